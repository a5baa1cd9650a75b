"""weftline: document, conversation and graph analytics on Spark DataFrames."""
