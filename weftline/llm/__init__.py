"""Training-data operators: sharding, search, scans, deduplication, scoring, mixing, tokens."""
