import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, digest string, score string, line string, target string, __id string, __key string, __gone string, h string, row string, kept string, copies string, __copies string, __source string, __last string, __text_key string, `__kept_text` string"
LONG = "word " * 30000 + "end"
PASSAGE = " ".join(f"passage{i}" for i in range(60))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and then runs far away from here."),
    (2, None),
    (3, ""),
    (4, " \n\t "),
    (5, "The quick brown fox jumps over the lazy dog and then runs far away from here."),
    (6, "The  QUICK brown fox jumps\nover the lazy dog and then runs far away from here."),
    (7, LONG),
    (8, LONG + " tail"),
    (9, "Étude à café 漢字 ﬁne ß İ <|endoftext|> it's 12 %%"),
    (9, "Étude à café 漢字 ﬁne ß İ <|endoftext|> it's 12 %%"),
    (None, "no id at all"),
    (10, "first line of ten words which will be repeated soon here\nother"),
    (11, "before\nfirst line of ten words which will be repeated soon here\nafter"),
    (12, "x" * 5000),
    (13, f"Some start. {PASSAGE} Some end."),
    (14, f"Another beginning, longer than that! {PASSAGE} Finis."),
    (15, "Licensed under the Apache License, Version 2.0.\nUnrelated text."),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and long texts, repeats, ties, and extra columns whose names clash with those of operators."""
    rows = [(i, t, None, None if i is None or i % 3 == 0 else f"s{i % 3}", None, "x", "y", "z", "l", "t", *"abcdefghijkl") for i, t in ROWS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def rows(docs):
    return sorted((r.doc_id, r.text) for r in docs.collect())
