"""Ranking, fusion and packing under budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions import vectors as V
from weftline.session import Scratch

K1, B, NUMBER_WEIGHT = 1.2, 0.75, 1.75


def _counted(text: Column | None, terms: dict[str, float]) -> Column:
    """struct(len, hits): the number of a text's tokens, and those of the query among them; the text is cut once."""
    tokens = T.search_tokens(text) if text is not None else F.array().cast("array<string>")
    return F.transform(F.array(tokens), lambda x: F.struct(F.size(x).alias("len"), F.filter(x, lambda w: w.isin(*terms)).alias("hits")))[0]


def bm25(docs: DataFrame, words: list[str], k: int, title: Column | None = None, body: Column | None = None) -> DataFrame:
    """(id, score): the k best of ``docs(id, ...)`` by BM25, ties to the smaller id.

    Term frequency counts the body once and the title twice, length the body alone; expansions weigh 0.55 and
    numbers 1.75. Only the query's own tokens leave a document, into a scratch table that is read for the
    statistics, one row, and for the scores.
    """
    terms = T.query_terms(words)
    if not terms:
        return docs.select("id", F.lit(0.0).alias("score")).limit(0)
    own = Scratch(docs.sparkSession).save(docs.select("id", _counted(F.col("text") if body is None else body, terms).alias("b"), _counted(title, terms).alias("t")))
    count = lambda where, term: F.size(F.filter(where, lambda x: x == F.lit(term)))
    tfs = [(count("b.hits", t) + 2 * count("t.hits", t)).cast("double") for t in terms]
    slim = own.select("id", F.greatest(F.col("b.len"), F.lit(1)).alias("len"), F.array(*tfs).alias("tf"))
    stats = slim.agg(
        F.count("*").cast("double").alias("n"), F.avg("len").alias("mean"), F.array(*[F.count_if(F.col("tf")[i] > 0).cast("double") for i in range(len(terms))]).alias("df")
    )
    score = F.lit(0.0)
    for i, (term, weight) in enumerate(terms.items()):
        tf, df = F.col("tf")[i], F.col("df")[i]
        factor = weight * (NUMBER_WEIGHT if term[0].isdigit() else 1.0)
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        full = tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.greatest(F.col("mean"), F.lit(1.0))))
        score = score + F.when(tf > 0, factor * idf * full).otherwise(0.0)
    scored = slim.where(F.exists("tf", lambda x: x > 0)).crossJoin(F.broadcast(stats))  # one row
    return scored.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(k)


def bm25_sql(words: list[str], docs: str, k: int) -> str:
    """The same in DuckDB over ``docs``, a query with id and text."""
    terms = T.query_terms(words)
    n = len(terms)
    tf = "[" + ", ".join(f"CAST(len(list_filter(b, lambda x: x = '{t}')) AS DOUBLE)" for t in terms) + "]"
    df = "[" + ", ".join(f"CAST(count(*) FILTER (tf[{i + 1}] > 0) AS DOUBLE)" for i in range(n)) + "]"
    parts = []
    for i, (term, weight) in enumerate(terms.items(), 1):
        factor = weight * (NUMBER_WEIGHT if term[0].isdigit() else 1.0)
        parts.append(
            f"CASE WHEN tf[{i}] > 0 THEN CAST({factor} AS DOUBLE) * ln(1 + (n - df[{i}] + 0.5) / (df[{i}] + 0.5)) * (tf[{i}] * CAST({K1 + 1} AS DOUBLE) / "
            f"(tf[{i}] + CAST({K1} AS DOUBLE) * (CAST({1 - B} AS DOUBLE) + CAST({B} AS DOUBLE) * len / greatest(mean, 1)))) ELSE 0 END"
        )
    return f"""
tokens AS (SELECT id, {T.search_tokens_sql("text")} AS b FROM ({docs})),
slim AS (SELECT id, greatest(len(b), 1) AS len, {tf} AS tf FROM tokens),
stats AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len) AS mean, {df} AS df FROM slim),
lexical AS (SELECT id, {" + ".join(parts)} AS score FROM slim, stats WHERE len(list_filter(tf, lambda x: x > 0)) > 0 ORDER BY score DESC, id LIMIT {k})"""


def cosine_top(vectors: DataFrame, probe: list[float], least: float, k: int) -> DataFrame:
    """(id, similarity): the k nearest of ``vectors(id, v)`` to one vector, at ``least`` or more, ties to the smaller id."""
    sim = V.cosine(F.col("v"), F.array(*[F.lit(float(x)) for x in probe]))
    return vectors.select("id", sim.alias("similarity")).where(F.col("similarity") >= least).orderBy(F.desc("similarity"), "id").limit(k)


def nearest(vectors: DataFrame, queries: DataFrame, least: float, k: int) -> DataFrame:
    """(query_id, id, similarity, rank): the k nearest rows to each query ``queries(query_id, q)``, itself left out.

    ``queries`` is a set of a few probes whose number does not grow with the data, so it is broadcast.
    """
    pairs = vectors.join(F.broadcast(queries), F.col("id") != F.col("query_id")).select("query_id", "id", V.cosine(F.col("v"), F.col("q")).alias("similarity"))
    best = W.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return pairs.where(F.col("similarity") >= least).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def reciprocal_rank_fusion(dense: DataFrame, lexical: DataFrame, k: int, constant: float = 60.0) -> DataFrame:
    """(id, score, dense, lexical) of two ranked results (id, score), by the sum of 1 / (60 + rank).

    Both results are top-k lists, so a window without partitions ranks a bounded number of rows.
    """
    place = lambda df, name: df.select(F.col("id"), F.col("score").alias(name), F.row_number().over(W.orderBy(F.desc("score"), "id")).alias(f"{name}_rank"))
    both = place(dense, "dense").join(place(lexical, "lexical"), "id", "full")
    part = lambda c: F.coalesce(1 / (constant + F.col(c)), F.lit(0.0))
    return (
        both.select("id", (part("dense_rank") + part("lexical_rank")).alias("score"), F.coalesce("dense", F.lit(0.0)).alias("dense"), F.coalesce("lexical", F.lit(0.0)).alias("lexical"))
        .orderBy(F.desc("score"), "id").limit(k)
    )


def greedy_pack(items: Column, budget: float, start: Column | None = None) -> Column:
    """Ids of an ordered array of struct(id, cost) that fit: one that overflows is skipped, later ones go on."""
    zero = F.struct(F.lit(0.0).alias("used") if start is None else start.cast("double").alias("used"), F.array().cast("array<string>").alias("taken"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["cost"] <= budget
        return F.struct(
            F.when(fits, acc["used"] + x["cost"]).otherwise(acc["used"]).alias("used"),
            F.when(fits, F.concat(acc["taken"], F.array(x["id"]))).otherwise(acc["taken"]).alias("taken"),
        )

    return F.aggregate(items, zero, step)


def newest_within(messages: DataFrame, budget: int, overhead: int = 20, per_token: int = 4) -> DataFrame:
    """Messages of a chat from the newest back until the first that overflows the budget.

    ``messages(chat, turn, text)`` gain tokens = (length + overhead) div per_token and used, the running sum.
    """
    cost = messages.withColumn("tokens", F.floor((F.length("text") + overhead) / per_token).cast("long"))
    back = W.partitionBy("chat").orderBy(F.desc("turn")).rowsBetween(W.unboundedPreceding, 0)
    return cost.withColumn("used", F.sum("tokens").over(back)).where(F.col("used") <= budget)


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group, with their rank."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col(name) <= k)
