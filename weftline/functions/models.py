"""Injected model calls: an embedder and an extractor, with deterministic defaults."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType

DIMENSIONS, BATCH = 64, 64


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> np.ndarray: ...


class Extractor(Protocol):
    def __call__(self, prompt: str) -> dict: ...


def hashed_vectors(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """Words hashed to signed places, at unit length: the default embedder."""
    out = np.zeros((len(texts), dimensions), np.float32)
    for i, text in enumerate(texts):
        for word in re.findall(r"\w+", text.lower()):
            h = xxhash.xxh64_intdigest(word, 1)
            out[i, h % dimensions] += 1 if h >> 63 else -1
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(size == 0, 1, size)


def embedded(df: DataFrame, column: str, embedder: Embedder = hashed_vectors, name: str = "vector") -> DataFrame:
    """``df`` with a vector of each text, asked for in batches of 64; a batch that fails gives zeros."""

    @F.pandas_udf(ArrayType(FloatType()))
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for i in range(0, len(texts), BATCH):
            part = [t or "" for t in texts[i : i + BATCH]]
            try:
                out += [v.tolist() for v in embedder(part)]
            except Exception:
                out += [[0.0] * DIMENSIONS for _ in part]
        return pd.Series(out)

    return df.withColumn(name, run(F.col(column)))


def missing_vectors(rows: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows without a cached vector, and the cache without vectors of rows that are gone."""
    return rows.join(cache.select(key), key, "left_anti"), cache.join(rows.select(key), key, "left_semi")


def extracted(df: DataFrame, prompt: Column, schema: str, extractor: Extractor, name: str = "found") -> DataFrame:
    """``df`` with the extractor's answer to each prompt, read by a schema; answers that fail or don't fit are null."""

    def answer(prompt: str | None) -> str | None:
        try:
            return json.dumps(extractor(prompt or ""))
        except Exception:
            return None

    @F.pandas_udf(StringType())
    def ask(prompts: pd.Series) -> pd.Series:
        return pd.Series([answer(p) for p in prompts], dtype=object)

    return df.withColumn(name, F.from_json(ask(prompt), schema))


def json_answer(raw: Column) -> Column:
    """A model's answer without code fences and line comments, as a variant; null if it is no JSON.

    Comments are cut wherever two slashes stand, in addresses as well.
    """
    bare = F.regexp_replace(F.trim(raw), r"^```(?:json)?[ \t]*\n?|\n?```$", "")
    return F.try_parse_json(F.regexp_replace(bare, r"//[^\n]*", ""))


def accent_fold(text: str | None) -> str:
    """NFKD without marks, lower case, letters and digits alone."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c))
    return re.sub(r"[^a-z0-9]+", " ", plain.lower()).strip()


def accent_folded(text: Column) -> Column:
    @F.pandas_udf(StringType())
    def fold(texts: pd.Series) -> pd.Series:
        return texts.map(accent_fold)

    return fold(text)


def mapped(df: DataFrame, f: Callable[[str], str], column: str, name: str) -> DataFrame:
    """A column made by a Python function of another, in Arrow batches."""

    @F.pandas_udf(StringType())
    def run(values: pd.Series) -> pd.Series:
        return values.map(f)

    return df.withColumn(name, run(F.col(column)))


# How a claim can be checked, and what can come of it.
METHODS, OUTCOMES = ("manual", "model", "external"), ("CONFIRMED", "CONTRADICTED", "UNRESOLVABLE")
CONTEXT_CHARS, UNSURE = 2000, 0.5


def verified(claims: DataFrame, verifier: Extractor, context: str = "") -> DataFrame:
    """``claims(id, claim, method)`` with outcome, confidence and notes.

    Manual claims, external ones (no service is configured) and those of unknown methods are unresolvable at confidence 0; the
    others go to the verifier, whose outcomes outside the known ones are unresolvable, as are claims on which it fails.
    """
    prompt = F.concat(F.lit(f"CONTEXT: {context[:CONTEXT_CHARS] or '(none)'}\nCLAIM: "), F.col("claim"))

    @F.pandas_udf("struct<outcome:string,confidence:double,notes:string>")
    def ask(prompts: pd.Series) -> pd.DataFrame:
        rows = []
        for p in prompts:
            try:
                found = verifier(p or "")
                outcome = str(found.get("outcome", "")).upper()
                rows.append((outcome if outcome in OUTCOMES else "UNRESOLVABLE", float(found.get("confidence", UNSURE)), str(found.get("notes", ""))))
            except Exception as e:
                rows.append(("UNRESOLVABLE", 0.0, f"failed: {e}"))
        return pd.DataFrame(rows, columns=["outcome", "confidence", "notes"])

    by_model = claims.where("method = 'model'").select("*", ask(prompt).alias("r")).select(*claims.columns, "r.outcome", "r.confidence", "r.notes")
    note = F.when(F.col("method") == "external", "not configured").otherwise("for review")
    by_hand = claims.where(~F.col("method").eqNullSafe("model")).select(*claims.columns, F.lit("UNRESOLVABLE").alias("outcome"), F.lit(0.0).alias("confidence"), note.alias("notes"))
    return by_model.unionByName(by_hand)
