"""A caller's rows as one column, so that names of an operator's own never meet the caller's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def packed(docs: DataFrame) -> DataFrame:
    """(row): all columns of ``docs`` in a struct."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))


def field(name: str) -> Column:
    return F.col("row").getField(name)


def unpacked(docs: DataFrame, replaced: dict[str, Column] | None = None) -> list[Column]:
    """The columns of ``docs`` from the struct, some of them replaced, under their names and in their order."""
    return [(replaced or {}).get(c, field(c)).alias(c) for c in docs.columns]
