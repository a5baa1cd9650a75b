"""All queries on the tables, by family."""

from __future__ import annotations

from weftline.plans import aggregates, archives, compositions, details, drafts, extras, files, graphs, lookups, matching, mining, ranking, records, sequences, states, texts

FAMILIES = (ranking, aggregates, sequences, graphs, lookups, states, texts, compositions, details, extras, matching, drafts, files, mining, records, archives)


def queries() -> dict:
    return {k: v for f in FAMILIES for k, v in f.registry.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for f in FAMILIES for k, v in f.registry.sql.items()}
