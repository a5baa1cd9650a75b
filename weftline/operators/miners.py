"""Miners around injected model calls: what goes to the model, and what of its answer is kept.

A model is a function from a prompt to a dictionary (``models.Extractor``). All else, segmentation, prompts, schemas, filters,
merging and the fallbacks for answers that fail or lack a part, is done here, row by row and in parallel.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions import render as R
from weftline.functions import text as T
from weftline.functions.models import Extractor, extracted
from weftline.operators import aggregate as A
from weftline.operators import dedup as D
from weftline.operators import segment as G
from weftline.operators import windows as S
from weftline.operators.proposals import fresh_corpus
from weftline.operators.records import is_heading

# Characters of a message and of a segment in a prompt, the least segment, handles listed, categories of directives, least text of a slab,
# batch of orphans, verdicts of a disambiguation.
MESSAGE_CHARS, SEGMENT_CHARS, SEGMENT_LEAST, LISTED = 500, 4000, 100, 20
CATEGORIES = ("rule", "invariant", "warning", "heuristic", "non_assumption", "intent", "definition")
DIRECTIVE_LEAST, ORPHANS, LABEL_TITLES = 20, 60, 10
STATUSES = ("CONFIRMED", "DRIFTED", "RETRACTED", "UNTOUCHED")
PROPOSAL = "array<struct<type:string,canonical_phrase:string,title:string,canonical_text:string,label:string,aliases:array<string>,justification:string,confidence:double>>"
EDGE = "array<struct<type:string,from_label:string,to_label:string,confidence:double>>"


def _plain(c: str | Column) -> Column:
    return F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))


def chunk_prompts(pairs: DataFrame, handles: list[str] = ()) -> DataFrame:
    """(key, topic, prompt) of ``pairs(key, topic, pair, user, assistant)``: 500 characters a message, 4000 a chunk; chunks under 100 have none."""
    one = F.concat(F.lit("User: "), F.substring(F.coalesce("user", F.lit("")), 1, MESSAGE_CHARS))
    two = F.when(F.col("assistant").isNotNull(), F.concat(F.lit("\n\nAssistant: "), F.substring("assistant", 1, MESSAGE_CHARS))).otherwise("")
    segments = R.joined(pairs.withColumn("line", F.concat(one, two)), ["key", "topic"], ["pair"], "line", "\n\n").where(F.length("text") >= SEGMENT_LEAST)
    known = f"\n\nKNOWN: {', '.join(list(handles)[:LISTED])}" if handles else ""
    return segments.select("key", "topic", F.concat(F.lit("TOPIC: "), "topic", F.lit("\n"), F.substring("text", 1, SEGMENT_CHARS), F.lit(known)).alias("prompt"))


def proposals(prompts: DataFrame, extractor: Extractor, least: float = 0.0) -> DataFrame:
    """(key, topic, n, type, phrase, title, text, label, aliases, justification, confidence): typed proposals of the answers.

    An answer that fails or has no list gives none. A proposal needs its phrase, its title and text, or its label, and ``least`` confidence,
    which is .5 where there is none.
    """
    told = extracted(prompts, F.col("prompt"), f"struct<proposals:{PROPOSAL}>", extractor)
    p = told.select("key", "topic", F.posexplode("found.proposals").alias("n", "p")).select("key", "topic", "n", "p.*")
    kept = F.when(F.col("type") == "anchor", _plain("canonical_phrase") != "").when(F.col("type") == "slab", (_plain("title") != "") & (_plain("canonical_text") != "")).when(F.col("type") == "bundle", _plain("label") != "").otherwise(False)
    confidence = T.clamp01(F.coalesce("confidence", F.lit(0.5)))
    return p.where(kept & (confidence >= least)).select(
        "key", "topic", "n", "type", F.trim("canonical_phrase").alias("phrase"), F.trim("title").alias("title"), F.trim("canonical_text").alias("text"), F.trim("label").alias("label"),
        F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), _plain("justification").alias("justification"), confidence.alias("confidence"),
    )


def merged(rows: DataFrame) -> DataFrame:
    """Proposals of one type and label as one, the most confident, in the order in which they were first made."""
    label = F.coalesce("phrase", "title", "label")
    placed = rows.withColumn("label", label).withColumn("ord", F.struct("key", "n"))
    return D.best_proposals(placed)


def conversation(messages: DataFrame, banks: dict[str, list[str]], extractor: Extractor, handles: list[str] = (), least: float = 0.0) -> DataFrame:
    """Proposals of ``messages(chat, turn, role, text)``: pairs, chunks of four that overlap by half, the best topic of each, one prompt a chunk."""
    pairs = S.pair_exchanges(messages)
    chunks = S.chunk_pairs(pairs)
    texts = messages.select("chat", F.col("turn").alias("t"), F.col("text").alias("x"))
    said = lambda name: texts.select("chat", F.col("t").alias(f"{name}_turn"), F.col("x").alias(name))
    full = chunks.join(said("user"), ["chat", "user_turn"], "left").join(said("assistant"), ["chat", "assistant_turn"], "left").withColumn("key", F.struct("chat", "start"))
    whole = R.joined(full.withColumn("line", F.concat_ws(" ", "user", "assistant")), ["key"], ["pair"], "line", " ")
    topics = A.topic_scores(whole.withColumnRenamed("key", "id"), banks).select(F.col("id").alias("key"), "topic")
    prompts = chunk_prompts(full.join(topics, "key").select("key", "topic", "pair", "user", "assistant"), handles)
    return merged(proposals(prompts, extractor, least))


def document(docs: DataFrame, extractor: Extractor, limit: int = 8000, least: float = 0.0) -> DataFrame:
    """Proposals of ``docs(doc_id, text)``: one prompt a segment, whatever the kind of text; the heading that holds a segment's start is its topic."""
    parts = G.segmented(docs.select("doc_id", "text"), limit).where(F.length("part") >= SEGMENT_LEAST)
    heads = G.outlined(docs.select("doc_id", "text")).groupBy("doc_id").agg(F.min_by("label", "start").alias("first"))
    prompts = parts.join(heads, "doc_id", "left").select(F.struct("doc_id", "segment").alias("key"), F.coalesce("first", F.lit("")).alias("topic"), F.concat(F.lit("TEXT:\n"), "part").alias("prompt"))
    return merged(proposals(prompts, extractor, least))


def classified(messages: DataFrame, extractor: Extractor, functions: list[str], fallback: str) -> DataFrame:
    """``messages`` with function, affect, volatility and rigor as the model sees them; unknown functions are the fallback, signals are clamped and .0 where missing."""
    told = extracted(messages, F.concat(F.lit("MESSAGE: "), F.coalesce("text", F.lit(""))), "struct<function:string,affect:double,volatility:double,rigor:double>", extractor)
    known = F.when(F.col("found.function").isin(*functions), F.col("found.function")).otherwise(fallback)
    signal = lambda c: T.clamp01(F.coalesce(F.col(f"found.{c}"), F.lit(0.0))).alias(c)
    return told.select(*messages.columns, known.alias("function"), signal("affect"), signal("volatility"), signal("rigor"))


def directives(slabs: DataFrame, extractor: Extractor, hint: str = "") -> DataFrame:
    """(id, n, category, quote, paraphrase, confidence) of ``slabs(id, title, text)`` of twenty characters or more; unknown categories and empty quotes go."""
    own = slabs.where(F.length(_plain("text")) >= DIRECTIVE_LEAST)
    prompt = F.concat(F.lit(f"CONTEXT: {hint}\nID: "), "id", F.lit("\nTITLE: "), F.coalesce("title", F.lit("")), F.lit("\nTEXT:\n"), "text")
    told = extracted(own, prompt, "struct<extractions:array<struct<category:string,quote:string,paraphrase:string,confidence:double>>>", extractor)
    rows = told.select("id", F.posexplode("found.extractions").alias("n", "e")).select("id", "n", F.lower(_plain(F.col("e.category"))).alias("category"), _plain(F.col("e.quote")).alias("quote"), _plain(F.col("e.paraphrase")).alias("paraphrase"), T.clamp01(F.coalesce("e.confidence", F.lit(0.5))).alias("confidence"))
    return rows.where(F.col("category").isin(*CATEGORIES) & (F.col("quote") != ""))


def merged_by_model(bundles: DataFrame, answers: DataFrame) -> DataFrame:
    """(id, label, intent, sources, depends_on, supports): bundles merged as ``answers(n, label, intent, sources)`` say, and all others as they are.

    An answer needs a label, an intent and a known source, and unites the references of its sources; its id is the slug of the label, numbered
    where it repeats. ``bundles(id, label, intent, depends_on, supports)`` that no answer names are carried through.
    """
    some = answers.where((_plain("label") != "") & (F.size(F.filter("intent", lambda i: F.trim(i) != "")) > 0))
    named = some.select("n", F.trim("label").alias("label"), F.slice(F.filter(F.transform("intent", lambda i: F.trim(i)), lambda i: i != ""), 1, 5).alias("intent"), F.explode(F.array_distinct("sources")).alias("source"))
    own = bundles.select(F.col("id").alias("source"), "depends_on", "supports")
    flat = named.join(own, "source").groupBy("n").agg(
        F.first("label").alias("label"), F.first("intent").alias("intent"), F.sort_array(F.collect_set("source")).alias("sources"),
        F.array_distinct(F.flatten(F.collect_list("depends_on"))).alias("d"), F.array_distinct(F.flatten(F.collect_list("supports"))).alias("s"),
    )
    ids = D.numbered(flat.withColumn("slug", F.concat(F.lit("bundle_"), T.slug(F.col("label"), 30, "x"))), [F.col("n")])
    out = ids.select(F.concat("new_id", F.lit("_v1")).alias("id"), "label", "intent", "sources", F.sort_array("d").alias("depends_on"), F.sort_array(F.array_union("s", "d")).alias("supports"))
    left = bundles.join(named.select(F.col("source").alias("id")).distinct(), "id", "left_anti")
    return out.unionByName(left.select("id", "label", "intent", F.array("id").alias("sources"), F.sort_array("depends_on").alias("depends_on"), F.sort_array("supports").alias("supports")))


def grouped(groups: DataFrame, slabs: DataFrame, assignments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (group, id) of a model's grouping, and the slabs that are still in none.

    ``groups(group, members)`` and, for slabs that no group names, ``assignments(id, group)``; ids are repaired of brackets and doubled
    prefixes, unknown ids and groups are left out, and a slab stays in its first group.
    """
    bare = lambda c: F.regexp_replace(F.regexp_replace(F.trim(c), r"^\[|\]$", ""), r"^(?:id=)+", "")
    first = groups.select("group", F.explode("members").alias("m")).select("group", bare(F.col("m")).alias("id")).join(slabs.select("id"), "id", "left_semi")
    own = first.groupBy("id").agg(F.min("group").alias("group"))
    late = assignments.select(bare(F.col("id")).alias("id"), "group").join(slabs.select("id"), "id", "left_semi").join(own, "id", "left_anti").join(groups.select("group").distinct(), "group", "left_semi")
    members = own.select("group", "id").unionByName(late.groupBy("id").agg(F.min("group").alias("group")).select("group", "id"))
    return members, slabs.select("id").join(members, "id", "left_anti")


def orphan_batches(orphans: DataFrame, order: list[Column], size: int = ORPHANS) -> DataFrame:
    """Orphans with the number of their batch of at most ``size``, dealt by hash so that no task numbers them all."""
    total = orphans.agg(F.greatest(F.ceil(F.count("*") / size), F.lit(1)).alias("batches"))
    return orphans.crossJoin(F.broadcast(total)).withColumn("batch", F.pmod(F.xxhash64(*order), F.col("batches"))).drop("batches")  # one row


def labelled_clusters(clusters: DataFrame, extractor: Extractor) -> DataFrame:
    """(cluster, label, summary) of ``clusters(cluster, titles)``: the model's label of ten titles, or the common leading words of five, or the first title."""
    shown = F.slice("titles", 1, LABEL_TITLES)
    told = extracted(clusters, F.concat(F.lit("TITLES:\n"), F.array_join(shown, "\n")), "struct<label:string,summary:string>", extractor)
    words = F.transform(F.slice("titles", 1, 5), lambda t: F.slice(F.split(t, r"\s+"), 1, 3))
    common = lambda k: F.size(F.array_distinct(F.transform(words, lambda w: F.array_join(F.slice(w, 1, k), " ")))) == 1
    first = F.get("titles", F.lit(0))
    lead = lambda k: F.array_join(F.slice(F.split(first, r"\s+"), 1, k), " ")
    fallback = F.when(common(3), lead(3)).when(common(2), lead(2)).when(common(1), lead(1)).otherwise(first)
    label = F.when(_plain("found.label") != "", F.trim("found.label")).otherwise(F.coalesce(fallback, F.lit("")))
    return told.select("cluster", label.alias("label"), _plain("found.summary").alias("summary"))


def rewritten(pending: DataFrame, done: DataFrame, extractor: Extractor) -> DataFrame:
    """(id, title, before, after, verdict): drafts that no rewrite has been made of yet, grounded by the model.

    ``pending(id, title, text, context)``. A rewrite may not change the title (``breach``, the text stays); an empty or failed answer
    leaves the text (``kept``).
    """
    todo = pending.join(done.select("id"), "id", "left_anti")
    told = extracted(todo, F.concat(F.lit("CONTEXT:\n"), F.coalesce("context", F.lit("")), F.lit("\nTITLE: "), "title", F.lit("\nTEXT:\n"), "text"), "struct<title:string,text:string>", extractor)
    same = F.col("found.title").isNull() | (T.label_key(F.col("found.title")) == T.label_key(F.col("title")))
    verdict = F.when(_plain("found.text") == "", "kept").when(~same, "breach").otherwise("rewritten")
    return told.select("id", "title", F.col("text").alias("before"), F.when(verdict == "rewritten", F.col("found.text")).otherwise(F.col("text")).alias("after"), verdict.alias("verdict"))


def disambiguated(drafts: DataFrame, turns: DataFrame, extractor: Extractor) -> DataFrame:
    """(id, status, reason) of ``drafts(id, status, chat, source_turn, references)`` that were referred to once, as the model reads both turns.

    ``turns(chat, turn, text)``. Drafts with another number of references, or with a turn that is missing or blank, keep their status, as
    do those whose answer is no known status.
    """
    once = drafts.where(F.size("references") == 1).withColumn("ref", F.col("references")[0])
    said = lambda key, name: turns.where(_plain("text") != "").select("chat", F.col("turn").alias(key), F.col("text").alias(name))
    both = once.join(said("source_turn", "a"), ["chat", "source_turn"]).join(said("ref", "b"), ["chat", "ref"])
    told = extracted(both, F.concat(F.lit("RAISED: "), "a", F.lit("\nREFERENCE: "), "b"), "struct<status:string,reason:string>", extractor)
    new = told.select("id", F.upper(_plain("found.status")).alias("new"), _plain("found.reason").alias("why"))
    out = drafts.select("id", "status").join(new, "id", "left")
    return out.select("id", F.when(F.col("new").isin(*STATUSES), F.col("new")).otherwise(F.col("status")).alias("status"), F.coalesce("why", F.lit("")).alias("reason"))


def marked_sections(raw: str | None, marks: list[tuple[str, str]]) -> list[dict]:
    """Sections that tile a text, from (label, first words) in order: each mark is sought behind the one before; marks that are not found go.

    The first section begins at 0; sections without text are left out.
    """
    text = (raw or "").replace("\r\n", "\n").replace("\r", "\n")
    found, cursor = [], 0
    for label, mark in marks:
        label, mark = (label or "").strip(), (mark or "").strip()
        at = text.find(mark, cursor) if label and mark else -1
        if at >= 0:
            found.append([label, at])
            cursor = at + 1
    if not found:
        return []
    found[0][1] = 0
    ends = [at for _, at in found[1:]] + [len(text)]
    return [{"label": label, "start": at, "end": end} for (label, at), end in zip(found, ends, strict=True) if text[at:end].strip()]


_MARKS = "array<struct<label:string,starts_with:string>>"


def outlined_by_model(docs: DataFrame, extractor: Extractor, digest: Column | None = None) -> DataFrame:
    """(doc_id, n, label, start, end) of ``docs(doc_id, text)`` without headings: the sections that the model marks in a digest of the text.

    Marks are sought in the whole text, each behind the one before; the sections tile the text from its beginning.
    """
    told = extracted(docs, F.concat(F.lit("DOCUMENT:\n"), F.col("text") if digest is None else digest), f"struct<sections:{_MARKS}>", extractor)

    @F.pandas_udf("array<struct<label:string,start:int,end:int>>")
    def tiled(texts: pd.Series, marks: pd.Series) -> pd.Series:
        return pd.Series([marked_sections(t, [(m["label"], m["starts_with"]) for m in (ms if ms is not None else [])]) for t, ms in zip(texts, marks, strict=True)])

    rows = told.select("doc_id", F.posexplode(tiled("text", "found.sections")).alias("n", "s"))
    return rows.select("doc_id", "n", "s.label", "s.start", "s.end")


def drilled(sections: DataFrame, extractor: Extractor, base: int = 1000, least: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Slabs (doc_id, path, n, title, text, position) and spine edges (doc_id, src, dst) of ``sections(doc_id, place, path, text)``: one prompt a leaf.

    A slab's position is its leaf's place times ``base`` plus its number; the spine leads from each slab to the next one of the document.
    """
    prompts = sections.where(F.length(_plain("text")) >= SEGMENT_LEAST).select(F.struct("doc_id", "place", "path").alias("key"), F.col("path").alias("topic"), F.concat(F.lit("SECTION: "), "path", F.lit("\n"), "text").alias("prompt"))
    slabs = proposals(prompts, extractor, least).where("type = 'slab'").select("key.doc_id", "key.path", "n", "title", "text", (F.col("key.place") * base + F.col("n")).alias("position"))
    spine = S.sequence_edges(slabs.select("doc_id", "position", F.col("position").alias("id")), ["doc_id"], ["position"])
    return slabs, spine


def leaves(sections: DataFrame, most: int) -> DataFrame:
    """(doc_id, place, path, text) of ``sections(doc_id, idx, path, text)``: those without sections below them; a text longer than ``most`` is cut into parts.

    The parts of a dense section are its sub-sections, ``path / 1`` and on.
    """
    below = sections.select("doc_id", F.col("path").alias("other"))
    inner = sections.select("doc_id", "path").join(below, "doc_id").where(F.startswith("other", F.concat("path", F.lit(" / ")))).select("doc_id", "path").distinct()
    leaf = sections.join(inner, ["doc_id", "path"], "left_anti")
    parts = G.segmented(leaf.withColumn("whole", F.length("text")), most)
    several = F.max("segment").over(W.partitionBy("doc_id", "idx")) > 0
    return parts.select("doc_id", (F.col("idx") * 100 + F.col("segment")).alias("place"), F.when(several, F.concat("path", F.lit(" / "), (F.col("segment") + 1).cast("string"))).otherwise(F.col("path")).alias("path"), F.col("part").alias("text"))


def explicit(messages: DataFrame, extractor: Extractor, last: int = 10, most: int = 10) -> DataFrame:
    """Proposals of the last messages of each chat, ``messages(chat, turn, role, text)``: no headings, the first ``most`` of a chat by confidence."""
    k = F.row_number().over(W.partitionBy("chat").orderBy(F.desc("turn")))
    tail = messages.withColumn("k", k).where(F.col("k") <= last).withColumn("line", F.concat(F.lit("["), "role", F.lit("] "), F.substring(F.coalesce("text", F.lit("")), 1, MESSAGE_CHARS)))
    prompts = R.joined(tail, ["chat"], ["turn"], "line").select(F.col("chat").alias("key"), F.lit("").alias("topic"), F.col("text").alias("prompt"))
    found = proposals(prompts, extractor).where(~((F.col("type") == "anchor") & is_heading(F.col("phrase"))))
    rank = F.row_number().over(W.partitionBy("key").orderBy(F.desc("confidence"), "n"))
    return found.withColumn("rank", rank).where(F.col("rank") <= most)


def remined(docs: DataFrame, extractor: Extractor, limit: int = 8000) -> dict[str, DataFrame]:
    """A fresh corpus of ``docs(doc_id, text)``: mined, merged, and given ids of its content."""
    found = document(docs, extractor, limit).select(F.struct("key", "n").alias("o"), "type", "phrase", "title", "text", F.col("label"), "aliases", "justification")
    placed = found.withColumn("ord", F.xxhash64("o"))  # any order that reruns repeat
    return fresh_corpus(placed, placed.limit(0).select("title", "ord", "phrase", "aliases"))
