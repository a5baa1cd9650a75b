"""Proposals of a miner as typed objects: temporary, fresh and committed-style corpora, and their consolidation.

``proposals(ord, type, phrase, title, text, label, aliases, description, justification, confidence)`` are in the order of
``ord``; ``relations(ord, type, from_label, to_label, confidence)`` name their ends by label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators.dedup import consolidation
from weftline.operators.match import label_index, resolve_labels
from weftline.session import Scratch

# Types of edges, the type of unknown ones, and the ending of a slab's own bundle.
EDGE_TYPES = ("INVOKES", "SUPPORTS", "CONFLICTS", "TENSIONS", "LINKS", "SEQUENCE", "PARENT_OF")
OTHER_TYPE, COHERENCE = "LINKS", "_coherence_v1"
_PLACES = 1 << 20  # labels of one proposal at most


def _plain(column: str) -> Column:
    return F.trim(F.coalesce(F.col(column), F.lit("")))


def _kind() -> Column:
    return F.when(F.upper(F.trim("type")).isin(*EDGE_TYPES), F.upper(F.trim("type"))).otherwise(OTHER_TYPE)


def _named(proposals: DataFrame, ident: Column) -> DataFrame:
    """Proposals that have what their type needs, with an id and their label: phrase, title or label."""
    name = F.when(F.col("type") == "anchor", _plain("phrase")).when(F.col("type") == "slab", _plain("title")).otherwise(_plain("label"))
    needed = F.when(F.col("type") == "anchor", _plain("phrase")).when(F.col("type") == "slab", _plain("text")).when(F.col("type") == "bundle", F.lit("x")).otherwise("")
    own = proposals.withColumn("id", ident).withColumn("name", name).where(needed != "")
    return own.withColumn("name", F.when((F.col("name") == "") & (F.col("type") != "anchor"), F.concat(F.initcap("type"), F.lit(" "), "id")).otherwise(F.col("name")))


def labels_of(objects: DataFrame) -> DataFrame:
    """(label, id, priority): names, then aliases of anchors, in the order of the objects."""
    aliases = F.when(F.col("type") == "anchor", F.coalesce("aliases", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    each = objects.select("id", "ord", F.posexplode(F.concat(F.array("name"), aliases)).alias("n", "label"))
    return each.select("label", "id", (F.col("ord") * _PLACES + F.col("n")).alias("priority")).where("label is not null")


def resolved_relations(relations: DataFrame, labels: DataFrame, strict: bool = False) -> DataFrame:
    """(ord, type, src, dst, confidence, src_strategy, dst_strategy) of all relations; an end that resolves to nothing is null.

    ``strict`` looks labels up as they are or in lower case, and no further.
    """
    index = label_index(labels)
    ends = relations.select(_plain("from_label").alias("label")).unionByName(relations.select(_plain("to_label").alias("label"))).distinct()
    found = resolve_labels(ends, index)
    if strict:
        found = found.where("strategy in ('exact', 'miss')")
    found = Scratch(relations.sparkSession).save(found)
    own = relations.select("ord", _kind().alias("type"), _plain("from_label").alias("f"), _plain("to_label").alias("t"), F.col("confidence").cast("double").alias("confidence"))
    end = lambda key, name: found.select(F.col("label").alias(key), F.col("id").alias(name), F.col("strategy").alias(f"{name}_strategy"))
    return own.join(end("f", "src"), "f", "left").join(end("t", "dst"), "t", "left").drop("f", "t")


def strategy_counts(resolved: DataFrame) -> DataFrame:
    """(strategy, n): how the ends of relations were found, over both ends."""
    both = resolved.select(F.explode(F.array("src_strategy", "dst_strategy")).alias("strategy"))
    return both.groupBy(F.coalesce("strategy", F.lit("miss")).alias("strategy")).agg(F.count("*").alias("n"))


def _corpus(objects: DataFrame, relations: DataFrame) -> dict[str, DataFrame]:
    scratch = Scratch(objects.sparkSession)
    labels = scratch.save(labels_of(objects))
    resolved = scratch.save(resolved_relations(relations, labels))
    edges = resolved.where("src <> dst").select("ord", "type", "src", "dst", F.col("confidence").alias("weight"), "confidence")
    return {
        "anchors": objects.where("type = 'anchor'").select("id", "ord", F.col("name").alias("phrase"), "aliases", "description", "justification", "confidence"),
        "slabs": objects.where("type = 'slab'").select("id", "ord", F.col("name").alias("title"), F.trim("text").alias("text")),
        "bundles": objects.where("type = 'bundle'").select("id", "ord", F.col("name").alias("label"), "aliases"),
        "edges": edges, "labels": labels, "strategies": strategy_counts(resolved), "dropped": resolved.where("src is null or dst is null or src = dst"),
    }


def temporary_corpus(proposals: DataFrame, relations: DataFrame) -> dict[str, DataFrame]:
    """Anchors, slabs, bundles and edges of a draft, so that it can be analysed like a corpus.

    Bundles depend on the anchors that their aliases name and support the slabs that LINKS edges join to those.
    Proposals without a phrase or text, unresolved edges and self-loops are left out.
    """
    out = _corpus(_named(proposals, F.concat(F.lit("draft_"), "type", F.lit("_"), F.col("ord").cast("string"))), relations)
    member_labels = out["bundles"].select("id", F.explode(F.transform("aliases", lambda a: F.trim(a))).alias("label"))
    members = member_labels.join(resolve_labels(member_labels.select("label").distinct(), label_index(out["labels"])).select("label", F.col("id").alias("anchor")), "label")
    members = Scratch(proposals.sparkSession).save(members.join(out["anchors"].select(F.col("id").alias("anchor")), "anchor", "left_semi").select("id", "anchor").distinct())
    links = out["edges"].where("type = 'LINKS'")
    either = links.select(F.col("src").alias("anchor"), F.col("dst").alias("slab")).unionByName(links.select(F.col("dst").alias("anchor"), F.col("src").alias("slab")))
    reach = members.join(either, "anchor").join(out["slabs"].select(F.col("id").alias("slab")), "slab", "left_semi").select("id", "slab").distinct()
    return out | {"depends_on": members, "supports": reach}


def analysed(corpus: dict[str, DataFrame]) -> DataFrame:
    """The consolidation verdicts of a ``temporary_corpus``, by anchor."""
    return consolidation(corpus["anchors"], corpus["slabs"], corpus["edges"], corpus["depends_on"], corpus["supports"])


def consolidated(proposals: DataFrame, relations: DataFrame) -> dict[str, DataFrame]:
    """What is left of a draft after consolidation: proposals, relations, anchors written into slabs, and the summary.

    Demoted and orphaned anchors go, with the relations that name one of their labels; a demoted anchor is
    inlined into its slab, found by title.
    """
    corpus = temporary_corpus(proposals, relations)
    verdicts = Scratch(proposals.sparkSession).save(analysed(corpus).join(corpus["anchors"].select("id", "ord", "phrase", "aliases"), "id"))
    gone = verdicts.where("verdict <> 'KEEP'")
    dropped = gone.select(F.explode(F.concat(F.array("phrase"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("l")).select(T.label_key(F.col("l")).alias("key")).where("key <> ''").distinct()
    left = relations
    for end in ("from_label", "to_label"):
        left = left.withColumn("key", T.label_key(F.coalesce(F.col(end), F.lit("")))).join(dropped, "key", "left_anti").drop("key")
    titles = corpus["slabs"].select(F.col("id").alias("parent"), "title")
    inline = verdicts.where("verdict = 'DEMOTE'").join(titles, "parent").select("title", "ord", "phrase", "aliases")
    tally = verdicts.agg(F.count("*").alias("anchors"), *[F.count_if(F.col("verdict") == v).alias(n) for v, n in (("KEEP", "kept"), ("DEMOTE", "demoted"), ("ORPHAN", "orphans"))])
    edges = relations.agg(F.count("*").alias("a")).crossJoin(left.agg(F.count("*").alias("b"))).select((F.col("a") - F.col("b")).alias("edges_dropped"))  # one row each
    return {"proposals": proposals.join(gone.select("ord"), "ord", "left_anti"), "relations": left, "inline": inline, "summary": tally.crossJoin(edges)}


def committed_corpus(proposals: DataFrame, relations: DataFrame) -> dict[str, DataFrame]:
    """Proposals as committed objects, with the edges that resolve, how, and those that do not (``dropped``)."""
    return _corpus(_named(proposals.where("trim(coalesce(phrase, title, label, '')) <> ''"), T.stable_id("mined_", F.col("type"), F.col("ord").cast("string"))), relations)


def _content_id(prefix: str, text: Column) -> Column:
    return F.concat(T.stable_id(f"{prefix}_", F.lower(text)), F.lit("_v1"))


def fresh_corpus(proposals: DataFrame, inline: DataFrame) -> dict[str, DataFrame]:
    """Anchors and slabs under ids of their content, the first of equal ones; bundles are left to a later pass.

    ``inline(title, ord, phrase, aliases)`` are written into the slab of that title.
    """
    a = proposals.where((F.col("type") == "anchor") & (_plain("phrase") != "")).withColumn("phrase", _plain("phrase")).withColumn("id", _content_id("mined_anchor", F.col("phrase")))
    s = proposals.where((F.col("type") == "slab") & (_plain("text") != "")).withColumn("title", _plain("title")).withColumn("text", _plain("text"))
    s = s.withColumn("id", _content_id("mined_slab", F.concat("title", "text")))
    first = lambda df: df.withColumn("k", F.row_number().over(W.partitionBy("id").orderBy("ord"))).where("k = 1").drop("k")
    notes = F.substring(F.coalesce("justification", F.lit("")), 1, 240).alias("notes")
    held = inline.where(_plain("phrase") != "").groupBy("title").agg(F.array_sort(F.collect_list(F.struct("ord", "phrase", "aliases"))).alias("inline"))
    slabs = first(s).join(held, "title", "left").select("id", F.when(F.col("title") == "", F.substring("text", 1, 60)).otherwise(F.col("title")).alias("title"), "text", notes, "inline")
    return {"anchors": first(a).select("id", "phrase", "aliases", notes), "slabs": slabs}


def registered(packets: DataFrame) -> DataFrame:
    """(label, id, description, turns_seen, promoted): registry rows of ``packets(ord, id, type, phrase, title, text, justification)``.

    The label is the phrase, else the title, the first 60 characters of the text, or the id; the last packet of a label holds.
    """
    some = lambda c: F.when(c != "", c)
    of_slab = F.coalesce(some(F.col("title")), some(F.substring("text", 1, 60)), F.col("id"))
    label = F.when(F.col("type") == "anchor", F.coalesce(some(F.col("phrase")), F.col("id"))).when(F.col("type") == "slab", of_slab).otherwise(F.col("id"))
    rows = packets.withColumn("label", label).groupBy("label").agg(F.max_by(F.struct("id", "justification", "type"), "ord").alias("r"))
    known = F.when(F.col("r.type").isin("anchor", "slab", "bundle"), F.col("r.type"))
    return rows.select("label", "r.id", F.coalesce("r.justification", F.lit("")).alias("description"), F.lit(1).alias("turns_seen"), known.alias("promoted"))


def activated(frame: DataFrame, packets: DataFrame) -> DataFrame:
    """``frame(id, place)`` with the packets behind it that it does not hold yet, each once, in order."""
    new = packets.groupBy("id").agg(F.min("ord").alias("ord")).join(frame.select("id"), "id", "left_anti")
    last = frame.agg(F.coalesce(F.max("place"), F.lit(-1)).alias("last"))
    return frame.select("id", "place").unionByName(new.crossJoin(F.broadcast(last)).select("id", (F.col("last") + 1 + F.col("ord")).alias("place")))  # one row


def compatible(candidates: DataFrame, source: str) -> DataFrame:
    """Candidates that have a label, and slabs a text, with their label and topic path: their own, or the source's name."""
    kind = F.lower("type")
    label = F.when(kind == "anchor", F.col("phrase")).otherwise(F.col("title"))
    lacks = ((kind == "anchor") & (F.coalesce(label, F.lit("")) == "")) | ((kind == "slab") & ((F.coalesce(label, F.lit("")) == "") | (_plain("text") == "")))
    topic = F.when(F.size(F.coalesce("source_path", F.array().cast("array<string>"))) > 0, F.col("source_path")).otherwise(F.array(F.lit(source)))
    return candidates.where(~lacks).withColumns({"type": kind, "name": label, "source_topic": topic})


def compatible_edges(relations: DataFrame, named: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(type, from, to, confidence, justification) of ``relations(ord, type, from_ref, to_ref, …)`` with known types and ends, each once.

    Refs are temporary ids of ``named(temp_id, name)`` or ids of ``catalogue(id, label)``; the temporary ones win.
    """
    own = named.select(F.col("temp_id").alias("ref"), F.col("name").alias("label"))
    known = own.unionByName(catalogue.select(F.col("id").alias("ref"), "label").join(own.select("ref"), "ref", "left_anti")).dropDuplicates(["ref"])
    end = lambda key, name: known.select(F.col("ref").alias(key), F.col("label").alias(name))
    rows = relations.withColumn("type", F.upper("type")).where(F.col("type").isin(*EDGE_TYPES)).join(end("from_ref", "from"), "from_ref").join(end("to_ref", "to"), "to_ref")
    rows = rows.where("from <> '' AND to <> '' AND from <> to").withColumn("k", F.row_number().over(W.partitionBy("type", "from", "to").orderBy("ord"))).where("k = 1")
    return rows.select("type", "from", "to", F.coalesce("confidence", F.lit(0.5)).alias("confidence"), F.coalesce("justification", F.lit("")).alias("justification"))


def migrated_coherence(slabs: DataFrame, bundles: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Slabs, bundles and edges after each slab's own bundle has moved into it.

    ``slabs(id, intent, invariants)`` that have none take the intent and invariants of the first ``bundles(ord, id, intent, invariants, depends_on)``
    whose id ends in _coherence_v1 and whose first known dependency is the slab. Such bundles go, and their SUPPORTS edges with them.
    """
    own = bundles.where(F.col("id").endswith(COHERENCE))
    reach = own.select("ord", "id", "intent", "invariants", F.posexplode("depends_on").alias("n", "slab")).join(slabs.select(F.col("id").alias("slab")), "slab", "left_semi")
    parent = reach.groupBy("id").agg(F.min_by(F.struct("slab", "ord", "intent", "invariants"), "n").alias("p")).select("p.*")
    filled = lambda c: F.min_by(F.when(F.size(c) > 0, F.col(c)), F.when(F.size(c) > 0, F.col("ord")))
    moved = parent.groupBy(F.col("slab").alias("id")).agg(filled("intent").alias("i"), filled("invariants").alias("v"))
    keep = lambda c, new: F.when(F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))) > 0, F.col(c)).otherwise(F.coalesce(F.col(new), F.col(c))).alias(c)
    new_slabs = slabs.join(moved, "id", "left").select("id", keep("intent", "i"), keep("invariants", "v"))
    left = bundles.where(~F.col("id").endswith(COHERENCE))
    return new_slabs, left, edges.where(~((F.col("type") == "SUPPORTS") & F.col("src").endswith(COHERENCE)))


def described(nodes: DataFrame, cap: int = 24) -> DataFrame:
    """(place, line): ``id (text)`` of ``nodes(place, id, type, phrase, text, intent)``: phrase, first 80 characters or first two intents; the first ``cap`` places."""
    text = F.when(F.col("type") == "anchor", F.col("phrase")).when(F.col("type") == "slab", F.substring("text", 1, 80)).when(F.col("type") == "bundle", F.array_join(F.slice("intent", 1, 2), "; "))
    return nodes.orderBy("place").limit(cap).select("place", F.when(text.isNull(), F.col("id")).otherwise(F.concat("id", F.lit(" ("), text, F.lit(")"))).alias("line"))
