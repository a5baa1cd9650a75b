"""Projections, predicates and small joins on the rows of corpora, drafts, frames and sections."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions import text as T

# Patterns of questions for a value and of those that want an inference, and how many references each gets.
VALUE_NOUNS = r"(?i)\b(dimensions?|measurements?|configuration|config|spec|specification|volume|capacity|length|width|height|depth|temperature|setting|value)\b"
INFERENCE = r"(?i)\b(infer|inference|implications?|design|recommend|suggest|compare|why|how)\b"
FEW_REFERENCES, REFERENCES = 8, 25
# Kinds of sources that can be asked for, and the patterns of those that are found by their text, in this order.
SOURCE_KINDS = ("chat", "paper", "document", "narrative")
CHAT_LINE = r"(?im)^(user|human|assistant|claude|ai)\s*:"
PAPER_LINE = r"(?im)^\s*(abstract|methods?|methodology|results?|discussion|references)\s*$"
HEADING_LINE = r"(?m)^#{1,6}\s+|^\d+(?:\.\d+)*[.)]?\s+[A-Z]"
# Words without a capital in a title, path parts that say nothing, a version named in a text.
FUNCTION_WORDS = ("a", "an", "the", "of", "and", "or", "in", "for", "to", "with", "on", "at", "by", "from", "as")
MECHANICAL = r"^(?:(?:segment|section|part|chapter|page) +)?(?:[0-9]+(?:\.[0-9]+)*|[ivxlc]+)$"
VERSION = r"\bv(?:ersion)?[_\s]*(\d+)\b"
# Limits of the challenge trigger, of the runtime header, of a material change, of a bundle's lists, and of texts.
COOLDOWN, MISMATCH, AFFECT, VOLATILITY, RIGOR, PRESSURE = 5, 0.6, 0.5, 0.4, 0.3, 0.6
LOW, AMBIGUOUS, TENSE, SHOWN = 0.5, 0.7, 0.5, 24
CHANGED_SHARE, CHANGED_NODES = 0.10, 5
BUNDLE_LISTS = (("warnings", 8), ("non_assumptions", 6), ("rules", 8), ("heuristics", 8))
DIGEST_CHARS, TARGET_CHARS, INVARIANT_TEXT, INVARIANT_CHARS, INVARIANTS = 25_000, 600, 50, 15, 5
BASE_TYPES, REFERENCE_TYPE, STAGES = ("CONSTITUTIONAL", "CANONICAL"), "REFERENCE", ("FUNCTION", "EXPLICITNESS", "CONFIDENCE")
RENDERED = (("depends_on", "LINKS", 0.8), ("invokes", "INVOKES", 0.9))


def _plain(c: str | Column) -> Column:
    return F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))


# -- projections ----------------------------------------------------------------------------------
def listing(nodes: DataFrame, text: str = "text") -> DataFrame:
    """``nodes`` with the length of their text in its place."""
    return nodes.withColumn("text_length", F.length(text).cast("long")).drop(text)


def looked_up(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """(asked, found, …): the node of each asked id, found or not."""
    return ids.select(F.col("id").alias("asked")).join(nodes, F.col("asked") == F.col("id"), "left").withColumn("found", F.col("id").isNotNull()).drop("id")


def uniform_nodes(tables: dict[str, DataFrame]) -> DataFrame:
    """(id, type, collection, label) of the tables of each type, one below the other."""
    parts = [df.select("id", F.lit(kind).alias("type"), "collection", "label") for kind, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def reference_edges(rows: DataFrame, fields: dict[str, str]) -> DataFrame:
    """(type, src, dst): the references that ``rows(id, field…)`` list in arrays, by the type that each field stands for."""
    some = F.array(*[F.struct(F.lit(kind).alias("type"), F.col(f).alias("refs")) for f, kind in fields.items()])
    each = rows.select(F.col("id").alias("src"), F.explode(some).alias("f")).select("src", "f.type", F.explode("f.refs").alias("dst"))
    return each.select("type", "src", "dst")


def rendered_edges(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """Corpus edges ``(type, src, dst, weight)`` with those that references imply, at the weight of their field."""
    out = edges.select("type", "src", "dst", "weight")
    for field, kind, weight in RENDERED:
        if field in rows.columns:
            out = out.unionByName(reference_edges(rows, {field: kind}).withColumn("weight", F.lit(weight)))
    return out


def tiers(sections: DataFrame) -> DataFrame:
    """(doc, top_level, chapter_level): the two least levels of ``sections(doc, level)``, or the only one twice."""
    levels = sections.groupBy("doc").agg(F.array_sort(F.collect_set("level")).alias("l"))
    return levels.select("doc", F.col("l")[0].alias("top_level"), F.element_at("l", F.least(F.size("l"), F.lit(2))).alias("chapter_level"))


def chapters(sections: DataFrame) -> DataFrame:
    """(doc, start, label, path): chapter-level sections, and top-level ones without a chapter among their own, in order of start.

    ``sections(doc, idx, parent, level, label, start)``; a chapter belongs to the top section that begins last before it.
    """
    t = tiers(sections)
    own = sections.join(t, "doc")
    before = W.partitionBy("doc").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    top = F.struct("idx", "label")
    placed = own.withColumn("under", F.last(F.when(F.col("level") == F.col("top_level"), top), True).over(before))
    inner = placed.where("level = chapter_level AND level <> top_level")
    one = placed.where("level = top_level").join(inner.select("doc", F.col("under.idx").alias("idx")).distinct(), ["doc", "idx"], "left_anti")
    path = F.when(F.col("under").isNotNull(), F.concat("under.label", F.lit(" / "), "label")).otherwise(F.col("label"))
    return inner.select("doc", "start", "label", path.alias("path")).unionByName(one.select("doc", "start", "label", F.col("label").alias("path")))


def digest(text: Column, chars: int = DIGEST_CHARS) -> Column:
    """The text if it is short, else the first sentence of each paragraph."""
    ledes = F.transform(F.filter(F.split(text, r"\n+", -1), lambda p: F.trim(p) != ""), lambda p: F.split(p, r"\. ", -1)[0])
    return F.when(F.length(text) <= chars, text).otherwise(F.array_join(ledes, "\n"))


def sub_sections(marks: DataFrame) -> DataFrame:
    """(doc, n, label, start, end) of ``marks(doc, n, label, at, size)``: parts that tile their parent, the first from 0; a single mark gives none.

    Marks that were not found (null) go, and so do those that do not lie behind the one before.
    """
    part = W.partitionBy("doc").orderBy("n")
    found = marks.where("at is not null").withColumn("before", F.max("at").over(part.rowsBetween(W.unboundedPreceding, -1)))
    kept = found.where("before is null OR at > before").withColumn("k", F.row_number().over(part)).withColumn("many", F.count("*").over(W.partitionBy("doc"))).where("many >= 2")
    kept = kept.withColumn("start", F.when(F.col("k") == 1, F.lit(0).cast("long")).otherwise(F.col("at").cast("long")))
    return kept.select("doc", "n", "label", "start", F.coalesce(F.lead("start").over(part), F.col("size").cast("long")).alias("end"))


def prefix_tree(rows: DataFrame, depth: int) -> DataFrame:
    """(prefix, depth, ord, members) of ``rows(ord, path)``, paths being arrays: every prefix up to a depth with its least order."""
    levels = F.transform(F.sequence(F.lit(1), F.least(F.size("path"), F.lit(depth))), lambda d: F.struct(F.array_join(F.slice("path", F.lit(1), d), " / ").alias("prefix"), d.alias("depth")))
    return rows.where(F.size("path") > 0).select("ord", F.explode(levels).alias("l")).groupBy("l.prefix", "l.depth").agg(F.min("ord").alias("ord"), F.count("*").alias("members"))


def semantic_path(parts: Column, fallback: Column, source: Column) -> Column:
    """Path parts without blanks, the source's own name and mechanical locators; the fallback's words if none is left."""
    clean = F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: (p != "") & (F.lower(p) != F.lower(_plain(source))) & ~F.lower(p).rlike(MECHANICAL))
    words = F.trim(F.regexp_replace(F.coalesce(F.nullif(fallback, F.lit("")), F.lit("Extracted concept")), r"\s+", " "))
    return F.when(F.size(clean) > 0, clean).otherwise(F.array(words))


def topic(value: Column, parts: Column) -> Column:
    """A topic of a sidecar: the string, trimmed, or the list's atoms joined, a separator inside an atom as `` + ``."""
    atoms = F.filter(F.transform(F.filter(parts, lambda p: p.isNotNull()), lambda p: F.replace(F.trim(p), F.lit(" / "), F.lit(" + "))), lambda p: p != "")
    return F.when(value.isNotNull(), F.trim(value)).otherwise(F.coalesce(F.array_join(atoms, " / "), F.lit("")))


def first_field(*sources: Column) -> Column:
    """The first of the inline, packet and raw values that is neither null nor empty."""
    return F.coalesce(*[F.nullif(s, F.lit("")) for s in sources], F.lit(""))


def slab_metadata(text: Column, justification: Column) -> Column:
    """struct(intent, invariants) of a slab of fifty characters or more: its reason, and its first five sentences of more than fifteen."""
    none = F.array().cast("array<string>")
    parts = F.slice(F.filter(F.transform(F.split(text, r"\.", -1), lambda s: F.trim(s)), lambda s: F.length(s) > INVARIANT_CHARS), 1, INVARIANTS)
    long_ = F.length(text) >= INVARIANT_TEXT
    return F.struct(F.when(long_ & (_plain(justification) != ""), F.array(justification)).otherwise(none).alias("intent"), F.when(long_, parts).otherwise(none).alias("invariants"))


def packets(proposals: DataFrame) -> DataFrame:
    """(ord, id, type, payload) of ``proposals(ord, type, phrase, title, text, label)``: the draft packets, with what their type needs inline."""
    kind = F.col("type")
    payload = F.when(kind == "anchor", F.to_json(F.struct(F.col("phrase").alias("canonical_phrase")))).when(kind == "slab", F.to_json(F.struct("title", F.col("text").alias("canonical_text")))).when(kind == "bundle", F.to_json(F.struct("label")))
    return proposals.select("ord", T.stable_id("draft_", kind, F.col("ord").cast("string")).alias("id"), "type", payload.alias("payload")).where("payload is not null")


def edge_rows(raw: DataFrame) -> DataFrame:
    """(ord, type, src, dst) of ``raw(ord, type, edge_type, from, from_label, to, to_label)``, whose keys have two spellings each; rows without an end go."""
    pick = lambda a, b: F.coalesce(F.nullif(_plain(a), F.lit("")), F.nullif(_plain(b), F.lit("")))
    return raw.select("ord", F.upper(F.coalesce(pick("type", "edge_type"), F.lit("LINKS"))).alias("type"), pick("from", "from_label").alias("src"), pick("to", "to_label").alias("dst")).where("src is not null AND dst is not null")


def joined_labels(rows: DataFrame, group: str, order: str, label: str, most: int | None = None, between: str = "; ") -> DataFrame:
    """(group, text): the labels of each group in order, the first ``most`` of them."""
    own = rows if most is None else rows.withColumn("__k", F.row_number().over(W.partitionBy(group).orderBy(order))).where(F.col("__k") <= most)
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(label).alias("l"))))
    return own.groupBy(group).agg(F.array_join(F.transform(listed, lambda x: x["l"]), between).alias("text"))


def frame_rows(frame: DataFrame) -> DataFrame:
    """(session, saliences, nodes) of ``frame(session, id, salience)``: a map of rounded saliences, and how many nodes."""
    entry = F.struct("id", F.round("salience", 4).alias("salience"))
    return frame.groupBy("session").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("saliences"), F.count("*").alias("nodes"))


def hits_with_attributes(auto: DataFrame, candidates: DataFrame, anchors: DataFrame) -> DataFrame:
    """(id, tier, …): automatic hits before candidates, each id once, with what ``anchors(id, …)`` know of it."""
    both = auto.select("id", F.lit(0).alias("tier")).unionByName(candidates.select("id", F.lit(1).alias("tier")))
    return both.groupBy("id").agg(F.min("tier").alias("tier")).join(anchors, "id")


def search_targets(phrases: DataFrame, slabs: DataFrame) -> DataFrame:
    """(target, text): phrases by their anchor, slabs by their first 600 characters, and inline phrases by the slab that holds them.

    ``phrases(id, phrase)``, ``slabs(id, text, inline)``.
    """
    a = phrases.select(F.col("id").alias("target"), F.col("phrase").alias("text"))
    s = slabs.select(F.col("id").alias("target"), F.substring("text", 1, TARGET_CHARS).alias("text"))
    return a.unionByName(s).unionByName(slabs.select(F.col("id").alias("target"), F.explode("inline").alias("text"))).where("text <> ''")


def drilled(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Slabs (leaf, n, title, position), and LINKS edges (src, dst, weight) to the anchors that they reference.

    ``rows(leaf, base, slabs array<struct<title, references>>)``; a slab's position is its leaf's base plus its number.
    """
    each = rows.select("leaf", "base", F.posexplode("slabs").alias("n", "s"))
    slabs = each.select("leaf", "n", F.col("s.title").alias("title"), (F.col("base") + F.col("n")).alias("position"))
    return slabs, each.select(F.col("s.title").alias("src"), F.explode("s.references").alias("dst")).withColumn("weight", F.lit(0.8)).distinct()


# -- predicates -----------------------------------------------------------------------------------
def base_set(slabs: DataFrame, mode: str, reference: bool = False) -> DataFrame:
    """Active slabs ``(id, type, status, requires_mode, …)`` of the basic types, and reference ones if asked, that need this mode or none."""
    kinds = [*BASE_TYPES, *([REFERENCE_TYPE] if reference else [])]
    return slabs.where((F.col("status") == "ACTIVE") & F.col("type").isin(kinds) & (F.col("requires_mode").isNull() | (F.col("requires_mode") == mode)))


def invariant_slabs(slabs: DataFrame) -> DataFrame:
    return slabs.where("status = 'ACTIVE' AND type = 'INVARIANT'")


def keyword(column: Column, word: str) -> Column:
    return F.contains(F.lower(column), F.lit(word.lower()))


def stage_order(stage: Column) -> Column:
    """Place of a gate's stage: function, explicitness, confidence, then all others."""
    out = F.lit(len(STAGES))
    for n, name in reversed(list(enumerate(STAGES))):
        out = F.when(stage == name, n).otherwise(out)
    return out


def effective_gate(imperative: Column, declarative: Column, declared: bool = False) -> Column:
    """struct(open, differs): the imperative outcome, or the declared one if that is in force, and whether they differ."""
    return F.struct((declarative if declared else imperative).alias("open"), (imperative != declarative).alias("differs"))


def reference_limit(text: Column) -> Column:
    """Eight references for a question about a value, twenty-five for others."""
    return F.when(text.rlike(VALUE_NOUNS) & ~text.rlike(INFERENCE), FEW_REFERENCES).otherwise(REFERENCES)


def mentioned(texts: DataFrame, collections: DataFrame) -> DataFrame:
    """(text_id, id): collections, few of them, that a text names by an id of three characters or more, or by the number of a version."""
    few = F.broadcast(collections.select("id", F.lower("id").alias("low"), F.regexp_extract("id", r"(\d+)$", 1).alias("tail")))  # a handful
    t = texts.select("text_id", F.lower("text").alias("t")).withColumn("versions", F.regexp_extract_all("t", F.lit(VERSION), F.lit(1)))
    hit = ((F.length("low") >= 3) & F.contains("t", F.col("low"))) | ((F.col("tail") != "") & F.array_contains("versions", F.col("tail")))
    return t.join(few, hit).select("text_id", "id").distinct()


def source_kind(text: Column, requested: Column | None = None, chat: Column | None = None) -> Column:
    """The kind that was asked for, else chat (also where ``chat`` holds: an export format), paper, document of two headings, or narrative."""
    asked = F.lower(requested) if requested is not None else F.lit(None).cast("string")
    talk = text.rlike(CHAT_LINE) | (chat if chat is not None else F.lit(False))
    found = F.when(talk, "chat").when(text.rlike(PAPER_LINE), "paper").when(F.regexp_count(text, F.lit(HEADING_LINE)) >= 2, "document").otherwise("narrative")
    return F.when(asked.isin(*SOURCE_KINDS), asked).otherwise(found)


def is_heading(phrase: Column) -> Column:
    """Whether a phrase looks like a heading and not like a named concept; blank ones do."""
    p = _plain(phrase)
    words = F.filter(F.split(p, r"\s+", -1), lambda w: w != "")
    n = F.size(words)
    conjunction = p.rlike(r"(?i)\b(and|or)\b")
    upper = lambda w: w.rlike(r"^\p{Lu}")
    titled = lambda w: ~w.rlike(r"^\p{L}") | upper(w)
    commas = F.length(p) - F.length(F.replace(p, F.lit(","), F.lit("")))
    small = F.exists(words, lambda w: F.lower(w).isin(*FUNCTION_WORDS))
    joiner = lambda w: F.lower(w).isin("and", "or")
    rest = F.filter(words, lambda w: ~joiner(w))
    return (
        (p == "") | ((commas >= 2) & conjunction) | ((n > 8) & (F.size(F.filter(words, upper)) / n >= 0.6)) | ((n > 3) & F.forall(words, titled) & ~small)
        | (n.between(2, 4) & F.exists(words, joiner) & (F.size(rest) > 0) & F.forall(rest, titled))
    )


def challenge(turn: Column, last: Column, mismatch: Column, affect: Column, volatility: Column, rigor: Column, pressure: Column, pushback: Column) -> Column:
    """Why a challenge fires on a turn, by the first reason that holds, or why it does not."""
    return (
        F.when(last.isNotNull() & (turn - last < COOLDOWN), "cooldown").when(mismatch > MISMATCH, "mismatch").when((affect > AFFECT) & (volatility > VOLATILITY) & (rigor > RIGOR), "signals")
        .when(pressure > PRESSURE, "pressure").when(pushback, "pushback").otherwise("quiet")
    )


def ambiguity(ident: Column, kind: Column, label: Column, anchor: Column, slab_text: Column, bundle: Column) -> Column:
    """What is odd about the type of a draft, by the first rule that holds: its id, its payload, or its length; empty if nothing is."""
    named = reduce(or_, [F.contains(ident, F.lit(f"tentative_{t}_")) & (kind != t) for t in ("anchor", "slab", "bundle")])
    has_a, has_s = _plain(anchor) != "", slab_text.isNotNull()
    none = ((kind == "anchor") & ~has_a) | ((kind == "slab") & ~has_s) | ((kind == "bundle") & (_plain(bundle) == ""))
    short = F.length(slab_text).between(1, 59) & ~F.contains(slab_text, F.lit("\n"))
    return (
        F.when(named, "id").when((kind == "anchor") & has_s & ~has_a, "inline slab").when((kind == "slab") & has_a & ~has_s, "inline anchor").when(none, "no payload")
        .when((kind == "anchor") & (F.length(label) > 60), "long phrase").when((kind == "slab") & short, "short slab").otherwise("")
    )


def starts_with_any(ident: Column, prefixes: tuple[str, ...]) -> Column:
    return reduce(or_, [F.startswith(ident, F.lit(p)) for p in prefixes])


def visible(nodes: DataFrame) -> DataFrame:
    """Active ``nodes(id, sources, hits, pressure)`` that a graph shows: all but those of the base set alone that nothing has hit or pressed."""
    base = (F.size("sources") > 0) & F.forall("sources", lambda s: s == "base_set")
    return nodes.where(~base | (F.coalesce("hits", F.lit(0)) > 0) | (F.coalesce("pressure", F.lit(0.0)) > 0))


def has_evidence(confidence: Column, refs: Column, least: float, weak: str = "assistant_unadopted") -> Column:
    """Confidence at the minimum, and references of which one at least is of another authority than the weakest."""
    return (F.coalesce(confidence, F.lit(0.0)) >= least) & (F.coalesce(F.size(refs), F.lit(0)) > 0) & ~F.forall(refs, lambda r: r == weak)


def title_now(title: Column, messages: Column) -> Column:
    """Whether a chat of a default title has the messages for a better one; a chat without a title always has."""
    return (_plain(title) == "") | (((title == "New Chat") | F.startswith(title, F.lit("Chat "))) & messages.between(3, 16))


def materially_changed(old_hash: Column, new_hash: Column, old_n: Column, new_n: Column) -> Column:
    """Other nodes than before, and a tenth of their number or five more or less; always without a state before."""
    gap = F.abs(new_n - old_n)
    return old_hash.isNull() | ((old_hash != new_hash) & ((gap / F.greatest(old_n, F.lit(1)) >= CHANGED_SHARE) | (gap >= CHANGED_NODES)))


def runtime_header(confidence: Column, active: Column, conflicts: Column) -> Column:
    """struct(flag, active, tense): low, ambiguous or normal confidence, the first 24 nodes, and the pairs of more than half tension."""
    flag = F.when(confidence < LOW, "low").when(confidence < AMBIGUOUS, "ambiguous").otherwise("normal")
    return F.struct(flag.alias("flag"), F.slice(active, 1, SHOWN).alias("active"), F.filter(conflicts, lambda c: c["tension"] > TENSE).alias("tense"))


def gated_bundles(bundles: DataFrame, slabs: DataFrame) -> DataFrame:
    """Bundles that have a label, an intent, two known slabs at least and one list that is not empty; lists are cut to their limits, the intent to five.

    ``bundles(id, label, intent, depends_on, warnings, non_assumptions, rules, heuristics)``.
    """
    known = bundles.select("id", F.explode(F.array_distinct("depends_on")).alias("slab")).join(slabs.select(F.col("id").alias("slab")), "slab", "left_semi").groupBy("id").agg(F.sort_array(F.collect_list("slab")).alias("known"))
    some = reduce(or_, [F.coalesce(F.size(n), F.lit(0)) > 0 for n, _ in BUNDLE_LISTS])
    ok = bundles.join(known, "id").where((_plain("label") != "") & (F.size("intent") > 0) & (F.size("known") >= 2) & some)
    return ok.select("id", "label", F.slice("intent", 1, 5).alias("intent"), F.col("known").alias("depends_on"), *[F.slice(n, 1, k).alias(n) for n, k in BUNDLE_LISTS])


# -- joins ----------------------------------------------------------------------------------------
def tiered_index(tiers_: list[DataFrame]) -> DataFrame:
    """(key, id, tier): labels ``(label, id, n)`` of several tables by their key, the first table and in it the first row winning."""
    keyed = [df.select(T.label_key(F.col("label")).alias("key"), F.struct(F.lit(k).alias("tier"), "n", "id").alias("m")) for k, df in enumerate(tiers_)]
    return reduce(DataFrame.unionByName, keyed).where("key <> ''").groupBy("key").agg(F.min("m").alias("m")).select("key", "m.id", "m.tier")


def references(drafts: DataFrame, turns: DataFrame) -> DataFrame:
    """(chat, id, refs, first_ref) of ``drafts(chat, id, raised, phrase)``: later turns ``(chat, turn, text)`` that hold the phrase, in any case."""
    low = turns.select("chat", "turn", F.lower("text").alias("t"))
    hit = drafts.where("phrase <> ''").join(low, "chat").where((F.col("turn") > F.col("raised")) & F.contains("t", F.lower("phrase")))
    return hit.groupBy("chat", "id").agg(F.count("*").alias("refs"), F.min("turn").alias("first_ref"))


def owners(nodes: DataFrame) -> DataFrame:
    """(id, owner): the first collection, by name, that holds a node."""
    return nodes.groupBy("id").agg(F.min("collection").alias("owner"))


def edge_collections(edges: DataFrame, nodes: DataFrame, default: str = "default") -> DataFrame:
    """``edges(src, dst, …)`` with target: the collection of both ends, the specific one if the other is the default, else the default."""
    side = lambda key, name: owners(nodes).select(F.col("id").alias(key), F.col("owner").alias(name))
    out = edges.join(side("src", "a"), "src").join(side("dst", "b"), "dst")
    target = F.when(F.col("a") == F.col("b"), F.col("a")).when(F.col("a") == default, F.col("b")).when(F.col("b") == default, F.col("a")).otherwise(default)
    return out.withColumn("target", target).drop("a", "b")


def marker_place(text: Column, marker: Column, cursor: Column) -> Column:
    """Where a marker stands at or after a place, from 0: exactly, else the paragraph behind it that shares most words; -1 if none shares six tenths.

    Only markers of three words or more are sought by words, among the 160 characters from a paragraph's start, or forty more than the marker has.
    """
    exact = F.instr(F.substring(text, cursor.cast("int") + 1, F.length(text)), marker)
    words = lambda t: F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit(r"\w+"), F.lit(0)))
    wanted = words(marker)
    paragraphs = F.regexp_extract_all(text, F.lit(r"(?s).+?(?:\n\s*\n|\z)"), F.lit(0))
    lengths = F.transform(paragraphs, lambda p: F.length(p))
    starts = F.transform(paragraphs, lambda p, i: F.aggregate(F.slice(lengths, F.lit(1), i), F.lit(0), lambda a, x: a + x))
    span = F.greatest(F.length(marker) + 40, F.lit(160))
    near = F.transform(starts, lambda s: F.struct((F.size(F.array_intersect(wanted, words(F.substring(text, s + 1, span)))) / F.size(wanted)).alias("share"), (-s).alias("s")))
    best = F.array_max(F.filter(near, lambda x: (-x["s"] >= cursor) & (x["s"] < 0)))
    fuzzy = F.when((F.size(wanted) >= 3) & (best["share"] >= 0.6), -best["s"]).otherwise(-1)
    return F.when(_plain(marker) == "", -1).when(exact > 0, cursor + exact - 1).otherwise(fuzzy)


def resolved_pushes(pushes: DataFrame, resolutions: DataFrame) -> DataFrame:
    """``pushes(id, …)`` with the first resolution ``(push_id, at, resolution)`` of each, null while there is none."""
    first = resolutions.groupBy(F.col("push_id").alias("id")).agg(F.min(F.struct("at", "resolution")).alias("m"))
    return pushes.join(first.select("id", "m.resolution"), "id", "left")


def short_label(kind: Column, phrase: Column, title: Column, intent: Column) -> Column:
    """A node's short name: its phrase, the first thirty characters of its title, or its first intent."""
    return F.when(kind == "anchor", phrase).when(kind == "slab", F.substring(title, 1, 30)).otherwise(F.get(intent, F.lit(0)))


def draft_targets(drafts: DataFrame, sidecars: DataFrame, default: str = "default") -> DataFrame:
    """(id, target): the collection that a draft's sidecar ``(id, target)`` names, or the default."""
    return drafts.select("id").join(sidecars.groupBy("id").agg(F.max("target").alias("target")), "id", "left").select("id", F.coalesce("target", F.lit(default)).alias("target"))


def matching_text(kind: Column, phrase: Column, aliases: Column, title: Column, text: Column, intent: Column) -> Column:
    """What a draft is compared by: phrase and aliases, title and the first 200 characters, or the intents."""
    some = lambda *parts: F.array_join(F.filter(F.array(*parts), lambda p: F.coalesce(p, F.lit("")) != ""), " ")
    return F.when(kind == "anchor", some(phrase, F.array_join(aliases, " "))).when(kind == "slab", some(title, F.substring(text, 1, 200))).otherwise(F.array_join(intent, "; "))


def partner_texts(conflicts: DataFrame, nodes: DataFrame, chars: int = 180) -> DataFrame:
    """``conflicts(src, dst)`` with the first characters of the partner's text, or its id."""
    n = nodes.select(F.col("id").alias("dst"), "text")
    return conflicts.join(n, "dst", "left").select("src", "dst", F.coalesce(F.nullif(F.substring("text", 1, chars), F.lit("")), F.col("dst")).alias("partner"))


def identity_locked(originals: DataFrame, rewrites: DataFrame, identity: list[str], free: list[str]) -> DataFrame:
    """``originals(id, …)`` with the rewritten values of the free fields; identity fields stay, whatever the rewrite says."""
    new = rewrites.select("id", *[F.col(f).alias(f"__{f}") for f in free])
    return originals.join(new, "id", "left").select("id", *identity, *[F.coalesce(f"__{f}", f).alias(f) for f in free])


def adjusted_salience(salience: DataFrame, steps: DataFrame) -> DataFrame:
    """``salience(id, value)`` after the user's heating and cooling ``steps(id, delta)``, between 0 and 1."""
    moved = steps.groupBy("id").agg(F.sum("delta").alias("d"))
    return salience.join(moved, "id", "left").select("id", T.clamp01(F.col("value") + F.coalesce("d", F.lit(0.0))).alias("value"))


def edited(rows: DataFrame, edits: DataFrame, fields: list[str]) -> DataFrame:
    """``rows(id, field…)`` with the values that ``edits(id, field…)`` give; null leaves a field as it is."""
    new = edits.select("id", *[F.col(f).alias(f"__{f}") for f in fields])
    return rows.join(new, "id", "left").select("id", *[F.coalesce(f"__{f}", f).alias(f) for f in fields])


def seeded(base: DataFrame, edges: DataFrame, default: float = 0.5) -> DataFrame:
    """(id, weight): base slabs at 1 and what they link to at the strength of the edge, the greatest of each."""
    own = base.select("id", F.lit(1.0).alias("weight"))
    linked = edges.where("type = 'LINKS'").join(base.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"), F.coalesce("weight", F.lit(default)).alias("weight"))
    return own.unionByName(linked).groupBy("id").agg(F.max("weight").alias("weight"))


def retrieval_policy(ranked: Column, seeds: Column) -> Column:
    """struct(mode, threshold): flat at .55 without seeds, flat at .70 with fewer than three ranked rows, else ranked."""
    mode = F.when(seeds == 0, "flat").when(ranked < 3, "flat").otherwise("ranked")
    return F.struct(mode.alias("mode"), F.when(seeds == 0, 0.55).when(ranked < 3, 0.70).alias("threshold"))


def kept_share(verdicts: DataFrame, group: str) -> DataFrame:
    """(group, n, kept_pct) of ``verdicts(group, verdict)``, to one place."""
    return verdicts.groupBy(group).agg(F.count("*").alias("n"), F.round(100 * F.count_if(F.col("verdict") == "KEEP") / F.count("*"), 1).alias("kept_pct"))


def common_lead(titles: Column, words: int = 3, most: int = 5) -> Column:
    """The leading words that the first titles share, three at most; the first title if they share none."""
    split = F.transform(F.slice(titles, 1, most), lambda t: F.slice(F.split(t, r"\s+"), 1, words))
    first = F.get(titles, F.lit(0))
    out = first
    for k in range(1, words + 1):
        same = F.size(F.array_distinct(F.transform(split, _leading(k)))) == 1
        out = F.when(same, F.array_join(F.slice(F.split(first, r"\s+"), 1, k), " ")).otherwise(out)
    return out


def _leading(k: int):
    return lambda w: F.array_join(F.slice(w, 1, k), " ")
