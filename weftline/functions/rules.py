"""Predicates and classifiers on text columns, and gate rules compiled to SQL."""

from __future__ import annotations

import ast

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns of review requests, of synthesis requests, and of answers to a challenge.
REVIEW_VERBS = (
    r"\b(compare|contrast|review|assess|evaluate|critique|curate|prune|deduplicate|dedupe|merge|consolidate|redundant|duplicates?|which\s+(?:should|would|do)\s+i\s+keep|"
    r"which\s+(?:is|are)\s+(?:better|more\s+useful)|worth\s+(?:keeping|deleting|promoting|discarding)|should\s+i\s+(?:keep|delete|merge|promote|discard|commit|purge)|clean\s+up|tidy\s+up)\b"
)
CORPUS_NOUNS = (
    r"\b(anchors?|slabs?|bundles?|edges?|collections?|corpus|corpora|drafts?|tentatives?|proposals?|mined|mining\s+(?:output|result|results|pass|passes)|(?:graph\s+)?nodes?|entries|entry)\b"
)
SYNTHESIS = (
    r"\btell me (?:about|more about)\b",
    r"\bsynthe[sz]i[sz]e\b",
    r"\bgive me (?:an? )?overview\b",
    r"\bwalk me through\b",
    r"\bexplain (?:the |my |your |this )?(?:concept|idea|thinking|view|stance|position|reasoning|framework|model)\b",
    r"\bwhat (?:is|are) (?:my |the |your )?(?:view|stance|position|take|thinking|reasoning|framework)\b",
    r"\bhow (?:do|does|did) .{2,40}\b(?:work|relate|connect|differ|compare)\b",
    r"\bcompare\b.{2,60}\b(?:and|with|to|against|vs)\b",
    r"\bcontrast\b",
    r"\bwhat do (?:I|you|we) think about\b",
    r"\bsummari[sz]e\b",
    r"\bbreak (?:this|that|it) down\b",
    r"\bwhat'?s (?:the |my )?(?:case|argument|reasoning|point) (?:for|against|behind)\b",
    r"\bdialectic\b",
    r"\btrade[- ]?offs?\b",
)
REJECT = r"^(no\b|actually\b|but\s|wrong\b|incorrect\b|disagree|that'?s\s+not|not\s+quite|hmm|hold\s+on|wait\b)"
ACCEPT = r"^(good\b|great\b|yes\b|yeah\b|yep\b|right\b|correct\b|exactly\b|agreed\b|perfect\b|makes\s+sense|got\s+it|understood)"
# Phrases of the output checks, hard ones and soft ones by layer, and directives.
HARD_PHRASES = {
    "floor": ("it is known that", "it is clear that", "without a doubt", "studies show", "research confirms", "science has proven", "experts agree that", "it has been established that"),
    "filling": (
        "it stands to reason that", "one could reasonably assume", "it makes sense that", "logically, this means", "this suggests that, in all likelihood", "we can safely assume", "the most likely explanation is",
    ),
}
SOFT_PHRASES = {
    "domain": (
        "you seem to feel", "you're feeling", "i can sense that you", "you seem upset", "you appear frustrated", "my training", "my architecture", "my system prompt", "i was trained to", "my neural network", "my weights",
    ),
    "style": (
        "it's important to remember that", "we should be careful to", "it's worth noting that", "let me be clear", "i want to emphasize", "on the other hand, one could argue", "before we proceed, i should mention",
        "i think it's crucial that", "this is a really important point", "let me take a step back",
    ),
    "memory": ("as we discussed previously", "as you mentioned before", "continuing from our last", "in our previous conversation", "you told me earlier", "going back to what you said"),
}
# Openings of sentences that claim nothing, the tag of claims, limits, and directives.
STARTERS = ("hi", "hello", "sure", "okay", "ok", "yes", "no", "thanks", "thank you", "you're welcome", "i see", "got it", "understood", "let me", "here's", "here is")
CLAIM_TAG = r"(?i)\[(FACT|INFERENCE|HYPOTHESIS|UNKNOWN)\]"
SCANNED, LONG, UNTAGGED_LIMIT = 15, 50, 3
DIRECTIVES = (
    r"(?i)\byou must\b|\byou should\b|\byou have to\b|\bdon['’]t forget to\b|\bmake sure you\b|\bI urge you to\b|\bit is essential that you\b|\bhere['’]s what you should do\b|\bI recommend that you\b|"
    r"\byour next step should be\b|\bthe best course of action\b|\byou need to\b|\blet me outline a plan for you\b|\bhere['’]s a step[- ]by[- ]step\b|\bI suggest you start by\b|\bfirst,? do\b.*\bthen\b.*\bfinally\b|\bstep\s*1[:.]\s"
)


def is_review(text: Column) -> Column:
    """A review verb and a corpus noun in a text of at least ten characters."""
    return (F.length(F.trim(text)) >= 10) & text.rlike("(?i)" + REVIEW_VERBS) & text.rlike("(?i)" + CORPUS_NOUNS)


def is_synthesis(text: Column, anchors: Column) -> Column:
    """A synthesis pattern in the first 2000 characters, or two anchors."""
    return F.substring(text, 1, 2000).rlike("(?i)" + "|".join(SYNTHESIS)) | (anchors >= 2)


def resolution(answer: Column, similarity: Column) -> Column:
    """How a turn answers a challenged claim: by its first words, by similarity, by length without one."""
    t = F.trim(answer)
    short = F.length(t) < 80
    return (
        F.when(t == "", "ambiguous").when(t.rlike("(?i)" + REJECT), "explicit_reject").when(t.rlike("(?i)" + ACCEPT), "explicit_accept")
        .when(similarity.isNotNull() & (similarity < 0.3) & short, "implicit_accept").when(similarity > 0.5, "unresolved").when(similarity.isNotNull(), "ambiguous")
        .when(short, "implicit_accept").otherwise("unresolved")
    )


def untagged_claims(text: Column) -> Column:
    """Of the first 15 sentences, those of 50 characters or more that are no question, opener or tagged claim."""
    sentences = F.transform(F.slice(F.split(text, r"[.!]\s+|\n", -1), 1, SCANNED), lambda s: F.trim(s))

    def counts(s: Column) -> Column:
        low = F.lower(s)
        opener = F.lit(False)
        for start in STARTERS:
            opener = opener | low.startswith(start)
        return (F.length(s) >= LONG) & ~low.endswith("?") & ~opener & ~s.rlike(CLAIM_TAG)

    return F.size(F.filter(sentences, counts))


def _any_phrase(low: Column, phrases: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(low, F.lit(p))
    return out


def validated(text: Column, retry: Column, streak: Column, on: Column | None = None, overrides: Column | None = None) -> Column:
    """struct(hard, soft, step, status) of an output: PASS, FLAGGED, REGENERATE, or BLOCK for a retry.

    ``on`` switches all checks; where it is false the output passes. ``overrides`` is an array of the soft
    layers, and "slope", that the user has lifted; hard layers can't be lifted.
    """
    low = F.lower(text)
    held = lambda name: F.lit(True) if overrides is None else ~F.coalesce(F.array_contains(overrides, name), F.lit(False))
    live = F.lit(True) if on is None else F.coalesce(on, F.lit(False))
    slope = live & held("slope") & (F.regexp_count(text, F.lit(DIRECTIVES)) >= 2)
    step = F.when(slope, F.least(streak + 1, F.lit(3))).otherwise(0)
    hits = lambda layers, keep: sum(((keep(name) & live & _any_phrase(low, p)).cast("int") for name, p in layers.items()), F.lit(0))
    hard = hits(HARD_PHRASES, lambda _: F.lit(True)) + (live & (untagged_claims(text) > UNTAGGED_LIMIT)).cast("int") + (step >= 3).cast("int")
    soft = hits(SOFT_PHRASES, held) + step.between(1, 2).cast("int")
    status = F.when((hard == 0) & (soft == 0), "PASS").when(hard == 0, "FLAGGED").when(retry, "BLOCK").otherwise("REGENERATE")
    return F.struct(hard.alias("hard"), soft.alias("soft"), step.alias("step"), status.alias("status"))


class RuleError(ValueError):
    """A rule outside the language, or one that names a field that is not there."""


def rule_sql(rule: str, schema: T.StructType) -> str:
    """A gate rule (==, !=, <, in, and, or, not, dotted names, literals) as a SQL condition."""

    def kind(node: ast.expr) -> T.DataType | None:
        names = []
        while isinstance(node, ast.Attribute):
            names.append(node.attr)
            node = node.value
        if not isinstance(node, ast.Name):
            return None
        at: T.DataType = schema
        for name in [node.id, *reversed(names)]:
            if not isinstance(at, T.StructType) or name not in at.names:
                raise RuleError(f"no field {name}")
            at = at[name].dataType
        return at

    def sql(node: ast.expr) -> str:
        if isinstance(node, ast.BoolOp):
            return "(" + (" AND " if isinstance(node.op, ast.And) else " OR ").join(map(sql, node.values)) + ")"
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
            return f"(NOT {sql(node.operand)})"
        if isinstance(node, ast.Constant):
            v = node.value
            if v is None or isinstance(v, bool):
                return str(v).upper().replace("NONE", "NULL")
            if isinstance(v, (int, float)):
                return repr(v)
            if isinstance(v, str):
                return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
        if isinstance(node, (ast.Name, ast.Attribute)):
            kind(node)
            return f"{sql_name(node)}"
        if isinstance(node, ast.List | ast.Tuple):
            return "array(" + ", ".join(map(sql, node.elts)) + ")"
        if isinstance(node, ast.Compare) and len(node.ops) == 1:
            left, right, op = node.left, node.comparators[0], node.ops[0]
            if isinstance(op, (ast.In, ast.NotIn)):
                held = f"array_contains({sql(right)}, {sql(left)})" if not isinstance(kind(right), T.StringType) else f"contains({sql(right)}, {sql(left)})"
                return held if isinstance(op, ast.In) else f"(NOT {held})"
            signs = {ast.Eq: "<=>", ast.NotEq: "<>", ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">="}
            if type(op) in signs:
                return f"({sql(left)} {signs[type(op)]} {sql(right)})"
        raise RuleError(f"not in the language: {ast.dump(node)}")

    def sql_name(node: ast.expr) -> str:
        return f"{sql_name(node.value)}.`{node.attr}`" if isinstance(node, ast.Attribute) else f"`{node.id}`"

    try:
        return sql(ast.parse(rule, mode="eval").body)
    except SyntaxError as e:
        raise RuleError(str(e)) from e


def gate(rules: list[dict], default: str, schema: T.StructType) -> Column:
    """Outcome of the first rule that holds, by priority; rules that can't be compiled are skipped."""
    out = None
    for r in sorted(rules, key=lambda r: r["priority"]):
        try:
            held = F.coalesce(F.expr(rule_sql(r["condition"], schema)).cast("boolean"), F.lit(False))
        except RuleError:
            continue
        out = F.when(held, r["outcome"]) if out is None else out.when(held, r["outcome"])
    return F.lit(default) if out is None else out.otherwise(default)


def gate_pipeline(outcomes: list[Column]) -> Column:
    """The first DENY or ESCALATE of gates in stage order, else ALLOW."""
    stop = F.filter(F.array(*outcomes), lambda o: o.isin("DENY", "ESCALATE"))
    return F.when(F.size(stop) > 0, stop[0]).otherwise("ALLOW")


def imperative_gate(required: Column, explicit: Column, function: Column, allowed: Column) -> Column:
    """Open without a requirement, for explicit mentions, and for allowed or safe functions."""
    safe = ("object_of_work", "rigor_work", "corpus_review", "meta_discussion")
    return ~required | explicit | F.array_contains(allowed, function) | function.isin(*safe)
