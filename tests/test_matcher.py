"""The matcher of handles, span features, proposals and session files against plain loops and worked examples."""

import difflib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import features as X
from weftline.functions import models
from weftline.operators import lifecycle, matcher, proposals
from weftline.operators.match import label_index, resolve_labels
from weftline.operators.segment import wraps
from weftline.session import ship
from weftline.sources import conversations, sessions


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a *b* c", (["b"], "a   c", None)),
        ("**bold** and *x **y** z*", (["x **y** z"], "**bold** and", None)),
        ("* * then *open end", ([], "* * then  open end", "open end")),
        ("*a**b*", (["a**b"], "", None)),
        (None, ([], "", None)),
    ],
)
def test_wraps(text, want):
    assert wraps(text) == want


@pytest.mark.parametrize(
    ("text", "hits", "reading"),
    [
        ("urgh why are u the way u are", 0, "model_directed_exasperation"),
        ("you are useless", 0, "model_directed_complaint"),
        ("fml im so dumb", 0, "self_directed_frustration"),
        ("oh my god english is stupid", 0, "world_directed_frustration"),
        ("scratch that", 0, "self_correction"),
        ("oh no GAAAHHHD", 0, "performed_imitation"),
        ("sighs", 0, "stage_direction"),
        ("hmph", 0, "ambient_sigh"),
        ("really?!", 0, "strong_affect"),
        ("plain words alone stand here", 0, "semantic_depth"),
        ("plain", 1, "explicit_invocation"),
        ("plain", 2, "ambiguous_invocation"),
        ("", 0, "semantic_depth"),
    ],
)
def test_readings(spark, text, hits, reading):
    df = spark.createDataFrame([(text, hits)], "t string, h int").select(X.features(F.col("t"), F.col("h")).alias("f"))
    assert df.select(X.reading(F.col("f")).alias("r")).first().r == reading


PHRASES = [(1, 0, "Neural Gravity"), (1, 1, "pull of words"), (2, 0, "log"), (3, 0, "great power"), (3, 1, "great responsibility"), (4, 0, "!!!"), (5, 0, "cat"), (6, 0, "x.y"), (7, 0, " ")]
TEXTS = [
    (1, "the neural gravity of it"), (2, "gravity that is neural"), (3, "private logic"), (4, "a log of power that is great"), (5, "wow !!!"), (6, "concatenate words of a pull"), (7, "x.y"), (8, "xzy"), (9, ""), (10, None),
    (11, "great"), (12, "words pull of"), (13, "neural gravity"), (14, "Great   Power"),
]


def bounded(part, text):
    return re.search(r"\b" + re.escape(part) + r"\b", text) is not None


def span_score(span, phrase):
    s, p = span.lower().strip(), phrase.lower().strip()
    if not s or not p:
        return None
    if s == p:
        return 1.0
    if re.search(r"(^|\b)" + re.escape(p) + r"(\b|$)", s):
        return 0.95
    words = p.split()
    return 0.9 if all(bounded(w, s) for w in words) and len(words) / max(1, len(s.split())) >= 0.5 else None


def text_score(text, phrase):
    t, p = text.lower(), phrase.lower()
    if p in t:
        return 1.0
    return 0.85 if len(p.split()) > 1 and all(bounded(w, t) for w in p.split()) else None


def first_hits(score):
    out = {}
    for key, text in TEXTS:
        for id_ in sorted({p[0] for p in PHRASES}):
            for n, phrase in sorted((n, p) for i, n, p in PHRASES if i == id_):
                if text is not None and (c := score(text, phrase)) is not None:
                    out[key, id_] = (phrase, c)
                    break
    return out


def test_span_and_text_matches(spark):
    phrases = spark.createDataFrame(PHRASES, "id int, n int, phrase string")
    spans = spark.createDataFrame(TEXTS, "span_id int, text string")
    got = {(r.span_id, r.id): (r.phrase, r.confidence) for r in matcher.span_matches(spans, phrases).collect()}
    assert got == first_hits(span_score)
    texts = spans.withColumnRenamed("span_id", "text_id")
    got = {(r.text_id, r.id): (r.phrase, r.confidence) for r in matcher.text_matches(texts, phrases).collect()}
    assert got == first_hits(text_score)
    got = {(r.text_id, r.id) for r in matcher.mentions(texts, phrases).collect()}
    assert got == {(k, i) for k, t in TEXTS if t for i, _, p in PHRASES if p and bounded(p.lower(), t.lower())}


def letters():
    """An embedder by counts of letters, enough for a likeness that plain loops can repeat; made here so that it travels by value."""
    return lambda texts: np.array([[t.lower().count(c) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts], float).reshape(len(texts), 26)


embed = letters()


def cosine(a, b):
    na, nb = np.linalg.norm(a), np.linalg.norm(b)
    return float(a @ b / (na * nb)) if na > 1e-8 and nb > 1e-8 else None


def brute_match(text, handles, names):
    phrases_of = {i: [p for _, p in sorted((n, p) for j, n, p in PHRASES if j == i)] for i in handles}
    spans, residue, _ = wraps(text)
    out, wrapped = [], set()

    def first(score, own, t):
        for p in own:
            if (c := score(t, p)) is not None:
                return p, c
        return None

    for s in spans:
        found = [(i, *hit) for i, h in handles.items() if (h["open"] or h["wrapped_only"]) and (hit := first(span_score, phrases_of[i], s))]
        top = max((c for _, _, c in found), default=0)
        near = [f for f in found if top - f[2] < 0.05]
        for i, p, c in near:
            out.append((i, "auto" if len(near) == 1 else "candidate", c, p))
            if len(near) == 1:
                wrapped.add(i)

    def best(i, t):
        v = embed([t])[0]
        sims = [(s, p) for p in phrases_of[i] if (s := cosine(v, embed([p])[0])) is not None]
        return max(sims, default=None)

    if residue.strip():
        for i, h in handles.items():
            if i in wrapped or not h["open"] or h["wrapped_only"]:
                continue
            hit = first(text_score, phrases_of[i], residue)
            if hit is None and (b := best(i, residue)) and b[0] >= 0.8 * h["min_fuzzy"]:
                hit = b[1], b[0]
            if hit:
                tier = "auto" if hit[1] >= h["min_exact"] else "candidate" if hit[1] >= h["min_fuzzy"] else "weak"
                out.append((i, tier, hit[1], hit[0]))
    known = {o[0] for o in out if o[1] != "weak"}
    if text and text.strip():
        for i in handles:
            if i not in known and (b := best(i, text)) and b[0] >= 0.42:
                out.append((i, "auto" if b[0] >= 0.7 else "candidate" if b[0] >= 0.55 else "weak", round(b[0], 4), b[1]))
    matched = {o[0] for o in out if o[1] != "weak"}
    for i, p in names:
        if i not in matched and len(p) > 3 and text and p in text.lower():
            out.append((i, "ref", 0.9, p))
    return sorted((i, t, round(c, 4)) for i, t, c, _ in out)


def test_match_all(spark):
    ship(spark)
    texts = [
        (1, "*neural gravity* and a log"), (2, "*great power and great responsibility and neural gravity*"), (3, "with *log* comes great power"), (4, "*scratch that* the epistemic floor"), (5, "zzz"), (6, ""), (7, None),
        (8, "*cat* !!! epistemic floor"), (9, "responsibility is great *open"), (10, "* * nothing"),
    ]
    handles = {i: {"open": i != 2, "wrapped_only": i == 3, "min_exact": 0.85, "min_fuzzy": 0.7} for i in sorted({p[0] for p in PHRASES})}
    names = [(100, "epistemic floor"), (101, "log"), (102, "nothing")]
    df = spark.createDataFrame(texts, "text_id int, text string")
    h = spark.createDataFrame([(i, *v.values()) for i, v in handles.items()], "id int, open boolean, wrapped_only boolean, min_exact double, min_fuzzy double")
    n = spark.createDataFrame([(i, 0, p) for i, p in names], "id int, n int, phrase string")
    rows = matcher.match_all(df, h, spark.createDataFrame(PHRASES, "id int, n int, phrase string"), n, letters()).collect()
    for key, text in texts:
        assert sorted((r.id, r.tier, round(r.confidence, 4)) for r in rows if r.text_id == key) == brute_match(text, handles, names), text


def brute_resolve(label, keys):
    key = label.strip().lower()
    if key in keys:
        return "exact"
    if any(min(len(key), len(k)) >= 5 and min(len(key), len(k)) / max(len(key), len(k)) >= 0.5 and (key in k or k in key) for k in keys):
        return "contained"
    return "alike" if any(difflib.SequenceMatcher(None, key, k).ratio() >= 0.85 for k in keys) else "miss"


def test_labels_resolve_as_by_a_scan_of_all_keys(spark):
    rng = np.random.default_rng(4)
    letters = list("abcdeé 12")
    keys = {"anchors", "Überbau der Welt", "neural gravity", "abcdefg", "12", "a"} | {"".join(rng.choice(letters, rng.integers(2, 14))).strip() or "q" for _ in range(150)}
    keys = {k.lower() for k in keys}
    labels = ["anchor", "überbau der Wellt", "gravity", "abcdefgh", "abcdef", "13", ""]
    for k in sorted(keys)[:120]:
        at = int(rng.integers(0, len(k)))
        labels += [k[:at] + "x" + k[at:], k[:at] + k[at + 1 :], k + k[:2]]
    labels = sorted({x.strip() for x in labels} - {""})
    index = label_index(spark.createDataFrame([(k, k, 0) for k in keys], "label string, id string, priority int"))
    got = {r.label: r.strategy for r in resolve_labels(spark.createDataFrame([(x,) for x in labels], "label string"), index).collect()}
    assert got == {x: brute_resolve(x, keys) for x in labels}


def test_messages_keep_roles_order_and_text():
    raw = '{"mapping": {"b": {"message": {"author": {"role": "tool"}, "create_time": 2, "content": {"parts": ["x", "y", 3]}}}, "a": {"message": {"author": {"role": "user"}, "create_time": 1, "content": {"parts": ["hi"]}}}, "s": {"message": {"author": {"role": "system"}, "content": {"parts": ["no"]}}}, "n": {"message": null}}}'
    assert conversations.exchanges(raw) == [{"role": "user", "content": "hi", "index": 0}, {"role": "assistant", "content": "x y", "index": 1}]
    raw = '{"chat_messages": [{"sender": "Human", "content": [{"type": "text", "text": "one"}, {"type": "image"}, {"type": "text", "text": "two"}]}, {"sender": "assistant", "text": "  "}, {"sender": "bot", "text": "ok"}]}'
    assert [(x["role"], x["content"]) for x in conversations.exchanges(raw)] == [("user", "one two"), ("assistant", "ok")]
    raw = '[{"role": "system", "content": "s"}, {"role": "tool", "content": ["a", 1]}, {"content": "b"}]'
    assert conversations.exchanges(raw) == [{"role": "tool", "content": "a 1", "index": 1}, {"role": "user", "content": "b", "index": 2}]
    lines = ['{"type": "user", "message": {"content": [{"type": "text", "text": " long enough text "}, "and more", {"type": "tool_use"}]}}', '{"type": "user", "message": {"content": "@file something long"}}', '{"type": "user", "message": {"content": "Base directory for this skill: x"}}', '{"type": "assistant", "message": {"content": "an answer that is long"}}', '{"type": "assistant", "message": "odd"}']
    assert [(x["role"], x["content"]) for x in conversations.exchanges("\n".join(lines))] == [("user", "long enough text\nand more"), ("assistant", "an answer that is long")]


def test_verification_routes(spark):
    claims = spark.createDataFrame([(1, "a", "manual"), (2, "b", "model"), (3, "c", "model"), (4, "d", "external"), (5, "e", None)], "id int, claim string, method string")

    def verifier(prompt):
        if prompt.endswith("c"):
            raise RuntimeError("down")
        return {"outcome": "confirmed", "confidence": 0.9}

    got = {r.id: (r.outcome, r.confidence) for r in models.verified(claims, verifier).collect()}
    assert got == {1: ("UNRESOLVABLE", 0.0), 2: ("CONFIRMED", 0.9), 3: ("UNRESOLVABLE", 0.0), 4: ("UNRESOLVABLE", 0.0), 5: ("UNRESOLVABLE", 0.0)}


def test_drafts_consolidate(spark):
    rows = [
        (0, "anchor", "kept", None, None, None, ["k2"]), (1, "anchor", "demoted", None, None, None, []), (2, "anchor", "orphan", None, None, None, None), (3, "anchor", " ", None, None, None, []),
        (4, "slab", None, "S one", "text", None, []), (5, "slab", None, "S two", "text", None, []), (6, "slab", None, "empty", "", None, []), (7, "bundle", None, None, None, "B", ["kept", "by bundle"]), (8, "anchor", "by bundle", None, None, None, []),
        (9, "anchor", "semantic", None, None, None, []),
    ]
    p = spark.createDataFrame([(*r, "", "why", 0.5) for r in rows], "ord long, type string, phrase string, title string, text string, label string, aliases array<string>, description string, justification string, confidence double")
    rel = [(0, "links", "K2", "s one"), (1, "links", "S two", "kept"), (2, "LINKS", "demoted", "S one"), (3, "odd", "demoted", "nothing"), (4, "LINKS", "kept", "kept"), (5, "CONFLICTS", "semantic", "S one"), (6, "SEQUENCE", "orphan", "S one")]
    r = spark.createDataFrame([(*x, 0.5) for x in rel], "ord long, type string, from_label string, to_label string, confidence double")
    out = proposals.consolidated(p, r)
    corpus = proposals.temporary_corpus(p, r)
    verdicts = {x.id.rsplit("_", 1)[1]: x.verdict for x in proposals.analysed(corpus).collect()}
    assert verdicts == {"0": "KEEP", "1": "DEMOTE", "2": "ORPHAN", "8": "KEEP", "9": "KEEP"}
    assert sorted(x.ord for x in out["proposals"].collect()) == [0, 3, 4, 5, 6, 7, 8, 9]
    assert sorted(x.ord for x in out["relations"].collect()) == [0, 1, 4, 5]
    assert [(x.title, x.phrase) for x in out["inline"].collect()] == [("S one", "demoted")]
    assert out["summary"].first().asDict() == {"anchors": 5, "kept": 3, "demoted": 1, "orphans": 1, "edges_dropped": 3}
    counts = {x.strategy: x.n for x in corpus["strategies"].collect()}
    assert counts["miss"] >= 1 and sum(counts.values()) == 2 * len(rel)


def test_commit_rolls_back(spark):
    corpus = spark.createDataFrame([("a_v1", "anchor", "v1")], "id string, type string, version string")
    good = spark.createDataFrame([("b_v1", "slab", "v1")], "id string, type string, version string")
    refs = spark.createDataFrame([("b_v1", "a_v1")], "id string, ref string")
    new, errors = lifecycle.committed(corpus, good, refs)
    assert sorted(r.id for r in new.collect()) == ["a_v1", "b_v1"] and errors.count() == 0
    bad = spark.createDataFrame([("a_v1", "slab", "v1"), ("c", "slab", "v1")], "id string, type string, version string")
    new, errors = lifecycle.committed(corpus, bad, refs.select(F.lit("c").alias("id"), F.lit("none").alias("ref")))
    assert [r.id for r in new.collect()] == ["a_v1"] and {r.check for r in errors.collect()} == {"duplicate_id", "version_suffix", "missing_reference"}


def test_session_files(spark, tmp_path):
    root = f"file://{tmp_path}"
    drafts = tmp_path / "drafts"
    drafts.mkdir()
    (drafts / "a.json").write_text('{"id": "a", "chat_id": "c"}')
    (drafts / "a_raw.json").write_text('{"id": "raw", "chat_id": "c"}')
    (drafts / "a.enriched.json").write_text('{"id": "rich", "chat_id": "c"}')
    (drafts / "bad.json").write_text("{")
    assert [r.id for r in sessions.draft_files(spark, f"{root}/drafts", "id string, chat_id string").collect()] == ["a"]
    assert sessions.json_files(spark, f"{root}/nowhere", "id string").count() == 0
    (tmp_path / "good.jsonl").write_text('{"turns": 3}\n{"turns": 4}\n')
    (tmp_path / "bad.jsonl").write_text('{"turns": 3}\noops\n')
    assert sorted(sessions.session_durations(spark, f"{root}/good.jsonl")) == [3, 4]
    assert sessions.session_durations(spark, f"{root}/bad.jsonl") == [] == sessions.session_durations(spark, f"{root}/none.jsonl")
    for name in ("objects/anchors.yaml", "corpora/b/objects/anchors.yaml", "corpora/a/objects/slabs.yaml", "corpora/empty/notes.txt", "src/x.py", "src/deep/y.yml", "src/z.txt"):
        path = tmp_path / "store" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("- x")
    found = {r.collection: r.path for r in sessions.discovered(spark, f"{root}/store").collect()}
    assert set(found) == {"default", "a", "b"} and found["a"].endswith("corpora/a")
    assert sorted(r.path for r in sessions.code_files(spark, f"{root}/store/src").collect()) == ["deep/y.yml", "x.py"]
    assert sessions.current(spark, f"{root}/t", "id long").count() == 0
    with pytest.raises(ValueError, match="no topic"):
        sessions.log_event(spark, f"{root}/log", "nothing", spark.range(1))
    assert not sessions.session_ended(spark, f"{root}/ends", "s", 0) and sessions.session_ended(spark, f"{root}/ends", "s", 2)
