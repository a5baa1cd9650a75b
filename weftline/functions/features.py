"""Features of the words that a user puts between single asterisks, as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cues of a correction, words of gestures, negative words, sighs, and openings that only sound like the first person.
CORRECTION_CUES = (
    "scratch that", "never mind", "nevermind", "forget that", "forget it", "hold on", "wait", "actually", "oops", "correction", "i retract", "retract that", "i meant", "let me rephrase",
    "let me restart", "strike that", "disregard that", "my mistake", "no wait", "actually no", "ignore that", "take that back",
)
EMOTE_VERBS = (
    "laughs", "giggles", "chuckles", "cackles", "snickers", "smiles", "grins", "beams", "smirks", "frowns", "sighs", "groans", "moans", "yawns", "nods", "shakes", "shrugs", "tilts",
    "blinks", "stares", "squints", "winks", "cries", "weeps", "sobs", "blushes", "flushes", "pales", "thinks", "ponders", "considers", "wonders", "gasps", "gulps", "swallows",
    "waves", "points", "gestures", "pauses", "stops", "freezes", "leans", "paces", "wanders", "facepalms", "facepalm", "raises", "lowers", "crosses", "uncrosses", "taps", "rubs", "scratches",
    "breathes", "exhales", "inhales", "sniffs", "snorts", "scoffs", "rolls", "stretches", "laughing", "smiling", "grinning", "sighing", "shrugging", "nodding", "staring", "blinking", "thinking",
)
EMOTE_NOUNS = (
    "shock", "surprise", "concern", "relief", "confusion", "laugh", "laughter", "sigh", "groan", "yawn", "nod", "shrug", "blink", "stare", "wink", "cry", "sob", "blush", "gasp", "wave", "pause",
    "breath", "smile", "grin", "frown", "smirk", "scoff", "stretch", "eyebrow", "brow", "eye", "eyes", "head", "hand", "hands", "shoulders", "lips", "mouth",
)
MILD = (
    "dumb", "stupid", "silly", "foolish", "dense", "clueless", "weird", "strange", "odd", "goofy", "confused", "annoying", "ridiculous", "absurd", "cringe", "cringey", "embarrassing", "embarrassed",
)
HARSH = (
    "useless", "broken", "terrible", "awful", "horrible", "hopeless", "worthless", "garbage", "trash", "cursed", "pointless", "wrong", "mistake", "messed", "screwed", "failed",
    "idiot", "idiotic", "moron", "moronic", "fool",
)
SIGHS = ("urgh", "ugh", "argh", "grr", "grrr", "hmph", "tsk", "pfft", "bleh", "meh", "oof", "yeesh", "sheesh")
SELF_EXPLETIVES = ("fml", "kms", "smh", "facepalm")
MY_BAD = ("my bad", "my fault", "my mistake")
IDIOMS = (
    "oh my god", "oh my goodness", "oh my gosh", "my god", "my goodness", "good god", "good lord", "jesus christ", "oh jesus", "holy shit", "holy cow", "for god's sake", "for fuck's sake",
    "for crying out loud",
)
INTERROGATIVES = ("why", "how", "what", "where", "when", "who", "wtf", "wth")
SECOND_PERSON = ("you", "your", "yours", "youre", "u", "ur", "yer")
FIRST_PERSON = r"\b(?:i'm|im|i\s+am|i've|ive|i'd|id|i\s+feel)\b"
# Spellings with feeling: vowels three times, consonants four times, capitals, marks.
EXTENDED_VOWELS = "|".join(f"{c}{{3,}}" for c in "aeiouAEIOU")
EXTENDED_CONSONANTS = "|".join(f"{c}{{4,}}" for c in "bcdfghjklmnpqrstvwxyzBCDFGHJKLMNPQRSTVWXYZ")
AFFECT_CAPS = r"\b[A-Z]{3,}\b"
MIXED_CAPS = "[a-z][A-Z]|[A-Z]{2,}[a-z][A-Z]"
REPEATED_MARKS = r"[!?]{2,}|\.{3,}"
WORD = "[a-z']+"
SHORT, LONG = 5, 10


def _lower(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def _any_word(low: Column, *lexicons: tuple[str, ...]) -> Column:
    return F.arrays_overlap(F.regexp_extract_all(low, F.lit(WORD), F.lit(0)), F.array(*[F.lit(w) for lexicon in lexicons for w in lexicon]))


def _any_part(low: Column, parts: tuple[str, ...]) -> Column:
    return reduce(or_, (F.contains(low, F.lit(p)) for p in parts))


def _named(flags: dict[str, Column]) -> Column:
    """The names of the flags that hold, in their order."""
    return F.filter(F.array(*[F.when(f, F.lit(n)) for n, f in flags.items()]), lambda x: x.isNotNull())


def _directed(text: Column) -> dict[str, Column]:
    low = _lower(text)
    negative, harsh, sigh = _any_word(low, MILD, HARSH), _any_word(low, HARSH), _any_word(low, SIGHS)
    asks = _any_word(low, INTERROGATIVES)
    plain = reduce(lambda t, idiom: F.replace(t, F.lit(idiom), F.lit("")), IDIOMS, low)
    me = low.rlike(FIRST_PERSON)
    mine = plain.rlike(r"\bmy\b") | F.contains(plain, F.lit("myself"))
    you = _any_word(low, SECOND_PERSON) | F.contains(low, F.lit("you're"))
    self_ = _any_word(low, SELF_EXPLETIVES) | _any_part(low, MY_BAD) | ((me | mine) & negative)
    model = ~self_ & you & (negative | sigh | asks)
    world = ~self_ & ~model & negative & ~(me | mine) & ~you
    return {
        "sigh_interjection": sigh, "rhetorical_question": asks & (sigh | negative | you | me | mine), "self_directed_affect": self_, "model_directed_affect": model,
        "harsh_descriptor": model & harsh, "world_directed_affect": world,
    }


def directionality(text: Column) -> Column:
    """At whom an outburst is aimed (self, model or world, one at most), a harsh word at the model, a sigh, a question that wants no answer."""
    return _named(_directed(text))


def _shape(text: Column, hits: Column) -> dict[str, Column]:
    raw, low = F.coalesce(text, F.lit("")), _lower(text)
    words = F.regexp_count(raw, F.lit(r"[^\s]+"))
    return {
        "ambiguous_anchor": hits >= 2, "anchor_hit": hits == 1, "short": words <= SHORT, "long": words > LONG, "correction_cue": _any_part(low, CORRECTION_CUES), "emote_vocab": _any_word(low, EMOTE_VERBS, EMOTE_NOUNS),
        "extended_vowels": raw.rlike(EXTENDED_VOWELS), "extended_consonants": raw.rlike(EXTENDED_CONSONANTS), "affect_caps": raw.rlike(AFFECT_CAPS), "mixed_caps": raw.rlike(MIXED_CAPS), "repeated_punct": raw.rlike(REPEATED_MARKS),
    }


def features(text: Column, hits: Column) -> Column:
    """Names of the features of a wrapped span in which ``hits`` handles were found; null and blank spans are short."""
    return _named(_shape(text, hits) | _directed(text))


# What a span is read as, by the first of its features in this order; the ones in brackets must all be there.
READINGS = (
    ("ambiguous_invocation", ("ambiguous_anchor",)),
    ("explicit_invocation", ("anchor_hit",)),
    ("self_correction", ("correction_cue",)),
    ("self_directed_frustration", ("self_directed_affect",)),
    ("model_directed_complaint", ("model_directed_affect", "harsh_descriptor")),
    ("model_directed_exasperation", ("model_directed_affect",)),
    ("world_directed_frustration", ("world_directed_affect",)),
    ("performed_imitation", ("affect_caps",)),
    ("performed_imitation", ("extended_vowels",)),
    ("performed_imitation", ("mixed_caps",)),
    ("performed_imitation", ("extended_consonants",)),
    ("stage_direction", ("emote_vocab", "short")),
    ("ambient_sigh", ("sigh_interjection",)),
    ("strong_affect", ("repeated_punct", "short")),
)


def reading(found: Column) -> Column:
    """What a span with these features is read as."""
    out = None
    for name, needed in READINGS:
        all_ = F.size(F.array_except(F.array(*[F.lit(n) for n in needed]), found)) == 0
        out = F.when(all_, name) if out is None else out.when(all_, name)
    return out.otherwise("semantic_depth")


def affect_boost(spans: Column) -> Column:
    """What the spans' features (an array of arrays of names) add to the affect signal: .12 for spelling, else .08 for gestures, .35 at most."""
    loud = F.array(*[F.lit(n) for n in ("affect_caps", "extended_vowels", "mixed_caps", "extended_consonants", "repeated_punct")])
    one = F.transform(spans, lambda s: F.when(F.arrays_overlap(s, loud), 0.12).when(F.array_contains(s, "emote_vocab"), 0.08).otherwise(0.0))
    return F.least(F.lit(0.35), F.aggregate(one, F.lit(0.0), lambda a, x: a + x))
