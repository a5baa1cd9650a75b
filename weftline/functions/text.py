"""Text functions on columns: tokens, keys, slugs, ids and small renderings."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words a search leaves out, and words it adds to a query.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "based", "by", "for", "from", "how", "i", "in", "is", "it", "me", "of", "on", "per",
    "collection", "config", "configuration", "please", "pod", "spec", "specification", "tell", "teh", "the", "to", "was", "what", "with",
)
EXPANSIONS = {
    "dimension": ("length", "width", "height", "depth", "dimensions"),
    "dimensions": ("length", "width", "height", "depth", "dimension"),
    "size": ("length", "width", "height", "depth", "dimensions"),
    "salt": ("saltwater", "saline", "salinity", "freshwater"),
    "saltwater": ("salt", "saline", "salinity", "freshwater"),
    "saline": ("saltwater", "salinity", "freshwater"),
    "volume": ("litres", "liters", "cubic", "capacity"),
}
# Weight of an added word, pattern of a token, and the rewrites before tokens are taken, (pattern, replacement) in their order.
EXPANSION_WEIGHT = 0.55
TOKEN = r"[a-z]+(?:'[a-z]+)?|\d+(?:\.\d+)?"
TOKEN_REWRITES = (
    ("m³|m\\^3", " cubic metres "),
    ("salt-water", "saltwater"),
    (r"\b(?:pod_?v?|version|v)[_\s-]*\d+\b", " "),
    (r"\bmeters?\b", "metres"),
    (r"\bliters?\b", "litres"),
)
#: Of these words each text that a rewrite changes holds one.
_NEEDED = (("m³", "m^3"), ("salt-water",), ("pod", "v"), ("meter",), ("liter",))


def search_tokens(text: Column) -> Column:
    """Lower-case words and numbers after unit and version spellings are unified; null gives no tokens."""
    out = F.lower(F.coalesce(text, F.lit("")))
    for (pattern, into), words in zip(TOKEN_REWRITES, _NEEDED, strict=True):
        out = _bound(out, functools.partial(_rewritten, pattern, into, words))
    return F.regexp_extract_all(out, F.lit(TOKEN), F.lit(0))


def _rewritten(pattern: str, into: str, words: tuple[str, ...], text: Column) -> Column:
    """A rewrite of the texts that hold one of its words; most hold none, and a plain search is faster than the pattern."""
    some = functools.reduce(operator.or_, (F.contains(text, F.lit(w)) for w in words))
    return F.when(some, F.regexp_replace(text, pattern, into)).otherwise(text)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it stands there."""
    return F.transform(F.array(value), lambda x: use(x))[0]


def search_tokens_sql(text: str) -> str:
    """The same tokens in DuckDB."""
    out = f"lower(coalesce({text}, ''))"
    for pattern, into in TOKEN_REWRITES:
        out = f"regexp_replace({out}, '{pattern}', '{into}', 'g')"
    return f"regexp_extract_all({out}, '{TOKEN.replace(chr(39), chr(39) * 2)}')"


def query_terms(words: list[str]) -> dict[str, float]:
    """Weight of each query term: 1 for those asked for, 0.55 for expansions."""
    asked = [w for w in words if w not in STOPWORDS]
    out = dict.fromkeys(asked, 1.0)
    for w in asked:
        for more in EXPANSIONS.get(w, ()):
            out.setdefault(more, EXPANSION_WEIGHT)
    return out


def word_set(text: Column, least: int = 3) -> Column:
    """Distinct lower-case words of at least so many letters or digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"[a-z0-9]{{{least},}}"), F.lit(0)))


def label_key(text: Column) -> Column:
    """Lower case without outer spaces."""
    return F.lower(F.trim(text))


def folded_key(text: Column) -> Column:
    """Lower case with runs of white space as one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\r\n]+", " "))


def alnum_key(text: Column) -> Column:
    """Lower case, runs of anything but letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def slug(text: Column, length: int = 40, fallback: str = "item") -> Column:
    """Lower-case words joined by underscores, cut at ``length``."""
    out = F.regexp_replace(F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, length), "_+$", "")
    return F.when(F.coalesce(out, F.lit("")) == "", F.lit(fallback)).otherwise(out)


def fold_punctuation(text: Column) -> Column:
    """Curly quotes, dashes, arrows, ellipses and hard spaces in ASCII."""
    out = F.translate(text, "‘’“”–— ", "''\"\"-- ")
    return F.replace(F.replace(out, F.lit("→"), F.lit("->")), F.lit("…"), F.lit("..."))


def stable_id(prefix: str, *parts: Column, length: int = 10) -> Column:
    """Prefix and the first characters of the SHA-1 of the parts."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat(*parts)), 1, length))


def edge_id(src: Column, dst: Column) -> Column:
    """The id of a sequence edge: SHA-1 of both ends with a zero character between, 12 characters of it."""
    return F.substring(F.sha1(F.concat(src, F.lit("\x00"), dst)), 1, 12)


def approx_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up, one at least."""
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4)).cast("long")


def jaccard(a: Column, b: Column) -> Column:
    """Shared by all distinct elements; 0 for two empty sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def heading_text(line: Column) -> Column:
    """A heading without its marks."""
    return F.trim(F.regexp_replace(line, r"^#{1,6}[ \t]+|[ \t]*#*[ \t]*$", ""))


def quote_text(line: Column) -> Column:
    """A quote without leading marks and outer quotation marks."""
    return F.regexp_replace(F.trim(F.regexp_replace(line, r"^[> \t]+", "")), "^\"+|\"+$", "")


def light_title(text: Column) -> Column:
    """Upper case first letters; words with capitals of their own stay."""
    word = lambda w: F.when(F.lower(w) == w, F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))).otherwise(w)
    return F.array_join(F.transform(F.split(text, " "), word), " ")


def one_line(text: Column, length: int = 120) -> Column:
    """White space folded, cut with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))
    return F.when(F.length(flat) > length, F.concat(F.substring(flat, 1, length - 1), F.lit("…"))).otherwise(flat)


def age(seconds: Column) -> Column:
    """Minutes, hours or days."""
    return (
        F.when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit("m")))
        .when(seconds < 86400, F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h")))
        .otherwise(F.concat(F.floor(seconds / 86400).cast("string"), F.lit("d")))
    )


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def first_of(*choices: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in choices])
