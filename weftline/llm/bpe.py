"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

The leaves of the tree are the ranks of a word's adjacent symbol pairs, each joined with its
position, so the root is the leftmost lowest-rank merge. A merge changes at most three leaves, each
updated in logarithmic time, until no mergeable pair remains. Short words run through the trees of
many words at once, as rows of one numpy array; long ones through a tree of their own.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.memory import released
from weftline.session import ship

#: Words of up to so many symbols share the batched tree.
BATCHED = 64
#: Words a worker keeps encoded; at the limit the memory starts anew.
REMEMBERED = 300_000


# Letters and numbers of Unicode 16, and capitals with the distance of their small letters, that older interpreters do not know.
NEWER = {
    "L": (
        (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E),
        (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED),
        (0x1E5F0, 0x1E5F0),
    ),
    "N": ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)),
}
NEWER_CAPITALS = (
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, -0xA567), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, -0xA641), (0x10D50, 0x10D65, 0x20),
    (0x16EA0, 0x16EB8, 0x1B),
)
_SMALL = {c: c + d for a, b, d in NEWER_CAPITALS for c in range(a, b + 1)}


def _classes() -> tuple[str, str]:
    """Letters and numbers as character ranges, by the general categories of the standard library and the newer ones."""
    out: dict[str, list[list[int]]] = {"L": [], "N": []}
    newer = {c: k for k, own in NEWER.items() for a, b in own for c in range(a, b + 1)}
    for i in range(sys.maxunicode + 1):
        ranges = out.get(newer.get(i, unicodedata.category(chr(i))[0]))
        if ranges is not None:
            if ranges and ranges[-1][1] == i - 1:
                ranges[-1][1] = i
            else:
                ranges.append([i, i])
    letters, numbers = ("".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out[k]) for k in "LN")
    return letters, numbers


_LETTERS, _NUMBERS = _classes()
_SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACES}{_LETTERS}{_NUMBERS}]+")
#: The same pieces for texts of ASCII and Latin letters, where the classes of re agree with it.
_PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
_UNUSUAL = re.compile("[^\x00-\x1b\x20-\x84\x86-\xa9\xab-\xb1\xb4-\xb8\xbb\xbf-ɏ]")
_FAR = np.int64(1) << np.int64(62)
_MIX, _SHIFT = np.int64(0x2545F4914F6CDD1D), np.int64(29)


def byte_letters() -> list[str]:
    """The visible character that stands for each byte in byte-level vocabularies."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in kept}
    for n, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + n)
    return [letters[b] for b in range(256)]


#: The parts of a definition that this class carries out; any other definition is refused.
PARTS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "decoder": None,
}
MODEL_PARTS = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}


class Bpe:
    """A tokenizer read from a JSON definition: NFC, white space, lower case, pieces, word-end BPE."""

    def __init__(self, definition: str) -> None:
        spec = json.loads(definition)
        model = spec["model"]
        other = [k for k, v in PARTS.items() if spec.get(k) != v] + [k for k, v in MODEL_PARTS.items() if model.get(k, v) != v]
        if other:
            raise ValueError(f"not a definition of this kind: {', '.join(other)}")
        self.end = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        letters = byte_letters()
        self.inner = np.array([vocab.get(c, -1) for c in letters], dtype=np.int64)
        self.final = np.array([vocab.get(c + self.end, -1) for c in letters], dtype=np.int64)
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs.setdefault(vocab[left] << 20 | vocab[right], (rank, vocab[left + right]))
        codes = sorted(self.pairs)
        self.codes = np.array([*codes, -1], dtype=np.int64)  # the last entry stands for an empty slot
        self.ranks = np.array([*(self.pairs[c][0] for c in codes), 0], dtype=np.int64)
        self.by_rank = np.zeros(len(model["merges"]) + 1, dtype=np.int64)
        for rank, merged in self.pairs.values():
            self.by_rank[rank] = merged
        self._hash(len(codes))
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, tuple[int, str, str]] = {}

    def _hash(self, n: int) -> None:
        """A table from the hash of a pair to its entry, eight slots for each, open addressing."""
        size = 1 << max(4, (8 * n).bit_length())
        self.mask, self.probes = size - 1, 1
        self.table = np.full(size, n, dtype=np.int32)
        slots = ((self.codes[:n] * _MIX) >> _SHIFT) & self.mask
        for k, slot in enumerate(slots.tolist()):
            probe = 1
            while self.table[slot] != n:
                slot = (slot + 1) & self.mask
                probe += 1
            self.table[slot] = k
            self.probes = max(self.probes, probe)

    # -- text to pieces ---------------------------------------------------------------------------
    def pieces(self, text: str) -> list[str]:
        """The normalised pieces of a text without special tokens."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
        else:
            text = text.lower()
        return _PIECES.findall(text.translate(_SMALL)) if _UNUSUAL.search(text) else _PLAIN.findall(text)

    def parts(self, text: str) -> list[str]:
        """Pieces and special tokens of a whole text, in order; specials keep their own spelling."""
        if self.split is None or "<" not in text:
            return self.pieces(text)
        out: list[str] = []
        for i, part in enumerate(self.split.split(text)):
            out += [part] if i % 2 else self.pieces(part)
        return out

    # -- pieces to ids ----------------------------------------------------------------------------
    def _leaf(self, left: np.ndarray, right: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
        """Leaf of each pair: its rank joined with its place, or _FAR; negative symbols never merge."""
        code = (left << 20) | right
        slot = ((code * _MIX) >> _SHIFT) & self.mask
        at = self.table[slot]
        hit = self.codes[at] == code
        for _ in range(self.probes - 1):
            if hit.all():
                break
            slot = (slot + 1) & self.mask
            nxt = self.table[slot]
            also = self.codes[nxt] == code
            at = np.where(also, nxt, at)
            hit |= also
        hit &= (left >= 0) & (right >= 0)
        return np.where(hit, self.ranks[at] * width + place, _FAR)

    def _many(self, flat: np.ndarray, lens: np.ndarray, width: int) -> list[list[int]]:
        """Words of at most ``width`` symbols (a power of two), each a row with its own tree."""
        n, span, twice = len(lens), width + 2, 2 * width
        grid = np.full((n, span), -1, dtype=np.int64)  # column 0 and the last stand for no neighbour
        grid[:, 1:-1][np.arange(width)[None, :] < lens[:, None]] = flat
        cols = np.arange(span)
        after = np.tile(np.minimum(cols + 1, width + 1), n)
        before = np.tile(np.maximum(cols - 1, 0), n)
        leaves = np.full((n, twice), _FAR, dtype=np.int64)
        leaves[:, width:] = self._leaf(grid[:, 1:-1], grid[:, 2:], np.arange(width), width)
        half = width // 2
        while half:
            leaves[:, half : 2 * half] = np.minimum(leaves[:, 2 * half : 4 * half : 2], leaves[:, 2 * half + 1 : 4 * half : 2])
            half //= 2
        sym, tree = grid.reshape(-1), leaves.reshape(-1)
        roots = np.arange(n) * twice + 1
        best = tree[roots]
        rows = np.flatnonzero(best < _FAR)
        while len(rows):
            base, best = rows * span, best[rows] if len(best) > len(rows) else best
            at = best % width + 1
            here = base + at
            second = after[here]
            there = base + second
            third, first = after[there], before[here]
            made = self.by_rank[best // width]
            sym[here] = made
            sym[there] = -2
            after[here] = third
            before[base + third] = at
            left_rank = self._leaf(sym[base + first], made, first - 1, width)
            right_rank = self._leaf(made, sym[base + third], at - 1, width)
            # a word's first symbol has no left neighbour: its update repeats that of the merged leaf
            none = first == 0
            node = np.concatenate([np.where(none, at, first), at, second]) + (width - 1)
            start = np.concatenate([rows, rows, rows]) * twice
            tree[start + node] = np.concatenate([np.where(none, right_rank, left_rank), right_rank, np.full(len(rows), _FAR)])
            level = width
            while level > 1:
                level >>= 1
                node >>= 1
                below = start + 2 * node
                tree[start + node] = np.minimum(tree[below], tree[below + 1])
            best = tree[rows * twice + 1]
            on = best < _FAR
            rows, best = rows[on], best[on]
        sym = grid
        left = sym[:, 1:-1]
        keep = left >= 0
        flat, ends = left[keep].tolist(), np.cumsum(keep.sum(axis=1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _one(self, symbols: list[int]) -> list[int]:
        """A single long word."""
        n = len(symbols)
        width = 1 << max(1, (n - 1).bit_length())
        sym, after, before = list(symbols), [*range(1, n), -1], [-1, *range(n - 1)]
        none = (1 << 62, 0)
        tree = [none] * (2 * width)

        def pair(i: int) -> tuple[int, int]:
            j = after[i]
            hit = self.pairs.get(sym[i] << 20 | sym[j]) if j >= 0 and sym[i] >= 0 and sym[j] >= 0 else None
            return (hit[0], i) if hit else none

        for i in range(n):
            tree[width + i] = pair(i)
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(i: int, value: tuple[int, int]) -> None:
            k = width + i
            tree[k] = value
            while k > 1:
                k >>= 1
                low = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == low:
                    break
                tree[k] = low

        while tree[1] < none:
            i = tree[1][1]
            j = after[i]
            sym[i] = self.pairs[sym[i] << 20 | sym[j]][1]
            sym[j] = -2
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            put(j, none)
            put(i, pair(i))
            if before[i] >= 0:
                put(before[i], pair(before[i]))
        return [s for s in sym if s >= 0]

    def words(self, words: list[str]) -> list[list[int]]:
        """The ids of each word."""
        out: list[list[int]] = [[] for _ in words]
        sized: dict[int, list[int]] = {}
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        for k, w in enumerate(raw):
            if len(w) > BATCHED:
                ids = self.inner[list(w)]
                ids[-1] = self.final[w[-1]]
                out[k] = self._one(ids[ids >= 0].tolist())
            elif w:
                sized.setdefault(max(2, 1 << (len(w) - 1).bit_length()), []).append(k)
        for width, some in sized.items():
            for i in range(0, len(some), 8192):
                part = some[i : i + 8192]
                letters = np.frombuffer(b"".join([raw[k] for k in part]), dtype=np.uint8)
                lens = np.array([len(raw[k]) for k in part])
                last = np.cumsum(lens) - 1
                flat = self.inner[letters]
                flat[last] = self.final[letters[last]]
                if (flat < 0).any():  # bytes without a symbol of their own are left out
                    lens = np.add.reduceat(flat >= 0, last - lens + 1)
                    flat = flat[flat >= 0]
                for k, ids in zip(part, self._many(flat, lens, width), strict=True):
                    out[k] = ids
        return out

    def learn(self, words: set[str]) -> dict[str, tuple[int, str, str]]:
        """Number of ids, ids and tokens of words; what was encoded before is remembered."""
        if len(self.known) + len(words) > REMEMBERED:
            self.known = {}
        new = [w for w in words if w not in self.known]
        for w, ids in zip(new, self.words([w for w in new]), strict=True):
            self.known[w] = (len(ids), " ".join(map(str, ids)), " ".join(self.tokens[i] for i in ids))
        return self.known

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text."""
        parts = self.parts(text)
        plain = list({p for p in parts if p not in self.special})
        ids = dict(zip(plain, self.words(plain), strict=True)) | {t: [i] for t, i in self.special.items()}
        return [i for p in parts for i in ids[p]]

    def decode(self, ids: list[int]) -> str:
        """The tokens of known ids, joined by spaces, as a definition without a decoder does."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


def definition(spark: SparkSession, path: str) -> str:
    """The tokenizer's definition; the file is read on the driver, its size is fixed."""
    with open(path, encoding="utf-8") as f:
        return f.read()


_OPEN: dict[str, Bpe] = {}


def _tokenizer(text: str) -> Bpe:
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _OPEN:
        _OPEN[key] = Bpe(text)
    return _OPEN[key]


def _joined(parts: list[str], bpe: Bpe, texts: bool):
    known = bpe.known
    n = 0
    ids: list[str] = []
    tokens: list[str] = []
    for p in parts:
        if p in bpe.special:
            m, i, t = 1, str(bpe.special[p]), p
        else:
            m, i, t = known[p]
        if m:
            n += m
            ids.append(i)
            tokens.append(t)
    return n, " ".join(ids), " ".join(tokens)


def _spelled(docs: DataFrame, spec: str, digest: bool) -> DataFrame:
    ship(docs.sparkSession)
    ctx = docs.sparkSession.sparkContext
    shared = ctx.broadcast(spec)  # a vocabulary file, of fixed size
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _tokenizer(shared.value)
        try:
            yield from encoded(bpe, batches)
        finally:
            bpe.known = {}  # the worker lives on, and may never encode again

    def encoded(bpe: Bpe, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                b = whole.slice(i, 256)
                split = [bpe.parts(t.as_py() or "") for t in b.column(1)]
                fresh: set[str] = set()
                for parts in split:
                    fresh.update(parts)
                bpe.learn(fresh - bpe.special.keys())
                rows = [_joined(parts, bpe, True) for parts in split]
                if digest:
                    cols = [pa.array([sha(r[k]) for r in rows], pa.string()) for k in (1, 2)]
                else:
                    cols = [
                        pa.array([[int(x) for x in r[1].split()] for r in rows], pa.list_(pa.int32())),
                        pa.array([r[2] for r in rows], pa.string()),
                    ]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in rows], pa.int64()), *cols], names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["doc_id", "n_tokens", "ids", "decoded"]
    kinds = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "doc_id long, n_tokens long, ids array<int>, decoded string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(released(run), kinds)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every whole text, one row per input row.

    Null and empty texts have no ids and an empty decoding. Special tokens in a text are
    recognised in their exact spelling before normalisation. Columns besides doc_id and text are
    ignored; an empty table gives no rows.
    """
    return _spelled(docs, definition(docs.sparkSession, path), digest=False)


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): ``encode_documents`` with digests of both lists."""
    return _spelled(docs, definition(docs.sparkSession, path), digest=True)
