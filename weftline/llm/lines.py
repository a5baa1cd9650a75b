"""Fuzzy line deduplication by MinHash.

Lines are compared as sets of character shingles of their normalised form. Equal lines are brought
together first, and one table, bucketed by line, holds the text of each once. Each distinct line gets
a one-permutation MinHash signature (two independent hash functions, their bins densified by
rotation), or, where its shingles are too few for the bins, a MinHash of one function for each row;
lines between both kinds have both. Signatures are cut into high-recall bands, whose values are
exchanged as packed runs of numbers; lines that share a band value form a bucket. Inside a bucket
every link is verified by exact Jaccard similarity of the shingle sets, and only a spanning forest of
the links leaves it. Buckets with the same members are compared once. A bucket beyond the limit is
cut into blocks: each is compared with itself and with the first, and lines which that leaves outside
the component of the first block are compared with all others. Components come from distributed
union-find, and of each component the first line, by document and line number, stays.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.memory import released
from weftline.llm.rows import field, packed, unpacked
from weftline.operators.components import connected_components
from weftline.session import Scratch, ship

#: Characters in a shingle, and least similarity of linked lines.
SHINGLE, SIMILARITY = 5, 0.8
#: Bands and rows in a band: a pair at 0.8 shares a band with probability 0.994, at 0.85 with 0.999.
BANDS, ROWS = 13, 5
#: Lines of fewer distinct shingles have no one-permutation signature: their bins would be empty and copy one another.
FEW = 80
#: Most lines of a bucket that are compared at once.
BLOCK = 1024
#: Places of a line in a batch that stand in the line's own row; the others go in rows dealt apart from it.
INLINE = 16
#: Bytes of text whose lines are brought together before the exchange.
SPLIT_CHARS = 1 << 23
#: Band values that are sorted at once, 16 bytes each with their line and its sketch.
RUN = 1 << 21
#: Most bits in which the sketches of two lines, 32 rows at a bit each, differ for them to be compared: more have a pair at 0.8 with probability 0.0002.
SKETCH_BITS = 10
#: Bits of the map that counts distinct shingles from below.
_MAP = 512
_FUNCTIONS = 2
_GOLD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_TIMES = np.array([xxhash.xxh64_intdigest(bytes([k]), seed=11) | 1 for k in range(BANDS * ROWS)], np.uint64)
_PLUS = np.array([xxhash.xxh64_intdigest(bytes([k]), seed=12) for k in range(BANDS * ROWS)], np.uint64)
_FACTORS = (np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25))


def normalised(line: str) -> str:
    """Lower case, runs of white space as one space."""
    return " ".join(line.lower().split())


def _mixed(x: np.ndarray, by: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * (_GOLD + np.uint64(2 * by))
    return x ^ (x >> np.uint64(32))


def shingles(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all lines in one array, and where each line's begin.

    A line of fewer characters than a shingle is one shingle.
    """
    lens = np.array([len(x) for x in lines], dtype=np.int64)
    code = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    n = np.maximum(lens - SHINGLE + 1, 1)
    begin = np.cumsum(n) - n
    padded = np.concatenate([code, np.zeros(SHINGLE, np.uint64)])
    h = padded[: len(code) + 1].copy()
    for k in range(1, SHINGLE):
        h *= _GOLD
        h += padded[k : k + len(h)]
    h ^= h >> np.uint64(31)
    first = np.cumsum(lens) - lens
    at = np.repeat(first - begin, n) + np.arange(n.sum())
    out = h[at]
    for i in np.flatnonzero(lens < SHINGLE).tolist():  # the text after a short line is none of its own
        out[begin[i]] = xxhash.xxh64_intdigest(lines[i].encode("utf-8", "surrogatepass"))
    return out, begin


def _densified(low: np.ndarray) -> np.ndarray:
    """Each empty bin takes the value of the next full one, marked with the distance."""
    out, empty, step = low.copy(), low == 1 << 40, 0
    while empty.any():
        step += 1
        take = np.roll(low, -step, axis=1)
        fill = empty & (take < 1 << 40)
        out[fill] = take[fill] + (step << 41)
        empty &= ~fill
    return out


def signatures(lines: list[str]) -> np.ndarray:
    """Band values of each line, as signed 64-bit numbers in an array of lines by bands."""
    return _binned(*shingles(lines))[0]


def _bits(rows: np.ndarray) -> np.ndarray:
    """A sketch of each line: one bit of each of 32 rows of its signature, an array of lines by rows."""
    return np.packbits((rows * _GOLD).view(np.int64) < 0, axis=1).view(np.uint32)[:, 0]


def _binned(h: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band values and sketches by two functions of bins."""
    n = len(begin)
    line = np.repeat(np.arange(n, dtype=np.uint64), np.diff(np.r_[begin, len(h)]))
    total, parts = BANDS * ROWS, []
    for f in range(_FUNCTIONS):
        bins = total // _FUNCTIONS + (f < total % _FUNCTIONS)
        x = h * _FACTORS[f]
        x ^= x >> np.uint64(33)
        x *= _MIX
        slot = x >> np.uint64(40)
        slot *= np.uint64(bins)
        slot >>= np.uint64(24)
        slot += line * np.uint64(bins)
        x &= np.uint64((1 << 40) - 1)
        low = np.full(n * bins, 1 << 40, dtype=np.int64)
        np.minimum.at(low, slot.view(np.int64), x.view(np.int64))
        low = low.reshape(n, bins)
        some = np.flatnonzero((low == 1 << 40).any(axis=1))
        low[some] = _densified(low[some])
        parts.append(low)
    sig = np.concatenate(parts, axis=1).astype(np.uint64)
    order = np.arange(total).reshape(ROWS, BANDS).T  # a band takes bins far from one another
    key = np.zeros((n, BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        key = _mixed(key * _GOLD + sig[:, order[:, r]], r + 1)
    return key.view(np.int64), _bits(sig[:, 1::2])


def full_signatures(h: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band values and sketches of lines by the least of their shingle hashes under BANDS * ROWS functions; other values than those of ``signatures``."""
    key = np.zeros((len(begin), BANDS), np.uint64) + np.arange(BANDS, 2 * BANDS, dtype=np.uint64)
    if not len(begin):
        return key.view(np.int64), np.zeros(0, np.uint32)
    h = _mixed(h, 0)
    x = np.empty_like(h)
    some = np.empty((len(begin), 32), np.uint64)
    for r in range(ROWS):
        low = np.empty((len(begin), BANDS), np.uint64)
        for b in range(BANDS):
            np.multiply(h, _TIMES[r * BANDS + b], out=x)
            x += _PLUS[r * BANDS + b]
            low[:, b] = np.minimum.reduceat(x, begin)
        some[:, 6 * r : 6 * r + 6] = low[:, 1 : 2 * min(6, 32 - 6 * r) + 1 : 2]
        key = _mixed(key * _GOLD + low, r + 1)
    return key.view(np.int64), _bits(some)


def _distinct_sizes(h: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Distinct shingles of each line, exact where it matters for the kind of its signature.

    The bits that some of a line's shingles set in a small map are no more than its distinct shingles, so only
    lines whose map leaves the question open are sorted.
    """
    out, at = sizes.copy(), np.flatnonzero(sizes >= FEW)
    if not len(at):
        return out
    n = np.minimum(sizes[at], _MAP // 2)
    first = np.cumsum(n) - n
    bits = np.zeros(len(at) * _MAP, bool)
    part = h[np.repeat(begin[at] - first, n) + np.arange(n.sum())]
    bits[np.repeat(np.arange(len(at), dtype=np.int64) * _MAP, n) + ((part >> np.uint64(40)).view(np.int64) & (_MAP - 1))] = True
    seen = np.count_nonzero(bits.reshape(-1, _MAP), axis=1)
    for i in at[seen * SIMILARITY <= FEW].tolist():
        own = np.sort(h[begin[i] : begin[i] + sizes[i]])
        out[i] = 1 + np.count_nonzero(own[1:] != own[:-1])
    return out


def line_bands(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Band values of all lines in one array, the sketch of the same signature beside each, and how many each line has.

    Lines of fewer than FEW distinct shingles have the full signature and the others the one-permutation one.
    Lines that can be SIMILARITY like both kinds have both, so that each pair at it meets under one kind.
    """
    h, begin = shingles(lines)
    lens = np.diff(np.r_[begin, len(h)])
    sizes = _distinct_sizes(h, begin, lens)
    full, many = np.flatnonzero(sizes * SIMILARITY <= FEW), np.flatnonzero(sizes >= FEW)
    counts = np.zeros(len(lines), np.int64)
    counts[full] += BANDS
    counts[many] += BANDS
    ends = np.cumsum(counts)
    out, sketches = np.empty(counts.sum(), np.int64), np.empty(counts.sum(), np.uint32)
    step = np.arange(BANDS)
    for which, at, made in ((full, ends - counts, full_signatures), (many, ends - BANDS, _binned)):
        if len(which):
            place = at[which][:, None] + step
            keys, bits = made(*_taken(h, begin, lens, which))
            out[place] = keys
            sketches[place] = bits[:, None]
    return out, sketches, counts


def _taken(h: np.ndarray, begin: np.ndarray, lens: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of some lines alone, and where each line's begin."""
    if len(at) == len(lens):
        return h, begin
    n = lens[at]
    first = np.cumsum(n) - n
    return h[np.repeat(begin[at] - first, n) + np.arange(n.sum())], first


def _digest(line: str) -> bytes:
    return xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"))


def _parts(lines: Iterable[str], limit: int = 250_000) -> Iterator[list[str]]:
    part, size = [], 0
    for line in lines:
        part.append(line)
        size += len(line)
        if size >= limit:
            yield part
            part, size = [], 0
    if part:
        yield part


_PLACE = "struct<doc_id:long,row_key:long,line_no:int>"
_SPLIT = f"line binary, text string, n long, first {_PLACE}, places array<{_PLACE}>"


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _SPLIT: the distinct lines of a batch of (doc_id, row_key, text), each with its number of places, the first place, and the first INLINE ones if there are several.

    Places beyond INLINE follow in rows without a text and with n = 0. Places are in order: null ids first, then by id, key and number.
    A batch with more than SPLIT_CHARS of text is taken in pieces, so that its lines are never all at hand.
    """
    for batch in batches:
        lens = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy()
        piece = np.cumsum(lens, dtype=np.int64) // SPLIT_CHARS
        cuts = np.r_[0, np.flatnonzero(piece[1:] != piece[:-1]) + 1, len(lens)].tolist()
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield from _lines_of(batch.slice(a, b - a))


def _lines_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    found: dict[str, int] = {}
    line_at, doc_at, no_at = [], [], []
    for doc, text in enumerate(batch.column(2)):
        text = text.as_py()
        for no, line in enumerate(text.lower().split("\n") if text else ()):
            if line := " ".join(line.split()):
                line_at.append(found.setdefault(line, len(found)))
                doc_at.append(doc)
                no_at.append(no)
    if not found:
        return
    ids = batch.column(0)
    null, doc_id, key = (np.asarray(x) for x in (ids.is_null(), ids.fill_null(0), batch.column(1)))
    place = np.lexsort((key, doc_id, ~null))
    rank = np.empty(len(place), np.int64)
    rank[place] = np.arange(len(place))
    line, doc, no = (np.array(x, np.int64) for x in (line_at, doc_at, no_at))
    order = np.argsort((line * len(place) + rank[doc]), kind="stable")  # numbers of a document already ascend
    line, doc, no = line[order], doc[order], no[order]
    counts = np.bincount(line, minlength=len(found))
    at_first = np.cumsum(counts) - counts
    nth = np.arange(len(line)) - np.repeat(at_first, counts)
    far = np.flatnonzero(nth >= INLINE)
    row = line[far] * (len(line) + 1) + nth[far] // INLINE  # a row for INLINE places more
    more = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    several = np.repeat(counts > 1, counts)  # a single place is the first one
    extra = line[far][more]

    def struct(at: np.ndarray) -> pa.StructArray:
        return pa.StructArray.from_arrays([pa.array(doc_id[doc[at]], mask=null[doc[at]]), pa.array(key[doc[at]]), pa.array(no[at].astype(np.int32))], ["doc_id", "row_key", "line_no"])

    def rows(digests: pa.Array, texts: pa.Array, n: np.ndarray, first: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), struct(at))
        return pa.RecordBatch.from_arrays([digests, texts, pa.array(n), struct(first), lists], ["line", "text", "n", "first", "places"])

    digests = pa.array([_digest(x) for x in found], pa.binary())
    out = rows(digests, pa.array(list(found), pa.string()), counts, at_first, np.flatnonzero(several & (nth < INLINE)), np.where(counts > 1, np.minimum(counts, INLINE), 0))
    found.clear()
    for start in range(0, out.num_rows, 8192):
        yield out.slice(start, 8192)
    if len(extra):
        yield rows(digests.take(pa.array(extra)), pa.nulls(len(extra), pa.string()), np.zeros(len(extra), np.int64), far[more], far, np.diff(np.r_[more, len(far)]))


def line_table(own: DataFrame, scratch: Scratch) -> DataFrame:
    """(slot, row, line, text, n, first, places) of the lines of ``own(doc_id, row_key, text)``, bucketed by slot.

    slot is xxhash64 of the line's digest, row a number of the row. A line has a row for each batch that holds it, with its
    text, the number of its places there, the first of them, and no more than INLINE of them. Places beyond that
    are in rows without a text, dealt over all slots, so that no slot holds all places of a line that stands everywhere.
    """
    n = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slot = F.when(F.col("n") == 0, F.xxhash64("line", "first.doc_id", "first.row_key", "first.line_no")).otherwise(F.xxhash64("line"))
    rows = own.mapInArrow(released(_split), _SPLIT).select(slot.alias("slot"), F.monotonically_increasing_id().alias("row"), "line", "text", "n", "first", "places")
    return scratch.save_bucketed(rows.repartition(n, "slot"), "slot", n)


def _on_slot(few: DataFrame, many: DataFrame, also: str, how: str = "inner") -> DataFrame:
    """Joins on slot and on the column ``also``, where ``many`` or both are bucketed by slot.

    Only slot is a join key, as the buckets do not know the other one; an order of two equals is no key to
    Catalyst. ``few`` is hashed, ``many`` streams without an exchange or a sort.
    """
    other = few.withColumnsRenamed({"slot": "__slot", also: "__also"}).hint("shuffle_hash")
    same = (F.col("slot") == F.col("__slot")) & (F.least(F.col(also), F.col("__also")) == F.greatest(F.col(also), F.col("__also")))
    return many.join(other, same, how).drop("__slot", "__also")


def _heads(lines: DataFrame) -> DataFrame:
    """(slot, line, row, total): each line of a ``line_table`` once, with the row whose text stands for all, and its places in all."""
    return lines.where("n > 0").groupBy("slot", "line").agg(F.min("row").alias("row"), F.sum("n").alias("total"))


#: Band values, lines and sketches of a part of the index, packed.
_PACKED = "part long, keys binary, slots binary, sketches binary"


def _packed(bits: int):
    """(slot, text) -> _PACKED: a part is the first bits of a band value, keys are the next 32, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        slots: list[np.ndarray] = []
        marks: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            key = np.concatenate(keys).view(np.uint64)
            order = np.argsort(key)
            key = key[order]
            part = (key >> np.uint64(64 - bits)).view(np.int64)
            first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            ends = np.r_[first, len(key)].astype(np.int32)
            short = (key >> np.uint64(32 - bits)).astype(np.uint32)
            columns = (short, np.concatenate(slots)[order], np.concatenate(marks)[order])
            packed = [pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends * np.int32(x.itemsize)), pa.py_buffer(x)]) for x in columns]
            for held in (keys, slots, marks):
                held.clear()
            return pa.RecordBatch.from_arrays([pa.array(part[first]), *packed], ["part", "keys", "slots", "sketches"])

        for batch in batches:
            at, own = 0, batch.column(0).to_numpy()
            for lines in _parts(batch.column(1).to_pylist()):
                bands, sketches, counts = line_bands(lines)
                keys.append(bands)
                slots.append(np.repeat(own[at : at + len(lines)], counts))
                marks.append(sketches)
                at += len(lines)
                size += len(bands)
                if size >= RUN:
                    yield out()
                    size = 0
        if size:
            yield out()

    return run


_MEMBERS = "key long, block int, slot long"


def _near(marks: np.ndarray) -> np.ndarray:
    """Which of some sketches have another one near."""
    far = np.bitwise_count(marks[:, None] ^ marks[None, :]) > SKETCH_BITS
    return (~far).sum(axis=1) > 1


def _buckets(limit: int, run_size: int = RUN):
    """_PACKED sorted by part -> (key, block, slot) of buckets with two lines or more.

    Lines whose sketch is near no other one leave a bucket. A bucket within the limit is renamed after its
    members, so that equal ones fall together. A part with more values than a run is taken run by run; its
    buckets are given whole, those of one line too, with blocks numbered on.
    """

    def members(part: int, short: np.ndarray, slots: np.ndarray, marks: np.ndarray, run: int | None) -> pa.RecordBatch:
        if run is None:  # a key alone between two others has no bucket; most are
            order = np.argsort(short)
            key = short[order]
            same = key[1:] == key[:-1]
            multi = order[np.r_[same, False] | np.r_[False, same]]
            short, slots, marks = short[multi], slots[multi], marks[multi]
        order = np.lexsort((slots, short))
        short, slot, mark = short[order], slots[order], marks[order]
        some = np.ones(len(short), bool)
        some[1:] = (short[1:] != short[:-1]) | (slot[1:] != slot[:-1])
        key, slot, mark = short[some].astype(np.int64) + (part << 32), slot[some], mark[some]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[first, len(key)])
        block = np.zeros(len(key), np.int32)
        kept = np.ones(len(key), bool)
        name = key.copy()
        if run is not None:
            at = np.arange(len(key)) - np.repeat(first, sizes)
            block = (at // limit + run * (run_size // limit + 1)).astype(np.int32)
        else:
            twos = first[sizes == 2]
            close = np.bitwise_count(mark[twos] ^ mark[twos + 1]) <= SKETCH_BITS
            kept[twos], kept[twos + 1] = close, close
            kept[first[sizes == 1]] = False
            for a, n in zip(first[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                if n > limit:
                    block[a : a + n] = np.arange(n) // limit
                else:
                    kept[a : a + n] = _near(mark[a : a + n])
            full = np.add.reduceat(kept, first) if len(first) else first
            for a, n in zip(first[full > 0].tolist(), sizes[full > 0].tolist(), strict=True):
                if n <= limit:
                    own = slot[a : a + n][kept[a : a + n]]
                    name[a : a + n] = -1 - (xxhash.xxh64_intdigest(own.tobytes()) >> 1)
        return pa.RecordBatch.from_arrays([pa.array(name[kept]), pa.array(block[kept]), pa.array(slot[kept])], ["key", "block", "slot"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size, runs = None, [], 0, 0

        def taken(last: bool) -> pa.RecordBatch:
            columns = [np.concatenate([np.frombuffer(r[k], t) for r in held]) for k, t in enumerate((np.uint32, np.int64, np.uint32))]
            held.clear()
            return members(part, *columns, None if last and not runs else runs)

        for batch in batches:
            for p, *row in zip(batch.column(0).to_pylist(), *(batch.column(k) for k in (1, 2, 3)), strict=True):
                if held and p != part:
                    yield taken(True)
                if p != part:
                    part, size, runs = p, 0, 0
                row = [x.as_buffer() for x in row]
                if held and size + row[0].size // 4 > run_size:
                    yield taken(False)
                    size, runs = 0, runs + 1
                held.append(row)
                size += row[0].size // 4
        if held:
            yield taken(True)

    return run


def verified_forest(lines: list[str], similarity: float, cut: int | None = None) -> list[tuple[int, int]]:
    """Spanning forest of the links at ``similarity`` or more between lines, as pairs of positions.

    With ``cut``, only links between the first ``cut`` lines and the others are needed.
    """
    sets = _sorted_sets(lines)
    size = np.array([len(x) for x in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.cumsum(size) - size
    mark = np.zeros(ids.max() + 1, np.int32)
    rest = np.arange(len(lines))
    flat, first = ids, begin
    out: list[tuple[int, int]] = []
    queue: list[int] = []
    live = np.ones(len(lines), bool)
    held = rest
    while True:
        if not queue:
            left = held[live[held]]
            if len(left) < 2:
                return out
            queue = [int(left[0])]
            live[left[0]] = False
        if live[held].sum() < 0.7 * len(held):
            held = held[live[held]]
            if not len(held):
                return out
            flat = np.concatenate([ids[begin[i] : begin[i] + size[i]] for i in held.tolist()])
            first = np.cumsum(size[held]) - size[held]
        x = queue.pop()
        own = ids[begin[x] : begin[x] + size[x]]
        mark[own] = 1
        both = np.add.reduceat(mark[flat], first)
        mark[own] = 0
        near = live[held] & (both >= similarity * (size[held] + size[x] - both) - 1e-9)
        if cut is not None:
            near &= (held < cut) != (x < cut)
        for y in held[near].tolist():
            out.append((x, y))
            queue.append(y)
            live[y] = False


def _sorted_sets(lines: list[str]) -> list[np.ndarray]:
    """The distinct shingle hashes of each line, in order."""
    h, begin = shingles(lines)
    for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(h)], strict=True):
        h[a:b].sort()
    new = np.r_[True, h[1:] != h[:-1]]
    new[begin] = True
    return np.split(h[new], np.cumsum(np.add.reduceat(new, begin, dtype=np.int64))[:-1])


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    both = np.concatenate((a, b))
    both.sort()
    return int(np.count_nonzero(both[1:] == both[:-1]))


def _small_forest(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """The same for a few lines, by their sorted sets."""
    out: list[tuple[int, int]] = []
    rest = list(range(len(sets)))
    while len(rest) > 1:
        queue = [rest.pop(0)]
        while queue and rest:
            x = queue.pop()
            own, far = sets[x], []
            for y in rest:
                other = sets[y]
                low, high = sorted((len(own), len(other)))
                if low >= similarity * high - 1e-9 and (both := _shared(own, other)) >= similarity * (low + high - both) - 1e-9:
                    out.append((x, y))
                    queue.append(y)
                else:
                    far.append(y)
            rest = far
    return out


def _links(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[tuple, list]] = []
        size = 0

        def out() -> pa.RecordBatch:
            few = [own for key, own in done if key[1] == key[2] and len(own) <= 12]
            found = _sorted_sets([x[2] for own in few for x in own]) if few else []
            a, b, at = [], [], 0
            for own in few:
                sets = found[at : at + len(own)]
                at += len(own)
                for x, y in _small_forest(sets, similarity):
                    a.append(own[x][0])
                    b.append(own[y][0])
            for key, own in done:
                if key[1] == key[2] and len(own) <= 12:
                    continue
                cut = sum(x[1] == key[1] for x in own) if key[1] != key[2] else None
                for x, y in verified_forest([x[2] for x in own], similarity, cut):
                    a.append(own[x][0])
                    b.append(own[y][0])
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

        key, own = None, []
        for batch in batches:
            for k, lo, hi, block, line, text in zip(*(batch.column(j).to_pylist() for j in range(6)), strict=True):
                if (k, lo, hi) != key:
                    if len(own) > 1:
                        done.append((key, own))
                        size += len(own)
                    if size >= 1000:
                        yield out()
                        size = 0
                    key, own = (k, lo, hi), []
                if own and own[-1][0] == line:  # another batch held the line too
                    continue
                own.append((line, block, text))
        if len(own) > 1:
            done.append((key, own))
        yield out()

    return run


def _pair_groups(members: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(key, lo, hi, block, slot): what is compared first; and the members of buckets of several blocks, if any.

    Each block meets itself, and in buckets of several blocks each meets the least one.
    """
    hot = members.where("block > 0").select("key").distinct()
    own = members.select("key", F.col("block").alias("lo"), F.col("block").alias("hi"), "block", "slot")
    if hot.isEmpty():
        return own, None
    many = members.join(hot, "key")
    blocks = many.groupBy("key").agg(F.min("block").alias("base"), F.max("block").alias("last")).where("last > base").drop("last")
    many = many.join(blocks, "key")
    others = many.where("block > base").select("key", "base", F.col("block").alias("hi")).distinct()
    with_base = many.where("block = base").join(others, ["key", "base"])
    cross = many.where("block > base").select("key", F.col("base").alias("lo"), F.col("block").alias("hi"), "block", "slot")
    return own.unionByName(cross).unionByName(with_base.select("key", F.col("base").alias("lo"), "hi", "block", "slot")), many


def _rest_groups(many: DataFrame, found: DataFrame, scratch: Scratch, block: int) -> DataFrame:
    """The comparisons that the first ones leave open in buckets of several blocks.

    Lines beyond the least block that are in the component of its first line need no more comparison with one another; each of
    the rest is compared with all lines beyond the least block. Blocks of the rest have negative numbers.
    """
    comp = connected_components(found.select("a", "b"), scratch).select(F.xxhash64("node").alias("slot"), "component")
    placed = scratch.save(many.join(comp, "slot", "left").withColumn("in", F.coalesce(F.xxhash64("component"), F.col("slot"))))
    heart = placed.where("block = base").groupBy("key").agg(F.min_by("in", "slot").alias("heart"))
    outer = placed.where("block > base").join(heart, "key")
    number = W.partitionBy("key", "block").orderBy("slot")
    rest = outer.where(F.col("in") != F.col("heart")).withColumn("at", -1 - F.col("block") - F.floor((F.row_number().over(number) - 1) / block).cast("int"))
    rest = scratch.save(rest.select("key", "at", "slot").distinct())
    pairs = rest.select("key", "at").distinct().join(outer.select("key", "block").distinct(), "key")
    left = pairs.join(rest, ["key", "at"]).select("key", F.col("at").alias("lo"), F.col("block").alias("hi"), F.col("at").alias("block"), "slot")
    right = pairs.join(outer.select("key", "block", "slot"), ["key", "block"]).select("key", F.col("at").alias("lo"), F.col("block").alias("hi"), "block", "slot")
    return left.unionByName(right)


def line_links(lines: DataFrame, scratch: Scratch, similarity: float = SIMILARITY, block: int = BLOCK, run: int = RUN) -> DataFrame:
    """(a, b): verified links between the lines of a ``line_table``, by digest, that connect every linked pair."""
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = lines.where("n > 0")
    # parts of half a run in the mean, and several a partition
    parts = max(rows.count() * 2 * BANDS / run, 4 * n)
    members = (
        rows.select("slot", "text").mapInArrow(released(_packed(min(int(np.ceil(np.log2(parts))), 30))), _PACKED)
        .repartition(n, "part").sortWithinPartitions("part").mapInArrow(released(_buckets(block, run)), _MEMBERS).distinct()
    )
    members = scratch.save(members, dictionary=False)
    scratch.tidy()

    def verified(groups: DataFrame) -> DataFrame:
        named = groups.hint("shuffle_hash").join(_heads(lines).drop("total"), "slot")
        texts = _on_slot(named, rows.select("slot", "row", "text"), "row")
        dealt = texts.select("key", "lo", "hi", "block", "line", "text").repartition(n, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "block", "line")
        return dealt.mapInArrow(released(_links(similarity)), "a binary, b binary")

    groups, many = _pair_groups(members)
    found = scratch.save(verified(groups), dictionary=False)
    if many is None:
        return found
    return found.unionByName(scratch.save(verified(_rest_groups(many, found, scratch, block))))


def removed_lines(docs: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK, run: int = RUN) -> DataFrame:
    """(doc_id, row_key, removed): numbers, from 0, of the lines of a text that repeat an earlier line.

    row_key is xxhash64 of the text. Documents that lose no line have no row. Lines that are blank
    after normalisation never take part; texts that are null have no lines. The first line of a
    component, by doc_id (null first), row_key and number, stays. Rows that repeat both doc_id and
    text count as one document.
    """
    scratch = Scratch(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("row_key"), F.col("text").cast("string").alias("text"))
    ship(docs.sparkSession)
    lines = line_table(own, scratch)
    scratch.tidy()
    linked = line_links(lines, scratch, similarity, block, run)
    scratch.tidy()
    comp = connected_components(linked, scratch).select(F.xxhash64("node").alias("slot"), F.col("node").alias("line"), "component")
    # most lines stand once and are like no other; only the rest go on
    live = _on_slot(comp, _heads(lines).drop("row"), "line", "left").where("total > 1 or component is not null")
    live = live.select("slot", "line", F.coalesce("component", "line").alias("root"))
    rows = _on_slot(live, lines.where("n > 0").select("slot", "line", "first", "places"), "line")
    rows = scratch.save(rows.select("line", "root", "first", "places"))
    kept = rows.groupBy("root").agg(F.min("first").alias("kept"))
    far = lines.where("n = 0").select("line", "places").join(rows.select("line", "root").distinct(), "line").select("root", "places")
    places = F.when(F.size("places") > 0, F.col("places")).otherwise(F.array("first"))
    gone = rows.select("root", places.alias("places")).unionByName(far).join(kept, "root").select("kept", F.explode("places").alias("p")).where("p <> kept")
    return gone.groupBy("p.doc_id", "p.row_key").agg(F.array_sort(F.collect_set("p.line_no")).alias("removed"))


def _deduped(docs: DataFrame, similarity: float, block: int) -> DataFrame:
    """(row, kept, lost): each row with its text without repeated lines, and how many went."""
    gone = removed_lines(docs, similarity, block).select(F.col("doc_id").alias("id"), "row_key", "removed")
    text = field("text").cast("string")
    same = field("doc_id").cast("long").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("row_key"))
    joined = packed(docs).withColumn("text_key", F.xxhash64(text)).join(gone, same, "left")
    # the split text is bound once, and each line found by its number: linear in very long texts
    split = F.split(text, "\n", -1)
    numbers = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("removed"))
    kept = F.transform(F.array(split), lambda all_: F.array_join(F.transform(numbers, lambda i: F.get(all_, i)), "\n"))[0]
    return joined.select("row", F.when(F.col("removed").isNull(), text).otherwise(kept).alias("kept"), F.coalesce(F.size("removed"), F.lit(0)).alias("lost"))


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """``docs`` with two more columns: the text without repeated lines, and how many were removed.

    They are __kept_text (null for a null text) and __removed (int), in place of columns of these names. All rows
    and the other columns stay, whatever their names; an empty table gives no rows.
    """
    own = docs.drop("__kept_text", "__removed")
    return _deduped(own, similarity, block).select(*unpacked(own), F.col("kept").alias("__kept_text"), F.col("lost").alias("__removed"))


def kept_documents(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with deduplicated texts; n_chars, if there, follows. A document left without any line goes.

    Null, empty and blank texts lose nothing and stay, as do all columns; an empty table gives no rows.
    """
    out = _deduped(docs, similarity, BLOCK).where((F.col("lost") == 0) | (F.trim("kept") != ""))
    new = {"text": F.col("kept").cast(docs.schema["text"].dataType)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("lost") > 0, F.length("kept")).otherwise(field("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*unpacked(docs, new))
