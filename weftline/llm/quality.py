"""Document quality by a byte-level convolutional network in numpy.

Bytes pass learned filters (an embedding folded into one table a filter offset), a rectifier and
the maximum over overlapping chunks that cover the whole document; the mean and the maximum of the
chunk values are combined into one probability. The network is fitted on a bounded sample of
labelled rows and scores every whole text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.memory import released
from weftline.session import ship

#: Bytes a chunk is long, and how far the next one begins: each byte lies in two chunks.
CHUNK, STRIDE = 256, 128
FILTERS, WIDTH = 8, 4
#: Bound of the labelled sample: rows, and bytes of their whole texts together.
SAMPLE_ROWS, SAMPLE_BYTES = 1500, 1 << 26
THRESHOLD = 0.3


class ByteNet:
    """tables[k, byte] is what a byte at offset k adds to each filter."""

    def __init__(self, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.tables = rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = rng.normal(0, 0.3, 2 * FILTERS).astype(np.float32)
        self.base = np.float32(0)
        self.shift = 0.0
        self.ready()

    def _responses(self, raw: np.ndarray) -> np.ndarray:
        n = len(raw) - WIDTH + 1
        x = self.tables[0][raw[:n]]
        for k in range(1, WIDTH):
            x += self.tables[k][raw[k : k + n]]
        return x

    @staticmethod
    def padded(text: bytes) -> np.ndarray:
        """The bytes, made as long as the filter at least."""
        return np.frombuffer(text + bytes(max(0, WIDTH - len(text))), dtype=np.uint8)

    def pooled(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chunk values (chunks by filters) and the position of each maximum."""
        values, places = [], []
        for start in range(0, max(1, len(raw) - WIDTH + 1), 64 * STRIDE):
            x = self._responses(raw[start : start + 64 * STRIDE + WIDTH - 1])
            for a in range(0, len(x), STRIDE):
                part = x[a : a + STRIDE]
                at = part.argmax(axis=0)
                values.append(part[at, np.arange(FILTERS)])
                places.append(at + a + start)
        v, p = np.array(values), np.array(places)
        if len(v) > 1:  # a chunk is two neighbouring strides
            second = v[1:] > v[:-1]
            v, p = np.where(second, v[1:], v[:-1]), np.where(second, p[1:], p[:-1])
        return v, p

    def ready(self) -> ByteNet:
        """Folds the tables of neighbouring offsets into tables of byte pairs, for scoring."""
        t = self.tables
        self.wide = [(t[k][:, None, :] + t[k + 1][None, :, :]).reshape(65536, FILTERS) for k in range(0, WIDTH, 2)]
        return self

    def chunk_values(self, raw: np.ndarray) -> np.ndarray:
        """Chunk values alone, in bounded pieces of the text."""
        n = len(raw) - WIDTH + 1
        parts = []
        for start in range(0, n, 128 * STRIDE):
            own = raw[start : start + 128 * STRIDE + WIDTH - 1]
            pair = own[:-1].astype(np.intp)
            pair <<= 8
            pair |= own[1:]
            m = len(own) - WIDTH + 1
            x = self.wide[0].take(pair[:m], axis=0, mode="clip")
            for k in range(1, WIDTH // 2):
                x += self.wide[k].take(pair[2 * k : 2 * k + m], axis=0, mode="clip")
            whole = m // STRIDE * STRIDE
            if whole:
                y, size = x[:whole], STRIDE
                while size > 1:  # halves against halves
                    y = y.reshape(-1, 2, FILTERS)
                    y = np.maximum(y[:, 0], y[:, 1])
                    size //= 2
                parts.append(y)
            if whole < m:
                parts.append(x[whole:].max(axis=0)[None])
        v = np.concatenate(parts)
        return np.maximum(v[1:], v[:-1]) if len(v) > 1 else v

    def score(self, text: bytes) -> float:
        v = np.maximum(self.chunk_values(self.padded(text)) + self.bias, 0)
        z = float(np.concatenate([v.mean(axis=0), v.max(axis=0)]) @ self.out + self.base) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def fit(self, texts: list[bytes], labels: list[int], epochs: int = 6, rate: float = 0.02, seed: int = 2) -> ByteNet:
        """Adam on the cross-entropy; gradients reach the filters through the maxima alone."""
        if not texts or len(set(labels)) < 2:
            self.base = np.float32(4 if not labels or labels[0] else -4)
            self.out[:] = 0
            return self.ready()
        rng = np.random.default_rng(seed)
        raws = [self.padded(t) for t in texts]
        y = np.array(labels, np.float64)
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
        state = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self._parts().items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(raws))
            for s in range(0, len(order), 24):
                batch = order[s : s + 24]
                grads = {k: np.zeros_like(v) for k, v in self._parts().items()}
                for i in batch:
                    v, p = self.pooled(raws[i])
                    pre = v + self.bias
                    act = np.maximum(pre, 0)
                    top = act.argmax(axis=0)
                    features = np.concatenate([act.mean(axis=0), act.max(axis=0)])
                    z = float(features @ self.out + self.base)
                    d = np.float32((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i]) * weight[i] / len(batch))
                    grads["out"] += d * features
                    grads["base"] += d
                    back = np.tile(d * self.out[:FILTERS] / len(v), (len(v), 1))
                    back[top, np.arange(FILTERS)] += d * self.out[FILTERS:]
                    back *= pre > 0
                    grads["bias"] += back.sum(axis=0)
                    cols = np.broadcast_to(np.arange(FILTERS), p.shape)
                    for k in range(WIDTH):
                        np.add.at(grads["tables"][k], (raws[i][p + k], cols), back)
                step += 1
                for k, v in self._parts().items():
                    m, q = state[k]
                    m += 0.1 * (grads[k] - m)
                    q += 0.01 * (grads[k] ** 2 - q)
                    v -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
                self.base = self._base[0]
        return self.ready()

    def _parts(self) -> dict[str, np.ndarray]:
        if not hasattr(self, "_base") or self._base[0] != self.base:
            self._base = np.array([self.base], np.float32)
        return {"tables": self.tables, "bias": self.bias, "out": self.out, "base": self._base}


def _utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept from fitting: crc32 of the id as text is a multiple of 5; a null id is."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> ByteNet:
    """Fits on the whole texts of at most ``rows`` labelled documents outside the held-out part.

    Rows are taken in order of a hash of the id, as long as their texts have no more than ``sample_bytes``
    together. Each label has half of both bounds, and scores are moved to the shares of the labels outside
    the held-out part. Null labels are skipped, repeated ids count once; without labels of both kinds the
    score is constant.
    """
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    halves = [known.where(F.col("quality") == q).orderBy(*order).limit(rows // 2) for q in (0, 1)]
    chosen = halves[0].unionByName(halves[1])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.col("text").cast("string"), "UTF-8").alias("raw"))
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("raw").alias("raw"), F.min("quality").alias("quality"))
    queue = W.partitionBy("quality").orderBy(*order)  # of at most half of the rows
    found = found.withColumn("bytes", F.sum(F.coalesce(F.octet_length("raw"), F.lit(0))).over(queue)).where(F.col("bytes") <= sample_bytes // 2)
    share = {r.quality: r["count"] for r in known.groupBy("quality").count().collect()}  # two rows at most
    sample = sorted((r.doc_id, bytes(r.raw or b""), r.quality) for r in found.collect())  # bounded by rows and sample_bytes
    net = ByteNet().fit([r[1] for r in sample], [r[2] for r in sample])
    if len(share) == 2:  # from the halves of the sample to the shares among all labels
        net.shift = math.log(share[1] / share[0])
    return net


def scores(docs: DataFrame, net: ByteNet, column: str = "text") -> DataFrame:
    """(doc_id, score) of every row; null and empty texts have a score too."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a network of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([own.score(_utf8(t.as_py())) for t in b.column(1)], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("string").alias("text")).mapInArrow(released(run), "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted): quality of every document; predicted is 1 at a score of ``threshold`` or more.

    Only the text is an input of the score. Repeated rows stay, an empty table gives no rows, a
    null doc_id counts as held out. Columns besides doc_id and text are ignored.
    """
    out = scores(docs, train(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with all their columns.

    Null and empty texts are scored as empty ones, repeated rows stay or go together, columns besides text
    are neither read nor changed, and an empty table gives no rows.
    """
    net = train(docs, labels)
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            texts = b.column(at).cast(pa.string())
            yield b.filter(pa.array([own.score(_utf8(t.as_py())) >= threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(released(run), docs.schema)
