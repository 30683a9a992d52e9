"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network in numpy.

A word's index vector is sparse and made from the word's hash.  The VOCABULARY most frequent words
of the corpus have a vector each: their index vector plus the mean of their neighbours' index
vectors over all documents.  Beside it every word has the vector of its shape (classes of its first
and last bytes, SHAPES buckets), made alike; a rarer word takes its shape's vector for its own.  A
document is the mean of its words' vectors, with a few counts; a two-layer network, fitted on at
most TRAIN_ROWS labelled rows (those whose ids hash lowest), gives a probability, whose temperature
is set on rows kept out of the fit.

Null and empty texts are scored as documents without words.  Rows without a label do not train;
with fewer than two classes the score is the share of label 1 (0.5 without rows).
Repeated documents each get their row, also those without doc_id, for which the query's `held_out`
is null; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .langid import remainder

VOCABULARY, SHAPES, DIM, ONES = 8192, 512, 32, 4
TRAIN_ROWS = 20_000
#: Words that a task counts before it hands its counts on.
COUNTED = 500_000
FEATURES = 2 * DIM + 3

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[0x41:0x5B], _CLASS[0x61:0x7B], _CLASS[0x30:0x3A], _CLASS[0x80:] = 65, 97, 48, 97


class Words(NamedTuple):
    """The words of a slice of texts."""

    hash: np.ndarray  # of the lower-cased word
    shape: np.ndarray  # bucket
    same: np.ndarray  # equal to the word before it
    size: np.ndarray  # bytes
    firsts: np.ndarray  # first word of each text, with an end


class Vectors(NamedTuple):
    """Known words (hashes, ascending) and the vectors of words, then shapes."""

    known: np.ndarray
    table: np.ndarray


def words(data: np.ndarray, offs: np.ndarray) -> Words:
    """Hash, shape bucket, repetition and size of each word."""
    starts, ends, firsts = W.spans(data, offs)
    h = W.hashes(W.LOWER[data], starts, ends)
    same = np.zeros(len(h), bool)
    if not len(h):
        return Words(h, np.empty(0, np.int64), same, ends - starts, firsts)
    c = _CLASS[data].astype(np.uint64)
    last = ends - 1
    shape = c[starts]
    for at in (np.minimum(starts + 1, last), np.maximum(starts, last - 2), np.maximum(starts, last - 1), last):
        shape = shape * np.uint64(257) + c[at]
    same[1:] = h[1:] == h[:-1]
    same[firsts[:-1][firsts[:-1] < len(h)]] = False
    return Words(h, (W.mix(shape) % np.uint64(SHAPES)).astype(np.int64), same, ends - starts, firsts)


def index_parts(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ONES dimensions and signs of each hash's index vector; a dimension may come twice."""
    bits = W.mix(h[:, None] + np.arange(1, ONES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return (bits % np.uint64(DIM)).astype(np.int64), np.where(bits >> np.uint64(63), 1.0, -1.0)


def index_vectors(h: np.ndarray) -> np.ndarray:
    """Index vectors of the hashes."""
    at, sign = index_parts(h)
    out = np.zeros((len(h), DIM))
    np.add.at(out, (np.arange(len(h))[:, None], at), sign)
    return out


def slots(known: np.ndarray, h: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """Row of each word in the table of vectors: its own, or its shape's."""
    if not len(known):
        return shape
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[at] == h, at, len(known) + shape)


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, n): occurrences of each word in all documents, by the word's hash."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_h, held_n = np.empty(0, np.uint64), np.empty(0, np.int64)

        def out():
            return pa.RecordBatch.from_arrays([pa.array(held_h.view(np.int64)), pa.array(held_n)], ["h", "n"])

        for b in batches:
            for _, _, data, offs in W.slices(b.column(1)):
                h, n = np.unique(words(data, offs).hash, return_counts=True)
                held_h, inverse = np.unique(np.concatenate([held_h, h]), return_inverse=True)
                held_n = np.bincount(inverse, np.concatenate([held_n, n]), len(held_h)).astype(np.int64)
                if len(held_h) > COUNTED:
                    yield out()
                    held_h, held_n = held_h[:0], held_n[:0]
        yield out()

    return docs.mapInArrow(W.tidy(each), "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame) -> np.ndarray:
    """Hashes, ascending, of the VOCABULARY most frequent words; equal counts by hash.

    Words too rare to be among them are left out first, by powers of two of their counts, so that
    what is sorted does not grow with the number of partitions.
    """
    power = F.floor(F.log2("n"))
    least, words_above = 0, 0
    for r in sorted(counts.groupBy(power.alias("power")).count().collect(), reverse=True):
        least, words_above = r.power, words_above + r["count"]
        if words_above >= VOCABULARY:
            break
    top = counts.filter(power >= least).orderBy(F.desc("n"), "h").limit(VOCABULARY).select("h").toArrow().column("h").to_numpy()
    return np.sort(top.astype(np.int64).view(np.uint64))


def context_sums(docs: DataFrame, known: np.ndarray) -> DataFrame:
    """(slot, n): for each row of the table of vectors (known words, then shapes) and dimension the
    sum of its neighbours' index vectors, and, beyond these, how many neighbours each row has."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        rows = len(known) + SHAPES
        total = np.zeros(rows * (DIM + 1))
        for b in batches:
            for _, _, data, offs in W.slices(b.column(1)):
                w = words(data, offs)
                if len(w.hash) < 2:
                    continue
                inside = np.ones(len(w.hash) - 1, bool)
                edge = w.firsts[(w.firsts > 0) & (w.firsts < len(w.hash))]
                inside[edge - 1] = False
                left = np.flatnonzero(inside)
                own = slots(known, w.hash, w.shape)
                at, sign = index_parts(w.hash)
                for a, n in ((left, left + 1), (left + 1, left)):
                    # a rarer word has no row of its own, and counts for its shape as all words do
                    mine = own[a] < len(known)
                    for row, by in ((own[a][mine], n[mine]), (len(known) + w.shape[a], n)):
                        total[: rows * DIM] += np.bincount((row[:, None] * DIM + at[by]).ravel(), sign[by].ravel(), rows * DIM)
                        total[rows * DIM :] += np.bincount(row, minlength=rows)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some].astype(np.int64))], ["slot", "n"])

    return docs.mapInArrow(W.tidy(each), "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))


def word_vectors(docs: DataFrame) -> Vectors:
    """Vectors of the corpus's words; at most (VOCABULARY + SHAPES) x (DIM + 1) numbers come to the driver."""
    known = vocabulary(W.cut(word_counts(docs)))
    sums = context_sums(docs, known).toArrow()
    rows = len(known) + SHAPES
    flat = np.zeros(rows * (DIM + 1))
    flat[sums.column("slot").to_numpy()] = sums.column("n").to_numpy()
    context, n = flat[: rows * DIM].reshape(rows, DIM), flat[rows * DIM :]
    index = index_vectors(np.concatenate([known, W.mix(np.arange(SHAPES, dtype=np.uint64))]))
    return Vectors(known, (index + context / np.maximum(n, 1)[:, None]).astype(np.float32))


def pooled(vectors: Vectors, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """For each text the mean of its words' vectors and of their shapes', the share of words that
    repeat the one before, the mean size of a word, and the logarithm of the number of words."""
    w = words(data, offs)
    n = np.diff(w.firsts)
    out = np.zeros((len(n), FEATURES), np.float32)
    full = np.flatnonzero(n)
    if len(full):
        at = w.firsts[:-1][full]
        known = len(vectors.known)
        for k, rows in enumerate((slots(vectors.known, w.hash, w.shape), known + w.shape)):
            out[full, k * DIM : (k + 1) * DIM] = np.add.reduceat(vectors.table[rows], at) / n[full, None]
        out[full, -3] = np.add.reduceat(w.same.astype(np.float32), at) / n[full]
        out[full, -2] = np.add.reduceat(w.size.astype(np.float32), at) / n[full] / 8
    out[:, -1] = np.log1p(n)
    return out


def features(docs: DataFrame, vectors: Vectors) -> DataFrame:
    """(doc_id, x): pooled vectors."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(vectors))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = Vectors(*shared.value)
        for b in batches:
            x = [pooled(vectors, data, offs) for _, _, data, offs in W.slices(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tolist() for p in x for r in p], pa.list_(pa.float32()))], ["doc_id", "x"])

    return docs.mapInArrow(W.tidy(each), "doc_id bigint, x array<float>")


class Network:
    """Two layers, fitted with Adam; a temperature for the logits."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 16, steps: int = 500, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.base = float(y.mean()) if len(y) else 0.5
        self.flat = len(set(y.tolist())) < 2
        if self.flat:
            return
        order = rng.permutation(len(y))
        keep, held = order[len(y) // 8 :], order[: len(y) // 8]
        self.mean, self.std = x.mean(0), x.std(0) + 1e-3
        x = (x - self.mean) / self.std
        self.p = [rng.normal(0, 0.3, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.3, hidden), np.zeros(1)]
        m, v = [np.zeros_like(w) for w in self.p], [np.zeros_like(w) for w in self.p]
        for t in range(1, steps + 1):
            rows = rng.choice(keep, min(len(keep), 2048), replace=False)
            a = np.tanh(x[rows] @ self.p[0] + self.p[1])
            e = (1 / (1 + np.exp(-np.clip(a @ self.p[2] + self.p[3][0], -30, 30))) - y[rows]) / len(rows)
            back = np.outer(e, self.p[2]) * (1 - a * a)
            grads = [x[rows].T @ back + 1e-4 * self.p[0], back.sum(0), a.T @ e + 1e-4 * self.p[2], np.array([e.sum()])]
            for k, g in enumerate(grads):
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                self.p[k] = self.p[k] - 0.02 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        self.temperature = 1.0
        if len(held):
            z = self._logits(x[held])
            loss = {t: np.logaddexp(0, np.where(y[held] == 1, -z, z) / t).mean() for t in np.geomspace(0.3, 6, 40)}
            self.temperature = min(loss, key=loss.__getitem__)

    def _logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3][0]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.flat:
            return np.full(len(x), self.base)
        return 1 / (1 + np.exp(-np.clip(self._logits((x - self.mean) / self.std) / self.temperature, -30, 30)))


def labelled(labels: DataFrame, column: str, modulus: int, held: int, rows: int) -> DataFrame:
    """At most `rows` (doc_id, y), one for each labelled id that is not held out, of lowest hash."""
    use = labels.filter(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), modulus) != held))
    return use.groupBy("doc_id").agg(F.max(column).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def fit(docs: DataFrame, train: DataFrame) -> tuple[Vectors, Network]:
    """Word vectors of the corpus and the network; train: a bounded (doc_id, y)."""
    vectors = word_vectors(W.as_bytes(docs))
    rows = features(W.as_bytes(docs.join(F.broadcast(train.select("doc_id")), "doc_id", "left_semi")), vectors).join(F.broadcast(train), "doc_id").orderBy("doc_id").toArrow()
    x = np.array(rows.column("x").to_pylist(), np.float64).reshape(-1, FEATURES)
    return vectors, Network(x, rows.column("y").to_numpy().astype(float))


def score(docs: DataFrame, vectors: Vectors, network: Network) -> DataFrame:
    """(doc_id, score) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast((tuple(vectors), network))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, network = Vectors(*shared.value[0]), shared.value[1]
        for b in batches:
            s = [network(pooled(vectors, data, offs).astype(np.float64)) for _, _, data, offs in W.slices(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate([np.empty(0), *s]), pa.float64())], ["doc_id", "score"])

    return docs.mapInArrow(W.tidy(each), "doc_id bigint, score double")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: every document's quality, learned from labels that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    vectors, network = fit(docs, labelled(spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", 5, 0, TRAIN_ROWS))
    out = score(W.as_bytes(docs), vectors, network)
    return out.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
