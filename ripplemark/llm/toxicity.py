"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear models over the document's set of words:
`terms` (it is toxic and holds a word that marks toxic rows), `repeated` (toxic, with two such
words or more), and `toxic`.  Each model also gets the probabilities of the categories before it;
in training these are out-of-fold predictions, so that a later model learns from probabilities as
unsure as those it will meet.  Marking words are found by their share of toxic rows, counted in
Spark over the training rows by fold: the models of a fold use words that the other folds give.

At most TRAIN_ROWS labelled rows (those whose ids hash lowest) train; of their words only the
marking ones come to the driver, which the training rows bound: each is held by LEAST_ROWS toxic
ones or more.  Null and empty texts have no words and get the models' base probabilities.  With
labels of one class only, nothing is toxic.  Repeated documents each get their row, also those
without doc_id, for which `held_out` is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .langid import remainder
from .quality import labelled

CATEGORIES = ("terms", "repeated", "toxic")
TRAIN_ROWS = 6_000
#: Bytes of a word's beginning that are features of their own, for words that share a stem.
PREFIXES = (4, 5, 6, 7, 8)
FOLDS = 4
#: A word is a feature if this many toxic training rows, this share of them at least, hold it,
#: and of the training rows that hold it this share is toxic.
LEAST_ROWS, LEAST_SHARE, LEAST_PURITY = 5, 0.015, 0.75
LEAST_SCORE = 0.5


def _sets(data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """Distinct hashes of the words and of their beginnings, of each text."""
    data = W.LOWER[data]
    starts, ends, firsts = W.spans(data, offs, W.ALNUM)
    parts, owner = [W.hashes(data, starts, ends)], [W.owners(firsts)]
    for n in PREFIXES:
        long = ends - starts > n
        parts.append(W.hashes(data, starts[long], starts[long] + n) ^ np.uint64(n))
        owner.append(owner[0][long])
    h, who = np.concatenate(parts), np.concatenate(owner)
    order = np.argsort(who, kind="stable")
    h, at = h[order], np.searchsorted(who[order], np.arange(len(offs)))
    return [np.unique(h[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def word_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, words): the distinct word hashes of each document."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [s.view(np.int64).tolist() for _, _, data, offs in W.slices(b.column(1)) for s in _sets(data, offs)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "words"])

    return docs.mapInArrow(W.tidy(each), "doc_id bigint, words array<bigint>")


class _Linear:
    """Logistic regression on sparse binary features and a few dense ones, by accelerated gradients."""

    def __init__(self, row: np.ndarray, col: np.ndarray, n_cols: int, more: np.ndarray, y: np.ndarray, steps: int = 600, decay: float = 2e-5):
        self.w, self.u, self.b = np.zeros(n_cols), np.zeros(more.shape[1]), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
        g2 = [np.full(n_cols, 1e-8), np.full(more.shape[1], 1e-8), 1e-8]
        for _ in range(steps):
            z = np.bincount(row, self.w[col], len(y)) + more @ self.u + self.b
            e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
            gw, gu, gb = np.bincount(col, e[row], n_cols) + decay * self.w, more.T @ e + decay * self.u, e.sum()
            g2 = [g2[0] + gw * gw, g2[1] + gu * gu, g2[2] + gb * gb]
            self.w -= 0.3 * gw / np.sqrt(g2[0])
            self.u -= 0.3 * gu / np.sqrt(g2[1])
            self.b -= 0.3 * gb / np.sqrt(g2[2])

    def __call__(self, row: np.ndarray, col: np.ndarray, n: int, more: np.ndarray) -> np.ndarray:
        z = np.bincount(row, self.w[col], n) + more @ self.u + self.b
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def marking(bad: np.ndarray, seen: np.ndarray, n_toxic: int) -> np.ndarray:
    """Which words mark toxic rows, by the toxic rows and all rows that hold them."""
    return (bad >= max(LEAST_ROWS, LEAST_SHARE * n_toxic)) & (bad >= LEAST_PURITY * seen)


class Chain:
    """The categories' models in order, over a vocabulary of word hashes.

    row, col: which training row holds which of the words (sorted hashes); toxic, fold: of each row;
    bad, seen: toxic rows and all rows that hold a word, by fold (words x FOLDS).
    """

    def __init__(self, row: np.ndarray, col: np.ndarray, words: np.ndarray, toxic: np.ndarray, fold: np.ndarray, bad: np.ndarray, seen: np.ndarray):
        n = len(toxic)
        self.flat = n == 0 or toxic.min() == toxic.max()
        if self.flat:
            return
        self.words = words

        def of(without: int | None) -> tuple[np.ndarray, np.ndarray, dict]:
            """Entries of the words that mark rows outside a fold, and the categories by these words."""
            part = np.arange(FOLDS) != (-1 if without is None else without)
            use = marking(bad[:, part].sum(1), seen[:, part].sum(1), int(toxic[fold != (-1 if without is None else without)].sum()))
            mine = use[col]
            hits = np.bincount(row[mine], minlength=n)
            return row[mine], col[mine], {"terms": (hits >= 1) & (toxic == 1), "repeated": (hits >= 2) & (toxic == 1), "toxic": toxic == 1}

        whole, inner = of(None), [of(k) for k in range(FOLDS)]
        before = np.zeros((n, 0))
        self.models = []
        for c in CATEGORIES:
            self.models.append(_Linear(*whole[:2], len(words), before, whole[2][c].astype(float)))
            out = np.zeros(n)
            for k in range(FOLDS):
                part = fold != k
                if part.any() and not part.all():
                    own_row, own_col, target = inner[k]
                    sub = part[own_row]
                    m = _Linear((np.cumsum(part) - 1)[own_row[sub]], own_col[sub], len(words), before[part], target[c][part].astype(float))
                    out[~part] = m(own_row, own_col, n, before)[~part]
            before = np.column_stack([before, out])

    def __call__(self, sets: list[np.ndarray]) -> np.ndarray:
        n = len(sets)
        before = np.zeros((n, 0))
        if self.flat or not n:
            return np.zeros((n, len(CATEGORIES)))
        row = np.repeat(np.arange(n), [len(s) for s in sets])
        h = np.concatenate(sets)
        at = np.minimum(np.searchsorted(self.words, h), max(0, len(self.words) - 1))
        known = self.words[at] == h if len(self.words) else np.zeros(len(h), bool)
        for m in self.models:
            before = np.column_stack([before, m(row[known], at[known], n, before)])
        return before


def fit(docs: DataFrame, train: DataFrame) -> Chain:
    """The chain from a bounded (doc_id, y) of labelled ids."""
    rows = word_sets(W.as_bytes(docs.join(F.broadcast(train.select("doc_id")), "doc_id", "left_semi"))).join(F.broadcast(train), "doc_id")
    rows = W.cut(rows.select(F.monotonically_increasing_id().alias("row"), F.col("y").cast("int").alias("y"), F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold"), "words"))
    at = rows.select("row", "y", "fold").orderBy("row").toArrow()  # at most TRAIN_ROWS, without their words
    y, fold = at.column("y").to_numpy().astype(np.int64), at.column("fold").to_numpy()
    each = rows.select("row", "y", "fold", F.explode("words").alias("word"))
    by_fold = [F.count_if((F.col("fold") == k) & (F.col("y") == v) if v else F.col("fold") == k).alias(f"{'bad' if v else 'seen'}{k}") for v in (1, 0) for k in range(FOLDS)]
    # a word stays if it marks the rows of all folds, or of all folds but one
    marks = []
    for without in range(-1, FOLDS):
        bad, seen = (sum(F.col(f"{x}{k}") for k in range(FOLDS) if k != without) for x in ("bad", "seen"))
        marks.append((bad >= float(max(LEAST_ROWS, LEAST_SHARE * y[fold != without].sum()))) & (bad >= LEAST_PURITY * seen))
    vocabulary = W.cut(each.groupBy("word").agg(*by_fold).filter(reduce(or_, marks)))
    table = vocabulary.toArrow()
    counts = [np.stack([table.column(f"{x}{k}").to_numpy() for k in range(FOLDS)], 1) for x in ("bad", "seen")]
    held = each.join(vocabulary.select("word"), "word").select("row", "word").toArrow()
    row = np.searchsorted(at.column("row").to_numpy(), held.column("row").to_numpy())
    words = table.column("word").to_numpy().view(np.uint64)
    order = np.argsort(words)
    words = words[order]
    col = np.searchsorted(words, held.column("word").to_numpy().view(np.uint64))
    back = np.lexsort([col, row])
    return Chain(row[back], col[back], words, y.astype(float), fold, *[c[order] for c in counts])


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """(doc_id, p_terms, p_repeated, p_toxic) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{c}" for c in CATEGORIES]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = [shared.value(_sets(data, offs)) for _, _, data, offs in W.slices(b.column(1))]
            p = np.concatenate([np.zeros((0, len(names))), *p])
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(p[:, k]) for k in range(len(names))]], ["doc_id", *names])

    return docs.mapInArrow(W.tidy(each), "doc_id bigint, " + ", ".join(f"{x} double" for x in names))


def toxicity(docs: DataFrame, source: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of docs by a chain that learns from the labelled rows of source."""
    return score(W.as_bytes(docs), fit(source, labelled(labels, "toxic", 5, 0, TRAIN_ROWS)))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the chain does not call toxic, with their columns."""
    chain = fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), labelled(spark.read.parquet(f"{sf_dir}/labels.parquet"), "toxic", 5, 0, TRAIN_ROWS))
    shared = spark.sparkContext.broadcast(chain)
    W.small_batches(spark)
    at = docs.columns.index("text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = [shared.value(_sets(data, offs))[:, -1] for _, _, data, offs in W.slices(b.column(at).cast(pa.binary()))]
            yield b.filter(pa.array(np.concatenate([np.empty(0), *p]) < LEAST_SCORE))

    return docs.mapInArrow(W.tidy(each), docs.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: every document's category probabilities and whether it is rejected."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = toxicity(docs, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "p_terms", "p_repeated", "p_toxic", (F.col("p_toxic") >= LEAST_SCORE).alias("toxic"))
