"""Benchmark decontamination as a prefix-filtered set join.

Every benchmark item gives its windows of 13 words (an item with fewer words is one window).  A
window lies in a document exactly when all its words do, in order, so one necessary prefix token
is enough to find it: the window's rarest word by document frequency over the whole corpus.
Document words that equal a prefix token give candidates; length and positional bounds (the
window must fit around that word) drop most of them, and the rest are verified word by word over
the item-sized window.  The items are worked through in blocks of a fixed number of windows, so
what is broadcast has a bound: a window that many items have is one, and its items are joined to
the documents found by its number.  Texts are never shuffled; if there are several blocks, they are
written once with a row key, and the blocks' hits of a row are put together by it.

Null or empty texts have no words and no hits; repeated items count by item_id; items without
words match nothing; items without item_id give hits and no item.  Repeated documents and those
without doc_id each get their row; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .names import free_prefix

WINDOW = 13
#: Windows broadcast at once: at most 100,000 of 13 hashes (10 MB) and their texts.
BLOCK_WINDOWS = 100_000

_MATCHES = pa.schema([("row_key", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("hits", pa.list_(pa.int32())), ("windows", pa.list_(pa.int64()))])


def _words_of(data: np.ndarray, offs: np.ndarray):
    data = W.LOWER[data]
    starts, ends, firsts = W.spans(data, offs, W.ALNUM)
    return data, starts, ends, firsts, W.hashes(data, starts, ends)


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Windows of the items: item_id as a string, the words' hashes and the words."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo, _, data, offs in W.slices(batch.column(1)):
                data, starts, ends, firsts, h = _words_of(data, offs)
                rows = []
                for k in range(len(firsts) - 1):
                    a, b = firsts[k], firsts[k + 1]
                    text = [data[x:y].tobytes() for x, y in zip(starts[a:b], ends[a:b], strict=True)]
                    n = min(window, b - a)
                    rows += [(ids[lo + k], h[a + i : a + i + n].view(np.int64).tolist(), b" ".join(text[i : i + n])) for i in range(b - a - n + 1 if n else 0)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.list_(pa.int64()), pa.binary()), strict=True)], ["item_id", "hashes", "words"])

    frame = W.as_bytes(items.withColumn("item_key", items[item_id].cast("string")), "item_key", text)
    return frame.mapInArrow(W.tidy(each), "item_id string, hashes array<bigint>, words binary")


def word_counts(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """Document frequency over all documents of the given word hashes (sorted)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        total = np.zeros(len(vocab), np.int64)
        for batch in batches:
            for _, _, data, offs in W.slices(batch.column(1)):
                _, _, _, firsts, h = _words_of(data, offs)
                if not len(h):
                    continue
                at = np.minimum(np.searchsorted(vocab, h), len(vocab) - 1)
                hit = vocab[at] == h
                pair = np.unique(W.owners(firsts)[hit] * len(vocab) + at[hit])
                total += np.bincount(pair % len(vocab), minlength=len(vocab))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(vocab[some].view(np.int64)), pa.array(total[some])], ["word", "n"])

    return docs.mapInArrow(W.tidy(each), "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class _Index:
    """The windows of a block (their numbers, hashes and words) by their prefix tokens."""

    def __init__(self, rows: list, frequency: dict[int, int]):
        self.number = np.array([r["window"] for r in rows], np.int64)
        self.words = [bytes(r["words"]) for r in rows]
        grams = [r["hashes"] for r in rows]
        self.size = np.array([len(g) for g in grams], np.int64)
        self.grams = np.zeros((len(grams), max(map(len, grams))), np.int64)
        offset = np.zeros(len(grams), np.int64)
        for k, g in enumerate(grams):
            self.grams[k, : len(g)] = g
            offset[k] = min(range(len(g)), key=lambda i: (frequency.get(g[i], 0), g[i], i))
        token = self.grams[np.arange(len(grams)), offset].view(np.uint64)
        self.order = np.argsort(token, kind="stable")
        self.offset = offset
        self.token, self.first, self.count = np.unique(token[self.order], return_index=True, return_counts=True)

    def matches(self, h: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, first word) of each window found by its prefix token and verified."""
        at = np.minimum(np.searchsorted(self.token, h), len(self.token) - 1)
        pos = np.flatnonzero(self.token[at] == h)
        owner = W.owners(firsts)
        found = []
        for chunk in np.array_split(pos, max(1, len(pos) // 20_000)):
            n = self.count[at[chunk]]
            row = self.order[np.repeat(self.first[at[chunk]] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            start = np.repeat(chunk, n) - self.offset[row]
            doc = owner[np.repeat(chunk, n)]
            fits = (start >= firsts[doc]) & (start + self.size[row] <= firsts[doc + 1])
            row, start = row[fits], start[fits]
            for j in range(self.grams.shape[1]):
                short = self.size[row] <= j
                same = short | (h[np.minimum(start + j, len(h) - 1)].view(np.int64) == self.grams[row, j])
                row, start = row[same], start[same]
            found.append((row, start))
        return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def numbered_windows(windows: DataFrame) -> DataFrame:
    """(window, words, hashes): a row for each distinct window of item_windows(), however many items have it."""
    return W.cut(windows.groupBy("words").agg(F.first("hashes").alias("hashes")).withColumn("window", F.monotonically_increasing_id()))


def find_windows(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """Per row its key, its number of words, the hit words' positions and the numbers of the windows in it.

    docs: doc_id and text as as_bytes() gives them, and a row_key if there is one that stays the
    same when docs is read again; windows: of numbered_windows().
    """
    spark = docs.sparkSession
    blocks = max(1, -(-windows.count() // BLOCK_WINDOWS))
    if "row_key" not in docs.columns:
        docs = docs.withColumn("row_key", F.monotonically_increasing_id())
        docs = W.cut(docs) if blocks > 1 else docs
    out = None
    for k in range(blocks):
        mine = windows.filter(F.pmod(F.xxhash64("words"), F.lit(blocks)) == k)
        rows = mine.collect()  # bounded: each window is one row, and a block holds about BLOCK_WINDOWS of them
        vocab = np.unique(np.array([x for r in rows for x in r["hashes"]], np.int64).view(np.uint64))
        seen = {r["word"]: r["n"] for r in word_counts(docs, vocab).collect()} if len(vocab) else {}
        shared = spark.sparkContext.broadcast(_Index(rows, seen) if rows else None)

        def each(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                ids, keys = batch.column(0), batch.column(2)
                for lo, hi, data, offs in W.slices(batch.column(1)):
                    data, starts, ends, firsts, h = _words_of(data, offs)
                    hits: list[list[int]] = [[] for _ in range(hi - lo)]
                    numbers: list[list[int]] = [[] for _ in range(hi - lo)]
                    if index is not None and len(h):
                        row, start = index.matches(h, firsts)
                        same = np.zeros(len(row), bool)
                        for i, (r, s) in enumerate(zip(row, start, strict=True)):
                            e = s + index.size[r]
                            same[i] = b" ".join(data[x:y].tobytes() for x, y in zip(starts[s:e], ends[s:e], strict=True)) == index.words[r]
                        row, start = row[same], start[same]
                        step = np.zeros(len(h) + 1, np.int64)
                        np.add.at(step, start, 1)
                        np.add.at(step, start + index.size[row], -1)
                        owner = W.owners(firsts)
                        hit = np.flatnonzero(np.cumsum(step[:-1]) > 0)
                        for d in np.unique(owner[hit]):
                            hits[d] = (hit[owner[hit] == d] - firsts[d]).tolist()
                        for d, r in np.unique(np.stack([owner[start], row], 1), axis=0) if len(row) else ():
                            numbers[d].append(index.number[r])
                    yield pa.RecordBatch.from_arrays([keys.slice(lo, hi - lo), ids.slice(lo, hi - lo).cast(pa.int64()), pa.array(np.diff(firsts)), pa.array(hits, pa.list_(pa.int32())), pa.array(numbers, pa.list_(pa.int64()))], schema=_MATCHES)

        part = docs.mapInArrow(W.tidy(each), "row_key bigint, doc_id bigint, n_words bigint, hits array<int>, windows array<bigint>")
        # the first block gives every row, the others those with hits
        out = part if out is None else out.unionByName(part.filter(F.size("hits") > 0))
    if blocks > 1:
        whole = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("hits", "windows")]
        out = out.groupBy("row_key").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), *whole)
    return out


def _contaminated(found: DataFrame) -> DataFrame:
    n = F.size("hits").cast("long")
    return found.withColumn("n_hit", n).withColumn("contaminated", (n > 0) & (20 * n >= F.col("n_words")))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, hits (word positions), items (item ids), n_hit, contaminated."""
    every = W.cut(item_windows(items, window=window))
    windows = numbered_windows(every)
    found = W.cut(find_windows(W.as_bytes(docs, doc_id, text), windows))
    holders = every.filter("item_id IS NOT NULL").select("words", "item_id").distinct().join(windows, "words").select("window", "item_id")
    items_of = found.select("row_key", F.explode("windows").alias("window")).join(holders, "window").groupBy("row_key").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    whole = found.join(items_of, "row_key", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return _contaminated(whole.select("doc_id", "n_words", "hits", "items"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not contaminated, with their columns; one without doc_id is judged by itself."""
    key = f"{free_prefix(docs)}_key"
    keyed, _ = W.with_keys(docs, key=key)
    items = numbered_windows(item_windows(spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    bad = _contaminated(find_windows(W.as_bytes(keyed, key), items)).filter("contaminated").select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(bad, key, "left_anti").select(*docs.columns)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: contamination of every document by the benchmark."""
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")
