"""Substring dedup: passages of 50 words that an earlier document has, by FM-index shards.

1. Anchors: of the ANCHOR-word grams in a 50-word window the one of smallest hash is its anchor,
   so equal windows have equal anchors.  Windows that follow one another and have one anchor are a
   slice.  Anchors that lie in one document only cannot lie in a repeat and are left out.
2. Equal slices are one: their first document (smallest doc_id) stands for them, and in all later
   ones every window is a repeat.
3. The distinct slices are dealt into shards by their anchors.  Each shard is indexed by an
   FM-index: the slices' grams of STEP words, read in steps of STEP words, are the symbols; the
   Burrows-Wheeler transform is held in a wavelet matrix of packed bits with block ranks.  The
   slices are streamed against it: backward search over 50 / STEP symbols gives the suffix range
   that matches 50 words or more, and the smallest document of the range tells whether the window
   starts in an earlier document.
4. Anchors with more than HOT slices would make a shard too large: their windows are split up by
   content instead, and each distinct window's first document is found by aggregation.

Documents that no repeat can be in (by a Bloom filter of fixed size) are not shuffled.

Null and empty texts have no words.  Texts of fewer than 50 words lose nothing.  doc_id is taken as
a key; rows that repeat a document wholly get the same result each; each row without a doc_id is a
document of its own, after all others in order.  Words, grams and windows are compared by 64-bit
hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W

WINDOW, ANCHOR, STEP = 50, 24, 10
SHARD_SLICES = 8_000
HOT = 2_000
#: A key with over one row in SHARE of all (fewer than SHARE keys) is dealt over SALTS tasks where it is joined.
SHARE, SALTS = 1_000, 32
#: Bits of the Bloom filter that is broadcast (8 MB).
FILTER_BITS = 1 << 26

_U = np.uint64
_POS = _U(26)


def _sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    size = 1
    while size * 2 <= k:
        x, size = np.minimum(x[:-size], x[size:]), size * 2
    return np.minimum(x[: len(x) - (k - size)], x[k - size :]) if k > size else x


def _slices_of(h: np.ndarray, firsts: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR):
    """(text, first word, number of windows, anchor hash, slice hash) of each slice."""
    if len(h) < window:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, _U),) * 2
    grams = W.rolling(h, anchor)
    key = ((grams >> _POS) << _POS) | np.arange(len(grams), dtype=_U)
    pick = (_sliding_min(key, window - anchor + 1) & ((_U(1) << _POS) - _U(1))).astype(np.int64)
    owner = W.owners(firsts)
    n = len(h) - window + 1
    inside = np.flatnonzero(owner[:n] == owner[window - 1 :])
    if not len(inside):
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, _U),) * 2
    pick = pick[inside]
    new = np.ones(len(inside), bool)
    new[1:] = (pick[1:] != pick[:-1]) | (inside[1:] != inside[:-1] + 1)
    at = np.flatnonzero(new)
    start, count = inside[at], np.diff(np.append(at, len(inside)))
    # the slice's hash from running sums of word hashes times powers
    base = _U(0xA0761D6478BD642F)
    power = np.full(len(h), base, _U)
    power[0] = 1
    power = np.multiply.accumulate(power)
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(h * power)])
    back = np.full(len(h), _U(pow(int(base), -1, 1 << 64)), _U)
    back[0] = 1
    back = np.multiply.accumulate(back)
    end = start + count + window - 1
    return owner[start], start, count, grams[pick[at]], W.mix((sums[end] - sums[start]) * back[start] + count.astype(_U))


def occurrences(docs: DataFrame) -> DataFrame:
    """(anchor, slice, doc_id, start, n): every slice of every document."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            for lo, _, data, offs in W.slices(b.column(1)):
                starts, ends, firsts = W.spans(data, offs)
                text, start, n, anchor, whole = _slices_of(W.hashes(data, starts, ends), firsts)
                if len(text):
                    yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(ids[lo + text]), pa.array((start - firsts[text]).astype(np.int32)), pa.array(n.astype(np.int32))], ["anchor", "slice", "doc_id", "start", "n"])

    return docs.mapInArrow(W.tidy(each), "anchor bigint, slice bigint, doc_id bigint, start int, n int")


def doc_filter(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of FILTER_BITS bits and one hash over the doc_ids, as 64-bit words."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    rows = ids.select(slot.alias("s")).groupBy(F.floor(F.col("s") / 64).cast("int").alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("s") % 64).cast("int"))).alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(_U)


def split_docs(docs: DataFrame, bits: np.ndarray, inside: bool) -> DataFrame:
    """The rows whose doc_id may be (inside) or is surely not in the filter."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = b.column(2).to_numpy().astype(_U)
            hit = (shared.value[(s >> _U(6)).astype(np.int64)] >> (s & _U(63))) & _U(1)
            yield b.select([0, 1]).filter(pa.array((hit == 1) == inside))

    return docs.withColumn("slot", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))).mapInArrow(W.tidy(each), "doc_id bigint, text binary")


class Wavelet:
    """A wavelet matrix over a sequence of symbols: packed bits, and ranks at each 64 bits."""

    def __init__(self, x: np.ndarray, levels: int):
        self.n, self.levels, self.planes = len(x), levels, []
        for k in range(levels - 1, -1, -1):
            bit = ((x >> k) & 1).astype(np.uint8)
            packed = np.packbits(np.pad(bit, (0, -len(bit) % 64 + 64)), bitorder="little").view(_U)
            ranks = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.bitwise_count(packed).astype(np.int64))])
            zeros = len(bit) - int(bit.sum())
            self.planes.append((packed, ranks.astype(np.int32), zeros))
            x = np.concatenate([x[bit == 0], x[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where (symbol, at) leads through the planes; the difference of two such places is a count."""
        for k, (packed, ranks, zeros) in enumerate(self.planes):
            word = at >> 6
            ones = ranks[word] + np.bitwise_count(packed[word] & ((_U(1) << (at & 63).astype(_U)) - _U(1))).astype(np.int64)
            at = np.where((symbol >> (self.levels - 1 - k)) & 1, zeros + ones, at - ones)
        return at


class FMIndex:
    """An FM-index of many short symbol sequences (symbols from 1; 0 ends each)."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray, n_symbols: int):
        n = len(symbols) + len(lengths)
        ends = np.cumsum(lengths + 1) - 1
        text = np.zeros(n, np.int64)
        body = np.ones(n, bool)
        body[ends] = False
        text[body] = symbols
        rank = text.copy()
        sequence = np.repeat(np.arange(len(lengths)), lengths + 1)
        left = ends[sequence] - np.arange(n)  # symbols up to the end
        step = 1
        while step <= int(lengths.max(initial=0)):
            later = np.zeros(n, np.int64)
            fits = left >= step
            later[fits] = rank[np.flatnonzero(fits) + step] + 1
            _, rank = np.unique(rank * (n + 2) + later, return_inverse=True)
            step *= 2
        self.order = np.lexsort([sequence, rank])
        before = np.zeros(n, np.int64)
        before[1:] = text[:-1]
        self.first = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.bincount(text, minlength=n_symbols + 1))])
        self.tree = Wavelet(before[self.order], max(1, int(n_symbols).bit_length()))
        self.n, self.sequence = n, sequence
        all_symbols = np.arange(n_symbols + 1)
        self.origin = self.tree.rank(all_symbols, np.zeros(n_symbols + 1, np.int64))

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges that start with each row of symbols, by backward search."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n)
        for c in patterns.T[::-1]:
            base = self.first[c] - self.origin[c]
            lo, hi = base + self.tree.rank(c, lo), base + self.tree.rank(c, hi)
        return lo, hi


def _search_shard(slices: list[np.ndarray], docs: np.ndarray, window: int = WINDOW, step: int = STEP) -> list[np.ndarray]:
    """For each slice (its words' hashes), which windows start in a slice of a smaller document."""
    size = np.array([len(s) for s in slices], np.int64)
    h = np.concatenate(slices)
    grams = W.rolling(h, step)
    owner = np.repeat(np.arange(len(slices)), size)
    first = np.cumsum(size) - size
    at = np.flatnonzero(owner[: len(grams)] == owner[step - 1 :])  # grams within one slice
    names, code = np.unique(grams[at], return_inverse=True)
    symbol = np.zeros(len(h), np.int64)
    symbol[at] = code + 1
    place = at - first[owner[at]]
    order = np.lexsort([place // step, place % step, owner[at]])  # each slice's grams, step words apart
    key = owner[at][order] * step + (place % step)[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    lengths = np.diff(np.append(new, len(key)))
    index = FMIndex(symbol[at][order], lengths, len(names))
    of_sequence = docs[owner[at][order][new]]
    starts = np.flatnonzero((np.arange(len(h)) - first[owner]) <= size[owner] - window)
    lo, hi = np.empty(len(starts), np.int64), np.empty(len(starts), np.int64)
    for a in range(0, len(starts), 200_000):
        some = starts[a : a + 200_000]
        lo[a : a + 200_000], hi[a : a + 200_000] = index.search(symbol[some[:, None] + np.arange(0, window, step)])
    by_rank = of_sequence[index.sequence[index.order]]
    low, back = np.unique(lo, return_inverse=True)
    high = np.zeros(len(low), np.int64)
    high[back] = hi
    edges = np.stack([low, high], 1).ravel()
    docs_at = np.append(by_rank, np.iinfo(np.int64).max)
    least = np.minimum.reduceat(docs_at, edges)[::2][back]
    hit = least < docs[owner[starts]]
    cuts = np.cumsum(size - window + 1)[:-1]
    return np.split(hit, cuts)


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - edge[::2]).tolist(), strict=True))


def search_shards(slices: DataFrame) -> DataFrame:
    """(doc_id, start, n): runs of windows that an earlier document has, from the shards."""

    def each(t: pa.Table) -> pa.Table:
        words = [np.frombuffer(x.as_py(), _U) for x in t.column("words")]
        docs, start = t.column("doc_id").to_numpy(), t.column("start").to_numpy()
        rows = [(docs[k], start[k] + a, n) for k, hit in enumerate(_search_shard(words, docs)) for a, n in _runs(hit)]
        return pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "start": pa.array([r[1] for r in rows], pa.int32()), "n": pa.array([r[2] for r in rows], pa.int32())})

    return slices.groupBy("shard").applyInArrow(each, "doc_id bigint, start int, n int")


def _words_of_slices(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(anchor, doc_id, start, words, hot) of wanted (anchor, doc_id, start, n, hot); a hot slice gives a row for each window."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lists = b.column(0).to_pylist(), b.column(2).to_pylist()
            rows = []
            for lo, _, data, offs in W.slices(b.column(1)):
                starts, ends, firsts = W.spans(data, offs)
                h = W.hashes(data, starts, ends)
                for k in range(len(firsts) - 1):
                    for s in lists[lo + k]:
                        at, n = int(firsts[k]) + s["start"], s["n"]
                        if at + n + WINDOW - 1 > firsts[k + 1]:
                            continue  # of another row with this doc_id
                        if s["hot"]:
                            whole = W.rolling(h[at : at + n + WINDOW - 1], WINDOW)
                            rows += [(s["anchor"], ids[lo + k], s["start"] + i, x.tobytes(), True) for i, x in enumerate(whole)]
                        else:
                            rows.append((s["anchor"], ids[lo + k], s["start"], h[at : at + n + WINDOW - 1].tobytes(), False))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds, strict=True)], ["anchor", "doc_id", "start", "words", "hot"])

    lists = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "start", "n", "hot")).alias("slices"))
    some = split_docs(docs, doc_filter(lists), True)
    return some.join(lists, "doc_id").select("doc_id", "text", "slices").mapInArrow(W.tidy(each), "anchor bigint, doc_id bigint, start int, words binary, hot boolean")


def hot_keys(counts: DataFrame, key: str, n: str) -> DataFrame:
    """(key, n) of the keys that hold over one row in SHARE of all; fewer than SHARE, so safe to broadcast."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    return W.cut(counts.filter(F.col(n) > max(SALTS, total // SHARE)).select(key, n))


def salted_join(rows: DataFrame, facts: DataFrame, keys: list[str], hot: DataFrame, *by: str) -> DataFrame:
    """rows join facts (one row for each of the keys), where a key of hot is dealt over SALTS tasks by the columns `by`."""
    key = hot.columns[0]
    mark = F.broadcast(hot.select(key, F.lit(True).alias("_hot")))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*by), F.lit(SALTS))).otherwise(0)
    every = F.when(F.col("_hot"), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    left = rows.join(mark, key, "left").withColumn("_salt", salt.cast("long")).drop("_hot")
    right = facts.join(mark, key, "left").withColumn("_salt", F.explode(every)).drop("_hot")
    return left.join(right, [*keys, "_salt"]).drop("_salt")


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, start, n): runs of n windows, the first at word `start`, that an earlier document has."""
    found = occurrences(docs)
    several = W.cut(found.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("rows")).filter("lo < hi").select("anchor", "rows"))
    hot = hot_keys(several, "anchor", "rows")
    shared = W.cut(salted_join(found, several.select("anchor"), ["anchor"], hot, "doc_id", "start"))
    distinct = W.cut(shared.groupBy("anchor", "slice").agg(F.min("doc_id").alias("first")))
    per_anchor = distinct.groupBy("anchor").agg(F.count("*").alias("slices"))
    # a slice's facts are put together by slice first, so that occurrences are joined once
    facts = salted_join(distinct, per_anchor, ["anchor"], hot, "slice")
    placed = W.cut(salted_join(shared, facts, ["anchor", "slice"], hot, "doc_id", "start").select("anchor", "doc_id", "start", "n", "first", "slices"))
    later = placed.filter("doc_id > first").select("doc_id", "start", "n")
    wanted = placed.filter("doc_id = first AND slices > 1").withColumn("hot", F.col("slices") > HOT).select("anchor", "doc_id", "start", "n", "hot")
    pieces = W.cut(_words_of_slices(docs, wanted))
    shards = max(1, -(-pieces.filter("NOT hot").count() // SHARD_SLICES))
    searched = search_shards(pieces.filter("NOT hot").select(F.pmod(F.xxhash64("anchor"), F.lit(shards)).cast("int").alias("shard"), "doc_id", "start", "words"))
    windows = pieces.filter("hot").select("words", "doc_id", "start")
    least = W.cut(windows.groupBy("words").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")))
    split = salted_join(windows, least.select("words", "first"), ["words"], hot_keys(least, "words", "rows"), "doc_id", "start").filter("doc_id > first").select("doc_id", "start", F.lit(1).alias("n"))
    return W.cut(later.unionByName(searched).unionByName(split))


_RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept binary"


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every document; kept: the other words, one space apart."""
    keyed, top = W.with_keys(docs, doc_id)
    texts = W.as_bytes(keyed, "row_key", text)
    spots = repeats(texts).groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    bits = doc_filter(spots)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs = b.column(2).to_pylist() if b.num_columns > 2 else None
            words, gone, kept = [], [], []
            for k, t in enumerate(b.column(1)):
                parts = t.as_py().split()
                left = parts
                if runs and runs[k]:
                    step = np.zeros(len(parts) + 1, np.int64)
                    for r in runs[k]:
                        if r["start"] < len(parts):
                            step[r["start"]] += 1
                            step[min(len(parts), r["start"] + r["n"] + WINDOW - 1)] -= 1
                    stay = np.cumsum(step[:-1]) == 0
                    left = [w for w, s in zip(parts, stay.tolist(), strict=True) if s]
                words.append(len(parts))
                gone.append(len(parts) - len(left))
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])

    clean = split_docs(texts, bits, False).mapInArrow(W.tidy(each), _RESULT)
    rest = split_docs(texts, bits, True).join(spots, "doc_id", "left").select("doc_id", "text", "runs").mapInArrow(W.tidy(each), _RESULT)
    return clean.unionByName(rest).withColumn("doc_id", W.without_keys(F.col("doc_id"), top))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: what is left of every document."""
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
