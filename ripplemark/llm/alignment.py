"""Alignment of two tokenizers by bytes, with corpus-wide counts of linked id pairs.

Tokenizer A is a byte-level BPE, B a piece model that puts a space before a text; A gets the space
written out, so that both cover the same bytes.  Where an A token and a B token both end, a group
ends; an A and a B token whose byte ranges overlap are linked.

1. Each text is encoded once.  Its ids are written, and each task writes the distinct pairs of its
   links with their counts, dealt into buckets by B id, so that all pairs of a B id are in a bucket.
2. A tree of merges, at most FAN lists at each node, finds each bucket's distinct pairs, and a
   minimal perfect hash is built over them: levels of bits in which a pair stands where no other
   does; a pair's index is its bit's rank.
3. Tasks' counts become dense vectors, indexed by the hash, which are summed along a tree.  Each
   entry keeps its pair, by which a look-up is verified: a pair that is not in the corpus counts 0.
4. A second pass aligns the documents again, from the ids, and looks up their links' counts, with
   SLICE entries in memory at most: with more pairs, a pass for each slice, whose sums are added.

Null and empty texts, and texts that either tokenizer does not give back byte for byte, have no
tokens: their numbers are 0 and their groups an empty string.  A text of any length is encoded
whole.  Repeated rows count each; other columns are kept, but for those named like the output.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .names import free_prefix

#: Lists merged by one task at once; buckets of B ids; entries in memory in the second pass.
FAN, BUCKETS, SLICE = 64, 64, 4_194_304
#: Distinct pairs that a task holds before it writes them.
HELD = 1_000_000
#: Bytes of text that are aligned at once; one longer text is aligned by itself.
TEXTS = 1_000_000
#: Bits for each pair in a level of the hash.
GAMMA = 2
_U = np.uint64
OUT = {"n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "n_links": "bigint", "n_best": "bigint", "count_sum": "bigint", "groups": "string"}


# ---- tokenizers


@cache
def _byte_of() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable Latin-1 signs for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def bytes_a(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level BPE file; an added token has none."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    vocab, added = data["model"]["vocab"], {x["content"] for x in data["added_tokens"]}
    table = [b""] * (1 + max([*vocab.values(), *(x["id"] for x in data["added_tokens"])]))
    for token, k in vocab.items():
        if token not in added:
            table[k] = bytes(map(_byte_of().__getitem__, token))
    return table


def bytes_b(path: str) -> list[bytes]:
    """The bytes of each id of a piece model; control and unknown pieces have none."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)

    def of(k: int) -> bytes:
        piece = model.id_to_piece(k)
        if model.is_control(k) or model.is_unknown(k):
            return b""
        return bytes([int(piece[3:5], 16)]) if model.is_byte(k) else piece.replace("▁", " ").encode()

    return [of(k) for k in range(model.get_piece_size())]


def _in_rank_order(path: str) -> dict[bytes, int] | None:
    """The ranks by which a faster library gives the same ids: only if ids stand in the order of the merges that make them, and nothing else is done to a text."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    model, table = data["model"], bytes_a(path)
    pre = data["pre_tokenizer"] or {}
    plain = data["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and model["type"] == "BPE" and not model.get("ignore_merges") and not model.get("dropout")
    made = [bytes(map(_byte_of().__getitem__, "".join(m if isinstance(m, list) else m.split(" ")))) for m in model["merges"]]
    ranks = {t: k for k, t in enumerate(table) if t}
    return ranks if plain and made == table[256 : 256 + len(made)] and sorted(table[:256]) == [bytes([k]) for k in range(256)] else None


def encoder_a(path: str):
    """texts -> ids of each, without special tokens."""
    ranks = _in_rank_order(path)
    if ranks is not None:
        import public_tokenizers
        import tiktoken

        encode = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy
        return lambda texts: [encode(t, disallowed_special=()) for t in texts]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda texts: [np.array(tokenizer.encode(t, add_special_tokens=False).ids, np.uint32) for t in texts]


def encoder_b(path: str):
    """texts -> ids of each; the model adds the space."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [np.array(x, np.uint32) for x in model.encode(texts, num_threads=1)]


class Vocabulary:
    """Token bytes of all ids, one after the other."""

    def __init__(self, table: list[bytes]):
        self.size = np.array([len(t) for t in table])
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(table), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        n = self.size[ids]
        return self.data[np.repeat(self.start[ids] - np.cumsum(n) + n, n) + np.arange(n.sum())]


# ---- alignment of many texts at once


def links(size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(A token, B token, whether both end) of each link in order, from token lengths that cover the same bytes.

    Each stretch between two ends of either side is one link: of the tokens that hold it.
    """
    at = [np.zeros(int(size_a.sum()), bool) for _ in range(2)]
    at[0][np.cumsum(size_a) - 1] = True
    at[1][np.cumsum(size_b) - 1] = True
    ends = np.flatnonzero(at[0] | at[1])
    is_a, is_b = at[0][ends], at[1][ends]
    return np.cumsum(is_a) - is_a, np.cumsum(is_b) - is_b, is_a & is_b


def _batch(a: list[np.ndarray], b: list[np.ndarray], va: Vocabulary, vb: Vocabulary):
    """(ids of A, of B, links' A, links' B, ends, text of each link) of texts one after the other."""
    flat = [np.concatenate(x) if x else np.empty(0, np.uint32) for x in (a, b)]
    of_a, of_b, ends = links(va.size[flat[0]], vb.size[flat[1]])
    text = np.repeat(np.arange(len(a)), [len(x) for x in a])[of_a] if len(of_a) else of_a
    return *flat, of_a, of_b, ends, text


def pair_keys(a: np.ndarray, b: np.ndarray, vb: Vocabulary) -> np.ndarray:
    return a.astype(_U) * _U(len(vb.size)) + b.astype(_U)


def _bucket(b: np.ndarray) -> np.ndarray:
    return (W.mix(b.astype(_U) + _U(1)) % _U(BUCKETS)).astype(np.int64)


def _unique(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate(keys), return_inverse=True)
    return keys, np.bincount(at, np.concatenate(counts), len(keys)).astype(np.int64)


def group_texts(a: np.ndarray, b: np.ndarray, of_a, of_b, ends, text, n: int) -> list[str]:
    """`a1,a2|b1;a3|b2,b3` for each of n texts."""
    if not len(of_a):
        return [""] * n
    group = np.cumsum(ends) - ends
    ga, gb = np.empty(len(a), np.int64), np.empty(len(b), np.int64)
    ga[of_a], gb[of_b] = group, group
    # a group's A tokens, then its B tokens: each follows all tokens of earlier groups
    before_b = np.searchsorted(gb, ga)
    before_a = np.searchsorted(ga, gb, side="right")
    ids, mark = np.empty(len(a) + len(b), np.int64), np.zeros(len(a) + len(b), np.int64)
    at_a, at_b = np.arange(len(a)) + before_b, np.arange(len(b)) + before_a
    ids[at_a], ids[at_b] = a, b
    last_a, last_b = np.append(ga[1:] != ga[:-1], True), np.append(gb[1:] != gb[:-1], True)
    mark[at_a[last_a]], mark[at_b[last_b]] = 1, 2
    names = _names(int(ids.max()) + 1)
    ta, tb = np.empty(len(a), np.int64), np.empty(len(b), np.int64)
    ta[of_a], tb[of_b] = text, text
    upto = np.cumsum(np.bincount(ta, minlength=n) + np.bincount(tb, minlength=n)).tolist()
    parts = names[mark, ids].tolist()
    out, lo = [], 0
    for hi in upto:
        out.append("".join(parts[lo:hi])[:-1])
        lo = hi
    return out


@cache
def _names_of(bits: int) -> np.ndarray:
    return np.array([[f"{k}{sign}" for k in range(1 << bits)] for sign in ",|;"], object)


def _names(n: int) -> np.ndarray:
    return _names_of(max(10, (n - 1).bit_length()))


# ---- minimal perfect hash


class PerfectHash:
    """A minimal perfect hash of distinct keys: level by level, keys whose bit no other key takes stay, the rest go on."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, upto = [], 0
        for bits in levels:
            self.ranks.append(np.cumsum(bits) - bits + upto)
            upto += int(bits.sum())

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (W.mix(keys + _U(0x9E3779B97F4A7C15 * (2 * level + 1) % 2**64)) % _U(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels = []
        while len(keys):
            size = GAMMA * len(keys) + 1
            at = cls._at(keys, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            keys = keys[~alone[at]]
        return cls(levels)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's index; a key that was not there at the build has any index, or -1."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, rank) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = self._at(keys[left], level, len(bits))
            hit = bits[at]
            out[left[hit]] = rank[at[hit]]
            left = left[~hit]
            if not len(left):
                break
        return out

    def dump(self) -> bytes:
        sizes = np.array([len(self.levels), *map(len, self.levels)], "<i8").tobytes()
        return sizes + b"".join(np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def load(cls, data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data, "<i8", 1)[0])
        sizes, at, levels = np.frombuffer(data, "<i8", n, 8), 8 + 8 * n, []
        for s in sizes.tolist():
            w = (s + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, w, at), count=s).astype(bool))
            at += w
        return cls(levels)


# ---- Spark


def encoded(docs: DataFrame, text: str, keep: list[str], path_a: str, path_b: str) -> DataFrame:
    """The kept columns with ids `a` and `b` (32-bit little-endian); then rows (bucket, keys, counts) of the tasks' linked pairs, null elsewhere."""
    names, at = keep, docs.columns.index(text)
    order = [docs.columns.index(c) for c in keep]
    schema = T.StructType([*[T.StructField(c, docs.schema[c].dataType) for c in keep], *T.StructType.fromDDL("a binary, b binary, bucket int, keys binary, counts binary")])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc_a, enc_b, va, vb = encoder_a(path_a), encoder_b(path_b), Vocabulary(bytes_a(path_a)), Vocabulary(bytes_b(path_b))
        held: list[tuple[np.ndarray, np.ndarray]] = []
        weight, kinds = 0, None

        def lists() -> pa.RecordBatch:
            keys, counts = _unique(*zip(*held, strict=True))
            bucket = _bucket(keys % _U(len(vb.size)))
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))
            some = [k for k in range(BUCKETS) if cuts[k] < cuts[k + 1]]
            at = [order[cuts[k] : cuts[k + 1]] for k in some]
            own = [pa.nulls(len(some), t) for t in kinds]
            return pa.RecordBatch.from_arrays([*own, pa.nulls(len(some), pa.binary()), pa.nulls(len(some), pa.binary()), pa.array(some, pa.int32()), pa.array([keys[x].tobytes() for x in at], pa.binary()), pa.array([counts[x].tobytes() for x in at], pa.binary())], [*names, "a", "b", "bucket", "keys", "counts"])

        for batch in batches:
            own = batch.select(order)
            kinds = [c.type for c in own.columns]
            column = batch.column(at).cast(pa.binary())
            for lo, hi, data, offs in W.slices(column, TEXTS):
                texts = [data[x:y].tobytes() for x, y in zip(offs[:-1], offs[1:], strict=True)]
                plain = [t.decode() for t in texts]
                a, b = enc_a([" " + t for t in plain]), enc_b(plain)
                for k, t in enumerate(texts):
                    if not t or va.joined(a[k]).tobytes() != b" " + t or vb.joined(b[k]).tobytes() != b" " + t:
                        a[k] = b[k] = np.empty(0, np.uint32)
                ids_a, ids_b, of_a, of_b, *_ = _batch(a, b, va, vb)
                if len(of_a):
                    keys, counts = np.unique(pair_keys(ids_a[of_a], ids_b[of_b], vb), return_counts=True)
                    held.append((keys, counts))
                    weight += len(keys)
                if weight > HELD:
                    held = [_unique(*zip(*held, strict=True))]
                    weight = len(held[0][0])
                    if 2 * weight > HELD:
                        yield lists()
                        held, weight = [], 0
                rows, none = hi - lo, pa.nulls(hi - lo, pa.binary())
                yield pa.RecordBatch.from_arrays([*own.slice(lo, rows).columns, *[pa.array([x.astype("<u4").tobytes() for x in side], pa.binary()) for side in (a, b)], pa.nulls(rows, pa.int32()), none, none], [*names, "a", "b", "bucket", "keys", "counts"])
        if held:
            yield lists()

    return docs.mapInArrow(W.tidy(each), schema)


def _list(t: pa.Table, k: int, kind: str, column: str) -> np.ndarray:
    return np.frombuffer(t[column][k].as_py(), kind)


def _levels(lists: DataFrame) -> list[int]:
    """How many nodes a bucket has at each level of the tree, down to one."""
    most = lists.groupBy("bucket").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    out = [max(1, -(-most // FAN))]
    while out[-1] > 1:
        out.append(-(-out[-1] // FAN))
    return out


def perfect_hashes(lists: DataFrame, levels: list[int]) -> DataFrame:
    """(bucket, hash, keys): for each bucket, the hash of its distinct pairs, and the pairs by index; lists: (bucket, node, keys, counts)."""

    def merge(last: bool):
        def each(t: pa.Table) -> pa.Table:
            keys = np.unique(np.concatenate([_list(t, k, "<u8", "keys") for k in range(len(t))]))
            blob = b""
            if last:
                found = PerfectHash.build(keys)
                placed = np.empty_like(keys)
                placed[found.find(keys)] = keys
                keys, blob = placed, found.dump()
            return pa.table([pa.array([t["bucket"][0].as_py()], pa.int32()), pa.array([t["node"][0].as_py()], pa.int32()), pa.array([keys.tobytes()], pa.binary()), pa.array([blob], pa.binary())], ["bucket", "node", "keys", "hash"])

        return each

    nodes = lists.select("bucket", "node", "keys")
    for k, n in enumerate(levels):
        nodes = nodes.withColumn("node", (F.col("node") % n).cast("int")).groupBy("bucket", "node").applyInArrow(merge(k == len(levels) - 1), "bucket int, node int, keys binary, hash binary")
        if n > 1:
            nodes = W.cut(nodes).drop("hash")
    return nodes.select("bucket", "hash", "keys")


def dense_counts(lists: DataFrame, hashes: DataFrame, levels: list[int], n_b: int) -> DataFrame:
    """(bucket, hash, keys, counts, best): the hashes with the pairs' counts, and whether a pair's count is the highest of its B id, by index."""
    nodes = F.explode(F.sequence(F.lit(0), F.lit(levels[0] - 1)))  # literals are int, as node is
    own = lists.withColumn("node", (F.col("node") % levels[0]).cast("int")).select("bucket", "node", "keys", "counts")

    def dense(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return pa.table([pa.array([], pa.int32()), pa.array([], pa.int32()), pa.array([], pa.binary())], ["bucket", "node", "counts"])
        find, total = PerfectHash.load(right["hash"][0].as_py()).find, np.zeros(len(_list(right, 0, "<u8", "keys")), "<i8")
        for k in range(len(left)):
            total[find(_list(left, k, "<u8", "keys"))] += _list(left, k, "<i8", "counts")
        return pa.table([pa.array([left["bucket"][0].as_py()], pa.int32()), pa.array([left["node"][0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["bucket", "node", "counts"])

    def summed(t: pa.Table) -> pa.Table:
        total = sum(_list(t, k, "<i8", "counts") for k in range(len(t)))
        return pa.table([pa.array([t["bucket"][0].as_py()], pa.int32()), pa.array([t["node"][0].as_py()], pa.int32()), pa.array([total.astype("<i8").tobytes()], pa.binary())], ["bucket", "node", "counts"])

    shape = "bucket int, node int, counts binary"
    sums = own.groupBy("bucket", "node").cogroup(hashes.withColumn("node", nodes).groupBy("bucket", "node")).applyInArrow(dense, shape)
    for n in levels[1:]:
        sums = W.cut(sums).withColumn("node", (F.col("node") % n).cast("int")).groupBy("bucket", "node").applyInArrow(summed, shape)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for keys, counts in zip(b.column(2), b.column(3), strict=True):
                keys, counts = np.frombuffer(keys.as_py(), "<u8"), np.frombuffer(counts.as_py(), "<i8")
                own = (keys % _U(n_b)).astype(np.int64)
                most = np.zeros(n_b, np.int64)
                np.maximum.at(most, own, counts)
                out.append((counts == most[own]).tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary()), pa.array([len(x) for x in out], pa.int64())], [*b.schema.names, "best", "n"])

    return hashes.join(sums.select("bucket", "counts"), "bucket").select("bucket", "hash", "keys", "counts").mapInArrow(W.tidy(marked), "bucket int, hash binary, keys binary, counts binary, best binary, n bigint")


class Counts:
    """Look-up of pairs in the buckets of a slice."""

    def __init__(self, rows: list[tuple]):
        self.of = {bucket: (PerfectHash.load(h), np.frombuffer(keys, "<u8"), np.frombuffer(counts, "<i8"), np.frombuffer(best, bool)) for bucket, h, keys, counts, best in rows}

    def find(self, keys: np.ndarray, n_b: int) -> tuple[np.ndarray, np.ndarray]:
        """(count, whether it is the highest of the B id) of each key; 0 for keys that are not there."""
        count, best = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        bucket = _bucket(keys % _U(n_b))
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))
        for k, (find, own, counts, marks) in self.of.items():
            mine = order[cuts[k] : cuts[k + 1]]
            if len(mine):
                at = find.find(keys[mine])
                there = (at >= 0) & (own[at] == keys[mine])
                count[mine[there]], best[mine[there]] = counts[at[there]], marks[at[there]]
        return count, best


def _looked_up(rows: DataFrame, keep: list[str], whole: bool, counts: list[tuple], path_a: str, path_b: str) -> DataFrame:
    """The kept columns with each row's alignment by the pairs in counts; whole: with its groups."""
    shared = rows.sparkSession.sparkContext.broadcast(counts)
    schema = T.StructType([*rows.select(*keep).schema, *T.StructType.fromDDL(", ".join(f"{c} {kind}" for c, kind in OUT.items()))])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        va, vb, table = Vocabulary(bytes_a(path_a)), Vocabulary(bytes_b(path_b)), Counts(shared.value)
        for batch in batches:
            for lo, hi, data, offs in W.slices(batch.column("a"), 2 * TEXTS):
                part = batch.slice(lo, hi - lo)
                a = [np.frombuffer(data[x:y].tobytes(), "<u4") for x, y in zip(offs[:-1], offs[1:], strict=True)]
                b = [np.frombuffer(x.as_py(), "<u4") for x in part.column("b")]
                ids_a, ids_b, of_a, of_b, ends, text = _batch(a, b, va, vb)
                n = len(a)
                keys, at = np.unique(pair_keys(ids_a[of_a], ids_b[of_b], vb), return_inverse=True)
                count, best = table.find(keys, len(vb.size))
                add = lambda x: pa.array(np.bincount(text, x, n).astype(np.int64))
                # sums of counts by whole numbers: a float sum is exact below 2 ** 53 only
                sums = np.zeros(n, np.int64)
                np.add.at(sums, text, count[at])
                done = [pa.array([len(x) for x in a], pa.int64()), pa.array([len(x) for x in b], pa.int64()), add(ends), add(None), add(best[at]), pa.array(sums), pa.array(group_texts(ids_a, ids_b, of_a, of_b, ends, text, n) if whole else [""] * n, pa.string())]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], *done], [*keep, *OUT])

    return rows.mapInArrow(W.tidy(each), schema)


def align(docs: DataFrame, path_a: str, path_b: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The rows with n_a, n_b (tokens), n_groups, n_links, n_best, count_sum and groups (`a1,a2|b1;a3|b2,b3`).

    n_best: links whose pair is linked most often of all pairs with its B id, ties included;
    count_sum: the sum over links of how often their pair is linked in all rows.  keep: the columns
    kept, by default all.
    """
    spark = docs.sparkSession
    W.small_batches(spark)
    own = free_prefix(docs)
    docs = docs.drop(*OUT)
    kept = [c for c in docs.columns if keep is None or c in keep]
    names = [f"{own}{k}" for k in range(len(kept))]  # columns of any names beside a, b, bucket, keys, counts
    named = docs.select(*[docs[c].alias(n) for c, n in zip(kept, names, strict=True)], docs[text].alias(f"{own}text"))
    both = W.cut(encoded(named, f"{own}text", names, path_a, path_b), "zstd")
    lists = both.filter("bucket IS NOT NULL").select("bucket", F.shiftrightunsigned(F.xxhash64("keys", "counts"), 1).alias("node"), "keys", "counts")
    levels = _levels(lists)
    n_b = len(bytes_b(path_b))
    hashes = W.cut(perfect_hashes(lists, levels))
    table = W.cut(dense_counts(lists, hashes, levels, n_b))
    rows = both.filter("bucket IS NULL").drop("bucket", "keys", "counts")
    slices, room = [[]], 0
    for r in table.select("bucket", "n").orderBy("bucket").collect():  # BUCKETS rows
        if room + r["n"] > SLICE and slices[-1]:
            slices.append([])
            room = 0
        slices[-1].append(r["bucket"])
        room += r["n"]
    key = f"{own}key"
    if len(slices) > 1:
        rows = W.cut(rows.withColumn(key, F.monotonically_increasing_id()), "zstd")
    out = more = None
    for k, mine in enumerate(slices):
        found = [tuple(r) for r in table.filter(F.col("bucket").isin(mine)).select("bucket", "hash", "keys", "counts", "best").collect()] if mine else []
        done = _looked_up(rows, [key] if k else [c for c in rows.columns if c not in ("a", "b")], not k, found, path_a, path_b)
        if not k:
            out = done
        else:
            done = done.select(key, "n_best", "count_sum")
            more = done if more is None else more.unionByName(done)
    if more is not None:
        more = more.groupBy(key).agg(F.sum("n_best").alias("more_best"), F.sum("count_sum").alias("more_sum"))
        out = out.join(more, key).withColumns({"n_best": F.col("n_best") + F.col("more_best"), "count_sum": F.col("count_sum") + F.col("more_sum")})
    return out.select(*[F.col(n).alias(c) for c, n in zip(kept, names, strict=True)], *OUT)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the alignment of every document, with its groups hashed."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])
    hashed = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return done.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", hashed.alias("groups_sha256"))
