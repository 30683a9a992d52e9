"""The trie of conversation prefixes: count-min screening, then exact grouping of what may be shared.

A node is a distinct sequence of first turns; what its subtree would save if each shared prefix were
kept once is summed up on it.

1. Turns become digests of (role, text) and text lengths in Spark, before anything is shuffled.  A
   chain of digests names a prefix: the key of d turns is a hash of the key of d - 1 and turn d.
2. A count-min sketch of all keys, saturated at two, is built in the tasks and merged by blocks of
   cells.  Estimates are never too low: a key estimated at one is a singleton, whose whole subtree is
   one conversation's tail.  Its node is made where it stands and never shuffled; only keys that
   may be shared go on.  The sketch has at most 2 ** MOST_BITS cells a row: a larger corpus lets
   more singletons through, which costs time and changes no result.
3. Keys that may be shared are grouped, with partial aggregation, so that a first turn that a third
   of all conversations have is a few rows.
4. Sums over subtrees need no walk of the tree.  Each node is owned by its smallest member; an owner's
   nodes are the end of its path, and every node lies on its owner's path.  So a node's subtree sum is
   the sum, over its members, of what they own at its depth or deeper: one window by conversation,
   one aggregation by key.
5. Ids of conversations that end in one node are joined in order within ranges of ids, then hashed
   range after range, so that a conversation with many copies is not one group.

Rows without a conv_id belong to no conversation.  Turns come in order of turn (null first), equal
ones by role and then by the digest of role and text; null roles and texts are empty.  Repeated rows
are turns of their own.  An empty table has no nodes.  Further columns are not read.  A conversation
is streamed in order by one task, which keeps its first HEAD turns; its length is not bounded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words as W

#: Hash rows of the sketch; cells a key in each; log2 of the most cells in a row; log2 of those in a block.
ROWS, CELLS, MOST_BITS, BLOCK_BITS = 2, 8, 28, 16
#: Conversations of this many ids in a row are joined at once for ends_sha256.
END_RANGE = 4096
#: The key of no turns.
ROOT = bytes(16)
_U = np.uint64


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, bytes): 16 bytes of SHA-256 of role and text, and the text's length in UTF-8."""
    role, text = (F.coalesce(conversations[c].cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)
    rows = conversations.filter(conversations["conv_id"].isNotNull())
    return rows.select(rows["conv_id"].cast("long").alias("conv_id"), rows["turn"].alias("turn"), role.alias("role"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))


def chained(rows: DataFrame, base: Column, head: Column, most: int) -> DataFrame:
    """(conv_id, depth, key, parent, bytes, last): the prefixes of each conversation, depth 0 included.

    A conversation is the first `head` turns of conversation `base`, then its own turns after its
    first `head`; base and head are columns of conv_id, head is at most `most`.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("key", pa.binary()), ("parent", pa.binary()), ("bytes", pa.int64()), ("last", pa.bool_())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        base, first, conv = None, [], None  # of the group: its base's first turns, as many as may be asked for
        left = depth = 0
        key = ROOT
        held: tuple | None = None  # the last prefix made, as only the next row tells whether it is the last

        def push(digest: bytes, size: int) -> None:
            nonlocal key, depth, held
            out.append((*held, False))
            parent, key, depth = key, hashlib.blake2b(key + digest, digest_size=16).digest(), depth + 1
            held = (conv, depth, key, parent, size)

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)

        for b in batches:
            for at, own, heads, digest, size in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                if at != base:
                    base, first = at, []
                if own != conv:
                    if held:
                        out.append((*held, True))
                    conv, left, depth, key = own, heads, 0, ROOT
                    held = (conv, 0, ROOT, None, 0)
                    start = own != at  # the base itself takes its head turns from its own rows
                    if start:
                        for d, n in first[:heads]:
                            push(d, n)
                if own == at and len(first) < most:
                    first.append((digest, size))
                if own == at or left == 0:
                    push(digest, size)
                else:
                    left -= 1
                if len(out) >= 5000:
                    yield batch()
        if held:
            out.append((*held, True))
        if out:
            yield batch()

    dealt = rows.withColumns({"base": base, "head": head.cast("int")}).repartition("base")
    dealt = dealt.sortWithinPartitions("base", F.col("conv_id") != F.col("base"), "conv_id", "turn", "role", "digest")
    return dealt.select("base", "conv_id", "head", "digest", "bytes").mapInArrow(W.tidy(each), "conv_id bigint, depth bigint, key binary, parent binary, bytes bigint, last boolean")


def _cells(column: pa.Array, bits: int) -> list[np.ndarray]:
    """The cell of each key in each row of the sketch."""
    raw = np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, 2)
    return [(W.mix(raw[:, k % 2] + _U(k)) >> _U(64 - bits)).astype(np.int64) for k in range(ROWS)]


def sketch(keys: DataFrame, bits: int) -> DataFrame:
    """(part, twice): blocks of the count-min sketch, as bitmaps of the cells that count two or more; blocks without such cells are absent."""
    block, parts = 1 << min(BLOCK_BITS, bits), 1 << max(0, bits - BLOCK_BITS)
    schema = pa.schema([("part", pa.int64()), ("once", pa.binary()), ("twice", pa.binary())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = (np.zeros((ROWS, 1 << bits), bool) for _ in range(2))
        for b in batches:
            for row, cells in enumerate(_cells(b.column(0), bits)):
                own, n = np.unique(cells, return_counts=True)
                twice[row, own[(n > 1) | once[row, own]]] = True
                once[row, own] = True
        for row in range(ROWS):
            for k in np.flatnonzero(once[row].reshape(parts, block).any(1)).tolist():
                span = slice(k * block, (k + 1) * block)
                yield pa.RecordBatch.from_arrays([pa.array([row * parts + k]), *[pa.array([np.packbits(x[row, span]).tobytes()]) for x in (once, twice)]], schema=schema)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for part, one, two in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                one, two = (np.frombuffer(x, np.uint8) for x in (one, two))
                have = done.setdefault(part, [np.zeros(len(one), np.uint8), np.zeros(len(one), np.uint8)])
                have[1] |= two | have[0] & one
                have[0] |= one
        for part, (_, two) in done.items():
            if two.any():
                yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([two.tobytes()])], ["part", "twice"])

    each = keys.mapInArrow(W.tidy(counted), "part bigint, once binary, twice binary")
    return each.repartition("part").mapInArrow(W.tidy(merged), "part bigint, twice binary")


def screened(prefixes: DataFrame) -> DataFrame:
    """The prefixes with `shared` and `above`: whether the key, and its parent's, may be held by two conversations."""
    n = prefixes.count()
    bits = min(MOST_BITS, max(10, int(n * CELLS).bit_length()))
    parts, size = 1 << max(0, bits - BLOCK_BITS), (1 << min(BLOCK_BITS, bits)) // 8
    found = np.zeros((ROWS * parts, size), np.uint8)  # 2 ** MOST_BITS bits a row at most: 64 MB
    for r in sketch(prefixes.filter("depth > 0").select("key"), bits).toLocalIterator():
        found[r["part"]] = np.frombuffer(r["twice"], np.uint8)
    bitmaps = prefixes.sparkSession.sparkContext.broadcast(found.reshape(ROWS, -1))
    schema = prefixes.withColumns({"shared": F.lit(True), "above": F.lit(True)}).schema

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            depth = b.column("depth").to_numpy()
            more = []
            for column, least in (("key", 1), ("parent", 2)):  # the root is shared by all
                out = np.ones(b.num_rows, bool)
                for row, cells in enumerate(_cells(b.column(column).fill_null(ROOT), bits)):
                    out &= (bitmaps.value[row, cells >> 3] >> (7 - (cells & 7)).astype(np.uint8) & 1).astype(bool)
                more.append(pa.array(out | (depth < least)))
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, "shared", "above"])

    return prefixes.mapInArrow(W.tidy(each), schema)


def ends(rows: DataFrame) -> DataFrame:
    """(key, ends_sha256): the hash of the ids, in order and comma-joined, of conversations (key, conv_id) that end in a key."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    pieces = rows.groupBy("key", F.floor(F.col("conv_id") / END_RANGE).alias("range")).agg(ids.alias("ids"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = digest = None
        for b in batches:
            done = []
            for own, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if own == key:
                    digest.update(b"," + ids.encode())
                else:
                    if key is not None:
                        done.append((key, digest.hexdigest()))
                    key, digest = own, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done], pa.string())], ["key", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()])], ["key", "ends_sha256"])

    return pieces.repartition("key").sortWithinPartitions("key", "range").select("key", "ids").mapInArrow(W.tidy(each), "key binary, ends_sha256 string")


def trie(prefixes: DataFrame) -> DataFrame:
    """The nodes of the prefixes that chained() gives."""
    spark = prefixes.sparkSession
    rows = W.cut(screened(W.cut(prefixes)))
    shared, alone = rows.filter("shared"), rows.filter("NOT shared")
    none = F.sha2(F.lit(b""), 256)

    # exact groups of what may be shared, and how many proved tails start below each
    tails = alone.filter("above").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("tails"))
    groups = shared.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent").alias("parent"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"))
    groups = W.cut(groups)
    below = groups.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("nodes"))
    counted = groups.join(tails, "key", "left").join(below, "key", "left").withColumn("n_children", F.coalesce("tails", F.lit(0)) + F.coalesce("nodes", F.lit(0)))
    counted = W.cut(counted.drop("tails", "nodes"))

    # what each conversation owns: savings and leaves at a depth; then, at each of its shared prefixes, the sum from there on
    owned = counted.select("conv_id", "depth", F.lit(None).cast("binary").alias("key"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saves"), F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaf")).filter("saves > 0 OR leaf > 0")
    tail_leaf = alone.filter("last").select("conv_id", "depth", F.lit(None).cast("binary").alias("key"), F.lit(0).cast("long").alias("saves"), F.lit(1).cast("long").alias("leaf"))
    paths = shared.select("conv_id", "depth", "key", F.lit(0).cast("long").alias("saves"), F.lit(0).cast("long").alias("leaf"))
    deeper = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    sums = paths.unionByName(owned).unionByName(tail_leaf).withColumns({"saves": F.sum("saves").over(deeper), "leaf": F.sum("leaf").over(deeper)}).filter("key IS NOT NULL")
    sums = sums.groupBy("key").agg(F.sum("saves").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))

    full = counted.join(sums, "key").join(ends(shared.filter("last").select("key", "conv_id")), "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", none))
    parent = counted.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    # a prefix that may be shared can stand below a proved one, if the estimate was too high: it is in the same conversation
    mine = full.join(parent, "parent", "left").withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "conv_id")))
    one = alone.withColumns({"n_convs": F.lit(1).cast("long"), "n_children": (~F.col("last")).cast("long"), "n_leaves": F.lit(1).cast("long"), "saved_tokens": F.lit(0).cast("long"), "ends_sha256": F.when(F.col("last"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(none)})
    inner = one.filter("NOT above").withColumn("parent_conv_id", F.col("conv_id"))
    heads = one.filter("above").join(parent, "parent", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "conv_id"))
    return mine.select(*names).unionByName(inner.select(*names)).unionByName(heads.select(*names))


def prefix_trie(conversations: DataFrame, base: Callable[[Column], Column] | None = None, head: Callable[[Column], Column] | None = None, most: int = 0) -> DataFrame:
    """The trie's nodes; base and head make conversations from others' heads (see chained()), by default each stands as it is."""
    spark = conversations.sparkSession
    W.small_batches(spark)
    conv = F.col("conv_id")
    return trie(chained(turns(conversations), base(conv) if base else conv, head(conv) if head else F.lit(0), most))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the trie of conversations whose first turns come from a fifth of them."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return prefix_trie(rows, lambda c: c - c % 5, lambda c: F.crc32(c.cast("string").cast("binary")) % 9, 8)
