"""Near-duplicate vectors of one label by PCA-ordered, tiled comparison, exact, with components.

1. Rows of equal label and equal vector are one group, found by an aggregation; a group is compared
   once and counts for all its rows, so that a vector with a million copies costs what one costs.
2. The second moments of all unit vectors, summed over the tasks, give the principal axes: one
   rotation that keeps every product, after which the leading coordinates carry most of it.
3. A label's groups are dealt into bands of the first coordinate that are as wide as two vectors at
   the threshold can be apart, and a band, by hash, into blocks of about BLOCK.  Two blocks of a
   band, or of neighbouring bands, are a tile; every pair that may link is in exactly one tile.
4. A tile accumulates products over STEPS of leading coordinates.  What the others can still add is
   at most the product of the two suffix norms; pairs that cannot reach the threshold are left, and
   a piece of a tile stops when none can.  Cosines within NEAR of the threshold are taken again from
   the vectors as given.
5. A tile gives each vector's number of links and a star for each of its components, not its pairs.
   Components of the stars follow by alternating stars.

Vectors that are null, empty, all zero, or hold a null, NaN or infinite component, and rows with a
null label, link with nothing; so do vectors of different lengths.  Rows that repeat a vec_id are
vectors of their own, with a row each; a row without a vec_id comes after all others in order, and
is kept if it is the first of its component; a component of only such rows has no id.  An empty
table gives no rows.  Only the three named columns are read, so others may have any name.

The work in a label of n distinct vectors grows as n * n (less what bands and suffix norms save):
the result is exact, and each vector is moved once for each BLOCK others that its bands hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .jaccard import components

THRESHOLD = 0.93
#: Vectors in a block, and in a piece of a tile that is compared at once.
BLOCK, PIECE = 4096, 512
#: Leading coordinates after which pairs are left.
STEPS = (8, 16, 32, 64, 128, 256, 512)
#: Cosines so near the threshold are computed again from the vectors as given.
NEAR = 1e-9
#: Pairs of a piece that are followed one by one are at most one in so many.
SPARSE = 32


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def groups(rows: DataFrame) -> DataFrame:
    """(label, vector, first, copies): the distinct vectors that may link, from (row_key, label, vector)."""
    double = F.transform("vector", lambda x: x.cast("double"))
    fit = rows.filter("label IS NOT NULL AND size(vector) > 0").filter(F.forall(double, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(double, lambda x: x != 0))
    return fit.groupBy("label", "vector").agg(F.min("row_key").alias("first"), F.count("*").alias("copies"))


def moments(vectors: DataFrame) -> DataFrame:
    """(size, at, value): for each length, the sum over all unit vectors of x_i * x_j, at i * size + j."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            lengths = b.column(0).value_lengths().to_numpy()
            for size in np.unique(lengths).tolist():
                x = unit(_matrix(b.column(0).filter(pa.array(lengths == size))))
                total[size] = total.get(size, 0) + x.T @ x
        for size, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m.size, size, np.int32)), pa.array(np.arange(m.size)), pa.array(m.ravel())], ["size", "at", "value"])

    return vectors.select("vector").mapInArrow(W.tidy(each), "size int, at bigint, value double").groupBy("size", "at").agg(F.sum("value").alias("value"))


def axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each length of vectors, its principal axes as columns, the strongest first; size * size numbers each reach the driver."""
    found: dict[int, np.ndarray] = {}
    for r in moments(vectors).toLocalIterator():
        found.setdefault(r["size"], np.zeros(r["size"] ** 2))[r["at"]] = r["value"]
    return {size: np.linalg.eigh(m.reshape(size, size))[1][:, ::-1] for size, m in found.items()}


def _least(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Gives both ends of each link the smaller label, until all linked have one."""
    while True:
        a, b = labels[i], labels[j]
        differ = a != b
        if not differ.any():
            return
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        low = np.minimum(a, b)
        np.minimum.at(labels, np.maximum(a, b), low)
        while (labels != labels[labels]).any():
            labels[:] = labels[labels]


def _piece(za, zb, sa, sb, ua, ub, steps: tuple[int, ...], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (row of a, row of b) with a cosine of threshold at least.

    za, zb: rotated vectors; sa, sb: their suffix norms by step; ua, ub: unit vectors as given.
    """
    least, lo, dense = threshold - NEAR, 0, None
    i = j = part = None
    for k, hi in enumerate(steps):
        if i is None:
            new = za[:, lo:hi] @ zb[:, lo:hi].T
            dense = new if dense is None else dense + new
            alive = dense + np.outer(sa[k], sb[k]) >= least
            n = np.count_nonzero(alive)
            if n * SPARSE <= alive.size:
                i, j = np.nonzero(alive)
                part, dense = dense[i, j], None
        else:
            part = part + np.einsum("ij,ij->i", za[i, lo:hi], zb[j, lo:hi])
            alive = part + sa[k][i] * sb[k][j] >= least
            i, j, part = i[alive], j[alive], part[alive]
        if i is not None and not len(i):
            return i, j
        lo = hi
    if i is None:
        i, j = np.nonzero(dense >= least)
        part = dense[i, j]
    near = np.abs(part - threshold) <= NEAR
    part[near] = np.einsum("ij,ij->i", ua[i[near]], ub[j[near]])
    alive = part >= threshold
    return i[alive], j[alive]


def compare(a: tuple[np.ndarray, np.ndarray, np.ndarray], b: tuple | None, turn: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids with links, their links' copies, ids, the first of their component in the tile); a, b: ids, copies, vectors; b None: a with itself."""
    ids = a[0] if b is None else np.concatenate([a[0], b[0]])
    copies = a[1] if b is None else np.concatenate([a[1], b[1]])
    u = unit(a[2] if b is None else np.concatenate([a[2], b[2]]))
    z = u @ turn
    size, first = z.shape[1], 0 if b is None else len(a[0])
    steps = (*[s for s in STEPS if s < size], size)
    rest = np.cumsum((z * z)[:, ::-1], 1)[:, ::-1]
    suffix = [np.sqrt(rest[:, s]) if s < size else np.zeros(len(z)) for s in steps]
    links, labels = np.zeros(len(ids), np.int64), np.arange(len(ids))
    for x in range(0, len(a[0]), PIECE):
        rows = slice(x, min(x + PIECE, len(a[0])))
        for y in range(x if b is None else first, len(ids), PIECE):
            cols = slice(y, y + PIECE)
            i, j = _piece(z[rows], z[cols], [s[rows] for s in suffix], [s[cols] for s in suffix], u[rows], u[cols], steps, threshold)
            i, j = i + x, j + y
            if b is None and x == y:
                i, j = i[i < j], j[i < j]
            if len(i):
                links += np.bincount(i, copies[j], len(ids)).astype(np.int64) + np.bincount(j, copies[i], len(ids)).astype(np.int64)
                _least(labels, i, j)
    some, child = links > 0, labels != np.arange(len(ids))
    return ids[some], links[some], ids[child], ids[labels[child]]


def tiles(blocks: DataFrame, threshold: float, turn: dict[int, np.ndarray]) -> DataFrame:
    """(a, n, b): number n of links that vector a has in a tile, or, n null, a link from a to b.

    blocks: (space, band, block, of, below, above, ids, copies, vectors), one row a block; of, below
    and above are the numbers of blocks in its band and the two beside it.
    """
    shared = blocks.sparkSession.sparkContext.broadcast(turn)
    counter = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    block = F.col("block")

    def tile(band, x, y, cross):
        return F.struct(band.alias("band"), x.cast("int").alias("x"), y.cast("int").alias("y"), F.lit(cross).alias("cross"))

    mine = F.concat(
        F.transform(counter(F.col("of")), lambda k: tile(F.col("band"), F.least(block, k), F.greatest(block, k), False)),
        F.transform(counter(F.col("above")), lambda k: tile(F.col("band"), block, k, True)),
        F.transform(counter(F.col("below")), lambda k: tile(F.col("band") - 1, k, block, True)),
    )
    placed = blocks.withColumn("tile", F.explode(mine)).select("space", "tile", "band", "block", "ids", "copies", "vectors")
    schema = pa.schema([("a", pa.int64()), ("n", pa.int64()), ("b", pa.int64())])

    def join(t: pa.Table) -> pa.Table:
        rows = sorted(t.select(["band", "block", "ids", "copies", "vectors"]).to_pylist(), key=lambda r: (r["band"], r["block"]))
        sides = []
        for r in rows:
            ids, copies = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["copies"], "<i8")
            sides.append((ids, copies, np.frombuffer(r["vectors"], "<f8").reshape(len(ids), -1)))
        cross = t["tile"][0].as_py()
        if len(sides) == 1 and (cross["cross"] or cross["x"] != cross["y"]):
            return schema.empty_table()  # the other block is empty
        ids, links, a, b = compare(sides[0], sides[1] if len(sides) == 2 else None, shared.value[sides[0][2].shape[1]], threshold)
        none_n, none_b = np.arange(len(ids) + len(a)) >= len(ids), np.arange(len(ids) + len(a)) < len(ids)
        zero = np.zeros
        out = [pa.array(np.concatenate([ids, a])), pa.array(np.concatenate([links, zero(len(a), np.int64)]), mask=none_n), pa.array(np.concatenate([zero(len(ids), np.int64), b]), mask=none_b)]
        W.release()
        return pa.Table.from_arrays(out, schema=schema)

    return placed.groupBy("space", "tile").applyInArrow(join, "a bigint, n bigint, b bigint")


def in_blocks(vectors: DataFrame, threshold: float, turn: dict[int, np.ndarray]) -> DataFrame:
    """The rows of tiles(), from (id, label, vector, copies) with ids that stay."""
    width = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6
    shared = vectors.sparkSession.sparkContext.broadcast({size: t[:, 0] for size, t in turn.items()})

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths, column = b.column(3).value_lengths().to_numpy(), b.column(3)
            band, raw = np.zeros(b.num_rows, np.int64), np.empty(b.num_rows, object)
            for size in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == size)
                x = _matrix(column.take(pa.array(at)))
                band[at] = np.floor(unit(x) @ shared.value[size] / width)
                raw[at] = [r.tobytes() for r in x]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(lengths.astype(np.int32)), pa.array(band), pa.array(raw, pa.binary())], ["id", "copies", "label", "size", "band", "vector"])

    kind = vectors.schema["label"].dataType.simpleString()
    flat = vectors.select("id", "copies", "label", "vector").mapInArrow(W.tidy(banded), f"id bigint, copies bigint, label {kind}, size int, band bigint, vector binary")
    flat = W.cut(flat.withColumn("space", F.struct("label", "size")).drop("label", "size"))
    of = W.cut(flat.groupBy("space", "band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("of")))

    def beside(step: int, name: str) -> DataFrame:
        return of.select("space", (F.col("band") + step).alias("band"), F.col("of").alias(name))

    bands = W.cut(of.join(beside(1, "below"), ["space", "band"], "left").join(beside(-1, "above"), ["space", "band"], "left").fillna(0, ["below", "above"]))
    dealt = flat.join(bands, ["space", "band"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("of")).cast("int"))

    def packed(t: pa.Table) -> pa.Table:
        def one(c):
            return pa.array([t[c].to_numpy().astype("<i8").tobytes()], pa.binary())

        first = t.slice(0, 1)
        return pa.Table.from_arrays([*[first[c].combine_chunks() for c in keys], one("id"), one("copies"), pa.array([b"".join(t["vector"].to_pylist())], pa.binary())], schema=schema)

    keys = ["space", "band", "block", "of", "below", "above"]
    fields = dealt.select(*keys).schema
    sql = f"space {fields['space'].dataType.simpleString()}, band bigint, block int, of int, below int, above int, ids binary, copies binary, vectors binary"
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = pa.schema([*to_arrow_schema(fields), ("ids", pa.binary()), ("copies", pa.binary()), ("vectors", pa.binary())])
    blocks = dealt.groupBy("space", "band", "block").applyInArrow(packed, sql)
    return tiles(blocks, threshold, turn)


def near_duplicate_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    W.small_batches(rows.sparkSession)
    keyed, top = W.with_keys(rows.select(rows[vec_id].alias("vec_id"), rows[vector].alias("vector"), rows[label].alias("label")), "vec_id")
    mine = W.cut(groups(keyed).withColumn("id", F.monotonically_increasing_id()))
    turn = axes(mine)
    found = W.cut(in_blocks(mine, threshold, turn))
    links = found.filter("n IS NOT NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    whole = components(found.filter("n IS NULL").select("a", "b")).select(F.col("doc_id").alias("id"), F.col("component_id").alias("part"))
    parts = W.cut(mine.select("id", "label", "vector", "first", "copies").join(links, "id", "left").join(whole, "id", "left").withColumn("part", F.coalesce("part", "id")))
    firsts = parts.groupBy("part").agg(F.min("first").alias("component"))
    # a plain table, so that Spark can split the join of a vector with many copies
    done = W.cut(parts.join(firsts, "part").select("label", "vector", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component"))
    out = keyed.join(done, ["label", "vector"], "left").select("row_key", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "row_key").alias("component"))
    return out.select(W.without_keys(F.col("row_key"), top).alias("vec_id"), "n_links", W.without_keys(F.col("component"), top).alias("component_id"), (F.col("row_key") == F.col("component")).alias("kept"))


def op11_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: links and component of every vector."""
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
