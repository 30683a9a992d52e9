"""N-gram Jaccard join in metric space, exact, with connected components.

The Jaccard distance of shingle sets is a metric.  Documents are dealt into regions around pivot
documents, and each region is joined by its distances to its pivots:

1. Each set's shingles are put into one global order: rare ones first, by hash; shingles that many
   documents share come last, by their count.  Two sets that link share some of their first
   shingles (see shared_least); sets that share fewer with all others are alone.  The smallest
   document that holds a shared shingle is a pivot, and every other holder of a size that can link
   is placed in its region, so linked documents always meet in a region.  (Pivots that are picked
   at random from all documents cut nothing: almost all pairs lie at distance 1, so that no
   triangle inequality tells the cells apart.)
2. A region of at most PART documents is joined whole.  A larger one gets about PIVOTS pivots, and
   is dealt into parts that hold all its pivots; each part is joined whole and measures every
   document's distances to the pivots.  The pivots' Voronoi cells are the next regions: a document
   goes to its nearest pivot's cell and, as a boundary document, to the cell of each pivot that is
   at most 2 * 0.25 farther off, since a document within 0.25 of it may belong there.  In a cell
   only documents whose distances to its pivot differ by 0.25 or less can link (triangle
   inequality), so a cell is cut into windows of that distance, which overlap.
3. Documents that a part's links connect with a cell's pivot are settled there: two of them are in
   one component already, so a window needs a loose document to be joined again.  Windows recurse
   from step 2 if they halve the pairs of their region at least.  A region that distances don't cut
   so is joined in blocks: loose documents with all.  Nothing is dropped.

Regions emit a star of links for each component they find, not all pairs; components over the
links follow by alternating stars.  Exact copies are one set; those of the COPIES sets with most
copies, and copies within a task, are left out of the regions (the others meet there).  Null texts and texts without words have empty sets and link with nothing;
documents with fewer words than a shingle have one shingle, their whole sequence.  Shingles are
compared by 64-bit hashes.  Rows that repeat a doc_id are one document, which has the links of all
its rows and the size of the largest set.  Each row without a doc_id is a document of its own,
after all others in order; a component of only such documents has no id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words as W
from .names import free_prefix
from .substrings import doc_filter, split_docs

WIDTH = 5
#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Shingles that come last in the order: at most so many, broadcast (4 MB).
HOT_SHINGLES = 262_144
#: A shingle is counted as hot if so many documents hold it, of those that have so many shingles in all.
HOT_LEAST, HOT_WEIGHT = 4, 1_000_000
#: Percent of a set's size by which its prefix is longer, so that links need as many shared shingles.
EXTRA = 8
#: Documents and shingles joined at once (besides pivots, or twice in blocks).
PART, WEIGHT = 256, 300_000
#: Pivots of a region with more, on average.
PIVOTS = 4
#: Sets whose copies are left out early, by a broadcast (3 MB), and sets that a task remembers.
COPIES, SEEN = 131_072, 50_000


def shared_least(n):
    """How many of their first |x| - ceil(0.75 |x|) + shared_least(|x|) shingles two sets of n or more share if they link.

    Shingles left out of a prefix come after all of it in the one order, so the shared shingles that
    either prefix lacks are those that one of them lacks.
    """
    return 1 + EXTRA * n // 100


def _sets(data: np.ndarray, offs: np.ndarray, width: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text."""
    data = W.LOWER[data]
    starts, ends, firsts = W.spans(data, offs)
    h = W.hashes(data, starts, ends)
    grams = W.rolling(h, width)
    out = []
    for a, b in zip(firsts[:-1], firsts[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(grams[a : b - width + 1]))
        elif b > a:
            out.append(W.rolling(h[a:b], b - a) ^ np.uint64(0x5BD1E995 * (b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _set_hash(s: np.ndarray) -> tuple[int, int]:
    """A 128-bit hash of a set."""
    if not len(s):
        return 0, 0
    m = W.mix(s)
    return int(m.sum().view(np.int64)), int(W.mix(m + np.uint64(1)).sum().view(np.int64))


def survey(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n, h1, h2, shingle, docs): set size and hash of every document; and, with null doc_id, counts of shared shingles."""
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "n", "h1", "h2", "shingle", "docs")])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        weight = 0

        def count() -> pa.RecordBatch:
            s, n = np.unique(np.concatenate(held), return_counts=True)
            hot = n >= HOT_LEAST
            none = pa.nulls(int(hot.sum()), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, none, pa.array(s[hot].view(np.int64)), pa.array(n[hot].astype(np.int64))], schema=schema)

        for b in batches:
            rows: list[tuple[int, int, int]] = []
            for _, _, data, offs in W.slices(b.column(1)):
                new = _sets(data, offs, width)
                rows += [(len(s), *_set_hash(s)) for s in new]
                held += new
                weight += sum(map(len, new))
                if weight >= HOT_WEIGHT:
                    yield count()
                    held.clear()
                    weight = 0
            none = pa.nulls(len(rows), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *[pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], none, none], schema=schema)
        if held:
            yield count()

    return docs.mapInArrow(W.tidy(each), ", ".join(f"{x.name} bigint" for x in schema))


def signatures(docs: DataFrame, hot: np.ndarray, copied: dict[tuple[int, int], int], width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n, h1, h2, cold, warm): set size, a 128-bit hash of the set, and its necessary shingles.

    The necessary shingles are the prefix in the global order; warm are those of them in hot (the
    most frequent last), cold the others.  Both are null for a set that an earlier row of the same
    task has, and where copied has the set with another document.
    """
    shared = docs.sparkSession.sparkContext.broadcast((np.sort(hot), np.argsort(hot, kind="stable").astype(np.uint64), copied))
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("cold", pa.list_(pa.int64())), ("warm", pa.list_(pa.int64()))])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank, copied = shared.value
        seen: set[tuple[int, int]] = set()
        for b in batches:
            n, h1, h2, cold, warm = [], [], [], [], []
            ids = b.column(0).to_pylist()
            for _, _, data, offs in W.slices(b.column(1)):
                for s in _sets(data, offs, width):
                    key = _set_hash(s)
                    own = ids[len(n)]
                    n.append(len(s))
                    h1.append(key[0])
                    h2.append(key[1])
                    if not len(s) or key in seen or copied.get(key, own) != own:
                        cold.append(None)
                        warm.append(None)
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(key)
                    k = len(s) - -(-percent * len(s) // 100) + shared_least(len(s))
                    is_hot = np.zeros(len(s), bool)
                    if len(known):
                        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                        is_hot = known[at] == s
                    rare = s[~is_hot][:k]
                    cold.append(rare.view(np.int64))
                    warm.append(s[is_hot][np.argsort(rank[at[is_hot]])][: k - len(rare)].view(np.int64) if len(rare) < k else [])
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, pa.int64()) for x in (n, h1, h2)], *[pa.array(x, pa.list_(pa.int64())) for x in (cold, warm)]], schema=schema)

    return docs.mapInArrow(W.tidy(each), "doc_id bigint, n bigint, h1 bigint, h2 bigint, cold array<bigint>, warm array<bigint>")


def _sizes(members: DataFrame) -> DataFrame:
    """Per region: its documents, its loose ones, its parts, and the parts of the loose ones."""

    def parts(docs: str, weight: str):
        return F.ceil(F.greatest(F.col(docs) / PART, F.col(weight) / WEIGHT)).cast("int")

    loose = F.when(F.col("loose"), 1)
    each = members.groupBy("region").agg(F.count("*").alias("docs"), F.sum("n").alias("weight"), F.count(loose).alias("loose_docs"), F.sum(loose * F.col("n")).alias("loose_weight"), F.min(F.when(F.col("loose"), F.col("doc_id"))).alias("first"))
    return each.withColumn("parts", parts("docs", "weight")).withColumn("loose_parts", parts("loose_docs", "loose_weight")).filter("parts > 1")


def _parts(members: DataFrame) -> DataFrame:
    """(region, part, doc_id, pivot, docs): what is joined at once.

    members: (region, doc_id, n, loose, cells); cells: whether the region gets pivots if it is large.
    pivot is null where a part ends the search: in regions that are joined whole or in blocks.
    """
    large = W.cut(_sizes(members))  # plain tables on both sides: a join that Spark can split
    placed = members.join(large, "region", "left").withColumn("hash", F.xxhash64("region", "doc_id"))
    mine, other = F.pmod("hash", F.col("parts")).cast("int"), F.shiftrightunsigned("hash", 20)
    ends = F.lit(None).cast("boolean")

    def rows(df: DataFrame, part, pivot=ends) -> DataFrame:
        return df.select("region", part.alias("part"), "doc_id", pivot.alias("pivot"), F.coalesce("docs", F.lit(0)).alias("docs"))

    def counter(n):
        return F.explode(F.sequence(F.lit(0), n - 1))

    out = rows(placed.filter("parts IS NULL"), F.lit(0))
    cells = placed.filter("cells AND parts IS NOT NULL").withColumn("pivot", F.col("loose") & ((F.col("doc_id") == F.col("first")) | (F.pmod(other, F.ceil(F.col("loose_docs") / PIVOTS)) == 0)))
    out = out.unionByName(rows(cells.filter("NOT pivot"), mine, F.lit(False)))
    out = out.unionByName(rows(cells.filter("pivot"), counter(F.col("parts")), F.lit(True)))
    blocks = placed.filter("NOT cells AND parts IS NOT NULL")
    few = blocks.filter("2 * loose_parts <= parts")  # blocks of the loose ones with blocks of all
    out = out.unionByName(rows(few.withColumn("row", counter(F.col("loose_parts"))), F.col("row") * F.col("parts") + mine))
    row = F.pmod(other, F.col("loose_parts")).cast("int")
    out = out.unionByName(rows(few.filter("loose").withColumn("column", counter(F.col("parts"))), row * F.col("parts") + F.col("column")))
    many = blocks.filter("2 * loose_parts > parts").withColumn("mine", mine).withColumn("with", counter(F.col("parts")))  # each two blocks of all
    return out.unionByName(rows(many, F.least("mine", "with") * F.col("parts") + F.greatest("mine", "with")))


def _links(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether each two sets link, and all distances; intersections by a matrix product over shared shingles."""
    size = np.array([len(s) for s in sets], np.int64)
    both = np.zeros((len(sets), len(sets)), np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    _, col, count = np.unique(flat, return_inverse=True, return_counts=True)
    keep = count[col] > 1
    col, owner = col[keep], owner[keep]
    if len(col):
        names, col = np.unique(col, return_inverse=True)
        for lo in range(0, len(names), 4096):
            mine = (col >= lo) & (col < lo + 4096)
            m = np.zeros((len(sets), min(4096, len(names) - lo)), np.float32)
            m[owner[mine], col[mine] - lo] = 1
            both += (m @ m.T).astype(np.int64)
    union = size[:, None] + size[None, :] - both
    return 100 * both >= percent * union, 1 - both / np.maximum(union, 1)


def _components(link: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each."""
    label = np.arange(len(link))
    todo = np.ones(len(link), bool)
    for k in range(len(link)):
        if todo[k]:
            edge = np.array([k])
            todo[k] = False
            while len(edge):
                near = np.flatnonzero(link[edge].any(0) & todo)
                todo[near] = False
                label[near] = k
                edge = near
    return label


_JOINED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("pivot", pa.int64()), ("d", pa.float64()), ("settled", pa.bool_()), ("n", pa.int64()), ("docs", pa.int64())])
_NEAR = 1e-6


def _join_part(region: int, ids: np.ndarray, pivot: np.ndarray | None, docs: int, sets: list[np.ndarray], percent: int) -> pa.RecordBatch:
    """Links (a, b) as stars, and for a part with pivots its documents' places (a: region, b: document) in the pivots' cells."""
    link, d = _links(sets, percent)
    label = _components(link)
    child = np.flatnonzero(label != np.arange(len(ids)))
    cols = [[ids[label[child]]], [ids[child]], [np.zeros(len(child), np.int64)], [np.zeros(len(child))], [np.zeros(len(child), bool)], [np.zeros(len(child), np.int64)]]
    if pivot is not None:
        m = int(pivot.sum())  # the pivots come first
        far = d[:m, m:]
        least = far.min(0)
        which, doc = np.nonzero((far <= least + 2 * (1 - percent / 100) + _NEAR) & (least > 0))
        size = np.array([len(s) for s in sets], np.int64)
        new = (np.full(len(doc), region), ids[m + doc], ids[which], far[which, doc], label[which] == label[m + doc], size[m + doc])
        for c, x in zip(cols, new, strict=True):
            c.append(x)
    data = [np.concatenate(c) for c in cols]
    none = np.arange(len(data[0])) < len(child)
    return pa.RecordBatch.from_arrays([pa.array(data[0]), pa.array(data[1]), pa.array(data[2], mask=none), *[pa.array(x) for x in data[3:]], pa.array(np.full(len(none), docs))], schema=_JOINED)


def _join_parts(parts: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Joins each part; parts come one after the other, sorted within a task."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def joined() -> pa.RecordBatch:
            ids, pivot = np.array([x[0] for x in held], np.int64), np.array([bool(x[1]) for x in held])
            order = np.lexsort([ids, ~pivot])
            return _join_part(key[0], ids[order], None if held[0][1] is None else pivot[order], held[0][2], [held[k][3] for k in order], percent)

        for b in batches:
            keys = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            ids, pivots, counts = (b.column(k).to_pylist() for k in (2, 3, 4))
            for lo, _, data, offs in W.slices(b.column(5)):
                for k, s in enumerate(_sets(data, offs, width), lo):
                    if keys[k] != key:
                        if len(held) > 1:
                            yield joined()
                        key, held = keys[k], []
                    held.append((ids[k], pivots[k], counts[k], s))
        if len(held) > 1:
            yield joined()

    wanted = split_docs(texts, doc_filter(parts.select("doc_id").distinct()), True)
    rows = parts.join(wanted, "doc_id").select("region", "part", "doc_id", "pivot", "docs", "text")
    return rows.repartition("region", "part").sortWithinPartitions("region", "part").mapInArrow(W.tidy(each), "a bigint, b bigint, pivot bigint, d double, settled boolean, n bigint, docs bigint")


def _next(cells: DataFrame, percent: int) -> DataFrame:
    """Members of the next regions: windows of the cells' distances that may still hold links, or a whole region that they don't cut."""
    eps = 1 - percent / 100 + _NEAR
    band = F.floor(F.col("d") / eps).cast("int")
    placed = cells.withColumn("band", F.explode(F.array(band, band - 1))).filter("band >= 0")
    loose = F.when(~F.col("settled"), F.col("d"))
    keys = placed.groupBy("a", "pivot", "band").agg(F.count("*").alias("inside"), F.min(loose).alias("from"), F.max(loose).alias("to"), F.max("docs").alias("docs"))
    keys = W.cut(keys.filter("from IS NOT NULL AND inside > 1"))
    pairs = F.sum(F.col("inside").cast("double") * F.col("inside"))
    regions = W.cut(keys.groupBy("a").agg(pairs.alias("pairs"), F.min("pivot").alias("one"), F.max("docs").cast("double").alias("docs")).select("a", "one", (2 * F.col("pairs") <= F.col("docs") * F.col("docs")).alias("cells")))
    kept = placed.join(keys.drop("docs"), ["a", "pivot", "band"]).join(regions.filter("cells").select("a"), "a").filter(F.col("d").between(F.col("from") - eps, F.col("to") + eps))
    windows = kept.select(F.xxhash64("a", "pivot", "band").alias("region"), F.col("b").alias("doc_id"), "n", (~F.col("settled")).alias("loose"), F.lit(True).alias("cells"))
    whole = cells.join(regions.filter("NOT cells").select("a", "one"), "a").groupBy(F.xxhash64("a").alias("region"), F.col("b").alias("doc_id"))
    return windows.unionByName(whole.agg(F.max("n").alias("n"), (~F.bool_or(F.col("settled") & (F.col("pivot") == F.col("one")))).alias("loose"), F.lit(False).alias("cells")))


def _chains(rows: DataFrame, percent: int) -> DataFrame:
    """The rows (doc_id, n, sig, hot) that have a holder of their sig within linking size, with a chain number and the chain's holders.

    Holders in order of size: those of which the next is too large to link are apart from it and all
    after it.  For hot sigs the order is found over distinct sizes, so that no task sorts all holders.
    """
    whole = Window.partitionBy("sig", "chain")

    def chained(df: DataFrame, own, alone: str) -> DataFrame:
        out = df.withColumn("less", F.lag("n").over(own)).withColumn("more", F.lead("n").over(own))
        out = out.withColumn("chain", F.sum(F.when(100 * F.col("less") >= percent * F.col("n"), 0).otherwise(1)).over(own))
        return out.filter(f"NOT ({alone}) OR 100 * less >= {percent} * n OR 100 * n >= {percent} * more").drop("less", "more")

    cold = chained(rows.filter("NOT hot"), Window.partitionBy("sig").orderBy("n", "doc_id"), "true").withColumn("docs", F.count("*").over(whole))
    hot = rows.filter("hot")
    sizes = chained(hot.groupBy("sig", "n").agg(F.count("*").alias("docs")), Window.partitionBy("sig").orderBy("n"), "docs = 1")
    return cold.unionByName(hot.join(sizes.withColumn("docs", F.sum("docs").over(whole)), ["sig", "n"]))


def links(docs: DataFrame, info: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) whose components are those of all links between the sets with prefixes in info."""
    sig = info.select("doc_id", F.col("n").cast("int").alias("n"), F.size("cold").alias("rare"), F.posexplode(F.concat("cold", "warm")).alias("at", "sig"))
    sig = sig.select("doc_id", "n", "sig", (F.col("at") >= F.col("rare")).alias("hot"))
    # a set that links shares so many shingles with one other set, so at least so many with any
    least = 1 + F.floor(EXTRA * F.ceil(percent * F.col("n") / 100) / 100)
    # all but the last least - 1 of its shared shingles are enough, in one order of all: after the first that two linked
    # sets share both have least - 1 more.  So each document stays out of its largest groups
    own = Window.partitionBy("doc_id")
    placed = _chains(sig, percent).withColumn("shared", F.count("*").over(own)).withColumn("place", F.row_number().over(own.orderBy("docs", "sig", "chain")))
    enough = W.cut(placed.filter(F.col("place") <= F.col("shared") - least + 1).drop("shared", "place", "docs"))
    group = Window.partitionBy("sig", "chain")
    cold = enough.filter("NOT hot").select("doc_id", "n", F.min("doc_id").over(group).alias("region"), F.max("doc_id").over(group).alias("last")).filter("last > region").drop("last")
    least_of = W.cut(enough.filter("hot").groupBy("sig", "chain").agg(F.min("doc_id").alias("region"), F.max("doc_id").alias("last")).filter("last > region").drop("last"))
    hot = enough.filter("hot").join(least_of, ["sig", "chain"]).select("doc_id", "n", "region")
    members = W.cut(cold.unionByName(hot).groupBy("region", "doc_id").agg(F.max("n").cast("long").alias("n")).withColumns({"loose": F.lit(True), "cells": F.lit(True)}))
    found = None
    while True:
        out = W.cut(_join_parts(W.cut(_parts(members)), docs, width, percent))
        mine = out.filter("pivot IS NULL").select("a", "b")
        found = mine if found is None else found.unionByName(mine)
        cells = out.filter("pivot IS NOT NULL")
        if cells.isEmpty():
            return found.distinct()
        members = W.cut(_next(cells, percent))


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, component_id) of every document in a link (a, b), by alternating large and small stars."""
    edges = W.cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = W.cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))  # a plain table: hubs can be split
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = W.cut(large)
        low = W.cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        edges = W.cut(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    members = edges.select(F.col("u").alias("doc_id"), F.col("v").alias("component_id"))
    return members.unionByName(edges.select(F.col("v").alias("doc_id"), F.col("v").alias("component_id")).distinct())


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    keyed, top = W.with_keys(docs, doc_id)
    found = _near_duplicates(keyed, "row_key", text, width, percent)
    return found.withColumns({c: W.without_keys(F.col(c), top) for c in ("doc_id", "component_id")})


def _near_duplicates(docs: DataFrame, doc_id: str, text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """near_duplicates() of documents that all have an id."""
    texts = W.as_bytes(docs, doc_id, text)
    first = W.cut(survey(texts, width))
    top = first.filter("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("docs").alias("docs")).orderBy(F.desc("docs"), "shingle").limit(HOT_SHINGLES).collect()
    hot = np.array([r["shingle"] for r in top][::-1], np.int64).view(np.uint64)
    small = first.filter("shingle IS NULL").select("doc_id", "n", "h1", "h2")
    # sets of several documents, as a plain table: Spark can split a join with the documents of a large one
    sets = W.cut(small.filter("n > 0").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("docs")).filter("docs > 1"))
    copied = {(r["h1"], r["h2"]): r["rep"] for r in sets.orderBy(F.desc("docs"), "rep").limit(COPIES).collect()}
    sets = sets.drop("docs")
    info = W.cut(signatures(texts, hot, copied, width, percent).filter("cold IS NOT NULL"))
    found = links(texts, info, width, percent)
    copies = small.filter("n > 0").join(sets, ["n", "h1", "h2"], "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep"))
    of_rep = info.select("doc_id", "n", "h1", "h2").join(sets, ["n", "h1", "h2"]).filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    several = W.cut(copies.groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo < hi").select("doc_id"))
    of_rows = copies.join(several, "doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    whole = W.cut(components(found.unionByName(of_rep).unionByName(of_rows)))
    rep = copies.join(whole.select(F.col("doc_id").alias("rep"), "component_id"), "rep", "left").select("doc_id", F.coalesce("component_id", "rep").alias("component_id"))
    one = small.groupBy("doc_id").agg(F.max("n").alias("n_shingles"))
    of = rep.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    return one.join(of, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component, the one of smallest doc_id (null last), with its columns."""
    key = f"{free_prefix(docs)}_key"
    keyed, _ = W.with_keys(docs, key=key)
    first = _near_duplicates(keyed, key).filter("component_id = doc_id").select(F.col("doc_id").alias(key))
    return keyed.join(first, key, "left_semi").select(*docs.columns)


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the near-duplicate component of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
