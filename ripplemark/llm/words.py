"""Vectorised word work over Arrow batches.

A batch's binary column is one byte buffer with offsets, so words, word hashes and rolling
window hashes are found for many texts at once.  Words are runs of bytes of a class; as both
word classes used here hold every byte from 0x80 up, byte runs equal code-point runs in UTF-8.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text worked on at once; one longer text is a slice of its own.
SLICE_BYTES = 2_000_000
#: Rows and bytes that Spark puts in an Arrow batch for these operators.
BATCH_ROWS, BATCH_BYTES = 1000, 8_000_000
#: Bytes of words hashed at once; one longer word is hashed by itself.
HASH_BYTES = 262_144

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)

SPACE = np.ones(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that long texts fit in a Python worker.

    The session keeps these settings, as plans run after this call.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def release() -> None:
    """Gives memory that this process no longer needs back to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(work):
    """The work on a task's Arrow batches; at its end the Python worker, which waits for further tasks, releases memory."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        release()

    return each


def as_bytes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *more: str) -> DataFrame:
    """Id, UTF-8 bytes of the text (null: empty) and further columns, under fixed names."""
    small_batches(docs.sparkSession)
    return docs.select(docs[doc_id].alias("doc_id"), F.coalesce(docs[text].cast("binary"), F.lit(b"")).alias("text"), *[docs[c] for c in more])


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows that hold at most limit bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column if isinstance(column, pa.Array) else column.chunk(0)
    if column.null_count:
        column = column.fill_null(b"")
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    n, (_, offs, data) = len(column), column.buffers()
    if not n:
        return
    offs = np.frombuffer(offs, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def spans(data: np.ndarray, offs: np.ndarray, kind: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and each text's first word number (with an end)."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offs), np.int64)
    is_word = kind[data]
    before, after = np.empty_like(is_word), np.empty_like(is_word)
    before[0], before[1:] = False, is_word[:-1]
    after[-1], after[:-1] = False, is_word[1:]
    edge = offs[(offs > 0) & (offs < len(data))]
    before[edge], after[edge - 1] = False, False
    starts = np.flatnonzero(is_word & ~before)
    return starts, np.flatnonzero(is_word & ~after) + 1, np.searchsorted(starts, offs)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    out = np.full(n, base, _U)
    out[:1] = 1
    return np.multiply.accumulate(out)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same in every process."""
    size = ends - starts
    out = np.empty(len(starts), _U)
    if not len(starts):
        return out
    upto, power = np.cumsum(size), _powers(int(size.max()))
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] - size[lo] + HASH_BYTES, side="right")))
        mine, first = size[lo:hi], upto[lo:hi] - size[lo:hi] - (upto[lo] - size[lo])
        at = np.arange(int(mine.sum())) - np.repeat(first, mine)
        part = (data[np.repeat(starts[lo:hi], mine) + at].astype(_U) + _U(1)) * power[at]
        out[lo:hi] = mix(np.add.reduceat(part, first) + mine.astype(_U) * _U(0xD6E8FEB86659FD93))
        lo = hi
    return out


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; windows that cross texts are the caller's to drop."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, _U)
    for j, p in enumerate(_powers(k, _U(0xC2B2AE3D27D4EB4F))):
        out += h[j : j + n] * p
    return mix(out)


def owners(firsts: np.ndarray) -> np.ndarray:
    """The text number of each word."""
    return np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is set and Spark runs on one machine (tests)."""
    import tempfile
    import uuid

    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", f"file://{top}")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    return f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/tables-{uuid.uuid4().hex}"


def cut(df: DataFrame, compression: str | None = None) -> DataFrame:
    """The rows, written to the shared folder, with their lineage cut."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def with_keys(docs: DataFrame, doc_id: str = "doc_id", key: str = "row_key") -> tuple[DataFrame, int]:
    """The rows with a key column, and the greatest id: the key is the id or, where that is null, a number above all ids."""
    ids = docs.select(docs[doc_id].cast("long").alias("id"))
    top, nulls = ids.agg(F.max("id"), F.count_if(F.col("id").isNull())).first()
    top = -1 if top is None else top
    keyed = docs.withColumn(key, docs[doc_id].cast("long"))
    if not nulls:
        return keyed, top
    # written, as the numbers would not be the same each time the rows are read
    lost = cut(docs.filter(docs[doc_id].isNull()).withColumn(key, F.monotonically_increasing_id() + F.lit(top + 1)))
    return keyed.filter(F.col(key).isNotNull()).unionByName(lost), top


def without_keys(key: Column, top: int) -> Column:
    """The id that a key of with_keys() stands for."""
    return F.when(key <= top, key)
