"""File versions as a stream, upserted into a snapshot table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SNAPSHOT = "repo_id string, path string, hash string, version bigint"
KEYS = ["repo_id", "path"]
#: Every so many batches the whole snapshot is written, in between only what changed.
WHOLE_EVERY = 50
#: Folders that each of them is dealt into by file, so that a batch reads those of its own files.
BUCKETS = 64


def _bucket():
    return F.pmod(F.xxhash64(*KEYS), F.lit(BUCKETS)).cast("int")


def read_snapshot(spark: SparkSession, path: str, below: int | None = None, buckets: list[int] | None = None) -> DataFrame:
    """The snapshot below a path: of each file the greatest version, after all batches or those below a number.

    The last whole snapshot and the changes after it; empty before the first batch.  buckets: those that are read.
    """
    done = [(n, name) for n, name in _finished(spark, path) if below is None or n < below]
    first = max((n for n, name in done if name.startswith("whole")), default=-1)
    use = [f"{path}/{name}" for n, name in done if n >= first]
    if not use:
        return spark.createDataFrame([], SNAPSHOT)
    # each folder is a table of its own, dealt into buckets
    rows = reduce(DataFrame.unionByName, [spark.read.schema(f"{SNAPSHOT}, bucket int").parquet(p) for p in use])
    if buckets is not None:
        rows = rows.filter(F.col("bucket").isin(buckets))
    return _latest(rows)


def _latest(rows: DataFrame) -> DataFrame:
    """The row of greatest version of each file; of equal versions the one of greatest hash, in whatever order they come."""
    return rows.groupBy(*KEYS).agg(F.max(F.struct("version", "hash")).alias("x")).select(*KEYS, "x.hash", "x.version")


def _finished(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """Numbers and names of finished batch folders, by Spark's own file system, as the path may be in any store."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted((int(n.rpartition("-")[2]), n) for n in names if n.startswith(("whole-", "part-")) and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))


def changed_versions(batch: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Of each file in a batch its greatest version, if it is new, or stands after the snapshot's in the order of _latest() and differs from it."""
    old = snapshot.select(*KEYS, F.col("hash").alias("_hash"), F.col("version").alias("_version"))
    out = _latest(batch).join(old, KEYS, "left")
    return out.filter("_version IS NULL OR (version > _version AND hash <> _hash) OR (version = _version AND hash > _hash)").drop("_hash", "_version")


def drop_old(spark: SparkSession, path: str, below: int) -> None:
    """Deletes what stands before the last whole snapshot below a number; a batch that is run again needs nothing older."""
    done = [(n, name) for n, name in _finished(spark, path) if n < below]
    first = max((n for n, name in done if name.startswith("whole")), default=-1)
    jvm = spark.sparkContext._jvm
    for n, name in done:
        if n < first:
            p = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stream_index(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Starts the stream (repo_id, path, hash, version); each batch reads the buckets of its files and writes what it changes.

    A batch that is run again, also after it had been written, reads the batches before it and
    writes the same folder, so nothing counts twice.  An older version that comes late changes nothing.
    """

    def batch(df: DataFrame, n: int) -> None:
        spark, whole = df.sparkSession, n % WHOLE_EVERY == WHOLE_EVERY - 1
        touched = None if whole else [r[0] for r in df.select(_bucket()).distinct().collect()]  # BUCKETS numbers at most
        old = read_snapshot(spark, path, n, touched)
        new = changed_versions(df, old)
        out = _latest(old.unionByName(new)) if whole else new
        laid = out.withColumn("bucket", _bucket()).hint("rebalance", "bucket")
        laid.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{'whole' if whole else 'part'}-{n:012d}")
        if whole:
            drop_old(spark, path, n)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
