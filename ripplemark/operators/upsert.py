"""Last write wins, and cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(base: DataFrame, delta: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Base and delta by key: a delta row wins over a base row, and of several delta rows the last in order."""
    both = base.withColumn("_new", F.lit(0)).unionByName(delta.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    own = Window.partitionBy(*keys).orderBy(F.desc("_new"), *[c.desc() for c in order])
    return both.withColumn("_rank", F.row_number().over(own)).filter("_rank = 1").drop("_rank", "_new")


def last_rows(rows: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """The last row of each key, by a column or else in the order in which the rows are read; with partial aggregation."""
    if order is None:
        return last_rows(rows.withColumn("_arrival", F.monotonically_increasing_id()), keys, "_arrival").drop("_arrival")
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_last")).select(*[c if c in keys else F.col(f"_last.{c}").alias(c) for c in rows.columns])


def insert_absent(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """Base, and delta rows whose key it lacks."""
    return base.unionByName(delta.dropDuplicates(keys).join(base.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def cut(df: DataFrame) -> DataFrame:
    """The rows from a table in the shared checkpoint folder, with their lineage cut."""
    spark = df.sparkSession
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        top = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", top)
    path = f"{top.rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a dictionary that is sent whole to each executor.
FEW_ROWS = 1_000_000


def few(table: DataFrame) -> DataFrame:
    """A written table, to be joined where the other rows stand if it has few rows (counted from its footers); else by shuffles."""
    return F.broadcast(table) if table.count() <= FEW_ROWS else table
