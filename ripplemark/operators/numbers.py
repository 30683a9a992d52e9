"""Dictionaries: whole numbers in place of strings in large joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .upsert import cut

#: monotonically_increasing_id() is the partition's number, and below it the row's in so many bits.
_ROW_BITS = 33


def identified(rows: DataFrame, name: str) -> DataFrame:
    """The distinct rows with a number each, in no order; written, so that the numbers stay."""
    return cut(rows.distinct().withColumn(name, F.monotonically_increasing_id()))


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """The distinct rows with their place in an order, from 0 on: a range-partitioned sort, and an offset for each partition."""
    placed = cut(rows.distinct().orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_at", _ROW_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).orderBy("_part").collect()  # a row a partition
    offsets, upto = [], 0
    for r in sizes:
        offsets.append((r["_part"], upto))
        upto += r["n"]
    table = rows.sparkSession.createDataFrame(offsets, "_part bigint, _offset bigint")
    out = placed.withColumn("_part", part).join(F.broadcast(table), "_part")
    return out.withColumn(name, F.col("_offset") + F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1)).select(*rows.columns, name)
