"""Calls: to the symbol that makes them, and to the symbol they name."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import normalize_call

SENTINELS = ["<module>", "<class>", "<global>"]


def attribute_calls(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """(call_id, repo_id, file_path, callee, src): each call with the narrowest symbol of its file that
    has the caller's name and holds its line; calls without one are dropped.

    The line range is a residual of an equi-join by name.
    """
    use = calls.filter(~F.col("caller").isin(SENTINELS)).select("call_id", "repo_id", "file_path", "caller", "callee", "line")
    dim = symbols.select("repo_id", "file_path", F.col("name").alias("caller"), "start_line", "end_line", "pos", F.col("qualified_name").alias("src"))
    both = use.join(dim, ["repo_id", "file_path", "caller"]).filter(F.col("line").between(F.col("start_line"), F.col("end_line")))
    own = Window.partitionBy("call_id").orderBy(F.col("end_line") - F.col("start_line"), "pos")
    return both.withColumn("_rank", F.row_number().over(own)).filter("_rank = 1").select("call_id", "repo_id", "file_path", "callee", "src")


def calls_by_symbol(attributed: DataFrame) -> DataFrame:
    """Sorted distinct callees of each symbol."""
    return attributed.groupBy("repo_id", "src").agg(F.sort_array(F.collect_set("callee")).alias("calls"))


def names_in_repo(symbols: DataFrame) -> DataFrame:
    """(repo_id, name, qname): the first in order of path components and place wins."""
    return symbols.groupBy("repo_id", "name").agg(F.min_by("qualified_name", F.struct(F.split("file_path", "/"), "pos")).alias("qname"))


def names_in_file(symbols: DataFrame) -> DataFrame:
    """(repo_id, file_path, name, qname): the last in the file wins."""
    return symbols.groupBy("repo_id", "file_path", "name").agg(F.max_by("qualified_name", "pos").alias("qname"))


def resolve_calls(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls (repo_id, file_path, callee, ...) with dst and resolved: own file first, then the repository;
    of a dotted text the method part first, then the whole.

    Both name tables hold one row for a name, so hot names don't multiply rows.
    """
    out = calls.withColumn("_call", normalize_call(F.col("callee")))
    out = out.withColumns({"_text": F.col("_call.text"), "_method": F.col("_call.method")}).drop("_call")
    found = []
    for column in ("_method", "_text"):
        own = names_in_file(symbols).withColumnsRenamed({"name": column, "qname": f"{column}_file"})
        whole = names_in_repo(symbols).withColumnsRenamed({"name": column, "qname": f"{column}_repo"})
        out = out.join(own, ["repo_id", "file_path", column], "left").join(whole, ["repo_id", column], "left")
        found += [f"{column}_file", f"{column}_repo"]
    return out.withColumn("dst", F.coalesce(*found)).withColumn("resolved", F.col("dst").isNotNull()).drop("_text", "_method", *found)
