"""Nodes and edges of the code graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from .upsert import cut

#: Imports of a file that stand in one row until its edges are made: eights, so that their numbers repeat by whole bytes where edges are written.
BLOCK = 512
#: Symbols and imports that a task makes edges of, as many as the dictionaries of a Parquet file hold.
TASK_ROWS = 20_000


def live(df: DataFrame) -> DataFrame:
    """Rows that aren't deleted; null counts as not deleted."""
    return df.filter(~F.coalesce("deleted", F.lit(False)))


def public_symbols(symbols: DataFrame) -> DataFrame:
    """Symbols that a file exports: (language, path, name, kind, parent, ...) by the rules of the language."""
    top = F.col("parent").isNull()
    header = P.suffix(F.col("path")).isin(".h", ".hpp", ".hxx")
    rule = (
        F.when(F.col("language") == "python", top & ~F.col("name").startswith("_"))
        .when(F.col("language") == "java", top)
        .when(F.col("language") == "cpp", header | (top & (F.col("kind") == "function")))
        .otherwise(False)
    )
    return symbols.filter(rule)


def package_nodes(imports: DataFrame) -> DataFrame:
    """Distinct packages of each repository with their flags, from (repo_id, module)."""
    out = imports.select("repo_id", F.col("module").alias("name")).filter("name IS NOT NULL").distinct()
    return out.withColumn("is_external", P.is_external(F.col("name"))).withColumn("is_builtin", P.is_builtin(F.col("name")))


def contains_edges(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """File to symbol, where both are there."""
    return symbols.select("repo_id", F.col("file_path").alias("path"), "qualified_name").join(files.select("repo_id", "path"), ["repo_id", "path"], "left_semi").distinct()


def repo_contains(repos: DataFrame, files: DataFrame) -> DataFrame:
    """Repository to file, where both are there."""
    return files.select("repo_id", "path").join(repos.select(F.col("id").alias("repo_id")), "repo_id", "left_semi").distinct()


def calls_edges(resolved: DataFrame, symbols: DataFrame) -> DataFrame:
    """Caller to callee (repo_id, src, dst), where both are there; a set."""
    known = symbols.select("repo_id", "qualified_name").distinct()
    out = resolved.filter("dst IS NOT NULL").select("repo_id", "src", "dst").distinct()
    for end in ("src", "dst"):
        out = out.join(known.withColumnRenamed("qualified_name", end), ["repo_id", end], "left_semi")
    return out.select("repo_id", "src", "dst")


def imports_edges(symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """Symbol to package: each symbol of a file with each import of the file.

    That is many more rows than symbols and imports, so what counts is how small they are written.  A task has few
    strings, and makes the edges of one block of imports after another: so they repeat at short distance.
    """
    spark, file, key = symbols.sparkSession, ["repo_id", "file_path"], ["repo_id", "file_path", "block"]
    modules = imports.select("repo_id", F.col("path").alias("file_path"), F.col("module").alias("package")).distinct()
    block = F.floor((F.row_number().over(Window.partitionBy(*file).orderBy("package")) - 1) / BLOCK)
    packages = F.transform(F.collect_list(F.struct("package")), lambda x: x["package"])  # a list leaves out nulls
    blocks = cut(modules.withColumn("block", block).groupBy(*key).agg(packages.alias("packages")))
    per_file = blocks.groupBy(*file).agg(F.max("block").alias("last"), F.sum(F.size("packages")).alias("modules"))
    known = symbols.select(*file, F.col("qualified_name").alias("src"))
    rows = known.groupBy(*file).count().join(per_file, file).agg(F.sum(F.expr("count * (last + 1) + modules"))).first()[0] or 0
    # fewer than Spark's own number it would deal out anew for the join
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), rows // TASK_ROWS + 1)
    known = known.distinct().join(per_file, file).select(*file, "src", F.explode(F.sequence(F.lit(0), "last")).alias("block"))
    # a merge keeps the order: each symbol with all imports of its block, block by block
    edges = known.repartition(n, *key).hint("merge").join(blocks.repartition(n, *key), key)
    return edges.select("repo_id", "src", F.explode("packages").alias("package"))


def has_commit(commits: DataFrame, repos: DataFrame, by: str = "id") -> DataFrame:
    """Repository to commit, where the repository is there; `by` as in `has_change`."""
    known = commits.join(repos.select(F.col("id").alias("repo_id")), "repo_id", "left_semi")
    return known.select(F.col(by).alias("_by"), "repo_id", F.col("id").alias("commit_id")).distinct().drop("_by")


def of_commits(changes: DataFrame, commits: DataFrame, by: str, how: str) -> DataFrame:
    """Changes of known commits, found by a column of both that stands for the commit's id.

    The repositories are compared as bounds, not as a key: tables dealt out by `by` are joined where they stand.
    """
    c = commits.select(F.col("repo_id").alias("_repo"), F.col(by).alias("_by"))
    return changes.join(c, (F.col(by) == F.col("_by")) & F.col("repo_id").between(F.col("_repo"), F.col("_repo")), how)


def has_change(changes: DataFrame, commits: DataFrame, by: str | None = None) -> DataFrame:
    """Commit to change, where the commit is there.

    by: a column of both that stands for the commit's id, by which they are dealt out; then neither is shuffled.
    """
    if by is not None:
        return of_commits(changes, commits, by, "left_semi").select(by, "repo_id", "commit_id", "file_path").distinct().drop(by)
    return changes.select("repo_id", "commit_id", "file_path").join(commits.select("repo_id", F.col("id").alias("commit_id")), ["repo_id", "commit_id"], "left_semi").distinct()


def tombstone(symbols: DataFrame, changes: DataFrame) -> DataFrame:
    """Symbols, deleted where a change deletes their file; runs after the upserts."""
    gone = changes.filter("type = 'deleted'").select("repo_id", "file_path", F.lit(True).alias("_gone")).distinct()
    return symbols.join(gone, ["repo_id", "file_path"], "left").withColumn("deleted", F.coalesce("_gone", "deleted", F.lit(False))).select(*symbols.columns)


def lines_of_code(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Files with the last line of their symbols, 0 without symbols."""
    top = symbols.groupBy("repo_id", F.col("file_path").alias("path")).agg(F.max("end_line").alias("_top"))
    return files.join(top, ["repo_id", "path"], "left").withColumn("lines_of_code", F.coalesce("_top", F.lit(0))).drop("_top")


def graph_counts(nodes: dict[str, DataFrame], edges: dict[str, DataFrame]) -> DataFrame:
    """(part, label, n): rows of each node label and edge type, and of all (label null)."""
    each = [df.groupBy().agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), F.lit(k).alias("label"), "n") for part, group in (("node", nodes), ("edge", edges)) for k, df in group.items()]
    rows = reduce(DataFrame.unionByName, each)
    return rows.groupingSets([["part", "label"], ["part"]], "part", "label").agg(F.sum("n").alias("n"))


def ingest_stats(nodes: dict[str, DataFrame], edges: dict[str, DataFrame], resolved: DataFrame) -> DataFrame:
    """One row: files, symbols, packages, changes, relationships before they are made distinct, unresolved calls."""
    counts = [df.groupBy().agg(F.count("*").alias("n")).select(F.lit(k).alias("k"), "n") for k, df in (nodes | edges).items()]
    counts.append(resolved.groupBy().agg(F.count(F.when(F.col("dst").isNull(), 1)).alias("n")).select(F.lit("unresolved").alias("k"), "n"))
    rows = reduce(DataFrame.unionByName, counts)

    def total(*names: str):
        return F.coalesce(F.sum(F.when(F.col("k").isin(*names), F.col("n"))), F.lit(0))

    return rows.agg(*[total(k).alias(k) for k in nodes], total(*edges).alias("relationships"), total("unresolved").alias("unresolved_calls"))


def top_called(edges: DataFrame, symbols: DataFrame, limit: int = 10) -> DataFrame:
    """Names with most callers."""
    names = symbols.select("repo_id", F.col("qualified_name").alias("dst"), "name")
    return edges.join(names, ["repo_id", "dst"]).groupBy("name").agg(F.count("*").alias("callers")).orderBy(F.desc("callers"), "name").limit(limit)


def prune_stale(edges: DataFrame, symbols: DataFrame, parsed_files: DataFrame) -> DataFrame:
    """Edges without those that leave a symbol of a parsed file which is no longer in it."""
    kept = symbols.select("repo_id", F.col("qualified_name").alias("src"), "file_path")
    fresh = parsed_files.select("repo_id", "file_path", "qualified_name")
    stale = kept.join(fresh.select("repo_id", "file_path").distinct(), ["repo_id", "file_path"], "left_semi").join(fresh.select("repo_id", F.col("qualified_name").alias("src")), ["repo_id", "src"], "left_anti")
    return edges.join(stale.select("repo_id", "src"), ["repo_id", "src"], "left_anti")


def repo_contents(nodes: dict[str, tuple[DataFrame, str]], repo_id: str) -> DataFrame:
    """(label, key, row): everything of one repository; nodes: label -> (table, key column)."""
    parts = [df.filter(F.col("repo_id") == repo_id).select(F.lit(k).alias("label"), F.col(key).alias("key"), F.to_json(F.struct(*df.columns)).alias("row")) for k, (df, key) in nodes.items()]
    return reduce(DataFrame.unionByName, parts)
