"""Choosing files, finding changed ones, and counting what was indexed."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P

MAX_KB = 512


def drop_skip_dirs(files: DataFrame) -> DataFrame:
    """Files outside the skipped folders."""
    return files.filter(~P.in_skipped_dir(F.col("path")))


def ignore_regex(pattern: str) -> tuple[str, bool] | None:
    """A gitignore line as (regex on the whole path, negated); None for blank lines and comments."""
    line = pattern.rstrip("\n")
    if not line.strip() or line.startswith("#"):
        return None
    line = re.sub(r"(?<!\\) +$", "", line)
    negated = line.startswith("!")
    line = line[1:] if negated else line
    folder = line.endswith("/")
    line = line.rstrip("/")
    anchored = "/" in line
    out, i = "", 0
    line = line.lstrip("/")
    while i < len(line):
        if line.startswith("**/", i) and (i == 0 or line[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif line.startswith("**", i):
            out, i = out + ".*", i + 2
        elif line[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif line[i] == "?":
            out, i = out + "[^/]", i + 1
        elif line[i] == "[" and "]" in line[i + 2 :]:
            end = line.index("]", i + 2)
            out, i = out + "[" + line[i + 1 : end].replace("!", "^", line[i + 1] == "!").replace("\\", "\\\\") + "]", end + 1
        elif line[i] == "\\" and i + 1 < len(line):
            out, i = out + re.escape(line[i + 1]), i + 2
        else:
            out, i = out + re.escape(line[i]), i + 1
    return f"^{'' if anchored else '(?:.*/)?'}{out}{'/.*' if folder else '(?:/.*)?'}$", negated


#: Rules that tasks hold; more are joined with the paths.
RULES = 100_000


def _last_match(rules: list[tuple[int, str]]) -> list[tuple]:
    """(matcher, negated) of a repository's rules, the last first."""
    made = [ignore_regex(p) for _, p in sorted(rules, key=lambda r: r[0], reverse=True)]
    return [(re.compile(x[0][1:-1]).fullmatch, x[1]) for x in made if x]


def apply_ignore_patterns(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Files that the ignore rules (repo_id, ordinal, pattern) of their repository keep; the last match wins.

    With at most RULES rules, each path is tried on its repository's rules where it stands, from the last one back to
    the first that matches: no shuffle, and no row for a path and a rule.  With more, paths and rules are joined.
    """
    known = rules.filter("pattern IS NOT NULL").select("repo_id", "ordinal", "pattern")
    few = known.limit(RULES + 1).collect()
    if len(few) > RULES:
        return _joined_patterns(files, known)
    of: dict[str, list[tuple[int, str]]] = {}
    for r in few:
        of.setdefault(r["repo_id"], []).append((r["ordinal"], r["pattern"]))
    shared = files.sparkSession.sparkContext.broadcast(of)

    @F.pandas_udf("boolean")
    def kept(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        made: dict[str, list[tuple]] = {}
        for repos, paths in parts:
            out = []
            for repo, path in zip(repos, paths, strict=True):
                if repo not in made:
                    made[repo] = _last_match(shared.value.get(repo, []))
                out.append(next((back for match, back in made[repo] if path is not None and match(path)), True))
            yield pd.Series(out, dtype=bool)

    return files.filter(kept("repo_id", "path"))


def _joined_patterns(files: DataFrame, rules: DataFrame) -> DataFrame:
    """apply_ignore_patterns by a join; each distinct pattern is made a regex once, in the executors."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            made = [(p, *x) for p in df["pattern"] if (x := ignore_regex(p))]
            yield pd.DataFrame(made, columns=["pattern", "regex", "negated"])

    regexes = rules.select("pattern").distinct().mapInPandas(each, "pattern string, regex string, negated boolean")
    table = rules.join(regexes, "pattern")
    hits = files.select("repo_id", "path").distinct().join(table, "repo_id").filter(F.expr("path RLIKE regex"))
    gone = hits.groupBy("repo_id", "path").agg(F.max_by("negated", "ordinal").alias("back")).filter("NOT back")
    return files.join(gone.select("repo_id", "path"), ["repo_id", "path"], "left_anti")


def drop_oversized(files: DataFrame, max_kb: int = MAX_KB) -> DataFrame:
    """Files of at most max_kb KB."""
    return files.filter(F.col("size") <= max_kb * 1024)


def scan_filter(files: DataFrame, rules: DataFrame | None = None, max_kb: int = MAX_KB) -> DataFrame:
    """The files to index, with their language."""
    out = drop_skip_dirs(files)
    if rules is not None:
        out = apply_ignore_patterns(out, rules)
    return drop_oversized(out.withColumn("language", P.detect_language(F.col("path"))).filter("language IS NOT NULL"), max_kb)


def changed_files(current: DataFrame, snapshots: DataFrame, full: bool = False) -> DataFrame:
    """Files (repo_id, path, hash) that are new or differ from their snapshot; all if full."""
    if full:
        return current
    old = snapshots.select("repo_id", "path", F.col("hash").alias("_old"))
    return current.join(old, ["repo_id", "path"], "left").filter(F.col("_old").isNull() | (F.col("_old") != F.col("hash"))).drop("_old")


def snapshot_commit_id(files: DataFrame) -> DataFrame:
    """(repo_id, commit_id): SHA-1 over each repository's path:mtime lines in order of components.

    A repository is one sequence for the hash, so a task works through it, sorted on disk and line by line: none of its
    paths are held together.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repo, digest = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([repo], pa.string()), pa.array([digest.hexdigest()])], ["repo_id", "commit_id"])

        for b in batches:
            for own, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if digest is not None and own == repo:
                    digest.update(b"\n" + line.encode())
                else:
                    if digest is not None:
                        yield done()
                    repo, digest = own, hashlib.sha1(line.encode())
        if digest is not None:
            yield done()

    lines = files.select("repo_id", F.split("path", "/").alias("_parts"), F.concat_ws(":", "path", "mtime_ns").alias("_line"))
    return lines.repartition("repo_id").sortWithinPartitions("repo_id", "_parts", "_line").select("repo_id", "_line").mapInArrow(each, "repo_id string, commit_id string")


def index_report(files: DataFrame, **parts: DataFrame) -> DataFrame:
    """Counts of each part (symbols, imports, calls, ...) by file, by repository (path null) and in all (both null)."""
    out = files.select("repo_id", "path")
    for name, df in parts.items():
        out = out.join(df.groupBy("repo_id", "path").agg(F.count("*").alias(name)), ["repo_id", "path"], "left")
    return out.rollup("repo_id", "path").agg(F.count("*").alias("files"), *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in parts])


def repo_stats(files: DataFrame, **parts: DataFrame) -> DataFrame:
    """(repo_id, total_files, languages, total_...) of each repository."""
    out = files.groupBy("repo_id").agg(F.count("*").alias("total_files"), F.array_join(F.sort_array(F.collect_set("language")), ", ").alias("languages"))
    for name, df in parts.items():
        out = out.join(df.groupBy("repo_id").agg(F.count("*").alias(f"total_{name}")), "repo_id", "left")
    return out.select("repo_id", "total_files", "languages", *[F.coalesce(f"total_{n}", F.lit(0)).alias(f"total_{n}") for n in parts])


def touch_registry(registry: DataFrame, stats: DataFrame, as_of: str, full: bool) -> DataFrame:
    """The registry after an index run: totals are replaced by a full run, else only last_indexed moves."""
    totals = [c for c in stats.columns if c != "repo_id"]
    new = stats.select("repo_id", *[F.col(c).alias(f"_{c}") for c in totals], F.lit(True).alias("_hit"))
    out = registry.join(new, "repo_id", "left").withColumn("last_indexed", F.when(F.col("_hit"), F.lit(as_of).cast("timestamp")).otherwise(F.col("last_indexed")))
    for c in totals if full else []:
        out = out.withColumn(c, F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)))
    return out.select(*registry.columns)


def unregister(table: DataFrame, gone: DataFrame, key: str = "repo_id") -> DataFrame:
    """The rows of repositories that aren't removed."""
    return table.join(gone.select(key).distinct(), key, "left_anti")


def recent(df: DataFrame, by: str, *ties: str, limit: int | None = None) -> DataFrame:
    """Rows by a time, newest first, nulls last; the first `limit`."""
    out = df.orderBy(F.desc_nulls_last(by), *ties)
    return out if limit is None else out.limit(limit)
