"""Change lists and patches: to hunks, and to changed symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import detect_language, suffix

TYPES = {"A": "added", "M": "modified", "R": "modified", "C": "added", "D": "deleted"}

# Definition patterns by language family, in the order in which they are tried.
PATTERNS = {
    "python": [
        (r"^\s*(?:async\s+)?def\s+(\w+)\s*\(", "function"),
        (r"^\s*class\s+(\w+)\s*[:(]", "class"),
    ],
    "script": [
        (r"^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*\(", "function"),
        (r"^\s*(?:export\s+)?class\s+(\w+)\s*[{(]", "class"),
        (r"^\s*(?:export\s+)?const\s+(\w+)\s*=\s*(?:async\s+)?\(", "function"),
        (r"^\s*(?:async\s+)?(\w+)\s*\([^)]*\)\s*(?::\s*\w+\s*)?\{", "method"),
    ],
    "java": [
        (r"^\s*(?:public|private|protected)?\s*(?:static\s+)?(?:abstract\s+)?(?:class|interface|enum)\s+(\w+)", "class"),
        (r"^\s*(?:public|private|protected)\s+(?:static\s+)?(?:[\w<>\[\]]+\s+)+(\w+)\s*\(", "method"),
    ],
    "cpp": [
        (r"^\s*class\s+(\w+)", "class"),
        (r"^\s*(?:[\w:*&<>]+\s+)+(\w+)\s*\([^;]*$", "function"),
    ],
}
FAMILIES = {"python": [".py"], "script": [".ts", ".tsx", ".js", ".jsx"], "java": [".java"], "cpp": [".cpp", ".cc", ".cxx", ".c", ".h", ".hpp"]}
_BREAKS = "\r\n|\n|\r"


def parse_name_status(df: DataFrame) -> DataFrame:
    """(repo_id, commit_id, ordinal, file_path, status, type) from change lists (repo_id, commit_id, text)."""
    lines = df.select("repo_id", "commit_id", F.posexplode(F.split("text", _BREAKS)).alias("ordinal", "line"))
    parts = lines.withColumn("p", F.filter(F.split("line", "\t"), lambda x: F.trim(x) != "")).filter("size(p) >= 2")
    status = F.upper(F.substring(F.trim(F.get("p", 0)), 1, 1))
    kind = F.coalesce(*[F.when(F.col("status") == k, v) for k, v in TYPES.items()])
    out = parts.select("repo_id", "commit_id", "ordinal", F.replace(F.trim(F.element_at("p", -1)), F.lit("\\"), F.lit("/")).alias("file_path"), status.alias("status"))
    return out.withColumn("type", kind).filter("type IS NOT NULL")


def initial_commit_changes(files: DataFrame) -> DataFrame:
    """Each file of a supported language as added, from (repo_id, path)."""
    return files.filter(detect_language(F.col("path")).isNotNull()).select("repo_id", F.col("path").alias("file_path"), F.lit("A").alias("status"), F.lit("added").alias("type"))


def merge_changes(unstaged: DataFrame, staged: DataFrame) -> DataFrame:
    """One change for each path; a staged one wins."""
    both = unstaged.withColumn("_s", F.lit(0)).unionByName(staged.withColumn("_s", F.lit(1)))
    return both.groupBy("repo_id", "file_path").agg(F.max_by(F.struct("status", "type"), "_s").alias("c")).select("repo_id", "file_path", "c.status", "c.type")


def ingest_scope(changes: DataFrame, files: DataFrame, full: bool = False) -> DataFrame:
    """(repo_id, path): the files to parse; all, or those with a change other than a deletion."""
    use = files.filter(detect_language(F.col("path")).isNotNull()).select("repo_id", "path").distinct()
    if full:
        return use
    changed = changes.filter(F.col("status").isin("A", "M", "R", "C")).select("repo_id", F.col("file_path").alias("path"))
    return use.join(changed, ["repo_id", "path"], "left_semi")


def read_patches(df: DataFrame) -> DataFrame:
    """(repo_id, commit_id, hunk, file, start, added, removed): the hunks of unified diffs.

    A patch is split at its file headers, and each file's lines at the hunk headers, all where the patch stands: no
    window and no shuffle.  Hunks are numbered by file block and place; what precedes the first header is hunk 0.
    """
    blocks = df.select("repo_id", "commit_id", F.posexplode(F.split("patch", r"(?m)^(?=diff --git )")).alias("block", "text")).filter(F.col("text").startswith("diff --git ")).filter(F.col("text").contains(" b/"))
    lines = blocks.select("repo_id", "commit_id", "block", F.split("text", _BREAKS).alias("lines"))
    first = F.get("lines", F.lit(0))
    file = F.substring(first, F.instr(first, " b/") + 3, F.lit(1 << 30))
    # the places of the headers, the file's own (0) as that of hunk 0
    heads = F.filter(F.transform("lines", lambda x, i: F.when((i == 0) | x.startswith("@@"), i)), lambda i: i.isNotNull())
    placed = lines.select("repo_id", "commit_id", "block", file.alias("file"), "lines", heads.alias("heads"))
    ends = F.transform("heads", lambda i, k: F.struct(k.alias("at"), i.alias("from"), F.coalesce(F.get("heads", k + 1), F.size("lines")).alias("to")))
    parts = F.transform(ends, lambda h: F.struct(h["at"].alias("at"), F.get("lines", h["from"]).alias("head"), F.slice("lines", h["from"] + 2, h["to"] - h["from"] - 1).alias("body")))
    hunks = placed.select("repo_id", "commit_id", "block", "file", F.explode(parts).alias("h")).select("repo_id", "commit_id", "block", "file", "h.*")
    start = F.expr(r"try_cast(regexp_extract(substring_index(substring_index(head, '+', -1), '@@', 1), '^([^, ]*)', 1) AS int)")

    def side(sign: str) -> Column:
        own = F.filter("body", lambda x: x.startswith(sign) & ~x.startswith(f"{sign * 3} "))
        return F.transform(own, lambda x: F.substring(x, F.lit(2), F.lit(1 << 30)))

    both = hunks.select("repo_id", "commit_id", F.struct("block", "at").alias("hunk"), "file", F.when(F.col("at") > 0, start).alias("start"), side("+").alias("added"), side("-").alias("removed"))
    return both.filter((F.size("added") > 0) | (F.size("removed") > 0))


def _definitions(s: Column, line: Column, *more: Column) -> Column:
    """The definitions in a line of a file with a suffix: an array of (name, ..., pattern, kind)."""
    hits = []
    for family, suffixes in FAMILIES.items():
        for k, (pattern, kind) in enumerate(PATTERNS[family]):
            name = F.regexp_extract(line, "(?U)" + pattern, 1)
            hits.append(F.when(s.isin(suffixes) & (name != ""), F.struct(name.alias("name"), *more, F.lit(k).alias("pattern"), F.lit(kind).alias("kind"))))
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def scan_definitions(lines: DataFrame) -> DataFrame:
    """Lines (file, line, ...) with the definitions in them: name, kind and the pattern's place."""
    found = lines.withColumn("_d", F.explode(_definitions(suffix(F.col("file")), F.col("line"))))
    return found.select(*lines.columns, "_d.name", "_d.kind", "_d.pattern")


def changed_symbols(hunks: DataFrame) -> DataFrame:
    """(repo_id, commit_id, hunk, place, file, symbol, kind, change_type, start_line, end_line) of hunks.

    A name on both sides is modified, else added or deleted; a hunk without definitions gives one
    row for its file.  A name counts once for each side, where a pattern hits it first.  A hunk's definitions are sorted
    and compared with their neighbours where the hunk stands: no window, join or shuffle.
    """

    def hits(lines: str, late: bool) -> Column:
        return F.flatten(F.transform(lines, lambda x, i: _definitions(F.col("_suffix"), x, F.lit(late).alias("late"), i.alias("i"))))

    # by name, then side, then place: the first of a name and side, and beside an added name the same one deleted
    ordered = hunks.withColumn("_suffix", suffix(F.col("file"))).withColumn("_all", F.array_sort(F.concat(hits("added", False), hits("removed", True))))
    before = lambda k: F.get("_all", k - 1)
    firsts = F.filter("_all", lambda x, k: (k == 0) | (before(k)["name"] != x["name"]) | (before(k)["late"] != x["late"]))
    sides = ordered.withColumn("_firsts", firsts).drop("_all", "_suffix")
    at = lambda k: F.get("_firsts", k)
    marked = F.transform("_firsts", lambda x, k: F.struct(x.alias("d"), F.coalesce(at(k + 1)["name"] == x["name"], F.lit(False)).alias("twice"), F.coalesce((k > 0) & (at(k - 1)["name"] == x["name"]), F.lit(False)).alias("second")))
    change = lambda x: F.when(x["twice"], "modified").when(x["d"]["late"], "deleted").otherwise("added")
    place = lambda late, i, p: F.struct(late.alias("late"), i.alias("i"), p.alias("p"))
    line = lambda i: F.when(F.col("start") > 0, F.col("start") + i).cast("int")
    found = F.transform(F.filter(marked, lambda x: ~x["second"]), lambda x: F.struct(place(x["d"]["late"], x["d"]["i"], x["d"]["pattern"]).alias("place"), x["d"]["name"].alias("symbol"), x["d"]["kind"].alias("kind"), change(x).alias("change_type"), line(x["d"]["i"]).alias("start_line")))
    change_of_file, stem = _of_file()
    whole = F.array(F.struct(place(F.lit(False), F.lit(0), F.lit(0)).alias("place"), stem.alias("symbol"), F.lit("unknown").alias("kind"), change_of_file.alias("change_type"), F.col("start").cast("int").alias("start_line")))
    rows = sides.select("repo_id", "commit_id", "hunk", "file", F.explode(F.when(F.size("_firsts") > 0, found).otherwise(whole)).alias("x"))
    return rows.select("repo_id", "commit_id", "hunk", "x.place", "file", "x.symbol", "x.kind", "x.change_type", "x.start_line", F.lit(None).cast("int").alias("end_line"))


def _of_file() -> tuple[Column, Column]:
    """A hunk's change and symbol if it counts for its file as a whole."""
    change = F.when(F.size("removed") == 0, "added").when(F.size("added") == 0, "deleted").otherwise("modified")
    return change, F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"(?<=.)\.[^.]*$", "")


def file_fallback(hunks: DataFrame) -> DataFrame:
    """One row for each hunk, for its file as a whole."""
    change, stem = _of_file()
    none = F.struct(F.lit(False).alias("late"), F.lit(0).alias("i"), F.lit(0).alias("p"))
    return hunks.select("repo_id", "commit_id", "hunk", none.alias("place"), "file", stem.alias("symbol"), F.lit("unknown").alias("kind"), change.alias("change_type"), F.col("start").cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line"))


def number_changes(changed: DataFrame) -> DataFrame:
    """Changed symbols with their ordinal in the commit."""
    own = Window.partitionBy("repo_id", "commit_id").orderBy("hunk", "place", "symbol")
    return changed.withColumn("ordinal", F.row_number().over(own)).drop("hunk", "place")
