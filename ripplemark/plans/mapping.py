"""A code graph derived from the test tables, by SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbers import identified

#: Model table -> its SQL over the test tables and the model tables before it.
MODEL = {
    "symbols": """SELECT repo_id, repo_id || '.' || replace(substr(file_path, 1, length(file_path) - 3), '/', '.') || '.' || parent || '.' || name AS qualified_name,
 name, 'function' AS type, start_line, end_line, file_path, parent, pos, deleted,
 (substr(name, 1, 5) = 'test_' OR lower(file_path) LIKE '%test%') AS is_test, part_key
 FROM (SELECT substr(sha1('repo' || CAST(p_partkey % 5 AS STRING)), 1, 10) AS repo_id,
  replace(p_name, ' ', '_') || '_' || CAST(p_partkey % 7 AS STRING) AS name,
  (CASE WHEN p_brand = 'Brand#7' THEN 'tests' ELSE lower(replace(p_brand, '#', '_')) END) || '/' || lower(p_type) || '.py' AS file_path,
  'c' || CAST(CAST(floor(p_partkey / 35) AS BIGINT) AS STRING) AS parent,
  CAST(p_size * 10 AS BIGINT) AS start_line, CAST(p_size * 10 + p_partkey % 50 AS BIGINT) AS end_line,
  p_partkey AS pos, p_partkey % 11 = 0 AS deleted, p_partkey AS part_key FROM part) AS x""",
    "files": "SELECT DISTINCT repo_id, file_path AS path FROM symbols",
    "pairs": """SELECT DISTINCT a.l_partkey AS a, b.l_partkey AS b FROM lineitem AS a JOIN lineitem AS b
 ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey % 5 = b.l_partkey % 5""",
    "calls": """SELECT DISTINCT s.repo_id, s.qualified_name AS src, t.qualified_name AS dst
 FROM pairs JOIN symbols AS s ON pairs.a = s.part_key JOIN symbols AS t ON pairs.b = t.part_key""",
    "raw_calls": """SELECT CAST(a AS STRING) || ':' || CAST(b AS STRING) AS call_id, s.repo_id, s.file_path,
 CASE WHEN a % 13 = 0 THEN '<module>' ELSE s.name END AS caller, s.start_line + b % 40 AS line,
 CASE b % 4 WHEN 0 THEN t.name WHEN 1 THEN 'obj.' || t.name WHEN 2 THEN t.name || '()' ELSE 'nope_' || CAST(b AS STRING) END AS callee
 FROM pairs JOIN symbols AS s ON pairs.a = s.part_key JOIN symbols AS t ON pairs.b = t.part_key""",
    "repos": "SELECT DISTINCT repo_id AS id FROM symbols WHERE part_key % 5 <> 4",
    "commits": """SELECT substr(sha1('repo' || CAST(o_orderkey % 5 AS STRING)), 1, 10) AS repo_id, sha1(CAST(o_orderkey AS STRING)) AS id,
 o_orderdate AS ingested_at, o_orderkey FROM orders""",
    "changes": """SELECT DISTINCT s.repo_id, sha1(CAST(o_orderkey AS STRING)) AS commit_id, s.file_path,
 CASE o_orderstatus WHEN 'F' THEN 'M' WHEN 'O' THEN 'A' ELSE 'D' END AS status,
 CASE o_orderstatus WHEN 'F' THEN 'modified' WHEN 'O' THEN 'added' ELSE 'deleted' END AS type
 FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN symbols AS s ON l_partkey = s.part_key""",
    "changed": """SELECT s.repo_id, sha1(CAST(l_orderkey AS STRING)) AS commit_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag) AS BIGINT) AS ordinal, s.file_path AS file, s.name AS symbol,
 s.type AS kind, CASE l_returnflag WHEN 'A' THEN 'added' WHEN 'R' THEN 'deleted' ELSE 'modified' END AS change_type, s.start_line, s.end_line
 FROM lineitem JOIN symbols AS s ON l_partkey = s.part_key""",
    "imports": """SELECT DISTINCT s.repo_id, s.file_path AS path,
 CASE t.part_key % 6 WHEN 0 THEN 'os.path' WHEN 1 THEN '.' || t.name WHEN 2 THEN 'json' ELSE t.parent || '.' || t.name END AS module
 FROM pairs JOIN symbols AS s ON pairs.a = s.part_key JOIN symbols AS t ON pairs.b = t.part_key""",
    "sources": """SELECT source AS repo_id, (CASE WHEN doc_id % 17 = 0 THEN 'build/' ELSE '' END) || lang || '/' || CAST(doc_id AS STRING) ||
 (CASE doc_id % 8 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.TSX' WHEN 3 THEN '.java' WHEN 4 THEN '.h' WHEN 5 THEN '.md' WHEN 6 THEN '' ELSE '.cc' END) AS path,
 text AS content, n_chars * 60 AS size, doc_id, doc_id * 1000 AS mtime_ns FROM documents""",
}


#: Rows that a task sorts and makes distinct at once, however large the tables are.
TASK_ROWS = 500_000


def _parts(lineitem: DataFrame, orders: DataFrame) -> int:
    """Parts that orders and their lines are dealt into by order, so that a task's rows stay bounded (counted from the footers)."""
    spark = lineitem.sparkSession
    # fewer than Spark's own number it would deal out anew for a join
    least = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return max(least, max(lineitem.count(), orders.count()) // TASK_ROWS + 1)


def _pairs(lineitem: DataFrame) -> DataFrame:
    """The rows of MODEL["pairs"]: lines meet in so many parts that a task's rows stay bounded, where Spark's own number is too small for them."""
    n = lineitem.count() // TASK_ROWS + 1  # counted from the footers
    lines = lineitem.select("l_orderkey", "l_partkey", "l_linenumber")
    this, after = ["l_partkey % 5", "l_orderkey", "l_linenumber + 1"], ["l_partkey % 5", "l_orderkey", "l_linenumber"]
    a = b = lines
    if n > int(lineitem.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        a, b = (lines.repartition(n, *map(F.expr, keys)) for keys in (this, after))
    same = F.expr("a.l_partkey % 5 = b.l_partkey % 5 AND a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1")
    return a.alias("a").join(b.alias("b"), same).select(F.col("a.l_partkey").alias("a"), F.col("b.l_partkey").alias("b")).distinct()


def _changes(lineitem: DataFrame, orders: DataFrame, symbols: DataFrame, n: int) -> DataFrame:
    """The rows of MODEL["changes"] and o_orderkey, made distinct as numbers where orders and lines meet, before their strings are made.

    A DISTINCT of the strings, nearly all of which differ, held them in each task and shuffled them once more.
    """
    files = identified(symbols.select("repo_id", "file_path"), "file")
    s, f = symbols.alias("s"), files.alias("f")
    at = s.join(f, F.expr("s.repo_id <=> f.repo_id AND s.file_path <=> f.file_path")).select("part_key", "file")
    touched = lineitem.select("l_orderkey", "l_partkey").join(at, F.col("l_partkey") == F.col("part_key")).select("l_orderkey", "file").repartition(n, "l_orderkey")
    status = F.expr("CASE o_orderstatus WHEN 'F' THEN 'M' WHEN 'O' THEN 'A' ELSE 'D' END").alias("status")
    known = orders.select("o_orderkey", status).repartition(n, "o_orderkey")
    rows = known.join(touched, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "status", "file").distinct()
    kind = F.expr("CASE status WHEN 'M' THEN 'modified' WHEN 'A' THEN 'added' ELSE 'deleted' END").alias("type")
    return rows.join(files, "file").select("o_orderkey", "repo_id", F.sha1(F.col("o_orderkey").cast("string")).alias("commit_id"), "file_path", "status", kind)


def commit_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """commits and changes, both dealt out by o_orderkey, which stands for the commit's id in both: joined by it, they are not shuffled again."""
    lineitem, orders = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders"))
    n = _parts(lineitem, orders)
    (symbols,) = tables(spark, sf_dir, "symbols")
    commits = spark.sql(_replace_table(MODEL["commits"], "FROM", "orders"), t_orders=orders.repartition(n, "o_orderkey"))
    return commits, _changes(lineitem, orders, symbols, n)


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """The model tables, derived in Spark."""
    made: dict[str, DataFrame] = {}
    raw = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "lineitem", "orders", "documents")}

    def get(name: str) -> DataFrame:
        if name == "changes" and name not in made:
            made[name] = _changes(raw["lineitem"], raw["orders"], get("symbols"), _parts(raw["lineitem"], raw["orders"])).drop("o_orderkey")
        if name == "pairs" and name not in made:
            made[name] = _pairs(raw["lineitem"])
        if name not in made:
            sql = MODEL[name]
            frames = {}
            for t in [*raw, *MODEL]:
                if t != name and any(f"{w} {t}" in sql for w in ("FROM", "JOIN")):
                    for w in ("FROM", "JOIN"):
                        sql = _replace_table(sql, w, t)
                    frames[f"t_{t}"] = raw[t] if t in raw else get(t)
            made[name] = spark.sql(sql, **frames)
        return made[name]

    return [get(n) for n in names]


def _replace_table(sql: str, word: str, table: str) -> str:
    import re

    # `FROM part` -> `FROM {t_part} AS part`, unless an alias follows
    sql = re.sub(rf"\b{word} {table}\b(?= AS )", f"{word} {{t_{table}}}", sql)
    return re.sub(rf"\b{word} {table}\b(?! AS )", f"{word} {{t_{table}}} AS {table}", sql)


def with_sql(body: str, recursive: bool = False) -> str:
    """DuckDB SQL: all model tables, then the body (which may begin with further tables)."""
    return f"WITH {'RECURSIVE ' * recursive}" + ",\n".join(f"{n} AS ({s})" for n, s in MODEL.items()) + (",\n" if not body.lstrip().upper().startswith("SELECT") else "\n") + body
