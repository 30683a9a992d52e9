"""Model tables that Spark derives by another way than their SQL."""

from collections import Counter

import duckdb
import pytest

from ripplemark.operators.graph import has_change, has_commit
from ripplemark.plans import mapping
from ripplemark.plans.mapping import MODEL, commit_tables, tables, with_sql
from ripplemark.plans.queries import QUERIES


@pytest.fixture
def odd(spark, tmp_path):
    """Tables with keys that repeat, nulls, keys that nothing has, and every status."""
    part = [(k, None if k == 3 else f"p {k % 4}", None if k == 5 else f"Brand#{k % 3 * 7}", "LARGE" if k % 2 else "SMALL", k % 9) for k in [*range(40), 7, 7]] + [(None, "q", "Brand#2", "LARGE", 1), (7, "q", "Brand#2", "ECONOMY", 1), (8, "q", "Brand#2", "ECONOMY", 1)]
    orders = [(k, "FOPX"[k % 4] if k % 5 else None, "1995-01-01") for k in [*range(30), 3, 3]] + [(3, "O", "1995-01-01"), (None, "F", "1995-01-01")]
    lines = [(k % 35, (k * 7 + k // 11) % 45, k % 4) for k in range(400)] + [(None, 1, 1), (1, None, 1), (2, 7, 1), (4, 8, 1), (4, 8, 1)]
    for name, rows, ddl in (
        ("part", part, "p_partkey long, p_name string, p_brand string, p_type string, p_size int"),
        ("orders", orders, "o_orderkey long, o_orderstatus string, o_orderdate string"),
        ("lineitem", lines, "l_orderkey long, l_partkey long, l_linenumber int"),
        ("documents", [], "doc_id long, text string, lang string, source string, n_chars int"),
    ):
        spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def from_sql(folder, name, columns):
    c = duckdb.connect()
    for t in ("part", "orders", "lineitem", "documents"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return Counter(c.execute(with_sql(f"SELECT {', '.join(columns)} FROM {name}")).fetchall())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_changes_are_made_distinct_as_numbers(spark, odd):
    (df,) = tables(spark, odd, "changes")
    assert Counter(map(tuple, df.collect())) == from_sql(odd, "changes", df.columns)
    aggregates = [x for x in plan(df).splitlines() if "Aggregate(" in x]
    assert aggregates and not any("commit_id" in x or "file_path" in x for x in aggregates)


def test_commits_and_changes_are_joined_where_they_were_dealt_out(spark, odd):
    repos, commits, changes = tables(spark, odd, "repos", "commits", "changes")
    c, h = commit_tables(spark, odd)
    assert Counter(map(tuple, c.collect())) == Counter(map(tuple, commits.collect()))
    assert Counter(map(tuple, h.drop("o_orderkey").collect())) == Counter(map(tuple, changes.collect()))
    for by_number, by_name in ((has_commit(c, repos, "o_orderkey"), has_commit(commits, repos)), (has_change(h, c, "o_orderkey"), has_change(changes, commits))):
        got = Counter(map(tuple, by_number.collect()))
        assert got and got == Counter(map(tuple, by_name.collect()))


def test_joined_commits_repeat_as_in_sql(spark, odd):
    from ripplemark.operators.graph import of_commits

    c, h = commit_tables(spark, odd)
    got = Counter(map(tuple, of_commits(h, c, "o_orderkey", "inner").select("commit_id", "file_path", "type").collect()))
    assert max(got.values()) > 1 and got == from_sql(odd, "commits AS c JOIN changes AS h ON h.repo_id = c.repo_id AND h.commit_id = c.id", ["commit_id", "file_path", "h.type"])


@pytest.mark.parametrize("name", ["j7_commit_edges", "l5_commit_files"])
def test_commits_are_not_shuffled_by_their_strings(spark, odd, name):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffles = [x for x in plan(QUERIES[name](spark, odd)).splitlines() if "Exchange hashpartitioning(" in x]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert any("o_orderkey" in x for x in shuffles) and not any("commit_id" in x for x in shuffles)


@pytest.mark.parametrize("task_rows", [20, 500_000])
def test_lines_meet_in_parts_of_bounded_rows(spark, odd, monkeypatch, task_rows):
    monkeypatch.setattr(mapping, "TASK_ROWS", task_rows)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        (df,) = tables(spark, odd, "pairs")
        assert Counter(map(tuple, df.collect())) == from_sql(odd, "pairs", df.columns)
        dealt = [x for x in plan(df).splitlines() if "Exchange hashpartitioning((l_partkey" in x]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    parts = 405 // task_rows + 1 if task_rows == 20 else 8
    assert dealt and all(f", {parts})" in x for x in dealt)
