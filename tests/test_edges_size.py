"""Import edges: the rows, and how small they are written."""

from collections import Counter

import duckdb
import pytest

from ripplemark.operators import graph

SYMBOLS, IMPORTS = "repo_id string, file_path string, qualified_name string", "repo_id string, path string, module string"


@pytest.mark.parametrize(("block", "task_rows"), [(8, 5), (512, 20_000)])
def test_rows_of_import_edges(spark, monkeypatch, block, task_rows):
    """Files of no, few and many imports, repeated rows, a null import, and keys that are null or nothing else has."""
    monkeypatch.setattr(graph, "BLOCK", block, raising=False)
    monkeypatch.setattr(graph, "TASK_ROWS", task_rows, raising=False)
    symbols = [(f"r{k % 2}", f"f{k % 3}", f"s{k}") for k in range(30)] * 2 + [("r0", "f0", None), (None, "f0", "x"), ("r0", None, "x"), ("r0", "alone", "x")]
    imports = [("r0", "f0", f"m{k}") for k in range(29)] * 2 + [("r0", "f0", None), ("r1", "f1", "m"), (None, "f0", "m"), ("r0", None, "m"), ("r9", "f0", "m")]
    want = {(r, s, m) for r, f, s in symbols for q, p, m in imports if r is not None and f is not None and (r, f) == (q, p)}
    got = Counter(map(tuple, graph.imports_edges(spark.createDataFrame(symbols, SYMBOLS), spark.createDataFrame(imports, IMPORTS)).collect()))
    assert got == Counter(want)
    for s, i in ((symbols, []), ([], imports), ([], [])):
        assert graph.imports_edges(spark.createDataFrame(s, SYMBOLS), spark.createDataFrame(i, IMPORTS)).count() == 0


def test_import_edges_are_written_small(spark, tmp_path):
    """Strings stay in the dictionaries, which a task of all files would overfill."""
    symbols = spark.range(6000).selectExpr("concat('r', id % 2) AS repo_id", "concat('f', id % 12) AS file_path", "concat(repeat(sha1(string(id)), 5), id) AS qualified_name")
    imports = spark.range(12 * 205).selectExpr("concat('r', id % 2) AS repo_id", "concat('f', id % 12) AS path", "sha1(string(id)) AS module")
    graph.imports_edges(symbols, imports).write.parquet(f"{tmp_path}/out")
    chunks = duckdb.sql(f"SELECT encodings, num_values, path_in_schema FROM parquet_metadata('{tmp_path}/out/*.parquet')").fetchall()
    assert sum(n for _, n, column in chunks if column == "src") == 6000 * 205
    assert not any("PLAIN" in e.replace("PLAIN_DICTIONARY", "").split(", ") for e, _, _ in chunks)
