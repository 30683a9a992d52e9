"""Reports of commits: the rows, and what is shuffled for them."""

import pytest

from ripplemark.operators import impact, upsert
from ripplemark.plans import jobs

KEY = ["repo_id", "commit_id"]


@pytest.fixture(scope="module")
def code(spark):
    """Two repositories of 40 functions, of which the first three are called by the others, some of them tests."""
    names = [(r, f"f{k}", f"{'tests' if k % 9 == 8 else f'm{k % 4}'}/x{k % 5}.py", k % 9 == 8) for r in ("r", "s") for k in range(40)]
    s = spark.createDataFrame([(r, f"{r}.m.{n}", n, f, "function", False, t) for r, n, f, t in names], "repo_id string, qualified_name string, name string, file_path string, type string, deleted boolean, is_test boolean")
    c = spark.createDataFrame([(r, f"{r}.m.f{k}", f"{r}.m.f{d}") for r in ("r", "s") for d in range(3) for k in range(3, 40) if (k + d) % 3], "repo_id string, src string, dst string")
    seeds = [[0], [1, 0], [0, 1], [2, 7, 2], [39], [0, 1, 2, 3, 5, 8]]
    change = [(r, f"c{c}", n, f"m{k % 4}/x{k % 5}.py", f"f{k}", "function", "modified", 1, 1) for r in ("r", "s") for c in range(24) for n, k in enumerate(seeds[c % len(seeds)], 1)]
    changed = spark.createDataFrame(change, "repo_id string, commit_id string, ordinal long, file string, symbol string, kind string, change_type string, start_line int, end_line int")
    return changed, s, c


def exchanged(node):
    """Names of the columns of each shuffle below a node of a plan."""
    own = [[node.output().apply(k).name() for k in range(node.output().size())]] if node.nodeName() == "Exchange" else []
    return sum((exchanged(node.children().apply(k)) for k in range(node.children().size())), own)


@pytest.fixture
def plain(spark):
    """Plans as they are run, and no broadcast that isn't asked for."""
    for k, v in (("spark.sql.adaptive.enabled", "false"), ("spark.sql.autoBroadcastJoinThreshold", "-1")):
        spark.conf.set(k, v)
    yield
    for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"):
        spark.conf.unset(k)


def test_impacted_symbols_of_reports_are_not_shuffled(code, plain):
    """What a profile reaches is gathered where the profile stands; only commits with their own lists are dealt out."""
    got = jobs.analyze_changes(*code)
    for name in ("reports", "risk", "summary"):
        shuffles = exchanged(got[name]._jdf.queryExecution().executedPlan())
        assert shuffles and not [x for x in shuffles if {"row", "impacted_symbols", "_near", "test_gaps"} & set(x)], name


def test_rows_do_not_depend_on_size(spark, code, plain, monkeypatch):
    """Dictionaries that are too many rows to be sent whole, and few pairs in a task, give the same rows."""
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    outs = ("reports", "risk", "summary", "impacted")
    want = jobs.analyze_changes(*code)
    want = {n: sorted(map(repr, want[n].select(*sorted(want[n].columns)).collect())) for n in outs}
    assert len(want["reports"]) == len(want["summary"]) == 48 and want["impacted"]
    monkeypatch.setattr(upsert, "FEW_ROWS", -1)
    monkeypatch.setattr(impact, "PAIRS", 1)
    got = jobs.analyze_changes(*code)
    for n in outs:
        assert sorted(map(repr, got[n].select(*sorted(got[n].columns)).collect())) == want[n], n


def test_summary_counts_what_reports_list(code):
    got = jobs.analyze_changes(*code)
    listed = {(r.repo_id, r.commit_id): (len({s.file for s in r.changed_symbols}), len({s.file for s in r.impacted_symbols}), len(r.test_gaps), len(r.tests_to_run), ",".join(s.symbol for s in r.changed_symbols)) for r in got["reports"].collect()}
    assert {(r.repo_id, r.commit_id): (r.changed_files, r.impacted_files, r.gaps, r.tests, r.names) for r in got["summary"].collect()} == listed
    assert any(x[1] == 0 for x in listed.values()) and any(x[1] > 1 for x in listed.values())
