"""Operators on small tables with expected rows: what no SQL covers, and runs in several steps."""

import json
import random

import pytest

from ripplemark.functions import paths as P
from ripplemark.operators import changes as C
from ripplemark.operators import context, graph, impact, report, scan
from ripplemark.operators.upsert import cut, upsert
from ripplemark.plans import jobs
from ripplemark.sources import files as S
from ripplemark.sources import parse
from ripplemark.streaming import index as stream
from pyspark.sql import functions as F


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_read_sources(spark, tmp_path):
    (tmp_path / "a b" / "c").mkdir(parents=True)
    (tmp_path / "a b" / "c" / "x.py").write_bytes(b"x = 1\n")
    (tmp_path / "y.txt").write_bytes(b"")
    got = rows(S.read_sources(spark, f"file:{tmp_path}", "r"), "repo_id", "path", "content", "size")
    assert got == [("r", "a b/c/x.py", bytearray(b"x = 1\n"), 6)]  # Spark leaves out files of no bytes


def test_read_payload(spark, tmp_path):
    p = {
        "repo_id": "r", "repo_name": "n", "commit_id": "c", "changes": [{"repo_id": "r", "commit_id": "c", "file_path": "a.py", "status": "M", "type": "modified"}],
        "results": [{"path": "a.py", "language": "python", "symbols": [{"name": "f", "qualified_name": "r.a.f", "start_line": 3, "calls": ["g", "h"], "imports": ["import os"], "file_path": "a.py"}]}, {"path": "b.py"}],
    }
    (tmp_path / "p.json").write_text(json.dumps(p))
    got = S.read_payload(spark, f"{tmp_path}/p.json")
    assert rows(got["repos"]) == [("r", "n", "", "c")] and rows(got["commits"], "repo_id", "id", "mode") == [("r", "c", "")]
    assert rows(got["changes"]) == [("r", "c", "a.py", "modified", "M")]
    assert rows(got["files"]) == [("r", "a.py", "python", ""), ("r", "b.py", "", "")]
    assert rows(got["symbols"]) == [("r", "r.a.f", "f", "", 3, 0, "a.py", 0)]
    assert rows(got["packages"]) == [("r", "os", True, True)] and rows(got["has_commit"]) == [("r", "c")] and rows(got["has_change"]) == [("r", "c", "a.py")] and rows(got["repo_contains"]) == [("r", "a.py"), ("r", "b.py")]
    assert rows(got["calls"], "src", "callee") == [("r.a.f", "g"), ("r.a.f", "h")] and rows(got["imports"], "src", "text") == [("r.a.f", "import os")]
    assert rows(got["contains"]) == [("r", "a.py", "r.a.f")]


def test_write_read_and_clear_graph(spark, tmp_path):
    t = {"files": spark.createDataFrame([("r", "a"), ("s", "b")], "repo_id string, path string")}
    S.write_graph(t, f"{tmp_path}/g")
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "g" / "files").rglob("*.parquet")}
    S.write_graph({"files": spark.createDataFrame([("s", "c")], "repo_id string, path string")}, f"{tmp_path}/g")
    left = {p: p.stat().st_mtime_ns for p in (tmp_path / "g" / "files").rglob("*.parquet")}
    assert len(before) == 2 and len([p for p in before if left.get(p) == before[p]]) == 1  # the bucket of r keeps its file
    assert rows(S.read_graph(spark, f"{tmp_path}/g", ["files", "none"], spark.createDataFrame([("s",)], "repo_id string"))["files"], "repo_id", "path") == [("s", "c")]
    many = spark.range(2000).selectExpr("'p' AS path", "concat('repo', id) AS repo_id")
    S.write_graph({"many": many}, f"{tmp_path}/g")
    assert len(list((tmp_path / "g" / "many").glob("bucket=*"))) <= S.BUCKETS and S.read_graph(spark, f"{tmp_path}/g", ["many"])["many"].count() == 2000
    back = S.read_graph(spark, f"{tmp_path}/g", ["files"])
    assert rows(back["files"], "repo_id", "path") == [("r", "a"), ("s", "c")]
    assert rows(S.clear_graph(back, "r")["files"], "path") == [("c",)] and rows(S.clear_graph(back)["files"]) == []


CHANGED = "repo_id string, commit_id string, ordinal long, file string, symbol string, kind string, change_type string, start_line int, end_line int"
SYMBOLS = "repo_id string, qualified_name string, name string, type string, start_line int, end_line int, file_path string, is_test boolean, deleted boolean"


@pytest.fixture(scope="module")
def code(spark):
    """f is called by g0..g5 in two modules and by the test t; g0 by tcase."""
    names = [("f", "a/f.py", False)] + [(f"g{k}", f"{'a' if k < 3 else 'b'}/g.py", False) for k in range(6)] + [("t", "tests/t.py", True), ("tcase", "tests/t.py", True)]
    s = spark.createDataFrame([("r", f"r.{n}", n, "function", 10 + k, 20, f, x, False) for k, (n, f, x) in enumerate(names)], SYMBOLS)
    e = spark.createDataFrame([("r", f"r.{a}", f"r.{b}") for a, b in [*[(f"g{k}", "f") for k in range(6)], ("t", "f"), ("tcase", "g0")]], "repo_id string, src string, dst string")
    return s, e


def test_report_texts(spark, code, tmp_path):
    changed = spark.createDataFrame([("r", "c", 1, "a/f.py", "f", "function", "modified", 10, 20)], CHANGED)
    r = jobs.analyze_changes(changed, *code)["reports"].withColumn("markdown", report.render_markdown())
    r = report.render_prompts(r, "{changed_symbols}|{fan_out_count}|{impacted_symbols}|{score} {level}|{reasons}|{test_gaps}", "{changed_files}|{file_count}|{tests_to_run}|{level}")
    got = r.first()
    # eight callers: 16, depth two: 6, over modules: 5, tested: -4
    reasons = ["8 downstream symbol(s) impacted", "Impact reaches 2 level(s) deep", "Change crosses module boundaries", "Test coverage found — risk partially mitigated"]
    names = ["g0", "g1", "g2", "g3", "g4", "g5", "t", "tcase"]
    place = {**{f"g{k}": ("a" if k < 3 else "b") + "/g.py" for k in range(6)}, "t": "tests/t.py", "tcase": "tests/t.py"}
    depth = {n: 2 if n == "tcase" else 1 for n in names}
    gaps = [f"{place[n]}::{n}" for n in ("g1", "g2", "g3", "g4", "g5", "t", "tcase")]
    gaps = sorted(gaps[:-1]) + gaps[-1:]
    assert (got.score, got.level, got.reasons, got.tests_to_run) == (23, "high", reasons, ["tests/t.py"])
    explanation = f"Change detected in: f. Downstream impact: {', '.join(names)}. Risk level: HIGH. Reasons: {'; '.join(reasons)}. Test gaps: {', '.join(got.test_gaps)}."
    assert sorted(got.test_gaps) == sorted(gaps) and got.explanation == explanation
    pr = f"## Summary\n{explanation}\n\n**Changed:** f\n**Risk:** HIGH\n**Run:** tests/t.py\n**Gaps:** {', '.join(got.test_gaps)}"
    assert got.pr_description == pr
    lines = ["# Analysis Report", "", "## Risk: HIGH (score: 23)", "", *[f"- {x}" for x in reasons], "", "## Changed Symbols", "", "- **f** (function) in `a/f.py` — modified"]
    lines += ["", "## Downstream Impact", "", *[f"- {n} (function) in `{place[n]}` — depth {depth[n]}" for n in names], "", "## Explanation", "", explanation, "", "## PR Description", "", pr]
    assert got.markdown == "\n".join(lines)
    impacted = "\n".join(f"  {n} (function) in {place[n]} — depth {depth[n]}" for n in names)
    assert got.explainer_prompt == f"f|8|{impacted}|23 high|{'; '.join(reasons)}|{', '.join(got.test_gaps)}"
    assert got.pr_writer_prompt == "a/f.py|3|tests/t.py|high"
    report.write_report(r, f"{tmp_path}/report")
    assert report.read_report(spark, f"{tmp_path}/report", r.schema).collect() == r.collect()


def test_answer_context(spark, code):
    s, e = code
    files = s.select("repo_id", F.col("file_path").alias("path")).distinct()
    imports = spark.createDataFrame([("r", "a/f.py", "os")], "repo_id string, path string, module string")
    asked = [(1, "anything", "f"), (2, "anything", "g1"), (3, "what is in a/f.py and does tcase run", None), (4, "see no/such.py", None), (5, "why", None), (6, None, None)]
    q = spark.createDataFrame(asked, "question_id long, question string, symbol_hint string")
    got = {r.question_id: r.context for r in jobs.answer_context_job(q, s, e, files, imports).collect()}
    down = [f"  - g{k} (function) in {'a' if k < 3 else 'b'}/g.py [depth 1]" for k in range(6)] + ["  - t (function) in tests/t.py [depth 1]", "  - tcase (function) in tests/t.py [depth 2]"]
    assert got[1] == "\n".join(["Symbol: f", "Has test coverage: ['tests/t.py']", "Downstream symbols:", *down])
    assert got[2] == "Symbol: g1\nHas test coverage: []\nNo downstream symbols found in the graph."
    assert got[3] == "File: a/f.py\nImports: os\nSymbols (1):\n  - f (function) at line 10\nSymbol: tcase (function) in tests/t.py at line 18\n  Calls: g0"
    assert got[4] == "No data found in graph for: no/such.py" and got[5] == got[6] == "No symbol context provided."


def test_answer_context_reads_what_is_written(spark, code, monkeypatch):
    """Symbols and edges, which several parts read, are worked out once."""
    s, e = code
    seen, real = [], impact.blast_radius
    monkeypatch.setattr(impact, "blast_radius", lambda seeds, *graph, **more: seen.extend(graph) or real(seeds, *graph, **more))
    files = s.select("repo_id", F.col("file_path").alias("path")).distinct()
    imports = spark.createDataFrame([("r", "a/f.py", "os")], "repo_id string, path string, module string")
    jobs.answer_context_job(spark.createDataFrame([(1, "g1", "f")], "question_id long, question string, symbol_hint string"), s, e, files, imports)
    assert len(seen) == 2 and all(df.inputFiles() for df in seen)


def test_radius_over_all_repositories_and_full_seeds(spark, code):
    s, e = code
    other = s.withColumn("repo_id", F.lit("z")).withColumn("file_path", F.concat(F.lit("z/"), "file_path"))
    both, edges = s.unionByName(other), e.unionByName(e.withColumn("repo_id", F.lit("z")))
    seed = spark.createDataFrame([("f",)], "seed string")
    got = impact.blast_radius(seed, both, edges, scope="all")
    assert got.count() == 16 and set(got.columns) == {"seed", "name", "file", "kind", "depth"}
    assert rows(impact.test_coverage(seed, both, edges, scope="all")) == [("f", "tests/t.py", "t"), ("f", "z/tests/t.py", "t")]
    for n in (3, 7, 8):
        cut = impact.blast_radius(seed.withColumn("repo_id", F.lit("r")), s, e, limit=n)
        assert [r[0] for r in rows(cut, "name")] == ["g0", "g1", "g2", "g3", "g4", "g5", "t", "tcase"][:n]


def test_hub_above_the_limit(spark):
    """A hub's list is cut off; a deleted node in the middle is followed; a million trails are never written."""
    n = 1000
    names = ["hub", "gone", "top", "low"] + [f"c{k:04d}" for k in range(n)] + [f"d{k:04d}" for k in range(n)]
    s = spark.createDataFrame([("r", f"r.{x}", x, "function", 1, 2, "a.py", False, x == "gone") for x in names], SYMBOLS)
    calls = [("low", "hub")] + [(f"c{k:04d}", "low") for k in range(n)] + [("gone", "hub"), ("top", "gone"), ("hub", "c0999")]
    e = spark.createDataFrame([("r", f"r.{a}", f"r.{b}") for a, b in calls], "repo_id string, src string, dst string")
    big = spark.range(n * n).selectExpr("'r' AS repo_id", f"format_string('r.d%04d', id % {n}) AS src", f"format_string('r.c%04d', id div {n}) AS dst")
    seed = spark.createDataFrame([("r", "hub"), ("r", "low"), ("r", "c0999")], "repo_id string, seed string")
    got = rows(impact.blast_radius(seed, s, e.unionByName(big), max_depth=3, limit=50), "seed", "depth", "name")
    assert [x for x in got if x[0] == "hub"] == [("hub", 1, "low"), *[("hub", 2, f"c{k:04d}") for k in range(49)]]
    assert [x for x in got if x[0] == "low"] == [("low", 1, f"c{k:04d}") for k in range(50)]
    assert [x for x in got if x[0] == "c0999"] == [("c0999", 1, f"d{k:04d}") for k in range(50)]
    some = rows(impact.blast_radius(seed.filter("seed = 'hub'"), s, e, limit=2000), "depth", "name")
    assert len(some) == 2 + n + 1 and some[0] == (1, "low") and some[-2:] == [(2, "top"), (3, "hub")]
    paths = rows(impact.impact_paths(seed.filter("seed <> 'hub'"), s, e.unionByName(big), 2, 50), "seed", "depth", "path")
    assert paths == [("c0999", 1, ["c0999", f"d{k:04d}"]) for k in range(50)] + [("low", 1, ["low", f"c{k:04d}"]) for k in range(50)]
    deep = rows(impact.blast_radius_all_depths(seed.filter("seed = 'hub'"), s, e.unionByName(big), 3, 1010), "depth", "name")
    assert deep[:2] == [(1, "low"), (2, "c0000")] and len(deep) == 1010 and deep[-1] == (3, "d0007") and deep[1002 - 1] == (2, "top")


def test_includes_and_failures(spark):
    text = 'import java.util.List;\r\nimport static a.B.c;\rimport x;\n  import a.b.*;\nimportant y;\n#include <z.h>\n'
    f = spark.createDataFrame([("r", "A.java", text), ("r", "a.h", '#include "q/w.h"\n # include <v>\nimport a.b;'), ("r", "a.py", "import os")], "repo_id string, path string, text string")
    assert rows(parse.parse_include_lines(f), "path", "pos", "module", "name") == sorted([("A.java", 0, "java.util", "List"), ("A.java", 1, "a.B", "c"), ("A.java", 2, "x", None), ("A.java", 3, "a.b", "*"), ("a.h", 0, "q/w.h", None), ("a.h", 1, "v", None)], key=str)
    src = spark.createDataFrame([("r", "good.py", b"def f(): pass\n"), ("r", "bad.py", b"def f(:\n"), ("r", "x.js", b"var x")], "repo_id string, path string, content binary")
    parsed = parse.parse_sources(src)
    assert [r.path for r in parse.parse_failures(parsed).collect()] == ["bad.py"] and parsed.count() == 2
    tables = jobs.index_job(src.withColumn("size", F.lit(1)), spark.createDataFrame([], "repo_id string, path string, hash string"))
    assert rows(tables["snapshots"], "path") == [("good.py",)] and rows(tables["failures"], "path") == [("bad.py",)]


def test_plugged_in_parser(spark):
    def words(content, path):
        return [(k, w, "function", k + 1, k + 1, None) for k, w in enumerate(content.decode().split())], [], [(0, "a", "b", 1)]

    src = spark.createDataFrame([("r", "x.js", b"a b"), ("r", "y.py", b"import os")], "repo_id string, path string, content binary")
    t = parse.parsed_tables(parse.parse_sources(src, {"javascript": words, "python": parse.parse_python}))
    assert rows(t["symbols"], "path", "name") == [("x.js", "a"), ("x.js", "b")] and rows(t["calls"], "caller", "callee") == [("a", "b")] and rows(t["imports"], "path", "module") == [("y.py", "os")]


PY = {
    "lib.py": "import os\ndef base():\n    pass\n",
    "mid.py": "import json\nfrom .lib import base\nclass M:\n    def run(self, xs=[1]):\n        base()\n        self.stop()\n        a.b(\n          'é', 1).c()\n    def stop(self):\n        pass\nfirst, second = 1, 2\n",
    "top.py": "def go():\n    M().run()\n    run()\n",
}


def test_python_parser():
    symbols, imports, calls = parse.parse_python(PY["mid.py"].encode(), "mid.py")
    assert [(s[1], s[2], s[5]) for s in symbols] == [("M", "class", None), ("run", "method", "M"), ("stop", "method", "M"), ("first", "variable", None), ("second", "variable", None)]
    assert [i[1:3] for i in imports] == [("json", None), (".lib", "base")]
    assert [c[1:3] for c in calls] == [("run", "base"), ("run", "stop"), ("run", "a.b(\n          'é', 1).c"), ("run", "a.b")]
    assert len(parse.parse_python(b"def f():\n" + b"    g(h)\n" * 20000, "x.py")[2]) == 20000


def test_call_owners():
    """The sweep against a search of all symbols, with overlapping ranges, equal names, ties and calls out of order."""
    rng = random.Random(3)
    for _ in range(200):
        symbols = [(k, rng.choice("abc"), "function", a := rng.randrange(30), a + rng.randrange(12), rng.choice([None, "P"])) for k in range(rng.randrange(12))]
        calls = [(k, rng.choice(["a", "b", "c", "<module>"]), "x", rng.randrange(45)) for k in range(rng.randrange(25))]
        held = [[(s[4] - s[3], s[0]) for s in symbols if s[1] == c[1] and s[3] <= c[3] <= s[4]] for c in calls]
        assert parse.call_owners(symbols, calls) == [min(h)[1] if h else None for h in held]


def test_calls_are_owned_while_parsed(spark):
    """Calls put to symbols in the parse batch make the graph that the join makes; no join or window by call is planned."""
    src = spark.createDataFrame([("r", p, t.encode(), len(t)) for p, t in PY.items()], "repo_id string, path string, content binary, size long")
    changes = spark.createDataFrame([], "repo_id string, commit_id string, file_path string, status string, type string")
    parsed = jobs.index_job(src, spark.createDataFrame([], "repo_id string, path string, hash string"))
    got = jobs.build_graph_job(parsed, changes)
    want = jobs.build_graph_job(parsed | {"calls": parsed["calls"].drop("owner", "parent")}, changes)
    for name in ("calls", "resolved", "calls_by_symbol"):
        assert rows(got[name], *sorted(got[name].columns)) == rows(want[name], *sorted(want[name].columns)) != [], name


def test_packed_files(spark):
    """Few large files among many small ones: partitions of about equal bytes, each file once, the same whenever it is done."""
    sizes = [(f"r{k % 3}", f"f{k}.py", 5_000) for k in range(2_000)] + [("r0", f"big{k}.py", 512_000) for k in range(6)] + [("r0", "none.py", None), ("r0", "f0.py", 5_000), (None, None, 10)]
    src = spark.createDataFrame(sizes, "repo_id string, path string, size long").withColumn("content", F.lit(b"x"))

    def dealt(df, *more):
        return {r.p: r.n for r in parse.packed(df, *more).groupBy(F.spark_partition_id().alias("p")).agg(F.sum("size").alias("n")).collect()}

    first = dealt(src)
    held = sorted(first.values())
    assert len(held) == 8 and held[-1] < 2 * held[4] and sum(held) == sum(n or 0 for _, _, n in sizes) and dealt(src.repartition(5)) == first
    many = dealt(src, 100_000)
    assert len(many) > 100 and sorted(many.values())[-1] < 900_000
    assert sorted(map(str, parse.packed(src).select("repo_id", "path", "size").collect())) == sorted(map(str, src.select("repo_id", "path", "size").collect()))
    assert parse.packed(src.filter("false")).count() == 0 and parse.packed(src.drop("size")).count() == len(sizes)


def test_two_batches_equal_a_full_build(spark):
    """Nodes and edges grow batch by batch to those of one build; keys of every node table."""
    src = spark.createDataFrame([("r", p, t.encode(), len(t)) for p, t in PY.items()], "repo_id string, path string, content binary, size long")
    changes = spark.createDataFrame([("r", f"c{k}", "lib.py", "M", "modified") for k in range(2)], "repo_id string, commit_id string, file_path string, status string, type string")
    nodes = {"repos": spark.createDataFrame([("r", "n")], "id string, name string"), "commits": spark.createDataFrame([("r", "c0", "git"), ("r", "c1", "git")], "repo_id string, id string, mode string")}
    none = spark.createDataFrame([], "repo_id string, path string, hash string")
    whole = jobs.build_graph_job(jobs.index_job(src, none), changes, nodes=nodes)
    old, snap = None, none
    for k, part in enumerate(("path = 'lib.py'", "path = 'mid.py'", "path = 'top.py'")):
        done = jobs.index_job(src.filter(part), snap)
        mine = {"repos": nodes["repos"].withColumn("name", F.lit(f"n{k}")), "commits": nodes["commits"].filter(f"id = 'c{k % 2}'")}
        old, snap = jobs.build_graph_job(done, changes.filter(f"commit_id = 'c{k % 2}'"), old, mine), done["snapshots"]
    for name in ("symbols", "files", "packages", "calls", "contains", "imports", "commits", "changes", "has_commit", "has_change", "repo_contains"):
        assert rows(old[name], *sorted(old[name].columns)) == rows(whole[name], *sorted(whole[name].columns)), name
    assert rows(old["repos"]) == [("r", "n2")] and rows(whole["calls"], "src", "dst") and len(rows(whole["packages"])) == 3
    again = jobs.build_graph_job(jobs.index_job(src, none), changes.withColumn("status", F.lit("D")), old, nodes)
    assert rows(again["changes"], "commit_id", "status") == [("c0", "D"), ("c1", "D")] and rows(again["repos"]) == [("r", "n")]


def test_last_row_of_repeated_keys(spark, tmp_path):
    """Within one run and against an older graph the last row of a key stays; a stored graph keeps other repositories' files."""
    src = spark.createDataFrame([("r", p, t.encode(), len(t)) for p, t in PY.items()], "repo_id string, path string, content binary, size long")
    none = spark.createDataFrame([], "repo_id string, path string, hash string")
    parsed = jobs.index_job(src, none)
    changes = spark.createDataFrame([("r", "c0", "lib.py", x, t) for x, t in (("M", "modified"), ("D", "deleted"), ("A", "added"))], "repo_id string, commit_id string, file_path string, status string, type string").coalesce(1)
    nodes = {"repos": spark.createDataFrame([("r", "zzz"), ("r", "aaa"), ("r", "mmm")], "id string, name string").coalesce(1), "commits": spark.createDataFrame([("r", "c0", "z"), ("r", "c0", "a")], "repo_id string, id string, mode string").coalesce(1)}
    once = jobs.build_graph_job(parsed, changes, nodes=nodes)
    twice = jobs.build_graph_job(parsed, changes, once, nodes)
    for got in (once, twice):
        assert rows(got["repos"]) == [("r", "mmm")] and rows(got["commits"]) == [("r", "c0", "a")] and rows(got["changes"], "status") == [("A",)]
    path = f"{tmp_path}/g"
    jobs.update_graph_job(spark, path, parsed, changes, nodes)
    other = {k: v.withColumn("repo_id", F.lit("q")) for k, v in parsed.items() if "repo_id" in v.columns}
    mine = {"repos": nodes["repos"].withColumn("id", F.lit("q")), "commits": nodes["commits"].withColumn("repo_id", F.lit("q"))}
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "g").rglob("*.parquet")}
    for _ in range(2):
        jobs.update_graph_job(spark, path, other, changes.withColumn("repo_id", F.lit("q")), mine)
    assert all(p.stat().st_mtime_ns == t for p, t in before.items())
    stored = S.read_graph(spark, path, jobs.STORED)
    assert set(stored) == set(jobs.STORED)
    for n in jobs.STORED:
        key = "id" if n == "repos" else "repo_id"
        assert rows(stored[n].filter(F.col(key) == "r"), *sorted(once[n].columns)) == rows(once[n], *sorted(once[n].columns)), n
    assert stored["symbols"].filter("repo_id = 'q'").count() == once["symbols"].count()


def test_payloads_to_a_graph(spark, tmp_path):
    """Two payloads: calls resolve within a payload or against the repository; stale symbols stay or go; the last of equal names stays."""

    def payload(k, commit, files, changes=()):
        results = [{"path": p, "language": "python", "symbols": [{"name": n, "qualified_name": f"r.{p[0]}.{n}", "type": "function", "start_line": i, "end_line": i + 1, "calls": c, "imports": ["import os", "from a.b import c as d", "no import"]} for i, (n, c) in enumerate(symbols)]} for p, symbols in files.items()]
        (tmp_path / f"{k}.json").write_text(json.dumps({"repo_id": "r", "repo_name": "n", "commit_id": commit, "changes": [{"file_path": p, "status": "D", "type": "deleted"} for p in changes], "results": results}))
        return S.read_payload(spark, f"{tmp_path}/{k}.json")

    one = jobs.ingest_payload_job(payload(1, "c1", {"a.py": [("f", ["g()", "x.h", "none"]), ("g", []), ("g", ["f"])], "b.py": [("h", ["f"]), ("g", [])]}, ["b.py"]))
    assert rows(one["calls"], "src", "dst") == [("r.a.f", "r.a.g"), ("r.a.f", "r.b.h"), ("r.a.g", "r.a.f"), ("r.b.h", "r.a.f")]
    assert rows(one["symbols"], "qualified_name", "start_line", "deleted") == [("r.a.f", 0, False), ("r.a.g", 2, False), ("r.b.g", 1, True), ("r.b.h", 0, True)]
    assert rows(one["packages"], "name") == [("a.b",), ("os",)] and one["imports"].count() == 8 and rows(one["has_change"]) == [("r", "c1", "b.py")]
    second = payload(2, "c2", {"a.py": [("g", ["h"])]})
    own, repo, pruned = (jobs.ingest_payload_job(second, one, **k) for k in ({}, {"scope": "repo"}, {"scope": "repo", "prune_stale": True}))
    assert rows(own["calls"], "src", "dst") == rows(one["calls"], "src", "dst") and own["resolved"].filter("dst IS NULL").count() == 1
    assert rows(repo["calls"], "src", "dst") == sorted([*rows(one["calls"], "src", "dst"), ("r.a.g", "r.b.h")])
    assert rows(pruned["calls"], "src", "dst") == [("r.a.g", "r.b.h")] and rows(pruned["symbols"], "qualified_name") == [("r.a.g",), ("r.b.g",), ("r.b.h",)]
    assert rows(pruned["contains"], "path", "qualified_name") == [("a.py", "r.a.g"), ("b.py", "r.b.g"), ("b.py", "r.b.h")] and rows(pruned["imports"].select("src").distinct()) == [("r.a.g",), ("r.b.g",), ("r.b.h",)]
    assert rows(pruned["has_commit"], "commit_id") == [("c1",), ("c2",)] and rows(pruned["repos"], "latest_commit_id") == [("c2",)]


def test_missing_fields_and_default_prompts(spark):
    kinds = "changed_symbols array<struct<file string, symbol string, kind string, change_type string>>, impacted_symbols array<struct<name string, file string, kind string, depth int>>, score int, level string, reasons array<string>, explanation string, pr_description string, tests_to_run array<string>, test_gaps array<string>"
    r = spark.createDataFrame([([(None, "f", None, "modified")], [("g", None, "function", 1)], 3, "low", [], "why", "", [], [])], kinds)
    got = report.render_prompts(r.withColumn("markdown", report.render_markdown())).first()
    assert "- **f** (?) in `?` — modified" in got.markdown and "- g (function) in `?` — depth 1" in got.markdown
    assert got.explainer_prompt.startswith("A commit changed these symbols: f\nIt reaches 1 other symbols:\n  g (function) in ? — depth 1\n") and "all covered" in got.explainer_prompt
    assert got.pr_writer_prompt.startswith("Commit by unknown on unknown: \n") and "Tests to run: none identified" in got.pr_writer_prompt


def test_prune_stale(spark):
    symbols = spark.createDataFrame([("r", "r.a", "a.py"), ("r", "r.b", "a.py"), ("r", "r.c", "c.py")], "repo_id string, qualified_name string, file_path string")
    edges = spark.createDataFrame([("r", "r.a", "r.c"), ("r", "r.b", "r.c"), ("r", "r.c", "r.a")], "repo_id string, src string, dst string")
    fresh = spark.createDataFrame([("r", "r.a", "a.py")], "repo_id string, qualified_name string, file_path string")
    assert rows(graph.prune_stale(edges, symbols, fresh), "src") == [("r.a",), ("r.c",)]


def test_touch_registry(spark):
    reg = spark.createDataFrame([("r", 1, None), ("s", 2, None)], "repo_id string, total_files long, last_indexed timestamp")
    stats = spark.createDataFrame([("r", 9)], "repo_id string, total_files long")
    for full, n in ((True, 9), (False, 1)):
        got = {r.repo_id: (r.total_files, str(r.last_indexed)) for r in scan.touch_registry(reg, stats, "2024-01-02 03:04:05", full).collect()}
        assert got == {"r": (n, "2024-01-02 03:04:05"), "s": (2, "None")}


@pytest.mark.parametrize("most", [100_000, 2])  # where the paths stand, and by a join
def test_ignore_rules_of_each_repository(spark, monkeypatch, most):
    monkeypatch.setattr(scan, "RULES", most)
    f = spark.createDataFrame([(r, p) for r in "rs" for p in ("a.log", "keep.log", "src/a.log", "build/x/y.py", "doc/a.txt", "b!.py")], "repo_id string, path string")
    rules = [("r", 0, "*.log"), ("r", 1, "!keep.log"), ("r", 2, "/build/"), ("r", 3, "# none"), ("r", 4, None), ("s", 0, "doc/**"), ("s", 1, "[a-b]!.py")]
    out = scan.apply_ignore_patterns(f, spark.createDataFrame(rules, "repo_id string, ordinal int, pattern string"))
    assert ("Exchange" in out._jdf.queryExecution().executedPlan().toString()) == (most == 2)
    got = rows(out)
    assert got == [("r", "b!.py"), ("r", "doc/a.txt"), ("r", "keep.log"), ("s", "a.log"), ("s", "build/x/y.py"), ("s", "keep.log"), ("s", "src/a.log")]


def test_contains_by_rarest_letters(spark):
    t = spark.createDataFrame([(f"get_{k}",) for k in range(5)] + [("ab",), ("xget",)], "q string")
    h = spark.createDataFrame([("get",), ("get_3",), ("zzz",), ("xge",)], "hint string")
    got = rows(context._containing(h, t, "q"), "hint", "q")
    assert got == sorted([("get", f"get_{k}") for k in range(5)] + [("get", "xget"), ("get_3", "get_3"), ("xge", "xget")])


def test_contains_without_shuffling_the_table(spark):
    """Few hints: the table's rows meet them where they stand."""
    t = spark.createDataFrame([(f"get_{k}",) for k in range(5)], "q string")
    out = context._containing(spark.createDataFrame([("get",), ("t_3",)], "hint string"), t, "q")
    assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    assert rows(out, "hint", "q") == sorted([("get", f"get_{k}") for k in range(5)] + [("t_3", "get_3")])


def test_stream_runs_batches_again(spark, tmp_path):
    """Late older versions change nothing; a batch run again after it was written gives the same snapshot; whole snapshots."""
    path = f"file://{tmp_path}/out"
    versions = [[("r", "a", "h1", 1), ("r", "b", "h1", 1)], [("r", "a", "h3", 3), ("r", "a", "h2", 2)], [("r", "a", "h2", 2), ("r", "c", "h1", 1)]]
    for k, v in enumerate(versions):
        spark.createDataFrame(v, stream.SNAPSHOT).coalesce(1).write.parquet(f"{tmp_path}/in{k}")
    want = [("r", "a", "h3", 3), ("r", "b", "h1", 1), ("r", "c", "h1", 1)]

    def run(check):
        for k in range(3):
            files = spark.readStream.schema(stream.SNAPSHOT).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in[0-{k}]")
            stream.stream_index(files, path, f"file://{tmp_path}/{check}").awaitTermination()

    run("check1")
    assert rows(stream.read_snapshot(spark, path)) == want
    run("check2")  # the checkpoint was lost: every batch is run again over its own finished folder
    assert rows(stream.read_snapshot(spark, path)) == want
    assert rows(stream.read_snapshot(spark, path, 1)) == [("r", "a", "h1", 1), ("r", "b", "h1", 1)]


def test_stream_reads_the_buckets_of_a_batch(spark, tmp_path, monkeypatch):
    """Equal versions are settled by hash in any order; a batch reads its own buckets; whole snapshots make older folders needless."""
    path = f"file://{tmp_path}/out"
    many = [("r", f"f{k}", "h", 1) for k in range(600)]
    for k, v in enumerate([many, [("r", "f1", "hz", 1), ("r", "f2", "a", 1), ("r", "f3", "z", 2)], [("r", "f1", "ha", 1)], [("r", "f1", "hz", 2)]]):
        spark.createDataFrame(v, stream.SNAPSHOT).coalesce(1).write.parquet(f"{tmp_path}/in{k}")

    def run(k, check="check"):
        files = spark.readStream.schema(stream.SNAPSHOT).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in[0-{k}]")
        stream.stream_index(files, path, f"file://{tmp_path}/{check}").awaitTermination()

    for k in range(4):
        run(k)
    got = {r.path: (r.hash, r.version) for r in stream.read_snapshot(spark, path).collect()}
    assert (got["f1"], got["f2"], got["f3"], len(got)) == (("hz", 1), ("h", 1), ("z", 2), 600)
    part = lambda n: spark.read.schema(stream.SNAPSHOT).parquet(f"{tmp_path}/out/part-{n:012d}")
    assert rows(part(1), "path") == [("f1",), ("f3",)] and part(2).count() == part(3).count() == 0
    touched = [r[0] for r in spark.createDataFrame([("r", "f1"), ("r", "f3")], "repo_id string, path string").select(stream._bucket()).collect()]
    own = stream.read_snapshot(spark, path, None, touched)
    own.collect()
    scans = own._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: ")[1:]
    # folders of batches that changed nothing have no buckets and no rows
    assert sum(x.startswith("[bucket#") for x in scans) >= 2 and all(x[:8] in ("[bucket#", "[], Push") for x in scans) and own.count() < 50
    monkeypatch.setattr(stream, "WHOLE_EVERY", 2)
    run(3, "again")
    assert {r.path: (r.hash, r.version) for r in stream.read_snapshot(spark, path).collect()} == got
    left = {p.name for p in (tmp_path / "out").glob("*-*")}
    assert "part-000000000000" not in left and {"part-000000000002", "whole-000000000001", "whole-000000000003"} <= left


def test_upsert_takes_the_last(spark):
    base = spark.createDataFrame([(1, "a", 9), (2, "b", 9)], "k int, v string, o int")
    delta = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 0)], "k int, v string, o int")
    assert rows(upsert(base, delta, ["k"], [F.col("o")]), "k", "v") == [(1, "a"), (2, "d"), (3, "e")]


def test_content_hash(spark):
    assert rows(spark.createDataFrame([(b"",)], "c binary").select(P.content_hash(F.col("c"))))[0][0].startswith("e3b0c442")


def test_commits_share_profiles(spark, monkeypatch):
    """What a change reaches is written once for each list of symbols, not for each commit; order and ordinals stay each commit's own."""
    code = spark.createDataFrame([("r", f"r.m{k}.f{k}", f"f{k}", f"m{k}.py", "function", False, False) for k in range(40)], "repo_id string, qualified_name string, name string, file_path string, type string, deleted boolean, is_test boolean")
    calls = spark.createDataFrame([("r", f"r.m{k}.f{k}", f"r.m{d}.f{d}") for d in (0, 1) for k in range(2, 40)], "repo_id string, src string, dst string")
    change = [("r", f"c{c:02d}", n, f"m{k}.py", f"f{k}", "function", "modified", 1, 1) for c in range(50) for n, k in ([(3, 0), (7, 1)] if c % 2 else [(2, 1), (9, 0)])]
    changed = spark.createDataFrame(change, "repo_id string, commit_id string, ordinal long, file string, symbol string, kind string, change_type string, start_line int, end_line int")
    sizes = []

    def counted(df):
        out = cut(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(jobs, "cut", counted)
    got = jobs.analyze_changes(changed, code, calls)
    assert max(sizes) <= 100, sizes  # the changes; it was 50 * 38 rows
    impacted = got["impacted"].collect()
    assert len(impacted) == 50 * 38 and {(r.commit_id, r.ordinal) for r in impacted} == {(f"c{c:02d}", 3 if c % 2 else 2) for c in range(50)}
    r = {x.commit_id: x for x in got["reports"].collect()}
    assert len(r) == 50 and r["c01"].test_gaps[:2] == ["m0.py::f0", "m1.py::f1"] and r["c02"].test_gaps[:2] == ["m1.py::f1", "m0.py::f0"] and len(r["c02"].test_gaps) == 40


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_patches_are_read_where_they_stand(spark):
    """No window and no shuffle; definitions by side, hunks without any, lines before a header, odd headers and breaks."""
    patch = "\n".join([
        "noise", "diff --git a/x.py b/x.py", "--- a/x.py", "+++ b/x.py", "+def early(a):", "@@ -1,2 +5,3 @@ def z():", " def same(a):", "-def f(a):", "+class K:", "+def f(a, b):", "+def f(c):", "-def gone(a):", "--- x", "@@ -9 +bad @@", "+x = 1", "@@ -20 +30 @@", " y", "@@ -40 +50 @@", "-z = 2",
        "diff --git a/d/T.java b/d/T.java\r", "@@ -1 +2 @@\r", "+public int go(int a) {\r", "+class T {", "diff --git nothing", "+def no(a):",
    ])
    hunks = C.read_patches(spark.createDataFrame([("r", "c", patch), ("r", "d", None)], "repo_id string, commit_id string, patch string"))
    found = C.changed_symbols(hunks)
    assert "Exchange" not in plan_of(found) and "Window" not in plan_of(found)
    assert rows(found, "hunk.block", "hunk.at", "symbol", "kind", "change_type", "start_line") == sorted([
        (1, 0, "early", "function", "added", None), (1, 1, "K", "class", "added", 5), (1, 1, "f", "function", "modified", 6), (1, 1, "gone", "function", "deleted", 6), (1, 2, "x", "unknown", "added", None), (1, 4, "x", "unknown", "deleted", 50), (2, 1, "T", "class", "added", 3), (2, 1, "go", "method", "added", 2),
    ], key=lambda r: r[:3])


def test_parsed_files_are_handed_on(monkeypatch):
    """A batch of many files is not held parsed as a whole."""
    import pandas as pd

    df = pd.DataFrame([("r", f"{k}.py", "python", "h", b"def f():\n    g()\n" * 20_000) for k in range(6)], columns=["repo_id", "path", "language", "hash", "content"])
    got = list(parse.parsed_frames(iter([df]), parse.PARSERS))
    assert [len(g) for g in got] == [3, 3] and [p for g in got for p in g["path"]] == [f"{k}.py" for k in range(6)]
    assert all(len(x) == 20_000 for g in got for x in g["calls"])


def test_full_seeds_are_not_followed(spark, monkeypatch):
    """A seed with `limit` direct callers has its list; only other seeds' callers are looked for further."""
    asked = []
    real = impact.caller_lists
    monkeypatch.setattr(impact, "caller_lists", lambda start, *a: asked.extend(r.seed for r in start.select("seed").collect()) or real(start, *a))
    code = [("r", f"r.{n}", n, f"{n}.py", "function", False) for n in ["hot", "cold", "u0", *(f"h{k}" for k in range(5))]]
    symbols = spark.createDataFrame(code, "repo_id string, qualified_name string, name string, file_path string, type string, deleted boolean")
    edges = spark.createDataFrame([("r", f"r.h{k}", "r.hot") for k in range(5)] + [("r", "r.u0", "r.cold"), ("r", "r.h1", "r.u0"), ("r", "r.u0", "r.h0")], "repo_id string, src string, dst string")
    got = impact.blast_radius(spark.createDataFrame([("r", "hot"), ("r", "cold")], "repo_id string, seed string"), symbols, edges, max_depth=3, limit=4)
    assert rows(got, "seed", "name", "depth") == [("cold", "h1", 2), ("cold", "u0", 1), *[("hot", f"h{k}", 1) for k in range(4)]]
    assert set(asked) == {"cold"}
