"""Near-duplicate vectors against plain loops over all pairs."""

import math

import numpy as np
import pytest

from ripplemark.llm import embeddings as E

DATA = "/root/testdata/sf0.001"


def brute(rows, threshold=E.THRESHOLD):
    """vec_id -> [(n_links, component_id)] by all pairs; rows: (vec_id, vector, label), ids not null or unique."""

    def fit(v):
        return v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n = len(rows)
    links = [set() for _ in rows]
    for i in range(n):
        for j in range(i + 1, n):
            (_, a, la), (_, b, lb) = rows[i], rows[j]
            if la is None or la != lb or not fit(a) or not fit(b) or len(a) != len(b):
                continue
            x, y = (np.array(v, float) / max(map(abs, v)) for v in (a, b))
            if x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
                links[i].add(j)
                links[j].add(i)
    label = list(range(n))
    order = sorted(range(n), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    seen = set()
    for k in order:
        if k not in seen:
            todo = [k]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    label[x] = k
                    todo += links[x]
    return sorted((rows[k][0] is None, rows[k][0] or 0, len(links[k]), -1 if rows[label[k]][0] is None else rows[label[k]][0]) for k in range(n))


def got(df):
    return sorted((r.vec_id is None, r.vec_id or 0, r.n_links, -1 if r.component_id is None else r.component_id) for r in df.collect())


def odd_rows():
    rng = np.random.default_rng(5)
    rows, k = [], 0
    for label in ("x", "y", "x y"):
        for center in rng.normal(size=(6, 12)):
            for _ in range(9):
                rows.append((k, [float(x) for x in center + rng.normal(size=12) * 0.22], label))
                k += 1
    base = rows[3][1]
    rows += [(k + i, list(base), "x") for i in range(30)]  # exact copies
    rows += [(k + 30, [x * 1e-200 for x in base], "x"), (k + 31, [x * 1e180 for x in base], "x"), (k + 32, list(base), None), (k + 33, list(base), "z")]
    rows += [(k + 34, None, "x"), (k + 35, [], "x"), (k + 36, [0.0] * 12, "x"), (k + 37, [None] + base[1:], "x"), (k + 38, [math.nan] + base[1:], "x"), (k + 39, [math.inf] + base[1:], "x"), (k + 40, base[:11], "x"), (k + 41, base[:11], "x")]
    rows += [(None, list(base), "x"), (None, [1.0] + [0.0] * 11, "x"), (k, list(base), "x"), (-4, [x + 0.01 for x in base], "x")]  # no id, a repeated row, a smaller id
    return rows


@pytest.mark.parametrize("block,piece", [(4096, 512), (20, 7)])
def test_links_and_components(spark, monkeypatch, block, piece):
    monkeypatch.setattr(E, "BLOCK", block)
    monkeypatch.setattr(E, "PIECE", piece)
    rows = odd_rows()
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id long, embedding array<double>, label string, row_key int, id int, vector int")
    out = E.near_duplicate_vectors(df)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert got(out) == brute(rows)
    kept = [r for r in out.collect() if r.kept]
    assert all(r.vec_id == r.component_id for r in kept) and sum(r.vec_id is None for r in kept) == 1


def test_borderline_pairs_in_a_plane(spark):
    angles = [0.0, math.acos(0.93), math.acos(0.93) + 1e-7, math.acos(0.93) - 1e-7]
    rows = [(k, [math.cos(a), math.sin(a)], 1) for k, a in enumerate(angles)] + [(9, [0.0, -1.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    at = {r.vec_id: r.n_links for r in E.near_duplicate_vectors(df).collect()}
    assert at[2] == 2 and at[3] == 3 and at[9] == 0
    assert got(E.near_duplicate_vectors(df, threshold=-0.5)) == brute(rows, -0.5)


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert E.near_duplicate_vectors(df).count() == 0
    df = spark.createDataFrame([(1, None, 3)], "vec_id long, embedding array<float>, label int")
    assert [tuple(r) for r in E.near_duplicate_vectors(df).collect()] == [(1, 0, 1, True)]


def test_a_tile_leaves_pairs_as_all_pairs_do():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(300, 24)), np.repeat(rng.normal(size=(1, 24)), 90, 0) + rng.normal(size=(90, 24)) * 0.3])
    ids, copies = np.arange(len(x)) + 7, rng.integers(1, 5, len(x))
    u = E.unit(x)
    link = (u @ u.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    turn = np.linalg.qr(rng.normal(size=(24, 24)))[0]  # any rotation gives the same pairs
    a, n, child, first = E.compare((ids, copies, x), None, turn, 0.9)
    assert dict(zip(a.tolist(), n.tolist())) == {int(ids[k]): int(copies[link[k]].sum()) for k in np.flatnonzero(link.any(1))}
    assert set(child.tolist()) <= set(a.tolist()) and (first < child).all()
    one, n1, *_ = E.compare((ids[:200], copies[:200], x[:200]), (ids[200:], copies[200:], x[200:]), turn, 0.9)
    across = link.copy()
    across[:200, :200] = across[200:, 200:] = False
    assert dict(zip(one.tolist(), n1.tolist())) == {int(ids[k]): int(copies[across[k]].sum()) for k in np.flatnonzero(across.any(1))}


def test_query(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    assert got(E.op11_embeddings(spark, DATA)) == brute(rows)
