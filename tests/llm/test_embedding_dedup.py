import numpy as np
import pytest

from quern.llm import embedding_dedup as ed


def brute(rows, t=0.95):
    """{id: (class, links)} over (id, vector) rows of unique ids."""
    ids = [i for i, _ in rows]
    x = np.array([v for _, v in rows], float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= t
    root = dict(zip(ids, ids))
    while True:
        new = {a: min(root[b] for b, ok in zip(ids, near[i]) if ok) for i, a in enumerate(ids)}
        if new == root:
            return {a: (root[a], int(near[i].sum()) - 1) for i, a in enumerate(ids)}
        root = new


def clustered(n, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n // 3, dim))
    x = base[rng.integers(0, len(base), n)] + rng.standard_normal((n, dim)) * rng.uniform(0.02, 0.35, (n, 1))
    return x.astype(np.float32)


def frame(spark, rows):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in rows], "vec_id long, embedding array<float>")


@pytest.mark.parametrize("cell, most", [(4096, 4096), (64, 4096), (64, 32)])  # one group and axis, several, hot cells in blocks
def test_links_and_classes(spark, cell, most):
    rows = list(enumerate(clustered(600)))
    want = brute(rows)
    got = {r.id: (r.class_id, r.links) for r in ed.near_duplicates(frame(spark, rows), cell=cell, most=most).collect()}
    assert set(got) == set(want) and all(got[i][1] <= want[i][1] for i in want)
    assert sum(n for _, n in got.values()) >= 0.97 * sum(n for _, n in want.values()) > 200


def test_dense_cluster_and_ties(spark):
    rng = np.random.default_rng(3)
    centre = rng.standard_normal(24)
    rows = list(enumerate((centre + 0.03 * rng.standard_normal((300, 24))).astype(np.float32)))
    rows += [(300 + i, rows[0][1]) for i in range(50)]  # ties: one vector many times
    got = {r.id: (r.class_id, r.links) for r in ed.near_duplicates(frame(spark, rows), most=64).collect()}
    assert got == brute(rows) and {c for c, _ in got.values()} == {0}


def test_candidates_count_collisions():
    p = np.random.default_rng(5).standard_normal((200, 32))
    got = {(int(i), int(j)) for a, b in ed.candidates(p, 1.1, 20) for i, j in zip(a, b)}
    want = {(i, j) for i in range(200) for j in range(i + 1, 200) if (np.abs(p[i] - p[j]) <= 1.1).sum() >= 20}
    assert got == want and len(want) > 50


def test_copies_nulls_and_odd_vectors(spark):
    a, b = [1.0, 2.0, 3.0], [1.0, 2.0, 3.01]
    rows = [(5, a), (2, a), (9, a), (9, a), (7, b), (1, None), (3, [0.0, 0.0, 0.0]), (4, [1.0, None, 2.0]), (6, [1.0]), (12, [2.0]), (None, a), (8, [float("nan"), 1.0, 1.0]), (10, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "0 as id", "0 as class_id", "0 as links", "0 as v", "0 as n")
    got = sorted(tuple(r) for r in ed.near_duplicates(df).collect())
    assert got == [(1, 1, 0), (2, 2, 4), (3, 3, 0), (4, 4, 0), (5, 2, 4), (6, 6, 1), (7, 2, 4), (8, 8, 0), (9, 2, 4), (9, 2, 4), (10, 10, 0), (12, 6, 1)]
    assert ed.near_duplicates(df.limit(0)).count() == 0
