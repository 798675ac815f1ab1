"""The top-k join against brute force, and what its bounds leave out."""

import numpy as np
import pytest

from vexel.llm import common, op8_knn

SCHEMA = "vec_id long, embedding array<double>"


def brute_force(rows, k=5, every=50):
    whole = {(i, tuple(int(np.floor(256.0 * c)) for c in v)) for i, v in rows if i is not None and v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v)}
    out = []
    for q in sorted({i for i, _ in whole if i % every == 0}):
        found = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), j) for i, x in whole if i == q for j, y in whole if j != q and len(x) == len(y))
        out += [(q, r + 1, j, -s) for r, (s, j) in enumerate(found[:k])]
    return out


def got(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


def clusters(n, groups, dim, spread, seed=1):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(groups, dim))
    centers /= np.linalg.norm(centers, axis=1)[:, None]
    return [(i, [float(c) for c in centers[i % groups] + spread * r.normal(size=dim)]) for i in range(n)]


@pytest.mark.parametrize("kind", ["even", "clusters", "norms", "ties", "hot"])
def test_equals_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(op8_knn, "CHUNK", 64)
    monkeypatch.setattr(op8_knn, "QUERIES", 3)
    r = np.random.default_rng(3)
    rows = {
        "even": lambda: clusters(400, 400, 8, 0.0),
        "clusters": lambda: clusters(400, 9, 8, 0.01),
        "norms": lambda: [(i, [float(c) for c in r.normal(size=6) * r.choice([0.01, 1, 30])]) for i in range(400)],
        "ties": lambda: [(i, [float(i % 3), 1.0]) for i in range(300)],
        "hot": lambda: [(i, [1.0, 0.0, 0.5] if i % 3 else [float(c) for c in r.normal(size=3)]) for i in range(400)],
    }[kind]()
    assert got(op8_knn.top_k(spark.createDataFrame(rows, SCHEMA))) == brute_force(rows)


def test_edge_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [1.0, None]), (2, None), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [0.5, 0.5]), (5, [0.25, 0.5]), (None, [1.0, 1.0]), (6, []), (50, [1.0]), (100, [3.0, -1.0]), (-50, [0.0, 0.0])]
    docs = spark.createDataFrame([(*r, 1, 2.0) for r in rows], SCHEMA + ", score int, cell double")
    assert got(op8_knn.top_k(docs)) == brute_force(rows)
    assert got(op8_knn.top_k(spark.createDataFrame([], SCHEMA))) == []
    assert got(op8_knn.top_k(spark.createDataFrame([(50, [1.0, 1.0])], SCHEMA))) == []


def test_clusters_are_pruned(spark, monkeypatch):
    """Of all (query, cell) pairs few are sent where the vectors have clusters."""
    written = {}
    real = common.materialize
    monkeypatch.setattr(op8_knn.common, "materialize", lambda df, tag: written.setdefault(tag, real(df, tag)))
    rows = clusters(6000, 6, 16, 0.01)
    assert got(op8_knn.top_k(spark.createDataFrame(rows, SCHEMA), every=500)) == brute_force(rows, every=500)
    queries, cells = 12, written["cells"].select("cell").distinct().count()
    assert cells >= 15
    assert written["sent"].count() <= 0.25 * queries * cells
