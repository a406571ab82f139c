"""Nearest neighbours against brute force: recall, exact scores, ties, unusable vectors, small and empty tables."""

from __future__ import annotations

import numpy as np
import pytest

from tapewarden.llm import neighbours

KIND = "vec_id long, embedding array<float>, label int, table int, score double"


def frame(spark, ids, vectors):
    return spark.createDataFrame([(i, None if v is None else [float(x) if x is not None else None for x in v], 1, 1, 0.0) for i, v in zip(ids, vectors, strict=True)], KIND)


def exact(ids, x, query, k=10):
    i = ids.index(query)
    score = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
    rows = [(s, v) for s, v in zip(score, ids, strict=True) if v != query]
    return sorted(rows)[:k]


@pytest.mark.parametrize("fine", [None, 2])
def test_recall_and_exact_scores(spark, fine, monkeypatch):
    """Random unit vectors, the hardest case, in cells of a few rows and queries."""
    monkeypatch.setattr(neighbours, "ROW_BLOCK", 64)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = list(range(1500))
    got = neighbours.nearest_neighbours(frame(spark, ids, x), fine=fine).collect()
    x = x.astype(np.float64)
    found = {}
    for row in got:
        assert row.score == np.sqrt(((x[row.query_id] - x[row.vec_id]) ** 2).sum())
        found.setdefault(row.query_id, []).append((row["rank"], row.score, row.vec_id))
    hits = 0
    assert set(found) == set(range(0, 1500, 100))
    for query, rows in found.items():
        assert [r[0] for r in sorted(rows)] == list(range(1, 11))
        assert [r[1:] for r in sorted(rows)] == sorted(r[1:] for r in rows)
        hits += len({r[2] for r in rows} & {v for _, v in exact(ids, x, query)})
    assert hits / (10 * len(found)) >= 0.9


def test_edges(spark):
    one = [1.0, 2.0, 0.5]
    ids = [0, 1, 2, 3, 4, 5, 6, 100, None, 0, 200, 300]
    vectors = [one, one, [2.0, 2.0, 0.5], None, [0.0, 0.0, 0.0], [1.0, None, 1.0], [float("nan"), 1.0, 1.0], [float("inf"), 1.0, 1.0], one, one, [1e-30, 0.0, 0.0], [1.0, 1.0]]
    got = neighbours.nearest_neighbours(frame(spark, ids, vectors)).collect()
    rows = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got}
    # the query 0 twice is one row; 300 has another length and no partner; 200 is tiny but takes part
    assert {q for q, _ in rows} == {0, 200}
    assert rows[0, 1] == (1, 0.0) and rows[0, 2] == (2, 1.0) and rows[0, 3][0] == 200 and len([q for q, _ in rows if q == 0]) == 3
    assert [rows[200, k][0] for k in (1, 2, 3)] == [0, 1, 2]


def test_many_equal_vectors(spark):
    """Ties go to the smaller ids."""
    vectors = [[1.0, 0.0, 0.0, 0.0]] * 300 + [[0.0, 1.0, 0.0, 0.0]] * 5
    got = neighbours.nearest_neighbours(frame(spark, list(range(305)), vectors)).filter("query_id = 200").orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(10)) and all(r.score == 0 for r in got)


def test_empty(spark):
    assert neighbours.nearest_neighbours(frame(spark, [], [])).count() == 0
