"""Product codes against a plain-Python codebook, and sliced masks against a search of all entries."""

from __future__ import annotations

import random

import numpy as np
import pytest
from brute import product_codes

from tapewarden.llm import codes

SCHEMA = "vec_id long, embedding array<double>, label int, code string, n long"


@pytest.mark.parametrize(("entries", "width", "scale"), [(1, 3, 10), (7, 1, 3), (64, 4, 5), (256, 16, 2000), (256, 2, 1 << 25), (200, 0, 1)])
def test_sliced_masks_find_the_nearest(entries, width, scale):
    rng = np.random.default_rng(entries + width)
    book = rng.integers(-scale, scale + 1, (entries, width))
    if entries > 5:
        book[entries // 2] = book[1]  # a tie: the lower index counts
    x = np.concatenate([rng.integers(-2 * scale, 2 * scale + 1, (300, width)), book])
    index, distance = codes.SlicedBook(book).nearest(x)
    all_of_them = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
    assert (index == all_of_them.argmin(axis=1)).all() and (distance == all_of_them.min(axis=1)).all()


def test_a_box_is_what_its_radius_says():
    rng = np.random.default_rng(3)
    book, x = rng.integers(-50, 50, (130, 5)), rng.integers(-50, 50, (40, 5))
    radius = rng.integers(0, 60, 40)
    want = (np.abs(x[:, None, :] - book[None]) <= radius[:, None, None]).all(axis=2)
    assert (codes.SlicedBook(book).in_box(x, radius) == want).all()


def vectors(n: int, width: int) -> list[tuple]:
    rng = random.Random(n)
    rows = [(k, [rng.gauss(0, 0.3) for _ in range(width)], rng.choice([1, 2, 3, None])) for k in range(n)]
    if n > 10:
        rows[4] = (4, rows[3][1], 2)
    return rows


@pytest.mark.parametrize(("n", "width", "limit"), [(400, 8, 100_000), (30, 4, 100_000), (300, 4, 0)])
def test_codes(spark, monkeypatch, n, width, limit):
    monkeypatch.setattr(codes, "BROADCAST_LABELS", limit)
    rows = vectors(n, width)
    inf, nan = float("inf"), float("nan")
    odd = [(900, None, 1), (901, [None] * width, 1), (902, [inf] * width, 2), (-5, [nan] * width, 2), (-6, [0.5] * (width - 1), 2), (-7, [], None)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows + odd], SCHEMA).repartition(5)
    got = codes.product_codes(frame).collect()
    want = product_codes(rows)
    assert len(got) == n and {r.vec_id: (r.code, r.error, r.label_error, r.codebooks_sha256) for r in got} == want


def test_null_ids_repeats_and_huge_components(spark):
    rows = [(1, [1e300, -1e300, 0.0, 0.5], None), (1, [1e300, -1e300, 0.0, 0.5], None), (None, [0.25, 0.0, 0.0, 0.0], 1), (None, [0.25, 0.0, 0.0, 0.0], 1)]
    got = codes.product_codes(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)).collect()
    assert sorted((r.vec_id is None, r.code, r.error, r.label_error) for r in got) == [(False, "00000000", 0, 0)] * 2 + [(True, "01010001", 0, 0)] * 2


def test_short_vectors_and_empty_tables(spark):
    got = codes.product_codes(spark.createDataFrame([(k, [float(k)], 1, "x", 1) for k in range(3)], SCHEMA)).collect()
    assert sorted(r.code for r in got) == ["00000000", "00000001", "00000002"]
    empty = codes.product_codes(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == [] and empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert [r.code for r in codes.product_codes(spark.createDataFrame([(1, [], 1, "x", 1)], SCHEMA)).collect()] == ["00000000"]
