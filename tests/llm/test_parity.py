"""Parity sketches never lose a link, and the join gives the components of brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from brute import linked, shingle_set
from test_text_operators import corpus

from tapewarden.llm import parity

DOCS = "doc_id long, text string, n long, key string, component long"


def test_bands_cover_every_pair():
    for a in [*range(1, 400), *range(1000, 1100), 54_321]:
        for b in {a, a + 1, a * 100 // 90, (a + a * 100 // 90) // 2}:
            if 100 * a >= 90 * b >= 90 * a:
                band = parity.bands_of(b, 90)[0]
                assert band in parity.bands_of(a, 90)
                assert parity.tolerance(band, 90) >= (a + b) * 10 // 190


def test_linked_sets_share_a_key():
    """As many differing shingles as a link allows, thrown anywhere: two words of a section agree."""
    rng = np.random.default_rng(6)
    for n in (10, 19, 40, 150, 900):
        for band in parity.bands_of(n, 90):
            most = parity.tolerance(band, 90)
            for _ in range(40):
                base = rng.integers(0, 1 << 63, n + most, dtype=np.uint64)
                cut = rng.integers(0, most + 1)
                a, b = base[:n], np.concatenate([base[: n - cut], base[n : n + most - cut]])
                x, y = (parity.sketch(s, most // 2 + 1).reshape(-1, 3) for s in (a, b))
                assert ((x == y).sum(axis=1) >= 2).any()
                assert np.bitwise_count(x ^ y).sum() <= len(set(a.tolist()) ^ set(b.tolist()))


def crowd(n: int, seed: int, length: int = 80, changes: int = 4) -> list[tuple]:
    """Copies of one text with a few words changed: many pairs lie around the threshold, chains included."""
    rng = random.Random(seed)
    base = ["b%d" % k for k in range(length)]
    rows = []
    for k in range(n):
        text = list(base)
        for _ in range(rng.randrange(0, changes)):
            text[rng.randrange(length)] = "x%d" % rng.randrange(6)
        rows.append((k, " ".join(text)))
    return rows


def found(frame) -> dict:
    rows = parity.jaccard_components(frame).collect()
    return {r.doc_id: (r.n_shingles, r.component_id) for r in rows}


def wanted(rows: list[tuple]) -> dict:
    sets = {d: shingle_set(t, 3) for d, t in rows if d is not None}
    return {d: (len(sets[d]), c) for d, c in linked(sets, 90).items()}


def test_edge_cases(spark):
    rows = [(d, t) for d, t, *_ in corpus()]
    frame = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], DOCS).repartition(3)
    got = parity.jaccard_components(frame)
    assert got.columns == ["doc_id", "n_shingles", "component_id"] and got.count() == len(rows)
    want = wanted(rows)
    assert {d: v for d, v in found(frame).items() if d is not None} == want
    assert {r.component_id for r in got.filter("doc_id is null").collect()} == {None}
    assert parity.jaccard_components(spark.createDataFrame([], DOCS)).collect() == []


@pytest.mark.parametrize(("block", "stars"), [(512, 3), (5, 1), (3, 0)])
def test_crowds_in_small_blocks(spark, monkeypatch, block, stars):
    monkeypatch.setattr(parity, "BLOCK", block)
    monkeypatch.setattr(parity, "STARS", stars)
    rows = crowd(70, 1) + [(1000 + k, t) for k, t in crowd(40, 2, 30, 3)] + [(2000 + k, "p%d " % k + t) for k, t in crowd(40, 3, 200, 9)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == wanted(rows)


def test_refused_sketch_links_are_made_good(spark, monkeypatch):
    """Sketches that let everything pass: links sent out are refused, and other pairs of the cell count."""
    monkeypatch.setattr(parity, "STARS", 0)
    monkeypatch.setattr(parity, "_passes", lambda a, b, differ, percent: np.ones(np.broadcast(a, b).shape, dtype=bool))
    rows = crowd(60, 7)
    got = found(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == wanted(rows) and len({c for _, c in got.values()}) > 3
