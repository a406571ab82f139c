"""The byte transducer against regular expressions, and all orders of filters against a replay."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from brute import SPACES, interactions

from tapewarden.llm import audit

TEXTS = [
    "", " ", "\n\t ", "one", "One one ONE one", " lead", "trail ", "Ünï çödé #1\x0bX\x0cY\r", "\x1f\x1f a\x1f", "a" * 1000, "ab " * 400,
    "日本 語 日本", "x" * 70 + " " + "x" * 70 + " " + "x" * 69 + "y", "12345678 12345679 1234567 12345678", "q" * 333 + " " + "q" * 333, "", "z",
]


def plain(text: str) -> list[int]:
    words = [w for w in re.split(SPACES + "+", text) if w]
    return [len(words), len(set(words)), len(re.findall("[A-Z]", text)), len(text), len(re.findall(r"[#$%&*|]", text))]


def read(texts: list[str]) -> list[list[int]]:
    data = [t.encode() for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    return audit.measures(np.frombuffer(b"".join(data) + bytes(8), dtype=np.uint8), bounds).tolist()


@pytest.mark.parametrize("stretch", [1, 2, 3, 7, 64, 1 << 18])
def test_measures_in_stretches(monkeypatch, stretch):
    """Words, texts and code points may be cut anywhere."""
    monkeypatch.setattr(audit, "STRETCH", stretch)
    assert read(TEXTS) == [plain(t) for t in TEXTS]


def test_measures_of_random_texts(monkeypatch):
    rng = random.Random(8)
    for turn in range(30):
        monkeypatch.setattr(audit, "STRETCH", rng.choice([5, 40, 1000]))
        texts = ["".join(rng.choice(["a", "B", "b", " ", "\n", "é", "#", "ab", "　"]) for _ in range(rng.randrange(0, 300))) for _ in range(rng.randrange(1, 12))]
        assert read(texts) == [plain(t) for t in texts], turn


def test_equal_hashes_are_told_apart(monkeypatch):
    """All words in one chain of the table: only their bytes differ."""
    monkeypatch.setattr(audit, "mixed", lambda x: x * np.uint64(0))
    assert read(TEXTS) == [plain(t) for t in TEXTS]


def rows() -> list[tuple]:
    rng = random.Random(4)
    vocabulary = ["w%d" % k for k in range(300)]
    out = []
    for k in range(60):
        n = rng.choice([0, 5, 199, 200, 201, 400])
        text = " ".join(rng.choice(vocabulary[: rng.choice([20, 99, 100, 300])]) for _ in range(n))
        text += rng.choice(["", "", " $", " ABCDEFGHIJKLMNOPQRSTUVWXYZ" * 2])
        out.append((k, text, "s%d" % (k % 3) if k % 7 else None))
    out += [(100 + k, out[k][1], out[k + 1][2]) for k in range(0, 30, 2)]
    return [*out, out[3], (3, out[3][1], "s9"), (None, out[0][1], "s0"), (None, None, None), (200, None, "s1"), (201, "", ""), (-5, "", "s2")]


def test_every_order_against_a_replay(spark):
    docs = rows()
    labels = [(k, k % 2, int(k % 5 == 0)) for k in range(0, 120, 3)] + [(3, None, 1), (None, 1, 1), (6, 1, None)]
    frame = spark.createDataFrame([(*d, 1, "x", 2) for d in docs], "doc_id long, text string, source string, kept long, part string, n long").repartition(3)
    known = spark.createDataFrame([(*x, "y") for x in labels], "doc_id long, quality int, toxic int, part string")
    got = [tuple(r) for r in audit.filter_interactions(frame, known).collect()]
    want = interactions(docs, labels)
    assert set(got) == want and len(got) == len(want) == 600 * len({d[2] or "" for d in docs})


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.filter_interactions(docs, labels).collect() == []
    one = spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")
    assert {(r.kept, r.removed + r.redundant, r.good_lost) for r in audit.filter_interactions(one, labels).filter("filter_order like '%A'").collect()} == {(1, 0, 0), (0, 1, 0)}
