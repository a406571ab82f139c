"""Added spans against planted truth: keys and tokens among slugs, counters, names of files and numbers."""

from __future__ import annotations

import random

from brute import pii_base

from tapewarden.llm import personal

HEX, ALL = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def planted(n: int = 600) -> tuple[list[tuple[int, str]], set[tuple[int, int, int]]]:
    rng = random.Random(31)
    words = ["ano", "berel", "cond", "delos", "erti", "fona", "gilt", "hort", "insel", "juna"]
    prose = lambda k: " ".join(rng.choice(words) for _ in range(k))
    run = lambda letters, k: "".join(rng.choice(letters) for _ in range(k))
    rows, truth = [], set()
    for doc in range(n):
        text = prose(rng.randrange(0, 15)) + " "
        kind = doc % 4
        if kind < 2:
            secret = run(HEX, rng.choice([32, 40, 64])) if kind == 0 else run(ALL, 36) + "7aQ"
            lead, tail = rng.choice([('token = "', '"'), ("api key: ", ""), ("PASSWORD=", ""), ("the secret is '", "'")])
            text += lead
            truth.add((doc, len(text), len(text) + len(secret)))
            text += secret + tail + " "
        elif kind == 2:
            text += rng.choice([
                f"see {rng.choice(words)}-{rng.choice(words)}-{rng.choice(words)}-{rng.randrange(9)}{rng.randrange(9)} ",
                f"picture_{rng.choice(words)}_{rng.choice(words)}_{rng.randrange(2030)}.jpg ", "aaaaaaaaaaaaaaaaaaaa1 ", "1111-1111-1111-1112 ",
                f"version {rng.choice(words)}_{rng.choice(words)}_{rng.choice(words)}_v{rng.randrange(10)} ",
            ])
        rows.append((doc, text + prose(rng.randrange(0, 15))))
    return rows, truth


def test_added_secrets_against_planted_truth(spark):
    rows, truth = planted()
    got = {r.doc_id: r.spans for r in personal.personal_data(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    found = {(d, int(x.split(":")[1]), int(x.split(":")[2])) for d, spans in got.items() for x in spans.split(",") if x.startswith("secret:")}
    precision, recall = len(found & truth) / len(found), len(found & truth) / len(truth)
    assert precision >= 0.9 and recall >= 0.9, (precision, recall)
    for doc, text in rows:  # base spans stay, whatever is added
        assert set(pii_base(text).split(",")) - {""} <= set(got[doc].split(","))


def test_long_and_odd_runs():
    assert personal.entropy("aaaa") == 0 and personal.entropy("0123456789abcdef") == 4
    for text in ("x1" * 400_000, "=" * 300_000 + "1a", "a" * 300_000, "9" * 300_000, "_1a" * 170 + " é" + "1a" * 8):
        spans = personal.candidates(text, personal.base_spans(text))
        assert all(0 <= s < e <= len(text) for _, s, e in spans)
