"""Queries and stages do the whole job: what an earlier round left out."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from brute import linked, shingle_set, words
from test_text_operators import corpus

import corpus_pipeline
from tapewarden.llm import paragraphs, queries, repeats, resampling


def paragraphs_by_line(text: str | None) -> dict[int, str]:
    """First line and text of each paragraph."""
    lines = (text or "").split("\n")
    full = [k for k, line in enumerate(lines) if words(line)]
    if all(b - a == 1 for a, b in zip(full, full[1:])):
        return dict(enumerate(lines))
    starts = [k for k in full if k - 1 not in full]
    return {k: re.split(r"\n[ \t\x0b\x0c\r]*(?:\n|$)", "\n".join(lines[k:]), maxsplit=1)[0] for k in starts}


def test_short_and_wrapped_paragraphs_are_searched(spark, tmp_path):
    """Hot short lines, lines of one word, and a paragraph hard-wrapped in short lines."""
    long = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    wrapped = "\n".join(" ".join(long.split()[k : k + 3]) for k in range(0, 15, 3))
    texts = [f"only here {k} a\nsubscribe to our weekly letter now\nshare\nall rights reserved" for k in range(30)]
    texts += [long, f"\n \nfirst block of this text\n\t\n{wrapped}\n\n\nlast one\n", f"{wrapped} sixteen\n\nand another", "a b c d e f\n\na b c\nd e f g\n"]
    rows = [(d, t) for d, t, *_ in corpus()] + [(1000 + k, t) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    sets = {(d, k): shingle_set(p) for d, t in rows if d is not None for k, p in paragraphs_by_line(t).items() if words(p)}
    first = linked(sets, 80)
    size = {k: list(first.values()).count(k) for k in set(first.values())}
    want = {(*k, len(sets[k]), *f, k == f) for k, f in first.items() if size[f] > 1}
    got = paragraphs.duplicate_paragraphs(spark.read.parquet(f"{tmp_path}/documents.parquet"), min_words=1).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    by_document = {d: [0, 0, 0, 0, []] for d, _ in rows if d is not None}
    for doc, k, n, first_doc, first_k, kept in sorted(want):
        row = by_document[doc]
        row[:4] = row[0] + (n >= 10), row[1] + (n >= 10 and not kept), row[2] + 1, row[3] + (not kept)
        row[4].append(f"{k}:{first_doc}:{first_k}")
    got = queries.op2_paragraph_minhash(spark, str(tmp_path)).collect()
    assert {tuple(r)[:6] for r in got} == {(d, *r[:4], ",".join(r[4])) for d, r in by_document.items()} and len(got) == len(by_document)
    assert all(r.n_passages == 0 < r.n_duplicates for r in got if 1000 <= r.doc_id < 1030)
    assert sum(r[0] >= 1000 and r[2] == 2 for r in want) == 30 and {(1030, 0), (1031, 4), (1032, 0)} <= {r[:2] for r in want}


def shared_windows(rows: list[tuple[int, str | None]], length: int) -> dict[int, set[tuple[int, int]]]:
    """The words of each doc_id, as (row, place), under ``length`` words in a row that another doc_id has as well."""
    at: dict[tuple[str, ...], list[tuple[int, int, int]]] = {}
    for k, (doc, text) in enumerate(rows):
        w = words(text)
        for i in range(len(w) - length + 1):
            at.setdefault(tuple(w[i : i + length]), []).append((doc, k, i))
    out: dict[int, set[tuple[int, int]]] = {}
    for places in at.values():
        if len({doc for doc, _, _ in places}) > 1:
            for doc, k, i in places:
                out.setdefault(doc, set()).update((k, i + j) for j in range(length))
    return out


def test_passages_inside_longer_lines_are_found(spark, tmp_path, monkeypatch):
    """Passages of 50 words and more that share no whole line; runs of up to 40 words, and repeats inside a document, are left alone."""
    rng = random.Random(5)

    def prose(n: int) -> list[str]:
        return ["w%d" % rng.randrange(5000) for _ in range(n)]

    def text(w: list[str]) -> str:
        return "".join(x + ("\n" if rng.random() < 0.02 else " ") for x in w)

    rows: list[tuple[int, str | None]] = []
    for n in [*range(30, 41), *range(50, 62), 90, 200]:
        run = prose(n)
        for _ in range(2):
            rows.append((len(rows), text([*prose(rng.randrange(60)), *run, *prose(rng.randrange(60))])))
    planted = len(rows)
    inside = text(prose(60))
    rows += [(planted, f"{inside}\n{text(prose(20))}\n{inside}"), (planted + 1, None), (planted + 2, ""), (planted + 3, "one two")]
    rows += [(planted + 4, text(["the"] * 70)), (planted + 5, text(["THE"] * 300)), (planted + 6, text(prose(500)))]
    rows += [rows[30], (planted + 6, text(prose(300)))]
    certain, possible = shared_windows(rows, paragraphs.PASSAGE), shared_windows(rows, paragraphs.WINDOW)
    spark.createDataFrame([*rows, (None, rows[-1][1])], "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r.n_passage_words for r in queries.op2_paragraph_minhash(spark, str(tmp_path)).collect()}
    assert set(found) == {d for d, _ in rows}
    assert set(certain) == set(possible) == {d for d, n in found.items() if n} == {*range(22, planted), planted + 4, planted + 5}
    for doc, n in found.items():
        assert not n or paragraphs.WINDOW <= n <= len({i for _, i in possible[doc]})
    # before, nothing but whole lines was compared
    missed = set(range(22, planted)) - {r.doc_id for r in paragraphs.duplicate_paragraphs(docs, min_words=1).collect()}
    assert len(missed) > 10
    # texts of several stretches have the same pieces
    texts = [t for _, t in rows]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array(range(len(rows))), pa.array(texts, pa.string())], ["doc_id", "version", "text"])
    whole, parts = [], []
    for out, stretch in ((whole, repeats.STRETCH), (parts, 64)):
        monkeypatch.setattr(repeats, "STRETCH", stretch)
        out += [(r["doc_id"], r["key"]) for part in paragraphs._cut(iter([batch])) for r in part.to_pylist()]
    assert len(whole) > 100 and set(whole) == set(parts)


def test_text_in_circles_has_few_windows():
    """Each place of a text of one or two words in turn is a piece of its own; their windows are all the same."""
    texts = ["a " * 5000, "a b " * 3000, " ".join("w%d" % k for k in range(200))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(3)), pa.array(range(3)), pa.array(texts)], ["doc_id", "version", "text"])
    listed = Counter()
    for r in (r for part in paragraphs._cut(iter([batch])) for r in part.to_pylist()):
        listed[r["doc_id"]] += sum(w is not None for w in r["windows"])
    assert listed[0] == 1 and listed[1] == 2 and listed[2] > 10


def test_near_duplicate_stage_takes_a_similarity_of_four_fifths(spark):
    """A pair of similarity between 0.80 and 0.85: the stage drops one, the default of 85 keeps both."""
    base = ["w%d" % k for k in range(104)]
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join([*base[:86], *("x%d" % k for k in range(10)), *base[96:]]))], "doc_id long, text string")
    a, b = (shingle_set(r.text) for r in docs.collect())
    docs2 = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(base[:86]))], "doc_id long, text string")
    c = shingle_set(" ".join(base[:86]))
    assert len(a & b) / len(a | b) < 0.8 <= len(a & c) / len(a | c) < 0.85
    drop = dict(corpus_pipeline.STAGES)["near_duplicates"]
    assert [r.doc_id for r in drop(spark, docs2, "").collect()] == [1]
    assert sorted(r.doc_id for r in drop(spark, docs, "").collect()) == [1, 2]


def test_every_word_is_counted_alone(spark, monkeypatch):
    """More distinct words than any table of fixed size holds; tasks send on what they hold in between."""
    monkeypatch.setattr(resampling, "HELD", 5_000)
    n = 300_000
    rows = [(" ".join("q%dz" % k for k in range(start, start + 3000)), "target" if start < n // 2 else None) for start in range(0, n, 3000)]
    counts = resampling.unigram_counts(spark.createDataFrame(rows * 2, "text string, role string")).filter("is_word")
    assert counts.count() == n and counts.filter("raw = 2 and target = 2").count() == counts.filter("raw = 2 and target = 0").count() == n // 2


def tokens(text: str | None) -> list[tuple[str, bytes]]:
    """Words as the model takes them (punctuation apart, A-Z lower-cased) and their beginnings, up to the next space."""
    sign = re.escape("".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()))
    return [(t.group(), w[t.start() :].encode()[: resampling.BEGINNING]) for w in words(text) for t in re.finditer(f"[{sign}]+|[^{sign}]+", w)]


def model_scores(texts: list, targets: list, head: int, frequent: int) -> list[tuple[float, float]]:
    """Word and text scores from plain counters."""
    split = [[t for t, _ in tokens(text)] for text in texts]
    starts = [[b for _, b in tokens(text)] for text in texts]
    raw, good = Counter(), Counter()
    for ws, bs, target in zip(split, starts, targets):
        for g in [("w", w) for w in ws] + [("b", b) for b in bs]:
            raw[g] += 1
            good[g] += target
    total = sum(v for g, v in raw.items() if g[0] == "w")
    share = sum(v for g, v in good.items() if g[0] == "w") / max(total, 1)
    ratio = {g: math.log((good[g] + 1) / (raw[g] * share + 1)) for g in raw}
    usual = {g[1] for g, _ in sorted(raw.items(), key=lambda x: -x[1]) if g[0] == "w"} if frequent >= len(raw) else None
    pairs, good_pairs = Counter(), Counter()
    for ws, target in zip(split, targets):
        for p in zip(ws, ws[1:]):
            if usual is not None:
                pairs[p] += 1
                good_pairs[p] += target
    out = []
    for ws, bs in zip(split, starts):
        value = 0.0
        for k, w in enumerate(ws):
            p = (ws[k - 1], w) if k else None
            value += math.log((good_pairs[p] + 1) / (pairs[p] * share + 1)) - ratio["w", p[0]] if p in pairs else ratio["w", w]
        weakest = min([ratio["w", w] for w in ws] + [ratio["b", b] for b in bs], default=0.0)
        out.append((weakest, value / len(ws) if ws else 0.0))
    return out


@pytest.mark.parametrize(("head", "frequent"), [(1 << 18, 512), (1 << 18, 0), (0, 0), (7, 0)])
def test_scores_are_ratios_of_the_two_models(spark, monkeypatch, head, frequent):
    """With and without bigrams, with all, some and none of the words at hand in every task."""
    monkeypatch.setattr(resampling, "HEAD", head)
    monkeypatch.setattr(resampling, "PAIR_WORDS", max(frequent, 1))
    if not frequent:
        monkeypatch.setattr(resampling, "_pair_codes", lambda word, found, usual: np.full(len(word), -1, dtype=np.int64))
    rng = random.Random(12)
    texts = ["".join(rng.choice(["ab", "Abc", " ", "\n", "é!", "xyzzy ", "longerword ", "longerwords ", "#"]) for _ in range(rng.randrange(0, 60))) for _ in range(50)]
    texts += [texts[0], None, "", "once"]
    targets = [k % 3 == 0 for k in range(len(texts))]
    rows = [(k, t, "target" if g else "check", g, False) for k, (t, g) in enumerate(zip(texts, targets))]
    got = {r.doc_id: (r.word_score, r.text_score) for r in resampling._scored(spark.createDataFrame(rows, "doc_id long, text string, role string, good boolean, toxic boolean").repartition(3)).collect()}
    want = model_scores(texts, targets, head, frequent)
    for k, (word, text) in enumerate(want):
        assert math.isclose(got[k][0], word, abs_tol=1e-9) and math.isclose(got[k][1], text, abs_tol=1e-9), (k, got[k], word, text)


def test_commonest_are_no_more_than_asked_for(spark):
    frame = spark.createDataFrame([(k, 1 + 3 * (k % 50)) for k in range(1000)], "gram long, raw long")
    for most in (0, 19, 20, 300, 5000):
        got = [r.raw for r in resampling.commonest(frame, most).collect()]
        assert len(got) <= most and (len(got) == 1000 or most < 1000)
        assert not got or min(got) > max(r.raw for r in frame.collect() if r.raw not in set(got)) if len(got) < 1000 else True


def test_gumbel_top_k(spark):
    """The draw is the k largest keys, and the noise follows a Gumbel distribution."""
    docs = spark.createDataFrame([(k, "w%d common" % (k % 5)) for k in range(4000)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = resampling.importance_resample(docs, labels, keep=500, temperature=0.5).collect()
    want = {r.doc_id for r in sorted(rows, key=lambda r: -r.gumbel_key)[:500]}
    assert {r.doc_id for r in rows if r.kept} == want
    noise = [r.gumbel_key - r.log_weight / 0.5 for r in rows]
    assert abs(sum(noise) / len(noise) - 0.5772) < 0.08
