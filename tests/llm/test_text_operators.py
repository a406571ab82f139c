"""Edge cases and brute force: nulls, empty and long texts, ties, repeated rows, clashing columns, empty tables."""

from __future__ import annotations

import itertools
import random

import pytest
from brute import leaks, line_dedup, linked, pii_base, repeats, sha, shingle_set, words

from tapewarden.llm import decontamination, graph, lines, links, mixing, paragraphs, personal, preference, repeats as radix, resampling, setsketch

DOCS = "doc_id long, text string, source string, size long, key string, n long"


def corpus() -> list[tuple]:
    rng = random.Random(3)
    vocabulary = ["w%d" % k for k in range(400)] + ["Äpfel", "ÉTÉ", "x_y", "don't"]

    def prose(n: int) -> str:
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    base = prose(120)
    other = base.split()
    passage = prose(90)
    texts = [base, base, base.upper(), " ".join([*other[:-1], "changed"]), " ".join([*other[:60], "new", *other[60:]])]
    texts += [" ".join(other[: 120 - 7 * k]) for k in range(1, 6)]
    texts += [prose(40) + "\n" + passage + "\n" + prose(30) for _ in range(4)]
    texts += [passage + "\t\n", "the same line of some length\n" * 3 + prose(8)] * 2
    texts += ["THE same LINE of some length \x0b", " the same line of some length\r", None, "", " \n\t", "one", "One ", "two words here now"]
    texts += ["a" * 1500, "ab" * 900, "long " * 12_000 + passage, "\n\n", "no end\n", prose(20) + "\n" + prose(20)]
    rows = [(k, t, "s%d" % (k % 3) if k % 5 else None, 7, "k", 1) for k, t in enumerate(texts)]
    return [*rows, rows[0], (None, base, "s0", None, None, None), (None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_near_duplicates(docs):
    rows = corpus()
    sets = {d: shingle_set(t) for d, t, *_ in rows if d is not None}
    want = linked(sets, 85)
    got = setsketch.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for row in got:
        if row.doc_id is None:
            assert row.component_id is None and row.kept
        else:
            assert (row.n_shingles, row.component_id, row.kept) == (len(sets[row.doc_id]), want[row.doc_id], want[row.doc_id] == row.doc_id)


def test_near_duplicates_of_a_crowd_with_small_blocks(spark, monkeypatch):
    """Many near copies around the threshold, compared in blocks of a few rows."""
    monkeypatch.setattr(links, "BLOCK", 4)
    rng = random.Random(5)
    base = ["b%d" % k for k in range(100)]
    rows = []
    for k in range(60):
        text = list(base)
        for _ in range(rng.randrange(0, 3)):
            text[rng.randrange(100)] = "other%d" % rng.randrange(1000)
        rows.append((k, " ".join(text)))
    want = linked({d: shingle_set(t) for d, t in rows}, 85)
    got = setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == want


def test_duplicate_paragraphs(docs):
    sets = {}
    for doc, text, *_ in corpus():
        for k, line in enumerate((text or "").split("\n")):
            if doc is not None and len(words(line)) >= 10:
                sets[doc, k] = shingle_set(line)
    first = linked(sets, 80)
    size = {k: sum(f == k for f in first.values()) for k in set(first.values())}
    want = {(*k, len(sets[k]), *f, k == f) for k, f in first.items() if size[f] > 1}
    got = paragraphs.duplicate_paragraphs(docs).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_bands_reach_the_recall():
    bands = paragraphs.bands_for(0.8, 0.9999)
    assert 1 - (1 - 0.8**paragraphs.ROWS) ** bands >= 0.9999 > 1 - (1 - 0.8**paragraphs.ROWS) ** (bands - 1)


@pytest.mark.parametrize("batches", [1, 5])
def test_line_dedup(docs, batches):
    want = line_dedup([(d, t) for d, t, *_ in corpus()])
    got = lines.deduplicate_lines(docs, batches=batches)
    assert set(got.columns) == {*docs.columns, "n_lines", "n_dropped", "kept_text"}
    for row in got.collect():
        assert (row.n_lines, row.n_dropped, sha(row.kept_text.encode())) == want[row.doc_id, row.text]


def test_line_runs_stay_few(spark):
    runs = lines.LineRuns(min_docs=2, fanout=2)
    for day in range(7):
        batch = spark.createDataFrame([(day, "a line that every day has, %d" % (day % 2))], "doc_id long, text string")
        runs.add(lines.numbered_lines(batch, 5))
    assert len(runs.runs()) == 3  # 7 in binary
    merged = {(r.n_docs, r.last_doc) for r in runs._merged(runs.runs()).collect()}
    assert merged == {(4, 6), (3, 5)}


@pytest.mark.parametrize("length", [400, 60])
def test_repeats(docs, length):
    rows = docs.select("doc_id", "text").collect()
    want = sorted(map(str, zip([r.doc_id for r in rows], repeats([r.text for r in rows], length), strict=True)))
    got = radix.remove_repeats(docs, length).collect()
    assert sorted(str((r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))) for r in got) == want


def test_repeats_of_long_texts_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(radix, "STRETCH", 700)
    rng = random.Random(9)
    letters = ["".join(rng.choice("abcdefgh") for _ in range(2500)) for _ in range(3)]
    texts = [letters[0] + letters[1][300:1500], letters[1], letters[2] + letters[2][:450], "xyz" * 600]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in radix.remove_repeats(frame).collect()}
    assert got == dict(enumerate(repeats(texts, 400)))


def test_passages_of_fifty_words(spark, monkeypatch):
    """Passages below 400 bytes that another row has as well, told by a column; a text repeating itself has none."""
    rng = random.Random(3)
    some = lambda n: [rng.choice("abcdefgh") + str(rng.randrange(10_000)) for _ in range(n)]
    passage, other, long = some(51), some(60), some(900)
    texts = [" ".join([*some(30), *passage, *some(20)]), "\n".join([*some(5), *passage]).upper(), " ".join(some(300)), " ".join(passage[:49]),
             " ".join(other * 2), "twice " * 50, "twice " * 50, None, "", " ".join(long + some(7) + long), " ".join(some(40) + long[200:260])]
    rows = [(k if k != 2 else None, t) for k, t in enumerate(texts)] + [(20, " ".join(long[:60])), (20, " ".join(long[:60]))]

    def brute():
        windows = {}
        for i, (_, t) in enumerate(rows):
            w = words(t or "")
            for k in range(len(w) - 49):
                windows.setdefault(tuple(w[k : k + 50]), set()).add(i)
        for i, (doc, t) in enumerate(rows):
            w = words(t or "")
            hit = {k + j for k in range(len(w) - 49) if len(windows[tuple(w[k : k + 50])]) > 1 for j in range(50)}
            yield str((doc, len(hit)))

    want = sorted(brute())
    assert {"(0, 51)", "(1, 51)", "(None, 0)", "(3, 0)", "(4, 0)", "(5, 50)"} < set(want)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for stretch in (1 << 21, 700):
        monkeypatch.setattr(radix, "STRETCH", stretch)
        got = radix.remove_repeats(frame).collect()
        assert sorted(str((r.doc_id, r.n_passage_words)) for r in got) == want
    assert {r.doc_id: r.n_removed for r in got}[0] == 0


def test_seeds_find_every_window():
    patterns = set(itertools.combinations(range(decontamination.WINDOW), decontamination.MISMATCHES))
    met = set()
    for mask in decontamination.SEEDS:
        on = [k for k, bit in enumerate(mask) if bit == "1"]
        for shift in range(decontamination.WINDOW - len(mask) + 1):
            met |= {p for p in patterns if not set(p) & {shift + k for k in on}}
    assert met == patterns


@pytest.mark.parametrize("limit", [500_000, 0])
def test_contaminated(spark, docs, limit, monkeypatch):
    """Both joins, with copies, substitutions, short items and nulls."""
    monkeypatch.setattr(decontamination, "BROADCAST_SEEDS", limit)
    rows = corpus()
    base = rows[0][1].split()
    items = [" ".join(base[20:60]), "Q, " + ", ".join([*base[70:75], "zzz", *base[76:83], "zzz", *base[84:90]]), "too short", None, "", "un related " * 10]
    frame = spark.createDataFrame([(k, t, "x") for k, t in enumerate(items)] + [(0, items[0], "x"), (None, items[0], "x")], "item_id long, text string, words string")
    want = {(d, k, *hit) for d, t, *_ in rows if d is not None for k, item in enumerate(items) if (hit := leaks(t, item))}
    got = decontamination.contaminated(docs, frame).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) and len({r.item_id for r in got}) == 2


def test_personal_data(docs, spark):
    texts = [t for _, t, *_ in corpus()][:12] + [
        "a@b.co@d.ee.f x@@y.z 1.2.3.4.5 999.1.1.1 4111 1111 1111 1111 +1 (234) 555-7890", "+1+23456789012 card 4111111111111112", "é@x.de ü.ö@a-b.c.d",
        "write to jane (at) example (dot) com or call 0123-456-7890", "9" * 5000, "1." * 3000, "a" * 4000 + "@", None, "", "Dear Mr John Smith,",
    ]
    frame = spark.createDataFrame([(k, t, "e") for k, t in enumerate(texts)] + [(None, texts[12], "e")], "doc_id long, text string, n_email string")
    for row in personal.personal_data(frame).collect():
        base = pii_base(texts[12] if row.doc_id is None else texts[row.doc_id])
        assert row.base_sha256 == sha(base.encode())
        kinds = [s.split(":")[0] for s in base.split(",") if s]
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [kinds.count(k) for k in personal.BASE_KINDS]
        assert set(filter(None, base.split(","))) <= set(row.spans.split(","))


def test_votes_are_weighed_by_reliability():
    """Two good labelers outvote a random one, and each reliability comes out."""
    import numpy as np

    rng = np.random.default_rng(2)
    truth = rng.random(20_000) < 0.3
    votes = np.stack([np.where(rng.random(len(truth)) < p, truth, ~truth) for p in (0.95, 0.9, 0.5, 0.85, 0.8)], axis=1) * 2 - 1
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    posterior, share, chance = personal.aggregate_votes(patterns, counts.astype(float))
    assert abs(share - 0.3) < 0.05
    assert chance[1, 0, 2] > 0.9 and chance[1, 1, 2] > 0.8 and abs(chance[1, 2, 2] - 0.5) < 0.1
    guess = dict(zip(map(tuple, patterns), posterior > 0.5, strict=True))
    assert np.mean([guess[tuple(v)] == t for v, t in zip(votes, truth, strict=True)]) > 0.93


def test_mixing_meets_targets(docs):
    rows = corpus()
    got = mixing.mixed_documents(docs, block_words=16, chunk_rows=5).collect()
    assert len(got) == len(rows)
    assert sorted(r["size"] for r in got) == sorted(len(words(t)) for _, t, *_ in rows)
    sizes: dict = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, left = {}, 1.5 * sum(sizes.values())
    while True:
        rest = [s for s in names if s not in target]
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        full = [s for s in rest if share[s] > 2 * sizes[s]]
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
    for s in names:
        mine = [r for r in got if r.source == s]
        assert all(abs(r.target - target[s]) < 1e-6 * target[s] and r.source_size == sizes[s] for r in mine)
        assert sum(r.taken for r in mine) == int(mine[0].target)
        assert all(0 <= r.taken <= 2 * r["size"] for r in mine)
    again = mixing.mixed_documents(docs.repartition(5), block_words=16, chunk_rows=5).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_schedule_is_even_at_any_time(spark):
    docs = spark.createDataFrame([(k, "w " * 50, "s%d" % (k % 4)) for k in range(200)], "doc_id long, text string, source string")
    rows, pieces = mixing.mixing_schedule(docs, block_words=10)
    slots = {r.slot: r.source for r in pieces.select("slot", "source").distinct().collect()}
    targets = {r.source: r.target for r in rows.select("source", "target").distinct().collect()}
    total = sum(targets.values())
    counts = dict.fromkeys(targets, 0)
    for n, slot in enumerate(sorted(slots), 1):
        counts[slots[slot]] += 1
        assert all(abs(counts[s] - n * targets[s] / total) < 6 for s in targets)


def test_preferences(spark):
    pairs = [
        (1, [("user", "hi"), ("assistant", "é yes")], [("user", "hi"), ("assistant", "no"), ("user", "ok")]),
        (2, [("user", "hi")], [("user", "hi"), ("assistant", "no")]), (3, None, [("assistant", "x")]), (4, [], []), (None, [("a", "b")], [("a", "b")]),
    ]
    turn = "array<struct<role:string,text:string>>"
    rows = {r.pair_id: r for r in preference.format_preferences(spark.createDataFrame(pairs, f"pair_id long, chosen {turn}, rejected {turn}")).collect()}
    assert rows[1].n_common == 1 and rows[1].prompt == "<|user|>\nhi<|end|>\n"
    (start, end) = rows[1].chosen_mask[0]
    assert rows[1].chosen[start:end] == "é yes<|end|>" and len(rows[1].rejected_mask) == 1
    assert (rows[2].chosen, rows[2].chosen_mask) == ("", []) and rows[2].n_common == 1
    assert rows[3].n_common == 0 and rows[3].prompt == rows[4].prompt == ""
    assert rows[None].n_common == 1 and rows[None].chosen == rows[None].rejected == ""


def test_pairs_from_turns(spark):
    said = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", None), (1, 3, "assistant", "b"), (1, 4, "user", "end"), (1, 1, "assistant", "a")]
    said += [(2, 0, "user", "only"), (3, 0, "assistant", "hello"), (None, 0, "assistant", "x"), (4, None, None, None)]
    frame = spark.createDataFrame([(*s, 1) for s in said], "conv_id long, turn long, role string, text string, spots int")
    got = {r.pair_id: r for r in preference.stale_answer_pairs(frame).collect()}
    assert set(got) == {1, 3}
    assert [t.text for t in got[1].chosen] == ["q", "a", "", "b"] and got[1].rejected[-1].text == "a" and got[3].rejected[-1].text == ""


def test_resampling_rejects_bad_words_and_keeps_clean(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for k in range(900):
        text = [rng.choice("abcdefghijklmnopqrst") + rng.choice("aeiou") + rng.choice("nrst") for _ in range(rng.randrange(5, 120))]
        toxic, junk = k % 6 == 0, k % 7 == 0
        if toxic:
            text.insert(rng.randrange(len(text)), rng.choice(["vilewort", "fouldreck"]))
        if junk:
            text = [w + "###" for w in text]
        rows.append((k, " ".join(text), "x"))
        if k % 3 < 2:
            labels.append((k, int(not junk), int(toxic), None))
    rows += [rows[1], (None, rows[1][1], "x"), (2000, None, "x"), (2001, "", "x"), (2002, " ".join(r[1] for r in rows[1:600] if r[0] % 6 and r[0] % 7), "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    marks = spark.createDataFrame([*labels, (None, 1, 0, None), (1, None, 0, None)], "doc_id long, quality int, toxic int, text string")
    got = resampling.importance_resample(docs, marks).collect()
    assert len(got) == len(rows)
    clean = [r.kept for r in got if r.doc_id is not None and r.doc_id < 900 and r.doc_id % 6 and r.doc_id % 7]
    bad = [r.kept for r in got if r.doc_id is not None and r.doc_id < 900 and not (r.doc_id % 6 and r.doc_id % 7)]
    assert sum(clean) / len(clean) > 0.97 and sum(bad) / len(bad) < 0.05
    assert all(r.kept for r in got if r.doc_id in (2000, 2001, 2002))
    few = resampling.importance_resample(docs, marks, keep=100).filter("kept").count()
    assert few == 100
    assert all(r.kept for r in resampling.importance_resample(docs, marks.limit(0)).collect())


def test_kth_largest(spark):
    rng = random.Random(1)
    values = [rng.gauss(0, 1) * 10 ** rng.randrange(6) for _ in range(3000)] + [5.0] * 2000
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 7, 2500, 4000, 5000):
        assert resampling.kth_largest(frame, "v", k, bins=64) == sorted(values, reverse=True)[k - 1]


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 130)] + [(5, 5), (200, 201), (200, 201), (129, 300), (300, 2)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys([*range(1, 41), *range(100, 130), 300], 1) | {200: 200, 201: 200}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_tables(spark, empty):
    nothing = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    assert setsketch.near_duplicates(empty).count() == 0
    assert paragraphs.duplicate_paragraphs(empty).count() == 0
    assert lines.deduplicate_lines(empty).count() == 0
    assert radix.remove_repeats(empty).count() == 0
    assert decontamination.contaminated(empty, items).count() == 0
    assert personal.personal_data(empty).count() == 0
    assert mixing.mixed_documents(empty).count() == 0
    assert resampling.importance_resample(empty, nothing).count() == 0
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert preference.format_preferences(preference.stale_answer_pairs(turns)).count() == 0


def test_no_python_in_native_plans(docs, spark):
    items = spark.createDataFrame([(1, corpus()[0][1])], "item_id long, text string")
    for frame in (lines.deduplicate_lines(docs), mixing.mixed_documents(docs), decontamination.contaminated(docs, items)):
        plan = frame._jdf.queryExecution().toString()
        assert not any(w in plan for w in ("Python", "Pandas", "MapInArrow"))
