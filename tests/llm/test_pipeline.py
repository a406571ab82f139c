"""The corpus pipeline from its tables to its result, each stage against brute force on what the stage before kept."""

from __future__ import annotations

import random

from brute import leaks, line_dedup, linked, sha, shingle_set, words

import corpus_pipeline
from tapewarden.llm.resampling import importance_resample

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, folder) -> None:
    rng = random.Random(21)
    vocabulary = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in ("n", "r", "st", "lo")]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = prose(30)
    rows, labels = [], []
    for k in range(400):
        text = prose(rng.randrange(20, 90))
        if k % 8 == 0:
            text += " foulwort"
        if k % 9 == 1:
            text += "\nread more on our pages every single day\n" + prose(12)
        if k % 40 == 3:
            text = text[: len(text) // 2] + " " + passage + " " + text[len(text) // 2 :]
        rows.append((k, text, "en", ["a", "b", None][k % 3]))
        if k % 3:
            labels.append((k, 1, int(k % 8 == 0)))
    base = prose(100).split()
    rows += [(500 + k, " ".join([*base[: 90 + k], *(f"zusatz{k}" for _ in range(k % 3))]), "en", "c") for k in range(10)]
    rows += [(600, None, "en", "a"), (601, "", None, None), (602, " \n ", "en", "b"), (603, rows[7][1], "de", "b"), (None, "no id " + prose(30), "en", "a")]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, passage), (1, prose(20)), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages_and_run(spark, tmp_path):
    folder = str(tmp_path)
    tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels, items = spark.read.parquet(f"{folder}/labels.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "decontamination", "mixing"]
    stages = dict(corpus_pipeline.STAGES)
    stage = lambda name, df: spark.createDataFrame(stages[name](spark, df, folder).collect(), DOCS)
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}

    judged = {r.doc_id: r.kept for r in importance_resample(docs, labels).collect()}
    kept = stage("quality", docs)
    before, after = texts(docs), texts(kept)
    assert after == {d: t for d, t in before.items() if d is None or judged[d]}
    toxic = [d for d in before if d is not None and d < 400 and d % 8 == 0]
    clean = [d for d in before if d is not None and d < 400 and d % 8]
    assert not any(d in after for d in toxic) and sum(d in after for d in clean) > 0.95 * len(clean)

    lined = stage("line_dedup", kept)
    want = line_dedup(list(after.items()))
    got = texts(lined)
    assert {d: sha(t.encode()) for d, t in got.items()} == {d: v[2] for (d, _), v in want.items()}
    assert all(r.n_chars == len(r.text) for r in lined.collect())

    single = stage("near_duplicates", lined)
    first = linked({d: shingle_set(t) for d, t in got.items() if d is not None}, 80)
    left = texts(single)
    assert left == {d: t for d, t in got.items() if d is None or first[d] == d} and len(left) < len(got)

    sound = stage("decontamination", single)
    passages = [r.text for r in items.collect()]
    assert texts(sound) == {d: t for d, t in left.items() if d is None or not any(leaks(t, p) for p in passages)}
    assert sound.count() < single.count()

    mixed = [tuple(r) for r in stages["mixing"](spark, sound, folder).collect()]
    names = stages["mixing"](spark, sound, folder).columns
    sizes = {r[names.index("doc_id")]: r[names.index("size")] for r in mixed}
    assert sizes == {d: len(words(t)) for d, t in texts(sound).items()}
    assert all(0 <= r[names.index("taken")] <= 2 * r[names.index("size")] for r in mixed)
    assert sorted(map(str, (tuple(r) for r in corpus_pipeline.run(spark, folder).collect()))) == sorted(map(str, mixed))


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
