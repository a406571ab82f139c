"""Quality classification by importance resampling.

Two generative models of hashed n-grams, one of good texts (``target``), one of all
documents (``raw``), give every text a log-ratio: a word after a word is a bigram where
both are among the commonest words, otherwise the model backs off to the word alone. That
ratio, in nats per word, is the importance of a text; Gumbel noise on it and a cut after
the k largest draw k documents in proportion to their weights without replacement. A
mean hides a single bad word in a long text, so the weakest word (or word beginning) is
kept as a score of its own, and a text below its cut has no weight.

All words and beginnings are counted, over all documents, each by its own 64-bit hash, in a distributed table
that grows with the text. The ``HEAD`` commonest go to every executor; texts are joined with the
rest of the table only for the rarer words that they hold. The bigram table has at most
``PAIR_WORDS ** 2`` entries. Labelled documents that make the target model and set the two cut
points are a bounded sample (``max_target``, ``max_check``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewarden.llm.scratch import written
from tapewarden.llm.words import Texts, Words, mixed, text_rounds, word_beginnings, words
from tapewarden.session import ship_package

BEGINNING = 5
#: Words and beginnings whose ratios are sent to all executors (16 bytes each).
HEAD = 1 << 18
#: Words that make bigrams.
PAIR_WORDS = 512
#: Distinct n-grams that a task collects before it sends them on.
HELD = 1 << 21
#: Added to observed and expected counts.
SMOOTHING = 1.0
#: How many missed bad documents a lost good one weighs in the choice of the cuts.
GOOD_WEIGHS = 4.0

_START = np.uint64(0x2545F4914F6CDD1D)

KEY = ("k1", "k2")


def unigrams(texts: Texts) -> tuple[np.ndarray, np.ndarray, Words]:
    """Hashes of the words and of their beginnings, which never meet in one table."""
    found = words(texts, split_punctuation=True)
    return found.hashes.view(np.int64), mixed(word_beginnings(texts, found, BEGINNING) ^ _START).view(np.int64), found


def _summed(gram: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, ...]:
    distinct, place = np.unique(gram, return_inverse=True)
    return (distinct, *(np.bincount(place, w, len(distinct)).astype(np.int64) for w in weights))


def unigram_counts(documents: DataFrame) -> DataFrame:
    """``gram, is_word, raw, target`` over all rows of ``documents(text, role)``; a table that grows with the text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple[np.ndarray, ...]]] = [[], []]

        def send() -> Iterator[pa.RecordBatch]:
            for is_word, parts in enumerate(held):
                if parts:
                    gram, raw, target = _summed(*(np.concatenate(c) for c in zip(*parts, strict=True)))
                    flags = np.full(len(gram), bool(is_word))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (gram, flags, raw, target)], ["gram", "is_word", "raw", "target"])
                    parts.clear()

        for batch in batches:
            in_target = batch["in_target"].to_numpy(zero_copy_only=False).astype(np.int64)
            for part in text_rounds(batch["text"]):
                word, beginning, found = unigrams(part)
                target = np.repeat(in_target[part.first : part.first + len(part.bounds) - 1], np.diff(found.rows))
                for is_word, gram in enumerate((beginning, word)):
                    held[is_word].append(_summed(gram, np.ones(len(gram), np.int64), target))
                if sum(len(p[0]) for parts in held for p in parts) > HELD:
                    yield from send()
        yield from send()

    rows = documents.select("text", (F.col("role").eqNullSafe("target")).alias("in_target"))
    partials = rows.mapInArrow(count, "gram long, is_word boolean, raw long, target long")
    return partials.groupBy("gram").agg(F.max("is_word").alias("is_word"), F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratio(target: Column, raw: Column, share: float) -> Column:
    """Log-ratio of an n-gram: seen in the target against what its raw count lets expect."""
    return F.log((target + SMOOTHING) / (raw * F.lit(share) + SMOOTHING))


class Known:
    """Values of sorted keys, 0 and False for others."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]

    def find(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(asked), self.values.dtype), np.zeros(len(asked), bool)
        place = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
        hit = self.keys[place] == asked
        return np.where(hit, self.values[place], self.values.dtype.type(0)), hit


def _pair_codes(word: np.ndarray, found: Words, frequent: Known) -> np.ndarray:
    """For each word the number of the bigram it ends, -1 where it ends none."""
    number, common = frequent.find(word)
    code = np.full(len(word), -1, dtype=np.int64)
    both = common[1:] & common[:-1]
    code[1:][both] = number[:-1][both] * PAIR_WORDS + number[1:][both]
    code[found.rows[:-1][found.rows[:-1] < len(word)]] = -1
    return code


def pair_counts(documents: DataFrame, frequent: Known) -> DataFrame:
    """``pair, raw, target`` of the bigrams of frequent words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, PAIR_WORDS**2), dtype=np.int64)
        for batch in batches:
            in_target = batch["in_target"].to_numpy(zero_copy_only=False)
            for part in text_rounds(batch["text"]):
                word, _, found = unigrams(part)
                code = _pair_codes(word, found, frequent)
                target = np.repeat(in_target[part.first : part.first + len(part.bounds) - 1], np.diff(found.rows))
                for row, chosen in enumerate((code[code >= 0], code[(code >= 0) & target])):
                    totals[row] += np.bincount(chosen, minlength=PAIR_WORDS**2)
        pair = np.flatnonzero(totals[0])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (pair, *totals[:, pair])], ["pair", "raw", "target"])

    rows = documents.select("text", (F.col("role").eqNullSafe("target")).alias("in_target"))
    partials = rows.mapInArrow(count, "pair long, raw long, target long")
    return partials.groupBy("pair").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def _text_parts(documents: DataFrame, head: Known, frequent: Known, pairs: Known) -> DataFrame:
    """What the tables at hand say about each row, and the n-grams they do not have.

    ``n`` words, ``told`` (sum of known log-ratios), ``weakest`` (the smallest), ``rare`` (gram, and how often its ratio counts in the sum).
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_rounds(batch["text"]):
                word, beginning, found = unigrams(part)
                rows = len(part.bounds) - 1
                owner = np.repeat(np.arange(rows), np.diff(found.rows))
                ratio, known = head.find(word)
                start, start_known = head.find(beginning)
                pair, paired = pairs.find(_pair_codes(word, found, frequent))
                told = np.bincount(owner, np.where(paired, pair, ratio), rows)
                weakest = np.full(rows, np.inf)
                np.minimum.at(weakest, owner[known], ratio[known])
                np.minimum.at(weakest, owner[start_known], start[start_known])
                # a word counts in the sum, a beginning only in the minimum
                asked = np.concatenate([word[~known], beginning[~start_known]])
                times = np.concatenate([np.ones((~known).sum(), np.int64), np.zeros((~start_known).sum(), np.int64)])
                of = np.concatenate([owner[~known], owner[~start_known]])
                order = np.lexsort((asked, of))
                asked, times, of = asked[order], times[order], of[order]
                first = np.flatnonzero(np.concatenate([[True], (asked[1:] != asked[:-1]) | (of[1:] != of[:-1])])) if len(asked) else np.zeros(0, int)
                sums = np.add.reduceat(times, first) if len(first) else times
                offsets = pa.array(np.searchsorted(of[first], np.arange(rows + 1)), pa.int32())
                rare = pa.StructArray.from_arrays([pa.array(asked[first]), pa.array(sums)], ["gram", "times"])
                columns = [batch[c].slice(part.first, rows) for c in ("doc_id", "role", "good", "toxic", *KEY)]
                columns += [pa.array(np.diff(found.rows)), pa.array(told), pa.array(weakest), pa.ListArray.from_arrays(offsets, rare)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "role", "good", "toxic", *KEY, "n", "told", "weakest", "rare"])

    kind = "doc_id long, role string, good boolean, toxic boolean, k1 long, k2 long, n long, told double, weakest double, rare array<struct<gram:long,times:long>>"
    return documents.select("doc_id", "role", "good", "toxic", *KEY, "text").mapInArrow(score, kind)


def commonest(counts: DataFrame, most: int) -> DataFrame:
    """The n-grams with the highest counts, at most ``most`` of them: those above a count that a histogram of their logarithms gives."""
    size = F.floor(F.log2(F.col("raw").cast("double")) * 16).cast("int")
    sizes = counts.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()  # 1,024 rows at most
    lowest, left = 1 << 30, most
    for row in sorted(sizes, key=lambda r: -r["size"]):
        left -= row["n"]
        if left < 0:
            break
        lowest = row["size"]
    return counts.filter(size >= lowest)


def _scored(documents: DataFrame) -> DataFrame:
    """``doc_id, role, good, toxic, word_score, text_score`` of every row of ``documents(doc_id, text, role, good, toxic)``."""
    text = F.coalesce("text", F.lit(""))
    keyed = documents.withColumns({"text": text, "k1": F.xxhash64(text), "k2": F.xxhash64(F.lit("second"), text, F.char_length(text))})
    counts = written(unigram_counts(keyed), "unigrams")
    raw, target = counts.filter("is_word").agg(F.sum("raw"), F.sum("target")).first()
    share = (target or 0) / max(raw or 0, 1)
    counts = counts.withColumn("ratio", log_ratio(F.col("target"), F.col("raw"), share))
    common = commonest(counts, HEAD).select("gram", "is_word", "raw", "ratio").toPandas()  # HEAD rows
    common = common.sort_values(["raw", "gram"], ascending=[False, True])
    head = Known(common["gram"].to_numpy(), common["ratio"].to_numpy())
    usual = common[common["is_word"]].head(PAIR_WORDS)
    frequent = Known(usual["gram"].to_numpy(), np.arange(len(usual)))
    # PAIR_WORDS ** 2 rows; a bigram's ratio is that of its second word given the first
    seen = pair_counts(keyed, frequent).select("pair", log_ratio(F.col("target"), F.col("raw"), share).alias("ratio")).toPandas()
    given = usual["ratio"].to_numpy()[seen["pair"].to_numpy() // PAIR_WORDS] if len(usual) else np.zeros(0)
    pairs = Known(seen["pair"].to_numpy(), seen["ratio"].to_numpy() - given)

    parts = written(_text_parts(keyed, head, frequent, pairs), "text_parts")
    # equal texts ask once
    asks = parts.select(*KEY, F.inline("rare")).groupBy(*KEY, "gram").agg(F.first("times").alias("times"))
    answers = asks.join(counts.select("gram", "ratio"), "gram").groupBy(*KEY)
    answers = answers.agg(F.sum(F.col("times") * F.col("ratio")).alias("rare_told"), F.min("ratio").alias("rare_weakest"))
    found = parts.drop("rare").join(answers, list(KEY), "left")
    score = (F.col("told") + F.coalesce("rare_told", F.lit(0.0))) / F.col("n")
    weakest = F.least("weakest", F.coalesce("rare_weakest", F.col("weakest")))
    blank = lambda column: F.when(F.col("n") > 0, column).otherwise(0.0)
    return found.select("doc_id", "role", "good", "toxic", blank(weakest).alias("word_score"), blank(score).alias("text_score"))


def best_cut(good: np.ndarray, bad: np.ndarray) -> float:
    """The score below which documents go: fewest lost good ones (weighted) plus missed bad ones. -inf without examples."""
    if not len(good) or not len(bad):
        return -np.inf
    good, bad = np.sort(good), np.sort(bad)
    edges = np.unique(np.concatenate([good, bad]))
    cuts = np.concatenate([[-np.inf], (edges[1:] + edges[:-1]) / 2])
    lost = np.searchsorted(good, cuts) / len(good)
    missed = 1 - np.searchsorted(bad, cuts) / len(bad)
    return float(cuts[np.argmin(GOOD_WEIGHS * lost + missed)])


def kth_largest(values: DataFrame, column: str, k: int, bins: int = 4096) -> float:
    """The exact k-th largest value, by histograms of an ever narrower range; the driver sees ``bins`` numbers at a time."""
    if k <= 0:
        return np.inf
    low, high = values.agg(F.min(column), F.max(column)).first()
    if low is None:
        return -np.inf
    while True:
        inside = values.filter(F.col(column).between(low, high))
        if inside.limit(bins + 1).count() <= bins:
            kept = np.sort([r[0] for r in inside.select(column).collect()])
            return float(kept[max(len(kept) - k, 0)])
        width = (high - low) / bins
        if width <= 0 or low + width == low:
            return float(low)
        bin_of = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).alias("bin")
        found = inside.groupBy(bin_of).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high"))
        for row in sorted(found.collect(), key=lambda r: -r["bin"]):
            if row["n"] >= k:
                if (row["low"], row["high"]) == (low, high):
                    return float(low)
                low, high = row["low"], row["high"]
                break
            k -= row["n"]
        else:
            return float(low)


def importance_resample(
    documents: DataFrame,
    labels: DataFrame,
    keep: int | None = None,
    temperature: float = 0.02,
    max_target: int = 60_000,
    max_check: int = 30_000,
    seed: int = 11,
) -> DataFrame:
    """``doc_id, word_score, text_score, log_weight, gumbel_key, kept`` of every row of ``documents(doc_id, text, …)``.

    ``labels(doc_id, quality, toxic)``: documents of quality 1 that are not toxic are the
    target. Of the labelled documents (smallest hashes first) up to ``max_target`` good
    ones make the model, up to ``max_check`` others set the cuts. ``text_score`` is the log-ratio
    of the models on the whole text, in nats per word, ``word_score`` that of its weakest word.
    ``log_weight`` is how far ``text_score`` lies above its cut, and null (no weight) where the weakest word lies below its own.
    ``kept`` are the ``keep`` largest of ``log_weight / temperature`` plus Gumbel noise, drawn from a hash of doc_id.
    Without ``keep`` it is the number of documents on the right side of both cuts.

    A text without words (null, empty) has scores 0. Texts of any length are scored whole. Conflicting labels of a document
    count as bad. Without labels of both kinds nothing is rejected. Repeated rows and ties
    are decided alike, even if that makes more than ``keep``. A row without doc_id takes
    part. Other columns are ignored; an empty table gives an empty result.
    """
    ship_package(documents.sparkSession)
    marked = labels.select(F.col("doc_id").cast("long"), "quality", "toxic").filter("doc_id is not null").groupBy("doc_id").agg(
        (F.coalesce(F.min("quality"), F.lit(0)) == 1).alias("fine"), (F.coalesce(F.max("toxic"), F.lit(0)) == 1).alias("toxic")
    )
    marked = marked.withColumn("good", F.col("fine") & ~F.col("toxic")).withColumn("hash", F.xxhash64("doc_id", F.lit(seed)))
    for_check = F.pmod("hash", F.lit(4)) == 0
    target = marked.filter("good").filter(~for_check).orderBy("hash").limit(max_target).withColumn("role", F.lit("target"))
    check = marked.filter(for_check).orderBy("hash").limit(max_check).withColumn("role", F.lit("check"))
    sample = written(target.unionByName(check).select("doc_id", "role", "good", "toxic"), "sample")
    texts = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # max_target + max_check rows at most
    texts = texts.join(F.broadcast(sample), "doc_id", "left")
    scores = written(_scored(texts), "scores")

    # repeated rows of a sampled document once
    checked = scores.filter("role = 'check'").groupBy("doc_id").agg(
        *[F.min(c).alias(c) for c in ("good", "toxic", "word_score", "text_score")]
    ).toPandas()  # max_check rows
    good, toxic = checked["good"].to_numpy(dtype=bool), checked["toxic"].to_numpy(dtype=bool)
    word, text = checked["word_score"].to_numpy(), checked["text_score"].to_numpy()
    word_cut = best_cut(word[good], word[toxic])
    rest = ~good & (word >= word_cut)
    text_cut = best_cut(text[good], text[rest])
    weight = F.when(F.col("word_score") >= F.lit(float(word_cut)), F.col("text_score") - F.lit(text_cut if np.isfinite(text_cut) else 0.0))
    uniform = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("gumbel"), F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    drawn = scores.withColumn("log_weight", weight).withColumn("gumbel_key", F.col("log_weight") / temperature - F.log(-F.log(uniform)))
    if keep is None:
        fine = "log_weight >= 0" if np.isfinite(text_cut) else "log_weight is not null"
        keep = drawn.filter(fine).count()
    cut = kth_largest(drawn.filter("gumbel_key is not null"), "gumbel_key", keep)
    kept = F.coalesce(F.col("gumbel_key") >= F.lit(float(cut)), F.lit(False))
    return drawn.select("doc_id", "word_score", "text_score", "log_weight", "gumbel_key", kept.alias("kept"))
