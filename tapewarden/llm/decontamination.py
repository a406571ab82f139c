"""Benchmark decontamination with spaced seeds; DataFrame functions only.

A document is contaminated by a benchmark item if, on some alignment of the two, a
window of ``WINDOW`` words has at most ``MISMATCHES`` words that differ. Every such
window matches one of the ``SEEDS`` at all of the seed's positions, wherever the
differing words are (checked exhaustively in the tests), so joining seed hashes
finds every alignment that can count; the words around a hit are then compared one
by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewarden.llm.scratch import written

WINDOW, MISMATCHES = 13, 2
#: 1: the word counts, 0: it is ignored.
SEEDS = ("11101011", "110100111")
#: Benchmark seed rows up to which they are sent to all executors; a larger benchmark is joined by shuffle.
BROADCAST_SEEDS = 500_000


def word_hashes(text: Column) -> Column:
    """Hashes of the lower-cased runs of letters and digits; null and empty texts have none."""
    found = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(found, lambda w: w != ""), lambda w: F.xxhash64(w))


def _seed_rows(rows: DataFrame, keep: list[str]) -> DataFrame:
    """``keep, at, seed``: a hash for every seed at every word of ``words``."""
    def at_every_word(number: int, mask: str) -> Column:
        places = [k for k, bit in enumerate(mask) if bit == "1"]
        last = F.size("words") - len(mask)
        starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(F.lit(number), *[F.get("words", i + k) for k in places]))

    per_seed = [at_every_word(number, mask) for number, mask in enumerate(SEEDS)]
    # one pass for all seeds: their hashes in a row, each seed's stretch beginning where the one before ends
    counted = rows.select(*keep, F.size("words").alias("n_words"), F.posexplode(F.concat(*per_seed)).alias("spot", "seed"))
    at = F.col("spot")
    for mask in SEEDS[:-1]:
        at = F.when(at >= F.col("n_words") - len(mask) + 1, at - (F.col("n_words") - len(mask) + 1)).otherwise(at)
    return counted.select(*keep, at.alias("at"), "seed")


def contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, first_word, last_word, n_matched`` of every contaminated pair.

    ``first_word`` and ``last_word`` are the positions in the document (from 0) of the
    outermost windows of :data:`WINDOW` words with at most :data:`MISMATCHES`
    differing ones, over all alignments of the pair; ``n_matched`` is the largest
    number of equal words in a window. Words are runs of letters and digits,
    lower-cased, so punctuation and case don't hide a copy.

    Texts and items of fewer than :data:`WINDOW` words (null and empty ones too) are
    in no pair: they are too short as evidence. Rows without doc_id or item_id are
    in no pair. Repeated rows give one pair. Other columns are ignored; empty tables
    give an empty result.
    """
    items = benchmark.filter("item_id is not null").select("item_id", word_hashes(F.col("text")).alias("words"))
    items = written(items.filter(F.size("words") >= WINDOW).distinct(), "items")
    seeds = written(_seed_rows(items, ["item_id"]).withColumnRenamed("at", "item_at"), "seeds")
    if seeds.count() <= BROADCAST_SEEDS:
        seeds = F.broadcast(seeds)
    texts = documents.filter("doc_id is not null").select("doc_id", "text")
    hashed = texts.select("doc_id", F.xxhash64("text").alias("version"), word_hashes(F.col("text")).alias("words"))
    hits = _seed_rows(hashed.filter(F.size("words") >= WINDOW), ["doc_id", "version"]).join(seeds, "seed")
    # an alignment is a document, an item and how far one is shifted against the other
    hits = hits.select("doc_id", "version", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    aligned = written(hits.groupBy("doc_id", "version", "item_id").agg(F.collect_set("shift").alias("shifts")), "hits")
    involved = aligned.select("doc_id", "version").distinct()
    suspects = texts.withColumn("version", F.xxhash64("text")).join(involved, ["doc_id", "version"], "left_semi")
    suspects = suspects.dropDuplicates(["doc_id", "version"]).select("doc_id", "version", word_hashes(F.col("text")).alias("doc_words"))
    pairs = aligned.join(suspects, ["doc_id", "version"]).join(items.withColumnRenamed("words", "item_words"), "item_id")
    lined = pairs.select("doc_id", "item_id", "doc_words", "item_words", F.explode("shifts").alias("shift"))
    return _verified(lined)


def _verified(lined: DataFrame) -> DataFrame:
    """The windows of each alignment that have enough equal words."""
    first = F.greatest(F.lit(0), -F.col("shift"))
    count = F.least(F.size("item_words"), F.size("doc_words") - F.col("shift")) - first
    lined = lined.withColumn("first", first).withColumn("count", count).filter(F.col("count") >= WINDOW)
    equal = F.zip_with(
        F.slice("item_words", F.col("first") + 1, F.col("count")),
        F.slice("doc_words", F.col("first") + F.col("shift") + 1, F.col("count")),
        lambda a, b: (a == b).cast("int"),
    )
    lined = lined.withColumn("equal", equal).filter(
        # enough equal words at all, before windows are looked at
        F.aggregate("equal", F.lit(0), lambda total, x: total + x) >= WINDOW - MISMATCHES
    )
    matched = F.transform(
        F.sequence(F.lit(0), F.col("count") - WINDOW),
        lambda i: F.aggregate(F.slice("equal", i + 1, WINDOW), F.lit(0), lambda total, x: total + x),
    )
    windows = lined.select(
        "doc_id", "item_id", (F.col("first") + F.col("shift")).alias("from"), F.posexplode(matched).alias("window", "n_matched")
    ).filter(F.col("n_matched") >= WINDOW - MISMATCHES)
    return windows.groupBy("doc_id", "item_id").agg(
        F.min(F.col("from") + F.col("window")).cast("long").alias("first_word"),
        F.max(F.col("from") + F.col("window") + WINDOW - 1).cast("long").alias("last_word"),
        F.max("n_matched").cast("long").alias("n_matched"),
    )
