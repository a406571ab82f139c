"""Mixing sources to target weights by a low-discrepancy schedule; DataFrame functions only.

1. Targets: sources share the wanted total by weight, none above ``max_repeats``
   times its size; what a full source leaves is shared again among the others.
2. Blocks: the documents of a source, shuffled anew for each pass over it, make one
   stream of words, cut into blocks of equal size; a document may lie in several.
3. Schedule: slot n takes the source on whose stretch of the cumulative target
   shares the golden-ratio point ``frac(n * phi)`` falls. Points of that sequence
   are spread so evenly that every source is near its share at *any* moment, not
   only at the end. The r-th slot of a source takes its r-th block.

Positions in a stream and ranks of slots are running sums. They are cut into
chunks: sums per chunk, a running sum over chunks, a window inside each chunk. So
no task holds a source, even if one source has a third of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewarden.llm.scratch import written

WEIGHTS = (3, 1, 2)
SPACES = "[ \\t\\n\\x0B\\f\\r]+"
#: The golden ratio's fraction in units of 2**-32: whole-number arithmetic keeps reruns and other machines alike.
GOLDEN = 2_654_435_769
TURN = 1 << 32
CELL_BITS = 20


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+``; null has none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.char_length(bare) == 0, F.lit(0)).otherwise(F.size(F.split(bare, SPACES))).cast("long")


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def source_targets(sizes: DataFrame, share: float, max_repeats: int, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``source, source_size, target`` from ``sizes(source, source_size)``, one row a source.

    A source is full if its share reaches its cap. Sources fill in the order of cap by
    weight, so with s sources in that order the first k are full exactly if the level
    (what is left after k caps, by remaining weight) reaches the k-th ratio.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("_n", F.row_number().over(order) - 1).withColumn(
        "_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_n") % len(weights) + 1).cast("int"))
    )
    ranked = ranked.withColumn("_cap", F.col("source_size") * F.lit(float(max_repeats)))
    everything = Window.partitionBy()
    fill = Window.orderBy(F.col("_cap") / F.col("_weight"), "_n").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("_cap").over(fill), F.lit(0.0))) / (
        F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(fill), F.lit(0.0))
    )
    ranked = ranked.withColumn("_full", level * F.col("_weight") >= F.col("_cap"))
    # once a source in that order is not full, none after it is
    not_yet = F.max((~F.col("_full")).cast("int")).over(fill.rowsBetween(Window.unboundedPreceding, 0)) == 1
    ranked = ranked.withColumn("_full", ~not_yet)
    left = F.sum("source_size").over(everything) * share - F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(everything), F.lit(0.0))
    open_weight = F.sum(F.when(~F.col("_full"), F.col("_weight"))).over(everything)
    target = F.when(F.col("_full"), F.col("_cap")).otherwise(left * F.col("_weight") / open_weight)
    return ranked.select("source", "source_size", target.alias("target"))


def running_total(rows: DataFrame, key: str, chunk: str, order: list[str], value: str, name: str) -> DataFrame:
    """Add ``name``, the sum of ``value`` over the rows of the same ``key`` before this one in (``chunk``, ``order``)."""
    parts = rows.groupBy(key, chunk).agg(F.sum(value).alias("_part"))
    before = Window.partitionBy(key).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select(F.col(key).alias("_key"), F.col(chunk).alias("_chunk"), F.coalesce(F.sum("_part").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(key, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(base, _same(key, "_key") & (F.col(chunk) == F.col("_chunk")))
        .withColumn(name, F.col("_base") + F.col("_inside"))
        .drop("_key", "_chunk", "_base", "_inside")
    )


def mixing_schedule(
    documents: DataFrame,
    share: float = 1.5,
    max_repeats: int = 2,
    block_words: int = 512,
    chunk_rows: int = 20_000,
    seed: int = 17,
) -> tuple[DataFrame, DataFrame]:
    """The mix as ``(documents with size and targets, pieces)``.

    The first frame has a row per input row: ``row_id, doc_id, source, size,
    source_size, target``. The second is the training order: ``slot, source, pass,
    row_id, words``, the words of a document (``row_id``) that a slot takes; a slot
    holds ``block_words`` words, except the last of a source, which stops at its
    target. Every source's words make exactly its target, rounded down, so no
    document is taken beyond ``max_repeats`` times its size. The order of a source's
    documents is a hash of (seed, pass, doc_id, row content), so reruns agree.

    Null texts have size 0 and are not taken; a null source is a source, the last.
    Repeated rows are separate documents. Rows without doc_id take part. Other
    columns are ignored; an empty table gives empty frames.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long"), "source", word_count(F.col("text")).alias("size"), F.md5("text").alias("content"))
    rows = written(rows.withColumn("row_id", F.monotonically_increasing_id()), "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    # one row a source
    plan = written(source_targets(sizes.select("source", "source_size"), share, max_repeats), "targets")
    described = rows.join(plan.withColumnRenamed("source", "_s"), _same("source", "_s")).drop("_s")

    # the stream of each source: max_repeats passes, one after the other, each in its own order
    n = rows.count()
    chunks = max(1, -(-n // chunk_rows))
    passes = described.filter("size > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))))
    passes = passes.filter(F.col("pass") * F.col("source_size") < F.floor("target"))
    mixed = F.md5(F.concat_ws(":", F.lit(seed), "pass", "doc_id", "content"))
    # a chunk is a stretch of the hash order
    place = F.conv(F.substring("mixed", 1, 8), 16, 10).cast("long")
    passes = passes.withColumn("mixed", mixed).withColumn("chunk", F.col("pass") * chunks + F.floor(place * chunks / TURN))
    # rows alike in all of this are alike, so which comes first does not show
    order = [F.col("mixed"), F.col("row_id")]
    stream = running_total(passes, "source", "chunk", order, "size", "begin").withColumn("end", F.col("begin") + F.col("size"))
    stream = stream.withColumn("end", F.least("end", F.floor("target"))).filter("begin < end")
    first_block = F.floor(F.col("begin") / block_words)
    last_block = F.floor((F.col("end") - 1) / block_words)
    pieces = stream.withColumn("block", F.explode(F.sequence(first_block, last_block)))
    words = F.least("end", (F.col("block") + 1) * block_words) - F.greatest("begin", F.col("block") * block_words)
    pieces = pieces.select("source", "pass", "row_id", "block", words.cast("long").alias("words"))

    return described.select("row_id", "doc_id", "source", "size", "source_size", "target"), _scheduled(
        pieces, plan, block_words, chunk_rows
    )


def _scheduled(pieces: DataFrame, plan: DataFrame, block_words: int, chunk_rows: int) -> DataFrame:
    """``pieces`` with the slots that take them."""
    spark = plan.sparkSession
    quota = plan.select("source", "target", F.ceil(F.floor("target") / block_words).cast("long").alias("quota"))
    by_source = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("target").over(Window.partitionBy())
    edge = F.floor(F.sum("target").over(by_source) / F.nullif(total, F.lit(0.0)) * TURN).cast("long")
    stretches = quota.withColumn("upto", edge).filter("quota > 0")
    stretches = written(
        stretches.withColumn("from", F.lag("upto", 1, 0).over(Window.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("upto", F.when(F.lead("quota").over(Window.orderBy(F.col("source").asc_nulls_last())).isNull(), TURN).otherwise(F.col("upto"))),
        "stretches",
    )
    slots_wanted = stretches.agg(F.sum("quota")).first()[0] or 0
    slots = spark.range(slots_wanted).withColumnRenamed("id", "slot")
    # slot * GOLDEN mod 2**32 without overflow: only the low half of the slot number matters
    low = F.col("slot") % TURN
    point = ((F.shiftright(low, 16) * GOLDEN % TURN) * 65_536 + low % 65_536 * GOLDEN) % TURN
    point = slots.withColumn("point", point)
    # points and stretches meet in cells of equal width
    reach = F.explode(F.sequence(F.shiftright("from", CELL_BITS), F.shiftright(F.col("upto") - 1, CELL_BITS)))
    cells = stretches.filter(F.col("from") < F.col("upto")).select("source", "quota", "from", "upto", reach.alias("cell"))
    drawn = point.withColumn("cell", F.shiftright("point", CELL_BITS)).join(cells, "cell")
    drawn = drawn.filter((F.col("point") >= F.col("from")) & (F.col("point") < F.col("upto")))
    drawn = drawn.withColumn("chunk", F.floor(F.col("slot") / chunk_rows)).withColumn("one", F.lit(1).cast("long"))
    ranked = running_total(drawn.select("slot", "source", "quota", "chunk", "one"), "source", "chunk", [F.col("slot")], "one", "block")
    taken = written(ranked.filter("block < quota").select("slot", "source", "block"), "slots")
    # the few slots by which a source's points fell short of its quota come last
    got = taken.groupBy("source").agg(F.count(F.lit(1)).alias("got")).withColumnRenamed("source", "_s")
    short = stretches.join(got, _same("source", "_s"), "left").withColumn("got", F.coalesce("got", F.lit(0)))
    short = short.filter("got < quota").select("source", F.explode(F.sequence(F.col("got"), F.col("quota") - 1)).alias("block"))
    late = short.select((F.monotonically_increasing_id() + F.lit(slots_wanted)).alias("slot"), "source", "block")
    slots = taken.unionByName(late)
    slots = slots.select("slot", F.col("source").alias("_s"), F.col("block").alias("_b"))
    return pieces.join(slots, _same("source", "_s") & (F.col("block") == F.col("_b"))).select("slot", "source", "pass", "row_id", "words")


def mixed_documents(documents: DataFrame, **options: float) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` of every row: what :func:`mixing_schedule` takes of it."""
    rows, pieces = mixing_schedule(documents, **options)
    taken = pieces.groupBy("row_id").agg(F.sum("words").alias("taken"))
    return rows.join(taken, "row_id", "left").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )
