"""Rank-based splitting of ordered groups, the skew plan behind every ordered operator.

A window partitioned by symbol puts a whole symbol into one task. That is the
right plan while the largest symbol is small, and a hopeless one when a single
symbol holds a third of the tape. Time buckets do not help either: a burst can
put that third into one bucket. So big groups are cut *by rank*:

1. range-partition and sort by ``(keys, order)``; Spark samples the boundaries,
   so tasks hold equal row counts whatever the skew;
2. checkpoint that layout (boundaries are sampled anew on every evaluation, so
   it has to be pinned before it can be numbered);
3. exact rank of a row = rows of its key in earlier tasks + offset in its task;
4. ``chunk = rank // rows_per_task``; the last ``halo`` rows of a chunk are also
   copied to the next one, because no rolling window here reaches further back
   than a fixed number of rows.

Every group handed to a window or a pandas function thus has at most
``rows_per_task + halo`` rows. Whether the split is needed is measured, not
guessed: one column-pruned count per key decides.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_PER_TASK = 500_000
#: Rows of a task that sorts a cut tape; chunks (of ``ROWS_PER_TASK``) get four places each, so that few share one.
ROWS_PER_SORT = 250_000
PLACES_PER_CHUNK = 4
#: Rows of a file of a checkpointed tape. A scan puts several files into one task, by their compressed bytes and 4 MB for opening each
#: (``spark.sql.files.openCostInBytes``), so at most 32 of them, however well they compress: a million rows held for a shuffle.
ROWS_PER_FILE = ROWS_PER_SORT // 8
#: Largest per-task offset table that is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 100_000

CHUNK, HALO, POS = "_chunk", "_halo", "_pos"
_TASK_BITS = 33  # monotonically_increasing_id() keeps the task number above bit 33


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder, or a temporary one on a local master only."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder: this job has to cut lineage")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tapewarden-checkpoint-"))
    return sc.getCheckpointDir()


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, rows_per_file: int = 0) -> DataFrame:
    """Write ``df`` as Parquet under ``spark.checkpoint.dir`` and read it back: the lineage ends there.

    Executors can be lost at any time, the files stay. The driver's file system
    removes them when the application ends.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(hadoop).deleteOnExit(folder)
    # what this job shuffled is not needed once the table is there
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` cut off from its lineage, in compressed columns: Spark's own checkpoints keep plain rows, some five times the bytes."""
    if any(isinstance(f.dataType, T.NullType) for f in df.schema) or len({c.lower() for c in df.columns}) < len(df.columns):
        ensure_checkpoint_dir(df.sparkSession)
        return df.checkpoint()  # Parquet has neither columns without a type nor two of one name
    return written(df, "rows", ROWS_PER_FILE)


def discard(df: DataFrame) -> None:
    """Remove the checkpoints that ``df`` reads: neither it nor anything else that reads them is asked again."""
    spark = df.sparkSession
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    home = ensure_checkpoint_dir(spark).rstrip("/").rsplit("/", 1)[-1]
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        parent, folder = name.rsplit("/", 1)
        if folder.startswith("rows-") and parent.endswith(f"/{home}"):
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(hadoop).delete(path, True)


def group_sizes(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """Rows of the biggest group and of all: one partial aggregate, one row to the driver."""
    if not keys:
        return (rows := df.count()), rows
    row = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n"), F.sum("n").alias("rows")).first()
    return row["n"] or 0, row["rows"] or 0


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    return group_sizes(df, keys)[0]


def tasks_for(df: DataFrame, rows: int, share: int) -> int:
    """Tasks of at most ``share`` rows, and no fewer than there are cores: a fixed number would hold more the longer the tape."""
    return max(-(-rows // share), df.sparkSession.sparkContext.defaultParallelism)


def _ranked_by_range(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int) -> DataFrame:
    cols = [*keys, *order]
    laid = checkpointed(
        df.repartitionByRange(tasks_for(df, rows, ROWS_PER_SORT), *cols).sortWithinPartitions(*cols).withColumn("_id", F.monotonically_increasing_id())
    ).withColumn("_task", F.shiftright("_id", _TASK_BITS))
    pieces = laid.groupBy(*keys, "_task").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*keys).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    # at most one row per task plus one per key
    pieces = checkpointed(
        pieces.withColumn("_base", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))).drop("_rows")
    )
    if pieces.count() <= BROADCAST_ROWS:
        pieces = F.broadcast(pieces)
    return (
        laid.join(pieces, [*keys, "_task"])
        .withColumn(POS, F.col("_base") + F.col("_id") - F.col("_first"))
        .drop("_id", "_task", "_first", "_base")
    )


def rank_within(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Add ``_pos``, the exact zero-based rank of a row inside its key (``order`` must be total)."""
    largest, rows = group_sizes(df, keys)
    if largest <= rows_per_task:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(POS, F.row_number().over(w).cast("long") - 1)
    return _ranked_by_range(df, keys, order, rows)


class Split(NamedTuple):
    """Rows with ``_chunk`` and ``_halo``, and the columns that bound a window or a pandas group."""

    frame: DataFrame
    group: list[str]
    was_cut: bool
    #: The same rows before each group was brought to one task, for totals per chunk.
    ranked: DataFrame


def split_by_rank(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    halo: int,
    rows_per_task: int = ROWS_PER_TASK,
) -> Split:
    """Cut groups larger than ``rows_per_task``; leave the frame as it is if there are none.

    A cut frame comes with each group in one task, over as many tasks as its rows need.
    Rows with ``_halo`` are copies that only feed the windows of their chunk
    and have to be filtered out of the result.
    """
    if rows_per_task < max(halo, 1):
        raise ValueError("rows_per_task must be at least the halo")
    largest, rows = group_sizes(df, keys)
    if largest <= rows_per_task:
        # grouping by the constant as well would cost a second sort: the planner folds it out of the window's order
        whole = df.withColumns({CHUNK: F.lit(0).cast("long"), HALO: F.lit(False)})
        return Split(whole, list(keys) or [CHUNK], False, whole)
    group = [*keys, CHUNK]
    own = F.floor(F.col(POS) / F.lit(rows_per_task)).cast("long")
    ranked = _ranked_by_range(df, keys, order, rows).withColumn("_own", own)
    places = tasks_for(df, rows * PLACES_PER_CHUNK, max(rows_per_task, ROWS_PER_TASK))
    if halo == 0:
        cut = ranked.withColumnsRenamed({"_own": CHUNK}).withColumn(HALO, F.lit(False)).drop(POS)
        return Split(cut.repartition(places, *group), group, True, cut)
    near_end = F.col(POS) % rows_per_task >= rows_per_task - halo
    homes = F.when(near_end, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own"))
    cut = ranked.withColumn(CHUNK, F.explode(homes)).withColumn(HALO, F.col(CHUNK) != F.col("_own")).drop("_own", POS)
    return Split(cut.repartition(places, *group), group, True, cut)


def running_sums(
    df: DataFrame, order: Sequence[str], sums: dict[str, Column], rows_per_task: int | None = ROWS_PER_TASK
) -> DataFrame:
    """Add inclusive running sums over the whole frame in ``order`` (which must be total).

    Chunks sum in parallel and start from the totals of the chunks before them.
    ``rows_per_task=None`` states that the frame has a fixed size bound.
    """
    if rows_per_task is None:
        cut, was_cut = df.withColumns({CHUNK: F.lit(0).cast("long"), HALO: F.lit(False)}), False
    else:
        # what is summed may be bound to a column of df, and so is computed there
        read = df.withColumns({f"_in_{name}": value for name, value in sums.items()})
        sums = {name: F.col(f"_in_{name}") for name in sums}
        cut, _, was_cut, _ = split_by_rank(read, [], order, halo=0, rows_per_task=rows_per_task)
    upto = Window.partitionBy(CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = cut.withColumns({name: F.sum(value).over(upto) for name, value in sums.items()})
    if was_cut:
        earlier = Window.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
        # one row per chunk
        totals = cut.groupBy(CHUNK).agg(*[F.sum(value).alias(f"_{name}") for name, value in sums.items()])
        base = totals.select(
            CHUNK, *[F.coalesce(F.sum(f"_{name}").over(earlier), F.lit(0)).alias(f"_{name}") for name in sums]
        )
        out = out.join(base, CHUNK).withColumns({name: F.col(name) + F.col(f"_{name}") for name in sums})
        out = out.drop(*[f"_{name}" for name in sums])
    return out.drop(CHUNK, HALO, *(f"_in_{name}" for name in sums))


def own_rows(df: DataFrame) -> DataFrame:
    """Drop the halo copies and the split's bookkeeping columns."""
    return df.filter(~F.col(HALO)).drop(CHUNK, HALO)
