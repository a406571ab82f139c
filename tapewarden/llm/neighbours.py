"""Nearest neighbours by cross-polytope hashing, with exact reranking.

A table turns unit vectors by a pseudo-random rotation (signs and fast Hadamard
transforms, three times) and puts each into the bucket of its nearest signed axis.
Where the index is large, a second rotation refines the bucket by the nearest of a
few signed axes, so buckets keep about ``ROWS_A_BUCKET`` rows. A query probes the
buckets whose axes are nearest to it in every table and compares itself with all
vectors there, on the original vectors and in double precision.

Rows and queries meet in cells: a bucket, or a block of it by a block of its queries
where it is large. Only the k nearest of each cell leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewarden.llm.cells import groups
from tapewarden.llm.scratch import written
from tapewarden.session import ship_package

TABLES, PROBES = 10, 10
ROWS_A_BUCKET = 512
#: Rows and queries in a cell, at most about.
ROW_BLOCK, QUERY_BLOCK = 4096, 512

CELL = ("width", "table", "bucket", "row_block", "query_block")


def hadamard(x: np.ndarray) -> np.ndarray:
    rows, width = x.shape
    half = 1
    while half < width:
        pairs = x.reshape(rows, width // (2 * half), 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(rows, width)
        half *= 2
    return x / np.sqrt(width)


def signed_axes(x: np.ndarray, table: int, level: int, axes: int | None = None) -> np.ndarray:
    """Nearness of unit vectors to the first ``axes`` axes and their opposites, after the rotation of (table, level)."""
    width = 1 << max(x.shape[1] - 1, 0).bit_length()
    turned = np.zeros((len(x), width))
    turned[:, : x.shape[1]] = x
    signs = np.random.Generator(np.random.PCG64([table, level, width])).choice([-1.0, 1.0], (3, width))
    for flip in signs:
        turned = hadamard(turned * flip)
    turned = turned[:, :axes]
    return np.concatenate([turned, -turned], axis=1)


def buckets(x: np.ndarray, table: int, fine: int) -> np.ndarray:
    code = signed_axes(x, table, 0).argmax(axis=1)
    return code * 2 * fine + signed_axes(x, table, 1, fine).argmax(axis=1) if fine else code


def probes(x: np.ndarray, table: int, fine: int, count: int) -> np.ndarray:
    """The ``count`` buckets of each query whose axes are least farther than the nearest ones."""
    near = signed_axes(x, table, 0)
    cost = (near.max(axis=1, keepdims=True) - near) ** 2
    if fine:
        near = signed_axes(x, table, 1, fine)
        second = (near.max(axis=1, keepdims=True) - near) ** 2
        cost = (cost[:, :, None] + second[:, None, :]).reshape(len(x), -1)
    count = min(count, cost.shape[1])
    return np.argpartition(cost, count - 1, axis=1)[:, :count]


def _matrix(column: pa.ChunkedArray | pa.Array, kind: str) -> np.ndarray:
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), dtype=kind).reshape(len(parts), -1)


def _hashed(vectors: DataFrame, kind: str, fine: int, probe: int | None) -> DataFrame:
    """``vec_id, width, vector, table, bucket``: a row for each table, or for each probe of a query."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch["width"].to_numpy()
            for width in np.unique(widths):
                part = batch.take(pa.array(np.flatnonzero(widths == width)))
                x = _matrix(part["vector"], kind).astype(np.float64)
                x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small numbers
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                for table in range(TABLES):
                    code = buckets(x, table, fine)[:, None] if probe is None else probes(x, table, fine, probe)
                    owner = np.repeat(np.arange(len(x)), code.shape[1])
                    rows = part.take(pa.array(owner))
                    columns = [rows["vec_id"], rows["width"], rows["vector"], pa.array(np.full(len(owner), table, np.int32)), pa.array(code.ravel().astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, ["vec_id", "width", "vector", "table", "bucket"])

    return vectors.mapInArrow(place, "vec_id long, width int, vector binary, table int, bucket long")


def _blocked(rows: DataFrame, size: int, block: str, other: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with their block, and the buckets that have several."""
    key = ["width", "table", "bucket"]
    large = rows.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("blocks")).filter("blocks > 1")
    own = F.pmod(F.xxhash64("vec_id"), F.coalesce("blocks", F.lit(1))).cast("int")
    return rows.join(large, key, "left").withColumn(block, own).drop("blocks"), large.withColumnRenamed("blocks", other)


def _nearest(rows: DataFrame, queries: DataFrame, kind: str, k: int) -> DataFrame:
    """``query_id, vec_id, score``: the k nearest of every cell; both sides have ``width, table, bucket``."""
    key = ["width", "table", "bucket"]
    rows, row_blocks = _blocked(rows, ROW_BLOCK, "row_block", "n_row_blocks")
    queries, query_blocks = _blocked(queries, QUERY_BLOCK, "query_block", "n_query_blocks")

    def spread(side: DataFrame, blocks: DataFrame, count: str, block: str) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(count), F.lit(1)) - 1))
        return side.join(blocks, key, "left").withColumn(block, every)

    def shaped(side: DataFrame, is_query: bool) -> DataFrame:
        return side.select(*CELL, F.lit(is_query).alias("is_query"), "vec_id", "vector")

    both = shaped(spread(rows, query_blocks, "n_query_blocks", "query_block"), False).unionByName(
        shaped(spread(queries, row_blocks, "n_row_blocks", "row_block"), True)
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in groups(batches, CELL):
            asks = cell["is_query"].to_numpy()
            if asks.all() or not asks.any():
                continue
            ids = cell["vec_id"].to_numpy()
            x = _matrix(cell["vector"], kind).astype(np.float64)
            there, there_ids = x[~asks], ids[~asks]
            found = []
            for query, vector in zip(ids[asks], x[asks], strict=True):
                score = np.sqrt(((there - vector) ** 2).sum(axis=1))
                score[there_ids == query] = np.inf
                limit = np.partition(score, k - 1)[k - 1] if len(score) > k else np.inf
                near = np.flatnonzero(score <= limit)
                near = near[np.lexsort((there_ids[near], score[near]))][:k]
                near = near[there_ids[near] != query]
                found.append((np.full(len(near), query), there_ids[near], score[near]))
            columns = [np.concatenate(c) for c in zip(*found, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])

    cells = both.repartition(*CELL).sortWithinPartitions(*CELL)
    return cells.mapInArrow(compare, "query_id long, vec_id long, score double")


def _valid(rows: DataFrame, column: str) -> DataFrame:
    """``vec_id, width, vector (bytes), kind``; without vectors that are null, zero, or hold nulls or non-finite numbers."""
    vector = F.col(column)

    def usable(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))

    fine = vector.isNotNull() & F.forall(vector, usable) & F.exists(vector, lambda x: x != 0)
    return rows.filter(F.col("vec_id").isNotNull() & fine).select(F.col("vec_id").cast("long"), vector.alias("values")).distinct()


def nearest_neighbours(
    embeddings: DataFrame, queries: Column | None = None, k: int = 10, column: str = "embedding", fine: int | None = None
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest found of each query, by Euclidean distance.

    ``queries`` selects the rows that ask (default: vec_id divisible by 100); every other row is a
    candidate. Nearest first, ties to the smaller vec_id. A query that finds fewer than ``k`` in its
    buckets is compared with all rows, so it gets ``k``, or all candidates if there are fewer.
    ``fine`` is the number of axes of the second rotation; by default it follows the number of rows.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows
    without vec_id; vectors of different length are never compared. Rows of one vec_id with equal
    vectors are one row; a row is no neighbour of its own vec_id. Other columns are ignored; an empty
    table gives an empty result.
    """
    ship_package(embeddings.sparkSession)
    kind = "<f4" if dict(embeddings.dtypes)[column] == "array<float>" else "<f8"
    asks = F.col("vec_id") % 100 == 0 if queries is None else queries
    valid = _valid(embeddings, column).withColumn("asks", asks)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.asarray(v, dtype=kind) for v in batch["values"].to_pylist()]
            columns = [batch["vec_id"], batch["asks"], pa.array([len(r) for r in rows], pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "asks", "width", "vector"])

    rows = written(valid.mapInArrow(pack, "vec_id long, asks boolean, width int, vector binary"), "vectors")
    asking = rows.filter("asks").drop("asks")
    index = rows.drop("asks")
    widths = index.groupBy("width").agg(F.count(F.lit(1)).alias("n"))
    n, width = (widths.agg(F.max("n"), F.max_by("width", "n")).first() or (None, None))
    axes = 1 << max((width or 1) - 1, 0).bit_length()
    if fine is None:
        fine = min(axes, -(-(n or 0) // (2 * axes * ROWS_A_BUCKET)) // 2) if (n or 0) > 2 * axes * ROWS_A_BUCKET else 0
    count = int(np.ceil(PROBES * max(1, 2 * fine) ** 0.75))
    found = _nearest(_hashed(index, kind, fine, None), _hashed(asking, kind, fine, count), kind, k)
    found = written(found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")), "found")
    # queries that met too few rows look at all of them, in blocks
    enough = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k)
    short = asking.join(enough.select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti")
    everywhere = [F.lit(-1).alias("table"), F.lit(0).cast("long").alias("bucket")]
    if not short.isEmpty():
        rest = _nearest(index.select("*", *everywhere), short.select("*", *everywhere), kind, k)
        found = found.unionByName(rest).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    # a query has at most k rows from each of its cells
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
