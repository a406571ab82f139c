"""Exact similarity links from colliding band keys, without emitting the pairs of a group.

1. Every bucket (a band key with two members or more) makes a star around one of its
   members. Star pairs that the sketches allow are confirmed on full sets, and
   confirmed links are merged to components. This is done a few times with other
   middles, in buckets whose members still lie in several components.
2. What is left are pairs *across* components. They are compared in blocks of bounded
   size, by sketch and then by full set, and only links leave the task.

A pair that already is connected never needs its own check, so a bucket of n near
copies costs about n confirmations; and a pair that is not connected is never
skipped unless its sketches rule it out. Buckets are counted by partial
aggregation and joined (adaptive execution splits hot join keys); blocks bound what
a task holds of a bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewarden.llm.cells import groups
from tapewarden.llm.graph import components
from tapewarden.llm.scratch import written

#: Members, and elements of their sets, that a block of a bucket holds about at most.
BLOCK, BLOCK_ELEMENTS = 512, 1_000_000
#: Rounds of stars before the pairs across components are looked at.
STARS = 3

#: (sizes a, sketches a, sizes b, sketches b) -> estimated similarity of each row pair
Estimate = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _stacked(column: pa.Array, kind: str) -> np.ndarray:
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), dtype=kind).reshape(len(parts), -1)


def _estimated(pairs: DataFrame, sketches: DataFrame, estimate: Estimate, floor: float) -> DataFrame:
    """``(a, b, likeness)`` of the pairs whose sketches leave ``floor`` possible."""
    side = {x: sketches.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}")) for x in "ab"}
    both = pairs.join(side["a"], "a").join(side["b"], "b").select("a", "b", "n_a", "n_b", "s_a", "s_b")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            likeness = estimate(
                batch["n_a"].to_numpy(), _stacked(batch["s_a"], "<u2"), batch["n_b"].to_numpy(), _stacked(batch["s_b"], "<u2")
            )
            keep = pa.array(likeness >= floor)
            found = pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(likeness)], ["a", "b", "likeness"])
            yield found.filter(keep)

    return both.mapInArrow(judge, "a long, b long, likeness double")


def _overlap(x: bytes, y: bytes, percent: int) -> bool:
    """Whether two sets of sorted hashes have ``100 * intersection >= percent * union``."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.sort(np.concatenate([np.frombuffer(x, dtype="<u8"), np.frombuffer(y, dtype="<u8")]), kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with ``100 * intersection >= percent * union`` on full sets."""
    side = {x: sets.select(F.col("id").alias(x), F.col("members").alias(f"m_{x}")) for x in "ab"}
    both = pairs.select("a", "b").join(side["a"], "a").join(side["b"], "b").select("a", "b", "m_a", "m_b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = (batch["m_a"].to_pylist(), batch["m_b"].to_pylist())
            linked = [_overlap(x, y, percent) for x, y in zip(*sides, strict=True)]
            found = pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"])
            yield found.filter(pa.array(linked, pa.bool_()))

    return both.mapInArrow(compare, "a long, b long")


def _mixed(rows: DataFrame) -> DataFrame:
    """Keys of the buckets whose members lie in several components, with counts."""
    counted = rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("size"), F.sum("n").alias("elements"), F.min("component").alias("low"), F.max("component").alias("high")
    )
    return counted.filter("low <> high").drop("low", "high")


def _across(rows: DataFrame, sketches: DataFrame, sets: DataFrame, estimate: Estimate, floor: float, percent: int, band_rows: int) -> DataFrame:
    """Links between components, from ``rows(key, band, id, n, component)``: every pair of a bucket is considered.

    Members meet in cells, pairs of blocks of a bucket. A pair is looked at in the
    first band in which the two collide; once two components are linked in a cell,
    their other pairs there are passed over.
    """
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("elements") / BLOCK_ELEMENTS)).cast("int")
    placed = rows.join(_mixed(rows).select("key", blocks.alias("blocks")), "key")
    placed = placed.withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    # a row goes to each pair of blocks that holds its own
    cells = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", "band", "id", "n", "component", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")
    )
    cells = cells.join(sketches.select("id", "sketch"), "id").join(sets, "id").repartition("key", "i", "j")
    cells = cells.sortWithinPartitions("key", "i", "j", "id")
    flat = ("key", "i", "j", "band", "id", "component", "own", "n")

    def one(cell: dict[str, np.ndarray], sketch: np.ndarray, members: pa.ChunkedArray) -> list[tuple[int, int]]:
        ids, own, n, band = cell["id"], cell["own"], cell["n"], int(cell["band"][0])
        two_blocks = cell["i"][0] != cell["j"][0]
        component = cell["component"].copy()
        out = []
        for row in range(len(ids) - 1):
            pick = np.arange(row + 1, len(ids))
            pick = pick[component[pick] != component[row]]
            if two_blocks:
                pick = pick[own[pick] != own[row]]
            if not len(pick):
                continue
            equal = sketch[pick] == sketch[row]
            # far fewer equal registers than any link has: no need to estimate
            pick, equal = (x[equal.mean(axis=1) >= floor - 0.1] for x in (pick, equal))
            met = equal.reshape(len(pick), sketch.shape[1] // band_rows, band_rows).all(axis=2).argmax(axis=1)
            pick = pick[met == band]
            if not len(pick):
                continue
            likeness = estimate(np.full(len(pick), n[row]), np.broadcast_to(sketch[row], (len(pick), sketch.shape[1])), n[pick], sketch[pick])
            for other in pick[np.argsort(-likeness)][: int((likeness >= floor).sum())]:
                if component[other] != component[row] and _overlap(members[row].as_py(), members[int(other)].as_py(), percent):
                    out.append((int(min(ids[row], ids[other])), int(max(ids[row], ids[other]))))
                    component[component == component[other]] = component[row]
        return out

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in groups(batches, ("key", "i", "j")):
            if len(cell) > 1:
                found = one({k: cell[k].to_numpy() for k in flat}, _stacked(cell["sketch"], "<u2"), cell["members"])
                pairs = np.array(found, dtype=np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return cells.select(*flat, "sketch", "members").mapInArrow(compare, "a long, b long").distinct()


def link_components(
    sketches: DataFrame,
    sets_of: Callable[[DataFrame], DataFrame],
    estimate: Estimate,
    floor: float,
    percent: int,
    band_rows: int,
) -> DataFrame:
    """``(node, component)`` of all linked rows of a written table ``sketches(id, n, sketch, keys)``.

    ``keys`` are the hashes of consecutive stretches of ``band_rows`` sketch values.
    ``sets_of(ids)`` returns ``(id, members)``, the full sets as sorted 64-bit hashes.
    """
    colliding = sketches.select("id", "n", F.posexplode("keys").alias("band", "key"))
    buckets = colliding.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    buckets = written(buckets.select("key"), "buckets")
    crowd = written(colliding.join(buckets, "key"), "crowd")
    sets = written(sets_of(crowd.select("id").distinct()), "sets")
    labels, links = None, None
    for turn in range(STARS):
        rows = crowd if labels is None else crowd.join(
            labels.select(F.col("node").alias("id"), F.col("component").alias("known")), "id", "left"
        )
        component = F.col("id") if labels is None else F.coalesce("known", "id")
        rows = rows.withColumn("component", component).select("key", "band", "id", "n", "component")
        if turn:
            rows = written(rows, "crowd")
            if _mixed(rows).isEmpty():
                return labels
        order = F.col("id") if not turn else F.xxhash64("id", F.lit(turn))
        hubs = rows.groupBy("key").agg(F.min_by(F.struct(F.col("id").alias("hub"), F.col("component").alias("of")), order).alias("h"))
        stars = rows.join(hubs.select("key", "h.hub", "h.of"), "key").filter("component <> of")
        stars = stars.select(F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b")).distinct()
        found = written(confirmed(_estimated(stars, sketches, estimate, floor), sets, percent).select("a", "b"), "links")
        links = found if links is None else links.unionByName(found)
        labels = components(links)
    rows = crowd.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    last = written(_across(rows, sketches, sets, estimate, floor, percent, band_rows), "links")
    return labels if last.isEmpty() else components(links.unionByName(last))
