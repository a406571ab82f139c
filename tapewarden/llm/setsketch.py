"""Near-duplicate documents by SetSketch registers.

A register holds the smallest of exponentially distributed values of a set's
elements, truncated to a step of a geometric scale (base ``BASE``). Registers of
a union are register-wise maxima, so sketches merge; two sets agree in a register
with about their Jaccard similarity, so bands of registers collide like MinHash
bands. The counts of larger, equal and smaller registers, together with the two
known set sizes, give a maximum-likelihood estimate of the similarity; candidates
that it leaves possible are confirmed on full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewarden.llm.links import link_components
from tapewarden.llm.scratch import written
from tapewarden.llm.words import fingerprint, mixed, shingles, text_rounds, words
from tapewarden.session import ship_package

BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
BASE, RATE, TOP = 1.001, 20.0, 65_534
#: Estimates below ``threshold - MARGIN`` standard deviations are not confirmed; one in fifty million true links is.
MARGIN = 5.5

_GOLD = 0x9E3779B97F4A7C15
_AT_ONCE = 1 << 16
_BAND_VALUE = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 63, (BANDS, ROWS + 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def smallest_values(sets: list[np.ndarray], registers: int = REGISTERS) -> np.ndarray:
    """For each set and register the smallest of the elements' Exp(1) values.

    An element throws points at rate ``registers`` on a time axis, each at a random
    register: the first at a register comes after an Exp(1) time. With n elements
    only points before about ``ln(registers) / n`` can matter, so a set costs
    ``registers * ln(registers)`` points whatever its size. Sets with a register
    still empty look twice as far.
    """
    out = np.full((len(sets), registers), np.inf)
    todo = np.array([i for i, s in enumerate(sets) if len(s)], dtype=np.int64)
    reach = np.log(registers) + 2
    while len(todo):
        sizes = np.array([len(sets[i]) for i in todo])
        element = np.concatenate([sets[i] for i in todo])
        row = np.repeat(np.arange(len(todo)), sizes)
        limit = (reach / sizes)[row]
        at = np.zeros(len(element))
        found = np.full(len(todo) * registers, np.inf)
        throw = 0
        while len(element):
            # few elements throw several points at once; sums run in the same order either way
            many = int(np.clip(_AT_ONCE // len(element), 1, 64))
            turns = np.array([(2 * (throw + k) + 3) * _GOLD & (1 << 64) - 1 for k in range(many)], dtype=np.uint64)
            throw += many
            x = mixed(element[:, None] + turns)
            # 40 bits make the waiting time, the other 24 choose the register
            wait = -np.log(((x >> np.uint64(24)).astype(np.float64) + 0.5) * 2.0**-40) / registers
            wait[:, 0] += at
            when = np.cumsum(wait, axis=1)
            cell = ((x & np.uint64(0xFFFFFF)) * np.uint64(registers) >> np.uint64(24)).astype(np.int64)
            cell += row[:, None] * registers
            soon = when < limit[:, None]
            np.minimum.at(found, cell[soon], when[soon])
            live = np.flatnonzero(soon[:, -1])
            element, row, at, limit = element[live], row[live], when[live, -1], limit[live]
        found = found.reshape(len(todo), registers)
        full = np.isfinite(found).all(axis=1)
        out[todo[full]] = found[full]
        todo = todo[~full]
        reach *= 2
    return out


def truncated(values: np.ndarray) -> np.ndarray:
    """Registers: the step of the geometric scale that a value falls on, larger for smaller values."""
    with np.errstate(divide="ignore"):
        step = np.floor(1 - np.log(values / RATE) / np.log(BASE))
    return np.clip(step, 0, TOP + 1).astype("<u2")


def band_keys(registers: np.ndarray) -> np.ndarray:
    parts = registers.reshape(len(registers), BANDS, ROWS).astype(np.uint64)
    sums = (mixed(parts + np.uint64(1)) * _BAND_VALUE[:, :ROWS]).sum(axis=2, dtype=np.uint64)
    return mixed(sums + _BAND_VALUE[:, ROWS]).view(np.int64)


_GRID = np.linspace(0.0, 1.0, 201)


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 0.0, 1.0) * (BASE - 1) / BASE) / np.log(BASE)


def estimated_similarity(n_a: np.ndarray, a: np.ndarray, n_b: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity that makes the observed register comparisons most likely, on a grid of 0.005."""
    larger, smaller = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    equal = a.shape[1] - larger - smaller
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    j = _GRID[None, :] * np.minimum(u / v, v / u)
    up, down = _p(u - v * j), _p(v - u * j)
    tiny = 1e-12
    likelihood = larger * np.log(up + tiny) + smaller * np.log(down + tiny) + equal * np.log(np.maximum(1 - up - down, 0) + tiny)
    best = likelihood.argmax(axis=1)
    return j[np.arange(len(j)), best]


def _sketched(documents: DataFrame) -> DataFrame:
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in text_rounds(batch["text"]):
                sets = shingles(words(texts))
                registers = truncated(smallest_values(sets))
                keys = band_keys(registers)
                prints = [fingerprint(s) if len(s) else (None, None) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].slice(texts.first, len(sets)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([p[0] for p in prints], pa.int64()),
                        pa.array([p[1] for p in prints], pa.int64()),
                        pa.array([r.tobytes() for r in registers], pa.binary()),
                        pa.array(list(keys), pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n", "fa", "fb", "sketch", "keys"],
                )

    kind = "doc_id long, n long, fa long, fb long, sketch binary, keys array<long>"
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(sketch, kind)


def _full_sets(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(id, members)`` of the wanted representatives, their shingles computed again from the text."""
    texts = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(wanted, "doc_id")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, fa, fb = (batch[k].to_pylist() for k in ("id", "fa", "fb"))
            for texts in text_rounds(batch["text"]):
                rows = []
                for k, one in enumerate(shingles(words(texts)), texts.first):
                    # another row may carry the same doc_id
                    if len(one) and fingerprint(one) == (fa[k], fb[k]):
                        rows.append((ids[k], one.tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["id", "members"]
                )

    found = texts.select("id", "fa", "fb", "text").mapInArrow(build, "id long, members binary")
    return found.dropDuplicates(["id"])


def near_duplicates(documents: DataFrame, percent: int = 85) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``documents(doc_id, text, …)``.

    Documents whose sets of five-word shingles overlap by ``percent`` of their union
    or more are linked; ``component_id`` is the smallest doc_id reachable.

    A text without words (null, empty, only spaces) has an empty set and is linked
    with nothing. Texts of one to four words are one shingle. Repeated rows count as
    the same document and are both marked alike. A row without doc_id is linked with
    nothing, keeps a null ``component_id`` and is kept. Other columns are ignored;
    an empty table gives an empty result.
    """
    ship_package(documents.sparkSession)
    rows = written(_sketched(documents), "sketches")
    # equal sets need no search: one representative each
    sets = rows.filter("n > 0 and doc_id is not null").groupBy("fa", "fb").agg(
        F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("keys").alias("keys")
    )
    sets = written(sets.withColumn("id", F.monotonically_increasing_id()), "representatives")
    names = sets.select("id", "fa", "fb", "doc_id")
    threshold = percent / 100
    floor = threshold - MARGIN * np.sqrt(threshold * (1 - threshold) / REGISTERS)
    labels = link_components(
        sets.select("id", "n", "sketch", "keys"),
        lambda ids: _full_sets(documents, names.join(ids, "id")),
        estimated_similarity,
        float(floor),
        percent,
        ROWS,
    )
    placed = names.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    smallest = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    found = placed.join(smallest, "component").select("fa", "fb", "component_id")
    out = rows.select("doc_id", "n", "fa", "fb").join(found, ["fa", "fb"], "left")
    alone = F.col("n").eqNullSafe(0) | F.col("doc_id").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )
