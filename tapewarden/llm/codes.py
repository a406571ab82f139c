"""Product codes of vectors, in whole numbers: exact nearest entries by intersected bitmasks.

Vectors are cut into four parts, each part position has a codebook of up to 256 entries.
For every dimension of a codebook the entries' coordinates are sorted, and behind the
k-th of them lies a mask of 256 bits (four words) with the first k entries set. A radius
around a part selects a range of each sorted dimension; two masks XORed are the
entries in that range, and all dimensions ANDed are the entries in the box. If the box
holds an entry no farther than the radius, the nearest entry is in the box, ties
included; otherwise the radius grows, to the distance of the best entry met if there is one.

A round of training is one pass: tasks add up their vectors per entry, Spark adds up the
tasks, and the driver sees four codebooks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewarden.llm.scratch import written
from tapewarden.session import ship_package

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors that are looked up at once.
BLOCK = 1024
#: Pairs of a vector and an entry that are subtracted at once.
PAIRS = 1 << 16
#: Label totals are sent to all executors up to this many labels.
BROADCAST_LABELS = 100_000
#: Beyond it, copies of every label's total, so that the rows of a hot label meet it in many tasks.
SALTS = 32


class SlicedBook:
    """A codebook whose nearest entries are found by slicing each dimension and intersecting bitmasks."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        count, width = entries.shape
        words = -(-count // 64)
        order = entries.argsort(axis=0, kind="stable")
        bit = np.zeros((count, words), dtype=np.uint64)
        bit[np.arange(count), np.arange(count) // 64] = np.uint64(1) << (np.arange(count) % 64).astype(np.uint64)
        self.sorted = [entries[order[:, d], d] for d in range(width)]
        first = np.zeros((1, words), dtype=np.uint64)
        self.prefix = [np.concatenate([first, np.bitwise_or.accumulate(bit[order[:, d]], axis=0)]) for d in range(width)]
        self.all = np.bitwise_or.reduce(bit, axis=0)
        self.radius = self._usual_distance()

    def _usual_distance(self) -> int:
        """The median distance from an entry to the nearest other one."""
        count, width = self.entries.shape
        if count < 2 or not width:
            return 1
        nearest = []
        for k, entry in enumerate(self.entries):
            others = ((self.entries - entry) ** 2).sum(axis=1)
            nearest.append(min(others[:k].min(initial=others.max()), others[k + 1 :].min(initial=others.max())))
        return max(1, math.isqrt(int(np.median(nearest))))

    def in_box(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """A row of flags for each vector: the entries within ``radius`` of it in every dimension."""
        found = np.repeat(self.all[None, :], len(x), axis=0)
        for d, (line, masks) in enumerate(zip(self.sorted, self.prefix, strict=True)):
            low = np.searchsorted(line, x[:, d] - radius, side="left")
            high = np.searchsorted(line, x[:, d] + radius, side="right")
            found &= masks[high] ^ masks[low]
        return np.unpackbits(found.view(np.uint8), axis=1, bitorder="little")[:, : len(self.entries)]

    def _squares(self, x: np.ndarray, flags: np.ndarray) -> np.ndarray:
        """Squared distances, right where ``flags`` are set: pair by pair where few are, as a matrix product where many."""
        reach = int(np.abs(x).max(initial=0)) + int(np.abs(self.entries).max(initial=0))
        few = flags.sum(dtype=np.int64) * 16 < flags.size
        if few or max(x.shape[1], 1) * reach**2 >= 1 << 51:  # a product of doubles would no longer be exact
            row, entry = np.nonzero(flags)
            out = np.zeros(flags.shape, dtype=np.int64)
            for start in range(0, len(row), PAIRS):
                some = slice(start, start + PAIRS)
                out[row[some], entry[some]] = ((x[row[some]] - self.entries[entry[some]]) ** 2).sum(axis=1)
            return out
        a, b = x.astype(np.float64), self.entries.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of each row, ties to the lower index."""
        index, distance = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=np.int64)
        todo, radius = np.arange(len(x)), np.full(len(x), self.radius, dtype=np.int64)
        most = np.iinfo(np.int64).max
        while len(todo):
            flags = self.in_box(x[todo], radius)
            square = np.where(flags, self._squares(x[todo], flags), most)
            chosen = square.argmin(axis=1)  # the first of equal ones
            best = square[np.arange(len(todo)), chosen]
            done = best <= radius * radius
            index[todo[done]], distance[todo[done]] = chosen[done], best[done]
            met = (best < most) & ~done
            grown = radius * 2
            grown[met] = np.ceil(np.sqrt(best[met].astype(np.float64))).astype(np.int64) + 1
            todo, radius = todo[~done], grown[~done]
        return index, distance


def _limit(width: int) -> int:
    """Largest component, so that the squared distances of a vector add up in 64 bits."""
    return math.isqrt((1 << 62) // max(width, 1)) // 2


def _edges(width: int) -> list[int]:
    return [p * width // PARTS for p in range(PARTS + 1)]


def whole_vectors(embeddings: DataFrame, column: str, label: str) -> tuple[DataFrame, int]:
    """``vec_id, label, vector`` (bytes of 32-bit whole numbers) of the usable rows, and their number of components."""
    vector = F.col(column)
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = embeddings.filter(vector.isNotNull() & finite)
    lengths = rows.groupBy(F.size(vector).alias("width")).agg(F.count(F.lit(1)).alias("n"))
    commonest = lengths.agg(F.max_by("width", F.struct("n", "width"))).first()[0] or 0
    limit = _limit(commonest)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["values"]
            x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))
            with np.errstate(over="ignore"):
                whole = np.clip(np.floor(x * SCALE), -limit, limit).astype("<i4")
            packed = pa.array([row.tobytes() for row in whole], pa.binary()) if commonest else pa.array([b""] * len(lists), pa.binary())
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], packed], ["vec_id", "label", "vector"])

    label_type = dict(rows.dtypes)[label]
    chosen = rows.filter(F.size(vector) == commonest).select(F.col("vec_id").cast("long"), F.col(label).alias("label"), vector.alias("values"))
    return written(chosen.mapInArrow(pack, f"vec_id long, label {label_type}, vector binary"), "whole_vectors"), commonest


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<i4").astype(np.int64).reshape(len(column), width)


def first_books(rows: DataFrame, width: int) -> list[np.ndarray]:
    """The parts of the vectors of the smallest vec_ids; a null vec_id comes last, the least vector speaks for a repeated one."""
    ids = [r[0] for r in rows.select("vec_id").distinct().orderBy(F.asc_nulls_last("vec_id")).limit(ENTRIES).collect()]
    known = [i for i in ids if i is not None]
    wanted = F.lit(False)
    if known:
        wanted = F.col("vec_id") <= max(known)
    if len(known) < len(ids):
        wanted = F.coalesce(wanted, F.lit(True))
    least = rows.filter(wanted).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    vectors = {r.vec_id: r.vector for r in least.collect()}  # ENTRIES rows
    table = np.array([np.frombuffer(vectors[i], dtype="<i4") for i in ids], dtype=np.int64).reshape(len(ids), width)
    edges = _edges(width)
    return [table[:, a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _trained(rows: DataFrame, books: list[np.ndarray], width: int) -> list[np.ndarray]:
    """One round: every entry becomes the mean of the parts nearest to it, rounded down."""
    edges = _edges(width)
    widest = max(b - a for a, b in zip(edges[:-1], edges[1:], strict=True))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sliced = [SlicedBook(b) for b in books]
        counts = np.zeros((PARTS, ENTRIES), dtype=np.int64)
        sums = np.zeros((PARTS, ENTRIES, widest), dtype=np.int64)
        for batch in batches:
            x = _matrix(batch["vector"], width)
            for start in range(0, len(x), BLOCK):
                for p, book in enumerate(sliced):
                    part = x[start : start + BLOCK, edges[p] : edges[p + 1]]
                    index, _ = book.nearest(part)
                    np.add.at(counts[p], index, 1)
                    np.add.at(sums[p], (index, slice(0, part.shape[1])), part)
        cells = np.flatnonzero(counts.ravel())
        lists = sums.reshape(PARTS * ENTRIES, widest)[cells]
        columns = [pa.array(cells.astype(np.int32)), pa.array(counts.ravel()[cells]), pa.array(list(lists), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["cell", "n", "sums"])

    partials = rows.select("vector").mapInArrow(add, "cell int, n long, sums array<long>")
    totals = [F.sum(F.get("sums", k)).alias(f"s{k}") for k in range(widest)]
    out = [b.copy() for b in books]
    for row in partials.groupBy("cell").agg(F.sum("n").alias("n"), *totals).collect():  # PARTS * ENTRIES rows
        p, entry = divmod(row["cell"], ENTRIES)
        for k in range(edges[p + 1] - edges[p]):
            out[p][entry, k] = row[f"s{k}"] // row["n"]
    return out


def product_codes(embeddings: DataFrame, column: str = "embedding", label: str = "label") -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every usable row of ``embeddings``.

    Components become ``floor(1024 * x)``. The codebooks start with the 256 smallest vec_ids and are trained
    for four rounds; ``code`` holds the final indexes (two hex digits each), ``error`` the squared distances
    summed over the parts, ``label_error`` the errors summed over equal labels (nulls together).

    Vectors that are null or hold null or non-finite components take no part, nor do vectors of another
    length than the commonest one (the longer, if two are equally common). A length that four does not
    divide gives parts that differ by one component, perhaps empty ones (code 00). Components
    beyond ``_limit(length)`` (131,072 for 64 components, before scaling) saturate, so that
    sums fit 64 bits. Repeated rows are coded alike and each counts in the means, but a repeated vec_id makes
    one starting entry, of its least vector by bytes; a null vec_id is coded, and makes an entry after
    all others. Fewer than 256 vec_ids make smaller codebooks. Other columns are ignored; an
    empty table gives an empty result.
    """
    ship_package(embeddings.sparkSession)
    rows, width = whole_vectors(embeddings, column, label)
    books = first_books(rows, width)
    empty = not len(books[0])
    for _ in range(0 if empty else ROUNDS):
        books = _trained(rows, books, width)
    edges = _edges(width)
    listed = ",".join(str(x) for book in books for x in book.ravel().tolist())
    digest = hashlib.sha256(listed.encode()).hexdigest()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sliced = [SlicedBook(b) for b in books]
        for batch in batches:
            x = _matrix(batch["vector"], width)
            index, error = np.zeros((len(x), PARTS), dtype=np.uint8), np.zeros(len(x), dtype=np.int64)
            for start in range(0, len(x), BLOCK):
                some = slice(start, start + BLOCK)
                for p, book in enumerate(sliced):
                    found, distance = book.nearest(x[some, edges[p] : edges[p + 1]])
                    index[some, p] = found
                    error[some] += distance
            codes = pa.array([row.tobytes().hex() for row in index], pa.string())
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], codes, pa.array(error)], ["vec_id", "label", "code", "error"])

    kind = f"vec_id long, label {dict(rows.dtypes)['label']}, code string, error long"
    coded = written(rows.mapInArrow(code, kind), "codes")
    by_label = written(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label_errors")
    if by_label.count() <= BROADCAST_LABELS:
        totals, same = F.broadcast(by_label.withColumnRenamed("label", "of")), F.col("label").eqNullSafe(F.col("of"))
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        totals = by_label.select(F.col("label").alias("of"), "label_error", salts)
        coded = coded.withColumn("own", F.pmod(F.xxhash64("vec_id", "code", "error"), F.lit(SALTS)).cast("int"))
        same = F.col("label").eqNullSafe(F.col("of")) & (F.col("own") == F.col("salt"))
    joined = coded.join(totals, same)
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
