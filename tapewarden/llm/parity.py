"""Jaccard join of documents by parity sketches: no link is missed, whatever the texts.

Every shingle flips one bit of a sketch. Two sketches differ in at most as many bits as
their sets differ in shingles, so their Hamming distance is a lower bound of the symmetric
difference. Sets of similar size form a band; a band allows at most K differing shingles.
Its sketches have ``K // 2 + 1`` sections, so that sketches of linked sets differ in at
most one bit of some section, and then two of the section's three words agree: the
two words are a join key. A set takes part in every band that a larger partner may lie in.

Equal sets are one representative. In a bucket of a key, members first meet one of
them (stars, a few rounds); then what still lies in different components is compared
in cells, blocks of sketches of bounded size. What passes its sketches is confirmed on full
shingle sets. Cells send out sketch links that join components, not all pairs; where a
sent link is refused, its cell is gone through again and sends out every pair that passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewarden.llm.cells import groups
from tapewarden.llm.graph import components
from tapewarden.llm.links import confirmed
from tapewarden.llm.scratch import written
from tapewarden.llm.words import fingerprint, mixed, shingles, text_rounds, words
from tapewarden.session import ship_package

WIDTH, PERCENT = 3, 90
#: Ratio of a band's upper to its lower size.
GROWTH = 1.35
#: Words of a section; two of three make a key.
PIECES = ((0, 1), (0, 2), (1, 2))
#: Members, and words of their sketches, that a block of a bucket holds about at most.
BLOCK, BLOCK_WORDS = 512, 1 << 18
STARS = 3
#: Keys in an Arrow batch.
KEYS_AT_ONCE = 1 << 17

CELL = ("key", "i", "j")

_rng = np.random.Generator(np.random.PCG64(1117))
_KEY_VALUE = _rng.integers(0, 1 << 63, (len(PIECES), 4), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_edges(growth: float = GROWTH) -> np.ndarray:
    """Smallest size of each band; every size up to two thousand million lies in one."""
    edges = [1]
    while edges[-1] < 1 << 31:
        edges.append(max(edges[-1] + 1, int(edges[-1] * growth)))
    return np.array(edges, dtype=np.int64)


EDGES = band_edges()


def tolerance(band: int, percent: int) -> int:
    """Most shingles in which two linked sets of a band differ."""
    return int(2 * (EDGES[band + 1] - 1) * (100 - percent) // (100 + percent))


def bands_of(n: int, percent: int) -> range:
    """The bands in which a set of n shingles may meet a partner of its size or larger, or smaller ones."""
    own, last = np.searchsorted(EDGES, [n, n * 100 // percent], side="right") - 1
    return range(own, last + 1)


def sketch(members: np.ndarray, sections: int) -> np.ndarray:
    """Three words of 64 bits for each section; every member flips one bit."""
    spread = mixed(members ^ np.uint64(0xA0761D6478BD642F))
    word = ((spread >> np.uint64(32)) * np.uint64(3 * sections) >> np.uint64(32)).astype(np.int64)
    bit = np.uint64(1) << (spread & np.uint64(63))
    out = np.zeros(3 * sections, dtype=np.uint64)
    np.bitwise_xor.at(out, word, bit)
    return out


def _sketched(documents: DataFrame, width: int, percent: int) -> DataFrame:
    """``doc_id, n, fa, fb, bands, sketches``; sets that can only be linked with equal ones have no sketch."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in text_rounds(batch["text"]):
                sets = shingles(words(texts), width)
                prints = [fingerprint(s) if len(s) else (None, None) for s in sets]
                bands = [[b for b in bands_of(len(s), percent) if tolerance(b, percent)] if len(s) else [] for s in sets]
                made = [[sketch(s, tolerance(b, percent) // 2 + 1).tobytes() for b in own] for s, own in zip(sets, bands, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].slice(texts.first, len(sets)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([p[0] for p in prints], pa.int64()),
                        pa.array([p[1] for p in prints], pa.int64()),
                        pa.array(bands, pa.list_(pa.int32())),
                        pa.array(made, pa.list_(pa.binary())),
                    ],
                    ["doc_id", "n", "fa", "fb", "bands", "sketches"],
                )

    kind = "doc_id long, n long, fa long, fb long, bands array<int>, sketches array<binary>"
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(build, kind)


def _full_sets(documents: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``(id, members)`` of the wanted representatives, their shingles computed again from the text."""
    texts = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(wanted, "doc_id")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, fa, fb = (batch[k].to_pylist() for k in ("id", "fa", "fb"))
            for part in text_rounds(batch["text"]):
                sets = enumerate(shingles(words(part), width), part.first)
                # another row may carry the same doc_id
                rows = [(ids[k], s.tobytes()) for k, s in sets if len(s) and fingerprint(s) == (fa[k], fb[k])]
                columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "members"])

    return texts.select("id", "fa", "fb", "text").mapInArrow(build, "id long, members binary").dropDuplicates(["id"])


def _words_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The words of all sketches in a row, and where each begins (one more: the end)."""
    parts = column.to_pylist()
    ends = np.cumsum([0, *(len(p) // 8 for p in parts)])
    return np.frombuffer(b"".join(parts), dtype="<u8"), ends


def key_rows(sketches: DataFrame) -> DataFrame:
    """``key, slot, band, id, n``: the keys of ``sketches(id, n, band, sketch)``; ``slot`` numbers the keys of a sketch."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, ends = _words_of(batch["sketch"])
            columns = {c: batch[c].to_numpy() for c in ("band", "id", "n")}
            row = 0
            while row < batch.num_rows:
                last = max(row + 1, int(np.searchsorted(ends, ends[row] + KEYS_AT_ONCE, side="right")) - 1)
                word = flat[ends[row] : ends[last]].reshape(-1, 3)
                sections = np.diff(ends[row : last + 1]) // 3
                owner = np.repeat(np.arange(row, last), sections)
                section = np.arange(len(owner)) - np.repeat((ends[row:last] - ends[row]) // 3, sections)
                place = section.astype(np.uint64) + (columns["band"][owner].astype(np.uint64) << np.uint64(32))
                for pair, (x, y) in enumerate(PIECES):
                    a, b, c, d = _KEY_VALUE[pair]
                    key = mixed(mixed(word[:, x] * a + mixed(word[:, y] * b)) + mixed(place * c) * d)
                    out = [key.view(np.int64), (3 * section + pair).astype(np.int32), *(columns[k][owner] for k in ("band", "id", "n"))]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], ["key", "slot", "band", "id", "n"])
                row = last

    return sketches.select("id", "n", "band", "sketch").mapInArrow(spread, "key long, slot int, band int, id long, n long")


def _passes(n_a: np.ndarray, n_b: np.ndarray, differ: np.ndarray, percent: int) -> np.ndarray:
    """Whether sketches that differ in ``differ`` bits leave a link possible."""
    close = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    return close & ((100 + percent) * differ <= (100 - percent) * (n_a + n_b))


def plausible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The ``pairs(a, b, band)`` that their sketches do not rule out, as distinct ``a, b``."""
    side = {
        x: sketches.select("band", F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}")) for x in "ab"
    }
    both = pairs.join(side["a"], ["a", "band"]).join(side["b"], ["b", "band"]).select("a", "b", "n_a", "n_b", "s_a", "s_b")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            (x, ends), (y, _) = _words_of(batch["s_a"]), _words_of(batch["s_b"])
            differ = np.add.reduceat(np.bitwise_count(x ^ y).astype(np.int64), ends[:-1])
            keep = _passes(batch["n_a"].to_numpy(), batch["n_b"].to_numpy(), differ, percent)
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(keep))

    return both.mapInArrow(judge, "a long, b long").distinct()


def _mixed(rows: DataFrame) -> DataFrame:
    """Buckets whose members lie in several components, with their number of members."""
    counted = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("component").alias("low"), F.max("component").alias("high"))
    return counted.filter("low <> high").select("key", "size")


def _cells(rows: DataFrame, percent: int) -> DataFrame:
    """``key, i, j, own, slot, band, id, n, component`` of the mixed buckets: blocks of members in pairs."""
    section = F.element_at(F.array(*[F.lit(3 * (tolerance(b, percent) // 2 + 1)) for b in range(len(EDGES) - 1)]), F.col("band") + 1)
    placed = rows.join(_mixed(rows), "key")
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("size") * section / BLOCK_WORDS)).cast("int")
    placed = placed.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return spread.select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "slot", "band", "id", "n", "component"
    )


def compare_cell(cell: dict[str, np.ndarray], words_of: np.ndarray, percent: int, every: bool) -> list[tuple[int, int]]:
    """Sketch links across components of a cell: a set that joins them, or ``every`` one.

    A pair is looked at in the first slot in which its two sketches share a key.
    """
    ids, own, n, slot = cell["id"], cell["own"], cell["n"], int(cell["slot"][0])
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
        differ = np.bitwise_count(words_of[pick] ^ words_of[row]).sum(axis=1, dtype=np.int64)
        pick = pick[_passes(n[row], n[pick], differ, percent)]
        if not len(pick):
            continue
        equal = (words_of[pick] == words_of[row]).reshape(len(pick), -1, 3)
        shared = np.stack([equal[:, :, x] & equal[:, :, y] for x, y in PIECES], axis=2).reshape(len(pick), -1)
        for other in pick[shared.argmax(axis=1) == slot]:
            if every or component[other] != component[row]:
                out.append((int(min(ids[row], ids[other])), int(max(ids[row], ids[other]))))
                if not every:
                    component[component == component[other]] = component[row]
    return out


def _compared(cells: DataFrame, sketches: DataFrame, percent: int, every: bool) -> DataFrame:
    """``key, i, j, a, b``: the sketch links that the cells send out."""
    fields = ("own", "slot", "id", "n", "component")
    laid = cells.join(sketches.select("id", "band", "sketch"), ["id", "band"]).select(*CELL, *fields, "sketch")
    laid = laid.repartition(*CELL).sortWithinPartitions(*CELL, "id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in groups(batches, CELL):
            flat, _ = _words_of(cell["sketch"])
            values = {k: cell[k].to_numpy() for k in (*CELL, *fields)}
            found = compare_cell(values, flat.reshape(len(cell), -1), percent, every) if len(cell) > 1 else []
            pairs = np.array(found, dtype=np.int64).reshape(-1, 2)
            where = [np.full(len(pairs), values[k][0]) for k in CELL]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*where, *pairs.T)], [*CELL, "a", "b"])

    return laid.mapInArrow(compare, "key long, i int, j int, a long, b long")


def _placed(crowd: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return crowd.withColumn("component", F.col("id"))
    known = labels.select(F.col("node").alias("id"), "component")
    return crowd.join(known, "id", "left").withColumn("component", F.coalesce("component", "id"))


def parity_components(sketches: DataFrame, sets_of, percent: int) -> DataFrame:
    """``(node, component)`` of all linked rows of a written table ``sketches(id, n, band, sketch)``.

    ``sets_of(ids)`` returns ``(id, members)``, the full sets as sorted 64-bit hashes.
    """
    keys = key_rows(sketches)
    shared = written(keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("key"), "parity_keys")
    crowd = written(keys.join(shared, "key"), "parity_crowd")
    sets = written(sets_of(crowd.select("id").distinct()), "parity_sets")
    links, labels = None, None

    def add(found: DataFrame) -> None:
        nonlocal links, labels
        links = found if links is None else links.unionByName(found)
        labels = components(links)

    for turn in range(STARS):
        rows = written(_placed(crowd, labels), "parity_rows") if turn else _placed(crowd, None)
        if turn and _mixed(rows).isEmpty():
            return labels
        order = F.col("id") if not turn else F.xxhash64("id", F.lit(turn))
        hubs = rows.groupBy("key").agg(F.min_by(F.struct(F.col("id").alias("hub"), F.col("component").alias("of")), order).alias("h"))
        stars = rows.join(hubs.select("key", "h.*"), "key").filter("component <> of")
        stars = stars.select(F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b"), "band").distinct()
        add(written(confirmed(plausible(stars, sketches, percent), sets, percent), "parity_links"))

    rows = written(_placed(crowd, labels), "parity_rows")
    if _mixed(rows).isEmpty():
        return labels
    cells = written(_cells(rows, percent), "parity_cells")
    sent = written(_compared(cells, sketches, percent, every=False), "parity_sent")
    found = written(confirmed(sent.select("a", "b").distinct(), sets, percent), "parity_links")
    refused = written(sent.join(found, ["a", "b"], "left_anti").select(*CELL).distinct(), "parity_refused")
    add(found)
    if not refused.isEmpty():
        # components may hang together in these cells by other pairs than the ones sent
        again = _placed(cells.drop("component").join(refused, list(CELL), "left_semi"), labels)
        every = written(_compared(again, sketches, percent, every=True).select("a", "b").distinct(), "parity_sent")
        add(written(confirmed(every, sets, percent), "parity_links"))
    return labels


def jaccard_components(documents: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``documents(doc_id, text, …)``.

    Documents whose sets of ``width``-word shingles have ``100 * intersection >= percent * union``
    are linked; ``component_id`` is the smallest doc_id reachable by links, itself included.

    A text without words (null, empty, only spaces) has an empty set and is linked with
    nothing. A text of fewer words is one shingle. Texts of any length are taken whole. Repeated
    rows are linked like copies; rows that share a doc_id but not the text go each by its own text. A row
    without doc_id is linked with nothing and has a null ``component_id``. Other columns are
    ignored; an empty table gives an empty result.
    """
    ship_package(documents.sparkSession)
    rows = written(_sketched(documents, width, percent), "parity_sketches")
    # equal sets need no search: one representative each
    sets = rows.filter("n > 0 and doc_id is not null").groupBy("fa", "fb").agg(
        F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first(F.struct("bands", "sketches")).alias("made")
    )
    sets = written(sets.select(F.monotonically_increasing_id().alias("id"), "fa", "fb", "doc_id", "n", "made.*"), "parity_sets")
    names = sets.select("id", "fa", "fb", "doc_id")
    each = sets.select("id", "n", F.inline(F.arrays_zip(F.col("bands").alias("band"), F.col("sketches").alias("sketch"))))
    labels = parity_components(
        written(each.toDF("id", "n", "band", "sketch"), "parity_bands"), lambda ids: _full_sets(documents, names.join(ids, "id"), width), percent
    )
    placed = names.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    smallest = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    found = placed.join(smallest, "component").select("fa", "fb", "component_id")
    alone = F.col("n").eqNullSafe(0) | F.col("doc_id").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    out = rows.select("doc_id", "n", "fa", "fb").join(found, ["fa", "fb"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
