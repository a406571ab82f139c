"""Repeated 400-byte strings by depth-limited most-significant-digit passes.

Positions are sorted only as deep as the threshold and only as far as needed to
tell which share all its bytes: every pass looks at another digit of the string
that starts at a position, and a position alone in its group drops out.

* *First digit*: the smallest hash of a ``GRAM``-byte gram inside the string.
  Neighbouring positions share it, so one row stands for a *run* of positions
  with the same smallest gram (about one row per 170 bytes). Equal strings have
  their smallest grams at the same distance, so strings of different groups differ.
* *Whole run*: inside a group, runs whose bytes agree from the first string's start
  to the last one's end settle all their positions at once.
* *Core*: what is left is cut into *steps* of ``STEP`` neighbouring positions at fixed
  distances from the gram. The bytes common to all strings of a step are the next
  digit; a step whose core occurs once holds no repeated string.
* *Full depth*: the strings of the remaining steps are compared by 64-bit hashes of
  all 400 bytes; equal groups are exactly the repeated strings.

Rows are aggregated per group (partial aggregates first), then joined back; no
group is ever gathered. Hot groups are joins, which adaptive execution splits.

A passage of 50 words is often shorter than 400 bytes. Passages that another row has as
well are found by the same first and last digit, over words: the smallest gram of a
window of words, and where that is shared by rows, a hash of the whole window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewarden.llm.scratch import written
from tapewarden.llm.words import mixed, powers, text_rounds, words
from tapewarden.session import ship_package

LENGTH, GRAM, STEP = 400, 32, 32
#: Words of a passage, and of the grams inside it.
PASSAGE, WORD_GRAM = 50, 8

_rng = np.random.Generator(np.random.PCG64(41))
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = np.uint64(0xD1342543DE82EF95 & ~7 | 3)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PLACE_BITS = 24
#: Longer texts are cut into overlapping stretches, so that a place fits its bits and memory stays bounded.
STRETCH = 1 << 21


class _Hashes:
    """Hashes of any stretch of an array of numbers, from prefix sums."""

    def __init__(self, values: np.ndarray) -> None:
        n = len(values)
        self.back = powers(_INVERSE, n + 1)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values * powers(_BASE, n), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def _smallest_gram(hashes: _Hashes, n: int, length: int, size: int = GRAM) -> np.ndarray:
    """For each start of a string of ``length`` the place of its smallest gram of ``size``, the first of equal ones."""
    starts = np.arange(n - size + 1)
    gram = mixed((hashes.sums[size:] - hashes.sums[: n - size + 1]) * hashes.back[: n - size + 1])
    rank = (gram >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | starts.astype(np.uint64)
    width = length - size + 1
    # sliding minimum: the larger of two blockwise running minima, one from either side
    blocks = -(-len(rank) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(rank)] = rank
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - length + 1
    least = np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])
    return (least & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)


def _stretches(data: np.ndarray, bounds: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, offset in it, bytes, bounds)``: rounds of whole rows, or pieces of a long one that overlap."""
    if len(data) <= STRETCH:
        yield 0, 0, data, bounds
        return
    for row, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        for at in range(a, max(b - length + 1, a + 1), STRETCH):
            end = min(at + STRETCH + length - 1, b)
            yield row, at - a, data[at:end], np.array([0, end - at])


def _runs_of(data: np.ndarray, bounds: np.ndarray, length: int) -> dict[str, np.ndarray] | None:
    """The runs of some rows, equal runs of a row once with all their starts; None if no row holds a string."""
    n = len(data)
    if n < length:
        return None
    hashes = _Hashes(_BYTE[data])
    anchors = _smallest_gram(hashes, n, length)
    row = np.searchsorted(bounds, np.arange(len(anchors)), side="right") - 1
    inside = np.arange(len(anchors)) + length <= bounds[row + 1]
    cut = np.ones(len(anchors), dtype=bool)
    cut[1:] = (anchors[1:] != anchors[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(cut & inside)
    if not len(head):
        return None
    # a run ends where the next begins or its row holds no more strings
    turns = np.flatnonzero(cut)
    following = np.append(turns, len(anchors))[np.searchsorted(turns, head) + 1]
    row = row[head]
    count = np.minimum(following, bounds[row + 1] - length + 1) - head
    anchor = anchors[head]
    whole = hashes.of(head, head + count - 1 + length) + mixed((anchor - head).astype(np.uint64))
    gram = hashes.of(anchor, anchor + GRAM)
    order = np.lexsort((head, whole, gram, row))
    row, head, count, anchor, whole, gram = (x[order] for x in (row, head, count, anchor, whole, gram))
    fresh = np.ones(len(row), dtype=bool)
    fresh[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1]) | (whole[1:] != whole[:-1])
    first = np.flatnonzero(fresh)
    place = anchor[first] - head[first]
    low, high = (place - count[first] + 1) // STEP, place // STEP
    steps = high - low + 1
    of_run = np.repeat(np.arange(len(first)), steps)
    step = np.arange(len(of_run)) - np.repeat(np.cumsum(steps) - steps, steps) + low[of_run]
    # strings of step s begin between s * STEP and s * STEP + STEP - 1 bytes before the gram;
    # common to them are the bytes from the latest beginning to the earliest end
    latest = anchor[first][of_run] - step * STEP
    core = hashes.of(latest, latest - STEP + 1 + length)
    return {
        "row": row[first], "gram": gram[first], "whole": whole[first], "count": count[first], "place": place,
        "starts": head - bounds[row], "start_offsets": np.append(first, len(row)),
        "cores": (core & np.uint64(0x7FFFFFFF)).astype(np.int32), "core_offsets": np.append(0, np.cumsum(steps)),
    }


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64).view(np.int64))


def _ints(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.int32)))


#: ``version`` tells texts with the same doc_id apart; a missing doc_id must not break joins.
KEY = ("doc", "version")


def _keyed(documents: DataFrame) -> DataFrame:
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long")).alias("doc")
    return documents.select(doc, F.xxhash64("text").alias("version"), F.col("text").cast("string").alias("text"))


def position_runs(texts: DataFrame, length: int) -> DataFrame:
    """``doc, version, gram, whole, count, place, starts, cores`` of ``texts(doc, version, text)``."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in text_rounds(batch["text"]):
                for first, offset, data, bounds in _stretches(rows.data, rows.bounds, length):
                    runs = _runs_of(data, bounds, length)
                    if runs is None:
                        continue
                    owner = pa.array(runs["row"] + rows.first + first)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch["doc"].take(owner), batch["version"].take(owner), _long(runs["gram"]), _long(runs["whole"]),
                            pa.array(runs["count"].astype(np.int32)), pa.array(runs["place"].astype(np.int32)),
                            _ints(runs["starts"] + offset, runs["start_offsets"]), _ints(runs["cores"], runs["core_offsets"]),
                        ],
                        ["doc", "version", "gram", "whole", "count", "place", "starts", "cores"],
                    )

    kind = "doc long, version long, gram long, whole long, count int, place int, starts array<int>, cores array<int>"
    return texts.mapInArrow(find, kind)


def _full_depth(texts: DataFrame, length: int) -> DataFrame:
    """``doc, version, start, settled, gram, string``: hashes of all strings of the steps listed with each text.

    ``texts`` carries ``steps``, structs of (place of the gram in the text, gram, first and last start, settled).
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            steps = batch["steps"]
            for rows in text_rounds(batch["text"]):
                for k in range(len(rows.bounds) - 1):
                    i = rows.first + k
                    listed = steps[i].as_py()
                    low, high = (np.array([s[x] for s in listed], dtype=np.int64) for x in ("low", "high"))
                    gram, settled = np.array([s["gram"] for s in listed], dtype=np.int64), np.array([s["settled"] for s in listed])
                    count = high - low + 1
                    of_step = np.repeat(np.arange(len(low)), count)
                    start = np.arange(len(of_step)) - np.repeat(np.cumsum(count) - count, count) + low[of_step]
                    string = _Hashes(_BYTE[rows.data[rows.bounds[k] : rows.bounds[k + 1]]]).of(start, start + length)
                    owner = pa.array(np.full(len(start), i))
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch["doc"].take(owner), batch["version"].take(owner), pa.array(start.astype(np.int32)),
                            pa.array(settled[of_step]), pa.array(gram[of_step]), _long(string),
                        ],
                        ["doc", "version", "start", "settled", "gram", "string"],
                    )

    kind = "doc long, version long, start int, settled boolean, gram long, string long"
    return texts.select("doc", "version", "text", "steps").mapInArrow(find, kind)


def repeated_starts(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc, version, start, count``: starts of ``length``-byte strings that also start anywhere else, as stretches."""
    texts = _keyed(documents)
    runs = written(position_runs(texts, length), "runs")
    # first digit
    grams = runs.groupBy("gram").agg(F.sum(F.size("starts")).alias("n"), F.min("whole").alias("low"), F.max("whole").alias("high"))
    shared = grams.filter("n > 1").select("gram", (F.col("low") != F.col("high")).alias("contested"))
    runs = written(runs.join(shared, "gram"), "shared_runs")
    # whole runs; the first of each class speaks for it
    speaker = F.min(F.struct(*KEY, F.col("starts")[0].alias("start"), "count", "place", "cores")).alias("run")
    classes = runs.groupBy("gram", "whole").agg(
        F.sum(F.size("starts")).alias("n"), F.first("contested").alias("contested"), speaker
    )
    classes = written(classes.withColumn("settled", F.col("n") > 1).drop("n"), "classes")
    settled = runs.join(classes.filter("settled").select("gram", "whole"), ["gram", "whole"])
    settled = settled.select(*KEY, F.explode("starts").alias("start"), "count")
    # cores
    low_step = F.floor((F.col("run.place") - F.col("run.count") + 1) / STEP).cast("int")
    cores = classes.filter("contested").select(
        "gram", "settled", "run.doc", "run.version", "run.start", "run.count", "run.place",
        low_step.alias("low_step"), F.posexplode("run.cores").alias("nth", "core"),
    ).withColumn("step", F.col("low_step") + F.col("nth"))
    twice = cores.groupBy("gram", "step", "core").agg(
        F.count(F.lit(1)).alias("n"), F.min("settled").alias("all_settled")
    ).filter("n > 1 and not all_settled").select("gram", "step", "core")
    anchor = F.col("start") + F.col("place")
    low = F.greatest("start", anchor - F.col("step") * STEP - STEP + 1)
    high = F.least(F.col("start") + F.col("count") - 1, anchor - F.col("step") * STEP)
    steps = cores.join(twice, ["gram", "step", "core"]).select(
        *KEY, F.struct(low.alias("low"), high.alias("high"), "gram", "settled").alias("step")
    )
    steps = written(steps.groupBy(*KEY).agg(F.collect_list("step").alias("steps")), "steps")
    # full depth; equal rows have the same strings, so one of them is read
    suspects = texts.join(steps, list(KEY)).dropDuplicates(list(KEY))
    strings = written(_full_depth(suspects, length), "strings")
    equal = strings.groupBy("gram", "string").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram", "string")
    deep = strings.filter("not settled").join(equal, ["gram", "string"]).select(*KEY, "start", F.lit(1).alias("count"))
    return settled.unionByName(deep)


def _word_runs(batch: pa.RecordBatch, length: int) -> Iterator[tuple[_Hashes, dict[str, np.ndarray]]]:
    """Runs of windows of ``length`` words with the same smallest gram, and the hashes of the words they index from ``at``."""
    size = min(WORD_GRAM, length)
    for texts in text_rounds(batch["text"]):
        found = words(texts)
        for first, offset, value, bounds in _stretches(found.hashes, found.rows, length):
            n = len(value)
            if n < length:
                continue
            hashes = _Hashes(value)
            anchors = _smallest_gram(hashes, n, length, size)
            row = np.searchsorted(bounds, np.arange(len(anchors)), side="right") - 1
            inside = np.flatnonzero(np.arange(len(anchors)) + length <= bounds[row + 1])
            cut = np.ones(len(inside), dtype=bool)
            cut[1:] = (anchors[inside][1:] != anchors[inside][:-1]) | (row[inside][1:] != row[inside][:-1])
            turns = np.flatnonzero(cut)
            at, count = inside[turns], np.diff(np.append(turns, len(inside)))
            anchor, row = anchors[at], row[at]
            whole = hashes.of(at, at + count - 1 + length) + mixed((anchor - at).astype(np.uint64))
            yield hashes, {
                "row": row + first + texts.first, "at": at, "start": at - bounds[row] + offset, "count": count,
                "gram": hashes.of(anchor, anchor + size).view(np.int64), "whole": whole.view(np.int64),
            }


def shared_passages(documents: DataFrame, length: int = PASSAGE) -> DataFrame:
    """``doc, version, start, count``: windows of ``length`` words that another row has as well, as stretches of first words.

    Words are as in :mod:`tapewarden.llm.words`, A-Z lower-cased; what is between them does not matter.
    Runs that are equal in two rows settle all their windows; of each other class of runs whose gram is shared
    the windows of one run are hashed.
    """
    texts = _keyed(documents)
    tag = F.monotonically_increasing_id()  # rows may be equal, and a long text comes in stretches

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, runs in _word_runs(batch, length):
                owner = pa.array(runs["row"])
                yield pa.RecordBatch.from_arrays(
                    [*(batch[c].take(owner) for c in (*KEY, "tag")), pa.array(runs["gram"]), pa.array(runs["whole"]),
                     pa.array(runs["start"].astype(np.int32)), pa.array(runs["count"].astype(np.int32))],
                    [*KEY, "tag", "gram", "whole", "start", "count"],
                )

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = [{x["start"]: (x["low"], x["high"]) for x in asked.as_py()} for asked in batch["asked"]]
            for hashes, runs in _word_runs(batch, length):
                wanted = [listed[row].get(start) for row, start in zip(runs["row"].tolist(), runs["start"].tolist())]
                some = np.flatnonzero([w is not None for w in wanted])
                low, high = (np.array([wanted[k][side] for k in some], dtype=np.int64) for side in (0, 1))
                count = runs["count"][some]
                of_run = np.repeat(np.arange(len(some)), count)
                nth = np.arange(len(of_run)) - np.repeat(np.cumsum(count) - count, count)
                at = runs["at"][some][of_run] + nth
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (runs["gram"][some][of_run], runs["whole"][some][of_run], nth.astype(np.int32),
                                           hashes.of(at, at + length).view(np.int64), low[of_run], high[of_run])],
                    ["gram", "whole", "nth", "window", "low", "high"],
                )

    kind = "doc long, version long, tag long, gram long, whole long, start int, count int"
    runs = written(texts.withColumn("tag", tag).mapInArrow(find, kind), "word_runs")
    grams = runs.groupBy("gram").agg(
        (F.min("tag") != F.max("tag")).alias("shared"), (F.min("whole") != F.max("whole")).alias("contested")
    )
    runs = written(runs.join(grams.filter("shared").select("gram", "contested"), "gram"), "shared_word_runs")
    speaker = F.min(F.struct(*KEY, "start")).alias("run")
    classes = runs.groupBy("gram", "whole").agg(
        F.min("tag").alias("low"), F.max("tag").alias("high"), F.first("contested").alias("contested"), speaker
    )
    classes = written(classes.withColumn("settled", F.col("low") != F.col("high")), "word_classes")
    settled = runs.join(classes.filter("settled").select("gram", "whole"), ["gram", "whole"]).select(*KEY, "start", "count")
    open_grams = classes.filter("contested and not settled").select("gram").distinct()
    asked = classes.join(open_grams, "gram", "left_semi").select("run.doc", "run.version", F.struct("run.start", "low", "high").alias("asked"))
    asked = written(asked.groupBy(*KEY).agg(F.collect_list("asked").alias("asked")), "asked_runs")
    # equal rows have the same runs, so one of them is read
    suspects = texts.join(asked, list(KEY)).dropDuplicates(list(KEY)).select("text", "asked")
    kind = "gram long, whole long, nth int, window long, low long, high long"
    found = written(suspects.mapInArrow(windows, kind), "windows")
    equal = found.groupBy("window").agg(F.min("low").alias("least"), F.max("high").alias("most")).filter("least != most").select("window")
    deep = found.filter("low = high").join(equal, "window").select("gram", "whole", "nth")
    deep = runs.join(deep, ["gram", "whole"]).select(*KEY, (F.col("start") + F.col("nth")).alias("start"), F.lit(1).alias("count"))
    return settled.unionByName(deep)


def _covered(start: np.ndarray, count: np.ndarray, length: int) -> int:
    """Places covered by the strings of ``length`` that begin in these stretches."""
    order = np.argsort(start, kind="stable")
    start, end = start[order].astype(np.int64), (start + count - 1 + length)[order].astype(np.int64)
    reached = np.maximum.accumulate(end)
    return int((reached - np.maximum(start, np.append(start[0], reached[:-1])))[np.append(True, end[1:] > reached[:-1])].sum())


def remove_repeats(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept, n_passage_words`` of every row of ``documents(doc_id, text, …)``.

    A text is its UTF-8 bytes. Removed is each byte covered by a ``length``-byte string
    that also starts anywhere else, in this text or another, overlaps included; strings
    are judged on the input. ``n_spans`` counts the maximal removed stretches; ``kept``
    are the remaining bytes, which need not be valid UTF-8. ``n_passage_words`` counts the words
    covered by passages of ``PASSAGE`` words that another row has as well (:func:`shared_passages`); they need not be
    ``length`` bytes long, and nothing is removed for them.

    A null text is empty; texts shorter than ``length`` keep everything. A repeated row
    repeats all its strings, so it loses all its bytes. A row without doc_id is a text
    like others. Other columns are ignored; an empty table gives an empty result.
    """
    ship_package(documents.sparkSession)
    starts = repeated_starts(documents, length)
    spans = starts.groupBy(*KEY).agg(F.collect_list(F.struct("start", "count")).alias("spans"))
    spans = written(spans.select(*KEY, F.col("spans.start").alias("at"), F.col("spans.count").alias("count")), "spans")
    passages = shared_passages(documents).groupBy(*KEY).agg(F.collect_list(F.struct("start", "count")).alias("passages"))
    passages = written(passages.select(*KEY, F.col("passages.start").alias("first"), F.col("passages.count").alias("words")), "passages")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in text_rounds(batch["text"]):
                found = []
                for k in range(len(rows.bounds) - 1):
                    i = rows.first + k
                    data = rows.data[rows.bounds[k] : rows.bounds[k + 1]]
                    at, count, first, held = (batch[c][i] for c in ("at", "count", "first", "words"))
                    shared = _covered(np.asarray(first.values), np.asarray(held.values), PASSAGE) if first.is_valid else 0
                    if not at.is_valid:
                        kept = data.tobytes()
                        found.append((len(kept), 0, 0, hashlib.sha256(kept).hexdigest(), kept, shared))
                        continue
                    at, count = np.asarray(at.values, dtype=np.int64), np.asarray(count.values, dtype=np.int64)
                    depth = np.zeros(len(data) + 1, dtype=np.int64)
                    np.add.at(depth, at, 1)
                    np.add.at(depth, at + count - 1 + length, -1)
                    gone = np.cumsum(depth)[:-1] > 0
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    kept = data[~gone].tobytes()
                    found.append((len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept, shared))
                columns = list(zip(*found, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(rows.first, len(found)), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "n_passage_words"],
                )

    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long")).alias("doc")
    texts = documents.select(F.col("doc_id").cast("long"), doc, F.xxhash64("text").alias("version"), F.col("text").cast("string"))
    rows = texts.join(spans, list(KEY), "left").join(passages, list(KEY), "left").select("doc_id", "text", "at", "count", "first", "words")
    kind = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, n_passage_words long"
    return rows.mapInArrow(cut, kind)
