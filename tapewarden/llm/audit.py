"""How text filters interact: what each one removes, alone and after others, in every order.

A byte transducer, driven by a table of (state, byte) to (next state, actions), reads
a text once. Its actions count code points, capitals and symbols, open and close
words, and feed the closed words' spans into a hash table that compares bytes
whenever two hashes agree. A text is read in stretches of bounded size: the state and
an open word are carried on, so the longest text takes no more memory than its
distinct words.

A document is then five bits, one for each filter it fails. All 120 orders follow from the
counts of those bit patterns per part; what comes before a filter is one of 16 sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewarden.llm.scratch import written
from tapewarden.llm.words import mixed, powers
from tapewarden.session import ship_package

#: Bytes that the transducer reads at a time.
STRETCH = 1 << 18
#: Words up to this many bytes are compared eight bytes at a time, for all words at once.
SHORT = 64

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT = 200, 50, 2

OUTSIDE, INSIDE = 0, 1
OPEN, CLOSE, POINT, CAPITAL, SYMBOL = 1, 2, 4, 8, 16


def transducer() -> tuple[np.ndarray, np.ndarray]:
    """``next_state[state, byte]`` and ``actions[state, byte]`` for UTF-8 text."""
    byte = np.arange(256)
    space = np.isin(byte, [9, 10, 11, 12, 13, 32])
    seen = np.where((byte & 0xC0) != 0x80, POINT, 0)
    seen |= np.where((byte >= ord("A")) & (byte <= ord("Z")), CAPITAL, 0)
    seen |= np.where(np.isin(byte, list(b"#$%&*|")), SYMBOL, 0)
    following = np.where(space, OUTSIDE, INSIDE)
    return (
        np.stack([following, following]).astype(np.uint8),
        np.stack([seen | np.where(space, 0, OPEN), seen | np.where(space, CLOSE, 0)]).astype(np.uint8),
    )


_NEXT, _ACTIONS = transducer()
_rng = np.random.Generator(np.random.PCG64(1789))
_BYTE_VALUE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_STEP = np.uint64(0xD1B54A32D192ED03)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
_ALL = (1 << 64) - 1


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether ``data[a:a + length]`` equals ``data[b:b + length]``, for each position; ``data`` has 8 spare bytes at its end."""
    equal = np.ones(len(a), dtype=bool)
    eights = np.ndarray(max(len(data) - 7, 0), dtype="<u8", buffer=data, strides=(1,))
    rows = np.flatnonzero(length <= SHORT)
    for start in range(0, SHORT, 8):
        rows = rows[length[rows] > start]
        if not len(rows):
            break
        differ = eights[a[rows] + start] ^ eights[b[rows] + start]
        left = np.minimum(length[rows] - start, 8).astype(np.uint64)
        kept = ~np.uint64(0) >> (np.uint64(64) - left * np.uint64(8))
        bad = (differ & kept) != 0
        equal[rows[bad]] = False
        rows = rows[~bad]
    for row in np.flatnonzero(length > SHORT):
        equal[row] = np.array_equal(data[a[row] : a[row] + length[row]], data[b[row] : b[row] + length[row]])
    return equal


class SpanTable:
    """An open-addressing hash table of byte spans, filled many spans at a time; equal hashes are verified byte by byte."""

    def __init__(self, data: np.ndarray, room: int = 1024) -> None:
        self.data = data
        self.spans = np.zeros((4, 0), dtype=np.int64)  # owner, hash, start, length of every span kept
        self.slots = np.full(1 << max(room * 2 - 1, 1).bit_length(), -1, dtype=np.int64)

    def _settle(self, home: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        """Claim free slots for ``chosen`` spans; returns which of them got theirs (the smallest, where several meet)."""
        free = self.slots[home] < 0
        claim = np.flatnonzero(free)[::-1]
        self.slots[home[claim]] = chosen[claim]
        return free & (self.slots[home] == chosen)

    def _place(self, first: int) -> np.ndarray:
        """Put the spans from ``first`` on into slots; True for each that no earlier span equals."""
        owner, hashes, start, length = self.spans
        fresh = np.ones(self.spans.shape[1] - first, dtype=bool)
        todo = np.arange(first, self.spans.shape[1])
        mask = len(self.slots) - 1
        home = (hashes[todo] ^ owner[todo] * 0x9E3779B1) & mask
        while len(todo):
            self._settle(home, todo)
            held = self.slots[home]
            mine = held == todo
            like = ~mine & (hashes[held] == hashes[todo]) & (owner[held] == owner[todo]) & (length[held] == length[todo])
            rows = np.flatnonzero(like)
            like[rows] = same_bytes(self.data, start[held[rows]], start[todo[rows]], length[todo[rows]])
            fresh[todo[like] - first] = False
            on = ~mine & ~like
            todo, home = todo[on], (home[on] + 1) & mask
        return fresh

    def insert(self, owner: np.ndarray, hashes: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Add spans in order of ``start``; True for each that is the first of its owner and bytes."""
        first = self.spans.shape[1]
        self.spans = np.concatenate([self.spans, np.stack([owner, hashes, start, length])], axis=1)
        if 2 * self.spans.shape[1] > len(self.slots):
            self.slots = np.full(1 << (4 * self.spans.shape[1] - 1).bit_length(), -1, dtype=np.int64)
            self._place_known(first)
        fresh = self._place(first)
        # only distinct spans stay: renumber what has been added
        kept = np.flatnonzero(fresh)
        number = np.full(len(fresh), -1, dtype=np.int64)
        number[kept] = first + np.arange(len(kept))
        moved = self.slots >= first
        self.slots[moved] = number[self.slots[moved] - first]
        self.spans = np.concatenate([self.spans[:, :first], self.spans[:, first:][:, kept]], axis=1)
        return fresh

    def _place_known(self, count: int) -> None:
        """Spans already told apart go into the new slots without being compared."""
        owner, hashes = self.spans[0, :count], self.spans[1, :count]
        todo, mask = np.arange(count), len(self.slots) - 1
        home = (hashes ^ owner * 0x9E3779B1) & mask
        while len(todo):
            self._settle(home, todo)
            on = self.slots[home] != todo
            todo, home = todo[on], (home[on] + 1) & mask


def measures(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Words, distinct words, capitals, code points and symbols (a column each) of the texts ``data[bounds[i]:bounds[i + 1]]``.

    ``data`` has 8 spare bytes behind the last text.
    """
    texts = len(bounds) - 1
    out = np.zeros((texts, 5), dtype=np.int64)
    at, end = int(bounds[0]), int(bounds[-1])
    back_powers, step_powers = powers(_BACK, STRETCH + 1), powers(_STEP, STRETCH + 1)
    table, state = None, OUTSIDE
    opened, partial, seen = 0, 0, 0  # of the open word: its start, the hash of its bytes so far and their number
    while at < end:
        row = int(np.searchsorted(bounds, at, side="right")) - 1
        stop = min(end, at + STRETCH)
        if bounds[row + 1] < stop:  # whole texts where they fit
            stop = int(bounds[np.searchsorted(bounds, stop, side="right") - 1])
        part = data[at:stop]
        heads = bounds[np.searchsorted(bounds, at) : np.searchsorted(bounds, stop)] - at
        if at == bounds[row]:
            table, state, seen = SpanTable(data, STRETCH // 16), OUTSIDE, 0
        before = np.empty(len(part), dtype=np.uint8)
        before[1:] = _NEXT[0, part[:-1]]  # the state depends on the last byte alone
        before[heads] = OUTSIDE
        if not len(heads) or heads[0]:
            before[0] = state
        done = _ACTIONS[before, part]
        state = int(_NEXT[0, part[-1]])
        first, last = row, int(np.searchsorted(bounds, stop, side="left")) - 1
        cuts = np.maximum(bounds[first : last + 1] - at, 0)
        for column, action in ((2, CAPITAL), (3, POINT), (4, SYMBOL)):
            total = np.concatenate([[0], np.cumsum((done & action) != 0)])
            out[first : last + 1, column] += np.diff(np.append(total[cuts], total[-1]))
        # spans: from an opening to the next closing, or to the end of the text
        starts = np.flatnonzero(done & OPEN)
        closes = np.flatnonzero(done & CLOSE)
        ended = np.append(cuts[1:], len(part))[np.diff(np.append(cuts, len(part))) > 0]
        text_ends = ended if stop == bounds[last + 1] else ended[:-1]
        closes = np.unique(np.concatenate([closes, text_ends[_NEXT[0, part[text_ends - 1]] == INSIDE]]))
        values = _BYTE_VALUE[part] * step_powers[: len(part)]
        values[_NEXT[0, part] == OUTSIDE] = 0
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])
        if seen and len(closes):
            hashed = (partial + pow(int(_STEP), seen, 1 << 64) * int(sums[closes[0]])) & _ALL
            head = (opened, hashed, seen + int(closes[0]))
        elif seen:
            partial = (partial + pow(int(_STEP), seen, 1 << 64) * int(sums[-1])) & _ALL
            seen += len(part)
        whole = closes[1:] if seen and len(closes) else closes
        begun = starts[: len(whole)]
        hashes = (sums[whole] - sums[begun]) * back_powers[begun]
        begin, length = begun + at, whole - begun
        if seen and len(closes):
            begin, length = np.append(head[0], begin), np.append(head[2], length)
            hashes = np.append(np.uint64(head[1]), hashes)
            seen = 0
        if len(starts) > len(whole):  # the last word goes on in the next stretch
            opened, seen = int(starts[-1]) + at, len(part) - int(starts[-1])
            partial = (int(sums[-1]) - int(sums[starts[-1]])) * int(back_powers[starts[-1]]) & _ALL
        if len(begin):
            owner = np.searchsorted(bounds, begin, side="right") - 1
            fresh = table.insert(owner, mixed(hashes).view(np.int64), begin, length)
            out[:, 0] += np.bincount(owner, minlength=texts)
            out[:, 1] += np.bincount(owner[fresh], minlength=texts)
        at = stop
    return out


def measured_documents(documents: DataFrame) -> DataFrame:
    """``doc_id, part, digest, n_words, n_distinct, n_capitals, n_points, n_symbols`` of every row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch["text"]
            bounds = np.frombuffer(column.buffers()[1], dtype=np.int32, count=column.offset + len(column) + 1)
            bounds = bounds[column.offset :].astype(np.int64)
            b = 0
            while b < len(column):  # rows of bounded bytes, or one long text
                a = b
                b = max(a + 1, min(a + 1024, int(np.searchsorted(bounds, bounds[a] + 4 * STRETCH, side="right")) - 1, len(column)))
                low, high = int(bounds[a]), int(bounds[b])
                body = column.buffers()[2]
                whole = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, np.uint8)
                data = np.concatenate([whole[low:high], np.zeros(8, np.uint8)])
                counts = measures(data, bounds[a : b + 1] - low)
                digests = [hashlib.sha256(data[i:j]).digest() for i, j in zip(bounds[a:b] - low, bounds[a + 1 : b + 1] - low, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(a, b - a), batch["part"].slice(a, b - a), pa.array(digests, pa.binary()), *(pa.array(c) for c in counts.T)],
                    ["doc_id", "part", "digest", "n_words", "n_distinct", "n_capitals", "n_points", "n_symbols"],
                )

    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    kind = "doc_id long, part string, digest binary, n_words long, n_distinct long, n_capitals long, n_points long, n_symbols long"
    return rows.mapInArrow(read, kind)


def failed_filters(documents: DataFrame) -> DataFrame:
    """``doc_id, part, failed`` of every row; bit k of ``failed`` is set where filter k of :data:`FILTERS` fails."""
    rows = written(measured_documents(documents), "measured")
    fails = (
        F.col("n_words") < MIN_WORDS,
        100 * F.col("n_distinct") < MIN_DISTINCT_PERCENT * F.col("n_words"),
        100 * F.col("n_capitals") > MAX_CAPITAL_PERCENT * F.col("n_points"),
        F.col("n_symbols") > 0,
    )
    own = sum((F.when(fail, 1 << k).otherwise(0) for k, fail in enumerate(fails)), F.lit(0))
    rows = rows.select("doc_id", "part", "digest", own.alias("own"))
    # a hot text is aggregated before the shuffle, and its rows are joined by doc_id as well, so they spread
    first = rows.filter("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    told = rows.filter("doc_id is not null").join(first, ["digest", "doc_id"], "left")
    told = told.select("doc_id", "part", (F.col("own") + F.when(F.col("first"), 0).otherwise(1 << 4)).alias("failed"))
    return told.unionByName(rows.filter("doc_id is null").select("doc_id", "part", F.col("own").alias("failed")))


def filter_interactions(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """What each step of each order of five filters does to every part (source) of ``documents(doc_id, source, text, …)``.

    A: under 200 words. B: less than half of the words distinct. C: over 2 % capitals.
    D: one of ``#$%&*|``. E: same text as a smaller doc_id, in any part. One row per
    ``part, filter_order, step`` with counts of documents: ``kept`` after the step,
    ``removed`` by it, ``redundant`` (fails this filter, removed earlier),
    ``unique_fails`` (fails this filter only), ``good_lost`` and ``toxic_lost`` (removed
    here and labelled so), ``shapley`` (what this filter removes, summed over all orders).

    A null text is empty, a null source the part ``''``. Repeated rows count each; a
    repeated doc_id with the same text is no copy of itself. A row without doc_id never
    fails E, makes no other row fail it, and has no label. Several labels of a doc_id: any
    1 counts. Texts of any length are read whole. Other columns, also such that are named like
    a result, are ignored. An empty table has no parts and gives no rows.
    """
    ship_package(documents.sparkSession)
    # read twice below
    told = written(failed_filters(documents), "told")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").filter("doc_id is not null")
    known = known.groupBy("doc_id").agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"),
        F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"),
    )
    counts = [F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")]
    # rows without doc_id would all meet in one task of the join
    marked = told.filter("doc_id is not null").join(known, "doc_id", "left").fillna(0, ["good", "toxic"])
    nameless = told.filter("doc_id is null").withColumns({"good": F.lit(0), "toxic": F.lit(0)})
    patterns = marked.unionByName(nameless).groupBy("part", "failed").agg(*counts)

    # every filter behind every set of others: 80 lines
    letters = range(len(FILTERS))
    lines = [(before, bit) for bit in letters for before in range(1 << len(FILTERS)) if not before >> bit & 1]
    literal = F.array(*[F.struct(F.lit(before).alias("before"), F.lit(bit).alias("bit"), F.lit(1 << bit).alias("own")) for before, bit in lines])
    this, earlier = (F.col("failed").bitwiseAND(F.col(c)) != 0 for c in ("own", "before"))
    total = lambda condition, column: F.sum(F.when(condition, F.col(column)).otherwise(0))
    spread = patterns.withColumn("line", F.explode(literal)).select("*", "line.*")
    sums = spread.groupBy("part", "before", "bit").agg(
        total(~this & ~earlier, "n").alias("kept"),
        total(this & ~earlier, "n").alias("removed"),
        total(this & earlier, "n").alias("redundant"),
        total(this & (F.bit_count("failed") == 1), "n").alias("unique_fails"),
        total(this & ~earlier, "good").alias("good_lost"),
        total(this & ~earlier, "toxic").alias("toxic_lost"),
    )
    size = F.bit_count("before")
    orders_with = F.element_at(F.array(*[F.lit(math.factorial(k) * math.factorial(4 - k)) for k in range(5)]), size + 1)
    # 16 rows per part and filter
    whole = F.sum(F.col("removed") * orders_with).over(Window.partitionBy("part", "bit"))
    sums = sums.withColumn("shapley", whole)
    steps = []
    for order in permutations(letters):
        before = 0
        for step, bit in enumerate(order, 1):
            steps.append(("".join(FILTERS[k] for k in order), step, before, bit))
            before |= 1 << bit
    plan = documents.sparkSession.createDataFrame(steps, "filter_order string, step int, before int, bit int")
    return sums.join(F.broadcast(plan), ["before", "bit"]).select(  # 600 rows
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )
