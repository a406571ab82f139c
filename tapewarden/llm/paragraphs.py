"""Near-duplicate paragraphs by MinHash banding.

Paragraphs (blocks between blank lines, or lines where a text has no blank ones) become
sets of five-word shingles and MinHash signatures; equal sets are one representative. The number of bands follows from the recall wanted at
the similarity threshold. Representatives that collide in a band are confirmed by
exact Jaccard similarity (:mod:`tapewarden.llm.links`), clusters are the connected
components, and of each cluster the first paragraph stays.

A passage pasted into longer lines is no paragraph of its own. For those the words of a document are cut at places
that their content decides, whatever the lines: of each window of 50 words the 20 words with the smallest hash are a
piece. Pieces meet in a MinHash band as paragraphs do, and what meets is checked on windows of 41 words around it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewarden.llm.links import link_components
from tapewarden.llm.repeats import _Hashes, _smallest_gram, _stretches
from tapewarden.llm.scratch import written
from tapewarden.llm.words import _IS_SPACE, _PLACE, Texts, flat_shingles, fingerprint, fingerprints, mixed, shingles, text_rounds, words
from tapewarden.session import ship_package

ROWS = 3
MARGIN = 5.5
#: Shingles of a paragraph that counts as a passage; shorter ones that repeat are mostly headings and boilerplate.
PASSAGE_SHINGLES = 10
#: Words of a passage that may lie anywhere in a text, of its pieces, and of the windows that confirm it.
PASSAGE, PIECE, WINDOW = 50, 20, 41
#: Words by which windows begin before their piece: any passage around a piece holds one of these windows whole.
REACH = (0, 10, 20, 21)
_rng = np.random.Generator(np.random.PCG64(2207))
_TIMES, _PLUS = (_rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


def bands_for(similarity: float, recall: float, rows: int = ROWS) -> int:
    """Bands of ``rows`` values so that a pair of this similarity collides with a chance of ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def paragraphs_of(texts: Texts) -> tuple[Texts, np.ndarray, np.ndarray]:
    """The paragraphs of a round of texts as rows of their own, the text each belongs to, and the number of its first line there.

    A text with a blank line between two others is cut at its blank lines, any other text at each line.
    """
    breaks = np.flatnonzero(texts.data == 10)
    starts = np.concatenate([texts.bounds[:-1], breaks + 1])
    owner = np.concatenate([np.arange(len(texts.bounds) - 1), np.searchsorted(texts.bounds, breaks, side="right") - 1])
    order = np.lexsort((owner, starts))
    starts, owner = starts[order], owner[order]
    first = np.searchsorted(owner, np.arange(len(texts.bounds) - 1))
    number = np.arange(len(owner)) - first[owner]
    signs = np.concatenate([[0], np.cumsum(~_IS_SPACE[texts.data])])
    full = np.diff(signs[np.append(starts, len(texts.data))]) > 0
    at = np.flatnonzero(full)
    in_blocks = np.zeros(len(texts.bounds) - 1, dtype=bool)
    in_blocks[owner[at[1:][(np.diff(at) > 1) & (owner[at[1:]] == owner[at[:-1]])]]] = True
    begins = ~in_blocks[owner] | (number == 0)
    begins[1:] |= full[1:] & ~full[:-1]
    return Texts(texts.first, texts.data, np.append(starts[begins], len(texts.data))), owner[begins], number[begins]


def signatures(element: np.ndarray, starts: np.ndarray, values: int) -> np.ndarray:
    """The low 16 bits of ``values`` MinHash minima of each (not empty) set; a set is what lies from its start to the next."""
    out = np.empty((len(starts), values), dtype="<u2")
    for k in range(values if len(starts) else 0):
        least = np.minimum.reduceat(element * _TIMES[k] + _PLUS[k], starts)
        out[:, k] = (mixed(least) & np.uint64(0xFFFF)).astype("<u2")
    return out


def agreement(n_a: np.ndarray, a: np.ndarray, n_b: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1)


def _sketched(documents: DataFrame, min_words: int, values: int) -> DataFrame:
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in text_rounds(batch["text"]):
                blocks, owner, number = paragraphs_of(texts)
                found = words(blocks)
                long = np.diff(found.rows) >= max(min_words, 1)
                every, bounds = flat_shingles(found)
                sizes = np.diff(bounds)
                element, n = every[np.repeat(long, sizes)], sizes[long]
                starts = np.cumsum(n) - n
                a, b = fingerprints(element, starts)
                sketches = signatures(element, starts, values)
                ends = pa.py_buffer(np.arange(len(n) + 1, dtype=np.int32) * np.int32(2 * values))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].take(pa.array(owner[long] + texts.first)), pa.array(number[long].astype(np.int32)),
                        pa.array(n), pa.array(a), pa.array(b), pa.Array.from_buffers(pa.binary(), len(n), [None, ends, pa.py_buffer(sketches)]),
                    ],
                    ["doc_id", "paragraph", "n", "fa", "fb", "sketch"],
                )

    kind = "doc_id long, paragraph int, n long, fa long, fb long, sketch binary"
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(sketch, kind)


def _full_sets(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(id, members)`` of wanted representatives ``(id, doc_id, paragraph, fa, fb)``, computed again from their texts."""
    lists = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("paragraph", "id", "fa", "fb")).alias("wanted"))
    texts = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(lists, "doc_id")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in text_rounds(batch["text"]):
                blocks, owner, number = paragraphs_of(texts)
                every = shingles(words(blocks))
                first = np.searchsorted(owner, np.arange(len(texts.bounds)))
                ids, members = [], []
                for k in range(len(texts.bounds) - 1):
                    for ask in batch["wanted"][texts.first + k].as_py():
                        at = first[k] + np.searchsorted(number[first[k] : first[k + 1]], ask["paragraph"])
                        # another row may carry the same doc_id
                        if at < first[k + 1] and number[at] == ask["paragraph"] and len(every[at]) and fingerprint(every[at]) == (ask["fa"], ask["fb"]):
                            ids.append(ask["id"])
                            members.append(every[at].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(members, pa.binary())], ["id", "members"])

    found = texts.select("text", "wanted").mapInArrow(build, "id long, members binary")
    return found.dropDuplicates(["id"])


def duplicate_paragraphs(documents: DataFrame, percent: int = 80, recall: float = 0.9999, min_words: int = 10) -> DataFrame:
    """Paragraphs that have a near duplicate: ``doc_id, paragraph, n_shingles, first_doc_id, first_paragraph, kept``.

    A text with a blank line between two others consists of the paragraphs that blank lines separate, any
    other text of its lines; a paragraph has the number of its first line, from 0. Two are linked if the intersection of their
    sets of five-word shingles is ``percent`` of the union or more; clusters are the connected
    components. A cluster is named by its first paragraph (smallest doc_id, then number), the only one
    kept. ``recall`` is the chance that a pair exactly at the threshold collides; more similar
    pairs collide nearly always.

    Paragraphs of fewer than ``min_words`` words are left alone and not returned; 1 searches all that have
    a word, those of one to four words as one shingle. Paragraphs without a word (empty texts and nulls
    have only such) and paragraphs without a partner are not returned. Rows of one doc_id and equal text have the
    same paragraphs, returned once. Rows without doc_id take no part. Other columns are ignored; an
    empty table gives an empty result.
    """
    ship_package(documents.sparkSession)
    bands = bands_for(percent / 100, recall)
    known = documents.filter("doc_id is not null")
    rows = written(_sketched(known, min_words, bands * ROWS), "paragraphs")
    sets = rows.groupBy("fa", "fb").agg(
        F.min(F.struct("doc_id", "paragraph")).alias("at"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.count(F.lit(1)).alias("copies")
    )
    sets = written(sets.withColumn("id", F.monotonically_increasing_id()), "representatives")
    width = 2 * ROWS
    keys = F.array(*[F.xxhash64(F.lit(b), F.substring("sketch", b * width + 1, width)) for b in range(bands)])
    names = sets.select("id", "fa", "fb", "at", "copies")
    threshold = percent / 100
    floor = threshold - MARGIN * math.sqrt(threshold * (1 - threshold) / (bands * ROWS))
    labels = link_components(
        sets.select("id", "n", "sketch", keys.alias("keys")),
        lambda ids: _full_sets(known, names.join(ids, "id").select("id", "at.doc_id", "at.paragraph", "fa", "fb")),
        agreement,
        floor,
        percent,
        ROWS,
    )
    placed = names.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    clusters = placed.groupBy("component").agg(F.min("at").alias("first"), F.sum("copies").alias("size")).filter("size > 1")
    found = placed.join(clusters, "component").select("fa", "fb", "first")
    members = rows.join(found, ["fa", "fb"]).select(
        "doc_id", F.col("paragraph").cast("long").alias("paragraph"), F.col("n").alias("n_shingles"),
        F.col("first.doc_id").alias("first_doc_id"), F.col("first.paragraph").cast("long").alias("first_paragraph"),
    ).distinct()
    kept = (F.col("doc_id") == F.col("first_doc_id")) & (F.col("paragraph") == F.col("first_paragraph"))
    return members.withColumn("kept", kept)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of ``doc_id, version, text``, a long text in overlapping stretches, so that a place fits its bits.

    A window that comes again around the same piece of a text is listed once.
    """
    for batch in batches:
        for texts in text_rounds(batch["text"]):
            found = words(texts)
            for row, offset, value, bounds in _stretches(found.hashes, found.rows, PASSAGE):
                if len(value) < PASSAGE:
                    continue
                hashes = _Hashes(value)
                place = _smallest_gram(hashes, len(value), PASSAGE, PIECE)
                owner = np.searchsorted(bounds, np.arange(len(place)), side="right") - 1
                inside = np.arange(len(place)) + PASSAGE <= bounds[owner + 1]
                first = np.unique(place[inside])
                owner = np.searchsorted(bounds, first, side="right") - 1
                joined = np.zeros(len(value) - 4, dtype=np.uint64)
                for k in range(5):
                    joined += value[k : k + len(joined)] * _PLACE[k]
                element = mixed(joined)[first[:, None] + np.arange(PIECE - 4)]
                key = np.zeros(len(first), dtype=np.uint64)
                for k in range(ROWS):
                    key = mixed(key + (element * _TIMES[k] + _PLUS[k]).min(axis=1))
                starts = first[:, None] - np.array(REACH)
                held = (starts >= bounds[owner][:, None]) & (starts + WINDOW <= bounds[owner + 1][:, None])
                window = np.zeros(starts.shape, dtype=np.int64)
                window[held] = hashes.of(starts[held], starts[held] + WINDOW).view(np.int64)
                # text that goes round in circles has the same few windows everywhere
                same = mixed(window.view(np.uint64) + mixed(key + mixed(owner.astype(np.uint64)))[:, None])
                once = np.zeros(window.size, dtype=bool)
                once[np.flatnonzero(held)[np.unique(same[held], return_index=True)[1]]] = True
                held = once.reshape(held.shape)
                some = held.any(axis=1)
                first, owner, key, window, held = (x[some] for x in (first, owner, key, window, held))
                lists = pa.ListArray.from_arrays(
                    np.arange(len(first) + 1, dtype=np.int32) * np.int32(len(REACH)), pa.array(window.ravel(), mask=~held.ravel())
                )
                of = pa.array(owner + row + texts.first)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].take(of), batch["version"].take(of), pa.array((first - bounds[owner] + offset).astype(np.int32)),
                     pa.array(key.view(np.int64)), lists],
                    ["doc_id", "version", "first", "key", "windows"],
                )


def _pieces(documents: DataFrame) -> DataFrame:
    """``doc_id, version, first, key, windows``: each piece with its first word, its band key and the hashes of the windows around it."""
    texts = documents.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("version"), F.col("text").cast("string"))
    return texts.mapInArrow(_cut, "doc_id long, version long, first int, key long, windows array<long>")


def passage_words(documents: DataFrame) -> DataFrame:
    """``doc_id, n_passage_words`` of the documents that share a passage with another doc_id, wherever it begins in its lines.

    ``n_passage_words`` counts the words under windows of ``WINDOW`` words that both documents have. A document that has ``PASSAGE``
    words in a row in common with another is never missed, one with fewer than ``WINDOW`` never returned. Words
    are as in :mod:`tapewarden.llm.words`; what is between them does not matter. What repeats only inside one doc_id does not
    count, and what a document repeats of a passage may count once; different texts of one doc_id are added up. Rows without doc_id take no part, nulls are empty.
    """
    ship_package(documents.sparkSession)
    pieces = written(_pieces(documents.filter("doc_id is not null")), "pieces")
    several = F.min("doc_id") != F.max("doc_id")
    # written, so that adaptive execution sees a plain join and splits hot keys
    keys = written(pieces.groupBy("key").agg(several.alias("met")).filter("met").select("key"), "piece_keys")
    met = written(pieces.join(keys, "key").drop("key"), "pieces_met")
    reach = F.array(*map(F.lit, REACH))
    windows = met.select("doc_id", "version", "first", F.posexplode("windows").alias("turn", "window")).filter("window is not null")
    shared = written(windows.groupBy("window").agg(several.alias("shared")).filter("shared").select("window"), "shared_windows")
    start = (F.col("first") - F.get(reach, "turn")).alias("start")
    found = windows.select("doc_id", "version", "window", start).join(shared, "window")
    found = found.groupBy("doc_id", "version").agg(F.array_sort(F.collect_set("start")).alias("starts"))
    # a window counts up to the next one's start, the last one whole
    steps = F.zip_with("starts", F.slice("starts", 2, F.size("starts")), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    covered = F.aggregate(steps, F.lit(0).cast("long"), lambda total, step: total + step)
    return found.select("doc_id", covered.alias("words")).groupBy("doc_id").agg(F.sum("words").alias("n_passage_words"))


def paragraphs_by_document(documents: DataFrame, members: DataFrame, passages: DataFrame) -> DataFrame:
    """One row for each doc_id of ``documents``, with what :func:`duplicate_paragraphs` and :func:`passage_words` found in it.

    ``n_passages`` and ``n_passages_dropped`` count the paragraphs of ``PASSAGE_SHINGLES`` shingles or more that have a near
    duplicate and those of them that are not kept, ``n_duplicates`` and ``n_dropped`` all such paragraphs;
    ``clusters`` lists them in order as paragraph:first_doc_id:first_paragraph, comma-joined. ``n_passage_words`` are the words
    of passages that another document has as well, whatever its lines. Documents
    without any have zeros and an empty list; rows without doc_id have no row.
    """
    long = F.col("n_shingles") >= PASSAGE_SHINGLES
    listed = F.sort_array(F.collect_list(F.struct("paragraph", "first_doc_id", "first_paragraph")))
    found = members.groupBy("doc_id").agg(
        F.count_if(long).alias("n_passages"), F.count_if(long & ~F.col("kept")).alias("n_passages_dropped"),
        F.count(F.lit(1)).alias("n_duplicates"), F.count_if(~F.col("kept")).alias("n_dropped"),
        F.array_join(F.transform(listed, lambda m: F.concat_ws(":", m["paragraph"], m["first_doc_id"], m["first_paragraph"])), ",").alias("clusters"),
    )
    every = documents.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    counts = ("n_passages", "n_passages_dropped", "n_duplicates", "n_dropped", "n_passage_words")
    return every.join(found, "doc_id", "left").join(passages, "doc_id", "left").fillna({c: 0 for c in counts} | {"clusters": ""})
