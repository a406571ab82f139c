"""Line deduplication with levelled runs of line hashes; DataFrame functions only.

A run is a Parquet table ``(k1, k2, n_docs, last_doc)`` sorted by the 128-bit key
hash, one row per line key of the documents it stands for. A batch of documents
makes a run of its own on level 0; when a level holds ``fanout`` runs they are
merged into one of the next level, so there are about log(batches) runs at any
time and a key is rewritten as often. Counts and largest doc_ids merge by sum and
maximum, so the verdict on a line does not depend on how the batches were cut.
After the last batch all lines are joined once with the merged runs, since later
batches change verdicts on earlier ones: lines whose key has met ``min_docs``
documents go, except in the largest doc_id that holds them.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewarden.llm.scratch import written

SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ("k1", "k2")


def line_array(text: Column) -> Column:
    """The lines of a text; null and empty texts are one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """Stripped at both ends, A-Z lower-cased. ``lower`` is the same on pure ASCII and much faster."""
    bare = F.btrim(line, F.lit(SPACES))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def numbered_lines(documents: DataFrame, min_chars: int) -> DataFrame:
    """``doc_id, version, line_no, k1, k2`` of the lines whose keys are long enough to matter.

    ``version`` tells rows of one doc_id with different texts apart.
    """
    version = F.xxhash64("text").alias("version")
    lines = documents.select("doc_id", version, F.posexplode(line_array(F.col("text"))).alias("line_no", "line"))
    keyed = lines.select("doc_id", "version", "line_no", line_key(F.col("line")).alias("key"))
    return keyed.filter(F.col("doc_id").isNotNull() & (F.char_length("key") >= min_chars)).select(
        "doc_id", "version", "line_no", F.xxhash64("key").alias("k1"),
        F.xxhash64(F.lit("second"), F.col("key"), F.char_length("key")).alias("k2"),
    )


def without(lines: Column, dropped: Column) -> Column:
    """``lines`` without the sorted zero-based positions ``dropped``: the stretches between them, strung together."""
    stops = F.concat(F.array(F.lit(-1)), dropped, F.array(F.size(lines)))
    between = F.transform(
        F.sequence(F.lit(1), F.size(stops) - 1),
        lambda i: F.slice(lines, F.get(stops, i - 1) + 2, F.get(stops, i) - F.get(stops, i - 1) - 1),
    )
    return F.flatten(between)


class LineRuns:
    """Levels of sorted runs; ``add`` a batch's lines, ``compact`` to one run, ``repeated`` lines of a batch."""

    def __init__(self, min_docs: int = 3, fanout: int = 3) -> None:
        self.min_docs, self.fanout = min_docs, fanout
        self.levels: list[list[DataFrame]] = []

    @staticmethod
    def _sorted_run(rows: DataFrame, name: str) -> DataFrame:
        return written(rows.sortWithinPartitions(*KEY), name)

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        together = reduce(DataFrame.unionByName, runs)
        return together.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))

    def add(self, lines: DataFrame) -> None:
        """Add a batch's lines; a document must lie in one batch as a whole."""
        # first each key once per document, then the documents of each key
        once = lines.select(*KEY, "doc_id").distinct()
        run = once.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))
        run, level = self._sorted_run(run, "run"), 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fanout:
                return
            run, self.levels[level] = self._sorted_run(self._merged(self.levels[level]), "run"), []
            level += 1

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def compact(self) -> None:
        """Merge all runs into one."""
        runs = self.runs()
        if len(runs) > 1:
            self.levels = [[] for _ in self.levels] + [[self._sorted_run(self._merged(runs), "run")]]

    def repeated(self, lines: DataFrame) -> DataFrame:
        """The lines of a batch that go because another document keeps them."""
        runs = self.runs()
        merged = runs[0] if len(runs) == 1 else self._merged(runs)
        often = merged.filter(F.col("n_docs") >= self.min_docs).select(*KEY, "last_doc")
        return lines.join(often, list(KEY)).filter("doc_id <> last_doc").select("doc_id", "version", "line_no")


def deduplicate_lines(
    documents: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4
) -> DataFrame:
    """Documents without the lines that other documents repeat: all columns, and ``n_lines``, ``n_dropped``, ``kept_text``.

    A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` and with A-Z lower-cased.
    Keys of ``min_chars`` code points or more found in ``min_docs`` documents or more
    lose all their lines except in the largest doc_id that holds them. The documents
    enter the runs in ``batches`` parts; the result does not depend on their number.

    A null or empty text is one empty line. Rows of the same doc_id count as one
    document. A row without doc_id keeps all its lines and counts for nothing. Other
    columns pass through, but the three named above are replaced; an empty table
    gives an empty result.
    """
    lines = numbered_lines(documents.select("doc_id", "text"), min_chars)
    lines = written(lines.withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches))), "lines")
    runs = LineRuns(min_docs)
    for batch in range(batches):
        runs.add(lines.filter(F.col("batch") == batch))
    runs.compact()
    gone = runs.repeated(lines.drop("batch"))
    dropped = gone.groupBy("doc_id", "version").agg(F.sort_array(F.collect_set("line_no")).alias("line_nos"))
    own = f"_{uuid.uuid4().hex[:8]}"  # a name that no column of the caller has
    text = F.coalesce("d.text", F.lit(""))
    result = {
        "n_lines": F.size(line_array(F.col("d.text"))).cast("long"),
        "n_dropped": F.coalesce(F.size("g.line_nos"), F.lit(0)).cast("long"),
        "kept_text": F.when(F.col("g.line_nos").isNull(), text).otherwise(
            F.array_join(without(F.split(text, "\n", -1), F.col("g.line_nos")), "\n")
        ),
    }
    docs = documents.withColumn(own, F.xxhash64("text"))
    match = (F.col("d.doc_id") == F.col("g.doc_id")) & (F.col(f"d.{own}") == F.col("g.version"))
    return docs.alias("d").join(dropped.alias("g"), match, "left").select(
        *[F.col(f"d.`{c}`") for c in documents.columns if c not in result], *[c.alias(k) for k, c in result.items()]
    )
