"""From raw documents to a mixed training set: five stages, each over all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewarden.llm.decontamination import contaminated
from tapewarden.llm.lines import deduplicate_lines
from tapewarden.llm.mixing import mixed_documents
from tapewarden.llm.resampling import importance_resample
from tapewarden.llm.scratch import written
from tapewarden.llm.setsketch import near_duplicates

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Documents whose doc_id is not in ``gone``; those without doc_id stay."""
    return docs.join(gone.select("doc_id").distinct(), "doc_id", "left_anti")


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _without(docs, importance_resample(docs, labels).filter("not kept"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that other documents keep go; the text and its length are what stays."""
    columns = docs.columns
    cleaned = deduplicate_lines(docs).withColumns({"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")})
    return cleaned.select(*columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest doc_id."""
    return _without(docs, near_duplicates(docs, percent=80).filter("not kept"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return _without(docs, contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixed_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", reject_low_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: Sketches and n-gram models have no SQL twin; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every other stage is written and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
