"""A corpus pipeline over documents: five stages, each written as Parquet before the next reads it.

Language identification rejects documents without a known language, line dedup
takes repeated lines out of the texts, near-dedup keeps one document of each
group, decontamination drops documents that hold any benchmark passage, and mixing
says how many copies of each document the training mix takes. A document that line
dedup leaves without words stays until the mix, which takes nothing of it.

Rows of one doc_id are one document to line dedup and near-dedup; documents with a
null doc_id have no near-duplicates. All stages but the last return the columns of
documents; the last adds size, source_size, target and copies, and gives a row of its
own to every row that it takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oreshaft.llm import decontaminate, langid, linededup, mixing, neardup
from oreshaft.llm._shared import Scratch, table, written

#: Least probability of a language below which a document is rejected, as one in whose text no language shows.
MIN_SCORE = 0.5

#: No SQL: a trained network, a random rounding and similarity groups.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter or whose best language scores below MIN_SCORE."""
    said = langid.predict(docs, langid.fit(docs))
    return said.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE)).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in several documents stay in the first alone; n_chars follows the text."""
    kept = linededup.dedup(docs)
    return kept.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the smallest doc_id stays."""
    gone = neardup.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item, however long the rest is."""
    found = decontaminate.judged(decontaminate.find_benchmark(docs, table(spark, sf_dir, "benchmark")))
    return found.where("n_hit = 0").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with size, source_size, target and copies."""
    numbered = written(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")  # ids may be null or repeat
    figures = ["size", "source_size", "target", "copies"]
    mixed = mixing.mix(numbered, row="__row").where("copies > 0").select(F.col("row").alias("__row"), *figures)
    return numbered.join(mixed, "__row").select(*docs.columns, *figures)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mix_sources", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark) as s:
        for name, stage in STAGES[:-1]:
            docs = s.written(stage(spark, docs, sf_dir), name)
        return STAGES[-1][1](spark, docs, sf_dir)
