"""Queries op1 to op10 over the driver's tables, with DuckDB SQL (oracles) where SQL can say the same.

Each query applies its operator to the whole table and derives the digest
columns of its contract from the operator's result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fingerprint, langid, linededup, mixing, neardup, secrets, substring, urlfilter, warc
from ._shared import table
from .oracles import ORACLES as ORACLES

#: The rules of op1.
URL_RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    weights = urlfilter.fit(urlfilter.example_table(spark))
    return urlfilter.judge(pages, URL_RULES, weights).select("page_id", "host", "path", "rule", "verdict", "blocked_p")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("bigint").alias("taken"), "source", "copies")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.Ledger(spark).scan(docs, "text")
    spans, base = F.col("spans"), [r.kind for r in secrets.RULES[1]]
    return found.select(
        "doc_id", *(secrets.count_of(spans, k).alias(f"n_{k}") for k in base),
        F.sha2(secrets.listed(spans, base), 256).alias("base_sha256"), secrets.listed(spans).alias("spans"),
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages")), payloads=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return decontaminate.judged(found).select(
        "doc_id", "n_words", "n_hit", F.size("hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), "contaminated",
    )


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    said = langid.predict(docs, langid.fit(docs), carry=["doc_id"])
    return said.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fingerprint.edited(table(spark, sf_dir, "documents"))
    fp, own = F.col("fp"), F.col("edited_fp")
    return e.select(
        "doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        fingerprint.text_of(fp).alias("fingerprint"), fingerprint.text_of(own).alias("edited_fingerprint"),
        fingerprint.likeness(fp, own).alias("near_edited"), fingerprint.likeness(fp, F.col("next_fp")).alias("near_next"),
    )


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_mix_sources, op3_secrets, op4_line_dedup, op5_warc, op6_decontaminate, op7_near_duplicates, op8_language_id, op9_fingerprint, op10_substring_dedup)}
