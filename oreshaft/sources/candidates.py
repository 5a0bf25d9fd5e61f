"""Candidate regions: CSV and JSON scans, and a binding to the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blobs import document_blobs

REQUIRED = ("device", "base_file", "new_file", "start", "end", "side")
BOUNDARY = (
    "candidates array<struct<base_file:string,new_file:string,side_file:string,start:int,`end`:int,note:string,"
    "windows_hex:struct<start_pre:string,start_post:string,end_pre:string,end_post:string>>>"
)


def read_candidates(spark: SparkSession, path: str, required=REQUIRED, strict: bool = False) -> DataFrame:
    """A headed CSV as text columns with start and end as ints (12.0 too).

    Absent required columns are an error. Rows whose bounds don't parse are dropped,
    or with strict an error when they are read. Blank cells are null.
    """
    raw = spark.read.csv(path, header=True, quote='"', escape='"', mode="PERMISSIVE", encoding="UTF-8")
    raw = raw.toDF(*(c.lstrip("﻿") for c in raw.columns))
    if absent := sorted(set(required) - set(raw.columns)):
        raise ValueError(f"{path}: missing columns {', '.join(absent)}")
    for c in ("start", "end"):
        raw = raw.withColumn(c, F.col(c).cast("double").cast("int") if strict else F.col(c).try_cast("double").cast("int"))
    return raw if strict else raw.where("start is not null and `end` is not null")


def read_boundary_windows(spark: SparkSession, path: str) -> DataFrame:
    """A boundary document's windows: idx, the candidate's fields, zone, hexed (no spaces; absent is empty)."""
    doc = spark.read.schema(BOUNDARY).json(path, multiLine=True).select(F.posexplode("candidates").alias("idx", "c"))
    zones = ("start_pre", "start_post", "end_pre", "end_post")
    pairs = F.array(*(F.struct(F.lit(z).alias("zone"), F.replace(F.coalesce(F.col(f"c.windows_hex.{z}"), F.lit("")), F.lit(" "), F.lit("")).alias("hexed")) for z in zones))
    return doc.select("idx", "c.base_file", "c.new_file", "c.side_file", "c.start", "c.end", "c.note", F.inline(pairs))


def side_file(side: str = "side", note: str = "note", rule: str = "exact"):
    """The file a candidate lies in.

    rule exact: new or base as written, else new; folded: base in any case, else
    new; noted: side in any case, else base if the note tells of a deletion, else new.
    """
    s, base, new = F.col(side), F.col("base_file"), F.col("new_file")
    if rule == "exact":
        return F.when(s == "base", base).otherwise(new)
    low = F.lower(F.trim(F.coalesce(s, F.lit(""))))
    if rule == "folded":
        return F.when(low == "base", base).otherwise(new)
    text = F.lower(F.coalesce(F.col(note), F.lit("")))
    return F.when(low == "base", base).when(low == "new", new).when(text.contains("insertion"), new).when(text.contains("deletion"), base).otherwise(new)


def document_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One region for each document of at least 64 bytes: doc_id, device, file_name, content, n, start, end, side."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    n = F.octet_length("content").cast("bigint")
    blobs = document_blobs(spark, sf_dir).withColumn("n", n).where("n >= 64")
    start = F.col("doc_id") % (F.col("n") - 32)
    end = F.least(F.col("n"), start + 27 + F.col("doc_id") % 200)
    side = F.when(F.col("quality") == 0, "base").otherwise("new")
    return blobs.join(labels, "doc_id", "left").select("doc_id", "device", "file_name", "content", "n", start.alias("start"), end.alias("end"), side.alias("side"))
