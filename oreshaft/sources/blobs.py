"""Blobs: (device, file_name, content) tables from folders, file lists or the driver's documents."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_blobs(spark: SparkSession, paths: str | list[str], pattern: str = "*.dat", recursive: bool = True) -> DataFrame:
    """Files under one or more folders (or a list of files): device is the last folder, file_name the last part of the path.

    Spark's scans leave out empty files: those come from the listing, which the driver
    holds for the scan anyway; its paths go to executors and meet those that were scanned.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    full = reader.load(paths).select("path", "length", "content")
    jvm = spark.sparkContext._jvm
    listed = jvm.scala.jdk.javaapi.CollectionConverters.asJava(jvm.scala.collection.immutable.ArraySeq.unsafeWrapArray(full._jdf.inputFiles()))
    uris = DataFrame(spark._jsparkSession.createDataset(listed, jvm.org.apache.spark.sql.Encoders.STRING()).toDF(), spark)
    # a listing's file:///a%20b is a scan's file:/a b
    plain = F.regexp_replace(F.url_decode(F.replace("value", F.lit("+"), F.lit("%2B"))), "^([^/:]+:)///", "$1/")
    every = uris.select(plain.alias("path")).distinct()
    empty = every.join(full.select("path"), "path", "left_anti").select("path", F.lit(0).cast("bigint").alias("length"), F.lit(b"").alias("content"))
    parts = F.split("path", "/")
    return full.unionByName(empty).select(F.element_at(parts, -2).alias("device"), F.element_at(parts, -1).alias("file_name"), "path", "length", "content")


def labelled(paths: list[str], labels: list[str] | None = None) -> dict[str, str]:
    """A label for each path: those given, one for each, or else the names without their suffix."""
    if labels is None:
        labels = [os.path.splitext(os.path.basename(p))[0] for p in paths]
    if len(labels) != len(paths):
        raise ValueError(f"{len(labels)} labels for {len(paths)} files")
    return dict(zip(paths, labels))


def by_name(blobs: DataFrame, root: str) -> DataFrame:
    """One blob for each file_name: one directly under root first, then the first path."""
    direct = F.col("path").rlike(r"^(file:)?/*\Q" + root.strip("/") + r"\E/[^/]+$")
    order = Window.partitionBy("file_name").orderBy(direct.desc(), "path")
    return blobs.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def resolve(wanted: DataFrame, blobs: DataFrame, on: list[str]) -> DataFrame:
    """wanted with content of the blob of its file_name, or else of the name with dashes for spaces; null where neither is there."""
    own = blobs.select(*on, "content")
    dashed = own.select(*(F.col(c).alias(f"__{c}") for c in on), F.col("content").alias("__content"))
    joined = wanted.join(own, on, "left")
    name = F.replace(F.col("file_name"), F.lit(" "), F.lit("-"))
    match = [F.col(c) == F.col(f"__{c}") if c != "file_name" else name == F.col("__file_name") for c in on]
    test = match[0]
    for m in match[1:]:
        test = test & m
    return joined.join(dashed, test, "left").withColumn("content", F.coalesce("content", "__content")).drop("__content", *(f"__{c}" for c in on))


def missing(wanted: DataFrame, blobs: DataFrame) -> DataFrame:
    """File names that no blob has."""
    return wanted.select("file_name").distinct().join(blobs.select("file_name"), "file_name", "left_anti")


def document_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as blobs: device is the language, content the text in UTF-8."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.col("lang").alias("device"), F.col("doc_id").cast("string").alias("file_name"), F.encode("text", "UTF-8").alias("content"))


def digest_blobs(spark: SparkSession, sf_dir: str, pieces: int = 64) -> DataFrame:
    """One blob of pieces * 16 near-uniform bytes for each document, from MD5 of id and piece."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("lang").alias("device"))
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), lambda i: F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":"), i.cast("string")).cast("binary"))), "")
    return docs.select("doc_id", "device", F.col("doc_id").cast("string").alias("file_name"), F.unhex(text).alias("content"))
