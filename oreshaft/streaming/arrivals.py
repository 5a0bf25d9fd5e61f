"""Histograms over blobs that keep arriving in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stats import histogram

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def arriving_blobs(spark: SparkSession, folder: str, pattern: str = "*.dat") -> DataFrame:
    """A stream of (device, file_name, modificationTime, content)."""
    parts = F.split("path", "/")
    stream = spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return stream.select(F.element_at(parts, -2).alias("device"), F.element_at(parts, -1).alias("file_name"), "modificationTime", "content")


def running_histogram(stream: DataFrame, offset: int = 0) -> DataFrame:
    """(device, b, n) over everything that has arrived; write it in complete or update mode."""
    return histogram(stream, "device", offset)
