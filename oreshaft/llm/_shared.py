"""Storage and small plan helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts, as a Java/RE2 character class body.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir. Only a session of one machine (master local) may lack it and then gets a new local one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {master} share")
        base = tempfile.mkdtemp(prefix="oreshaft-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders by the file system that their path names."""
    sc = spark.sparkContext
    for p in paths:
        path = sc._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


#: Folders that results read, to be removed by release().
_left: list[str] = []


def release(spark: SparkSession) -> None:
    """Remove the tables behind all results given so far; they can't be read afterwards."""
    remove(spark, _left)
    _left.clear()


class Scratch:
    """An operator's intermediate tables in the shared folder, removed when it ends, also by an error.

    What the operator's lazy result still reads is written with keep and stays until
    release().
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.names = spark, [], []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(self.spark, self.paths)

    def path(self, name: str, keep: bool = False) -> str:
        path = scratch(self.spark, name)
        (_left if keep else self.paths).append(path)
        return path

    def written(self, df: DataFrame, name: str, keep: bool = False) -> DataFrame:
        """Cut the lineage: write the rows once to the shared folder and read them back."""
        path = self.path(name, keep)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, name: str, buckets: int, *keys: str, deal: bool = True) -> DataFrame:
        """df as a table in buckets of keys, each one file sorted by them: joins on the keys read it without a shuffle.

        Without deal df is known to be dealt by keys into as many partitions.
        """
        full = f"{name}_{uuid.uuid4().hex}"
        rows = df.repartition(buckets, *keys) if deal else df
        rows.write.option("path", self.path(name)).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(full)
        self.names.append(full)
        return self.spark.table(full)


@contextmanager
def settings(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Session settings (dots written as __) while a plan is made and run."""
    names = {k.replace("__", "."): v for k, v in conf.items()}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def written(df: DataFrame, name: str) -> DataFrame:
    """Rows written once to the shared folder and read back; they stay until release()."""
    return Scratch(df.sparkSession).written(df, name, keep=True)


def ascii_lower(col: Column) -> Column:
    """A-Z only; other letters keep their case."""
    return F.translate(col, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
