"""Exact line dedup over levelled sorted runs of line hashes.

The index holds one row for each line key seen so far, with the document that
owns it. It is kept as runs: tables bucketed by key hash, each bucket one sorted
file, whose keys are disjoint. A batch's keys are reduced to one row each and
written in the same buckets; a merge join then takes out what any run holds, and
what is left becomes a new run of level 0. When a level has `fanout` runs they are
merged two by two, bucket by bucket, into one run of the next level, so that n
batches leave about fanout * log(n) runs. Neither of these merges shuffles or sorts
a run; a new run's rows are sorted once more within their bucket as Spark writes
them.

dedup() feeds batches of ascending doc_id, so that a key's owner is the smallest
doc_id that holds it. Keys are told apart by a 128-bit hash. Only hashes are
shuffled for the index; texts are shuffled once, by doc_id, to take their dropped
keys. A frequent line is reduced on the map side, and its lookups go through a
join whose large partitions Spark splits. Lines are cut and hashed in Arrow
batches, in time linear in the text.

Nulls: a null or empty text is one empty line; a null doc_id counts as the
largest id. Rows with one doc_id are one document. Lines repeated within the
owner stay. Keys shorter than `least` code points are never dropped. An empty table
gives an empty result; columns named n_lines or n_dropped are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import Scratch, settings
from ._words import buffers

STRIPPED = b" \t\n\x0b\x0c\r"
ROWS = 1 << 16
#: Runs are read in the order in which they lie.
SORTED = {"spark__sql__legacy__bucketedTableScan__outputOrdering": "true"}


def key_of(line: bytes) -> bytes:
    return line.strip(STRIPPED).lower()  # bytes: A-Z alone


def long_enough(key: bytes, least: int) -> bool:
    """At least `least` code points."""
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


class LineRuns:
    """The levelled runs; add() takes a batch of (a, b, doc_id) and returns its new keys."""

    def __init__(self, spark: SparkSession, s: Scratch, fanout: int = 2, buckets: int | None = None):
        self.spark, self.s, self.fanout = spark, s, max(2, fanout)
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = []

    def rows(self) -> DataFrame | None:
        every = [t for level in self.levels for t in level]
        return reduce(DataFrame.unionByName, every) if every else None

    def add(self, batch: DataFrame) -> DataFrame:
        new = self.s.bucketed(batch.groupBy("a", "b").agg(F.min("doc_id").alias("doc_id")), "line_batch", self.buckets, "a", "b")
        runs = [t for level in self.levels for t in level]
        if runs:
            with settings(self.spark, **SORTED):
                new = self.s.bucketed(unseen(new, runs), "line_run", self.buckets, "a", "b", deal=False)
        self._push(0, new)
        return new

    def _push(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            with settings(self.spark, **SORTED):
                one = reduce(lambda x, y: self.s.bucketed(merged(x, y), "line_run", self.buckets, "a", "b", deal=False), self.levels[level])
            self.levels[level] = []
            self._push(level + 1, one)


def unseen(new: DataFrame, runs: list[DataFrame]) -> DataFrame:
    """Rows of new whose key no run holds, by merge joins."""
    return reduce(lambda rest, run: rest.join(run.hint("merge"), ["a", "b"], "left_anti"), runs, new)


def merged(x: DataFrame, y: DataFrame) -> DataFrame:
    """Two runs of different keys as one, by a merge join."""
    return x.join(y.withColumnRenamed("doc_id", "other").hint("merge"), ["a", "b"], "full").select("a", "b", F.coalesce("doc_id", "other").alias("doc_id"))


def _keyer(least: int):
    """Rows (doc_id, text) to rows (a, b, doc_id): the distinct long keys of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            found, counts, first = [], [], 0

            def out(first: int) -> pa.RecordBatch:
                h = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
                who = np.repeat(np.arange(first, first + len(counts)), counts)
                return pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), batch.column(0).take(pa.array(who))], names=["a", "b", "doc_id"])

            for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                keys = set(map(key_of, data[lo:hi].tobytes().split(b"\n")))
                own = [xxhash.xxh3_128_digest(k) for k in keys if long_enough(k, least)]
                found += own
                counts.append(len(own))
                if len(found) >= ROWS:
                    yield out(first)
                    first, found, counts = first + len(counts), [], []
            if found:
                yield out(first)

    return run


def keys_of(docs: DataFrame, text: str, doc_id: str, least: int) -> DataFrame:
    """(a, b, doc_id), one row for each document row and distinct key of at least `least` code points."""
    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return source.mapInArrow(_keyer(least), "a bigint, b bigint, doc_id " + docs.schema[doc_id].dataType.simpleString())


def _dropper(names: list[str], at: int):
    """Rows of carried columns, the text among them at `at`, and drops, to the same with the kept text, n_lines and n_dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(at))
            drops = batch.column(len(names))
            start, values = drops.offsets.to_numpy(), drops.values
            pairs = np.stack([values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1)], 1).astype(np.int64) if len(values) else np.zeros((0, 2), np.int64)
            n_lines, n_dropped, kept = [], [], []
            for i, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                raw = data[lo:hi].tobytes()
                if start[i] == start[i + 1]:
                    n_lines.append(raw.count(b"\n") + 1)
                    n_dropped.append(0)
                    kept.append(raw)
                    continue
                gone, lines = {p.tobytes() for p in pairs[start[i] : start[i + 1]]}, raw.split(b"\n")
                left = [x for x in lines if xxhash.xxh3_128_digest(key_of(x)) not in gone]
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(left))
                kept.append(b"\n".join(left))
            columns = list(batch.columns[: len(names)])
            columns[at] = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*names, "n_lines", "n_dropped"])

    return run


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = 10, batches: int = 4, fanout: int = 2, carry: list[str] | None = None) -> DataFrame:
    """docs' columns (or carry and text) with text's repeated lines dropped, n_lines and n_dropped."""
    spark = docs.sparkSession
    carry = [c for c in (docs.columns if carry is None else [*dict.fromkeys([*carry, text])]) if c.lower() not in ("n_lines", "n_dropped")]
    cuts = docs.agg(F.percentile_approx(doc_id, [i / batches for i in range(1, batches)], 1000)).first()[0] or []
    batch = F.lit(len(cuts))
    for i, cut in reversed(list(enumerate(cuts))):
        batch = F.when(F.col("doc_id") <= cut, i).otherwise(batch)
    with Scratch(spark) as s:
        path = s.path("line_keys")
        keys_of(docs, text, doc_id, least).withColumn("batch", batch).write.partitionBy("batch").parquet(path)
        keys = spark.read.schema("a long, b long, doc_id " + docs.schema[doc_id].dataType.simpleString() + ", batch int").parquet(path)
        runs = LineRuns(spark, s, fanout)
        for i in range(len(cuts) + 1):
            runs.add(keys.where(F.col("batch") == i).drop("batch"))
        index = runs.rows().select("a", "b", F.col("doc_id").alias("owner"))
        drops = keys.join(index, ["a", "b"]).where(~F.col("doc_id").eqNullSafe(F.col("owner")))
        with settings(spark, spark__sql__sources__bucketing__enabled="false"):  # both sides are dealt anew, so that Spark can split a frequent line
            drops = s.written(drops.groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set(F.struct("a", "b")).alias("__drop")), "line_drops", keep=True)
    joined = docs.select(*(F.col(f"`{c}`").cast("string").alias(c) if c == text else F.col(f"`{c}`") for c in carry), F.col(f"`{doc_id}`").alias("__doc")).join(drops, F.col("__doc").eqNullSafe(F.col("__id")), "left")
    schema = T.StructType([joined.schema[c] for c in carry]).add("n_lines", "long").add("n_dropped", "long")
    return joined.select(*(f"`{c}`" for c in carry), "__drop").mapInArrow(_dropper(carry, carry.index(text)), schema)
