"""Ranks over all rows and short lists of tags, without gathering rows in one task."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _part(value: Column, cuts: list, kind: str) -> Column:
    """How many of the ascending cuts are below value, looked up in a constant array."""
    return F.size(F.filter(F.array(*(F.lit(c).cast(kind) for c in cuts)), lambda c: c < value)) if cuts else F.lit(0)


def ranked(rows: DataFrame, value: str, tie: str, name: str = "rank") -> DataFrame:
    """rows with their place by value, greatest first, and then by tie, least first.

    Rows are dealt to ranges of value, and those whose value is itself a bound, of which
    there may be any number, to ranges of tie; each range is numbered for itself, from the
    number of rows before it. Driver: a row for each range, at most the square of the
    number of shuffle partitions. rows are kept in memory or on disk while they are
    counted, as they are read three times.
    """
    rows = rows.persist()
    parts = max(2, min(128, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    shares = [i / parts for i in range(1, parts)]
    found = rows.agg(F.percentile_approx(value, shares, 10_000).alias("v"), F.percentile_approx(tie, shares, 10_000).alias("t")).first()
    values, ties = sorted(set(found["v"] or [])), sorted(set(found["t"] or []))
    kind, tie_kind = (rows.schema[c].dataType.simpleString() for c in (value, tie))
    own = F.col(value).isin(*values) if values else F.lit(False)
    dealt = rows.withColumn("__a", _part(F.col(value), values, kind)).withColumn("__b", F.when(own, _part(F.col(tie), ties, tie_kind) + 1).otherwise(0))
    # between two bounds come first those equal to the upper one, then the others
    order = lambda r: (-r["__a"], r["__b"] == 0, r["__b"])
    counts = sorted(dealt.groupBy("__a", "__b").count().collect(), key=order)
    before = accumulate([0, *(r["count"] for r in counts)])
    start = rows.sparkSession.createDataFrame([(r["__a"], r["__b"], n) for r, n in zip(counts, before)], "__a int, __b int, __n long")
    at = F.row_number().over(Window.partitionBy("__a", "__b").orderBy(F.col(value).desc(), tie))
    return dealt.join(F.broadcast(start), ["__a", "__b"]).withColumn(name, F.col("__n") + at).drop("__a", "__b", "__n")


def tag_lists(rows: DataFrame, by: list[str], shown: int = 6, distinct: bool = False) -> DataFrame:
    """(by, sources, tags, more) of rows (by, tag): how many distinct tags (distinct: they are so already), the first `shown` of them and how many others."""
    each = rows.select(*by, "tag") if distinct else rows.select(*by, "tag").distinct()
    first = first_tags(rows, by, shown).distinct().withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy("tag"))).where(F.col("__r") <= shown)
    listed = first.groupBy(*by).agg(F.sort_array(F.collect_list("tag")).alias("tags"))
    counts = each.groupBy(*by).agg(F.count("*").alias("sources"))
    return counts.join(listed, by).withColumn("more", F.greatest(F.lit(0).cast("bigint"), F.col("sources") - shown))


#: Rows that a task compares at a time.
HELD = 1 << 18


def first_tags(rows: DataFrame, by: list[str], shown: int) -> DataFrame:
    """Rows (by, tag) among which are the first `shown` tags of every group: those of each task's groups, without sorting its rows by group."""
    source = rows.select(*by, "tag")

    def cut(t: pa.Table) -> pa.Table:
        t = t.combine_chunks().group_by(t.column_names, use_threads=False).aggregate([])
        t = t.take(pc.sort_indices(t, sort_keys=[(c, "ascending") for c in t.column_names], null_placement="at_start"))
        new = np.zeros(len(t), bool)
        new[:1] = True
        for c in t.column_names[:-1]:
            code = t.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            new[1:] |= code[1:] != code[:-1]
        at = np.arange(len(t))
        return t.filter(pa.array(at - np.maximum.accumulate(np.where(new, at, 0)) < shown))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for b in batches:
            held.append(pa.Table.from_batches([b]))
            if sum(map(len, held)) >= HELD:
                held = [cut(pa.concat_tables(held))]
                if len(held[0]) > HELD // 2:  # many groups
                    yield from held.pop().to_batches()
        if held:
            yield from cut(pa.concat_tables(held)).to_batches()

    return source.mapInArrow(run, source.schema)


def sources_text(tags: str = "tags", more: str = "more") -> Column:
    """`a, b (+3 more)`"""
    return F.concat(F.array_join(tags, ", "), F.when(F.col(more) > 0, F.concat(F.lit(" (+"), F.col(more).cast("string"), F.lit(" more)"))).otherwise(""))
