"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a share of all words by its weight, at most `most` times its
own size; what is cut off goes to the others by weight until none is above. A
source's documents then all want the same fractional number of copies. Its whole
part is given at once; the fraction is rounded by the pivotal method: two
fractional documents meet, word mass moves from one to the other, at random with
unchanged expectations, until one of them is integral, and the other meets the
next. Documents equal in id, source and size are counted first, and of n such all
but one are integral at once, whatever n is. The others are dealt to groups of about
`fan` rows; each group leaves at most one fractional document, and these residuals
meet in groups of `fan` on the next level, up to a single one, which is rounded at
random. No group holds more than about `fan` documents, whatever a source's share of
the rows is, and a source's taken words differ from its target by one document at
most (the smallest of the last group).

All randomness is a hash of doc_id and a seed, so reruns agree. Nulls: a null
text has size 0, a null source is a source of its own, ranked last, and a null
doc_id is hashed as such. Repeated rows are documents of their own. Documents of
size 0 take nothing. An empty table gives an empty result. Other columns of docs
are not looked at.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import WORD, Scratch

WEIGHTS = (5.0, 2.0, 1.0)
FAN = 4096
_NEAR = 1e-9


def ranked(names: DataFrame, column: str, s: Scratch) -> DataFrame:
    """Distinct values with their 0-based rank in code point order, null last, without gathering them in one task."""
    parts = max(1, int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    key = F.struct(F.col(column).isNull().alias("n"), F.col(column).alias("v"))
    dealt = s.written(names.withColumn("__key", key).repartitionByRange(parts, "__key").withColumn("__part", F.spark_partition_id()), "rank")
    before, total = [], 0
    for r in dealt.groupBy("__part").count().orderBy("__part").collect():  # a row for each partition
        before.append((r["__part"], total))
        total += r["count"]
    start = names.sparkSession.createDataFrame(before, "__part int, __before long")
    at = F.row_number().over(Window.partitionBy("__part").orderBy("__key")) - 1
    return dealt.join(F.broadcast(start), "__part").withColumn("rank", F.col("__before") + at).drop("__part", "__before", "__key")


def targets(sizes: DataFrame, s: Scratch, weights=WEIGHTS, most: float = 3.0) -> DataFrame:
    """A row for each source: source, source_size, n_docs (those with words), rank, target."""
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("n_docs"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    table = s.written(ranked(sums, "source", s).withColumn("weight", weight.cast("double")), "sources")
    ceiling = F.col("source_size") * F.lit(float(most))
    words = table.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:  # a round for each set of sources that reach their ceiling
        full = F.col("weight") * level >= ceiling if capped >= 0 else F.lit(False)
        n, used, rest = table.agg(F.count_if(full), F.sum(F.when(full, ceiling)), F.sum(F.when(~full, F.col("weight")))).first()
        if n == capped or not rest:
            break
        capped, level = n, (words - (used or 0.0)) / rest
    return table.withColumn("target", F.least(ceiling, F.col("weight") * level).cast("double"))


def _paired(t: pa.Table, last: bool) -> pa.Table:
    """One group through the pivotal method: at most one row stays fractional, none if last."""
    order = [("size", "descending"), ("u", "ascending"), ("p", "ascending"), *([("row", "ascending")] if "row" in t.column_names else [])]
    t = t.sort_by(order)  # so that a small document is left
    p, size, u = (t[c].to_pylist() for c in ("p", "size", "u"))
    held = -1
    for i in range(len(p)):
        if not _NEAR < p[i] < 1 - _NEAR:
            p[i] = float(round(p[i]))
            continue
        if held < 0:
            held = i
            continue
        ratio = size[held] / size[i]
        up, down = min(1 - p[held], p[i] / ratio), min(p[held], (1 - p[i]) / ratio)
        move = up if u[i] * (up + down) < down else -down
        p[held] += move
        p[i] -= move * ratio
        for j in (held, i):
            if not _NEAR < p[j] < 1 - _NEAR:
                p[j] = float(round(p[j]))
        held = held if 0 < p[held] < 1 else i if 0 < p[i] < 1 else -1
    if last and held >= 0:
        p[held] = float((u[held] * 7919) % 1 < p[held])
    for name, values in (("p", pa.array(p, pa.float64())), ("done", pa.array([x in (0.0, 1.0) for x in p], pa.bool_()))):
        t = t.set_column(t.schema.get_field_index(name), name, values)
    return t


def _pairing(last: bool):
    return lambda t: _paired(t, last)


def _spread(rows: DataFrame, fan: int) -> DataFrame:
    """A row for each of n equal rows, with `ones` of them at 1 and the last at p, else 0; a large n is dealt to many tasks first."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunked = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("n") / n) - 1))
    small = rows.where(F.col("n") <= fan).withColumn("chunk", F.lit(0).cast("bigint"))
    large = rows.where(F.col("n") > fan).withColumn("chunk", chunked(fan)).repartition(parts, "doc_id", "size", "chunk")
    each = small.unionByName(large).withColumn("k", F.explode(F.sequence(F.col("chunk") * fan, F.least(F.col("chunk") * fan + fan, F.col("n")) - 1)))
    value = F.when(F.col("k") < F.col("ones"), 1.0).when(F.col("k") == F.col("n") - 1, F.col("p")).otherwise(0.0)
    return each.withColumn("p", value).drop("chunk", "k", "n", "ones")


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights=WEIGHTS, most: float = 3.0, fan: int = FAN, seed: int = 5, row: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target and copies, a row for each row of docs.

    row names a column that tells rows apart; it is then the column row of the result.
    """
    own = ["row"] if row else []
    with Scratch(docs.sparkSession) as s:
        sizes = s.written(
            docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"), *([F.col(row).alias("row")] if row else [])),
            "sizes",
        )
        table = targets(sizes, s, weights, most)
        table = s.written(table.select(F.col("source").alias("__s"), "rank", "source_size", "target", F.greatest(F.lit(1), F.ceil(F.col("n_docs") / fan)).alias("groups")), "targets")
        rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
        equal = sizes.withColumn("n", F.lit(1).cast("bigint")) if row else sizes.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
        rows = (
            equal.join(table, equal["source"].eqNullSafe(table["__s"]))
            .withColumn("whole", F.floor(rate + _NEAR).cast("int"))
            .withColumn("p", F.when(F.col("size") > 0, F.greatest(F.lit(0.0), rate - F.col("whole"))).otherwise(0.0))
            .withColumn("p", F.when(F.col("p") < _NEAR, 0.0).otherwise(F.col("p")) * F.col("n"))
            .withColumn("ones", F.floor(F.col("p") + _NEAR))  # of n equal documents all but one become integral at once
            .withColumn("p", F.greatest(F.lit(0.0), F.col("p") - F.col("ones")))
            .withColumn("u", F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 53)) / F.lit(float(1 << 53)))
            .withColumn("part", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("doc_id"), F.col("size"), *own), F.col("groups")))
            .withColumn("done", F.col("p") < _NEAR)
            .drop("__s")
        )
        levels = [rows.where("done")]
        rest, groups = rows.where("not done"), table.agg(F.max("groups")).first()[0] or 1
        while True:
            last = groups == 1
            level = s.written(rest.groupBy("rank", "part").applyInArrow(_pairing(last), rows.schema), "mix")
            levels.append(level.where("done"))
            if last:
                break
            rest, groups = level.where("not done").withColumn("part", F.floor(F.col("part") / fan).cast("bigint")), math.ceil(groups / fan)
        out = levels[0]
        for level in levels[1:]:
            out = out.unionByName(level)
        out = s.written(out.select("doc_id", "source", "size", "source_size", "target", "whole", "n", "ones", "p", *own), "mixed", keep=True)
    return _spread(out, fan).withColumn("copies", F.col("whole") + F.round("p").cast("int")).drop("whole", "p").select("doc_id", "source", "size", "source_size", "target", "copies", *own)
