"""Instruction validity of little-endian halfwords, block filter and what follows from it.

A halfword starts a 32-bit instruction if it is at least 0xE800 and the next one
is neither 0 nor 0xFFFF; the next one is then consumed. In a run of halfwords that
could all start one, every other does, beginning with the first; so the mask needs
no loop: a halfword's place in its run decides. Else it is valid if it is a 16-bit
instruction. Blocks are decoded where the blob is read, a batch at a time with
numpy, and only a row for each block leaves the task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values: (name, mask, value) of the halfwords counted in kept blocks.
SIGNATURES = (("pop_pc", 0xFF00, 0xBD00), ("bx_lr", 0xFFFF, 0x4770), ("mov_pc_lr", 0xFFFF, 0x46F7), ("push_lr", 0xFF00, 0xB500))

BLOCK = "array<struct<start:bigint,stop:bigint,halfwords:bigint,valid:bigint,counts:array<bigint>,counts_ok:array<bigint>>>"


def halfwords(content: bytes, offset: int) -> np.ndarray:
    """The blob behind its header, without an odd last byte, as little-endian halfwords."""
    n = max(0, len(content) - offset)
    return np.frombuffer(content, "<u2", n // 2, offset) if n >= 2 else np.empty(0, "<u2")


def validity(h: np.ndarray) -> np.ndarray:
    if not len(h):
        return np.zeros(0, bool)
    following = np.append(h[1:], 0)
    could = (h >= 0xE800) & (following != 0) & (following != 0xFFFF)
    at = np.arange(len(h))
    before = np.maximum.accumulate(np.where(could, -1, at))  # last place outside a run, -1 for none
    starts = could & ((at - before) % 2 == 1)
    consumed = np.append(False, starts[:-1])
    return starts | (~consumed & ((h < 0xC000) | ((h >= 0xD000) & (h < 0xE800))))


def block_size(block_bytes: int, rule: str = "down") -> int:
    """An even block size: odd sizes go down, at least 2; with rule up they go up, at least 256."""
    return max(2, block_bytes - block_bytes % 2) if rule == "down" else max(256, block_bytes) + max(256, block_bytes) % 2


def blocks(blobs: DataFrame, offset: int = 6001, block_bytes: int = 2048, rule: str = "down") -> DataFrame:
    """One row for each block: blobs' columns but content, block, start and stop (file offsets), halfwords, valid, ratio, counts, counts_ok.

    A blob that ends within its header has no blocks; a null content is empty.
    """
    size = block_size(block_bytes, rule) // 2
    keep = [c for c in blobs.columns if c != "content"]

    def run(batches):
        for b in batches:
            rows = []
            for content in b.column(len(keep)):
                h = halfwords(content.as_py() or b"", offset)
                ok, first = validity(h), np.arange(0, len(h), size)
                if not len(h):
                    rows.append([])
                    continue
                n = np.diff(np.append(first, len(h)))
                hits = [(h & m) == v for _, m, v in SIGNATURES]
                both = [[np.add.reduceat(x.astype(np.int64), first) for x in xs] for xs in (hits, [x & ok for x in hits])]
                valid = np.add.reduceat(ok.astype(np.int64), first)
                rows.append([{"start": offset + 2 * int(a), "stop": offset + 2 * int(a + k), "halfwords": int(k), "valid": int(v), "counts": [int(x[i]) for x in both[0]], "counts_ok": [int(x[i]) for x in both[1]]} for i, (a, k, v) in enumerate(zip(first, n, valid))])
            counts, pair = pa.int64(), pa.list_(pa.int64())
            kind = pa.list_(pa.struct([("start", counts), ("stop", counts), ("halfwords", counts), ("valid", counts), ("counts", pair), ("counts_ok", pair)]))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(rows, kind)], names=[*keep, "blocks"])

    from pyspark.sql import types as T

    schema = T.StructType([blobs.schema[c] for c in keep]).add("blocks", T.StructType.fromDDL(f"x {BLOCK}")["x"].dataType)
    cut = blobs.select(*keep, "content").mapInArrow(run, schema)
    return cut.select(*keep, F.posexplode("blocks").alias("block", "b")).select(*keep, "block", "b.*").withColumn("ratio", F.col("valid") / F.col("halfwords"))


def kept(table: DataFrame, min_ratio: float = 0.9) -> DataFrame:
    return table.where(F.col("ratio") >= min_ratio)


def block_meta(table: DataFrame, by: list[str], min_ratio: float = 0.9) -> DataFrame:
    """kept_blocks, total_blocks, kept_bytes, total_bytes, kept_fraction of each blob."""
    good = F.col("ratio") >= min_ratio
    sums = table.groupBy(*by).agg(
        F.count_if(good).alias("kept_blocks"), F.count("*").alias("total_blocks"),
        F.coalesce(F.sum(F.when(good, 2 * F.col("halfwords"))), F.lit(0)).alias("kept_bytes"), F.sum(2 * F.col("halfwords")).alias("total_bytes"),
    )
    return sums.withColumn("kept_fraction", F.col("kept_bytes") / F.col("total_bytes"))


def codeonly_map(table: DataFrame, by: list[str], min_ratio: float = 0.9) -> DataFrame:
    """Where each kept block goes in the concatenation of its blob's kept blocks."""
    size = F.col("stop") - F.col("start")
    until = F.sum(size).over(Window.partitionBy(*by).orderBy("start").rowsBetween(Window.unboundedPreceding, 0))
    return kept(table, min_ratio).select(*by, (until - size).alias("out_start"), until.alias("out_end"), F.col("start").alias("src_start"), F.col("stop").alias("src_end"), size.alias("len"))


def codeonly_blobs(blobs: DataFrame, table: DataFrame, by: list[str], min_ratio: float = 0.9, write_empty: bool = False) -> DataFrame:
    """Each blob's kept blocks, end to end, as content; blobs without any only with write_empty."""
    spans = kept(table, min_ratio).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    joined = blobs.join(spans, by, "left" if write_empty else "inner")
    piece = lambda s: F.hex(F.substring(F.col("content"), (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int")))
    text = F.array_join(F.transform(F.coalesce("spans", F.array().cast("array<struct<start:bigint,stop:bigint>>")), piece), "")
    return joined.select(*by, F.unhex(text).alias("content"))


def return_rates(table: DataFrame, by: str = "device", min_ratio: float = 0.9, only_ok: bool = False) -> DataFrame:
    """Return signatures for each 1000 halfwords of kept blocks, and the kept fraction."""
    good, counts = F.col("ratio") >= min_ratio, F.col("counts_ok" if only_ok else "counts")
    words = F.coalesce(F.sum(F.when(good, F.col("valid" if only_ok else "halfwords"))), F.lit(0))
    sums = table.groupBy(by).agg(
        (F.coalesce(F.sum(F.when(good, 2 * F.col("halfwords"))), F.lit(0)) / F.sum(2 * F.col("halfwords"))).alias("kept_frac"), words.alias("total_halfwords_counted"),
        *(F.coalesce(F.sum(F.when(good, F.get(counts, F.lit(i)))), F.lit(0)).alias(name) for i, (name, _, _) in enumerate(SIGNATURES)),
    )
    per = [(1000.0 * F.col(name) / F.greatest("total_halfwords_counted", F.lit(1))).alias(f"{name}_per_1k") for name, _, _ in SIGNATURES]
    return sums.select(by, "kept_frac", "total_halfwords_counted", *per)
