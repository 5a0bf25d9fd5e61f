"""Histograms, distances between devices, entropy, autocorrelation and phases of byte series."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import distances as D
from .decode import block_size, halfwords, validity


def _counts(blobs: DataFrame, by: str, pick) -> DataFrame:
    """(by, b, n, files) summed over blobs: pick maps a blob's content to the byte array that counts."""
    schema = T.StructType([blobs.schema[by]]).add("b", "integer").add("n", "long").add("files", "long")

    def run(batches):
        for batch in batches:
            keys, total, files = {}, [], []
            for key, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                chosen = pick(content.as_py() or b"")
                if len(chosen):
                    i = keys.setdefault(key, len(keys))
                    if i == len(total):
                        total.append(np.zeros(256, np.int64))
                        files.append(0)
                    total[i] += np.bincount(chosen, minlength=256)
                    files[i] += 1
            rows = [(k, b, int(total[i][b]), files[i]) for k, i in keys.items() for b in np.flatnonzero(total[i]).tolist()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64()))], names=[by, "b", "n", "files"])

    return blobs.select(by, "content").mapInArrow(run, schema)


def histogram(blobs: DataFrame, by: str = "device", offset: int = 0) -> DataFrame:
    """(by, b, n): bytes behind the header, counted where the blobs are read and summed by key."""
    return _counts(blobs, by, lambda c: np.frombuffer(c, np.uint8)[offset:]).groupBy(by, "b").agg(F.sum("n").alias("n"))


def files_counted(blobs: DataFrame, by: str = "device", offset: int = 0) -> DataFrame:
    """(by, num_files): blobs with bytes behind the header."""
    return blobs.where(F.octet_length("content") > offset).groupBy(by).agg(F.count("*").alias("num_files"))


def codeonly_histogram(blobs: DataFrame, by: str = "device", offset: int = 6000, block_bytes: int = 4096, min_ratio: float = 0.8, rule: str = "up") -> DataFrame:
    """(by, b, n) over the kept blocks of blobs that have any."""
    size = block_size(block_bytes, rule) // 2

    def pick(content: bytes) -> np.ndarray:
        h = halfwords(content, offset)
        if not len(h):
            return np.empty(0, np.uint8)
        first = np.arange(0, len(h), size)
        n = np.diff(np.append(first, len(h)))
        good = np.add.reduceat(validity(h).astype(np.int64), first) / n >= min_ratio
        return np.frombuffer(h[np.repeat(good, n)].tobytes(), np.uint8)

    return _counts(blobs, by, pick).groupBy(by, "b").agg(F.sum("n").alias("n"))


def normalised(hist: DataFrame, by: str = "device") -> DataFrame:
    """(by, p): 256 shares; all zero where nothing was counted."""
    held = hist.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("b", "n"))).alias("m"), F.sum("n").alias("t"))
    share = lambda b: F.coalesce(F.try_divide(F.coalesce(F.try_element_at("m", b), F.lit(0)).cast("double"), F.col("t")), F.lit(0.0))
    return held.select(by, F.transform(F.sequence(F.lit(0), F.lit(255)), share).alias("p"))


METRICS = {"jsd": D.js_distance, "chi2": D.chi2, "cosine": D.cosine, "sorted_cosine": D.sorted_cosine}


def similarity(shares: DataFrame, metrics: list[str], by: str = "device") -> DataFrame:
    """(d1, d2, metric columns) of every two keys, both ways and with themselves; half of it is computed and mirrored.

    The keys are devices; their histograms are a few kilobytes each, and Spark
    broadcasts one side only if it is small.
    """
    a, b = shares.select(F.col(by).alias("d1"), F.col("p").alias("p1")), shares.select(F.col(by).alias("d2"), F.col("p").alias("p2"))
    half = a.join(b, F.col("d1") <= F.col("d2")).select("d1", "d2", *(METRICS[m](F.col("p1"), F.col("p2")).alias(m) for m in metrics))
    mirrored = half.where("d1 < d2").select(F.col("d2").alias("d1"), F.col("d1").alias("d2"), *metrics)
    return half.unionByName(mirrored)


def closest(pairs: DataFrame, metric: str, descending: bool = False, top: int = 10) -> DataFrame:
    """The top unordered pairs; ties by name, both orders reversed together."""
    order = [F.col(metric).desc(), F.col("d1").desc(), F.col("d2").desc()] if descending else [metric, "d1", "d2"]
    return pairs.where("d1 < d2").orderBy(*order).limit(top)


def byte_entropy(counts: DataFrame, by: list[str], n: str = "n") -> DataFrame:
    """(by, entropy) of counts grouped by `by`."""
    total = counts.groupBy(*by).agg(F.sum(n).alias("__t"), F.sum(F.col(n) * F.log2(F.col(n).cast("double"))).alias("__l"))
    return total.select(*by, (F.log2(F.col("__t").cast("double")) - F.col("__l") / F.col("__t")).alias("entropy"))


#: Rows that a task makes before they leave it.
GIVEN = 1 << 16


def _series(blobs: DataFrame, kernel, **columns: str) -> DataFrame:
    """blobs' columns but content, with a row for each place of the arrays that kernel(bytes as an array) gives, named by columns.

    Rows leave a task GIVEN at a time, whatever the number of blobs in a batch.
    """
    keep = [c for c in blobs.columns if c != "content"]
    schema = T.StructType([blobs.schema[c] for c in keep])
    for c, kind in columns.items():
        schema.add(c, kind)
    kinds = [pa.int32() if kind == "integer" else pa.float64() for kind in columns.values()]

    def run(batches):
        for b in batches:
            rows, parts, size = [], [], 0

            def made():
                at = pa.array(np.repeat(rows, [len(p[0]) for p in parts]))
                return pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in range(len(keep))), *(pa.array(np.concatenate(p), kind) for p, kind in zip(zip(*parts), kinds))], names=[*keep, *columns])

            for i, content in enumerate(b.column(len(keep))):
                for part in kernel(np.frombuffer(content.as_py() or b"", np.uint8)):
                    rows.append(i)
                    parts.append(part)
                    size += len(part[0])
                    if size >= GIVEN:
                        yield made()
                        rows, parts, size = [], [], 0
            if size:
                yield made()

    return blobs.select(*keep, "content").mapInArrow(run, schema)


def sliding_entropy(blobs: DataFrame, window: int = 2560, step: int = 16) -> DataFrame:
    """(…, off, entropy) at every step below length - window."""
    share = np.arange(1, window + 1) / window
    bits = np.concatenate([[0.0], -share * np.log2(share)])  # of a byte by its count in the window

    def kernel(x: np.ndarray):
        present = np.flatnonzero(np.bincount(x, minlength=256))
        code = np.zeros(256, np.int64)
        code[present] = np.arange(len(present))
        starts, last = np.arange(0, len(x) - window, step), None
        for lo in range(0, len(starts), WINDOWS):
            at = starts[lo : lo + WINDOWS]
            row = np.arange(len(at))[:, None]
            count = lambda a, n: np.bincount((row[: len(a)] * len(present) + code[x[a[:, None] + np.arange(n)]]).ravel(), minlength=len(at) * len(present)).reshape(len(at), -1)
            if step > window:
                counts = count(at, window)
            else:  # the window moves by one step: what leaves and what enters
                if last is None:
                    counts = np.zeros((len(at), len(present)), np.int64)
                    counts[0] = np.bincount(code[x[:window]], minlength=len(present))
                    counts[1:] = count(at[:-1] + window, step)[:-1] - count(at[:-1], step)[:-1]
                else:
                    counts = count(at - step + window, step) - count(at - step, step)
                    counts[0] += last
                counts = counts.cumsum(0)
                last = counts[-1]
            yield at, bits[counts].sum(1)

    return _series(blobs, kernel, off="integer", entropy="double")


#: Windows counted at a time.
WINDOWS = 1 << 12


def autocorrelation(blobs: DataFrame, max_lag: int = 64, header: int = 0) -> DataFrame:
    """(…, lag, r): Pearson correlation of a byte series with itself shifted; 0 where a variance is 0.

    Series shorter than max_lag + 2 have lags up to max(1, length - 2). Sums are
    exact: 64 bits hold them below EXACT bytes, and Python's integers beyond.
    """

    def kernel(x: np.ndarray):
        x = x[header:]
        n = len(x)
        if n < 3:
            yield np.array([1]), np.zeros(1)
            return
        lag = np.arange(1, (max_lag if n >= max_lag + 2 else max(1, n - 2)) + 1)
        v, kind = x.astype(np.float64), np.int64 if n < EXACT else object
        ends = lambda y: y[: len(lag)].astype(np.int64)
        a, c = ((int(x.sum(dtype=np.int64)) - np.cumsum(ends(y))).astype(kind) for y in (x[::-1], x))
        aa, cc = ((int(v @ v) - np.cumsum(ends(y) ** 2)).astype(kind) for y in (x[::-1], x))
        ac = np.array([int(v[:-d] @ v[d:]) for d in lag], np.int64).astype(kind)
        m = (n - lag).astype(kind)
        cov, va, vc = ((m * p - q).astype(np.float64) for p, q in ((ac, a * c), (aa, a * a), (cc, c * c)))
        some = (va > 0) & (vc > 0)
        yield lag, np.divide(cov, np.sqrt(va) * np.sqrt(vc), out=np.zeros(len(lag)), where=some)

    return _series(blobs, kernel, lag="integer", r="double")


#: Bytes up to which length times the sum of squares fits 63 bits.
EXACT = 10**7


def phase_scores(blobs: DataFrame, ks: tuple[int, ...] = (2, 3, 4, 5, 6, 7, 8), header: int = 0) -> DataFrame:
    """(…, k, score): mean divergence between the histograms of every two phases (index modulo k).

    All phases of all k make one matrix, with a column for each byte that occurs and one
    for those that don't, which are alike.
    """
    first = np.cumsum([0, *ks[:-1]])
    pairs = [(a + i, a + j) for a, k in zip(first, ks) for i in range(k) for j in range(i + 1, k)]
    one, two = np.array(pairs).T
    sizes = np.array([k * (k - 1) // 2 for k in ks])
    begin = np.cumsum(sizes) - sizes
    names = np.array(ks)

    def kernel(x: np.ndarray):
        x = x[header:]
        counts = np.array([np.bincount(x[j::k], minlength=256) for k in ks for j in range(k)])
        present = np.flatnonzero(counts.any(0))
        share = np.zeros((len(counts), len(present) + 1))
        share[:, :-1] = counts[:, present] / np.maximum(1, counts.sum(1))[:, None]
        weight = np.ones(len(present) + 1)
        weight[-1] = 256 - len(present)
        share += D.TINY
        share /= (share @ weight)[:, None]
        p, q = share[one], share[two]
        m = (p + q) / 2
        each = (p * np.log2(p / m) + q * np.log2(q / m)) @ weight / 2
        yield names, np.add.reduceat(each, begin) / sizes

    return _series(blobs, kernel, k="integer", score="double")


def best_k(scores: DataFrame, by: list[str]) -> DataFrame:
    """The first k with the greatest score."""
    return scores.groupBy(*by).agg(F.max_by("k", F.struct("score", -F.col("k"))).alias("best_k"))


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in columns})
