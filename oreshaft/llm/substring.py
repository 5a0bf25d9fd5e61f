"""Exact dedup of repeated word sequences by seed and extend.

A window is `least` consecutive words. Anchors are winnowed K-word grams: every
window contains exactly the grams of one winnowing window, so each window has one
anchor, its least gram (the last of equals), wherever the same words stand. A
document is so cut into runs of windows with one anchor. Runs are the rows:
anchor, a hash of all words that its windows cover (the run's context), document.

Seeds: runs are joined on their anchor. Extension: where the whole context of a
run occurs in a smaller document, the match extends over the run both ways, and
all its windows are covered at once. Else, if the anchor occurs in other contexts
too, the extension ends somewhere inside the run: one run of each such context
(that of the smallest document) is opened into its windows, which are matched one
by one. Both joins are reductions by key to the smallest doc_id, done before the
shuffle in part, so no pairs of documents arise, however many share a passage.
Covered windows that touch make up maximal repeats, whose words are removed.

Texts are read twice: once for the runs, which are written, and once for those
that have a run to open or to cut, which are shuffled once and kept in buckets for
both. Inside opened runs a match is extended window by window, by hash, and not word
by word: the occurrences of a frequent anchor never have to meet. Contexts, grams and
windows are told apart by 64-bit hashes of 64-bit word hashes, contexts by two.

Nulls: a null text has no words. A null doc_id counts as the largest. Rows with
one doc_id are one document, whose repeats of itself stay. Texts of fewer than
`least` words lose nothing. doc_ids are integers. An empty table gives an empty
result; other columns of docs are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch
from ._words import Texts, gram_hashes, lists, map_texts, mix, separators, texts

LEAST = 50
K = 10
RUN = "array<struct<anchor:bigint,context:bigint,check:int,first:int,last:int>>"


def anchors(h: np.ndarray, least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(gram hashes, position of each window's anchor) over all words, whatever their text."""
    g = gram_hashes(h, k)
    span = least - k + 1
    n = len(g) - span + 1
    if n <= 0:
        return g, np.empty(0, np.int64)
    bits = np.uint64(32)  # fixed, so that every batch orders grams alike
    low = (np.uint64(1) << bits) - np.uint64(1)
    cur = (g >> bits << bits) | (low - np.arange(len(g), dtype=np.uint64))  # of equals the last is least
    size, out, have, left = 1, None, 0, span
    while left:
        if left & 1:
            if out is None:
                out, have = cur, size
            else:
                m = min(len(out), len(cur) - have)
                out, have = np.minimum(out[:m], cur[have : have + m]), have + size
        left >>= 1
        if left:
            cur = np.minimum(cur[:-size], cur[size:])
            size *= 2
    return g, (low - (out[:n] & low)).astype(np.int64)


def window_runs(t: Texts, h: np.ndarray, least: int, k: int):
    """(anchor position, first window, last window, text) of each run, by word index in the batch."""
    g, at = anchors(h, least, k)
    n = len(at)
    bounds = t.bounds
    doc = t.doc
    ok = doc[:n] == doc[least - 1 : least - 1 + n] if n else np.zeros(0, bool)
    starts = np.flatnonzero(ok)
    if not len(starts):
        return g, *(np.empty(0, np.int64) for _ in range(4)), bounds
    new = np.ones(len(starts), bool)
    new[1:] = (at[starts[1:]] != at[starts[:-1]]) | (doc[starts[1:]] != doc[starts[:-1]])
    a = np.flatnonzero(new)
    first, last = starts[a], starts[np.append(a[1:], len(starts)) - 1]
    return g, at[first], first, last, doc[first], bounds


def _context(h: np.ndarray, first: np.ndarray, last: np.ndarray, at: np.ndarray, least: int, salt: int) -> np.ndarray:
    """Hash of the words from first to last + least - 1 and of where in them the anchor is."""
    n = last - first + least
    x = mix(h, salt)
    p, q = _powers(len(x) + 1)
    c = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * p[: len(x)], out=c[1:])
    body = (c[first + n] - c[first]) * q[first]
    return mix(body ^ mix((n * 4096 + (at - first)).astype(np.uint64), salt + 1))


_BASE = 0xC2B2AE3D27D4EB4F
_held = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_held[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            t = np.full(n, base, np.uint64)
            t[0] = 1
            _held[i] = np.multiply.accumulate(t)
    return _held[0], _held[1]


def _runner(least: int, k: int):
    """Each text's number of words, digest of all its words, and runs."""
    seps = separators()

    def kernel(column):
        words, digest, counts, cols = [], [], [], [[] for _ in range(5)]
        for t in texts(column, seps, False):
            words.append(t.counts)
            digest += [hashlib.sha256(x).hexdigest() for x in kept_texts(t, np.ones(len(t.starts), bool))]
            h = t.hashes()
            g, at, first, last, doc, bounds = window_runs(t, h, least, k)
            context, check = (_context(h, first, last, at, least, s).view(np.int64) for s in (5, 9)) if len(at) else (at, at)
            for c, v in zip(cols, (g[at].view(np.int64) if len(at) else at, context, check & 0x7FFFFFFF, first - bounds[doc], last - bounds[doc])):
                c.append(v)
            counts.append(np.bincount(doc, minlength=len(t.counts)))
        arrays = [pa.array(np.concatenate(c).astype(np.int64 if i < 2 else np.int32)) for i, c in enumerate(cols)]
        runs = lists(np.concatenate(counts), pa.StructArray.from_arrays(arrays, ["anchor", "context", "check", "first", "last"]))
        return [pa.array(np.concatenate(words).astype(np.int64)), pa.array(digest, pa.string()), runs]

    return kernel


def kept_texts(t: Texts, keep: np.ndarray):
    """Each text's kept words joined by one space, as bytes."""
    # each kept word with one space before it, cut per text, without the first space
    s, e = t.starts[keep], t.ends[keep]
    n = e - s + 1
    total = int(n.sum())
    out = np.full(total, 32, np.uint8)
    begin = np.cumsum(n) - n
    at = np.arange(total) - np.repeat(begin, n)
    inside = at > 0
    out[inside] = t.data[(np.repeat(s, n) + at - 1)[inside]]
    kept = np.concatenate(([0], np.cumsum(keep)))[t.bounds]
    cut = np.append(begin, total)[kept]
    raw = out.tobytes()
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        yield raw[a + 1 : b]


def _opener(least: int):
    """Rows (did, tid, runs to open, text) to their windows (did, tid, window, check, first)."""
    seps = separators()

    def run(batches):
        for b in batches:
            runs, rows, found = b.column(2).to_pylist(), [], [[], [], []]
            for t in texts(b.column(3), seps, False):
                h, bounds = t.hashes(), t.bounds
                both = gram_hashes(h, least).view(np.int64), gram_hashes(mix(h, 9), least).view(np.int64)
                for i in range(len(t.counts)):
                    at = np.unique(np.concatenate([np.arange(r["first"], r["last"] + 1) for r in runs[t.first + i]]))
                    rows.append(np.full(len(at), t.first + i))
                    for c, v in zip(found, (*(x[bounds[i] + at] for x in both), at)):
                        c.append(v)
            if rows:
                who = pa.array(np.concatenate(rows))
                window, check, first = map(np.concatenate, found)
                yield pa.RecordBatch.from_arrays([b.column(0).take(who), b.column(1).take(who), pa.array(window), pa.array((check & 0x7FFFFFFF).astype(np.int32)), pa.array(first.astype(np.int32))], names=["did", "tid", "window", "check", "first"])

    return run


def _cutter(least: int):
    """Rows (did, tid, covered window ranges, text) to (did, tid, n_removed, removed, kept_sha256)."""
    seps = separators()

    def run(batches):
        for b in batches:
            ranges, removed, counts, starts, ends, digest = b.column(2).to_pylist(), [], [], [], [], []
            for t in texts(b.column(3), seps, False):
                n, bounds, doc = len(t.starts), t.bounds, t.doc
                cover = np.zeros(n + 1, np.int64)
                for i in range(len(t.counts)):
                    for r in ranges[t.first + i]:
                        cover[bounds[i] + r["first"]] += 1
                        cover[bounds[i] + r["last"] + least] -= 1
                gone = np.cumsum(cover[:-1]) > 0
                edge = np.zeros(n + 1, bool)
                edge[bounds] = True
                a = np.flatnonzero(gone & (np.concatenate(([True], ~gone[:-1])) | edge[:-1])) if n else np.empty(0, np.int64)
                e = np.flatnonzero(gone & (np.concatenate((~gone[1:], [True])) | edge[1:])) + 1 if n else a
                removed.append(np.bincount(doc[gone], minlength=len(t.counts)))
                counts.append(np.bincount(doc[a], minlength=len(t.counts)))
                starts.append(a - bounds[doc[a]])
                ends.append(e - bounds[doc[a]])
                digest += [hashlib.sha256(x).hexdigest() for x in kept_texts(t, ~gone)]
            if digest:
                spans = pa.StructArray.from_arrays([pa.array(np.concatenate(x).astype(np.int32)) for x in (starts, ends)], ["start", "end"])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.concatenate(removed).astype(np.int64)), lists(np.concatenate(counts), spans), pa.array(digest)], names=["did", "tid", "n_removed", "removed", "sha"])

    return run


LAST = (1 << 63) - 1
SPANS = "array<struct<start:int,end:int>>"


def repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = LEAST, k: int = K) -> DataFrame:
    """(doc_id, n_words, n_removed, removed, kept_sha256), a row for each row of docs.

    removed holds the maximal repeats as word spans, end exclusive; kept_sha256 is
    that of the other words joined by one space.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(doc_id).cast("bigint"), F.lit(LAST)).alias("did"), F.xxhash64(text).alias("tid"), F.col(text).alias("text"))
    who = ["did", "tid"]
    with Scratch(spark) as s:
        first = s.written(map_texts(base, lambda: _runner(least, k), {"n_words": "bigint", "whole_sha": "string", "runs": RUN}, carry=["doc_id", *who]), "runs", keep=True)
        runs = first.select(*who, F.explode("runs").alias("r")).select(*who, "r.*")
        contexts = runs.groupBy("anchor", "context", "check").agg(F.min("did").alias("owner"), F.max("did").alias("other"))
        # written, so that Spark can split the contexts of a frequent anchor in the join
        ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("did", "context", "check") for f in (F.min, F.max)]
        several = runs.groupBy("anchor").agg(*ends).where("min_did <> max_did and (min_context <> max_context or min_check <> max_check)")
        several = s.written(several.select("anchor", F.lit(True).alias("open")), "several")
        shared = s.written(contexts.join(several, "anchor", "left").where("owner <> other or open").select("context", "check", "owner", F.coalesce("open", F.lit(False)).alias("open")), "contexts")
        piece = F.struct("first", "last")
        marks = runs.drop("anchor").join(shared, ["context", "check"]).where("owner < did or open")
        marks = s.written(
            marks.groupBy(*who).agg(
                F.collect_set(F.when(F.col("owner") < F.col("did"), piece)).alias("covered"),
                F.collect_set(F.when(F.col("owner") == F.col("did"), piece)).alias("open"),
            ), "marks",
        )
        wanted = base.select(*who, "text").join(marks.select(*who), who, "left_semi").dropDuplicates()
        full = s.bucketed(wanted, "repeat_texts", parts, *who)
        opened = marks.where(F.size("open") > 0).select(*who, "open").join(full, who).select(*who, "open", "text")
        windows = s.written(opened.mapInArrow(_opener(least), "did bigint, tid bigint, window bigint, check int, first int"), "windows")
        earliest = windows.groupBy("window", "check").agg(F.min("did").alias("owner"), F.max("did").alias("other")).where("owner <> other").drop("other")
        hits = windows.join(earliest, ["window", "check"]).where("owner < did").groupBy(*who).agg(F.collect_set(F.struct("first", F.col("first").alias("last"))).alias("more"))
        none = F.array().cast("array<struct<first:int,last:int>>")
        covered = marks.join(hits, who, "left").select(*who, F.concat("covered", F.coalesce("more", none)).alias("covered")).where(F.size("covered") > 0)
        cut = covered.join(full, who).select(*who, "covered", "text")
        cut = s.written(cut.mapInArrow(_cutter(least), f"did bigint, tid bigint, n_removed bigint, removed {SPANS}, sha string"), "cut", keep=True)
    return first.select("doc_id", *who, "n_words", "whole_sha").join(cut, who, "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce("removed", F.array().cast(SPANS)).alias("removed"), F.coalesce("sha", "whole_sha").alias("kept_sha256"),
    )
