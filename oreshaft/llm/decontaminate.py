"""Benchmark decontamination by Wu-Manber search over word sequences.

Every window of 13 consecutive words of a benchmark item is a pattern (an item
of fewer words is one pattern). Patterns of one length share a searcher: a shift
table over blocks of two words tells how far a position can be skipped, a
position whose block ends some pattern selects that block's suffix bucket, and
the bucket's patterns are compared directly, word by word by hash and then
byte by byte. All texts of a batch advance together, in lanes of a few hundred
words, so that the search is a few numpy operations a step. Patterns are places in
the benchmark's text; equal ones, by 128-bit hash, are one.

The benchmark is taken in groups of at most GROUP_BYTES of text, which alone bound
what is broadcast, and what a task holds at a time: a group's searchers, of about
ten times its text. Items are cut into overlapping pieces that fit. A benchmark of
one group is searched as the documents stream by, without a shuffle; with more
groups the documents pass once for each, written out in between with the hits so
far, in time linear in the number of groups.

Nulls: a null text has no words; an item with a null text has no pattern; a null
item_id is listed as "null". Items with one item_id are one item. Repeated
documents are each judged. Empty tables give no hits or no rows; columns named
n_words, hit_spans or hit_items are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import Scratch
from ._words import Texts, gram_hashes, lists, mix, separators, texts

GROUP_BYTES = 16 << 20
PIECE_BYTES = 1 << 20
LANE = 256
SPANS = "array<struct<start:int,end:int>>"


def expand(at: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(at repeated, every integer of its range start to stop)"""
    n = stops - starts
    return np.repeat(at, n), np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Searcher:
    """Patterns of m words: those of source from each word of first on; item: the item of each."""

    def __init__(self, source: Texts, h: np.ndarray, first: np.ndarray, item: np.ndarray, m: int):
        self.source, self.h, self.m, self.block = source, h, m, min(2, m)
        x, y = gram_hashes(h, m)[first], gram_hashes(mix(h, 9), m)[first]
        order = np.lexsort((y, x))
        first, item, x, y = first[order], item[order], x[order], y[order]
        new = np.ones(len(first), bool)
        new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        self.first, self.item, self.group = first[new], item, np.append(np.flatnonzero(new), len(first))
        blocks = gram_hashes(h, self.block) if self.block > 1 else h
        self.mask = np.uint64((1 << min(24, max(12, (8 * len(h)).bit_length()))) - 1)
        self.shift = np.full(int(self.mask) + 1, m - self.block + 1, np.uint8)
        for j in range(m - self.block, -1, -1):
            self.shift[(blocks[self.first + (m - self.block - j)] & self.mask).astype(np.int64)] = j
        last = blocks[self.first + (m - self.block)]
        self.order = np.argsort(last, kind="stable")
        self.suffix = last[self.order]

    def find(self, t: Texts, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, pattern) of each occurrence."""
        m, b = self.m, self.block
        blocks = gram_hashes(h, b) if b > 1 else h
        bounds, last = t.bounds[:-1], t.counts - m  # last: largest start inside the text
        ok = last >= 0
        lanes = last[ok] // LANE + 1
        within = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        pos = np.repeat(bounds[ok], lanes) + within * LANE
        stop = np.minimum(pos + LANE - 1, np.repeat(bounds[ok] + last[ok], lanes))
        seen = []
        while len(pos):
            s = self.shift[(blocks[pos + (m - b)] & self.mask).astype(np.int64)]
            if (hit := s == 0).any():
                seen.append(pos[hit])
            pos = pos + np.maximum(s, 1)
            live = pos <= stop
            pos, stop = pos[live], stop[live]
        if not seen:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.concatenate(seen)
        key = blocks[at + (m - b)]
        at, k = expand(at, np.searchsorted(self.suffix, key), np.searchsorted(self.suffix, key, "right"))
        pat = self.order[k]
        for j in range(m):
            same = h[at + j] == self.h[self.first[pat] + j]
            at, pat = at[same], pat[same]
        sure = np.ones(len(at), bool)
        for j in range(m):
            sure &= self._same(t, at + j, self.first[pat] + j)
        return at[sure], pat[sure]

    def _same(self, t: Texts, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words a of t and b of the source have the same bytes."""
        s = self.source
        out = (n := t.ends[a] - t.starts[a]) == s.ends[b] - s.starts[b]
        i, at = expand(np.flatnonzero(out), t.starts[a[out]], t.ends[a[out]])
        j = np.repeat(s.starts[b[out]], n[out]) + at - np.repeat(t.starts[a[out]], n[out])
        out[i[t.data[at] != s.data[j]]] = False
        return out


def searchers(group: list[tuple[int, str]], window: int) -> list[Searcher]:
    """One searcher for each pattern length of the pieces (item, text) of a group."""
    seps, by = separators("alnum"), {}
    for t in texts(pa.array([x for _, x in group], pa.string()), seps, True, 1 << 62):
        h, bounds, own = t.hashes(), t.bounds, np.array([i for i, _ in group])
        for m in np.unique(np.minimum(t.counts, window)).tolist():
            if m:
                some = np.flatnonzero(np.minimum(t.counts, window) == m)
                item, first = expand(own[some], bounds[some], bounds[some] + t.counts[some] - m + 1)
                by[m] = Searcher(t, h, first, item, m)
    return list(by.values())


def _searching(names: list[str], held, window: int):
    """Rows of names, then text, hit_spans and hit_items so far, to the same with this group's hits and n_words."""
    seps = separators("alnum")

    def found_in(t: Texts, group: list[Searcher], spans: list, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Spans as (text, start, end) and items as (text, rank), all by text."""
        h, n = t.hashes(), len(t.starts)
        cover, doc, bounds = np.zeros(n + 1, np.int64), t.doc, t.bounds
        np.add.at(cover, np.repeat(bounds[:-1], counts) + spans[0], 1)
        np.add.at(cover, np.repeat(bounds[:-1], counts) + spans[1], -1)
        pairs = [np.empty((0, 2), np.int64)]
        for s in group:
            at, pat = s.find(t, h)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + s.m, -1)
            met = np.unique(np.stack([doc[at], pat], 1), axis=0)
            i, k = expand(met[:, 0], s.group[met[:, 1]], s.group[met[:, 1] + 1])
            pairs.append(np.unique(np.stack([i, s.item[k]], 1), axis=0))
        hit = np.cumsum(cover[:-1]) > 0
        edge = np.zeros(n + 1, bool)
        edge[bounds] = True
        before, after = np.concatenate(([False], hit[:-1])) if n else hit, np.concatenate((hit[1:], [False])) if n else hit
        a = np.flatnonzero(hit & (~before | edge[:-1]))
        e = np.flatnonzero(hit & (~after | edge[1:])) + 1
        items = np.unique(np.concatenate(pairs), axis=0)
        return doc[a], a - bounds[doc[a]], e - bounds[doc[a]], items[:, 0], items[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names_of, pieces = held.value
        group, known = searchers(pieces, window), pa.array(names_of, pa.string())
        for b in batches:
            at = len(names)
            old, said = b.column(at + 1), b.column(at + 2).to_pylist()
            bounds, ends = old.offsets.to_numpy(), [old.values.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1)]
            words, counts, starts, stops, names_n, item_names = [], [], [], [], [], []
            for t in texts(b.column(at), seps, True):
                lo, hi = t.first, t.first + len(t.counts)
                prior = [x[bounds[lo] : bounds[hi]] for x in ends]
                doc, start, end, who, item = found_in(t, group, prior, np.diff(bounds[lo : hi + 1]))
                words.append(t.counts)
                counts.append(np.bincount(doc, minlength=hi - lo))
                starts.append(start)
                stops.append(end)
                own = np.split(item, np.searchsorted(who, np.arange(1, hi - lo)))
                for i, x in enumerate(own):
                    every = known.take(pa.array(x)).to_pylist()
                    if said[lo + i]:
                        every = sorted({*every, *said[lo + i]})
                    names_n.append(len(every))
                    item_names += every
            if words:
                spans = pa.StructArray.from_arrays([pa.array(np.concatenate(x).astype(np.int32)) for x in (starts, stops)], ["start", "end"])
                made = [pa.array(np.concatenate(words).astype(np.int64)), lists(np.concatenate(counts), spans), lists(np.array(names_n), pa.array(item_names, pa.string()))]
                yield pa.RecordBatch.from_arrays([*b.columns[: at + 1], *made], names=[*names, "__text", "n_words", "hit_spans", "hit_items"])

    return run


def _cutter(window: int, piece_bytes: int):
    """Rows (item, text) to rows (item, piece): pieces of about piece_bytes, every window in one of them."""
    seps = separators("alnum")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items, pieces = [], []
            for t in texts(b.column(1), seps, True):
                for i, (lo, hi) in enumerate(zip(t.bounds[:-1].tolist(), t.bounds[1:].tolist())):
                    while lo < hi:
                        end = min(hi, max(lo + window, int(np.searchsorted(t.ends, t.starts[lo] + piece_bytes))))
                        items.append(t.first + i)
                        pieces.append(t.data[t.starts[lo] : t.ends[end - 1]].tobytes())
                        lo = hi if end == hi else end - window + 1
            if items:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(items)), pa.array(pieces, pa.binary()).cast(pa.string())], names=["item", "piece"])

    return run


def groups(benchmark: DataFrame, window: int, group_bytes: int = GROUP_BYTES, piece_bytes: int = PIECE_BYTES) -> Iterator[tuple[list[str], list[tuple[int, str]]]]:
    """The benchmark group by group: sorted item names, and pieces with the index of their item."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text").cast("string").alias("text")).where("text is not null").mapInArrow(_cutter(window, piece_bytes), "item string, piece string")
    group, size = [], 0

    def closed() -> tuple[list[str], list[tuple[int, str]]]:
        names = sorted({i for i, _ in group})
        rank = {n: k for k, n in enumerate(names)}
        return names, [(rank[i], p) for i, p in group]

    for item, piece in rows.toLocalIterator():
        if group and size + len(piece.encode()) > group_bytes:
            yield closed()
            group, size = [], 0
        group.append((item, piece))
        size += len(piece.encode())
    yield closed()


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = 13, text: str = "text", carry: list[str] | None = None, group_bytes: int = GROUP_BYTES, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """docs' columns (or carry) with n_words, hit_spans (maximal runs of hit words, end exclusive) and hit_items (sorted ids)."""
    spark = docs.sparkSession
    new = ("n_words", "hit_spans", "hit_items", "__text")
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() not in new]
    source = docs.select(*(f"`{c}`" for c in carry), F.col(f"`{text}`").cast("string").alias("__text"))
    none = [F.array().cast(SPANS).alias("hit_spans"), F.array().cast("array<string>").alias("hit_items")]
    schema = T.StructType([*source.schema]).add("n_words", "long").add("hit_spans", T.StructType.fromDDL(f"x {SPANS}")["x"].dataType).add("hit_items", T.ArrayType(T.StringType()))
    more = groups(benchmark, window, group_bytes, piece_bytes)
    group, frame, first, s = next(more), source.select("*", *none), True, Scratch(spark)
    with s:
        while True:
            following = next(more, None)
            held = spark.sparkContext.broadcast(group)
            frame = frame.mapInArrow(_searching(carry, held, window), schema)
            if following is None:
                return frame.drop("__text") if first else s.written(frame.drop("__text"), "hits", keep=True)
            frame, group, first = s.written(frame, "hits").drop("n_words"), following, False
            held.destroy()


def judged(found: DataFrame, least: int = 20) -> DataFrame:
    """n_hit and contaminated: some word is hit, and at least one in `least`."""
    n = F.aggregate("hit_spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    return found.withColumn("n_hit", n).withColumn("contaminated", (F.col("n_hit") > 0) & (least * F.col("n_hit") >= F.col("n_words")))
