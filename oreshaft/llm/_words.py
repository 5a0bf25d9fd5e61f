"""Vectorised tokenising and hashing of Arrow text batches with numpy.

A batch's texts lie end to end in one UTF-8 buffer. Words are maximal runs of
bytes outside a separator set; all separators of the contracts are ASCII, so
bytes and code points give the same words. Words never cross a text's end.
Hashes are 64-bit polynomials with a final mix; where a result must be exact,
callers use two independent ones or compare the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 21
_BLOCK = 1 << 18
_U = np.uint64
_P = 0x9E3779B97F4A7C15
_Q = 0xD6E8FEB86659FD93


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ _U(salt & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(_P))
_powers = [np.ones(1, _U), np.ones(1, _U)]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if len(_powers[0]) < n:
        n = max(n, _BLOCK + 1)
        for k, base in enumerate((_P, pow(_P, -1, 1 << 64))):
            t = np.full(n, base, _U)
            t[0] = 1
            _powers[k] = np.multiply.accumulate(t)
    return _powers[0], _powers[1]


def separators(kept: str = "") -> np.ndarray:
    """256 flags: bytes that separate words; kept: 'alnum' keeps 0-9 a-z and all bytes from 0x80, else all but white space."""
    b = np.arange(256)
    if kept == "alnum":
        return ~(((b >= 48) & (b <= 57)) | ((b >= 97) & (b <= 122)) | (b >= 128))
    return ((b >= 9) & (b <= 13)) | (b == 32)


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


@dataclass
class Texts:
    """Some rows' texts: UTF-8 data, text bounds, and words as byte bounds and counts per text."""

    first: int
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    counts: np.ndarray

    @property
    def bounds(self) -> np.ndarray:
        """Word index at which each text starts, and the number of words."""
        return np.concatenate(([0], np.cumsum(self.counts)))

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        out, lo, n = np.empty(len(self.starts), _U), 0, len(self.starts)
        while lo < n:
            base = self.starts[lo]
            hi = max(lo + 1, int(np.searchsorted(self.ends, base + _BLOCK, "right")))
            seg = self.data[base : self.ends[hi - 1]]
            pw, inv = _tables(len(seg) + 1)
            c = np.zeros(len(seg) + 1, _U)
            np.cumsum(_BYTE[seg] * pw[: len(seg)], out=c[1:])
            s = self.starts[lo:hi] - base
            out[lo:hi] = (c[self.ends[lo:hi] - base] - c[s]) * inv[s]
            lo = hi
        return mix(out)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def texts(column: pa.Array, seps: np.ndarray, fold: bool, chunk_bytes: int = CHUNK_BYTES) -> Iterator[Texts]:
    """Runs of whole texts of about chunk_bytes bytes, or one longer text at a time."""
    if not len(column):
        return
    data, offsets = buffers(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + chunk_bytes, "right")) - 1)
        hi = min(hi, n)
        d, o = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        if fold:
            d = _FOLD[d]
        inside = ~seps[d]
        edge = np.zeros(len(d) + 1, bool)
        edge[o] = True
        start, end = inside.copy(), inside.copy()
        start[1:] &= ~inside[:-1] | edge[1:-1]
        end[:-1] &= ~inside[1:] | edge[1:-1]
        s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
        yield Texts(lo, d, o, s, e, np.diff(np.searchsorted(s, o)))
        lo = hi


def gram_hashes(h: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hash of each run of n consecutive entries, len(h) - n + 1 of them, by doubling."""
    if len(h) < n:
        return np.empty(0, _U)
    done, have, cur, size = None, 0, h, 1
    mul = pow(_Q, 1, 1 << 64)
    while True:
        if n & size:
            if done is None:
                done, have = cur, size
            else:
                m = len(h) - have - size + 1
                done = done[:m] * _U(mul) + cur[have : have + m]
                have += size
        if have == n:
            return mix(done[: len(h) - n + 1], salt ^ n)
        cur = cur[: len(cur) - size] * _U(mul) + cur[size:]
        mul = mul * mul % (1 << 64)
        size *= 2


def shingles(t: Texts, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct n-word shingle hashes, sorted, end to end, and their bounds.

    A text of fewer words, but not none, has its whole sequence as its one shingle.
    """
    sizes = np.where(t.counts >= n, t.counts - n + 1, np.minimum(t.counts, 1))
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    out = np.empty(bounds[-1], _U)
    g, wb = gram_hashes(h, n), t.bounds
    long = t.counts >= n
    if long.any():
        sz = sizes[long]
        at = np.repeat(wb[:-1][long] - (np.cumsum(sz) - sz), sz) + np.arange(sz.sum())
        out[np.repeat(long, sizes)] = g[at]
    for k in range(1, n):
        short = np.flatnonzero(t.counts == k)
        if len(short):
            out[bounds[short]] = gram_hashes(h, k)[wb[short]]
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a > 1:
            out[a:b].sort()
    fresh = np.ones(len(out), bool)
    fresh[1:] = out[1:] != out[:-1]
    fresh[bounds[:-1][sizes > 0]] = True
    return out[fresh], np.concatenate(([0], np.cumsum(fresh)))[bounds]


def map_texts(df, make, fields: dict, text: str = "text", carry: list[str] | None = None):
    """Arrow map: the columns carry (all by default) plus fields, computed from the text column.

    make() gives, in each task, a function from a string array to a list of arrays
    in the order of fields (name to Spark type). A carried column whose name a new
    one takes, in any letter case, is replaced by it.
    """
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    new = {n.lower() for n in fields}
    carry = [c for c in (df.columns if carry is None else carry) if c.lower() not in new]
    source = df.select(*(F.col(f"`{c}`") for c in carry), F.col(f"`{text}`").cast("string").alias("__text"))
    schema = T.StructType([df.schema[c] for c in carry])
    for name, kind in fields.items():
        schema.add(name, T.StructType.fromDDL(f"x {kind}")["x"].dataType)
    names = schema.names

    def run(batches):
        kernel = make()
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *kernel(b.columns[-1])], names=names)

    return source.mapInArrow(run, schema)


def lists(counts: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), values)
