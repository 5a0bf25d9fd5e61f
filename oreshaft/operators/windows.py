"""Byte patterns over batches of hexadecimal text, with numpy: windows as pairs of longs, masks, first matches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CELLS = 1 << 22
_NIBBLE = np.zeros(256, np.uint8)
_NIBBLE[np.frombuffer(b"0123456789abcdef", np.uint8)] = np.arange(16)


def rows_of(hexed: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row numbers, bytes as a matrix with zeros behind, lengths) of some rows at a time, shorter ones first."""
    _, offs, data = hexed.buffers()
    offsets = np.frombuffer(offs, np.int64 if pa.types.is_large_string(hexed.type) else np.int32)[hexed.offset : hexed.offset + len(hexed) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    length = np.diff(offsets) // 2
    order, lo = np.argsort(length, kind="stable"), 0
    while lo < len(order):
        most = (np.arange(1, len(order) - lo + 1) * np.maximum(1, length[order[lo:]])) <= CELLS
        hi = lo + max(1, int(most.sum()))  # lengths ascend, so what fits comes first
        at = order[lo:hi]
        size = length[at]
        wide = int(size.max())
        cell = np.arange(wide) < size[:, None]
        out = np.zeros((len(at), wide), np.uint8)
        place = (offsets[at][:, None] + 2 * np.arange(wide))[cell]
        out[cell] = _NIBBLE[raw[place]] << 4 | _NIBBLE[raw[place + 1]]
        yield at, out, size
        lo = hi


def longs(cells: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k bytes from every column on (k up to 16) as two unsigned longs, zeros behind."""
    n = cells.shape[1] - k + 1
    out = []
    for first in (0, 8):
        g = np.zeros((cells.shape[0], n), np.uint64)
        for j in range(first, min(k, first + 8)):
            g |= cells[:, j : j + n].astype(np.uint64) << np.uint64(8 * (first + 7 - j))
        out.append(g)
    return out[0], out[1]


def words(cells: np.ndarray, k: int, count: int, kept: list[int]) -> list[np.ndarray]:
    """The k bytes from every column on as `count` unsigned longs, zeros behind and at places that are not kept."""
    n = cells.shape[1] - k + 1
    out = [np.zeros((cells.shape[0], n), np.uint64) for _ in range(count)]
    for j in kept:
        out[j // 8] |= cells[:, j : j + n].astype(np.uint64) << np.uint64(8 * (7 - j % 8))
    return out


def first_matches(cells: np.ndarray, size: np.ndarray, pattern: str) -> np.ndarray:
    """Each row's first place where the hex pattern, with ?? for any byte, matches; -1 for none."""
    k = len(pattern) // 2
    n = cells.shape[1] - k + 1
    if n <= 0:
        return np.full(len(size), -1)
    hit = np.arange(n) <= (size - k)[:, None]
    for j in range(k):
        if (b := pattern[2 * j : 2 * j + 2]) != "??":
            hit &= cells[:, j : j + n] == int(b, 16)
    return np.where(hit.any(1), hit.argmax(1), -1)


def order_of(keys: list[np.ndarray]) -> np.ndarray:
    """Row numbers by keys, the first one foremost; equal rows in any order. Constant keys cost nothing, a last one is sorted by the fastest way."""
    varied = [k for k in keys if len(k) and (k != k[0]).any()]
    if not varied:
        return np.arange(len(keys[0]))
    order = np.argsort(varied[-1])
    for k in varied[-2::-1]:
        if k.min() >= 0 and k.max() < 1 << 16:
            k = k.astype(np.uint16)  # sorted by digits
        order = order[np.argsort(k[order], kind="stable")]
    return order


def starts(keys: list[np.ndarray]) -> np.ndarray:
    """The first row of each run of equal keys."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def grouped(keys: list[np.ndarray], n: np.ndarray, seen: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct keys, in order, with the sum of n and the least seen."""
    order = order_of(keys)
    keys = [k[order] for k in keys]
    at = starts(keys)
    if not len(at):
        return keys, n, seen
    return [k[at] for k in keys], np.add.reduceat(n[order], at), np.minimum.reduceat(seen[order], at)
