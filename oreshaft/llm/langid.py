"""Language identification with a byte convolutional network trained in numpy.

Bytes are embedded; filters of widths 2, 3 and 4 run over fixed-length windows,
each filter is max-pooled over its window, and a softmax layer gives a language.
A text's windows cover it whole; their logits are averaged by bytes.

Training takes at most `sample` labelled rows, as many of each language (chosen by a
hash of doc_id, the same on every run), each with at most `slice_chars` characters
from a place that the hash chooses: it runs on the driver, whose memory these two
bound. All windows of these slices count, also those of short texts. Prediction embeds nothing: for each
byte offset in a filter one table of 256 rows holds embedding times weights.

Nulls: rows with a null doc_id, text or lang train nothing. A null text, or one
without a letter, is "und" with score 0, as all are when there is nothing to
learn from. Repeated rows are each judged. An empty table gives an empty result;
columns named lang_pred or score are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._words import buffers, map_texts

WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBED = 8
STEP_BYTES = 1 << 17


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4, is 2; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(zero-padded windows with max(WIDTHS) - 1 zero bytes behind, text of each, bytes of each)."""
    size = np.diff(offsets)
    n = -(-size // WINDOW)
    doc = np.repeat(np.arange(len(size)), n)
    start = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * WINDOW
    length = np.minimum(size[doc] - start, WINDOW)
    at = (offsets[doc] + start)[:, None] + np.arange(WINDOW + max(WIDTHS) - 1)
    inside = np.arange(WINDOW + max(WIDTHS) - 1) < length[:, None]
    out = np.zeros(at.shape, np.uint8)
    out[inside] = data[at[inside]]
    return out, doc, length


class ByteConvNet:
    """Parameters and both passes."""

    def __init__(self, langs: list[str], seed: int = 7):
        r = np.random.default_rng(seed)
        self.langs = langs
        f32 = lambda *shape, s: (r.standard_normal(shape) * s).astype(np.float32)
        self.p = {"emb": f32(256, EMBED, s=0.5), "out": f32(FILTERS * len(WIDTHS), len(langs), s=0.1), "bias": np.zeros(len(langs), np.float32)}
        for k in WIDTHS:
            self.p[f"w{k}"] = f32(k * EMBED, FILTERS, s=(k * EMBED) ** -0.5)
            self.p[f"b{k}"] = np.zeros(FILTERS, np.float32)

    def step(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross entropy for windows x with labels y."""
        p, n = self.p, len(x)
        e = p["emb"][x]
        pooled, back = [], []
        for k in WIDTHS:
            v = np.lib.stride_tricks.sliding_window_view(e, k, axis=1)[:, :WINDOW].transpose(0, 1, 3, 2).reshape(n, WINDOW, k * EMBED)
            c = v @ p[f"w{k}"] + p[f"b{k}"]
            arg = c.argmax(1)
            pooled.append(np.maximum(np.take_along_axis(c, arg[:, None], 1)[:, 0], 0))
            back.append((v, arg))
        z = np.concatenate(pooled, 1)
        logits = z @ p["out"] + p["bias"]
        q = np.exp(logits - logits.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        q[np.arange(n), y] -= 1
        q /= n
        g = {"out": z.T @ q, "bias": q.sum(0), "emb": np.zeros_like(p["emb"])}
        dz = (q @ p["out"].T) * (z > 0)
        for i, (k, (v, arg)) in enumerate(zip(WIDTHS, back)):
            d = dz[:, i * FILTERS : (i + 1) * FILTERS]
            picked = np.take_along_axis(v, arg[:, :, None], 1)  # n, filters, k*embed
            g[f"w{k}"] = np.einsum("nfe,nf->ef", picked, d)
            g[f"b{k}"] = d.sum(0)
            de = (d[:, :, None] * p[f"w{k}"].T[None]).reshape(n, FILTERS, k, EMBED)
            at = arg[:, :, None] + np.arange(k)
            np.add.at(g["emb"], x[np.arange(n)[:, None, None], at], de)
        return g

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 128, rate: float = 0.01, seed: int = 3, least: int = 400) -> ByteConvNet:
        """Adam over shuffled batches: `epochs` passes, or as many as make up `least` steps, the rate falling as 1, 1/2, ... 1/8."""
        r, m = np.random.default_rng(seed), {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        each = -(-len(x) // batch)
        total = max(epochs, -(-least // each)) * each
        for t in range(total):
            if t % each == 0:
                order = r.permutation(len(x))
            b = order[t % each * batch :][:batch]
            for k, g in self.step(x[b], y[b]).items():
                a, s = m[k]
                a += 0.1 * (g - a)
                s += 0.01 * (g * g - s)
                self.p[k] -= rate / (1 + 8 * t // total) * (a / (1 - 0.9 ** (t + 1))) / (np.sqrt(s / (1 - 0.99 ** (t + 1))) + 1e-7)
        return self

    def tables(self) -> list[np.ndarray]:
        """For each offset in a filter, 256 rows of all filters' partial sums."""
        out = []
        for j in range(max(WIDTHS)):
            t = np.zeros((256, FILTERS * len(WIDTHS)), np.float32)
            for i, k in enumerate(WIDTHS):
                if j < k:
                    t[:, i * FILTERS : (i + 1) * FILTERS] = self.p["emb"] @ self.p[f"w{k}"][j * EMBED : (j + 1) * EMBED] + (self.p[f"b{k}"] if j == 0 else 0)
            out.append(t)
        return out

    def logits(self, x: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        c = tables[0][x[:, :WINDOW]]
        for j in range(1, len(tables)):
            c += tables[j][x[:, j : WINDOW + j]]
        return np.maximum(c.max(1), 0) @ self.p["out"] + self.p["bias"]


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample: int = 4000, slice_chars: int = 768, seed: int = 11) -> ByteConvNet | None:
    """A network trained on rows that are not held out; None where no row has a text with a letter and a language.

    Languages have the same number of rows each, or all that there are; where there are
    more than `sample` languages, the most frequent ones have one.
    """
    key = F.xxhash64(F.lit(seed), F.col(doc_id))
    at = F.pmod(key, F.greatest(F.char_length(text) - slice_chars + 1, F.lit(1))).cast("int") + 1
    own = F.col(lang).cast("string")
    labelled = docs.where(~held_out(doc_id) & F.col(doc_id).isNotNull() & own.isNotNull() & F.col(text).rlike(r"\p{L}"))
    counts = labelled.groupBy(own.alias("lang")).count().orderBy(F.desc("count"), "lang").limit(sample).collect()
    if not counts:
        return None
    each = max(1, sample // len(counts))
    # hashes below a bound by language, so that all tasks together send few rows more than are taken
    bounds = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], int(min(1.0, (2 * each + 20) / r["count"]) * (1 << 30)))))
    rows = (
        labelled.where(F.pmod(key, F.lit(1 << 30)) < F.coalesce(F.try_element_at(bounds, own), F.lit(0)))
        .select(key.alias("k"), own.alias("lang"), F.lower(F.substring(F.col(text), at, F.lit(slice_chars))).alias("piece"))
        .withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("k", F.lit(1 << 30)), "k", "piece"))).where(F.col("r") <= each).select("lang", "piece").collect()
    )
    rows.sort()
    langs = sorted({r["lang"] for r in rows})
    data, offsets = buffers(pa.array([r["piece"] for r in rows], pa.string()))
    x, doc, _ = windows(data, offsets)
    return ByteConvNet(langs).train(x, np.array([langs.index(r["lang"]) for r in rows])[doc])


def _kernel(net: ByteConvNet | None):
    tables = net.tables() if net else None

    def kernel(column):
        n, pred, score = len(column), ["und"] * len(column), np.zeros(len(column))
        if net is None or not n:
            return [pa.array(pred, pa.string()), pa.array(score)]
        data, offsets = buffers(column)
        data = data[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        total = np.zeros((n, len(net.langs)))
        size = np.diff(offsets)
        lo = 0
        while lo < n:
            hi = min(n, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + STEP_BYTES, "right")) - 1))
            # a long text goes through in steps of whole windows
            for a in range(int(offsets[lo]), int(offsets[hi]), STEP_BYTES // WINDOW * WINDOW) if hi == lo + 1 else [int(offsets[lo])]:
                b = min(int(offsets[hi]), a + STEP_BYTES // WINDOW * WINDOW) if hi == lo + 1 else int(offsets[hi])
                x, doc, length = windows(data[a:b], np.array([0, b - a]) if hi == lo + 1 else offsets[lo : hi + 1] - a)
                if len(x):
                    np.add.at(total, doc + lo, net.logits(x, tables) * length[:, None])
            lo = hi
        mean = total / np.maximum(size, 1)[:, None]
        q = np.exp(mean - mean.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        best = q.argmax(1)
        said = size > 0
        return [pa.array([net.langs[b] if s else "und" for b, s in zip(best.tolist(), said.tolist())], pa.string()), pa.array(np.where(said, q[np.arange(n), best], 0.0))]

    return kernel


def predict(docs: DataFrame, net: ByteConvNet | None, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """docs' columns (or carry) with lang_pred and score."""
    letters = F.when(F.col(text).rlike(r"\p{L}"), F.lower(F.col(text)))
    frame = docs.withColumn("__folded", letters)
    carry = docs.columns if carry is None else carry
    sc = docs.sparkSession.sparkContext
    held = sc.broadcast(net)
    return map_texts(frame, lambda: _kernel(held.value), {"lang_pred": "string", "score": "double"}, "__folded", carry)
