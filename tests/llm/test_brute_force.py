"""What SQL can't say of the operators' inner steps, against plain Python."""

from __future__ import annotations

import random
import re
import time

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from oreshaft.llm import fingerprint, langid, mixing, neardup, queries, secrets, substring, urlfilter, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
MASK = (1 << 64) - 1


# --- op1 ----------------------------------------------------------------------


def test_url_parts_and_rules_are_those_of_sql(spark, sf_dir):
    con, rules = duckdb.connect(), queries.URL_RULES
    con.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{sf_dir}/pages.parquet')")
    listed = ", ".join(f"('{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{r}')" for r in rules)
    sql = rf"""WITH p AS (SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '') AS h, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
    u AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM p), r(own, start, rule) AS (VALUES {listed})
    SELECT page_id, host, path, max_by(rule, length(rule)) AS rule FROM u LEFT JOIN r ON (host = own OR ends_with(host, '.' || own)) AND starts_with(path, start) GROUP BY ALL"""
    got = {r["page_id"]: r for r in queries.op1_url_filter(spark, sf_dir).collect()}
    want = con.sql(sql).fetchall()
    assert len(want) == len(got) and any(w[3] for w in want)
    for page, host, path, rule in want:
        r = got[page]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (rules[rule] if rule else "block" if r["blocked_p"] >= 0.5 else "allow")


def test_url_score_is_the_logistic_regression(spark):
    weights = urlfilter.fit(urlfilter.example_table(spark))
    urls = ["https://Some.Host.org/a/b?c", "http://x.y/é", "a://b", None, "none"]
    host, path = urlfilter.parts(F.col("u"))
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", host.alias("h"), path.alias("p"), urlfilter.score(host, path, weights).alias("s")).collect()
    for r in rows:
        grams = set()
        for mark, part in (("h", r["h"]), ("p", r["p"])):
            s = f"^{part}$"
            for n in (3, 4, 5):
                for i in range(len(s) - n + 1 if part else 0):
                    grams.add(xxhash.xxh64_intdigest(s[i : i + n].encode(), xxhash.xxh64_intdigest(f"{mark}{n}".encode(), 42)))
        signed = [g - (1 << 64) if g >> 63 else g for g in grams]
        own = {g % (len(weights) - 1) for g in signed}
        z = weights[-1] + sum(weights[g] for g in own) / max(1, len(own))
        assert r["s"] == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-4)


# --- op2 ----------------------------------------------------------------------


def test_pivotal_rounding_keeps_mass_and_expectations():
    r, n = random.Random(1), 12
    size, p = [r.randrange(1, 40) for _ in range(n)], [r.random() for _ in range(n)]
    mean, rounds = np.zeros(n), 3000
    for k in range(rounds):
        t = pa.table({"id": range(n), "size": size, "p": p, "u": [r.random() for _ in range(n)], "done": [False] * n})
        out = mixing._paired(t, False).sort_by("id").to_pydict()
        assert sum(0 < x < 1 for x in out["p"]) <= 1 and sum(not d for d in out["done"]) <= 1
        assert sum(a * b for a, b in zip(out["p"], size)) == pytest.approx(sum(a * b for a, b in zip(p, size)))
        mean += np.array(out["p"]) / rounds
        whole = mixing._paired(t, True).to_pydict()["p"]
        assert set(whole) <= {0.0, 1.0}
    assert np.abs(mean - p).max() < 0.05


def test_mixing_of_a_document_that_repeats(spark):
    """Equal rows are counted, so that they fill no group, and each still has its row."""
    rows = [(7, "a b c", "hot")] * 20_000 + [(None, "x", "hot")] * 500 + [(i, "w " * (i % 50 + 1), "cold") for i in range(100, 400)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), fan=64)
    by = {(r["doc_id"], r["source"], r["size"]): r for r in got.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"), F.sum("copies").alias("copies"), F.max("copies").alias("most"), F.min("copies").alias("least"), F.max("target").alias("target")).collect()}
    assert by[(7, "hot", 3)]["n"] == 20_000 and by[(None, "hot", 1)]["n"] == 500 and len(by) == 302
    for source in ("hot", "cold"):
        own = [r for k, r in by.items() if k[1] == source]
        assert abs(sum(k[2] * r["copies"] for k, r in by.items() if k[1] == source) - own[0]["target"]) <= 50
        assert all(r["most"] - r["least"] <= 1 and r["most"] <= 3 for r in own)


# --- op3 ----------------------------------------------------------------------


def test_many_matches_of_one_text(spark):
    text = "é" + " ".join(f"token={i:09d}" for i in range(40_000))
    start = time.time()
    got = secrets.Ledger(spark).scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), "text").first()["spans"]
    assert [(s["start"], s["stop"]) for s in got] == [m.span() for m in re.finditer(r"token=([0-9]+)", text)]
    assert time.time() - start < 60


# --- op5, op7, op9, op10: clashing names ----------------------------------------


def test_other_columns_don_t_matter(spark):
    r = random.Random(5)
    text = lambda: " ".join(f"w{r.randrange(900)}" for _ in range(80))
    rows = [(i, text()) for i in range(20)]
    rows += [(30 + i, rows[i][1]) for i in range(4)] + [(None, rows[0][1])]
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    more = plain.select("*", *(F.lit("x").alias(c) for c in ("n", "sa", "rep", "mh", "did", "tid", "runs", "first", "fp", "next", "n_words", "component_id", "kept", "key", "root")))
    same = lambda f, *c: sorted(map(repr, f(plain).select(*c).collect())) == sorted(map(repr, f(more).select(*c).collect()))
    assert same(neardup.near_duplicates, "doc_id", "n_shingles", "component_id", "kept")
    assert same(substring.repeats, "doc_id", "n_words", "n_removed", "kept_sha256")
    assert same(fingerprint.edited, "doc_id", "n_chars", "edited")
    pages = plain.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    assert warc.read_archives(warc.write_archives(pages.select("*", F.lit(1).alias("sha"), F.lit(2).alias("size"), F.lit(3).alias("latest")))).count() == len(rows)


# --- op7 ----------------------------------------------------------------------


def test_members_apart_are_not_linked():
    """Groups that rare tokens connect hold all links, and roots are the components."""
    r = np.random.default_rng(3)
    common = r.integers(0, 1 << 60, 60, dtype=np.uint64)
    base = [np.concatenate((common, r.integers(0, 1 << 60, 40, dtype=np.uint64))) for _ in range(25)]
    parts = [np.unique(b) for b in base]
    for b in base[:15]:
        for cut in (3, 9, 14):
            x = b.copy()
            x[-cut:] = r.integers(0, 1 << 60, cut, dtype=np.uint64)
            parts.append(np.unique(x))
    sets = neardup.Sets(parts)
    group = {int(m): i for i, g in enumerate(sets.apart(80)) for m in g}
    label = list(range(len(parts)))
    for i in range(len(parts)):
        for j in range(i):
            inter = len(np.intersect1d(parts[i], parts[j]))
            if 100 * inter >= 80 * (len(parts[i]) + len(parts[j]) - inter):
                assert group[i] == group[j]
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    root = neardup.roots_of(sets, 0.8)
    assert len({(a, int(b)) for a, b in zip(label, root)}) == len(set(label)) == len(set(root.tolist()))


def test_bins_part_no_linked_members():
    """A link of exactly 0.8 stays in a group, also where counts exceed a bin's range; unrelated sets are left out."""
    r = np.random.default_rng(5)
    new = lambda n: r.integers(0, 1 << 63, n, dtype=np.uint64)
    parts = []
    for size in (1, 4, 9, 40, 90, 400, 9000):
        base = new(size)
        more, cut = np.concatenate((base, new(size // 4))), size // 9
        parts += [base, more, np.concatenate((base[cut:], new(cut))), new(size)]
    parts = sorted((np.unique(p) for p in parts), key=len)
    size = np.array([len(p) for p in parts])
    bins = np.array([list(b) for b in neardup._binned(np.concatenate(parts), size).to_pylist()], np.uint8)
    group = {int(m): i for i, g in enumerate(neardup.may_link(size, bins, 80)) for m in g}
    links = 0
    for i in range(len(parts)):
        for j in range(i):
            inter = len(np.intersect1d(parts[i], parts[j]))
            if 100 * inter >= 80 * (size[i] + size[j] - inter):
                links += 1
                assert group[i] == group[j]
    assert links >= 12
    alone = np.array([100, 100]), np.array([list(b) for b in neardup._binned(new(200), np.array([100, 100])).to_pylist()], np.uint8)
    assert neardup.may_link(*alone, 80) == []


# --- op8 ----------------------------------------------------------------------


def forward(net: langid.ByteConvNet, text: str) -> np.ndarray:
    """The mean of a text's windows' logits, written out."""
    raw, total = text.lower().encode(), 0.0
    for lo in range(0, len(raw), langid.WINDOW):
        part = raw[lo : lo + langid.WINDOW]
        e = net.p["emb"][np.frombuffer(part + b"\0" * (langid.WINDOW + max(langid.WIDTHS) - len(part)), np.uint8)].astype(float)
        pooled = []
        for k in langid.WIDTHS:
            each = [e[i : i + k].reshape(-1) @ net.p[f"w{k}"] + net.p[f"b{k}"] for i in range(langid.WINDOW)]
            pooled.append(np.maximum(np.max(each, 0), 0))
        total = total + (np.concatenate(pooled) @ net.p["out"] + net.p["bias"]) * len(part)
    return total / len(raw)


def test_prediction_is_the_forward_pass(spark):
    r = random.Random(9)
    net = langid.ByteConvNet(["aa", "bb", "cc"], seed=4)
    texts = ["a", "É" * 95 + "x", "Some words of Text", "".join(r.choice("abcdéñ \n") for _ in range(191)), "".join(r.choice("xyz ü") for _ in range(langid.STEP_BYTES + 5000))] + [f"row {i} " * (i % 40 + 1) for i in range(60)]
    got = {x["i"]: x for x in langid.predict(spark.createDataFrame(list(enumerate(texts)), "i long, text string"), net).collect()}
    for i in [*range(5), 20, 64]:
        z = forward(net, texts[i])
        q = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert got[i]["lang_pred"] == net.langs[int(q.argmax())] and got[i]["score"] == pytest.approx(q.max(), abs=1e-4)


def test_short_texts_train_and_languages_share_the_sample(spark):
    r = random.Random(2)
    word = lambda c: "".join(r.choice(c) for _ in range(4))
    rows = [(i, " ".join(word("kztpaou") for _ in range(2)) if i % 50 else " ".join(word("lmnrei") for _ in range(2)), "many" if i % 50 else "few") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    said = langid.predict(docs, langid.fit(docs, sample=60)).where(langid.held_out()).groupBy("lang").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right")).collect()
    assert {x["lang"] for x in said} == {"many", "few"} and all(x["right"] >= 0.9 for x in said)
    assert langid.fit(docs.withColumn("text", F.lit("12 ?"))) is None


# --- op9 ----------------------------------------------------------------------


def chained(*parts) -> int:
    """Spark's xxhash64 of several values, signed."""
    h = 42
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode() if isinstance(p, str) else p.to_bytes(4, "little", signed=True), h)
    return h - (1 << 64) if h >> 63 else h


def plain_fingerprint(text: str | None) -> str:
    w = WORD.findall(text or "")
    hashes = [chained(*w[i : i + 5]) for i in range(len(w) - 4)] or ([chained(" ".join(w), len(w))] if w else [])
    bin_of = lambda h: (h & MASK) >> 57
    least: dict[int, int] = {}
    for h in sorted(hashes):
        least.setdefault(bin_of(h), h)
    if not least:
        return ""
    full = []
    for b in range(128):
        tries = [b] if b in least else [t for t in (chained(b, k) % 128 for k in range(12)) if t in least]
        full.append(least[tries[0]] if tries else min((chained(b, bin_of(y)), y) for y in least.values())[1])
    return "".join(f"{int.from_bytes(bytes(h & 255 for h in full[i : i + 8]), 'big'):016X}" for i in range(0, 128, 8))


def test_fingerprints_bin_densify_and_pack(spark):
    r = random.Random(6)
    texts = [None, "", " \n", "one", "four words are few", "exactly five words are here", *(" ".join(f"é{r.randrange(50)}" for _ in range(n)) for n in (6, 7, 12, 60, 700)), "same " * 40]
    got = spark.createDataFrame(list(enumerate(texts)), "i long, text string").select("i", fingerprint.text_of(fingerprint.fingerprint(F.col("text"))).alias("f"), fingerprint.fingerprint(F.col("text")).alias("raw")).collect()
    for r_ in got:
        assert r_["f"] == plain_fingerprint(texts[r_["i"]]), texts[r_["i"]]
    cells = {r_["i"]: bytes.fromhex(r_["f"]) for r_ in got}
    both = spark.createDataFrame([(a["i"], a["raw"], b["i"], b["raw"]) for a in got for b in got], "i long, x array<long>, j long, y array<long>").select("i", "j", fingerprint.likeness(F.col("x"), F.col("y")).alias("n")).collect()
    for x in both:
        a, b = cells[x["i"]], cells[x["j"]]
        share = sum(p == q for p, q in zip(a, b)) / 128
        want = 1.0 if not a and not b else 0.0 if not a or not b else min(1.0, max(0.0, (share - 1 / 256) / (1 - 1 / 256)))
        assert x["n"] == pytest.approx(want)


def test_edited_texts_follow_descending_ids_and_wrap(spark):
    r = random.Random(8)
    rows = [(i, "".join(r.choice("abc é") for _ in range(r.randrange(0, 30)))) for i in r.sample(range(1000), 60)] + [(None, "null one")]
    order = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0)))
    got = {x["doc_id"]: x["edited"] for x in fingerprint.edited(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for (i, text), (_, following) in zip(order, [*order[1:], order[0]]):
        half = len(text) // 2
        assert got[i] == text[: len(text) - half] + following[:half]
