"""Jobs that must stay whole and bounded on larger and odd tables."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import types as T

from __spark_entry__ import queries
from oreshaft.operators import mining, ranking, signatures, stats
from oreshaft.sources import blobs, html


def documents(spark, tmp_path, texts):
    rows = [(i, t, "en" if i % 2 else None, "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_empty_blobs_are_files_too(spark, tmp_path):
    texts = ["", "a b", None, "é", ""]
    sf_dir = documents(spark, tmp_path, texts)
    got = {tuple(r) for r in queries()["blob_files"](spark, sf_dir).collect()}
    each = [("en" if i % 2 else "none", f"{i}.dat", (t or "").encode()) for i, t in enumerate(texts)]
    assert got == {(d, f, len(c), hashlib.md5(c).hexdigest()) for d, f, c in each}
    assert {tuple(r) for r in queries()["blob_list"](spark, sf_dir).collect()} == {("none", 3, 0), ("en", 2, 5)}


def test_empty_blobs_with_odd_names_and_other_suffixes(spark, tmp_path):
    for name, content in {"d/a b+%41.dat": b"", "d/e/c.dat": b"", "d/full %.dat": b"12", "d/other.txt": b""}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    got = {(r["device"], r["file_name"], r["length"], bytes(r["content"])) for r in blobs.read_blobs(spark, str(tmp_path)).collect()}
    assert got == {("d", "a b+%41.dat", 0, b""), ("e", "c.dat", 0, b""), ("d", "full %.dat", 2, b"12")}


class Recorded:
    """Stands in for a DataFrame and keeps the function that goes to the tasks."""

    def __init__(self, schema):
        self.schema, self.columns = schema, schema.names

    def select(self, *columns):
        return self

    def where(self, condition):
        return self

    def mapInArrow(self, run, schema):
        self.run = run
        return self


@pytest.mark.parametrize("operator", [stats.autocorrelation, stats.sliding_entropy, stats.phase_scores])
def test_rows_of_series_leave_a_task_some_at_a_time(operator):
    df = Recorded(T.StructType().add("doc_id", "long").add("content", "binary"))
    operator(df)
    contents = [bytes(range(256)) * (400 if i % 1000 == 0 else 0) + b"abc" * 30 for i in range(20_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(20_000), pa.int64()), pa.array(contents, pa.binary())], names=["doc_id", "content"])
    sizes = [b.num_rows for b in df.run(iter([batch]))]
    assert len(sizes) > 1 and max(sizes) <= stats.GIVEN + stats.WINDOWS


@pytest.mark.parametrize("n", [3000, 5])
def test_exact_sums_of_long_series_agree(n, monkeypatch):
    df = Recorded(T.StructType().add("content", "binary"))
    stats.autocorrelation(df)
    batch = pa.RecordBatch.from_arrays([pa.array([bytes(i * i % 251 for i in range(n)), b"z" * n], pa.binary())], names=["content"])
    short = pa.Table.from_batches(df.run(iter([batch]))).to_pydict()
    monkeypatch.setattr(stats, "EXACT", 1)
    assert pa.Table.from_batches(df.run(iter([batch]))).to_pydict() == short and 0.0 in short["r"]


def entropy(counts):
    total = sum(counts.values())
    return round(-sum(n / total * math.log2(n / total) for n in counts.values()), 12) + 0.0


def zones_of(spark, cells, columns="zone string, doc_id long, tag string, hexed string"):
    return spark.createDataFrame(cells, columns).repartition(3)


def test_templates_are_counted_where_zones_are_read(spark):
    r = random.Random(5)
    cells = [(r.choice("pq"), i, f"t{i}" if i % 3 else f"s{i % 4}", bytes([r.randrange(3), r.randrange(2), *(r.choice(b"abcdefgh") for _ in range(r.choice((0, 1, 7, 9))))]).hex()) for i in range(120)]
    found = mining.templates(zones_of(spark, cells), (2, 3, 9), 3, 2.7)
    assert "explode(sequence" not in found._jdf.queryExecution().optimizedPlan().toString()
    wins = [(z, k, d, o, t, h[2 * o : 2 * o + 2 * k]) for z, d, t, h in cells for k in (2, 3, 9) for o in range(len(h) // 2 - k + 1)]
    cell = lambda h, i: h[2 * i : 2 * i + 2]
    groups, want = defaultdict(list), []
    spread = defaultdict(Counter)
    for z, k, *_, h in wins:
        for i in range(k):
            spread[z, k, i][cell(h, i)] += 1
    for w in sorted(wins, key=lambda w: (w[2], w[3])):
        anchors = [i for i in range(w[1]) if entropy(spread[w[0], w[1], i]) < 2.7]
        if anchors and sum(spread[w[0], w[1], 0].values()) >= 3:
            groups[w[0], w[1], "".join(cell(w[5], i) for i in anchors)].append(w)
    for (z, k, _), own in groups.items():
        counts = [Counter(cell(w[5], i) for w in own) for i in range(k)]
        made = [c.most_common(1)[0][0] if entropy(c) < 1 else "??" for c in counts]
        if len(own) >= 3 and set(made) != {"??"}:
            want.append((z, k, "".join(made), len(own), len({w[4] for w in own}), sum(c != "??" for c in made)))
    got = [tuple(x) for x in found.select("zone", "k", "template", "n", "sources", "fixed").collect()]
    assert sorted(got) == sorted(want) and any("??" in x[2] for x in got)


def test_top_grams_count_all_lengths(spark):
    r = random.Random(6)
    cells = [(r.choice("pq"), i, "t", bytes(r.choice(b"ab") for _ in range(r.randrange(20))).hex()) for i in range(80)]
    got = {(x["zone"], x["k"], x["rank"]): (x["pattern"], x["n"]) for x in mining.top_grams(zones_of(spark, cells), (4, 8, 12), 5).collect()}
    n, seen = Counter(), {}
    for z, d, _, h in cells:
        for k in (4, 8, 12):
            for o in range(len(h) // 2 - k + 1):
                key = (z, k, h[2 * o : 2 * o + 2 * k])
                n[key] += 1
                seen.setdefault(key, (d, o))
    for z in "pq":
        for k in (4, 8, 12):
            best = sorted((x for x in n if x[:2] == (z, k)), key=lambda x: (-n[x], seen[x]))[:5]
            assert [got[z, k, i + 1] for i in range(5)] == [(x[2], n[x]) for x in best]


def test_motifs_are_mined_once_for_their_hits(spark):
    zones = zones_of(spark, [("p", 1, "t", "0102030401"), ("p", 2, "t", "ff"), ("p", 3, "t", "0209"), ("q", 1, "t", "0102")])
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([("p", "01??", 5, 1, 1), ("p", "02??", 4, 1, 2)], "zone string, pattern string, n long, fixed int, rank int").coalesce(1)
    hits = mining.motif_hits(zones, rows.mapInArrow(counted, rows.schema))
    assert {(x["zone"], x["doc_id"], x["pattern"], x["rank"], x["off"], x["w"]) for x in hits.collect()} == {("p", 1, "01??", 1, 0, 10.0), ("p", 1, "02??", 2, 1, 8.0), ("p", 3, "02??", 2, 0, 8.0)}
    assert read.value == 2


def test_rows_of_pages_leave_a_task_some_at_a_time(spark):
    df = Recorded(T.StructType().add("page_id", "long").add("html", "string"))
    html.changelog_rows(df)
    page = '<div class="firmware-table-details"><tr data-modelno="M"><td class="firmware-message">x</td></tr></div>'
    batch = pa.RecordBatch.from_arrays([pa.array(range(9000), pa.int64()), pa.array([page] * 9000)], names=["page_id", "html"])
    sizes = [b.num_rows for b in df.run(iter([batch]))]
    assert sum(sizes) == 9000 and max(sizes) <= html.GIVEN


def test_first_tags_leave_a_task_alone(monkeypatch):
    monkeypatch.setattr(ranking, "HELD", 1000)
    df = Recorded(T.StructType().add("g", "long").add("tag", "string"))
    ranking.first_tags(df, ["g"], 3)
    rows = [(i % 4, f"t{i * 7919 % 5000:05d}") for i in range(8000)]
    batches = [pa.RecordBatch.from_arrays([pa.array([g for g, _ in rows[a : a + 700]], pa.int64()), pa.array([t for _, t in rows[a : a + 700]])], names=["g", "tag"]) for a in range(0, 8000, 700)]
    out = [tuple(r.values()) for b in df.run(iter(batches)) for r in b.to_pylist()]
    assert sorted(out) == sorted((g, t) for g in range(4) for t in sorted({t for h, t in rows if h == g})[:3])


def test_report_counts_signatures_past_62(spark):
    hits = spark.createDataFrame([("p", f"t{i % 5}", o, f"n{o}") for i in range(40) for o in (0, 61, 62, 130) if i % (o + 1) < 9], "zone string, tag string, ordinal int, name string")
    got = {x["ordinal"]: (x["name"], x["hits"], x["sources"], x["tags"], x["more"]) for x in signatures.report(hits, shown=3).collect()}
    rows = [tuple(x) for x in hits.collect()]
    assert got == {o: (f"n{o}", len(own := [x for x in rows if x[2] == o]), len(s := {x[1] for x in own}), sorted(s)[:3], max(0, len(s) - 3)) for o in (0, 61, 62, 130)}
