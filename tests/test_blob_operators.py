"""Operators against sequential Python, on the inputs that the tables don't have."""

from __future__ import annotations

import json
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from oreshaft.functions import bytes as B
from oreshaft.functions import distances as D
from oreshaft.operators import ranking, decode, mining, regions, signatures, stats
from oreshaft.sources import blobs, candidates, html, sinks
from oreshaft.streaming import arrivals


def sequential_mask(h):
    ok, i = [False] * len(h), 0
    while i < len(h):
        if h[i] >= 0xE800 and i + 1 < len(h) and h[i + 1] not in (0, 0xFFFF):
            ok[i] = True
            i += 2
            continue
        ok[i] = h[i] < 0xC000 or 0xD000 <= h[i] < 0xE800
        i += 1
    return ok


def test_mask_equals_the_sequential_decoder():
    r = random.Random(1)
    pool = [0, 0xFFFF, 0xE800, 0xF123, 0xF8FF, 0xC111, 0x4770]
    for _ in range(500):
        h = [r.choice(pool) if r.random() < 0.7 else r.randrange(65536) for _ in range(r.randrange(0, 120))]
        assert decode.validity(np.array(h, "<u2")).tolist() == sequential_mask(h)


@pytest.mark.parametrize("only_ok", [False, True])
def test_blocks_map_and_rates(spark, only_ok):
    r = random.Random(2)
    content = [bytes(r.randrange(256) for _ in range(n)) for n in (0, 1, 2, 15, 16, 17, 18, 129, 400)] + [b"\x70\x47" * 200, None]
    df = spark.createDataFrame([("d", str(i), c) for i, c in enumerate(content)], "device string, file_name string, content binary")
    table = decode.blocks(df, offset=16, block_bytes=65)  # odd: 64
    got = {(x["file_name"], x["block"]): x for x in table.collect()}
    want = 0
    total = Counter()
    for i, c in enumerate(content):
        h = list(np.frombuffer((c or b"")[16:][: max(0, len(c or b"") - 16) // 2 * 2], "<u2"))
        ok = sequential_mask(h)
        for a in range(0, len(h), 32):
            want += 1
            x, part = got[(str(i), a // 32)], ok[a : a + 32]
            assert (x["valid"], x["halfwords"], x["start"], x["stop"]) == (sum(part), len(part), 16 + 2 * a, 16 + 2 * a + 2 * len(part))
            if sum(part) / len(part) >= 0.8:
                total["words"] += sum(part) if only_ok else len(part)
                total["bx"] += sum(v == 0x4770 and (o or not only_ok) for v, o in zip(h[a : a + 32], part))
    assert len(got) == want
    rates = decode.return_rates(table, "device", 0.8, only_ok).first()
    assert rates["total_halfwords_counted"] == total["words"]
    assert rates["bx_lr_per_1k"] == pytest.approx(1000 * total["bx"] / total["words"])
    out = decode.codeonly_map(table, ["file_name"], 0.8).collect()
    meta = {x["file_name"]: x for x in decode.block_meta(table, ["file_name"], 0.8).collect()}
    for name, m in meta.items():
        own = sorted((x["out_start"], x["out_end"], x["len"]) for x in out if x["file_name"] == name)
        assert sum(x[2] for x in own) == m["kept_bytes"] and all(b - a == n for a, b, n in own)
        assert [x[0] for x in own[1:]] == [x[1] for x in own[:-1]]
    made = {x["file_name"]: bytes(x["content"]) for x in decode.codeonly_blobs(df, table, ["file_name"], 0.8, write_empty=True).collect()}
    assert {k: len(v) for k, v in made.items() if v} == {k: m["kept_bytes"] for k, m in meta.items() if m["kept_bytes"]}
    hist = stats.codeonly_histogram(df, "device", 16, 64, 0.8, rule="down").agg(F.sum("n")).first()[0]
    assert hist == sum(m["kept_bytes"] for m in meta.values())


def test_block_size_rules():
    assert [decode.block_size(x) for x in (0, 1, 2, 3, 2049)] == [2, 2, 2, 2, 2048]
    assert [decode.block_size(x, "up") for x in (1, 255, 257, 4096)] == [256, 256, 258, 4096]


def test_distances(spark):
    df = spark.createDataFrame([([0.5, 0.5, 0.0], [0.0, 0.5, 0.5]), ([1.0, 0.0, 0.0], [1.0, 0.0, 0.0]), ([0.0, 0.0, 0.0], [1.0, 0.0, 0.0])], "p array<double>, q array<double>")
    p, q = F.col("p"), F.col("q")
    got = df.select(D.js_distance(p, q).alias("j"), D.js_distance(q, p).alias("k"), D.chi2(p, q).alias("c"), D.cosine(p, q).alias("s"), D.sorted_cosine(p, q).alias("o"), D.js_divergence(p, q).alias("d")).collect()
    assert got[0]["j"] == pytest.approx(math.sqrt(0.5)) and got[0]["j"] == got[0]["k"] and got[0]["c"] == pytest.approx(0.5)
    assert got[0]["s"] == pytest.approx(0.5) and got[0]["o"] == pytest.approx(1) and got[0]["d"] == pytest.approx(0.5, abs=1e-6)
    assert got[1]["j"] == 0 and got[1]["d"] == pytest.approx(0, abs=1e-9) and got[2]["s"] == 0


def test_autocorrelation_and_phases_of_odd_series(spark):
    series = [b"", b"a", b"ab", b"aaaaaaaa", bytes(range(70)), b"ab" * 40]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(series)], "i int, content binary")
    got: dict = {}
    for r in stats.autocorrelation(df, 64).collect():
        got.setdefault(r["i"], {})[r["lag"]] = r["r"]
    assert [len(got[i]) for i in range(6)] == [1, 1, 1, 6, 64, 64]
    assert set(got[3].values()) == {0.0} and got[4][5] == pytest.approx(1) and got[5][1] == pytest.approx(-1) and got[5][2] == pytest.approx(1)
    best = {r["i"]: r["best_k"] for r in stats.best_k(stats.phase_scores(df), ["i"]).collect()}
    assert best[5] == 2 and best[3] == 2
    window = stats.sliding_entropy(spark.createDataFrame([(0, b"ab" * 40), (1, b"a" * 64)], "i int, content binary"), 64, 16).collect()
    assert [(r["i"], r["off"], r["entropy"]) for r in window] == [(0, 0, 1.0)]


def brute_templates(zones, lengths, least, threshold):
    ent = lambda c: -sum(v / sum(c.values()) * math.log2(v / sum(c.values())) for v in c.values())
    out = []
    for k in lengths:
        wins = [(z[i : i + k], t) for z, t in zones for i in range(len(z) - k + 1)]
        if len(wins) < least:
            continue
        low = [j for j in range(k) if ent(Counter(w[j] for w, _ in wins)) < threshold]
        groups: dict = {}
        for w, t in wins if low else []:
            groups.setdefault(tuple(w[j] for j in low), []).append((w, t))
        for m in groups.values():
            if len(m) >= least:
                cs = [Counter(w[j] for w, _ in m) for j in range(k)]
                cells = [f"{c.most_common(1)[0][0]:02x}" if ent(c) < 1.0 else "??" for c in cs]
                if any(c != "??" for c in cells):
                    out.append((k, "".join(cells), len(m), len({t for _, t in m})))
    return sorted(out)


def test_templates_with_wild_positions(spark):
    r = random.Random(5)
    zones = [(bytes([0xB5, r.randrange(256), 0x00, r.choice([1, 2])] + [r.randrange(256) for _ in range(r.randrange(0, 5))]), f"t{i % 7}") for i in range(40)]
    df = spark.createDataFrame([("prologue", i, t, z.hex()) for i, (z, t) in enumerate(zones)], "zone string, doc_id long, tag string, hexed string")
    found = mining.templates(df, range(2, 5), 3, 4.0)
    assert sorted((x["k"], x["template"], x["n"], x["sources"]) for x in found.collect()) == brute_templates(zones, range(2, 5), 3, 4.0)
    assert any("??" in x["template"] for x in found.collect())
    kept = {x["template"] for x in mining.dedup_templates(found).collect()}
    every = [(x["k"], x["template"], x["n"]) for x in found.collect()]
    cells = lambda t: [t[2 * i : 2 * i + 2] for i in range(len(t) // 2)]
    inside = lambda a, b: any(all(x in ("??", y) for x, y in zip(cells(a), cells(b)[s:])) for s in range(len(cells(b)) - len(cells(a)) + 1))
    assert kept == {t for k, t, n in every if not any(k2 > k and n2 >= 0.8 * n and inside(t, t2) for k2, t2, n2 in every)}


def test_masks():
    assert len(mining.masks(8, 3)) == 93 and len(mining.masks(8, 3, True)) == 22


def test_signatures(spark):
    assert [len(signatures.registry(v)) for v in (2, 3)] == [57, 51]
    df = spark.createDataFrame([(1, "p", "t", "00f0b500"), (2, "p", "t", ""), (3, "p", "t", "0b00")], "doc_id long, zone string, tag string, hexed string")
    hits = {(r["doc_id"], r["name"]): r["off"] for r in signatures.scan(df, signatures.registry(2)).collect()}
    assert hits[(1, "ARM-Thumb PUSH {LR}")] == 1 and hits[(1, "ARM-Thumb PUSH {r4-r7,LR}")] == 1 and hits[(1, "ARM-Thumb BL (high)")] == 0
    assert hits[(3, "SH2 RTS")] == 0 and (3, "ARM-Thumb BX LR") not in hits and not any(k[0] == 2 for k in hits)


def test_interval_hits_equal_a_range_join(spark):
    r = random.Random(7)
    kept = sorted(r.sample(range(12), 7))
    blocks = [("f", b, 16 + 10 * b, 16 + 10 * b + (10 if b < 11 else 6)) for b in kept]
    rows = [(i, "f", a, a + r.randrange(0, 25)) for i, a in enumerate(r.randrange(0, 150) for _ in range(300))]
    df = spark.createDataFrame(rows, "doc_id long, file_name string, start long, `end` long")
    table = spark.createDataFrame(blocks, "file_name string, block int, start long, stop long")
    got = {x["doc_id"]: (x["contained"], x["overlaps"]) for x in regions.interval_hits(df, table, ["file_name"], 16, 10).collect()}
    for i, _, s, e in rows:
        assert got[i] == (any(s >= a and e <= b for _, _, a, b in blocks), any(not (e <= a or s >= b) for _, _, a, b in blocks)), (s, e)


def test_zones_clamp(spark):
    df = spark.createDataFrame([(1, "d", "f.dat", bytes(range(40)), -5, 10), (2, "d", "f.dat", bytes(40), 50, 60), (3, "d", "a.dat", bytes(range(40)), 35, 99)], "doc_id long, device string, file_name string, content binary, start long, `end` long")
    got = {(r["doc_id"], r["zone"]): (r["hexed"], r["tag"]) for r in regions.region_zones(df).collect()}
    assert len(got) == 8 and got[(1, "pre_context")] == ("", "d/f@0x00000") and got[(3, "prologue")] == ("2324252627", "d/a@0x00023")
    assert regions.region_counts(df).first().asDict() == {"regions": 2, "skipped": 1}


def test_files_candidates_and_sinks(spark, tmp_path):
    for device, name, content in (("one", "a-b.dat", b"xy" * 9), ("one", "c.dat", b"z"), ("two", "a-b.dat", b"q"), ("two", "n.txt", b"no")):
        (tmp_path / "in" / device).mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / device / name).write_bytes(content)
    found = blobs.read_blobs(spark, str(tmp_path / "in"))
    assert sorted((r["device"], r["file_name"]) for r in found.collect()) == [("one", "a-b.dat"), ("one", "c.dat"), ("two", "a-b.dat")]
    assert {r["file_name"]: r["device"] for r in blobs.by_name(found, str(tmp_path / "in")).collect()} == {"a-b.dat": "one", "c.dat": "one"}
    wanted = spark.createDataFrame([("one", "a b.dat"), ("one", "c.dat"), ("one", "no.dat")], "device string, file_name string")
    assert {r["file_name"]: r["content"] and bytes(r["content"]) for r in blobs.resolve(wanted, found, ["device", "file_name"]).collect()} == {"a b.dat": b"xy" * 9, "c.dat": b"z", "no.dat": None}
    assert [r[0] for r in blobs.missing(wanted, found).orderBy("file_name").collect()] == ["a b.dat", "no.dat"]
    assert blobs.labelled(["/a/b.c.dat", "d"]) == {"/a/b.c.dat": "b.c", "d": "d"} and blobs.labelled(["/x"], ["y"]) == {"/x": "y"}
    with pytest.raises(ValueError, match="2 labels for 1"):
        blobs.labelled(["/x"], ["y", "z"])
    csv = tmp_path / "c.csv"
    csv.write_text('﻿device,base_file,new_file,start,end,side,note\none,b,n,12.0,20,base,"x ""y"" z"\none,b,n,zz,20,,\none,b,n,3,9,,a Deletion\n', encoding="utf-8")
    rows = candidates.read_candidates(spark, str(csv))
    assert [(r["start"], r["end"]) for r in rows.collect()] == [(12, 20), (3, 9)]
    assert [[r[0] for r in rows.select(candidates.side_file(rule=k)).collect()] for k in ("exact", "folded", "noted")] == [["b", "n"], ["b", "n"], ["b", "b"]]
    with pytest.raises(ValueError, match="missing columns"):
        candidates.read_candidates(spark, str(csv), required=("device", "kind"))
    doc = tmp_path / "b.json"
    doc.write_text(json.dumps({"meta": {}, "candidates": [{"base_file": "b", "start": 1, "end": 2, "windows_hex": {"start_post": "b5 f0", "end_pre": ""}}]}))
    assert {r["zone"]: r["hexed"] for r in candidates.read_boundary_windows(spark, str(doc)).collect()} == {"start_pre": "", "start_post": "b5f0", "end_pre": "", "end_post": ""}
    sinks.write_blobs(found.where("device = 'one'"), str(tmp_path / "out"))
    assert (tmp_path / "out" / "one" / "a-b_codeonly.bin").read_bytes() == b"xy" * 9
    sinks.write_csv(wanted.coalesce(1), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 3
    sinks.write_document(wanted, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 3
    stream = arrivals.running_histogram(arrivals.arriving_blobs(spark, str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("seen").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("seen").where("device = 'one' and b = 120").first()["n"] == 9


def test_expressions(spark):
    row = spark.range(1).select(
        B.hex_of(B.tail(F.lit(b"abcd"), 2)).alias("t"), B.hex_of(B.tail(F.lit(b"ab"), 2)).alias("e"), B.hex_of(B.even(F.lit(b"abc"))).alias("v"),
        B.spaced(F.lit("b5f0")).alias("s"), B.hex_of(B.unspaced(F.lit("b5 f0"))).alias("u"), B.byte_array(F.lit("ff00")).alias("a"), B.byte_array(F.lit("")).alias("n"),
        B.first_match(F.lit("aab5ccb5"), "b5??").alias("m"), B.safe_filename(F.lit("AB-C 1/x")).alias("f"), B.normalize_space(F.lit(" a \n b ")).alias("w"),
        B.changelog_date(F.lit("Jan 5, 2021")).cast("string").alias("d"), B.changelog_date(F.lit("soon")).alias("j"), B.source_tag(F.lit("d"), F.lit("x.dat"), F.lit(1048577)).alias("g"),
    ).first()
    assert (row["t"], row["e"], row["v"], row["s"], row["u"], row["a"], row["n"], row["m"]) == ("6364", "", "6162", "b5 f0", "b5f0", [255, 0], [], 1)
    assert (row["f"], row["w"], row["d"], row["j"], row["g"]) == ("AB-C_1_x", "a b", "2021-01-05 00:00:00", None, "d/x@0x100001")


def test_changelog_page(spark):
    page = """<div class="x firmware-table-details"><table><tr data-modelno="M1"><td class="firmware-date">Jan 5, 2021</td><td class="firmware-version"> 4.1 </td><td class="firmware-message"><p>Fixed
      it</p></td></tr><tr data-modelno="M1"><td class="firmware-date">soon</td><td class="firmware-version">4.0</td><td class="firmware-message">Old</td></tr>
      <tr data-modelno="M1"><td class="firmware-date">Feb 1, 2022</td><td class="firmware-version">4.2</td><td class="firmware-message">New</td></tr>
      <tr data-modelno="M2"><td class="firmware-date">Feb 1, 2022</td><td class="firmware-version">1</td><td class="firmware-message"> </td></tr></table></div><tr data-modelno="M3"><td class="firmware-message">out</td></tr>"""
    rows = html.changelog_rows(spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string"))
    assert sorted((r["model"], r["date"], r["version"], r["message"]) for r in rows.collect()) == [("M1", "Feb 1, 2022", "4.2", "New"), ("M1", "Jan 5, 2021", "4.1", "Fixed it"), ("M1", "soon", "4.0", "Old")]
    made = {r["model"]: r for r in html.changelog_text(rows, ["M1", "M 7"]).collect()}
    body = made["M1"]
    assert made["M 7"]["file"] == "M_7.txt" and made["M 7"]["body"].endswith("No entries found.\n")
    assert body["file"] == "M1.txt" and [body["body"].index(x) for x in ("New", "Fixed it", "Old")] == sorted(body["body"].index(x) for x in ("New", "Fixed it", "Old"))


def test_changelog_pages_nest(spark):
    page = """<div class="firmware-table-details"><table><tr data-modelno="M&amp;1"><td class="firmware-message"><div>A &amp; B</div> <i>c</td><td class="firmware-date">x<td class="firmware-message">no</td></tr></table></div>
      <div class="firmware-table-details"><tr data-modelno="M2"><td class="firmware-message">second wrapper</td></tr></div>"""
    rows = html.changelog_rows(spark.createDataFrame([(1, page, "old")], "page_id long, html string, model string")).collect()
    assert [(r["page_id"], r["pos"], r["model"], r["message"]) for r in rows] == [(1, 0, "M&1", "A & B c")]


def test_ranked_with_many_ties(spark):
    r = random.Random(11)
    rows = [(i, float(r.choice([0, 0, 0, 1, 2.5, r.randrange(50)]))) for i in range(700)]
    got = {x["i"]: x["rank"] for x in ranking.ranked(spark.createDataFrame(rows, "i long, v double").repartition(5), "v", "i").collect()}
    assert got == {i: n + 1 for n, (i, _) in enumerate(sorted(rows, key=lambda x: (-x[1], x[0])))}
    assert ranking.ranked(spark.createDataFrame([], "i long, v double"), "v", "i").count() == 0


def test_motifs_in_parts_equal_whole(spark, monkeypatch):
    r = random.Random(12)
    rows = [(i, "p" if i % 3 else "q", "".join(r.choice(["00", "0a", "ff", "b5"]) for _ in range(r.randrange(0, 14)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, zone string, hexed string")
    for k, wild, contiguous in ((4, 2, False), (9, 2, True), (3, 0, False), (2, 3, False)):
        want: dict = {}
        for i, z, h in rows:
            cells = [h[j : j + 2] for j in range(0, len(h), 2)]
            for at in range(len(cells) - k + 1):
                for m, mask in enumerate(mining.masks(k, wild, contiguous)):
                    p = "".join("??" if j in mask else c for j, c in enumerate(cells[at : at + k]))
                    n, seen, _, _ = want.get((z, p), (0, (i, at), m, 0))
                    want[z, p] = (n + 1, min(seen, (i, at)), m, k - len(mask))
        best = {z: sorted(((-n, -fixed, seen, m, p) for (y, p), (n, seen, m, fixed) in want.items() if y == z and n >= 2))[:12] for z in "pq"}
        for held in (1 << 20, 16):
            monkeypatch.setattr(mining, "HELD", held)
            got = mining.motifs(df, k, wild, contiguous, least=2, top=12).collect()
            for z in "pq":
                own = sorted((x["rank"], x["pattern"], x["n"]) for x in got if x["zone"] == z)
                assert [(p, n) for _, p, n in own] == [(p, -n) for n, _, _, _, p in best[z]], (k, wild, held)


def test_phases_without_bytes_are_uniform(spark):
    """A series shorter than k has empty phases, whose smoothed histogram is uniform."""
    content = b"Osra\xc3\xb1."
    got = {r["k"]: r["score"] for r in stats.phase_scores(spark.createDataFrame([(1, bytearray(content))], "doc_id long, content binary")).collect()}

    def share(part: bytes) -> np.ndarray:
        p = np.bincount(np.frombuffer(part, np.uint8), minlength=256) / max(1, len(part)) + 1e-12
        return p / p.sum()

    for k in range(2, 9):
        h, d = [share(content[j::k]) for j in range(k)], []
        for i in range(k):
            for j in range(i + 1, k):
                m = (h[i] + h[j]) / 2
                d.append(((h[i] * np.log2(h[i] / m)).sum() + (h[j] * np.log2(h[j] / m)).sum()) / 2)
        assert got[k] == pytest.approx(np.mean(d))
    assert got[8] < 1
