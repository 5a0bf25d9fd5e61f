"""Reports: every section runs, and parameters take effect."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from oreshaft.plans import reports
from oreshaft.sources import blobs, candidates


@pytest.fixture(scope="module")
def found(spark, sf_dir):
    return candidates.document_regions(spark, sf_dir).where("doc_id < 40")


def test_miner_sections(found):
    p = reports.Miner(version=2, ngram_max=4, min_occ=2, lengths=(2,), threshold=5.0)
    sections = reports.miner(found, p)
    assert sections["counts"].first()["regions"] == found.count()
    for name, df in sections.items():
        assert not df.isEmpty(), name
    assert sections["patterns"].agg(F.max(F.char_length("pattern"))).first()[0] <= 8


def test_groups_add_up(found):
    parts = reports.grouped_miner(found, reports.Miner(version=3, groups={"A": ["en"], "B": ["de"]}))
    count = {k: v["counts"].first()["regions"] for k, v in parts.items()}
    assert count["combined"] == found.count() and count["A"] == found.where("device = 'en'").count()


def test_boundary_and_motifs(found):
    b = reports.boundary(found, window=16, hi=5, top=3, kgrams=(4,))
    assert b["prologue_prefix"].count() == 3 and b["kgrams"].count() == 6
    m = reports.motif_ranking(b["windows"], k=4, wild=1, least=2, top=5, max_hits=1)
    assert m["motifs"].count() == 10 and m["ranking"].count() == found.count()
    assert m["hits"].groupBy("doc_id", "zone").count().agg(F.max("count")).first()[0] == 1


def test_similarity_and_code_regions(spark, sf_dir, found):
    source = blobs.digest_blobs(spark, sf_dir).where("doc_id < 40")
    for code_only in (False, True):
        s = reports.similarity(source, 16, code_only, 256, 0.8)
        devices = source.select("device").distinct().count()
        assert s["pairs"].count() == devices**2 and s["matrix_jsd"].count() == devices
    some = found.select("doc_id", "device", "file_name", "start", "end")
    c = reports.code_regions(source.where("doc_id <> 5"), some, ["device", "file_name"], 16, 128, 0.86)
    total = c["summary"].where("device = '__OVERALL__'").first()
    assert total["candidates_total"] == some.count() and total["missing_rows"] == some.where("doc_id = 5").count()
    assert c["hits"].where("contained and not overlaps").isEmpty()
