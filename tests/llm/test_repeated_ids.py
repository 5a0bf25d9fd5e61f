"""Tables where a doc_id has several rows, or none has an id."""

from __future__ import annotations

import random

import corpus_pipeline
from oreshaft.llm import neardup


def words(r, n):
    return " ".join(f"w{r.randrange(10**6)}" for _ in range(n))


def test_texts_of_one_doc_id_are_one_group(spark):
    r = random.Random(21)
    a, b, c, d = (words(r, 40) for _ in range(4))
    rows = [(3, a), (5, a), (5, b), (7, b), (8, c), (9, c), (9, d), (4, d), (10, words(r, 40)), (None, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(x["doc_id"], x["component_id"], x["kept"]) for x in neardup.near_duplicates(df).collect()}
    assert got == {(3, 3, True), (5, 3, False), (7, 3, False), (4, 4, True), (8, 4, False), (9, 4, False), (10, 10, True), (None, None, True)}
    left = corpus_pipeline.drop_near_duplicates(spark, df, "").collect()
    assert sorted((x["doc_id"], x["text"]) for x in left if x["doc_id"]) == [(3, a), (4, d), (10, rows[8][1])]


def test_mix_counts_every_row_of_its_own(spark):
    r = random.Random(22)
    ids = lambda i: None if i % 3 == 0 else 7 if i % 3 == 1 else 1000 + i
    rows = [(ids(i), f"r{i} " + words(r, r.randrange(1, 60)), "abc"[i % 5 % 3]) for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = corpus_pipeline.mix_sources(spark, df, "").collect()
    given = {t: (i, s) for i, t, s in rows}
    assert len({x["text"] for x in out}) == len(out) and all(given[x["text"]] == (x["doc_id"], x["source"]) for x in out)
    assert all(x["size"] == len(x["text"].split()) and x["copies"] > 0 for x in out)
    for name in "abc":
        own = [x for x in out if x["source"] == name]
        sizes = [len(t.split()) for _, t, s in rows if s == name]
        assert {x["source_size"] for x in own} == {sum(sizes)} and len({x["target"] for x in own}) == 1
        assert abs(sum(x["size"] * x["copies"] for x in own) - own[0]["target"]) <= max(sizes)
    assert len(out) < len(rows)
