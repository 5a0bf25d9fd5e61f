"""The corpus pipeline, stage by stage and as a whole, against brute force."""

from __future__ import annotations

import random

import pytest
from test_operators import DOCS, brute_components, brute_hits, brute_lines

import corpus_pipeline as pipeline

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
BENCH = [(1, "the quick brown fox jumps over the lazy dog and then it sleeps all day long"), (2, "short item"), (3, None)]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """Documents in two invented languages with copies, shared lines, passages of the benchmark, and odd rows."""
    r = random.Random(31)
    word = {"aa": lambda: "".join(r.choice("kztp") + r.choice("aou") for _ in range(r.randrange(1, 4))), "bb": lambda: "".join(r.choice("lmnr") + r.choice("ei") for _ in range(r.randrange(1, 4)))}
    rows = []
    for i in range(120):
        lang = ("aa", "bb")[i % 2]
        rows.append((i + 1, "\n".join(" ".join(word[lang]() for _ in range(r.randrange(6, 25))) for _ in range(r.randrange(1, 5))), lang, f"s{i % 3}"))
    shared = " ".join(word["aa"]() for _ in range(12))
    for i in range(6):
        rows.append((200 + i, f"{shared}\n{rows[2 * i][1]} {word['aa']()}", "aa", "s0"))  # a shared line, and a near copy of what is left
    rows += [(300 + i, f"{rows[2 * i + 9][1]}\n{rows[2 * i + 41][1]} {BENCH[0][1]} {word['bb']()}", "bb", None) for i in range(3)]
    rows += [(310, rows[0][1], "aa", "s1"), (311, None, None, None), (312, "", "aa", "s1"), (313, "123 ?!", "bb", "s2"), (None, rows[3][1], "bb", "s2"), (314, f"{rows[40][1]} short item", "aa", "s2")]
    rows = [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, str(folder)


def lists(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()), key=repr)


def test_stages_and_whole_run(spark, made):
    rows, folder = made
    frame = lambda x: spark.createDataFrame(x, DOCS)
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "decontaminate", "mix_sources"]

    kept = lists(pipeline.identify_language(spark, frame(rows), folder))
    gone = {r[0] for r in rows} - {r[0] for r in kept}
    assert {311, 312, 313} <= gone and set(kept) <= set(rows) and len(kept) >= len(rows) - 6

    want = sorted(((i, t) for i, _, _, t in brute_lines(kept)), key=repr)
    after = lists(pipeline.dedup_lines(spark, frame(kept), folder))
    assert sorted(((r[0], r[1]) for r in after), key=repr) == want
    assert all(r[4] == len(r[1]) for r in after)
    assert sum(a[1] != b[1] for a, b in zip(sorted(kept, key=repr), sorted(after, key=repr))) >= 5

    groups = {(x[0], x[3]) for x in brute_components(after)}
    unique = lists(pipeline.drop_near_duplicates(spark, frame(after), folder))
    assert unique == sorted((r for r in after if (r[0], True) in groups), key=repr) and len(unique) < len(after)

    clean = lists(pipeline.drop_contaminated(spark, frame(unique), folder))
    assert clean == sorted((r for r, h in zip(sorted(unique, key=repr), brute_hits(sorted(unique, key=repr), BENCH)) if h[2] == 0), key=repr)
    assert {300, 301, 302, 314} & {r[0] for r in unique} and not {300, 301, 302, 314} & {r[0] for r in clean}

    taken = pipeline.mix_sources(spark, frame(clean), folder).collect()
    by = {r[0]: r for r in clean}
    for source in {r[3] for r in clean}:
        sizes = [len(r[1].split()) for r in clean if r[3] == source]
        own = [x for x in taken if x["source"] == source]
        assert {x["source_size"] for x in own} == {sum(sizes)}
        assert abs(sum(x["size"] * x["copies"] for x in own) - own[0]["target"]) <= max(sizes)
    assert all(x["text"] == by[x["doc_id"]][1] and 1 <= x["copies"] <= 3 for x in taken)

    whole = pipeline.run(spark, folder).collect()
    key = lambda x: (repr(x["doc_id"]), x["text"], x["copies"])
    assert sorted(map(key, whole)) == sorted(map(key, taken))


def test_empty_table(spark, made, tmp_path):
    _, folder = made
    docs = spark.createDataFrame([], DOCS)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0
        docs = docs.select(*COLUMNS)
