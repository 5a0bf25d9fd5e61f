"""Queries over sources and sinks: the driver's tables are written as files, CSV, JSON or HTML and read back.

They join those of the catalog, with the DuckDB SQL that gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import BLOB, HALF, HIT_REGION, HITS, OFFSET, BLOCK, RATIO, REGION, WINDOWS, _blocks, _regions, _windows, query
from .functions.bytes import hex_of, safe_filename, unspaced
from .operators import decode, regions, stats
from .sources import blobs, candidates, html, sinks
from .sources.staging import staged

# --- files --------------------------------------------------------------------

FILES = "file AS (SELECT coalesce(lang, 'none') AS device, CAST(doc_id AS VARCHAR) || '.dat' AS file_name, encode(coalesce(text, '')) AS c FROM documents)"


def _files(spark, sf_dir) -> str:
    """Every document as a file of a folder for its language."""
    folder = staged(spark, "blobs")
    docs = blobs.document_blobs(spark, sf_dir)
    sinks.write_blobs(docs.select(F.coalesce("device", F.lit("none")).alias("device"), "file_name", F.coalesce("content", F.lit(b"")).alias("content")), folder, suffix=".dat")
    return folder


@query(f"WITH {FILES} SELECT device, file_name, CAST(octet_length(c) AS BIGINT) AS length, md5(c) AS content_md5 FROM file")
def blob_files(spark, sf_dir):
    found = blobs.read_blobs(spark, _files(spark, sf_dir))
    return found.select("device", "file_name", "length", F.md5("content").alias("content_md5"))


@query(f"WITH {FILES} SELECT device, count(*) AS files, CAST(sum(octet_length(c)) AS BIGINT) AS bytes FROM file GROUP BY device")
def blob_list(spark, sf_dir):
    folder = _files(spark, sf_dir)
    devices = [r[0] for r in blobs.document_blobs(spark, sf_dir).select(F.coalesce("device", F.lit("none"))).distinct().collect()]
    found = blobs.read_blobs(spark, [f"{folder}/{d}" for d in devices])
    return found.groupBy("device").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


_NAMED = "CASE WHEN doc_id % 11 = 0 THEN '/root/' ELSE '/root/' || coalesce(lang, 'none') || '/' || CAST(doc_id AS VARCHAR) || '/' END || CAST(doc_id % 97 AS VARCHAR) || '.dat'"


@query(f"""SELECT file_name, path FROM (SELECT regexp_extract(path, '[^/]+$') AS file_name, path, row_number() OVER (PARTITION BY regexp_extract(path, '[^/]+$') ORDER BY regexp_matches(path, '^/root/[^/]+$') DESC, path) AS r
FROM (SELECT {_NAMED} AS path FROM documents)) WHERE r = 1""")
def blob_index(spark, sf_dir):
    docs = blobs.document_blobs(spark, sf_dir).select(F.expr(_NAMED.replace("lang", "device").replace("VARCHAR", "STRING")).alias("path"))
    return blobs.by_name(docs.withColumn("file_name", F.regexp_extract("path", "[^/]+$", 0)), "/root").select("file_name", "path")


def _wanted(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Names asked for, some with a space where the blob's has a dash and some that no blob has; and the blobs."""
    docs = blobs.document_blobs(spark, sf_dir)
    name = lambda sep: F.concat(F.lit("fw"), F.when(F.col("doc_id") % 3 == 0, sep).otherwise("_"), F.col("doc_id").cast("string"))
    asked = docs.select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("no"), F.col("file_name"))).otherwise(name(" ")).alias("file_name"))
    return asked, docs.select(name("-").alias("file_name"), "content")


ASKED = """asked AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'no' ELSE CASE WHEN doc_id % 3 = 0 THEN 'fw ' ELSE 'fw_' END END || CAST(doc_id AS VARCHAR) AS file_name FROM documents),
have AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'fw-' ELSE 'fw_' END || CAST(doc_id AS VARCHAR) AS file_name, text FROM documents)"""


@query(f"WITH {ASKED} SELECT doc_id, asked.file_name, md5(coalesce(a.text, b.text)) AS content_md5 FROM asked LEFT JOIN have a ON a.file_name = asked.file_name LEFT JOIN have b ON b.file_name = replace(asked.file_name, ' ', '-')")
def resolved_blobs(spark, sf_dir):
    asked, have = _wanted(spark, sf_dir)
    return blobs.resolve(asked, have, ["file_name"]).select("doc_id", "file_name", F.md5("content").alias("content_md5"))


@query(f"WITH {ASKED} SELECT DISTINCT file_name FROM asked WHERE file_name NOT IN (SELECT file_name FROM have)")
def missing_files(spark, sf_dir):
    return blobs.missing(*_wanted(spark, sf_dir))


# --- candidates ---------------------------------------------------------------

CANDIDATE = """cand AS (SELECT doc_id, lang AS device, 'b' || CAST(doc_id % 5 AS VARCHAR) || '.dat' AS base_file, 'n "' || CAST(doc_id % 3 AS VARCHAR) || '", x.dat' AS new_file,
  CASE doc_id % 6 WHEN 0 THEN 'zz' WHEN 1 THEN CAST(doc_id AS VARCHAR) || '.0' ELSE CAST(doc_id AS VARCHAR) END AS start, CAST(doc_id + 9 AS VARCHAR) AS "end",
  CASE doc_id % 4 WHEN 0 THEN 'base' WHEN 1 THEN 'Base' WHEN 2 THEN 'new' END AS side, CASE doc_id % 3 WHEN 0 THEN 'An Insertion' WHEN 1 THEN 'a deletion, seen' END AS note FROM documents)"""


def _candidate_csv(spark, sf_dir) -> DataFrame:
    """Candidates written as CSV, with quotes, commas, blank cells, bounds like 12.0 and some that are no number; and read back."""
    path, i = staged(spark, "candidates"), F.col("doc_id")
    text = lambda c: c.cast("string")
    rows = blobs.document_blobs(spark, sf_dir).select(
        "doc_id", "device", F.concat(F.lit("b"), text(i % 5), F.lit(".dat")).alias("base_file"), F.concat(F.lit('n "'), text(i % 3), F.lit('", x.dat')).alias("new_file"),
        F.when(i % 6 == 0, "zz").when(i % 6 == 1, F.concat(text(i), F.lit(".0"))).otherwise(text(i)).alias("start"), text(i + 9).alias("end"),
        F.when(i % 4 == 0, "base").when(i % 4 == 1, "Base").when(i % 4 == 2, "new").alias("side"), F.when(i % 3 == 0, "An Insertion").when(i % 3 == 1, "a deletion, seen").alias("note"),
    )
    sinks.write_csv(rows, path)
    return candidates.read_candidates(spark, path)


@query(f"""WITH {CANDIDATE} SELECT doc_id, device, base_file, new_file, CAST(try_cast(start AS DOUBLE) AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end", side, note FROM cand WHERE try_cast(start AS DOUBLE) IS NOT NULL""")
def candidate_csv(spark, sf_dir):
    return _candidate_csv(spark, sf_dir).withColumn("doc_id", F.col("doc_id").cast("bigint"))


@query(f"""WITH {CANDIDATE} SELECT doc_id, CASE WHEN side = 'base' THEN base_file ELSE new_file END AS exact, CASE WHEN lower(trim(side)) = 'base' THEN base_file ELSE new_file END AS folded,
  CASE WHEN lower(trim(side)) = 'base' THEN base_file WHEN lower(trim(side)) = 'new' OR lower(note) LIKE '%insertion%' THEN new_file WHEN lower(note) LIKE '%deletion%' THEN base_file ELSE new_file END AS noted
FROM cand WHERE try_cast(start AS DOUBLE) IS NOT NULL""")
def side_rules(spark, sf_dir):
    rows = _candidate_csv(spark, sf_dir)
    return rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), *(candidates.side_file(rule=r).alias(r) for r in ("exact", "folded", "noted")))


@query(f"""WITH {WINDOWS}, d AS (SELECT DISTINCT doc_id, device, s, e FROM z), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id % 16 ORDER BY doc_id) - 1 AS idx FROM d)
SELECT n.idx, n.device AS base_file, CAST(n.doc_id AS VARCHAR) AS new_file, n.s AS start, n.e AS "end", z.zone, z.hexed FROM n JOIN z ON z.doc_id = n.doc_id""")
def boundary_json(spark, sf_dir):
    """Boundary documents of a sixteenth of the regions each, written as JSON and read back."""
    path = staged(spark, "boundary")
    spaced = F.rtrim(F.regexp_replace("hexed", "(..)", "$1 "))
    each = _windows(spark, sf_dir).groupBy("doc_id", "device", "start", "end").agg(F.map_from_entries(F.collect_list(F.struct("zone", spaced.alias("hexed")))).alias("windows_hex"))
    one = F.struct("doc_id", F.col("device").alias("base_file"), F.col("doc_id").cast("string").alias("new_file"), "start", "end", "windows_hex")
    docs = each.groupBy((F.col("doc_id") % 16).alias("part")).agg(F.array_sort(F.collect_list(one), lambda a, b: (a["doc_id"] - b["doc_id"]).cast("int")).alias("candidates"))
    docs.select("part", F.to_json(F.struct("candidates")).alias("value")).write.partitionBy("part").text(path)
    return candidates.read_boundary_windows(spark, path).select("idx", "base_file", "new_file", "start", "end", "zone", "hexed")


@query(f"""WITH {HALF}, {HIT_REGION}, {HITS}, known AS (SELECT *, doc_id % 13 <> 0 AS there FROM hit)
SELECT CASE WHEN grouping(device) = 1 THEN '__OVERALL__' ELSE device END AS device, count(*) AS candidates_total, count(*) FILTER (WHERE contained AND there) AS contained_hits, round(avg(CAST(contained AND there AS INT)), 6) AS contained_rate,
  count(*) FILTER (WHERE "overlaps" AND there) AS overlap_hits, round(avg(CAST("overlaps" AND there AS INT)), 6) AS overlap_rate, count(*) FILTER (WHERE NOT there) AS missing_rows FROM known GROUP BY ROLLUP (device)""")
def missing_blob_summary(spark, sf_dir):
    """Hits where some candidates' blobs are absent: these stay, as hits of nothing, and are counted."""
    start = F.col("doc_id") % 992
    asked = blobs.digest_blobs(spark, sf_dir).select("doc_id", "device", start.alias("start"), F.least(F.lit(1024), start + 27 + F.col("doc_id") % 200).alias("end"))
    table = _blocks(spark, sf_dir).where("doc_id % 13 <> 0")
    known = asked.join(table.select("doc_id", F.lit(True).alias("exists")).distinct(), "doc_id", "left").withColumn("exists", F.coalesce("exists", F.lit(False)))
    hits = regions.interval_hits(known, decode.kept(table, RATIO), ["doc_id"], OFFSET, BLOCK)
    return stats.rounded(regions.hit_summary(hits, exists="exists"), "contained_rate", "overlap_rate")


# --- records and expressions --------------------------------------------------


@query(f"WITH {REGION} SELECT doc_id, device, s AS start, e AS \"end\", side FROM region")
def record_csv(spark, sf_dir):
    path = staged(spark, "records")
    sinks.write_csv(_regions(spark, sf_dir).select("doc_id", "device", "start", "end", "side"), path)
    return spark.read.schema("doc_id bigint, device string, start bigint, `end` bigint, side string").csv(path, header=True)


@query(f"WITH {REGION} SELECT doc_id, device, side, n - s AS rest FROM region")
def record_json(spark, sf_dir):
    path = staged(spark, "documents")
    sinks.write_document(_regions(spark, sf_dir).select("doc_id", "device", "side", (F.col("n") - F.col("start")).alias("rest")), path)
    return spark.read.schema("doc_id bigint, device string, side string, rest bigint").json(path)


@query(f"WITH {BLOB} SELECT doc_id, hx AS again, 'fw' || regexp_replace(device || ' / ' || file_name || ' (x).dat', '[^A-Za-z0-9._-]+', '_', 'g') AS name FROM blob")
def hex_round_trip(spark, sf_dir):
    docs = blobs.document_blobs(spark, sf_dir)
    spaced = F.rtrim(F.regexp_replace(hex_of(F.col("content")), "(..)", "$1 "))
    name = F.concat(F.lit("fw"), safe_filename(F.concat("device", F.lit(" / "), "file_name", F.lit(" (x).dat"))))
    return docs.select("doc_id", hex_of(unspaced(spaced)).alias("again"), name.alias("name"))


# --- pages --------------------------------------------------------------------

ENTRY = r"""e AS (SELECT page_id, i AS pos, 'M' || CAST((page_id + i) % 7 AS VARCHAR) || '/x' AS model, CASE WHEN page_id % 5 = 0 THEN 'soon' WHEN i = 1 AND page_id % 4 = 0 THEN '' ELSE strftime(DATE '2020-01-01' + CAST((page_id * 37 + i) % 900 AS INT), '%b %-d, %Y') END AS date,
  CASE WHEN i = 1 AND page_id % 6 = 0 THEN '' ELSE '4.' || CAST(page_id % 9 AS VARCHAR) END AS version, 'Fix <' || CAST(page_id AS VARCHAR) || '> & more é' AS message FROM pages, (SELECT unnest([0, 1, 3]) AS i))"""
MODELS = [f"M{i}/x" for i in range(7)] + ["M9 none"]


def _changelog(spark, sf_dir) -> DataFrame:
    """Every page, with a table of entries before it: nested elements, entities, an empty message (row 2), a second wrapper and a row outside."""
    i = F.col("page_id")

    def row(k: int):
        day = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), ((i * 37 + k) % 900).cast("int")), "MMM d, yyyy")
        date = F.when(i % 5 == 0, "soon").when((F.lit(k) == 1) & (i % 4 == 0), "").otherwise(day)
        version = F.when((F.lit(k) == 1) & (i % 6 == 0), "").otherwise(F.concat(F.lit(" 4."), (i % 9).cast("string")))
        message = F.lit(" <br/> ") if k == 2 else F.concat(F.lit("<div><p>Fix\n &lt;"), i.cast("string"), F.lit("&gt; &amp; </p></div> <b>more</b> &eacute;<script>var x = 1;</script>"))
        cell = lambda kind, c: F.concat(F.lit(f"<td class='a firmware-{kind} b'>"), c, F.lit("</td>"))
        return F.concat(F.lit('<tr data-modelno="M'), ((i + k) % 7).cast("string"), F.lit('/x">'), cell("date", date), cell("version", version), cell("message", message), F.lit('<td class="firmware-message">second</td></tr>'))

    outside = F.lit('<tr data-modelno="M0/x"><td class="firmware-message">outside</td></tr><div class="firmware-table-details"><tr data-modelno="M0/x"><td class="firmware-message">second wrapper</td></tr></div>')
    page = F.concat(F.lit('<html><body><div class="x firmware-table-details"><div><img src="a"><table>'), *(row(k) for k in range(4)), F.lit("</table></div></div>"), outside, F.coalesce("html", F.lit("")))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", page.alias("html"))
    return html.changelog_rows(pages, MODELS)


@query(f"WITH {ENTRY} SELECT page_id, pos, model, date, version, message FROM e")
def html_rows(spark, sf_dir):
    return _changelog(spark, sf_dir)


@query(r"""WITH a AS (SELECT page_id, regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>') AS l FROM pages), o AS (SELECT page_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS a FROM a)
SELECT page_id, pos, regexp_extract(a, 'href="([^"]*)"', 1) AS href, trim(regexp_replace(regexp_extract(a, '>([^<]*)<', 1), '\s+', ' ', 'g')) AS label FROM o""")
def html_links(spark, sf_dir):
    return html.links(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"))


RANKED = "r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY coalesce(try_strptime(date, '%b %d, %Y'), TIMESTAMP '0001-01-01') DESC, page_id, pos) AS rank FROM e)"


@query(f"WITH {ENTRY}, {RANKED} SELECT page_id, pos, model, rank FROM r")
def changelog_sorted(spark, sf_dir):
    return html.newest_first(_changelog(spark, sf_dir), ["model"], "page_id", "pos").select("page_id", "pos", "model", "rank")


@query(f"""WITH {ENTRY}, {RANKED}, m AS (SELECT unnest({MODELS}) AS model)
SELECT model, regexp_replace(model, '[^A-Za-z0-9._-]+', '_', 'g') || '.txt' AS file, md5('Model: ' || model || chr(10) || 'Source: http://x/' || chr(10) || 'Fetched: 2024-01-01' || chr(10) || repeat('=', 80) || chr(10) || chr(10) || coalesce(
  string_agg('- ' || CASE WHEN date = '' THEN 'Unknown date' ELSE date END || ' | ' || CASE WHEN version = '' THEN 'Unknown version' ELSE version END || chr(10) || '  ' || message || chr(10) || chr(10), '' ORDER BY rank), 'No entries found.' || chr(10))) AS body_md5
FROM m LEFT JOIN r USING (model) GROUP BY model""")
def changelog_files(spark, sf_dir):
    made = html.changelog_text(_changelog(spark, sf_dir), MODELS, "page_id", "pos", source="http://x/", fetched="2024-01-01")
    return made.select("model", "file", F.md5(F.col("body").cast("binary")).alias("body_md5"))
