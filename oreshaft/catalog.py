"""Queries over the driver's tables, by name, with the DuckDB SQL that gives the same rows.

Documents stand in for blobs (device is the language) and give one region each;
near-uniform MD5 blobs exercise the decoder. Counts are BIGINT and doubles rounded
to six digits on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.bytes import spaced
from .operators import decode, mining, regions, signatures, stats
from .operators.ranking import sources_text
from .sources import blobs, candidates, sinks

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Parameters of the decoder queries: the test blobs' blocks are 81 to 89 per cent valid.
OFFSET, BLOCK, RATIO = 16, 128, 0.86
GROUPS = {"A": ["en"], "B": ["de", "fr"]}


def _wide(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c, t in df.dtypes if t in ("int", "smallint", "tinyint")})


def query(sql: str | None = None):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return _wide(f(spark, sf_dir))

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# Common table expressions of the SQL.
BLOB = """blob AS (SELECT doc_id, lang AS device, CAST(doc_id AS VARCHAR) AS file_name, lower(hex(encode(text))) AS hx,
  CAST(octet_length(encode(text)) AS BIGINT) AS n FROM documents)"""
BYTES = "byte AS (SELECT doc_id, device, unnest(regexp_extract_all(hx, '..')) AS h FROM blob)"
HIST = f"{BLOB}, {BYTES}, hist AS (SELECT device, CAST('0x' || h AS INT) AS b, count(*) AS n FROM byte GROUP BY ALL)"
SHARE = f"""{HIST}, dev AS (SELECT device, sum(n) AS t FROM hist GROUP BY device),
share AS (SELECT dev.device, g.b, coalesce(hist.n, 0) / dev.t AS p FROM dev CROSS JOIN (SELECT unnest(range(0, 256)) AS b) g LEFT JOIN hist ON hist.device = dev.device AND hist.b = g.b)"""
REGION = f"""{BLOB}, region AS (SELECT b.doc_id, device, file_name, hx, n, b.doc_id % (n - 32) AS s,
  least(n, b.doc_id % (n - 32) + 27 + b.doc_id % 200) AS e, CASE WHEN quality = 0 THEN 'base' ELSE 'new' END AS side
  FROM blob b LEFT JOIN (SELECT doc_id, quality FROM labels) l USING (doc_id) WHERE n >= 64),
tagged AS (SELECT *, device || '/' || file_name || printf('@0x%05x', s) AS tag FROM region)"""


def _cut(a: str, b: str) -> str:
    lo, hi = f"greatest(0, least(n, {a}))", f"greatest(0, least(n, {b}))"
    return f"substr(hx, CAST(2 * {lo} + 1 AS BIGINT), CAST(2 * greatest(0, {hi} - {lo}) AS BIGINT))"


def _union(table: str, zones: dict[str, tuple[str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT doc_id, device, tag, s, e, '{z}' AS zone, {_cut(a, b)} AS hexed FROM {table}" for z, (a, b) in zones.items())


ZONES = f"{REGION}, z AS ({_union('tagged', {'prologue': ('s', 'least(s + 16, e)'), 'epilogue': ('greatest(s, e - 16)', 'e'), 'pre_context': ('s - 32', 's'), 'post_context': ('e', 'e + 32')})})"
WINDOWS = f"{REGION}, z AS ({_union('tagged', {'start_pre': ('s - 64', 's'), 'start_post': ('s', 's + 64'), 'end_pre': ('e - 64', 'e'), 'end_post': ('e', 'e + 64')})})"


def _grams(lo: int, hi: int, where: str = "true") -> str:
    return f"""gram AS (SELECT zone, doc_id, device, tag, k, o, substr(hexed, 2 * o + 1, 2 * k) AS pattern FROM (
  SELECT *, unnest(range(0, length(hexed) // 2 - k + 1)) AS o FROM (SELECT * FROM z WHERE {where}) z CROSS JOIN (SELECT unnest(range({lo}, {hi + 1})) AS k) WHERE length(hexed) // 2 >= k))"""


# --- histograms and distances -------------------------------------------------


def _shares(spark, sf_dir):
    return stats.normalised(stats.histogram(blobs.document_blobs(spark, sf_dir)))


@query(f"WITH {HIST} SELECT device, CAST(b AS BIGINT) AS b, n FROM hist")
def hist_by_device(spark, sf_dir):
    return stats.histogram(blobs.document_blobs(spark, sf_dir))


@query(f"WITH {BLOB} SELECT device, count(*) AS num_files FROM blob WHERE n > 6000 GROUP BY device")
def files_counted(spark, sf_dir):
    return stats.files_counted(blobs.document_blobs(spark, sf_dir), offset=6000)


@query(f"WITH {SHARE} SELECT device, CAST(b AS BIGINT) AS b, round(p, 6) AS p FROM share")
def hist_normalised(spark, sf_dir):
    return stats.rounded(_shares(spark, sf_dir).select("device", F.posexplode("p").alias("b", "p")), "p")


PAIR = f"WITH {SHARE}, pair AS (SELECT x.device AS d1, y.device AS d2, x.p AS p, y.p AS q FROM share x JOIN share y USING (b)), "
JSD = "v AS (SELECT d1, d2, sqrt(greatest(0, (sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END) + sum(CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END)) / 2)) AS v FROM pair GROUP BY ALL)"
CHI = "v AS (SELECT d1, d2, sum((p - q) * (p - q) / (p + q + 1e-12)) / 2 AS v FROM pair GROUP BY ALL)"
COS = "v AS (SELECT d1, d2, sum(p * q) / (sqrt(sum(p * p)) * sqrt(sum(q * q)) + 1e-12) AS v FROM pair GROUP BY ALL)"
SORTED = f"""WITH {SHARE}, ordered AS (SELECT device, p, row_number() OVER (PARTITION BY device ORDER BY p) AS b FROM share),
pair AS (SELECT x.device AS d1, y.device AS d2, x.p AS p, y.p AS q FROM ordered x JOIN ordered y USING (b)), {COS}"""


@query(f"{PAIR}{JSD} SELECT d1, d2, round(v, 6) AS jsd FROM v")
def sim_jsd(spark, sf_dir):
    return stats.rounded(stats.similarity(_shares(spark, sf_dir), ["jsd"]), "jsd")


@query(f"{PAIR}{CHI} SELECT d1, d2, round(v, 6) AS chi2 FROM v")
def sim_chi2(spark, sf_dir):
    return stats.rounded(stats.similarity(_shares(spark, sf_dir), ["chi2"]), "chi2")


@query(f"{PAIR}{COS} SELECT d1, d2, round(v, 6) AS cosine FROM v")
def sim_cosine(spark, sf_dir):
    return stats.rounded(stats.similarity(_shares(spark, sf_dir), ["cosine"]), "cosine")


@query(f"{SORTED} SELECT d1, d2, round(v, 6) AS sorted_cosine FROM v")
def sim_sorted_cosine(spark, sf_dir):
    return stats.rounded(stats.similarity(_shares(spark, sf_dir), ["sorted_cosine"]), "sorted_cosine")


@query(f"{PAIR}{JSD} SELECT d1, d2, round(v, 6) AS jsd FROM v WHERE d1 < d2 ORDER BY v, d1, d2 LIMIT 10")
def closest_by_jsd(spark, sf_dir):
    return stats.rounded(stats.closest(stats.similarity(_shares(spark, sf_dir), ["jsd"]), "jsd"), "jsd")


@query(f"{SORTED} SELECT d1, d2, round(v, 6) AS sorted_cosine FROM v WHERE d1 < d2 ORDER BY v DESC, d1 DESC, d2 DESC LIMIT 10")
def closest_by_sorted_cosine(spark, sf_dir):
    return stats.rounded(stats.closest(stats.similarity(_shares(spark, sf_dir), ["sorted_cosine"]), "sorted_cosine", descending=True), "sorted_cosine")


@query(f"""{PAIR}{JSD} SELECT d1 AS device, {', '.join(f"max(CASE WHEN d2 = '{d}' THEN format('{{:.6f}}', v) END) AS {d}" for d in ("de", "en", "es", "fr"))} FROM v GROUP BY d1""")
def jsd_matrix(spark, sf_dir):
    return sinks.matrix(stats.similarity(_shares(spark, sf_dir), ["jsd"]), "jsd")


@query(f"""WITH {SHARE} SELECT device, max((SELECT count(*) FROM blob WHERE blob.device = share.device AND n > 0)) AS num_files, {', '.join(f"max(CASE WHEN b = {b} THEN format('{{:.10f}}', p) END) AS b{b:02x}" for b in range(256))} FROM share GROUP BY device""")
def hist_wide(spark, sf_dir):
    return sinks.wide_histogram(_shares(spark, sf_dir), stats.files_counted(blobs.document_blobs(spark, sf_dir)))


@query(f"WITH {HIST} SELECT device, round(-sum((n / t) * log2(n / t)), 6) AS entropy FROM (SELECT *, sum(n) OVER (PARTITION BY device) AS t FROM hist) GROUP BY device")
def device_entropy(spark, sf_dir):
    return stats.rounded(stats.byte_entropy(stats.histogram(blobs.document_blobs(spark, sf_dir)), ["device"]), "entropy")


# --- decoder ------------------------------------------------------------------

HALF = """md AS (SELECT doc_id, lang AS device, CAST(doc_id AS VARCHAR) AS file_name, (SELECT string_agg(md5(concat(CAST(doc_id AS VARCHAR), ':', CAST(i AS VARCHAR))), '' ORDER BY i) FROM range(0, 64) r(i)) AS hx FROM documents),
half AS (SELECT doc_id, device, i, CAST('0x' || substr(hx, 4 * i + 35, 2) || substr(hx, 4 * i + 33, 2) AS INT) AS h FROM (SELECT *, unnest(range(0, 504)) AS i FROM md)),
could AS (SELECT *, coalesce(h >= 59392 AND lead(h) OVER w NOT IN (0, 65535), false) AS c FROM half WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
run AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - row_number() OVER (PARTITION BY doc_id, c ORDER BY i) AS g FROM could),
st AS (SELECT *, c AND row_number() OVER (PARTITION BY doc_id, c, g ORDER BY i) % 2 = 1 AS s32 FROM run),
mask AS (SELECT *, s32 OR (NOT coalesce(lag(s32) OVER (PARTITION BY doc_id ORDER BY i), false) AND (h < 49152 OR (h >= 53248 AND h < 59392))) AS ok FROM st),
blk AS (SELECT doc_id, device, bk AS block, 16 + 128 * bk AS start, 16 + 128 * bk + 2 * count(*) AS stop, count(*) AS halfwords, count(*) FILTER (WHERE ok) AS valid,
  count(*) FILTER (WHERE h & 65280 = 48384) AS pop_pc, count(*) FILTER (WHERE h = 18288) AS bx_lr, count(*) FILTER (WHERE h = 18167) AS mov_pc_lr, count(*) FILTER (WHERE h & 65280 = 46336) AS push_lr,
  count(*) FILTER (WHERE ok) / count(*) AS ratio FROM (SELECT *, i // 64 AS bk FROM mask) GROUP BY doc_id, device, bk)"""


def _blocks(spark, sf_dir):
    return decode.blocks(blobs.digest_blobs(spark, sf_dir), OFFSET, BLOCK)


@query(f"WITH {HALF} SELECT doc_id, device, count(*) AS halfwords, count(*) FILTER (WHERE ok) AS valid FROM mask GROUP BY ALL")
def thumb_mask_ratio(spark, sf_dir):
    return _blocks(spark, sf_dir).groupBy("doc_id", "device").agg(F.sum("halfwords").alias("halfwords"), F.sum("valid").alias("valid"))


@query(f"WITH {HALF} SELECT doc_id, block, start, stop, valid FROM blk WHERE ratio >= {RATIO}")
def kept_blocks(spark, sf_dir):
    return decode.kept(_blocks(spark, sf_dir), RATIO).select("doc_id", "block", "start", "stop", "valid")


@query(f"""WITH {HALF} SELECT doc_id, count(*) FILTER (WHERE ratio >= {RATIO}) AS kept_blocks, count(*) AS total_blocks, CAST(coalesce(sum(2 * halfwords) FILTER (WHERE ratio >= {RATIO}), 0) AS BIGINT) AS kept_bytes,
  CAST(sum(2 * halfwords) AS BIGINT) AS total_bytes, round(coalesce(sum(2 * halfwords) FILTER (WHERE ratio >= {RATIO}), 0) / sum(2 * halfwords), 6) AS kept_fraction FROM blk GROUP BY doc_id""")
def block_meta(spark, sf_dir):
    return stats.rounded(decode.block_meta(_blocks(spark, sf_dir), ["doc_id"], RATIO), "kept_fraction")


@query(f"WITH {HALF} SELECT doc_id, CAST(sum(stop - start) OVER w - (stop - start) AS BIGINT) AS out_start, CAST(sum(stop - start) OVER w AS BIGINT) AS out_end, start AS src_start, stop AS src_end, stop - start AS len FROM blk WHERE ratio >= {RATIO} WINDOW w AS (PARTITION BY doc_id ORDER BY start)")
def codeonly_map(spark, sf_dir):
    return decode.codeonly_map(_blocks(spark, sf_dir), ["doc_id"], RATIO)


@query(f"WITH {HALF} SELECT blk.doc_id, md5(string_agg(substr(hx, 2 * start + 1, 2 * (stop - start)), '' ORDER BY start)) AS content_md5 FROM blk JOIN md USING (doc_id) WHERE ratio >= {RATIO} GROUP BY blk.doc_id")
def codeonly_blobs(spark, sf_dir):
    source = blobs.digest_blobs(spark, sf_dir)
    made = decode.codeonly_blobs(source, decode.blocks(source, OFFSET, BLOCK), ["doc_id"], RATIO)
    return made.select("doc_id", F.md5(F.lower(F.hex("content")).cast("binary")).alias("content_md5"))


CODE = "code AS (SELECT m.device, m.h FROM mask m JOIN blk ON blk.doc_id = m.doc_id AND blk.block = m.i // 64 WHERE ratio >= {ratio})"


@query(f"WITH {HALF}, {CODE.format(ratio=RATIO)} SELECT device, CAST(b AS BIGINT) AS b, count(*) AS n FROM (SELECT device, h % 256 AS b FROM code UNION ALL SELECT device, h // 256 AS b FROM code) GROUP BY ALL")
def codeonly_hist(spark, sf_dir):
    return stats.codeonly_histogram(blobs.digest_blobs(spark, sf_dir), "device", OFFSET, BLOCK, RATIO, rule="down")


@query(f"""WITH {HALF}, s AS (SELECT device, sum(2 * halfwords) AS t, coalesce(sum(halfwords) FILTER (WHERE ratio >= {RATIO}), 0) AS w,
  {', '.join(f"coalesce(sum({c}) FILTER (WHERE ratio >= {RATIO}), 0) AS {c}" for c in ("pop_pc", "bx_lr", "mov_pc_lr", "push_lr"))} FROM blk GROUP BY device)
SELECT device, round(2 * w / t, 6) AS kept_frac, CAST(w AS BIGINT) AS total_halfwords_counted, {', '.join(f"round(1000.0 * {c} / greatest(w, 1), 6) AS {c}_per_1k" for c in ("pop_pc", "bx_lr", "mov_pc_lr", "push_lr"))} FROM s""")
def return_rates(spark, sf_dir):
    out = decode.return_rates(_blocks(spark, sf_dir), "device", RATIO)
    return stats.rounded(out, *(c for c in out.columns if c not in ("device", "total_halfwords_counted")))


HIT_REGION = "reg AS (SELECT doc_id, lang AS device, doc_id % 992 AS s, least(1024, doc_id % 992 + 27 + doc_id % 200) AS e FROM documents)"
HITS = f"""hit AS (SELECT r.doc_id, r.device, r.s, r.e, coalesce(bool_or(s >= start AND e <= stop), false) AS contained, coalesce(bool_or(NOT (e <= start OR s >= stop)), false) AS "overlaps"
  FROM reg r LEFT JOIN (SELECT * FROM blk WHERE ratio >= {RATIO}) b ON b.doc_id = r.doc_id GROUP BY ALL)"""


def _hits(spark, sf_dir):
    table = _blocks(spark, sf_dir)
    start = F.col("doc_id") % 992
    own = blobs.digest_blobs(spark, sf_dir).select("doc_id", "device", start.alias("start"), F.least(F.lit(1024), start + 27 + F.col("doc_id") % 200).alias("end"))
    return regions.interval_hits(own, decode.kept(table, RATIO), ["doc_id"], OFFSET, BLOCK)


@query(f'WITH {HALF}, {HIT_REGION}, {HITS} SELECT doc_id, device, s AS start, e AS "end", contained, "overlaps" FROM hit')
def candidate_hits(spark, sf_dir):
    return _hits(spark, sf_dir)


@query(f"""WITH {HALF}, {HIT_REGION}, {HITS} SELECT CASE WHEN grouping(device) = 1 THEN '__OVERALL__' ELSE device END AS device, count(*) AS candidates_total, count(*) FILTER (WHERE contained) AS contained_hits,
  round(avg(CAST(contained AS INT)), 6) AS contained_rate, count(*) FILTER (WHERE "overlaps") AS overlap_hits, round(avg(CAST("overlaps" AS INT)), 6) AS overlap_rate, CAST(0 AS BIGINT) AS missing_rows FROM hit GROUP BY ROLLUP (device)""")
def candidate_hit_summary(spark, sf_dir):
    return stats.rounded(regions.hit_summary(_hits(spark, sf_dir)), "contained_rate", "overlap_rate")


# --- regions ------------------------------------------------------------------


def _regions(spark, sf_dir):
    return candidates.document_regions(spark, sf_dir)


def _zones(spark, sf_dir):
    return regions.region_zones(_regions(spark, sf_dir))


def _windows(spark, sf_dir):
    return regions.boundary_windows(_regions(spark, sf_dir))


@query(f"WITH {WINDOWS} SELECT doc_id, zone, trim(regexp_replace(hexed, '(..)', '\\1 ', 'g')) AS hex FROM z")
def boundary_windows(spark, sf_dir):
    return _windows(spark, sf_dir).select("doc_id", "zone", spaced(F.col("hexed")).alias("hex"))


@query(f"WITH {ZONES} SELECT doc_id, tag, zone, hexed FROM z")
def region_zones(spark, sf_dir):
    return _zones(spark, sf_dir).select("doc_id", "tag", "zone", "hexed")


@query(f"""WITH {ZONES} SELECT doc_id, tag, s AS start, e AS "end", {', '.join(f"max(hexed) FILTER (WHERE zone = '{z}') AS {z}" for z in regions.ZONES)}, greatest(0, e - s - 32) AS omitted FROM z GROUP BY ALL""")
def region_dump(spark, sf_dir):
    return regions.region_dump(_regions(spark, sf_dir))


@query(f"WITH {REGION} SELECT side, CASE WHEN side = 'base' THEN 'b.dat' ELSE 'n.dat' END AS file, count(*) AS n FROM region GROUP BY ALL")
def side_files(spark, sf_dir):
    named = _regions(spark, sf_dir).withColumns({"base_file": F.lit("b.dat"), "new_file": F.lit("n.dat")})
    return named.select("side", candidates.side_file().alias("file")).groupBy("side", "file").agg(F.count("*").alias("n"))


@query(f"""WITH {REGION}, g AS (SELECT device, CASE WHEN device = 'en' THEN 'A' WHEN device IN ('de', 'fr') THEN 'B' ELSE 'ungrouped' END AS grp FROM region)
SELECT grp, count(*) AS n FROM (SELECT grp FROM g UNION ALL SELECT 'combined' FROM g) GROUP BY grp""")
def group_routing(spark, sf_dir):
    return regions.route_groups(_regions(spark, sf_dir), GROUPS).groupBy("grp").agg(F.count("*").alias("n"))


@query(f"WITH {REGION} SELECT count(*) FILTER (WHERE s < least(n, e)) AS regions, count(*) FILTER (WHERE NOT s < least(n, e)) AS skipped FROM region")
def region_counts(spark, sf_dir):
    return regions.region_counts(_regions(spark, sf_dir))


@query(f"""WITH {REGION} SELECT what, a AS align, count(*) FILTER (WHERE v % a = 0) AS aligned, count(*) AS total FROM (
  SELECT 'start' AS what, s AS v FROM region UNION ALL SELECT 'end', e FROM region UNION ALL SELECT 'length', e - s FROM region) CROSS JOIN (SELECT CAST(unnest([2, 4]) AS BIGINT) AS a) GROUP BY ALL""")
def alignment(spark, sf_dir):
    return regions.alignment(_regions(spark, sf_dir))


@query(f"WITH {REGION} SELECT min(e - s) AS min_len, max(e - s) AS max_len, round(avg(e - s), 6) AS mean_len, round(median(e - s), 6) AS median_len FROM region")
def length_stats(spark, sf_dir):
    return stats.rounded(regions.length_stats(_regions(spark, sf_dir)), "mean_len", "median_len")


@query(f"WITH {REGION} SELECT m, (e - s) % m AS rest, count(*) AS n FROM region CROSS JOIN (SELECT CAST(unnest([2, 3, 4]) AS BIGINT) AS m) GROUP BY ALL")
def length_mods(spark, sf_dir):
    return regions.length_mods(_regions(spark, sf_dir))


EDGE = " UNION ALL ".join(f"SELECT doc_id, '{z}' AS edge, {_cut(a, b)} AS h FROM region" for z, (a, b) in {"first": ("s", "s + 1"), "last": ("e - 1", "e"), "before": ("s - 1", "s"), "after": ("e", "e + 1")}.items())


@query(f"""WITH {REGION}, c AS (SELECT edge, h, count(*) AS n, min(doc_id) AS seen FROM ({EDGE}) WHERE h <> '' GROUP BY ALL)
SELECT edge, CAST(CAST('0x' || h AS INT) AS BIGINT) AS b, n, seen FROM c QUALIFY row_number() OVER (PARTITION BY edge ORDER BY n DESC, seen) <= 20""")
def edge_bytes(spark, sf_dir):
    return regions.edge_bytes(_regions(spark, sf_dir))


@query(f"""WITH {REGION}, c AS (SELECT edge, h, count(*) AS n, min(doc_id) AS seen, count(DISTINCT tag) AS sources FROM (
  SELECT doc_id, tag, 'first' AS edge, {_cut('s', 's + 2')} AS h FROM tagged UNION ALL SELECT doc_id, tag, 'last', {_cut('e - 2', 'e')} FROM tagged) GROUP BY ALL)
SELECT edge, h AS pair, n, sources FROM c QUALIFY row_number() OVER (PARTITION BY edge ORDER BY n DESC, seen) <= 20""")
def edge_pairs(spark, sf_dir):
    return regions.edge_pairs(_regions(spark, sf_dir)).drop("tags", "more")


ZBYTE = "zb AS (SELECT zone, unnest(regexp_extract_all(hexed, '..')) AS h FROM z)"


@query(f"WITH {ZONES}, {ZBYTE}, c AS (SELECT zone, h, count(*) AS n FROM zb GROUP BY ALL) SELECT zone, round(-sum((n / t) * log2(n / t)), 6) AS entropy FROM (SELECT *, sum(n) OVER (PARTITION BY zone) AS t FROM c) GROUP BY zone")
def zone_entropy(spark, sf_dir):
    return stats.rounded(regions.zone_entropy(_zones(spark, sf_dir)), "entropy")


def _positional(roles: str) -> str:
    return f"""WITH {ZONES}, zp AS (SELECT zone, doc_id, pos, CAST('0x' || substr(rpad(hexed, 32, '0'), 2 * pos + 1, 2) AS INT) AS b FROM (SELECT *, unnest(range(0, 16)) AS pos FROM z)),
c AS (SELECT zone, pos, b, count(*) AS n, min(doc_id) AS seen FROM zp GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY zone, pos) AS t, row_number() OVER (PARTITION BY zone, pos ORDER BY n DESC, seen) AS rn FROM c),
x AS (SELECT zone, pos, round(-sum((n / t) * log2(n / t)), 6) + 0.0 AS entropy, CAST(max(b) FILTER (WHERE rn = 1) AS BIGINT) AS top_value, max(n) AS top_count, CAST(max(t) AS BIGINT) AS total FROM r GROUP BY ALL)
SELECT *, {roles} AS role FROM x"""


@query(_positional("CASE WHEN entropy < 3 THEN 'OPCODE?' WHEN entropy < 5 THEN 'mixed' ELSE 'operand' END"))
def positional_entropy(spark, sf_dir):
    return stats.rounded(regions.positional_entropy(_zones(spark, sf_dir)), "entropy")


@query(_positional("CASE WHEN entropy < 2 THEN '★OPCODE★' WHEN entropy < 3.5 THEN 'opcode?' WHEN entropy < 5 THEN 'mixed' ELSE 'operand' END"))
def positional_entropy_v3(spark, sf_dir):
    return stats.rounded(regions.positional_entropy(_zones(spark, sf_dir), version=3), "entropy")


# --- mining -------------------------------------------------------------------

_ENDS = """e AS (SELECT zone, doc_id, k, {piece} AS pattern FROM (SELECT *, unnest(range(4, least(16, length(hexed) // 2) + 1)) AS k FROM z)),
c AS (SELECT zone, pattern, count(*) AS n, min((doc_id, k)) AS seen FROM e GROUP BY ALL)"""
PREFIX, SUFFIX = _ENDS.format(piece="substr(hexed, 1, 2 * k)"), _ENDS.format(piece="substr(hexed, length(hexed) - 2 * k + 1, 2 * k)")


@query(f"WITH {WINDOWS}, {PREFIX} SELECT zone, pattern, n FROM c")
def prefix_counts(spark, sf_dir):
    return mining.prefixes(_windows(spark, sf_dir)).select("zone", "pattern", "n")


@query(f"WITH {WINDOWS}, {SUFFIX} SELECT zone, pattern, n FROM c")
def suffix_counts(spark, sf_dir):
    return mining.suffixes(_windows(spark, sf_dir)).select("zone", "pattern", "n")


@query(f"""WITH {WINDOWS}, p AS (WITH {PREFIX} SELECT * FROM c WHERE zone IN ('start_post', 'end_post')), q AS (WITH {SUFFIX} SELECT * FROM c WHERE zone IN ('start_pre', 'end_pre'))
SELECT zone, pattern, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY n DESC, length(pattern) DESC, seen) AS rank FROM (SELECT * FROM p UNION ALL SELECT * FROM q)) WHERE rank <= 30""")
def boundary_top(spark, sf_dir):
    w = _windows(spark, sf_dir)
    both = mining.prefixes(w.where("zone in ('start_post', 'end_post')")).unionByName(mining.suffixes(w.where("zone in ('start_pre', 'end_pre')")))
    return mining.top_patterns(both, top=30, longest_first=True).select("zone", "pattern", "n", "rank")


KGRAM = """kg AS (SELECT zone, k, pattern, count(*) AS n, min((doc_id, k, o)) AS seen FROM gram WHERE k IN (4, 6, 8, 10, 12) GROUP BY ALL)"""


@query(f"""WITH {WINDOWS}, {_grams(4, 12, "zone IN ('start_post', 'end_pre')")}, {KGRAM}
SELECT zone, k, pattern, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY zone, k ORDER BY n DESC, seen) AS rank FROM kg) WHERE rank <= 30""")
def kgram_topk(spark, sf_dir):
    w = _windows(spark, sf_dir).where("zone in ('start_post', 'end_pre')")
    return mining.top_grams(w, (4, 6, 8, 10, 12), 30).select("zone", "k", "pattern", "n", "rank")


NGRAM = "c AS (SELECT zone, pattern, count(*) AS n, min((doc_id, k, o)) AS seen, count(DISTINCT tag) AS sources FROM gram GROUP BY ALL)"


def _ngram_sql(least: int, top: int) -> str:
    return f"""WITH {ZONES}, {_grams(2, 8)}, {NGRAM}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY n DESC, seen) AS rank FROM c WHERE n >= {least}) WHERE rank <= {top}),
listed AS (SELECT zone, pattern, string_agg(tag, ', ' ORDER BY tag) FILTER (WHERE r <= 6) || CASE WHEN max(r) > 6 THEN ' (+' || (max(r) - 6) || ' more)' ELSE '' END AS listed FROM (
  SELECT zone, pattern, tag, row_number() OVER (PARTITION BY zone, pattern ORDER BY tag) AS r FROM (SELECT DISTINCT zone, pattern, tag FROM gram SEMI JOIN best USING (zone, pattern))) GROUP BY ALL)
SELECT zone, pattern, n, sources, listed, rank FROM best JOIN listed USING (zone, pattern)"""


def _ngram_top(spark, sf_dir, least: int, top: int):
    grams = mining.ngrams(_zones(spark, sf_dir), extra=("tag",))
    best = mining.with_sources(mining.top_patterns(mining.counted(grams), top=top, least=least), grams)
    return best.select("zone", "pattern", "n", "sources", sources_text().alias("listed"), "rank")


@query(_ngram_sql(3, 40))
def ngram_topk(spark, sf_dir):
    return _ngram_top(spark, sf_dir, 3, 40)


@query(_ngram_sql(2, 20))
def ngram_topk_v3(spark, sf_dir):
    return _ngram_top(spark, sf_dir, 2, 20)


@query(f"""WITH {ZONES}, {_grams(4, 8, "zone = 'prologue'")}, c AS (SELECT pattern, count(DISTINCT device) AS devices, count(DISTINCT tag) AS sources, min((doc_id, k, o)) AS seen FROM gram GROUP BY ALL)
SELECT pattern, devices, sources FROM c WHERE devices >= 2 ORDER BY devices DESC, length(pattern) DESC, seen LIMIT 30""")
def cross_device_ngrams(spark, sf_dir):
    grams = mining.ngrams(_zones(spark, sf_dir).where("zone = 'prologue'"), extra=("device", "tag"))
    return mining.cross_device(grams).select("pattern", "devices", "sources")


def _signature_cte(version: int) -> str:
    rows = ", ".join("({}, '{}', '{}')".format(i, name.replace("'", "''"), p.replace("?", "_")) for i, (name, p) in enumerate(signatures.registry(version)))
    return f"""sig(ordinal, name, p) AS (VALUES {rows}),
hit AS (SELECT doc_id, tag, zone, ordinal, name, min(o) AS off FROM (SELECT z.*, ordinal, name, p, unnest(range(0, length(hexed) // 2 - length(p) // 2 + 1)) AS o FROM z, sig WHERE length(hexed) >= length(p))
  WHERE substr(hexed, 2 * o + 1, length(p)) LIKE p GROUP BY ALL)"""


def _scan(spark, sf_dir, version):
    return signatures.scan(_zones(spark, sf_dir), signatures.registry(version))


@query(f"WITH {ZONES}, {_signature_cte(2)} SELECT doc_id, zone, CAST(ordinal AS BIGINT) AS ordinal, off FROM hit")
def signature_hits(spark, sf_dir):
    return _scan(spark, sf_dir, 2).select("doc_id", "zone", "ordinal", "off")


@query(f"WITH {ZONES}, {_signature_cte(3)} SELECT doc_id, zone, CAST(ordinal AS BIGINT) AS ordinal, off FROM hit")
def signature_hits_v3(spark, sf_dir):
    return _scan(spark, sf_dir, 3).select("doc_id", "zone", "ordinal", "off")


@query(f"WITH {ZONES}, {_signature_cte(2)} SELECT CAST(ordinal AS BIGINT) AS ordinal, name, zone, count(*) AS hits, count(DISTINCT tag) AS sources FROM hit GROUP BY ALL")
def signature_report(spark, sf_dir):
    return signatures.report(_scan(spark, sf_dir, 2)).drop("tags", "more")


@query(f"WITH {ZONES}, {_signature_cte(2)} SELECT split_part(name, ' ', 1) AS arch, count(*) AS hits FROM hit GROUP BY ALL")
def arch_scores(spark, sf_dir):
    return signatures.scores(_scan(spark, sf_dir, 2))


@query(f"WITH {ZONES}, {_signature_cte(3)} SELECT split_part(name, ' ', 1) AS arch, count(*) AS hits FROM hit GROUP BY ALL")
def arch_scores_v3(spark, sf_dir):
    return signatures.scores(_scan(spark, sf_dir, 3))


def _motif_cte(k: int, wild: int, contiguous: bool) -> str:
    every = mining.masks(k, wild, contiguous)
    rows = ", ".join(f"({i}, {k - len(m)}, '{''.join('1' if j in m else '0' for j in range(k))}')" for i, m in enumerate(every))
    form = " || ".join(f"CASE WHEN substr(holes, {i + 1}, 1) = '1' THEN '??' ELSE substr(pattern, {2 * i + 1}, 2) END" for i in range(k))
    return f"""mask(m, fixed, holes) AS (VALUES {rows}),
gc AS (SELECT zone, pattern, count(*) AS n, min((doc_id, k, o)) AS seen FROM gram GROUP BY ALL),
form AS (SELECT zone, {form} AS pattern, fixed, holes, n, seen, m FROM gc CROSS JOIN mask),
mc AS (SELECT zone, pattern, fixed, holes, sum(n) AS n, min((seen, m)) AS seen FROM form GROUP BY ALL HAVING sum(n) >= 4),
motif AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY n DESC, fixed DESC, seen) AS rank FROM mc) WHERE rank <= 40)"""


_TWO = "zone IN ('start_post', 'end_pre')"


def _motifs(spark, sf_dir, **how):
    return mining.motifs(_windows(spark, sf_dir).where(_TWO), **how)


@query(f"WITH {WINDOWS}, {_grams(8, 8, _TWO)}, {_motif_cte(8, 3, False)} SELECT zone, pattern, CAST(fixed AS BIGINT) AS fixed, CAST(n AS BIGINT) AS n, rank FROM motif")
def motif_mine(spark, sf_dir):
    return _motifs(spark, sf_dir).select("zone", "pattern", "fixed", "n", "rank")


@query(f"WITH {WINDOWS}, {_grams(8, 8, _TWO)}, {_motif_cte(8, 3, True)} SELECT zone, pattern, CAST(fixed AS BIGINT) AS fixed, CAST(n AS BIGINT) AS n, rank FROM motif")
def motif_mine_contiguous(spark, sf_dir):
    return _motifs(spark, sf_dir, contiguous=True).select("zone", "pattern", "fixed", "n", "rank")


@query(f"""WITH {WINDOWS}, {_grams(8, 8, _TWO)}, {_motif_cte(8, 3, False)}, w AS (SELECT doc_id, zone, sum(w) AS w FROM (
  SELECT DISTINCT g.doc_id, g.zone, motif.rank, CAST(8 * motif.n * motif.fixed AS DOUBLE) AS w FROM gram g JOIN motif ON motif.zone = g.zone AND g.pattern LIKE replace(motif.pattern, '?', '_')) GROUP BY ALL),
s AS (SELECT r.doc_id, coalesce(a.w, 0) AS start_score, coalesce(b.w, 0) AS end_score FROM region r LEFT JOIN w a ON a.doc_id = r.doc_id AND a.zone = 'start_post' LEFT JOIN w b ON b.doc_id = r.doc_id AND b.zone = 'end_pre')
SELECT doc_id, round(start_score, 6) AS start_score, round(end_score, 6) AS end_score, round(start_score + end_score, 6) AS total_score, row_number() OVER (ORDER BY start_score + end_score DESC, doc_id) AS rank FROM s""")
def motif_score_rank(spark, sf_dir):
    w = _windows(spark, sf_dir).where(_TWO)
    ranked = mining.rank_by_motifs(w, mining.motif_hits(w, mining.motifs(w)))
    return stats.rounded(ranked.drop("top_start_hit", "top_end_hit"), "start_score", "end_score", "total_score")


def _template_cte(threshold: float, least: str = "3") -> str:
    return f"""w AS (SELECT zone, k, doc_id, o, tag, pattern FROM gram),
wb AS (SELECT *, substr(pattern, 2 * pos + 1, 2) AS b FROM (SELECT *, unnest(range(0, k)) AS pos FROM w)),
pc AS (SELECT zone, k, pos, b, count(*) AS n FROM wb GROUP BY ALL),
pe AS (SELECT zone, k, pos, sum(n) AS t, round(-sum((n / t) * log2(n / t)), 12) AS ent FROM (SELECT *, sum(n) OVER (PARTITION BY zone, k, pos) AS t FROM pc) GROUP BY ALL),
an AS (SELECT zone, k, list(pos ORDER BY pos) AS anchors FROM pe WHERE ent < {threshold} GROUP BY ALL HAVING max(t) >= {least}),
kw AS (SELECT w.*, array_to_string(list_transform(anchors, lambda p: substr(pattern, 2 * p + 1, 2)), '') AS key FROM w JOIN an USING (zone, k)),
gr AS (SELECT zone, k, key, count(*) AS n, count(DISTINCT tag) AS sources, min((doc_id, o)) AS seen FROM kw GROUP BY ALL HAVING count(*) >= {least}),
cb AS (SELECT zone, k, key, pos, b, count(*) AS n, min((doc_id, o)) AS seen FROM (SELECT *, substr(pattern, 2 * pos + 1, 2) AS b FROM (SELECT kw.*, unnest(range(0, k)) AS pos FROM kw JOIN gr USING (zone, k, key))) GROUP BY ALL),
ce AS (SELECT zone, k, key, pos, round(-sum((n / t) * log2(n / t)), 12) AS ent, max(b) FILTER (WHERE rn = 1) AS b FROM (
  SELECT *, sum(n) OVER (PARTITION BY zone, k, key, pos) AS t, row_number() OVER (PARTITION BY zone, k, key, pos ORDER BY n DESC, seen) AS rn FROM cb) GROUP BY ALL),
tp AS (SELECT zone, k, key, string_agg(CASE WHEN ent < 1 THEN b ELSE '??' END, '' ORDER BY pos) AS template, count(*) FILTER (WHERE ent < 1) AS fixed FROM ce GROUP BY ALL HAVING fixed >= 1),
t AS (SELECT zone, k, template, n, sources, fixed FROM tp JOIN gr USING (zone, k, key))"""


_INNER = "zone IN ('prologue', 'epilogue')"
_TEMPLATE_COLUMNS = ("zone", "k", "template", "n", "sources", "fixed")
#: Text bytes are alike everywhere, at 4.4 to 4.6 bits: with this bound all positions are anchors.
ALL_ANCHORS = 5.0
#: Bytes 0 to 7 of a zone cut to their lowest bit: with the miners' own bounds of 3 and 2.5 bits some positions are anchors and others are not.
_HALF_SQL = "".join(f"CASE WHEN length(hexed) > {2 * i} THEN '0' || CASE WHEN substr(hexed, {2 * i + 2}, 1) IN ('1', '3', '5', '7', '9', 'b', 'd', 'f') THEN '1' ELSE '0' END ELSE '' END || " for i in range(8))
HALF_ZONES = ZONES.replace(", z AS (", ", z0 AS (") + f", z AS (SELECT doc_id, device, tag, s, e, zone, {_HALF_SQL}substr(hexed, 17) AS hexed FROM z0 WHERE {_INNER})"


def _half_zones(spark, sf_dir):
    digit = lambda i: F.substring("hexed", 2 * i + 2, 1)
    cells = [F.when(F.char_length("hexed") > 2 * i, F.when(digit(i).isin(*"13579bdf"), "01").otherwise("00")).otherwise("") for i in range(8)]
    return _zones(spark, sf_dir).where(_INNER).withColumn("hexed", F.concat(*cells, F.substring("hexed", 17, 1 << 20)))


_DEDUP_SQL = "SELECT zone, k, template, n, sources, fixed FROM t WHERE NOT EXISTS (SELECT 1 FROM t x, (SELECT CAST(unnest(range(0, {span})) AS BIGINT) AS at0) WHERE x.zone = t.zone AND x.k > t.k AND x.n >= t.n * 0.8 AND at0 <= x.k - t.k AND regexp_matches(substr(x.template, 2 * at0 + 1, 2 * t.k), '^' || replace(t.template, '??', '..') || '$'))"


def _templates(spark, sf_dir):
    return mining.templates(_zones(spark, sf_dir).where(_INNER), threshold=ALL_ANCHORS)


@query(f"WITH {ZONES}, {_grams(2, 6, _INNER)}, {_template_cte(ALL_ANCHORS)} SELECT zone, k, template, n, sources, fixed FROM t")
def templates(spark, sf_dir):
    return _templates(spark, sf_dir).select(*_TEMPLATE_COLUMNS)


@query(f"""WITH {ZONES}, {_grams(2, 6, _INNER)}, {_template_cte(ALL_ANCHORS)} SELECT zone, k, template, n, sources, fixed FROM t WHERE NOT EXISTS (
  SELECT 1 FROM t x, (SELECT CAST(unnest(range(0, 5)) AS BIGINT) AS at0) WHERE x.zone = t.zone AND x.k > t.k AND x.n >= t.n * 0.8 AND at0 <= x.k - t.k AND substr(x.template, 2 * at0 + 1, 2 * t.k) LIKE replace(t.template, '?', '_'))""")
def templates_dedup(spark, sf_dir):
    return mining.dedup_templates(_templates(spark, sf_dir)).select(*_TEMPLATE_COLUMNS)


@query(f"WITH {HALF_ZONES}, {_grams(2, 6)}, {_template_cte(3.0)} SELECT zone, k, template, n, sources, fixed FROM t")
def templates_wild(spark, sf_dir):
    return mining.templates(_half_zones(spark, sf_dir)).select(*_TEMPLATE_COLUMNS)


@query(f"WITH {HALF_ZONES}, {_grams(2, 6)}, {_template_cte(3.0)} {_DEDUP_SQL.format(span=5)}")
def templates_wild_dedup(spark, sf_dir):
    return mining.dedup_templates(mining.templates(_half_zones(spark, sf_dir))).select(*_TEMPLATE_COLUMNS)


@query(f"WITH {HALF_ZONES}, {_grams(2, 8)}, {_template_cte(2.5, '(SELECT greatest(2, count(*) // 8) FROM region WHERE s < least(n, e))')} SELECT zone, k, template, n, sources, fixed FROM t")
def templates_v3(spark, sf_dir):
    found = regions.region_counts(_regions(spark, sf_dir)).first()["regions"]
    return mining.templates(_half_zones(spark, sf_dir), range(2, 9), max(2, found // 8), 2.5).select(*_TEMPLATE_COLUMNS)


# --- signals ------------------------------------------------------------------

SHORT = f"{BLOB}, sb AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, CAST('0x' || unnest(l) AS INT) AS b FROM (SELECT doc_id, regexp_extract_all(hx, '..') AS l FROM blob))"


def _series(spark, sf_dir):
    return blobs.document_blobs(spark, sf_dir).select("doc_id", "content")


@query(f"""WITH {SHORT}, m AS (SELECT x.doc_id, lag, count(*) AS n, sum(CAST(x.b AS BIGINT)) AS a, sum(CAST(y.b AS BIGINT)) AS c, sum(CAST(x.b * y.b AS BIGINT)) AS ac, sum(CAST(x.b * x.b AS BIGINT)) AS aa, sum(CAST(y.b * y.b AS BIGINT)) AS cc
  FROM (SELECT *, unnest(range(1, 65)) AS lag FROM sb) x JOIN sb y ON y.doc_id = x.doc_id AND y.pos = x.pos + x.lag GROUP BY ALL)
SELECT doc_id, lag, round(coalesce(CAST(m.n * ac - a * c AS DOUBLE) / nullif(sqrt(CAST(m.n * aa - a * a AS DOUBLE)) * sqrt(CAST(m.n * cc - c * c AS DOUBLE)), 0), 0), 6) + 0.0 AS r
FROM (SELECT doc_id, unnest(range(1, CASE WHEN n >= 66 THEN 65 ELSE greatest(2, n - 1) END)) AS lag FROM blob) g LEFT JOIN m USING (doc_id, lag)""")
def autocorr(spark, sf_dir):
    return stats.rounded(stats.autocorrelation(_series(spark, sf_dir)), "r")


PHASE = SHORT + """, ph AS (SELECT doc_id, k, pos % k AS j, b, count(*) AS n FROM (SELECT *, unnest({ks}) AS k FROM sb) GROUP BY ALL),
tot AS (SELECT g.doc_id, g.k, g.j, coalesce(sum(n), 0) AS t FROM (SELECT doc_id, k, unnest(range(0, k)) AS j FROM (SELECT doc_id, unnest({ks}) AS k FROM blob)) g LEFT JOIN ph ON ph.doc_id = g.doc_id AND ph.k = g.k AND ph.j = g.j GROUP BY ALL),
pairs AS (SELECT x.doc_id, x.k, x.j AS i, y.j AS j, x.t AS t1, y.t AS t2 FROM tot x JOIN tot y ON x.doc_id = y.doc_id AND x.k = y.k AND x.j < y.j),
full256 AS (SELECT p.*, b FROM pairs p CROSS JOIN (SELECT unnest(range(0, 256)) AS b) g),
pq AS (SELECT f.doc_id, f.k, f.i, f.j, (coalesce(a.n, 0) / greatest(t1, 1) + 1e-12) / (least(t1, 1) + 256e-12) AS p, (coalesce(c.n, 0) / greatest(t2, 1) + 1e-12) / (least(t2, 1) + 256e-12) AS q FROM full256 f
  LEFT JOIN ph a ON a.doc_id = f.doc_id AND a.k = f.k AND a.j = f.i AND a.b = f.b LEFT JOIN ph c ON c.doc_id = f.doc_id AND c.k = f.k AND c.j = f.j AND c.b = f.b),
js AS (SELECT doc_id, k, i, j, sum(p * log2(2 * p / (p + q)) + q * log2(2 * q / (p + q))) / 2 AS d FROM pq GROUP BY ALL),
sc AS (SELECT doc_id, k, avg(d) AS score FROM js GROUP BY ALL)"""


@query(f"WITH {PHASE.format(ks=list(range(2, 9)))} SELECT doc_id, CAST(k AS BIGINT) AS k, round(score, 6) AS score FROM sc")
def phase_scores(spark, sf_dir):
    return stats.rounded(stats.phase_scores(_series(spark, sf_dir)), "score")


@query(f"WITH {PHASE.format(ks=list(range(2, 9)))} SELECT doc_id, CAST(max_by(k, (round(score, 12), -k)) AS BIGINT) AS best_k FROM sc GROUP BY doc_id")
def best_k(spark, sf_dir):
    return stats.best_k(stats.rounded(stats.phase_scores(_series(spark, sf_dir)), "score", digits=12), ["doc_id"])


@query(f"""WITH {BLOB}, w AS (SELECT doc_id, off, substr(hx, 2 * off + 1, 5120) AS h FROM (SELECT *, unnest(range(0, n - 2560, 16)) AS off FROM blob)),
c AS (SELECT doc_id, off, b, count(*) AS n FROM (SELECT doc_id, off, unnest(regexp_extract_all(h, '..')) AS b FROM w) GROUP BY ALL)
SELECT doc_id, off, round(-sum((n / 2560) * log2(n / 2560)), 6) AS entropy FROM c GROUP BY ALL""")
def sliding_entropy(spark, sf_dir):
    return stats.rounded(stats.sliding_entropy(_series(spark, sf_dir)), "entropy")
