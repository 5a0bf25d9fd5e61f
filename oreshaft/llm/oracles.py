"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from ._shared import LOWER, UPPER, WORD
from .secrets import KINDS, RULES

FOLD = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"

OP4 = f"""
WITH line AS (
  SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), one AS (
  SELECT doc_id, r, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM line
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS k FROM one
), own AS (
  SELECT k, min(doc_id) AS owner, count(DISTINCT doc_id) AS n FROM keyed WHERE length(k) >= 10 GROUP BY k
), judged AS (
  SELECT keyed.*, coalesce(n >= 2 AND doc_id <> owner, false) AS dropped FROM keyed LEFT JOIN own USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id, r
"""

OP5 = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b FROM pages
), d AS (
  SELECT page_id, octet_length(b) AS n, sha1(b) AS h, max(page_id) OVER (PARTITION BY b) AS latest FROM p
)
SELECT page_id, n AS payload_bytes, h AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> latest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> latest THEN latest END AS refers_to
FROM d
"""


def _found() -> str:
    """Matches of every rule with the text before each, from the pieces between matches."""
    out = []
    for version in sorted(RULES):
        for rule in RULES[version]:
            p = rule.pattern.replace("'", "''")
            inner = rule.group + 1
            out.append(
                f"SELECT r, {KINDS.index(rule.kind)} AS kind, unnest(regexp_extract_all(t, '({p})', 1)) AS m, unnest(regexp_extract_all(t, '({p})', {inner})) AS g, "
                f"unnest(string_split_regex(t, '{p}')) AS gap, unnest(range(0, length(t) + 2)) AS i, {rule.least} AS least FROM d WHERE regexp_matches(t, '{p}')"
            )
    return " UNION ALL ".join(out)


OP3 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), f AS ({_found()}),
s AS (SELECT r, kind, g, least, m, sum(length(gap)) OVER w + sum(length(m)) OVER w - length(m) AS a FROM f WHERE m IS NOT NULL WINDOW w AS (PARTITION BY r, kind ORDER BY i)),
k AS (SELECT r, kind, CAST(a AS BIGINT) AS a, CAST(a + length(m) AS BIGINT) AS b, [{', '.join(f"'{x}'" for x in KINDS)}][kind + 1] AS name FROM s WHERE length(g) >= least)
SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
  sha256(coalesce(string_agg(name || ':' || a || ':' || b, ',' ORDER BY a, kind) FILTER (WHERE kind < 3), '')) AS base_sha256,
  coalesce(string_agg(name || ':' || a || ':' || b, ',' ORDER BY a, kind), '') AS spans
FROM d LEFT JOIN k USING (r) GROUP BY r, doc_id
"""

OP6 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({FOLD}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all({FOLD}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item, n, array_to_string(w[o + 1 : o + n], ' ') AS p FROM (SELECT *, unnest(range(0, len(w) - n + 1)) AS o FROM (SELECT item, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0))),
win AS (SELECT r, n, o, array_to_string(w[o + 1 : o + n], ' ') AS p FROM (SELECT r, w, n, unnest(range(0, len(w) - n + 1)) AS o FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
hit AS (SELECT r, win.n, o, item FROM win JOIN p USING (n, p)),
h AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(o, o + n)) AS x FROM (SELECT DISTINCT r, o, n FROM hit)) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN i USING (r)
"""

OP7 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({FOLD}, '{WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[o + 1 : o + 4], ' ') AS s FROM (SELECT *, unnest(range(0, greatest(1, len(w) - 3))) AS o FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""

OP10 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
win AS (SELECT r, doc_id, o, md5(array_to_string(w[o + 1 : o + 50], ' ')) AS h FROM (SELECT *, unnest(range(0, len(w) - 49)) AS o FROM d WHERE len(w) >= 50)),
own AS (SELECT h, min(doc_id) AS owner FROM win GROUP BY h),
gone AS (SELECT DISTINCT r, unnest(range(o + 1, o + 51)) AS i FROM win JOIN own USING (h) WHERE owner < doc_id),
one AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS k, count(*) AS n FROM one LEFT JOIN gone USING (r, i) WHERE gone.r IS NULL GROUP BY r)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""

ORACLES = {
    "op3_secrets": OP3,
    "op4_line_dedup": OP4,
    "op5_warc": OP5,
    "op6_decontaminate": OP6,
    "op7_near_duplicates": OP7,
    "op10_substring_dedup": OP10,
}
