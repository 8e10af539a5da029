"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

SUBSTRING_DEDUP = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS i, len(w) AS n FROM d),
g AS (SELECT doc_id, i, n, string_agg(t, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) AS s FROM x),
v AS (SELECT doc_id, i, s FROM g WHERE i + 49 <= n),
f AS (SELECT s, min(doc_id) AS first FROM v GROUP BY s HAVING count(DISTINCT doc_id) > 1),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM v JOIN f USING (s) WHERE first < doc_id),
k AS (SELECT x.doc_id, count(r.i) AS n_removed, string_agg(x.t, ' ' ORDER BY x.i) FILTER (WHERE r.i IS NULL) AS kept FROM x LEFT JOIN r ON r.doc_id = x.doc_id AND r.i = x.i GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format('text')}, {_ALNUM}) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, row_number() OVER () AS k, regexp_extract_all({_LOWER.format('text')}, {_ALNUM}) AS w FROM benchmark WHERE item_id IS NOT NULL),
bx AS (SELECT item, k, unnest(w) AS t, generate_subscripts(w, 1) AS i, len(w) AS n FROM b),
bg AS (SELECT item, i, n, string_agg(t, ' ') OVER (PARTITION BY k ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS s FROM bx),
bw AS (SELECT DISTINCT item, s, least(n, 10) AS m FROM bg WHERE i + least(n, 10) - 1 <= n),
x AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS i, len(w) AS n FROM d),
{", ".join(f"g{m} AS (SELECT doc_id, i, n, {m} AS m, string_agg(t, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {m - 1} FOLLOWING) AS s FROM x WHERE EXISTS (SELECT 1 FROM bw WHERE m = {m}))" for m in range(1, 11))},
g AS ({" UNION ALL ".join(f"SELECT doc_id, i, n, m, s FROM g{m}" for m in range(1, 11))}),
h AS (SELECT doc_id, i, g.m, item FROM g JOIN bw ON bw.s = g.s AND bw.m = g.m WHERE i + g.m - 1 <= n),
p AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS i FROM h) GROUP BY 1),
q AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN q USING (doc_id)"""

NEAR_DEDUP = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format('text')}, {_SPACED}) AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS i, len(w) AS n FROM d),
g AS (SELECT doc_id, i, n, string_agg(t, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS s FROM x),
s AS (SELECT DISTINCT doc_id, s FROM g WHERE i + least(n, 4) - 1 <= n),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 100 * both_ >= 80 * (x.n + y.n - both_)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN c USING (doc_id) JOIN m USING (doc_id)"""
