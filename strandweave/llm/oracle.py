"""DuckDB SQL for those contract queries that SQL can express."""

OP1 = r"""
WITH u AS (
  SELECT page_id, url,
         CASE WHEN url IS NOT NULL AND instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), s AS (
  SELECT page_id, url, regexp_extract(rest, '^[^/?#]*') AS raw_host, rest FROM u
), p AS (
  SELECT page_id, url,
         translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path
  FROM s
), rules(action, rh, rp) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'),
         ('allow', 'example.net', '/de/8'), ('block', 'org', '/es/')
), fit AS (
  SELECT page_id, url, host, path, action, rh || rp AS rule,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC, rh || rp) AS k
  FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
), free(pattern, rx) AS (
  VALUES ('/adserver/', '/adserver/'), ('/banner-ads/', '/banner-ads/'), ('/tracking-pixel.', '/tracking-pixel\.'),
         ('/porn/', '/porn/'), ('.casino^', '\.casino([^\w.%-]|$)')
), loose AS (
  SELECT page_id, min(pattern) AS pattern FROM p JOIN free ON regexp_matches(url, rx) GROUP BY page_id
)
SELECT p.page_id, p.host, p.path, fit.rule,
       coalesce(fit.action, CASE WHEN loose.pattern IS NOT NULL THEN 'block' END, 'allow') AS verdict,
       CASE WHEN fit.rule IS NULL THEN loose.pattern END AS pattern
FROM p LEFT JOIN fit ON p.page_id = fit.page_id AND fit.k = 1 LEFT JOIN loose ON p.page_id = loose.page_id
"""

OP5 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL
), p AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS r(i) WHERE len(w) > 0
), lengths AS (SELECT DISTINCT m FROM p
), g AS (
  SELECT doc_id, i, m, array_to_string(w[i : i + m - 1], ' ') AS g
  FROM d, lengths, unnest(range(1, len(w) - m + 2)) AS r(i) WHERE len(w) >= m
), o AS (
  SELECT g.doc_id, g.i, g.m, p.item_id FROM g JOIN p ON g.g = p.g AND g.m = p.m
), h AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM o) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM o GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""

OP6 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS g FROM d, unnest(range(1, len(w) - 11)) AS r(i) WHERE len(w) >= 13
), m AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g
), hit AS (
  SELECT DISTINCT g.doc_id, unnest(range(g.i, g.i + 13)) AS k FROM g JOIN m ON g.g = m.g AND m.first < g.doc_id
), t AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS k FROM d
), kept AS (
  SELECT t.doc_id, count(*) AS n, string_agg(t.x, ' ' ORDER BY t.k) AS s
  FROM t LEFT JOIN hit ON t.doc_id = hit.doc_id AND t.k = hit.k WHERE hit.k IS NULL GROUP BY t.doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.s, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

ORACLE = {"op6_seed_and_extend_dedup": OP6, "op1_url_filter": OP1, "op5_wu_manber_decontamination": OP5}
