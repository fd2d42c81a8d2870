"""DuckDB SQL for the queries that SQL can express.

The others rest on a trained model, on merges or fingerprints, on seeded hashes, or on bytes; tests hold them against
plain versions in Python.
"""

LINE_DEDUP = """WITH parts AS (SELECT doc_id, source, string_split(text, chr(10)) AS s FROM documents),
 lines AS (SELECT doc_id, source, i AS pos, s[i] AS line FROM (SELECT *, unnest(generate_series(1, len(s))) AS i FROM parts) AS u),
 spread AS (SELECT line, min((doc_id, pos)) AS first FROM lines WHERE regexp_matches(line, '[^\\x09-\\x0D\\x{85}\\p{Z}]') GROUP BY line HAVING count(DISTINCT source) >= 3),
 told AS (SELECT l.doc_id, l.pos, l.line, s.line IS NOT NULL AND (l.doc_id, l.pos) <> s.first AS gone FROM lines l LEFT JOIN spread s ON s.line = l.line)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS text_sha256
FROM told GROUP BY doc_id"""

URLS = """WITH cut AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
   coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
 rules AS (SELECT * FROM (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')) AS v(verdict, h, p)),
 best AS (SELECT page_id, arg_max(concat(h, p), length(h) + length(p)) AS rule, arg_max(verdict, length(h) + length(p)) AS verdict FROM cut JOIN rules
   ON (host = h OR ends_with(host, concat('.', h))) AND starts_with(path, p) GROUP BY page_id)
SELECT c.page_id, host, path, rule, coalesce(verdict, CASE WHEN (host, path) IN (SELECT (host, path) FROM cut WHERE page_id % 100 = 0) THEN 'block' ELSE 'allow' END) AS verdict
FROM cut c LEFT JOIN best b ON b.page_id = c.page_id"""

ORACLES: dict[str, str] = {"op5_line_dedup": LINE_DEDUP, "op9_urls": URLS}
