"""DuckDB SQL for operators that SQL can express on whole tables: by plain enumeration, not by the operators' methods."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"regexp_extract_all(coalesce(%s, ''), '[^\x20\x09-\x0D]+')"
_FOLDED = rf"translate(%s, '{_UPPER}', '{_LOWER}')"
_ALNUM = r"regexp_extract_all(coalesce(" + _FOLDED + r", ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1 = rf"""
WITH docs AS (SELECT doc_id, {_WORDS % 'text'} AS ws FROM documents),
windows AS (SELECT doc_id, i, array_to_string(ws[i + 1:i + 20], ' ') AS w FROM (SELECT doc_id, ws, unnest(range(len(ws) - 19)) AS i FROM docs)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS r FROM windows) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM later)),
starts AS (SELECT doc_id, count(*) FILTER (before IS NULL OR before < p - 1) AS n_spans, list(p) AS ps FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM gone) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(array_to_string(CASE WHEN ps IS NULL THEN ws ELSE list_transform(list_filter(range(len(ws)), lambda i: NOT list_contains(ps, i)), lambda i: ws[i + 1]) END, ' ')) AS kept_sha256
FROM docs d LEFT JOIN starts s USING (doc_id)
"""

OP3 = rf"""
WITH RECURSIVE docs AS (SELECT doc_id, {_WORDS % (_FOLDED % 'text')} AS ws FROM documents),
each AS (SELECT DISTINCT doc_id, array_to_string(ws[i + 1:i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [0] ELSE range(len(ws) - 3) END) AS i FROM docs)),
sets AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS m FROM each GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM each a JOIN each b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM docs UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
degrees AS (SELECT a, count(*) AS n_links FROM edges GROUP BY a),
copies AS (SELECT m, count(*) AS n_copies FROM sets GROUP BY m)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, r.component_id, coalesce(c.n_copies, 1)::BIGINT AS n_copies, coalesce(g.n_links, 0)::BIGINT AS n_links
FROM docs d JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = d.doc_id LEFT JOIN sets s USING (doc_id) LEFT JOIN copies c USING (m) LEFT JOIN degrees g ON g.a = d.doc_id
"""

OP8 = rf"""
WITH docs AS (SELECT doc_id, {_ALNUM % 'text'} AS ws FROM documents),
items AS (SELECT item_id::VARCHAR AS item, {_ALNUM % 'text'} AS ws FROM benchmark),
windows AS (SELECT DISTINCT item, least(13, len(ws)) AS n, array_to_string(ws[i + 1:i + 13], ' ') AS w FROM (SELECT item, ws, unnest(range(greatest(len(ws) - 12, least(len(ws), 1)))) AS i FROM items)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, n, i, array_to_string(ws[i + 1:i + n], ' ') AS w FROM (SELECT doc_id, ws, n, unnest(range(len(ws) - n + 1)) AS i FROM docs, sizes)),
met AS (SELECT p.doc_id, p.i, p.n, w.item FROM places p JOIN windows w ON p.n = w.n AND p.w = w.w),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM met)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM met) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM docs d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

_TERMS = rf"regexp_extract_all(coalesce({_FOLDED % 'text'}, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"

OP13 = rf"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_TERMS} AS ts FROM documents),
each AS (SELECT d, lang, source, unnest(ts) AS term FROM docs),
vocabulary AS (SELECT lang, term FROM each GROUP BY lang, term HAVING count(DISTINCT d) >= 3),
sizes AS (SELECT lang, count(*) AS v FROM vocabulary GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS c FROM each SEMI JOIN vocabulary USING (lang, term) GROUP BY ALL),
grps AS (SELECT DISTINCT lang, source FROM docs),
totals AS (SELECT g.lang, g.source, coalesce(n, 0) AS n, coalesce(v, 0) AS v FROM grps g LEFT JOIN (SELECT lang, source, sum(c) AS n FROM counts GROUP BY ALL) USING (lang, source) LEFT JOIN sizes USING (lang)),
shares AS (SELECT t.lang, t.source, term, coalesce(c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c, 0) + 1)::HUGEINT) // (n + v)::HUGEINT AS p
  FROM totals t JOIN vocabulary USING (lang) LEFT JOIN counts USING (lang, source, term)),
whole AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(c) + 1)::HUGEINT) // (sum(sum(c)) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang))::HUGEINT AS q FROM counts GROUP BY lang, term),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, 0::HUGEINT AS value FROM totals a JOIN totals b ON a.lang = b.lang AND a.source <> b.source WHERE a.v = 0
  UNION ALL SELECT a.lang, a.source, 'pair', b.source, sum(((a.p - b.p) * (a.p - b.p)) // b.p) FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value FROM shares JOIN whole USING (lang, term) WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, r::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS r FROM (FROM pairs UNION ALL FROM terms)) WHERE part = 'pair' OR r <= 200
"""

OP11 = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
strings AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(greatest(len(h) // 2 - 49, 0))) AS i FROM docs)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS f FROM strings) WHERE f < doc_id),
steps AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 AS on_it FROM later),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT doc_id, i, sum(CASE WHEN on_it THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM steps) GROUP BY doc_id, r),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM runs),
cut AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS z, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS kept FROM gaps JOIN docs USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(z, 0) + 1))) AS kept_sha256
FROM docs d LEFT JOIN cut USING (doc_id)
"""
