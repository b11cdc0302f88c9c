"""SQL for the operators whose results follow from a definition; doc_id is unique in the tables that it is run on."""

from __future__ import annotations

#: Words of the lower-cased text, by letters, digits and everything beyond ASCII.
_WORDS = "regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

#: Every 100-byte string by its first place; the others' places cover what goes. Bytes are written as pairs of hex digits.
OP1 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, s, md5(substr(x, 2 * s + 1, 200)) AS h FROM (SELECT doc_id, x, unnest(range(0, n - 99)) AS s FROM d)),
r AS (SELECT doc_id, s FROM w QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, s) > 1),
e AS (SELECT doc_id, s, s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS step FROM r),
i AS (SELECT doc_id, s, sum(CASE WHEN step <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s) AS island FROM e),
g AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS b FROM i GROUP BY doc_id, island),
c AS (SELECT doc_id, 0 AS a, 0 AS b FROM d UNION ALL SELECT doc_id, a, b FROM g),
k AS (SELECT doc_id, b AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY b) AS b FROM c),
t AS (SELECT doc_id, string_agg(substr(x, 2 * a + 1, 2 * (coalesce(b, n) - a)), '' ORDER BY a) AS rest, count(*) - 1 AS spans
      FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, (n - length(rest) // 2)::BIGINT AS n_removed, spans::BIGINT AS n_spans, sha256(unhex(rest)) AS kept_sha256
FROM d JOIN t USING (doc_id)
"""

#: All pairs of different texts by the shingles they share, then what each text reaches.
OP6 = f"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS rep, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
p AS (SELECT rep, w, i, len(ws) AS n FROM (SELECT rep, ws, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM d WHERE doc_id = rep)),
five AS (SELECT rep, n, list(w) OVER (PARTITION BY rep ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS g, i FROM p),
s AS MATERIALIZED (SELECT DISTINCT rep, array_to_string(g, ' ') AS g FROM five WHERE len(g) = 5 OR (i = 0 AND n < 5)),
m AS (SELECT rep, count(*) AS m FROM s GROUP BY rep),
c AS (SELECT a.rep AS a, b.rep AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.rep <> b.rep GROUP BY a.rep, b.rep),
e AS MATERIALIZED (SELECT a, b FROM c JOIN m x ON x.rep = a JOIN m y ON y.rep = b WHERE shared >= 0.8 * (x.m + y.m - shared) - 1e-9),
r(a, b) AS (SELECT rep, rep FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
q AS (SELECT a, min(b) AS class_id FROM r GROUP BY a)
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size, doc_id = class_id AS kept FROM d JOIN q ON q.a = d.rep
"""

#: A join of all windows; what is no longer than ten words is its own window.
OP10 = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
p AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM d),
t AS (SELECT doc_id, i, list(w) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS ten FROM p),
b AS (SELECT item_id::VARCHAR AS item, ws, least(10, len(ws)) AS n FROM (SELECT item_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM benchmark WHERE item_id IS NOT NULL)),
k AS (SELECT DISTINCT item, n, array_to_string(ws[s + 1 : s + n], ' ') AS g FROM (SELECT *, unnest(range(0, len(ws) - n + 1)) AS s FROM b WHERE n > 0)),
z AS (SELECT DISTINCT n FROM k),
m AS (SELECT doc_id, i, n, item FROM (SELECT doc_id, i, z.n AS n, array_to_string(ten[1 : z.n], ' ') AS g FROM t JOIN z ON len(ten) >= z.n) JOIN k USING (n, g)),
h AS (SELECT doc_id, count(DISTINCT hit) AS n_hit FROM (SELECT doc_id, i + unnest(range(n)) AS hit FROM m) GROUP BY doc_id),
v AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN v USING (doc_id)
"""
