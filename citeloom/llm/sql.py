"""SQL (DuckDB) for the queries that SQL can express on whole tables."""

from __future__ import annotations

P1 = """WITH RECURSIVE e AS (SELECT DISTINCT src_node_id AS a, dst_node_id AS b FROM relate WHERE kind = 'duplicates' AND src_node_id IS NOT NULL AND dst_node_id IS NOT NULL AND src_node_id <> dst_node_id),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS n, a AS m FROM u UNION SELECT r.n, u.b FROM r JOIN u ON u.a = r.m)
SELECT n AS node_id, min(m) AS group_id FROM r GROUP BY n"""

P4 = """WITH t AS (SELECT 'cards.body' AS field, card_id AS key, body AS x FROM cards UNION ALL SELECT 'cards.read_text', card_id, read_text FROM cards UNION ALL SELECT 'opendebate_rows.fulltext', CAST(id AS VARCHAR), fulltext FROM opendebate_rows),
w AS (SELECT DISTINCT field, key, regexp_extract_all(lower(x), '[a-z0-9]+') AS w FROM t WHERE x IS NOT NULL),
s AS (SELECT field, key, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM w WHERE len(w) >= 20),
e AS (SELECT field, key, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.field, a.key AS key_a, b.key AS key_b, a.n AS n, b.n AS m, count(*) AS k FROM e a JOIN e b ON a.field = b.field AND a.g = b.g AND a.key < b.key AND a.n >= 0.69 * b.n AND b.n >= 0.69 * a.n GROUP BY ALL)
SELECT field, key_a, key_b FROM p WHERE 10 * k >= 7 * (n + m - k)"""

P5 = """WITH t AS (SELECT DISTINCT 'cards.body' AS field, card_id, body AS x FROM cards WHERE body IS NOT NULL UNION SELECT DISTINCT 'cards.read_text', card_id, read_text FROM cards WHERE read_text IS NOT NULL),
w AS (SELECT field, card_id, list_filter(regexp_split_to_array(x, '[\\s\\x{0085}\\x{00a0}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+'), lambda v: v <> '') AS w FROM t),
g AS (SELECT field, card_id, unnest(range(0, len(w) - 24)) AS p, w FROM w WHERE len(w) >= 25), h AS (SELECT field, card_id, p, array_to_string(w[p + 1:p + 25], ' ') AS r FROM g),
c AS (SELECT field, r FROM h GROUP BY ALL HAVING count(DISTINCT card_id) > 1), k AS (SELECT field, card_id, p FROM h JOIN c USING (field, r)),
n AS (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY field, card_id ORDER BY p) <= 25 THEN 0 ELSE 1 END AS new FROM k),
i AS (SELECT *, sum(new) OVER (PARTITION BY field, card_id ORDER BY p) AS island FROM n)
SELECT field, card_id, CAST(min(p) AS INT) AS first_word, CAST(max(p) + 24 AS INT) AS last_word FROM i GROUP BY field, card_id, island"""

P8 = """WITH d AS (SELECT doc_id, regexp_extract_all(regexp_replace(regexp_replace(lower(text), '[\\x{00ad}\\x{200b}-\\x{200f}\\x{2060}-\\x{206f}\\x{feff}]', '', 'g'), '([a-z0-9])-[ \\t]*\\r?\\n[ \\t]*([a-z0-9])', '\\1\\2', 'g'), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) AS r FROM d WHERE len(w) >= 13),
x AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM eval_items WHERE text IS NOT NULL), y AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) AS r FROM x WHERE len(w) >= 13)
SELECT DISTINCT doc_id, item_id FROM g JOIN y USING (r)"""

ORACLE = {"p1_found": P1, "p4_found": P4, "p5_found": P5, "p8_found": P8}
