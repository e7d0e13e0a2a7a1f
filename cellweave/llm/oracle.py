"""SQL twins of the training-data queries, where SQL can express them over whole tables."""

_SETS = """
WITH s AS (
  SELECT id, list_distinct(list_filter(flatten(list(list_concat(coalesce(instances, []), coalesce(subclasses, [])))), lambda x: x IS NOT NULL)) AS v
  FROM candidate WHERE id IS NOT NULL GROUP BY id),
k AS (SELECT id, list_sort(v) AS v FROM s WHERE len(v) >= 4),
e AS (SELECT id, len(v) AS n, unnest(v) AS x FROM k),
pairs AS (
  SELECT a.id AS id_a, b.id AS id_b FROM e a JOIN e b ON a.x = b.x AND a.id < b.id
  GROUP BY a.id, b.id, a.n, b.n HAVING 5 * count(*) >= 4 * (a.n + b.n - count(*)))
"""

_TABLES = """
WITH r0 AS (SELECT tab_id, row_id, split, source, col0 FROM table_rows WHERE tab_id IS NOT NULL AND row_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY tab_id, row_id ORDER BY loaded_at DESC NULLS LAST, col0 DESC NULLS LAST, split DESC NULLS LAST, source DESC NULLS LAST) = 1),
r AS (SELECT tab_id, row_id, split, source,
  nullif(regexp_replace(translate(replace(replace(replace(lower(strip_accents(col0)), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'), 'øłđı', 'oldi'), '[^\\p{L}\\p{N}]', '', 'g'), '') AS v FROM r0),
n AS (SELECT tab_id, count(*) AS n, max(split) AS split, max(source) AS source FROM r GROUP BY 1),
h AS (SELECT DISTINCT v FROM r WHERE split IN ('valid', 'test') AND v IS NOT NULL),
t AS (SELECT DISTINCT v FROM r WHERE split = 'train' AND v IS NOT NULL),
m AS (SELECT h.v AS a, t.v AS b FROM h JOIN t ON abs(length(h.v) - length(t.v)) <= 1 AND (h.v = t.v OR damerau_levenshtein(h.v, t.v) <= 1
  AND NOT (length(h.v) = 1 AND length(t.v) = 1) AND regexp_replace(h.v, '[^0-9]', '', 'g') = regexp_replace(t.v, '[^0-9]', '', 'g'))),
p AS (SELECT x.tab_id AS held, y.tab_id AS train, count(DISTINCT x.row_id) AS hs, count(DISTINCT y.row_id) AS ts
  FROM r x JOIN m ON x.v = m.a JOIN r y ON y.v = m.b WHERE x.split IN ('valid', 'test') AND y.split = 'train' GROUP BY 1, 2),
q AS (SELECT held, train, a.split, a.source, CASE WHEN a.n > b.n THEN hs WHEN a.n < b.n THEN ts ELSE greatest(hs, ts) END AS shared, greatest(a.n, b.n) AS longer
  FROM p JOIN n a ON a.tab_id = held JOIN n b ON b.tab_id = train),
f AS (SELECT * FROM q WHERE shared * 10 >= longer * 7)
"""

SQL: dict[str, str] = {
    "p4_found": _TABLES + "SELECT least(held, train) AS tab_a, greatest(held, train) AS tab_b FROM f",
    "p4_report": _TABLES + "SELECT split, source, count(DISTINCT held) AS tables, count(*) AS pairs FROM f GROUP BY 1, 2",
    "p3_classes": _SETS
    + """, c AS (SELECT id, min(id) OVER (PARTITION BY v) AS class FROM k),
l AS (SELECT a.class AS one, b.class AS other FROM pairs JOIN c a ON a.id = id_a JOIN c b ON b.id = id_b WHERE a.class <> b.class),
u AS (SELECT one AS class, count(DISTINCT other) AS links FROM (SELECT one, other FROM l UNION ALL SELECT other, one FROM l) GROUP BY 1)
SELECT id, class, coalesce(links, 0) AS links FROM c LEFT JOIN u USING (class)""",
    "p3_found": _SETS + "SELECT id_a, id_b FROM pairs",
    "p8_decoded": "SELECT doc_id, md5(coalesce(text, '')) AS digest, true AS same FROM documents",
}
