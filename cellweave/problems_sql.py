"""SQL twins of the queries in ``problems``."""

CLASSES = """
WITH RECURSIVE cls AS (
  SELECT id, min(list_min(list_filter(subclasses, lambda x: x IS NOT NULL))) AS parent
  FROM candidate WHERE id IS NOT NULL AND coalesce(len(instances), 0) = 0 GROUP BY id),
up AS (
  SELECT id AS node, id AS cur, parent AS nxt, [id] AS trail FROM cls
  UNION ALL
  SELECT u.node, u.nxt, c.parent, list_prepend(u.nxt, u.trail)
  FROM up u LEFT JOIN cls c ON c.id = u.nxt
  WHERE u.nxt IS NOT NULL AND NOT list_contains(u.trail, u.nxt)),
ended AS (SELECT node, cur AS root, trail FROM up WHERE nxt IS NULL),
ring AS (
  SELECT node, list_min(trail[1:list_position(trail, nxt)]) AS root
  FROM up WHERE nxt IS NOT NULL AND list_contains(trail, nxt))
"""

_P2_DOCS = """
WITH d AS (
  SELECT response_id, max_by(CAST(body AS JSON), (received_at, body)) AS doc
  FROM raw_response WHERE response_id IS NOT NULL AND json_valid(body) GROUP BY response_id),
pages AS (
  SELECT response_id, unnest(CASE WHEN json_type(doc, '$.webPages.value') = 'ARRAY' THEN CAST(doc->'$.webPages.value' AS JSON[])
    WHEN json_type(doc, '$.webPages.value') IS NULL OR json_type(doc, '$.webPages.value') = 'NULL' THEN [] ELSE [doc->'$.webPages.value'] END) AS el,
    generate_subscripts(CASE WHEN json_type(doc, '$.webPages.value') = 'ARRAY' THEN CAST(doc->'$.webPages.value' AS JSON[])
    WHEN json_type(doc, '$.webPages.value') IS NULL OR json_type(doc, '$.webPages.value') = 'NULL' THEN [] ELSE [doc->'$.webPages.value'] END, 1) - 1 AS i FROM d),
hits AS (
  SELECT response_id, unnest(CASE WHEN json_type(doc, '$.search') = 'ARRAY' THEN CAST(doc->'$.search' AS JSON[])
    WHEN json_type(doc, '$.search') IS NULL OR json_type(doc, '$.search') = 'NULL' THEN [] ELSE [doc->'$.search'] END) AS el,
    generate_subscripts(CASE WHEN json_type(doc, '$.search') = 'ARRAY' THEN CAST(doc->'$.search' AS JSON[])
    WHEN json_type(doc, '$.search') IS NULL OR json_type(doc, '$.search') = 'NULL' THEN [] ELSE [doc->'$.search'] END, 1) - 1 AS i FROM d),
deep AS (
  SELECT response_id, i, CASE WHEN json_type(el, '$.deepLinks') = 'ARRAY' THEN CAST(el->'$.deepLinks' AS JSON[])
    WHEN json_type(el, '$.deepLinks') IS NULL OR json_type(el, '$.deepLinks') = 'NULL' THEN [] ELSE [el->'$.deepLinks'] END AS l FROM pages),
ali AS (
  SELECT response_id, i, CASE WHEN json_type(el, '$.aliases') = 'ARRAY' THEN CAST(el->'$.aliases' AS JSON[])
    WHEN json_type(el, '$.aliases') IS NULL OR json_type(el, '$.aliases') = 'NULL' THEN [] ELSE [el->'$.aliases'] END AS l FROM hits),
rows AS (
  SELECT response_id, 'query' AS child, -1 AS pos1, -1 AS pos2, coalesce(doc->>'$.queryContext.originalQuery', doc->>'$.searchinfo.search', '') AS val FROM d
  UNION ALL SELECT response_id, 'page', i, -1, coalesce(el->>'$.name', '') FROM pages
  UNION ALL SELECT response_id, 'link', i, generate_subscripts(l, 1) - 1, coalesce(unnest(l)->>'$.name', '') FROM deep
  UNION ALL SELECT response_id, 'hit', i, -1, coalesce(el->>'$.id', '') FROM hits
  UNION ALL SELECT response_id, 'display', i, -1, coalesce(el->>'$.display.label.value', '') FROM hits WHERE json_type(el, '$.display.label') IS NOT NULL AND json_type(el, '$.display.label') <> 'NULL'
  UNION ALL SELECT response_id, 'alias', i, generate_subscripts(l, 1) - 1, coalesce(unnest(l)->>'$', '') FROM ali)
"""

_P2_ROWS = _P2_DOCS + "SELECT response_id, child, CAST(pos1 AS INTEGER) AS pos1, CAST(pos2 AS INTEGER) AS pos2, val FROM rows"

_P5 = r"""
WITH one AS (
  SELECT line_id, min((received_at, coalesce(line, ''), feed)) AS got FROM raw_line WHERE line_id IS NOT NULL GROUP BY line_id),
rec AS (SELECT line_id, got[3] AS feed, regexp_replace(got[2], '\r\z', '') AS r FROM (SELECT line_id, [CAST(got[1] AS VARCHAR), got[2], got[3]] AS got FROM one)),
q AS (SELECT *, regexp_full_match(r, '(?s)("([^"]|"")*"|[^",]*)(,("([^"]|"")*"|[^",]*))*') AS quoted FROM rec),
f AS (SELECT *, list_transform(regexp_extract_all(r || ',', '(?s)("(?:[^"]|"")*"|[^",]*),', 1),
        lambda x: CASE WHEN x LIKE '"%' THEN replace(x[2:length(x) - 1], '""', '"') ELSE x END) AS c FROM q),
e AS (SELECT line_id, feed, c, CASE WHEN NOT quoted THEN 'quoting' WHEN len(c) <> 4 THEN 'column_count'
    WHEN feed IN ('cea_gt', 'tables') AND (NOT regexp_full_match(c[1], '[0-9A-Z]{8}') OR NOT regexp_full_match(c[2], '[0-9]+')) THEN 'invalid_value'
    WHEN feed = 'cea_gt' AND (NOT regexp_full_match(c[3], '[0-9]+') OR trim(c[4], E' \t\n\r ') = '') THEN 'invalid_value'
    WHEN feed = 'tables' AND NOT regexp_full_match(c[4], '([+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?)?') THEN 'invalid_value'
    WHEN feed IS NULL OR feed NOT IN ('cea_gt', 'tables') THEN 'unknown_feed' END AS reason FROM f)
"""

SQL = {
    "p1_found": CLASSES
    + "SELECT node AS node_id, root AS root_id, CAST(len(trail) - 1 AS INTEGER) AS depth FROM ended UNION ALL SELECT node, root, -1 FROM ring",
    "p1_paths": CLASSES
    + """SELECT node AS node_id, array_to_string(trail, '/') AS path, CAST(len(trail) - 1 AS INTEGER) AS depth, root AS root_id, false AS back_edge FROM ended
UNION ALL SELECT r.node, NULL, -1, r.root, u.nxt = r.node AND c.parent = r.root FROM ring r JOIN up u ON u.node = r.node AND u.nxt IS NOT NULL AND list_contains(u.trail, u.nxt) JOIN cls c ON c.id = r.node""",
    "p1_descendants": CLASSES
    + "SELECT a AS ancestor, node AS node_id, CAST(len(trail) - p AS INTEGER) AS distance FROM (SELECT node, trail, unnest(trail) AS a, generate_subscripts(trail, 1) AS p FROM ended) WHERE a <> node",
    "p2_found": _P2_ROWS,
    **{f"p2_{c}": _P2_ROWS + f" WHERE child = '{c}'" for c in ("query", "page", "link", "hit", "display", "alias")},
    "p5_found": _P5 + "SELECT line_id, reason FROM e WHERE reason IS NOT NULL",
    "p5_valid": _P5
    + """SELECT line_id, feed, c[1] AS tab_id, c[2] AS row_id, CASE WHEN feed = 'cea_gt' THEN c[3] END AS col_id,
    CASE WHEN feed = 'cea_gt' THEN c[4] END AS entity, CASE WHEN feed = 'tables' THEN c[3] END AS col0, CASE WHEN feed = 'tables' THEN c[4] END AS col1 FROM e WHERE reason IS NULL""",
}
