"""SQL twins of the queries in ``annotation``. The pairwise definitions are used here where the library has a faster form."""

from cellweave.functions.text import ENTITY_RULES, ENTITY_TYPES, PUNCTUATION, STOP_WORDS
from cellweave.problems_sql import CLASSES as _CLASSES

P = "http://kg.tablelink.example/entity/"
PP = "http://kg.tablelink.example/prop/direct/"

_ONCE = "once AS (SELECT tab_id, row_id, col0, col1, col2, col3, col4 FROM table_rows WHERE tab_id IS NOT NULL AND row_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY tab_id, row_id ORDER BY loaded_at DESC NULLS LAST, col0 DESC NULLS LAST, col1 DESC NULLS LAST, col2 DESC NULLS LAST, col3 DESC NULLS LAST, col4 DESC NULLS LAST) = 1)"
_CELLS = (
    _ONCE
    + ", cells AS ("
    + " UNION ALL ".join(f'SELECT tab_id, row_id AS "row", {i} AS col, col{i} AS mention FROM once WHERE col{i} IS NOT NULL' for i in range(5))
    + ")"
)
_GOLD = """
g0 AS (SELECT gt_id, tab_id, row_id, col_id, entity FROM cea_gt WHERE gt_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY gt_id ORDER BY loaded_at DESC NULLS LAST, tab_id DESC NULLS LAST, row_id DESC NULLS LAST, col_id DESC NULLS LAST, entity DESC NULLS LAST) = 1),
g1 AS (SELECT gt_id, upper(regexp_extract(tab_id, '([0-9A-Za-z]{8})', 1)) AS tab_id, try_cast(trim(row_id) AS INTEGER) AS "row", try_cast(trim(col_id) AS INTEGER) AS col,
  list_transform(regexp_extract_all(entity, '[Qq]([0-9]+)', 1), lambda x: try_cast(x AS BIGINT)) AS ids FROM g0),
gold AS (SELECT tab_id, "row", col, arg_max(ids, gt_id) AS ids, arg_max(ids[-1], gt_id) AS correct_id FROM g1
  WHERE tab_id <> '' AND "row" IS NOT NULL AND col IS NOT NULL AND len(ids) > 0 GROUP BY 1, 2, 3)"""
_DATA = f"WITH {_CELLS}, {_GOLD}, ds AS (SELECT c.*, g.correct_id FROM cells c JOIN gold g USING (tab_id, \"row\", col))"
_CAT = """
cat AS (SELECT id, coalesce(title, '') AS title, coalesce(description, '') AS description, list_sort(coalesce(instances, [])) AS instances, list_sort(coalesce(subclasses, [])) AS subclasses
  FROM candidate WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id
  ORDER BY fetched_at DESC NULLS LAST, title DESC NULLS LAST, description DESC NULLS LAST, list_sort(coalesce(instances, [])) DESC, list_sort(coalesce(subclasses, [])) DESC) = 1)"""
_KNOWN = (
    _CAT
    + """,
items AS (SELECT try_cast(item_id[2:] AS BIGINT) AS id, coalesce(max(label), '') AS title, coalesce(max(description), '') AS description FROM kg_item WHERE kind = 'item' GROUP BY 1),
known AS (SELECT * FROM cat UNION ALL SELECT id, title, description, CAST([] AS BIGINT[]), CAST([] AS BIGINT[]) FROM items WHERE id NOT IN (SELECT id FROM cat))"""
)
_LISTED = "CASE WHEN json_type(doc, '$.webPages.value') = 'ARRAY' THEN CAST(doc->'$.webPages.value' AS JSON[]) WHEN coalesce(json_type(doc, '$.webPages.value'), 'NULL') = 'NULL' THEN [] ELSE [doc->'$.webPages.value'] END"
_DOCS = "docs AS (SELECT response_id, max_by(CAST(body AS JSON), (received_at, body)) AS doc FROM raw_response WHERE response_id IS NOT NULL AND json_valid(body) GROUP BY 1)"
_TITLES = f"""
WITH {_DOCS},
pg AS (SELECT response_id, coalesce(doc->>'$.queryContext.originalQuery', doc->>'$.searchinfo.search', '') AS asked, {_LISTED} AS l FROM docs),
titles AS (SELECT response_id, asked, CAST(i - 1 AS INTEGER) AS pos, coalesce(l[i]->>'$.name', '') AS title FROM (SELECT *, unnest(generate_series(1, len(l))) AS i FROM pg))"""
_SUBSETS = (
    _TITLES
    + r""",
w AS (SELECT *, replace(title, ' - Wikidata', '') AS whole, list_filter(string_split_regex(replace(title, ' - Wikidata', ''), '\s+'), lambda x: x <> '') AS ws FROM titles),
masks AS (SELECT *, unnest(CASE WHEN len(ws) = 0 THEN [0] ELSE generate_series(0, CAST(pow(2, len(ws)) AS BIGINT) - 1) END) AS m FROM w),
subs AS (SELECT *, CASE WHEN m = 0 THEN whole ELSE list_aggregate(list_filter(list_transform(generate_series(1, len(ws)), lambda j: CASE WHEN (m >> CAST(j - 1 AS INTEGER)) % 2 = 1 THEN ws[j] END), lambda x: x IS NOT NULL), 'string_agg', ' ') END AS subset,
  CASE WHEN m = 0 THEN 1 ELSE 0 END AS at_end FROM masks),
parts AS (SELECT response_id, asked, pos, subset, CAST(row_number() OVER (PARTITION BY response_id, pos ORDER BY at_end, m) - 1 AS INTEGER) AS nth FROM subs WHERE at_end = 1 OR subset <> whole)"""
)


def ratio(a: str, b: str) -> str:
    """Indel similarity of two SQL texts, by the bit-parallel common subsequence (texts of up to 120 characters)."""
    full = f"((CAST(1 AS HUGEINT) << CAST(length({a}) AS INTEGER)) - 1)"
    mask = f"list_sum(list_transform(generate_series(0, length({a}) - 1), lambda i: CASE WHEN substring({a}, CAST(i + 1 AS INTEGER), 1) = c THEN CAST(1 AS HUGEINT) << CAST(i AS INTEGER) ELSE CAST(0 AS HUGEINT) END))"
    steps = f"list_transform(regexp_extract_all({b}, '(?s).'), lambda c: CAST({mask} AS HUGEINT))"
    rest = f"list_reduce(list_prepend({full}, {steps}), lambda v, k: ((v + (v & k)) | (v - (v & k))) & {full})"
    return (
        f"(CASE WHEN length({a}) + length({b}) = 0 THEN 1.0 WHEN length({a}) = 0 OR length({b}) = 0 THEN 0.0"
        f" ELSE 2.0 * (length({a}) - bit_count({rest})) / (length({a}) + length({b})) END)"
    )


_STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
_PUNCT = PUNCTUATION.replace("'", "''")


def words(text: str) -> str:
    """Content words of a SQL text."""
    return rf"list_filter(string_split_regex(translate(coalesce({text}, ''), '{_PUNCT}', ''), '\s+'), lambda x: x <> '' AND NOT list_contains({_STOP}, lower(x)))"


def terms(source: str) -> str:
    """CTE of term counts (entity_id, token, n) over a table with id and description."""
    return (
        f"terms AS (SELECT entity_id, token, count(*) AS n FROM (SELECT id AS entity_id, unnest(flatten(list_transform({words('description')}, "
        rf"lambda x: regexp_extract_all(lower(x), '[\p{{L}}\p{{N}}_]{{2,}}')))) AS token FROM {source}) GROUP BY 1, 2)"
    )


_UNIT = "norms AS (SELECT entity_id, sqrt(sum(n * n)) AS norm FROM terms GROUP BY 1), unit AS (SELECT t.entity_id, token, n / norm AS w FROM terms t JOIN norms USING (entity_id))"
_KEYS = r"list_distinct(list_transform(list_filter(string_split_regex(lower({0}), '\s+'), lambda x: length(x) >= 5), lambda x: x[1:4]))"
_TOP = (
    _DATA
    + ", "
    + _KNOWN
    + f""",
asked AS (SELECT mention, unnest({_KEYS.format("mention")}) AS k FROM (SELECT DISTINCT mention FROM ds WHERE mention <> '')),
posted AS (SELECT id, title, unnest({_KEYS.format("title")}) AS k FROM known WHERE title <> ''),
prs AS (SELECT DISTINCT mention, id AS entity_id, title FROM asked JOIN posted USING (k)),
scored AS (SELECT mention, entity_id, {ratio("mention", "title")} AS score FROM prs),
ranked AS (SELECT mention, entity_id, CAST(row_number() OVER (PARTITION BY mention ORDER BY score DESC, entity_id) - 1 AS INTEGER) AS pos FROM scored)"""
)
_FOUND = _TOP + """, found AS (SELECT tab_id, "row", col, correct_id, entity_id, pos FROM ds JOIN ranked USING (mention) WHERE pos < 30)"""
_PAIRS = """,
pairs AS (SELECT f.tab_id, f."row", f.col, f.pos, f.entity_id, f.correct_id, o.entity_id AS other_id
  FROM found f JOIN found o ON f.tab_id = o.tab_id AND f.col = o.col AND f.correct_id <> o.correct_id)"""
_FEAT = (
    _FOUND
    + _PAIRS
    + ", "
    + terms("known")
    + ", "
    + _UNIT
    + f""",
ids AS (SELECT DISTINCT entity_id, other_id FROM pairs WHERE entity_id <> other_id),
cosines AS (SELECT i.entity_id, i.other_id, sum(a.w * b.w) AS c FROM ids i JOIN unit a ON a.entity_id = i.entity_id JOIN unit b ON b.entity_id = i.other_id AND b.token = a.token GROUP BY 1, 2),
sets AS (SELECT i.entity_id, i.other_id, len(list_intersect(list_distinct(a.instances), list_distinct(b.instances))) AS si, len(list_intersect(list_distinct(a.subclasses), list_distinct(b.subclasses))) AS ss
  FROM ids i JOIN known a ON a.id = i.entity_id JOIN known b ON b.id = i.other_id),
ctx AS (SELECT p.tab_id, p."row", p.col, p.pos, sum(CASE WHEN p.entity_id <> p.other_id THEN si ELSE 0 END) AS ni, sum(CASE WHEN p.entity_id <> p.other_id THEN ss ELSE 0 END) AS ns,
  sum(len(k.instances)) AS ti, sum(len(k.subclasses)) AS ts, sum(CASE WHEN p.entity_id <> p.other_id THEN coalesce(c, 0) ELSE 0 END) AS nd, count(*) FILTER (WHERE p.entity_id <> p.other_id) AS td
  FROM pairs p JOIN known k ON k.id = p.other_id LEFT JOIN sets s ON s.entity_id = p.entity_id AND s.other_id = p.other_id
  LEFT JOIN cosines c ON c.entity_id = p.entity_id AND c.other_id = p.other_id GROUP BY 1, 2, 3, 4),
feat AS (SELECT f.tab_id, f."row", f.col, f.pos, f.entity_id, f.correct_id, {ratio("e.title", "t.title")} AS lex,
  CASE WHEN coalesce(ti, 0) > 0 THEN ni / ti ELSE 0.0 END AS inst, CASE WHEN coalesce(ts, 0) > 0 THEN ns / ts ELSE 0.0 END AS subc, CASE WHEN coalesce(td, 0) > 0 THEN nd / td ELSE 0.0 END AS descr
  FROM found f JOIN known e ON e.id = f.entity_id LEFT JOIN known t ON t.id = f.correct_id LEFT JOIN ctx x ON x.tab_id = f.tab_id AND x."row" = f."row" AND x.col = f.col AND x.pos = f.pos)"""
)
_BEST = (
    _FEAT
    + """, best AS (SELECT tab_id, "row", col, correct_id, entity_id FROM (SELECT *, row_number() OVER (PARTITION BY tab_id, "row", col ORDER BY round(lex + inst + subc + descr, 9) DESC, pos) AS rn
  FROM feat WHERE lex IS NOT NULL) WHERE rn = 1)"""
)
_NEXT = """, nxt AS (SELECT DISTINCT a.correct_id, b.correct_id AS next_id FROM ds a JOIN ds b ON a.tab_id = b.tab_id AND a.col = b.col AND b."row" = a."row" + 1)"""
_SEARCH = (
    _DOCS
    + f""",
web AS (SELECT response_id, lower(doc->>'$.queryContext.originalQuery') AS asked, doc->>'$.queryContext.alteredQuery' AS altered,
  CASE WHEN coalesce(json_type(doc, '$.webPages.value'), 'NULL') <> 'NULL' THEN list_transform({_LISTED}, lambda p: p->>'$.name') END AS titles FROM docs WHERE doc->>'$._type' = 'SearchResponse'),
stored AS (SELECT asked, arg_min(altered, response_id) AS altered, min(response_id) AS response_id, arg_min(titles, response_id) AS titles FROM web WHERE asked IS NOT NULL GROUP BY 1)"""
)
_PRF = "SELECT {0} round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM (SELECT {0} CASE WHEN n > 0 THEN c / n ELSE 0 END AS p, CASE WHEN g > 0 THEN c / g ELSE 0 END AS r FROM s)"
_CEA = (
    f"WITH {_GOLD}, "
    + f"""gu AS (SELECT tab_id, "row", col, correct_id AS n, list_transform(ids, lambda i: lower('{P}Q' || CAST(i AS VARCHAR))) AS gold FROM gold),
sub AS (SELECT 'one' AS file, tab_id, "row", col, CASE WHEN n % 5 = 0 THEN 'Q1' WHEN n % 3 = 0 THEN 'q' || n ELSE '{P}Q' || n END AS annotation FROM gu
  UNION ALL SELECT 'two', tab_id, "row" + CASE WHEN n % 2 = 0 THEN 1000 ELSE 0 END, col, '{P}Q' || n FROM gu WHERE n % 3 = 0),
j AS (SELECT file, list_contains(gold, lower(CASE WHEN starts_with(annotation, '{P}') THEN annotation ELSE '{P}' || annotation END)) AS ok FROM sub JOIN gu USING (tab_id, "row", col)),
s AS (SELECT file, count(*) AS n, CAST(sum(ok::INT) AS DOUBLE) AS c, (SELECT count(*) FROM gu) AS g FROM j GROUP BY 1) """
)

SQL = {
    "open_dataset": _DATA + 'SELECT tab_id, "row", col, mention, correct_id FROM ds',
    "columns_grouped": _DATA + """SELECT tab_id, col, count(*) AS n, string_agg(mention, '|' ORDER BY "row", mention) AS mentions FROM ds GROUP BY 1, 2""",
    "target_cells": _DATA + "SELECT count(*) AS cells, count(DISTINCT mention) AS mentions FROM ds",
    "cell_key": _DATA + """SELECT tab_id || '_' || "row" || '_' || col AS key, mention FROM ds""",
    "id_from_url": "SELECT entity, string_split(entity, '/')[-1] AS segment, try_cast(string_split(entity, '/')[-1][2:] AS BIGINT) AS number FROM (SELECT DISTINCT entity FROM cea_gt WHERE entity IS NOT NULL)",
    "string_basics": "SELECT val_id, lower(label) AS low, replace(label, ' ', '_') AS replaced, len(string_split(label, ' ')) AS parts, contains(lower(label), 'of') AS has_of, label LIKE '%.' AS dotted FROM vals_labeled WHERE label IS NOT NULL",
    "run_stamp": "SELECT gt_id, strftime(loaded_at, '%d-%m_%H-%M-%S') AS stamp FROM cea_gt",
    "remove_last_symbol": _TITLES + r"SELECT response_id, pos, regexp_replace(title, '[,:;\-. ?!]+$', '') AS stripped FROM titles",
    "acceptable_match": _TITLES + "SELECT response_id, pos, NOT ends_with(title, '...') AS complete FROM titles",
    "remove_stopwords": f"SELECT doc_id, md5(array_to_string({words('text')}, ' ')) AS digest FROM documents WHERE text IS NOT NULL",
    "term_counts": f"WITH {_CAT}, {terms('cat')} SELECT entity_id, token, n FROM terms",
    "description_cosine": _DATA + ", " + _KNOWN + _NEXT + ", " + terms("known") + ", " + _UNIT + """
SELECT correct_id, next_id, round(coalesce(sum(a.w * b.w), 0), 6) AS cosine FROM nxt LEFT JOIN unit a ON a.entity_id = correct_id LEFT JOIN unit b ON b.entity_id = next_id AND b.token = a.token
WHERE correct_id < next_id GROUP BY 1, 2""",
    "indel_ratio": f"SELECT val_id, round({ratio('label', 'actual_label')}, 6) AS ratio FROM vals_labeled WHERE label IS NOT NULL AND actual_label IS NOT NULL",
    "title_subsets": _SUBSETS + "SELECT response_id, pos, nth, subset FROM parts",
    "title_distance": _SUBSETS + f", lows AS (SELECT response_id, pos, nth, lower(asked) AS a, lower(subset) AS b FROM parts) SELECT response_id, pos, nth, round(1 - {ratio('a', 'b')}, 6) AS distance FROM lows",
    "best_title_match": _SUBSETS + f""", lows AS (SELECT *, lower(asked) AS a, lower(subset) AS b FROM parts), d AS (SELECT *, 1 - {ratio('a', 'b')} AS far FROM lows),
b1 AS (SELECT response_id, asked, subset, row_number() OVER (PARTITION BY response_id ORDER BY far, pos, nth) AS rn FROM d),
b2 AS (SELECT response_id, asked, regexp_replace(subset, '[,:;\\-. ?!]+$', '') AS s FROM b1 WHERE rn = 1)
SELECT response_id, CASE WHEN ends_with(s, '...') THEN asked ELSE replace(s, chr(8217), '''') END AS best FROM b2""",
    "search_lookup": f"WITH {_CELLS}, {_SEARCH}, ask AS (SELECT mention FROM cells UNION SELECT upper(asked) FROM stored) SELECT mention, response_id, altered FROM ask JOIN stored ON lower(mention) = asked",
    "search_request": f"WITH {_CELLS} SELECT DISTINCT mention, mention || 'site:www.wikidata.org' AS request FROM cells",
    "entity_parse": f"""WITH {_CAT}, n AS (SELECT id, max(title) AS t, max(description) AS d FROM candidate GROUP BY id)
SELECT id, title, description, len(instances) + len(subclasses) AS claims FROM cat""",
    "entity_label": f"WITH {_CAT} SELECT id, title FROM cat",
    "entity_lookup": _DATA + ", " + _KNOWN + "SELECT DISTINCT correct_id AS id, title, description FROM gold LEFT JOIN known ON id = correct_id",
    "claims_flatten": f"WITH {_CAT} SELECT id, 'P31' AS property, 'Q' || unnest(instances) AS target FROM cat UNION ALL SELECT id, 'P279', 'Q' || unnest(subclasses) FROM cat",
    "instances_subclasses": f"WITH {_CAT} SELECT id, coalesce(array_to_string(instances, ' '), '') AS instances, coalesce(array_to_string(subclasses, ' '), '') AS subclasses FROM cat",
    "candidate_topk": _DATA + ", " + _KNOWN + f""",
scored AS (SELECT mention, id AS entity_id, {ratio("mention", "title")} AS score FROM (SELECT DISTINCT mention FROM ds WHERE mention <> '') CROSS JOIN known WHERE title <> '')
SELECT mention, entity_id, CAST(row_number() OVER (PARTITION BY mention ORDER BY score DESC, entity_id) - 1 AS INTEGER) AS pos FROM scored QUALIFY pos < 30""",
    "correct_candidate": _DATA + ", " + _KNOWN + 'SELECT tab_id, "row", col, correct_id, title, id IS NOT NULL AS fetched FROM ds LEFT JOIN known ON id = correct_id',
    "candidate_recall": _FOUND + 'SELECT (SELECT count(*) FROM ds) AS cells, count(*) AS hit FROM (SELECT DISTINCT tab_id, "row", col FROM found WHERE entity_id = correct_id)',
    "fetch_completeness": _FOUND + """SELECT tab_id, col, count(*) AS cells, bool_and(correct_id IN (SELECT id FROM known)) AS complete FROM ds GROUP BY 1, 2""",
    "distinct_mentions": f"""WITH {_CELLS} SELECT mention, tab_id, "row", col FROM (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY tab_id, "row", col) AS rn FROM cells) WHERE rn = 1""",
    "merge_dict": f"""WITH {_CAT}, r AS (SELECT CAST(item_id[2:] AS BIGINT) AS id, upper(label) AS title FROM kg_item)
SELECT coalesce(r.id, c.id) AS id, CASE WHEN r.id IS NOT NULL THEN r.title ELSE c.title END AS title FROM cat c FULL JOIN r ON r.id = c.id""",
    "instance_overlap_pair": _DATA + ", " + _KNOWN + _NEXT + """SELECT correct_id, next_id, len(list_intersect(list_distinct(a.instances), list_distinct(b.instances))) AS inst,
len(list_intersect(list_distinct(a.subclasses), list_distinct(b.subclasses))) AS subc FROM nxt JOIN known a ON a.id = correct_id JOIN known b ON b.id = next_id""",
    "context_pairs": _FOUND + _PAIRS + 'SELECT tab_id, "row", col, pos, count(*) AS pairs FROM pairs WHERE entity_id <> other_id GROUP BY 1, 2, 3, 4',
    "column_features": _FEAT + 'SELECT tab_id, "row", col, pos, entity_id, round(round(lex, 9) + 1e-10, 6) AS lex, round(round(inst, 9) + 1e-10, 6) AS inst, round(round(subc, 9) + 1e-10, 6) AS subc, round(round(descr, 9) + 1e-10, 6) AS descr FROM feat',
    "feature_vectors": _FEAT + 'SELECT tab_id, "row", col, pos, CAST(entity_id AS DOUBLE) AS f0, round(round(coalesce(lex, 0), 9) + 1e-10, 6) AS f1, round(round(inst, 9) + 1e-10, 6) AS f2, round(round(subc, 9) + 1e-10, 6) AS f3, round(round(descr, 9) + 1e-10, 6) AS f4 FROM feat',
    "label_vectors": _FOUND + 'SELECT tab_id, "row", col, pos, CASE WHEN entity_id = correct_id THEN 1.0 ELSE 0.0 END::DOUBLE AS label FROM found',
    "best_candidate": _BEST + 'SELECT tab_id, "row", col, correct_id, entity_id FROM best',
    "linking_accuracy": _BEST + """, m AS (SELECT ds.correct_id, b.entity_id FROM ds LEFT JOIN best b USING (tab_id, "row", col)),
c AS (SELECT count(*) AS cells, count(*) FILTER (WHERE entity_id IS NULL OR entity_id = correct_id) AS "right", count(*) FILTER (WHERE entity_id = correct_id) AS right_strict FROM m)
SELECT cells, "right", right_strict, round("right" / cells, 6) AS accuracy, round(right_strict / cells, 6) AS accuracy_strict FROM c""",
    "spell_pairs": _DATA + ", " + _KNOWN + "SELECT mention AS label, title AS actual_label, correct_id AS entity_id FROM ds JOIN known ON id = correct_id",
    "uri_normalise": f"""WITH t AS (SELECT DISTINCT tab_id, col_id, unnest(string_split_regex(trim(type), '\\s+')) AS type FROM cta_gt WHERE type IS NOT NULL)
SELECT DISTINCT tab_id, col_id, lower(CASE WHEN starts_with(type, '{P}') THEN type ELSE '{P}' || type END) AS uri FROM t""",
    "cea_eval": _CEA.replace("FROM j GROUP BY 1", "FROM j WHERE file = 'one' GROUP BY 1") + _PRF.format(""),
    "eval_leaderboard": _CEA + _PRF.format("file,"),
    "cpa_eval": f"""WITH {_ONCE}, g AS (SELECT tab_id, '{PP}P' || sum(length(col1)) AS gold, count(*) AS n FROM once WHERE col1 IS NOT NULL GROUP BY 1),
a AS (SELECT gold, CASE WHEN n % 5 = 0 THEN 'P0' ELSE gold END AS ann FROM g WHERE n % 7 <> 0),
s AS (SELECT count(*) AS n, CAST(sum((lower(gold) = lower(ann))::INT) AS DOUBLE) AS c, (SELECT count(*) FROM g) AS g FROM a) """ + _PRF.format(""),
}

_TEXT = "json_type({0}, '$.{1}') = 'VARCHAR'"
_HIT_FIELDS = "['id', 'title', 'pageid', 'display', 'repository', 'url', 'concepturi', 'label', 'description', 'match', 'aliases']"
_INT = "('BIGINT', 'UBIGINT')"


def _only(value: str, path: str, *names: str) -> str:
    """Whether there is an object at a path with no other fields than those."""
    return f"(coalesce(json_type({value}, '$.{path}'), '') = 'OBJECT' AND len(list_filter(json_keys({value}, '$.{path}'), lambda k: NOT list_contains({list(names)}, k))) = 0)"


def _said(value: str, path: str) -> str:
    """Whether there is a text with its language at a path."""
    return f"({_only(value, path, 'value', 'language')} AND coalesce({_TEXT.format(value, path + '.value')} AND {_TEXT.format(value, path + '.language')}, false))"


SQL["validate_response"] = (
    f"WITH d AS (SELECT response_id, max_by(CAST(body AS JSON), (received_at, body)) AS doc FROM raw_response WHERE endpoint = 'kg' AND response_id IS NOT NULL AND json_valid(body) GROUP BY 1), "
    + f"""r AS (SELECT response_id, CASE WHEN json_type(doc) <> 'OBJECT' THEN 'not an object'
  WHEN len(list_filter(json_keys(doc), lambda k: k NOT IN ('searchinfo', 'search', 'search_continue', 'success'))) > 0 THEN 'unknown field'
  WHEN NOT ({_only('doc', 'searchinfo', 'search')} AND coalesce({_TEXT.format('doc', 'searchinfo.search')}, false)) THEN 'searchinfo'
  WHEN coalesce(json_type(doc, '$.search'), '') <> 'ARRAY' THEN 'search'
  WHEN json_type(doc, '$.search_continue') NOT IN {_INT} THEN 'search_continue'
  WHEN coalesce(try_cast(doc->>'$.success' AS INTEGER), 0) <> 1 THEN 'success' END AS top,
  CASE WHEN json_type(doc, '$.search') = 'ARRAY' THEN CAST(doc->'$.search' AS JSON[]) ELSE [] END AS hits FROM d),
h AS (SELECT response_id, top, list_filter(list_transform(hits, lambda h: CASE
  WHEN coalesce(json_type(h), '') <> 'OBJECT' THEN 'hit: not an object'
  WHEN len(list_filter(json_keys(h), lambda k: NOT list_contains({_HIT_FIELDS}, k))) > 0 THEN 'hit: unknown field'
  WHEN NOT coalesce({" AND ".join(_TEXT.format("h", c) for c in ("id", "title", "repository", "url", "concepturi", "label"))}, false) THEN 'hit: text field'
  WHEN coalesce(json_type(h, '$.pageid'), '') NOT IN {_INT} THEN 'hit: pageid'
  WHEN h->>'$.repository' <> 'kgdata' THEN 'hit: repository'
  WHEN NOT ({_only('h', 'display', 'label', 'description')} AND {_said('h', 'display.label')} AND (json_type(h, '$.display.description') IS NULL OR {_said('h', 'display.description')})) THEN 'hit: display'
  WHEN NOT ({_only('h', 'match', 'type', 'language', 'text')} AND coalesce(h->>'$.match.type', '') IN ('label', 'alias') AND coalesce({_TEXT.format('h', 'match.language')} AND {_TEXT.format('h', 'match.text')}, false)) THEN 'hit: match'
  WHEN json_type(h, '$.description') <> 'VARCHAR' THEN 'hit: description'
  WHEN json_type(h, '$.aliases') IS NOT NULL AND (json_type(h, '$.aliases') <> 'ARRAY' OR len(list_filter(CAST(h->'$.aliases' AS JSON[]), lambda a: json_type(a) <> 'VARCHAR')) > 0) THEN 'hit: aliases' END),
  lambda x: x IS NOT NULL) AS broken FROM r)
SELECT response_id, coalesce(top, broken[1]) IS NULL AS is_valid, coalesce(top, broken[1]) AS reason FROM h"""
)
SQL["cta_eval"] = (
    _CLASSES
    + f""", bel AS (SELECT '{P}Q' || a AS anc, '{P}Q' || node AS node, len(trail) - p AS d FROM (SELECT node, trail, unnest(trail) AS a, generate_subscripts(trail, 1) AS p FROM ended) WHERE a <> node),
gold AS (SELECT tab_id, col_id, list_transform(string_split_regex(trim(max(type)), '\\s+'), lambda t: CASE WHEN starts_with(t, '{P}') THEN t ELSE '{P}' || t END) AS types
  FROM cta_gt WHERE type IS NOT NULL AND trim(type) <> '' GROUP BY 1, 2),
f AS (SELECT tab_id, col_id, types, types[1] AS t, CAST(right(types[1], 1) AS INTEGER) AS digit FROM gold),
high AS (SELECT f.tab_id, f.col_id, max((d, anc)) AS u FROM f JOIN bel ON bel.node = f.t WHERE d <= digit GROUP BY 1, 2),
down AS (SELECT anc, max((d, node)) AS u FROM bel GROUP BY 1),
sub AS (SELECT f.*, lower(CASE WHEN digit % 4 = 3 THEN coalesce(down.u[2], t) ELSE coalesce(high.u[2], t) END) AS said
  FROM f LEFT JOIN high USING (tab_id, col_id) LEFT JOIN down ON down.anc = f.t),
e AS (SELECT tab_id, col_id, said, lower(unnest(types)) AS g FROM sub),
best AS (SELECT tab_id, col_id, max(CASE WHEN g = said THEN 1.0 WHEN b1.d IS NOT NULL THEN CASE WHEN b1.d <= 5 THEN pow(0.8, b1.d) ELSE 0.0 END
  WHEN b2.d IS NOT NULL THEN CASE WHEN b2.d <= 3 THEN pow(0.7, b2.d) ELSE 0.0 END ELSE 0.0 END) AS b
  FROM e LEFT JOIN bel b1 ON lower(b1.node) = g AND lower(b1.anc) = said LEFT JOIN bel b2 ON lower(b2.anc) = g AND lower(b2.node) = said GROUP BY 1, 2),
s AS (SELECT count(*) AS n, sum(b) AS c, (SELECT count(*) FROM gold) AS g FROM best) """
    + _PRF.format("")
)

for _name, _where in (("spellcheck_accuracy", ""), ("spellcheck_accuracy_hard", " AND label <> actual_label")):
    SQL[_name] = (
        rf"SELECT count(*) AS total, count(*) FILTER (WHERE lower(regexp_replace(trim(label), '\s+', ' ', 'g')) = lower(actual_label)) AS correct,"
        rf" round(100.0 * count(*) FILTER (WHERE lower(regexp_replace(trim(label), '\s+', ' ', 'g')) = lower(actual_label)) / count(*), 2) AS accuracy"
        rf" FROM vals_labeled WHERE label IS NOT NULL AND actual_label IS NOT NULL{_where}"
    )


def _suggestion() -> str:
    """The decision tree over the distinct mentions; the closest subset is taken only for mentions that have an answer with pages."""
    return (
        f"WITH {_CELLS}, {_SEARCH}, "
        + r"""ask AS (SELECT mention FROM cells UNION SELECT upper(asked) FROM stored),
m AS (SELECT mention, altered, titles FROM ask JOIN stored ON lower(mention) = asked WHERE titles IS NOT NULL),
ok AS (SELECT mention, altered AS s FROM m WHERE altered IS NOT NULL AND len(list_filter(titles, lambda t: contains(t, altered))) > 0),
rest AS (SELECT mention, list_filter(titles, lambda t: t IS NOT NULL) AS titles FROM m WHERE mention NOT IN (SELECT mention FROM ok)),
w AS (SELECT mention, CAST(i AS INTEGER) AS pos, replace(titles[i], ' - Wikidata', '') AS whole, list_filter(string_split_regex(replace(titles[i], ' - Wikidata', ''), '\s+'), lambda x: x <> '') AS ws
  FROM (SELECT mention, titles, unnest(generate_series(1, len(titles))) AS i FROM rest)),
masks AS (SELECT *, unnest(CASE WHEN len(ws) = 0 THEN [0] ELSE generate_series(0, CAST(pow(2, len(ws)) AS BIGINT) - 1) END) AS k FROM w),
subs AS (SELECT *, CASE WHEN k = 0 THEN whole ELSE list_aggregate(list_filter(list_transform(generate_series(1, len(ws)), lambda j: CASE WHEN (k >> CAST(j - 1 AS INTEGER)) % 2 = 1 THEN ws[j] END), lambda x: x IS NOT NULL), 'string_agg', ' ') END AS subset FROM masks),
lows AS (SELECT mention, pos, k, subset, lower(mention) AS a, lower(subset) AS b FROM subs WHERE k = 0 OR subset <> whole),
"""
        + f"d AS (SELECT *, 1 - {ratio('a', 'b')} AS far FROM lows), "
        + r"""b1 AS (SELECT mention, regexp_replace(subset, '[,:;\-. ?!]+$', '') AS s, row_number() OVER (PARTITION BY mention ORDER BY far, pos, CASE WHEN k = 0 THEN 1 ELSE 0 END, k) AS rn FROM d),
b2 AS (SELECT mention, CASE WHEN ends_with(s, '...') THEN mention ELSE replace(s, chr(8217), '''') END AS s FROM b1 WHERE rn = 1),
u AS (SELECT * FROM ok UNION ALL SELECT * FROM b2),
v AS (SELECT mention, regexp_replace(replace(replace(replace(replace(s, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;?', '&', 'g') AS suggestion FROM u)"""
    )


SQL["suggestion"] = _suggestion() + " SELECT mention, suggestion FROM v WHERE mention <> suggestion"
SQL["variant_union"] = (
    _suggestion()
    + f""", {_GOLD}, ds AS (SELECT c.*, g.correct_id FROM cells c JOIN gold g USING (tab_id, "row", col))
SELECT tab_id, "row", col, 'raw' AS variant, mention FROM ds UNION ALL SELECT tab_id, "row", col, 'spell', coalesce(suggestion, mention) FROM ds LEFT JOIN v USING (mention)"""
)

for _name, _where in (("suggestion_accuracy", ""), ("suggestion_accuracy_hard", " WHERE label <> actual_label")):
    SQL[_name] = (
        _suggestion()
        + f""", {_GOLD}, {_KNOWN}, ds AS (SELECT c.*, g.correct_id FROM cells c JOIN gold g USING (tab_id, "row", col)),
pr AS (SELECT mention AS label, title AS actual_label, coalesce(suggestion, mention) AS said FROM ds JOIN known ON id = correct_id LEFT JOIN v USING (mention))
SELECT count(*) AS total, count(*) FILTER (WHERE lower(said) = lower(actual_label)) AS correct, round(100.0 * count(*) FILTER (WHERE lower(said) = lower(actual_label)) / nullif(count(*), 0), 2) AS accuracy FROM pr{_where}"""
    )

_UNESCAPED = "regexp_replace(replace(replace(replace(replace(title, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&amp;?', '&', 'g')"
SQL["html_unescape"] = _TITLES + f"SELECT response_id, pos, {_UNESCAPED} AS title FROM titles"
_matched = ", ".join(f"CASE WHEN regexp_matches(lower(title || ' - ' || description), '{rule}') THEN {ENTITY_TYPES[name]} END" for name, rule in ENTITY_RULES.items())
SQL["ner_labels"] = f"WITH {_CAT} SELECT id, array_to_string(list_sort(list_filter([{_matched}], lambda x: x IS NOT NULL)), ' ') AS labels FROM cat"

_SPELL = (
    _suggestion()
    + f""", {_GOLD}, ds AS (SELECT c.tab_id, c."row", c.col, coalesce(v.suggestion, c.mention) AS mention, g.correct_id FROM cells c JOIN gold g USING (tab_id, "row", col) LEFT JOIN v ON v.mention = c.mention)"""
    + _FEAT[len(_DATA) :]
)
SQL["column_features_spell"] = _SPELL + SQL["column_features"][len(_FEAT) :]
SQL["annotation_scan"] = "SELECT gt_id::VARCHAR AS gt_id, coalesce(tab_id, '') AS tab_id, coalesce(row_id, '') AS row_id, coalesce(col_id, '') AS col_id, coalesce(entity, '') AS entity FROM cea_gt"
SQL["deny_list"] = f"""WITH {_GOLD}, denied AS (SELECT DISTINCT CAST(item_id[2:] AS BIGINT) AS id FROM kg_item WHERE description IS NULL)
SELECT tab_id, "row", col, correct_id FROM gold WHERE correct_id NOT IN (SELECT id FROM denied)"""
