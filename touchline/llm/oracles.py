"""DuckDB SQL for the rows of the queries that SQL can express."""

_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM_WORDS = f"regexp_extract_all({_FOLD.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_SPACE_WORDS = f"regexp_extract_all({_FOLD.format('text')}, '[^\\x20\\x09-\\x0D]+')"

#: From (a, b) links in both directions: the smallest node that each one reaches.
_REACH = """
reach(a, b) AS (SELECT DISTINCT a, a FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
root AS (SELECT a, min(b) AS component FROM reach GROUP BY a)"""

VECTOR_DEDUP = f"""
WITH RECURSIVE v AS (
    SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
links AS (SELECT x.id AS a, y.id AS b FROM v x JOIN v y ON x.id <> y.id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.95),
{_REACH},
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN root ON root.a = vec_id
"""

BENCHMARK_PASSAGES = f"""
WITH d AS (SELECT doc_id, coalesce({_ALNUM_WORDS}, []) AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ALNUM_WORDS} AS ws FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
windows AS (
    SELECT DISTINCT item, least(len(ws), 10) AS k, array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') AS w
    FROM b, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS t(i) WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT k FROM windows),
runs AS (
    SELECT doc_id, k, i, array_to_string(ws[i : i + k - 1], ' ') AS w
    FROM (SELECT * FROM d, sizes WHERE len(ws) >= k), unnest(range(1, len(ws) - k + 2)) AS t(i)),
hits AS (SELECT doc_id, k, i, item FROM runs JOIN windows USING (k, w)),
covered AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, k, i FROM hits), unnest(range(i, i + k)) AS t(p) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""

JACCARD_CLASSES = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce({_SPACE_WORDS}, []) AS ws FROM documents),
s AS (
    SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS w
    FROM d, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS t(i) WHERE len(ws) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.w = y.w AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
{_REACH}
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component, doc_id) AS component_id
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN root ON root.a = doc_id
"""

_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINE_DEDUP = f"""
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM t),
k AS (SELECT *, {_FOLD.format(f"trim(line, {_BLANKS})")} AS k FROM l),
f AS (SELECT k, min(doc_id) AS first FROM k WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT k.*, coalesce(doc_id > first, false) AS dropped FROM k LEFT JOIN f USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

BY_QUERY = {
    "op1_vector_dedup": VECTOR_DEDUP,
    "op6_benchmark_passages": BENCHMARK_PASSAGES,
    "op9_jaccard_classes": JACCARD_CLASSES,
    "op13_line_dedup": LINE_DEDUP,
}
