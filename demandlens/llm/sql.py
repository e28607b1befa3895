"""DuckDB SQL for the operators that SQL can express, over the tables that the driver registers."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^ \t\n\x0B\x0C\r]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS sh
  FROM w
), x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 185 * count(*) >= 85 * (any_value(a.n) + any_value(b.n))
), reach(doc_id, seen) AS (
  SELECT doc_id, doc_id FROM s UNION SELECT l.b, r.seen FROM reach r JOIN links l ON r.doc_id = l.a
)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, c.component_id
FROM s JOIN (SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
"""

_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP6 = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents
), b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS ws FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, m, array_to_string(ws[i:i + m - 1], ' ') AS g
  FROM (SELECT item_id, ws, least(10, len(ws)) AS m, unnest(range(1, greatest(2, len(ws) - 8))) AS i FROM b WHERE len(ws) > 0)
), runs AS (
  SELECT doc_id, m, i, array_to_string(ws[i:i + m - 1], ' ') AS g
  FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM windows))
), found AS (SELECT a.doc_id, a.i, a.m, w.item_id FROM runs a JOIN windows w ON a.m = w.m AND a.g = w.g
), hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_HOSTS = r"""
SELECT page_id, to_timestamp(1704067200 + (page_id * 977) % 2592000)::TIMESTAMP AS fetched_at,
  nullif(regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(trim(url), '^(?i:https?)://([^/?#\\]*)', 1)), '^.*@', ''), '(:[0-9]*)?$', ''), '\.+$', ''), '') AS host
FROM pages
"""

OP10 = rf"""
WITH own AS ({_HOSTS}), hosts AS (SELECT host, CAST('0x' || substr(md5(host), 1, 6) AS BIGINT) AS c FROM (SELECT DISTINCT host FROM own WHERE host IS NOT NULL)
), entries AS (
  SELECT 'hosts' AS list_name, host AS pattern, 'block' AS action, c % 13 AS d FROM hosts WHERE c % 6 = 0
  UNION ALL SELECT 'hosts', host, 'remove', c % 13 + 5 FROM hosts WHERE c % 12 = 0
  UNION ALL SELECT 'hosts', host, 'block', c % 13 + 9 FROM hosts WHERE c % 60 = 0
  UNION ALL SELECT 'trusted', host, 'allow', c % 17 FROM hosts WHERE c % 7 = 0
  UNION ALL SELECT DISTINCT 'themes', array_to_string(string_split(host, '.')[-3:], '.'), 'block', 3 FROM hosts
    WHERE regexp_matches(array_to_string(string_split(host, '.')[-3:], '.'), '(^|[.-])(ads|bets|pills|casino)([.-])')
), spans AS (
  SELECT list_name, pattern, action, d, lead(d) OVER (PARTITION BY list_name, pattern ORDER BY d) AS until
  FROM (SELECT list_name, pattern, d, max(action) AS action FROM entries GROUP BY ALL)
), held AS (
  SELECT o.page_id, count(*) AS n_active, arg_max([s.pattern, s.action], (length(s.pattern), CAST(s.action = 'allow' AS INT), s.pattern)) AS rule
  FROM own o JOIN spans s ON (o.host = s.pattern OR ends_with(o.host, '.' || s.pattern)) AND s.action <> 'remove'
    AND epoch(o.fetched_at) >= 1704067200 + d * 86400 AND (until IS NULL OR epoch(o.fetched_at) < 1704067200 + until * 86400)
  GROUP BY o.page_id
)
SELECT own.page_id, host, strftime(fetched_at, '%Y-%m-%d %H:%M:%S') AS fetched_at, CAST(coalesce(n_active, 0) AS BIGINT) AS n_active, rule[1] AS pattern, rule[2] AS action,
  host IS NOT NULL AND coalesce(rule[2], 'none') <> 'block' AS kept
FROM own LEFT JOIN held USING (page_id)
"""

# crc32 of a decimal number's digits, bit by bit; -1 stands for a shift
_CRC = (
    "xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), "
    "lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END) END), 4294967295)"
)

OP12 = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS p
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_CRC} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)
), r AS (
  SELECT c.conv_id, 0 AS part, p, role, text FROM c JOIN t ON t.conv_id = c.base AND p < h
  UNION ALL SELECT c.conv_id, 1, p, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND p >= h
), w AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, p) AS d, sha256(length(role) || ':' || role || text) AS w, strlen(text) AS size FROM r
), pre AS (
  SELECT conv_id, d, md5(string_agg(w, '') OVER (PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING)) AS k, size FROM w
  UNION ALL SELECT conv_id, 0, 'root', 0 FROM c
), own AS (SELECT *, lag(k) OVER (PARTITION BY conv_id ORDER BY d) AS pk, d = max(d) OVER (PARTITION BY conv_id) AS ends FROM pre
), node AS (
  SELECT k, any_value(d) AS d, min(conv_id) AS conv_id, any_value(pk) AS pk, any_value(size) AS size, count(*) AS n, sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (ends), '')) AS lists
  FROM own GROUP BY k
), kids AS (SELECT pk, count(*) AS kids FROM node WHERE pk IS NOT NULL GROUP BY pk
), below AS (
  SELECT a.k, count(*) FILTER (kids IS NULL) AS leaves, sum((u.n - 1) * u.size) AS saved
  FROM node u LEFT JOIN kids ON kids.pk = u.k JOIN pre a ON a.conv_id = u.conv_id AND a.d <= u.d GROUP BY a.k
)
SELECT node.conv_id, CAST(node.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, node.n AS n_convs, CAST(coalesce(kids, 0) AS BIGINT) AS n_children,
  CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, node.lists AS ends_sha256
FROM node LEFT JOIN node up ON up.k = node.pk LEFT JOIN kids ON kids.pk = node.k JOIN below ON below.k = node.k
"""
