"""DuckDB SQL of the queries that SQL can express over whole tables."""

_OP2 = """
WITH v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (
  WITH RECURSIVE r AS (
    SELECT vec_id AS a, vec_id AS b FROM v UNION
    SELECT r.a, link.b FROM r JOIN link ON r.b = link.a)
  SELECT a, min(b) AS least FROM r GROUP BY a),
n AS (SELECT a, count(*) AS links FROM link GROUP BY a)
SELECT e.vec_id, coalesce(n.links, 0)::BIGINT AS n_links, coalesce(r.least, e.vec_id) AS component_id,
       e.vec_id = coalesce(r.least, e.vec_id) AS kept
FROM embeddings e LEFT JOIN reach r ON r.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""

_OP4 = """
WITH item AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM benchmark WHERE text IS NOT NULL),
i AS (SELECT item_id, w, len(w) AS n, least(5, len(w)) AS k FROM item WHERE len(w) > 0),
doc AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM documents WHERE text IS NOT NULL),
size AS (SELECT DISTINCT k FROM i),
item_all AS (
  SELECT item_id, n, k, array_to_string(w[p:p + k - 1], ' ') AS s, count(*) AS c
  FROM (SELECT item_id, w, n, k, unnest(range(1, n - k + 2)) AS p FROM i) GROUP BY ALL),
doc_all AS (
  SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS s, len(w) AS m
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM doc, size WHERE len(w) >= k)),
start AS (
  SELECT DISTINCT doc_id, item_id, n, k, a FROM (
    SELECT d.doc_id, x.item_id, x.n, x.k, d.m,
           unnest(range(greatest(1, d.p - (x.n - x.k)), least(d.p, d.m - x.n + 1) + 1)) AS a
    FROM doc_all d JOIN item_all x ON d.s = x.s AND d.k = x.k)),
held AS (
  SELECT t.doc_id, t.item_id, t.n, t.k, t.a, d.s, count(*) AS c
  FROM start t JOIN doc_all d ON d.doc_id = t.doc_id AND d.k = t.k AND d.p BETWEEN t.a AND t.a + t.n - t.k
  GROUP BY ALL),
score AS (
  SELECT h.doc_id, h.item_id, h.a, h.n - h.k + 1 AS z, sum(CASE WHEN x.c IS NULL THEN 0 ELSE least(h.c, x.c) END)::BIGINT AS both_
  FROM held h LEFT JOIN item_all x ON x.item_id = h.item_id AND x.s = h.s
  GROUP BY h.doc_id, h.item_id, h.a, h.n, h.k),
good AS (
  SELECT doc_id, item_id, a, both_::DOUBLE / (2 * z - both_)::DOUBLE AS similarity FROM score
  WHERE 100 * both_ >= 80 * (2 * z - both_))
SELECT doc_id, item_id, similarity, (min(a) - 1)::BIGINT AS first_word
FROM (SELECT *, max(similarity) OVER (PARTITION BY doc_id, item_id) AS best FROM good)
WHERE similarity = best GROUP BY doc_id, item_id, similarity
"""

_OP7 = """
WITH page AS (
  SELECT page_id, DATE '2024-01-01' + (page_id % 366)::INT AS day,
         nullif(lower(regexp_replace(regexp_extract(url,
           '^\\s*[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#@]*@)?(\\[[^\\]/?#]*\\]|[^/?#:]+)(?::\\d*)?([^?#\\s]*)', 1), '\\.$', '')), '') AS host,
         regexp_extract(url,
           '^\\s*[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#@]*@)?(\\[[^\\]/?#]*\\]|[^/?#:]+)(?::\\d*)?([^?#\\s]*)', 2) AS path
  FROM pages),
base AS (
  SELECT *, ('0x' || substr(md5(host), 1, 6))::INT AS lot FROM (
    SELECT DISTINCT host, regexp_extract(path, '^/([^/]+)', 1) AS step FROM page WHERE host IS NOT NULL)),
span AS (
  SELECT DISTINCT 'block' AS list, host AS pattern, lot % 200 AS a, lot % 200 + 90 AS b FROM base WHERE lot % 16 < 4
  UNION SELECT 'block', host, lot % 200 + 120, 1000000 FROM base WHERE lot % 16 < 2
  UNION SELECT 'allow', host || '/' || step, lot % 200 + 30, lot % 200 + 60 FROM base
  WHERE lot % 16 IN (0, 2) AND step <> ''),
hit AS (
  SELECT p.page_id, s.list, s.pattern FROM page p JOIN span s
    ON (s.list = 'block' AND ('.' || p.host) LIKE ('%.' || s.pattern)
        OR s.list = 'allow' AND ('.' || p.host || p.path || '/') LIKE ('%.' || s.pattern || '/%')
           AND contains(s.pattern, '/'))
    AND date_diff('day', DATE '2024-01-01', p.day) >= s.a AND date_diff('day', DATE '2024-01-01', p.day) < s.b),
best AS (
  SELECT page_id, count(*) AS n_active,
         arg_max(list || ':' || pattern, (length(pattern), list = 'allow', pattern)) AS rule
  FROM hit GROUP BY page_id)
SELECT p.page_id, p.host, p.day, coalesce(b.n_active, 0)::BIGINT AS n_active, b.rule,
       coalesce(starts_with(b.rule, 'block:'), false) AS blocked
FROM page p LEFT JOIN best b USING (page_id)
"""

_OP6 = """
WITH doc AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+'), []) AS w FROM documents),
win AS (
  SELECT doc_id, p, md5(array_to_string(w[p:p + 34], ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS p FROM doc WHERE len(w) >= 35)),
often AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS p FROM win WHERE s IN (SELECT s FROM often)),
kept AS (
  SELECT d.doc_id, string_agg(d.x, ' ' ORDER BY d.p) AS k, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM doc) d
  ANTI JOIN gone g ON g.doc_id = d.doc_id AND g.p = d.p GROUP BY d.doc_id)
SELECT doc.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(kept.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept.k, '')) AS kept_sha256
FROM doc LEFT JOIN kept USING (doc_id)
"""

_OP10 = """
WITH doc AS (
  SELECT doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t\\n\\x0B\\f\\r]+'), []) AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[p:p + 3], ' ')) AS x
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS p FROM doc WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n
  HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
reach AS (
  WITH RECURSIVE r AS (
    SELECT doc_id AS a, doc_id AS b FROM n UNION
    SELECT r.a, link.b FROM r JOIN link ON r.b = link.a)
  SELECT a, min(b) AS least FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(r.least, d.doc_id) AS component_id,
       d.doc_id = coalesce(r.least, d.doc_id) AS kept
FROM doc d LEFT JOIN n USING (doc_id) LEFT JOIN reach r ON r.a = d.doc_id
"""

_FIELD = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{n}", "text")) + ")"

# crc32 of an id's digits: a byte is taken in by xor, then eight steps (-1) shift it through.
_OP11 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, {_LEAF.format(n="n_chars")} AS leaf,
         CASE WHEN xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
                range(1, strlen(doc_id::VARCHAR) + 1),
                lambda i: [ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
              lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END),
            4294967295) % 7 = 0 THEN {_LEAF.format(n="(n_chars + 1)")}
         ELSE {_LEAF.format(n="n_chars")} END AS claim
  FROM documents),
leaf AS (
  SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM d
  WINDOW w AS (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf)),
tree AS (
  SELECT lang, 0 AS lvl, i, n, leaf AS h FROM leaf
  UNION ALL
  SELECT lang, lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i))
  FROM tree WHERE n > 1 GROUP BY lang, lvl, i // 2, n),
sub AS (
  SELECT lang, h, row_number() OVER (ORDER BY lang IS NOT NULL, encode(lang)) - 1 AS i, count(*) OVER () AS n
  FROM tree WHERE n = 1),
top AS (
  SELECT 0 AS lvl, i, n, h FROM sub
  UNION ALL
  SELECT lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i))
  FROM top WHERE n > 1 GROUP BY lvl, i // 2, n),
low AS (
  SELECT l.lang, l.i, t.lvl, l.i >> t.lvl AS place, s.h AS beside FROM leaf l
  JOIN (SELECT DISTINCT lang, lvl FROM tree WHERE n > 1) t ON l.lang IS NOT DISTINCT FROM t.lang
  LEFT JOIN tree s ON s.lang IS NOT DISTINCT FROM l.lang AND s.lvl = t.lvl AND s.i = xor(l.i >> t.lvl, 1)),
steps AS (
  SELECT lang, i, list(CASE WHEN beside IS NULL THEN '=' WHEN place % 2 = 1 THEN '<' ELSE '>' END
                       || coalesce(beside, '') ORDER BY lvl) AS s FROM low GROUP BY lang, i),
over_ AS (
  SELECT u.lang, list(CASE WHEN s.h IS NULL THEN '=' WHEN (u.i >> t.lvl) % 2 = 1 THEN '<' ELSE '>' END
                      || coalesce(s.h, '') ORDER BY t.lvl) AS s
  FROM sub u JOIN (SELECT DISTINCT lvl FROM top WHERE n > 1) t ON true
  LEFT JOIN top s ON s.lvl = t.lvl AND s.i = xor(u.i >> t.lvl, 1) GROUP BY u.lang),
proof AS (
  SELECT l.doc_id, l.leaf, l.claim, u.h AS subroot, (SELECT h FROM top WHERE n = 1) AS root,
         list_concat(coalesce(a.s, []), coalesce(b.s, [])) AS s
  FROM leaf l JOIN sub u ON u.lang IS NOT DISTINCT FROM l.lang
  LEFT JOIN steps a ON a.lang IS NOT DISTINCT FROM l.lang AND a.i = l.i
  LEFT JOIN over_ b ON b.lang IS NOT DISTINCT FROM l.lang),
folded AS (
  SELECT *, list_reduce(list_prepend(claim, s), lambda h, x: CASE x[1] WHEN '<' THEN sha256(x[2:] || h)
            WHEN '>' THEN sha256(h || x[2:]) ELSE sha256(h) END) AS folded_root FROM proof)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(s, lambda x: x[2:]), '')) AS proof_sha256,
       folded_root, folded_root = root AS verified
FROM folded
"""

ORACLE_SQL: dict[str, str] = {
    "op2_cap_filters": _OP2,
    "op4_decontamination": _OP4,
    "op6_substring_dedup": _OP6,
    "op7_url_filters": _OP7,
    "op10_minhash_near_dedup": _OP10,
    "op11_merkle_manifest": _OP11,
}
