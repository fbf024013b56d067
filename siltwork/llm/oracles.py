"""DuckDB SQL with the results of those operators that SQL can express."""

OP2 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words),
every AS (SELECT doc_id, unnest(s) AS g FROM sets),
grams AS (SELECT doc_id, g FROM (SELECT doc_id, g, count(*) OVER (PARTITION BY g) AS df FROM every) WHERE df > 1),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id
  JOIN sets sx ON sx.doc_id = x.doc_id JOIN sets sy ON sy.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, len(sx.s), len(sy.s) HAVING 100 * count(*) >= 85 * (len(sx.s) + len(sy.s) - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.b) AS component_id
FROM sets s JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, len(s.s)
"""

OP4 = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
stats AS (SELECT count(*) AS n, avg(len(w)) AS average FROM words),
terms AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM words) GROUP BY doc_id, t),
df AS (SELECT t, count(*) AS df FROM terms GROUP BY t),
scored AS (
  SELECT q.doc_id AS query_id, d.doc_id, round(sum(ln((s.n - f.df + 0.5) / (f.df + 0.5) + 1) * d.tf * 2.2 / (d.tf + 1.2 * (0.25 + 0.75 * len(x.w) / s.average))), 6) AS score
  FROM terms q JOIN df f ON f.t = q.t JOIN terms d ON d.t = q.t JOIN words x ON x.doc_id = d.doc_id CROSS JOIN stats s
  WHERE q.doc_id % 50 = 0 GROUP BY q.doc_id, d.doc_id),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT query_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

OP10 = """
WITH RECURSIVE vectors AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM vectors x JOIN vectors y ON x.label = y.label AND x.vec_id <> y.vec_id
  WHERE list_dot_product(x.v, y.v) >= 0.93 * sqrt(list_dot_product(x.v, x.v) * list_dot_product(y.v, y.v))),
reach AS (SELECT vec_id AS a, vec_id AS b FROM vectors UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
named AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT n.a AS vec_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, n.component_id, n.a = n.component_id AS kept
FROM named n LEFT JOIN counted c ON c.a = n.a
"""

OP11 = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
every AS (SELECT d, lang, source, unnest(w) AS t FROM docs),
kept AS (SELECT lang, t, count(*) AS n FROM every GROUP BY lang, t HAVING count(DISTINCT d) >= 3),
held AS (SELECT lang, source, t, count(*) AS n FROM every SEMI JOIN kept USING (lang, t) GROUP BY lang, source, t),
langs AS (SELECT lang, count(t) AS v, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang FROM docs) LEFT JOIN kept USING (lang) GROUP BY lang),
sizes AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN held USING (lang, source) GROUP BY lang, source),
shares AS (
  SELECT s.lang, s.source, k.t, coalesce(h.n, 0) AS n, CAST(1 + 1000000000 * CAST(coalesce(h.n, 0) + 1 AS HUGEINT) // (s.total + l.v) AS BIGINT) AS p, CAST(1 + 1000000000 * CAST(k.n + 1 AS HUGEINT) // (l.total + l.v) AS BIGINT) AS q
  FROM sizes s JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN held h ON h.lang = s.lang AND h.source = s.source AND h.t = k.t),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0) AS BIGINT) AS value
  FROM sizes a JOIN sizes b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.t = x.t
  GROUP BY a.lang, a.source, b.source),
found AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', t, (p - q) * (p - q) // q FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM found)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""

OP12 = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
stats AS (SELECT count(*) FILTER (len(w) > 0) AS n, sum(len(w)) AS l FROM docs),
lengths AS (SELECT d, doc_id, CAST(75 + (25 * len(w) * s.n) // s.l AS BIGINT) AS m FROM docs, stats s WHERE len(w) > 0),
terms AS (SELECT d, t, count(*) AS tf FROM (SELECT d, unnest(w) AS t FROM docs) GROUP BY d, t),
asked AS (
  SELECT item_id, t, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark WHERE item_id IS NOT NULL) GROUP BY item_id, t),
weights AS (SELECT t, CAST(floor(1000 * ln((2 * s.n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM terms, stats s GROUP BY t, s.n),
scored AS (
  SELECT a.item_id, x.d, l.doc_id, sum(a.times * w.w * ((1000000000 * x.tf) // (1000 * x.tf + 12 * l.m))) AS score
  FROM asked a JOIN weights w USING (t) JOIN terms x USING (t) JOIN lengths l USING (d) WHERE l.doc_id IS NOT NULL GROUP BY a.item_id, x.d, l.doc_id),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""

# the checksum is linear over bits: a byte's share of it depends on its bits and on how many bytes follow
OP13 = r"""
WITH RECURSIVE steps AS (SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))) AS t),
docs AS (SELECT row_number() OVER () AS d, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
after AS (
  SELECT 0 AS k, list_transform(range(8), lambda i: t[(1 << i) + 1]) AS own, 4294967295 AS start, t FROM steps
  UNION ALL SELECT k + 1, list_transform(own, lambda x: xor(t[(x & 255) + 1], x >> 8)), xor(t[(start & 255) + 1], start >> 8), t FROM after WHERE k < (SELECT max(len(h)) FROM docs) // 2),
bytes AS (SELECT d, unnest(regexp_extract_all(h, '..')) AS b, generate_subscripts(regexp_extract_all(h, '..'), 1) AS i, len(h) // 2 AS n FROM docs),
sums AS (
  SELECT d, bit_xor(list_reduce(list_transform(range(8), lambda i: CASE WHEN (CAST('0x' || b AS BIGINT) >> i) & 1 = 1 THEN a.own[i + 1] ELSE 0 END), lambda x, y: xor(x, y))) AS x
  FROM bytes JOIN after a ON a.k = n - i GROUP BY d),
sized AS (
  SELECT d.d, d.doc_id, len(h) // 2 + 1 AS size, xor(xor(coalesce(s.x, 0), a.start), 4294967295) AS text_crc32, coalesce(CAST(d.doc_id AS VARCHAR), '') AS key
  FROM docs d JOIN after a ON a.k = len(h) // 2 LEFT JOIN sums s USING (d)),
nodes AS (
  SELECT '13/' || r || ':' AS path, 1 AS level, r AS number, -1 AS above, CASE WHEN r = 4 THEN 1.0 ELSE 4.0 END AS weight FROM range(5) t(r)
  UNION ALL SELECT '13/' || r || '/' || k || ':', 2, 2 * r + k, r, CASE WHEN r = 4 THEN 1.0 ELSE 2.0 END FROM range(5) t(r), range(2) u(k) WHERE r < 4 OR k = 0
  UNION ALL SELECT '13/' || r || '/' || k || '/' || s || ':', 3, 4 * r + 2 * k + s, 2 * r + k, 1.0 FROM range(5) t(r), range(2) u(k), range(2) v(s) WHERE r < 4 OR (k = 0 AND s = 0)),
drawn AS (SELECT d, level, number, above, -ln((CAST('0x' || substr(md5(path || key), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0) / weight AS draw FROM sized, nodes),
regions AS (SELECT d, arg_min(number, draw) FILTER (number < 4) AS now, arg_min(number, draw) AS later FROM drawn WHERE level = 1 GROUP BY d),
racks AS (SELECT d, arg_min(x.number, x.draw) FILTER (x.above = r.now) AS now, arg_min(x.number, x.draw) FILTER (x.above = r.later) AS later FROM drawn x JOIN regions r USING (d) WHERE level = 2 GROUP BY d),
shards AS (SELECT d, arg_min(x.number, x.draw) FILTER (x.above = r.now) AS now, arg_min(x.number, x.draw) FILTER (x.above = r.later) AS later FROM drawn x JOIN racks r USING (d) WHERE level = 3 GROUP BY d)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, CAST(now AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY now ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, CAST(later AS INTEGER) AS grown_shard,
  CAST(now // 4 AS INTEGER) AS region, CAST(now // 2 % 2 AS INTEGER) AS rack
FROM sized JOIN shards USING (d)
"""
