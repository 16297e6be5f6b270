"""What SQL can say about the operators: the same rows by plain definitions, for small tables."""

from __future__ import annotations

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Every window of ten item words, looked up at every place of every document.
OP5 = rf"""WITH d AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, lengths WHERE len(w) >= n)),
hits AS (SELECT doc_id, k, n, item_id FROM dw JOIN bw USING (n, win)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)"""

#: All pairs of sets that share a shingle, counted; components by reach.
OP7 = rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2])) END AS g FROM d),
t AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both, any_value(a.n) AS na, any_value(b.n) AS nb FROM t a JOIN t b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs WHERE 100 * n_both >= 90 * (na + nb - n_both)),
reach AS (SELECT doc_id AS node, doc_id AS other FROM documents UNION SELECT node, CASE WHEN other = a THEN b ELSE a END FROM reach JOIN links ON other = a OR other = b)
SELECT node AS doc_id, CAST(len(g) AS BIGINT) AS n_shingles, min(other) AS component_id FROM reach JOIN s ON s.doc_id = node GROUP BY node, g"""

#: Every string of 200 bytes, counted; the bytes that repeated ones cover, and the rest put together again.
OP9 = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 400)) AS win FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 199)) AS p FROM d WHERE length(h) >= 400)),
twice AS (SELECT win FROM w GROUP BY 1 HAVING count(*) > 1),
m AS (SELECT doc_id, p FROM w JOIN twice USING (win)),
e AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM m),
i AS (SELECT doc_id, p, sum(CASE WHEN before IS NULL OR p > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM e),
spans AS (SELECT doc_id, min(p) AS a, max(p) + 200 AS z FROM i GROUP BY doc_id, k),
cuts AS (SELECT doc_id, z AS a, lead(a, 1, NULL) OVER (PARTITION BY doc_id ORDER BY a) AS z FROM spans UNION ALL SELECT doc_id, 0, min(a) FROM spans GROUP BY 1),
kept AS (SELECT doc_id, string_agg(CASE WHEN cuts.z IS NULL THEN substr(h, 2 * a + 1) ELSE substr(h, 2 * a + 1, 2 * (cuts.z - a)) END, '' ORDER BY a) AS h FROM cuts JOIN d USING (doc_id) GROUP BY 1),
sums AS (SELECT doc_id, sum(z - a) AS n, count(*) AS k FROM spans GROUP BY 1)
SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(k, 0) AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)"""

#: Checksum bit by bit; a conversation is the joined digests of its turns, 32 characters each; a node is a beginning of it.
OP11 = """WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS p,
  md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, length(coalesce(text, '')) AS size FROM conversations WHERE conv_id IS NOT NULL),
sums AS (SELECT conv_id, conv_id - conv_id % 100 AS head, xor(list_reduce(list_concat([4294967295], flatten(list_transform(range(1, length(s) + 1), lambda i: [ascii(s[i]), 0, 0, 0, 0, 0, 0, 0]))),
  lambda a, e: xor(xor(a, e) >> 1, (xor(a, e) & 1) * 3988292384)), 4294967295) % 6 AS h FROM (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s FROM t)),
r AS (SELECT c.conv_id, 0 AS o, t.p, k, size FROM sums c JOIN t ON t.conv_id = c.head AND t.p < h UNION ALL SELECT c.conv_id, 1, t.p, k, size FROM sums c JOIN t ON t.conv_id = c.conv_id AND t.p >= h),
paths AS (SELECT c.conv_id, coalesce(string_agg(k, '' ORDER BY o, p), '') AS path, coalesce(list(size ORDER BY o, p) FILTER (WHERE size IS NOT NULL), []) AS sizes FROM sums c LEFT JOIN r USING (conv_id) GROUP BY 1),
m AS (SELECT conv_id, path, d, substr(path, 1, 32 * d) AS node, CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS size FROM (SELECT *, unnest(range(0, len(sizes) + 1)) AS d FROM paths)),
n AS (SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE path = node), '') AS ids FROM m GROUP BY node, d),
up AS (SELECT substr(node, 1, 32 * (d - 1)) AS node, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
own AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN up USING (node)),
sub AS (SELECT substr(node, 1, 32 * a) AS node, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * size) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM own) GROUP BY 1)
SELECT o.conv_id, CAST(o.d AS BIGINT) AS depth, q.conv_id AS parent_conv_id, o.n_convs, CAST(o.n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(o.ids) AS ends_sha256
FROM own o JOIN sub USING (node) LEFT JOIN own q ON o.d > 0 AND q.node = substr(o.node, 1, 32 * (o.d - 1))"""

ORACLES = {"op11_prefix_trie": OP11, "op5_decontamination": OP5, "op7_ngram_join": OP7, "op9_suffix_dedup": OP9}
