"""SQL of the searches, by plain means: all pairs of a label, all shared shingles, all windows, halves of lines.

Independent of how the operators find their rows, and meant for the small tables of a comparison.
"""

from __future__ import annotations

#: Every vector against all of its label; reachable rows by recursion.
OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
c AS (SELECT a, min(b) AS component FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, coalesce(c.component, e.vec_id) AS component_id, coalesce(c.component, e.vec_id) IS NOT DISTINCT FROM e.vec_id AS kept
FROM embeddings AS e LEFT JOIN n ON e.vec_id = n.a LEFT JOIN c ON e.vec_id = c.a
"""

#: Shared shingles of every two different sets, counted by a join on the shingle.
OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\t\n\x0B\f\r ]+'), lambda x: x <> '') AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) BETWEEN 1 AND 4 THEN [array_to_string(w, ' ')]
                                      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
t AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS mark FROM g GROUP BY doc_id),
k AS (SELECT mark, min(doc_id) AS rep, any_value(n) AS n, count(*) AS size FROM t GROUP BY mark),
m AS (SELECT k.rep, k.n, k.size, hash(g.s) AS s FROM k JOIN g ON g.doc_id = k.rep),
p AS (
  SELECT a.rep AS a, b.rep AS b, any_value(b.size) AS size FROM m AS a JOIN m AS b ON a.s = b.s AND a.rep <> b.rep AND 10 * a.n >= 8 * b.n AND 10 * b.n >= 8 * a.n
  GROUP BY a.rep, b.rep HAVING 10 * count(*) >= 8 * (any_value(a.n) + any_value(b.n) - count(*))),
reach(a, b) AS (SELECT rep, rep FROM k UNION SELECT reach.a, p.b FROM reach JOIN p ON reach.b = p.a),
c AS (SELECT a, min(b) AS component FROM reach GROUP BY a),
l AS (SELECT a, sum(size) AS links FROM p GROUP BY a)
SELECT d.doc_id, CAST(coalesce(t.n, 0) AS INTEGER) AS n_shingles, coalesce(k.rep, d.doc_id) AS class_id,
       CAST(coalesce(l.links, 0) + coalesce(k.size, 1) - 1 AS BIGINT) AS n_links,
       coalesce(c.component, d.doc_id) AS component_id, coalesce(c.component, d.doc_id) IS NOT DISTINCT FROM d.doc_id AS kept
FROM documents AS d LEFT JOIN t ON d.doc_id = t.doc_id LEFT JOIN k ON t.mark = k.mark LEFT JOIN c ON k.rep = c.a LEFT JOIN l ON k.rep = l.a
"""

#: Every string of 100 bytes; all but the first of equal ones are covers.
OP6_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS i FROM d),
w AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 200)) AS w FROM s),
r AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, i) > 1),
e AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS begins FROM r),
n AS (SELECT doc_id, i, sum(begins) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM e),
c AS (SELECT doc_id, min(i) AS low, max(i) + 100 AS high FROM n GROUP BY doc_id, span),
b AS (SELECT doc_id, low, high, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 0) AS before FROM c),
k AS (
  SELECT b.doc_id, count(*) AS n_spans, sum(high - low) AS n_removed,
         string_agg(substr(h, 2 * before + 1, 2 * (low - before)), '' ORDER BY low) || any_value(h)[2 * max(high) + 1:] AS kept
  FROM b JOIN d ON b.doc_id = d.doc_id GROUP BY b.doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(from_hex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""

#: Lines within one edit share a half of the shorter one; x and y then part at one place only.
OP9_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS nr FROM documents),
o AS (SELECT *, regexp_matches(line, '[^\t\n\x0B\f\r\x1c-\x1f\x{85}\pZ]') AS ink, row_number() OVER (ORDER BY doc_id NULLS FIRST, nr) AS place FROM l),
f AS (SELECT line, min(place) AS place, length(line) AS n FROM o WHERE ink GROUP BY line),
z AS (SELECT *, unnest([n, n - 1]) AS size FROM f),
h AS (SELECT line, place, n, size, 0 AS side, hash(left(line, size // 2)) AS half FROM z
      UNION ALL SELECT line, place, n, size, 1, hash(right(line, size - size // 2)) FROM z),
p AS (SELECT DISTINCT a.line AS x, b.line AS y, a.n AS n, b.n AS m FROM h AS a JOIN h AS b
      ON a.side = b.side AND a.size = b.size AND a.half = b.half AND b.place < a.place AND least(a.n, b.n) = a.size),
q AS (SELECT DISTINCT x FROM p WHERE len(list_filter(range(0, greatest(n, m)), lambda i: left(x, i) = left(y, i)
      AND substr(x, i + 1 + CAST(n >= m AS INTEGER)) = substr(y, i + 1 + CAST(m >= n AS INTEGER)))) > 0),
s AS (SELECT o.*, NOT ink OR (o.place = f.place AND q.x IS NULL) AS stays FROM o LEFT JOIN f ON o.line = f.line LEFT JOIN q ON o.line = q.x)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (NOT stays) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY nr) FILTER (stays), '')) AS kept_sha256
FROM s GROUP BY doc_id
"""
