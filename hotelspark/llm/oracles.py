"""DuckDB SQL for the queries that SQL can express, over the same tables."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"

ORACLES = {
    "op6_spherical_caps": """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
g AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS u, b.vec_id AS v FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT u AS vec_id, v AS other FROM p UNION SELECT r.vec_id, p.v FROM reach r JOIN p ON p.u = r.other),
c AS (SELECT vec_id, min(other) AS low FROM reach GROUP BY vec_id), n AS (SELECT u AS vec_id, count(*) AS n FROM p GROUP BY u)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(v.vec_id, coalesce(c.low, v.vec_id)) AS component_id,
  v.vec_id = least(v.vec_id, coalesce(c.low, v.vec_id)) AS kept
FROM v LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)""",
    "op7_columnwise_suffixes": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
o AS (SELECT doc_id, base, len(h) // 2 AS n, substring(h, 2 * base + 1, 1310) AS part FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2, 256)) AS base FROM d)),
q AS (SELECT doc_id, base + j AS i, n, part, j FROM (SELECT *, unnest(range(0, least(256, n - base))) AS j FROM o)),
s AS (SELECT doc_id, i, md5(substring(part, 2 * j + 1, 800)) AS w FROM q WHERE i + 400 <= n),
r AS (SELECT w FROM s GROUP BY w HAVING count(*) > 1),
b AS (SELECT doc_id, i, substring(part, 2 * j + 1, 2) AS x FROM q),
m AS (SELECT b.doc_id, b.i, b.x, coalesce(max(f.i) OVER (PARTITION BY b.doc_id ORDER BY b.i ROWS UNBOUNDED PRECEDING), -400) > b.i - 400 AS gone
  FROM b LEFT JOIN (SELECT s.doc_id, s.i FROM s JOIN r USING (w)) f ON f.doc_id = b.doc_id AND f.i = b.i),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), FALSE) AS opens FROM m),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, string_agg(x, '' ORDER BY i) FILTER (NOT gone) AS kept FROM e GROUP BY doc_id)
SELECT d.doc_id, (len(d.h) // 2)::BIGINT AS n_bytes, coalesce(k.n_removed, 0)::BIGINT AS n_removed, coalesce(k.n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(k.kept, ''))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
    "op9_fixed_block_anchors": f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
s AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY x) AS low FROM s) WHERE low < doc_id),
b AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
m AS (SELECT b.doc_id, b.i, b.word, coalesce(max(f.i) OVER (PARTITION BY b.doc_id ORDER BY b.i ROWS UNBOUNDED PRECEDING), -12) > b.i - 13 AS gone
  FROM b LEFT JOIN f ON f.doc_id = b.doc_id AND f.i = b.i),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)""",
    "op10_prefix_sum_mixing": f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::BIGINT AS size, md5('0|' || doc_id) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM s),
w AS (SELECT *, [3, 1, 2][(rank % 3 + 1)::INT]::BIGINT AS weight FROM r),
l AS (SELECT *, 2::DOUBLE * source_size / weight AS level FROM w),
c AS (SELECT *, sum(source_size) OVER o AS size_to, sum(weight) OVER o AS weight_to FROM l WINDOW o AS (ORDER BY level, rank ROWS UNBOUNDED PRECEDING)),
t AS (SELECT sum(source_size)::DOUBLE AS all_size, sum(weight) AS all_weight FROM w),
f AS (SELECT c.*, t.*, 2::DOUBLE * size_to + level * (all_weight - weight_to)::DOUBLE <= 1.5::DOUBLE * all_size AS filled FROM c, t),
u AS (SELECT coalesce(sum(source_size) FILTER (filled), 0)::DOUBLE AS used_size, coalesce(sum(weight) FILTER (filled), 0) AS used_weight FROM f),
g AS (SELECT source, source_size, CASE WHEN filled THEN 2::DOUBLE * source_size
  ELSE least((1.5::DOUBLE * all_size - 2::DOUBLE * used_size) / (all_weight - used_weight)::DOUBLE * weight, 2::DOUBLE * source_size) END AS target FROM f, u),
x AS (SELECT d.*, g.source_size, g.target, floor(g.target + 0.5)::BIGINT AS budget,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN g ON g.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size * size
  + greatest(0, least(size, budget - budget // source_size * source_size - before)) END::BIGINT AS taken FROM x""",
}
