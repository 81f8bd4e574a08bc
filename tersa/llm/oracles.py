"""DuckDB SQL for the queries of this subpackage that SQL can express.

Encoding, learned models and packing are beyond SQL; their tests compare them
with brute force, a round trip or held-out labels.
"""

from __future__ import annotations

SEARCH = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w
  FROM documents WHERE doc_id IS NOT NULL),
tf AS (SELECT doc_id, w, count(*)::DOUBLE AS tf FROM words GROUP BY ALL),
len AS (
  SELECT d.doc_id, count(w.w)::DOUBLE AS dl FROM documents d LEFT JOIN words w USING (doc_id)
  WHERE d.doc_id IS NOT NULL GROUP BY d.doc_id),
total AS (SELECT count(*)::DOUBLE AS n, sum(dl) / count(*) AS avgdl FROM len),
df AS (SELECT w, count(*)::DOUBLE AS df FROM tf GROUP BY w),
hit AS (
  SELECT q.doc_id AS query_id, t.doc_id, sum(
    ln(1 + (n - df + 0.5) / (df + 0.5)) * t.tf * 2.2
    / (t.tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS s
  FROM tf q JOIN tf t USING (w) JOIN df USING (w) JOIN len ON len.doc_id = t.doc_id, total
  WHERE q.doc_id % 100 = 0 AND q.doc_id <> t.doc_id GROUP BY q.doc_id, t.doc_id),
ranked AS (
  SELECT query_id, doc_id, s, row_number() OVER (
    PARTITION BY query_id ORDER BY round(s, 9) DESC, doc_id) AS rank FROM hit)
SELECT query_id, rank::INTEGER AS rank, doc_id, round(s, 6) AS score FROM ranked WHERE rank <= 10
"""

AUDIT = r"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
words AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM texts),
told AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
smallest AS (SELECT t, min(doc_id) AS least FROM texts GROUP BY t),
failures AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(w) < 100 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS f
  FROM words JOIN smallest USING (t) LEFT JOIN told USING (doc_id)),
masks AS (
  SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM failures GROUP BY part, f),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, unnest([1, 2, 3, 4, 5])::INTEGER AS step FROM orders),
parts AS (SELECT DISTINCT part FROM texts),
plain AS (
  SELECT p.part, filter_order, step, filter_order[step] AS x,
    sum(CASE WHEN length(translate(f, filter_order[1:step], '')) = length(f) THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN contains(f, filter_order[step]) AND length(translate(f, filter_order[1:step - 1], ''))
      = length(f) THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN contains(f, filter_order[step]) AND length(translate(f, filter_order[1:step - 1], ''))
      < length(f) THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN f = filter_order[step] THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN contains(f, filter_order[step]) AND length(translate(f, filter_order[1:step - 1], ''))
      = length(f) THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN contains(f, filter_order[step]) AND length(translate(f, filter_order[1:step - 1], ''))
      = length(f) THEN toxic ELSE 0 END) AS toxic_lost
  FROM parts p JOIN masks m ON m.part = p.part, steps GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed,
  redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley
FROM plain
"""

CODES = """
WITH fit AS (
  SELECT vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(
    [x for x in embedding if x IS NULL OR NOT isfinite(x) OR abs(x) > 1e14]) = 0),
usual AS (
  SELECT len(embedding) AS n FROM fit GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, embedding,
    (n + 7) // 8 AS width
  FROM fit JOIN usual ON len(embedding) = n),
cells AS MATERIALIZED (
  SELECT r, p, i, coalesce(floor(4096 * embedding[p * width + i + 1]::DOUBLE), 0)::BIGINT AS x
  FROM (SELECT r, embedding, width, p, unnest(range(width)) AS i
    FROM (SELECT *, unnest(range(8)) AS p FROM kept))),
book0 AS MATERIALIZED (SELECT p, r - 1 AS e, i, x FROM cells WHERE r <= 16),
""" + "".join(f"""
near{k} AS MATERIALIZED (
  SELECT r, p, min(d * 16 + e) % 16 AS e, min(d * 16 + e) // 16 AS d
  FROM (SELECT c.r, c.p, b.e, sum((c.x - b.x) * (c.x - b.x))::BIGINT AS d
    FROM cells c JOIN book{k} b ON c.p = b.p AND c.i = b.i GROUP BY ALL) GROUP BY ALL),
""" + (f"""
book{k + 1} AS MATERIALIZED (
  SELECT b.p, b.e, b.i, coalesce(m.x, b.x) AS x
  FROM book{k} b LEFT JOIN (
    SELECT n.p, n.e, c.i, floor(sum(c.x)::DOUBLE / count(*))::BIGINT AS x
    FROM near{k} n JOIN cells c ON c.r = n.r AND c.p = n.p GROUP BY ALL) m
  ON m.p = b.p AND m.e = b.e AND m.i = b.i),
""" if k < 6 else "") for k in range(7)) + """
coded AS (
  SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error
  FROM near6 GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, i)) FROM book6) AS codebooks_sha256
FROM coded JOIN kept USING (r)
"""

ORACLES: dict[str, str] = {"op8_topk_search": SEARCH, "op11_vector_codes": CODES,
                           "op12_filter_audit": AUDIT}
