"""SQL counterparts of the queries that SQL can express.

Learned models, compressed sizes, edit distances, segmentations, DOM trees and the spans that checksums add are
beyond it; tests hold those queries against brute force.
"""

from __future__ import annotations

import string

WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_LOWER = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

ORACLE: dict[str, str] = {}

ORACLE["op2_mix_sources"] = f"""WITH RECURSIVE
sized AS (
  SELECT doc_id, source, coalesce(len({WORDS.format('text')}), 0)::BIGINT AS size,
         ('0x' || substr(md5(concat_ws('|', 'mix-1', coalesce(doc_id::VARCHAR, ''), coalesce(text, ''))), 1, 15))::BIGINT AS key
  FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT source, source_size, 3.0::DOUBLE * source_size AS most,
         ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM sums),
level AS (
  SELECT 0::DOUBLE AS level
  UNION ALL
  SELECT next FROM (
    SELECT level, (sum(source_size)::DOUBLE - coalesce(sum(most) FILTER (most <= level * weight), 0))
             / sum(weight) FILTER (most > level * weight) AS next
    FROM level, ranked GROUP BY level)
  WHERE next > level),
targets AS (SELECT source, source_size, least(most, (SELECT max(level) FROM level) * weight) AS target FROM ranked),
placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM sized),
joined AS (
  SELECT doc_id, size, source_size, target, p.source, before, least(floor(target + 0.5)::BIGINT, 3 * source_size) AS budget
  FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, source,
       (CASE WHEN source_size > 0 THEN budget // source_size * size + greatest(0, least(size, budget % source_size - before))
             ELSE 0 END)::BIGINT AS taken
FROM joined"""

ORACLE["op3_top_k"] = """WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM scores QUALIFY rank <= 5"""

ORACLE["op4_near_dedup"] = f"""WITH RECURSIVE
split AS (SELECT doc_id, coalesce({WORDS.format(_LOWER)}, []) AS w FROM documents),
places AS (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM split WHERE len(w) > 0),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM places),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id
  GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id
  WHERE 100 * shared.n >= 75 * (x.n + y.n - shared.n)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
  SELECT doc_id, doc_id AS other FROM split
  UNION
  SELECT r.doc_id, e.b FROM reached r JOIN edges e ON r.other = e.a)
SELECT r.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(other) AS component_id, r.doc_id = min(other) AS kept
FROM reached r LEFT JOIN sizes USING (doc_id) GROUP BY r.doc_id"""

_TERMS = rf"coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), [])"

ORACLE["op13_ranked_search"] = f"""WITH
texts AS (SELECT row_number() OVER () AS place, doc_id, {_TERMS} AS terms FROM documents),
lengths AS (SELECT place, doc_id, len(terms)::BIGINT AS n FROM texts WHERE len(terms) > 0),
corpus AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM lengths),
items AS (SELECT row_number() OVER () AS item, item_id, {_TERMS} AS terms FROM benchmark),
asked AS (
  SELECT item, term, count(*)::BIGINT AS repeats FROM (SELECT item, unnest(terms) AS term FROM items) GROUP BY ALL),
held AS (
  SELECT place, term, count(*)::BIGINT AS tf FROM (SELECT place, unnest(terms) AS term FROM texts)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1)))::BIGINT AS w
  FROM held, corpus GROUP BY term),
factors AS (SELECT place, doc_id, 100 - 25 + (25 * n * big_n) // big_l AS m FROM lengths, corpus),
scores AS (
  SELECT item, doc_id, place, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM asked JOIN held USING (term) JOIN weights USING (term) JOIN factors USING (place)
  GROUP BY ALL),
ranked AS (
  SELECT item, doc_id, score,
         (row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST))::INTEGER AS rank
  FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked JOIN items USING (item) WHERE rank <= 20"""
