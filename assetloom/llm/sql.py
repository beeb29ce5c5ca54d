"""The operators' queries in SQL for DuckDB, where SQL can say them on whole tables."""

_FINITE = "embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: coalesce(isnan(x) OR isinf(x), true)))"

OP1 = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings WHERE {_FINITE}),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s) WHERE rank <= 10
"""

OP10 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
u AS (SELECT doc_id, unnest(s) AS x FROM s),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON e.a = r.b)
SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, coalesce(min(r.b), n.doc_id)) AS component_id FROM n LEFT JOIN reach r ON r.a = n.doc_id GROUP BY n.doc_id, n.n
"""

_USABLE = f"{_FINITE} AND list_bool_or(list_transform(embedding, lambda x: x <> 0)) AND label IS NOT NULL"

OP11 = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE {_USABLE}),
edge AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON e.a = r.b)
SELECT vec_id, n_links, component_id, vec_id = component_id AS kept
FROM (SELECT t.vec_id, (SELECT count(*) FROM edge WHERE a = t.vec_id)::BIGINT AS n_links, least(t.vec_id, coalesce((SELECT min(b) FROM reach WHERE a = t.vec_id), t.vec_id))::BIGINT AS component_id FROM embeddings t)
"""

OP12 = r"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
first AS (SELECT t, min(doc_id) AS least FROM w GROUP BY t),
said AS (SELECT doc_id, max(coalesce(quality = 1, false)::INTEGER) AS good, max(coalesce(toxic = 1, false)::INTEGER) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, (len(w) < 200)::INTEGER + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INTEGER + 4 * (100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * len(t))::INTEGER
        + 8 * regexp_matches(t, '[#$%&*|]')::INTEGER + 16 * coalesce(doc_id > least, false)::INTEGER AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
      FROM w JOIN first USING (t) LEFT JOIN said USING (doc_id)),
cell AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
f AS (SELECT unnest(range(5)) AS f),
o AS (SELECT a.f AS a, b.f AS b, c.f AS c, d.f AS d, e.f AS e FROM f a JOIN f b ON b.f <> a.f JOIN f c ON c.f NOT IN (a.f, b.f) JOIN f d ON d.f NOT IN (a.f, b.f, c.f) JOIN f e ON e.f NOT IN (a.f, b.f, c.f, d.f)),
s AS (SELECT array_to_string(list_transform([a, b, c, d, e], lambda x: chr((65 + x)::INTEGER)), '') AS filter_order, i::INTEGER AS step, [a, b, c, d, e][i] AS f,
        coalesce(list_sum(list_transform([a, b, c, d, e][1 : i - 1], lambda x: (1 << x))), 0)::BIGINT AS before FROM o, unnest(range(1, 6)) AS u(i)),
r AS (SELECT part, filter_order, step, f, sum(CASE WHEN (mask >> f) & 1 = 1 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN (mask >> f) & 1 = 1 THEN n ELSE 0 END) AS fails, sum(CASE WHEN mask & (before | (1 << f)) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask = 1 << f THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN (mask >> f) & 1 = 1 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN (mask >> f) & 1 = 1 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
      FROM cell, s GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, (fails - removed)::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM r
"""
