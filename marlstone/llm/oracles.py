"""DuckDB SQL that gives what the corpus queries give."""

MIX_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS s, coalesce(doc_id::VARCHAR, '') AS i,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS t FROM documents
), tot AS (SELECT s, sum(t)::BIGINT AS tokens, count(*) AS n FROM d GROUP BY s),
sh AS (SELECT s, ln(tokens::DOUBLE / (SELECT sum(tokens) FROM tot)::DOUBLE) AS lp FROM tot WHERE tokens > 0),
l AS (SELECT list(lp) AS ps FROM sh),
goal AS (SELECT ps, -list_sum(list_transform(ps, lambda x: exp(x) * x)) + 0.5 * (ln(len(ps)) + list_sum(list_transform(ps, lambda x: exp(x) * x))) AS h FROM l),
high AS (  -- the largest exponent lo / 2**30 with at least that entropy; hi fails
  SELECT 0 AS step, 0::BIGINT AS lo, (1::BIGINT << 30) + 1 AS hi
  UNION ALL
  SELECT step + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END FROM (
    SELECT step, lo, hi, (lo + hi) // 2 AS mid, ln(list_sum(list_transform(ps, lambda x: exp(x * ((lo + hi) // 2) / (1 << 30)))))
      - list_sum(list_transform(ps, lambda x: exp(x * ((lo + hi) // 2) / (1 << 30)) * x * ((lo + hi) // 2) / (1 << 30)))
      / list_sum(list_transform(ps, lambda x: exp(x * ((lo + hi) // 2) / (1 << 30)))) >= h - 1e-12 AS ok FROM high, goal WHERE hi - lo > 1)
), low AS (  -- the smallest exponent hi / 2**30 within two passes; lo fails
  SELECT 0 AS step, -1::BIGINT AS lo, (1::BIGINT << 30) AS hi
  UNION ALL
  SELECT step + 1, CASE WHEN ok THEN lo ELSE mid END, CASE WHEN ok THEN mid ELSE hi END FROM (
    SELECT step, lo, hi, (lo + hi) // 2 AS mid, exp(list_max(list_transform(ps, lambda x: x * ((lo + hi) // 2) / (1 << 30) - x))
      - list_min(list_transform(ps, lambda x: x * ((lo + hi) // 2) / (1 << 30) - x))) <= 2 + 1e-12 AS ok FROM low, goal WHERE hi - lo > 1)
), a AS (SELECT greatest((SELECT max(lo) FROM high), (SELECT min(hi) FROM low)) / (1 << 30) AS a),
p AS (
  SELECT tot.s, tokens, least(4096, ceil(n / 256.0))::BIGINT AS blocks,
         coalesce(exp(lp * a - lp - (SELECT min(lp * a - lp) FROM sh, a)), 1.0) AS passes
  FROM tot LEFT JOIN sh USING (s), a
), plan AS (
  SELECT s, blocks, floor(passes + 1e-9)::INT AS whole, greatest(0, floor((passes - floor(passes + 1e-9)) * tokens))::BIGINT AS rest FROM p
), r AS (
  SELECT d.*, whole, rest, ('0x' || substr(md5(i || '|block17'), 1, 12))::BIGINT % blocks AS b FROM d JOIN plan USING (s)
), bt AS (
  SELECT s, b, rest, sum(t) AS bt, md5(s || '|' || b || '|' || whole || '|17') AS k FROM r GROUP BY s, b, rest, whole
), bw AS (
  SELECT *, sum(bt) OVER (PARTITION BY s ORDER BY k, b ROWS UNBOUNDED PRECEDING) - bt AS before FROM bt
), lastp AS (
  SELECT r.*, before, before + bt > r.rest AS cut, before + sum(t) OVER (PARTITION BY r.s, r.b ORDER BY md5(i || '|' || whole || '|17'), i, t ROWS UNBOUNDED PRECEDING) - t AS upto
  FROM r JOIN bw ON r.s = bw.s AND r.b = bw.b WHERE before < r.rest
), every AS (
  SELECT doc_id, source, s, i, t, b, unnest(range(whole)) AS e FROM r WHERE whole > 0
  UNION ALL
  SELECT doc_id, source, s, i, t, b, whole FROM lastp WHERE NOT cut OR upto < rest
)
SELECT doc_id, source, e::BIGINT AS mix_pass, t AS n_tokens, b AS mix_block, md5(s || '|' || b || '|' || e || '|17') AS mix_block_key,
       md5(i || '|' || e || '|17') AS mix_row_key
FROM every
"""

CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, conv_id // 2 AS pair_id, conv_id % 2 = 0 AS chosen, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL
), p AS (
  SELECT pair_id, min(conv_id) FILTER (chosen) AS chosen_id, min(conv_id) FILTER (NOT chosen) AS rejected_id,
         least(max(k) FILTER (chosen), max(k) FILTER (NOT chosen)) AS shared
  FROM t GROUP BY pair_id HAVING count(*) FILTER (chosen) > 0 AND count(*) FILTER (NOT chosen) > 0
), u AS (
  SELECT c.pair_id, min(c.k) AS k FROM t c JOIN t r ON c.pair_id = r.pair_id AND c.k = r.k AND c.chosen AND NOT r.chosen
  WHERE c.role <> r.role OR c.text <> r.text GROUP BY c.pair_id
), n AS (SELECT p.*, coalesce(u.k - 1, shared) AS n_prompt_turns FROM p LEFT JOIN u USING (pair_id)
), s AS (
  SELECT n.pair_id, t.chosen, t.k, t.k <= n_prompt_turns AS prompt, role, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS piece,
         sum(CASE WHEN t.k > n_prompt_turns THEN length(role) + length(text) + 13 ELSE 0 END) OVER (PARTITION BY t.conv_id ORDER BY t.k) AS done, length(text) AS m
  FROM n JOIN t USING (pair_id)
)
SELECT n.pair_id, chosen_id, rejected_id, n_prompt_turns,
       coalesce(string_agg(piece, '' ORDER BY k) FILTER (prompt AND chosen), '') AS prompt,
       coalesce(string_agg(piece, '' ORDER BY k) FILTER (NOT prompt AND chosen), '') AS chosen,
       coalesce(string_agg(piece, '' ORDER BY k) FILTER (NOT prompt AND NOT chosen), '') AS rejected,
       coalesce(string_agg((done - 8 - m)::BIGINT || ':' || (done - 1)::BIGINT, ',' ORDER BY k) FILTER (NOT prompt AND chosen AND role = 'assistant'), '') AS chosen_spans,
       coalesce(string_agg((done - 8 - m)::BIGINT || ':' || (done - 1)::BIGINT, ',' ORDER BY k) FILTER (NOT prompt AND NOT chosen AND role = 'assistant'), '') AS rejected_spans
FROM n JOIN s USING (pair_id) GROUP BY n.pair_id, chosen_id, rejected_id, n_prompt_turns
"""

TOPK_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
