"""SQL for the queries that SQL can express."""

_P2 = r"""WITH hits AS (
  SELECT search_id, document_id, regexp_replace(lower(trim(method)), '[\s_\-]+', '', 'g') AS m, max(score) AS s
  FROM search_hits WHERE score IS NOT NULL AND NOT isnan(score) AND search_id IS NOT NULL AND document_id IS NOT NULL AND method IS NOT NULL GROUP BY ALL
), pct AS (SELECT *, cume_dist() OVER (PARTITION BY search_id, m ORDER BY s) AS p FROM hits),
per AS (SELECT search_id, document_id, list_sort(list(p)) AS v FROM pct GROUP BY ALL),
n AS (SELECT search_id, count(DISTINCT m) AS n FROM hits GROUP BY ALL),
vec AS (SELECT search_id, document_id, list_concat(list_transform(range(n - len(v)), lambda x: 0.0::DOUBLE), v) AS vector FROM per JOIN n USING (search_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY vector DESC, document_id) AS place FROM vec)"""

_P5 = """WITH cur AS (
  SELECT id, usetype, content FROM (SELECT id, usetype, content, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, usetype DESC NULLS LAST, content DESC NULLS LAST) AS rn FROM nodes WHERE id IS NOT NULL) WHERE rn = 1
), last AS (SELECT document_id, max(token_idx) AS t FROM token_embeddings GROUP BY 1),
lim AS (SELECT cur.*, coalesce(l.max_chars, o.max_chars) AS max_chars, coalesce(l.max_tokens, o.max_tokens) AS max_tokens
  FROM cur LEFT JOIN chunk_limits l ON l.usetype = cur.usetype AND l.usetype <> '*' JOIN chunk_limits o ON o.usetype = '*')"""

_P6 = """WITH once AS (
  SELECT index_id, document_id, term, max(term_freq) AS f FROM search_term_postings WHERE document_id IS NOT NULL AND term IS NOT NULL AND term_freq > 0 GROUP BY ALL
), k AS (SELECT document_id, lower(term) AS term, sum(f)::BIGINT AS k FROM once GROUP BY ALL),
tot AS (SELECT sum(k)::BIGINT AS total FROM k),
terms AS (SELECT term, sum(k)::BIGINT AS k_all, count(*) AS df FROM k GROUP BY 1 HAVING count(*) >= 2),
sizes AS (SELECT document_id, sum(k)::BIGINT AS n FROM k GROUP BY 1),
x AS (SELECT document_id, term, k, df, k_all, n, total FROM k JOIN terms USING (term) JOIN sizes USING (document_id), tot),
lead AS (SELECT *, greatest(n, k_all) AS hi, least(n, k_all) AS lo FROM x),
zero AS (SELECT *, list_sum(list_transform(range(0, lo), lambda i: ln((total - hi - i)::DOUBLE / (total - i)))) AS p0, list_transform(range(0, lo), lambda i: ln((k_all - i)::DOUBLE * (n - i) / ((i + 1)::DOUBLE * (total - k_all - n + i + 1)))) AS steps FROM lead),
logs AS (SELECT *, list_transform(range(k, lo + 1), lambda j: p0 + list_sum(steps[1 : j])) AS l FROM zero),
raws AS (SELECT document_id, term, k, df, greatest(-(list_max(l) + ln(list_sum(list_transform(l, lambda y: exp(y - list_max(l)))))), 0.0) AS raw FROM logs),
"""

_P6_FOUND = (
    _P6
    + """best AS (SELECT document_id, term, row_number() OVER (PARTITION BY document_id ORDER BY round(raw, 7) DESC, df, term) AS rn FROM raws WHERE document_id IN (SELECT document_id FROM probe_documents))
SELECT document_id, term FROM best WHERE rn = 1"""
)

_P6_SCORES = (
    _P6
    + """ranked AS (SELECT *, rank() OVER (PARTITION BY document_id ORDER BY round(raw, 9) DESC) + count(*) OVER (PARTITION BY document_id, round(raw, 9)) - 1 AS place, count(*) OVER (PARTITION BY document_id) AS m FROM raws),
adj AS (SELECT *, max(raw - ln(m / place)) OVER (PARTITION BY document_id ORDER BY place DESC) AS s FROM ranked)
SELECT document_id, term, k AS freq, df, round(raw, 5) AS raw, round(greatest(least(s, raw), 0.0), 5) AS score FROM adj"""
)

_P3 = r"""WITH cur AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY column_id ORDER BY profiled_at DESC) AS rn FROM sheet_columns) WHERE rn = 1
), raw AS (SELECT column_id, trim(regexp_replace(lower(unnest(column_values)), '\s+', ' ', 'g')) AS v FROM cur WHERE column_values IS NOT NULL),
c1 AS (SELECT column_id, CASE WHEN regexp_full_match(v, '[+-]?\d{1,3}(,\d{3})+(\.\d+)?') THEN replace(v, ',', '') ELSE v END AS v FROM raw WHERE v <> ''),
vals AS (SELECT DISTINCT column_id, CASE WHEN regexp_full_match(v, '[+-]?\d+\.0+') THEN regexp_replace(v, '\.0+$', '') ELSE v END AS v FROM c1),
sizes AS (SELECT column_id, count(*) AS n FROM vals GROUP BY 1 HAVING count(*) >= 8),
big AS (SELECT vals.* FROM vals JOIN sizes USING (column_id)),
shared AS (SELECT a.column_id AS ia, b.column_id AS ib, count(*) AS c FROM big a JOIN big b ON a.v = b.v AND a.column_id < b.column_id GROUP BY ALL),
sk AS (SELECT column_id, sketch_num_perm AS np, sketch_seed AS seed, unnest(sketch) AS v, generate_subscripts(sketch, 1) AS i FROM cur WHERE column_values IS NULL AND sketch IS NOT NULL AND sketch_count >= 8),
skp AS (SELECT a.column_id AS ia, b.column_id AS ib FROM sk a JOIN sk b ON a.np = b.np AND a.seed = b.seed AND a.i = b.i AND a.v = b.v AND a.column_id < b.column_id GROUP BY a.column_id, b.column_id, a.np HAVING count(*) >= 0.7 * a.np)
SELECT ia AS column_id_a, ib AS column_id_b FROM shared JOIN sizes x ON x.column_id = ia JOIN sizes y ON y.column_id = ib WHERE c >= 0.7 * (x.n + y.n - c)
UNION ALL SELECT ia, ib FROM skp"""

ORACLE = {
    "p3_found": _P3,
    "p2_ranking": f"{_P2} SELECT search_id, document_id, vector, place FROM ranked",
    "p2_found": f"{_P2} SELECT search_id, document_id FROM ranked WHERE place = 1",
    "p5_found": f"{_P5} SELECT id FROM lim LEFT JOIN last ON last.document_id = lim.id WHERE length(content) > max_chars OR t >= max_tokens",
    "p8_report": "SELECT 0 AS over, 0 AS split, 0 AS overlapping, count(DISTINCT doc_id) AS documents FROM documents",
    "p6_found": _P6_FOUND,
    "p6_scores": _P6_SCORES,
}
