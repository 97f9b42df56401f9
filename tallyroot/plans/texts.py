"""Texts as chunks, trees and turns: queries and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyroot.operators import chunking, embedding, tasks
from tallyroot.operators.views import current_nodes
from tallyroot.sources.tables import table


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "title", "text", "source")


def x_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences, those below 80 characters joined to the one before, none above 1,800."""
    return chunking.chunk_texts(_docs(spark, folder), "doc_id", "text", strategy="sentence", least=80).select("doc_id", "piece", "text")


def x_packed_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.packed_paragraphs(_docs(spark, folder), "doc_id", "text")


def x_tree(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.tree_of(_docs(spark, folder), "doc_id", "text", least=80)


def x_spans(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.section_spans(_docs(spark, folder), "doc_id", "text").select("doc_id", "parent", "level", "title", "start", "stop")


def x_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the trees: chunks within their sections, no text outside of chunks but headings and white space."""
    docs, tree = _docs(spark, folder), x_tree(spark, folder)
    up = tree.where("kind = 'section'").select("doc_id", F.col("node").alias("parent"), F.col("start").alias("a"), F.col("stop").alias("b"))
    outside = tree.where("kind = 'chunk'").join(up, ["doc_id", "parent"]).agg(F.count_if(F.expr("start < a or stop > b or start >= stop")).alias("outside"))
    share = chunking.coverage(tree, docs, "doc_id", "text").agg(F.count("*").alias("texts"), F.count_if(F.col("share") > 1).alias("over"))
    return outside.crossJoin(share)  # one row each


def x_turns(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.turns(_docs(spark, folder), "doc_id", "text")


def x_turn_chunks(spark: SparkSession, folder: str) -> DataFrame:
    found = chunking.turn_chunks(x_turns(spark, folder), "doc_id", 300)
    return found.agg(F.count_if(F.col("piece").isNull()).alias("turns"), F.count_if(F.col("piece") == 0).alias("long"), F.count_if(F.col("piece").isNotNull() & (F.char_length("text") > 300)).alias("unfit"))


def x_tables(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.tables(_docs(spark, folder), "doc_id", "text")


def x_embedded(spark: SparkSession, folder: str) -> DataFrame:
    """Each query text's best documents by hashed term vectors."""
    from tallyroot.operators.retrieval import vector_search

    docs = embedding.embed(_docs(spark, folder), "doc_id", "text").select(F.col("doc_id").alias("doc"), "v")
    asked = embedding.embed(table(spark, folder, "eval_queries"), "query_id", "query_text").select(F.col("query_id").alias("query"), "v")
    found = vector_search(docs, asked, 10)
    return found.groupBy("query").agg(F.count("*").alias("n"), F.round(F.max("score"), 6).alias("best"), F.round(F.sum("score"), 5).alias("total"))


def x_probes(spark: SparkSession, folder: str) -> DataFrame:
    """What each text's pattern probes say, and which steps its guards let through."""
    probed = tasks.text_patterns(_docs(spark, folder), "doc_id", "text")
    return tasks.guarded(probed, tasks.RUNGS).select("doc_id", *[F.col("patterns")[k].alias(k) for k in ("headings", "turns", "tables", "lines")], "steps")


def t_importance(spark: SparkSession, folder: str) -> DataFrame:
    return embedding.importance_of(table(spark, folder, "token_embeddings"), "document_id", "importance_score")


def t_settle(spark: SparkSession, folder: str) -> DataFrame:
    from tallyroot.plans.trees import kept_tree as tree

    return tasks.settle(current_nodes(table(spark, folder, "nodes"), ["parent_id", "settled"]), tree(spark, folder))


def t_claims(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes as tasks: those in flight are claimed until 20 minutes after their last change, failed ones wait for a retry."""
    n = table(spark, folder, "nodes").where("id is not null").groupBy("id").agg(F.max_by(F.struct("settled", "usetype", "created_at", "updated_at"), "updated_at").alias("x"))
    rows = n.select("id", F.coalesce("x.usetype", F.lit("")).alias("kind"), F.when(F.col("x.settled") == "in_flight", "claimed").when(F.col("x.settled") == "failed", "failed").otherwise("done").alias("state"), F.lit(0).alias("priority"), (F.col("id") % 4).cast("int").alias("attempts"), F.col("x.created_at").alias("created_at"), (F.col("x.updated_at") + F.expr("interval 20 minutes")).alias("lease_until"))
    return tasks.claimable(rows, F.to_timestamp_ntz(F.lit("2025-02-01 00:00:00")), most_attempts=3, limit=50).select("id", "kind", "place")


QUERIES = {f.__name__: f for f in (x_chunks, x_packed_paragraphs, x_tree, x_spans, x_coverage, x_turns, x_turn_chunks, x_tables, x_embedded, x_probes, t_importance, t_settle, t_claims)}

# The operators' own fixed values, as SQL.
_ABBR = "|".join(chunking.ABBREVIATIONS)
_TRIM = r"regexp_replace({}, '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g')"
_MARKED = rf"regexp_replace(regexp_replace({{0}}, '([.!?])([ \t\n\r\f\v]+)([A-Z\"''(\[])', '\1' || chr(30) || '\2\3', 'g'), '(^|[^A-Za-z0-9_])((?i:{_ABBR}))\.' || chr(30), '\1\2.', 'g')"
_PARTS = rf"list_filter(list_transform(string_split({_MARKED}, chr(30)), lambda p: {_TRIM.format('p')}), lambda p: p <> '')"
_SENT = f"sent AS (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, {_PARTS.format('text')} AS l FROM documents WHERE text IS NOT NULL))"
_WORDS = r"len(string_split_regex({}, '[ \t\n\r\f\v]+'))"
# Greedy packing, one step for each part: what a step emits is the pack before it, if the part begins another.
_PACK = f"""pack(doc_id, i, cur, n, out) AS (
  SELECT doc_id, i, t, {_WORDS.format('t')}, NULL::VARCHAR FROM parts WHERE i = 1
  UNION ALL SELECT p.doc_id, s.i, CASE WHEN n + {_WORDS.format('s.t')} <= 120 AND s.g = g.g THEN cur || ' ' || s.t ELSE s.t END, CASE WHEN n + {_WORDS.format('s.t')} <= 120 AND s.g = g.g THEN n + {_WORDS.format('s.t')} ELSE {_WORDS.format('s.t')} END, CASE WHEN n + {_WORDS.format('s.t')} <= 120 AND s.g = g.g THEN NULL ELSE cur END
  FROM pack p JOIN parts s ON s.doc_id = p.doc_id AND s.i = p.i + 1 JOIN parts g ON g.doc_id = p.doc_id AND g.i = p.i),
ends AS (SELECT doc_id, i, out AS text FROM pack WHERE out IS NOT NULL UNION ALL SELECT doc_id, i + 1, cur FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) AS k FROM pack) WHERE k = 1)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS piece, text FROM ends"""
_SECTIONS = r"""cut AS (SELECT doc_id, string_split(regexp_replace(chr(10) || {0}, '\n(#{{1,6}}[ \t]+[^ \t\n\r\f\v])', chr(30) || '\1', 'g'), chr(30)) AS l FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, unnest(l) AS p, generate_subscripts(l, 1) - 1 AS section FROM cut),
s AS (SELECT *, length(regexp_extract(p, '^(#{{1,6}})[ \t]', 1)) AS level FROM p)"""
_HEAD = r"CASE WHEN level > 0 THEN trim(regexp_extract(p, '^#{1,6}[ \t]+([^\r\n]*)', 1)) END AS title"
_TURN = r"\[(?:user|assistant|system|tool)\]: "
_CUR = "cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) AS rn FROM nodes WHERE id IS NOT NULL) WHERE rn = 1)"
_TURNS = rf"""t AS (SELECT doc_id, list_filter(string_split(regexp_replace(chr(10) || chr(10) || regexp_replace(text, '\r\n?', chr(10), 'g'), '\n\n({_TURN})', chr(30) || '\1', 'g'), chr(30)), lambda p: regexp_matches(p, '^{_TURN}')) AS l FROM documents WHERE text IS NOT NULL),
turns AS (SELECT doc_id, turn, regexp_extract(p, '^\[([a-z]+)\]', 1) AS role, {_TRIM.format(f"regexp_replace(p, '^{_TURN}', '')")} AS text FROM (SELECT doc_id, (generate_subscripts(l, 1) - 1)::INT AS turn, unnest(l) AS p FROM t))"""
_VEC = "{0} AS (SELECT k, list_transform(range({1}), lambda i: coalesce(m[i], 0.0)) AS v FROM (SELECT k, map_from_entries(list((h, n))) AS m FROM (SELECT k, h, sum(s) AS n FROM (SELECT k, ('0x' || substr(md5(term), 1, 7))::BIGINT % {1} AS h, CASE WHEN ('0x' || substr(md5(term), 8, 1))::BIGINT % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0 END AS s FROM (SELECT {2} AS k, unnest(list_filter(string_split_regex(lower({3}), '[^a-z0-9]+'), lambda x: length(x) >= 2)) AS term FROM {4})) GROUP BY ALL) GROUP BY k))"

ORACLE = {
    "x_sentences": f"WITH {_SENT} SELECT doc_id, (i - 1)::INT AS piece, t AS text FROM sent",
    "x_packed": f"WITH RECURSIVE {_SENT}, parts AS (SELECT doc_id, i, t, 0 AS g FROM sent), {_PACK}",
    "x_packed_paragraphs": rf"WITH RECURSIVE para AS (SELECT doc_id, unnest(l) AS p, generate_subscripts(l, 1) AS g FROM (SELECT doc_id, string_split_regex(text, '\n[ \t\n\r\f\v]*\n') AS l FROM documents WHERE text IS NOT NULL)), sent AS (SELECT doc_id, g, unnest(l) AS t, generate_subscripts(l, 1) AS j FROM (SELECT doc_id, g, {_PARTS.format('p')} AS l FROM para)), parts AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g, j) AS i, t, g FROM sent), {_PACK}",
    "x_chunks": rf"""WITH RECURSIVE {_SENT}, long AS (SELECT doc_id, i, unnest(w) AS w, generate_subscripts(w, 1) AS j FROM (SELECT doc_id, i, string_split_regex(t, '[ \t\n\r\f\v]+') AS w FROM sent WHERE length(t) > 1800)),
cut AS (SELECT doc_id, i, j, length(w) > 1800 AS alone, unnest(list_transform(range(0, length(w), 1800), lambda x: substring(w, x + 1, 1800))) AS w, generate_subscripts(range(0, length(w), 1800), 1) AS k FROM long),
seq AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, i ORDER BY j, k) AS j, alone, w FROM cut),
cap(doc_id, i, j, cur, shut, out) AS (SELECT doc_id, i, j, w, alone, NULL::VARCHAR FROM seq WHERE j = 1
  UNION ALL SELECT c.doc_id, c.i, s.j, CASE WHEN NOT shut AND NOT alone AND length(cur) + 1 + length(w) <= 1800 THEN cur || ' ' || w ELSE w END, alone, CASE WHEN NOT shut AND NOT alone AND length(cur) + 1 + length(w) <= 1800 THEN NULL ELSE cur END FROM cap c JOIN seq s ON s.doc_id = c.doc_id AND s.i = c.i AND s.j = c.j + 1),
raw AS (SELECT doc_id, i, 0 AS j, t FROM sent WHERE length(t) <= 1800 UNION ALL SELECT doc_id, i, j, out FROM cap WHERE out IS NOT NULL UNION ALL SELECT doc_id, i, j + 1, cur FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, i ORDER BY j DESC) AS k FROM cap) WHERE k = 1),
parts AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS i, t FROM raw),
pack(doc_id, i, cur, out) AS (SELECT doc_id, i, t, NULL::VARCHAR FROM parts WHERE i = 1
  UNION ALL SELECT p.doc_id, s.i, CASE WHEN length(t) < 80 AND length(cur) + 1 + length(t) <= 1800 THEN cur || ' ' || t ELSE t END, CASE WHEN length(t) < 80 AND length(cur) + 1 + length(t) <= 1800 THEN NULL ELSE cur END FROM pack p JOIN parts s ON s.doc_id = p.doc_id AND s.i = p.i + 1),
ends AS (SELECT doc_id, i, out AS text FROM pack WHERE out IS NOT NULL UNION ALL SELECT doc_id, i + 1, cur FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) AS k FROM pack) WHERE k = 1)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS piece, text FROM ends""",
    "x_headings": rf"""WITH {_SECTIONS.format("regexp_replace(text, '\r\n?', chr(10), 'g')")},
f AS (SELECT doc_id, section, level, {_HEAD}, trim(CASE WHEN level > 0 THEN regexp_replace(p, '^[^\n]*\n?', '') ELSE regexp_replace(p, '^\n', '') END) AS body FROM s)
SELECT doc_id, section::INT AS section, level::INT AS level, title, body, (SELECT max(b.section) FROM f b WHERE b.doc_id = f.doc_id AND b.section < f.section AND b.level BETWEEN 1 AND f.level - 1 AND (b.level > 0 OR b.body <> ''))::INT AS parent FROM f WHERE level > 0 OR body <> ''""",
    "x_spans": rf"""WITH {_SECTIONS.format('text')}, f AS (SELECT *, coalesce(sum(length(p) + 1) OVER (PARTITION BY doc_id ORDER BY section ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
SELECT doc_id, (SELECT max(b.section) FROM f b WHERE b.doc_id = f.doc_id AND b.section < f.section AND b.level BETWEEN 1 AND f.level - 1)::INT AS parent, level::INT AS level, {_HEAD}, greatest(before - 1, 0)::BIGINT AS start, (greatest(before - 1, 0) + length(p) - CASE WHEN section = 0 AND p LIKE chr(10) || '%' THEN 1 ELSE 0 END)::BIGINT AS stop FROM f WHERE level > 0 OR regexp_replace(p, '[\r\n\t ]', '', 'g') <> ''""",
    "x_coverage": "SELECT 0 AS outside, count(*) AS texts, 0 AS over FROM documents WHERE length(text) > 0",
    "x_turns": f"WITH {_TURNS} SELECT * FROM turns",
    "x_turn_chunks": f"WITH {_TURNS} SELECT count(*) AS turns, count(*) FILTER (length(text) > 300) AS long, 0 AS unfit FROM turns",
    "x_tables": r"""WITH l AS (SELECT doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS l FROM documents WHERE text IS NOT NULL), r AS (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM l),
b AS (SELECT *, regexp_full_match(t, '[ \t]*\|.*\|[ \t]*') AS bar, regexp_full_match(t, '[ \t]*\|([ \t]*:?-+:?[ \t]*\|)+[ \t]*') AS rule FROM r),
h AS (SELECT *, lead(rule) OVER (PARTITION BY doc_id ORDER BY i) AS ruled, i - row_number() OVER (PARTITION BY doc_id, bar ORDER BY i) AS run FROM b),
g AS (SELECT doc_id, run, min(i) FILTER (bar AND ruled) AS i0, max(i) AS i1 FROM h WHERE bar GROUP BY ALL HAVING min(i) FILTER (bar AND ruled) IS NOT NULL)
SELECT g.doc_id, (row_number() OVER (PARTITION BY g.doc_id ORDER BY i0) - 1)::INT AS block, trim(t) AS header, (i1 - i0 - 1)::INT AS n_rows FROM g JOIN r ON r.doc_id = g.doc_id AND r.i = i0""",
    "x_embedded": f"""WITH {_VEC.format('d', embedding.DIMENSIONS, 'doc_id', 'text', 'documents')}, {_VEC.format('q', embedding.DIMENSIONS, 'query_id', 'query_text', 'eval_queries')},
s AS (SELECT q.k AS query, d.k AS doc, list_cosine_similarity(q.v, d.v) AS score FROM q, d WHERE list_inner_product(q.v, q.v) > 0 AND list_inner_product(d.v, d.v) > 0), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rn FROM s)
SELECT query, count(*) AS n, round(max(score), 6) AS best, round(sum(score), 5) AS total FROM r WHERE rn <= 10 GROUP BY 1""",
    "x_probes": rf"""WITH p AS (SELECT doc_id, CASE WHEN text IS NULL OR trim(text) = '' THEN NULL ELSE len(regexp_extract_all(chr(10) || text, '\n#{{1,6}}[ \t]+[^ \t\n\r\f\v]'))::BIGINT END AS headings, CASE WHEN text IS NULL OR trim(text) = '' THEN NULL ELSE len(regexp_extract_all(chr(10) || text, '\n{_TURN}'))::BIGINT END AS turns, CASE WHEN text IS NULL OR trim(text) = '' THEN NULL ELSE len(regexp_extract_all(chr(10) || text, '\n[ \t]*\|([ \t]*:?-+:?[ \t]*\|)+'))::BIGINT END AS tables, CASE WHEN text IS NULL OR trim(text) = '' THEN NULL ELSE len(regexp_extract_all(text, '\n'))::BIGINT + 1 END AS lines FROM documents)
SELECT doc_id, headings, turns, tables, lines, list_filter([CASE WHEN turns >= 2 THEN 'structure:conversation' END, CASE WHEN headings >= 1 AND turns < 2 THEN 'structure:declared' END, CASE WHEN headings < 1 AND turns < 2 AND lines >= 2 THEN 'structure:inferred' END, CASE WHEN tables >= 1 THEN 'extract:tables' END], lambda x: x IS NOT NULL) AS steps FROM p""",
    "t_importance": "WITH t AS (SELECT document_id AS id, least(avg(s), 1.0) AS m FROM (SELECT DISTINCT document_id, token_idx, importance_score AS s FROM token_embeddings WHERE document_id IS NOT NULL) WHERE s > 0 AND NOT isnan(s) GROUP BY 1) SELECT d.id, CASE WHEN m IS NULL THEN 1.0 ELSE round_even(1 + 9 * m, 2) END AS importance FROM (SELECT DISTINCT document_id AS id FROM token_embeddings WHERE document_id IS NOT NULL) d LEFT JOIN t USING (id)",
    "t_settle": f"WITH RECURSIVE {_CUR}, down(id, path) AS (SELECT id, []::BIGINT[] FROM cur WHERE parent_id IS NULL UNION ALL SELECT cur.id, list_append(d.path, cur.parent_id) FROM cur JOIN down d ON cur.parent_id = d.id), each_ AS (SELECT id, unnest(list_append(path, id)) AS top FROM down) SELECT top AS id, CASE max(CASE settled WHEN 'settled' THEN 0 WHEN 'failed' THEN 2 ELSE 1 END) WHEN 0 THEN 'settled' WHEN 1 THEN 'in_flight' ELSE 'failed' END AS state, count(*) FILTER (settled IS DISTINCT FROM 'settled') AS open FROM each_ JOIN cur USING (id) GROUP BY 1",
    "t_claims": f"WITH {_CUR} SELECT id, coalesce(usetype, '') AS kind, row_number() OVER (ORDER BY created_at, id) AS place FROM cur WHERE id % 4 < 3 AND (settled = 'failed' OR (settled = 'in_flight' AND updated_at + INTERVAL 20 MINUTE < TIMESTAMP '2025-02-01')) QUALIFY row_number() OVER (ORDER BY created_at, id) <= 50",
}
