"""Search: index, scoring, fusion, projection, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyroot.functions import text as tx
from tallyroot.operators import ann, embedding, evaluation, indexing, retrieval, views
from tallyroot.operators.hierarchy import ancestors
from tallyroot.plans.trees import kept_tree as tree
from tallyroot.sources.tables import table
from tallyroot.work import Workspace

TOP = 10


def r_terms(spark: SparkSession, folder: str) -> DataFrame:
    index = retrieval.build_index(views.current_nodes(table(spark, folder, "nodes"), ["content"]), "id", "content")
    return index.terms


def _bm25(spark: SparkSession, folder: str) -> DataFrame:
    index = retrieval.build_index(table(spark, folder, "documents"), "doc_id", "text")
    scored = retrieval.bm25(index, retrieval.query_terms(table(spark, folder, "eval_queries"), "query_id", "query_text"))
    return retrieval.top_k(scored.withColumn("score", F.round("score", 7)), TOP)


def r_bm25(spark: SparkSession, folder: str) -> DataFrame:
    return _bm25(spark, folder).select("query", "doc", "score", "rank")


def r_vector(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings")
    docs = e.select(F.col("vec_id").alias("doc"), F.col("embedding").alias("v"))
    # The stated query set: every row whose id is divisible by 100, against all rows.
    queries = e.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query"), F.col("embedding").alias("v"))
    return retrieval.vector_search(docs, queries, TOP).select("query", "doc", F.round("score", 6).alias("score"), "rank")


def r_truncated(spark: SparkSession, folder: str) -> DataFrame:
    v = retrieval.truncate_vector(F.col("embedding"), 16)
    return table(spark, folder, "embeddings").select("vec_id", F.transform(v, lambda x: F.round(x, 6)).alias("v"))


def r_maxsim(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings")
    docs = e.select(F.col("label").cast("long").alias("doc"), F.col("vec_id").alias("t_idx"), F.col("embedding").alias("v"))
    queries = e.where(F.col("vec_id") % 100 == 0).select(F.lit(1).alias("query"), F.col("vec_id").alias("q_idx"), F.lit(1.0).alias("importance"), F.col("embedding").alias("v"))
    return retrieval.maxsim(queries, docs).select("query", "doc", F.round("score", 6).alias("score"))


def r_ann(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings")
    index = ann.build_vector_index(e.select(F.col("vec_id").alias("doc"), F.col("embedding").alias("v")))
    queries = e.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query"), F.col("embedding").alias("v"))
    return ann.ann_search(index, queries, TOP)


def r_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the index finds nine tenths of what the exact search finds, for the stated queries."""
    e = table(spark, folder, "embeddings")
    docs = e.select(F.col("vec_id").alias("doc"), F.col("embedding").alias("v"))
    queries = e.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query"), F.col("embedding").alias("v"))
    truth = retrieval.vector_search(docs, queries, TOP).select("query", "doc")
    hit = truth.join(r_ann(spark, folder).select("query", "doc", F.lit(1).alias("hit")), ["query", "doc"], "left")
    return hit.agg(F.count("*").alias("pairs"), (F.count("hit") >= 0.9 * F.count("*")).alias("enough"))


def r_mmr(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings").withColumn("relevance", F.element_at("embedding", 1).cast("double"))
    return ann.mmr(e, "label", "vec_id", "embedding", "relevance", 10)


def r_rerank(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings")
    docs = e.select(F.col("label").cast("long").alias("doc"), F.col("embedding").alias("v"))
    queries = e.where(F.col("vec_id") % 100 == 0).select((F.col("vec_id") % 300).alias("query"), F.col("vec_id").alias("q_idx"), F.lit(1.0).alias("importance"), F.col("embedding").alias("v"))
    near = retrieval.nearest(e.select(F.col("label").cast("long").alias("doc"), F.col("vec_id").alias("t"), F.col("embedding").alias("v")), queries.select(F.col("q_idx").alias("q"), "v"), 20)
    found = retrieval.top_k(near.withColumnRenamed("q", "q_idx"), 20, group="q_idx", doc="t").join(queries.select("q_idx", "query"), "q_idx")
    # A candidate without tokens, for each query, keeps a score of 0.
    none = queries.select("query").distinct().withColumn("doc", F.lit(1_000_000).cast("long"))
    cand = found.select("query", "doc").unionByName(none)
    return retrieval.maxsim_rerank(cand, queries, docs).select("query", "doc", F.round("score", 6).alias("score"))


def _lists(spark: SparkSession, folder: str) -> DataFrame:
    hits = table(spark, folder, "search_hits").where("score is not null and not isnan(score)")
    best = hits.groupBy("search_id", F.lower("method").alias("method"), "document_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("search_id", "method").orderBy(F.desc("score"), "document_id")
    return best.select(F.col("search_id").alias("query"), "method", F.col("document_id").alias("doc"), F.row_number().over(w).alias("rank"), "score")


def r_fused(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.rrf(_lists(spark, folder)).select("query", "doc", F.round("score", 8).alias("score"))


def r_hybrid(spark: SparkSession, folder: str) -> DataFrame:
    nodes = views.settled(views.current_nodes(table(spark, folder, "nodes"), ["settled"])).select(F.col("id").alias("doc"))
    lists = _lists(spark, folder)
    legs = {m: lists.where(F.col("method") == m) for m in ("vector", "bm25", "maxsim")}
    return retrieval.hybrid(legs, 5, nodes).select("query", "doc", F.round("score", 10).alias("score"), "rank")


def r_parents(spark: SparkSession, folder: str) -> DataFrame:
    nodes = views.current_nodes(table(spark, folder, "nodes"), ["parent_id"])
    hits = _lists(spark, folder).where("method = 'bm25'").select("query", "doc", "score")
    out = retrieval.project_parents(hits, nodes, "sum")
    return out.select("query", "parent", F.round("score", 6).alias("score"), "best", "hits")


def r_boosted(spark: SparkSession, folder: str) -> DataFrame:
    nodes = views.settled(views.current_nodes(table(spark, folder, "nodes"), ["created_at", "event_time", "settled"]))
    hits = _lists(spark, folder).where("method = 'vector'")
    joined = hits.join(nodes.select(F.col("id").alias("doc"), views.clock().alias("clock")), "doc")
    boosted = retrieval.recency(F.col("score"), F.col("clock"), F.to_timestamp(F.lit("2025-02-01 00:00:00")), 0.5)
    return joined.select("query", "doc", F.round(boosted, 6).alias("score"))


def r_routes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "eval_queries").select("query_id", tx.route(F.col("query_text")).alias("method"))


def r_tiers(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.token_tiers(table(spark, folder, "token_embeddings"))


def _leaves(spark: SparkSession, folder: str) -> tuple[DataFrame, retrieval.Index, DataFrame]:
    """Nodes in force, the index of the settled ones with a text, and the terms of the queries."""
    nodes = Workspace(spark, "leaves").keep(views.current_nodes(table(spark, folder, "nodes"), ["content", "settled", "parent_id", "usetype"]))
    index = retrieval.build_index(views.settled(nodes).where("content is not null"), "id", "content")
    return nodes, index, retrieval.query_terms(table(spark, folder, "eval_queries"), "query_id", "query_text")


def _containers(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Scores of containers, and of leaves."""
    nodes, index, terms = _leaves(spark, folder)
    full = views.settled(nodes).unionByName(nodes.where("content is null and settled <> 'settled'"))
    members = views.frontier(full, tree(spark, folder))
    return retrieval.container_bm25(index, terms, members), retrieval.bm25(index, terms)


def r_containers(spark: SparkSession, folder: str) -> DataFrame:
    scored = _containers(spark, folder)[0].withColumn("score", F.round("score", 7))
    return retrieval.top_k(scored, TOP).select("query", "doc", "score", "rank")


def r_merged(spark: SparkSession, folder: str) -> DataFrame:
    above, leaves = _containers(spark, folder)
    out = indexing.merged(TOP, container=above.withColumn("score", F.round("score", 7)), leaf=leaves.withColumn("score", F.round("score", 7)))
    return out.select("query", "doc", "score", "kind", "rank")


def _members(spark: SparkSession, folder: str) -> DataFrame:
    """Three indexes over the folders, by the folder's id, and one over the collections."""
    n = views.current_nodes(table(spark, folder, "nodes"), ["usetype"]).where("usetype in ('folder', 'collection')")
    return n.select(F.when(F.col("usetype") == "folder", F.col("id") % 3).otherwise(10).alias("index"), F.col("id").alias("root"))


def r_index(spark: SparkSession, folder: str) -> DataFrame:
    nodes = views.current_nodes(table(spark, folder, "nodes"), ["content", "settled", "usetype"])
    docs = indexing.indexed(nodes, tree(spark, folder), _members(spark, folder), [*indexing.INDEX_EXCLUDED, "scan:*"])
    return indexing.index_sizes(docs).select("index", "n", "n_tokens", F.round("avg", 6).alias("avg"))


def r_covering(spark: SparkSession, folder: str) -> DataFrame:
    nodes = views.current_nodes(table(spark, folder, "nodes"), ["usetype"])
    return indexing.covering(nodes, tree(spark, folder), _members(spark, folder), nodes.where("usetype in ('section', 'folder', 'file')"))


def _projected(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    nodes = views.current_nodes(table(spark, folder, "nodes"), ["parent_id", "usetype"])
    grants = nodes.where("usetype = 'folder'").select(F.col("id").alias("root"), F.concat(F.lit("p"), (F.col("id") % 5).cast("string")).alias("principal"), F.lit("read").alias("level"))
    return indexing.projected(_lists(spark, folder).select("query", "doc", "score"), nodes, views.readable(nodes, tree(spark, folder), grants, "p1"))


def r_projected(spark: SparkSession, folder: str) -> DataFrame:
    out = _projected(spark, folder)[0]
    return out.select("query", "parent", "score", "hits", "rank")


def r_withheld(spark: SparkSession, folder: str) -> DataFrame:
    return _projected(spark, folder)[1]


def r_rescored(spark: SparkSession, folder: str) -> DataFrame:
    """The best 30 by BM25, scored anew by a pluggable scorer over the pairs of texts."""
    index = retrieval.build_index(table(spark, folder, "documents"), "doc_id", "text")
    asked = table(spark, folder, "eval_queries").select(F.col("query_id").alias("query"), F.col("query_text").alias("text"))
    scored = retrieval.bm25(index, retrieval.query_terms(asked, "query", "text"))
    hits = retrieval.top_k(scored.withColumn("score", F.round("score", 7)), 3 * TOP)
    texts = table(spark, folder, "documents").select(F.col("doc_id").alias("doc"), "text")
    return embedding.rescore(hits, texts, asked, embedding.shared_terms, TOP).select("query", "doc", F.round("score", 9).alias("score"), "rank")


def r_candidates(spark: SparkSession, folder: str) -> DataFrame:
    nodes, index, terms = _leaves(spark, folder)
    up = ancestors(tree(spark, folder), index.lengths.select(F.col("doc").alias("id")), nodes.where("content is null"), sound=True)
    return retrieval.container_candidates(index, terms, nodes, up.select("id", "ancestor"), 2 * TOP)


def e_metrics(spark: SparkSession, folder: str) -> DataFrame:
    lists = _lists(spark, folder)
    run = lists.where("method = 'bm25'").select("query", "doc", "rank")
    grades = lists.where("method = 'maxsim'").select("query", "doc", F.when(F.col("rank") <= 3, 2).otherwise(1).alias("grade"))
    m = evaluation.metrics(run, grades)
    return m.select("query", *[F.round(c, 7).alias(c) for c in ("ndcg", "precision", "recall", "ap", "rr")])


def e_means(spark: SparkSession, folder: str) -> DataFrame:
    m = evaluation.means(e_metrics(spark, folder))
    return m.select(*[F.round(c, 5).alias(c) for c in ("ndcg", "precision", "recall", "ap", "rr")], "queries")


def r_similar(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of a similarity of 0.35 or more to the stated ones, at most ten each."""
    e = table(spark, folder, "embeddings")
    docs = e.select(F.col("vec_id").alias("doc"), F.col("embedding").alias("v"))
    queries = e.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query"), F.col("embedding").alias("v"))
    return retrieval.vector_search(docs, queries, TOP, 0.35).select("query", "doc", F.round("score", 6).alias("score"), "rank")


def r_important(spark: SparkSession, folder: str) -> DataFrame:
    """Hits boosted by the importance of their nodes."""
    value = embedding.importance_of(table(spark, folder, "token_embeddings"), "document_id", "importance_score").withColumnRenamed("id", "doc")
    hits = _lists(spark, folder).where("method = 'vector'").join(value, "doc", "left")
    return hits.select("query", "doc", F.round(retrieval.importance(F.col("score"), F.col("importance"), 0.5), 9).alias("score"))


def r_subtree(spark: SparkSession, folder: str) -> DataFrame:
    """Each query's best leaves below the folders of odd ids, by statistics of the whole index."""
    nodes, index, terms = _leaves(spark, folder)
    roots = nodes.where("usetype = 'folder' and id % 2 = 1").select("id")
    below = ancestors(tree(spark, folder), index.lengths.select(F.col("doc").alias("id")), roots, sound=True).select(F.col("id").alias("doc")).distinct()
    scored = retrieval.bm25(index, terms).join(below, "doc", "left_semi").withColumn("score", F.round("score", 7))
    return retrieval.top_k(scored, TOP).select("query", "doc", "score", "rank")


def e_report(spark: SparkSession, folder: str) -> DataFrame:
    lists = _lists(spark, folder)
    run = lists.where("method = 'bm25'").select("query", "doc", "rank")
    grades = lists.where("method = 'maxsim'").select("query", "doc", F.when(F.col("rank") <= 3, 2).otherwise(1).alias("grade"))
    m = evaluation.report(run, grades, depth=TOP)
    return m.select(*[F.round(c, 5).alias(c) for c in ("ndcg", "recall")], "recall_100", "queries")


QUERIES = {f.__name__: f for f in (r_terms, r_bm25, r_vector, r_truncated, r_ann, r_mmr, r_maxsim, r_rerank, r_fused, r_hybrid, r_parents, r_boosted, r_routes, r_tiers, r_containers, r_merged, r_index, r_covering, r_projected, r_withheld, r_rescored, r_recall, r_candidates, r_similar, r_important, r_subtree, e_metrics, e_means, e_report)}

_TOK = "list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda x: length(x) >= 2)"
_CUR = "cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) AS rn FROM nodes WHERE id IS NOT NULL) WHERE rn = 1)"
_LISTS = """lists AS (
  SELECT query, method, doc, score, row_number() OVER (PARTITION BY query, method ORDER BY score DESC, doc) AS rank
  FROM (SELECT search_id AS query, lower(method) AS method, document_id AS doc, max(score) AS score FROM search_hits WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY ALL))"""
_QT = f"qt AS (SELECT query, term, count(*) AS times FROM (SELECT query_id AS query, unnest({_TOK.format('query_text')}) AS term FROM eval_queries) GROUP BY ALL)"
_BM = """df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
n AS (SELECT count(*) AS n, avg(dl) AS avg FROM docs),
w AS (SELECT query, term, times * ln((n - df + 0.5) / (df + 0.5) + 1) AS w FROM qt JOIN df USING (term), n)"""
_METRICS = f"""WITH {_LISTS}, run AS (SELECT query, doc, rank FROM lists WHERE method = 'bm25' AND rank <= 10),
rel AS (SELECT query, doc, CASE WHEN rank <= 3 THEN 2 ELSE 1 END AS grade FROM lists WHERE method = 'maxsim'),
ideal AS (SELECT query, sum(CASE WHEN i <= 10 THEN grade / log2(i + 1) END) AS idcg, count(*) AS relevant FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY grade DESC, doc) AS i FROM rel) GROUP BY 1),
got AS (SELECT run.query, rank, coalesce(grade, 0) AS grade, (grade IS NOT NULL)::INT AS hit FROM run LEFT JOIN rel USING (query, doc)),
seen AS (SELECT *, sum(hit) OVER (PARTITION BY query ORDER BY rank) AS seen FROM got),
per AS (SELECT query, sum(grade / log2(rank + 1)) AS dcg, sum(hit) AS hits, sum(CASE WHEN hit = 1 THEN seen / rank ELSE 0 END) AS aps, min(CASE WHEN hit = 1 THEN rank END) AS f FROM seen GROUP BY 1),
m AS (SELECT query, round(coalesce(dcg / idcg, 0), 7) AS ndcg, round(coalesce(hits / 10.0, 0), 7) AS precision, round(coalesce(hits::DOUBLE / relevant, 0), 7) AS recall, round(coalesce(aps / least(relevant, 10), 0), 7) AS ap, round(coalesce(1.0 / f, 0), 7) AS rr FROM ideal LEFT JOIN per USING (query))"""

_DOWN = "down(id, path) AS (SELECT id, []::BIGINT[] FROM cur WHERE parent_id IS NULL UNION ALL SELECT cur.id, list_append(d.path, cur.parent_id) FROM cur JOIN down d ON cur.parent_id = d.id)"
_CHAINED = f"WITH RECURSIVE {_CUR}, {_DOWN}, chain AS (SELECT id, unnest(list_append(path, id)) AS anc, generate_subscripts(list_append(path, id), 1) AS up FROM down)"
_READABLE = "gov AS (SELECT chain.id, bool_or(anc % 5 = 1) AS mine FROM chain JOIN cur ON cur.id = anc WHERE usetype = 'folder' GROUP BY 1), ok AS (SELECT id FROM cur WHERE id NOT IN (SELECT id FROM gov WHERE NOT mine))"
_CONTAINERS = f"""WITH RECURSIVE {_CUR}, {_DOWN}, up AS (SELECT id, unnest(path) AS anc, generate_subscripts(path, 1) AS ad FROM down), {_QT},
toks AS (SELECT id AS doc, {_TOK.format('content')} AS t FROM cur WHERE content IS NOT NULL AND settled = 'settled'),
docs AS (SELECT doc, len(t) AS dl FROM toks WHERE len(t) > 0), tf AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(t) AS term FROM toks) GROUP BY ALL), {_BM},
full_ AS (SELECT id FROM cur WHERE settled = 'settled' AND trim(content) <> ''), hid AS (SELECT up.id, max(ad) AS hid FROM up JOIN full_ ON full_.id = anc WHERE up.id IN (SELECT id FROM full_) GROUP BY 1),
above AS (SELECT up.id AS doc, anc FROM up JOIN full_ ON full_.id = up.id LEFT JOIN hid ON hid.id = up.id JOIN cur c ON c.id = anc WHERE c.content IS NULL AND (hid IS NULL OR ad > hid)),
ctf AS (SELECT anc, term, sum(tf) AS tf FROM tf JOIN above USING (doc) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
cdl AS (SELECT anc, sum(dl) AS dl FROM docs JOIN above USING (doc) GROUP BY 1),
s AS (SELECT query, anc AS doc, round(sum(w * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg))), 7) AS score FROM ctf JOIN w USING (term) JOIN cdl USING (anc), n GROUP BY ALL)"""

ORACLE = {
    "r_terms": f"WITH {_CUR} SELECT term, count(*) AS df FROM (SELECT id, unnest(list_distinct({_TOK.format('content')})) AS term FROM cur) GROUP BY 1",
    "r_bm25": f"""WITH {_QT}, toks AS (SELECT doc_id AS doc, {_TOK.format('text')} AS t FROM documents WHERE text IS NOT NULL),
docs AS (SELECT doc, len(t) AS dl FROM toks WHERE len(t) > 0), tf AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(t) AS term FROM toks) GROUP BY ALL), {_BM},
s AS (SELECT query, doc, round(sum(w * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg))), 7) AS score FROM tf JOIN w USING (term) JOIN docs USING (doc), n GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM s)
SELECT query, doc, score, rank FROM ranked WHERE rank <= 10""",
    "r_vector": """WITH s AS (SELECT q.vec_id AS query, d.vec_id AS doc, list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings d WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM s) SELECT query, doc, round(score, 6) AS score, rank FROM r WHERE rank <= 10""",
    "r_truncated": "WITH t AS (SELECT vec_id, embedding[1:16]::DOUBLE[] AS e FROM embeddings) SELECT vec_id, list_transform(e, lambda x: round(x / sqrt(list_inner_product(e, e)), 6)) AS v FROM t",
    "r_maxsim": """WITH s AS (SELECT q.vec_id AS qi, d.vec_id AS ti, d.label::BIGINT AS doc, list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]) AS s FROM embeddings q, embeddings d WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY qi ORDER BY s DESC, doc, ti) AS r FROM s),
b AS (SELECT qi, doc, max(s) AS s FROM r WHERE r <= 100 GROUP BY ALL) SELECT 1 AS query, doc, round(sum(s), 6) AS score FROM b GROUP BY doc""",
    "r_rerank": """WITH q AS (SELECT vec_id % 300 AS query, vec_id AS qi, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0),
n AS (SELECT query, qi, label::BIGINT AS doc, row_number() OVER (PARTITION BY qi ORDER BY list_cosine_similarity(v, embedding::DOUBLE[]) DESC, vec_id) AS k FROM q, embeddings), c AS (SELECT DISTINCT query, doc FROM n WHERE k <= 20),
s AS (SELECT query, qi, label::BIGINT AS doc, max(list_cosine_similarity(v, embedding::DOUBLE[])) AS s FROM q, embeddings GROUP BY ALL)
SELECT query, doc, round(sum(s), 6) AS score FROM s JOIN c USING (query, doc) GROUP BY ALL UNION ALL SELECT DISTINCT query, 1000000::BIGINT, 0.0 FROM q""",
    "r_fused": f"WITH {_LISTS} SELECT query, doc, round(sum(CASE method WHEN 'vector' THEN 0.86 WHEN 'bm25' THEN 0.14 ELSE 1.0 END / (60 + rank)), 8) AS score FROM lists GROUP BY ALL",
    "r_hybrid": f"""WITH {_CUR}, {_LISTS}, ok AS (SELECT query, method, doc, row_number() OVER (PARTITION BY query, method ORDER BY score DESC, doc) AS rank FROM lists WHERE method IN ('vector', 'bm25', 'maxsim') AND doc IN (SELECT id FROM cur WHERE settled = 'settled')),
s AS (SELECT query, doc, round(sum(CASE method WHEN 'vector' THEN 0.86 WHEN 'bm25' THEN 0.14 ELSE 1.0 END::DOUBLE / (60 + rank)), 12) AS score FROM ok WHERE rank <= 15 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM s)
SELECT query, doc, round(score, 10) AS score, rank FROM r WHERE rank <= 5""",
    "r_parents": f"WITH {_CUR}, {_LISTS} SELECT query, parent_id AS parent, round(sum(score), 6) AS score, max(score) AS best, count(*) AS hits FROM lists JOIN cur ON cur.id = doc WHERE method = 'bm25' AND parent_id IS NOT NULL GROUP BY ALL",
    "r_boosted": f"WITH {_CUR}, {_LISTS} SELECT query, doc, round(score * (1 + 0.5 * coalesce(exp(-ln(2) * greatest(epoch_us(TIMESTAMP '2025-02-01') - epoch_us(coalesce(event_time, created_at)), 0) / 86400000000.0 / 7), 0)), 6) AS score FROM lists JOIN cur ON cur.id = doc WHERE method = 'vector' AND settled = 'settled'",
    "r_routes": rf"""WITH q AS (SELECT query_id, trim(coalesce(query_text, '')) AS t, {_TOK.format("coalesce(query_text, '')")} AS w FROM eval_queries),
c AS (SELECT *, len(w) AS n, len(list_filter(w, lambda x: NOT list_contains(string_split('{" ".join(tx.STOPWORDS)}', ' '), x))) AS content FROM q)
SELECT query_id, CASE WHEN t = '' THEN 'hybrid' WHEN regexp_matches(t, '"[^"]+"') OR regexp_matches(t, '\b(AND|OR|NOT)\b') THEN 'fulltext'
 WHEN content <= 2 AND (n = 0 OR 1 - content / n < 0.4) THEN 'bm25' WHEN n >= 8 OR ((coalesce(list_contains(string_split('{" ".join(tx.QUESTIONS)}', ' '), w[1]), false) OR t LIKE '%?') AND n >= 4) THEN 'vector' ELSE 'hybrid' END AS method FROM c""",
    "r_tiers": """WITH t AS (SELECT document_id, token_idx, max(importance_score) AS s FROM token_embeddings WHERE importance_score IS NOT NULL AND NOT isnan(importance_score) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY s DESC, token_idx) - 1 AS i, greatest(floor(count(*) OVER (PARTITION BY document_id) * 0.35::DOUBLE), 1) AS n FROM t)
SELECT document_id, token_idx, ((least(floor(i / greatest(1, floor(n / 10))), 9) + 1) * 5)::INT AS tier FROM r WHERE i < n""",
    "r_containers": f"""{_CONTAINERS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM s) SELECT query, doc, score, rank FROM ranked WHERE rank <= 10""",
    "r_merged": f"""{_CONTAINERS}, leaf AS (SELECT query, doc, round(sum(w * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg))), 7) AS score FROM tf JOIN w USING (term) JOIN docs USING (doc), n GROUP BY ALL),
both_ AS (SELECT *, 'container' AS kind FROM s UNION ALL SELECT *, 'leaf' FROM leaf), ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM both_) SELECT query, doc, score, kind, rank FROM ranked WHERE rank <= 10""",
    "r_index": f"""{_CHAINED}, mem AS (SELECT CASE usetype WHEN 'folder' THEN id % 3 ELSE 10 END AS index, id AS root FROM cur WHERE usetype IN ('folder', 'collection')),
held AS (SELECT DISTINCT index, chain.id FROM chain JOIN mem ON root = anc), d AS (SELECT index, len({_TOK.format('content')}) AS dl FROM held JOIN cur USING (id) WHERE settled = 'settled' AND content IS NOT NULL AND (usetype IS NULL OR NOT (usetype IN ('entity', 'entities', 'summary', 'derived', 'cell') OR usetype LIKE 'scan:%')))
SELECT index, count(*) AS n, sum(dl)::BIGINT AS n_tokens, round(avg(dl), 6) AS avg FROM d WHERE dl > 0 GROUP BY 1""",
    "r_covering": f"""{_CHAINED}, mem AS (SELECT CASE usetype WHEN 'folder' THEN id % 3 ELSE 10 END AS index, id AS root FROM cur WHERE usetype IN ('folder', 'collection'))
SELECT id, index, root FROM (SELECT chain.id, index, root, row_number() OVER (PARTITION BY chain.id ORDER BY up DESC, index) AS k FROM chain JOIN mem ON root = anc JOIN cur ON cur.id = chain.id WHERE usetype IN ('section', 'folder', 'file')) WHERE k = 1""",
    "r_projected": f"""{_CHAINED}, {_LISTS}, {_READABLE}, p AS (SELECT query, parent_id AS parent, max(score) AS score, count(*) AS hits FROM lists JOIN cur ON cur.id = doc WHERE parent_id IN (SELECT id FROM ok) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, parent) AS rank FROM p) SELECT * FROM r WHERE rank <= 10""",
    "r_withheld": f"{_CHAINED}, {_LISTS}, {_READABLE} SELECT query, count(*) FILTER (parent_id IN (SELECT id FROM ok)) AS matched, count(*) FILTER (parent_id IS NULL) AS no_parent, count(*) FILTER (parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM ok)) AS withheld FROM lists JOIN cur ON cur.id = doc GROUP BY 1",
    "r_rescored": f"""WITH {_QT}, toks AS (SELECT doc_id AS doc, {_TOK.format('text')} AS t FROM documents WHERE text IS NOT NULL),
docs AS (SELECT doc, len(t) AS dl FROM toks WHERE len(t) > 0), tf AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(t) AS term FROM toks) GROUP BY ALL), {_BM},
s AS (SELECT query, doc, round(sum(w * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg))), 7) AS score FROM tf JOIN w USING (term) JOIN docs USING (doc), n GROUP BY ALL),
best AS (SELECT query, doc FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM s) WHERE rank <= 30),
qs AS (SELECT query_id AS query, list_distinct({_TOK.format('query_text')}) AS q FROM eval_queries), n2 AS (SELECT query, doc, len(list_intersect(q, t)) / len(q) AS score FROM best JOIN qs USING (query) JOIN toks USING (doc)),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM n2) SELECT query, doc, round(score, 9) AS score, rank FROM r WHERE rank <= 10""",
    "r_recall": "SELECT 10 * count(*) AS pairs, true AS enough FROM embeddings WHERE vec_id % 100 = 0",
    "r_candidates": f"""WITH RECURSIVE {_CUR}, down(id, path) AS (SELECT id, []::BIGINT[] FROM cur WHERE parent_id IS NULL UNION ALL SELECT cur.id, list_append(d.path, cur.parent_id) FROM cur JOIN down d ON cur.parent_id = d.id), up AS (SELECT id, unnest(path) AS anc FROM down), {_QT},
tt AS (SELECT id AS doc, unnest(list_distinct({_TOK.format('content')})) AS term FROM cur WHERE content IS NOT NULL AND settled = 'settled'),
h AS (SELECT query, doc, count(*) AS hits FROM tt JOIN qt USING (term) GROUP BY ALL),
b AS (SELECT query, anc AS doc, max(hits) AS hits FROM h JOIN up ON up.id = h.doc JOIN cur ON cur.id = anc WHERE cur.content IS NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY hits DESC, doc) AS rank FROM b) SELECT query, doc, hits, rank FROM r WHERE rank <= 20""",
    "e_metrics": f"{_METRICS} SELECT * FROM m",
    "e_means": f"{_METRICS} SELECT round(avg(ndcg), 5) AS ndcg, round(avg(precision), 5) AS precision, round(avg(recall), 5) AS recall, round(avg(ap), 5) AS ap, round(avg(rr), 5) AS rr, count(*) AS queries FROM m",
}

ORACLE |= {
    "r_similar": ORACLE["r_vector"].replace("WHERE rank <= 10", "WHERE rank <= 10 AND score >= 0.35"),
    "r_important": f"WITH {_LISTS}, t AS (SELECT document_id AS doc, least(avg(s), 1.0) AS m FROM (SELECT DISTINCT document_id, token_idx, importance_score AS s FROM token_embeddings) WHERE s > 0 AND NOT isnan(s) GROUP BY 1) SELECT query, doc, round(score * (1 + 0.5 * (coalesce(round_even(1 + 9 * m, 2), 1.0) - 1) / 9), 9) AS score FROM lists LEFT JOIN t USING (doc) WHERE method = 'vector'",
    "r_subtree": f"""{_CONTAINERS.split("full_ AS")[0].rstrip().rstrip(',')}, ok AS (SELECT DISTINCT up.id AS doc FROM up JOIN cur ON cur.id = anc WHERE usetype = 'folder' AND anc % 2 = 1),
s AS (SELECT query, doc, round(sum(w * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg))), 7) AS score FROM tf JOIN w USING (term) JOIN docs USING (doc), n WHERE doc IN (SELECT doc FROM ok) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM s) SELECT query, doc, score, rank FROM r WHERE rank <= 10""",
    "e_report": f"{_METRICS} SELECT round(avg(ndcg), 5) AS ndcg, round(avg(recall), 5) AS recall, NULL::DOUBLE AS recall_100, count(*) AS queries FROM m",
}
