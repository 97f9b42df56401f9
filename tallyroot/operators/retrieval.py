"""Inverted index, lexical and vector scoring, fusion and projection of ranked lists."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyroot.functions.text import tokens
from tallyroot.work import Workspace

K1, B = 1.2, 0.75
RRF_K = 60
WEIGHTS = {"vector": 0.86, "bm25": 0.14}


#: Distinct query terms up to which they are sent to every task that reads occurrences.
FEW_TERMS = 200_000


@dataclass
class Index:
    """occurrences (doc, term, dl), a row for each token; lengths (doc, dl); terms (term, df); n documents of average length avg."""

    occurrences: DataFrame
    lengths: DataFrame
    terms: DataFrame
    n: int
    avg: float

    def postings(self, of: DataFrame | None = None) -> DataFrame:
        """(doc, term, tf, dl), of all terms or of those in `of` (term).

        Occurrences are counted before the shuffle. Few terms are broadcast, so that other
        occurrences go no further than the scan; many are joined by term.
        """
        rows = self.occurrences
        if of is not None:
            of = of.select("term").distinct()
            rows = rows.join(F.broadcast(of) if of.limit(FEW_TERMS + 1).count() <= FEW_TERMS else of, "term", "left_semi")
        return rows.groupBy("doc", "term", "dl").agg(F.count("*").alias("tf")).select("doc", "term", "tf", "dl")


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, term, tf, dl) of documents."""
    return build_index(docs, key, text).postings()


def build_index(docs: DataFrame, key: str, text: str) -> Index:
    """An inverted index of documents with at least one token; null and empty texts are skipped."""
    # No filter on the tokens before they are used: it would take every text apart twice.
    t = docs.select(F.col(key).alias("doc"), tokens(F.col(text)).alias("t"))
    sized = t.select("doc", F.size("t").alias("dl"))
    stats = sized.agg(F.count_if(F.col("dl") > 0).alias("n"), F.sum("dl").alias("all")).first()
    terms = t.select(F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    occurrences = t.select("doc", F.size("t").alias("dl"), F.explode("t").alias("term"))
    return Index(occurrences, sized.where("dl > 0"), terms, stats.n, (stats.all or 0) / max(stats.n, 1))


def query_terms(queries: DataFrame, key: str, text: str) -> DataFrame:
    """(query, term, times): repeated terms of a query count repeatedly."""
    t = queries.select(F.col(key).alias("query"), F.explode(tokens(F.col(text))).alias("term"))
    return t.groupBy("query", "term").agg(F.count("*").alias("times"))


def _idf(n: Column | int) -> Column:
    return F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)


def bm25(index: Index, terms: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(query, doc, score): statistics are those of the whole index.

    Only postings of the queries' terms leave the scan side; they are summed before the shuffle.
    """
    weighted = terms.join(index.terms, "term").select("query", "term", (F.col("times") * _idf(index.n)).alias("w"))
    norm = F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(index.avg))
    return index.postings(terms).join(weighted, "term").groupBy("query", "doc").agg(F.sum(F.col("w") * F.col("tf") * (k1 + 1) / norm).alias("score"))


def top_k(scored: DataFrame, k: int, group: str = "query", doc: str = "doc", score: str = "score") -> DataFrame:
    """The k best of each group with their rank, ties in ascending order of the document."""
    w = Window.partitionBy(group).orderBy(F.desc(score), F.asc(doc))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalise(v: Column) -> Column:
    size = F.sqrt(dot(v, v))
    return F.when(size > 0, F.transform(v, lambda x: x.cast("double") / size))


def truncate_vector(v: Column, dims: int) -> Column:
    """The first `dims` dimensions at unit length."""
    return normalise(F.slice(v, 1, dims))


#: Query vectors sent to the executors at once: with 768 dimensions about 25 MB.
QUERY_BLOCK = 4096
#: Document rows, without their vectors, that a task remembers before it lets go of those no query wants.
MOST_KEPT = 200_000


def _nearest(block, k: int, least: float | None):
    """The k best documents of each query of the block in a task, by one matrix product a batch.

    A task keeps what may still be among the best and hands it on once, at its end. All that tie
    with the k-th stay, so that ties are decided over the whole table.
    """

    def run(batches):
        keys, q = block.value
        floor = least if least is not None else -np.inf
        kept: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, dtype="int64"))] * len(keys)
        frames, at = [], 0
        for frame in batches:
            if not len(frame):
                continue
            v = np.asarray(frame["v"].tolist(), dtype="float64")
            size = np.sqrt((v * v).sum(axis=1))
            frames.append(frame[frame.columns[:-1]])
            s = q @ (v / np.where(size > 0, size, np.nan)[:, None]).T
            s[np.isnan(s)] = -np.inf
            cut = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(keys), -np.inf)
            for i in range(len(keys)):
                old, rows = kept[i]
                new = np.flatnonzero((s[i] >= cut[i]) & np.isfinite(s[i]) & (s[i] >= floor))
                old, rows = np.concatenate([old, s[i, new]]), np.concatenate([rows, new + at])
                if len(old) > k:
                    stay = old >= np.partition(old, -k)[-k]
                    old, rows = old[stay], rows[stay]
                kept[i] = (old, rows)
            at += len(frame)
            if at > MOST_KEPT:  # rows that no query wants any more are let go
                used = np.unique(np.concatenate([rows for _, rows in kept]))
                frames = [pd.concat(frames, ignore_index=True).iloc[used]]
                kept, at = [(x, np.searchsorted(used, rows)) for x, rows in kept], len(used)
        if frames:
            docs = pd.concat(frames, ignore_index=True)
            for i in range(0, len(keys), 64):
                part = kept[i : i + 64]
                out = docs.iloc[np.concatenate([rows for _, rows in part])].copy()
                out.insert(0, "q", np.repeat(np.array(keys[i : i + 64]), [len(x) for x, _ in part]))
                out["score"] = np.concatenate([x for x, _ in part])
                yield out

    return run


def nearest(docs: DataFrame, queries: DataFrame, k: int, least: float | None = None, block: int = QUERY_BLOCK) -> DataFrame:
    """(q, *docs without v, score): for each query (q long, v) candidates that hold its k nearest documents (..., v last).

    Exact cosine similarity. The queries are a stated set: they are walked in blocks of a fixed
    size, the only thing that is broadcast; each block meets all documents once, in batches,
    and only the best of a batch leave the task. Null vectors, and those of length 0, have no
    score.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "nearest")
    others = [c for c in docs.columns if c != "v"]
    kinds = dict(docs.dtypes)
    schema = ", ".join(["q long", *[f"{c} {kinds[c]}" for c in others], "score double"])
    d = docs.where("v is not null").select(*others, "v")
    q = work.keep(queries.where("q is not null and v is not null").select("q", F.transform("v", lambda x: x.cast("double")).alias("v")))
    n = q.count()
    parts = -(-n // block)
    out = None
    for part in range(max(parts, 1)):
        rows = q.where(F.pmod(F.xxhash64("q"), F.lit(parts)) == part).collect() if parts > 1 else q.collect()
        if not rows:
            continue
        vectors = np.array([r.v for r in rows], dtype="float64").reshape(len(rows), -1)
        size = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
        shared = spark.sparkContext.broadcast(([r.q for r in rows], vectors / np.where(size > 0, size, np.nan)))
        found = d.mapInPandas(_nearest(shared, k, least), schema)
        if parts > 1:
            found = work.keep(found)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def vector_search(docs: DataFrame, queries: DataFrame, k: int, least: float = 0.0) -> DataFrame:
    """(query, doc, score, rank): the k nearest documents (doc, v) of each query (query, v) by cosine similarity.

    `least`: only similarities of so much or more, if above 0.
    """
    found = nearest(docs.select("doc", "v"), queries.select(F.col("query").cast("long").alias("q"), "v"), k, least if least > 0 else None)
    return top_k(found.withColumnRenamed("q", "query"), k)


def maxsim(query_tokens: DataFrame, doc_tokens: DataFrame, per_token: int = 100) -> DataFrame:
    """(query, doc, score): late interaction of query tokens (query, q_idx, importance, v) and token rows (doc, t_idx, v).

    Each query token finds its nearest `per_token` token rows; a document gets the sum over
    query tokens of its best of those. Tokens of importance 0 or less are skipped.
    """
    q = query_tokens.where("importance > 0").withColumn("q", F.xxhash64("query", "q_idx"))
    near = nearest(doc_tokens.select("doc", "t_idx", "v"), q.select("q", "v"), per_token)
    w = Window.partitionBy("q").orderBy(F.desc("score"), "doc", "t_idx")
    best = near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_token).groupBy("q", "doc").agg(F.max("score").alias("s"))
    return best.join(q.select("q", "query"), "q").groupBy("query", "doc").agg(F.sum("s").alias("score"))


def maxsim_rerank(candidates: DataFrame, query_tokens: DataFrame, doc_tokens: DataFrame) -> DataFrame:
    """(query, doc, score): candidates (query, doc) scored exactly; those without tokens get 0.

    Token rows are joined to the candidates they belong to, and summed by partial maxima.
    """
    q = query_tokens.where("importance > 0").select("query", "q_idx", normalise(F.col("v")).alias("qv"))
    d = doc_tokens.select("doc", normalise(F.col("v")).alias("dv")).where("dv is not null")
    pairs = candidates.select("query", "doc").distinct().join(d, "doc").join(q, "query")
    best = pairs.groupBy("query", "doc", "q_idx").agg(F.max(dot(F.col("dv"), F.col("qv"))).alias("s")).groupBy("query", "doc").agg(F.sum("s").alias("score"))
    return candidates.select("query", "doc").distinct().join(best, ["query", "doc"], "left").select("query", "doc", F.coalesce("score", F.lit(0.0)).alias("score"))


def rrf(lists: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(query, doc, score) from ranked lists (query, method, doc, rank): sum of weight / (60 + rank)."""
    weights = WEIGHTS if weights is None else weights
    w = F.lit(1.0)
    for name, value in weights.items():
        w = F.when(F.col("method") == name, float(value)).otherwise(w)
    return lists.groupBy("query", "doc").agg(F.sum(w / (RRF_K + F.col("rank"))).alias("score"))


def hybrid(legs: dict[str, DataFrame], limit: int, allowed: DataFrame | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """(query, doc, score, rank): legs (query, doc, score) fused by reciprocal ranks.

    Each leg gives its best 3 * limit candidates among the allowed documents (doc); the filter
    comes before the cut, so it never leaves a page short, and holds for every leg.
    """
    lists = None
    for name, leg in legs.items():
        if allowed is not None:
            leg = leg.join(allowed.select("doc"), "doc", "left_semi")
        part = top_k(leg.select("query", "doc", "score"), 3 * limit).select("query", F.lit(name).alias("method"), "doc", "rank")
        lists = part if lists is None else lists.unionByName(part)
    return top_k(rrf(lists, weights).withColumn("score", F.round("score", 12)), limit)


def recency(score: Column, clock: Column, now: Column, weight: float, half_life_days: float = 7.0) -> Column:
    """Boosted by 1 + weight * 2^(-age / half life); the future counts as age 0; no clock, no boost."""
    age = F.greatest((F.unix_micros(now.cast("timestamp")) - F.unix_micros(clock.cast("timestamp"))) / F.lit(86_400_000_000.0), F.lit(0.0))
    return score * (1 + weight * F.when(clock.isNull(), 0.0).otherwise(F.exp(-F.log(F.lit(2.0)) * age / half_life_days)))


def importance(score: Column, value: Column, weight: float) -> Column:
    """Boosted by 1 + weight * (importance - 1) / 9; importances outside 1 to 10 are errors, null is 1."""
    v = F.coalesce(value, F.lit(1.0))
    checked = F.when((v < 1) | (v > 10) | F.isnan(v), F.raise_error(F.lit("importance outside 1 to 10")).cast("double")).otherwise(v)
    return score * (1 + weight * (checked - 1) / 9)


def project_parents(hits: DataFrame, nodes: DataFrame, how: str = "max") -> DataFrame:
    """(query, parent, score, best, hits): hits (query, doc, score) grouped by the parent of the hit node."""
    agg = {"max": F.max("score"), "sum": F.sum("score"), "count": F.count("*").cast("double")}[how]
    joined = hits.join(nodes.select(F.col("id").alias("doc"), F.col("parent_id").alias("parent")), "doc").where("parent is not null")
    return joined.groupBy("query", "parent").agg(agg.alias("score"), F.max("score").alias("best"), F.count("*").alias("hits"))


def token_tiers(rows: DataFrame, keep: float = 0.35) -> DataFrame:
    """(document_id, token_idx, tier): the best `keep` of a node's tokens, by importance, in tenths of 5 each."""
    w = Window.partitionBy("document_id").orderBy(F.desc("importance_score"), "token_idx")
    ranked = rows.where("importance_score is not null and not isnan(importance_score)").groupBy("document_id", "token_idx").agg(F.max("importance_score").alias("importance_score"))
    ranked = ranked.withColumn("i", F.row_number().over(w) - 1).withColumn("all", F.count("*").over(Window.partitionBy("document_id")))
    ranked = ranked.withColumn("n", F.greatest(F.floor(F.col("all") * keep), F.lit(1))).where("i < n")
    tier = (F.least(F.floor(F.col("i") / F.greatest(F.lit(1), F.floor(F.col("n") / 10))), F.lit(9)) + 1) * 5
    return ranked.select("document_id", "token_idx", tier.cast("int").alias("tier"))


def container_bm25(index: Index, terms: DataFrame, members: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(query, doc, score) of containers: as if the members of their frontier were one text.

    Term frequencies and lengths of a container's members are added; idf stays that of the
    leaves. `members`: (id, member) as views.frontier gives them; leave out containers that have
    a summary of their own.
    """
    above = members.select(F.col("member").alias("doc"), F.col("id").alias("ancestor"))
    weighted = terms.join(index.terms, "term").select("query", "term", (F.col("times") * _idf(index.n)).alias("w"))
    tf = index.postings(terms).join(above, "doc").groupBy("ancestor", "term").agg(F.sum("tf").alias("tf"))
    lengths = index.lengths.join(above, "doc").groupBy("ancestor").agg(F.sum("dl").alias("dl"))
    norm = F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(index.avg))
    scored = tf.join(weighted, "term").join(lengths, "ancestor")
    return scored.groupBy("query", F.col("ancestor").alias("doc")).agg(F.sum(F.col("w") * F.col("tf") * (k1 + 1) / norm).alias("score"))


def container_candidates(index: Index, terms: DataFrame, nodes: DataFrame, up: DataFrame, k: int) -> DataFrame:
    """(query, doc, hits, rank): containers ranked by the most distinct query terms that one of their leaves holds."""
    hits = index.postings(terms).join(terms.select("query", "term"), "term").groupBy("query", "doc").agg(F.count("*").alias("hits"))
    containers = nodes.where("content is null").select(F.col("id").alias("ancestor"))
    best = hits.join(up.join(containers, "ancestor", "left_semi").select(F.col("id").alias("doc"), "ancestor"), "doc").groupBy("query", "ancestor").agg(F.max("hits").alias("hits"))
    return top_k(best.withColumnRenamed("ancestor", "doc"), k, score="hits")
