"""Vectors of texts by a pluggable embedder, with hashed term counts as the one that needs no model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyroot.functions.text import tokens

DIMENSIONS = 256
# What stands before a text for the models that were trained with it.
PREFIXES = {"query": "search_query: ", "document": "search_document: "}


def embed(docs: DataFrame, key: str, text: str, embedder: Callable[[Column], Column] | None = None, kind: str | None = None, fits: Callable[[Column], Column] | None = None) -> DataFrame:
    """(key, v): the vector of each text, null texts none.

    embedder: a function from a text column to a vector column, such as a pandas UDF around a
    model; kind: `query` or `document`, whose prefix is set before the text. fits: a condition
    on the text; those beyond a model's window get no vector instead of one of their beginning.
    """
    t = F.col(text) if kind is None else F.concat(F.lit(PREFIXES[kind]), F.col(text))
    rows = docs.where(F.col(text).isNotNull())
    if fits is not None:
        rows = rows.where(fits(F.col(text)))
    if embedder is None:
        # Term counts are summed by term before they become a vector, so a long text costs one pass.
        hashed = rows.select(key, F.explode(F.transform(tokens(t), F.md5)).alias("h"))
        slot = (F.conv(F.substring("h", 1, 7), 16, 10).cast("bigint") % DIMENSIONS).cast("int")
        sign = F.when(F.conv(F.substring("h", 8, 1), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
        sums = hashed.groupBy(key, slot.alias("i")).agg(F.sum(sign).alias("x"))
        held = sums.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("i", "x"))).alias("m"))
        return held.select(key, F.transform(F.sequence(F.lit(0), F.lit(DIMENSIONS - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("v"))
    return rows.select(key, embedder(t).alias("v")).where("v is not null")


def rescore(hits: DataFrame, texts: DataFrame, queries: DataFrame, scorer: Callable[[Column, Column], Column], limit: int) -> DataFrame:
    """(query, doc, score, rank): hits (query, doc) scored anew as pairs of texts (query text, document text), the best `limit` of each query.

    scorer: a function from two text columns to a score, such as a pandas UDF around a
    cross-encoder. Give it more hits than `limit`, three times as many as a rule.
    """
    from tallyroot.operators.retrieval import top_k

    pairs = hits.select("query", "doc").distinct().join(texts.select("doc", F.col("text").alias("_d")), "doc").join(queries.select("query", F.col("text").alias("_q")), "query")
    return top_k(pairs.select("query", "doc", scorer(F.col("_q"), F.col("_d")).alias("score")).where("score is not null"), limit)


def shared_terms(query: Column, text: Column) -> Column:
    """The share of the query's different tokens that the text has; null for a query without tokens."""
    asked = F.array_distinct(tokens(query))
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, tokens(text))) / F.size(asked))


def importance_of(rows: DataFrame, key: str, score: str) -> DataFrame:
    """(id, importance): 1 + 9 * the mean of a node's positive token scores, at most 1, to two places, halves to even; 1 without any.

    Repeated rows count once (rows need `token_idx`).
    """
    s = F.col(score).cast("double")
    once = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), "token_idx", F.when((s > 0) & ~F.isnan(s), s).alias("s")).distinct()
    return once.groupBy("id").agg(F.avg("s").alias("m")).select("id", F.when(F.col("m").isNull(), 1.0).otherwise(F.bround(1 + 9 * F.least("m", F.lit(1.0)), 2)).alias("importance"))
