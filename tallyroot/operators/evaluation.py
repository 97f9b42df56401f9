"""Retrieval metrics of ranked runs against graded judgments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def metrics(run: DataFrame, judgments: DataFrame, k: int = 10) -> DataFrame:
    """(query, ndcg, precision, recall, ap, rr) at k, one row for each judged query.

    run: (query, doc, rank) from 1; judgments: (query, doc, grade), relevant above 0. Linear
    gain; 0 where a query has nothing relevant. Recall is over all relevant documents, ap is
    divided by min(relevant, k).
    """
    rel = judgments.groupBy("query", "doc").agg(F.max("grade").alias("grade"))
    ideal = rel.where("grade > 0").withColumn("i", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("grade"), "doc")))
    best = ideal.groupBy("query").agg(F.sum(F.when(F.col("i") <= k, F.col("grade") / F.log2(F.col("i") + 1.0))).alias("idcg"), F.count("*").alias("relevant"))
    got = run.where(F.col("rank") <= k).join(rel, ["query", "doc"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    hit = (F.col("grade") > 0).cast("int")
    seen = F.sum(hit).over(Window.partitionBy("query").orderBy("rank"))
    got = got.withColumn("hit", hit).withColumn("seen", seen)
    per = got.groupBy("query").agg(
        F.sum(F.col("grade") / F.log2(F.col("rank") + 1.0)).alias("dcg"),
        F.sum("hit").alias("hits"),
        F.sum(F.when(F.col("hit") == 1, F.col("seen") / F.col("rank")).otherwise(0.0)).alias("aps"),
        F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"),
    )
    z = lambda x: F.coalesce(x, F.lit(0.0))
    every = rel.select("query").distinct().join(best, "query", "left").join(per, "query", "left")
    return every.select(
        "query",
        z(F.col("dcg") / F.col("idcg")).alias("ndcg"),
        z(F.col("hits") / F.lit(k)).alias("precision"),
        z(F.col("hits") / F.col("relevant")).alias("recall"),
        z(F.col("aps") / F.least("relevant", F.lit(k))).alias("ap"),
        z(1 / F.col("first")).alias("rr"),
    )


def means(per_query: DataFrame) -> DataFrame:
    """One row of means over the queries; an empty input is refused."""
    if per_query.isEmpty():
        raise ValueError("no query was judged")
    names = [c for c in per_query.columns if c != "query"]
    return per_query.agg(*[F.avg(c).alias(c) for c in names], F.count("*").alias("queries"))


def report(run: DataFrame, judgments: DataFrame, depth: int, k: int = 10, deep: int = 100) -> DataFrame:
    """One row: means of the metrics at k, and of the recall at `deep`, which is withheld (null) for runs of fewer than `deep` ranks."""
    near = means(metrics(run, judgments, k))
    if depth < deep:
        return near.withColumn(f"recall_{deep}", F.lit(None).cast("double"))
    far = means(metrics(run, judgments, deep)).select(F.col("recall").alias(f"recall_{deep}"))
    return near.crossJoin(far)  # one row each
