"""Approximate nearest neighbours: an inverted file of cells around centroids.

The centroids are fitted on a bounded sample; every row is indexed. A query looks into its
nearest cells only; cells are cut into shares by a hash, so a full cell is many tasks' work.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyroot.operators.retrieval import dot, nearest, normalise, top_k
from tallyroot.work import Workspace

#: Rows that the centroids are fitted on, at most: those with the least hashes of their keys.
SAMPLE_ROWS = 20_000
SHARES = 8


#: An index has about as many cells as the square root of its rows, within these bounds.
LEAST_CELLS, MOST_CELLS = 8, 4096
#: Rows that are looked up exactly to find how many cells must be probed for the recall, and that recall.
TUNE_ROWS, RECALL = 256, 0.95


@dataclass
class VectorIndex:
    """rows: (doc, v, cell, share) with v at unit length; centroids: at most MOST_CELLS vectors; probes: cells to look into."""

    rows: DataFrame
    centroids: np.ndarray
    probes: int = 1


def fit_centroids(x: np.ndarray, cells: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """k-means by cosine; an empty cell takes the row that fits its own cell worst."""
    rnd = np.random.default_rng(seed)
    c = x[rnd.permutation(len(x))[:cells]].copy()
    for _ in range(rounds):
        s = x @ c.T
        at = s.argmax(axis=1)
        for i in range(len(c)):
            own = x[at == i]
            c[i] = own.sum(axis=0) if len(own) else x[s.max(axis=1).argmin()]
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def _cells(shared, probes: int, key: str):
    def run(batches):
        for frame in batches:
            if len(frame):
                x = np.asarray(frame["v"].tolist(), dtype="float64")
                near = np.argsort(-(x @ shared.value.T), axis=1, kind="stable")[:, :probes]
                yield pd.DataFrame({key: frame[key].to_numpy(), "v": frame["v"], "cells": near.astype("int32").tolist()})

    return run


def build_vector_index(docs: DataFrame, cells: int | None = None, sample_rows: int = SAMPLE_ROWS, k: int = 10, target: float = RECALL) -> VectorIndex:
    """The index of documents (doc long, v). Null vectors, and those of length 0, are left out.

    The centroids are fitted on `sample_rows` rows. How many cells a search probes is measured:
    TUNE_ROWS rows are searched exactly, and as many cells are probed as hold the share
    `target` of their k nearest.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "ann")
    unit = docs.where("doc is not null").select(F.col("doc").cast("long").alias("doc"), normalise(F.col("v")).alias("v")).where("v is not null")
    sample = [r.v for r in unit.orderBy(F.xxhash64("doc"), "doc").limit(sample_rows).select("v").collect()]
    if not sample:
        return VectorIndex(work.keep(unit.withColumns({"cell": F.lit(0), "share": F.lit(0)})), np.zeros((0, 1)))
    if cells is None:
        cells = int(min(MOST_CELLS, max(LEAST_CELLS, unit.count() ** 0.5)))
    centroids = fit_centroids(np.array(sample, dtype="float64"), min(cells, len(sample)))
    shared = spark.sparkContext.broadcast(centroids)
    placed = unit.mapInPandas(_cells(shared, 1, "doc"), "doc long, v array<double>, cells array<int>")
    rows = placed.select("doc", "v", F.element_at("cells", 1).alias("cell"), F.pmod(F.xxhash64("doc"), F.lit(SHARES)).cast("int").alias("share"))
    index = VectorIndex(work.keep(rows), centroids)
    tune = index.rows.orderBy(F.xxhash64("doc", F.lit(3)), "doc").limit(TUNE_ROWS).select(F.col("doc").alias("query"), "v")
    index.probes = enough_probes(index, tune, k, target)
    return index


def enough_probes(index: VectorIndex, queries: DataFrame, k: int, target: float) -> int:
    """How many of a query's nearest cells hold the share `target` of the true k nearest of these queries (query long, v), a bounded set."""
    shared = index.rows.sparkSession.sparkContext.broadcast(index.centroids)
    queries = Workspace(index.rows.sparkSession, "tune").keep(queries)
    truth = top_k(nearest(index.rows.select("doc", "v"), queries.select(F.col("query").alias("q"), "v"), k + 1).withColumnRenamed("q", "query").where("query <> doc"), k)
    order = queries.mapInPandas(_cells(shared, len(index.centroids), "query"), "query long, v array<double>, cells array<int>").select("query", "cells")
    held = truth.join(index.rows.select("doc", "cell"), "doc").join(order, "query").select(F.array_position("cells", F.col("cell")).alias("at"))
    at = sorted(r[0] for r in held.collect())  # k for each of the queries
    return int(at[min(len(at) - 1, int(np.ceil(target * len(at))) - 1)]) if at else 1


def ann_search(index: VectorIndex, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """(query, doc, score, rank): the k best by cosine among the documents of each query's nearest `probes` cells; by default as many as the index was measured to need.

    queries: (query long, v), a stated set. The best k of each share of a cell are taken before
    anything is shuffled by query.
    """
    spark = queries.sparkSession
    probes = probes or index.probes
    unit = queries.where("query is not null").select(F.col("query").cast("long").alias("query"), normalise(F.col("v")).alias("v")).where("v is not null")
    if not len(index.centroids):
        return top_k(index.rows.join(unit.select("query", F.col("v").alias("qv")).limit(0), F.lit(False)).select("query", "doc", F.lit(0.0).alias("score")), k)
    shared = spark.sparkContext.broadcast(index.centroids)
    asked = unit.mapInPandas(_cells(shared, probes, "query"), "query long, v array<double>, cells array<int>")
    asked = asked.select("query", F.col("v").alias("qv"), F.explode("cells").alias("cell")).withColumn("share", F.explode(F.array(*map(F.lit, range(SHARES)))))
    scored = index.rows.join(asked, ["cell", "share"]).select("cell", "share", "query", "doc", dot(F.col("v"), F.col("qv")).alias("score"))
    w = Window.partitionBy("cell", "share", "query").orderBy(F.desc("score"), "doc")
    near = scored.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("query", "doc", "score")
    return top_k(near, k)


def recall(found: DataFrame, truth: DataFrame) -> float:
    """The share of the true (query, doc) pairs that were found."""
    n = truth.count()
    return truth.join(found.select("query", "doc"), ["query", "doc"], "left_semi").count() / n if n else 1.0


def mmr(rows: DataFrame, group: str, key: str, vector: str, relevance: str, k: int = 50, balance: float = 0.5) -> DataFrame:
    """(group, key, pick): up to k rows of each group by maximal marginal relevance.

    Each pick has the greatest balance * relevance - (1 - balance) * greatest similarity to the
    earlier picks; relevance counts by its rank within the group. Null vectors are left out. One
    group, the tokens of one text, is one task's work.
    """
    kinds = dict(rows.dtypes)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(key).reset_index(drop=True)
        x = np.array(frame[vector].tolist(), dtype="float64")
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        n = len(frame)
        value = frame[relevance].rank(method="average").to_numpy() / n
        worst, picked = np.full(n, -np.inf), []
        for _ in range(min(k, n)):
            score = balance * value - (1 - balance) * np.where(np.isfinite(worst), worst, 0.0)
            score[picked] = -np.inf
            i = int(score.argmax())
            picked.append(i)
            worst = np.maximum(worst, x @ x[i])
        return pd.DataFrame({group: frame[group].to_numpy()[picked], key: frame[key].to_numpy()[picked], "pick": np.arange(len(picked), dtype="int32")})

    Workspace(rows.sparkSession, "mmr")
    some = rows.where(F.col(vector).isNotNull() & F.col(group).isNotNull() & F.col(relevance).isNotNull()).select(group, key, vector, relevance)
    return some.groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, {key} {kinds[key]}, pick int")
