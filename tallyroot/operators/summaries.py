"""Layers of clusters over vectors, and triples found by conjunctive filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyroot.operators.ann import ann_search, build_vector_index
from tallyroot.operators.graph import label_communities
from tallyroot.operators.hierarchy import Hierarchy
from tallyroot.operators.retrieval import nearest, top_k
from tallyroot.operators.views import effective_content
from tallyroot.work import Workspace


def mean_vectors(rows: DataFrame, group: str) -> DataFrame:
    """(group, v, n): the mean vector of each group, summed by position before the shuffle."""
    parts = rows.select(group, F.posexplode("v").alias("i", "x")).groupBy(group, "i").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    return parts.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("i", "x")))["x"].alias("v"), F.max("n").alias("n"))


def near_links(vectors: DataFrame, k: int, exact: bool = False) -> DataFrame:
    """(src, dst, weight): each vector (id long, v) and its k nearest others by cosine, if that is above 0.

    Through the inverted-file index, which probes as many cells as find RECALL of the true
    links; `exact`: in blocks of vectors that meet all others, so the work grows with the square
    of the rows.
    """
    if exact:
        found = nearest(vectors.select(F.col("id").alias("doc"), "v"), vectors.select(F.col("id").alias("q"), "v"), k + 1).withColumnRenamed("q", "query")
    else:
        index = build_vector_index(vectors.withColumnRenamed("id", "doc"), k=k)
        found = ann_search(index, vectors.withColumnRenamed("id", "query"), k + 1)
    near = top_k(found.select("query", "doc", "score").where("query <> doc"), k).where("score > 0")
    return near.select(F.col("query").alias("src"), F.col("doc").alias("dst"), F.col("score").alias("weight"))


def reassigned(level: DataFrame, labels: DataFrame, least: int = 2) -> DataFrame:
    """labels (id, community) in which members of clusters below `least` go to the cluster with the nearest mean; clusters stay if all are so small."""
    sizes = labels.groupBy("community").agg(F.count("*").alias("n"))
    small = labels.join(sizes.where(F.col("n") < least), "community", "left_semi").select("id")
    large = labels.join(sizes.where(F.col("n") >= least), "community", "left_semi")
    lost = level.join(small, "id", "left_semi")
    means = mean_vectors(level.join(large, "id"), "community").select(F.col("community").alias("doc"), "v")
    near = top_k(nearest(means, lost.select(F.col("id").alias("q"), "v"), 1).withColumnRenamed("q", "query"), 1)
    moved = near.select(F.col("query").alias("id"), F.col("doc").alias("new"))
    return labels.join(moved, "id", "left").select("id", F.coalesce("new", "community").alias("community"))


def layers(vectors: DataFrame, k: int = 8, k_step: int = 0, most: int = 5, exact: bool = False) -> DataFrame:
    """(layer, id, cluster): clusters of vectors (id long, v), then of the clusters' means, and so on.

    In each layer every vector is linked to its k + layer * k_step nearest (near_links), and clusters
    are the communities of those links; single vectors join the cluster with the nearest mean. A
    cluster is named by its smallest member and stands for its mean in the next layer. It stops
    at a single cluster, when nothing merges any more, or after `most` layers.
    """
    work = Workspace(vectors.sparkSession, "layers")
    level = work.keep(vectors.where("v is not null").select("id", F.transform("v", lambda x: x.cast("double")).alias("v")))
    out, size = None, level.count()
    for layer in range(most):
        if size < 2:
            break
        found = work.keep(label_communities(level, near_links(level, k + layer * k_step, exact)))
        labels = reassigned(level, found)
        named = labels.groupBy("community").agg(F.min("id").alias("name"))
        labels = work.keep(labels.join(named, "community").select("id", F.col("name").alias("community")))
        rows = labels.select(F.lit(layer).alias("layer"), "id", F.col("community").alias("cluster"))
        out = rows if out is None else out.unionByName(rows)
        merged = mean_vectors(level.join(labels, "id"), "community").select(F.col("community").alias("id"), "v")
        level = work.keep(merged)
        before, size = size, level.count()
        if size == before or size == 1:
            break
    if out is None:
        out = level.select(F.lit(0).alias("layer"), "id", F.col("id").alias("cluster"))
    return out


def rollup(nodes: DataFrame, tree: Hierarchy, window: int, summariser=None) -> DataFrame:
    """(id, text, how, size): a text for every container: its parts in tree order if they fit the window (characters), else a summary of them.

    summariser: a function from a text column to a text column, such as a pandas UDF around a
    model; without one, containers beyond the window are `deferred` and have no text.
    """
    whole = effective_content(nodes, tree)
    fits = F.col("size") <= window
    long = F.lit(None).cast("string") if summariser is None else summariser(F.col("text"))
    how = F.when(fits, "concatenated").otherwise("deferred" if summariser is None else "summarised")
    return whole.select("id", F.when(fits, F.col("text")).otherwise(long).alias("text"), how.alias("how"), "size")


def bridges(labels: DataFrame, near: DataFrame, least: float = 0.7) -> DataFrame:
    """(a, b, score): similar pairs (query, doc, score) that lie in different clusters (id, community)."""
    pairs = near.where(F.col("score") >= least).select(F.least("query", "doc").alias("a"), F.greatest("query", "doc").alias("b"), "score").where("a <> b")
    pairs = pairs.groupBy("a", "b").agg(F.max("score").alias("score"))
    ca, cb = labels.select(F.col("id").alias("a"), F.col("community").alias("ca")), labels.select(F.col("id").alias("b"), F.col("community").alias("cb"))
    return pairs.join(ca, "a").join(cb, "b").where("ca <> cb").select("a", "b", "score")


def find_facts(facts: DataFrame, entity: int | None = None, predicate: str | None = None, direction: str = "both", live: bool = True, moment=None, kind: str | None = None) -> DataFrame:
    """Facts that meet all given conditions: about an entity as subject (`out`), object (`in`) or either."""
    if direction not in ("out", "in", "both"):
        raise ValueError(f"no such direction: {direction!r}")
    if entity is not None:
        out, back = F.col("subject_id") == entity, (F.col("object") == str(entity)) & F.col("datatype").isNull()
        facts = facts.where(out if direction == "out" else back if direction == "in" else out | back)
    if predicate is not None:
        facts = facts.where(F.col("predicate") == predicate)
    if live:
        facts = facts.where("invalidated_at is null")
    if kind is not None:
        facts = facts.where(F.col("fact_type") == kind)
    if moment is not None:
        m = F.lit(moment)
        facts = facts.where((F.col("valid_from").isNull() | (F.col("valid_from") <= m)) & (F.col("valid_until").isNull() | (F.col("valid_until") >= m)))
    return facts
