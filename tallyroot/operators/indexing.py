"""Indexes over parts of the tree: their documents, which one covers a node, and lists of leaves and containers merged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyroot.functions.text import EXCLUDED, not_excluded, tokens
from tallyroot.operators.hierarchy import Hierarchy, ancestors
from tallyroot.operators.retrieval import top_k

#: Usetypes that no index holds, unless it is built with another list.
INDEX_EXCLUDED = [*EXCLUDED, "cell"]


def at_or_above(nodes: DataFrame, tree: Hierarchy, roots: DataFrame) -> DataFrame:
    """(id, root, distance): nodes with those of the roots (root) that they are or lie below."""
    few = roots.select(F.col("root").alias("id")).distinct()
    own = nodes.select("id").join(few, "id", "left_semi").select("id", F.col("id").alias("root"), F.lit(0).cast("long").alias("distance"))
    return ancestors(tree, among=few, sound=True).select("id", F.col("ancestor").alias("root"), "distance").unionByName(own)


def indexed(nodes: DataFrame, tree: Hierarchy, members: DataFrame, excluded: list[str] | None = None) -> DataFrame:
    """(index, doc, content): the documents of each index, once each however many of its members (index, root) hold them.

    Settled nodes in the members' subtrees, roots included, that have a token and no excluded usetype.
    nodes: (id, usetype, settled, content).
    """
    fit = nodes.where("settled = 'settled'").where(not_excluded(F.col("usetype"), INDEX_EXCLUDED if excluded is None else excluded))
    fit = fit.where(F.size(tokens(F.col("content"))) > 0)
    held = at_or_above(nodes, tree, members).join(members, "root").select("index", "id").distinct()
    return held.join(fit.select("id", "content"), "id").select("index", F.col("id").alias("doc"), "content")


def index_sizes(docs: DataFrame) -> DataFrame:
    """(index, n, n_tokens, avg): documents of each index and their lengths."""
    dl = docs.select("index", F.size(tokens(F.col("content"))).alias("dl"))
    return dl.groupBy("index").agg(F.count("*").alias("n"), F.sum("dl").alias("n_tokens"), F.avg("dl").alias("avg"))


def covering(nodes: DataFrame, tree: Hierarchy, members: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, index, root): for each asked node (id) the index whose member is the node or its nearest ancestor; ties: the smallest index."""
    over = at_or_above(nodes, tree, members).join(asked.select("id").distinct(), "id", "left_semi").join(members, "root")
    best = over.groupBy("id").agg(F.min(F.struct("distance", "index", "root")).alias("b"))
    return best.select("id", F.col("b.index").alias("index"), F.col("b.root").alias("root"))


def merged(limit: int, **lists: DataFrame) -> DataFrame:
    """(query, doc, score, rank, kind): several scored lists as one, cut again; a document of two lists counts with its better score."""
    both = None
    for kind, rows in lists.items():
        part = rows.select("query", "doc", "score", F.lit(kind).alias("kind"))
        both = part if both is None else both.unionByName(part)
    once = both.groupBy("query", "doc").agg(F.max(F.struct("score", "kind")).alias("b"))
    return top_k(once.select("query", "doc", F.col("b.score").alias("score"), F.col("b.kind").alias("kind")), limit)


def projected(hits: DataFrame, nodes: DataFrame, readable: DataFrame, how: str = "max", limit: int = 10) -> tuple[DataFrame, DataFrame]:
    """Hits (query, doc, score) by parent, and what became of them.

    (query, parent, score, best, hits, rank): the best `limit` parents of each query, ties by
    their best hit, then by id. (query, matched, no_parent, withheld): hits of a parent that may
    be read (id), without a parent, and of one that may not.
    """
    agg = {"max": F.max("score"), "sum": F.sum("score"), "count": F.count("*").cast("double")}
    if how not in agg:
        raise ValueError(f"no such aggregate: {how!r}")
    rows = hits.join(nodes.select(F.col("id").alias("doc"), F.col("parent_id").alias("parent")), "doc")
    rows = rows.join(readable.select(F.col("id").alias("parent"), F.lit(True).alias("ok")), "parent", "left")
    counts = rows.groupBy("query").agg(F.count_if("ok").alias("matched"), F.count_if(F.col("parent").isNull()).alias("no_parent"), F.count_if(F.col("parent").isNotNull() & F.col("ok").isNull()).alias("withheld"))
    per = rows.where("ok").groupBy("query", "parent").agg(agg[how].alias("score"), F.max("score").alias("best"), F.count("*").alias("hits"))
    ranked = top_k(per.withColumn("o", F.struct("score", "best")), limit, doc="parent", score="o").drop("o")
    return ranked, counts


def applied(**settings) -> dict:
    """What a search was run with, as it is told to its caller: settings that were given, nulls left out."""
    return {k: v for k, v in settings.items() if v is not None}
