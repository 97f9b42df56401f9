"""Derived rows and checks: rules over facts, paths between nodes, anti-joins for what is outstanding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyroot.operators.facts import not_held
from tallyroot.operators.graph import neighbours
from tallyroot.work import Workspace


def apply_rule(facts: DataFrame, name: str, first: str, second: str | None, result: str, now) -> DataFrame:
    """facts with the rule's own rows replaced by a fresh derivation.

    The rule: x `first` y and y `second` z give x `result` z; without a second, x `first` y gives
    x `result` y. It is applied once to live facts that the rule did not derive itself; what is
    held already is not added again. facts need `derived_by`.
    """
    given = facts.where(~F.col("derived_by").eqNullSafe(F.lit(name)))
    live = given.where("invalidated_at is null")
    a = live.where(F.col("predicate") == first)
    if second is None:
        new = a.select("subject_id", "object", "datatype")
    else:
        b = live.where((F.col("predicate") == second)).select(F.col("subject_id").cast("string").alias("_mid"), F.col("object").alias("_o"), F.col("datatype").alias("_d"))
        new = a.where("datatype is null").join(b, F.col("object") == F.col("_mid")).select("subject_id", F.col("_o").alias("object"), F.col("_d").alias("datatype"))
    new = not_held(new.distinct().withColumn("predicate", F.lit(result)), live)
    new = new.withColumns({"derived_by": F.lit(name), "recorded_at": F.lit(now)})
    return given.unionByName(new, allowMissingColumns=True)


def rederived_links(links: DataFrame, fresh: DataFrame, producer: str) -> DataFrame:
    """links with the producer's own replaced by the fresh ones (source_id, target_id, link_type, score); refused where another's link is in the way."""
    key = ["source_id", "target_id", "link_type"]
    others = links.where(~F.col("produced_by").eqNullSafe(F.lit(producer)))
    clash = fresh.join(others.select(*key), key, "left_semi").limit(1).collect()
    if clash:
        raise ValueError(f"held by another producer: {tuple(clash[0][c] for c in key)}")
    return others.unionByName(fresh.dropDuplicates(key).withColumn("produced_by", F.lit(producer)), allowMissingColumns=True)


def outstanding(docs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Documents that have no row in `done` yet."""
    return docs.join(done.select(key), key, "left_anti")


def orphans(blobs: DataFrame, holders: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Blobs that nothing holds, and holders whose blob is gone."""
    return blobs.join(holders.select(key), key, "left_anti"), holders.where(F.col(key).isNotNull()).join(blobs.select(key), key, "left_anti")


def back_references(links: DataFrame, facts: DataFrame) -> DataFrame:
    """(id, source, kind, name): what points at each node, by links and by live facts."""
    a = links.select(F.col("target_id").alias("id"), F.col("source_id").alias("source"), F.lit("link").alias("kind"), F.col("link_type").alias("name"))
    live = facts.where("invalidated_at is null and datatype is null")
    return a.unionByName(live.select(F.col("object").try_cast("long").alias("id"), F.col("subject_id").alias("source"), F.lit("fact").alias("kind"), F.col("predicate").alias("name")).where("id is not null"))


def paths_between(edges: DataFrame, source: int, target: int, hops: int = 5, k: int = 5) -> DataFrame:
    """(path, length, place): the k shortest simple paths, edges walked both ways; ties by the path's ids.

    Distances from both ends come first; only nodes on some walk of at most `hops` steps are
    then followed, and never one that is too far from the target for the steps left.
    """
    spark = edges.sparkSession
    work = Workspace(spark, "paths")
    ends = lambda x: spark.createDataFrame([(x,)], "id long")
    away = neighbours(edges, ends(source), hops).select("id", F.col("hops").alias("a"))
    left = neighbours(edges, ends(target), hops).select("id", F.col("hops").alias("b"))
    near = work.keep(away.join(left, "id").where(F.col("a") + F.col("b") <= hops))
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()
    step = work.keep(both.join(near.select(F.col("id").alias("src")), "src", "left_semi").join(near.select(F.col("id").alias("dst"), "b"), "dst"))
    front = near.where(F.col("id") == source).select(F.array("id").alias("path"))
    done = front.where(F.lit(source) == F.lit(target))
    for hop in range(1, hops + 1):
        front = front.where(F.element_at("path", -1) != target).withColumn("src", F.element_at("path", -1)).join(step, "src").where(~F.array_contains("path", F.col("dst")) & (F.col("b") <= hops - hop))
        front = work.keep(front.select(F.concat("path", F.array("dst")).alias("path")))
        done = done.unionByName(front.where(F.element_at("path", -1) == target))
        if front.isEmpty() or done.limit(k).count() >= k:
            break
    best = done.select("path", (F.size("path") - 1).alias("length"))
    return best.orderBy("length", "path").limit(k).withColumn("place", F.row_number().over(Window.orderBy("length", "path")))


def context_blocks(hits: DataFrame) -> DataFrame:
    """(query, text): `[Source i: title (id, score)]` blocks of ranked hits (query, rank, id, title, score, content), joined by blank lines."""
    head = F.concat(F.lit("[Source "), F.col("rank").cast("string"), F.lit(": "), F.coalesce("title", F.lit("untitled")), F.lit(" ("), F.col("id").cast("string"), F.lit(", "), F.format_number("score", 3), F.lit(")]\n"), F.coalesce("content", F.lit("")))
    return hits.groupBy("query").agg(F.array_join(F.sort_array(F.collect_list(F.struct("rank", head.alias("t"))))["t"], "\n\n").alias("text"))
