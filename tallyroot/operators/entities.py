"""Names resolved to entities, and entities joined that stand for the same thing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyroot.operators.alignment import similarity
from tallyroot.operators.graph import neighbours
from tallyroot.work import Workspace, ship

#: Similarity from which a title is taken for a name.
ALIKE = 0.8
#: Characters of a name by which titles are found for it.
PREFIX = 3


def _grams(titles: DataFrame, title: str) -> DataFrame:
    """titles with a row for each different run of one to PREFIX characters (`g`, lower case) of the title."""
    low = F.lower(F.col(title))
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(PREFIX)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - n + 1, F.lit(1))), lambda i: F.substr(low, i, n))))
    return titles.where(F.length(title) > 0).withColumn("g", F.explode(F.array_distinct(runs)))


def candidates(names: DataFrame, entities: DataFrame) -> DataFrame:
    """(name, id, root, title): entities (id, root, title) whose title begins like the name, by its first three characters, or holds it.

    Either way the title holds the name's beginning, so the two meet on that run of characters.
    """
    asked = names.where(F.length("name") > 0).select("name").distinct()
    asked = asked.withColumn("g", F.lower(F.substring("name", 1, PREFIX)))
    met = asked.join(_grams(entities.select("id", "root", "title"), "title"), "g")
    return met.where(F.lower("title").startswith(F.col("g")) | F.contains(F.lower("title"), F.lower("name"))).select("name", "id", "root", "title")


def _scored(pairs: DataFrame) -> DataFrame:
    ship(pairs.sparkSession)
    ratio = F.pandas_udf(lambda a, b: pd.Series([similarity(x, y) for x, y in zip(a, b)], dtype="float64"), "double")
    return pairs.withColumn("score", ratio("name", "title"))


def resolve(names: DataFrame, entities: DataFrame, threshold: float = ALIKE) -> DataFrame:
    """(name, id, score): for each name the entity with the most similar title, if that reaches the threshold; ties: the smallest id; null id for a new name.

    Names and titles are compared case-folded. Null and empty names are left out, repeated ones count once.
    """
    near = _scored(candidates(names, entities)).where(F.col("score") >= threshold)
    best = near.groupBy("name").agg(F.max(F.struct("score", (-F.col("id")).alias("i"))).alias("b"))
    asked = names.where(F.length("name") > 0).select("name").distinct()
    return asked.join(best, "name", "left").select("name", (-F.col("b.i")).alias("id"), F.col("b.score").alias("score"))


def copies_elsewhere(entities: DataFrame, threshold: float = ALIKE) -> DataFrame:
    """(source_id, target_id, link_type): each entity linked to its copy below every other root, the later one (greater id) to the earlier.

    A root has one entity for each thing, so of a root's titles that are similar enough only the
    best counts.
    """
    names = entities.select(F.col("id").alias("me"), F.col("root").alias("own"), F.col("title").alias("name"))
    pairs = candidates(entities.select(F.col("title").alias("name")), entities).join(names, "name").where((F.col("root") != F.col("own")) & (F.col("id") < F.col("me")))
    near = _scored(pairs).where(F.col("score") >= threshold)
    best = near.groupBy("me", "root").agg(F.max(F.struct("score", (-F.col("id")).alias("i"))).alias("b"))
    return best.select(F.col("me").alias("source_id"), (-F.col("b.i")).alias("target_id"), F.lit("rbac_coref").alias("link_type"))


def cluster(links: DataFrame, seed: DataFrame, types: tuple[str, ...] = ("same_as", "rbac_coref"), depth: int = 5, most: int = 200) -> DataFrame:
    """(id, hops): what a seed (id) stands for, along links of these types both ways. A closure that `depth` or `most` would cut is an error."""
    kept = links.where(F.col("link_type").isin(*types)).select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
    found = Workspace(links.sparkSession, "cluster").keep(neighbours(kept, seed, depth + 1).select("id", "hops"))
    n, far = found.agg(F.count("*"), F.max("hops")).first()
    if n > most or (far or 0) > depth:
        raise ValueError(f"more than {most} members or {depth} steps")
    return found


def facts_from_answers(answers: DataFrame, least: float = 0.5, most: int = 5) -> DataFrame:
    """(source_id, subject, predicate, object, confidence, place): facts read from a language model's answers (source_id, answer), JSON lists.

    The best `most` of each answer with a confidence of `least` or more; answers that are no such
    list give none. The model is the caller's.
    """
    form = "array<struct<subject:string,predicate:string,object:string,confidence:double>>"
    inner = F.regexp_extract("answer", r"(?s)(\[.*\])", 1)
    facts = F.filter(F.from_json(inner, form), lambda f: (F.coalesce(f["confidence"], F.lit(1.0)) >= least) & (F.length(f["subject"]) > 0) & (F.length(f["predicate"]) > 0) & (F.length(f["object"]) > 0))
    order = F.array_sort(F.transform(facts, lambda f, i: F.struct((-F.coalesce(f["confidence"], F.lit(1.0))).alias("c"), i.alias("i"), f.alias("f"))))
    rows = answers.select("source_id", F.posexplode(F.slice(order, 1, most)).alias("place", "x"))
    return rows.select("source_id", "x.f.subject", F.regexp_replace(F.lower(F.trim("x.f.predicate")), r"\s+", "_").alias("predicate"), "x.f.object", (-F.col("x.c")).alias("confidence"), "place")
