"""One ranking from several differently-scaled scores: leximin over percentiles.

Each method's scores of a group become percentiles, so no method counts more for its range.
An item's percentiles, sorted ascending, form its vector, and vectors are compared
lexicographically: the weakest score decides first, so no strong score can mask a weak one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyroot.work import Workspace

#: Groups with more scores than this are ranked in many tasks.
HOT_ROWS = 2_000_000
SLICES = 256
#: Rows of a hot group are spread over so many tasks where they meet a row that stands for the whole group.
SALTS = 64


def method_name(col: str):
    """Spelling variants of a method are one: letter case, hyphens, spaces and underscores do not matter."""
    return F.regexp_replace(F.lower(F.trim(F.col(col))), r"[\s_\-]+", "")


def scored(hits: DataFrame, group: str, item: str, method: str, score: str) -> DataFrame:
    """(g, m, i, s): one score per group, method and item; null and NaN scores are none; of several the greatest."""
    s = F.col(score).cast("double")
    rows = hits.select(F.col(group).alias("g"), method_name(method).alias("m"), F.col(item).alias("i"), s.alias("s"))
    return rows.where("g is not null and m is not null and i is not null and s is not null and not isnan(s)").groupBy("g", "m", "i").agg(F.max("s").alias("s"))


def _spread(rows: DataFrame, few: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows joined with `few`, one row a key, whose rows are repeated for each salt so that no key is one task's work."""
    few = few.withColumn("_salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("i"), F.lit(SALTS)).cast("int")).join(few, [*keys, "_salt"], how).drop("_salt")


def _percentiles(rows: DataFrame) -> DataFrame:
    return rows.withColumn("p", F.cume_dist().over(Window.partitionBy("g", "m").orderBy("s")))


def _percentiles_sliced(rows: DataFrame) -> DataFrame:
    """The same for groups of any size: scores are cut into slices, ranked inside and offset by the slices below."""
    cuts = rows.groupBy("g", "m").agg(F.percentile_approx("s", [k / SLICES for k in range(1, SLICES)], 1000).alias("cuts"))
    cut = _spread(rows, cuts, ["g", "m"]).withColumn("c", F.size(F.filter("cuts", lambda x: x < F.col("s"))))
    # A score that very many items share stands at several cuts: its items are counted and spread, not sorted.
    cut = cut.withColumn("tie", F.size(F.filter("cuts", lambda x: x == F.col("s"))) > 1).drop("cuts")
    counted = cut.groupBy("g", "m", "c", "s", "tie").agg(F.count("*").alias("n"))
    inner = counted.withColumn("k", F.sum("n").over(Window.partitionBy("g", "m", "c").orderBy("s")))
    sizes = counted.groupBy("g", "m", "c").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("g", "m").orderBy("c")
    sizes = sizes.select("g", "m", "c", (F.sum("n").over(w) - F.col("n")).alias("below"), F.sum("n").over(Window.partitionBy("g", "m")).alias("all"))
    places = inner.join(sizes, ["g", "m", "c"]).select("g", "m", "s", "tie", ((F.col("k") + F.col("below")) / F.col("all")).alias("p"))
    salts = F.when(F.col("tie"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    places = places.select("g", "m", "s", "p", F.explode(salts).alias("salt"))
    salted = cut.withColumn("salt", F.when(F.col("tie"), F.pmod(F.xxhash64("i"), F.lit(SALTS)).cast("int")).otherwise(0))
    return salted.join(places, ["g", "m", "s", "salt"]).select("g", "m", "i", "s", "p")


def _vectors(rows: DataFrame, methods: DataFrame, spread: bool = False) -> DataFrame:
    """(g, i, v): percentiles ascending, with a zero for each method of the group that does not list the item."""
    per = rows.groupBy("g", "i").agg(F.sort_array(F.collect_list("p")).alias("v"))
    pad = F.array_repeat(F.lit(0.0), (F.col("n") - F.size("v")).cast("int"))
    both = _spread(per, methods, ["g"]) if spread else per.join(methods, "g")
    return both.select("g", "i", F.concat(pad, "v").alias("v"))


def leximin(hits: DataFrame, group: str, item: str, method: str, score: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(group, item, vector, place): the items of each group in leximin order, best first.

    A method's percentile of an item is the share of the method's scores in the group that are
    not above it; equal scores share it. Items with equal vectors stand in ascending order of
    the item. Rows without group, item, method or score (null or NaN) say nothing; repeated
    rows count once; an item that has no score at all does not appear. Other columns are
    ignored. An empty table gives an empty result.

    A group is small as a rule and is ranked by one task; all steps after the first
    aggregation then use one shuffle by group. Groups above `hot_rows` scores are cut into
    slices of scores and of vectors, so each slice is one task's work.
    """
    work = Workspace(hits.sparkSession, "leximin")
    rows = work.keep(scored(hits, group, item, method, score))
    hot = rows.groupBy("g").count().where(F.col("count") > hot_rows).select("g")
    any_hot = not hot.isEmpty()
    usual = (_spread(rows, hot, ["g"], "left_anti") if any_hot else rows).repartition("g")
    methods = usual.groupBy("g").agg(F.count_distinct("m").alias("n"))
    place = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("v"), "i"))
    out = _vectors(_percentiles(usual), methods).withColumn("place", place.cast("long"))
    if any_hot:
        large = work.keep(_spread(rows, hot, ["g"], "left_semi"))
        methods = large.select("g", "m").distinct().groupBy("g").agg(F.count("*").alias("n"))
        n = hits.sparkSession.conf.get("spark.sql.shuffle.partitions")
        ordered = _vectors(_percentiles_sliced(large), methods, True).repartitionByRange(int(n), F.col("g"), F.desc("v"), F.col("i"))
        ordered = work.keep(ordered.withColumn("c", F.spark_partition_id()))
        sizes = ordered.groupBy("g", "c").agg(F.count("*").alias("n"))
        sizes = sizes.select("g", "c", (F.sum("n").over(Window.partitionBy("g").orderBy("c")) - F.col("n")).alias("before"))
        inner = ordered.withColumn("k", F.row_number().over(Window.partitionBy("g", "c").orderBy(F.desc("v"), "i")))
        out = out.unionByName(inner.join(sizes, ["g", "c"]).select("g", "i", "v", (F.col("k") + F.col("before")).alias("place")))
    return out.select(F.col("g").alias(group), F.col("i").alias(item), F.col("v").alias("vector"), "place")
