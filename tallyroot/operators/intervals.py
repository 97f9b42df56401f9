"""Overlaps between intervals of two tables, by buckets instead of a join on inequalities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlaps(a: DataFrame, b: DataFrame, group: str, width: int) -> DataFrame:
    """(a, b, start, stop): pairs with a common stretch; a, b: (id, group, start, stop), start < stop, stop exclusive.

    Intervals are cut at multiples of `width`; both sides meet in the buckets they touch, and a
    pair is reported only in the bucket where its common stretch begins. Choose the width near
    the usual length, so that an interval touches few buckets.
    """

    def cut(t: DataFrame, side: str) -> DataFrame:
        t = t.where(F.col("start") < F.col("stop"))
        buckets = F.sequence(F.floor(F.col("start") / width), F.floor((F.col("stop") - 1) / width))
        return t.select(F.col("id").alias(side), group, F.col("start").alias(f"{side}s"), F.col("stop").alias(f"{side}e"), F.explode(buckets).alias("bucket"))

    both = cut(a, "a").join(cut(b, "b"), [group, "bucket"]).where("`as` < be and bs < ae")
    start = F.greatest("as", "bs")
    return both.where(F.floor(start / width) == F.col("bucket")).select("a", "b", start.alias("start"), F.least("ae", "be").alias("stop"))


def places_on_pages(spans: DataFrame, blocks: DataFrame, group: str, width: int) -> DataFrame:
    """(a, page, left, top, right, bottom, blocks): for each span the first page it touches and the box around its blocks there.

    spans: (id, group, start, stop); blocks: the same and (page, left, top, right, bottom).
    """
    met = overlaps(spans, blocks, group, width).select("a", "b")
    held = met.join(blocks.select(F.col("id").alias("b"), "page", "left", "top", "right", "bottom"), "b")
    first = held.groupBy("a").agg(F.min("page").alias("page"))
    box = [F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom"), F.count("*").alias("blocks")]
    return held.join(first, ["a", "page"]).groupBy("a", "page").agg(*box)
