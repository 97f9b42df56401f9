"""The row in force among repeated deliveries of one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyroot.work import Workspace


def in_force(rows: DataFrame, key: str, order: str, keep: list[str]) -> DataFrame:
    """One row per key: the one with the greatest `order`, with the columns `keep`.

    A null `order` counts as the oldest. Among rows with the same `order` the greatest
    values of `keep`, compared column by column with null least, are taken, so the result
    does not depend on the order of arrival. Rows with a null key are no rows of any key and
    are left out. The maximum is taken before the shuffle, so a key with many repeats costs
    one row per map task.
    """
    cols = [c for c in dict.fromkeys(keep) if c not in (key, order)]
    best = F.max(F.struct(order, *cols)).alias("_best")
    out = rows.where(F.col(key).isNotNull()).groupBy(key).agg(best)
    return out.select(key, *[F.col(f"_best.{c}").alias(c) for c in dict.fromkeys(keep) if c != key])


def in_force_wide(rows: DataFrame, key: str, order: str, keep: list[str], work: Workspace) -> DataFrame:
    """The same as in_force, for rows with long texts most of whose keys stand once.

    Keys and orders alone tell which keys repeat; rows of the others are in force as they are,
    so only what repeats goes through the aggregation. The repeated keys are written first, so
    that Spark knows their size: it broadcasts them where they are few, else the join is one
    shuffle, as in_force has.
    """
    cols = [c for c in dict.fromkeys(keep) if c not in (key, order)]
    some = rows.where(F.col(key).isNotNull())
    repeated = some.groupBy(key).agg(F.max(order).alias("_u"), F.count("*").alias("_n")).where("_n > 1").select(F.col(key).alias("_k"), "_u", F.lit(True).alias("_many"))
    repeated = work.keep(repeated)
    joined = some.select(*dict.fromkeys([key, order, *cols])).join(repeated, F.col(key) == F.col("_k"), "left")
    picked = [key, *[c for c in dict.fromkeys(keep) if c != key]]
    once = joined.where("_many is null").select(*picked)
    last = joined.where("_many").where(F.col(order).eqNullSafe(F.col("_u")))
    return once.unionByName(in_force(last, key, order, keep).select(*picked))
