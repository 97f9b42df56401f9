"""All similar pairs between set-valued records, by T-occurrence list merging.

Two sets of similarity theta or more share at least T of their values, T following from their
sizes. Large sets are first split by a hash of the values into small universes, as many as
leave some dozens of values in each: sets that are similar as a whole are similar in at least one
universe, so only there a pair has to be found, and what is sent grows with the sizes of the sets and
not with their squares. In a universe the inverted lists are partitioned: a set goes to the partitions of
its rarest values, enough of them that two similar sets must meet in one. Inside a partition
each record probes the lists of its values: the longest lists are set aside, the others are
merged with a heap that skips over records which cannot reach T, and what passes is looked up
in the long lists by binary search. A pair is reported only in the partition of the rarest
value it shares; pairs of sets that were split are counted again over the whole sets.

Before that, records with equal sets become one class, values of one record only are counted
but not carried, and a set that shares too few values with anything is dropped, so the
work follows the number of near matches and not the number of values.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyroot.work import Workspace

THRESHOLD = 0.7
#: Records of one partition and value above which they are joined in blocks.
BLOCK = 20_000
#: Values that a universe is to hold of a set.
UNIVERSE = 48
#: Members of a class that one task pairs with all others of it.
MEMBERS = 2_000


def normal_value(v: Column) -> Column:
    """The value as compared: lower case, single spaces, no thousands commas, no `.0` of whole numbers; null if blank."""
    x = F.trim(F.regexp_replace(F.lower(v), r"[\s\u00a0\u2007\u202f]+", " "))
    x = F.when(x.rlike(r"^[+-]?\d{1,3}(,\d{3})+(\.\d+)?$"), F.replace(x, F.lit(","), F.lit(""))).otherwise(x)
    x = F.when(x.rlike(r"^[+-]?\d+\.0+$"), F.regexp_replace(x, r"\.0+$", "")).otherwise(x)
    return F.when(x != "", x)


def value_sets(rows: DataFrame, key: str, values: str) -> DataFrame:
    """(k, h, n): the distinct normal values of each record as sorted 64-bit hashes, and their number."""
    v = F.array_distinct(F.filter(F.transform(values, normal_value), lambda x: x.isNotNull()))
    return rows.select(F.col(key).alias("k"), F.array_sort(F.transform(v, lambda x: F.xxhash64(x))).alias("h")).select("k", "h", F.size("h").alias("n"))


def need(n: np.ndarray | int, theta: float):
    """Values a set of n must share with any set of similarity theta or more."""
    return np.ceil(np.asarray(n) * theta - 1e-9).astype("int64")


def _required(n: int, m: int, theta: float) -> int:
    return math.ceil(theta / (1 + theta) * (n + m) - 1e-9)


def merge(probe: list[list[int]], need_short: int) -> list[int]:
    """Records that stand in at least `need_short` of the ascending lists (heap merge with skipping)."""
    heap = [(lst[0], i, 0) for i, lst in enumerate(probe) if lst]
    heapq.heapify(heap)
    found = []
    while len(heap) >= need_short:
        top = heap[0][0]
        popped = []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap))
        if len(popped) >= need_short:
            found.append(top)
            target = top + 1
        else:
            # Records below the need_short-th smallest head cannot be in enough lists.
            while heap and len(popped) < need_short - 1:
                popped.append(heapq.heappop(heap))
            if not heap:
                break
            target = max(heap[0][0], top + 1)
        for _, i, at in popped:
            lst = probe[i]
            at = bisect_left(lst, target, at)
            if at < len(lst):
                heapq.heappush(heap, (lst[at], i, at))
    return found


def similar_in(records: list[tuple[int, int, list[int], list[int]]], theta: float) -> list[tuple[int, int, int]]:
    """(i, j, overlap) over records (class, n, values by rarity, own keys), by probing inverted lists.

    Records are numbered by size; each probes those before it that are not too small.
    """
    order = sorted(range(len(records)), key=lambda r: (records[r][1], records[r][0]))
    sizes = [records[r][1] for r in order]
    lists: dict[int, list[int]] = defaultdict(list)
    out = []
    for at, r in enumerate(order):
        _, n, values, _ = records[r]
        low = bisect_left(sizes, int(need(n, theta)), 0, at)
        probe = [lst for v in values if (lst := lists.get(v)) and lst[-1] >= low]
        # The smallest partner asks for the least overlap.
        least = _required(n, max(sizes[low], 1), theta) if low < at else n + 1
        if low < at and len(probe) >= least:
            probe.sort(key=len)
            # As many of the longest lists are set aside as pays off by their length.
            aside = min(least - 1, int(least / (0.02 * math.log2(len(probe[-1]) + 1) + 1)))
            short, long = probe[: len(probe) - aside], probe[len(probe) - aside :]
            for c in merge([lst if lst[0] >= low else lst[bisect_left(lst, low) :] for lst in short], least - aside):
                overlap = sum(1 for lst in short + long if (p := bisect_left(lst, c)) < len(lst) and lst[p] == c)
                if overlap >= _required(n, sizes[c], theta):
                    out.append((order[c], r, overlap))
        for v in values:
            lists[v].append(at)
    return out


def _groups(batches):
    """Runs of rows with one (part, side, u), one after the other; rows come sorted by them."""
    key, records = None, []
    for frame in batches:
        for part, side, u, band, c, n, h, keys in zip(frame["part"], frame["side"], frame["u"], frame["band"], frame["c"], frame["n"], frame["h"], frame["keys"]):
            if (part, side, u) != key:
                if len(records) > 1:
                    yield key, records
                key, records = (part, side, u), []
            records.append((c, n, h.tolist(), keys.tolist(), band))
    if len(records) > 1:
        yield key, records


def _probe(theta: float, parts: int):
    columns = ["side", "u", "a", "b", "shared", "together"]

    def run(batches):
        rows = []
        for (part, side, u), records in _groups(batches):
            for i, j, overlap in similar_in([r[:4] for r in records], theta):
                a, b = records[i], records[j]
                if a[4] == b[4] != side:
                    continue  # two sets of one band belong to their own side
                shared = set(b[3])
                first = next((v for v in a[3] if v in shared), None)
                # The pair belongs to the partition of the rarest value that both list among their keys.
                if first is not None and first % parts == part:
                    rows.append((side, u, min(a[0], b[0]), max(a[0], b[0]), overlap, a[1] + b[1] - overlap))
            if len(rows) > 50_000:
                yield pd.DataFrame(rows, columns=columns)
                rows = []
        yield pd.DataFrame(rows, columns=columns)

    return run


def similar_sets(sets: DataFrame, theta: float = THRESHOLD, least: int = 1, parts: int = 4096) -> tuple[DataFrame, DataFrame]:
    """Pairs of similar classes, and the classes: (a, b, shared, together) and (k, class, n).

    `sets`: (k, h, n) with h an array of distinct longs. Records with equal sets are one class,
    named by its smallest key; similarity is shared / together (Jaccard). Sets of fewer than `least`
    values, and null ones, are in no class and no pair. A key should stand once; repeats of a
    key with the same set count once. An empty table gives empty results.
    """
    spark = sets.sparkSession
    work = Workspace(spark, "setjoin")
    rows = work.keep(sets.where(F.col("n") >= least).select("k", "h", "n", F.xxhash64(F.array_sort("h")).alias("x"), F.xxhash64(F.reverse(F.array_sort("h")), F.lit(7)).alias("y")))
    ids = rows.groupBy("x", "y").agg(F.min("k").alias("c"))
    members = work.keep(rows.select("k", "n", "x", "y").distinct().join(ids, ["x", "y"]).select("k", F.col("c").alias("class"), "n"))
    reps = rows.join(members.where("k = class").select("k").distinct(), "k", "left_semi").dropDuplicates(["k"]).select(F.col("k").alias("c"), "n", "h")
    reps = work.keep(reps)
    # Values of one class only cannot be shared: they count in n and are not carried. A pair's
    # sizes are within theta of each other: a band of sizes meets itself and the next. Each band
    # is probed with the next one; a pair inside a band is found in its own side only.
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(1 / theta) + 1e-9).cast("int")
    values = reps.select("c", "n", band.alias("band"), F.explode("h").alias("v"))
    df = values.groupBy("v").agg(F.count("*").alias("df"))
    sides = values.join(df, "v").select("c", "n", "band", "v", "df", F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("side"))
    # The most values that a set of the side can have decide on its number of universes.
    universes = F.ceil(F.pow(F.lit(1 / theta), F.col("side") + 2) / F.lit(UNIVERSE)).cast("int")
    placed = sides.withColumn("u", F.pmod(F.xxhash64("v", F.lit(3)), F.greatest(universes, F.lit(1))).cast("int"))
    kept = placed.groupBy("c", "side", "u").agg(F.count("*").cast("int").alias("m"), F.first("band").alias("band"), F.sort_array(F.collect_list(F.when(F.col("df") > 1, F.struct("df", "v")))).alias("s"))
    lowest = F.ceil(F.col("m") * F.lit(theta) - 1e-9).cast("int")
    keyed = kept.where(F.size("s") >= lowest).select("c", "side", "u", "band", F.col("m").alias("n"), F.col("s.v").alias("h"), lowest.alias("low"))
    keyed = keyed.withColumn("keys", F.slice("h", 1, F.size("h") - F.col("low") + 1)).drop("low")
    keyed = work.keep(keyed.withColumn("part", F.explode(F.array_distinct(F.transform("keys", lambda v: F.pmod(v, F.lit(parts)))))))
    found = work.keep(_pairs(keyed, theta, parts, work))
    sizes = reps.select("c", "n", "h")
    split = found.where("u > 0 or universes > 1").select("a", "b").distinct()
    a, b = sizes.select(F.col("c").alias("a"), F.col("n").alias("na"), F.col("h").alias("ha")), sizes.select(F.col("c").alias("b"), F.col("n").alias("nb"), F.col("h").alias("hb"))
    again = split.join(a, "a").join(b, "b").withColumn("shared", F.size(F.array_intersect("ha", "hb")))
    again = again.withColumn("together", F.col("na") + F.col("nb") - F.col("shared")).where(F.col("shared") >= F.lit(theta) * F.col("together") - 1e-9)
    whole = found.where("universes = 1").select("a", "b", "shared", "together").distinct()
    return whole.unionByName(again.select("a", "b", "shared", "together")), members


def _pairs(sided: DataFrame, theta: float, parts: int, work: Workspace) -> DataFrame:
    """(side, u, universes, a, b, shared, together): similar pairs of each universe, each once or a few times."""
    universes = F.greatest(F.ceil(F.pow(F.lit(1 / theta), F.col("side") + 2) / F.lit(UNIVERSE)).cast("int"), F.lit(1))
    schema = "side int, u int, a long, b long, shared int, together int"
    group = ["part", "side", "u"]
    hot = work.keep(sided.groupBy(*group).count().where(F.col("count") > BLOCK))
    usual = sided
    blocks = None
    if not hot.isEmpty():
        # Large groups are joined block by block: every pair of blocks is a group of its own.
        b = F.greatest(F.ceil(F.col("count") / F.lit(BLOCK // 2)), F.lit(2)).cast("int")
        sized = sided.join(hot.withColumn("blocks", b).drop("count"), group)
        own = F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int")
        both = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(F.least(i, own).alias("i"), F.greatest(i, own).alias("j")))
        blocks = sized.withColumn("pair", F.explode(both)).select(*group, "band", "c", "n", "h", "keys", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"))
        usual = sided.join(hot.select(*group), group, "left_anti")
    columns = [*group, "band", "c", "n", "h", "keys"]
    found = usual.select(*columns).repartition(*group).sortWithinPartitions(*group).mapInPandas(_probe(theta, parts), schema)
    if blocks is not None:
        per = blocks.groupBy(*group, "i", "j").applyInPandas(lambda f: pd.concat(_probe(theta, parts)(iter([f]))), schema)
        found = found.unionByName(per)
    return found.withColumn("universes", universes)


def sketch_sets(rows: DataFrame, key: str, sketch: str, recipe: list[str], size: str) -> DataFrame:
    """(k, h, n, size): each sketch as the set of its (recipe, position, least value) triples.

    Two sketches of one recipe share as many triples as they have equal positions; sketches of
    different recipes share none.
    """
    triple = F.transform(F.col(sketch), lambda v, i: F.xxhash64(*[F.col(c) for c in recipe], i, v))
    return rows.select(F.col(key).alias("k"), triple.alias("h"), F.size(sketch).alias("n"), F.col(size).alias("size"))


def expand(pairs: DataFrame, members: DataFrame, least: int) -> DataFrame:
    """(column_id_a, column_id_b): every pair of records, smaller key first, from class pairs and classes.

    Classes of more than MEMBERS records are cut into blocks, each of which meets the whole
    other class in a task of its own.
    """
    sizes = members.groupBy("class").agg(F.ceil(F.count("*") / F.lit(MEMBERS)).cast("int").alias("blocks"))
    sized = members.select("class", "k").join(sizes, "class")
    one = sized.where("blocks > 0").select(F.col("class").alias("a"), F.col("k").alias("ka"), F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int").alias("block"))
    every = sized.select(F.col("class").alias("b"), F.col("k").alias("kb"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    within = one.join(every, [one.a == every.b, one.block == every.block]).where("ka < kb")
    left = pairs.select("a", "b").join(one.drop("block"), "a").join(sizes.withColumnRenamed("class", "b"), "b")
    left = left.select("b", "ka", F.pmod(F.xxhash64("ka"), F.col("blocks")).cast("int").alias("block"))
    across = left.join(every, ["b", "block"])
    both = across.select("ka", "kb").unionByName(within.select("ka", "kb"))
    return both.select(F.least("ka", "kb").alias("column_id_a"), F.greatest("ka", "kb").alias("column_id_b"))


def similar_columns(columns: DataFrame, theta: float = THRESHOLD, least: int = 8) -> DataFrame:
    """(column_id_a, column_id_b): pairs of columns whose value sets have a similarity of theta or more.

    Columns with `has_values` are compared by their values, columns without values by their
    sketches, where the share of equal positions stands for the similarity; the two kinds are
    not compared with each other. Both columns need `least` distinct values. Repeated rows of a
    column: the one profiled last is in force. Null ids, null values and null sketches are left
    out; extra columns are not read.
    """
    from tallyroot.operators.current import in_force

    cols = ["column_values", "sketch", "sketch_count", "sketch_num_perm", "sketch_seed"]
    cur = in_force(columns, "column_id", "profiled_at", cols)
    work = Workspace(columns.sparkSession, "columns")
    cur = work.keep(cur)
    valued = value_sets(cur.where("column_values is not null"), "column_id", "column_values")
    pairs, members = similar_sets(valued, theta, least)
    found = expand(pairs, members, least)
    only = cur.where("column_values is null and sketch is not null and size(sketch) > 0")
    only = sketch_sets(only, "column_id", "sketch", ["sketch_num_perm", "sketch_seed"], "sketch_count").where(F.col("size") >= least)
    # Equal positions e of n make theta: the sets of triples then have a similarity of e / (2n - e).
    pairs, members = similar_sets(only.select("k", "h", "n"), theta / (2 - theta), 1)
    return found.unionByName(expand(pairs, members, 1))
