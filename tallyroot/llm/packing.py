"""Filling fixed-capacity containers: shortest-pack-first over the length histogram.

Only the number of items of each length reaches the driver, at most `capacity` numbers. There,
lengths are placed longest first, and each item goes to the pack with the most room left; if
that one cannot hold it, none can, and a new pack is begun. Packs that are filled alike are one
pattern with a number of packs, so whole counts move at once. Items find their pack by their
rank within their length.
"""

from __future__ import annotations

from bisect import insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyroot.work import Workspace

CAPACITY = 4096
#: Ranks and lengths share one long while an item looks for its pack.
RANK_BITS, MOST_CAPACITY = 40, 1 << 22
RANK_BUCKETS = 256


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """([(length, times), ...], packs): patterns that together use every item of the histogram once.

    A pattern is a chain (before, length, times), so that patterns share their beginnings. Each
    length adds three patterns at most: those that did and did not get an item of it where it ran
    out, and the last new pack.
    """
    rooms: list[int] = []  # the different rooms of the open packs, ascending
    open_: dict[int, list[tuple]] = {}  # room -> [(chain, packs)]

    def put(room: int, chain: tuple, packs: int) -> None:
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append((chain, packs))

    def longer(chain: tuple, length: int, times: int) -> tuple:
        before, last, n = chain
        return (before, last, n + times) if last == length else (chain, length, times)

    for length in sorted((x for x in histogram if x > 0), reverse=True):
        left = histogram[length]
        while left:
            if not rooms or rooms[-1] < length:
                # New packs: each stays the one with the most room until it cannot hold another.
                each = capacity // length
                full, rest = divmod(left, each)
                if full:
                    put(capacity - each * length, (None, length, each), full)
                if rest:
                    put(capacity - rest * length, (None, length, rest), 1)
                break
            room = rooms.pop()
            group = open_.pop(room)
            below = rooms[-1] if rooms else 0
            packs = sum(n for _, n in group)
            # Rounds in which these packs, all of them, have more room than any other.
            rounds = min(max(1, -(-(room - below) // length)), room // length, left // packs)
            if rounds:
                for chain, n in group:
                    put(room - rounds * length, longer(chain, length, rounds), n)
                left -= rounds * packs
                continue
            for chain, n in group:  # fewer items than packs
                take = min(n, left)
                left -= take
                if take:
                    put(room - length, longer(chain, length, 1), take)
                if n > take:
                    put(room, chain, n - take)
    out = []
    for group in open_.values():
        for chain, packs in group:
            runs = []
            while chain:
                chain, length, times = chain
                runs.append((length, times))
            out.append((runs[::-1], packs))
    return out


def _slots(found: list[tuple[list[tuple[int, int]], int]]) -> np.ndarray:
    """Rows (length, first rank, pack, offset, times), ascending: which ranks of a length go where.

    At most three patterns a length, and in each no more different lengths than fit into the
    capacity, 90 for 4,096: some 50 MB at the very most, however many items there are.
    """
    rows, first, used = [], 0, {}
    for runs, packs in found:
        offset = 0
        for x, times in runs:
            lo = used.get(x, 0)
            rows.append((x, lo, first, offset, times))
            used[x] = lo + packs * times
            offset += x * times
        first += packs
    table = np.array(rows, dtype="int64").reshape(-1, 5)
    return table[np.lexsort((table[:, 1], table[:, 0]))]


def _place(shared):
    def run(batches):
        table = shared.value
        keys = (table[:, 0] << RANK_BITS) + table[:, 1]
        for frame in batches:
            at = np.searchsorted(keys, (frame["length"].to_numpy() << RANK_BITS) + frame["rank"].to_numpy(), side="right") - 1
            _, lo, first, offset, times = table[at].T
            nth = frame["rank"].to_numpy() - lo
            frame["container"] = first + nth // times
            frame["offset"] = offset + nth % times * frame["length"].to_numpy()
            yield frame.drop(columns="rank")

    return run


def pack(items: DataFrame, key: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """(key, part, start, length, container, offset): where each item, or part of one, goes.

    Items larger than the capacity are cut into full containers and a rest, and only they are
    cut; `start` is the part's first unit in the item, `offset` its first unit in the container.
    Items of size 0 or null take no room and go to container 0. Containers are numbered from 0.
    Every row is an item of its own, also if a key repeats (its rows then cannot be told apart
    in the result); a null key is kept. A negative size counts as 0. An empty table gives an
    empty result.
    """
    if not 0 < capacity <= MOST_CAPACITY:
        raise ValueError("capacity out of range")
    spark = items.sparkSession
    work = Workspace(spark, "packing")
    n = F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0))
    rows = items.select(F.col(key).alias("k"), n.alias("n"))
    pieces = F.expr(f"transform(sequence(0, cast(greatest(n - 1, 0) div {capacity} as int)), i -> struct(i as part, i * cast({capacity} as bigint) as start, least(n - i * cast({capacity} as bigint), {capacity}) as length))")
    parts = work.keep(rows.select("k", F.explode(pieces).alias("x")).select("k", "x.*").withColumn("b", F.pmod(F.xxhash64("k", "part"), F.lit(RANK_BUCKETS))))
    sizes = work.keep(parts.where("length > 0").groupBy("length", "b").agg(F.count("*").alias("c")))
    histogram = {r.length: r.c for r in sizes.groupBy("length").agg(F.sum("c").alias("c")).collect()}  # at most `capacity` rows
    shared = spark.sparkContext.broadcast(_slots(patterns(histogram, capacity)))
    before = sizes.select("length", "b", (F.sum("c").over(Window.partitionBy("length").orderBy("b")) - F.col("c")).alias("before"))
    ranked = parts.where("length > 0").withColumn("r", F.row_number().over(Window.partitionBy("length", "b").orderBy("k", "part")) - 1)
    ranked = ranked.join(before, ["length", "b"]).select("k", "part", "start", "length", (F.col("r") + F.col("before")).alias("rank"))
    kind = dict(items.select(F.col(key).alias("k")).dtypes)["k"]
    out = ranked.mapInPandas(_place(shared), f"k {kind}, part int, start long, length long, container long, offset long")
    zero = parts.where("length = 0").select("k", "part", "start", "length", F.lit(0).cast("long").alias("container"), F.lit(0).cast("long").alias("offset"))
    return out.unionByName(zero).withColumnRenamed("k", key)


def pack_report(placed: DataFrame, key: str, capacity: int = CAPACITY) -> DataFrame:
    """One row of what must hold of `pack`'s result, and how full the containers are.

    (parts, containers, units, over, split, overlapping): over: containers with more units than
    fit or a part that reaches beyond; split: keys in several parts although they fit into one
    container; overlapping: parts that begin before the one before them in the container ends.
    """
    real = placed.where("length > 0")
    end = F.max(F.col("offset") + F.col("length")).over(Window.partitionBy("container").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1))
    lapped = real.select(F.col("offset") < end).toDF("x").agg(F.count_if("x").alias("overlapping"))
    per = real.groupBy("container").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"), F.count("*").alias("parts"))
    fill = per.agg(F.coalesce(F.sum("parts"), F.lit(0)).alias("parts"), F.count("*").alias("containers"), F.coalesce(F.sum("n"), F.lit(0)).alias("units"), F.count_if((F.col("n") > capacity) | (F.col("end") > capacity)).alias("over"))
    keys = real.groupBy(key).agg(F.count_distinct("part").alias("p"), F.sum("length").alias("n"))
    split = keys.agg(F.count_if((F.col("p") > 1) & (F.col("n") <= capacity)).alias("split"))
    # Three tables of one row each.
    return fill.crossJoin(split).crossJoin(lapped)
