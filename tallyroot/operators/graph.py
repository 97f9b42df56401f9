"""Graph operators over edge tables (src, dst, weight): degrees, ranks, walks, audits.

Iterations are loops of jobs whose state is cut from its lineage by a kept table in the shared
folder; ranks and frontiers are joined by key, never collected.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyroot.operators.hierarchy import Hierarchy, ancestors
from tallyroot.work import Workspace

DAMPING = 0.85
#: When ranks move along at most this many edges any more, one task walks the rounds that are left in numpy.
FINISH_EDGES = 500_000
#: The level of validity windows without an end or a beginning, above that of any other.
OPEN = 1000


def link_graph(links: DataFrame, types: list[str] | None = None) -> DataFrame:
    """(src, dst, weight): parallel links are kept, a null score is 1 and 0 stays 0. Unknown types are refused."""
    if types is not None:
        if not types:
            raise ValueError("an empty list of types")
        known = {r[0] for r in links.select("link_type").distinct().where(F.col("link_type").isin(types)).collect()}
        if set(types) - known:
            raise ValueError(f"unknown types {sorted(set(types) - known)}")
        links = links.where(F.col("link_type").isin(types))
    return links.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), F.coalesce(F.col("score").cast("double"), F.lit(1.0)).alias("weight"))


def triple_graph(triples: DataFrame) -> DataFrame:
    """(src, dst, weight): live facts between nodes, weight 1."""
    live = triples.where("invalidated_at is null and object_id is not null")
    return live.select(F.col("subject_id").alias("src"), F.col("object_id").alias("dst"), F.lit(1.0).alias("weight"))


def combined(*graphs: DataFrame) -> DataFrame:
    """Weights summed per pair; a weight of 0 counts as 1."""
    edges = graphs[0]
    for g in graphs[1:]:
        edges = edges.unionByName(g)
    return edges.groupBy("src", "dst").agg(F.sum(F.when(F.col("weight") == 0, 1.0).otherwise(F.col("weight"))).alias("weight"))


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, n_in, n_out, n_all) of every vertex, parallel edges counted."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    n = ends.groupBy("id").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return vertices.select("id").distinct().join(n, "id", "left").select("id", z("n_in").alias("n_in"), z("n_out").alias("n_out"), (z("n_in") + z("n_out")).alias("n_all"))


def pagerank(vertices: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int | None = 30, reset: DataFrame | None = None, tolerance: float = 1e-10, finish_edges: int = FINISH_EDGES) -> DataFrame:
    """(id, score): weighted PageRank summing to 1; the mass of vertices without out-edges goes where the reset goes.

    reset: (id, weight), weights above 0; null: uniform. Stops after `rounds`, or when no score
    moves by more than `tolerance`. Rounds null: converged, as the sum over walks of every length
    from the reset, which needs no rounds for the lost mass; what longer walks could add is then
    below `tolerance`, and each round leaves at most `damping` of it.
    """
    work = Workspace(vertices.sparkSession, "pagerank")
    v = work.keep(vertices.select("id").distinct())
    if reset is None:
        base = v.withColumn("r", F.lit(1.0 / max(v.count(), 1)))
    else:
        if not reset.where("weight is null or weight <= 0").isEmpty():
            raise ValueError("reset weights must be above 0")
        if not reset.join(v, "id", "left_anti").isEmpty():
            raise ValueError("a seed is no vertex")
        total = reset.agg(F.sum("weight")).first()[0]
        base = work.keep(v.join(reset.groupBy("id").agg(F.sum("weight").alias("w")), "id", "left").select("id", (F.coalesce("w", F.lit(0.0)) / total).alias("r")))
    # Edges to or from what is no vertex are none, so their sources keep no mass for them.
    inner = edges.join(v.withColumnRenamed("id", "dst"), "dst", "left_semi").join(v.withColumnRenamed("id", "src"), "src", "left_semi")
    summed = work.keep(inner.groupBy("src", "dst").agg(F.sum("weight").alias("weight")).where("weight > 0"))
    out = summed.groupBy("src").agg(F.sum("weight").alias("all"))
    steps = summed.join(out, "src").select("src", "dst", (F.col("weight") / F.col("all")).alias("p"))
    few = rounds is not None and summed.count() <= finish_edges
    # In buckets by their source, the edges stay where they are from round to round; only ranks and sums move.
    steps = work.keep(steps) if few else work.keep_bucketed(steps, "src")
    work.drop(summed)
    if rounds is None:
        return _walk_sum(work, base, steps, damping, tolerance)
    return _round_sum(work, base, steps, damping, rounds, tolerance, finish_edges, few, reset is None)


def _round_sum(work: Workspace, base: DataFrame, steps: DataFrame, damping: float, rounds: int, tolerance: float, finish_edges: int, few: bool, uniform: bool) -> DataFrame:
    """The ranks after so many rounds, as a sum with factors of z_0, z_1, ..., the reset's mass after so many undamped steps.

    A round is x_k+1 = (1 - damping + damping * lost_k) z_0 + damping * (x_k moved by a step), and
    what z_j loses at vertices without out-edges is its sum less that of z_j+1: factors are
    numbers, and only what still walks is moved. Where the reset is uniform the vertices that
    walks of k steps reach are among those of k - 1 steps, so edges from others are done with.
    """
    z, rest, left = base.select("id", F.col("r").alias("m")), None, steps if few else None
    walks, sums, n, asked = [z], [1.0], None, None
    while len(sums) <= rounds:
        front = z.where("m > 0")
        if uniform and n is not None and n <= finish_edges and n != asked:
            asked, live = n, steps.join(front.select(F.col("id").alias("src")), "src", "left_semi")
            left = work.keep(live) if live.count() <= finish_edges else None
        if left is not None:
            begun = front.join(left.select(F.col("src").alias("id")), "id", "left_semi").select(F.col("id").alias("src"), F.col("id").alias("dst"), F.col("m").alias("p"), F.lit(False).alias("edge"))
            rows = begun.unionByName(left.withColumn("edge", F.lit(True)))
            rest = work.keep(rows.repartition(1).mapInPandas(_walker(list(sums), rounds, damping), f"k int, id {base.schema['id'].dataType.simpleString()}, m double"))
            found = {r.k: r.m for r in rest.where("k >= 0").select("k", "m").collect()}  # one row a round
            sums += [found.get(k, 0.0) for k in range(len(sums), rounds + 1)]
            break
        moved = steps.join(front, steps.src == front.id).groupBy("dst").agg(F.sum(F.col("m") * F.col("p")).alias("m"))
        z = work.keep(moved.select(F.col("dst").alias("id"), "m"))
        n, mass = z.agg(F.count("*"), F.sum("m")).first()
        walks.append(z)
        sums.append(mass or 0.0)
        if not n:
            sums += [0.0] * (rounds + 1 - len(sums))
        elif _factors(sums, damping)[1] < tolerance:
            break
    work.drop(steps, left)
    factors = _factors(sums, damping)[0]
    terms = None
    for k, walk in enumerate(walks):
        term = walk.select("id", (F.col("m") * F.lit(factors[k])).alias("score"))
        terms = term if terms is None else terms.unionByName(term)
    if rest is not None:
        terms = terms.unionByName(rest.where("k < 0").select("id", F.col("m").alias("score")))
    return terms.groupBy("id").agg(F.sum("score").alias("score"))


def _factors(sums: list[float], damping: float) -> tuple[list[float], float]:
    """The factors of z_0, z_1, ... in the last round's ranks, and what that round moved at most."""
    x, moved = [1.0], math.inf
    for _ in sums[1:]:
        lost = sum(c * (sums[j] - sums[j + 1]) for j, c in enumerate(x))
        new = [1 - damping + damping * lost, *(damping * c for c in x)]
        moved = sum(abs(a - b) * s for a, b, s in zip(new, [*x, 0.0], sums))
        x = new
    return x, moved


def _walker(sums: list[float], rounds: int, damping: float):
    """Walks on from rows (src, dst, p, edge), of which those that are no edges hold the mass p at src.

    sums: those of z_0 to the z they hold. Gives (k, id, m): the sum m of each later z_k, with
    any id, and with k = -1 the part of each vertex's rank that these z make.
    """

    def walk(batches):
        rows = list(batches)
        if not rows:
            return
        rows = pd.concat(rows, ignore_index=True)
        at, ids = pd.factorize(pd.concat([rows["src"], rows["dst"]], ignore_index=True))
        if not len(ids):
            return
        edge, p = rows["edge"].to_numpy(bool), rows["p"].to_numpy(float)
        begun = np.bincount(at[: len(rows)][~edge], weights=p[~edge], minlength=len(ids))
        src, dst, p = at[: len(rows)][edge], at[len(rows) :][edge], p[edge]

        def later():
            z = begun
            for _ in range(len(sums), rounds + 1):
                z = np.bincount(dst, weights=z[src] * p, minlength=len(ids))
                yield z

        # Factors need all sums, so the rounds are walked twice: what each holds is not kept.
        masses = [float(z.sum()) for z in later()]
        score = np.zeros(len(ids))
        for c, z in zip(_factors([*sums, *masses], damping)[0][len(sums) :], later()):
            score += c * z
        yield pd.DataFrame({"k": np.arange(len(sums), rounds + 1, dtype="int32"), "id": ids[np.zeros(len(masses), int)], "m": masses})
        yield pd.DataFrame({"k": np.full(len(ids), -1, "int32"), "id": ids, "m": score})

    return walk


def _walk_sum(work: Workspace, base: DataFrame, steps: DataFrame, damping: float, tolerance: float) -> DataFrame:
    state = work.keep(base.select("id", F.col("r").alias("term"), F.col("r").alias("sum")))
    while True:
        moved = steps.join(state.where("term > 0"), steps.src == state.id).groupBy("dst").agg((damping * F.sum(F.col("term") * F.col("p"))).alias("m"))
        new = work.keep(state.join(moved, state.id == moved.dst, "left").select("id", F.coalesce("m", F.lit(0.0)).alias("term"), (F.col("sum") + F.coalesce("m", F.lit(0.0))).alias("sum")))
        work.drop(state)
        state = new
        left, whole = state.agg(F.sum("term"), F.sum("sum")).first()
        if left is None or left * damping / (1 - damping) < tolerance:
            return state.select("id", (F.col("sum") / F.lit(whole)).alias("score"))


def neighbours(edges: DataFrame, seeds: DataFrame, depth: int, direction: str = "both", blocked: DataFrame | None = None) -> DataFrame:
    """(id, hops, via): what is reached from the seeds (id) within `depth` steps, with the smallest predecessor.

    Blocked vertices are neither reached nor walked through.
    """
    work = Workspace(edges.sparkSession, "walk")
    out, back = edges.select("src", "dst"), edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    step = {"out": out, "in": back, "both": out.unionByName(back)}[direction]
    if blocked is not None:
        step = step.join(blocked.select(F.col("id").alias("dst")), "dst", "left_anti")
    kind = dict(edges.dtypes)["dst"]
    reached = work.keep(seeds.select("id").distinct().select("id", F.lit(0).alias("hops"), F.lit(None).cast(kind).alias("via")))
    front = reached
    for hop in range(1, depth + 1):
        new = step.join(front.select(F.col("id").alias("src")), "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("via"))
        new = work.keep(new.join(reached, "id", "left_anti").select("id", F.lit(hop).alias("hops"), "via"))
        if new.isEmpty():
            break
        front, reached = new, work.keep(reached.unionByName(new))
    return reached


def bounded_neighbours(edges: DataFrame, seeds: DataFrame, depth: int, limit: int, direction: str = "both", blocked: DataFrame | None = None) -> tuple[DataFrame, bool, bool]:
    """(id, hops, via) of the nearest `limit` vertices around the seeds, ties by id; whether the limit cut some; whether the depth did.

    The limit is what a caller wants to see at most; seeds are not among it.
    """
    work = Workspace(edges.sparkSession, "bounded")
    wide = work.keep(neighbours(edges, seeds, depth + 1, direction, blocked))
    inside = wide.where((F.col("hops") > 0) & (F.col("hops") <= depth))
    n, beyond = wide.agg(F.count_if((F.col("hops") > 0) & (F.col("hops") <= depth)), F.count_if(F.col("hops") > depth)).first()
    return inside.orderBy("hops", "id").limit(limit), n > limit, beyond > 0 and n <= limit


def betweenness(vertices: DataFrame, edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(id, score): how many shortest paths between others lead through a vertex, each pair's paths counting one together.

    Undirected; weights of parallel edges are added and are lengths; those of 0 and loops are
    left out. sources: only paths from these vertices (id), a stated set, else from all.
    What hangs on the graph as trees is folded onto where it hangs, and the paths from and to it
    are counted from numbers of sources and vertices: that is work in proportion to the edges,
    in as many rounds as such trees are deep. What is left, the vertices on loops and between
    them, is sources times edges of work. There all sources go at once: distances settle in
    rounds, then paths are counted forwards and shares passed back along the edges of shortest
    paths, by number of steps, so there are as many rounds as a shortest path has steps.
    """
    work = Workspace(vertices.sparkSession, "betweenness")
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).where("src <> dst")
    pairs = work.keep(both.groupBy("src", "dst").agg(F.sum("weight").alias("w")).where("w > 0"))
    folded, rest, pairs = _fold_trees(work, pairs, (vertices if sources is None else sources).select("id").distinct())
    heads = rest.select("id", F.col("a").alias("all_a"), F.col("b").alias("all_b"))
    core = None
    if not pairs.isEmpty():
        core = _core_betweenness(work, pairs, rest)
        part = components(pairs, rest)
        sums = part.join(rest, "id").groupBy("component").agg(F.sum("a").alias("all_a"), F.sum("b").alias("all_b"))
        heads = part.join(sums, "component").select("id", "all_a", "all_b")
    # Of each vertex the branches folded onto it, and all of its component that is not below it.
    every = folded.unionByName(rest.withColumn("head", F.col("id"))).join(heads.withColumnRenamed("id", "head"), "head")
    d = lambda x: x.cast("double")
    low_a, low_b, far_a, far_b = d(F.col("a") - F.col("own")), d(F.col("b") - 1), d(F.col("all_a") - F.col("a")), d(F.col("all_b") - F.col("b"))
    score = every.select("id", (low_a * low_b - F.col("ab") + low_a * far_b + far_a * low_b).alias("x"))
    if core is not None:
        score = score.unionByName(core)
    score = score.groupBy("id").agg((F.sum("x") / 2).alias("score"))
    return vertices.select("id").distinct().join(score, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))


def _fold_trees(work: Workspace, pairs: DataFrame, start: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vertices folded away, those that are left, and the pairs (src, dst, w) among the latter.

    Vertices with one neighbour are folded onto it, round by round; of two that have only each
    other the smaller id stays. Vertices are (id, own, a, b, ab): whether it is a source, sources
    and vertices folded onto it with itself, and the sum of a * b of the branches folded onto it;
    those folded away also have head, the vertex left that they came to hang on.
    """
    own = start.withColumn("own", F.lit(1).cast("long"))
    rest = pairs.select(F.col("src").alias("id")).distinct().join(own, "id", "left").select("id", F.coalesce("own", F.lit(0).cast("long")).alias("own"))
    rest = work.keep(rest.select("id", "own", F.col("own").alias("a"), F.lit(1).cast("long").alias("b"), F.lit(0.0).alias("ab")))
    folded = []
    while True:
        ends = pairs.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"), F.max("dst").alias("to")).where("n = 1").select("id", "to")
        ends = ends.join(ends.select(F.col("id").alias("to"), F.lit(True).alias("both")), "to", "left").where("both is null or id > to")
        gone = work.keep(ends.join(rest, "id").select("id", "to", "own", "a", "b", "ab"))
        if gone.isEmpty():
            break
        folded.append(gone)
        inner = pairs.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti")
        more = gone.groupBy(F.col("to").alias("id")).agg(F.sum("a").alias("more_a"), F.sum("b").alias("more_b"), F.sum(F.col("a").cast("double") * F.col("b")).alias("more_ab"))
        onto = rest.join(gone.select("id"), "id", "left_anti").join(more, "id", "left")
        plus = lambda c: (F.col(c) + F.coalesce(F.col(f"more_{c}"), F.lit(0).cast("long"))).alias(c)
        old, rest = (pairs, rest), work.keep(onto.select("id", "own", plus("a"), plus("b"), plus("ab")))
        pairs = work.keep(inner.select("src", "dst", "w"))
        work.drop(*old)
    gone = rest.limit(0).withColumn("to", F.col("id"))
    for rows in folded:
        gone = gone.unionByName(rows)
    # Ways up double each time; none is longer than there were rounds.
    up = gone.select("id", "to")
    for _ in range(max(len(folded) - 1, 0).bit_length()):
        up = work.keep(up.join(up.select(F.col("id").alias("to"), F.col("to").alias("next")), "to", "left").select("id", F.coalesce("next", "to").alias("to")))
    return gone.drop("to").join(up.withColumnRenamed("to", "head"), "id"), rest, pairs


def _core_betweenness(work: Workspace, pairs: DataFrame, rest: DataFrame) -> DataFrame:
    """(id, x): shortest paths through each vertex along these pairs, a path from s to t as often as s has sources, a, and t vertices, b."""
    inner = work.keep(rest.join(pairs.select(F.col("src").alias("id")).distinct(), "id", "left_semi").select("id", "a", "b"))
    pairs = work.keep_bucketed(pairs, "src")
    start = inner.where("a > 0").select("id")
    far = work.keep(start.select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(0.0).alias("d")))
    front = far
    while not front.isEmpty():
        step = front.join(pairs, front.v == pairs.src).select("s", F.col("dst").alias("v"), (F.col("d") + F.col("w")).alias("d"))
        better = step.groupBy("s", "v").agg(F.min("d").alias("d")).join(far.withColumnRenamed("d", "old"), ["s", "v"], "left").where("old is null or d < old - 1e-12")
        front = work.keep(better.select("s", "v", "d"))
        far = work.keep(far.unionByName(front).groupBy("s", "v").agg(F.min("d").alias("d")))
    ends = far.select("s", F.col("v").alias("dst"), F.col("d").alias("e"))
    dag = far.join(pairs, far.v == pairs.src).select("s", F.col("v").alias("u"), "dst", (F.col("d") + F.col("w")).alias("d")).join(ends, ["s", "dst"])
    dag = work.keep(dag.where(F.abs(F.col("d") - F.col("e")) < 1e-9).select("s", "u", F.col("dst").alias("v")))

    def total(rows: DataFrame, come: str, go: str) -> DataFrame:
        """(s, v, x): rows and all that is passed on from them, step by step, along the edges of shortest paths."""
        out = now = work.keep(rows)
        while True:
            now = work.keep(now.withColumnRenamed("v", come).join(dag, ["s", come]).groupBy("s", F.col(go).alias("v")).agg(F.sum("x").alias("x")))
            if now.isEmpty():
                return work.keep(out.groupBy("s", "v").agg(F.sum("x").alias("x")))
            out = out.unionByName(now)

    # `dag` names its ends u and v; a step forwards comes from u, one back from v.
    ways = total(start.select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(1.0).alias("x")), "u", "v")
    targets = inner.select(F.col("id").alias("v"), "b")
    shares = ways.where("s <> v").join(targets, "v").select("s", "v", (F.col("b") / F.col("x")).alias("x"))
    passed = total(shares, "v", "u")
    own = ways.withColumnRenamed("x", "n").join(passed, ["s", "v"]).where("s <> v").join(targets, "v").join(inner.select(F.col("id").alias("s"), "a"), "s")
    # What was passed on includes the vertex's own share, which are paths that end there.
    return own.groupBy(F.col("v").alias("id")).agg(F.sum(F.col("a") * (F.col("n") * F.col("x") - F.col("b"))).alias("x"))


def seeded_rank(vertices: DataFrame, edges: DataFrame, seeds: DataFrame, hops: int = 2, damping: float = DAMPING, rounds: int | None = None) -> DataFrame:
    """(id, score, hops, n_all): PageRank on the seeds' neighbourhood, resetting to the seeds (id, weight); converged unless `rounds` are given."""
    near = neighbours(edges, seeds, hops)
    part = vertices.select("id").join(near.select("id"), "id", "left_semi")
    inner = edges.join(near.select(F.col("id").alias("src")), "src", "left_semi").join(near.select(F.col("id").alias("dst")), "dst", "left_semi")
    ranked = pagerank(part, inner, damping, rounds, seeds)
    return ranked.join(near.select("id", "hops"), "id").join(degrees(part, inner).select("id", "n_all"), "id")


def components(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, component): the smallest id connected to each vertex, by alternating large-star and small-star rounds.

    The number of rounds grows with the logarithm of the vertex count; hubs are never expanded.
    """
    work = Workspace(edges.sparkSession, "components")
    v = vertices.select("id").distinct()
    e = work.keep(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct())
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        new = work.keep(small.where("u <> v").distinct())
        done = new.exceptAll(e).isEmpty() and e.exceptAll(new).isEmpty()
        work.drop(e)
        e = new
        if done:
            return v.join(e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("c")), "id", "left").select("id", F.coalesce("c", "id").alias("component"))


def label_communities(vertices: DataFrame, edges: DataFrame, rounds: int = 8) -> DataFrame:
    """(id, community): weighted label propagation, ties to the smallest label; odd and even vertices take turns."""
    work = Workspace(edges.sparkSession, "labels")
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).where("src <> dst")
    pairs = work.keep_bucketed(both.groupBy("src", "dst").agg(F.sum("weight").alias("weight")), "dst")
    labels = work.keep(vertices.select("id").distinct().withColumn("community", F.col("id")))
    for i in range(rounds):
        votes = pairs.join(labels, pairs.dst == labels.id).groupBy("src", "community").agg(F.sum("weight").alias("w"))
        best = votes.groupBy("src").agg(F.min_by("community", F.struct(-F.col("w"), "community")).alias("new"))
        turn = F.pmod(F.xxhash64("id"), F.lit(2)) == i % 2
        new = labels.join(best, labels.id == best.src, "left").select("id", F.when(turn, F.coalesce("new", "community")).otherwise(F.col("community")).alias("community"))
        new = work.keep(new)
        work.drop(labels)
        labels = new
    return labels


def cohesion(labels: DataFrame, edges: DataFrame, least: int = 2) -> DataFrame:
    """(community, size, n_edges, cohesion): edges inside a community over its possible pairs."""
    sizes = labels.groupBy("community").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    pairs = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a <> b").distinct()
    inside = pairs.join(labels.select(F.col("id").alias("a"), "community"), "a").join(labels.select(F.col("id").alias("b"), F.col("community").alias("cb")), "b").where("community = cb")
    n = inside.groupBy("community").agg(F.count("*").alias("n_edges"))
    out = sizes.join(n, "community", "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))
    return out.withColumn("cohesion", F.col("n_edges") / (F.col("size") * (F.col("size") - 1) / 2))


def quantile_score(scores: DataFrame, quantile: float) -> float | None:
    """The score at place int(q * (n - 1)) of the ascending scores above 0; null without any.

    Scores are cut into ranges by approximate quantiles; only the range that holds the place is
    put in order.
    """
    some = scores.where("score > 0").select("score")
    cuts, n = some.agg(F.percentile_approx("score", [k / 256 for k in range(1, 256)], 2000), F.count("*")).first()
    if not n:
        return None
    place = int(quantile * (n - 1))
    bucket = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda x: x < F.col("score")))
    counted = some.groupBy(bucket.alias("b"), "score").agg(F.count("*").alias("c"))
    below = 0
    for b, c in sorted(counted.groupBy("b").agg(F.sum("c")).collect()):  # 256 rows at most
        if below + c > place:
            w = Window.partitionBy("b").orderBy("score")
            inner = counted.where(F.col("b") == b).withColumn("to", F.sum("c").over(w))
            return inner.where(F.col("to") > place - below).agg(F.min("score")).first()[0]
        below += c
    return None


def subtree_authority(scores: DataFrame, tree: Hierarchy, decay: float = 0.7, quantile: float = 0.75, least: int = 3) -> DataFrame:
    """(id, own, below, spread, size, authority): a node's score and its descendants', decayed by distance.

    scores: (id, score). spread: descendants whose score reaches the quantile of all non-zero
    scores, the one at place int(q * (n - 1)). Nodes with fewer than `least` nodes in their
    subtree are left out. Spread is counted along the Euler tour; decayed scores come from as
    near descendants as can change twelve digits (78 steps for a decay of 0.7).
    """
    reach = quantile_score(scores, quantile)
    far = max(1, math.ceil(math.log(1e-12) / math.log(decay))) if 0 < decay < 1 else None
    high = scores.where(F.col("score") >= F.lit(reach)) if reach is not None else scores.limit(0)
    spread = ancestors(tree, high, sound=True).groupBy(F.col("ancestor").alias("id")).agg(F.count("*").alias("spread"))
    near = ancestors(tree, scores.where("score <> 0"), up_to=far, sound=True).join(scores, "id")
    below = near.groupBy(F.col("ancestor").alias("id")).agg(F.sum(F.col("score") * F.pow(F.lit(decay), F.col("distance"))).alias("below"))
    sizes = tree.nodes.where("kind = 'tree'").select("id", (F.col("n_descendants") + 1).alias("size")).where(F.col("size") >= max(least, 2))
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    out = scores.join(sizes, "id").join(below, "id", "left").join(spread, "id", "left").select("id", F.col("score").alias("own"), F.coalesce("below", F.lit(0.0)).alias("below"), z("spread"), "size")
    return out.withColumn("authority", (F.col("own") + F.col("below")) * (1 + F.log1p("spread")))


def contributors(scores: DataFrame, tree: Hierarchy, of: DataFrame, k: int = 5, decay: float = 0.7) -> DataFrame:
    """(id, member, share, place): the k descendants of each asked node (id) with the greatest decayed scores; ties by id.

    The k best of each of 64 shares of a subtree are taken first, so that no subtree is one task's work.
    """
    pairs = ancestors(tree, scores.where("score > 0"), among=of, sound=True).join(scores, "id")
    rows = pairs.select(F.col("ancestor").alias("top"), F.col("id").alias("member"), (F.col("score") * F.pow(F.lit(decay), F.col("distance"))).alias("share"))
    part = Window.partitionBy("top", F.pmod(F.xxhash64("member"), F.lit(64))).orderBy(F.desc("share"), "member")
    near = rows.withColumn("r", F.row_number().over(part)).where(F.col("r") <= k)
    ranked = near.withColumn("place", F.row_number().over(Window.partitionBy("top").orderBy(F.desc("share"), "member"))).where(F.col("place") <= k)
    return ranked.select(F.col("top").alias("id"), "member", "share", "place")


def lint_orphans(vertices: DataFrame, edges: DataFrame, threshold: int = 0) -> DataFrame:
    """(id, n_all, severity): vertices of a degree up to the threshold; a warning if it is 0, else an info."""
    low = degrees(vertices, edges).where(F.col("n_all") <= threshold)
    return low.select("id", "n_all", F.when(F.col("n_all") == 0, "warning").otherwise("info").alias("severity"))


def lint_contradictions(facts: DataFrame) -> DataFrame:
    """(a, b): facts of one subject and predicate with different objects whose validity windows overlap, ends included.

    facts: (id, subject_id, predicate, object, valid_from, valid_until), null ends open. A window
    is at home in the one or two buckets, of a width that is a power of two and not below its
    own, that it touches; open ones in a bucket of all times. Each also visits the buckets of
    the wider homes that occur, so windows meet in the wider one's home and a subject with very
    many facts is spread over time. A pair is reported where its common stretch begins.
    """
    number = lambda c: F.col(c).cast("double")
    low, high = number("valid_from"), number("valid_until")
    bounded = low.isNotNull() & high.isNotNull()
    level = F.when(bounded, F.greatest(F.ceil(F.log2(F.greatest(high - low, F.lit(1.0)))), F.lit(0))).otherwise(OPEN).cast("int")
    rows = facts.where("subject_id is not null and predicate is not null and object is not null").where(~bounded | (low <= high))
    rows = rows.select("id", "subject_id", "predicate", "object", low.alias("low"), high.alias("high"), level.alias("level"))
    levels = sorted(r[0] for r in rows.select("level").distinct().collect())  # some sixty at most
    homes = F.array(*map(F.lit, levels)).cast("array<int>")
    width = F.pow(F.lit(2.0), F.col("at"))
    cells = F.when(F.col("at") == OPEN, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.floor(F.col("low") / width), F.floor(F.col("high") / width)))
    placed = rows.withColumn("at", F.explode(F.filter(homes, lambda x: x >= F.col("level")))).withColumn("cell", F.explode(cells))
    key = ["subject_id", "predicate", "at", "cell"]
    names = lambda d, s: d.select(*key, *[F.col(c).alias(f"{c}_{s}") for c in ("id", "object", "low", "high", "level")])
    both = names(placed.where("level = at"), "x").join(names(placed, "y"), key)
    # Of two at home on one level the smaller id stands for the pair.
    both = both.where("object_x <> object_y").where((F.col("level_y") < F.col("level_x")) | (F.col("id_x") < F.col("id_y")))
    after = lambda p, q: F.col(f"low_{p}").isNull() | F.col(f"high_{q}").isNull() | (F.col(f"low_{p}") <= F.col(f"high_{q}"))
    begins = (F.col("at") == OPEN) | (F.floor(F.greatest("low_x", "low_y") / width) == F.col("cell"))
    found = both.where(after("x", "y") & after("y", "x") & begins)
    return found.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b"))


def lint_stale(facts: DataFrame, now, days: int = 90) -> DataFrame:
    """(id, age_days): live dynamic facts whose clock is older than `days`."""
    clock = F.coalesce("valid_from", "recorded_at")
    age = (F.unix_micros(F.lit(now)) - F.unix_micros(clock)) / F.lit(86_400_000_000.0)
    return facts.where("fact_type = 'dynamic' and invalidated_at is null").withColumn("age_days", F.floor(age)).where(age > days).select("id", "age_days")


def spines(scores: DataFrame, up: DataFrame, k: int = 5, cut: float = 0.85) -> DataFrame:
    """(root, leaf, total, place): the heaviest root-to-leaf paths of each tree, at most k, until one falls below `cut` of the best.

    scores: (id, score) of all nodes; up: (id, ancestor, ancestor_depth). A path's weight is the
    sum of the scores on it. The k best of a tree are found by a partial top-k in each of a
    fixed number of buckets first, so a large tree is not one task's work.
    """
    inner = up.select(F.col("ancestor").alias("id")).distinct()
    leaves = scores.join(inner, "id", "left_anti")
    roots = up.where("ancestor_depth = 0").select("id", F.col("ancestor").alias("root"))
    above = up.join(leaves.select("id"), "id", "left_semi").join(scores.select(F.col("id").alias("ancestor"), F.col("score").alias("s")), "ancestor").groupBy("id").agg(F.sum("s").alias("s"))
    total = leaves.join(above, "id").join(roots, "id").select("root", F.col("id").alias("leaf"), (F.col("score") + F.col("s")).alias("total"))
    part = Window.partitionBy("root", F.pmod(F.xxhash64("leaf"), F.lit(64))).orderBy(F.desc("total"), "leaf")
    whole = Window.partitionBy("root").orderBy(F.desc("total"), "leaf")
    near = total.withColumn("r", F.row_number().over(part)).where(F.col("r") <= k).drop("r")
    ranked = near.withColumn("place", F.row_number().over(whole)).where(F.col("place") <= k)
    return ranked.withColumn("best", F.max("total").over(Window.partitionBy("root"))).where(F.col("total") >= cut * F.col("best")).select("root", "leaf", "total", "place")


def branch_points(nodes: DataFrame, scores: DataFrame, tree: Hierarchy, chosen: DataFrame, near: float = 0.85) -> DataFrame:
    """(root, leaf, parent, child, sibling): where a chosen path (root, leaf) could nearly as well have gone to a sibling.

    That is where a sibling's whole subtree has `near` of the score of the one the path goes
    into, or more. nodes: (id, parent_id).
    """
    up = ancestors(tree, scores.where("score <> 0"), sound=True).join(scores, "id")
    sums = up.groupBy(F.col("ancestor").alias("id")).agg(F.sum("score").alias("b")).join(scores, "id", "right").select("id", (F.coalesce("b", F.lit(0.0)) + F.col("score")).alias("whole"))
    leaves = chosen.select("root", "leaf").distinct()
    on = ancestors(tree, leaves.select(F.col("leaf").alias("id")), sound=True).select(F.col("id").alias("leaf"), F.col("ancestor").alias("child")).unionByName(leaves.select("leaf", F.col("leaf").alias("child")))
    own = nodes.select(F.col("id").alias("child"), F.col("parent_id").alias("parent")).where("parent is not null").join(sums.select(F.col("id").alias("child"), F.col("whole").alias("mine")), "child")
    step = leaves.join(on, "leaf").join(own, "child")
    others = nodes.select(F.col("id").alias("sibling"), F.col("parent_id").alias("parent")).join(sums.select(F.col("id").alias("sibling"), F.col("whole").alias("theirs")), "sibling")
    return step.join(others, "parent").where((F.col("child") != F.col("sibling")) & (F.col("theirs") > 0) & (F.col("theirs") >= near * F.col("mine"))).select("root", "leaf", "parent", "child", "sibling")


def lint_all(*reports: tuple[str, DataFrame]) -> DataFrame:
    """(rule, severity, id, rank): several reports (id, severity) in one, errors before warnings before infos."""
    out = None
    for rule, r in reports:
        rows = r.select(F.lit(rule).alias("rule"), "severity", F.col("id").cast("string").alias("id"))
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("rank", F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2))
