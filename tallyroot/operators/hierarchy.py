"""Parent-child links to full hierarchies: leaf peeling, Euler tours, list ranking.

The tree is never walked level by level. Loops are exposed by peeling leaves (rake) and
splicing out single-child chain nodes (compress), which takes a number of rounds that grows
with the logarithm of the node count, however deep the trees are. Loops are then cut open,
missing parents stand as roots of their own, and every tree becomes a linked list, its Euler
tour: one element where a node is entered, one where it is left (a leaf has one element of
weight two). The lists are ranked in parallel by splicing out independent elements until few
are left, ranking those, and putting the spliced ones back in reverse. The rank of a node's
two elements is its interval; depth is the sum of +1 and -1 along the same list.

Every round is one hash aggregation by key over rows that shrink geometrically; a node with
very many children sends its counts pre-aggregated, and its children are chained in buckets.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyroot.operators.current import in_force
from tallyroot.work import Workspace

#: Contraction stops when at most this many rows are left; one task ranks those in numpy (about 10 MB).
FINISH_ROWS = 200_000
#: Children of a node with more than this many are chained in buckets, each sorted by its own task.
HOT_FANOUT = 500_000
HOT_BUCKETS = 256
#: Width of the stretches of the tour in which ancestors are looked up.
STRETCH = 1 << 18
#: Nodes are looked up depth by depth among at most so many different depths.
MOST_DEPTHS = 256

SOUND, ON_LOOP, MISSING = 0, 1, 2


@dataclass
class Hierarchy:
    """`nodes`: one row per node.

    id: the node. kind: `tree`, `loop`, `below_loop` or `dangling`. root, depth: null unless
    kind is `tree`; a root has depth 0. anchor: the root, the loop node or the missing parent
    at the top of the node's chain. anchor_depth: links from the anchor. tour_in, tour_out:
    places of entering and leaving the node in the Euler tour of the anchor, counted down to
    the tour's end, so that b lies below a exactly if both have the same anchor and
    a.tour_in > b.tour_in and b.tour_in > a.tour_out. n_descendants: nodes below it; null on a loop,
    where each node is below every other.
    """

    nodes: DataFrame
    work: Workspace


def _links(nodes: DataFrame, id_col: str, parent_col: str, order: str | None) -> DataFrame:
    if order is None:
        nodes = nodes.select(F.col(id_col), F.col(parent_col), F.lit(0).alias("_order"))
        order = "_order"
    return in_force(nodes, id_col, order, [id_col, parent_col]).select(F.col(id_col).alias("v"), F.col(parent_col).alias("p"))


def _with_children(links: DataFrame) -> DataFrame:
    """(v, p, n, x, real): number of children, xor of their ids; real is 0 for a parent that is no node."""
    own = links.select("v", "p", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("x"), F.lit(1).alias("real"))
    up = links.where("p is not null").select(F.col("p").alias("v"), F.lit(None).cast("long").alias("p"), F.lit(1).cast("long").alias("n"), F.col("v").alias("x"), F.lit(0).alias("real"))
    return own.unionByName(up).groupBy("v").agg(F.max("p").alias("p"), F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.max("real").alias("real"))


def _peel(state: DataFrame) -> DataFrame:
    """Remove nodes without children, telling their parents."""
    gone = F.col("n") == 0
    told = state.where(gone & F.col("p").isNotNull()).select(F.col("p").alias("v"), F.lit(None).cast("long").alias("p"), F.lit(-1).cast("long").alias("n"), F.col("v").alias("x"), F.lit(0).alias("here"))
    left = state.where(~gone).select("v", "p", "n", "x", F.lit(1).alias("here"))
    return left.unionByName(told).groupBy("v").agg(F.max("p").alias("p"), F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.max("here").alias("here")).where("here = 1").drop("here")


def _spliceable(salt: int) -> Column:
    """Chain nodes no two of which are neighbours: one child, and a hash above both neighbours'."""
    h = lambda c: F.xxhash64(F.col(c), F.lit(salt))
    return (F.col("n") == 1) & F.col("p").isNotNull() & (h("v") > h("p")) & (h("v") > h("x"))


def _splice(state: DataFrame, salt: int) -> DataFrame:
    """Take chain nodes out: parent and child become neighbours."""
    out = F.coalesce(_spliceable(salt), F.lit(False))
    none = F.lit(None).cast("long")
    kept = state.where(~out).select("v", "p", "n", "x", none.alias("np"), F.lit(1).alias("here"))
    cut = state.where(out)
    up = cut.select(F.col("p").alias("v"), none.alias("p"), F.lit(0).cast("long").alias("n"), F.col("v").bitwiseXOR(F.col("x")).alias("x"), none.alias("np"), F.lit(0).alias("here"))
    down = cut.select(F.col("x").alias("v"), none.alias("p"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("x"), F.col("p").alias("np"), F.lit(0).alias("here"))
    rows = kept.unionByName(up).unionByName(down)
    return rows.groupBy("v").agg(F.coalesce(F.max("np"), F.max("p")).alias("p"), F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.max("here").alias("here")).where("here = 1").drop("here")


def _peel_rest(batches):
    """Leaf peeling of the few nodes left, in one task: yields those on loops."""
    frame = pd.concat([b for b in batches] or [pd.DataFrame({"v": [], "p": []})])
    v = frame["v"].to_numpy()
    at = {k: i for i, k in enumerate(v.tolist())}
    parent = np.array([-1 if pd.isna(p) else at.get(int(p), -1) for p in frame["p"].tolist()], dtype=np.int64)
    n = np.bincount(parent[parent >= 0], minlength=len(v)) if len(v) else np.zeros(0, int)
    stack = np.flatnonzero(n == 0).tolist()
    gone = np.zeros(len(v), bool)
    while stack:
        i = stack.pop()
        gone[i] = True
        up = parent[i]
        if up >= 0:
            n[up] -= 1
            if n[up] == 0:
                stack.append(up)
    yield pd.DataFrame({"v": v[~gone].astype("int64")})


def loop_nodes(state: DataFrame, work: Workspace, finish_rows: int = FINISH_ROWS) -> DataFrame:
    """(v): the nodes that come back to themselves. `state`: a kept table (v, p, n, x)."""
    state = state.select("v", "p", "n", "x")
    spliced: list[DataFrame] = []
    spent: list[DataFrame] = []
    salt = 0
    while True:
        state = work.keep(_peel(state))
        spent.append(state)
        left, size = state.agg(F.count_if(F.expr("p is null or p <> v")), F.count("*")).first()
        if left == 0 or size <= finish_rows:
            break
        salt += 1
        spliced.append(state.where(F.coalesce(_spliceable(salt), F.lit(False))).select("v", F.col("x").alias("c")))
        state = work.keep(_splice(state, salt))
        spent.append(state)
    if left:
        # Nodes left may hang from a null parent; they peel away in the single task.
        # The parents of what is left are all left too, so the subset is closed.
        # Self-loops are kept by it as loops of one node.
        found = state.select("v", "p").coalesce(1).mapInPandas(_peel_rest, "v long")
    else:
        found = state.select("v")
    found = work.keep(found)
    for step in reversed(spliced):
        # A chain node was on a loop exactly if its only child was.
        found = work.keep(found.unionByName(step.join(found.withColumnRenamed("v", "c"), "c", "left_semi").select("v")))
    work.drop(*spent)
    return found


def _tour(forest: DataFrame, hot: DataFrame | None) -> DataFrame:
    """(e, nxt, prv, w, s, g): the elements of the Euler tours; g is set where a list ends.

    `forest`: (v, p, leaf, g). Element 2v enters v, 2v+1 leaves it; a leaf has 2v only.
    """
    kids = forest.where("p is not null")
    order = ["v"]
    if hot is not None:
        kids = kids.join(hot.select(F.col("v").alias("p"), F.lit(1).alias("hot")), "p", "left").withColumn("b", F.when(F.col("hot") == 1, F.pmod(F.xxhash64("v"), F.lit(HOT_BUCKETS))).otherwise(F.lit(0)))
        order = ["b", "v"]
    end = lambda v, leaf: F.when(F.col(leaf), F.col(v) * 2).otherwise(F.col(v) * 2 + 1)
    kids = kids.withColumn("out", end("v", "leaf"))
    if hot is None:
        w = Window.partitionBy("p").orderBy(*order)
        sib = kids.select("v", "p", "leaf", "g", F.lead("v").over(w).alias("ns"), F.lag("out").over(w).alias("po"))
        ends = kids.groupBy("p").agg(F.min("v").alias("f"), F.max_by("out", "v").alias("lo"))
    else:
        w = Window.partitionBy("p", "b").orderBy("v")
        sib = kids.select("v", "p", "leaf", "g", "b", F.lead("v").over(w).alias("ns"), F.lag("out").over(w).alias("po"))
        part = kids.groupBy("p", "b").agg(F.min("v").alias("f"), F.max_by("out", "v").alias("lo"))
        across = Window.partitionBy("p").orderBy("b")
        part = part.select("p", "b", "f", "lo", F.lead("f").over(across).alias("nf"), F.lag("lo").over(across).alias("plo"))
        sib = sib.join(part.select("p", "b", "nf", "plo"), ["p", "b"]).select("v", "p", "leaf", "g", F.coalesce("ns", "nf").alias("ns"), F.coalesce("po", "plo").alias("po"))
        ends = part.groupBy("p").agg(F.min_by("f", "b").alias("f"), F.max_by("lo", "b").alias("lo"))
    none = F.lit(None).cast("long")
    tops = forest.where("p is null").select("v", "p", "leaf", "g", none.alias("ns"), none.alias("po"))
    full = sib.unionByName(tops).join(ends.select(F.col("p").alias("v"), "f", "lo"), "v", "left")
    after = F.coalesce(F.col("ns") * 2, F.col("p") * 2 + 1)
    before = F.coalesce(F.col("po"), F.col("p") * 2)
    ending = F.when(F.col("p").isNull(), F.col("g"))
    element = lambda e, nxt, prv, w, s, g: F.struct(e.alias("e"), nxt.alias("nxt"), prv.alias("prv"), F.lit(w).cast("long").alias("w"), F.lit(s).cast("long").alias("s"), g.cast("int").alias("g"))
    single = F.array(element(F.col("v") * 2, after, before, 2, 0, ending))
    double = F.array(element(F.col("v") * 2, F.col("f") * 2, before, 1, 1, F.lit(None)), element(F.col("v") * 2 + 1, after, F.col("lo"), 1, -1, ending))
    return full.select(F.explode(F.when(F.col("leaf"), single).otherwise(double)).alias("t")).select("t.*")


def _removable(salt: int) -> Column:
    h = lambda c: F.xxhash64(F.col(c), F.lit(salt))
    return F.col("nxt").isNotNull() & (h("e") < h("nxt")) & (F.col("prv").isNull() | (h("e") < h("prv")))


def _contract(state: DataFrame, salt: int) -> DataFrame:
    """Splice out elements no two of which are neighbours; their weights go to the element before."""
    out = _removable(salt)
    none = F.lit(None).cast("long")
    zero = F.lit(0).cast("long")
    kept = state.where(~out).select("e", "nxt", "prv", "w", "s", "g", none.alias("nn"), none.alias("np"), F.lit(False).alias("first"))
    gone = state.where(out)
    back = gone.where("prv is not null").select(F.col("prv").alias("e"), none.alias("nxt"), none.alias("prv"), "w", "s", F.lit(None).cast("int").alias("g"), F.col("nxt").alias("nn"), none.alias("np"), F.lit(False).alias("first"))
    ahead = gone.select(F.col("nxt").alias("e"), none.alias("nxt"), none.alias("prv"), zero.alias("w"), zero.alias("s"), F.lit(None).cast("int").alias("g"), none.alias("nn"), F.col("prv").alias("np"), F.col("prv").isNull().alias("first"))
    rows = kept.unionByName(back).unionByName(ahead)
    prv = F.when(~F.max("first"), F.coalesce(F.max("np"), F.max("prv")))
    return rows.groupBy("e").agg(F.coalesce(F.max("nn"), F.max("nxt")).alias("nxt"), prv.alias("prv"), F.sum("w").alias("w"), F.sum("s").alias("s"), F.max("g").alias("g"))


RANKED = "e long, r long, d long, t long, g int"


def _rank_rest(batches):
    """Pointer jumping over the few elements left, in one task."""
    frame = pd.concat([b for b in batches] or [pd.DataFrame({c: [] for c in ("e", "nxt", "w", "s", "g")})]).reset_index(drop=True)
    n = len(frame)
    if not n:
        return
    e = frame["e"].to_numpy().astype("int64")
    last = frame["nxt"].isna().to_numpy()
    by = np.argsort(e)
    to = by[np.minimum(np.searchsorted(e[by], frame["nxt"].fillna(0).astype("int64").to_numpy()), n - 1)]
    to[last] = np.flatnonzero(last)
    w, s = frame["w"].to_numpy().astype("int64"), frame["s"].to_numpy().astype("int64")
    r, d = np.where(last, 0, w), np.where(last, 0, s)
    while not last[to].all():
        r, d, to = r + r[to], d + d[to], to[to]
    g = frame["g"].fillna(0).astype("int64").to_numpy()
    yield pd.DataFrame({"e": e, "r": r + w[to], "d": d + s[to], "t": e[to], "g": g[to].astype("int32")})


def rank_lists(elements: DataFrame, work: Workspace, finish_rows: int = FINISH_ROWS) -> DataFrame:
    """Ranks the elements of linked lists: (e, r, d, t, g).

    `elements`: a kept table (e, nxt, prv, w, s, g). r: sum of w from the element to its
    list's end, both included; d: the same sum of s; t, g: the last element and its g.
    """
    rounds, state, salt = [], elements, 0
    while (left := state.where("nxt is not null").count()) > finish_rows:
        rounds.append((state, salt))
        state = work.keep(_contract(state, salt))
        salt += 1
    # A list that has shrunk to its end is done; there are at most as many other ends as elements before them.
    ranked = state.where("nxt is null and prv is null").select("e", F.col("w").alias("r"), F.col("s").alias("d"), F.col("e").alias("t"), "g")
    if left:
        rest = state.where("nxt is not null or prv is not null").select("e", "nxt", "w", "s", "g")
        ranked = ranked.unionByName(rest.coalesce(1).mapInPandas(_rank_rest, RANKED))
    ranked = work.keep(ranked)
    if rounds:
        work.drop(state)
    for before, salt in reversed(rounds):
        gone = before.where(_removable(salt)).select(F.col("e").alias("ge"), "nxt", F.col("w").alias("gw"), F.col("s").alias("gs"))
        back = gone.join(ranked, gone.nxt == ranked.e).select(F.col("ge").alias("e"), (F.col("r") + F.col("gw")).alias("r"), (F.col("d") + F.col("gs")).alias("d"), "t", "g")
        wider = work.keep(ranked.unionByName(back))
        work.drop(ranked, before)
        ranked = wider
    return ranked


def _keys(links: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame | None]:
    """Links on long keys whose double is a long too, and the names of the keys where they had to be made."""
    kind = dict(links.dtypes)["v"]
    if kind in ("tinyint", "smallint", "int", "bigint"):
        links = work.keep(links.select(F.col("v").cast("long"), F.col("p").cast("long")))
        wide = F.lit(1 << 61)
        if links.where((F.col("v") >= wide) | (F.col("v") < -wide) | (F.col("p") >= wide) | (F.col("p") < -wide)).isEmpty():
            return links, None
    names = links.select(F.col("v").alias("name")).union(links.where("p is not null").select("p")).distinct()
    names = work.keep(names.withColumn("key", F.monotonically_increasing_id()))
    a, b = names.select(F.col("name").alias("v"), F.col("key").alias("kv")), names.select(F.col("name").alias("p"), F.col("key").alias("kp"))
    return work.keep(links.join(a, "v").join(b, "p", "left").select(F.col("kv").alias("v"), F.col("kp").alias("p"))), names


def hierarchy(nodes: DataFrame, id_col: str = "id", parent_col: str = "parent_id", order_col: str | None = "updated_at", finish_rows: int = FINISH_ROWS, hot_fanout: int = HOT_FANOUT) -> Hierarchy:
    """Trees of unknown depth from parent links; see `Hierarchy` for the result.

    Repeated rows of an id: the one with the greatest `order_col` is in force (ties: the
    greatest parent, null least). A null parent makes a root; a row with a null id is left
    out; a node that is its own parent is a loop of one. Ids may be of any type that can be
    compared. Other columns are not read, whatever their names. An empty table gives an empty
    result.
    """
    work = Workspace(nodes.sparkSession, "hierarchy")
    links, names = _keys(_links(nodes, id_col, parent_col, order_col), work)
    full = work.keep(_with_children(links))
    loops = loop_nodes(full, work, finish_rows)
    marked = full.join(loops.withColumn("on_loop", F.lit(1)), "v", "left")
    on = F.col("on_loop").isNotNull()
    forest = work.keep(
        marked.select(
            "v",
            F.when(~on, F.col("p")).alias("p"),
            ((F.col("n") - F.when(on, 1).otherwise(0)) == 0).alias("leaf"),
            F.when(on, ON_LOOP).when(F.col("real") == 0, MISSING).otherwise(SOUND).alias("g"),
            "n",
        )
    )
    hot = forest.where(F.col("n") > hot_fanout).select("v")
    hot = None if hot.isEmpty() else hot
    elements = work.keep(_tour(forest.drop("n"), hot))
    work.drop(links, full, loops, forest)
    ranked = rank_lists(elements, work, finish_rows)
    work.drop(elements)
    v, entering = F.shiftright("e", 1), F.col("e").bitwiseAND(1) == 0
    per = ranked.groupBy(v.alias("v")).agg(F.max(F.when(entering, F.col("r"))).alias("i"), F.max(F.when(~entering, F.col("r"))).alias("o"), F.max(F.when(entering, -F.col("d"))).alias("depth"), F.max("t").alias("t"), F.max("g").alias("g"))
    per = per.select("v", "i", F.coalesce("o", F.col("i") - 1).alias("o"), "depth", F.shiftright("t", 1).alias("anchor"), "g")
    per = per.where((F.col("g") != MISSING) | (F.col("v") != F.col("anchor")))
    if names is not None:
        a, b = names.select(F.col("key").alias("v"), F.col("name").alias("vn")), names.select(F.col("key").alias("anchor"), F.col("name").alias("an"))
        per = per.join(a, "v").join(b, "anchor").select(F.col("vn").alias("v"), "i", "o", "depth", (F.col("v") == F.col("anchor")).alias("top"), F.col("an").alias("anchor"), "g")
    else:
        per = per.withColumn("top", F.col("v") == F.col("anchor"))
    sound = F.col("g") == SOUND
    kind = F.when(sound, "tree").when(F.col("g") == MISSING, "dangling").when(F.col("top"), "loop").otherwise("below_loop")
    out = per.select(
        F.col("v").alias("id"),
        kind.alias("kind"),
        F.when(sound, F.col("anchor")).alias("root"),
        F.when(sound, F.col("depth")).alias("depth"),
        "anchor",
        F.col("depth").alias("anchor_depth"),
        F.col("i").alias("tour_in"),
        F.col("o").alias("tour_out"),
        F.when(~sound & F.col("top") & (F.col("g") == ON_LOOP), None).otherwise(F.shiftright(F.col("i") - F.col("o") - 1, 1)).alias("n_descendants"),
    )
    return Hierarchy(out, work)


def ancestors(tree: Hierarchy, of: DataFrame | None = None, among: DataFrame | None = None, up_to: int | None = None, sound: bool = False, stretch: int = STRETCH) -> DataFrame:
    """(id, ancestor, ancestor_depth, distance): every node paired with each node above it, up to its anchor.

    From the tour intervals alone: the ancestor of a node at depth d is the last node of that
    depth that was entered before it. The tours are cut into stretches, so a huge tree is
    searched in many tasks; what was entered last before a stretch is carried over from the
    stretches before. of: only for these ids. among: only these ids as ancestors; then a node
    is looked up once for each depth at which one of them stands, and not for each node above
    it. up_to: only ancestors so near. sound: only in sound trees.
    """
    nodes = tree.nodes.where("kind = 'tree'") if sound else tree.nodes
    nodes = nodes.select("id", "anchor", F.col("anchor_depth").alias("depth"), F.col("tour_in").alias("r"), F.col("tour_out").alias("out"))
    asked = nodes if of is None else nodes.join(of.select("id").distinct(), "id", "left_semi")
    tops, steps = nodes, F.sequence(F.greatest(F.col("depth") - up_to, F.lit(0)) if up_to else F.lit(0).cast("long"), F.col("depth") - 1)
    if among is not None:
        tops = nodes.join(among.select("id").distinct(), "id", "left_semi")
        few = [r[0] for r in tops.select("depth").distinct().limit(MOST_DEPTHS + 1).collect()]
        if len(few) <= MOST_DEPTHS:
            near = (lambda d: (d < F.col("depth")) & (d >= F.col("depth") - up_to)) if up_to else (lambda d: d < F.col("depth"))
            steps = F.filter(F.array(*map(F.lit, few)).cast("array<bigint>"), near)
    kind = dict(nodes.dtypes)["id"]
    entered = tops.select("anchor", F.col("depth").alias("d"), "r", F.struct("id", "out").alias("up"), F.lit(None).cast(kind).alias("id"), F.lit(None).cast("long").alias("depth"))
    above = asked.where("depth > 0").select("anchor", F.explode(steps).alias("d"), "r", F.lit(None).cast(f"struct<id:{kind},out:bigint>").alias("up"), "id", "depth")
    both = entered.unionByName(above).withColumn("c", F.floor(-F.col("r") / F.lit(stretch)))
    inside = Window.partitionBy("anchor", "d", "c").orderBy(F.desc("r")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.select("anchor", "d", "c", "r", "id", "depth", F.last("up", ignorenulls=True).over(inside).alias("up"))
    before = Window.partitionBy("anchor", "d").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    ends = both.groupBy("anchor", "d", "c").agg(F.min_by("up", F.when(F.col("up").isNotNull(), F.col("r"))).alias("end"))
    carried = ends.select("anchor", "d", "c", F.last("end", ignorenulls=True).over(before).alias("carry"))
    done = found.where("id is not null").join(carried, ["anchor", "d", "c"]).withColumn("a", F.coalesce("up", "carry"))
    # The anchor of a dangling tree is a parent that is no node: it has no row and is left out.
    return done.where("a is not null and r > a.out").select("id", F.col("a.id").alias("ancestor"), F.col("d").alias("ancestor_depth"), (F.col("depth") - F.col("d")).alias("distance"))


def paths(tree: Hierarchy) -> DataFrame:
    """(id, path): for every node of a sound tree the ids from its root to its parent."""
    chain = ancestors(tree).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("ancestor_depth", "ancestor"))).alias("c"))
    sound = tree.nodes.where("kind = 'tree'").select("id")
    empty = F.array().cast(f"array<{dict(tree.nodes.dtypes)['id']}>")
    return sound.join(chain, "id", "left").select("id", F.coalesce(F.col("c.ancestor"), empty).alias("path"))


def descendants(tree: Hierarchy, of: DataFrame | None = None) -> DataFrame:
    """(id, descendant, distance) for nodes of sound trees; `of`: only below these ids."""
    pairs = ancestors(tree, among=of, sound=True)
    return pairs.select(F.col("ancestor").alias("id"), F.col("id").alias("descendant"), "distance")


def rootless(tree: Hierarchy) -> DataFrame:
    """(id, kind): nodes whose chain of parents does not end at a root."""
    return tree.nodes.where("kind <> 'tree'").select("id", "kind")
