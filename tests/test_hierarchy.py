"""Hierarchies against a walk in plain Python, with the parallel rounds forced on small inputs."""

import random

import pytest

from tallyroot.operators import hierarchy as h

SCHEMA = "id long, parent_id long, updated_at int, v string, r string"


def walk(parents):
    out = {}
    for v in parents:
        chain, u = [], v
        while u in parents and u not in chain:
            chain.append(u)
            u = parents[u]
        if u is None:
            out[v] = ("tree", chain[-1], len(chain) - 1, list(reversed(chain[1:])))
        elif u not in parents:
            out[v] = ("dangling", None, None, None)
        else:
            out[v] = ("loop" if u == v else "below_loop", None, None, None)
    return out


def result(tree):
    paths = {r.id: r.path for r in h.paths(tree).collect()}
    return {r.id: (r.kind, r.root, r.depth, paths.get(r.id)) for r in tree.nodes.collect()}


@pytest.mark.parametrize("seed,finish,fanout", [(1, 20, 10**6), (2, 0, 2), (3, 10**6, 10**6), (4, 5, 3)])
def test_random_forests(spark, seed, finish, fanout):
    rnd = random.Random(seed)
    n = 60
    parents = {}
    for v in range(-3, n):
        kind = rnd.random()
        parents[v] = None if kind < 0.1 else rnd.choice([900, 901]) if kind < 0.15 else rnd.randrange(-3, n) if kind < 0.3 else rnd.randrange(-3, max(v, -2)) if v > -3 else None
    for v in range(100, 130):  # a chain and a fan
        parents[v] = v - 1 if v > 100 else None
    for v in range(200, 230):
        parents[v] = 100
    rows = [(v, p, 2, "x", None) for v, p in parents.items()] + [(v, 100, 1, None, "y") for v in range(0, n, 7)] + [(1, parents[1], 2, "x", None), (None, 1, 5, None, None)]
    rnd.shuffle(rows)
    tree = h.hierarchy(spark.createDataFrame(rows, SCHEMA), finish_rows=finish, hot_fanout=fanout)
    assert result(tree) == walk(parents)
    got = {(r.id, r.descendant, r.distance) for r in h.descendants(tree).collect()}
    want = {(a, v, len(path) - i) for v, (kind, _, _, path) in walk(parents).items() if kind == "tree" for i, a in enumerate(path)}
    assert got == want
    counts = {r.id: r.n_descendants for r in tree.nodes.collect() if r.kind == "tree"}
    assert counts == {v: sum(a == v for a, _, _ in want) for v in counts}


def test_stretches(spark):
    rows = [(v, v - 1 if v else None, 1, None, None) for v in range(40)] + [(100 + v, v % 40, 1, None, None) for v in range(80)]
    tree = h.hierarchy(spark.createDataFrame(rows, SCHEMA))
    whole = {tuple(r) for r in h.ancestors(tree).collect()}
    cut = {tuple(r) for r in h.ancestors(tree, stretch=7).collect()}
    assert whole == cut and len(whole) == sum(range(40)) + sum(v % 40 + 1 for v in range(80))


def test_chosen_ancestors(spark, monkeypatch):
    rows = [(v, v - 1 if v % 9 else None, 1, None, None) for v in range(40)] + [(100 + v, v % 40, 1, None, None) for v in range(80)] + [(500, 501, 1, None, None), (502, 500, 1, None, None)]
    tree = h.hierarchy(spark.createDataFrame(rows, SCHEMA))
    whole = {tuple(r) for r in h.ancestors(tree).collect()}
    some = {1, 4, 5, 21, 33, 104, 500}
    few = spark.createDataFrame([(v,) for v in some], "id long")
    for most in (256, 1):
        monkeypatch.setattr(h, "MOST_DEPTHS", most)
        for kw in ({}, {"stretch": 7}):
            assert {tuple(r) for r in h.ancestors(tree, among=few, **kw).collect()} == {r for r in whole if r[1] in some}
        assert {tuple(r) for r in h.ancestors(tree, among=few, up_to=2).collect()} == {r for r in whole if r[1] in some and r[3] <= 2}
    assert {tuple(r) for r in h.ancestors(tree, up_to=2).collect()} == {r for r in whole if r[3] <= 2}
    assert {(a, d, n) for a, d, n in map(tuple, h.descendants(tree, few).collect())} == {(r[1], r[0], r[3]) for r in whole if r[1] in some - {500}}


def test_empty_and_ties(spark):
    assert h.hierarchy(spark.createDataFrame([], SCHEMA)).nodes.count() == 0
    rows = [(1, None, None, None, None), (2, None, 3, None, None), (2, 1, 3, None, None), (3, 3, None, None, None)]
    tree = h.hierarchy(spark.createDataFrame(rows, SCHEMA), finish_rows=0)
    assert result(tree) == {1: ("tree", 1, 0, []), 2: ("tree", 1, 1, [1]), 3: ("loop", None, None, None)}


def test_other_keys(spark):
    rows = [("a", None, 1), ("b", "a", 1), ("c", "b", 1), ("d", "zz", 1), ("e", "f", 1), ("f", "e", 1), ("", "c", 1)]
    tree = h.hierarchy(spark.createDataFrame(rows, "id string, parent_id string, updated_at int"), finish_rows=1)
    assert result(tree) == {"a": ("tree", "a", 0, []), "b": ("tree", "a", 1, ["a"]), "c": ("tree", "a", 2, ["a", "b"]), "": ("tree", "a", 3, ["a", "b", "c"]), "d": ("dangling", None, None, None), "e": ("loop", None, None, None), "f": ("loop", None, None, None)}
    big = 2**62
    tree = h.hierarchy(spark.createDataFrame([(big, None, 1), (-big, big, 1)], "id long, parent_id long, updated_at int"))
    assert result(tree) == {big: ("tree", big, 0, []), -big: ("tree", big, 1, [big])}
