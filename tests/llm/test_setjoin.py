"""Similar sets against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tallyroot.llm import setjoin


def brute(sets, theta, least):
    keys = sorted(k for k, s in sets.items() if len(s) >= least)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) >= theta * len(sets[a] | sets[b]) - 1e-9}


def data(seed, n=150):
    rnd = random.Random(seed)
    sets = {}
    for k in range(n):
        if k and rnd.random() < 0.6:
            s = set(sets[rnd.randrange(k)])
            for _ in range(rnd.randrange(0, 5)):
                s ^= {rnd.randrange(300)}
        else:
            s = set(rnd.sample(range(300), rnd.randrange(0, 40)))
        sets[k] = s or {1}
    return sets


@pytest.mark.parametrize("seed,theta,block,universe,members", [(1, 0.7, 20_000, 48, 2000), (2, 0.5, 20_000, 5, 1), (3, 0.7, 6, 3, 2)])
def test_pairs(spark, monkeypatch, seed, theta, block, universe, members):
    monkeypatch.setattr(setjoin, "BLOCK", block)
    monkeypatch.setattr(setjoin, "UNIVERSE", universe)
    monkeypatch.setattr(setjoin, "MEMBERS", members)
    sets = data(seed)
    df = spark.createDataFrame([(k, sorted(s), len(s)) for k, s in sets.items()], "k long, h array<long>, n int")
    pairs, members = setjoin.similar_sets(df, theta, 3, parts=16)
    got = {(r.column_id_a, r.column_id_b) for r in setjoin.expand(pairs, members, 3).collect()}
    assert got == brute(sets, theta, 3)


def test_merge():
    rnd = random.Random(6)
    for _ in range(200):
        lists = [sorted(rnd.sample(range(30), rnd.randrange(1, 15))) for _ in range(rnd.randrange(1, 8))]
        need = rnd.randrange(1, len(lists) + 1)
        assert setjoin.merge(lists, need) == [x for x in range(30) if sum(x in lst for lst in lists) >= need]


SCHEMA = "column_id long, column_values array<string>, sketch array<long>, sketch_count long, sketch_num_perm int, sketch_seed int, profiled_at int, n int, h int, k int"


def test_columns(spark):
    a = [f"v{i}" for i in range(10)]
    b = ["V0", " v1 ", "v2", "v3", "v4", "v5", "v6", "v7", "v8", "1,000", None, "", "  "]
    c = [*a[:9], "1000.0"]
    rows = [
        (1, a, None, None, None, None, 1, 0, 0, 0),
        (1, ["x"], None, None, None, None, 0, 0, 0, 0),
        (2, b, None, None, None, None, 1, 0, 0, 0),
        (3, c, [1] * 8, 50, 8, 1, 1, 0, 0, 0),
        (3, c, [1] * 8, 50, 8, 1, 1, 0, 0, 0),
        (4, a[:7], None, None, None, None, 1, 0, 0, 0),
        (5, None, list(range(20)), 50, 20, 1, 1, 0, 0, 0),
        (6, None, [*range(18), 77, 78], 60, 20, 1, 1, 0, 0, 0),
        (7, None, list(range(20)), 50, 20, 2, 1, 0, 0, 0),
        (8, None, list(range(20)), 5, 20, 1, 1, 0, 0, 0),
        (9, None, [*range(10), *range(90, 100)], 50, 20, 1, 1, 0, 0, 0),
        (10, None, None, None, None, None, 1, 0, 0, 0),
        (11, [], None, None, None, None, 1, 0, 0, 0),
        (None, a, None, None, None, None, 1, 0, 0, 0),
    ]
    got = {tuple(r) for r in setjoin.similar_columns(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(1, 2), (1, 3), (2, 3), (5, 6)}
    assert setjoin.similar_columns(spark.createDataFrame([], SCHEMA)).count() == 0


def test_values(spark):
    cases = {"1,234": "1234", " 1,234.00 ": "1234", "12,34": "12,34", "3.0": "3", "3.50": "3.50", " A  b\t": "a b", "": None, "  ": None, "-1,000,000": "-1000000"}
    df = spark.createDataFrame([(k,) for k in cases], "v string").select("v", setjoin.normal_value(F.col("v")).alias("x"))
    assert {r.v: r.x for r in df.collect()} == cases
