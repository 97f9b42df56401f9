"""Containers: capacity, completeness, fill."""

import random
from collections import Counter

from tallyroot.llm import packing


def check(rows, out, capacity):
    used = {}
    parts = Counter()
    for r in out:
        parts[r.id] += r.length
        for x in range(r.offset, r.offset + r.length):
            assert (r.container, x) not in used
            used[r.container, x] = r.id
            assert x < capacity
    want = Counter()
    for k, n, *_ in rows:
        want[k] += max(n or 0, 0)
    assert +parts == +want
    return len({c for c, _ in used})


def test_random(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice([0, 1, 3, 7, 20, 21, 49, 50, 51, 130, rnd.randrange(60)]), "c") for i in range(400)] + [(1000, None, "c"), (1001, -4, "c"), (7, 20, "dup"), (None, 9, "n")]
    out = packing.pack(spark.createDataFrame(rows, "id long, n int, container string"), "id", "n", 50).collect()
    n = check(rows, out, 50)
    total = sum(max(r[1] or 0, 0) for r in rows)
    assert n <= -(-total // 50) + 2
    assert all(r.container == 0 for r in out if r.length == 0)
    by = {r.id: r for r in out if r.length == 0}
    assert 1000 in by and 1001 in by
    whole = [r for r in out if r.id is not None and 0 < r.id < 400 and r.part > 0]
    assert {r.id for r in whole} <= {k for k, v, _ in rows if v and v > 50}


def test_patterns():
    rnd = random.Random(5)
    for _ in range(50):
        cap = rnd.randrange(5, 200)
        h = {rnd.randrange(1, cap + 1): rnd.randrange(1, 300) for _ in range(20)}
        p = packing.patterns(h, cap)
        seen = Counter()
        for runs, count in p:
            assert sum(x * times for x, times in runs) <= cap and count > 0
            for x, times in runs:
                seen[x] += count * times
        assert seen == Counter(h)


def test_rule():
    """Shortest pack first, where best fit would put 30 beside 70; and item by item against the plain rule."""
    assert packing.patterns({70: 1, 60: 1, 30: 1}, 100) == [([(70, 1)], 1), ([(60, 1), (30, 1)], 1)]
    rnd = random.Random(6)
    for cap in (100, 4096):
        for _ in range(60):
            h = {rnd.randint(1, cap): rnd.randint(1, 40) for _ in range(rnd.randint(1, 30))}
            rooms = []
            for x in sorted(h, reverse=True):
                for _ in range(h[x]):
                    if rooms and max(rooms) >= x:
                        rooms[rooms.index(max(rooms))] -= x
                    else:
                        rooms.append(cap - x)
            got = [cap - sum(x * t for x, t in runs) for runs, n in packing.patterns(h, cap) for _ in range(n)]
            assert sorted(got) == sorted(rooms)
            assert len(packing.patterns(h, cap)) <= 3 * len(h)


def test_report(spark):
    rows = [(1, 0, 0, 50, 0, 0), (1, 1, 50, 10, 1, 0), (2, 0, 0, 40, 1, 10), (3, 0, 0, 0, 0, 0)]
    placed = spark.createDataFrame(rows, "id long, part int, start long, length long, container long, offset long")
    assert tuple(packing.pack_report(placed, "id", 50).first()) == (3, 2, 100, 0, 0, 0)
    bad = spark.createDataFrame([(1, 0, 0, 30, 0, 0), (2, 0, 0, 30, 0, 20), (3, 0, 0, 5, 1, 0), (3, 1, 5, 5, 2, 0)], "id long, part int, start long, length long, container long, offset long")
    assert tuple(packing.pack_report(bad, "id", 50).first()) == (4, 3, 70, 1, 1, 1)


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "id long, n int"), "id", "n").count() == 0
