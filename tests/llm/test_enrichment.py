"""Tail probabilities against exact arithmetic; scores against a plain adjustment."""

import math
import random
from fractions import Fraction

import numpy as np

from tallyroot.llm import enrichment as e


def exact(k, n, of, total):
    top = sum(math.comb(of, x) * math.comb(total - of, n - x) for x in range(k, min(n, of) + 1))
    return Fraction(top, math.comb(total, n))


def test_tail():
    rnd = random.Random(1)
    cases = []
    for _ in range(200):
        total = rnd.randrange(2, 3000)
        of, n = rnd.randrange(1, total + 1), rnd.randrange(1, total + 1)
        low = max(1, n + of - total)
        cases.append((rnd.randrange(low, min(n, of) + 1), n, of, total))
    got = e.log_upper_tail(*map(np.array, zip(*cases)))
    for c, g in zip(cases, got):
        p = exact(*c)
        want = math.log(p.numerator) - math.log(p.denominator)
        assert abs(g - want) < 1e-8 * max(1, abs(want)), c


def test_log_gamma():
    x = np.array([1, 1.5, 2, 7, 15.9, 16, 100, 1e6, 1e12])
    assert np.allclose(e.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-13, atol=1e-12)
    assert abs(e.log_gamma_step(np.array([1e15]), np.array([2.0]))[0] - (math.log(1e15 - 1) + math.log(1e15 - 2))) < 1e-9


SCHEMA = "index_id int, term string, document_id long, term_freq int, doc_freq long, score int"


def test_scores(spark):
    rnd = random.Random(2)
    rows = []
    for d in range(12):
        for t in range(40):
            if rnd.random() < 0.5:
                rows.append((1, rnd.choice([f"T{t}", f"t{t}"]), d, rnd.randrange(1, 9), None, 0))
    rows += rows[::4] + [(1, None, 3, 2, 1, 0), (1, "x", None, 2, 1, 0), (1, "y", 2, None, 1, 0), (1, "lonely", 2, 50, 1, 0), (1, "", 2, 1, 1, 0), (1, "", 3, 1, 1, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    counts = e.term_counts(df, source=["index_id"])
    k = {}
    for i, t, d, f, *_ in {r[:4] for r in rows if r[1] is not None and r[2] is not None and r[3]}:
        k[d, t.lower()] = k.get((d, t.lower()), 0) + f
    assert {(r.r, r.t): r.k for r in counts.collect()} == k
    total = sum(k.values())
    n, of, df_ = {}, {}, {}
    for (d, t), f in k.items():
        n[d] = n.get(d, 0) + f
        of[t] = of.get(t, 0) + f
        df_[t] = df_.get(t, 0) + 1
    want = {}
    for d in n:
        p = sorted((float(exact(f, n[d], of[t], total)), t) for (dd, t), f in k.items() if dd == d and df_[t] > 1)
        q, m = 1.0, len(p)
        for i in range(m, 0, -1):
            q = min(q, p[i - 1][0] * m / i)
            want[d, p[i - 1][1]] = (-math.log(p[i - 1][0]), -math.log(q))
    got = {(r.r, r.t): (r.raw, r.score) for r in e.enrichment(counts).collect()}
    assert got.keys() == want.keys()
    for key, (raw, score) in want.items():
        assert abs(got[key][0] - raw) < 1e-7 and abs(got[key][1] - score) < 1e-7
    best = {r.r: r.t for r in e.most_distinctive(e.enrichment(counts)).collect()}
    assert all(abs(want[d, t][0] - max(w[0] for (dd, _), w in want.items() if dd == d)) < 1e-9 for d, t in best.items())
    part = e.enrichment(counts, of=spark.createDataFrame([(3,)], "r long"))
    assert {(r.r, r.t): (r.raw, r.score) for r in part.collect()} == {x: v for x, v in got.items() if x[0] == 3}


def test_empty(spark):
    assert e.enrichment(e.term_counts(spark.createDataFrame([], SCHEMA))).count() == 0
