"""Leximin ranking against plain Python; hot groups against usual ones."""

import random
from collections import defaultdict

from tallyroot.llm import fusion

SCHEMA = "search_id long, document_id long, method string, score double, arrived_at string, vector int"


def plain(rows):
    best = defaultdict(dict)
    for g, i, m, s, *_ in rows:
        if None in (g, i, m, s) or s != s:
            continue
        m = m.lower().replace("-", "").replace("_", "").replace(" ", "")
        best[g, m][i] = max(s, best[g, m].get(i, s))
    groups = defaultdict(lambda: defaultdict(list))
    n = defaultdict(int)
    for (g, _), scores in best.items():
        n[g] += 1
        for i, s in scores.items():
            groups[g][i].append(sum(x <= s for x in scores.values()) / len(scores))
    out = []
    for g, items in groups.items():
        vec = {i: [0.0] * (n[g] - len(v)) + sorted(v) for i, v in items.items()}
        for place, i in enumerate(sorted(vec, key=lambda i: ([-x for x in vec[i]], i)), 1):
            out.append((g, i, vec[i], place))
    return sorted(out)


def rows(seed, groups=4, items=30):
    rnd = random.Random(seed)
    out = []
    for g in range(groups):
        for m in ("bm25", "BM25", "full-text", "vector"):
            for _ in range(rnd.randrange(0, items)):
                s = rnd.choice([None, float("nan"), *[rnd.choice([-5.0, 0.0, 1.5, 100.0, rnd.random()]) for _ in range(8)]])
                out.append((g, rnd.randrange(items), m, s, None, 1))
    return out + out[::5] + [(None, 1, "bm25", 1.0, None, 1), (1, None, "bm25", 1.0, None, 1), (1, 1, None, 1.0, None, 1)]


def got(df):
    return sorted((r.search_id, r.document_id, r.vector, r.place) for r in df.collect())


def test_ranking(spark):
    for seed in (1, 2):
        data = rows(seed)
        df = spark.createDataFrame(data, SCHEMA)
        assert got(fusion.leximin(df, "search_id", "document_id", "method", "score")) == plain(data)


def test_hot_groups(spark, monkeypatch):
    data = rows(3, groups=3, items=60)
    df = spark.createDataFrame(data, SCHEMA)
    assert got(fusion.leximin(df, "search_id", "document_id", "method", "score", hot_rows=40)) == plain(data)


def test_empty(spark):
    assert fusion.leximin(spark.createDataFrame([], SCHEMA), "search_id", "document_id", "method", "score").count() == 0
