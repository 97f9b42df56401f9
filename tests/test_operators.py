"""Core operators on literal fixtures and against plain Python."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyroot.functions import text as tx
from tallyroot.operators import chunking, evaluation, facts, graph, hierarchy, retrieval, sheets, views
from tallyroot.sources import readers
from tallyroot.streaming import incremental


def test_metrics(spark):
    run = spark.createDataFrame([("q", d, i) for i, d in enumerate("abcd", 1)], "query string, doc string, rank int")
    judged = spark.createDataFrame([("q", "a", 1), ("q", "c", 2), ("q", "e", 1), ("q", "z", 0), ("empty", "x", 0)], "query string, doc string, grade int")
    m = {r["query"]: r for r in evaluation.metrics(run, judged).collect()}
    q = m["q"]
    assert abs(q.ndcg - 0.6387878864795979) < 1e-12 and abs(q.precision - 0.2) < 1e-12
    assert abs(q.recall - 2 / 3) < 1e-12 and abs(q.ap - 0.5555555555555555) < 1e-12 and q.rr == 1.0
    assert tuple(m["empty"])[1:] == (0.0,) * 5
    with pytest.raises(ValueError):
        evaluation.means(evaluation.metrics(run, judged.limit(0)))


def test_rrf_ties(spark):
    rows = [("q", "vector", 5, 1), ("q", "bm25", 5, 2), ("q", "vector", 6, 2), ("q", "other", 7, 1)]
    got = {r.doc: r.score for r in retrieval.rrf(spark.createDataFrame(rows, "query string, method string, doc int, rank int")).collect()}
    assert got == {5: 0.86 / 61 + 0.14 / 62, 6: 0.86 / 62, 7: 1 / 61}


def test_container_is_concatenation(spark):
    """A container scores as its leaves' concatenation would under the leaves' statistics."""
    nodes = spark.createDataFrame([(1, None), (2, "alpha beta gamma"), (3, "beta delta"), (4, "epsilon zeta beta")], "id long, content string")
    members = spark.createDataFrame([(1, 2), (1, 3)], "id long, member long")
    index = retrieval.build_index(nodes, "id", "content")
    terms = retrieval.query_terms(spark.createDataFrame([(0, "Beta gamma, beta")], "q int, t string"), "q", "t")
    got = retrieval.container_bm25(index, terms, members).collect()
    whole = retrieval.build_index(spark.createDataFrame([(1, "alpha beta gamma beta delta")], "id long, content string"), "id", "content")
    want = retrieval.bm25(retrieval.Index(whole.occurrences, whole.lengths, index.terms, index.n, index.avg), terms).collect()
    assert len(got) == 1 and got[0].doc == 1 and abs(got[0].score - want[0].score) < 1e-12


def test_boosts(spark):
    df = spark.range(1)
    now, old = F.to_timestamp(F.lit("2025-01-08")), F.to_timestamp(F.lit("2025-01-01"))
    r = df.select(retrieval.recency(F.lit(2.0), old, now, 1.0), retrieval.recency(F.lit(2.0), now, old, 1.0), retrieval.recency(F.lit(2.0), F.lit(None).cast("timestamp"), now, 1.0), retrieval.importance(F.lit(1.0), F.lit(10.0), 0.5)).first()
    assert [round(x, 9) for x in r] == [3.0, 4.0, 2.0, 1.5]
    with pytest.raises(Exception, match="importance"):
        df.select(retrieval.importance(F.lit(1.0), F.col("id") + 11.0, 0.5)).collect()


def test_globs(spark):
    df = spark.createDataFrame([("a:b",), ("ax",), ("[x]",), ("%",), ("_",), ("q",), (None,)], "u string")
    pick = lambda g: [r.u for r in df.where(tx.matches_globs(F.col("u"), g)).collect()]
    assert pick("a:*") == ["a:b"] and pick("a?") == ["ax"] and pick("[x], %*") == ["[x]", "%"] and pick(["_?", "_"]) == ["_"]
    assert [r.u for r in df.where(tx.usetype_gate(F.col("u"), excluded=["a*", "q"])).collect()] == ["[x]", "%", "_", None]
    for bad in ("", "a,,b", "a,a"):
        with pytest.raises(ValueError):
            tx.matches_globs(F.col("u"), bad)


def test_literals(spark):
    rows = [("1", "integer", True), ("1.0", "integer", False), ("99999999999", "int", False), ("2024-02-30", "date", False), ("2024-02-29", "date", True), ("INF", "double", True), ("x", "custom", True), (None, "string", False), ("0", "positiveInteger", False), ("yes", "boolean", False), ("a b", "anyURI", False)]
    df = spark.createDataFrame(rows, "v string, t string, want boolean").withColumn("got", tx.valid_literal(F.col("v"), F.col("t")))
    assert [tuple(r) for r in df.where("got <> want").collect()] == []


def windows(a, b):
    return (a[0] is None or b[1] is None or a[0] <= b[1]) and (b[0] is None or a[1] is None or b[0] <= a[1])


def test_contradictions(spark):
    spans = [(1, 5), (5, 9), (None, 0), (6, None), (None, None), (10, 12)]
    rows = [(i, 1, "p", str(i), a, b) for i, (a, b) in enumerate(spans)] + [(50, 1, "p", "0", 1, 5), (60, 2, "p", "z", 1, 5)]
    got = {tuple(r) for r in graph.lint_contradictions(spark.createDataFrame(rows, "id int, subject_id int, predicate string, object string, valid_from int, valid_until int")).collect()}
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and a[3] != b[3] and windows(a[4:], b[4:])}
    assert got == want


def edges_of(spark, pairs):
    return spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src long, dst long, weight double")


def test_pagerank_and_walks(spark):
    rnd = random.Random(3)
    n = 12
    pairs = [(a, rnd.randrange(n)) for a in range(n - 2) for _ in range(2)]
    v = spark.range(n)
    got = {r.id: r.score for r in graph.pagerank(v, edges_of(spark, pairs), rounds=60).collect()}
    w = np.zeros((n, n))
    for a, b in pairs:
        w[a, b] += 1
    p = np.full(n, 1 / n)
    for _ in range(200):
        out = w.sum(axis=1)
        lost = p[out == 0].sum()
        p = (0.15 + 0.85 * lost) / n + 0.85 * (w / np.where(out, out, 1)[:, None]).T @ p
    assert max(abs(got[i] - p[i]) for i in range(n)) < 1e-4 and abs(sum(got.values()) - 1) < 1e-9
    near = {r.id: r.hops for r in graph.neighbours(edges_of(spark, pairs), spark.createDataFrame([(0,)], "id long"), 2).collect()}
    adj = defaultdict(set)
    for a, b in pairs:
        adj[a].add(b)
        adj[b].add(a)
    one = adj[0] - {0}
    two = {x for y in one for x in adj[y]} - one - {0}
    assert near == {0: 0, **dict.fromkeys(one, 1), **dict.fromkeys(two, 2)}
    with pytest.raises(ValueError):
        graph.pagerank(v, edges_of(spark, pairs), reset=spark.createDataFrame([(99, 1.0)], "id long, weight double"))


def solved_rank(ids, edges, reset):
    """PageRank by solving its linear equations; edges: (src, dst, weight), reset: {id: weight}."""
    at = {x: i for i, x in enumerate(ids)}
    w, r = np.zeros((len(ids), len(ids))), np.zeros(len(ids))
    for a, b, x in edges:
        w[at[a], at[b]] += x
    for a, x in reset.items():
        r[at[a]] = x / sum(reset.values())
    out = w.sum(axis=1)
    p = np.where(out[:, None] > 0, w / np.where(out > 0, out, 1)[:, None], r[None, :])
    x = np.linalg.solve(np.eye(len(ids)) - 0.85 * p.T, 0.15 * r)
    return dict(zip(ids, x))


def test_seeded_rank(spark):
    """Two hops from weighted seeds, on a graph with loops, and as g_seeded runs it."""
    from tallyroot.plans import knowledge

    def brute(ids, edges, seeds):
        hops = dict.fromkeys(seeds, 0)
        for h in (1, 2):
            for a, b in [(a, b) for a, b, _ in edges] + [(b, a) for a, b, _ in edges]:
                if hops.get(a) == h - 1:
                    hops.setdefault(b, h)
        part = [x for x in ids if x in hops]
        inner = [e for e in edges if e[0] in hops and e[1] in hops]
        return hops, solved_rank(part, inner, seeds)

    def same(rows, ids, edges, seeds):
        hops, want = brute(ids, edges, seeds)
        assert {r.id: r.hops for r in rows} == hops and max(hops.values()) == 2
        assert max(abs(r.score - want[r.id]) for r in rows) < 1e-9

    edges = [(0, 1, 1.0), (1, 0, 1.0), (1, 2, 6.0), (2, 3, 1.0), (7, 2, 2.0), (7, 8, 1.0), (8, 9, 1.0), (9, 10, 1.0), (11, 7, 1.0)]
    seeds = {0: 3.0, 7: 1.0}
    frame = lambda rows, s: spark.createDataFrame(rows, s)
    got = graph.seeded_rank(spark.range(12), frame(edges, "src long, dst long, weight double"), frame(list(seeds.items()), "id long, weight double"))
    same(got.collect(), list(range(12)), edges, seeds)
    folder = "/root/testdata/sf0.001"
    ids = [r.id for r in knowledge._vertices(spark, folder).collect()]
    edges = [tuple(r) for r in graph.link_graph(knowledge._links(spark, folder)).select("src", "dst", "weight").collect()]
    rich = sorted(((-r.s_acctbal, r.s_suppkey) for r in spark.read.parquet(f"{folder}/supplier.parquet").collect() if r.s_acctbal > 0))[:5]
    same(knowledge.g_seeded(spark, folder).collect(), ids, edges, {k * 2: -b for b, k in rich})


def test_components(spark):
    pairs = [(i, i + 1) for i in range(20)] + [(50, 51), (51, 52), (52, 50), (60, 60)]
    ids = [*range(21), 50, 51, 52, 60, 70]
    got = {r.id: r.component for r in graph.components(edges_of(spark, pairs), spark.createDataFrame([(i,) for i in ids], "id long")).collect()}
    assert got == {**dict.fromkeys(range(21), 0), 50: 50, 51: 50, 52: 50, 60: 60, 70: 70}


def test_communities(spark):
    clique = lambda ids: [(a, b) for a in ids for b in ids if a < b]
    e = edges_of(spark, clique(range(5)) + clique(range(10, 15)) + [(4, 10)])
    v = spark.createDataFrame([(i,) for i in [*range(5), *range(10, 15)]], "id long")
    groups = defaultdict(set)
    for r in graph.label_communities(v, e).collect():
        groups[r.community].add(r.id)
    assert sorted(map(sorted, groups.values())) == [list(range(5)), list(range(10, 15))]
    assert {r.cohesion for r in graph.cohesion(graph.label_communities(v, e), e).collect()} == {1.0}


def test_change_points():
    rnd = np.random.default_rng(42)
    x = np.vstack([rnd.normal(0, 0.05, (8, 4)) + [1, 0, 0, 0], rnd.normal(0, 0.05, (8, 4)) + [0, 1, 0, 0]])
    assert chunking.change_points(x, 0.5) == [8, 16]
    cost = lambda a, b: ((x[a:b] - x[a:b].mean(axis=0)) ** 2).sum()
    best = {0: (-0.1, [])}
    for e in range(2, 17):
        best[e] = min(((best[a][0] + cost(a, e) + 0.1, [*best[a][1], e]) for a in best if e - a >= 2), key=lambda t: t[0])
    assert chunking.change_points(x, 0.1) == best[16][1]
    assert chunking.change_points(x[:1], 1.0) == [1] and chunking.change_points(x[:0], 1.0) == []
    assert chunking.bounded([1, 5, 20], 2, 8) == [5, 13, 20] and chunking.bounded([3], 5, 2) == [2, 3]


def test_chunks(spark):
    text = "Dr. No came. He left!  \"Why?\" nobody asked.\n\nA list:\n# One\nbody\n## Two\n\n### Three\ndeep\n# Four"
    df = spark.createDataFrame([(1, text, 0), (2, None, 0), (3, "", 0)], "doc_id int, text string, piece int")
    assert [r.text for r in chunking.sentences(df.where("doc_id = 1").withColumn("text", F.lit("Dr. No came. He left! Ok.")), "doc_id", "text").collect()] == ["Dr. No came.", "He left!", "Ok."]
    h = chunking.nest(chunking.headings(df, "doc_id", "text"), "doc_id").orderBy("section").collect()
    assert [(r.level, r.title, r.body, r.parent) for r in h[1:]] == [(1, "One", "body", None), (2, "Two", "", 1), (3, "Three", "deep", 2), (1, "Four", "", None)]
    assert [r.text for r in chunking.paragraphs(df, "doc_id", "text").orderBy("piece").limit(1).collect()] == ["Dr. No came. He left!  \"Why?\" nobody asked."]
    w = chunking.token_windows(spark.createDataFrame([(1, "a b c d e f g")], "doc_id int, text string"), "doc_id", "text", 4, 2)
    assert [r.text for r in w.orderBy("piece").collect()] == ["a b c d", "c d e f", "e f g"]
    p = chunking.packed_sentences(spark.createDataFrame([(1, "One two. Three four five. Six."), (2, "")], "doc_id int, text string"), "doc_id", "text", 4)
    assert [r.text for r in p.orderBy("piece").collect()] == ["One two.", "Three four five. Six."]


def test_conversations(spark):
    lines = [(1, 1, '{"prompt": "hi", "response": "hello"}'), (1, 2, "broken {"), (1, 3, '{"role": "user", "content": "more"}'), (2, 1, '{"role": "system", "content": "x"}'), (3, 1, None)]
    turns = readers.conversation_turns(spark.createDataFrame(lines, "c int, n int, line string"), "c", "n", "line")
    assert sorted(map(tuple, turns.collect())) == [(1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "more"), (2, 0, "system", "x")]
    text = {r.c: r.text for r in readers.conversation_text(turns, "c").collect()}
    assert text[1] == "[user]: hi\n\n[assistant]: hello\n\n[user]: more"


def test_readers(spark, tmp_path):
    (tmp_path / "a.md").write_text("# T")
    (tmp_path / "b.bin").write_bytes(b"\xff\xfe\x00\x01")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "d.txt").write_text("<!DOCTYPE html><html></html>")
    got = {r.path[-5:]: r.format for r in readers.read_files(spark, str(tmp_path)).collect()}
    assert got == {"/a.md": "md", "b.bin": "unknown", "c.pdf": "pdf", "d.txt": "html"}
    html = "<html><head><script>var a='</p>';</script></head><body><h1>Top</h1><p>One &amp; two<p>Three<br>four<ul><li>x</ul></body>"
    assert spark.createDataFrame([(html,)], "h string").select(readers.html_text(F.col("h"))).first()[0] == "# Top\n\nOne & two\n\nThree\nfour\n\n- x"
    (tmp_path / "set/qrels").mkdir(parents=True)
    (tmp_path / "set/corpus.jsonl").write_text('{"_id": "d1", "title": "t", "text": "x"}\n')
    (tmp_path / "set/queries.jsonl").write_text('{"_id": "q1", "text": "x"}\n')
    (tmp_path / "set/qrels/test.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td1\t2\n")
    assert [tuple(map(tuple, d.collect())) for d in readers.read_judged_set(spark, str(tmp_path / "set"))] == [(("d1", "t", "x"),), (("q1", "x"),), (("q1", "d1", 2),)]


def test_sheets(spark):
    t = spark.createDataFrame([("1.0", "x", None), ("1", "y", " "), ("2", "x", "TRUE")], "a string, b string, c string")
    got = {r.col: (r.n_rows, r.n_filled, r.n_distinct, r.is_unique, r.kind) for r in sheets.measure_columns(sheets.cells(t, "s")).collect()}
    assert got == {"a": (3, 3, 2, False, "number"), "b": (3, 3, 2, False, "text"), "c": (3, 1, 1, True, "bool")}
    rows = [("s", 0, ["", "x"]), ("s", 1, ["name", "name"]), ("s", 2, ["name", "size"]), ("s", 3, ["a", "1"]), ("t", 0, ["1", "2"])]
    assert {tuple(r) for r in sheets.find_header(spark.createDataFrame(rows, "sheet string, row int, cells array<string>")).collect()} == {("s", 2), ("t", 0)}


def test_all_columns_of_all_tables(spark, tmp_path):
    from tallyroot.plans import knowledge

    held = {
        "part": [(i, f"n{i}") for i in range(20)],
        "lineitem": [(i % 7, f"n{i % 3}") for i in range(50)],
        "events": [(100 + i, "x" if i % 2 else None) for i in range(9)],
        "other": [(i + 1, f"m{i}") for i in range(19)],
    }
    for t, rows in held.items():
        spark.createDataFrame(rows, "key long, name string").write.parquet(f"{tmp_path}/{t}.parquet")
    cols = {f"{t}.{c}": [str(r[i]) for r in rows if r[i] is not None] for t, rows in held.items() for i, c in enumerate(("key", "name"))}
    sets = {c: set(v) for c, v in cols.items() if len(set(v)) >= 2}
    want = {(a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a != b and len(sets[a] & sets[b]) >= 0.9 * len(sets[a])}
    assert ("lineitem.key", "part.key", 7) in want
    assert {(r.a, r.b, r.shared) for r in knowledge.c_containment_all(spark, str(tmp_path)).collect()} == want
    got = {f"{r.sheet}.{r.col}": (r.n_rows, r.n_filled, r.n_distinct) for r in knowledge.c_measures_all(spark, str(tmp_path)).collect()}
    assert got == {c: (len(held[c.split(".")[0]]), len(v), len(set(v))) for c, v in cols.items()}
    found = {(r.a, r.b) for r in knowledge.c_containment_all(spark, "/root/testdata/sf0.001").collect()}
    assert {("lineitem.l_partkey", "part.p_partkey"), ("supplier.s_nationkey", "nation.n_nationkey")} <= found


def test_facts(spark):
    schema = "subject_id long, predicate string, object string, datatype string, valid_from int, valid_until int, recorded_at int, invalidated_at int"
    held = spark.createDataFrame([(1, "likes", "a", None, None, None, 1, None), (1, "likes", "b", None, None, None, 1, 2)], schema)
    new = spark.createDataFrame([(1, " Likes ", "a", None, None, None, 3, None), (1, "likes", "b", None, None, None, 4, None), (1, "likes", "b", None, None, None, 5, None)], schema)
    assert sorted((r.object, r.recorded_at) for r in facts.upsert(held, new).collect()) == [("a", 1), ("b", 1), ("b", 4)]
    line = facts.ntriples(spark.createDataFrame([(1, "p", 'x"\n\\', "string", None, None, 1, None), (2, "q", "3", None, None, None, 1, None)], schema), "urn:")
    assert sorted(r.line for r in line.collect()) == ['<urn:1> <urn:p> "x\\"\\n\\\\"^^<http://www.w3.org/2001/XMLSchema#string> .', "<urn:2> <urn:q> <urn:3> ."]


def test_access(spark):
    nodes = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, None)], "id long, parent_id long")
    tree = hierarchy.hierarchy(nodes, order_col=None)
    grants = spark.createDataFrame([(1, "a", "read"), (2, "a", "write"), (2, "b", "read")], "root long, principal string, level string")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(views.readable(nodes, tree, grants, "b")) == [2, 3, 4] and ids(views.readable(nodes, tree, grants, "c")) == [4]
    assert ids(views.writable(nodes, tree, grants, "a")) == [2, 3, 4] and ids(views.writable(nodes, tree, grants, "b")) == [4]
    assert {r.id: r.access for r in views.access_keys(nodes, tree, grants).collect()} == {1: "a:read", 2: "a:write,b:read", 3: "a:write,b:read", 4: None}
    assert [tuple(r) for r in views.access_audit(nodes, tree, grants).collect()] == [(4, 1, 1)]


def test_texts_of_containers(spark):
    from datetime import datetime as dt

    rows = [(1, None, None, None), (2, 1, 1, None), (3, 1, 0, "a"), (4, 2, None, "d"), (5, 2, 3, "c"), (6, 5, 0, "hidden"), (7, 1, 2, " "), (8, 7, 0, "under blank"), (9, 1, 9, None), (10, 9, 0, "summed up")]
    nodes = spark.createDataFrame([(i, p, o, t, dt(2024, 1, 1)) for i, p, o, t in rows], "id long, parent_id long, position int, content string, created_at timestamp")
    tree = hierarchy.hierarchy(nodes, order_col=None)
    got = {r.id: (r.text, r.size, r.members) for r in views.effective_content(nodes, tree).collect()}
    assert got == {1: ("a\n\nc\n\nd\n\nunder blank\n\nsummed up", 31, 5), 2: ("c\n\nd", 4, 2), 9: ("summed up", 9, 1)}
    stored = spark.createDataFrame([(9, "short"), (3, "no container")], "id long, text string")
    got = {r.id: r.text for r in views.effective_content(nodes, tree, stored, most=25).collect()}
    assert got == {1: None, 2: "c\n\nd", 9: "summed up"}
    assert {(r.id, r.member) for r in views.frontier(nodes, tree, stored).where("summary").collect()} == {(1, 9)}
    assert {(r.id, r.member) for r in views.frontier(nodes, tree, depth=1).collect()} == {(1, 3), (2, 4), (2, 5), (9, 10)}
    few = nodes.where("id in (1, 3)")
    assert sorted(map(tuple, views.siblings(nodes, few).select("id", "sibling").collect())) == [(3, 2), (3, 7), (3, 9)]
    assert {tuple(r) for r in views.subtree_to_depth(tree, few, 1).collect()} == {(1, i, 1) for i in (2, 3, 7, 9)}
    assert {tuple(r) for r in views.children_page(nodes, few, 2, 1).collect()} == {(1, 7, 2, 1), (1, 9, 3, 1)}


def test_authority(spark):
    rnd = np.random.default_rng(2)
    parent = {i: int(rnd.integers(0, i)) if i % 37 else None for i in range(300)}
    score = {i: float(rnd.integers(0, 6)) for i in parent}
    nodes = spark.createDataFrame(list(parent.items()), "id long, parent_id long")
    scores = spark.createDataFrame(list(score.items()), "id long, score double")
    tree = hierarchy.hierarchy(nodes, order_col=None)
    some = sorted(s for s in score.values() if s > 0)
    reach = some[int(0.75 * (len(some) - 1))]
    assert graph.quantile_score(scores, 0.75) == reach and graph.quantile_score(scores.limit(0), 0.75) is None
    below, top = {i: [0.0, 0, 1] for i in parent}, {i: [] for i in parent}
    for i in parent:
        up, d = parent[i], 1
        while up is not None:
            b = below[up]
            b[0], b[1], b[2] = b[0] + score[i] * 0.7**d, b[1] + (score[i] >= reach), b[2] + 1
            top[up].append((-score[i] * 0.7**d, i))
            up, d = parent[up], d + 1
    got = {r.id: (round(r.below, 8), r.spread, r["size"]) for r in graph.subtree_authority(scores, tree).collect()}
    assert got == {i: (round(b[0], 8), b[1], b[2]) for i, b in below.items() if b[2] >= 3}
    few = graph.contributors(scores, tree, nodes.where("id in (0, 37, 5)"), 3).collect()
    for i in (0, 37, 5):
        assert [r.member for r in sorted((r for r in few if r.id == i), key=lambda r: r.place)] == [j for s, j in sorted((round(s, 12), j) for s, j in top[i] if s < 0)[:3]]


def test_stream_index(spark, tmp_path):
    src, out, mark = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "mark")
    for text in ("alpha beta", "beta gamma"):
        spark.createDataFrame([(1, text), (2, "delta")], "id long, text string").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("id long, text string").parquet(src)
        incremental.keep_index(stream, out, "id", "text", mark).awaitTermination()
    p, t = incremental.read_index(spark, out)
    assert sorted((r.doc, r.term) for r in p.collect()) == [(1, "beta"), (1, "gamma"), (2, "delta")]
    assert {r.term: r.df for r in t.collect()} == {"beta": 1, "gamma": 1, "delta": 1}


def test_nearest_blocks(spark):
    rnd = np.random.default_rng(1)
    v = rnd.normal(size=(60, 5))
    v[10] = v[11] = v[12]
    docs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(100, None), (101, [0.0] * 5)], "doc long, v array<double>")
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v[:20])] + [(30, None)], "query long, v array<double>")
    whole = sorted(map(tuple, retrieval.vector_search(docs, queries, 4).collect()))
    found = retrieval.nearest(docs, queries.withColumnRenamed("query", "q"), 4, block=3).withColumnRenamed("q", "query")
    blocks = sorted(map(tuple, retrieval.top_k(found, 4).collect()))
    n = v / np.linalg.norm(v, axis=1)[:, None]
    want = sorted((q, d, r) for q in range(20) for r, d in enumerate(sorted(range(60), key=lambda d: (-round(float(n[q] @ n[d]), 12), d))[:4], 1))
    assert [(a, b, r) for a, b, _, r in whole] == [(a, b, r) for a, b, _, r in blocks] == want
    assert retrieval.vector_search(docs, queries.limit(0), 4).count() == 0
    assert retrieval.vector_search(docs.limit(0), queries, 4).count() == 0


def test_fulltext(spark):
    from tallyroot.operators import fulltext

    assert fulltext.parse('one "two three" -four OR -"five six" seven') == [([["one"], ["two", "three"]], [["four"]]), ([["seven"]], [["five", "six"]])]
    assert fulltext.parse("-only") == [] and fulltext.parse(None) == [] and fulltext.parse(" OR ") == []
    docs = spark.createDataFrame([(1, "One two three"), (2, "two one three four"), (3, "seven five six"), (4, "seven six five"), (5, None), (6, "")], "id int, text string")
    queries = spark.createDataFrame([(0, 'one "two three"'), (1, "one three -four"), (2, 'nothing OR seven -"five six"'), (3, None), (4, "")], "q int, t string")
    assert sorted(map(tuple, fulltext.fulltext(docs, "id", "text", queries, "q", "t").collect())) == [(0, 1), (1, 1), (2, 4)]


def test_overlaps(spark):
    from tallyroot.operators import intervals

    rnd = random.Random(9)
    rows = lambda n: [(i, rnd.randrange(2), s := rnd.randrange(-50, 50), s + rnd.randrange(0, 30)) for i in range(n)]
    a, b = rows(40), rows(40)
    schema = "id int, g int, start long, stop long"
    got = {tuple(r) for r in intervals.overlaps(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), "g", 7).collect()}
    assert got == {(x[0], y[0], max(x[2], y[2]), min(x[3], y[3])) for x in a for y in b if x[1] == y[1] and x[2] < x[3] and y[2] < y[3] and x[2] < y[3] and y[2] < x[3]}


def test_templates(spark):
    from tallyroot.functions import templates

    v = F.create_map(F.lit("a"), F.lit("x{{b}}"), F.lit("n"), F.lit(None).cast("string"))
    r = spark.range(1).select(templates.render(F.lit("{{ a }}-{{n}}-{{z.y}}"), v).alias("t"), templates.missing(F.lit("{{ a }}{{z.y}}{{ b }}"), v).alias("m")).first()
    assert r.t == "x{{b}}--{{z.y}}" and r.m == ["z.y", "b"]


def test_ann_recall(spark):
    from tallyroot.operators import ann
    from tallyroot.sources.tables import table

    e = table(spark, "/root/testdata/sf0.01", "embeddings")
    docs = e.select(F.col("vec_id").alias("doc"), F.col("embedding").alias("v"))
    queries = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("v"))
    found = ann.ann_search(ann.build_vector_index(docs), queries, 10, 36)
    assert ann.recall(found, retrieval.vector_search(docs, queries, 10)) >= 0.9
    assert ann.build_vector_index(docs).rows.count() == docs.count()
    assert ann.ann_search(ann.build_vector_index(docs.limit(0)), queries, 10).count() == 0
    odd = docs.limit(3).unionByName(spark.createDataFrame([(900, None), (901, [0.0] * 64), (None, [1.0] * 64)], "doc long, v array<float>"))
    assert ann.ann_search(ann.build_vector_index(odd), queries.limit(1), 10).count() == 3


def test_mmr(spark):
    from tallyroot.operators import ann

    rows = [(1, 0, [1.0, 0.0], 9.0), (1, 1, [1.0, 0.01], 8.0), (1, 2, [0.0, 1.0], 1.0), (2, 5, [1.0, 1.0], 1.0), (2, 6, None, 3.0)]
    got = sorted(map(tuple, ann.mmr(spark.createDataFrame(rows, "g int, i int, v array<double>, r double"), "g", "i", "v", "r", 2).collect()))
    assert got == [(1, 0, 0), (1, 2, 1), (2, 5, 0)]


def test_methods():
    from tallyroot.functions.methods import Method, parse_method, with_preset

    assert parse_method("vector→maxsim@200:t15") == Method("vector", "maxsim", 200, 15) and parse_method("hybrid") == Method("hybrid")
    for bad in ("", "vector→", "x", "vector→maxsim", "vector→maxsim@0", "bm25→other@5"):
        with pytest.raises(ValueError):
            parse_method(bad)
    assert with_preset({"a": 1, "b": 2}, {"a": None, "b": 3, "c": 0}) == {"a": 1, "b": 3, "c": 0}


def test_layers(spark):
    from tallyroot.operators import summaries

    rnd = np.random.default_rng(5)
    base = np.eye(6)[[0, 2, 4]]
    v = [(i, (base[i % 3] + rnd.normal(0, 0.02, 6)).tolist()) for i in range(30)] + [(99, None)]
    rows = summaries.layers(spark.createDataFrame(v, "id long, v array<double>"), k=4).where("layer = 0").collect()
    groups = defaultdict(set)
    for r in rows:
        groups[r.cluster].add(r.id % 3)
    assert len(rows) == 30 and all(len(g) == 1 for g in groups.values())
    m = summaries.mean_vectors(spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 4.0])], "g int, v array<double>"), "g").first()
    assert (m.v, m.n) == ([2.0, 3.0], 2)


def test_layers_of_exact_links(spark):
    """With exact links layer 0 is the communities of the true nearest."""
    from tallyroot.operators import summaries
    from tallyroot.sources.tables import table

    rows = table(spark, "/root/testdata/sf0.1", "embeddings").where("vec_id % 3 = 0 and embedding is not null").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")).collect()
    level = spark.createDataFrame([(r.id, [float(x) for x in r.v]) for r in rows], "id long, v array<double>")
    x, ids = np.array([r.v for r in rows], dtype="float64"), [r.id for r in rows]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    true = {(ids[i], ids[j]): float(s[i, j]) for i in range(len(ids)) for j in np.argsort(-s[i])[:8] if s[i, j] > 0}
    groups = defaultdict(set)
    for r in summaries.layers(level, most=1, exact=True).collect():
        groups[r.cluster].add(r.id)
    e = spark.createDataFrame([(a, b, w) for (a, b), w in true.items()], "src long, dst long, weight double")
    want = defaultdict(set)
    for r in graph.label_communities(level, e).collect():
        want[r.community].add(r.id)
    assert all(min(g) == c for c, g in groups.items())
    assert {frozenset(g) for g in want.values() if len(g) > 1} <= {frozenset(g) for g in groups.values()} or any(len(g) == 1 for g in want.values())
    assert {(r.src, r.dst) for r in summaries.near_links(level, 8, exact=True).collect()} == set(true)


def test_rules_and_references(spark):
    from tallyroot.operators import derive

    schema = "subject_id long, predicate string, object string, datatype string, invalidated_at int, recorded_at int, derived_by string"
    rows = [(1, "in", "2", None, None, 1, None), (2, "in", "3", None, None, 1, None), (2, "in", "4", None, 5, 1, None), (1, "in", "9", "string", None, 1, None), (9, "in", "8", None, None, 1, None), (7, "within", "7", None, None, 1, "r")]
    got = {tuple(r)[:3] for r in derive.apply_rule(spark.createDataFrame(rows, schema), "r", "in", "in", "within", 6).where("derived_by = 'r'").collect()}
    assert got == {(1, "within", "3")}
    again = derive.apply_rule(derive.apply_rule(spark.createDataFrame(rows, schema), "r", "in", "in", "within", 6), "r", "in", "in", "within", 7)
    assert again.count() == 6
    copied = derive.apply_rule(spark.createDataFrame(rows, schema), "c", "within", None, "in", 6)
    assert {tuple(r)[:3] for r in copied.where("derived_by = 'c'").collect()} == {(7, "in", "7")}
    links = spark.createDataFrame([(5, 2, "cites")], "source_id long, target_id long, link_type string")
    refs = {tuple(r) for r in derive.back_references(links, spark.createDataFrame(rows, schema)).where("id = 2 or id = 9").collect()}
    assert refs == {(2, 5, "link", "cites"), (2, 1, "fact", "in")}
    a, b = derive.orphans(spark.createDataFrame([(1,), (2,)], "blob int"), spark.createDataFrame([(2, 1), (3, 1), (None, 1)], "blob int, doc int"), "blob")
    assert [r.blob for r in a.collect()] == [1] and [r.blob for r in b.collect()] == [3]


def test_paths_between(spark):
    from tallyroot.operators import derive

    rnd = random.Random(11)
    pairs = {(rnd.randrange(9), rnd.randrange(9)) for _ in range(14)}
    adj = defaultdict(set)
    for a, b in pairs:
        if a != b:
            adj[a].add(b)
            adj[b].add(a)
    found, stack = [], [[0]]
    while stack:
        p = stack.pop()
        if p[-1] == 5:
            found.append(p)
        elif len(p) <= 4:
            stack += [[*p, x] for x in adj[p[-1]] if x not in p]
    want = sorted(found, key=lambda p: (len(p), p))[:5]
    assert [r.path for r in derive.paths_between(edges_of(spark, pairs), 0, 5, 4, 5).orderBy("place").collect()] == want


def test_alignment(spark):
    from tallyroot.operators import alignment as al

    text = "Preface\n1. Ｆirst steps\nbody\n2. SECOND\nmore first steps"
    assert al.place_titles(text, ["First Steps", "missing", "Second", "First steps"]) == [11, None, 31, 43]
    assert al.align_blocks(["Alpha beta", "gone", "A long shared beginning, then this"], ["x", "ALPHA-beta", "a long shared beginning and that", "Alpha beta"]) == [1, None, 2]
    assert al.similarity("Order No", "order no") == 1.0 and al.similarity("", "x") == 0.0
    docs = spark.createDataFrame([(1, text, ["First steps", "Second"]), (2, None, ["a"]), (3, "plain", None)], "id int, t string, o array<string>")
    got = [(r.id, r.section, r.title, r.body) for r in al.split_outline(docs, "id", "t", "o").orderBy("id", "section").collect()]
    assert got[1] == (1, 1, "First steps", "Ｆirst steps\nbody\n2. ") and got[3] == (3, 0, None, "plain") and len(got) == 4
    pairs = al.name_similarity(spark.createDataFrame([("abcd", "abce"), (None, "x")], "a string, b string"), "a", "b")
    assert [r.similarity for r in pairs.collect()] == [0.75, 0.0]


def test_context_blocks(spark):
    from tallyroot.operators import derive

    rows = [(0, 2, 7, None, 0.5, "late"), (0, 1, 8, "T", 1234.5678, None)]
    got = derive.context_blocks(spark.createDataFrame(rows, "query int, rank int, id long, title string, score double, content string")).collect()
    assert [r.text for r in got] == ["[Source 1: T (8, 1,234.568)]\n\n\n[Source 2: untitled (7, 0.500)]\nlate"]


def test_in_force_wide(spark):
    from tallyroot.operators.current import in_force, in_force_wide
    from tallyroot.work import Workspace

    rnd = random.Random(5)
    rows = [(rnd.choice([None, *range(40)]), rnd.choice([None, 1, 2, 3]), rnd.choice([None, "a", "b"]), rnd.choice([None, 1])) for _ in range(90)]
    df = spark.createDataFrame(rows, "id int, updated_at int, content string, position int")
    work, keep = Workspace(spark, "wide"), ["content", "position"]
    plain = in_force(df, "id", "updated_at", keep).collect()
    assert sorted(map(str, plain)) == sorted(map(str, in_force_wide(df, "id", "updated_at", keep, work).collect()))
    assert in_force_wide(df.limit(0), "id", "updated_at", ["content"], work).count() == 0


def test_pagerank_rounds(spark, monkeypatch):
    """30 rounds as stated, in one task and in jobs, on a forest, with a loop, with shared steps and from seeds; few jobs where walks end."""
    from tallyroot.work import Workspace

    rnd = random.Random(8)
    n = 60
    forest = [(i, rnd.randrange(i), 1.0) for i in range(1, n - 4)]
    shared = [(rnd.randrange(n - 3), rnd.randrange(n), rnd.choice([0.5, 2.0])) for _ in range(150)]
    big = 1 << 60  # ids that no double holds
    kept = []
    keep = Workspace.keep
    monkeypatch.setattr(Workspace, "keep", lambda self, df: kept.append(1) or keep(self, df))
    for edges in (forest, forest + [(0, 5, 1.0), (n - 1, n + 7, 1.0)], shared):
        for seeds in (None, {3: 1.0, 17: 2.0, 40: 1.0}):
            w, r = np.zeros((n, n)), np.full(n, 1 / n)
            for a, b, x in edges:
                if b < n:
                    w[a, b] += x
            if seeds:
                r = np.array([seeds.get(i, 0.0) / 4 for i in range(n)])
            p, out = r, w.sum(axis=1)
            for _ in range(30):
                p = (0.15 + 0.85 * p[out == 0].sum()) * r + 0.85 * (w / np.where(out, out, 1)[:, None]).T @ p
            df = spark.createDataFrame([(a + big, b + big, x) for a, b, x in edges], "src long, dst long, weight double")
            v = spark.range(big, big + n)
            reset = spark.createDataFrame([(i + big, x) for i, x in seeds.items()], "id long, weight double") if seeds else None
            for finish in (200_000,) if seeds and edges is not shared else (0, 20, 200_000):
                kept.clear()
                got = {x.id - big: x.score for x in graph.pagerank(v, df, reset=reset, finish_edges=finish).collect()}
                assert len(got) == n and max(abs(got[i] - p[i]) for i in range(n)) < 1e-9, (len(edges), seeds, finish)
                assert finish < 200_000 or len(kept) <= 6
