"""Column links, sketches, profiles and references of cells; facts, shapes, scopes and entities; views with references."""

import random

import pytest
from pyspark.sql import functions as F

from tallyroot.functions import text as tx
from tallyroot.operators import derive, entities, facts, graph, sheets, views


def test_containment(spark):
    rnd = random.Random(3)
    cols = {f"c{i}": {f"v{rnd.randrange(60)}" for _ in range(rnd.randrange(1, 50))} | {"filler"} for i in range(25)}
    cols |= {"inner": {f"v{i}" for i in range(20)}, "outer": {f"v{i}" for i in range(2, 55)}, "twin": {f"v{i}" for i in range(20)}}
    rows = [("s", c, v) for c, vs in cols.items() for v in vs for _ in range(rnd.randrange(1, 3))] + [("s", "inner", None), ("s", "inner", " ")]
    df = spark.createDataFrame(rows, "sheet string, col string, value string")
    want = {(f"s.{a}", f"s.{b}", len(x & y)) for a, x in cols.items() for b, y in cols.items() if a != b and len(x) >= 2 and len(y) >= 2 and len(x & y) >= 0.9 * len(x)}
    assert {(r.a, r.b, r.shared) for r in sheets.containment(df).collect()} == want and ("s.inner", "s.outer", 18) in want
    with pytest.raises(ValueError):
        sheets.containment(df, most_pairs=1)
    found = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "d"), ("e", "f"), ("f", "e"), ("g", "x")], "a string, b string")
    unique = spark.createDataFrame([("a", True), ("b", False), ("c", False), ("d", True), ("e", False), ("f", False), ("g", True)], "c string, is_unique boolean")
    assert {tuple(r) for r in sheets.collapsed(found, unique).collect()} == {("b", "a", True, "key"), ("c", "d", False, "key"), ("f", "e", True, "shared"), ("g", "x", False, "unknown")}
    assert sheets.containment(df.limit(0)).count() == 0


def test_sketches(spark):
    sets = {"a": [f"x{i}" for i in range(300)], "b": [f"x{i}" for i in range(30, 600)], "c": [f"y{i}" for i in range(50)], "d": [None, "x1", "x1"], "e": []}
    df = sheets.sketches(spark.createDataFrame(list(sets.items()), "c string, v array<string>"), "c", "v")
    got = {r.c: (r.sketch, r.n) for r in df.collect()}
    assert got["d"][1] == 1 and got["e"] == (None, 0) and len(got["a"][0]) == 128
    pair = spark.createDataFrame([(got["a"][0], got["b"][0], 300, 570)], "a array<long>, b array<long>, na int, nb int")
    r = pair.select(sheets.jaccard_estimate(F.col("a"), F.col("b")).alias("j"), sheets.containment_estimate(sheets.jaccard_estimate(F.col("a"), F.col("b")), F.col("na"), F.col("nb")).alias("c")).first()
    assert abs(r.j - 270 / 600) < 0.15 and abs(r.c - 0.9) < 0.2
    near = sheets.sketched_containment(df.where("n > 1").withColumn("recipe", F.lit("128/1")), 0.7)
    assert {(r.a, r.b) for r in near.collect()} == {("a", "b")}


def test_profiles(spark):
    t = spark.createDataFrame([(i, f"name {i}", None if i % 2 else "x") for i in range(40)], "k int, name string, flag string")
    cells = sheets.cells(t, "s")
    assert {r.col: (r.n_distinct, r.at_least) for r in sheets.capped_distinct(cells, 10).collect()} == {"k": (10, True), "name": (10, True), "flag": (1, False)}
    lists = sheets.value_lists(cells, 10)
    assert {r.col: (r.has_values, r["values"]) for r in lists.collect()} == {"k": (False, None), "name": (False, None), "flag": (True, ["x"])}
    whole = sheets.profile_text(sheets.measure_columns(cells), sheets.value_lists(cells), 4000).first()
    assert whole.shown == 8 and whole.text.splitlines()[0] == "flag: text, 50% filled, 1 distinct, e.g. x"
    small = sheets.profile_text(sheets.measure_columns(cells), sheets.value_lists(cells), 140).first()
    assert len(small.text) <= 140 and 0 <= small.shown < 8
    r = sheets.split_rows(spark.createDataFrame([(1, "ab", "c"), (2, "word " * 30, "c"), (3, None, None)], "k long, x string, y string"), "k", ["x", "y"], 40).collect()
    assert {(q.k, q.col) for q in r} == {(1, None), (2, "x"), (2, "y")} and all(len(q.text) <= 40 for q in r) and sum(q.col == "x" for q in r) == 4
    refs = {"B2": (2, 2, 2, 2), "$C$5:A1": (1, 1, 5, 3), "Sheet 1!AA10:ab9": (9, 27, 10, 28), "A0": None, "1A": None, "": None, None: None, "A1:B": None}
    df = spark.createDataFrame([(k,) for k in refs], "r string").select("r", sheets.cell_range(F.col("r")).alias("x"))
    assert {q.r: q.x and tuple(q.x) for q in df.collect()} == refs
    grid = spark.createDataFrame([(i, j, f"{i},{j}") for i in range(1, 6) for j in range(1, 6)], "row int, column int, value string")
    assert {q.value for q in sheets.region(grid, "B2:C3").collect()} == {"2,2", "2,3", "3,2", "3,3"}
    for bad, most in (("B2:C3", 3), ("nothing", 9)):
        with pytest.raises(ValueError):
            sheets.region(grid, bad, most)
    heads = spark.createDataFrame([("s", 1, 1, "Sales"), ("s", 2, 1, None), ("s", 3, 1, "Cost"), ("s", 4, 1, None), ("s", 1, 0, "2023"), ("s", 2, 0, "2024"), ("s", 3, 0, "Cost"), ("s", 4, 0, "Note")], "sheet string, column int, level int, text string")
    assert {q.column: q.name for q in sheets.banner_names(heads).collect()} == {1: "Sales / 2023", 2: "Sales / 2024", 3: "Cost", 4: "Cost / Note"}


def test_contradictions(spark):
    rnd = random.Random(8)
    rows = [(i, rnd.choice([1, 1, 1, 2]), "p", rnd.choice("abc"), rnd.choice([None, rnd.randrange(1000)]), None) for i in range(120)]
    rows = [(i, s, p, o, low, rnd.choice([None, (low or 0) + rnd.choice([0, 1, 7, 300])])) for i, s, p, o, low, _ in rows]
    df = spark.createDataFrame(rows, "id int, subject_id int, predicate string, object string, valid_from int, valid_until int")
    after = lambda x, y: x is None or y is None or x <= y
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and a[3] != b[3] and after(a[4], b[5]) and after(b[4], a[5])}
    got = [tuple(r) for r in graph.lint_contradictions(df).collect()]
    assert set(got) == want and len(got) == len(want)


SCHEMA = "id long, subject_id long, predicate string, object string, datatype string, recorded_at int, invalidated_at int"


def test_facts(spark):
    held = spark.createDataFrame([(1, 1, "n", "1", "int", 1, None), (2, 1, "n", "2", None, 1, 5)], SCHEMA)
    new = spark.createDataFrame([(3, 1, "n", "1", None, 2, None), (4, 1, "n", "1", "int", 2, None)], SCHEMA)
    assert {r.id for r in facts.upsert(held, new).collect()} == {1, 2, 3}  # a node 1 is not the number 1
    gone = facts.invalidate(held, spark.createDataFrame([(1,)], "id long"), F.lit(9))
    assert {r.id: r.invalidated_at for r in gone.collect()} == {1: 9, 2: 5}
    for i in (2, 77):
        with pytest.raises(ValueError):
            facts.invalidate(held, spark.createDataFrame([(i,)], "id long"), F.lit(9))
    cases = [("24:00:00", True), ("24:00:01", False), ("23:59:59.5Z", True), ("25:00:00", False)]
    for t, ok in cases:
        assert spark.range(1).select(tx.valid_literal(F.lit(f"2024-02-29T{t}"), F.lit("dateTime")).alias("x")).first().x is ok
    for v, ok in (("32767", True), ("32768", False), ("-32768", True), ("1.0", False)):
        assert spark.range(1).select(tx.valid_literal(F.lit(v), F.lit("short")).alias("x")).first().x is ok
    links = spark.createDataFrame([(1, 2, "a", "rule"), (1, 3, "a", None), (2, 3, "b", "rule")], "source_id long, target_id long, link_type string, produced_by string")
    fresh = spark.createDataFrame([(1, 2, "a"), (5, 6, "a"), (5, 6, "a")], "source_id long, target_id long, link_type string")
    assert {tuple(r) for r in derive.rederived_links(links, fresh, "rule").collect()} == {(1, 3, "a", None), (1, 2, "a", "rule"), (5, 6, "a", "rule")}
    with pytest.raises(ValueError):
        derive.rederived_links(links, spark.createDataFrame([(1, 3, "a")], "source_id long, target_id long, link_type string"), "rule")


def test_shapes_and_scope(spark):
    rows = [(1, 1, "type", "P", None), (2, 2, "type", "P", None), (3, 1, "age", "x", "int"), (4, 1, "knows", "2", None), (5, 2, "knows", "9", None), (6, 2, "age", "5", "int"), (7, 2, "age", "6", "int"), (8, 9, "knows", "2", None)]
    df = spark.createDataFrame([(*r, 1, None) for r in rows], SCHEMA)
    lines = ['{"shape": "a", "target_class": "P", "path": "age", "least": 1, "most": 1, "datatype": "int"}', '{"shape": "b", "target_class": "P", "path": "knows", "class": "P"}', '{"shape": "c", "target_class": "P", "path": "name", "least": 1, "allowed": ["q"]}']
    shapes = facts.shapes_from_json(spark.createDataFrame([(x,) for x in lines], "value string"))
    got = {tuple(r) for r in facts.shape_report(df, shapes).collect()}
    assert got == {("a", 1, "age", "datatype", 1), ("a", 2, "age", "most", 2), ("b", 2, "knows", "class", 1), ("c", 1, "name", "least", 0), ("c", 2, "name", "least", 0)}
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    inner, cut = facts.scoped_graph(df, ids(1, 2), ids(9))
    assert {r.id for r in inner.collect()} == {3, 4, 6, 7} and {tuple(r) for r in cut.collect()} == {(5, 2, 9), (8, 2, 9)}
    assert facts.scoped_graph(df, ids(1, 2), ids(5))[1].count() == 0


def test_entities(spark):
    rows = [(1, 10, "Paris, France"), (2, 10, "Parisian"), (3, 20, "Paris"), (4, 20, "London"), (5, 30, "paris"), (6, 30, None), (7, 10, "Jo")]
    known = spark.createDataFrame(rows, "id long, root long, title string")
    names = spark.createDataFrame([("Paris",), ("londom",), ("Nowhere",), ("jo",), ("",), (None,), ("Paris",)], "name string")
    got = {r.name: r.id for r in entities.resolve(names, known).collect()}
    assert got == {"Paris": 3, "londom": 4, "Nowhere": None, "jo": 7}
    assert {(r.name, r.id) for r in entities.candidates(names, known).where("name = 'Paris'").collect()} == {("Paris", 1), ("Paris", 2), ("Paris", 3), ("Paris", 5)}
    assert {(r.source_id, r.target_id) for r in entities.copies_elsewhere(known).collect()} == {(5, 3)}
    links = spark.createDataFrame([(i, i + 1, "same_as") for i in range(8)] + [(0, 50, "other")], "source_id long, target_id long, link_type string")
    seed = lambda i: spark.createDataFrame([(i,)], "id long")
    assert {(r.id, r.hops) for r in entities.cluster(links, seed(4)).collect()} == {(i, abs(i - 4)) for i in range(9)}
    for kw in ({"depth": 3}, {"most": 5}):
        with pytest.raises(ValueError):
            entities.cluster(links, seed(4), **kw)
    answers = [(1, 'Sure: [{"subject": "A", "predicate": "Lives In ", "object": "B", "confidence": 0.9}, {"subject": "A", "predicate": "x", "object": "C", "confidence": 0.2}, {"subject": "D", "predicate": "y", "object": "E"}]'), (2, "no list"), (3, None)]
    got = entities.facts_from_answers(spark.createDataFrame(answers, "source_id long, answer string")).collect()
    assert [(r.source_id, r.subject, r.predicate, r.object, r.confidence) for r in sorted(got, key=lambda r: r.place)] == [(1, "D", "y", "E", 1.0), (1, "A", "lives_in", "B", 0.9)]


def test_betweenness(spark):
    rnd = random.Random(4)
    edges = {}
    for _ in range(26):
        a, b = rnd.sample(range(14), 2)
        edges[min(a, b), max(a, b)] = edges.get((min(a, b), max(a, b)), 0) + rnd.choice([1.0, 1.0, 2.0])
    far = {(a, b): 0 if a == b else float("inf") for a in range(16) for b in range(16)}
    for (a, b), w in edges.items():
        far[a, b] = far[b, a] = w
    for k in range(16):
        for a in range(16):
            for b in range(16):
                far[a, b] = min(far[a, b], far[a, k] + far[k, b])

    def ways(a, b):
        return 1 if a == b else sum(ways(a, x) for x in range(16) if (min(x, b), max(x, b)) in edges and far[a, x] + edges[min(x, b), max(x, b)] == far[a, b])

    want = {}
    for v in range(16):
        want[v] = sum(ways(a, v) * ways(v, b) / ways(a, b) for a in range(16) for b in range(a + 1, 16) if v not in (a, b) and far[a, b] < float("inf") and far[a, v] + far[v, b] == far[a, b])
    half = [(a, b, w / 2) for (a, b), w in edges.items()] + [(b, a, w / 2) for (a, b), w in edges.items()]
    df = spark.createDataFrame(half + [(3, 3, 1.0)], "src long, dst long, weight double")
    got = {r.id: r.score for r in graph.betweenness(spark.range(16), df).collect()}
    assert {k: round(v, 8) for k, v in got.items()} == {k: round(v, 8) for k, v in want.items()}
    one = {r.id: r.score for r in graph.betweenness(spark.range(16), df, spark.createDataFrame([(0,)], "id long")).collect()}
    assert round(sum(one.values()), 8) == round(sum(ways(0, v) * ways(v, b) / ways(0, b) for v in range(1, 16) for b in range(1, 16) if v != b and far[0, b] < float("inf") and far[0, v] + far[v, b] == far[0, b]) / 2, 8)


def test_betweenness_of_trees(spark, monkeypatch):
    """Trees, and trees that hang on loops, from some sources and from all; on trees no table grows beyond the edges."""
    from tallyroot.work import Workspace

    rows = []
    keep = Workspace.keep

    def counted(self, df):
        rows.append((out := keep(self, df)).count())
        return out

    monkeypatch.setattr(Workspace, "keep", counted)
    rnd = random.Random(6)
    tree = [(rnd.randrange(max(0, i - 9), i), i, rnd.choice([1.0, 2.0])) for i in range(1, 60)] + [(60, 61, 1.0)]
    star = [(100, 101 + i, 1.0) for i in range(40)]
    loops = [(200 + i, 200 + (i + 1) % 6, 1.0) for i in range(6)] + [(202, 209, 1.0), (209, 210, 1.0), (210, 211, 1.0), (211, 209, 1.0), (205, 206, 1.0), (206, 207, 1.0), (206, 208, 1.0), (211, 212, 1.0)]
    for edges in (tree + star, loops, tree[:20] + loops + [(300, 301, 1.0)]):
        ids = sorted({x for a, b, _ in edges for x in (a, b)})
        near = {x: {} for x in ids}
        for a, b, w in edges:
            near[a][b] = near[b][a] = w
        far = {(a, b): 0.0 if a == b else near[a].get(b, float("inf")) for a in ids for b in ids}
        for k in ids:
            for a in ids:
                for b in ids:
                    far[a, b] = min(far[a, b], far[a, k] + far[k, b])
        ways = {}
        for a in ids:
            for b in sorted((b for b in ids if far[a, b] < float("inf")), key=lambda b: far[a, b]):
                ways[a, b] = 1 if a == b else sum(ways[a, x] for x in near[b] if far[a, x] + near[b][x] == far[a, b])
        for some in (None, [x for x in ids if x % 3 == 0]):
            want = {v: sum(ways[s, v] * ways[v, t] / ways[s, t] for s in some or ids for t in ids if len({s, t, v}) == 3 and (s, t) in ways and far[s, v] + far[v, t] == far[s, t]) / 2 for v in ids} | {999: 0.0}
            rows.clear()
            v = spark.createDataFrame([(x,) for x in [*ids, 999]], "id long")
            got = graph.betweenness(v, spark.createDataFrame(edges, "src long, dst long, weight double"), spark.createDataFrame([(x,) for x in [*some, 999]], "id long") if some else None)
            assert {r.id: round(r.score, 8) for r in got.collect()} == {k: round(x, 8) for k, x in want.items()}
            assert edges[-1] != star[-1] or max(rows) <= 2 * len(edges)


def test_bounded_walk(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (1, 9)], "src long, dst long")
    seed = spark.createDataFrame([(1,)], "id long")
    found, cut, deep = graph.bounded_neighbours(df, seed, 2, 3)
    assert [(r.id, r.hops) for r in found.orderBy("hops", "id").collect()] == [(2, 1), (9, 1), (3, 2)] and (cut, deep) == (False, True)
    found, cut, deep = graph.bounded_neighbours(df, seed, 9, 2)
    assert {r.id for r in found.collect()} == {2, 9} and (cut, deep) == (True, False)


def test_rollup(spark):
    from datetime import datetime as dt

    from tallyroot.operators import hierarchy, summaries

    rows = [(1, None, None, 0), (2, 1, "alpha", 0), (3, 1, "beta " * 20, 1), (4, 1, None, 2), (5, 4, "gamma", 0)]
    nodes = spark.createDataFrame([(*r, dt(2024, 1, 1)) for r in rows], "id long, parent_id long, content string, position int, created_at timestamp")
    tree = hierarchy.hierarchy(nodes, order_col=None)
    got = {r.id: (r.how, r.text) for r in summaries.rollup(nodes, tree, 50).collect()}
    assert got == {1: ("deferred", None), 4: ("concatenated", "gamma")}
    got = {r.id: (r.how, r.text) for r in summaries.rollup(nodes, tree, 50, lambda t: F.substring(t, 1, 5)).collect()}
    assert got == {1: ("summarised", "alpha"), 4: ("concatenated", "gamma")}


def test_views(spark):
    from datetime import datetime as dt

    rows = [(1, None, "Top", None, None), (2, 1, "Two", "# Head\n\nSee [[3]] and [[doc:9]].", 0), (3, 1, None, "First para.\n\nSecond para is long.", 1), (4, 2, "Leaf", "  ", 0)]
    nodes = spark.createDataFrame([(*r[:4], r[4], dt(2024, 1, 1), "section") for r in rows], "id long, parent_id long, title string, content string, position int, created_at timestamp, usetype string")
    top = nodes.where("id = 1")
    shown = lambda how: {r.child: (r.preview, r.n_children) for r in views.child_stubs(nodes, top, 12, how).collect()}
    assert shown("collapsed") == {2: ("# Head\n\nSee…", 1), 3: ("First para.…", 0)}
    assert shown("first-paragraph") == {2: ("# Head", 1), 3: ("First para.", 0)} and shown("hidden") == {}
    assert shown("inline-headings")[2][0].startswith("# Head\n\n# Head")
    links = spark.createDataFrame([(2, 4, "cites"), (2, 3, None)], "source_id long, target_id long, link_type string")
    held = spark.createDataFrame([(2, "size", "12", "int"), (2, "near", "4", None)], "subject_id long, predicate string, object string, datatype string")
    text = lambda how: {r.id: r.text for r in views.with_references(nodes, links, held, how).collect()}
    body = "# Head\n\nSee [doc 3](/view/3) and [doc 9](/view/9)."
    assert text("hidden")[2] == body and text("footnotes")[3] == rows[2][3]
    assert text("footnotes")[2] == body + "\n\n\n## Footnotes\n\n[1] **cites** [Leaf](/view/4)\n[2] **links_to** [#3](/view/3)\n[3] **near** → [Leaf](/view/4)\n[4] **size** → 12\n"
    assert "\n<!-- sidebar -->\n## Footnotes\n\n- **cites**" in text("sidebar")[2] and "## References\n\n- " in text("inline-citations")[2]
    with pytest.raises(ValueError):
        views.child_stubs(nodes, top, how="odd")
