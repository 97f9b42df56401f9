"""Chunks, trees and turns of texts; probes, guards and claims; hashed vectors; member indexes."""

from datetime import datetime as dt

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyroot.functions import text as tx
from tallyroot.operators import ann, chunking, embedding, hierarchy, indexing, retrieval, tasks


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB .!?\n\"(x", min_size=1, max_size=300), st.sampled_from(chunking.STRATEGIES), st.integers(1, 60), st.integers(1, 80), st.integers(1, 20))
def test_chunks(text, strategy, least, most, max_words):
    if not text.strip():
        return
    fits = (lambda t: True) if strategy == "sentence_window" else None
    got = chunking.chunk(text, strategy, max_words=max_words, least=least, most=most, fits=fits)
    assert all(len(t) <= most and t == t.strip() for _, _, t in got)
    # Nothing but white space is lost, and places are those of the text.
    assert "".join("".join(t.split()) for _, _, t in got) == "".join(text.split())
    for a, b, t in got:
        assert "".join(text[a:b].split()) == "".join(t.split())
    assert len(got) <= chunking.most_chunks(len(text), least, most)


def test_strategies():
    text = "Dr. No came. He left! Ok. See et al. 2017. (Yes). One\n\nTwo here. Short."
    cut = lambda *a, **k: [t for _, _, t in chunking.chunk(text, *a, **k)]
    assert cut("sentence") == ["Dr. No came.", "He left!", "Ok.", "See et al. 2017.", "(Yes).", "One\n\nTwo here.", "Short."]
    assert cut("paragraph") == ["Dr. No came. He left! Ok. See et al. 2017. (Yes). One", "Two here. Short."]
    assert cut("sentence_packed", max_words=6) == ["Dr. No came. He left! Ok.", "See et al. 2017. (Yes).", "One\n\nTwo here. Short."]
    assert cut("token_count", max_words=6, overlap=2) == ["Dr. No came. He left! Ok.", "left! Ok. See et al. 2017.", "al. 2017. (Yes). One Two here.", "Two here. Short."]
    assert cut("sentence", least=8) == ["Dr. No came.", "He left! Ok.", "See et al. 2017. (Yes).", "One\n\nTwo here. Short."]
    assert cut("sentence_window", fits=lambda t: len(t) <= 70, most=40) == ["Dr. No came. He left! Ok.", "See et al. 2017. (Yes). One\n\nTwo here.", "Short."]
    assert [t for _, _, t in chunking.chunk("a" * 50 + " bb cc", most=20)] == ["a" * 20, "a" * 20, "a" * 10, "bb cc"]
    halves = chunking.chunk("word " * 60, fits=lambda t: len(t) < 100)
    assert all(len(t) < 100 for _, _, t in halves) and len(halves) >= 3
    for bad in ({"strategy": "odd"}, {"strategy": "sentence_window"}, {"most": 0}, {"fits": lambda t: False}):
        with pytest.raises(ValueError):
            chunking.chunk("Some text.", **bad)
    with pytest.raises(ValueError):
        chunking.chunk("  ")


def test_tree_of_text(spark):
    text = "intro here\r\n# One\n\nAlpha. Beta.\n## Sub\nGamma.\n# Two\n"
    docs = spark.createDataFrame([(1, text), (2, "plain"), (3, None), (4, " \n"), (5, "# A\nb")], "doc_id long, text string")
    spans = {(r.doc_id, r.section): (r.parent, r.level, r.title, text[r.start : r.stop] if r.doc_id == 1 else None) for r in chunking.section_spans(docs, "doc_id", "text").collect()}
    assert spans[1, 0] == (None, 0, None, "intro here\r") and spans[1, 1] == (None, 1, "One", "# One\n\nAlpha. Beta.") and spans[1, 2][0] == 1 and spans[1, 3] == (None, 1, "Two", "# Two\n")
    assert {k for k in spans if k[0] != 1} == {(2, 0), (5, 1)}
    tree = chunking.tree_of(docs, "doc_id", "text")
    got = {(r.node, r.parent, text[r.start : r.stop]) for r in tree.where("doc_id = 1 and kind = 'chunk'").collect()}
    assert got == {("s0.0", "s0", "intro here"), ("s1.0", "s1", "Alpha. Beta."), ("s2.0", "s2", "Gamma.")}
    share = {r.doc_id: (r.chunks, r.covered) for r in chunking.coverage(tree, docs, "doc_id", "text").collect()}
    assert share[1] == (3, 28) and share[4] == (0, 0) and 3 not in share
    spoken = chunking.turns(spark.createDataFrame([(1, "[user]: Hi\n\nthere\n\n[assistant]: " + "Long one. " * 20), (2, "no turns")], "doc_id long, text string"), "doc_id", "text")
    assert [(r.turn, r.role, r.text[:9]) for r in spoken.orderBy("turn").collect()] == [(0, "user", "Hi\n\nthere"), (1, "assistant", "Long one.")]
    parts = chunking.turn_chunks(spoken, "doc_id", 100).collect()
    assert sorted((r.turn, r.piece) for r in parts if r.piece is not None) == [(1, 0), (1, 1)] and sum(r.piece is None for r in parts) == 2
    t = chunking.tables(spark.createDataFrame([(1, "a\n| x | y |\n|---|:-:|\n| 1 | 2 |\n| 3 | 4 |\nb | c")], "doc_id long, text string"), "doc_id", "text").collect()
    assert [tuple(r) for r in t] == [(1, 0, "| x | y |", 2)]


def test_tasks(spark):
    docs = spark.createDataFrame([(1, "# A\ntext"), (2, "[user]: a\n\n[assistant]: b"), (3, None), (4, "one line"), (5, "two\nlines\n| a |\n|---|\n| b |")], "doc_id long, text string")
    got = {r.doc_id: r.steps for r in tasks.guarded(tasks.text_patterns(docs, "doc_id", "text"), tasks.RUNGS).collect()}
    assert got == {1: ["structure:declared"], 2: ["structure:conversation"], 3: [], 4: [], 5: ["structure:inferred", "extract:tables"]}
    with pytest.raises(ValueError):
        tasks.holds(F.col("patterns"), ("lines", "~", 1))
    now = dt(2024, 5, 1)
    rows = [(1, "a", "ready", 0, 0, dt(2024, 1, 2), None), (2, "a", "ready", 5, 0, dt(2024, 1, 3), None), (3, "a", "failed", 0, 3, dt(2024, 1, 1), None), (4, "a", "claimed", 0, 1, dt(2024, 1, 1), dt(2024, 4, 1)), (5, "a", "claimed", 0, 1, dt(2024, 1, 1), dt(2024, 6, 1)), (6, "a", "done", 0, 1, dt(2024, 1, 1), None)]
    t = spark.createDataFrame(rows, "id long, kind string, state string, priority int, attempts int, created_at timestamp, lease_until timestamp")
    first = tasks.claimable(t, F.lit(now), limit=2)
    assert [r.id for r in first.orderBy("place").collect()] == [2, 4]
    after = tasks.claim(t, first, F.lit(now))
    assert {r.id: (r.state, r.attempts) for r in after.collect()} == {1: ("ready", 0), 2: ("claimed", 1), 3: ("failed", 3), 4: ("claimed", 2), 5: ("claimed", 1), 6: ("done", 1)}
    ended = tasks.finish(after, spark.createDataFrame([(2, True), (4, False), (1, True)], "id long, ok boolean"))
    assert {r.id: r.state for r in ended.where("id in (1, 2, 4)").collect()} == {1: "ready", 2: "done", 4: "failed"}
    tried = spark.createDataFrame([(1, "embed", True, dt(2024, 1, 1), dt(2024, 1, 1, 0, 0, 5)), (1, "embed", False, dt(2024, 1, 1), dt(2024, 1, 1, 0, 0, 1)), (1, "embed", None, dt(2024, 1, 1), None)], "root long, kind string, ok boolean, started_at timestamp, ended_at timestamp")
    assert [tuple(r) for r in tasks.attempts_summary(tried).collect()] == [(1, "embed", 3, 1, 1, 6.0)]


def test_settle(spark):
    nodes = spark.createDataFrame([(1, None, "settled"), (2, 1, "settled"), (3, 2, "failed"), (4, 1, "in_flight"), (5, None, None), (6, 2, "settled")], "id long, parent_id long, settled string")
    tree = hierarchy.hierarchy(nodes, order_col=None)
    assert {tuple(r) for r in tasks.settle(nodes, tree).collect()} == {(1, "failed", 2), (2, "failed", 1), (3, "failed", 1), (4, "in_flight", 1), (5, "in_flight", 1), (6, "settled", 0)}


def test_vectors_of_texts(spark):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "beta alpha beta"), (3, ""), (4, None), (5, "x" * 50)], "id long, text string")
    got = {r.id: r.v for r in embedding.embed(docs, "id", "text").collect()}
    assert got[1] == got[2] and sorted(map(abs, got[1]))[-2:] == [1.0, 2.0] and set(got) == {1, 2, 5}
    own = embedding.embed(docs, "id", "text", lambda t: F.array(F.length(t).cast("double")), kind="query", fits=lambda t: F.length(t) < 20)
    assert {r.id: r.v[0] for r in own.collect()} == {1: 29.0, 2: 29.0, 3: 14.0}
    hits = spark.createDataFrame([(7, 1), (7, 2), (7, 3), (7, 1)], "query long, doc long")
    texts = docs.select(F.col("id").alias("doc"), "text")
    asked = spark.createDataFrame([(7, "beta gamma")], "query long, text string")
    out = embedding.rescore(hits, texts, asked, embedding.shared_terms, 2).collect()
    assert [(r.doc, r.score, r["rank"]) for r in sorted(out, key=lambda r: r["rank"])] == [(1, 0.5, 1), (2, 0.5, 2)]
    rows = [(1, 0, 0.5), (1, 0, 0.5), (1, 1, -2.0), (1, 2, None), (2, 0, float("nan")), (3, 0, 7.0)]
    t = spark.createDataFrame(rows, "document_id long, token_idx int, s double")
    assert {r.id: r.importance for r in embedding.importance_of(t, "document_id", "s").collect()} == {1: 5.5, 2: 1.0, 3: 10.0}


def test_indexes(spark):
    rows = [(1, None, "folder", None, "settled"), (2, 1, "folder", None, "settled"), (3, 2, "chunk", "alpha beta", "settled"), (4, 2, "cell", "gamma", "settled"), (5, 1, None, "delta", "in_flight"), (6, 1, "chunk", "delta x", "settled"), (7, None, "chunk", "alone here", "settled")]
    nodes = spark.createDataFrame(rows, "id long, parent_id long, usetype string, content string, settled string")
    tree = hierarchy.hierarchy(nodes, order_col=None)
    members = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (3, 7)], "index int, root long")
    docs = indexing.indexed(nodes, tree, members)
    assert {(r["index"], r.doc) for r in docs.collect()} == {(1, 3), (1, 6), (2, 3), (3, 7)}
    assert {(r["index"], r.doc) for r in indexing.indexed(nodes, tree, members, []).collect()} == {(1, 3), (1, 4), (1, 6), (2, 3), (2, 4), (3, 7)}
    assert {r["index"]: (r.n, r.n_tokens) for r in indexing.index_sizes(docs).collect()} == {1: (2, 3), 2: (1, 2), 3: (1, 2)}
    asked = nodes.select("id").unionByName(spark.createDataFrame([(99,)], "id long"))
    assert {(r.id, r["index"], r.root) for r in indexing.covering(nodes, tree, members, asked).collect()} == {(1, 1, 1), (2, 1, 2), (3, 1, 2), (4, 1, 2), (5, 1, 1), (6, 1, 1), (7, 3, 7)}
    a = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.9)], "query long, doc long, score double")
    b = spark.createDataFrame([(1, 1, 0.7), (1, 3, 0.1)], "query long, doc long, score double")
    assert [(r.doc, r.score, r.kind) for r in indexing.merged(2, x=a, y=b).orderBy("rank").collect()] == [(2, 0.9, "x"), (1, 0.7, "y")]
    hits = spark.createDataFrame([(1, 3, 0.5), (1, 4, 0.9), (1, 6, 0.95), (1, 7, 1.0), (2, 6, 0.1)], "query long, doc long, score double")
    top, counts = indexing.projected(hits, nodes, nodes.where("id = 2"), "sum")
    assert [(r.query, r.parent, round(r.score, 6), r.best, r.hits, r["rank"]) for r in top.collect()] == [(1, 2, 1.4, 0.9, 2, 1)]
    assert {tuple(r) for r in counts.collect()} == {(1, 2, 1, 1), (2, 0, 0, 1)}
    assert indexing.applied(method="bm25", weights=None) == {"method": "bm25"}


def test_routes(spark):
    """Routes written down by hand."""
    want = {
        "": "hybrid", None: "hybrid", "alpha": "bm25", "alpha beta": "bm25", '"exact words" here': "fulltext", "cats AND dogs": "fulltext",
        "explain how token selection works in detail": "vector", "describe the index build": "vector", "what is the default weight of the recency boost": "vector",
        "index build queue": "hybrid", "is it done": "hybrid", "one two three four five six seven eight": "vector", "???": "bm25",
    }
    df = spark.createDataFrame([(k,) for k in want], "q string").select("q", tx.route(F.col("q")).alias("m"))
    assert {r.q: r.m for r in df.collect()} == want


def test_index_recall(spark):
    """The shipped defaults find nine tenths of the true neighbours, also where vectors lie evenly in all directions."""
    rnd = np.random.default_rng(4)
    v = rnd.normal(size=(1500, 24))
    docs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "doc long, v array<double>")
    queries = docs.where("doc % 30 = 0").withColumnRenamed("doc", "query")
    index = ann.build_vector_index(docs)
    assert 1 < index.probes < len(index.centroids)
    assert ann.recall(ann.ann_search(index, queries, 10), retrieval.vector_search(docs, queries, 10)) >= 0.9
    from tallyroot.operators import summaries

    v = docs.withColumnRenamed("doc", "id")
    near, true = summaries.near_links(v, 8), summaries.near_links(v, 8, exact=True)
    assert true.join(near, ["src", "dst"], "left_semi").count() >= 0.9 * true.count()
