"""Pieces: limits, overlaps, round trips, boundaries."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyroot.llm import splitting as s


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab .!?\n# é日", max_size=400), st.integers(1, 60), st.integers(0, 50))
def test_round_trip(text, limit, overlap):
    spans = s.split(text, limit, overlap)
    lap = min(overlap, limit - 1)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert c == b - lap and d > b
    assert all(b - a <= limit for a, b in spans)
    assert "".join(text[a + (lap if i else 0) : b] for i, (a, b) in enumerate(spans)) == text


def test_boundaries():
    text = "# One\n" + "First sentence here. " * 3 + "\n\n" + "Second para. " * 4 + "\n# Two\n" + "words " * 10
    ends = [text[b - 8 : b] for _, b in s.split(text, 80, 0)[:-1]]
    assert all(x[-1].isspace() for x in ends)
    assert s.split("x" * 10, 4, 1) == [(0, 4), (3, 7), (6, 10)]
    assert s.split("", 5, 2) == [(0, 0)]
    assert s.split("a" * 100, 20, 15)[:3] == [(0, 20), (5, 25), (10, 30)]
    cjk = "これは文です。" * 20
    assert all(cjk[b - 1] == "。" for _, b in s.split(cjk, 20, 0))
    doctor = "We met Dr. Adams, e.g. on Monday. " * 5
    assert all(doctor[a:b].rstrip().endswith("Monday.") for a, b in s.split(doctor, 40, 0))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=200), st.integers(1, 60), st.integers(0, 50), st.integers(2, 20), st.integers(1, 90))
def test_token_limit(text, limit, overlap, most, n):
    n = min(n, len(text))
    dense = np.minimum(np.arange(len(text) + 1), n).astype(float)  # all tokens at the front
    spans = s.split(text, limit, overlap, dense, most)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(b - a <= limit and dense[b] - dense[a] <= most for a, b in spans)
    assert all(c <= b < d for (_, b), (c, d) in zip(spans, spans[1:]))


def test_places():
    text = "alpha beta gamma delta beta"
    at = s.token_places(text, [(0, "alpha"), (3, "Beta"), (9, "delta")], 12)
    assert at[0] == 0 and at[-1] == 12 and at[text.index("delta")] == 9
    assert s.token_places(text, [(0, "delta"), (1, "gamma")], 5) is None and s.token_places(text, [], 5) is None


NODES = "id long, parent_id long, content string, usetype string, updated_at int, document_id long, piece int"


def test_nodes(spark):
    rows = [
        (1, None, "a " * 100, "chunk", 1, None, 7),
        (1, None, "short", "chunk", 2, None, 7),
        (2, None, "b " * 100, "chunk", 1, None, 7),
        (2, None, "b " * 100, "chunk", 1, None, 7),
        (3, None, "c" * 51, None, 1, None, 7),
        (4, None, None, "chunk", 1, None, 7),
        (5, None, "", "odd", 1, None, 7),
        (6, None, "few chars here", "chunk", 1, None, 7),
        (7, None, "日" * 20, "chunk", 1, None, 7),
        (8, None, "x", "chunk", 1, None, 7),
        (None, None, "z" * 500, "chunk", 1, None, 7),
    ]
    tokens = [(4, 25), (4, 3), (6, 19), (6, 19), (8, 10), (99, 1000), (7, 9), (None, 50), (5, None)]
    limits = [("chunk", 40, 10, 5), ("*", 50, 10, 0), (None, 1, 1, 1)]
    t = spark.createDataFrame([(d, i, "t") for d, i in tokens], "document_id long, token_idx int, token_text string")
    lim = spark.createDataFrame(limits, "usetype string, max_chars int, max_tokens int, overlap_chars int")
    got = s.split_nodes(spark.createDataFrame(rows, NODES), t, lim)
    by = {}
    for r in got.collect():
        by.setdefault(r.id, []).append(r)
    assert sorted(by) == [2, 3, 4, 6, 8]
    assert {r.unit for r in by[4]} == {"token"} and [(r.start, r.stop) for r in sorted(by[4], key=lambda r: r.piece)] == [(0, 10), (5, 15), (10, 20), (15, 25), (20, 26)]
    assert all(len(r.text) <= 7 for r in by[6]) and by[8][0].unit == "token"
    assert sorted(r.id for r in s.split_ids(got).collect()) == [2, 3, 4, 6, 8]
    assert s.split_nodes(spark.createDataFrame([], NODES), t, lim).count() == 0
    assert s.split_nodes(spark.createDataFrame(rows, NODES), t.limit(0), lim.limit(0)).count() == 0
