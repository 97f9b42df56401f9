"""Queries of the llm operators against DuckDB, or running."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from compare import FOLDER, check, connect  # noqa: E402

from tallyroot.llm.queries import ORACLE, QUERIES  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, con, name):
    check(spark, con, QUERIES[name], ORACLE[name])


def rows(spark, name):
    return QUERIES[name](spark, FOLDER).collect()


def read(spark, name):
    return spark.read.parquet(f"{FOLDER}/{name}.parquet")


def test_p4(spark):
    """Noise is found in lines that are there, and the paragraphs are free of it."""
    pages = {}
    for r in read(spark, "nodes").where("usetype = 'scan:page' and content is not null").orderBy("updated_at").collect():
        pages[r.id] = r.content.split("\n")
    found = rows(spark, "p4_found")
    assert found and len(set(found)) == len(found) and {r.kind for r in found} <= {"running", "page_no", "broken", "misread"}
    lines = {(r.id, r.line_no): pages[r.id][r.line_no - 1] for r in found}
    assert all(x.strip() for x in lines.values())
    out = {(r.id, r.line_no) for r in found if r.kind in ("running", "page_no")}
    assert not out & {(r.id, r.line_no) for r in found if r.kind in ("broken", "misread")}
    texts = rows(spark, "p4_paragraphs")
    assert texts and all(r.text == r.text.strip() and r.text and "\n" not in r.text for r in texts)
    assert not {(r.id, r.line_no) for r in texts} & out


def test_p5(spark):
    """Pieces keep to the limits, overlap as stated, and are the whole text."""
    limits = {r.usetype: r for r in read(spark, "chunk_limits").collect()}
    nodes = {}
    for r in read(spark, "nodes").orderBy("updated_at").select("id", "usetype", "content").collect():
        nodes[r.id] = r
    by = {}
    for r in rows(spark, "p5_pieces"):
        by.setdefault(r.id, []).append(r)
    assert set(by) == {r.id for r in rows(spark, "p5_found")}
    for key, pieces in by.items():
        pieces.sort(key=lambda r: r.piece)
        limit = limits.get(nodes[key].usetype, limits["*"])
        assert [r.piece for r in pieces] == list(range(pieces[0].pieces))
        if pieces[0].unit == "char":
            text = nodes[key].content
            assert pieces[0].start == 0 and pieces[-1].stop == len(text)
            assert all(r.text == text[r.start : r.stop] and len(r.text) <= limit.max_chars for r in pieces)
            laps = {a.stop - b.start for a, b in zip(pieces, pieces[1:])}
            assert laps == {limit.overlap_chars} or max(laps) <= limit.overlap_chars < limit.max_chars and len(text) <= limit.max_chars


def test_p7_p8(spark):
    ids = {r.doc_id: len(r.ids) for r in rows(spark, "p7_ids")}
    placed = {}
    for r in rows(spark, "p8_packs"):
        placed.setdefault(r.doc_id, []).append(r)
    assert set(ids) == set(placed) and all(sum(r.length for r in p) == ids[k] for k, p in placed.items())
    assert {r.doc_id for r in rows(spark, "p8_found")} == {k for k, n in ids.items() if n > 4096}


def test_p9(spark):
    segments = rows(spark, "p9_segments")
    docs = {r.doc_id for r in read(spark, "documents").select("doc_id").collect()}
    assert {r.doc_id for r in segments} == docs and all(0 < r.confidence <= 1 for r in segments)
    codes = {r.code for r in read(spark, "lang_codes").collect()}
    found = rows(spark, "p9_found")
    assert found and {r.lang for r in found} <= codes
    spoken = {(r.doc_id, r.lang) for r in segments if r.sentences}
    assert {tuple(r) for r in found} <= spoken
    by = {}
    for k, x in spoken:
        by.setdefault(k, set()).add(x)
    # Documents that were not found are in one language, that of their label.
    label = {r.doc_id: r.label for r in segments}
    assert all(by[k] == {label[k]} for k in set(by) - {r.doc_id for r in found})
