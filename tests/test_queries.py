"""Every query of the core with SQL against DuckDB; the others run and give rows of a stable schema."""

import os

import pytest

from tallyroot.plans import knowledge, retrieval, trees

from compare import FOLDER, check, connect

QUERIES = {**trees.QUERIES, **retrieval.QUERIES, **knowledge.QUERIES}
ORACLE = {**trees.ORACLE, **retrieval.ORACLE, **knowledge.ORACLE}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, con, name):
    check(spark, con, QUERIES[name], ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert len(QUERIES[name](spark, FOLDER).limit(5).collect()) > 0
