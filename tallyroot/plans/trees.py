"""Problem 1: hierarchies from the parent links of `nodes`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyroot.operators import hierarchy as h
from tallyroot.sources.tables import table


def tree(spark: SparkSession, folder: str) -> h.Hierarchy:
    return h.hierarchy(table(spark, folder, "nodes"))


def kept_tree(spark: SparkSession, folder: str) -> h.Hierarchy:
    """The same with its nodes written, for queries that look into it several times."""
    found = tree(spark, folder)
    return h.Hierarchy(found.work.keep(found.nodes), found.work)


def sound_ancestors(spark: SparkSession, folder: str) -> DataFrame:
    """(id, ancestor, ancestor_depth, distance): nodes of sound trees with those above them."""
    return h.ancestors(tree(spark, folder), sound=True)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return h.rootless(tree(spark, folder))


def p1_hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    found = tree(spark, folder)
    return found.nodes.join(h.paths(found), "id", "left").select("id", "kind", "root", "depth", "path", "n_descendants")


def p1_descendants(spark: SparkSession, folder: str) -> DataFrame:
    return h.descendants(tree(spark, folder))


def p1_rounds(spark: SparkSession, folder: str) -> DataFrame:
    """The hierarchy with every contraction round run, down to a hundred rows."""
    found = h.hierarchy(table(spark, folder, "nodes"), finish_rows=100)
    return found.nodes.select("id", "kind", "root", "depth", "n_descendants")


QUERIES = {"p1_found": p1_found, "p1_hierarchy": p1_hierarchy, "p1_descendants": p1_descendants, "p1_rounds": p1_rounds}

_CUR = """cur AS (
  SELECT id, parent_id FROM (SELECT id, parent_id, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, parent_id DESC NULLS LAST) AS rn FROM nodes WHERE id IS NOT NULL) WHERE rn = 1
)"""
_UP = f"""WITH RECURSIVE {_CUR}, up(id, anc) AS (
  SELECT id, parent_id FROM cur WHERE parent_id IS NOT NULL
  UNION
  SELECT up.id, cur.parent_id FROM up JOIN cur ON cur.id = up.anc WHERE cur.parent_id IS NOT NULL
), looped AS (SELECT id FROM up WHERE id = anc),
kinds AS (
  SELECT cur.id, CASE
    WHEN cur.id IN (SELECT id FROM looped) THEN 'loop'
    WHEN cur.id IN (SELECT up.id FROM up JOIN looped ON up.anc = looped.id) THEN 'below_loop'
    WHEN cur.id IN (SELECT up.id FROM up WHERE up.anc NOT IN (SELECT id FROM cur)) THEN 'dangling'
    ELSE 'tree' END AS kind
  FROM cur
)"""
_DOWN = _UP.replace("kinds AS", "down(id, root, depth, path) AS (\n  SELECT id, id, 0::BIGINT, []::BIGINT[] FROM cur WHERE parent_id IS NULL\n  UNION ALL\n  SELECT cur.id, d.root, d.depth + 1, list_append(d.path, cur.parent_id) FROM cur JOIN down d ON cur.parent_id = d.id\n), kinds AS")

ORACLE = {
    "p1_found": f"{_UP} SELECT id, kind FROM kinds WHERE kind <> 'tree'",
    "p1_hierarchy": f"""{_DOWN}, below AS (SELECT anc, count(*) AS n FROM up GROUP BY anc)
SELECT k.id, k.kind, d.root, d.depth, d.path, CASE WHEN k.kind <> 'loop' THEN coalesce(b.n, 0) END AS n_descendants FROM kinds k LEFT JOIN down d ON d.id = k.id LEFT JOIN below b ON b.anc = k.id""",
    "p1_rounds": f"""{_DOWN}, below AS (SELECT anc, count(*) AS n FROM up GROUP BY anc)
SELECT k.id, k.kind, d.root, d.depth, CASE WHEN k.kind <> 'loop' THEN coalesce(b.n, 0) END AS n_descendants FROM kinds k LEFT JOIN down d ON d.id = k.id LEFT JOIN below b ON b.anc = k.id""",
    "p1_descendants": f"""{_DOWN} SELECT up.anc AS id, up.id AS descendant, d.depth - a.depth AS distance FROM up JOIN down d ON d.id = up.id JOIN down a ON a.id = up.anc""",
}
