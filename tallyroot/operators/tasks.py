"""Steps of processing as rows: pattern probes, guards, claims with leases, states of whole subtrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyroot.operators.hierarchy import Hierarchy, ancestors


def text_patterns(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, patterns): how many headings, turns, table heads and lines a text has; nulls where there is no text to know it by."""
    t = F.concat(F.lit("\n"), F.col(text))
    known = F.trim(F.col(text)) != ""
    count = lambda form: F.when(known, F.size(F.regexp_extract_all(t, F.lit(form), F.lit(0))).cast("bigint"))
    found = {
        "headings": count(r"\n#{1,6}[ \t]+\S"),
        "turns": count(r"\n\[(?:user|assistant|system|tool)\]: "),
        "tables": count(r"\n[ \t]*\|(?:[ \t]*:?-+:?[ \t]*\|)+"),
        "lines": count(r"\n"),
    }
    return docs.select(key, F.create_map(*[x for name, n in found.items() for x in (F.lit(name), n)]).alias("patterns"))


#: Steps with the guards that must hold and those that must not: (pattern, operator, value).
RUNGS = (
    ("structure:conversation", [("turns", ">=", 2)], []),
    ("structure:declared", [("headings", ">=", 1)], [("turns", ">=", 2)]),
    ("structure:inferred", [("lines", ">=", 2)], [("headings", ">=", 1), ("turns", ">=", 2)]),
    ("extract:tables", [("tables", ">=", 1)], []),
)
_HOLDS = {">=": lambda a, b: a >= b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, "<": lambda a, b: a < b, "=": lambda a, b: a == b, "!=": lambda a, b: a != b}


def holds(patterns: Column, guard: tuple[str, str, object]) -> Column:
    """Whether a guard holds; null where its pattern was not measured. Unknown operators are errors."""
    name, op, value = guard
    if op not in _HOLDS:
        raise ValueError(f"no such operator: {op!r}")
    return _HOLDS[op](F.try_element_at(patterns, F.lit(name)), F.lit(value))


def guarded(probed: DataFrame, rungs) -> DataFrame:
    """probed (..., patterns) with `steps`: those whose guards hold, in order. A step with a guard that is not known stands down."""
    every = []
    for step, requires, forbids in rungs:
        ok = F.lit(True)
        for g in requires:
            ok = ok & holds(F.col("patterns"), g)
        for g in forbids:
            ok = ok & ~holds(F.col("patterns"), g)
        every.append(F.when(ok, F.lit(step)))
    return probed.withColumn("steps", F.filter(F.array(*every), lambda s: s.isNotNull()))


def settle(nodes: DataFrame, tree: Hierarchy) -> DataFrame:
    """(id, state, open): for nodes of sound trees the worst state of the node and all below it (failed, in_flight, settled) and how many of these are not settled.

    Only what is not settled is looked up along the tree.
    """
    unsettled = nodes.where("settled is null or settled <> 'settled'").select("id", F.when(F.col("settled") == "failed", 2).otherwise(1).alias("bad"))
    up = ancestors(tree, unsettled, sound=True).select("id", F.col("ancestor").alias("top")).unionByName(unsettled.select("id", F.col("id").alias("top")))
    worst = up.join(unsettled, "id").groupBy(F.col("top").alias("id")).agg(F.max("bad").alias("bad"), F.count("*").alias("open"))
    state = F.when(F.col("bad") == 2, "failed").when(F.col("bad") == 1, "in_flight").otherwise("settled")
    return tree.nodes.where("kind = 'tree'").select("id").join(worst, "id", "left").select("id", state.alias("state"), F.coalesce("open", F.lit(0)).alias("open"))


def claimable(tasks: DataFrame, now: Column, most_attempts: int = 3, limit: int = 100) -> DataFrame:
    """tasks with `place`: the first `limit` that a worker may take, by priority (highest first), age and id.

    tasks: (id, kind, state, priority, attempts, created_at, lease_until). Ready ones may be
    taken, failed ones while they have attempts left, claimed ones whose lease has run out. A
    claim is for a few tasks at a time, so the list is short.
    """
    tried = F.col("attempts") < most_attempts
    free = (F.col("state") == "ready") | ((F.col("state") == "failed") & tried) | ((F.col("state") == "claimed") & tried & (F.col("lease_until") < now))
    order = [F.desc("priority"), F.asc("created_at"), F.asc("id")]
    first = tasks.where(free).orderBy(*order).limit(limit)
    return first.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def claim(tasks: DataFrame, taken: DataFrame, now: Column, lease: str = "20 minutes") -> DataFrame:
    """tasks after the taken ones (id) were claimed: one attempt more, and a new lease."""
    mark = taken.select("id", F.lit(True).alias("_t")).distinct()
    hit = F.col("_t").isNotNull()
    out = tasks.join(mark, "id", "left")
    return out.withColumns({"state": F.when(hit, "claimed").otherwise(F.col("state")), "attempts": F.col("attempts") + F.when(hit, 1).otherwise(0), "lease_until": F.when(hit, now + F.expr(f"interval {lease}")).otherwise(F.col("lease_until"))}).drop("_t")


def finish(tasks: DataFrame, ended: DataFrame) -> DataFrame:
    """tasks after reports (id, ok): done or failed; a report of a task that is not claimed changes nothing."""
    last = ended.groupBy("id").agg(F.max("ok").alias("_ok"))
    hit = (F.col("state") == "claimed") & F.col("_ok").isNotNull()
    return tasks.join(last, "id", "left").withColumn("state", F.when(hit & F.col("_ok"), "done").when(hit, "failed").otherwise(F.col("state"))).drop("_ok")


def attempts_summary(attempts: DataFrame) -> DataFrame:
    """(root, kind, tries, failed, done, seconds): what was tried for each tree, from attempts (root, kind, ok, started_at, ended_at); running ones have no end."""
    seconds = (F.unix_micros(F.col("ended_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / F.lit(1_000_000.0)
    return attempts.groupBy("root", "kind").agg(F.count("*").alias("tries"), F.count_if(~F.col("ok")).alias("failed"), F.count_if("ok").alias("done"), F.sum(seconds).alias("seconds"))
