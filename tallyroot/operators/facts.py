"""Time-valid facts: (subject_id, predicate, object, datatype, valid_from, valid_until, recorded_at, invalidated_at)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyroot.functions.text import predicate_name, valid_literal

#: What makes two facts the same; a literal is told from a node, and from other literals, by its datatype.
KEY = ["subject_id", "predicate", "object", "datatype"]


def not_held(new: DataFrame, held: DataFrame) -> DataFrame:
    """The new facts whose key is none of the held ones'; a null datatype is a key like any other."""
    keys = held.select(*[F.col(c).alias(f"_{c}") for c in KEY]).distinct()
    same = F.lit(True)
    for c in KEY:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return new.join(keys, same, "left_anti")


def upsert(facts: DataFrame, new: DataFrame) -> DataFrame:
    """facts with the new ones that are not held yet; of repeated new facts the first recorded counts."""
    w = Window.partitionBy(*KEY).orderBy("recorded_at")
    fresh = new.withColumn("predicate", predicate_name(F.col("predicate"))).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return facts.unionByName(not_held(fresh, facts.where("invalidated_at is null")), allowMissingColumns=True)


def supersede(facts: DataFrame) -> DataFrame:
    """Of a subject's facts of one predicate only the newest stays live: each earlier one is invalidated when the next is recorded."""
    w = Window.partitionBy("subject_id", "predicate").orderBy("recorded_at", "object")
    return facts.withColumn("invalidated_at", F.coalesce("invalidated_at", F.lead("recorded_at").over(w)))


def invalidate(facts: DataFrame, which: DataFrame, now: Column) -> DataFrame:
    """facts with those named (id) invalidated; refused if one of them is unknown or invalidated already."""
    asked = which.select("id").distinct()
    bad = asked.join(facts.where("invalidated_at is null").select("id"), "id", "left_anti").limit(5).collect()
    if bad:
        raise ValueError(f"no live facts: {sorted(r.id for r in bad)}")
    mark = asked.withColumn("_m", F.lit(True))
    return facts.join(mark, "id", "left").withColumn("invalidated_at", F.when(F.col("_m"), now).otherwise(F.col("invalidated_at"))).drop("_m")


def shapes_from_json(lines: DataFrame, column: str = "value") -> DataFrame:
    """(shape, target_class, path, least, most, datatype, allowed, class): constraints, one row each, from JSON lines with these names; unreadable lines are errors."""
    form = "shape string, target_class string, path string, least int, most int, datatype string, allowed array<string>, class string"
    return lines.select(F.from_json(F.col(column), form, {"mode": "FAILFAST"}).alias("s")).select("s.*")


def shape_report(facts: DataFrame, shapes: DataFrame, type_predicate: str = "type") -> DataFrame:
    """(shape, id, path, rule, n): what of the shapes does not hold in live facts; n: how many values do not, or how many there are.

    A shape is for the subjects that are of its target class by a `type` fact. Rules: `least`,
    `most` (numbers of values), `datatype`, `in` (allowed values), `class` (values are nodes of
    that class).
    """
    live = facts.where("invalidated_at is null")
    types = live.where((F.col("predicate") == type_predicate) & F.col("datatype").isNull()).select(F.col("subject_id").alias("id"), F.col("object").alias("type")).distinct()
    rules = shapes.select("shape", F.col("target_class").alias("type"), F.col("path").alias("predicate"), "least", "most", F.col("datatype").alias("want"), "allowed", F.col("class").alias("kind"))
    focus = types.join(rules, "type")
    values = live.select(F.col("subject_id").alias("id"), "predicate", "object", F.col("datatype").alias("given"))
    known = types.select(F.col("id").cast("string").alias("object"), F.col("type").alias("kind"), F.lit(True).alias("of_kind"))
    both = focus.join(values, ["id", "predicate"], "left").join(known, ["object", "kind"], "left")
    held = F.col("object").isNotNull()
    wrong = F.col("want").isNotNull() & held & (~F.col("given").eqNullSafe(F.col("want")) | ~valid_literal(F.col("object"), F.col("want")))
    outside = F.col("allowed").isNotNull() & held & ~F.coalesce(F.array_contains("allowed", F.col("object")), F.lit(False))
    other = F.col("kind").isNotNull() & held & (F.col("given").isNotNull() | F.col("of_kind").isNull())
    per = both.groupBy("shape", "id", F.col("predicate").alias("path"), "least", "most").agg(F.count("object").alias("n"), F.count_if(wrong).alias("bad_type"), F.count_if(outside).alias("bad_in"), F.count_if(other).alias("bad_class"))
    rule = lambda name, ok, n: F.when(ok, F.struct(F.lit(name).alias("rule"), F.col(n).alias("n")))
    found = F.array(rule("least", F.col("n") < F.col("least"), "n"), rule("most", F.col("n") > F.col("most"), "n"), rule("datatype", F.col("bad_type") > 0, "bad_type"), rule("in", F.col("bad_in") > 0, "bad_in"), rule("class", F.col("bad_class") > 0, "bad_class"))
    return per.select("shape", "id", "path", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select("shape", "id", "path", "x.rule", "x.n")


def scoped_graph(facts: DataFrame, scope: DataFrame, readable: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Live facts of a scope (id), and those that its boundary cuts.

    Literals of the scope's nodes and facts between two of them are the scope's; where exactly
    one end is in the scope and the other may be read (id), the fact is cut: (id, inside, outside).
    """
    live = facts.where("invalidated_at is null").withColumn("_o", F.when(F.col("datatype").isNull(), F.col("object").try_cast("long")))
    ids = scope.select("id").distinct()
    rows = live.join(ids.select(F.col("id").alias("subject_id"), F.lit(True).alias("_s")), "subject_id", "left").join(ids.select(F.col("id").alias("_o"), F.lit(True).alias("_t")), "_o", "left")
    inner = rows.where(F.col("_s") & (F.col("datatype").isNotNull() | F.col("_t"))).drop("_o", "_s", "_t")
    across = rows.where("datatype is null and (_s is null) <> (_t is null)").select("id", F.when(F.col("_s"), F.col("subject_id")).otherwise(F.col("_o")).alias("inside"), F.when(F.col("_s"), F.col("_o")).otherwise(F.col("subject_id")).alias("outside"))
    return inner, across.join(readable.select(F.col("id").alias("outside")).distinct(), "outside", "left_semi").select("id", "inside", "outside")


def valid_at(facts: DataFrame, moment) -> DataFrame:
    """Live facts whose validity holds at the moment, ends included, null ends open."""
    m = F.lit(moment)
    return facts.where(F.col("invalidated_at").isNull() & (F.col("valid_from").isNull() | (F.col("valid_from") <= m)) & (F.col("valid_until").isNull() | (F.col("valid_until") >= m)))


def literal_errors(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("datatype").isNotNull() & ~valid_literal(F.col("object"), F.col("datatype")))


def ntriples(facts: DataFrame, base: str) -> DataFrame:
    """(line): live facts as N-Triples; literals escaped, objects without datatype are nodes."""
    esc = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col("object"), r"\\", r"\\\\"), '"', r'\\"'), "\n", r"\\n")
    node = lambda c: F.concat(F.lit(f"<{base}"), c.cast("string"), F.lit(">"))
    obj = F.when(F.col("datatype").isNull(), node(F.col("object"))).otherwise(F.concat(F.lit('"'), esc, F.lit('"^^<http://www.w3.org/2001/XMLSchema#'), F.col("datatype"), F.lit(">")))
    return facts.where("invalidated_at is null").select(F.concat_ws(" ", node(F.col("subject_id")), node(F.col("predicate")), obj, F.lit(".")).alias("line"))


def cardinality_report(facts: DataFrame, subjects: DataFrame, predicate: str, least: int, most: int | None = None, datatype: str | None = None) -> DataFrame:
    """(id, n, bad): subjects (id) with too few or too many live values of a predicate, or values of another datatype."""
    live = facts.where((F.col("predicate") == predicate) & F.col("invalidated_at").isNull())
    wrong = F.lit(False) if datatype is None else ~valid_literal(F.col("object"), F.lit(datatype))
    n = live.groupBy(F.col("subject_id").alias("id")).agg(F.count("*").alias("n"), F.count_if(wrong).alias("bad"))
    out = subjects.select("id").distinct().join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bad", F.lit(0)).alias("bad"))
    over = F.col("n") > most if most is not None else F.lit(False)
    return out.where((F.col("n") < least) | over | (F.col("bad") > 0))
