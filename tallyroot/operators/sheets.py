"""Measurements of table columns and containment between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyroot.functions.text import canonical_cell, canonical_kind, cell_kind
from tallyroot.work import Workspace

#: Distinct values up to which a column's values are listed, and up to which they are counted exactly in a report.
VALUES_CAP, DISTINCT_CAP = 1000, 50_000
BUCKETS = 64


def cells(table: DataFrame, name: str) -> DataFrame:
    """(sheet, col, value): one row per cell, by one pass over the table."""
    pairs = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value")) for c in table.columns])
    return table.select(F.lit(name).alias("sheet"), F.explode(pairs).alias("x")).select("sheet", "x.col", "x.value")


def measure_columns(cell_rows: DataFrame) -> DataFrame:
    """(sheet, col, n_rows, n_filled, n_distinct, is_unique, kind): kind is the commonest one, ties by name.

    Values are counted once per distinct value first, so a frequent value is one row after the first aggregation.
    """
    v = cell_rows.select("sheet", "col", canonical_cell(F.col("value")).alias("v"))
    # The kind is told from distinct values only.
    per = v.groupBy("sheet", "col", "v").agg(F.count("*").alias("n")).withColumn("k", canonical_kind(F.col("v")))
    kinds = per.groupBy("sheet", "col", "k").agg(F.sum("n").alias("n"), F.count("v").alias("d"))
    filled = F.col("k") != "empty"
    out = kinds.groupBy("sheet", "col").agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(filled, F.col("n")).otherwise(0)).alias("n_filled"),
        F.sum("d").alias("n_distinct"),
        F.min(F.when(filled, F.struct(-F.col("n"), "k"))).alias("best"),
    )
    return out.select("sheet", "col", "n_rows", "n_filled", "n_distinct", ((F.col("n_filled") == F.col("n_distinct")) & (F.col("n_filled") > 0)).alias("is_unique"), F.coalesce("best.k", F.lit("empty")).alias("kind"))


def containment(cell_rows: DataFrame, threshold: float = 0.9, least: int = 2, most_pairs: int | None = None) -> DataFrame:
    """(a, b, shared, containment): columns a whose distinct values stand in column b to the threshold or more. Exact.

    A column that holds the share t of a's n values holds at least one of any (1 - t) * n + 1 of
    them, so b is looked for among the columns with one of a's rarest values only; values that
    very many columns hold lead to no pairs unless a has little else. The rarest are picked in
    buckets of a column's values, each of which gives its own share, so a large column is not one
    task's work. Pairs that are found are counted over all values. More than `most_pairs` of them are refused.
    """
    work = Workspace(cell_rows.sparkSession, "containment")
    v = cell_rows.select(F.concat_ws(".", "sheet", "col").alias("c"), canonical_cell(F.col("value")).alias("t")).where("t is not null")
    v = work.keep(v.select("c", F.xxhash64("t").alias("v"), F.xxhash64("t", F.lit(1)).alias("w")).distinct())
    sizes = work.keep(v.groupBy("c").agg(F.count("*").alias("n")).where(F.col("n") >= least))
    v = v.join(sizes, "c")
    rare = v.join(v.groupBy("v", "w").agg(F.count("*").alias("df")), ["v", "w"]).withColumn("b", F.pmod("v", F.lit(BUCKETS)))
    bucket = Window.partitionBy("c", "b")
    ranked = rare.withColumn("r", F.row_number().over(bucket.orderBy("df", "v", "w"))).withColumn("m", F.count("*").over(bucket))
    probes = ranked.where((F.col("r") <= F.floor((1 - threshold) * F.col("m") + 1e-9) + 1) & (F.col("df") > 1)).select("v", "w", F.col("c").alias("a"), F.col("n").alias("na"))
    holders = v.select("v", "w", F.col("c").alias("b"), F.col("n").alias("nb"))
    pairs = work.keep(probes.join(holders, ["v", "w"]).where((F.col("a") != F.col("b")) & (F.col("nb") >= threshold * F.col("na"))).select("a", "b", "na").distinct())
    if most_pairs is not None and pairs.count() > most_pairs:
        raise ValueError(f"more than {most_pairs} pairs of columns to count")
    own = v.select(F.col("c").alias("a"), "v", "w")
    shared = pairs.join(own, "a").join(v.select(F.col("c").alias("b"), "v", "w"), ["b", "v", "w"]).groupBy("a", "b", "na").agg(F.count("*").alias("shared"))
    return shared.withColumn("containment", F.col("shared") / F.col("na")).where(F.col("containment") >= threshold).select("a", "b", "shared", "containment")


def collapsed(found: DataFrame, unique: DataFrame) -> DataFrame:
    """(a, b, mutual, reading): containments (a, b) with both directions of a pair as one, and what each may mean.

    Of a pair that holds both ways the unique column is the container b; if both or neither are
    unique, the smaller name. unique: (c, is_unique). A pair whose container is unique reads as
    `key`: a may refer to the rows that b names; others are a shared set of values, `shared`;
    `unknown` if it is not known whether the container is unique.
    """
    back = found.select(F.col("a").alias("b"), F.col("b").alias("a"), F.lit(True).alias("mutual"))
    both = found.select("a", "b").join(back, ["a", "b"], "left")
    u = unique.select("c", F.col("is_unique").alias("u"))
    both = both.join(u.select(F.col("c").alias("a"), F.col("u").alias("ua")), "a", "left").join(u.select(F.col("c").alias("b"), F.col("u").alias("ub")), "b", "left")
    one = lambda c: F.coalesce(F.col(c), F.lit(False))
    stays = F.when(one("ua") != one("ub"), one("ub")).otherwise(F.col("b") < F.col("a"))
    reading = F.when(F.col("ub").isNull(), "unknown").when(F.col("ub"), "key").otherwise("shared")
    return both.where(F.col("mutual").isNull() | stays).select("a", "b", F.coalesce("mutual", F.lit(False)).alias("mutual"), reading.alias("reading"))


def sketches(sets: DataFrame, key: str, values: str, permutations: int = 128, seed: int = 1) -> DataFrame:
    """(key, sketch, n): MinHash sketches: at each place the least of one hash function over the set's values, and the number of these."""
    v = F.array_distinct(F.filter(values, lambda x: x.isNotNull()))
    one = lambda i: F.array_min(F.transform(v, lambda x: F.xxhash64(x, F.lit(seed), i)))
    return sets.select(key, F.when(F.size(v) > 0, F.transform(F.sequence(F.lit(1), F.lit(permutations)), one)).alias("sketch"), F.size(v).alias("n"))


def jaccard_estimate(a: Column, b: Column) -> Column:
    """The share of places at which two sketches of one recipe are equal."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.size(a)


def containment_estimate(jaccard: Column, n_a: Column, n_b: Column) -> Column:
    """The share of a's values that stand in b, from the similarity of the sets and their sizes; at most 1, 0 for an empty set."""
    shared = jaccard * (n_a + n_b) / (1 + jaccard)
    return F.when((n_a > 0) & (jaccard > 0), F.least(shared / n_a, F.lit(1.0))).otherwise(0.0)


def sketched_containment(columns: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(a, b, estimate): pairs of sketched columns (c, sketch, n, recipe) whose estimated containment reaches the threshold.

    Columns of one recipe meet at places where their sketches are equal; a's least values of b
    that is much larger differ mostly, so the fewest places that can reach the threshold follow
    from the sizes, and pairs are formed by places, counted, and judged.
    """
    places = columns.select("c", "n", "recipe", F.size("sketch").alias("k"), F.posexplode("sketch").alias("i", "x"))
    a, b = [places.select(F.col("c").alias(s), F.col("n").alias(f"n{s}"), "recipe", "k", "i", "x") for s in "ab"]
    equal = a.join(b, ["recipe", "k", "i", "x"]).where("a <> b").groupBy("a", "b", "na", "nb", "k").agg(F.count("*").alias("e"))
    return equal.select("a", "b", containment_estimate(F.col("e") / F.col("k"), F.col("na"), F.col("nb")).alias("estimate")).where(F.col("estimate") >= threshold)


def capped_distinct(cell_rows: DataFrame, cap: int = DISTINCT_CAP) -> DataFrame:
    """(sheet, col, n_distinct, at_least): distinct values of each column; above the cap the cap, marked as `at_least`."""
    n = cell_rows.select("sheet", "col", canonical_cell(F.col("value")).alias("v")).groupBy("sheet", "col").agg(F.count_distinct("v").alias("n"))
    return n.select("sheet", "col", F.least("n", F.lit(cap)).alias("n_distinct"), (F.col("n") > cap).alias("at_least"))


def value_lists(cell_rows: DataFrame, cap: int = VALUES_CAP) -> DataFrame:
    """(sheet, col, has_values, values): the sorted distinct values of columns that have no more than `cap`; null for others."""
    v = cell_rows.select("sheet", "col", canonical_cell(F.col("value")).alias("v")).where("v is not null").distinct()
    sizes = v.groupBy("sheet", "col").agg(F.count("*").alias("n"))
    small = v.join(sizes.where(F.col("n") <= cap), ["sheet", "col"]).groupBy("sheet", "col").agg(F.sort_array(F.collect_list("v")).alias("values"))
    return sizes.join(small, ["sheet", "col"], "left").select("sheet", "col", F.col("values").isNotNull().alias("has_values"), "values")


def profile_text(measured: DataFrame, lists: DataFrame, budget: int = 4000, examples: int = 8) -> DataFrame:
    """(sheet, text, shown): a sheet in words, a line for each column, with as many example values as the budget of characters allows.

    measured: as measure_columns gives it; lists: as value_lists gives it. All columns are shown
    with the same greatest number of examples whose text fits; without examples if none does.
    """
    rows = measured.join(lists.select("sheet", "col", "values"), ["sheet", "col"], "left")
    share = F.round(100.0 * F.col("n_filled") / F.col("n_rows"), 0).cast("int").cast("string")
    head = F.concat("col", F.lit(": "), "kind", F.lit(", "), share, F.lit("% filled, "), F.col("n_distinct").cast("string"), F.lit(" distinct"), F.when(F.col("is_unique"), F.lit(", unique")).otherwise(F.lit("")))
    shown = lambda k: F.when((k > 0) & (F.size("values") > 0), F.concat(F.lit(", e.g. "), F.array_join(F.slice("values", 1, k), "; "))).otherwise(F.lit(""))
    lines = rows.select("sheet", "col", F.explode(F.sequence(F.lit(0), F.lit(examples))).alias("k"), "values", head.alias("head"))
    lines = lines.withColumn("line", F.concat("head", shown(F.col("k"))))
    text = lines.groupBy("sheet", "k").agg(F.array_join(F.sort_array(F.collect_list(F.struct("col", "line")))["line"], "\n").alias("text"))
    fits = text.where((F.char_length("text") <= budget) | (F.col("k") == 0))
    return fits.groupBy("sheet").agg(F.max(F.struct("k", "text")).alias("b")).select("sheet", F.col("b.text").alias("text"), F.col("b.k").alias("shown"))


def split_rows(table: DataFrame, key: str, columns: list[str], most: int) -> DataFrame:
    """(key, col, piece, text): rows as prose; one above `most` characters cell by cell, and a cell above it in pieces.

    A row that fits has a null col; a cell that fits is one piece. A key stands for one row.
    """
    whole = prose(table, columns).select(key, "text").where("text <> ''")
    out = whole.where(F.char_length("text") <= most).select(key, F.lit(None).cast("string").alias("col"), F.lit(0).alias("piece"), "text")
    over = table.join(whole.where(F.char_length("text") > most).select(key), key, "left_semi")
    pairs = F.array(*[F.struct(F.lit(c).alias("col"), canonical_cell(F.col(c).cast("string")).alias("value")) for c in columns])
    cells_ = over.select(key, F.explode(pairs).alias("x")).where("x.value is not null").select(key, "x.col", F.concat("x.col", F.lit(": "), "x.value", F.lit(".")).alias("text"))
    from tallyroot.operators.chunking import chunk_texts

    small = cells_.where(F.char_length("text") <= most).select(key, "col", F.lit(0).alias("piece"), "text")
    long = cells_.where(F.char_length("text") > most).select(F.to_json(F.struct(key, "col")).alias("k"), "text")
    kind = dict(table.dtypes)[key]
    cut = chunk_texts(long, "k", "text", strategy="sentence_packed", most=most).select(F.from_json("k", f"{key} {kind}, col string").alias("x"), "piece", "text")
    return out.unionByName(small).unionByName(cut.select(f"x.{key}", "x.col", "piece", "text"))


def column_number(letters: Column) -> Column:
    """The number of a column's letters: A is 1, Z 26, AA 27; null for anything else."""
    ok = letters.rlike("^[A-Za-z]{1,3}$")
    value = F.aggregate(F.split(F.upper(letters), ""), F.lit(0), lambda s, c: s * 26 + F.ascii(c) - 64)
    return F.when(ok, value)


def cell_range(ref: Column) -> Column:
    """(top, left, bottom, right) of a reference such as `B2`, `$B$2:D10` or `Sheet!A1:C3`, corners in any order; null if it is none."""
    part = lambda i: F.regexp_extract(ref, r"^(?:[^!]*!)?\$?([A-Za-z]{1,3})\$?([1-9][0-9]{0,6})(?::\$?([A-Za-z]{1,3})\$?([1-9][0-9]{0,6}))?$", i)
    c1, r1 = column_number(part(1)), part(2).try_cast("int")
    c2, r2 = F.coalesce(column_number(part(3)), c1), F.coalesce(part(4).try_cast("int"), r1)
    found = F.struct(F.least(r1, r2).alias("top"), F.least(c1, c2).alias("left"), F.greatest(r1, r2).alias("bottom"), F.greatest(c1, c2).alias("right"))
    return F.when(r1.isNotNull(), found)


def region(cells_: DataFrame, ref: str, most: int = 100_000) -> DataFrame:
    """The cells (row, column, value, ...) within a reference; one of more than `most` cells is refused."""
    box = cells_.sparkSession.range(1).select(cell_range(F.lit(ref)).alias("x")).first().x
    if box is None:
        raise ValueError(f"no such reference: {ref!r}")
    if (box.bottom - box.top + 1) * (box.right - box.left + 1) > most:
        raise ValueError(f"more than {most} cells: {ref!r}")
    return cells_.where(F.col("row").between(box.top, box.bottom) & F.col("column").between(box.left, box.right))


def banner_names(heads: DataFrame) -> DataFrame:
    """(sheet, column, name): column names under banners: heads (sheet, column, level, text), level 0 the lowest header row.

    A banner stands over its own column and those to the right up to the next text of its row, as merged cells do; a
    name is the banners above and the header, joined by ` / `, repeats left out.
    """
    levels = Window.partitionBy("sheet", "level").orderBy("column").rowsBetween(Window.unboundedPreceding, 0)
    filled = heads.withColumn("text", canonical_cell(F.col("text"))).withColumn("t", F.when(F.col("level") > 0, F.last("text", ignorenulls=True).over(levels)).otherwise(F.col("text")))
    parts = filled.where("t is not null").groupBy("sheet", "column").agg(F.array_distinct(F.reverse(F.sort_array(F.collect_list(F.struct("level", "t"))))["t"]).alias("p"))
    return parts.select("sheet", "column", F.array_join("p", " / ").alias("name"))


def prose(table: DataFrame, columns: list[str]) -> DataFrame:
    """table with `text`: each row as `Key: value.` sentences of its filled cells."""
    parts = [F.when(canonical_cell(F.col(c).cast("string")).isNotNull(), F.concat(F.lit(f"{c}: "), canonical_cell(F.col(c).cast("string")), F.lit("."))) for c in columns]
    return table.withColumn("text", F.concat_ws(" ", *parts))


def find_header(rows: DataFrame, first: int = 8) -> DataFrame:
    """(sheet, header): the first of a sheet's first rows (sheet, row, cells) whose cells are all filled, distinct and text; else of any kind."""
    near = rows.where(F.col("row") < first)
    full = (F.size("cells") > 0) & F.forall("cells", lambda c: canonical_cell(c).isNotNull()) & (F.size(F.array_distinct("cells")) == F.size("cells"))
    text = full & F.forall("cells", lambda c: cell_kind(c) == "text")
    return near.groupBy("sheet").agg(F.coalesce(F.min(F.when(text, F.col("row"))), F.min(F.when(full, F.col("row")))).alias("header"))


def markdown_rows(table: DataFrame, columns: list[str]) -> DataFrame:
    """table with `line`: each row as a line of a Markdown table; bars are escaped, line breaks become spaces."""
    cell = lambda c: F.regexp_replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), r"\s*[\r\n]+\s*", " ")
    return table.withColumn("line", F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, columns)), F.lit(" |")))


def markdown_head(columns: list[str]) -> str:
    return "| " + " | ".join(columns) + " |\n" + "|-" * len(columns) + "|"
