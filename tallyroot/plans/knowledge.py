"""Trees, access, graphs, facts, sheets, texts and streams as batch queries over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyroot.functions import text as tx
from tallyroot.functions import templates
from tallyroot.operators import chunking, derive, entities, facts, fulltext, graph, intervals, retrieval, sheets, summaries, views
from tallyroot.operators.hierarchy import ancestors
from tallyroot.plans.trees import kept_tree as tree
from tallyroot.plans.trees import sound_ancestors
from tallyroot.sources import readers
from tallyroot.sources.tables import names, table
from tallyroot.streaming import incremental
from tallyroot.work import Workspace

NOW = "2025-06-01 00:00:00"


def _nodes(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The rows in force, with these columns only: others, texts above all, are not read."""
    return views.current_nodes(table(spark, folder, "nodes"), list(columns))


def _grants(spark: SparkSession, folder: str) -> DataFrame:
    """Grants at every folder: principals p0 to p4, read or write by the id."""
    f = _nodes(spark, folder, "usetype").where("usetype = 'folder'")
    return f.select(F.col("id").alias("root"), F.concat(F.lit("p"), (F.col("id") % 5).cast("string")).alias("principal"), F.when(F.col("id") % 2 == 0, "write").otherwise("read").alias("level"))


def t_children(spark: SparkSession, folder: str) -> DataFrame:
    return views.children_counts(_nodes(spark, folder, "parent_id"))


def t_places(spark: SparkSession, folder: str) -> DataFrame:
    return views.sibling_places(_nodes(spark, folder, "parent_id", "position", "created_at"))


def t_states(spark: SparkSession, folder: str) -> DataFrame:
    # Of a text only whether there is one goes through the shuffle.
    slim = table(spark, folder, "nodes").withColumn("content", F.when(F.col("content").isNotNull(), F.lit("")))
    n = views.current_nodes(slim, ["usetype", "settled", "content"])
    return n.groupBy("usetype").agg(F.count("*").alias("n"), F.count_if(F.col("settled") == "settled").alias("settled"), F.count_if(F.col("settled") == "failed").alias("failed"), F.count_if(F.col("content").isNotNull()).alias("with_content"))


def t_growth(spark: SparkSession, folder: str) -> DataFrame:
    n = _nodes(spark, folder, "created_at", "event_time")
    return n.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("event_time").isNotNull()).alias("dated"))


def t_as_of(spark: SparkSession, folder: str) -> DataFrame:
    n = views.settled(_nodes(spark, folder, "usetype", "settled", "created_at", "event_time")).where(tx.usetype_gate(F.col("usetype"), excluded=["sc*", "sheet"]))
    return views.as_of(n, "2025-01-03 00:00:00").select("id", "usetype")


def t_globs(spark: SparkSession, folder: str) -> DataFrame:
    return _nodes(spark, folder, "usetype").where(tx.usetype_gate(F.col("usetype"), "scan:*, c?unk")).select("id", "usetype")


def t_snippets(spark: SparkSession, folder: str) -> DataFrame:
    return _nodes(spark, folder, "content").where("content is not null").select("id", tx.content_hash(F.col("content")).alias("hash"), tx.snippet(F.col("content")).alias("snippet"))


def t_effective(spark: SparkSession, folder: str) -> DataFrame:
    nodes = Workspace(spark, "texts").keep(_nodes(spark, folder, "parent_id", "position", "created_at", "content"))
    out = views.effective_content(nodes, tree(spark, folder))
    return out.select("id", tx.content_hash(F.col("text")).alias("hash"), F.col("size").cast("int").alias("size"))


def t_access(spark: SparkSession, folder: str) -> DataFrame:
    return views.access_keys(_nodes(spark, folder, "usetype"), tree(spark, folder), _grants(spark, folder))


def t_readable(spark: SparkSession, folder: str) -> DataFrame:
    return views.readable(_nodes(spark, folder, "usetype"), tree(spark, folder), _grants(spark, folder), "p1").select("id")


def t_find(spark: SparkSession, folder: str) -> DataFrame:
    return views.find(_nodes(spark, folder, "title", "usetype", "created_at"), usetype="section", title="the ", limit=20, offset=5).select("id", "title")


def t_audit(spark: SparkSession, folder: str) -> DataFrame:
    return views.access_audit(_nodes(spark, folder, "usetype"), tree(spark, folder), _grants(spark, folder))


def t_copies(spark: SparkSession, folder: str) -> DataFrame:
    return views.newest_by_content(_nodes(spark, folder, "parent_id", "usetype", "content", "created_at"))


def t_next(spark: SparkSession, folder: str) -> DataFrame:
    return views.next_positions(_nodes(spark, folder, "parent_id", "position"))


def t_bundle(spark: SparkSession, folder: str) -> DataFrame:
    return views.bundle(_nodes(spark, folder, "parent_id", "title", "usetype"), tree(spark, folder))


def t_uncovered(spark: SparkSession, folder: str) -> DataFrame:
    """Of the 25 nodes that rank highest by the links from children to parents those without a summary below them."""
    n = Workspace(spark, "uncovered").keep(_nodes(spark, folder, "parent_id", "usetype"))
    edges = n.where("parent_id is not null and usetype is not null").select(F.col("id").alias("src"), F.col("parent_id").alias("dst"), F.lit(1.0).alias("weight"))
    ranks = graph.pagerank(n, edges).select("id", F.round("score", 9).alias("score"))
    return views.without_summary(n, ranks, 25)


def c_markdown(spark: SparkSession, folder: str) -> DataFrame:
    return sheets.markdown_rows(table(spark, folder, "nation"), ["n_nationkey", "n_name"]).select("n_nationkey", "line")


def t_summarised(spark: SparkSession, folder: str) -> DataFrame:
    up = sound_ancestors(spark, folder)
    slim = table(spark, folder, "nodes").withColumn("content", F.char_length("content").cast("long"))
    n = views.current_nodes(slim, ["content"]).select("id", F.col("content").alias("c"))
    return up.join(n, "id").groupBy(F.col("ancestor").alias("id")).agg(F.count("*").alias("below"), F.sum("c").alias("chars"), F.max("distance").alias("height"))


def _links(spark: SparkSession, folder: str) -> DataFrame:
    line = table(spark, folder, "lineitem")
    return line.select((F.col("l_suppkey") * 2).alias("source_id"), (F.col("l_partkey") * 2 + 1).alias("target_id"), F.col("l_returnflag").alias("link_type"), F.col("l_discount").alias("score"))


def _vertices(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "supplier").select((F.col("s_suppkey") * 2).alias("id")).unionByName(table(spark, folder, "part").select((F.col("p_partkey") * 2 + 1).alias("id")))


def g_degrees(spark: SparkSession, folder: str) -> DataFrame:
    return graph.degrees(_vertices(spark, folder), graph.link_graph(_links(spark, folder)))


def g_combined(spark: SparkSession, folder: str) -> DataFrame:
    e = graph.combined(graph.link_graph(_links(spark, folder)), graph.link_graph(_links(spark, folder), ["R"]))
    return e.select("src", "dst", F.round("weight", 6).alias("weight"))


def g_pagerank(spark: SparkSession, folder: str) -> DataFrame:
    return graph.pagerank(_vertices(spark, folder), graph.combined(graph.link_graph(_links(spark, folder)))).select("id", F.round("score", 9).alias("score"))


def g_seeded(spark: SparkSession, folder: str) -> DataFrame:
    seeds = table(spark, folder, "supplier").where("s_acctbal > 0").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(5).select((F.col("s_suppkey") * 2).alias("id"), F.col("s_acctbal").cast("double").alias("weight"))
    return graph.seeded_rank(_vertices(spark, folder), graph.link_graph(_links(spark, folder)), seeds)


def g_betweenness(spark: SparkSession, folder: str) -> DataFrame:
    """Shortest paths between customers, nations and regions, from every customer whose id is divisible by 100."""
    edges = _placed(spark, folder).select(F.col("subject_id").alias("src"), F.col("object").cast("long").alias("dst"), F.lit(1.0).alias("weight"))
    v = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    return graph.betweenness(v, edges, v.where("id < 1000000000 and id % 100 = 0")).select("id", F.round("score", 6).alias("score"))


def t_rollup(spark: SparkSession, folder: str) -> DataFrame:
    nodes = Workspace(spark, "rollup").keep(_nodes(spark, folder, "parent_id", "position", "created_at", "content"))
    out = summaries.rollup(nodes, tree(spark, folder), 4000)
    return out.select("id", tx.content_hash(F.col("text")).alias("hash"), "how", "size")


def c_sheets(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each sheet: its name and its columns in order, by the last profile of each column."""
    c = table(spark, folder, "sheet_columns").where("column_id is not null").groupBy("column_id").agg(F.max_by(F.struct("sheet_id", "sheet_name", "position", "letter", "column_name", "is_unique"), "profiled_at").alias("x")).select("x.*")
    cols = F.sort_array(F.collect_list(F.struct("position", F.coalesce("column_name", "letter").alias("name"))))
    return c.groupBy("sheet_id").agg(F.max("sheet_name").alias("name"), F.count("*").alias("columns"), F.count_if("is_unique").alias("n_unique"), F.array_join(cols["name"], ", ").alias("names"))


def g_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    best = table(spark, folder, "supplier").agg(F.min("s_suppkey").alias("s")).select((F.col("s") * 2).alias("id"))
    return graph.neighbours(graph.link_graph(_links(spark, folder), ["R"]), best, 2)


def g_components(spark: SparkSession, folder: str) -> DataFrame:
    n = _nodes(spark, folder, "parent_id")
    return graph.components(n.where("parent_id is not null").select(F.col("id").alias("src"), F.col("parent_id").alias("dst")), n)


def g_communities(spark: SparkSession, folder: str) -> DataFrame:
    e = graph.link_graph(_links(spark, folder))
    return graph.cohesion(graph.label_communities(_vertices(spark, folder), e), e)


def g_authority(spark: SparkSession, folder: str) -> DataFrame:
    scores = views.children_counts(_nodes(spark, folder, "parent_id")).select("id", F.col("n_children").cast("double").alias("score"))
    out = graph.subtree_authority(scores, tree(spark, folder))
    return out.select("id", "own", F.round("below", 6).alias("below"), "spread", "size", F.round("authority", 5).alias("authority"))


def g_orphans(spark: SparkSession, folder: str) -> DataFrame:
    return graph.lint_orphans(_vertices(spark, folder), graph.link_graph(_links(spark, folder), ["R"]), 12)


def g_spines(spark: SparkSession, folder: str) -> DataFrame:
    scores = views.children_counts(_nodes(spark, folder, "parent_id")).select("id", F.col("n_children").cast("double").alias("score"))
    return graph.spines(scores, sound_ancestors(spark, folder))


def g_lint(spark: SparkSession, folder: str) -> DataFrame:
    stale = k_stale(spark, folder).select("id", F.lit("info").alias("severity"))
    clash = k_contradictions(spark, folder).select(F.col("a").alias("id"), F.lit("error").alias("severity"))
    return graph.lint_all(("orphan", g_orphans(spark, folder)), ("stale", stale), ("contradiction", clash)).groupBy("rule", "severity", "rank").agg(F.count("*").alias("n"))


def g_layers(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings")
    return summaries.layers(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")))


def _placed(spark: SparkSession, folder: str) -> DataFrame:
    """Facts: customers lie in nations, nations in regions."""
    far = 1_000_000_000
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("subject_id"), (F.col("c_nationkey") + far).cast("string").alias("object"))
    n = table(spark, folder, "nation").select((F.col("n_nationkey") + far).cast("long").alias("subject_id"), (F.col("n_regionkey") + 2 * far).cast("string").alias("object"))
    none = F.lit(None).cast("string")
    return c.unionByName(n).withColumns({"predicate": F.lit("in"), "datatype": none, "derived_by": none, "invalidated_at": F.lit(None).cast("timestamp"), "recorded_at": F.to_timestamp(F.lit(NOW))})


def k_derived(spark: SparkSession, folder: str) -> DataFrame:
    """A rule places customers within regions."""
    held = _placed(spark, folder)
    out = derive.apply_rule(held, "places", "in", "in", "within", NOW)
    return out.where("derived_by = 'places'").select("subject_id", "predicate", "object")


def k_backrefs(spark: SparkSession, folder: str) -> DataFrame:
    # Facts with literals point at nothing; those that place customers and nations do.
    facts_ = _facts(spark, folder).select("subject_id", "predicate", "object", "datatype", "invalidated_at").unionByName(_placed(spark, folder).select("subject_id", "predicate", "object", "datatype", "invalidated_at"))
    refs = derive.back_references(_links(spark, folder), facts_)
    return refs.groupBy("id", "kind", "name").agg(F.count("*").alias("n"), F.min("source").alias("first"))


def x_named(spark: SparkSession, folder: str) -> DataFrame:
    slim = table(spark, folder, "nodes").withColumn("content", F.when(F.col("content").isNotNull(), F.lit("")))
    n = views.current_nodes(slim, ["content", "title"]).where("content is null and title is not null")
    done = _nodes(spark, folder, "settled").where("settled = 'settled'")
    return derive.outstanding(n, done, "id").select("id", tx.predicate_name(F.col("title")).alias("name"), tx.local_name(F.concat(F.lit("urn:x#"), F.col("title"))).alias("local"))


def k_found(spark: SparkSession, folder: str) -> DataFrame:
    f = summaries.find_facts(facts.supersede(_facts(spark, folder)), predicate="click", moment="2024-01-15 00:00:00", live=False, kind="dynamic")
    return f.select("id", "subject_id", "object")


def k_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select(F.col("event_id").alias("id"), "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("start"))
    hours = 3_600_000_000
    e = e.withColumn("stop", F.col("start") + 6 * hours)
    return intervals.overlaps(e.where("event_type = 'purchase'"), e.where("event_type <> 'purchase'"), "user_id", 6 * hours)


def x_fulltext(spark: SparkSession, folder: str) -> DataFrame:
    return fulltext.fulltext(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_queries"), "query_id", "query_text")


def c_rendered(spark: SparkSession, folder: str) -> DataFrame:
    values = F.create_map(F.lit("name"), F.col("s_name"), F.lit("nation"), F.col("s_nationkey").cast("string"))
    t = F.lit("{{ name }} of {{nation}}: {{other}}")
    return table(spark, folder, "supplier").select("s_suppkey", templates.render(t, values).alias("text"), F.array_join(templates.missing(t, values), ",").alias("missing"))


def _facts(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    ts = F.col("ts").cast("timestamp")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("subject_id"), F.col("event_type").alias("predicate"), F.col("value").cast("decimal(18,2)").cast("string").alias("object"), F.lit("decimal").alias("datatype"), ts.alias("valid_from"), (ts + F.expr("interval 2 hours")).alias("valid_until"), ts.alias("recorded_at"), F.lit(None).cast("timestamp").alias("invalidated_at"), F.lit("dynamic").alias("fact_type"))


def k_contradictions(spark: SparkSession, folder: str) -> DataFrame:
    return graph.lint_contradictions(_facts(spark, folder))


def _typed(spark: SparkSession, folder: str) -> DataFrame:
    """Customers and nations as facts: their classes, segments, balances and nations."""
    none = F.lit(None).cast("string")
    row = lambda p, o, d: F.struct(F.lit(p).alias("predicate"), o.cast("string").alias("object"), d.alias("datatype"))
    c = table(spark, folder, "customer")
    far = 1_000_000_000
    facts_ = F.array(row("type", F.lit("Customer"), none), row("segment", F.col("c_mktsegment"), F.lit("string")), row("balance", F.col("c_acctbal").cast("decimal(18,2)"), F.when(F.col("c_custkey") % 10 == 0, "integer").otherwise("decimal")), row("nation", F.col("c_nationkey") + far, F.when(F.col("c_custkey") % 7 == 0, F.lit("string"))))
    a = c.where("c_custkey % 11 <> 0").select(F.col("c_custkey").alias("subject_id"), F.explode(facts_).alias("f"))
    n = table(spark, folder, "nation").where("n_nationkey % 4 <> 0").select((F.col("n_nationkey") + far).cast("long").alias("subject_id"), row("type", F.lit("Nation"), none).alias("f"))
    return a.unionByName(n).select("subject_id", "f.*", F.lit(None).cast("timestamp").alias("invalidated_at"))


SHAPES = [
    '{"shape": "s1", "target_class": "Customer", "path": "segment", "least": 1, "most": 1, "allowed": ["BUILDING", "MACHINERY", "AUTOMOBILE"]}',
    '{"shape": "s1", "target_class": "Customer", "path": "balance", "least": 1, "datatype": "decimal"}',
    '{"shape": "s2", "target_class": "Customer", "path": "nation", "class": "Nation"}',
    '{"shape": "s3", "target_class": "Nation", "path": "name", "least": 1}',
]


def k_shapes(spark: SparkSession, folder: str) -> DataFrame:
    shapes = facts.shapes_from_json(spark.createDataFrame([(s,) for s in SHAPES], "value string"))
    return facts.shape_report(_typed(spark, folder), shapes)


def k_scope(spark: SparkSession, folder: str) -> DataFrame:
    """How much of the placed facts is in the scope of some customers and nations, and what its boundary cuts."""
    f = _placed(spark, folder).withColumn("id", F.xxhash64("subject_id", "object"))
    far = 1_000_000_000
    scope = table(spark, folder, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id")).unionByName(table(spark, folder, "nation").where("n_nationkey % 3 = 0").select((F.col("n_nationkey") + far).cast("long").alias("id")))
    readable = table(spark, folder, "nation").where("n_nationkey % 5 <> 0").select((F.col("n_nationkey") + far).cast("long").alias("id"))
    inner, cut = facts.scoped_graph(f, scope, readable)
    return inner.select(F.lit("inner").alias("part"), F.col("subject_id").alias("inside"), F.col("object").try_cast("long").alias("outside")).unionByName(cut.select(F.lit("cut").alias("part"), "inside", "outside"))


def k_resolved(spark: SparkSession, folder: str) -> DataFrame:
    """Titles of sections resolved to folders and collections."""
    n = _nodes(spark, folder, "title", "usetype", "parent_id").where("title is not null")
    known = n.where("usetype in ('folder', 'collection')").select("id", F.coalesce("parent_id", F.lit(0)).alias("root"), "title")
    return entities.resolve(n.where("usetype = 'conversation' or usetype = 'file'").select(F.col("title").alias("name")), known).select("name", "id", F.round("score", 6).alias("score"))


def t_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Corpus counts: nodes with and without text, token rows and the nodes that have any, postings, hits, facts by type and links by type."""
    slim = table(spark, folder, "nodes").withColumn("content", F.when(F.col("content").isNotNull(), F.lit("")))
    n = views.current_nodes(slim, ["content"]).agg(F.count("*").alias("nodes"), F.count("content").alias("texts"))
    t = table(spark, folder, "token_embeddings").agg(F.count("*").alias("token_rows"), F.count_distinct("document_id").alias("token_nodes"))
    kinds = _links(spark, folder).groupBy("link_type").count().agg(F.count("*").alias("link_types"), F.sum("count").alias("links"))
    dead = facts.supersede(_facts(spark, folder)).agg(F.count("*").alias("facts"), F.count("invalidated_at").alias("superseded"))
    return n.crossJoin(t).crossJoin(kinds).crossJoin(dead)  # one row each


def t_window(spark: SparkSession, folder: str) -> DataFrame:
    """What came within a window, ends included: nodes, facts, and facts that were superseded."""
    low, high = F.lit("2024-01-05 00:00:00").cast("timestamp"), F.lit("2024-01-20 00:00:00").cast("timestamp")
    made = _nodes(spark, folder, "created_at").agg(F.count_if(F.col("created_at").cast("timestamp").between(F.lit("2025-01-02 00:00:00").cast("timestamp"), F.lit("2025-01-05 00:00:00").cast("timestamp"))).alias("nodes"))
    f = facts.supersede(_facts(spark, folder)).agg(F.count_if(F.col("recorded_at").between(low, high)).alias("facts"), F.count_if(F.col("invalidated_at").between(low, high)).alias("superseded"))
    return made.crossJoin(f)  # one row each


def t_stubs(spark: SparkSession, folder: str) -> DataFrame:
    n = _nodes(spark, folder, "parent_id", "title", "usetype", "content", "position", "created_at")
    return views.child_stubs(n, n.where("usetype in ('section', 'conversation')"), 80).select("id", "child", "place", "preview", "n_children")


def t_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Below each collection, to three steps down: nodes by distance; and each folder's place among its siblings."""
    n = _nodes(spark, folder, "usetype")
    below = views.subtree_to_depth(tree(spark, folder), n.where("usetype in ('collection', 'folder')"), 3)
    return below.groupBy("id", "distance").agg(F.count("*").alias("n"))


def t_lifecycle(spark: SparkSession, folder: str) -> DataFrame:
    n = _nodes(spark, folder, "usetype", "settled")
    return views.subtree_states(n, tree(spark, folder), n.where("usetype in ('collection', 'folder')"))


def k_live(spark: SparkSession, folder: str) -> DataFrame:
    live = facts.supersede(_facts(spark, folder)).where("invalidated_at is null")
    return live.select("id", "subject_id", "predicate")


def k_stale(spark: SparkSession, folder: str) -> DataFrame:
    return graph.lint_stale(facts.supersede(_facts(spark, folder)), F.to_timestamp(F.lit(NOW)), 90)


def k_cardinality(spark: SparkSession, folder: str) -> DataFrame:
    subjects = table(spark, folder, "events").select(F.col("user_id").alias("id"))
    return facts.cardinality_report(_facts(spark, folder), subjects, "purchase", 1, 20, "decimal")


def k_lines(spark: SparkSession, folder: str) -> DataFrame:
    return facts.ntriples(_facts(spark, folder), "urn:x:")


STAR = ("customer", "supplier", "part", "nation", "region", "orders", "lineitem", "events")


def _star_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Every cell of every column of the star tables and events."""
    out = None
    for name in STAR:
        c = sheets.cells(table(spark, folder, name), name)
        out = c if out is None else out.unionByName(c)
    return out


def c_measures(spark: SparkSession, folder: str) -> DataFrame:
    return sheets.measure_columns(_star_cells(spark, folder))


def c_containment(spark: SparkSession, folder: str) -> DataFrame:
    return sheets.containment(_star_cells(spark, folder)).select("a", "b", "shared", F.round("containment", 6).alias("containment"))


def c_links(spark: SparkSession, folder: str) -> DataFrame:
    """Containments with mutual ones as one, and what each may mean."""
    cells = Workspace(spark, "links").keep(_star_cells(spark, folder))
    unique = sheets.measure_columns(cells).select(F.concat_ws(".", "sheet", "col").alias("c"), "is_unique")
    return sheets.collapsed(sheets.containment(cells), unique)


def c_distinct(spark: SparkSession, folder: str) -> DataFrame:
    return sheets.capped_distinct(_star_cells(spark, folder), 5000)


def c_values(spark: SparkSession, folder: str) -> DataFrame:
    v = sheets.value_lists(_star_cells(spark, folder), 50)
    return v.select("sheet", "col", "has_values", F.array_join("values", "|").alias("list"))


def c_profile(spark: SparkSession, folder: str) -> DataFrame:
    cells = Workspace(spark, "profile").keep(_star_cells(spark, folder))
    out = sheets.profile_text(sheets.measure_columns(cells), sheets.value_lists(cells), 700)
    return out.select("sheet", "shown", (F.char_length("text") <= 700).alias("fits"), F.size(F.split("text", "\n")).alias("columns"))


def c_split(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of nations and customers as prose of at most 60 characters, longer ones cell by cell."""
    return sheets.split_rows(table(spark, folder, "customer"), "c_custkey", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"], 60)


def c_letters(spark: SparkSession, folder: str) -> DataFrame:
    """Columns whose letters do not say their position, counted from 0, and the reference of each column's first ten cells."""
    c = table(spark, folder, "sheet_columns").select("column_id", "position", "letter").distinct()
    box = sheets.cell_range(F.concat(F.lit("Sheet1!$"), "letter", F.lit("$10:"), "letter", F.lit("1")))
    return c.select("column_id", (sheets.column_number(F.col("letter")) - 1).alias("number"), box["top"].alias("top"), box["left"].alias("left"), box["bottom"].alias("bottom"))


def c_sketched(spark: SparkSession, folder: str) -> DataFrame:
    """Estimated containments between the columns of which only sketches are kept."""
    c = table(spark, folder, "sheet_columns").where("column_id is not null").groupBy("column_id").agg(F.max_by(F.struct("sketch", "sketch_count", "sketch_num_perm", "sketch_seed", F.col("column_values").isNull().alias("bare")), "profiled_at").alias("x"))
    c = c.where("x.bare and x.sketch is not null").select(F.col("column_id").alias("c"), "x.sketch", F.col("x.sketch_count").alias("n"), F.concat_ws("/", "x.sketch_num_perm", "x.sketch_seed").alias("recipe"))
    return sheets.sketched_containment(c, 0.7).select("a", "b", F.round("estimate", 6).alias("estimate"))


def _all_cells(spark: SparkSession, folder: str) -> DataFrame:
    """The cells of every column of every table in the folder."""
    out = None
    for name in names(spark, folder):
        c = sheets.cells(table(spark, folder, name), name)
        out = c if out is None else out.unionByName(c)
    return out


def c_measures_all(spark: SparkSession, folder: str) -> DataFrame:
    return sheets.measure_columns(_all_cells(spark, folder))


def c_containment_all(spark: SparkSession, folder: str) -> DataFrame:
    return sheets.containment(_all_cells(spark, folder)).select("a", "b", "shared", F.round("containment", 6).alias("containment"))


def c_prose(spark: SparkSession, folder: str) -> DataFrame:
    return sheets.prose(table(spark, folder, "customer"), ["c_custkey", "c_name", "c_mktsegment"]).select("c_custkey", "text")


def x_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.paragraphs(table(spark, folder, "documents"), "doc_id", "text")


def x_windows(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.token_windows(table(spark, folder, "documents"), "doc_id", "text", 50, 10)


def x_headings(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.nest(chunking.headings(table(spark, folder, "documents"), "doc_id", "text"), "doc_id")


def x_sentences(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.sentences(table(spark, folder, "documents"), "doc_id", "text")


def x_packed(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.packed_sentences(table(spark, folder, "documents"), "doc_id", "text")


def x_segments(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.segment(table(spark, folder, "embeddings"), "label", "vec_id", "embedding", 1.5, 2, 2, 40)


def s_windows(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return incremental.windowed_counts(e).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def k_iris(spark: SparkSession, folder: str) -> DataFrame:
    iri = tx.minted_iri("urn:x", "part", F.col("p_name"))
    return table(spark, folder, "part").select("p_partkey", iri.alias("iri"), tx.valid_iri(iri).alias("valid"))


def k_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """Sections of texts on pages of three columns, each of one block of 500 characters."""
    docs = table(spark, folder, "documents")
    spans = chunking.section_spans(docs, "doc_id", "text").where("start < stop").select(F.concat_ws("/", "doc_id", "section").alias("id"), "doc_id", "start", "stop")
    n = docs.where("length(text) > 0").select("doc_id", F.explode(F.sequence(F.lit(0), F.floor((F.char_length("text") - 1) / 500).cast("int"))).alias("i"))
    c = (F.col("i") % 3) * 100
    blocks = n.select(F.concat_ws("/", "doc_id", "i").alias("id"), "doc_id", (F.col("i") * 500).cast("long").alias("start"), ((F.col("i") + 1) * 500).cast("long").alias("stop"), F.floor(F.col("i") / 3).alias("page"), c.alias("left"), F.lit(0).alias("top"), (c + 90).alias("right"), F.lit(700).alias("bottom"))
    return intervals.places_on_pages(spans, blocks, "doc_id", 500)


def k_upserted(spark: SparkSession, folder: str) -> DataFrame:
    """Facts after others came, half of which are held already and some of which come twice."""
    cols = ["subject_id", "predicate", "object", "datatype", "recorded_at", "invalidated_at"]
    held = _placed(spark, folder).select(*cols)
    late = F.to_timestamp(F.lit("2025-07-01 00:00:00"))
    new = held.withColumns({"predicate": F.when(F.col("subject_id") % 2 == 0, F.lit(" In ")).otherwise(F.lit("Lives In")), "recorded_at": late})
    out = facts.upsert(held, new.unionByName(new.where("subject_id % 3 = 0")))
    return out.groupBy("predicate").agg(F.count("*").alias("n"), F.count_if(F.col("recorded_at") == late).alias("late"))


def k_orphans(spark: SparkSession, folder: str) -> DataFrame:
    """Token rows of nodes that are gone, and leaves without token rows."""
    rows = table(spark, folder, "token_embeddings").where("document_id is not null").select(F.col("document_id").alias("id")).distinct()
    leaves = _nodes(spark, folder, "usetype").where("usetype = 'chunk'").select("id")
    every = _nodes(spark, folder, "usetype").select("id")
    return derive.orphans(rows, every, "id")[0].select("id", F.lit("rows").alias("kind")).unionByName(derive.orphans(rows, leaves, "id")[1].select("id", F.lit("node").alias("kind")))


def g_triples(spark: SparkSession, folder: str) -> DataFrame:
    """Degrees in the graph of the placed facts."""
    f = _placed(spark, folder).withColumn("object_id", F.when(F.col("datatype").isNull(), F.col("object").cast("long")))
    v = f.select(F.col("subject_id").alias("id")).union(f.select("object_id"))
    return graph.degrees(v, graph.triple_graph(f))


def g_branches(spark: SparkSession, folder: str) -> DataFrame:
    nodes = Workspace(spark, "branches").keep(_nodes(spark, folder, "parent_id"))
    scores = views.children_counts(nodes).select("id", F.col("n_children").cast("double").alias("score"))
    found = tree(spark, folder)
    return graph.branch_points(nodes, scores, found, graph.spines(scores, ancestors(found, sound=True)))


def g_bridges(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors near the stated ones that bear another label."""
    e = table(spark, folder, "embeddings")
    docs = e.select(F.col("vec_id").alias("doc"), F.col("embedding").alias("v"))
    near = retrieval.vector_search(docs, e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("v")), 20)
    labels = e.select(F.col("vec_id").alias("id"), F.col("label").alias("community"))
    return summaries.bridges(labels, near, 0.3).select("a", "b", F.round("score", 6).alias("score"))


def x_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as text: messages in order, by turns of user and assistant."""
    n = _nodes(spark, folder, "parent_id", "usetype", "content", "position", "created_at")
    said = n.where("usetype = 'message' and content is not null")
    turns = views.sibling_places(n).join(said.select("id", "content"), "id").select("parent_id", F.col("place").alias("turn"), F.when(F.col("place") % 2 == 0, "user").otherwise("assistant").alias("role"), F.col("content").alias("text"))
    return readers.conversation_text(turns, "parent_id").select("parent_id", tx.content_hash(F.col("text")).alias("hash"), F.char_length("text").alias("size"))


QUERIES = {name: f for name, f in globals().items() if name[:2] in ("t_", "g_", "k_", "c_", "x_", "s_") and callable(f)}

_CUR = "cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) AS rn FROM nodes WHERE id IS NOT NULL) WHERE rn = 1)"
_KIDS = "kids AS (SELECT parent_id AS id, count(*) AS n FROM cur WHERE parent_id IS NOT NULL GROUP BY 1)"
_DOWN = f"WITH RECURSIVE {_CUR}, down(id, path) AS (SELECT id, []::BIGINT[] FROM cur WHERE parent_id IS NULL UNION ALL SELECT cur.id, list_append(d.path, cur.parent_id) FROM cur JOIN down d ON cur.parent_id = d.id), up AS (SELECT id, unnest(path) AS anc, len(path) AS depth, generate_subscripts(path, 1) - 1 AS ad FROM down)"
_GRANTS = "grants AS (SELECT id AS root, 'p' || (id % 5) AS principal, CASE WHEN id % 2 = 0 THEN 'write' ELSE 'read' END AS level FROM cur WHERE usetype = 'folder')"
_CHAIN = "chain AS (SELECT id, anc FROM up UNION ALL SELECT id, id FROM cur)"
_LINKS = "links AS (SELECT l_suppkey * 2 AS src, l_partkey * 2 + 1 AS dst, l_returnflag AS t, l_discount AS w FROM lineitem), vert AS (SELECT s_suppkey * 2 AS id FROM supplier UNION ALL SELECT p_partkey * 2 + 1 FROM part)"
_DEG = "deg AS (SELECT vert.id, coalesce(sum(i), 0)::BIGINT AS n_in, coalesce(sum(o), 0)::BIGINT AS n_out FROM vert LEFT JOIN (SELECT src AS id, 0 AS i, 1 AS o FROM links{0} UNION ALL SELECT dst, 1, 0 FROM links{0}) e USING (id) GROUP BY 1)"
_FACTS = "facts AS (SELECT event_id AS id, user_id AS subject_id, event_type AS predicate, value::DECIMAL(18,2)::VARCHAR AS object, ts AS valid_from, ts + INTERVAL 2 HOUR AS valid_until FROM events)"
_PR = "".join(
    f", r{i} AS MATERIALIZED (SELECT b.id, (0.15 + 0.85 * (SELECT coalesce(sum(score), 0) FROM r{i - 1} WHERE id NOT IN (SELECT src FROM steps))) * b.r + 0.85 * coalesce(m, 0) AS score FROM base b LEFT JOIN (SELECT dst, sum(score * p) AS m FROM steps JOIN r{i - 1} ON r{i - 1}.id = steps.src GROUP BY 1) x ON x.dst = b.id)"
    for i in range(1, 13)
)
_CELLS = lambda names: " UNION ALL ".join(f"SELECT '{t}' AS sheet, '{c}' AS col, {c}::VARCHAR AS value FROM {t}" for t, cs in names.items() for c in cs)
_MEASURED = {
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment".split(), "supplier": "s_suppkey s_name s_nationkey s_acctbal".split(), "part": "p_partkey p_name p_brand p_type p_size p_retailprice".split(),
    "nation": "n_nationkey n_name n_regionkey".split(), "region": "r_regionkey r_name".split(), "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority".split(),
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split(), "events": "event_id ts user_id event_type value props".split(),
}
_CANON = r"""nullif(CASE WHEN regexp_full_match(trim(value), '[+-]?\d+\.0+') THEN regexp_replace(trim(value), '\.0+$', '') WHEN regexp_full_match(trim(value), '\d{4}-\d{2}-\d{2}[ T]00:00:00(\.0+)?') THEN substring(trim(value), 1, 10) WHEN lower(trim(value)) IN ('true', 'false') THEN upper(trim(value)) ELSE trim(value) END, '')"""
_CELL = f"cells AS ({_CELLS(_MEASURED)}), v AS (SELECT sheet, col, {_CANON} AS v FROM cells)"
_FOUND = f"{_CELL}, d AS (SELECT DISTINCT sheet || '.' || col AS c, v FROM v WHERE v IS NOT NULL), sz AS (SELECT c, count(*) AS n FROM d GROUP BY 1 HAVING count(*) >= 2), p AS (SELECT x.c AS a, y.c AS b, count(*) AS shared FROM d x JOIN d y ON x.v = y.v AND x.c <> y.c GROUP BY ALL), found AS (SELECT a, b, shared, shared / n AS containment FROM p JOIN sz ON sz.c = a WHERE b IN (SELECT c FROM sz) AND shared / n >= 0.9)"
_TYPED = """typed AS (SELECT c_custkey AS id, 'type' AS p, 'Customer' AS o, NULL AS d FROM customer WHERE c_custkey % 11 <> 0 UNION ALL SELECT c_custkey, 'segment', c_mktsegment, 'string' FROM customer WHERE c_custkey % 11 <> 0
 UNION ALL SELECT c_custkey, 'balance', c_acctbal::DECIMAL(18,2)::VARCHAR, CASE WHEN c_custkey % 10 = 0 THEN 'integer' ELSE 'decimal' END FROM customer WHERE c_custkey % 11 <> 0 UNION ALL SELECT c_custkey, 'nation', (c_nationkey + 1000000000)::VARCHAR, CASE WHEN c_custkey % 7 = 0 THEN 'string' END FROM customer WHERE c_custkey % 11 <> 0
 UNION ALL SELECT n_nationkey + 1000000000, 'type', 'Nation', NULL FROM nation WHERE n_nationkey % 4 <> 0)"""
_PLACED = "placed AS (SELECT c_custkey AS s, (c_nationkey + 1000000000)::BIGINT AS o FROM customer UNION ALL SELECT n_nationkey + 1000000000, n_regionkey + 2000000000 FROM nation)"

ORACLE = {
    "t_children": f"WITH {_CUR}, {_KIDS} SELECT cur.id, coalesce(n, 0) AS n_children FROM cur LEFT JOIN kids USING (id)",
    "t_places": f"WITH {_CUR} SELECT id, parent_id, row_number() OVER (PARTITION BY parent_id ORDER BY position ASC NULLS LAST, created_at, id) - 1 AS place FROM cur WHERE parent_id IS NOT NULL",
    "t_states": f"WITH {_CUR} SELECT usetype, count(*) AS n, count(*) FILTER (settled = 'settled') AS settled, count(*) FILTER (settled = 'failed') AS failed, count(content) AS with_content FROM cur GROUP BY 1",
    "t_growth": f"WITH {_CUR} SELECT created_at::DATE AS day, count(*) AS n, count(event_time) AS dated FROM cur GROUP BY 1",
    "t_as_of": f"WITH {_CUR} SELECT id, usetype FROM cur WHERE settled = 'settled' AND coalesce(event_time, created_at) <= TIMESTAMP '2025-01-03' AND (usetype IS NULL OR NOT (usetype = 'sheet' OR usetype LIKE 'sc%'))",
    "t_globs": f"WITH {_CUR} SELECT id, usetype FROM cur WHERE usetype LIKE 'scan:%' OR usetype LIKE 'c_unk'",
    "t_snippets": rf"WITH {_CUR}, f AS (SELECT id, content, trim(regexp_replace(content, '\s+', ' ', 'g')) AS t FROM cur WHERE content IS NOT NULL) SELECT id, CASE WHEN content <> '' THEN sha256(content) END AS hash, CASE WHEN length(t) <= 160 THEN t ELSE rtrim(substring(t, 1, 160)) || '…' END AS snippet FROM f",
    "t_effective": f"""{_DOWN}, full_ AS (SELECT id FROM cur WHERE content IS NOT NULL AND trim(content) <> ''),
hid AS (SELECT up.id, max(ad) AS hid FROM up JOIN full_ ON full_.id = anc GROUP BY 1),
front AS (SELECT anc AS id, up.id AS member FROM up JOIN full_ ON full_.id = up.id LEFT JOIN hid ON hid.id = up.id JOIN cur c ON c.id = anc WHERE c.content IS NULL AND (hid IS NULL OR ad > hid)),
okey AS (SELECT id, {{'a': position IS NULL, 'b': coalesce(position, 0), 'c': created_at, 'd': id}} AS o FROM cur),
keys AS (SELECT x.id AS member, list_append(list(k.o ORDER BY ad), (SELECT o FROM okey WHERE okey.id = x.id)) AS key FROM up x JOIN okey k ON k.id = x.anc GROUP BY x.id),
txt AS (SELECT f.id, string_agg(c.content, chr(10) || chr(10) ORDER BY key) AS text FROM front f JOIN keys USING (member) JOIN cur c ON c.id = f.member GROUP BY 1)
SELECT id, sha256(text) AS hash, length(text)::INT AS size FROM txt""",
    "t_access": f"{_DOWN}, {_GRANTS}, {_CHAIN}, best AS (SELECT id, principal, max(CASE level WHEN 'write' THEN 2 ELSE 1 END) AS l FROM chain JOIN grants ON root = anc GROUP BY ALL), a AS (SELECT id, string_agg(principal || ':' || CASE l WHEN 2 THEN 'write' ELSE 'read' END, ',' ORDER BY principal) AS access FROM best GROUP BY 1) SELECT cur.id, access FROM cur LEFT JOIN a USING (id)",
    "t_readable": f"{_DOWN}, {_GRANTS}, {_CHAIN} SELECT id FROM cur WHERE id NOT IN (SELECT id FROM chain JOIN grants ON root = anc) OR id IN (SELECT id FROM chain JOIN grants ON root = anc WHERE principal = 'p1')",
    "t_find": f"WITH {_CUR} SELECT id, title FROM cur WHERE usetype = 'section' AND lower(title[1:4]) = 'the ' ORDER BY created_at DESC, id LIMIT 20 OFFSET 5",
    "t_audit": f"{_DOWN}, {_GRANTS}, {_CHAIN}, top AS (SELECT id, coalesce(path[1], id) AS root FROM down), gov AS (SELECT DISTINCT id FROM chain JOIN grants ON root = anc) SELECT root, count(*) AS documents, count(*) FILTER (id NOT IN (SELECT id FROM gov)) AS ungoverned FROM top GROUP BY 1 HAVING count(*) FILTER (id NOT IN (SELECT id FROM gov)) > 0",
    "t_copies": f"WITH {_CUR}, h AS (SELECT *, row_number() OVER (PARTITION BY parent_id, content ORDER BY created_at DESC, id DESC) AS k, count(*) OVER (PARTITION BY parent_id, content) AS copies FROM cur WHERE usetype IS DISTINCT FROM 'file' AND content <> '') SELECT parent_id, sha256(content) AS hash, id, copies FROM h WHERE k = 1",
    "t_next": f"WITH {_CUR}, l AS (SELECT parent_id AS id, max(position) + 1 AS n FROM cur WHERE parent_id IS NOT NULL GROUP BY 1) SELECT cur.id, coalesce(n, 0)::INT AS next_position FROM cur LEFT JOIN l USING (id)",
    "t_bundle": f"{_DOWN}, {_KIDS}, d AS (SELECT id, len(path) AS depth FROM down), b AS (SELECT anc AS id, count(*) AS n_below FROM up GROUP BY 1) SELECT cur.id, title, usetype, coalesce(depth, 0) AS depth, coalesce(n, 0) AS n_children, coalesce(n_below, 0) AS n_below FROM cur LEFT JOIN kids USING (id) LEFT JOIN d USING (id) LEFT JOIN b USING (id)",
    "c_markdown": "SELECT n_nationkey, '| ' || n_nationkey || ' | ' || n_name || ' |' AS line FROM nation",
    "t_summarised": f"{_DOWN} SELECT anc AS id, count(*) AS below, sum(length(content))::BIGINT AS chars, max(depth - ad) AS height FROM up JOIN cur USING (id) GROUP BY 1",
    "g_degrees": f"WITH {_LINKS}, {_DEG.format('')} SELECT *, n_in + n_out AS n_all FROM deg",
    "g_combined": f"WITH {_LINKS}, e AS (SELECT src, dst, w FROM links UNION ALL SELECT src, dst, w FROM links WHERE t = 'R') SELECT src, dst, round(sum(CASE WHEN w = 0 THEN 1 ELSE w END), 6) AS weight FROM e GROUP BY ALL",
    "g_pagerank": f"WITH {_LINKS}, e AS (SELECT src, dst, sum(CASE WHEN w = 0 THEN 1 ELSE w END) AS w FROM links GROUP BY ALL), steps AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM e WHERE w > 0), base AS (SELECT id, 1.0 / (SELECT count(*) FROM vert) AS r FROM vert), r0 AS (SELECT id, r AS score FROM base){_PR} SELECT id, round(score, 9) AS score FROM r12",
    "g_betweenness": "WITH n AS (SELECT n_nationkey AS n, any_value(n_regionkey) AS r, count(c_custkey) AS c FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1), t AS (SELECT r, 1 + sum(c + 1) AS total FROM n GROUP BY 1), s AS (SELECT n, r, c, total, (SELECT count(*) FROM customer WHERE c_nationkey = n AND c_custkey % 100 = 0) AS k FROM n JOIN t USING (r)) SELECT n + 1000000000 AS id, round((k * (total - 2) + (sum(k) OVER (PARTITION BY r) - k) * c) / 2.0, 6)::DOUBLE AS score FROM s UNION ALL SELECT r + 2000000000, round(sum(k * (total - (c + 1) - 1)) / 2.0, 6)::DOUBLE FROM s GROUP BY r UNION ALL SELECT c_custkey, 0.0 FROM customer",
    "c_sheets": "WITH c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY column_id ORDER BY profiled_at DESC) AS rn FROM sheet_columns) WHERE rn = 1) SELECT sheet_id, max(sheet_name) AS name, count(*) AS columns, count(*) FILTER (is_unique) AS n_unique, string_agg(coalesce(column_name, letter), ', ' ORDER BY position) AS names FROM c GROUP BY 1",
    "g_neighbours": f"WITH {_LINKS}, e AS (SELECT src, dst FROM links WHERE t = 'R' UNION ALL SELECT dst, src FROM links WHERE t = 'R'), h0 AS (SELECT min(s_suppkey) * 2 AS id FROM supplier), h1 AS (SELECT dst AS id, min(src) AS via FROM e WHERE src IN (SELECT id FROM h0) AND dst NOT IN (SELECT id FROM h0) GROUP BY 1), h2 AS (SELECT dst AS id, min(src) AS via FROM e WHERE src IN (SELECT id FROM h1) AND dst NOT IN (SELECT id FROM h0 UNION ALL SELECT id FROM h1) GROUP BY 1) SELECT id, 0 AS hops, NULL::BIGINT AS via FROM h0 UNION ALL SELECT id, 1, via FROM h1 UNION ALL SELECT id, 2, via FROM h2",
    "g_components": f"WITH RECURSIVE {_CUR}, e AS (SELECT id AS a, parent_id AS b FROM cur WHERE parent_id IS NOT NULL UNION SELECT parent_id, id FROM cur WHERE parent_id IS NOT NULL), up(id, anc) AS (SELECT id, id FROM cur UNION SELECT up.id, cur.parent_id FROM up JOIN cur ON cur.id = up.anc WHERE cur.parent_id IS NOT NULL), top AS (SELECT id, anc FROM up WHERE anc NOT IN (SELECT id FROM cur WHERE parent_id IS NOT NULL) UNION SELECT id, min(anc) FROM up WHERE anc IN (SELECT x.id FROM cur x JOIN up y ON y.id = x.parent_id AND y.anc = x.id) AND id NOT IN (SELECT id FROM up WHERE anc NOT IN (SELECT id FROM cur WHERE parent_id IS NOT NULL)) GROUP BY id), low AS (SELECT anc AS t, least(min(id), anc) AS c FROM top GROUP BY anc) SELECT top.id, c AS component FROM top JOIN low ON low.t = top.anc",
    "g_authority": f"""{_DOWN}, {_KIDS}, sc AS (SELECT cur.id, coalesce(n, 0)::DOUBLE AS score FROM cur LEFT JOIN kids USING (id)),
q AS (SELECT list_sort(list(score))[(0.75 * (count(*) - 1))::DOUBLE::INT + 1] AS t0, list_sort(list(score)) AS l, count(*) AS n FROM sc WHERE score > 0), t AS (SELECT l[floor(0.75 * (n - 1))::INT + 1] AS t FROM q),
b AS (SELECT anc AS id, sum(score * power(0.7, depth - ad)) AS below, count(*) FILTER (score >= (SELECT t FROM t)) AS spread, count(*) + 1 AS size FROM up JOIN sc USING (id) GROUP BY 1)
SELECT id, score AS own, round(below, 6) AS below, spread, size, round((score + below) * (1 + ln(1 + spread)), 5) AS authority FROM sc JOIN b USING (id) WHERE size >= 3""",
    "g_orphans": f"WITH {_LINKS}, {_DEG.format(' WHERE t = $R$').replace('$R$', chr(39) + 'R' + chr(39))} SELECT id, n_in + n_out AS n_all, CASE WHEN n_in + n_out = 0 THEN 'warning' ELSE 'info' END AS severity FROM deg WHERE n_in + n_out <= 12",
    "g_lint": f"WITH {_LINKS}, {_DEG.format(' WHERE t = $R$').replace('$R$', chr(39) + 'R' + chr(39))}, {_FACTS}, l AS (SELECT *, row_number() OVER (PARTITION BY subject_id, predicate ORDER BY valid_from DESC, object DESC) AS rn FROM facts) SELECT 'orphan' AS rule, CASE WHEN n_in + n_out = 0 THEN 'warning' ELSE 'info' END AS severity, CASE WHEN n_in + n_out = 0 THEN 1 ELSE 2 END AS rank, count(*) AS n FROM deg WHERE n_in + n_out <= 12 GROUP BY ALL UNION ALL SELECT 'stale', 'info', 2, count(*) FROM l WHERE rn = 1 AND (epoch_us(TIMESTAMP '2025-06-01') - epoch_us(valid_from)) / 86400000000.0 > 90 HAVING count(*) > 0 UNION ALL SELECT 'contradiction', 'error', 0, count(*) FROM facts a JOIN facts b ON a.subject_id = b.subject_id AND a.predicate = b.predicate AND a.id < b.id AND a.object <> b.object AND a.valid_from <= b.valid_until AND b.valid_from <= a.valid_until HAVING count(*) > 0",
    "g_spines": f"""{_DOWN}, {_KIDS}, sc AS (SELECT cur.id, coalesce(n, 0)::DOUBLE AS score FROM cur LEFT JOIN kids USING (id)),
tot AS (SELECT up.id AS leaf, min(CASE WHEN ad = 0 THEN anc END) AS root, sum(sc.score) + max(own.score) AS total FROM up JOIN sc ON sc.id = anc JOIN sc own ON own.id = up.id WHERE up.id NOT IN (SELECT anc FROM up) GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY total DESC, leaf) AS place, max(total) OVER (PARTITION BY root) AS best FROM tot) SELECT root, leaf, total, place FROM r WHERE place <= 5 AND total >= 0.85::DOUBLE * best""",
    "k_derived": "SELECT c_custkey AS subject_id, 'within' AS predicate, (n_regionkey + 2000000000::BIGINT)::VARCHAR AS object FROM customer JOIN nation ON n_nationkey = c_nationkey",
    "k_backrefs": f"WITH {_PLACED} SELECT l_partkey * 2 + 1 AS id, 'link' AS kind, l_returnflag AS name, count(*) AS n, min(l_suppkey * 2) AS first FROM lineitem GROUP BY ALL UNION ALL SELECT o, 'fact', 'in', count(*), min(s) FROM placed GROUP BY ALL",
    "x_named": rf"WITH {_CUR} SELECT id, regexp_replace(lower(trim(title)), '\s+', '_', 'g') AS name, regexp_extract('urn:x#' || title, '([^#/]*)$', 1) AS local FROM cur WHERE content IS NULL AND title IS NOT NULL AND settled <> 'settled'",
    "k_found": f"WITH {_FACTS} SELECT id, subject_id, object FROM facts WHERE predicate = 'click' AND valid_from <= TIMESTAMP '2024-01-15' AND valid_until >= TIMESTAMP '2024-01-15'",
    "k_overlaps": "WITH e AS (SELECT event_id AS id, user_id, event_type AS t, epoch_us(ts) AS s, epoch_us(ts) + 21600000000 AS e FROM events) SELECT a.id AS a, b.id AS b, greatest(a.s, b.s) AS start, least(a.e, b.e) AS stop FROM e a JOIN e b ON a.user_id = b.user_id AND a.t = 'purchase' AND b.t <> 'purchase' AND a.s < b.e AND b.s < a.e",
    "c_rendered": "SELECT s_suppkey, s_name || ' of ' || s_nationkey || ': {{other}}' AS text, 'other' AS missing FROM supplier",
    "k_contradictions": f"WITH {_FACTS} SELECT a.id AS a, b.id AS b FROM facts a JOIN facts b ON a.subject_id = b.subject_id AND a.predicate = b.predicate AND a.id < b.id AND a.object <> b.object AND a.valid_from <= b.valid_until AND b.valid_from <= a.valid_until",
    "k_live": f"WITH {_FACTS} SELECT id, subject_id, predicate FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, predicate ORDER BY valid_from DESC, object DESC) AS rn FROM facts) WHERE rn = 1",
    "k_stale": f"WITH {_FACTS}, l AS (SELECT *, row_number() OVER (PARTITION BY subject_id, predicate ORDER BY valid_from DESC, object DESC) AS rn FROM facts), a AS (SELECT id, (epoch_us(TIMESTAMP '2025-06-01') - epoch_us(valid_from)) / 86400000000.0 AS age FROM l WHERE rn = 1) SELECT id, floor(age)::BIGINT AS age_days FROM a WHERE age > 90",
    "k_cardinality": f"WITH {_FACTS}, n AS (SELECT u.user_id AS id, count(f.id) AS n FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN facts f ON f.subject_id = u.user_id AND f.predicate = 'purchase' GROUP BY 1) SELECT id, n, 0::BIGINT AS bad FROM n WHERE n < 1 OR n > 20",
    "k_lines": f"""WITH {_FACTS} SELECT '<urn:x:' || subject_id || '> <urn:x:' || predicate || '> "' || object || '"^^<http://www.w3.org/2001/XMLSchema#decimal> .' AS line FROM facts""",
    "c_measures": rf"WITH {_CELL}, k AS (SELECT *, CASE WHEN v IS NULL THEN 'empty' WHEN v IN ('TRUE', 'FALSE') THEN 'bool' WHEN regexp_full_match(v, '[+-]?(\d+(\.\d+)?|\.\d+)([eE][+-]?\d+)?') THEN 'number' WHEN regexp_full_match(v, '\d{{4}}-\d{{2}}-\d{{2}}([ T]\d{{2}}:\d{{2}}(:\d{{2}}(\.\d+)?)?)?') THEN 'date' ELSE 'text' END AS k FROM v), m AS (SELECT sheet, col, k, count(*) AS n FROM k WHERE k <> 'empty' GROUP BY ALL), best AS (SELECT sheet, col, k AS kind FROM (SELECT *, row_number() OVER (PARTITION BY sheet, col ORDER BY n DESC, k) AS rn FROM m) WHERE rn = 1), t AS (SELECT sheet, col, count(*) AS n_rows, count(v) AS n_filled, count(DISTINCT v) AS n_distinct FROM v GROUP BY ALL) SELECT t.*, n_filled = n_distinct AND n_filled > 0 AS is_unique, coalesce(kind, 'empty') AS kind FROM t LEFT JOIN best USING (sheet, col)",
    "c_containment": f"WITH {_FOUND} SELECT a, b, shared, round(containment, 6) AS containment FROM found",
    "c_links": f"WITH {_FOUND}, u AS (SELECT sheet || '.' || col AS c, count(v) = count(DISTINCT v) AND count(v) > 0 AS u FROM v GROUP BY 1), f AS (SELECT x.a, x.b, y.a IS NOT NULL AS mutual, ua.u AS ua, ub.u AS ub FROM found x LEFT JOIN found y ON y.a = x.b AND y.b = x.a JOIN u ua ON ua.c = x.a JOIN u ub ON ub.c = x.b) SELECT a, b, mutual, CASE WHEN ub THEN 'key' ELSE 'shared' END AS reading FROM f WHERE NOT mutual OR (CASE WHEN ua <> ub THEN ub ELSE b < a END)",
    "c_distinct": f"WITH {_CELL} SELECT sheet, col, least(count(DISTINCT v), 5000) AS n_distinct, count(DISTINCT v) > 5000 AS at_least FROM v GROUP BY ALL",
    "c_values": f"WITH {_CELL} SELECT sheet, col, count(DISTINCT v) <= 50 AS has_values, CASE WHEN count(DISTINCT v) <= 50 THEN array_to_string(list_sort(list(DISTINCT v) FILTER (v IS NOT NULL)), '|') END AS list FROM v GROUP BY ALL HAVING count(v) > 0",
    "c_letters": "WITH c AS (SELECT DISTINCT column_id, position, letter FROM sheet_columns) SELECT column_id, n - 1 AS number, 1 AS top, n AS left, 10 AS bottom FROM (SELECT *, CASE length(letter) WHEN 1 THEN ascii(letter) - 64 WHEN 2 THEN (ascii(letter) - 64) * 26 + ascii(letter[2]) - 64 END AS n FROM c)",
    "c_split": "WITH r AS (SELECT c_custkey, 'c_custkey: ' || c_custkey || '.' AS a, 'c_name: ' || c_name || '.' AS b, 'c_nationkey: ' || c_nationkey || '.' AS c, 'c_mktsegment: ' || c_mktsegment || '.' AS d FROM customer), w AS (SELECT *, concat_ws(' ', a, b, c, d) AS t FROM r) SELECT c_custkey, NULL AS col, 0 AS piece, t AS text FROM w WHERE length(t) <= 60 UNION ALL SELECT c_custkey, unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_mktsegment']), 0, unnest([a, b, c, d]) FROM w WHERE length(t) > 60",
    "c_sketched": """WITH cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY column_id ORDER BY profiled_at DESC) AS rn FROM sheet_columns) WHERE rn = 1 AND column_values IS NULL AND sketch IS NOT NULL),
s AS (SELECT column_id AS c, sketch_count AS n, sketch_num_perm AS np, sketch_seed AS seed, len(sketch) AS k, unnest(sketch) AS x, generate_subscripts(sketch, 1) AS i FROM cur), e AS (SELECT a.c AS a, b.c AS b, a.n AS na, b.n AS nb, count(*) / a.k AS j FROM s a JOIN s b ON a.np = b.np AND a.seed = b.seed AND a.i = b.i AND a.x = b.x AND a.c <> b.c GROUP BY a.c, b.c, a.n, b.n, a.k)
SELECT a, b, round(least(j * (na + nb) / (1 + j) / na, 1.0), 6) AS estimate FROM e WHERE least(j * (na + nb) / (1 + j) / na, 1.0) >= 0.7""",
    "k_shapes": f"""WITH {_TYPED}, c AS (SELECT id FROM typed WHERE p = 'type' AND o = 'Customer'), n AS (SELECT id FROM typed WHERE p = 'type' AND o = 'Nation')
SELECT 's1' AS shape, id, 'segment' AS path, 'in' AS rule, 1 AS n FROM typed WHERE p = 'segment' AND o NOT IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') UNION ALL SELECT 's1', id, 'balance', 'datatype', 1 FROM typed WHERE p = 'balance' AND d <> 'decimal'
UNION ALL SELECT 's2', id, 'nation', 'class', 1 FROM typed WHERE p = 'nation' AND (d IS NOT NULL OR o::BIGINT NOT IN (SELECT id FROM n)) UNION ALL SELECT 's3', id, 'name', 'least', 0 FROM n""",
    "k_scope": f"WITH {_PLACED}, sc AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT n_nationkey + 1000000000 FROM nation WHERE n_nationkey % 3 = 0), rd AS (SELECT n_nationkey + 1000000000 AS id FROM nation WHERE n_nationkey % 5 <> 0) SELECT 'inner' AS part, s AS inside, o AS outside FROM placed WHERE s IN (SELECT id FROM sc) AND o IN (SELECT id FROM sc) UNION ALL SELECT 'cut', s, o FROM placed WHERE s IN (SELECT id FROM sc) AND o NOT IN (SELECT id FROM sc) AND o IN (SELECT id FROM rd) UNION ALL SELECT 'cut', o, s FROM placed WHERE o IN (SELECT id FROM sc) AND s NOT IN (SELECT id FROM sc) AND s IN (SELECT id FROM rd)",
    "t_totals": f"WITH {_CUR}, {_LINKS}, {_FACTS}, l AS (SELECT count(*) AS facts, count(*) FILTER (rn > 1) AS superseded FROM (SELECT row_number() OVER (PARTITION BY subject_id, predicate ORDER BY valid_from DESC, object DESC) AS rn FROM facts)) SELECT (SELECT count(*) FROM cur) AS nodes, (SELECT count(content) FROM cur) AS texts, (SELECT count(*) FROM token_embeddings) AS token_rows, (SELECT count(DISTINCT document_id) FROM token_embeddings) AS token_nodes, (SELECT count(DISTINCT t) FROM links) AS link_types, (SELECT count(*) FROM links) AS links, facts, superseded FROM l",
    "t_window": f"WITH {_CUR}, {_FACTS}, l AS (SELECT valid_from AS r, lead(valid_from) OVER (PARTITION BY subject_id, predicate ORDER BY valid_from, object) AS nxt FROM facts) SELECT (SELECT count(*) FROM cur WHERE created_at BETWEEN TIMESTAMP '2025-01-02' AND TIMESTAMP '2025-01-05') AS nodes, count(*) FILTER (r BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20') AS facts, count(*) FILTER (nxt BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20') AS superseded FROM l",
    "t_stubs": rf"WITH {_CUR}, {_KIDS}, o AS (SELECT parent_id AS id, id AS child, row_number() OVER (PARTITION BY parent_id ORDER BY position ASC NULLS LAST, created_at, id) - 1 AS place, regexp_replace(coalesce(content, ''), '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g') AS t FROM cur WHERE parent_id IS NOT NULL) SELECT o.id, child, place, nullif(CASE WHEN length(t) <= 80 THEN t ELSE regexp_replace(substring(t, 1, 80), '[ \t\n\r\f\v]+$', '') || '…' END, '') AS preview, coalesce(n, 0) AS n_children FROM o JOIN cur p ON p.id = o.id LEFT JOIN kids ON kids.id = child WHERE p.usetype IN ('section', 'conversation')",
    "t_levels": f"{_DOWN} SELECT anc AS id, depth - ad AS distance, count(*) AS n FROM up JOIN cur ON cur.id = anc WHERE usetype IN ('collection', 'folder') AND depth - ad <= 3 GROUP BY ALL",
    "t_lifecycle": f"{_DOWN}, {_CHAIN} SELECT anc AS id, cur.settled, count(*) AS n FROM chain JOIN cur p ON p.id = anc JOIN cur ON cur.id = chain.id WHERE p.usetype IN ('collection', 'folder') GROUP BY ALL",
    "c_prose": "SELECT c_custkey, 'c_custkey: ' || c_custkey || '. c_name: ' || c_name || '. c_mktsegment: ' || c_mktsegment || '.' AS text FROM customer",
    "x_paragraphs": r"WITH p AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\n[ \t]*\n'), lambda p: regexp_replace(p, '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g')), lambda p: p <> '') AS l FROM documents WHERE text IS NOT NULL) SELECT doc_id, (generate_subscripts(l, 1) - 1)::INT AS piece, unnest(l) AS text FROM p",
    "x_fulltext": r"""WITH items AS (SELECT query_id, regexp_extract_all(query_text, '-?"[^"]*"|\S+') AS l FROM eval_queries),
i AS (SELECT query_id, unnest(l) AS it, generate_subscripts(l, 1) AS i FROM items), alt AS (SELECT *, sum((it = 'OR')::INT) OVER (PARTITION BY query_id ORDER BY i) AS alt FROM i),
ph AS (SELECT query_id, alt, it LIKE '-%' AND length(it) > 1 AS neg, array_to_string(list_filter(string_split_regex(lower(it), '[^a-z0-9]+'), lambda x: length(x) >= 2), ' ') AS p FROM alt WHERE it NOT IN ('OR', 'AND')),
d AS (SELECT doc_id, ' ' || array_to_string(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: length(x) >= 2), ' ') || ' ' AS t FROM documents WHERE text IS NOT NULL),
m AS (SELECT query_id, alt, doc_id, bool_and(contains(t, ' ' || p || ' ') <> neg) AS ok, bool_or(NOT neg) AS has FROM ph, d WHERE p <> '' GROUP BY ALL)
SELECT DISTINCT query_id AS query, doc_id AS doc FROM m WHERE ok AND has""",
    "x_windows": r"WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \t\n\r\f\v]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL), i AS (SELECT doc_id, w, unnest(range(0, greatest(ceil((len(w) - 50) / 40.0), 0)::INT + 1)) AS piece FROM w WHERE len(w) > 0) SELECT doc_id, piece::INT AS piece, array_to_string(w[piece * 40 + 1 : piece * 40 + 50], ' ') AS text FROM i",
    "s_windows": "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
}

ORACLE["t_rollup"] = ORACLE["t_effective"].replace("SELECT id, sha256(text) AS hash, length(text)::INT AS size FROM txt", "SELECT id, CASE WHEN length(text) <= 4000 THEN sha256(text) END AS hash, CASE WHEN length(text) <= 4000 THEN 'concatenated' ELSE 'deferred' END AS how, length(text) AS size FROM txt")

ORACLE |= {
    "k_iris": "SELECT p_partkey, 'urn:x/part/' || replace(p_name, ' ', '%20') AS iri, true AS valid FROM part",
    "k_boxes": rf"""WITH cut AS (SELECT doc_id, string_split(regexp_replace(chr(10) || text, '\n(#{{1,6}}[ \t]+[^ \t\n\r\f\v])', chr(30) || '\1', 'g'), chr(30)) AS l FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, unnest(l) AS p, generate_subscripts(l, 1) - 1 AS section FROM cut),
f AS (SELECT *, coalesce(sum(length(p) + 1) OVER (PARTITION BY doc_id ORDER BY section ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p),
sp AS (SELECT doc_id, section, greatest(before - 1, 0) AS s, greatest(before - 1, 0) + length(p) - CASE WHEN section = 0 AND p LIKE chr(10) || '%' THEN 1 ELSE 0 END AS e FROM f WHERE regexp_matches(p, '^#{{1,6}}[ \t]') OR regexp_replace(p, '[\r\n\t ]', '', 'g') <> ''),
b AS (SELECT doc_id, unnest(range(0, (length(text) - 1) // 500 + 1)) AS i FROM documents WHERE length(text) > 0), m AS (SELECT sp.doc_id || '/' || section AS a, i // 3 AS page, i % 3 * 100 AS l, min(i // 3) OVER (PARTITION BY sp.doc_id, section) AS first FROM sp JOIN b ON b.doc_id = sp.doc_id AND s < (i + 1) * 500 AND i * 500 < e AND s < e)
SELECT a, page, min(l) AS left, 0 AS top, max(l) + 90 AS right, 700 AS bottom, count(*) AS blocks FROM m WHERE page = first GROUP BY a, page""",
    "k_upserted": f"WITH {_PLACED}, n AS (SELECT DISTINCT s, o FROM placed WHERE s % 2 <> 0) SELECT 'in' AS predicate, count(*) AS n, 0 AS late FROM placed UNION ALL SELECT 'lives_in', count(*), count(*) FROM n",
    "k_orphans": f"WITH {_CUR} SELECT DISTINCT document_id AS id, 'rows' AS kind FROM token_embeddings WHERE document_id IS NOT NULL AND document_id NOT IN (SELECT id FROM cur) UNION ALL SELECT id, 'node' FROM cur WHERE usetype = 'chunk' AND id NOT IN (SELECT document_id FROM token_embeddings WHERE document_id IS NOT NULL)",
    "g_triples": f"WITH {_PLACED}, e AS (SELECT s AS id, 0 AS i, 1 AS o FROM placed UNION ALL SELECT o, 1, 0 FROM placed) SELECT id, sum(i)::BIGINT AS n_in, sum(o)::BIGINT AS n_out, count(*) AS n_all FROM e GROUP BY 1",
    "g_branches": ORACLE["g_spines"].replace("SELECT root, leaf, total, place FROM r WHERE place <= 5 AND total >= 0.85::DOUBLE * best", """, ch AS (SELECT root, leaf FROM r WHERE place <= 5 AND total >= 0.85::DOUBLE * best), wh AS (SELECT sc.id, sc.score + coalesce((SELECT sum(x.score) FROM up JOIN sc x ON x.id = up.id WHERE up.anc = sc.id), 0) AS w FROM sc),
st AS (SELECT root, leaf, anc AS child FROM ch JOIN up ON up.id = ch.leaf UNION ALL SELECT root, leaf, leaf FROM ch) SELECT root, leaf, c.parent_id AS parent, child, o.id AS sibling FROM st JOIN cur c ON c.id = child JOIN cur o ON o.parent_id = c.parent_id AND o.id <> child JOIN wh m ON m.id = child JOIN wh t ON t.id = o.id WHERE t.w > 0 AND t.w >= 0.85::DOUBLE * m.w"""),
    "g_bridges": "WITH s AS (SELECT q.vec_id AS x, d.vec_id AS y, q.label AS lx, d.label AS ly, list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]) AS s FROM embeddings q, embeddings d WHERE q.vec_id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY s DESC, y) AS k FROM s) SELECT least(x, y) AS a, greatest(x, y) AS b, round(max(s), 6) AS score FROM r WHERE k <= 20 AND s >= 0.3 AND x <> y AND lx <> ly GROUP BY ALL",
    "x_conversations": f"WITH {_CUR}, o AS (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY position ASC NULLS LAST, created_at, id) - 1 AS place FROM cur WHERE parent_id IS NOT NULL), t AS (SELECT parent_id, string_agg('[' || CASE WHEN place % 2 = 0 THEN 'user' ELSE 'assistant' END || ']: ' || content, chr(10) || chr(10) ORDER BY place) AS t FROM o WHERE usetype = 'message' AND content IS NOT NULL GROUP BY 1) SELECT parent_id, sha256(t) AS hash, length(t)::INT AS size FROM t",
}

_RANKED = "".join(
    f", r{i} AS MATERIALIZED (SELECT b.id, (0.15 + 0.85 * (SELECT coalesce(sum(score), 0) FROM r{i - 1} WHERE id NOT IN (SELECT src FROM steps))) * b.r + 0.85 * coalesce(m, 0) AS score FROM base b LEFT JOIN (SELECT dst, sum(score) AS m FROM steps JOIN r{i - 1} ON r{i - 1}.id = steps.src GROUP BY 1) x ON x.dst = b.id)"
    for i in range(1, 31)
)
ORACLE["t_uncovered"] = f"WITH {_CUR}, steps AS (SELECT id AS src, parent_id AS dst FROM cur WHERE parent_id IN (SELECT id FROM cur) AND usetype IS NOT NULL), base AS MATERIALIZED (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM cur) AS r FROM cur), r0 AS (SELECT id, r AS score FROM base){_RANKED}, best AS (SELECT id, round(score, 9) AS score FROM r30 ORDER BY 2 DESC, 1 LIMIT 25) SELECT * FROM best WHERE id NOT IN (SELECT parent_id FROM cur WHERE usetype = 'summary' AND parent_id IS NOT NULL)"
