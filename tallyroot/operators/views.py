"""Reading the tree of nodes: children, siblings, ancestors, effective content, access."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyroot.operators.current import in_force
from tallyroot.operators.hierarchy import Hierarchy, ancestors
from tallyroot.work import Workspace

NODE_COLUMNS = ["parent_id", "title", "content", "position", "usetype", "produced_by", "created_at", "event_time", "settled"]
#: How far down a container's text is looked for, and how many characters are put into one row at most.
MAX_DEPTH, MOST_CHARS = 40, 64_000_000


def current_nodes(nodes: DataFrame, keep: list[str] | None = None) -> DataFrame:
    return in_force(nodes, "id", "updated_at", keep or NODE_COLUMNS)


def settled(nodes: DataFrame) -> DataFrame:
    return nodes.where("settled = 'settled'")


def clock() -> Column:
    """A node's place in time: when it happened, else when it was made."""
    return F.coalesce("event_time", "created_at")


def as_of(nodes: DataFrame, moment) -> DataFrame:
    return nodes.where(clock() <= F.lit(moment))


def subtree(up: DataFrame, nodes: DataFrame, roots: DataFrame, with_roots: bool = False) -> DataFrame:
    """Nodes below any of the roots (id), each once; up: (id, ancestor)."""
    ids = up.join(roots.select(F.col("id").alias("ancestor")), "ancestor", "left_semi").select("id")
    if with_roots:
        ids = ids.unionByName(roots.select("id"))
    return nodes.join(ids.distinct(), "id", "left_semi")


def sibling_order() -> list[Column]:
    return [F.asc_nulls_last("position"), F.asc("created_at"), F.asc("id")]


def sibling_places(nodes: DataFrame, buckets: int = 64) -> DataFrame:
    """(id, parent_id, place): places of siblings from 0; siblings are ranked in buckets of positions, then offset."""
    bucket = F.coalesce(F.floor(F.col("position") / 1024), F.lit(1 << 40))
    rows = nodes.where("parent_id is not null").withColumn("b", bucket)
    inner = rows.withColumn("k", F.row_number().over(Window.partitionBy("parent_id", "b").orderBy(*sibling_order())))
    sizes = rows.groupBy("parent_id", "b").agg(F.count("*").alias("n"))
    sizes = sizes.select("parent_id", "b", (F.sum("n").over(Window.partitionBy("parent_id").orderBy("b")) - F.col("n")).alias("before"))
    return inner.join(sizes, ["parent_id", "b"]).select("id", "parent_id", (F.col("k") + F.col("before") - 1).alias("place"))


def children_counts(nodes: DataFrame) -> DataFrame:
    """(id, n_children) of every node, 0 included."""
    n = nodes.where("parent_id is not null").groupBy("parent_id").agg(F.count("*").alias("n_children"))
    return nodes.select("id").join(n.withColumnRenamed("parent_id", "id"), "id", "left").select("id", F.coalesce("n_children", F.lit(0)).alias("n_children"))


def siblings(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """(id, sibling, place): the other children of each asked node's (id) parent, in sibling order; roots have none."""
    places = sibling_places(nodes)
    asked = places.join(of.select("id"), "id", "left_semi").select(F.col("id").alias("me"), "parent_id")
    return asked.join(places.withColumnRenamed("id", "sibling"), "parent_id").where("me <> sibling").select(F.col("me").alias("id"), "sibling", "place")


def roots(nodes: DataFrame) -> DataFrame:
    return nodes.where("parent_id is null")


def subtree_to_depth(tree: Hierarchy, of: DataFrame, depth: int) -> DataFrame:
    """(id, descendant, distance): what lies below the asked nodes (id), at most `depth` steps down."""
    pairs = ancestors(tree, among=of, up_to=depth, sound=True)
    return pairs.select(F.col("ancestor").alias("id"), F.col("id").alias("descendant"), "distance")


def subtree_states(nodes: DataFrame, tree: Hierarchy, of: DataFrame) -> DataFrame:
    """(id, settled, n): below each asked node (id), itself included, the number of nodes in each state."""
    below = ancestors(tree, among=of, sound=True).select(F.col("ancestor").alias("top"), "id").unionByName(of.select(F.col("id").alias("top"), "id"))
    return below.join(nodes.select("id", "settled"), "id").groupBy(F.col("top").alias("id"), "settled").agg(F.count("*").alias("n"))


def frontier(nodes: DataFrame, tree: Hierarchy, summaries: DataFrame | None = None, depth: int = MAX_DEPTH) -> DataFrame:
    """(id, member, summary): for each container the first nodes with a text on each branch below it.

    A member has content, or is a container with a stored summary (id, text), and no such node
    lies between it and the container; it is at most `depth` steps below. summary: whether the
    member stands with its summary.
    """
    full = nodes.where("content is not null and trim(content) <> ''").select("id", F.lit(False).alias("summary"))
    if summaries is not None:
        held = nodes.where("content is null").select("id").join(summaries.where("trim(text) <> ''").select("id").distinct(), "id", "left_semi")
        full = full.unionByName(held.withColumn("summary", F.lit(True)))
    containers = nodes.where("content is null").select("id")
    # The nearest node with a text above hides a node from all containers above that one.
    hiding = ancestors(tree, full, among=full, sound=True).groupBy("id").agg(F.max("ancestor_depth").alias("hid"))
    seen = ancestors(tree, full, among=containers, up_to=depth, sound=True).join(hiding, "id", "left").where("hid is null or ancestor_depth >= hid")
    return seen.join(full, "id").select(F.col("ancestor").alias("id"), F.col("id").alias("member"), "summary")


def content_parts(nodes: DataFrame, tree: Hierarchy, summaries: DataFrame | None = None, depth: int = MAX_DEPTH) -> DataFrame:
    """(id, member, key, summary): a container's parts; keys, compared as arrays, are the order of the tree.

    A key holds the places of the member and of those above it among their siblings.
    """
    places = sibling_places(nodes).select("id", "place")
    members = frontier(nodes, tree, summaries, depth)
    chain = ancestors(tree, members.select(F.col("member").alias("id")), sound=True).where("ancestor_depth > 0")
    above = chain.join(places.withColumnRenamed("id", "ancestor"), "ancestor").select("id", F.struct("ancestor_depth", "place").alias("o"))
    own = members.select(F.col("member").alias("id")).distinct().join(places, "id").select("id", F.struct(F.lit(1 << 40).cast("long").alias("ancestor_depth"), "place").alias("o"))
    keys = above.unionByName(own).groupBy("id").agg(F.sort_array(F.collect_list("o"))["place"].alias("key"))
    return members.join(keys.withColumnRenamed("id", "member"), "member").select("id", "member", "key", "summary")


def effective_content(nodes: DataFrame, tree: Hierarchy, summaries: DataFrame | None = None, depth: int = MAX_DEPTH, most: int = MOST_CHARS) -> DataFrame:
    """(id, text, size, members): a container's text, its frontier's texts in tree order, joined by blank lines.

    Texts above `most` characters are not put together (text null): their parts are those of
    content_parts, in order; size is their length all the same.
    """
    # Kept: sizes and texts both come from the parts.
    parts = Workspace(nodes.sparkSession, "parts").keep(content_parts(nodes, tree, summaries, depth))
    texts = nodes.where("content is not null").select(F.col("id").alias("member"), F.col("content").alias("t"))
    if summaries is not None:
        stored = summaries.groupBy(F.col("id").alias("member")).agg(F.max("text").alias("t"))
        texts = texts.unionByName(stored.join(nodes.where("content is null").select(F.col("id").alias("member")), "member", "left_semi"))
    sized = parts.join(texts.select("member", F.char_length("t").cast("long").alias("n")), "member")
    sizes = sized.groupBy("id").agg((F.sum("n") + 2 * (F.count("*") - 1)).alias("size"), F.count("*").alias("members"))
    small = parts.join(sizes.where(F.col("size") <= most).select("id"), "id", "left_semi").join(texts, "member")
    joined = small.groupBy("id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("key", "t")))["t"], "\n\n").alias("text"))
    return sizes.join(joined, "id", "left").select("id", "text", "size", "members")


def _governing(nodes: DataFrame, tree: Hierarchy, tops: DataFrame) -> DataFrame:
    """(id, root): every node with those of the roots (root) that it is or lies below."""
    few = tops.select(F.col("root").alias("id")).distinct()
    own = nodes.select("id").join(few, "id", "left_semi").select("id", F.col("id").alias("root"))
    return ancestors(tree, among=few, sound=True).select("id", F.col("ancestor").alias("root")).unionByName(own)


def readable(nodes: DataFrame, tree: Hierarchy, grants: DataFrame, principal: str) -> DataFrame:
    """Nodes that a principal may read: below or at a root granted to it, or under no governed root.

    grants: (root, principal, level); write implies read.
    """
    mine = grants.groupBy("root").agg(F.max(F.when(F.col("principal") == principal, 1).otherwise(0)).alias("mine"))
    hidden = _governing(nodes, tree, grants).join(mine, "root").groupBy("id").agg(F.max("mine").alias("mine")).where("mine = 0")
    return nodes.join(hidden, "id", "left_anti")


def writable(nodes: DataFrame, tree: Hierarchy, grants: DataFrame, principal: str) -> DataFrame:
    """Nodes that a principal may write: below or at a root it has a write grant for, or under no governed root."""
    mine = grants.groupBy("root").agg(F.max(F.when((F.col("principal") == principal) & (F.col("level") == "write"), 1).otherwise(0)).alias("mine"))
    hidden = _governing(nodes, tree, grants).join(mine, "root").groupBy("id").agg(F.max("mine").alias("mine")).where("mine = 0")
    return nodes.join(hidden, "id", "left_anti")


def access_keys(nodes: DataFrame, tree: Hierarchy, grants: DataFrame) -> DataFrame:
    """(id, access): every principal's greatest level over the node and those above it, as `p:read,q:write`; null if ungoverned."""
    level = F.max(F.when(F.col("level") == "write", 2).otherwise(1)).alias("l")
    best = _governing(nodes, tree, grants).join(grants, "root").groupBy("id", "principal").agg(level)
    text = F.array_join(F.array_sort(F.collect_list(F.concat("principal", F.lit(":"), F.when(F.col("l") == 2, "write").otherwise("read")))), ",")
    return nodes.select("id").join(best.groupBy("id").agg(text.alias("access")), "id", "left")


def find(nodes: DataFrame, parent: int | None = None, usetype: str | None = None, title: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest nodes first, with the given parent, usetype and beginning of the title in any letter case."""
    if parent is not None:
        nodes = nodes.where(F.col("parent_id") == parent)
    if usetype is not None:
        nodes = nodes.where(F.col("usetype") == usetype)
    if title is not None:
        nodes = nodes.where(F.lower(F.substring("title", 1, len(title))) == title.lower())
    return nodes.orderBy(F.desc("created_at"), "id").offset(offset).limit(limit)


def access_audit(nodes: DataFrame, tree: Hierarchy, grants: DataFrame) -> DataFrame:
    """(root, documents, ungoverned): trees with nodes that no grant covers, the most first."""
    governed = _governing(nodes, tree, grants).select("id", F.lit(1).alias("g")).distinct()
    n = tree.nodes.where("kind = 'tree'").select("id", "root").join(governed, "id", "left")
    n = n.groupBy("root").agg(F.count("*").alias("documents"), F.count_if(F.col("g").isNull()).alias("ungoverned"))
    return n.where("ungoverned > 0")


def newest_by_content(nodes: DataFrame) -> DataFrame:
    """(parent_id, hash, id, copies): of nodes of one parent with equal content the newest; `file` nodes are left out, null usetypes are not."""
    from tallyroot.functions.text import content_hash

    rows = nodes.where(~F.col("usetype").eqNullSafe(F.lit("file"))).withColumn("hash", content_hash(F.col("content"))).where("hash is not null")
    return rows.groupBy("parent_id", "hash").agg(F.max_by("id", F.struct("created_at", "id")).alias("id"), F.count("*").alias("copies"))


def next_positions(nodes: DataFrame) -> DataFrame:
    """(id, next_position): the place a new child of each node would get, 0 without children."""
    last = nodes.where("parent_id is not null").groupBy("parent_id").agg((F.max("position") + 1).alias("n"))
    return nodes.select("id").join(last.withColumnRenamed("parent_id", "id"), "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("next_position"))


def bundle(nodes: DataFrame, tree: Hierarchy) -> DataFrame:
    """(id, title, usetype, depth, n_children, n_below): what a view of each node shows."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    places = tree.nodes.where("kind = 'tree'").select("id", "depth", F.col("n_descendants").alias("n_below"))
    return nodes.select("id", "title", "usetype").join(children_counts(nodes), "id").join(places, "id", "left").select("id", "title", "usetype", z("depth"), "n_children", z("n_below"))


def children_page(nodes: DataFrame, of: DataFrame, size: int = 50, page: int = 0) -> DataFrame:
    """(id, child, place, n_children): one page of each asked node's (id) children in sibling order, with their own numbers of children."""
    kids = sibling_places(nodes).where(F.col("place").between(page * size, (page + 1) * size - 1))
    kids = kids.join(of.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").select(F.col("parent_id").alias("asked"), "id", "place")
    return kids.join(children_counts(nodes), "id").select(F.col("asked").alias("id"), F.col("id").alias("child"), "place", "n_children")


def child_stubs(nodes: DataFrame, of: DataFrame, preview: int = 200, how: str = "collapsed") -> DataFrame:
    """(id, child, place, title, usetype, preview, n_children): how a view of each asked node (id) shows its children.

    how: `collapsed`: the beginning of the child's text; `inline-headings`: its first heading
    line before that; `first-paragraph`: its first paragraph; `hidden`: no children.
    """
    if how not in ("collapsed", "inline-headings", "first-paragraph", "hidden"):
        raise ValueError(f"no such way: {how!r}")
    if how == "hidden":
        nodes = nodes.limit(0)
    text = F.regexp_replace(F.coalesce("content", F.lit("")), r"^\s+|\s+$", "")
    begun = F.when(F.char_length(text) <= preview, text).otherwise(F.concat(F.regexp_replace(F.substring(text, 1, preview), r"\s+$", ""), F.lit("…")))
    head = F.regexp_extract(text, r"(?m)^(#{1,6}[ \t]+\S[^\r\n]*)", 1)
    shown = {"inline-headings": F.trim(F.concat(head, F.when(head != "", "\n\n").otherwise(""), begun)), "first-paragraph": F.trim(F.regexp_extract(text, r"(?s)^(.*?)(?:\n\n|$)", 1))}.get(how, begun)
    places = sibling_places(nodes).join(of.select(F.col("id").alias("parent_id")).distinct(), "parent_id", "left_semi")
    rows = places.join(nodes.select("id", "title", "usetype", F.when(shown != "", shown).alias("preview")), "id").join(children_counts(nodes), "id")
    return rows.select(F.col("parent_id").alias("id"), F.col("id").alias("child"), "place", "title", "usetype", "preview", "n_children")


def with_references(nodes: DataFrame, links: DataFrame, facts: DataFrame, handling: str = "footnotes") -> DataFrame:
    """(id, text): contents with `[[N]]` and `[[doc:N]]` as links to the nodes' titles, and what the node points at below.

    links: (source_id, target_id, link_type); facts: live (subject_id, predicate, object,
    datatype). handling: `footnotes` are numbered, `inline-citations` a list under References,
    `sidebar` footnotes behind a mark, `hidden` leaves them out. Links come before facts, each
    in order of type and target; an untitled node is named by its id.
    """
    if handling not in ("footnotes", "inline-citations", "sidebar", "hidden"):
        raise ValueError(f"no such handling: {handling!r}")
    titles = nodes.select(F.col("id").alias("n"), F.when(F.length("title") > 0, F.col("title")).alias("t"))
    asked = nodes.select("id", F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(r"\[\[(?:doc:)?(\d{1,18})\]\]"), F.lit(1)))).alias("k")).withColumn("n", F.col("k").cast("long"))
    named = asked.join(titles, "n", "left").groupBy("id").agg(F.collect_set(F.struct("k", F.coalesce("t", F.concat(F.lit("doc "), "k")).alias("t"))).alias("names"))
    body = nodes.select("id", F.coalesce("content", F.lit("")).alias("c")).join(named, "id", "left")

    def link(text, x):
        to = F.concat(F.lit("["), x["t"], F.lit("](/view/"), x["k"], F.lit(")"))
        return F.replace(F.replace(text, F.concat(F.lit("[["), x["k"], F.lit("]]")), to), F.concat(F.lit("[[doc:"), x["k"], F.lit("]]")), to)

    body = body.select("id", F.when(F.col("names").isNull(), F.col("c")).otherwise(F.aggregate("names", F.col("c"), link)).alias("c"))
    if handling == "hidden":
        return body.select("id", F.col("c").alias("text"))
    out = links.select(F.col("source_id").alias("id"), F.lit(0).alias("o"), F.coalesce("link_type", F.lit("links_to")).alias("p"), F.col("target_id").cast("long").alias("n"), F.lit(None).cast("string").alias("v"))
    node = F.when(F.col("datatype").isNull(), F.col("object").try_cast("long"))
    out = out.unionByName(facts.select(F.col("subject_id").alias("id"), F.lit(1).alias("o"), F.col("predicate").alias("p"), node.alias("n"), F.col("object").alias("v")))
    title = F.concat(F.lit("["), F.coalesce("t", F.concat(F.lit("#"), F.col("n").cast("string"))), F.lit("](/view/"), F.col("n").cast("string"), F.lit(")"))
    arrow = F.when(F.col("o") == 0, " ").otherwise(" → ")
    line = F.concat(F.lit("**"), "p", F.lit("**"), arrow, F.when(F.col("n").isNull(), F.col("v")).otherwise(title))
    held = out.join(titles, "n", "left").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("o", "p", "n", "v", line.alias("l"))))["l"].alias("ls"))
    mark = (lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x)) if handling == "footnotes" else (lambda x, i: F.concat(F.lit("- "), x))
    head = "## References" if handling == "inline-citations" else "## Footnotes"
    below = F.concat(F.lit(("<!-- sidebar -->\n" if handling == "sidebar" else "") + head + "\n\n"), F.array_join(F.transform("ls", mark), "\n"), F.lit("\n"))
    gap = F.when((F.col("c") != "") & ~F.col("c").endswith("\n"), "\n\n\n").otherwise("\n\n")
    return body.join(held, "id", "left").select("id", F.when(F.col("ls").isNull(), F.col("c")).otherwise(F.concat("c", gap, below)).alias("text"))


def without_summary(nodes: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """(id, score): of the k nodes with the highest scores (id, score) those without a child of usetype `summary`."""
    best = scores.orderBy(F.desc("score"), "id").limit(k)
    return best.join(nodes.where("usetype = 'summary' and parent_id is not null").select(F.col("parent_id").alias("id")), "id", "left_anti")
