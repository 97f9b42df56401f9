"""Noise in text from scanned pages: running lines, page numbers, cut words, misread characters.

Lines at page edges that repeat within a file, up to numbers, misread characters and a few lost
or added ones, are headers and footers; lines that hold only a number which counts on from page
to page are page numbers.
What is left is joined by a vocabulary counted over the whole corpus: a word cut at a line end
is one whose halves together are a word there, and not a compound written with a hyphen; a
misread word is a rare one that a frequent word looks like, letter for letter.

Two words look alike if their skeletons are equal: the skeleton writes every character as the
strokes it can be mistaken for, so words are compared by equality. Lines at page edges are
compared by edit distance between skeletons: those of a file that share a piece are measured
against the commonest of them, never pair by pair.
"""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyroot.operators.current import in_force_wide
from tallyroot.work import Workspace

# Characters that scanning mistakes for each other, by the strokes they are made of.
STROKES = {
    "0": "o", "1": "i", "l": "i", "!": "i", "|": "i", "5": "s", "$": "s", "6": "ii", "8": "ii", "b": "ii", "h": "ii", "u": "ii",
    "9": "g", "+": "t", "@": "a", "4": "a", "¢": "c", "e": "c", "€": "c", "y": "v", "w": "vv", "d": "ci", "n": "ri", "m": "rri", "2": "z",
    "ﬁ": "fi", "ﬂ": "fi", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffi", "’": "'",
}
_TABLE = str.maketrans(STROKES)
#: Marks of a cut word at a line's end: hyphens, soft hyphen, not sign.
MARKS = "-‐‑¬­"
#: Lines with text that count as a page's edge, at the top and at the bottom.
EDGE = 3
#: Edge lines are alike within this edit distance, as a share of the longer skeleton, from so many characters on.
APART, LEAST_FORM = 0.15, 8
#: Edge lines are compared if they share one of their so many pieces of so many characters with the least hashes.
PIECES, PIECE = 6, 4
#: A running line is on this share of the pages from its first to its last, at least; one that ends like a sentence on this many.
DENSE, DENSE_ENDED = 0.25, 0.6
#: What one file repeats is running in others that have it once, if it is repeated in this share of all that have it.
COMMON = 0.25
SALTS = 16
#: A word is misread if a look-alike is so many times as frequent.
RATIO = 4
#: Pages of a file are put in order within stretches of so many positions.
STRETCH = 4096

_INNER = r"\p{L}\p{M}\p{N}+@!¢€$|ﬁﬂﬀﬃﬄ"
WORD = rf"[{_INNER}](?:[{_INNER}'’‐-]*[{_INNER}])?"
_word = regex.compile(WORD)
_heading = regex.compile(r"^\s*\p{N}+(?:\.\p{N}+)+\.?\s+\p{L}")
_roman = regex.compile(r"^(?=[ivxlc])(?:c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})$")
# Letters read for digits in a number.
_DIGITS = str.maketrans({"o": "0", "q": "0", "l": "1", "i": "1", "s": "5", "b": "8", "z": "2", "g": "9", "|": "1", "!": "1"})
_no = r"(?:[oqlisbzg|!]*\p{N}[\p{N}oqlisbzg|!]*)"
_number = regex.compile(rf"^(?P<pre>[^\p{{L}}\p{{N}}]*(?:\p{{L}}{{1,9}}[^\p{{L}}\p{{N}}]{{1,3}})?)(?P<no>{_no}|[ivxlc]{{1,9}})(?P<of>\s*(?:/|\p{{L}}{{1,4}}(?=\s))\s*{_no})?(?P<post>[^\p{{L}}\p{{N}}]*)$")
_beside = regex.compile(rf"^(?P<a>{_no}|[ivxlc]{{1,9}})\s{{2,}}\D|\s{{2,}}(?P<b>{_no}|[ivxlc]{{1,9}})\W*$")
_page = regex.compile(rf"^(?:{_no}|[ivxlc]{{1,9}})\s{{2,}}|\s{{2,}}(?:{_no}|[ivxlc]{{1,9}})\W*$|(?:^|\s)[-–—\[|(]?\s*(?:p|s|page|seite)?\.?\s*{_no}\s*[-–—\])|.]?\s*$", regex.I)
_ended = regex.compile(r"[\p{L}\p{N})][.!?,;:]$")


def skeleton(text: str) -> str:
    return text.lower().translate(_TABLE)


def skeleton_in(text: str) -> str | None:
    """A second skeleton, in which `in` and `m` look alike too; null for words with neither."""
    low = text.lower()
    return skeleton(low.replace("in", "m")) if "in" in low or "m" in low else None


def roman(text: str) -> int | None:
    if text == "l":
        return 1  # a misread 1; no page is numbered with a lone L
    if not text or not _roman.match(text):
        return None
    value = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
    nums = [value[c] for c in text]
    return sum(-n if i + 1 < len(nums) and n < nums[i + 1] else n for i, n in enumerate(nums))


def page_number(line: str) -> tuple[int, str] | None:
    """(value, shape) of a line that holds a page number only; `#` alone is the shape of a bare one."""
    m = _number.match(line.strip().lower())
    if not m:
        return None
    no = m["no"]
    value, kind = roman(no), "r#"
    if value is None:
        kind = "#"
        digits = no.translate(_DIGITS)
        if not digits.isdecimal():
            return None
        value = int(digits)
    shape = f"{m['pre'].strip()}{kind}{'/#' if m['of'] else ''}"
    return value, shape if shape != "#" or not m["post"].strip(" .,'`") else "#" + m["post"].strip()


def number_beside(line: str) -> int | None:
    """The page number at the side of a running line, set off by two spaces or more."""
    m = _beside.search(line.strip().lower())
    found = (m["a"] or m["b"]) if m else ""
    if (value := roman(found)) is not None:
        return value
    digits = found.translate(_DIGITS)
    return int(digits) if digits.isdecimal() and len(digits) < 8 else None


def running_form(line: str) -> str | None:
    """What stays the same in a running line from page to page: its skeleton without page number and digits; numbered headings are none."""
    line = line.strip()
    if _heading.match(line):
        return None
    text = regex.sub(r"(?<!\p{L})\p{N}+(?!\p{L})", "#", _page.sub(" ", line, count=1))
    form = regex.sub(r"\s+", " ", skeleton(text)).strip()
    return form if sum(c.isalpha() for c in form) >= 4 else None


EDGES = "file long, id long, position long, line_no int, form string, ended boolean, outer boolean, value long, shape string"
LINES = "file long, id long, position long, seq int, line_no int, text string, gap boolean, last boolean"


def _edges(batches):
    for frame in batches:
        rows = []
        for file, key, pos, content in zip(frame["file"], frame["id"], frame["position"], frame["content"]):
            lines = content.split("\n")
            full = [i for i, x in enumerate(lines) if x.strip()]
            near = {i: page_number(lines[i]) for i in dict.fromkeys(full[:EDGE] + full[-EDGE:])}
            # The outermost lines of the page that are more than a number.
            words = [i for i in near if not near[i]]
            for i, number in near.items():
                form = running_form(lines[i])
                if not number and form:
                    number = (number_beside(lines[i]), "beside")
                rows.append((file, key, pos, i + 1, form, bool(_ended.search(lines[i].strip())), bool(words) and i in (words[0], words[-1]), *(number or (None, None))))
        out = pd.DataFrame(rows, columns=["file", "id", "position", "line_no", "form", "ended", "outer", "value", "shape"])
        yield out.astype({"value": "Int64"})


def _body(batches):
    for frame in batches:
        rows = []
        for file, key, pos, content, out in zip(frame["file"], frame["id"], frame["position"], frame["content"], frame["out"]):
            drop = set(out) if out is not None else set()
            kept, gap = [], True
            for i, x in enumerate(content.split("\n"), 1):
                if not x.strip():
                    gap = True
                elif i not in drop:
                    kept.append((i, x.rstrip(), gap))
                    gap = False
            # A page that starts in the middle of a sentence has no gap before its first line.
            rows += [(file, key, pos, j, i, x, g and j > 0, j == len(kept) - 1) for j, (i, x, g) in enumerate(kept)]
        yield pd.DataFrame(rows, columns=["file", "id", "position", "seq", "line_no", "text", "gap", "last"])


def chunks(text: Column) -> Column:
    """What stands between white space, in order; empty strings where there is more than one blank."""
    return F.split(F.trim(F.translate(text, "\n\r\t\x0b\x0c\u00a0", "      ")), " ")


def line_chunks(lines: DataFrame) -> DataFrame:
    """(id, line_no, role, chunk): role 1: the line's first chunk, 2: its last, else 0."""
    c = lines.select("id", "line_no", chunks(F.col("text")).alias("c"))
    c = c.select("id", "line_no", F.size("c").alias("n"), F.posexplode("c").alias("i", "chunk")).where("chunk <> ''")
    return c.select("id", "line_no", F.when(F.col("i") == F.col("n") - 1, 2).when(F.col("i") == 0, 1).otherwise(0).alias("role"), "chunk")


def line_cuts(lines: DataFrame, work: Workspace) -> DataFrame:
    """(id, line_no, next_id, next_line, a, b, marked): line ends at which a word a + b may be cut."""
    text = F.rtrim(F.translate("text", "\r\t\u00a0", "   "))
    near = lines.where(F.col("next_text").isNotNull() & ~F.col("next_gap"))
    near = near.select("id", "line_no", "next_id", "next_line", F.substring_index(text, " ", -1).alias("last"), F.substring_index(F.ltrim(F.translate("next_text", "\r\t\u00a0", "   ")), " ", 1).alias("first"))
    c, e = F.substring("first", 1, 1), F.substring("last", -1, 1)
    marked = F.position(e, F.lit(MARKS)) > 0
    starts = ((F.lower(c) == c) & (F.upper(c) != c)) | c.rlike("[0156924+@!¢|ﬁﬂ]")
    # Kept step by step: else each condition below would take the lines apart again.
    near = work.keep(near.where("last <> '' and first <> ''"))
    near = near.where(starts & (marked | e.rlike(f"[{_INNER}]"))).withColumn("marked", marked)
    near = near.where(~F.col("last").rlike(r"^\P{L}*\p{N}$"))
    a = F.lower(F.regexp_replace(F.when(F.col("marked"), F.regexp_replace("last", f"[{MARKS}]+$", "")).otherwise(F.col("last")), f"^[^{_INNER}]+", ""))
    b = F.lower(F.regexp_extract("first", f"({WORD})", 1))
    cuts = work.keep(near.select("id", "line_no", "next_id", "next_line", a.alias("a"), b.alias("b"), "marked"))
    cuts = cuts.where("a <> '' and b <> ''")
    return cuts.where(F.concat("a", F.substring("b", 1, 1)).rlike(r"\p{L}") & ~F.col("a").rlike(r"^\p{N}+$"))


def nodes_in_force(nodes: DataFrame, work: Workspace) -> DataFrame:
    """The rows in force, kept: pages and vocabulary are both read from here."""
    return work.keep(in_force_wide(nodes.select("id", "updated_at", "parent_id", "position", "usetype", "content"), "id", "updated_at", ["parent_id", "position", "usetype", "content"], work))


def scanned_pages(cur: DataFrame, usetype: str = "scan:page") -> DataFrame:
    """(file, id, position, content): the scanned pages among rows in force; null contents and parents included as given."""
    page = (F.col("usetype") == usetype) & F.col("content").isNotNull()
    return cur.where(page).select(F.col("parent_id").cast("long").alias("file"), F.col("id").cast("long").alias("id"), F.coalesce(F.col("position").cast("long"), F.lit(1 << 40)).alias("position"), "content")


def alike_forms(edges: DataFrame, work: Workspace) -> DataFrame:
    """(f0, form, root): forms of outermost lines of a file (f0) that are another, commoner one with a few characters misread, lost or added."""
    long = edges.where("form is not null and outer").where(F.length("form") >= LEAST_FORM).groupBy("f0", "form").agg(F.count("*").alias("n"))
    pieces = F.transform(F.sequence(F.lit(1), F.length("form") - PIECE + 1), lambda i: F.xxhash64(F.substring("form", i, F.lit(PIECE))))
    keyed = work.keep(long).select("f0", "form", "n", F.explode(F.slice(F.array_sort(F.array_distinct(pieces)), 1, PIECES)).alias("piece"))
    # A piece's commonest form is what the others are measured against. It is one row for each of
    # the salts, so that no file's members, however many, are one task's work.
    centre = keyed.groupBy("f0", "piece").agg(F.count("*").alias("m"), F.max(F.struct("n", "form")).alias("c")).where("m > 1")
    centre = centre.select("f0", "piece", F.col("c.n").alias("cn"), F.col("c.form").alias("cform"), F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
    members = keyed.withColumn("salt", F.pmod(F.xxhash64("form"), F.lit(SALTS)).cast("int"))
    pairs = members.join(centre, ["f0", "piece", "salt"]).where("form <> cform").select("f0", "form", "cn", "cform")
    most = F.floor(F.greatest(F.length("form"), F.length("cform")) * F.lit(APART)).cast("int")
    near = pairs.where((F.abs(F.length("form") - F.length("cform")) <= most) & (F.levenshtein("form", "cform") <= most))
    return near.groupBy("f0", "form").agg(F.max_by("cform", F.struct("cn", "cform")).alias("root"))


def edge_kinds(pages: DataFrame, work: Workspace) -> DataFrame:
    """(id, line_no, kind): running lines and page numbers."""
    edges = work.keep(pages.mapInPandas(_edges, EDGES).withColumn("f0", F.coalesce(F.col("file"), F.lit(-1))))
    sizes = pages.groupBy("file").agg(F.count("*").alias("pages"))
    # A file's form is running if enough of the pages from its first to its last carry it: two or
    # more if it stands there twice alike, three or more if each has characters of its own.
    rooted = edges.where("form is not null").join(alike_forms(edges, work), ["f0", "form"], "left")
    rooted = work.keep(rooted.select("f0", "id", "position", "line_no", "ended", "outer", F.coalesce("root", "form").alias("form"), (F.col("root").isNull()).alias("same")))
    span = F.max("position") - F.min("position") + 1
    paged = rooted.groupBy("f0", "form", "id").agg(F.max("same").alias("same"), F.max("ended").alias("ended"), F.min("position").alias("position"))
    groups = paged.groupBy("f0", "form").agg(F.count("*").alias("n"), F.count_if("same").alias("seed"), span.alias("span"), F.max("ended").alias("ended"))
    plain = ((F.col("seed") >= 2) | (F.col("n") >= 3)) & (F.col("n") >= DENSE * F.col("span"))
    own = F.when(F.col("ended"), (F.col("n") >= 3) & (F.col("n") >= DENSE_ENDED * F.col("span"))).otherwise(plain)
    groups = work.keep(groups.withColumn("own", own))
    # It is then running as the outermost line of other files' pages too, if enough of the files that have it repeat it.
    common = groups.where("not ended").groupBy("form").agg(F.count_if("own").alias("k"), F.count("*").alias("all")).where(F.col("k") >= COMMON * F.col("all")).where("k > 0").select("form")
    alone = rooted.where("outer and not ended").join(common, "form", "left_semi").select("id", "line_no")
    known = groups.where("own").select("f0", "form")
    repeated = rooted.join(known, ["f0", "form"], "left_semi").select("id", "line_no").unionByName(alone).withColumn("kind", F.lit("running"))
    # Numbers that count on with the pages, alone on their line or beside a running line.
    numbers = edges.where("value is not null").withColumn("step", F.col("value") - F.col("position"))
    alike = numbers.groupBy("file", "step", "shape").agg(F.count_distinct("id").alias("m"))
    steps = numbers.groupBy(F.col("file").alias("f2"), F.col("step").alias("s2")).agg(F.count_distinct("id").alias("n"))
    alike = alike.join(steps, F.col("file").eqNullSafe(F.col("f2")) & (F.col("step") == F.col("s2"))).select(F.col("file").alias("f3"), F.col("step").alias("s3"), F.col("shape").alias("shape3"), "n", "m")
    n = numbers.join(alike, F.col("file").eqNullSafe(F.col("f3")) & (F.col("step") == F.col("s3")) & (F.col("shape") == F.col("shape3")))
    n = n.join(sizes.withColumnRenamed("file", "f4"), F.col("file").eqNullSafe(F.col("f4"))).select("id", "line_no", "shape", "step", "n", "m", "pages")
    bare = F.col("shape") == "#"
    counted = F.when(bare, (F.col("n") >= 2) & (F.col("n") >= 0.6 * F.col("pages"))).otherwise((F.col("n") >= 2) & ((F.col("m") >= 2) | ~F.col("shape").rlike(r"\p{L}{6,}")))
    alone = (F.col("pages") == 1) & ~F.col("shape").rlike(r"^\(") & (~bare | (F.col("step") == 0))
    single = F.col("shape") != "beside"
    page_no = n.where(single & (counted | alone)).select("id", "line_no", F.lit("page_no").alias("kind"))
    beside = n.where(~single & counted).select("id", "line_no", F.lit("running").alias("kind"))
    kinds = page_no.unionByName(repeated).unionByName(beside)
    return work.keep(kinds.groupBy("id", "line_no").agg(F.min("kind").alias("kind")))


def body_lines(pages: DataFrame, edges: DataFrame, work: Workspace) -> DataFrame:
    """Lines of running text in order, each with the next one of its file, maybe on the next page."""
    out = edges.groupBy("id").agg(F.collect_list("line_no").alias("out"))
    lines = work.keep(pages.join(out, "id", "left").mapInPandas(_body, LINES))
    within = Window.partitionBy("id").orderBy("seq")
    nxt = lambda c: F.lead(c).over(within)
    chained = lines.select("*", F.when(~F.col("last"), F.col("id")).alias("nid"), nxt("line_no").alias("nno"), nxt("text").alias("ntext"), nxt("gap").alias("ngap"))
    # First lines of the pages with text, chained in stretches of positions, so no file is one task's work.
    heads = lines.where("seq = 0").select("file", "id", "position", F.col("line_no").alias("hno"), F.col("text").alias("htext")).withColumn("c", F.floor(F.col("position") / STRETCH))
    at = Window.partitionBy("file", "c").orderBy("position", "id")
    head = F.struct(F.col("id").alias("nid"), F.col("hno").alias("nno"), F.col("htext").alias("ntext"))
    heads = heads.withColumn("h", head).withColumn("after", F.lead("h").over(at))
    starts = heads.groupBy("file", "c").agg(F.min_by("h", F.struct("position", "id")).alias("h")).withColumn("start", F.lead("h").over(Window.partitionBy("file").orderBy("c"))).select("file", "c", "start")
    heads = heads.join(starts, [heads.file.eqNullSafe(starts.file), heads.c == starts.c]).select("id", F.coalesce("after", "start").alias("h"))
    full = chained.join(heads, "id", "left")
    pick = lambda c: F.coalesce(F.col(c), F.when(F.col("last"), F.col(f"h.{c}")))
    return full.select("file", "id", "position", "seq", "line_no", "text", "gap", "last", pick("nid").alias("next_id"), pick("nno").alias("next_line"), pick("ntext").alias("next_text"), F.coalesce("ngap", F.lit(False)).alias("next_gap"))


def vocabulary(cur: DataFrame, items: DataFrame, usetype: str, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """(w, f, sk, sk2): words of the corpus with their numbers; (chunk, w): the words of each chunk of a scanned line.

    Texts are only cut at blanks; words are taken out of the distinct chunks, after counting.
    Chunks at line ends may hold halves of cut words: they are known, but count nothing.
    """
    clean = cur.where(~F.col("usetype").eqNullSafe(F.lit(usetype)) & F.col("content").isNotNull())
    counted = clean.select(F.explode(chunks(F.col("content"))).alias("chunk")).groupBy("chunk").agg(F.count("*").alias("f"))
    inner = items.groupBy("chunk").agg(F.count_if(F.col("role") == 0).alias("f"))
    found = lambda d: d.select("*", F.explode(F.regexp_extract_all(F.lower("chunk"), F.lit(f"({WORD})"), F.lit(1))).alias("w")).where("length(w) > 1")
    inner = work.keep(found(inner))
    both = found(counted).select("w", "f").unionByName(inner.select("w", "f")).groupBy("w").agg(F.sum("f").alias("f"))
    as_skeleton = F.pandas_udf(lambda s: s.map(skeleton), "string")
    second = F.pandas_udf(lambda s: s.map(skeleton_in), "string")
    return work.keep(both.withColumn("sk", as_skeleton("w")).withColumn("sk2", second("w"))), inner.select("chunk", "w")


def scan_noise(nodes: DataFrame, usetype: str = "scan:page") -> tuple[DataFrame, DataFrame, DataFrame, Workspace]:
    """(id, line_no, kind) of noisy lines; the body lines; the repairs (id, line_no, kind, w, to):
    kind `rest` is the half of a cut word at a line's start, `compound` a hyphen that stays.

    kind: `running`, `page_no`, `broken` (the last word goes on in the next line of running
    text), `misread`. Lines are counted from 1 after splitting the content at line feeds. Of
    repeated rows of a page the one in force counts. Pages are in order of `position` (null
    last), then id; pages without a parent are one file. Null and blank contents have no lines.
    Extra columns are not read. An empty table gives an empty result.
    """
    work = Workspace(nodes.sparkSession, "scans")
    cur = nodes_in_force(nodes, work)
    pages = work.keep(scanned_pages(cur, usetype))
    edges = edge_kinds(pages, work)
    lines = work.keep(body_lines(pages, edges, work))
    # Not kept: to cut the lines once more costs less than to write and read a row for each word.
    items = line_chunks(lines)
    vocab, in_chunks = vocabulary(cur, items, usetype, work)
    work.drop(cur)
    plain = F.col("w").rlike(r"\p{L}")
    looks = vocab.where(plain & (F.col("f") > 0)).groupBy("sk").agg(F.max(F.struct("f", "w")).alias("best")).select("sk", F.col("best.f").alias("best_f"), F.col("best.w").alias("best_w"))
    looks = work.keep(looks)
    second = vocab.where(plain & (F.col("f") > 0) & F.col("sk2").isNotNull()).groupBy("sk2").agg(F.max(F.struct("f", "w")).alias("best")).select("sk2", F.col("best.f").alias("best_f"), F.col("best.w").alias("best_w"))
    pairs = vocab.join(looks, "sk").select("w", "f", "best_f", "best_w").unionByName(vocab.join(second, "sk2").select("w", "f", "best_f", "best_w"))
    rare = (F.col("w") != F.col("best_w")) & (F.col("best_f") >= RATIO * F.greatest("f", F.lit(1))) & F.col("w").rlike(r"[^\p{N}]")
    wrong = pairs.where(rare).groupBy("w").agg(F.max_by("best_w", F.struct("best_f", "best_w")).alias("best_w"))
    # A mark of exclamation or a bar after a word of the vocabulary is punctuation.
    bare = F.regexp_replace("w", r"[!|$+@]+$", "")
    tail = wrong.where(bare != F.col("w")).select("w", bare.alias("stem")).join(vocab.select(F.col("w").alias("stem"), F.col("f").alias("stem_f")), "stem").where("stem_f > 1").select("w")
    wrong = work.keep(wrong.join(tail, "w", "left_anti").select("w", F.col("best_w").alias("to")))

    cuts = line_cuts(lines, work)
    sk = F.pandas_udf(lambda s: s.map(skeleton), "string")
    # Unmarked line ends are cuts only if the halves together are a word, so few of them go on from here.
    whole_words = looks.select("sk", F.col("best_f").alias("f_ab"), F.col("best_w").alias("whole"))
    joined = work.keep(cuts.withColumn("sk", sk(F.concat("a", "b"))).join(whole_words, "sk", "left").drop("sk").where("marked or f_ab is not null"))
    # The other three words that a cut is judged by are looked up at once.
    words = F.array(F.concat("a", F.lit("-"), "b"), F.col("a"), F.col("b"))
    asked = joined.select("id", "line_no", F.posexplode(words).alias("i", "word")).withColumn("sk", sk("word"))
    best = lambda c, i: F.max(F.when(F.col("i") == i, F.col(c)))
    got = asked.join(looks, "sk").groupBy("id", "line_no").agg(best("best_f", 0).alias("f_c"), best("best_w", 0).alias("compound"), best("best_f", 1).alias("f_a"), best("best_f", 2).alias("f_b"))
    joined = joined.join(got, ["id", "line_no"], "left")
    ab, c, fa, fb = (F.coalesce(x, F.lit(0)) for x in ("f_ab", "f_c", "f_a", "f_b"))
    is_cut = F.when(F.col("marked"), (ab >= c) & ((ab > 0) | (F.least(fa, fb) < 2))).otherwise((ab > 1) & (F.least(fa, fb) * RATIO < ab))
    judged = work.keep(joined.withColumn("cut", is_cut))
    broken = judged.where("cut").select("id", "line_no", F.lit("broken").alias("kind"), F.concat("a", "b").alias("w"), F.coalesce("whole", F.concat("a", "b")).alias("to"))

    # Whole words: inside a line, and at its ends where no word is cut.
    lead = judged.where("cut or (marked and f_c is not null)").select("id", "line_no", F.lit(2).alias("role"))
    trail = judged.where("cut or (marked and f_c is not null)").select(F.col("next_id").alias("id"), F.col("next_line").alias("line_no"), F.lit(1).alias("role"))
    bad_chunks = work.keep(in_chunks.join(wrong, "w"))
    whole = items.join(bad_chunks, "chunk").select("id", "line_no", "role", "w", "to")
    misread = whole.join(lead.unionByName(trail), ["id", "line_no", "role"], "left_anti").select("id", "line_no", "w", "to")
    # A misread character in a cut word is in the half that the right word does not begin or end with.
    true = F.when(F.col("cut"), F.col("whole")).otherwise(F.regexp_replace("compound", "-", ""))
    halves = judged.where((F.col("cut") & F.col("whole").isNotNull()) | (F.col("marked") & ~F.col("cut") & F.col("compound").isNotNull())).withColumn("true", true).where(F.col("true") != F.concat("a", "b"))
    halves = halves.where(F.when(F.col("cut"), True).otherwise(F.regexp_replace(F.concat("a", "b"), "-", "") != F.col("true")))
    left = halves.where(~F.expr("startswith(true, a)")).select("id", "line_no", F.col("a").alias("w"), F.col("true").alias("to"))
    right = halves.where(~F.expr("endswith(true, b)")).select(F.col("next_id").alias("id"), F.col("next_line").alias("line_no"), F.col("b").alias("w"), F.col("true").alias("to"))
    bad = misread.unionByName(left).unionByName(right).select("id", "line_no", F.lit("misread").alias("kind"), "w", "to")
    rest = judged.where("cut").select(F.col("next_id").alias("id"), F.col("next_line").alias("line_no"), F.lit("rest").alias("kind"), F.col("b").alias("w"), F.lit("").alias("to"))
    compound = judged.where("marked and not cut").select("id", "line_no", F.lit("compound").alias("kind"), "a", F.lit("").alias("to")).withColumnRenamed("a", "w")
    repairs = broken.unionByName(bad).unionByName(rest).unionByName(compound)
    noise = F.col("kind").isin("broken", "misread")
    found = edges.select("id", "line_no", "kind").unionByName(repairs.where(noise).select("id", "line_no", "kind")).distinct()
    return found, lines, repairs, work


REPAIRED = "file long, id long, position long, seq int, line_no int, gap boolean, last boolean, ends boolean, next_id long, text string, glue boolean"


def _like(word: str, pattern: str) -> str:
    return word.upper() if pattern.isupper() and len(pattern) > 1 else word[:1].upper() + word[1:] if pattern[:1].isupper() else word


def _repaired(batches):
    for frame in batches:
        rows = []
        for file, key, pos, seq, no, gap, last, nid, text, fixes in zip(frame["file"], frame["id"], frame["position"], frame["seq"], frame["line_no"], frame["gap"], frame["last"], frame["next_id"], frame["text"], frame["fixes"]):
            ends = bool(regex.search(r"""[.!?:]["'”’»)]*\s*$""", text))
            line, glue = text.strip(), False
            fixes = [] if fixes is None else list(fixes)
            wrong = {f["w"]: f["to"] for f in fixes if f["kind"] == "misread"}
            if wrong:
                line = _word.sub(lambda m: _like(wrong[m[0].lower()], m[0]) if m[0].lower() in wrong else m[0], line)
            for f in fixes:
                if f["kind"] == "rest":  # it was written at the end of the line before, but its punctuation is here
                    first, _, after = line.partition(" ")
                    tail = regex.sub(rf"^.*[{_INNER}]", "", first)
                    line = (tail + " " + after).strip() if tail else after.strip()
                    if tail:
                        line = "\x00" + line
                elif f["kind"] == "compound":
                    glue = True
            for f in fixes:
                if f["kind"] == "broken":
                    cut = line.split(" ")[-1]
                    lead = regex.match(rf"^[^{_INNER}]*", cut)[0]
                    line = line[: len(line) - len(cut)] + lead + _like(f["to"], cut[len(lead) :][:1])
            rows.append((file, key, pos, seq, no, gap, last, ends, nid, line, glue))
        out = pd.DataFrame(rows, columns=["file", "id", "position", "seq", "line_no", "gap", "last", "ends", "next_id", "text", "glue"])
        yield out.astype({"next_id": "Int64"})


def paragraphs(nodes: DataFrame, usetype: str = "scan:page") -> DataFrame:
    """(file, id, line_no, text): the repaired paragraphs of each file, by the page and line they begin on.

    Running lines and page numbers are gone, cut words are whole, misread words are replaced. A
    paragraph ends at a blank line; at a page's end it goes on unless the last line ends a
    sentence.
    """
    _, lines, repairs, work = scan_noise(nodes, usetype)
    fixes = repairs.groupBy("id", "line_no").agg(F.collect_set(F.struct("kind", "w", "to")).alias("fixes"))
    done = work.keep(lines.join(fixes, ["id", "line_no"], "left").mapInPandas(_repaired, REPAIRED))
    ended = done.where("last and next_id is not null").select(F.col("next_id").alias("id"), F.lit(0).alias("seq"), F.col("ends").alias("before"))
    starts = F.col("gap") | ((F.col("seq") == 0) & F.coalesce("before", F.lit(True)))
    own = F.when(starts, F.struct("id", "line_no"))
    inside = Window.partitionBy("id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    marked = done.join(ended, ["id", "seq"], "left").withColumn("p", F.last(own, ignorenulls=True).over(inside))
    # The paragraph a page goes on with: the last one begun on the pages before it, in stretches of positions.
    pages = marked.groupBy("file", "id", "position").agg(F.max_by("p", "seq").alias("p")).withColumn("c", F.floor(F.col("position") / STRETCH))
    w = Window.partitionBy("file", "c").orderBy("position", "id").rowsBetween(Window.unboundedPreceding, -1)
    pages = pages.withColumn("open", F.last("p", ignorenulls=True).over(w))
    ends = pages.where("p is not null").groupBy("file", "c").agg(F.max_by("p", F.struct("position", "id")).alias("end"))
    every = pages.select("file", "c").distinct()
    ends = every.join(ends.select(F.col("file").alias("f2"), F.col("c").alias("c2"), "end"), F.col("file").eqNullSafe(F.col("f2")) & (F.col("c") == F.col("c2")), "left")
    over = Window.partitionBy("file").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(F.col("file").alias("f3"), F.col("c").alias("c3"), F.last("end", ignorenulls=True).over(over).alias("carry"))
    opened = pages.join(ends, F.col("file").eqNullSafe(F.col("f3")) & (F.col("c") == F.col("c3"))).select("id", F.coalesce("open", "carry").alias("open"))
    full = marked.join(opened, "id").withColumn("p", F.coalesce("p", "open", F.struct("id", "line_no")))
    lines_ = F.sort_array(F.collect_list(F.struct("position", "id", "seq", "text", "glue")))
    per = full.groupBy("file", "p").agg(lines_.alias("x"))
    joined = F.aggregate("x", F.lit(""), lambda s, r: F.concat(s, r["text"], F.when(r["glue"], F.lit("")).otherwise(F.lit(" "))))
    text = F.trim(F.regexp_replace(F.regexp_replace(joined, r" ?\x00", ""), r" +", " "))
    return per.select("file", F.col("p.id").alias("id"), F.col("p.line_no").alias("line_no"), text.alias("text")).where("text <> ''")
