"""Readers of text, conversations, evaluation sets and marked-up pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGE = "struct<prompt:string,response:string,role:string,content:string,text:string>"


def detect_format(head: Column, name: Column) -> Column:
    """Format of a file by its first bytes, then by whether they are UTF-8 text, then by its extension."""
    hexed = F.hex(F.substring(head, 1, 8))
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    text = F.try_validate_utf8(head.cast("string"))
    start = F.lower(F.substring(F.ltrim(text), 1, 15))
    return (
        F.when(hexed.startswith("25504446"), "pdf")
        .when(hexed.startswith("504B0304"), F.when(ext.isin("docx", "pptx", "xlsx"), ext).otherwise("zip"))
        .when(hexed.startswith("D0CF11E0A1B11AE1"), "ole2")
        .when(hexed.startswith("89504E47"), "png")
        .when(hexed.startswith("FFD8FF"), "jpeg")
        .when(start.startswith("<!doctype html") | start.startswith("<html"), "html")
        .when(text.isNotNull() & ext.isin("md", "jsonl", "json", "csv", "tsv", "html", "txt"), F.when(ext == "txt", "text").otherwise(ext))
        .when(text.isNotNull(), "text")
        .otherwise("unknown")
    )


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, format, sha256, content) of files."""
    f = spark.read.format("binaryFile").load(path)
    return f.select("path", "length", detect_format(F.col("content"), F.col("path")).alias("format"), F.sha2("content", 256).alias("sha256"), "content")


def conversation_turns(lines: DataFrame, key: str, order: str, line: str) -> DataFrame:
    """(key, turn, role, text) from JSON lines {prompt, response} or {role, content}; bad lines are skipped, turns counted on.

    The window is over one conversation.
    """
    from pyspark.sql import Window

    j = F.from_json(F.col(line), MESSAGE, {"mode": "PERMISSIVE"})
    row = lambda role, text: F.struct(role.alias("role"), text.alias("text"))
    pair = F.array(row(F.lit("user"), F.col("j.prompt")), row(F.lit("assistant"), F.col("j.response")))
    single = F.array(row(F.col("j.role"), F.coalesce("j.content", "j.text")))
    parts = F.when(F.col("j.prompt").isNotNull() | F.col("j.response").isNotNull(), pair).when(F.col("j.role").isNotNull(), single)
    rows = lines.withColumn("j", j).select(key, order, F.posexplode(parts).alias("k", "m")).where("m.text is not null")
    return rows.select(key, (F.row_number().over(Window.partitionBy(key).orderBy(order, "k")) - 1).alias("turn"), "m.role", "m.text")


def conversation_text(turns: DataFrame, key: str) -> DataFrame:
    """(key, text): `[role]: text` of the turns in order, joined by blank lines."""
    parts = F.sort_array(F.collect_list(F.struct("turn", F.concat(F.lit("["), "role", F.lit("]: "), "text").alias("t"))))
    return turns.groupBy(key).agg(F.array_join(parts["t"], "\n\n").alias("text"))


def read_judged_set(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """corpus (doc, title, text), queries (query, text) and judgments (query, doc, grade) of a BEIR-style folder."""
    corpus = spark.read.schema("_id string, title string, text string").json(f"{folder}/corpus.jsonl")
    queries = spark.read.schema("_id string, text string").json(f"{folder}/queries.jsonl")
    qrels = spark.read.option("sep", "\t").option("header", True).schema("`query-id` string, `corpus-id` string, score int").csv(f"{folder}/qrels/test.tsv")
    return corpus.withColumnRenamed("_id", "doc"), queries.withColumnRenamed("_id", "query"), qrels.toDF("query", "doc", "grade")


def html_text(html: Column) -> Column:
    """Visible text: scripts, styles and comments dropped, headings as `#`, blocks as lines, common entities decoded."""
    t = F.regexp_replace(html, r"(?is)<(script|style|noscript|template)\b.*?</\1\s*>|<!--.*?-->", " ")
    for k in range(1, 7):
        t = F.regexp_replace(t, rf"(?is)<h{k}\b[^>]*>\s*", "\n\n" + "#" * k + " ")
    t = F.regexp_replace(t, r"(?is)<li\b[^>]*>\s*", "\n- ")
    t = F.regexp_replace(t, r"(?is)</?(p|div|section|article|ul|ol|table|tr|h[1-6]|blockquote|pre)\b[^>]*>", "\n\n")
    t = F.regexp_replace(t, r"(?is)<br\s*/?>", "\n")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", "")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t\x0B\f\r]+", " "), r" ?\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
