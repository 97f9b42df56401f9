"""Boolean full text in the usual search-box syntax.

Words must all occur (AND may stand between them); "quoted words" stand in a row; OR separates alternatives; a minus
excludes. Words are the index's tokens, not stemmed, and no word is left out.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyroot.functions.text import tokens
from tallyroot.work import ship

_item = re.compile(r'(-?)"([^"]*)"|(\S+)')
_token = re.compile(r"[^a-z0-9]+")
CLAUSES = "array<struct<must:array<array<string>>,no:array<array<string>>>>"


def parse(query: str | None) -> list[tuple[list[list[str]], list[list[str]]]]:
    """Alternatives of (phrases that must occur, phrases that must not)."""
    out: list[tuple[list, list]] = [([], [])]
    for minus, quoted, word in _item.findall(query or ""):
        if word == "OR":
            out.append(([], []))
        if word in ("OR", "AND"):
            continue
        no = minus == "-" or (word.startswith("-") and len(word) > 1)
        phrase = [t for t in _token.split((word or quoted).lower()) if len(t) >= 2]
        if phrase:
            out[-1][1 if no else 0].append(phrase)
    return [c for c in out if c[0]]


def _holds(text, phrase):
    n = F.size(phrase)
    return F.exists(F.sequence(F.lit(0), F.greatest(F.size(text) - n, F.lit(0))), lambda i: F.slice(text, i + 1, n) == phrase)


def fulltext(docs: DataFrame, key: str, text: str, queries: DataFrame, query: str, query_text: str) -> DataFrame:
    """(query, doc) that match. A query without a word that must occur matches nothing.

    Candidates are found by one word of each alternative through the postings, then checked; a
    document is matched with as many alternatives as hold its words, so the queries are a stated set.
    """
    ship(docs.sparkSession)
    parsed = F.pandas_udf(lambda s: pd.Series([[{"must": m, "no": n} for m, n in parse(q)] for q in s]), CLAUSES)
    alts = queries.where(F.col(query_text).isNotNull()).select(F.col(query).alias("query"), F.explode(parsed(query_text)).alias("c"))
    longest = F.array_max(F.transform(F.flatten("c.must"), lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"]
    alts = alts.select("query", F.col("c.must").alias("must"), F.col("c.no").alias("no"), longest.alias("term"))
    d = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("doc"), tokens(F.col(text)).alias("t"))
    # Only ids go through the joins by term; a document's tokens travel once, to all the alternatives it may match.
    near = d.select("doc", F.explode(F.array_distinct("t")).alias("term")).join(alts.select("term").distinct(), "term", "left_semi")
    pairs = near.join(alts, "term").groupBy("doc").agg(F.collect_list(F.struct("query", "must", "no")).alias("asked"))
    ok = lambda a: F.forall(a["must"], lambda p: _holds(F.col("t"), p)) & ~F.exists(a["no"], lambda p: _holds(F.col("t"), p))
    return pairs.join(d, "doc").select("doc", F.explode(F.array_distinct(F.transform(F.filter("asked", ok), lambda a: a["query"]))).alias("query")).select("query", "doc")
