"""How distinctive a term is of a record: hypergeometric enrichment.

A record of n term occurrences is seen as a draw from the N occurrences of the collection, K
of them of the term. The score is the negative natural logarithm of the probability that such
a draw holds the term as often as the record does, or more, adjusted for the number of terms
tested in the record (Benjamini-Hochberg).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyroot.work import Workspace


def _correction(x: np.ndarray) -> np.ndarray:
    y = 1.0 / (x * x)
    return (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y / 1680))) / x


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x >= 1 (Stirling's series after a shift)."""
    x = np.asarray(x, dtype="float64")
    small = x < 16
    z = np.where(small, x + 16, x)
    down = np.zeros_like(x)
    for k in range(16):
        down += np.where(small, np.log(np.where(small, x + k, 1.0)), 0.0)
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + _correction(z) - down


def log_gamma_step(a: np.ndarray, d: np.ndarray) -> np.ndarray:
    """ln gamma(a) - ln gamma(a - d), without the cancellation of two huge numbers."""
    a, d = np.asarray(a, dtype="float64"), np.asarray(d, dtype="float64")
    b = a - d
    plain = log_gamma(a) - log_gamma(np.maximum(b, 1.0))
    big = b > 1e4
    bb, aa = np.where(big, b, 1e5), np.where(big, a, 1e5)
    stable = -(aa - 0.5) * np.log1p(-np.where(big, d, 0.0) / aa) + d * np.log(bb) - d + _correction(aa) - _correction(bb)
    return np.where(big, stable, plain)


def log_upper_tail(k: np.ndarray, n: np.ndarray, of: np.ndarray, total: np.ndarray) -> np.ndarray:
    """ln P(X >= k), X the number of `of` marked ones among n drawn from `total` without replacement."""
    k, n, of, total = (np.asarray(a, dtype="float64") for a in (k, n, of, total))
    choose = lambda a, b: log_gamma_step(a + 1, b) - log_gamma(b + 1)
    lead = choose(of, k) + choose(total - of, n - k) - choose(total, n)
    out = np.ones_like(lead)
    x, term, at = k.copy(), np.ones_like(lead), np.arange(len(lead))
    most = np.minimum(n, of)
    with np.errstate(over="ignore", invalid="ignore"):
        while len(at):
            term = term * ((of[at] - x) * (n[at] - x) / ((x + 1) * (total[at] - of[at] - n[at] + x + 1)))
            x = x + 1
            live = (x <= most[at]) & (term > 0)
            at, term, x = at[live], term[live], x[live]
            out[at] += term
            falling = (of[at] - x) * (n[at] - x) < (x + 1) * (total[at] - of[at] - n[at] + x + 1)
            live = ~(falling & (term < out[at] * 1e-18)) & np.isfinite(out[at])
            at, term, x = at[live], term[live], x[live]
        return np.minimum(lead + np.log(out), 0.0)


def _surprise(k: pd.Series, n: pd.Series, of: pd.Series, total: pd.Series) -> pd.Series:
    return pd.Series(-log_upper_tail(k, n, of, total) + 0.0)


def term_counts(postings: DataFrame, record: str = "document_id", term: str = "term", freq: str = "term_freq", source: list[str] | None = None) -> DataFrame:
    """(r, t, k): occurrences of each term, in lower case, in each record.

    Repeated rows (the same record, term as spelled and `source` columns) count once, with the
    greatest frequency; spellings that differ in case only are added. Rows without record or
    term, or without a positive frequency, are left out. A blank term is a term.
    """
    key = [F.col(c).alias(f"_{i}") for i, c in enumerate(source or [])]
    once = postings.where(F.col(record).isNotNull() & F.col(term).isNotNull() & (F.col(freq) > 0)).select(F.col(record).alias("r"), F.col(term).alias("w"), *key, F.col(freq).cast("long").alias("f"))
    once = once.groupBy("r", "w", *[f"_{i}" for i in range(len(key))]).agg(F.max("f").alias("f"))
    return once.groupBy("r", F.lower("w").alias("t")).agg(F.sum("f").alias("k"))


def enrichment(counts: DataFrame, of: DataFrame | None = None, least_records: int = 2) -> DataFrame:
    """(r, t, k, df, raw, score): for each record and each term found in `least_records` records or more.

    raw: negative log of the exact upper-tail probability. score: the same after the
    Benjamini-Hochberg adjustment over the record's tested terms, never above raw. df: records
    with the term. `counts`: what term_counts gives; `of` (r): score these records only, the
    collection is still the whole of `counts`. An empty table gives an empty result.

    Counts are summed before they are shuffled. Ranks within a record are found in bands of
    the score, so a record with a great many terms is not one task's work.
    """
    work = Workspace(counts.sparkSession, "enrichment")
    counts = work.keep(counts)
    total = counts.agg(F.sum("k")).first()[0] or 0
    terms = counts.groupBy("t").agg(F.sum("k").alias("of"), F.count("*").alias("df")).where(F.col("df") >= least_records)
    asked = counts if of is None else counts.join(of.select("r").distinct(), "r", "left_semi")
    sizes = asked.groupBy("r").agg(F.sum("k").alias("n"))
    rows = asked.join(terms, "t").join(sizes, "r").withColumn("raw", F.pandas_udf(_surprise, "double")("k", "n", "of", F.lit(total)))
    rows = work.keep(rows.select("r", "t", "k", "df", "raw", F.least(F.floor(F.col("raw") * 64), F.lit(1 << 16)).cast("int").alias("b")))
    band = Window.partitionBy("r", "b").orderBy(F.desc("raw"))
    placed = rows.withColumn("place", F.count("*").over(band))
    bands = rows.groupBy("r", "b").agg(F.count("*").alias("n"))
    down = Window.partitionBy("r").orderBy(F.desc("b"))
    bands = bands.select("r", "b", (F.sum("n").over(down) - F.col("n")).alias("above"), F.sum("n").over(Window.partitionBy("r")).alias("m"))
    step = F.col("raw") - F.log(F.col("m") / (F.col("place") + F.col("above")))
    # Adjusted probabilities never rise with the rank: the least of this one and all weaker ones,
    # which for negative logarithms is the greatest over this and all lower scores.
    stepped = placed.join(bands, ["r", "b"]).withColumn("step", step)
    inner = F.max("step").over(Window.partitionBy("r", "b").orderBy("raw"))
    tops = stepped.groupBy("r", "b").agg(F.max("step").alias("top"))
    below = Window.partitionBy("r").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("r", "b", F.max("top").over(below).alias("lower"))
    done = stepped.withColumn("inner", inner).join(tops, ["r", "b"])
    return done.select("r", "t", "k", "df", "raw", F.greatest(F.least(F.greatest("inner", "lower"), F.col("raw")), F.lit(0.0)).alias("score"))


def most_distinctive(scores: DataFrame) -> DataFrame:
    """(r, t): the term of each record with the highest raw score; ties: the rarer, then the alphabetically first."""
    best = scores.groupBy("r").agg(F.min(F.struct(-F.col("raw"), "df", "t")).alias("b"))
    return best.select("r", F.col("b.t").alias("t"))
