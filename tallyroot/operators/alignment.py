"""Placing known pieces in a text, in order: outline titles and blocks of another rendition."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyroot.work import ship


def fold(text: str) -> tuple[str, list[int]]:
    """Compatibility-composed, case-folded letters and digits only, and where each came from."""
    out, at = [], []
    for i, c in enumerate(text):
        for x in unicodedata.normalize("NFKC", c).casefold():
            if x.isalnum():
                out.append(x)
                at.append(i)
    return "".join(out), at


def place_titles(text: str, titles: list[str]) -> list[int | None]:
    """Where each title stands in the text, each after the one before; null where it is not found."""
    flat, at = fold(text)
    start, out = 0, []
    for title in titles:
        key = fold(title or "")[0]
        found = flat.find(key, start) if key else -1
        out.append(at[found] if found >= 0 else None)
        if found >= 0:
            start = found + len(key)
    return out


def align_blocks(source: list[str], target: list[str], window: int = 400, prefix: int = 16) -> list[int | None]:
    """For each source block the target block that it matches, never going back.

    A match is an equal folded text, or a common beginning of at least `prefix` characters; of
    the next `window` target blocks the first equal one counts, else the first with the longest common beginning.
    """
    folded = [fold(t)[0] for t in target]
    out, start = [], 0
    for block in source:
        key, best, size = fold(block)[0], None, prefix - 1
        if key:
            for j in range(start, min(start + window, len(folded))):
                other = folded[j]
                if other == key:
                    best = j
                    break
                n = 0
                for x, y in zip(key, other):
                    if x != y:
                        break
                    n += 1
                if n > size:
                    best, size = j, n
        out.append(best)
        if best is not None:
            start = best + 1
    return out


def similarity(a: str, b: str) -> float:
    """Ratcliff-Obershelp similarity of two folded names."""
    return difflib.SequenceMatcher(None, (a or "").casefold(), (b or "").casefold(), autojunk=False).ratio()


def name_similarity(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with `similarity` of two name columns."""
    ship(pairs.sparkSession)
    ratio = F.pandas_udf(lambda x, y: pd.Series([similarity(p, q) for p, q in zip(x, y)], dtype="float64"), "double")
    return pairs.withColumn("similarity", ratio(F.col(a), F.col(b)))


def split_outline(docs: DataFrame, key: str, text: str, titles: str) -> DataFrame:
    """(key, section, title, start, body): documents cut at the titles that are found in order; what comes before the first has no title.

    Titles that are not found are left out of the cut. Null texts give nothing.
    """
    ship(docs.sparkSession)
    kinds = dict(docs.dtypes)

    def run(batches):
        for frame in batches:
            rows = []
            for k, t, names in zip(frame[key], frame[text], frame[titles]):
                if not isinstance(t, str):
                    continue
                names = [] if names is None else list(names)
                cuts = [(at, n) for at, n in zip(place_titles(t, names), names) if at is not None]
                cuts = ([] if cuts and cuts[0][0] == 0 else [(0, None)]) + cuts
                for i, (at, n) in enumerate(cuts):
                    stop = cuts[i + 1][0] if i + 1 < len(cuts) else len(t)
                    rows.append((k, i, n, at, t[at:stop]))
            yield pd.DataFrame(rows, columns=[key, "section", "title", "start", "body"])

    return docs.select(key, text, titles).mapInPandas(run, f"{key} {kinds[key]}, section int, title string, start long, body string")
