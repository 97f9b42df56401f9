"""Splitting oversized items at natural boundaries, by a recursive hierarchy of separators.

A text is cut at section headings; what is still too long at blank lines, then at sentence
ends, then at white space, and only then between characters. The units are packed greedily
into pieces under the limit, and every piece begins with the last characters of the one before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyroot.operators.current import in_force
from tallyroot.work import Workspace

# Abbreviations whose full stop does not end a sentence.
ABBREVIATIONS = "Mr Mrs Ms Dr Prof Sr Jr St vs e.g i.e cf No Nr Fig Vol pp al approx ca bzw z.B d.h p.ex Sra Dott".split()
_short = "|".join(map(regex.escape, ABBREVIATIONS))
#: Where a unit ends, from coarse to fine: before a heading or a form feed, after a blank line, a sentence, a word.
#: Full-width stops end sentences without white space behind them; initials and abbreviations end none.
LEVELS = (
    regex.compile(r"\n(?=#{1,6}[ \t]|\f)|\f"),
    regex.compile(r"\n[ \t\r]*\n\s*"),
    regex.compile(rf"""(?:(?<!\b(?:{_short}|\p{{Lu}}))\.|[!?…]|\.(?=[.!?…]))[.!?…]*["'”’»)\]]*\s+|[。！？｡]+["'”’»)\]」』）]*\s*"""),
    regex.compile(r"\s+"),
)


def units(text: str, start: int, end: int, fits: Callable[[int, int], bool], level: int = 0) -> Iterator[int]:
    """Ends of consecutive units of text[start:end], all of which fit or are single characters."""
    if fits(start, end):
        yield end
    elif level == len(LEVELS):
        yield from range(start + 1, end + 1)  # single characters, so that pieces of an unbroken text are full
    else:
        at = start
        for m in LEVELS[level].finditer(text, start, end):
            if m.end() < end and m.end() > at:
                yield from units(text, at, m.end(), fits, level + 1)
                at = m.end()
        yield from units(text, at, end, fits, level + 1)


def split(text: str, limit: int, overlap: int, tokens: np.ndarray | None = None, most: float = 0) -> list[tuple[int, int]]:
    """(start, end) of the pieces: each at most `limit` long, each starting `overlap` before the last one's end.

    Without the overlaps the pieces are the text, whole and in order. A piece must add
    something, so an overlap of `limit` or more is one of limit - 1. tokens: how many tokens
    stand before each place of the text and its end, not falling; then no piece has more than
    `most` of them either, and an overlap that alone could hold more than half of these is halved until it cannot.
    """
    limit = max(1, limit)
    overlap = max(0, min(overlap, limit - 1))
    if tokens is None:
        most, within = 0, lambda a, b, room: True
        lap = 0.0
    else:
        within = lambda a, b, room: tokens[b] - tokens[a] <= room
        densest = lambda n: float((tokens[n:] - tokens[: len(tokens) - n]).max())
        overlap = min(overlap, len(text))
        while (lap := densest(overlap)) > most / 2:
            overlap //= 2
    if len(text) <= limit and within(0, len(text), most):
        return [(0, len(text))]
    pieces, start, end = [], 0, 0
    for stop in units(text, 0, len(text), lambda a, b: b - a <= limit - overlap and within(a, b, most - lap)):
        if end > start and (stop - start > limit or not within(start, stop, most)):
            pieces.append((start, end))
            start = max(end - overlap, start)
        end = stop
    pieces.append((start, end))
    return pieces


def token_places(text: str, tokens: list[tuple[int, str | None]], n: int) -> np.ndarray | None:
    """How many of a text's n tokens stand before each place, from the kept ones (index, text); null where they cannot be placed.

    Kept tokens are looked for in order, once from the front and once from the back; each
    stands in the middle of its two places, and the others are spread evenly between.
    """
    low = text.lower() if len(text.lower()) == len(text) else text
    known = [(i, t.strip() if t.strip() in text else t.strip().lower()) for i, t in tokens if t and t.strip()]
    front, at = [], 0
    for _, t in known:
        found = max(text.find(t, at), -1)
        found = low.find(t, at) if found < 0 else found
        if found < 0:
            return None
        front.append(found)
        at = found + len(t)
    back, at = [], len(text)
    for _, t in reversed(known):
        found = text.rfind(t, 0, at)
        found = low.rfind(t, 0, at) if found < 0 else found
        if found < 0:
            return None
        back.append(found)
        at = found
    if not known:
        return None
    places = [0.0, *[(a + b) / 2 for a, b in zip(front, reversed(back))], float(len(text))]
    counts = [0.0, *[float(i) for i, _ in known], float(n)]
    return np.maximum.accumulate(np.interp(np.arange(len(text) + 1), places, counts))


COLUMNS = ["id", "piece", "pieces", "unit", "start", "stop", "text"]
PIECES = "id long, piece int, pieces int, unit string, start long, stop long, text string"


def _cut(batches):
    for frame in batches:
        out = []
        for key, text, chars, most, overlap, n, kept in zip(frame["id"], frame["text"], frame["max_chars"], frame["max_tokens"], frame["overlap_chars"], frame["n_tokens"], frame["kept"]):
            text = text if isinstance(text, str) else ""
            n, most, overlap = int(n), int(most), int(overlap)
            kept = [] if kept is None else sorted({(int(t["token_idx"]), t["token_text"]) for t in kept if t["token_idx"] is not None}, key=lambda t: t[0])
            limit = int(min(chars, max(len(text), 1)))
            if n > most and len(text) > 1 and most > 0:
                places = token_places(text, kept, n)
                spans = split(text, limit, overlap, np.linspace(0, n, len(text) + 1) if places is None else places, most)
            else:
                spans = split(text, limit, overlap) if text else []
            if len(spans) > 1:
                out += [(key, i, len(spans), "char", a, b, text[a:b]) for i, (a, b) in enumerate(spans)]
            else:  # tokens of a node without a text that could be cut
                most = max(1, most)
                sizes = [len(t) for _, t in kept if t]
                lap = min(most - 1, -(-overlap * len(sizes) // sum(sizes))) if sum(sizes) else 0
                starts = range(0, max(n - lap, 1), most - lap)
                out += [(key, i, len(starts), "token", a, min(a + most, n), None) for i, a in enumerate(starts)]
            if len(out) > 5000:
                yield pd.DataFrame(out, columns=COLUMNS)
                out = []
        if out:
            yield pd.DataFrame(out, columns=COLUMNS)


def split_nodes(nodes: DataFrame, tokens: DataFrame, limits: DataFrame) -> DataFrame:
    """(id, piece, pieces, unit, start, stop, text): the pieces of every node above a limit of its usetype.

    A node is too long if its content has more than `max_chars` characters (code points), or if
    it has a token with a `token_idx` of `max_tokens` or more. The limits of usetype `*` hold
    for null and unlisted usetypes; a null limit does not limit; without a row `*`, unlisted
    usetypes are not limited. Pieces are numbered from 0; start and stop are characters of the
    content. A node with too many tokens is cut so that no piece has more than `max_tokens` by
    the places of its kept tokens in the content, or, where these do not stand there in order,
    with tokens spread evenly. If it has no content to cut, its pieces are ranges of token_idx
    (unit `token`, text null) that share as many tokens as `overlap_chars` are by the mean
    length of the kept ones. Of repeated rows of a node the one in force counts; tokens of nodes
    that are gone are ignored; extra columns are not read. Only texts above a limit, and their
    tokens, reach Python.

    `limits` is a configuration of a few rows; more than 10,000 are refused.
    """
    spark = nodes.sparkSession
    work = Workspace(spark, "splitting")
    few = limits.select("usetype", "max_chars", "max_tokens", "overlap_chars").where("usetype is not null").limit(10_001).collect()
    if len(few) > 10_000:
        raise ValueError("more than 10,000 limits")
    far = (1 << 62) - 1
    rows = {r.usetype: (r.usetype, far if r.max_chars is None else r.max_chars, far if r.max_tokens is None else r.max_tokens, r.overlap_chars or 0) for r in few}
    other = rows.pop("*", ("*", far, far, 0))
    table = F.broadcast(spark.createDataFrame(list(rows.values()), "_u string, _c long, _t long, _o long"))
    last = tokens.where("document_id is not null").groupBy("document_id").agg((F.max("token_idx") + 1).cast("long").alias("n_tokens"))
    least = min([other[2]] + [r[2] for r in rows.values()])
    last = last.where(F.col("n_tokens") > least)  # others cannot be above any limit
    cur = in_force(nodes, "id", "updated_at", ["usetype", "content"])
    cur = cur.join(last, cur.id == last.document_id, "left").drop("document_id").join(table, F.col("usetype") == F.col("_u"), "left")
    limited = cur.select(
        F.col("id").cast("long").alias("id"),
        F.col("content").alias("text"),
        F.coalesce("_c", F.lit(other[1])).alias("max_chars"),
        F.coalesce("_t", F.lit(other[2])).alias("max_tokens"),
        F.coalesce("_o", F.lit(other[3])).alias("overlap_chars"),
        F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"),
    )
    over = work.keep(limited.where("char_length(text) > max_chars or n_tokens > max_tokens"))
    dense = over.where("n_tokens > max_tokens").select(F.col("id").alias("document_id"))
    kept = tokens.select(F.col("document_id").cast("long").alias("document_id"), "token_idx", "token_text").join(dense, "document_id", "left_semi")
    kept = kept.groupBy(F.col("document_id").alias("id")).agg(F.collect_set(F.struct("token_idx", "token_text")).alias("kept"))
    return over.join(kept, "id", "left").mapInPandas(_cut, PIECES)


def split_ids(pieces: DataFrame) -> DataFrame:
    """(id): the nodes that were cut."""
    return pieces.where("piece = 1").select("id")
