"""Scalar functions over text columns; all stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits of two or more characters, in order; repeats stay."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda t: F.length(t) >= 2)


def content_hash(text: Column) -> Column:
    """SHA-256 of the UTF-8 text; null for null and empty."""
    return F.when(F.length(text) > 0, F.sha2(text.cast("binary"), 256))


def snippet(text: Column, size: int = 160) -> Column:
    """White space collapsed, cut to `size` characters with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.char_length(flat) <= size, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, size)), F.lit("…")))


def predicate_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), r"\s+", "_")


def local_name(iri: Column) -> Column:
    """What follows the last # or / of an IRI."""
    return F.regexp_extract(iri, r"([^#/]*)$", 1)


def minted_iri(base: str, kind: str, key: Column) -> Column:
    """base/kind/key, the key with every character that is not safe in a name percent-encoded."""
    return F.concat(F.lit(f"{base.rstrip('/')}/{kind}/"), F.replace(F.url_encode(key.cast("string")), F.lit("+"), F.lit("%20")))


def valid_iri(iri: Column) -> Column:
    return iri.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:[^\s<>\"{}|\\^`]+$")


# Lexical forms of XML Schema datatypes.
LEXICAL = {
    "string": r"(?s)^.*$",
    "boolean": r"^(true|false|1|0)$",
    "integer": r"^[+-]?[0-9]+$",
    "long": r"^[+-]?[0-9]+$",
    "int": r"^[+-]?[0-9]+$",
    "short": r"^[+-]?[0-9]+$",
    "nonNegativeInteger": r"^(\+?[0-9]+|-0+)$",
    "positiveInteger": r"^\+?0*[1-9][0-9]*$",
    "decimal": r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$",
    "double": r"^([+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|[+-]?INF|NaN)$",
    "float": r"^([+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|[+-]?INF|NaN)$",
    "date": r"^-?[0-9]{4,}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])(Z|[+-][0-9]{2}:[0-9]{2})?$",
    "dateTime": r"^-?[0-9]{4,}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])T(([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]+)?|24:00:00(\.0+)?)(Z|[+-][0-9]{2}:[0-9]{2})?$",
    "anyURI": r"^\S+$",
}


_SIZED = {"long": "bigint", "int": "int", "short": "smallint"}


def valid_literal(value: Column, datatype: Column) -> Column:
    """Whether a literal has the lexical form of its datatype; unlisted datatypes pass; null datatype is a string."""
    out = F.lit(True)
    for name, form in LEXICAL.items():
        ok = value.rlike(form)
        if name in _SIZED:
            ok = ok & value.try_cast(_SIZED[name]).isNotNull()
        if name in ("date", "dateTime"):
            ok = ok & F.substring(F.regexp_replace(value, "^-", ""), 1, 10).try_cast("date").isNotNull()
        out = F.when(datatype == name, ok).otherwise(out)
    return F.when(value.isNull(), F.lit(False)).otherwise(F.coalesce(out, F.lit(False)))


# Words that do not count as content of a query, and those that begin a question.
STOPWORDS = (
    "a an the is are was were be been being have has had do does did will would could should may might shall can need dare ought used "
    "to of in for on with at by from as into through during before after above below between out off over under again further then once "
    "and but or nor not so yet both each few more most other some such no only own same than too very just because if when where how "
    "what which who whom this that these those i me my we our you your he him his she her it its they them their all any every"
).split()
QUESTIONS = "how what why when where who which explain describe".split()


def route(query: Column) -> Column:
    """The search method for a query: `fulltext`, `bm25`, `vector` or `hybrid`."""
    text = F.trim(F.coalesce(query, F.lit("")))
    words = tokens(text)
    n = F.size(words)
    content = F.size(F.filter(words, lambda w: ~w.isin(STOPWORDS)))
    question = F.coalesce(F.try_element_at(words, F.lit(1)).isin(QUESTIONS), F.lit(False)) | text.endswith("?")
    return (
        F.when(text == "", "hybrid")
        .when(text.rlike('"[^"]+"') | text.rlike(r"\b(AND|OR|NOT)\b"), "fulltext")
        .when((content <= 2) & ((n == 0) | (1 - content / n < 0.4)), "bm25")
        .when((n >= 8) | (question & (n >= 4)), "vector")
        .otherwise("hybrid")
    )


def glob_like(glob: str) -> str:
    """A usetype glob (* any run, ? one character) as a LIKE pattern with \\ as escape."""
    return "".join({"*": "%", "?": "_"}.get(c, "\\" + c if c in "%_\\" else c) for c in glob)


def matches_globs(usetype: Column, globs: str | list[str]) -> Column:
    """True where one of the globs matches; null usetypes never do. Empty and repeated globs are errors."""
    parts = [g.strip() for g in globs.split(",")] if isinstance(globs, str) else list(globs)
    if not parts or any(not g for g in parts) or len(set(parts)) < len(parts):
        raise ValueError(f"empty or repeated glob in {globs!r}")
    exact = [g for g in parts if not set(g) & set("*?")]
    out = usetype.isin(exact) if exact else F.lit(False)
    for g in parts:
        if g not in exact:
            out = out | usetype.like(glob_like(g))
    return F.coalesce(out, F.lit(False))


def not_excluded(usetype: Column, globs: list[str]) -> Column:
    """True for all but the excluded usetypes; null is never excluded."""
    return usetype.isNull() | ~matches_globs(usetype, globs) if globs else F.lit(True)


EXCLUDED = ["entity", "entities", "summary", "derived"]


def usetype_gate(usetype: Column, wanted: str | list[str] | None = None, excluded: list[str] | None = None) -> Column:
    """A positive filter disables the exclusion; an explicit exclusion list holds as given; else the default one."""
    if wanted is not None:
        return matches_globs(usetype, wanted)
    return not_excluded(usetype, EXCLUDED if excluded is None else excluded)


def canonical_cell(value: Column) -> Column:
    """A cell's text as compared: whole floats as integers, midnight timestamps as dates, booleans in capitals, blank as null."""
    v = F.trim(value)
    return (
        F.when(F.lower(v).isin("true", "false"), F.upper(v))
        .when(v.rlike(r"^[+-]?\d+\.0+$"), F.regexp_replace(v, r"\.0+$", ""))
        .when(v.rlike(r"^\d{4}-\d{2}-\d{2}[ T]00:00:00(\.0+)?$"), F.substring(v, 1, 10))
        .when(v != "", v)
    )


def cell_kind(value: Column) -> Column:
    return canonical_kind(canonical_cell(value))


def canonical_kind(v: Column) -> Column:
    """The kind of a cell as canonical_cell gives it."""
    return (
        F.when(v.isNull(), "empty")
        .when(v.isin("TRUE", "FALSE"), "bool")
        .when(v.rlike(r"^[+-]?(\d+(\.\d+)?|\.\d+)([eE][+-]?\d+)?$"), "number")
        .when(v.rlike(r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?$"), "date")
        .otherwise("text")
    )
