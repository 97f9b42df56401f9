"""Rendering of {{name}} templates from a map column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _names(template: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(template, F.lit(r"\{\{\s*([\w.]+)\s*\}\}"), F.lit(1)), F.trim))


def missing(template: Column, values: Column) -> Column:
    """Names that the template uses and the map does not hold, in order."""
    return F.array_except(_names(template), F.map_keys(values))


def render(template: Column, values: Column) -> Column:
    """The template with known names replaced, null values as nothing; unknown names stay."""
    even = F.regexp_replace(template, r"\{\{\s*([\w.]+)\s*\}\}", "{{$1}}")
    return F.aggregate(F.map_entries(values), even, lambda s, e: F.replace(s, F.concat(F.lit("{{"), e["key"], F.lit("}}")), F.coalesce(e["value"], F.lit(""))))
