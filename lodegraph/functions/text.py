"""Text, id and rounding functions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(value: Column, places: int) -> Column:
    """Rounded half towards plus infinity, which Spark's round does not do for negative or inexact halves."""
    scale = 10.0**places
    return F.floor(value * scale + 0.5) / F.lit(scale)


def clean_id(value: Column) -> Column:
    """An identifier of letters, digits and ``_-:./`` only, runs of _ as one, at most 200 characters."""
    return F.substring(F.regexp_replace(F.regexp_replace(value, r"[^a-zA-Z0-9_\-:./]", "_"), "_+", "_"), 1, 200)


def node_id(kind: Column, identifier: Column) -> Column:
    return F.concat(kind, F.lit(":"), clean_id(identifier))


def symbol_id(kind: Column, path: Column, name: Column, line: Column | None = None) -> Column:
    parts = [path, F.lit(":"), name] + ([F.lit(":"), line.cast("string")] if line is not None else [])
    return node_id(kind, F.concat(*parts))


def edge_id(source: Column, target: Column, kind: Column) -> Column:
    return F.concat(source, F.lit("->"), target, F.lit(":"), kind)


def capital(value: Column, rest_lower: bool = True) -> Column:
    rest = F.substring(value, 2, 1_000_000)
    return F.concat(F.upper(F.substring(value, 1, 1)), F.lower(rest) if rest_lower else rest)


def any_of(value: Column, patterns: tuple[str, ...]) -> Column:
    """Whether one of the patterns is found; one alternation, so one pass of the matcher."""
    return value.rlike("|".join(f"(?:{p})" for p in patterns))


def name_prefix(name: Column) -> Column:
    """The first part of a name, as capitals and underscores part it."""
    first = F.element_at(F.split(name, "(?=[A-Z])|_"), 1)
    return F.when(first == "", name).otherwise(first)
