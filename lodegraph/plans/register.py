"""Registration of queries beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import Fixtures, with_clause

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *fixtures: str, extra: str = "") -> Callable:
    """Register a function of :class:`Fixtures` under its name. ``sql`` is the body after the fixtures' common table
    expressions; ``extra`` are more of these, recursive ones too."""

    def wrap(make: Callable[[Fixtures], DataFrame]) -> Callable[[Fixtures], DataFrame]:
        QUERIES[make.__name__] = lambda spark, sf_dir: make(Fixtures(spark, sf_dir))
        if sql is not None:
            head = with_clause(fixtures, bool(extra)) if fixtures else ("WITH RECURSIVE " if extra else "")
            ORACLES[make.__name__] = head + (",\n" if fixtures and extra else "") + extra + "\n" + sql
        return make

    return wrap
