"""Names, query callables and the reference SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terraflow.sources import views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, check: str | None = None, recursive: bool = False):
    """Register ``fn(spark, sf_dir)`` under ``name`` with its checking SQL.

    ``check`` may use every view of :mod:`terraflow.sources.views`; the needed
    definitions are put in front as common table expressions.
    """

    def wrap(fn: Query) -> Query:
        QUERIES[name] = fn
        if check is not None:
            ORACLES[name] = views.with_views(check, recursive=recursive)
        return fn

    return wrap
