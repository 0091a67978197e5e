"""Named queries over the driver's tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbitra.plans.oracle import sql

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, needs: Sequence[str] = (), body: str | None = None, recursive: bool = False) -> Callable[[Query], Query]:
    """Register a query; ``body`` is its SQL over the named oracle fragments.

    A recursive body begins with common table expressions of its own, which may refer to themselves.
    """

    def add(fn: Query) -> Query:
        def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
            # Days and windows are UTC on both sides of the comparison.
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        prepared.__name__ = name
        QUERIES[name] = prepared
        if body is not None:
            ORACLE[name] = sql(needs, body, recursive)
        return fn

    return add


def r6(column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    name = column if isinstance(column, str) else None
    out = F.round(c, 6)
    return out.alias(name) if name else out


def longs(*names: str) -> list[Column]:
    return [F.col(n).cast("long").alias(n) for n in names]


def all_queries() -> tuple[dict[str, Query], dict[str, str]]:
    from arbitra.plans import (  # noqa: F401
        active_queries, evaluation_queries, judgment_queries, source_queries, topic_queries,
    )

    return dict(QUERIES), dict(ORACLE)
