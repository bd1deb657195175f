"""Named queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nightledger.plans import portable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register fn(spark, sf_dir) under a name, with its oracle if SQL can
    express it."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def frames_query(name: str, sql: str | None = None, *ctes: tuple[str, str]):
    """Like query(), for fn(frames) over the portable frame table."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(portable.frames(spark, sf_dir))

        return query(name, with_frames(sql, *ctes) if sql else None)(run)

    return add


def with_ctes(sql: str, *ctes: tuple[str, str]) -> str:
    head = "WITH " + ", ".join(f"{n} AS ({s})" for n, s in ctes)
    # SQL that starts with a comma goes on with further CTEs.
    return head + sql if sql.startswith(",") else head + " " + sql


def with_frames(sql: str, *ctes: tuple[str, str]) -> str:
    return with_ctes(sql, ("frames", portable.FRAMES_SQL), *ctes)


def r6(c: Column | str, alias: str | None = None) -> Column:
    """Six decimals, so that the order of a floating sum cannot show."""
    col = F.round(c, 6)
    return col.alias(alias) if alias else col


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(F.col(n)) for n in names})


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})
