"""Registry of queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round double columns, so that sums taken in another order compare equal.

    Halves are decided in doubles, as the checking engine does, not in decimals.
    """
    unit = 10.0**digits

    def half_away(c: str) -> Column:
        x = F.col(c)
        near = F.signum(x) * F.floor(F.abs(x) * unit + 0.5).cast("double") / unit
        return F.when(F.abs(x) < 1e9, near).otherwise(F.round(x, digits)).alias(c)

    return df.select(*[half_away(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add
