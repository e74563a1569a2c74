"""Resumable appends.

There are no event-time streams here; work arrives as tables and is done in instalments.  An
instalment is the anti-join of the wanted keys with the keys already stored, so repeating a failed
or finished run adds nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from quorate.operators.retrieval import query_hash


def pending(wanted: DataFrame, done: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Wanted rows whose key is not stored yet, once per key."""
    unique = wanted.dropDuplicates(list(keys))
    if done is None:
        return unique
    return unique.join(done.select(*keys).distinct(), list(keys), "left_anti")


def pending_queries(queries: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Queries without a stored pool, keyed by the hash of their text."""
    return pending(queries.withColumn("query_hash", query_hash(F.col("text"))), stored, ["query_hash"])


def stored_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at a path, or nothing before the first instalment."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return None
        raise


def append_pending(
    wanted: DataFrame, path: str, keys: Sequence[str], work: Callable[[DataFrame], DataFrame]
) -> None:
    """Do the missing part of the work and append it to the table at ``path``."""
    todo = pending(wanted, stored_table(wanted.sparkSession, path), keys)
    work(todo).write.mode("append").parquet(path)
