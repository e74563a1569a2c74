"""Tables on disk: versions, partitions, agent folders, exports, digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_version(df: DataFrame, base: str, version: str) -> str:
    """Replace a whole table by writing a new version folder; the commit protocol makes the files
    visible at once, so readers of older versions are undisturbed."""
    path = f"{base}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def write_decisions(df: DataFrame, path: str, partitions: Sequence[str] = ("run", "baseline", "c_min")) -> None:
    """One table for all runs, baselines and constraints; each is a partition, found by pruning."""
    df.write.mode("append").partitionBy(*partitions).parquet(path)


def read_agent_responses(spark: SparkSession, path: str) -> DataFrame:
    """Responses of all agents; the agent comes from the folder name ``agent_id=...``."""
    return spark.read.parquet(path)


def available_constraints(decisions: DataFrame) -> DataFrame:
    """Constraints for which decisions are stored; answered from partition values."""
    return decisions.select("c_min").distinct()


def export_items_csv(df: DataFrame, path: str) -> None:
    """Item-level export, sorted by agent, constraint, fold and item over all part files."""
    df.orderBy("agent_id", "c_min", "fold_k", "item_id").write.option("header", True).csv(path)


def content_digest(df: DataFrame, key: str, text: str, buckets: int = 256) -> DataFrame:
    """(bucket, n, digest): digest of the sums of the row digests of each key bucket.

    Buckets and sums do not depend on file layout or row order, so equal content gives equal digests.
    A row's SHA-256 counts as four numbers of 60 bits, and each is summed exactly: a bucket is four
    running sums, whatever its rows.
    """
    row = F.sha2(F.concat_ws("\n", F.col(key).cast("string"), F.col(text)), 256)
    bucket = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("bigint") % buckets
    rows = df.select(bucket.alias("bucket"), row.alias("h"))
    parts = [F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(19,0)") for i in range(4)]
    sums = F.concat_ws(",", *[F.sum(p).cast("string") for p in parts])
    return rows.groupBy("bucket").agg(F.count("*").alias("n"), F.sha2(sums, 256).alias("digest"))
