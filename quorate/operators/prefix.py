"""Ordered running totals and ranks over tables of any size.

A window ordered over a whole group is one task.  Here the ordered key is first cut into buckets
that depend only on the key, the running total is taken inside each (group, bucket) task, and the
few per-bucket totals are accumulated separately and joined back on the same partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

BUCKETS = 4096


def unit_bucket(key: Column, buckets: int = BUCKETS) -> Column:
    """Equal-width bucket of a key that lies in [0, 1]; values outside go to the end buckets.

    Clamping keeps the order of buckets consistent with the order of keys, so results stay exact
    whatever the range is; only the balance depends on it.
    """
    return F.least(F.greatest(F.floor(key * buckets), F.lit(0)), F.lit(buckets - 1)).cast("int")


def digest_bucket(digest: Column) -> Column:
    """Bucket of a hex digest: its first three digits, 4096 equally likely values."""
    return F.conv(F.substring(digest, 1, 3), 16, 10).cast("int")


def levels(
    df: DataFrame, group: Sequence[str], key: str, measures: dict[str, Column]
) -> DataFrame:
    """Compress rows to one row per distinct (group, key), with map-side partial sums."""
    return df.groupBy(*group, key).agg(*[c.alias(name) for name, c in measures.items()])


def running_totals(
    df: DataFrame,
    group: Sequence[str],
    key: str,
    measures: Sequence[str],
    *,
    descending: bool = False,
    bucket: Column | None = None,
    extra_order: Sequence[Column] = (),
) -> DataFrame:
    """Add ``before_<m>`` (sum over strictly earlier rows) and ``total_<m>`` (group sum).

    ``df`` must hold one row per (group, key), or a total order through ``extra_order``.
    """
    group = list(group)
    b = "_bucket"
    keyed = df.withColumn(b, unit_bucket(F.col(key)) if bucket is None else bucket)
    direction = (lambda c: c.desc()) if descending else (lambda c: c.asc())

    inside = W.partitionBy(*group, b).orderBy(direction(F.col(key)), *extra_order)
    earlier = inside.rowsBetween(W.unboundedPreceding, -1)
    local = keyed.select(
        "*", *[F.coalesce(F.sum(m).over(earlier), F.lit(0)).alias(f"_in_{m}") for m in measures]
    )

    # One row per (group, bucket): at most BUCKETS rows per group meet in one task.
    per_bucket = keyed.groupBy(*group, b).agg(*[F.sum(m).alias(f"_b_{m}") for m in measures])
    across = W.partitionBy(*group).orderBy(direction(F.col(b)))
    before = across.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*group)
    offsets = per_bucket.select(
        *group,
        b,
        *[F.coalesce(F.sum(f"_b_{m}").over(before), F.lit(0)).alias(f"_off_{m}") for m in measures],
        *[F.sum(f"_b_{m}").over(whole).alias(f"total_{m}") for m in measures],
    )
    joined = local.join(offsets, [*group, b])
    return joined.select(
        *df.columns,
        *[(F.col(f"_in_{m}") + F.col(f"_off_{m}")).alias(f"before_{m}") for m in measures],
        *[f"total_{m}" for m in measures],
    )


def distributed_rank(
    df: DataFrame, group: Sequence[str], digest: str, tie: Sequence[str]
) -> DataFrame:
    """Add ``rank0`` (0-based) and ``group_size`` by (digest, tie) inside each group, without a
    single-task window; groups may be as few as one."""
    one = df.withColumn("_one", F.lit(1).cast("bigint"))
    ranked = running_totals(
        one,
        group,
        digest,
        ["_one"],
        bucket=digest_bucket(F.col(digest)),
        extra_order=[F.col(t) for t in tie],
    )
    return (
        ranked.withColumnRenamed("before__one", "rank0")
        .withColumnRenamed("total__one", "group_size")
        .drop("_one")
    )
