"""Stratified bootstrap by replica weights, never by copies of rows.

Rows are first compressed to cells (stratum and the columns that a statistic reads) with counts.
Resampling n_s rows with replacement from a stratum is the same as drawing a multinomial vector of
cell counts, so each cell gets an array of integer weights per block of replicas.  The draw has two
levels so that it is spread over tasks: how many of a stratum's picks fall into each hash bucket of
its cells, and, inside a bucket, how the bucket's picks spread over its cells.  Both use generators
seeded by (seed, stratum, block, bucket), so a retried task draws the same numbers.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorate.functions.stats import normal_cdf, normal_quantile
from quorate.operators.prefix import running_totals
from quorate.session import materialise

# Replicas drawn at once and cells that a draw holds: a task has so many weights whatever the replicas and the data.
REPLICA_BLOCK = 1000
BUCKET_CELLS = 2048


def _stratum_seed(value: object) -> int:
    return zlib.crc32(str(value).encode())


def compress(df: DataFrame, stratum: str | None, columns: Sequence[str]) -> DataFrame:
    """(_s, columns, _n): distinct cells with row counts."""
    s = F.lit("all") if stratum is None else F.coalesce(F.col(stratum).cast("string"), F.lit("null"))
    return df.groupBy(s.alias("_s"), *columns).agg(F.count("*").alias("_n"))


def bucketed(cells: DataFrame, columns: Sequence[str], buckets: int) -> DataFrame:
    """``cells`` with the bucket ``_b`` of each."""
    return cells.withColumn("_b", F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int"))


def block_starts(replicas: int, block: int) -> Column:
    return F.sequence(F.lit(0), F.lit(replicas - 1), F.lit(block))


def bucket_picks(keyed: DataFrame, replicas: int, seed: int, block: int) -> DataFrame:
    """(_s, _b, _first, _order, _picks): picks of a stratum that fall into each bucket in the replicas of a block, one row a bucket.

    The numbers of a stratum's buckets are split once for each block; cells do not carry them.
    """
    totals = keyed.groupBy("_s", "_b").agg(F.sum("_n").alias("_bn"))
    shape = totals.groupBy("_s").agg(F.array_sort(F.collect_list(F.struct("_b", "_bn"))).alias("_shape"))
    shape = shape.select("_s", F.col("_shape._b").alias("_buckets"), F.col("_shape._bn").alias("_sizes"), F.explode(block_starts(replicas, block)).alias("_first"))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for s, listed, sizes, first in zip(pdf["_s"], pdf["_buckets"], pdf["_sizes"], pdf["_first"].tolist()):
                sizes = np.asarray(sizes, dtype=np.int64)
                rng = np.random.default_rng([seed, _stratum_seed(s), first, 0])
                picks = rng.multinomial(int(sizes.sum()), sizes / sizes.sum(), size=min(block, replicas - first))
                yield pd.DataFrame({"_s": s, "_b": listed, "_first": first, "_order": np.arange(len(sizes)), "_picks": list(picks.T)})

    return shape.mapInPandas(split, "_s string, _b int, _first int, _order int, _picks array<bigint>")


def bucket_weights(seed: int, stratum: str, first: int, order: int, picks: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(replica, cell): how the picks of a bucket spread over its cells."""
    rng = np.random.default_rng([seed, _stratum_seed(stratum), first, 1 + order])
    return rng.multinomial(np.asarray(picks, dtype=np.int64), counts / counts.sum())


def replica_weights(
    cells: DataFrame,
    columns: Sequence[str],
    replicas: int,
    seed: int = 42,
    buckets: int | None = None,
    block: int = REPLICA_BLOCK,
) -> DataFrame:
    """(_s, columns, _n, _first, _w): weights of replicas _first, _first + 1, ... per cell.

    A draw is one (stratum, bucket of cells, block of replicas); there are as many buckets as the
    number of cells asks for. All buckets of a block draw the same split of the picks over buckets.
    """
    if replicas < 100:
        raise ValueError("at least 100 replicas are needed")
    if buckets is None:
        cells = materialise(cells)
        buckets = max(1, -(-cells.count() // BUCKET_CELLS))
    keyed = bucketed(cells, columns, buckets)
    shaped = keyed.withColumn("_first", F.explode(block_starts(replicas, block)))
    kept = ["_s", *columns, "_n"]
    fields = {f.name: f.dataType.simpleString() for f in shaped.schema}
    schema = ", ".join(f"`{c}` {fields[c]}" for c in kept) + ", _first int, _w array<int>"

    def draw(pdf: pd.DataFrame, split: pd.DataFrame) -> pd.DataFrame:
        first = int(split["_first"].iloc[0])
        pdf = pdf.sort_values(list(columns), kind="mergesort")
        weights = bucket_weights(seed, split["_s"].iloc[0], first, int(split["_order"].iloc[0]), split["_picks"].iloc[0], pdf["_n"].to_numpy(dtype=np.int64))
        return pdf[kept].assign(_first=np.int32(first), _w=list(weights.T.astype(np.int32)))

    group = ["_s", "_b", "_first"]
    picks = bucket_picks(keyed, replicas, seed, block)
    return shaped.groupBy(*group).cogroup(picks.groupBy(*group)).applyInPandas(draw, schema)


def replica_rows(weights: DataFrame) -> DataFrame:
    """One row per (cell, replica) with a positive weight; partial sums follow in the same task."""
    kept = [c for c in weights.columns if c not in ("_first", "_w")]
    exploded = weights.select(*kept, "_first", F.posexplode("_w").alias("_i", "w"))
    return exploded.where("w > 0").select(*kept, (F.col("_first") + F.col("_i")).alias("replica"), "w")


def replicate(
    df: DataFrame,
    stratum: str | None,
    columns: Sequence[str],
    statistics: dict[str, Column],
    replicas: int,
    seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """Point estimates (one row) and replica values of statistics written over the weight ``w``."""
    cells = compress(df, stratum, columns)
    aggs = [c.alias(name) for name, c in statistics.items()]
    point = cells.withColumn("w", F.col("_n")).agg(*aggs)
    rows = replica_rows(replica_weights(cells, columns, replicas, seed))
    return point, rows.groupBy("replica").agg(*aggs)


def percentile_interval(values: DataFrame, names: Sequence[str], level: float = 0.95) -> DataFrame:
    """(statistic, ci_lo, ci_hi, n_resamples, n_dropped); replicas without a value are dropped."""
    if not 0.0 < level < 1.0:
        raise ValueError("the confidence level must lie in (0, 1)")
    tail = (1.0 - level) / 2.0
    long = values.unpivot(["replica"], list(names), "statistic", "value")
    clean = F.nanvl("value", F.lit(None).cast("double"))
    q = F.percentile(clean, F.array(F.lit(tail), F.lit(1.0 - tail)))
    return (
        long.groupBy("statistic")
        .agg(q.alias("q"), F.count("*").alias("n_resamples"), F.count_if(clean.isNull()).alias("n_dropped"))
        .select(
            "statistic",
            F.col("q")[0].alias("ci_lo"),
            F.col("q")[1].alias("ci_hi"),
            "n_resamples",
            "n_dropped",
        )
        .where(F.col("n_dropped") * 2 <= F.col("n_resamples"))
    )


def interval_table(
    df: DataFrame,
    stratum: str | None,
    columns: Sequence[str],
    statistics: dict[str, Column],
    replicas: int = 10_000,
    level: float = 0.95,
    seed: int = 42,
) -> DataFrame:
    """Point and percentile interval per statistic; a statistic without value or with more than
    half of its replicas dropped has null bounds."""
    point, values = replicate(df, stratum, columns, statistics, replicas, seed)
    names = list(statistics)
    points = point.unpivot([], names, "statistic", "point")
    return points.join(percentile_interval(values, names, level), "statistic", "left")


def weighted_mean(value: Column) -> Column:
    return F.sum(F.col("w") * value) / F.sum("w")


def weighted_ratio(num: Column, den: Column) -> Column:
    """Weighted sum of ``num`` over weighted sum of ``den``; null when there is nothing below."""
    return F.try_divide(F.sum(F.col("w") * num).cast("double"), F.sum(F.col("w") * den).cast("double"))


def paired_delta(
    df: DataFrame, a: str, b: str, stratum: str | None, replicas: int = 10_000, seed: int = 42
) -> DataFrame:
    """Means of two paired columns, the mean of b - a with its interval, and whether it holds 0."""
    stats = {
        "mean_a": weighted_mean(F.col(a)),
        "mean_b": weighted_mean(F.col(b)),
        "delta": weighted_mean(F.col(b) - F.col(a)),
    }
    point, values = replicate(df, stratum, [a, b], stats, replicas, seed)
    bounds = percentile_interval(values, ["delta"]).select("ci_lo", "ci_hi", "n_resamples")
    one = F.lit(1).alias("_k")
    return (
        point.select("*", one)
        .join(bounds.select("*", one), "_k")
        .drop("_k")
        .withColumn("includes_zero", (F.col("ci_lo") <= 0) & (F.col("ci_hi") >= 0))
    )


def bca_interval(
    df: DataFrame,
    stratum: str | None,
    columns: Sequence[str],
    ratios: dict[str, tuple[Column, Column]],
    replicas: int = 10_000,
    level: float = 0.95,
    seed: int = 42,
) -> DataFrame:
    """Bias-corrected and accelerated interval of ratios of sums.

    Leaving one row of a cell out only subtracts that cell's terms from two totals, so the jackknife
    is one pass over cells weighted by their counts.
    """
    cells = compress(df, stratum, columns)
    names = list(ratios)
    aggs = [weighted_ratio(n, d).alias(name) for name, (n, d) in ratios.items()]
    sums = cells.agg(
        F.array(
            *[
                F.struct(
                    F.lit(k).alias("statistic"),
                    F.sum(F.col("_n") * n).cast("double").alias("num"),
                    F.sum(F.col("_n") * d).cast("double").alias("den"),
                )
                for k, (n, d) in ratios.items()
            ]
        ).alias("t")
    )
    points = sums.select(F.inline("t")).withColumn("point", F.try_divide("num", "den"))

    parts = F.array(
        *[
            F.struct(F.lit(k).alias("statistic"), n.cast("double").alias("a"), d.cast("double").alias("b"))
            for k, (n, d) in ratios.items()
        ]
    )
    loo = (
        cells.select("_n", F.inline(parts))
        .join(F.broadcast(points), "statistic")
        .withColumn("theta", F.try_divide(F.col("num") - F.col("a"), F.col("den") - F.col("b")))
        .where(F.col("theta").isNotNull())
        .groupBy("statistic", "theta")
        .agg(F.sum("_n").alias("m"))
    )
    centre = loo.groupBy("statistic").agg(
        (F.sum(F.col("theta") * F.col("m")) / F.sum("m")).alias("centre")
    )
    gap = F.col("centre") - F.col("theta")
    accel = (
        loo.join(F.broadcast(centre), "statistic")
        .groupBy("statistic")
        .agg(
            F.sum(F.col("m") * gap * gap * gap).alias("cube"),
            F.sum(F.col("m") * gap * gap).alias("square"),
        )
        .withColumn("den6", F.lit(6.0) * F.pow("square", F.lit(1.5)))
        .select(
            "statistic",
            F.when(F.col("den6") != 0, F.col("cube") / F.col("den6")).otherwise(0.0).alias("acceleration"),
        )
    )

    weights = replica_rows(replica_weights(cells, columns, replicas, seed))
    values = weights.groupBy("replica").agg(*aggs).unpivot(["replica"], names, "statistic", "value")
    kept = values.where(F.col("value").isNotNull()).join(
        F.broadcast(points.select("statistic", "point")), "statistic"
    )
    spread = kept.groupBy("statistic", "point").agg(
        F.count("*").alias("n_valid"),
        F.avg((F.col("value") < F.col("point")).cast("double")).alias("below"),
        F.array_sort(F.collect_list("value")).alias("sorted"),
    )
    tail = (1.0 - level) / 2.0
    eps = F.lit(0.5) / F.col("n_valid")
    z0 = normal_quantile(F.greatest(F.least("below", F.lit(1.0) - eps), eps))
    out = spread.join(accel, "statistic").withColumn("z0", z0)

    def adjusted(p: float) -> Column:
        z = F.col("z0") + normal_quantile(F.lit(p))
        return normal_cdf(F.col("z0") + z / (F.lit(1.0) - F.col("acceleration") * z))

    def quantile_of(p: Column) -> Column:
        """Linear interpolation in the sorted replicas (B numbers per statistic)."""
        position = p * (F.col("n_valid") - 1)
        lower = F.floor(position)
        low = F.element_at("sorted", (lower + 1).cast("int"))
        high = F.element_at("sorted", F.least(lower + 2, F.col("n_valid")).cast("int"))
        return low + (high - low) * (position - lower)

    return (
        out.withColumn("p_lo", adjusted(tail))
        .withColumn("p_hi", adjusted(1.0 - tail))
        .where(F.col("n_valid") * 2 >= replicas)
        .select(
            "statistic",
            "point",
            quantile_of(F.col("p_lo")).alias("ci_lo"),
            quantile_of(F.col("p_hi")).alias("ci_hi"),
            "acceleration",
            (F.lit(replicas) - F.col("n_valid")).alias("n_dropped"),
        )
    )


def kappa_columns() -> dict[str, Column]:
    """Cohen's kappa of the 0/1 columns ``a`` and ``b`` as an aggregate over the weight ``w``."""
    n = F.sum("w").cast("double")
    agree = F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0)) / n
    pa = F.sum(F.col("w") * F.col("a")) / n
    pb = F.sum(F.col("w") * F.col("b")) / n
    chance = pa * pb + (F.lit(1.0) - pa) * (F.lit(1.0) - pb)
    return {"kappa": F.try_divide(agree - chance, F.lit(1.0) - chance)}


# Kinds of rows that the audit metrics tell apart: label, refusal, its verdict and sufficiency of the context.
KINDS = 2 * 2 * 8 * 8


def _kind(z: Column, refusal: Column, verdict: Column, context: Column) -> Column:
    """One number for the labels of a row; verdict and sufficiency from -1 to 5, or null. Odd for label 1."""
    small = lambda c: F.coalesce(c + 2, F.lit(0))
    return (z + 2 * refusal.cast("int") + 4 * small(verdict) + 32 * small(context)).cast("int")


def _of_kind(kind: Column) -> list[Column]:
    digit = lambda by: F.floor(kind / by) % 8
    back = lambda d: F.when(d > 0, d - 2).cast("int")
    return [
        (kind % 2).cast("int").alias("z_winner"),
        (F.floor(kind / 2) % 2 == 1).alias("textual_refusal"),
        back(digit(4)).alias("refusal_verdict"),
        back(digit(32)).alias("context_sufficiency"),
    ]


# Half width, in square roots of the number of rows, of the band around a coverage's cut inside which scores stay apart. The weight above
# a score varies by half such a root at most, so one replica in some 10^13 leaves the band; that is noticed, and the band doubled.
MARGIN = 4.0


def far_merged(cells: DataFrame, curves: dict, coverages: Sequence[float], total: int, margin: float) -> DataFrame:
    """``cells`` with one score for all levels of a curve that lie between the same cuts, more than ``margin`` rows away from each.

    Such levels are answered all or none in a replica, so the metrics need their total only. KINDS is added to their kinds.
    """
    each = F.array(*[F.struct(F.lit(v).alias("curve"), F.col(c.score).alias("score"), F.col("_n").alias("n")) for v, c in curves.items()])
    levels = cells.select(F.inline(each)).groupBy("curve", "score").agg(F.sum("n").alias("n"))
    levels = running_totals(levels, ["curve"], "score", ["n"], descending=True, bucket=F.floor(F.col("score") * 1024).cast("int"))
    # The last level ends at the total in every replica, so full coverage cuts nothing.
    cuts = [c * total for c in coverages if c < 1]
    near, zone = F.lit(False), F.lit(0)
    for cut in cuts:
        near = near | ((F.col("before_n") <= cut + margin) & (F.col("before_n") + F.col("n") >= cut - margin))
        zone = zone + (F.col("before_n") > cut).cast("int")
    zones = levels.where(~near).groupBy("curve", zone.alias("zone")).agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    for z in zones.collect():
        curve = curves[z["curve"]]
        inside = F.col(curve.score).between(z["lo"], z["hi"]) & (F.col(curve.kind) < KINDS)
        cells = cells.withColumns({curve.score: F.when(inside, F.lit(z["hi"])).otherwise(F.col(curve.score)), curve.kind: F.when(inside, F.col(curve.kind) + KINDS).otherwise(F.col(curve.kind))})
    return cells


def compress_again(cells: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``cells`` whose columns have become equal as one."""
    return cells.groupBy("_s", *columns).agg(F.sum("_n").alias("_n"))


def metric_contrasts(
    items: DataFrame,
    pairs: Sequence[tuple[str, str]],
    coverages: Sequence[float],
    metrics: Sequence[str],
    stratum: str,
    replicas: int,
    seed: int = 42,
) -> DataFrame:
    """Contrasts of audit metrics over variant pairs and coverages with shared resamples.

    A weight belongs to the joint cell of the item over all variants, so variants stay paired.  Per
    replica the response probability is recomputed from weighted score levels (``replica_curves``).
    """
    from quorate.operators.audit import decision_metrics
    from quorate.operators.replica_curves import Curve, answered, replica_values

    names = sorted({v for pair in pairs for v in pair})
    parts = ["score", "z_winner", "textual_refusal", "refusal_verdict"]
    wide = items.where(F.col("variant").isin(names)).groupBy(
        "item_id", stratum, "context_sufficiency"
    )
    wide = wide.agg(
        *[F.max(F.when(F.col("variant") == v, F.col(c))).alias(f"{v}_{c}") for v in names for c in parts]
    )
    kind = lambda v: _kind(F.col(f"{v}_z_winner"), F.col(f"{v}_textual_refusal"), F.col(f"{v}_refusal_verdict"), F.col("context_sufficiency"))
    wide = wide.select(stratum, *[F.col(f"{v}_score").alias(f"{v}_score") for v in names], *[kind(v).alias(f"{v}_kind") for v in names])
    columns = [f"{v}_{c}" for v in names for c in ("score", "kind")]
    cells = materialise(compress(wide, stratum, columns))
    total = cells.agg(F.sum("_n")).first()[0] or 0
    curves = {v: Curve(f"{v}_score", f"{v}_kind") for v in names}
    fold, width = answered(coverages, total, KINDS), MARGIN
    while True:
        drawn = compress_again(far_merged(cells, curves, coverages, total, width * math.sqrt(total)), columns)
        found = materialise(replica_values(drawn, columns, curves, fold, replicas, seed))
        if found.where(F.isnan("value")).isEmpty():
            break
        width *= 2
    found = found.select("replica", F.col("curve").alias("variant"), (F.col("key") % KINDS).alias("kind"), F.floor(F.col("key") / KINDS).alias("c"), "value")
    weights = found.where("c = 0").select("replica", "variant", "kind", F.col("value").alias("w"))
    # The metrics are linear in the answered share, so the share of a kind stands for its rows.
    listed = F.array(*[F.struct(F.lit(i + 1).alias("c"), F.lit(float(x)).alias("target_coverage")) for i, x in enumerate(coverages)])
    shares = found.where("c > 0").groupBy("replica", "variant", "kind").agg(F.map_from_entries(F.collect_list(F.struct("c", "value"))).alias("taken"))
    cellwise = weights.join(shares, ["replica", "variant", "kind"]).select("*", F.inline(listed))
    cellwise = cellwise.withColumn("p", F.when(F.col("w") > 0, F.element_at("taken", F.col("c").cast("bigint")) / F.col("w")).otherwise(0.0))
    values = decision_metrics(cellwise.select("*", *_of_kind(F.col("kind"))), F.col("p"), ["replica", "variant", "target_coverage"], F.col("w"))
    base = items.where(F.col("variant").isin(names)).groupBy(
        "variant", "context_sufficiency", *parts
    ).agg(F.count("*").alias("w"))
    points = _weighted_metrics(base, coverages, [], decision_metrics)

    delta = _contrast(values, pairs, metrics, ["replica"])
    bounds = (
        delta.groupBy("a", "b", "target_coverage", "metric")
        .agg(F.percentile("delta", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.count("*").alias("n_resamples"))
        .select("a", "b", "target_coverage", "metric", F.col("q")[0].alias("ci_lo"), F.col("q")[1].alias("ci_hi"), "n_resamples")
    )
    point = _contrast(points, pairs, metrics, []).withColumnRenamed("delta", "delta_a_minus_b")
    return point.join(bounds, ["a", "b", "target_coverage", "metric"], "left")


def point_contrasts(
    points: DataFrame,
    pairs: Sequence[tuple[str, str]],
    metrics: Sequence[str],
    stratum: str,
    replicas: int,
    seed: int = 42,
) -> DataFrame:
    """Contrasts of stored operating points (``variant``), whose answering probability
    ``p_respond`` is given per item, with shared resamples."""
    from quorate.operators.audit import decision_metrics

    names = sorted({v for pair in pairs for v in pair})
    parts = ["p_respond", "z_winner", "textual_refusal", "refusal_verdict"]
    kept = points.where(F.col("variant").isin(names))
    wide = kept.groupBy("item_id", stratum, "context_sufficiency").agg(
        *[F.max(F.when(F.col("variant") == v, F.col(c))).alias(f"{v}_{c}") for v in names for c in parts]
    )
    columns = ["context_sufficiency", *[f"{v}_{c}" for v in names for c in parts]]
    cells = compress(wide, stratum, columns)
    listed = F.array(
        *[
            F.struct(F.lit(v).alias("variant"), *[F.col(f"{v}_{c}").alias(c) for c in parts])
            for v in names
        ]
    )

    def metric_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
        long = rows.select(*keys, "w", "context_sufficiency", F.inline(listed))
        long = long.withColumn("target_coverage", F.lit(None).cast("double"))
        return decision_metrics(long, F.col("p_respond"), [*keys, "variant", "target_coverage"], F.col("w"))

    replicated = metric_rows(replica_rows(replica_weights(cells, columns, replicas, seed)), ["replica"])
    delta = _contrast(replicated, pairs, metrics, ["replica"])
    bounds = delta.groupBy("a", "b", "metric").agg(
        F.percentile("delta", F.array(F.lit(0.025), F.lit(0.975))).alias("q")
    )
    point = _contrast(metric_rows(cells.withColumnRenamed("_n", "w"), []), pairs, metrics, [])
    return point.join(bounds, ["a", "b", "metric"], "left").select(
        "a",
        "b",
        "metric",
        F.col("delta").alias("delta_a_minus_b"),
        F.col("q")[0].alias("ci_lo"),
        F.col("q")[1].alias("ci_hi"),
    )


def _weighted_metrics(compact: DataFrame, coverages, keys: list[str], decision_metrics) -> DataFrame:
    group = [*keys, "variant"]
    by_level = compact.groupBy(*group, "score").agg(F.sum("w").alias("n"))
    cum = running_totals(
        by_level, group, "score", ["n"], descending=True, bucket=F.floor(F.col("score") * 4).cast("int")
    ).withColumn("target_coverage", F.explode(F.array(*[F.lit(float(c)) for c in coverages])))
    target = F.col("target_coverage") * F.col("total_n")
    share = F.least(F.greatest((target - F.col("before_n")) / F.col("n"), F.lit(0.0)), F.lit(1.0))
    probs = cum.select(*group, "score", "target_coverage", share.alias("p"))
    joined = compact.join(probs, [*group, "score"])
    return decision_metrics(joined, F.col("p"), [*group, "target_coverage"], F.col("w"))


def _contrast(values: DataFrame, pairs, metrics, keys: list[str]) -> DataFrame:
    """Difference of each metric between the two variants of every pair, in one aggregation."""
    aggs = []
    for a, b in pairs:
        for m in metrics:
            value_a = F.max(F.when(F.col("variant") == a, F.col(m)))
            value_b = F.max(F.when(F.col("variant") == b, F.col(m)))
            aggs.append(
                F.struct(
                    F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(m).alias("metric"), (value_a - value_b).alias("delta")
                )
            )
    wide = values.groupBy(*keys, "target_coverage").agg(F.array(*aggs).alias("c"))
    return wide.select(*keys, "target_coverage", F.inline("c"))
