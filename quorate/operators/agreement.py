"""Agreement between the automatic judge and human annotators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorate.functions.stats import clopper_pearson
from quorate.operators.bootstrap import compress, kappa_columns, percentile_interval, replica_rows, replica_weights


def judged(annotations: DataFrame) -> DataFrame:
    """Rows the annotator could judge (a negative label means "cannot tell")."""
    return annotations.where("human >= 0")


def confusion(annotations: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Counts of judge label x human label."""
    return annotations.groupBy(*group, "judge", "human").agg(F.count("*").alias("n"))


def cohen_kappa(annotations: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Kappa from the confusion table; null when chance agreement is 1."""
    group = list(group)
    cells = confusion(judged(annotations), group)
    total = cells.groupBy(*group).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("judge") == F.col("human"), F.col("n")).otherwise(0)).alias("agree")
    )
    sides = cells.select(
        *group,
        F.inline(
            F.array(
                F.struct(F.col("judge").alias("label"), F.col("n").alias("j"), F.lit(0).cast("bigint").alias("h")),
                F.struct(F.col("human").alias("label"), F.lit(0).cast("bigint").alias("j"), F.col("n").alias("h")),
            )
        ),
    )
    chance = (
        sides.groupBy(*group, "label")
        .agg(F.sum("j").alias("j"), F.sum("h").alias("h"))
        .groupBy(*group)
        .agg(F.sum(F.col("j").cast("double") * F.col("h")).alias("cross"))
    )
    if group:
        both = total.join(chance, group)
    else:
        both = total.withColumn("cross", chance.scalar())
    po = F.col("agree") / F.col("n")
    pe = F.col("cross") / (F.col("n").cast("double") * F.col("n"))
    return both.select(
        *group, "n", po.alias("observed"), pe.alias("expected"), F.try_divide(po - pe, F.lit(1.0) - pe).alias("kappa")
    )


def conditional_agreement(annotations: DataFrame) -> DataFrame:
    """Share of human labels that confirm the judge, per stratum, with an exact interval."""
    counts = judged(annotations).groupBy("stratum").agg(
        F.count("*").alias("n"), F.count_if(F.col("judge") == F.col("human")).alias("k")
    )
    return counts.withColumn("ci", clopper_pearson(F.col("k"), F.col("n"))).select(
        "stratum", "n", "k", (F.col("k") / F.col("n")).alias("agreement"), "ci.ci_lo", "ci.ci_hi"
    )


def disagreement_direction(annotations: DataFrame) -> DataFrame:
    """How often the judge was milder, and how often stricter, than the human."""
    return judged(annotations).agg(
        F.count_if((F.col("judge") == 1) & (F.col("human") == 0)).alias("judge_milder"),
        F.count_if((F.col("judge") == 0) & (F.col("human") == 1)).alias("judge_stricter"),
    )


def disagreements(annotations: DataFrame, refusal: str = "recusa") -> DataFrame:
    """Rows whose human label differs from the reference label of their stratum, or that carry a
    comment; the reference of a refusal is the auditor's verdict, else the judge's label."""
    reference = F.when(
        F.col("stratum") == refusal, F.coalesce("refusal_verdict", F.lit(-9))
    ).otherwise(F.col("judge"))
    agrees = F.when(F.col("human") >= 0, F.col("human") == reference)
    return (
        annotations.withColumn("reference", reference)
        .withColumn("agrees", agrees)
        .where((~F.col("agrees")) | (F.coalesce("comment", F.lit("")) != ""))
        .select("stratum", "item_id", "agent_id", "reference", "human", "agrees")
    )


def upsert(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Last write wins per key over the union of both tables."""
    both = stored.unionByName(incoming)
    others = [c for c in both.columns if c not in keys]
    last = F.max_by(F.struct(*others), F.struct(ts, *[c for c in others if c != ts])).alias("r")
    return both.groupBy(*keys).agg(last).select(*keys, "r.*").select(*both.columns)


def progress(draw: DataFrame, annotations: DataFrame) -> DataFrame:
    """Per stratum: drawn, annotated, judged and agreeing pairs."""
    joined = draw.join(
        annotations.select("item_id", "agent_id", "judge", "human"), ["item_id", "agent_id"], "left"
    )
    return joined.groupBy("stratum").agg(
        F.count("*").alias("drawn"),
        F.count("human").alias("annotated"),
        F.count_if(F.col("human") >= 0).alias("judged"),
        F.count_if((F.col("human") >= 0) & (F.col("human") == F.col("judge"))).alias("agreeing"),
    )


def kappa_error(annotations: DataFrame) -> DataFrame:
    """(kappa, se): Cohen's kappa of 0/1 labels and its large-sample standard error."""
    pairs = judged(annotations).groupBy().agg(
        F.count("*").cast("double").alias("n"),
        *[F.avg(((F.col("judge") == i) & (F.col("human") == j)).cast("double")).alias(f"p{i}{j}") for i in (0, 1) for j in (0, 1)],
    )
    a, b = F.col("p10") + F.col("p11"), F.col("p01") + F.col("p11")
    agree, chance = F.col("p00") + F.col("p11"), a * b + (1 - a) * (1 - b)
    kappa = F.try_divide(agree - chance, 1 - chance)
    miss = 1 - kappa
    # Row and column shares of a cell's labels, on and off the diagonal.
    on = F.col("p11") * F.pow(1 - (a + b) * miss, F.lit(2)) + F.col("p00") * F.pow(1 - (2 - a - b) * miss, F.lit(2))
    off = F.pow(miss, F.lit(2)) * (F.col("p10") * F.pow(b + (1 - a), F.lit(2)) + F.col("p01") * F.pow((1 - b) + a, F.lit(2)))
    square = on + off - F.pow(kappa - chance * miss, F.lit(2))
    return pairs.select(kappa.alias("kappa"), (F.sqrt(square / F.col("n")) / (1 - chance)).alias("se"))


def kappa_interval(annotations: DataFrame, replicas: int = 4000, seed: int = 42) -> DataFrame:
    """Percentile interval of kappa from multinomial draws on the four cells of 0/1 labels."""
    pairs = judged(annotations).select(F.col("judge").alias("a"), F.col("human").alias("b"))
    cells = compress(pairs, None, ["a", "b"])
    rows = replica_rows(replica_weights(cells, ["a", "b"], replicas, seed))
    values = rows.groupBy("replica").agg(*[c.alias(k) for k, c in kappa_columns().items()])
    return percentile_interval(values, ["kappa"])
