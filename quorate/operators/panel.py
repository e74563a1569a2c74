"""Item x agent panels: grid completion, label sources, refusals, crosstabs and strata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorate.functions import constants as C


def complete_grid(
    items: DataFrame, agents: Sequence, observed: DataFrame, defaults: dict[str, object]
) -> DataFrame:
    """Every (item, agent) pair once; absent pairs take ``defaults``.

    The agent list is a short parameter, so the grid is an explode inside each item row and the
    only shuffle is the left join on (item_id, agent_id).
    """
    grid = items.withColumn("agent_id", F.explode(F.array(*[F.lit(a) for a in agents])))
    joined = grid.join(observed, ["item_id", "agent_id"], "left")
    return joined.withColumns(
        {name: F.coalesce(F.col(name), F.lit(value)) for name, value in defaults.items()}
    )


def usable_confidence(conf: Column) -> Column:
    """Missing or not-a-number confidence counts as zero."""
    return F.coalesce(F.nanvl(conf, F.lit(None).cast("double")), F.lit(0.0))


def judged_label(z: Column, valid_json: Column, response: Column | None = None) -> Column:
    """Label of an answer: invalid or empty output is 0 without a look-up; absent label is 0."""
    bad = ~F.coalesce(valid_json, F.lit(False))
    if response is not None:
        bad = bad | (F.length(F.trim(F.coalesce(response, F.lit("")))) == 0)
    return F.when(bad, F.lit(0)).otherwise(F.coalesce(z, F.lit(0))).cast("int")


def is_refusal(text: Column) -> Column:
    """Textual refusal predicate; null text is not a refusal."""
    return F.coalesce(text.rlike("(?iu)" + C.REFUSAL_PATTERN), F.lit(False))


def unpivot_labels(wide: DataFrame, ids: Sequence[str], prefix: str, value: str) -> DataFrame:
    """Columns ``<prefix><agent>`` to rows (ids, agent_id, value)."""
    columns = [c for c in wide.columns if c.startswith(prefix)]
    long = wide.unpivot(list(ids), columns, "agent_id", value)
    return long.withColumn("agent_id", F.expr(f"substring(agent_id, {len(prefix) + 1})"))


def labels_with_fallback(
    grid: DataFrame, label_cache: DataFrame | None, wide: DataFrame | None, prefix: str
) -> DataFrame:
    """Labels from the judge's table when there is one, else from wide columns; missing pair 0."""
    if label_cache is not None:
        source = label_cache.select("item_id", F.col("response_source").alias("agent_id"), "z")
    else:
        source = unpivot_labels(wide, ["item_id"], prefix, "z")
    return grid.join(source, ["item_id", "agent_id"], "left").withColumn(
        "z", F.coalesce("z", F.lit(0))
    )


def label_of(code: Column, labels: dict[int, str]) -> Column:
    """Code to label through a literal map; unknown codes are null."""
    pairs = [F.lit(x) for pair in labels.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), code.cast("int"))


def drop_parse_failures(df: DataFrame, verdict: str) -> DataFrame:
    """Keep rows whose verdict was read (>= 0)."""
    return df.where(F.col(verdict) >= 0)


def exclude_documented(df: DataFrame, exclusions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop rows listed, with a reason, in an exclusions table."""
    return df.join(exclusions.select(*keys).distinct(), list(keys), "left_anti")


def retrieval_stratum(has_doc_ref: Column, recall: Column) -> Column:
    none, zero, low, high = C.RETRIEVAL_STRATA
    return (
        F.when(~has_doc_ref, none)
        .when(recall.isNull() | F.isnan(recall) | (recall == 0), zero)
        .when(recall < 0.5, low)
        .otherwise(high)
    )


def recall_band(recall: Column) -> Column:
    return F.when(recall == 0, "zero").when(recall >= 1, "one").otherwise("between")


def crosstab(
    df: DataFrame, row: str, col: str, col_values: Sequence[str]
) -> DataFrame:
    """Counts of ``row`` x ``col`` with declared columns (no extra job to discover them)."""
    return df.groupBy(row).pivot(col, list(col_values)).count().na.fill(0, list(col_values))


def row_shares(table: DataFrame, row: str, cols: Sequence[str], scale: float = 1.0) -> DataFrame:
    """Each cell as a share of its row."""
    total = sum((F.col(c) for c in cols[1:]), F.col(cols[0]))
    return table.select(
        row, *[F.try_divide(F.col(c) * F.lit(scale), total.cast("double")).alias(c) for c in cols]
    )


def pivot_mean(df: DataFrame, row: str, col: str, col_values: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(row).pivot(col, list(col_values)).avg(value)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts of a column, or of the elements of an array column."""
    if dict(df.dtypes)[column].startswith("array"):
        df = df.select(F.explode(column).alias(column))
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def composition_share(df: DataFrame, kind: str) -> DataFrame:
    """Count and share of rows per kind; the total comes from the per-kind counts."""
    counts = df.groupBy(kind).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("share", F.col("n") / total)


def item_rollup(long: DataFrame, agents: Sequence, measures: Sequence[str]) -> DataFrame:
    """(item, agent) rows to one row per item: wide columns per agent and the mean over agents."""
    aggs = []
    for m in measures:
        for a in agents:
            aggs.append(
                F.coalesce(F.max(F.when(F.col("agent_id") == F.lit(a), F.col(m))), F.lit(0)).alias(
                    f"{m}_{a}"
                )
            )
    wide = long.groupBy("item_id").agg(*aggs)
    means = {
        f"{m}_mean": sum((F.col(f"{m}_{a}") for a in agents[1:]), F.col(f"{m}_{agents[0]}"))
        / F.lit(float(len(agents)))
        for m in measures
    }
    return wide.withColumns(means)


def variant_summary(long: DataFrame) -> DataFrame:
    """Per agent: adequacy, adequate answers, refusals, evasive refusals, parse failures."""
    return long.groupBy("agent_id").agg(
        F.count("*").alias("n"),
        F.avg("z").alias("adequacy"),
        F.sum("z").cast("bigint").alias("n_adequate"),
        F.sum(F.col("refused").cast("bigint")).alias("n_refusals"),
        F.sum(F.col("evasive").cast("bigint")).alias("n_evasive"),
        F.sum((~F.col("valid_json")).cast("bigint")).alias("n_parse_failures"),
    )


def strata_summary(decided: DataFrame, stratum: str) -> DataFrame:
    """Abstention rate and precision, selective risk and adequacy of answers per stratum."""
    abstained, error = F.col("abstained"), (F.lit(1) - F.col("z")).cast("double")
    return decided.groupBy(stratum).agg(
        F.count("*").alias("n"),
        F.avg(abstained.cast("double")).alias("abstention_rate"),
        F.avg(F.when(abstained, error)).alias("abstention_precision"),
        F.avg(F.when(~abstained, error)).alias("selective_risk"),
        F.avg(F.when(~abstained, F.col("z").cast("double"))).alias("answered_adequacy"),
    )


def tradeoff_by_level(decided: DataFrame, level: str = "c_min") -> DataFrame:
    """Abstention precision, volume, coverage and risk for each coverage constraint."""
    abstained, error = F.col("abstained"), (F.lit(1) - F.col("z")).cast("double")
    return decided.groupBy(level).agg(
        F.avg(F.when(abstained, error)).alias("abstention_precision"),
        F.count_if(abstained).alias("n_abstentions"),
        F.avg((~abstained).cast("double")).alias("coverage"),
        F.avg(F.when(~abstained, error)).alias("selective_risk"),
    )


def uncertainty_histogram(decided: DataFrame, edges: int = 22) -> DataFrame:
    """Counts of eta by adequacy over equal bins; the range is widened to multiples of 1/20."""
    span = decided.agg(
        (F.floor(F.min("eta") * 20) / 20.0).alias("lo"), (F.ceil(F.max("eta") * 20) / 20.0).alias("hi")
    )
    bins = edges - 1
    lo, hi = span.select("lo").scalar(), span.select("hi").scalar()
    position = F.floor((F.col("eta") - lo) / ((hi - lo) / F.lit(float(bins))))
    return (
        decided.withColumn("bin", F.least(position, F.lit(bins - 1)).cast("int"))
        .groupBy("bin", "z")
        .agg(F.count("*").alias("n"))
    )


def size_quantiles(df: DataFrame, column: str, limit: int) -> DataFrame:
    """Mean, median, p95, p99, maximum and number of rows over a limit.

    ``percentile`` keeps one counter per distinct size, so it stays small for integer sizes.
    """
    q = F.percentile(column, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    return df.agg(
        F.count("*").alias("n"),
        F.avg(column).alias("mean"),
        q.alias("q"),
        F.max(column).alias("max"),
        F.count_if(F.col(column) > limit).alias("n_over_limit"),
    ).select(
        "n",
        "mean",
        F.col("q")[0].alias("median"),
        F.col("q")[1].alias("p95"),
        F.col("q")[2].alias("p99"),
        "max",
        "n_over_limit",
    )
