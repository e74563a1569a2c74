"""Selective-prediction metrics on compressed score levels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from quorate.functions import constants as C
from quorate.operators.prefix import levels, running_totals, unit_bucket
from quorate.session import materialise, values_table


def coverage_risk(decided: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Coverage and selective risk, overall or by group."""
    answered = ~F.col("abstained")
    return decided.groupBy(*group).agg(
        F.count("*").alias("n"),
        F.avg(answered.cast("double")).alias("coverage"),
        F.avg(F.when(answered, (F.lit(1) - F.col("z_winner")).cast("double"))).alias("selective_risk"),
    )


def abstention_metrics(decided: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Useful adequacy, abstention precision, base rate, lift and number of abstentions."""
    abst = F.col("abstained")
    error = (F.lit(1) - F.col("z_winner")).cast("double")
    useful = F.sum(F.when(~abst, F.col("z_winner")).otherwise(0)).cast("double")
    return decided.groupBy(*group).agg(
        (useful / F.count("*")).alias("adequacy_useful"),
        F.avg(F.when(abst, error)).alias("abstention_precision"),
        F.avg(error).alias("base_rate"),
        (F.avg(F.when(abst, error)) - F.avg(error)).alias("lift"),
        F.count_if(abst).alias("n_abstentions"),
    )


def _error_levels(df: DataFrame, group: Sequence[str], extra: Sequence[float] = ()) -> DataFrame:
    """Distinct eta with rows and errors; each ``extra`` eta is a level even where no row has it.

    Extra levels enter as rows of no weight beside every row and vanish in the map-side partial
    sums, so keep them few.
    """
    rows = df.select(*group, "eta", F.lit(1).alias("n"), (F.lit(1) - F.col("z")).alias("err"))
    if extra:
        own = F.struct("eta", "n", "err")
        zero = F.lit(0)
        added = [
            F.struct(F.lit(float(t)).alias("eta"), zero.alias("n"), zero.alias("err")) for t in extra
        ]
        rows = rows.select(*group, F.inline(F.array(own, *added)))
    return levels(
        rows,
        group,
        "eta",
        {"n": F.sum("n").cast("bigint"), "err": F.sum("err").cast("bigint")},
    )


def _with_grid(base: DataFrame, group: Sequence[str], taus: Sequence[float]) -> DataFrame:
    """Add zero-count levels for many taus to every group of a compressed level table."""
    heads = base.select(*group).distinct() if group else base.sparkSession.range(1)
    grid = heads.withColumn("eta", F.explode(F.array(*[F.lit(float(t)) for t in taus])))
    none = F.lit(0).cast("bigint")
    grid = grid.select(*group, "eta", none.alias("n"), none.alias("err"))
    return (
        base.unionByName(grid)
        .groupBy(*group, "eta")
        .agg(F.sum("n").alias("n"), F.sum("err").alias("err"))
    )


def tau_star(val: DataFrame, group: Sequence[str], c_mins: Sequence[float]) -> DataFrame:
    """Threshold of least selective risk with coverage of at least c_min, per group and c_min.

    Candidates are the distinct eta and 1.0; ties go to larger coverage, then to smaller tau.
    When no candidate qualifies tau is 1.0 and ``constraint_satisfied`` is false.
    """
    group = list(group)
    cand = running_totals(_error_levels(val, group, [1.0]), group, "eta", ["n", "err"])
    answered = F.col("before_n") + F.col("n")
    errors = F.col("before_err") + F.col("err")
    curve = cand.select(
        *group,
        F.col("eta").alias("tau"),
        F.col("total_n").alias("val_size"),
        (answered / F.col("total_n")).alias("coverage"),
        F.try_divide(errors, answered).alias("risk"),
    )
    wanted = curve.withColumn(
        "c_min", F.explode(F.array(*[F.lit(float(c)) for c in c_mins]))
    )
    feasible = (F.col("coverage") >= F.col("c_min")) & F.col("risk").isNotNull()
    point = F.struct("tau", "coverage", "risk")
    best = F.min_by(
        F.when(feasible, point),
        F.when(feasible, F.struct(F.col("risk"), -F.col("coverage"), F.col("tau"))),
    )
    fallback = F.max_by(F.when(F.col("tau") <= 1.0, point), F.when(F.col("tau") <= 1.0, F.col("tau")))
    return (
        wanted.groupBy(*group, "c_min")
        .agg(best.alias("b"), fallback.alias("f"), F.max("val_size").alias("val_size"))
        .select(
            *group,
            "c_min",
            F.coalesce("b.tau", F.lit(1.0)).alias("tau_star"),
            F.coalesce("b.coverage", "f.coverage").alias("coverage_emp_val"),
            F.coalesce("b.risk", "f.risk").alias("risk_sel_emp_val"),
            "val_size",
            F.col("b").isNotNull().alias("constraint_satisfied"),
        )
    )


def risk_coverage_curve(
    df: DataFrame, group: Sequence[str] = (), n_points: int = C.CURVE_POINTS
) -> DataFrame:
    """Coverage, selective risk and answered rows at each tau of a uniform grid and distinct eta."""
    group = list(group)
    grid = _equal_edges(n_points - 1)
    base = materialise(_error_levels(df, group))
    cum = running_totals(_with_grid(base, group, grid), group, "eta", ["n", "err"])
    answered = F.col("before_n") + F.col("n")
    return cum.select(
        *group,
        F.col("eta").alias("tau"),
        (answered / F.col("total_n")).alias("coverage"),
        F.try_divide(F.col("before_err") + F.col("err"), answered).alias("selective_risk"),
        answered.alias("n_answered"),
    )


def nearest_curve_point(curve: DataFrame, taus: DataFrame) -> DataFrame:
    """Curve point nearest to each wanted tau; ties to the smaller tau.

    Points and wanted values are laid on one line, cut into buckets of tau; each wanted value looks at
    the last point before it and the first from it on inside its bucket, and at the ends of the nearest
    buckets that have points. Nothing is paired, whatever the length of either side.
    """
    point = F.struct("tau", "coverage", "selective_risk")
    points = curve.select(F.col("tau").alias("t"), point.alias("p"), F.lit(None).cast("double").alias("wanted_tau"))
    asked = taus.select(F.col("wanted_tau").cast("double").alias("wanted_tau")).distinct()
    asked = asked.select(F.col("wanted_tau").alias("t"), F.lit(None).cast(points.schema["p"].dataType).alias("p"), "wanted_tau")
    line = points.unionByName(asked).withColumn("_b", unit_bucket(F.col("t")))
    order = W.partitionBy("_b").orderBy("t", F.col("wanted_tau").isNotNull())
    before = F.last("p", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    after = F.first("p", ignorenulls=True).over(order.rowsBetween(0, W.unboundedFollowing))
    seen = line.select("_b", "wanted_tau", before.alias("lo"), after.alias("hi")).where("wanted_tau is not null")

    # One row per bucket of the fixed number of buckets.
    ends = line.groupBy("_b").agg(F.max_by("p", F.when(F.col("p").isNotNull(), F.col("t"))).alias("top"), F.min_by("p", F.when(F.col("p").isNotNull(), F.col("t"))).alias("bottom"))
    along = W.orderBy("_b")
    ends = ends.select(
        "_b",
        F.last("top", ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, -1)).alias("below"),
        F.first("bottom", ignorenulls=True).over(along.rowsBetween(1, W.unboundedFollowing)).alias("above"),
    )
    both = seen.join(F.broadcast(ends), "_b").select("wanted_tau", F.explode(F.array("lo", "hi", "below", "above")).alias("p"))
    gap = F.struct(F.abs(F.col("p.tau") - F.col("wanted_tau")), F.col("p.tau"))
    near = both.where("p is not null").groupBy("wanted_tau").agg(F.min_by("p", gap).alias("p"))
    return near.select("wanted_tau", "p.tau", "p.coverage", "p.selective_risk")


def with_overall(df: DataFrame, stratum: str, overall: str = "all") -> DataFrame:
    """Each row in its stratum and in the overall one."""
    return df.withColumn(
        stratum, F.explode(F.array(F.lit(overall), F.col(stratum).cast("string")))
    )


def _equal_edges(n_bins: int) -> list[float]:
    """Edges i x (1/n): a product of doubles, as a uniform grid is usually generated."""
    step = 1.0 / n_bins
    return [i * step for i in range(n_bins)] + [1.0]


def bin_index(conf: Column, edges: Column, n_bins: int) -> Column:
    """Number of lower edges that are <= conf, 0-based; the last bin is closed on the right."""
    passed = F.size(F.filter(edges, lambda e: e <= conf))
    return F.least(passed, F.lit(n_bins)) - 1


def _binned(
    df: DataFrame, group: Sequence[str], edges: Column, n_bins: int
) -> DataFrame:
    compact = levels(
        df, group, "conf", {"n": F.count("*"), "z": F.sum("z").cast("bigint")}
    )
    index = bin_index(F.col("conf"), edges, n_bins)
    return compact.withColumn("bin", index).where(
        (F.col("bin") >= 0) & (F.col("conf") <= F.element_at(edges, -1))
    )


def _bin_table(binned: DataFrame, group: Sequence[str]) -> DataFrame:
    n = F.sum("n")
    return binned.groupBy(*group, "bin").agg(
        n.alias("count"),
        (F.sum(F.col("conf") * F.col("n")) / n).alias("avg_confidence"),
        (F.sum("z") / n).alias("accuracy"),
    )


def ece_equal_width(df: DataFrame, group: Sequence[str], n_bins: int = C.ECE_BINS) -> DataFrame:
    """Expected calibration error over equal bins of ``conf`` against ``z``."""
    edges = F.array(*[F.lit(e) for e in _equal_edges(n_bins)])
    return _ece(df, group, edges, n_bins)


def exact_quantiles(df: DataFrame, group: Sequence[str], key: str, probs: Sequence[float]) -> DataFrame:
    """(group, _q): exact interpolated quantiles of a key in [0, 1], from its levels and running counts.

    A quantile lies between two places of the sorted rows; only the levels that hold a wanted place are
    kept, so no group's values meet in one buffer. Null and NaN keys are left out.
    """
    group = list(group)
    known = df.where(F.col(key).isNotNull() & ~F.isnan(F.col(key).cast("double")))
    compact = levels(known, group, key, {"n": F.count("*")})
    cum = running_totals(compact, group, key, ["n"])
    place = lambda p: F.lit(float(p)) * (F.col("total_n") - 1)
    wanted = F.array(*[
        F.struct(F.lit(i).alias("i"), place(p).alias("at"), end(place(p)).cast("bigint").alias("k"))
        for i, p in enumerate(probs) for end in (F.floor, F.ceil)
    ])
    inside = F.filter(wanted, lambda w: (w["k"] >= F.col("before_n")) & (w["k"] < F.col("before_n") + F.col("n")))
    met = cum.select(*group, F.col(key).cast("double").alias("x"), F.explode(F.array_distinct(inside)).alias("w"))
    low, high = F.min_by("x", "w.k"), F.max_by("x", "w.k")
    share = F.max("w.at") - F.floor(F.max("w.at"))
    each = met.groupBy(*group, F.col("w.i").alias("i")).agg((low * (1 - share) + high * share).alias("q"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("i", "q"))), lambda s: s["q"])
    return each.groupBy(*group).agg(listed.alias("_q"))


def ece_quantile(df: DataFrame, group: Sequence[str], n_bins: int = C.ECE_BINS) -> DataFrame:
    """The same over quantile bins per group; repeated edges give empty bins."""
    quantiles = exact_quantiles(df, group, "conf", [i / n_bins for i in range(n_bins + 1)])
    inner = F.slice(F.col("_q"), 2, n_bins - 1)
    quantiles = quantiles.select(
        *group, F.concat(F.array(F.lit(0.0)), inner, F.array(F.lit(1.0 + 1e-9))).alias("_edges")
    )
    joined = df.join(quantiles, list(group)) if group else df.withColumn("_edges", quantiles.scalar())
    compact = levels(
        joined, [*group, "_edges"], "conf", {"n": F.count("*"), "z": F.sum("z").cast("bigint")}
    )
    index = bin_index(F.col("conf"), F.col("_edges"), n_bins)
    table = _bin_table(compact.withColumn("bin", index), group)
    return _weighted_gap(table, group)


def _ece(df: DataFrame, group: Sequence[str], edges: Column, n_bins: int) -> DataFrame:
    return _weighted_gap(_bin_table(_binned(df, group, edges, n_bins), group), group)


def _weighted_gap(table: DataFrame, group: Sequence[str]) -> DataFrame:
    gap = F.sum(F.col("count") * F.abs(F.col("accuracy") - F.col("avg_confidence")))
    return table.groupBy(*group).agg((gap / F.sum("count")).alias("ece"))


def reliability_table(df: DataFrame, group: Sequence[str], n_bins: int = C.ECE_BINS) -> DataFrame:
    """Bins with counts, mean confidence and accuracy; empty bins are kept."""
    steps = _equal_edges(n_bins)
    edges = F.array(*[F.lit(e) for e in steps])
    table = _bin_table(_binned(df, group, edges, n_bins), group)
    spark = df.sparkSession
    bins = values_table(spark, "bin, bin_lo, bin_hi", [(i, steps[i], steps[i + 1]) for i in range(n_bins)])
    heads = table.select(*group).distinct() if group else None
    if heads is None:
        full = bins
    else:
        listed = F.array(*[F.struct(F.lit(i).alias("bin"), F.lit(steps[i]).alias("bin_lo"), F.lit(steps[i + 1]).alias("bin_hi")) for i in range(n_bins)])
        full = heads.withColumn("_b", F.explode(listed)).select(*group, "_b.bin", "_b.bin_lo", "_b.bin_hi")
    return full.join(table, [*group, "bin"], "left").withColumn(
        "count", F.coalesce("count", F.lit(0).cast("bigint"))
    )


def representative_fold(panel: DataFrame, n_bins: int = C.ECE_BINS) -> DataFrame:
    """Fold whose mean raw calibration error is nearest to the median over folds; ties to the
    smaller fold.  The tables here have one row per fold.

    With an even number of folds the two middle ones are equally near, so distances are compared
    at twelve digits: the noise of a sum's order must not choose.
    """
    per_fold = (
        ece_equal_width(panel, ["fold_k", "agent_id"], n_bins)
        .groupBy("fold_k")
        .agg(F.avg("ece").alias("ece"))
    )
    middle = per_fold.agg(F.percentile("ece", F.lit(0.5))).scalar()
    return (
        per_fold.withColumn("distance", F.round(F.abs(F.col("ece") - middle), 12))
        .orderBy("distance", "fold_k")
        .limit(1)
    )


def auroc_from_levels(compact: DataFrame, group: Sequence[str], score: str) -> DataFrame:
    """AUROC with midrank ties from (group, score, n, pos); null when one class is absent."""
    both = compact.withColumn("neg", F.col("n") - F.col("pos"))
    cum = running_totals(both, group, score, ["n", "pos", "neg"])
    wins = F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2.0))
    out = cum.groupBy(*group).agg(
        F.sum("n").alias("n"), wins.alias("_u"), F.sum("pos").alias("_p"), F.sum("neg").alias("_m")
    )
    return out.select(
        *group, "n", F.try_divide(F.col("_u"), F.col("_p").cast("double") * F.col("_m")).alias("auroc")
    )


def auroc(df: DataFrame, group: Sequence[str], score: str, positive: Column) -> DataFrame:
    """AUROC of ``score`` for the 0/1 column ``positive``; null scores make the result null."""
    compact = df.groupBy(*group, score).agg(
        F.count("*").alias("n"), F.sum(positive).cast("bigint").alias("pos")
    )
    area = auroc_from_levels(compact.where(F.col(score).isNotNull()), group, score)
    whole = compact.groupBy(*group).agg(F.sum("n").alias("_all"))
    if not group:
        return area.withColumn("auroc", F.when(F.col("n") == whole.scalar(), F.col("auroc")))
    return area.join(whole, list(group)).select(
        *group, "n", F.when(F.col("n") == F.col("_all"), F.col("auroc")).alias("auroc")
    )


EULER_GAMMA = 0.5772156649015329
SMALL_LEVEL = 64


def harmonic(n: Column) -> Column:
    """H(n) by its asymptotic series; exact sums are used below ``SMALL_LEVEL``."""
    x = n.cast("double")
    series = (
        F.log(x)
        + F.lit(EULER_GAMMA)
        + F.lit(1.0) / (x * 2)
        - F.lit(1.0) / (x * x * 12)
        + F.lit(1.0) / (x * x * x * x * 120)
    )
    exact = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.least(n, F.lit(SMALL_LEVEL)), F.lit(1)).cast("int")),
        F.lit(0.0),
        lambda acc, i: acc + F.lit(1.0) / i,
    )
    return F.when(n <= 0, F.lit(0.0)).when(n <= SMALL_LEVEL, exact).otherwise(series)


def ranked_levels(df: DataFrame, group: Sequence[str], score: str = "score") -> DataFrame:
    """Score levels, best first, with rows ``n`` and successes ``s`` before and in each level."""
    compact = df.groupBy(*group, score).agg(
        F.count("*").alias("n"), F.sum("z").cast("bigint").alias("s")
    )
    return running_totals(compact, group, score, ["n", "s"], descending=True)


def aurc_term(n: Column, s: Column, n0: Column, s0: Column) -> Column:
    """Sum of risks over the n positions of a tied level that starts after n0 rows, s0 successes.

    The expected label of every tied row is the level mean m, so the sum over j of
    1 - (s0 + j m) / (n0 + j) is n (1 - m) - (s0 - n0 m) (H(n0 + n) - H(n0)).
    """
    m = s / n
    return n * (F.lit(1.0) - m) - (s0 - n0 * m) * (harmonic(n0 + n) - harmonic(n0))


def aurc(df: DataFrame, group: Sequence[str], score: str = "score") -> DataFrame:
    """Area under the risk-coverage curve, invariant to the order of tied rows."""
    cum = ranked_levels(df, group, score)
    term = aurc_term(F.col("n"), F.col("s"), F.col("before_n"), F.col("before_s"))
    return cum.groupBy(*group).agg(
        F.sum("n").alias("n_items"),
        F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).cast("bigint").alias("n_tied"),
        (F.sum(term) / F.sum("n")).alias("aurc"),
    )


# Ranges of the row number into which the rows of one tied score are cut.
TIE_RANGES = 1024


def aurc_row_order(df: DataFrame, group: Sequence[str], row: str, score: str = "score") -> DataFrame:
    """The same area with ties broken by a row number, for comparison.

    Totals before a score come from its level; inside a level rows are cut into ranges of the row number,
    so a score that most rows share is no single task.
    """
    group = list(group)
    one = df.select(*group, score, row, F.lit(1).cast("bigint").alias("n"), F.col("z").cast("bigint").alias("s"))
    spans = one.groupBy(*group, score).agg(F.min(row).alias("_from"), F.max(row).alias("_to"))
    before = ranked_levels(df, group, score).select(*group, score, F.col("before_n").alias("_n"), F.col("before_s").alias("_s"))
    both = spans.join(before, [*group, score])
    rows = one.join(both, [*group, score])
    part = F.floor((F.col(row) - F.col("_from")) / (F.col("_to") - F.col("_from") + 1) * TIE_RANGES).cast("int")
    cum = running_totals(rows, [*group, score], row, ["n", "s"], bucket=part)
    answered = F.col("_n") + F.col("before_n") + F.col("n")
    risk = F.lit(1.0) - (F.col("_s") + F.col("before_s") + F.col("s")) / answered
    return cum.groupBy(*group).agg(F.avg(risk).alias("aurc_row_order"))


def risk_at_coverage(
    df: DataFrame, group: Sequence[str], coverages: Sequence[float], score: str = "score"
) -> DataFrame:
    """Risk over the first max(int(c n), 1) rows by score; the cut level enters by its mean."""
    cum = ranked_levels(df, group, score).withColumn(
        "coverage", F.explode(F.array(*[F.lit(float(c)) for c in coverages]))
    )
    wanted = F.greatest(F.floor(F.col("coverage") * F.col("total_n")), F.lit(1))
    taken = F.greatest(F.least(wanted - F.col("before_n"), F.col("n")), F.lit(0))
    return (
        cum.withColumn("_k", wanted)
        .groupBy(*group, "coverage")
        .agg(
            (
                F.lit(1.0)
                - F.sum(taken * (F.col("s") / F.col("n"))) / F.max("_k")
            ).alias("risk")
        )
    )


def response_probability(
    df: DataFrame, group: Sequence[str], coverages: Sequence[float], score: str = "score"
) -> DataFrame:
    """Probability of answering per score level: 1 above the cut, fractional in the cut level."""
    compact = df.groupBy(*group, score).agg(F.count("*").alias("n"))
    cum = running_totals(compact, group, score, ["n"], descending=True).withColumn(
        "target_coverage", F.explode(F.array(*[F.lit(float(c)) for c in coverages]))
    )
    target = F.col("target_coverage") * F.col("total_n")
    share = F.least(F.greatest((target - F.col("before_n")) / F.col("n"), F.lit(0.0)), F.lit(1.0))
    return cum.select(*group, score, "target_coverage", share.alias("p_respond"))
