"""Numeric helpers on result rows: normal distribution, and exact binomial bounds as plain expressions."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F, types as T


@F.pandas_udf(T.DoubleType())
def normal_cdf(x: pd.Series) -> pd.Series:
    return x.map(NormalDist().cdf)


@F.pandas_udf(T.DoubleType())
def normal_quantile(p: pd.Series) -> pd.Series:
    return p.map(NormalDist().inv_cdf)


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function of positive numbers: Stirling's series eight places further on."""
    far = x + 8
    series = (far - 0.5) * F.log(far) - far + 0.5 * math.log(2 * math.pi)
    series = series + 1 / (12 * far) - 1 / (360 * F.pow(far, F.lit(3))) + 1 / (1260 * F.pow(far, F.lit(5))) - 1 / (1680 * F.pow(far, F.lit(7)))
    for i in range(8):
        series = series - F.log(x + i)
    return series


# Halvings of the unit interval that a bound takes.
HALVINGS = 56


def _beta_fraction(x: Column, a: Column, b: Column) -> Column:
    """Continued fraction of the incomplete beta function (modified Lentz); terms grow with the root of a and b."""
    safe = lambda v: F.when(F.abs(v) < 1e-300, 1e-300).otherwise(v)
    first = 1 / safe(1 - (a + b) * x / (a + 1))

    def step(acc: Column, i: Column) -> Column:
        m = F.floor(i / 2)
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        term = F.when(i % 2 == 0, even).otherwise(odd)
        d, c = 1 / safe(1 + term * acc["d"]), safe(1 + term / acc["c"])
        return F.struct(c.alias("c"), d.alias("d"), (acc["t"] * c * d).alias("t"))

    terms = F.sequence(F.lit(2), (80 + 8 * F.sqrt(F.greatest(a, b))).cast("int"))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("t"))
    return F.aggregate(terms, start, step, lambda acc: acc["t"])


def _bound(target: float, k: Column, n: Column) -> Column:
    """The p with P(X >= k) = ``target`` for X ~ Binomial(n, p), 0 < k <= n, by bisection."""
    a, b = k.cast("double"), (n - k + 1).cast("double")
    scale = log_gamma(a + b) - log_gamma(a) - log_gamma(b)

    def halve(acc: Column, _: Column) -> Column:
        p = (acc["lo"] + acc["hi"]) / 2
        turned = p > (a + 1) / (a + b + 2)
        front = F.exp(scale + a * F.log(p) + b * F.log1p(-p))
        near = front * _beta_fraction(p, a, b) / a
        far = 1 - front * _beta_fraction(1 - p, b, a) / b
        below = F.when(turned, far).otherwise(near) < target
        return F.struct(F.when(below, p).otherwise(acc["lo"]).alias("lo"), F.when(below, acc["hi"]).otherwise(p).alias("hi"))

    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), start, halve, lambda acc: (acc["lo"] + acc["hi"]) / 2)


def clopper_pearson(k: Column, n: Column, level: float = 0.95) -> Column:
    """struct(ci_lo, ci_hi): exact interval of k successes in n; null without trials."""
    tail = (1 - level) / 2
    lo = F.when(k > 0, _bound(tail, k, n)).otherwise(0.0)
    hi = F.when(k < n, _bound(1 - tail, k + 1, n)).otherwise(1.0)
    return F.when(n > 0, F.struct(lo.alias("ci_lo"), hi.alias("ci_hi")))
