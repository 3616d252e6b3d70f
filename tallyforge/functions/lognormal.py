"""Lognormal estimates as struct columns (mu, sigma), and their arithmetic."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

Z90 = NormalDist().inv_cdf(0.9)


def estimate(mu: Column, sigma: Column) -> Column:
    return F.struct(mu.cast("double").alias("mu"), sigma.cast("double").alias("sigma"))


def from_point(value: Column, cv: float = 0.5) -> Column:
    """An estimate with median value and coefficient of variation cv; null for values that are not positive."""
    return F.when(value > 0, estimate(F.ln(value), F.lit(math.sqrt(math.log1p(cv * cv)))))


def from_range(p10: Column, p90: Column) -> Column:
    return F.when((p10 > 0) & (p90 > 0), estimate((F.ln(p10) + F.ln(p90)) / 2, (F.ln(p90) - F.ln(p10)) / (2 * Z90)))


def quantile(e: Column, p: float) -> Column:
    return F.exp(e["mu"] + e["sigma"] * NormalDist().inv_cdf(p))


def median(e: Column) -> Column:
    return F.exp(e["mu"])


def mean(e: Column) -> Column:
    return F.exp(e["mu"] + e["sigma"] * e["sigma"] / 2)


def variance(e: Column) -> Column:
    s2 = e["sigma"] * e["sigma"]
    return F.expm1(s2) * F.exp(2 * e["mu"] + s2)


def times(a: Column, b: Column) -> Column:
    return estimate(a["mu"] + b["mu"], F.sqrt(a["sigma"] * a["sigma"] + b["sigma"] * b["sigma"]))


def over(a: Column, b: Column) -> Column:
    return estimate(a["mu"] - b["mu"], F.sqrt(a["sigma"] * a["sigma"] + b["sigma"] * b["sigma"]))


def minus(a: Column, b: Column) -> Column:
    """Difference of means with both variances; a token amount where it is not positive."""
    d = mean(a) - mean(b)
    cv = F.sqrt(variance(a) + variance(b)) / d
    return F.when(d > 0, estimate(F.ln(d), F.sqrt(F.log1p(cv * cv)))).otherwise(from_point(F.lit(0.001), 0.5))


def savings_fraction(multiplier: Column) -> Column:
    """1 - 1 / m of the multiplier's median, within 0 and 0.95."""
    m = F.greatest(median(multiplier), F.lit(1.001))
    f = F.least(F.greatest(1 - 1 / m, F.lit(0.0)), F.lit(0.95))
    return F.when(f > 0, from_point(f, 0.3)).otherwise(from_point(F.lit(0.001), 0.5))


def summed(e: Column) -> Column:
    """Aggregate: the sum's median is the sum of means, its variation that of the sum within 0.01 and 2."""
    m, v = F.sum(mean(e)), F.sum(variance(e))
    cv = F.least(F.greatest(F.sqrt(v) / m, F.lit(0.01)), F.lit(2.0))
    return F.when(m > 0, estimate(F.ln(m), F.sqrt(F.log1p(cv * cv))))


def product(e: Column) -> Column:
    """Aggregate: the product of estimates, beginning with a near-certain 1."""
    return estimate(F.sum(e["mu"]), F.sqrt(F.sum(e["sigma"] * e["sigma"]) + math.log1p(0.01**2)))


def round_sig2(x: Column) -> Column:
    """Two significant digits, half away from zero."""
    scale = F.pow(F.lit(10.0), 1 - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.round(x * scale) / scale)


def fan_out_factor(downstream: Column, exposures: Column) -> Column:
    return F.least(F.lit(2.0), 1 + 0.25 * F.log2(1 + downstream)) * F.least(F.lit(1.5), 1 + 0.05 * exposures)
