"""p-values of correlation tests as native column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def correlation_pvalue(r: Column, n: Column) -> Column:
    """Two-sided p of H0: rho = 0 for a sample correlation r over n pairs.

    Student's t with integer degrees of freedom has a finite trigonometric
    series, so no incomplete-beta routine (and no UDF) is needed: with
    theta = atan(t / sqrt(df)) the terms are powers of cos(theta)^2 = 1 - r^2.
    """
    df = (n - 2).cast("int")
    r2 = F.least(r * r, F.lit(1.0))
    cos2, sin, odd = 1.0 - r2, F.sqrt(r2), (df % 2) == 1
    # Number of series terms after the leading one.
    terms = F.when(odd, F.floor((df - 3) / F.lit(2))).otherwise(F.floor((df - 2) / F.lit(2))).cast("int")

    def step(acc: Column, j: Column) -> Column:
        jd = j.cast("double")
        ratio = F.when(odd, 2 * jd / (2 * jd + 1)).otherwise((2 * jd - 1) / (2 * jd))
        term = acc["term"] * ratio * cos2
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    series = F.aggregate(
        F.when(terms >= 1, F.sequence(F.lit(1), terms)).otherwise(F.array().cast("array<int>")),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total")),
        step,
        lambda acc: acc["total"],
    )
    theta = F.asin(sin)
    inside = (
        F.when(df == 1, 2 / math.pi * theta)
        .when(odd, 2 / math.pi * (theta + sin * F.sqrt(cos2) * series))
        .otherwise(sin * series)
    )
    return F.when(df >= 1, F.greatest(F.lit(0.0), 1.0 - inside))


# Chebyshev fit of ln(erfc(x) exp(x^2) / t) in t = 1 / (1 + x / 2), constant first; its relative error is below 1.2e-7.
ERFC_FIT = (
    -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277,
)


def normal_pvalue(z: Column) -> Column:
    """Two-sided p of a standard normal score, erfc(abs(z) / sqrt(2)), as a column expression."""
    x = F.abs(z) / math.sqrt(2)
    t = 1.0 / (1.0 + x / 2)
    fit = F.lit(ERFC_FIT[-1])
    for c in reversed(ERFC_FIT[:-1]):
        fit = fit * t + c
    return t * F.exp(fit - x * x)


def strength_class(r: Column) -> Column:
    a = F.abs(r)
    return (
        F.when(a >= 0.8, "very_strong").when(a >= 0.6, "strong").when(a >= 0.4, "moderate")
        .when(a >= 0.2, "weak").otherwise("very_weak")
    )
