"""Scalar arithmetic: guarded division, clamped scaling, portable rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def num(v) -> Column:
    """A double literal, or the column itself."""
    return v if isinstance(v, Column) else F.lit(float(v))


def div(a: Column | str, b: Column | str, default: float | None = None) -> Column:
    """a / b; NULL (or ``default``) when b is zero or anything is missing."""
    q = col(a) / F.nullif(col(b), F.lit(0.0))
    return q if default is None else F.coalesce(q, F.lit(float(default)))


def whole(y: Column) -> Column:
    """Floor as a double of any size: doubles from 9e15 on are whole, and only smaller ones pass through a BIGINT."""
    return F.when(F.abs(y) < F.lit(9e15), F.floor(y).cast("double")).otherwise(y)


def snap(c: Column | str, digits: int = 6) -> Column:
    """Round half up by ``floor``; unlike ``round`` it gives the same bits in every engine."""
    p = float(10**digits)
    return whole(col(c) * F.lit(p) + F.lit(0.5)) / F.lit(p)


def steady(c: Column) -> Column:
    """A sort key without floating-point noise (nine decimals)."""
    return whole(c * F.lit(1e9) + F.lit(0.5))


def clamp(c: Column, lo=0.0, hi=1.0) -> Column:
    """Clip to [lo, hi]; NULL stays NULL (bare greatest/least would skip it)."""
    return F.when(c.isNotNull(), F.greatest(num(lo), F.least(num(hi), c)))


def clip(c: Column, lo=0.0, hi=1.0) -> Column:
    """``clamp`` for expressions that are never NULL; mentions ``c`` once, so nesting stays linear."""
    return F.greatest(num(lo), F.least(num(hi), c))


def norm(v: Column | str, lo, hi, invert: bool = False) -> Column:
    """Clamp-normalise ``v`` from [lo, hi] to [0, 1]; an empty range gives 0.5."""
    v, lo, hi = col(v), num(lo), num(hi)
    scaled = clip((v - lo) / F.nullif(hi - lo, F.lit(0.0)))
    if invert:
        scaled = 1.0 - scaled
    return F.when(v.isNull(), F.lit(None).cast("double")).when(hi == lo, F.lit(0.5)).otherwise(scaled)


def rescale(v: Column | str, lo=-1.0, hi=1.0, tlo=0.0, thi=1.0) -> Column:
    """Map [lo, hi] linearly onto [tlo, thi] after clipping; an empty range gives the midpoint."""
    v, lo, hi, tlo, thi = col(v), num(lo), num(hi), num(tlo), num(thi)
    inside = tlo + (clamp(v, lo, hi) - lo) / F.nullif(hi - lo, F.lit(0.0)) * (thi - tlo)
    return F.when(hi == lo, (tlo + thi) / 2.0).otherwise(inside)


def percent_of_range(v: Column | str, lo=0.0, hi=100.0) -> Column:
    """Progress of ``v`` through [lo, hi] as 0..100."""
    return rescale(v, lo, hi, 0.0, 100.0)


def ladder(v: Column, steps: list[tuple[float, str]], otherwise: str, op: str = ">=") -> Column:
    """First label whose bound ``v`` meets, tested in order (``>=``, ``>``, ``<`` or ``<=``)."""
    test = {
        ">=": lambda b: v >= F.lit(b),
        ">": lambda b: v > F.lit(b),
        "<": lambda b: v < F.lit(b),
        "<=": lambda b: v <= F.lit(b),
    }[op]
    (b0, l0), *rest = steps
    out = F.when(test(b0), F.lit(l0))
    for b, label in rest:
        out = out.when(test(b), F.lit(label))
    return out.otherwise(F.lit(otherwise))


def finite(c: Column | str) -> Column:
    """NaN and infinities become NULL, the only missing value used downstream."""
    c = col(c)
    bad = F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.when(~bad, c)


def notes(*conditions: tuple[Column, str | Column]) -> Column:
    """Array of the texts whose condition holds, in the given order."""
    return F.array_compact(
        F.array(*[F.when(c, t if isinstance(t, Column) else F.lit(t)) for c, t in conditions])
    )
