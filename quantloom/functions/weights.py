"""Indicator-weight arithmetic, per row.

A weight set is either a mapping source -> Column (used inside scores) or a
MAP<STRING, DOUBLE> column (used for reporting and validation).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quantloom.functions.numeric import div


def total(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out + c
    return out


def renormalize(weights: dict[str, float], available: dict[str, Column]) -> dict[str, Column]:
    """Weights of the available sources rescaled to sum to one; NULL for absent sources.

    If all available weights are zero the available sources share equally.
    """
    mass = available_mass(weights, available)
    out = {s: F.when(available[s], div(F.lit(float(w)), mass)) for s, w in weights.items()}
    if all(w > 0 for w in weights.values()):
        return out
    share = 1.0 / F.nullif(available_count(available), F.lit(0))
    return {s: F.coalesce(c, F.when(available[s], share)) for s, c in out.items()}


def available_mass(weights: dict[str, float], available: dict[str, Column]) -> Column:
    return total([F.when(available[s], F.lit(float(w))).otherwise(0.0) for s, w in weights.items()])


def available_count(available: dict[str, Column]) -> Column:
    return total([F.when(a, 1).otherwise(0) for a in available.values()])


def weighted_score(components: dict[str, Column], weights: dict[str, float], available: dict[str, Column],
                   neutral: float) -> Column:
    """Sum of renormalised weight x component over the available sources; ``neutral`` without any."""
    if not all(w > 0 for w in weights.values()):
        w = renormalize(weights, available)
        parts = [F.coalesce(w[s] * c, F.lit(0.0)) for s, c in components.items()]
        return F.when(none_available(available), F.lit(neutral)).otherwise(total(parts))
    parts = [F.when(available[s], float(weights[s]) * c).otherwise(0.0) for s, c in components.items()]
    return F.coalesce(div(total(parts), available_mass(weights, available)), F.lit(float(neutral)))


def none_available(available: dict[str, Column]) -> Column:
    return available_count(available) == 0


def weight_map(weights: dict[str, Column], neutral: Column | None = None) -> Column:
    """MAP of the non-NULL weights; ``{neutral: 1}`` where nothing is available."""
    entries = F.map_filter(
        F.create_map(*[x for s, w in weights.items() for x in (F.lit(s), w)]), lambda k, v: v.isNotNull()
    )
    if neutral is None:
        return entries
    return F.when(neutral, F.create_map(F.lit("neutral"), F.lit(1.0))).otherwise(entries)


def map_total(m: Column) -> Column:
    return F.aggregate(F.map_values(m), F.lit(0.0), lambda a, v: a + v)


def rescale_map(m: Column) -> Column:
    """Weights divided by their sum; equal shares if the sum is zero."""
    s = map_total(m)
    return F.transform_values(
        m, lambda k, v: F.coalesce(div(v, s), 1.0 / F.size(m).cast("double"))
    )


def drop_source(m: Column, source: str) -> Column:
    """Remove one source and rescale the others to sum to one."""
    return rescale_map(F.map_filter(m, lambda k, v: k != source))


def sums_to_one(m: Column, tolerance: float = 0.001) -> Column:
    return F.abs(map_total(m) - 1.0) <= tolerance


def missing_sources(m: Column, required) -> Column:
    return F.array_except(F.array(*[F.lit(s) for s in required]), F.map_keys(m))


def extra_sources(m: Column, required) -> Column:
    return F.array_except(F.map_keys(m), F.array(*[F.lit(s) for s in required]))


def valid_custom(m: Column, required) -> Column:
    """Exactly the required keys, nothing negative, sum of one within .001."""
    return (
        (F.size(missing_sources(m, required)) == 0)
        & (F.size(extra_sources(m, required)) == 0)
        & F.forall(F.map_values(m), lambda v: v >= 0)
        & sums_to_one(m)
    )


def coverage_class(m: Column) -> Column:
    n = F.size(m)
    return F.when(n == 5, "Excellent").when(n >= 4, "Good").when(n >= 3, "Moderate").otherwise("Limited")


def coverage_badge(m: Column) -> Column:
    n = F.size(m)
    color = F.when(n == 5, "green").when(n >= 3, "yellow").otherwise("red")
    return F.concat(n.cast("string"), F.lit("/5 "), color)
