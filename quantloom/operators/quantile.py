"""Exact quantiles of groups that may not fit in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def grouped_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float],
                      accuracy: int = 10_000, extra: dict[str, Column] | None = None) -> DataFrame:
    """Linear-interpolation quantiles ``{name: q}`` per group, plus ``n``; exact at any group size.

    ``extra`` aggregates over ``value`` (named by key) ride along in the sketch pass.

    A mergeable sketch gives values around every wanted rank, the nearest ones 2/accuracy of the group away and each next
    one four times as far.  Of those on either side the nearest is taken whose rank, by the sketch's error bound of n/accuracy,
    certainly lies beyond the wanted order statistics; where none does, as in every small group, that side stays open.
    Rows above the bracket are dropped, rows below it are collapsed to one counted row on the map side, and only the
    distinct values inside are ordered.  Nothing collects a group: the hottest task sorts about n * 4/accuracy values.
    Each group has one sketch row, so a join that is not broadcast can be split on the rows' side where a group is hot.
    """
    extra = extra or {}
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    steps = [2.0 / accuracy * 4**k for k in range(16) if 2.0 / accuracy * 4**k < 1]
    names = list(probs)
    below = {n: [probs[n] - s for s in steps if probs[n] - s > 0] for n in names}
    above = {n: [probs[n] + s for s in steps if probs[n] + s < 1] for n in names}
    edges = sorted({e for n in names for e in below[n] + above[n]}) or [0.5]
    sketch = rows.groupBy(*keys).agg(
        F.count("*").alias("_n"),
        F.percentile_approx("_v", edges, accuracy).alias("_e"),
        *[e.alias(f"_x_{n}") for n, e in extra.items()],
    )

    def nearest(candidates: list[float], safe, open_end: float) -> Column:
        out = F.lit(open_end)
        for e in reversed(candidates):  # the first candidate, the nearest, is tested first
            out = F.when(safe(e), F.col("_e")[edges.index(e)]).otherwise(out)
        return out

    wanted = []
    for name in names:
        h = F.lit(probs[name]) * (F.col("_n") - 1)
        # ranks from 1: the sketch's value at e has a rank between floor((e - 1/accuracy) n) and ceil((e + 1/accuracy) n)
        lo = nearest(below[name], lambda e: F.lit(e + 1 / accuracy) * F.col("_n") <= F.floor(h), float("-inf"))  # noqa: B023
        hi = nearest(above[name], lambda e: F.lit(e - 1 / accuracy) * F.col("_n") >= F.ceil(h) + 2, float("inf"))  # noqa: B023
        wanted.append(F.struct(F.lit(name).alias("name"), lo.alias("lo"), hi.alias("hi"), h.alias("h")))
    wanted = F.explode(F.array(*wanted)).alias("_w")
    carried = ["_n", *[f"_x_{n}" for n in extra]]
    near = (
        rows.join(sketch, keys)
        .select(*keys, "_v", "_n", *[f"_x_{n}" for n in extra], wanted)
        .where(F.col("_v") <= F.col("_w.hi"))
        .groupBy(
            *keys, *carried, F.col("_w.name").alias("_name"), F.col("_w.h").alias("_h"),
            F.when(F.col("_v") < F.col("_w.lo"), float("-inf")).otherwise(F.col("_v")).alias("_v"),
        )
        .agg(F.count("*").alias("_c"))
    )
    upto = F.sum("_c").over(
        W.partitionBy(*keys, "_name").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    )
    ordered = near.withColumn("_upto", upto)
    lower = F.min(F.when(F.col("_upto") > F.floor("_h"), F.col("_v")))
    upper = F.min(F.when(F.col("_upto") > F.ceil("_h"), F.col("_v")))
    points = ordered.groupBy(*keys, *carried, "_name", "_h").agg(
        (lower + (F.col("_h") - F.floor("_h")) * (upper - lower)).alias("_q")
    )
    return points.groupBy(*keys, F.col("_n").alias("n"), *[F.col(f"_x_{n}").alias(n) for n in extra]).agg(
        *[F.max(F.when(F.col("_name") == n, F.col("_q"))).alias(n) for n in names]
    )
