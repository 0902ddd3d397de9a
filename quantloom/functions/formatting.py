"""Report formatting; for sinks only, never in the middle of a plan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quantloom.functions.numeric import col, finite, snap

NA = "N/A"


def fixed(c: Column | str, digits: int, pattern: str = "%s") -> Column:
    """Fixed decimals, rounded half up first so that every engine prints the same text.

    Rounding to six decimals before that keeps summation noise from flipping a tie.
    ``pattern`` is the surrounding text with ``%s`` for the number.
    """
    return F.format_string(pattern % f"%.{digits}f", snap(snap(c, 6), digits))


def currency_short(c: Column | str, digits: int = 2) -> Column:
    """$1.23B / M / K, plain below a thousand."""
    v = finite(col(c).cast("double"))
    a = F.abs(v)
    body = (
        F.when(a >= 1e9, F.concat(fixed(v / 1e9, digits), F.lit("B")))
        .when(a >= 1e6, F.concat(fixed(v / 1e6, digits), F.lit("M")))
        .when(a >= 1e3, F.concat(fixed(v / 1e3, digits), F.lit("K")))
        .otherwise(fixed(v, digits))
    )
    return F.when(v.isNull(), NA).otherwise(F.concat(F.lit("$"), body))


def currency(c: Column | str, digits: int = 2) -> Column:
    """$ with thousands separators."""
    v = finite(col(c).cast("double"))
    return F.when(v.isNull(), NA).otherwise(F.concat(F.lit("$"), F.format_string(f"%,.{digits}f", snap(snap(v, 6), digits))))


def percent(c: Column | str, digits: int = 1) -> Column:
    v = finite(col(c).cast("double"))
    return F.when(v.isNull(), NA).otherwise(F.concat(fixed(v * 100, digits), F.lit("%")))


def number(c: Column | str, digits: int = 2) -> Column:
    v = finite(col(c).cast("double"))
    return F.when(v.isNull(), NA).otherwise(fixed(v, digits))


# Status bands; the label of the first bound the value stays below.
STATUS_BANDS = {
    "pe_ratio": [(15.0, "good"), (25.0, "neutral"), (35.0, "warning")],
    "volatility": [(0.15, "good"), (0.25, "neutral"), (0.40, "warning")],
    "debt_to_equity": [(0.5, "good"), (1.0, "neutral"), (2.0, "warning")],
}


def status(c: Column | str, metric: str) -> Column:
    """good / neutral / warning / bad for a metric; unknown metrics and NULLs are neutral."""
    v = col(c)
    if metric == "margin_of_safety":
        s = F.when(v >= 0.15, "good").when(v >= -0.10, "warning").otherwise("bad")
    elif metric == "rsi":
        s = F.when(v < 30, "good").when(v > 70, "warning").otherwise("neutral")
    elif metric in STATUS_BANDS:
        bands = STATUS_BANDS[metric]
        s = F.when(v < bands[0][0], bands[0][1])
        for bound, label in bands[1:]:
            s = s.when(v < bound, label)
        s = s.otherwise("bad")
    else:
        s = F.lit("neutral")
    return F.when(v.isNull(), "neutral").otherwise(s)


def cell_class(c: Column | str, kind: str) -> Column:
    """green / orange / red emphasis of a report cell."""
    v = col(c)
    rules = {
        "rsi": F.when(v > 70, "red").when(v < 30, "green").otherwise("orange"),
        "score": F.when(v >= 0.7, "green").when(v >= 0.5, "orange").otherwise("red"),
        "iv": F.when(v <= 0.3, "green").when(v <= 0.5, "orange").otherwise("red"),
        "forecast": F.when(v >= 0.7, "green").when(v >= 0.4, "orange").otherwise("red"),
    }
    return F.when(v.isNull(), "").otherwise(rules[kind])
