"""Ratios and health scores over wide statements (one row per ticker and period).

Statements are unique on (ticker, period_end): a ticker's partition is its
handful of reporting periods.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.functions.numeric import col, div, notes


def optional(df: DataFrame, name: str, default: float | None = 0.0) -> Column:
    """The column, or a constant where the statements do not carry the item."""
    return F.col(name) if name in df.columns else F.lit(default).cast("double")


def latest_period(facts: DataFrame, key="ticker", ts="period_end") -> DataFrame:
    w = W.partitionBy(key).orderBy(F.desc(ts))
    return facts.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def latest_periods(facts: DataFrame, n: int = 8, keys=("ticker",), ts="period_end") -> DataFrame:
    w = W.partitionBy(*keys).orderBy(F.desc(ts))
    return facts.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def interest_with_fallback(key="ticker", ts="period_end") -> Column:
    """Interest expense, a missing one replaced by the nearest non-zero of the two earlier years."""
    w = W.partitionBy(key).orderBy(F.desc(ts))
    ie = F.col("interest_expense")
    earlier = F.nullif(ie, F.lit(0.0))
    return F.coalesce(ie, F.lead(earlier, 1).over(w), F.lead(earlier, 2).over(w))


BASIC = ("working_capital", "debt_to_equity", "current_ratio", "quick_ratio", "roa", "roe",
         "gross_margin", "operating_margin", "net_margin")


def basic_ratios(now: DataFrame) -> DataFrame:
    """Nine ratios of the latest period; zero where a denominator is zero or an item is missing."""
    c = {n: F.coalesce(optional(now, n), F.lit(0.0)) for n in (
        "total_current_assets", "total_current_liabilities", "long_term_debt", "short_term_debt", "inventory",
        "total_stockholder_equity", "net_income", "total_assets", "gross_profit", "operating_income", "total_revenue")}
    r = {
        "working_capital": c["total_current_assets"] - c["total_current_liabilities"],
        "debt_to_equity": div(c["long_term_debt"] + c["short_term_debt"], c["total_stockholder_equity"], 0),
        "current_ratio": div(c["total_current_assets"], c["total_current_liabilities"], 0),
        "quick_ratio": div(c["total_current_assets"] - c["inventory"], c["total_current_liabilities"], 0),
        "roa": div(c["net_income"], c["total_assets"], 0),
        "roe": div(c["net_income"], c["total_stockholder_equity"], 0),
        "gross_margin": div(c["gross_profit"], c["total_revenue"], 0),
        "operating_margin": div(c["operating_income"], c["total_revenue"], 0),
        "net_margin": div(c["net_income"], c["total_revenue"], 0),
    }
    return now.select("ticker", *[r[n].alias(n) for n in BASIC])


HEALTH_RATIOS = ("current_ratio", "debt_to_equity", "debt_to_assets", "interest_coverage", "return_on_equity",
                 "return_on_assets", "gross_margin", "operating_margin", "net_margin")


def health_ratio_columns() -> dict[str, Column]:
    """The nine health ratios of a row that carries ``interest_used``; NULL when a denominator is zero."""
    return {
        "current_ratio": div("total_current_assets", "total_current_liabilities"),
        "debt_to_equity": div("total_liabilities", "total_stockholder_equity"),
        "debt_to_assets": div("total_liabilities", "total_assets"),
        "interest_coverage": div("operating_income", "interest_used"),
        "return_on_equity": div("net_income", "total_stockholder_equity"),
        "return_on_assets": div("net_income", "total_assets"),
        "gross_margin": div("gross_profit", "total_revenue"),
        "operating_margin": div("operating_income", "total_revenue"),
        "net_margin": div("net_income", "total_revenue"),
    }


def with_health_ratios(facts: DataFrame) -> DataFrame:
    """Latest period with the nine health ratios."""
    now = latest_period(facts.withColumn("interest_used", interest_with_fallback()))
    return now.withColumns(health_ratio_columns())


def piotroski() -> Column:
    """Seven level tests on the latest period (0..7)."""
    tests = [
        F.col("net_income") > 0,
        F.col("operating_cash_flow") > 0,
        div("net_income", "total_assets") > 0,
        div("long_term_debt", "total_assets") < 0.4,
        div("total_current_assets", "total_current_liabilities") > 1,
        div("gross_profit", "total_revenue") > 0.2,
        div("total_revenue", "total_assets") > 0.1,
    ]
    score = F.lit(0)
    for t in tests:
        score = score + F.coalesce(t, F.lit(False)).cast("int")
    return score


def altman_z() -> Column:
    """Z with the liabilities/assets form of the fourth term; 0 if assets are zero or an item is missing."""
    a = F.nullif(F.col("total_assets"), F.lit(0.0))
    z = (
        1.2 * (F.col("total_current_assets") - F.col("total_current_liabilities")) / a
        + 1.4 * F.col("retained_earnings") / a
        + 3.3 * F.col("operating_income") / a
        + 0.6 * F.col("total_liabilities") / a
        + 1.0 * F.col("total_revenue") / a
    )
    return F.coalesce(z, F.lit(0.0))


def health_flags(p: Column, z: Column) -> Column:
    """Text flags; a missing ratio counts as zero."""
    cr, de, roe, om = (
        F.coalesce(c, F.lit(0.0)) for c in ("current_ratio", "debt_to_equity", "return_on_equity", "operating_margin")
    )
    return notes(
        (p >= 7, "Strong financial health (Piotroski score >= 7)"),
        (p <= 3, "Weak financial health (Piotroski score <= 3)"),
        (z > 2.99, "Low bankruptcy risk (Altman Z-score > 2.99)"),
        (z < 1.81, "High bankruptcy risk (Altman Z-score < 1.81)"),
        (cr < 1.0, "Low liquidity (Current ratio < 1.0)"),
        (cr > 2.0, "Excess liquidity (Current ratio > 2.0)"),
        (de > 1.0, "High leverage (Debt/Equity > 1.0)"),
        (roe < 0.1, "Low return on equity (< 10%)"),
        (roe > 0.2, "Strong return on equity (> 20%)"),
        (om < 0.1, "Low operating margin (< 10%)"),
        (om > 0.2, "Strong operating margin (> 20%)"),
    )


def health_report(facts: DataFrame) -> DataFrame:
    """ticker, scores, ratios struct and flags of the latest period."""
    h = with_health_ratios(facts).withColumns({"piotroski_score": piotroski(), "altman_z_score": altman_z()})
    return h.select(
        "ticker", "period_end", "piotroski_score", "altman_z_score",
        F.struct(*HEALTH_RATIOS).alias("financial_ratios"),
        health_flags(F.col("piotroski_score"), F.col("altman_z_score")).alias("health_flags"),
    )


def last_ratio(facts: DataFrame, numerator: str, denominator: str, default: float = 0.0) -> DataFrame:
    """Ratio of the last period, ``default`` plus a reason when it cannot be formed."""
    missing = [c for c in (numerator, denominator) if c not in facts.columns]
    if missing:
        return latest_period(facts).select(
            "ticker", F.lit(default).alias("ratio"),
            F.lit(f"Missing columns for ratio calculation: {numerator}/{denominator}").alias("reason"),
        )
    now = latest_period(facts)
    zero = F.coalesce(F.col(denominator) == 0, F.lit(True))
    return now.select(
        "ticker",
        F.when(zero, F.lit(default)).otherwise(div(col(numerator), col(denominator))).alias("ratio"),
        F.when(zero, f"Zero denominator in ratio calculation: {denominator}").alias("reason"),
    )
