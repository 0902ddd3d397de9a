"""Growth rates and growth quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.functions.numeric import clamp, div, notes
from quantloom.operators.fundamentals import latest_period
from quantloom.operators.series import by_day, with_yoy

TREND_ITEMS = {"revenue": "total_revenue", "net_income": "net_income", "eps": "eps", "fcf": "free_cash_flow"}
# Growth bands and metric weights.
HIGH, MODERATE = 0.15, 0.05
SCORE_WEIGHTS = {
    "revenue_growth": 0.30, "earnings_growth": 0.30, "eps_growth": 0.20,
    "fcf_growth": 0.10, "asset_growth": 0.05, "equity_growth": 0.05,
}


def cagr(first: Column, last: Column, periods: Column) -> Column:
    """(last/first)^(1/periods) - 1; zero for non-positive ends, NULL without a full period."""
    ok = (first > 0) & (last > 0)
    ratio = F.when(ok, last / F.nullif(first, F.lit(0.0)))
    return F.when(periods >= 1, F.coalesce(F.pow(ratio, 1.0 / F.nullif(periods, F.lit(0))) - 1, F.lit(0.0)))


def with_eps(facts: DataFrame) -> DataFrame:
    if "eps" in facts.columns:
        return facts
    return facts.withColumn("eps", div("net_income", F.col("shares_outstanding").cast("double")))


def trends(facts: DataFrame) -> DataFrame:
    """CAGR and mean year-over-year change per item, oldest to newest, in one grouped pass."""
    f = with_yoy(with_eps(facts), list(TREND_ITEMS.values()))
    n = F.count("*") - 1
    return f.groupBy("ticker").agg(
        n.alias("periods"),
        *[
            e
            for name, item in TREND_ITEMS.items()
            for e in (
                cagr(F.min_by(item, "period_end"), F.max_by(item, "period_end"), n).alias(f"{name}_cagr"),
                F.avg(f"{item}_yoy").alias(f"{name}_avg_yoy"),
                F.stddev_samp(f"{item}_yoy").alias(f"{name}_std_yoy"),
            )
        ],
    )


LATEST_ITEMS = {
    "revenue_growth": "total_revenue", "earnings_growth": "net_income", "eps_growth": "eps",
    "fcf_growth": "free_cash_flow", "asset_growth": "total_assets", "equity_growth": "total_stockholder_equity",
}


def change_on_previous(item: str, w) -> Column:
    """(x - previous) / |previous|, zero if undefined."""
    return F.coalesce(div(F.col(item) - F.lag(item).over(w), F.abs(F.lag(item).over(w))), F.lit(0.0))


def company_profile(facts: DataFrame) -> DataFrame:
    """Latest period of every company with its trends, latest growth and the interest to use.

    Everything is a window over the same (ticker, period_end) sort, so health,
    growth, valuation and risk can all be projected from one pass over the
    statements instead of joining separate passes.
    """
    w = by_day("ticker", "period_end")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    n = F.count("*").over(whole) - 1
    earlier = F.nullif(F.col("interest_expense"), F.lit(0.0))
    f = with_yoy(with_eps(facts), list(TREND_ITEMS.values())).withColumns(
        {
            "interest_used": F.coalesce("interest_expense", F.lag(earlier, 1).over(w), F.lag(earlier, 2).over(w)),
            "_newer": F.lead("period_end").over(w),
            **{name: change_on_previous(item, w) for name, item in LATEST_ITEMS.items()},
        }
    )
    f = f.withColumns(
        {
            "periods": n,
            **{f"{k}_cagr": cagr(F.first(i).over(whole), F.last(i).over(whole), n) for k, i in TREND_ITEMS.items()},
            **{f"{k}_avg_yoy": F.avg(f"{i}_yoy").over(whole) for k, i in TREND_ITEMS.items()},
            **{f"{k}_std_yoy": F.stddev_samp(f"{i}_yoy").over(whole) for k, i in TREND_ITEMS.items()},
        }
    )
    return f.where(F.col("_newer").isNull()).drop("_newer", *[f"{i}_yoy" for i in TREND_ITEMS.values()])


def quality(t: DataFrame) -> DataFrame:
    """0..5 score, class and stability from the trends."""
    def pts(c: str, high: float, mid: float) -> Column:
        return F.when(F.col(c) >= HIGH, high).when(F.col(c) >= MODERATE, mid).otherwise(0.0)

    score = pts("revenue_cagr", 2.0, 1.0) + pts("net_income_cagr", 2.0, 1.0) + pts("fcf_cagr", 1.0, 0.5)
    unstable = F.abs(F.col("revenue_avg_yoy") - F.col("revenue_cagr")) > 0.1
    g = t.withColumns({"growth_score": score, "stability_flags": notes((unstable, "Unstable revenue growth"))})
    return g.withColumns(
        {
            "growth_classification": classify(F.col("growth_score"), 4.0, 2.0),
            "growth_stability": F.when(F.size("stability_flags") == 0, "Stable Growth").otherwise("Unstable Growth"),
        }
    )


def classify(score: Column, high: float, moderate: float) -> Column:
    return (
        F.when(score >= high, "High Growth").when(score >= moderate, "Moderate Growth").otherwise("Low/Negative Growth")
    )


def latest_growth(facts: DataFrame) -> DataFrame:
    """Change of the newest over the previous period relative to its absolute size; 0 if undefined."""
    w = by_day("ticker", "period_end")
    f = with_eps(facts).withColumns({name: change_on_previous(c, w) for name, c in LATEST_ITEMS.items()})
    return latest_period(f).select("ticker", *LATEST_ITEMS)


def growth_score(metrics=tuple(SCORE_WEIGHTS)) -> Column:
    """Weighted mean of the growth percentages clipped to 0..100, zero metrics left out."""
    mass, total = F.lit(0.0), F.lit(0.0)
    for m in metrics:
        on = F.col(m) != 0
        total = total + F.when(on, clamp(F.col(m) * 100, 0.0, 100.0) * SCORE_WEIGHTS[m]).otherwise(0.0)
        mass = mass + F.when(on, SCORE_WEIGHTS[m]).otherwise(0.0)
    return div(total, mass, 0.0)


def growth_report(facts: DataFrame, metrics=("revenue_growth", "earnings_growth", "eps_growth")) -> DataFrame:
    g = latest_growth(facts).withColumn("growth_score", growth_score(metrics))
    return g.withColumn("growth_class", classify(F.col("growth_score"), 80.0, 50.0))
