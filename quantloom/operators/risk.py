"""Market, financial and business risk, and the two composite scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.formatting import fixed
from quantloom.functions.numeric import div, ladder, notes
from quantloom.operators.series import with_yoy
from quantloom.operators.valuation import pct


def financial_risk(now: DataFrame) -> DataFrame:
    """D/E, D/A and coverage; NULL stands for an infinite ratio."""
    return now.select(
        "ticker",
        div("long_term_debt", "total_stockholder_equity").alias("debt_to_equity"),
        div("long_term_debt", "total_assets").alias("debt_to_assets"),
        div("operating_income", "interest_expense").alias("interest_coverage"),
    )


def business_risk(facts: DataFrame) -> DataFrame:
    """Revenue volatility and mean operating leverage over a company's periods."""
    y = with_yoy(facts, ["total_revenue", "operating_income"])
    return y.groupBy("ticker").agg(
        F.stddev_samp("total_revenue_yoy").alias("revenue_volatility"),
        F.avg(div("operating_income_yoy", "total_revenue_yoy")).alias("operating_leverage"),
    )


def composite_score() -> Column:
    """0..100 from volatility, beta, drawdown, leverage, coverage, revenue volatility and operating leverage."""
    def part(c: Column, weight: float) -> Column:
        return F.coalesce(F.least(c, F.lit(100.0)), F.lit(0.0)) * weight

    market = (
        part(F.col("volatility") * 100, 0.4) + part(F.abs("beta") * 20, 0.3) + part(F.abs("max_drawdown") * 200, 0.3)
    )
    # an infinite D/E is worth the cap, an infinite coverage nothing
    de = F.when(F.col("debt_to_equity").isNull(), 40.0).otherwise(F.least(F.col("debt_to_equity") * 20, F.lit(100.0)) * 0.4)
    cover = F.coalesce(F.least(div(F.lit(100.0), "interest_coverage"), F.lit(100.0)), F.lit(0.0)) * 0.6
    business = part(F.col("revenue_volatility") * 200, 0.5) + part(F.abs("operating_leverage") * 20, 0.5)
    return market * 0.4 + (de + cover) * 0.35 + business * 0.25


def five_levels(score: Column) -> Column:
    return ladder(score, [(20.0, "Very Low"), (40.0, "Low"), (60.0, "Moderate"), (80.0, "High")], "Very High", "<")


def risk_report(now: DataFrame) -> DataFrame:
    """Score, level, factors and warnings per ticker.

    ``now`` is the latest period of each ticker with beta and volatility attached (either may be NULL).  A missing
    component takes its neutral value only if another of its group is known;
    a group without any component scores zero and is reported as a warning.
    """
    j = now.withColumns(
        {
            "debt_to_equity": div("total_liabilities", "total_stockholder_equity"),
            "interest_coverage": div("operating_income", "interest_expense"),
            "operating_margin": div("operating_income", "total_revenue"),
            "revenue": F.when(F.col("total_revenue") > 0, F.col("total_revenue")),
        }
    )
    beta, vol = F.col("beta"), F.col("volatility")
    de, ic = F.col("debt_to_equity"), F.col("interest_coverage")
    om, rev = F.col("operating_margin"), F.col("revenue")
    has_m = beta.isNotNull() | vol.isNotNull()
    has_f = de.isNotNull() | ic.isNotNull()
    has_b = om.isNotNull() | rev.isNotNull()
    b1, v1 = F.coalesce(beta, F.lit(1.0)), F.coalesce(vol, F.lit(0.2))
    d1, i1 = F.coalesce(de, F.lit(0.5)), F.coalesce(ic, F.lit(3.0))
    o1, r1 = F.coalesce(om, F.lit(0.15)), F.coalesce(rev, F.lit(1e9))
    zero = F.lit(0.0)
    m = (F.least(F.abs(b1 - 1.0) * 2, F.lit(2.0)) / 2.0 + F.least(v1 * 2, F.lit(1.0))) / 2
    f = (F.least(d1, F.lit(2.0)) / 2.0 + F.greatest(zero, 1 - i1 / 5.0)) / 2
    b = (F.greatest(zero, 1 - o1 / 0.3) + F.greatest(zero, 1 - r1 / 1e10)) / 2
    j = j.withColumns(
        {
            "market_score": F.when(has_m, m).otherwise(zero),
            "financial_score": F.when(has_f, f).otherwise(zero),
            "business_score": F.when(has_b, b).otherwise(zero),
        }
    ).withColumn(
        "score",
        (F.col("market_score") * 0.3 + F.col("financial_score") * 0.4 + F.col("business_score") * 0.3) * 100,
    )
    s = F.col("score")
    millions = fixed(r1 / 1e6, 0)
    factors = notes(
        (s >= 70, "High risk due to combination of market volatility, financial leverage, and business challenges"),
        ((s >= 40) & (s < 70), "Moderate risk with some concerns in financial health or market exposure"),
        (s < 40, "Low risk with stable financials and manageable market exposure"),
        (beta > 1.5, "High market sensitivity (beta > 1.5)"),
        (beta < 0.5, "Low market sensitivity (beta < 0.5)"),
        (vol > 0.4, "High price volatility (> 40%)"),
        (vol < 0.1, "Low price volatility (< 10%)"),
        (de > 1.0, "High leverage (D/E > 1.0)"),
        (ic < 1.0, "Low interest coverage (< 1.0)"),
        (om < 0.1, "Low operating margin (< 10%)"),
        (rev < 1e9, "Small revenue base (< $1B)"),
        (has_m & (b1 > 1.5), fixed(b1, 2, "Beta of %s indicates high volatility relative to market")),
        (has_m & (b1 < 0.5), fixed(b1, 2, "Beta of %s indicates low correlation with market")),
        (has_m & (v1 > 0.4), F.concat(F.lit("Annual volatility of "), pct(v1), F.lit(" is very high"))),
        (has_m & (v1 > 0.3) & (v1 <= 0.4), F.concat(F.lit("Annual volatility of "), pct(v1), F.lit(" is above average"))),
        (has_f & (d1 > 2.0), fixed(d1, 2, "Debt-to-equity ratio of %s indicates very high leverage")),
        (has_f & (d1 > 1.0) & (d1 <= 2.0), fixed(d1, 2, "Debt-to-equity ratio of %s indicates significant leverage")),
        (has_f & (i1 < 1.5), fixed(i1, 2, "Interest coverage of %sx is dangerously low")),
        (has_f & (i1 >= 1.5) & (i1 < 3.0), fixed(i1, 2, "Interest coverage of %sx may be insufficient in downturns")),
        (has_b & (o1 < 0.05), F.concat(F.lit("Operating margin of "), pct(o1), F.lit(" is very low"))),
        (has_b & (o1 >= 0.05) & (o1 < 0.10), F.concat(F.lit("Operating margin of "), pct(o1), F.lit(" is below healthy levels"))),
        (has_b & (r1 < 1e8), F.concat(F.lit("Small company with revenue of $"), millions, F.lit("M"))),
        (has_b & (r1 >= 1e8) & (r1 < 1e9), F.concat(F.lit("Mid-size company with revenue of $"), millions, F.lit("M"))),
    )
    warnings = notes(
        (beta.isNull(), "Beta not available in fundamentals data"),
        (vol.isNull(), "Price data not available for volatility calculation"),
        (F.coalesce(F.col("total_stockholder_equity"), zero) == 0, "Total Stockholder Equity is zero"),
        (F.coalesce(F.col("interest_expense"), zero) == 0, "Interest Expense is zero"),
        (F.coalesce(F.col("total_revenue"), zero) == 0, "Total Revenue is zero"),
        (rev.isNull(), "Total Revenue is zero or negative"),
        (~has_m, "Market risk metrics not available for score calculation"),
        (~has_f, "Financial risk metrics not available for score calculation"),
        (~has_b, "Business risk metrics not available for score calculation"),
    )
    level = ladder(s, [(70.0, "High"), (40.0, "Moderate")], "Low")
    return j.select(
        "ticker", "market_score", "financial_score", "business_score", "score",
        level.alias("level"), factors.alias("factors"), warnings.alias("warnings"),
    )
