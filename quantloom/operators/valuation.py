"""Free cash flow, the two discounted-cash-flow forms and valuation labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.formatting import fixed
from quantloom.functions.numeric import col, div, ladder, notes
from quantloom.operators.fundamentals import optional
from quantloom.operators.series import with_yoy

DEFAULT_SHARES = 1e10
DEFAULT_TAX = 0.21


def free_cash_flow(df: DataFrame) -> Column:
    """OCF - |capex|, else EBIT after tax + D&A, else net income + D&A."""
    ocf, capex = optional(df, "operating_cash_flow", None), optional(df, "capital_expenditure", None)
    ebit, ni = optional(df, "operating_income", None), optional(df, "net_income", None)
    tax, da = optional(df, "income_tax_expense", None), F.coalesce(optional(df, "depreciation"), F.lit(0.0))
    rate = F.coalesce(div(F.nullif(tax, F.lit(0.0)), ebit), F.lit(DEFAULT_TAX))
    return F.coalesce(ocf - F.abs(capex), ebit * (1 - rate) + da, ni + da)


def present_value(fcf: Column, growth: Column | float, discount: float, years: int) -> Column:
    """Sum of fcf growing by ``growth`` a year, each year discounted back."""
    g = growth if isinstance(growth, Column) else F.lit(float(growth))
    step = (1 + g) / (1 + discount)
    return fcf * F.aggregate(
        F.sequence(F.lit(1), F.lit(years)), F.lit(0.0), lambda acc, i: acc + F.pow(step, i.cast("double"))
    )


def shares_outstanding(df: DataFrame) -> tuple[Column, Column]:
    """(shares, where they came from): stated, market cap / price, balance sheet, default."""
    stated = optional(df, "shares_outstanding", None).cast("double")
    implied = div(F.nullif(optional(df, "market_cap", None), F.lit(0.0)), F.when(optional(df, "latest_price", None) > 0, optional(df, "latest_price", None)))
    sheet = optional(df, "balance_sheet_shares", None).cast("double")
    sheet = F.when(sheet > 0, sheet)
    source = (
        F.when(stated.isNotNull(), "fundamentals").when(implied.isNotNull(), "market_cap")
        .when(sheet.isNotNull(), "balance_sheet").otherwise("default")
    )
    return F.coalesce(stated, implied, sheet, F.lit(DEFAULT_SHARES)), source


def margin_of_safety(intrinsic: Column | str, price: Column | str, percent: bool = False) -> Column:
    """(value - price) / value; zero for non-positive inputs, or NULL in the percent form."""
    v, p = col(intrinsic), col(price)
    ok = (v > 0) & (p > 0)
    m = (v - p) / F.nullif(v, F.lit(0.0))
    if percent:
        return F.when(ok, m * 100)
    return F.when(ok, m).otherwise(0.0)


def dcf_undiscounted_terminal(companies: DataFrame, growth: float = 0.03, discount: float = 0.10, years: int = 10) -> DataFrame:
    """Per-share value with the terminal value taken at face value (form A).

    ``companies`` is one row per ticker: latest statements plus fundamentals.
    """
    if discount <= growth:
        raise ValueError("discount rate must exceed the growth rate")
    fcf = free_cash_flow(companies)
    shares, source = shares_outstanding(companies)
    debt = F.coalesce(optional(companies, "total_debt", None), optional(companies, "long_term_debt", None),
                      optional(companies, "total_liabilities", None), F.lit(0.0))
    cash = F.coalesce(optional(companies, "cash", None), F.lit(0.0))
    out = companies.withColumns({"fcf": fcf, "shares": shares, "shares_source": source})
    out = out.withColumns(
        {
            "terminal_value": F.col("fcf") * (1 + growth) / (discount - growth),
            "pv_flows": present_value(F.col("fcf"), growth, discount, years),
        }
    ).withColumn("enterprise_value", F.col("pv_flows") + F.col("terminal_value"))
    out = out.withColumn("equity_value", F.col("enterprise_value") - (debt - cash))
    out = out.withColumn("intrinsic_value", div("equity_value", "shares"))
    return out.withColumn("margin_of_safety_pct", margin_of_safety("intrinsic_value", "latest_price", percent=True))


def dcf_discounted(facts: DataFrame, discount: float = 0.10, terminal_growth: float = 0.03, years: int = 5,
                   conservative: float = 0.8) -> DataFrame:
    """Value from the company's own damped mean growth, terminal value discounted (form B).

    A company with a single period is projected flat.  The last known cash flow counts, and a statement without a period comes last.
    """
    y = with_yoy(facts, ["free_cash_flow"], ts=F.asc_nulls_last("period_end"))
    known = F.when(F.col("free_cash_flow").isNotNull(), F.col("period_end"))
    c = y.groupBy("ticker").agg(
        F.count("*").alias("n_periods"),
        F.max_by("free_cash_flow", known).alias("last_fcf"),
        (F.avg("free_cash_flow_yoy") * conservative).alias("_g"),
    )
    c = c.withColumn("growth", F.when(F.col("n_periods") < 2, 0.0).otherwise(F.col("_g"))).drop("_g")
    flow = F.col("last_fcf") * F.pow(1 + F.col("growth"), F.lit(float(years)))
    terminal = flow * (1 + terminal_growth) / (discount - terminal_growth)
    return c.withColumns(
        {
            "projected_cash_flows": F.transform(
                F.sequence(F.lit(1), F.lit(years)), lambda i: F.col("last_fcf") * F.pow(1 + F.col("growth"), i.cast("double"))
            ),
            "intrinsic_value": present_value(F.col("last_fcf"), F.col("growth"), discount, years)
            + terminal / (1 + discount) ** years,
        }
    )


def valuation_status(mos: Column) -> Column:
    return F.when(mos.isNull(), "unknown").otherwise(
        ladder(mos, [(0.25, "deeply_undervalued"), (0.10, "undervalued"), (0.0, "fairly_valued"), (-0.15, "slightly_overvalued")], "overvalued")
    )


def valuation_advice(mos: Column) -> Column:
    return F.when(mos.isNull(), "Insufficient data for valuation analysis").otherwise(
        ladder(
            mos,
            [
                (0.25, "Strong Buy - Significant margin of safety"),
                (0.10, "Buy - Good margin of safety"),
                (0.0, "Hold - Limited margin of safety"),
                (-0.15, "Caution - Consider waiting for better entry"),
            ],
            "Avoid - No margin of safety",
        )
    )


def summary_score(mos: Column, pe: Column) -> Column:
    """Mean of the band scores that are available; 50 with none."""
    m = F.when(mos >= 0.25, 100.0).when(mos >= 0.10, 80.0).when(mos >= 0, 60.0).when(mos >= -0.15, 40.0).when(mos.isNotNull(), 20.0)
    p = F.when(pe < 15, 80.0).when(pe < 25, 60.0).when(pe.isNotNull(), 40.0)
    n = m.isNotNull().cast("int") + p.isNotNull().cast("int")
    total = F.coalesce(m, F.lit(0.0)) + F.coalesce(p, F.lit(0.0))
    return F.when(n == 0, 50.0).otherwise(total / F.nullif(n, F.lit(0)))


def pe_signal(pe: Column) -> Column:
    return F.when(pe < 15, "Attractive").when(pe > 25, "Expensive").when(pe.isNotNull(), "Fair")


def peg_signal(peg: Column) -> Column:
    return F.when(peg < 1, "Undervalued").when(peg > 2, "Overvalued").when(peg.isNotNull(), "Fair")


def pb_signal(pb: Column) -> Column:
    return F.when(pb < 1, "Below Book Value").when(pb > 3, "Premium Valuation").when(pb.isNotNull(), "Normal")


def investment_rating(mos: Column) -> Column:
    return ladder(mos, [(0.25, "STRONG BUY"), (0.15, "BUY"), (0.05, "HOLD"), (-0.10, "WATCH")], "AVOID")


def volatility_level(vol: Column) -> Column:
    """NULL without a price series."""
    return F.when(vol.isNotNull(), ladder(vol, [(0.15, "Low"), (0.25, "Moderate"), (0.40, "High")], "Very High", "<"))


def pct(c: Column) -> Column:
    return fixed(c * 100, 1, "%s%%%%")


def thesis(mos: Column, growth: Column, roe: Column, de: Column, momentum: Column, vol: Column) -> Column:
    """Bullet texts in a fixed order; a missing ratio simply adds no bullet (missing D/E counts as 1)."""
    de = F.coalesce(de, F.lit(1.0))
    return notes(
        (mos >= 0.15, F.concat(F.lit("Stock appears undervalued with "), pct(mos), F.lit(" margin of safety"))),
        ((mos >= 0) & (mos < 0.15), F.concat(F.lit("Stock is fairly valued with limited "), pct(mos), F.lit(" margin of safety"))),
        (mos < 0, F.concat(F.lit("Stock appears overvalued by "), pct(F.abs(mos)))),
        (growth > 0.15, F.concat(F.lit("Strong revenue growth of "), pct(growth), F.lit(" indicates business expansion"))),
        ((growth > 0.05) & (growth <= 0.15), F.concat(F.lit("Moderate revenue growth of "), pct(growth), F.lit(" shows stable business"))),
        (roe > 0.15, F.concat(F.lit("High ROE of "), pct(roe), F.lit(" demonstrates efficient capital utilization"))),
        (de < 0.5, "Strong balance sheet with low debt levels provides financial flexibility"),
        (de > 1.5, "High debt levels may pose financial risk in economic downturns"),
        (momentum > 0.1, F.concat(F.lit("Positive price momentum of "), pct(momentum), F.lit(" suggests market confidence"))),
        (momentum < -0.1, F.concat(F.lit("Negative momentum of "), pct(momentum), F.lit(" may indicate market concerns"))),
        (vol > 0.3, F.concat(F.lit("High volatility of "), pct(vol), F.lit(" suggests increased investment risk"))),
    )


def radar_scores(mos: Column, growth: Column, roe: Column, de: Column, momentum: Column) -> dict[str, Column]:
    """Five 0..100 overview scores."""
    cap = lambda c: F.least(c, F.lit(100.0))
    return {
        "value_score": F.when(mos > 0, cap(mos * 200)).otherwise(0.0),
        "growth_axis": F.when(growth > 0, cap(growth * 500)).otherwise(50.0),
        "quality_score": F.when(roe > 0, cap(roe * 300)).otherwise(50.0),
        "financial_health": F.when(de < 0.5, 80.0).otherwise(50.0),
        "momentum_axis": F.when(momentum > 0, cap(momentum * 200 + 50)).otherwise(50.0),
    }
