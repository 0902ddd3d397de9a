"""Definitions of the metrics and strategies the library computes, as a small dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# (key, name, category, description, formula)
METRICS = [
    ("revenue_growth", "Revenue Growth Rate", "growth",
     "Change of sales against the previous year", "(revenue - previous revenue) / |previous revenue|"),
    ("earnings_growth", "Earnings Growth Rate", "growth", "Change of net income against the previous year", "(net income - previous) / |previous|"),
    ("eps_growth", "Earnings Per Share (EPS) Growth", "growth",
     "Change of the profit attributed to one share", "(EPS - previous EPS) / |previous EPS|"),
    ("revenue_cagr", "Revenue Compound Annual Growth Rate (CAGR)", "growth",
     "Constant yearly rate linking first and last sales", "(last / first) ^ (1 / years) - 1"),
    ("fcf_growth", "Free Cash Flow Growth", "growth", "Change of free cash flow against the previous year", "(FCF - previous FCF) / |previous FCF|"),
    ("pe_ratio", "Price-to-Earnings Ratio (P/E)", "value", "Price paid for one unit of yearly profit", "price / EPS"),
    ("pb_ratio", "Price-to-Book Ratio (P/B)", "value", "Price paid for one unit of equity", "market cap / equity"),
    ("peg_ratio", "Price/Earnings-to-Growth Ratio (PEG)", "value", "P/E put in relation to expected growth", "P/E / growth in percent"),
    ("intrinsic_value", "Intrinsic Value (DCF)", "value",
     "Present worth of the cash flows a company will produce", "discounted flows + terminal value"),
    ("margin_of_safety", "Margin of Safety", "value", "Discount of the price to the intrinsic value", "(value - price) / value"),
    ("current_ratio", "Current Ratio", "health", "Short-term assets per unit of short-term debt", "current assets / current liabilities"),
    ("quick_ratio", "Quick Ratio", "health", "Liquidity without selling inventory", "(current assets - inventory) / current liabilities"),
    ("debt_to_equity", "Debt-to-Equity Ratio", "health", "Borrowed against own capital", "debt / equity"),
    ("debt_to_assets", "Debt-to-Assets Ratio", "health", "Share of assets financed by debt", "liabilities / assets"),
    ("interest_coverage", "Interest Coverage Ratio", "health", "How often operating profit pays the interest", "operating income / interest expense"),
    ("return_on_equity", "Return on Equity (ROE)", "health", "Profit earned on own capital", "net income / equity"),
    ("return_on_assets", "Return on Assets (ROA)", "health", "Profit earned on everything owned", "net income / assets"),
    ("gross_margin", "Gross Profit Margin", "health", "Share of sales left after direct cost", "gross profit / revenue"),
    ("operating_margin", "Operating Profit Margin", "health", "Share of sales left after operating cost", "operating income / revenue"),
    ("net_margin", "Net Profit Margin", "health", "Share of sales left at the end", "net income / revenue"),
    ("piotroski_score", "Piotroski Score", "health", "Count of passed financial strength tests", "sum of passed tests"),
    ("altman_z_score", "Altman Z-Score", "health", "Weighted ratios warning of bankruptcy", "1.2 A + 1.4 B + 3.3 C + 0.6 D + 1.0 E"),
    ("beta", "Beta", "risk", "Sensitivity of the share to the market", "cov(asset, market) / var(market)"),
    ("volatility", "Annualized Volatility", "risk", "Spread of returns scaled to a year", "std(returns) * sqrt(252)"),
    ("value_at_risk", "Value at Risk (95%)", "risk", "Loss not exceeded on 95 of 100 days", "5th percentile of returns"),
    ("max_drawdown", "Maximum Drawdown", "risk", "Deepest fall from a previous peak", "min(value / running peak - 1)"),
]

# (key, name, market outlook, risk profile)
STRATEGIES = [
    ("long_calls", "Long Calls", "Bullish", "Limited risk, unlimited profit"),
    ("long_puts", "Long Puts", "Bearish", "Limited risk, high profit"),
    ("covered_call", "Covered Call", "Neutral to slightly bullish", "Reduced stock risk, limited upside"),
    ("cash_secured_put", "Cash-Secured Put", "Neutral to bullish", "Moderate risk"),
    ("bull_call_spread", "Bull Call Spread", "Moderately bullish", "Limited risk and reward"),
    ("bear_put_spread", "Bear Put Spread", "Moderately bearish", "Limited risk and reward"),
    ("bull_put_spread", "Bull Put Spread", "Bullish", "Limited risk, limited reward"),
    ("bear_call_spread", "Bear Call Spread", "Bearish", "Limited risk, limited reward"),
    ("iron_condor", "Iron Condor", "Neutral within a range", "Limited risk and reward"),
    ("iron_butterfly", "Iron Butterfly", "Neutral at the current price", "Limited risk and reward"),
    ("calendar_spread", "Calendar Spread", "Neutral near the strike", "Limited risk"),
    ("long_straddle", "Long Straddle", "Neutral direction, high volatility", "Limited risk, unlimited profit"),
    ("long_strangle", "Long Strangle", "Neutral direction, very high volatility", "Limited risk, unlimited profit"),
    ("short_straddle", "Short Straddle", "Neutral, low volatility", "Limited profit, unlimited risk"),
    ("short_strangle", "Short Strangle", "Neutral between the strikes", "Limited profit, very high risk"),
]

# Words that a search for an outlook accepts.
OUTLOOK_WORDS = {
    "bullish": ["bullish", "bull"], "bearish": ["bearish", "bear"], "neutral": ["neutral", "range-bound", "low volatility"],
}


def metrics(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(METRICS, "key string, name string, category string, description string, formula string")


def strategies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STRATEGIES, "key string, name string, market_outlook string, risk_profile string")


def lookup(key: str) -> tuple[str, ...]:
    """One definition by key; KeyError lists what exists."""
    table = {r[0]: r for r in [*METRICS, *STRATEGIES]}
    if key not in table:
        raise KeyError(f"{key!r} is not defined; known: {', '.join(table)}")
    return table[key]
