"""Statement-based queries: ratios, health, valuation, growth, risk, recommendation."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions.numeric import div, snap
from quantloom.operators import fundamentals as fin
from quantloom.operators import growth as gro
from quantloom.operators import pairs as p
from quantloom.operators import recommend as rcm
from quantloom.operators import risk as rsk
from quantloom.operators import series as s
from quantloom.operators import valuation as val
from quantloom.plans import pair_queries  # noqa: F401  (registers the beta CTE)
from quantloom.plans import series_queries as sq
from quantloom.plans.common import Catalog, show
from quantloom.plans.oracle import r, rcols, register, sql
from quantloom.sources import bars
from quantloom.sources import bindings as b

CAT = Catalog()

register("fund", ("fnow",), """
SELECT f.ticker, CASE WHEN c_custkey % 11 <> 0 THEN 5 + abs(c_acctbal) / 1000 END AS latest_price,
  CASE WHEN c_custkey % 13 <> 0 THEN (5 + abs(c_acctbal) / 1000) * f.shares_outstanding END AS market_cap,
  CASE WHEN c_custkey % 7 <> 0 THEN CAST(f.shares_outstanding AS DOUBLE) END AS shares_stated,
  f.net_income / f.shares_outstanding AS eps,
  CASE WHEN f.net_income > 0 THEN (5 + abs(c_acctbal) / 1000) / (f.net_income / f.shares_outstanding) END AS pe_ratio,
  CASE WHEN f.net_income > 0 THEN (5 + abs(c_acctbal) / 1000) / (f.net_income / f.shares_outstanding) END / (1 + c_custkey % 30) AS peg_ratio,
  (5 + abs(c_acctbal) / 1000) * f.shares_outstanding / nullif(f.total_stockholder_equity, 0) AS price_to_book,
  CASE WHEN c_custkey % 9 <> 0 THEN 0.2 + CAST(c_custkey % 20 AS DOUBLE) / 10 END AS beta,
  CAST(c_custkey % 40 AS DOUBLE) / 1000 AS dividend_yield, c_mktsegment AS sector,
  CASE WHEN c_custkey % 17 <> 0 THEN concat(c_mktsegment, ' ', c_nationkey) END AS industry
FROM customer JOIN fnow f ON f.ticker = concat('C', c_custkey)""")


def q(a: str, d: str, default: str | None = "0") -> str:
    x = f"({a}) / nullif({d}, 0)"
    return x if default is None else f"coalesce({x}, {default})"


BASIC_SQL = {
    "working_capital": "total_current_assets - total_current_liabilities",
    "debt_to_equity": q("long_term_debt", "total_stockholder_equity"),
    "current_ratio": q("total_current_assets", "total_current_liabilities"),
    "quick_ratio": q("total_current_assets", "total_current_liabilities"),
    "roa": q("net_income", "total_assets"),
    "roe": q("net_income", "total_stockholder_equity"),
    "gross_margin": q("gross_profit", "total_revenue"),
    "operating_margin": q("operating_income", "total_revenue"),
    "net_margin": q("net_income", "total_revenue"),
}


@CAT.add("ratios", sql("fnow", "SELECT ticker, " + ", ".join(
    f"{r(e, 4 if n == 'working_capital' else 6)} AS {n}" for n, e in BASIC_SQL.items()) + " FROM fnow"))
def ratios(spark, sf):
    return show(fin.basic_ratios(fin.latest_period(b.facts(spark, sf))), places={"working_capital": 4})


register("gaps", ("facts",), """
SELECT * EXCLUDE (interest_expense), CASE WHEN (CAST(substr(ticker, 2) AS BIGINT) + year(period_end)) % 3 <> 0 THEN interest_expense END AS interest_expense
FROM facts""")
register("hnow", ("gaps",), f"""
SELECT *, {q('total_current_assets', 'total_current_liabilities', None)} AS current_ratio,
  {q('total_liabilities', 'total_stockholder_equity', None)} AS debt_to_equity, {q('total_liabilities', 'total_assets', None)} AS debt_to_assets,
  {q('operating_income', 'ie_used', None)} AS interest_coverage, {q('net_income', 'total_stockholder_equity', None)} AS return_on_equity,
  {q('net_income', 'total_assets', None)} AS return_on_assets, {q('gross_profit', 'total_revenue', None)} AS gross_margin,
  {q('operating_income', 'total_revenue', None)} AS operating_margin, {q('net_income', 'total_revenue', None)} AS net_margin,
  CAST(net_income > 0 AS INT) + CAST(operating_cash_flow > 0 AS INT) + CAST(net_income / total_assets > 0 AS INT) + CAST(long_term_debt / total_assets < 0.4 AS INT)
  + CAST(total_current_assets / total_current_liabilities > 1 AS INT) + CAST(gross_profit / total_revenue > 0.2 AS INT) + CAST(total_revenue / total_assets > 0.1 AS INT) AS piotroski_score,
  coalesce(1.2 * (total_current_assets - total_current_liabilities) / total_assets + 1.4 * retained_earnings / total_assets + 3.3 * operating_income / total_assets
  + 0.6 * total_liabilities / total_assets + 1.0 * total_revenue / total_assets, 0) AS altman_z_score
FROM (SELECT *, coalesce(interest_expense, lead(nullif(interest_expense, 0), 1) OVER w, lead(nullif(interest_expense, 0), 2) OVER w) AS ie_used,
             row_number() OVER w AS rn FROM gaps WINDOW w AS (PARTITION BY ticker ORDER BY period_end DESC)) x WHERE rn = 1""")
HR = " ".join(fin.HEALTH_RATIOS)


def with_gaps(facts):
    keep = (F.substr("ticker", F.lit(2)).cast("bigint") + F.year("period_end")) % 3 != 0
    return facts.withColumn("interest_expense", F.when(keep, F.col("interest_expense")))


@CAT.add("health_ratios", sql("hnow", f"SELECT ticker, {rcols(HR)} FROM hnow"))
def health_ratios(spark, sf):
    return show(fin.with_health_ratios(with_gaps(b.facts(spark, sf))).select("ticker", *fin.HEALTH_RATIOS))


FLAG_SQL = [
    ("piotroski_score >= 7", "Strong financial health (Piotroski score >= 7)"),
    ("piotroski_score <= 3", "Weak financial health (Piotroski score <= 3)"),
    ("altman_z_score > 2.99", "Low bankruptcy risk (Altman Z-score > 2.99)"),
    ("altman_z_score < 1.81", "High bankruptcy risk (Altman Z-score < 1.81)"),
    ("coalesce(current_ratio, 0) < 1.0", "Low liquidity (Current ratio < 1.0)"),
    ("coalesce(current_ratio, 0) > 2.0", "Excess liquidity (Current ratio > 2.0)"),
    ("coalesce(debt_to_equity, 0) > 1.0", "High leverage (Debt/Equity > 1.0)"),
    ("coalesce(return_on_equity, 0) < 0.1", "Low return on equity (< 10%)"),
    ("coalesce(return_on_equity, 0) > 0.2", "Strong return on equity (> 20%)"),
    ("coalesce(operating_margin, 0) < 0.1", "Low operating margin (< 10%)"),
    ("coalesce(operating_margin, 0) > 0.2", "Strong operating margin (> 20%)"),
]


def cases(rows: list[tuple[str, str]], quoted: bool = True) -> str:
    return "concat_ws('; ', " + ", ".join(
        f"CASE WHEN {c} THEN {chr(39) + t + chr(39) if quoted else t} END" for c, t in rows) + ")"


@CAT.add("health_scores", sql("hnow", f"""
SELECT ticker, CAST(period_end AS VARCHAR) AS period_end, piotroski_score, {rcols('altman_z_score')}, {cases(FLAG_SQL)} AS health_flags FROM hnow"""))
def health_scores(spark, sf):
    return show(fin.health_report(with_gaps(b.facts(spark, sf))).drop("financial_ratios"))


@CAT.add("altman", sql("hnow", f"""
SELECT ticker, {rcols('altman_z_score')}, CASE WHEN altman_z_score > 2.99 THEN 'safe' WHEN altman_z_score < 1.81 THEN 'distress' ELSE 'grey' END AS zone FROM hnow"""))
def altman(spark, sf):
    z = F.col("altman_z_score")
    t = fin.latest_period(b.facts(spark, sf)).withColumn("altman_z_score", fin.altman_z())
    return show(t.select("ticker", "altman_z_score", F.when(z > 2.99, "safe").when(z < 1.81, "distress").otherwise("grey").alias("zone")))


@CAT.add("generic_ratio", sql("fnow", f"""
SELECT ticker, {r('CASE WHEN d = 0 THEN -1 ELSE free_cash_flow / d END')} AS ratio,
  CASE WHEN d = 0 THEN 'Zero denominator in ratio calculation: operating_income' END AS reason
FROM (SELECT *, CASE WHEN operating_income < 0 THEN 0 ELSE operating_income END AS d FROM fnow) x"""))
def generic_ratio(spark, sf):
    f = b.facts(spark, sf).withColumn("operating_income", F.greatest(F.col("operating_income"), F.lit(0.0)))
    return show(fin.last_ratio(f, "free_cash_flow", "operating_income", default=-1.0))


# --- growth ------------------------------------------------------------------

register("yoy", ("facts",), """
SELECT *, total_revenue / nullif(lag(total_revenue) OVER w, 0) - 1 AS y_rev, net_income / nullif(lag(net_income) OVER w, 0) - 1 AS y_ni,
  eps / nullif(lag(eps) OVER w, 0) - 1 AS y_eps, free_cash_flow / nullif(lag(free_cash_flow) OVER w, 0) - 1 AS y_fcf,
  operating_income / nullif(lag(operating_income) OVER w, 0) - 1 AS y_ebit
FROM (SELECT *, net_income / nullif(shares_outstanding, 0) AS eps FROM facts) x WINDOW w AS (PARTITION BY ticker ORDER BY period_end)""")


def cagr_sql(c: str) -> str:
    a, z = f"min_by({c}, period_end)", f"max_by({c}, period_end)"
    return f"CASE WHEN count(*) > 1 THEN CASE WHEN {a} > 0 AND {z} > 0 THEN pow({z} / {a}, 1.0 / (count(*) - 1)) - 1 ELSE 0 END END"


TREND_COLS = {"revenue": ("total_revenue", "y_rev"), "net_income": ("net_income", "y_ni"), "eps": ("eps", "y_eps"), "fcf": ("free_cash_flow", "y_fcf")}
register("trend", ("yoy",), "SELECT ticker, count(*) - 1 AS periods, " + ", ".join(
    f"{cagr_sql(c)} AS {n}_cagr, avg({y}) AS {n}_avg_yoy, stddev_samp({y}) AS {n}_std_yoy" for n, (c, y) in TREND_COLS.items())
    + " FROM yoy GROUP BY ticker")
TREND_OUT = " ".join(f"{n}_{k}" for n in TREND_COLS for k in ("cagr", "avg_yoy", "std_yoy"))


@CAT.add("growth_trends", sql("trend", f"SELECT ticker, periods, {rcols(TREND_OUT, 4)} FROM trend"))
def growth_trends(spark, sf):
    return show(gro.trends(b.facts(spark, sf)), 4)


GPTS = """CASE WHEN revenue_cagr >= 0.15 THEN 2.0 WHEN revenue_cagr >= 0.05 THEN 1.0 ELSE 0 END
 + CASE WHEN net_income_cagr >= 0.15 THEN 2.0 WHEN net_income_cagr >= 0.05 THEN 1.0 ELSE 0 END
 + CASE WHEN fcf_cagr >= 0.15 THEN 1.0 WHEN fcf_cagr >= 0.05 THEN 0.5 ELSE 0 END"""
register("gq", ("trend",), f"""
SELECT *, CASE WHEN growth_score >= 4 THEN 'High Growth' WHEN growth_score >= 2 THEN 'Moderate Growth' ELSE 'Low/Negative Growth' END AS growth_classification,
  CASE WHEN abs(revenue_avg_yoy - revenue_cagr) > 0.1 THEN 'Unstable Growth' ELSE 'Stable Growth' END AS growth_stability
FROM (SELECT *, CAST({GPTS} AS DOUBLE) AS growth_score FROM trend) x""")


@CAT.add("growth_quality", sql("gq", "SELECT ticker, growth_score, growth_classification, growth_stability FROM gq"))
def growth_quality(spark, sf):
    return show(gro.quality(gro.trends(b.facts(spark, sf))).select(
        "ticker", "growth_score", "growth_classification", "growth_stability"))


G6 = {"revenue_growth": "total_revenue", "earnings_growth": "net_income", "eps_growth": "eps", "fcf_growth": "free_cash_flow",
      "asset_growth": "total_assets", "equity_growth": "total_stockholder_equity"}
register("g6", ("yoy",), "SELECT * FROM (SELECT ticker, " + ", ".join(
    f"coalesce(({c} - lag({c}) OVER w) / nullif(abs(lag({c}) OVER w), 0), 0) AS {n}" for n, c in G6.items()) + """,
  row_number() OVER (PARTITION BY ticker ORDER BY period_end DESC) AS rn FROM yoy WINDOW w AS (PARTITION BY ticker ORDER BY period_end)) x WHERE rn = 1""")


def gscore(metrics) -> str:
    a = " + ".join(f"CASE WHEN {m} <> 0 THEN least(100, greatest(0, {m} * 100)) * {gro.SCORE_WEIGHTS[m]} ELSE 0 END" for m in metrics)
    w = " + ".join(f"CASE WHEN {m} <> 0 THEN {gro.SCORE_WEIGHTS[m]} ELSE 0 END" for m in metrics)
    return f"coalesce(({a}) / nullif({w}, 0), 0)"


@CAT.add("growth_yoy", sql("g6", f"""
SELECT *, CASE WHEN growth_score >= 80 THEN 'High Growth' WHEN growth_score >= 50 THEN 'Moderate Growth' ELSE 'Low/Negative Growth' END AS growth_class
FROM (SELECT ticker, {rcols(' '.join(G6), 4)}, {r(gscore(list(G6)[:3]), 4)} AS growth_score, {r(gscore(list(G6)), 4)} AS growth_score_all FROM g6) x"""))
def growth_yoy(spark, sf):
    g = gro.growth_report(b.facts(spark, sf)).withColumn("growth_score_all", gro.growth_score())
    return show(g, 4)


# --- valuation ---------------------------------------------------------------

register("vnow", ("fnow", "fund"), """
SELECT n.* EXCLUDE (shares_outstanding), n.shares_outstanding AS sheet_shares, d.* EXCLUDE (ticker), 0.01 * total_assets AS depreciation,
  CASE WHEN CAST(substr(n.ticker, 2) AS BIGINT) % 4 <> 1 THEN operating_cash_flow END AS ocf_known,
  CASE WHEN CAST(substr(n.ticker, 2) AS BIGINT) % 12 <> 1 THEN operating_income END AS ebit_known
FROM fnow n JOIN fund d USING (ticker)""")
register("dcfa", ("vnow",), """
SELECT *, equity_value / shares AS intrinsic_value,
  CASE WHEN equity_value / shares > 0 AND latest_price > 0 THEN (equity_value / shares - latest_price) / (equity_value / shares) * 100 END AS margin_of_safety_pct
FROM (SELECT *, pv_flows + terminal_value AS enterprise_value, pv_flows + terminal_value - long_term_debt AS equity_value FROM (
SELECT *, fcf * 1.03 / (0.10 - 0.03) AS terminal_value, fcf * (SELECT sum(pow(1.03 / 1.10, i)) FROM range(1, 11) t(i)) AS pv_flows FROM (
SELECT *, coalesce(ocf_known - abs(capital_expenditure), ebit_known * (1 - 0.21) + depreciation, net_income + depreciation) AS fcf,
  coalesce(shares_stated, market_cap / latest_price, sheet_shares) AS shares,
  CASE WHEN shares_stated IS NOT NULL THEN 'fundamentals' WHEN market_cap / latest_price IS NOT NULL THEN 'market_cap' ELSE 'balance_sheet' END AS shares_source
FROM vnow) a) b) c""")


def blanked(c):
    """Some cash flows and EBITs blanked so that every fallback of the cash-flow cascade runs."""
    k = F.substr("ticker", F.lit(2)).cast("bigint")
    return c.withColumns({
        "operating_cash_flow": F.when(k % 4 != 1, F.col("operating_cash_flow")),
        "operating_income": F.when(k % 12 != 1, F.col("operating_income")),
        "depreciation": 0.01 * F.col("total_assets"),
    })


def companies(spark, sf):
    """Latest statements with the fundamentals snapshot, one row per company."""
    return blanked(b.with_fundamentals(spark, sf, fin.latest_period(b.facts(spark, sf))))


@CAT.add("dcf_a", sql("dcfa", f"""
SELECT ticker, shares_source, {rcols('fcf terminal_value enterprise_value equity_value', 2)}, {rcols('intrinsic_value margin_of_safety_pct', 4)} FROM dcfa"""))
def dcf_a(spark, sf):
    t = val.dcf_undiscounted_terminal(companies(spark, sf))
    return show(t.select("ticker", "shares_source", "fcf", "terminal_value", "enterprise_value", "equity_value",
                         "intrinsic_value", "margin_of_safety_pct"), 2, {"intrinsic_value": 4, "margin_of_safety_pct": 4})


register("dcfb", ("yoy",), """
SELECT *, last_fcf * (SELECT sum(pow((1 + growth) / 1.10, i)) FROM range(1, 6) t(i)) + last_fcf * pow(1 + growth, 5) * 1.03 / (0.10 - 0.03) / pow(1.10, 5) AS intrinsic_value
FROM (SELECT ticker, count(*) AS n_periods, max_by(free_cash_flow, period_end) AS last_fcf, CASE WHEN count(*) < 2 THEN 0 ELSE avg(y_fcf) * 0.8 END AS growth
      FROM yoy GROUP BY ticker) x""")


# Growth of a nearly zero cash flow explodes, so values are compared to seven significant digits.
def digits7(c: str) -> str:
    return f"CAST(printf('%.6e', {c}) AS DOUBLE)"


def seven_digits(c):
    """A missing value stays NULL: format_string would print it as the text null."""
    return F.when(F.col(c).isNotNull(), F.format_string("%.6e", F.col(c))).cast("double").alias(c)


@CAT.add("dcf_b", sql("dcfb", f"""
SELECT ticker, n_periods, {r('last_fcf', 4)} AS last_fcf, {digits7('growth')} AS growth, {digits7('intrinsic_value')} AS intrinsic_value FROM dcfb"""))
def dcf_b(spark, sf):
    t = val.dcf_discounted(b.facts(spark, sf))
    return t.select("ticker", "n_periods", snap("last_fcf", 4).alias("last_fcf"), seven_digits("growth"), seven_digits("intrinsic_value"))


@CAT.add("dcf_b_flows", sql("dcfb", f"""
SELECT ticker, i AS year, {digits7('flow')} AS flow
FROM (SELECT ticker, CAST(i AS INT) AS i, last_fcf * pow(1 + growth, i) AS flow FROM dcfb, range(1, 6) t(i)) x"""))
def dcf_b_flows(spark, sf):
    t = val.dcf_discounted(b.facts(spark, sf)).select("ticker", F.posexplode("projected_cash_flows").alias("y", "flow"))
    return t.select("ticker", (F.col("y") + 1).alias("year"), seven_digits("flow"))


register("bands", ("dcfa",), """
SELECT *, CASE WHEN intrinsic_value > 0 AND latest_price IS NOT NULL THEN (intrinsic_value - latest_price) / intrinsic_value END AS mos FROM dcfa""")


@CAT.add("valuation_bands", sql("bands", f"""
SELECT ticker, {r('mos', 4)} AS margin_of_safety,
  CASE WHEN mos IS NULL THEN 'unknown' WHEN mos >= 0.25 THEN 'deeply_undervalued' WHEN mos >= 0.10 THEN 'undervalued' WHEN mos >= 0 THEN 'fairly_valued'
       WHEN mos >= -0.15 THEN 'slightly_overvalued' ELSE 'overvalued' END AS status,
  CASE WHEN mos IS NULL THEN 'Insufficient data for valuation analysis' WHEN mos >= 0.25 THEN 'Strong Buy - Significant margin of safety'
       WHEN mos >= 0.10 THEN 'Buy - Good margin of safety' WHEN mos >= 0 THEN 'Hold - Limited margin of safety'
       WHEN mos >= -0.15 THEN 'Caution - Consider waiting for better entry' ELSE 'Avoid - No margin of safety' END AS advice,
  {r('''CASE WHEN mos IS NULL AND pe_ratio IS NULL THEN 50 ELSE (coalesce(CASE WHEN mos >= 0.25 THEN 100 WHEN mos >= 0.10 THEN 80 WHEN mos >= 0 THEN 60 WHEN mos >= -0.15 THEN 40
     WHEN mos IS NOT NULL THEN 20 END, 0) + coalesce(CASE WHEN pe_ratio < 15 THEN 80 WHEN pe_ratio < 25 THEN 60 WHEN pe_ratio IS NOT NULL THEN 40 END, 0))
     / (CASE WHEN mos IS NULL THEN 0 ELSE 1 END + CASE WHEN pe_ratio IS NULL THEN 0 ELSE 1 END) END''')} AS summary_score,
  CASE WHEN pe_ratio < 15 THEN 'Attractive' WHEN pe_ratio > 25 THEN 'Expensive' WHEN pe_ratio IS NOT NULL THEN 'Fair' END AS pe_signal,
  CASE WHEN peg_ratio < 1 THEN 'Undervalued' WHEN peg_ratio > 2 THEN 'Overvalued' WHEN peg_ratio IS NOT NULL THEN 'Fair' END AS peg_signal,
  CASE WHEN price_to_book < 1 THEN 'Below Book Value' WHEN price_to_book > 3 THEN 'Premium Valuation' WHEN price_to_book IS NOT NULL THEN 'Normal' END AS pb_signal
FROM bands"""))
def valuation_bands(spark, sf):
    t = val.dcf_undiscounted_terminal(companies(spark, sf))
    v = F.col("intrinsic_value")
    t = t.withColumn("mos", F.when((v > 0) & F.col("latest_price").isNotNull(), (v - F.col("latest_price")) / F.nullif(v, F.lit(0.0))))
    mos, pe = F.col("mos"), F.col("pe_ratio")
    return show(t.select(
        "ticker", mos.alias("margin_of_safety"), val.valuation_status(mos).alias("status"), val.valuation_advice(mos).alias("advice"),
        val.summary_score(mos, pe).alias("summary_score"), val.pe_signal(pe).alias("pe_signal"),
        val.peg_signal(F.col("peg_ratio")).alias("peg_signal"), val.pb_signal(F.col("price_to_book")).alias("pb_signal")),
        places={"margin_of_safety": 4})


# --- companies listed as suppliers: statements plus market data ---------------

register("pr", ("ret",), sq.PRICE_RISK)
register("mom", ("prices",), """
SELECT ticker, max(CASE WHEN k = 0 THEN close END) / max(CASE WHEN k = 20 THEN close END) - 1 AS momentum
FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY dt DESC) - 1 AS k FROM prices) x GROUP BY ticker""")
register("listed", ("pr", "betas", "mom"), """
SELECT concat('C', substr(p.ticker, 2)) AS ticker, volatility, var_95, max_drawdown, b.beta AS price_beta, momentum
FROM pr p LEFT JOIN betas b USING (ticker) LEFT JOIN mom m USING (ticker)""")


def listed(spark, sf):
    """Price-based metrics of supplier k re-keyed to company k."""
    px = bars.daily(spark, sf).select("ticker", "dt", "close")
    beta = p.beta(p.with_market(s.with_returns(px), p.market_returns(b.benchmark(px)))).select("ticker", F.col("beta").alias("price_beta"))
    t = s.price_risk(px).join(beta, "ticker", "left").join(s.momentum(px), "ticker", "left")
    return t.withColumn("ticker", F.concat(F.lit("C"), F.substr("ticker", F.lit(2)))).drop("n_returns")


def pct(c: str) -> str:
    return f"printf('%.1f%%', floor(floor(({c}) * 1e8 + 0.5) / 1e6 * 10 + 0.5) / 10)"


MOS0 = "CASE WHEN intrinsic_value > 0 AND latest_price > 0 THEN (intrinsic_value - latest_price) / intrinsic_value ELSE 0 END"
THESIS = [
    ("m >= 0.15", f"concat('Stock appears undervalued with ', {pct('m')}, ' margin of safety')"),
    ("m >= 0 AND m < 0.15", f"concat('Stock is fairly valued with limited ', {pct('m')}, ' margin of safety')"),
    ("m < 0", f"concat('Stock appears overvalued by ', {pct('abs(m)')})"),
    ("g > 0.15", f"concat('Strong revenue growth of ', {pct('g')}, ' indicates business expansion')"),
    ("g > 0.05 AND g <= 0.15", f"concat('Moderate revenue growth of ', {pct('g')}, ' shows stable business')"),
    ("roe > 0.15", f"concat('High ROE of ', {pct('roe')}, ' demonstrates efficient capital utilization')"),
    ("coalesce(de, 1) < 0.5", "'Strong balance sheet with low debt levels provides financial flexibility'"),
    ("coalesce(de, 1) > 1.5", "'High debt levels may pose financial risk in economic downturns'"),
    ("mo > 0.1", f"concat('Positive price momentum of ', {pct('mo')}, ' suggests market confidence')"),
    ("mo < -0.1", f"concat('Negative momentum of ', {pct('mo')}, ' may indicate market concerns')"),
    ("vo > 0.3", f"concat('High volatility of ', {pct('vo')}, ' suggests increased investment risk')"),
]


def snap3(c: str) -> str:
    return r(c, 5)


@CAT.add("investment_thesis", sql("dcfa g6 listed", f"""
SELECT ticker, CASE WHEN m >= 0.25 THEN 'STRONG BUY' WHEN m >= 0.15 THEN 'BUY' WHEN m >= 0.05 THEN 'HOLD' WHEN m >= -0.10 THEN 'WATCH' ELSE 'AVOID' END AS rating,
  CASE WHEN vo < 0.15 THEN 'Low' WHEN vo < 0.25 THEN 'Moderate' WHEN vo < 0.40 THEN 'High' WHEN vo IS NOT NULL THEN 'Very High' END AS risk_level,
  {r('CASE WHEN latest_price > 0 AND intrinsic_value > 0 THEN (intrinsic_value - latest_price) / latest_price ELSE 0 END', 4)} AS upside, {cases(THESIS, False)} AS thesis,
  {r('CASE WHEN m > 0 THEN least(m * 200, 100) ELSE 0 END', 3)} AS value_score, {r('CASE WHEN g > 0 THEN least(g * 500, 100) ELSE 50 END', 3)} AS growth_axis,
  {r('CASE WHEN roe > 0 THEN least(roe * 300, 100) ELSE 50 END', 3)} AS quality_score, CAST(CASE WHEN de < 0.5 THEN 80 ELSE 50 END AS DOUBLE) AS financial_health,
  {r('CASE WHEN mo > 0 THEN least(mo * 200 + 50, 100) ELSE 50 END', 3)} AS momentum_axis
FROM (SELECT a.ticker, intrinsic_value, latest_price, {snap3(MOS0)} AS m, {snap3('revenue_growth')} AS g, {snap3('net_income / nullif(total_stockholder_equity, 0)')} AS roe,
        {snap3('long_term_debt / nullif(total_stockholder_equity, 0)')} AS de, {snap3('momentum')} AS mo, {snap3('volatility')} AS vo
      FROM dcfa a JOIN g6 USING (ticker) LEFT JOIN listed USING (ticker)) x"""))
def investment_thesis(spark, sf):
    """All companies; without a price series momentum and volatility add nothing and the risk level is unknown."""
    c = blanked(b.with_fundamentals(spark, sf, gro.company_profile(b.facts(spark, sf))))
    t = val.dcf_undiscounted_terminal(c).join(listed(spark, sf), "ticker", "left")
    t = show(t.select(
        "ticker", "intrinsic_value", "latest_price",
        val.margin_of_safety("intrinsic_value", "latest_price").alias("m"), F.col("revenue_growth").alias("g"),
        div("net_income", "total_stockholder_equity").alias("roe"), div("long_term_debt", "total_stockholder_equity").alias("de"),
        F.col("momentum").alias("mo"), F.col("volatility").alias("vo")), 5, {"intrinsic_value": 9, "latest_price": 9})
    m, g, roe, de, mo, vo = (F.col(c) for c in ("m", "g", "roe", "de", "mo", "vo"))
    ok = (F.col("latest_price") > 0) & (F.col("intrinsic_value") > 0)
    up = F.when(ok, (F.col("intrinsic_value") - F.col("latest_price")) / F.nullif(F.col("latest_price"), F.lit(0.0))).otherwise(0.0)
    radar = {k: v.alias(k) for k, v in val.radar_scores(m, g, roe, de, mo).items()}
    return show(t.select("ticker", val.investment_rating(m).alias("rating"), val.volatility_level(vo).alias("risk_level"),
                         up.alias("upside"), val.thesis(m, g, roe, de, mo, vo).alias("thesis"), *radar.values()), 3, {"upside": 4})


# --- risk --------------------------------------------------------------------

@CAT.add("market_risk", sql("listed", f"SELECT ticker, {rcols('volatility var_95 max_drawdown price_beta')} FROM listed"))
def market_risk(spark, sf):
    return show(listed(spark, sf).drop("momentum"))


@CAT.add("financial_risk", sql("fnow", f"""
SELECT ticker, {r(q('long_term_debt', 'total_stockholder_equity', None))} AS debt_to_equity, {r(q('long_term_debt', 'total_assets', None))} AS debt_to_assets,
       {r(q('operating_income', 'interest_expense', None))} AS interest_coverage FROM fnow"""))
def financial_risk(spark, sf):
    return show(rsk.financial_risk(fin.latest_period(b.facts(spark, sf))))


register("brisk", ("yoy",), """
SELECT ticker, stddev_samp(y_rev) AS revenue_volatility, avg(y_ebit / nullif(y_rev, 0)) AS operating_leverage FROM yoy GROUP BY ticker""")


@CAT.add("business_risk", sql("brisk", f"SELECT ticker, {rcols('revenue_volatility operating_leverage', 4)} FROM brisk"))
def business_risk(spark, sf):
    return show(rsk.business_risk(b.facts(spark, sf)), 4)


@CAT.add("risk_score", sql("fnow brisk listed", f"""
SELECT ticker, {r('score', 4)} AS risk_score, CASE WHEN score < 20 THEN 'Very Low' WHEN score < 40 THEN 'Low' WHEN score < 60 THEN 'Moderate' WHEN score < 80 THEN 'High' ELSE 'Very High' END AS risk_level
FROM (SELECT ticker, 0.4 * (coalesce(least(volatility * 100, 100), 0) * 0.4 + coalesce(least(abs(price_beta) * 20, 100), 0) * 0.3 + coalesce(least(abs(max_drawdown) * 200, 100), 0) * 0.3)
  + 0.35 * (CASE WHEN total_stockholder_equity = 0 THEN 40 ELSE least(long_term_debt / total_stockholder_equity * 20, 100) * 0.4 END
          + coalesce(least(100 / nullif(operating_income / nullif(interest_expense, 0), 0), 100), 0) * 0.6)
  + 0.25 * (coalesce(least(revenue_volatility * 200, 100), 0) * 0.5 + coalesce(least(abs(operating_leverage) * 20, 100), 0) * 0.5) AS score
  FROM fnow JOIN brisk USING (ticker) LEFT JOIN listed USING (ticker)) x"""))
def risk_score(spark, sf):
    """All companies; market metrics of one without a price series add nothing."""
    f = b.facts(spark, sf)
    t = (
        rsk.financial_risk(fin.latest_period(f)).join(rsk.business_risk(f), "ticker")
        .join(listed(spark, sf).withColumnRenamed("price_beta", "beta"), "ticker", "left")
        .withColumn("risk_score", rsk.composite_score())
    )
    return show(t.select("ticker", "risk_score", rsk.five_levels(F.col("risk_score")).alias("risk_level")), 4)


RF = [
    ("score >= 70", "'High risk due to combination of market volatility, financial leverage, and business challenges'"),
    ("score >= 40 AND score < 70", "'Moderate risk with some concerns in financial health or market exposure'"),
    ("score < 40", "'Low risk with stable financials and manageable market exposure'"),
    ("beta > 1.5", "'High market sensitivity (beta > 1.5)'"), ("beta < 0.5", "'Low market sensitivity (beta < 0.5)'"),
    ("vol > 0.4", "'High price volatility (> 40%)'"), ("vol < 0.1", "'Low price volatility (< 10%)'"),
    ("de > 1.0", "'High leverage (D/E > 1.0)'"), ("ic < 1.0", "'Low interest coverage (< 1.0)'"),
    ("om < 0.1", "'Low operating margin (< 10%)'"), ("rev < 1e9", "'Small revenue base (< $1B)'"),
    ("hm AND b1 > 1.5", "printf('Beta of %.2f indicates high volatility relative to market', floor(floor(b1 * 1e6 + 0.5) / 1e6 * 1e2 + 0.5) / 1e2)"),
    ("hm AND b1 < 0.5", "printf('Beta of %.2f indicates low correlation with market', floor(floor(b1 * 1e6 + 0.5) / 1e6 * 1e2 + 0.5) / 1e2)"),
    ("hm AND v1 > 0.4", f"concat('Annual volatility of ', {pct('v1')}, ' is very high')"),
    ("hm AND v1 > 0.3 AND v1 <= 0.4", f"concat('Annual volatility of ', {pct('v1')}, ' is above average')"),
    ("hf AND d1 > 2.0", "printf('Debt-to-equity ratio of %.2f indicates very high leverage', floor(floor(d1 * 1e6 + 0.5) / 1e6 * 1e2 + 0.5) / 1e2)"),
    ("hf AND d1 > 1.0 AND d1 <= 2.0", "printf('Debt-to-equity ratio of %.2f indicates significant leverage', floor(floor(d1 * 1e6 + 0.5) / 1e6 * 1e2 + 0.5) / 1e2)"),
    ("hf AND i1 < 1.5", "printf('Interest coverage of %.2fx is dangerously low', floor(floor(i1 * 1e6 + 0.5) / 1e6 * 1e2 + 0.5) / 1e2)"),
    ("hf AND i1 >= 1.5 AND i1 < 3.0", "printf('Interest coverage of %.2fx may be insufficient in downturns', floor(floor(i1 * 1e6 + 0.5) / 1e6 * 1e2 + 0.5) / 1e2)"),
    ("hb AND o1 < 0.05", f"concat('Operating margin of ', {pct('o1')}, ' is very low')"),
    ("hb AND o1 >= 0.05 AND o1 < 0.10", f"concat('Operating margin of ', {pct('o1')}, ' is below healthy levels')"),
    ("hb AND r1 < 1e8", "concat('Small company with revenue of $', printf('%.0f', floor(floor((r1 / 1e6) * 1e6 + 0.5) / 1e6 * 1e0 + 0.5) / 1e0), 'M')"),
    ("hb AND r1 >= 1e8 AND r1 < 1e9", "concat('Mid-size company with revenue of $', printf('%.0f', floor(floor((r1 / 1e6) * 1e6 + 0.5) / 1e6 * 1e0 + 0.5) / 1e0), 'M')"),
]
RW = [
    ("beta IS NULL", "'Beta not available in fundamentals data'"), ("vol IS NULL", "'Price data not available for volatility calculation'"),
    ("coalesce(total_stockholder_equity, 0) = 0", "'Total Stockholder Equity is zero'"), ("coalesce(interest_expense, 0) = 0", "'Interest Expense is zero'"),
    ("coalesce(total_revenue, 0) = 0", "'Total Revenue is zero'"), ("rev IS NULL", "'Total Revenue is zero or negative'"),
    ("NOT hm", "'Market risk metrics not available for score calculation'"), ("NOT hf", "'Financial risk metrics not available for score calculation'"),
    ("NOT hb", "'Business risk metrics not available for score calculation'"),
]


@CAT.add("risk_report", sql("fnow fund listed", f"""
SELECT ticker, {rcols('market_score financial_score business_score')}, {r('score', 4)} AS score, CASE WHEN score >= 70 THEN 'High' WHEN score >= 40 THEN 'Moderate' ELSE 'Low' END AS level,
  {cases(RF, False)} AS factors, {cases(RW, False)} AS warnings
FROM (SELECT *, (market_score * 0.3 + financial_score * 0.4 + business_score * 0.3) * 100 AS score FROM (
SELECT *, CASE WHEN hm THEN (least(abs(b1 - 1.0) * 2, 2.0) / 2 + least(v1 * 2, 1.0)) / 2 ELSE 0 END AS market_score,
  CASE WHEN hf THEN (least(d1, 2.0) / 2 + greatest(0, 1 - i1 / 5)) / 2 ELSE 0 END AS financial_score,
  CASE WHEN hb THEN (greatest(0, 1 - o1 / 0.3) + greatest(0, 1 - r1 / 1e10)) / 2 ELSE 0 END AS business_score FROM (
SELECT *, beta IS NOT NULL OR vol IS NOT NULL AS hm, de IS NOT NULL OR ic IS NOT NULL AS hf, om IS NOT NULL OR rev IS NOT NULL AS hb, coalesce(beta, 1) AS b1,
  coalesce(vol, 0.2) AS v1, coalesce(de, 0.5) AS d1, coalesce(ic, 3) AS i1, coalesce(om, 0.15) AS o1, coalesce(rev, 1e9) AS r1 FROM (
SELECT n.*, d.beta, l.volatility AS vol, {q('total_liabilities', 'total_stockholder_equity', None)} AS de, {q('operating_income', 'interest_expense', None)} AS ic,
  {q('operating_income', 'total_revenue', None)} AS om, CASE WHEN total_revenue > 0 THEN total_revenue END AS rev
FROM fnow n LEFT JOIN fund d USING (ticker) LEFT JOIN listed l USING (ticker)) a) b) c) e"""))
def risk_report(spark, sf):
    now = b.with_fundamentals(spark, sf, fin.latest_period(b.facts(spark, sf)))
    px = bars.daily(spark, sf).select("ticker", "dt", "close")
    vol = s.annual_volatility(s.with_returns(px)).withColumn("ticker", F.concat(F.lit("C"), F.substr("ticker", F.lit(2))))
    return show(rsk.risk_report(now.join(vol, "ticker", "left")), places={"score": 4})


# --- recommendation ----------------------------------------------------------

register("recm", ("dcfa", "hnow", "gq"), f"""
SELECT a.ticker, {r(MOS0, 9)} AS margin_of_safety, a.pe_ratio, a.price_to_book AS pb_ratio, h.piotroski_score, h.altman_z_score, h.current_ratio, h.debt_to_equity,
  g.growth_score, g.revenue_cagr, g.eps_cagr, h.return_on_equity AS roe, h.operating_margin, a.free_cash_flow / nullif(a.total_revenue, 0) AS fcf_margin
FROM dcfa a JOIN hnow h USING (ticker) JOIN gq g USING (ticker)""")


def points(cat: str | None = None) -> str:
    return " + ".join(f"CASE WHEN {m} >= {t} THEN {n} ELSE 0 END" for m, t, n, _, c, _ in rcm.RULES if cat in (None, c))


register("rec", ("recm",), "SELECT *, CASE WHEN score >= 8 THEN 'Strong Buy' WHEN score >= 6 THEN 'Buy' WHEN score >= 4 THEN 'Hold' ELSE 'Sell' END AS recommendation FROM (SELECT *, "
         + f"{points()} AS score, " + ", ".join(f"{points(c)} AS {c}_points" for c in rcm.CATEGORIES) + ", "
         + cases([(f"{m} >= {t}", d) for m, t, _, d, _, _ in rcm.RULES]) + " AS reasons FROM recm) x")


def metrics(spark, sf):
    """The thirteen rule inputs, all projected from one pass over the statements."""
    c = b.with_fundamentals(spark, sf, gro.company_profile(b.facts(spark, sf)))
    c = gro.quality(c).withColumns({
        **fin.health_ratio_columns(), "piotroski_score": fin.piotroski(), "altman_z_score": fin.altman_z(),
        "fcf_margin": div("free_cash_flow", "total_revenue"),
    })
    v = val.dcf_undiscounted_terminal(blanked(c))
    return v.select(
        "ticker", val.margin_of_safety("intrinsic_value", "latest_price").alias("margin_of_safety"), "pe_ratio",
        F.col("price_to_book").alias("pb_ratio"), "piotroski_score", "altman_z_score", "current_ratio", "debt_to_equity",
        "growth_score", "revenue_cagr", "eps_cagr", F.col("return_on_equity").alias("roe"), "operating_margin", "fcf_margin")


@CAT.add("recommendation", sql("rec", "SELECT ticker, score, value_points, health_points, growth_points, profitability_points, reasons, recommendation FROM rec"))
def recommendation(spark, sf):
    return show(rcm.recommendation(metrics(spark, sf)).select(
        "ticker", "score", *[f"{c}_points" for c in rcm.CATEGORIES], "reasons", "recommendation"))


BEST = {c: sum(x[2] for x in rcm.RULES if x[4] == c) for c in rcm.CATEGORIES}


@CAT.add("recommendation_explained", sql("rec", f"""
SELECT ticker, score, recommendation, concat(recommendation, ' recommendation based on a score of ', score, '/10') AS summary,
  {cases([(f'{c}_points / {n} >= 0.7', f'Strong {c} metrics') for c, n in BEST.items()])} AS key_strengths,
  {cases([(f'{c}_points / {n} <= 0.3', f'Weak {c} metrics') for c, n in BEST.items()])} AS key_concerns,
  CASE WHEN recommendation IN ('Strong Buy', 'Buy') THEN '{rcm.THESIS_BUY}' WHEN recommendation = 'Hold' THEN '{rcm.THESIS_HOLD}' ELSE '{rcm.THESIS_SELL}' END AS investment_thesis
FROM rec"""))
def recommendation_explained(spark, sf):
    return show(rcm.explain(rcm.recommendation(metrics(spark, sf))))


@CAT.add("recommendation_rules", sql("recm", "\nUNION ALL\n".join(
    f"SELECT ticker, '{m}' AS metric, '{c}' AS category, CAST({m} {'<=' if d == 'low' else '>='} {t} AS INT) AS hit FROM recm WHERE {m} IS NOT NULL"
    for m, t, _, _, c, d in rcm.RULES)))
def recommendation_rules(spark, sf):
    """Rule by rule, with low-is-better rules tested the other way round."""
    return show(rcm.judged(metrics(spark, sf), compat=False).select("ticker", "metric", "category", "hit"))
