"""Weights, scalar functions, modular scores, dispatch, set operations and report sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.config import options as cfg
from quantloom.functions import formatting as fmt
from quantloom.functions import weights as wt
from quantloom.functions.numeric import div, norm, percent_of_range, rescale, snap
from quantloom.operators import chain as ch
from quantloom.operators import filters as flt
from quantloom.operators import fundamentals as fin
from quantloom.operators import report as rep
from quantloom.operators import scoring as sc
from quantloom.operators import series as s
from quantloom.operators import strategies as st
from quantloom.plans import data_queries as data
from quantloom.plans import fundamental_queries  # noqa: F401  (registers fund, hnow)
from quantloom.plans import option_queries as oq
from quantloom.plans.common import Catalog, show
from quantloom.plans.oracle import norm as n_sql
from quantloom.plans.oracle import CTE, r, rcols, register, sql
from quantloom.sources import bars, sinks
from quantloom.sources import bindings as b
from quantloom.sources.shared import new_path

CAT = Catalog()
SRC = cfg.SOURCES

# --- weights -----------------------------------------------------------------

# Which sources a ticker has is read off its number, so all 32 combinations occur.
FLAGS = {src: 2**i for i, src in enumerate(SRC)}
W0 = {"rsi": 0.30, "beta": 0.25, "momentum": 0.20, "iv": 0.15, "forecast": 0.10}
register("flags", (), "SELECT s_suppkey, " + ", ".join(f"(s_suppkey // {v}) % 2 = 1 AS has_{k}" for k, v in FLAGS.items()) + " FROM supplier")


def flags(spark, sf) -> DataFrame:
    return b.table(spark, sf, "supplier").select(
        "s_suppkey", *[(F.floor(F.col("s_suppkey") / v) % 2 == 1).alias(f"has_{k}") for k, v in FLAGS.items()])


MASS = " + ".join(f"CASE WHEN has_{k} THEN {v} ELSE 0 END" for k, v in W0.items())
COUNT = " + ".join(f"CAST(has_{k} AS INT)" for k in SRC)


@CAT.add("weight_renorm", sql("flags", f"""
SELECT s_suppkey, {', '.join(r(f'CASE WHEN has_{k} THEN {v} / ({MASS}) END') + f' AS w_{k}' for k, v in W0.items())},
       {COUNT} AS n_sources, CASE WHEN {COUNT} = 0 THEN 1 ELSE 0 END AS neutral,
       CASE WHEN {COUNT} = 5 THEN 'Excellent' WHEN {COUNT} >= 4 THEN 'Good' WHEN {COUNT} >= 3 THEN 'Moderate' ELSE 'Limited' END AS coverage
FROM flags"""))
def weight_renorm(spark, sf):
    t = flags(spark, sf)
    w = wt.renormalize(W0, sc.flags())
    m = wt.weight_map(w, wt.none_available(sc.flags()))
    t = t.withColumn("m", m)
    real = F.map_filter("m", lambda k, v: k != "neutral")
    return show(t.select(
        "s_suppkey", *[F.try_element_at("m", F.lit(s)).alias(f"w_{s}") for s in SRC], F.size(real).alias("n_sources"),
        F.map_contains_key("m", "neutral").alias("neutral"), wt.coverage_class(real).alias("coverage")))


@CAT.add("weight_redistribute", sql("flags", f"""
SELECT s_suppkey, {', '.join(r(f'CASE WHEN has_{k} THEN {v} / nullif(({MASS}) - CASE WHEN has_rsi THEN 0.3 ELSE 0 END, 0) END') + f' AS w_{k}' for k, v in W0.items() if k != 'rsi')}
FROM flags"""))
def weight_redistribute(spark, sf):
    """RSI withdrawn from whatever weights a ticker has."""
    m = wt.drop_source(wt.weight_map(wt.renormalize(W0, sc.flags())), "rsi")
    t = flags(spark, sf).withColumn("m", m)
    return show(t.select("s_suppkey", *[F.try_element_at("m", F.lit(s)).alias(f"w_{s}") for s in SRC if s != "rsi"]))


@CAT.add("custom_weight_check", """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 1 ELSE 0 END AS valid, CASE WHEN p_partkey % 4 = 1 THEN 'forecast' ELSE '' END AS missing,
       CASE WHEN p_partkey % 4 = 1 THEN 'delta' ELSE '' END AS extra, CASE WHEN p_partkey % 4 IN (0, 1) THEN 1 ELSE 0 END AS sums_to_one FROM part""")
def custom_weight_check(spark, sf):
    """Weight maps that are fine, have a wrong key, a negative weight or a wrong sum."""
    kind = F.col("p_partkey") % 4
    pairs = {
        "rsi": F.lit(0.3), "beta": F.lit(0.2), "momentum": F.when(kind == 2, -0.1).otherwise(0.2),
        "iv": F.when(kind == 3, 0.5).otherwise(0.2),
    }
    m = F.create_map(*[x for k_, v in pairs.items() for x in (F.lit(k_), v)], F.when(kind == 1, "delta").otherwise("forecast"), F.lit(0.1))
    t = b.table(spark, sf, "part").select("p_partkey", m.alias("m"))
    return show(t.select("p_partkey", wt.valid_custom(F.col("m"), SRC).alias("valid"), wt.missing_sources(F.col("m"), SRC).alias("missing"),
                         wt.extra_sources(F.col("m"), SRC).alias("extra"), wt.sums_to_one(F.col("m")).alias("sums_to_one")))


@CAT.add("scale_functions", f"""
SELECT p_partkey, {r(n_sql('p_retailprice', '1000', '1800'))} AS scaled, {r(n_sql('p_retailprice', '1000', '1800', True))} AS inverse, 0.5::DOUBLE AS flat,
  {r('greatest(-1, least(1, p_size / 25.0 - 1)) / 2 + 0.5')} AS rescaled, {r('greatest(0, least(50, p_size)) / 50.0 * 100')} AS progress, {r('coalesce(p_retailprice / nullif(p_size - 25, 0), -1)')} AS quotient FROM part""")
def scale_functions(spark, sf):
    price, size = F.col("p_retailprice"), F.col("p_size").cast("double")
    return show(b.table(spark, sf, "part").select(
        "p_partkey", norm(price, 1000, 1800).alias("scaled"), norm(price, 1000, 1800, invert=True).alias("inverse"), norm(price, 5, 5).alias("flat"),
        rescale(size / 25 - 1).alias("rescaled"), percent_of_range(size, 0, 50).alias("progress"), div(price, size - 25, -1).alias("quotient")))


def money(v: str) -> str:
    return f"""CASE WHEN {v} IS NULL THEN 'N/A' WHEN abs({v}) >= 1e9 THEN concat('$', printf('%.2f', floor(floor(({v} / 1e9) * 1e6 + 0.5) / 1e6 * 1e2 + 0.5) / 1e2), 'B') WHEN abs({v}) >= 1e6 THEN concat('$', printf('%.2f', floor(floor(({v} / 1e6) * 1e6 + 0.5) / 1e6 * 1e2 + 0.5) / 1e2), 'M')
  WHEN abs({v}) >= 1e3 THEN concat('$', printf('%.2f', floor(floor(({v} / 1e3) * 1e6 + 0.5) / 1e6 * 1e2 + 0.5) / 1e2), 'K') ELSE concat('$', printf('%.2f', floor(floor(({v}) * 1e6 + 0.5) / 1e6 * 1e2 + 0.5) / 1e2)) END"""


V = "CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal * 10 * (1 + c_custkey % 4 * 100 + c_custkey % 7 * 1e5) + 0.0007 END"


@CAT.add("format_values", f"""
SELECT c_custkey, {money('v')} AS short, CASE WHEN v IS NULL THEN 'N/A' ELSE concat(printf('%.1f', floor(floor((p * 100) * 1e6 + 0.5) / 1e6 * 1e1 + 0.5) / 1e1), '%') END AS pct, CASE WHEN v IS NULL THEN 'N/A' ELSE printf('%.2f', floor(floor((p) * 1e6 + 0.5) / 1e6 * 1e2 + 0.5) / 1e2) END AS num
FROM (SELECT *, {V} AS v, CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal / 7919 + 0.000013 END AS p FROM customer) x""")
def format_values(spark, sf):
    c = b.table(spark, sf, "customer")
    key = F.col("c_custkey")
    v = F.when(key % 9 != 0, F.col("c_acctbal") * 10 * (1 + key % 4 * 100 + key % 7 * 1e5) + 0.0007)
    p = F.when(key % 9 != 0, F.col("c_acctbal") / 7919 + 0.000013)
    return c.select("c_custkey", fmt.currency_short(v).alias("short"), fmt.percent(p).alias("pct"), fmt.number(p).alias("num"))


@CAT.add("status_classes", sql("hnow fund dcfa listed", """
SELECT a.ticker, CASE WHEN a.pe_ratio IS NULL THEN 'neutral' WHEN a.pe_ratio < 15 THEN 'good' WHEN a.pe_ratio < 25 THEN 'neutral' WHEN a.pe_ratio < 35 THEN 'warning' ELSE 'bad' END AS pe_status,
  CASE WHEN h.debt_to_equity IS NULL THEN 'neutral' WHEN h.debt_to_equity < 0.5 THEN 'good' WHEN h.debt_to_equity < 1 THEN 'neutral' WHEN h.debt_to_equity < 2 THEN 'warning' ELSE 'bad' END AS de_status,
  CASE WHEN m IS NULL THEN 'neutral' WHEN m >= 0.15 THEN 'good' WHEN m >= -0.10 THEN 'warning' ELSE 'bad' END AS mos_status,
  CASE WHEN m IS NULL THEN '' WHEN m >= 0.7 THEN 'green' WHEN m >= 0.5 THEN 'orange' ELSE 'red' END AS score_cell
FROM (SELECT *, margin_of_safety_pct / 100 AS m FROM dcfa) a JOIN hnow h USING (ticker)"""))
def status_classes(spark, sf):
    v = fundamental_queries.val.dcf_undiscounted_terminal(fundamental_queries.companies(spark, sf)).select(
        "ticker", "pe_ratio", (F.col("margin_of_safety_pct") / 100).alias("m"))
    h = fin.with_health_ratios(fundamental_queries.with_gaps(b.facts(spark, sf))).select("ticker", "debt_to_equity")
    return v.join(h, "ticker").select(
        "ticker", fmt.status("pe_ratio", "pe_ratio").alias("pe_status"), fmt.status("debt_to_equity", "debt_to_equity").alias("de_status"),
        fmt.status("m", "margin_of_safety").alias("mos_status"), fmt.cell_class("m", "score").alias("score_cell"))


@CAT.add("comparison_table", sql("hnow", "\nUNION ALL\n".join(
    f"SELECT ticker, '{cat}' AS category, '{m}' AS metric, {r(m)} AS value FROM hnow" for cat, ms in
    {"liquidity": ["current_ratio"], "profitability": ["gross_margin", "operating_margin", "net_margin"]}.items() for m in ms)))
def comparison_table(spark, sf):
    h = fin.with_health_ratios(b.facts(spark, sf))
    return show(flt.flatten_maps(h, "ticker", {"liquidity": ["current_ratio"], "profitability": ["gross_margin", "operating_margin", "net_margin"]}))


# --- modular scores and dispatch ---------------------------------------------

MOD = {
    "rsi": "CASE WHEN rsi <= 30 THEN 1.0 WHEN rsi >= 70 THEN 0.2 ELSE 1.0 - (rsi - 30) / 40 * 0.8 END",
    "beta": "CASE WHEN beta BETWEEN 0.8 AND 1.2 THEN 1.0 WHEN beta < 0.8 THEN 0.7 ELSE greatest(0.3, 1.0 - (beta - 1.2) * 0.2) END",
    "momentum": "CASE WHEN momentum > 0.1 THEN 0.8 WHEN momentum > 0 THEN 1.0 WHEN momentum > -0.05 THEN 0.6 ELSE 0.2 END",
    "forecast": "forecast", "iv": n_sql("iv", "avg_iv * 0.8", "avg_iv * 1.5"),
}
register("modx", ("chain", "ind", "chain_iv"), """
SELECT c.*, i.* EXCLUDE (ticker), coalesce(v.avg_iv, 0.25) AS avg_iv, v.avg_iv IS NOT NULL AS has_iv
FROM chain c JOIN ind i USING (ticker) LEFT JOIN chain_iv v USING (ticker) WHERE side = 'C' AND dte >= 180""")


@CAT.add("modular_score", sql("modx", f"""
SELECT ticker, CAST(expiry AS VARCHAR) AS expiry, {rcols('strike')}, {r(oq.clip(oq.composite(MOD, 0.0)))} AS default_score,
  {', '.join(r(oq.clip(oq.composite(MOD, 0.0, cfg.strategy_weights(s)))) + f' AS "{s}"' for s in cfg.STRATEGIES)} FROM modx"""))
def modular_score(spark, sf):
    """The shared scorer with the default and the four implemented strategies' weights."""
    c = b.option_chain(spark, sf)
    ivs = ch.mean_iv(c.where("side = 'C'"), ["ticker"])
    x = sc.with_mean_iv(ch.contracts(c, "C", 180).join(oq.indicators(spark, sf), "ticker"), ivs, ["ticker"], fallback=0.25)
    return show(x.select("ticker", "expiry", "strike", sc.modular_score().alias("default_score"),
                         *[sc.modular_score(cfg.strategy_weights(s)).alias(s) for s in cfg.STRATEGIES]))


@CAT.add("strategy_weights_ranked", sql("ind chain_iv", f"""
SELECT ticker, strategy, {r('score')} AS score, rank FROM (SELECT *, rank() OVER (PARTITION BY ticker ORDER BY score DESC) AS rank FROM (
SELECT ticker, strategy, floor((w_rsi * ({MOD['rsi']}) + w_beta * ({MOD['beta']}) + w_mom * ({MOD['momentum']}) + w_fc * forecast + w_iv * 0.5) / (w_rsi + w_beta + w_mom + w_fc + w_iv) * 1e9 + 0.5) / 1e9 AS score
FROM ind, (VALUES {', '.join("('" + s + "', " + ', '.join(map(str, w)) + ')' for s, w in cfg.STRATEGY_WEIGHTS.items())}) AS w(strategy, w_rsi, w_beta, w_mom, w_iv, w_fc)) x) y"""))
def strategy_weights_ranked(spark, sf):
    """All fifteen weight sets applied to a ticker's indicator row (mean IV, so the IV part is 0.5), ranked."""
    ind = oq.indicators(spark, sf).withColumns({f"has_{s}": F.lit(True) for s in SRC}).withColumns({"iv": F.lit(1.15), "avg_iv": F.lit(1.0)})
    rows = [F.struct(F.lit(s).alias("strategy"), (F.floor(sc.modular_score(cfg.strategy_weights(s)) * 1e9 + 0.5) / 1e9).alias("score")) for s in cfg.STRATEGY_WEIGHTS]
    long = ind.select("ticker", F.inline(F.array(*rows)))
    return show(flt.score_rank(long, ["ticker"], "score").withColumnRenamed("score_rank", "rank"))


@CAT.add("dispatch_long_calls", sql("lc1", oq.best(
    f"'Long Calls' AS strategy_type, 'Medium-term (3-6 months)' AS time_horizon, ticker, risk, rank, CAST(expiry AS VARCHAR) AS expiry, {rcols('strike final_score')}", "lc1",
    ("final_score DESC, iv, dte DESC", "final_score DESC, dte", "final_score DESC"), (5, 5, 15), "expiry, strike")))
def dispatch_long_calls(spark, sf):
    t = st.analyze("Long Calls", b.option_chain(spark, sf), oq.indicators(spark, sf), oq.peer_signals(spark, sf), top_n=5)
    return show(t.select("strategy_type", "time_horizon", "ticker", "risk", "rank", "expiry", "strike", "final_score"))


SPREAD_ORDER = ("composite_score DESC, profit_ratio DESC, dte DESC", "composite_score DESC, profit_ratio DESC", "composite_score DESC, max_profit DESC, profit_ratio DESC")


@CAT.add("dispatch_bull_call_spread", sql("sp1", oq.best(
    f"'Bull Call Spread' AS strategy_type, ticker, risk, rank, CAST(expiry AS VARCHAR) AS expiry, {rcols('long_strike short_strike composite_score')}", "sp1",
    SPREAD_ORDER, (3, 3, 10), "expiry, long_strike, short_strike")))
def dispatch_bull_call_spread(spark, sf):
    """top_n = 3: Conservative and Moderate give three, Aggressive doubles twice up to ten."""
    t = st.analyze("Bull Call Spread", b.option_chain(spark, sf), oq.indicators(spark, sf), top_n=3)
    return show(t.select("strategy_type", "ticker", "risk", "rank", "expiry", "long_strike", "short_strike", "composite_score"))


# income strategies look at most 90 days ahead, so a request for 180 asks for 90
CTE_90 = {"callsiv90": "callsiv", "cc90": "cc1", "cp90": "cp1"}
for _name, _base in CTE_90.items():
    _deps, _body = CTE[_base]
    register(_name, tuple("callsiv90" if d == "callsiv" else d for d in _deps), _body.replace("callsiv", "callsiv90").replace("dte >= 60", "dte >= 90").replace("60.0", "90.0"))


@CAT.add("dispatch_covered_call", sql("cc90", oq.best(
    f"'Covered Call' AS strategy_type, '1998-06-01' AS analysis_date, ticker, risk, rank, CAST(expiry AS VARCHAR) AS expiry, {rcols('strike annualized_yield composite_score')}", "cc90", (
        "composite_score DESC, assignment_probability, annualized_yield DESC", "composite_score DESC, annualized_yield DESC",
        "composite_score DESC, annualized_yield DESC, total_return DESC"), (5, 5, 8), "expiry, strike")))
def dispatch_covered_call(spark, sf):
    t = st.analyze("Covered Call", b.option_chain(spark, sf), oq.indicators(spark, sf), min_days=180, top_n=5, analysis_date="1998-06-01")
    return show(t.select("strategy_type", "analysis_date", "ticker", "risk", "rank", "expiry", "strike", "annualized_yield", "composite_score"))


@CAT.add("dispatch_cash_secured_put", sql("cp90", oq.best(
    f"'Cash-Secured Put' AS strategy_type, risk AS risk_tolerance, ticker, rank, CAST(expiry AS VARCHAR) AS expiry, {rcols('strike annualized_yield composite_score')}", "cp90", (
        "composite_score DESC, assignment_probability, discount_to_current DESC", "composite_score DESC, annualized_yield DESC",
        "composite_score DESC, annualized_yield DESC, assignment_probability DESC"), (5, 5, 8), "expiry, strike")))
def dispatch_cash_secured_put(spark, sf):
    t = st.analyze("Cash-Secured Put", b.option_chain(spark, sf), oq.indicators(spark, sf), min_days=180, top_n=5)
    return show(t.select("strategy_type", "risk_tolerance", "ticker", "rank", "expiry", "strike", "annualized_yield", "composite_score"))


# --- report tables on top of a strategy's result ------------------------------

register("ccpick", ("cc1",), oq.best("*", "cc1", (
    "composite_score DESC, assignment_probability, annualized_yield DESC", "composite_score DESC, annualized_yield DESC",
    "composite_score DESC, annualized_yield DESC, total_return DESC"), (5, 5, 8), "expiry, strike"))


def picks(spark, sf) -> DataFrame:
    return st.covered_call(b.option_chain(spark, sf), oq.indicators(spark, sf), min_days=60)


@CAT.add("score_distribution", sql("ccpick", f"""
SELECT ticker, risk, count(*) AS n, {r('max(composite_score)')} AS max_score, {r('min(composite_score)')} AS min_score, {r('avg(composite_score)')} AS mean_score,
  {r('stddev_samp(composite_score)')} AS std_score, {r('max(composite_score) - min(composite_score)')} AS score_range, {r('quantile_cont(composite_score, 0.25)')} AS q1,
  {r('quantile_cont(composite_score, 0.5)')} AS q2, {r('quantile_cont(composite_score, 0.75)')} AS q3,
  {r('greatest(0, coalesce(1 - stddev_samp(composite_score) / nullif(avg(composite_score), 0), 0))')} AS consistency,
  CASE WHEN stddev_samp(composite_score) < 0.5 THEN 'High' WHEN stddev_samp(composite_score) < 1 THEN 'Medium' ELSE 'Low' END AS consistency_class
FROM ccpick GROUP BY ticker, risk"""))
def score_distribution(spark, sf):
    return show(flt.score_distribution(picks(spark, sf), ["ticker", "risk"]))


@CAT.add("topk_bottomk", sql("ccpick", f"""
SELECT ticker, risk, place, "end", {rcols('strike composite_score')}, CAST(expiry AS VARCHAR) AS expiry FROM (
SELECT *, row_number() OVER (PARTITION BY ticker, risk ORDER BY floor(composite_score * 1e9 + 0.5) DESC, expiry, strike) AS place, 'top' AS "end" FROM ccpick
UNION ALL SELECT *, row_number() OVER (PARTITION BY ticker, risk ORDER BY floor(composite_score * 1e9 + 0.5), expiry, strike), 'bottom' FROM ccpick) x WHERE place <= 3"""))
def topk_bottomk(spark, sf):
    t = flt.top_and_bottom(picks(spark, sf), ["ticker", "risk"], ["expiry", "strike"])
    return show(t.select("ticker", "risk", "place", "end", "strike", "composite_score", "expiry"))


LONG_ORDER = ("final_score DESC, iv, dte DESC", "final_score DESC, dte", "final_score DESC")
PUT_ORDER = ("composite_score DESC, assignment_probability, discount_to_current DESC", "composite_score DESC, annualized_yield DESC",
             "composite_score DESC, annualized_yield DESC, assignment_probability DESC")
register("lcpick", ("lc1",), oq.best("*", "lc1", LONG_ORDER, (5, 5, 10), "expiry, strike"))
register("sppick", ("sp1",), oq.best("*", "sp1", SPREAD_ORDER, (5, 5, 10), "expiry, long_strike, short_strike"))
register("cppick", ("cp1",), oq.best("*", "cp1", PUT_ORDER, (5, 5, 8), "expiry, strike"))
PICKS = {"Long Calls": "lcpick", "Bull Call Spread": "sppick", "Covered Call": "ccpick", "Cash-Secured Put": "cppick"}


def picks_of(strategy: str, spark, sf) -> DataFrame:
    chain, ind = b.option_chain(spark, sf), oq.indicators(spark, sf)
    if strategy == "Long Calls":
        return st.long_calls(chain, ind, oq.peer_signals(spark, sf))
    if strategy == "Bull Call Spread":
        return st.bull_call_spread(chain, ind)
    return (st.covered_call if strategy == "Covered Call" else st.cash_secured_put)(chain, ind, min_days=60)


def insight_sql(strategy: str) -> str:
    cells = []
    for c, bands in flt.INSIGHTS[strategy].items():
        cells.append(f"{r(f'avg({c})')} AS avg_{c}")
        cells.append("CASE " + " ".join(f"WHEN avg({c}) > {bound} THEN '{label}'" for bound, label in bands) + f" ELSE 'Modest' END AS {c}_band")
    return sql(PICKS[strategy], f"SELECT ticker, risk, {', '.join(cells)} FROM {PICKS[strategy]} GROUP BY ticker, risk")


def insights_of(strategy: str, spark, sf) -> DataFrame:
    return show(flt.insights(picks_of(strategy, spark, sf), strategy, ["ticker", "risk"]))


@CAT.add("strategy_insights", insight_sql("Covered Call"))
def strategy_insights(spark, sf):
    return insights_of("Covered Call", spark, sf)


@CAT.add("insights_bull_call_spread", insight_sql("Bull Call Spread"))
def insights_bull_call_spread(spark, sf):
    return insights_of("Bull Call Spread", spark, sf)


@CAT.add("insights_cash_secured_put", insight_sql("Cash-Secured Put"))
def insights_cash_secured_put(spark, sf):
    return insights_of("Cash-Secured Put", spark, sf)


@CAT.add("score_rank", sql("ccpick", f"""
SELECT ticker, risk, rank, {rcols('composite_score')}, 1 + (SELECT count(*) FROM ccpick b WHERE b.ticker = a.ticker AND b.risk = a.risk AND floor(b.composite_score * 1e9 + 0.5) > floor(a.composite_score * 1e9 + 0.5)) AS score_rank FROM ccpick a"""))
def score_rank(spark, sf):
    t = flt.score_rank(picks(spark, sf), ["ticker", "risk"])
    return show(t.select("ticker", "risk", "rank", "composite_score", "score_rank"))


@CAT.add("run_summary", sql("ccpick", f"SELECT count(*) AS n_rows, {r('avg(composite_score)')} AS mean_score, {r('max(composite_score)')} AS max_score FROM ccpick"))
def run_summary(spark, sf):
    return show(flt.run_summary(picks(spark, sf)))


@CAT.add("partial_data", sql("ccpick", f"""
SELECT ticker, CAST(bool_or(n < 5) AS INT) AS partial, min(n) AS fewest_sources FROM (SELECT ticker, {COUNT} AS n FROM ccpick) x GROUP BY ticker"""))
def partial_data(spark, sf):
    return show(flt.partial_data(picks(spark, sf)))


def printed(c: str, digits: int, scale: str = "1e0") -> str:
    return f"floor(floor(({c}) * {scale} * 1e6 + 0.5) / 1e6 * 1e{digits} + 0.5) / 1e{digits}"


SQL_FORMATS = {
    "currency": lambda c: f"CASE WHEN {c} IS NULL THEN 'N/A' ELSE concat('$', format('{{:,.2f}}', {printed(c, 2)})) END",
    "number": lambda c: f"CASE WHEN {c} IS NULL THEN 'N/A' ELSE printf('%.2f', {printed(c, 2)}) END",
    "percent": lambda c: f"CASE WHEN {c} IS NULL THEN 'N/A' ELSE concat(printf('%.1f', {printed(c, 1, '100')}), '%') END",
    "date": lambda c: f"CAST({c} AS VARCHAR)",
}


def report_sql(strategy: str) -> str:
    source = {"max_loss": "net_premium"}  # what a spread can lose is what it costs
    cells = ", ".join(f'{SQL_FORMATS[f](source.get(c, c))} AS "{t}"' for c, t, f in flt.REPORTS[strategy])
    return sql(PICKS[strategy], f"SELECT ticker, risk, rank, {cells} FROM {PICKS[strategy]}")


@CAT.add("strategy_report", report_sql("Covered Call"))
def strategy_report(spark, sf):
    return flt.strategy_report(picks_of("Covered Call", spark, sf), "Covered Call")


@CAT.add("report_long_calls", report_sql("Long Calls"))
def report_long_calls(spark, sf):
    return flt.strategy_report(picks_of("Long Calls", spark, sf), "Long Calls")


@CAT.add("report_bull_call_spread", report_sql("Bull Call Spread"))
def report_bull_call_spread(spark, sf):
    return flt.strategy_report(picks_of("Bull Call Spread", spark, sf), "Bull Call Spread")


@CAT.add("report_cash_secured_put", report_sql("Cash-Secured Put"))
def report_cash_secured_put(spark, sf):
    return flt.strategy_report(picks_of("Cash-Secured Put", spark, sf), "Cash-Secured Put")


@CAT.add("coverage_badge", sql("flags", f"""
SELECT s_suppkey, concat(n, '/5 ', CASE WHEN n = 5 THEN 'green' WHEN n >= 3 THEN 'yellow' ELSE 'red' END) AS coverage_badge,
  CASE WHEN n = 5 THEN 'Excellent' WHEN n >= 4 THEN 'Good' WHEN n >= 3 THEN 'Moderate' ELSE 'Limited' END AS coverage_class FROM (SELECT s_suppkey, {COUNT} AS n FROM flags) x"""))
def coverage_badge(spark, sf):
    """All combinations of sources; the neutral entry of a ticker without any is none of them."""
    m = wt.weight_map(wt.renormalize(W0, sc.flags()), wt.none_available(sc.flags()))
    t = flags(spark, sf).withColumn("score_details", F.map_filter(m, lambda source, _: source.isin(list(SRC))))
    return flt.with_coverage(t).select("s_suppkey", "coverage_badge", "coverage_class")


@CAT.add("score_fallback", sql("ccpick", f"""
SELECT ticker, risk, rank, {r('composite_score')} AS score, 0.0::DOUBLE AS no_score, {r(f'CASE WHEN has_rsi THEN 0.2 / ({oq.weight_sum({k: 0.2 for k in SRC})}) ELSE 0 END')} AS rsi_weight,
  -1.0::DOUBLE AS gamma_weight, 0.0::DOUBLE AS other_rsi FROM ccpick"""))
def score_fallback(spark, sf):
    """The first score column there is, and weights looked up in nested maps, with defaults for what is absent."""
    t = picks(spark, sf).withColumn("report", F.create_map(F.lit("weights"), F.col("score_details")))
    report = F.col("report")
    return show(t.select(
        "ticker", "risk", "rank", flt.first_column(t, ["total_score", "composite_score", "final_score", "score"]).alias("score"),
        flt.first_column(t, ["total_score", "grade"]).alias("no_score"), flt.nested(report, ["weights", "rsi"]).alias("rsi_weight"),
        flt.nested(report, ["weights", "gamma"], -1.0).alias("gamma_weight"), flt.nested(report, ["other", "rsi"]).alias("other_rsi")))


@CAT.add("market_status", sql("ind chain_iv ret", """
SELECT ticker, CASE WHEN vol IS NULL THEN 'neutral' WHEN vol < 0.15 THEN 'good' WHEN vol < 0.25 THEN 'neutral' WHEN vol < 0.40 THEN 'warning' ELSE 'bad' END AS volatility_status,
  CASE WHEN rsi < 30 THEN 'good' WHEN rsi > 70 THEN 'warning' ELSE 'neutral' END AS rsi_status, 'neutral' AS unknown_status,
  CASE WHEN rsi > 70 THEN 'red' WHEN rsi < 30 THEN 'green' ELSE 'orange' END AS rsi_cell,
  CASE WHEN avg_iv IS NULL THEN '' WHEN avg_iv <= 0.3 THEN 'green' WHEN avg_iv <= 0.5 THEN 'orange' ELSE 'red' END AS iv_cell,
  CASE WHEN forecast >= 0.7 THEN 'green' WHEN forecast >= 0.4 THEN 'orange' ELSE 'red' END AS forecast_cell
FROM ind LEFT JOIN (SELECT ticker, floor(avg_iv * 1e9 + 0.5) / 1e9 AS avg_iv FROM chain_iv) v USING (ticker)
LEFT JOIN (SELECT ticker, stddev_samp(ret) AS vol FROM ret GROUP BY ticker) q USING (ticker)"""))
def market_status(spark, sf):
    """Status of the daily volatility and the RSI, and the cells of RSI, IV and forecast; tickers without listed calls have no IV."""
    vol = s.with_returns(bars.daily(spark, sf).select("ticker", "dt", "close")).groupBy("ticker").agg(F.stddev_samp("ret").alias("vol"))
    iv = ch.mean_iv(b.option_chain(spark, sf).where("side = 'C'"), ["ticker"]).select("ticker", snap("avg_iv", 9).alias("avg_iv"))
    t = oq.indicators(spark, sf).join(iv, "ticker", "left").join(vol, "ticker", "left")
    return t.select(
        "ticker", fmt.status("vol", "volatility").alias("volatility_status"), fmt.status("rsi", "rsi").alias("rsi_status"), fmt.status("rsi", "gamma").alias("unknown_status"),
        fmt.cell_class("rsi", "rsi").alias("rsi_cell"), fmt.cell_class("avg_iv", "iv").alias("iv_cell"), fmt.cell_class("forecast", "forecast").alias("forecast_cell"))


@CAT.add("sorted_export", sql("chain", f"""
SELECT ticker, side, CAST(expiry AS VARCHAR) AS expiry, printf('%.4f', {printed('strike', 4)}) AS strike,
  row_number() OVER (PARTITION BY ticker ORDER BY expiry, strike, side) AS place FROM chain"""))
def sorted_export(spark, sf):
    """The listings as a sorted sink writes them: their place among a ticker's rows in the order of the files."""
    path = new_path(spark, "export")
    sinks.write_csv(b.option_chain(spark, sf).select("ticker", "side", "expiry", "strike"), path, order_by=["ticker", "expiry", "strike", "side"])
    rows = spark.read.option("header", True).schema("ticker string, side string, expiry string, strike string").csv(path)
    line = F.struct(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line"))
    return rows.withColumn("at", line).select("ticker", "side", "expiry", "strike", F.row_number().over(Window.partitionBy("ticker").orderBy("at.file", "at.line")).alias("place"))


@CAT.add("csv_export", sql("ccpick", """
SELECT 'Covered Call' AS strategy, '1998-06-01' AS date, ticker, risk, rank, CAST(expiry AS VARCHAR) AS expiry, printf('%.4f', floor(floor((strike) * 1e6 + 0.5) / 1e6 * 1e4 + 0.5) / 1e4) AS strike, printf('%.4f', floor(floor((premium_yield) * 1e6 + 0.5) / 1e6 * 1e4 + 0.5) / 1e4) AS premium_yield FROM ccpick"""))
def csv_export(spark, sf):
    t = picks(spark, sf).select("ticker", "risk", "rank", "expiry", "strike", "premium_yield")
    return sinks.export_view(t, strategy="Covered Call", date="1998-06-01")


@CAT.add("json_export", sql("hnow", """
SELECT ticker, concat('{"ticker":"', ticker, '","period_end":"', period_end, '","piotroski_score":', piotroski_score, ',"zone":"',
  CASE WHEN altman_z_score > 2.99 THEN 'safe' ELSE 'other' END, '"}') AS report FROM hnow"""))
def json_export(spark, sf):
    h = fin.health_report(fundamental_queries.with_gaps(b.facts(spark, sf))).select(
        "ticker", "period_end", "piotroski_score", F.when(F.col("altman_z_score") > 2.99, "safe").otherwise("other").alias("zone"))
    return h.select("ticker", F.to_json(F.struct("*")).alias("report"))


# --- set operations ----------------------------------------------------------

@CAT.add("chain_union", sql("chain", f"""
SELECT ticker, side, CAST(expiry AS VARCHAR) AS expiry, count(*) AS n, {r('sum(strike)', 2)} AS strikes FROM (
SELECT * FROM chain WHERE side = 'C' AND dte >= 180 UNION ALL SELECT * FROM chain WHERE side = 'P' AND dte >= 60) x GROUP BY ticker, side, expiry"""))
def chain_union(spark, sf):
    c = b.option_chain(spark, sf)
    u = ch.contracts(c, "C", 180).unionByName(ch.contracts(c, "P", 60), allowMissingColumns=True)
    return show(u.groupBy("ticker", "side", "expiry").agg(F.count("*").alias("n"), F.sum("strike").alias("strikes")), 2)


@CAT.add("distinct_expiries", sql("chain", "SELECT DISTINCT ticker, CAST(expiry AS VARCHAR) AS expiry FROM chain"))
def distinct_expiries(spark, sf):
    return show(b.option_chain(spark, sf).select("ticker", "expiry").distinct())


@CAT.add("required_except_present", sql("gapf", f"""
SELECT ticker, statement, item FROM (
SELECT ticker, 'income' AS statement, 'Basic EPS' AS item FROM gapf GROUP BY ticker
UNION ALL SELECT ticker, 'income', 'Operating Income' FROM gapf GROUP BY ticker HAVING count(operating_income) = 0
UNION ALL SELECT ticker, 'cash_flow', 'Free Cash Flow' FROM gapf WHERE {data.HAS['cash_flow']} GROUP BY ticker) x"""))
def required_except_present(spark, sf):
    """Required items minus those with any value, per ticker and statement."""
    return rep.missing_items(data.bundle(spark, sf), data.LAYOUT)
