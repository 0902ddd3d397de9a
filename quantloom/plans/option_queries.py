"""Option-chain, forecast, ecosystem and strategy queries."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import functions as F

from quantloom.config import options as cfg
from quantloom.functions import weights as wt
from quantloom.operators import chain as ch
from quantloom.operators import ecosystem as eco
from quantloom.operators import forecast as fc
from quantloom.operators import pairs as p
from quantloom.operators import scoring as sc
from quantloom.operators import series as s
from quantloom.operators import strategies as st
from quantloom.plans import pair_queries  # noqa: F401  (registers the pair CTEs)
from quantloom.plans.common import Catalog, show
from quantloom.plans.oracle import norm, r, rcols, register, sql
from quantloom.sources import bars
from quantloom.sources import bindings as b

CAT = Catalog()
AS_OF = b.AS_OF
YEAR_AGO = dt.date(1997, 6, 2)  # first day of the twelve months ending AS_OF

# --- forecasts ---------------------------------------------------------------

register("tsum", ("targets",), """
SELECT *, (SELECT stddev_samp(v) FROM unnest(CASE WHEN median_target <> mean_target
    THEN [low_target, mean_target, high_target, median_target] ELSE [low_target, mean_target, high_target] END) t(v)) AS point_std
FROM (SELECT ticker, count(*) AS num_analysts, avg(target) AS mean_target, quantile_cont(target, 0.5) AS median_target,
             max(target) AS high_target, min(target) AS low_target, stddev_samp(target) AS std_dev
      FROM targets WHERE target IS NOT NULL GROUP BY ticker) x""")


def conf_sql(n: str, sd: str) -> str:
    return (f"floor((CASE WHEN mean_target <= 0 THEN 0 ELSE least(1, greatest(0, 0.6 * least({n} / 10, 1) + "
            f"0.4 * greatest(0, 1 - coalesce({sd}, 0) / mean_target))) END) * 1000 + 0.5) / 1000")


register("fcst", ("tsum",), f"SELECT *, {conf_sql('num_analysts', 'point_std')} AS confidence FROM tsum")
FCLASS = ("CASE WHEN {c} >= 0.8 THEN 'Very High' WHEN {c} >= 0.6 THEN 'High' WHEN {c} >= 0.4 THEN 'Moderate' "
          "WHEN {c} >= 0.2 THEN 'Low' ELSE 'Very Low' END")


def forecasts(spark, sf):
    return fc.with_confidence(fc.target_summary(b.analyst_targets(spark, sf)))


@CAT.add("forecast_confidence", sql("fcst", f"""
SELECT ticker, num_analysts, {rcols('mean_target median_target high_target low_target std_dev point_std confidence')},
       'All available forecasts' AS data_freshness, {FCLASS.format(c='confidence')} AS confidence_class,
       {r('(high_target - low_target) / mean_target * 100')} AS dispersion_pct, {r('least(num_analysts / 10, 1)')} AS coverage,
       {r('mean_target - 50')} AS upside
FROM fcst"""))
def forecast_confidence(spark, sf):
    t = fc.dispersion(forecasts(spark, sf), F.lit(50.0))
    return show(t.withColumn("confidence_class", fc.confidence_class(F.col("confidence"))))


N90 = "greatest(1, CAST(floor(num_analysts * 0.5) AS BIGINT))"


@CAT.add("forecast_window", sql("tsum", f"""
SELECT ticker, {N90} AS num_analysts, {conf_sql(N90, 'point_std')} AS confidence, 'Last 3 months' AS data_freshness FROM tsum"""))
def forecast_window(spark, sf):
    t = fc.with_confidence(fc.target_summary(b.analyst_targets(spark, sf)), window_days=90)
    return show(t.select("ticker", "num_analysts", "confidence", "data_freshness"))


@CAT.add("forecast_recent", sql("targets", f"""
SELECT ticker, count(*) AS num_analysts, {r('avg(target)')} AS mean_target, {r('quantile_cont(target, 0.5)')} AS median_target
FROM targets WHERE ts <= TIMESTAMP '2024-01-20' AND ts > TIMESTAMP '2024-01-20' - INTERVAL 14 DAY GROUP BY ticker"""))
def forecast_recent(spark, sf):
    """Targets of the last two weeks only: the look-back window on real issue dates."""
    t = fc.target_summary(fc.recent(b.analyst_targets(spark, sf), dt.datetime(2024, 1, 20), 14))
    return show(t.select("ticker", "num_analysts", "mean_target", "median_target"))


MIX = "(strong_buy + buy * 0.75 + hold * 0.5 + sell * 0.25) / nullif(strong_buy + buy + hold + sell + strong_sell, 0)"


@CAT.add("rating_mix", sql("ratings", f"""
SELECT *, {r(MIX)} AS rating_score, {FCLASS.format(c=f'({MIX})')} AS confidence_class FROM ratings"""))
def rating_mix(spark, sf):
    t = b.rating_mix(spark, sf).withColumn("rating_score", fc.rating_score())
    return show(t.withColumn("confidence_class", fc.confidence_class(F.col("rating_score"))))


BEST = f"""coalesce(CASE WHEN num_analysts >= 10 THEN least(1, greatest(0, confidence)) END,
  CASE WHEN strong_buy > 0 THEN {MIX} END, 0.5 + least(0.5, greatest(0, (mean_target - 50) / 50 / 0.3 * 0.5)), 0.5)"""


@CAT.add("forecast_best_confidence", sql("ratings fcst", f"""
SELECT r.ticker, {r(BEST)} AS confidence,
  CASE WHEN num_analysts >= 10 THEN 'stored' WHEN strong_buy > 0 THEN 'ratings' WHEN mean_target IS NOT NULL THEN 'upside' ELSE 'default' END AS source_used
FROM ratings r LEFT JOIN fcst f ON r.ticker = f.ticker"""))
def forecast_best_confidence(spark, sf):
    """Ordered fallback: a well-covered stored confidence, the rating mix, the target's upside, neutral."""
    j = b.rating_mix(spark, sf).join(forecasts(spark, sf), "ticker", "left")
    stored = F.when(F.col("num_analysts") >= 10, F.col("confidence"))
    mix = F.when(F.col("strong_buy") > 0, fc.rating_score())
    up = fc.upside_confidence(F.col("mean_target"), F.lit(50.0))
    return show(j.select(
        "ticker", fc.best_confidence(stored, mix, up).alias("confidence"),
        F.when(stored.isNotNull(), "stored").when(mix.isNotNull(), "ratings").when(up.isNotNull(), "upside")
        .otherwise("default").alias("source_used")))


@CAT.add("forecast_summary", sql("fcst", """
SELECT ticker, concat('Analyst Forecast Summary for ', ticker, ': Mean Target: $', printf('%.2f', floor(floor((mean_target) * 1e6 + 0.5) / 1e6 * 1e2 + 0.5) / 1e2), ', Range: $',
  printf('%.2f', floor(floor((low_target) * 1e6 + 0.5) / 1e6 * 1e2 + 0.5) / 1e2), ' - $', printf('%.2f', floor(floor((high_target) * 1e6 + 0.5) / 1e6 * 1e2 + 0.5) / 1e2), ', Analysts: ', num_analysts, ', Confidence: ',
  printf('%.1f', floor(floor((confidence * 100) * 1e6 + 0.5) / 1e6 * 1e1 + 0.5) / 1e1), '%') AS summary FROM fcst"""))
def forecast_summary(spark, sf):
    return forecasts(spark, sf).select("ticker", fc.summary_text().alias("summary"))


# --- ecosystem ---------------------------------------------------------------

register("tmet", ("prices",), """
SELECT * FROM (
SELECT ticker, dt, coalesce(CASE WHEN n < 14 THEN NULL WHEN ll = 0 THEN CASE WHEN gg > 0 THEN 100.0 END ELSE 100 - 100 / (1 + gg / ll) END, 50) AS rsi,
  ret_1, ret_5, ret_30,
  CASE WHEN count(ret_1) OVER (PARTITION BY ticker ORDER BY dt ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) = 30
       THEN stddev_samp(ret_1) OVER (PARTITION BY ticker ORDER BY dt ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) * sqrt(252) END AS rolling_vol,
  row_number() OVER (PARTITION BY ticker ORDER BY dt DESC) AS rn, count(*) OVER (PARTITION BY ticker) AS bars
FROM (SELECT ticker, dt, close / lag(close) OVER w - 1 AS ret_1, close / lag(close, 5) OVER w - 1 AS ret_5, close / lag(close, 30) OVER w - 1 AS ret_30,
        avg(greatest(c, 0)) OVER f AS gg, avg(greatest(-c, 0)) OVER f AS ll, count(*) OVER f AS n
      FROM (SELECT *, coalesce(close - lag(close) OVER (PARTITION BY ticker ORDER BY dt), 0) AS c FROM prices) a
      WINDOW w AS (PARTITION BY ticker ORDER BY dt), f AS (PARTITION BY ticker ORDER BY dt ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)) b) z
WHERE rn = 1 AND bars >= 2""")
register("pmet", ("tmet", "peers"), """
SELECT *, CASE WHEN avg_rolling_vol < 0.15 THEN 'low' WHEN avg_rolling_vol > 0.35 THEN 'high' ELSE 'normal' END AS volatility_regime,
  0.5 * avg_ret_5 + 0.3 * avg_ret_30 + 0.2 * avg_ret_1 AS sector_momentum,
  CASE WHEN avg_ret_5 > 0.02 THEN 'strong_bullish' WHEN avg_ret_5 > 0.005 THEN 'bullish' WHEN avg_ret_5 < -0.02 THEN 'strong_bearish'
       WHEN avg_ret_5 < -0.005 THEN 'bearish' ELSE 'neutral' END AS momentum_signal
FROM (SELECT concat('S', s_suppkey) AS ticker, count(m.ticker) AS n_used, coalesce(avg(rsi), 50) AS avg_rsi, coalesce(avg(ret_1), 0) AS avg_ret_1,
             coalesce(avg(ret_5), 0) AS avg_ret_5, coalesce(avg(ret_30), 0) AS avg_ret_30, coalesce(avg(rolling_vol), 0.2) AS avg_rolling_vol
      FROM supplier LEFT JOIN peers e ON e.ticker = concat('S', s_suppkey) LEFT JOIN tmet m ON m.ticker = e.peer GROUP BY 1) x""")
register("escore", ("peercorr",), """
SELECT ticker, count(*) AS n_peers, sum(abs(r) * w) / sum(w) AS avg_correlation, least(1, greatest(0, sum(abs(r) * w) / sum(w))) AS score,
  0.4 * least(count(*) / 5, 1) + 0.3 * least(avg(n) / 100, 1) + 0.3 * avg(CASE WHEN significant THEN 1.0 ELSE 0 END) AS score_confidence,
  CAST(floor(avg(n)) AS BIGINT) AS sample_size
FROM (SELECT *, CASE WHEN significant THEN 1.5 ELSE 0.5 END * CASE WHEN n >= 30 THEN 1 ELSE greatest(0.1, n / 30) END AS w FROM peercorr) x
GROUP BY ticker""")
register("esig", ("escore", "pmet"), """
SELECT *, CASE WHEN signal_strength >= 0.7 THEN 'confirm' WHEN signal_strength <= 0.3 THEN 'veto' ELSE 'neutral' END AS signal FROM (
SELECT e.*, m.* EXCLUDE (ticker), least(1, greatest(0, score
    + CASE momentum_signal WHEN 'strong_bullish' THEN 0.3 WHEN 'bullish' THEN 0.15 WHEN 'strong_bearish' THEN -0.3 WHEN 'bearish' THEN -0.15 ELSE 0 END
    + CASE WHEN avg_rsi > 70 THEN -0.1 WHEN avg_rsi < 30 THEN 0.1 ELSE 0 END)) AS signal_strength,
  (score_confidence + least(n_peers / 5, 1) + CASE WHEN volatility_regime = 'normal' THEN 0.8 ELSE 0.6 END) / 3 AS confidence
FROM escore e JOIN pmet m USING (ticker)) x""")


def tickers(spark, sf):
    return b.table(spark, sf, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker"))


def peer_signals(spark, sf):
    px, edges = bars.daily(spark, sf).select("ticker", "dt", "close"), b.peers(spark, sf)
    of_peers = p.peer_prices(px, edges)
    corr = p.peer_correlations(s.with_returns(px), edges, peer_ret=s.with_returns(of_peers))
    metrics = eco.peer_metrics(eco.ticker_metrics(of_peers), edges, tickers(spark, sf))
    return eco.signal(eco.ecosystem_score(corr), metrics)


METRIC_COLS = "avg_rsi avg_ret_1 avg_ret_5 avg_ret_30 avg_rolling_vol sector_momentum"


@CAT.add("peer_metrics", sql("pmet", f"SELECT ticker, n_used, {rcols(METRIC_COLS)}, volatility_regime, momentum_signal FROM pmet"))
def peer_metrics(spark, sf):
    px, edges = bars.daily(spark, sf).select("ticker", "dt", "close"), b.peers(spark, sf)
    return show(eco.peer_metrics(eco.ticker_metrics(p.peer_prices(px, edges)), edges, tickers(spark, sf)))


@CAT.add("ecosystem_score", sql("escore", f"SELECT ticker, n_peers, {rcols('avg_correlation score score_confidence')}, sample_size FROM escore"))
def ecosystem_score(spark, sf):
    return show(eco.ecosystem_score(p.peer_correlations(**pair_queries.inputs(spark, sf))))


@CAT.add("ecosystem_signal", sql("esig", f"""
SELECT ticker, n_peers, {rcols('score score_confidence avg_rsi')}, volatility_regime, momentum_signal,
       {rcols('signal_strength confidence')}, signal FROM esig"""))
def ecosystem_signal(spark, sf):
    return show(peer_signals(spark, sf).select(
        "ticker", "n_peers", "score", "score_confidence", "avg_rsi", "volatility_regime", "momentum_signal",
        "signal_strength", "confidence", "signal"))


@CAT.add("ecosystem_correlation_map", sql("peercorr", """
SELECT ticker, count(*) AS n, string_agg(concat(peer, '=', printf('%.3f', floor(r * 1000 + 0.5) / 1000)), '; ' ORDER BY peer) AS correlations
FROM peercorr GROUP BY ticker"""))
def ecosystem_correlation_map(spark, sf):
    m = eco.correlation_map(p.peer_correlations(**pair_queries.inputs(spark, sf)))
    entries = F.transform(
        F.array_sort(F.map_entries("individual_correlations")),
        lambda e: F.format_string("%s=%.3f", e["key"], F.floor(e["value"] * 1000 + 0.5) / 1000))
    return show(m.select("ticker", F.size("individual_correlations").cast("bigint").alias("n"), entries.alias("correlations")))


# --- chain -------------------------------------------------------------------

@CAT.add("calls_scan", sql("chain", f"""
SELECT ticker, CAST(expiry AS VARCHAR) AS expiry, {rcols('strike last_price iv')}, volume, open_interest, CAST(dte AS INT) AS dte
FROM chain WHERE side = 'C' AND dte >= 180"""))
def calls_scan(spark, sf):
    c = ch.contracts(b.option_chain(spark, sf), "C", 180)
    return show(c.select("ticker", "expiry", "strike", "last_price", "iv", "volume", "open_interest", "dte"))


@CAT.add("puts_scan", sql("chain", f"""
SELECT ticker, CAST(expiry AS VARCHAR) AS expiry, {rcols('strike last_price iv')}, volume, open_interest, CAST(dte AS INT) AS dte
FROM chain WHERE side = 'P' AND dte >= 60"""))
def puts_scan(spark, sf):
    c = ch.contracts(b.option_chain(spark, sf), "P", 60)
    return show(c.select("ticker", "expiry", "strike", "last_price", "iv", "volume", "open_interest", "dte"))


@CAT.add("avg_iv", sql("chain", f"""
SELECT ticker, side, {r('coalesce(sum(CASE WHEN volume > 0 THEN iv * volume END) / nullif(sum(CASE WHEN volume > 0 THEN volume END), 0), avg(iv))')} AS avg_iv,
  {r('sum(iv * coalesce(v30, 1)) / sum(coalesce(v30, 1))')} AS avg_iv_filled, CAST(sum(v30) AS BIGINT) AS total_volume
FROM (SELECT *, CASE WHEN volume >= 30 THEN volume END AS v30 FROM chain) x GROUP BY ticker, side"""))
def avg_iv(spark, sf):
    """Both mean-IV forms per side; thin contracts stand in for an unknown volume in the second."""
    c = b.option_chain(spark, sf)
    thin = c.withColumn("volume", F.when(F.col("volume") >= 30, F.col("volume")))
    return show(ch.mean_iv(c, ["ticker", "side"]).join(ch.mean_iv_filled(thin, ["ticker", "side"]), ["ticker", "side"]))


@CAT.add("chain_summary", sql("chain", f"""
SELECT ticker, count(*) AS n_contracts, string_agg(DISTINCT CAST(expiry AS VARCHAR), '; ' ORDER BY CAST(expiry AS VARCHAR)) AS expiries,
       {r('min(strike)')} AS strike_min, {r('max(strike)')} AS strike_max, {r('avg(iv)')} AS mean_iv,
       CAST(sum(volume) AS BIGINT) AS total_volume, CAST(sum(open_interest) AS BIGINT) AS total_open_interest
FROM chain GROUP BY ticker"""))
def chain_summary(spark, sf):
    return show(ch.chain_summary(b.option_chain(spark, sf)))


@CAT.add("chain_check", sql("chain", """
SELECT ticker, count(*) AS n, concat_ws('; ', CASE WHEN count(CASE WHEN strike < 0 THEN 1 END) = 0 THEN 'strike' END,
   CASE WHEN ticker LIKE '%7' THEN 'last_price' END) AS empty_columns,
   0 AS valid FROM chain GROUP BY ticker"""))
def chain_check(spark, sf):
    """All listings, damaged on purpose: every strike, and the last prices of tickers that end in 7, are blanked."""
    broken = b.option_chain(spark, sf).withColumns({
        "strike": F.when(F.col("strike") < 0, F.col("strike")),
        "last_price": F.when(~F.col("ticker").endswith("7"), F.col("last_price"))})
    return show(ch.structural_check(broken))


@CAT.add("chain_coerce", sql("chain", """
SELECT ticker, count(*) AS n, count(TRY_CAST(CASE WHEN volume % 7 = 0 THEN 'n/a' ELSE CAST(volume AS VARCHAR) END AS DOUBLE)) AS n_volume,
       floor(sum(TRY_CAST(CASE WHEN volume % 7 = 0 THEN 'n/a' ELSE CAST(volume AS VARCHAR) END AS DOUBLE)) * 100 + 0.5) / 100 AS sum_volume, 0 AS n_delta
FROM chain GROUP BY ticker"""))
def chain_coerce(spark, sf):
    """Volumes as text with some unparsable entries; delta, bid and ask are absent."""
    text = F.when(F.col("volume") % 7 == 0, "n/a").otherwise(F.col("volume").cast("string"))
    c = ch.coerce_numeric(b.option_chain(spark, sf).withColumn("volume", text))
    return show(c.groupBy("ticker").agg(
        F.count("*").alias("n"), F.count("volume").alias("n_volume"), F.sum("volume").alias("sum_volume"),
        F.count("delta").alias("n_delta")), 2)


@CAT.add("iv_p95_filter", sql("chain", f"""
SELECT ticker, {r('cut')} AS iv_cut, count(*) AS n, count(*) FILTER (iv <= cut) AS kept FROM (
SELECT *, quantile_cont(iv, 0.95) OVER (PARTITION BY ticker) AS cut FROM chain
WHERE side = 'C' AND dte >= 180 AND strike / spot BETWEEN 0.85 AND 1.05) x GROUP BY ticker, cut"""))
def iv_p95_filter(spark, sf):
    c = ch.contracts(b.option_chain(spark, sf), "C", 180).where((F.col("strike") / F.col("spot")).between(0.85, 1.05))
    return show(ch.with_iv_cutoff(c, ["ticker"]).groupBy("ticker", "iv_cut").agg(
        F.count("*").alias("n"), F.count_if(F.col("iv") <= F.col("iv_cut")).alias("kept")))


@CAT.add("days_to_expiry", sql("chain", """
SELECT ticker, side, CAST(expiry AS VARCHAR) AS expiry, max(dte) - 1 AS dte_evening, max(dte) AS dte_day FROM chain GROUP BY ALL"""))
def days_to_expiry(spark, sf):
    c = b.option_chain(spark, sf).select("ticker", "side", "expiry").distinct()
    evening = F.lit(dt.datetime(1998, 6, 1, 18, 30))
    return show(c.select("ticker", "side", "expiry",
                         ch.days_to_expiry(F.col("expiry"), evening).alias("dte_evening"),
                         ch.days_to_expiry(F.col("expiry"), F.lit(AS_OF)).alias("dte_day")))


# --- indicators and scores ---------------------------------------------------

register("px1", ("prices",), "SELECT * FROM prices WHERE dt > DATE '1997-06-01' AND dt <= DATE '1998-06-01'")
register("ind", ("px1", "fcst"), """
SELECT ticker, coalesce(rsi, 50) AS rsi, coalesce(beta, 1) AS beta, coalesce(momentum, 0) AS momentum, coalesce(confidence, 0.5) AS forecast,
       rsi IS NOT NULL AS has_rsi, beta IS NOT NULL AS has_beta, momentum IS NOT NULL AS has_momentum, confidence IS NOT NULL AS has_forecast
FROM (
  SELECT x.ticker,
    CASE WHEN count(*) >= 15 THEN CASE WHEN sum(greatest(-chg, 0) * wt) = 0 THEN CASE WHEN sum(greatest(chg, 0) * wt) > 0 THEN 100.0 END
         ELSE 100 - 100 / (1 + sum(greatest(chg, 0) * wt) / sum(greatest(-chg, 0) * wt)) END END AS rsi,
    CASE WHEN count(CASE WHEN ret IS NOT NULL AND mkt IS NOT NULL THEN 1 END) >= 20
         THEN covar_samp(ret, mkt) / nullif(var_samp(CASE WHEN ret IS NOT NULL THEN mkt END), 0) END AS beta,
    max(CASE WHEN k = 0 THEN close END) / max(CASE WHEN k = 20 THEN close END) - 1 AS momentum, count(*) AS n_bars
  FROM (SELECT ticker, dt, close, close - lag(close) OVER w AS chg, close / lag(close) OVER w - 1 AS ret,
               pow(1 - 2.0 / 15, row_number() OVER d - 1) AS wt, row_number() OVER d - 1 AS k
        FROM px1 WINDOW w AS (PARTITION BY ticker ORDER BY dt), d AS (PARTITION BY ticker ORDER BY dt DESC)) x
  LEFT JOIN (SELECT dt, close / lag(close) OVER (ORDER BY dt) - 1 AS mkt FROM (SELECT dt, avg(close) AS close FROM px1 GROUP BY dt) i) m USING (dt)
  GROUP BY x.ticker) y
LEFT JOIN (SELECT concat('S', substr(ticker, 2)) AS ticker, confidence FROM fcst) f USING (ticker)
WHERE n_bars >= 30""")

IND_OUT = "ticker, " + rcols("rsi beta momentum forecast") + ", " + ", ".join(
    f"CAST(has_{x} AS INT) AS has_{x}" for x in ("rsi", "beta", "momentum", "forecast"))


def stock_forecasts(spark, sf):
    """Forecasts re-keyed to the supplier tickers (same number, prefix S)."""
    t = b.analyst_targets(spark, sf).withColumn("ticker", F.concat(F.lit("S"), F.substr("ticker", F.lit(2))))
    return fc.with_confidence(fc.target_summary(t.where(F.col("ticker").isNotNull())))


def indicators(spark, sf):
    px = bars.daily(spark, sf, start=YEAR_AGO, end=AS_OF).select("ticker", "dt", "close")
    return sc.indicator_row(sc.price_indicators(px), stock_forecasts(spark, sf))


register("chain_iv", ("chain",), """
SELECT ticker, coalesce(sum(CASE WHEN volume > 0 THEN iv * volume END) / nullif(sum(CASE WHEN volume > 0 THEN volume END), 0), avg(iv)) AS avg_iv
FROM chain WHERE side = 'C' GROUP BY ticker""")


@CAT.add("indicator_row", sql("ind chain_iv", f"""
SELECT {IND_OUT}, {r('coalesce(avg_iv, 0.2)')} AS avg_iv, CAST(avg_iv IS NOT NULL AS INT) AS has_iv FROM ind LEFT JOIN chain_iv USING (ticker)"""))
def indicator_row(spark, sf):
    calls = b.option_chain(spark, sf).where("side = 'C'")
    return show(sc.with_mean_iv(indicators(spark, sf), ch.mean_iv(calls, ["ticker"]), ["ticker"]))


SRC = ("rsi", "beta", "momentum", "iv", "forecast")


def weight_sum(weights: dict[str, float]) -> str:
    return " + ".join(f"CASE WHEN has_{k} THEN {w} ELSE 0 END" for k, w in weights.items())


def composite(parts: dict[str, str], neutral: float, weights: dict[str, float] | None = None) -> str:
    weights = weights or {k: 0.2 for k in SRC}
    num_ = " + ".join(f"CASE WHEN has_{k} THEN {weights[k]} * ({parts[k]}) ELSE 0 END" for k in SRC)
    return f"coalesce(({num_}) / nullif({weight_sum(weights)}, 0), {neutral})"


def clip(x: str, lo="0.0", hi="1.0") -> str:
    return f"greatest({lo}, least({hi}, {x}))"


def best(fields: str, source: str, per_level: tuple[str, str, str], lim: tuple[int, int, int], tie: str) -> str:
    picks = []
    per_level = tuple(re.sub(r"(\w+)( DESC)?(, |$)", r"floor(\1 * 1e9 + 0.5)\2\3", order) for order in per_level)
    for level, order, k in zip(cfg.RISK_LEVELS, per_level, lim):
        picks.append(f"""SELECT {fields} FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY {order}, {tie}) AS rank
FROM {source} WHERE risk = '{level}') q WHERE rank <= {k}""")
    return "\nUNION ALL\n".join(picks)


def risk_table(bands: dict[str, dict]) -> str:
    cols = list(next(iter(bands.values())))
    rows = ", ".join("('" + r_ + "', " + ", ".join(str(float(v)) for v in d.values()) + ")" for r_, d in bands.items())
    return f"(VALUES {rows}) AS band(risk, {', '.join(cols)})"


IVX = """coalesce(sum(CASE WHEN volume > 0 THEN iv * volume END) OVER g / nullif(sum(CASE WHEN volume > 0 THEN volume END) OVER g, 0), avg(iv) OVER g)"""

register("lc0", ("chain",), f"""
SELECT * FROM (SELECT c.*, risk, floor_days, quantile_cont(iv, 0.95) OVER (PARTITION BY ticker, risk) AS cut
FROM chain c JOIN {risk_table(cfg.LONG_CALL_BANDS)} ON strike / spot >= lo AND strike / spot <= hi WHERE side = 'C' AND dte >= 180) x
WHERE (risk <> 'Conservative' OR iv <= cut) AND dte >= floor_days""")
LC = composite({
    "rsi": norm("rsi", "0", "100", True),
    "beta": f"CASE WHEN beta < 0.5 THEN 0.2 WHEN beta > 2.0 THEN 0.3 ELSE {norm('beta', '0.5', '1.5')} END",
    "momentum": norm("momentum", "-0.1", "0.1"), "forecast": "forecast",
    "iv": norm("iv", "avg_iv * 0.5", "avg_iv * 1.5", True)}, 0.5)
register("lc1", ("lc0", "ind", "esig"), f"""
SELECT *, composite_score * CASE signal WHEN 'confirm' THEN 1.1 WHEN 'veto' THEN 0.9 ELSE 1.0 END AS final_score FROM (
SELECT *, {clip('''CASE risk WHEN 'Conservative' THEN base * (1 - greatest(0, (iv - avg_iv) / avg_iv * 0.2)) * (1 + least(0.15, dte / 365 * 0.1))
   WHEN 'Aggressive' THEN base * CASE WHEN momentum > 0 THEN 1 + least(0.2, momentum * 10) ELSE 1 END * CASE WHEN beta > 1 THEN 1 + least(0.15, (beta - 1) * 0.2) ELSE 1 END
   ELSE base END''')} AS composite_score FROM (
SELECT *, {LC} AS base FROM (
SELECT c.*, i.* EXCLUDE (ticker), {IVX} AS avg_iv, true AS has_iv, coalesce(e.score, 0.5) AS ecosystem_score,
       coalesce(e.signal, 'neutral') AS signal, coalesce(e.confidence, 0.5) AS confidence
FROM lc0 c JOIN ind i USING (ticker) LEFT JOIN esig e USING (ticker) WINDOW g AS (PARTITION BY ticker, risk)) a) b) z""")
LC_FIELDS = ("ticker, risk, rank, CAST(expiry AS VARCHAR) AS expiry, " + rcols(
    "strike last_price iv rsi beta momentum forecast composite_score final_score ecosystem_score confidence") + ", signal, CAST(dte AS INT) AS dte")


def top_long(k: tuple[int, int, int]) -> str:
    return best(LC_FIELDS, "lc1", ("final_score DESC, iv, dte DESC", "final_score DESC, dte", "final_score DESC"), k, "expiry, strike")


@CAT.add("long_calls", sql("lc1", top_long((5, 5, 10))))
def long_calls(spark, sf):
    t = st.long_calls(b.option_chain(spark, sf), indicators(spark, sf), peer_signals(spark, sf))
    return show(t.select(
        "ticker", "risk", "rank", "expiry", "strike", "last_price", "iv", "rsi", "beta", "momentum", "forecast",
        "composite_score", "final_score", "ecosystem_score", "confidence", "signal", "dte"))


@CAT.add("long_call_filter", sql("lc0", """
SELECT ticker, risk, count(*) AS n, CAST(min(dte) AS INT) AS min_dte, floor(max(iv) * 1e6 + 0.5) / 1e6 AS max_iv FROM lc0 GROUP BY ticker, risk"""))
def long_call_filter(spark, sf):
    return show(st.long_call_filter(b.option_chain(spark, sf)).groupBy("ticker", "risk").agg(
        F.count("*").alias("n"), F.min("dte").alias("min_dte"), F.max("iv").alias("max_iv")))


SP = composite({
    "rsi": norm("rsi", "25", "65", True), "beta": norm("beta", "0.8", "1.5"), "momentum": norm("momentum", "-0.05", "0.1"),
    "forecast": "forecast", "iv": "0.5"}, 0.0)
register("callsiv", ("chain",), f"""
SELECT ticker, risk, coalesce(sum(CASE WHEN volume > 0 THEN iv * volume END) / nullif(sum(CASE WHEN volume > 0 THEN volume END), 0), avg(iv)) AS avg_iv
FROM chain JOIN {risk_table({r_: dict(days=60.0) for r_ in cfg.RISK_LEVELS})} ON dte >= days WHERE side = 'C' GROUP BY ticker, risk""")
register("sp0", ("chain",), f"""
SELECT *, max_profit / net_premium AS profit_ratio FROM (
SELECT l.ticker, l.expiry, l.dte, l.spot, l.strike AS long_strike, s.strike AS short_strike, l.last_price AS long_price, s.last_price AS short_price,
       l.iv AS long_iv, s.iv AS short_iv, (l.iv + s.iv) / 2 AS iv, s.strike - l.strike AS spread_width, l.last_price - s.last_price AS net_premium,
       s.strike - l.strike - (l.last_price - s.last_price) AS max_profit, l.strike + (l.last_price - s.last_price) AS break_even
FROM (SELECT *, row_number() OVER (PARTITION BY ticker, expiry ORDER BY strike) AS rn FROM chain WHERE side = 'C' AND dte >= 180) l
JOIN (SELECT *, row_number() OVER (PARTITION BY ticker, expiry ORDER BY strike) AS rn FROM chain WHERE side = 'C' AND dte >= 180) s
  ON s.ticker = l.ticker AND s.expiry = l.expiry AND s.rn BETWEEN l.rn + 1 AND l.rn + 7) x
WHERE net_premium > 0 AND max_profit > 0""")
register("sp1", ("sp0", "ind"), f"""
SELECT *, {clip('''CASE risk WHEN 'Conservative' THEN base * (1 + greatest(0, least(0.3, least((profit_ratio - 1) * 0.2, 0.3))) - least(spread_width / (mean_width * 2) * 0.1, 0.2))
   WHEN 'Aggressive' THEN base * (1 + greatest(0, least(0.25, max_profit / mean_profit * 0.15))) ELSE base END''')} AS composite_score FROM (
SELECT *, {clip(f'({SP}) * (1 + CASE WHEN profit_ratio > 1 THEN least((profit_ratio - 1) * 0.25, 0.3) ELSE 0 END)')} AS base,
       avg(spread_width) OVER (PARTITION BY ticker, risk) AS mean_width, avg(max_profit) OVER (PARTITION BY ticker, risk) AS mean_profit
FROM (SELECT s.*, risk, i.* EXCLUDE (ticker), true AS has_iv FROM sp0 s
      JOIN {risk_table(cfg.SPREAD_BANDS)} ON spread_width <= spot * max_width AND profit_ratio >= min_ratio JOIN ind i USING (ticker)) a) z""")
SP_FIELDS = ("ticker, risk, rank, CAST(expiry AS VARCHAR) AS expiry, " + rcols(
    "long_strike short_strike long_price short_price net_premium max_profit break_even profit_ratio spread_width iv composite_score") + ", CAST(dte AS INT) AS dte")


@CAT.add("bull_call_spread", sql("sp1", best(SP_FIELDS, "sp1", (
    "composite_score DESC, profit_ratio DESC, dte DESC", "composite_score DESC, profit_ratio DESC", "composite_score DESC, max_profit DESC, profit_ratio DESC"),
    (5, 5, 10), "expiry, long_strike, short_strike")))
def bull_call_spread(spark, sf):
    t = st.bull_call_spread(b.option_chain(spark, sf), indicators(spark, sf))
    return show(t.select(
        "ticker", "risk", "rank", "expiry", "long_strike", "short_strike", "long_price", "short_price", "net_premium",
        "max_profit", "break_even", "profit_ratio", "spread_width", "iv", "composite_score", "dte"))


@CAT.add("spread_pairs", sql("sp0", f"SELECT ticker, CAST(expiry AS VARCHAR) AS expiry, {rcols('long_strike short_strike net_premium profit_ratio')} FROM sp0"))
def spread_pairs(spark, sf):
    t = st.spread_pairs(ch.contracts(b.option_chain(spark, sf), "C", 180)).withColumn(
        "net_premium", F.col("long_price") - F.col("short_price"))
    t = t.withColumn("max_profit", F.col("short_strike") - F.col("long_strike") - F.col("net_premium"))
    t = t.where("net_premium > 0 AND max_profit > 0")
    return show(t.select("ticker", "expiry", "long_strike", "short_strike", "net_premium",
                         (F.col("max_profit") / F.col("net_premium")).alias("profit_ratio")))


CC = composite({
    "rsi": f"CASE WHEN rsi < 70 THEN {norm('rsi', '30', '70')} ELSE 0.3 END", "beta": norm("beta", "0.5", "1.2", True),
    "momentum": norm("momentum", "-0.05", "0.05"), "forecast": "least(forecast, 0.7)", "iv": norm("iv", "avg_iv * 0.8", "avg_iv * 1.5")}, 0.0)
register("cc1", ("chain", "ind", "callsiv"), f"""
SELECT *, {clip('''CASE risk WHEN 'Conservative' THEN base * (1 - assignment_probability * 0.3) * (1 + least(0.2, dte / 90 * 0.1))
   WHEN 'Aggressive' THEN base * (1 + least(annualized_yield / 50, 0.3)) * (1 + assignment_probability * 0.1) ELSE base END''')} AS composite_score FROM (
SELECT *, {clip(f'({CC}) * (1 + least(annualized_yield / 50, 0.3))')} AS base FROM (
SELECT c.*, b.risk, i.* EXCLUDE (ticker), v.avg_iv, v.avg_iv IS NOT NULL AS has_iv, last_price / spot * 100 AS premium_yield,
       last_price / spot * 100 * 365 / dte AS annualized_yield, (strike - spot) / spot * 100 AS upside_capture,
       last_price / spot * 100 + (strike - spot) / spot * 100 AS total_return, greatest(0, least(1, (spot - strike) / spot + 0.5)) AS assignment_probability
FROM chain c JOIN {risk_table(cfg.COVERED_CALL_BANDS).replace('AS band', 'AS b')} ON strike >= spot * (1 + lo) AND strike <= spot * (1 + hi) AND last_price / spot * 100 >= min_yield * 100
JOIN ind i USING (ticker) LEFT JOIN callsiv v ON v.ticker = c.ticker AND v.risk = b.risk WHERE side = 'C' AND dte >= 60) a) z""")
CC_FIELDS = ("ticker, risk, rank, CAST(expiry AS VARCHAR) AS expiry, " + rcols(
    "strike last_price iv premium_yield annualized_yield upside_capture total_return assignment_probability composite_score") + ", CAST(dte AS INT) AS dte")


@CAT.add("covered_call", sql("cc1", best(CC_FIELDS, "cc1", (
    "composite_score DESC, assignment_probability, annualized_yield DESC", "composite_score DESC, annualized_yield DESC",
    "composite_score DESC, annualized_yield DESC, total_return DESC"), (5, 5, 8), "expiry, strike")))
def covered_call(spark, sf):
    t = st.covered_call(b.option_chain(spark, sf), indicators(spark, sf), min_days=60)
    return show(t.select(
        "ticker", "risk", "rank", "expiry", "strike", "last_price", "iv", "premium_yield", "annualized_yield",
        "upside_capture", "total_return", "assignment_probability", "composite_score", "dte"))


CP = composite({
    "rsi": norm("rsi", "20", "60", True), "beta": norm("beta", "0.7", "1.3"), "momentum": norm("momentum", "-0.1", "0.05", True),
    "forecast": "forecast", "iv": norm("iv", "avg_iv * 0.8", "avg_iv * 1.5")}, 0.0)
register("cp1", ("chain", "ind", "callsiv"), f"""
SELECT *, {clip('''CASE risk WHEN 'Conservative' THEN base * (1 - assignment_probability * 0.25) * (1 + least(discount_to_current / 20, 0.2))
   WHEN 'Aggressive' THEN base * (1 + least(annualized_yield / 40, 0.3)) * (1 + assignment_probability * 0.05) ELSE base END''')} AS composite_score FROM (
SELECT *, {clip(f'({CP}) * (1 + least(annualized_yield / 40, 0.2) + least(discount_to_current / 20, 0.2))')} AS base FROM (
SELECT c.*, b.risk, i.* EXCLUDE (ticker), coalesce(v.avg_iv, 0.2) AS avg_iv, v.avg_iv IS NOT NULL AS has_iv, last_price / strike * 100 AS premium_yield,
       last_price / strike * 100 * 365 / dte AS annualized_yield, (spot - strike) / spot * 100 AS assignment_discount,
       strike - last_price AS effective_cost, (spot - (strike - last_price)) / spot * 100 AS discount_to_current,
       greatest(0, least(1, (strike - spot) / spot + 0.5)) AS assignment_probability
FROM chain c JOIN {risk_table(cfg.CASH_PUT_BANDS).replace('AS band', 'AS b')} ON strike <= spot * (1 - lo) AND strike >= spot * (1 - hi) AND last_price / strike * 100 >= min_yield * 100
JOIN ind i USING (ticker) LEFT JOIN callsiv v ON v.ticker = c.ticker AND v.risk = b.risk WHERE side = 'P' AND dte >= 60) a) z""")
CP_FIELDS = ("ticker, risk, rank, CAST(expiry AS VARCHAR) AS expiry, " + rcols(
    "strike last_price iv premium_yield annualized_yield assignment_discount effective_cost discount_to_current assignment_probability composite_score") + ", CAST(dte AS INT) AS dte")


@CAT.add("cash_secured_put", sql("cp1", best(CP_FIELDS, "cp1", (
    "composite_score DESC, assignment_probability, discount_to_current DESC", "composite_score DESC, annualized_yield DESC",
    "composite_score DESC, annualized_yield DESC, assignment_probability DESC"), (5, 5, 8), "expiry, strike")))
def cash_secured_put(spark, sf):
    t = st.cash_secured_put(b.option_chain(spark, sf), indicators(spark, sf), min_days=60)
    return show(t.select(
        "ticker", "risk", "rank", "expiry", "strike", "last_price", "iv", "premium_yield", "annualized_yield",
        "assignment_discount", "effective_cost", "discount_to_current", "assignment_probability", "composite_score", "dte"))
