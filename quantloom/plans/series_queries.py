"""Price-series queries: returns, indicators, bands, risk of a series."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import series as s
from quantloom.plans.common import Catalog, show
from quantloom.plans.oracle import r, rcols, sql
from quantloom.sources import bars
from quantloom.sources import bindings as b

CAT = Catalog()
W = "(PARTITION BY ticker ORDER BY dt)"
D = "CAST(dt AS VARCHAR) AS dt"


def frame(n: int) -> str:
    return f"(PARTITION BY ticker ORDER BY dt ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


@CAT.add("returns_simple", sql("ret", f"SELECT ticker, {D}, {r('ret')} AS ret FROM ret"))
def returns_simple(spark, sf):
    return show(s.with_returns(bars.daily(spark, sf)).select("ticker", "dt", "ret"))


@CAT.add("returns_log", sql("ret", f"SELECT ticker, {D}, {r('ln(1 + ret)')} AS ret FROM ret"))
def returns_log(spark, sf):
    return show(s.with_returns(bars.daily(spark, sf), "log").select("ticker", "dt", "ret"))


RANKED = "SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY dt DESC) - 1 AS k FROM prices"


def nth(k: int) -> str:
    return f"max(CASE WHEN k = {k} THEN close END)"


@CAT.add("momentum_20", sql("prices", f"""
SELECT ticker, {r(f'{nth(0)} / {nth(20)} - 1')} AS momentum, {r(f'{nth(0)} / {nth(19)} - 1')} AS momentum_chart
FROM ({RANKED}) x GROUP BY ticker"""))
def momentum_20(spark, sf):
    p = s.last_n_prices(bars.daily(spark, sf), [0, 19, 20])
    return show(p.select(
        "ticker",
        (s.div("p0", "p20") - 1).alias("momentum"),
        (s.div("p0", "p19") - 1).alias("momentum_chart"),
    ))


@CAT.add("trailing_returns", sql("prices", f"""
SELECT ticker, {r(f'{nth(0)} / {nth(1)} - 1')} AS ret_1, {r(f'{nth(0)} / {nth(5)} - 1')} AS ret_5,
       {r(f'{nth(0)} / {nth(30)} - 1')} AS ret_30
FROM ({RANKED}) x GROUP BY ticker"""))
def trailing_returns(spark, sf):
    return show(s.trailing_returns(bars.daily(spark, sf)))


RSI_EWM = """
SELECT ticker, CASE WHEN count(*) >= 15 THEN
         CASE WHEN sum(l * wt) = 0 THEN CASE WHEN sum(g * wt) > 0 THEN 100.0 END
              ELSE 100 - 100 / (1 + sum(g * wt) / sum(l * wt)) END END AS rsi
FROM (SELECT ticker, greatest(c, 0) AS g, greatest(-c, 0) AS l, pow(1 - 2.0 / 15, k) AS wt FROM (
        SELECT ticker, close - lag(close) OVER (PARTITION BY ticker ORDER BY dt) AS c,
               row_number() OVER (PARTITION BY ticker ORDER BY dt DESC) - 1 AS k FROM prices) a) b
GROUP BY ticker"""


@CAT.add("rsi_ewm", sql("prices", f"SELECT ticker, {rcols('rsi')} FROM ({RSI_EWM}) x"))
def rsi_ewm(spark, sf):
    return show(s.rsi_ewm(bars.daily(spark, sf)))


RSI_SMA = f"""
SELECT *, CASE WHEN n < 14 THEN NULL WHEN ll = 0 THEN CASE WHEN gg > 0 THEN 100.0 END
               ELSE 100 - 100 / (1 + gg / ll) END AS rsi
FROM (SELECT *, avg(greatest(c, 0)) OVER {frame(14)} AS gg, avg(greatest(-c, 0)) OVER {frame(14)} AS ll,
             count(*) OVER {frame(14)} AS n
      FROM (SELECT *, coalesce(close - lag(close) OVER {W}, 0) AS c FROM prices) a) b"""


@CAT.add("rsi_sma", sql("prices", f"SELECT ticker, {D}, {rcols('rsi')} FROM ({RSI_SMA}) x"))
def rsi_sma(spark, sf):
    return show(s.rsi_sma(bars.daily(spark, sf)).select("ticker", "dt", "rsi"))


def full(fn: str, c: str, n: int) -> str:
    return f"CASE WHEN count({c}) OVER {frame(n)} = {n} THEN {fn}({c}) OVER {frame(n)} END"


@CAT.add("technical_signals", sql("prices", f"""
SELECT ticker, {rcols('rsi sma_20 sma_50 avg_volume trend')},
  CASE WHEN rsi > 70 THEN 'Overbought' WHEN rsi < 30 THEN 'Oversold' WHEN rsi IS NOT NULL THEN 'Neutral' END AS rsi_signal,
  CASE WHEN sma_50 IS NULL THEN NULL WHEN close > sma_20 AND sma_20 > sma_50 THEN 'Bullish'
       WHEN close < sma_20 AND sma_20 < sma_50 THEN 'Bearish' ELSE 'Mixed' END AS ma_signal,
  CASE WHEN volume > 1.5 * avg_volume THEN 'High Volume' ELSE 'Normal' END AS volume_signal,
  CASE WHEN trend IS NULL THEN NULL WHEN trend > 0.05 THEN 'Uptrend' WHEN trend < -0.05 THEN 'Downtrend'
       ELSE 'Sideways' END AS trend_signal
FROM (SELECT *, {full('avg', 'close', 20)} AS sma_20, {full('avg', 'close', 50)} AS sma_50,
             {full('avg', 'volume', 20)} AS avg_volume, close / lag(close, 19) OVER {W} - 1 AS trend,
             row_number() OVER (PARTITION BY ticker ORDER BY dt DESC) AS rn FROM ({RSI_SMA}) q) x
WHERE rn = 1"""))
def technical_signals(spark, sf):
    return show(s.technical_signals(bars.daily(spark, sf)))


@CAT.add("sma_bollinger", sql("prices", f"""
SELECT ticker, {D}, {rcols('sma_20 sma_50 sma_200 bb_mid bb_upper bb_lower')} FROM (
SELECT ticker, dt, {full('avg', 'close', 20)} AS sma_20, {full('avg', 'close', 50)} AS sma_50,
       {full('avg', 'close', 200)} AS sma_200, {full('avg', 'close', 20)} AS bb_mid,
       {full('avg', 'close', 20)} + 2 * {full('stddev_samp', 'close', 20)} AS bb_upper,
       {full('avg', 'close', 20)} - 2 * {full('stddev_samp', 'close', 20)} AS bb_lower
FROM prices) x"""))
def sma_bollinger(spark, sf):
    t = s.bollinger(s.moving_averages(bars.daily(spark, sf)))
    return show(t.select("ticker", "dt", "sma_20", "sma_50", "sma_200", "bb_mid", "bb_upper", "bb_lower"))


STATS = {"mean": "avg", "std": "stddev_samp", "var": "var_samp", "min": "min", "max": "max"}


@CAT.add("rolling_stats", sql("ret", f"SELECT ticker, {D}, " + ", ".join(
    f"{r(full(fn, 'ret', 30))} AS {k}_30" for k, fn in STATS.items()) + " FROM ret"))
def rolling_stats(spark, sf):
    t = s.rolling_stats(s.with_returns(bars.daily(spark, sf)), "ret", 30)
    return show(t.select("ticker", "dt", *[f"{k}_30" for k in s.ROLLING]))


@CAT.add("high_low_52w", sql("prices", f"""
SELECT ticker, {r('max(close)')} AS high_52w, {r('min(close)')} AS low_52w
FROM ({RANKED}) x WHERE k < 252 GROUP BY ticker"""))
def high_low_52w(spark, sf):
    return show(s.high_low_52w(bars.daily(spark, sf)))


def decay_step(prev: str, value: str, span: int) -> str:
    return f"({prev} * (1 - 2.0 / {span + 1}) + {value} * (2.0 / {span + 1}))"


EMA_SQL = sql("prices", "").rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + f""",
num AS (SELECT ticker, dt, close, row_number() OVER {W} AS i FROM prices),
lines AS (
  SELECT ticker, dt, i, close AS ema_12, close AS ema_26 FROM num WHERE i = 1
  UNION ALL
  SELECT n.ticker, n.dt, n.i, {decay_step('l.ema_12', 'n.close', 12)}, {decay_step('l.ema_26', 'n.close', 26)}
  FROM lines l JOIN num n ON n.ticker = l.ticker AND n.i = l.i + 1),
sig AS (
  SELECT ticker, dt, i, ema_12 - ema_26 AS macd, ema_12 - ema_26 AS macd_signal FROM lines WHERE i = 1
  UNION ALL
  SELECT n.ticker, n.dt, n.i, n.ema_12 - n.ema_26, {decay_step('l.macd_signal', '(n.ema_12 - n.ema_26)', 9)}
  FROM sig l JOIN lines n ON n.ticker = l.ticker AND n.i = l.i + 1)
SELECT ticker, {D}, {rcols('ema_12 ema_26 macd macd_signal')}, {r('macd - macd_signal')} AS macd_hist
FROM lines JOIN sig USING (ticker, dt)"""


@CAT.add("ema_macd", EMA_SQL)
def ema_macd(spark, sf):
    return show(s.macd(bars.daily(spark, sf)).select(
        "ticker", "dt", "ema_12", "ema_26", "macd", "macd_signal", "macd_hist"))


@CAT.add("volatility", sql("ret", f"""
SELECT ticker, {r('stddev_samp(ret) * sqrt(252)')} AS volatility, {r('max_by(rv, dt)')} AS rolling_vol
FROM (SELECT *, {full('stddev_samp', 'ret', 30)} * sqrt(252) AS rv FROM ret) x GROUP BY ticker"""))
def volatility(spark, sf):
    w = s.by_day()
    ret = s.with_returns(bars.daily(spark, sf))
    rv = ret.withColumn("rv", s.rolling("ret", 30, "std", w) * s.math.sqrt(s.TRADING_DAYS))
    return show(rv.groupBy("ticker").agg(
        (F.stddev_samp("ret") * s.math.sqrt(s.TRADING_DAYS)).alias("volatility"),
        F.max_by("rv", "dt").alias("rolling_vol"),
    ))


PRICE_RISK = f"""
SELECT ticker, stddev_samp(ret) * sqrt(252) AS volatility, quantile_cont(ret, 0.05) AS var_95,
       min(dd) AS max_drawdown, count(*) AS n_returns
FROM (SELECT *, cum / max(cum) OVER (PARTITION BY ticker ORDER BY dt) - 1 AS dd
      FROM (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY ticker ORDER BY dt)) AS cum FROM ret) a) b
GROUP BY ticker"""


@CAT.add("var95_drawdown", sql("ret", f"SELECT ticker, {rcols('volatility var_95 max_drawdown')}, n_returns FROM ({PRICE_RISK}) x"))
def var95_drawdown(spark, sf):
    return show(s.price_risk(bars.daily(spark, sf)))


@CAT.add("price_change", sql("prices", f"""
SELECT ticker, {r('max_by(close, dt)')} AS latest_price, {r('max_by(close, dt) / min_by(close, dt) - 1')} AS window_change,
       {r('(max_by(close, dt) / max_by(prev, dt) - 1) * 100')} AS day_change_pct
FROM (SELECT *, lag(close) OVER {W} AS prev FROM prices) x GROUP BY ticker"""))
def price_change(spark, sf):
    return show(s.price_change(bars.daily(spark, sf)))


@CAT.add("trend_status", sql("prices bench", f"""
SELECT ticker, {rcols('close index_close')},
  CASE WHEN prev IS NULL OR prev = 0 THEN 'flat' WHEN (close - prev) / abs(prev) > 0.01 THEN 'up'
       WHEN (close - prev) / abs(prev) < -0.01 THEN 'down' ELSE 'flat' END AS direction,
  CASE WHEN (close - index_close) / index_close > 0.1 THEN 'good' WHEN (close - index_close) / index_close <= -0.1 THEN 'bad' ELSE 'neutral' END AS status_high,
  CASE WHEN (close - index_close) / index_close < -0.1 THEN 'good' WHEN (close - index_close) / index_close >= 0.1 THEN 'bad' ELSE 'neutral' END AS status_low
FROM (SELECT p.ticker, p.close, b.close AS index_close, lag(p.close) OVER (PARTITION BY p.ticker ORDER BY p.dt) AS prev,
             row_number() OVER (PARTITION BY p.ticker ORDER BY p.dt DESC) AS rn
      FROM prices p JOIN bench b USING (dt)) x WHERE rn = 1"""))
def trend_status(spark, sf):
    px = bars.daily(spark, sf)
    index = F.broadcast(b.benchmark(px).withColumnRenamed("close", "index_close"))  # one row per calendar day
    t = px.select("ticker", "dt", "close").join(index, "dt").withColumn("prev", F.lag("close").over(s.by_day()))
    return show(s.latest(t).select(
        "ticker", "close", "index_close",
        s.trend_direction("close", "prev").alias("direction"),
        s.benchmark_status("close", "index_close").alias("status_high"),
        s.benchmark_status("close", "index_close", higher_better=False).alias("status_low"),
    ))
