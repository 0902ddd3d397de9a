"""Per-ticker time-series operators over daily bars (ticker, dt, open..volume).

All windows are partitioned by ticker and ordered by day.  Bars are unique on
(ticker, dt), so a partition is bounded by the number of calendar days.
``full(N)`` columns are NULL until N values are in the frame.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.functions.numeric import col, div

TRADING_DAYS = 252


def by_day(key: str = "ticker", ts: str = "dt"):
    return W.partitionBy(key).orderBy(ts)


def from_end(key: str = "ticker", ts: str = "dt"):
    return W.partitionBy(key).orderBy(F.desc(ts))


def trailing(w, n: int):
    return w.rowsBetween(-(n - 1), 0)


# --- returns -----------------------------------------------------------------

def with_returns(px: DataFrame, method: str = "simple", value: str = "close", out: str = "ret",
                 key: str = "ticker", ts: str = "dt") -> DataFrame:
    """Bar-over-bar return, the first bar of each ticker removed."""
    prev = F.lag(value).over(by_day(key, ts))
    if method == "simple":
        r = div(F.col(value), prev) - 1
    elif method == "log":
        r = F.log(div(F.col(value), prev))
    else:
        raise ValueError(f"unknown return method {method!r}")
    return px.withColumn(out, r).where(F.col(out).isNotNull())


def lagged_return(value: str, bars: int, w) -> Column:
    return div(F.col(value), F.lag(value, bars).over(w)) - 1


def latest(df: DataFrame, key: str = "ticker", ts: str = "dt") -> DataFrame:
    """The last row per key."""
    return df.withColumn("_r", F.row_number().over(from_end(key, ts))).where("_r = 1").drop("_r")


def momentum(px: DataFrame, bars: int = 20, key: str = "ticker", ts: str = "dt", value: str = "close") -> DataFrame:
    """(p_last - p_lag) / p_lag over non-null prices; NULL with too short a history.

    ``bars=20`` is the indicator; ``bars=19`` the chart variant that looks at
    the 20th price from the end.
    """
    return last_n_prices(px, [0, bars], key, ts, value).select(
        key, (div(F.col("p0"), F.col(f"p{bars}")) - 1).alias("momentum")
    )


def last_n_prices(px: DataFrame, offsets: list[int], key="ticker", ts="dt", value="close") -> DataFrame:
    """One row per key with the price ``offsets`` bars before the last (p0, p1, ...) and n."""
    ranked = px.where(F.col(value).isNotNull()).withColumn(
        "_k", F.row_number().over(from_end(key, ts)) - 1
    )
    return ranked.groupBy(key).agg(
        *[F.max(F.when(F.col("_k") == o, F.col(value))).alias(f"p{o}") for o in offsets],
        F.count("*").alias("n"),
    )


def trailing_returns(px: DataFrame, key="ticker", ts="dt", value="close") -> DataFrame:
    """Returns over the last 1, 5 and 30 bars."""
    p = last_n_prices(px, [0, 1, 5, 30], key, ts, value)
    return p.select(key, *[(div(F.col("p0"), F.col(f"p{k}")) - 1).alias(f"ret_{k}") for k in (1, 5, 30)])


# --- RSI ---------------------------------------------------------------------

def rsi_from(gain: Column, loss: Column) -> Column:
    """100 - 100/(1 + gain/loss); no losses gives 100, no movement at all gives NULL."""
    return F.when(loss == 0, F.when(gain > 0, F.lit(100.0))).otherwise(100 - 100 / (1 + gain / loss))


def rsi_sma(px: DataFrame, period: int = 14, key="ticker", ts="dt", value="close", out="rsi") -> DataFrame:
    """RSI with rolling means; the first bar's change counts as zero."""
    w = by_day(key, ts)
    chg = F.coalesce(F.col(value) - F.lag(value).over(w), F.lit(0.0))
    f = trailing(w, period)
    up, down = F.greatest(F.col("_chg"), F.lit(0.0)), F.greatest(-F.col("_chg"), F.lit(0.0))
    return (
        px.withColumn("_chg", chg)
        .withColumns({"_g": F.avg(up).over(f), "_l": F.avg(down).over(f), "_n": F.count("_chg").over(f)})
        .withColumn(out, F.when(F.col("_n") == period, rsi_from(F.col("_g"), F.col("_l"))))
        .drop("_chg", "_g", "_l", "_n")
    )


def rsi_ewm(px: DataFrame, period: int = 14, key="ticker", ts="dt", value="close", out="rsi") -> DataFrame:
    """Latest RSI with span-weighted means: one aggregate, since the weight norms cancel in gain/loss."""
    p = px.where(F.col(value).isNotNull())
    w = by_day(key, ts)
    decay = 1 - 2.0 / (period + 1)
    moved = p.select(
        key,
        (F.col(value) - F.lag(value).over(w)).alias("_chg"),
        F.pow(F.lit(decay), F.row_number().over(from_end(key, ts)) - 1).alias("_wt"),
    )
    sums = moved.groupBy(key).agg(
        F.sum(F.greatest(F.col("_chg"), F.lit(0.0)) * F.col("_wt")).alias("_g"),
        F.sum(F.greatest(-F.col("_chg"), F.lit(0.0)) * F.col("_wt")).alias("_l"),
        F.count("*").alias("_n"),
    )
    return sums.select(
        key, F.when(F.col("_n") >= period + 1, rsi_from(F.col("_g"), F.col("_l"))).alias(out)
    )


# --- rolling statistics ------------------------------------------------------

ROLLING = {
    "mean": F.avg, "std": F.stddev_samp, "var": F.var_samp, "min": F.min, "max": F.max,
}


def rolling(value: str, n: int, stat: str, w) -> Column:
    """full(n) rolling statistic over the last n rows."""
    f = trailing(w, n)
    return F.when(F.count(value).over(f) == n, ROLLING[stat](value).over(f))


def rolling_stats(df: DataFrame, value: str, n: int, stats=tuple(ROLLING), key="ticker", ts="dt") -> DataFrame:
    w = by_day(key, ts)
    return df.withColumns({f"{s}_{n}": rolling(value, n, s, w) for s in stats})


def moving_averages(px: DataFrame, windows=(20, 50, 200), key="ticker", ts="dt", value="close") -> DataFrame:
    w = by_day(key, ts)
    return px.withColumns({f"sma_{n}": rolling(value, n, "mean", w) for n in windows})


def bollinger(px: DataFrame, n: int = 20, k: float = 2.0, key="ticker", ts="dt", value="close") -> DataFrame:
    w = by_day(key, ts)
    mid, sd = rolling(value, n, "mean", w), rolling(value, n, "std", w)
    return px.withColumns({"bb_mid": mid, "_sd": sd}).select(
        *px.columns, "bb_mid",
        (F.col("bb_mid") + k * F.col("_sd")).alias("bb_upper"),
        (F.col("bb_mid") - k * F.col("_sd")).alias("bb_lower"),
    )


# --- exponential averages ----------------------------------------------------

def ema(df: DataFrame, specs: dict[str, tuple[str, int]], key="ticker", ts="dt") -> DataFrame:
    """Recursive EMA (``adjust=False``) for ``{out: (value, span)}`` without recursion or UDFs.

    The unrolled recursion is a decayed running sum.  Scaling a whole history by
    decay**-i overflows a double, so the history is cut into blocks long enough
    that decay**block < 1e-20: inside a block a scaled running sum is exact to
    rounding, and only the previous block's closing value has to be carried in.
    Works for any history length.
    """
    w = by_day(key, ts)
    out = df.withColumn("_i", F.row_number().over(w) - 1)
    for name, (value, span) in specs.items():
        if span == 1:  # nothing of the past is left
            out = out.withColumn(name, F.col(value))
            continue
        alpha = 2.0 / (span + 1)
        decay = 1 - alpha
        block = max(2, math.ceil(-20 * math.log(10) / math.log(decay)))
        pos, blk = F.col("_i") % block, F.floor(F.col("_i") / block)
        wb = W.partitionBy(key, "_b").orderBy(ts).rowsBetween(W.unboundedPreceding, 0)
        weight = F.when(F.col("_i") == 0, F.lit(1.0)).otherwise(F.lit(alpha))
        before = w.rowsBetween(W.unboundedPreceding, -1)
        closing = F.when(F.col("_o") == block - 1, F.col("_loc"))
        out = (
            out.withColumns({"_b": blk, "_o": pos})
            .withColumn(
                "_loc",
                F.sum(weight * F.col(value) * F.pow(F.lit(decay), -F.col("_o"))).over(wb)
                * F.pow(F.lit(decay), F.col("_o")),
            )
            .withColumn("_carry", F.coalesce(F.last(closing, ignorenulls=True).over(before), F.lit(0.0)))
            .withColumn(name, F.col("_loc") + F.pow(F.lit(decay), F.col("_o") + 1) * F.col("_carry"))
        )
    return out.drop("_i", "_b", "_o", "_loc", "_carry")


def macd(px: DataFrame, fast=12, slow=26, signal=9, key="ticker", ts="dt", value="close") -> DataFrame:
    lines = ema(px, {f"ema_{fast}": (value, fast), f"ema_{slow}": (value, slow)}, key, ts)
    lines = lines.withColumn("macd", F.col(f"ema_{fast}") - F.col(f"ema_{slow}"))
    return ema(lines, {"macd_signal": ("macd", signal)}, key, ts).withColumn(
        "macd_hist", F.col("macd") - F.col("macd_signal")
    )


# --- risk of a price series --------------------------------------------------

def annual_volatility(ret: DataFrame, key="ticker", out="volatility") -> DataFrame:
    return ret.groupBy(key).agg((F.stddev_samp("ret") * math.sqrt(TRADING_DAYS)).alias(out))


def rolling_volatility(px: DataFrame, n: int = 30, key="ticker", ts="dt") -> DataFrame:
    """Annualised rolling volatility at the last bar; NULL with fewer than n returns."""
    w = by_day(key, ts)
    r = with_returns(px, key=key, ts=ts).withColumn(
        "rolling_vol", rolling("ret", n, "std", w) * math.sqrt(TRADING_DAYS)
    )
    return r.groupBy(key).agg(F.max_by("rolling_vol", ts).alias("rolling_vol"))


def price_risk(px: DataFrame, key="ticker", ts="dt", value="close") -> DataFrame:
    """Volatility, 5th percentile return and maximum drawdown per ticker, one pass over the windows.

    cumprod(1 + r) is the price relative to the first bar, so the drawdown needs
    only a running maximum that starts at the second bar.
    """
    w = by_day(key, ts)
    r = with_returns(px.where(F.col(value).isNotNull()), value=value, key=key, ts=ts)
    peak = F.max(value).over(w.rowsBetween(W.unboundedPreceding, 0))
    return (
        r.withColumn("_dd", div(F.col(value), peak) - 1)
        .groupBy(key)
        .agg(
            (F.stddev_samp("ret") * math.sqrt(TRADING_DAYS)).alias("volatility"),
            F.percentile("ret", F.lit(0.05)).alias("var_95"),  # <= one return per day
            F.min("_dd").alias("max_drawdown"),
            F.count("*").alias("n_returns"),
        )
    )


# --- levels and signals ------------------------------------------------------

def high_low_52w(px: DataFrame, bars: int = 252, key="ticker", ts="dt", value="close") -> DataFrame:
    r = px.withColumn("_r", F.row_number().over(from_end(key, ts))).where(F.col("_r") <= bars)
    return r.groupBy(key).agg(F.max(value).alias("high_52w"), F.min(value).alias("low_52w"))


def price_change(px: DataFrame, key="ticker", ts="dt", value="close") -> DataFrame:
    """Whole-window change (fraction) and last day-over-day change (percent)."""
    r = px.withColumn("_prev", F.lag(value).over(by_day(key, ts)))
    return r.groupBy(key).agg(
        F.max_by(value, ts).alias("latest_price"),
        (div(F.max_by(value, ts), F.min_by(value, ts)) - 1).alias("window_change"),
        ((div(F.max_by(value, ts), F.max_by("_prev", ts)) - 1) * 100).alias("day_change_pct"),
    )


def technical_signals(px: DataFrame, key="ticker", ts="dt") -> DataFrame:
    """RSI, moving-average, volume and trend labels at the last bar of each ticker."""
    w = by_day(key, ts)
    t = rsi_sma(px, key=key, ts=ts).withColumns(
        {
            "sma_20": rolling("close", 20, "mean", w),
            "sma_50": rolling("close", 50, "mean", w),
            "avg_volume": rolling("volume", 20, "mean", w),
            "trend": lagged_return("close", 19, w),
        }
    )
    last = latest(t, key, ts)
    p, a, b = F.col("close"), F.col("sma_20"), F.col("sma_50")
    return last.select(
        key, "rsi", "sma_20", "sma_50", "avg_volume", "trend",
        F.when(F.col("rsi").isNotNull(), rsi_label(F.col("rsi"))).alias("rsi_signal"),
        F.when(b.isNotNull(), F.when((p > a) & (a > b), "Bullish").when((p < a) & (a < b), "Bearish").otherwise("Mixed")).alias("ma_signal"),
        F.when(F.col("volume") > 1.5 * F.col("avg_volume"), "High Volume").otherwise("Normal").alias("volume_signal"),
        F.when(F.col("trend").isNotNull(), F.when(F.col("trend") > 0.05, "Uptrend").when(F.col("trend") < -0.05, "Downtrend").otherwise("Sideways")).alias("trend_signal"),
    )


def rsi_label(rsi: Column) -> Column:
    return F.when(rsi > 70, "Overbought").when(rsi < 30, "Oversold").otherwise("Neutral")


def trend_direction(current: Column | str, previous: Column | str, threshold: float = 0.01) -> Column:
    """up / down / flat for a relative change beyond the threshold; no or zero base is flat."""
    change = div(col(current) - col(previous), F.abs(col(previous)), 0.0)
    return F.when(change > threshold, "up").when(change < -threshold, "down").otherwise("flat")


def benchmark_status(current: Column | str, reference: Column | str, higher_better: bool = True) -> Column:
    """good beyond +10 %, bad at -10 % or worse, else neutral (mirrored when lower is better)."""
    gap = div(col(current) - col(reference), F.abs(col(reference)))
    gap = gap if higher_better else -gap
    return F.when(gap > 0.1, "good").when(gap <= -0.1, "bad").otherwise("neutral")


# --- period series -----------------------------------------------------------

def with_yoy(df: DataFrame, items: list[str], key="ticker", ts="period_end", suffix="_yoy") -> DataFrame:
    """Period-over-period change of each item (x / previous - 1)."""
    w = by_day(key, ts)
    return df.withColumns({f"{c}{suffix}": div(F.col(c), F.lag(c).over(w)) - 1 for c in items})


def yoy_summary(df: DataFrame, item: str, key="ticker", ts="period_end") -> DataFrame:
    y = with_yoy(df, [item], key, ts)
    return y.groupBy(key).agg(
        F.avg(f"{item}_yoy").alias("avg_yoy"), F.stddev_samp(f"{item}_yoy").alias("std_yoy"),
        F.count(f"{item}_yoy").alias("n_yoy"),
    )
