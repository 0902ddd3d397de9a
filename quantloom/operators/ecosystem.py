"""Peer-group metrics, the correlation score and the resulting signal."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.numeric import clamp, div
from quantloom.operators import series as s


def ticker_metrics(px: DataFrame, key="ticker", ts="dt", value="close") -> DataFrame:
    """RSI, trailing returns and rolling volatility of every ticker at its last bar.

    One windowed pass; RSI is the neutral 50 on a short or flat series, the
    other metrics are NULL when the series is too short.
    """
    w = s.by_day(key, ts)
    t = s.rsi_sma(px, key=key, ts=ts, value=value).withColumns(
        {
            "ret": s.lagged_return(value, 1, w),
            "ret_5": s.lagged_return(value, 5, w),
            "ret_30": s.lagged_return(value, 30, w),
            "_bars": F.row_number().over(w),
        }
    )
    t = t.withColumn("rolling_vol", s.rolling("ret", 30, "std", w) * math.sqrt(s.TRADING_DAYS))
    last = s.latest(t, key, ts)
    return last.where("_bars >= 2").select(
        key, F.coalesce("rsi", F.lit(50.0)).alias("rsi"), F.col("ret").alias("ret_1"), "ret_5", "ret_30", "rolling_vol"
    )


def momentum_label(ret_5: Column) -> Column:
    return (
        F.when(ret_5 > 0.02, "strong_bullish").when(ret_5 > 0.005, "bullish")
        .when(ret_5 < -0.02, "strong_bearish").when(ret_5 < -0.005, "bearish").otherwise("neutral")
    )


def peer_metrics(metrics: DataFrame, edges: DataFrame, tickers: DataFrame) -> DataFrame:
    """Average peer metrics per ticker; neutral defaults for a ticker without usable peers."""
    joined = edges.join(metrics.withColumnRenamed("ticker", "peer"), "peer")
    avg = joined.groupBy("ticker").agg(
        F.count("*").alias("n_used"), *[F.avg(c).alias(c) for c in ("rsi", "ret_1", "ret_5", "ret_30", "rolling_vol")]
    )
    neutral = {"rsi": 50.0, "ret_1": 0.0, "ret_5": 0.0, "ret_30": 0.0, "rolling_vol": 0.2}
    out = tickers.join(avg, "ticker", "left").select(
        "ticker",
        F.coalesce("n_used", F.lit(0)).cast("bigint").alias("n_used"),
        *[F.coalesce(c, F.lit(d)).alias(f"avg_{c}") for c, d in neutral.items()],
    )
    v = F.col("avg_rolling_vol")
    return out.withColumns(
        {
            "volatility_regime": F.when(v < 0.15, "low").when(v > 0.35, "high").otherwise("normal"),
            "sector_momentum": 0.5 * F.col("avg_ret_5") + 0.3 * F.col("avg_ret_30") + 0.2 * F.col("avg_ret_1"),
            "momentum_signal": momentum_label(F.col("avg_ret_5")),
        }
    )


def ecosystem_score(correlations: DataFrame, min_sample: int = 30, by_significance: bool = True) -> DataFrame:
    """Weighted mean absolute correlation with the peers, and how much to trust it."""
    sig = F.when(F.col("significant"), 1.5).otherwise(0.5) if by_significance else F.lit(1.0)
    size = F.when(F.col("n") >= min_sample, 1.0).otherwise(F.greatest(F.lit(0.1), F.col("n") / float(min_sample)))
    agg = correlations.withColumn("_w", sig * size).groupBy("ticker").agg(
        F.count("*").alias("n_peers"),
        F.coalesce(div(F.sum(F.abs("r") * F.col("_w")), F.sum("_w")), F.avg(F.abs("r"))).alias("avg_correlation"),
        F.avg("n").alias("avg_n"),
        F.avg(F.col("significant").cast("double")).alias("sig_ratio"),
    )
    return agg.select(
        "ticker", "n_peers", "avg_correlation",
        clamp(F.col("avg_correlation")).alias("score"),
        (
            0.4 * F.least(F.col("n_peers") / 5.0, F.lit(1.0))
            + 0.3 * F.least(F.col("avg_n") / 100.0, F.lit(1.0))
            + 0.3 * F.col("sig_ratio")
        ).alias("score_confidence"),
        F.floor("avg_n").cast("bigint").alias("sample_size"),
    )


def correlation_map(correlations: DataFrame) -> DataFrame:
    """ticker -> MAP(peer, r); the edge table bounds the list."""
    return correlations.groupBy("ticker").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("peer", "r")))).alias("individual_correlations")
    )


def signal(score: DataFrame, metrics: DataFrame) -> DataFrame:
    """confirm / neutral / veto from correlation strength, peer momentum and peer RSI."""
    m, rsi = F.col("momentum_signal"), F.col("avg_rsi")
    boost = (
        F.when(m == "strong_bullish", 0.3).when(m == "bullish", 0.15)
        .when(m == "strong_bearish", -0.3).when(m == "bearish", -0.15).otherwise(0.0)
    )
    adjust = F.when(rsi > 70, -0.1).when(rsi < 30, 0.1).otherwise(0.0)
    calm = F.when(F.col("volatility_regime") == "normal", 0.8).otherwise(0.6)
    strength = clamp(F.col("score") + boost + adjust)
    return (
        score.join(metrics, "ticker")
        .withColumns(
            {
                "signal_strength": strength,
                "confidence": (F.col("score_confidence") + F.least(F.col("n_peers") / 5.0, F.lit(1.0)) + calm) / 3.0,
            }
        )
        .withColumn(
            "signal",
            F.when(F.col("signal_strength") >= 0.7, "confirm")
            .when(F.col("signal_strength") <= 0.3, "veto").otherwise("neutral"),
        )
    )
