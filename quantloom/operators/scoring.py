"""Indicator rows and composite scores.

``indicators`` has one row per ticker: rsi, beta, momentum, forecast (the
defaults filled in) and has_<source> flags.  Contracts carry avg_iv / has_iv.
All scores are single projections; weights of missing sources are
redistributed per row.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.config.options import DEFAULT_WEIGHTS, SOURCES
from quantloom.functions.numeric import clip, div, norm
from quantloom.functions.weights import none_available, renormalize, weight_map, weighted_score
from quantloom.operators import pairs, series

FALLBACK = {"rsi": 50.0, "beta": 1.0, "momentum": 0.0, "iv": 0.2, "forecast": 0.5}


def lookback(px: DataFrame, as_of: dt.date, months: int = 12, ts: str = "dt") -> DataFrame:
    """Bars in (as_of - months, as_of]."""
    return px.where((F.col(ts) > F.add_months(F.lit(as_of), -months)) & (F.col(ts) <= F.lit(as_of)))


def price_indicators(px: DataFrame, min_bars: int = 30) -> DataFrame:
    """RSI, momentum and beta per ticker in one windowed pass over the bars.

    Tickers with fewer than ``min_bars`` bars are rejected.  Everything shares
    the (ticker, dt) sort; the market index is one row per day and is broadcast.
    """
    market = pairs.market_returns(pairs_index(px))
    w, back = series.by_day(), series.from_end()
    decay = 1 - 2.0 / 15
    chg = F.col("close") - F.lag("close").over(w)
    rows = px.where(F.col("close").isNotNull()).select(
        "ticker", "dt", "close",
        (F.col("close") / F.nullif(F.lag("close").over(w), F.lit(0.0)) - 1).alias("ret"),
        chg.alias("chg"),
        (F.row_number().over(back) - 1).alias("k"),
    )
    x = rows.join(F.broadcast(market.withColumnRenamed("ret", "mkt")), "dt", "left")
    wt = F.pow(F.lit(decay), F.col("k"))
    both = F.col("ret").isNotNull() & F.col("mkt").isNotNull()
    agg = x.groupBy("ticker").agg(
        F.count("*").alias("n_bars"),
        F.sum(F.greatest(F.col("chg"), F.lit(0.0)) * wt).alias("g"),
        F.sum(F.greatest(-F.col("chg"), F.lit(0.0)) * wt).alias("l"),
        F.max(F.when(F.col("k") == 0, F.col("close"))).alias("p0"),
        F.max(F.when(F.col("k") == 20, F.col("close"))).alias("p20"),
        F.count_if(both).alias("n_common"),
        F.covar_samp("ret", "mkt").alias("cov"),
        F.var_samp(F.when(F.col("ret").isNotNull(), F.col("mkt"))).alias("var"),
    )
    return agg.where(F.col("n_bars") >= min_bars).select(
        "ticker",
        F.when(F.col("n_bars") >= 15, series.rsi_from(F.col("g"), F.col("l"))).alias("rsi"),
        F.when(F.col("n_common") >= 20, F.col("cov") / F.nullif(F.col("var"), F.lit(0.0))).alias("beta"),
        (F.col("p0") / F.nullif(F.col("p20"), F.lit(0.0)) - 1).alias("momentum"),
    )


def pairs_index(px: DataFrame) -> DataFrame:
    return px.groupBy("dt").agg(F.avg("close").alias("close"))


def indicator_row(price_ind: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Add forecast confidence; keep what is missing as a flag plus a neutral default."""
    j = price_ind.join(forecasts.select("ticker", F.col("confidence").alias("forecast")), "ticker", "left")
    cols = ("rsi", "beta", "momentum", "forecast")
    return j.select(
        "ticker",
        *[F.coalesce(F.col(c), F.lit(FALLBACK[c])).alias(c) for c in cols],
        *[F.col(c).isNotNull().alias(f"has_{c}") for c in cols],
    )


def with_mean_iv(contracts: DataFrame, ivs: DataFrame, keys: list[str], fallback: float = FALLBACK["iv"]) -> DataFrame:
    return contracts.join(ivs, keys, "left").withColumns(
        {"has_iv": F.col("avg_iv").isNotNull(), "avg_iv": F.coalesce("avg_iv", F.lit(fallback))}
    )


def flags() -> dict[str, Column]:
    return {s: F.col(f"has_{s}") for s in SOURCES}


def combine(components: dict[str, Column], weights: dict[str, float] | None = None,
            neutral: float = 0.0) -> Column:
    """Weighted sum over the available sources; ``neutral`` when there is none."""
    return weighted_score(components, weights or DEFAULT_WEIGHTS, flags(), neutral)


def details(weights: dict[str, float] | None = None) -> Column:
    """MAP of the weights actually used."""
    return weight_map(renormalize(weights or DEFAULT_WEIGHTS, flags()), none_available(flags()))


def long_call_score(weights=None) -> Column:
    beta = F.when(F.col("beta") < 0.5, 0.2).when(F.col("beta") > 2.0, 0.3).otherwise(norm(F.col("beta"), 0.5, 1.5))
    return combine(
        {
            "rsi": norm(F.col("rsi"), 0, 100, invert=True),
            "beta": beta,
            "momentum": norm(F.col("momentum"), -0.1, 0.1),
            "forecast": F.col("forecast"),
            "iv": norm(F.col("iv"), F.col("avg_iv") * 0.5, F.col("avg_iv") * 1.5, invert=True),
        },
        weights, neutral=0.5,
    )


def long_call_overlay(score: Column, risk: Column) -> Column:
    dear = F.greatest(F.lit(0.0), div(F.col("iv") - F.col("avg_iv"), F.col("avg_iv"), 0.0) * 0.2)
    patient = F.least(F.lit(0.15), F.col("dte") / 365.0 * 0.1)
    mom = F.when(F.col("momentum") > 0, 1 + F.least(F.lit(0.2), F.col("momentum") * 10)).otherwise(1.0)
    lively = F.when(F.col("beta") > 1, 1 + F.least(F.lit(0.15), (F.col("beta") - 1) * 0.2)).otherwise(1.0)
    return clip(
        F.when(risk == "Conservative", score * (1 - dear) * (1 + patient))
        .when(risk == "Aggressive", score * mom * lively)
        .otherwise(score)
    )


def covered_call_score(weights=None) -> Column:
    base = combine(
        {
            "rsi": F.when(F.col("rsi") < 70, norm(F.col("rsi"), 30, 70)).otherwise(0.3),
            "beta": norm(F.col("beta"), 0.5, 1.2, invert=True),
            "momentum": norm(F.col("momentum"), -0.05, 0.05),
            "forecast": F.least(F.col("forecast"), F.lit(0.7)),
            "iv": norm(F.col("iv"), F.col("avg_iv") * 0.8, F.col("avg_iv") * 1.5),
        },
        weights,
    )
    return clip(base * (1 + F.least(F.col("annualized_yield") / 50.0, F.lit(0.3))))


def covered_call_overlay(score: Column, risk: Column) -> Column:
    ap, ann = F.col("assignment_probability"), F.col("annualized_yield")
    return clip(
        F.when(risk == "Conservative", score * (1 - ap * 0.3) * (1 + F.least(F.lit(0.2), F.col("dte") / 90.0 * 0.1)))
        .when(risk == "Aggressive", score * (1 + F.least(ann / 50.0, F.lit(0.3))) * (1 + ap * 0.1))
        .otherwise(score)
    )


def cash_put_score(weights=None) -> Column:
    base = combine(
        {
            "rsi": norm(F.col("rsi"), 20, 60, invert=True),
            "beta": norm(F.col("beta"), 0.7, 1.3),
            "momentum": norm(F.col("momentum"), -0.1, 0.05, invert=True),
            "forecast": F.col("forecast"),
            "iv": norm(F.col("iv"), F.col("avg_iv") * 0.8, F.col("avg_iv") * 1.5),
        },
        weights,
    )
    boost = F.least(F.col("annualized_yield") / 40.0, F.lit(0.2)) + F.least(F.col("discount_to_current") / 20.0, F.lit(0.2))
    return clip(base * (1 + boost))


def cash_put_overlay(score: Column, risk: Column) -> Column:
    ap, ann = F.col("assignment_probability"), F.col("annualized_yield")
    return clip(
        F.when(risk == "Conservative", score * (1 - ap * 0.25) * (1 + F.least(F.col("discount_to_current") / 20.0, F.lit(0.2))))
        .when(risk == "Aggressive", score * (1 + F.least(ann / 40.0, F.lit(0.3))) * (1 + ap * 0.05))
        .otherwise(score)
    )


def spread_score(weights=None, corrected: bool = False) -> Column:
    """``corrected`` scores the mean leg IV and the break-even distance, which the default form leaves neutral."""
    iv = norm(F.col("iv"), F.col("avg_iv") * 0.7, F.col("avg_iv") * 1.2, invert=True) if corrected else F.lit(0.5)
    base = combine(
        {
            "rsi": norm(F.col("rsi"), 25, 65, invert=True),
            "beta": norm(F.col("beta"), 0.8, 1.5),
            "momentum": norm(F.col("momentum"), -0.05, 0.1),
            "forecast": F.col("forecast"),
            "iv": iv,
        },
        weights,
    )
    pr = F.col("profit_ratio")
    score = base * (1 + F.when(pr > 1, F.least((pr - 1) * 0.25, F.lit(0.3))).otherwise(0.0))
    if corrected:
        be = F.col("break_even")
        score = score * (1 + F.when(be > 0, F.least((F.col("spot") / be - 1) * 0.1, F.lit(0.15))).otherwise(0.0))
    return clip(score)


def spread_overlay(score: Column, risk: Column, mean_width: Column, mean_profit: Column) -> Column:
    pr = clip(F.least((F.col("profit_ratio") - 1) * 0.2, F.lit(0.3)), 0.0, 0.3)
    wide = F.least(F.col("spread_width") / (mean_width * 2) * 0.1, F.lit(0.2))
    rich = clip(F.least(F.col("max_profit") / mean_profit * 0.15, F.lit(0.25)), 0.0, 0.25)
    return clip(
        F.when(risk == "Conservative", score * (1 + pr - wide))
        .when(risk == "Aggressive", score * (1 + rich))
        .otherwise(score)
    )


def modular_score(weights=None) -> Column:
    """The threshold scorer shared by all strategies, with its own per-strategy weights."""
    rsi = F.when(F.col("rsi") <= 30, 1.0).when(F.col("rsi") >= 70, 0.2).otherwise(1.0 - (F.col("rsi") - 30) / 40 * 0.8)
    beta = F.when(F.col("beta").between(0.8, 1.2), 1.0).when(F.col("beta") < 0.8, 0.7).otherwise(
        F.greatest(F.lit(0.3), 1.0 - (F.col("beta") - 1.2) * 0.2)
    )
    mom = F.when(F.col("momentum") > 0.1, 0.8).when(F.col("momentum") > 0, 1.0).when(F.col("momentum") > -0.05, 0.6).otherwise(0.2)
    return clip(
        combine(
            {"rsi": rsi, "beta": beta, "momentum": mom, "forecast": F.col("forecast"),
             "iv": norm(F.col("iv"), F.col("avg_iv") * 0.8, F.col("avg_iv") * 1.5)},
            weights,
        )
    )
