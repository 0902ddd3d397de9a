"""The four strategies for every ticker and risk level at once.

Contracts are paired with the risk levels whose band they fall in (a literal
three-row table, filtered in the same stage), scored in one projection and cut
to the top k per (ticker, risk).  ``row_number() <= k`` lets Spark keep only k
rows per group on the map side, so a hot ticker never reaches one task whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.config import options as cfg
from quantloom.functions.numeric import clamp, div, steady
from quantloom.operators import chain as ch
from quantloom.operators import scoring as sc

GROUP = ["ticker", "risk"]


def at_risk_levels(df: DataFrame, bands: dict[str, dict], risks=cfg.RISK_LEVELS) -> DataFrame:
    """One copy of each row per risk level, with the level's band as columns."""
    rows = [
        F.struct(F.lit(r).alias("risk"), *[F.lit(float(v)).alias(k) for k, v in bands[r].items()]) for r in risks
    ]
    return df.withColumn("_band", F.explode(F.array(*rows))).select(*df.columns, "_band.*")


def per_risk(values: dict[str, int], risk: Column) -> Column:
    out = F.lit(None).cast("int")
    for r, v in values.items():
        out = F.when(risk == r, F.lit(v)).otherwise(out)
    return out


def top_k(df: DataFrame, orders: dict[str, list[Column]], limits: dict[str, int], tie: list[Column]) -> DataFrame:
    """Best rows per (ticker, risk) with their rank; each risk level has its own order and limit.

    ``orders`` lists numeric sort keys, smallest first, the composite score ahead
    of everything; keys are compared to nine decimals so that summation order
    cannot reorder ties.  One window serves all levels: keys are picked by CASE, and the
    literal bound lets the planner prune each group before the shuffle.
    """
    depth = max(len(o) for o in orders.values())
    keys = []
    for i in range(depth):
        key = F.lit(0.0)
        for risk, order in orders.items():
            if i < len(order):
                key = F.when(F.col("risk") == risk, order[i].cast("double")).otherwise(key)
        keys.append(steady(key))
    w = W.partitionBy(*GROUP).orderBy(*keys, *tie)
    return (
        df.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= max(limits.values()))
        .where(F.col("rank") <= per_risk(limits, F.col("risk")))
    )


def by_level(conservative: list, moderate: list, aggressive: list) -> dict[str, list]:
    return dict(zip(cfg.RISK_LEVELS, (conservative, moderate, aggressive)))


def limits(conservative: int, moderate: int, aggressive: int) -> dict[str, int]:
    return dict(zip(cfg.RISK_LEVELS, (conservative, moderate, aggressive)))


def n_of(top_n: int | dict[str, int], risk: str) -> int:
    return top_n[risk] if isinstance(top_n, dict) else top_n


def days_of(min_days: int | dict[str, int]) -> tuple[int, dict[str, int]]:
    """Lowest bound (pushed into the scan) and the bound per risk level."""
    table = min_days if isinstance(min_days, dict) else {r: min_days for r in cfg.RISK_LEVELS}
    return min(table.values()), table


def long_call_filter(chain: DataFrame, min_days=180, risks=cfg.RISK_LEVELS) -> DataFrame:
    """Moneyness band and minimum days per risk level; Conservative also drops the dearest 5 % by IV."""
    lowest, table = days_of(min_days)
    c = at_risk_levels(ch.contracts(chain, "C", lowest), cfg.LONG_CALL_BANDS, risks)
    m = F.col("strike") / F.col("spot")
    c = c.where((m >= F.col("lo")) & (m <= F.col("hi")) & (F.col("dte") >= per_risk(table, F.col("risk"))))
    cut = F.percentile(F.when(F.col("risk") == "Conservative", F.col("iv")), F.lit(0.95)).over(W.partitionBy(*GROUP))
    return (
        c.withColumn("iv_cut", cut)  # one listing's band: bounded by its strike grid
        .where((F.col("risk") != "Conservative") | (F.col("iv") <= F.col("iv_cut")))
        .where(F.col("dte") >= F.col("floor_days"))
        .drop("lo", "hi", "floor_days", "iv_cut")
    )


def long_calls(chain: DataFrame, indicators: DataFrame, signals: DataFrame, min_days=180, top_n=5,
               weights=None, risks=cfg.RISK_LEVELS) -> DataFrame:
    scored = score_long_calls(long_call_filter(chain, min_days, risks), indicators, signals, weights)
    tie = [F.col("expiry"), F.col("strike")]
    s = -F.col("final_score")
    return top_k(
        scored,
        by_level([s, F.col("iv"), -F.col("dte")], [s, F.col("dte")], [s]),
        limits(
            max(3, min(n_of(top_n, "Conservative"), 5)), n_of(top_n, "Moderate"), min(n_of(top_n, "Aggressive") * 2, 15)
        ),
        tie,
    )


def score_long_calls(c: DataFrame, indicators: DataFrame, signals: DataFrame, weights=None) -> DataFrame:
    """Scores against the mean IV of the contracts that passed the filter."""
    c = c.withColumn("avg_iv", ch.mean_iv_over(W.partitionBy(*GROUP)))
    sig = signals.select("ticker", F.col("score").alias("ecosystem_score"), "signal", "confidence")
    m = F.create_map(*[x for k, v in cfg.SIGNAL_MULTIPLIER.items() for x in (F.lit(k), F.lit(v))])
    scored = scored_by(
        with_indicators(c, indicators), sc.long_call_score(weights), lambda b: sc.long_call_overlay(b, F.col("risk")), weights
    )
    return (
        scored.join(sig, "ticker", "left")
        .fillna({"ecosystem_score": 0.5, "signal": "neutral", "confidence": 0.5})
        .withColumn("final_score", F.col("composite_score") * F.element_at(m, F.col("signal")))
    )


def scored_by(x: DataFrame, base: Column, overlay, weights=None) -> DataFrame:
    """Base score, then the risk overlay on it as a column of its own, plus the weights used.

    Two steps keep the expression trees small: the overlay mentions the base
    score several times.
    """
    return (
        x.withColumn("_base", base)
        .withColumns({"composite_score": overlay(F.col("_base")), "score_details": sc.details(weights)})
        .drop("_base")
    )


def with_indicators(contracts: DataFrame, indicators: DataFrame) -> DataFrame:
    """Attach the one-row-per-ticker indicators; tickers without an indicator row are rejected."""
    return contracts.join(indicators, "ticker").withColumns(
        {"has_iv": F.col("avg_iv").isNotNull(), "avg_iv": F.coalesce("avg_iv", F.lit(sc.FALLBACK["iv"]))}
    )


def with_call_iv(chain: DataFrame, table: dict[str, int]) -> DataFrame:
    """Mean IV of a ticker's calls that are long enough, one column per distinct minimum.

    A window over the listing rather than an aggregate joined back: the chain is
    computed once, and the later top-k finds its rows already with their ticker.
    """
    w = W.partitionBy("ticker")
    return chain.withColumns(
        {f"_iv_{d}": ch.mean_iv_over(w, (F.col("side") == "C") & (F.col("dte") >= d)) for d in set(table.values())}
    )


def pick_call_iv(df: DataFrame, table: dict[str, int]) -> DataFrame:
    """The mean IV that belongs to each row's risk level."""
    out = F.lit(None).cast("double")
    for r, d in table.items():
        out = F.when(F.col("risk") == r, F.col(f"_iv_{d}")).otherwise(out)
    return df.withColumn("avg_iv", out).drop(*{f"_iv_{d}" for d in table.values()})


def spread_pairs(calls: DataFrame, reach: int = 7) -> DataFrame:
    """Each contract with the next ``reach`` strikes of its expiry: one sort, no join."""
    w = W.partitionBy("ticker", "expiry").orderBy("strike")
    leg = F.struct("strike", "last_price", "iv")
    kept = [c for c in calls.columns if c.startswith("_iv_")]
    nxt = F.array_compact(F.array(*[F.lead(leg, i).over(w) for i in range(1, reach + 1)]))
    return (
        calls.withColumn("_next", nxt)
        .withColumn("_short", F.explode("_next"))
        .select(
            "ticker", "expiry", "dte", "spot",
            F.col("strike").alias("long_strike"), F.col("_short.strike").alias("short_strike"),
            F.col("last_price").alias("long_price"), F.col("_short.last_price").alias("short_price"),
            F.col("iv").alias("long_iv"), F.col("_short.iv").alias("short_iv"), *kept,
        )
    )


def spread_candidates(chain: DataFrame, min_days=180, risks=cfg.RISK_LEVELS) -> DataFrame:
    lowest, table = days_of(min_days)
    net = F.col("long_price") - F.col("short_price")
    calls = with_call_iv(ch.contracts(chain, "C", lowest), table)
    p = spread_pairs(calls).withColumns(
        {"spread_width": F.col("short_strike") - F.col("long_strike"), "net_premium": net}
    )
    p = p.withColumns(
        {
            "max_profit": F.col("spread_width") - F.col("net_premium"),
            "max_loss": F.col("net_premium"),
            "break_even": F.col("long_strike") + F.col("net_premium"),
        }
    ).where((F.col("net_premium") > 0) & (F.col("max_profit") > 0))
    p = p.withColumns(
        {"profit_ratio": F.col("max_profit") / F.col("net_premium"), "iv": (F.col("long_iv") + F.col("short_iv")) / 2}
    )
    out = (
        at_risk_levels(p, cfg.SPREAD_BANDS, risks)
        .where(
            (F.col("spread_width") <= F.col("spot") * F.col("max_width"))
            & (F.col("profit_ratio") >= F.col("min_ratio"))
            & (F.col("dte") >= per_risk(table, F.col("risk")))
        )
        .drop("max_width", "min_ratio")
    )
    return pick_call_iv(out, table)


def bull_call_spread(chain: DataFrame, indicators: DataFrame, min_days=180, top_n=5, weights=None,
                     corrected: bool = False, risks=cfg.RISK_LEVELS) -> DataFrame:
    means = W.partitionBy(*GROUP)
    x = spread_candidates(chain, min_days, risks).withColumns(
        {"mean_width": F.avg("spread_width").over(means), "mean_profit": F.avg("max_profit").over(means)}
    )
    x = scored_by(
        with_indicators(x, indicators), sc.spread_score(weights, corrected),
        lambda b: sc.spread_overlay(b, F.col("risk"), F.col("mean_width"), F.col("mean_profit")), weights,
    )
    s, pr = -F.col("composite_score"), -F.col("profit_ratio")
    return top_k(
        x,
        by_level([s, pr, -F.col("dte")], [s, pr], [s, -F.col("max_profit"), pr]),
        limits(min(n_of(top_n, "Conservative"), 5), n_of(top_n, "Moderate"), min(n_of(top_n, "Aggressive") * 2, 10)),
        [F.col("expiry"), F.col("long_strike"), F.col("short_strike")],
    )


def covered_call(chain: DataFrame, indicators: DataFrame, min_days=30, top_n=5, weights=None,
                 risks=cfg.RISK_LEVELS) -> DataFrame:
    lowest, table = days_of(min_days)
    calls = with_call_iv(ch.contracts(chain, "C", lowest), table)
    k, s0 = F.col("strike"), F.col("spot")
    c = at_risk_levels(calls, cfg.COVERED_CALL_BANDS, risks).where(
        (k >= s0 * (1 + F.col("lo"))) & (k <= s0 * (1 + F.col("hi"))) & (F.col("dte") >= per_risk(table, F.col("risk")))
    )
    c = c.withColumns(
        {
            "premium_yield": F.col("last_price") / s0 * 100,
            "upside_capture": (k - s0) / s0 * 100,
            "assignment_probability": clamp((s0 - k) / s0 + 0.5),
        }
    ).withColumns(
        {
            "annualized_yield": div(F.col("premium_yield") * 365, F.col("dte").cast("double")),
            "total_return": F.col("premium_yield") + F.col("upside_capture"),
        }
    )
    c = c.where(F.col("premium_yield") >= F.col("min_yield") * 100).drop("lo", "hi", "min_yield")
    x = scored_by(
        with_indicators(pick_call_iv(c, table), indicators), sc.covered_call_score(weights),
        lambda b: sc.covered_call_overlay(b, F.col("risk")), weights,
    )
    s, ann = -F.col("composite_score"), -F.col("annualized_yield")
    return top_k(
        x,
        by_level([s, F.col("assignment_probability"), ann], [s, ann], [s, ann, -F.col("total_return")]),
        limits(min(n_of(top_n, "Conservative"), 5), n_of(top_n, "Moderate"), min(n_of(top_n, "Aggressive") * 2, 8)),
        [F.col("expiry"), F.col("strike")],
    )


def cash_secured_put(chain: DataFrame, indicators: DataFrame, min_days=30, top_n=5, weights=None,
                     risks=cfg.RISK_LEVELS) -> DataFrame:
    """The IV yardstick is the mean IV of the calls, as for the other strategies."""
    lowest, table = days_of(min_days)
    k, s0 = F.col("strike"), F.col("spot")
    puts = with_call_iv(chain.where(F.col("dte") >= lowest), table).where(F.col("side") == "P")
    p = at_risk_levels(puts, cfg.CASH_PUT_BANDS, risks).where(
        (k <= s0 * (1 - F.col("lo"))) & (k >= s0 * (1 - F.col("hi"))) & (F.col("dte") >= per_risk(table, F.col("risk")))
    )
    p = p.withColumns(
        {
            "premium_yield": div(F.col("last_price"), k) * 100,
            "assignment_discount": (s0 - k) / s0 * 100,
            "effective_cost": k - F.col("last_price"),
            "assignment_probability": clamp((k - s0) / s0 + 0.5),
        }
    ).withColumns(
        {
            "annualized_yield": div(F.col("premium_yield") * 365, F.col("dte").cast("double")),
            "discount_to_current": (s0 - F.col("effective_cost")) / s0 * 100,
        }
    )
    p = p.where(F.col("premium_yield") >= F.col("min_yield") * 100).drop("lo", "hi", "min_yield")
    x = scored_by(
        with_indicators(pick_call_iv(p, table), indicators), sc.cash_put_score(weights),
        lambda b: sc.cash_put_overlay(b, F.col("risk")), weights,
    )
    s, ann, ap = -F.col("composite_score"), -F.col("annualized_yield"), F.col("assignment_probability")
    return top_k(
        x,
        by_level([s, ap, -F.col("discount_to_current")], [s, ann], [s, ann, -ap]),
        limits(min(n_of(top_n, "Conservative"), 5), n_of(top_n, "Moderate"), min(n_of(top_n, "Aggressive") * 2, 8)),
        [F.col("expiry"), F.col("strike")],
    )


def request_limits(strategy: str, min_days: int, top_n: int, compat: bool = True) -> tuple[dict, dict]:
    """(min_days, top_n) per risk level after the dispatcher's adjustments.

    Income strategies never look beyond 90 days, Conservative asks for at least
    60.  With ``compat`` Aggressive doubles top_n here and again in the strategy.
    """
    if strategy not in cfg.STRATEGIES:
        raise ValueError(f"unsupported strategy {strategy!r}; choose from {cfg.STRATEGIES}")
    if min_days < 0 or top_n < 1:
        raise ValueError("min_days must be >= 0 and top_n >= 1")
    if strategy in ("Covered Call", "Cash-Secured Put"):
        min_days = min(min_days, 90)
    days = {r: min_days for r in cfg.RISK_LEVELS}
    days["Conservative"] = max(min_days, 60)
    n = {r: top_n for r in cfg.RISK_LEVELS}
    if compat:
        n["Aggressive"] = min(top_n * 2, 10)
    return days, n


def analyze(strategy: str, chain: DataFrame, indicators: DataFrame, signals: DataFrame | None = None, *,
            min_days: int = 180, top_n: int = 5, time_horizon: str = "Medium-term (3-6 months)",
            analysis_date: str | None = None, weights=None, strategy_weighted: bool = False,
            compat: bool = True, risks=cfg.RISK_LEVELS) -> DataFrame:
    """Dispatch one strategy and add the request's metadata columns."""
    days, n = request_limits(strategy, min_days, top_n, compat)
    if strategy_weighted and weights is None:
        weights = cfg.strategy_weights(strategy)
    common = dict(min_days=days, top_n=n, weights=weights, risks=risks)
    if strategy == "Long Calls":
        if signals is None:
            raise ValueError("Long Calls needs the peer signals")
        out = long_calls(chain, indicators, signals, **common)
    elif strategy == "Bull Call Spread":
        out = bull_call_spread(chain, indicators, **common)
    elif strategy == "Covered Call":
        out = covered_call(chain, indicators, **common)
    else:
        out = cash_secured_put(chain, indicators, **common)
    return out.withColumns(
        {
            "strategy_type": F.lit(strategy),
            "risk_tolerance": F.col("risk"),
            "time_horizon": F.lit(time_horizon),
            "analysis_date": F.lit(analysis_date),
        }
    )
