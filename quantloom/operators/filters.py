"""Filters, metadata and summaries on top of recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.functions import formatting as fmt
from quantloom.functions import weights as wt
from quantloom.functions.numeric import ladder, steady


def custom_filters(df: DataFrame, max_delta=None, min_volume=None, max_spread=None, min_open_interest=None) -> DataFrame:
    """Each limit applies only if given and if the columns it needs exist."""
    tests = [
        (max_delta, ("delta",), lambda v: F.col("delta") <= v),
        (min_volume, ("volume",), lambda v: F.col("volume") >= v),
        (max_spread, ("bid", "ask"), lambda v: F.col("ask") - F.col("bid") <= v),
        (min_open_interest, ("open_interest",), lambda v: F.col("open_interest") >= v),
    ]
    for value, needed, test in tests:
        if value is not None and all(c in df.columns for c in needed):
            df = df.where(test(value))
    return df


def filter_text(max_delta=None, min_volume=None, max_spread=None, min_open_interest=None) -> str:
    named = [("Delta≤", max_delta), ("Vol≥", min_volume), ("Spread≤", max_spread), ("OI≥", min_open_interest)]
    return "; ".join(f"{n}{v}" for n, v in named if v is not None) or "None"


def with_metadata(df: DataFrame, custom_weights: bool = False, risk: str = "Conservative",
                  horizon: str = "Medium-term", **limits) -> DataFrame:
    return df.withColumns(
        {
            "custom_weights": F.lit("Yes" if custom_weights else "No"),
            "risk_tolerance": F.lit(risk),
            "time_horizon": F.lit(horizon),
            "filtering_applied": F.lit(filter_text(**limits)),
        }
    )


def partial_data(df: DataFrame, key="ticker", details="score_details", sources: int = 5) -> DataFrame:
    """Does any recommendation of the key rest on fewer than all sources?"""
    return df.groupBy(key).agg(
        F.bool_or(F.size(F.col(details)) < sources).alias("partial"),
        F.min(F.size(F.col(details))).alias("fewest_sources"),
    )


def with_coverage(df: DataFrame, details="score_details") -> DataFrame:
    m = F.col(details)
    return df.withColumns({"coverage_badge": wt.coverage_badge(m), "coverage_class": wt.coverage_class(m)})


# Report columns per strategy as (source, title, format).
REPORTS = {
    "Long Calls": [
        ("strike", "Strike", "currency"), ("expiry", "Expiry", "date"), ("last_price", "Price", "currency"), ("rsi", "RSI", "number"),
        ("iv", "IV", "percent"), ("momentum", "Momentum", "number"), ("forecast", "Forecast", "percent"), ("composite_score", "Composite Score", "number"),
    ],
    "Bull Call Spread": [
        ("long_strike", "Long Strike", "currency"), ("short_strike", "Short Strike", "currency"), ("expiry", "Expiry", "date"),
        ("net_premium", "Net Premium", "currency"), ("max_profit", "Max Profit", "currency"), ("max_loss", "Max Loss", "currency"),
        ("profit_ratio", "Profit Ratio", "number"), ("composite_score", "Composite Score", "number"),
    ],
    "Covered Call": [
        ("strike", "Strike", "currency"), ("expiry", "Expiry", "date"), ("last_price", "Premium", "currency"), ("premium_yield", "Premium Yield %", "number"),
        ("annualized_yield", "Annualized Yield %", "number"), ("upside_capture", "Upside %", "number"), ("total_return", "Total Return %", "number"),
        ("composite_score", "Composite Score", "number"),
    ],
    "Cash-Secured Put": [
        ("strike", "Strike", "currency"), ("expiry", "Expiry", "date"), ("last_price", "Premium", "currency"), ("premium_yield", "Premium Yield %", "number"),
        ("annualized_yield", "Annualized Yield %", "number"), ("assignment_discount", "Discount %", "number"), ("effective_cost", "Effective Cost", "currency"),
        ("composite_score", "Composite Score", "number"),
    ],
}
FORMATS = {"currency": fmt.currency, "number": fmt.number, "percent": fmt.percent, "date": lambda c: F.date_format(c, "yyyy-MM-dd")}


def strategy_report(df: DataFrame, strategy: str, keep=("ticker", "risk", "rank")) -> DataFrame:
    """The strategy's report columns, renamed and formatted."""
    kept = [c for c in keep if c in df.columns]
    return df.select(*kept, *[FORMATS[f](c).alias(t) for c, t, f in REPORTS[strategy] if c in df.columns])


def score_distribution(df: DataFrame, keys: list[str], score: str = "composite_score") -> DataFrame:
    """Extremes, mean, deviation, range, quartiles and consistency of a group's recommendations.

    A group is one (ticker, risk) selection, i.e. at most the strategy's top n.
    """
    s = F.stddev_samp(score)
    g = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.max(score).alias("max_score"), F.min(score).alias("min_score"), F.avg(score).alias("mean_score"),
        s.alias("std_score"), F.percentile(score, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"),
    )
    return g.select(
        *keys, "n", "max_score", "min_score", "mean_score", "std_score",
        (F.col("max_score") - F.col("min_score")).alias("score_range"),
        *[F.col("_q")[i].alias(f"q{i + 1}") for i in range(3)],
        F.greatest(F.lit(0.0), 1 - F.col("std_score") / F.nullif(F.col("mean_score"), F.lit(0.0))).alias("consistency"),
        F.when(F.col("std_score") < 0.5, "High").when(F.col("std_score") < 1.0, "Medium").otherwise("Low").alias("consistency_class"),
    )


def top_and_bottom(df: DataFrame, keys: list[str], tie: list[str], k: int = 3, score: str = "composite_score") -> DataFrame:
    """The k best and the k worst rows of each group, two pruned rankings."""
    best = W.partitionBy(*keys).orderBy(steady(-F.col(score)), *tie)
    worst = W.partitionBy(*keys).orderBy(steady(F.col(score)), *tie)
    out = [
        df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).withColumn("end", F.lit(end))
        for end, w in (("top", best), ("bottom", worst))
    ]
    return out[0].unionByName(out[1])


def score_rank(df: DataFrame, keys: list[str], score: str = "composite_score") -> DataFrame:
    """1 + the number of strictly better scores in the group."""
    return df.withColumn("score_rank", F.rank().over(W.partitionBy(*keys).orderBy(steady(-F.col(score)))))


# Averaged column -> bands per strategy.
INSIGHTS = {
    "Bull Call Spread": {"profit_ratio": [(2.0, "Excellent"), (1.0, "Good")]},
    "Covered Call": {"annualized_yield": [(20.0, "High"), (10.0, "Good")], "upside_capture": [(10.0, "Additional upside")]},
    "Cash-Secured Put": {"annualized_yield": [(15.0, "High"), (8.0, "Good")], "discount_to_current": [(15.0, "Excellent"), (8.0, "Good")]},
}


def insights(df: DataFrame, strategy: str, keys: list[str]) -> DataFrame:
    """Average of each insight column with its band."""
    table = INSIGHTS[strategy]
    g = df.groupBy(*keys).agg(*[F.avg(c).alias(f"avg_{c}") for c in table])
    return g.withColumns({f"{c}_band": ladder(F.col(f"avg_{c}"), bands, "Modest", ">") for c, bands in table.items()})


def run_summary(df: DataFrame, score: str = "composite_score") -> DataFrame:
    """Row count, mean and best score."""
    return df.agg(F.count("*").alias("n_rows"), F.avg(score).alias("mean_score"), F.max(score).alias("max_score"))


def first_column(df: DataFrame, names: list[str], default=0.0) -> Column:
    """The first of several columns that exists, else a constant."""
    for n in names:
        if n in df.columns:
            return F.col(n)
    return F.lit(default)


def nested(value: Column, path: list[str], default=0.0) -> Column:
    """What nested maps hold under a path of keys, else a constant."""
    for key in path:
        value = F.try_element_at(value, F.lit(key))
    return F.coalesce(value, F.lit(default))


def keyword_search(df: DataFrame, columns: list[str], words: list[str]) -> DataFrame:
    """Rows with any of the words, case-insensitively, in any of the columns (whole texts)."""
    hit = F.lit(False)
    for c in columns:
        text = F.lower(F.coalesce(F.col(c), F.lit("")))
        for w in words:
            hit = hit | text.contains(w.lower())
    return df.where(hit)


def flatten_maps(df: DataFrame, key: str, categories: dict[str, list[str]]) -> DataFrame:
    """(key, category, metric, value) rows from groups of metric columns."""
    cells = [
        F.struct(F.lit(cat).alias("category"), F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
        for cat, ms in categories.items() for m in ms
    ]
    return df.select(key, F.inline(F.array(*cells)))
