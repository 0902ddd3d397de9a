"""Scans with the defaults, gates and fallbacks of the domain."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.numeric import snap

# Defaults of the strict fundamentals snapshot.
FUNDAMENTAL_DEFAULTS = {
    "market_cap": 0.0, "pe_ratio": 0.0, "price_to_book": 0.0, "dividend_yield": 0.0, "beta": 0.0,
    "sector": "Unknown", "industry": "Unknown",
}
PRICE_SCHEMA = "ticker string, dt date, open double, high double, low double, close double, volume bigint"
CHAIN_SCHEMA = (
    "ticker string, side string, expiry date, strike double, last_price double, iv double, delta double, "
    "ask double, bid double, volume bigint, open_interest bigint"
)


def read_table(spark: SparkSession, path: str, schema: str | None = None, fmt: str = "parquet", **options) -> DataFrame:
    """A file scan with an explicit schema where one is known (no inference pass)."""
    r = spark.read.format(fmt).options(**options)
    return (r.schema(schema) if schema else r).load(path)


def period_start(period: str, as_of: dt.date) -> Column | None:
    """First excluded day of a look-back such as 5d, 6mo, 1y; NULL-safe None for 'max'."""
    if period == "max":
        return None
    m = re.fullmatch(r"(\d+)(d|mo|y)", period)
    if not m:
        raise ValueError(f"unknown period {period!r}")
    n, unit = int(m.group(1)), m.group(2)
    base = F.lit(as_of)
    return F.date_sub(base, n) if unit == "d" else F.add_months(base, -(n if unit == "mo" else 12 * n))


def price_history(px: DataFrame, as_of: dt.date, period: str = "1y", tickers: list[str] | None = None, ts: str = "dt") -> DataFrame:
    """Bars of a look-back window; plain predicates, so they reach the scan of a stored table."""
    out = px.where(F.col(ts) <= F.lit(as_of))
    start = period_start(period, as_of)
    if start is not None:
        out = out.where(F.col(ts) > start)
    return out if tickers is None else out.where(F.col("ticker").isin(tickers))


def fundamentals_with_defaults(df: DataFrame, defaults: dict | None = None) -> DataFrame:
    use = {k: v for k, v in (defaults or FUNDAMENTAL_DEFAULTS).items() if k in df.columns}
    return df.fillna(use)


def statement(df: DataFrame, items: list[str], digits: int = 2, keys=("ticker", "period_end")) -> DataFrame:
    """Statement items with missing as zero, rounded half up."""
    return df.select(*keys, *[snap(F.coalesce(F.col(i).cast("double"), F.lit(0.0)), digits).alias(i) for i in items])


def first_available(base: DataFrame, sources: dict[str, DataFrame], columns: list[str], key: str = "ticker") -> DataFrame:
    """Ordered fallback: each key takes all columns from the first source that has a row for it.

    ``source_used`` names it; keys no source knows are kept as unavailable.
    """
    out = base.select(key)
    for name, df in sources.items():
        packed = df.select(key, F.struct(*columns).alias(f"_s_{name}"))
        out = out.join(packed, key, "left")
    pick = F.coalesce(*[F.col(f"_s_{n}") for n in sources])
    used = F.coalesce(*[F.when(F.col(f"_s_{n}").isNotNull(), F.lit(n)) for n in sources], F.lit("none"))
    return out.select(
        key, *[pick[c].alias(c) for c in columns], used.alias("source_used"), pick.isNotNull().alias("available"),
        F.when(pick.isNull(), F.lit("all sources failed")).alias("error"),
    )


def current_price(current: Column, market: Column, previous: Column, last_close: Column) -> Column:
    """First known of the four quotes; NULL unless positive."""
    p = F.coalesce(current, market, previous, last_close)
    return F.when(p > 0, p)


def latest_bundle(metrics: DataFrame, fundamentals: DataFrame, ratios: DataFrame, key: str = "ticker") -> DataFrame:
    """One row per ticker: price metrics, fundamentals and statement ratios."""
    return metrics.join(fundamentals, key, "left").join(ratios, key, "left")


def market_bundle(chain: DataFrame, px: DataFrame, index: DataFrame, spot: DataFrame) -> DataFrame:
    """Per ticker: spot, number of contracts, bars and index days in common."""
    # the index has one row per calendar day
    known = F.broadcast(index.select("dt", F.lit(True).alias("_known")))
    bars = px.join(known, "dt", "left").groupBy("ticker").agg(
        F.count("*").alias("n_bars"), F.count("_known").alias("n_common")
    )
    n = chain.groupBy("ticker").agg(F.count("*").alias("n_contracts"))
    return spot.join(n, "ticker", "left").join(bars, "ticker", "left")
