"""Domain tables derived from the star-schema inputs.

Each function is a lazy view: prices, benchmark, peers, option_chain, facts,
analyst_targets, rating_mix.  Raw rows are folded by map-side aggregation
before any shuffle, so a key holding a third of the raw rows arrives at the
reducers already as one row per mapper and group.

``prices`` is unique on (ticker, dt) and ``option_chain`` on (ticker, side,
expiry, strike).  A per-ticker window therefore never sees more rows than
there are calendar days (or listed contracts), however skewed the raw table is.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.functions.numeric import snap

AS_OF = dt.date(1998, 6, 1)
PEERS_PER_TICKER = 8


# Stated rather than inferred: a scan then starts without a footer-reading job.
SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
        "l_shipdate timestamp_ntz"
    ),
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def midnight(day: dt.date, days: int = 0) -> Column:
    return F.lit(day + dt.timedelta(days=days)).cast("timestamp_ntz")


def day_expr() -> Column:
    return F.to_date("l_shipdate")


def supplier_ticker() -> Column:
    return F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ticker")


def trade_order() -> Column:
    """(order, line, part) as one sortable number: 14, 2 and 13 digits, which leaves 9 of a decimal's 38 to a day before them.

    A decimal stays exact up to 10^14 orders and 10^13 parts (a bigint overflows near 10^9 orders) and, unlike a struct
    key, leaves min_by/max_by hash-aggregated.
    """
    return F.col("l_orderkey").cast("decimal(14,0)") * F.lit(10**15).cast("decimal(16,0)") + (
        F.col("l_linenumber").cast("bigint") * F.lit(10**13) + F.col("l_partkey").cast("bigint")
    ).cast("decimal(16,0)")


def prices(spark: SparkSession, sf_dir: str, *, start=None, end=None) -> DataFrame:
    """Daily bars of unit price per supplier; optional [start, end] dates reach the parquet scan."""
    li = table(spark, sf_dir, "lineitem")
    if start is not None:
        li = li.where(F.col("l_shipdate") >= midnight(start))
    if end is not None:
        li = li.where(F.col("l_shipdate") < midnight(end, 1))
    trades = li.select(
        "l_suppkey",
        day_expr().alias("dt"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"),
        "l_quantity",
        trade_order().alias("k"),
    )
    bars = trades.groupBy("l_suppkey", "dt").agg(
        F.min_by("px", "k").alias("open"),
        F.max("px").alias("high"),
        F.min("px").alias("low"),
        F.max_by("px", "k").alias("close"),
        F.sum("l_quantity").cast("bigint").alias("volume"),
    )
    # Stating the keys' non-nullness here gives every consumer the same plan below the
    # aggregation, so its exchange is computed once per query instead of once per join.
    return bars.select(
        supplier_ticker(),
        "dt", "open", "high", "low", "close", "volume",
    ).where(F.col("ticker").isNotNull() & F.col("dt").isNotNull())


def benchmark(px: DataFrame) -> DataFrame:
    """Equal-weight market index: at most one row per calendar day."""
    return px.groupBy("dt").agg(F.avg("close").alias("close"))


def peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to eight same-region suppliers by key, self excluded.

    Everyone's peers come from the first nine keys of the region, so only those
    (9 x regions rows) are joined back: a member of the nine sees the other
    eight, anyone else the first eight.  Linear in suppliers, no self join.
    """
    region = table(spark, sf_dir, "supplier").join(
        F.broadcast(table(spark, sf_dir, "nation")),  # fixed dimension, 25 rows
        F.col("s_nationkey") == F.col("n_nationkey"),
    ).select("n_regionkey", "s_suppkey")
    rank = F.row_number().over(W.partitionBy("n_regionkey").orderBy("s_suppkey"))
    head = (
        region.withColumn("r", rank)
        .where(F.col("r") <= PEERS_PER_TICKER + 1)
        .select("n_regionkey", F.col("s_suppkey").alias("p"), "r")
    )
    last = head.where(F.col("r") == PEERS_PER_TICKER + 1).select(
        "n_regionkey", F.col("p").alias("ninth")
    )
    heads = head.join(F.broadcast(last), "n_regionkey", "left")  # one row per region
    return (
        region.join(F.broadcast(heads), "n_regionkey")  # at most 9 rows per region
        .where(
            (F.col("p") != F.col("s_suppkey"))
            & ((F.col("r") <= PEERS_PER_TICKER) | (F.col("s_suppkey") < F.col("ninth")))
        )
        .select(
            F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker"),
            F.concat(F.lit("S"), F.col("p").cast("string")).alias("peer"),
        )
    )


def spot(px: DataFrame, as_of: dt.date = AS_OF) -> DataFrame:
    """Last close on or before ``as_of`` per ticker."""
    return (
        px.where(F.col("dt") <= F.lit(as_of))
        .groupBy("ticker")
        .agg(F.max_by("close", "dt").alias("spot"))
    )


def raw_spot(spark: SparkSession, sf_dir: str, as_of: dt.date = AS_OF) -> DataFrame:
    """``spot(prices)`` straight from the trades: the last trade wins, so one map-side-combined shuffle."""
    li = table(spark, sf_dir, "lineitem").where(
        F.col("l_shipdate") < midnight(as_of, 1)
    )
    day = F.unix_date(day_expr()).cast("decimal(7,0)")
    latest = (day * F.lit(Decimal(10) ** 29)).cast("decimal(38,0)") + trade_order()
    return (
        li.groupBy("l_suppkey")
        .agg(F.max_by(F.col("l_extendedprice") / F.col("l_quantity"), latest).alias("spot"))
        .select(supplier_ticker(), "spot")
    )


def option_chain(spark: SparkSession, sf_dir: str, as_of: dt.date = AS_OF) -> DataFrame:
    """Listed contracts: strike .71-1.30 x spot, month-end expiries, IV .10-.50.

    The spot price comes from the stored bars, so the trades are scanned once.
    """
    from quantloom.sources import bars  # which folds the bars of this module

    li = (
        table(spark, sf_dir, "lineitem")
        .where(F.col("l_shipdate") >= midnight(as_of, 1))
        .select(
            supplier_ticker(),
            F.when(F.col("l_linestatus") == "O", "C").otherwise("P").alias("side"),
            F.last_day(day_expr()).alias("expiry"),
            "l_quantity", "l_tax", "l_discount",
        )
    )
    # Trades of one quantity share strike and moneyness, so they fold on the map side into at most 50 cells for each
    # (ticker, side, expiry); only cells meet the spot price, however many trades a ticker has.
    cells = (
        li.groupBy("ticker", "side", "expiry", "l_quantity")
        .agg(
            F.sum(1 + F.col("l_tax")).alias("with_tax"),
            F.sum("l_discount").alias("discount"),
            F.sum("l_quantity").alias("quantity"),
            F.count("*").alias("trades"),
        )
        .join(spot(bars.daily(spark, sf_dir), as_of), "ticker")
    )
    q, s, trades = F.col("l_quantity"), F.col("spot"), F.sum("trades")
    return (
        cells.withColumn("strike", snap(s * (0.70 + 0.012 * q), 2))
        .groupBy("ticker", "side", "expiry", "strike")
        .agg(
            snap(F.sum(s * (0.02 + 0.25 * (0.62 - 0.012 * q)) * F.col("with_tax")) / trades).alias("last_price"),
            snap(0.10 + 4 * F.sum("discount") / trades).alias("iv"),
            F.sum("quantity").cast("bigint").alias("volume"),
            (trades * 10).cast("bigint").alias("open_interest"),
            F.max("spot").alias("spot"),
        )
        .withColumn("dte", F.datediff("expiry", F.lit(as_of)))
    )


FACT_ITEMS = [
    "total_revenue", "gross_profit", "operating_income", "net_income", "interest_expense",
    "total_assets", "total_current_assets", "total_current_liabilities", "total_liabilities",
    "long_term_debt", "retained_earnings", "operating_cash_flow", "capital_expenditure",
    "shares_outstanding", "total_stockholder_equity", "free_cash_flow",
]


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide statements, one row per (company, calendar year)."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.year("o_orderdate").alias("fy")
    )
    li = table(spark, sf_dir, "lineitem")
    p, d, t, n = (F.col(c) for c in ("l_extendedprice", "l_discount", "l_tax", "l_linenumber"))
    terms = {
        "total_revenue": p * (1 - d),
        "gross_profit": p * (1 - d) * (0.45 + t),
        "operating_income": p * (0.20 - 2 * d),
        "net_income": p * (0.12 - 2 * d),
        "interest_expense": p * 0.01 * n,
        "total_assets": p * 1.8,
        "total_current_assets": p * (0.5 + 0.04 * n),
        "total_current_liabilities": p * (0.3 + 5 * t),
        "total_liabilities": p * (0.8 + 5 * t),
        "long_term_debt": p * (0.3 + 2 * d),
        "retained_earnings": p * 0.2,
        "operating_cash_flow": p * (0.25 - 2 * d),
        "capital_expenditure": -p * t,
    }
    wide = (
        li.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_custkey", "fy")
        .agg(
            *[snap(F.sum(e)).alias(c) for c, e in terms.items()],
            (F.sum("l_quantity").cast("bigint") * 100).alias("shares_outstanding"),
        )
    )
    return wide.select(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("ticker"),
        F.make_date("fy", F.lit(12), F.lit(31)).alias("period_end"),
        *terms,
        "shares_outstanding",
        (F.col("total_assets") - F.col("total_liabilities")).alias("total_stockholder_equity"),
        (F.col("operating_cash_flow") - F.abs("capital_expenditure")).alias("free_cash_flow"),
    )


def analyst_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .where(F.col("event_type") == "purchase")
        .select(
            F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("ticker"),
            F.col("event_id").alias("analyst_id"),
            F.col("value").alias("target"),
            "ts",
        )
        .where(F.col("ticker").isNotNull())
    )


RATING_OF_EVENT = {
    "view": "strong_buy", "click": "buy", "signup": "hold", "purchase": "sell", "error": "strong_sell",
}


def rating_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the five ratings per ticker."""
    ev = table(spark, sf_dir, "events")
    return ev.groupBy(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("ticker")).agg(
        *[
            F.count_if(F.col("event_type") == e).alias(r)
            for e, r in RATING_OF_EVENT.items()
        ]
    )


def snapshot_columns() -> dict[str, Column]:
    """Snapshot fields of a customer row joined with its latest statement, with realistic gaps (NULLs)."""
    k = F.col("c_custkey")
    price = 5 + F.abs("c_acctbal") / 1000
    shares = F.col("shares_outstanding").cast("double")
    eps = F.col("net_income") / F.nullif(shares, F.lit(0.0))
    pe = F.when(eps > 0, price / eps)
    return {
        "latest_price": F.when(k % 11 != 0, price),
        "market_cap": F.when(k % 13 != 0, price * shares),
        "shares_outstanding": F.when(k % 7 != 0, shares),
        "eps": eps,
        "pe_ratio": pe,
        "peg_ratio": pe / (1 + k % 30),
        "price_to_book": price * shares / F.nullif(F.col("total_stockholder_equity"), F.lit(0.0)),
        "beta": F.when(k % 9 != 0, 0.2 + (k % 20) / 10.0),
        "dividend_yield": (k % 40) / 1000.0,
        "sector": F.col("c_mktsegment"),
        "industry": F.when(k % 17 != 0, F.concat_ws(" ", "c_mktsegment", F.col("c_nationkey").cast("string"))),
    }


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").withColumn("ticker", F.concat(F.lit("C"), F.col("c_custkey").cast("string")))


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One snapshot row per company that has statements."""
    last = facts(spark, sf_dir).groupBy("ticker").agg(
        *[F.max_by(c, "period_end").alias(c) for c in ("net_income", "shares_outstanding", "total_stockholder_equity")]
    )
    return customers(spark, sf_dir).join(last, "ticker").select(
        "ticker", *[c.alias(n) for n, c in snapshot_columns().items()]
    )


def with_fundamentals(spark: SparkSession, sf_dir: str, now: DataFrame) -> DataFrame:
    """Snapshot fields attached to one latest-period row per company; the sheet's share count is kept apart."""
    snap = snapshot_columns()
    kept = [F.col(c) for c in now.columns if c != "ticker" and c not in snap]
    return customers(spark, sf_dir).join(now, "ticker").select(
        "ticker", *kept, F.col("shares_outstanding").alias("balance_sheet_shares"), *[c.alias(n) for n, c in snap.items()]
    )
