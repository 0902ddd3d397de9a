"""Cleaning of prices, statements, fundamentals and analyst rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.functions.numeric import col, div

PRICE_COLUMNS = ("open", "high", "low", "close", "adj_close")


def try_double(c: str) -> Column:
    return F.expr(f"try_cast(`{c}` AS double)")


def forward_fill(df: DataFrame, columns, key="ticker", ts="dt") -> DataFrame:
    w = W.partitionBy(key).orderBy(ts).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def fill_both_ways(df: DataFrame, columns, key="ticker", ts="dt") -> DataFrame:
    """Forward fill, then backward fill what is left at the start."""
    w = W.partitionBy(key).orderBy(ts)
    back = w.rowsBetween(0, W.unboundedFollowing)
    f = forward_fill(df, columns, key, ts)
    return f.withColumns({c: F.first(c, ignorenulls=True).over(back) for c in columns})


def clean_prices(px: DataFrame, key="ticker", ts="dt") -> DataFrame:
    """Prices filled forward, missing volume zero, negative numbers made positive."""
    cols = [c for c in PRICE_COLUMNS if c in px.columns]
    f = forward_fill(px, cols, key, ts)
    return f.withColumns(
        {**{c: F.abs(F.col(c)) for c in cols}, "volume": F.abs(F.coalesce("volume", F.lit(0)))}
    )


def market_cap_millions(text: Column | str) -> Column:
    """'$1.5B' -> 1500; suffixes K, M, B, T, no suffix counts as millions; NULL if unreadable."""
    s = F.upper(F.regexp_replace(F.trim(col(text)), r"[$,]", ""))
    number = F.regexp_extract(s, r"^([0-9.]+)([KMBT]?)", 1)
    unit = F.regexp_extract(s, r"^([0-9.]+)([KMBT]?)", 2)
    scale = F.when(unit == "K", 1e-3).when(unit == "B", 1e3).when(unit == "T", 1e6).otherwise(1.0)
    return F.nullif(number, F.lit("")).try_cast("double") * scale


def market_cap_number(value: Column | str) -> Column:
    """A plain number of currency units in millions."""
    return col(value) / 1e6


def clean_statement(df: DataFrame, key_columns: list[str]) -> DataFrame:
    """Trimmed column names, numbers coerced from text, missing zero, dates as ISO labels."""
    d = df.toDF(*[c.strip() for c in df.columns])
    kinds = dict(d.dtypes)
    out = []
    for c in d.columns:
        q = F.col(f"`{c}`")
        if kinds[c] in ("date", "timestamp"):
            out.append(F.date_format(q, "yyyy-MM-dd").alias(c))
        elif c in key_columns:
            out.append((F.trim(q) if kinds[c] == "string" else q).alias(c))
        else:
            out.append(F.coalesce(try_double(c), F.lit(0.0)).alias(c))
    return d.select(*out)


# Date shapes looked for, in this order, with their formats.
DATE_SHAPES = [
    (r"\d{4}-\d{2}-\d{2}", "yyyy-MM-dd"),
    (r"\d{2}/\d{2}/\d{4}", "MM/dd/yyyy"),
    (r"\d{2}-\d{2}-\d{4}", "dd-MM-yyyy"),
    (r"\d{4}/\d{2}/\d{2}", "yyyy/MM/dd"),
]


def find_date(text: Column | str) -> Column:
    """The first recognisable date inside a label, else 1970-01-01."""
    t = col(text)
    tries = [
        F.to_date(F.try_to_timestamp(F.nullif(F.regexp_extract(t, f"({p})", 1), F.lit("")), F.lit(f)))
        for p, f in DATE_SHAPES
    ]
    return F.coalesce(*tries, F.lit("1970-01-01").cast("date"))


def clean_bundle(df: DataFrame, label: str, required: list[str], keys=("ticker",)) -> DataFrame:
    """Dated by ``find_date``, numbers double with zero for missing, absent required items added as zero."""
    nums = [c for c, k in df.dtypes if k in ("double", "float", "int", "bigint") and c not in keys]
    absent = [c for c in required if c not in df.columns]
    return df.select(
        *keys, find_date(label).alias("period_end"),
        *[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(c) for c in nums],
        *[F.lit(0.0).alias(c) for c in absent],
    )


FUNDAMENTAL_NUMBERS = (
    "pe_ratio", "pb_ratio", "eps", "roe", "dividend_yield", "beta", "total_debt", "total_equity", "current_assets",
    "current_liabilities", "interest_expense", "ebit", "gross_profit", "operating_income", "net_income", "revenue",
)


def clean_fundamentals(df: DataFrame) -> DataFrame:
    """Numbers coerced, text trimmed (missing empty), market cap in millions, three ratios derived."""
    fixes = {c: try_double(c) for c in FUNDAMENTAL_NUMBERS if c in df.columns}
    fixes |= {c: F.coalesce(F.trim(F.col(c)), F.lit("")) for c in ("sector", "industry") if c in df.columns}
    if "market_cap" in df.columns:
        text = dict(df.dtypes)["market_cap"] == "string"
        fixes["market_cap"] = market_cap_millions("market_cap") if text else market_cap_number("market_cap")
    d = df.withColumns(fixes)
    derived = {
        "current_ratio": ("current_assets", "current_liabilities"),
        "debt_to_equity": ("total_debt", "total_equity"),
        "net_margin": ("net_income", "revenue"),
    }
    return d.withColumns({k: div(a, b) for k, (a, b) in derived.items() if a in d.columns and b in d.columns})


def clean_analyst_rows(df: DataFrame) -> DataFrame:
    """Snake-case names, listing columns dropped, counts coerced, recommendation lower-case or unknown."""
    d = df.toDF(*[c.lower().replace(" ", "_") for c in df.columns]).drop("currency", "exchange", "quote_type")
    numeric = [c for c in ("target_price", "num_analysts", "strong_buy", "buy", "hold", "sell", "strong_sell") if c in d.columns]
    d = d.withColumns({c: try_double(c) for c in numeric})
    if "recommendation" in d.columns:
        d = d.withColumn("recommendation", F.lower(F.coalesce("recommendation", F.lit("unknown"))))
    return d
