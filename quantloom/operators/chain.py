"""Option-chain scans, checks and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.functions.numeric import div


def days_to_expiry(expiry: Column, as_of: Column) -> Column:
    """Whole days from ``as_of`` (date or timestamp) to the expiry's midnight, rounded down."""
    seconds = F.unix_timestamp(expiry.cast("timestamp")) - F.unix_timestamp(as_of.cast("timestamp"))
    return F.floor(seconds / F.lit(86400)).cast("int")


def contracts(chain: DataFrame, side: str, min_days: int) -> DataFrame:
    return chain.where((F.col("side") == side) & (F.col("dte") >= min_days))


def mean_iv(chain: DataFrame, keys: list[str], out: str = "avg_iv") -> DataFrame:
    """Volume-weighted IV over traded contracts, the plain mean if none traded; bad IVs dropped."""
    ok = chain.where(F.col("iv") >= 0)
    traded = F.col("volume") > 0
    weighted = div(
        F.sum(F.when(traded, F.col("iv") * F.col("volume"))), F.sum(F.when(traded, F.col("volume"))).cast("double")
    )
    return ok.groupBy(*keys).agg(F.coalesce(weighted, F.avg("iv")).alias(out))


def mean_iv_over(window, where: Column | None = None) -> Column:
    """``mean_iv`` as a window column over the rows that satisfy ``where``."""
    ok = F.col("iv") >= 0
    ok = ok if where is None else ok & where
    traded = ok & (F.col("volume") > 0)
    weighted = div(
        F.sum(F.when(traded, F.col("iv") * F.col("volume"))).over(window),
        F.sum(F.when(traded, F.col("volume"))).over(window).cast("double"),
    )
    return F.coalesce(weighted, F.avg(F.when(ok, F.col("iv"))).over(window))


def mean_iv_filled(chain: DataFrame, keys: list[str], default: float = 0.25) -> DataFrame:
    """The variant that gives an unknown volume the weight one; ``default`` when nothing weighs."""
    w = F.coalesce(F.col("volume").cast("double"), F.lit(1.0))
    return chain.groupBy(*keys).agg(
        F.coalesce(div(F.sum(F.col("iv") * w), F.sum(F.when(F.col("iv").isNotNull(), w))), F.lit(default)).alias("avg_iv_filled"),
        F.sum("volume").alias("total_volume"),
    )


def chain_summary(chain: DataFrame, key: str = "ticker") -> DataFrame:
    """Size, expiries, strike range, mean IV, total volume and open interest."""
    return chain.groupBy(key).agg(
        F.count("*").alias("n_contracts"),
        # month-end expiries: a listing's calendar, not its rows, bounds this set
        F.transform(F.sort_array(F.collect_set("expiry")), lambda d: F.date_format(d, "yyyy-MM-dd")).alias("expiries"),
        F.min("strike").alias("strike_min"),
        F.max("strike").alias("strike_max"),
        F.avg("iv").alias("mean_iv"),
        F.sum("volume").alias("total_volume"),
        F.sum("open_interest").alias("total_open_interest"),
    )


def with_iv_cutoff(chain: DataFrame, keys: list[str], q: float = 0.95) -> DataFrame:
    """IV percentile of each row's group as a column; a group is one listing, bounded by its strike grid."""
    return chain.withColumn("iv_cut", F.percentile("iv", F.lit(q)).over(W.partitionBy(*keys)))


NUMERIC = ("strike", "last_price", "iv", "volume", "open_interest", "delta", "ask", "bid")


def coerce_numeric(chain: DataFrame, columns=NUMERIC) -> DataFrame:
    """Text to double; unparsable values become NULL, absent columns are added as NULL."""
    return chain.withColumns(
        {c: (F.expr(f"try_cast(`{c}` AS double)") if c in chain.columns else F.lit(None).cast("double")) for c in columns}
    )


def structural_check(chain: DataFrame, key: str = "ticker") -> DataFrame:
    """Per listing: which of strike, last price and IV have no value at all."""
    checked = ("strike", "last_price", "iv")
    agg = chain.groupBy(key).agg(F.count("*").alias("n"), *[F.count(c).alias(f"_{c}") for c in checked])
    return agg.select(
        key, "n",
        F.array_compact(F.array(*[F.when(F.col(f"_{c}") == 0, F.lit(c)) for c in checked])).alias("empty_columns"),
    ).withColumn("valid", F.size("empty_columns") == 0)
