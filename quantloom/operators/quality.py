"""Data-quality rules: row predicates folded by one aggregation per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.numeric import col, notes

PRICES = ("open", "high", "low", "close")


def price_rules(columns) -> dict[str, tuple[str, Column]]:
    """code -> (severity, row predicate) over the columns that exist."""
    has = [c for c in PRICES if c in columns]
    rules: dict[str, tuple[str, Column]] = {}
    present = [c for c in (*PRICES, "volume") if c in columns]
    missing = F.lit(False)
    for c in present:
        missing = missing | F.col(c).isNull()
    rules["MISSING_VALUES"] = ("MEDIUM", missing)
    negative = F.lit(False)
    for c in has:
        negative = negative | F.coalesce(F.col(c) < 0, F.lit(False))
    rules["NEGATIVE_PRICES"] = ("HIGH", negative)
    if len(has) == 4:
        h, lo, o, c = (F.col(x) for x in ("high", "low", "open", "close"))
        rules["INVALID_HIGH_LOW"] = ("HIGH", h < lo)
        rules["INVALID_OPEN_CLOSE"] = ("HIGH", (o > h) | (o < lo) | (c > h) | (c < lo))
    if "volume" in columns:
        rules["NEGATIVE_VOLUME"] = ("HIGH", F.col("volume") < 0)
    return rules


def missing_columns(df: DataFrame, required) -> list[str]:
    return [c for c in required if c not in df.columns]


def price_issues(px: DataFrame, key: str = "ticker") -> DataFrame:
    """(key, code, severity, n): the violated rules with the number of offending rows.

    A missing required column is reported for every key.
    """
    rules = price_rules(px.columns)
    absent = missing_columns(px, (*PRICES, "volume"))
    counts = px.groupBy(key).agg(
        *[F.count_if(F.coalesce(p, F.lit(False))).alias(code) for code, (_, p) in rules.items()],
        (F.count("*") if absent else F.lit(0).cast("bigint")).alias("MISSING_COLUMNS"),
    )
    codes = [*rules, "MISSING_COLUMNS"]
    severity = F.create_map(*[x for c in codes for x in (F.lit(c), F.lit(rules[c][0] if c in rules else "HIGH"))])
    long = counts.unpivot(key, codes, "code", "n").where("n > 0")
    return long.select(key, "code", F.element_at(severity, F.col("code")).alias("severity"), "n")


def fundamentals_issues(df: DataFrame, key="ticker", required=("market_cap", "pe_ratio", "eps"),
                        numeric=("market_cap", "pe_ratio", "eps", "dividend_yield", "beta")) -> DataFrame:
    """Missing required fields and text that is no number, as an array of codes per row."""
    checks = []
    for c in required:
        gone = F.lit(True) if c not in df.columns else F.col(c).isNull()
        checks.append((gone, f"MISSING:{c}"))
    for c in numeric:
        if c in df.columns:
            checks.append((F.col(c).isNotNull() & F.expr(f"try_cast(`{c}` AS double)").isNull(), f"INVALID:{c}"))
    return df.select(key, notes(*checks).alias("issues")).withColumn("valid", F.size("issues") == 0)


def bundle_check(universe: DataFrame, statements: dict[str, DataFrame], key="ticker") -> DataFrame:
    """Which of the statements each key has at all, and whether the bundle is complete."""
    out = universe.select(key)
    for name, df in statements.items():
        out = out.join(df.select(key).distinct().withColumn(f"has_{name}", F.lit(True)), key, "left")
    flags = [F.coalesce(F.col(f"has_{n}"), F.lit(False)) for n in statements]
    return out.select(
        key, *[f.alias(f"has_{n}") for n, f in zip(statements, flags)],
        F.forall(F.array(*flags), lambda x: x).alias("complete"),
    )


def strict_symbol(c: Column | str) -> Column:
    """Alphanumeric, one to ten characters."""
    return F.coalesce(col(c).rlike("^[A-Za-z0-9]{1,10}$"), F.lit(False))


def loose_symbol(c: Column | str) -> Column:
    """Any non-empty text up to ten characters."""
    return F.coalesce(F.length(col(c)).between(1, 10), F.lit(False))


def peer_symbol(c: Column | str) -> Column:
    """Alphanumeric after trimming and removing dots and dashes, any length."""
    return F.coalesce(F.regexp_replace(F.trim(col(c)), r"[.\-]", "").rlike("^[A-Za-z0-9]+$"), F.lit(False))


def normal_symbol(c: Column | str) -> Column:
    return F.upper(F.trim(col(c)))


def valid_range(start: Column, end: Column, max_years: int = 10) -> Column:
    """start strictly before end and at most ``max_years`` of 365 days apart."""
    span = F.datediff(end, start)
    return F.coalesce((start < end) & (span <= 365 * max_years), F.lit(False))


def ordered_range(start: Column, end: Column) -> Column:
    """The lenient rule: start not after end."""
    return F.coalesce(start <= end, F.lit(False))


def valid_parameters(growth="growth_rate", discount="discount_rate", years="forecast_years") -> Column:
    ok = (
        F.col(growth).between(-1, 1) & (F.col(discount) > 0) & (F.col(discount) <= 1) & F.col(years).between(1, 20)
    )
    return F.coalesce(ok, F.lit(False))


LEVELS = ("Strong Buy", "Buy", "Hold", "Sell", "Strong Sell")


def valid_recommendation(score="score", level="level", explanation="explanation") -> Column:
    ok = F.col(score).between(0, 100) & F.col(level).isin(*LEVELS) & (F.length(explanation) > 0)
    return F.coalesce(ok, F.lit(False))


def series_gate(df: DataFrame, value: str, key="ticker", min_length: int = 1, allow_null: bool = False) -> DataFrame:
    """Length and null gate per series: counts, verdict and reason; the failing keys are the quarantine."""
    g = df.groupBy(key).agg(F.count("*").alias("n_rows"), F.count(value).alias("n_valid"))
    reason = (
        F.when(F.col("n_valid") == 0, "empty")
        .when(F.col("n_valid") < min_length, "too short")
        .when(F.lit(not allow_null) & (F.col("n_valid") < F.col("n_rows")), "has nulls")
    )
    return g.withColumn("reason", reason).withColumn("passed", F.col("reason").isNull())


def frame_gate(df: DataFrame, required: list[str], key="ticker", min_rows: int = 1) -> DataFrame:
    """Required columns present and enough rows per key; periods, where given, positive."""
    absent = missing_columns(df, required)
    periods = F.min("period") if "period" in df.columns else F.lit(1)
    g = df.groupBy(key).agg(F.count("*").alias("n_rows"), periods.alias("_p"))
    return g.select(
        key, "n_rows",
        notes(
            (F.lit(bool(absent)), "missing columns: " + ", ".join(absent)),
            (F.col("n_rows") < min_rows, "too few rows"),
            (F.col("_p") <= 0, "non-positive period"),
        ).alias("reasons"),
    ).withColumn("passed", F.size("reasons") == 0)


def min_history(px: DataFrame, bars: int = 30, key="ticker") -> DataFrame:
    """Only keys with at least ``bars`` rows (a semi join on per-key counts)."""
    enough = px.groupBy(key).count().where(F.col("count") >= bars).select(key)
    return px.join(enough, key, "left_semi")


def source_status(universe: DataFrame, forecasts: DataFrame, options: DataFrame, peers: DataFrame, key="ticker") -> DataFrame:
    """Availability of the three sources and the overall health per key."""
    out = bundle_check(universe, {"forecast": forecasts, "options": options, "peers": peers}, key).drop("complete")
    flags = [F.col(f"has_{s}").cast("int") for s in ("forecast", "options", "peers")]
    n = flags[0] + flags[1] + flags[2]
    return out.withColumn("available_sources", n).withColumn(
        "health", F.when(n == 3, "healthy").when(n >= 2, "partial").otherwise("unhealthy")
    )


def health_summary(status: DataFrame) -> DataFrame:
    """Counts by health, success rate per source, and the most and least reliable source."""
    sources = ("forecast", "options", "peers")
    s = status.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("health") == h).alias(f"{h}_tickers") for h in ("healthy", "partial", "unhealthy")],
        *[F.coalesce(F.avg(F.col(f"has_{x}").cast("double")), F.lit(0.0)).alias(f"{x}_rate") for x in sources],
    )
    def rank(sign: int) -> Column:
        # ties go to the source named first
        best = F.array_min(F.array(*[F.struct((sign * F.col(f"{x}_rate")).alias("v"), F.lit(i).alias("i"), F.lit(x).alias("name")) for i, x in enumerate(sources)]))
        return best["name"]

    return s.withColumns({"most_reliable": rank(-1), "least_reliable": rank(1)})
