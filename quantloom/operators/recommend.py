"""Rule-based recommendation: metrics as rows, rules as a broadcast table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.numeric import ladder

CATEGORIES = ("value", "health", "growth", "profitability")

# Metric, threshold, points, description, category, better direction.
RULES = [
    ("margin_of_safety", 0.20, 2, "High margin of safety", "value", "high"),
    ("pe_ratio", 15.0, 1, "Reasonable P/E ratio", "value", "low"),
    ("pb_ratio", 1.5, 1, "Attractive price-to-book ratio", "value", "low"),
    ("piotroski_score", 7.0, 2, "Strong financial health", "health", "high"),
    ("altman_z_score", 3.0, 1, "Low bankruptcy risk", "health", "high"),
    ("current_ratio", 1.5, 1, "Strong liquidity position", "health", "high"),
    ("debt_to_equity", 0.5, 1, "Conservative debt levels", "health", "low"),
    ("growth_score", 4.0, 2, "Strong growth profile", "growth", "high"),
    ("revenue_cagr", 0.15, 1, "Strong revenue growth", "growth", "high"),
    ("eps_cagr", 0.10, 1, "Consistent earnings growth", "growth", "high"),
    ("roe", 0.15, 1, "Strong return on equity", "profitability", "high"),
    ("operating_margin", 0.15, 1, "Healthy operating margins", "profitability", "high"),
    ("fcf_margin", 0.10, 1, "Strong free cash flow generation", "profitability", "high"),
]
LABELS = [(8.0, "Strong Buy"), (6.0, "Buy"), (4.0, "Hold")]

# The investment texts per label.
THESIS_BUY = ("This stock appears to be a good value investment opportunity. Consider building a position gradually, "
              "starting with a small initial investment and adding more on price weakness.")
THESIS_HOLD = ("The stock shows mixed signals. Consider waiting for better entry points or more clarity on key metrics "
               "before making a significant investment.")
THESIS_SELL = ("The current metrics suggest avoiding this stock. If already holding, consider reducing or exiting the "
               "position unless there are strong contrarian reasons to maintain exposure.")


def rules(spark: SparkSession) -> DataFrame:
    rows = [(i, *r) for i, r in enumerate(RULES)]
    return spark.createDataFrame(
        rows, "ord int, metric string, threshold double, points int, reason string, category string, direction string"
    )


def judged(metrics: DataFrame, compat: bool = True) -> DataFrame:
    """One row per (ticker, rule) with a known metric: did it earn its points?

    ``compat`` tests every rule as value >= threshold; otherwise the rules for
    which low is better use <=.
    """
    names = [r[0] for r in RULES if r[0] in metrics.columns]
    long = metrics.select("ticker", *[F.col(n).cast("double") for n in names]).unpivot("ticker", names, "metric", "value")
    j = long.where(F.col("value").isNotNull()).join(F.broadcast(rules(metrics.sparkSession)), "metric")
    hit = F.col("value") >= F.col("threshold")
    if not compat:
        hit = F.when(F.col("direction") == "low", F.col("value") <= F.col("threshold")).otherwise(hit)
    return j.withColumn("hit", hit)


def recommendation(metrics: DataFrame, compat: bool = True) -> DataFrame:
    """Score, per-category breakdown, reasons and label.

    The thirteen metrics of a ticker are columns of one row, so the rules are
    applied in place: no rows are multiplied and nothing is shuffled.
    """
    def hit(r) -> Column:
        name, threshold, _, _, _, better = r
        v = F.col(name).cast("double") if name in metrics.columns else F.lit(None).cast("double")
        test = v <= threshold if (better == "low" and not compat) else v >= threshold
        return F.coalesce(test, F.lit(False))

    def points(rs) -> Column:
        out = F.lit(0)
        for r in rs:
            out = out + F.when(hit(r), r[2]).otherwise(0)
        return out

    reasons = F.array_compact(F.array(*[F.when(hit(r), F.lit(r[3])) for r in RULES]))
    scored = metrics.withColumns(
        {
            "score": points(RULES),
            **{f"{c}_points": points([r for r in RULES if r[4] == c]) for c in CATEGORIES},
            "reasons": reasons,
        }
    )
    return scored.withColumn("recommendation", label(F.col("score")))


def label(score: Column) -> Column:
    return ladder(score, LABELS, "Sell")


def explain(rec: DataFrame) -> DataFrame:
    """Strengths (>= 70 % of a category's points), concerns (<= 30 %), thesis and summary."""
    best = {c: sum(r[2] for r in RULES if r[4] == c) for c in CATEGORIES}
    share = {c: F.col(f"{c}_points") / float(best[c]) for c in CATEGORIES}
    lab = F.col("recommendation")
    return rec.select(
        "ticker", "score", "recommendation",
        F.concat(lab, F.lit(" recommendation based on a score of "), F.col("score").cast("string"), F.lit("/10")).alias("summary"),
        F.array_compact(F.array(*[F.when(s >= 0.7, F.lit(f"Strong {c} metrics")) for c, s in share.items()])).alias("key_strengths"),
        F.array_compact(F.array(*[F.when(s <= 0.3, F.lit(f"Weak {c} metrics")) for c, s in share.items()])).alias("key_concerns"),
        F.when(lab.isin("Strong Buy", "Buy"), THESIS_BUY).when(lab == "Hold", THESIS_HOLD).otherwise(THESIS_SELL).alias("investment_thesis"),
    )
