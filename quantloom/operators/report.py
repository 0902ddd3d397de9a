"""Collection report over wide statements: completeness, structure, impact, advice, quality score.

Input is one frame keyed by (ticker, period_end) whose columns are canonical
item names, plus a ``layout`` saying which of them belong to which statement
and optional ``has_<statement>`` flags for periods a statement was not filed
for.  All statements are judged in the same pass.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.config import statements as cfg
from quantloom.functions.numeric import notes

Layout = dict[str, list[str]]
TITLE = {"income": "Income Stmt", "balance": "Balance Sheet", "cash_flow": "Cash Flow"}


def q(name: str) -> Column:
    return F.col(f"`{name}`")


def filed(wide: DataFrame, statement: str) -> Column:
    flag = f"has_{statement}"
    return F.coalesce(F.col(flag), F.lit(False)) if flag in wide.columns else F.lit(True)


def strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def presence(universe: DataFrame, wide: DataFrame, layout: Layout) -> DataFrame:
    """Which statements each ticker has at all, and whether the bundle is complete."""
    g = wide.groupBy("ticker").agg(*[F.bool_or(filed(wide, s)).alias(f"_{s}") for s in layout])
    flags = {s: F.coalesce(F.col(f"_{s}"), F.lit(False)) for s in layout}
    return universe.select("ticker").join(g, "ticker", "left").select(
        "ticker", *[c.alias(f"has_{s}") for s, c in flags.items()],
        F.forall(F.array(*flags.values()), lambda x: x).alias("complete"),
    )


def availability(universe: DataFrame, wide: DataFrame, layout: Layout) -> DataFrame:
    """Per (ticker, statement): completeness %, periods, last date, missing items, negative findings.

    Tickers without a statement get an ``available = false`` row.  Balance
    sheets never carry a date.
    """
    aggs, rows = [], []
    for s, items in layout.items():
        here = filed(wide, s)
        present = [c for c in cfg.REQUIRED_AVAILABILITY[s] if c in items]
        counts = [F.count(F.when(here, q(c))) for c in items]
        aggs += [
            F.count_if(here).alias(f"_n_{s}"),
            (counts[0] if len(counts) == 1 else F.least(*counts)).alias(f"_least_{s}"),
            F.max(F.when(here, F.col("period_end"))).alias(f"_last_{s}"),
            *[F.count_if(here & (q(c) < 0)).alias(f"_neg_{s}_{i}") for i, c in enumerate(present)],
        ]
        n = F.col(f"_n_{s}")
        found = F.coalesce(n > 0, F.lit(False))
        issues = notes(
            *[
                (F.col(f"_neg_{s}_{i}") > 0, F.format_string(f"Negative values in {c}: %d occurrences", F.col(f"_neg_{s}_{i}")))
                for i, c in enumerate(present)
            ]
        )
        last = F.lit(None).cast("date") if s == "balance" else F.col(f"_last_{s}")
        rows.append(
            F.struct(
                F.lit(s).alias("statement"),
                F.when(found, n).alias("periods"),
                F.when(found, F.col(f"_least_{s}") / n * 100).alias("completeness"),
                F.when(found, last).alias("last_date"),
                F.when(found, strings([c for c in cfg.REQUIRED_AVAILABILITY[s] if c not in items])).alias("missing_columns"),
                F.when(found, issues).alias("issues"),
                found.alias("available"),
            )
        )
    g = wide.groupBy("ticker").agg(*aggs)
    return universe.select("ticker").join(g, "ticker", "left").select("ticker", F.inline(F.array(*rows)))


def structure(wide: DataFrame, layout: Layout) -> DataFrame:
    """Required items absent from the schema (errors), text items and items with gaps (warnings)."""
    kinds = dict(wide.dtypes)
    aggs, rows = [], []
    for s, items in layout.items():
        here = filed(wide, s)
        aggs += [
            F.count_if(here).alias(f"_n_{s}"),
            *[F.count_if(here & q(c).isNull()).alias(f"_gap_{s}_{i}") for i, c in enumerate(items)],
        ]
        absent = [c for c in cfg.REQUIRED_STRUCTURE[s] if c not in items]
        errors = [f"Missing required columns: {', '.join(absent)}"] if absent else []
        gaps = notes(*[(F.col(f"_gap_{s}_{i}") > 0, c) for i, c in enumerate(items)])
        warnings = notes(
            *[(F.lit(kinds[c] == "string"), f"Column '{c}' is not numeric") for c in items],
            (F.size(gaps) > 0, F.concat(F.lit("Found missing values in columns: "), F.array_join(gaps, ", "))),
        )
        rows.append(
            F.when(
                F.col(f"_n_{s}") > 0,
                F.struct(F.lit(s).alias("statement"), strings(errors).alias("errors"), warnings.alias("warnings"), F.lit(not errors).alias("is_valid")),
            )
        )
    g = wide.groupBy("ticker").agg(*aggs)
    return g.select("ticker", F.inline(F.array_compact(F.array(*rows))))


def missing_items(wide: DataFrame, layout: Layout) -> DataFrame:
    """Required items without any value, per ticker and filed statement."""
    aggs, rows = [], []
    for s, items in layout.items():
        here = filed(wide, s)
        aggs += [F.count_if(here).alias(f"_n_{s}"), *[F.count(F.when(here, q(c))).alias(f"_v_{s}_{i}") for i, c in enumerate(items)]]
        have = F.array_compact(F.array(*[F.when(F.col(f"_v_{s}_{i}") > 0, F.lit(c)) for i, c in enumerate(items)]))
        gone = F.array_except(strings(cfg.REQUIRED_STRUCTURE[s]), have)
        rows.append(F.when(F.col(f"_n_{s}") > 0, F.struct(F.lit(s).alias("statement"), gone.alias("items"))))
    g = wide.groupBy("ticker").agg(*aggs).select("ticker", F.inline(F.array_compact(F.array(*rows))))
    return g.select("ticker", "statement", F.explode("items").alias("item"))


def impact(avail: DataFrame, fundamentals: DataFrame) -> DataFrame:
    """Affected metrics per ticker in four groups, from missing statements, items and fundamentals."""
    rules = [
        F.when(
            (F.col("statement") == s) & (~F.col("available") | F.arrays_overlap(F.col("missing_columns"), F.array(*[F.lit(i) for i in items]))),
            F.struct(F.lit(n).alias("ord"), F.lit(group).alias("grp"), F.lit(", ".join(metrics)).alias("metrics")),
        )
        for n, (s, items, group, metrics) in enumerate(cfg.DEPENDENCIES)
    ]
    hits = avail.select("ticker", F.explode(F.array_compact(F.array(*rules))).alias("h")).select("ticker", "h.*")
    gaps = fundamentals.select(
        "ticker",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("pe_ratio").isNull(), F.struct(F.lit(-2).alias("ord"), F.lit("value_metrics").alias("grp"), F.lit("P/E Ratio").alias("metrics"))),
                    F.when(F.col("beta").isNull(), F.struct(F.lit(-1).alias("ord"), F.lit("risk_metrics").alias("grp"), F.lit("Market Risk").alias("metrics"))),
                )
            )
        ).alias("h"),
    ).select("ticker", "h.*")
    # at most one row per dependency rule and ticker, so the lists are bounded
    lists = hits.unionByName(gaps).groupBy("ticker").pivot(
        "grp", ["value_metrics", "health_metrics", "growth_metrics", "risk_metrics"]
    ).agg(F.sort_array(F.collect_list(F.struct("ord", "metrics"))))
    groups = ("value_metrics", "health_metrics", "growth_metrics", "risk_metrics")
    return lists.select(
        "ticker",
        *[F.array_join(F.transform(F.coalesce(F.col(g), F.array().cast("array<struct<ord:int,metrics:string>>")), lambda x: x["metrics"]), ", ").alias(g) for g in groups],
    )


def advice(avail: DataFrame, affected: DataFrame, as_of: dt.date, stale_days: int = 90) -> DataFrame:
    """One advice text per gap, negative finding, affected metric group and stale statement."""
    title = F.element_at(F.create_map(*[x for k, v in TITLE.items() for x in (F.lit(k), F.lit(v))]), F.col("statement"))
    stale = F.datediff(F.lit(as_of), F.col("last_date")) > stale_days
    per_statement = avail.select(
        "ticker",
        F.explode(
            notes(
                (~F.col("available"), F.concat(F.lit("Collect "), title, F.lit(" data"))),
                (F.size("missing_columns") > 0, F.concat(F.lit("Add "), F.array_join("missing_columns", ", "), F.lit(" to "), title)),
                (F.size("issues") > 0, F.concat(F.lit("Review "), title, F.lit(" for "), F.array_join("issues", ", "))),
                (stale, F.concat(F.lit("Update "), title, F.lit(" data (last available: "), F.date_format("last_date", "yyyy-MM-dd"), F.lit(")"))),
            )
        ).alias("advice"),
    )
    groups = ("value_metrics", "health_metrics", "growth_metrics", "risk_metrics")
    per_group = affected.select(
        "ticker",
        F.explode(
            notes(
                *[
                    (F.col(g) != "", F.concat(F.lit(f"Improve {g.replace('_', ' ')} calculation by collecting: "), F.col(g)))
                    for g in groups
                ]
            )
        ).alias("advice"),
    )
    return per_statement.unionByName(per_group)


def age_penalty(days: Column) -> Column:
    return F.when(days > 365, 10.0).when(days > 180, 7.0).when(days > 90, 5.0).when(days > 30, 2.0).otherwise(0.0)


def quality_score(universe: DataFrame, wide: DataFrame, layout: Layout, fundamentals: DataFrame, as_of: dt.date) -> DataFrame:
    """0..100: share of required items present, less at most 40 points of scaled penalties.

    Penalties: age of each dated statement, negative values of the critical items
    in the latest eight periods, missing or zero critical fundamentals, and low
    completeness.  Fundamentals never count as required items.
    """
    newest = W.partitionBy("ticker").orderBy(F.desc("period_end")).rowsBetween(W.unboundedPreceding, 0)
    ranked = wide.withColumns({f"_rank_{s}": F.sum(filed(wide, s).cast("int")).over(newest) for s in layout})
    aggs = []
    required, have, penalty, most = F.lit(0), F.lit(0), F.lit(0.0), 0.0
    for s, items in layout.items():
        recent = filed(wide, s) & (F.col(f"_rank_{s}") <= 8)
        critical = [c for c in cfg.CRITICAL_POSITIVE[s] if c in items]
        aggs += [
            F.max(F.when(filed(wide, s), F.col("period_end"))).alias(f"_last_{s}"),
            *[F.count_if(recent & (q(c) < 0)).alias(f"_neg_{s}_{i}") for i, c in enumerate(critical)],
        ]
        here = F.col(f"_last_{s}").isNotNull()
        need = cfg.REQUIRED_STRUCTURE[s]
        required = required + F.when(here, len(need)).otherwise(0)
        have = have + F.when(here, sum(c in items for c in need)).otherwise(0)
        most += 10 + 5 * len(cfg.CRITICAL_POSITIVE[s])
        if s != "balance":
            penalty = penalty + F.when(here, age_penalty(F.datediff(F.lit(as_of), F.col(f"_last_{s}")))).otherwise(0.0)
        for i in range(len(critical)):
            penalty = penalty + F.least(F.lit(5.0), F.coalesce(F.col(f"_neg_{s}_{i}"), F.lit(0)) * 1.5)
    score = (
        universe.select("ticker")
        .join(ranked.groupBy("ticker").agg(*aggs), "ticker", "left")
        .join(fundamentals.select("ticker", *cfg.CRITICAL_FUNDAMENTALS), "ticker", "left")
    )
    for c in cfg.CRITICAL_FUNDAMENTALS:
        most += 8
        penalty = penalty + F.when(F.col(c).isNull(), 8.0).when(F.col(c) == 0, 4.0).otherwise(0.0)
    most += 15
    out = score.select("ticker", required.alias("required"), have.alias("available"), penalty.alias("_p"))
    ratio = F.col("available") / F.nullif(F.col("required"), F.lit(0))
    out = out.withColumns(
        {
            "base_score": F.coalesce(ratio * 100, F.lit(0.0)),
            "penalty": F.col("_p") + F.when(ratio < 0.5, 15.0).when(ratio < 0.7, 10.0).when(ratio < 0.9, 5.0).otherwise(0.0),
        }
    ).drop("_p")
    return out.withColumn(
        "quality_score", F.greatest(F.lit(0.0), F.col("base_score") - F.col("penalty") / most * 40)
    )
