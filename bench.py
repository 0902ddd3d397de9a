"""Times the headline queries and prints one JSON line.

Every query is materialised in full (noop sink, no column pruned away) from the
parquet inputs, BENCH_RUNS times; the best run counts, so session warm-up does not.
"""

from __future__ import annotations

import json
import os
import time

from quantloom.plans import catalog
from quantloom.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
RUNS = int(os.environ.get("BENCH_RUNS", "2"))
HEADLINE = [
    "returns_simple", "rsi_sma", "technical_signals", "sma_bollinger", "ema_macd", "var95_drawdown",
    "beta", "pair_correlation", "spearman", "kendall", "rolling_corr", "corr_matrix",
    "ecosystem_signal", "forecast_confidence", "chain_summary", "indicator_row",
    "long_calls", "bull_call_spread", "covered_call", "cash_secured_put", "modular_score",
    "health_scores", "growth_trends", "dcf_a", "risk_report", "recommendation",
    "statement_standardize", "price_dq", "quality_score", "keyword_search",
]


def main() -> None:
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = local_session(CPUS, app="bench")
    queries = catalog.queries()
    times: dict[str, float] = {}
    queries["technical_signals"](spark, SF_DIR).write.format("noop").mode("overwrite").save()  # warm-up, untimed
    for name in only or HEADLINE:
        best = None
        for _ in range(RUNS):
            start = time.perf_counter()
            queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"), "cpus": CPUS,
            }
        )
    )


if __name__ == "__main__":
    main()
