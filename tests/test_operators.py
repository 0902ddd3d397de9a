"""Operators against hand-computed numbers or brute force on small fixtures."""

import datetime as dt
import difflib
import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.config import glossary
from quantloom.config import options as cfg
from quantloom.functions import formatting as fmt
from quantloom.functions import weights as wt
from quantloom.functions.inference import correlation_pvalue, normal_pvalue
from quantloom.functions.numeric import clamp, norm, rescale
from quantloom.operators import chain as ch
from quantloom.operators import clean, filters, forecast, normalize, pairs, quality, scoring, series, strategies
from quantloom.operators.quantile import grouped_quantiles
from quantloom.sources import readers, sinks

DAY = dt.date(2020, 1, 1)


def bars(spark, data: dict[str, list], start=DAY):
    rows = [(t, start + dt.timedelta(days=i), None if p is None else float(p)) for t, ps in data.items() for i, p in enumerate(ps)]
    return spark.createDataFrame(rows, "ticker string, dt date, close double")


def one(df):
    return df.collect()[0]


# --- series ------------------------------------------------------------------

def test_ewm_rsi_known_value(spark):
    px = bars(spark, {"A": [100, 102, 101, 103, 105, 104, 106, 108, 107, 109]})
    prices = pd.Series([100, 102, 101, 103, 105, 104, 106, 108, 107, 109], dtype=float)
    d = prices.diff().dropna()
    rs = d.clip(lower=0).ewm(span=5).mean() / (-d).clip(lower=0).ewm(span=5).mean()
    expected = (100 - 100 / (1 + rs)).iloc[-1]
    got = one(series.rsi_ewm(px, period=5))["rsi"]
    assert got == pytest.approx(expected, abs=1e-12)
    assert got == pytest.approx(81.25, abs=0.01)


def test_rsi_without_losses_is_100_and_flat_is_unknown(spark):
    px = bars(spark, {"UP": range(1, 40), "FLAT": [5] * 40, "SHORT": [1, 2, 3]})
    got = {r["ticker"]: r["rsi"] for r in series.rsi_ewm(px).collect()}
    assert got == {"UP": 100.0, "FLAT": None, "SHORT": None}


def test_rsi_sma_matches_pandas(spark):
    rng = np.random.default_rng(1)
    p = pd.Series(100 + rng.normal(size=80).cumsum())
    d = p.diff()
    rs = d.where(d > 0, 0).rolling(14).mean() / (-d.where(d < 0, 0)).rolling(14).mean()
    expected = (100 - 100 / (1 + rs)).to_numpy()
    got = [r["rsi"] for r in series.rsi_sma(bars(spark, {"A": p.tolist()})).orderBy("dt").collect()]
    for g, e in zip(got, expected):
        assert (g is None and math.isnan(e)) or g == pytest.approx(e, abs=1e-9)


@pytest.mark.parametrize("span", [9, 26, 200])
def test_ema_is_exact_on_long_histories(spark, span):
    rng = np.random.default_rng(2)
    p = pd.Series(100 + rng.normal(size=9000).cumsum() * 0.1)
    got = np.array([r["e"] for r in series.ema(bars(spark, {"A": p.tolist()}, dt.date(1980, 1, 1)), {"e": ("close", span)}).orderBy("dt").collect()])
    expected = p.ewm(span=span, adjust=False).mean().to_numpy()
    assert np.max(np.abs(got / expected - 1)) < 1e-12


def test_price_risk_matches_pandas(spark):
    rng = np.random.default_rng(3)
    p = pd.Series(100 * np.exp(rng.normal(scale=0.02, size=300).cumsum()))
    r = p.pct_change().dropna()
    cum = (1 + r).cumprod()
    row = one(series.price_risk(bars(spark, {"A": p.tolist()})))
    assert row["volatility"] == pytest.approx(r.std() * math.sqrt(252), rel=1e-9)
    assert row["var_95"] == pytest.approx(np.percentile(r, 5), rel=1e-9)
    assert row["max_drawdown"] == pytest.approx((cum / cum.expanding().max() - 1).min(), rel=1e-9)


def test_rolling_volatility_needs_thirty_returns(spark):
    px = bars(spark, {"A": [100 + (i % 3) for i in range(30)], "B": [100 + (i % 3) for i in range(31)]})
    got = {r["ticker"]: r["rolling_vol"] for r in series.rolling_volatility(px).collect()}
    assert got["A"] is None and got["B"] > 0


def test_momentum_skips_nulls_and_needs_history(spark):
    px = bars(spark, {"A": [100, None, *range(101, 121)], "B": [1, 2, 3]})
    got = {r["ticker"]: r["momentum"] for r in series.momentum(px).collect()}
    assert got["A"] == pytest.approx(0.2) and got["B"] is None


# --- pairs -------------------------------------------------------------------

def test_pvalues(spark):
    # t = 2 on 10 degrees of freedom and t = 2.5 on 9
    def r_of(t, df):
        return t / math.sqrt(df + t * t)

    df = spark.createDataFrame([(r_of(2, 10), 12), (r_of(2.5, 9), 11), (0.0, 50), (1.0, 40), (-r_of(2, 10), 12), (r_of(1, 1), 3), (r_of(3, 2), 4), (r_of(3, 3), 5)], "r double, n bigint")
    p = [x["p"] for x in df.select(correlation_pvalue(F.col("r"), F.col("n")).alias("p")).collect()]
    assert p == pytest.approx([0.0733880, 0.0338618, 1.0, 0.0, 0.0733880, 0.5, 0.0954660, 1 / 3 - math.sqrt(3) / (2 * math.pi)], abs=1e-6)
    z = one(spark.createDataFrame([(1.959964,)], "z double").select(normal_pvalue("z").alias("p")))["p"]
    assert z == pytest.approx(0.05, abs=1e-6)


def sample_pairs(spark, n=70, ties=True):
    rng = np.random.default_rng(4)
    rows = []
    for peer in ("P", "Q"):
        x = rng.integers(0, 15, n) if ties else rng.normal(size=n)
        y = x + rng.integers(0, 9, n)
        rows += [("A", peer, DAY + dt.timedelta(days=i), float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))]
    return rows, spark.createDataFrame(rows, "ticker string, peer string, dt date, x double, y double")


def test_kendall_matches_brute_force(spark):
    rows, df = sample_pairs(spark)
    got = {r["peer"]: r["r"] for r in pairs.kendall(df).collect()}
    for peer in ("P", "Q"):
        v = [(r[3], r[4]) for r in rows if r[1] == peer]
        s = tx = ty = 0
        for (a, b), (c, d) in itertools.combinations(v, 2):
            s += np.sign(c - a) * np.sign(d - b)
            tx += a == c
            ty += b == d
        n0 = len(v) * (len(v) - 1) / 2
        assert got[peer] == pytest.approx(s / math.sqrt((n0 - tx) * (n0 - ty)), abs=1e-12)


def test_spearman_matches_pandas_with_ties(spark):
    rows, df = sample_pairs(spark)
    got = {r["peer"]: r["r"] for r in pairs.spearman(df).collect()}
    for peer in ("P", "Q"):
        v = pd.DataFrame([(r[3], r[4]) for r in rows if r[1] == peer])
        assert got[peer] == pytest.approx(v[0].rank().corr(v[1].rank()), abs=1e-12)


def test_peer_correlations_keep_pairs_without_overlap(spark):
    px = bars(spark, {"A": np.sin(np.arange(50)) + 5, "B": np.sin(np.arange(50)) * 2 + 9})
    edges = spark.createDataFrame([("A", "B"), ("A", "NONE")], "ticker string, peer string")
    got = {r["peer"]: r for r in pairs.peer_correlations(series.with_returns(px), edges).collect()}
    assert got["B"]["n"] == 49 and got["B"]["significant"]
    assert (got["NONE"]["r"], got["NONE"]["p_value"], got["NONE"]["n"], got["NONE"]["significant"]) == (0.0, 1.0, 0, False)


def test_correlation_matrix_is_pairwise_complete(spark):
    rng = np.random.default_rng(5)
    wide = pd.DataFrame(rng.normal(size=(60, 3)), columns=list("ABC"))
    wide.iloc[::7, 1] = np.nan
    rows = [(c, DAY + dt.timedelta(days=int(i)), float(v)) for c in wide for i, v in wide[c].dropna().items()]
    members = spark.createDataFrame([("A",), ("B",), ("C",)], "ticker string")
    got = {(r["a"], r["b"]): r["r"] for r in pairs.correlation_matrix(spark.createDataFrame(rows, "ticker string, dt date, ret double"), members).collect()}
    expected = wide.corr()
    assert len(got) == 6
    for (a, b), r in got.items():
        assert r == pytest.approx(expected.loc[a, b], abs=1e-9)


def test_regime_change_finds_a_flip(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=200)
    y = np.where(np.arange(200) < 100, x, -x)
    rows = [("A", "B", DAY + dt.timedelta(days=i), float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "ticker string, peer string, dt date, x double, y double")
    r = pd.Series(x).rolling(30, min_periods=15).corr(pd.Series(y)).dropna().reset_index(drop=True)
    s = r.rolling(20, center=True).mean()
    expected = [i for i in range(20, len(s) - 20) if abs(s[i:i + 20].mean() - s[i - 20:i].mean()) >= 0.3]
    got = pairs.regime_changes(pairs.rolling_correlation(df)).count()
    assert got == len(expected) > 0


def test_edges_are_cleaned_and_upserted(spark):
    old = spark.createDataFrame([("A", "X"), ("B", "Y")], "ticker string, peer string")
    new = spark.createDataFrame([("a ", " brk.b"), ("A", "A"), ("A", "b@d"), ("A", "BRK.B")], "ticker string, peer string")
    assert sorted(map(tuple, pairs.upsert_edges(old, new).collect())) == [("A", "BRK.B"), ("B", "Y")]


# --- quantiles under skew ----------------------------------------------------

@pytest.mark.parametrize("accuracy", [10_000, 50])
def test_quantiles_are_exact_with_a_dominant_group(spark, accuracy):
    rng = np.random.default_rng(7)
    hot = np.round(rng.lognormal(size=6000), 3)
    data = {"hot": hot, "small": np.array([3.0, 1.0]), "same": np.full(500, 2.0), "single": np.array([9.0])}
    rows = [(k, float(v)) for k, vs in data.items() for v in vs] + [("hot", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r for r in grouped_quantiles(df, ["k"], "v", {"lo": 0.05, "mid": 0.5, "hi": 0.95, "max": 1.0}, accuracy).collect()}
    for k, vs in data.items():
        assert got[k]["n"] == len(vs)
        for name, q in (("lo", 5), ("mid", 50), ("hi", 95), ("max", 100)):
            assert got[k][name] == pytest.approx(np.percentile(vs, q), abs=1e-12), (k, name)


# --- scalars, weights, formats ------------------------------------------------

def test_scaling(spark):
    df = spark.createDataFrame([(-1.0,), (0.25,), (9.0,), (None,)], "v double")
    got = df.select(norm("v", 0, 1).alias("a"), norm("v", 0, 1, invert=True).alias("b"), norm("v", 2, 2).alias("c"),
                    rescale("v", 0, 1, 10, 20).alias("d"), clamp(F.col("v")).alias("e")).collect()
    assert [tuple(r) for r in got] == [(0, 1, .5, 10, 0), (.25, .75, .5, 12.5, .25), (1, 0, .5, 20, 1), (None, None, None, None, None)]


def test_weight_renormalisation_goldens(spark):
    have = {s: F.lit(s != "iv") for s in cfg.SOURCES}
    r = one(spark.range(1).select(wt.weight_map(wt.renormalize(cfg.DEFAULT_WEIGHTS, have)).alias("m")))["m"]
    assert r == pytest.approx({"rsi": .25, "beta": .25, "momentum": .25, "forecast": .25})
    custom = {"rsi": 0.3, "beta": 0.25, "momentum": 0.2, "iv": 0.15, "forecast": 0.1}
    have = {s: F.lit(s in ("rsi", "beta", "momentum")) for s in cfg.SOURCES}
    r = one(spark.range(1).select(wt.weight_map(wt.renormalize(custom, have)).alias("m")))["m"]
    assert r == pytest.approx({"rsi": .4, "beta": 1 / 3, "momentum": .2 / .75})
    none = {s: F.lit(False) for s in cfg.SOURCES}
    r = one(spark.range(1).select(wt.weight_map(wt.renormalize(custom, none), wt.none_available(none)).alias("m")))["m"]
    assert r == {"neutral": 1.0}
    zero = one(spark.range(1).select(wt.weight_map(wt.renormalize({"a": 0.0, "b": 0.0}, {"a": F.lit(True), "b": F.lit(True)})).alias("m")))["m"]
    assert zero == {"a": .5, "b": .5}


def test_all_strategy_weights_sum_to_one():
    for name in cfg.STRATEGY_WEIGHTS:
        assert sum(cfg.strategy_weights(name).values()) == pytest.approx(1.0)
    assert cfg.strategy_weights("unknown") == cfg.DEFAULT_WEIGHTS
    assert cfg.risk_adjusted_params("Long Calls", "Aggressive")["min_days_adjustment"] == -60


def test_formats(spark):
    df = spark.createDataFrame([(1234567.891,), (None,), (float("nan"),), (float("inf"),)], "v double")
    got = df.select(fmt.currency_short("v"), fmt.currency("v"), fmt.percent("v"), fmt.number("v")).collect()
    assert tuple(got[0]) == ("$1.23M", "$1,234,567.89", "123456789.1%", "1234567.89")
    assert all(tuple(r) == ("N/A",) * 4 for r in got[1:])
    rsi = spark.createDataFrame([(20.0,), (50.0,), (80.0,)], "v double").select(fmt.status("v", "rsi"), fmt.cell_class("v", "rsi")).collect()
    assert [tuple(r) for r in rsi] == [("good", "green"), ("neutral", "orange"), ("warning", "red")]


# --- chains, scores, strategies ----------------------------------------------

def test_mean_iv(spark):
    rows = [("A", .2, 100), ("A", .4, 300), ("A", -.5, 900), ("A", None, 50), ("B", .3, 0), ("B", .5, None)]
    c = spark.createDataFrame(rows, "ticker string, iv double, volume bigint")
    got = {r["ticker"]: r["avg_iv"] for r in ch.mean_iv(c, ["ticker"]).collect()}
    assert got == pytest.approx({"A": .35, "B": .4})


def contracts(spark):
    rows = [("A", "C", dt.date(2021, 1, 31), 80.0 + 2 * i, 30.0 - 0.7 * i, .2 + .01 * i, 10 + i, 10, 100.0, 200) for i in range(15)]
    return spark.createDataFrame(
        rows, "ticker string, side string, expiry date, strike double, last_price double, iv double, volume bigint, open_interest bigint, spot double, dte int")


def indicators(spark):
    return spark.createDataFrame(
        [("A", 45.0, 1.2, .05, .75, True, True, True, True)],
        "ticker string, rsi double, beta double, momentum double, forecast double, has_rsi boolean, has_beta boolean, has_momentum boolean, has_forecast boolean")


def test_spread_pairs_match_a_double_loop(spark):
    c = contracts(spark)
    got = {(r["long_strike"], r["short_strike"]) for r in strategies.spread_pairs(c).collect()}
    k = [80.0 + 2 * i for i in range(15)]
    assert got == {(k[i], k[j]) for i in range(15) for j in range(i + 1, min(i + 8, 15))}


def test_spreads_are_bounded_and_ranked(spark):
    rows = strategies.bull_call_spread(contracts(spark), indicators(spark)).collect()
    assert {r["risk"] for r in rows} == set(cfg.RISK_LEVELS)
    for r in rows:
        assert 0 <= r["composite_score"] <= 1 and r["net_premium"] > 0 and r["max_profit"] > 0
        assert sum(r["score_details"].values()) == pytest.approx(1)
        width = {"Conservative": 10, "Moderate": 15, "Aggressive": 20}[r["risk"]]
        assert r["spread_width"] <= width + 1e-9
    n = {x: sum(r["risk"] == x for r in rows) for x in cfg.RISK_LEVELS}
    assert n["Conservative"] <= 5 and n["Moderate"] <= 5 and n["Aggressive"] <= 10


def test_missing_forecast_moves_its_weight(spark):
    ind = indicators(spark).withColumn("has_forecast", F.lit(False))
    row = one(strategies.covered_call(contracts(spark), ind, risks=("Moderate",)))
    assert set(row["score_details"]) == {"rsi", "beta", "momentum", "iv"}
    assert row["score_details"]["rsi"] == pytest.approx(.25)


def test_dispatch_limits_and_validation(spark):
    days, n = strategies.request_limits("Covered Call", 180, 5)
    assert days == {"Conservative": 90, "Moderate": 90, "Aggressive": 90} and n["Aggressive"] == 10
    days, n = strategies.request_limits("Long Calls", 30, 5, compat=False)
    assert days["Conservative"] == 60 and n["Aggressive"] == 5
    with pytest.raises(ValueError):
        strategies.request_limits("Iron Condor", 30, 5)
    out = strategies.analyze("Covered Call", contracts(spark), indicators(spark), strategy_weighted=True, analysis_date="2020-07-15")
    assert out.where("strategy_type = 'Covered Call' AND analysis_date = '2020-07-15'").count() == out.count() > 0
    custom = strategies.analyze("Covered Call", contracts(spark), indicators(spark), weights={**cfg.DEFAULT_WEIGHTS, "rsi": 0.0})
    assert custom.count() == out.count()


def test_long_call_selection_with_signal(spark):
    sig = spark.createDataFrame([("A", .8, "confirm", .7)], "ticker string, score double, signal string, confidence double")
    rows = strategies.long_calls(contracts(spark), indicators(spark), sig, top_n=1).collect()
    assert all(r["final_score"] == pytest.approx(r["composite_score"] * 1.1) for r in rows)
    n = {x: sum(r["risk"] == x for r in rows) for x in cfg.RISK_LEVELS}
    assert n == {"Conservative": 3, "Moderate": 1, "Aggressive": 2}


def test_corrected_spread_scores_use_iv_and_break_even(spark):
    base = strategies.bull_call_spread(contracts(spark), indicators(spark), risks=("Moderate",))
    fixed = strategies.bull_call_spread(contracts(spark), indicators(spark), risks=("Moderate",), corrected=True)
    assert one(base)["composite_score"] != one(fixed)["composite_score"]


# --- cleaning and normalising -------------------------------------------------

def test_market_cap_text(spark):
    text = ["$1.5B", "500M", "2,500K", "1.2t", "750", "abc", None, " $3b "]
    df = spark.createDataFrame([(t,) for t in text], "t string")
    assert [r[0] for r in df.select(clean.market_cap_millions("t")).collect()] == [1500.0, 500.0, 2.5, 1.2e6, 750.0, None, None, 3000.0]


def test_find_date(spark):
    df = spark.createDataFrame([("FY 2020-03-31",), ("ended 12/31/2019",), ("31-01-2018 (a)",), ("2017/06/30",), ("none",), ("13/45/2019",)], "t string")
    got = [str(r[0]) for r in df.select(clean.find_date("t")).collect()]
    assert got == ["2020-03-31", "2019-12-31", "2018-01-31", "2017-06-30", "1970-01-01", "1970-01-01"]


def test_fuzzy_labels_agree_with_difflib(spark):
    labels = ["Net Incme", "Totl Revenue", "gross_proft", "Operating Incom", "zzz", "EBIT", "net-income"]
    rows = [("A", "income", DAY, n, i, 1.0) for i, n in enumerate(labels)]
    long = spark.createDataFrame(rows, "ticker string, statement string, period_end date, line_item string, ord int, value double")
    got = {r["line_item"]: r["canonical"] for r in normalize.label_map(long).collect()}
    known = {k: c for s, k, c in normalize.synonym_rows() if s == "income"}
    for n in labels:
        key = normalize.fold_text(n)
        best = [key] if key in known else difflib.get_close_matches(key, known, n=1, cutoff=0.8)
        assert got[n] == (known[best[0]] if best else n)


def test_collision_modes(spark):
    rows = [("A", "income", DAY, "Net Income", 0, None), ("A", "income", DAY, "Net Profit", 1, 5.0), ("A", "income", DAY, "Net Earnings", 2, 7.0)]
    long = spark.createDataFrame(rows, "ticker string, statement string, period_end date, line_item string, ord int, value double")
    assert one(normalize.standardize(long))["value"] == 5.0
    assert one(normalize.standardize(long, mode="sum"))["value"] == 12.0
    wide = one(normalize.to_wide(normalize.standardize(long), ["Net Income", "EPS"], fill=0.0))
    assert (wide["Net Income"], wide["EPS"]) == (5.0, 0.0)


def test_price_cleaning(spark):
    px = spark.createDataFrame(
        [("A", DAY, 1.0, 5), ("A", DAY + dt.timedelta(1), None, None), ("A", DAY + dt.timedelta(2), -3.0, -7)],
        "ticker string, dt date, close double, volume bigint")
    assert [(r["close"], r["volume"]) for r in clean.clean_prices(px).orderBy("dt").collect()] == [(1.0, 5), (1.0, 0), (3.0, 7)]


def test_price_rules_report_missing_columns(spark):
    px = bars(spark, {"A": [1, -2, None]})
    got = {r["code"]: r["n"] for r in quality.price_issues(px).collect()}
    assert got == {"MISSING_VALUES": 1, "NEGATIVE_PRICES": 1, "MISSING_COLUMNS": 3}


# --- sources and sinks ---------------------------------------------------------

def test_sources_fall_back_in_order(spark):
    base = spark.createDataFrame([("A",), ("B",), ("C",)], "ticker string")
    a = spark.createDataFrame([("A", 1.0)], "ticker string, x double")
    b = spark.createDataFrame([("A", 9.0), ("B", 2.0)], "ticker string, x double")
    got = {r["ticker"]: (r["x"], r["source_used"], r["available"]) for r in readers.first_available(base, {"p": a, "s": b}, ["x"]).collect()}
    assert got == {"A": (1.0, "p", True), "B": (2.0, "s", True), "C": (None, "none", False)}
    with pytest.raises(ValueError):
        readers.period_start("soon", DAY)


def test_sorted_sink(spark, tmp_path):
    rows = [(f"1998-0{1 + i % 3}-01", float(100 - i), i) for i in range(100)]
    df = spark.createDataFrame(rows, "expiry string, strike double, volume int").repartition(7)
    sinks.write_csv(df, str(tmp_path / "sorted"), order_by=["expiry", "strike"])
    parts = sorted((tmp_path / "sorted").glob("part-*"))
    lines = [line.split(",") for p in parts for line in p.read_text().splitlines()[1:]]
    assert [(e, float(s)) for e, s, _ in lines] == sorted((e, s) for e, s, _ in rows)


def test_round_trip_through_files(spark, tmp_path):
    df = spark.createDataFrame([("A", DAY, 1.23456789, {"rsi": .5})], "ticker string, expiry date, score double, details map<string,double>")
    sinks.write_csv(df, str(tmp_path / "c"), strategy="Long Calls")
    row = one(readers.read_table(spark, str(tmp_path / "c"), fmt="csv", header="true"))
    assert (row["strategy"], row["expiry"], row["score"]) == ("Long Calls", "2020-01-01", "1.2346")
    sinks.write_json(df, str(tmp_path / "j"))
    assert one(readers.read_table(spark, str(tmp_path / "j"), fmt="json"))["details"]["rsi"] == .5
    sinks.write_parquet(df, str(tmp_path / "p"), partition_by=["ticker"])
    assert readers.read_table(spark, str(tmp_path / "p")).where("ticker = 'A'").count() == 1


def test_price_history_filter_reaches_the_scan(spark, tmp_path):
    bars(spark, {"A": range(1, 800)}).write.parquet(str(tmp_path / "px"))
    df = readers.price_history(readers.read_table(spark, str(tmp_path / "px")), dt.date(2021, 6, 1), "6mo")
    assert df.count() == 182
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(dt), LessThanOrEqual(dt,2021-06-01), GreaterThan(dt,2020-12-01)]" in plan


def test_glossary_and_search(spark):
    s = glossary.strategies(spark)
    bull = {r["key"] for r in filters.keyword_search(s, ["market_outlook"], glossary.OUTLOOK_WORDS["bullish"]).collect()}
    assert {"long_calls", "bull_call_spread", "cash_secured_put"} <= bull and "long_puts" not in bull
    assert filters.keyword_search(glossary.metrics(spark), ["name", "description"], ["MARGIN"]).count() >= 4
    assert glossary.lookup("beta")[1] == "Beta"
    with pytest.raises(KeyError):
        glossary.lookup("nothing")


def test_forecast_confidence_values(spark):
    df = spark.createDataFrame([(10, 5.2, 150.0), (0, 0.0, 0.0), (5, 300.0, 100.0)], "n bigint, s double, m double")
    got = [r[0] for r in df.select(forecast.confidence(F.col("n"), F.col("s"), F.col("m"))).collect()]
    assert got == pytest.approx([.6 + .4 * (1 - 5.2 / 150), 0.0, .3])
    assert forecast.freshness(45) == "Last 1 months" and forecast.freshness(400) == "Last 1 years"


def test_plans_do_not_widen(spark):
    """The strategy plan reads the listing once and never pairs tickers with each other."""
    out = strategies.covered_call(contracts(spark), indicators(spark))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "CartesianProduct" not in plan
    assert scoring.FALLBACK["rsi"] == 50.0


def test_snap_keeps_large_values(spark):
    from quantloom.functions.numeric import snap, steady

    values = [9.3e12, 5e13, 1e15, -6e13, -0.1234565, 12.3456785, None]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", snap("v").alias("s"), steady(F.col("v")).alias("k")).collect()
    for v, s, k in rows:
        assert (v is None and s is None) or abs(s - v) <= max(6e-7, abs(v) * 1e-15)
    assert len({k for v, _, k in rows if v is not None}) == 6


def test_ema_of_span_one_is_the_series(spark):
    from quantloom.operators import series

    df = spark.createDataFrame([("A", d, float(d)) for d in range(5)], "ticker string, dt int, close double")
    assert all(r.e == r.close for r in series.ema(df, {"e": ("close", 1)}).collect())
