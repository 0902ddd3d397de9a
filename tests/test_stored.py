"""Tables that outlive a query: bucketed bars, the index of character triples, and the shared folder."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quantloom.operators import series, textindex
from quantloom.plans import catalog
from quantloom.sources import bars, bindings, shared

DATA = "/root/testdata/sf0.001"


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_stored_bars_are_the_bars(spark):
    direct, stored = (sorted(map(tuple, f(spark, DATA).collect())) for f in (bindings.prices, bars.daily))
    assert direct == stored and direct
    day = direct[len(direct) // 2][1]
    assert sorted(map(tuple, bars.daily(spark, DATA, start=day, end=day).collect())) == [r for r in direct if r[1] == day]
    assert bars.daily(spark, DATA)._jdf.queryExecution().analyzed().toString() == bars.daily(spark, DATA)._jdf.queryExecution().analyzed().toString()


def test_windows_by_ticker_need_no_exchange(spark):
    plan = executed(series.macd(bars.daily(spark, DATA)))
    assert "Window" in plan and "Exchange" not in plan


def test_long_calls_scan_the_trades_once(spark):
    catalog.queries()["long_calls"](spark, DATA)  # writes the bars if no other test did
    plan = catalog.queries()["long_calls"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_shipdate") > 0 and len(set(re.findall(r"l_shipdate#\d+", plan))) == 1


def test_spot_of_the_bars_is_the_last_trade(spark):
    of_bars, of_trades = ({r["ticker"]: r["spot"] for r in f.collect()} for f in (bindings.spot(bars.daily(spark, DATA)), bindings.raw_spot(spark, DATA)))
    assert of_bars == of_trades and of_bars


def test_changed_files_make_another_version(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    first = shared.version(spark, path)
    assert shared.version(spark, path) == first
    spark.range(4).write.mode("append").parquet(path)
    assert shared.version(spark, path) != first


def test_shared_dir_is_named_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(ValueError):
        shared.shared_dir(Session)
    monkeypatch.setattr(Context, "master", "local[2]")
    assert shared.shared_dir(Session) == shared.shared_dir(Session)
    monkeypatch.setattr(Session.conf, "get", staticmethod(lambda key, default: "/shared/"))
    assert shared.shared_dir(Session) == "/shared"


def test_search_equals_contains(spark):
    rng = random.Random(3)
    rows = [(i, *["".join(rng.choice("abAB é.\n😀") for _ in range(rng.randint(0, 30))) if rng.random() < 0.9 else None for _ in range(2)]) for i in range(300)]
    df = spark.createDataFrame(rows, "key long, one string, two string")
    words = {"ab": ["ab"], "several": ["abab", "É.", "b a"], "single": ["é"], "run": ["aaa", "bbbb"], "pair of units": ["😀"], "long": ["a😀b"], "line": ["\n"], "none": ["zzz"]}
    index = textindex.postings(df, "key", ["one", "two"])
    for columns in (["one"], ["one", "two"]):
        found = {tuple(r) for r in textindex.search(index, words, columns).collect()}
        hits = {(s, r[0]) for s, listed in words.items() for r in rows for w in listed for c, t in zip(("one", "two"), r[1:]) if c in columns and t and w.lower() in t.lower()}
        assert found == hits


def test_search_reads_its_own_triples(spark):
    index = textindex.store(spark.createDataFrame([(1, "some text")], "key long, one string"), "key", ["one"], "test_triples")
    plan = textindex.search(index, {"s": ["text"]}, ["one"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*In\(triple, \[ext,tex\]\)", plan)
    assert textindex.store(index.where(F.lit(False)), "key", [], "test_triples").count() == index.count()
