"""Rank correlations, correlation matrices of any size and counted upserts of edges."""

import datetime as dt
import itertools
import math
import time

import numpy as np
import pandas as pd
import pytest

from quantloom.functions.inference import normal_pvalue
from quantloom.operators import pairs
from quantloom.sources import sinks

DAY = dt.date(2020, 1, 1)


def slow_kendall(x, y):
    s = n1 = n2 = 0
    for (a, b), (c, d) in itertools.combinations(zip(x, y), 2):
        s += np.sign(c - a) * np.sign(d - b)
        n1 += a == c
        n2 += b == d
    n0 = len(x) * (len(x) - 1) / 2
    scale = (n0 - n1) * (n0 - n2)
    return s / math.sqrt(scale) if scale > 0 else None


@pytest.mark.parametrize("n,values", [(1, 3), (2, 2), (3, 2), (17, 4), (64, 3), (65, 1000), (200, 9), (333, 50)])
def test_kendall_counts_every_pair(n, values):
    rng = np.random.default_rng(n)
    x, y = rng.integers(0, values, n).astype(float), rng.integers(0, values, n).astype(float)
    r, expected = pairs._kendall_of(x, y)[0], slow_kendall(x, y)
    assert r == pytest.approx(expected, abs=1e-12) if expected is not None else r is None
    assert pairs._kendall_of(x, x)[0] in (None, pytest.approx(1.0))


def test_kendall_of_a_long_series_is_fast():
    rng = np.random.default_rng(0)
    x = rng.normal(size=50_000)
    start = time.perf_counter()
    r, z = pairs._kendall_of(x, x + rng.normal(size=50_000))
    assert time.perf_counter() - start < 1 and r == pytest.approx(0.5, abs=0.02) and z > 100


def test_normal_p_is_erfc(spark):
    zs = [0.0, 0.1, -0.5, 1.0, -1.959964, 2.5758, 4.0, 6.0, -9.0]
    got = [r["p"] for r in spark.createDataFrame([(z,) for z in zs], "z double").coalesce(1).select(normal_pvalue("z").alias("p")).collect()]
    assert got == pytest.approx([math.erfc(abs(z) / math.sqrt(2)) for z in zs], rel=2e-7)


def returns(spark, wide):
    rows = [(c, DAY + dt.timedelta(days=int(i)), float(v)) for c in wide for i, v in wide[c].dropna().items()]
    return spark.createDataFrame(rows, "ticker string, dt date, ret double")


@pytest.mark.parametrize("method", ["pearson", "spearman", "kendall"])
def test_matrix_of_a_hundred_members(spark, method):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 1))
    wide = pd.DataFrame(1e6 + base + rng.normal(size=(60, 100)), columns=[f"T{i}" for i in range(100)])
    wide = wide.mask(rng.random(wide.shape) < 0.2)
    wide["FLAT"] = 0.25
    wide = wide.round(1) if method != "pearson" else wide
    members = spark.createDataFrame([(c,) for c in [*wide, "NONE", None, "T3"]], "ticker string")
    rows = pairs.correlation_matrix(returns(spark, wide), members, method, block=17).collect()
    assert len(rows) == 102 * 103 / 2
    expected, seen = wide.corr(method=method if method != "kendall" else lambda a, b: slow_kendall(a, b) or np.nan), wide.notna().astype(int)
    common = seen.T @ seen
    for row in rows:
        assert row["a"] <= row["b"]
        if "NONE" in (row["a"], row["b"]):
            assert (row["r"], row["n"]) == (None, 0)
            continue
        assert row["n"] == common.loc[row["a"], row["b"]]
        if "FLAT" in (row["a"], row["b"]):
            assert row["r"] is None
        elif row["a"] != row["b"]:
            assert row["r"] == pytest.approx(expected.loc[row["a"], row["b"]], abs=1e-9)


def test_spearman_takes_two_sorts(spark):
    frame = spark.createDataFrame([("A", "P", 1.0, 2.0)], "ticker string, peer string, x double, y double")
    plan = pairs.spearman(frame)._jdf.queryExecution().optimizedPlan().toString()
    assert sum(line.strip(" +-:").startswith("Window") for line in plan.splitlines()) == 2


def test_edges_are_merged_and_counted(spark, tmp_path):
    path = str(tmp_path / "edges")
    old = spark.createDataFrame([("A", "X"), ("A", "Y"), ("B", "Y"), ("C", "Z")], "ticker string, peer string")
    new = spark.createDataFrame([("a ", " brk.b"), ("A", "A"), ("A", "b@d"), ("A", "BRK.B"), ("C", "C"), ("D", "X"), ("E", None)], "ticker string, peer string")
    report = {r["ticker"]: tuple(r)[1:] for r in pairs.upsert_report(old, new).collect()}
    # accepted, replaced, malformed, self references, repeated, rejected
    assert report == {"A": (1, 2, 1, 1, 1, 3), "C": (0, 0, 0, 1, 0, 1), "D": (1, 0, 0, 0, 0, 0), "E": (0, 0, 1, 0, 0, 1)}
    sinks.write_edges(old, path, parts=4)
    expected = {("A", "BRK.B"), ("B", "Y"), ("C", "Z"), ("D", "X")}
    table = lambda: {(r["ticker"], r["peer"]) for r in spark.read.parquet(path).collect()}
    assert sinks.merge_edges(spark, path, new, parts=4) == {"accepted": 2, "malformed": 2, "self_references": 2, "replaced": 2, "rejected": 4}
    assert table() == expected
    assert sinks.merge_edges(spark, path, new, parts=4)["replaced"] == 2
    assert table() == expected
