"""Label matching against a full comparison, vendor layouts, and the profiles and reports built on them."""

import datetime as dt
import difflib
import random
import time

import numpy as np
import pandas as pd
import pytest

from quantloom.operators import filters, normalize, valuation
from quantloom.plans import catalog, data_queries, fundamental_queries
from quantloom.sources import readers


def noisy(rng, name):
    chars = list(name)
    for _ in range(rng.randint(0, 5)):
        k = rng.randrange(len(chars) + 1)
        kind = rng.random()
        if kind < 0.4 and chars:
            chars.pop(min(k, len(chars) - 1))
        elif kind < 0.7:
            chars.insert(k, rng.choice("abcdefghij -&x"))
        else:
            rng.shuffle(chars)
    return "".join(chars)


def test_bounds_never_change_a_match():
    rng = random.Random(2)
    known = [k for s, k, _ in normalize.synonym_rows() if s == "balance"]
    labels = [noisy(rng, rng.choice(known)) for _ in range(400)] + ["", "a", "zzzz", "total", known[0] * 20]
    shared = normalize.shared_characters(labels, known)
    for cutoff in (0.6, 0.8):
        for label, row in zip(labels, shared):
            best = difflib.get_close_matches(label, known, n=1, cutoff=cutoff)
            found, ratio = normalize.best_match(label, known, row, cutoff)
            assert found == (best[0] if best else None), label
            assert ratio is None or ratio == difflib.SequenceMatcher(None, best[0], label).ratio()


def test_subsequence_length():
    def slow(a, b):
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        return table[-1, -1]

    rng = random.Random(1)
    for _ in range(100):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 80))) for _ in range(2))
        masks = {c: sum(1 << i for i, x in enumerate(b) if x == c) for c in set(b)}
        assert normalize.common_subsequence(a, masks, len(b)) == slow(a, b)


def test_ten_thousand_labels(spark):
    rng = random.Random(4)
    known = [k for s, k, _ in normalize.synonym_rows() if s == "income"]
    labels = sorted({noisy(rng, rng.choice(known)) for _ in range(10_000)})
    statement, key = pd.Series(["income"] * len(labels)), pd.Series(labels)
    start = time.perf_counter()
    found = normalize.closest(0.6).func(statement, key)
    took = time.perf_counter() - start
    start = time.perf_counter()
    sample = range(0, len(labels), 25)
    canonical = {k: c for s, k, c in normalize.synonym_rows() if s == "income"}
    for i in sample:
        best = difflib.get_close_matches(labels[i], known, n=1, cutoff=0.6)
        assert found["canonical"][i] == (canonical[best[0]] if best else None), labels[i]
    assert took < 25 * (time.perf_counter() - start)  # fewer comparisons than all


def test_vendor_layout_without_a_list_of_periods(spark):
    day = lambda y: dt.date(y, 12, 31)
    rows = [("A", "income", day(1999), "Revenue", 0, 1.0), ("A", "income", day(2044), "Revenue", 0, 2.0), ("B", "income", day(1999), "Revenue", 0, None)]
    long = spark.createDataFrame(rows, "ticker string, statement string, period_end date, line_item string, ord int, value double")
    vendor = normalize.to_vendor_layout(long)
    assert vendor.count() == 2
    back = {tuple(r) for r in normalize.from_vendor_layout(vendor, "income").select("ticker", "period_end", "value").collect()}
    assert back == {(r[0], r[2], r[5]) for r in rows}
    wide = spark.createDataFrame([("A", "Revenue", 1.0, 2.0)], "ticker string, line_item string, `1999-12-31` double, `2000-12-31` double")
    assert {(r["period_end"], r["value"]) for r in normalize.from_vendor_layout(wide, "income").collect()} == {(day(1999), 1.0), (day(2000), 2.0)}


def test_every_test_label_means_its_own_item():
    """The SQL oracle takes the value of an item from its column, so no spelling may fall on another item."""
    for statement, items in data_queries.SHEETS.items():
        known = {k: c for s, k, c in normalize.synonym_rows() if s == statement}
        for canonical in items:
            for label in data_queries.spellings(statement, canonical):
                key = normalize.fold_text(label)
                found = key if key in known else difflib.get_close_matches(key, known, n=1, cutoff=0.8)[0]
                assert known[found] == canonical


def test_large_statement_values_keep_their_size(spark):
    df = spark.createDataFrame([("A", 9.3e17, None)], "ticker string, a double, b double")
    row = readers.statement(df, ["a", "b"], keys=("ticker",)).first()
    assert row["a"] == 9.3e17 and row["b"] == 0.0


def test_unknown_volatility_has_no_level(spark):
    df = spark.createDataFrame([(0.1,), (0.5,), (None,)], "v double")
    assert [r[0] for r in df.select(valuation.volatility_level(df["v"])).collect()] == ["Low", "Very High", None]


def test_all_companies_get_a_thesis_and_a_risk_score(spark):
    data = "/root/testdata/sf0.001"
    n = fundamental_queries.companies(spark, data).count()
    for name in ("investment_thesis", "risk_score"):
        assert catalog.queries()[name](spark, data).count() == n


def test_merged_parameters_are_those_written_out():
    assert {k: tuple(v.values()) for k, v in data_queries.merged_limits().items()} == data_queries.MERGED_SQL


def test_nested_lookup(spark):
    df = spark.createDataFrame([({"w": {"rsi": 0.5}},), ({},), (None,)], "m map<string, map<string, double>>")
    got = [tuple(r) for r in df.select(filters.nested(df["m"], ["w", "rsi"]), filters.nested(df["m"], ["w", "x"], -1.0), filters.nested(df["m"], ["y", "rsi"], 7.0)).collect()]
    assert got == [(0.5, -1.0, 7.0), (0.0, -1.0, 7.0), (0.0, -1.0, 7.0)]


@pytest.mark.parametrize("name", ["first_column"])
def test_first_column(spark, name):
    df = spark.createDataFrame([(1.0, 2.0)], "final_score double, score double")
    assert df.select(filters.first_column(df, ["total_score", "final_score", "score"]), filters.first_column(df, ["x"], 9.0)).first()[:] == (1.0, 9.0)
