"""Correlation matrices from packed returns."""

import datetime as dt

import numpy as np
import pyarrow as pa
import pytest

from quantloom.operators import pairs
from quantloom.sources import shared

DAY = dt.date(2020, 1, 1)


def some_returns(members, days, share=0.7, seed=3):
    rng = np.random.default_rng(seed)
    grid = rng.normal(size=(members, days)) + rng.normal(size=days)
    return np.where(rng.random(grid.shape) < share, grid, np.nan)


def frame(spark, grid):
    rows = [(f"T{i}", DAY + dt.timedelta(days=d), float(v)) for i, line in enumerate(grid) for d, v in enumerate(line) if not np.isnan(v)]
    return spark.createDataFrame(rows, "ticker string, dt date, ret double")


def packed(spark):
    at = spark._jvm.org.apache.hadoop.fs.Path(shared.shared_dir(spark))
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    return {f.getPath().toString() for f in found if f.getPath().getName().startswith("quantloom-returns")}


def test_matrix_of_many_blocks_moves_each_return_once(spark):
    grid = some_returns(60, 20)
    before = packed(spark)
    matrix = pairs.correlation_matrix(frame(spark, grid), spark.createDataFrame([(f"T{i}",) for i in range(60)], "ticker string"), block=2)
    assert matrix.count() == 60 * 61 / 2
    # a row of returns used to go to every pair of blocks
    plan = matrix._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "FlatMapGroups" not in plan
    (path,) = packed(spark) - before
    pieces = spark.read.parquet(path).collect()
    assert len(pieces) > 10 and sorted(n for x in pieces for n in x["names"]) == sorted(f"T{i}" for i in range(60))
    assert sum(len(x["ret"]) for x in pieces) == 8 * np.count_nonzero(~np.isnan(grid))


@pytest.mark.parametrize("block,days", [(3, 4), (500, 4), (7, 10**6)])
def test_blocks_and_portions_of_days_change_nothing(monkeypatch, tmp_path, block, days):
    monkeypatch.setattr(pairs, "DAYS", days)
    monkeypatch.setattr(pairs, "CELLS", 10)
    grid = some_returns(20, 30)
    grid[4], grid[5, 3:] = 0.1, np.nan
    cells = [(f"T{i:02}", d, v) for i, line in enumerate(grid) for d, v in enumerate(line) if not np.isnan(v)] + [("T99", None, None)]
    table = pa.table(dict(zip(("ticker", "day", "ret"), map(list, zip(*cells)))), pa.schema([("ticker", pa.string()), ("day", pa.int32()), ("ret", pa.float64())]))
    files = []
    for k, piece in enumerate(pairs._packed(table.to_batches(max_chunksize=11), block)):
        files.append((f"file://{tmp_path}/{k}.parquet", piece.column(4)[0].as_py()))
        pairs.pq.write_table(pa.Table.from_batches([piece]), f"{tmp_path}/{k}.parquet")
    assert sum(n for _, n in files) == 21 and (len(files) > 1 or block == 500)
    blocks = pairs._blocks(files, block)
    rows = [{"low": i, "files": a, "high": j, "others": b} for i, a in enumerate(blocks) for j, b in enumerate(blocks) if i <= j]
    got = {(x["a"], x["b"]): (x["r"], x["n"]) for batch in pairs._compared([pa.RecordBatch.from_pylist(rows)]) for x in batch.to_pylist()}
    assert len(got) == 21 * 22 / 2
    for i in range(20):
        assert got[(f"T{i:02}", "T99")] == (None, 0)
        for j in range(i, 20):
            both = ~np.isnan(grid[i]) & ~np.isnan(grid[j])
            r, n = got[(f"T{i:02}", f"T{j:02}")]
            assert n == both.sum()
            if 4 in (i, j):
                assert r is None
            elif n > 2:
                assert r == pytest.approx(np.corrcoef(grid[i, both], grid[j, both])[0, 1], abs=1e-9)


def test_no_members_make_no_rows(spark):
    nobody = spark.createDataFrame([(None,)], "ticker string")
    assert pairs.correlation_matrix(frame(spark, some_returns(2, 5)), nobody).collect() == []
