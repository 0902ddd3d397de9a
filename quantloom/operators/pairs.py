"""Joins between series and the pairwise statistics on top of them.

Pairs always come from an edge table (ticker, peer) with a bounded number of
peers per ticker; nothing here forms all pairs of the universe.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quantloom.functions.inference import correlation_pvalue, normal_pvalue, strength_class
from quantloom.operators.series import with_returns
from quantloom.sources.shared import new_path, opened, release

PAIR = ["ticker", "peer"]


def clean_edges(edges: DataFrame) -> DataFrame:
    """Upper-cased, trimmed, well-formed, distinct edges without self references."""
    p = F.upper(F.trim("peer"))
    return (
        edges.select(F.upper(F.trim("ticker")).alias("ticker"), p.alias("peer"))
        .where(valid_peer_symbol(F.col("peer")) & (F.col("peer") != F.col("ticker")))
        .distinct()
    )


def valid_peer_symbol(c: Column) -> Column:
    """Alphanumeric once dots and dashes are removed."""
    return c.rlike(r"^[A-Za-z0-9.\-]*[A-Za-z0-9][A-Za-z0-9.\-]*$")


def with_market(ret: DataFrame, market_ret: DataFrame, ts: str = "dt") -> DataFrame:
    """Date-aligned asset and market returns; the market has one row per calendar day."""
    m = market_ret.select(ts, F.col("ret").alias("mkt"))
    return ret.join(F.broadcast(m), ts)


def market_returns(index: DataFrame, ts: str = "dt") -> DataFrame:
    return with_returns(index.withColumn("ticker", F.lit("MKT")), ts=ts).select(ts, "ret")


def beta(aligned: DataFrame, min_rows: int = 20, key: str = "ticker") -> DataFrame:
    """cov(asset, market) / var(market); NULL under ``min_rows`` common days or with a flat market."""
    b = F.covar_samp("ret", "mkt") / F.nullif(F.var_samp("mkt"), F.lit(0.0))
    return aligned.groupBy(key).agg(b.alias("_b"), F.count("*").alias("n_common")).select(
        key, F.when(F.col("n_common") >= min_rows, F.col("_b")).alias("beta"), "n_common"
    )


def peer_prices(px: DataFrame, edges: DataFrame) -> DataFrame:
    """Bars of those tickers only that are somebody's peer."""
    return px.join(edges.select(F.col("peer").alias("ticker")).distinct(), "ticker", "left_semi")


def paired_returns(ret: DataFrame, edges: DataFrame, peer_ret: DataFrame | None = None, ts: str = "dt") -> DataFrame:
    """(ticker, peer, dt, x, y): both returns on every common day of every edge.

    Returns arrive partitioned by ticker, so the edges (a bounded list per
    ticker, hence a safe hash-join build side) are brought to them and everything
    grouped by (ticker, peer) afterwards needs no further shuffle.  Only tickers
    that are somebody's peer enter the other side; AQE broadcasts that side when
    it is small and otherwise joins on (peer, day), which spreads even a peer that
    a third of the universe points to over all its days.  ``peer_ret`` are the
    peers' returns where they were computed from ``peer_prices`` alone.
    """
    x = ret.select("ticker", ts, F.col("ret").alias("x"))
    y = peer_prices(ret, edges) if peer_ret is None else peer_ret
    y = y.select(F.col("ticker").alias("peer"), ts, F.col("ret").alias("y"))
    return x.join(edges.hint("shuffle_hash"), "ticker").join(y, ["peer", ts])


def pearson(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(*PAIR).agg(F.corr("x", "y").alias("r"), F.count("*").alias("n"))


def _average_rank(value: str, w_part: list[str]) -> Column:
    """Ties share the mean of their ranks; rank and number of ties come from one sort."""
    order = W.partitionBy(*w_part).orderBy(value)
    return F.rank().over(order) + (F.count("*").over(order.rangeBetween(W.currentRow, W.currentRow)) - 1) / 2.0


def spearman(pairs: DataFrame) -> DataFrame:
    """Pearson correlation of average ranks, ranked within each pair's common days."""
    ranked = pairs.withColumns({"rx": _average_rank("x", PAIR), "ry": _average_rank("y", PAIR)})
    return ranked.groupBy(*PAIR).agg(F.corr("rx", "ry").alias("r"), F.count("*").alias("n"))


def _tie_sums(values: np.ndarray) -> tuple[float, float, float]:
    """Over tie groups of size t: sum of t(t-1)/2, t(t-1)(t-2) and t(t-1)(2t+5)."""
    t = np.unique(values, return_counts=True)[1].astype("float64")
    return float((t * (t - 1) / 2).sum()), float((t * (t - 1) * (t - 2)).sum()), float((t * (t - 1) * (2 * t + 5)).sum())


def _discordant(x: np.ndarray, y: np.ndarray) -> int:
    """Pairs that x and y order in opposite ways: the inversions of y in the order of (x, y), counted while halves are merged."""
    order = np.lexsort((y, x))
    y = np.unique(y[order], return_inverse=True)[1].reshape(-1).astype(np.int64)
    n, at, total, width = len(y), np.arange(len(y)), 0, 1
    while width < n:
        block = at // (2 * width)
        second = (at // width) % 2 == 1
        # both halves are in order, so the stable sort merges them; of equal values the first half's come first
        place = np.argsort(block * n + y, kind="stable")
        passed = np.concatenate(([0], np.cumsum(second[place])))
        smaller = passed[:-1] - passed[block * 2 * width]
        total += int(smaller[~second[place]].sum())
        y, width = y[place], 2 * width
    return total


def _kendall_of(x: np.ndarray, y: np.ndarray) -> tuple[float | None, float | None]:
    """Tau-b and its normal score in O(n log n)."""
    n = float(len(x))
    (n1, x2, x3), (n2, y2, y3) = _tie_sums(x), _tie_sums(y)
    both = np.unique(np.stack([x, y]), axis=1, return_counts=True)[1].astype("float64")
    m = n * (n - 1)
    s = m / 2 - n1 - n2 + float((both * (both - 1) / 2).sum()) - 2.0 * _discordant(x, y)
    scale = (m / 2 - n1) * (m / 2 - n2)
    var = (m * (2 * n + 5) - x3 - y3) / 18
    if n > 2:
        var += 2 * n1 * n2 / m + x2 * y2 / (9 * m * (n - 2))
    return (s / scale**0.5 if scale > 0 else None), (s / var**0.5 if var > 0 else None)


@F.pandas_udf(StructType([StructField("r", DoubleType()), StructField("z", DoubleType())]))
def _kendall_udf(x: pd.Series, y: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_kendall_of(a, b) for a, b in zip(x, y)], columns=["r", "z"])


def kendall(pairs: DataFrame) -> DataFrame:
    """Kendall tau-b and its normal score per pair.

    A pair's common days are one row per calendar day at most, so they fit an
    array; numpy counts their inversions inside the task that already holds the
    ticker.  No self join, no shuffle.
    """
    # (x, y) has no NULLs, so both lists see the same rows in the same order
    days = pairs.groupBy(*PAIR).agg(F.collect_list("x").alias("xs"), F.collect_list("y").alias("ys"))
    return days.withColumn("k", _kendall_udf("xs", "ys")).select(
        *PAIR, "k.r", F.size("xs").cast("bigint").alias("n"), "k.z"
    )


METHODS = {"pearson": pearson, "spearman": spearman, "kendall": kendall}


def peer_correlations(ret: DataFrame, edges: DataFrame, method: str = "pearson", min_periods: int = 30,
                      peer_ret: DataFrame | None = None) -> DataFrame:
    """One row per edge: r, p, n, significance and strength.

    Edges with too few common days (or none) are kept with r=0, p=1, n=0.
    An undefined r (a constant series) becomes r=0, p=1 but keeps its n.
    """
    stats = METHODS[method](paired_returns(ret, edges, peer_ret))
    stats = stats.where(F.col("n") >= min_periods)
    p = normal_pvalue(F.col("z")) if method == "kendall" else correlation_pvalue(F.col("r"), F.col("n"))
    known = F.col("r").isNotNull() & ~F.isnan("r")
    stats = stats.select(
        *PAIR,
        F.when(known, F.col("r")).otherwise(0.0).alias("r"),
        F.when(known, p).otherwise(1.0).alias("p_value"),
        "n",
    )
    return (
        edges.join(stats, PAIR, "left")
        .select(
            *PAIR,
            F.coalesce("r", F.lit(0.0)).alias("r"),
            F.coalesce("p_value", F.lit(1.0)).alias("p_value"),
            F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
        )
        .withColumns(
            {"significant": F.col("p_value") < 0.05, "strength": strength_class(F.col("r"))}
        )
    )


def rolling_correlation(pairs: DataFrame, window: int = 30, min_periods: int | None = None, ts: str = "dt") -> DataFrame:
    """Rolling r per pair; nothing for pairs with fewer than ``window`` common days."""
    need = max(10, window // 2) if min_periods is None else min_periods
    f = W.partitionBy(*PAIR).orderBy(ts).rowsBetween(-(window - 1), 0)
    r = F.when(F.count("*").over(f) >= need, F.corr("x", "y").over(f))
    return (
        pairs.select(*PAIR, ts, r.alias("r"), F.count("*").over(W.partitionBy(*PAIR)).alias("_n"))
        .where((F.col("_n") >= window) & F.col("r").isNotNull() & ~F.isnan("r"))
        .drop("_n")
    )


def regime_changes(rolling: DataFrame, window: int = 20, threshold: float = 0.3, ts: str = "dt") -> DataFrame:
    """Days where the smoothed correlation shifts by at least ``threshold``.

    The series is smoothed by a centred mean (even windows lean one back), then
    the mean of the ``window`` rows before is compared with the ``window`` from here on.
    """
    w = W.partitionBy(*PAIR).orderBy(ts)
    half = window // 2
    centred = w.rowsBetween(-half, window - half - 1)
    s = rolling.select(
        *PAIR, ts,
        F.when(F.count("r").over(centred) == window, F.avg("r").over(centred)).alias("s"),
        (F.row_number().over(w) - 1).alias("i"),
        F.count("*").over(W.partitionBy(*PAIR)).alias("n"),
    )
    return (
        s.withColumns(
            {
                "before": F.avg("s").over(w.rowsBetween(-window, -1)),
                "after": F.avg("s").over(w.rowsBetween(0, window - 1)),
            }
        )
        .where(
            (F.col("n") >= 2 * window) & (F.col("i") >= window) & (F.col("i") < F.col("n") - window)
            & (F.abs(F.col("after") - F.col("before")) >= threshold)
        )
        .select(*PAIR, ts, "before", "after", (F.col("after") - F.col("before")).alias("shift"))
    )


#: Members of a block of the correlation matrix for products and for ranks, and days that products are summed over at once.
BLOCK, RANK_BLOCK, DAYS = 512, 16, 3072
#: Rows of one batch of results.
CELLS = 1 << 17


def _grid(table: pa.Table) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Names in order, each name's block, and the days x names matrix of a task's returns (NaN where there is none)."""
    names, code = np.unique(np.asarray(table.column("ticker").to_pylist(), dtype=object), return_inverse=True)
    block = np.zeros(len(names), np.int64)
    block[code] = table.column("block").to_numpy()
    day, ret = table.column("day").to_numpy(), table.column("ret").to_numpy().astype("float64")
    seen = ~np.isnan(day)
    days, row = np.unique(day[seen], return_inverse=True)
    grid = np.full((len(days), len(names)), np.nan)
    grid[row, code[seen]] = ret[seen]
    return names.tolist(), block, grid


def _wanted(key: tuple, names: list[str], block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs a <= b of a task: one member of either block."""
    i, j = np.triu_indices(len(names))
    low, high = key[0].as_py(), key[1].as_py()
    keep = (np.minimum(block[i], block[j]) == low) & (np.maximum(block[i], block[j]) == high)
    return i[keep], j[keep]


def _centred(ret: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Returns relative to their member's mean; exactly zero where a member has one value only."""
    size = size[size > 0]
    if not len(size):
        return ret
    start = np.cumsum(size) - size
    least, most, mean = np.minimum.reduceat(ret, start), np.maximum.reduceat(ret, start), np.add.reduceat(ret, start) / size
    return ret - np.repeat(np.where(least == most, least, mean), size)


PIECE = "names array<string>, size binary, day binary, ret binary, members int"


def _packed(batches, block: int):
    """Returns sorted by member as pieces of about `block` members: names, rows of each, and all their days and returns."""
    names: list[str] = []
    sizes: list[int] = []
    days: list[np.ndarray] = []  # of each member one or more parts
    rets: list[np.ndarray] = []
    owner: list[int] = []  # the member of each part, counted from the first that is kept

    def piece(count: int) -> pa.RecordBatch:
        parts = next((k for k, o in enumerate(owner) if o >= count), len(owner))
        size = np.array(sizes[:count], np.int32)
        day, ret = (np.concatenate([kind(0), *held[:parts]]) for kind, held in ((lambda n: np.empty(n, np.int32), days), (np.empty, rets)))
        values = [names[:count], size.tobytes(), day.tobytes(), _centred(ret, size).tobytes(), count]
        del names[:count], sizes[:count], days[:parts], rets[:parts]
        owner[:] = [o - count for o in owner[parts:]]
        types = (pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=["names", "size", "day", "ret", "members"])

    for batch in batches:
        if not batch.num_rows:
            continue
        coded = batch.column(0).dictionary_encode()
        code, known = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(code)) + 1, [len(code)]))
        seen = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
        day, ret = batch.column(1).fill_null(0).to_numpy(), batch.column(2).fill_null(0.0).to_numpy()
        for i, j in zip(cuts[:-1], cuts[1:]):
            if not names or names[-1] != known[code[i]]:
                names.append(known[code[i]])
                sizes.append(0)
            here = seen[i:j]
            sizes[-1] += int(here.sum())
            days.append(day[i:j][here].astype(np.int32))
            rets.append(ret[i:j][here])
            owner.append(len(names) - 1)
        while len(names) > 2.5 * block:
            yield piece(block)
    for left in range(max(1, round(len(names) / block)), 0, -1):
        if names:
            yield piece(-(-len(names) // left))


class _Block:
    """Members of some pieces: their names and returns."""

    def __init__(self, files: list[str]):
        pieces = [row for f in files for row in pq.read_table(opened(f), columns=["names", "size", "day", "ret"]).to_pylist()]
        self.names = [n for x in pieces for n in x["names"]]
        size, self.day, self.ret = (np.concatenate([np.frombuffer(x[c], kind) for x in pieces]) for c, kind in (("size", np.int32), ("day", np.int32), ("ret", np.float64)))
        self.row = np.repeat(np.arange(len(size), dtype=np.int32), size)
        known = ~np.isnan(self.ret)
        if not known.all():
            self.row, self.day, self.ret = self.row[known], self.day[known], self.ret[known]
        self.days = np.unique(self.day)
        self.kept: tuple[np.ndarray, np.ndarray] | None = None

    def dense(self, days: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Members x days: returns, zero where there is none, and which there are."""
        at = np.full(int(days[-1]) - int(days[0]) + 1, -1, np.int32)
        at[days - days[0]] = np.arange(len(days), dtype=np.int32)
        near = (self.day >= days[0]) & (self.day <= days[-1])
        column, row, ret = at[self.day[near] - days[0]], self.row[near], self.ret[near]
        x, m = np.zeros((len(self.names), len(days))), np.zeros((len(self.names), len(days)), bool)
        listed = column >= 0
        place = row[listed].astype(np.int64) * len(days) + column[listed]
        x.reshape(-1)[place], m.reshape(-1)[place] = ret[listed], True
        return x, m

    def on(self, days: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """`dense` over this block's own days, kept if they come at once."""
        if len(days) < len(self.days):
            return self.dense(days)
        self.kept = self.kept or self.dense(days)
        return self.kept


def _moments(low: _Block, high: _Block) -> tuple[np.ndarray, np.ndarray]:
    """Number of common days, and r, of each member of one block with each of the other; sums over common days are matrix products."""
    shape = (len(low.names), len(high.names))
    n, sx, sy, sxx, syy, sxy = (np.zeros(shape) for _ in range(6))
    for k in range(0, len(low.days), DAYS):
        days = low.days[k : k + DAYS]
        (x, p), (y, q) = low.on(days), high.dense(days)
        n += p.astype(np.float32) @ q.astype(np.float32).T  # whole numbers, exact up to 2^24 days
        sxy += x @ y.T
        p, q = p.astype(np.float64), q.astype(np.float64)
        sx += x @ q.T
        sxx += (x * x) @ q.T
        sy += p @ y.T
        syy += p @ (y * y).T
    with np.errstate(invalid="ignore", divide="ignore"):
        spread = np.sqrt((n * sxx - sx * sx) * (n * syy - sy * sy))
        r = (n * sxy - sx * sy) / spread
    return n.astype(np.int64), np.ma.masked_array(r, (n <= 1) | (spread == 0))


def _compared(batches):
    """Cells (a, b, r, n) of pairs of blocks; a block is read once for all pairs in a row that it is the first of."""
    last: tuple[list[str], _Block] | None = None
    for batch in batches:
        for pair in batch.to_pylist():
            files = pair["files"]
            low = last[1] if last and last[0] == files else _Block(files)
            last = (files, low)
            high = low if pair["low"] == pair["high"] else _Block(pair["others"])
            n, r = _moments(low, high)
            width = len(high.names)
            names = low.names + ([] if high is low else high.names)
            rank = np.unique(np.asarray(names, dtype=object), return_inverse=True)[1].astype(np.int32)
            text, mine, theirs = pa.array(names, pa.string()), np.arange(len(low.names), dtype=np.int32), np.arange(len(names) - width, len(names), dtype=np.int32)
            step = max(1, CELLS // max(1, width))
            for k in range(0, len(mine), step):
                i, j = np.repeat(mine[k : k + step], width), np.tile(theirs, len(mine[k : k + step]))
                one, value, out = n[k : k + step].reshape(-1), r[k : k + step].reshape(-1), rank[i] <= rank[j]
                a, b, missing = np.where(out, i, j), np.where(out, j, i), np.ma.getmaskarray(value)
                if high is low:  # each pair once
                    once = i <= j
                    a, b, one, value, missing = a[once], b[once], one[once], value[once], missing[once]
                yield pa.RecordBatch.from_arrays(
                    [text.take(pa.array(a)), text.take(pa.array(b)), pa.array(np.ma.getdata(value), mask=missing), pa.array(one)], names=["a", "b", "r", "n"])


def _blocks(pieces: list[tuple[str, int]], block: int) -> list[list[str]]:
    """Files of pieces put together up to one and a half blocks of members."""
    out: list[list[str]] = []
    held = 0
    for file, members in sorted(pieces):
        if not out or held + members > 1.5 * block:
            out.append([])
            held = 0
        out[-1].append(file)
        held += members
    return out


def _product_correlations(names: DataFrame, known: DataFrame, block: int) -> DataFrame:
    """Pearson's r of all members: (a, b, r, n) with a <= b.

    Returns are packed into pieces, a file each in the shared folder, where they stay for the tasks, which read two blocks of
    pieces each and multiply their matrices.  So returns are written once however many members there are, and only the
    results grow with the square.
    """
    spark = known.sparkSession
    release(spark)  # the bars may have been stored just now
    path = new_path(spark, "quantloom-returns")
    rows = names.join(known, "ticker", "left").select("ticker", "day", "ret").sortWithinPartitions("ticker")
    pieces = rows.mapInArrow(lambda batches: _packed(batches, block), PIECE)
    pieces.write.option("maxRecordsPerFile", 1).option("compression", "zstd").parquet(path)
    files = spark.read.schema(PIECE).parquet(path).select("_metadata.file_path", "members").collect()
    blocks = [(i, f) for i, f in enumerate(_blocks([tuple(f) for f in files], block))]
    if not blocks:
        return spark.createDataFrame([], "a string, b string, r double, n long")
    low = spark.createDataFrame(blocks, "low int, files array<string>")
    high = low.select(F.col("low").alias("high"), F.col("files").alias("others"))
    count = len(blocks) * (len(blocks) + 1) // 2
    pairs = low.join(F.broadcast(high), F.col("low") <= F.col("high"))  # file names
    dealt = pairs.repartitionByRange(min(count, max(256, count // 16)), "low", "high").sortWithinPartitions("low", "high")
    return dealt.mapInArrow(_compared, "a string, b string, r double, n long")


def _ranks(x: np.ndarray) -> np.ndarray:
    """Average ranks."""
    _, code, count = np.unique(x, return_inverse=True, return_counts=True)
    last = np.cumsum(count)
    return (last - (count - 1) / 2.0)[code.reshape(-1)]


def _rank_correlation(method: str, x: np.ndarray, y: np.ndarray) -> float | None:
    if len(x) < 2:
        return None
    if method == "kendall":
        return _kendall_of(x, y)[0]
    x, y = _ranks(x), _ranks(y)
    x, y = x - x.mean(), y - y.mean()
    spread = float((x * x).sum() * (y * y).sum()) ** 0.5
    return float((x * y).sum()) / spread if spread > 0 else None


def correlation_matrix(ret: DataFrame, members: DataFrame, method: str = "pearson", ts: str = "dt", block: int | None = None) -> DataFrame:
    """Pairwise-complete correlations of all members with each other: (a, b, r, n) with a <= b, for any number of members.

    Members are dealt into blocks, and a task compares two blocks.  Pearson's moments are matrix products over packed returns
    in the shared folder, which are written by this call; returns are taken relative to their member's mean, which keeps the
    sums accurate.  Rank correlations need all common days of a pair in order; there a row of returns goes to every pair of
    blocks that its member's is in.  Members without returns keep their rows, with n = 0 and a NULL r.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; choose from {tuple(METHODS)}")
    names = members.select("ticker").where(F.col("ticker").isNotNull()).distinct()
    known = ret.where(F.col("ret").isNotNull()).select("ticker", F.unix_date(ts).alias("day"), F.col("ret").cast("double").alias("ret"))
    if method == "pearson":
        return _product_correlations(names, known.where(F.col("day").isNotNull()), block or BLOCK)
    blocks = names.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / (block or RANK_BLOCK))).cast("int").alias("blocks"))
    # one row; the number of blocks is a column, so nothing comes to the driver
    names = names.crossJoin(F.broadcast(blocks)).withColumn("block", F.pmod(F.xxhash64("ticker"), F.col("blocks")).cast("long"))
    same = F.min("ret") == F.max("ret")
    centre = known.groupBy("ticker").agg(F.when(same, F.min("ret")).otherwise(F.avg("ret")).alias("centre"))
    rows = names.join(known, "ticker").join(centre, "ticker").select("ticker", "block", "blocks", F.col("day").cast("double").alias("day"), (F.col("ret") - F.col("centre")).alias("ret"))
    nothing = F.lit(None).cast("double")
    rows = rows.unionByName(names.select("ticker", "block", "blocks", nothing.alias("day"), nothing.alias("ret")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - F.lit(1).cast("long")))
    rows = rows.select("ticker", "block", "day", "ret", other.alias("other"))
    group = [F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")]

    def whole(key: tuple, table: pa.Table) -> pa.Table:
        found, of, x = _grid(table)
        out = []
        for i, j in zip(*_wanted(key, found, of)):
            both = ~(np.isnan(x[:, i]) | np.isnan(x[:, j]))
            out.append((found[i], found[j], _rank_correlation(method, x[both, i], x[both, j]), int(both.sum())))
        return pa.Table.from_pylist([dict(zip(("a", "b", "r", "n"), o)) for o in out], pa.schema([("a", pa.string()), ("b", pa.string()), ("r", pa.float64()), ("n", pa.int64())]))

    return rows.groupBy(*group).applyInArrow(whole, "a string, b string, r double, n long")


def strongest_peer(correlations: DataFrame) -> DataFrame:
    """The peer with the largest absolute r (ties: smallest name), or N/A."""
    w = W.partitionBy("ticker").orderBy(F.desc(F.abs("r")), "peer")
    return correlations.withColumn("_k", F.row_number().over(w)).where("_k = 1").select(
        "ticker", F.col("peer").alias("strongest_peer"), F.abs("r").alias("strongest_abs_r")
    )


def peer_info(edges: DataFrame, info: DataFrame) -> DataFrame:
    """Peers with name, sector and industry; a peer without an entry is kept with NULLs."""
    return edges.join(info.withColumnRenamed("ticker", "peer"), "peer", "left").withColumn(
        "found", F.col("name").isNotNull()
    )


def judged_edges(incoming: DataFrame) -> DataFrame:
    """Each incoming edge cleaned, with why it is rejected (NULL if it is not): a name that is none, a self reference, a repeat."""
    t, p = F.upper(F.trim("ticker")), F.upper(F.trim("peer"))
    counted = incoming.select(t.alias("ticker"), p.alias("peer")).groupBy("ticker", "peer").agg(F.count("*").alias("copies"))
    valid = F.coalesce(valid_peer_symbol(F.col("ticker")) & valid_peer_symbol(F.col("peer")), F.lit(False))
    reason = F.when(~valid, "malformed").when(F.col("peer") == F.col("ticker"), "self")
    return counted.withColumn("reason", reason)


def upsert_edges(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Replace the peer lists of every ticker that has valid incoming edges; keep the others."""
    new = judged_edges(incoming).where("reason IS NULL").select("ticker", "peer")
    kept = current.join(new.select("ticker").distinct(), "ticker", "left_anti")
    return kept.select("ticker", "peer").unionByName(new)


def upsert_report(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Per incoming ticker: edges accepted, earlier ones replaced (none if all new ones are rejected), and rejected by reason."""
    judged = judged_edges(incoming)
    good = F.col("reason").isNull()
    new = judged.groupBy("ticker").agg(
        F.count_if(good).alias("accepted"),
        F.coalesce(F.sum(F.when(F.col("reason") == "malformed", F.col("copies"))), F.lit(0)).alias("malformed"),
        F.coalesce(F.sum(F.when(F.col("reason") == "self", F.col("copies"))), F.lit(0)).alias("self_references"),
        F.coalesce(F.sum(F.when(good, F.col("copies") - 1)), F.lit(0)).alias("repeated"),
    )
    old = current.groupBy("ticker").agg(F.count("*").alias("earlier"))
    return new.join(old, "ticker", "left").select(
        "ticker", "accepted", F.when(F.col("accepted") > 0, F.coalesce("earlier", F.lit(0))).otherwise(0).alias("replaced"),
        "malformed", "self_references", "repeated", (F.col("malformed") + F.col("self_references") + F.col("repeated")).alias("rejected"),
    )
