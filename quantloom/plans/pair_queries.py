"""Beta, correlations and correlation dynamics."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions.inference import ERFC_FIT
from quantloom.operators import pairs as p
from quantloom.operators import series as s
from quantloom.plans.common import Catalog, show
from quantloom.plans.oracle import r, rcols, register, sql
from quantloom.sources import bars
from quantloom.sources import bindings as b

CAT = Catalog()
D = "CAST(dt AS VARCHAR) AS dt"

register("pairs", ("ret", "peers"), """
SELECT e.ticker, e.peer, x.dt, x.ret AS x, y.ret AS y
FROM peers e JOIN ret x ON x.ticker = e.ticker JOIN ret y ON y.ticker = e.peer AND y.dt = x.dt""")

# p of Student's t with integer df by its finite series (df = n - 2); the
# product of ratios is taken as exp of a running sum of logs.
PVALUE = """
SELECT s.ticker, s.peer, s.r, s.n, 1 - CASE WHEN (s.n - 2) % 2 = 1
    THEN 2 / pi() * (asin(abs(s.r)) + abs(s.r) * sqrt(1 - s.r * s.r) * coalesce(t.total, 1))
    ELSE abs(s.r) * coalesce(t.total, 1) END AS p_value
FROM {stat} s LEFT JOIN (
  SELECT ticker, peer, 1 + sum(term) AS total FROM (
    SELECT ticker, peer, exp(sum(ln((CASE WHEN df % 2 = 1 THEN 2.0 * j / (2 * j + 1) ELSE (2.0 * j - 1) / (2 * j) END) * (1 - r * r)))
             OVER (PARTITION BY ticker, peer ORDER BY j)) AS term
    FROM (SELECT ticker, peer, r, n - 2 AS df, unnest(range(1, CAST(floor((n - 2 - CASE WHEN n % 2 = 1 THEN 3 ELSE 2 END) / 2) AS BIGINT) + 1)) AS j
          FROM {stat}) a) b
  GROUP BY ticker, peer) t ON t.ticker = s.ticker AND t.peer = s.peer"""

register("pear", ("pairs",), "SELECT ticker, peer, corr(x, y) AS r, count(*) AS n FROM pairs GROUP BY ticker, peer")
register("pearp", ("pear",), PVALUE.format(stat="(SELECT * FROM pear WHERE n >= 30)"))
STRENGTH = """CASE WHEN abs(r) >= 0.8 THEN 'very_strong' WHEN abs(r) >= 0.6 THEN 'strong' WHEN abs(r) >= 0.4 THEN 'moderate'
  WHEN abs(r) >= 0.2 THEN 'weak' ELSE 'very_weak' END AS strength"""
register("peercorr", ("peers", "pearp"), f"""
SELECT *, p_value < 0.05 AS significant, {STRENGTH} FROM (
SELECT e.ticker, e.peer, coalesce(c.r, 0) AS r, coalesce(c.p_value, 1) AS p_value, coalesce(c.n, 0) AS n
FROM peers e LEFT JOIN pearp c ON c.ticker = e.ticker AND c.peer = e.peer) x""")
CORR_OUT = f"ticker, peer, {rcols('r p_value')}, n, CAST(p_value < 0.05 AS INT) AS significant, {STRENGTH}"

BETA = """
SELECT ticker, CASE WHEN count(*) >= 20 THEN covar_samp(ret, mkt) / nullif(var_samp(mkt), 0) END AS beta,
       count(*) AS n_common
FROM ret JOIN mret USING (dt) GROUP BY ticker"""
register("betas", ("ret", "mret"), BETA)


def inputs(spark, sf):
    px, edges = bars.daily(spark, sf).select("ticker", "dt", "close"), b.peers(spark, sf)
    return {"ret": s.with_returns(px), "edges": edges, "peer_ret": s.with_returns(p.peer_prices(px, edges))}


@CAT.add("beta", sql("betas", f"SELECT ticker, {rcols('beta')}, n_common FROM betas"))
def beta(spark, sf):
    px = bars.daily(spark, sf).select("ticker", "dt", "close")
    return show(p.beta(p.with_market(s.with_returns(px), p.market_returns(b.benchmark(px)))))


@CAT.add("pair_correlation", sql("peercorr", f"SELECT {CORR_OUT} FROM peercorr"))
def pair_correlation(spark, sf):
    return show(p.peer_correlations(**inputs(spark, sf)))


register("spear", ("pairs",), """
SELECT ticker, peer, corr(rx, ry) AS r, count(*) AS n FROM (
  SELECT ticker, peer,
    rank() OVER (PARTITION BY ticker, peer ORDER BY x) + (count(*) OVER (PARTITION BY ticker, peer, x) - 1) / 2 AS rx,
    rank() OVER (PARTITION BY ticker, peer ORDER BY y) + (count(*) OVER (PARTITION BY ticker, peer, y) - 1) / 2 AS ry
  FROM pairs) a GROUP BY ticker, peer""")


@CAT.add("spearman", sql("peers spear", f"""
SELECT {CORR_OUT} FROM (
SELECT e.ticker, e.peer, coalesce(c.r, 0) AS r, coalesce(c.p_value, 1) AS p_value, coalesce(c.n, 0) AS n
FROM peers e LEFT JOIN ({PVALUE.format(stat="(SELECT * FROM spear WHERE n >= 30)")}) c ON c.ticker = e.ticker AND c.peer = e.peer) x"""))
def spearman(spark, sf):
    return show(p.peer_correlations(**inputs(spark, sf), method="spearman"))


# tau-b by comparing all days of a pair with each other; p from the normal score by the same fit of erfc as the library's
register("kend0", ("pairs",), """
SELECT ticker, peer, sum(sign(b.x - a.x) * sign(b.y - a.y)) AS s, count(*) AS n0, max(c.n) AS n FROM pairs a JOIN pairs b USING (ticker, peer)
JOIN (SELECT ticker, peer, count(*) AS n FROM pairs GROUP BY ticker, peer) c USING (ticker, peer) WHERE b.dt > a.dt GROUP BY ticker, peer""")
for _side in "xy":
    register(f"ties_{_side}", ("pairs",), f"""
SELECT ticker, peer, sum(t * (t - 1) / 2) AS t1, sum(t * (t - 1) * (t - 2)) AS t2, sum(t * (t - 1) * (2 * t + 5)) AS t3
FROM (SELECT ticker, peer, count(*)::DOUBLE AS t FROM pairs GROUP BY ticker, peer, {_side}) g GROUP BY ticker, peer""")
register("kend", ("kend0", "ties_x", "ties_y"), """
SELECT ticker, peer, n, s / sqrt((n0 - x.t1) * (n0 - y.t1)) AS r,
  s / sqrt((n * (n - 1) * (2.0 * n + 5) - x.t3 - y.t3) / 18 + 2 * x.t1 * y.t1 / (n * (n - 1)) + x.t2 * y.t2 / (9.0 * n * (n - 1) * (n - 2))) AS z
FROM kend0 JOIN ties_x x USING (ticker, peer) JOIN ties_y y USING (ticker, peer)""")
_fit = str(ERFC_FIT[-1])
for _c in reversed(ERFC_FIT[:-1]):
    _fit = f"({_fit} * t + {_c})"


@CAT.add("kendall", sql("peers kend", f"""
SELECT {CORR_OUT} FROM (
SELECT e.ticker, e.peer, coalesce(c.r, 0) AS r, coalesce(c.p_value, 1) AS p_value, coalesce(c.n, 0) AS n FROM peers e LEFT JOIN (
  SELECT ticker, peer, r, n, t * exp({_fit} - v * v) AS p_value FROM (
    SELECT *, 1 / (1 + v / 2) AS t FROM (SELECT *, abs(z) / sqrt(2) AS v FROM kend WHERE n >= 30) a) b) c USING (ticker, peer)) x"""))
def kendall(spark, sf):
    return show(p.peer_correlations(**inputs(spark, sf), method="kendall"))


ROLL = """
SELECT * FROM (SELECT ticker, peer, dt, CASE WHEN count(*) OVER f >= 15 THEN corr(x, y) OVER f END AS r,
       count(*) OVER (PARTITION BY ticker, peer) AS n_all FROM pairs
WINDOW f AS (PARTITION BY ticker, peer ORDER BY dt ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)) x
WHERE n_all >= 30 AND r IS NOT NULL"""
register("roll", ("pairs",), ROLL)


@CAT.add("rolling_corr", sql("roll", f"SELECT ticker, peer, {D}, {rcols('r')} FROM roll"))
def rolling_corr(spark, sf):
    return show(p.rolling_correlation(p.paired_returns(**inputs(spark, sf))))


@CAT.add("regime_change", sql("roll", f"""
SELECT ticker, peer, {D}, {r('bef')} AS before, {r('aft')} AS after, {r('aft - bef')} AS shift FROM (
  SELECT *, avg(s) OVER (PARTITION BY ticker, peer ORDER BY dt ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS bef,
            avg(s) OVER (PARTITION BY ticker, peer ORDER BY dt ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS aft
  FROM (SELECT ticker, peer, dt, row_number() OVER (PARTITION BY ticker, peer ORDER BY dt) - 1 AS i,
               count(*) OVER (PARTITION BY ticker, peer) AS n,
               CASE WHEN count(r) OVER c = 20 THEN avg(r) OVER c END AS s
        FROM roll WINDOW c AS (PARTITION BY ticker, peer ORDER BY dt ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING)) a) b
WHERE n >= 40 AND i >= 20 AND i < n - 20 AND abs(aft - bef) >= 0.3"""))
def regime_change(spark, sf):
    return show(p.regime_changes(p.rolling_correlation(p.paired_returns(**inputs(spark, sf)))))


NATION_RET = """
SELECT n_name AS ticker, dt, close / lag(close) OVER (PARTITION BY n_name ORDER BY dt) - 1 AS ret FROM (
  SELECT n_name, dt, avg(close) AS close FROM prices JOIN supplier ON ticker = concat('S', s_suppkey)
  JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name, dt) x"""


@CAT.add("corr_matrix", sql("prices", f"""
SELECT a.n_name AS a, b.n_name AS b, {r('corr(x.ret, y.ret)')} AS r
FROM nation a JOIN nation b ON a.n_name <= b.n_name
LEFT JOIN ({NATION_RET}) x ON x.ticker = a.n_name AND x.ret IS NOT NULL
LEFT JOIN ({NATION_RET}) y ON y.ticker = b.n_name AND y.dt = x.dt AND y.ret IS NOT NULL
GROUP BY a.n_name, b.n_name"""))
def corr_matrix(spark, sf):
    """All national indices with each other; a nation without a listed supplier keeps its rows."""
    return show(p.correlation_matrix(s.with_returns(national_index(spark, sf)), nations(spark, sf)).drop("n"))


def nations(spark, sf):
    return b.table(spark, sf, "nation").select(F.col("n_name").alias("ticker"))


def national_index(spark, sf):
    """Mean close of a nation's suppliers per day."""
    home = (
        b.table(spark, sf, "supplier")
        .join(F.broadcast(b.table(spark, sf, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 rows
        .select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker"), "n_name")
    )
    return (
        bars.daily(spark, sf).select("ticker", "dt", "close").join(home, "ticker")
        .groupBy(F.col("n_name").alias("ticker"), "dt").agg(F.avg("close").alias("close"))
    )


@CAT.add("corr_matrix_all", sql("ret", f"""
SELECT a, b, {r('corr(x, y)')} AS r, count(x) AS n FROM (
  SELECT a.ticker AS a, b.ticker AS b, x.ret AS x, y.ret AS y
  FROM (SELECT DISTINCT concat('S', s_suppkey) AS ticker FROM supplier) a JOIN (SELECT DISTINCT concat('S', s_suppkey) AS ticker FROM supplier) b ON a.ticker <= b.ticker
  LEFT JOIN (ret x JOIN ret y ON y.dt = x.dt) ON x.ticker = a.ticker AND y.ticker = b.ticker) z GROUP BY a, b"""))
def corr_matrix_all(spark, sf):
    """Every listed supplier with every other one, in blocks."""
    listed = b.table(spark, sf, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker"))
    return show(p.correlation_matrix(s.with_returns(bars.daily(spark, sf).select("ticker", "dt", "close")), listed))


@CAT.add("corr_matrix_spearman", sql("prices", f"""
, natret AS ({NATION_RET}), common AS (
  SELECT x.ticker AS a, y.ticker AS b, x.ret AS x, y.ret AS y FROM natret x JOIN natret y ON y.dt = x.dt AND x.ticker <= y.ticker
  WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL)
SELECT m.n_name AS a, k.n_name AS b, {r('q.r')} AS r, coalesce(q.n, 0) AS n FROM nation m JOIN nation k ON m.n_name <= k.n_name LEFT JOIN (
  SELECT a, b, corr(rx, ry) AS r, count(*) AS n FROM (SELECT a, b,
    rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2 AS rx,
    rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2 AS ry FROM common) g GROUP BY a, b) q
  ON q.a = m.n_name AND q.b = k.n_name""".strip()))
def corr_matrix_spearman(spark, sf):
    return show(p.correlation_matrix(s.with_returns(national_index(spark, sf)), nations(spark, sf), method="spearman"))


@CAT.add("max_corr_peer", sql("peercorr", f"""
SELECT ticker, peer AS strongest_peer, {r('abs(r)')} AS strongest_abs_r FROM (
SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY abs(r) DESC, peer) AS rn FROM peercorr) x WHERE rn = 1"""))
def max_corr_peer(spark, sf):
    return show(p.strongest_peer(p.peer_correlations(**inputs(spark, sf))))


@CAT.add("peer_info", sql("peers", """
SELECT e.ticker, count(*) AS n_peers, count(s_name) AS found, count(*) - count(s_name) AS missing,
       string_agg(s_name, '; ' ORDER BY e.peer) AS names
FROM peers e LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) s ON concat('S', s_suppkey) = e.peer
GROUP BY e.ticker"""))
def peer_info(spark, sf):
    """Suppliers in debt have no entry, so some look-ups fail and are counted."""
    info = (
        b.table(spark, sf, "supplier").where("s_acctbal > 0")
        .select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker"),
                F.col("s_name").alias("name"), F.col("s_nationkey").alias("sector"))
    )
    t = p.peer_info(b.peers(spark, sf), info)
    # at most eight peers per ticker, so the list is bounded
    names = F.transform(F.sort_array(F.collect_list(F.when(F.col("found"), F.struct("peer", "name")))), lambda x: x["name"])
    return show(t.groupBy("ticker").agg(
        F.count("*").alias("n_peers"), F.count_if("found").alias("found"),
        F.count_if(~F.col("found")).alias("missing"), names.alias("names")))


@CAT.add("peer_upsert", sql("peers", """
SELECT ticker, peer FROM peers WHERE ticker NOT IN (SELECT DISTINCT concat('S', s_suppkey) FROM supplier WHERE s_acctbal < 0)
UNION ALL
SELECT concat('S', s_suppkey), concat('N-', s_nationkey) FROM supplier WHERE s_acctbal < 0"""))
def peer_upsert(spark, sf):
    return p.upsert_edges(b.peers(spark, sf), new_edges(spark, sf))


def new_edges(spark, sf):
    """Suppliers in debt get a new one-entry list; a self reference and a malformed name are among their edges."""
    debt = b.table(spark, sf, "supplier").where("s_acctbal < 0")
    t = F.concat(F.lit("S"), F.col("s_suppkey").cast("string"))
    return debt.select(
        t.alias("ticker"),
        F.explode(F.array(F.concat(F.lit(" n-"), F.col("s_nationkey").cast("string")), t, F.lit("b@d"))).alias("peer"),
    )


@CAT.add("peer_upsert_report", sql("peers", """
SELECT concat('S', s_suppkey) AS ticker, 1 AS accepted, coalesce(n, 0) AS replaced, 1 AS malformed, 1 AS self_references, 0 AS repeated, 2 AS rejected
FROM supplier LEFT JOIN (SELECT ticker, count(*) AS n FROM peers GROUP BY ticker) e ON e.ticker = concat('S', s_suppkey) WHERE s_acctbal < 0"""))
def peer_upsert_report(spark, sf):
    return show(p.upsert_report(b.peers(spark, sf), new_edges(spark, sf)))
