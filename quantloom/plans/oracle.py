"""SQL fragments for the correctness oracle: one CTE per domain table.

These restate the bindings in plain SQL, independently of the DataFrame code.
"""

from __future__ import annotations

CTE: dict[str, tuple[tuple[str, ...], str]] = {
    "prices": ((), """
SELECT concat('S', l_suppkey) AS ticker, CAST(l_shipdate AS DATE) AS dt,
       min_by(px, k) AS open, max(px) AS high, min(px) AS low, max_by(px, k) AS close,
       CAST(sum(l_quantity) AS BIGINT) AS volume
FROM (SELECT *, l_extendedprice / l_quantity AS px,
             CAST(l_orderkey AS HUGEINT) * 10000000000 + CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey AS k
      FROM lineitem) x
GROUP BY ALL"""),
    "bench": (("prices",), "SELECT dt, avg(close) AS close FROM prices GROUP BY dt"),
    "ret": (("prices",), """
SELECT * FROM (SELECT ticker, dt, close, volume,
       close / lag(close) OVER (PARTITION BY ticker ORDER BY dt) - 1 AS ret FROM prices) x WHERE ret IS NOT NULL"""),
    "mret": (("bench",), """
SELECT * FROM (SELECT dt, close / lag(close) OVER (ORDER BY dt) - 1 AS mkt FROM bench) x WHERE mkt IS NOT NULL"""),
    "peers": ((), """
SELECT ticker, peer FROM (
  SELECT concat('S', a.s_suppkey) AS ticker, concat('S', b.s_suppkey) AS peer,
         row_number() OVER (PARTITION BY a.s_suppkey ORDER BY b.s_suppkey) AS rn
  FROM supplier a JOIN nation na ON a.s_nationkey = na.n_nationkey
       JOIN nation nb ON na.n_regionkey = nb.n_regionkey
       JOIN supplier b ON b.s_nationkey = nb.n_nationkey AND b.s_suppkey <> a.s_suppkey) x
WHERE rn <= 8"""),
    "spot": (("prices",), """
SELECT ticker, max_by(close, dt) AS spot FROM prices WHERE dt <= DATE '1998-06-01' GROUP BY ticker"""),
    "chain": (("spot",), """
SELECT *, date_diff('day', DATE '1998-06-01', expiry) AS dte FROM (
SELECT s.ticker, CASE WHEN l_linestatus = 'O' THEN 'C' ELSE 'P' END AS side,
       last_day(CAST(l_shipdate AS DATE)) AS expiry,
       floor(s.spot * (0.70 + 0.012 * l_quantity) * 1e2 + 0.5) / 1e2 AS strike,
       floor(avg(s.spot * (0.02 + 0.25 * (0.62 - 0.012 * l_quantity)) * (1 + l_tax)) * 1e6 + 0.5) / 1e6 AS last_price,
       floor(avg(0.10 + 4 * l_discount) * 1e6 + 0.5) / 1e6 AS iv,
       CAST(sum(l_quantity) AS BIGINT) AS volume, CAST(10 * count(*) AS BIGINT) AS open_interest,
       max(s.spot) AS spot
FROM lineitem l JOIN spot s ON s.ticker = concat('S', l.l_suppkey)
WHERE CAST(l_shipdate AS DATE) > DATE '1998-06-01'
GROUP BY 1, 2, 3, 4) c"""),
    "facts0": ((), """
SELECT concat('C', o_custkey) AS ticker, make_date(year(o_orderdate), 12, 31) AS period_end,
  floor(sum(l_extendedprice * (1 - l_discount)) * 1e6 + 0.5) / 1e6               AS total_revenue,
  floor(sum(l_extendedprice * (1 - l_discount) * (0.45 + l_tax)) * 1e6 + 0.5) / 1e6 AS gross_profit,
  floor(sum(l_extendedprice * (0.20 - 2 * l_discount)) * 1e6 + 0.5) / 1e6        AS operating_income,
  floor(sum(l_extendedprice * (0.12 - 2 * l_discount)) * 1e6 + 0.5) / 1e6        AS net_income,
  floor(sum(l_extendedprice * 0.01 * l_linenumber) * 1e6 + 0.5) / 1e6            AS interest_expense,
  floor(sum(l_extendedprice * 1.8) * 1e6 + 0.5) / 1e6                            AS total_assets,
  floor(sum(l_extendedprice * (0.5 + 0.04 * l_linenumber)) * 1e6 + 0.5) / 1e6    AS total_current_assets,
  floor(sum(l_extendedprice * (0.3 + 5 * l_tax)) * 1e6 + 0.5) / 1e6              AS total_current_liabilities,
  floor(sum(l_extendedprice * (0.8 + 5 * l_tax)) * 1e6 + 0.5) / 1e6              AS total_liabilities,
  floor(sum(l_extendedprice * (0.3 + 2 * l_discount)) * 1e6 + 0.5) / 1e6         AS long_term_debt,
  floor(sum(l_extendedprice * 0.2) * 1e6 + 0.5) / 1e6                            AS retained_earnings,
  floor(sum(l_extendedprice * (0.25 - 2 * l_discount)) * 1e6 + 0.5) / 1e6        AS operating_cash_flow,
  floor(sum(-l_extendedprice * l_tax) * 1e6 + 0.5) / 1e6                         AS capital_expenditure,
  CAST(sum(l_quantity) AS BIGINT) * 100                           AS shares_outstanding
FROM orders JOIN lineitem ON l_orderkey = o_orderkey
GROUP BY o_custkey, year(o_orderdate)"""),
    "facts": (("facts0",), """
SELECT *, total_assets - total_liabilities AS total_stockholder_equity,
       operating_cash_flow - abs(capital_expenditure) AS free_cash_flow FROM facts0"""),
    "fnow": (("facts",), """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY period_end DESC) AS rn FROM facts) x
WHERE rn = 1"""),
    "targets": ((), """
SELECT concat('U', user_id) AS ticker, event_id AS analyst_id, value AS target, ts
FROM events WHERE event_type = 'purchase'"""),
    "ratings": ((), """
SELECT concat('U', user_id) AS ticker,
  count(*) FILTER (event_type = 'view') AS strong_buy, count(*) FILTER (event_type = 'click') AS buy,
  count(*) FILTER (event_type = 'signup') AS hold, count(*) FILTER (event_type = 'purchase') AS sell,
  count(*) FILTER (event_type = 'error') AS strong_sell
FROM events GROUP BY user_id"""),
}


def register(name: str, deps: tuple[str, ...], body: str) -> None:
    CTE[name] = (deps, body)


def sql(deps: str, body: str) -> str:
    """``body`` with the named CTEs (space separated) and everything they need in front."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for d in CTE[name][0]:
            visit(d)
        order.append(name)

    for name in deps.split():
        visit(name)
    if not order:
        return body
    head = ",\n".join(f"{n} AS ({CTE[n][1]})" for n in order)
    return f"WITH {head}\n{body}"


def r(expr: str, digits: int = 6) -> str:
    """The portable rounding used on every compared double."""
    return f"floor(({expr}) * 1e{digits} + 0.5) / 1e{digits}"


def rcols(names: str, digits: int = 6) -> str:
    return ", ".join(f"{r(n, digits)} AS {n}" for n in names.split())


def norm(v: str, lo: str, hi: str, invert: bool = False) -> str:
    x = f"greatest(0.0, least(1.0, (({v}) - ({lo})) / nullif(({hi}) - ({lo}), 0)))"
    if invert:
        x = f"(1.0 - {x})"
    return f"(CASE WHEN ({v}) IS NULL THEN NULL WHEN ({hi}) = ({lo}) THEN 0.5 ELSE {x} END)"
