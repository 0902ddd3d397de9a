"""Scans, cleaning, normalisation, data quality, scalar functions and report queries."""

from __future__ import annotations

import datetime as dt
import difflib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.config import glossary
from quantloom.config import options as cfg
from quantloom.config import statements as stm
from quantloom.functions.numeric import div
from quantloom.operators import chain as ch
from quantloom.operators import clean
from quantloom.operators import filters as flt
from quantloom.operators import fundamentals as fin
from quantloom.operators import normalize as nrm
from quantloom.operators import quality as dq
from quantloom.operators import report as rep
from quantloom.operators import series as s
from quantloom.operators import strategies as st
from quantloom.operators import textindex as ti
from quantloom.plans import fundamental_queries  # noqa: F401  (registers fund)
from quantloom.plans import option_queries as oq
from quantloom.plans import series_queries as sq
from quantloom.plans.common import Catalog, show
from quantloom.plans.oracle import r, rcols, register, sql
from quantloom.sources import bars
from quantloom.sources import bindings as b
from quantloom.sources import readers as rd
from quantloom.sources.shared import version

CAT = Catalog()
AS_OF = b.AS_OF
REPORT_DAY = dt.date(2001, 9, 15)
K = "CAST(substr(ticker, 2) AS BIGINT)"
D = "CAST(dt AS VARCHAR) AS dt"


def k() -> Column:
    """The number inside a ticker; drives the deterministic gaps of the dirty variants."""
    return F.substr("ticker", F.lit(2)).cast("bigint")


# --- scans -------------------------------------------------------------------

@CAT.add("price_history", sql("prices", f"""
SELECT ticker, {D}, {rcols('open high low close')}, volume FROM prices WHERE dt > DATE '1997-12-01' AND dt <= DATE '1998-06-01'"""))
def price_history(spark, sf):
    return show(rd.price_history(b.prices(spark, sf, start=dt.date(1997, 12, 2), end=AS_OF), AS_OF, "6mo"))


@CAT.add("min_history", sql("prices", f""", recent AS (SELECT * FROM prices WHERE dt > DATE '1998-03-01' AND dt <= DATE '1998-06-01')
SELECT ticker, {D}, {rcols('close')} FROM recent WHERE ticker IN (SELECT ticker FROM recent GROUP BY ticker HAVING count(*) >= 22)"""))
def min_history(spark, sf):
    px = rd.price_history(b.prices(spark, sf, start=dt.date(1998, 3, 2), end=AS_OF), AS_OF, "3mo").select("ticker", "dt", "close")
    return show(dq.min_history(px, 22))


FD = "market_cap pe_ratio price_to_book dividend_yield beta"


@CAT.add("fundamentals_snapshot", sql("fund", "SELECT ticker, " + ", ".join(
    f"{r(f'coalesce({c}, 0)', 4)} AS {c}" for c in FD.split()) + ", coalesce(sector, 'Unknown') AS sector, coalesce(industry, 'Unknown') AS industry FROM fund"))
def fundamentals_snapshot(spark, sf):
    t = rd.fundamentals_with_defaults(b.fundamentals(spark, sf))
    return show(t.select("ticker", *FD.split(), "sector", "industry"), 4)


def scanned(item: str) -> str:
    return f"CASE WHEN {K} % 6 = 0 THEN 0 ELSE {item} END" if item == "operating_income" else item


@CAT.add("statement_scan", sql("facts", f"""
SELECT ticker, CAST(period_end AS VARCHAR) AS period_end, {", ".join(f"{r(scanned(i), 2)} AS {i}" for i in b.FACT_ITEMS)} FROM facts"""))
def statement_scan(spark, sf):
    f = b.facts(spark, sf).withColumn("operating_income", F.when(k() % 6 != 0, F.col("operating_income")))
    return show(rd.statement(f, b.FACT_ITEMS), 2)


@CAT.add("source_fallback", sql("fcst ratings", """, p AS (SELECT * FROM fcst WHERE num_analysts >= 14), q AS (SELECT ticker, 0.5 AS confidence, buy + hold AS num_analysts FROM ratings WHERE sell >= 10)
SELECT r.ticker, floor(CASE WHEN p.ticker IS NOT NULL THEN p.confidence WHEN q.ticker IS NOT NULL THEN 0.5 END * 1e6 + 0.5) / 1e6 AS confidence,
  CASE WHEN p.ticker IS NOT NULL THEN p.num_analysts WHEN q.ticker IS NOT NULL THEN q.num_analysts END AS num_analysts,
  CASE WHEN p.ticker IS NOT NULL THEN 'targets' WHEN q.ticker IS NOT NULL THEN 'ratings' ELSE 'none' END AS source_used,
  CASE WHEN p.ticker IS NULL AND q.ticker IS NULL THEN 0 ELSE 1 END AS available, CASE WHEN p.ticker IS NULL AND q.ticker IS NULL THEN 'all sources failed' END AS error
FROM ratings r LEFT JOIN p ON p.ticker = r.ticker LEFT JOIN q ON q.ticker = r.ticker"""))
def source_fallback(spark, sf):
    """Well-covered targets first, then a neutral row from the ratings, else unavailable."""
    mix = b.rating_mix(spark, sf)
    primary = oq.forecasts(spark, sf).where("num_analysts >= 14").select("ticker", "confidence", "num_analysts")
    second = mix.where("sell >= 10").select("ticker", F.lit(0.5).alias("confidence"), (F.col("buy") + F.col("hold")).alias("num_analysts"))
    return show(rd.first_available(mix, {"targets": primary, "ratings": second}, ["confidence", "num_analysts"]))


@CAT.add("current_price", sql("spot prices", f"""
SELECT ticker, {r('price')} AS price FROM (
SELECT s.ticker, coalesce(CASE WHEN {K.replace('ticker', 's.ticker')} % 3 = 0 THEN spot END, CASE WHEN {K.replace('ticker', 's.ticker')} % 5 = 0 THEN 0 END,
   CASE WHEN {K.replace('ticker', 's.ticker')} % 7 = 0 THEN spot * 0.99 END, l.last_close) AS price
FROM spot s JOIN (SELECT ticker, max_by(close, dt) AS last_close FROM prices GROUP BY ticker) l ON l.ticker = s.ticker) x WHERE price > 0"""))
def current_price(spark, sf):
    """Quotes with gaps: the first known one counts, a zero quote drops the ticker."""
    px = bars.daily(spark, sf)
    last = px.groupBy("ticker").agg(F.max_by("close", "dt").alias("last_close"))
    t = b.spot(px).join(last, "ticker")
    p = rd.current_price(F.when(k() % 3 == 0, F.col("spot")), F.when(k() % 5 == 0, 0.0), F.when(k() % 7 == 0, F.col("spot") * 0.99), F.col("last_close"))
    return show(t.select("ticker", p.alias("price")).where("price IS NOT NULL"))


register("px1c", ("px1",), "SELECT ticker, count(*) AS n_bars FROM px1 GROUP BY ticker")


@CAT.add("market_bundle", sql("chain px1 px1c spot", f"""
SELECT s.ticker, {r('s.spot')} AS spot, c.n AS n_contracts, p.n_bars, p.n_bars AS n_common
FROM spot s LEFT JOIN (SELECT ticker, count(*) AS n FROM chain GROUP BY ticker) c ON c.ticker = s.ticker LEFT JOIN px1c p ON p.ticker = s.ticker"""))
def market_bundle(spark, sf):
    px = bars.daily(spark, sf, start=oq.YEAR_AGO, end=AS_OF)
    return show(rd.market_bundle(b.option_chain(spark, sf), px, b.benchmark(px), b.raw_spot(spark, sf)))


register("metrics0", ("prices", "ret"), f"""
SELECT p.ticker, latest_price, window_change, momentum_chart, rsi, volatility FROM (
  SELECT ticker, max_by(close, dt) AS latest_price, max_by(close, dt) / min_by(close, dt) - 1 AS window_change FROM prices GROUP BY ticker) p
JOIN (SELECT ticker, max(CASE WHEN k = 0 THEN close END) / max(CASE WHEN k = 19 THEN close END) - 1 AS momentum_chart FROM ({sq.RANKED}) x GROUP BY ticker) m USING (ticker)
JOIN (SELECT ticker, max_by(rsi, dt) AS rsi FROM ({sq.RSI_SMA}) q GROUP BY ticker) r USING (ticker)
JOIN (SELECT ticker, stddev_samp(ret) * sqrt(252) AS volatility FROM ret GROUP BY ticker) v USING (ticker)""")


@CAT.add("ticker_bundle", sql("metrics0 fund fnow", f"""
SELECT m.ticker, {rcols('latest_price window_change momentum_chart volatility')}, {r('m.rsi')} AS rsi, {r('f.pe_ratio', 4)} AS pe_ratio, f.sector,
  {r('n.gross_profit / n.total_revenue')} AS gross_margin, {r('n.operating_income / n.total_revenue')} AS operating_margin, {r('n.net_income / n.total_revenue')} AS net_margin
FROM (SELECT concat('C', substr(ticker, 2)) AS ticker, * EXCLUDE (ticker) FROM metrics0) m
LEFT JOIN (SELECT ticker, pe_ratio, sector FROM fund) f ON f.ticker = m.ticker LEFT JOIN fnow n ON n.ticker = m.ticker""").replace("latest_price) * 1e6", "m.latest_price) * 1e6"))
def ticker_bundle(spark, sf):
    """Latest price metrics, fundamentals and margins, one row per listed company."""
    px = bars.daily(spark, sf)
    w = s.by_day()
    t = s.rsi_sma(px).withColumns({"ret": s.lagged_return("close", 1, w), "mom": s.lagged_return("close", 19, w)})
    m = t.groupBy("ticker").agg(
        F.max_by("close", "dt").alias("latest_price"),
        (div(F.max_by("close", "dt"), F.min_by("close", "dt")) - 1).alias("window_change"),
        F.max_by("mom", "dt").alias("momentum_chart"), F.max_by("rsi", "dt").alias("rsi"),
        (F.stddev_samp("ret") * s.math.sqrt(s.TRADING_DAYS)).alias("volatility"),
    ).withColumn("ticker", F.concat(F.lit("C"), F.substr("ticker", F.lit(2))))
    f = b.facts(spark, sf)
    now = b.with_fundamentals(spark, sf, fin.latest_period(f))
    ratios = fin.basic_ratios(now).select("ticker", "gross_margin", "operating_margin", "net_margin")
    return show(rd.latest_bundle(m, now.select("ticker", "pe_ratio", "sector"), ratios), places={"pe_ratio": 4})


# --- statements: layout, names, cleaning ------------------------------------

INCOME = {"Total Revenue": "total_revenue", "Gross Profit": "gross_profit", "Operating Income": "operating_income", "Net Income": "net_income"}
BALANCE = {"Total Assets": "total_assets", "Total Current Assets": "total_current_assets", "Total Liabilities": "total_liabilities",
           "Total Current Liabilities": "total_current_liabilities", "Total Stockholder Equity": "total_stockholder_equity"}
CASH = {"Operating Cash Flow": "operating_cash_flow", "Capital Expenditure": "capital_expenditure"}


ITEMS = INCOME | BALANCE | CASH


@CAT.add("vendor_transpose", sql("facts", f"""
SELECT ticker, period_end, line_item, floor(value * 100 + 0.5) / 100 AS value FROM (
SELECT ticker, CAST(period_end AS VARCHAR) AS period_end, unnest([{", ".join(f"'{n}'" for n in ITEMS)}]) AS line_item,
       unnest([{", ".join(ITEMS.values())}]) AS value FROM facts) x WHERE value IS NOT NULL"""))
def vendor_transpose(spark, sf):
    """Items as rows with their periods beside each other (the vendor's layout), turned back into facts: all items and periods."""
    f = b.facts(spark, sf).select("ticker", "period_end", *[F.col(c).alias(n) for n, c in ITEMS.items()])
    vendor = nrm.to_vendor_layout(nrm.to_long(f, list(ITEMS), "all"))
    back = nrm.from_vendor_layout(vendor, "all").where(F.col("value").isNotNull())
    return show(back.select("ticker", "period_end", "line_item", "value"), 2)


LABELS = {
    "net_income": ["Net_Income", "NET INCOME", "net.income", "Net Incme", "Net Profit"],
    "total_revenue": ["Revenue", "total-revenue", "NET_SALES", "Totl Revenue", "Total Revenue"],
    "operating_income": ["EBIT", "Operating_Profit", "operating income", "Operting Income", "Custom Operating Thing"],
}


def dirty_items(spark, sf) -> DataFrame:
    """Long facts with labels that vary by company; every fifth company reports net income twice."""
    f = b.facts(spark, sf).withColumn("_k", k() % 5)
    cells = []
    for i, (c, names) in enumerate(LABELS.items()):
        label = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("_k") + 1).cast("int"))
        # every tenth company leaves its first net income blank
        v = F.when(k() % 10 != 4, F.col(c)) if c == "net_income" else F.col(c)
        cells.append(F.struct(label.alias("line_item"), F.lit(i).alias("ord"), v.alias("value")))
    second = F.when(F.col("_k") == 4, F.struct(F.lit("Net Earnings").alias("line_item"), F.lit(9).alias("ord"), (F.col("net_income") + 1).alias("value")))
    items = F.array_compact(F.array(*cells, second))
    return f.select("ticker", F.lit("income").alias("statement"), "period_end", F.inline(items))


OUT = ["Total Revenue", "Net Income", "Operating Income", "Gross Profit", "Custom Operating Thing"]
NI1 = f"CASE WHEN {K} % 10 = 4 THEN net_income + 1 ELSE net_income END"
NI2 = f"CASE WHEN {K} % 10 = 4 THEN net_income + 1 WHEN {K} % 5 = 4 THEN net_income * 2 + 1 ELSE net_income END"


def wide_sql(ni: str, fill: str) -> str:
    return f"""
SELECT ticker, CAST(period_end AS VARCHAR) AS period_end, {r('total_revenue', 2)} AS total_revenue, {r(ni, 2)} AS net_income,
  {r(f'CASE WHEN {K} % 5 <> 4 THEN operating_income ELSE {fill} END', 2)} AS operating_income, CAST({fill} AS DOUBLE) AS gross_profit,
  {r(f'CASE WHEN {K} % 5 = 4 THEN operating_income ELSE {fill} END', 2)} AS custom FROM facts"""


def renamed(t: DataFrame) -> DataFrame:
    return show(t.select("ticker", "period_end", *[F.col(f"`{o}`").alias(n) for o, n in zip(
        OUT, ["total_revenue", "net_income", "operating_income", "gross_profit", "custom"])]), 2)


@CAT.add("statement_standardize", sql("facts", wide_sql(NI1, "NULL")))
def statement_standardize(spark, sf):
    return renamed(nrm.to_wide(nrm.standardize(dirty_items(spark, sf)), OUT))


@CAT.add("statement_standardize_sum", sql("facts", wide_sql(NI2, "0")))
def statement_standardize_sum(spark, sf):
    return renamed(nrm.to_wide(nrm.standardize(dirty_items(spark, sf), mode="sum"), OUT, fill=0.0))


# canonical item -> column, of the statements whose labels only vary in spelling
SHEETS = {
    "balance": {
        "Total Assets": "total_assets", "Total Current Assets": "total_current_assets", "Total Liabilities": "total_liabilities",
        "Total Current Liabilities": "total_current_liabilities", "Long Term Debt": "long_term_debt",
        "Retained Earnings": "retained_earnings", "Total Stockholder Equity": "total_stockholder_equity",
    },
    "cash_flow": {"Operating Cash Flow": "operating_cash_flow", "Capital Expenditure": "capital_expenditure", "Net Income": "net_income"},
}


def spellings(statement: str, canonical: str) -> list[str]:
    """Five labels of an item: two with other separators, upper case, a synonym, and one with a missing letter."""
    other = stm.STATEMENTS[statement][canonical]
    return [canonical.replace(" ", "_"), canonical.upper(), canonical.lower().replace(" ", "."), (other or [canonical])[0], canonical[:3] + canonical[4:]]


def varied_items(spark, sf) -> DataFrame:
    """Long facts of the balance sheet and the cash flow with labels that vary by company, and an item that no statement knows."""
    f = b.facts(spark, sf)
    cells = []
    for statement, items in SHEETS.items():
        for i, (canonical, c) in enumerate(items.items()):
            label = F.element_at(F.array(*[F.lit(n) for n in spellings(statement, canonical)]), (k() % 5 + 1).cast("int"))
            cells.append(F.struct(F.lit(statement).alias("statement"), label.alias("line_item"), F.lit(i).alias("ord"), F.col(c).cast("double").alias("value")))
        cells.append(F.struct(F.lit(statement).alias("statement"), F.lit("Zzyzx Adjustment").alias("line_item"), F.lit(99).alias("ord"), F.lit(1.0).alias("value")))
    return f.select("ticker", "period_end", F.inline(F.array(*cells))).select("ticker", "statement", "period_end", "line_item", "ord", "value")


def all_items(spark, sf) -> DataFrame:
    return dirty_items(spark, sf).select("ticker", "statement", "period_end", "line_item", "ord", "value").unionByName(varied_items(spark, sf))


def fold_sql(c: str) -> str:
    return f"lower(regexp_replace({c}, '[ _.-]', ' ', 'g'))"


def quoted_text(t: str | None) -> str:
    return "NULL" if t is None else "'" + t.replace("'", "''") + "'"


def fuzzy_values() -> str:
    """What comparing each label of the test data with every synonym finds; SQL itself has no such ratio."""
    known: dict[str, dict[str, str]] = {}
    for statement, key, canonical in nrm.synonym_rows():
        known.setdefault(statement, {})[key] = canonical
    labels = {("income", n) for ns in LABELS.values() for n in ns} | {("income", "Net Earnings")}
    labels |= {(s_, n) for s_, items in SHEETS.items() for c in items for n in spellings(s_, c)} | {(s_, "Zzyzx Adjustment") for s_ in SHEETS}
    rows = []
    for statement, label in sorted(labels):
        found = difflib.get_close_matches(nrm.fold_text(label), known[statement], n=1, cutoff=0.6)
        ratio = difflib.SequenceMatcher(None, found[0], nrm.fold_text(label)).ratio() if found else 0.0
        rows.append(f"({quoted_text(statement)}, {quoted_text(label)}, {quoted_text(known[statement][found[0]] if found else None)}, {ratio})")
    return f"(VALUES {', '.join(rows)}) AS fuzzy(statement, line_item, canonical, ratio)"


SYNONYMS = f"(VALUES {', '.join('(' + ', '.join(map(quoted_text, row)) + ')' for row in nrm.synonym_rows())}) AS synonyms(statement, key, canonical)"
register("labels_seen", ("facts",), f"""
SELECT DISTINCT statement, line_item FROM (
SELECT 'income' AS statement, unnest([{", ".join(f"[{', '.join(quoted_text(n) for n in ns)}][CAST({K} % 5 AS INT) + 1]" for ns in LABELS.values())}, CASE WHEN {K} % 5 = 4 THEN 'Net Earnings' END]) AS line_item FROM facts
{"".join(f"UNION ALL SELECT '{s_}', unnest([{', '.join('[' + ', '.join(quoted_text(n) for n in spellings(s_, c)) + f'][CAST({K} % 5 AS INT) + 1]' for c in items)}, 'Zzyzx Adjustment']) FROM facts " for s_, items in SHEETS.items())}) x
WHERE line_item IS NOT NULL""")


@CAT.add("label_map", sql("labels_seen", f"""
SELECT l.statement, l.line_item, coalesce(e.canonical, CASE WHEN f.ratio >= 0.8 THEN f.canonical END, l.line_item) AS canonical,
  CASE WHEN e.canonical IS NOT NULL THEN 'exact' WHEN f.ratio >= 0.8 THEN 'fuzzy' ELSE 'unmapped' END AS how,
  CASE WHEN e.canonical IS NULL AND f.ratio >= 0.6 AND f.ratio < 0.8 THEN f.canonical END AS suggestion
FROM labels_seen l LEFT JOIN {SYNONYMS} ON synonyms.statement = l.statement AND synonyms.key = {fold_sql('l.line_item')}
LEFT JOIN {fuzzy_values()} ON fuzzy.statement = l.statement AND fuzzy.line_item = l.line_item""".replace("e.canonical", "synonyms.canonical").replace("f.ratio", "fuzzy.ratio").replace("f.canonical", "fuzzy.canonical")))
def label_map(spark, sf):
    return nrm.label_map(all_items(spark, sf)).select("statement", "line_item", "canonical", "how", "suggestion")


def canonical_sql(statement: str) -> str:
    known = {"Total Revenue": "total_revenue", "Net Income": NI1, "Operating Income": f"CASE WHEN {K} % 5 <> 4 THEN operating_income END"} if statement == "income" else SHEETS[statement]
    cells = ", ".join(f'{r(known[c], 2)} AS "{c}"' if c in known else f'NULL::DOUBLE AS "{c}"' for c in stm.STATEMENTS[statement])
    return sql("facts", f"SELECT ticker, CAST(period_end AS VARCHAR) AS period_end, {cells} FROM facts")


def canonical_statement(spark, sf, statement: str) -> DataFrame:
    """Every canonical item of a statement as a column, also those that no company reports; items without a canonical name go."""
    long = nrm.standardize(all_items(spark, sf).where(F.col("statement") == statement))
    return show(nrm.to_wide(long, list(stm.STATEMENTS[statement])), 2)


@CAT.add("canonical_income", canonical_sql("income"))
def canonical_income(spark, sf):
    return canonical_statement(spark, sf, "income")


@CAT.add("canonical_balance", canonical_sql("balance"))
def canonical_balance(spark, sf):
    return canonical_statement(spark, sf, "balance")


@CAT.add("canonical_cash_flow", canonical_sql("cash_flow"))
def canonical_cash_flow(spark, sf):
    return canonical_statement(spark, sf, "cash_flow")


@CAT.add("alias_resolution", sql("facts", f"""
SELECT ticker, CAST(period_end AS VARCHAR) AS period_end, {r('total_revenue', 2)} AS revenue, {r('net_income', 2)} AS earnings, NULL::DOUBLE AS ebitda FROM facts"""))
def alias_resolution(spark, sf):
    """The first of several names that the frame has; an item under none of its names is missing."""
    f = b.facts(spark, sf).withColumnRenamed("total_revenue", "Revenue")
    names = {"revenue": ["Total Revenue", "Revenue", "net_income"], "earnings": ["Net Income", "net_income"], "ebitda": ["EBITDA", "ebitda"]}
    found = {n: nrm.first_existing(f, listed) for n, listed in names.items()}
    return show(f.select("ticker", "period_end", *[(F.lit(None) if c is None else c).cast("double").alias(n) for n, c in found.items()]), 2)


@CAT.add("price_clean_ffill", sql("prices", f"""
SELECT ticker, {D}, {r('abs(last_value(c IGNORE NULLS) OVER w)')} AS close, {r('last_value(o IGNORE NULLS) OVER w')} AS open,
       CASE WHEN day(dt) % 13 = 0 THEN 0 ELSE volume END AS volume
FROM (SELECT *, CASE WHEN day(dt) % 7 <> 0 THEN CASE WHEN day(dt) % 5 = 0 THEN -close ELSE close END END AS c, CASE WHEN day(dt) % 9 <> 0 THEN open END AS o FROM prices) x
WINDOW w AS (PARTITION BY ticker ORDER BY dt)"""))
def price_clean_ffill(spark, sf):
    return show(clean.clean_prices(dirty_prices(spark, sf)).select("ticker", "dt", "close", "open", "volume"))


def dirty_prices(spark, sf) -> DataFrame:
    """Closes missing on days divisible by 7 and negative on the fifths, opens missing on the ninths, odd volumes."""
    day = F.day("dt")
    close = F.when(day % 7 != 0, F.when(day % 5 == 0, -F.col("close")).otherwise(F.col("close")))
    volume = F.when(day % 13 != 0, F.when(day % 11 == 0, -F.col("volume")).otherwise(F.col("volume")))
    return bars.daily(spark, sf).withColumns({"close": close, "open": F.when(day % 9 != 0, F.col("open")), "volume": volume})


@CAT.add("price_fill_both", sql("prices", f"""
SELECT ticker, {D}, {r('coalesce(last_value(o IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY dt), first_value(o IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY dt ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))')} AS open
FROM (SELECT *, CASE WHEN day(dt) % 9 <> 0 AND dt > DATE '1995-02-01' THEN open END AS o FROM prices) x"""))
def price_fill_both(spark, sf):
    px = dirty_prices(spark, sf).withColumn("open", F.when(F.col("dt") > F.lit(dt.date(1995, 2, 1)), F.col("open")))
    return show(clean.fill_both_ways(px, ["open"]).select("ticker", "dt", "open"))


def as_text(c: str) -> str:
    return f"CAST(printf('%.6f', {c}) AS DOUBLE)"


@CAT.add("statement_clean", sql("facts", f"""
SELECT ticker, CAST(period_end AS VARCHAR) AS period_end, {", ".join(f'{r(f"CASE WHEN {K} % 4 = {i % 4} THEN 0 ELSE {as_text(c)} END", 2)} AS "{n}"' for i, (n, c) in enumerate(ITEMS.items()))} FROM facts"""))
def statement_clean(spark, sf):
    """Numbers as text, every item unreadable for another quarter of the companies; padded names and tickers."""
    f = b.facts(spark, sf)
    texts = [F.when(k() % 4 == i % 4, "n/m").otherwise(F.format_string("%.6f", F.col(c))).alias(f"  {n} ") for i, (n, c) in enumerate(ITEMS.items())]
    return show(clean.clean_statement(f.select(F.concat(F.lit(" "), "ticker").alias("ticker"), "period_end", *texts), ["ticker"]), 2)


DATE_TEXT = {0: "yyyy-MM-dd", 1: "MM/dd/yyyy", 2: "dd-MM-yyyy", 3: "yyyy/MM/dd"}


@CAT.add("bundle_clean", sql("facts", f"""
SELECT ticker, CASE WHEN {K} % 5 = 4 THEN '1970-01-01' ELSE CAST(period_end AS VARCHAR) END AS period_end,
  {r(f'CASE WHEN {K} % 6 = 0 THEN 0 ELSE operating_income END', 2)} AS "Operating Income", 0.0::DOUBLE AS "Net Income" FROM facts"""))
def bundle_clean(spark, sf):
    """Period labels in four date styles inside text, or without any date."""
    f = b.facts(spark, sf)
    label = F.lit("FY end")
    for i, style in DATE_TEXT.items():
        label = F.when(k() % 5 == i, F.concat(F.lit("FY "), F.date_format("period_end", style))).otherwise(label)
    f = f.select("ticker", label.alias("label"), F.when(k() % 6 != 0, F.col("operating_income")).alias("Operating Income"))
    return show(clean.clean_bundle(f, "label", ["Operating Income", "Net Income"]), 2)


def cap_text() -> Column:
    n = F.col("c_custkey") % 5
    unit = F.when(n == 0, "K").when(n == 1, "M").when(n == 2, "B").when(n == 3, "t").otherwise("")
    return F.when(F.col("c_custkey") % 19 == 0, "unknown").otherwise(F.concat(F.lit("$"), F.format_string("%,.2f", F.abs("c_acctbal")), unit))


@CAT.add("marketcap_parse", f"""
SELECT c_custkey, {r('CASE WHEN c_custkey % 19 <> 0 THEN abs(c_acctbal) * CASE c_custkey % 5 WHEN 0 THEN 1e-3 WHEN 2 THEN 1e3 WHEN 3 THEN 1e6 ELSE 1 END END', 4)} AS cap_millions,
       {r('c_acctbal / 1e6')} AS from_number FROM customer""")
def marketcap_parse(spark, sf):
    c = b.table(spark, sf, "customer")
    return show(c.select("c_custkey", clean.market_cap_millions(cap_text()).alias("cap_millions"),
                         clean.market_cap_number("c_acctbal").alias("from_number")), places={"cap_millions": 4})


@CAT.add("fundamentals_clean", sql("fund fnow", f"""
SELECT f.ticker, {r('CASE WHEN f.beta IS NOT NULL THEN f.beta END')} AS beta, coalesce(industry, '') AS industry, {r('market_cap / 1e6')} AS market_cap,
  {r('n.total_current_assets / n.total_current_liabilities')} AS current_ratio, {r('n.long_term_debt / n.total_stockholder_equity')} AS debt_to_equity,
  {r('n.net_income / n.total_revenue')} AS net_margin FROM fund f JOIN fnow n ON n.ticker = f.ticker"""))
def fundamentals_clean(spark, sf):
    """Text where numbers belong, padded names; ratios derived after cleaning."""
    f = b.facts(spark, sf)
    now = b.with_fundamentals(spark, sf, fin.latest_period(f))
    t = clean.clean_fundamentals(now.select(
        "ticker", F.coalesce(F.col("beta").cast("string"), F.lit("none")).alias("beta"), F.concat(F.lit("  "), "industry").alias("industry"), "market_cap",
        F.col("total_current_assets").alias("current_assets"), F.col("total_current_liabilities").alias("current_liabilities"),
        F.col("long_term_debt").alias("total_debt"), F.col("total_stockholder_equity").alias("total_equity"), "net_income", F.col("total_revenue").alias("revenue")))
    return show(t.select("ticker", "beta", "industry", "market_cap", "current_ratio", "debt_to_equity", "net_margin"))


@CAT.add("analyst_clean", sql("ratings", """
SELECT ticker, CAST(strong_buy AS DOUBLE) AS strong_buy, CASE WHEN buy % 2 = 0 THEN CAST(buy AS DOUBLE) END AS buy,
       CASE WHEN hold > sell THEN 'hold' ELSE 'unknown' END AS recommendation FROM ratings"""))
def analyst_clean(spark, sf):
    m = b.rating_mix(spark, sf)
    raw = m.select(
        "ticker", F.col("strong_buy").cast("string").alias("Strong Buy"), F.when(F.col("buy") % 2 == 0, F.col("buy").cast("string")).otherwise("?").alias("Buy"),
        F.when(F.col("hold") > F.col("sell"), "HOLD").alias("Recommendation"), F.lit("USD").alias("Currency"), F.lit("EQUITY").alias("Quote Type"))
    return show(clean.clean_analyst_rows(raw))


# --- data quality ------------------------------------------------------------

RULE_SQL = {
    "MISSING_VALUES": ("MEDIUM", "c IS NULL OR o IS NULL OR v IS NULL"),
    "NEGATIVE_PRICES": ("HIGH", "c < 0 OR o < 0"),
    "INVALID_OPEN_CLOSE": ("HIGH", "coalesce(o > high, false) OR coalesce(o < low, false) OR coalesce(c > high, false) OR coalesce(c < low, false)"),
    "NEGATIVE_VOLUME": ("HIGH", "v < 0"),
}


@CAT.add("price_dq", sql("prices", """
, dirty AS (SELECT *, CASE WHEN day(dt) % 7 <> 0 THEN CASE WHEN day(dt) % 5 = 0 THEN -close ELSE close END END AS c, CASE WHEN day(dt) % 9 <> 0 THEN open END AS o,
   CASE WHEN day(dt) % 13 <> 0 THEN CASE WHEN day(dt) % 11 = 0 THEN -volume ELSE volume END END AS v FROM prices)
""".strip() + "\n" + "\nUNION ALL\n".join(
    f"SELECT ticker, '{c}' AS code, '{sev}' AS severity, count(*) AS n FROM dirty WHERE {p} GROUP BY ticker" for c, (sev, p) in RULE_SQL.items())))
def price_dq(spark, sf):
    return show(dq.price_issues(dirty_prices(spark, sf)))


@CAT.add("fundamentals_dq", sql("fund", """
SELECT ticker, issues, CAST(issues = '' AS INT) AS valid FROM (
SELECT ticker, concat_ws('; ', CASE WHEN market_cap IS NULL THEN 'MISSING:market_cap' END, CASE WHEN pe_ratio IS NULL THEN 'MISSING:pe_ratio' END,
  CASE WHEN beta IS NULL THEN 'INVALID:beta' END) AS issues FROM fund) x"""))
def fundamentals_dq(spark, sf):
    d = b.fundamentals(spark, sf)
    return show(dq.fundamentals_issues(d.withColumn("beta", F.coalesce(F.col("beta").cast("string"), F.lit("none")))))


HAS = {"income": "true", "balance": f"{K} % 10 <> 0", "cash_flow": f"{K} % 8 <> 0"}


LAYOUT = {"income": list(INCOME), "balance": list(BALANCE), "cash_flow": list(CASH)}


def bundle(spark, sf) -> DataFrame:
    """All statements in one wide frame under canonical names; some companies lack a statement or a value."""
    f = b.facts(spark, sf).withColumn("operating_income", F.when(k() % 6 != 0, F.col("operating_income")))
    return f.select(
        "ticker", "period_end", *[F.col(c).alias(n) for n, c in {**INCOME, **BALANCE, **CASH}.items()],
        (k() % 10 != 0).alias("has_balance"), (k() % 8 != 0).alias("has_cash_flow"))


def universe(spark, sf) -> DataFrame:
    return b.table(spark, sf, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("ticker"))


register("uni", (), "SELECT concat('C', c_custkey) AS ticker, c_custkey FROM customer")
register("gapf", ("facts",), f"SELECT * EXCLUDE (operating_income), CASE WHEN {K} % 6 <> 0 THEN operating_income END AS operating_income FROM facts")


@CAT.add("bundle_check", sql("uni gapf", f"""
SELECT u.ticker, CAST(f.ticker IS NOT NULL AS INT) AS has_income, CAST(f.ticker IS NOT NULL AND c_custkey % 10 <> 0 AS INT) AS has_balance,
  CAST(f.ticker IS NOT NULL AND c_custkey % 8 <> 0 AS INT) AS has_cash_flow, CAST(f.ticker IS NOT NULL AND c_custkey % 10 <> 0 AND c_custkey % 8 <> 0 AS INT) AS complete
FROM uni u LEFT JOIN (SELECT DISTINCT ticker FROM gapf) f ON f.ticker = u.ticker"""))
def bundle_check(spark, sf):
    return show(rep.presence(universe(spark, sf), bundle(spark, sf), LAYOUT))


def avail_sql() -> str:
    """ticker, statement, periods, completeness, last_date, missing, issues, present."""
    parts = []
    neg = {"income": INCOME, "balance": {n: BALANCE[n] for n in stm.REQUIRED_AVAILABILITY["balance"]}, "cash_flow": CASH}
    missing = {"income": "", "balance": "", "cash_flow": "Free Cash Flow"}
    least = {"income": "count(operating_income)", "balance": "count(*)", "cash_flow": "count(*)"}
    for name in ("income", "balance", "cash_flow"):
        issues = ", ".join(
            f"CASE WHEN count(*) FILTER ({c} < 0) > 0 THEN concat('Negative values in {n}: ', count(*) FILTER ({c} < 0), ' occurrences') END" for n, c in neg[name].items())
        last = "NULL" if name == "balance" else "CAST(max(period_end) AS VARCHAR)"
        parts.append(f"SELECT ticker, '{name}' AS statement, count(*) AS periods, {least[name]} * 100.0 / count(*) AS completeness, {last} AS last_date, "
                     f"'{missing[name]}' AS missing_columns, concat_ws('; ', {issues}) AS issues FROM gapf WHERE {HAS[name]} GROUP BY ticker")
    return "\nUNION ALL\n".join(parts)


register("avail0", ("gapf",), avail_sql())
register("avail", ("avail0", "uni"), """
SELECT u.ticker, s.statement, periods, completeness, last_date, missing_columns, issues, a.ticker IS NOT NULL AS available
FROM uni u CROSS JOIN (VALUES ('income'), ('balance'), ('cash_flow')) s(statement) LEFT JOIN avail0 a ON a.ticker = u.ticker AND a.statement = s.statement""")


@CAT.add("availability_report", sql("avail", """
SELECT ticker, statement, periods, floor(completeness * 1e6 + 0.5) / 1e6 AS completeness, last_date, coalesce(missing_columns, '') AS missing_columns, coalesce(issues, '') AS issues,
       CAST(available AS INT) AS available FROM avail"""))
def availability_report(spark, sf):
    return show(rep.availability(universe(spark, sf), bundle(spark, sf), LAYOUT))


@CAT.add("structure_report", sql("gapf", f"""
SELECT ticker, 'income' AS statement, 'Missing required columns: Basic EPS' AS errors,
  CASE WHEN count(operating_income) < count(*) THEN 'Found missing values in columns: Operating Income' ELSE '' END AS warnings, 0 AS is_valid FROM gapf GROUP BY ticker
UNION ALL SELECT ticker, 'balance', '', '', 1 FROM gapf WHERE {HAS['balance']} GROUP BY ticker
UNION ALL SELECT ticker, 'cash_flow', 'Missing required columns: Free Cash Flow', '', 0 FROM gapf WHERE {HAS['cash_flow']} GROUP BY ticker"""))
def structure_report(spark, sf):
    return show(rep.structure(bundle(spark, sf), LAYOUT))


register("impact", ("avail", "fund"), """
SELECT a.ticker, concat_ws(', ', CASE WHEN f.ticker IS NOT NULL AND f.pe_ratio IS NULL THEN 'P/E Ratio' END, 'Free Cash Flow, Intrinsic Value (DCF)') AS value_metrics,
  concat_ws(', ', CASE WHEN NOT bal THEN 'Current Ratio, Debt-to-Equity Ratio, Altman Z-Score' END, CASE WHEN NOT inc THEN 'Operating Margin, Net Margin, Piotroski Score' END) AS health_metrics,
  concat_ws(', ', CASE WHEN NOT inc THEN 'Revenue Growth, Earnings Growth, EPS Growth' END) AS growth_metrics,
  concat_ws(', ', CASE WHEN f.ticker IS NOT NULL AND f.beta IS NULL THEN 'Market Risk' END, CASE WHEN NOT bal THEN 'Financial Risk, Business Risk' END) AS risk_metrics
FROM (SELECT ticker, bool_or(available AND statement = 'income') AS inc, bool_or(available AND statement = 'balance') AS bal FROM avail GROUP BY ticker) a
LEFT JOIN fund f ON f.ticker = a.ticker""")


@CAT.add("impact_map", sql("impact", "SELECT * FROM impact"))
def impact_map(spark, sf):
    av = rep.availability(universe(spark, sf), bundle(spark, sf), LAYOUT)
    return show(rep.impact(av, b.fundamentals(spark, sf)))


T = "CASE statement WHEN 'income' THEN 'Income Stmt' WHEN 'balance' THEN 'Balance Sheet' ELSE 'Cash Flow' END"


@CAT.add("data_advice", sql("avail impact", f"""
SELECT ticker, concat('Collect ', {T}, ' data') AS advice FROM avail WHERE NOT available
UNION ALL SELECT ticker, concat('Add ', missing_columns, ' to ', {T}) FROM avail WHERE available AND missing_columns <> ''
UNION ALL SELECT ticker, concat('Review ', {T}, ' for ', replace(issues, '; ', ', ')) FROM avail WHERE available AND issues <> ''
UNION ALL SELECT ticker, concat('Update ', {T}, ' data (last available: ', last_date, ')') FROM avail WHERE date_diff('day', CAST(last_date AS DATE), DATE '2001-09-15') > 90
""" + "".join(f"UNION ALL SELECT ticker, concat('Improve {g.replace('_', ' ')} calculation by collecting: ', {g}) FROM impact WHERE {g} <> ''\n"
              for g in ("value_metrics", "health_metrics", "growth_metrics", "risk_metrics"))))
def data_advice(spark, sf):
    av = rep.availability(universe(spark, sf), bundle(spark, sf), LAYOUT)
    return show(rep.advice(av, rep.impact(av, b.fundamentals(spark, sf)), REPORT_DAY))


AGE = "CASE WHEN {d} > 365 THEN 10 WHEN {d} > 180 THEN 7 WHEN {d} > 90 THEN 5 WHEN {d} > 30 THEN 2 ELSE 0 END"


def neg_pen(c: str) -> str:
    return f"least(5, 1.5 * count(*) FILTER (rn <= 8 AND {c} < 0))"


@CAT.add("quality_score", sql("uni gapf fund", f"""
, p AS (SELECT ticker, {AGE.format(d="date_diff('day', max(period_end), DATE '2001-09-15')")} AS age, {neg_pen('gross_profit')} + {neg_pen('total_revenue')} AS inc_neg,
   {neg_pen('total_assets')} + {neg_pen('total_stockholder_equity')} AS bal_neg, {neg_pen('operating_cash_flow')} AS cash_neg
   FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY period_end DESC) AS rn FROM gapf) x GROUP BY ticker),
q AS (SELECT u.ticker, CASE WHEN p.ticker IS NULL THEN 0 ELSE 5 + CASE WHEN c_custkey % 10 <> 0 THEN 5 ELSE 0 END + CASE WHEN c_custkey % 8 <> 0 THEN 3 ELSE 0 END END AS required,
   CASE WHEN p.ticker IS NULL THEN 0 ELSE 4 + CASE WHEN c_custkey % 10 <> 0 THEN 5 ELSE 0 END + CASE WHEN c_custkey % 8 <> 0 THEN 2 ELSE 0 END END AS available,
   coalesce(age + inc_neg, 0) + CASE WHEN c_custkey % 10 <> 0 THEN coalesce(bal_neg, 0) ELSE 0 END + CASE WHEN c_custkey % 8 <> 0 THEN coalesce(age + cash_neg, 0) ELSE 0 END
   + CASE WHEN f.pe_ratio IS NULL THEN 8 WHEN f.pe_ratio = 0 THEN 4 ELSE 0 END + CASE WHEN f.market_cap IS NULL THEN 8 WHEN f.market_cap = 0 THEN 4 ELSE 0 END
   + CASE WHEN f.beta IS NULL THEN 8 WHEN f.beta = 0 THEN 4 ELSE 0 END AS pen0
   FROM uni u LEFT JOIN p ON p.ticker = u.ticker LEFT JOIN fund f ON f.ticker = u.ticker),
z AS (SELECT *, available / nullif(required, 0) AS ratio, pen0 + CASE WHEN available / nullif(required, 0) < 0.5 THEN 15 WHEN available / nullif(required, 0) < 0.7 THEN 10
   WHEN available / nullif(required, 0) < 0.9 THEN 5 ELSE 0 END AS penalty FROM q)
SELECT ticker, required, available, {r('coalesce(ratio * 100, 0)', 4)} AS base_score, {r('penalty', 4)} AS penalty,
  {r('greatest(0, coalesce(ratio * 100, 0) - penalty / 94.0 * 40)', 4)} AS quality_score FROM z""".strip()))
def quality_score(spark, sf):
    return show(rep.quality_score(universe(spark, sf), bundle(spark, sf), LAYOUT, b.fundamentals(spark, sf), REPORT_DAY), 4)


register("status", ("fcst", "chain", "peers"), """
SELECT *, has_forecast + has_options + has_peers AS available_sources,
  CASE WHEN has_forecast + has_options + has_peers = 3 THEN 'healthy' WHEN has_forecast + has_options + has_peers >= 2 THEN 'partial' ELSE 'unhealthy' END AS health
FROM (SELECT t.ticker, CAST(t.ticker IN (SELECT concat('S', substr(ticker, 2)) FROM fcst) AS INT) AS has_forecast,
        CAST(t.ticker IN (SELECT ticker FROM chain WHERE side = 'C' AND dte >= 1) AS INT) AS has_options, CAST(t.ticker IN (SELECT ticker FROM peers) AS INT) AS has_peers
      FROM (SELECT concat('S', s_suppkey) AS ticker FROM supplier) t) x""")


def status(spark, sf) -> DataFrame:
    fc = oq.stock_forecasts(spark, sf)
    return dq.source_status(oq.tickers(spark, sf), fc, ch.contracts(b.option_chain(spark, sf), "C", 1), b.peers(spark, sf))


@CAT.add("source_health", sql("status", "SELECT * FROM status"))
def source_health(spark, sf):
    return show(status(spark, sf))


@CAT.add("health_summary", sql("status", """
SELECT total, healthy_tickers, partial_tickers, unhealthy_tickers, floor(f * 1e6 + 0.5) / 1e6 AS forecast_rate, floor(o * 1e6 + 0.5) / 1e6 AS options_rate, floor(p * 1e6 + 0.5) / 1e6 AS peers_rate,
  CASE WHEN f >= o AND f >= p THEN 'forecast' WHEN o >= p THEN 'options' ELSE 'peers' END AS most_reliable,
  CASE WHEN f <= o AND f <= p THEN 'forecast' WHEN o <= p THEN 'options' ELSE 'peers' END AS least_reliable
FROM (SELECT count(*) AS total, count(*) FILTER (health = 'healthy') AS healthy_tickers, count(*) FILTER (health = 'partial') AS partial_tickers,
  count(*) FILTER (health = 'unhealthy') AS unhealthy_tickers, avg(has_forecast) AS f, avg(has_options) AS o, avg(has_peers) AS p FROM status) x"""))
def health_summary(spark, sf):
    return show(dq.health_summary(status(spark, sf)))


SYM = """CASE c_custkey % 6 WHEN 0 THEN concat('C', c_custkey) WHEN 1 THEN concat('BRK.', c_custkey) WHEN 2 THEN concat(' x-', c_custkey) WHEN 3 THEN concat('TOOLONGNAME', c_custkey)
  WHEN 4 THEN '' ELSE concat('A$', c_custkey) END"""


@CAT.add("symbol_rules", f"""
SELECT c_custkey, upper(trim(s)) AS normal, CAST(regexp_full_match(s, '[A-Za-z0-9]{{1,10}}') AS INT) AS strict_ok, CAST(length(s) BETWEEN 1 AND 10 AS INT) AS loose_ok,
       CAST(regexp_full_match(replace(replace(trim(s), '.', ''), '-', ''), '[A-Za-z0-9]+') AS INT) AS peer_ok FROM (SELECT c_custkey, {SYM} AS s FROM customer) x""")
def symbol_rules(spark, sf):
    n, key = F.col("c_custkey") % 6, F.col("c_custkey").cast("string")
    sym = (F.when(n == 0, F.concat(F.lit("C"), key)).when(n == 1, F.concat(F.lit("BRK."), key)).when(n == 2, F.concat(F.lit(" x-"), key))
           .when(n == 3, F.concat(F.lit("TOOLONGNAME"), key)).when(n == 4, "").otherwise(F.concat(F.lit("A$"), key)))
    c = b.table(spark, sf, "customer").select("c_custkey", sym.alias("s"))
    return show(c.select("c_custkey", dq.normal_symbol("s").alias("normal"), dq.strict_symbol("s").alias("strict_ok"),
                         dq.loose_symbol("s").alias("loose_ok"), dq.peer_symbol("s").alias("peer_ok")))


@CAT.add("date_range_rules", """
SELECT count(*) AS n, count(*) FILTER (a < z AND date_diff('day', a, z) <= 365) AS valid_1y, count(*) FILTER (a <= z) AS ordered, o_custkey
FROM (SELECT o_custkey, CAST(o_orderdate AS DATE) AS a, CAST(l_shipdate AS DATE) - CAST(l_linenumber * 30 AS INTEGER) AS z FROM orders JOIN lineitem ON o_orderkey = l_orderkey) x GROUP BY o_custkey""")
def date_range_rules(spark, sf):
    j = b.table(spark, sf, "orders").join(b.table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    a, z = F.to_date("o_orderdate"), F.date_sub(F.to_date("l_shipdate"), F.col("l_linenumber") * 30)
    return show(j.select("o_custkey", a.alias("a"), z.alias("z")).groupBy("o_custkey").agg(
        F.count("*").alias("n"), F.count_if(dq.valid_range(F.col("a"), F.col("z"), 1)).alias("valid_1y"),
        F.count_if(dq.ordered_range(F.col("a"), F.col("z"))).alias("ordered")))


@CAT.add("parameter_rules", """
SELECT p_partkey, CAST(g BETWEEN -1 AND 1 AND d > 0 AND d <= 1 AND y BETWEEN 1 AND 20 AS INT) AS params_ok, CAST(sc BETWEEN 0 AND 100 AND lv <> 'Maybe' AND ex <> '' AS INT) AS rec_ok
FROM (SELECT p_partkey, (p_size - 25) / 20.0 AS g, (p_partkey % 12) / 10.0 AS d, p_size AS y, p_retailprice / 10 AS sc, CASE WHEN p_partkey % 3 = 0 THEN 'Maybe' ELSE 'Buy' END AS lv,
        CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name END AS ex FROM part) x""")
def parameter_rules(spark, sf):
    p = b.table(spark, sf, "part").select(
        "p_partkey", ((F.col("p_size") - 25) / 20.0).alias("growth_rate"), ((F.col("p_partkey") % 12) / 10.0).alias("discount_rate"),
        F.col("p_size").alias("forecast_years"), (F.col("p_retailprice") / 10).alias("score"), F.when(F.col("p_partkey") % 3 == 0, "Maybe").otherwise("Buy").alias("level"),
        F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.col("p_name")).alias("explanation"))
    return show(p.select("p_partkey", dq.valid_parameters().alias("params_ok"), dq.valid_recommendation().alias("rec_ok")))


@CAT.add("series_gate", sql("prices", """
SELECT ticker, n_rows, n_valid, CASE WHEN n_valid < 500 THEN 'too short' WHEN n_valid < n_rows THEN 'has nulls' END AS reason, CAST(n_valid >= 500 AND n_valid = n_rows AS INT) AS passed
FROM (SELECT ticker, count(*) AS n_rows, count(CASE WHEN day(dt) % 31 <> 0 OR CAST(substr(ticker, 2) AS BIGINT) % 2 = 0 THEN close END) AS n_valid FROM prices GROUP BY ticker) x"""))
def series_gate(spark, sf):
    px = bars.daily(spark, sf).withColumn("close", F.when((F.day("dt") % 31 != 0) | (k() % 2 == 0), F.col("close")))
    return show(dq.series_gate(px, "close", min_length=500))


@CAT.add("frame_gate", sql("prices", """
SELECT ticker, count(*) AS n_rows, concat_ws('; ', 'missing columns: adj_close', CASE WHEN count(*) < 520 THEN 'too few rows' END) AS reasons, 0 AS passed FROM prices GROUP BY ticker"""))
def frame_gate(spark, sf):
    return show(dq.frame_gate(bars.daily(spark, sf), ["close", "adj_close"], min_rows=520))


# --- filters and reports -----------------------------------------------------

QUOTES = "last_price * 0.97 AS bid, last_price * (1.01 + iv / 10) AS ask, greatest(0.01, least(0.99, 0.5 + (spot - strike) / spot * 2)) AS delta"


def quoted(c: DataFrame) -> DataFrame:
    """Bid, ask and delta derived from the contract, which the base listing lacks."""
    return c.withColumns({
        "bid": F.col("last_price") * 0.97, "ask": F.col("last_price") * (1.01 + F.col("iv") / 10),
        "delta": F.greatest(F.lit(0.01), F.least(F.lit(0.99), 0.5 + (F.col("spot") - F.col("strike")) / F.col("spot") * 2))})


@CAT.add("custom_filters", sql("chain", f"""
SELECT ticker, side, CAST(expiry AS VARCHAR) AS expiry, {rcols('strike')}, volume, open_interest, 'No' AS custom_weights, 'Moderate' AS risk_tolerance, 'Medium-term' AS time_horizon,
  'Delta≤0.7; Vol≥25; Spread≤30.0; OI≥10' AS filtering_applied FROM (SELECT *, {QUOTES} FROM chain) x WHERE delta <= 0.7 AND volume >= 25 AND ask - bid <= 30.0 AND open_interest >= 10"""))
def custom_filters(spark, sf):
    limits = dict(max_delta=0.7, min_volume=25, max_spread=30.0, min_open_interest=10)
    t = flt.with_metadata(flt.custom_filters(quoted(b.option_chain(spark, sf)), **limits), risk="Moderate", **limits)
    return show(t.select("ticker", "side", "expiry", "strike", "volume", "open_interest", "custom_weights", "risk_tolerance", "time_horizon", "filtering_applied"))


LIMITS = {
    "within_delta": ("delta <= {max_delta}", lambda: F.col("delta") <= F.col("max_delta")),
    "long_enough": ("dte >= {min_days}", lambda: F.col("dte") >= F.col("min_days")),
    "near_the_money": ("abs(strike / spot - 1) <= {moneyness_range}", lambda: F.abs(F.col("strike") / F.col("spot") - 1) <= F.col("moneyness_range")),
    "traded": ("volume >= {min_volume}", lambda: F.col("volume") >= F.col("min_volume")),
    "held": ("open_interest >= {min_open_interest}", lambda: F.col("open_interest") >= F.col("min_open_interest")),
    "tight": ("(ask - bid) / ask <= {max_spread}", lambda: (F.col("ask") - F.col("bid")) / F.col("ask") <= F.col("max_spread")),
}


@CAT.add("risk_profile_filter", sql("chain", "\nUNION ALL\n".join(
    f"SELECT '{x}' AS risk, ticker, count(*) AS n, " + ", ".join(f"count(*) FILTER ({t.format(**p)}) AS {n}" for n, (t, _) in LIMITS.items())
    + f", count(*) FILTER ({' AND '.join(t.format(**p) for t, _ in LIMITS.values())}) AS passed FROM (SELECT *, {QUOTES} FROM chain) x GROUP BY ticker" for x, p in cfg.RISK_PROFILES.items())))
def risk_profile_filter(spark, sf):
    """Contracts of a ticker within each of the six limits of every risk profile, and within all of them."""
    t = st.at_risk_levels(quoted(b.option_chain(spark, sf)), cfg.RISK_PROFILES)
    tests = {n: test() for n, (_, test) in LIMITS.items()}
    every = F.lit(True)
    for test in tests.values():
        every = every & test
    return t.groupBy("risk", "ticker").agg(F.count("*").alias("n"), *[F.count_if(test).alias(n) for n, test in tests.items()], F.count_if(every).alias("passed"))


def merged_limits() -> dict[str, dict]:
    """Long calls: base parameters, overridden by the risk level's; the minimum of days is the default plus the level's change."""
    out = {}
    for risk in cfg.RISK_LEVELS:
        merged = cfg.risk_adjusted_params("Long Calls", risk)
        out[risk] = {"max_delta": merged["max_delta"], "min_volume": merged["min_volume"], "min_open_interest": merged["min_open_interest"],
                     "min_days": merged["default_min_days"] + merged["min_days_adjustment"]}
    return out


# written out, not merged by the code under test
MERGED_SQL = {"Conservative": (0.6, 50, 100, 210), "Moderate": (0.7, 25, 50, 180), "Aggressive": (0.9, 5, 10, 120)}


@CAT.add("strategy_params_filter", sql("chain", "\nUNION ALL\n".join(
    f"SELECT '{x}' AS risk, ticker, count(*) AS n, count(*) FILTER (delta <= {d} AND volume >= {v} AND open_interest >= {o} AND dte >= {days}) AS passed"
    f" FROM (SELECT *, {QUOTES} FROM chain WHERE side = 'C') x GROUP BY ticker" for x, (d, v, o, days) in MERGED_SQL.items())))
def strategy_params_filter(spark, sf):
    """Calls within the long-call parameters as each risk level adjusts them."""
    c = quoted(b.option_chain(spark, sf).where("side = 'C'"))
    ok = (F.col("delta") <= F.col("max_delta")) & (F.col("volume") >= F.col("min_volume")) & (F.col("open_interest") >= F.col("min_open_interest")) & (F.col("dte") >= F.col("min_days"))
    return st.at_risk_levels(c, merged_limits()).groupBy("risk", "ticker").agg(F.count("*").alias("n"), F.count_if(ok).alias("passed"))


# --- definitions ---------------------------------------------------------------

DEFINED = ["name", "description", "category", "market_outlook", "risk_profile"]
STRATEGY_ROWS = ", ".join(f"({i}, {', '.join(quoted_text(v) for v in row[1:])})" for i, row in enumerate(glossary.STRATEGIES))
register("defined", (), f"""
SELECT p_partkey AS key, concat(strategy, ' on ', p_name) AS name, concat(p_brand, ', a ', lower(p_type), ' product') AS description, p_type AS category, market_outlook, risk_profile
FROM part JOIN (VALUES {STRATEGY_ROWS}) AS s(i, strategy, market_outlook, risk_profile) ON s.i = p_partkey % {len(glossary.STRATEGIES)}""")


def definitions(spark, sf) -> DataFrame:
    """One definition for each part: a product on it by one of the strategies, with the strategy's outlook and risk."""
    rows = [F.struct(*[F.lit(v).alias(n) for n, v in zip(("strategy", "market_outlook", "risk_profile"), row[1:])]) for row in glossary.STRATEGIES]
    part = b.table(spark, sf, "part").withColumn("s", F.element_at(F.array(*rows), (F.col("p_partkey") % len(rows) + 1).cast("int")))
    return part.select(
        F.col("p_partkey").alias("key"), F.concat("s.strategy", F.lit(" on "), "p_name").alias("name"),
        F.concat("p_brand", F.lit(", a "), F.lower("p_type"), F.lit(" product")).alias("description"), F.col("p_type").alias("category"),
        "s.market_outlook", "s.risk_profile")


def indexed(spark, sf) -> DataFrame:
    """The stored index of all definitions; parts that change make a new one."""
    return ti.store(definitions(spark, sf), "key", DEFINED, f"quantloom_terms_{version(spark, f'{sf}/part.parquet')}")


SEARCHES = {
    # query: columns, searches with their words
    "definition_search": (["name", "description"], {"call": ["CALL"], "blue": ["Blue"], "brand 1 or 4": ["brand#1,", "brand#4,"], "o": ["o "], "none": ["zebra"]}),
    "category_search": (["category"], {"economy": ["economy"], "large": ["LARGE", "Standard"]}),
    "outlook_search": (["market_outlook"], glossary.OUTLOOK_WORDS),
    "risk_profile_search": (["risk_profile"], {w: [w] for w in ("limited", "unlimited", "moderate")}),
}


def search_sql(name: str) -> str:
    columns, searches = SEARCHES[name]
    return sql("defined", "\nUNION ALL\n".join(
        f"SELECT {quoted_text(s_)} AS search, key FROM defined WHERE " + " OR ".join(f"contains(lower({c}), {quoted_text(w.lower())})" for c in columns for w in words)
        for s_, words in searches.items()))


def searched(spark, sf, name: str) -> DataFrame:
    columns, searches = SEARCHES[name]
    return ti.search(indexed(spark, sf), searches, columns)


@CAT.add("definition_search", search_sql("definition_search"))
def definition_search(spark, sf):
    return searched(spark, sf, "definition_search")


@CAT.add("category_search", search_sql("category_search"))
def category_search(spark, sf):
    return searched(spark, sf, "category_search")


@CAT.add("outlook_search", search_sql("outlook_search"))
def outlook_search(spark, sf):
    return searched(spark, sf, "outlook_search")


@CAT.add("risk_profile_search", search_sql("risk_profile_search"))
def risk_profile_search(spark, sf):
    return searched(spark, sf, "risk_profile_search")


@CAT.add("keyword_search", """
SELECT doc_id, source, length(text) AS n FROM documents
WHERE contains(lower(text), 'license') OR contains(lower(text), 'password') OR contains(lower(source), 'license') OR contains(lower(source), 'password')
   OR contains(lower(text), 'src7') OR contains(lower(source), 'src7')""")
def keyword_search(spark, sf):
    d = flt.keyword_search(b.table(spark, sf, "documents"), ["text", "source"], ["license", "password", "src7"])
    return d.select("doc_id", "source", F.length("text").alias("n"))
