"""Statement normalisation on long facts: (ticker, statement, period_end, line_item, ord, value).

``ord`` is the item's position in its source, so that collisions resolve in
input order.  Synonyms are a small broadcast table; fuzzy matching only ever
sees the distinct unmatched labels.
"""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.config import statements as cfg

KEYS = ["ticker", "statement", "period_end"]


def to_long(wide: DataFrame, items: list[str], statement: str, keys=("ticker", "period_end")) -> DataFrame:
    """One row per item and period (the vendor layout's transpose is the inverse)."""
    order = F.create_map(*[x for i, n in enumerate(items) for x in (F.lit(n), F.lit(i))])
    long = wide.select(*keys, *[F.col(i).cast("double") for i in items]).unpivot(list(keys), items, "line_item", "value")
    return long.select(
        *keys, F.lit(statement).alias("statement"), "line_item", F.element_at(order, F.col("line_item")).alias("ord"), "value"
    )


def to_vendor_layout(long: DataFrame, key="ticker", item="line_item") -> DataFrame:
    """Vendor rows: one an item, its periods (ISO labels) and values as a map, so periods need not be known before they are read.

    An item has one value a period; of several the last in input order stays.
    """
    cell = F.struct(F.date_format("period_end", "yyyy-MM-dd").alias("period"), F.col("value"))
    last = long.groupBy(key, item, "period_end").agg(F.max_by("value", "ord").alias("value"))
    return last.groupBy(key, item).agg(F.map_from_entries(F.collect_list(cell)).alias("periods"))


def from_vendor_layout(table: DataFrame, statement: str, key="ticker", item="line_item") -> DataFrame:
    """Long facts from vendor rows, whose periods are a map column ``periods`` or else all further columns, by their names."""
    if "periods" in table.columns:
        long = table.select(key, item, F.explode("periods").alias("_p", "value"))
    else:
        long = table.unpivot([key, item], [c for c in table.columns if c not in (key, item)], "_p", "value")
    return long.select(
        key, F.lit(statement).alias("statement"), F.to_date("_p").alias("period_end"), F.col(item).alias("line_item"),
        F.lit(0).alias("ord"), "value",
    )


def to_wide(long: DataFrame, items: list[str], keys=("ticker", "period_end"), fill: float | None = None,
            item: str = "line_item") -> DataFrame:
    """Pivot on a fixed item list: absent items become NULL (or ``fill``) columns, no value scan."""
    wide = long.groupBy(*keys).pivot(item, items).agg(F.first("value", ignorenulls=True))
    return wide if fill is None else wide.fillna(fill, subset=items)


def fold(c: Column) -> Column:
    """Matching key: lower case, every separator a space."""
    return F.lower(F.regexp_replace(c, r"[ _.\-]", " "))


def fold_text(text: str) -> str:
    for sep in "_.-":
        text = text.replace(sep, " ")
    return text.lower()


def synonym_rows(mapping: dict[str, dict[str, list[str]]] | None = None) -> list[tuple[str, str, str]]:
    mapping = mapping or cfg.STATEMENTS
    rows: dict[tuple[str, str], str] = {}
    for statement, table in mapping.items():
        for canonical, names in table.items():
            for n in [canonical, *names]:
                rows[(statement, fold_text(n))] = canonical
    return [(s, k, c) for (s, k), c in rows.items()]


def synonym_table(spark: SparkSession, mapping=None) -> DataFrame:
    return spark.createDataFrame(synonym_rows(mapping), "statement string, key string, canonical string")


def shared_characters(labels: list[str], names: list[str]) -> np.ndarray:
    """labels x names: how many characters two texts share, repeats counted. No matching of the two is longer."""
    alphabet = sorted(set("".join(labels)) & set("".join(names)))
    counts = [np.array([[t.count(c) for c in alphabet] for t in texts], np.int32).reshape(len(texts), len(alphabet)) for texts in (labels, names)]
    out = np.zeros((len(labels), len(names)), np.int32)
    for c in range(len(alphabet)):
        out += np.minimum(counts[0][:, c : c + 1], counts[1][None, :, c])
    return out


def common_subsequence(a: str, masks: dict[str, int], size: int) -> int:
    """Length of the longest common subsequence of `a` and a text of `size` characters, given as the bits where each stands."""
    row = full = (1 << size) - 1
    for c in a:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return size - row.bit_count()


def best_match(label: str, names: list[str], shared: np.ndarray, cutoff: float) -> tuple[str | None, float | None]:
    """The name of highest difflib ratio of at least `cutoff` (of equal ones the last in order), and that ratio.

    A ratio is twice the matched characters over both lengths. Neither the shared characters nor the longest common
    subsequence are ever fewer than the matched ones, so names are tried by falling bound until none can be better.
    """
    sizes = np.array([len(n) for n in names]) + len(label)
    bound = np.where(sizes > 0, 2.0 * shared / np.maximum(sizes, 1), 1.0)
    masks: dict[str, int] = {}
    for i, c in enumerate(label):
        masks[c] = masks.get(c, 0) | 1 << i
    matcher = difflib.SequenceMatcher()
    matcher.set_seq2(label)
    best: tuple[float, str] | None = None
    for k in np.argsort(-bound, kind="stable"):
        least = cutoff if best is None else best[0]
        if bound[k] < least:
            break
        if sizes[k] and 2.0 * common_subsequence(names[k], masks, len(label)) / sizes[k] < least:
            continue
        matcher.set_seq1(names[k])
        found = (matcher.ratio(), names[k])
        if found[0] >= cutoff and (best is None or found > best):
            best = found
    return (None, None) if best is None else (best[1], best[0])


def closest(cutoff: float, mapping=None):
    """Arrow UDF (statement, folded label) -> canonical and ratio of the best difflib match of at least ``cutoff``, or NULLs.

    Names that two bounds prove to be below the cutoff, or below a better match, are never compared.
    """
    table: dict[str, dict[str, str]] = {}
    for s, k, c in synonym_rows(mapping):
        table.setdefault(s, {})[k] = c

    def match(statement: pd.Series, key: pd.Series) -> pd.DataFrame:
        out: list[tuple[str | None, float | None]] = [(None, None)] * len(key)
        of = statement.to_numpy()
        for s, known in table.items():
            names = list(known)
            rows = np.flatnonzero((of == s) & key.notna().to_numpy())
            for at in range(0, len(rows), 1024):
                some = rows[at : at + 1024]
                labels = [key.iloc[i] for i in some]
                for i, label, shared in zip(some, labels, shared_characters(labels, names)):
                    name, ratio = best_match(label, names, shared, cutoff)
                    out[i] = (known.get(name), ratio) if name is not None else (None, None)
        return pd.DataFrame(out, columns=["canonical", "ratio"]).astype({"canonical": "object", "ratio": "float64"})

    match.__annotations__ = {"statement": pd.Series, "key": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(match, "canonical string, ratio double")


def label_map(long: DataFrame, cutoff: float = 0.8, suggest: float = 0.6, mapping=None) -> DataFrame:
    """(statement, line_item) -> canonical, how it was matched, and a weak suggestion if unmatched.

    Works on the distinct labels; unmatched labels keep their own name.
    """
    labels = long.select("statement", "line_item").distinct().withColumn("key", fold(F.col("line_item")))
    exact = labels.join(synonym_table(long.sparkSession, mapping), ["statement", "key"], "left")
    known = exact.where(F.col("canonical").isNotNull()).withColumns(
        {"how": F.lit("exact"), "suggestion": F.lit(None).cast("string")}
    )
    rest = exact.where(F.col("canonical").isNull()).withColumn("_f", closest(min(cutoff, suggest), mapping)("statement", "key"))
    fuzzy = F.coalesce(F.col("_f.ratio") >= cutoff, F.lit(False))
    rest = rest.select(
        "statement", "key", "line_item",
        F.when(fuzzy, F.col("_f.canonical")).otherwise(F.col("line_item")).alias("canonical"),
        F.when(fuzzy, "fuzzy").otherwise("unmapped").alias("how"),
        F.when(~fuzzy & (F.col("_f.ratio") >= suggest), F.col("_f.canonical")).alias("suggestion"),
    )
    return known.select(*rest.columns).unionByName(rest).drop("key")


def standardize(long: DataFrame, mode: str = "first", cutoff: float | None = None, mapping=None) -> DataFrame:
    """Canonical items per period; items that fall on one canonical are merged.

    ``mode="first"``: the first non-null in input order (cutoff .8).
    ``mode="sum"``: their sum, missing counted as zero (cutoff .7).
    """
    if mode not in ("first", "sum"):
        raise ValueError(f"unknown collision mode {mode!r}")
    cutoff = cutoff if cutoff is not None else {"first": 0.8, "sum": 0.7}[mode]
    # label_map has one row per distinct label; AQE broadcasts it when it is small
    j = long.join(label_map(long, cutoff, mapping=mapping).select("statement", "line_item", "canonical"), ["statement", "line_item"])
    if mode == "first":
        value = F.min_by("value", F.when(F.col("value").isNotNull(), F.col("ord")))
    else:
        value = F.sum(F.coalesce("value", F.lit(0.0)))
    return j.groupBy(*KEYS, F.col("canonical").alias("line_item")).agg(value.alias("value"))


def first_existing(df: DataFrame, names: list[str]) -> Column | None:
    """The first candidate column the frame has."""
    for n in names:
        if n in df.columns:
            return F.col(f"`{n}`")
    return None
