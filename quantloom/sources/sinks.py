"""Writers.  Files are written by the executors; nothing is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.formatting import fixed
from quantloom.operators.pairs import judged_edges


def export_view(df: DataFrame, **constants: str) -> DataFrame:
    """Flat text-friendly form: doubles with four decimals, dates ISO, maps and arrays as JSON, constants first."""
    out: list[Column] = [F.lit(v).alias(k) for k, v in constants.items()]
    for f in df.schema.fields:
        kind, c = f.dataType.typeName(), F.col(f"`{f.name}`")
        if kind in ("double", "float", "decimal"):
            c = fixed(c.cast("double"), 4)
            c = F.when(F.col(f"`{f.name}`").isNotNull(), c)
        elif kind == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        elif kind in ("map", "array", "struct"):
            c = F.to_json(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def _in_order(df: DataFrame, order_by: list[str] | None) -> DataFrame:
    """Rows in order within and across the files (a range shuffle); untouched without keys."""
    return df.orderBy(*order_by) if order_by else df


def write_csv(df: DataFrame, path: str, mode: str = "error", order_by: list[str] | None = None, **constants: str) -> None:
    """``order_by``: sort keys, compared as the values they are, not as the exported text (a chain: expiry, strike)."""
    export_view(_in_order(df, order_by), **constants).write.mode(mode).option("header", True).csv(path)


def as_json(df: DataFrame, out: str = "report") -> DataFrame:
    """One JSON document per row."""
    return df.select(F.to_json(F.struct("*")).alias(out))


def write_json(df: DataFrame, path: str, mode: str = "error", order_by: list[str] | None = None) -> None:
    _in_order(df, order_by).write.mode(mode).json(path)


def write_parquet(df: DataFrame, path: str, mode: str = "error", partition_by: list[str] | None = None) -> None:
    w = df.write.mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


#: Parts of a stored edge table; an upsert rewrites only those that hold a ticker it replaces.
EDGE_PARTS = 64


def _parted(edges: DataFrame, parts: int) -> DataFrame:
    return edges.select("ticker", "peer", F.pmod(F.xxhash64("ticker"), F.lit(parts)).cast("int").alias("part"))


def write_edges(edges: DataFrame, path: str, mode: str = "error", parts: int = EDGE_PARTS) -> None:
    """A peer table that `merge_edges` can change in place: one folder for each part of the tickers."""
    _parted(edges, parts).repartition("part").write.mode(mode).partitionBy("part").parquet(path)


def merge_edges(spark: SparkSession, path: str, incoming: DataFrame, parts: int = EDGE_PARTS) -> dict[str, int]:
    """Replaces the peer lists of the incoming tickers in a table of `write_edges`; the counts are observed while it is written.

    Only the parts with such a ticker are read and overwritten. The same edges once more leave the table as it is.
    """
    accepted, replaced = Observation(), Observation()
    judged = judged_edges(incoming)
    new = _parted(judged.where("reason IS NULL"), parts)
    tickers = new.select("ticker").distinct().withColumn("gone", F.lit(True))
    seen = judged.observe(
        accepted, F.count_if(F.col("reason").isNull()).alias("accepted"),
        F.coalesce(F.sum(F.when(F.col("reason") == "malformed", F.col("copies"))), F.lit(0)).alias("malformed"),
        F.coalesce(F.sum(F.when(F.col("reason") == "self", F.col("copies"))), F.lit(0)).alias("self_references"),
    )
    current = spark.read.schema("ticker string, peer string, part int").parquet(path)
    kept = (
        current.join(new.select("part").distinct(), "part", "left_semi").join(tickers, "ticker", "left")
        .observe(replaced, F.count_if("gone").alias("replaced")).where("gone IS NULL").select("ticker", "peer", "part")
    )
    merged = kept.unionByName(_parted(seen.where("reason IS NULL"), parts))
    # dynamic: files go to a staging folder first and then take the place of the parts they belong to
    merged.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    counts = {**accepted.get, **replaced.get}
    return {**counts, "rejected": counts["malformed"] + counts["self_references"]}
