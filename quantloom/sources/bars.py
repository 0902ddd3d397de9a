"""Daily bars as a stored table, bucketed by ticker and sorted by (ticker, day).

The first query that asks for the bars of some trades folds them once and writes the table; all later ones read it. A window
or aggregate by ticker over it needs no exchange, and the trades are not scanned again. New or changed trade files make a new
table.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.sources import bindings
from quantloom.sources.shared import new_path, version


def store(px: DataFrame, name: str, buckets: int | None = None) -> None:
    """Writes bars (ticker, dt, ...) as table `name`: one sorted file a bucket, in the shared folder."""
    spark = px.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # dealt as the buckets are, so that every task writes one file
    rows = px.repartition(buckets, "ticker")
    rows.write.bucketBy(buckets, "ticker").sortBy("ticker", "dt").option("path", new_path(spark, name)).mode("ignore").saveAsTable(name)


def daily(spark: SparkSession, sf_dir: str, *, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """The same rows as ``bindings.prices``, from the stored table; [start, end] dates reach its scan."""
    name = f"quantloom_bars_{version(spark, f'{sf_dir}/lineitem.parquet')}"
    if not spark.catalog.tableExists(name):
        store(bindings.prices(spark, sf_dir), name)
    px = spark.table(name).where(F.col("ticker").isNotNull() & F.col("dt").isNotNull())
    if start is not None:
        px = px.where(F.col("dt") >= F.lit(start))
    if end is not None:
        px = px.where(F.col("dt") <= F.lit(end))
    return px
