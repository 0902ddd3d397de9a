"""Flat binary files in the shared folder: written by Spark's own committers, read by byte ranges inside tasks."""

from __future__ import annotations

import re

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write(df: DataFrame, column: str, path: str, end: bytes) -> None:
    """Writes the bytes of a binary column one row after another, each followed by `end`.

    The text writer copies a string's bytes as they are, so lost tasks and double attempts are dealt with as for any table.
    """
    df.select(F.col(column).cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", end.decode("latin-1")).text(path)


def ranges(spark: SparkSession, path: str, size: int) -> DataFrame:
    """(file, length, start, stop): the byte ranges of all files of a folder, dealt over the tasks. No content is read."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length").where("length > 0")
    each = files.select("file", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))).alias("start"))
    each = each.withColumn("stop", F.least(F.col("start") + size, F.col("length")))
    return each.repartition(spark.sparkContext.defaultParallelism * 4, "file", "start")


def opened(file: str):
    """A seekable file of any store that pyarrow knows."""
    store, path = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", file))
    return store.open_input_file(path)
