"""The folder that the driver and all executors share, for tables that outlive one query."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from functools import cache

from pyarrow import fs
from pyspark.sql import SparkSession


@cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="quantloom-")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or what was given to setCheckpointDir.

    Where neither is set, a folder of this process serves a session whose executors are in the same process; a cluster must name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors can reach")
    return _own_dir()


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def version(spark: SparkSession, path: str) -> str:
    """Tells states of a table's files apart: names, sizes and times of change of all files below `path`."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    files, out = root.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(root, True), []
    while files.hasNext():
        f = files.next()
        out.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return uuid.uuid5(uuid.NAMESPACE_URL, "\n".join(sorted(out))).hex


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps now; it does so once the driver has collected what referred to them."""
    gc.collect()
    spark._jvm.System.gc()


def opened(file: str):
    """A seekable file of any store that pyarrow knows, for tasks that read what an earlier step left in the shared folder."""
    store, path = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", file))
    return store.open_input_file(path)
