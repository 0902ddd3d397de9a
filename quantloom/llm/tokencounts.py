"""Document token counts by a separator scan of flat, unindexed token files.

`write` makes such files: token ids of fixed width, documents one after another, each ended by the end-of-document id.
`count` knows nothing but the files: tasks search blocks for the separator in one vectorised step, each block tells its
separators and what is left over after the last one, and a prefix scan over the blocks of a file stitches documents together
that begin in an earlier block.

A null text is a document of no tokens, repeated rows are documents of their own, an empty table gives no document, further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.llm import rawfiles

#: Bytes of a block; a multiple of the id width.
BLOCK = 8 << 20
Encoder = Callable[[list[str]], list[list[int]]]


def byte_pairs(ranks_file: str, pattern: str) -> Callable[[], Encoder]:
    """A maker of encoders from a public vocabulary in rank form; it is called inside the tasks."""

    def make() -> Encoder:
        import base64

        import tiktoken

        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [coder.encode_ordinary(text) for text in texts]

    return make


def write(docs: DataFrame, path: str, make: Callable[[], Encoder], separator: int, width: int = 2) -> None:
    """Writes the tokens of `text` to flat files in the order of the rows of each partition."""
    kind = np.dtype(f"<u{width}")

    def encode(batches):
        encoder = None
        for batch in batches:
            encoder = encoder or make()
            for at in range(0, batch.num_rows, 64):
                texts = batch.column("text").slice(at, 64).to_pylist()
                tokens = [np.asarray(t, kind).tobytes() for t in encoder([t or "" for t in texts])]
                yield pa.RecordBatch.from_pydict({"tokens": pa.array(tokens, pa.binary())})

    rawfiles.write(docs.select("text").mapInArrow(encode, "tokens binary"), "tokens", path, np.array([separator], kind).tobytes())


def _blocks(spark: SparkSession, path: str, separator: int, width: int, size: int) -> DataFrame:
    """A row for each block: its separators, the tokens before the first and after the last, and the counts between them."""
    kind = np.dtype(f"<u{width}")

    def scan(batches):
        for batch in batches:
            for file, start, stop in zip(*[batch.column(c).to_pylist() for c in ("file", "start", "stop")]):
                with rawfiles.opened(file) as source:
                    source.seek(start)
                    tokens = np.frombuffer(source.read(stop - start), kind)
                at = np.flatnonzero(tokens == separator)
                whole = len(at) > 0
                yield pa.RecordBatch.from_pydict({
                    "file": [file], "start": [start], "ends": pa.array([len(at)], pa.int64()), "head": pa.array([at[0] if whole else len(tokens)], pa.int64()),
                    "tail": pa.array([len(tokens) - at[-1] - 1 if whole else len(tokens)], pa.int64()), "inner": pa.array([np.diff(at) - 1], pa.list_(pa.int64())),
                })

    return rawfiles.ranges(spark, path, size).mapInArrow(scan, "file string, start long, ends long, head long, tail long, inner array<long>")


def count(spark: SparkSession, path: str, separator: int, width: int = 2, size: int = BLOCK) -> DataFrame:
    """(file, number, n_tokens): the n-th document of each file and its tokens, the separator not counted.

    Tokens after a file's last separator are a document as well.
    """
    blocks = _blocks(spark, path, separator, width, size - size % width)
    order = Window.partitionBy("file").orderBy("start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # what was left over since the last block with a separator; that block is told by the separators before this one
    blocks = blocks.withColumn("first", F.coalesce(F.sum("ends").over(before), F.lit(0)))
    since = Window.partitionBy("file", "first").orderBy("start")
    carried = F.sum(F.when(F.col("ends") == 0, F.col("tail"))).over(since.rowsBetween(Window.unboundedPreceding, -1))
    last_tail = F.last(F.when(F.col("ends") > 0, F.col("tail")), ignorenulls=True).over(before)
    blocks = blocks.withColumn("carried", F.coalesce(carried, F.lit(0)) + F.coalesce(last_tail, F.lit(0)))
    last = F.lead("start").over(order).isNull()
    left = F.when(F.col("ends") > 0, F.col("tail")).otherwise(F.col("carried") + F.col("tail"))
    blocks = blocks.withColumn("open", last & (left > 0)).withColumn("left", left)
    counts = F.when(F.col("ends") > 0, F.concat(F.array(F.col("carried") + F.col("head")), "inner")).otherwise(F.array().cast("array<long>"))
    counts = F.when(F.col("open"), F.concat(counts, F.array("left"))).otherwise(counts)
    return blocks.select("file", "first", F.posexplode(counts).alias("k", "n_tokens")).select("file", (F.col("first") + F.col("k")).alias("number"), "n_tokens")


def manifest(docs: DataFrame, *carry: str) -> DataFrame:
    """(part, number, carry): where `write` puts each row. Only for rows straight from a scan, whose partitions are stable."""
    place = F.monotonically_increasing_id()
    return docs.select(*carry, F.shiftright(place, 33).cast("int").alias("part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("number"))


def part_of(file: str = "file"):
    """The number of the partition that wrote a file."""
    return F.regexp_extract(file, r"part-(\d+)", 1).cast("int")
