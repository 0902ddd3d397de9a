"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A spaced seed is the hash of the tokens that a fixed mask selects from a window; the other positions may differ. Seeds of the
test items meet seeds of the training documents in an equi-join. Around each hit the two token sequences are laid side by
side, and the hit stands when some run of aligned tokens agrees in a large enough share.

Items too short for the masks, or for some placement of the allowed substitutions in them, are sought by runs of their own
tokens: one run more than substitutions are allowed, so that one of them is always whole. So items of any length are found, and up to
SHORT tokens every alignment that the verification would accept.

Tokens are runs of letters and digits, lower-cased. Null texts and items without a token have none and are never found. Null or
repeated ids are kept apart by their text, empty tables give an empty result, and further columns are ignored. A text of any
length is one array of token hashes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed masks: 1 selects a token, 0 ignores it.
MASKS = ("111010011", "1101100101", "1100101011")
#: Aligned tokens that are judged together, and the share of them that must agree.
RUN, AGREE = 12, 0.8
#: Items of at most so many tokens are sought by runs of their own tokens.
SHORT = 13
#: `clean` takes no document out for an item of fewer tokens, which ordinary text may hold by chance.
LEAST_TOKENS = 8
#: Seeds of test items that are broadcast at most (about 40 bytes each); beyond it the join shuffles both sides.
BROADCAST_SEEDS = 1_000_000


def tokens(text: Column) -> Column:
    """Hashes of the text's tokens."""
    found = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(found, lambda w: F.xxhash64(w))


def seeds(token: str, mask: str, number: int) -> Column:
    """Array of (seed, at): the mask's hash at each position that its window fits."""
    chosen = [k for k, bit in enumerate(mask) if bit == "1"]
    fits = F.size(token) - len(mask)
    at = F.when(fits >= 0, F.sequence(F.lit(0), fits)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(F.xxhash64(F.lit(number), *[F.get(F.col(token), i + k) for k in chosen]).alias("seed"), i.alias("at")))


def runs(n: int) -> list[tuple[int, int]]:
    """(first, length) of token runs of an item of n tokens, one of which is whole in every alignment that stands."""
    window = min(n, RUN)
    parts = window - math.ceil(window * AGREE) + 1
    cuts = [window * k // parts for k in range(parts + 1)]
    return sorted({(first + a, b - a) for first in range(n - window + 1) for a, b in zip(cuts, cuts[1:])})


def masks_for(items: DataFrame) -> list[tuple[int, str]]:
    """The numbered masks that texts need for these items: the fixed ones, and whole runs of the lengths that short items ask for."""
    sizes = [r["n"] for r in items.select(F.size("token").alias("n")).where(F.col("n").between(1, SHORT)).distinct().collect()]  # at most SHORT
    return [*enumerate(MASKS), *((len(MASKS) + k, "1" * k) for k in sorted({length for n in sizes for _, length in runs(n)}))]


def with_seeds(rows: DataFrame, masks: list[tuple[int, str]], *carry: str) -> DataFrame:
    """A row for each seed of each row of (carry, token)."""
    each = F.explode(F.concat(*[seeds("token", mask, number) for number, mask in masks]))
    return rows.select(*carry, each.alias("s")).select(*carry, F.col("s.seed").alias("seed"), F.col("s.at").alias("at"))


def item_seeds(items: DataFrame, masks: list[tuple[int, str]]) -> DataFrame:
    """(item, seed, at, whole): all seeds of long items, and of short ones those of their runs; `whole` if the run is the item."""
    long = with_seeds(items.where(F.size("token") > SHORT), masks[: len(MASKS)], "item").withColumn("whole", F.lit(False))
    parts = []
    for n in range(1, SHORT + 1) if len(masks) > len(MASKS) else ():
        own = [
            F.struct(F.xxhash64(F.lit(len(MASKS) + length), *[F.get("token", F.lit(first + k)) for k in range(length)]).alias("seed"), F.lit(first).alias("at"), F.lit(length == n).alias("whole"))
            for first, length in runs(n)
        ]
        parts.append(items.where(F.size("token") == n).select("item", F.inline(F.array(*own))))
    for part in parts:
        long = long.unionByName(part)
    return long


def hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(text_hash, item, shift): items laid against texts so that some seed agrees; item token j meets text token shift + j.

    A run that is the item itself is laid only where it first stands: it cannot fit better elsewhere.
    """
    masks = masks_for(items)
    of_items = item_seeds(items, masks).withColumnRenamed("at", "item_at")
    if of_items.count() <= BROADCAST_SEEDS:
        of_items = F.broadcast(of_items)
    of_docs = with_seeds(docs.select("text_hash", tokens(F.col("text")).alias("token")), masks, "text_hash")
    shift = F.col("at") - F.col("item_at")
    laid = of_docs.join(of_items, "seed").select("text_hash", "item", shift.alias("shift"), F.when(~F.col("whole"), shift).alias("place"))
    return laid.groupBy("text_hash", "item", "place").agg(F.min("shift").alias("shift")).drop("place")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_tokens, n_agree, first_token, text_hash): test items that documents hold, one row for each pair.

    `n_agree` of the item's `n_tokens` tokens agree in the best alignment, which begins at the text's token `first_token`.
    """
    items = benchmark.where("text is not null").select(F.col("item_id"), tokens(F.col("text")).alias("token")).distinct()
    items = items.withColumn("item", F.xxhash64("item_id", "token"))
    docs = docs.where("text is not null").select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    found = hits(docs, items)
    pairs = docs.join(found, "text_hash").select("doc_id", "text_hash", "item", "shift", tokens(F.col("text")).alias("doc_token"))
    pairs = pairs.join(items, "item")
    last = F.size("token") - 1
    same = F.transform(F.sequence(F.lit(0), last), lambda j: F.when(F.get("doc_token", F.col("shift") + j) == F.get("token", j), 1).otherwise(0))
    pairs = pairs.withColumn("same", same).withColumn("run", F.least(F.size("token"), F.lit(RUN)))
    agreed = lambda at: F.aggregate(F.slice("same", at + 1, F.col("run")), F.lit(0), lambda a, b: a + b)
    best = F.array_max(F.transform(F.sequence(F.lit(0), F.size("token") - F.col("run")), agreed))
    pairs = pairs.where(best >= F.ceil(F.col("run") * AGREE))
    pairs = pairs.withColumn("best", F.struct(F.aggregate("same", F.lit(0), lambda a, b: a + b).alias("n_agree"), (-F.col("shift")).alias("back"), F.size("token").alias("n_tokens")))
    top = pairs.groupBy("doc_id", "text_hash", "item_id").agg(F.max("best").alias("best"))
    return top.select("doc_id", "item_id", F.col("best.n_tokens").cast("long").alias("n_tokens"), F.col("best.n_agree").cast("long").alias("n_agree"), (-F.col("best.back")).cast("long").alias("first_token"), "text_hash")


def clean(docs: DataFrame, benchmark: DataFrame, least_tokens: int = LEAST_TOKENS) -> DataFrame:
    """The documents that hold no test item of at least `least_tokens` tokens, all columns."""
    bad = contaminated(docs.select("doc_id", "text"), benchmark).where(F.col("n_tokens") >= least_tokens).select(F.col("text_hash").alias("bad_hash"), F.col("doc_id").alias("bad_id")).distinct()
    return docs.join(bad, (F.xxhash64(docs["text"]) == F.col("bad_hash")) & docs["doc_id"].eqNullSafe(F.col("bad_id")), "left_anti")
