"""Mixing sources to target weights by entropy balancing.

Rates stay as close to one as the word targets allow, in the sense of relative entropy over words. The convex dual of that
problem has one multiplier for each constraint; a document's rate is the exponential of the multipliers of the groups it is
in, and Newton's method finds them. Rates are then rounded to whole copies, spread evenly over documents of like size.

A null text has no words, a null source is a source of its own that sorts last, null or repeated ids are fine, an empty table
gives an empty result, and further columns stay where `carry` names them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.shared import WORD, forget, stored

#: Weights of the sources in their order, repeating; a target stops at so many times the source's words.
WEIGHTS = (5, 2, 1)
MOST = 3
NEWTON_ROUNDS = 30
#: Documents of a source that are rounded together, about.
BUCKET_ROWS = 2_000


def n_words(text: Column) -> Column:
    """Number of words in the text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, source_size): weighted shares of all words, capped and shared again.

    Sources are numbered by code point, null last. With a common level v, a source's target is min(MOST * size, weight * v);
    the level is the one at which the targets add up to all words: it is found in the order in which sources reach their cap.
    """
    everything = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (number % len(WEIGHTS) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(MOST))
    # sorted by the level at which each is capped: with the k first capped, the level is (all - capped) / weights left
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("all_words", F.sum("source_size").over(everything)).withColumn("all_weight", F.sum("weight").over(everything))
    left = F.col("all_words") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rest = F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rows = rows.withColumn("level", left / rest).withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
    level = F.min(F.when(F.col("free"), F.struct((F.col("cap") / F.col("weight")).alias("reach"), "level"))).over(everything)
    target = F.least(F.col("cap"), F.col("weight") * F.coalesce(level["level"], F.lit(float("inf"))))
    return rows.select("source", "source_size", target.alias("target"))


def expected(cells: DataFrame, solution: DataFrame) -> DataFrame:
    """(one, two, words): what two constraints' common documents weigh at their tilted rates; the dual's Hessian, whose diagonal
    less the targets is its gradient.

    `cells` (cell, groups, size) holds the words of all documents of the same constraints; `solution` (number, x) a multiplier each.
    """
    tilt = cells.select("cell", F.explode("groups").alias("number")).join(solution, "number").groupBy("cell").agg(F.sum("x").alias("tilt"))
    mass = cells.join(tilt, "cell").select("groups", (F.col("size") * F.exp("tilt")).alias("mass"))
    pairs = mass.select("groups", "mass", F.explode("groups").alias("one")).select("one", F.explode("groups").alias("two"), "mass")
    return pairs.groupBy("one", "two").agg(F.sum("mass").alias("words"))


def _solved(one: np.ndarray, two: np.ndarray, value: np.ndarray, diagonal: np.ndarray, right: np.ndarray) -> np.ndarray:
    """x of H x = right for the symmetric matrix of entries (one, two, value): conjugate gradients, scaled by the diagonal."""
    scale = 1 / np.maximum(diagonal, 1e-300)
    x, rest = np.zeros(len(right)), right.copy()
    along = scaled = scale * rest
    for _ in range(4 * len(right) + 10):
        if np.abs(rest).max(initial=0.0) <= 1e-12 * np.abs(right).max(initial=1.0):
            break
        turned = np.bincount(one, weights=value * along[two], minlength=len(right))
        curve = along @ turned
        if not curve > 0:
            break
        by = (rest @ scaled) / curve
        was = rest @ scaled
        x, rest = x + by * along, rest - by * turned
        scaled = scale * rest
        along = scaled + (rest @ scaled) / was * along
    return x


def balance(rows: DataFrame, targets: DataFrame, rounds: int = NEWTON_ROUNDS) -> DataFrame:
    """Stored (number, x): the multipliers at which the documents' tilted words meet the targets, which may overlap.

    `rows` (groups, size) tells the numbers of the constraints that each document is in, at least one; `targets` (number, target) has
    targets above 0. Spark sums the dual's gradient and Hessian over the documents in every Newton round; the driver holds a row for
    each pair of constraints that share documents, of which there are few, and solves the step. A step moves no multiplier by more than one unit and is halved
    until the dual falls. Targets that contradict each other are met in the sense of the last round.
    """
    spark = rows.sparkSession
    cells = rows.groupBy(F.array_sort(F.array_distinct("groups")).alias("groups")).agg(F.sum("size").cast("double").alias("size"))
    cells = stored(cells.where("size > 0").withColumn("cell", F.xxhash64("groups")), "cells")
    wanted = {r["number"]: r["target"] for r in targets.orderBy("number").toLocalIterator()}
    numbers = np.array(sorted(wanted), np.int64)
    goal = np.array([wanted[n] for n in numbers.tolist()], float)

    def table(x: np.ndarray) -> DataFrame:
        return spark.createDataFrame(pa.table({"number": numbers, "x": x}))

    def state(x: np.ndarray) -> tuple[float, tuple, np.ndarray]:
        got = expected(cells, F.broadcast(table(x))).toArrow()
        one, two = (np.searchsorted(numbers, got.column(c).to_numpy()) for c in ("one", "two"))
        words_of = got.column("words").to_numpy()
        diagonal = np.bincount(one[one == two], weights=words_of[one == two], minlength=len(numbers))
        tilt = cells.select("size", "cell", F.explode("groups").alias("number")).join(F.broadcast(table(x)), "number").groupBy("cell", "size").agg(F.sum("x").alias("tilt"))
        words = tilt.agg(F.sum(F.col("size") * F.exp("tilt")).alias("words")).first()["words"] or 0.0
        return float(words - goal @ x), (one, two, words_of, diagonal), diagonal - goal

    x = np.zeros(len(numbers))
    if not len(x):
        return table(x)
    value, hessian, slope = state(x)
    for _ in range(rounds):
        if np.abs(slope).max() <= 1e-9 * max(goal.max(), 1.0):
            break
        step = _solved(*hessian, slope)
        step /= max(1.0, np.abs(step).max())
        for _ in range(30):
            new = state(x - step)
            if new[0] <= value:
                break
            step /= 2
        else:
            break
        x, (value, hessian, slope) = x - step, new
    forget(spark, cells)
    return table(x)


def multipliers(rows: DataFrame, rounds: int = NEWTON_ROUNDS) -> DataFrame:
    """Adds `multiplier` to (source, source_size, target): the dual's solution where every source is a constraint.

    A target of 0 leaves null (rate 0).
    """
    numbered = stored(rows.withColumn("number", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long")), "numbered")
    live = numbered.where((F.col("target") > 0) & (F.col("source_size") > 0))
    solved = balance(live.select(F.array("number").alias("groups"), F.col("source_size").alias("size")), live.select("number", "target"), rounds)
    return numbered.join(solved.withColumnRenamed("x", "multiplier"), "number", "left").drop("number")


def _copies(rate: float, size: np.ndarray) -> np.ndarray:
    """Whole copies for documents in descending size: each takes the count, next to the rate, that best pays the words owed."""
    low, high = int(np.floor(rate + 1e-9)), int(np.ceil(rate - 1e-9))
    out = np.full(len(size), low, np.int64)
    owed = 0.0
    for i, n in enumerate(size.tolist()):
        owed += (rate - low) * n
        if high > low and owed > n / 2:
            out[i] = high
            owed -= n
    return out


def mix(docs: DataFrame, *carry: str) -> DataFrame:
    """doc_id, size, source_size, target, rate, copies and taken of every document, with the `carry` columns.

    Each source is dealt into buckets of about BUCKET_ROWS documents by a digest of id and size; a bucket is rounded by
    itself, the longest documents first, so that what is left owing is less than its shortest document or two. Rows without an
    id are dealt by their text. A carried column that is named like a result column gives way to it.
    """
    made = ("doc_id", "size", "source_size", "target", "rate", "copies", "taken")
    names = [c for c in dict.fromkeys(carry) if c not in made]
    inner = [f"c{k}" for k in range(len(names))]
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null "), F.coalesce(F.md5("text"), F.lit(""))))
    sized = docs.select(F.col("doc_id"), F.col("source"), n_words(F.col("text")).alias("size"), key.alias("key"), *(F.col(c).alias(i) for c, i in zip(names, inner)))
    per_source = stored(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), "sources")
    plan = multipliers(targets(per_source.select("source", "source_size"))).withColumnRenamed("source", "of")
    plan = plan.join(per_source.select(F.col("source").alias("of_n"), "n"), F.col("of").eqNullSafe(F.col("of_n")))
    plan = stored(plan.select("of", "source_size", "target", F.coalesce(F.exp("multiplier"), F.lit(0.0)).alias("rate"), F.ceil(F.col("n") / BUCKET_ROWS).cast("long").alias("buckets")), "plan")
    rows = sized.join(plan, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    digest = F.conv(F.substring(F.md5(F.concat("key", F.lit("|"), F.col("size").cast("string"))), 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("bucket", digest % F.col("buckets")).drop("buckets", "key")

    def rounded(bucket: pa.Table) -> pa.Table:
        bucket = bucket.sort_by([("size", "descending"), ("doc_id", "ascending")])
        size = bucket.column("size").to_numpy()
        copies = _copies(bucket.column("rate")[0].as_py(), size)
        return bucket.drop_columns(["bucket"]).append_column("copies", pa.array(copies)).append_column("taken", pa.array(copies * size))

    kinds = [f for f in rows.schema.fields if f.name != "bucket"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kinds] + ["copies long", "taken long"])
    out = rows.groupBy("source", "bucket").applyInArrow(rounded, schema)
    return out.select(*made, *(F.col(i).alias(c) for c, i in zip(names, inner)))
