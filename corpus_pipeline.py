"""The corpus pipeline: stages over `documents`, each written as Parquet and read again as the next one's input.

`run` gives the mixed corpus: the documents that quality rules, toxicity, near-duplicate removal and decontamination keep,
with the number of copies that the mix takes of each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import decontaminate, jaccard, mixing, perplexity, toxicity
from quantloom.llm.shared import fold, read, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules, their language's perplexity band and its bound on excess over good documents keep."""
    hashed = docs.withColumn("text_hash", F.xxhash64("text"))
    bad = perplexity.judge(hashed, "doc_id", "text_hash", labels=read(spark, sf_dir, "labels")).where(~F.col("kept"))
    bad = bad.select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash"), F.col("lang").alias("bad_lang")).distinct()
    same = docs["doc_id"].eqNullSafe(F.col("bad_id")) & F.xxhash64(docs["text"]).eqNullSafe(F.col("bad_hash"))
    return docs.join(bad, same & (F.coalesce(docs["lang"], F.lit("")) == F.col("bad_lang")), "left_anti").select(*COLUMNS)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below one half."""
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return toxicity.score(docs, model, *COLUMNS).where("score < 0.5").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest doc_id (null last), then content hash.

    Row numbers keep rows of equal or null ids apart, but do not choose, so that reruns keep the same documents.
    """
    rows = stored(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "rows")
    groups = jaccard.join(rows.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "class_id")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64(*COLUMNS).alias("content"), "row")
    chosen = rows.select("row", order.alias("order")).join(groups, "row").groupBy("class_id").agg(F.min("order").alias("first"))
    return rows.join(chosen.select("first.row"), "row", "left_semi").select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how often it takes them."""
    return mixing.mix(docs, *COLUMNS).where("copies > 0").select(*COLUMNS, "copies", "taken", "target")


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", without_toxic),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("mixing", mixed),
]

#: Trained models and similarity groups are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
