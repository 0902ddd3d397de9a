"""Substring search over an inverted index of character triples.

`postings` lists where every run of three characters (fewer at the end) stands in which column of which row, lower-cased. A word
stands in a text exactly where its own triples stand one after another, so `search` joins the triples of all words with the
postings, counts those that agree on where the word begins, and never reads the texts. Words of one or two characters are
found by the beginning of a triple. The stored table is sorted by triple: a search reads the row groups of its own triples only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.sources.shared import new_path

WIDTH = 3


def triples(text: Column) -> Column:
    """All runs of three characters of a lower-cased text in order; the last ones are shorter."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"(?s)(?=(.{{1,{WIDTH}}}))"), F.lit(1))


def postings(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(triple, column, key, at) of all columns; a NULL text has none."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("text")) for c in columns]))
    rows = df.select(F.col(key).alias("key"), cells.alias("cell"))
    return rows.select(F.col("cell.column").alias("column"), "key", F.posexplode(triples(F.col("cell.text"))).alias("at", "triple")).select("triple", "column", "key", "at")


def store(df: DataFrame, key: str, columns: list[str], name: str) -> DataFrame:
    """The postings as table `name`, sorted by triple over all files; a name that exists already is only read."""
    spark = df.sparkSession
    if not spark.catalog.tableExists(name):
        rows = postings(df, key, columns).repartitionByRange("triple", "key").sortWithinPartitions("triple", "column", "key", "at")
        rows.write.option("path", new_path(spark, name)).mode("ignore").saveAsTable(name)
    return spark.table(name)


def search(index: DataFrame, searches: dict[str, list[str]], columns: list[str]) -> DataFrame:
    """(search, key): the rows that hold one of a search's words in one of the columns, whatever the case."""
    spark: SparkSession = index.sparkSession
    words = [(s, w) for s, listed in searches.items() for w in listed]
    given = spark.createDataFrame(words, "search string, word string").select("search", F.lower("word").alias("word"))
    # the caller's words: a few rows
    asked = given.select("search", "word", F.posexplode(triples(F.col("word"))).alias("offset", "triple")).where(
        (F.char_length("triple") == WIDTH) | (F.char_length("word") < WIDTH) & (F.col("offset") == 0)
    )
    asked = asked.withColumn("need", F.greatest(F.lit(1), F.char_length("word") - WIDTH + 1)).collect()
    whole = [r for r in asked if len(r["triple"]) == WIDTH]
    hits = index.where(F.col("column").isin(columns))
    found = spark.createDataFrame([], f"search string, key {index.schema['key'].dataType.simpleString()}")
    if whole:
        places = spark.createDataFrame([(r["search"], r["word"], r["need"], r["offset"], r["triple"]) for r in whole], "search string, word string, need int, offset int, triple string")
        own = hits.where(F.col("triple").isin(sorted({r["triple"] for r in whole}))).join(F.broadcast(places), "triple")
        begins = own.groupBy("search", "word", "need", "key", "column", (F.col("at") - F.col("offset")).alias("begin")).agg(F.count("*").alias("n"))
        found = found.unionByName(begins.where("n = need").select("search", "key"))
    for r in (r for r in asked if len(r["triple"]) < WIDTH):
        found = found.unionByName(hits.where(F.col("triple").startswith(r["word"])).select(F.lit(r["search"]).alias("search"), "key"))
    return found.distinct()
