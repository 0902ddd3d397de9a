"""The registered queries of this subpackage: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

import string

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import bytepair, decontaminate, extract, jaccard, language, lexical, mixing, perplexity, reputation, spelling, tokencounts, toxicity, warc
from quantloom.llm.shared import fold, new_path, read

URL_RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The id that the vocabulary leaves free for the end of a document.
END_OF_DOCUMENT = 50_256
#: How that vocabulary cuts a text before it merges bytes (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages, with the passage and where it stands."""
    found = decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_tokens", "n_agree", "first_token")


def page_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, bad): a page shows the document whose number its path has; bad is of low quality or toxic."""
    number = F.regexp_extract(reputation.path_of(F.col("url")), r"/(\d{1,18})", 1)
    pages = read(spark, sf_dir, "pages").select("page_id", number.try_cast("long").alias("doc_id"))
    labels = read(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))
    return pages.join(labels, "doc_id").select("page_id", "bad")


def op2_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = reputation.judge(read(spark, sf_dir, "pages"), page_outcomes(spark, sf_dir), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write(read(spark, sf_dir, "pages"), path)
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", fold("doc_id", 4) == 2)
    model = language.train(docs.where("not held_out"))
    return language.predict(docs.select("doc_id", "held_out", "text"), model, "doc_id", "held_out")


def op5_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = perplexity.judge(read(spark, sf_dir, "documents"), "doc_id", labels=read(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "perplexity", "deviation")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    scores = toxicity.score(docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "text"), model, "doc_id", "held_out")
    return scores.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def op8_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(read(spark, sf_dir, "pages"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted from flat files of the documents' tokens."""
    docs, path = read(spark, sf_dir, "documents"), new_path(spark, "tokens")
    tokencounts.write(docs, path, tokencounts.byte_pairs(TOKENIZER, PATTERN), END_OF_DOCUMENT)
    counted = tokencounts.count(spark, path, END_OF_DOCUMENT).withColumn("part", tokencounts.part_of())
    # both sides have a row for each document: neither may be broadcast, however small its shuffled form looks
    return tokencounts.manifest(docs, "doc_id").join(counted.hint("merge"), ["part", "number"]).select("doc_id", "part", "number", "n_tokens")


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(read(spark, sf_dir, "documents"))


def op11_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's tokens, decoded again; the file of ranks is read on the driver."""
    vocabulary = bytepair.Vocabulary.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    tokens = bytepair.encode(read(spark, sf_dir, "documents"), vocabulary, "doc_id")
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    found = bytepair.decode(tokens, vocabulary, "doc_id", "ids")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def written_words(docs: DataFrame, least: int = 7) -> DataFrame:
    """(word, n): runs of letters of at least `least` code points; by a hash of id and run, one in 31 lacks a letter."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(f"[A-Za-z\u00C0-\u00FF]{{{least},}}"), F.lit(0))).alias("run"))
    lower = F.translate("run", string.ascii_uppercase, string.ascii_lowercase)
    runs = runs.select("id", F.when(F.col("run").rlike("[A-Z]"), lower).otherwise(F.col("run")).alias("run"))
    drawn = runs.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.left("run", at), F.substr("run", at + 2))
    words = drawn.select(F.when(F.col("h") % 31 == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.char_length("word") >= least).groupBy("word").agg(F.count("*").alias("n"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = written_words(read(spark, sf_dir, "documents")).where("n >= 2")
    return spelling.group(words).select("word", "form", "root", "n", "n_near", "form_n")


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.build(read(spark, sf_dir, "documents")), read(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH doc_terms AS (
  SELECT row, doc_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS run
  FROM (SELECT row_number() OVER () AS row, doc_id, text FROM documents)),
doc_tf AS (
  SELECT row, doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term, count(*) AS tf
  FROM doc_terms GROUP BY ALL),
lengths AS (SELECT row, sum(tf)::BIGINT AS n FROM doc_tf GROUP BY row),
totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM lengths),
weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM doc_tf, totals GROUP BY term, docs),
item_terms AS (
  SELECT item, item_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS run
  FROM (SELECT row_number() OVER () AS item, item_id, text FROM benchmark)),
item_tf AS (
  SELECT item, item_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term, count(*) AS times
  FROM item_terms GROUP BY ALL),
scores AS (
  SELECT item, item_id, row, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::BIGINT AS score
  FROM item_tf JOIN weights USING (term) JOIN doc_tf USING (term) JOIN lengths USING (row), totals
  GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10
"""

QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_host_reputation, op3_warc, op4_language, op5_perplexity, op6_toxicity, op7_mixing, op8_extract, op9_token_counts, op10_jaccard, op11_byte_pairs, op12_spelling, op13_lexical)}
ORACLES: dict[str, str] = {"op13_lexical": OP13_SQL}
