"""A corpus pipeline of the training-data operators over documents.

Each stage takes (spark, docs, sf_dir), works on all rows of docs, and returns a DataFrame; run()
writes every stage as Parquet into the shared folder and reads it back as the next stage's docs.
All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import jaccard_join, language_id, packing, substring_dedup, toxicity
from weftline.llm.common import checkpoint_dir, cut, hot_join, small_batches, small_side, table

#: SQL can express neither the networks nor the packing: tested against brute force instead.
ORACLE_SQL = None

#: The least mean probability that a document is in any of the learned languages.
LEAST_LANGUAGE_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter (also null and empty texts) and those no learned language fits.

    Every row is judged by its own text, whatever its doc_id.
    """
    small_batches(spark)
    return language_id.keep_known(docs, language_id.fit(docs.select("doc_id", "text", "lang")), LEAST_LANGUAGE_SCORE)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that are predicted toxic; every row is judged by its own text.

    Null and empty texts are scored as a window without words, and rejected only if that is toxic.
    """
    return toxicity.keep_clean(docs, toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the least doc_id, of each component of similar ones.

    Rows of one doc_id with different texts are documents of their own (the one with the smaller hash
    comes first); of rows equal in both one stays. Rows without doc_id are not compared and stay. Null
    and empty texts are similar to nothing.
    """
    small_batches(spark)
    text = F.xxhash64("text")
    again = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min(text).alias("x"), F.max(text).alias("y")).filter("n > 1")
    again = cut(again.select("doc_id", (F.col("x") != F.col("y")).alias("__mixed")))
    if again.isEmpty():
        found = cut(jaccard_join.join(docs.select("doc_id", "text")))
        copies = cut(found.filter("component_id <> doc_id").select("doc_id").distinct())
        return docs.join(small_side(copies, 40), "doc_id", "left_anti").select(docs.columns)
    node = F.when(F.col("__mixed"), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id").cast("long"))
    rows = docs.join(small_side(again, 40), "doc_id", "left").withColumn("__node", node)
    found = cut(jaccard_join.join(rows.select(F.col("__node").alias("doc_id"), "text")).filter("doc_id is not null").select(F.col("doc_id").alias("__node"), "component_id").distinct())
    names = rows.filter("__mixed").select("__node", F.col("doc_id").cast("long").alias("id")).distinct()
    parts = cut(found.join(names, "__node", "left").withColumn("id", F.coalesce("id", "__node")))
    first = cut(parts.groupBy("component_id").agg(F.min(F.struct("id", "__node")).alias("first"), F.count(F.lit(1)).alias("n")))
    copies = hot_join(parts, first.select("component_id", "first"), ["component_id"], first.select("component_id", "n"))
    copies = cut(copies.filter(F.col("__node") != F.col("first.__node")).select("__node"))
    left = rows.join(small_side(copies, 40), "__node", "left_anti")
    once = left.filter("__mixed is not null").dropDuplicates(["doc_id", "text"])
    return left.filter("__mixed is null").select(docs.columns).union(once.select(docs.columns))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated passages; a document that loses all its words goes.

    Rows without doc_id and null texts stay as they are; n_chars is counted anew where words went.
    """
    small_batches(spark)
    out = substring_dedup.dedup(docs)
    left = out.filter((F.col("n_removed_words") == 0) | (F.col("n_removed_words") < F.col("n_words")))
    return left.withColumn("n_chars", F.when(F.col("n_removed_words") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the texts into windows of 2048 tokens; null and empty texts are an end mark alone."""
    small_batches(spark)
    import public_tokenizers

    return packing.pack_digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("toxicity", toxic), ("near_copies", near_copies), ("repeated_passages", repeated_passages), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, base = table(spark, sf_dir, "documents"), f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs
