"""A training corpus from the table of documents: five stages, each a decision about whole documents or lines.

Every stage takes (spark, docs, sf_dir), where docs has the columns of the documents table, and
returns those columns; the last one returns the encoded documents.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainwitness.llm import bpe, decontamination, jaccard_join, language_id, line_dedup
from chainwitness.llm.catalog import tokenizer_file
from chainwitness.llm.common import identified, stage, table, text_key, without
from chainwitness.session import ship_package

#: SQL has no statement for learned languages or for the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without a letter, or without text, go.

    Languages are learned from the labelled part of the same documents; a missing label becomes the
    learned language, a given one stays.
    """
    ship_package(spark)
    found = language_id.predict(identified(docs), language_id.sample(docs))
    found = stage(found.select("_id", "_hash", "lang_pred"), "languages")
    rows = without(identified(docs, carry=True), found.where(F.col("lang_pred") == language_id.UNKNOWN))
    missing = rows.where("_row.lang is null")
    names = found.select(F.col("_id").alias("i"), F.col("_hash").alias("h"), "lang_pred").distinct()
    learned = missing.join(names, missing["_id"].eqNullSafe(names["i"]) & (missing["_hash"] == names["h"]))
    learned = learned.select(*(F.col("lang_pred" if c == "lang" else f"_row.`{c}`").alias(c) for c in docs.columns))
    return rows.where("_row.lang is not null").select("_row.*").unionByName(learned)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier one; those that lose all their words go."""
    ship_package(spark)
    left = line_dedup.remove_lines(identified(docs, carry=True))
    left = left.where((F.col("_n_removed") == 0) | F.col("_kept").rlike("[^ \\t-\\r]"))
    text = {"text": F.col("_kept"), "n_chars": F.when(F.col("_n_removed") == 0, F.col("_row.n_chars")).otherwise(F.length("_kept"))}
    return left.select(*(text.get(c, F.col(f"_row.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each class of near-duplicates."""
    ship_package(spark)
    stays = jaccard_join.linked(identified(docs)).groupBy("_id", "_hash").agg(F.count(F.when(F.col("kept"), 1)).alias("stays"))
    stays = stage(stays.where("stays > 0").select(F.col("_id").alias("i"), F.col("_hash").alias("h"), "stays"), "stays")
    rows = identified(docs, carry=True)
    rows = rows.join(stays, rows["_id"].eqNullSafe(stays["i"]) & (rows["_hash"] == stays["h"]))
    number = F.row_number().over(Window.partitionBy("_id", "_hash").orderBy(F.lit(1)))  # of rows that repeat id and text
    return rows.withColumn("_number", number).where("_number <= stays").select("_row.*")


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with the benchmark."""
    benchmark = identified(table(spark, sf_dir, "benchmark"), "item_id")
    return without(identified(docs, carry=True), decontamination.overlaps(identified(docs), benchmark, short=True)).select("_row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    ship_package(spark)
    texts = docs.withColumn("text", F.coalesce("text", F.lit("")))
    decoded = bpe.round_trip(identified(texts), tokenizer_file())
    return decoded.select(
        F.col("_id").alias("doc_id"), F.size("_ids").cast("long").alias("n_tokens"), F.col("_ids").alias("ids"),
        (text_key(F.col("_decoded")) == F.col("_hash")).alias("round_trip"),
    )


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("benchmark decontamination", remove_benchmark),
    ("BPE encoding and decoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
