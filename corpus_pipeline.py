"""A corpus pipeline of five stages: quality rules, line dedup, near-duplicate removal, source mixing, packing.

Each stage takes the documents that the stage before wrote.  All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.llm.best_fit_packing import best_fit_packing
from factloom.llm.jaccard_join import jaccard_join
from factloom.llm.line_dedup import line_dedup
from factloom.llm.queries import byte_bpe
from factloom.llm.repetition_rules import repetition_rules
from factloom.llm.shared import saved, shared_folder
from factloom.llm.source_mixing import mixed

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules reject go; null and empty texts are among them."""
    judged = repetition_rules(docs, keep=("text", "lang", "source", "n_chars"))
    return judged.where("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that an earlier document holds go, and documents of which nothing is left.

    n_chars becomes the length of what is left.  Documents that lose no line stay as they are, null texts included.
    """
    left = line_dedup(docs, keep=("lang", "source", "n_chars"))
    left = left.where("n_removed = 0 or n_removed < n_lines")
    return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest doc_id stays, once; rows without a doc_id all stay.

    Rows that share a doc_id are one document only if their texts are equal.  Where ids repeat with unlike texts, ids in
    the order of doc_id and text hash take their place while the texts are compared.
    """
    docs = docs.select(*COLUMNS)
    named = docs.where("doc_id is not null").withColumn("text_hash", F.xxhash64("text"))
    ids = named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("text_hash").alias("low"), F.max("text_hash").alias("high")).where("n > 1")
    repeated, unlike = ids.agg(F.count(F.lit(1)), F.count(F.when(F.col("low") != F.col("high"), 1))).first()
    if unlike:
        keys = saved(named.select("doc_id", "text_hash", "text").dropDuplicates(["doc_id", "text_hash"]).orderBy("doc_id", "text_hash").withColumn("key", F.monotonically_increasing_id()))
        classes = jaccard_join(keys.select(F.col("key").alias("doc_id"), "text"))
        lost = classes.where("doc_id <> class_id").select(F.col("doc_id").alias("key")).distinct().join(keys.select("key", "doc_id", "text_hash"), "key").drop("key")
        kept = named.join(lost, ["doc_id", "text_hash"], "left_anti").dropDuplicates(["doc_id", "text_hash"])
        return kept.select(*COLUMNS).unionByName(docs.where("doc_id is null"))
    lost = jaccard_join(docs).where("doc_id <> class_id").select("doc_id").distinct()
    kept = docs.join(lost, "doc_id", "left_anti").select(*COLUMNS)
    if repeated:
        kept = kept.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(kept.where("doc_id is null"))
    return kept


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's weight asks for: once at least, so that none is lost, and the most
    repeated source at most twice as often as the least."""
    drawn = mixed(docs, keep=("text", "lang", "n_chars"))
    return drawn.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).where("copy <= copies").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1024 tokens."""
    return best_fit_packing(docs, **byte_bpe())


STAGES = [
    ("quality", quality),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL has no tokenizer, suffix array or patience diff; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def folder(spark: SparkSession) -> str:
    """A new folder in the one that all executors share."""
    return f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = folder(spark)
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{out}/{name}")
        docs = spark.read.parquet(f"{out}/{name}")
    return docs
