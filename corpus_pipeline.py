"""Corpus pipeline: documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each as Parquet in the shared folder and rereads it as the next stage's input,
so a lost executor costs a stage at most.  A stage's files go when the next one
is written.  All but the last return the columns of ``documents`` (other columns
of the input are left out); the last returns the pieces with their token ids.

Null ids, null and empty texts, repeated rows and empty tables: each stage's
docstring says what becomes of them; none is lost but by a stage's decision.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm.decontamination import decontaminate
from ledgerlake.llm.frames import shared_folder, table
from ledgerlake.llm.near_dedup import near_dedup
from ledgerlake.llm.packing import pack
from ledgerlake.llm.quality import classify
from ledgerlake.llm.queries import tokenizer
from ledgerlake.llm.substring_dedup import substring_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; a null text is judged as an empty one,
    rows of one id and rows without an id each for themselves."""
    return classify(docs, table(spark, sf_dir, "labels")).where("predicted = 1").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays (five words, similarity 0.8), whatever the
    ids of the others: each text is judged by itself, of equal rows one stays, and texts of one id
    are documents of their own.  Rows without an id all stay, as they are in no group."""
    named = docs.where("doc_id is not null").withColumn("mark", F.xxhash64("text"))
    kept = near_dedup(named.select("doc_id", "text", "mark"), shingle=5, mark="mark").where("chosen").select("doc_id", "mark").distinct()
    single = named.join(kept.hint("shuffle_hash"), ["doc_id", "mark"], "left_semi")
    single = single.groupBy("doc_id", "mark", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("rest"))
    return single.select("doc_id", "text", "rest.*").select(*COLUMNS).union(docs.where("doc_id is null").select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that a document with a smaller id has are cut out; a document
    of nothing else goes.  Rows of one id keep each other's passages, rows without an id lose none."""
    out = substring_dedup(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    out = out.withColumn("text", text).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length(text).cast("long")).otherwise(F.col("n_chars")))
    return out.where("n_removed = 0 or n_removed < n_words").select(*COLUMNS)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go; a null text holds none."""
    out = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return out.where("not contaminated").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into sequences of at most 2048 tokens, each row by itself; a null
    text is the separator alone."""
    return pack(docs, tokenizer(), with_ids=True)


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_passages),
    ("packing", packing),
]

#: Not expressible in SQL: trained scores, hashing signatures, tokens. Tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    where = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{where}/{k}")
        docs = spark.read.parquet(f"{where}/{k}")
        if k:
            done = hadoop.Path(f"{where}/{k - 1}")
            done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(done, True)
    return docs
