"""A training corpus from raw documents, in five stages.

Each stage takes what the one before kept, as a table with the columns of
documents, and returns what it keeps; the last returns the kept documents' pieces.
Stages are written as Parquet and read again, so a lost executor costs one stage
at most, and a later stage never recomputes an earlier one.

Cases: null and empty texts have no words and go with the quality classifier; rows
without an id are decided and kept one by one; rows of one id are one document to
near-dedup, which keeps one of them; null languages and sources are a language and a
source; columns beside those of documents are dropped at the start, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamcontract.llm import mixing, near_dedup, pieces, quality, toxicity
from streamcontract.llm.common import drop_table, shared_dir, table

#: No stage is SQL: the models are trained, the copies come from solved rates.
ORACLE_SQL = None

#: Words of a shingle.
WIDTH = 5
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier accepts, each by its own text."""
    return quality.filter_quality(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows below their language's threshold, each by its own text."""
    return toxicity.filter_toxicity(docs.select(*COLUMNS), toxicity.learn(docs, table(spark, sf_dir, "labels")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies, one row of it (the smallest by its columns).

    Rows without an id have no document but their text: one row of each set of
    shingles that no document with an id has, and one of each text without words.
    """
    docs = docs.select(*COLUMNS)
    ids = near_dedup.near_duplicates(docs, width=WIDTH, percent=80).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__id")).distinct()
    least = F.min(F.struct(F.xxhash64("text").alias("h"), *COLUMNS)).alias("r")
    kept = docs.join(ids, docs["doc_id"] == ids["__id"], "left_semi").groupBy(F.col("doc_id").alias("__id")).agg(least).select("r.*").select(*COLUMNS)
    nameless = docs.where("doc_id IS NULL")
    if not nameless.limit(1).count():
        return kept
    key = ["n", "k1", "k2"]
    own = near_dedup.set_keys(nameless, WIDTH).withColumn("same", F.when(F.col("n") == 0, F.coalesce("text", F.lit(""))))
    own = own.groupBy(*key, "same").agg(least)
    named = near_dedup.set_keys(docs.where("doc_id IS NOT NULL").select("text"), WIDTH).where("n > 0").select(*key)
    return kept.unionByName(own.join(named, key, "left_anti").select("r.*").select(*COLUMNS))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it."""
    taken = mixing.mix(docs, carry=COLUMNS).where("copies > 0")
    return taken.select(*(F.col(f"in_{c}").alias(c) for c in COLUMNS), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*COLUMNS)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each row's whole text."""
    return pieces.pieces(docs, pieces.public_model())


STAGES = [
    ("quality classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("near-dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("pieces", pieces_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            drop_table(spark, f"{folder}/{i - 1}")
    return docs
