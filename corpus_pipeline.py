"""A training-data pipeline over ``documents``: quality, repeated lines, near duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``. Nulls, empty
texts and repeated rows are treated as each operator's docstring says; an empty table goes through every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesspark.llm import bpe, line_dedup, mixing, near_dup, quality
from salesspark.llm.common import read, shared_folder, word_count
from salesspark.session import ensure_checkpoint_dir, ship_package

VOCABULARY = "byte_bpe_50k.json"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the rows not held out, scores 0.7 or more."""
    labels = read(spark, sf_dir, "labels")
    weights = quality.train(read(spark, sf_dir, "documents"), labels.filter(~quality.held_out(F.col("doc_id"))))
    packed = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"))
    return quality.scored(packed, weights).filter(F.col("score") >= quality.THRESHOLD).select("row.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more stay in the first of them only; documents stay, also if empty then."""
    return line_dedup.drop_repeated_lines(docs, min_docs=10, keep_first=True)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id. Texts that share a doc_id are documents of their own, told
    apart by their hash; of rows equal in both, one stays. Rows without doc_id or without words are duplicates of nothing."""
    found = near_dup.near_duplicates(docs.select("doc_id", "text")).filter("kept AND component IS NOT NULL")
    stays = found.groupBy("component").agg(F.min(F.struct("doc_id", "t1", "t2")).alias("s")) \
        .select(F.col("s.doc_id").alias("k_doc"), "s.t1", "s.t2")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("k_doc"), *near_dup.text_key(F.col("text")),
                       (F.col("doc_id").isNull() | (word_count(F.col("text")) == 0)).alias("alone"))
    one = rows.filter("NOT alone").join(stays, ["k_doc", "t1", "t2"]).dropDuplicates(["k_doc", "t1", "t2"])
    return one.select("row").unionByName(rows.filter("alone").select("row")).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.take_copies(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document (little-endian unsigned 32-bit integers) and the digest of what they decode to."""
    with open(public_tokenizers.path(VOCABULARY), "rb") as f:
        both = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), f.read(), kept=bpe.SMALL)
    return both.select("row.doc_id", "row.lang", "row.source", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), "ids",
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def _stage(fn):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ensure_checkpoint_dir(spark)
        ship_package(spark)
        return fn(spark, docs, sf_dir)

    return run_stage


STAGES = [("quality", _stage(keep_quality)), ("line_dedup", _stage(drop_lines)), ("near_dup", _stage(drop_near_duplicates)),
          ("mixing", _stage(mix_sources)), ("bpe", _stage(to_tokens))]

#: SQL can express neither the classifier nor the random rounding of the mix; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again by the next."""
    ensure_checkpoint_dir(spark)
    docs, folder = read(spark, sf_dir, "documents"), shared_folder(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
