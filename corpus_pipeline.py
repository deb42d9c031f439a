"""The corpus pipeline: stages over `documents`, each filtering or rewriting what the one before kept.

Every stage but the last returns the columns of documents; the last returns the
token ids of what is left.  Rows of null id or text pass through the filters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm import decontamination, gam_quality, ngram_join, pii, sentencepiece_bpe
from quern.llm.common import saved
from quern.shipping import ship
from quern.sources.tables import read

#: Up to so many ids a filter is sent to all executors; beyond, Spark joins by shuffle.
BROADCAST_IDS = 1 << 20


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; it is fitted on labelled rows among docs."""
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return gam_quality.kept(docs, gam_quality.train(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of least id, of each group linked by similar n-gram sets.

    An id with several texts is as many documents, each compared by its own set;
    where a group's least id has several of its texts, the one of least hash stays.
    Of rows that repeat an id and its text one stays, the least by the other columns.
    """
    ship(spark)
    again = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("times")).where("times > 1 and doc_id is not null").select(F.col("doc_id").alias("again_id"))
    again = saved(again, "again")
    if again.isEmpty():
        return _without(docs, "doc_id", ngram_join.linked(docs).where("doc_id != class_id").select("doc_id"))
    others = [F.col(f"`{c}`").cast("string").asc_nulls_first() for c in docs.columns if c not in ("doc_id", "text")]
    twice = docs.join(again, docs["doc_id"] == again["again_id"], "left_semi")
    rank = F.row_number().over(Window.partitionBy("doc_id", "text").orderBy(*(others or [F.lit(0)])))
    one = twice.withColumn("rank of a repeated row", rank).where("`rank of a repeated row` = 1").select(docs.columns)
    rows = docs.join(again, docs["doc_id"] == again["again_id"], "left_anti").union(one)
    rows = saved(rows.withColumn("key_of_a_document", F.monotonically_increasing_id()), "documents")  # stands still only once written
    named = rows.where("doc_id is not null").select(F.col("key_of_a_document").alias("key"), F.col("doc_id").alias("id"), "text")
    classes = ngram_join.linked(named.select(F.col("key").alias("doc_id"), "text")).select(F.col("doc_id").alias("key"), "class_id")
    members = saved(classes.join(named.select("key", "id", F.xxhash64("text").alias("h")), "key"), "members")
    stay = members.groupBy("class_id").agg(F.min(F.struct("id", "h", "key"))["key"].alias("key"))
    return _without(rows, "key_of_a_document", members.join(stay, "key", "left_anti").select("key")).select(docs.columns)


def _without(docs: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """docs but for the rows whose key is in keys, a table of one column; rows of null key stay."""
    gone = saved(keys.toDF("gone_id"), "gone")
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, docs[key] == gone["gone_id"], "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within its error budget."""
    ship(spark)
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with identifiers replaced by their kinds."""
    ship(spark)
    return pii.redacted(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, token_ids, decoded) of every document left."""
    ship(spark)
    return sentencepiece_bpe.encode_and_decode(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("PII", personal_data),
    ("SentencePiece", tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:  # each stage's result is written and read again as the next one's docs
            docs = saved(docs, "stage")
    return docs
