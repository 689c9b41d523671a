"""A pipeline from raw documents to packed training sequences.

Each stage takes the session, the documents that its predecessor kept and the folder of the tables.  All but the last
return the columns of ``documents``; ``run`` writes every stage's result to the shared folder and reads it again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowscope.llm.common import materialize, text_column
from flowscope.llm.decontaminate import find_items
from flowscope.llm.jaccard_join import jaccard_components
from flowscope.llm.line_crf import train, with_quality
from flowscope.llm.packing import pack_documents
from flowscope.llm.secrets import redact, with_spans

ORACLE_SQL = None  # model scores and token ids are beyond SQL; tests compare with a plain version


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose lines are more likely good than bad."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return with_quality(docs, model, "quality_score").where("quality_score >= 0.5").drop("quality_score")


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``document_key``, 64 hash bits of id and text: a row without an id, or one that shares its id with
    another text, is a document of its own."""
    return docs.withColumn("document_key", F.xxhash64("doc_id", "text"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document stays: that with the smallest id, rows without an id coming last and
    the key deciding between texts of one id.  Of rows equal in id and text the smallest by the other columns stays."""
    rows = keyed(docs)
    groups = jaccard_components(rows, id_col="document_key").groupBy("document_key").agg(
        F.min("component_id").alias("component_id"), F.count("*").alias("copies"))
    ids = rows.select("document_key", "doc_id").distinct()
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "document_key", "copies")
    stay = groups.join(ids, "document_key").groupBy("component_id").agg(F.min(order).alias("first")).select(
        F.col("first.document_key").alias("stay_key"), F.col("first.copies").alias("copies"))
    kept = rows.join(stay, rows["document_key"] == stay["stay_key"])
    once = kept.where("copies = 1").select(*docs.columns)
    again = kept.where("copies > 1").groupBy("document_key").agg(F.min(F.struct(*docs.columns)).alias("row"))
    return once.union(again.select("row.*"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, each row judged by its own text."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = keyed(docs)
    found = find_items(rows, items, id_col="document_key").select("document_key").distinct()
    return rows.join(found, "document_key", "left_anti").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    rows = with_spans(docs.withColumn("text", text_column(docs)))
    found = F.size("spans") > 0
    clean = F.when(found, redact(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    rows = rows.withColumn("text", clean).withColumn("n_chars", F.when(found, F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=0)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("secret scans", secrets),
    ("best-fit packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs


QUERIES = {"pipeline": run}
CHECKS = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
