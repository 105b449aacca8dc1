"""The corpus pipeline: language, near copies, benchmark leaks, secrets, packing. Each stage's result is written as Parquet and read again.

All but the last stage return the columns of documents, the last the pieces of documents with their token ids and places in sequences. Stages
are judged on what the one before kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import near_copies, op1_language, op3_decontaminate, op4_packing, op7_secrets
from tidemark.llm.textvec import lean_workers, remove_folder, shared_folder

#: No SQL states a fitted model, an edit-tolerant search or a packing; tests hold the stages against brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows. Those with no letters go, and those with few of the trigrams that its languages have: foreign or garbled text."""
    lean_workers(spark)
    model = op1_language.train(docs, "doc_id", "text", "lang")
    found = op1_language.predict(docs, model, "text", "__tm_lang", "__tm_score", coverage_out="__tm_coverage")
    known = (F.col("__tm_lang") != "und") & (F.col("__tm_coverage") >= op1_language.LEAST_COVERAGE)
    # with nothing to learn from there is no ground to reject a text that has letters
    keep = known if model else F.col("text").rlike(r"\p{L}")
    return found.filter(keep).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies: SimHash through a byte-position inverted index with count filtering, the pairs that it misses, and an exact check."""
    lean_workers(spark)
    return near_copies.drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    lean_workers(spark)
    return op3_decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark."""
    marked = op7_secrets.redact(docs)
    return marked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else marked


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their token ids (little-endian unsigned 32-bit numbers) and their places in sequences."""
    lean_workers(spark)
    return op4_packing.pack_documents(docs, keep_ids=True)


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("secrets", secrets), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn over the documents table; between stages the rows lie in the shared folder, where only the last stage's stay."""
    place = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{name}")
        if last:
            remove_folder(spark, f"{place}/{last}")
        docs, last = spark.read.parquet(f"{place}/{name}"), name
    return docs
