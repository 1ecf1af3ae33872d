"""From raw documents to packed sequences: five stages, each written as Parquet before the next reads it. Only the last table stays.

Every stage takes null ids and texts, empty and very long texts, repeated rows and an empty table; each function says what becomes of them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import langid, minhash, mixing, packing, secrets
from lexmill.llm.queries import tokenizer_path
from lexmill.llm.shared import cut, delete, shared_folder, small

#: A prediction under this posterior is no language.
LEAST_SCORE = 0.5
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language that the labelled ones teach; lang becomes the prediction. A text that is null or has no letter has none and goes."""
    model = langid.fit(docs.where(F.coalesce(langid.fold() != 2, F.lit(False))))
    kept = langid.predict(docs, model).where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words a shingle, similarity 0.8 or more): the one with the
    smallest id, once."""
    n = docs.count()
    found = cut(minhash.near_duplicates(docs).where("NOT kept").select("doc_id").distinct(), n)
    kept = docs.join(small(found), "doc_id", "left_anti")
    # Only rows whose id is there twice are compared by their texts.
    twice = cut(kept.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").select("doc_id"), n)
    again = kept.join(small(twice), "doc_id", "left_semi").unionByName(kept.where("doc_id IS NULL"))
    alone = kept.where("doc_id IS NOT NULL").join(small(twice), "doc_id", "left_anti")
    return alone.unionByName(again.dropDuplicates(["doc_id", "text"])).select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, reported secrets replaced in their texts; null texts stay null, repeated rows stay equal."""
    return secrets.redact(docs).select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, each as often as its source's target needs. Null sources are one source; a document without words is taken once."""
    return mixing.mix(docs, [1.0, 2.0, 3.0]).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in sequences of 4096 tokens. A null or empty text is a piece of the end id alone; repeated rows are packed each."""
    return packing.pack(cut(packing.pieces(docs, tokenizer_path())))


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_duplicates),
    ("secret scans", secret_scan),
    ("mixing sources", source_mixing),
    ("best-fit packing", best_fit_packing),
]

#: Language identification and MinHash signatures are no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            delete(spark, f"{folder}/{k - 1}")
    return docs
