"""The thin queries: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: The rules that op10's contract names.
RULES = ("allow com/", "block example.com/en/", "allow www.example.com/en/", "block net/es/", "block net/fr/")


def op1_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ann

    return ann.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import nndescent

    return nndescent.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing
    from .shared import cut

    return packing.pack(cut(packing.pieces(_docs(spark, sf_dir), tokenizer_path())))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secrets

    found = secrets.scan(_docs(spark, sf_dir))
    counts = [secrets.count_of(F.col("base"), k).alias(f"n_{k}") for k in secrets.BASE]
    return found.select("doc_id", *counts, F.sha2(secrets.digest(F.col("base")), 256).alias("base_sha256"), secrets.digest(F.col("spans")).alias("spans"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pll

    blocks = pll.encode(_docs(spark, sf_dir))
    return pll.score(blocks, pll.fit(blocks))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import minhash

    return minhash.near_duplicates(_docs(spark, sf_dir), shingle=4)


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    return mixing.plan(_docs(spark, sf_dir), [1.0, 2.0, 3.0], split_last=True).select("doc_id", "size", "source_size", "target", "taken")


def op8_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import phrases

    return phrases.remove_repeats(_docs(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    docs = _docs(spark, sf_dir)
    model = langid.fit(docs.where(langid.fold() != 2))
    out = langid.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(langid.fold() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import urlgraph

    return urlgraph.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), [urlgraph.parse_rule(r) for r in RULES]).select("page_id", "host", "path", "rule", "verdict")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from .oracles import SQL

    return SQL
