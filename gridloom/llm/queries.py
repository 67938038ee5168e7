"""The registered query of each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).taken()


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import token_output

    return token_output(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pseudonymize

    # a session without a key of its own gets one that is public, and so good for trials only
    return pseudonymize(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.conf.get("spark.gridloom.pii.key", "trial"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "held_out", "lang_pred", "score")


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embdedup import near_vectors

    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_chat

    return format_chat(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import secret_digest

    return secret_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(docs, benchmark).drop("text_hash")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity(docs, labels)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from .oracles import SQL

    return dict(SQL)
