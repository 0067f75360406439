"""The registered queries of this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, langid, lm, media, neardup, secrets, substring, tokencount, toxicity
from .common import read_documents


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.op1(read_documents(spark, sf_dir))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(read_documents(spark, sf_dir))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.op3(read_documents(spark, sf_dir))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op4(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.op5(read_documents(spark, sf_dir))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op6(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.op7(read_documents(spark, sf_dir))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digest(read_documents(spark, sf_dir))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.op9(read_documents(spark, sf_dir))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(read_documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_secret_scans, op3_lm_scoring, op4_toxicity, op5_minhash, op6_decontamination, op7_substring_dedup, op8_bpe, op9_token_counts, op10_media)}

ORACLE_SQL = {"op5_minhash": neardup.ORACLE_SQL, "op6_decontamination": decontaminate.ORACLE_SQL, "op7_substring_dedup": substring.ORACLE_SQL}
