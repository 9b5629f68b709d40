"""The queries op1 to op10: thin digests of the operators' outputs, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact_dedup, fingerprint, hmm, langid, near_dedup, packing, pii, token_store, warc
from .common import read_table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(read_table(spark, sf_dir, "documents")))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(warc.write_archives(read_table(spark, sf_dir, "pages")))


def op4_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(read_table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(read_table(spark, sf_dir, "documents"), words=4)


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.read_tokens(token_store.write_tokens(read_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json")))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_edited(read_table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_documents(read_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_langid, op3_warc, op4_hmm, op5_packing, op6_near_dedup, op7_token_store, op8_fingerprints, op9_bpe, op10_exact_dedup)}
ORACLE_SQL = {"op3_warc": warc.ORACLE_SQL, "op10_exact_dedup": exact_dedup.ORACLE_SQL}
