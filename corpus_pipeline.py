"""A corpus pipeline: language identification, exact and near deduplication, redaction of personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. A stage
sees all that its predecessor kept, and its decisions take effect: rows leave, or their texts change. Before each stage
executors give back what the one before has left on their heaps.

Ids are expected to be unique, as they are in documents. Rows that repeat an id share its fate; rows with a null id take
part like any other (they are matched null-safely). Empty input gives empty output at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import exact_dedup, langid, near_dedup, packing, pii
from weftgraph.llm.common import release_heaps, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


#: Up to so many ids that leave (some 16 bytes each, counted first) are broadcast, and no text is shuffled; beyond that they
#: are matched by an ordinary shuffle.
BROADCAST_IDS = 1_000_000
#: The tokenizer's memo in the last stage, smaller than packing alone has it: its workers stand beside heaps that the stages
#: before have made large, of which not all is given back.
MEMO_WORDS = 100_000


def _chosen(docs: DataFrame, decisions: DataFrame, name: str) -> DataFrame:
    """docs without the rows whose ids leave: those of decisions (doc_id, kept) of which no row is kept."""
    leaving = written(decisions.groupBy("doc_id").agg(F.max("kept").alias("kept")).filter(~F.col("kept")).select(F.col("doc_id").alias("__gone")), name)
    gone = F.broadcast(leaving) if leaving.count() <= BROADCAST_IDS else leaving
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["__gone"]), "left_anti").select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in no language (without letters); the others get the language found where they have none."""
    release_heaps(spark)
    found = langid.tagged(docs.select(*COLUMNS)).filter(F.col("lang_pred") != langid.UNDETERMINED)
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the smallest id stays."""
    release_heaps(spark)
    return _chosen(docs, exact_dedup.exact_groups(docs), "exact-gone")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, resemblance 0.8 or more), the one with the smallest id stays."""
    release_heaps(spark)
    return _chosen(docs, near_dedup.near_groups(docs), "near-gone")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in angle brackets; n_chars follows the text."""
    release_heaps(spark)
    return pii.redact(docs).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long"))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences; see weftgraph.llm.packing."""
    import public_tokenizers

    release_heaps(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), memo_words=MEMO_WORDS, give_back=True)


STAGES = [("language_id", language_id), ("exact_dedup", exact_duplicates), ("near_dedup", near_duplicates), ("pii", personal_data), ("packing", packed)]

#: Cross-parsing, MinHash and tokenizer ids are beyond SQL; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each one's rows written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
