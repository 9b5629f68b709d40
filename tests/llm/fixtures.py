"""Small document tables: nulls in any column, empty and very long texts, ties, repeated rows, clashing column names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark: SparkSession, texts: list, langs: list | None = None) -> DataFrame:
    rows = [(i, t, langs[i] if langs else None, None, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def odd_rows() -> list[tuple]:
    long = "word " * 30_000 + "end"
    return [
        (5, "a b  c\td e f", "en", "s", 1),
        (3, "a b c d e f", "en", "s", 1),
        (3, "a b c d e f", "en", "s", 1),
        (None, "a b c d e f", None, None, None),
        (None, None, None, None, None),
        (7, None, "de", None, 0),
        (8, "", "de", None, 0),
        (9, " \n\t ", "fr", "x", 4),
        (11, long, "en", "s", len(long)),
        (12, "été über naïve \U0001f600 oḱ   x\x1cy", "fr", "s", 3),
    ]


def odd(spark: SparkSession) -> DataFrame:
    """The odd rows, with extra columns named like those the operators make."""
    from pyspark.sql import functions as F

    extra = {c: F.lit("clash") for c in ("digest", "keep_id", "kept", "group_size", "shard", "bucket", "hash", "tokens", "component_id", "held_out", "row", "spans", "lang_pred")}
    return spark.createDataFrame(odd_rows(), SCHEMA).withColumns(extra)


def none(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
