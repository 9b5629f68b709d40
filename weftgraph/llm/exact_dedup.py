"""Exact duplicates by a heavy-hitter split.

1. Every text is reduced to the SHA-256 of its normalised form; (id, digest) rows go to a written table, so the
   texts are read once.
2. Misra-Gries summaries with ``counters`` counters are made per partition and added up by digest. A digest on more
   than 2 n / (counters + 1) of the n rows keeps a sum of at least n / (counters + 1), and as all sums together are at
   most n, at most counters + 1 digests have such a sum: that is the proven bound of what is broadcast.
3. The candidates are verified: exact count and smallest id, by map-side partial aggregation; those with a count below
   n / (counters + 1) are no winners.
4. Rows of the winners get their group by a broadcast join and are not shuffled. The remaining digests, none of which
   has more than 2 n / (counters + 1) rows, are summed up by partial aggregates and joined back, an ordinary shuffle of
   40-byte rows.

Edge cases. Null text counts as empty, and all empty texts are one group. Ids that are null are ignored when the
smallest id is sought; a group with null ids alone has a null keep_id and all its rows are kept. Rows that repeat the
smallest id of their group are the same document and are all marked kept. An empty table gives an empty result. Columns
other than the id and the text are never read, so their names cannot clash.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, kept, pieces, text_or_empty, written

COUNTERS = 1000


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


def shrink(counts: Counter, counters: int) -> None:
    """Misra-Gries reduction of a summary in place: the (counters + 1)-th largest count is taken from each."""
    if len(counts) > counters:
        cut = sorted(counts.values(), reverse=True)[counters]
        for k in [k for k, v in counts.items() if v <= cut]:
            del counts[k]
        for k in counts:
            counts[k] -= cut


def misra_gries(counters: int):
    """For mapInArrow: the summary of a partition's digests, as rows (digest, lower bound of its count)."""

    def summarise(batches):
        kept("exact_dedup")
        counts: Counter = Counter()
        for batch in pieces(batches):
            counts.update(batch.column(0).to_pylist())
            shrink(counts, counters)
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["digest", "low"])

    return summarise


def heavy_hitters(keys: DataFrame, counters: int = COUNTERS, rows: int | None = None) -> DataFrame:
    """keys: one binary column ``digest``. At most counters + 1 rows (digest), among them each one on more than
    2 n / (counters + 1) rows."""
    n = keys.count() if rows is None else rows
    sums = keys.mapInArrow(misra_gries(counters), "digest binary, low long").groupBy("digest").agg(F.sum("low").alias("low"))
    return sums.filter(F.col("low") * F.lit(counters + 1) >= F.lit(n)).select("digest")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    bounded(docs.sparkSession)
    rows = written(docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(normalised(text_or_empty(text_col)), 256)).alias("digest")), "digests")
    n = rows.count()
    found = heavy_hitters(rows.select("digest"), counters, n)
    group = [F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]
    winners = written(rows.join(F.broadcast(found), "digest").groupBy("digest").agg(*group).filter(F.col("group_size") * (counters + 1) >= n), "winners")
    split = rows.join(F.broadcast(winners), "digest", "left")
    heavy = split.filter(F.col("group_size").isNotNull())
    light = split.filter(F.col("group_size").isNull()).select("doc_id", "digest")
    rest = light.join(light.groupBy("digest").agg(*group), "digest")
    return heavy.unionByName(rest).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256
)
SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""
