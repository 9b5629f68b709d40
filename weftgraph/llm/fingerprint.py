"""Document fingerprints: bottom-k sketches of word-shingle hashes, by SQL functions alone.

A text is lower-cased and cut into words at ASCII white space; each run of five words is hashed to 64 bits (with fewer
words, the whole sequence), and the K smallest distinct hashes are the fingerprint. The smallest hashes of a union are
among those of its parts, so fingerprints of parts merge to that of the whole; they estimate resemblance, containment
and the number of distinct shingles. With at most K shingles all of these are exact.

Edge cases. Null text counts as empty: its fingerprint is empty, like that of a text without words; two empty ones have
resemblance 1, an empty and another 0. An empty table gives an empty result. Null ids come after all others in
descending order, ties in the order of the texts' hashes. Other columns are never read.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shares, text_or_empty

K, WORDS = 128, 5
#: Ranges hold about ROWS_PER_RANGE rows up to 67 million rows, and more of them beyond (with 10 billion rows, 40,000).
ROWS_PER_RANGE, MAX_RANGES = 256, 1 << 18


def with_sketch(df: DataFrame, text: str, name: str, k: int = K, words: int = WORDS) -> DataFrame:
    """df with the fingerprint of a text column, array<bigint> in ascending order. The words and hashes are columns of
    steps of their own, so each is computed once."""
    w, h = f"__{name}_words", f"__{name}_hashes"
    df = df.withColumn(w, F.filter(F.split(F.lower(F.col(text)), r"[\x20\x09-\x0D]+"), lambda x: x != ""))
    many = F.transform(F.sequence(F.lit(1), F.size(w) - (words - 1)), lambda i: F.xxhash64(F.slice(w, i, words)))
    few = F.when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn(h, F.when(F.size(w) > words, many).otherwise(few)).drop(w)
    return df.withColumn(name, F.slice(F.sort_array(F.array_distinct(h)), 1, k)).drop(h)


def merged(a: Column | str, b: Column | str, k: int = K) -> Column:
    """The fingerprint of the union of two parts."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def distinct_shingles(a: Column | str, k: int = K) -> Column:
    """Estimate of the number of distinct shingles: (k - 1) over the share of the hash range below the k-th hash."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def resemblance(a: Column | str, b: Column | str, k: int = K) -> Column:
    """Estimate of intersection over union: the share of the union's k smallest hashes that both have."""
    union = merged(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union))


def containment(a: Column | str, b: Column | str, k: int = K) -> Column:
    """Estimate of the share of a's shingles that b has."""
    both = resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_shingles(a, k)))


def merge_groups(df: DataFrame, key: str, sketch: str, k: int = K, salts: int = 64) -> DataFrame:
    """Merges many fingerprints by key. Each key's hashes are thinned to k in each of ``salts`` parts first, so a key of
    very many rows does not meet in one task."""
    hashes = df.select(key, F.explode(sketch).alias("__h")).distinct().withColumn("__s", F.pmod(F.xxhash64("__h"), F.lit(salts)))
    part = hashes.withColumn("__n", F.row_number().over(Window.partitionBy(key, "__s").orderBy("__h"))).filter(F.col("__n") <= k)
    last = part.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy("__h"))).filter(F.col("__n") <= k)
    found = last.groupBy(key).agg(F.sort_array(F.collect_list("__h")).alias(sketch))
    keys = df.select(key).distinct()
    return keys.join(found, keys[key].eqNullSafe(found[key]), "left").select(keys[key], F.coalesce(found[sketch], F.array().cast("array<bigint>")).alias(sketch))


def text_form(sketch: Column | str) -> Column:
    """16 hexadecimal digits a hash."""
    return F.lower(F.array_join(F.transform(sketch, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def _longs(values: list) -> Column:
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")


def _range_of(column: str, bounds: list[int]) -> Column:
    """How many bounds (ascending) are at most the column's value, found in two steps; 0 for null."""
    step = max(128, math.isqrt(len(bounds)))
    parts = [bounds[i : i + step] for i in range(0, len(bounds), step)] or [[]]
    coarse = _longs([p[-1] for p in parts[:-1]])
    fine = F.from_json(F.lit(json.dumps(parts)), "array<array<bigint>>")
    i = F.size(F.filter(coarse, lambda c: c <= F.col(column)))
    inner = F.size(F.filter(F.element_at(fine, i + 1), lambda c: c <= F.col(column)))
    return F.when(F.col(column).isNull(), F.lit(0)).otherwise(i * step + inner)


def with_next(docs: DataFrame, derive=lambda df: df, columns: tuple = ("text",), rows_per_range: int = ROWS_PER_RANGE, max_ranges: int = MAX_RANGES) -> DataFrame:
    """docs (doc_id, text) with next_<column> of the next row in descending doc_id (after the last: of the first).

    Rows are dealt to ranges of doc_id at approximate quantiles. The first row of each range is also sent to the range
    before it as a guest, so the next row is always in the same range and the texts are shuffled once; only the ranges'
    bounds and largest ids (max_ranges at most) go to the driver. ``derive`` adds columns after the shuffle."""
    n = docs.count()
    ranges = max(1, min(max_ranges, n // rows_per_range))
    cuts = [i / ranges for i in range(1, ranges)]
    bounds = sorted(set(docs.agg(F.percentile_approx("doc_id", cuts, max(10_000, 4 * ranges))).first()[0] or [])) if cuts else []
    placed = docs.withColumn("__range", _range_of("doc_id", bounds))
    tops = {r["__range"]: r["top"] for r in placed.groupBy("__range").agg(F.max("doc_id").alias("top")).collect()}
    there = sorted(tops)
    above = {r: there[(i + 1) % len(there)] for i, r in enumerate(there)}
    top = F.element_at(_longs([tops.get(i) for i in range(len(bounds) + 1)]), F.col("__range") + 1)
    host = F.element_at(_longs([above.get(i, -1) for i in range(len(bounds) + 1)]), F.col("__range") + 1).cast("int")
    own = F.struct(F.col("__range").alias("r"), F.lit(False).alias("guest"))
    seats = F.when(F.col("doc_id").eqNullSafe(top), F.array(own, F.struct(host.alias("r"), F.lit(True).alias("guest")))).otherwise(F.array(own))
    dealt = placed.withColumn("__seat", F.explode(seats)).drop("__range").repartition(max(1, shares(docs)), "__seat.r")
    dealt = derive(dealt.select("doc_id", "text", F.col("__seat.r").alias("__range"), F.col("__seat.guest").alias("__guest")))
    order = Window.partitionBy("__range").orderBy("__guest", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), "text")
    return dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns}).filter(~F.col("__guest")).drop("__guest", "__range")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """doc_id, fingerprint (array<bigint>), distinct_shingles of each row."""
    rows = with_sketch(docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")), "text", "fingerprint", k)
    return rows.select("doc_id", "fingerprint", distinct_shingles("fingerprint", k).alias("distinct_shingles"))


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Each text against its edited text (its last third, floor(n_chars / 3) code points, replaced by the first as many
    of the next document) and against the next document: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next and the estimates contained_edited, distinct_shingles."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    rows = with_next(rows, lambda df: with_sketch(df, "text", "fp", k), ("text", "fp"))
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))).drop("text", "next_text")
    rows = with_sketch(rows, "edited", "efp", k)
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), text_form("fp").alias("fingerprint"), text_form("efp").alias("edited_fingerprint"),
        resemblance("fp", "efp", k).alias("near_edited"), resemblance("fp", "next_fp", k).alias("near_next"), containment("fp", "efp", k).alias("contained_edited"), distinct_shingles("fp", k).alias("distinct_shingles"),
    )
