import hashlib
import re

from pyspark.sql import functions as F

from weftgraph.llm import fingerprint as fp

from . import fixtures


def words_of(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]


def shingle_set(text, k=5):
    w = words_of(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def alike(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(rows):
    """rows: (doc_id, text) with distinct ids -> doc_id: (text, edited, next)."""
    rows = sorted(rows, key=lambda r: -r[0])
    out = {}
    for i, (d, t) in enumerate(rows):
        t, nxt = t or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(t) // 3
        out[d] = (t, t[: len(t) - k] + nxt[:k], nxt)
    return out


def check(spark, rows, df):
    want, got = edited(rows), fp.compare_edited(df).collect()
    assert sorted(r.doc_id for r in got) == sorted(want)
    for r in got:
        t, e, nxt = want[r.doc_id]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        exact = max(len(shingle_set(t) | shingle_set(e)), len(shingle_set(t) | shingle_set(nxt))) <= fp.K
        assert abs(r.near_edited - alike(t, e)) < (1e-9 if exact else 0.25)
        assert abs(r.near_next - alike(t, nxt)) < (1e-9 if exact else 0.25)
        n = len(shingle_set(t))
        assert r.distinct_shingles == n if n < fp.K else abs(r.distinct_shingles / n - 1) < 0.5
    by = {}
    for r in got:
        assert by.setdefault(want[r.doc_id][0], r.fingerprint) == r.fingerprint
    errors = [r.near_edited - alike(*want[r.doc_id][:2]) for r in got]
    assert abs(sum(errors) / max(1, len(errors))) < 0.02


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check(spark, [(r.doc_id, r.text) for r in docs.collect()], docs.repartition(3))


def test_sparse_ids_and_small_ranges(spark):
    rows = [(i * i * i - 500, f"text number {i} " * (i % 7), None, None, None) for i in range(40)]
    df = spark.createDataFrame(rows, fixtures.SCHEMA).repartition(4).select("doc_id", F.col("text"))
    got = {r.doc_id: r.next_text for r in fp.with_next(df, rows_per_range=3).collect()}
    assert got == {d: nxt for d, (_, _, nxt) in edited([r[:2] for r in rows]).items()}


def test_odd_rows(spark):
    got = fp.compare_edited(fixtures.odd(spark)).collect()
    assert len(got) == len(fixtures.odd_rows())
    assert {r.near_next for r in got if r.doc_id == 8} == {1.0}
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fp.compare_edited(fixtures.none(spark)).collect() == []
    one = fp.compare_edited(fixtures.docs(spark, ["only one document here now"])).collect()[0]
    assert one.near_next == 1.0


def test_parts_merge_to_the_whole(spark):
    rows = [(i % 2, " ".join(f"w{(i * 37 + j) % 400}" for j in range(200))) for i in range(12)]
    df = fp.with_sketch(spark.createDataFrame(rows, "k int, text string"), "text", "s")
    got = {r.k: r.s for r in fp.merge_groups(df, "k", "s").collect()}
    hashes = {r.k: r.h for r in fp.with_sketch(spark.createDataFrame(rows, "k int, text string"), "text", "h", k=10**6).groupBy("k").agg(F.array_distinct(F.flatten(F.collect_list("h"))).alias("h")).collect()}
    assert got == {k: sorted(h)[: fp.K] for k, h in hashes.items()}
    pair = df.limit(2).select(F.lit(1).alias("x"), "s").groupBy("x").agg(F.first("s").alias("a"), F.last("s").alias("b"))
    r = pair.select(fp.containment("a", "b").alias("c"), fp.merged("a", "b").alias("m")).first()
    assert 0 <= r.c <= 1 and len(r.m) == fp.K
