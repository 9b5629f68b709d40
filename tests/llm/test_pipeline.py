"""The pipeline against brute force, stage by stage."""

import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline as cp

from . import fixtures
from .test_exact_dedup import brute as brute_exact
from .test_near_dedup import brute as brute_near
from .test_pii import base_spans
from .test_tokens import check_pieces


def rows(df):
    return {r.doc_id: tuple(r) for r in df.collect()}


def test_stages_and_run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    junk = spark.createDataFrame([(10**6, "123 456 !!", None, "s", 10), (10**6 + 1, None, None, "s", None)], fixtures.SCHEMA)
    before = docs.unionByName(junk).cache()
    one = cp.language_id(spark, before, sf_dir).cache()
    assert one.columns == list(cp.COLUMNS) and rows(one) == rows(docs)
    two = cp.exact_duplicates(spark, one, sf_dir).cache()
    assert rows(two).keys() == {d for d, keep, _, kept, _ in brute_exact([(r.doc_id, r.text) for r in one.collect()]) if kept}
    three = cp.near_duplicates(spark, two, sf_dir).cache()
    assert rows(three).keys() == {d for d, _, _, kept in brute_near([(r.doc_id, r.text) for r in two.collect()], 5) if kept}
    four = cp.personal_data(spark, three, sf_dir).cache()
    assert rows(four).keys() == rows(three).keys()
    assert all(r.n_chars == len(r.text) and not base_spans(r.text) for r in four.collect())
    same = {d: t for d, t in rows(three).items() if not base_spans(t[1])}
    assert sum(rows(four)[d][1] == t[1] for d, t in same.items()) > 0.9 * len(same)
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    lib.encode_special_tokens = True
    want = [(r.doc_id, lib.encode(r.text, add_special_tokens=False).ids + [2]) for r in four.collect()]
    check_pieces(cp.packed(spark, four, sf_dir).collect(), want)
    whole = cp.run(spark, sf_dir)
    check_pieces(whole.collect(), want)


def test_odd_rows(spark, sf_dir):
    docs = fixtures.odd(spark).drop("row")
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.count() > 0, name
    docs = fixtures.none(spark)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0


def test_each_stage_begins_with_executors_that_gave_back_their_heaps(spark, sf_dir):
    """Full collections of the JVM, which is executor and driver here, by the time a stage has been planned."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    docs = fixtures.none(spark)
    for name, stage in cp.STAGES:
        before = full()
        stage(spark, docs, sf_dir)
        assert full() > before, name
