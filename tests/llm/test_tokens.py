import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from weftgraph.llm import packing, token_store
from weftgraph.llm.common import shared_path
from weftgraph.llm.tokens import WordEncoder, encoder

from . import fixtures

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


def library(name):
    t = Tokenizer.from_file(P.path(name))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", FILES)
def test_memo_gives_the_librarys_ids(spark, name):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    enc, lib = encoder(P.path(name)), library(name)
    assert enc.kind in ("byte", "word")
    for t, got in zip(texts, enc.encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == lib(t)


@pytest.mark.parametrize("name", FILES)
def test_memo_on_odd_texts(name):
    enc, lib = encoder(P.path(name)), library(name)

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.text(st.sampled_from("ab é́\n \t\r'sS~<|endoftext>1２٣ς \x1c\U0001f600$"), max_size=30), max_size=4))
    def run(texts):
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == [lib(t) for t in texts]

    run()


def test_memo_halves():
    enc, lib = WordEncoder(P.path(FILES[0]), memo_words=5), library(FILES[0])
    for texts in (["a b c", "d e f"], ["a b", "g h i j k l"], ["a b", "c"], ["a g h", "m n o p q"], ["a", "c"]):
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == [lib(t) for t in texts]


def key(x):
    return (x is not None, x)


def test_store_round_trip(spark):
    docs, lib = fixtures.odd(spark), library(FILES[0])
    got = token_store.read_tokens(token_store.write_tokens(docs, P.path(FILES[0]), docs_per_file=2)).collect()
    ids = sorted(((d, np.array(lib(t or "") + [2], "<u4").tobytes()) for d, t, *_ in fixtures.odd_rows()), key=lambda x: (key(x[0]), zlib.crc32(x[1])))
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got if r.doc_id is not None) == sorted((d, len(b) // 4, zlib.crc32(b)) for d, b in ids if d is not None)
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == [d for d, _ in ids]
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()


def test_shards_of_many_files(spark):
    """More rows than all shards would hold at that many a file."""
    docs, lib = fixtures.docs(spark, [f"text number {i} " + "x" * (i % 7) for i in range(100)]), library(FILES[0])
    manifest = token_store.write_tokens(docs.repartition(3), P.path(FILES[0]), docs_per_file=4, max_shards=3)
    files = sorted(manifest.collect(), key=lambda r: (r.shard, r.part))
    assert len({r.shard for r in files}) <= 3 and len(files) >= 25 and max(r.n_docs for r in files) == 4
    got = sorted(token_store.read_tokens(manifest).collect(), key=lambda r: r.doc_id)
    ends = np.cumsum([len(lib(r.text)) + 1 for r in docs.orderBy("doc_id").collect()]).tolist()
    assert [r.start for r in got] == [0, *ends[:-1]] and [r.start + r.n_tokens for r in got] == ends


def test_store_reads_single_documents_and_finds_damage(spark):
    import zstandard

    out = shared_path(spark, "t")
    files = token_store.write_tokens(fixtures.docs(spark, ["one two", "three", "", "four five six"]), P.path(FILES[0]), out=out).collect()
    assert len(files) == 1 and files[0].n_docs == 4
    f, lib = token_store.TokenFile(files[0].path), library(FILES[0])
    assert f.ids(3).tolist() == lib("four five six") + [2] and f.doc_id(3) == 3 and f.ids(2).tolist() == [2]
    path = files[0].path.removeprefix("file:")
    data = bytearray(open(path, "rb").read())
    whole = zstandard.ZstdDecompressor().stream_reader(bytes(data), read_across_frames=True).read()
    assert np.frombuffer(whole, "<u2").tolist() == [i for t in ("one two", "three", "", "four five six") for i in lib(t) + [2]]
    data[int(f.offsets[1]) + 6] ^= 1
    open(path, "wb").write(data)
    bad = token_store.TokenFile(files[0].path)
    assert bad.ids(0).tolist() == lib("one two") + [2]
    with pytest.raises(Exception):
        bad.ids(1)


def test_store_empty(spark):
    assert token_store.read_tokens(token_store.write_tokens(fixtures.none(spark), P.path(FILES[0]))).collect() == []


def check_pieces(rows, want, tiers=packing.TIERS):
    """want: list of (doc_id, ids). Ids are unique here."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == {d for d, _ in want}
    for d, ids in want:
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= max(tiers) and at & (at - 1) == 0 and all(r.tier == at for r in seq)


def test_packing(spark, sf_dir):
    lib = library(FILES[1])
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = [(r.doc_id, lib(r.text) + [2]) for r in docs.collect()]
    rows = packing.pack(docs, P.path(FILES[1])).collect()
    check_pieces(rows, want)
    small = packing.pack(docs.repartition(3), P.path(FILES[1]), block_tokens=9000, step_tokens=8192).collect()
    check_pieces(small, want)
    assert sum(r.length for r in rows if r.tier < 512) < 512 * docs.rdd.getNumPartitions()


def test_packing_odd_rows(spark):
    lib = library(FILES[1])
    rows = packing.pack(fixtures.odd(spark).coalesce(1), P.path(FILES[1])).collect()
    assert sum(r.length for r in rows) == sum(len(lib(t or "")) + 1 for _, t, *_ in fixtures.odd_rows())
    assert packing.pack(fixtures.none(spark), P.path(FILES[1])).collect() == []


def test_step_groups_are_balanced():
    windows = [[(0, None, 0, n)] * (1024 // n) for n in (64, 128, 256, 512, 1024) for _ in range(10)]
    groups = packing.step_groups(windows, 10240)
    costs = {}
    for w, g in zip(windows, groups):
        costs[g] = costs.get(g, 0) + sum((p[3] - p[2]) ** 2 for p in w)
    assert len(costs) == 5 and max(costs.values()) < 1.1 * min(costs.values())
