import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftgraph.llm import near_dedup as nd
from weftgraph.llm.components import components

from . import fixtures


def shingle_set(text, k):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k, percent=80):
    """rows: (doc_id, text) with distinct ids."""
    sets = [(d, shingle_set(t, k)) for d, t in rows]
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return sorted((d, len(s), find(d), find(d) == d) for d, s in sets)


@pytest.mark.parametrize("words", [4, 5])
def test_documents(spark, words):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], words)
    assert sorted(map(tuple, nd.near_groups(docs, words=words).collect())) == want
    assert sum(not r[3] for r in want) > 50


def test_chains_and_hot_groups(spark):
    """A chain whose ends differ, a large group of near copies of one text, and texts that share a passage but are apart."""
    rng = random.Random(5)
    w = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts, t = [], w(120)
    for i in range(40):
        t = t[:]
        t[3 * i] = f"new{i}"
        texts.append(" ".join(t))
    base = w(100)
    for i in range(150):
        x = base[:]
        x[rng.randrange(100)] = f"e{i}"
        texts.append(" ".join(x))
    passage = w(80)
    texts += [" ".join(passage + w(60)) for _ in range(60)]
    texts += ["Same TEXT here again", "same text here AGAIN", "one", "ONE two", "one two", "", None]
    got = sorted(map(tuple, nd.near_groups(fixtures.docs(spark, texts).repartition(5), words=4).collect()))
    assert got == brute(list(enumerate(texts)), 4)


@pytest.mark.parametrize("block", [256, 16])
def test_hub_with_spokes(spark, monkeypatch, block):
    """Copies like the original (0.85) but not like each other (0.72), the original neither the smallest nor the largest."""
    monkeypatch.setattr(nd, "BLOCK", block, raising=False)
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    texts = []
    for i in range(300):
        x = base[:]
        for j in range(4):
            x[50 * j + rng.randrange(4, 46)] = f"s{i}x{j}"
        texts.append(" ".join(x))
    texts[150] = " ".join(base)
    got = sorted(map(tuple, nd.near_groups(fixtures.docs(spark, texts).repartition(5), words=4).collect()))
    want = brute(list(enumerate(texts)), 4)
    assert len({r[2] for r in want}) == 1 and got == want


@pytest.mark.parametrize(("count", "pairs", "few"), [(200, 400, 500_000), (400, 800, 10)])
def test_mixed_buckets_lose_no_link(spark, monkeypatch, count, pairs, few):
    """Copies of one text with two words replaced each, of so many (position, word) pairs: some are alike, most are not,
    nearly all meet in the same buckets. Also by way of the shuffled texts."""
    monkeypatch.setattr(nd, "BROADCAST_NODES", few)
    rng = random.Random(1)
    base = [f"b{rng.randrange(10**6)}" for _ in range(100)]
    changes = [(p, f"c{i}") for i in range(pairs // 19 + 1) for p in range(4, 95, 5)][:pairs]
    texts = []
    for _ in range(count):
        x = base[:]
        for p, w in rng.sample(changes, 2):
            x[p] = w
        texts.append(" ".join(x))
    got = sorted(map(tuple, nd.near_groups(fixtures.docs(spark, texts).repartition(5), words=4).collect()))
    want = brute(list(enumerate(texts)), 4)
    assert got == want and len({r[2] for r in want}) > 1


def test_many_repeated_rows(spark):
    """A third of the rows are one row, another third copies of its text under other ids, in many partitions."""
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(7, base)] * 100 + [(100 + i, base) for i in range(100)] + [(300 + i, base + f" x{i}" if i % 2 else f"other {i} words") for i in range(100)]
    df = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], fixtures.SCHEMA).repartition(6)
    got = nd.near_groups(df, words=4).collect()
    want = {r[0]: r for r in brute(sorted(set(rows)), 4)}
    assert len(got) == 300 and all(tuple(r) == want[r.doc_id] for r in got) and sum(r.kept for r in got) == 150


def test_nothing_is_left_behind(spark):
    """All tables but the result's are deleted."""
    from pathlib import Path

    from weftgraph.llm.common import shared_root

    folder = Path(shared_root(spark).removeprefix("file:")) / "weftgraph"
    before = set(folder.glob("*")) if folder.exists() else set()
    nd.near_groups(fixtures.docs(spark, ["a b c d e", "a b c d e", "x"])).collect()
    assert [p.name.split("-")[0] for p in set(folder.glob("*")) - before] == ["near"]


def test_odd_rows(spark):
    got = nd.near_groups(fixtures.odd(spark)).collect()
    assert len(got) == len(fixtures.odd_rows())
    same = [r for r in got if r.n_shingles == 2 and r.component_id == 3]
    assert len(same) == 4 and sum(r.kept for r in same) == 2
    assert all(r.kept and r.component_id == r.doc_id for r in got if r.n_shingles == 0)
    assert nd.near_groups(fixtures.none(spark)).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=400))
def test_values_by_definition(items):
    signer, u = nd.Signer(8, 3), np.array(sorted(items), dtype="u8")
    low = {}
    for x in sorted(items):
        low.setdefault((x >> 32) * 24 >> 32, x)
    want = [low[i] if i in low else next(low[j] for j in signer.orders[i].tolist() if j in low) for i in range(24)]
    assert signer.values(u).tolist() == want


def test_bins_agree_with_the_probability_of_resemblance():
    rng, signer = np.random.default_rng(1), nd.Signer()
    for n in (5, 50, 2000):
        rate = []
        for _ in range(60):
            a = np.unique(rng.integers(0, 2**64, 2 * n, dtype="u8", endpoint=False))
            x, y = np.sort(a[rng.permutation(len(a))[: int(1.8 * n)]]), a
            rate.append((signer.values(x) == signer.values(y)).mean() - len(x) / len(a))
        assert abs(np.mean(rate)) < 0.06


def test_components(spark):
    rng = random.Random(2)
    links = [(a, b) for a, b in ((rng.randrange(300), rng.randrange(300)) for _ in range(220)) if a != b]
    root = list(range(300))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    df = spark.createDataFrame(links, "a long, b long")
    first = components(df.limit(100))
    for got in (components(df), components(df, first)):
        assert {(r.node, r.comp) for r in got.collect()} == {(x, find(x)) for x in range(300) if find(x) != x}
