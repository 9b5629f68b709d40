import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from weftgraph.llm import hmm

from . import fixtures


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [None]


def brute(rows):
    held = [d is not None and zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows]
    counts = Counter(t for (_, x), h in zip(rows, held) if not h for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    return [(d, h, len(tokens(x)), sum(counts[t] > 0 for t in tokens(x)), sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens(x)), n) for (d, x), h in zip(rows, held)]


def key(r):
    return (r[0] is not None, r[0] or 0, r[2])


def check(rows, got):
    want = sorted(brute(rows), key=key)
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.base_score, r.train_tokens, r.score) for r in got), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:4] == w[:4] and g[5] == w[5] and math.isclose(g[4], w[4], rel_tol=1e-9) and math.isfinite(g[6]) and g[6] < 0


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = hmm.score(docs.repartition(3), block_tokens=50_000, rounds=4).collect()
    check([(r.doc_id, r.text) for r in docs.collect()], got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > 0.97 * sum(r.base_score for r in held)
    assert sum(r.score for r in held) / sum(r.n_tokens for r in held) > sum(r.base_score for r in held) / sum(r.n_tokens for r in held)


def test_odd_rows(spark):
    check([r[:2] for r in fixtures.odd_rows()], hmm.score(fixtures.odd(spark), rounds=1).collect())
    assert hmm.score(fixtures.none(spark), rounds=1).collect() == []


def model(states=3, symbols=5, seed=1):
    rng = np.random.default_rng(seed)
    start, move, emit = rng.random(states), rng.random((states, states)), rng.random((symbols, states))
    return hmm.Hmm(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def paths(m, text):
    for p in itertools.product(range(len(m.start)), repeat=len(text)):
        w = m.start[p[0]] * m.emit[text[0], p[0]]
        for t in range(1, len(text)):
            w *= m.move[p[t - 1], p[t]] * m.emit[text[t], p[t]]
        yield p, w


def test_likelihood_and_counts_equal_the_sum_over_all_paths():
    m = model()
    texts = [np.array(t) for t in ([0, 1, 4, 2], [3], [2, 2, 0, 1, 1, 3])]
    want = [sum(w for _, w in paths(m, t)) for t in texts]
    assert np.allclose(m.log10(texts), np.log10(want))
    starts, moves, emits = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for t, total in zip(texts, want):
        for p, w in paths(m, t):
            starts[p[0]] += w / total
            for i, s in enumerate(p):
                emits[t[i], s] += w / total
                if i:
                    moves[p[i - 1], s] += w / total
    for a, b in zip(m.expected(texts), (starts, moves, emits)):
        assert np.allclose(a, b)


def plain_counts(m, t):
    """The recursions over one whole text, step by step."""
    k, n = len(m.start), len(t)
    a, b, scale = np.zeros((n, k)), np.ones((n, k)), np.zeros(n)
    for i, x in enumerate(t):
        a[i] = (m.start if i == 0 else a[i - 1] @ m.move) * m.emit[x]
        scale[i] = a[i].sum()
        a[i] /= scale[i]
    moves, emits = np.zeros((k, k)), np.zeros_like(m.emit)
    for i in range(n - 2, -1, -1):
        up = m.emit[t[i + 1]] * b[i + 1] / scale[i + 1]
        b[i] = m.move @ up
        moves += m.move * np.outer(a[i], up)
    np.add.at(emits, t, a * b)
    return a[0] * b[0], moves, emits


@pytest.mark.parametrize(("stretch", "chunk"), [(512, 512), (16, 512), (7, 5), (1, 3)])
def test_counts_of_whole_texts(monkeypatch, stretch, chunk):
    """Texts of up to 1,000 tokens, cut into stretches and parts: the counts are those of one run over each text. Two
    states of the last model are never left, so nothing is ever forgotten."""
    monkeypatch.setattr(hmm, "STRETCH", stretch)
    monkeypatch.setattr(hmm, "CHUNK", chunk)
    rng = np.random.default_rng(9)
    slow = model(3, 6, seed=4)
    slow.move = np.eye(3) * 0.97 + 0.01
    stuck = model(2, 6, seed=5)
    stuck.move, stuck.emit = np.eye(2), np.full((6, 2), 1 / 6)
    for m in (model(4, 6, seed=3), slow, stuck):
        texts = [rng.integers(0, 6, n) for n in (1000, 1, 2, 333, 57, 6, 16, 600)]
        for got, want in zip(m.expected(texts), map(sum, zip(*[plain_counts(m, t) for t in texts]))):
            assert np.allclose(got, want, rtol=1e-6, atol=1e-6)


def test_training_raises_the_likelihood():
    true, rng, texts = model(seed=5), np.random.default_rng(3), []
    for _ in range(200):
        s, t = rng.choice(3, p=true.start), []
        for _ in range(30):
            t.append(rng.choice(5, p=true.emit[:, s]))
            s = rng.choice(3, p=true.move[s])
        texts.append(np.array(t))
    flat = np.bincount(np.concatenate(texts), minlength=5) / 6000
    m, before = hmm.Hmm.first(flat, 3), -np.inf
    for _ in range(6):
        now = m.log10(texts).sum()
        assert now >= before - 0.5
        m, before = m.estimate(*m.expected(texts), flat), now


def test_probabilities_sum_to_one():
    m = model(2, 3)
    assert np.isclose(sum(10 ** m.log10([np.array(t)])[0] for t in itertools.product(range(3), repeat=4)), 1)
