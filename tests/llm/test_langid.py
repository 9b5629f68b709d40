import math
import zlib
from unittest import mock

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftgraph.llm import langid

from . import fixtures


def clean(m, text):
    return "".join(chr(256 + c) for c in m.alphabet.codes(text))


def brute_phrases(sample: str, text: str) -> int:
    n = at = 0
    while at < len(text):
        k = 1
        while at + k < len(text) + 1 and text[at : at + k] in sample:
            k += 1
        at += max(1, k - 1)
        n += 1
    return n


def brute(m, samples, text):
    """What predict() gives, from the definition."""
    whole = {k: "".join(clean(m, t + " ") for t in v) for k, v in samples.items()}
    text = clean(m, text)
    if not text.strip(chr(256)):
        return "und", 0.0, None
    phrases = {k: brute_phrases(v, text) for k, v in whole.items()}
    bits = {k: n * math.log2(max(2, len(whole[k]))) for k, n in phrases.items()}
    best = min(sorted(bits), key=bits.get)
    weights = [2.0 ** -((bits[k] - bits[best]) / math.log2(max(2, len(whole[k])))) for k in bits]
    return best, 1 / sum(weights), bits[best] / len(text)


@settings(max_examples=150, deadline=None)
@given(st.integers(2, 40), st.integers(0, 4), st.text(st.sampled_from("abc "), min_size=1, max_size=40), st.lists(st.text(st.sampled_from("abcd  "), max_size=60), min_size=1, max_size=4))
def test_phrases_equal_brute_force(block, dense, sample, texts):
    """With blocks, segments and dense rows of all sizes; ties and unknown letters among them."""
    with mock.patch.multiple(langid, BLOCK=block, SEGMENT=2 * block + 1, DENSE=dense):
        samples = {"x": [sample], "y": ["cab", "b"], "z": ["cab", "b"]}
        m = langid.Model(samples)
        total, sizes, _ = m.phrases(texts)
        assert sizes.tolist() == [len(clean(m, t)) for t in texts]
        assert total[:, 0].tolist() == [brute_phrases(clean(m, sample + " "), clean(m, t)) for t in texts]
        for got, t in zip(m.predict(texts), texts):
            assert got[0] != "z" and got == pytest.approx(brute(m, samples, t))


def test_long_texts_are_parsed_as_a_whole():
    """Phrases that span many blocks, whose ends depend on where the text begins."""
    rng = np.random.default_rng(2)
    sample = "ab" * 3000 + "".join(rng.choice(list("abcde"), 3000))
    samples = {"x": [sample], "y": ["".join(rng.choice(list("abc "), 500))]}
    texts = ["ab" * 5000, "b" + "ab" * 4000 + "e" + "ab" * 3000, "".join(rng.choice(list("abcde "), 20_000)), "c"]
    with mock.patch.multiple(langid, BLOCK=64, SEGMENT=1000):
        m = langid.Model(samples)
        total = m.phrases(texts)[0]
    for k, v in enumerate(samples.values()):
        assert total[:, k].tolist() == [brute_phrases(clean(m, v[0] + " "), clean(m, t)) for t in texts]


def made_up(rng, letters: str, words: int) -> list[str]:
    return ["".join(rng.choice(list(letters), rng.integers(2, 9))) for _ in range(words)]


def test_seven_scripts_and_forty_labels(spark):
    """No letter and no label is left out, whatever their number: scripts, an alphabet of 3,000 letters, 40 labels."""
    rng = np.random.default_rng(3)
    span = lambda a, n: "".join(chr(a + i) for i in range(n) if chr(a + i).isalpha())
    scripts = {"la": "abcdefghijklmnopqrstuvwxyz", "lb": "abdefghijklmnoprstuvzäöüßéèåøæ", "ca": span(0x430, 32), "cb": span(0x430, 32) + "іїєґўџљњ", "el": span(0x3B1, 25), "he": span(0x5D0, 27), "ar": span(0x621, 42), "zh": span(0x4E00, 3000)}
    scripts |= {f"l{i:02}": "abcdefghijklmnopqrstuvwxyz" for i in range(32)}
    rows, n = [], 0
    for lang, letters in scripts.items():
        words = made_up(rng, letters, 60)
        for _ in range(12):
            n += 1
            rows.append((n, " ".join(rng.choice(words, 60)), lang, None, None))
    rows += [(n + 1 + i, "odd one", "la", None, None) for i in range(50)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, fixtures.SCHEMA)).collect()}
    wrong = [(r[2], got[r[0]].lang_pred) for r in rows if r[1] != "odd one" and got[r[0]].lang_pred != r[2]]
    assert len(scripts) == 40 and len(wrong) <= 0.02 * n, wrong


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and len(r) and r.lang is not None]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97


def test_odd_rows(spark):
    got = langid.identify(fixtures.odd(spark)).collect()
    assert len(got) == len(fixtures.odd_rows())
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[7].lang_pred == by[8].lang_pred == by[9].lang_pred == "und" and by[9].score == 0
    assert by[3].lang_pred in ("en", "fr")


def test_nothing_to_learn_from(spark):
    assert {r.lang_pred for r in langid.identify(fixtures.docs(spark, ["some text", None])).collect()} == {"und"}
    assert langid.identify(fixtures.none(spark)).collect() == []
