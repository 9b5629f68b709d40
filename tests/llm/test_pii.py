import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftgraph.llm import pii

from . import fixtures

REFERENCE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        total = sum((x * 2 - 9 if x > 4 else x * 2) if i % 2 else x for i, x in enumerate(map(int, reversed(d))))
        return 14 <= len(d) <= 19 and total % 10 == 0
    return kind != "phone" or 10 <= len(d) <= 15


def base_spans(text):
    out = [(m.start(), i, k, m.end()) for i, (k, p) in enumerate(REFERENCE.items()) for m in re.finditer(p, text or "") if passes(k, m.group())]
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(out)]


def check(spark, rows, df):
    got = pii.digest(pii.find(df)).collect()
    want = {}
    for d, t in rows:
        want.setdefault(d, []).append(base_spans(t))
    assert len(got) == len(rows)
    for r in got:
        base = [s for s in r.spans.split(",") if s.split(":")[0] in REFERENCE]
        assert base in want[r.doc_id], (r, want[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in base) for k in REFERENCE]
    return got


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = check(spark, [(r.doc_id, r.text) for r in docs.collect()], docs)
    assert sum(r.n_card for r in got) > 5 and sum(r.n_email for r in got) > 5


def test_odd_rows(spark):
    check(spark, [r[:2] for r in fixtures.odd_rows()], fixtures.odd(spark))
    assert pii.find(fixtures.none(spark)).collect() == []


def test_made_up_texts(spark):
    rng = random.Random(4)
    parts = ["a@b.c", "x.y%z@host-1.org", "@", ".d@e.f", "_q@r.s", "1.2.3.4", "256.1.1.1", "1.2.3", ".5", "000.01.255.0", "4111 1111 1111 1111", "4111-1111-1111-1112", "5500000000000004", " - ", "+1 (603) 555-8791", "+49.30-123 4567 8", "+1", "7", "é\U0001f600", " tel ", "\n", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "GB82WEST12345698765431", 'token = "4d44c79e8bf7c557aa"', "phone 030 1234 5678", "00000000000000"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", "x"]) for _ in range(rng.randrange(1, 9))) for _ in range(1500)]
    check(spark, list(enumerate(texts)), fixtures.docs(spark, texts).repartition(4))


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text(st.sampled_from("a@.b1+-2 (5)_é0"), max_size=60), min_size=40, max_size=80))
def test_any_text(spark, texts):
    check(spark, list(enumerate(texts)), fixtures.docs(spark, texts))


def test_long_runs_stay_linear(spark):
    texts = ["a" * 300_000, "1" * 300_000, "1 " * 100_000, "a.b" * 100_000, "1." * 10_000, "+1" * 100_000, "a@b" + ".c" * 50_000]
    got = {r.doc_id: r for r in pii.digest(pii.find(fixtures.docs(spark, texts))).collect()}  # brute force is quadratic here
    assert [got[i].n_email for i in range(7)] == [0, 0, 0, 0, 0, 0, 1] and got[4].n_ip == 2500 and got[1].n_card == got[2].n_card == 0


def test_added_spans_and_scores(spark):
    texts = ["My IBAN is DE89 3704 0044 0532 0130 00.", "pay to GB82WEST12345698765431 now", "call me, phone 030 1234 5678 please", "in room 030 1234 5678 there", 'token = "4d44c79e8bf7c557aa"', "sample mail a@b.org", "write mail to a@b.org"]
    got = {r.doc_id: r.spans for r in pii.find(fixtures.docs(spark, texts)).collect()}
    assert [(s.kind, texts[0][s.start : s.end]) for s in got[0]] == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert got[1] == [] and got[3] == []
    assert [(s.kind, texts[2][s.start : s.end]) for s in got[2]] == [("natphone", "030 1234 5678")]
    assert [s.kind for s in got[4]] == ["secret"]
    assert got[5][0].score < got[6][0].score


def test_groups_followed_by_words_and_numbers(spark):
    iban = "DE89 3704 0044 0532 0130 00"
    texts = [f"IBAN {iban} BIC COBADEFFXXX", f"{iban} A", f"{iban} 2024-01-05 paid", "DE89370400440532013000 BIC x", f"AB12 CDEF GHIJ KLMN {iban} Ab", "phone 030 1234 5678 2024 x", "phone 030 1234 5678 20th", f"{iban} {iban} é"]
    want = [[iban], [iban], [iban], ["DE89370400440532013000"], [iban], ["030 1234 5678"], ["030 1234 5678"], [iban, iban]]
    got = {r.doc_id: r.spans for r in pii.find(fixtures.docs(spark, texts)).collect()}
    assert [[texts[i][s.start : s.end] for s in got[i] if s.kind in ("iban", "natphone")] for i in range(len(texts))] == want


def test_redaction(spark):
    texts = ["write to a@b.org or +1 (603) 555-8791!", "nothing here", None, "é 4111 1111 1111 1111", "1.2.3.4"]
    df = fixtures.docs(spark, texts)
    got = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert got == {0: "write to <EMAIL> or <PHONE>!", 1: "nothing here", 2: None, 3: "é <CARD>", 4: "<IP>"}
    assert pii.redact(fixtures.odd(spark)).columns == fixtures.odd(spark).columns


def test_very_many_matches(spark):
    """Texts of 100,000 matches, confirmed or not, of one kind or several."""
    import time

    n = 100_000
    texts = ["12x" * n + "4111 1111 1111 1111", "a@b.c " * n, "tel 030 1234 5678; 1.2.3.4 " * (n // 2), "DE89370400440532013000 " * n, "no such thing"]
    df = fixtures.docs(spark, texts).repartition(5)
    began = time.time()
    got = {r.doc_id: r for r in pii.digest(pii.find(df)).collect()}
    assert got[0].spans == f"card:{3 * n}:{3 * n + 19}" and got[1].n_email == n and got[1].spans.endswith(f",email:{6 * n - 6}:{6 * n - 1}")
    assert got[2].n_ip == got[2].n_natphone == n // 2 and got[3].n_iban == n and got[4].spans == got[4].scores == ""
    new = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert new[0] == "12x" * n + "<CARD>" and new[1] == "<EMAIL> " * n and new[2] == "tel <NATPHONE>; <IP> " * (n // 2) and new[3] == "<IBAN> " * n
    assert time.time() - began < 120


def test_overlapping_spans(spark):
    """The passes over sorted spans against pairs, and replaced stretches against a plain loop."""
    rng = random.Random(8)
    parts = ["phone 030 1234 5678", "tel 030 1234 1.2.3.4", "+49 30 1234 5678 90", "tel 06 12 34 56 78 a@b.c", "4111 1111 1111 1111", "1.2.3.4", "a@1.2.3.4", "token: 06-12-34-56-78-90-12", "DE89 3704 0044 0532 0130 00"]
    texts = [rng.choice(["", " ", "é "]).join(rng.choice(parts) for _ in range(rng.randrange(1, 6))) for _ in range(400)]
    df = fixtures.docs(spark, texts).repartition(4)
    found = {r.doc_id: r.spans for r in pii.find(df).collect()}
    new = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert sum(len(v) for v in found.values()) > 500
    for i, t in enumerate(texts):
        others = [s for s in found[i] if s.kind != "natphone"]
        assert not any(a.start < b.end and b.start < a.end for a in others for b in found[i] if b.kind == "natphone")
        out, at, end = "", 0, -1
        for s in found[i]:
            if s.start >= end:
                out += t[at : s.start] + f"<{s.kind.upper()}>"
            end = max(end, s.end)
            at = end
        assert new[i] == out + t[at:]
