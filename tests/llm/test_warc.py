import hashlib
import io

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftgraph.llm import warc

SCHEMA = "page_id long, url string, html string"


def brute(rows):
    best = {}
    for p, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 1000:
            best.setdefault(b, []).append(p)
    best = {b: max((p for p in ps if p is not None), default=None) for b, ps in best.items()}
    out = []
    for p, _, h in rows:
        b = (h or "").encode()
        first = b not in best or best[b] == p
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "response" if first else "revisit", None if first else best[b]))
    return out


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is not None, x) for x in r))


def test_pages(spark):
    big = ["<p>" + c * 1200 for c in "abé"]
    rows = [(i, f"http://h/{i} x", big[i % 3] if i % 4 else f"small{i % 2}") for i in range(40)]
    rows += [(None, None, big[0]), (50, None, None), (51, "", ""), (52, "u", "é" * 500), (52, "u", "é" * 500), (53, "u", "x" * 300_000)]
    df = spark.createDataFrame(rows, SCHEMA + "").repartition(3)
    manifest = warc.write_archives(df)
    assert order(warc.read_archives(manifest).collect()) == order(brute(rows))
    payloads = {(r[0], r[5]) for m in manifest.collect() for r in warc.page_rows(m.path) if r[5] is not None}
    assert all(((h or "").encode()) in {x for _, x in payloads} for _, _, h in rows)


def test_small_archives_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    rows = [(i, f"http://h/{i}", "<p>" + "ab"[i % 2] * 1500 if i % 3 else f"page {i}") for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA + "").withColumns({c: F.lit("clash") for c in ("digest", "size", "refers_to", "revisit", "path", "n_records", "copies", "last", "payload_bytes", "record_type")})
    manifest = warc.write_archives(df.coalesce(2), archive_bytes=3000)
    assert order(warc.read_archives(manifest).collect()) == order(brute(rows))
    assert manifest.count() > 4 and sum(m.n_records for m in manifest.collect()) == 60


def test_empty(spark):
    assert warc.read_archives(warc.write_archives(spark.createDataFrame([], SCHEMA))).collect() == []


def records(n):
    return [warc.record("response", {"WARC-Record-ID": f"<urn:page:{i}>"}, (f"<html>{i}" + "common words in every page " * 40).encode()) for i in range(n)]


def test_dictionary_leads_and_is_used():
    want = records(400)
    data = b"".join(warc.archive(iter(want)))
    assert data[:4] == warc.DICT_FRAME.to_bytes(4, "little")
    assert list(warc.frames(io.BytesIO(data), 100)) == want
    with pytest.raises(ValueError):
        list(warc.frames(io.BytesIO(data[8 + int.from_bytes(data[4:8], "little") :])))
    with pytest.raises(ValueError):
        list(warc.frames(io.BytesIO(data[:-3])))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.binary(max_size=300), max_size=5), st.integers(1, 40))
def test_round_trip(blocks, chunk):
    want = [warc.record("response", {"WARC-Record-ID": "<urn:page:1>"}, b) for b in blocks]
    got = list(warc.frames(io.BytesIO(b"".join(warc.archive(iter(want)))), chunk))
    assert got == want and [warc.parse(x)[1] for x in got] == blocks


@pytest.mark.parametrize("change", [(b"WARC/1.1", b"WARC/9.9"), (b"Content-Length: 5", b"Content-Length: 4"), (b"hello", b"jello"), (b"WARC-Record-ID", b"WARC-Other"), (b"WARC-Date: ", b"WARC-Date ")])
def test_invalid_records(change):
    good = warc.record("response", {"WARC-Record-ID": "<urn:page:1>"}, b"hello")
    assert warc.parse(good)[1] == b"hello"
    with pytest.raises(ValueError):
        warc.parse(good.replace(*change))
