import hashlib
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from weftgraph.llm.exact_dedup import exact_groups, heavy_hitters, shrink

from . import fixtures


def brute(rows):
    groups = {}
    for d, t, *_ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(d)
    out = []
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(d, keep, len(ids), d == keep, hashlib.sha256(t.encode()).hexdigest()) for d in ids]
    return Counter(out)


def test_odd_rows(spark):
    assert Counter(map(tuple, exact_groups(fixtures.odd(spark)).collect())) == brute(fixtures.odd_rows())


def test_empty(spark):
    assert exact_groups(fixtures.none(spark)).collect() == []


def test_heavy_hitters_take_another_way_with_the_same_result(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i % 40}", None, None, None) for i in range(900)]
    got = exact_groups(spark.createDataFrame(rows, fixtures.SCHEMA), counters=5).collect()
    assert Counter(map(tuple, got)) == brute(rows)


def test_candidates_are_bounded_and_hold_the_frequent(spark):
    keys = spark.createDataFrame([(bytes([i % 7 if i % 2 else 200]),) for i in range(2000)], "digest binary").repartition(5)
    found = {bytes(r.digest) for r in heavy_hitters(keys, 4).collect()}
    assert bytes([200]) in found and len(found) <= 5


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 12), max_size=80), st.integers(1, 6))
def test_misra_gries_bounds(items, k):
    counts = Counter()
    for i in range(0, len(items), 7):
        counts.update(items[i : i + 7])
        shrink(counts, k)
    true = Counter(items)
    assert len(counts) <= k
    assert all(true[x] - len(items) / (k + 1) <= counts[x] <= true[x] for x in true)
