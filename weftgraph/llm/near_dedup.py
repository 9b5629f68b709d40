"""Near duplicates on word shingles: one-permutation hashing, optimal densification, banded buckets, star-shaped edges.

1. A text's set of word shingles is hashed once (64 bits); the upper bits give one of BANDS * ROWS bins, the smallest
   hash of a bin is its value. An empty bin takes the value of the first filled bin in a fixed random order of its own
   (optimal densification), so each bin of two sets agrees with the probability of their resemblance.
2. Texts with equal sets are one class, and only one of them goes on.
3. ROWS bins are a band; its hash is a bucket. Two sets of resemblance 0.8 share none of the 40 buckets with
   probability (1 - 0.8 ** 6) ** 40 = 5e-6.
4. First each class is confirmed against the smallest centre of all its buckets; then, for buckets whose members still
   belong to different components, against the bucket's smallest member, and then against its largest. That tries all
   pairs of buckets of up to three members. In each larger bucket that is still mixed, all pairs of members of different
   components are tried: the members are dealt into blocks (BLOCK members or BLOCK_SHINGLES shingles each, those of the
   largest component apart from the others), and a pair of blocks is a task's unit, whatever the bucket's size. A pair
   that shares several such buckets is tried in the smallest. No pair, member or bucket is left out.
5. Edges are confirmed on the full sets: 100 * intersection >= threshold * union. Links are joined to components.

Sets are made and stored for classes with a shared bucket only. Where these are few (BROADCAST_NODES, by count) their ids
are broadcast and no text is shuffled; else the texts are shuffled once. What belongs to a bucket is looked up by
``common.matched``, so the members of a bucket that holds many of them stay where they are. A set is looked up per edge by
sort-merge joins whose hot keys (a centre of many edges) adaptive execution splits. The result is a table of small rows;
all others are deleted when it is written.

Edge cases. Null text or text without words: an empty set, linked with nothing, each row its own component. With fewer
words than a shingle has, the whole sequence is the one shingle. A row with a null id takes part; where a component has
null ids only, component_id is null and its rows are kept. Rows of equal text are always in one component; those that
repeat the smallest id are the same document and all kept. An empty table gives an empty result. Other columns are never
read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import Scratch, bounded, kept, lookup, matched, pieces, text_or_empty
from .components import components, relabel

BANDS, ROWS, WORDS, PERCENT = 40, 6, 5, 80
NO_ID = 1 << 62
BLOCK, BLOCK_SHINGLES = 256, 1 << 19
#: Up to so many classes with a shared bucket, their ids (some 50 bytes each) are broadcast and no text is shuffled.
BROADCAST_NODES = 500_000
_P, _A, _B, _C = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))
_S30, _S27, _S31, _S32 = (np.uint64(x) for x in (30, 27, 31, 32))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S30)) * _A
    x = (x ^ (x >> _S27)) * _B
    return x ^ (x >> _S31)


def shingles(text: str, words: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles. bytes.lower() and bytes.split() change and see ASCII
    only: A-Z and the white space 20, 09-0D."""
    h = np.array(list(map(xxh64_intdigest, text.encode("utf-8", "surrogatepass").lower().split())), dtype="u8")
    if not len(h):
        return h
    n = max(1, len(h) - words + 1)
    size = min(words, len(h))
    x = np.full(n, size, dtype="u8")
    for i in range(size):
        x = x * _P + h[i : i + n]
    return np.unique(mix(x))


class Signer:
    """Band hashes of shingle sets."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        order = np.random.default_rng(20240607)
        self.orders = np.array([order.permutation(self.bins) for _ in range(self.bins)], dtype="i8")
        self.short = self.orders[:, :16]
        self.salt = mix(np.arange(1, bands + 1, dtype="u8") * _C)

    def values(self, hashes: np.ndarray) -> np.ndarray:
        """The value of each bin of a set that isn't empty."""
        bins = ((hashes >> _S32) * np.uint64(self.bins) >> _S32).astype("i8")
        first = np.concatenate([[0], np.flatnonzero(np.diff(bins)) + 1])
        filled = np.zeros(self.bins, dtype=bool)
        filled[bins[first]] = True
        value = np.zeros(self.bins, dtype="u8")
        value[bins[first]] = hashes[first]
        empty = np.flatnonzero(~filled)
        if len(empty):
            tries = filled[self.short[empty]]
            at = tries.argmax(axis=1)
            take = self.short[empty, at]
            far = ~tries[np.arange(len(empty)), at]
            if far.any():
                rows = self.orders[empty[far]]
                take[far] = rows[np.arange(len(rows)), filled[rows].argmax(axis=1)]
            value[empty] = value[take]
        return value

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        v = self.values(hashes).reshape(self.bands, self.rows)
        x = self.salt.copy()
        for i in range(self.rows):
            x = mix(x * _P + v[:, i])
        return x.view("i8")


def digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _signed(words: int, bands: int, rows: int):
    def run(batches):
        kept("near_dedup")
        signer = Signer(bands, rows)
        for b in pieces(batches):
            sizes, digests, keys = [], [], []
            for text in b.column(2).to_pylist():
                s = shingles(text, words)
                sizes.append(len(s))
                digests.append(digest(s) if len(s) else None)
                keys.append(signer.keys(s) if len(s) else np.zeros(0, "i8"))
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype("i4")
            flat = np.concatenate(keys) if keys else np.zeros(0, "i8")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64()))], ["doc_id", "id", "n_shingles", "digest", "bands"])

    return run


def _sets(words: int):
    """For mapInArrow: (node, digest, text) to (node, size, set). Of rows of one id, only those of the class's text count, and
    of those one in a partition."""

    def run(batches):
        seen: set[int] = set()
        for b in pieces(batches):
            nodes, sets = [], []
            for node, want, text in zip(*(c.to_pylist() for c in b.columns)):
                if node in seen:
                    continue
                s = shingles(text, words)
                if len(s) and digest(s) == want:
                    seen.add(node)
                    nodes.append(node)
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([len(x) // 8 for x in sets], pa.int64()), pa.array(sets, pa.binary())], ["node", "size", "shingles"])

    return run


def _confirmed(percent: int):
    def run(batches):
        for b in pieces(batches):
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, "u8"), np.frombuffer(y, "u8")
                both = len(np.intersect1d(x, y, assume_unique=True)) if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) else 0
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _linked(percent: int):
    """For applyInArrow: the members of one block, or of two blocks, of a bucket to links that join their components. Pairs
    of one component and pairs that share a bucket listed in ``seen`` are passed over."""

    def run(t: pa.Table) -> pa.Table:
        block, node, comp = (t.column(c).to_numpy().copy() for c in ("block", "node", "comp"))
        sets = [np.frombuffer(x, "u8") for x in t.column("shingles").to_pylist()]
        size = np.array([len(x) for x in sets], dtype="i8")
        ends = np.cumsum(size)
        starts = ends - size
        items = np.unique(np.concatenate(sets), return_inverse=True)[1]
        seen = t.column("seen").to_pylist()
        owner = np.repeat(np.arange(len(seen)), [len(x) for x in seen])
        buckets = np.unique(np.array([b for x in seen for b in x], dtype="i8"), return_inverse=True)[1]
        first, last = block.min(), block.max()
        marked, earlier = np.zeros(len(items), dtype="u1"), np.zeros(len(buckets), dtype=bool)
        a, b = [], []
        for x in np.flatnonzero(block == first):
            open_ = (block == last) & (comp != comp[x]) & (100 * np.minimum(size, size[x]) >= percent * np.maximum(size, size[x]))
            if first == last:
                open_[: x + 1] = False
            if len(buckets) and open_.any():
                own = buckets[owner == x]
                earlier[own] = True
                open_[owner[earlier[buckets]]] = False
                earlier[own] = False
            if not open_.any():
                continue
            own = items[starts[x] : ends[x]]
            marked[own] = 1
            both = np.add.reduceat(marked[items], starts, dtype="i8")
            marked[own] = 0
            hits = np.flatnonzero(open_ & (100 * both >= percent * (size + size[x] - both)))
            joined, at = np.unique(comp[hits], return_index=True)
            a += [node[x]] * len(at)
            b += node[hits[at]].tolist()
            comp[np.isin(comp, joined)] = comp[x]
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _blocks(apart: DataFrame, sets: DataFrame, table: Scratch) -> DataFrame | None:
    """Members (bucket, node, comp) of mixed buckets of more than three, once per pair of blocks that they are in: bucket,
    low, high, block, node, comp, seen, shingles; None if there are none. The largest component's blocks are not paired
    with one another."""
    mixed = apart.groupBy("bucket").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.count(F.lit(1)).alias("copies")).filter("least < most AND copies > 3")
    mixed = table(mixed.select("bucket", "copies"), "mixed")
    if not mixed.limit(1).count():
        return None
    held = matched(apart.select("bucket", "node", "comp"), mixed, "bucket", apart.count()).drop("copies").distinct()
    sized = table(held.join(sets.select("node", "size"), "node"), "sized")
    parts = sized.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"))
    whole = parts.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.max(F.struct("n", "s", "comp")).alias("top"))
    whole = whole.filter((F.col("n") > 3) & (F.col("top.n") < F.col("n")))

    def count(n, s):
        return F.greatest(F.ceil(n / BLOCK), F.ceil(s / BLOCK_SHINGLES)).cast("int")

    n, s, top = F.col("n"), F.col("s"), F.col("top")
    shape = whole.select("bucket", n.alias("copies"), top["comp"].alias("main"), count(n - top["n"], s - top["s"]).alias("others"), count(top["n"], top["s"]).alias("mains"))
    hard = table(matched(sized, table(shape, "shape"), "bucket", sized.count()), "hard")
    is_main, others, mains = F.col("comp") == F.col("main"), F.col("others"), F.col("mains")
    dealt = F.pmod(F.xxhash64("node", F.lit(7)), F.when(is_main, mains).otherwise(others)).cast("int")
    placed = hard.select("bucket", "node", "comp", F.when(is_main, others).otherwise(0).alias("base"), dealt.alias("dealt"), F.when(is_main, others).otherwise(others + mains).alias("partners"))
    placed = placed.select("bucket", "node", "comp", (F.col("base") + F.col("dealt")).alias("block"), F.explode(F.sequence(F.lit(0), F.col("partners") - 1)).alias("other"))
    pairs = placed.select("bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "comp")
    lists = hard.groupBy("node").agg(F.collect_set("bucket").alias("buckets")).join(sets.select("node", "shingles"), "node")
    return pairs.join(lists, "node").select("bucket", "low", "high", "block", "node", "comp", F.filter("buckets", lambda b: b < F.col("bucket")).alias("seen"), "shingles")


def near_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept."""
    text = text_or_empty(text_col)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    base = base.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID) + F.pmod(F.xxhash64("text"), F.lit(1 << 61))).alias("id"), "text")
    with Scratch(bounded(docs.sparkSession)) as table:
        return _near_groups(base, words, percent, bands, rows, table)


def _near_groups(base: DataFrame, words: int, percent: int, bands: int, rows: int, table: Scratch) -> DataFrame:
    signed = table(base.mapInArrow(_signed(words, bands, rows), "doc_id long, id long, n_shingles long, digest binary, bands array<long>"), "signed")
    found = signed.filter("n_shingles > 0")
    classes = table(found.groupBy("digest").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("copies")), "classes")

    # Buckets of more than one class, with their members and smallest member. Rows repeating an id and a text are one node.
    each = found.groupBy("digest", F.col("id").alias("node")).agg(F.first("bands").alias("bands"))
    nodes = table(each.join(classes.select("digest", "node"), ["digest", "node"]).select("node", "bands"), "nodes")
    held = nodes.select(F.explode("bands").alias("bucket"), "node")
    shared = held.groupBy("bucket").agg(F.min("node").alias("centre"), F.max("node").alias("last"), F.count(F.lit(1)).alias("copies")).filter("centre < last")
    shared = table(shared.select("bucket", "centre", "copies"), "shared")
    members = table(matched(held, shared, "bucket", nodes.count() * bands).select("bucket", "node", "centre"), "members")

    wanted = table(members.select("node").distinct().join(classes.select("node", "digest"), "node"), "wanted")
    n = wanted.count()
    texts = base.select(F.col("id").alias("node"), "text").join(F.broadcast(wanted) if n <= BROADCAST_NODES else wanted, "node").select("node", "digest", "text")
    sets = table(texts.mapInArrow(_sets(words), "node long, size long, shingles binary"), "sets")
    if sets.count() > n:  # rows that repeat an id and a text, in several partitions
        sets = table(sets.dropDuplicates(["node"]), "sets")

    def confirmed(edges: DataFrame) -> DataFrame:
        one = edges.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
        two = one.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")
        return table(two.mapInArrow(_confirmed(percent), "a long, b long"), "confirmed")

    def by_component(labels: DataFrame) -> DataFrame:
        return table(relabel(members.select("bucket", "node", F.col("node").alias("comp")), labels, ["comp"]), "apart")

    tried = table(members.filter("centre < node").groupBy(F.col("node").alias("a")).agg(F.min("centre").alias("b")), "tried")
    labels = components(confirmed(tried), table=table)
    for new in (F.min("node"), F.max("node")):
        apart = by_component(labels)
        mixed = apart.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), new.alias("new"), F.count(F.lit(1)).alias("copies")).filter("low < high")
        mixed = table(relabel(mixed.select("bucket", "new", F.col("new").alias("other"), "copies"), labels, ["other"]), "mixed")
        pairs = matched(apart, mixed, "bucket", apart.count()).filter("comp <> other")
        edges = pairs.select(F.greatest("node", "new").alias("a"), F.least("node", "new").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
        edges = table(edges, "edges")
        if edges.limit(1).count():
            labels = components(confirmed(edges), labels, table)
            tried = table(tried.unionByName(edges), "tried")

    if (blocks := _blocks(by_component(labels), sets, table)) is not None:
        links = blocks.groupBy("bucket", "low", "high").applyInArrow(_linked(percent), "a long, b long")
        labels = components(table(links, "links"), labels, table)

    class_of = table(relabel(classes.select("digest", "copies", F.col("node").alias("comp")), labels, ["comp"]), "class-components")
    all_rows = lookup(signed.select("doc_id", "n_shingles", "digest"), class_of, "digest", signed.count())
    own = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.when(F.col("comp") < NO_ID, F.col("comp")))
    return table(all_rows.select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept")), "near-groups", keep=True)
