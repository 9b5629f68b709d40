"""Hierarchical packing of token sequences into windows of several sizes.

Route: a document longer than the largest window is cut into full windows first; what remains of it (or the whole of a
shorter document) goes to the smallest tier that holds it. Pack: the tiers are filled from the longest down; each window
is opened by the longest remainder of its tier. Fill: its gap takes whole remainders of shorter tiers, the best fit
first, and where none fits the gap is closed by cutting the remainder that is nearest in size. So every window is full
and is a power of two long: no padding. What is left at the end of a partition becomes windows of the powers of two that
make up its length, at most one of each. Balance: the windows of a block are dealt in serpentine order of their cost
(the sum of squared piece lengths, as attention costs) to step groups of about ``step_tokens`` tokens.

A partition is packed in blocks of ``block_tokens`` ids, so a worker's memory is bounded; nothing is shuffled, and a task
that is run again makes the same pieces. Sequence ids hold the partition's number in their upper bits.

Edge cases. Null text counts as empty: its document is the end id alone. Null or repeated ids are kept as they are; each
row is a document of its own. An empty table gives an empty result. Other columns are never read.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, pieces, release, text_or_empty
from .tokens import MEMO_WORDS, encoder

TIERS = (512, 1024, 2048, 4096)
BLOCK_TOKENS, STEP_TOKENS = 1 << 19, 1 << 16
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class Pool:
    """Remainders that wait for a window, by length."""

    def __init__(self):
        self.lengths: list[int] = []
        self.by: dict[int, list] = {}
        self.total = 0

    def add(self, piece: tuple) -> None:
        n = piece[3] - piece[2]
        if n not in self.by:
            bisect.insort(self.lengths, n)
            self.by[n] = []
        self.by[n].append(piece)
        self.total += n

    def take(self, at_most: int) -> tuple | None:
        """The longest piece of at most that length."""
        i = bisect.bisect_right(self.lengths, at_most)
        return self._pop(self.lengths[i - 1]) if i else None

    def nearest(self, above: int) -> tuple | None:
        """The shortest piece that is longer."""
        i = bisect.bisect_right(self.lengths, above)
        return self._pop(self.lengths[i]) if i < len(self.lengths) else None

    def _pop(self, n: int) -> tuple:
        piece = self.by[n].pop()
        self.total -= n
        if not self.by[n]:
            del self.by[n]
            self.lengths.pop(bisect.bisect_left(self.lengths, n))
        return piece


class Packer:
    """Takes documents, gives windows: lists of pieces (doc, ids, from, to). ``doc`` is opaque."""

    def __init__(self, tiers=TIERS, block_tokens: int = BLOCK_TOKENS):
        self.tiers, self.block_tokens, self.pool = sorted(tiers), block_tokens, Pool()

    def add(self, doc, ids: np.ndarray):
        at, top = 0, self.tiers[-1]
        while len(ids) - at >= top:
            yield [(doc, ids, at, at + top)]
            at += top
        if at < len(ids):
            self.pool.add((doc, ids, at, len(ids)))

    def full(self) -> bool:
        return self.pool.total >= self.block_tokens

    def windows(self, last: bool):
        """Packs the waiting remainders tier by tier. Those of the shortest tier that are left wait for the next block."""
        for k in range(len(self.tiers) - 1, -1, -1):
            size, below = self.tiers[k], self.tiers[k - 1] if k else 0
            while self.pool.lengths and self.pool.lengths[-1] > below and self.pool.total >= size:
                yield self._fill(size)
        if last:
            left = self.pool.total
            for bit in range(left.bit_length() - 1, -1, -1):
                if left >> bit & 1:
                    yield self._fill(1 << bit)

    def _fill(self, size: int) -> list:
        """One window of that size; the pool holds at least as much."""
        window, gap = [], size
        while gap:
            piece = self.pool.take(gap)
            if piece is None:
                doc, ids, a, b = self.pool.nearest(gap)
                piece = (doc, ids, a, a + gap)
                self.pool.add((doc, ids, a + gap, b))
            window.append(piece)
            gap -= piece[3] - piece[2]
        return window


def step_groups(windows: list[list], step_tokens: int) -> list[int]:
    """A group for each window: serpentine dealing by falling cost evens out both the cost and the number of windows."""
    groups = max(1, round(sum(p[3] - p[2] for w in windows for p in w) / step_tokens))
    order = sorted(range(len(windows)), key=lambda i: (-sum((p[3] - p[2]) ** 2 for p in windows[i]), i))
    out = [0] * len(windows)
    for rank, i in enumerate(order):
        turn, k = divmod(rank, groups)
        out[i] = k if turn % 2 == 0 else groups - 1 - k
    return out


def _packed(tokenizer: str, end_id: int, tiers: tuple, block_tokens: int, step_tokens: int, memo_words: int, give_back: bool = False):
    def run(batches):
        from pyspark import TaskContext

        enc, packer = encoder(tokenizer, memo_words), Packer(tiers, block_tokens)
        base = TaskContext.get().partitionId() << 40
        number, group, waiting, held = 0, 0, [], 0

        def batch():
            nonlocal number, group, waiting, held
            rows = []
            for window, g in zip(waiting, step_groups(waiting, step_tokens), strict=True):
                offset, size = 0, sum(p[3] - p[2] for p in window)
                for doc, ids, a, b in window:
                    rows.append((doc, a, b - a, zlib.crc32(ids[a:b]), len(ids), base + number, offset, size, base + group + g))
                    offset += b - a
                number += 1
            group += max((r[8] - base - group + 1 for r in rows), default=0)
            waiting, held = [], 0
            kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in SCHEMA.split(", ")])

        def keep(windows):
            nonlocal held
            for w in windows:
                waiting.append(w)
                held += sum(p[3] - p[2] for p in w)

        for b in pieces(batches):
            for doc, data in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist()), strict=True):
                keep(packer.add(doc, np.append(np.frombuffer(data, "<u4"), np.array([end_id], "<u4"))))
                if packer.full():
                    keep(packer.windows(last=False))
                if held >= block_tokens:
                    yield batch()
            if give_back:
                release()
        keep(packer.windows(last=True))
        if waiting:
            yield batch()

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, tiers: tuple = TIERS, block_tokens: int = BLOCK_TOKENS, step_tokens: int = STEP_TOKENS, id_col: str = "doc_id", text_col: str = "text", memo_words: int = MEMO_WORDS, give_back: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier (the sequence's
    length, a power of two), step_group. memo_words bounds the tokenizer's memo, some 400 bytes each, and with it the time.
    give_back: workers return freed memory to the system after each piece of their rows, not only when they begin."""
    if any(t & (t - 1) for t in tiers):
        raise ValueError("tiers are powers of two")
    bounded(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(_packed(tokenizer, end_id, tuple(tiers), block_tokens, step_tokens, memo_words, give_back), SCHEMA)
