"""A hidden Markov language model of whole texts, beside a smoothed unigram base.

Tokens are words (A-Z lower-cased, split at ASCII white space) and one end per text. Counts cover all training texts:

1. A pass over the texts numbers the words of each block of at most BLOCK_TOKENS tokens and counts them; texts are kept
   as compressed local numbers. Only (block, word, count) rows are shuffled by word, once, to sum the counts; a word has
   at most one row per block, and its rows stream by its sum. The sums go back to their blocks, where each text's base
   score is added up.
2. Words with at least one of ``frequent`` training tokens (so at most that many words, whatever the corpus; FREQUENT by
   default) are symbols of their own. All others share CLASSES symbols by a hash of their last ENDING characters; within
   a class a word has its smoothed unigram probability, with one share for all unseen words, so the score stays a
   probability. Held-out log10 per token at sf0.1 (base -4.255): -3.883 with 20,000 words and 64 classes of two
   characters, -3.865 with 64,000 words, -3.812 with 1,024 classes of three; -4.169 with all words as symbols, as the
   emissions of rare words are then learned by heart. So sharing costs nothing here; it is what makes rare words scorable.
3. Baum-Welch: every partition computes the expected counts of its whole training texts by scaled forward and backward
   recursions and emits one row per symbol; rows are summed across partitions by the symbol. The model, at most
   STATES * (frequent + CLASSES) numbers, is re-estimated on the driver.
4. The scaled forward recursion over each whole text gives its exact log-likelihood under the model.

To go over long texts in step with others, they are cut into stretches of STRETCH tokens that are all run at once from a
guessed state. Then each is run again from the state in which the one before really ended, until the recursion has
forgotten the difference (TOLERANCE), and so on until no stretch changes: what is counted is what one run over the whole
text counts, transitions across the cuts included. Memory is bounded: of a text of more than CHUNK stretches only the
states at every CHUNK-th cut are kept, and a part between two is computed again when the backward recursion gets there.

Edge cases. Null text counts as empty: its one token is the end. A null id is not held out. Repeated rows are texts of
their own. Without training texts only the smoothing is left. An empty table gives an empty result. Other columns are
never read.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PIECE_BYTES, Scratch, bounded, kept, pieces, shares, text_or_empty

BLOCK_TOKENS, FREQUENT, CLASSES, ENDING, STATES, ROUNDS = 4_000_000, 64_000, 1024, 3, 8, 5
STRETCH, CHUNK, TOLERANCE, EVERY = 1024, 256, 1e-10, 8
SMOOTH, PRIOR = 0.1, 20.0
WORDS_PER_TASK = 2_000_000
END = b""
_LOCAL = "block long, doc_id long, held_out boolean, ids binary, word string, local int, uses long"
_TEXTS = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, rare_score double, symbols binary"


def _numbered(block_tokens: int):
    """For mapInArrow: (doc_id, held_out, text) to a row per text and a row per word of each block."""

    def run(batches):
        from pyspark import TaskContext

        base, block, pack = TaskContext.get().partitionId() << 20, 0, zstandard.ZstdCompressor(level=1).compress
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.string(), pa.int32(), pa.int64()]
        names = [x.split()[0] for x in _LOCAL.split(", ")]

        def rows(columns):
            n = max(len(c) for c in columns if c is not None)
            return pa.RecordBatch.from_arrays([pa.array(c, k) if c is not None else pa.nulls(n, k) for c, k in zip(columns, kinds)], names)

        def fresh():
            numbers = defaultdict(count().__next__)
            numbers[END]
            return numbers, [], 0

        def flush():
            training = [ids for _, held, ids in texts if not held]
            uses = np.bincount(np.concatenate(training) if training else np.zeros(0, "u4"), minlength=len(numbers))
            for a in range(0, len(texts), 1000):
                part = texts[a : a + 1000]
                yield rows([[base + block] * len(part), [t[0] for t in part], [t[1] for t in part], [pack(t[2].tobytes()) for t in part], None, None, None])
            words = [w.decode("utf-8", "replace") for w in numbers]
            for a in range(0, len(words), 50_000):
                part = words[a : a + 50_000]
                yield rows([[base + block] * len(part), None, None, None, part, list(range(a, a + len(part))), uses[a : a + len(part)].tolist()])

        numbers, texts, held_tokens = fresh()
        for b in pieces(batches):
            for doc, held, text in zip(*(c.to_pylist() for c in b.columns)):
                words = text.encode().lower().split()
                ids = np.fromiter(map(numbers.__getitem__, words), dtype="<u4", count=len(words))
                texts.append((doc, held, np.append(ids, np.uint32(0)).astype("<u4")))
                held_tokens += len(ids) + 1
                if held_tokens >= block_tokens:
                    yield from flush()
                    block += 1
                    numbers, texts, held_tokens = fresh()
        if texts:
            yield from flush()

    return run


def _block_scored(total: int, distinct: int, frequent: int, class_uses: dict, class_words: dict):
    """For a cogroup of a block's texts and its words with their counts and symbols."""
    bottom = np.array([class_uses.get(i, 0) + SMOOTH * (class_words.get(i, 0) + 1) for i in range(CLASSES)])

    def run(texts: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        n = len(words)
        uses, symbol = np.zeros(n), np.zeros(n, dtype="i8")
        local = words["local"].to_numpy()
        uses[local], symbol[local] = words["c"].to_numpy(), words["symbol"].to_numpy()
        base = np.log10((uses + SMOOTH) / (total + SMOOTH * (distinct + 1)))
        rare = np.zeros(n)
        of = symbol >= frequent
        rare[of] = np.log10((uses[of] + SMOOTH) / bottom[symbol[of] - frequent])
        symbol = symbol.astype(_symbol_kind(frequent + CLASSES))
        out = []
        unpack, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress
        for doc, held, packed in zip(texts["doc_id"], texts["held_out"], texts["ids"]):
            ids = np.frombuffer(unpack(packed), "<u4")
            out.append((None if pd.isna(doc) else int(doc), bool(held), len(ids), int((uses[ids] > 0).sum()), float(base[ids].sum()), float(rare[ids].sum()), pack(symbol[ids].tobytes())))
        return pd.DataFrame(out, columns=[x.split()[0] for x in _TEXTS.split(", ")]).astype({"doc_id": "Int64"})

    return run


class Hmm:
    """Start, transition and emission probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit  # emit: symbol by state

    @classmethod
    def first(cls, unigram: np.ndarray, states: int, seed: int = 7) -> "Hmm":
        """Persistent states whose emissions are the unigram's, disturbed."""
        rng = np.random.default_rng(seed)
        emit = unigram[:, None] * np.exp(rng.normal(0, 1, (len(unigram), states)))
        move = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(axis=0))

    def rest(self) -> np.ndarray:
        """The stationary distribution: the first guess of where a stretch in the middle of a text begins."""
        p = self.start
        for _ in range(200):
            p = p @ self.move
        return p / p.sum()

    def expected(self, texts: list[np.ndarray]):
        """Baum-Welch counts of the texts: (starts, moves, emissions by symbol and state)."""
        k = len(self.start)
        total = np.zeros(k), np.zeros((k, k)), np.zeros_like(self.emit)
        group, held = [], 0
        for t in sorted((t for t in texts if len(t)), key=len):
            n = -(-len(t) // STRETCH)
            if n > CHUNK:
                self._long(t, total)
                continue
            if held + n > CHUNK:
                self._count(_Stretches(self, group), None, total)
                group, held = [], 0
            group.append(t)
            held += n
        if group:
            self._count(_Stretches(self, group), None, total)
        return total

    def _long(self, text: np.ndarray, total) -> None:
        """The counts of one text, part by part: forward for the states at the cuts, then backward from the last part."""
        parts = [text[a : a + STRETCH * CHUNK] for a in range(0, len(text), STRETCH * CHUNK)]
        entry = [None]
        for part in parts[:-1]:
            entry.append(_Stretches(self, [part], entry[-1]).end())
        after = None
        for part, before in zip(parts[::-1], entry[::-1]):
            after = self._count(_Stretches(self, [part], before), after, total)

    def _count(self, s: "_Stretches", after: np.ndarray | None, total) -> np.ndarray:
        """Adds the counts of stretches to total. after: the backward vector at the end of the last text, if it goes on.
        Returns what the backward vector before the first text follows from."""
        starts, moves, emits = total
        up, gamma = s.backward(after)
        first = s.before < 0
        if s.entry is None:
            starts += gamma[0][first].sum(axis=0)
        else:
            moves += self.move * np.outer(s.entry, up[0][first][0])
        k = len(self.start)
        moves += self.move * (s.a[:-1].reshape(-1, k).T @ up[1:].reshape(-1, k))
        moves += self.move * (s.ends()[s.before[~first]].T @ up[0][~first])
        flat = s.x.ravel()
        for i in range(k):  # gamma is 0 where there is no token
            emits[:, i] += np.bincount(flat, weights=gamma[..., i].ravel(), minlength=len(emits))
        return up[0][first][0] @ self.move.T

    def estimate(self, starts, moves, emits, unigram: np.ndarray) -> "Hmm":
        start, move = starts + SMOOTH, moves + SMOOTH
        emit = emits + PRIOR * unigram[:, None]
        return Hmm(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))

    def log10(self, texts: list[np.ndarray]) -> np.ndarray:
        """Exact log10 likelihoods by the scaled forward recursion, all texts in step."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        lengths = np.array([len(texts[i]) for i in order])
        flat = np.concatenate([texts[i] for i in order]) if texts else np.zeros(0, "i8")
        at = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        total = np.zeros(len(texts))
        active = len(texts) - np.searchsorted(lengths[::-1], np.arange(int(lengths[0]) if len(texts) else 0), "right")
        a = np.empty((0, 0))
        for t, n in enumerate(active.tolist()):
            a = (self.start if t == 0 else a[:n] @ self.move) * self.emit[flat[at[:n] + t]]
            s = a.sum(axis=1)
            total[:n] += np.log10(s)
            a /= s[:, None]
        out = np.zeros(len(texts))
        out[order] = total
        return out


class _Stretches:
    """Forward and backward vectors of texts, cut into stretches that stand side by side, the longest first: x, a and the
    scale by step and stretch. before and after: the stretch before and after each, -1 for none."""

    def __init__(self, model: Hmm, texts: list[np.ndarray], entry: np.ndarray | None = None):
        self.model, self.entry = model, entry
        cuts = [(i, a) for i, t in enumerate(texts) for a in range(0, len(t), STRETCH)]
        size = np.array([min(STRETCH, len(texts[i]) - a) for i, a in cuts])
        order = np.argsort(-size, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        inner = np.array([a > 0 for _, a in cuts])
        self.before = np.where(inner, place[np.maximum(np.arange(len(cuts)) - 1, 0)], -1)[order]
        self.after = np.full(len(cuts), -1)
        self.after[self.before[self.before >= 0]] = np.flatnonzero(self.before >= 0)
        self.last_text = int(place[-1])
        self.length = length = size[order]
        steps, count, k = int(length[0]), len(cuts), len(model.start)
        self.x = np.zeros((steps, count), dtype="i8")
        for p, i in enumerate(order.tolist()):
            t, a = cuts[i]
            self.x[: length[p], p] = texts[t][a : a + STRETCH]
        self.active = (count - np.searchsorted(length[::-1], np.arange(steps), "right")).tolist()
        self.e = model.emit[self.x]
        self.a, self.scale = np.zeros((steps, count, k)), np.ones((steps, count))
        vector = np.where((self.before < 0)[:, None], model.start if entry is None else entry @ model.move, model.rest())
        self._run(vector)
        self._settle(vector)

    def _run(self, vector: np.ndarray) -> None:
        ones, a = np.ones(len(self.model.start)), None
        for t, n in enumerate(self.active):
            a = (vector if t == 0 else a[:n] @ self.model.move) * self.e[t, :n]
            scale = a @ ones
            a /= scale[:, None]
            self.scale[t, :n], self.a[t, :n] = scale, a

    def _settle(self, used: np.ndarray) -> None:
        """used: the vector with which each stretch was begun. Whether a stretch is as it was before is looked at at every
        EVERY-th step."""
        used, inner, ones = used.copy(), np.flatnonzero(self.before >= 0), np.ones(len(self.model.start))
        while len(inner):
            now = self.ends()[self.before[inner]] @ self.model.move
            moved = np.abs(now - used[inner]).max(axis=1) > TOLERANCE
            at, now = inner[moved], now[moved]
            if not len(at):
                return
            used[at] = now
            for t in range(len(self.x)):
                a = now * self.e[t, at]
                scale = a @ ones
                a /= scale[:, None]
                go = self.length[at] > t + 1 if self.length[at[-1]] <= t + 1 else None  # the last is the shortest
                if t % EVERY == EVERY - 1:
                    far = np.abs(a - self.a[t, at]).max(axis=1) > TOLERANCE
                    go = far if go is None else go & far
                self.a[t, at], self.scale[t, at] = a, scale
                if go is not None:
                    at, a = at[go], a[go]
                    if not len(at):
                        break
                now = a @ self.model.move

    def ends(self) -> np.ndarray:
        """The forward vector at the end of each stretch."""
        return self.a[self.length - 1, np.arange(len(self.length))]

    def end(self) -> np.ndarray:
        """The forward vector at the end of the last text."""
        return self.ends()[self.last_text]

    def backward(self, after: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(up, gamma): up is emission times backward vector over scale, 0 where there is no token; gamma the posterior.
        after: the backward vector at the end of the last text, ones without it."""
        model, count = self.model, len(self.length)
        b, back = np.zeros_like(self.a), np.ascontiguousarray(model.move.T)
        used = np.ones((count, len(model.start)))
        if after is not None:
            used[self.last_text] = after
        b[self.length - 1, np.arange(count)] = used
        ratio = self.e
        ratio /= self.scale[..., None]
        for t in range(len(self.x) - 2, -1, -1):
            n = self.active[t + 1]
            b[t, :n] = (ratio[t + 1, :n] * b[t + 1, :n]) @ back
        inner = np.flatnonzero(self.after >= 0)
        while len(inner):
            follow = self.after[inner]
            now = (ratio[0, follow] * b[0, follow]) @ back
            moved = np.abs(now - used[inner]).max(axis=1) > TOLERANCE * np.abs(now).max(axis=1)
            at, now = inner[moved], now[moved]
            if not len(at):
                break
            used[at] = now
            t, step = self.length[at] - 1, 0
            while len(at):
                step += 1
                go = t > 0 if step % EVERY == 0 or t.min() == 0 else None
                if step % EVERY == 0:
                    go &= np.abs(now - b[t, at]).max(axis=1) > TOLERANCE * np.abs(now).max(axis=1)
                b[t, at] = now
                if go is not None:
                    at, t, now = at[go], t[go], now[go]
                now = (ratio[t, at] * now) @ back
                t = t - 1
        gamma = self.a * b
        b *= ratio
        return b, gamma


def _symbols(column, kind: str) -> list[np.ndarray]:
    unpack = zstandard.ZstdDecompressor().decompress
    return [np.frombuffer(unpack(x), kind).astype("i8") for x in column.to_pylist()]


def _symbol_kind(symbols: int) -> str:
    return "<u2" if symbols <= 1 << 16 else "<u4"


def _counted(shared):
    """For mapInArrow: expected counts of a partition. Rows below 0 are moves (-2 - state) and starts (-1)."""

    def run(batches):
        model: Hmm = shared.value
        kept("hmm")
        kind = _symbol_kind(len(model.emit))
        starts, moves, emits = 0.0, 0.0, 0.0
        seen = False
        for b in pieces(batches, 4000):
            s, m, e = model.expected(_symbols(b.column(0), kind))
            starts, moves, emits, seen = starts + s, moves + m, emits + e, True
        if seen:
            used = np.flatnonzero(emits.any(axis=1))
            table = np.concatenate([starts[None], moves, emits[used]])
            keys = np.concatenate([[-1], -2 - np.arange(len(moves)), used])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), *[pa.array(table[:, i]) for i in range(table.shape[1])]], ["symbol", *[f"s{i}" for i in range(table.shape[1])]])

    return run


def _scored(shared, at_once: int = 6000):
    def run(batches):
        model: Hmm = shared.value
        kept("hmm")
        kind = _symbol_kind(len(model.emit))
        held: list = []

        def flush():
            table = pa.Table.from_batches(held).combine_chunks().to_batches()
            for b in table:
                own = model.log10(_symbols(b.column(6), kind)) + b.column(5).to_numpy()
                yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(own, pa.float64())], [*b.schema.names[:5], "score"])

        for b in pieces(batches):
            held.append(b)
            if sum(x.num_rows for x in held) >= at_once or sum(x.nbytes for x in held) >= PIECE_BYTES * 4:
                yield from flush()
                held.clear()
        if held:
            yield from flush()

    return run


def train(symbols: DataFrame, unigram: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> Hmm:
    """symbols: one binary column of training texts."""
    spark, model = symbols.sparkSession, Hmm.first(unigram, states)
    names = [f"s{i}" for i in range(states)]
    schema = "symbol int, " + ", ".join(f"{n} double" for n in names)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)
        sums = symbols.mapInArrow(_counted(shared), schema).groupBy("symbol").agg(*[F.sum(n).alias(n) for n in names]).toPandas()
        starts, moves, emits = np.zeros(states), np.zeros((states, states)), np.zeros((len(unigram), states))
        values, keys = sums[names].to_numpy(), sums["symbol"].to_numpy()
        emits[keys[keys >= 0]] = values[keys >= 0]
        for key, row in zip(keys[keys < 0], values[keys < 0]):
            if key == -1:
                starts = row
            else:
                moves[-2 - key] = row
        model = model.estimate(starts, moves, emits, unigram)
        shared.unpersist()
    return model


def score(docs: DataFrame, modulus: int = 10, held_out: int = 0, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, rounds: int = ROUNDS, block_tokens: int = BLOCK_TOKENS, frequent: int = FREQUENT) -> DataFrame:
    """Learns from the rows that are not held out (crc32 of the id as text, modulo ``modulus``, is not ``held_out``) and
    scores every row: doc_id, held_out, n_tokens, n_known, base_score, score, train_tokens."""
    out = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == held_out, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), out.alias("held_out"), text_or_empty(text_col).alias("text"))
    with Scratch(bounded(docs.sparkSession)) as table:
        scored, unigram, total = _base(rows, block_tokens, frequent, table)
    model = train(scored.filter("not held_out").select("symbols"), unigram / unigram.sum(), states, rounds)
    done = scored.mapInArrow(_scored(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return done.withColumn("train_tokens", F.lit(total).cast("long"))


def _base(rows: DataFrame, block_tokens: int, frequent: int, table: Scratch) -> tuple[DataFrame, np.ndarray, int]:
    """(texts as symbols with their base scores, training tokens by symbol, all training tokens)."""
    spark = rows.sparkSession
    local = table(rows.mapInArrow(_numbered(block_tokens), _LOCAL), "local")
    words = local.filter(F.col("word").isNotNull()).select("block", "local", "word", "uses")
    n, total = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("uses"), F.lit(0))).first()
    # One exchange: the sums and the rows that they go back to are dealt alike, and Spark uses it twice.
    dealt = words.repartition(max(shares(rows), n // WORDS_PER_TASK), "word")
    sums = dealt.groupBy("word").agg(F.sum("uses").alias("c"), F.min("block").alias("least"))
    known = dealt.select("block", "local", "word").join(sums.hint("shuffle_merge"), "word")
    is_symbol = (F.col("c") * frequent >= total) & (F.col("c") > 0) | (F.col("word") == "")
    known = known.select("block", "local", "c", (F.col("least") == F.col("block")).alias("first"), F.pmod(F.xxhash64(F.right("word", F.lit(ENDING))), F.lit(CLASSES)).cast("int").alias("class"), F.when(is_symbol, F.col("word")).alias("symbol_word"))
    known = table(known, "known")
    one = known.filter("first")
    top = sorted(((r["symbol_word"], r["c"]) for r in one.filter("symbol_word is not null").select("symbol_word", "c").collect()), key=lambda x: (-x[1], x[0]))
    number = {w: i for i, (w, _) in enumerate(top)}
    classes = one.filter("symbol_word is null").groupBy("class").agg(F.sum("c").alias("c"), F.sum((F.col("c") > 0).cast("long")).alias("n")).collect()
    class_uses, class_words = {r["class"]: r["c"] for r in classes}, {r["class"]: r["n"] for r in classes}
    distinct = sum(c > 0 for _, c in top) + sum(class_words.values())
    unigram = np.array([c for _, c in top] + [class_uses.get(i, 0) for i in range(CLASSES)], dtype="f8") + SMOOTH
    numbers = F.broadcast(spark.createDataFrame(list(number.items()), "symbol_word string, number int"))
    symbols = known.join(numbers, "symbol_word", "left").select("block", "local", "c", F.coalesce("number", F.col("class") + len(top)).alias("symbol"))
    texts = local.filter("word is null").select("block", "doc_id", "held_out", "ids")
    scored = texts.groupBy("block").cogroup(symbols.groupBy("block")).applyInPandas(_block_scored(total, distinct, len(top), class_uses, class_words), _TEXTS)
    return table(scored, "texts", keep=True), unigram, total
