"""Language identification by cross-parsing.

Per language, a suffix automaton is built of a sample of labelled texts. A text is then cut greedily into the longest
phrases that occur in the sample; with c phrases over m characters, c log2(n) / m bits per character is the
cross-parsing estimate of its entropy given a sample of n characters. The language with the fewest bits (the fewest
phrases, normalised) wins. Ties go to the label that sorts first.

Texts are lower-cased; letters count, and any run of other characters is one space. Each text is parsed as a whole, from
its start to its end. To parse a long text in step with others it is cut into blocks that are parsed at the same time, as
if each began a phrase; then each block is parsed again from the state in which the one before really ended, up to where
a phrase begins in both parses, as from there on they are the same (``_settle``). Memory is bounded by segments: the
state goes from one segment of SEGMENT characters to the next.

Learning reads a bounded sample of labelled rows: ``rows_per_lang`` different texts per label (ROWS_PER_LANG), chosen by
length (those up to SHORT characters first, then the shortest) and a hash of doc_id among the rows that may be learned
from. Every label and every letter of these texts is learned, and each chosen text is read whole. An automaton has a
dense row per state for the DENSE most frequent letters of its own language and a sorted list of transitions by all
other letters, so large alphabets cost no more than the text. The model grows with the number of labels only.
Prediction reads every whole text.

Edge cases. Null text or a text without letters: ``und`` with score 0. Rows with null lang or null id are not learned
from; a null id is not held out. Without anything to learn from, all is ``und``. Repeated rows are each predicted. An
empty table gives an empty result. Other columns are never read.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import bounded, kept, pieces

#: The one bound of the sample, in rows; SHORT only says which rows come first.
ROWS_PER_LANG, SHORT = 32, 3000
BLOCK, SEGMENT, DENSE = 1024, 1 << 20, 31
UNDETERMINED = "und"
PREDICTED = {"lang_pred": StringType(), "score": DoubleType(), "bits_per_char": DoubleType()}


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo: decides what is held out. Null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


class Alphabet:
    """Code points to codes: 0 for what is no letter, then the letters given, last all other letters."""

    def __init__(self, letters: str):
        self.size = len(letters) + 2
        self.table = np.zeros(0x110000, dtype="i4")
        code = {c: i + 1 for i, c in enumerate(letters)}
        other = len(letters) + 1
        self.table[[i for i in range(0x110000) if chr(i).isalpha()]] = other
        for i in range(0x3000):  # cased letters lie below, or have a lower case that is no learned letter
            if self.table[i] and (k := code.get(chr(i).lower()[:1])):
                self.table[i] = k
        for c, k in code.items():
            self.table[ord(c)] = k

    def codes(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        codes = self.table[points]
        keep = codes != 0
        keep[1:] |= codes[:-1] != 0
        return codes[keep]


def automaton(codes: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the suffix automaton by state and code; state 0 stands for none, state 1 is the start."""
    rows: list[dict[int, int]] = [{}, {}]
    link, length = [0, 0], [0, 0]
    last = 1
    for c in codes.tolist():
        new = len(rows)
        rows.append({})
        link.append(1)
        length.append(length[last] + 1)
        p = last
        while p and c not in rows[p]:
            rows[p][c] = new
            p = link[p]
        if p:
            q = rows[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(rows)
                rows.append(dict(rows[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p and rows[p].get(c) == q:
                    rows[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return rows


class Model:
    """samples: label to texts. A state is a number over all languages; 0 is none, from which no transition leads on, so any
    character starts a phrase there. columns: for each language and code its column in the dense table, WIDE - 1 (a
    column without transitions) for other letters."""

    def __init__(self, samples: dict[str, list[str]]):
        self.langs = sorted(samples)
        letters = sorted({c for texts in samples.values() for c in "".join(texts).lower() if c.isalpha()})
        self.alphabet, self.wide = Alphabet("".join(letters)), DENSE + 2
        count, wide = len(self.langs), self.wide
        self.columns = np.full((count, self.alphabet.size), wide - 1, dtype="i4")
        self.starts, self.bits = np.zeros(count, dtype="i8"), np.zeros(count)
        dense, at, rare = [np.zeros((1, wide), dtype="i4")], 1, []
        self.odd = np.zeros(self.alphabet.size, dtype=bool)  # codes that are learned, but not dense, in some language
        for k, lang in enumerate(self.langs):
            codes = np.concatenate([self.alphabet.codes(t + " ") for t in samples[lang]])
            often = np.bincount(codes, minlength=self.alphabet.size)
            often[0] = often.max() + 1  # the space is always dense
            top = [c for c in np.argsort(-often, kind="stable")[: DENSE + 1].tolist() if often[c]]
            self.columns[k, top] = np.arange(len(top))
            self.odd |= (often > 0) & (self.columns[k] == wide - 1)
            rows = automaton(codes)[1:]  # without the one for none
            self.starts[k], self.bits[k] = at, np.log2(max(2, len(codes)))
            state = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
            by = np.fromiter((c for r in rows for c in r), dtype="i8", count=len(state))
            to = np.fromiter((t for r in rows for t in r.values()), dtype="i8", count=len(state)) + (at - 1)
            column = self.columns[k, by]
            table, plain = np.zeros((len(rows), wide), dtype="i4"), column < wide - 1
            table[state[plain], column[plain]] = to[plain]
            dense.append(table)
            rare.append(np.stack([(state[~plain] + at) * self.alphabet.size + by[~plain], to[~plain]]))
            at += len(rows)
        self.table = np.concatenate(dense).ravel()
        self.kind = "i4" if len(self.table) < 1 << 31 else "i8"
        self.table = self.table.astype(self.kind, copy=False)
        keys = np.concatenate(rare, axis=1) if rare else np.zeros((2, 0), dtype="i8")
        order = np.argsort(keys[0])
        self.keys, self.to = keys[0][order], keys[1][order].astype(self.kind)
        self.first = np.stack([self._next(np.full(self.alphabet.size, s), np.arange(self.alphabet.size), np.full(self.alphabet.size, k)) for k, s in enumerate(self.starts)]) if count else np.zeros((0, self.alphabet.size), self.kind)

    def _next(self, state: np.ndarray, code: np.ndarray, lang) -> np.ndarray:
        """The state after a code, 0 where no transition leads on. lang: each state's language."""
        to = self.table[state * self.wide + self.columns[lang, code]]
        if len(self.keys) and (odd := self.odd[code]).any():
            at = np.nonzero(np.broadcast_to(odd, to.shape))
            key = state[at].astype("i8") * self.alphabet.size + np.broadcast_to(code, to.shape)[at]
            i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            to[at] = np.where(self.keys[i] == key, self.to[i], to[at])
        return to

    def _blocks(self, codes: np.ndarray, first: np.ndarray, length: np.ndarray, record: bool):
        """Parses blocks (first, length; longest first) as if each began a phrase. (phrases, end states) by language and
        block, and where phrases begin, by step, if they are recorded."""
        langs = len(self.langs)
        every = np.arange(langs)[:, None]
        state = np.zeros((langs, len(first)), dtype=self.kind)
        count = np.zeros((langs, len(first)), dtype="i4")
        begins = []
        active = len(first) - np.searchsorted(length[::-1], np.arange(int(length[0]) if len(length) else 0), "right")
        for t, n in enumerate(active.tolist()):
            c = codes[first[:n] + t]
            to = self._next(state[:, :n], c, every)
            new = to == 0
            count[:, :n] += new
            state[:, :n] = np.where(new, self.first[:, c], to)
            if record:
                begins.append(new)
        return count, state, begins

    def _settle(self, codes, first, length, before, count, state, begins, incoming):
        """Corrects counts and end states of blocks for the states in which the blocks before them really end. before: the
        number of the block before each, -1 for none; incoming: the state in which a block without one begins, by
        language and block."""
        langs = len(self.langs)
        used = np.zeros((langs, len(first)), dtype=self.kind)  # the incoming state that a block's figures hold for
        guess, ends = count.copy(), state.copy()
        while True:
            entry = np.where(before >= 0, state[:, np.maximum(before, 0)], incoming)
            lang, block = np.nonzero(entry != used)
            if not len(lang):
                return count, state
            used[lang, block] = now = entry[lang, block]
            count[lang, block], state[lang, block] = guess[lang, block], ends[lang, block]
            for t in range(int(length.max()) + 1):
                over = length[block] <= t  # the whole block is parsed otherwise
                state[lang[over], block[over]] = now[over]
                lang, block, now = lang[~over], block[~over], now[~over]
                if not len(lang):
                    break
                c = codes[first[block] + t]
                to = self._next(now, c, lang)
                new, was = to == 0, begins[t][lang, block]
                count[lang, block] += new.astype("i4") - was
                on = ~(new & was)  # where both begin a phrase, all that follows is the same
                now = np.where(new, self.first[lang, c], to)[on]
                lang, block = lang[on], block[on]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrases by text and language, characters by text, whether a text has letters)."""
        total = np.zeros((len(texts), len(self.langs)), dtype="i8")
        sizes, letters = np.zeros(len(texts), dtype="i8"), np.zeros(len(texts), dtype=bool)
        group, held = [], 0
        for i, text in enumerate(texts):
            codes = self.alphabet.codes(text)
            sizes[i], letters[i] = len(codes), bool((codes != 0).any())
            if len(codes) > SEGMENT:
                state = np.zeros(len(self.langs), dtype=self.kind)
                for a in range(0, len(codes), SEGMENT):
                    counts, ends = self._parse([codes[a : a + SEGMENT]], state[:, None])
                    total[i] += counts[:, 0]
                    state = ends[:, 0]
                continue
            if held + len(codes) > SEGMENT:
                self._add(total, group)
                group, held = [], 0
            group.append((i, codes))
            held += len(codes)
        self._add(total, group)
        return total, sizes, letters

    def _add(self, total: np.ndarray, group: list) -> None:
        if group:
            total[[i for i, _ in group]] = self._parse([c for _, c in group], np.zeros((len(self.langs), len(group)), self.kind))[0].T

    def _parse(self, parts: list[np.ndarray], states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrases that begin in each part, state at its end), by language and part, from the given states on."""
        sizes = np.array([len(p) for p in parts])
        starts = np.concatenate([[0], np.cumsum(sizes)])
        of = np.repeat(np.arange(len(parts)), -(-sizes // BLOCK))
        rank = np.concatenate([np.arange(-(-n // BLOCK)) for n in sizes]) if len(sizes) else np.zeros(0, "i8")
        first = starts[:-1][of] + rank * BLOCK
        length = np.minimum(first + BLOCK, starts[1:][of]) - first
        order = np.argsort(-length, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        before = np.where(rank > 0, place[np.maximum(np.arange(len(of)) - 1, 0)], -1)[order]
        of, rank, first, length, codes = of[order], rank[order], first[order], length[order], np.concatenate(parts)
        several = bool((rank > 0).any() or states.any())
        count, state, begins = self._blocks(codes, first, length, several)
        if several:
            count, state = self._settle(codes, first, length, before, count, state, begins, np.where(rank == 0, states[:, of], 0))
        total, ends = np.zeros((len(self.langs), len(parts)), dtype="i8"), states.copy()
        np.add.at(total.T, of, count.T)
        last = rank == (-(-sizes // BLOCK) - 1)[of]
        ends[:, of[last]] = state[:, last]
        return total, ends

    def predict(self, texts: list[str]) -> list[tuple[str, float, float | None]]:
        """(label, score, bits per character) of each text. The score is the label's share when a language weighs 2 to
        the power of minus its phrases."""
        if not self.langs or not texts:
            return [(UNDETERMINED, 0.0, None)] * len(texts)
        total, sizes, letters = self.phrases(texts)
        bits = total * self.bits
        best = bits.argmin(axis=1)
        least = bits[np.arange(len(texts)), best]
        share = 1 / np.exp2(-np.minimum((bits - least[:, None]) / self.bits, 1000)).sum(axis=1)
        return [(self.langs[b], float(s), float(x / n)) if ok else (UNDETERMINED, 0.0, None) for b, s, x, n, ok in zip(best, share, least, sizes, letters)]


def learn(docs: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_lang: int = ROWS_PER_LANG) -> dict[str, list[str]]:
    """The samples: whole texts of at most rows_per_lang rows per label. Rows are first thinned by a hash to about four
    times as many, so no label's rows meet in one task."""
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), may_learn.alias("may"))
    rows = rows.filter(F.col("may") & F.col("lang").isNotNull() & F.col("id").isNotNull() & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    rows = rows.withColumn("rank", (F.xxhash64("id") / F.lit(2.0**64) + 0.5).cast("double")).withColumn("over", F.greatest(F.lit(0), F.length("text") - SHORT))
    counts = {r["lang"]: (r["n"], r["short"]) for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("over") == 0).alias("short")).collect()}
    # Of a label with enough short texts only these are thinned and looked at; else all of its texts.
    enough = {k: s >= 8 * rows_per_lang for k, (_, s) in counts.items()}
    share = {k: min(1.0, 4.0 * rows_per_lang / (s if enough[k] else n)) for k, (n, s) in counts.items()}
    at_most = {k: 0 if enough[k] else 1 << 30 for k in counts}
    table = lambda values, kind: F.from_json(F.lit(json.dumps(values)), f"map<string,{kind}>")[F.col("lang")]
    some = rows.filter((F.col("rank") < table(share, "double")) & (F.col("over") <= table(at_most, "int")))
    some = some.groupBy("lang", "text").agg(F.min("rank").alias("rank"), F.min("over").alias("over"))
    best = some.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("over", "rank", "text"))).filter(F.col("n") <= rows_per_lang)
    samples: dict[str, list[str]] = {}
    for r in best.orderBy("lang", "n").collect():
        samples.setdefault(r["lang"], []).append(r["text"])
    return samples


def _predicted(samples: dict[str, list[str]], text_at: int):
    """For mapInArrow: adds the prediction from the column ``text_at`` to each row."""
    key = hashlib.sha256(repr(sorted(samples.items())).encode()).hexdigest()

    def run(batches):
        m = kept("langid", key, lambda: Model(samples))
        for b in pieces(batches):
            got = m.predict([t or "" for t in b.column(text_at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.float64())], [*b.schema.names, *PREDICTED])

    return run


def tagged(docs: DataFrame, modulus: int = 4, held_out: int = 2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_lang: int = ROWS_PER_LANG) -> DataFrame:
    """docs with lang_pred, score and bits_per_char of each row; docs has no columns of these names. Learns from the
    labelled rows that are not held out (crc32 of the id as text, modulo ``modulus``, is not ``held_out``). Nothing but the
    sample is shuffled."""
    bounded(docs.sparkSession)
    samples = learn(docs, ~F.coalesce(remainder(id_col, modulus) == held_out, F.lit(False)), id_col, text_col, lang_col, rows_per_lang)
    schema = StructType([*docs.schema.fields, *[StructField(n, t) for n, t in PREDICTED.items()]])
    return docs.mapInArrow(_predicted(samples, docs.columns.index(text_col)), schema)


def identify(docs: DataFrame, modulus: int = 4, held_out: int = 2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_lang: int = ROWS_PER_LANG) -> DataFrame:
    """A prediction of every row, as by tagged(): doc_id, held_out, lang_pred, score, bits_per_char."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    out = F.coalesce(remainder("doc_id", modulus) == held_out, F.lit(False))
    return tagged(rows, modulus, held_out, rows_per_lang=rows_per_lang).select("doc_id", out.alias("held_out"), *PREDICTED)
