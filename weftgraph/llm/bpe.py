"""Byte-level BPE by a lazily determinised transducer, and streaming decoding.

Merging by rank has two properties that make it a finite-state matter: a prefix of a text's tokens is the encoding of the
text they cover, and a sequence of tokens is an encoding exactly if each adjacent pair is the encoding of its own bytes.
So every prefix of the input has one last token, found from the tokens that end there and the last tokens where they
begin. A position can still matter only if the bytes from it on begin some token of the vocabulary; a state of the
transducer is the last token before the pending bytes (where it still matters), those bytes, and such positions in them
with the tokens that lead there. As soon as the tokens to all of them begin alike, these are emitted: the lookahead is
bounded by the longest token. States and transitions are made when they are first needed and kept in tables of bounded
size that start anew when they are full.

Decoding takes ids in any portions: the bytes of a character may be spread over tokens, so a state machine holds back the
bytes of an unfinished character until the rest arrives.

Edge cases. Null text counts as empty: no ids, and the hashes of the empty string. Bytes that are not UTF-8 decode to
U+FFFD as usual. Null or repeated ids are kept as they are. An empty table gives an empty result. Other columns are
never read.
"""

from __future__ import annotations

import base64
import hashlib
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, kept, pieces, text_or_empty

#: Bounds of the tables, which start anew when full; longer words and pieces are not remembered.
MAX_TRANSITIONS, MEMO_WORDS, MEMO_CHARS = 700_000, 800_000, 32
HEAD, NO_RANK, PORTION = 6, 1 << 60, 4096
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Transducer:
    """A state is (last token before the pending bytes, or OPEN where it no longer matters; the pending bytes; the live
    positions). A live position is a place in the pending bytes from which they begin some token, with the tokens that
    lead there. Live positions only ever die or are added at the end, so a transition looks at the two or three there are."""

    OPEN, START = -2, -1

    def __init__(self, ranks: dict[bytes, int], max_transitions: int = MAX_TRANSITIONS):
        self.ranks, self.max_transitions = ranks, max_transitions
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.prefixes = {b[:n] for b in ranks for n in range(1, len(b))}
        self.single = [bytes([b]) for b in range(256)]
        self._pairs: dict[tuple[int, int], bool] = {}
        self._courses: dict[int, list[tuple[int, bytes, bytes]] | None] = {}
        self._reset()

    def _reset(self) -> None:
        start = (self.START, b"", ((0, ()),))
        self.ids = {start: 0}
        self.states = [start]
        self.next: dict[int, tuple[int, tuple[int, ...]]] = {}  # state and byte -> state * 256, tokens emitted
        self.heads: dict[bytes, tuple[int, tuple[int, ...]]] = {}  # the same for the first HEAD bytes of a piece at once

    def _merged(self, data: bytes, course: list | None = None) -> list[bytes]:
        """Merges the pair of lowest rank, the first of equals, until none is left. For short strings. The course takes the
        rank of each merge with the parts that are then first and last."""
        get, none = self.ranks.get, NO_RANK
        parts = [self.single[b] for b in data]
        pairs = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs and (rank := min(pairs)) != none:
            i = pairs.index(rank)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], none)
            if course is not None:
                course.append((rank, parts[0], parts[-1]))
        return parts

    def merge(self, data: bytes) -> list[int]:
        """The encoding by its definition."""
        return [self.ranks[p] for p in self._merged(data)]

    def _course(self, token: int) -> list[tuple[int, bytes, bytes]] | None:
        """How merging comes to the token, from its single bytes on (rank, first part, last part); None if it can't."""
        if token in self._courses:
            return self._courses[token]
        data = self.bytes_of[token]
        course = [(-1, data[:1], data[-1:])]
        made = self._merged(data, course)
        course.append((NO_RANK, data, data))
        self._courses[token] = course if len(made) == 1 else None
        return self._courses[token]

    def _apart(self, a: int, b: int) -> bool:
        """Whether merging the bytes of both gives the two: their own merges take place in the order of their ranks, those of
        a first among equals, and the pair across the border must never be the lowest."""
        left, right = self._course(a), self._course(b)
        if left is None or right is None:
            return False
        get, i, j = self.ranks.get, 0, 0
        while True:
            across = get(left[i][2] + right[j][1], NO_RANK)
            next_left, next_right = left[i + 1][0], right[j + 1][0]
            if across < next_left and across <= next_right:
                return False
            if next_left <= next_right:
                if next_left == NO_RANK:
                    return True
                i += 1
            else:
                j += 1

    def _follows(self, a: int, b: int) -> bool:
        if a < 0:
            return self._course(b) is not None
        if (known := self._pairs.get((a, b))) is None:
            if len(self._pairs) > self.max_transitions:
                self._pairs.clear()
            known = self._pairs[a, b] = self._apart(a, b)
        return known

    def _step(self, key: int) -> tuple[int, tuple[int, ...]]:
        """Makes the transition of key: state * 256 + byte."""
        before, pending, lives = self.states[key >> 8]
        data, rank, prefixes = pending + self.single[key & 255], self.ranks.get, self.prefixes
        whole, kept = None, []
        for live in lives:
            at, tokens = live
            rest = data[at:] if at else data
            if whole is None and (token := rank(rest)) is not None and self._follows(tokens[-1] if tokens else before, token):
                whole = (*tokens, token)
            if rest in prefixes:
                kept.append(live)
        if not kept:  # all chains have met at the end
            state, out = (whole[-1], b"", ((0, ()),)), whole
        else:
            cut, first = kept[0]
            kept.append((len(data), whole))
            shared = 0
            while shared < len(first) and all([len(tokens) > shared and tokens[shared] == first[shared] for _, tokens in kept]):
                shared += 1
            out = first[:shared]
            if out:
                before = out[-1]
            if shared < len(first):
                before = self.OPEN
            if cut or shared:
                kept = [(at - cut, tokens[shared:]) for at, tokens in kept]
            state = (before, data[cut:], tuple(kept))
        to = self.ids.get(state)
        if to is None:
            to = self.ids[state] = len(self.states)
            self.states.append(state)
        made = self.next[key] = (to << 8, out)
        return made

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one piece, as byte-pair merging gives them; a piece that is a token is that token."""
        if (token := self.ranks.get(piece)) is not None:
            return [token]
        if len(self.next) > self.max_transitions or len(self.heads) > self.max_transitions:
            self._reset()
        state, get, step = 0, self.next.get, self._step
        if (head := self.heads.get(piece[:HEAD])) is not None:
            state, out = head[0], [*head[1]]
        else:
            out = []
            for b in piece[:HEAD]:
                state, some = get(state | b) or step(state | b)
                out += some
            self.heads[piece[:HEAD]] = state, tuple(out)
        for b in piece[HEAD:]:
            state, some = get(state | b) or step(state | b)
            if some:
                out += some
        return [*out, *self.states[state >> 8][2][-1][1]]  # the tokens still owed lead to the end, the last live position


class Memo(dict):
    """What ``make`` gives for a key, remembered; starts anew when it is full. Long keys are not remembered."""

    def __init__(self, make, limit: int):
        self.make, self.limit = make, limit

    def __missing__(self, key: str) -> bytes:
        made = self.make(key)
        if len(key) <= MEMO_CHARS:
            if len(self) >= self.limit:
                self.clear()
            self[key] = made
        return made


class TextEncoder:
    """Whole texts to ids as little-endian 32-bit integers: splits by the pattern and remembers recent words and pieces. A
    text is first cut before each single space between other characters, and around single line ends; the pattern always
    cuts there too."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo_words: int = MEMO_WORDS):
        self.fst, self.split = Transducer(ranks), regex.compile(pattern).findall
        self.words = Memo(self._word, memo_words)  # keys: what follows a space
        self.bare = Memo(self._piece, max(1, memo_words // 4))  # keys: pieces without a leading space

    def _piece(self, piece: str) -> bytes:
        ids = self.fst.encode(piece.encode())
        return pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():  # one piece
            return self._piece(" " + word)
        if word[:1] == "\n":
            return self._pieces(word)
        pieces = self.split(" " + word)
        if len(pieces) == 1:
            return self._piece(pieces[0])
        return self._known(pieces)

    def _known(self, pieces: list[str]) -> bytes:
        return b"".join([self.words[p[1:]] if p[0] == " " and not p[1:2].isspace() and len(p) > 1 else self.bare[p] for p in pieces])

    def _pieces(self, text: str) -> bytes:
        return self._known(self.split(text))

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        words = None
        if not (text[0].isspace() or text[-1].isspace() or "  " in text or " \n" in text or "\n " in text or "\n\n" in text):
            words = text.replace("\n", " \n").split(" ")
            if len(words) != len(text.split()):
                words = None
        if words is None:
            return self._pieces(text)
        return self._pieces(words[0]) + b"".join(map(self.words.__getitem__, words[1:]))


class Decimals:
    """Ids in decimal, joined by a space."""

    def __init__(self, ranks: dict[bytes, int]):
        width = len(str(top := max(ranks.values()))) + 1
        self.digits = np.frombuffer(b"".join([(b" %d" % i).ljust(width, b"\0") for i in range(top + 1)]), np.uint8).reshape(-1, width)

    def write(self, ids: np.ndarray) -> bytes:
        digits = self.digits[ids].ravel()
        return digits[digits != 0][1:].tobytes()


class Utf8Machine:
    """Incremental UTF-8: gives the finished characters, holds back the bytes of an unfinished one."""

    def __init__(self):
        self.held = b""

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut, state = len(data), 0
        for i in range(max(0, len(data) - 3), len(data)):  # the state: how many bytes the character at cut still needs
            b = data[i]
            if state and b >> 6 == 0b10:
                state -= 1
            else:
                cut, state = i, 1 if b >> 5 == 0b110 else 2 if b >> 4 == 0b1110 else 3 if b >> 3 == 0b11110 else 0
        self.held, done = (data[cut:], data[:cut]) if state else (b"", data)
        return done.decode("utf-8", "replace")

    def end(self) -> str:
        out, self.held = self.held.decode("utf-8", "replace"), b""
        return out


def decode(bytes_of: dict[int, bytes], ids: np.ndarray, portion: int = PORTION):
    """The text of ids, in portions."""
    machine, get = Utf8Machine(), bytes_of.__getitem__
    for a in range(0, len(ids), portion):
        yield machine.feed(b"".join(map(get, ids[a : a + portion].tolist())))
    yield machine.end()


def _encoder(path: str, pattern: str) -> tuple[TextEncoder, Decimals]:
    """One for all tasks of a worker: a task has its own copy of what its function names, but for functions of a module."""

    def make():
        ranks = load_ranks(path)
        return TextEncoder(ranks, pattern), Decimals(ranks)

    return kept("bpe", (path, pattern), make)


def _encoded(path: str, pattern: str):
    def run(batches):
        enc, decimals = _encoder(path, pattern)
        for batch in pieces(batches):
            counts, hashes, decoded = [], [], []
            for text in batch.column(1).to_pylist():
                ids = np.frombuffer(enc.encode(text), "<u4")
                counts.append(len(ids))
                given, back = hashlib.sha256(), hashlib.sha256()
                for a in range(0, len(ids), PORTION):
                    given.update((b" " if a else b"") + decimals.write(ids[a : a + PORTION]))
                for part in decode(enc.fst.bytes_of, ids):
                    back.update(part.encode())
                hashes.append(given.hexdigest())
                decoded.append(back.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())], [x.split()[0] for x in SCHEMA.split(", ")])

    return run


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row's ids and of the text decoded from them."""
    bounded(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(_encoded(ranks_path, pattern), SCHEMA)
