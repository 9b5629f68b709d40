"""Token ids of whole texts by the tokenizers library, with a memo of words.

The library is asked once per distinct word (a bounded memo, kept by the Python worker between tasks); a text's ids are
the words' ids joined. That is exact only where the tokenizer's own splitting always cuts between words, so the memo is
used for two kinds of tokenizer files whose pre-tokenizers guarantee it, and a text that has any other white space than
single spaces and line ends between words (``byte`` kind), or any other kind of tokenizer, is encoded as a whole.
"""

from __future__ import annotations

import json
import os

import numpy as np

from .common import kept

#: Words in the memo's newer half. When it is full it becomes the older half, which gives back the words that are asked
#: for again; the others go. A word takes about 200 bytes.
MEMO_WORDS = 1_500_000
_JOIN = 512


def encoder(path: str, memo_words: int = MEMO_WORDS) -> "WordEncoder":
    """This process's encoder for a tokenizer file."""
    return kept("tokens", (path, memo_words), lambda: WordEncoder(path, memo_words))


class WordEncoder:
    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.memo_words, self.memo, self.older = memo_words, {}, {}
        part = lambda x: None if x is None else json.loads(x.__getstate__())  # noqa: E731  the whole file is large
        self.kind = self._kind({"pre_tokenizer": part(self.library.pre_tokenizer), "normalizer": part(self.library.normalizer)})
        self.width = 2 if self.library.get_vocab_size() <= 65536 else 4
        if self.kind == "byte":
            self.mark = self._one("\n")
        elif self.kind == "word":
            self.mark = self._one("~")
        if self.kind != "whole" and self.mark is None:
            self.kind = "whole"

    @staticmethod
    def _kind(spec: dict) -> str:
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
            return "byte"
        parts = pre.get("pretokenizers") or [{}]
        if parts[0].get("type") == "Split" and parts[0].get("behavior") == "Removed" and parts[0].get("invert") and r"[^\s\p{L}\p{N}]+" in str(parts[0]["pattern"].get("Regex")):
            return "word"
        return "whole"

    def _one(self, text: str) -> int | None:
        ids = self._whole(text)
        return int(ids[0]) if len(ids) == 1 else None

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _words(self, text: str) -> list[str] | None:
        """Keys whose ids, joined, are those of the text; None where the text has to be encoded as a whole."""
        if self.kind == "word":
            return text.replace("\n", " ").split(" ")
        if self.kind == "whole" or not text or text[0].isspace() or text[-1].isspace() or "  " in text or " \n" in text or "\n " in text or "\n\n" in text:
            return None
        words = ("\n" + text).replace("\n", " \n").split(" ")[1:]
        return words if len(words) == len(text.split()) else None

    def _learn(self, words: set[str]) -> None:
        """Adds the ids of words that the memo lacks. Many are encoded at once, with a mark between them."""
        odd, groups = [], {"": [], " ": []}
        for w in words:
            if self.kind == "byte":
                groups["" if w[0] == "\n" else " "].append(w)
            elif "~" in w:
                odd.append(w)
            elif w:
                groups[""].append(w)
            else:
                self.memo[w] = b""
        for lead, group in groups.items():
            parts = [group[i : i + _JOIN] for i in range(0, len(group), _JOIN)]
            glue = "~" if self.kind == "word" else "" if lead == "" else "\n"
            joined = [(f" {glue} " if self.kind == "word" else glue).join(lead + w for w in p) for p in parts]
            for p, e in zip(parts, self.library.encode_batch_fast(joined, add_special_tokens=False), strict=True):
                ids = np.array(e.ids, dtype="<u4")
                cut = np.flatnonzero(ids == self.mark)
                newline = self.kind == "byte" and lead == ""
                if len(cut) != len(p) - (not newline):
                    odd += p
                    continue
                data = ids.tobytes()
                if newline:  # each word brings its own line end
                    starts, ends = cut, np.append(cut[1:], len(ids))
                else:
                    starts, ends = np.append([0], cut + 1), np.append(cut, len(ids))
                self.memo.update(zip(p, [data[a:b] for a, b in zip((starts * 4).tolist(), (ends * 4).tolist())]))
        for w in odd:
            self.memo[w] = self._whole(w if self.kind == "word" or w[0] == "\n" else " " + w).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        if len(self.memo) > self.memo_words:
            self.older, self.memo = self.memo, {}
        get, split, holes, missing = self.memo.get, [], [], set()
        for t in texts:
            words = self._words(t)
            ids = None if words is None else list(map(get, words))
            hole = [i for i, x in enumerate(ids) if x is None] if ids is not None and None in ids else []
            if hole:
                hole = [(i, words[i]) for i in hole]
                missing.update([w for _, w in hole])
            split.append(ids)
            holes.append(hole)
        for w in missing & self.older.keys():
            self.memo[w] = self.older[w]
        self._learn(missing - self.older.keys())
        out, known = [], self.memo
        for t, ids, hole in zip(texts, split, holes, strict=True):
            if ids is None:
                out.append(self._whole(t).tobytes() if t else b"")
                continue
            for i, w in hole:
                ids[i] = known[w]
            ids = b"".join(ids)
            out.append(ids[4:] if self.kind == "byte" else ids)
        return out
