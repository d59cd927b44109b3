"""Token ids of whole Arrow text columns with a public word-level BPE file.

The tokenizer drops white space and never merges across it, so a text's ids are those of its words
in order. Words are found and compared as hashes in numpy; the tokenizer itself only sees words
that its worker has not met before.
"""

from __future__ import annotations

from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

from .text import Words, words

#: Words and parts of words that a worker remembers; idle workers keep them.
WORD_CACHE = 600_000
PART_CACHE = 250_000

# Fixed value: the file's own split pattern.
_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
# Plain Latin words are split here; all others go through the whole tokenizer.
_PLAIN = regex.compile(r"[\x21-\x7e\xa1-\xac\xae-ɏ]+")


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class CachedIds:
    """Ids of whole columns from the ids of their distinct words, with a bounded memory of words met so far."""

    def __init__(self):
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)

    def cut(self, column: pa.Array) -> Words:
        return words(column)

    def compute(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each word, and all their ids one after the other."""
        raise NotImplementedError

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after the other, and where each row's begin (one more at the end)."""
        w = self.cut(column)
        key, one, back = np.unique(w.hash, return_index=True, return_inverse=True)
        slot = np.searchsorted(self.keys, key)
        known = np.zeros(len(key), bool)
        inside = slot < len(self.keys)
        known[inside] = self.keys[slot[inside]] == key[inside]
        if not known.all():
            if len(self.keys) + len(key) > WORD_CACHE:
                self._forget()
                known[:] = False
            new = np.flatnonzero(~known)
            data = w.data.tobytes()
            size, flat = self.compute(
                [data[a:b] for a, b in zip(w.start[one[new]].tolist(), w.end[one[new]].tolist(), strict=True)]
            )
            at = len(self.pool) + np.cumsum(size) - size
            self.pool = np.concatenate([self.pool, flat])
            keys = np.concatenate([self.keys, key[new]])
            order = np.argsort(keys, kind="stable")
            self.keys = keys[order]
            self.at = np.concatenate([self.at, at])[order]
            self.size = np.concatenate([self.size, size])[order]
            slot = np.searchsorted(self.keys, key)
        size, at = self.size[slot][back], self.at[slot][back]
        total = np.concatenate([[0], np.cumsum(size)])
        return self.pool[np.repeat(at - total[:-1], size) + np.arange(total[-1])], total[w.first]


class WordTokenizer(CachedIds):
    """Ids by white-space words of a byte-level BPE file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = _byte_letters()
        # ids as 32-bit numbers, far smaller than lists
        self.parts: dict[str, bytes] = {}

    def word_ids(self, word: str) -> bytes:
        if not _PLAIN.fullmatch(word) or ("<|" in word and any(s in word for s in self.special)):
            return array("i", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        out = b""
        for part in _PARTS.findall(word.lower()):
            ids = self.parts.get(part)
            if ids is None:
                if len(self.parts) >= PART_CACHE:
                    self.parts.clear()
                shown = part if part.isascii() else "".join(self.letters[b] for b in part.encode())
                ids = self.parts[part] = array("i", [t.id for t in self.model.tokenize(shown)]).tobytes()
            out += ids
        return out

    def compute(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = [self.word_ids(w.decode("utf-8", "replace")) for w in new]
        return np.fromiter(map(len, ids), np.int64, len(ids)) // 4, np.frombuffer(b"".join(ids), np.int32)


@lru_cache(maxsize=1)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)
