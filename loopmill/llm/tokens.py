"""Encode whole texts with a public tokenizer that never joins text across white space.

Each distinct white-space word is encoded once per worker and then reused, which gives the same ids as
encoding the text (``tests/llm`` hold that) at a fraction of the cost.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np

from loopmill.llm.wordscan import Words, scan

#: Words remembered by one worker (about 30 bytes each); beyond it the memory starts anew.
REMEMBERED = 2_000_000
#: Marks that this tokenizer takes as a token of their own after a letter at a word's end.
END_MARKS = b".,"
ENCODED_AT_ONCE = 2_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """ids of words, remembered by their hash. The hash folds ASCII case, as the tokenizer does."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, dtype=np.uint64)  # sorted hashes
        self.entry = np.zeros(0, dtype=np.int64)  # of each of them, its place in start and length
        self.start, self.length = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=self.dtype)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all words, and how many each has; the words stand in one text, told apart by offsets."""
        ids, owner = [], []
        for at in range(0, len(words), ENCODED_AT_ONCE):
            part = words[at : at + ENCODED_AT_ONCE]
            starts = np.zeros(len(part), dtype=np.int64)
            np.cumsum([len(w) + 1 for w in part[:-1]], out=starts[1:])
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            where = np.fromiter((a for a, _ in found.offsets), dtype=np.int64, count=len(found.ids))
            ids.append(np.array(found.ids, dtype=self.dtype))
            owner.append(np.searchsorted(starts, where, "right") - 1 + at)
        counts = np.bincount(np.concatenate(owner), minlength=len(words)) if owner else np.zeros(0, dtype=np.int64)
        return np.concatenate([np.zeros(0, dtype=self.dtype), *ids]), counts

    def entries(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """For each word of ``w`` its entry, and for each entry its number of ids."""
        if len(self.known) > REMEMBERED:
            self.clear()
        unique, first, back = np.unique(w.hash, return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, unique)
        seen = np.zeros(len(unique), dtype=bool)
        if len(self.known):
            seen = self.known[np.minimum(place, len(self.known) - 1)] == unique
        at = np.empty(len(unique), dtype=np.int64)
        at[seen] = self.entry[place[seen]]
        new = np.flatnonzero(~seen)
        if len(new):
            ids, counts = self._encode([w.word(i).decode() for i in first[new].tolist()])
            at[new] = len(self.start) + np.arange(len(new))
            self.known = np.insert(self.known, place[new], unique[new])
            self.entry = np.insert(self.entry, place[new], at[new])
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(counts) - counts])
            self.length = np.concatenate([self.length, counts])
            self.ids = np.concatenate([self.ids, ids])
        return at[back], self.length

    def counts(self, texts: list[bytes]) -> np.ndarray:
        """Number of ids of each text."""
        w = scan(texts, marks=END_MARKS)
        entry, length = self.entries(w)
        total = np.zeros(len(entry) + 1, dtype=np.int64)
        np.cumsum(length[entry], out=total[1:])
        return np.diff(total[w.first])

    def encode(self, texts: list[bytes], closing: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, ``closing`` after each text; and the place of each text's first id, and the end."""
        w = scan(texts, marks=END_MARKS)
        entry, length = self.entries(w)
        n = length[entry]
        total = np.zeros(len(entry) + 1, dtype=np.int64)
        np.cumsum(n, out=total[1:])
        bounds = total[w.first] + np.arange(len(texts) + 1)
        word_at = np.arange(total[-1], dtype=np.int64) + np.repeat(self.start[entry] - total[:-1], n)
        out = np.full(bounds[-1], closing, dtype=self.dtype)
        inside = np.ones(len(out), dtype=bool)
        inside[bounds[1:] - 1] = False
        out[inside] = self.ids[word_at]
        return out, bounds


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One for each worker process."""
    return WordEncoder(path)
