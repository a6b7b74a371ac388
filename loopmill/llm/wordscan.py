"""Vectorised word scanning: texts of a batch become arrays of 64-bit word hashes and byte positions.

A word hash is a polynomial over per-byte random values, taken from one prefix sum (all arithmetic is
modulo 2**64), so no Python object is made for a word. ASCII capitals count as small letters.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BLOCK = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 5  # odd, and 5 modulo 8: of full order


def _lower() -> np.ndarray:
    to = np.arange(256, dtype=np.uint8)
    to[ord("A") : ord("Z") + 1] += 32
    return to


LOWER = _lower()
_VALUE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64)[LOWER] | np.uint64(1)

#: Word bytes: all but ASCII white space, or small ASCII letters, digits and everything beyond ASCII.
SPACED = np.ones(256, dtype=bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POW = _powers(BLOCK + 1, _BASE)
_INV = _powers(BLOCK + 1, pow(_BASE, -1, 2**64))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values; a bijection."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


@dataclass
class Words:
    buffer: bytes  #: the texts, a line feed after each
    start: np.ndarray  #: first byte of each word
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  #: of each text, the number of words before it; one more entry at the end

    def word(self, i: int) -> bytes:
        return self.buffer[self.start[i] : self.end[i]]


_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True


def scan(texts: list[bytes], word: np.ndarray = SPACED, marks: bytes = b"") -> Words:
    """All words of all texts, in order. A last byte in ``marks`` after an ASCII letter is a word of its own."""
    mark = np.isin(np.arange(256), np.frombuffer(marks, dtype=np.uint8))
    buffer = b"\n".join([*texts, b""])
    raw = np.frombuffer(buffer, dtype=np.uint8)
    starts, ends, hashes = [], [], []
    at = 0
    while at < len(raw):
        stop = min(at + BLOCK, len(raw))
        inside = word[raw[at:stop]]
        gap = np.flatnonzero(~inside[::-1][:4096])
        if not len(gap):
            gap = np.flatnonzero(~inside[::-1])
        if len(gap):
            stop -= int(gap[0])
        else:  # a word longer than a block
            while stop < len(raw) and word[raw[stop]]:
                stop += 1
        s, e, h = _block(raw[at:stop], word, mark)
        starts.append(s + at)
        ends.append(e + at)
        hashes.append(h)
        at = stop
    joined = [np.concatenate(x) if x else np.zeros(0, dtype=t) for x, t in ((starts, np.int64), (ends, np.int64), (hashes, np.uint64))]
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
    return Words(buffer, *joined, np.searchsorted(joined[0], offsets))


def _block(raw: np.ndarray, word: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(raw)
    inside = np.zeros(n + 2, dtype=np.int8)
    inside[1:-1] = word[raw]
    step = np.diff(inside)
    s, e = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if mark.any():
        cut = e[mark[raw[e - 1]] & (e - s > 1) & _LETTER[raw[np.maximum(e - 2, 0)]]] - 1
        s, e = np.sort(np.concatenate([s, cut])), np.sort(np.concatenate([e, cut]))
    power, inverse = (_POW, _INV) if n <= BLOCK else (_powers(n, _BASE), _powers(n, pow(_BASE, -1, 2**64)))
    value = _VALUE[raw]
    value *= power[:n]
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(value, out=total[1:])
    return s, e, mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64))
