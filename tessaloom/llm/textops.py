"""Vectorised words, shingles and their 64-bit hashes, shared by the operators.

A word is a maximal run of letters and digits, lower-cased one code point at a time.
A shingle is five consecutive words; a text of one to four words has one shingle, all its
words; a text without words has none. Null counts as the empty text.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

SHINGLE_WORDS = 5
STRETCH = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_STEP = np.array([pow(0xD6E8FEB86659FD93, i + 1, 1 << 64) for i in range(SHINGLE_WORDS)], np.uint64)


@lru_cache(1)
def fold_table() -> np.ndarray:
    """0 for code points outside words, else the lower-case code point."""
    out = np.zeros(0x110000, np.uint32)
    for code in range(0x110000):
        char = chr(code)
        if char.isalnum():
            out[code] = ord(char.lower()[0])
    return out


_powers: dict[str, np.ndarray] = {}


def forget() -> None:
    """Drops the powers that are kept from text to text."""
    _powers.clear()


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if size <= 1 << 21:
            _powers[name] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


class Words:
    """The words of a list of texts: ``hashes``, character ``starts`` and ``ends`` within
    the own text, and ``offsets`` (words of text i: offsets[i] to offsets[i + 1]). ``prefixes``
    has, for each of ``sizes``, a hash of each word's first so many characters, 0 for words that
    aren't longer.

    Texts are gone through by stretches of about STRETCH characters, cut outside words, so that
    beyond a stretch some 4 bytes a character and 24 a word are held."""

    def __init__(self, texts: list[str | None], sizes: tuple[int, ...] = ()):
        texts = [t or "" for t in texts]
        codes = np.frombuffer("\n".join(texts).encode("utf-32-le"), np.uint32)
        table, parts, lo = fold_table(), [], 0
        while lo < len(codes) or not parts:
            hi = min(len(codes), lo + STRETCH)
            while hi < len(codes):
                outside = np.flatnonzero(table[codes[hi : hi + 4096]] == 0)
                if len(outside):
                    hi += int(outside[0])
                    break
                hi = min(len(codes), hi + 4096)
            parts.append(self._stretch(table[codes[lo:hi]], lo, sizes))
            lo = hi
        self.hashes, starts, ends, *self.prefixes = (np.concatenate(x) for x in zip(*parts))
        begin = np.zeros(len(texts), np.int64)
        np.cumsum([len(t) + 1 for t in texts[:-1]], out=begin[1:]) if len(texts) > 1 else None
        self.offsets = np.append(np.searchsorted(starts, begin), len(starts)).astype(np.int64)
        shift = np.repeat(begin, np.diff(self.offsets))
        self.starts, self.ends = starts - shift, ends - shift

    @staticmethod
    def _stretch(folded: np.ndarray, lo: int, sizes: tuple[int, ...]) -> list[np.ndarray]:
        inside = np.zeros(len(folded) + 2, np.int8)
        inside[1:-1] = folded != 0
        edges = np.diff(inside)
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        sums = np.zeros(len(folded) + 1, np.uint64)
        np.cumsum(folded.astype(np.uint64) * _power("up", _BASE, len(folded) + 1)[: len(folded)], out=sums[1:])
        down = _power("down", pow(_BASE, -1, 1 << 64), len(folded) + 1)
        out = [mix((sums[ends] - sums[starts]) * down[starts]), starts + lo, ends + lo]
        for size in sizes:
            longer = ends - starts > size
            part = np.zeros(len(starts), np.uint64)
            part[longer] = mix((sums[starts[longer] + size] - sums[starts[longer]]) * down[starts[longer]] + np.uint64(size))
            out.append(part)
        return out

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.offsets[i] : self.offsets[i + 1]]


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive words."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for i in range(n):
        out = (out + hashes[i : i + count]) * _STEP[0]
    return mix(out)


def shingles(hashes: np.ndarray) -> np.ndarray:
    """Hashes of the shingles of one text, in order, repeats included."""
    if len(hashes) >= SHINGLE_WORDS:
        return runs(hashes, SHINGLE_WORDS)
    return runs(hashes, len(hashes)) ^ np.uint64(len(hashes)) if len(hashes) else np.zeros(0, np.uint64)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = Words(texts)
    return [np.unique(shingles(words.of(i))) for i in range(len(words))]
