"""Word shingles of whole texts as 64-bit numbers."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from . import words

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits over all bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_hashes(found: words.Words) -> np.ndarray:
    """A 64-bit number for each word of the texts."""
    if not len(found.vocab):
        return np.zeros(0, np.uint64)
    listed = pc.binary_join(pa.ListArray.from_arrays([0, len(found.vocab)], found.vocab), " ")[0].as_py().split(" ")
    return np.fromiter(map(xxhash.xxh3_64_intdigest, listed), np.uint64, len(listed))[found.codes]


class Shingled:
    """Shingles of `size` words of a slice of texts. `of(i)` has the distinct shingles of text i, sorted; fewer words are one shingle."""

    def __init__(self, texts: pa.Array, size: int):
        self.size = size
        found = words.split(texts, words.LOWER)
        self.offsets = found.offsets
        self.word = word_hashes(found)
        n = max(0, len(self.word) - size + 1)
        total = np.zeros(n, np.uint64)
        for k in range(size):
            total += self.word[k : k + n] * _ODD[k % len(_ODD)] + np.uint64(k)
        self.all = mix(total)

    def span(self, i: int) -> slice:
        """Where the shingles of text i lie in `all`."""
        a, b = int(self.offsets[i]), int(self.offsets[i + 1])
        return slice(a, max(a, b - self.size + 1))

    def short(self, i: int) -> np.ndarray:
        """The one shingle of a text with fewer words than a shingle; none for a text without words."""
        own = self.word[self.offsets[i] : self.offsets[i + 1]]
        total = np.zeros(1, np.uint64)
        for k in range(len(own)):
            total += own[k : k + 1] * _ODD[k % len(_ODD)] + np.uint64(k)
        return mix(total + np.uint64(1 + len(own))) if len(own) else np.zeros(0, np.uint64)

    def of(self, i: int) -> np.ndarray:
        if self.offsets[i + 1] - self.offsets[i] < self.size:
            return self.short(i)
        own = np.sort(self.all[self.span(i)])
        return own[np.concatenate([[True], own[1:] != own[:-1]])]


def set_key(sorted_shingles: np.ndarray) -> int:
    """A number for the whole set; equal sets have equal keys."""
    return int.from_bytes(hashlib.blake2b(sorted_shingles.tobytes(), digest_size=8).digest(), "little", signed=True)
