"""Token ids of whole texts with a public tokenizer file.

The word tokenizer drops white space and never joins pieces across it, so the ids of a text are the ids of its words in order.
A task gives each distinct word to the tokenizers library once and keeps the answer in a bounded cache.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import words

#: The tokenizer of the registered queries; paths are a parameter everywhere.
WORD_TOKENIZER = "word_bpe_49k.json"
CACHED_WORDS = 250_000
_JOINED = 400
_PLAIN_WORD = "^[a-zß-öø-ÿ]+$"
_LETTER = np.zeros(256, bool)
_LETTER[0x61:0x7B] = True
_MARK = np.zeros(256, bool)
_MARK[np.frombuffer(b".,!?;:#$%&*|", np.uint8)] = True


def tokenizer_path(name: str = WORD_TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _listed(vocab: pa.Array) -> list[str]:
    """The words as Python strings; none holds white space, so one joined string splits into them."""
    return pc.binary_join(pa.ListArray.from_arrays([0, len(vocab)], vocab), " ")[0].as_py().split(" ")


class WordEncoder:
    """Encodes Arrow text columns. The file must hold a BPE with word ends whose pre-tokenizer removes white space."""

    _open: dict[str, "WordEncoder"] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        # A word of lower-case letters is one piece that normalising leaves alone: the model alone gives its ids.
        self.plain = Tokenizer(self.full.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.full.get_vocab()
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self._clear()

    @classmethod
    def open(cls, path: str) -> "WordEncoder":
        """One encoder per worker process and path."""
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def _clear(self) -> None:
        self.slots: dict[str, int] = {}
        self.length = np.zeros(1 << 12, np.int64)
        self.start = np.zeros(1 << 12, np.int64)
        self.ids = np.zeros(1 << 16, np.uint16 if len(self.ends_word) <= 1 << 16 else np.uint32)
        self.used = 0

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids: text i has ids[offsets[i]:offsets[i + 1]], as encode(text, add_special_tokens=False) gives them."""
        if len(texts) and pc.any(pc.match_substring(pc.fill_null(texts, ""), "<|")).as_py():  # may hold a special token, which has marks inside
            found = [e.ids for e in self.full.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int64)
            return offsets, np.array([i for f in found for i in f], self.ids.dtype)
        offsets, data = words.raw(texts)
        data = words.LOWER[data]
        # A space between a letter and a mark changes no id and leaves fewer distinct words.
        gap = np.flatnonzero(_LETTER[data[:-1]] & _MARK[data[1:]]) + 1
        split = words.split_raw(offsets + np.searchsorted(gap, offsets), np.insert(data, gap, 0x20))
        slots = self._slots(split.vocab)[split.codes]
        lengths = self.length[slots]
        ends = np.zeros(len(lengths) + 1, np.int64)
        np.cumsum(lengths, out=ends[1:])
        return ends[split.offsets], self.ids[words.ragged(self.start[slots], lengths)]

    def _slots(self, vocab: pa.Array) -> np.ndarray:
        if len(self.slots) > CACHED_WORDS:
            self._clear()
        if not len(vocab):
            return np.zeros(0, np.int64)
        out = np.fromiter(map(self.slots.get, _listed(vocab), repeat(-1)), np.int64, len(vocab))
        new = np.flatnonzero(out < 0)
        plain = pc.match_substring_regex(vocab.take(pa.array(new)), _PLAIN_WORD).to_numpy(zero_copy_only=False).astype(bool)
        for places, encode in ((new[plain], self._encode_plain), (new[~plain], self._encode_full)):
            if len(places):
                wanted = _listed(vocab.take(pa.array(places)))
                out[places] = self._add(wanted, *encode(wanted))
        return out

    def _encode_plain(self, wanted: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = [" ".join(wanted[i : i + _JOINED]) for i in range(0, len(wanted), _JOINED)]
        ids = np.concatenate([np.asarray(e.ids, self.ids.dtype) for e in self.plain.encode_batch_fast(joined, add_special_tokens=False)])
        last = np.flatnonzero(self.ends_word[ids])
        return np.diff(np.concatenate([[-1], last])), ids

    def _encode_full(self, wanted: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.full.encode_batch_fast(wanted, add_special_tokens=False)]
        return np.array([len(f) for f in found], np.int64), np.array([i for f in found for i in f], self.ids.dtype)

    def _add(self, wanted: list[str], lengths: np.ndarray, ids: np.ndarray) -> np.ndarray:
        first, count = len(self.slots), len(wanted)
        while len(self.ids) < self.used + len(ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.length) < first + count:
            self.length, self.start = (np.concatenate([x, np.zeros_like(x)]) for x in (self.length, self.start))
        self.ids[self.used : self.used + len(ids)] = ids
        self.length[first : first + count] = lengths
        self.start[first : first + count] = self.used + np.cumsum(lengths) - lengths
        self.used += len(ids)
        self.slots.update(zip(wanted, range(first, first + count), strict=True))
        return np.arange(first, first + count)
