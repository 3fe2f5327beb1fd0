"""SentencePiece ids of whole texts, and texts of ids, for merge-type (BPE) model files.

For every prefix of a text, the ids of the prefix end in one token only, and a sequence of tokens is the one that merging gives exactly if each
pair of neighbours is what merging gives for their joined characters. So a table of each prefix's last token is filled from left to right:
an automaton lists the vocabulary tokens that end at a place, and the one that is compatible with the last token before it is the
entry. Walking the table backwards from the end gives the ids. No merge is ever carried out on a text.

Places that no token of the vocabulary spans cut a text into parts that are encoded each by itself; a task encodes each distinct part once.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words

PIECE_TOKENIZER = "piece_bpe_32k.model"
#: What a worker process remembers: parts of texts, their ids, and pairs of tokens with their verdict. Full tables start anew.
CACHED_PARTS = 250_000
CACHED_IDS = 1 << 21
CACHED_PAIRS = 1 << 18
#: Ids that one task turns into text at once; a longer single row is a slice of its own.
SLICE_IDS = 1 << 19
SPACE = "▁"

_NEVER = float("inf")  # rank of a merge that does not come

# The library gives one replacement character for each byte that is not part of a character.
codecs.register_error("each-byte", lambda e: ("\ufffd", e.start + 1))


class MergeModel:
    """Pieces of a model file, their ranks, and how merging builds each of them."""

    _open: dict[str, "MergeModel"] = {}

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        p = self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = p.vocab_size()
        if p.normalize(" A  ﬁé\t ") != f"{SPACE}{SPACE}A{SPACE}{SPACE}ﬁé\t{SPACE}":
            raise ValueError("only models that keep characters as they are, with a space before the text, are read")
        plain = [i for i in range(size) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]
        self.ids = {p.id_to_piece(i): i for i in plain}
        # The higher the score, the sooner a pair is merged; equal scores merge from left to right.
        by_score = {s: r for r, s in enumerate(sorted({p.get_score(i) for i in plain}, reverse=True))}
        self.rank = {i: by_score[p.get_score(i)] for i in plain}
        self.bytes = np.full(256, -1, np.int64)
        for i in range(size):
            if p.is_byte(i):
                self.bytes[int(p.id_to_piece(i)[3:5], 16)] = i
        self.unknown = p.unk_id()

        self.text = {i: t for t, i in self.ids.items()}
        letters = {c for t in self.ids for c in t}
        if not letters <= set(self.ids):
            raise ValueError("only models with a piece for each of their characters are read")
        self.known = np.zeros(0x110000, bool)
        self.known[[ord(c) for c in letters]] = True
        self.spines: dict[int, tuple[list[int], list[int]]] = {}
        self.odd: set[int] = set()
        self._build_spines()
        self.automaton = ahocorasick.Automaton()
        for i in self.spines:
            self.automaton.add_word(self.text[i], (i, len(self.text[i])))
        self.automaton.make_automaton()
        self._build_joins()
        self.verdicts: dict[int, bool] = {}
        self.size = size
        self._clear()
        probes = [*[self.text[i] for i in plain[:: max(1, len(plain) // 500)]], "Merge types, e.g. this one?  12 \n\u0000"]
        offsets, ids = self.encode(pa.array(probes))
        if [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] != p.encode(probes):
            raise ValueError("only merge-type models are read")

    @classmethod
    def open(cls, path: str) -> "MergeModel":
        """One model per worker process and path."""
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def merge(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """What merging gives for a short string, and the two sides of the last merge."""
        parts, last = list(text), None
        while len(parts) > 1:
            best = min(((self.rank[self.ids[m]], k) for k in range(len(parts) - 1) if (m := parts[k] + parts[k + 1]) in self.ids), default=None)
            if best is None:
                break
            k = best[1]
            last = (parts[k], parts[k + 1])
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts, last

    def _build_spines(self) -> None:
        """For each piece that merging its own characters gives: what stands at its left and right edge in turn, from one character up to itself.

        Where each piece has a later rank than the two it is made of, merges of one piece happen in the order of their ranks. Pieces for
        which that does not hold (equal scores) are odd.
        """
        for text, i in sorted(self.ids.items(), key=lambda x: len(x[0])):
            if len(text) == 1:
                self.spines[i] = ([i], [i])
                continue
            parts, last = self.merge(text)
            if len(parts) > 1:
                continue
            left, right = (self.ids[t] for t in last)
            self.spines[i] = ([*self.spines[left][0], i], [*self.spines[right][1], i])
            sides = [s for s in (left, right) if len(self.text[s]) > 1]
            if any(s in self.odd or self.rank[s] >= self.rank[i] for s in sides):
                self.odd.add(i)

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the characters of pieces a and b together gives a and b again."""
        key = a * self.size + b
        found = self.verdicts.get(key)
        if found is None:
            if len(self.verdicts) >= CACHED_PAIRS:
                self.verdicts.clear()
            found = self.verdicts[key] = self._compatible(a, b)
        return found

    def _compatible(self, a: int, b: int) -> bool:
        if a in self.odd or b in self.odd:
            return self.merge(self.text[a] + self.text[b])[0] == [self.text[a], self.text[b]]
        # Replay what stands on either side of the border: the side whose next merge is sooner goes on, unless a merge over the
        # border comes before both. Of equal ranks the one further left is sooner.
        left, right = self.spines[a][1], self.spines[b][0]
        i = j = 0
        while True:
            next_left = self.rank[left[i + 1]] if i + 1 < len(left) else _NEVER
            next_right = self.rank[right[j + 1]] if j + 1 < len(right) else _NEVER
            over = self.ids.get(self.text[left[i]] + self.text[right[j]])
            if over is not None and self.rank[over] < next_left and self.rank[over] <= next_right:
                return False
            if next_left == next_right == _NEVER:
                return True
            if next_left <= next_right:
                i += 1
            else:
                j += 1

    def last_tokens(self, part: str) -> list[tuple[int, int]]:
        """The prefix table: for each length from 1 on, the last token of the prefix and its number of characters."""
        table: list[tuple[int, int] | None] = [None] * len(part)
        for end, (token, length) in self.automaton.iter(part):
            if table[end] is None:
                before = end - length
                if before < 0 or self.compatible(table[before][0], token):
                    table[end] = (token, length)
        return table

    def part_ids(self, part: str) -> list[int]:
        """Ids of a part: no token of the vocabulary reaches over its ends. A part of one unknown character becomes its bytes."""
        if len(part) == 1 and part not in self.ids:
            found = self.bytes[list(part.encode())].tolist()
            return found if min(found) >= 0 else [self.unknown]
        table, out, at = self.last_tokens(part), [], len(part) - 1
        while at >= 0:
            token, length = table[at]
            out.append(token)
            at -= length
        return out[::-1]

    def _build_joins(self) -> None:
        """Pairs of characters that stand together in some token, as a hashed bit table: a false hit makes a part longer, never wrong."""
        pairs = {t[k : k + 2] for t in (self.text[i] for i in self.spines) for k in range(len(t) - 1)}
        self.joins = np.zeros(1 << 20, bool)
        codes = np.frombuffer("".join(pairs).encode("utf-32-le"), np.uint32)
        self.joins[self._pair(codes[::2], codes[1::2])] = True

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77)) >> np.uint32(12)

    def _clear(self) -> None:
        self.slots: dict[str, int] = {}
        self.start, self.length, self.store = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 16, np.int32)
        self.used = 0

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids: text i has ids[offsets[i]:offsets[i + 1]], as the library gives them. NULL counts as empty."""
        texts = pc.replace_substring(pc.fill_null(texts.cast(pa.string()), ""), " ", SPACE)
        texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise(SPACE, texts, ""))
        offsets, data = words.raw(texts)
        if not len(data):
            return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int32)
        starts = np.flatnonzero((data & 0xC0) != 0x80)  # first byte of each character
        codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        known = self.known[codes]
        cut = ~(self.joins[self._pair(codes[:-1], codes[1:])] & known[:-1] & known[1:])
        is_cut = np.zeros(len(data) + 1, bool)
        is_cut[offsets] = True
        is_cut[starts[1:][cut]] = True
        cuts = np.flatnonzero(is_cut)
        vocab = words.strings(cuts, data).dictionary_encode()
        slots = self._slots(vocab.dictionary)[vocab.indices.to_numpy()]
        lengths = self.length[slots]
        ends = np.append(0, np.cumsum(lengths))
        return ends[np.searchsorted(cuts, offsets)], self.store[words.ragged(self.start[slots], lengths)]

    def _slots(self, vocab: pa.Array) -> np.ndarray:
        """Places of the parts in the store, which gets the ids of new ones."""
        if len(self.slots) > CACHED_PARTS or self.used > CACHED_IDS:
            self._clear()
        parts = vocab.to_pylist()
        out = np.fromiter(map(self.slots.get, parts, repeat(-1)), np.int64, len(parts))
        new = np.flatnonzero(out < 0)
        if not len(new):
            return out
        wanted = [parts[k] for k in new]
        found = [self.part_ids(part) for part in wanted]
        lengths = np.array([len(f) for f in found], np.int64)
        first, used = len(self.slots), self.used
        self.used += int(lengths.sum())
        while len(self.store) < self.used:
            self.store = np.concatenate([self.store, np.zeros_like(self.store)])
        while len(self.length) < first + len(new):
            self.length, self.start = (np.concatenate([x, np.zeros_like(x)]) for x in (self.length, self.start))
        self.store[used : self.used] = [i for f in found for i in f]
        out[new] = np.arange(first, first + len(new))
        self.length[out[new]] = lengths
        self.start[out[new]] = used + np.cumsum(lengths) - lengths
        self.slots.update(zip(wanted, out[new].tolist(), strict=True))
        return out


class PieceTexts:
    """What each id of a model file stands for in a text, as UTF-8 bytes."""

    _open: dict[str, "PieceTexts"] = {}

    def __init__(self, path: str):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = size = p.vocab_size()
        high, surface = np.zeros(size, bool), []
        for i in range(size):
            if p.is_byte(i):
                surface.append(bytes([int(p.id_to_piece(i)[3:5], 16)]))
                high[i] = surface[-1] >= b"\x80"
            elif p.is_control(i):
                surface.append(b"")
            elif p.is_unknown(i):
                surface.append(p.decode([i]).encode())
            else:
                surface.append(p.id_to_piece(i).replace(SPACE, " ").encode())
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_length = np.array([len(s) for s in surface], np.int64)
        self.surface_start = np.cumsum(self.surface_length) - self.surface_length
        self.is_control = np.array([p.is_control(i) for i in range(size)])
        self.is_high_byte = high
        self.drops_space = np.array([not p.is_byte(i) and p.id_to_piece(i).startswith(SPACE) for i in range(size)])

    @classmethod
    def open(cls, path: str) -> "PieceTexts":
        """One table per worker process and path."""
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def _surface(self, ids: np.ndarray) -> bytes:
        return self.surface[words.ragged(self.surface_start[ids], self.surface_length[ids])].tobytes()

    def _decode_odd(self, ids: np.ndarray) -> str:
        """Text of ids with bytes that need not form characters; a control id ends a run of bytes."""
        return "".join(self._surface(run).decode(errors="each-byte") for run in np.split(ids, np.flatnonzero(self.is_control[ids])))

    def decode(self, offsets: np.ndarray, ids: np.ndarray) -> pa.Array:
        """Texts of ids[offsets[i]:offsets[i + 1]], as the library gives them."""
        if len(ids) and not 0 <= ids.min() <= ids.max() < self.size:
            raise ValueError(f"ids must lie in 0 to {self.size - 1}")
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        length, start = self.surface_length[ids], self.surface_start[ids]
        # The space before the text goes, if a piece brings it that nothing visible precedes.
        seen = np.flatnonzero(~self.is_control[ids])
        first = seen[np.flatnonzero(np.append(True, np.diff(row[seen]) != 0))] if len(seen) else seen
        first = first[self.drops_space[ids[first]]]
        length[first] -= 1
        start[first] += 1
        ends = np.append(0, np.cumsum(length))[offsets]
        data = self.surface[words.ragged(start, length)]
        odd = np.unique(row[self.is_high_byte[ids]])
        if not len(odd):
            return words.strings(ends, data)
        texts, out = data.tobytes(), []
        odd = set(odd.tolist())
        for i in range(len(offsets) - 1):
            mine = ids[offsets[i] : offsets[i + 1]]
            if i in odd:
                text = self._decode_odd(mine)
                out.append(text[1:] if len(at := np.flatnonzero(~self.is_control[mine])) and self.drops_space[mine[at[0]]] else text)
            else:
                out.append(texts[ends[i] : ends[i + 1]].decode())
        return pa.array(out, pa.string())


def encode(docs: DataFrame, model: str, text: str = "text", out: str = "ids") -> DataFrame:
    """All rows and columns with the ids (array of int) of the whole text, without begin or end ids and without sampling.

    NULL and empty texts have no ids; repeated rows are encoded alike; an empty table gives no row; a column named `out` is replaced.
    Nothing is shuffled. A task holds SLICE_BYTES of text, or its longest text, and bounded caches. `model` is the path of the
    model file on the workers; files that are not merge-type, or that change characters, raise ValueError.
    """
    rows = docs.withColumn(out, F.lit(None).cast("array<int>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = MergeModel.open(model)
        for batch in batches:
            for part in words.byte_slices(batch, text):
                offsets, ids = pieces.encode(part.column(text))
                new = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([new if c == out else part.column(c) for c in part.schema.names], names=part.schema.names)

    return rows.mapInArrow(run, rows.schema)


def _id_slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The batch in runs of rows of at most SLICE_IDS ids (or one row), with the ids and their offsets from 0."""
    lists = pc.if_else(pc.is_valid(batch.column(column)), batch.column(column), pa.scalar([], batch.schema.field(column).type))
    ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + SLICE_IDS, side="right")))
        flat = pc.fill_null(lists.slice(start, stop - start).flatten(), -1).to_numpy(zero_copy_only=False)
        yield batch.slice(start, stop - start), np.append(0, ends[start:stop] - before), flat.astype(np.int64)
        start = stop


def decode(rows: DataFrame, model: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """All rows and columns with the text of an array of ids, as the library's decode gives it.

    NULL and empty arrays give the empty string; bytes that form no character give replacement characters; control ids give nothing. An
    id that the model lacks, or a NULL among the ids, raises ValueError. A column named `out` is replaced; nothing is shuffled.
    """
    rows = rows.withColumn(out, F.lit(None).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = PieceTexts.open(model)
        for batch in batches:
            for part, offsets, flat in _id_slices(batch, ids):
                new = pieces.decode(offsets, flat)
                yield pa.RecordBatch.from_arrays([new if c == out else part.column(c) for c in part.schema.names], names=part.schema.names)

    return rows.mapInArrow(run, rows.schema)
