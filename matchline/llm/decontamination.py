"""Benchmark decontamination: a prefix-filtered set join of benchmark windows with document positions.

A window is `window` consecutive words of an item; an item with fewer words is one window. A window occurs where all its shingles do, so
the required overlap is the whole set and the necessary prefix is one shingle: the one in the fewest documents. Documents meet windows
on that shingle alone; the position of the shingle in the window and the length of both sides bound the place, and the words decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words

WINDOW = 13
SHINGLE = 3
#: Benchmark text bytes whose index the tasks hold at once; a larger benchmark is worked through in blocks of about this size.
BLOCK_BYTES = 4 << 20


class Windows(NamedTuple):
    """Distinct windows of a block. Words are numbers of `vocab`; window i has `length[i]` words in row i of `ids`."""

    vocab: pa.Array
    ids: np.ndarray
    length: np.ndarray
    items: list[list[int | None]]


class Index(NamedTuple):
    windows: Windows
    shingle: np.ndarray  # sorted codes of the prefix shingles
    first: np.ndarray  # their postings: first[i] .. first[i + 1]
    window: np.ndarray
    offset: np.ndarray


def windows_of(items: list[tuple[int | None, str | None]], window: int = WINDOW) -> Windows:
    """The distinct windows; items without words have none."""
    found = words.split(pa.array([t for _, t in items], pa.string()), words.LOWER_ALNUM)
    by_words: dict[tuple, set] = {}
    for i, (item, _) in enumerate(items):
        ids = found.codes[found.offsets[i] : found.offsets[i + 1]].tolist()
        size = min(window, len(ids))
        for at in range(len(ids) - size + 1) if size else ():
            by_words.setdefault(tuple(ids[at : at + size]), set()).add(item)
    ids = np.full((len(by_words), window), -1, np.int64)
    for i, w in enumerate(by_words):
        ids[i, : len(w)] = w
    return Windows(found.vocab, ids, np.array([len(w) for w in by_words], np.int64), [list(s) for s in by_words.values()])


def _codes(ids: np.ndarray, size: int, base: int) -> np.ndarray:
    """Codes of all shingles of `size` words along the last axis; -1 where a word is foreign."""
    n = ids.shape[-1] - size + 1
    parts = [ids[..., k : k + n] for k in range(size)]
    code = parts[0] + 1
    for p in parts[1:]:
        code = code * (base + 1) + p + 1
    return np.where(np.minimum.reduce(parts) >= 0, code, -1)


def _window_shingles(w: Windows, size: int) -> np.ndarray:
    """Shingle codes of the windows by offset, -1 past the end; a window of fewer words is one shingle of its first words only."""
    return _codes(w.ids, size, len(w.vocab))


def _sizes(w: Windows, size: int) -> list[int]:
    """Shingle sizes in use: `size`, and the lengths of shorter windows."""
    return sorted({min(size, int(n)) for n in w.length})


def _doc_ids(part: pa.Array, w: Windows) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and benchmark word numbers of the texts, with a -1 after each text so that no shingle spans two."""
    found = words.split(part, words.LOWER_ALNUM)
    known = pc.fill_null(pc.index_in(found.vocab, value_set=w.vocab), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    ids = known[found.codes] if len(known) else np.zeros(0, np.int64)
    return found.offsets, np.insert(ids, found.offsets[1:], -1)


def shingle_documents(docs: DataFrame, text: str, w: Windows, size: int) -> dict[int, int]:
    """Document frequency of each benchmark shingle over all documents. At most one number per shingle of the block reaches the driver."""
    wanted = np.unique(_window_shingles(w, size))
    shared = docs.sparkSession.sparkContext.broadcast((w.vocab, wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, wanted = shared.value
        block = Windows(vocab, np.zeros((0, 1)), np.zeros(0), [])
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for part in words.byte_slices(batch, "text"):
                offsets, ids = _doc_ids(part.column("text"), block)
                code = _codes(ids, size, len(vocab)) if len(ids) >= size else np.zeros(0, np.int64)
                at = np.flatnonzero(code >= 0)
                place = np.minimum(np.searchsorted(wanted, code[at]), len(wanted) - 1)
                at, place = (x[wanted[place] == code[at]] for x in (at, place))
                doc = np.searchsorted(offsets + np.arange(len(offsets)), at, "right")
                total += np.bincount(np.unique(doc * len(wanted) + place) % len(wanted), minlength=len(wanted))
        yield pa.RecordBatch.from_arrays([pa.array(wanted[total > 0]), pa.array(total[total > 0])], names=["code", "n"])

    if not len(wanted):
        return {}
    counted = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    return {r.code: r.n for r in counted.collect()}


def build_index(w: Windows, size: int, frequency: dict[int, int]) -> Index:
    """Postings under the rarest shingle of each window with at least `size` words; ties go to the first."""
    code = _window_shingles(w, size)
    count = np.array([[frequency.get(c, 0) if c >= 0 else np.iinfo(np.int64).max for c in row] for row in code.tolist()], np.int64).reshape(code.shape)
    rows = np.flatnonzero((code[:, 0] >= 0) & (np.minimum(w.length, SHINGLE) == min(size, SHINGLE))) if len(code) else np.zeros(0, np.int64)
    offset = count[rows].argmin(axis=1) if len(rows) else np.zeros(0, np.int64)
    key = code[rows, offset]
    order = np.argsort(key, kind="stable")
    shingle, first = np.unique(key[order], return_index=True)
    return Index(w, shingle, np.append(first, len(order)), rows[order], offset[order])


def occurrences(offsets: np.ndarray, ids: np.ndarray, index: Index, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word position, window) of every window in the texts. `ids` has a -1 after each text, as _doc_ids gives it."""
    none = np.zeros(0, np.int64)
    if len(ids) < size or not len(index.shingle):
        return none, none, none
    code = _codes(ids, size, len(index.windows.vocab))
    at = np.flatnonzero(code >= 0)
    place = np.minimum(np.searchsorted(index.shingle, code[at]), len(index.shingle) - 1)
    hit = index.shingle[place] == code[at]
    at, place = at[hit], place[hit]
    many = index.first[place + 1] - index.first[place]
    posting = words.ragged(index.first[place], many)
    at = np.repeat(at, many)
    starts = offsets + np.arange(len(offsets))  # of the texts among the ids with marks
    doc = np.searchsorted(starts, at, "right") - 1
    window, begin = index.window[posting], at - index.offset[posting]
    length = index.windows.length[window]
    fits = (begin >= starts[doc]) & (begin + length < starts[doc + 1])  # position and length bounds
    doc, window, begin, length = doc[fits], window[fits], begin[fits], length[fits]
    same = np.ones(len(doc), bool)
    for k in range(index.windows.ids.shape[1]):
        inside = k < length
        same &= ~inside | (ids[np.minimum(begin + k, len(ids) - 1)] == index.windows.ids[window, k])
    return doc[same], (begin - starts[doc])[same], window[same]


def _merged(spans: list[tuple[int, int]]) -> list[int]:
    """Disjoint spans as start, end, start, end ..."""
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _mark(docs: DataFrame, text: str, w: Windows) -> DataFrame:
    indexes = [(size, build_index(w, size, shingle_documents(docs, text, w, size))) for size in _sizes(w, SHINGLE)]
    shared = docs.sparkSession.sparkContext.broadcast((w, indexes))
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, indexes = shared.value
        for batch in batches:
            for part in words.byte_slices(batch, text):
                offsets, ids = _doc_ids(part.column(text).cast(pa.string()), w)
                spans, items = part.column("_spans").to_pylist(), part.column("_items").to_pylist()
                for size, index in indexes:
                    for doc, begin, window in zip(*(x.tolist() for x in occurrences(offsets, ids, index, size)), strict=True):
                        end = begin + int(w.length[window])
                        spans[doc] = [*spans[doc], begin, end]
                        items[doc] = [*items[doc], *w.items[window]] if not set(w.items[window]) <= set(items[doc]) else items[doc]
                spans = [_merged(list(zip(s[::2], s[1::2], strict=True))) if len(s) > 2 else s for s in spans]
                items = [list(dict.fromkeys(i)) for i in items]
                new = {"_n_words": pa.array(np.diff(offsets)), "_spans": pa.array(spans, pa.list_(pa.int64())), "_items": pa.array(items, pa.list_(pa.int64()))}
                yield pa.RecordBatch.from_arrays([new.get(n, part.column(n)) for n in part.schema.names], names=part.schema.names)

    return docs.mapInArrow(run, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", out: str = "contamination", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All rows and columns of `docs` with a struct `out`: n_words, n_hit, spans (word positions start, end, start, end ...), items.

    Only the benchmark is sent to the tasks, and only a block of it at a time; documents are not shuffled. NULL and empty texts have no
    words and no hit; an empty benchmark hits nothing; a repeated item counts once; items without words never match. Repeated documents
    are judged alike. A column named `out` is replaced; the names _n_words, _spans and _items are used inside.
    """
    size = benchmark.agg(F.sum(F.octet_length(item_text))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    rows = docs.withColumns({"_n_words": F.lit(0).cast("long"), "_spans": F.array().cast(T.ArrayType(T.LongType())), "_items": F.array().cast(T.ArrayType(T.LongType()))})
    pairs = benchmark.select(F.col(item_id).cast("long").alias("item"), F.col(item_text).alias("text"))
    for b in range(blocks):
        of_block = pairs if blocks == 1 else pairs.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        rows = _mark(rows, text, windows_of([tuple(r) for r in of_block.collect()], window))
    hit = F.aggregate(F.sequence(F.lit(0), (F.size("_spans") / 2).cast("int")), F.lit(0).cast("long"), lambda s, i: s + F.coalesce(F.try_element_at("_spans", 2 * i + 2) - F.try_element_at("_spans", 2 * i + 1), F.lit(0)))
    found = F.struct(F.col("_n_words").alias("n_words"), hit.alias("n_hit"), F.col("_spans").alias("spans"), F.col("_items").alias("items"))
    return rows.withColumn(out, found).drop("_n_words", "_spans", "_items")


def is_contaminated(found: str = "contamination"):
    """Any hit, and hit words at least a twentieth of the document's."""
    return (F.col(found)["n_hit"] > 0) & (F.col(found)["n_hit"] * 20 >= F.col(found)["n_words"])
