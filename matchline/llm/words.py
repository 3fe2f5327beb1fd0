"""Word splitting of Arrow text columns, a slice of bounded size at a time."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that one task handles at once; a longer single text is a slice of its own.
SLICE_BYTES = 2 << 20

_BYTES = np.arange(256, dtype=np.uint8)
_UPPER = (_BYTES >= 0x41) & (_BYTES <= 0x5A)
#: Lower-case A-Z, everything else as it is.
LOWER = np.where(_UPPER, _BYTES + 32, _BYTES).astype(np.uint8)
_ASCII_NO_WORD = (_BYTES <= 0x2F) | ((_BYTES >= 0x3A) & (_BYTES <= 0x60)) | ((_BYTES >= 0x7B) & (_BYTES <= 0x7F))
#: Lower-case A-Z; ASCII other than letters and digits becomes a space.
LOWER_ALNUM = np.where(_UPPER, _BYTES + 32, np.where(_ASCII_NO_WORD, 0x20, _BYTES)).astype(np.uint8)


class Words(NamedTuple):
    """Text i has the words vocab[codes[offsets[i]:offsets[i + 1]]]."""

    offsets: np.ndarray
    codes: np.ndarray
    vocab: pa.Array


def byte_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose text column holds at most `limit` bytes (or one row)."""
    if batch.num_rows == 0:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and UTF-8 bytes of a string column; NULL counts as empty."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int32, len(texts) + 1, texts.offset * 4) if len(texts) else np.zeros(1, np.int32)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    return (offsets - offsets[0]).astype(np.int32), data


def strings(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)), pa.py_buffer(np.ascontiguousarray(data)))


def split(texts: pa.Array, table: np.ndarray = LOWER) -> Words:
    """Words between ASCII white space (x20, x09-x0D) after the byte table is applied; vocab has each word once."""
    offsets, data = raw(texts)
    return split_raw(offsets, table[data])


def split_raw(offsets: np.ndarray, data: np.ndarray) -> Words:
    lists = pc.ascii_split_whitespace(strings(offsets, data))
    flat = lists.flatten()
    at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    filled = pc.not_equal(pc.binary_length(flat), 0)
    kept = np.zeros(len(flat) + 1, np.int64)
    np.cumsum(filled.to_numpy(zero_copy_only=False), out=kept[1:])
    coded = flat.filter(filled).dictionary_encode()
    return Words(kept[at], coded.indices.to_numpy().astype(np.int64), coded.dictionary)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[i] .. starts[i] + lengths[i] - 1 for all i, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
