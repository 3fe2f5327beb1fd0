"""Packing: token sequences of a fixed capacity with near equal attention cost."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import token_ids, words

CAPACITY = 4096
END_ID = 2
#: Tokens that are packed together; a task holds the ids of one such group.
GROUP_TOKENS = 4 << 20
#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n; attention outweighs the rest from about 2,000 tokens on.
LINEAR, QUADRATIC = 1.0, 1.0 / 2048

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"


def assign(lengths: np.ndarray, capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC) -> tuple[np.ndarray, int]:
    """Pack documents of the given token counts into as few sequences as their tokens need.

    Longest first, each document goes whole to the cheapest sequence that has room for it; one that fits nowhere is cut over the cheapest
    sequences with room left. What exceeds the capacity is cut into full sequences before. Ties go to the lower document and sequence.
    Returns rows (document, start, length, sequence, offset) in assignment order, and the number of sequences. Empty documents get no piece.
    """
    lengths = np.asarray(lengths, np.int64)
    count = int(-(-lengths.sum() // capacity))
    cost, free = np.zeros(count), np.full(count, capacity, np.int64)
    pieces, full = [], 0
    for doc in np.flatnonzero(lengths >= capacity):
        for start in range(0, int(lengths[doc] // capacity) * capacity, capacity):
            pieces.append((doc, start, capacity, full, 0))
            cost[full], free[full] = linear * capacity + quadratic * capacity**2, 0
            full += 1
    rest = lengths % capacity
    # Only sequences with room left stay in the search.
    open_ = np.arange(full, count)
    open_cost, open_free = cost[full:].copy(), free[full:].copy()

    def put(doc: int, start: int, length: int, at: int) -> None:
        pieces.append((doc, start, length, open_[at], capacity - open_free[at]))
        open_free[at] -= length
        open_cost[at] += linear * length + quadratic * length * length

    for doc in np.argsort(-rest, kind="stable"):
        left, start = int(rest[doc]), int(lengths[doc] - rest[doc])
        if not left:
            break
        fits = np.where(open_free >= left, open_cost, np.inf)
        at = int(fits.argmin())
        if fits[at] < np.inf:
            put(doc, start, left, at)
            continue
        while left:
            at = int(np.where(open_free > 0, open_cost, np.inf).argmin())
            length = min(left, int(open_free[at]))
            put(doc, start, length, at)
            left, start = left - length, start + length
    return np.array(pieces, np.int64).reshape(-1, 5), count


def _rows(doc_ids: list, offsets: np.ndarray, ids: np.ndarray, first: int, capacity: int, linear: float, quadratic: float) -> tuple[pa.RecordBatch, int]:
    pieces, count = assign(np.diff(offsets), capacity, linear, quadratic)
    doc, start, length, sequence, offset = pieces.T
    begin = offsets[doc] + start
    data = ids.astype("<u4")
    crc = [zlib.crc32(data[b : b + n]) for b, n in zip(begin.tolist(), length.tolist(), strict=True)]
    columns = [pa.array([doc_ids[i] for i in doc], pa.int64()), start, length, crc, np.diff(offsets)[doc], sequence + first, offset, linear * length + quadratic * length**2]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=PIECES_NAMES), first + count


PIECES_NAMES = [c.split()[0] for c in PIECES.split(", ")]


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID, capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS, linear: float = LINEAR, quadratic: float = QUADRATIC) -> DataFrame:
    """One row per piece: PIECES, where `doc_id` holds the key column.

    A document is its tokens and the end id; NULL and empty texts are the end id alone. Each task packs its own rows in groups of about
    `group_tokens` tokens, so nothing is shuffled, a hot key cannot gather anywhere, and each group wastes less than one sequence.
    Repeated rows are packed as often as they occur. Sequence ids are unique; they hold the partition and a running number.
    Other columns are not read. A group's ids and its longest text are held in memory.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = token_ids.WordEncoder.open(tokenizer)
        held, held_tokens, sequence = [], 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, held_tokens, sequence
            ends = np.concatenate([[0], *[o[1:] + shift for (_, o, _), shift in zip(held, np.cumsum([0] + [o[-1] for _, o, _ in held[:-1]]), strict=True)]])
            out, sequence = _rows([d for docs_, _, _ in held for d in docs_], ends, np.concatenate([i for _, _, i in held]), sequence, capacity, linear, quadratic)
            held, held_tokens = [], 0
            yield out

        for batch in batches:
            if batch.num_rows and sequence is None:
                sequence = batch.column(2)[0].as_py() << 33
            for part in words.byte_slices(batch, "text"):
                offsets, ids = encoder.encode(part.column("text"))
                ids = np.insert(ids, offsets[1:], end_id)
                offsets = offsets + np.arange(len(offsets))
                held.append((part.column("key").to_pylist(), offsets, ids))
                held_tokens += len(ids)
                if held_tokens >= group_tokens:
                    yield from flush()
        if held:
            yield from flush()

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"), F.spark_partition_id().alias("part")).mapInArrow(run, PIECES)
