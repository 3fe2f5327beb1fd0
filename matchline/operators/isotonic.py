"""Monotone fits of a hit rate on a distance, pooled where the rows are.

Rows are dealt by ranges of the distance. Each partition pools its adjacent violators and leaves blocks: stretches of the distance with one rate. Pooling
in any order gives the one solution, so the blocks of neighbouring ranges are pooled again, in ever fewer ranges, until all
lie in one and nothing is left to pool. Rates of blocks are distinct fractions that rise, which keeps their number far below the number of rows,
however many distances are distinct; only blocks reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialise

#: Blocks that one task pools on average in the rounds after the first.
BLOCKS_PER_TASK = 1 << 16

BLOCKS = "low double, high double, n_rows long, hits long"


def pool(low: np.ndarray, high: np.ndarray, n: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pool adjacent blocks, in order and of different distances, until rates rise strictly."""
    while len(low) > 1:
        rate = hits / n
        joins = rate[1:] <= rate[:-1]
        if not joins.any():
            return low, high, n, hits
        first = np.flatnonzero(np.append(True, ~joins))
        end = np.append(first[1:], len(low)) - 1
        shrunk = len(first) < 0.9 * len(low)
        low, high, n, hits = low[first], high[end], np.add.reduceat(n, first), np.add.reduceat(hits, first)
        if not shrunk:
            return _pool_by_stack(low, high, n, hits)
    return low, high, n, hits


def _pool_by_stack(low, high, n, hits) -> tuple[np.ndarray, ...]:
    """The same one block at a time, for what is left where a pass over all joins few."""
    stack: list[list] = []
    for block in zip(low.tolist(), high.tolist(), n.tolist(), hits.tolist(), strict=True):
        stack.append(list(block))
        while len(stack) > 1 and stack[-1][3] / stack[-1][2] <= stack[-2][3] / stack[-2][2]:
            _, top_high, top_n, top_hits = stack.pop()
            stack[-1][1:] = [top_high, stack[-1][2] + top_n, stack[-1][3] + top_hits]
    columns = list(zip(*stack, strict=True))
    return tuple(np.array(c, t) for c, t in zip(columns, (float, float, np.int64, np.int64), strict=True))


def one_per_distance(low: np.ndarray, high: np.ndarray, n: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted rows with equal distances made one; they must be before any pooling, since only their whole rate counts."""
    first = np.flatnonzero(np.append(True, np.diff(low) != 0)) if len(low) else np.zeros(0, np.int64)
    return (low[first], high[first], np.add.reduceat(n, first), np.add.reduceat(hits, first)) if len(first) else (low, high, n, hits)


_COLUMNS = ("low", "high", "n_rows", "hits")
_NONE = tuple(np.zeros(0, t) for t in (float, float, np.int64, np.int64))


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per distance and batch, so that a distance that most rows share stays small before it moves."""
    for batch in batches:
        low, row = np.unique(batch.column("low").to_numpy(zero_copy_only=False), return_inverse=True)
        hits = np.bincount(row, batch.column("hits").to_numpy(zero_copy_only=False), len(low)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (low, low, np.bincount(row, minlength=len(low)), hits)], names=_COLUMNS)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    held = open_ = _NONE  # the last distance of a batch may go on in the next one
    for batch in batches:
        new = [batch.column(c).to_numpy(zero_copy_only=False) for c in _COLUMNS]
        new = one_per_distance(*[np.concatenate(x) for x in zip(open_, new, strict=True)])
        open_ = tuple(c[-1:] for c in new)
        held = pool(*[np.concatenate(x) for x in zip(held, pool(*[c[:-1] for c in new]), strict=True)])
    held = pool(*[np.concatenate(x) for x in zip(held, open_, strict=True)])
    if len(held[0]):
        part = pa.array(np.full(len(held[0]), TaskContext.get().partitionId(), np.int32))
        yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in held], part], names=[*_COLUMNS, "part"])


def _pooled(rows: DataFrame) -> tuple[DataFrame, int, int]:
    """The blocks each partition leaves, written once; how many there are, and in how many partitions."""
    blocks = materialise(rows.sortWithinPartitions("low").mapInArrow(_run, BLOCKS + ", part int"), "blocks")
    n, parts = blocks.agg(F.count(F.lit(1)), F.count_distinct("part")).first()
    return blocks, n, parts


def isotonic_blocks(df: DataFrame, distance: Column, hit: Column) -> DataFrame:
    """(low, high, n_rows, hits, rate): the blocks of the monotone fit of `hit` (boolean) on `distance`, which do not overlap and whose rates rise with it.

    Rows where either is NULL or NaN are left out; a table without others has no block. Rows of one distance are combined batch by batch before they
    move, so a distance that most rows share does not fill a task. Later rounds move blocks only, into half as many ranges or fewer.
    """
    rows = df.select(distance.cast("double").alias("low"), hit.cast("long").alias("hits"))
    rows = rows.filter(F.col("low").isNotNull() & ~F.isnan("low") & F.col("hits").isNotNull())
    blocks, n, parts = _pooled(rows.mapInArrow(_combine, BLOCKS).repartitionByRange("low"))
    while parts > 1:
        ranges = max(1, min(parts // 2, n // BLOCKS_PER_TASK))
        meet = blocks.drop("part")
        blocks, n, parts = _pooled(meet.coalesce(1) if ranges == 1 else meet.repartitionByRange(ranges, "low"))
    return blocks.select("low", "high", "n_rows", "hits", (F.col("hits") / F.col("n_rows")).alias("rate"))
