"""Periodic runs: stretches of a text in which the same words come round and round.

A run of period q is a longest stretch whose words q apart are identical; it counts from `least` words and `times` periods on. Every word of such a run
occurs in it `times` times or more. So a word that is rarer than that within its segment lies in no run of the segment and splits it;
the parts are judged anew, since a word may be rare in its part, until no word splits. What is left is scanned for the lags at
which blocks of words recur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words

LEAST = 24
TIMES = 3
#: Rounds of splitting after which the scan takes the segments as they are; it is exact on any segment, split or not.
ROUNDS = 64

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
SCHEMA = f"struct<runs:{RUNS},collapsed:string>"

_ANY = np.arange(256, dtype=np.uint8)


def _segment_ids(at: np.ndarray) -> np.ndarray:
    """Numbers of the stretches of consecutive positions."""
    new = np.ones(len(at), bool)
    new[1:] = np.diff(at) != 1
    return np.cumsum(new) - 1


def _long_enough(at: np.ndarray, least: int) -> np.ndarray:
    segment = _segment_ids(at)
    return at[np.bincount(segment)[segment] >= least] if len(at) else at


def split_by_frequency(at: np.ndarray, codes: np.ndarray, least: int = LEAST, times: int = TIMES, rounds: int = ROUNDS) -> np.ndarray:
    """The positions that can lie in a run. `at` is ascending, codes[i] the word at position i; a gap in `at` ends a segment."""
    done, at = [], _long_enough(at, least)
    for _ in range(rounds):
        if not len(at):
            break
        segment = _segment_ids(at)
        _, group, count = np.unique(segment * (int(codes.max()) + 1) + codes[at], return_inverse=True, return_counts=True)
        stays = count[group] >= times
        split = np.bincount(segment, ~stays) > 0
        # Segments without a rare word are stable; only the others go on.
        done.append(at[~split[segment]])
        at = _long_enough(at[stays & split[segment]], least)
    return np.sort(np.concatenate([*done, at]))


def scan_lags(at: np.ndarray, codes: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (start, length, period) of all runs within the segments of `at`, by start, then period.

    Blocks of 1, 2, 4 ... words get names, equal blocks of a segment the same one; a block's name comes from those of its halves. Let s be the least such size
    that is not below the period q. A run is longer than q + s, and inside it a block of s words comes again first after q words: any
    sooner, and the run would have a smaller period. So consecutive positions whose block of s words comes again first at one
    lag in s/2+1 .. s are exactly a run, and each size scans its lags by one sort. Blocks that do not come again are left out.
    """
    found = []
    if len(at):
        name = np.full(int(at[-1]) + 2, -1, np.int64)
        # Names differ between segments.
        name[at] = _segment_ids(at) * (int(codes.max()) + 1) + codes[at]
        longest = int(np.bincount(_segment_ids(at)).max())
    size = 1
    while len(at):
        order = np.argsort(name[at], kind="stable")
        sorted_at, sorted_name = at[order], name[at][order]
        same = np.diff(sorted_name) == 0
        lag = np.zeros(len(name), np.int64)
        lag[sorted_at[:-1][same]] = np.diff(sorted_at)[same]
        here = at[(lag[at] > size // 2) & (lag[at] <= size)]
        if len(here):
            first = np.ones(len(here), bool)
            first[1:] = (np.diff(here) != 1) | (np.diff(lag[here]) != 0)
            begin = np.flatnonzero(first)
            end = np.append(begin[1:], len(here)) - 1
            q = lag[here[begin]]
            length = here[end] - here[begin] + size + q
            counts = length >= np.maximum(least, times * q)
            found.append(np.column_stack([here[begin], length, q])[counts])
        size *= 2
        if size // 2 >= longest // times:
            break
        # Blocks twice as long, of two halves that both come again somewhere.
        again = np.zeros(len(at), bool)
        again[1:] |= same
        again[:-1] |= same
        renamed = np.full(len(name), -1, np.int64)
        renamed[sorted_at[again]] = np.cumsum(np.append(True, ~same))[again]
        at = np.sort(sorted_at[again])
        second = at + size // 2
        whole = second < len(name)
        at, second = at[whole], second[whole]
        at, second = (x[renamed[second] >= 0] for x in (at, second))
        name[:] = -1
        name[at] = renamed[at] * (len(sorted_at) + 1) + renamed[second]
    rows = np.concatenate([np.zeros((0, 3), np.int64), *found])
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def runs_of(offsets: np.ndarray, codes: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray]:
    """Runs of texts (text i has the words codes[offsets[i]:offsets[i + 1]]): their texts, and rows (start, length, period)."""
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    # One free place after each text, so that no segment spans two.
    at = np.arange(len(codes)) + text
    spread = np.zeros(len(codes) + len(offsets), np.int64)
    spread[at] = codes
    rows = scan_lags(split_by_frequency(at, spread, least, times), spread, least, times)
    begins = offsets[:-1] + np.arange(len(offsets) - 1)
    of = np.searchsorted(begins, rows[:, 0], "right") - 1
    rows[:, 0] -= begins[of]
    return of, rows


def kept_words(offsets: np.ndarray, of: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which words stay: all but those that a run holds after its first period."""
    edge = np.zeros(int(offsets[-1]) + 1, np.int64)
    start = offsets[of] + rows[:, 0]
    np.add.at(edge, start + rows[:, 2], 1)
    np.add.at(edge, start + rows[:, 1], -1)
    return np.cumsum(edge[:-1]) == 0


def _joined(found: words.Words, kept: np.ndarray) -> pa.Array:
    before = np.append(0, np.cumsum(kept))
    flat = found.vocab.take(pa.array(found.codes[kept]))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(before[found.offsets], pa.int32()), flat), " ")


def with_runs(docs: DataFrame, text: str = "text", out: str = "periodic", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """All rows and columns with a struct `out`: runs (start, length, period in words, by start, then period) and the collapsed text.

    Words lie between ASCII white space. Periods are the smallest ones, and no neighbouring word extends a run. Collapsing drops the words that
    a run holds after its first period and joins the others by one space, in texts without runs too. NULL, empty and wordless texts have
    no runs and collapse to the empty string. Repeated rows are judged alike; an empty table gives no row; a column named `out` is
    replaced. Texts are judged where they lie: nothing is shuffled. A task holds the words of SLICE_BYTES of text, or of its longest text.
    """
    if times < 3:
        raise ValueError("a run needs three periods or more")
    rows = docs.withColumn(out, F.lit(None).cast(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.byte_slices(batch, text):
                found = words.split(part.column(text), _ANY)
                of, runs = runs_of(found.offsets, found.codes, least, times)
                ends = np.append(0, np.cumsum(np.bincount(of, minlength=part.num_rows)))
                structs = pa.StructArray.from_arrays([pa.array(c) for c in runs.T.astype(np.int64)], ["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs)
                new = pa.StructArray.from_arrays([lists, _joined(found, kept_words(found.offsets, of, runs))], ["runs", "collapsed"])
                yield pa.RecordBatch.from_arrays([new if c == out else part.column(c) for c in part.schema.names], names=part.schema.names)

    return rows.mapInArrow(run, rows.schema)


def strongest(runs: Column) -> Column:
    """The run with the greatest length over period, compared as whole numbers; the first in order at equality, NULL without runs."""
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.aggregate(runs, F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), lambda best, r: F.when(better(best, r), r).otherwise(best))
