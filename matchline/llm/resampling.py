"""Target-distribution importance resampling: draw the documents that look most like a target corpus.

Words fall into hashed buckets. A bucket's gain is the log ratio of its share in the target and in the documents; a document's weight is
the sum of gains over its words, read from one array. Weights plus Gumbel noise rank the documents, and the best of them are a draw
without replacement in proportion to exp(weight). The cutoff key of the draw comes from weighted medians of partition medians.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchline.sources.scratch import materialise

from . import words

BUCKETS = 10_000
SEED = 2024
#: Gains, weights and noise are whole thousandths, so that sums do not depend on their order.
SCALE = 1000
#: Winners that one task orders on average.
SLICE_ROWS = 50_000
#: Keys left over from the rounds of the selection that the driver puts in order itself.
FINISH = 10_000

_LAST = np.iinfo(np.int64).max


def feature_buckets(texts: pa.Array, buckets: int, longest: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every feature: all runs of 1 to `longest` words, repeats counted, in no order. Buckets are crc32 modulo `buckets`."""
    found = words.split(texts, words.LOWER_ALNUM)
    text = np.repeat(np.arange(len(texts)), np.diff(found.offsets))
    out_text, out_bucket = [], []
    for size in range(1, longest + 1):
        first = np.flatnonzero(text[: len(text) - size + 1] == text[size - 1 :]) if len(text) >= size else np.zeros(0, np.int64)
        if size == 1:
            vocab, codes = found.vocab, found.codes
        else:
            runs = pc.binary_join_element_wise(*[found.vocab.take(pa.array(found.codes[first + k])) for k in range(size)], " ").dictionary_encode()
            vocab, codes = runs.dictionary, runs.indices.to_numpy()
        crc = np.fromiter(map(zlib.crc32, vocab.cast(pa.binary()).to_pylist()), np.int64, len(vocab))
        out_text.append(text[first])
        out_bucket.append((crc % buckets)[codes])
    return np.concatenate(out_text), np.concatenate(out_bucket)


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = 1) -> np.ndarray:
    """Features of all rows by bucket. A task sends at most one row a bucket; the driver gets `buckets` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in words.byte_slices(batch, "text"):
                total += np.bincount(feature_buckets(part.column("text"), buckets, longest)[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    counted = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in counted.collect():
        out[r.bucket] = r.n
    return out


def gains(docs: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole thousandths of ln of the target's share over the documents' share of each bucket, one added to every count."""
    s, t = docs.astype(np.float64), target.astype(np.float64)
    n = len(s)
    return np.floor(SCALE * np.log(((t + 1) * (s.sum() + n)) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def with_weights(docs: DataFrame, gain: np.ndarray, text: str = "text", longest: int = 1) -> DataFrame:
    """All rows and columns with n_words, n_features and weight (long): the sum of gains over the row's features, 0 without any.

    NULL counts as empty. The gains, one number a bucket, are all that is sent to the tasks; nothing is shuffled. Columns of these three
    names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    rows = docs.withColumns({c: F.lit(0).cast("long") for c in ("n_words", "n_features", "weight")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            for part in words.byte_slices(batch, text):
                row, bucket = feature_buckets(part.column(text).cast(pa.string()), len(gain), longest)
                count = np.bincount(row, minlength=part.num_rows)
                n = count.copy() if longest == 1 else np.diff(words.split(part.column(text), words.LOWER_ALNUM).offsets)
                weight = np.bincount(row, gain[bucket], part.num_rows)  # whole numbers far below 2^53
                new = {k: pa.array(v.astype(np.int64)) for k, v in (("n_words", n), ("n_features", count), ("weight", weight))}
                yield pa.RecordBatch.from_arrays([new.get(c, part.column(c)) for c in part.schema.names], names=part.schema.names)

    return rows.mapInArrow(run, rows.schema)


def noise(key: str = "doc_id", seed: int = SEED) -> Column:
    """Gumbel noise in whole thousandths from a digest of the key; a NULL key is the empty string."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(SCALE)) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


class Key(NamedTuple):
    """Place of a row in the draw: smaller is better."""

    minus_score: int
    id: int
    tie: int


def _smaller(keys: np.ndarray, than: Key) -> np.ndarray:
    """Which rows of (n, 3) come before a key."""
    out = keys[:, 2] < than[2]
    for c in (1, 0):
        out = (keys[:, c] < than[c]) | ((keys[:, c] == than[c]) & out)
    return out


def _before(key: Key, or_same: bool = False) -> Column:
    """The same test as a filter that the scan of the key table can use."""
    a, b, c = F.col("minus_score"), F.col("id"), F.col("tie")
    last = c <= key.tie if or_same else c < key.tie
    return (a <= key.minus_score) & ((a < key.minus_score) | (b < key.id) | ((b == key.id) & last))


def _after(key: Key) -> Column:
    return (F.col("minus_score") >= key.minus_score) & ~_before(key, or_same=True)


def _median(keys: np.ndarray) -> tuple[Key, int] | None:
    if not len(keys):
        return None
    order = np.lexsort((keys[:, 2], keys[:, 1], keys[:, 0]))
    return Key(*keys[order[(len(keys) - 1) // 2]].tolist()), len(keys)


def _split(keys: DataFrame, pivot: Key | None) -> list:
    """One row a partition: median and number of its keys before the pivot and after it (all are after none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.concatenate([np.zeros((0, 3), np.int64)] + [np.column_stack([b.column(c).to_numpy() for c in Key._fields]) for b in batches])
        first = _smaller(mine, pivot) if pivot else np.zeros(len(mine), bool)
        rest = ~first & (mine != pivot).any(axis=1) if pivot else ~first
        sides = [_median(mine[first]), _median(mine[rest])]
        rows = [{"side": i, "n": s[1], **s[0]._asdict()} for i, s in enumerate(sides) if s]
        if rows:
            yield pa.RecordBatch.from_pylist(rows)

    return keys.mapInArrow(run, "side long, n long, minus_score long, id long, tie long").collect()


def weighted_median(medians: list[tuple[Key, int]]) -> Key:
    """The key at which half of the weight is reached."""
    medians = sorted(medians)
    half, seen = sum(n for _, n in medians) / 2, 0
    for key, n in medians:
        seen += n
        if seen >= half:
            return key
    raise ValueError("no medians")


def cutoff(keys: DataFrame, place: int, finish: int = FINISH, rewrite: int = 8) -> Key:
    """The key at `place` (1 is the smallest) of a table of distinct keys (minus_score, id, tie), for 1 <= place <= rows.

    Each round splits the keys that are left at a pivot, in one job that returns one row a partition and side. The pivot is the median of
    the partitions' medians, weighted by what each has left. Half of the partitions' weight holds half of its keys on either side, so
    a round discards at least a quarter of the keys, on either side alike, and the cutoff key is met exactly. Once fewer than one in
    `rewrite` of the table's keys are left they are written anew, so that the work of all rounds is a multiple of the first one. The last
    `finish` keys or fewer are put in order on the driver.
    """
    low = high = pivot = None
    between, seen, table_rows = keys, 0, None
    while True:
        sides = ([], [])
        for r in _split(between, pivot):
            sides[r.side].append((Key(r.minus_score, r.id, r.tie), r.n))
        first, rest = (sum(n for _, n in s) for s in sides)
        table_rows = table_rows or first + rest
        if pivot is None:
            side, remaining = sides[1], rest
        elif place == seen + first + 1:
            return pivot
        elif place <= seen + first:
            high, side, remaining = pivot, sides[0], first
        else:
            low, seen, side, remaining = pivot, seen + first + 1, sides[1], rest
        if not 0 < place - seen <= remaining:
            raise ValueError(f"no key at place {place}")
        between = keys.where(_after(low)) if low is not None else keys
        between = between.where(_before(high)) if high is not None else between
        if remaining <= finish:
            return Key(*sorted(tuple(r) for r in between.select(*Key._fields).collect())[place - seen - 1])
        if remaining * rewrite < table_rows:
            keys, low, high, table_rows = materialise(between, "keys"), None, None, remaining
            between = keys
        pivot = weighted_median(side)


def _ranked(winners: DataFrame, out: str, count: int) -> DataFrame:
    """Places from 1 in key order; ranges of keys are written once, and the counts of the ranges before a range are its offset."""
    order = list(Key._fields)
    dealt = materialise(winners.repartitionByRange(max(1, -(-count // SLICE_ROWS)), *order).withColumn("_slice", F.spark_partition_id()), "winners")
    counts = dealt.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_slice", F.coalesce(F.sum("_n").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # one row a range
    place = F.row_number().over(Window.partitionBy("_slice").orderBy(*order))
    return dealt.withColumn("_place", place).join(F.broadcast(offsets), "_slice").withColumn(out, (F.col("_before") + F.col("_place")).cast("long")).drop("_slice", "_place", "_before")


def resample(docs: DataFrame, target: DataFrame, percent: int, key: str = "doc_id", text: str = "text", target_text: str = "text", least_words: int = 20, buckets: int = BUCKETS, longest: int = 1, seed: int = SEED) -> DataFrame:
    """One row per document: (key, n_features, weight, score, rank), all long; rank counts the drawn documents from 1, NULL for the others.

    Of the N documents with at least `least_words` words, floor(percent * N / 100) with the highest scores are drawn; ties go to the smaller
    key, a NULL key last, then rows of one key by a running number. The score is the weight plus noise from the key and the seed. NULL and
    empty texts have no features, weight 0 and are never drawn unless `least_words` is 0. Repeated rows count and are drawn each by itself.
    An empty target gives gains from the documents alone; an empty table gives no row. Other columns are not read, whatever their names.
    The key is cast to long.

    Only numbers of fixed size a document are written (no text): scores once, the drawn rows once more in key order. The driver gets bucket counts and
    one or two rows a partition a round. A task holds the keys of its own partition of the score table, never a document twice.
    """
    if least_words < 0 or not 0 <= percent <= 100:
        raise ValueError("percent must lie in 0 to 100 and least_words must not be negative")
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    of_target = bucket_counts(target.select(F.col(target_text).alias("text")), buckets=buckets, longest=longest)
    weighed = with_weights(rows, gains(bucket_counts(rows, buckets=buckets, longest=longest), of_target), longest=longest)
    scored = weighed.select(
        "key", "n_features", "weight", (F.col("weight") + noise("key", seed)).alias("score"), (F.col("n_words") >= least_words).alias("able"), F.monotonically_increasing_id().alias("tie"),
    )
    scored = materialise(scored.withColumns({"minus_score": -F.col("score"), "id": F.coalesce("key", F.lit(int(_LAST)))}), "scores")
    able = scored.where("able").count()
    place = percent * able // 100
    columns = [F.col("key").alias(key), "n_features", "weight", "score"]
    unranked = F.lit(None).cast("long").alias("rank")
    if not place:
        return scored.select(*columns, unranked)
    last = cutoff(scored.where("able").select(*Key._fields), place)
    drawn = F.col("able") & _before(last, or_same=True)
    return _ranked(scored.where(drawn), "rank", place).select(*columns, "rank").unionByName(scored.where(~drawn).select(*columns, unranked))
