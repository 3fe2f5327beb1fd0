"""Sharding: rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchline.sources.scratch import materialise

#: Rows that one ordered window of `with_slots` holds on average.
SLICE_ROWS = 50_000


def _draw(key: Column, shard: int) -> Column:
    """A number in (0, 1) that depends on the key and the shard alone; the digest is the same in every engine."""
    digest = F.md5(F.concat_ws("/", F.coalesce(key.cast("string"), F.lit("null")), F.lit(str(shard))))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**48))


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard whose draw wins: the least -ln(draw) / weight, the lower number at equality.

    A shard gets rows in proportion to its weight. A new shard at the end takes rows only into itself, and only as many as its share.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    bids = [F.struct((-F.log(_draw(key, i)) / F.lit(float(w))).alias("bid"), F.lit(i).alias("shard")) for i, w in enumerate(weights)]
    return (F.least(*bids) if len(bids) > 1 else bids[0])["shard"]


def with_shards(docs: DataFrame, key: str = "doc_id", weights: Sequence[float] = (1.0,) * 8, out: str = "shard") -> DataFrame:
    """All rows with their shard. A NULL key is a key of its own; equal keys share a shard; a column named `out` is replaced."""
    return docs.withColumn(out, shard_of(F.col(key), weights))


def with_slots(rows: DataFrame, shard: str, order: Sequence[str], out: str = "slot", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Positions from 0 without gaps in each shard, in the order of the `order` columns, although no task sees a whole shard.

    Rows are dealt by ranges of `order` and written once; the counts of the ranges before a range are its offset, and rows are numbered
    inside their range only. A running number breaks ties, so a key that holds a third of all rows spreads over ranges too; rows equal
    in `order` are numbered in any order. The number of ranges follows the number of rows.
    """
    slices = max(1, -(-rows.count() // slice_rows))
    keys = [F.col(c) for c in order] + [F.col("_tie")]
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(slices, *keys).withColumn("_slice", F.spark_partition_id())
    dealt = materialise(dealt, "slots")
    counts = dealt.groupBy(shard, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(shard).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(shard, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy(shard, "_slice").orderBy(*keys)).cast("long") - 1)
    return ranked.join(offsets, [shard, "_slice"]).withColumn(out, F.col("_before") + F.col("_rank")).drop("_slice", "_rank", "_before", "_tie")
