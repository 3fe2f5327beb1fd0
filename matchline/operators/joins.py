"""Lookup joins: left rows gain columns from a table with at most one row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialise

BROADCAST_BYTES = 64 * 1024 * 1024
# Columnar files hold a row in a fraction of what a broadcast table needs for it.
FILE_GROWTH = 4


def estimated_bytes(df: DataFrame) -> int | None:
    """Spark's own size estimate of the frame, None when the session cannot tell."""
    try:
        plan = df._jdf.queryExecution().optimizedPlan()
    except AttributeError:
        return None
    return int(str(plan.stats().sizeInBytes()))


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES, growth: int = FILE_GROWTH) -> bool:
    """Is the frame surely below `limit` once built?

    The estimate follows the bytes of the scanned files; `growth` bounds how far the frame may
    exceed them, which the estimate does not know when rows are generated.
    """
    size = estimated_bytes(df)
    return size is not None and size * growth <= limit


def salted_left_join(left: DataFrame, right: DataFrame, on: Sequence[str], salts: int | None = None) -> DataFrame:
    """Shuffle join that spreads one hot key over `salts` tasks, for sessions without adaptive execution.

    The salt is a hash of the row, so a retried task picks the same one. By default there are as
    many salts as a shuffle has partitions, so the spread follows the cluster.
    """
    salts = salts or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    row_hash = F.xxhash64(*[F.col(c) for c in left.columns])
    left = left.withColumn("_salt", F.pmod(row_hash, F.lit(salts)).cast("int"))
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], "left").drop("_salt")


def lookup_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], limit: int = BROADCAST_BYTES, growth: int = FILE_GROWTH
) -> DataFrame:
    """Left join to a lookup of unknown size: broadcast below `limit`, shuffle beyond.

    The estimate of a frame that is derived from the facts grows with them and says little, so where it is too large the lookup is written
    once and its files decide. Beyond the limit adaptive execution splits hot keys; without it they are salted.
    """
    if not fits_broadcast(right, limit, growth):
        right = materialise(right, "lookup")
        if not fits_broadcast(right, limit):
            adaptive = left.sparkSession.conf.get("spark.sql.adaptive.enabled") == "true" and left.sparkSession.conf.get("spark.sql.adaptive.skewJoin.enabled") == "true"
            return left.join(right, list(on), "left") if adaptive else salted_left_join(left, right, on)
    return left.join(F.broadcast(right), list(on), "left")


def frequent_hashes(df: DataFrame, on: Sequence[str], support: float) -> list[int]:
    """Hashes of all keys that more than `support` of the rows have, by a frequency sketch in one pass over the key columns.

    The sketch misses no such key; it may add a few others, and holds at most about 1 / support of them.
    """
    hashed = df.select(F.xxhash64(*on).alias("_h"))
    return list(hashed.stat.freqItems(["_h"], support).first()[0] or [])


def hybrid_left_join(left: DataFrame, right: DataFrame, on: Sequence[str], limit: int | None = None, growth: int = FILE_GROWTH) -> DataFrame:
    """Left join to a table of one row per key, hot keys apart.

    A table below `limit` is broadcast. Beyond it, the keys that a frequency sketch finds hot on the left side meet their few right rows by
    broadcast, and the others by a shuffle. Hot rows, and rows with a NULL in their key, pass that shuffle under a salt that no right row has,
    so they spread over all tasks and match nothing there. The left side is read once for the sketch, key columns only, and once for the join.
    """
    limit = BROADCAST_BYTES if limit is None else limit
    if not fits_broadcast(right, limit, growth):
        # The salt of right rows is written with them: a constant that the optimiser sees would be no join key.
        right = materialise(right.withColumn("_salt", F.lit(0).cast("long")), "lookup")
        if not fits_broadcast(right, limit):
            return _hot_apart(left, right, list(on))
        right = right.drop("_salt")
    return left.join(F.broadcast(right), list(on), "left")


def _hot_apart(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    partitions = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A key is hot from a quarter of an average partition on; freqItems takes no support of 0.0001 or less.
    hot = frequent_hashes(left, on, max(1.01e-4, 1 / (4 * partitions)))
    values = [c for c in right.columns if c not in (*on, "_salt")]
    packed = right.select(*on, "_salt", F.struct(F.lit(True).alias("_is"), *values).alias("_v"))
    # As many rows as the sketch has keys, at most about four a partition.
    few = packed.filter(F.xxhash64(*on).isin(hot)).drop("_salt").withColumnRenamed("_v", "_hot")
    out = left.join(F.broadcast(few), on, "left")
    apart = F.col("_hot").isNotNull()
    for c in on:
        apart = apart | F.col(c).isNull()
    hashed = [c for c, t in left.dtypes if "map<" not in t and t != "variant"]  # maps have no hash
    spread = F.when(apart, F.xxhash64(*hashed).bitwiseOR(F.lit(1))).otherwise(0)  # never 0 where apart
    out = out.withColumn("_salt", spread.cast("long")).join(packed, [*on, "_salt"], "left")
    found = F.coalesce("_hot", "_v")
    return out.select(*left.columns, *[found[c].alias(c) for c in values])


def first_row_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the lowest in `order`, then in the other columns; a value comes before NULL.

    A whole-row minimum keeps it a partial aggregation.
    """
    rest = [c for c in df.columns if c not in keys]
    lead = [c for c in order if c in rest]
    ranked = [*lead, *[c for c in rest if c not in lead]]
    packed = F.struct(*[x for c in ranked for x in (F.col(c).isNull().alias(f"_null_{c}"), F.col(c))])
    return df.groupBy(*keys).agg(F.min(packed).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def newest_row_per_key(df: DataFrame, keys: Sequence[str], newest: Column) -> DataFrame:
    """One row per key, the one with the greatest `newest`; at equality the lowest, a value before NULL."""
    rest = [c for c in df.columns if c not in keys]
    dated = df.withColumn("_at", newest)
    latest = dated.groupBy(*keys).agg(F.max("_at").alias("_last"))
    same = F.struct(*keys)
    kept = dated.join(latest.withColumnsRenamed({k: f"_{k}" for k in keys}), (same == F.struct(*[f"_{k}" for k in keys])) & F.col("_at").eqNullSafe(F.col("_last")))
    return first_row_per_key(kept.select(*keys, *rest), keys, [])


def join_both_sides(
    games: DataFrame,
    dim: DataFrame,
    keys: Sequence[str],
    entity: str,
    values: dict[str, str],
    sides: dict[str, str] | None = None,
    per_day: bool = False,
    hot_apart: bool = False,
) -> DataFrame:
    """Left-join a per-entity table once for each side of the match.

    `values` maps dimension columns to output prefixes: {'hca': 'hca'} gives hca_a and hca_b.
    `sides` maps the suffix to the match column holding that side's entity. A `per_day` table has
    the match day in its key and may be as large as the matches: it takes a plain join, which
    adaptive execution broadcasts when the measured size allows, and splits where an entity's day is hot.
    With `hot_apart` the key may hold a large share of all matches, as with snapshots that stay in force for long: see `hybrid_left_join`.
    """
    sides = sides or {"a": "team_a", "b": "team_b"}
    out = games
    for suffix, side in sides.items():
        right = dim.select(
            *[F.col(k) for k in keys],
            F.col(entity).alias(side),
            *[F.col(c).alias(f"{name}_{suffix}") for c, name in values.items()],
        )
        on = [*keys, side]
        out = out.join(right, on, "left") if per_day else hybrid_left_join(out, right, on) if hot_apart else lookup_join(out, right, on)
    return out


def map_lookup(df: DataFrame, source: str, mapping: DataFrame, raw: str, canonical: str, target: str) -> DataFrame:
    """Add `target`: the canonical value of `source` under a two-column mapping, NULL when unmapped. Rows without a target map nothing."""
    right = first_row_per_key(mapping.filter(F.col(canonical).isNotNull()).select(F.col(raw).alias(source), F.col(canonical).alias(target)), [source], [target])
    return lookup_join(df, right, [source])


def unmapped(names: DataFrame, mapping: DataFrame, name: str, raw: str, canonical: str = "canonical_name") -> DataFrame:
    """Distinct names without a mapping; a row without a target is none."""
    mapping = mapping.filter(F.col(canonical).isNotNull())
    return names.select(name).distinct().join(mapping.select(F.col(raw).alias(name)).distinct(), [name], "left_anti")


def matched(rows: DataFrame, mapping: DataFrame, name: str, raw: str, canonical: str = "canonical_name") -> DataFrame:
    """Rows whose name has a mapping with a target."""
    hit = mapping.filter(F.col(canonical).isNotNull()).select(F.col(raw).alias(name)).distinct().withColumn("_hit", F.lit(True))
    return lookup_join(rows, hit, [name]).filter("_hit").drop("_hit")


def full_outer_merge(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Full outer join of two statistics tables on their shared key."""
    return left.join(right, list(on), "full")


def schema_diff(spark, left: DataFrame, right: DataFrame) -> DataFrame:
    """Columns that only one of two frames has, as (column_name, status)."""
    names = "column_name string"
    a = spark.createDataFrame([(c,) for c in left.columns], names)
    b = spark.createDataFrame([(c,) for c in right.columns], names)
    missing = a.join(b, "column_name", "left_anti").withColumn("status", F.lit("missing"))
    extra = b.join(a, "column_name", "left_anti").withColumn("status", F.lit("extra"))
    return missing.unionByName(extra)


def latest_row_per_key(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """One row per key by an explicit order; the rank limit is applied before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
