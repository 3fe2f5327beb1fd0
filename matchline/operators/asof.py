"""As-of joins: the newest rating snapshot strictly before a match."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from .joins import first_row_per_key, join_both_sides, lookup_join


def snapshot_calendar(
    games: DataFrame, ratings: DataFrame, date: str = "date", snapshot: str = "snapshot_date", tolerance: int | None = fixed.TOLERANCE_DAYS
) -> DataFrame:
    """For every match day the snapshot in force and its tier.

    Both sides shrink to distinct calendar days before the ordered window, so the one task that
    runs it sees at most one row per day and side.
    """
    days = games.select(F.col(date).cast("date").alias("_day")).filter(F.col("_day").isNotNull()).distinct()
    snaps = ratings.select(F.col(snapshot).cast("date").alias("_day")).filter(F.col("_day").isNotNull()).distinct()
    line = days.select("_day", F.lit(0).alias("_kind")).unionByName(snaps.select("_day", F.lit(1).alias("_kind")))
    w = Window.orderBy("_day", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    latest = F.last(F.when(F.col("_kind") == 1, F.col("_day")), ignorenulls=True).over(w)
    out = line.withColumn("_snap", latest).filter("_kind = 0 and _snap is not null")
    age = F.datediff("_day", "_snap")
    if tolerance is not None:
        out = out.filter(age <= tolerance)
    tier = F.when(age <= fixed.RECENT_DAYS, "daily").otherwise("seasonal")
    return out.select(F.col("_day").alias(date), F.col("_snap").alias("kp_snapshot_date"), tier.alias("asof_tier"))


def asof_snapshot_join(
    games: DataFrame,
    ratings: DataFrame,
    values: dict[str, str],
    entity: str = "TeamName",
    date: str = "date",
    snapshot: str = "snapshot_date",
    tolerance: int | None = fixed.TOLERANCE_DAYS,
    require_both: bool = False,
    sides: dict[str, str] | None = None,
) -> DataFrame:
    """Rating columns of both sides from the snapshot in force on the match day.

    The snapshot is chosen per day, not per entity: an entity absent from it stays NULL. A snapshot
    that stays in force for long makes (snapshot, entity) a hot key, which the join keeps apart. With
    `require_both`, one missing side blanks the other. Adds kp_snapshot_date and asof_tier.
    """
    sides = sides or {"a": "team_a", "b": "team_b"}
    # At most one row per calendar day: the size of the DATE domain bounds this broadcast.
    calendar = snapshot_calendar(games, ratings, date, snapshot, tolerance)
    out = games.join(F.broadcast(calendar), [date], "left")
    rows = ratings.select(
        F.col(entity), F.col(snapshot).cast("date").alias("kp_snapshot_date"), *[F.col(c) for c in values]
    )
    rows = first_row_per_key(rows, [entity, "kp_snapshot_date"], list(values))
    if require_both:
        rows = rows.withColumn("_found", F.lit(True))
        values = {**values, "_found": "_found"}
    out = join_both_sides(out, rows, ["kp_snapshot_date"], entity, values, sides, hot_apart=True)
    if require_both:
        both = F.lit(True)
        for s in sides:
            both = both & F.coalesce(F.col(f"_found_{s}"), F.lit(False))
        names = [f"{v}_{s}" for v in values.values() if v != "_found" for s in sides]
        out = out.withColumn("kp_matched", both).withColumns({n: F.when(F.col("kp_matched"), F.col(n)) for n in names})
        out = out.drop(*[f"_found_{s}" for s in sides])
    return out


def lookup_unordered_snapshot(
    games: DataFrame, ratings: DataFrame, values: dict[str, str], order: Sequence[str], entity: str = "TeamName",
    sides: dict[str, str] | None = None,
) -> DataFrame:
    """Season-level ratings without a date condition: the first row of each entity. Flagged leaky."""
    first = first_row_per_key(ratings.select(entity, *dict.fromkeys([*order, *values])), [entity], order)
    out = join_both_sides(games, first, [], entity, values, sides)
    return out.withColumn("is_leaky", F.lit(True))


def asof_per_entity(
    events: DataFrame, ratings: DataFrame, values: Sequence[str], entity: str, date: str, snapshot: str
) -> DataFrame:
    """Newest snapshot of each entity strictly before the event day.

    Events shrink to distinct (entity, day) first, so a hot entity orders at most one row per
    calendar day and snapshot; the result joins back on the same pair.
    """
    days = events.select(entity, F.col(date).cast("date").alias("_day")).distinct()
    snaps = first_row_per_key(
        ratings.select(entity, F.col(snapshot).cast("date").alias("_day"), *values), [entity, "_day"], list(values)
    )
    pack = F.struct(F.col("_day").alias("_snap"), *values)
    both = days.select(entity, "_day", F.lit(0).alias("_kind"), F.lit(None).alias("_r")).unionByName(
        snaps.select(entity, "_day", F.lit(1).alias("_kind"), pack.alias("_r"))
    )
    w = Window.partitionBy(entity).orderBy("_day", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    state = both.withColumn("_r", F.last("_r", ignorenulls=True).over(w)).filter("_kind = 0")
    state = state.select(
        entity, F.col("_day").alias("_jday"), F.col("_r._snap").alias(snapshot), *[F.col(f"_r.{v}").alias(v) for v in values]
    )
    keyed = events.withColumn("_jday", F.col(date).cast("date"))
    return keyed.join(state, [entity, "_jday"], "left").drop("_jday")


def rating_differentials(df: DataFrame) -> DataFrame:
    """Derived rating columns of a match; a missing side leaves them NULL."""
    c = F.col
    return df.withColumns(
        {
            "kp_adj_em_diff": c("kp_adj_em_a") - c("kp_adj_em_b"),
            "kp_tempo_avg": (c("kp_tempo_a") + c("kp_tempo_b")) / 2,
            "kp_tempo_diff": c("kp_tempo_a") - c("kp_tempo_b"),
            "kp_o_vs_d_a": c("kp_adj_o_a") - c("kp_adj_d_b"),
            "kp_o_vs_d_b": c("kp_adj_o_b") - c("kp_adj_d_a"),
        }
    )


def expected_margin_raw(df: DataFrame) -> DataFrame:
    return df.withColumn("kp_pred_margin_raw", F.col("kp_adj_em_diff") * F.col("kp_tempo_avg") / 100)


def matched_flag(df: DataFrame) -> DataFrame:
    return df.withColumn("kp_matched", F.col("kp_adj_em_a").isNotNull() & F.col("kp_adj_em_b").isNotNull())


def rank_normalise(df: DataFrame, sides: Sequence[str] = ("a", "b")) -> DataFrame:
    """Replace raw ranks by their share of the ranked field: kp_rank_em_a and so on."""
    raw = {f"RankAdj{m}_{s}": f"kp_rank_{m.lower()}_{s}" for m in ("EM", "OE", "DE") for s in sides}
    raw = {k: v for k, v in raw.items() if k in df.columns}
    return df.withColumns({v: F.col(k) / fixed.RANKED_ENTITIES for k, v in raw.items()}).drop(*raw)
