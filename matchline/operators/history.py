"""Features from an entity's own past: gap, rolling rate and exponentially weighted means.

A match is seen from both sides, so each entity has one row per match. The features hold one
value per (entity, day), taken before the day's first match. They come from a prefix scan over
rows dealt by ranges of (entity, date, match key), so neither an entity nor one of its days,
however many matches it has, is ordered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import fixed
from . import prefix_scan
from .joins import join_both_sides


def unpivot_sides(
    games: DataFrame, date: str = "date", key: str = "game_key", cover: str = "cover_a", margin: str = "final_margin_a"
) -> DataFrame:
    """Two rows per match, one from each side, with cover and margin seen from that side."""
    c = F.col
    have = set(games.columns)
    side_a = [F.lit("a").alias("side"), c("team_a").alias("entity")]
    side_b = [F.lit("b").alias("side"), c("team_b").alias("entity")]
    if cover in have:
        side_a.append(c(cover).cast("double").alias("cover"))
        side_b.append((F.lit(1.0) - c(cover)).alias("cover"))
    if margin in have:
        side_a.append(c(margin).cast("double").alias("margin"))
        side_b.append((-c(margin).cast("double")).alias("margin"))
    if {"points_a", "points_b"} <= have:
        side_a.append(c("points_a").cast("double").alias("points"))
        side_b.append(c("points_b").cast("double").alias("points"))
    rows = games.select(
        c(key).alias("game_key"), c(date).cast("date").alias("date"), F.inline(F.array(F.struct(*side_a), F.struct(*side_b)))
    )
    return rows.filter(c("date").isNotNull() & c("entity").isNotNull())


def _before(w: Window) -> Window:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def _rest_days(previous: Column) -> Column:
    return F.least(F.coalesce(F.datediff("date", previous), F.lit(fixed.REST_DEFAULT)), F.lit(fixed.REST_CAP))


def entity_day_history(
    games: DataFrame,
    parts: Sequence[str] = ("rest", "rolling", "ew"),
    date: str = "date",
    window: int = fixed.ROLLING_WINDOW,
    half_life: float = fixed.HALF_LIFE,
    min_periods: int = fixed.MIN_PERIODS,
    compat: bool = False,
) -> DataFrame:
    """History features per (entity, date), all parts from one pass.

    rest: rest_days. rolling: rolling_rate. ew: ew_margin and ew_points. With `compat` the rolling
    rate exists only on days with a decided match, else it is 0.5.
    """
    rows = unpivot_sides(games, date)
    if not {"rolling", "ew"} & set(parts):
        days = rows.select("entity", "date").distinct()
        previous = F.lag("date").over(Window.partitionBy("entity").orderBy("date"))
        return days.withColumn("rest_days", _rest_days(previous))
    measures = ["margin", "points"] if "ew" in parts else []
    rows = rows.withColumns({c: F.lit(None).cast("double") for c in ("cover", *measures) if c not in rows.columns})
    days = prefix_scan.states_before_days(rows, measures, window, half_life, min_periods)
    names = ["entity", "date"]
    if "rest" in parts:
        days = days.withColumn("rest_days", _rest_days(F.col("previous")))
        names.append("rest_days")
    if "rolling" in parts:
        rate = F.when(F.col("n_results") >= min_periods, F.col("hits") / F.col("n_results"))
        if compat:
            rate = F.when(F.col("has_result"), rate)
        days = days.withColumn("rolling_rate", F.coalesce(rate, F.lit(0.5)))
        names.append("rolling_rate")
    return days.select(*names, *[f"ew_{m}" for m in measures])


def feature_join_back(games: DataFrame, days: DataFrame, values: dict[str, str], date: str = "date") -> DataFrame:
    """Attach per-(entity, date) features to both sides of each match."""
    days = days if date == "date" else days.withColumnRenamed("date", date)
    return join_both_sides(games, days, [date], "entity", values, per_day=True)


def days_since_previous(games: DataFrame, date: str = "date") -> DataFrame:
    """rest_days_a/b, their difference and back-to-back flags."""
    days = entity_day_history(games, ("rest",), date)
    return rest_columns(feature_join_back(games, days, {"rest_days": "rest_days"}, date))


def rest_columns(df: DataFrame) -> DataFrame:
    default = F.lit(fixed.REST_DEFAULT)
    df = df.withColumns({f"rest_days_{s}": F.coalesce(f"rest_days_{s}", default) for s in "ab"})
    return df.withColumns(
        {
            "rest_diff": F.col("rest_days_a") - F.col("rest_days_b"),
            "b2b_a": (F.col("rest_days_a") == 1).cast("int"),
            "b2b_b": (F.col("rest_days_b") == 1).cast("int"),
        }
    )


def rolling_rate(games: DataFrame, date: str = "date", window: int = fixed.ROLLING_WINDOW, compat: bool = False) -> DataFrame:
    """rolling_ats_a/b and their difference."""
    days = entity_day_history(games, ("rolling",), date, window=window, compat=compat)
    return rolling_columns(feature_join_back(games, days, {"rolling_rate": "rolling_ats"}, date))


def rolling_columns(df: DataFrame) -> DataFrame:
    df = df.withColumns({f"rolling_ats_{s}": F.coalesce(f"rolling_ats_{s}", F.lit(0.5)) for s in "ab"})
    return df.withColumn("rolling_ats_diff", F.col("rolling_ats_a") - F.col("rolling_ats_b"))


def ew_mean(games: DataFrame, date: str = "date", half_life: float = fixed.HALF_LIFE) -> DataFrame:
    """ew_margin_a/b, ew_ppg_a/b and the margin difference."""
    days = entity_day_history(games, ("ew",), date, half_life=half_life)
    return ew_columns(feature_join_back(games, days, {"ew_margin": "ew_margin", "ew_points": "ew_ppg"}, date))


def ew_columns(df: DataFrame) -> DataFrame:
    return df.withColumn("ew_margin_diff", F.col("ew_margin_a") - F.col("ew_margin_b"))


def history_features(games: DataFrame, date: str = "date", compat: bool = False) -> DataFrame:
    """All history columns with one history pass and one join per side."""
    days = entity_day_history(games, date=date, compat=compat)
    values = {"rest_days": "rest_days", "rolling_rate": "rolling_ats", "ew_margin": "ew_margin", "ew_points": "ew_ppg"}
    return ew_columns(rolling_columns(rest_columns(feature_join_back(games, days, values, date))))


def with_global_position(df: DataFrame, date: str, key: str) -> DataFrame:
    """0-based place of each row in (date, md5(key), key) order, and the row count n_total.

    Counts per (day, first two digits of the digest) give offsets; rows are only ordered inside
    such a slice, so neither the whole table nor a hot day is ever sorted by one task.
    """
    digest = F.md5(F.col(key).cast("string"))
    rows = df.withColumns({"_gh": digest, "_gb": F.substring(digest, 1, 2)})
    slices = rows.groupBy(F.col(date).alias("_gday"), "_gb").agg(F.count("*").alias("_gn"))
    days = slices.groupBy("_gday").agg(F.sum("_gn").alias("_dn"))
    # One row per calendar day: the DATE domain bounds this window and the broadcast.
    order = Window.orderBy("_gday")
    days = days.select(
        "_gday",
        F.coalesce(F.sum("_dn").over(_before(order)), F.lit(0)).alias("_doff"),
        F.sum("_dn").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n_total"),
    )
    in_day = F.coalesce(F.sum("_gn").over(_before(Window.partitionBy("_gday").orderBy("_gb"))), F.lit(0))
    slices = slices.withColumn("_soff", in_day).join(F.broadcast(days), "_gday")
    slices = slices.select(F.col("_gday").alias(date), "_gb", (F.col("_doff") + F.col("_soff")).alias("_goff"), "n_total")
    place = F.row_number().over(Window.partitionBy(date, "_gb").orderBy("_gh", key))
    out = rows.withColumn("_grn", place).join(slices, [date, "_gb"])
    return out.withColumn("position", (F.col("_goff") + F.col("_grn") - 1).cast("bigint")).drop("_gh", "_gb", "_goff", "_grn")


def expanding_folds(df: DataFrame, n_splits: int = 5, date: str = "date", key: str = "game_key") -> DataFrame:
    """Add test_fold: the fold (1..n_splits) whose test block holds the row, 0 for the lead block.

    A fold trains on every row with a smaller test_fold.
    """
    pos = with_global_position(df, date, key)
    size = F.floor(F.col("n_total") / (n_splits + 1))
    start = F.col("n_total") - size * n_splits
    fold = F.when(F.col("position") < start, 0).otherwise(F.floor((F.col("position") - start) / size) + 1)
    return pos.withColumn("test_fold", fold.cast("int")).drop("n_total")


def fold_roles(df: DataFrame, n_splits: int = 5) -> DataFrame:
    """Rows per fold and role, from the test_fold counts."""
    counts = df.groupBy("test_fold").agg(F.count("*").alias("_n"), F.min("date").alias("_lo"), F.max("date").alias("_hi"))
    folds = F.sequence(F.lit(1), F.lit(n_splits))
    role = F.when(F.col("test_fold") == F.col("fold"), "test").when(F.col("test_fold") < F.col("fold"), "train")
    return (
        counts.select("*", F.explode(folds).alias("fold"))
        .withColumn("role", role)
        .filter(F.col("role").isNotNull())
        .groupBy("fold", "role")
        .agg(F.sum("_n").cast("bigint").alias("n_rows"), F.min("_lo").alias("first_date"), F.max("_hi").alias("last_date"))
    )


def first_per_group(df: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """First non-null value of each group by an explicit order."""
    return df.groupBy(*keys).agg(F.min_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias(value))
