"""State tables that follow landing files: the newest rating and the history of every entity.

A micro-batch reads the table of the batch before it and writes its own version, named by the batch id. So a replayed batch writes what it wrote before, and a
lost run leaves the older version as it was. Batches may come in any order of dates: ratings keep the newest row, and histories are merged where a batch goes
on from the state, or made anew from the landed matches of the few entities for which it does not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import history, joins, prefix_scan

MEASURES = ["margin", "points"]


def _version(spark: SparkSession, path: str, before: int | None, newest_only: bool) -> DataFrame | None:
    """Rows of the versions below `before` (all without it), or of the newest of them."""
    try:
        rows = spark.read.parquet(path)
    except AnalysisException as e:
        if (e.getCondition() or "") != "PATH_NOT_FOUND":
            raise
        return None
    if before is not None:
        rows = rows.filter(F.col("batch_id") < before)
    if not newest_only:
        return rows.drop("batch_id")
    # The partition column alone answers this; no file is opened.
    last = rows.agg(F.max("batch_id")).first()[0]
    return None if last is None else rows.filter(F.col("batch_id") == last).drop("batch_id")


def _write(rows: DataFrame, path: str, batch_id: int) -> DataFrame:
    rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/batch_id={batch_id}")


def update_ratings(batch: DataFrame, batch_id: int, path: str, entity: str = "TeamName", at: str = "snapshot_date") -> DataFrame:
    """The newest row of each entity after this batch; at equal dates the lowest row, a value before NULL."""
    old = _version(batch.sparkSession, path, batch_id, True)
    rows = batch if old is None else old.unionByName(batch.select(*old.columns))
    return _write(joins.newest_row_per_key(rows, [entity], F.col(at)), path, batch_id)


def update_history(
    batch: DataFrame, batch_id: int, path: str, window: int = fixed.ROLLING_WINDOW, half_life: float = fixed.HALF_LIFE
) -> DataFrame:
    """The history state of each entity after this batch of games; a game_key that landed before counts once."""
    spark = batch.sparkSession
    landed = _version(spark, f"{path}/games", batch_id, False)
    new = joins.first_row_per_key(batch, ["game_key"], [])
    if landed is not None:
        new = new.select(*landed.columns).join(landed.select("game_key"), "game_key", "left_anti").select(*landed.columns)
    new = _write(new, f"{path}/games", batch_id)
    states = lambda games: prefix_scan.entity_states(history.unpivot_sides(games), MEASURES, window, half_life)
    fresh = states(new)
    old = _version(spark, f"{path}/state", batch_id, True)
    if old is None:
        return _write(fresh, f"{path}/state", batch_id)
    pack = lambda df, name: df.select("entity", F.struct(*fresh.columns).alias(name))
    both = pack(old, "_a").join(pack(fresh, "_b"), "entity", "full")
    a, b = F.col("_a"), F.col("_b")
    goes_on = F.struct(b["first"]["date"], b["first"]["game_key"]) > F.struct(a["last"]["date"], a["last"]["game_key"])
    late = a.isNotNull() & b.isNotNull() & ~goes_on
    kept = both.filter(~late).select(F.when(a.isNull(), b).when(b.isNull(), a).otherwise(prefix_scan.merged(a, b, MEASURES, window, half_life)).alias("_s")).select("_s.*")
    again = both.filter(late).select("entity")
    rows = history.unpivot_sides(landed.unionByName(new)).join(again, "entity", "left_semi")
    rebuilt = prefix_scan.entity_states(rows, MEASURES, window, half_life)
    return _write(kept.unionByName(rebuilt), f"{path}/state", batch_id)


def history_now(state: DataFrame, match_date: str | Column | None = None, min_periods: int = fixed.MIN_PERIODS) -> DataFrame:
    """Features of each entity's next match from its state: rolling_rate, ew_margin, ew_points, last_date, and rest_days up to `match_date`."""
    n = F.size("results")
    rate = F.when(n >= min_periods, F.aggregate("results", F.lit(0.0), lambda acc, v: acc + v) / n).otherwise(0.5)
    means = [F.when(F.col(m)["k"] >= min_periods, F.col(m)["s"] / F.col(m)["w"]).alias(f"ew_{m}") for m in MEASURES]
    out = state.select("entity", F.col("last.date").alias("last_date"), rate.alias("rolling_rate"), *means)
    if match_date is None:
        return out
    day = F.lit(match_date).cast("date") if isinstance(match_date, str) else match_date
    return out.withColumn("rest_days", F.least(F.datediff(day, "last_date"), F.lit(fixed.REST_CAP)))


def start_state(stream: DataFrame, update, path: str, checkpoint: str, **trigger):
    """Run `update_ratings` or `update_history` on every micro-batch of a stream."""
    writer = stream.writeStream.foreachBatch(lambda batch, batch_id: update(batch, batch_id, path) and None)
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest version of a state table."""
    return _version(spark, path, None, True)
