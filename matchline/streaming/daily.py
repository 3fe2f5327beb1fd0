"""The daily scoring on files that keep landing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.odds import BOOKMAKERS

ODDS_SCHEMA = f"id string, commence_time timestamp, home_team string, away_team string, bookmakers {BOOKMAKERS}"


def odds_stream(spark: SparkSession, folder: str, delay: str = "1 day") -> DataFrame:
    """Odds documents as they land, one per match id that arrives within `delay`.

    The event time is the arrival (the file's modification time): a document for a far match says nothing about nearer ones, so the match
    time must not move the watermark. A file that arrives with an older time than the watermark would be refused, so files are written
    before they are moved into the folder, not copied with an old time.
    """
    rows = spark.readStream.schema(ODDS_SCHEMA).json(folder).withColumn("arrived", F.col("_metadata.file_modification_time"))
    return rows.withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["id"])


def start_daily_picks(
    stream: DataFrame, score: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, **trigger
):
    """Score each micro-batch with the batch code and write its picks.

    The batch id is a partition, so a replayed batch replaces its own output.
    """

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        out = score(batch).withColumn("batch_id", F.lit(batch_id))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(sink)

    writer = stream.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
