"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_by_season(df: DataFrame, path: str, season: str = "season", order: tuple[str, ...] = ("date", "team_a")) -> None:
    """Parquet partitioned by season, ordered inside each file.

    Range partitioning on (season, order) splits a large season over many tasks and keeps the
    files of one season in order.
    """
    keys = [season, *order]
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").partitionBy(season).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A report table as CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_quarantine(df: DataFrame, path: str, code: str = "quarantine_reason_code") -> None:
    """Rejected rows, one folder per reason code."""
    df.write.mode("overwrite").partitionBy(code).parquet(path)


def write_predictions(df: DataFrame, path: str, date: str = "pred_date") -> None:
    """Predictions, one folder per day; writing a day again replaces only that day."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date).parquet(path)
