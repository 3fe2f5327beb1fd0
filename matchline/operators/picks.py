"""Picks of the day and the tables behind the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import fixed


def signed_line(c: Column) -> Column:
    """+3.5 / -3.0 text, ties of the first decimal to even."""
    return F.format_string("%+.1f", F.when(c == 0, c).otherwise(F.bround(c, 1)))


def stars(edge: Column) -> Column:
    """One star per two points of edge, three at most."""
    return F.repeat(F.lit("*"), F.least(F.floor(F.abs(edge) / 2), F.lit(3)).cast("int"))


def daily_picks(
    df: DataFrame, pred: str = "pred_margin", line: str = "spread_home", threshold: float = fixed.DEFAULT_THRESHOLD,
    actionable: Column | None = None,
) -> DataFrame:
    """Prediction rows: edge, pick text, confidence stars and the actionable flag.

    Without a mask from a calibrated strategy the threshold decides. Pick text in order: NO LINE,
    NO DATA, SKIP, then the backed side with its line.
    """
    spread = X.null_if_nan(F.col(line).cast("double"))
    edge = X.null_if_nan((F.col(pred) + spread).cast("double"))
    mask = F.abs(edge) >= F.lit(float(threshold)) if actionable is None else actionable
    df = df.withColumns({"_line": spread, "edge": edge, "is_actionable": F.coalesce(mask, F.lit(False))})
    e, s = F.col("edge"), F.col("_line")
    blocked = (
        F.when(s.isNull(), "NO LINE")
        .when(F.col("home_kp").isNull() | F.col("away_kp").isNull() | e.isNull(), "NO DATA")
        .when(~F.col("is_actionable"), "SKIP")
    )
    side = F.when(e > 0, F.concat(F.col("home_team"), F.lit(" "), signed_line(s))).otherwise(
        F.concat(F.col("away_team"), F.lit(" "), signed_line(-s))
    )
    df = df.withColumn("_blocked", blocked)
    df = df.withColumns(
        {
            "pick": F.coalesce("_blocked", side),
            "confidence": F.when(F.col("_blocked").isNull(), stars(e)).otherwise(""),
        }
    )
    return df.drop("_blocked", "_line")


def _actionable(df: DataFrame, threshold: float) -> Column:
    if "is_actionable" in df.columns:
        return F.coalesce(F.col("is_actionable"), F.lit(False))
    return F.coalesce(F.abs(F.col("edge")) >= F.lit(float(threshold)), F.lit(False))


def top_k_with_ties(df: DataFrame, k: int = 5, threshold: float = fixed.DEFAULT_THRESHOLD) -> DataFrame:
    """The k largest |edge| among actionable rows, all ties at the cut kept."""
    rows = df.filter(_actionable(df, threshold) & F.col("edge").isNotNull()).withColumn("abs_edge", F.abs("edge"))
    cut = rows.select("abs_edge").orderBy(F.desc("abs_edge")).limit(k).agg(F.min("abs_edge").alias("_cut"))
    # One row, so the nested-loop broadcast is a filter by a scalar.
    return rows.join(F.broadcast(cut), F.col("abs_edge") >= F.col("_cut"), "inner").drop("_cut")


def picks_sorted(df: DataFrame, threshold: float = fixed.DEFAULT_THRESHOLD) -> DataFrame:
    """Actionable rows, strongest edge first."""
    rows = df.filter(_actionable(df, threshold)).withColumn("abs_edge", F.abs("edge"))
    return rows.orderBy(F.desc("abs_edge"))


def all_games_table(df: DataFrame, threshold: float = fixed.DEFAULT_THRESHOLD) -> DataFrame:
    """Every match with display texts and the highlight flag."""
    text = lambda c, f: F.coalesce(F.format_string(f, F.col(c)), F.lit("N/A"))
    shown = lambda c, f: F.when(F.col(c).isNotNull(), text(c, f)).otherwise("N/A")
    return df.select(
        "away_team", "home_team", shown("spread_home", "%+.1f").alias("spread_text"),
        shown("pred_margin", "%.1f").alias("margin_text"), shown("edge", "%+.1f").alias("edge_text"),
        "pick", _actionable(df, threshold).alias("highlight"),
    )


def picks_summary(df: DataFrame, threshold: float = fixed.DEFAULT_THRESHOLD) -> DataFrame:
    hit = F.when(_actionable(df, threshold), 1).otherwise(0)
    return df.agg(F.count("*").alias("total_games"), F.coalesce(F.sum(hit), F.lit(0)).cast("bigint").alias("actionable_picks"))


def read_latest_date(df: DataFrame, date: str = "pred_date", target: str | None = None) -> DataFrame:
    """Rows of the given date, or of the newest one."""
    if target is not None:
        return df.filter(F.col(date) == F.lit(target).cast("date"))
    newest = df.agg(F.max(date).alias(date))
    return df.join(F.broadcast(newest), [date], "left_semi")


def read_last_dates(df: DataFrame, n: int = 7, date: str = "pred_date") -> DataFrame:
    """Rows of the n newest dates."""
    dates = df.select(date).distinct().orderBy(F.desc(date)).limit(n)
    return df.join(F.broadcast(dates), [date], "left_semi")
