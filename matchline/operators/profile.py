"""Profiles and audits of landed rows and paired matches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from .evaluation import count_where


def file_profile(df: DataFrame, by: str = "file", date: str = "date_parsed") -> DataFrame:
    """Size, date range, distinct names and missing lines per file."""
    return df.groupBy(by).agg(
        F.count("*").alias("n_rows"),
        F.min(date).alias("min_date"),
        F.max(date).alias("max_date"),
        F.countDistinct("team_name").alias("unique_teams"),
        F.countDistinct("opponent").alias("unique_opponents"),
        count_where(F.col("spread").isNull()).alias("spread_missing"),
        count_where(F.col("total").isNull()).alias("total_missing"),
        count_where(~F.coalesce(F.col("result").isin("W", "L"), F.lit(False))).alias("result_other"),
    )


def value_counts(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Frequency of every non-null value of several columns, in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in names])
    long = df.select(F.inline(pairs)).filter(F.col("value").isNotNull())
    return long.groupBy("column_name", "value").agg(F.count("*").alias("n_rows"))


def line_convention_check(df: DataFrame) -> DataFrame:
    """Does margin + line > 0 agree with the recorded W or L?"""
    own = X.own_score("result", "winner_score", "loser_score")
    opp = X.opponent_score("result", "winner_score", "loser_score")
    beaten = (own - opp + F.col("spread")) > 0
    rows = df.filter(F.col("spread").isNotNull() & F.col("ats").isin("W", "L"))
    out = rows.agg(
        F.avg((F.coalesce(beaten, F.lit(False)) == (F.col("ats") == "W")).cast("double")).alias("match_rate"),
        F.count("*").alias("sample_size"),
    )
    text = F.when(
        F.col("match_rate") > 0.95, "spread is from team perspective (team + spread > 0 means cover)"
    ).otherwise("needs manual review")
    return out.withColumn("interpretation", text)


def label_validation(games: DataFrame) -> DataFrame:
    """Computed cover label against the recorded one on decided matches."""
    rows = games.filter(F.col("spread_a").isNotNull() & F.col("ats_a_raw").isin("W", "L"))
    same = F.coalesce(F.col("cover_a") == 1.0, F.lit(False)) == (F.col("ats_a_raw") == "W")
    return rows.agg(
        F.count("*").alias("sample_size"), F.avg(same.cast("double")).alias("match_rate"), count_where(~same).alias("mismatches")
    )


def season_audit(games: DataFrame, quarantine: DataFrame | None = None) -> DataFrame:
    """Audit row per season; quarantined rows are counted by the season of their date.

    Seasons with quarantined rows only have a row too, and so have rows without a date, under the season NULL: twice the matches and the
    quarantined rows add up to the rows that came in.
    """
    line, cover = F.col("spread_a").isNotNull(), F.col("cover_a")
    wins, losses = count_where(line & (cover == 1.0)), count_where(line & (cover == 0.0))
    out = games.groupBy("season").agg(
        F.count("*").alias("total_games"),
        count_where(line).alias("games_with_spread"),
        count_where(~line).alias("games_without_spread"),
        wins.alias("cover_a_wins"),
        losses.alias("cover_a_losses"),
        count_where(line & (cover == 0.5)).alias("pushes"),
        F.avg(F.when(line & cover.isin(0.0, 1.0), cover)).alias("cover_rate"),
    )
    if quarantine is None:
        return out.withColumn("quarantine_rows", F.lit(0).cast("bigint"))
    q = quarantine.groupBy(X.season_label("date_parsed").alias("season")).agg(F.count("*").alias("quarantine_rows"))
    counts = [c for c, t in out.dtypes if t == "bigint"]
    joined = out.join(q.withColumnRenamed("season", "_season"), F.col("season").eqNullSafe(F.col("_season")), "full")
    joined = joined.withColumn("season", F.coalesce("season", "_season")).drop("_season")
    return joined.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in [*counts, "quarantine_rows"]})


def pairing_rate(n_input: DataFrame, games: DataFrame, quarantine: DataFrame) -> DataFrame:
    """One row: input rows, games, quarantined rows and the share of rows paired."""
    one = F.lit(1).alias("_one")
    total = n_input.agg(F.count("*").alias("rows_in")).select("*", one)
    paired = games.agg(F.count("*").alias("games_out")).select("*", one)
    out = quarantine.agg(F.count("*").alias("rows_quarantined")).select("*", one)
    joined = total.join(paired, "_one").join(out, "_one").drop("_one")
    return joined.withColumn(
        "pairing_rate", F.try_divide(F.col("games_out") * F.lit(2.0), F.col("rows_in").cast("double"))
    )


def distinct_entities(games: DataFrame, sides: Sequence[str] = ("team_a", "team_b")) -> DataFrame:
    """Distinct entities over both sides."""
    return games.select(F.explode(F.array(*[F.col(s) for s in sides])).alias("entity")).distinct()


def match_coverage(features: DataFrame) -> DataFrame:
    """How many matches have ratings and a line."""
    out = features.agg(
        F.count("*").alias("total_games"),
        count_where(F.col("kp_matched")).alias("matched"),
        count_where(F.col("spread_a").isNotNull()).alias("with_line"),
    )
    n = F.col("total_games").cast("double")
    return out.withColumns({"matched_pct": F.col("matched") * 100 / n, "with_line_pct": F.col("with_line") * 100 / n})


def sample_rows(df: DataFrame, key: str, n: int = 10, seed: int = 42) -> DataFrame:
    """A repeatable sample: the n rows with the smallest digest of key and seed (top-k, no full sort)."""
    digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    return df.withColumn("_d", digest).orderBy("_d", key).limit(n).drop("_d")
