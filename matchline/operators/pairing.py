"""Pairing of two-sided rows: both views of a match become one row, everything else is quarantined."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..sources.scratch import materialise
from .joins import lookup_join, map_lookup

_SIDE = ["team_id", "opponent_team_id", "team_name", "team_norm", "location", "game", "team_score", "opp_score",
         "spread", "total", "ats", "ou"]


def keyed_rows(rows: DataFrame, opponent_ids: DataFrame) -> DataFrame:
    """Cleaned rows with opponent_team_id, the order-free game_key and, if unusable, a reject reason.

    `opponent_ids` holds (opponent, opponent_team_id).
    """
    df = map_lookup(rows, "opponent", opponent_ids, "opponent", "opponent_team_id", "opponent_team_id")
    code = F.when(F.col("date_parsed").isNull(), "bad_date").when(F.col("opponent_team_id").isNull(), "unmapped")
    return df.withColumns(
        {"game_key": X.match_key("date_parsed", "team_id", "opponent_team_id"), "quarantine_reason_code": code}
    )


def venue_first(loc1: Column, loc2: Column, name1: Column, name2: Column) -> Column:
    """Which of two rows is side A: 1 or 2, NULL when the venues do not fit together.

    The home row leads; on neutral ground the smaller normalised name does.
    """
    neutral = (loc1 == "Neutral") & (loc2 == "Neutral")
    return (
        F.when((loc1 == "Home") & (loc2 == "Away"), 1)
        .when((loc1 == "Away") & (loc2 == "Home"), 2)
        .when(neutral & (name1 < name2), 1)
        .when(neutral, 2)
    )


def judged_keys(keyed: DataFrame) -> DataFrame:
    """One row per game_key with its row count, its two rows and a verdict. Rows without a key are left out.

    With two rows, the minimum and the maximum of the packed row are exactly those rows. Both are
    partial aggregates of fixed size, so a key with any number of rows stays cheap.
    """
    pack = F.struct(*_SIDE)
    pairs = (
        keyed.filter(F.col("game_key").isNotNull())
        .groupBy("game_key", "date_parsed")
        .agg(F.count("*").alias("_n"), F.min(pack).alias("_r1"), F.max(pack).alias("_r2"))
    )
    r1, r2 = F.col("_r1"), F.col("_r2")
    swapped = (r1["opponent_team_id"] == r2["team_id"]) & (r2["opponent_team_id"] == r1["team_id"])
    pairs = pairs.withColumn("_first", venue_first(r1["location"], r2["location"], r1["team_norm"], r2["team_norm"]))
    code = (
        F.when(F.col("_n") != 2, "row_count")
        .when(~swapped, "id_mismatch")
        .when(F.col("_first").isNull(), "venue")
    )
    reason = (
        F.when(F.col("_n") != 2, F.concat(F.lit("expected 2 rows, got "), F.col("_n").cast("string")))
        .when(~swapped, "opponent team_id mismatch")
        .when(
            F.col("_first").isNull(),
            F.concat(
                F.lit("unexpected location combo: "),
                F.coalesce(r1["location"], F.lit("None")),
                F.lit("/"),
                F.coalesce(r2["location"], F.lit("None")),
            ),
        )
    )
    return pairs.withColumns({"_code": code, "_reason": reason})


def _games(judged: DataFrame) -> DataFrame:
    good = judged.filter(F.col("_code").isNull())
    first = F.col("_first") == 1
    a = F.when(first, F.col("_r1")).otherwise(F.col("_r2"))
    b = F.when(first, F.col("_r2")).otherwise(F.col("_r1"))
    good = good.withColumns({"_a": a, "_b": b})
    ca, cb = F.col("_a"), F.col("_b")
    neutral = ca["location"] == "Neutral"
    df = good.select(
        "game_key",
        X.season_label("date_parsed").alias("season"),
        F.col("date_parsed").alias("date"),
        ca["game"].alias("game_type"),
        ca["team_name"].alias("team_a"),
        cb["team_name"].alias("team_b"),
        ca["team_id"].alias("team_a_id"),
        cb["team_id"].alias("team_b_id"),
        F.when(~neutral, ca["team_name"]).alias("home_team"),
        F.when(~neutral, cb["team_name"]).alias("away_team"),
        neutral.alias("is_neutral"),
        ca["team_score"].alias("points_a"),
        cb["team_score"].alias("points_b"),
        ca["spread"].alias("spread_a"),
        ca["total"].alias("total_line"),
        ca["ats"].alias("ats_a_raw"),
        cb["ats"].alias("ats_b_raw"),
        ca["ou"].alias("ou_raw"),
    )
    return labelled(df)


def labelled(games: DataFrame) -> DataFrame:
    """Margin, total and the three labels. Missing scores or lines give NULL labels."""
    games = games.withColumns(
        {
            "final_margin_a": F.col("points_a") - F.col("points_b"),
            "game_total": F.col("points_a") + F.col("points_b"),
        }
    )
    return games.withColumns(
        {
            "cover_a": X.label_cover("final_margin_a", "spread_a"),
            "win_a": X.label_win("final_margin_a"),
            "over": X.label_over("game_total", "total_line"),
        }
    )


@dataclass(frozen=True)
class Pairing:
    """Result of one pairing job: both tables, and the row counts observed while they were written."""

    games: DataFrame
    rejects: DataFrame
    counts: dict[str, int]

    def conserved(self) -> bool:
        """Every row that came in is in exactly one place."""
        c = self.counts
        return c["rows_in"] == 2 * c["games"] + c["bad_date"] + c["unmapped"] + c["row_count"] + c["id_mismatch"] + c["venue"]

    def rate(self) -> DataFrame:
        """One row: input rows, games, quarantined rows and the share of rows paired, from the observed counts alone."""
        rows_in, games = self.counts["rows_in"], self.counts["games"]
        row = (rows_in, games, rows_in - 2 * games, 2.0 * games / rows_in if rows_in else None)
        return self.games.sparkSession.createDataFrame([row], "rows_in long, games_out long, rows_quarantined long, pairing_rate double")


def pair_landed(rows: DataFrame, opponent_ids: DataFrame) -> Pairing:
    """Pair cleaned two-sided rows; reject reasons as in `pair_two_sided_rows`.

    One job over the rows writes one row per key with its verdict, and the counts of rows that came and went ride along with it. Games read that table
    alone. Rejected rows, few as they are, are looked up in the input by the keys of that table when they are asked for, with the columns asked for.
    """
    came, judged = Observation(), Observation()
    code = lambda c, v: F.count(F.when(F.col(c) == v, 1)).alias(v)
    early = ("bad_date", "unmapped")
    keyed = keyed_rows(rows, opponent_ids)
    counted = keyed.observe(came, F.count(F.lit(1)).alias("rows_in"), *[code("quarantine_reason_code", v) for v in early])
    of_code = lambda v: F.coalesce(F.sum(F.when(F.col("_code") == v, F.col("_n"))), F.lit(0)).alias(v)
    pairs = judged_keys(counted).observe(judged, F.count(F.when(F.col("_code").isNull(), 1)).alias("games"), *[of_code(v) for v in ("row_count", "id_mismatch", "venue")])
    pairs = materialise(pairs, "judged")
    bad = pairs.filter(F.col("_code").isNotNull()).select("game_key", "_code", "_reason")
    reason = F.when(F.col("quarantine_reason_code") == "bad_date", "unparseable date").when(
        F.col("quarantine_reason_code") == "unmapped", "could not map opponent to team_id"
    )
    rejected = (
        lookup_join(keyed, bad, ["game_key"])
        .withColumns(
            {
                "quarantine_reason": F.coalesce(reason, F.col("_reason")),
                "quarantine_reason_code": F.coalesce("quarantine_reason_code", "_code"),
            }
        )
        .filter(F.col("quarantine_reason").isNotNull())
        .drop("_code", "_reason")
    )
    return Pairing(_games(pairs), rejected, {**came.get, **judged.get})


def pair_two_sided_rows(rows: DataFrame, opponent_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(games, quarantine) of cleaned two-sided rows; every input row ends up in exactly one of them.

    Reject reasons in order: unparseable date, unmapped opponent, row count, id mismatch, venues.
    """
    done = pair_landed(rows, opponent_ids)
    return done.games, done.rejects
