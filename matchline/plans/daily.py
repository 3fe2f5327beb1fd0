"""Scoring of the day's matches: odds, names, features, predictions, picks. Same code for batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import fixed
from ..operators import asof, dims, evaluation, joins, models, names, odds, picks
from ..operators.calibration import Calibration, calibrated_bet_mask
from ..sources.scratch import materialise
from .features import RATING_VALUES


def resolve_sides(games: DataFrame, canonical: DataFrame, mapping: DataFrame) -> DataFrame:
    """Add home_kp and away_kp; the distinct names of both sides are resolved once, and both lookups read the written table."""
    both = games.select(F.explode(F.array("home_team", "away_team")).alias("raw_name")).distinct()
    table = materialise(names.resolve_by_overlap(both, canonical, mapping).select("raw_name", "canonical_name"), "sides")
    for side in ("home", "away"):
        right = table.select(F.col("raw_name").alias(f"{side}_team"), F.col("canonical_name").alias(f"{side}_kp"))
        games = joins.lookup_join(games, right, [f"{side}_team"])
    return games


def _newest(df: DataFrame, entity: str, values: list[str], at: str | None) -> DataFrame:
    """One row per entity, from its newest `at` (a date or a season); None for a table that is current as a whole."""
    if at is None:
        return joins.first_row_per_key(df.select(entity, *values), [entity], values)
    if at not in df.columns:
        raise ValueError(f"no column {at} to find the newest row by")
    when = X.season_number(at) if at == "season" else F.col(at)
    return joins.newest_row_per_key(df.select(entity, at, *values), [entity], when).drop(at)


def day_features(
    games: DataFrame, ratings: DataFrame, dimensions: dict[str, DataFrame], entity: str = "TeamName", *, rating_date: str | None, season: str | None = None
) -> DataFrame:
    """Features of unplayed matches from the latest ratings and dimensions, all at the home side's place.

    `rating_date` is the column that tells the newest rating of an entity, `season` the one of the four factors and heights; None says that a
    table holds the current rows only.
    """
    sides = {"a": "home_kp", "b": "away_kp"}
    values = {c: RATING_VALUES[c] for c in X.present(ratings, fixed.RATING_COLUMNS)}
    current = _newest(ratings, entity, list(values), rating_date)
    # Both sides read one written row per entity.
    current = materialise(current.withColumn("_known", F.lit(True)), "current")
    df = joins.join_both_sides(games, current, [], entity, {**values, "_known": "_known"}, sides)
    neutral = F.coalesce(F.col("is_neutral").cast("boolean"), F.lit(False)) if "is_neutral" in df.columns else F.lit(False)
    df = df.withColumns({"is_home_a": (~neutral).cast("int"), "is_neutral": neutral.cast("int")})
    df = asof.rating_differentials(df)
    if "four_factors" in dimensions:
        dim = _newest(dimensions["four_factors"], entity, X.present(dimensions["four_factors"], fixed.FOUR_FACTOR_COLUMNS), season)
        df = joins.join_both_sides(df, dim, [], entity, {c: f"ff_{c}" for c in dim.columns if c != entity}, sides)
    if "height_exp" in dimensions:
        dim = _newest(dimensions["height_exp"], entity, X.present(dimensions["height_exp"], fixed.HEIGHT_COLUMNS), season)
        df = joins.join_both_sides(df, dim, [], entity, {c: f"ht_{c}" for c in dim.columns if c != entity}, sides)
    if "hca" in dimensions:
        df = dims.dim_join_advantage(df, dimensions["hca"], entity, sides)
    else:
        df = df.withColumn("team_hca", F.col("is_home_a") * F.lit(fixed.VENUE_POINTS))
    df = dims.matchup_features(df, fill=0.0)
    known = F.coalesce(F.col("_known_a"), F.lit(False)) & F.coalesce(F.col("_known_b"), F.lit(False))
    # Without both ratings there is nothing to score: the names count as unresolved.
    df = df.withColumn("_both", known).withColumns(
        {c: F.when(F.col("_both"), F.col(c)) for c in ("home_kp", "away_kp")}
    )
    return df.drop("_known_a", "_known_b", "_both")


def score_day(
    games: DataFrame,
    canonical: DataFrame,
    mapping: DataFrame,
    ratings: DataFrame,
    dimensions: dict[str, DataFrame] | None = None,
    fitted: dict | None = None,
    calibration: Calibration | None = None,
    threshold: float = fixed.DEFAULT_THRESHOLD,
    bookmakers: str | None = "bookmakers",
    entity: str = "TeamName",
    rating_date: str | None = "snapshot_date",
    season: str | None = "season",
) -> DataFrame:
    """Prediction rows of the day, from each entity's newest rating and dimension rows.

    With fitted models the ensemble predicts (skipping missing members); without, the rating
    difference does. A calibration decides which rows are actionable, else the threshold.
    """
    df = odds.flatten_odds(games, bookmakers).drop(bookmakers) if bookmakers else games
    df = resolve_sides(df, canonical, mapping)
    df = day_features(df, ratings, dimensions or {}, entity, rating_date=rating_date, season=season)
    known = F.col("home_kp").isNotNull() & F.col("away_kp").isNotNull()
    if fitted:
        defaults = {k: v for k, v in fixed.SCORING_DEFAULTS.items() if k not in df.columns}
        df = models.score_models(df.withColumns({k: F.lit(v) for k, v in defaults.items()}), fitted)
        missing = [m for m in fixed.THREE_MODEL_WEIGHTS if f"pred_{m}" not in df.columns]
        df = df.withColumns({f"pred_{m}": F.lit(None).cast("double") for m in missing})
        margin = evaluation.ensemble_rowwise()
    else:
        margin = dims.simple_expected_margin(df)
    df = df.withColumn("pred_margin", F.when(known, margin))
    if calibration is None:
        return picks.daily_picks(df, threshold=threshold)
    df = calibrated_bet_mask(df, calibration, line="spread_home")
    df = df.withColumn("pred_margin", F.when(known, F.col("pred_scaled"))).drop("pred_scaled", "edge")
    return picks.daily_picks(df, actionable=F.col("is_bet") & known)


PREDICTION_COLUMNS = [
    "home_team", "away_team", "home_kp", "away_kp", "spread_home", "pred_margin", "edge", "pick", "confidence", "is_actionable",
]
