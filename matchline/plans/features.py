"""Feature tables: one lazy plan from paired matches to model inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import fixed
from ..operators import asof, cleaning, dims, history, joins
from ..operators.profile import distinct_entities

RATING_VALUES = {"AdjEM": "kp_adj_em", "AdjOE": "kp_adj_o", "AdjDE": "kp_adj_d", "AdjTempo": "kp_tempo"}


def _canonical_sides(games: DataFrame, name_map: DataFrame | None) -> tuple[DataFrame, dict[str, str]]:
    """Games with the canonical name of both sides; without a map the names are canonical."""
    if name_map is None:
        return games, {"a": "team_a", "b": "team_b"}
    raw, canonical = name_map.columns[:2]
    for s in "ab":
        games = joins.map_lookup(games, f"team_{s}", name_map, raw, canonical, f"_canon_{s}")
    return games, {"a": "_canon_a", "b": "_canon_b"}


def rating_features(games: DataFrame, ratings: DataFrame, name_map: DataFrame | None = None, entity: str = "TeamName") -> DataFrame:
    """As-of ratings of both sides with the derived columns."""
    games, sides = _canonical_sides(games, name_map)
    ranks = {c: c for c in X.present(ratings, fixed.RANK_COLUMNS)}
    out = asof.asof_snapshot_join(games, ratings, {**RATING_VALUES, **ranks}, entity, sides=sides)
    out = asof.rank_normalise(out).drop(*[f"{r}_{s}" for r in ranks for s in "ab"], "_canon_a", "_canon_b")
    return asof.expected_margin_raw(asof.rating_differentials(asof.matched_flag(out)))


def feature_table(games: DataFrame, ratings: DataFrame, name_map: DataFrame | None = None, entity: str = "TeamName", compat: bool = False) -> DataFrame:
    """Rest, rolling, recency, ratings, venue and expected margin, in the fixed column order."""
    df = history.history_features(games, compat=compat)
    df = rating_features(df, ratings, name_map, entity)
    home, neutral = X.venue_flags("is_neutral")
    df = df.withColumns({"is_home_a": home, "is_neutral": neutral})
    df = df.withColumn("kp_pred_margin", X.venue_adjusted("kp_pred_margin_raw", "is_home_a", "is_neutral"))
    return cleaning.select_ordered(df)


def features_without_ratings(games: DataFrame) -> DataFrame:
    """Base columns and venue flags when no ratings exist."""
    home, neutral = X.venue_flags("is_neutral")
    base = ["game_key", "season", "date", "team_a", "team_b", "is_neutral", "spread_a", "final_margin_a", "cover_a"]
    return games.select(*base).withColumns(
        {"is_home_a": home, "is_neutral": neutral, "kp_matched": F.lit(False), "is_leaky": F.lit(False)}
    )


def feature_table_extended(features: DataFrame, dimensions: dict[str, DataFrame], name_map: DataFrame | None = None, entity: str = "TeamName") -> DataFrame:
    """Add the dimensions that exist and the matchup columns.

    Names: four_factors, hca, height_exp, team_stats. Season-level values are end-of-season, so
    rows are flagged leaky as soon as one is joined.
    """
    df, sides = _canonical_sides(features, name_map)
    kw = {"entity": entity, "sides": sides}
    if "four_factors" in dimensions:
        df = dims.dim_join_four_factors(df, dimensions["four_factors"], **kw)
    if "hca" in dimensions:
        df = dims.dim_join_advantage(df, dimensions["hca"], **kw)
    if "height_exp" in dimensions:
        df = dims.dim_join_height_exp(df, dimensions["height_exp"], **kw)
    if "team_stats" in dimensions:
        df = dims.dim_join_team_stats(df, dimensions["team_stats"], **kw)
    leaky = bool({"four_factors", "height_exp", "team_stats"} & set(dimensions))
    return dims.matchup_features(df).drop("_canon_a", "_canon_b").withColumn("is_leaky", F.lit(leaky))


def entities_of(games: DataFrame) -> DataFrame:
    return distinct_entities(games).withColumnRenamed("entity", "raw_name")
