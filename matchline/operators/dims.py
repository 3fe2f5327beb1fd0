"""Season-level and venue dimensions joined to both sides of a match, and matchup columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import fixed
from .joins import first_row_per_key, join_both_sides


def dim_join_season(
    games: DataFrame, dim: DataFrame, columns: Sequence[str], prefix: str, entity: str = "TeamName",
    season: str = "season", sides: dict[str, str] | None = None,
) -> DataFrame:
    """Left-join (season, entity) columns to both sides as <prefix>_<column>_a and _b."""
    have = X.present(dim, list(columns))
    if not have:
        return games
    key = "_season_no"
    dim = dim.select(X.season_number(season).alias(key), F.col(entity), *[F.col(c) for c in have])
    dim = first_row_per_key(dim, [key, entity], have)
    left = games.withColumn(key, X.season_number(season))
    return join_both_sides(left, dim, [key], entity, {c: f"{prefix}_{c}" for c in have}, sides).drop(key)


def dim_join_four_factors(games: DataFrame, dim: DataFrame, **kw) -> DataFrame:
    return dim_join_season(games, dim, fixed.FOUR_FACTOR_COLUMNS, "ff", **kw)


def dim_join_height_exp(games: DataFrame, dim: DataFrame, **kw) -> DataFrame:
    return dim_join_season(games, dim, fixed.HEIGHT_COLUMNS, "ht", **kw)


def dim_join_team_stats(games: DataFrame, dim: DataFrame, **kw) -> DataFrame:
    columns = [*fixed.OFFENCE_RENAMES.values(), *fixed.DEFENCE_RENAMES.values()]
    return dim_join_season(games, dim, columns, "ts", **kw)


def venue_advantage(own: str | Column, other: str | Column, is_home: str = "is_home_a", is_neutral: str = "is_neutral") -> Column:
    """Advantage of side A: own value at home, minus the host's away, zero on neutral ground."""
    default = F.lit(fixed.VENUE_POINTS)
    home, neutral = F.col(is_home) == 1, F.col(is_neutral) == 1
    return (
        F.when(home, F.coalesce(X.col(own), default))
        .when(~home & ~neutral, -F.coalesce(X.col(other), default))
        .otherwise(F.lit(0.0))
    )


def venue_elevation(own: str | Column, other: str | Column, is_home: str = "is_home_a", is_neutral: str = "is_neutral") -> Column:
    """Elevation of the host's place; zero when neutral or unknown."""
    home, neutral = F.col(is_home) == 1, F.col(is_neutral) == 1
    zero = F.lit(0.0)
    return F.when(home, F.coalesce(X.col(own), zero)).when(~home & ~neutral, F.coalesce(X.col(other), zero)).otherwise(zero)


def dim_join_advantage(
    games: DataFrame, dim: DataFrame, entity: str = "TeamName", sides: dict[str, str] | None = None, order: Sequence[str] = ()
) -> DataFrame:
    """team_hca and team_elevation from a per-entity table; of duplicates the first in `order` (a load time, a file), then the lowest stays."""
    have = X.present(dim, ["hca", "elevation"])
    one = first_row_per_key(dim.select(entity, *order, *have), [entity], [*order, *have]).drop(*order)
    out = join_both_sides(games, one, [], entity, {c: f"_{c}" for c in have}, sides)
    cols = {"team_hca": venue_advantage("_hca_a", "_hca_b")}
    cols["team_elevation"] = venue_elevation("_elevation_a", "_elevation_b") if "elevation" in have else F.lit(0.0)
    return out.withColumns(cols).drop(*[f"_{c}_{s}" for c in have for s in "ab"])


def matchup_features(df: DataFrame, fill: float | None = None) -> DataFrame:
    """Offence against the other side's defence, and size/experience differences.

    Columns whose inputs are absent are skipped. `fill` replaces unknown values (scoring).
    """
    rules = {
        "ff_efg_matchup_a": ("ff_off_efg_a", "ff_def_efg_b"),
        "ff_efg_matchup_b": ("ff_off_efg_b", "ff_def_efg_a"),
        "ff_to_matchup_a": ("ff_def_to_pct_b", "ff_off_to_pct_a"),
        "ff_to_matchup_b": ("ff_def_to_pct_a", "ff_off_to_pct_b"),
        "ff_reb_matchup_a": ("ff_off_or_pct_a", "ff_def_or_pct_b"),
        "ff_reb_matchup_b": ("ff_off_or_pct_b", "ff_def_or_pct_a"),
        "ht_height_diff": ("ht_avg_height_a", "ht_avg_height_b"),
        "ht_exp_diff": ("ht_experience_a", "ht_experience_b"),
        "ht_cont_diff": ("ht_continuity_a", "ht_continuity_b"),
    }
    have, cols = set(df.columns), {}
    for target, (plus, minus) in rules.items():
        if {plus, minus} <= have:
            diff = F.col(plus) - F.col(minus)
            cols[target] = diff if fill is None else F.coalesce(diff, F.lit(float(fill)))
        elif fill is not None:
            cols[target] = F.lit(float(fill))
    return df.withColumns(cols) if cols else df


def simple_expected_margin(df: DataFrame) -> Column:
    """Rating difference scaled by tempo, plus the venue advantage at home."""

    def known(name: str, default: float) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)

    home = F.coalesce(F.col("is_home_a"), F.lit(0)) if "is_home_a" in df.columns else F.lit(0)
    raw = F.col("kp_adj_em_diff") * known("kp_tempo_avg", fixed.DEFAULT_TEMPO) / 100
    return raw + known("team_hca", fixed.VENUE_POINTS) * home
