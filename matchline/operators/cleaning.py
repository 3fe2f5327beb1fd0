"""Cleaning and projection of landed rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import fixed


def drop_unnamed(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in df.columns if not c.startswith(("Unnamed", "_c"))])


def coerce_numeric(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Cast the listed columns that exist; unreadable values become NULL."""
    return df.withColumns({c: X.to_number(c) for c in X.present(df, list(names))})


def rename_to_canonical(df: DataFrame, renames: dict[str, str], keep: Sequence[str] | None = None) -> DataFrame:
    """Rename the columns that exist and, if asked, keep only the listed ones."""
    out = df.withColumnsRenamed({k: v for k, v in renames.items() if k in df.columns})
    return out if keep is None else out.select(*X.present(out, list(keep)))


def first_available(df: DataFrame, *names: str) -> str:
    """The first of several alternative column names the frame has."""
    for n in names:
        if n in df.columns:
            return n
    raise ValueError(f"none of {names} in {df.columns}")


def clean_team_rows(df: DataFrame) -> DataFrame:
    """Parsed date, match keys of the names, and own/opponent scores of two-sided rows."""
    df = drop_unnamed(df)
    return df.withColumns(
        {
            "date_parsed": X.parse_event_date("date"),
            "team_norm": X.normalise_key("team_name"),
            "opponent_norm": X.normalise_key("opponent"),
            "team_score": X.to_number(X.own_score("result", "winner_score", "loser_score")),
            "opp_score": X.to_number(X.opponent_score("result", "winner_score", "loser_score")),
        }
    )


def clean_repeated_headers(df: DataFrame, name: str = "TeamName", headers: Sequence[str] = ("Team", "TeamName")) -> DataFrame:
    """Drop separator rows: repeated headers, blank names and date captions inside the body."""
    n = F.col(name)
    return df.filter(n.isNotNull() & ~n.isin(*headers) & ~F.contains(n, F.lit("Ratings on")))


def clean_snapshots(df: DataFrame) -> DataFrame:
    """Snapshot rows ready to join: canonical names, numbers, no separators, no trailing seed numbers."""
    df = rename_to_canonical(df, fixed.RATING_RENAMES)
    df = clean_repeated_headers(df)
    df = coerce_numeric(df, fixed.RATING_COLUMNS + fixed.RANK_COLUMNS)
    return df.withColumn("TeamName", X.strip_trailing_ordinal("TeamName"))


def column_shift_audit(df: DataFrame, by: str, margin: str, offence: str, floor: float = 60.0) -> DataFrame:
    """Flag snapshots with impossible metrics: a margin column without values, or offence below `floor`."""
    low = F.avg(F.when(F.col(offence) < floor, 1.0).otherwise(0.0))
    absent = F.avg(F.when(F.col(margin).isNull(), 1.0).otherwise(0.0))
    return (
        df.groupBy(by)
        .agg(F.count("*").alias("n_rows"), absent.alias("margin_null_rate"), low.alias("offence_low_rate"))
        .withColumn("is_shifted", (F.col("margin_null_rate") == 1.0) | (F.col("offence_low_rate") > 0.5))
    )


def dimension(df: DataFrame, renames: dict[str, str], season: int | None = None) -> DataFrame:
    """A season-level dimension: canonical columns only, numeric except the name."""
    targets = list(dict.fromkeys(renames.values()))
    out = rename_to_canonical(df, renames, targets)
    out = coerce_numeric(out, [c for c in out.columns if c != "TeamName"])
    return out if season is None else out.withColumn("season", F.lit(season))


def filter_modelable(
    df: DataFrame, features: Sequence[str], require_line: bool = True, require_ratings: bool = True, strict: bool = False
) -> tuple[DataFrame, list[str]]:
    """Rows usable for fitting, and the features that exist.

    Unknown features are reported; with `strict` they raise.
    """
    available = X.present(df, list(features))
    missing = sorted(set(features) - set(available))
    if missing and strict:
        raise ValueError(f"unknown features: {missing}")
    if missing:
        import warnings

        warnings.warn(f"{len(missing)} features are not in the frame: {', '.join(missing[:5])}", stacklevel=2)
    out = df
    if require_line:
        out = out.filter(F.col("spread_a").isNotNull())
    if require_ratings:
        out = out.filter(F.col("kp_matched"))
    return out.dropna(subset=[*available, "final_margin_a", "cover_a"]), available


def with_split(df: DataFrame, train: Sequence, val: Sequence, test: Sequence, season: str = "season") -> DataFrame:
    """Label every row train, val or test by its season; rows of other seasons are dropped."""
    s = F.col(season)
    split = F.when(s.isin(*train), "train").when(s.isin(*val), "val").when(s.isin(*test), "test")
    return df.withColumn("split", split).filter(F.col("split").isNotNull())


def select_ordered(df: DataFrame, prefixes: Sequence[str] = ("kp_",)) -> DataFrame:
    """Core columns, prefixed groups, history columns, then everything else."""
    groups = [c for p in prefixes for c in df.columns if c.startswith(p)]
    lead = X.present(df, fixed.CORE_COLUMNS + groups + fixed.SITUATIONAL + fixed.ROLLING + fixed.EW_COLUMNS)
    lead = list(dict.fromkeys(lead))
    return df.select(*lead, *[c for c in df.columns if c not in lead])


def scoring_defaults(df: DataFrame, features: Sequence[str], defaults: dict[str, float] | None = None) -> DataFrame:
    """Feature columns for scoring: situational defaults first, then zero; absent features are added."""
    defaults = fixed.SCORING_DEFAULTS if defaults is None else defaults
    cols = {}
    for f in features:
        fill = F.lit(float(defaults.get(f, 0.0)))
        cols[f] = F.coalesce(X.null_if_nan(F.col(f).cast("double")), fill) if f in df.columns else fill
    return df.withColumns(cols)


def column_coverage(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Non-null count and percentage of each listed column, from one pass."""
    names = X.present(df, list(names))
    agg = df.agg(F.count("*").alias("_n"), *[F.count(c).alias(f"_c{i}") for i, c in enumerate(names)])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"_c{i}").alias("non_null")) for i, c in enumerate(names)])
    out = agg.select("_n", F.inline(rows))
    return out.select(
        "column_name", "non_null", F.col("_n").alias("n_rows"), (F.lit(100.0) * F.col("non_null") / F.col("_n")).alias("pct")
    )
