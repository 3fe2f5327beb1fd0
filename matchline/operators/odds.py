"""Market lines out of nested odds documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOOKMAKERS = (
    "array<struct<markets: array<struct<key: string, outcomes: array<struct<name: string, point: double>>>>>>"
)


def _last_point(outcomes: Column, name: Column) -> Column:
    named = F.filter(outcomes, lambda o: o["name"] == name)
    return F.get(F.transform(named, lambda o: o["point"]), F.size(named) - 1)


def flatten_odds(df: DataFrame, bookmakers: str = "bookmakers", home: str = "home_team", away: str = "away_team") -> DataFrame:
    """Add spread_home and spread_away.

    Each bookmaker offers its first `spreads` market. The first bookmaker that prices the home
    side ends the search; the away price is the newest one seen up to there. Only array functions,
    so no row is exploded.
    """
    h, a = F.col(home), F.col(away)

    def quote(book: Column) -> Column:
        spreads = F.get(F.filter(F.coalesce(book["markets"], F.array()), lambda m: m["key"] == "spreads"), F.lit(0))
        outcomes = F.coalesce(spreads["outcomes"], F.array())
        not_home = F.filter(outcomes, lambda o: ~F.coalesce(o["name"] == h, F.lit(False)))
        return F.struct(_last_point(outcomes, h).alias("home"), _last_point(not_home, a).alias("away"))

    quotes = F.transform(F.coalesce(F.col(bookmakers), F.array()), quote)
    df = df.withColumn("_quotes", quotes)
    priced = F.transform(
        F.col("_quotes"), lambda q, i: F.when(q["home"].isNotNull(), i)
    )
    first = F.array_min(priced)
    upto = F.slice("_quotes", F.lit(1), F.coalesce(first + 1, F.size("_quotes")))
    seen = F.filter(F.transform(upto, lambda q: q["away"]), lambda p: p.isNotNull())
    df = df.withColumns({"spread_home": F.get("_quotes", first)["home"], "spread_away": F.get(seen, F.size(seen) - 1)})
    return df.drop("_quotes")


def flatten_odds_json(df: DataFrame, document: str = "bookmakers_json", home: str = "home_team", away: str = "away_team") -> DataFrame:
    """flatten_odds on a JSON text column."""
    parsed = df.withColumn("_books", F.from_json(F.col(document), BOOKMAKERS))
    return flatten_odds(parsed, "_books", home, away).drop("_books")
