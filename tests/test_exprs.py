"""Expressions on inline rows: the awkward values of landed data."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from matchline.functions import exprs as X
from matchline.operators import asof, cleaning, pairing


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("+31.5", 31.5), (" 7 ", 7.0), ("-3", -3.0), ("n/a", None), ("", None), ("NaN", None), ("12d", None), ("1e2", 100.0), (None, None)],
)
def test_to_number(spark, raw, want):
    assert one(spark, raw, X.to_number) == want


@pytest.mark.parametrize(
    ("raw", "want"), [("Jan 05, 2024", dt.date(2024, 1, 5)), ("Jan 5, 2024", dt.date(2024, 1, 5)), ("Foo 99, 2024", None), ("Feb 30, 2024", None)]
)
def test_dates(spark, raw, want):
    assert one(spark, raw, X.parse_event_date) == want


@pytest.mark.parametrize(
    ("day", "label", "number"),
    [(dt.date(2024, 10, 1), "2024-25", 2025), (dt.date(2025, 4, 1), "2024-25", 2025), (dt.date(1999, 12, 31), "1999-00", 2000)],
)
def test_seasons(spark, day, label, number):
    assert one(spark, day, X.season_label, "date") == label
    assert one(spark, day, lambda c: X.season_number(X.season_label(c)), "date") == number
    assert one(spark, 2022, X.season_number, "int") == 2022


@pytest.mark.parametrize(
    ("raw", "want"),
    [("@ Duke", ("Duke", "Away")), ("@@Duke", ("Duke", "Away")), ("vs Duke ", ("Duke", "Home")), ("VS Duke", ("Duke", "Home")), ("Duke", ("Duke", "Neutral")), (None, ("", "Neutral"))],
)
def test_venue(spark, raw, want):
    opponent, location = X.split_venue("x")
    assert tuple(spark.createDataFrame([(raw,)], "x string").select(opponent, location).first()) == want


@pytest.mark.parametrize(("raw", "want"), [("80-70", (80, 70)), ("70 - 80", (80, 70)), ("n/a", (None, None)), ("80-70 OT", (None, None)), (None, (None, None))])
def test_scores(spark, raw, want):
    a, b = X.score_pair("x")
    assert tuple(spark.createDataFrame([(raw,)], "x string").select(a, b).first()) == want


def test_labels(spark):
    rows = spark.createDataFrame(
        [(1.0, -1.0), (2.0, -1.0), (0.0, -1.0), (None, 1.0), (1.0, None), (float("nan"), 1.0)], "m double, s double"
    )
    got = [r[0] for r in rows.select(X.label_cover("m", "s")).collect()]
    assert got == [0.5, 1.0, 0.0, None, None, None]


def test_title(spark):
    title = lambda h: one(spark, h, X.page_title)
    assert title("<TITLE> A &amp; B - log</TITLE>") == "A & B"
    assert title("<title></title>") == "Unknown Team"
    assert title("<p>none</p>") == "Unknown Team"
    assert title("<title>a\nb</title>") == "a\nb"


def test_match_key_needs_all_parts(spark):
    rows = spark.createDataFrame([(dt.date(2024, 1, 2), 9, 3), (None, 1, 2), (dt.date(2024, 1, 2), None, 3)], "d date, a int, b int")
    assert [r[0] for r in rows.select(X.match_key("d", "a", "b")).collect()] == ["2024-01-02|3|9", None, None]


def test_missing_features_warn_or_raise(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, True, 1.0)], "x double, spread_a double, final_margin_a double, kp_matched boolean, cover_a double")
    with pytest.warns(UserWarning):
        rows, have = cleaning.filter_modelable(df, ["x", "y"])
    assert have == ["x"] and rows.count() == 1
    with pytest.raises(ValueError):
        cleaning.filter_modelable(df, ["x", "y"], strict=True)


ROW = "team_id int, team_name string, date string, opponent string, location string, game string, result string, winner_score double, loser_score double, ats string, spread double, ou string, total double"


def test_pairing_rejects_and_conserves(spark):
    def row(i, name, opp, loc, date="Jan 5, 2024", result="W"):
        return (i, f"{name} Cats", date, opp, loc, "REG", result, 80.0, 70.0, "W", -3.0, None, 140.0)

    rows = spark.createDataFrame(
        [
            row(1, "Ann", "Bea", "Home"), row(2, "Bea", "Ann", "Away", result="L"),
            row(3, "Cal", "Dee", "Home"), row(4, "Dee", "Cal", "Home"),
            row(5, "Eve", "Nowhere", "Home"),
            row(6, "Fay", "Gus", "Away"),
            row(7, "Gus", "Hal", "Home", "Foo 99, 2024"),
            row(8, "Hal", "Ivy", "Neutral"), row(9, "Ivy", "Hal", "Neutral", result="L"),
            row(10, "Jo", "Kim", "Home"), row(10, "Jo", "Kim", "Home"),
            row(11, "Kim", "Jo", "Away", "Jan 6, 2024"),
        ],
        ROW,
    )
    ids = spark.createDataFrame([(n, i + 1) for i, n in enumerate("Ann Bea Cal Dee Eve Fay Gus Hal Ivy Jo Kim".split())], "opponent string, opponent_team_id int")
    games, rejects = pairing.pair_two_sided_rows(cleaning.clean_team_rows(rows), ids)
    got = {r["team_a"]: r for r in games.collect()}
    assert set(got) == {"Ann Cats", "Hal Cats"}
    assert (got["Ann Cats"]["points_a"], got["Ann Cats"]["points_b"], got["Ann Cats"]["cover_a"]) == (80.0, 70.0, 1.0)
    assert got["Hal Cats"]["home_team"] is None and got["Hal Cats"]["is_neutral"]
    reasons = sorted((r["team_id"], r["quarantine_reason"]) for r in rejects.collect())
    assert reasons == [
        (3, "unexpected location combo: Home/Home"), (4, "unexpected location combo: Home/Home"),
        (5, "could not map opponent to team_id"), (6, "expected 2 rows, got 1"), (7, "unparseable date"),
        (10, "opponent team_id mismatch"), (10, "opponent team_id mismatch"), (11, "expected 2 rows, got 1"),
    ]
    assert 2 * games.count() + rejects.count() == rows.count()
    done = pairing.pair_landed(cleaning.clean_team_rows(rows), ids)
    assert done.counts == {"rows_in": 12, "bad_date": 1, "unmapped": 1, "games": 2, "row_count": 2, "id_mismatch": 2, "venue": 2} and done.conserved()
    assert tuple(done.rate().first()) == (12, 2, 8, 4 / 12)
    none = pairing.pair_landed(cleaning.clean_team_rows(rows.limit(0)), ids)
    assert none.conserved() and none.counts["rows_in"] == 0 and none.games.count() == 0 and tuple(none.rate().first()) == (0, 0, 0, None)


def test_asof_is_strictly_before_and_bounded(spark):
    d = dt.date
    games = spark.createDataFrame([(1, d(2024, 1, 10), "x", "y"), (2, d(2024, 1, 1), "x", "y"), (3, d(2025, 12, 1), "x", "y")], "game_key int, date date, team_a string, team_b string")
    ratings = spark.createDataFrame(
        [("x", d(2024, 1, 1), 1.0), ("y", d(2024, 1, 1), 2.0), ("x", d(2024, 1, 10), 9.0), ("x", d(2024, 1, 1), 5.0)], "TeamName string, snapshot_date date, AdjEM double"
    )
    rows = {r["game_key"]: r for r in asof.asof_snapshot_join(games, ratings, {"AdjEM": "em"}).collect()}
    assert len(rows) == 3
    assert (rows[1]["em_a"], rows[1]["em_b"], rows[1]["asof_tier"]) == (1.0, 2.0, "daily")
    assert rows[2]["em_a"] is None and rows[3]["em_a"] is None and rows[3]["kp_snapshot_date"] is None
