"""Cases that once gave wrong values or lost rows without a sign."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from matchline.operators import calibration, dims, history, joins, pages, profile
from matchline.plans import daily
from matchline.sources import readers
from matchline.streaming import daily as stream


def ew_of(spark, values, half_life=5.0):
    start = dt.date(2000, 1, 1)
    rows = [(i, start + dt.timedelta(days=i), 1, 1_000_000 + i, None if v is None else float(v), 1, 2) for i, v in enumerate(values)]
    games = spark.createDataFrame(rows, "game_key long, date date, team_a long, team_b long, final_margin_a double, points_a int, points_b int")
    days = history.entity_day_history(games, parts=("ew",), half_life=half_life, min_periods=1)
    return [r.ew_margin for r in days.filter("entity = 1").orderBy("date").collect()]


def ew_by_pandas(values, half_life=5.0):
    mean = pd.Series(values, dtype=float).ewm(halflife=half_life, min_periods=1).mean().shift(1)
    return [None if np.isnan(v) else v for v in mean]


@pytest.mark.parametrize("case", ["empty block", "many empty blocks", "random runs"])
def test_ew_mean_keeps_values_over_empty_blocks(spark, case):
    rng = np.random.default_rng(4)
    if case == "empty block":
        values = [0.0] * 480 + [100.0] * 18 + [0.0, 0.0] + [None] * 1600
    elif case == "many empty blocks":
        values = [3.0, 7.0, None, 9.0] + [None] * 7000 + [1.0, None]
    else:
        values = []
        while len(values) < 4000:
            values += [float(x) for x in rng.integers(-30, 30, rng.integers(1, 40))] + [None] * int(rng.integers(0, 900))
    got, want = ew_of(spark, values), ew_by_pandas(values)
    assert len(got) == len(want)
    for i, (g, w) in enumerate(zip(got, want)):
        # An empty history is the default of the feature, whatever it is.
        if w is not None:
            assert g == pytest.approx(w, rel=1e-9, abs=1e-9), i


def test_the_newest_rating_counts(spark):
    ratings = spark.createDataFrame(
        [("A", dt.date(2024, 1, 1), 1.0, 100.0, 100.0, 70.0), ("A", dt.date(2025, 1, 1), 30.0, 110.0, 90.0, 70.0), ("B", dt.date(2024, 6, 1), 2.0, 100.0, 100.0, 70.0)],
        "TeamName string, snapshot_date date, AdjEM double, AdjOE double, AdjDE double, AdjTempo double",
    )
    games = spark.createDataFrame([("A", "B", -3.0, 3.0)], "home_team string, away_team string, spread_home double, spread_away double")
    canonical = ratings.select(F.col("TeamName").alias("canonical_name")).distinct()
    mapping = spark.createDataFrame([], "raw_name string, canonical_name string")
    row = daily.score_day(games, canonical, mapping, ratings, bookmakers=None).first()
    assert row.pred_margin == pytest.approx(28 * 70 / 100 + 3.5)
    factors = spark.createDataFrame([("A", "2023-24", 40.0), ("A", "2024-25", 55.0)], "TeamName string, season string, off_efg double")
    out = daily.day_features(games.withColumns({"home_kp": F.col("home_team"), "away_kp": F.col("away_team")}), ratings, {"four_factors": factors}, rating_date="snapshot_date", season="season").first()
    assert out.ff_off_efg_a == 55.0
    with pytest.raises(ValueError):
        daily.score_day(games, canonical, mapping, ratings.drop("snapshot_date"), bookmakers=None)


def test_csv_columns_go_by_name(spark, tmp_path):
    folder = tmp_path / "ratings one"
    folder.mkdir()
    (folder / "r-2024-01-01.csv").write_text("TeamName,AdjEM,AdjOE,AdjTempo,kp_rank_em\nA,1,100,68,5\n")
    (folder / "r-2024-01-02.csv").write_text("AdjTempo,AdjOE,TeamName,AdjEM\n70,110,B,30\n")
    (folder / "r-2024-01-03.csv").write_text("TeamName,AdjEM,AdjOE,AdjTempo,kp_rank_em\nC,2,,69,\n")
    rows = {r.TeamName: r for r in readers.read_dated_snapshots(spark, f"{folder}/*.csv").collect()}
    assert (rows["B"].AdjEM, rows["B"].AdjOE, rows["B"].AdjTempo, rows["B"].kp_rank_em) == (30.0, 110.0, 70.0, None)
    assert (rows["A"].AdjEM, rows["A"].kp_rank_em, rows["C"].AdjOE) == (1.0, "5", None)
    assert {r.snapshot_date for r in rows.values()} == {dt.date(2024, 1, d) for d in (1, 2, 3)}


def test_a_value_beats_null(spark):
    mapping = spark.createDataFrame([("x", None), ("x", "Y"), ("z", None)], "raw_name string, canonical_name string")
    names = spark.createDataFrame([("x",), ("z",), ("q",)], "name string")
    assert {r.name: r.found for r in joins.map_lookup(names, "name", mapping, "raw_name", "canonical_name", "found").collect()} == {"x": "Y", "z": None, "q": None}
    assert {r.name for r in joins.unmapped(names, mapping, "name", "raw_name").collect()} == {"z", "q"}
    assert {r.name for r in joins.matched(names, mapping, "name", "raw_name").collect()} == {"x"}
    values = spark.createDataFrame([("A", None, 1), ("A", 5.0, 2), ("A", 3.0, 3)], "TeamName string, hca double, loaded int")
    assert joins.first_row_per_key(values.drop("loaded"), ["TeamName"], ["hca"]).first().hca == 3.0
    games = spark.createDataFrame([("A", "B", 1, 0)], "team_a string, team_b string, is_home_a int, is_neutral int")
    assert dims.dim_join_advantage(games, values, order=["loaded"]).first().team_hca == 3.5
    assert dims.dim_join_advantage(games, values.filter("hca IS NOT NULL"), order=["loaded"]).first().team_hca == 5.0


def test_audit_keeps_all_quarantined_rows(spark):
    games = spark.createDataFrame([("2024-25", 1.5, 1.0), ("2024-25", None, None)], "season string, spread_a double, cover_a double")
    bad = spark.createDataFrame([(None,), (dt.date(2020, 1, 5),), (dt.date(2025, 1, 5),)], "date_parsed date")
    rows = {r.season: r for r in profile.season_audit(games, bad).collect()}
    assert {s: (r.total_games, r.quarantine_rows) for s, r in rows.items()} == {"2024-25": (2, 1), "2019-20": (0, 1), None: (0, 1)}
    assert 2 * sum(r.total_games for r in rows.values()) + sum(r.quarantine_rows for r in rows.values()) == 2 * 2 + 3


def log_page(cells):
    head = "".join(f"<th>{c}</th>" for c in ("Date", "Opponent", "Game", "Result", "Score", "ATS", "Spread", "OU", "Total"))
    body = "".join("<tr>" + "".join(f"<td>{c}</td>" for c in row) + "</tr>" for row in cells)
    return f"<title>T</title><p>x</p><table><tr>{head}</tr>{body}</table><table><tr><td>other</td></tr></table>"


def test_tables_in_cells_do_not_cut_the_page(spark):
    row = lambda i, opponent: [f"Nov {i}, 2024", opponent, "REG", "W", "80-70", "W", "-3", "O", "140"]
    cells = [row(1, "A"), row(2, "vs <TABLE class=x><tr><td>B</td><td>C</td></tr></TABLE> D"), row(3, "E"), row(4, "F")]
    html = log_page(cells)
    df = spark.createDataFrame([(1, "2024-25", html), (2, "2024-25", html.replace("</table>", "")), (3, "2024-25", "no table")], "team_id long, season string, html string")
    rows, rejects = pages.page_log_to_rows(df)
    got = [r.opponent for r in rows.orderBy("date").collect()]
    assert len(got) == 4 and "B C D" in got[1] and got[2:] == ["E", "F"]
    assert {r.team_id: r.reject_reason.split(":")[0] for r in rejects.collect()} == {2: "table without end", 3: "no table"}


def test_calibration_without_a_monotone_fit_loads(spark, tmp_path):
    saved = calibration.Calibration({"ridge": 1.0}, 0.9, 4.0, ["3-5"])
    saved.save(spark, str(tmp_path / "c"))
    assert calibration.Calibration.load(spark, str(tmp_path / "c")) == saved


def test_late_batches_of_odds_are_kept(spark, tmp_path):
    doc = lambda i, day: '{"id": "%s", "commence_time": "2025-01-%02dT00:00:00Z", "home_team": "h", "away_team": "a", "bookmakers": []}\n' % (i, day)
    source = tmp_path / "in"
    source.mkdir()
    seen = []
    for batch in ([("far", 20)], [("near", 10), ("next", 21), ("far", 20)], [("first", 1)]):
        (source / f"{len(seen)}.json").write_text("".join(doc(*d) for d in batch))
        q = stream.start_daily_picks(stream.odds_stream(spark, str(source)), lambda df: df.select("id"), str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination(120)
        assert q.exception() is None
        seen.append(sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()))
    assert seen == [["far"], ["far", "near", "next"], ["far", "first", "near", "next"]]




def test_shared_words_of_names_of_any_length(spark):
    import random

    from matchline.operators import names

    rng = random.Random(11)
    words = ["state", "of", "the"] * 6 + [f"w{i}" for i in range(40)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    canonical = sorted({make(rng.choice([1, 1, 2, 3, 5, 12, 40])) for _ in range(120)})
    raw = sorted({make(rng.choice([1, 2, 3, 9, 10, 11, 12, 40])).upper() for _ in range(150)} | {"nothing known", "", "State"})
    want = {}
    for r in raw:
        best = max(((len(set(r.lower().split()) & set(c.split())), [-ord(x) for x in c] + [1], c) for c in canonical), default=None)
        if best and best[0]:
            tied = [c for c in canonical if len(set(r.lower().split()) & set(c.split())) == best[0]]
            want[r] = (min(tied), best[0])
    got = names.token_overlap_join(spark.createDataFrame([(r,) for r in raw] + [(None,)], "raw_name string"), spark.createDataFrame([(c,) for c in canonical], "canonical_name string"))
    assert {r.raw_name: (r.canonical_name, r.overlap) for r in got.collect()} == want
