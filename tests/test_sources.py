"""Readers on files laid out as they land."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from matchline.operators import cleaning
from matchline.sources import readers, scratch, writers

HEADER = "TeamName,AdjEM,AdjOE,AdjDE,AdjTempo\n"


def test_dated_snapshots(spark, tmp_path):
    (tmp_path / "ratings_2025-11-03.csv").write_text(HEADER + "Houston,+31.13,119.5,88.3,66.9\nTeam,,,,\nDuke 1,n/a,120,90,70\n")
    (tmp_path / "ratings_2025-11-04.csv").write_text(HEADER + "Houston,30.0,119.0,89.0,67.0\n")
    (tmp_path / "ratings_2024.csv").write_text(HEADER + "Old,1,2,3,4\n")
    rows, mode = readers.read_snapshots(spark, str(tmp_path))
    assert mode == "daily"
    got = sorted((str(r["snapshot_date"]), r["TeamName"], r["AdjEM"]) for r in cleaning.clean_snapshots(rows).collect())
    assert got == [("2025-11-03", "Duke", None), ("2025-11-03", "Houston", 31.13), ("2025-11-04", "Houston", 30.0)]


def test_season_snapshots_are_the_fallback(spark, tmp_path):
    (tmp_path / "ratings_2024.csv").write_text(HEADER + "Old,1,2,3,4\n")
    rows, mode = readers.read_snapshots(spark, str(tmp_path))
    r = rows.first()
    assert (mode, r["season"], r["is_leaky"], r["AdjTempo"]) == ("season", 2024, True, 4.0)


def test_no_snapshots_raise(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.read_snapshots(spark, str(tmp_path))


def test_team_rows(spark, tmp_path):
    names = "team_id,team_name,season,date,opponent,location,game,result,winner_score,loser_score,ats,spread,ou,total,\n"
    (tmp_path / "a.csv").write_text(names + '7,Duke Blue Devils,2024-25,"Jan 5, 2025",Iowa,Home,REG,W,80,70,W,-3.5,O,140,\n8,Iowa Hawks,2024-25,"Jan 5, 2025",Duke,Away,REG,L,80,70,L,+3.5,O,x,\n')
    rows = cleaning.clean_team_rows(readers.read_team_rows(spark, str(tmp_path))).orderBy("team_id").collect()
    assert [(r["team_id"], r["date_parsed"], r["team_score"], r["spread"], r["total"], r["file"]) for r in rows] == [
        (7, dt.date(2025, 1, 5), 80.0, -3.5, 140.0, "a.csv"), (8, dt.date(2025, 1, 5), 70.0, 3.5, None, "a.csv")
    ]


def test_name_map_headers_and_order(spark, tmp_path):
    (tmp_path / "old.csv").write_text("team_name,canonical_name\nA,B\n")
    assert readers.read_name_map(spark, str(tmp_path / "new.csv"), str(tmp_path / "old.csv")).first()["canonical_name"] == "B"
    assert readers.read_name_map(spark, str(tmp_path / "none.csv")).count() == 0


def test_season_sink_is_ordered(spark, tmp_path):
    rows = spark.range(2000).selectExpr("id AS game_key", "IF(id % 3 = 0, '2023-24', '2024-25') AS season", "date_add(date'2024-01-01', CAST(id % 97 AS INT)) AS date", "concat('t', id % 11) AS team_a")
    path = str(tmp_path / "games")
    writers.write_by_season(rows, path)
    back = spark.read.parquet(path)
    assert back.count() == 2000 and {r[0] for r in back.select("season").distinct().collect()} == {"2023-24", "2024-25"}


def test_predictions_of_a_day_are_replaced(spark, tmp_path):
    path = str(tmp_path / "p")
    day = lambda d, n: spark.range(n).selectExpr("id", f"date'{d}' AS pred_date")
    writers.write_predictions(day("2025-01-01", 3), path)
    writers.write_predictions(day("2025-01-02", 2), path)
    writers.write_predictions(day("2025-01-02", 5), path)
    assert spark.read.parquet(path).count() == 8


def test_scratch_uses_the_named_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    path = scratch.scratch_path(spark, "x")
    assert "/matchline/x-" in path and (named is None or path.startswith(named))
    assert path != scratch.scratch_path(spark, "x")
    assert scratch.materialise(spark.range(5), "r").count() == 5


def test_csv_files_in_many_blocks(spark, tmp_path):
    a = [f"{i},x{i},{i * 2}" for i in range(200)]
    b = [f'{i * 2},{i},"q, ""{i}"""' for i in range(200, 400)]
    (tmp_path / "a b,c.csv").write_text("\n\n".join(["\ufeffkey,name,v,", *[x + "," for x in a]]) + "\n")
    (tmp_path / "b.csv").write_text("\r\n".join(["v, key ,name", *b]))
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "only_header.csv").write_text("zz,key\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        df = readers.scan_csv(spark, str(tmp_path), file=F.col("_metadata.file_name"))
        assert set(df.columns) == {"key", "v", "zz", "name", "_c3", "file", "reject_reason"}
        got = sorted((int(r.key), r.name, int(r.v), r.zz, r.reject_reason) for r in df.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = [(i, f"x{i}", i * 2, None, None) for i in range(200)] + [(i, f'q, "{i}"', i * 2, None, None) for i in range(200, 400)]
    assert got == want


def test_csv_lines_that_do_not_fit_their_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,v,w\n1,2,3\n4,5\n6,7,8,9\n10,,\n"11,12,13\n14,15,16,17,18,19,20\n')
    got = {r.k: (r.v, r.w, r.reject_reason) for r in readers.scan_csv(spark, str(tmp_path)).collect()}
    assert got["1"] == ("2", "3", None) and got["10"] == (None, None, None)
    assert got["4"] == ("5", None, "too few cells") and got["6"] == ("7", "8", "too many cells") and got["14"] == ("15", "16", "too many cells")
    assert len(got) == 6 and [v[2] for k, v in got.items() if k and k.startswith("11")] == ["too many cells"]


def test_csv_is_read_once(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n1,2\n")
    plan = readers.scan_csv(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "FileScan text" not in plan and "FileScan csv" not in plan and "FileScan parquet" in plan


def test_names_are_looked_up_once_per_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n3,4\n")
    (tmp_path / "b.csv").write_text("y,z,x\n5,6,7\n8\n")
    rows = readers.scan_csv(spark, str(tmp_path / "*.csv"))
    top = rows._jdf.queryExecution().optimizedPlan().toString().splitlines()[0]
    assert "Project" in top and "_places" in top and "_names" not in top
    got = {(r.x, r.y, r.z, r.reject_reason) for r in rows.collect()}
    assert got == {("1", "2", None, None), ("3", "4", None, None), ("7", "5", "6", None), (None, "8", None, "too few cells")}
