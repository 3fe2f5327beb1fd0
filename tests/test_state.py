"""State tables per micro-batch against the batch job."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from matchline.operators import history as H
from matchline.operators import joins, prefix_scan
from matchline.streaming import state
from test_history import matches


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def close(a, b):
    for x, y in zip(a, b, strict=True):
        assert x[0] == y[0] and x[1] == y[1] and tuple(x[2:]) == pytest.approx(tuple(y[2:]))
    return len(a) > 0


def features(df):
    return rows_of(state.history_now(df).select("entity", "last_date", "rolling_rate", F.coalesce("ew_margin", F.lit(-999.0)), F.coalesce("ew_points", F.lit(-999.0))))


def test_history_of_batches_in_any_order_is_that_of_the_batch_job(spark, tmp_path):
    games, _ = matches(spark, 260, 12, 40, 0.5, 7, 5)
    path = str(tmp_path / "h")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
    try:
        # The middle goes first, then the end, then the start, with some matches landing twice.
        cuts = ["date BETWEEN '2000-01-14' AND '2000-01-27'", "date > '2000-01-25'", "date < '2000-01-14' OR game_key % 5 = 0"]
        for i, cut in enumerate(cuts):
            state.update_history(games.filter(cut), i, path)
        got = state.current(spark, path + "/state")
        whole = prefix_scan.entity_states(H.unpivot_sides(games), state.MEASURES, 10, 5.0)
        assert close(features(got), features(whole))
        # The same features before a match far ahead, from the batch operator.
        ahead = spark.createDataFrame([(10_000 + i, dt.date(2050, 1, 1), i, (i + 1) % 5 + 100) for i in range(5)], "game_key long, date date, team_a long, team_b long")
        columns = {c: F.lit(None).cast("double") for c in ("cover_a", "points_a", "points_b", "final_margin_a")}
        days = H.entity_day_history(games.unionByName(ahead.withColumns(columns).select(*games.columns)), ("rolling", "ew"))
        want = rows_of(days.filter("date = '2050-01-01' AND entity < 100").select("entity", F.lit(0), "rolling_rate", F.coalesce("ew_margin", F.lit(-999.0)), F.coalesce("ew_points", F.lit(-999.0))))
        assert close([(r[0], 0, *r[2:]) for r in features(got)], want)
        before = rows_of(got)
        state.update_history(games.filter(cuts[2]), 2, path)
        assert rows_of(state.current(spark, path + "/state")) == before
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_ratings_keep_the_newest_row(spark, tmp_path):
    rows = [("a", dt.date(2024, 1, d), float(d)) for d in (3, 1, 9)] + [("b", dt.date(2024, 1, 2), 5.0), ("b", dt.date(2024, 1, 2), 4.0), ("c", None, 1.0)]
    df = spark.createDataFrame(rows, "TeamName string, snapshot_date date, AdjEM double")
    path = str(tmp_path / "r")
    for i, part in enumerate([rows[2:4], rows[:2], rows[4:]]):
        state.update_ratings(spark.createDataFrame(part, df.schema), i, path)
    want = rows_of(joins.newest_row_per_key(df, ["TeamName"], F.col("snapshot_date")))
    assert rows_of(state.current(spark, path)) == want
    state.update_ratings(spark.createDataFrame(rows[4:], df.schema), 2, path)
    assert rows_of(state.current(spark, path)) == want
    assert state.current(spark, str(tmp_path / "none")) is None


def test_a_stream_keeps_the_state(spark, tmp_path):
    source, path = tmp_path / "in", str(tmp_path / "s")
    schema = "TeamName string, snapshot_date date, AdjEM double"
    for i, day in enumerate((5, 2, 8)):
        spark.createDataFrame([("a", dt.date(2024, 1, day), float(day)), (f"t{i}", dt.date(2024, 1, 1), 0.0)], schema).coalesce(1).write.mode("append").json(str(source))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
    state.start_state(stream, state.update_ratings, path, str(tmp_path / "cp")).awaitTermination()
    got = {r.TeamName: r.AdjEM for r in state.current(spark, path).collect()}
    assert got == {"a": 8.0, "t0": 0.0, "t1": 0.0, "t2": 0.0}


def test_partitions_leave_one_state_per_entity(spark):
    games, pdf = matches(spark, 300, 5, 20, 0.7, 6, 4)
    changed = {"spark.sql.execution.arrow.maxRecordsPerBatch": "7", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in changed}
    whole = rows_of(prefix_scan.entity_states(H.unpivot_sides(games), state.MEASURES, 10, 5.0).select("entity", "n", "last", "results", "margin.s", "margin.w", "margin.at", "margin.k"))
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        torn = rows_of(prefix_scan.entity_states(H.unpivot_sides(games), state.MEASURES, 10, 5.0).select("entity", "n", "last", "results", "margin.s", "margin.w", "margin.at", "margin.k"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [r[:4] for r in torn] == [r[:4] for r in whole] and sum(r[1] for r in torn) == 2 * len(pdf)
    assert all(a[4:] == pytest.approx(b[4:]) for a, b in zip(torn, whole, strict=True))
