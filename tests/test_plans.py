"""Physical plans and skew: what must not appear, and what must not change the result."""

import re

import pytest
from pyspark.sql import functions as F

from checks import catalog
from checks.fixtures import Data
from matchline.operators import asof, cleaning, joins, names, pairing
from matchline.plans import daily, features
from matchline.streaming import daily as stream

NAMES = ["edge_buckets", "threshold_sweep", "weight_search_roi", "bootstrap_threshold_stability", "rolling_rate", "ew_mean", "asof_snapshot_join",
         "pair_two_sided_rows", "token_overlap_join", "containment_theta_join", "expanding_folds", "feature_table", "resolve_names_staged", "daily_picks"]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_no_python_rows_no_products(spark, folder, name):
    text = plan_of(catalog.REG.queries[name](spark, folder))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in text


@pytest.mark.parametrize("name", [n for n in NAMES if n not in ("asof_snapshot_join", "feature_table", "expanding_folds")])
def test_no_window_over_one_partition(spark, folder, name):
    """The exceptions order distinct calendar days only."""
    text = plan_of(catalog.REG.queries[name](spark, folder))
    assert not re.search(r"Window [^\n]*\n[^\n]*Sort [^\n]*\n[^\n]*Exchange SinglePartition", text)


def judged(spark, folder):
    rows = cleaning.clean_team_rows(Data(spark, folder).team_rows)
    return pairing.judged_keys(pairing.keyed_rows(rows, names.resolve_opponent_ids(rows)))


def test_pairing_aggregates_before_the_shuffle(spark, folder):
    text = plan_of(judged(spark, folder))
    assert "partial_min(struct" in text and "collect_list" not in text


def test_games_read_the_written_verdicts_only(spark, folder):
    rows = cleaning.clean_team_rows(Data(spark, folder).team_rows)
    done = pairing.pair_landed(rows, names.resolve_opponent_ids(rows))
    text = plan_of(done.games)
    assert text.count("FileScan") == 1 and "Exchange" not in text and "Aggregate" not in text
    assert done.conserved() and done.counts["games"] == done.games.count()
    assert done.counts["rows_in"] - 2 * done.counts["games"] == done.rejects.count()


def test_lookups_join_by_their_measured_size(spark, folder):
    facts = spark.read.parquet(f"{folder}/lineitem.parquet").select("l_partkey", "l_quantity")
    derived = facts.select("l_partkey").distinct().withColumn("v", F.col("l_partkey") * 2)
    # The estimate alone would not do: the map is measured, found small and broadcast; a large one is shuffled.
    assert "BroadcastHashJoin" in plan_of(joins.lookup_join(facts, derived, ["l_partkey"], growth=10**9))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        text = plan_of(joins.lookup_join(facts, derived, ["l_partkey"], limit=100))
        assert "SortMergeJoin" in text and "_salt" not in text
        assert "BroadcastHashJoin" in plan_of(joins.lookup_join(facts, derived, ["l_partkey"]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pairing_broadcasts_the_opponent_map(spark, folder):
    """The map is distinct names of the facts: small whatever its estimate says."""
    assert "BroadcastHashJoin" in plan_of(judged(spark, folder))


def test_scan_reads_only_needed_columns(spark, folder):
    text = plan_of(catalog.REG.queries["edge_buckets"](spark, folder))
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in text


def test_salted_join_equals_plain_join(spark):
    left = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"))
    right = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    plain = left.join(right, "k", "left").select("id", "k", "v")
    salted = joins.salted_left_join(left, right, ["k"]).select("id", "k", "v")
    assert salted.count() == 5000 and plain.exceptAll(salted).count() == 0
    forced = joins.lookup_join(left, right, ["k"], limit=0).select("id", "k", "v")
    assert plain.exceptAll(forced).count() == 0


def test_feature_order(spark, folder):
    d = Data(spark, folder)
    cols = features.feature_table(d["games"], d["ratings"]).columns
    assert cols[:10] == ["game_key", "season", "date", "team_a", "team_b", "is_home_a", "is_neutral", "spread_a", "final_margin_a", "cover_a"]
    assert cols.index("kp_adj_em_a") < cols.index("rest_days_a") < cols.index("rolling_ats_a") < cols.index("ew_margin_a")


def test_stream_equals_batch(spark, tmp_path):
    docs = [
        '{"id": "%d", "commence_time": "2025-01-01T00:00:00Z", "home_team": "Duke", "away_team": "iowa state", "bookmakers": [{"markets": [{"key": "spreads", "outcomes": [{"name": "Duke", "point": %s}, {"name": "iowa state", "point": 1}]}]}]}'
        % (i, p)
        for i, p in ((1, -3.5), (2, 40.0))
    ]
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text("\n".join(docs) + "\n" + docs[0] + "\n")
    ratings = spark.createDataFrame([("Duke", 20.0, 110.0, 90.0, 70.0), ("Iowa State", 5.0, 105.0, 100.0, 66.0)], "TeamName string, AdjEM double, AdjOE double, AdjDE double, AdjTempo double")
    canonical = ratings.select(F.col("TeamName").alias("canonical_name"))
    mapping = spark.createDataFrame([], "raw_name string, canonical_name string")
    score = lambda df: daily.score_day(df, canonical, mapping, ratings, rating_date=None).select("id", *daily.PREDICTION_COLUMNS)
    q = stream.start_daily_picks(stream.odds_stream(spark, str(folder)), score, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert q.exception() is None
    got = {r["id"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert set(got) == {"1", "2"}
    assert got["1"]["home_kp"] == "Duke" and got["1"]["away_kp"] == "Iowa State"
    assert got["1"]["pred_margin"] == pytest.approx(15 * 68 / 100 + 3.5) and got["1"]["pick"] == "Duke -3.5"


def test_history_is_computed_once_for_both_sides(spark, folder):
    from matchline.operators import history

    df = history.history_features(Data(spark, folder)["games"])
    df._jdf.queryExecution().executedPlan().execute().count()
    final = plan_of(df).split("== Initial Plan ==")[0]
    assert final.count("ReusedExchange") == 1


@pytest.fixture()
def uncoalesced(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_hot_keys_meet_a_broadcast_side_and_the_rest_is_shuffled(uncoalesced):
    spark = uncoalesced
    left = spark.range(8000).select("id", F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 11 == 0, None).otherwise(F.col("id") % 900).alias("k"), (F.col("id") % 2).alias("d"))
    right = spark.range(0, 900).select(F.col("id").alias("k"), F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("d"), (F.col("id") * 10).alias("v"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("w"))
    right = right.filter("k % 4 > 0")
    joined = joins.hybrid_left_join(left, right, ["k", "d"], limit=0)
    text = plan_of(joined)
    assert "BroadcastHashJoin" in text and "SortMergeJoin" in text and "_salt" in text
    assert joined.columns == ["id", "k", "d", "v", "w"]
    want = left.join(right, ["k", "d"], "left").select(*joined.columns)
    assert joined.exceptAll(want).isEmpty() and want.exceptAll(joined).isEmpty()
    sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 8000 / 8
    hot = joins.frequent_hashes(left, ["k", "d"], 1 / 32)
    assert set(r.h for r in left.filter("k = 7").select(F.xxhash64("k", "d").alias("h")).distinct().collect()) <= set(hot) and len(hot) <= 64
    none = joins.hybrid_left_join(left.limit(0), right, ["k", "d"], limit=0)
    assert none.count() == 0


def test_unbounded_snapshots_with_a_hot_entity(uncoalesced, monkeypatch):
    import datetime as dt

    spark = uncoalesced
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    games = [(i, dt.date(2020, 1, 1) + dt.timedelta(i % 700) if i % 50 else None, "hot" if i % 3 == 0 else f"t{i % 40}", f"t{i % 37}") for i in range(1500)]
    ratings = [(t, dt.date(2019 + y, 7, 1), float(hash((t, y)) % 97)) for y in range(3) for t in ["hot", *[f"t{k}" for k in range(0, 40, 2)]] if (t, y) != ("t4", 1)]
    got = asof.asof_snapshot_join(
        spark.createDataFrame(games, "game_key int, date date, team_a string, team_b string"), spark.createDataFrame(ratings, "TeamName string, snapshot_date date, AdjEM double"), {"AdjEM": "em"}, tolerance=None
    )
    assert "_salt" in plan_of(got)
    by, days = {(t, d): v for t, d, v in ratings}, sorted({d for _, d, _ in ratings})
    for r in got.collect():
        _, day, a, b = games[r.game_key]
        snap = max((d for d in days if day and d < day), default=None)
        assert (r.kp_snapshot_date, r.em_a, r.em_b) == (snap, by.get((a, snap)), by.get((b, snap)))
    assert got.count() == 1500


def test_names_of_the_day_are_resolved_once(spark, folder, monkeypatch):
    written, write = [], joins.materialise

    def record(df, name):
        written.append(df.columns)
        return write(df, name)

    monkeypatch.setattr(joins, "materialise", record)
    monkeypatch.setattr(daily, "materialise", record)
    catalog.REG.queries["score_day"](spark, folder)
    assert written.count(["raw_name", "canonical_name"]) == 1
    assert not [c for c in written if "home_kp" in c or "away_kp" in c]
