"""History features against pandas on long, gappy and hot histories."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from matchline.operators import history as H
from matchline.operators import prefix_scan


def matches(spark, n, seed, days, hot=0.4, null_every=11, teams=6):
    """Random matches in which one entity holds a large share and double headers are common."""
    rng = np.random.default_rng(seed)
    a = np.where(rng.random(n) < hot, 0, rng.integers(1, teams, n))
    b = (a + 1 + rng.integers(0, teams - 1, n)) % teams
    cover = rng.choice([0.0, 1.0, 0.5, np.nan], n, p=[0.4, 0.4, 0.1, 0.1])
    pa, pb = rng.integers(50, 100, n).astype(float), rng.integers(50, 100, n).astype(float)
    pa[::null_every] = np.nan
    day = np.sort(rng.integers(0, days, n))
    pdf = pd.DataFrame({"game_key": rng.permutation(n), "date": [dt.date(2000, 1, 1) + dt.timedelta(int(x)) for x in day], "team_a": a, "team_b": b, "cover_a": cover, "points_a": pa, "points_b": pb})
    pdf["final_margin_a"] = pdf.points_a - pdf.points_b
    rows = [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in pdf.itertuples(index=False)]
    schema = "game_key long, date date, team_a long, team_b long, cover_a double, points_a double, points_b double, final_margin_a double"
    return spark.createDataFrame(rows, schema), pdf


def long_form(pdf):
    a = pdf[["game_key", "date", "team_a", "cover_a", "final_margin_a", "points_a"]].set_axis(["key", "date", "entity", "cover", "margin", "points"], axis=1)
    b = pdf[["game_key", "date", "team_b", "cover_a", "final_margin_a", "points_b"]].set_axis(["key", "date", "entity", "cover", "margin", "points"], axis=1)
    b = b.assign(cover=1 - b.cover, margin=-b.margin)
    return pd.concat([a, b]).sort_values(["entity", "date", "key"]).reset_index(drop=True)


@pytest.mark.parametrize(("n", "days", "hot"), [(600, 250, 0.4), (6000, 400, 0.9), (40, 12, 0.5)])
def test_ew_mean(spark, n, days, hot):
    df, pdf = matches(spark, n, 3, days, hot)
    long = long_form(pdf)
    for m in ("margin", "points"):
        long[m] = long.groupby("entity")[m].transform(lambda x: x.shift(1).ewm(halflife=5, min_periods=3).mean())
    want = long.groupby(["entity", "date"])[["margin", "points"]].first()
    got = H.entity_day_history(df, ("ew",)).toPandas().set_index(["entity", "date"]).sort_index()
    want = want.sort_index()
    assert len(got) == len(want)
    np.testing.assert_allclose(got["ew_margin"].astype(float), want["margin"], atol=1e-8, equal_nan=True)
    np.testing.assert_allclose(got["ew_points"].astype(float), want["points"], atol=1e-8, equal_nan=True)


def test_ew_mean_keeps_old_values_through_a_long_gap(spark):
    n = 1800
    values = [float(i) if i < 4 or i > 1600 else None for i in range(n)]
    rows = [(i, dt.date(2000, 1, 1) + dt.timedelta(i), 1, 2, None, v, 0.0, v) for i, v in enumerate(values)]
    schema = "game_key long, date date, team_a long, team_b long, cover_a double, points_a double, points_b double, final_margin_a double"
    got = H.entity_day_history(spark.createDataFrame(rows, schema), ("ew",)).filter("entity = 1").orderBy("date").toPandas()
    s = pd.Series([np.nan if v is None else v for v in values])
    want = s.shift(1).ewm(halflife=5, min_periods=3).mean()
    np.testing.assert_allclose(got["ew_margin"].astype(float), want, rtol=1e-9, equal_nan=True)


@pytest.mark.parametrize(("n", "days"), [(800, 300), (3000, 60)])
def test_rolling_rate(spark, n, days):
    df, pdf = matches(spark, n, 5, days)
    dec = long_form(pdf)
    dec = dec[dec.cover.isin([0, 1])].copy()
    dec["r"] = dec.groupby("entity")["cover"].transform(lambda x: x.shift(1).rolling(10, min_periods=3).mean()).fillna(0.5)
    want = dec.groupby(["entity", "date"])["r"].first()
    got = H.entity_day_history(df, ("rolling",), compat=True).toPandas().set_index(["entity", "date"])["rolling_rate"]
    np.testing.assert_allclose(got.loc[want.index], want, atol=1e-12)
    assert (got.drop(want.index) == 0.5).all()


def test_rest_days(spark):
    df, pdf = matches(spark, 500, 7, 900)
    long = long_form(pdf)[["entity", "date"]].drop_duplicates()
    gap = pd.to_datetime(long["date"]).groupby(long["entity"]).diff().dt.days.fillna(7).clip(upper=14)
    want = gap.set_axis(pd.MultiIndex.from_frame(long))
    got = H.entity_day_history(df, ("rest",)).toPandas().set_index(["entity", "date"])["rest_days"]
    assert (got.loc[want.index] == want).all()


def test_positions_are_a_permutation(spark):
    df, _ = matches(spark, 700, 9, 5)
    rows = H.expanding_folds(df).select("position", "date", "test_fold").orderBy("position").collect()
    assert [r[0] for r in rows] == list(range(700))
    assert [r[1] for r in rows] == sorted(r[1] for r in rows)
    sizes = pd.Series([r[2] for r in rows]).value_counts()
    assert all(sizes[k] == 700 // 6 for k in range(1, 6)) and sizes[0] == 700 - 5 * (700 // 6)


@pytest.fixture()
def torn(spark):
    """Many partitions and tiny batches, so that histories and days are cut often."""
    changed = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "13", "spark.sql.execution.arrow.maxRecordsPerBatch": "7"}
    before = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize(("n", "days", "hot", "teams"), [(900, 3, 0.9, 6), (500, 1, 1.0, 3), (400, 300, 0.3, 40), (700, 25, 0.6, 4), (30, 2, 0.5, 12)])
def test_histories_cut_anywhere_equal_pandas(torn, n, days, hot, teams):
    df, pdf = matches(torn, n, n, days, hot, 5, teams)
    got = H.entity_day_history(df).toPandas().set_index(["entity", "date"]).sort_index()
    long = long_form(pdf)
    for m in ("margin", "points"):
        long[f"ew_{m}"] = long.groupby("entity")[m].transform(lambda x: x.shift(1).ewm(halflife=5, min_periods=3).mean())
    first = long.groupby(["entity", "date"])[["ew_margin", "ew_points"]].first().sort_index()
    assert got.index.equals(first.index)
    for m in ("ew_margin", "ew_points"):
        np.testing.assert_allclose(got[m].astype(float), first[m], atol=1e-8, equal_nan=True)
    for (entity, date), r in got.iterrows():
        past = long[(long.entity == entity) & (long.date < date)]
        dec = past[past.cover.isin([0, 1])].cover.tail(10)
        assert r.rolling_rate == pytest.approx(dec.mean() if len(dec) >= 3 else 0.5)
        assert r.rest_days == (min((date - past.date.max()).days, 14) if len(past) else 7)


def test_old_values_survive_empty_partitions_of_values(torn):
    n = 400
    values = [float(i % 7) if i < 4 or i > 380 else None for i in range(n)]
    rows = [(f"k{i:05d}", dt.date(2000, 1, 1), "x", "y", None, v, 0.0, v) for i, v in enumerate(values)] + [("z", dt.date(2030, 1, 1), "x", "y", None, None, None, None)]
    schema = "game_key string, date date, team_a string, team_b string, cover_a double, points_a double, points_b double, final_margin_a double"
    got = H.entity_day_history(torn.createDataFrame(rows, schema), ("ew",)).filter("entity = 'x'").orderBy("date").toPandas()
    want = pd.Series([np.nan if v is None else v for v in values] + [np.nan]).shift(1).ewm(halflife=5, min_periods=3).mean()
    np.testing.assert_allclose(got["ew_margin"].astype(float), [want[3], want[n]], rtol=1e-9)


def test_a_hot_day_is_spread_and_never_ordered_as_a_whole(torn, capsys):
    df, _ = matches(torn, 3000, 2, 2, 0.95)
    parts = prefix_scan.day_parts(H.unpivot_sides(df), ["margin"], 10, 5.0, 3)
    assert parts.where("entity = 0").select("slice").distinct().count() >= 4
    dealt = parts.where("tail IS NOT NULL").select("tail.n", "tail.first", "tail.entity").collect()
    assert max(r.n for r in dealt) < 6000 / 13 * 2
    parts.explain()
    H.ew_mean(df).explain()
    H.rolling_rate(df).explain()
    plan = capsys.readouterr().out
    assert "rangepartitioning" in plan and "Window" not in plan


def test_merging_is_associative():
    rng = np.random.default_rng(1)

    def state():
        k = int(rng.integers(0, 4))
        n = k + int(rng.integers(0, 4))
        w = prefix_scan.Weighted(float(rng.random()), float(rng.random()) + 1, int(rng.integers(k, n + 1)) if k else 0, k) if k else prefix_scan.Weighted()
        return prefix_scan.State("e", n, int(rng.integers(100)), tuple(rng.integers(0, 2, k).astype(float)), {"m": w})

    for _ in range(200):
        a, b, c = state(), state(), state()
        left = prefix_scan.merge(prefix_scan.merge(a, b, 5, 2.0), c, 5, 2.0)
        right = prefix_scan.merge(a, prefix_scan.merge(b, c, 5, 2.0), 5, 2.0)
        assert (left.n, left.last_date, left.results) == (right.n, right.last_date, right.results)
        assert vars(left.measures["m"]) == pytest.approx(vars(right.measures["m"]))


def test_no_matches_and_missing_columns(spark):
    schema = "game_key long, date date, team_a long, team_b long, cover_a double, points_a double, points_b double, final_margin_a double"
    assert H.entity_day_history(spark.createDataFrame([], schema)).count() == 0
    bare = spark.createDataFrame([(1, dt.date(2020, 1, 1), 1, 2), (2, None, 1, 2), (3, dt.date(2020, 1, 5), 1, None)], "game_key long, date date, team_a long, team_b long")
    got = {(r.entity, r.date.day): (r.rest_days, r.rolling_rate, r.ew_margin) for r in H.entity_day_history(bare).collect()}
    assert got == {(1, 1): (7, 0.5, None), (2, 1): (7, 0.5, None), (1, 5): (4, 0.5, None)}
