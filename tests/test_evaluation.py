"""Invariants of the evaluation tables and the calibration state."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.fixtures import Data
from matchline.operators import calibration as C
from matchline.operators import evaluation as E
from matchline.operators import models as M
from matchline.functions import fixed


@pytest.fixture(scope="module")
def games(spark, folder):
    rows = Data(spark, folder)["games"].cache()
    yield rows
    rows.unpersist()


def test_counts_agree(games):
    total = E.evaluate_line(games, "pred_ridge").first()
    buckets = E.edge_buckets(games, "pred_ridge").collect()
    assert sum(r["n_games"] for r in buckets) == total["n_bets"]
    both = games.filter("pred_dnn is not null")
    agree = E.model_agreement(both, ["pred_ridge", "pred_gbm", "pred_dnn"]).collect()
    assert sum(r["n_games"] for r in agree) == E.evaluate_line(both, "pred_ridge").first()["n_bets"]
    sweep = E.threshold_sweep(games, pred="pred_ridge").orderBy("threshold").collect()
    assert all(a["n_bets"] >= b["n_bets"] for a, b in zip(sweep, sweep[1:]))
    at5 = next(r for r in sweep if r["threshold"] == 5.0)
    assert at5["n_bets"] == sum(r["n_games"] for r in buckets if r["bucket"] in ("5-7 pts", "7-10 pts", "10+ pts"))
    for r in [*sweep, *buckets]:
        assert abs(r["roi"] - (r["hit_rate"] * (1 + 100 / 110) - 1)) < 1e-9


def test_awkward_rows(spark):
    rows = spark.createDataFrame(
        [(1, 3.0, -3.0, 0.0), (2, 3.0, -3.0, 1.0), (3, float("nan"), -3.0, 1.0), (4, 9.0, None, 1.0), (5, 9.0, -1.0, 0.5), (6, 9.0, -1.0, 1.0), (7, 9.0, -1.0, None)],
        "k int, pred double, spread_a double, cover_a double",
    )
    r = E.evaluate_line(rows).first()
    # A zero edge backs side B; NaN, missing lines and pushes never bet but count as rows.
    assert (r["n_games"], r["n_bets"]) == (7, 3)
    assert r["hit_rate"] == pytest.approx(2 / 3)
    assert E.evaluate_line(rows, threshold=8.0).first()["n_bets"] == 1
    none = E.evaluate_line(rows, threshold=99.0).first()
    assert (none["n_bets"], none["hit_rate"], none["roi"], none["pct_games_bet"]) == (0, 0.0, 0.0, 0.0)
    assert E.tune_threshold(rows).first()["threshold"] == 0.0


def test_group_and_single_agree(games):
    by = {r["season"]: r for r in E.evaluate_by_group(games, {"m": "pred_gbm"}, ["season"]).collect()}
    for r in E.evaluate_line(games, "pred_gbm", margin="final_margin_a", by=["season"]).collect():
        assert by[r["season"]]["n_bets"] == r["n_bets"] and by[r["season"]]["mae"] == pytest.approx(r["mae"])


def test_rowwise_ensemble(spark):
    rows = spark.createDataFrame([(1.0, 2.0, 3.0), (1.0, 2.0, None), (None, 2.0, 3.0), (None, None, None), (1.0, None, None)], "pred_ridge double, pred_gbm double, pred_dnn double")
    got = [r[0] for r in rows.select(E.ensemble_rowwise()).collect()]
    assert got[:3] == pytest.approx([0.1 + 0.4 + 2.1, 1.6, (0.4 + 2.1) / 0.9])
    assert got[3] is None and got[4] == pytest.approx(1.0)


def test_isotonic_is_monotone_and_bounded(games):
    model = C.fit_isotonic(games, "pred_gbm")
    rows = C.isotonic_calibrate(E.with_edge(games, "pred_gbm"), model).filter("edge is not null")
    pts = rows.select(F.abs("edge").alias("x"), "cover_prob").distinct().orderBy("x").collect()
    p = [r["cover_prob"] for r in pts]
    assert all(a <= b + 1e-12 for a, b in zip(p, p[1:])) and min(p) >= 0.4 and max(p) <= 0.7


def test_poisson_weights_have_mean_one(games):
    rois = C.bootstrap_rois(games, thresholds=[0.0], pred="pred_gbm").collect()
    n = E.evaluate_line(games, "pred_gbm").first()["n_bets"]
    draws = np.array([r["n_bets"] for r in rois])
    assert len(draws) == 100 and abs(draws.mean() / n - 1) < 0.02
    assert 0.5 < draws.std() / np.sqrt(n) < 1.6


def test_calibration_roundtrip(spark, games, tmp_path):
    cal = C.calibration_fit(games)
    assert abs(sum(cal.weights.values()) - 1) < 1e-9 and 0.8 <= cal.temperature <= 1.5
    cal.save(spark, str(tmp_path / "cal"))
    back = C.Calibration.load(spark, str(tmp_path / "cal"))
    assert (back.weights, back.temperature, back.threshold, back.buckets) == (cal.weights, cal.temperature, cal.threshold, cal.buckets)
    a = C.calibrated_bet_mask(games, cal, min_prob=0.5).filter("is_bet")
    b = C.calibrated_bet_mask(games, back, min_prob=0.5).filter("is_bet")
    assert a.count() == b.count()
    assert a.filter(F.abs("edge") < cal.threshold).count() == 0


def test_no_stable_threshold_falls_back(games):
    empty = C.bootstrap_threshold_stability(C.bootstrap_rois(games.limit(0), pred="pred_gbm"))
    assert C.stable_threshold(empty) == fixed.DEFAULT_THRESHOLD


def test_ridge_matches_closed_form(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3)) * [1, 10, 0.1] + [5, -2, 0]
    y = x @ [1.0, -0.3, 4.0] + rng.normal(size=300)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, c double, final_margin_a double")
    got = np.array([r[0] for r in M.score_models(df, {"ridge": M.ridge_fit(df, ["a", "b", "c"])}).select("pred_ridge").collect()])
    z = (x - x.mean(0)) / x.std(0)
    w = np.linalg.solve(z.T @ z + np.eye(3), z.T @ (y - y.mean()))
    np.testing.assert_allclose(got, z @ w + y.mean(), atol=1e-9)


def test_trees_beat_the_mean_and_survive_saving(spark, games, tmp_path):
    rows = games.filter("spread_a is not null").withColumn("x", F.col("final_margin_a") + F.col("pred_gbm") / 10).withColumn("n", F.lit(None).cast("double"))
    model = M.gbt_fit(rows.withColumn("n", F.lit(0.0)), ["x", "n"], params={"maxIter": 15, "stepSize": 0.3})
    scored = M.score_models(rows, {"gbm": model})
    r = scored.agg(F.avg(F.abs(F.col("final_margin_a") - F.col("pred_gbm"))).alias("e"), F.avg(F.abs("final_margin_a")).alias("m")).first()
    assert r["e"] < 0.5 * r["m"]
    assert scored.filter("n is not null").count() == 0
    M.save_models({"gbm": model}, str(tmp_path / "m"), {"gbm": 1.0}, 4.5, spark)
    loaded, weights, threshold = M.load_models(str(tmp_path / "m"), spark)
    assert (weights, threshold) == ({"gbm": 1.0}, 4.5)
    assert M.feature_importance(loaded["gbm"], spark).first()["feature"] == "x"


def test_selective_backtest_measures_the_mask(spark, games):
    from matchline.plans import backtest as B

    val, test = games.filter("season <= 1998"), games.filter("season > 1998")
    out = {r["strategy"]: r for r in B.selective_backtest(val, test).collect()}
    cal = C.calibration_fit(val)
    rows = C.calibrated_bet_mask(test, cal).withColumn("raw", E.combine_weighted(cal.weights, list(cal.weights)) + F.col("spread_a")).toPandas()
    decided = rows[rows.cover_a.isin([0.0, 1.0])]

    def expected(edge, chosen):
        bets = decided[chosen & edge.notna()]
        hits = np.where(edge[bets.index] > 0, bets.cover_a == 1.0, bets.cover_a == 0.0)
        return len(bets), int(hits.sum())

    raw, scaled = decided.raw, decided.edge
    cases = {
        "all": (raw, raw.notna()), "threshold": (raw, raw.abs() >= cal.threshold), "scaled": (scaled, scaled.abs() >= cal.threshold),
        "band": (raw, (raw.abs() >= 5) & (raw.abs() < 7)), "calibrated": (scaled, decided.is_bet),
    }
    assert set(out) == set(cases)
    for name, (edge, chosen) in cases.items():
        n, wins = expected(edge, chosen)
        assert out[name]["n_bets"] == n, name
        assert out[name]["hit_rate"] == pytest.approx(wins / n if n else 0.0) and out[name]["roi"] == pytest.approx((wins * 100 / 110 - (n - wins)) / n if n else 0.0)


def test_weight_grid_is_a_plain_loop(spark):
    rng = np.random.default_rng(4)
    rows = [tuple(None if rng.random() < 0.1 else float(v) for v in rng.normal(0, 6, 4)) + (float(rng.choice([0.0, 0.5, 1.0])),) for _ in range(200)]
    rows.append((1.0, float("nan"), 2.0, 3.0, 1.0))
    df = spark.createDataFrame(rows, "pred_a double, pred_b double, pred_c double, spread_a double, cover_a double")
    got = {r.grid_pos: r for r in C.weight_grid(df, ["a", "b", "c"], 2.0, steps=3).collect()}
    for i, ws in enumerate(C.simplex_lattice(3, 3)):
        edges = [(ws[0] * a + ws[1] * b + ws[2] * c + s, y) for a, b, c, s, y in rows if None not in (a, b, c, s) and y != 0.5]
        bets = [(e, y) for e, y in edges if abs(e) >= 2.0]
        r = got[i]
        assert (r.w_a, r.w_b, r.w_c) == ws and r.n_bets == len(bets)
        assert r.hit_rate == pytest.approx(sum((e > 0) == (y == 1.0) for e, y in bets) / len(bets))
    assert len(got) == 10
    assert all(r.n_bets == 0 for r in C.weight_grid(df.limit(0), ["a", "b", "c"], 2.0, steps=3).collect())


def plain_poisson(u, mean):
    """The least k whose cumulative probability reaches u, in logarithms."""
    total, k = 0.0, 0
    while True:
        total += math.exp(k * math.log(mean) - mean - math.lgamma(k + 1))
        if total >= u or k > mean + 12 * math.sqrt(mean) + 30:
            return k
        k += 1


def test_poisson_draws_invert_the_distribution(spark):
    rng = np.random.default_rng(6)
    cases = [(float(u), float(m)) for m in (1, 2, 7, 30, 255, 256, 257, 900, 20_000) for u in (*rng.random(60), 1e-9, 1 - 1e-9, 0.02425, 0.5)]
    got = spark.createDataFrame(cases, "u double, mean double").select("*", C.poisson_quantile(F.col("u"), F.col("mean")).alias("k")).collect()
    for r in got:
        want = plain_poisson(r.u, r.mean)
        assert r.k == want if r.mean <= C.EXACT_MEAN else abs(r.k - want) <= 1
    wide = [r.k == plain_poisson(r.u, r.mean) for r in got if r.mean > C.EXACT_MEAN and 1e-6 < r.u < 1 - 1e-6]
    assert sum(wide) / len(wide) > 0.97
    assert spark.range(1).select(C.poisson_quantile(F.lit(0.3), F.lit(0.0)).alias("k")).first().k == 0


def test_replicates_are_poisson_sums(spark):
    rows = [(i, 5.0 + i % 3, 0.0, float(i % 2)) for i in range(3000)]
    df = spark.createDataFrame(rows, "game_key long, pred double, spread_a double, cover_a double")
    rois = C.bootstrap_rois(df, thresholds=[0.0, 5.5, 6.5], n_bootstrap=400).toPandas()
    by = rois.groupby("threshold")["n_bets"].agg(["mean", "std", "count"])
    for t, n in ((0.0, 3000), (5.5, 2000), (6.5, 1000)):
        assert abs(by.loc[t, "mean"] - n) < 5 * math.sqrt(n / 400) and 0.85 < by.loc[t, "std"] / math.sqrt(n) < 1.15
    again = C.bootstrap_rois(df.repartition(5), thresholds=[0.0, 5.5, 6.5], n_bootstrap=400).toPandas()
    key = ["rep", "threshold"]
    assert rois.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))
    other = C.bootstrap_rois(df, thresholds=[0.0], n_bootstrap=5, seed=1).toPandas()
    assert set(other.n_bets) != set(rois[(rois.threshold == 0.0) & (rois.rep <= 5)].n_bets)


def test_each_row_is_drawn_in_each_replicate(spark):
    rows = [(None if i == 5 else i // 2, 2.0 + i % 4, 0.0, float(i % 3 == 0)) for i in range(80)]
    df = spark.createDataFrame(rows, "game_key long, pred double, spread_a double, cover_a double")
    got = {(r.rep, r.threshold): r.n_bets for r in C.bootstrap_rois(df, thresholds=[3.0, 4.5], n_bootstrap=10).collect()}
    want = {}
    for key, pred, _, _ in rows:
        for rep in range(1, 11):
            digest = hashlib.md5(f"{'' if key is None else key}:{(rep - 1) // 4}".encode()).hexdigest()
            digits, weight, total = int(digest[8 * ((rep - 1) % 4) :][:8], 16), 0, math.exp(-1.0)
            while digits >= int(total * 16**8):
                weight += 1
                total += math.exp(-1.0) / math.factorial(weight)
            for t in (3.0, 4.5):
                if pred >= t:
                    want[rep, t] = want.get((rep, t), 0) + weight
    assert got == {k: n for k, n in want.items() if n}
