"""Monotone fits against the max-min formula."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from matchline.operators import calibration as C
from matchline.operators import isotonic


def plain(x, y):
    """Fitted rate of each distinct distance: the greatest, over all starts, of the least mean over all ends."""
    g = pd.DataFrame({"x": x, "y": y}).groupby("x")["y"].agg(["sum", "count"])
    s, n = np.append(0, g["sum"].cumsum()), np.append(0, g["count"].cumsum())
    fit = np.full(len(g), -np.inf)
    for a in range(len(g)):
        means = (s[a + 1 :] - s[a]) / (n[a + 1 :] - n[a])
        fit[a:] = np.maximum(fit[a:], np.minimum.accumulate(means[::-1])[::-1])
    return g.index.to_numpy(), fit


def blocks_of(x, y):
    out = isotonic.pool(*isotonic.one_per_distance(x, x.copy(), np.ones(len(x), np.int64), y))
    assert (np.diff(out[3] / out[2]) > 0).all() and (out[0][1:] > out[1][:-1]).all()
    return out


@pytest.mark.parametrize("seed", range(12))
def test_pool_is_the_max_min_formula(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 90))
    x = np.sort(rng.random(n) if seed % 2 else rng.integers(0, 9, n).astype(float))
    y = (rng.random(n) < (0.2 + 0.6 * x / max(x.max(), 1)) if seed % 3 else rng.random(n) < 0.5).astype(np.int64)
    low, high, _, hits = blocks = blocks_of(x, y)
    points, fit = plain(x, y)
    at = np.searchsorted(low, points, "right") - 1
    assert (points <= high[at]).all()
    np.testing.assert_allclose((hits / blocks[2])[at], fit, atol=1e-12)


def test_passes_that_join_little_go_by_stack():
    # One miss-free start before a slow rise: each pass joins one block only.
    n = np.append(1, np.full(20_000, 20_001)).astype(np.int64)
    hits = np.append(1, np.arange(20_000)).astype(np.int64)
    low = np.arange(20_001).astype(float)
    out = isotonic.pool(low, low + 0.5, n, hits)
    assert (np.diff(out[3] / out[2]) > 0).all() and out[2].sum() == n.sum() and out[3].sum() == hits.sum()


@pytest.mark.parametrize("kind", ["continuous", "hot", "few", "rising"])
def test_pooled_over_many_ranges(spark, kind):
    rng = np.random.default_rng(5)
    n = 600
    x = {"continuous": rng.random(n), "hot": np.where(rng.random(n) < 0.6, 0.25, rng.random(n)), "few": rng.integers(0, 5, n) / 4, "rising": np.arange(n) / n}[kind]
    y = (np.arange(n) >= n // 2) if kind == "rising" else rng.random(n) < 0.3 + 0.4 * x
    rows = [(i, float(a), bool(b)) for i, (a, b) in enumerate(zip(x, y))] + [(n, None, True), (n + 1, float("nan"), True), (n + 2, 0.5, None)]
    changed = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "9", "spark.sql.execution.arrow.maxRecordsPerBatch": "11"}
    before = {k: spark.conf.get(k) for k in changed}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        got = isotonic.isotonic_blocks(spark.createDataFrame(rows, "k long, x double, y boolean"), F.col("x"), F.col("y")).orderBy("low").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = blocks_of(np.sort(x), np.asarray(y)[np.argsort(x, kind="stable")].astype(np.int64))
    assert [(r.low, r.high, r.n_rows, r.hits) for r in got] == list(zip(*[c.tolist() for c in want]))


def test_rounds_meet_in_fewer_ranges(spark, monkeypatch):
    monkeypatch.setattr(isotonic, "BLOCKS_PER_TASK", 2)
    seen, pooled = [], isotonic._pooled
    monkeypatch.setattr(isotonic, "_pooled", lambda rows: seen.append(pooled(rows)) or seen[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rng = np.random.default_rng(2)
        x = rng.random(900)
        y = rng.random(900) < x
        got = isotonic.isotonic_blocks(spark.createDataFrame([(float(a), bool(b)) for a, b in zip(x, y)], "x double, y boolean"), F.col("x"), F.col("y")).orderBy("low").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    order = np.argsort(x)
    assert [(r.low, r.n_rows, r.hits) for r in got] == [(a, n, h) for a, _, n, h in zip(*[c.tolist() for c in blocks_of(x[order], y[order].astype(np.int64))])]
    assert len(seen) >= 3 and all(b[2] < a[2] for a, b in zip(seen, seen[1:]))


def test_the_model_gets_blocks_only(spark):
    rng = np.random.default_rng(3)
    e = rng.normal(0, 8, 2000)
    rows = [(i, float(v), 0.0, float(rng.random() < 0.5 + min(abs(v), 20) / 60) if v > 0 else float(rng.random() > 0.5 + min(abs(v), 20) / 60)) for i, v in enumerate(e)]
    df = spark.createDataFrame(rows, "game_key long, pred double, spread_a double, cover_a double")
    model = C.fit_isotonic(df)
    assert len(model.boundaries) <= 2 * C.calibration_blocks(df).count() < 200
    hit = np.array([(v > 0) == (c == 1.0) for _, v, _, c in rows])
    points, fit = plain(np.abs(e), hit.astype(float))
    np.testing.assert_allclose([model.predict(p) for p in points[::37]], fit[::37], atol=1e-12)


def test_no_rows(spark):
    empty = spark.createDataFrame([], "x double, y boolean")
    assert isotonic.isotonic_blocks(empty, F.col("x"), F.col("y")).count() == 0
