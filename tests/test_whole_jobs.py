"""The registered queries ask for the whole job: default fits, all feature sets, uncut views."""

import threading

import pytest
from pyspark.sql import functions as F

from checks.catalog import REG
from checks.fixtures import Data
from matchline.functions import fixed
from matchline.operators import models
from matchline.plans import backtest


class Asked(Exception):
    pass


@pytest.mark.parametrize("name", ["gbt_fit", "score_models", "save_load_model", "top_feature_importance", "holdout_evaluation", "holdout_summary", "cross_validation", "ablation_table"])
def test_fits_take_the_default_parameters(spark, folder, monkeypatch, name):
    def fit(train, features, label="final_margin_a", params=None):
        raise Asked(params)

    monkeypatch.setattr(models, "gbt_fit", fit)
    with pytest.raises(Asked) as asked:
        REG.queries[name](spark, folder)
    assert not asked.value.args[0]


def test_ablation_takes_the_six_sets(spark, folder, monkeypatch):
    def table(df, sets, *splits):
        assert sets == fixed.ABLATION_SETS and not {c for s in sets.values() for c in s} - set(df.columns)
        raise Asked

    monkeypatch.setattr(backtest, "ablation_table", table)
    with pytest.raises(Asked):
        REG.queries["ablation_table"](spark, folder)


def test_ratings_are_read_uncut(spark, folder):
    orders = Data(spark, folder)["orders"]
    n = orders.select(F.col("o_custkey") % 200, F.trunc("o_orderdate", "month")).distinct().count()
    assert REG.queries["rename_to_canonical"](spark, folder).count() == n
    assert REG.queries["scan_fail_on_empty"](spark, folder).first().n_rows == n


def test_folds_and_sets_are_fitted_side_by_side(spark, folder, monkeypatch):
    both = threading.Barrier(2, timeout=60)

    def fit(train, features, *args, **kwargs):
        both.wait()
        raise Asked

    monkeypatch.setattr(models, "fit_models", fit)
    games = Data(spark, folder)["games"].withColumn("kp_matched", F.lit(True)).filter("spread_a IS NOT NULL")
    with pytest.raises(Asked):
        backtest.cross_validation(games, ["spread_a"], 2)
    with pytest.raises(Asked):
        backtest.ablation_table(games, {"a": ["spread_a"], "b": ["spread_a", "total_line"]}, [1995], [1996], [1997])


def test_tree_fits_pass_even_partitions(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(models.Pipeline, "fit", lambda self, df: seen.append(df))
    rows = spark.range(0, 6000, 1, 1).union(spark.range(6000, 6300, 1, 2)).select(F.col("id").cast("double").alias("x"), F.lit(1.0).alias("final_margin_a"))
    sizes = lambda df: sorted(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())
    models.gbt_fit(rows, ["x"])
    assert sizes(seen[-1]) == [150, 150, 6000]  # few rows stay as they lie

    monkeypatch.setattr(models, "EVEN_FROM", 5000)
    cores = spark.sparkContext.defaultParallelism
    models.gbt_fit(rows, ["x"])
    dealt = sizes(seen[-1])
    assert len(dealt) == cores and dealt[-1] - dealt[0] <= 3
    assert sorted(r.x for r in seen[-1].collect()) == list(range(6300))

    monkeypatch.setattr(models, "MOST_ROWS", 500)
    models.gbt_fit(rows, ["x"])
    dealt = sizes(seen[-1])
    assert len(dealt) % cores == 0 and dealt[-1] <= 503
    models.gbt_fit(seen[-1], ["x"])
    assert sizes(seen[-1]) == dealt  # even rows are not dealt again
