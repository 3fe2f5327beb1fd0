"""Tree fits give the trees of Spark's GBTRegressor, in one task and over several."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from matchline.operators import boosting
from matchline.operators import models as M

PARAMS = {"maxIter": 6, "maxDepth": 4, "stepSize": 0.05, "subsamplingRate": 0.8, "minInstancesPerNode": 20, "seed": 42}


def _rows(spark, n, k, parts, tmp_path):
    rng = np.random.default_rng(n + k)
    x = rng.normal(size=(n, k)).round(3)
    x[:, 1] = rng.integers(0, 4, n)
    y = x[:, 0] * 3 + np.abs(x[:, 1] - 2) * x[:, 2 % k] + rng.normal(size=n)
    rows = pd.DataFrame(x, columns=[f"x{i}" for i in range(k)]).assign(final_margin_a=y.round(2))
    for i in range(parts):
        rows.iloc[i * n // parts : (i + 1) * n // parts].to_parquet(f"{tmp_path}/{i}.parquet")
    return spark.read.parquet(str(tmp_path)), [f"x{i}" for i in range(k)]


def _both(df, features):
    own = M.gbt_fit(df, features, params=PARAMS)
    rows = VectorAssembler(inputCols=features, outputCol="_features").transform(df)
    spark_fit = GBTRegressor(featuresCol="_features", labelCol="final_margin_a", predictionCol="p", **PARAMS).fit(rows)
    return own.stages[-1], spark_fit, rows


def _shape(model):
    return [(t.numNodes, t.depth) for t in model.trees], list(model.treeWeights)


@pytest.mark.parametrize(("n", "k", "parts", "tasks"), [(3000, 3, 1, 1), (24000, 4, 3, 1), (24000, 5, 4, 2)])
def test_trees_are_those_of_the_regressor(spark, tmp_path, monkeypatch, n, k, parts, tasks):
    monkeypatch.setattr(boosting, "HERE_ROWS", n if tasks == 1 else 1000)
    monkeypatch.setattr(boosting, "TASK_ROWS", n // tasks)
    monkeypatch.setattr(boosting, "BLOCK", 4096)
    monkeypatch.setattr(boosting, "CHECKPOINT_EVERY", 2)
    df, features = _rows(spark, n, k, parts, tmp_path)
    own, reference, rows = _both(df, features)
    assert _shape(own) == _shape(reference)
    got = [np.array(m.transform(rows).select(m.getPredictionCol()).collect()) for m in (own, reference)]
    np.testing.assert_allclose(*got, atol=1e-9)
    np.testing.assert_allclose(own.featureImportances.toArray(), reference.featureImportances.toArray(), atol=1e-9)
    for a, b in zip(own.trees, reference.trees, strict=True):
        a, b = a._java_obj.rootNode(), b._java_obj.rootNode()
        assert a.impurityStats().rawCount() == b.impurityStats().rawCount() and a.impurity() == pytest.approx(b.impurity())


def test_a_large_fit_is_grown_over_cached_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(boosting, "HERE_ROWS", 1000)
    df, features = _rows(spark, 3000, 3, 3, tmp_path)
    fits = []
    monkeypatch.setattr(GBTRegressor, "_fit", lambda self, rows: fits.append(self))
    cached = spark.sparkContext._jsc.getPersistentRDDs
    before = set(cached())
    M.gbt_fit(df, features, params=PARAMS)
    assert not fits and set(cached()) <= before  # nothing stays cached


def test_flat_labels_and_constant_features_give_leaves(spark):
    df = spark.range(500).select(F.lit(2.0).alias("x"), (F.col("id") % 7).cast("double").alias("z"), F.lit(3.0).alias("final_margin_a"))
    model = M.gbt_fit(df, ["x", "z"], params=PARAMS).stages[-1]
    assert {t.numNodes for t in model.trees} == {1} and model.predict(Vectors.dense(2.0, 1.0)) == 3.0


def test_gaps_fail(spark):
    df = spark.range(100).select(F.when(F.col("id") != 5, F.col("id")).cast("double").alias("x"), F.lit(1.0).alias("final_margin_a"))
    with pytest.raises(Exception, match="null"):
        M.gbt_fit(df, ["x"], params=PARAMS)


def test_other_parameters_are_left_to_the_regressor(spark, monkeypatch):
    df = spark.range(100).select(F.col("id").cast("double").alias("x"), F.col("id").cast("double").alias("final_margin_a"))
    fits, fit = [], GBTRegressor._fit
    monkeypatch.setattr(GBTRegressor, "_fit", lambda self, rows: fits.append(self) or fit(self, rows))
    M.gbt_fit(df, ["x"], params={"maxIter": 2, "lossType": "absolute"})
    assert len(fits) == 1
