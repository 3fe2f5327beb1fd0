"""Fitting and scoring with Spark ML. Predictions are columns on the match row: pred_<model>."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..sources.scratch import ensure_checkpoint_dir
from . import boosting, cleaning

#: Tree fits over fewer rows read them as they lie; above, partitions hold at most MOST_ROWS.
EVEN_FROM = 200_000
MOST_ROWS = 4_000_000


def scaler_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column with mean and population standard deviation, unknown values read as 0."""
    aggs = []
    for i, c in enumerate(columns):
        v = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        aggs += [F.avg(v).alias(f"_m{i}"), F.stddev_pop(v).alias(f"_s{i}")]
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.col(f"_m{i}").alias("mean"), F.col(f"_s{i}").alias("std"))
            for i, c in enumerate(columns)
        ]
    )
    return df.agg(*aggs).select(F.inline(rows))


def standardise(df: DataFrame, train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Z-scores under the statistics of the training rows; a constant column is only centred.

    The statistics are one row, fetched once and used as literals.
    """
    stats = {r["column_name"]: (r["mean"], r["std"]) for r in scaler_stats(train, columns).collect()}
    cols = {}
    for c in columns:
        mean, std = stats[c]
        cols[c] = (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.lit(mean)) / F.lit(std or 1.0)
    return df.withColumns(cols)


def _assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="error")


def ridge_fit(train: DataFrame, features: Sequence[str], label: str = "final_margin_a", alpha: float = 1.0) -> PipelineModel:
    """Ridge on z-scored features.

    The normal solver standardises features and label itself, so `alpha` on the summed loss is
    alpha * std(label) / n here.
    """
    train = train.select(label, *features)
    r = train.agg(F.count(label).alias("n"), F.stddev_pop(label).alias("s")).first()
    lr = LinearRegression(
        featuresCol="_features", labelCol=label, predictionCol="pred_ridge", solver="normal", elasticNetParam=0.0,
        regParam=alpha * (r["s"] or 0.0) / max(r["n"], 1), standardization=True,
    )
    return Pipeline(stages=[_assembler(features), lr]).fit(train)


def _evenly(rows: DataFrame) -> DataFrame:
    """The same rows, one equal partition a core (or a multiple of that), where there are many and they lie otherwise.

    A tree fit passes all rows once per tree and level, and each pass waits for its largest partition. Files are split by their row groups, so a
    core may hold twice the rows of another.
    """
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    n, cores = sum(sizes), rows.sparkSession.sparkContext.defaultParallelism
    if n < EVEN_FROM:
        return rows
    parts = cores * math.ceil(n / (cores * MOST_ROWS))
    return rows if len(sizes) <= parts and max(sizes) <= 1.25 * n / parts else rows.repartition(parts)


def gbt_fit(train: DataFrame, features: Sequence[str], label: str = "final_margin_a", params: dict | None = None) -> PipelineModel:
    """Gradient-boosted trees on raw features; every tenth tree checkpoints the running residuals.

    The trees are those of Spark's GBTRegressor over the same partitions: the rows that a tree samples depend on the partition they lie in.
    """
    ensure_checkpoint_dir(train.sparkSession)
    train = _evenly(train.select(label, *features))
    params = {**fixed.GBT_PARAMS, **(params or {})}
    gbt = GBTRegressor(featuresCol="_features", labelCol=label, predictionCol="pred_gbm", **params)
    return Pipeline(stages=[_assembler(features), boosting.BoostedTrees(gbt, list(features), params)]).fit(train)


def fit_models(
    train: DataFrame, features: Sequence[str], label: str = "final_margin_a", alpha: float = 1.0, gbt_params: dict | None = None
) -> dict[str, PipelineModel]:
    rows = train.select(label, *features).withColumn(label, F.col(label).cast("double"))
    return {"ridge": ridge_fit(rows, features, label, alpha), "gbm": gbt_fit(rows, features, label, gbt_params)}


def score_models(df: DataFrame, models: dict[str, PipelineModel]) -> DataFrame:
    """Add or replace pred_<model> for each model; unknown features count as 0."""
    out = df
    for name, model in models.items():
        features = model.stages[0].getInputCols()
        if f"pred_{name}" not in features:
            out = out.drop(f"pred_{name}")
        filled = out.withColumns({f"_in_{f}": F.col(f) for f in features if f in out.columns})
        filled = cleaning.scoring_defaults(filled, features, {})
        scored = model.transform(filled).drop("_features")
        keep = [F.col(f"_in_{c}").alias(c) if c in features else F.col(c) for c in out.columns]
        out = scored.select(*keep, F.col(f"pred_{name}"))
    return out


def feature_importance(model: PipelineModel, spark, k: int = 10) -> DataFrame:
    """The k features the trees rely on most."""
    names = model.stages[0].getInputCols()
    weights = model.stages[-1].featureImportances.toArray()
    rows = [(n, float(w)) for n, w in zip(names, weights, strict=True)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(k)


def save_models(models: dict[str, PipelineModel], path: str, weights: dict[str, float], threshold: float, spark) -> None:
    """Pipelines plus one row of ensemble settings."""
    for name, model in models.items():
        model.write().overwrite().save(f"{path}/{name}")
    row = [(list(models), [float(weights.get(m, 0.0)) for m in models], float(threshold))]
    spark.createDataFrame(row, "models array<string>, weights array<double>, threshold double").write.mode("overwrite").parquet(
        f"{path}/ensemble"
    )


def load_models(path: str, spark) -> tuple[dict[str, PipelineModel], dict[str, float], float]:
    r = spark.read.parquet(f"{path}/ensemble").first()
    models = {m: PipelineModel.load(f"{path}/{m}") for m in r["models"]}
    return models, dict(zip(r["models"], r["weights"], strict=True)), r["threshold"]
