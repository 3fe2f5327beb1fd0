"""Fit, score and evaluate: holdout by season, expanding folds, ablation."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import calibration, cleaning, evaluation, history, models
from ..sources.scratch import materialise

PARALLEL_FITS = 6
_PREDS = {"Ridge": "pred_ridge", "GBM": "pred_gbm", "Ensemble": "pred_ensemble"}


def _scored(df: DataFrame, fitted: dict) -> DataFrame:
    out = models.score_models(df, fitted)
    return out.withColumn("pred_ensemble", evaluation.ensemble_fixed(fixed.TWO_MODEL_WEIGHTS))


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def _side_by_side(spark: SparkSession, work: Callable, items: Sequence, parallelism: int) -> list:
    """work(item) of independent items, in their order, at most `parallelism` at once.

    A fit is hundreds of short jobs, each of which waits for the one before; several fits fill the cluster.
    """
    with ThreadPool(max(1, min(parallelism, len(items)))) as pool:
        return pool.map(inheritable_thread_target(spark)(work), items, chunksize=1)


def _prepare(features_df: DataFrame, features: Sequence[str], name: str) -> tuple[DataFrame, list[str]]:
    """Modelable rows with only the needed columns, written once: every fit and score reads that."""
    rows, available = cleaning.filter_modelable(features_df, features)
    keep = [c for c in ("game_key", "season", "date", "spread_a", "final_margin_a", "cover_a") if c in rows.columns and c not in available]
    rows = rows.select(*keep, *[F.col(c).cast("double").alias(c) for c in available])
    return materialise(rows, name), available


def holdout_evaluation(
    features_df: DataFrame, features: Sequence[str], train: Sequence, val: Sequence, test: Sequence, gbt_params: dict | None = None
) -> dict:
    """Fit on the training seasons, measure every split, tune on validation, apply to test.

    Returns fitted models, the metric table, the tuned threshold, the test row at that threshold
    and the scored rows.
    """
    rows, available = _prepare(features_df, features, "holdout")
    rows = cleaning.with_split(rows, train, val, test)
    fitted = models.fit_models(rows.filter("split = 'train'"), available, gbt_params=gbt_params)
    scored = _scored(rows, fitted)
    metrics = evaluation.evaluate_by_group(scored, _PREDS, ["split"])
    best = evaluation.tune_threshold(scored.filter("split = 'val'"), pred="pred_ensemble").first()
    threshold = 0.0 if best is None else float(best["threshold"])
    applied = evaluation.evaluate_line(scored.filter("split = 'test'"), "pred_ensemble", threshold=threshold)
    return {
        "models": fitted, "features": available, "metrics": metrics, "threshold": threshold, "test_at_threshold": applied, "scored": scored,
    }


def cross_validation(
    features_df: DataFrame, features: Sequence[str], n_splits: int = 5, gbt_params: dict | None = None, parallelism: int = PARALLEL_FITS
) -> DataFrame:
    """Metric row per fold and model; fold k trains on everything before its test block. Folds are fitted side by side."""
    rows, available = _prepare(features_df, features, "folds")
    rows = materialise(history.expanding_folds(rows, n_splits), "folds-placed")

    def measured(fold: int) -> DataFrame:
        fitted = models.fit_models(rows.filter(F.col("test_fold") < fold), available, gbt_params=gbt_params)
        scored = _scored(rows.filter(F.col("test_fold") == fold), fitted)
        return evaluation.evaluate_by_group(scored, _PREDS, ["test_fold"]).withColumnRenamed("test_fold", "fold")

    return _union(_side_by_side(rows.sparkSession, measured, range(1, n_splits + 1), parallelism))


def ablation_table(
    features_df: DataFrame, sets: dict[str, list[str]], train: Sequence, val: Sequence, test: Sequence, gbt_params: dict | None = None, parallelism: int = PARALLEL_FITS
) -> DataFrame:
    """Feature set, its size, and the ensemble's test hit rate and return.

    The input is written once with the columns of all sets; each set filters those rows. Sets are fitted side by side.
    """
    wanted = dict.fromkeys(["game_key", "season", "date", "spread_a", "final_margin_a", "cover_a", "kp_matched", *[c for s in sets.values() for c in s]])
    features_df = materialise(features_df.select(*[c for c in wanted if c in features_df.columns]), "ablation")

    def measured(name: str) -> DataFrame:
        res = holdout_evaluation(features_df, sets[name], train, val, test, gbt_params)
        row = res["metrics"].filter("split = 'test' and model = 'Ensemble'")
        return row.select(
            F.lit(name).alias("feature_set"), F.lit(len(res["features"])).alias("n_features"),
            F.col("hit_rate").alias("test_hit_rate"), F.col("roi").alias("test_roi"),
        )

    return _union(_side_by_side(features_df.sparkSession, measured, list(sets), parallelism))


def selective_backtest(
    val: DataFrame, test: DataFrame, models_used: Sequence[str] = ("ridge", "gbm", "dnn"), band: tuple[float, float] = (5.0, 7.0), key: str = "game_key"
) -> DataFrame:
    """Fit the selection on validation rows and measure it on test rows: strategy, n_bets, hit_rate, roi.

    Strategies: every decided row, the stable threshold, the temperature-scaled prediction at that threshold, one edge band, and the calibrated
    mask. Both frames hold one prediction column per model, the line and the cover label; the test rows are read once.
    """
    cal = calibration.calibration_fit(val, models_used, key)
    rows = calibration.calibrated_bet_mask(test, cal)
    raw = evaluation.edge_of(evaluation.combine_weighted(cal.weights, list(cal.weights)), "spread_a")
    scaled, cover = F.col("edge"), F.col("cover_a")
    least = F.lit(float(cal.threshold))
    bets = {
        "all": (raw, F.lit(True)),
        "threshold": (raw, F.abs(raw) >= least),
        "scaled": (scaled, F.abs(scaled) >= least),
        "band": (raw, (F.abs(raw) >= band[0]) & (F.abs(raw) < band[1])),
        "calibrated": (scaled, F.col("is_bet")),
    }
    long = rows.select(F.inline(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(name).alias("strategy"), F.when(chosen, evaluation.hit_of(e, cover)).alias("hit")) for i, (name, (e, chosen)) in enumerate(bets.items())])))
    n, wins = evaluation.count_where(F.col("hit").isNotNull()), evaluation.count_where(F.coalesce("hit", F.lit(False)))
    out = long.groupBy("place", "strategy").agg(n.alias("n_bets"), wins.alias("wins"))
    return out.select("strategy", "n_bets", evaluation.rate_of(F.col("wins"), F.col("n_bets")).alias("hit_rate"), evaluation.roi_of(F.col("wins"), F.col("n_bets")).alias("roi"))


def holdout_summary(result: dict) -> DataFrame:
    """One row: test metrics of the ensemble, the tuned threshold and the metrics at it."""
    test = result["metrics"].filter("split = 'test' and model = 'Ensemble'").select(
        F.lit(1).alias("_one"), F.col("hit_rate").alias("test_hit_rate"), F.col("roi").alias("test_roi")
    )
    at = result["test_at_threshold"].select(
        F.lit(1).alias("_one"), "threshold", F.col("hit_rate").alias("threshold_hit_rate"),
        F.col("roi").alias("threshold_roi"), F.col("n_bets").alias("threshold_n_bets"),
    )
    return test.join(at, "_one").drop("_one")
