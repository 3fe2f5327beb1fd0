"""Calibration and selection on validation rows.

Searches run over candidate grids: rows meet a candidate inside the task and leave it as partial
sums, so a shuffle carries one row per candidate and task, never rows times candidates.
"""

from __future__ import annotations

import json
import math
import operator
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from . import evaluation as E
from . import isotonic


def simplex_lattice(members: int, steps: int = 10) -> list[tuple[float, ...]]:
    """All weight vectors in multiples of 1/steps that sum to one, in lexicographic order."""

    def grow(left: int, n: int):
        if n == 1:
            yield (left,)
            return
        for i in range(left + 1):
            for rest in grow(left - i, n - 1):
                yield (i, *rest)

    return [tuple(i / steps for i in w) for w in grow(steps, members)]


def _lattice_counts(lattice: Sequence[Sequence[float]], threshold: float):
    """A task's bets and hits per lattice point: each batch meets all points as columns, and one row a point leaves the task."""
    weights = np.array(lattice).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bets, hits = np.zeros(weights.shape[1], np.int64), np.zeros(weights.shape[1], np.int64)
        for batch in batches:
            *preds, line, cover = (pc.fill_null(c, np.nan).to_numpy(zero_copy_only=False)[:, None] for c in batch.columns)
            edge = reduce(operator.add, [p * w for p, w in zip(preds, weights, strict=True)]) + line
            bet = np.abs(edge) >= threshold  # false without an edge
            bets += bet.sum(axis=0)
            hits += (bet & ((edge > 0) == (cover == 1.0))).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(bets), dtype=np.int32)), pa.array(bets), pa.array(hits)], names=["grid_pos", "n", "w"])

    return run


def weight_grid(
    df: DataFrame, models: Sequence[str], threshold: float, steps: int = 10, line: str = "spread_a", cover: str = "cover_a"
) -> DataFrame:
    """Metric row per weight vector of the lattice.

    Each bet is read once and counted for all lattice points at the same time; nothing but the counts leaves a task.
    """
    lattice = simplex_lattice(len(models), steps)
    decided = df.filter(F.col(cover).isin(0.0, 1.0)).select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate([*[f"pred_{m}" for m in models], line, cover])])
    counts = decided.mapInArrow(_lattice_counts(lattice, float(threshold)), "grid_pos int, n long, w long")
    counts = counts.groupBy("grid_pos").agg(F.sum("n").alias("n_bets"), F.sum("w").alias("_w"))
    vectors = F.array(*[F.array(*map(F.lit, ws)) for ws in lattice])
    named = [F.get(F.get(vectors, F.col("grid_pos")), F.lit(i)).alias(f"w_{m}") for i, m in enumerate(models)]
    n, w = F.col("n_bets"), F.col("_w")
    return counts.select("grid_pos", *named, "n_bets", E.rate_of(w, n).alias("hit_rate"), E.roi_of(w, n).alias("roi"))


def weight_search_roi(
    df: DataFrame, models: Sequence[str] = ("ridge", "gbm", "dnn"), threshold: float = fixed.DEFAULT_THRESHOLD, min_bets: int = 50, steps: int = 10
) -> DataFrame:
    """The weights with the highest return among those with enough bets."""
    return E.argmax_grid(weight_grid(df, models, threshold, steps), "roi", "grid_pos", min_bets)


def weight_search_hit_rate(df: DataFrame, models: Sequence[str] = ("ridge", "gbm", "dnn"), steps: int = 10) -> DataFrame:
    """The weights with the highest hit rate over all bets."""
    return E.argmax_grid(weight_grid(df, models, 0.0, steps), "hit_rate", "grid_pos")


def temperatures(low: float, high: float, n: int) -> list[float]:
    step = (high - low) / (n - 1)
    return [round(low + i * step, 12) for i in range(n)]


def temperature_search(
    df: DataFrame, pred: str = "pred", line: str = "spread_a", cover: str = "cover_a",
    threshold: float = fixed.DEFAULT_THRESHOLD, min_bets: int = 100,
) -> DataFrame:
    """(temperature, hit_rate, n_bets) of the best edge divisor; 1 unless another one is better.

    |edge / T| >= t is |edge| >= t * T, so the grid is a threshold sweep.
    """
    grid = temperatures(*fixed.TEMPERATURE_RANGE)
    grid = [1.0, *[t for t in grid if t != 1.0]]
    by_cut = {t * threshold: (i, t) for i, t in enumerate(grid)}
    sweep = E.threshold_sweep(df, list(by_cut), pred, line, cover)
    pos, temp = F.lit(None).cast("int"), F.lit(None).cast("double")
    for cut, (i, t) in by_cut.items():
        at = F.col("threshold") == F.lit(cut)
        pos, temp = F.when(at, i).otherwise(pos), F.when(at, t).otherwise(temp)
    scored = sweep.select(pos.alias("grid_pos"), temp.alias("temperature"), "hit_rate", "n_bets")
    scored = scored.filter((F.col("grid_pos") == 0) | (F.col("n_bets") >= min_bets))
    return scored.orderBy(F.desc("hit_rate"), "grid_pos").limit(1).drop("grid_pos")


def temperature_apply(pred: str, line: str, temperature: float) -> Column:
    return -F.col(line) + (F.col(pred) + F.col(line)) / F.lit(float(temperature))


def calibration_blocks(df: DataFrame, pred: str = "pred", line: str = "spread_a", cover: str = "cover_a") -> DataFrame:
    """Blocks of the monotone fit of P(bet correct) on |edge|: (low, high, n_rows, hits, rate), pooled on the executors."""
    e = E.edge_of(pred, line)
    return isotonic.isotonic_blocks(df, F.abs(e), E.hit_of(e, cover))


def fit_isotonic(df: DataFrame, pred: str = "pred", line: str = "spread_a", cover: str = "cover_a") -> IsotonicRegressionModel:
    """Monotone fit of P(bet correct) on |edge|.

    The model gets the ends of the blocks only, which rise already, so fitting them leaves the solution as is.
    """
    blocks = calibration_blocks(df, pred, line, cover)
    ends = F.array_distinct(F.array("low", "high"))
    points = blocks.select(F.explode(ends).alias("abs_edge"), F.col("rate").alias("hit"), (F.col("n_rows") / F.size(ends)).alias("weight"))
    return IsotonicRegression(featuresCol="abs_edge", labelCol="hit", weightCol="weight", predictionCol="_p").fit(points)


def isotonic_calibrate(df: DataFrame, model: IsotonicRegressionModel, edge: str | Column = "edge") -> DataFrame:
    """Add cover_prob, the calibrated probability of a correct bet within the fixed range."""
    low, high = fixed.PROBABILITY_RANGE
    e = F.abs(edge if isinstance(edge, Column) else F.col(edge))
    rows = df.withColumn("abs_edge", e)
    scored = model.transform(rows.withColumn("abs_edge", F.coalesce("abs_edge", F.lit(0.0))))
    p = F.least(F.greatest(F.col("_p"), F.lit(low)), F.lit(high))
    known = (edge if isinstance(edge, Column) else F.col(edge)).isNotNull()
    return scored.withColumn("cover_prob", F.when(known, p)).drop("_p", "abs_edge")


def probability_filter(df: DataFrame, min_prob: float = fixed.MIN_CONFIDENCE) -> DataFrame:
    return df.filter(F.col("cover_prob") >= min_prob)


def profitable_buckets(
    df: DataFrame, pred: str = "pred", line: str = "spread_a", cover: str = "cover_a",
    min_samples: int = 30, breakeven: float = fixed.BREAKEVEN,
) -> DataFrame:
    """Edge buckets with enough rows and a hit rate at or above break-even."""
    out = E.edge_buckets(df, pred, line, cover)
    return out.filter((F.col("n_games") >= min_samples) & (F.col("hit_rate") >= breakeven))


def bucket_filter(df: DataFrame, buckets: DataFrame, edge: str = "edge") -> DataFrame:
    """Rows whose edge lies in one of the given buckets (at most one row per bucket label)."""
    rows = df.withColumn("bucket", E.bucket_label(F.abs(edge)))
    return rows.join(F.broadcast(buckets.select("bucket")), ["bucket"], "left_semi")


#: Up to this mean a Poisson draw inverts the distribution term by term; beyond it the expansion below is off by less than a hundredth within five deviations.
EXACT_MEAN = 256

# A rational approximation of the normal quantile by P. J. Acklam, relative error below 1.2e-9.
NORMAL_CENTRE = (
    [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00],
    [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0],
)
NORMAL_TAIL = (
    [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00],
    [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0],
)
NORMAL_EDGE = 0.02425


def _polynomial(coefficients: Sequence[float], x: Column) -> Column:
    return reduce(lambda acc, c: acc * x + F.lit(c), coefficients[1:], F.lit(coefficients[0]))


def _let(value: Column, body) -> Column:
    """body(value), which reads the value instead of repeating its expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normal_quantile(u: Column) -> Column:
    """The value below which a standard normal lies with probability u (0 < u < 1)."""
    ratio = lambda pair, x: _polynomial(pair[0], x) / _polynomial(pair[1], x)
    # Products before quotients, as the terms are written.
    centre = _let((u - 0.5) * (u - 0.5), lambda r: (u - 0.5) * _polynomial(NORMAL_CENTRE[0], r) / _polynomial(NORMAL_CENTRE[1], r))
    tail = lambda p: _let(F.sqrt(F.lit(-2.0) * F.log(p)), lambda r: ratio(NORMAL_TAIL, r))
    return F.when(u < NORMAL_EDGE, tail(u)).when(u > 1 - NORMAL_EDGE, -tail(F.lit(1.0) - u)).otherwise(centre)


def poisson_quantile(u: Column, mean: Column) -> Column:
    """A Poisson draw (long) by inverse distribution: the least k whose cumulative probability reaches u."""
    root = F.sqrt(mean)
    wide = _let(normal_quantile(u), lambda z: F.greatest(F.floor(mean + z * root + (z * z - 1.0) / 6.0 + (z - z * z * z) / (F.lit(72.0) * root) + 0.5), F.lit(0)))
    # Terms are summed until u is reached; k stays once it is. Twelve deviations beyond the mean hold more than any digest can tell.
    last = F.ceil(mean + F.lit(12.0) * root + F.lit(24.0)).cast("int")
    start = F.struct(F.lit(0).cast("long").alias("k"), F.exp(-mean).alias("term"), F.exp(-mean).alias("sum"))

    def step(s: Column, i: Column) -> Column:
        on = s["sum"] < u
        term = F.when(on, s["term"] * mean / i).otherwise(s["term"])
        return F.struct((s["k"] + F.when(on, 1).otherwise(0)).alias("k"), term.alias("term"), F.when(on, s["sum"] + term).otherwise(s["sum"]).alias("sum"))

    exact = F.aggregate(F.sequence(F.lit(1), last), start, step, lambda s: s["k"])
    return F.when(mean == 0, F.lit(0)).when(mean <= EXACT_MEAN, exact).otherwise(wide).cast("long")


def poisson_cuts(digits: int = 8) -> list[str]:
    """Cumulative Poisson(1) probabilities as upper ends of fixed-length hexadecimal fractions."""
    cuts, total = [], 0.0
    for k in range(40):
        total += math.exp(-1.0) / math.factorial(k)
        point = int(total * 16**digits)
        if point >= 16**digits - 1:
            break
        cuts.append(format(point, f"0{digits}x"))
    return cuts


def poisson_weight(hexes: Column) -> Column:
    """Poisson(1) draw from eight hexadecimal digits; fixed-length digits compare as text."""
    out = F.lit(len(poisson_cuts()))
    for k, cut in reversed(list(enumerate(poisson_cuts()))):
        out = F.when(hexes < cut, k).otherwise(out)
    return out


def bootstrap_rois(
    df: DataFrame, thresholds: Sequence[float] = tuple(fixed.STABILITY_THRESHOLDS), n_bootstrap: int = 100,
    pred: str = "pred", line: str = "spread_a", cover: str = "cover_a", seed: int = 0, key: str = "game_key",
) -> DataFrame:
    """(rep, threshold, n_bets, roi) of Poisson-weighted resamples.

    A row's weight in a replicate is a Poisson(1) draw from the digest of its key (and of a seed other than 0), so a rerun draws the same. One digest serves
    four replicates, whose weights are summed side by side: a task sends one row per digest number, threshold bin and hit or miss. Rows below
    the lowest threshold never bet.
    """
    steps = sorted({float(t) for t in thresholds})
    e, hit = E.edge_of(pred, line), E.hit_of(E.edge_of(pred, line), cover)
    reached = F.lit(0)
    for i, t in enumerate(steps):
        reached = F.when(F.abs(e) >= t, i).otherwise(reached)
    own = F.concat(F.lit(f"{seed}:" if seed else ""), F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"))
    bets = df.select(own.alias("_k"), reached.alias("_bin"), hit.cast("int").alias("_hit"), F.abs(e).alias("_e")).filter(F.col("_hit").isNotNull() & (F.col("_e") >= steps[0]))
    digests = -(-n_bootstrap // 4)
    drawn = bets.select("_bin", "_hit", "_k", F.explode(F.sequence(F.lit(0), F.lit(digests - 1))).alias("_g"))
    drawn = drawn.select("_bin", "_hit", "_g", F.md5(F.concat("_k", F.col("_g").cast("string"))).alias("_md"))
    cells = drawn.groupBy("_g", "_bin", "_hit").agg(*[F.sum(poisson_weight(F.substring("_md", 8 * s + 1, 8))).alias(f"_n{s}") for s in range(4)])
    by_rep = F.array(*[F.struct((F.col("_g") * 4 + (s + 1)).alias("rep"), F.col(f"_n{s}").alias("_n")) for s in range(4)])
    grid = F.array(*[F.struct(F.lit(i).alias("_t"), F.lit(t).alias("threshold")) for i, t in enumerate(steps)])
    # A replicate in which no row of a threshold is drawn has no bets there, and no row.
    weighted = cells.select("_bin", "_hit", F.inline(by_rep)).filter((F.col("_n") > 0) & (F.col("rep") <= n_bootstrap))
    out = (
        weighted.select("*", F.inline(grid))
        .filter(F.col("_bin") >= F.col("_t"))
        .groupBy("rep", "threshold")
        .agg(F.sum("_n").cast("bigint").alias("n_bets"), F.sum(F.col("_n") * F.col("_hit")).cast("bigint").alias("_w"))
    )
    return out.select("rep", "threshold", "n_bets", E.roi_of(F.col("_w"), F.col("n_bets")).alias("roi"))


def bootstrap_rois_by_cell(
    df: DataFrame, thresholds: Sequence[float] = tuple(fixed.STABILITY_THRESHOLDS), n_bootstrap: int = 100,
    pred: str = "pred", line: str = "spread_a", cover: str = "cover_a", seed: int = 0,
) -> DataFrame:
    """As bootstrap_rois, but with one draw per cell instead of one per row.

    Each row weighs Poisson(1) in a replicate, and sums of those weights over the rows of a cell (threshold bin, hit or miss) are Poisson with the
    number of its rows. So one pass counts the cells, at most two per threshold, and each replicate draws once per cell, from a digest
    of seed, replicate and cell: a rerun draws the same. Rows below the lowest threshold never bet.
    """
    steps = sorted({float(t) for t in thresholds})
    e, hit = E.edge_of(pred, line), E.hit_of(E.edge_of(pred, line), cover)
    reached = F.lit(0)
    for i, t in enumerate(steps):
        reached = F.when(F.abs(e) >= t, i).otherwise(reached)
    bets = df.select(reached.alias("_bin"), hit.cast("int").alias("_hit"), F.abs(e).alias("_e")).filter(F.col("_hit").isNotNull() & (F.col("_e") >= steps[0]))
    cells = bets.groupBy("_bin", "_hit").agg(F.count("*").alias("_rows"))
    drawn = cells.select("*", F.explode(F.sequence(F.lit(1), F.lit(n_bootstrap))).alias("rep"))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("rep").cast("string"), F.col("_bin").cast("string"), F.col("_hit").cast("string")))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(2**48))
    drawn = drawn.withColumn("_n", _let(u, lambda u: poisson_quantile(u, F.col("_rows").cast("double"))))
    grid = F.array(*[F.struct(F.lit(i).alias("_t"), F.lit(t).alias("threshold")) for i, t in enumerate(steps)])
    out = (
        drawn.select("*", F.inline(grid))
        .filter(F.col("_bin") >= F.col("_t"))
        .groupBy("rep", "threshold")
        .agg(F.sum("_n").cast("bigint").alias("n_bets"), F.sum(F.col("_n") * F.col("_hit")).cast("bigint").alias("_w"))
    )
    return out.select("rep", "threshold", "n_bets", E.roi_of(F.col("_w"), F.col("n_bets")).alias("roi"))


def bootstrap_threshold_stability(rois: DataFrame, min_bets: int = 20, min_reps: int = 50) -> DataFrame:
    """Mean, spread and stability score per threshold over the replicates with enough bets."""
    out = (
        rois.filter(F.col("n_bets") >= min_bets)
        .groupBy("threshold")
        .agg(
            F.count("*").alias("n_reps"),
            F.avg("roi").alias("mean_roi"),
            F.stddev_pop("roi").alias("std_roi"),
            F.avg((F.col("roi") > 0).cast("double")).alias("pct_profitable"),
        )
        .filter(F.col("n_reps") >= min_reps)
    )
    score = F.when(F.col("pct_profitable") > 0.5, F.col("mean_roi") / (F.col("std_roi") + 0.01)).otherwise(-1.0)
    return out.withColumn("stability", score)


def stable_threshold(stability: DataFrame, default: float = fixed.DEFAULT_THRESHOLD) -> float:
    """The most stable threshold, the default when none qualified (at most one row is fetched)."""
    row = stability.orderBy(F.desc("stability"), "threshold").select("threshold").first()
    return default if row is None else float(row[0])


@dataclass
class Calibration:
    """Fitted state of the selection: a handful of numbers and the monotone fit."""

    weights: dict[str, float]
    temperature: float = 1.0
    threshold: float = fixed.DEFAULT_THRESHOLD
    buckets: list[str] = field(default_factory=list)
    isotonic: IsotonicRegressionModel | None = None

    def to_row(self, spark: SparkSession) -> DataFrame:
        row = (json.dumps(self.weights), self.temperature, self.threshold, list(self.buckets), self.isotonic is not None)
        return spark.createDataFrame([row], "weights string, temperature double, threshold double, buckets array<string>, monotone boolean")

    def save(self, spark: SparkSession, path: str) -> None:
        self.to_row(spark).write.mode("overwrite").parquet(f"{path}/state")
        if self.isotonic is not None:
            self.isotonic.write().overwrite().save(f"{path}/isotonic")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Calibration":
        r = spark.read.parquet(f"{path}/state").first()
        fit = IsotonicRegressionModel.load(f"{path}/isotonic") if r["monotone"] else None
        return cls(json.loads(r["weights"]), r["temperature"], r["threshold"], list(r["buckets"]), fit)


def calibration_fit(
    df: DataFrame, models: Sequence[str] = ("ridge", "gbm", "dnn"), key: str = "game_key", line: str = "spread_a", cover: str = "cover_a"
) -> Calibration:
    """Weights, temperature, monotone fit, buckets and stable threshold from validation rows."""
    best = weight_search_roi(df, models).first()
    default = {m: fixed.THREE_MODEL_WEIGHTS.get(m, 0.0) for m in models}
    weights = default if best is None else {m: float(best[f"w_{m}"]) for m in models}
    scored = df.withColumn("_pred", E.combine_weighted(weights, models)).select(key, "_pred", line, cover)
    temp = temperature_search(scored, "_pred", line, cover).first()
    buckets = [r["bucket"] for r in profitable_buckets(scored, "_pred", line, cover).select("bucket").collect()]
    rois = bootstrap_rois_by_cell(scored, pred="_pred", line=line, cover=cover)
    return Calibration(
        weights,
        1.0 if temp is None else float(temp["temperature"]),
        stable_threshold(bootstrap_threshold_stability(rois)),
        [b for _, _, b in fixed.EDGE_BUCKETS if b in buckets],
        fit_isotonic(scored, "_pred", line, cover),
    )


def calibrated_bet_mask(
    df: DataFrame, cal: Calibration, use_buckets: bool = True, use_probability: bool = True,
    min_prob: float = fixed.MIN_CONFIDENCE, line: str = "spread_a",
) -> DataFrame:
    """Add pred_scaled, edge, cover_prob and is_bet of the calibrated strategy."""
    raw = E.combine_weighted(cal.weights, list(cal.weights))
    out = df.withColumn("_raw", raw)
    out = out.withColumn("pred_scaled", temperature_apply("_raw", line, cal.temperature)).drop("_raw")
    out = out.withColumn("edge", E.edge_of("pred_scaled", line))
    mask = F.abs("edge") >= F.lit(float(cal.threshold))
    if use_buckets and cal.buckets:
        mask = mask & E.bucket_label(F.abs("edge")).isin(*cal.buckets)
    if cal.isotonic is not None:
        out = isotonic_calibrate(out, cal.isotonic)
        if use_probability:
            mask = mask & (F.col("cover_prob") >= min_prob)
    return out.withColumn("is_bet", F.coalesce(mask, F.lit(False)))
