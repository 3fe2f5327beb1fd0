"""Evaluation of predictions against a line.

Rows are matches with a prediction, a line and a three-valued cover label. Every table is one
grouped aggregation over all rows; nothing is multiplied per threshold or per model.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import fixed


def edge_of(pred: str | Column, line: str | Column) -> Column:
    """Predicted advantage over the line, NULL when either is unknown."""
    return X.null_if_nan((X.col(pred) + X.col(line)).cast("double"))


def hit_of(edge: Column, cover: str | Column) -> Column:
    """Did the backed side cover? Side A is backed only above a zero edge; pushes give NULL."""
    cover = X.col(cover)
    return F.when(cover.isin(0.0, 1.0) & edge.isNotNull(), (edge > 0) == (cover == 1.0))


def with_edge(df: DataFrame, pred: str = "pred", line: str = "spread_a", cover: str = "cover_a") -> DataFrame:
    """Add edge, abs_edge, side and hit."""
    e = edge_of(pred, line)
    return df.withColumns(
        {
            "edge": e,
            "abs_edge": F.abs(e),
            "side": F.when(e > 0, "A").when(e.isNotNull(), "B"),
            "hit": hit_of(e, cover),
        }
    )


def count_where(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("bigint")


def roi_of(wins: Column, bets: Column, juice: float = fixed.JUICE) -> Column:
    """Return per unit staked at the given odds, 0 without bets."""
    payout = 100.0 / abs(juice)
    return F.coalesce(F.try_divide(wins * F.lit(payout) - (bets - wins), bets.cast("double")), F.lit(0.0))


def rate_of(wins: Column, bets: Column) -> Column:
    return F.coalesce(F.try_divide(wins.cast("double"), bets.cast("double")), F.lit(0.0))


def _metric_columns(juice: float) -> dict[str, Column]:
    bets, wins, games = F.col("n_bets"), F.col("_wins"), F.col("n_games")
    return {
        "hit_rate": rate_of(wins, bets),
        "roi": roi_of(wins, bets, juice),
        "pct_games_bet": rate_of(bets, games),
    }


def evaluate_line(
    df: DataFrame,
    pred: str = "pred",
    line: str = "spread_a",
    cover: str | None = "cover_a",
    margin: str | None = None,
    threshold: float = 0.0,
    juice: float = fixed.JUICE,
    by: Sequence[str] = (),
) -> DataFrame:
    """Metric row: bets are rows with a decided cover and |edge| >= threshold.

    Pushes and rows without a line count in n_games and in the errors, never in bets. Without a
    cover column the label comes from the margin.
    """
    if cover is None and margin is None:
        raise ValueError("either cover or margin is needed")
    label = X.label_cover(margin, line) if cover is None else F.col(cover)
    e = edge_of(pred, line)
    hit = hit_of(e, label)
    bet = hit.isNotNull() & (F.abs(e) >= F.lit(float(threshold)))
    aggs = [
        F.count("*").alias("n_games"),
        count_where(bet).alias("n_bets"),
        count_where(bet & hit).alias("_wins"),
    ]
    out_cols = ["n_games", "threshold"]
    if margin is not None:
        miss = F.col(margin) - F.col(pred)
        aggs += [F.avg(F.abs(miss)).alias("mae"), F.sqrt(F.avg(miss * miss)).alias("rmse")]
        out_cols += ["mae", "rmse"]
    out = df.groupBy(*by).agg(*aggs).withColumns({"threshold": F.lit(float(threshold)), **_metric_columns(juice)})
    return out.select(*by, *out_cols, "hit_rate", "roi", "n_bets", "pct_games_bet")


def mae_rmse(df: DataFrame, pred: str, margin: str, by: Sequence[str] = ()) -> DataFrame:
    miss = F.col(margin) - F.col(pred)
    return df.groupBy(*by).agg(
        F.count(miss).alias("n_games"), F.avg(F.abs(miss)).alias("mae"), F.sqrt(F.avg(miss * miss)).alias("rmse")
    )


def evaluate_by_group(
    df: DataFrame,
    models: dict[str, str],
    by: Sequence[str],
    line: str = "spread_a",
    cover: str = "cover_a",
    margin: str = "final_margin_a",
    threshold: float = 0.0,
    juice: float = fixed.JUICE,
) -> DataFrame:
    """Metric row per group and model: all models are measured in one pass over the rows."""
    aggs, packs = [F.count("*").alias("n_games")], []
    for i, (name, pred) in enumerate(models.items()):
        e = edge_of(pred, line)
        hit = hit_of(e, cover)
        bet = hit.isNotNull() & (F.abs(e) >= F.lit(float(threshold)))
        miss = F.col(margin) - F.col(pred)
        aggs += [
            count_where(bet).alias(f"_b{i}"),
            count_where(bet & hit).alias(f"_w{i}"),
            F.avg(F.abs(miss)).alias(f"_a{i}"),
            F.sqrt(F.avg(miss * miss)).alias(f"_r{i}"),
        ]
        packs.append(
            F.struct(
                F.lit(name).alias("model"),
                F.col(f"_b{i}").alias("n_bets"),
                F.col(f"_w{i}").alias("_wins"),
                F.col(f"_a{i}").alias("mae"),
                F.col(f"_r{i}").alias("rmse"),
            )
        )
    out = df.groupBy(*by).agg(*aggs).select(*by, "n_games", F.inline(F.array(*packs)))
    out = out.withColumns({"threshold": F.lit(float(threshold)), **_metric_columns(juice)})
    return out.select(
        *by, "model", "n_games", "threshold", "mae", "rmse", "hit_rate", "roi", "n_bets", "pct_games_bet"
    )


def threshold_sweep(
    df: DataFrame,
    thresholds: Sequence[float] = tuple(fixed.SWEEP_VALIDATION),
    pred: str = "pred",
    line: str = "spread_a",
    cover: str = "cover_a",
    juice: float = fixed.JUICE,
    by: Sequence[str] = (),
) -> DataFrame:
    """Metric row per threshold.

    Each bet falls into the bin of the highest threshold it reaches, so one aggregation over the
    rows yields at most len(thresholds) + 1 bins; the rows per threshold come from those bins.
    """
    steps = sorted({float(t) for t in thresholds})
    e = edge_of(pred, line)
    hit = hit_of(e, cover)
    reached = F.lit(-1)
    for i, t in enumerate(steps):
        reached = F.when(F.abs(e) >= t, i).otherwise(reached)
    bins = (
        df.select(*by, F.when(hit.isNotNull(), reached).otherwise(-1).alias("_bin"), hit.alias("_hit"))
        .groupBy(*by, "_bin")
        .agg(F.count("*").alias("_n"), count_where(F.col("_hit")).alias("_w"))
    )
    grid = F.array(*[F.struct(F.lit(i).alias("_t"), F.lit(t).alias("threshold")) for i, t in enumerate(steps)])
    inside = F.col("_bin") >= F.col("_t")
    out = (
        bins.select("*", F.inline(grid))
        .groupBy(*by, "threshold")
        .agg(
            F.sum("_n").cast("bigint").alias("n_games"),
            F.sum(F.when(inside, F.col("_n")).otherwise(0)).cast("bigint").alias("n_bets"),
            F.sum(F.when(inside, F.col("_w")).otherwise(0)).cast("bigint").alias("_wins"),
        )
        .withColumns(_metric_columns(juice))
    )
    return out.select(*by, "n_games", "threshold", "hit_rate", "roi", "n_bets", "pct_games_bet")


def argmax_grid(grid: DataFrame, score: str, position: str, min_bets: int = 0, default: float | None = None) -> DataFrame:
    """Best row of a small candidate grid: highest score, earliest position on ties.

    Rows below `min_bets` only win when no other row qualifies and sit at `default`.
    """
    ok = F.col("n_bets") >= F.lit(min_bets)
    if default is not None:
        grid = grid.filter(ok | (F.col(position) == F.lit(float(default))))
    else:
        grid = grid.filter(ok)
    return grid.orderBy(ok.desc(), F.when(ok, F.col(score)).desc(), F.col(position).asc()).limit(1)


def tune_threshold(
    df: DataFrame,
    thresholds: Sequence[float] | None = None,
    min_bets: int = 50,
    pred: str = "pred",
    line: str = "spread_a",
    cover: str = "cover_a",
) -> DataFrame:
    """The sweep row with the highest return among those with enough bets; threshold 0 otherwise."""
    steps = [i * 0.5 for i in range(15)] if thresholds is None else list(thresholds)
    sweep = threshold_sweep(df, [*steps, 0.0], pred, line, cover)
    if 0.0 not in steps:
        sweep = sweep.withColumn("n_bets", F.when(F.col("threshold") == 0.0, F.lit(-1)).otherwise(F.col("n_bets")))
    return argmax_grid(sweep, "roi", "threshold", min_bets, 0.0)


def bucket_label(abs_edge: Column, buckets=tuple(fixed.EDGE_BUCKETS)) -> Column:
    out = F.lit(None).cast("string")
    for low, high, label in buckets:
        inside = abs_edge >= low if high is None else (abs_edge >= low) & (abs_edge < high)
        out = F.when(inside, label).otherwise(out)
    return out


def edge_buckets(
    df: DataFrame,
    pred: str = "pred",
    line: str = "spread_a",
    cover: str = "cover_a",
    by: Sequence[str] = (),
    buckets=tuple(fixed.EDGE_BUCKETS),
) -> DataFrame:
    """Hit rate and return per |edge| bucket of decided rows; empty buckets are left out."""
    e = edge_of(pred, line)
    hit = hit_of(e, cover)
    out = (
        df.select(*by, bucket_label(F.abs(e), buckets).alias("bucket"), hit.alias("_hit"))
        .filter(F.col("_hit").isNotNull() & F.col("bucket").isNotNull())
        .groupBy(*by, "bucket")
        .agg(F.count("*").alias("n_games"), count_where(F.col("_hit")).alias("_w"))
    )
    n, w = F.col("n_games"), F.col("_w")
    return out.select(*by, "bucket", "n_games", rate_of(w, n).alias("hit_rate"), roi_of(w, n).alias("roi"))


def single_bucket_strategy(
    df: DataFrame, low: float = 5.0, high: float = 7.0, pred: str = "pred", line: str = "spread_a", cover: str = "cover_a"
) -> DataFrame:
    """Bet only inside one edge band, with a status against break-even."""
    e = F.abs(edge_of(pred, line))
    inside = df.filter((e >= low) & (e < high) & F.col(cover).isin(0.0, 1.0))
    row = evaluate_line(inside, pred, line, cover).select("n_bets", "hit_rate", "roi")
    return breakeven_flag(row)


def breakeven_flag(df: DataFrame, hit_rate: str = "hit_rate", level: float = fixed.BREAKEVEN, otherwise: str = "Below breakeven") -> DataFrame:
    return df.withColumn("status", F.when(F.col(hit_rate) >= level, "PROFITABLE").otherwise(otherwise))


def model_agreement(df: DataFrame, preds: Sequence[str], line: str = "spread_a", cover: str = "cover_a") -> DataFrame:
    """Decided rows split by whether all models back the same side; the bet follows the mean edge."""
    edges = [edge_of(p, line) for p in preds]
    first = F.signum(edges[0])
    agree = F.lit(True)
    total = F.lit(0.0)
    for e in edges:
        agree = agree & (F.signum(e) == first)
        total = total + e
    mean_edge = total / len(edges)
    hit = hit_of(mean_edge, cover)
    scenario = F.when(agree, "All models agree").otherwise("Models disagree")
    out = (
        df.select(scenario.alias("scenario"), hit.alias("_hit"))
        .filter(F.col("_hit").isNotNull())
        .groupBy("scenario")
        .agg(F.count("*").alias("n_games"), count_where(F.col("_hit")).alias("_w"))
    )
    n, w = F.col("n_games"), F.col("_w")
    return out.select("scenario", "n_games", rate_of(w, n).alias("hit_rate"), roi_of(w, n).alias("roi"))


def roi(df: DataFrame, hit: str = "hit", juice: float = fixed.JUICE, by: Sequence[str] = ()) -> DataFrame:
    """Return of the settled bets (hit not NULL)."""
    out = df.groupBy(*by).agg(F.count(hit).alias("n_bets"), count_where(F.col(hit)).alias("_w"))
    return out.select(*by, "n_bets", roi_of(F.col("_w"), F.col("n_bets"), juice).alias("roi"))


def ensemble_fixed(weights: dict[str, float], prefix: str = "pred_") -> Column:
    """Weighted sum of prediction columns; unknown if any member is."""
    terms = [F.lit(float(w)) * F.col(prefix + m) for m, w in weights.items()]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def ensemble_available_models(df: DataFrame, weights: dict[str, float] | None = None, prefix: str = "pred_") -> Column:
    """Weighted sum over the models the frame has, weights renormalised at plan time."""
    weights = fixed.THREE_MODEL_WEIGHTS if weights is None else weights
    have = {m: w for m, w in weights.items() if prefix + m in df.columns}
    total = sum(have.values())
    if total == 0:
        raise ValueError("no model with a weight is in the frame")
    return ensemble_fixed({m: w / total for m, w in have.items()}, prefix)


def _weighted_mean(weights: dict[str, float], prefix: str) -> Column:
    num, den = F.lit(0.0), F.lit(0.0)
    for m, w in weights.items():
        p = X.null_if_nan(prefix + m)
        num = num + F.coalesce(F.lit(float(w)) * p, F.lit(0.0))
        den = den + F.when(p.isNotNull(), F.lit(float(w))).otherwise(0.0)
    return F.try_divide(num, den)


def ensemble_rowwise(
    weights: dict[str, float] | None = None, fallback: dict[str, float] | None = None, prefix: str = "pred_"
) -> Column:
    """Weighted mean of the members present on each row.

    When the members of `fallback` are all present and every other one is missing, the fallback
    weights apply.
    """
    weights = fixed.THREE_MODEL_WEIGHTS if weights is None else weights
    fallback = fixed.TWO_MODEL_WEIGHTS if fallback is None else fallback
    use_fallback = F.lit(True)
    for m in weights:
        known = X.null_if_nan(prefix + m).isNotNull()
        use_fallback = use_fallback & (known if m in fallback else ~known)
    return F.when(use_fallback, _weighted_mean(fallback, prefix)).otherwise(_weighted_mean(weights, prefix))


def combine_weighted(weights: dict[str, float], models: Sequence[str], prefix: str = "pred_") -> Column:
    """Plain weighted sum; a model without a weight adds nothing."""
    return ensemble_fixed({m: weights.get(m, 0.0) for m in models}, prefix)


def scored_rows(df: DataFrame, pred: str = "pred", line: str = "spread_a") -> DataFrame:
    """Rows with their edge columns, as written by the scoring job."""
    e = edge_of(pred, line)
    return df.withColumns({"pred_edge": e, "abs_edge": F.abs(e)})


def run_summary(sweep: DataFrame, selective: float) -> DataFrame:
    """One row: all bets beside the bets at the selective threshold."""
    all_bets = F.col("threshold") == 0.0
    chosen = F.col("threshold") == F.lit(float(selective))
    pick = lambda c, cond, name: F.max(F.when(cond, F.col(c))).alias(name)
    return sweep.agg(
        pick("hit_rate", all_bets, "all_bets_hit_rate"),
        pick("roi", all_bets, "all_bets_roi"),
        pick("n_bets", all_bets, "all_bets_n"),
        F.lit(float(selective)).alias("selective_threshold"),
        pick("hit_rate", chosen, "selective_hit_rate"),
        pick("roi", chosen, "selective_roi"),
        pick("n_bets", chosen, "selective_n"),
    )


def cv_summary(metrics: DataFrame, by: str = "model") -> DataFrame:
    """Mean and sample standard deviation of the metrics over folds."""
    return metrics.groupBy(by).agg(
        *[a for c in ("mae", "hit_rate", "roi") for a in (F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"))]
    )
