"""Scan and sink queries: views are written to the shared folder and scanned back."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Window
from pyspark.sql import functions as F

from matchline.functions import exprs as X
from matchline.functions import fixed
from matchline.operators import picks
from matchline.operators import evaluation as E
from matchline.operators import models as M
from matchline.operators import profile
from matchline.plans import backtest as B
from matchline.plans import features as plan
from matchline.sources import readers, writers
from matchline.sources.scratch import scratch_path

from .evaluation import METRICS, buckets_sql
from .fixtures import REG, r6, rounded, season_sql
from .joins import PAIRED, TR, paired

G = ("games",)


def _write_csv(df, path: str, by: str | None = None) -> None:
    w = df.write.option("header", True)
    (w.partitionBy(by) if by else w).csv(path)


@REG.add(
    "scan_team_rows",
    f"SELECT team_id, team_name, {season_sql('game_date')} AS season, strftime(game_date, '%b %-d, %Y') AS date, opponent, location, 'REG' AS game, result, CAST(winner_score AS DOUBLE) AS winner_score, CAST(loser_score AS DOUBLE) AS loser_score, ats, {r6('spread', 'spread')}, ou, {r6('total', 'total')} FROM fx_team_rows",
    TR,
)
def _(d):
    path = scratch_path(d.spark, "team-rows")
    _write_csv(d.team_rows.drop("src_key").withColumn("Unnamed: 14", F.lit(None).cast("string")), path)
    return rounded(readers.read_team_rows(d.spark, path).drop("file"), "spread", "total")


def _snapshot_files(d, by: str):
    path = scratch_path(d.spark, "ratings")
    _write_csv(d["all_ratings"].withColumn("day", F.date_format("snapshot_date", by)).drop("snapshot_date"), path, "day")
    return path


@REG.add("scan_dated_snapshots", "SELECT TeamName, snapshot_date, " + ", ".join(r6(c, c) for c in fixed.RATING_COLUMNS) + " FROM all_ratings", ("all_ratings",))
def _(d):
    rows = readers.read_dated_snapshots(d.spark, _snapshot_files(d, "yyyy-MM-dd") + "/*/*.csv")
    return rounded(rows.withColumn("TeamName", F.col("TeamName").cast("bigint")), *fixed.RATING_COLUMNS)


@REG.add("scan_season_snapshots", "SELECT TeamName, CAST(year(snapshot_date) AS INTEGER) AS season, true AS is_leaky, " + ", ".join(r6(c, c) for c in fixed.RATING_COLUMNS) + " FROM all_ratings", ("all_ratings",))
def _(d):
    rows = readers.read_season_snapshots(d.spark, _snapshot_files(d, "yyyy") + "/*/*.csv")
    return rounded(rows.withColumn("TeamName", F.col("TeamName").cast("bigint")), *fixed.RATING_COLUMNS)


@REG.add(
    "scan_rejects",
    "SELECT CASE WHEN TeamName % 7 = 0 THEN 'too many cells' WHEN TeamName % 7 = 1 THEN 'too few cells' END AS reject_reason, count(*) AS n_rows, CAST(sum(TeamName) AS BIGINT) AS team_sum, "
    "min(CASE WHEN TeamName % 7 > 0 THEN snapshot_date END) AS first_date FROM all_ratings GROUP BY 1",
    ("all_ratings",),
)
def _(d):
    # Without quotes, a comma in a value makes one cell too many; a line without its note has one too few. Files of odd years name a column otherwise.
    rows = d["all_ratings"].withColumn("note", F.when(F.col("TeamName") % 7 == 0, "a,b").otherwise("a"))
    line = F.concat_ws(",", F.col("TeamName").cast("string"), F.when(F.col("TeamName") % 7 != 1, F.col("note")), F.col("snapshot_date").cast("string"))
    head = F.when(F.year("snapshot_date") % 2 == 1, "TeamName,other,snapshot_date").otherwise("TeamName,note,snapshot_date")
    path = scratch_path(d.spark, "reject-rows")
    # One row per file: its header and its lines.
    files = rows.groupBy(F.year("snapshot_date").alias("year"), head.alias("head")).agg(F.array_join(F.collect_list(line), "\n").alias("body"))
    files.select("year", F.concat_ws("\n", "head", "body").alias("value")).write.partitionBy("year").text(path)
    found = readers.scan_csv(d.spark, f"{path}/*/*")
    # What is too short lacks its last cell, the date.
    date = F.coalesce(F.try_to_date("snapshot_date", "yyyy-MM-dd"), F.try_to_date(F.coalesce("note", "other"), "yyyy-MM-dd"))
    return found.groupBy("reject_reason").agg(
        F.count("*").alias("n_rows"), F.sum(F.col("TeamName").cast("bigint")).alias("team_sum"), F.min(F.when(F.col("reject_reason") == "too many cells", F.lit(None)).otherwise(date)).alias("first_date")
    )


@REG.add("scan_fail_on_empty", "SELECT count(*) AS n_rows, true AS empty_raises FROM all_ratings", ("all_ratings",))
def _(d):
    path = _snapshot_files(d, "yyyy-MM-dd")
    try:
        readers.read_dated_snapshots(d.spark, path + "/*/*.tsv")
        raised = False
    except AnalysisException:
        raised = True
    rows = readers.read_dated_snapshots(d.spark, path + "/*/*.csv")
    return rows.agg(F.count("*").alias("n_rows")).withColumn("empty_raises", F.lit(raised))


@REG.add("scan_pruned_parquet", f"SELECT game_key, season, date, team_a, team_b, {r6('spread_a', 'spread_a')}, final_margin_a, {r6('cover_a', 'cover_a')}, {r6('pred_gbm', 'pred_gbm')} FROM games", G)
def _(d):
    path = scratch_path(d.spark, "features")
    d["games"].write.parquet(path)
    return rounded(readers.read_scored(d.spark, path, ["pred_gbm", "absent"]), "spread_a", "cover_a", "pred_gbm")


@REG.add(
    "scan_optional_dims",
    "SELECT 'four_factors' AS name, count(*) AS n_rows FROM all_dims UNION ALL SELECT 'hca', count(*) FROM all_advantage",
    ("all_dims", "all_advantage"),
)
def _(d):
    base = scratch_path(d.spark, "dims")
    d["all_dims"].write.parquet(base + "/four_factors.parquet")
    d["all_advantage"].write.parquet(base + "/hca.parquet")
    found = readers.read_optional(d.spark, {n: f"{base}/{n}.parquet" for n in ("four_factors", "hca", "height_experience", "team_stats")})
    return readers.union_by_name(*[df.agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("name"), "n_rows") for n, df in found.items()])


@REG.add(
    "union_by_name",
    f"SELECT team, season, {r6('off_x', 'off_x')}, {r6('CAST(NULL AS DOUBLE)', 'hca')} FROM all_dims UNION ALL SELECT team, NULL, NULL, hca FROM all_advantage",
    ("all_dims", "all_advantage"),
)
def _(d):
    out = readers.union_by_name(d["all_dims"].select("season", "team", "off_x"), d["all_advantage"].select("hca", "team"))
    return rounded(out, "off_x", "hca")


@REG.add("load_name_map", "SELECT DISTINCT concat(p_name, ' ', p_type) AS raw_name, p_name AS canonical_name FROM part")
def _(d):
    path = scratch_path(d.spark, "map")
    pairs = d["part"].select(F.concat("p_name", F.lit(" "), "p_type").alias("team_name"), F.col("p_name").alias("canonical_name"), F.lit("auto").alias("notes"))
    _write_csv(pairs.distinct(), path)
    return readers.read_name_map(d.spark, path + "-v2-absent", path)


def _season_games(d):
    return d["games"].select("game_key", X.season_label("date").alias("season"), "date", "team_a", "spread_a")


@REG.add("sink_parquet_by_season", f"SELECT game_key, {season_sql('date')} AS season, date, team_a, {r6('spread_a', 'spread_a')} FROM games", G)
def _(d):
    path = scratch_path(d.spark, "by-season")
    writers.write_by_season(_season_games(d), path)
    return rounded(d.spark.read.parquet(path), "spread_a")


@REG.add("sink_report_csv", buckets_sql(), G)
def _(d):
    path = scratch_path(d.spark, "report")
    writers.write_report(E.edge_buckets(d["games"], "pred_ridge"), path)
    schema = "bucket string, n_games bigint, hit_rate double, roi double"
    return rounded(d.spark.read.schema(schema).option("header", True).csv(path), "hit_rate", "roi")


@REG.add(
    "sink_quarantine",
    f"WITH {PAIRED} SELECT src_key, team_id, location, reason AS quarantine_reason, CASE WHEN reason LIKE 'expected%' THEN 'row_count' WHEN reason LIKE 'could%' THEN 'unmapped' WHEN reason LIKE 'opponent%' THEN 'id_mismatch' ELSE 'venue' END AS quarantine_reason_code FROM rejects",
    TR,
)
def _(d):
    path = scratch_path(d.spark, "quarantine")
    writers.write_quarantine(paired(d)[1], path)
    return d.spark.read.parquet(path).select("src_key", "team_id", "location", "quarantine_reason", "quarantine_reason_code")


@REG.add(
    "predictions_by_date",
    f"SELECT game_key, date_trunc('month', date)::DATE AS pred_date, {r6('pred_gbm', 'pred_margin')} FROM games WHERE date_trunc('month', date) = (SELECT max(date_trunc('month', date)) FROM games)",
    G,
)
def _(d):
    path = scratch_path(d.spark, "predictions")
    rows = d["games"].select("game_key", F.trunc("date", "month").alias("pred_date"), F.col("pred_gbm").alias("pred_margin"))
    writers.write_predictions(rows.repartition("pred_date"), path)
    return rounded(picks.read_latest_date(d.spark.read.parquet(path)), "pred_margin")


@REG.add("sort_games", f"SELECT game_key, date, team_a, {r6('spread_a', 'spread_a')} FROM games", G)
def _(d):
    return rounded(d["games"].select("game_key", "date", "team_a", "spread_a"), "spread_a").orderBy("date", "team_a")


@REG.add("sample_rows", "SELECT game_key, date, team_a FROM games ORDER BY md5(concat(game_key, ':42')), game_key LIMIT 10", G)
def _(d):
    return profile.sample_rows(d["games"].select("game_key", "date", "team_a"), "game_key")


# --- models ----------------------------------------------------------------

TRAIN, VAL, TEST = [1995, 1996, 1997, 1998], [1999], [2000, 2001]


def modelable(d):
    """Matches with a line and a few numeric inputs, under the names the plans expect."""
    return d["games"].withColumn("kp_matched", F.lit(True)).filter(F.col("spread_a").isNotNull())


@REG.add(
    "standardise",
    "WITH s AS (SELECT "
    + ", ".join(f"avg(coalesce({c}, 0)) AS m_{c}, stddev_pop(coalesce({c}, 0)) AS s_{c}" for c in ("pred_dnn", "total_line"))
    + " FROM games WHERE season <= 1998) SELECT game_key, "
    + ", ".join(r6(f"(coalesce({c}, 0) - m_{c}) / s_{c}", c) for c in ("pred_dnn", "total_line"))
    + " FROM games, s",
    G,
)
def _(d):
    out = M.standardise(d["games"], d["games"].filter(F.col("season").isin(*TRAIN)), ["pred_dnn", "total_line"])
    return rounded(out.select("game_key", "pred_dnn", "total_line"), "pred_dnn", "total_line")


X_INPUTS = ["x_ridge", "x_gbm", "spread_a", "total_line"]


def _named(d):
    """Inputs renamed, so that the fitted predictions do not collide with them."""
    return modelable(d).withColumnsRenamed({"pred_ridge": "x_ridge", "pred_gbm": "x_gbm"})


def _train(d):
    return _named(d).filter(F.col("season").isin(*TRAIN))


def ridge_sql() -> str:
    """Ridge by the normal equations of z-scores, solved by elimination, one step per table."""
    source = {"x_ridge": "pred_ridge", "x_gbm": "pred_gbm"}
    cols = [f"CAST({source.get(c, c)} AS DOUBLE)" for c in X_INPUTS]
    k = len(cols)
    seasons = ", ".join(map(str, TRAIN))
    steps = [
        f"tr AS (SELECT {', '.join(f'{c} AS x{i}' for i, c in enumerate(cols))}, CAST(final_margin_a AS DOUBLE) AS y FROM games WHERE spread_a IS NOT NULL AND season IN ({seasons}))",
        "st AS (SELECT avg(y) AS my, " + ", ".join(f"avg(x{i}) AS m{i}, stddev_pop(x{i}) AS s{i}" for i in range(k)) + " FROM tr)",
    ]
    z = [f"((x{i} - m{i}) / s{i})" for i in range(k)]
    # One unit of penalty on each coefficient of a z-score.
    cells = [f"sum({z[i]} * {z[j]}) + {1 if i == j else 0} AS a{i}_{j}" for i in range(k) for j in range(k)] + [f"sum({z[i]} * (y - my)) AS a{i}_{k}" for i in range(k)]
    steps.append("e0 AS (SELECT " + ", ".join(cells) + " FROM tr, st)")
    for p in range(k):
        row = [f"a{p}_{j} / a{p}_{p} AS a{p}_{j}" for j in range(k + 1)]
        other = [f"a{i}_{j} - a{i}_{p} * a{p}_{j} / a{p}_{p} AS a{i}_{j}" for i in range(k) if i != p for j in range(k + 1)]
        steps.append(f"e{p + 1} AS (SELECT " + ", ".join(row + other) + f" FROM e{p})")
    fitted = " + ".join(["my"] + [f"a{i}_{k} * ({cols[i]} - m{i}) / s{i}" for i in range(k)])
    return "WITH " + ", ".join(steps) + f" SELECT game_key, {r6(fitted, 'pred_ridge')} FROM games, st, e{k} WHERE spread_a IS NOT NULL"


@REG.add("ridge_fit", ridge_sql(), G)
def _(d):
    out = M.score_models(_named(d), {"ridge": M.ridge_fit(_train(d), X_INPUTS)})
    return rounded(out.select("game_key", "pred_ridge"), "pred_ridge")


@REG.add("gbt_fit")
def _(d):
    out = M.score_models(_named(d), {"gbm": M.gbt_fit(_train(d), X_INPUTS)})
    return rounded(out.select("game_key", "pred_gbm"), "pred_gbm")


@REG.add("score_models")
def _(d):
    out = M.score_models(_named(d), M.fit_models(_train(d), X_INPUTS))
    return rounded(out.select("game_key", "pred_ridge", "pred_gbm"), "pred_ridge", "pred_gbm")


@REG.add("save_load_model")
def _(d):
    path = scratch_path(d.spark, "models")
    M.save_models(M.fit_models(_train(d), X_INPUTS), path, fixed.TWO_MODEL_WEIGHTS, 4.5, d.spark)
    loaded, weights, threshold = M.load_models(path, d.spark)
    out = M.score_models(_named(d), loaded).withColumn("pred", E.ensemble_fixed(weights))
    return rounded(out.select("game_key", "pred", F.lit(threshold).alias("threshold")), "pred")


@REG.add("top_feature_importance")
def _(d):
    return rounded(M.feature_importance(M.gbt_fit(_train(d), X_INPUTS), d.spark), "importance")


def _holdout(d):
    return B.holdout_evaluation(_named(d), X_INPUTS, TRAIN, VAL, TEST)


@REG.add("holdout_evaluation")
def _(d):
    return rounded(_holdout(d)["metrics"], "mae", "rmse", *METRICS)


@REG.add("holdout_summary")
def _(d):
    return B.holdout_summary(_holdout(d))


@REG.add("cross_validation")
def _(d):
    return rounded(B.cross_validation(_named(d), X_INPUTS, 5), "mae", "rmse", *METRICS)


@REG.add("ablation_table")
def _(d):
    place = lambda c, up: F.rank().over(Window.partitionBy("snapshot_date").orderBy(F.col(c).asc() if up else F.col(c).desc()))  # noqa: E731  one row a team
    ratings = d["ratings"].withColumns({n: place(c, c == "AdjDE") for n, c in zip(fixed.RANK_COLUMNS, fixed.RATING_COLUMNS, strict=True)})
    return B.ablation_table(plan.feature_table(d["games"], ratings), fixed.ABLATION_SETS, TRAIN, VAL, TEST)
