"""Evaluation and calibration queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchline.functions import fixed
from matchline.operators import calibration as C
from matchline.operators import evaluation as E
from matchline.plans import backtest as B

from .fixtures import REG, r6, rounded

PAY = "CAST(100 AS DOUBLE) / CAST(110 AS DOUBLE)"
METRICS = ("hit_rate", "roi", "pct_games_bet")
MODELS = {"ridge": "pred_ridge", "gbm": "pred_gbm", "dnn": "pred_dnn"}


def rate(w: str, n: str) -> str:
    return f"CASE WHEN {n} = 0 THEN 0 ELSE CAST({w} AS DOUBLE) / {n} END"


def roi_sql(w: str, n: str) -> str:
    return f"CASE WHEN {n} = 0 THEN 0 ELSE ({w} * ({PAY}) - ({n} - {w})) / {n} END"


def bets(pred: str = "pred_ridge", more: str = "") -> str:
    """Oracle rows: edge, whether the label is decided, and the hit."""
    return (
        f"b AS (SELECT *, {pred} + spread_a AS edge, abs({pred} + spread_a) AS ae, "
        f"({pred} + spread_a IS NOT NULL AND cover_a IN (0, 1)) AS ok, "
        f"(({pred} + spread_a > 0) = (cover_a = 1)) AS hit {more} FROM games)"
    )


def metric_row(cond: str, by: str = "", threshold: str = "CAST(0 AS DOUBLE)") -> str:
    g = f"{by}, " if by else ""
    n, w = f"count(*) FILTER (WHERE {cond})", f"count(*) FILTER (WHERE {cond} AND hit)"
    return (
        f"SELECT {g}count(*) AS n_games, {threshold} AS threshold, {r6(rate(w, n), 'hit_rate')}, {r6(roi_sql(w, n), 'roi')}, "
        f"{n} AS n_bets, {r6(rate(n, 'count(*)'), 'pct_games_bet')}"
    )


@REG.add("edge_side_hit", f"WITH {bets()} SELECT game_key, {r6('edge', 'edge')}, {r6('ae', 'abs_edge')}, CASE WHEN edge > 0 THEN 'A' WHEN edge IS NOT NULL THEN 'B' END AS side, CASE WHEN ok THEN hit END AS hit FROM b", ("games",))
def _(d):
    out = E.with_edge(d["games"], "pred_ridge").select("game_key", "edge", "abs_edge", "side", "hit")
    return rounded(out, "edge", "abs_edge")


@REG.add("roi", f"WITH {bets()} SELECT season, count(*) FILTER (WHERE ok) AS n_bets, {r6(roi_sql('count(*) FILTER (WHERE ok AND hit)', 'count(*) FILTER (WHERE ok)'), 'roi')} FROM b GROUP BY season", ("games",))
def _(d):
    rows = E.with_edge(d["games"], "pred_ridge")
    return rounded(E.roi(rows, by=["season"]), "roi")


@REG.add(
    "evaluate_line",
    f"WITH {bets()}, m AS ({metric_row('ok AND ae >= 3', threshold='CAST(3 AS DOUBLE)')}, {r6('avg(abs(final_margin_a - pred_ridge))', 'mae')}, {r6('sqrt(avg((final_margin_a - pred_ridge) * (final_margin_a - pred_ridge)))', 'rmse')} FROM b) SELECT * FROM m",
    ("games",),
)
def _(d):
    out = E.evaluate_line(d["games"], "pred_ridge", margin="final_margin_a", threshold=3.0)
    return rounded(out, "mae", "rmse", *METRICS)


@REG.add(
    "evaluate_line_from_margin",
    f"WITH {bets()}, m AS ({metric_row('ok AND ae >= 4.5', 'season', 'CAST(4.5 AS DOUBLE)')}, {r6('avg(abs(final_margin_a - pred_ridge))', 'mae')}, {r6('sqrt(avg((final_margin_a - pred_ridge) * (final_margin_a - pred_ridge)))', 'rmse')} FROM b GROUP BY season) SELECT * FROM m",
    ("games",),
)
def _(d):
    out = E.evaluate_line(d["games"], "pred_ridge", cover=None, margin="final_margin_a", threshold=4.5, by=["season"])
    return rounded(out, "mae", "rmse", *METRICS)


def _by_model() -> str:
    parts = []
    for name, pred in MODELS.items():
        n, w = "count(*) FILTER (WHERE ok)", "count(*) FILTER (WHERE ok AND hit)"
        parts.append(
            f"SELECT season, '{name}' AS model, count(*) AS n_games, CAST(0 AS DOUBLE) AS threshold, "
            f"{r6(f'avg(abs(final_margin_a - {pred}))', 'mae')}, {r6(f'sqrt(avg((final_margin_a - {pred}) * (final_margin_a - {pred})))', 'rmse')}, "
            f"{r6(rate(w, n), 'hit_rate')}, {r6(roi_sql(w, n), 'roi')}, {n} AS n_bets, {r6(rate(n, 'count(*)'), 'pct_games_bet')} "
            f"FROM (WITH {bets(pred)} SELECT * FROM b) t GROUP BY season"
        )
    return " UNION ALL ".join(parts)


@REG.add("evaluate_by_group", _by_model(), ("games",))
def _(d):
    return rounded(E.evaluate_by_group(d["games"], MODELS, ["season"]), "mae", "rmse", *METRICS)


@REG.add(
    "cv_summary",
    "WITH m AS (" + _by_model() + ") SELECT model, "
    + ", ".join(f"{r6(f'avg({c})', c + '_mean')}, {r6(f'stddev_samp({c})', c + '_std')}" for c in ("mae", "hit_rate", "roi"))
    + " FROM m GROUP BY model",
    ("games",),
)
def _(d):
    metrics = rounded(E.evaluate_by_group(d["games"], MODELS, ["season"]), "mae", "hit_rate", "roi")
    out = E.cv_summary(metrics)
    return rounded(out, *[c for c in out.columns if c != "model"])


@REG.add("mae_rmse", f"SELECT season, count(final_margin_a - pred_dnn) AS n_games, {r6('avg(abs(final_margin_a - pred_dnn))', 'mae')}, {r6('sqrt(avg((final_margin_a - pred_dnn) * (final_margin_a - pred_dnn)))', 'rmse')} FROM games GROUP BY season", ("games",))
def _(d):
    return rounded(E.mae_rmse(d["games"], "pred_dnn", "final_margin_a", ["season"]), "mae", "rmse")


def grid_values(values) -> str:
    return "(VALUES " + ", ".join(f"(CAST({v!r} AS DOUBLE))" for v in values) + ") g(t)"


def sweep_sql(values, pred: str = "pred_ridge") -> str:
    n, w = "count(*) FILTER (WHERE ok AND ae >= t)", "count(*) FILTER (WHERE ok AND ae >= t AND hit)"
    return (
        f"WITH {bets(pred)} SELECT count(*) AS n_games, t AS threshold, {r6(rate(w, n), 'hit_rate')}, {r6(roi_sql(w, n), 'roi')}, {n} AS n_bets, "
        f"{r6(rate(n, 'count(*)'), 'pct_games_bet')} FROM b CROSS JOIN {grid_values(values)} GROUP BY t"
    )


@REG.add("threshold_sweep", sweep_sql(fixed.SWEEP_VALIDATION), ("games",))
def _(d):
    return rounded(E.threshold_sweep(d["games"], pred="pred_ridge"), *METRICS)


@REG.add("threshold_sweep_test", sweep_sql(fixed.SWEEP_TEST, "pred_gbm"), ("games",))
def _(d):
    return rounded(E.threshold_sweep(d["games"], fixed.SWEEP_TEST, pred="pred_gbm"), *METRICS)


@REG.add("threshold_sweep_fine", sweep_sql(fixed.SWEEP_FINE), ("games",))
def _(d):
    return rounded(E.threshold_sweep(d["games"], fixed.SWEEP_FINE, pred="pred_ridge"), *METRICS)


HALVES = [i * 0.5 for i in range(15)]


@REG.add(
    "tune_threshold",
    f"SELECT * FROM ({sweep_sql(HALVES)}) s ORDER BY n_bets >= 50 DESC, CASE WHEN n_bets >= 50 THEN roi END DESC NULLS LAST, threshold LIMIT 1",
    ("games",),
)
def _(d):
    return rounded(E.tune_threshold(d["games"], pred="pred_ridge"), *METRICS)


def bucket_sql(ae: str = "ae") -> str:
    arms = []
    for low, high, label in fixed.EDGE_BUCKETS:
        top = "" if high is None else f" AND {ae} < {high}"
        arms.append(f"WHEN {ae} >= {low}{top} THEN '{label}'")
    return "CASE " + " ".join(arms) + " END"


def buckets_sql(pred: str = "pred_ridge") -> str:
    w, n = "count(*) FILTER (WHERE hit)", "count(*)"
    return f"WITH {bets(pred)} SELECT {bucket_sql()} AS bucket, count(*) AS n_games, {r6(rate(w, n), 'hit_rate')}, {r6(roi_sql(w, n), 'roi')} FROM b WHERE ok GROUP BY 1"


def edge_buckets_query(d):
    return rounded(E.edge_buckets(d["games"], "pred_ridge"), "hit_rate", "roi")


REG.add("edge_buckets", buckets_sql(), ("games",))(edge_buckets_query)


@REG.add(
    "single_bucket_strategy",
    f"WITH {bets()}, c AS (SELECT count(*) AS n, count(*) FILTER (WHERE hit) AS w FROM b WHERE ok AND ae >= 5 AND ae < 7) SELECT n AS n_bets, {r6(rate('w', 'n'), 'hit_rate')}, {r6(roi_sql('w', 'n'), 'roi')}, CASE WHEN w * 1.0 / n >= 0.524 THEN 'PROFITABLE' ELSE 'Below breakeven' END AS status FROM c",
    ("games",),
)
def _(d):
    return rounded(E.single_bucket_strategy(d["games"], pred="pred_ridge"), "hit_rate", "roi")


@REG.add(
    "model_agreement",
    "WITH e AS (SELECT cover_a, pred_ridge + spread_a AS e1, pred_gbm + spread_a AS e2, pred_dnn + spread_a AS e3 FROM games), "
    "f AS (SELECT cover_a, (sign(e1) = sign(e2) AND sign(e1) = sign(e3)) AS agree, (e1 + e2 + e3) / 3 AS m FROM e WHERE cover_a IN (0, 1) AND e1 + e2 + e3 IS NOT NULL), "
    "c AS (SELECT CASE WHEN agree THEN 'All models agree' ELSE 'Models disagree' END AS scenario, count(*) AS n, count(*) FILTER (WHERE (m > 0) = (cover_a = 1)) AS w FROM f GROUP BY 1) "
    f"SELECT scenario, n AS n_games, {r6(rate('w', 'n'), 'hit_rate')}, {r6(roi_sql('w', 'n'), 'roi')} FROM c",
    ("games",),
)
def _(d):
    return rounded(E.model_agreement(d["games"], list(MODELS.values())), "hit_rate", "roi")


@REG.add("breakeven_flag", f"SELECT *, CASE WHEN hit_rate >= 0.524 THEN 'PROFITABLE' ELSE '' END AS status FROM ({sweep_sql(fixed.SWEEP_TEST)}) s", ("games",))
def _(d):
    sweep = rounded(E.threshold_sweep(d["games"], fixed.SWEEP_TEST, pred="pred_ridge"), *METRICS)
    return E.breakeven_flag(sweep, otherwise="")


@REG.add(
    "ensemble_fixed",
    f"SELECT game_key, {r6('0.4 * pred_ridge + 0.6 * pred_gbm', 'two')}, {r6('0.1 * pred_ridge + 0.2 * pred_gbm + 0.7 * pred_dnn', 'three')} FROM games",
    ("games",),
)
def _(d):
    out = d["games"].select(
        "game_key", E.ensemble_fixed(fixed.TWO_MODEL_WEIGHTS).alias("two"), E.ensemble_fixed(fixed.THREE_MODEL_WEIGHTS).alias("three")
    )
    return rounded(out, "two", "three")


@REG.add("ensemble_available_models", f"SELECT game_key, {r6('pred_ridge * (CAST(1 AS DOUBLE) / 3) + pred_gbm * (CAST(2 AS DOUBLE) / 3)', 'pred')} FROM games", ("games",))
def _(d):
    have = d["games"].drop("pred_dnn")
    return rounded(have.select("game_key", E.ensemble_available_models(have).alias("pred")), "pred")


@REG.add(
    "ensemble_rowwise_null",
    f"SELECT game_key, {r6('CASE WHEN pred_dnn IS NULL THEN 0.4 * pred_ridge + 0.6 * pred_gbm ELSE 0.1 * pred_ridge + 0.2 * pred_gbm + 0.7 * pred_dnn END', 'pred')} FROM games",
    ("games",),
)
def _(d):
    return rounded(d["games"].select("game_key", E.ensemble_rowwise().alias("pred")), "pred")


@REG.add("scored_rows", f"SELECT game_key, date, team_a, team_b, spread_a, final_margin_a, cover_a, {r6('pred_gbm', 'pred')}, {r6('pred_gbm + spread_a', 'pred_edge')}, {r6('abs(pred_gbm + spread_a)', 'abs_edge')} FROM games", ("games",))
def _(d):
    rows = d["games"].select("game_key", "date", "team_a", "team_b", "spread_a", "final_margin_a", "cover_a", F.col("pred_gbm").alias("pred"))
    return rounded(E.scored_rows(rows), "pred", "pred_edge", "abs_edge")


@REG.add(
    "run_summary",
    f"WITH s AS (SELECT * FROM ({sweep_sql([0.0, 5.0])}) x) SELECT a.hit_rate AS all_bets_hit_rate, a.roi AS all_bets_roi, a.n_bets AS all_bets_n, CAST(5 AS DOUBLE) AS selective_threshold, c.hit_rate AS selective_hit_rate, c.roi AS selective_roi, c.n_bets AS selective_n FROM s a, s c WHERE a.threshold = 0 AND c.threshold = 5",
    ("games",),
)
def _(d):
    out = E.run_summary(E.threshold_sweep(d["games"], [0.0, 5.0], pred="pred_ridge"), 5.0)
    return rounded(out, "all_bets_hit_rate", "all_bets_roi", "selective_hit_rate", "selective_roi")


# --- calibration -----------------------------------------------------------


@REG.add("profitable_buckets", f"SELECT * FROM ({buckets_sql('pred_gbm')}) s WHERE n_games >= 30 AND hit_rate >= 0.505", ("games",))
def _(d):
    out = C.profitable_buckets(d["games"], "pred_gbm", breakeven=0.505)
    return rounded(out, "hit_rate", "roi")


@REG.add(
    "bucket_filter",
    f"WITH p AS (SELECT bucket FROM ({buckets_sql('pred_gbm')}) s WHERE n_games >= 30 AND hit_rate >= 0.505), e AS (SELECT game_key, pred_gbm + spread_a AS edge, {bucket_sql('abs(pred_gbm + spread_a)')} AS bucket FROM games) SELECT bucket, game_key, {r6('edge', 'edge')} FROM e WHERE bucket IN (SELECT bucket FROM p)",
    ("games",),
)
def _(d):
    good = C.profitable_buckets(d["games"], "pred_gbm", breakeven=0.505)
    rows = E.with_edge(d["games"], "pred_gbm").select("game_key", "edge")
    return rounded(C.bucket_filter(rows, good), "edge")


def lattice_sql(threshold: float) -> str:
    rows = ", ".join(
        f"({i}, " + ", ".join(f"CAST({w!r} AS DOUBLE)" for w in ws) + ")" for i, ws in enumerate(C.simplex_lattice(3))
    )
    edge = "(w_ridge * pred_ridge + w_gbm * pred_gbm + w_dnn * pred_dnn) + spread_a"
    return (
        f"WITH g(grid_pos, w_ridge, w_gbm, w_dnn) AS (VALUES {rows}), "
        f"x AS (SELECT grid_pos, w_ridge, w_gbm, w_dnn, cover_a, {edge} AS e FROM games CROSS JOIN g WHERE cover_a IN (0, 1)), "
        f"c AS (SELECT grid_pos, w_ridge, w_gbm, w_dnn, count(*) FILTER (WHERE abs(e) >= {threshold}) AS n, count(*) FILTER (WHERE abs(e) >= {threshold} AND (e > 0) = (cover_a = 1)) AS w FROM x GROUP BY ALL) "
        f"SELECT grid_pos, w_ridge, w_gbm, w_dnn, n AS n_bets, {rate('w', 'n')} AS hit_rate, {roi_sql('w', 'n')} AS roi FROM c"
    )


def _grid_out(inner: str, score: str, having: str) -> str:
    return f"SELECT grid_pos, w_ridge, w_gbm, w_dnn, n_bets, {r6('hit_rate', 'hit_rate')}, {r6('roi', 'roi')} FROM (SELECT * FROM ({inner}) s WHERE {having} ORDER BY {score} DESC, grid_pos LIMIT 1) t"


@REG.add("weight_search_roi", _grid_out(lattice_sql(4.5), "roi", "n_bets >= 50"), ("games",))
def _(d):
    return rounded(C.weight_search_roi(d["games"]), "hit_rate", "roi")


@REG.add("weight_search_hit_rate", _grid_out(lattice_sql(0.0), "hit_rate", "n_bets >= 0"), ("games",))
def _(d):
    return rounded(C.weight_search_hit_rate(d["games"]), "hit_rate", "roi")


@REG.add("argmax_grid", f"SELECT * FROM ({sweep_sql(fixed.STABILITY_THRESHOLDS)}) s WHERE n_bets >= 100 ORDER BY roi DESC, threshold LIMIT 1", ("games",))
def _(d):
    sweep = rounded(E.threshold_sweep(d["games"], fixed.STABILITY_THRESHOLDS, pred="pred_ridge"), *METRICS)
    return E.argmax_grid(sweep, "roi", "threshold", 100)


@REG.add("combine_weighted", f"SELECT game_key, {r6('0.25 * pred_ridge + 0.5 * pred_gbm + 0 * pred_dnn', 'pred')} FROM games", ("games",))
def _(d):
    out = d["games"].select("game_key", E.combine_weighted({"ridge": 0.25, "gbm": 0.5}, ["ridge", "gbm", "dnn"]).alias("pred"))
    return rounded(out, "pred")


TEMPS = [1.0] + [t for t in C.temperatures(*fixed.TEMPERATURE_RANGE) if t != 1.0]


@REG.add(
    "temperature_search",
    "WITH g(pos, temperature) AS (VALUES " + ", ".join(f"({i}, CAST({t!r} AS DOUBLE))" for i, t in enumerate(TEMPS)) + f"), {bets('pred_gbm')}, "
    "c AS (SELECT pos, temperature, count(*) FILTER (WHERE ok AND ae / temperature >= 4.5) AS n, count(*) FILTER (WHERE ok AND ae / temperature >= 4.5 AND hit) AS w FROM b CROSS JOIN g GROUP BY ALL) "
    f"SELECT temperature, {r6(rate('w', 'n'), 'hit_rate')}, n AS n_bets FROM c WHERE pos = 0 OR n >= 100 ORDER BY CASE WHEN n = 0 THEN 0 ELSE CAST(w AS DOUBLE) / n END DESC, pos LIMIT 1",
    ("games",),
)
def _(d):
    return rounded(C.temperature_search(d["games"], "pred_gbm"), "hit_rate")


@REG.add("temperature_apply", f"SELECT game_key, {r6('-spread_a + (pred_gbm + spread_a) / 1.25', 'pred_scaled')} FROM games", ("games",))
def _(d):
    return rounded(d["games"].select("game_key", C.temperature_apply("pred_gbm", "spread_a", 1.25).alias("pred_scaled")), "pred_scaled")


def _polynomial(coefficients, x: str) -> str:
    out = f"CAST({coefficients[0]!r} AS DOUBLE)"
    for c in coefficients[1:]:
        out = f"({out} * {x} + CAST({c!r} AS DOUBLE))"
    return out


def _tail(p: str) -> str:
    root = f"sqrt(CAST(-2.0 AS DOUBLE) * ln({p}))"
    return f"{_polynomial(C.NORMAL_TAIL[0], root)} / {_polynomial(C.NORMAL_TAIL[1], root)}"


def _poisson_sql() -> str:
    return "CASE " + " ".join(f"WHEN h < '{c}' THEN {k}" for k, c in enumerate(C.poisson_cuts())) + f" ELSE {len(C.poisson_cuts())} END"


def stability_sql(pred: str) -> str:
    steps = grid_values(fixed.STABILITY_THRESHOLDS)
    return (
        f"WITH {bets(pred)}, d AS (SELECT ae, hit, r.rep, substr(md5(concat(game_key, ':', (r.rep - 1) // 4)), CAST(8 * ((r.rep - 1) % 4) + 1 AS INTEGER), 8) AS h "
        "FROM b CROSS JOIN (SELECT unnest(range(1, 101)) AS rep) r WHERE ok AND ae >= 3), "
        f"x AS (SELECT ae, hit, rep, {_poisson_sql()} AS wt FROM d), "
        f"c AS (SELECT rep, t, sum(wt) AS n, sum(CASE WHEN hit THEN wt ELSE 0 END) AS w FROM x CROSS JOIN {steps} WHERE ae >= t GROUP BY rep, t), "
        f"r2 AS (SELECT t, {roi_sql('w', 'n')} AS roi FROM c WHERE n >= 20), "
        "s AS (SELECT t AS threshold, count(*) AS n_reps, avg(roi) AS mean_roi, stddev_pop(roi) AS std_roi, avg(CASE WHEN roi > 0 THEN 1.0 ELSE 0.0 END) AS pct FROM r2 GROUP BY t HAVING count(*) >= 50) "
        f"SELECT threshold, n_reps, {r6('mean_roi', 'mean_roi')}, {r6('std_roi', 'std_roi')}, {r6('pct', 'pct_profitable')}, {r6('CASE WHEN pct > 0.5 THEN mean_roi / (std_roi + 0.01) ELSE -1 END', 'stability')} FROM s"
    )


def cell_stability_sql(pred: str) -> str:
    steps = grid_values(fixed.STABILITY_THRESHOLDS)
    reached = " + ".join(f"CASE WHEN ae >= {t} THEN 1 ELSE 0 END" for t in sorted(fixed.STABILITY_THRESHOLDS))
    square = "((u - 0.5) * (u - 0.5))"
    centre = f"(u - 0.5) * {_polynomial(C.NORMAL_CENTRE[0], square)} / {_polynomial(C.NORMAL_CENTRE[1], square)}"
    edge = f"CAST({C.NORMAL_EDGE!r} AS DOUBLE)"
    return (
        f"WITH {bets(pred)}, cells AS (SELECT {reached} - 1 AS bin, CASE WHEN hit THEN 1 ELSE 0 END AS h, CAST(count(*) AS DOUBLE) AS n FROM b WHERE ok AND ae >= {min(fixed.STABILITY_THRESHOLDS)} GROUP BY 1, 2), "
        "d AS (SELECT bin, h, n, r.rep, (CAST('0x' || left(md5(concat_ws(':', '0', r.rep, bin, h)), 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u FROM cells, (SELECT unnest(range(1, 101)) AS rep) r), "
        f"z AS (SELECT *, CASE WHEN u < {edge} THEN {_tail('u')} WHEN u > 1 - {edge} THEN -({_tail('(1 - u)')}) ELSE {centre} END AS z FROM d), "
        # Cumulative probabilities of the small cells, term by term.
        f"e AS (SELECT n, k, sum(exp(k * ln(n) - n - lgamma(k + 1))) OVER (PARTITION BY n ORDER BY k) AS p FROM (SELECT n, CAST(unnest(range(CAST(n + 12 * sqrt(n) + 25 AS BIGINT))) AS DOUBLE) AS k FROM (SELECT DISTINCT n FROM cells WHERE n <= {C.EXACT_MEAN}) s) t), "
        "x AS (SELECT bin, h, rep, CASE WHEN n <= " + str(C.EXACT_MEAN) + " THEN (SELECT min(k) FROM e WHERE e.n = z.n AND e.p >= z.u) "
        "ELSE greatest(floor(n + z * sqrt(n) + (z * z - 1) / 6 + (z - z * z * z) / (72 * sqrt(n)) + 0.5), 0) END AS wt FROM z), "
        f"c AS (SELECT rep, t, sum(wt) AS n, sum(wt * h) AS w FROM x JOIN (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i FROM {steps}) g ON bin >= i GROUP BY rep, t), "
        f"r2 AS (SELECT t, {roi_sql('w', 'n')} AS roi FROM c WHERE n >= 20), "
        "s AS (SELECT t AS threshold, count(*) AS n_reps, avg(roi) AS mean_roi, stddev_pop(roi) AS std_roi, avg(CASE WHEN roi > 0 THEN 1.0 ELSE 0.0 END) AS pct FROM r2 GROUP BY t HAVING count(*) >= 50) "
        f"SELECT threshold, n_reps, {r6('mean_roi', 'mean_roi')}, {r6('std_roi', 'std_roi')}, {r6('pct', 'pct_profitable')}, {r6('CASE WHEN pct > 0.5 THEN mean_roi / (std_roi + 0.01) ELSE -1 END', 'stability')} FROM s"
    )


@REG.add("bootstrap_threshold_stability", stability_sql("pred_gbm"), ("games",))
def _(d):
    out = C.bootstrap_threshold_stability(C.bootstrap_rois(d["games"], pred="pred_gbm"))
    return rounded(out, "mean_roi", "std_roi", "pct_profitable", "stability")


@REG.add(
    "bootstrap_replicates",
    cell_stability_sql("pred_gbm").split(", r2 AS")[0].replace("WITH ", "WITH ", 1) + f" SELECT CAST(rep AS INTEGER) AS rep, t AS threshold, CAST(n AS BIGINT) AS n_bets, {r6(roi_sql('w', 'n'), 'roi')} FROM c",
    ("games",),
)
def _(d):
    return rounded(C.bootstrap_rois_by_cell(d["games"], pred="pred_gbm"), "roi")


def _isotonic(d):
    rows = E.with_edge(d["games"], "pred_gbm").select("game_key", "edge")
    return C.isotonic_calibrate(rows, C.fit_isotonic(d["games"], "pred_gbm"))


# Monotone fit by its max-min formula, then linear interpolation between the points.
ISO = (
    f"{bets('pred_gbm')}, pts AS (SELECT ae AS x, avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) AS y, count(*) AS w FROM b WHERE ok GROUP BY ae), "
    "acc AS (SELECT x, row_number() OVER (ORDER BY x) AS i, sum(w) OVER (ORDER BY x) AS sw, sum(w * y) OVER (ORDER BY x) AS sy, w, w * y AS wy FROM pts), "
    "pool AS (SELECT l.i AS a, r.i AS i, min((r.sy - l.sy + l.wy) / (r.sw - l.sw + l.w)) OVER (PARTITION BY l.i ORDER BY r.i DESC) AS m FROM acc l JOIN acc r ON l.i <= r.i), "
    "fit AS (SELECT acc.x, f.y FROM acc JOIN (SELECT i, max(m) AS y FROM pool GROUP BY i) f USING (i)), "
    "near AS (SELECT b.game_key, b.edge, b.ae, lo.x AS x0, lo.y AS y0, hi.x AS x1, hi.y AS y1 FROM b ASOF LEFT JOIN fit lo ON b.ae >= lo.x ASOF LEFT JOIN fit hi ON b.ae <= hi.x), "
    "iso AS (SELECT game_key, edge, CASE WHEN edge IS NULL THEN NULL ELSE least(greatest(CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL THEN y0 WHEN x0 = x1 THEN y0 ELSE y0 + (y1 - y0) * (ae - x0) / (x1 - x0) END, 0.4), 0.7) END AS p FROM near)"
)


@REG.add("isotonic_calibrate", f"WITH {ISO} SELECT game_key, {r6('edge', 'edge')}, {r6('p', 'cover_prob')} FROM iso", ("games",))
def _(d):
    return rounded(_isotonic(d), "edge", "cover_prob")


@REG.add("probability_filter", f"WITH {ISO} SELECT game_key, {r6('edge', 'edge')}, {r6('p', 'cover_prob')} FROM iso WHERE p >= 0.5", ("games",))
def _(d):
    return rounded(C.probability_filter(_isotonic(d), 0.5), "edge", "cover_prob")


# Every edge is distinct: the key adds a fraction of its own to the prediction.
FINE = "games_fine AS (SELECT *, pred_gbm + CAST(game_key AS DOUBLE) / 16777216 AS pred_fine FROM games)"
FINE_BETS = f"{FINE}, " + bets("pred_fine").replace("FROM games", "FROM games_fine")
# The fit is the lower hull of the cumulative hits: from each corner the hull goes on to the point with the least slope, the last one of several.
HULL = (
    f"{FINE_BETS}, pts AS (SELECT ae AS x, CAST(count(*) FILTER (WHERE hit) AS DOUBLE) AS y, CAST(count(*) AS DOUBLE) AS w FROM b WHERE ok GROUP BY ae), "
    "acc AS (SELECT 0 AS i, CAST(NULL AS DOUBLE) AS x, CAST(0 AS DOUBLE) AS sw, CAST(0 AS DOUBLE) AS sy UNION ALL "
    "SELECT row_number() OVER (ORDER BY x), x, sum(w) OVER (ORDER BY x), sum(y) OVER (ORDER BY x) FROM pts), "
    "hull AS (WITH RECURSIVE h(i) AS (SELECT CAST(0 AS BIGINT) UNION ALL "
    "SELECT max(i) FROM (SELECT a.i, (a.sy - o.sy) / (a.sw - o.sw) AS slope, min((a.sy - o.sy) / (a.sw - o.sw)) OVER () AS best "
    "FROM h JOIN acc o ON o.i = h.i JOIN acc a ON a.i > h.i) t WHERE slope = best HAVING count(*) > 0) SELECT * FROM h), "
    "blocks AS (SELECT lo.i AS i0, hi.i AS i1, hi.x AS high, hi.sw - lo.sw AS n, hi.sy - lo.sy AS hits FROM (SELECT i, lead(i) OVER (ORDER BY i) AS j FROM hull) c JOIN acc lo ON lo.i = c.i JOIN acc hi ON hi.i = c.j)"
)


def fine(d):
    return d["games"].withColumn("pred_fine", F.col("pred_gbm") + F.col("game_key").cast("double") / F.lit(16777216.0))


@REG.add(
    "isotonic_blocks",
    f"WITH {HULL} SELECT f.x AS low, high, CAST(n AS BIGINT) AS n_rows, CAST(hits AS BIGINT) AS hits, {r6('hits / n', 'rate')} FROM blocks JOIN acc f ON f.i = i0 + 1",
    ("games",),
)
def _(d):
    return rounded(C.calibration_blocks(fine(d), "pred_fine"), "rate")


@REG.add(
    "isotonic_distinct_edges",
    f"WITH {HULL}, fit AS (SELECT a.x, b.hits / b.n AS y FROM acc a JOIN blocks b ON a.i > b.i0 AND a.i <= b.i1), "
    + ISO[ISO.index("near AS") :] + f" SELECT game_key, {r6('edge', 'edge')}, {r6('p', 'cover_prob')} FROM iso",
    ("games",),
)
def _(d):
    rows = E.with_edge(fine(d), "pred_fine").select("game_key", "edge")
    return rounded(C.isotonic_calibrate(rows, C.fit_isotonic(fine(d), "pred_fine")), "edge", "cover_prob")


def _calibrated(sql: str) -> str:
    """An oracle over the matches with the combined prediction."""
    return sql.replace("FROM games", "FROM combined")


TEMPERATURE = (
    "WITH g(pos, temperature) AS (VALUES " + ", ".join(f"({i}, CAST({t!r} AS DOUBLE))" for i, t in enumerate(TEMPS)) + "), " + _calibrated(bets("pred_cal"))
    + ", c AS (SELECT pos, temperature, count(*) FILTER (WHERE ok AND ae / temperature >= 4.5) AS n, count(*) FILTER (WHERE ok AND ae / temperature >= 4.5 AND hit) AS w FROM b CROSS JOIN g GROUP BY ALL) "
    "SELECT temperature FROM c WHERE pos = 0 OR n >= 100 ORDER BY CASE WHEN n = 0 THEN 0 ELSE CAST(w AS DOUBLE) / n END DESC, pos LIMIT 1"
)
ORDERED = "CASE bucket " + " ".join(f"WHEN '{b}' THEN {i}" for i, (_, _, b) in enumerate(fixed.EDGE_BUCKETS)) + " END"
CALIBRATION = (
    f"best AS ({_grid_out(lattice_sql(4.5), 'roi', 'n_bets >= 50')}), "
    "combined AS (SELECT g.*, w_ridge * pred_ridge + w_gbm * pred_gbm + w_dnn * pred_dnn AS pred_cal FROM games g CROSS JOIN best)"
)


@REG.add(
    "calibration_fit",
    f"WITH {CALIBRATION} SELECT '{{\"ridge\": ' || w_ridge || ', \"gbm\": ' || w_gbm || ', \"dnn\": ' || w_dnn || '}}' AS weights, ({TEMPERATURE}) AS temperature, "
    f"coalesce((SELECT threshold FROM ({_calibrated(cell_stability_sql('pred_cal'))}) s ORDER BY stability DESC, threshold LIMIT 1), CAST({fixed.DEFAULT_THRESHOLD} AS DOUBLE)) AS threshold, "
    f"coalesce((SELECT string_agg(bucket, ',' ORDER BY {ORDERED}) FROM ({_calibrated(buckets_sql('pred_cal'))}) s WHERE n_games >= 30 AND hit_rate >= {fixed.BREAKEVEN}), '') AS buckets, true AS monotone FROM best",
    ("games",),
)
def _(d):
    return C.calibration_fit(d["games"]).to_row(d.spark).withColumn("buckets", F.array_join("buckets", ","))


FITTED = REG.sql["calibration_fit"][REG.sql["calibration_fit"].index("SELECT '{") :]


@REG.add(
    "calibrated_bet_mask",
    f"WITH {CALIBRATION}, {_calibrated(bets('pred_cal'))}, " + HULL[HULL.index("pts AS") :]
    + f", fit AS (SELECT a.x, b.hits / b.n AS y FROM acc a JOIN blocks b ON a.i > b.i0 AND a.i <= b.i1), state AS ({FITTED}), "
    "scaled AS (SELECT game_key, spread_a, -spread_a + (pred_cal + spread_a) / temperature AS pred_scaled, threshold, buckets FROM combined CROSS JOIN state), "
    "z AS (SELECT *, pred_scaled + spread_a AS edge, abs(pred_scaled + spread_a) AS ae FROM scaled), "
    + ISO[ISO.index("near AS") :].replace("b.", "z.").replace("FROM b ", "FROM z ")
    + f" SELECT game_key, {r6('pred_scaled', 'pred_scaled')}, {r6('z.edge', 'edge')}, {r6('p', 'cover_prob')}, "
    f"coalesce(z.ae >= threshold AND (buckets = '' OR list_contains(string_split(buckets, ','), {bucket_sql('z.ae')})) AND p >= 0.5, false) AS is_bet FROM z JOIN iso USING (game_key)",
    ("games",),
)
def _(d):
    cal = C.calibration_fit(d["games"])
    out = C.calibrated_bet_mask(d["games"], cal, min_prob=0.5)
    return rounded(out.select("game_key", "pred_scaled", "edge", "cover_prob", "is_bet"), "pred_scaled", "edge", "cover_prob")


@REG.add("selective_backtest")
def _(d):
    games = d["games"]
    middle = games.agg(F.percentile("season", 0.6).cast("int")).first()[0]
    out = B.selective_backtest(games.filter(F.col("season") <= middle), games.filter(F.col("season") > middle))
    return rounded(out, "hit_rate", "roi")
