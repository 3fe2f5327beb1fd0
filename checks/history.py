"""History features and feature tables."""

from __future__ import annotations


from pyspark.sql import functions as F

from matchline.operators import history as H
from matchline.plans import features as plan
from matchline.sources.scratch import scratch_path
from matchline.streaming import state

from .cleaning import DIFFS, GR, RAW_MARGIN, SHORT, factors, rated_sql
from .fixtures import REG, r6, rounded

G = ("games",)

SIDES = (
    "sides AS (SELECT game_key, date, 'a' AS side, team_a AS entity, cover_a AS cover, CAST(final_margin_a AS DOUBLE) AS margin, CAST(points_a AS DOUBLE) AS points FROM games "
    "UNION ALL SELECT game_key, date, 'b', team_b, 1 - cover_a, CAST(-final_margin_a AS DOUBLE), CAST(points_b AS DOUBLE) FROM games)"
)
REST = (
    "rest AS (SELECT entity, date, least(coalesce(date_diff('day', lag(date) OVER (PARTITION BY entity ORDER BY date), date), 7), 14) AS rest_days FROM (SELECT DISTINCT entity, date FROM sides) t)"
)
# Mean of the last ten decided results before the day, from the decided rows alone.
ROLL = (
    "dec AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date, game_key) AS rn FROM sides WHERE cover IN (0, 1)), "
    "upto AS (SELECT s.entity, s.date, (SELECT count(*) FROM dec x WHERE x.entity = s.entity AND x.date < s.date) AS n FROM (SELECT DISTINCT entity, date FROM sides) s), "
    "roll AS (SELECT u.entity, u.date, CASE WHEN u.n >= 3 THEN avg(x.cover) ELSE 0.5 END AS rate FROM upto u LEFT JOIN dec x ON x.entity = u.entity AND x.rn <= u.n AND x.rn > u.n - 10 GROUP BY u.entity, u.date, u.n)"
)
ROLL_COMPAT = (
    "dec AS (SELECT *, row_number() OVER w AS rn, avg(cover) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS m, count(cover) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS c "
    "FROM sides WHERE cover IN (0, 1) WINDOW w AS (PARTITION BY entity ORDER BY date, game_key)), "
    "roll AS (SELECT entity, date, arg_min(CASE WHEN c >= 3 THEN m ELSE 0.5 END, game_key) AS rate FROM dec GROUP BY 1, 2)"
)
EW_PARTS = {"margin": "m", "points": "p"}
EW = (
    "pos AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date, game_key) AS i FROM sides), "
    "ewr AS (SELECT entity, date, game_key, "
    + ", ".join(
        f"CASE WHEN count({c}) OVER w >= 3 THEN sum({c} * pow(CAST(2 AS DOUBLE), i / CAST(5 AS DOUBLE))) OVER w / sum(CASE WHEN {c} IS NOT NULL THEN pow(CAST(2 AS DOUBLE), i / CAST(5 AS DOUBLE)) END) OVER w END AS ew_{c}"
        for c in EW_PARTS
    )
    + " FROM pos WINDOW w AS (PARTITION BY entity ORDER BY date, game_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), "
    "ew AS (SELECT entity, date, "
    + ", ".join(f"arg_min(ew_{c}, game_key) FILTER (WHERE ew_{c} IS NOT NULL) AS ew_{c}" for c in EW_PARTS)
    + " FROM ewr GROUP BY 1, 2)"
)


def both(table: str) -> str:
    return f"JOIN {table} a ON a.entity = g.team_a AND a.date = g.date JOIN {table} b ON b.entity = g.team_b AND b.date = g.date"


@REG.add("unpivot_sides", f"WITH {SIDES} SELECT game_key, date, side, entity, {r6('cover', 'cover')}, {r6('margin', 'margin')}, {r6('points', 'points')} FROM sides", G)
def _(d):
    return rounded(H.unpivot_sides(d["games"]), "cover", "margin", "points")


REST_OUT = "CAST(a.rest_days AS INTEGER) AS rest_days_a, CAST(b.rest_days AS INTEGER) AS rest_days_b, CAST(a.rest_days - b.rest_days AS INTEGER) AS rest_diff, CASE WHEN a.rest_days = 1 THEN 1 ELSE 0 END AS b2b_a, CASE WHEN b.rest_days = 1 THEN 1 ELSE 0 END AS b2b_b"


@REG.add("days_since_previous", f"WITH {SIDES}, {REST} SELECT g.game_key, {REST_OUT} FROM games g {both('rest')}", G)
def _(d):
    return H.days_since_previous(d["games"]).select("game_key", "rest_days_a", "rest_days_b", "rest_diff", "b2b_a", "b2b_b")


ROLLING = ["rolling_ats_a", "rolling_ats_b", "rolling_ats_diff"]


@REG.add("rolling_rate", f"WITH {SIDES}, {ROLL} SELECT g.game_key, {r6('a.rate', ROLLING[0])}, {r6('b.rate', ROLLING[1])}, {r6('a.rate - b.rate', ROLLING[2])} FROM games g {both('roll')}", G)
def _(d):
    return rounded(H.rolling_rate(d["games"]).select("game_key", *ROLLING), *ROLLING)


@REG.add(
    "rolling_rate_compat",
    f"WITH {SIDES}, {ROLL_COMPAT} SELECT g.game_key, {r6('coalesce(a.rate, 0.5)', ROLLING[0])}, {r6('coalesce(b.rate, 0.5)', ROLLING[1])}, {r6('coalesce(a.rate, 0.5) - coalesce(b.rate, 0.5)', ROLLING[2])} FROM games g "
    "LEFT JOIN roll a ON a.entity = g.team_a AND a.date = g.date LEFT JOIN roll b ON b.entity = g.team_b AND b.date = g.date",
    G,
)
def _(d):
    return rounded(H.rolling_rate(d["games"], compat=True).select("game_key", *ROLLING), *ROLLING)


EWS = ["ew_margin_a", "ew_margin_b", "ew_ppg_a", "ew_ppg_b", "ew_margin_diff"]
EW_OUT = f"{r6('a.ew_margin', EWS[0])}, {r6('b.ew_margin', EWS[1])}, {r6('a.ew_points', EWS[2])}, {r6('b.ew_points', EWS[3])}, {r6('a.ew_margin - b.ew_margin', EWS[4])}"


@REG.add("ew_mean", f"WITH {SIDES}, {EW} SELECT g.game_key, {EW_OUT} FROM games g {both('ew')}", G)
def _(d):
    return rounded(H.ew_mean(d["games"]).select("game_key", *EWS), *EWS)


KP = [f"{p}_{s}" for p in SHORT.values() for s in "ab"]
FEATURES = KP + [*DIFFS, "kp_pred_margin_raw", "kp_pred_margin"]
FEATURE_SQL = (
    f"WITH {rated_sql()}, {SIDES}, {REST}, {ROLL}, {EW}, ft AS (SELECT g.game_key, g.date, g.team_a, g.team_b, g.season, "
    "CASE WHEN g.is_neutral THEN 0 ELSE 1 END AS is_home_a, CASE WHEN g.is_neutral THEN 1 ELSE 0 END AS is_neutral, (kp_adj_em_a IS NOT NULL AND kp_adj_em_b IS NOT NULL) AS kp_matched, "
    + ", ".join(KP) + ", " + ", ".join(f"{v} AS {k}" for k, v in DIFFS.items())
    + f", {RAW_MARGIN} AS kp_pred_margin_raw, {RAW_MARGIN} + CASE WHEN g.is_neutral THEN 0 ELSE 3.5 END AS kp_pred_margin, "
    "ra.rest_days AS rest_days_a, rb.rest_days AS rest_days_b, oa.rate AS rolling_ats_a, ob.rate AS rolling_ats_b, "
    "ea.ew_margin AS ew_margin_a, eb.ew_margin AS ew_margin_b, ea.ew_points AS ew_ppg_a, eb.ew_points AS ew_ppg_b FROM rated g "
    + " ".join(
        f"JOIN {t} {x}{s} ON {x}{s}.entity = g.team_{s} AND {x}{s}.date = g.date" for t, x in (("rest", "r"), ("roll", "o"), ("ew", "e")) for s in "ab"
    )
    + ")"
)
HISTORY = ["rolling_ats_a", "rolling_ats_b", *EWS[:4]]


@REG.add(
    "feature_table",
    f"{FEATURE_SQL} SELECT game_key, is_home_a, is_neutral, kp_matched, CAST(rest_days_a AS INTEGER) AS rest_days_a, CAST(rest_days_b AS INTEGER) AS rest_days_b, "
    + ", ".join(r6(c, c) for c in [*FEATURES, *HISTORY]) + " FROM ft",
    GR,
)
def _(d):
    out = plan.feature_table(d["games"], d["ratings"])
    return rounded(
        out.select("game_key", "is_home_a", "is_neutral", "kp_matched", "rest_days_a", "rest_days_b", *FEATURES, *HISTORY), *FEATURES, *HISTORY
    )


def features(d):
    return plan.feature_table(d["games"], d["ratings"])


def dimensions(d):
    named = factors(d).withColumnRenamed("team", "TeamName")
    return {"four_factors": named, "height_exp": named, "hca": d["fx_advantage"].withColumnRenamed("team", "TeamName")}


EXTENDED = {
    "kp_adj_em_a": "ft.kp_adj_em_a", "ew_margin_a": "ft.ew_margin_a", "ff_off_efg_a": "fa.off_x", "ff_off_efg_b": "fb.off_x",
    "ht_avg_height_a": "fa.avg_height", "team_hca": "CASE WHEN ft.is_neutral = 1 THEN 0 ELSE coalesce(va.hca, 3.5) END",
    "team_elevation": "CASE WHEN ft.is_neutral = 1 THEN 0 ELSE coalesce(va.elevation, 0) END",
    "ff_efg_matchup_a": "fa.off_x - fb.def_x", "ff_to_matchup_b": "fa.def_x / 4 - fb.off_x / 2", "ht_height_diff": "fa.avg_height - fb.avg_height",
}


@REG.add(
    "feature_table_extended",
    f"{FEATURE_SQL} SELECT game_key, true AS is_leaky, " + ", ".join(r6(v, k) for k, v in EXTENDED.items())
    + " FROM ft LEFT JOIN fx_dims fa ON fa.team = ft.team_a AND fa.season = ft.season LEFT JOIN fx_dims fb ON fb.team = ft.team_b AND fb.season = ft.season LEFT JOIN fx_advantage va ON va.team = ft.team_a",
    (*GR, "fx_dims", "fx_advantage"),
)
def _(d):
    out = plan.feature_table_extended(features(d), dimensions(d))
    return rounded(out.select("game_key", "is_leaky", *EXTENDED), *EXTENDED)


FOLDS = (
    "p AS (SELECT game_key, date, row_number() OVER (ORDER BY date, md5(CAST(game_key AS VARCHAR)), game_key) - 1 AS position, count(*) OVER () AS n FROM games), "
    "f AS (SELECT *, n // 6 AS size, n - 5 * (n // 6) AS start FROM p), "
    "t AS (SELECT *, CASE WHEN position < start THEN 0 ELSE (position - start) // size + 1 END AS test_fold FROM f)"
)


@REG.add("expanding_folds", f"WITH {FOLDS} SELECT game_key, position, CAST(test_fold AS INTEGER) AS test_fold FROM t", G)
def _(d):
    return H.expanding_folds(d["games"]).select("game_key", "position", "test_fold")


@REG.add(
    "fold_roles",
    f"WITH {FOLDS} SELECT fold, CASE WHEN test_fold = fold THEN 'test' ELSE 'train' END AS role, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date FROM t CROSS JOIN (VALUES (1), (2), (3), (4), (5)) x(fold) WHERE test_fold <= fold GROUP BY 1, 2",
    G,
)
def _(d):
    return H.fold_roles(H.expanding_folds(d["games"]))


@REG.add(
    "history_state",
    f"WITH {SIDES}, pos AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY entity) AS n FROM sides WINDOW w AS (PARTITION BY entity ORDER BY date, game_key)), "
    "dec AS (SELECT entity, cover, row_number() OVER (PARTITION BY entity ORDER BY date DESC, game_key DESC) AS k FROM sides WHERE cover IN (0, 1)), "
    "rate AS (SELECT entity, CASE WHEN count(*) >= 3 THEN avg(cover) ELSE 0.5 END AS r FROM dec WHERE k <= 10 GROUP BY 1), "
    "e AS (SELECT entity, max(date) AS last_date, "
    + ", ".join(
        f"CASE WHEN count({c}) >= 3 THEN sum({c} * pow(CAST(2 AS DOUBLE), (i - n) / CAST(5 AS DOUBLE))) / sum(CASE WHEN {c} IS NOT NULL THEN pow(CAST(2 AS DOUBLE), (i - n) / CAST(5 AS DOUBLE)) END) END AS ew_{c}"
        for c in EW_PARTS
    )
    + f" FROM pos GROUP BY 1) SELECT entity, last_date, {r6('coalesce(r, 0.5)', 'rolling_rate')}, {r6('ew_margin', 'ew_margin')}, {r6('ew_points', 'ew_points')} FROM e LEFT JOIN rate USING (entity)",
    G,
)
def _(d):
    # Three micro-batches, none in order of the dates, the last one landing twice.
    path, games = scratch_path(d.spark, "history-state"), d["games"]
    for batch_id, third in ((0, 1), (1, 2), (2, 0), (2, 0)):
        state.update_history(games.filter(F.year("date") % 3 == third), batch_id, path)
    return rounded(state.history_now(state.current(d.spark, f"{path}/state")), "rolling_rate", "ew_margin", "ew_points")


@REG.add(
    "rating_state",
    "SELECT TeamName, snapshot_date, " + ", ".join(r6(c, c) for c in ("AdjEM", "AdjOE", "AdjDE", "AdjTempo")) + " FROM all_ratings QUALIFY row_number() OVER (PARTITION BY TeamName ORDER BY snapshot_date DESC) = 1",
    ("all_ratings",),
)
def _(d):
    path, ratings = scratch_path(d.spark, "rating-state"), d["all_ratings"]
    for batch_id, third in ((0, 1), (1, 2), (2, 0), (2, 0)):
        state.update_ratings(ratings.filter(F.year("snapshot_date") % 3 == third), batch_id, path)
    return rounded(state.current(d.spark, path), "AdjEM", "AdjOE", "AdjDE", "AdjTempo")
