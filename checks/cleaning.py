"""Projection, filter and cleaning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchline.functions import exprs as X
from matchline.functions import fixed
from matchline.operators import asof, cleaning, dims
from matchline.operators import pairing
from matchline.plans import features as plan

from .fixtures import REG, r6, rounded, season_sql

VALUES = plan.RATING_VALUES
SHORT = {"AdjEM": "kp_adj_em", "AdjOE": "kp_adj_o", "AdjDE": "kp_adj_d", "AdjTempo": "kp_tempo"}


def rated(d):
    return asof.asof_snapshot_join(d["games"], d["ratings"], VALUES)


def rated_sql(tolerance: str = "AND s.snapshot_date >= g.date - INTERVAL 365 DAY") -> str:
    """Oracle: games with both sides' ratings from the newest earlier snapshot."""
    cols = ", ".join(f"{s}.{c} AS {p}_{s}" for s in "ab" for c, p in SHORT.items())
    return (
        "cal AS (SELECT g.date, max(s.snapshot_date) AS snap FROM (SELECT DISTINCT date FROM games) g "
        f"JOIN (SELECT DISTINCT snapshot_date FROM ratings) s ON s.snapshot_date < g.date {tolerance} GROUP BY 1), "
        f"rated AS (SELECT g.*, cal.snap AS kp_snapshot_date, {cols} FROM games g LEFT JOIN cal ON g.date = cal.date "
        "LEFT JOIN ratings a ON a.TeamName = g.team_a AND a.snapshot_date = cal.snap "
        "LEFT JOIN ratings b ON b.TeamName = g.team_b AND b.snapshot_date = cal.snap)"
    )


G = ("games",)
GR = ("games", "ratings")


@REG.add("parse_event_date", "SELECT game_key, CASE WHEN game_key % 29 = 0 THEN NULL ELSE date END AS date_parsed FROM games", G)
def _(d):
    raw = F.when(F.col("game_key") % 29 == 0, "Foo 99, 2024").otherwise(F.date_format("date", "MMM dd, yyyy"))
    return d["games"].select("game_key", X.parse_event_date(raw).alias("date_parsed"))


def _messy(c):
    k = F.col("game_key") % 6
    text = F.col(c).cast("string")
    return (
        F.when(k == 0, "n/a").when(k == 1, F.concat(F.lit("+"), text)).when(k == 2, F.concat(F.lit(" "), text, F.lit(" ")))
        .when(k == 3, "").when(k == 4, F.concat(text, F.lit("e1"))).otherwise(text)
    )


@REG.add(
    "coerce_numeric",
    "SELECT game_key, CASE WHEN game_key % 6 IN (0, 3) THEN NULL WHEN game_key % 6 = 4 THEN CAST(points_a * 10 AS DOUBLE) ELSE CAST(points_a AS DOUBLE) END AS points_a FROM games",
    G,
)
def _(d):
    return cleaning.coerce_numeric(d["games"].select("game_key", _messy("points_a").alias("points_a")), ["points_a", "absent"])


@REG.add("strip_sign_prefix", f"SELECT game_key, {r6('spread_a', 'adj')} FROM games", G)
def _(d):
    raw = F.when(F.col("spread_a") > 0, F.concat(F.lit("+"), F.col("spread_a").cast("string"))).otherwise(F.col("spread_a").cast("string"))
    return rounded(d["games"].select("game_key", X.to_number(X.strip_sign(raw)).alias("adj")), "adj")


@REG.add("normalise_key", "SELECT DISTINCT lower(p_name) AS name_key FROM part")
def _(d):
    raw = F.concat(F.lit(" \t"), F.upper("p_name"), F.lit("  "))
    return d["part"].select(X.normalise_key(raw).alias("name_key")).distinct()


@REG.add(
    "own_score_projection",
    "SELECT src_key, team_id, location, CASE WHEN result = 'W' THEN winner_score ELSE loser_score END AS own_score, CASE WHEN result = 'W' THEN loser_score ELSE winner_score END AS opp_score FROM fx_team_rows",
    ("fx_team_rows",),
)
def _(d):
    return d["fx_team_rows"].select(
        "src_key", "team_id", "location",
        X.own_score("result", "winner_score", "loser_score").alias("own_score"),
        X.opponent_score("result", "winner_score", "loser_score").alias("opp_score"),
    )


def _captioned(d):
    t = F.col("TeamName")
    name = (
        F.when(t % 41 == 0, "Team").when(t % 43 == 0, None).when(t % 47 == 0, "Ratings on Nov 3").when(t % 37 == 0, "TeamName")
        .otherwise(F.concat(F.lit("School"), t.cast("string")))
    )
    return d["all_ratings"].withColumn("TeamName", name)


@REG.add(
    "clean_repeated_headers",
    f"SELECT concat('School', TeamName) AS TeamName, snapshot_date, {r6('AdjEM', 'AdjEM')} FROM all_ratings WHERE TeamName % 41 <> 0 AND TeamName % 43 <> 0 AND TeamName % 47 <> 0 AND TeamName % 37 <> 0",
    ("all_ratings",),
)
def _(d):
    return rounded(cleaning.clean_repeated_headers(_captioned(d)).select("TeamName", "snapshot_date", "AdjEM"), "AdjEM")


@REG.add("strip_trailing_ordinal", "SELECT p_partkey, p_name AS name FROM part")
def _(d):
    seeded = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"))).otherwise(F.col("p_name"))
    return d["part"].select("p_partkey", X.strip_trailing_ordinal(seeded).alias("name"))


@REG.add(
    "column_shift_audit",
    "SELECT snapshot_date, count(*) AS n_rows, CAST(CASE WHEN month(snapshot_date) = 5 THEN 1 ELSE 0 END AS DOUBLE) AS margin_null_rate, CAST(CASE WHEN month(snapshot_date) = 5 THEN 1 ELSE 0 END AS DOUBLE) AS offence_low_rate, month(snapshot_date) = 5 AS is_shifted FROM all_ratings GROUP BY snapshot_date",
    ("all_ratings",),
)
def _(d):
    may = F.month("snapshot_date") == 5
    shifted = d["all_ratings"].withColumns(
        {"AdjOE": F.when(may, F.col("AdjEM")).otherwise(F.col("AdjOE")), "AdjEM": F.when(~may, F.col("AdjEM"))}
    )
    return cleaning.column_shift_audit(shifted, "snapshot_date", "AdjEM", "AdjOE")


@REG.add("rename_to_canonical", "SELECT TeamName, AdjEM, AdjOE, AdjDE, AdjTempo FROM all_ratings", ("all_ratings",))
def _(d):
    raw = d["all_ratings"].withColumnsRenamed({"TeamName": "Team", "AdjOE": "AdjO", "AdjDE": "AdjD", "AdjTempo": "AdjT"})
    return cleaning.rename_to_canonical(raw, fixed.RATING_RENAMES, ["TeamName", *fixed.RATING_COLUMNS, *fixed.RANK_COLUMNS])


@REG.add("first_available_column", "SELECT TeamName AS entity, AdjOE AS offence FROM all_ratings", ("all_ratings",))
def _(d):
    raw = d["all_ratings"].withColumnsRenamed({"TeamName": "Team", "AdjOE": "AdjO"})
    return raw.select(
        F.col(cleaning.first_available(raw, "TeamName", "Team")).alias("entity"),
        F.col(cleaning.first_available(raw, "AdjOE", "AdjO")).alias("offence"),
    )


@REG.add("season_from_date", f"SELECT game_key, {season_sql('date')} AS season_label FROM games", G)
def _(d):
    return d["games"].select("game_key", X.season_label("date").alias("season_label"))


@REG.add("season_label_to_int", "SELECT game_key, CAST(CASE WHEN month(date) >= 10 THEN year(date) + 1 ELSE year(date) END AS INTEGER) AS from_label, CAST(season AS INTEGER) AS from_number FROM games", G)
def _(d):
    return d["games"].select(
        "game_key", X.season_number(X.season_label("date")).alias("from_label"), X.season_number("season").alias("from_number")
    )


@REG.add("season_label_from_param", "SELECT game_key, concat(year(date), '-', lpad(CAST((year(date) + 1) % 100 AS VARCHAR), 2, '0')) AS season_label, CAST(year(date) + 1 AS INTEGER) AS output_year FROM games", G)
def _(d):
    return d["games"].select("game_key", X.season_label_of_year(F.year("date")).alias("season_label"), (F.year("date") + 1).alias("output_year"))


@REG.add("match_key", "SELECT game_key, concat(strftime(date, '%Y-%m-%d'), '|', least(team_a, team_b), '|', greatest(team_a, team_b)) AS match_key FROM games", G)
def _(d):
    return d["games"].select("game_key", X.match_key("date", "team_a", "team_b").alias("match_key"))


@REG.add(
    "venue_roles",
    "WITH v AS (SELECT game_key, team_a, team_b, CASE game_key % 3 WHEN 0 THEN 'Home' WHEN 1 THEN 'Away' ELSE 'Neutral' END AS l1, CASE game_key % 4 WHEN 0 THEN 'Away' WHEN 1 THEN 'Home' ELSE 'Neutral' END AS l2, concat('school', team_a) AS n1, concat('school', team_b) AS n2 FROM games) "
    "SELECT game_key, CASE WHEN l1 = 'Home' AND l2 = 'Away' THEN team_a WHEN l1 = 'Away' AND l2 = 'Home' THEN team_b WHEN l1 = 'Neutral' AND l2 = 'Neutral' THEN CASE WHEN n1 < n2 THEN team_a ELSE team_b END END AS side_a FROM v",
    G,
)
def _(d):
    k = F.col("game_key")
    l1 = F.when(k % 3 == 0, "Home").when(k % 3 == 1, "Away").otherwise("Neutral")
    l2 = F.when(k % 4 == 0, "Away").when(k % 4 == 1, "Home").otherwise("Neutral")
    name = lambda c: F.concat(F.lit("school"), F.col(c).cast("string"))
    first = pairing.venue_first(l1, l2, name("team_a"), name("team_b"))
    return d["games"].select("game_key", F.when(first == 1, F.col("team_a")).when(first == 2, F.col("team_b")).alias("side_a"))


LABELS = (
    "SELECT game_key, points_a - points_b AS final_margin_a, points_a + points_b AS game_total, "
    "CASE WHEN points_a > points_b THEN 1.0 WHEN points_a < points_b THEN 0.0 ELSE 0.5 END AS win_a, "
    "CASE WHEN points_a + points_b > total_line THEN 1.0 WHEN points_a + points_b < total_line THEN 0.0 ELSE 0.5 END AS over, "
    "CASE WHEN spread_a IS NULL THEN NULL WHEN points_a + spread_a > points_b THEN 1.0 WHEN points_a + spread_a < points_b THEN 0.0 ELSE 0.5 END AS cover_a FROM fx_games"
)


def _labels(d, *names):
    return pairing.labelled(d["fx_games"]).select("game_key", *names)


for _name, _cols in {
    "derive_margin_total": ("final_margin_a", "game_total"), "label_cover": ("cover_a",), "label_win": ("win_a",), "label_over": ("over",),
}.items():
    _sql = f"SELECT game_key, {', '.join(c if c.endswith(('a_', 'total')) or c == 'final_margin_a' else f'CAST({c} AS DOUBLE) AS {c}' for c in _cols)} FROM ({LABELS}) t"
    REG.add(_name, _sql, ("fx_games",))(lambda d, _cols=_cols: _labels(d, *_cols))

MODEL_COLS = ["kp_adj_em_a", "kp_adj_em_b", "kp_tempo_a", "pred_dnn"]


@REG.add(
    "filter_modelable",
    f"WITH {rated_sql()} SELECT game_key, {r6('kp_adj_em_a', 'kp_adj_em_a')}, {r6('pred_dnn', 'pred_dnn')} FROM rated WHERE spread_a IS NOT NULL AND kp_adj_em_a IS NOT NULL AND kp_adj_em_b IS NOT NULL AND kp_tempo_a IS NOT NULL AND pred_dnn IS NOT NULL AND cover_a IS NOT NULL",
    GR,
)
def _(d):
    rows, available = cleaning.filter_modelable(asof.matched_flag(rated(d)), [*MODEL_COLS, "kp_absent"])
    return rounded(rows.select("game_key", *[c for c in available if c in ("kp_adj_em_a", "pred_dnn")]), "kp_adj_em_a", "pred_dnn")


@REG.add("split_by_season", "SELECT game_key, CASE WHEN season <= 1997 THEN 'train' WHEN season IN (1998, 1999) THEN 'val' ELSE 'test' END AS split FROM games WHERE season <= 2000", G)
def _(d):
    return cleaning.with_split(d["games"], [1995, 1996, 1997], [1998, 1999], [2000]).select("game_key", "split")


@REG.add("venue_flags", "SELECT game_key, CASE WHEN is_neutral THEN 0 ELSE 1 END AS is_home_a, CASE WHEN is_neutral THEN 1 ELSE 0 END AS is_neutral FROM games", G)
def _(d):
    home, neutral = X.venue_flags("is_neutral")
    return d["games"].select("game_key", home.alias("is_home_a"), neutral.alias("is_neutral"))


DIFFS = {
    "kp_adj_em_diff": "kp_adj_em_a - kp_adj_em_b", "kp_tempo_avg": "(kp_tempo_a + kp_tempo_b) / 2", "kp_tempo_diff": "kp_tempo_a - kp_tempo_b",
    "kp_o_vs_d_a": "kp_adj_o_a - kp_adj_d_b", "kp_o_vs_d_b": "kp_adj_o_b - kp_adj_d_a",
}
RAW_MARGIN = "(kp_adj_em_a - kp_adj_em_b) * ((kp_tempo_a + kp_tempo_b) / 2) / 100"


@REG.add("rating_differentials", f"WITH {rated_sql()} SELECT game_key, {', '.join(r6(v, k) for k, v in DIFFS.items())} FROM rated", GR)
def _(d):
    return rounded(asof.rating_differentials(rated(d)).select("game_key", *DIFFS), *DIFFS)


def _margins(d):
    return asof.expected_margin_raw(asof.rating_differentials(rated(d)))


@REG.add("expected_margin_raw", f"WITH {rated_sql()} SELECT game_key, {r6(RAW_MARGIN, 'kp_pred_margin_raw')} FROM rated", GR)
def _(d):
    return rounded(_margins(d).select("game_key", "kp_pred_margin_raw"), "kp_pred_margin_raw")


@REG.add("expected_margin_venue", f"WITH {rated_sql()} SELECT game_key, {r6(RAW_MARGIN + ' + CASE WHEN is_neutral THEN 0 ELSE 3.5 END', 'kp_pred_margin')} FROM rated", GR)
def _(d):
    home, neutral = X.venue_flags("is_neutral")
    rows = _margins(d).withColumns({"is_home_a": home, "is_neutral": neutral})
    out = rows.select("game_key", X.venue_adjusted("kp_pred_margin_raw", "is_home_a", "is_neutral").alias("kp_pred_margin"))
    return rounded(out, "kp_pred_margin")


@REG.add(
    "simple_expected_margin",
    f"WITH {rated_sql()} SELECT game_key, {r6('(kp_adj_em_a - kp_adj_em_b) * coalesce((kp_tempo_a + kp_tempo_b) / 2, 67.5) / 100 + CASE WHEN is_neutral THEN 0 ELSE coalesce(v.hca, 3.5) END', 'pred_margin')} FROM rated LEFT JOIN fx_advantage v ON v.team = rated.team_a",
    (*GR, "fx_advantage"),
)
def _(d):
    rows = asof.rating_differentials(rated(d)).withColumn("is_home_a", X.venue_flags("is_neutral")[0])
    adv = d["fx_advantage"].select(F.col("team").alias("team_a"), F.col("hca").alias("team_hca"))
    rows = rows.join(adv, "team_a", "left")
    return rounded(rows.select("game_key", dims.simple_expected_margin(rows).alias("pred_margin")), "pred_margin")


@REG.add("rank_normalise", f"SELECT game_key, {r6('points_a / CAST(365 AS DOUBLE)', 'kp_rank_em_a')}, {r6('points_b / CAST(365 AS DOUBLE)', 'kp_rank_em_b')} FROM games", G)
def _(d):
    ranked = d["games"].select("game_key", F.col("points_a").alias("RankAdjEM_a"), F.col("points_b").alias("RankAdjEM_b"))
    return rounded(asof.rank_normalise(ranked), "kp_rank_em_a", "kp_rank_em_b")


@REG.add("matched_flag", f"WITH {rated_sql()} SELECT game_key, (kp_adj_em_a IS NOT NULL AND kp_adj_em_b IS NOT NULL) AS kp_matched FROM rated", GR)
def _(d):
    return asof.matched_flag(rated(d)).select("game_key", "kp_matched")


HOST = "CASE WHEN g.is_neutral THEN 'N' WHEN g.game_key % 4 = 0 THEN 'B' ELSE 'A' END"


def _advantage(d):
    """Matches where side B hosts a quarter of the time, with both sides' advantage."""
    away = (F.col("game_key") % 4 == 0) & ~F.col("is_neutral")
    rows = d["games"].withColumns(
        {"is_home_a": (~F.col("is_neutral") & ~away).cast("int"), "is_neutral": F.col("is_neutral").cast("int")}
    )
    return dims.dim_join_advantage(rows, d["fx_advantage"], "team")


ADV = "FROM games g LEFT JOIN fx_advantage a ON a.team = g.team_a LEFT JOIN fx_advantage b ON b.team = g.team_b"


@REG.add("venue_advantage_select", f"SELECT game_key, {r6(f'CASE {HOST} WHEN $A$A$A$ THEN coalesce(a.hca, 3.5) WHEN $A$B$A$ THEN -coalesce(b.hca, 3.5) ELSE 0 END', 'team_hca')} {ADV}".replace("$A$", "'"), (*G, "fx_advantage"))
def _(d):
    return rounded(_advantage(d).select("game_key", "team_hca"), "team_hca")


@REG.add("venue_elevation_select", f"SELECT game_key, {r6(f'CASE {HOST} WHEN $A$A$A$ THEN coalesce(a.elevation, 0) WHEN $A$B$A$ THEN coalesce(b.elevation, 0) ELSE 0 END', 'team_elevation')} {ADV}".replace("$A$", "'"), (*G, "fx_advantage"))
def _(d):
    return rounded(_advantage(d).select("game_key", "team_elevation"), "team_elevation")


def factors(d):
    """Season dimension under the four-factor and height names."""
    x = F.col
    return d["fx_dims"].select(
        "season", "team", x("off_x").alias("off_efg"), x("def_x").alias("def_efg"), (x("off_x") / 2).alias("off_to_pct"),
        (x("def_x") / 4).alias("def_to_pct"), x("avg_height"), (x("avg_height") / 8).alias("experience"),
    )


MATCHUPS = {
    "ff_efg_matchup_a": "a.off_x - b.def_x", "ff_efg_matchup_b": "b.off_x - a.def_x", "ff_to_matchup_a": "b.def_x / 4 - a.off_x / 2",
    "ff_to_matchup_b": "a.def_x / 4 - b.off_x / 2", "ht_height_diff": "a.avg_height - b.avg_height", "ht_exp_diff": "a.avg_height / 8 - b.avg_height / 8",
}
DIMS = "FROM games g LEFT JOIN fx_dims a ON a.team = g.team_a AND a.season = g.season LEFT JOIN fx_dims b ON b.team = g.team_b AND b.season = g.season"


def with_factors(d):
    rows = dims.dim_join_four_factors(d["games"], factors(d), entity="team")
    return dims.dim_join_height_exp(rows, factors(d), entity="team")


@REG.add("matchup_features", f"SELECT game_key, {', '.join(r6(v, k) for k, v in MATCHUPS.items())} {DIMS}", (*G, "fx_dims"))
def _(d):
    return rounded(dims.matchup_features(with_factors(d)).select("game_key", *MATCHUPS), *MATCHUPS)


@REG.add(
    "matchup_features_scoring",
    f"SELECT game_key, {', '.join(r6(f'coalesce({v}, 0)', k) for k, v in MATCHUPS.items())}, CAST(0 AS DOUBLE) AS ff_reb_matchup_a {DIMS}",
    (*G, "fx_dims"),
)
def _(d):
    out = dims.matchup_features(with_factors(d), fill=0.0)
    return rounded(out.select("game_key", *MATCHUPS, "ff_reb_matchup_a"), *MATCHUPS)


@REG.add("scoring_defaults", f"SELECT game_key, {r6('coalesce(pred_dnn, 0)', 'pred_dnn')}, CAST(3 AS DOUBLE) AS rest_days_a, CAST(0.5 AS DOUBLE) AS rolling_ats_b, CAST(0 AS DOUBLE) AS other FROM games", G)
def _(d):
    out = cleaning.scoring_defaults(d["games"], ["pred_dnn", "rest_days_a", "rolling_ats_b", "other"])
    return rounded(out.select("game_key", "pred_dnn", "rest_days_a", "rolling_ats_b", "other"), "pred_dnn")


@REG.add("select_columns_ordered", "SELECT game_key, season, date, team_a, team_b, is_neutral, spread_a, final_margin_a, cover_a, kp_matched, points_a FROM (SELECT *, spread_a IS NOT NULL AS kp_matched FROM games) t", G)
def _(d):
    mixed = d["games"].select(
        "points_a", (F.col("spread_a").isNotNull()).alias("kp_matched"), "cover_a", "spread_a", "team_b", "team_a", "date", "season",
        "is_neutral", "final_margin_a", "game_key",
    )
    return cleaning.select_ordered(mixed)


@REG.add(
    "features_without_ratings",
    "SELECT game_key, season, date, team_a, team_b, CASE WHEN is_neutral THEN 1 ELSE 0 END AS is_neutral, spread_a, final_margin_a, cover_a, CASE WHEN is_neutral THEN 0 ELSE 1 END AS is_home_a, false AS kp_matched, false AS is_leaky FROM games",
    G,
)
def _(d):
    return plan.features_without_ratings(d["games"])


@REG.add(
    "new_column_coverage",
    "WITH j AS (SELECT a.off_x AS ff_off_efg_a, b.avg_height AS ht_avg_height_b " + DIMS + "), "
    "c AS (SELECT count(*) AS n, count(ff_off_efg_a) AS x, count(ht_avg_height_b) AS y FROM j) "
    f"SELECT 'ff_off_efg_a' AS column_name, x AS non_null, n AS n_rows, {r6('CAST(100 AS DOUBLE) * x / n', 'pct')} FROM c UNION ALL SELECT 'ht_avg_height_b', y, n, {r6('CAST(100 AS DOUBLE) * y / n', 'pct')} FROM c",
    (*G, "fx_dims"),
)
def _(d):
    return rounded(cleaning.column_coverage(with_factors(d), ["ff_off_efg_a", "ht_avg_height_b"]), "pct")


