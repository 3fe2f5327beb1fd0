"""Join and aggregation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchline.functions import exprs as X
from matchline.functions import fixed
from matchline.operators import asof, cleaning, dims, history, joins, names, pairing, profile

from .cleaning import ADV, DIMS, GR, SHORT, VALUES, factors, rated, rated_sql, with_factors
from .fixtures import REG, r6, rounded, season_sql

G = ("games",)
SIDES = [f"{p}_{s}" for p in SHORT.values() for s in "ab"]

# Oracle of the pairing: keys, row counts, both rows side by side, one verdict per row.
PAIRED = f"""
ids AS (SELECT DISTINCT team_id FROM fx_team_rows),
rows0 AS (SELECT t.*, i.team_id AS opp_id, row_number() OVER (ORDER BY src_key, t.team_id, location, opponent, winner_score) AS rid,
          CASE WHEN result = 'W' THEN winner_score ELSE loser_score END AS own, CASE WHEN result = 'W' THEN loser_score ELSE winner_score END AS opp
          FROM fx_team_rows t LEFT JOIN ids i ON concat('School', i.team_id) = t.opponent),
keyed AS (SELECT *, CASE WHEN opp_id IS NOT NULL THEN concat(strftime(game_date, '%Y-%m-%d'), '|', least(team_id, opp_id), '|', greatest(team_id, opp_id)) END AS k FROM rows0),
counted AS (SELECT *, count(*) OVER (PARTITION BY k) AS n, row_number() OVER (PARTITION BY k ORDER BY team_id, rid) AS rn FROM keyed),
two AS (SELECT x.k, x.game_date, x.team_id AS t1, y.team_id AS t2, x.opp_id AS o1, y.opp_id AS o2, x.location AS l1, y.location AS l2,
        lower(x.team_name) < lower(y.team_name) AS first_small, x.rid AS r1, y.rid AS r2
        FROM counted x JOIN counted y ON x.k = y.k AND x.n = 2 AND x.rn = 1 AND y.rn = 2),
verdict AS (SELECT *, CASE WHEN o1 <> t2 OR o2 <> t1 THEN 'opponent team_id mismatch'
        WHEN NOT ((l1 = 'Home' AND l2 = 'Away') OR (l1 = 'Away' AND l2 = 'Home') OR (l1 = 'Neutral' AND l2 = 'Neutral'))
        THEN concat('unexpected location combo: ', l1, '/', l2) END AS reason,
        CASE WHEN l1 = 'Home' THEN r1 WHEN l1 = 'Away' THEN r2 WHEN first_small THEN r1 ELSE r2 END AS ra FROM two),
paired AS (SELECT v.k AS game_key, {season_sql('v.game_date')} AS season, v.game_date AS date, a.team_name AS team_a, b.team_name AS team_b,
        a.team_id AS team_a_id, b.team_id AS team_b_id, a.location = 'Neutral' AS is_neutral, a.own AS points_a, b.own AS points_b,
        a.spread AS spread_a, a.total AS total_line, a.ats AS ats_a_raw, b.ats AS ats_b_raw,
        a.own - b.own AS final_margin_a, a.own + b.own AS game_total,
        CASE WHEN a.spread IS NULL THEN NULL WHEN a.own - b.own + a.spread > 0 THEN 1.0 WHEN a.own - b.own + a.spread < 0 THEN 0.0 ELSE 0.5 END AS cover_a,
        CASE WHEN a.own > b.own THEN 1.0 WHEN a.own < b.own THEN 0.0 ELSE 0.5 END AS win_a,
        CASE WHEN a.own + b.own > a.total THEN 1.0 WHEN a.own + b.own < a.total THEN 0.0 ELSE 0.5 END AS "over",
        'REG' AS game_type, CASE WHEN a.location <> 'Neutral' THEN a.team_name END AS home_team, CASE WHEN a.location <> 'Neutral' THEN b.team_name END AS away_team, a.ou AS ou_raw
        FROM verdict v JOIN rows0 a ON a.rid = v.ra JOIN rows0 b ON b.rid = CASE WHEN v.ra = v.r1 THEN v.r2 ELSE v.r1 END WHERE v.reason IS NULL),
rejects AS (SELECT c.*, CASE WHEN c.opp_id IS NULL THEN 'could not map opponent to team_id' WHEN n <> 2 THEN concat('expected 2 rows, got ', n) ELSE v.reason END AS reason
        FROM counted c LEFT JOIN verdict v ON v.k = c.k WHERE c.opp_id IS NULL OR n <> 2 OR v.reason IS NOT NULL)"""
TR = ("fx_team_rows",)
GAME_COLS = [
    "game_key", "season", "date", "team_a", "team_b", "team_a_id", "team_b_id", "is_neutral", "points_a", "points_b", "spread_a",
    "total_line", "ats_a_raw", "ats_b_raw", "final_margin_a", "game_total", "cover_a", "win_a", "over", "game_type", "home_team", "away_team", "ou_raw",
]
DOUBLES = ["points_a", "points_b", "spread_a", "total_line", "final_margin_a", "game_total", "cover_a", "win_a", "over"]


def landed_pairing(d):
    rows = cleaning.clean_team_rows(d.landed_rows)
    return pairing.pair_landed(rows, names.resolve_opponent_ids(rows))


def paired(d):
    done = landed_pairing(d)
    return done.games, done.rejects


@REG.add("pair_two_sided_rows", f"WITH {PAIRED} SELECT " + ", ".join(r6(f'"{c}"', f'"{c}"') if c in DOUBLES else c for c in GAME_COLS) + " FROM paired", TR)
def _(d):
    return rounded(paired(d)[0].select(*GAME_COLS), *DOUBLES)


@REG.add("pair_quarantine", f"WITH {PAIRED} SELECT src_key, team_id, location, opponent, reason AS quarantine_reason FROM rejects", TR)
def _(d):
    return paired(d)[1].select("src_key", "team_id", "location", "opponent", "quarantine_reason")


@REG.add("asof_snapshot_join", f"WITH {rated_sql()} SELECT game_key, kp_snapshot_date, {', '.join(r6(c, c) for c in SIDES)} FROM rated", GR)
def _(d):
    return rounded(rated(d).select("game_key", "kp_snapshot_date", *SIDES), *SIDES)


@REG.add(
    "asof_tier_flag",
    f"WITH {rated_sql()} SELECT game_key, CASE WHEN kp_snapshot_date IS NULL THEN NULL WHEN date_diff('day', kp_snapshot_date, date) <= 14 THEN 'daily' ELSE 'seasonal' END AS asof_tier FROM rated",
    GR,
)
def _(d):
    return rated(d).select("game_key", "asof_tier")


@REG.add(
    "asof_unbounded",
    f"WITH {rated_sql('')}, m AS (SELECT *, (kp_adj_em_a IS NOT NULL AND kp_adj_em_b IS NOT NULL) AS ok FROM rated) SELECT game_key, ok AS kp_matched, {', '.join(r6(f'CASE WHEN ok THEN {c} END', c) for c in SIDES)} FROM m",
    GR,
)
def _(d):
    out = asof.asof_snapshot_join(d["games"], d["ratings"], VALUES, tolerance=None, require_both=True)
    return rounded(out.select("game_key", "kp_matched", *SIDES), *SIDES)


@REG.add(
    "lookup_unordered_snapshot",
    "WITH f AS (SELECT TeamName, arg_min(AdjEM, snapshot_date) AS em FROM ratings GROUP BY 1) "
    f"SELECT game_key, {r6('a.em', 'kp_adj_em_a')}, {r6('b.em', 'kp_adj_em_b')}, true AS is_leaky FROM games g LEFT JOIN f a ON a.TeamName = g.team_a LEFT JOIN f b ON b.TeamName = g.team_b",
    GR,
)
def _(d):
    out = asof.lookup_unordered_snapshot(d["games"], d["ratings"], {"AdjEM": "kp_adj_em"}, ["snapshot_date"])
    return rounded(out.select("game_key", "kp_adj_em_a", "kp_adj_em_b", "is_leaky"), "kp_adj_em_a", "kp_adj_em_b")


@REG.add(
    "asof_per_entity",
    f"SELECT game_key, r.snapshot_date, {r6('r.AdjEM', 'AdjEM')} FROM games g ASOF LEFT JOIN ratings r ON r.TeamName = g.team_a AND r.snapshot_date < g.date",
    GR,
)
def _(d):
    ratings = d["ratings"].withColumnRenamed("TeamName", "team_a")
    out = asof.asof_per_entity(d["games"], ratings, ["AdjEM"], "team_a", "date", "snapshot_date")
    return rounded(out.select("game_key", "snapshot_date", "AdjEM"), "AdjEM")


@REG.add(
    "feature_join_back",
    "WITH s AS (SELECT team_a AS e, date, spread_a AS v, game_key FROM games UNION ALL SELECT team_b, date, -spread_a, game_key FROM games), "
    "f AS (SELECT e, date, arg_min(v, game_key) AS v FROM s WHERE v IS NOT NULL GROUP BY 1, 2) "
    f"SELECT g.game_key, {r6('a.v', 'line_a')}, {r6('b.v', 'line_b')} FROM games g LEFT JOIN f a ON a.e = g.team_a AND a.date = g.date LEFT JOIN f b ON b.e = g.team_b AND b.date = g.date",
    G,
)
def _(d):
    g = d["games"]
    a = g.select(F.col("team_a").alias("entity"), "date", F.col("spread_a").alias("line"), "game_key")
    b = g.select(F.col("team_b").alias("entity"), "date", (-F.col("spread_a")).alias("line"), "game_key")
    days = history.first_per_group(a.unionByName(b), ["entity", "date"], "line", "game_key")
    out = history.feature_join_back(g, days, {"line": "line"})
    return rounded(out.select("game_key", "line_a", "line_b"), "line_a", "line_b")


FF = ["ff_off_efg_a", "ff_off_efg_b", "ff_def_efg_a", "ff_def_efg_b"]


@REG.add("dim_join_season_both_sides", f"SELECT game_key, {r6('a.off_x', FF[0])}, {r6('b.off_x', FF[1])}, {r6('a.def_x', FF[2])}, {r6('b.def_x', FF[3])} {DIMS}", (*G, "fx_dims"))
def _(d):
    return rounded(dims.dim_join_four_factors(d["games"], factors(d), entity="team").select("game_key", *FF), *FF)


@REG.add(
    "dim_join_entity_dedup",
    f"SELECT game_key, {r6('CASE WHEN is_neutral THEN 0 ELSE coalesce(a.hca, 3.5) END', 'team_hca')} {ADV}",
    (*G, "fx_advantage"),
)
def _(d):
    adv = d["fx_advantage"]
    doubled = adv.unionByName(adv.filter("team % 9 = 0").withColumn("hca", F.col("hca") + 1))
    home, neutral = X.venue_flags("is_neutral")
    rows = d["games"].withColumns({"is_home_a": home, "is_neutral": neutral})
    return rounded(dims.dim_join_advantage(rows, doubled, "team").select("game_key", "team_hca"), "team_hca")


HT = ["ht_avg_height_a", "ht_avg_height_b", "ht_experience_a", "ht_experience_b"]


@REG.add("dim_join_height_exp", f"SELECT game_key, {r6('a.avg_height', HT[0])}, {r6('b.avg_height', HT[1])}, {r6('a.avg_height / 8', HT[2])}, {r6('b.avg_height / 8', HT[3])} {DIMS}", (*G, "fx_dims"))
def _(d):
    return rounded(with_factors(d).select("game_key", *HT), *HT)


@REG.add(
    "full_outer_merge",
    "WITH l AS (SELECT season, team, off_x FROM fx_dims WHERE team % 3 <> 0), r AS (SELECT season, team, def_x FROM fx_dims WHERE team % 5 <> 0) "
    f"SELECT season, team, {r6('off_x', 'off_x')}, {r6('def_x', 'def_x')} FROM l FULL JOIN r USING (season, team)",
    ("fx_dims",),
)
def _(d):
    x = d["fx_dims"]
    out = joins.full_outer_merge(
        x.filter("team % 3 <> 0").select("season", "team", "off_x"), x.filter("team % 5 <> 0").select("season", "team", "def_x"), ["season", "team"]
    )
    return rounded(out, "off_x", "def_x")


def team_map(d):
    """Opponent text to team id, taken from the rows themselves."""
    ids = d["fx_team_rows"].select("team_id").distinct()
    return ids.select(F.concat(F.lit("School"), F.col("team_id").cast("string")).alias("raw_name"), F.col("team_id").alias("canonical"))


MAP = "m AS (SELECT DISTINCT concat('School', team_id) AS raw_name, team_id AS canonical FROM fx_team_rows)"


@REG.add("map_lookup_join", f"WITH {MAP} SELECT src_key, team_id, location, opponent, canonical AS opponent_team_id FROM fx_team_rows t LEFT JOIN m ON m.raw_name = t.opponent", TR)
def _(d):
    rows = d["fx_team_rows"].select("src_key", "team_id", "location", "opponent")
    return joins.map_lookup(rows, "opponent", team_map(d), "raw_name", "canonical", "opponent_team_id")


@REG.add("unmapped_anti_join", f"WITH {MAP} SELECT DISTINCT opponent, '{fixed.UNMAPPED_NOTE}' AS notes FROM fx_team_rows WHERE opponent NOT IN (SELECT raw_name FROM m)", TR)
def _(d):
    return joins.unmapped(d["fx_team_rows"], team_map(d), "opponent", "raw_name", "canonical").withColumn("notes", F.lit(fixed.UNMAPPED_NOTE))


@REG.add("matched_semi_join", f"WITH {MAP} SELECT src_key, team_id, location, opponent FROM fx_team_rows WHERE opponent IN (SELECT raw_name FROM m)", TR)
def _(d):
    rows = d["fx_team_rows"].select("src_key", "team_id", "location", "opponent")
    return joins.matched(rows, team_map(d), "opponent", "raw_name", "canonical")


@REG.add(
    "prefix_theta_join",
    "WITH r AS (SELECT DISTINCT concat(upper(p_brand), ' ', p_type) AS raw_name FROM part), c AS (SELECT DISTINCT p_brand AS canonical_name FROM part) "
    "SELECT raw_name, min(canonical_name) AS canonical_name FROM r JOIN c ON starts_with(lower(canonical_name), lower(split_part(raw_name, ' ', 1))) GROUP BY raw_name HAVING count(*) = 1",
)
def _(d):
    raw = d["part"].select(F.concat(F.upper("p_brand"), F.lit(" "), F.col("p_type")).alias("raw_name"))
    return names.prefix_theta_join(raw, d["part"].select(F.col("p_brand").alias("canonical_name")))


SCHOOLS = (
    "teams AS (SELECT team_id, lower(min(team_name)) AS full_name FROM fx_opponents GROUP BY team_id), "
    "schools AS (SELECT team_id, full_name, array_to_string(string_split(full_name, ' ')[:-2], ' ') AS school FROM teams), "
    "opps AS (SELECT DISTINCT opponent, lower(trim(opponent)) AS o FROM fx_opponents), "
    "scored AS (SELECT opponent, team_id, CASE WHEN school = o THEN 100 WHEN starts_with(school, concat(o, ' ')) THEN 90 ELSE 50 END AS score FROM opps JOIN schools ON contains(school, o)), "
    "best AS (SELECT opponent, max(score) AS score FROM scored GROUP BY opponent), "
    "won AS (SELECT s.opponent, min(s.team_id) AS team_id, s.score FROM scored s JOIN best b ON b.opponent = s.opponent AND b.score = s.score GROUP BY s.opponent, s.score HAVING s.score = 100 OR count(*) = 1)"
)


@REG.add("containment_theta_join", f"WITH {SCHOOLS} SELECT opponent, team_id, score FROM won", ("fx_opponents",))
def _(d):
    rows = d["fx_opponents"]
    return names.containment_theta_join(rows.select("opponent"), names.school_table(rows))


@REG.add(
    "resolve_opponent_ids",
    f"WITH {SCHOOLS}, full_key AS (SELECT full_name AS o, max(team_id) AS team_id FROM schools GROUP BY 1), school_key AS (SELECT school AS o, min(team_id) AS team_id FROM schools GROUP BY 1) "
    "SELECT opps.opponent, coalesce(f.team_id, s.team_id, w.team_id) AS opponent_team_id FROM opps LEFT JOIN full_key f ON f.o = opps.o LEFT JOIN school_key s ON s.o = opps.o LEFT JOIN won w ON w.opponent = opps.opponent "
    "WHERE coalesce(f.team_id, s.team_id, w.team_id) IS NOT NULL",
    ("fx_opponents",),
)
def _(d):
    return names.resolve_opponent_ids(d["fx_opponents"])


OVERLAP = (
    "rw AS (SELECT raw_name, unnest(list_distinct(string_split(lower(raw_name), ' '))) AS w FROM fx_names), "
    "cw AS (SELECT canonical_name, unnest(list_distinct(string_split(lower(canonical_name), ' '))) AS w FROM fx_canonical), "
    "ov AS (SELECT raw_name, canonical_name, count(*) AS n FROM rw JOIN cw USING (w) GROUP BY 1, 2), "
    "ob AS (SELECT raw_name, canonical_name, n FROM ov QUALIFY row_number() OVER (PARTITION BY raw_name ORDER BY n DESC, canonical_name) = 1)"
)
NM = ("fx_names", "fx_canonical")


@REG.add("token_overlap_join", f"WITH {OVERLAP} SELECT raw_name, canonical_name, CAST(n AS INTEGER) AS overlap FROM ob", NM)
def _(d):
    return names.token_overlap_join(d["fx_names"], d["fx_canonical"])


@REG.add(
    "schema_diff",
    "WITH a AS (SELECT column_name FROM (DESCRIBE fx_games_t)), b AS (SELECT column_name FROM (DESCRIBE fx_scored_t)) SELECT column_name, 'missing' AS status FROM a WHERE column_name NOT IN (SELECT column_name FROM b) UNION ALL SELECT column_name, 'extra' FROM b WHERE column_name NOT IN (SELECT column_name FROM a)"
    .replace("fx_games_t", "orders").replace("fx_scored_t", "lineitem"),
)
def _(d):
    return joins.schema_diff(d.spark, d["orders"], d["lineitem"])


# --- aggregations ----------------------------------------------------------


def _filed(d):
    rows = cleaning.clean_team_rows(d.team_rows)
    return rows.withColumn("file", F.concat(F.lit("rows_"), F.year("date_parsed").cast("string"), F.lit(".csv")))


@REG.add(
    "file_profile",
    "SELECT concat('rows_', year(game_date), '.csv') AS file, count(*) AS n_rows, min(game_date) AS min_date, max(game_date) AS max_date, count(DISTINCT team_name) AS unique_teams, count(DISTINCT opponent) AS unique_opponents, "
    "count(*) FILTER (WHERE spread IS NULL) AS spread_missing, count(*) FILTER (WHERE total IS NULL) AS total_missing, CAST(0 AS BIGINT) AS result_other FROM fx_team_rows GROUP BY 1",
    TR,
)
def _(d):
    return profile.file_profile(_filed(d))


@REG.add(
    "value_counts",
    " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c} AS value, count(*) AS n_rows FROM fx_team_rows WHERE {c} IS NOT NULL GROUP BY {c}" for c in ("location", "result", "ats", "ou")),
    TR,
)
def _(d):
    return profile.value_counts(d.team_rows, ["location", "result", "ats", "ou"])


@REG.add(
    "line_convention_check",
    "WITH c AS (SELECT (CASE WHEN result = 'W' THEN winner_score - loser_score ELSE loser_score - winner_score END + spread > 0) = (ats = 'W') AS same FROM fx_team_rows WHERE spread IS NOT NULL AND ats IN ('W', 'L')) "
    f"SELECT {r6('avg(CASE WHEN same THEN 1.0 ELSE 0.0 END)', 'match_rate')}, count(*) AS sample_size, CASE WHEN avg(CASE WHEN same THEN 1.0 ELSE 0.0 END) > 0.95 THEN 'spread is from team perspective (team + spread > 0 means cover)' ELSE 'needs manual review' END AS interpretation FROM c",
    TR,
)
def _(d):
    return rounded(profile.line_convention_check(d.team_rows), "match_rate")


@REG.add(
    "label_validation",
    f"WITH {PAIRED}, v AS (SELECT (cover_a = 1) = (ats_a_raw = 'W') AS same FROM paired WHERE spread_a IS NOT NULL AND ats_a_raw IN ('W', 'L')) SELECT count(*) AS sample_size, {r6('avg(CASE WHEN same THEN 1.0 ELSE 0.0 END)', 'match_rate')}, count(*) FILTER (WHERE NOT same) AS mismatches FROM v",
    TR,
)
def _(d):
    return rounded(profile.label_validation(paired(d)[0]), "match_rate")


@REG.add(
    "season_audit",
    f"WITH {PAIRED}, q AS (SELECT {season_sql('game_date')} AS season, count(*) AS n FROM rejects GROUP BY 1), "
    "a AS (SELECT season, count(*) AS total_games, count(spread_a) AS games_with_spread, count(*) - count(spread_a) AS games_without_spread, count(*) FILTER (WHERE cover_a = 1) AS cover_a_wins, "
    "count(*) FILTER (WHERE cover_a = 0) AS cover_a_losses, count(*) FILTER (WHERE cover_a = 0.5) AS pushes, avg(cover_a) FILTER (WHERE cover_a IN (0, 1)) AS cr FROM paired GROUP BY season) "
    "SELECT coalesce(a.season, q.season) AS season, " + "".join(f"coalesce({c}, 0) AS {c}, " for c in ("total_games", "games_with_spread", "games_without_spread", "cover_a_wins", "cover_a_losses", "pushes"))
    + f"{r6('cr', 'cover_rate')}, coalesce(q.n, 0) AS quarantine_rows FROM a FULL JOIN q ON q.season IS NOT DISTINCT FROM a.season",
    TR,
)
def _(d):
    games, rejects = paired(d)
    return rounded(profile.season_audit(games, rejects), "cover_rate")


@REG.add(
    "pairing_rate",
    f"WITH {PAIRED}, c AS (SELECT (SELECT count(*) FROM fx_team_rows) AS rows_in, (SELECT count(*) FROM paired) AS games_out, (SELECT count(*) FROM rejects) AS rows_quarantined) SELECT rows_in, games_out, rows_quarantined, {r6('CAST(2 AS DOUBLE) * games_out / rows_in', 'pairing_rate')} FROM c",
    TR,
)
def _(d):
    return rounded(landed_pairing(d).rate(), "pairing_rate")


@REG.add("first_per_group", f"SELECT team_a, date, {r6('arg_min(spread_a, game_key) FILTER (WHERE spread_a IS NOT NULL)', 'spread_a')} FROM games GROUP BY team_a, date", G)
def _(d):
    return rounded(history.first_per_group(d["games"], ["team_a", "date"], "spread_a", "game_key"), "spread_a")


@REG.add("distinct_entities", "SELECT team_a AS entity FROM games UNION SELECT team_b FROM games", G)
def _(d):
    return profile.distinct_entities(d["games"])


@REG.add(
    "match_coverage",
    f"WITH {rated_sql()}, c AS (SELECT count(*) AS n, count(*) FILTER (WHERE kp_adj_em_a IS NOT NULL AND kp_adj_em_b IS NOT NULL) AS m, count(spread_a) AS s FROM rated) SELECT n AS total_games, m AS matched, s AS with_line, {r6('CAST(100 AS DOUBLE) * m / n', 'matched_pct')}, {r6('CAST(100 AS DOUBLE) * s / n', 'with_line_pct')} FROM c",
    GR,
)
def _(d):
    return rounded(profile.match_coverage(asof.matched_flag(rated(d))), "matched_pct", "with_line_pct")


@REG.add("latest_row_per_key", f"SELECT team_a, game_key, date, {r6('spread_a', 'spread_a')} FROM games QUALIFY row_number() OVER (PARTITION BY team_a ORDER BY date DESC, game_key) = 1", G)
def _(d):
    rows = d["games"].select("team_a", "game_key", "date", "spread_a")
    return rounded(joins.latest_row_per_key(rows, ["team_a"], [F.desc("date"), "game_key"]), "spread_a")


# --- names -----------------------------------------------------------------

STAGED = (
    "r AS (SELECT raw_name, lower(array_to_string(string_split(raw_name, ' ')[:-2], ' ')) AS school, lower(split_part(raw_name, ' ', 1)) AS fw FROM fx_names), "
    "fwm AS (SELECT r.raw_name, min(c.canonical_name) AS m FROM r JOIN fx_canonical c ON starts_with(lower(c.canonical_name), r.fw) GROUP BY 1 HAVING count(*) = 1), "
    "res AS (SELECT r.raw_name, CASE WHEN e.canonical_name IS NOT NULL THEN e.canonical_name WHEN s.canonical_name IS NOT NULL THEN s.canonical_name ELSE f.m END AS canonical_name, "
    "CASE WHEN e.canonical_name IS NOT NULL THEN 'exact' WHEN s.canonical_name IS NOT NULL THEN 'school' WHEN f.m IS NOT NULL THEN 'first_word' END AS stage "
    "FROM r LEFT JOIN fx_canonical e ON e.canonical_name = r.raw_name LEFT JOIN fx_canonical s ON lower(s.canonical_name) = r.school LEFT JOIN fwm f ON f.raw_name = r.raw_name)"
)


@REG.add("resolve_names_staged", f"WITH {STAGED} SELECT raw_name, canonical_name, stage FROM res", NM)
def _(d):
    return names.resolve_names_staged(d["fx_names"], d["fx_canonical"])


@REG.add(
    "name_map_report",
    f"WITH {STAGED} SELECT raw_name, canonical_name, CASE WHEN canonical_name IS NULL THEN '{fixed.UNMAPPED_NOTE}' ELSE '{fixed.AUTO_NOTE}' END AS notes FROM res",
    NM,
)
def _(d):
    return names.name_map_report(names.resolve_names_staged(d["fx_names"], d["fx_canonical"]))


@REG.add("name_map_coverage", f"WITH {STAGED} SELECT count(*) AS total_names, count(canonical_name) AS mapped_names, {r6('CAST(100 AS DOUBLE) * count(canonical_name) / count(*)', 'mapped_pct')} FROM res", NM)
def _(d):
    report = names.name_map_report(names.resolve_names_staged(d["fx_names"], d["fx_canonical"]))
    return rounded(names.name_map_coverage(report), "mapped_pct")


@REG.add(
    "resolve_by_overlap",
    f"WITH {OVERLAP}, mp AS (SELECT DISTINCT concat(p_name, ' LARGE') AS k, 'mapped ' || p_name AS v FROM part) "
    "SELECT n.raw_name, coalesce(e.canonical_name, mp.v, l.canonical_name, ob.canonical_name) AS canonical_name, "
    "CASE WHEN e.canonical_name IS NOT NULL THEN 'exact' WHEN mp.v IS NOT NULL THEN 'mapped' WHEN l.canonical_name IS NOT NULL THEN 'case' WHEN ob.canonical_name IS NOT NULL THEN 'overlap' END AS stage "
    "FROM (SELECT raw_name FROM fx_names UNION SELECT upper(canonical_name) FROM fx_canonical UNION SELECT canonical_name FROM fx_canonical) n "
    "LEFT JOIN fx_canonical e ON e.canonical_name = n.raw_name LEFT JOIN mp ON mp.k = n.raw_name LEFT JOIN fx_canonical l ON l.canonical_name = lower(n.raw_name) LEFT JOIN ob ON ob.raw_name = n.raw_name",
    NM,
)
def _(d):
    c = d["fx_canonical"]
    raw = d["fx_names"].union(c.select(F.upper("canonical_name"))).union(c)
    mapping = d["part"].select(F.concat("p_name", F.lit(" LARGE")).alias("k"), F.concat(F.lit("mapped "), "p_name").alias("v")).distinct()
    return names.resolve_by_overlap(raw, c, mapping)


@REG.add(
    "normalise_name",
    "SELECT DISTINCT concat(lower(p_name), ' state and ', lower(p_type)) AS name FROM part",
)
def _(d):
    raw = F.concat(F.lit("  "), F.upper("p_name"), F.lit("  St.  & "), F.col("p_type"), F.lit("\t"))
    return d["part"].select(X.normalise_name(raw).alias("name")).distinct()
