"""Page, odds and picks queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchline.functions import exprs as X
from matchline.functions import fixed
from matchline.operators import odds, pages, picks
from matchline.plans import daily

from .fixtures import REG, r6, rounded

G = ("games",)


@REG.add("extract_link_ids", "SELECT DISTINCT unnest(regexp_extract_all(html, 'href=\"/([^\"]+)\"', 1)) AS link_id FROM pages")
def _(d):
    return pages.extract_link_ids(d["pages"], pattern='href="/([^"]+)"')


@REG.add(
    "extract_page_title",
    "WITH t AS (SELECT page_id, replace(replace(replace(replace(replace(replace(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS raw FROM pages), "
    "s AS (SELECT page_id, trim(split_part(trim(raw, E' \\t\\n\\r\\f\\x0b'), ' - ', 1), E' \\t\\n\\r\\f\\x0b') AS title FROM t) SELECT page_id, CASE WHEN title = '' THEN 'Unknown Team' ELSE title END AS title FROM s",
)
def _(d):
    return pages.extract_page_title(d["pages"]).select("page_id", "title")


@REG.add(
    "split_venue_prefix",
    "SELECT p_partkey, p_name AS opponent, CASE p_partkey % 3 WHEN 0 THEN 'Away' WHEN 1 THEN 'Home' ELSE 'Neutral' END AS location FROM part",
)
def _(d):
    k = F.col("p_partkey") % 3
    raw = F.when(k == 0, F.concat(F.lit(" @ "), "p_name")).when(k == 1, F.concat(F.lit("VS "), "p_name", F.lit(" "))).otherwise(F.col("p_name"))
    opponent, location = X.split_venue(raw)
    return d["part"].select("p_partkey", opponent.alias("opponent"), location.alias("location"))


@REG.add(
    "parse_score_pair",
    "SELECT game_key, CASE WHEN game_key % 11 = 0 THEN NULL ELSE CAST(greatest(points_a, points_b) AS INTEGER) END AS winner_score, CASE WHEN game_key % 11 = 0 THEN NULL ELSE CAST(least(points_a, points_b) AS INTEGER) END AS loser_score FROM games",
    G,
)
def _(d):
    raw = F.when(F.col("game_key") % 11 == 0, "n/a").otherwise(F.concat_ws(" - ", F.col("points_a").cast("string"), F.col("points_b").cast("string")))
    w, lo = X.score_pair(raw)
    return d["games"].select("game_key", w.alias("winner_score"), lo.alias("loser_score"))


def log_pages(d):
    """One game-log page per landed row; some lack the table, some a column."""
    venue = F.when(F.col("location") == "Away", "@ ").when(F.col("location") == "Home", "vs ").otherwise("")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    cells = [
        F.date_format("game_date", "MMM d, yyyy"), F.concat(venue, F.col("opponent")), F.lit("REG"), F.col("result"),
        F.concat_ws(" - ", text("loser_score"), text("winner_score")), text("ats"), text("spread"), F.lit(""), text("total"),
    ]
    head = "".join(f"<th>{c}</th>" for c in ("Date", "Opponent", "Game", "Result", "Score", "ATS", "Spread", "OU", "Total"))
    row = F.concat(F.lit("<tr class='r'>"), *[F.concat(F.lit("<td><b>"), c, F.lit("</b></td>")) for c in cells], F.lit("</tr>"))
    title = F.concat(F.lit("<html><title>"), F.col("team_name"), F.lit(" - Game log</title>"))
    table = F.concat(F.lit(f"<table>\n<tr>{head}</tr>"), row, F.lit("</table></html>"))
    k = F.col("src_key") % 50
    body = F.when(k == 7, "<p>no games</p>").when(k == 9, F.replace(table, F.lit("<th>Score</th>"), F.lit("<th>Final</th>"))).otherwise(table)
    return d["fx_team_rows"].repartition("src_key").select("team_id", F.lit("2024-25").alias("season"), F.concat(title, body).alias("html"), "src_key")


@REG.add(
    "page_log_to_rows",
    "SELECT team_id, team_name, '2024-25' AS season, strftime(game_date, '%b %-d, %Y') AS date, opponent, location, 'REG' AS game, result, CAST(winner_score AS INTEGER) AS winner_score, CAST(loser_score AS INTEGER) AS loser_score, ats, "
    f"{r6('spread', 'spread')}, CAST(NULL AS VARCHAR) AS ou, {r6('total', 'total')} FROM fx_team_rows WHERE src_key % 50 NOT IN (7, 9)",
    ("fx_team_rows",),
)
def _(d):
    return rounded(pages.page_log_to_rows(log_pages(d))[0], "spread", "total")


def monthly_pages(d):
    """One game-log page per team and month: the day stands once for all its rows, and two empty cells in a row are one."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    rows = d["fx_team_rows"]
    order = [F.col(c).asc_nulls_first() for c in ("src_key", "location", "total")]
    day = Window.partitionBy("team_id", "game_date")
    rows = rows.withColumn("at", F.row_number().over(day.orderBy(*order))).withColumn("n", F.count("*").over(day))
    venue = F.when(F.col("location") == "Away", "@ ").when(F.col("location") == "Home", "vs ").otherwise("")
    date = F.concat(F.lit('<td class="d" rowspan="'), F.col("n").cast("string"), F.lit('">'), F.date_format("game_date", "MMM d, yyyy"), F.lit("</td>"))
    lines = F.when(F.col("ats").isNull() & F.col("spread").isNull(), "<td colspan=2></td>").otherwise(F.concat(cell(text("ats")), cell(text("spread"))))
    row = F.concat(
        F.lit("<tr>"), F.when(F.col("at") == 1, date).otherwise(F.lit("")), cell(F.concat(venue, F.col("opponent"))), cell(F.lit("REG")), cell(F.col("result")),
        cell(F.concat_ws(" - ", text("loser_score"), text("winner_score"))), lines, cell(F.lit("")), cell(text("total")), F.lit("</tr>"),
    )
    month = F.trunc("game_date", "month")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("game_date", "at", row.alias("row")))), lambda r: r["row"]), "\n")
    head = "".join(f"<th>{c}</th>" for c in ("Date", "Opponent", "Game", "Result", "Score", "ATS", "Spread", "OU", "Total"))
    grouped = rows.groupBy("team_id", "team_name", month.alias("month")).agg(body.alias("body"))
    html = F.concat(F.lit("<html><title>"), F.col("team_name"), F.lit(f" - Game log</title><table><tr>{head}</tr>"), F.col("body"), F.lit("</table></html>"))
    return grouped.select("team_id", F.lit("2024-25").alias("season"), html.alias("html"))


@REG.add(
    "page_log_with_spans",
    "SELECT team_id, team_name, '2024-25' AS season, strftime(game_date, '%b %-d, %Y') AS date, opponent, location, 'REG' AS game, result, CAST(winner_score AS INTEGER) AS winner_score, CAST(loser_score AS INTEGER) AS loser_score, ats, "
    f"{r6('spread', 'spread')}, CAST(NULL AS VARCHAR) AS ou, {r6('total', 'total')} FROM fx_team_rows",
    ("fx_team_rows",),
)
def _(d):
    rows, _ = pages.page_log_to_rows(monthly_pages(d))
    return rounded(rows, "spread", "total")


@REG.add(
    "page_log_rejects",
    "SELECT team_id, CASE src_key % 50 WHEN 7 THEN 'no table' ELSE 'missing columns: score' END AS reject_reason, count(*) AS n_pages FROM fx_team_rows WHERE src_key % 50 IN (7, 9) GROUP BY 1, 2",
    ("fx_team_rows",),
)
def _(d):
    rejects = pages.page_log_to_rows(log_pages(d))[1]
    return rejects.groupBy("team_id", "reject_reason").agg(F.count("*").alias("n_pages"))


@REG.add(
    "challenge_page_filter",
    "SELECT page_id % 10 = 3 AS is_challenge, count(*) AS n_pages FROM pages GROUP BY 1",
)
def _(d):
    marked = d["pages"].withColumn(
        "html", F.when(F.col("page_id") % 10 == 3, F.concat(F.lit("<title>Just a moment...</title>"), "html")).otherwise(F.col("html"))
    )
    good, bad = pages.challenge_page_filter(marked)
    flag = lambda df, v: df.select(F.lit(v).alias("is_challenge"))
    return flag(good, False).unionByName(flag(bad, True)).groupBy("is_challenge").agg(F.count("*").alias("n_pages"))


def ratings_pages(d):
    """One archive page per rating row, with a caption row and a short row in its table."""
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    num = lambda c: F.col(c).cast("string")
    signed = F.when(F.col("AdjEM") > 0, F.concat(F.lit("+"), num("AdjEM"))).otherwise(num("AdjEM"))
    cells = [F.lit("1"), F.concat(F.lit("School"), num("TeamName")), F.lit("X"), signed, num("AdjOE"), F.lit("1"), num("AdjDE"), F.lit("1"), num("AdjTempo"), F.lit("1"), F.lit("9")]
    caption = "<tr>" + "<td>Ratings on Nov 3</td>" * 10 + "</tr><tr><td>short</td></tr>"
    html = F.concat(F.lit(f"<table id='ratings-table'>{caption}<tr>"), *[cell(c) for c in cells], F.lit("</tr></table>"))
    return d["all_ratings"].select("snapshot_date", html.alias("html"))


@REG.add(
    "ratings_page_to_rows",
    "SELECT snapshot_date, concat('School', TeamName) AS TeamName, " + ", ".join(r6(c, c) for c in fixed.RATING_COLUMNS) + " FROM all_ratings",
    ("all_ratings",),
)
def _(d):
    return rounded(pages.ratings_page_to_rows(ratings_pages(d))[0], *fixed.RATING_COLUMNS)


def yearly_archive(d):
    """One archive page per month with all its teams; the conference cell spans all rows, the last two columns are one."""
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    num = lambda c: F.col(c).cast("string")
    month = Window.partitionBy("snapshot_date")
    rows = d["all_ratings"].withColumn("at", F.row_number().over(month.orderBy("TeamName"))).withColumn("n", F.count("*").over(month))
    conference = F.when(F.col("at") == 1, F.concat(F.lit("<td rowspan='"), num("n"), F.lit("'>X</td>"))).otherwise(F.lit(""))
    cells = [cell(num("at")), cell(F.concat(F.lit("School"), num("TeamName"))), conference, *[x for c in ("AdjEM", "AdjOE", "AdjDE") for x in ((cell(num(c)),) if c == "AdjEM" else (cell(num(c)), cell(F.lit("1"))))], cell(num("AdjTempo")), F.lit("<td colspan=2>1</td>")]
    row = F.concat(F.lit("<tr>"), *cells, F.lit("</tr>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", row.alias("row")))), lambda r: r["row"]), "")
    caption = "<tr><td colspan=10>Ratings on Nov 3</td></tr>"
    pages_ = rows.groupBy("snapshot_date").agg(body.alias("body"))
    return pages_.select("snapshot_date", F.concat(F.lit(f"<table id='ratings-table'>{caption}"), F.col("body"), F.lit("</table>")).alias("html"))


@REG.add(
    "ratings_page_with_spans",
    "SELECT snapshot_date, concat('School', TeamName) AS TeamName, " + ", ".join(r6(c, c) for c in fixed.RATING_COLUMNS) + " FROM all_ratings",
    ("all_ratings",),
)
def _(d):
    return rounded(pages.ratings_page_to_rows(yearly_archive(d))[0], *fixed.RATING_COLUMNS)


def odds_documents(d):
    """One document per order: each line item is a bookmaker with one market, in line order."""
    li = d["lineitem"]
    outcome = lambda name, p: F.struct(F.lit(name).alias("name"), p.alias("point"))
    outcomes = F.array(outcome("H", F.col("l_quantity")), outcome("A", -F.col("l_quantity")))
    market = F.struct(F.when(F.col("l_linenumber") % 2 == 1, "h2h").otherwise("spreads").alias("key"), outcomes.alias("outcomes"))
    books = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_quantity", F.array(market).alias("markets"))))
    doc = F.to_json(F.transform(books, lambda b: F.struct(b["markets"].alias("markets"))))
    return li.groupBy("l_orderkey").agg(doc.alias("bookmakers_json")).withColumns({"home_team": F.lit("H"), "away_team": F.lit("A")})


@REG.add(
    "flatten_odds_json",
    "WITH p AS (SELECT l_orderkey, l_quantity FROM lineitem WHERE l_linenumber % 2 = 0 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) = 1) "
    f"SELECT o.l_orderkey, {r6('p.l_quantity', 'spread_home')}, {r6('-p.l_quantity', 'spread_away')} FROM (SELECT DISTINCT l_orderkey FROM lineitem) o LEFT JOIN p ON p.l_orderkey = o.l_orderkey",
)
def _(d):
    out = odds.flatten_odds_json(odds_documents(d)).select("l_orderkey", "spread_home", "spread_away")
    return rounded(out, "spread_home", "spread_away")


# --- picks -----------------------------------------------------------------

PICKS = (
    "e AS (SELECT game_key, date, concat('Team ', team_a) AS home_team, concat('Team ', team_b) AS away_team, CASE WHEN team_a % 13 <> 0 THEN concat('Team ', team_a) END AS home_kp, "
    "CASE WHEN team_b % 13 <> 0 THEN concat('Team ', team_b) END AS away_kp, spread_a AS spread_home, pred_dnn AS pred_margin, pred_dnn + spread_a AS edge FROM games), "
    "f AS (SELECT *, coalesce(abs(edge) >= 4.5, false) AS is_actionable FROM e), "
    "pk AS (SELECT *, CASE WHEN spread_home IS NULL THEN 'NO LINE' WHEN home_kp IS NULL OR away_kp IS NULL OR edge IS NULL THEN 'NO DATA' WHEN NOT is_actionable THEN 'SKIP' END AS blocked FROM f), "
    "picks AS (SELECT game_key, date, home_team, away_team, home_kp, away_kp, spread_home, pred_margin, edge, is_actionable, "
    "coalesce(blocked, CASE WHEN edge > 0 THEN concat(home_team, ' ', printf('%+.1f', spread_home)) ELSE concat(away_team, ' ', printf('%+.1f', -spread_home)) END) AS pick, "
    "CASE WHEN blocked IS NULL THEN repeat('*', CAST(least(floor(abs(edge) / 2), 3) AS INTEGER)) ELSE '' END AS confidence FROM pk)"
)


def board(d):
    """Predictions of every match with some unresolved names."""
    name = lambda c: F.concat(F.lit("Team "), F.col(c).cast("string"))
    rows = d["games"].select(
        "game_key", "date", name("team_a").alias("home_team"), name("team_b").alias("away_team"),
        F.when(F.col("team_a") % 13 != 0, name("team_a")).alias("home_kp"), F.when(F.col("team_b") % 13 != 0, name("team_b")).alias("away_kp"),
        F.col("spread_a").alias("spread_home"), F.col("pred_dnn").alias("pred_margin"),
    )
    return picks.daily_picks(rows)


NUMBERS = ["spread_home", "pred_margin", "edge"]
PICK_COLS = "game_key, home_team, away_team, home_kp, away_kp, " + ", ".join(r6(c, c) for c in NUMBERS) + ", pick, confidence, is_actionable"


def _shown(df, *more):
    return rounded(df.select("game_key", *daily.PREDICTION_COLUMNS, *more), *NUMBERS)


@REG.add("daily_picks", f"WITH {PICKS} SELECT {PICK_COLS} FROM picks", G)
def _(d):
    return _shown(board(d))


@REG.add("picks_summary", f"WITH {PICKS} SELECT count(*) AS total_games, count(*) FILTER (WHERE is_actionable) AS actionable_picks FROM picks", G)
def _(d):
    return picks.picks_summary(board(d))


@REG.add("picks_sorted", f"WITH {PICKS} SELECT {PICK_COLS}, {r6('abs(edge)', 'abs_edge')} FROM picks WHERE is_actionable", G)
def _(d):
    return rounded(_shown(picks.picks_sorted(board(d)), "abs_edge"), "abs_edge")


@REG.add(
    "top_k_with_ties",
    f"WITH {PICKS}, c AS (SELECT min(x) AS cut FROM (SELECT abs(edge) AS x FROM picks WHERE is_actionable ORDER BY x DESC LIMIT 5) t) SELECT {PICK_COLS}, {r6('abs(edge)', 'abs_edge')} FROM picks, c WHERE is_actionable AND abs(edge) >= cut",
    G,
)
def _(d):
    return rounded(_shown(picks.top_k_with_ties(board(d)), "abs_edge"), "abs_edge")


@REG.add(
    "all_games_table",
    f"WITH {PICKS} SELECT away_team, home_team, coalesce(printf('%+.1f', spread_home), 'N/A') AS spread_text, coalesce(printf('%.1f', pred_margin), 'N/A') AS margin_text, coalesce(printf('%+.1f', edge), 'N/A') AS edge_text, pick, is_actionable AS highlight FROM picks",
    G,
)
def _(d):
    return picks.all_games_table(board(d))


@REG.add("read_latest_partition", f"WITH {PICKS} SELECT {PICK_COLS} FROM picks WHERE date = (SELECT max(date) FROM picks)", G)
def _(d):
    return _shown(picks.read_latest_date(board(d), "date"))


@REG.add("read_last_n_partitions", f"WITH {PICKS} SELECT {PICK_COLS} FROM picks WHERE date IN (SELECT DISTINCT date FROM picks ORDER BY date DESC LIMIT 7)", G)
def _(d):
    return _shown(picks.read_last_dates(board(d), 7, "date"))


# The whole daily job: documents, names, latest ratings, venue advantage, picks.
SCORE = (
    "p AS (SELECT l_orderkey, l_quantity FROM lineitem WHERE l_linenumber % 2 = 0 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) = 1), "
    "cur AS (SELECT TeamName, AdjEM, AdjTempo FROM ratings QUALIFY row_number() OVER (PARTITION BY TeamName ORDER BY snapshot_date DESC) = 1), "
    "s AS (SELECT g.game_key, concat('Team', g.team_a) AS home_team, concat('Team', g.team_b) AS away_team, p.l_quantity AS spread_home, "
    "CASE WHEN a.TeamName IS NOT NULL AND b.TeamName IS NOT NULL THEN (a.AdjEM - b.AdjEM) * ((a.AdjTempo + b.AdjTempo) / 2) / 100 + coalesce(v.hca, 3.5) END AS pred_margin "
    "FROM games g JOIN (SELECT DISTINCT l_orderkey FROM lineitem) d ON d.l_orderkey = g.game_key LEFT JOIN p ON p.l_orderkey = g.game_key LEFT JOIN cur a ON a.TeamName = g.team_a LEFT JOIN cur b ON b.TeamName = g.team_b LEFT JOIN fx_advantage v ON v.team = g.team_a), "
    "e AS (SELECT *, pred_margin + spread_home AS edge FROM s)"
)


@REG.add(
    "score_day",
    f"WITH {SCORE} SELECT game_key, home_team, away_team, {r6('spread_home', 'spread_home')}, {r6('pred_margin', 'pred_margin')}, {r6('edge', 'edge')}, coalesce(abs(edge) >= 4.5, false) AS is_actionable, "
    "CASE WHEN spread_home IS NULL THEN 'NO LINE' WHEN edge IS NULL THEN 'NO DATA' WHEN abs(edge) < 4.5 THEN 'SKIP' WHEN edge > 0 THEN concat(home_team, ' ', printf('%+.1f', spread_home)) ELSE concat(away_team, ' ', printf('%+.1f', -spread_home)) END AS pick FROM e",
    ("games", "ratings", "fx_advantage"),
)
def _(d):
    name = lambda c: F.concat(F.lit("Team"), F.col(c).cast("string"))
    docs = odds.flatten_odds_json(odds_documents(d)).select(F.col("l_orderkey").alias("game_key"), "spread_home", "spread_away")
    games = d["games"].select("game_key", name("team_a").alias("home_team"), name("team_b").alias("away_team")).join(docs, "game_key")
    ratings = d["ratings"].withColumn("TeamName", name("TeamName"))
    canonical = d["games"].select(F.explode(F.array(name("team_a"), name("team_b"))).alias("canonical_name")).distinct()
    mapping = d.spark.createDataFrame([], "raw_name string, canonical_name string")
    hca = {"hca": d["fx_advantage"].withColumn("TeamName", name("team")).drop("team")}
    out = daily.score_day(games, canonical, mapping, ratings, hca, bookmakers=None)
    return rounded(out.select("game_key", "home_team", "away_team", "spread_home", "pred_margin", "edge", "is_actionable", "pick"), *NUMBERS)


