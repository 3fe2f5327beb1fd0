"""Input views over the given tables. One SQL text serves Spark and the SQL oracle."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchline.functions import exprs as X
from matchline.sources.scratch import materialise

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages"]

# {name} stands for a table or another view.
VIEWS = {
    "fx_games": """
SELECT o_orderkey AS game_key, CAST(o_orderdate AS DATE) AS game_date,
       o_custkey % 200 AS team_a,
       (o_custkey % 200 + 1 + o_orderkey % 199) % 200 AS team_b,
       50 + (o_custkey*31 + o_orderkey*17) % 61 AS points_a,
       50 + (o_orderkey*37 + o_custkey*7) % 61 AS points_b,
       CASE WHEN o_orderkey % 17 = 0 THEN NULL
            ELSE ((o_orderkey*13) % 61 - 30) / CAST(2 AS DOUBLE) END AS spread_a,
       CAST(140 + (o_orderkey*11) % 41 AS DOUBLE) AS total_line,
       o_orderkey % 9 = 0 AS is_neutral
FROM {orders}""",
    "fx_scored": """
SELECT *, CASE WHEN spread_a IS NULL THEN NULL
               WHEN points_a - points_b + spread_a > 0 THEN CAST(1 AS DOUBLE)
               WHEN points_a - points_b + spread_a < 0 THEN CAST(0 AS DOUBLE)
               ELSE CAST(0.5 AS DOUBLE) END AS cover_a,
       CAST((game_key*29) % 81 - 40 AS DOUBLE) / CAST(2 AS DOUBLE) AS pred_ridge,
       CAST((game_key*53) % 81 - 40 AS DOUBLE) / CAST(2 AS DOUBLE) AS pred_gbm,
       CASE WHEN game_key % 23 = 0 THEN NULL ELSE CAST((game_key*71) % 81 - 40 AS DOUBLE) / CAST(2 AS DOUBLE) END AS pred_dnn
FROM {fx_games}""",
    "games": """
SELECT game_key, game_date AS date, team_a, team_b, points_a, points_b, points_a - points_b AS final_margin_a,
       points_a + points_b AS game_total, spread_a, total_line, is_neutral, cover_a, pred_ridge, pred_gbm, pred_dnn,
       CAST(year(game_date) AS INTEGER) AS season
FROM {fx_scored}""",
    "fx_ratings": """
SELECT o_custkey % 200 AS team, CAST(date_trunc('month', o_orderdate) AS DATE) AS snapshot_date,
       CAST(90 + CAST(sum(o_orderkey) AS BIGINT) % 40 AS DOUBLE) AS adj_o,
       CAST(90 + CAST(sum(o_custkey*7) AS BIGINT) % 30 AS DOUBLE) AS adj_d,
       CAST(60 + count(*) % 15 AS DOUBLE) AS tempo
FROM {orders} WHERE year(o_orderdate) % 3 <> 0 GROUP BY 1, 2""",
    "ratings": """
SELECT team AS TeamName, snapshot_date, adj_o - adj_d AS AdjEM, adj_o AS AdjOE, adj_d AS AdjDE, tempo AS AdjTempo
FROM {fx_ratings}""",
    "fx_names": "SELECT DISTINCT concat(p_name, ' ', p_type) AS raw_name FROM {part}",
    "fx_canonical": "SELECT DISTINCT p_name AS canonical_name FROM {part} WHERE p_name NOT LIKE '% ring'",
    "fx_sides": """
SELECT game_key, game_date, 0 AS side, team_a AS team_id, team_b AS opp_id, points_a AS own, points_b AS opp,
       spread_a AS spread, total_line AS total, is_neutral FROM {fx_games}
UNION ALL
SELECT game_key, game_date, 1, team_b, team_a, points_b, points_a, -spread_a, total_line, is_neutral FROM {fx_games}""",
    "fx_defects": """
SELECT * FROM {fx_sides} WHERE NOT (game_key % 41 = 0 AND side = 1)
UNION ALL SELECT * FROM {fx_sides} WHERE game_key % 43 = 0 AND side = 0""",
    "fx_team_rows": """
SELECT game_key AS src_key, game_date, team_id, concat('School', team_id, ' Mascot') AS team_name,
       CASE WHEN game_key % 53 = 0 THEN 'Nowhere' ELSE concat('School', opp_id) END AS opponent,
       CASE WHEN is_neutral THEN 'Neutral' WHEN game_key % 47 = 0 OR side = 0 THEN 'Home' ELSE 'Away' END AS location,
       CASE WHEN own > opp THEN 'W' ELSE 'L' END AS result,
       CASE WHEN own > opp THEN own ELSE opp END AS winner_score,
       CASE WHEN own > opp THEN opp ELSE own END AS loser_score, spread, total,
       CASE WHEN spread IS NULL THEN NULL WHEN own - opp + spread > 0 THEN 'W'
            WHEN own - opp + spread < 0 THEN 'L' ELSE 'P' END AS ats,
       CASE WHEN own + opp > total THEN 'O' WHEN own + opp < total THEN 'U' ELSE 'P' END AS ou
FROM {fx_defects}""",
    "fx_dims": """
SELECT CAST(year(snapshot_date) AS INTEGER) AS season, team, sum(adj_o) AS off_x, sum(adj_d) AS def_x, max(tempo) AS avg_height
FROM {fx_ratings} WHERE team % 11 <> 0 GROUP BY 1, 2""",
    "fx_advantage": """
SELECT team, CAST(2 + team % 5 AS DOUBLE) / CAST(2 AS DOUBLE) AS hca, CAST(team * 13 % 1500 AS DOUBLE) AS elevation
FROM (SELECT DISTINCT team FROM {fx_ratings}) t WHERE team % 7 <> 0""",
    "fx_opponents": """
SELECT team_id, team_name, opponent FROM (
  SELECT min(p_partkey) AS team_id, concat(p_name, ' ', p_type) AS team_name, p_name AS opponent FROM {part} GROUP BY p_name, p_type
  UNION ALL SELECT min(p_partkey), concat(p_name, ' ', p_type), concat(' ', upper(p_name), ' ', p_type) FROM {part} GROUP BY p_name, p_type
  UNION ALL SELECT min(p_partkey), concat(p_name, ' ', p_type), substr(p_name, 2) FROM {part} GROUP BY p_name, p_type
  UNION ALL SELECT min(p_partkey), concat(p_name, ' ', p_type), p_type FROM {part} GROUP BY p_name, p_type
  UNION ALL SELECT 1000000 + min(p_partkey), concat(p_brand, ' of ', p_name, ' ', p_type), lower(p_brand) FROM {part} GROUP BY p_brand, p_name, p_type
  UNION ALL SELECT 2000000 + p_partkey, concat('Club', p_partkey, ' x'), concat('club', p_partkey) FROM {part} WHERE p_partkey % 3 = 0
) t""",
}

# The same without gaps, for queries whose feature is no missing row.
VIEWS["fx_all_ratings"] = VIEWS["fx_ratings"].replace(" WHERE year(o_orderdate) % 3 <> 0", "")
VIEWS["all_ratings"] = VIEWS["ratings"].replace("{fx_ratings}", "{fx_all_ratings}")
VIEWS["all_dims"] = VIEWS["fx_dims"].replace("{fx_ratings}", "{fx_all_ratings}").replace(" WHERE team % 11 <> 0", "")
VIEWS["all_advantage"] = VIEWS["fx_advantage"].replace("{fx_ratings}", "{fx_all_ratings}").replace(" WHERE team % 7 <> 0", "")


def _needs(text: str) -> list[str]:
    return [n for n in [*VIEWS, *TABLES] if "{" + n + "}" in text]


def with_views(query: str, *names: str) -> str:
    """Oracle text: the query with the views it uses as common table expressions."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in TABLES or name in order:
            return
        for dep in _needs(VIEWS[name]):
            add(dep)
        order.append(name)

    for n in names:
        add(n)
    plain = {n: n for n in [*VIEWS, *TABLES]}
    ctes = [f"{n} AS ({VIEWS[n].format(**plain)})" for n in order]
    query = query.strip()
    if query[:5].upper() == "WITH ":
        return "WITH " + ", ".join(ctes) + ", " + query[5:] if ctes else query
    return ("WITH " + ", ".join(ctes) + " " if ctes else "") + query


class Data:
    """The tables of one scale folder and the views over them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._frames: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames:
            if name in TABLES:
                self._frames[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                deps = {n: self[n] for n in _needs(VIEWS[name])}
                self._frames[name] = self.spark.sql(VIEWS[name], **deps)
        return self._frames[name]

    @cached_property
    def team_rows(self) -> DataFrame:
        """Two-sided rows under the landed column names."""
        rows = self["fx_team_rows"]
        return rows.select(
            "src_key", "team_id", "team_name", X.season_label("game_date").alias("season"),
            F.date_format("game_date", "MMM d, yyyy").alias("date"), "opponent", "location", F.lit("REG").alias("game"), "result",
            "winner_score", "loser_score", "ats", "spread", "ou", "total",
        )


    @cached_property
    def landed_rows(self) -> DataFrame:
        """The two-sided rows as a landed table."""
        return materialise(self.team_rows, "team-rows")


def r6(sql: str, name: str) -> str:
    """Six-decimal column of an oracle; the added zero turns -0.0 into 0.0."""
    return f"round({sql}, 6) + CAST(0 AS DOUBLE) AS {name}"


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: X.round6(F.col(n).cast("double")) for n in names})


SEASON = (
    "CASE WHEN month({d}) >= 10 THEN concat(year({d}), '-', lpad(CAST((year({d}) + 1) % 100 AS VARCHAR), 2, '0')) "
    "ELSE concat(year({d}) - 1, '-', lpad(CAST(year({d}) % 100 AS VARCHAR), 2, '0')) END"
)


def season_sql(d: str) -> str:
    return SEASON.format(d=d)


class Registry:
    """Query functions and oracle texts by name."""

    def __init__(self):
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None, views: tuple[str, ...] = ()):
        def wrap(fn):
            def run(spark: SparkSession, folder: str) -> DataFrame:
                from matchline.plans.session import configure

                return fn(Data(configure(spark), folder))

            run.__name__ = name
            if name in self.queries:
                raise ValueError(f"{name} is registered twice")
            self.queries[name] = run
            if sql is not None:
                self.sql[name] = with_views(sql, *views)
            return fn

        return wrap

REG = Registry()
