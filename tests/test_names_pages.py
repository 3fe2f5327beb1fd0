"""Name resolution against brute force, and pages and odds on awkward documents."""

import itertools
import random

import pytest

from matchline.operators import names as N
from matchline.operators import odds, pages, picks


def frame(spark, values, name):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def test_overlap_matches_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(30)]
    make = lambda k: " ".join(rng.choice(["State", *vocab]) for _ in range(k))
    raw = list({make(rng.randint(1, 14)) for _ in range(60)} | {"zzz", "  State   w1 "})
    canon = list({make(rng.randint(1, 13)) for _ in range(60)})
    got = {r[0]: (r[1], r[2]) for r in N.token_overlap_join(frame(spark, raw, "raw_name"), frame(spark, canon, "canonical_name")).collect()}
    for r in raw:
        w = set(r.lower().split())
        best = min(((-len(w & set(c.lower().split())), c) for c in canon), default=(0, None))
        assert got.get(r) == ((best[1], -best[0]) if best[0] < 0 else None), r


def test_containment_matches_brute_force(spark):
    rng = random.Random(8)
    letters = ["al", "be", "a", "ta", " "]
    make = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(2, 6))).strip() or "x"
    schools = {i: make() + " cats" for i in range(40)}
    opponents = list({make() for _ in range(60)})
    rows = spark.createDataFrame([(i, s, o) for (i, s), o in zip(itertools.cycle(schools.items()), [*opponents, *opponents])], "team_id int, team_name string, opponent string")
    table = N.school_table(rows).cache()
    known = {r["team_id"]: r["school"] for r in table.collect()}
    got = {r[0]: (r[1], r[2]) for r in N.containment_theta_join(rows.select("opponent"), table).collect()}
    for o in opponents:
        score = {i: 100 if s == o else 90 if s.startswith(o + " ") else 50 for i, s in known.items() if o in s}
        top = max(score.values(), default=0)
        best = [i for i, v in score.items() if v == top]
        want = (min(best), top) if top == 100 or len(best) == 1 else None
        assert got.get(o) == want, o


def test_opponent_rules(spark):
    rows = spark.createDataFrame(
        [
            (1, "Alabama Crimson Tide", "Texas"), (2, "Texas Longhorns", "alabama"), (3, "Texas State Bobcats", " TEXAS LONGHORNS "),
            (4, "Solo", "Solo"), (5, "North Dakota Fighting Hawks", "North Dakota"), (6, "North Dakota Hawks", "Dakota"),
            (7, "Texas Longhorns", "Crimson"), (8, "UNLV Rebels", "unlv"),
        ],
        "team_id int, team_name string, opponent string",
    )
    got = {r[0]: r[1] for r in N.resolve_opponent_ids(rows).collect()}
    assert got == {
        "Texas": 2, "alabama": 1, " TEXAS LONGHORNS ": 7, "Solo": 4, "North Dakota": 5, "Crimson": 1, "unlv": 8,
    }


def test_stage_order(spark):
    canon = ["Alabama", "Alabama St.", "Iowa State", "Duke", "Dukes Hill", "Vermont", "ohio st."]
    raw = ["Alabama Crimson Tide", "Duke", "Alabama State Hornets", "Alabama State Bees", "Iowa St. Cyclones", "Vermontia X Y", "DUKE Devils", "Nobody", "Ohio State Bucks"]
    got = {r[0]: (r[1], r[2]) for r in N.resolve_names_staged(frame(spark, raw, "raw_name"), frame(spark, canon, "canonical_name")).collect()}
    assert got == {
        "Alabama Crimson Tide": ("Alabama", "mapped"), "Duke": ("Duke", "exact"), "Alabama State Hornets": ("Alabama St.", "mapped"),
        "Alabama State Bees": ("Alabama St.", "st_to_state"), "Iowa St. Cyclones": ("Iowa State", "state_to_st"), "Vermontia X Y": (None, None),
        "DUKE Devils": ("Duke", "school"), "Nobody": (None, None), "Ohio State Bucks": ("ohio st.", "first_word"),
    }
    forced = spark.createDataFrame([("Duke", "Vermont"), ("Nobody", "Absent")], "k string, v string")
    again = {r[0]: r[1] for r in N.resolve_names_staged(frame(spark, raw, "raw_name"), frame(spark, canon, "canonical_name"), overrides=forced).collect()}
    assert again["Duke"] == "Vermont" and again["Nobody"] is None


def test_unique_prefix(spark):
    got = N.prefix_theta_join(frame(spark, ["Miami X", "Ver Y", "Du Z"], "raw_name"), frame(spark, ["Miami FL", "Miami OH", "Vermont", "Duke", "Duquesne"], "canonical_name"))
    assert [tuple(r) for r in got.collect()] == [("Ver Y", "Vermont")]


BOOK = "array<struct<markets: array<struct<key: string, outcomes: array<struct<name: string, point: double>>>>>>"


def test_odds_search_order(spark):
    market = lambda key, *o: {"key": key, "outcomes": [{"name": n, "point": p} for n, p in o]}
    docs = [
        [{"markets": [market("h2h", ("H", 1.0))]}, {"markets": [market("spreads", ("A", 4.0))]}, {"markets": [market("spreads", ("H", -3.0))]}],
        [{"markets": [market("spreads", ("A", 2.0)), market("spreads", ("H", 9.0))]}],
        [{"markets": [market("spreads", ("H", -1.5), ("A", 1.5))]}, {"markets": [market("spreads", ("H", -7.0), ("A", 7.0))]}],
        [], None,
    ]
    df = spark.createDataFrame([(i, "H", "A", b) for i, b in enumerate(docs)], f"i int, home_team string, away_team string, bookmakers {BOOK}")
    got = [tuple(r) for r in odds.flatten_odds(df).orderBy("i").select("spread_home", "spread_away").collect()]
    assert got == [(-3.0, 4.0), (None, 2.0), (-1.5, 1.5), (None, None), (None, None)]


def test_challenge_and_ratings_pages(spark):
    cells = ["1", "Gonzaga", "WCC", "+30.9", "120", "1", "89", "2", "72", "3", "x"]
    table = "<TABLE id=a><tr>" + "".join(f"<th>{i}</th>" for i in range(11)) + "</tr><tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr><tr><td>a</td></tr></TABLE>"
    df = spark.createDataFrame([("2024-01-01", table), ("2024-01-02", "Just a moment " + table)], "snapshot_date string, html string")
    rows, bad = pages.ratings_page_to_rows(df)
    got = [tuple(r) for r in rows.filter("TeamName = 'Gonzaga'").collect()]
    assert got == [("2024-01-01", "Gonzaga", 30.9, 120.0, 89.0, 72.0)]
    assert bad.count() == 1


def test_pick_texts(spark):
    rows = spark.createDataFrame(
        [("H", "A", "H", "A", -3.5, 9.0), ("H", "A", "H", "A", 2.25, -12.0), ("H", "A", "H", "A", -3.0, 4.0), ("H", "A", None, "A", -3.0, None), ("H", "A", "H", "A", None, 4.0), ("H", "A", "H", "A", float("nan"), 4.0)],
        "home_team string, away_team string, home_kp string, away_kp string, spread_home double, pred_margin double",
    )
    got = [(r["pick"], r["confidence"], r["is_actionable"]) for r in picks.daily_picks(rows).collect()]
    assert got == [("H -3.5", "**", True), ("A -2.2", "***", True), ("SKIP", "", False), ("NO DATA", "", False), ("NO LINE", "", False), ("NO LINE", "", False)]


def test_page_rows(spark):
    head = "".join(f"<th>{c}</th>" for c in ["Date", "Opponent", "Game", "Result", "Score", "ATS", "Spread", "OU", "Total"])
    row = "<tr><td>Jan 5, 2024</td><td>@ <a href='x'>A &amp; M</a></td><td>REG</td><td>L</td><td>60 - 70</td><td></td><td>+3.5</td><td>O</td><td>130</td></tr>"
    html = f"<title>Duke - log</title><table><thead><tr>{head}</tr></thead>{row}</table>"
    df = spark.createDataFrame([(1, "2023-24", html), (2, "2023-24", "<p/>")], "team_id int, season string, html string")
    rows, rejects = pages.page_log_to_rows(df)
    r = rows.first()
    assert (r["team_name"], r["opponent"], r["location"], r["winner_score"], r["loser_score"], r["ats"], r["spread"], r["total"]) == ("Duke", "A & M", "Away", 70, 60, None, 3.5, 130.0)
    assert [tuple(x) for x in rejects.collect()] == [(2, "2023-24", "no table")]




def plain_grid(rows):
    """Row and column spans by a plain table of taken places; rows are lists of (text, columns, rows)."""
    out, open_ = [], []
    i = 0
    while i < len(rows) or open_:
        cells, line, next_ = list(rows[i]) if i < len(rows) else [], [], []
        queue = open_

        def put(at, text, left):
            line.append(text)
            if left > 1:
                next_.append((at, text, left - 1))

        for text, columns, left in cells:
            while queue and queue[0][0] <= len(line):
                put(*queue.pop(0))
            for _ in range(columns):
                put(len(line), text, left)
        for e in queue:
            put(*e)
        out.append(line)
        open_, i = next_, i + 1
    return out


def test_spans_are_a_plain_grid(spark):
    rng = random.Random(11)
    pages_, want = [], []
    for k in range(300):
        rows = []
        for r in range(rng.randrange(1, 7)):
            rows.append([(f"{r}.{c}", rng.choice([1, 1, 1, 2, 3]), rng.choice([1, 1, 1, 2, 4])) for c in range(rng.randrange(0, 6))])
        tag = lambda n, v: rng.choice([f' {n}="{v}"', f" {n.upper()}={v}", f" class=x {n} = '{v}'"]) if v > 1 or rng.random() < 0.2 else ""
        cell = lambda t, c, r: f"<{(x := rng.choice(['td', 'th', 'TD']))}{tag('colspan', c)}{tag('rowspan', r)}> <b>{t}</b>&nbsp;</{x}>"
        pages_.append((k, "<p><table>" + "".join("<tr>" + "".join(cell(*c) for c in row) + "</tr>" for row in rows) + "</table>"))
        want.append(plain_grid(rows))
    got = spark.createDataFrame(pages_, "k int, html string").select("k", pages.table_rows("html").alias("r")).orderBy("k").collect()
    assert [[[c.strip("\xa0 ") for c in row] for row in r.r] for r in got] == want


def test_odd_spans(spark):
    html = [
        "<table><tr><td>a</td><td colspan=2>b</td></tr><tr><td rowspan=2>d</td><td>e</td><td>f</td></tr><tr><td>g</td><td>h</td></tr></table>",
        "<table><tr><td colspan=0 rowspan='x'>a</td><td colspan=\"\">b</td></tr></table>",
        "<table><tr><td colspan=5000>a</td></tr></table>",
        "<table><tr><td data-colspan=3>a</td><td>b</td></tr></table>",
        "<table><tr><td colspan=2>x<table><tr><td rowspan=9>in</td></tr></table></td></tr></table>",
        "<table><tr><td rowspan=2>never ends", None,
    ]
    got = [r.r for r in spark.createDataFrame(list(enumerate(html)), "k int, html string").select("k", pages.table_rows("html").alias("r")).orderBy("k").collect()]
    assert got[0] == [["a", "b", "b"], ["d", "e", "f"], ["d", "g", "h"]]
    assert got[1] == [["a", "b"]] and got[2] == [["a"] * 1000] and got[3] == [["a", "b"]] and got[4] == [["x in", "x in"]] and got[5] is None and got[6] is None


def test_page_rows_with_spans(spark):
    head = "".join(f"<th>{c}</th>" for c in ["Date", "Opponent", "Game", "Result", "Score", "ATS", "Spread", "OU", "Total"])
    first = "<tr><td rowspan=2>Jan 5, 2024</td><td>A</td><td>REG</td><td>L</td><td>60 - 70</td><td colspan=2></td><td>O</td><td>130</td></tr>"
    second = "<tr><td>vs B</td><td>REG</td><td>W</td><td>60 - 70</td><td>W</td><td>-2</td><td>U</td><td>131</td></tr>"
    df = spark.createDataFrame([(1, "2023-24", f"<title>Duke - log</title><table><tr>{head}</tr>{first}{second}</table>")], "team_id int, season string, html string")
    got = [(r["date"], r["opponent"], r["location"], r["ats"], r["spread"], r["ou"], r["total"]) for r in pages.page_log_to_rows(df)[0].collect()]
    assert got == [("Jan 5, 2024", "A", "Neutral", None, None, "O", 130.0), ("Jan 5, 2024", "B", "Home", "W", -2.0, "U", 131.0)]


def test_a_long_table_is_read_in_one_pass(spark):
    n = 30_000
    rows = "".join(f"<tr>{'<td rowspan=3>d</td>' if i % 3 == 0 else ''}<td>{i}</td></tr>" for i in range(n))
    df = spark.createDataFrame([(f"<table>{rows}</table>",)], "html string").select(pages.table_rows("html").alias("r"))
    # Array expressions copy what they have built with each row.
    assert "ArrowEvalPython" in df._jdf.queryExecution().executedPlan().toString()
    assert df.first().r == [["d", str(i)] for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_suffix_index_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    name = lambda n: "".join(rng.choices("ab c", k=rng.randrange(n)))
    schools = [(i, name(14)) for i in range(60)] + [(60, ""), (61, "x" * 30), (62, "aé日本 b"), (63, None)]
    keys = {name(9).strip() for _ in range(300)} | {"", "x" * 30, "x" * 29, "é日", "aé日本", "zzzz"}
    want = {}
    for k in keys:
        ranks = {}
        for i, s in schools:
            if s is not None and k in s and (k or not s):
                ranks.setdefault(100 if s == k else 90 if s.startswith(k + " ") else 50, []).append(i)
        if ranks:
            best = max(ranks)
            if best == 100 or len(ranks[best]) == 1:
                want[k] = (min(ranks[best]), best)
    got = N.containment_theta_join(spark.createDataFrame([(k,) for k in keys], "opponent string"), spark.createDataFrame(schools, "team_id long, school string"))
    assert {r.opponent: (r.team_id, r.score) for r in got.collect()} == want


def test_a_long_name_adds_one_entry_per_character(spark):
    text = "".join(chr(97 + i % 26) + str(i) for i in range(2000))[:10_000].ljust(10_000, "z")
    schools = spark.createDataFrame([(1, text), (2, "abc")], "team_id long, school string")
    index = N.suffix_index(schools)
    assert index.count() == 10_000 - N.GRAM + 1 and max(len(r.gram) for r in index.collect()) == N.GRAM
    probes = spark.createDataFrame([(text[4000:9000],), (text,), ("abc",)], "opponent string")
    assert {(len(r.opponent), r.team_id, r.score) for r in N.containment_theta_join(probes, schools).collect()} == {(5000, 1, 50), (10_000, 1, 100), (3, 2, 100)}
