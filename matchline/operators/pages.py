"""Landed pages to rows. Bad pages go to a reject table instead of failing the job."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import fixed

# Opening tags cut the page; whatever closes a row or cell goes with the other tags.
_TABLE = re.compile(r"(</?table(?:\s[^>]*)?>)", re.ASCII | re.IGNORECASE)
_ROW = re.compile(r"<tr(?:\s[^>]*)?>", re.ASCII | re.IGNORECASE)
_CELL = re.compile(r"<t[hd](?:\s[^>]*)?>", re.ASCII | re.IGNORECASE)
_BLANK = re.compile(r"(?:<[^>]*>|\s)+", re.ASCII)
# The same cell tag with its spans, each if it has one.
_SPANNED_CELL = re.compile(r"""<t[hd](?:(?=[^>]*?\scolspan\s*=\s*["']?\s*(\d{1,9})))?(?:(?=[^>]*?\srowspan\s*=\s*["']?\s*(\d{1,9})))?(?:\s[^>]*)?>""", re.ASCII | re.IGNORECASE)
_HAS_SPAN = re.compile(r"<t[hd]\s[^>]*?(?:col|row)span\s*=", re.ASCII | re.IGNORECASE)
_ROW_MARK, _CELL_MARK, _SPAN_MARK = "\x1e", "\x1f", "\x1d"
# Greatest spans that a table can have (fixed values of the HTML standard).
_MOST_COLUMNS, _MOST_ROWS = 1000, 65534


def extract_link_ids(pages: DataFrame, html: str = "html", pattern: str = fixed.LINK_ID_PATTERN) -> DataFrame:
    """Distinct ids captured by the pattern in any page source."""
    ids = F.explode(F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(1))).alias("link_id")
    return pages.select(ids).distinct()


def extract_page_title(pages: DataFrame, html: str = "html") -> DataFrame:
    return pages.withColumn("title", X.page_title(html))


def is_challenge(html: str | Column) -> Column:
    hit = F.lit(False)
    for marker in fixed.CHALLENGE_MARKERS:
        hit = hit | F.contains(X.col(html), F.lit(marker))
    return hit


def challenge_page_filter(pages: DataFrame, html: str = "html") -> tuple[DataFrame, DataFrame]:
    """(usable pages, bot-challenge pages)."""
    flagged = is_challenge(html)
    return pages.filter(~flagged), pages.filter(flagged)


def _after_first(pieces: Column) -> Column:
    # No array is longer than this; taking the size instead would evaluate `pieces` twice.
    return F.slice(pieces, 2, 1 << 30)


def table_rows(html: str | Column) -> Column:
    """Cell texts of the first table as an array of rows; NULL when its end is missing.

    The table ends at the tag that balances its first one; tables inside it are text of their cell. It is cleaned as one text: rows and
    cells become separator characters, all other tags and blanks single spaces, entities characters. Only then is it cut. A cell that
    spans columns or rows stands in each of them, so that later cells keep their columns.
    """
    return F.arrow_udf(_read_tables, "array<array<string>>")(X.col(html).cast("string"))


def _read_tables(html: pa.Array) -> pa.Array:
    return pa.array([None if page is None else _rows_of(page) for page in html.to_pylist()], pa.list_(pa.list_(pa.string())))


def _rows_of(page: str) -> list[list[str]] | None:
    text = outer_table(page)
    if text is None:
        return None
    for mark in (_ROW_MARK, _CELL_MARK, _SPAN_MARK):
        text = text.replace(mark, " ")
    spans = bool(_HAS_SPAN.search(text))
    text = _ROW.sub(_ROW_MARK, text)
    text = _SPANNED_CELL.sub(_marked, text) if spans else _CELL.sub(_CELL_MARK, text)
    text = X.unescape_text(_BLANK.sub(" ", text))
    rows = [row.split(_CELL_MARK)[1:] for row in text.split(_ROW_MARK)[1:]]
    # A table without spans is its own grid.
    return grid(rows) if spans else [[c.strip(" ") for c in row] for row in rows]


def _marked(cell: re.Match) -> str:
    return f"{_CELL_MARK}{cell[1] or ''}{_SPAN_MARK}{cell[2] or ''}{_SPAN_MARK}"


def _span(text: str, most: int) -> int:
    return min(max(int(text or 1), 1), most)


def grid(rows: list[list[str]]) -> list[list[str]]:
    """Rows of texts from rows of marked cells (colspan, rowspan, text).

    Open row spans (column, text, rows left) are carried from row to row, each row in time of its own cells and open spans. In front of a cell come the
    spans whose column is reached. Where spans overlap, what is pushed aside keeps its old column in mind. Spans that outlast the table give rows of their own.
    """
    out, open_ = [], []
    for cells in rows:
        texts, going, at = [], [], 0
        for cell in cells:
            columns, left, text = cell.split(_SPAN_MARK)
            while at < len(open_) and open_[at][0] <= len(texts):
                going.append(open_[at])
                texts.append(open_[at][1])
                at += 1
            columns, left, text = _span(columns, _MOST_COLUMNS), _span(left, _MOST_ROWS), text.strip(" ")
            if left > 1:
                going += [(len(texts) + i, text, left) for i in range(columns)]
            texts += [text] * columns
        texts += [text for _, text, _ in open_[at:]]
        going += open_[at:]
        open_ = [(c, text, left - 1) for c, text, left in going if left > 1]
        out.append(texts)
    longest = max((left for _, _, left in open_), default=0)
    return out + [[text for _, text, left in open_ if left >= r] for r in range(1, longest + 1)]


def outer_table(page: str) -> str | None:
    """The inside of the first table, without the row and cell tags of inner tables; empty without a table, None when it does not end."""
    depth, texts = 0, []
    pieces = _TABLE.split(page)
    for tag, piece in zip(pieces[1::2], pieces[2::2], strict=True):
        before, depth = depth, max(depth + (-1 if tag.startswith("</") else 1), 0)
        if before and not depth:
            return "".join(texts)
        if depth:
            texts.append(piece if depth == 1 else _CELL.sub(" ", _ROW.sub(" ", piece)))
    return None if any(texts) else ""


def once(c: Column) -> Column:
    """A generator of one value: later expressions read its result instead of repeating it."""
    return F.explode(F.array(c))


def page_log_to_rows(
    pages: DataFrame, team_id: str = "team_id", season: str = "season", html: str = "html"
) -> tuple[DataFrame, DataFrame]:
    """(two-sided rows, rejected pages) of game-log pages with a header row in their first table."""
    ids = [F.col(team_id).alias("team_id"), F.col(season).alias("season")]
    parsed = pages.select(*ids, X.page_title(html).alias("team_name"), once(table_rows(html)).alias("_rows"))
    first = F.coalesce(F.get("_rows", F.lit(0)), F.array())
    names = F.transform(first, lambda c: F.replace(F.lower(c), F.lit(" "), F.lit("_")))
    parsed = parsed.select("*", once(names).alias("_head"))
    wanted = F.array(*[F.lit(c) for c in fixed.PAGE_LOG_COLUMNS])
    places = F.transform(wanted, lambda c: F.array_position("_head", c).cast("int"))
    parsed = parsed.select("team_id", "season", "team_name", "_rows", once(places).alias("_at"))
    absent = F.filter(F.transform(wanted, lambda c, i: F.when(F.get("_at", i) == 0, c)), lambda c: c.isNotNull())
    broken = F.array_contains("_at", 0)
    reason = F.when(F.col("_rows").isNull(), "table without end").when(F.size("_rows") == 0, "no table").otherwise(F.concat(F.lit("missing columns: "), F.array_join(absent, ",")))
    rejects = parsed.filter(broken).select(F.col("team_id").alias(team_id), F.col("season").alias(season), reason.alias("reject_reason"))
    cells = parsed.filter(~broken).select(
        "team_id", "team_name", "season", "_at",
        F.explode(_after_first(F.col("_rows"))).alias("_cells"),
    )
    texts = F.transform("_at", lambda p: F.get("_cells", p - 1))
    cells = cells.select("team_id", "team_name", "season", once(texts).alias("_c"))
    at = {c: F.get("_c", F.lit(i)) for i, c in enumerate(fixed.PAGE_LOG_COLUMNS)}
    body = cells.select("team_id", "team_name", "season", *[F.nullif(v, F.lit("")).alias(f"_{c}") for c, v in at.items()])
    opponent, location = X.split_venue("_opponent")
    winner, loser = X.score_pair("_score")
    rows = body.select(
        "team_id", "team_name", "season", F.col("_date").alias("date"), opponent.alias("opponent"), location.alias("location"),
        F.col("_game").alias("game"), F.col("_result").alias("result"), winner.alias("winner_score"), loser.alias("loser_score"),
        F.col("_ats").alias("ats"), X.to_number("_spread").alias("spread"), F.col("_ou").alias("ou"), X.to_number("_total").alias("total"),
    )
    return rows, rejects


def ratings_page_to_rows(pages: DataFrame, snapshot: str = "snapshot_date", html: str = "html") -> tuple[DataFrame, DataFrame]:
    """(rating rows, rejected pages): rows of at least ten cells, the first ten named, five kept."""
    good, challenged = challenge_page_filter(pages, html)
    parsed = good.select(F.col(snapshot), once(table_rows(html)).alias("_rows"))
    cells = parsed.select(snapshot, F.explode("_rows").alias("_cells")).filter(F.size("_cells") >= 10)
    at = {c: F.get("_cells", F.lit(i)) for i, c in enumerate(fixed.RATINGS_PAGE_COLUMNS)}
    name = at["TeamName"]
    rows = cells.select(
        snapshot,
        F.when(name != "", name).alias("TeamName"),
        *[X.to_number(X.strip_sign(at[c])).alias(c) for c in fixed.RATING_COLUMNS],
    )
    rows = rows.filter(
        F.col("TeamName").isNotNull() & ~F.col("TeamName").isin("Team", "TeamName") & ~F.contains("TeamName", F.lit("Ratings on"))
    )
    cut = parsed.filter(F.col("_rows").isNull()).select(snapshot, F.lit("table without end").alias("reject_reason"))
    return rows, challenged.select(snapshot, F.lit("challenge page").alias("reject_reason")).unionByName(cut)
