"""Column expressions shared by the operators. Everything here stays inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_if_nan(c: str | Column) -> Column:
    """NaN becomes NULL: Spark orders NaN above every number, so it must not reach a comparison."""
    return F.nanvl(col(c), F.lit(None).cast("double"))


def to_number(c: str | Column) -> Column:
    """Tolerant numeric cast: signs and blanks are fine, anything else is NULL."""
    c = col(c).cast("string")
    # Java also reads "12d" and "12f" as numbers; a data file never means that.
    plain = F.when(~c.rlike(r"[0-9.][dDfF]\s*$"), c)
    return null_if_nan(plain.try_cast("double"))


def strip(c: str | Column) -> Column:
    """Trim every kind of blank, not only spaces."""
    return F.btrim(col(c), F.lit(" \t\n\r\f\x0b"))


def strip_sign(c: str | Column) -> Column:
    return F.regexp_replace(col(c), r"\+", "")


def parse_event_date(c: str | Column, fmt: str = fixed.EVENT_DATE_FORMAT) -> Column:
    return F.try_to_date(col(c), fmt)


def normalise_key(c: str | Column) -> Column:
    return F.lower(strip(c))


def normalise_name(c: str | Column) -> Column:
    c = F.lower(strip(c))
    c = F.replace(c, F.lit("st."), F.lit("state"))
    c = F.replace(c, F.lit("&"), F.lit("and"))
    return F.regexp_replace(c, r"\s+", " ")


def words(c: str | Column) -> Column:
    """Whitespace-separated words, no empty ones."""
    return F.filter(F.split(col(c), r"\s+"), lambda w: w != "")


def drop_last_word(c: str | Column) -> Column:
    """Everything before the last word; a single word is kept."""
    w = words(c)
    return F.when(F.size(w) >= 2, F.array_join(F.slice(w, 1, F.size(w) - 1), " ")).otherwise(col(c))


def strip_trailing_ordinal(c: str | Column) -> Column:
    return F.regexp_replace(col(c), r" \d+$", "")


def own_score(result: str | Column, winner: str | Column, loser: str | Column) -> Column:
    """Score of the row's own entity: any result other than W counts as a loss."""
    return F.when(col(result) == "W", col(winner)).otherwise(col(loser))


def opponent_score(result: str | Column, winner: str | Column, loser: str | Column) -> Column:
    return F.when(col(result) == "W", col(loser)).otherwise(col(winner))


def season_start(d: str | Column) -> Column:
    d = col(d)
    return F.when(F.month(d) >= 10, F.year(d)).otherwise(F.year(d) - 1)


def season_label_of_year(start: str | Column) -> Column:
    start = col(start)
    return F.concat_ws("-", start.cast("string"), F.lpad(((start + 1) % 100).cast("string"), 2, "0"))


def season_label(d: str | Column) -> Column:
    """October opens a season: 2024-10-01 and 2025-04-01 are both 2024-25."""
    return F.when(col(d).isNotNull(), season_label_of_year(season_start(d)))


def season_number(c: str | Column) -> Column:
    """Season label or number to the closing year: '2021-22' and 2022 are both 2022."""
    c = col(c).cast("string")
    first = F.split(c, "-")[0].try_cast("int")
    return F.when(F.contains(c, F.lit("-")), first + 1).otherwise(first)


def match_key(d: str | Column, left: str | Column, right: str | Column) -> Column:
    """Order-free key of a match, NULL when any part is missing."""
    d, left, right = col(d), col(left), col(right)
    key = F.concat_ws(
        "|", F.date_format(d, "yyyy-MM-dd"), F.least(left, right).cast("string"), F.greatest(left, right).cast("string")
    )
    return F.when(d.isNotNull() & left.isNotNull() & right.isNotNull(), key)


def sign_label(c: Column) -> Column:
    """1 above zero, 0 below, 0.5 at zero, NULL when unknown."""
    return (F.signum(null_if_nan(c.cast("double"))) + 1.0) / 2.0


def label_cover(margin: str | Column, line: str | Column) -> Column:
    return sign_label(col(margin) + col(line))


def label_win(margin: str | Column) -> Column:
    return sign_label(col(margin))


def label_over(total: str | Column, line: str | Column) -> Column:
    return sign_label(col(total) - col(line))


def venue_flags(is_neutral: str | Column) -> tuple[Column, Column]:
    """(is_home_a, is_neutral) as integers."""
    neutral = col(is_neutral).cast("boolean")
    return (~neutral).cast("int"), neutral.cast("int")


def venue_adjusted(raw: str | Column, is_home: str | Column, is_neutral: str | Column) -> Column:
    """Add the venue points to the home side and take them away from a visitor."""
    points = F.lit(fixed.VENUE_POINTS)
    away = F.lit(1) - col(is_home) - col(is_neutral)
    return col(raw) + (col(is_home) * points - away * points)


def split_venue(raw: str | Column) -> tuple[Column, Column]:
    """(opponent, location) of a schedule cell: '@X' is Away, 'vs X' is Home, anything else Neutral."""
    s = strip(F.coalesce(col(raw), F.lit("")))
    away = F.startswith(s, F.lit("@"))
    home = F.startswith(F.lower(s), F.lit("vs "))
    opponent = (
        F.when(away, strip(F.regexp_replace(s, "^@+", "")))
        .when(home, strip(F.regexp_replace(s, "^.{3}", "")))
        .otherwise(s)
    )
    return opponent, F.when(away, "Away").when(home, "Home").otherwise("Neutral")


def score_pair(raw: str | Column) -> tuple[Column, Column]:
    """(winner score, loser score) of 'a - b', NULLs when the text is not a score."""
    a = F.regexp_extract(col(raw), fixed.SCORE_PATTERN, 1).try_cast("int")
    b = F.regexp_extract(col(raw), fixed.SCORE_PATTERN, 2).try_cast("int")
    both = a.isNotNull() & b.isNotNull()
    return F.when(both, F.greatest(a, b)), F.when(both, F.least(a, b))


# The ampersand last, so nothing is decoded twice.
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def unescape(c: str | Column) -> Column:
    """Decode the common character entities."""
    c = col(c)
    for entity, text in _ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(text))
    return c


def unescape_text(text: str) -> str:
    """The same on a Python text."""
    for entity, plain in _ENTITIES:
        text = text.replace(entity, plain)
    return text


def page_title(html: str | Column) -> Column:
    """Title text up to the first ' - '; 'Unknown Team' when there is none."""
    raw = F.regexp_extract(col(html), r"(?is)<title[^>]*>(.*?)</title>", 1)
    title = strip(F.split(strip(unescape(raw)), " - ")[0])
    return F.when(title == "", "Unknown Team").otherwise(title)


def round6(c: str | Column) -> Column:
    """Six decimals for reports; the added zero turns -0.0 into 0.0."""
    return F.round(col(c), 6) + F.lit(0.0)


def present(df: DataFrame, names: list[str]) -> list[str]:
    """The listed columns the frame has, in list order (plan time only, no job)."""
    have = set(df.columns)
    return [n for n in names if n in have]
