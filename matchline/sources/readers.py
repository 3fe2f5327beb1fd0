"""Scans of landed files. Schemas are declared or string; nothing is inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import fixed
from ..operators import cleaning
from ..operators.joins import lookup_join
from .scratch import materialise

_NUMERIC = {"winner_score", "loser_score", "spread", "total"}


_CSV = {"escape": '"', "mode": "PERMISSIVE"}
_END = "\x02"


def scan_csv(spark: SparkSession, path: str | Sequence[str], **from_file: Column) -> DataFrame:
    """CSV files with a header line, read once; columns go by name, whatever their order in a file, and are NULL where a file lacks them.

    Lines land once in the shared folder. A file's header is its first line, which lies in the block that starts at 0; every line is parsed by position and meets its
    file's header by a lookup of one row per file. `reject_reason` says where a line has more or fewer cells than its header (such lines are kept,
    missing cells are NULL; a quote that does not close counts as too many), else NULL. Of repeated names the first counts, and a column without a name is _c and its place. `from_file`
    adds columns made from a file's metadata. Only the distinct column names reach the driver.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), *[c.alias(n) for n, c in from_file.items()])
    lines = materialise(lines.filter(F.trim("value") != "").withColumn("_place", F.monotonically_increasing_id()), "csv-lines")
    first = lines.filter("_start = 0").groupBy("_file").agg(F.min_by("value", "_place").alias("_line"), F.min("_place").alias("_head_at"))
    # As many cells as any header has commas, one more, and one for the mark behind the last cell, whose place tells how many there are.
    width = (first.agg(F.max(F.length(F.regexp_replace("_line", "[^,]", "")))).first()[0] or 0) + 3
    schema = ", ".join(f"c{i} string" for i in range(width))
    cells = lambda line: F.from_csv(F.concat(line, F.lit("," + _END)), schema, _CSV)
    listed = lambda c: F.array(*[F.col(c)[f"c{i}"] for i in range(width)])
    first = first.withColumn("_s", cells(F.regexp_replace("_line", "^\ufeff", ""))).select("_file", "_head_at", listed("_s").alias("_h"))
    heads = F.slice("_h", F.lit(1), F.greatest(F.array_position("_h", _END).cast("int") - 1, F.lit(0)))
    names = F.transform(heads, lambda n, i: F.coalesce(F.nullif(F.trim(n), F.lit("")), F.concat(F.lit("_c"), i.cast("string"))))
    first = first.select("_file", "_head_at", names.alias("_names"))
    known = first.select(F.posexplode("_names").alias("at", "name")).groupBy("name").agg(F.min("at").alias("at")).orderBy("at", "name").collect()
    # Names are looked up once per file; a line meets their places.
    places = [F.array_position("_names", r.name).cast("int") for r in known]
    first = first.select("_file", "_head_at", F.size("_names").alias("_size"), F.array(*places).alias("_places"))
    rows = lookup_join(lines, first, ["_file"]).filter(F.col("_place") != F.col("_head_at"))
    rows = rows.withColumn("_s", cells(F.col("value"))).select(*from_file, "_size", "_places", listed("_s").alias("_c"))
    at, size = F.array_position("_c", _END), F.col("_size")
    place = lambda i: F.get("_places", F.lit(i))
    values = [F.when((at == 0) | (place(i) < at), F.get("_c", place(i) - 1)).alias(r.name) for i, r in enumerate(known)]
    reason = F.when((at == 0) | (at - 1 > size), "too many cells").when(at - 1 < size, "too few cells")
    return rows.select(*values, *from_file, reason.alias("reject_reason"))


def _csv(spark: SparkSession, path: str | Sequence[str], **from_file: Column) -> DataFrame:
    return scan_csv(spark, path, **from_file).drop("reject_reason")


def read_team_rows(spark: SparkSession, path: str) -> DataFrame:
    """Two-sided rows of all matching CSV files, declared columns only, with their file name."""
    raw = _csv(spark, path, file=F.col("_metadata.file_name"))
    typed = [
        X.to_number(c).alias(c) if c in _NUMERIC else X.to_number(c).cast("bigint").alias(c) if c == "team_id" else F.col(c)
        for c in fixed.TEAM_ROW_COLUMNS
    ]
    return raw.select(*typed, "file")


def _from_path(pattern: str):
    return F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)


def read_dated_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Rating snapshots; the date is the last YYYY-MM-DD in the file's path."""
    dated = _csv(spark, path, snapshot_date=F.try_to_date(_from_path(r".*(\d{4}-\d{2}-\d{2}).*\.csv$"), "yyyy-MM-dd"))
    return cleaning.coerce_numeric(cleaning.drop_unnamed(dated), fixed.RATING_COLUMNS + fixed.RANK_COLUMNS)


def read_season_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Season-level ratings (file or folder ends in YYYY): they know the season's end, so rows are leaky."""
    season = _from_path(r".*\D(\d{4})(?:\.csv|/[^/]*\.csv)$").try_cast("int")
    tagged = _csv(spark, path, season=season).withColumn("is_leaky", F.lit(True))
    return cleaning.coerce_numeric(cleaning.drop_unnamed(tagged), fixed.RATING_COLUMNS + fixed.RANK_COLUMNS)


def _missing(error: AnalysisException) -> bool:
    return (error.getCondition() or "") == "PATH_NOT_FOUND"


def read_snapshots(spark: SparkSession, folder: str) -> tuple[DataFrame, str]:
    """(ratings, 'daily' or 'season'): dated files when there are any, season files otherwise.

    An empty folder raises.
    """
    try:
        return read_dated_snapshots(spark, f"{folder}/*[0-9][0-9][0-9][0-9]-[0-9][0-9]-[0-9][0-9].csv"), "daily"
    except AnalysisException as e:
        if not _missing(e):
            raise
    try:
        return read_season_snapshots(spark, f"{folder}/*[!0-9-][0-9][0-9][0-9][0-9].csv"), "season"
    except AnalysisException as e:
        if _missing(e):
            raise FileNotFoundError(f"no rating files in {folder}") from e
        raise


def read_optional(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """The Parquet tables that exist, by name."""
    out = {}
    for name, path in paths.items():
        try:
            out[name] = spark.read.parquet(path)
        except AnalysisException as e:
            if not _missing(e):
                raise
    return out


def read_scored(spark: SparkSession, path: str, features: Sequence[str]) -> DataFrame:
    """Only the metadata and model columns of a feature table; the scan skips the rest."""
    df = spark.read.parquet(path)
    return df.select(*X.present(df, list(dict.fromkeys([*fixed.SCORED_METADATA, *features]))))


def read_name_map(spark: SparkSession, *paths: str) -> DataFrame:
    """(raw_name, canonical_name) from the first file that exists, under either header form."""
    for path in paths:
        try:
            df = _csv(spark, path)
        except AnalysisException as e:
            if _missing(e):
                continue
            raise
        raw = cleaning.first_available(df, "raw_name", "team_name")
        target = cleaning.first_available(df, "canonical_name", "kenpom_name")
        return df.select(F.col(raw).alias("raw_name"), F.col(target).alias("canonical_name"))
    return spark.createDataFrame([], "raw_name string, canonical_name string")


def read_odds(spark: SparkSession, path: str) -> DataFrame:
    """Odds documents: one JSON object per match."""
    from ..operators.odds import BOOKMAKERS

    schema = f"id string, commence_time timestamp, home_team string, away_team string, bookmakers {BOOKMAKERS}"
    return spark.read.schema(schema).option("multiLine", False).json(path)


def union_by_name(*frames: DataFrame) -> DataFrame:
    """Stack frames by column name; a column some lack is NULL there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
