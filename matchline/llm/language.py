"""Language ID by rank-order profiles of letter n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words

#: n-grams of a profile, and the distance of one that a language does not have.
PROFILE = 400
#: Languages a model may know; the model holds PROFILE n-grams of each.
MOST_LANGUAGES = 1000
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def grams(text: str) -> np.ndarray:
    """Codes of all 1- to 3-grams of the lower-cased letters; other runs are one space, which may stand at an edge of a gram only."""
    chars = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    chars = np.where(_letters()[chars], chars, 0)
    chars = chars[(chars > 0) | np.concatenate([[True], chars[:-1] > 0])]
    one, two, three = chars, chars[:-1] << 21 | chars[1:], chars[:-2] << 42 | chars[1:-1] << 21 | chars[2:]
    solid = (chars[1:-1] > 0) & ((chars[:-2] > 0) | (chars[2:] > 0)) if len(chars) > 2 else np.zeros(0, bool)
    return np.concatenate([one[one > 0], two, three[solid]]) if len(chars) > 1 else np.zeros(0, np.int64)


def ranked(codes: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent codes, ties by the lower code."""
    found, counts = np.unique(codes, return_counts=True)
    if len(found) > 4 * most:
        least = np.partition(counts, -most)[-most]
        found, counts = found[counts >= least], counts[counts >= least]
    return found[np.lexsort((found, -counts))][:most]


class Profiles(NamedTuple):
    languages: list[str]
    codes: np.ndarray  # sorted
    ranks: np.ndarray  # one row per code, one column per language; PROFILE: not there


def held_out(key: str) -> Column:
    """Rows kept from learning."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> Profiles:
    """Profiles of all languages from all given rows with a text and a language. n-grams are counted per task and summed in Spark;
    PROFILE rows per language reach the driver. More than MOST_LANGUAGES languages are an error."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.byte_slices(batch, "text"):
                by: dict[str, list] = {}
                for name, t in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                    by.setdefault(name, []).append(t)
                for name, texts in by.items():
                    code, n = np.unique(np.concatenate([grams(t) for t in texts]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(code), pa.string()), pa.array(code), pa.array(n)], names=["lang", "code", "n"])

    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).dropna()
    summed = rows.mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "code"))
    top = summed.withColumn("rank", place - 1).where(F.col("rank") < PROFILE).select("lang", "code", "rank").limit(MOST_LANGUAGES * PROFILE + 1).collect()
    languages = sorted({r.lang for r in top})
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    codes = np.unique(np.array([r.code for r in top], np.int64))
    ranks = np.full((len(codes), len(languages)), PROFILE, np.int64)
    if top:
        ranks[np.searchsorted(codes, [r.code for r in top]), [languages.index(r.lang) for r in top]] = [r["rank"] for r in top]
    return Profiles(languages, codes, ranks)


def judge(text: str | None, p: Profiles) -> tuple[str, float]:
    """Language and score: 1 - the least out-of-place distance as a share of the greatest possible; ties go to the first language."""
    own = ranked(grams(text)) if text else np.zeros(0, np.int64)
    if not len(own) or not p.languages:
        return UNKNOWN, 0.0
    place = np.minimum(np.searchsorted(p.codes, own), len(p.codes) - 1)
    ranks = np.where((p.codes[place] == own)[:, None], p.ranks[place], PROFILE)
    far = np.where(ranks == PROFILE, PROFILE, np.abs(ranks - np.arange(len(own))[:, None])).sum(axis=0)
    best = int(far.argmin())
    return p.languages[best], 1.0 - float(far[best]) / (PROFILE * len(own))


def predict(docs: DataFrame, profiles: Profiles, text: str = "text", lang_pred: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """All rows and columns with the two new ones, which replace columns of these names. NULL texts and texts without a letter are `und`
    with score 0, as is everything when no language was learned. Repeated rows are judged alike."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    rows = docs.withColumns({lang_pred: F.lit(None).cast("string"), score: F.lit(None).cast("double")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.byte_slices(batch, text):
                found = [judge(t, shared.value) for t in part.column(text).to_pylist()]
                new = {lang_pred: pa.array([f[0] for f in found], pa.string()), score: pa.array([f[1] for f in found], pa.float64())}
                yield pa.RecordBatch.from_arrays([new.get(n, part.column(n)) for n in part.schema.names], names=part.schema.names)

    return rows.mapInArrow(run, rows.schema)
