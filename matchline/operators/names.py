"""Entity-name resolution.

Every stage is an equality lookup. Prefix matching becomes one by indexing the prefixes of the
target names, aggregated per index key before the join. Containment goes through an index of
suffixes led by a few characters, and what it finds is verified. Shared words are matched through
the rarest words of a name, so a hot word joins nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import fixed
from ..sources.scratch import materialise
from .joins import lookup_join

# How many index rows a name may yield, for the size check of the lookup.
PREFIX_GROWTH = 200


def name_table(spark, pairs: dict[str, str], raw: str = "raw_name", canonical: str = "canonical_name") -> DataFrame:
    return spark.createDataFrame(list(pairs.items()), f"{raw} string, {canonical} string")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def _prefixes(c: Column) -> Column:
    return F.when(F.length(c) > 0, F.transform(F.sequence(F.lit(1), F.length(c)), lambda n: F.substring(c, F.lit(1), n)))


def prefix_index(names: DataFrame, name: str) -> DataFrame:
    """(prefix, match, n): how many distinct names start with each prefix, ignoring case."""
    out = names.select(F.col(name).alias("match")).distinct()
    out = out.select("match", F.explode(_prefixes(F.lower("match"))).alias("prefix"))
    return out.groupBy("prefix").agg(F.min("match").alias("match"), F.count("*").alias("n"))


def prefix_theta_join(raw: DataFrame, canonical: DataFrame, raw_name: str = "raw_name", name: str = "canonical_name") -> DataFrame:
    """Raw names whose first word starts exactly one canonical name."""
    probes = raw.select(raw_name).distinct().withColumn("prefix", F.get(X.words(F.lower(raw_name)), F.lit(0)))
    hits = lookup_join(probes, prefix_index(canonical, name), ["prefix"], growth=PREFIX_GROWTH)
    return hits.filter("n = 1").select(raw_name, F.col("match").alias(name))


def _stage(df: DataFrame, stage: int, key: Column, value: Column) -> DataFrame:
    return df.select(F.lit(stage).alias("stage_no"), key.alias("key"), value.alias("match"))


STAGES = {1: "mapped", 2: "exact", 3: "school", 4: "st_to_state", 5: "state_to_st", 6: "first_word"}


def resolve_names_staged(
    raw: DataFrame,
    canonical: DataFrame,
    known: DataFrame | None = None,
    overrides: DataFrame | None = None,
    raw_name: str = "raw_name",
    name: str = "canonical_name",
) -> DataFrame:
    """(raw_name, canonical_name, stage) for every distinct raw name; NULLs when nothing fits.

    Stages: known table (overrides first, only if the target exists), exact, without the last
    word, 'St.' and 'State' exchanged, unique first-word prefix. Equal keys go to the first name
    in order.
    """
    spark = raw.sparkSession
    known = name_table(spark, fixed.KNOWN_NAMES) if known is None else known
    targets = canonical.select(F.col(name).alias("match")).filter(F.col("match").isNotNull()).distinct()
    m, low = F.col("match"), F.lower("match")
    table = known.select(F.col(known.columns[0]).alias("key"), F.col(known.columns[1]).alias("match"), F.lit(1).alias("_p"))
    if overrides is not None:
        extra = overrides.select(
            F.col(overrides.columns[0]).alias("key"), F.col(overrides.columns[1]).alias("match"), F.lit(0).alias("_p")
        )
        table = table.unionByName(extra)
    table = table.join(targets, "match", "left_semi")
    table = table.groupBy("key").agg(F.min(F.struct("_p", "match")).alias("_b")).select("key", F.col("_b.match").alias("match"))
    stages = [
        _stage(table, 1, F.col("key"), m),
        _stage(targets, 2, m, m),
        _stage(targets, 3, low, m),
        _stage(targets, 4, F.lower(F.replace(m, F.lit(" St."), F.lit(" State"))), m),
        _stage(targets, 5, F.lower(F.replace(m, F.lit(" State"), F.lit(" St."))), m),
        _stage(prefix_index(targets, "match").filter("n = 1"), 6, F.col("prefix"), m),
    ]
    index = _union(stages).groupBy("stage_no", "key").agg(F.min("match").alias("match"))
    r = F.col(raw_name)
    school = F.lower(X.drop_last_word(raw_name))
    first = F.get(X.words(F.lower(raw_name)), F.lit(0))
    probe = lambda n, k: F.struct(F.lit(n).alias("stage_no"), k.alias("key"))
    names = raw.select(raw_name).filter(r.isNotNull()).distinct()
    probes = names.select(
        raw_name,
        F.inline(F.array(probe(1, r), probe(2, r), probe(3, school), probe(4, school), probe(5, school), probe(6, first))),
    )
    hits = lookup_join(probes, index, ["stage_no", "key"], growth=PREFIX_GROWTH)
    best = hits.groupBy(raw_name).agg(
        F.min(F.when(F.col("match").isNotNull(), F.struct("stage_no", "match"))).alias("_b")
    )
    label = F.lit(None).cast("string")
    for n, text in STAGES.items():
        label = F.when(F.col("_b.stage_no") == n, text).otherwise(label)
    return best.select(raw_name, F.col("_b.match").alias(name), label.alias("stage"))


def school_table(rows: DataFrame) -> DataFrame:
    """(team_id, full, school, n_words): lower-case full name and name without the last word."""
    t = rows.groupBy("team_id").agg(F.min("team_name").alias("team_name"))
    return t.select(
        "team_id",
        F.lower("team_name").alias("full"),
        F.lower(X.drop_last_word("team_name")).alias("school"),
        F.size(X.words("team_name")).alias("n_words"),
    )


#: Characters that lead an entry of the suffix index.
GRAM = 4
# How an index entry names its team: full name, school name, whole containment, leading words, fragment.
_FULL, _SCHOOL, _WHOLE, _HEAD, _INNER = 1, 2, 3, 4, 5
_SCORES = {_WHOLE: 100, _HEAD: 90, _INNER: 50}


def _grams(s: str) -> Column:
    """The strings of GRAM characters in a text and where they start, as (gram, at)."""
    at = F.when(F.length(s) >= GRAM, F.sequence(F.lit(1), F.length(s) - (GRAM - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(F.substring(F.col(s), i, F.lit(GRAM)).alias("gram"), i.alias("at")))


def _short_fragments(s: Column) -> Column:
    """What a text shorter than GRAM can match in a name, as (key, rank): parts, leading words, the whole name."""
    size = F.length(s)
    starts = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
    cut = lambda n: F.transform(F.filter(starts, lambda i: i <= size - (n - 1)), lambda i: F.substring(s, i, F.lit(n)))
    entry = lambda key, rank: F.struct(key.alias("key"), F.lit(rank).alias("rank"))
    inner = F.transform(F.array_distinct(F.concat(*[cut(n) for n in range(1, GRAM)])), lambda p: entry(p, _INNER))
    spaces = F.filter(F.sequence(F.lit(1), F.lit(GRAM - 1)), lambda i: F.substring(s, i + 1, F.lit(1)) == " ")
    heads = F.transform(spaces, lambda i: entry(F.substring(s, F.lit(1), i), _HEAD))
    whole = F.when(size < GRAM, F.array(entry(s, _WHOLE))).otherwise(F.array().cast("array<struct<key:string,rank:int>>"))
    return F.concat(inner, heads, whole)


def _best_entry(entries: DataFrame) -> DataFrame:
    """(key, rank, n, team_id): the strongest kind of entry per key and the team it stands for.

    A clash of full names goes to the highest id, every other one to the lowest.
    """
    out = entries.groupBy("key", "rank").agg(
        F.count("*").alias("n"), F.min("team_id").alias("_lo"), F.max("team_id").alias("_hi")
    )
    team = F.when(F.col("rank") == _FULL, F.col("_hi")).otherwise(F.col("_lo"))
    out = out.select("key", "rank", "n", team.alias("team_id"))
    return out.groupBy("key").agg(F.min(F.struct("rank", "n", "team_id")).alias("_b")).select("key", "_b.*")


def suffix_index(schools: DataFrame) -> DataFrame:
    """(team_id, gram, at): every suffix of every school name, led by its first GRAM characters; one short row per character of a name."""
    return schools.select("team_id", F.inline(_grams("school")))


def _contained(keys: DataFrame, schools: DataFrame) -> DataFrame:
    """(key, rank, n, team_id): how each text lies in school names at best, in how many, and the lowest such team.

    A text of GRAM characters or more looks its rarest gram up in the suffix index, and what is found is verified: the name must go on with the
    whole text from there. Shorter texts meet an index of all short parts.
    """
    index = suffix_index(schools)
    held = index.groupBy("gram").agg(F.count("*").alias("_n"))
    asked = keys.filter(F.length("key") >= GRAM).select("key", F.inline(_grams("key"))).join(held, "gram", "left")
    lead = asked.groupBy("key").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("at").alias("place"), "gram")).alias("_l"))
    lead = lead.filter("_l.n > 0").select("key", "_l.place", "_l.gram")  # a text with an unknown gram lies nowhere
    found = lead.join(index, "gram").withColumn("start", F.col("at") - F.col("place") + 1).filter("start > 0")
    found = lookup_join(found.select("key", "team_id", "start"), schools.select("team_id", "school"), ["team_id"])
    rest = F.substring("school", F.col("start"), F.length("school"))
    found = found.filter(F.startswith(rest, F.col("key")))
    leads = (F.col("start") == 1) & (F.substring(rest, F.length("key") + 1, F.lit(1)) == " ")
    rank = F.when(F.col("school") == F.col("key"), _WHOLE).when(leads, _HEAD).otherwise(_INNER)
    long_ = found.groupBy("key", "team_id").agg(F.min(rank).alias("rank")).select("key", "rank", "team_id")
    short = _best_entry(schools.select("team_id", F.inline(_short_fragments(F.col("school")))))
    brief = lookup_join(keys.filter(F.length("key") < GRAM), short, ["key"], growth=PREFIX_GROWTH).filter(F.col("rank").isNotNull())
    return _best_entry(long_).unionByName(brief.select("key", "rank", "n", "team_id"))


def containment_theta_join(opponents: DataFrame, schools: DataFrame, opponent: str = "opponent") -> DataFrame:
    """(opponent, team_id, score) where one team has the uniquely best containment score.

    100 the whole school name, 90 its leading words, 50 any part of it. `schools` has one row per team_id.
    """
    probes = materialise(opponents.select(opponent).distinct().withColumn("key", X.normalise_key(opponent)), "probes")
    found = _contained(probes.select("key").filter(F.col("key").isNotNull()).distinct(), materialise(schools.select("team_id", "school"), "schools"))
    hits = probes.join(found, "key").filter((F.col("rank") == _WHOLE) | (F.col("n") == 1))
    score = F.lit(None).cast("int")
    for rank, value in _SCORES.items():
        score = F.when(F.col("rank") == rank, value).otherwise(score)
    return hits.select(opponent, "team_id", score.alias("score"))


def resolve_opponent_ids(rows: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """(opponent, opponent_team_id) for each distinct opponent text that resolves.

    Overrides win when their target is a known name, then full names (highest id on a clash), then
    school names (lowest id), then a unique best containment. Two passes over the rows, one for
    the teams and one for the opponent texts; both small tables are written once, since each kind of match reads them.
    """
    overrides = fixed.OPPONENT_OVERRIDES if overrides is None else overrides
    entry = lambda key, rank: F.struct(F.col(key).alias("key"), F.lit(rank).alias("rank"))
    teams = materialise(school_table(rows), "schools")
    named = teams.filter("n_words >= 2").select("team_id", F.inline(F.array(entry("full", _FULL), entry("school", _SCHOOL))))
    key = X.normalise_key("opponent")
    texts = materialise(rows.select("opponent").filter(F.col("opponent").isNotNull()).distinct().withColumn("key", key), "opponents")
    if overrides:
        table = F.create_map(*[F.lit(x) for pair in overrides.items() for x in pair])
        forced = F.try_element_at(table, F.col("key"))
    else:
        forced = F.lit(None).cast("string")
    tries = F.array(F.struct(F.lit(0).alias("_try"), forced.alias("key")), F.struct(F.lit(1).alias("_try"), F.col("key").alias("key")))
    sure = lookup_join(texts.select("opponent", F.inline(tries)), _best_entry(named), ["key"]).filter(F.col("rank").isNotNull())
    sure = sure.select("opponent", F.struct("_try", "rank", "team_id").alias("_h"))
    part = _contained(texts.select("key").distinct(), teams).filter((F.col("rank") == _WHOLE) | (F.col("n") == 1))
    part = texts.join(part, "key").select("opponent", F.struct(F.lit(1).alias("_try"), "rank", "team_id").alias("_h"))
    best = sure.unionByName(part).groupBy("opponent").agg(F.min("_h").alias("_b"))
    return best.select("opponent", F.col("_b.team_id").alias("opponent_team_id"))


def _word_set(c: str) -> Column:
    return F.array_sort(F.array_distinct(X.words(F.lower(c))))


def token_overlap_join(raw: DataFrame, canonical: DataFrame, raw_name: str = "raw_name", name: str = "canonical_name") -> DataFrame:
    """(raw_name, canonical_name, overlap): the canonical name sharing most words, first name on ties.

    A raw name's known words are ordered from rare to frequent. The names that hold its rarest word give a lower bound on the best overlap; a
    name that shares `best` of its `n` words must hold one of the n - best + 1 rarest, so only these are joined and the overlap is counted on
    the few names found. An overlap of one needs no pairs at all: the first name of each word is known. The hottest word of a name
    is never joined, and all names take this path.
    """
    left = raw.select(raw_name).filter(F.col(raw_name).isNotNull()).distinct().withColumn("_ws", _word_set(raw_name))
    right = canonical.select(F.col(name).alias("match")).filter(F.col("match").isNotNull()).distinct().withColumn("_cs", _word_set("match"))
    postings = right.select("match", F.explode("_cs").alias("_w"))
    known = postings.groupBy("_w").agg(F.count("*").alias("_n"), F.min("match").alias("_first"))
    found = lookup_join(left.select(raw_name, F.explode("_ws").alias("_w")), known, ["_w"]).filter(F.col("_n").isNotNull())
    by_name = found.groupBy(raw_name).agg(F.array_sort(F.collect_list(F.struct("_n", "_w"))).alias("_rare"), F.min("_first").alias("_first"))  # the words of one name

    def overlaps(probes: DataFrame) -> DataFrame:
        pairs = probes.join(postings, "_w").select(raw_name, "match").distinct()
        shared = pairs.join(left, raw_name).join(right, "match")
        return shared.select(raw_name, "match", F.size(F.array_intersect("_ws", "_cs")).alias("overlap"))

    rarest = by_name.select(raw_name, F.get("_rare", F.lit(0))["_w"].alias("_w"))
    least = overlaps(rarest).groupBy(raw_name).agg(F.max("overlap").alias("_least"))
    wanted = F.size("_rare") - F.greatest(F.col("_least"), F.lit(2)) + 1
    probes = by_name.join(least, raw_name).filter(wanted > 0).select(raw_name, F.explode(F.slice("_rare", F.lit(1), wanted)).alias("_r")).select(raw_name, "_r._w")
    many = overlaps(probes).select(raw_name, F.struct((-F.col("overlap")).alias("_neg"), "match").alias("_b"))
    one = by_name.select(raw_name, F.struct(F.lit(-1).alias("_neg"), F.col("_first").alias("match")).alias("_b"))
    best = many.unionByName(one).groupBy(raw_name).agg(F.min("_b").alias("_b"))
    return best.select(raw_name, F.col("_b.match").alias(name), (-F.col("_b._neg")).alias("overlap"))


def resolve_by_overlap(
    raw: DataFrame, canonical: DataFrame, mapping: DataFrame, raw_name: str = "raw_name", name: str = "canonical_name"
) -> DataFrame:
    """(raw_name, canonical_name, stage): exact, mapped, case-insensitive, then most shared words."""
    names = raw.select(raw_name).filter(F.col(raw_name).isNotNull()).distinct()
    targets = canonical.select(F.col(name).alias("match")).filter(F.col("match").isNotNull()).distinct()
    mapped = mapping.select(F.col(mapping.columns[0]).alias("key"), F.col(mapping.columns[1]).alias("match")).filter(
        F.col("match").isNotNull()
    )
    index = _union(
        [
            _stage(targets, 1, F.col("match"), F.col("match")),
            _stage(mapped, 2, F.col("key"), F.col("match")),
            _stage(targets, 3, F.lower("match"), F.col("match")),
        ]
    )
    index = index.groupBy("stage_no", "key").agg(F.min("match").alias("match"))
    r = F.col(raw_name)
    probe = lambda n, k: F.struct(F.lit(n).alias("stage_no"), k.alias("key"))
    probes = names.select(raw_name, F.inline(F.array(probe(1, r), probe(2, r), probe(3, F.lower(r)))))
    direct = lookup_join(probes, index, ["stage_no", "key"]).groupBy(raw_name).agg(
        F.min(F.when(F.col("match").isNotNull(), F.struct("stage_no", "match"))).alias("_b")
    )
    overlap = token_overlap_join(names, canonical, raw_name, name).select(raw_name, F.col(name).alias("_o"))
    out = direct.join(overlap, raw_name, "left")
    stage = (
        F.when(F.col("_b.stage_no") == 1, "exact")
        .when(F.col("_b.stage_no") == 2, "mapped")
        .when(F.col("_b.stage_no") == 3, "case")
        .when(F.col("_o").isNotNull(), "overlap")
    )
    return out.select(raw_name, F.coalesce("_b.match", "_o").alias(name), stage.alias("stage"))


def name_map_report(resolved: DataFrame, raw_name: str = "raw_name", name: str = "canonical_name") -> DataFrame:
    """The map file: every raw name with its canonical name and a note."""
    note = F.when(F.col(name).isNotNull(), fixed.AUTO_NOTE).otherwise(fixed.UNMAPPED_NOTE)
    return resolved.select(raw_name, name, note.alias("notes"))


def name_map_coverage(report: DataFrame, name: str = "canonical_name") -> DataFrame:
    out = report.agg(F.count("*").alias("total_names"), F.count(name).alias("mapped_names"))
    return out.withColumn("mapped_pct", F.col("mapped_names") * 100 / F.col("total_names").cast("double"))
