"""Importance resampling against plain loops."""

import hashlib
import math
import random
import re
import zlib

import pytest

from matchline.llm import resampling
from matchline.llm.resampling import Key

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, n_features string, weight string, key string, rank int"


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def features(text, longest):
    w = words_of(text)
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def plain(docs, target, percent, least_words, buckets, longest, seed=2024):
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            for f in features(x, longest):
                counts[zlib.crc32(f.encode()) % buckets] += 1
    gain = [math.floor(1000 * math.log(((b + 1) * (sum(s) + buckets)) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t, strict=True)]
    rows = []
    for doc_id, text in docs:
        f = features(text, longest)
        weight = sum(gain[zlib.crc32(x.encode()) % buckets] for x in f)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(f), weight, score, len(words_of(text)) >= least_words])
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = able[: percent * len(able) // 100]
    ranks = {}
    for i, r in enumerate(drawn):
        ranks.setdefault(tuple(r[:4]), []).append(i + 1)
    out = []
    for r in sorted(rows, key=lambda r: not r[4]):
        at = ranks.get(tuple(r[:4])) if r[4] else None
        out.append((*r[:4], at.pop(0) if at else None))
    return sorted(out, key=repr)


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "x", "y", "z", 5) for i, t in docs], SCHEMA)


def corpus(seed, n):
    rng = random.Random(seed)
    vocab = ["Ab", "cd", "é", "x1", "ÉA", "7", "日本", "q"]
    docs = [(i, rng.choice([" ", "-", "\n"]).join(rng.choices(vocab, k=rng.randrange(12)))) for i in range(n)]
    docs += [(None, "ab cd ab"), (None, "ab cd ab"), (3, "é é"), (3, "é é"), (n, ""), (n + 1, None), (n + 2, "a\x00b\x7fc {x}"), (n + 3, "word " * 5000)]
    return docs


@pytest.mark.parametrize("longest, percent, least", [(1, 10, 2), (2, 50, 1), (3, 100, 0), (1, 1, 20)])
def test_plain_loops(spark, longest, percent, least):
    docs, target = corpus(longest, 60), ["ab AB x1", None, "", "日本 q q"]
    found = resampling.resample(frame(spark, docs).repartition(5), spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int"), percent, least_words=least, buckets=50, longest=longest)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, found.collect()), key=repr) == plain(docs, target, percent, least, 50, longest)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(frame(spark, []), none, 10).count() == 0
    docs = corpus(9, 20)
    found = resampling.resample(frame(spark, docs), none, 30, least_words=1, buckets=20)
    assert sorted(map(tuple, found.collect()), key=repr) == plain(docs, [], 30, 1, 20, 1)
    with pytest.raises(ValueError):
        resampling.resample(frame(spark, docs), none, 101)


def test_every_place_is_met(spark):
    rng = random.Random(4)
    # One score holds a third of all keys, ids repeat, and the partitions differ in size.
    keys = [Key(rng.choice([7, rng.randrange(-50, 50), rng.randrange(-50, 50)]), rng.randrange(20), i) for i in range(300)]
    table = spark.createDataFrame(keys[:200], list(Key._fields)).coalesce(1).union(spark.createDataFrame(keys[200:], list(Key._fields)).repartition(6))
    from matchline.sources.scratch import materialise

    table = materialise(table, "test-keys")
    for place in (1, 2, 77, 150, 299, 300):
        assert resampling.cutoff(table, place, finish=0, rewrite=3) == sorted(keys)[place - 1]
    assert resampling.cutoff(table, 42) == sorted(keys)[41]
    with pytest.raises(ValueError):
        resampling.cutoff(table, 301, finish=0)


def test_rounds_discard_a_quarter(monkeypatch, spark):
    rng = random.Random(8)
    table = spark.createDataFrame([Key(rng.randrange(10**6), i, i) for i in range(4000)], list(Key._fields)).repartition(8)
    from matchline.sources.scratch import materialise

    table, sizes, split = materialise(table, "test-keys"), [], resampling._split

    def counted(keys, pivot):
        sides = split(keys, pivot)
        sizes.append(sum(r.n for r in sides))
        return sides

    monkeypatch.setattr(resampling, "_split", counted)
    resampling.cutoff(table, 400, finish=0)
    # A split reads what the round before kept, and its own pivot is counted on no side.
    assert len(sizes) > 4 and all(b <= 0.76 * a + 1 for a, b in zip(sizes[1:], sizes[2:]))


def test_weighted_median_counts_weights():
    keys = [Key(i, 0, 0) for i in range(4)]
    assert resampling.weighted_median([(keys[3], 1), (keys[0], 5), (keys[1], 1), (keys[2], 2)]) == keys[0]
    assert resampling.weighted_median([(keys[3], 10), (keys[0], 5)]) == keys[3]
