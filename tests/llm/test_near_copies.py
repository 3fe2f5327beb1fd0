"""N-gram join, components, decontamination and sharding against brute force."""

import itertools
import random
import re

import numpy as np
import pytest

from matchline.llm import components, decontamination, ngram_join, sharding
from pyspark.sql import functions as F


def word_list(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def shingle_set(text, size):
    w = word_list(text)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute_groups(docs, size, num, den):
    sets = [shingle_set(t, size) for _, t in docs]
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * len(sets[i] | sets[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (key, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), key), key)
    return sorted((key, len(sets[i]), least[find(i)]) for i, (key, _) in enumerate(docs))


def copies(seed, vocabulary, n=60):
    rng = random.Random(seed)
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 6, 7, 8, 20, 60, 300]))] for _ in range(n // 5)]
    docs = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        docs.append((i, (" " if seed % 2 else "\n").join(w)))
    return docs + [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "A B c"), (n + 4, "a b C"), (n + 5, "x " * 9000)]


@pytest.mark.parametrize("seed,size,num,den", [(1, 4, 85, 100), (2, 5, 80, 100)])
def test_groups_are_those_of_all_pairs(spark, seed, size, num, den):
    docs = copies(seed, [f"w{i}" for i in range(400)])
    df = spark.createDataFrame([(i, t, "a", 1) for i, t in docs], "doc_id long, text string, class string, n int").repartition(3)
    got = ngram_join.similar_groups(df, size=size, num=num, den=den)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_groups(docs, size, num, den)


def test_large_group_is_joined_before_all_pairs_are_met(spark, monkeypatch):
    """4 of 14 words are left out: only texts that lack 3 of the same words link, so few leaders link to a text, and the first of them to a few."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    docs = [(i, " ".join(w for k, w in enumerate(base) if k not in gone)) for i, gone in enumerate(rng.sample(list(itertools.combinations(range(10, 150, 10), 4)), 300))]
    met, check = [], ngram_join.check

    def counted(pairs, *more):
        met.append(pairs.count())
        return check(pairs, *more)

    monkeypatch.setattr(ngram_join, "check", counted)
    got = ngram_join.similar_groups(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), size=4, num=85, den=100)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_groups(docs, 4, 85, 100)
    assert max(met) <= len(docs) and met[-1] < len(docs) // 10, met


def test_texts_that_only_share_a_passage_are_not_shuffled(spark, monkeypatch):
    docs = [(i, " ".join([f"a{i}x{k}" for k in range(10)] + [f"p{i // 4}x{k}" for k in range(8)] + [f"z{i}x{k}" for k in range(40)])) for i in range(12)]
    docs += [(12, docs[0][1].replace("a0x0 ", "")), (13, None)]
    read, check = [], ngram_join.check

    def counted(pairs, texts, *more):
        read.append(texts.count())
        return check(pairs, texts, *more)

    monkeypatch.setattr(ngram_join, "check", counted)
    for turns in (0, 1):
        read.clear()
        got = ngram_join.similar_groups(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), size=4, num=85, den=100, leader_turns=turns)
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_groups(docs, 4, 85, 100)
    assert read[0] <= 5 and read[1] == 0, read


def test_only_texts_of_pairs_that_may_link_are_read(spark, monkeypatch):
    """Four of five sets that share a passage hold nothing else in common; a posting with one pair that may link does not bring in the others' texts."""
    docs = [(i, " ".join([f"a{i}x{k}" for k in range(10)] + [f"p{k}" for k in range(8)] + [f"z{i}x{k}" for k in range(40)])) for i in range(4)]
    docs += [(4, docs[0][1].replace("a0x0 ", "")), (5, docs[1][1])]
    read, check = [], ngram_join.check

    def counted(pairs, texts, *more):
        read.append(texts.count())
        return check(pairs, texts, *more)

    monkeypatch.setattr(ngram_join, "check", counted)
    got = ngram_join.similar_groups(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), size=4, num=85, den=100, leader_turns=1)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_groups(docs, 4, 85, 100)
    assert read == [2, 0], read


def test_pairs_of_small_postings_are_held_once(spark):
    """Both sets stand together in 50 postings, in the core of both; a pair that differs too much in length is none."""
    rows = [(sig, c, n, True, n, 3) for sig in range(50) for c, n in ((1, 100), (2, 98), (3, 10))]
    got = ngram_join._small_pairs(spark.createDataFrame(rows, "sig long, class long, n int, core boolean, rest int, m long"), 80, 100)
    assert [(r.a, r.b, r.x_n, r.y_n) for r in got.collect()] == [(1, 2, 100, 98)]


def test_marks_miss_no_key(spark):
    rows = spark.range(5000).select(F.when(F.col("id") != 7, F.col("id") * 2**33).alias("k"), F.lit("t").alias("t"))
    keys = rows.where(F.col("k").isNull() | (F.col("k") % (3 * 2**33) == 0)).select("k")
    got = ngram_join.with_marks(rows, keys, "k")
    wanted = {r.k for r in keys.collect()}
    marked = {r.k for r in got.where("_marked").collect()}
    assert got.columns == ["k", "t", "_marked"] and got.count() == 5000 and wanted <= marked and len(marked) <= len(wanted) + 20
    assert ngram_join.with_marks(rows, keys.limit(0), "k").where("_marked").count() == 0


def test_no_rows_and_no_words(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.similar_groups(empty).count() == 0
    blank = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, " ")], "doc_id long, text string")
    assert sorted(map(str, (tuple(r) for r in ngram_join.similar_groups(blank).collect()))) == ["(1, 0, 1, 1)", "(2, 0, 2, 2)", "(2, 0, 2, 2)", "(None, 0, None, None)"]


@pytest.mark.parametrize("seed", range(30))
def test_similar_sets_always_share_a_signature(seed):
    rng = np.random.default_rng(seed)
    universe = rng.integers(0, 2**63, 6000).astype(np.uint64)
    rarity = rng.integers(0, 80, 6000).astype(np.uint8) if seed % 3 else np.full(6000, 60, np.uint8)
    n = int(rng.choice([6, 7, 8, 12, 40, 63, 64, 130, 700, 3000]))
    a = rng.choice(6000, n, replace=False)
    for _ in range(20):
        gone = rng.integers(0, n - -(-n * 85 // 100) + 1)
        keep = rng.permutation(a)[gone:]
        new = rng.choice(np.setdiff1d(np.arange(6000), a), rng.integers(0, max(1, len(keep) * 100 // 85 - n) + 1), replace=False)
        b = np.concatenate([keep, new])
        if 100 * len(keep) >= 85 * (n + len(new)):
            sides = [ngram_join.signatures(universe[x], rarity[x], 85, 100) for x in sorted((a, b), key=len)]
            rest = [dict(zip(s.tolist(), left.tolist())) for s, _, left in sides]
            core = set(sides[0][0][sides[0][1]].tolist()) | (set(sides[1][0][sides[1][1]].tolist()) if len(a) == len(b) else set())
            enough = [s for s in core & rest[0].keys() & rest[1].keys() if min(rest[0][s], rest[1][s]) * 185 >= 85 * (n + len(b))]
            assert enough


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(7, 7), (5, 4)]
    label = {x: x for e in edges for x in e}
    for _ in range(len(label)):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in label.items() if any(k in e and e[0] != e[1] for e in edges)}


def alnum(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_contamination(text, items):
    w = alnum(text)
    hit, found = set(), set()
    for item, t in items:
        own = alnum(t)
        m = min(13, len(own))
        for k in range(len(own) - m + 1) if m else ():
            for i in range(len(w) - m + 1):
                if w[i : i + m] == own[k : k + m]:
                    hit |= set(range(i, i + m))
                    found.add(item)
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [1 << 22, 200])
def test_contamination(spark, block_bytes):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(12)] + ["é", "日本"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i, n in enumerate([1, 2, 3, 12, 13, 14, 30, 30])] + [(8, None), (9, "!!"), (6, "w1 W2 w3"), (10, "W1, w2; w3")]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60)))) for i in range(30)]
    docs += [(30, items[6][1].upper() + "..."), (31, "x " + items[7][1][3:] + " y"), (32, None), (33, ""), (34, "?!"), (35, "a b " * 5000 + items[4][1])]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, contamination int")
    got = decontamination.contamination(df, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes)
    assert got.columns == ["doc_id", "text", "contamination"]
    for r in got.collect():
        c = r.contamination
        assert (c.n_words, c.n_hit, sorted(c["items"])) == brute_contamination(r.text, items), r.doc_id
    none = decontamination.contamination(df, spark.createDataFrame([], "item_id long, text string"))
    assert none.where("contamination.n_hit > 0").count() == 0 and none.count() == len(docs)


def test_shards(spark):
    keys = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("shard")).union(spark.createDataFrame([(None, "y"), (5, "z")], "doc_id long, shard string"))
    eight = {(r.doc_id): r.shard for r in sharding.with_shards(keys).collect()}
    nine = {(r.doc_id): r.shard for r in sharding.with_shards(keys, weights=(1.0,) * 9).collect()}
    assert all(nine[k] in (eight[k], 8) for k in eight) and 300 < sum(s == 8 for s in nine.values()) < 600
    heavy = sharding.with_shards(keys, weights=(1.0, 3.0)).groupBy("shard").count().collect()
    assert abs(next(r["count"] for r in heavy if r.shard == 1) / 4002 - 0.75) < 0.03
    slots = sharding.with_slots(sharding.with_shards(keys), "shard", ["doc_id"], slice_rows=300).collect()
    for s in range(8):
        own = sorted((r for r in slots if r.shard == s), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        ids = [-1 if r.doc_id is None else r.doc_id for r in own]
        assert ids == sorted(ids)
    assert sharding.with_slots(sharding.with_shards(keys.limit(0)), "shard", ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        sharding.with_shards(keys, weights=(1.0, 0.0))
