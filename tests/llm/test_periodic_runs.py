"""Periodic runs against a plain scan of all lags."""

import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchline.llm import periodic_runs, queries

SCHEMA = "doc_id long, text string, runs int, periodic string, start string, n string"


def plain(w, least=24, times=3):
    """All runs by trying every lag; a run whose stretch has a smaller period is not one of this lag."""
    out = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, times * q) and not any(all(w[k] == w[k + p] for k in range(i, i + length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def texts(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        size = rng.choice([1, 2, 3, 5, 40])
        w = [str(rng.randrange(size)) for _ in range(rng.randrange(80))]
        for _ in range(rng.randrange(4)):
            p = [str(rng.randrange(size + 1)) for _ in range(rng.randrange(1, 14))]
            k = rng.randrange(2, 9)
            part = (p * k)[: rng.randrange(len(p) * k) + 1]
            at = rng.randrange(len(w) + 1)
            w[at:at] = part
        yield w


@pytest.mark.parametrize("seed, least, times", [(1, 24, 3), (2, 24, 3), (3, 1, 3), (4, 9, 4), (5, 6, 3)])
def test_runs_are_those_of_all_lags(seed, least, times):
    docs = list(texts(seed, 150))
    codes = np.array([int(x) for w in docs for x in w], np.int64)
    offsets = np.cumsum([0] + [len(w) for w in docs])
    of, rows = periodic_runs.runs_of(offsets, codes, least, times)
    found = [[] for _ in docs]
    for d, r in zip(of.tolist(), rows.tolist(), strict=True):
        found[d].append(tuple(r))
    assert found == [plain(w, least, times) for w in docs]
    kept = periodic_runs.kept_words(offsets, of, rows)
    assert [" ".join(x for x, k in zip(w, kept[a:]) if k) for w, a in zip(docs, offsets)] == [collapsed(w, r) for w, r in zip(docs, found)]


def test_splitting_changes_no_run():
    for w in texts(6, 200):
        at, codes = np.arange(len(w)), np.array([int(x) for x in w] + [0], np.int64)
        whole = periodic_runs.scan_lags(at, codes)
        for rounds in (0, 1, 64):
            assert (periodic_runs.scan_lags(periodic_runs.split_by_frequency(at, codes, rounds=rounds), codes) == whole).all()


def test_words_split_again_in_their_part():
    # Two of the three 7s fall off with the 9, so the last one is rare in its part; the 1s alone are too short.
    codes = np.array([7, 7, 9, *[1] * 10, 7, *[2] * 30])
    assert periodic_runs.split_by_frequency(np.arange(len(codes)), codes).tolist() == list(range(14, 44))


def test_long_texts_are_not_quadratic():
    rng = np.random.default_rng(0)
    for codes in (np.zeros(400_000, np.int64), np.tile(rng.integers(0, 50, 130_000), 3), rng.integers(0, 2, 300_000), np.tile([0, 0, 1], 100_000)):
        of, rows = periodic_runs.runs_of(np.array([0, len(codes)]), codes)
        for start, length, q in rows[rows[:, 1] > 1000].tolist():
            assert (codes[start : start + length - q] == codes[start + q : start + length]).all()
        assert len(rows) or codes.max() == 1
    assert (rows == [[0, 300_000, 3]]).all()


def test_edge_rows(spark):
    line = "a b  c\td\x0be "
    rows = [(1, line * 6), (1, line * 6), (2, None), (3, ""), (4, " \n\t "), (None, "x " * 24), (5, "x " * 23), (6, "é\xa0z　 " * 30), (7, "A a " * 12), (8, "w " * 200_000), (9, "p q r s " * 8 + "t " * 40)]
    docs = spark.createDataFrame([(i, t, 1, "x", "y", "z") for i, t in rows], SCHEMA)
    found = periodic_runs.with_runs(docs.repartition(3))
    assert found.columns == docs.columns
    got = sorted(((r.doc_id, r.text, r.periodic.collapsed, [tuple(x) for x in r.periodic.runs]) for r in found.collect()), key=repr)
    expected = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = plain(w) if len(w) < 1000 else [(0, len(w), 1)]
        expected.append((i, t, collapsed(w, runs), runs))
    assert got == sorted(expected, key=repr)
    assert periodic_runs.with_runs(docs.limit(0)).count() == 0
    best = found.select("doc_id", periodic_runs.strongest(F.col("periodic.runs")).alias("b")).collect()
    by_id = {i: r for i, _, _, r in got}
    for r in best:
        runs = by_id[r.doc_id]
        assert (tuple(r.b) if r.b else None) == (max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2])) if runs else None)
    with pytest.raises(ValueError):
        periodic_runs.with_runs(docs, times=2)


def test_query_on_a_small_fixture(spark, tmp_path):
    import hashlib
    import zlib

    rng = random.Random(3)
    docs = [(i, " ".join(rng.choices("abcdefghij", k=rng.randrange(90)))) for i in range(150)] + [(1000, None), (1001, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect()}
    planted = 0
    for i, t in docs:
        w = (t or "").split()
        h = zlib.crc32(str(i).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = plain(w)
        planted += bool(runs)
        r = found[i]
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r.n_runs, r.runs_sha256, r.collapsed_sha256) == (len(runs), digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(collapsed(w, runs)))
        best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2])) if runs else (None,) * 3
        assert (r.start, r.length, r.period) == best and r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
    assert planted > 3
