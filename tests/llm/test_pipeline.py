"""The pipeline's stages against brute force, each on its own input."""

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from matchline.llm import language, quality, token_ids

from test_near_copies import alnum, brute_contamination, brute_groups


@pytest.fixture(scope="module")
def stages(spark, folder, tmp_path_factory):
    """The rows of `documents` and of every stage."""
    frames = [spark.read.parquet(f"{folder}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / "rows")
        stage(spark, frames[-1], folder).write.parquet(path)
        frames.append(spark.read.parquet(path))
    return frames


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_keep_the_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "quality classifier", "n-gram Jaccard join", "benchmark decontamination", "packing"]
    assert all(df.columns == stages[0].columns for df in stages[1:-1])
    assert all(later.count() <= earlier.count() for earlier, later in zip(stages[:4], stages[1:5]))


def test_language_stage(spark, stages):
    profiles = language.learn(stages[0].where(~language.held_out("doc_id")))
    before = texts(stages[0])
    assert set(texts(stages[1])) == {k for k, t in before.items() if language.judge(t, profiles)[0] != "und"} == {k for k, t in before.items() if t and any(c.isalpha() for c in t)}


def test_quality_stage(spark, folder, stages):
    forest = quality.learn(stages[1], spark.read.parquet(f"{folder}/labels.parquet"))
    before = texts(stages[1])
    scores = forest.score(quality.statistics(pa.array(list(before.values()), pa.string())))
    assert set(texts(stages[2])) == {k for k, s in zip(before, scores) if s >= 0.7} and len(texts(stages[2])) < len(before)


def test_near_copy_stage(stages):
    before = sorted(texts(stages[2]).items())
    assert set(texts(stages[3])) == {key for key, _, least in brute_groups(before, 5, 80, 100) if key == least} and len(texts(stages[3])) < len(before)


def test_decontamination_stage(spark, folder, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    grams = {tuple(w[i : i + 13]) for _, t in items for w in [alnum(t)] for i in range(max(1, len(w) - 12))}
    clean = set()
    for key, text in texts(stages[3]).items():
        w = alnum(text)
        near = any(tuple(w[i : i + 13]) in grams for i in range(len(w))) or any(len(g) < 13 for g in grams)
        n, hit, _ = brute_contamination(text, items) if near else (len(w), 0, [])
        if not (hit and 20 * hit >= n):
            clean.add(key)
    assert set(texts(stages[4])) == clean


def test_packing_stage(stages):
    encoder = token_ids.WordEncoder.open(token_ids.tokenizer_path())
    want = {k: len(encoder.full.encode(t or "", add_special_tokens=False).ids) + 1 for k, t in texts(stages[4]).items()}
    rows = stages[5].collect()
    got, filled = {}, {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        filled[r.sequence_id] = filled.get(r.sequence_id, 0) + r.length
    assert got == want and max(filled.values()) <= 4096
    assert 4096 * len(filled) - sum(filled.values()) < 4096 * 2 * max(1, len({s >> 33 for s in filled}))
    assert np.all([r.doc_tokens == want[r.doc_id] for r in rows])


def test_repeated_and_missing_ids(spark, folder):
    rows = [(1, "a b c d e f g h", "en", "s", 15), (1, "a b c d e f g h", "en", "s", 15), (2, "A B C D E F G H", "en", "s", 15), (None, "x y z", "en", "s", 5), (None, None, None, None, None), (3, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.one_of_a_kind(spark, docs, folder).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept) == [(False, 1, rows[0][1]), (False, 3, ""), (True, 0, ""), (True, 0, "x y z")]
    assert corpus_pipeline.one_of_a_kind(spark, docs.limit(0), folder).count() == 0


def test_kept_texts_are_not_shuffled(spark, folder, tmp_path):
    """One branch of the stage's rows takes no part in a join by row; before, all rows passed one."""
    rows = [(i, " ".join(f"w{i % 90}x{k}" for k in range(30))) for i in range(100)]
    plan = corpus_pipeline.one_of_a_kind(spark, spark.createDataFrame(rows, "doc_id long, text string"), folder)
    plan.write.parquet(str(tmp_path / "rows"))
    assert sorted(r.doc_id for r in spark.read.parquet(str(tmp_path / "rows")).collect()) == list(range(90))
    assert "Union" in plan._jdf.queryExecution().optimizedPlan().toString()


def test_rows_under_one_id_or_none_are_judged_each_by_itself(spark):
    from corpus_pipeline import one_of_a_kind

    a, b, c, d = (" ".join(f"{p}{i}" for i in range(40)) for p in "abcd")
    rows = [(1, a), (2, a + " x"), (2, b), (3, c), (3, d), (None, d + " y"), (None, "n o p q r s"), (None, "n o p q r s"), (4, a)]
    got = one_of_a_kind(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted((r.doc_id or 9, r.text) for r in got) == sorted([(1, a), (2, b), (3, c), (3, d), (9, "n o p q r s")])
