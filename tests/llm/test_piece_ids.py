"""SentencePiece ids and texts against the library."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from matchline.llm import piece_ids, queries, token_ids

PATH = token_ids.tokenizer_path(piece_ids.PIECE_TOKENIZER)
ODD = [
    "Hello  world", " a　b", "ﬁne ﬀ\tx\n y", "▁a ▁", "日本語 😀 語日", "", None, "<s> </s> <unk> <0x41>", "a" * 57, "  lead trail  ", "\x00a\x01", "é é", " ", "   ",
    " " * 40, "\n\n\n", "x" + " " * 15 + "y" + " " * 16 + "z" + " " * 17, "1234567 3.14159", "don't won't 'tis", "�﻿", "𝔘𝔫𝔦", "▁" * 33 + "the", "the" * 20, "word " * 30_000, "ab" * 9_000,
    "=" * 500, "-" * 77 + "=-" * 60, "aAaAaa" * 30, "​x y", "https://www.example.com/a?b=c&d=%20",
]


@pytest.fixture(scope="module")
def model():
    return piece_ids.MergeModel.open(PATH)


def encoded(model, texts):
    offsets, ids = model.encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]


def test_odd_texts(model):
    assert encoded(model, ODD) == model.library.encode([t or "" for t in ODD])


@pytest.mark.parametrize("seed", range(6))
def test_random_texts(model, seed):
    rng = random.Random(seed)
    pieces = [model.text[i] for i in model.spines]
    alphabets = ["ab ", "aeiou nrst", " ▁\n\t1a", "ab日本é😀ﬁ ", "".join(set("".join(rng.choices(pieces, k=40))))]
    texts = ["".join(rng.choices(alphabets[k % 5], k=rng.randrange(1, 120))) for k in range(600)]
    texts += ["".join(rng.choices(pieces, k=rng.randrange(1, 12))) for _ in range(1500)]
    assert encoded(model, texts) == model.library.encode(texts)


def test_whole_documents(model, folder):
    texts = pq.read_table(f"{folder}/documents.parquet", columns=["text"]).column("text").to_pylist()
    assert encoded(model, texts) == model.library.encode([t or "" for t in texts])


def test_pairs_are_compatible_where_merging_keeps_them(model):
    rng = random.Random(2)
    some = rng.sample(sorted(model.spines), 400) + sorted(model.odd)
    for a, b in zip(rng.choices(some, k=4000), rng.choices(some, k=4000)):
        assert model.compatible(a, b) == (model.merge(model.text[a] + model.text[b])[0] == [model.text[a], model.text[b]])


def test_each_prefix_has_one_last_token(model):
    for text in ["▁internationalisation", "▁▁▁▁▁▁the", "aaaaaaaaaaaa", "▁don't"]:
        part = text
        table = model.last_tokens(part)
        for end, (token, length) in enumerate(table):
            pieces = model.merge(part[: end + 1])[0]
            assert model.text[token] == pieces[-1] and length == len(pieces[-1])


def test_random_ids_decode_as_in_the_library(model):
    rng = random.Random(7)
    texts = piece_ids.PieceTexts.open(PATH)
    pools = [range(model.size), range(0, 262), [0, 1, 2, 28705, 259, 264, *range(195, 262)], [int(i) for i in model.bytes[192:]] + [int(i) for i in model.bytes[128:192]] * 2 + [1, 264]]
    rows = [[rng.choice(pools[k % 4]) for _ in range(rng.randrange(12))] for k in range(3000)] + [[int(b) for b in model.bytes["x語😀é".encode()[k]].reshape(-1)] for k in range(3)]
    offsets = np.cumsum([0] + [len(r) for r in rows])
    found = texts.decode(offsets, np.array([i for r in rows for i in r], np.int64)).to_pylist()
    assert found == [model.library.decode(r) for r in rows]
    with pytest.raises(ValueError):
        texts.decode(np.array([0, 1]), np.array([32_000]))


def test_full_caches_change_nothing(model, monkeypatch):
    monkeypatch.setattr(piece_ids, "CACHED_PARTS", 3)
    monkeypatch.setattr(piece_ids, "CACHED_PAIRS", 5)
    for _ in range(3):
        assert encoded(model, ODD[:12]) == model.library.encode([t or "" for t in ODD[:12]])


def test_frames(spark):
    rows = [(i, t, "x", i) for i, t in enumerate(ODD)] + [(3, ODD[0], "y", 1), (3, ODD[0], "y", 1), (None, "tail", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, start int")
    library = piece_ids.MergeModel.open(PATH).library
    found = piece_ids.decode(piece_ids.encode(docs.repartition(3), PATH), PATH, out="back")
    assert found.columns == ["doc_id", "text", "ids", "start", "back"]
    got = sorted(((r.doc_id, r.text, r.ids, r.start, r.back) for r in found.collect()), key=repr)
    expected = [(i, t, ids := library.encode(t or ""), n, library.decode(ids)) for i, t, _, n in rows]
    assert got == sorted(expected, key=repr)
    assert piece_ids.decode(piece_ids.encode(docs.limit(0), PATH), PATH).count() == 0
    none = spark.createDataFrame([(1, None), (2, []), (3, [264, 264])], "k int, ids array<int>")
    assert sorted(tuple(r) for r in piece_ids.decode(none, PATH).select("k", "text").collect()) == [(1, ""), (2, ""), (3, "a a")]


def test_slices_of_ids(monkeypatch):
    monkeypatch.setattr(piece_ids, "SLICE_IDS", 4)
    batch = pa.RecordBatch.from_pydict({"ids": pa.array([[1, 2], None, [3] * 9, [], [4, 5], [6, 7], [8]], pa.list_(pa.int32()))}).slice(1)
    parts = list(piece_ids._id_slices(batch, "ids"))
    assert [p.num_rows for p, _, _ in parts] == [1, 1, 3, 1]
    assert [x for _, o, f in parts for x in (f[a:b].tolist() for a, b in zip(o, o[1:]))] == [[], [3] * 9, [], [4, 5], [6, 7], [8]]


def test_query_holds_the_rows_of_the_library(spark, folder):
    import hashlib

    library = piece_ids.MergeModel.open(PATH).library
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = set()
    for r in pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pylist():
        ids = library.encode(r["text"] or "")
        expected.add((r["doc_id"], len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids))))
    assert {tuple(r) for r in queries.op11_piece_ids(spark, folder).collect()} == expected
