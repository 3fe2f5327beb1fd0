"""Token ids, packing and token files."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from matchline.llm import packing, token_files, token_ids, words

PATH = token_ids.tokenizer_path()
ODD = [
    "it's, they're. THE,' 'rest, a.'s don't! x'll,", "É ÉCOLE éa", "İstanbul ΑΣ. Σ", "áb é.", "", None, "  \n ", "a\x0bb c d 12,3 ½ x²",
    "<|endoftext|> hi<|endoftext|>,you", "日本語 テキスト", "a\x1cb\x85c", "A.B.C co-op e.g., \x00x", "n'T 'S I'M", "a̸.b≠ x.́y", "word " * 6000,
]


def ids_of(text):
    return token_ids.WordEncoder.open(PATH).full.encode(text or "", add_special_tokens=False).ids


def test_words_give_the_ids_of_whole_texts():
    encoder = token_ids.WordEncoder.open(PATH)
    alphabet = "ab éÉß'.,!<|>12 \n\tſḰ̸"
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choices(alphabet, k=rng.randrange(40))) for _ in range(400)]
    for group in (texts, [t for t in texts if "<|" not in (t or "")]):
        offsets, ids = encoder.encode(pa.array(group, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [ids_of(t) for t in group]


def test_slices_hold_all_rows():
    batch = pa.RecordBatch.from_pydict({"t": ["a" * n for n in (5, 0, 30, 1, 2)] + [None]})
    parts = list(words.byte_slices(batch, "t", 6))
    assert [p.num_rows for p in parts] == [2, 1, 3] and pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    assert list(words.byte_slices(batch.slice(0, 0), "t")) == []


def greedy(lengths, capacity, cost):
    """The packing rule word by word."""
    count = -(-sum(lengths) // capacity)
    seqs = [[0.0, capacity] for _ in range(count)]
    out, full = [], 0
    for d, n in enumerate(lengths):
        for s in range(0, n - n % capacity, capacity):
            out.append((d, s, capacity, full, 0))
            seqs[full] = [cost(capacity), 0]
            full += 1
    for d in sorted(range(len(lengths)), key=lambda d: (-(lengths[d] % capacity), d)):
        left, start = lengths[d] % capacity, lengths[d] - lengths[d] % capacity
        while left:
            fits = [(s[0], i) for i, s in enumerate(seqs) if s[1] >= left and s[1]] or [(s[0], i) for i, s in enumerate(seqs) if s[1]]
            at = min(fits)[1]
            n = min(left, seqs[at][1])
            out.append((d, start, n, at, capacity - seqs[at][1]))
            seqs[at][0] += cost(n)
            seqs[at][1] -= n
            left, start = left - n, start + n
            if left and n == 0:
                raise AssertionError
    return out, count


@pytest.mark.parametrize("seed", range(8))
def test_assign_is_the_greedy_rule(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([0, 1, 3, 16, 17, 40, rng.randrange(60)]) for _ in range(rng.randrange(1, 40))]
    pieces, count = packing.assign(lengths, 16, 1.0, 0.5)
    expected, n = greedy(lengths, 16, lambda k: k + 0.5 * k * k)
    assert count == n and [tuple(p) for p in pieces.tolist()] == expected


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, part int, start string, key string, sequence_id string")


def test_pack_edge_rows(spark):
    rows = [(i, t, 1, "x", "y", "z") for i, t in enumerate(ODD)] + [(3, ODD[0], 1, "x", "y", "z"), (None, "tail", 1, "x", "y", "z")] * 2
    found = packing.pack(frame(spark, rows).repartition(3), PATH, capacity=64, group_tokens=500).collect()
    by_sequence, by_doc = {}, {}
    for r in found:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 64
    total = sum(len(ids_of(r[1])) + 1 for r in rows)
    assert sum(r.length for r in found) == total and len(by_sequence) <= total // 64 + 12
    for doc_id in (0, 1, 4, 5, 14):
        ids = np.array([*ids_of(ODD[doc_id]), 2], "<u4")
        for r in by_doc[doc_id]:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length]) and r.doc_tokens == len(ids)
    assert packing.pack(frame(spark, []), PATH).count() == 0


@pytest.mark.parametrize("ids", [[], [5], [5, 5], [5] * 9, [1, 2] * 20, [1, 2, 3] * 50 + [9] * 31])
def test_grammar_round_trip(ids):
    ids = np.array(ids, np.uint16)
    cut = len(ids) // 3
    block = token_files.Block(token_files.block_bytes(np.array([cut, 0, len(ids) - cut]), ids, 10))
    assert (block.all_ids() == ids).all() and (block.document(0) == ids[:cut]).all() and not len(block.document(1)) and (block.document(2) == ids[cut:]).all()


def test_grammar_is_shorter_and_random_access_is_exact():
    rng = np.random.default_rng(1)
    ids = rng.zipf(1.3, 30_000).clip(max=900).astype(np.uint16)
    counts = np.full(100, 300)
    block = token_files.Block(token_files.block_bytes(counts, ids, 1000))
    assert len(block.symbols) < 0.8 * len(ids) and (block.all_ids() == ids).all()
    assert all((block.document(i) == ids[300 * i : 300 * i + 300]).all() for i in range(100))
    assert (block.lengths == block.span[block.left] + block.span[block.right]).all()


def test_files_read_back(spark, tmp_path):
    rows = [(i, t, 1, "x", "y", "z") for i, t in enumerate(ODD)] + [(7, ODD[7], 1, "x", "y", "z"), (None, "no key", 1, "x", "y", "z")]
    path = str(tmp_path / "tokens")
    token_files.write(frame(spark, rows).repartition(4), path, PATH, block_tokens=50)
    found = sorted(token_files.read(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == [None, *sorted([*range(len(ODD)), 7])]
    at = 0
    for r in found:
        ids = np.array([*ids_of("no key" if r.doc_id is None else ODD[r.doc_id]), 1], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids))
        at += len(ids)
    token_files.write(frame(spark, []), path + "0", PATH)
    assert token_files.read(spark, path + "0").count() == 0


def test_copies_become_a_few_symbols():
    rng = np.random.default_rng(3)
    one = rng.integers(0, 50_000, 400)
    ids = np.concatenate([one] * 1000)
    payload = token_files.block_bytes(np.full(1000, 400), ids, 60_000)
    block = token_files.Block(payload)
    assert len(block.symbols) < 1000 and (block.all_ids() == ids).all() and (block.document(500) == one).all()
    wide = token_files.Block(token_files.block_bytes(np.array([len(ids)]), ids, 70_000))
    assert (wide.all_ids() == ids).all()
