"""Token files: ids of documents in key order, compressed by a grammar of repeated pairs (Re-Pair), readable at random.

A file holds blocks of whole documents. Layout of a block, little-endian:
8 bytes magic, then 6 uint32 (documents, tokens, terminals, rules, symbols, bytes per symbol), then uint32 arrays: the ids that occur in the block, in order (terminal
i is the i-th of them), tokens of each document, left and right of each rule, expansion length of each rule, and the symbols (of three bytes: the low two of all, then
the high one of all). Rule k is the symbol `terminals + k`; its sides are smaller symbols.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import token_ids, words

MAGIC = b"PAIRTOK2"
END_ID = 1
#: Tokens of a block (a single longer document is a block of its own).
BLOCK_TOKENS = 2 << 20
#: Each replacement round takes the most frequent pairs of the block at once; rounds go on while a pair saves bytes.
PAIRS_PER_ROUND = 5000
#: A rule takes two sides and a length.
RULE_BYTES = 12
_BUCKET_BITS = 20
_SPREAD = np.uint64(0x9E3779B97F4A7C15)

BLOCKS = "part int, block int, n_docs long, n_tokens long, keys array<bigint>, payload binary"
TOKENS = "part int, block int, doc_id long, inside long, n_tokens long, ids_crc32 long"


class Grammar(NamedTuple):
    symbols: np.ndarray
    left: np.ndarray
    right: np.ndarray
    lengths: np.ndarray


def _pairs(a: np.ndarray, b: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of symbols as one number each, of 32 bits while symbols fit into 16, and their hash buckets."""
    if symbols <= 1 << 16:
        pairs = (a << np.uint32(16)) | b
        return pairs, ((pairs * np.uint32(0x9E3779B1)) >> np.uint32(32 - _BUCKET_BITS)).astype(np.int32)
    pairs = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
    return pairs, ((pairs * _SPREAD) >> np.uint64(64 - _BUCKET_BITS)).astype(np.int32)


def _frequent(pairs: np.ndarray, bucket: np.ndarray, pairs_per_round: int, least_count: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent pairs, most frequent first, and how often they occur."""
    filled = np.bincount(bucket, minlength=1 << _BUCKET_BITS)
    # A pair occurs at most as often as its bucket is filled, so only the fullest buckets can hold the most frequent pairs.
    least = max(least_count, int(np.partition(filled, -pairs_per_round)[-pairs_per_round]))
    for low in dict.fromkeys((least, least_count)):  # the fullest buckets may hold rare pairs only
        found, counts = np.unique(pairs[(filled >= low)[bucket]], return_counts=True)
        order = np.lexsort((found, -counts))[:pairs_per_round]
        order = order[counts[order] >= least_count]
        if len(order):
            break
    return found[order], counts[order]


def compress(ids: np.ndarray, terminals: int, rounds: int | None = None, pairs_per_round: int = PAIRS_PER_ROUND) -> Grammar:
    """Replace frequent adjacent pairs by new symbols, round by round until none saves bytes (or for so many `rounds`); where chosen pairs overlap, the left one is taken.

    A rule costs RULE_BYTES, and an occurrence saves one symbol. The rules that would make all symbols wider than two bytes are taken only
    if the round saves more than that costs.
    """
    seq = ids.astype(np.uint32)
    left, right, lengths, known = [], [], [], terminals
    last = False
    for _ in count() if rounds is None else range(rounds):
        if len(seq) < 2 or last:
            break
        pairs, bucket = _pairs(seq[:-1], seq[1:], known)
        width = 2 if known <= 1 << 16 else 3
        chosen, counts = _frequent(pairs, bucket, pairs_per_round, RULE_BYTES // width + 1)
        free = (1 << 16) - known
        if width == 2 and len(chosen) > free and 3 * int(counts[free:].sum()) - RULE_BYTES * (len(chosen) - free) <= len(seq) - int(counts.sum()):
            chosen, last = chosen[:free], True
        if not len(chosen):
            break
        shift, mask = (np.uint32(16), np.uint32(0xFFFF)) if width == 2 else (np.uint64(32), np.uint64(0xFFFFFFFF))
        a, b = (chosen >> shift).astype(np.uint32), (chosen & mask).astype(np.uint32)
        _, at = _pairs(a, b, known)
        at, first = np.unique(at, return_index=True)  # one pair of a bucket a round: the most frequent
        chosen, a, b = chosen[first], a[first].astype(np.int64), b[first].astype(np.int64)
        rule = np.full(1 << _BUCKET_BITS, -1, np.int32)
        rule[at] = np.arange(len(chosen), dtype=np.int32)
        hits = np.flatnonzero((rule >= 0)[bucket])
        hits = hits[chosen[rule[bucket[hits]]] == pairs[hits]]
        new_run = np.concatenate([[True], np.diff(hits) > 1])
        run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(hits)), 0))
        hits = hits[(np.arange(len(hits)) - run_start) % 2 == 0]
        seq[hits] = (known + rule[bucket[hits]]).astype(np.uint32)
        keep = np.ones(len(seq), bool)
        keep[hits + 1] = False
        seq = seq[keep]
        before = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
        span = lambda s: np.where(s < terminals, 1, before[np.maximum(s - terminals, 0)]) if len(before) else np.ones(len(s), np.int64)
        left.append(a), right.append(b), lengths.append(span(a) + span(b))
        known += len(chosen)
    joined = [np.concatenate(x).astype("<u4") if x else np.zeros(0, "<u4") for x in (left, right, lengths)]
    return Grammar(seq.astype("<u2" if known <= 1 << 16 else "<u4"), *joined)


class Block:
    """A block opened for reading. Rules are expanded once; `document` decodes only the symbols that cover one document."""

    def __init__(self, payload: bytes):
        if payload[:8] != MAGIC:
            raise ValueError("not a token block")
        docs, self.n_tokens, self.terminals, rules, symbols, width = np.frombuffer(payload, "<u4", 6, 8).tolist()
        arrays = np.frombuffer(payload, "<u4", self.terminals + docs + 3 * rules, 32)
        self.alphabet, arrays = arrays[: self.terminals].astype(np.int64), arrays[self.terminals :]
        self.doc_tokens = arrays[:docs].astype(np.int64)
        self.ends = np.cumsum(self.doc_tokens)
        self.left, self.right, self.lengths = arrays[docs:].reshape(3, rules).astype(np.int64)
        at = 32 + 4 * (self.terminals + docs + 3 * rules)
        self.symbols = np.frombuffer(payload, "<u4" if width == 4 else "<u2", symbols, at)
        if width == 3:
            self.symbols = self.symbols | np.frombuffer(payload, "u1", symbols, at + 2 * symbols).astype("<u4") << 16
        self._expand_rules()
        self.symbol_ends = np.cumsum(self.span[self.symbols])

    def _expand_rules(self) -> None:
        """Expansions of all symbols in one array; a rule is expanded as soon as both sides are."""
        self.span = np.concatenate([np.ones(self.terminals, np.int64), self.lengths])
        self.start = np.arange(len(self.span))
        size = done = self.terminals
        table = self.alphabet
        while done < len(self.span):
            highest = np.maximum(self.left, self.right)[done - self.terminals :]
            waits = np.flatnonzero(highest >= done)
            stop = done + (int(waits[0]) if len(waits) else len(highest))
            rules = slice(done - self.terminals, stop - self.terminals)
            sides = np.stack([self.left[rules], self.right[rules]], 1).ravel()
            new = table[words.ragged(self.start[sides], self.span[sides])]
            self.start[done:stop] = size + np.cumsum(self.lengths[rules]) - self.lengths[rules]
            table = np.concatenate([table, new])
            size, done = size + len(new), stop
        self.table = table

    def all_ids(self) -> np.ndarray:
        return self.table[words.ragged(self.start[self.symbols], self.span[self.symbols])]

    def document(self, i: int) -> np.ndarray:
        first, last = int(self.ends[i] - self.doc_tokens[i]), int(self.ends[i])
        a, b = np.searchsorted(self.symbol_ends, first, "right"), np.searchsorted(self.symbol_ends, last, "left") + 1
        ids = self.table[words.ragged(self.start[self.symbols[a:b]], self.span[self.symbols[a:b]])]
        skip = first - (int(self.symbol_ends[a - 1]) if a else 0)
        return ids[skip : skip + last - first]


def block_bytes(doc_tokens: np.ndarray, ids: np.ndarray, vocabulary: int, **how) -> bytes:
    """A block of documents with ids below `vocabulary`. Ids are numbered densely first, which leaves most of the two-byte symbols to rules."""
    occurs = np.bincount(ids, minlength=vocabulary) > 0
    alphabet, terminals = np.flatnonzero(occurs), int(occurs.sum())
    g = compress((np.cumsum(occurs) - 1)[ids], terminals, **how)
    wide = g.symbols.itemsize == 4 and terminals + len(g.left) <= 1 << 24
    symbols = (g.symbols & 0xFFFF).astype("<u2").tobytes() + (g.symbols >> 16).astype("u1").tobytes() if wide else g.symbols.tobytes()
    head = np.array([len(doc_tokens), len(ids), terminals, len(g.left), len(g.symbols), 3 if wide else g.symbols.itemsize], "<u4")
    return b"".join([MAGIC, head.tobytes(), alphabet.astype("<u4").tobytes(), np.asarray(doc_tokens, "<u4").tobytes(), g.left.tobytes(), g.right.tobytes(), g.lengths.tobytes(), symbols])


def write(docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> None:
    """Write all documents in ascending key order (NULL first, equal keys in any order) as block rows of Parquet files below `path`.

    Rows are dealt by ranges of the key and a running number, so a key that repeats spreads over ranges. A NULL or empty text is the end id
    alone; repeated rows are written as often as they occur; an empty table gives no block. Other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = token_ids.WordEncoder.open(tokenizer)
        vocabulary, held, held_tokens, block, part = len(encoder.ends_word), [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, held_tokens, block
            counts = np.concatenate([c for _, c, _ in held])
            ids = np.concatenate([i for _, _, i in held])
            keys = [k for ks, _, _ in held for k in ks]
            row = [[part], [block], [len(keys)], [len(ids)], [keys], [block_bytes(counts, ids, vocabulary)]]
            held, held_tokens, block = [], 0, block + 1
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()), strict=True)], names=["part", "block", "n_docs", "n_tokens", "keys", "payload"])

        for batch in batches:
            if batch.num_rows:
                part = batch.column(2)[0].as_py()
            for rows in words.byte_slices(batch, "text"):
                offsets, ids = encoder.encode(rows.column("text"))
                ids = np.insert(ids, offsets[1:], end_id)
                held.append((rows.column("key").to_pylist(), np.diff(offsets) + 1, ids))
                held_tokens += len(ids)
                if held_tokens >= block_tokens:
                    yield flush()
        if held:
            yield flush()

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).withColumn("tie", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange("key", "tie").sortWithinPartitions("key", "tie").select("key", "text", F.spark_partition_id().alias("part"))
    dealt.mapInArrow(run, BLOCKS).write.option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per document from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Starts come from the token counts of the parts, then of the blocks of a part, then of the documents of a block.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, number, keys, payload = (batch.column(c)[row].as_py() for c in ("part", "block", "keys", "payload"))
                block = Block(payload)
                data = block.all_ids().astype("<u4")
                starts = block.ends - block.doc_tokens
                crc = [zlib.crc32(data[a:b]) for a, b in zip(starts.tolist(), block.ends.tolist(), strict=True)]
                n = len(keys)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, number, np.int32)), pa.array(keys, pa.int64()), pa.array(starts), pa.array(block.doc_tokens), pa.array(crc, pa.int64())], names=["part", "block", "doc_id", "inside", "n_tokens", "ids_crc32"])

    blocks = spark.read.schema(BLOCKS).parquet(path)
    docs = blocks.select("part", "block", "keys", "payload").mapInArrow(run, TOKENS)
    sizes = blocks.select("part", "block", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part of the file
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before_part"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", "block", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("before_block")).join(parts, "part")
    return docs.join(offsets, ["part", "block"]).select("doc_id", (F.col("before_part") + F.col("before_block") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
