"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles, words
from .language import held_out

#: Labelled rows that a fit takes at most: those with the lowest digest of their key. This bounds the fit, not the scoring.
FIT_ROWS = 20_000
BINS, TREES, DEPTH, RATE, LEAST_WEIGHT, RIDGE = 64, 80, 4, 0.15, 1.0, 1.0

# Byte classes: 0 other, then letters, capitals, digits, blanks, line ends, bytes of non-ASCII letters, and single marks.
_MARKS = b".,!?;:#$%&*|-_<>(){}[]/\\\"'@=+~^"
_CLASS = np.zeros(256, np.int32)
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A], _CLASS[[0x20, 0x09]], _CLASS[[0x0A, 0x0D]], _CLASS[0x80:] = 1, 2, 3, 4, 5, 6
for _i, _b in enumerate(_MARKS):
    _CLASS[_b] = 7 + _i
CLASSES = 7 + len(_MARKS)
#: Columns of the statistics.
FEATURES = CLASSES + 13


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES numbers per text; NULL counts as empty, and an empty text has zeros."""
    n = len(texts)
    offsets, data = words.raw(texts)
    size = np.diff(offsets).astype(np.int64)
    cell = np.repeat(np.arange(n, dtype=np.int32) * CLASSES, size)
    cell += _CLASS[data]
    counts = np.bincount(cell, minlength=n * CLASSES).reshape(n, CLASSES)
    shares = counts / np.maximum(size, 1)[:, None]
    one, three = shingles.Shingled(texts, 1), shingles.Shingled(texts, 3)
    more = np.zeros((n, FEATURES - CLASSES))
    listed = texts.to_pylist()
    for i in range(n):
        own = one.word[one.offsets[i] : one.offsets[i + 1]]
        if not len(own):
            continue
        kinds, often = np.unique(own, return_counts=True)
        spans = three.all[three.span(i)]
        lines = [x for x in (listed[i] or "").split("\n") if x.strip()]
        distinct = set(lines)
        ended = sum(x.rstrip()[-1] in ".!?\"'" for x in lines)
        more[i] = [
            np.log1p(size[i]), np.log1p(len(own)), size[i] / len(own), len(kinds) / len(own), often.max() / len(own), (often[often > 1]).sum() / len(own),
            len(np.unique(spans)) / len(spans) if len(spans) else 1.0, np.log1p(len(lines)), len(distinct) / max(1, len(lines)),
            sum(map(len, distinct)) / max(1, sum(map(len, lines))), ended / max(1, len(lines)), size[i] / max(1, len(lines)), counts[i, 2] / max(1, counts[i, 1] + counts[i, 2]),
        ]
    return np.concatenate([shares, more], axis=1)


class Forest(NamedTuple):
    """All trees in one set of arrays. Node i asks x[feature[i]] <= threshold[i] and goes to child[i] or child[i] + 1; leaves have child 0."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(DEPTH):
                inner = self.child[at] > 0
                right = x[rows, self.feature[at]] > self.threshold[at]
                at = np.where(inner, self.child[at] + right, at)
            total += self.value[at]
        return 1.0 / (1.0 + np.exp(-total))


def _grow(binned: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, first: int) -> tuple[list[list[float]], np.ndarray]:
    """One tree, level by level; nodes as [feature, threshold, child, value]. Returns each row's value as well."""
    nodes = [[0, 0.0, 0, 0.0]]
    where = np.zeros(len(grad), np.int64)
    level = [0]
    for depth in range(DEPTH + 1):
        local = {node: k for k, node in enumerate(level)}
        lookup = np.full(len(nodes), -1)
        lookup[level] = range(len(level))
        at = lookup[where]
        live = np.flatnonzero(at >= 0)
        sums = [np.bincount(at[live], w[live], len(level)) for w in (grad, hess)]
        for node in level:
            nodes[node][3] = -RATE * sums[0][local[node]] / (sums[1][local[node]] + RIDGE)
        if depth == DEPTH:
            break
        best = [(1e-6, -1, -1)] * len(level)
        for f in range(binned.shape[1]):
            if not len(edges[f]):
                continue
            cell = at[live] * BINS + binned[live, f]
            g, h = (np.bincount(cell, w[live], len(level) * BINS).reshape(-1, BINS).cumsum(axis=1) for w in (grad, hess))
            gt, ht = g[:, -1:], h[:, -1:]
            gain = g**2 / (h + RIDGE) + (gt - g) ** 2 / (ht - h + RIDGE) - gt**2 / (ht + RIDGE)
            gain = np.where((h >= LEAST_WEIGHT) & (ht - h >= LEAST_WEIGHT), gain, -1.0)[:, : len(edges[f])]
            cut = gain.argmax(axis=1)
            for k in range(len(level)):
                if gain[k, cut[k]] > best[k][0] + 1e-12:
                    best[k] = (float(gain[k, cut[k]]), f, int(cut[k]))
        following = []
        for k, node in enumerate(level):
            _, f, cut = best[k]
            if f < 0:
                continue
            child = len(nodes)
            nodes[node][:3] = [f, float(edges[f][cut]), first + child]
            nodes += [[0, 0.0, 0, 0.0], [0, 0.0, 0, 0.0]]
            mine = where == node
            where[mine] = child + (binned[mine, f] > cut)
            following += [child, child + 1]
        level = following
        if not level:
            break
    return nodes, np.array([n[3] for n in nodes])[where]


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boosted trees for the probability of 1. Without rows the score is 0.5 everywhere, with one class its smoothed share."""
    rate = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(rate / (1 - rate)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) if len(x) else np.zeros(0) for f in range(x.shape[1])]
    edges = [e[e < x[:, f].max()] if len(x) else e for f, e in enumerate(edges)]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1) if len(x) else np.zeros((0, x.shape[1]), np.int64)
    total, nodes, roots = np.full(len(y), base), [], []
    for _ in range(TREES if 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-total))
        tree, moved = _grow(binned, edges, p - y, p * (1 - p), len(nodes))
        roots.append(len(nodes))
        nodes += tree
        total += moved
    table = np.array(nodes, float).reshape(-1, 4)
    return Forest(base, np.array(roots, np.int64), table[:, 0].astype(np.int64), table[:, 1], table[:, 2].astype(np.int64), table[:, 3])


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = FIT_ROWS) -> Forest:
    """Fit on at most `rows` labelled documents that are not held out. Several labels of a key count by their mean; NULL labels not at all.

    Only the keys of the sample meet the documents, so no text is shuffled; the driver gets `rows` rows of statistics.
    """
    marked = labels.where(F.col(label).isNotNull() & ~held_out(key)).groupBy(F.col(key).cast("string").alias("k")).agg(F.avg(label).alias("y"))
    sample = marked.orderBy(F.md5("k"), "k").limit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.byte_slices(batch, "text"):
                x = statistics(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("k"), part.column("y"), pa.array(list(x), pa.list_(pa.float64()))], names=["k", "y", "x"])

    # At most FIT_ROWS short keys: a bounded broadcast.
    chosen = docs.select(F.col(key).cast("string").alias("k"), F.col(text).cast("string").alias("text")).join(F.broadcast(sample), "k").select("k", "y", "text")
    found = chosen.mapInArrow(run, "k string, y double, x array<double>").orderBy(F.md5("k"), "k", "x").limit(rows).select("y", "x").toPandas()
    return fit(np.array(found["x"].tolist(), float).reshape(-1, FEATURES), found["y"].to_numpy(float))


def predict(docs: DataFrame, forest: Forest, text: str = "text", score: str = "quality_score") -> DataFrame:
    """All rows and columns with the score, which replaces a column of that name. NULL and empty texts are scored by their zeros."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)
    out = docs.withColumn(score, F.lit(None).cast("double"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.byte_slices(batch, text):
                new = pa.array(shared.value.score(statistics(part.column(text).cast(pa.string()))))
                yield pa.RecordBatch.from_arrays([new if n == score else part.column(n) for n in part.schema.names], names=part.schema.names)

    return out.mapInArrow(run, out.schema)
