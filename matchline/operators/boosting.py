"""Boosted regression trees: the algorithm, thresholds and samples of Spark's GBTRegressor, in fewer and cheaper passes.

GBTRegressor updates a vector of sums row by row and feature by feature, and caches labels and errors anew for every tree. Here rows are binned once into cached blocks,
a pass adds up whole blocks with numpy, counts only the smaller of two sibling nodes, and sends sums per node, feature and bin to the driver.
"""

from __future__ import annotations

import functools
import math
import pickle
from array import array
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml import Estimator
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.serializers import BatchedSerializer, CPickleSerializer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
#: Rows of a block (LANE times a power of two), rows that draw from one state of the generator.
BLOCK, LANE = 1 << 16, 32
#: Up to HERE_ROWS rows are fitted in one task, without a job per level. Beyond, a task takes whole partitions, of about TASK_ROWS rows together, as starting it is not free.
HERE_ROWS, TASK_ROWS = 500_000, 2_000_000
#: Trees between two checkpoints of the residuals.
CHECKPOINT_EVERY = 10
#: Parameters that are grown here, with Spark's defaults. Fits that set others are left to GBTRegressor.
DEFAULTS = {
    "maxIter": 20, "maxDepth": 5, "stepSize": 0.1, "subsamplingRate": 1.0, "minInstancesPerNode": 1, "minInfoGain": 0.0, "maxBins": 32, "seed": None,
}
#: Rows that the thresholds are taken from; tables with more are sampled.
THRESHOLD_ROWS = 10_000
#: A split that takes less off the squares of a tree than the rounding of its sums is none.
ROUNDING = 8 * np.finfo(float).eps

BINNED = "part int, block int, pairs binary, y binary"


class Spec(NamedTuple):
    n_splits: list[int]
    width: int
    trees: int
    depth: int
    step: float
    rate: float
    least: int
    min_gain: float
    seed: int
    block: int


class Tree(NamedTuple):
    """Nodes by their place in the heap, the root at 1: rows, sum and squares of the target; feature is -1 on leaves."""

    n: np.ndarray
    total: np.ndarray
    squares: np.ndarray
    feature: np.ndarray
    split: np.ndarray
    gain: np.ndarray


class Pass(NamedTuple):
    """One pass over the rows: the splits of tree m so far, the nodes to count, and in a tree's first pass what the tree before has found."""

    m: int
    splits: dict[int, tuple[int, int]]
    counted: list[int]
    before: tuple[dict[int, tuple[int, int]], np.ndarray] | None = None


# --- random numbers: XORShiftRandom, by linear jumps -------------------------


def _murmur(data: bytes, h: int) -> int:
    mask = 0xFFFFFFFF
    for i in range(0, len(data), 4):
        k = int.from_bytes(data[i : i + 4], "little") * 0xCC9E2D51 & mask
        k = ((k << 15 | k >> 17) & mask) * 0x1B873593 & mask
        h ^= k
        h = ((h << 13 | h >> 19) & mask) * 5 + 0xE6546B64 & mask
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & mask
    h = (h ^ h >> 13) * 0xC2B2AE35 & mask
    return h ^ h >> 16


def seeded(seed: int) -> int:
    """The generator's first state."""
    data = (seed & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "big")
    low = _murmur(data, 0x3C074A61)
    return _murmur(data, low) << 32 | low


def _step(x: np.ndarray) -> np.ndarray:
    x = x ^ (x << np.uint64(21))
    x ^= x >> np.uint64(35)
    x ^= x << np.uint64(4)
    return x


def _apply(matrix: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A linear map of states, given by the images of the 64 bits, on each state."""
    out = np.zeros_like(x)
    for b in range(64):
        out ^= (x >> np.uint64(b) & np.uint64(1)) * matrix[b]
    return out


class Draws:
    """The rows of a block that one tree draws: Spark draws them in order, one number a row, from a state per partition and tree."""

    def __init__(self, rate: float, block: int):
        self.least = math.ceil(rate * 2**53)
        bits = np.uint64(1) << np.arange(64, dtype=np.uint64)
        jump = bits
        for _ in range(2 * LANE):
            jump = _step(jump)
        lanes = bits[:, None]
        # Images of the 64 bits at the start of each lane of a block; afterwards `jump` passes a whole block.
        while lanes.shape[1] < block // LANE:
            lanes = np.concatenate([lanes, _apply(jump, lanes.ravel()).reshape(lanes.shape)], axis=1)
            jump = _apply(jump, jump)
        self.lanes, self.jump, self.starts = lanes, jump, [bits]

    def kept(self, seed: int, block: int, n: int) -> np.ndarray:
        while len(self.starts) <= block:
            self.starts.append(_apply(self.jump, self.starts[-1]))
        state = np.uint64(seeded(seed))
        bits = np.arange(64, dtype=np.uint64)
        state = np.bitwise_xor.reduce(self.starts[block][(state >> bits & np.uint64(1)).astype(bool)])
        x = np.bitwise_xor.reduce(self.lanes[(state >> bits & np.uint64(1)).astype(bool), : -(-n // LANE)], axis=0)
        kept = np.empty((len(x), LANE), bool)
        for i in range(LANE):
            x = _step(x)
            high = (x & np.uint64(2**26 - 1)) << np.uint64(27)
            x = _step(x)
            kept[:, i] = high + (x & np.uint64(2**27 - 1)) < self.least
        return kept.ravel()[:n]


@functools.cache
def _draws(rate: float, block: int) -> Draws:
    return Draws(rate, block)


# --- thresholds --------------------------------------------------------------


def thresholds(values: np.ndarray, expected: float, most: int) -> np.ndarray:
    """At most `most` - 1 thresholds of a feature, evenly in rank. Rows that `expected` has beyond those that are not zero count as zeros."""
    found, counts = np.unique(values[values != 0], return_counts=True)
    if not len(found):
        return np.empty(0)
    counts = counts.astype(float)
    zeros = expected - counts.sum()
    if zeros > np.finfo(float).eps * expected * 100:
        at = int(np.searchsorted(found, 0.0))
        found, counts = np.insert(found, at, 0.0), np.insert(counts, at, zeros)
    between = (found[:-1] + found[1:]) / 2.0
    if len(between) <= most - 1:
        return between
    stride = expected / most
    out, target, seen = [], stride, counts[0]
    for i in range(1, len(found)):
        before, seen = seen, seen + counts[i]
        if abs(before - target) < abs(seen - target):
            out.append(between[i - 1])
            target += stride
    return np.array(out)


def _thresholds(rows: DataFrame, n: int, most: int, seed: int) -> list[np.ndarray]:
    """Thresholds of each column but the first, the label; the sample, of some 10,000 rows, is the one that GBTRegressor draws."""
    bins = min(most, n)
    fraction = THRESHOLD_ROWS / n if n > THRESHOLD_ROWS else 1.0
    if fraction < 1:
        first = int(_step(np.array([seeded(seed)], np.uint64))[0]) & 0xFFFFFFFF
        spark = rows.sparkSession
        drawn = rows._jdf.rdd().sample(False, fraction, first - (first >> 31 << 32))
        rows = DataFrame(spark._jsparkSession.createDataFrame(drawn, rows._jdf.schema()), spark)
    sample = rows.toArrow()
    return [thresholds(_numbers(c), fraction * n, bins) for c in sample.columns[1:]]


def _numbers(column) -> np.ndarray:
    """A column without gaps, as the assembler asks for."""
    values = column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()
    if column.null_count or np.isnan(values).any():
        raise ValueError("a tree fit takes no null or NaN, neither in features nor in the label")
    return values


# --- rows --------------------------------------------------------------------


def _binned(splits: list[np.ndarray], width: int, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of rows in the partition's order; two features share a number, an odd last one has its own."""
    # The partition's number comes as the last column: a task may run several partitions.
    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("pairs", pa.binary()), ("y", pa.binary())])

    def run(batches):
        part, block, held = 0, 0, []

        def packed(last):
            nonlocal block, held
            y, *bins = (np.concatenate(x) for x in zip(*held, strict=True))
            end = len(y) if last else len(y) // size * size
            held = [[y[end:], *(b[end:] for b in bins)]]
            for at in range(0, end, size):
                own = [b[at : min(at + size, end)].astype(np.uint16) for b in bins]
                pairs = [own[i] * np.uint16(width) + own[i + 1] if i + 1 < len(own) else own[i] for i in range(0, len(own), 2)]
                row = {"part": part, "block": block, "pairs": np.concatenate(pairs).tobytes(), "y": y[at : min(at + size, end)].tobytes()}
                yield pa.RecordBatch.from_pylist([row], schema)
                block += 1

        for batch in batches:
            if batch.num_rows:
                part = batch.column(batch.num_columns - 1)[0].as_py()
            held.append([_numbers(batch.column(0)), *(np.searchsorted(s, _numbers(batch.column(i))).astype(np.uint8) for i, s in enumerate(splits, 1))])
            if sum(len(x[0]) for x in held) >= size:
                yield from packed(False)
        if held:
            yield from packed(True)

    return run


class _Block:
    """Rows of one partition: bins, and what the trees so far leave of the label."""

    def __init__(self, part: int, block: int, pairs: bytes, residual: bytes):
        self.part, self.block = part, block
        self.residual = np.frombuffer(residual)
        self.pairs = np.frombuffer(pairs, np.uint16).reshape(-1, len(self.residual))
        self.drawn: tuple[int, np.ndarray] | None = None

    def target(self, m: int) -> np.ndarray:
        """Half the gradient is left out, as in GBTRegressor: the first tree fits the label, later ones twice the residual."""
        return 2.0 * self.residual if m else self.residual

    def kept(self, m: int, spec: Spec) -> np.ndarray:
        if self.drawn is None or self.drawn[0] != m:
            n = len(self.residual)
            self.drawn = m, _draws(spec.rate, spec.block).kept(spec.seed + m + self.part + 1, self.block, n) if spec.rate < 1 else np.ones(n, bool)
        return self.drawn[1]

    def nodes(self, splits: dict[int, tuple[int, int]], spec: Spec) -> np.ndarray:
        node = np.ones(len(self.residual), np.uint8)
        for j, (feature, split) in sorted(splits.items()):
            pair = self.pairs[feature // 2]
            if feature % 2:
                right = pair % np.uint16(spec.width) > split
            else:
                right = pair > split if feature == len(spec.n_splits) - 1 else pair >= (split + 1) * spec.width
            at = node == j
            node += at * np.uint8(j)
            node += at & right
        return node

    def settle(self, m: int, spec: Spec, splits: dict[int, tuple[int, int]], value: np.ndarray) -> np.ndarray:
        """Takes the values of tree m off the residual; squares of its target by node."""
        node, kept = self.nodes(splits, spec), self.kept(m, spec)
        squares = np.bincount(node[kept], np.square(self.target(m)[kept]), minlength=len(value))
        self.residual = self.residual - value.take(node)
        return squares

    def add(self, this: Pass, spec: Spec, counts: list[np.ndarray], sums: list[np.ndarray]) -> None:
        """Adds rows and target of the counted nodes, per cell of each pair."""
        kept, target, k = self.kept(this.m, spec), self.target(this.m), len(this.counted)
        if this.splits:
            place = np.full(2 << spec.depth, k, np.uint8)
            place[this.counted] = np.arange(k)
            own = place.take(self.nodes(this.splits, spec))
            rows = np.flatnonzero(kept & (own < k))
            own = own.take(rows).astype(np.int64)
        else:
            rows, own = np.flatnonzero(kept), 0
        target = target.take(rows)
        for i, pair in enumerate(self.pairs):
            cells = counts[i].shape[1]
            at = own * cells + pair.take(rows).astype(np.int64)
            counts[i] += np.bincount(at, minlength=k * cells).reshape(k, cells)
            sums[i] += np.bincount(at, target, minlength=k * cells).reshape(k, cells)


def _features(cells: list[np.ndarray], spec: Spec) -> np.ndarray:
    """(node, feature, bin) from the cells of pairs."""
    out = np.zeros((cells[0].shape[0], len(spec.n_splits), spec.width))
    for i, c in enumerate(cells):
        if c.shape[1] == spec.width:
            out[:, 2 * i] = c
        else:
            square = c.reshape(-1, spec.width, spec.width)
            out[:, 2 * i], out[:, 2 * i + 1] = square.sum(axis=2), square.sum(axis=1)
    return out


def _sums(blocks: Iterable[_Block], this: Pass, spec: Spec) -> list[np.ndarray]:
    """Rows and target per counted node, feature and bin; squares of the target of all rows drawn; squares of the tree before, by node."""
    k, n_features = len(this.counted), len(spec.n_splits)
    cells = [spec.width ** min(2, n_features - i) for i in range(0, n_features, 2)]
    counts, sums = ([np.zeros((k, c)) for c in cells] for _ in range(2))
    whole, before = np.zeros(1), np.zeros(2 << spec.depth)
    for b in blocks:
        if this.before:
            before += b.settle(this.m - 1, spec, *this.before)
        if not k:
            continue
        if not this.splits:
            whole += np.square(b.target(this.m)[b.kept(this.m, spec)]).sum()
        b.add(this, spec, counts, sums)
    return [_features(counts, spec), _features(sums, spec), whole, before]


def _added(parts: Iterable[list[np.ndarray]]) -> list[np.ndarray]:
    return functools.reduce(lambda a, b: [x + y for x, y in zip(a, b, strict=True)], parts)


# --- growing -----------------------------------------------------------------


def best_split(n: np.ndarray, total: np.ndarray, spec: Spec) -> tuple[int, int, float, float, float] | None:
    """Feature, bin, gain, rows and sum of the left side; the first of equal gains. None without a split that leaves both sides enough rows."""
    left_n, left = n.cumsum(axis=1), total.cumsum(axis=1)
    right_n, right = left_n[:, -1:] - left_n, left[:, -1:] - left
    valid = (left_n >= spec.least) & (right_n >= spec.least) & (np.arange(spec.width) < np.array(spec.n_splits)[:, None])
    if not valid.any():
        return None
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(valid, left_n * right_n / left_n[:, -1:] ** 2 * (left / left_n - right / right_n) ** 2, -np.inf)
    feature, at = divmod(int(gain.argmax()), spec.width)
    return feature, at, float(gain[feature, at]), float(left_n[feature, at]), float(left[feature, at])


def _grow(spec: Spec, run: Callable[[Pass], list[np.ndarray]]) -> list[Tree]:
    """All trees; run(pass) gives the sums of a pass over all rows."""
    heap, trees, before = 2 << spec.depth, [], None

    def squared(tree: Tree, own: np.ndarray) -> None:
        tree.squares[:] = own
        for j in range(heap // 2 - 1, 0, -1):
            tree.squares[j] += tree.squares[2 * j] + tree.squares[2 * j + 1]

    for m in range(spec.trees):
        tree = Tree(*(np.zeros(heap) for _ in range(3)), np.full(heap, -1), np.zeros(heap, np.int64), np.full(heap, -np.inf))
        n, total, whole, own = run(Pass(m, {}, [1], before))
        if trees:
            squared(trees[-1], own)
        floor = ROUNDING * whole[0]
        tree.n[1], tree.total[1] = n[0, 0].sum(), total[0, 0].sum()
        found, splits = {1: (n[0], total[0])}, {}
        for level in range(spec.depth):
            new = []
            for j, sums in sorted(found.items()):
                best = best_split(*sums, spec)
                if best is None or best[2] < spec.min_gain:
                    continue
                feature, at, tree.gain[j], left_n, left = best
                if tree.gain[j] * tree.n[j] <= floor:
                    continue
                new.append(j)
                tree.feature[j], tree.split[j] = splits[j] = feature, at
                tree.n[2 * j : 2 * j + 2] = left_n, tree.n[j] - left_n
                tree.total[2 * j : 2 * j + 2] = left, tree.total[j] - left
            if not new or level + 1 == spec.depth:
                break
            # Of two new nodes the one with fewer rows is counted; the other is what is left of the node above.
            counted = [2 * j + int(tree.n[2 * j] > tree.n[2 * j + 1]) for j in new]
            n, total, *_ = run(Pass(m, dict(splits), counted))
            less = dict(zip(counted, zip(n, total, strict=True), strict=True))
            found = less | {j ^ 1: (found[j // 2][0] - a, found[j // 2][1] - s) for j, (a, s) in less.items()}
        # The first tree counts whole, as in GBTRegressor.
        value = np.divide(tree.total, tree.n, out=np.zeros(heap), where=tree.n > 0) * (spec.step if m else 1.0)
        trees.append(tree)
        before = splits, value
    squared(trees[-1], run(Pass(spec.trees, {}, [], before))[3])
    return trees


def _grow_here(spec: Spec) -> Callable[[Iterator[tuple]], Iterator[list[Tree]]]:
    def run(rows):
        blocks = [_Block(*r) for r in rows]
        yield _grow(spec, lambda this: _sums(blocks, this, spec))

    return run


def _cached(rdd: RDD) -> RDD:
    """Cached one record at a time, so that it can be zipped as it lies."""
    return rdd._reserialize(BatchedSerializer(CPickleSerializer(), 1)).persist(StorageLevel.MEMORY_AND_DISK)


def _grow_over(binned: RDD, spec: Spec) -> list[Tree]:
    """Bins stay cached; the residuals are cached anew for each tree, and checkpointed every tenth, as they depend on those of the tree before."""
    base = _cached(binned)
    blocks, state = _cached(base.map(lambda r: r[:3])), _cached(base.map(lambda r: (r[3], None)))
    checkpoints: list[RDD] = []

    def run(this: Pass) -> list[np.ndarray]:
        nonlocal state
        # The shape that follows from zip: ((part, block, bins), (residual, sums)).
        zipped = blocks.zip(state)
        if not (this.before and this.counted):
            return _added(zipped.mapPartitions(lambda rows: [_sums((_Block(*b, r) for b, (r, _) in rows), this, spec)]).collect())

        def settled(row):
            block = _Block(*row[0], row[1][0])
            sums = _sums([block], this, spec)
            return block.residual.tobytes(), sums

        old, state = state, _cached(zipped.map(settled))
        if this.m % CHECKPOINT_EVERY == 0:
            state.checkpoint()
            checkpoints.append(state)
        out = _added(state.mapPartitions(lambda rows: [_added(s for _, s in rows)]).collect())
        old.unpersist()
        while len(checkpoints) > 1:
            _forget(checkpoints.pop(0))
        return out

    try:
        blocks.count(), state.count()
        base.unpersist()
        return _grow(spec, run)
    finally:
        for rdd in (base, blocks, state):
            rdd.unpersist()
        for rdd in checkpoints:
            _forget(rdd)


def _forget(rdd: RDD) -> None:
    """Deletes the files of a checkpoint that a newer one replaces."""
    path = rdd.getCheckpointFile()
    if path:
        context = rdd.ctx
        path = context._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


# --- the model ---------------------------------------------------------------


def _model(stage: GBTRegressor, trees: list[Tree], splits: list[np.ndarray], spec: Spec, spark) -> GBTRegressionModel:
    """The trees as a GBTRegressionModel; two leaves of one prediction become one, as Spark prunes."""
    context = spark.sparkContext
    jvm, gateway = context._jvm, context._gateway
    # Each name is looked up once: a lookup asks the JVM for every part of it.
    ml, loads = jvm.org.apache.spark.ml, jvm.org.apache.spark.ml.python.MLSerDe.loads
    variance, threshold, inner, leaf = jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator, ml.tree.ContinuousSplit, ml.tree.InternalNode, ml.tree.LeafNode

    def node(tree: Tree, stats, j: int):
        n, total, squares = tree.n[j], tree.total[j], tree.squares[j]
        predicted = float(total / n) if n else 0.0
        impurity = float((squares - total * total / n) / n) if n else 0.0
        summary = variance(stats.get(j), int(n))
        if tree.feature[j] >= 0:
            left, left_value = node(tree, stats, 2 * j)
            right, right_value = node(tree, stats, 2 * j + 1)
            if left_value is None or left_value != right_value:
                f = int(tree.feature[j])
                split = threshold(f, float(splits[f][tree.split[j]]))
                return inner(predicted, impurity, float(tree.gain[j]), left, right, split, summary), None
        elif 2 * j < len(tree.n) and tree.gain[j] == -np.inf:
            impurity = -1.0  # no split was valid
        return leaf(predicted, impurity, summary), predicted

    kind = ml.regression.DecisionTreeRegressionModel
    grown, weights = gateway.new_array(kind, len(trees)), gateway.new_array(jvm.double, len(trees))
    for m, tree in enumerate(trees):
        stats = pickle.dumps([array("d", x) for x in zip(tree.n, tree.total, tree.squares, strict=True)], protocol=2)
        root, _ = node(tree, loads(stats), 1)
        grown[m] = kind(root, len(spec.n_splits))
        weights[m] = spec.step if m else 1.0
    model = GBTRegressionModel(ml.regression.GBTRegressionModel(stage.uid, grown, weights, len(spec.n_splits)))
    stage._transfer_params_to_java()
    stage._java_obj.copyValues(model._java_obj, stage._java_obj.extractParamMap())
    model._resetUid(stage.uid)
    return stage._copyValues(model)


class BoostedTrees(Estimator):
    """Fits a GBTRegressor's trees over the assembled features; what it cannot grow is left to the GBTRegressor."""

    def __init__(self, stage: GBTRegressor, features: list[str], params: dict):
        super().__init__()
        self.stage, self.features, self.params_given = stage, features, params

    def _grows(self, df: DataFrame) -> bool:
        given = {**DEFAULTS, **self.params_given}
        plain = not any("ml_attr" in df.schema[c].metadata for c in self.features)
        return set(given) == set(DEFAULTS) and given["maxBins"] <= 64 and 0 < given["maxDepth"] <= 6 and plain

    def _fit(self, df: DataFrame) -> GBTRegressionModel:
        if not self._grows(df):
            return self.stage.fit(df)
        given = {**DEFAULTS, **self.params_given, "seed": self.stage.getSeed()}
        rows = df.select(*[F.col(c).cast("double") for c in (self.stage.getLabelCol(), *self.features)])
        # Counted, sampled and binned, so what lies above is run once.
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return self._fit_rows(df, rows, given)
        finally:
            rows.unpersist()

    def _fit_rows(self, df: DataFrame, rows: DataFrame, given: dict) -> GBTRegressionModel:
        n = rows.count()
        if not n:
            return self.stage.fit(df)  # raises
        splits = _thresholds(rows, n, given["maxBins"], given["seed"])
        spec = Spec(
            [len(s) for s in splits], 1 + max(len(s) for s in splits), given["maxIter"], given["maxDepth"], float(given["stepSize"]), float(given["subsamplingRate"]), given["minInstancesPerNode"],
            float(given["minInfoGain"]), given["seed"], BLOCK,
        )
        binned = rows.withColumn("_part", F.spark_partition_id()).mapInArrow(_binned(splits, spec.width, spec.block), BINNED).rdd.map(lambda r: (r[0], r[1], bytes(r[2]), bytes(r[3])))
        if n <= HERE_ROWS:
            trees = binned.coalesce(1).mapPartitions(_grow_here(spec)).collect()[0]
        else:
            parts = binned.getNumPartitions()
            together = max(1, parts * TASK_ROWS // n)
            trees = _grow_over(binned.coalesce(math.ceil(parts / together)), spec)
        return _model(self.stage, trees, splits, spec, rows.sparkSession)
