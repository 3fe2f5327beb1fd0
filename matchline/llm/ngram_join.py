"""N-gram Jaccard join: token-combination prefixes, exact check, connected components.

Tokens are word shingles. A document's tokens are ordered from rare to frequent. Shingles and words are counted in hash buckets over all
documents; the least of the counts of a shingle and of its words bounds its occurrences. Shingles below RARE are indexed one by one, the
frequent ones in combinations of two of a class; a document of a level has 2^level / CLASS_TOKENS classes, so combinations stay
proportional to its length.

A document of n shingles that is similar to another misses at most e = n - ceil(n * similarity) of its shingles there. Its prefix is extended
until (rare shingles) + sum over classes of (shingles - 1) exceeds e: then of the shingles both share, a rare one or two of a
class lie in the prefix, and since both order alike they lie in the other's prefix too. No link can be missed, whatever the counts are.
Towards sets that are not shorter even less can be missing, e' = n - ceil(2 * n * similarity / (1 + similarity)); the part of the prefix that
exceeds e' is its core. Two sets meet only on a signature that is in the core of the shorter one, and only if enough tokens remain: behind the
first common token (or, without a common rare one, behind the rare ones) both need as many tokens as the overlap asks for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchline.sources.scratch import scratch_path

from . import shingles, words
from .components import components

#: Buckets in which shingles and words are counted: one byte of each goes to every task.
SHINGLE_BUCKETS, WORD_BUCKETS = 1 << 22, 1 << 20
BUCKETS = SHINGLE_BUCKETS + WORD_BUCKETS
CHUNK = 1 << 14
#: A task's count of a bucket stops at 255. Counts only order the shingles; no result depends on them.
MOST_OF_A_TASK = 255
#: Rarity is 4 * log2(count); shingles of a lower one are indexed alone.
RARE = 32
CLASS_TOKENS = 64
#: Bits of the filter that picks the texts to check; more only save work.
FILTER_BITS = 1 << 23
#: 64-bit numbers of a parity sketch. Two sketches differ in at most as many bits as their sets differ in tokens.
SKETCH = 8
#: Leaders of a posting in one turn.
LEADERS = 4
#: A posting of at most so many sets names all its pairs at once; they are no more than leaders would give.
SMALL = 2 * LEADERS
_PAIR = np.array([0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F], np.uint64)


def _most_missing(n: int, num: int, den: int) -> int:
    return n - -(-n * num // den)


def _most_missing_in_longer(n: int, num: int, den: int) -> int:
    return n - -(-2 * n * num // (num + den))


def _has_partners(n: int, num: int, den: int) -> bool:
    """Whether a set of n can be similar to a different set at all."""
    return n * den // num > n or _most_missing(n, num, den) > 0


def _shingle_bucket(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(SHINGLE_BUCKETS - 1)).astype(np.int64)


def _word_bucket(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(WORD_BUCKETS - 1)).astype(np.int64) + SHINGLE_BUCKETS


def describe(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """Per row: key, n_shingles, class (a number of the whole shingle set; NULL without words). Also the counts in chunks of buckets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, part_id = np.zeros(BUCKETS, np.uint32), 0
        names = ["key", "n_shingles", "class", "part", "chunk", "counts"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        for batch in batches:
            if batch.num_rows:
                part_id = batch.column("part")[0].as_py()
            for part in words.byte_slices(batch, "text"):
                found = shingles.Shingled(part.column("text"), size)
                sets = [found.of(i) for i in range(part.num_rows)]
                for bucket in (_shingle_bucket(np.concatenate(sets)), _word_bucket(found.word)):
                    at, n = np.unique(bucket, return_counts=True)
                    counts[at] += n.astype(np.uint32)
                n = [len(s) for s in sets]
                cls = [shingles.set_key(s) if len(s) else None for s in sets]
                empty = [None] * part.num_rows
                yield pa.RecordBatch.from_arrays([part.column("key"), *(pa.array(v, t) for v, t in zip((n, cls, empty, empty, empty), types[1:], strict=True))], names=names)
        counts = np.minimum(counts, MOST_OF_A_TASK).astype(np.uint8)
        chunks = [(c, counts[c * CHUNK : (c + 1) * CHUNK]) for c in range(BUCKETS // CHUNK)]
        chunks = [(c, pa.compress(v.tobytes(), "zstd", asbytes=True)) for c, v in chunks if v.any()]
        none = [None] * len(chunks)
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip((none, none, none, [part_id] * len(chunks), [c for c, _ in chunks], [v for _, v in chunks]), types, strict=True)], names=names)

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"), F.spark_partition_id().alias("part"))
    return rows.mapInArrow(run, "key long, n_shingles long, class long, part int, chunk int, counts binary")


def rarities(described: DataFrame) -> np.ndarray:
    """The rarity of each bucket, one byte each. Chunks are added in groups of at most 256 tasks, then over those."""
    def total_of(batch: pa.Table, kind: str) -> np.ndarray:
        size = CHUNK * np.dtype(kind).itemsize
        return sum(np.frombuffer(pa.decompress(v.as_py(), size, "zstd"), kind).astype("<i8") for v in batch.column("counts"))

    def add(batch: pa.Table) -> pa.Table:
        packed = pa.compress(total_of(batch, "u1").tobytes(), "zstd", asbytes=True)
        return pa.table({"part": batch.column("part").slice(0, 1), "chunk": batch.column("chunk").slice(0, 1), "counts": pa.array([packed], pa.binary())})

    def level(batch: pa.Table) -> pa.Table:
        total = total_of(batch, "<i8")
        return pa.table({"chunk": batch.column("chunk").slice(0, 1), "levels": pa.array([np.minimum(255, np.rint(4 * np.log2(total + 1))).astype(np.uint8).tobytes()], pa.binary())})

    chunks = described.where("chunk IS NOT NULL").select((F.col("part") / 256).cast("int").alias("part"), "chunk", "counts")
    summed = chunks.groupBy("part", "chunk").applyInArrow(add, "part int, chunk int, counts binary")
    out = np.zeros(BUCKETS, np.uint8)
    for row in summed.groupBy("chunk").applyInArrow(level, "chunk int, levels binary").collect():  # one byte a bucket
        out[row.chunk * CHUNK : (row.chunk + 1) * CHUNK] = np.frombuffer(row.levels, np.uint8)
    return out


def signatures(tokens: np.ndarray, rarity: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix signatures of one document from its distinct tokens and their rarities, which of them are core, and the tokens left from there on."""
    n = len(tokens)
    limits = [_most_missing(n, num, den), _most_missing_in_longer(n, num, den)]
    order = np.lexsort((tokens, rarity))
    tokens, rarity = tokens[order], rarity[order]
    rare = int(np.searchsorted(rarity, RARE))
    alone = min(rare, limits[0] + 1)
    sigs, core, left = [shingles.mix(tokens[:alone] ^ _PAIR[0])], [np.arange(alone) <= limits[1]], [n - np.arange(alone)]
    if rare > limits[0]:
        return sigs[0], core[0], left[0]
    frequent = tokens[rare:]
    # Partners have between n * similarity and n / similarity tokens; both sides index at the level of the shorter.
    for level in {int(m).bit_length() for m in (-(-n * num // den), n, n * den // num)}:
        classes = max(1, (1 << (level - 1)) // CLASS_TOKENS)
        cls = (frequent >> np.uint64(20)) % np.uint64(classes)
        # Tokens that add one to the sum: all but the first of their class.
        adds = np.ones(len(frequent), np.int64)
        adds[np.unique(cls, return_index=True)[1]] = 0
        stop, core_stop = (int(np.searchsorted(np.cumsum(adds), e + 1 - rare)) + 1 if rare <= e else 0 for e in limits)
        by_class = np.argsort(cls[:stop], kind="stable")
        first, second = (by_class[x] for x in _pairs_inside(cls[:stop][by_class]))
        a, b = frequent[first], frequent[second]
        sigs.append(shingles.mix(a * _PAIR[0] + b * _PAIR[1] + np.uint64(level)))
        core.append(np.maximum(first, second) < core_stop)
        left.append(np.full(len(a), n - rare))
    return np.concatenate(sigs), np.concatenate(core), np.concatenate(left)


def _pairs_inside(cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places (i < j) with equal class in a sorted array."""
    ends = np.searchsorted(cls, cls, "right")
    after = ends - np.arange(len(cls)) - 1
    return np.repeat(np.arange(len(cls)), after), words.ragged(np.arange(len(cls)) + 1, after)


def sketch(tokens: np.ndarray) -> list[int]:
    """Bit i tells whether an odd number of tokens fall on i."""
    odd = np.bincount((tokens % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def index_rows(docs: DataFrame, text: str, size: int, num: int, den: int, levels: np.ndarray) -> DataFrame:
    """(sig, class, facts): the prefix signatures of each distinct set, n, rest and core packed into one number; a task writes a set's rows once however many copies it meets."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, seen = shared.value, set()
        for batch in batches:
            for part in words.byte_slices(batch, "text"):
                found = shingles.Shingled(part.column("text"), size)
                word = levels[_word_bucket(found.word)]
                rarity = np.minimum.reduce([levels[_shingle_bucket(found.all)], *(word[k : k + len(found.all)] for k in range(size))])
                sigs, cores, rests, classes, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, bool)], [np.zeros(0, np.int64)], [], []
                for i in range(part.num_rows):
                    span = found.span(i)
                    if span.stop == span.start:
                        continue
                    tokens, first = np.unique(found.all[span], return_index=True)
                    cls = shingles.set_key(tokens)
                    if cls in seen or not _has_partners(len(tokens), num, den):
                        continue
                    if len(seen) < 1_000_000:
                        seen.add(cls)
                    for kept, new in zip((sigs, cores, rests), signatures(tokens, rarity[span][first], num, den), strict=True):
                        kept.append(new)
                    classes.append(cls)
                    sizes.append(len(tokens))
                many = [len(s) for s in sigs[1:]]
                facts = np.repeat(np.array(sizes, np.int64), many) << 32 | np.concatenate(rests) << 1 | np.concatenate(cores)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.repeat(np.array(classes, np.int64), many)), pa.array(facts)], names=["sig", "class", "facts"])

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "sig long, class long, facts long")


def shared_postings(index: DataFrame) -> DataFrame:
    """The index rows whose signature at least two different sets have, one of them in its core; with the partners a set meets in all."""
    unpacked = [F.shiftright("facts", 32).cast("int").alias("n"), (F.col("facts").bitwiseAND(F.lit(1)) == 1).alias("core"), F.shiftright("facts", 1).bitwiseAND(F.lit(2**31 - 1)).cast("int").alias("rest")]
    dealt = index.repartition("sig").groupBy("sig", "class").agg(F.max("facts").alias("facts")).select("sig", "class", *unpacked)
    of_sig = Window.partitionBy("sig")
    return dealt.withColumns({"m": F.count(F.lit(1)).over(of_sig), "any": F.max("core").over(of_sig)}).where("m > 1 AND any").drop("any")


def with_partners(postings: DataFrame) -> DataFrame:
    """Add `partners`, the meetings of a set over all these postings: the original of a group of copies has the most."""
    met = postings.groupBy("class").agg(F.sum(F.col("m") - 1).alias("partners"))
    return postings.join(met, "class")


def with_marks(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows with `_marked`: true where the key is one of `keys`, and for a few others by chance. Only a bit field of fixed size moves, none of the rows."""
    bit = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS)) + 1  # the bitmap functions count from 1
    bucket, place = F.bitmap_bucket_number(bit), F.bitmap_bit_position(bit)
    fields = keys.select(bucket.alias("_bucket"), place.alias("place")).groupBy("_bucket").agg(F.bitmap_construct_agg("place").alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(place.cast("int"), 3) + 1, F.lit(1))), 16, 10).cast("int")
    met = rows.withColumn("_bucket", bucket).join(F.broadcast(fields), "_bucket", "left")  # FILTER_BITS bits at most
    return met.withColumn("_marked", F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))).drop("_bucket", "_bits")


def of_candidates(docs: DataFrame, text: str, key: str, described: DataFrame, classes: DataFrame, size: int, column: str) -> DataFrame:
    """(class, `column`): the text or the sketch of each set of `classes`. Marks pick the texts, so the others are not shuffled; a few more sets may come along."""
    firsts = described.where("class IS NOT NULL").groupBy("class").agg(F.min("key").alias("key"))
    wanted = classes.select("class").distinct().join(firsts, "class").select("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.byte_slices(batch, "text"):
                found = shingles.Shingled(part.column("text"), size)
                sets = [found.of(i) for i in range(part.num_rows)]
                columns = [pa.array([shingles.set_key(s) for s in sets], pa.int64()), part.column("text"), pa.array([sketch(s) for s in sets], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["class", "text", "sketch"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    marked = with_marks(rows, wanted, "key").where("_marked").select("text")
    return marked.mapInArrow(run, "class long, text string, sketch array<long>").select("class", column).dropDuplicates(["class"])


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("class")).union(pairs.select(F.col("b").alias("class")))


def check(pairs: DataFrame, texts: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar, compared in full."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.byte_slices(batch, "text_b"):
                a, b = (part.column(c).to_pylist() for c in ("a", "b"))
                # Equal left sides stand together; each is read once.
                first = [i for i in range(len(a)) if i == 0 or a[i] != a[i - 1]]
                left, right = shingles.Shingled(part.column("text_a").take(pa.array(first)), size), shingles.Shingled(part.column("text_b"), size)
                out, own, at = [], None, -1
                for i in range(len(a)):
                    if at + 1 < len(first) and first[at + 1] == i:
                        at += 1
                        own = left.of(at)
                    other = right.of(i)
                    place = np.minimum(np.searchsorted(own, other), len(own) - 1)
                    both = int((own[place] == other).sum())
                    if den * both >= num * (len(own) + len(other) - both):
                        out.append(i)
                yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in out], pa.int64()), pa.array([b[i] for i in out], pa.int64())], names=["a", "b"])

    sides = pairs.join(texts.select(F.col("class").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("class").alias("a"), F.col("text").alias("text_a")), "a")
    return sides.select("a", "b", "text_a", "text_b").sortWithinPartitions("a").mapInArrow(run, "a long, b long")


def _labelled(postings: DataFrame, found: DataFrame | None) -> DataFrame:
    if found is None:
        return postings.withColumn("component", F.col("class"))
    return postings.join(found.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))


def _open(labelled: DataFrame) -> DataFrame:
    """The postings that still hold two components; in the others nothing is left to join."""
    of_sig = Window.partitionBy("sig")
    ends = {"_least": F.min("component").over(of_sig), "_greatest": F.max("component").over(of_sig)}
    return labelled.withColumns(ends).where("_least < _greatest").drop(*ends)


def _may_link(x: dict[str, str], y: dict[str, str], num: int, den: int):
    """Near enough in length, not in one component yet, the signature in the core of the shorter set, and enough tokens left on both sides."""
    nx, ny = F.col(x["n"]), F.col(y["n"])
    core = F.when(nx < ny, F.col(x["core"])).when(nx > ny, F.col(y["core"])).otherwise(F.col(x["core"]) | F.col(y["core"]))
    enough = F.least(F.col(x["rest"]), F.col(y["rest"])) * (num + den) >= (nx + ny) * num
    return enough & (F.least(nx, ny) * den >= F.greatest(nx, ny) * num) & (F.col(x["component"]) != F.col(y["component"])) & core


def _with_sketch(labelled: DataFrame, sketches: DataFrame) -> DataFrame:
    return labelled.join(sketches.select("class", *[F.get("sketch", F.lit(i)).alias(f"s{i}") for i in range(SKETCH)]), "class")


_SIDE = ("class", "n", "component", "core", "rest", *[f"s{i}" for i in range(SKETCH)])


def _side(rows: DataFrame, name: str) -> DataFrame:
    return rows.select("sig", *[F.col(c).alias(f"{name}_{c}") for c in _SIDE])


def _differing() -> Column:
    return sum(F.bit_count(F.col(f"x_s{i}").bitwiseXOR(F.col(f"y_s{i}"))) for i in range(SKETCH))


def _near(num: int, den: int) -> Column:
    """The sketches do not differ in more bits than the sets may in tokens."""
    return _differing() * (num + den) <= (F.col("x_n") + F.col("y_n")) * (den - num)


def _small_pairs(small: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, x_n, y_n): all pairs of small postings that may link, each once however many postings it shares. Sketches stay out of it: pairs are few, postings many."""
    facts = ("class", "n", "component", "core", "rest")
    x, y = (_labelled(small, None).select("sig", *[F.col(c).alias(f"{name}_{c}") for c in facts]) for name in "xy")
    met = x.join(y, "sig").where(_may_link({c: f"x_{c}" for c in facts}, {c: f"y_{c}" for c in facts}, num, den) & (F.col("x_class") < F.col("y_class")))
    return met.select(F.col("x_class").alias("a"), F.col("y_class").alias("b"), "x_n", "y_n").distinct()


def _near_pairs(pairs: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, differing): the pairs whose sketches are near enough."""
    x, y = (sketches.select(F.col("class").alias(end), *[F.get("sketch", F.lit(i)).alias(f"{name}_s{i}") for i in range(SKETCH)]) for end, name in (("a", "x"), ("b", "y")))
    return pairs.join(x, "a").join(y, "b").where(_near(num, den)).select("a", "b", _differing().alias("differing"))


def _still_apart(pairs: DataFrame, found: DataFrame | None, checked: DataFrame | None) -> DataFrame:
    """The pairs that are neither checked yet nor in one component."""
    if checked is not None:
        pairs = pairs.join(checked, ["a", "b"], "left_anti")
    if found is None:
        return pairs
    for end in ("a", "b"):
        pairs = pairs.join(found.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}")), end, "left")
    return pairs.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).drop("of_a", "of_b")


def _met(left: DataFrame, right: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of a posting that may link, and whose sketches do not differ in more bits than their sets may."""
    near = _may_link({c: f"x_{c}" for c in _SIDE}, {c: f"y_{c}" for c in _SIDE}, num, den)
    return _side(left, "x").join(_side(right, "y"), "sig").where(near & _near(num, den))


def _ordered(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _leader_meetings(labelled: DataFrame, num: int, den: int, turn: int) -> DataFrame:
    """(x_class, y_class, differing): the leaders that a set meets in its postings and may link with.

    The leaders of a posting are the LEADERS sets with the most partners, in later turns the first in an order that changes with the turn and the signature; so a posting of m sets gives at most LEADERS * m pairs, yet the many
    postings that a group of near copies shares offer a set different leaders."""
    place = -F.col("partners") if turn == 0 else F.xxhash64("class", "sig", F.lit(turn))
    leaders = labelled.withColumn("_place", F.row_number().over(Window.partitionBy("sig").orderBy(place, "class"))).where(F.col("_place") <= LEADERS)
    return _met(labelled, leaders, num, den).select("x_class", "y_class", _differing().alias("differing"))


def _nearest(meetings: DataFrame) -> DataFrame:
    """For each set the leader that is nearest by sketch."""
    nearest = meetings.groupBy("x_class").agg(F.min(F.struct("differing", "y_class"))["y_class"].alias("y_class"))
    return nearest.select(*_ordered("x_class", "y_class")).distinct()


def _cross_pairs(labelled: DataFrame, num: int, den: int) -> DataFrame:
    """All pairs of a posting that are not in one component yet and may link; sets of the posting's largest component meet only the others."""
    of_sig = Window.partitionBy("sig")
    counted = labelled.repartition("sig").withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("sig", "component")))
    open_ = _open(counted.withColumn("largest", F.max(F.struct("k", "component")).over(of_sig)["component"]))
    return _met(open_.where("component <> largest"), open_, num, den).select(*_ordered("x_class", "y_class")).distinct()


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write the frame to the shared folder, well compressed, and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def similar_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, num: int = 80, den: int = 100, leader_turns: int = 3) -> DataFrame:
    """One row per row of `docs`: key, n_shingles, class_id (least key with an equal set), component_id (least key reachable by links).

    Rows link when den * intersection >= num * union of their sets of `size`-word shingles (fewer words: the whole sequence as one shingle; A-Z
    lower-cased, words between ASCII white space). NULL, empty and wordless texts have n_shingles 0 and are linked with nothing. Equal
    sets are one class and are indexed once. Repeated keys are rows of their own; a NULL key counts after all others as a representative.

    Small postings name all their pairs, each pair is held once however many postings it shares; in large ones each set meets a few leaders. In a few turns each set is checked against the nearest it
    may link with, then every pair of sets that are still in two components: all links between different sets count, yet large groups of near copies are not expanded into pairs. Only texts of the pairs
    of a turn are shuffled. Only byte-sized rarities and bit fields, all of fixed size, pass through the driver.
    """
    described = kept(describe(docs, key, text, size), "shingle-sets")
    levels = rarities(described)
    postings = kept(shared_postings(index_rows(docs, text, size, num, den, levels)), "postings")
    rows = described.where("chunk IS NULL").select("key", "n_shingles", "class")
    large = kept(with_partners(postings.where(F.col("m") > SMALL)), "large-postings")
    pairs = kept(_small_pairs(postings.where(F.col("m") <= SMALL), num, den), "small-pairs")
    sketches = kept(of_candidates(docs, text, key, rows, _ends(pairs).union(large.select("class")), size, "sketch"), "sketches")
    near = kept(_near_pairs(pairs, sketches, num, den), "near-pairs")
    found, checked = None, None
    for turn in range(leader_turns + 1):
        labelled = _labelled(large, found)
        labelled = _with_sketch(_open(labelled) if turn else labelled, sketches)
        apart = _still_apart(near, found, checked)
        if turn < leader_turns:
            either = apart.select(F.col("a").alias("x_class"), F.col("b").alias("y_class"), "differing").union(apart.select("b", "a", "differing"))
            pairs = _nearest(either.union(_leader_meetings(labelled, num, den, turn)))
        else:
            pairs = apart.select("a", "b").union(_cross_pairs(labelled, num, den)).distinct()
        pairs = kept(pairs, "pairs")
        checked = pairs if checked is None else checked.union(pairs)
        links = kept(check(pairs, of_candidates(docs, text, key, rows, _ends(pairs), size, "text"), size, num, den), "links")
        if found is None:
            found = components(links)
        elif not links.isEmpty():
            found = components(links.union(found.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    classes = rows.where("class IS NOT NULL").groupBy("class").agg(F.min("key").alias("class_id"))
    named = classes.join(found.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    groups = named.groupBy("component").agg(F.min("class_id").alias("component_id"))
    labels = named.join(groups, "component").select("class", "class_id", "component_id")
    out = rows.join(labels, "class", "left")
    return out.select(F.col("key").alias(key), "n_shingles", F.coalesce("class_id", "key").alias("class_id"), F.coalesce("component_id", "key").alias("component_id"))
