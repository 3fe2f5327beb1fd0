"""Document fingerprints of closed syncmers, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words of a k-mer, and of the inner substrings whose minimum decides.
#: In longer runs without white space, and in scripts that write none between words, each character is a word.
K, INNER, WORD = 5, 2, 16
_UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
_WORDS = rf"(?<![^\s{_UNSPACED}])[^\s{_UNSPACED}]{{1,{WORD}}}(?![^\s{_UNSPACED}])|\S"
#: Text bytes of a slice of neighbouring documents, and the cells their keys are counted in.
SLICE_BYTES = 2 << 20
CELLS = 1 << 16


def with_anchors(docs: DataFrame, text: str, out: str) -> DataFrame:
    """Add `out`: the fingerprint, an array of 32-bit anchors in text order. NULL counts as empty and has no anchor.

    A k-mer of K words is an anchor if the least hash of its inner INNER-word strings is at its first or last place. That depends on the
    k-mer alone, so an anchor survives every edit outside its words, in text without spaces too; only a run that an edit
    takes over or under WORD characters gets other words. Where no k-mer qualifies, the whole word sequence is the one anchor.
    """
    words, hashed, inner, found = (f"_{name}_{out}" for name in ("words", "hash", "inner", "found"))
    n = F.size(words)
    at = lambda column, i: F.get(F.col(column), i)
    last = K - INNER
    edge = lambda i: F.least(at(inner, i), at(inner, i + last)) <= F.least(*[at(inner, i + j) for j in range(1, last)])
    anchor = lambda i: F.xxhash64(at(inner, i), at(inner, i + INNER), at(hashed, i + K - 1))
    low = lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF))
    none = F.array().cast("array<bigint>")
    rows = docs.withColumn(words, F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(_WORDS), F.lit(0)))
    rows = rows.withColumn(hashed, F.transform(words, lambda w: F.xxhash64(w)))
    rows = rows.withColumn(inner, F.when(n >= K, F.transform(F.sequence(F.lit(0), n - INNER), lambda i: F.xxhash64(at(hashed, i), at(hashed, i + 1)))).otherwise(none))
    rows = rows.withColumn(found, F.when(n >= K, F.filter(F.transform(F.sequence(F.lit(0), n - K), lambda i: F.when(edge(i), low(anchor(i)))), lambda h: h.isNotNull())).otherwise(none))
    whole = F.when(n > 0, F.array(low(F.xxhash64(hashed)))).otherwise(none)
    return rows.withColumn(out, F.when(F.size(found) > 0, F.col(found)).otherwise(whole)).drop(words, hashed, inner, found)


def likeness(a: str, b: str) -> Column:
    """Shared anchors as a share of all distinct anchors of both; two empty fingerprints are equal."""
    both, all_ = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(all_ == 0, 1.0).otherwise(both / all_).cast("double")


def as_text(anchors: str) -> Column:
    return F.array_join(F.transform(anchors, lambda h: F.lpad(F.hex(h), 8, "0")), "")


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(key, text, anchors, next_text, next_anchors) of every row, the next being the one with the following key; after the last comes the first.

    Rows are dealt into slices of neighbouring keys: text bytes are counted per cell of equal key width, and cells are joined to slices of about
    `slice_bytes`. The first row of each slice is also sent to the slice before, so one shuffle of the texts does. Equal keys follow
    each other by text; NULL keys come first. Keys are record ids: one cell's rows meet in one slice, which is sorted and may spill.
    At most CELLS counts reach the driver.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    low, high = rows.agg(F.min("key"), F.max("key")).first()
    if low is None:
        low, high = 0, 0
    width = -(-(high - low + 1) // CELLS)
    cell = F.when(F.col("key").isNull(), 0).otherwise(F.floor((F.col("key").cast("decimal(20,0)") - low) / width)).cast("int")
    counted = rows.groupBy(cell.alias("cell")).agg(F.sum(F.octet_length("text") + 1).alias("n"), F.min(F.struct("key")).alias("k")).orderBy("cell").collect()
    slices, firsts, filled = [], [], slice_bytes
    for c in counted:
        if filled >= slice_bytes:
            firsts.append(c.k.key)
            filled = 0
        filled += c.n
        slices.append((c.cell, len(firsts) - 1))
    # The first key of a slice is looked for from the slice before it; that of slice 0 from the last.
    wanted = docs.sparkSession.createDataFrame([(k, (i or len(firsts)) - 1) for i, k in enumerate(firsts)], "first long, slice int")
    heads = rows.join(F.broadcast(wanted), F.col("key").eqNullSafe(F.col("first"))).groupBy("slice", "key").agg(F.min("text").alias("text"))
    own = rows.withColumn("cell", cell).join(F.broadcast(docs.sparkSession.createDataFrame(slices, "cell int, slice int")), "cell")  # at most CELLS short rows
    own = own.select("key", "text", "slice", F.lit(0).alias("head"))
    dealt = own.unionByName(heads.select("key", "text", "slice", F.lit(1).alias("head"))).repartition("slice")
    order = Window.partitionBy("slice").orderBy("head", "key", "text")
    led = with_anchors(dealt, "text", "anchors").withColumns({"next_text": F.lead("text").over(order), "next_anchors": F.lead("anchors").over(order)})
    return led.where("head = 0").select(F.col("key").alias(key), "text", "anchors", "next_text", "next_anchors")
