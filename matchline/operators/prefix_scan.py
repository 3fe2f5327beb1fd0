"""A distributed prefix scan over ordered histories.

Rows are dealt by ranges of (entity, date, match key), so an entity, or one day of it, that holds most rows spreads over as many
partitions as it needs. Each partition turns its rows into states before each day, Arrow batch by Arrow batch, and ends with one tail: the
state its last entity leaves behind. States are associative, so the tails, one row a partition, merge in order to what each partition
has to add to its first entity. No group of rows meets in one task and no day is ordered as a whole.

A state holds the number of rows, the last date, the last `window` decided results, and for each measure the weighted sum, the sum of weights, the number of
values and the place of the last value. Weights count from that place, so a long gap or a long history neither underflows nor
overflows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import materialise

SUM = T.StructType([T.StructField("s", T.DoubleType()), T.StructField("w", T.DoubleType()), T.StructField("at", T.LongType())])


@dataclass(frozen=True)
class Weighted:
    """Weighted sums over the values of one measure; weights halve every `half_life` rows back from the last value, which is row `at` (from 1)."""

    s: float = 0.0
    w: float = 0.0
    at: int = 0
    k: int = 0


@dataclass(frozen=True)
class State:
    """What the rows of one entity, in order, leave behind."""

    entity: Any = None
    n: int = 0
    last_date: Any = None
    results: tuple[float, ...] = ()
    measures: dict[str, Weighted] = field(default_factory=dict)


def merge_weighted(a: Weighted, a_rows: int, b: Weighted, half_life: float) -> Weighted:
    """Sums over the rows of a (there are `a_rows`) followed by those of b."""
    if not b.k:
        return a
    fade = 2.0 ** (-(a_rows - a.at + b.at) / half_life) if a.k else 0.0
    return Weighted(b.s + a.s * fade, b.w + a.w * fade, a_rows + b.at, a.k + b.k)


def merge(a: State, b: State, window: int, half_life: float) -> State:
    """The state after the rows of a and then those of b, both of one entity."""
    measures = {m: merge_weighted(a.measures.get(m, Weighted()), a.n, w, half_life) for m, w in b.measures.items()}
    return State(b.entity, a.n + b.n, b.last_date, (a.results + b.results)[-window:], measures)


def _scan(x: np.ndarray, start: np.ndarray, half_life: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sum, weight, row of the last value or -1) over the values from start[i] up to row i, for all rows at once by doubling steps."""
    valued = ~np.isnan(x)
    s, w, at = np.where(valued, x, 0.0), valued.astype(float), np.where(valued, np.arange(len(x)), -1)
    reach = np.arange(len(x)) - start
    step = 1
    while step <= reach.max(initial=0):
        here = np.flatnonzero(reach >= step)
        left = here - step
        fade = np.where(at[here] < 0, 1.0, np.exp2(-(at[here] - at[left]) / half_life))
        fade[at[left] < 0] = 0.0
        s_new, w_new = s[here] + s[left] * fade, w[here] + w[left] * fade
        at_new = np.where(at[here] < 0, at[left], at[here])
        s[here], w[here], at[here] = s_new, w_new, at_new
        step *= 2
    return s, w, at


class Scanner:
    """Scans one partition, a batch at a time, and holds the state of the entity that the last batch ended in."""

    def __init__(self, measures: Sequence[str], window: int, half_life: float, min_periods: int):
        self.measures, self.window, self.half_life, self.min_periods = list(measures), window, half_life, min_periods
        self.state: State | None = None
        self.first_entity: Any = None
        self.parts = 0

    def scan(self, batch: pa.RecordBatch) -> dict[str, pa.Array]:
        """Columns with one row per (entity, day) part of the batch; adds the batch to the state."""
        n, entity = batch.num_rows, batch.column("entity")
        date = batch.column("date").cast(pa.int32()).to_numpy(zero_copy_only=False)
        new_entity, row = np.ones(n, bool), np.arange(n)
        new_entity[1:] = pc.not_equal(entity[1:], entity[:-1]).to_numpy(zero_copy_only=False)
        goes_on = self.state is not None and self.state.entity == entity[0].as_py()
        if self.state is None:
            self.first_entity = entity[0].as_py()
        carry = self.state if goes_on else State()
        start = np.maximum.accumulate(np.where(new_entity, row, 0))
        new_day = new_entity.copy()
        new_day[1:] |= np.diff(date) != 0
        day = np.flatnonzero(new_day)
        day_end = np.append(day[1:], n)
        inherits = start[day] == 0  # days of the batch's first entity add what came before
        out = {"entity": entity.take(pa.array(day)), "date": batch.column("date").take(pa.array(day)), "part": pa.array(self.parts + np.arange(len(day)))}
        out["in_first"] = pa.array(inherits & (self.first_entity == entity[0].as_py() if goes_on or not self.parts else False))
        self.parts += len(day)

        before = np.where(new_entity[day], -1, day - 1)
        previous = np.where(before >= 0, date[before], 0)
        known = before >= 0
        if goes_on:
            previous, known = np.where(known, previous, np.where(inherits, carry.last_date, 0)), known | inherits
        out["previous"] = pa.array(previous.astype(np.int32), mask=~known).cast(pa.date32())

        results = self._results(batch, out, day, day_end, start, inherits, carry, n)
        ends = {}
        for m in self.measures:
            ends[m] = self._weighted(m, batch.column(m), out, day, day_end, start, inherits, carry)
        last_start = int(start[-1])
        own = State(entity[n - 1].as_py(), n - last_start, int(date[-1]), results, ends)
        self.state = merge(carry, own, self.window, self.half_life) if last_start == 0 and goes_on else own
        return out

    def _results(self, batch, out, day, day_end, start, inherits, carry, n) -> tuple[float, ...]:
        cover = pc.fill_null(batch.column("cover"), np.nan).to_numpy(zero_copy_only=False)
        decided = np.flatnonzero((cover == 0.0) | (cover == 1.0))
        count = np.searchsorted(decided, np.arange(n + 1))  # decided rows before each row
        hits = np.append(0.0, np.cumsum(cover[decided]))
        upto = count[day]
        since = np.maximum(upto - self.window, count[start[day]])
        total, number = hits[upto] - hits[since], upto - since
        older = np.append(0.0, np.cumsum(carry.results[::-1]))  # sums of the newest results of earlier batches
        more = np.where(inherits, np.minimum(self.window - number, len(carry.results)), 0)
        out["hits"], out["n_results"] = pa.array(total + older[more]), pa.array(number + more)
        out["has_result"] = pa.array(count[day_end] > upto)
        return tuple(cover[decided[max(count[start[-1]], count[n] - self.window) :]].tolist())

    def _weighted(self, m, column, out, day, day_end, start, inherits, carry) -> Weighted:
        x = pc.fill_null(column, np.nan).to_numpy(zero_copy_only=False)
        n = len(x)
        s, w, at = _scan(x, start, self.half_life)
        valued = np.flatnonzero(~np.isnan(x))
        count = np.searchsorted(valued, np.arange(n + 1))
        old = carry.measures.get(m, Weighted())

        def upto(rows: np.ndarray, has: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Sums over the entity's rows up to each row (where `has`), with earlier batches for the first entity."""
            rows = np.where(has, rows, 0)
            any_ = has & (at[rows] >= 0)
            place = np.where(any_, at[rows] - start[of] + 1, 0)
            s_, w_ = np.where(any_, s[rows], 0.0), np.where(any_, w[rows], 0.0)
            if old.k:
                fade = np.where(any_, np.exp2(-(carry.n - old.at + place) / self.half_life), 1.0) * inherits
                s_, w_ = s_ + old.s * fade, w_ + old.w * fade
            place = np.where(any_, place + np.where(inherits, carry.n, 0), np.where(inherits, old.at, 0))
            return s_, w_, place

        k = count[day] - count[start[day]] + np.where(inherits, old.k, 0)
        levels = [(*upto(day - 1, day > start[day], day), np.ones(len(day), bool))]
        for need in range(1, self.min_periods + 1):
            # The first row of the day with `need` values before it inside the day comes right after the need-th of them.
            nth = count[day] + need - 1
            inside = nth < len(valued)
            row = valued[np.minimum(nth, len(valued) - 1)] if len(valued) else np.zeros(len(day), np.int64)
            inside &= row + 1 < day_end
            levels.append((*upto(row, inside, day), inside & (k < self.min_periods)))
        out[f"k_{m}"] = pa.array(k)
        columns = [np.column_stack([level[c] for level in levels]).reshape(-1) for c in range(4)]
        structs = pa.StructArray.from_arrays([pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2].astype(np.int64))], ["s", "w", "at"], mask=pa.array(~columns[3].astype(bool)))
        # Later levels serve entities with a short past only.
        length = np.where(k < self.min_periods, len(levels), 1)
        keep = (np.arange(len(levels)) < length[:, None]).reshape(-1)
        out[f"ew_{m}"] = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)), pa.int32()), structs.filter(pa.array(keep)))
        first = int(start[-1])
        if at[-1] < 0:
            return Weighted()
        return Weighted(float(s[-1]), float(w[-1]), int(at[-1]) - first + 1, int(count[n] - count[first]))


def _tail_type(entity: T.DataType, measures: Sequence[str]) -> T.StructType:
    one = T.StructType([*SUM.fields, T.StructField("k", T.LongType())])
    fixed = [("first", entity), ("entity", entity), ("n", T.LongType()), ("last_date", T.IntegerType()), ("results", T.ArrayType(T.DoubleType()))]
    return T.StructType([T.StructField(n, t) for n, t in [*fixed, *[(m, one) for m in measures]]])


def _schema(entity: T.DataType, measures: Sequence[str]) -> T.StructType:
    fixed = [
        ("entity", entity), ("date", T.DateType()), ("part", T.LongType()), ("in_first", T.BooleanType()), ("previous", T.DateType()),
        ("hits", T.DoubleType()), ("n_results", T.LongType()), ("has_result", T.BooleanType()),
    ]
    of_measures = [x for m in measures for x in ((f"k_{m}", T.LongType()), (f"ew_{m}", T.ArrayType(SUM)))]
    last = [("slice", T.IntegerType()), ("tail", _tail_type(entity, measures))]
    return T.StructType([T.StructField(n, t) for n, t in [*fixed, *of_measures, *last]])


def day_parts(rows: DataFrame, measures: Sequence[str], window: int, half_life: float, min_periods: int) -> DataFrame:
    """States before each (entity, day) part from the rows of its own partition, and one row with a tail per partition.

    `rows` has entity, date, game_key, cover and the measures. One exchange by ranges; nothing else moves.
    """
    measures = list(measures)
    schema = _schema(rows.schema["entity"].dataType, measures)
    order = ["entity", "date", "game_key"]
    dealt = rows.select(*order, F.col("cover").cast("double"), *[F.col(m).cast("double") for m in measures]).repartitionByRange(*order)
    dealt = dealt.sortWithinPartitions(*order).withColumn("slice", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        scanner, slice_ = Scanner(measures, window, half_life, min_periods), None
        for batch in batches:
            if batch.num_rows:
                slice_ = batch.column("slice")[0].as_py()
                out = scanner.scan(batch)
                n = len(out["part"])
                out |= {"slice": pa.array([slice_] * n, pa.int32()), "tail": pa.nulls(n, arrow.field("tail").type)}
                yield pa.RecordBatch.from_arrays([out[f.name].cast(f.type) for f in arrow], schema=arrow)
        if slice_ is not None:
            st = scanner.state
            tail = {"first": scanner.first_entity, "entity": st.entity, "n": st.n, "last_date": st.last_date, "results": list(st.results)}
            tail |= {m: vars(w) for m, w in st.measures.items()}
            row = {"slice": slice_, "tail": tail}
            yield pa.RecordBatch.from_arrays([pa.array([row.get(f.name)], f.type) for f in arrow], schema=arrow)

    return dealt.mapInArrow(run, schema)


def carried(tails: list, measures: Sequence[str], window: int, half_life: float) -> list[tuple]:
    """For each slice whose first entity has earlier rows: (slice, state they leave behind). Tails are rows (slice, tail)."""
    out, state = [], None
    for r in sorted(tails, key=lambda r: r.slice):
        t = r.tail
        goes_on = state is not None and state.entity == t.first
        if goes_on:
            out.append((r.slice, state))
        own = State(t.entity, t.n, t.last_date, tuple(t.results), {m: Weighted(*(t[m][f] for f in ("s", "w", "at", "k"))) for m in measures})
        state = merge(state, own, window, half_life) if goes_on and t.first == t.entity else own
    return out


def _carry_frame(spark, carries: list[tuple], measures: Sequence[str]) -> DataFrame:
    """One row per slice with what its first entity inherits; `c_sums` holds the sums of the newest 0, 1, 2 ... results."""
    rows = []
    for slice_, st in carries:
        sums = np.append(0.0, np.cumsum(st.results[::-1])).tolist()
        rows.append((slice_, True, st.last_date, sums, st.n, *[v for m in measures for v in vars(st.measures[m]).values()]))
    of_measures = ", ".join(f"c_s_{m} double, c_w_{m} double, c_at_{m} long, c_k_{m} long" for m in measures)
    return spark.createDataFrame(rows, "slice int, in_first boolean, c_date int, c_sums array<double>, c_n long" + (", " + of_measures if measures else ""))


def states_before_days(rows: DataFrame, measures: Sequence[str], window: int, half_life: float, min_periods: int) -> DataFrame:
    """One row per (entity, date): previous (date), hits and n_results (of the last `window` decided results), has_result, ew_<measure>.

    All are taken before the entity's first row of the day; ew_<measure> is NULL until `min_periods` values came before, or else taken before
    the first row of the day where they did. The driver gets one tail per partition and sends as many rows back.
    """
    spark = rows.sparkSession
    parts = materialise(day_parts(rows, measures, window, half_life, min_periods), "day-parts")
    tails = parts.where("tail IS NOT NULL").select("slice", "tail").collect()
    carry = _carry_frame(spark, carried(tails, measures, window, half_life), measures)
    found = parts.where("tail IS NULL").drop("tail").join(F.broadcast(carry), ["slice", "in_first"], "left")  # at most one row a partition
    place = F.struct("slice", "part")
    more = F.least(F.lit(window) - F.col("n_results"), F.coalesce(F.size("c_sums") - 1, F.lit(0)))
    more = F.when(F.col("c_sums").isNull(), 0).otherwise(more)
    before = F.struct(
        F.coalesce("previous", F.date_from_unix_date("c_date")).alias("previous"),
        (F.col("hits") + F.coalesce(F.get("c_sums", more.cast("int")), F.lit(0.0))).alias("hits"),
        (F.col("n_results") + more).alias("n_results"),
    )
    aggs = [F.min_by(before, place).alias("_b"), F.max("has_result").alias("has_result")]
    for m in measures:
        value = _mean(m, half_life, min_periods)
        aggs.append(F.min_by(value, F.when(value.isNotNull(), place)).alias(f"ew_{m}"))
    return found.groupBy("entity", "date").agg(*aggs).select("entity", "date", "_b.*", "has_result", *[f"ew_{m}" for m in measures])


def _mean(m: str, half_life: float, min_periods: int) -> Column:
    """Weighted mean of one measure: the part's own sums and the inherited ones, faded by the rows between."""
    have = F.col(f"k_{m}") + F.coalesce(f"c_k_{m}", F.lit(0))
    own = F.get(f"ew_{m}", F.greatest(F.lit(min_periods) - have, F.lit(0)).cast("int"))
    gap = (F.col("c_n") - F.col(f"c_at_{m}") + own["at"]).cast("double")
    fade = F.when(own["w"] > 0, F.pow(F.lit(2.0), -gap / F.lit(float(half_life)))).otherwise(1.0)
    inherited = lambda c: F.coalesce(F.col(f"c_{c}_{m}") * fade, F.lit(0.0))
    return F.when(own.isNotNull(), F.try_divide(own["s"] + inherited("s"), own["w"] + inherited("w")))


def _end_schema(entity: T.DataType, key: T.DataType, measures: Sequence[str]) -> T.StructType:
    one = T.StructType([*SUM.fields, T.StructField("k", T.LongType())])
    place = T.StructType([T.StructField("date", T.DateType()), T.StructField("game_key", key)])
    fixed = [("entity", entity), ("n", T.LongType()), ("first", place), ("last", place), ("results", T.ArrayType(T.DoubleType()))]
    return T.StructType([T.StructField(n, t) for n, t in [*fixed, *[(m, one) for m in measures]]])


def _segment_rows(batch: pa.RecordBatch, measures: Sequence[str], window: int, half_life: float) -> list[dict]:
    """The state that each entity's rows in a sorted batch leave, one row per entity."""
    n, entity = batch.num_rows, batch.column("entity")
    new = np.append(True, pc.not_equal(entity[1:], entity[:-1]).to_numpy(zero_copy_only=False)) if n > 1 else np.ones(n, bool)
    first = np.flatnonzero(new)
    end = np.append(first[1:], n) - 1
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    cover = pc.fill_null(batch.column("cover"), np.nan).to_numpy(zero_copy_only=False)
    decided = np.flatnonzero((cover == 0.0) | (cover == 1.0))
    scans = {m: _scan(pc.fill_null(batch.column(m), np.nan).to_numpy(zero_copy_only=False), start, half_life) for m in measures}
    valued = {m: np.append(0, np.cumsum(pc.is_valid(batch.column(m)).to_numpy(zero_copy_only=False))) for m in measures}
    out = []
    for a, b in zip(first.tolist(), end.tolist(), strict=True):
        place = lambda i: {"date": batch.column("date")[i].as_py(), "game_key": batch.column("game_key")[i].as_py()}
        mine = decided[np.searchsorted(decided, a) : np.searchsorted(decided, b + 1)]
        row = {"entity": entity[a].as_py(), "n": b - a + 1, "first": place(a), "last": place(b), "results": cover[mine[-window:]].tolist()}
        for m, (s, w, at) in scans.items():
            row[m] = {"s": float(s[b]), "w": float(w[b]), "at": int(at[b]) - a + 1 if at[b] >= 0 else 0, "k": int(valued[m][b + 1] - valued[m][a])}
        out.append(row)
    return out


def _merged_rows(a: dict, b: dict, measures: Sequence[str], window: int, half_life: float) -> dict:
    """The same for two rows of one entity that follow each other."""
    out = {**b, "n": a["n"] + b["n"], "first": a["first"], "results": (a["results"] + b["results"])[-window:]}
    return out | {m: vars(merge_weighted(Weighted(**a[m]), a["n"], Weighted(**b[m]), half_life)) for m in measures}


def merged(a: Column, b: Column, measures: Sequence[str], window: int, half_life: float) -> Column:
    """The state after the rows of a and then those of b, as a struct; the same rule as `merge`."""
    def measure(m: str) -> Column:
        x, y = a[m], b[m]
        gap = (a["n"] - x["at"] + y["at"]).cast("double")
        fade = F.when(x["k"] > 0, F.pow(F.lit(2.0), -gap / F.lit(float(half_life)))).otherwise(0.0)
        both = F.struct((y["s"] + x["s"] * fade).alias("s"), (y["w"] + x["w"] * fade).alias("w"), (a["n"] + y["at"]).alias("at"), (x["k"] + y["k"]).alias("k"))
        return F.when(y["k"] == 0, x).otherwise(both).alias(m)

    results = F.concat(a["results"], b["results"])
    newest = F.slice(results, F.greatest(F.size(results) - (window - 1), F.lit(1)), F.lit(window))
    return F.struct(a["entity"].alias("entity"), (a["n"] + b["n"]).alias("n"), a["first"].alias("first"), b["last"].alias("last"), newest.alias("results"), *[measure(m) for m in measures])


def entity_states(rows: DataFrame, measures: Sequence[str], window: int, half_life: float) -> DataFrame:
    """The state that all rows of each entity leave: (entity, n, first, last, results, one struct per measure).

    Rows are dealt by ranges; each partition leaves one state per entity, and an entity's states, at most one a partition, are merged in order.
    """
    measures, order = list(measures), ["entity", "date", "game_key"]
    schema = _end_schema(rows.schema["entity"].dataType, rows.schema["game_key"].dataType, measures)
    dealt = rows.select(*order, F.col("cover").cast("double"), *[F.nanvl(F.col(m).cast("double"), F.lit(None).cast("double")).alias(m) for m in measures])
    dealt = dealt.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, open_ = to_arrow_schema(schema), None
        for batch in batches:
            if not batch.num_rows:
                continue
            states = _segment_rows(batch, measures, window, half_life)
            if open_ and open_["entity"] == states[0]["entity"]:
                states[0] = _merged_rows(open_, states[0], measures, window, half_life)
            elif open_:
                states.insert(0, open_)
            open_ = states.pop()  # the next batch may go on with it
            yield pa.RecordBatch.from_pylist(states, schema=arrow)
        if open_:
            yield pa.RecordBatch.from_pylist([open_], schema=arrow)

    parts = dealt.mapInArrow(run, schema)
    # The place of its first row puts the states of an entity in order.
    state = F.struct("first", "entity", "n", "last", "results", *measures)
    gathered = parts.groupBy("entity").agg(F.array_sort(F.collect_list(state)).alias("_p"))
    plain = lambda p: F.struct(*[p[c].alias(c) for c in ("entity", "n", "first", "last", "results", *measures)])
    whole = F.aggregate(F.slice("_p", F.lit(2), F.size("_p")), plain(F.get("_p", F.lit(0))), lambda a, b: merged(a, plain(b), measures, window, half_life))
    return gathered.select(whole.alias("_s")).select("_s.*")
