"""Prefix scans over range partitions: ordered computation in which no device or day is a task of its own.

`in_runs` brings a table in the order of its keys and time by one shuffle whose bounds are sampled, so each partition, a run, holds
about as many rows as any other: a device with a third of all rows owns a third of the runs, and many small devices share one.
All that follows is narrow:

1. every run condenses the rows of its *last* key to a head (last row, last known values, totals, or a fold's summary). Only that
   key can go on in the next run, so a run has one head, whatever the number of keys;
2. the heads, one row a partition, are passed through in order and give every run what its first key brings along;
3. that comes back with the run's first row by a broadcast join (as many rows as partitions), and the running columns follow in
   numpy over Arrow batches, with the last row's values handed from batch to batch.

Scans and folds in a row share the one shuffle: a table that is in runs has the column RUN and is scanned as it is. Filters and row-wise columns
in between keep the runs; joins and shuffles don't, and have to drop RUN first.

Bounds are fixed when the plan is made, by a job that reads keys and time: each task keeps the TAKEN rows of least hash, of which not more than
THINNED times LANES come to the driver. So heads and rows are cut alike, also if Spark runs the shuffle twice or again. Rows that share
keys and microsecond stay together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from itertools import zip_longest

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetwatt.operators.timeline import DEVICE_TIME, Timeline

RUN = "__run_no"
FIRST = "__first"
HEAD = "__head_"
NONE = -2

KINDS = ("lag", "last", "last_before", "total", "total_before", "high", "low", "high_before", "low_before", "items_before")


#: Rows of a task that bounds are sampled from; lanes in which samples are thinned, and rows left of a lane.
TAKEN = 256
LANES = 8
THINNED = 8192


def _taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: the TAKEN rows of least hash (the last column), and how many rows each stands for."""
    kept, n = None, 0
    for batch in batches:
        n += batch.num_rows
        t = pa.Table.from_batches([batch]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([batch])])
        kept = t.take(pc.select_k_unstable(t, min(TAKEN, t.num_rows), [(t.column_names[-1], "ascending")]))
    if n:
        weight = pa.array(np.full(kept.num_rows, n / kept.num_rows))
        yield kept.drop_columns([kept.column_names[-1]]).append_column("w", weight).combine_chunks().to_batches()[0]


def _thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: THINNED of the sampled rows at even steps of weight."""
    t = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
    if t is not None and t.num_rows:
        if t.num_rows > THINNED:
            upto = np.cumsum(t.column("w").to_numpy())
            at = np.searchsorted(upto, (np.arange(THINNED) + 0.5) * upto[-1] / THINNED)
            t = t.take(pa.array(at)).set_column(t.num_columns - 1, "w", pa.array(np.full(THINNED, upto[-1] / THINNED)))
        yield from t.combine_chunks().to_batches()


def _rank(bound: tuple[tuple, int]) -> tuple:
    """A bound as Spark sorts it: nulls first."""
    return tuple((v is not None, v) if v is not None else (False,) for v in (*bound[0], bound[1]))


def cuts(sampled: list[tuple[tuple, int, float]], runs: int) -> list[tuple[tuple, int]]:
    """The (keys, time) at which runs of about equal weight begin, the first one left out."""
    sampled = sorted((((k, t), w) for k, t, w in sampled), key=lambda x: _rank(x[0]))
    step, upto, out = sum(w for _, w in sampled) / runs, 0.0, []
    for bound, w in sampled:
        if upto + w / 2 > step * (len(out) + 1) and (not out or out[-1] != bound):
            out.append(bound)
        upto += w
    return out[: runs - 1]


def _ahead(keys: Sequence[str], t: Column, bound: tuple[tuple, int]) -> Column:
    """Whether a row stands before a bound."""
    out = t < F.lit(bound[1])
    for k, v in reversed(list(zip(map(F.col, keys), bound[0], strict=True))):
        if v is None:
            out = F.when(k.isNull(), out).otherwise(False)
        else:
            out = F.when(k.isNull() | (k < F.lit(v)), True).when(k == F.lit(v), out).otherwise(False)
    return out


def _run_of(keys: Sequence[str], t: Column, bounds: list[tuple[tuple, int]], first: int = 0) -> Column:
    """The number of the row's run: a search that halves the bounds at each step, in built-in expressions."""
    if not bounds:
        return F.lit(first)
    m = len(bounds) // 2
    return F.when(_ahead(keys, t, bounds[m]), _run_of(keys, t, bounds[:m], first)).otherwise(_run_of(keys, t, bounds[m + 1 :], first + m + 1))


#: Stands for a time that is missing; such rows come first.
NO_TIME = -(1 << 63)


def sampled_rows(df: DataFrame, tl: Timeline) -> list[tuple[tuple, int, float]]:
    """(keys, time, weight) of sampled rows."""
    at = [f"k{i}" for i in range(len(tl.keys))]
    key = [F.col(k).alias(a) for k, a in zip(tl.keys, at, strict=True)]
    rows = df.select(*key, F.coalesce(F.unix_micros(tl.time), F.lit(NO_TIME)).alias("t"), F.xxhash64(*tl.keys, *tl.order).alias("h"))
    out = T.StructType([*rows.schema.fields[:-1], T.StructField("w", T.DoubleType())])
    got = rows.mapInArrow(_taken, out).repartition(LANES).mapInArrow(_thinned, out).collect()
    return [(tuple(r[a] for a in at), r["t"], r["w"]) for r in got]


def in_runs(df: DataFrame, tl: Timeline = DEVICE_TIME, runs: int | None = None) -> DataFrame:
    """`df` in order of keys and time, cut in runs of about equal size; as it is if it already is in runs.

    There are as many runs as shuffle partitions, unless `runs` says otherwise.
    """
    if RUN in df.columns:
        return df
    tl = tl.of(df)
    n = runs or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    number = _run_of(tl.keys, F.coalesce(F.unix_micros(tl.time), F.lit(NO_TIME)), cuts(sampled_rows(df, tl), n))
    return df.withColumn(RUN, number).repartitionById(n, F.col(RUN)).sortWithinPartitions(*tl.keys, *tl.order)


def _changes(batch: pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """Whether each row's key differs from that of the row before; the first row counts as different."""
    out = np.zeros(batch.num_rows, bool)
    out[:1] = True
    for k in keys:
        codes = pc.fill_null(batch.column(k).dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        out[1:] |= codes[1:] != codes[:-1]
    return out


def _key(batch: pa.RecordBatch, keys: Sequence[str], i: int) -> tuple:
    return tuple(batch.column(k)[i].as_py() for k in keys)


def _along(values: np.ndarray, starts: np.ndarray, op: np.ufunc) -> np.ndarray:
    """Running values of `op` within groups that begin at `starts`."""
    out = np.empty_like(values)
    for i, j in zip(starts, [*starts[1:], len(values)], strict=True):
        op.accumulate(values[i:j], out=out[i:j])
    return out


class _Running:
    """One running column: what the rows so far of the current key leave behind, and its values over a batch."""

    def __init__(self, kind: str, carried: pa.Array | None):
        self.kind, self.carried = kind, carried

    def over(self, col: pa.Array, fresh: np.ndarray) -> pa.Array:
        """`fresh` marks the first rows of keys; row 0 isn't marked if it goes on with the key of the batch before."""
        n, at = len(col), np.arange(len(col))
        begin = np.maximum.accumulate(np.where(fresh, at, -1))
        if self.carried is None or fresh[0]:
            self.carried = pa.nulls(1, col.type)
        if self.kind == "items_before":
            return self._items(col, begin)
        valid = col.is_valid().to_numpy(zero_copy_only=False)
        if self.kind == "lag":
            source = np.where(fresh, NONE, at - 1)
            keep = n - 1
        else:
            upto = np.maximum.accumulate(np.where(valid, at, -1))
            before = np.concatenate([[-1], upto[:-1]])
            upto = np.where(upto >= begin, upto, NONE)
            before = np.where(before >= begin, before, NONE)
            if self.kind not in ("last", "last_before"):
                none = -1 if self.carried[0].is_valid else NONE
                seen = np.where(upto == -1, none, upto) != NONE
                col = self._worked(col, valid, fresh, seen)
                upto, before = np.where(seen, at, NONE), np.where(np.where(before == -1, none, before) == NONE, NONE, at - 1)
            source = before if self.kind.endswith("before") else upto
            keep = upto[n - 1]
        every = pa.concat_arrays([self.carried, col])
        out = every.take(pa.array(source + 1, mask=source == NONE))
        self.carried = pa.nulls(1, col.type) if keep == NONE else every.slice(int(keep) + 1, 1)
        return out

    def _items(self, col: pa.StructArray, begin: np.ndarray) -> pa.Array:
        """For each item of a list the last value known at its place before this row; `reset` on a row forgets all before it."""
        n, (reset, lists) = len(col), col.flatten()
        reset = pc.fill_null(reset, False).to_numpy(zero_copy_only=False)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        starts = lists.offsets.to_numpy()[:-1].astype(np.int64)
        ends = np.cumsum(sizes)
        row = np.repeat(np.arange(n), sizes)
        place = np.arange(len(row)) - np.repeat(ends - sizes, sizes)
        values = lists.values.take(pa.array(starts[row] + place))
        old = pc.list_flatten(self.carried.flatten()[1]) if self.carried[0].is_valid else values.slice(0, 0)
        wide = max(int(sizes.max(initial=0)), len(old))
        # row i + 1 has the position, among old and new values, of what row i leaves at each place
        at = np.full((n + 1, wide), NONE)
        at[0, : len(old)] = np.arange(len(old))
        known = values.is_valid().to_numpy(zero_copy_only=False)
        at[row[known] + 1, place[known]] = len(old) + np.flatnonzero(known)
        # positions grow with the rows, so the greatest is the last; one from before the key's or the lists' begin counts for nothing
        at = np.maximum.accumulate(at, axis=0)
        since = np.maximum(begin, np.maximum.accumulate(np.where(reset, np.arange(n), -1)))
        least = np.where(since < 0, 0, len(old) + (ends - sizes)[since])
        every = pa.concat_arrays([old, values])
        source = at[row, place]
        before = every.take(pa.array(source, mask=source < least[row]))
        offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
        left = every.take(pa.array(at[n], mask=at[n] < least[n - 1]))
        begun = begin[n - 1] < 0 and self.carried[0].is_valid and self.carried[0]["reset"].as_py()
        was_reset = pa.array([bool(begun or reset[max(begin[n - 1], 0) :].any())])
        made = lambda r, o, v: pa.StructArray.from_arrays([r, pa.ListArray.from_arrays(o, v)], names=["reset", "items"])
        self.carried = made(was_reset, pa.array([0, wide], pa.int32()), left)
        return made(pa.array(reset), offsets, before)

    def _worked(self, col: pa.Array, valid: np.ndarray, fresh: np.ndarray, seen: np.ndarray) -> pa.Array:
        """Running sums or extremes, zero where no value was seen yet."""
        whole = pa.types.is_integer(col.type)
        op, neutral = {
            "total": (np.add, 0),
            "high": (np.maximum, np.iinfo(np.int64).min if whole else -np.inf),
            "low": (np.minimum, np.iinfo(np.int64).max if whole else np.inf),
        }[self.kind.removesuffix("_before")]
        given = pc.fill_null(col, 0).to_numpy(zero_copy_only=False).astype(np.int64 if whole else np.float64)
        x = np.where(valid, given, neutral)
        starts = np.flatnonzero(fresh)
        if not fresh[0]:
            starts = np.concatenate([[0], starts])
            if self.carried[0].is_valid:
                x[0] = op(x[0], self.carried[0].as_py())
        return pa.array(np.where(seen, _along(x, starts, op), 0)).cast(col.type)


def _heads(keys: Sequence[str], wanted: Mapping[str, tuple[str, str]], order: Sequence[str]):
    """Task function: the head of a run, one row: its first and last key, and what the last key's rows leave behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = running = key = no = None
        single = True
        types: dict[str, pa.DataType] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            fresh = _changes(batch, keys)
            if first is None:
                first, no = batch.slice(0, 1), batch.column(RUN)[0].as_py()
                running = {o: _Running(kind, None) for o, (kind, _) in wanted.items()}
                types = {o: batch.column(arg).type for o, (_, arg) in wanted.items()}
                single = not fresh[1:].any()
            else:
                fresh[0] = _key(batch, keys, 0) != key
                single = single and not fresh.any()
            key, last = _key(batch, keys, batch.num_rows - 1), batch.slice(batch.num_rows - 1, 1)
            for o, r in running.items():
                r.over(batch.column(wanted[o][1]), fresh)
        if first is not None:
            left = [running[o].carried if running[o].carried is not None else pa.nulls(1, types[o]) for o in wanted]
            cols = [pa.array([no], pa.int32()), *[first.column(c) for c in (*keys, *order)], *[last.column(k) for k in keys], pa.array([single]), *left]
            yield pa.RecordBatch.from_arrays(cols, names=[RUN, *[f"__a{i}" for i in range(len(keys) + len(order))], *[f"__z{i}" for i in range(len(keys))], "__single", *[HEAD + o for o in wanted]])

    return run


def _joined_heads(n_keys: int, wanted: Mapping[str, tuple[str, str]]):
    """Task function over all heads in order: what each run's first key brings along."""

    def later(kind: str, old: pa.Scalar, new: pa.Scalar):
        if kind == "lag":
            return new
        if not new.is_valid or not old.is_valid:
            return new if new.is_valid else old
        base = kind.removesuffix("_before")
        if base == "items":
            a, b = old.as_py(), new.as_py()
            return new if b["reset"] else pa.scalar({"reset": a["reset"], "items": [y if y is not None else x for x, y in zip_longest(a["items"], b["items"])]}, new.type)
        if base.startswith("last"):
            return new
        a, b = old.as_py(), new.as_py()
        return pa.scalar(a + b if base == "total" else max(a, b) if base == "high" else min(a, b), new.type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            rows: dict[str, list] = {o: [] for o in wanted}
            goes = []
            for i in range(batch.num_rows):
                a, z = (tuple(batch.column(f"__{x}{k}")[i].as_py() for k in range(n_keys)) for x in "az")
                on = key is not None and key == (a,)
                goes.append(on)
                for o, (kind, _) in wanted.items():
                    new = batch.column(HEAD + o)[i]
                    rows[o].append(state[o] if on else pa.scalar(None, new.type))
                    state[o] = later(kind, state[o], new) if on and batch.column("__single")[i].as_py() else new
                key = (z,)
            cols = [pa.array([s.as_py() for s in rows[o]], batch.column(HEAD + o).type) for o in wanted]
            at = [f"__a{k}" for k in range(batch.num_columns) if f"__a{k}" in batch.schema.names]
            yield pa.RecordBatch.from_arrays([batch.column(RUN), *[batch.column(c) for c in at], pa.array(goes), *cols], names=[RUN, *at, "__goes_on", *[HEAD + o for o in wanted]])

    return run


def _checked(batch: pa.RecordBatch, columns: Sequence[str]) -> None:
    """The run's first row must be the one that its head was made from."""
    if any(batch.column(c)[0].as_py() != batch.column(f"__a{i}")[0].as_py() for i, c in enumerate(columns)):
        raise RuntimeError("a run doesn't begin with the row that its head was made from; are the rows the same at each read?")


def _scanned(keys: Sequence[str], order: Sequence[str], keep: Sequence[str], wanted: Mapping[str, tuple[str, str]]):
    """Task function: every row with the running columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        running, key = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            fresh = _changes(batch, keys)
            if running is None:
                _checked(batch, [*keys, *order])
                fresh[0] = not batch.column("__goes_on")[0].as_py()
                running = {o: _Running(kind, batch.column(HEAD + o).slice(0, 1)) for o, (kind, _) in wanted.items()}
            else:
                fresh[0] = _key(batch, keys, 0) != key
            key = _key(batch, keys, batch.num_rows - 1)
            made = [r.over(batch.column(wanted[o][1]), fresh) for o, r in running.items()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *made], names=[*keep, *wanted])

    return run


def released(out: DataFrame, given: DataFrame) -> DataFrame:
    """`out` without RUN, unless the table that was given had it."""
    return out if RUN in given.columns else out.drop(RUN)


def with_heads(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """`rows`, the first of each run with its head's columns; the heads, one a partition, are broadcast."""
    first = F.when(F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0, F.col(RUN))
    rows = rows.withColumn(FIRST, first)
    heads = heads.withColumnRenamed(RUN, FIRST)
    return rows.join(F.broadcast(heads), FIRST, "left").drop(FIRST)


def head_schema(rows: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[T.StructField]) -> tuple[T.StructType, T.StructType]:
    """Schemas of heads as made, and as handed on."""
    at = [T.StructField(f"__a{i}", rows.schema[c].dataType) for i, c in enumerate([*keys, *order])]
    last = [T.StructField(f"__z{i}", rows.schema[c].dataType) for i, c in enumerate(keys)]
    no = T.StructField(RUN, T.IntegerType())
    made = T.StructType([no, *at, *last, T.StructField("__single", T.BooleanType()), *columns])
    return made, T.StructType([no, *at, T.StructField("__goes_on", T.BooleanType()), *columns])


def joined_back(rows: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[T.StructField], head: Callable, join: Callable) -> DataFrame:
    """`rows` in runs with what each run's first key brings along, by the task functions for heads and for their row."""
    made, handed = head_schema(rows, keys, order, columns)
    heads = rows.mapInArrow(head, made).repartition(1).sortWithinPartitions(RUN).mapInArrow(join, handed)
    return with_heads(rows, heads)


def _with_unknown(t: T.StructType) -> T.StructType:
    """The type of (reset, items) where items may be missing."""
    return T.StructType([T.StructField("reset", T.BooleanType()), T.StructField("items", T.ArrayType(t["items"].dataType.elementType))])


def scan(
    df: DataFrame,
    tl: Timeline = DEVICE_TIME,
    *,
    lag: Mapping[str, Column] | None = None,
    last: Mapping[str, Column] | None = None,
    last_before: Mapping[str, Column] | None = None,
    total: Mapping[str, Column] | None = None,
    total_before: Mapping[str, Column] | None = None,
    high: Mapping[str, Column] | None = None,
    low: Mapping[str, Column] | None = None,
    high_before: Mapping[str, Column] | None = None,
    low_before: Mapping[str, Column] | None = None,
    items_before: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add running columns along each key's timeline.

    lag          value on the previous row
    last         latest non-null value up to this row
    total        running sum of numbers up to this row, null before the first one
    high, low    running maximum / minimum of numbers up to this row
    .._before    the same without this row
    items_before from structs of (reset, items): the same struct with the last value known at each place of the list before this row;
                 a row whose reset is true knows none, and hides the rows before it

    A table in runs stays in runs; any other is brought in runs, and comes back without RUN.
    """
    given = dict(zip(KINDS, (lag, last, last_before, total, total_before, high, low, high_before, low_before, items_before), strict=True))
    tl = tl.of(df)
    rows = in_runs(df, tl)
    wanted = {out: (kind, f"__in_{out}") for kind, cols in given.items() for out in cols or {}}
    args = {f"__in_{out}": col for cols in given.values() for out, col in (cols or {}).items()}
    keep = list(rows.columns)
    rows = rows.select("*", *[col.alias(a) for a, col in args.items()])
    # sums are kept in 64 bits, as Spark's own
    wide = {a: "bigint" if isinstance(rows.schema[a].dataType, T.IntegralType) else "double" for o, (kind, a) in wanted.items() if kind.startswith("total")}
    rows = rows.withColumns({a: F.col(a).cast(kind) for a, kind in wide.items()}) if wide else rows

    kinds = {o: _with_unknown(rows.schema[a].dataType) if kind == "items_before" else rows.schema[a].dataType for o, (kind, a) in wanted.items()}
    fields = [T.StructField(HEAD + o, t) for o, t in kinds.items()]
    with_carry = joined_back(rows, tl.keys, tl.order, fields, _heads(tl.keys, wanted, tl.order), _joined_heads(len(tl.keys), wanted))
    schema = T.StructType([*[rows.schema[c] for c in keep], *[T.StructField(o, t) for o, t in kinds.items()]])
    out = with_carry.mapInArrow(_scanned(tl.keys, tl.order, keep, wanted), schema)
    return released(out, df)
