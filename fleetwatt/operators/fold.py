"""Run a sequential state machine over every device's ordered samples.

A fold is written once, as a step function, and runs in batch (here) and in streaming
(`fleetwatt.streaming.folds`). What a task must know is the state at its first row:

* A *composable* fold condenses rows into a summary from which the state after them follows from the state before
  them. It runs over range partitions (`prefix`): one shuffle, a summary for the last key of each run, and then rows with
  the exact start state. Folds and scans in a row share the shuffle.
* Any other fold runs over the slices of `timeline`. It starts every slice cold, hands the end state of each slice to the next one, and
  repeats for the slices whose start state moved, until none does. The first slice is exact from the
  start, and each round makes at least the next slice exact, so the fixed point is the sequential
  result. Filters that forget their past settle in two or three rounds; for those that do not, each round
  follows a moved state through twice as many slices as the round before.

Rows stream through `mapInArrow`: one Arrow batch is in memory, never a device or a slice. Only the
state table (one row per device and slice) is written to the checkpoint folder.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from itertools import groupby
from operator import itemgetter
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from fleetwatt.operators import prefix
from fleetwatt.operators.timeline import CARRIED, DEVICE_TIME, SLICE, Timeline
from fleetwatt.session import checkpointed

STATE = "__state"
RUN = "__run"


class Fold:
    """Base of all folds; `step` must depend on nothing but its arguments.

    `inputs` names the values a step gets, in order; `output` is the DDL of what it returns.
    States and summaries are made of numbers, strings, booleans, None and lists of these.
    """

    inputs: Sequence[str] = ()
    output: str = "out double"

    def init(self) -> Any:
        return None

    def step(self, state: Any, row: tuple) -> tuple[Any, tuple]:
        raise NotImplementedError


class ComposableFold(Fold):
    """`advance(state, summarise(rows))` is the state after stepping through `rows`."""

    def summarise(self, rows: Iterator[tuple]) -> Any:
        raise NotImplementedError

    def advance(self, state: Any, summary: Any) -> Any:
        raise NotImplementedError


def _lists(batch: pa.RecordBatch, names: Sequence[str]) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types)], schema=schema)


def _ends(fold: Fold, keys: Sequence[str], inputs: Sequence[str], schema: pa.Schema):
    """Task function over runs of slices: the state each slice ended with, and the one it started from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = sl = used = state = None
        for batch in batches:
            done = []
            ids = list(zip(*_lists(batch, [*keys, RUN])))
            slices, heads, states = _lists(batch, [SLICE, CARRIED, STATE])
            args = list(zip(*_lists(batch, inputs)))
            for key, s, head, start, row in zip(ids, slices, heads, states, args):
                if (key, s) != (at, sl):
                    if at is not None:
                        used_next = json.dumps(state)
                        done.append((*at[:-1], sl, used_next, used))
                    if key != at:
                        state, used_next = fold.init(), None
                    at, sl, used = key, s, used_next
                if head:
                    state, used = json.loads(start), start
                else:
                    state, _ = fold.step(state, row)
            yield _batch(done, schema)
        if at is not None:
            yield _batch([(*at[:-1], sl, json.dumps(state), used)], schema)

    return run


def _emit(fold: Fold, keys: Sequence[str], inputs: Sequence[str], keep: Sequence[str], out: pa.Schema):
    """Task function: every sample with the fold's output columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        n_out = len(out)
        for batch in batches:
            ids = list(zip(*_lists(batch, keys)))
            heads, states = _lists(batch, [CARRIED, STATE])
            args = list(zip(*_lists(batch, inputs)))
            results: list[tuple] = []
            for key, head, start, row in zip(ids, heads, states, args):
                if key != at:
                    at, state = key, fold.init()
                if head:
                    state = json.loads(start)
                else:
                    state, got = fold.step(state, row)
                    results.append(got)
            kept = batch.select(list(keep)).filter(pa.array([not h for h in heads]))
            cols = list(zip(*results)) if results else [()] * n_out
            made = [pa.array(c, t) for c, t in zip(cols, out.types)]
            yield pa.RecordBatch.from_arrays([*kept.columns, *made], names=[*keep, *out.names])

    return run


def _run_heads(fold: ComposableFold, keys: Sequence[str], order: Sequence[str], inputs: Sequence[str], schema: pa.Schema):
    """Task function: the summary of the last key of a run. Of a batch only the rows of its last key are looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: list = []
        seen = {"no": None, "key": None, "last": None, "single": True}

        def rows():
            group = 0
            for batch in batches:
                if not batch.num_rows:
                    continue
                fresh = prefix._changes(batch, keys)
                if not first:
                    first.extend(batch.column(c)[0].as_py() for c in (*keys, *order))
                    seen["no"] = batch.column(prefix.RUN)[0].as_py()
                    fresh[0] = False
                else:
                    fresh[0] = prefix._key(batch, keys, 0) != seen["last"]
                seen["last"] = prefix._key(batch, keys, batch.num_rows - 1)
                starts = fresh.nonzero()[0]
                begin = 0
                if len(starts):
                    seen["single"] = False
                    group, begin = group + 1, int(starts[-1])
                for row in zip(*_lists(batch.slice(begin), inputs)):
                    yield group, row

        summary = None
        for _, group in groupby(rows(), key=itemgetter(0)):
            summary = fold.summarise(row for _, row in group)
        if first:
            yield _batch([(seen["no"], *first, *seen["last"], seen["single"], json.dumps(summary))], schema)

    return run


def _run_states(fold: ComposableFold, n_keys: int, n_order: int, schema: pa.Schema):
    """Task function over all heads in order: the state that each run's first key brings along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                no, at, last, (single, summary) = row[0], row[1 : 1 + n_keys + n_order], row[1 + n_keys + n_order : -2], row[-2:]
                on = key is not None and key == (at[:n_keys],)
                done.append((no, *at, on, json.dumps(state) if on else None))
                state = fold.advance(state if on and single else fold.init(), json.loads(summary))
                key = (last,)
            yield _batch(done, schema)

    return run


def _run_rows(fold: ComposableFold, keys: Sequence[str], order: Sequence[str], inputs: Sequence[str], keep: Sequence[str], out: pa.Schema):
    """Task function: every row of a run with the fold's output columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, begun = None, None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            fresh = prefix._changes(batch, keys)
            if not begun:
                begun = True
                prefix._checked(batch, [*keys, *order])
                fresh[0] = not batch.column("__goes_on")[0].as_py()
                state = None if fresh[0] else json.loads(batch.column(prefix.HEAD + STATE)[0].as_py())
            else:
                fresh[0] = prefix._key(batch, keys, 0) != last
            last = prefix._key(batch, keys, batch.num_rows - 1)
            results = []
            for new, row in zip(fresh.tolist(), zip(*_lists(batch, inputs))):
                state, got = fold.step(fold.init() if new else state, row)
                results.append(got)
            made = [pa.array(c, t) for c, t in zip(zip(*results), out.types)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *made], names=[*keep, *out.names])

    return run


def _fold_in_runs(df: DataFrame, fold: ComposableFold, args: Mapping[str, Column], tl: Timeline) -> DataFrame:
    keys, order = list(tl.keys), list(tl.order)
    rows = prefix.in_runs(df, tl)
    keep, named = list(rows.columns), [f"__arg_{n}" for n in fold.inputs]
    fields = [rows.schema[c] for c in keep]
    rows = rows.select("*", *[args[n].alias(a) for n, a in zip(fold.inputs, named)])
    state = [T.StructField(prefix.HEAD + STATE, T.StringType())]
    made, handed = prefix.head_schema(rows, keys, order, state)
    heads, states = _run_heads(fold, keys, order, named, _arrow(made)), _run_states(fold, len(keys), len(order), _arrow(handed))
    out = T.StructType.fromDDL(fold.output)
    ready = prefix.joined_back(rows, keys, order, state, heads, states)
    told = ready.mapInArrow(_run_rows(fold, keys, order, named, keep, _arrow(out)), T.StructType([*fields, *out.fields]))
    return prefix.released(told, df)


def _arrow(schema: T.StructType) -> pa.Schema:
    return pa.schema([(f.name, _arrow_type(f.dataType)) for f in schema.fields])


#: Arrow types of the keys, states and outputs that folds use
_ARROW = {
    T.StringType(): pa.string(),
    T.BinaryType(): pa.binary(),
    T.BooleanType(): pa.bool_(),
    T.IntegerType(): pa.int32(),
    T.LongType(): pa.int64(),
    T.FloatType(): pa.float32(),
    T.DoubleType(): pa.float64(),
    T.DateType(): pa.date32(),
    T.TimestampType(): pa.timestamp("us", "UTC"),
    T.TimestampNTZType(): pa.timestamp("us"),
}


def _arrow_type(t: T.DataType) -> pa.DataType:
    return pa.list_(_arrow_type(t.elementType)) if isinstance(t, T.ArrayType) else _ARROW[t]


def run_fold(
    df: DataFrame,
    fold: Fold,
    args: Mapping[str, Column],
    tl: Timeline = DEVICE_TIME,
    max_rounds: int = 10_000,
) -> DataFrame:
    """`df` plus the fold's output columns; `args` gives a column for each of `fold.inputs`."""
    tl = tl.of(df)
    if isinstance(fold, ComposableFold):
        return _fold_in_runs(df, fold, args, tl)
    keys, keep = list(tl.keys), list(df.columns)
    named = [f"__arg_{n}" for n in fold.inputs]
    rows = tl.sliced(df).select("*", *[args[n].alias(a) for n, a in zip(fold.inputs, named)])
    slim = rows.select(*keys, SLICE, *[c for c in tl.order if c not in keys], *named)

    key_fields = [df.schema[k] for k in keys]
    state_schema = T.StructType([*key_fields, T.StructField(SLICE, T.LongType()), T.StructField(STATE, T.StringType())])

    def ordered(part: DataFrame, heads: DataFrame | None, by: str = SLICE) -> DataFrame:
        part = part.withColumn(CARRIED, F.lit(False))
        if heads is None:
            part = part.withColumn(STATE, F.lit(None).cast("string"))
        else:
            part = part.unionByName(heads.withColumn(CARRIED, F.lit(True)), allowMissingColumns=True)
        return part.repartition(*keys, by).sortWithinPartitions(*keys, by, F.col(CARRIED).desc(), *tl.order)

    used_schema = T.StructType([*state_schema.fields, T.StructField("__used", T.StringType())])
    ends = _ends(fold, keys, named, _arrow(used_schema))
    heads = _settle(slim, lambda part, heads: ordered(part, heads, RUN).mapInArrow(ends, used_schema), keys, max_rounds)
    out_schema = T.StructType([*df.schema.fields, *T.StructType.fromDDL(fold.output).fields])
    out_arrow = _arrow(T.StructType.fromDDL(fold.output))
    emitted = ordered(rows, heads).mapInArrow(_emit(fold, [*keys, SLICE], named, keep, out_arrow), out_schema)
    return emitted


def _settle(slim: DataFrame, ends_of, keys: Sequence[str], max_rounds: int) -> DataFrame:
    """Hand end states forward until no slice starts from another state than the one it ran with."""
    slim = slim.persist(StorageLevel.DISK_ONLY)  # read once per round; dropped when the rounds are over
    try:
        return _rounds(slim, ends_of, keys, max_rounds)
    finally:
        slim.unpersist()


def _rounds(slim: DataFrame, ends_of, keys: Sequence[str], max_rounds: int) -> DataFrame:
    by_slice = Window.partitionBy(*keys).orderBy(SLICE)
    ids = [*keys, SLICE]
    ends = ends_of(slim.withColumn(RUN, F.col(SLICE)), None)
    for turn in range(max_rounds):
        table = ends.select(*ids, STATE, "__used").withColumn("__entry", F.lag(STATE).over(by_slice))
        moved = ~F.col("__entry").eqNullSafe(F.col("__used"))
        table = table.withColumn("__nth", F.row_number().over(by_slice)).withColumn("__moved", moved)
        table = checkpointed(table)
        if table.filter("__moved").isEmpty():
            return table.filter("__entry IS NOT NULL").select(*ids, F.col("__entry").alias(STATE))
        # a run: a moved slice and the slices behind it, more of them each round
        begin = F.last(F.when(F.col("__moved"), F.struct("__nth", SLICE)), ignorenulls=True).over(by_slice)
        span = 2 ** max(0, turn - 1)
        runs = table.withColumn("__begin", begin).filter(F.col("__nth") - F.col("__begin.__nth") < span)
        runs = runs.select(*ids, F.col(f"__begin.{SLICE}").alias(RUN))
        heads = table.filter("__moved").select(*ids, F.col(SLICE).alias(RUN), F.col("__entry").alias(STATE))
        redone = ends_of(slim.join(runs, ids), heads)
        ends = table.join(runs.select(*ids), ids, "left_anti").select(*ids, STATE, "__used").unionByName(redone)
    raise RuntimeError("the fold did not settle")
