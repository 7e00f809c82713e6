"""The folds of `fleetwatt.operators` on a stream: the same step functions, in event-time order.

A micro-batch brings rows of a key in any order. They wait in keyed state until the watermark has
passed them, are then stepped in order, and only then emitted, so the stream gives the rows the batch
runner gives. Waiting rows lie in a map by time bucket, and a batch reads only the buckets that are due or get new rows, so
what it touches doesn't grow with the delay. A key of which many rows come at once puts them aside in runs, each in order and cut
in small pieces, and merges the runs piece by piece when they are due: a task holds `HELD_ROWS` rows and a piece of each run.

There are two clocks. With Spark's watermark, rows behind it are dropped before they reach the state; `late_policy` can put rows
aside by their age before. With `keep_late`, each key has a clock of its own in its state, the greatest time seen less the delay, and
rows behind that come out marked as late, so that no row is lost: `run.split_late` writes them to a table of their own.
"""

from __future__ import annotations

import base64
import json
from bisect import bisect_left
from collections.abc import Iterator, Mapping, Sequence
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fleetwatt.functions.scalar import is_fresh, parse_algorithm
from fleetwatt.operators.fold import Fold
from fleetwatt.operators.folds import PackTemperature, SocController
from fleetwatt.operators.frames import Reassemble
from fleetwatt.operators.joins import AMBIENT_MAX_AGE_S
from fleetwatt.operators.meters import CHARGE_STEP_MAX, CYCLE_STEP_MAX, DIFF_GAP_S, METERS
from fleetwatt.operators.timeline import DEVICE_TIME, Timeline, micros

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Meters(Fold):
    """Running readings of the six meters."""

    inputs = ("t_us", "current", "power", "soc", "charge")
    output = ", ".join(f"{m} double" for m in METERS)

    def __init__(self, gap_s: float, invert: bool = False):
        self.gap_h, self.sign = gap_s / 3600.0, -1.0 if invert else 1.0

    def init(self):
        # last known (t, current), (t, power), previous (t, soc, charge), readings
        return [None, None, None, [0.0] * len(METERS)]

    def _area(self, t, y, last) -> float:
        dx = (t - last[0]) / 3.6e9
        return dx * (last[1] + y) / 2 if dx <= self.gap_h else 0.0

    def step(self, state, row):
        t, current, power, soc, charge = row
        amps, watts, before, total = state
        total = list(total)
        if current is not None:
            if amps is not None:
                total[0] += self.sign * self._area(t, current, amps)
            amps = [t, current]
        if power is not None:
            if watts is not None:
                parts = ((lambda p: p), (lambda p: max(p, 0.0)), (lambda p: abs(min(p, 0.0))))
                for i, part in enumerate(parts, start=1):
                    area = self._area(t, part(power) * 1e-3, [watts[0], part(watts[1]) * 1e-3])
                    total[i] += self.sign * area if i == 1 else area
            watts = [t, power]
        if before is not None and (t - before[0]) / 3.6e9 <= DIFF_GAP_S / 3600.0:
            if soc is not None and before[1] is not None:
                d = abs(soc * 0.005 - before[1] * 0.005)
                total[4] += d if d <= CYCLE_STEP_MAX else 0.0
            if charge is not None and before[2] is not None:
                d = abs(charge - before[2])
                total[5] += d if d <= CHARGE_STEP_MAX else 0.0
        return [amps, watts, [t, soc, charge], total], tuple(total)


def _plain(v):
    """A cell as JSON can hold it; NaN and NaT are missing, arrays become lists."""
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, (list, tuple, np.ndarray)):
        return [_plain(x) for x in (v.tolist() if isinstance(v, np.ndarray) else v)]
    return v.item() if isinstance(v, np.generic) else v


def _bytes_out(v):
    return {"__bytes": base64.b64encode(bytes(v)).decode()}


def _bytes_back(d: dict):
    return base64.b64decode(d["__bytes"]) if set(d) == {"__bytes"} else d


#: Width of a bucket of waiting rows.
BUCKET_US = 60_000_000
#: Rows of a key that are held at once, and of a piece of a run; fewer than a piece go to buckets.
HELD_ROWS, PIECE_ROWS = 50_000, 500

IN_ORDER = itemgetter(0, 1)


class FoldProcessor(StatefulProcessor):
    """Buffers rows of one key until its clock has passed them, then steps them in order."""

    def __init__(self, fold: Fold, keys: Sequence[str], names: Sequence[str], outputs: Sequence[str], own_delay_us: int | None = None):
        self.fold, self.keys, self.names, self.outputs, self.own_delay = fold, list(keys), list(names), list(outputs), own_delay_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("fold", "state string")
        self.waiting = handle.getMapState("waiting", "bucket bigint", "rows string")
        #: the buckets that hold rows, and the least time in each
        self.index = handle.getValueState("index", "buckets string")
        self.runs = handle.getMapState("runs", "piece bigint", "rows string")
        #: the pieces of runs, and the least time in each
        self.pieces = handle.getValueState("pieces", "pieces string")
        self.clock = handle.getValueState("clock", "t bigint")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.state.update((initialState["state"].iloc[0],))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = None
        if self.own_delay is None:
            limit = timerValues.getCurrentWatermarkInMs() * 1000
        else:
            passed = limit = self.clock.get()[0] if self.clock.exists() else None
        held = []
        for pdf in rows:
            cols = [[_plain(v) for v in pdf[c].tolist()] for c in self.names]
            fresh = [list(r) for r in zip(*cols)]
            if self.own_delay is not None:
                late = [r for r in fresh if passed is not None and r[0] <= passed]
                fresh = [r for r in fresh if passed is None or r[0] > passed]
                limit = max([r[0] - self.own_delay for r in fresh] + ([] if limit is None else [limit]))
                if late:
                    yield self._frame([(*key, r[0], r[1], *[None] * len(self.outputs), True) for r in late])
            held += fresh
            if len(held) >= HELD_ROWS:
                pieces = self._known(self.pieces)
                self._put_run(held, pieces)
                self._keep(self.pieces, pieces)
                held = []
        if self.own_delay is not None:
            self.clock.update((limit,))
        yield from self._advance(key, held, limit)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, [], timerValues.getCurrentWatermarkInMs() * 1000)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[*self.keys, "t_us", "seq", *self.outputs, *([] if self.own_delay is None else ["late"])])

    def _read(self, number: int, store=None) -> list:
        return json.loads((store or self.waiting).getValue((number,))[0], object_hook=_bytes_back)

    def _known(self, index) -> dict[int, int]:
        return dict(json.loads(index.get()[0])) if index.exists() else {}

    def _keep(self, index, known: dict[int, int]) -> None:
        if known != self._known(index):
            index.update((json.dumps(sorted(known.items())),))

    def _put_run(self, rows: list, pieces: dict[int, int]) -> None:
        rows.sort(key=IN_ORDER)
        first = max(pieces, default=-1) + 1
        for i, at in enumerate(range(0, len(rows), PIECE_ROWS)):
            self.runs.updateValue((first + i,), (json.dumps(rows[at : at + PIECE_ROWS], default=_bytes_out),))
            pieces[first + i] = rows[at][0]

    def _put_buckets(self, rows: list, buckets: dict[int, int]) -> None:
        put: dict[int, list] = {}
        for r in rows:
            put.setdefault(r[0] // BUCKET_US, []).append(r)
        for bucket, new in put.items():
            every = (self._read(bucket) if bucket in buckets else []) + new
            buckets[bucket] = min(r[0] for r in every)
            self.waiting.updateValue((bucket,), (json.dumps(every, default=_bytes_out),))

    def _due(self, fresh: list, limit: int, buckets: dict[int, int], pieces: dict[int, int]) -> Iterator[list]:
        """Rows up to `limit` in order, part by part; the others are put to buckets or a run."""
        due, rest = [r for r in fresh if r[0] <= limit], [r for r in fresh if r[0] > limit]
        stored = [(least, n, index, store) for index, store in ((buckets, self.waiting), (pieces, self.runs)) for n, least in index.items() if least <= limit]
        full = HELD_ROWS
        for least, n, index, store in sorted(stored, key=itemgetter(0)):
            if len(due) >= full:
                due.sort(key=IN_ORDER)
                # what is not read yet has no row before `least`
                ready = bisect_left(due, least, key=itemgetter(0))
                if ready:
                    yield due[:ready]
                due = due[ready:]
                full = len(due) + HELD_ROWS
            rows = self._read(n, store)
            due += [r for r in rows if r[0] <= limit]
            rest += [r for r in rows if r[0] > limit]
            store.removeKey((n,))
            del index[n]
        if due:
            yield sorted(due, key=IN_ORDER)
        if len(rest) < PIECE_ROWS:
            self._put_buckets(rest, buckets)
        else:
            self._put_run(rest, pieces)

    def _released(self, fresh: list, limit: int) -> Iterator[list]:
        """Rows that the clock has passed, in order, part by part; the others wait."""
        buckets, pieces = self._known(self.index), self._known(self.pieces)
        yield from self._due(fresh, limit, buckets, pieces)
        self._keep(self.index, buckets)
        self._keep(self.pieces, pieces)
        if (buckets or pieces) and self.own_delay is None:
            self.handle.registerTimer(-(-min([*buckets.values(), *pieces.values()]) // 1000))

    def _advance(self, key, fresh: list, limit: int) -> Iterator[pd.DataFrame]:
        state = None
        for due in self._released(fresh, limit):
            if state is None:
                state = json.loads(self.state.get()[0], object_hook=_bytes_back) if self.state.exists() else self.fold.init()
            out = []
            for r in due:
                state, got = self.fold.step(state, tuple(r[2:]))
                out.append((*key, r[0], r[1], *got, *([] if self.own_delay is None else [False])))
            yield self._frame(out)
        if state is not None:
            self.state.update((json.dumps(state, default=_bytes_out),))

    def close(self) -> None:
        pass


def stream_fold(
    stream: DataFrame,
    fold: Fold,
    args: Mapping[str, Column],
    delay: str = "1 minute",
    seq: str = "event_id",
    tl: Timeline = DEVICE_TIME,
    initial: DataFrame | None = None,
    keep_late_s: float | None = None,
) -> DataFrame:
    """(keys, ts, seq, outputs) in event-time order; the session's state store must be RocksDB (`ROCKSDB`). `initial` is (keys, state) with stored fold states.

    With `keep_late_s` each key's own clock counts, that many seconds behind the greatest time seen, instead of a watermark of
    `delay`; a column `late` marks rows that came behind it, which the fold leaves out.
    """
    named = [f"arg_{n}" for n in fold.inputs]
    own = None if keep_late_s is None else int(keep_late_s * 1e6)
    rows = (stream.withWatermark(tl.time, delay) if own is None else stream).select(
        *tl.keys, tl.time, micros(tl.time).alias("t_us"), F.col(seq).cast("long").alias("seq"),
        *[args[n].alias(a) for n, a in zip(fold.inputs, named)],
    )
    made = T.StructType.fromDDL(fold.output)
    late = [] if own is None else [T.StructField("late", T.BooleanType())]
    schema = T.StructType(
        [*[stream.schema[k] for k in tl.keys], T.StructField("t_us", T.LongType()), T.StructField("seq", T.LongType()), *made.fields, *late]
    )
    processor = FoldProcessor(fold, tl.keys, ["t_us", "seq", *named], made.names, own)
    out = rows.groupBy(*tl.keys).transformWithStateInPandas(
        processor, outputStructType=schema, outputMode="Append", timeMode="EventTime" if own is None else "None",
        initialState=None if initial is None else initial.groupBy(*tl.keys),
    )
    return out.withColumn(tl.time, F.timestamp_micros("t_us")).select(*tl.keys, tl.time, F.col("seq").alias(seq), *made.names, *[f.name for f in late])


class EntityProcessor(FoldProcessor):
    """Says when an entity becomes available, and, by event-time timers, when it has been silent for longer than it may."""

    def __init__(self, keys: Sequence[str]):
        super().__init__(Fold(), keys, ["t_us", "seq", "expire_us"], ["available"])

    def _advance(self, key, fresh: list, limit: int) -> Iterator[pd.DataFrame]:
        # the last time seen, how long that holds, and whether the entity is shown
        before = json.loads(self.state.get()[0]) if self.state.exists() else None
        last, newest = before, None
        for due in self._released(fresh, limit):
            out = []
            for t, seq, expire in due:
                if last is not None and last[2] and t - last[0] > last[1]:
                    out.append((*key, last[0] + last[1], seq, False))
                    last = [*last[:2], False]
                if last is None or not last[2]:
                    out.append((*key, t, seq, True))
                last, newest = [t, expire, True], seq
            if out:
                yield self._frame(out)
        if last is not None and last[2]:
            end = last[0] + last[1]
            if limit > end:
                last = [*last[:2], False]
                yield self._frame([(*key, end, newest, False)])
            else:
                self.handle.registerTimer(end // 1000 + 1)
        if last != before:
            self.state.update((json.dumps(last),))


def stream_entities(stream: DataFrame, expire_s: Column, delay: str = "1 minute", seq: str = "event_id", tl: Timeline | None = None) -> DataFrame:
    """(device, entity, ts, available): when entities of a stream of values (device, entity, ts) are published and withdrawn.

    A value holds for `expire_s` seconds; an entity that is silent for longer becomes unavailable then, and available with its next value.
    """
    tl = tl or DEVICE_TIME.with_keys("device", "entity")
    rows = stream.withWatermark(tl.time, delay).select(*tl.keys, tl.time, micros(tl.time).alias("t_us"), F.col(seq).cast("long").alias("seq"), (expire_s * 1_000_000).cast("long").alias("expire_us"))
    schema = T.StructType([*[stream.schema[k] for k in tl.keys], T.StructField("t_us", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("available", T.BooleanType())])
    out = rows.groupBy(*tl.keys).transformWithStateInPandas(EntityProcessor(tl.keys), outputStructType=schema, outputMode="Append", timeMode="EventTime")
    return out.withColumn(tl.time, F.timestamp_micros("t_us")).select(*tl.keys, tl.time, "available")


def stream_soc_controller(stream: DataFrame, devices: DataFrame, delay: str = "1 minute", tl: Timeline = DEVICE_TIME) -> DataFrame:
    """Charge-switch commands live, by the thresholds in each device's own `algorithm` text (device, algorithm); devices without one get none."""
    rule = parse_algorithm("algorithm")
    known = devices.select(*tl.keys, rule.alias("__rule")).filter("__rule.name = 'soc' AND __rule.charge_stop IS NOT NULL")
    rows = stream.join(known, list(tl.keys))
    args = {
        "t_us": micros(tl.time), "soc": F.col("soc").cast("double"), "sw": F.col("switch_charge"),
        "stop": F.col("__rule.charge_stop"), "start": F.col("__rule.charge_start"), "calibration_us": (F.col("__rule.calibration_s") * 1e6).cast("long"),
    }
    return stream_fold(rows, SocController(), args, delay, tl=tl).filter("value IS NOT NULL")


class LiveThermal(Fold):
    """The thermal model on a feed of ambient readings and samples: a reading is kept, a sample steps the model with what is young enough."""

    inputs = ("t_us", "channel", "reading", "mos")
    output = "pack_temperature double"

    def __init__(self, channels: Sequence[str], max_age_s: float):
        self.model, self.channels, self.max_age = PackTemperature(), tuple(channels), max_age_s * 1e6

    def init(self):
        return [[None] * len(self.channels), self.model.init()]

    def step(self, state, row):
        t, channel, reading, mos = row
        known, temperature = state
        if channel is not None:
            if channel in self.channels and reading is not None:
                known = list(known)
                known[self.channels.index(channel)] = [reading, t]
            return [known, temperature], (None,)
        young = [k[0] if k is not None and t - k[1] <= self.max_age else None for k in known]
        temperature, out = self.model.step(temperature, (t, mos, *young))
        return [known, temperature], out


def stream_pack_temperature(
    packs: DataFrame, ambient: DataFrame, devices: Sequence[str], max_age_s: float = AMBIENT_MAX_AGE_S, delay: str = "1 minute", seq: str = "event_id", tl: Timeline = DEVICE_TIME
) -> DataFrame:
    """Pack temperatures live from streams of samples and of ambient(channel, ts, value), which every one of `devices` gets.

    Rows of one instant go by `seq`, ambient readings first.
    """
    reading = ambient.select(F.explode(F.array(*[F.lit(d) for d in devices])).alias(tl.keys[0]), tl.time, (F.col(seq) * 2).alias(seq), "channel", F.col("value").alias("reading"), F.lit(None).cast("double").alias("mos"))
    sample = packs.select(*tl.keys, tl.time, (F.col(seq) * 2 + 1).alias(seq), F.lit(None).cast("string").alias("channel"), F.lit(None).cast("double").alias("reading"), F.col("mos_temperature").cast("double").alias("mos"))
    args = {"t_us": micros(tl.time), **{c: F.col(c) for c in ("channel", "reading", "mos")}}
    out = stream_fold(sample.unionByName(reading), LiveThermal(("room", "outdoor"), max_age_s), args, delay, seq, tl)
    return out.filter(F.col(seq) % 2 == 1).withColumn(seq, F.floor(F.col(seq) / 2).cast("long"))


def stream_reassemble(chunks: DataFrame, protocol: str, delay: str = "1 minute", seq: str = "seq") -> DataFrame:
    """chunks(device, ts, seq, chunk) -> what `operators.frames.reassemble` gives, live."""
    tl = Timeline(("device",), "ts", ("ts", seq))
    return stream_fold(chunks, Reassemble(protocol), {"chunk": F.col("chunk")}, delay, seq, tl)


def stream_meters(stream: DataFrame, gap_s: float, invert: bool = False, delay: str = "1 minute", tl: Timeline = DEVICE_TIME) -> DataFrame:
    """Readings after every sample; they survive a restart with the query's checkpoint."""
    args = {
        "t_us": micros(tl.time),
        **{c: F.col(c).cast("double") for c in ("current", "power", "soc", "charge")},
    }
    return stream_fold(stream, Meters(gap_s, invert), args, delay, tl=tl)


def late_policy(stream: DataFrame, expire_s: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(fresh, late) by the age at ingestion; the late rows can be kept in a table of their own."""
    fresh = F.coalesce(is_fresh(expire_s), F.lit(True))
    return stream.filter(fresh), stream.filter(~fresh)


def drop_repeats(stream: DataFrame, delay: str = "1 minute", keys: Sequence[str] = ("device", "ts"), time: str = "ts") -> DataFrame:
    """A sample delivered twice counts once."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def stream_downsample(stream: DataFrame, period: str, delay: str = "1 minute", tl: Timeline = DEVICE_TIME, explicit_power: str = "power") -> DataFrame:
    """Windows that the watermark has closed, in the layout of `operators.aggregate.downsample`."""
    tl = tl.of(stream)
    rest = [c for c in stream.columns if c not in (*tl.keys, "voltage", "current", explicit_power)]
    agg = (
        stream.withWatermark(tl.time, delay)
        .groupBy(*tl.keys, F.window(tl.time, period).alias("__w"))
        .agg(
            F.avg("voltage").alias("voltage"), F.avg("current").alias("current"),
            F.avg(F.coalesce(explicit_power, F.col("voltage") * F.col("current"))).alias("__power"),
            F.max_by(F.struct(F.col(explicit_power).alias("__explicit"), *rest), tl.order_key()).alias("__last"),
            F.count(F.lit(1)).alias("n_samples"),
        )
    )
    p = F.when(F.col("__last.__explicit").isNotNull(), F.col("__power")).otherwise(F.col("voltage") * F.col("current"))
    return agg.select(
        *tl.keys, F.unix_seconds(F.col("__w.start")).alias("bucket"), "voltage", "current", p.alias("power"), "n_samples",
        *[F.col(f"__last.{c}").alias(c) for c in rest],
    )


def stream_outages(stream: DataFrame, gap: str, delay: str = "1 minute", tl: Timeline = DEVICE_TIME) -> DataFrame:
    """Uninterrupted spells of reporting; the time between two of them is an outage."""
    return (
        stream.withWatermark(tl.time, delay).groupBy(*tl.keys, F.session_window(tl.time, gap).alias("s"))
        .agg(F.count(F.lit(1)).alias("n_samples"), F.min(tl.time).alias("first_seen"), F.max(tl.time).alias("last_seen"))
        .drop("s")
    )
