"""Step functions of the order-dependent filters and throttles."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwatt.operators.fold import ComposableFold, Fold, run_fold
from fleetwatt.operators.prefix import scan
from fleetwatt.operators.timeline import DEVICE_TIME, Timeline, micros
from fleetwatt.operators.windows import LATCH_MARGIN
from fleetwatt.session import checkpointed


def smooth(y: float | None, x: float, alpha: float) -> float:
    """One exponential step; the first value seeds the filter."""
    if y is None:
        y = x
    return (1 - alpha) * y + alpha * x


def finite(x: float | None) -> bool:
    return x is not None and math.isfinite(x)


class Affine:
    """The map y -> a*y + b that a run of exponential steps makes, and where it ends from cold."""

    def __init__(self):
        self.a, self.b, self.cold = 1.0, 0.0, None

    def add(self, x: float, alpha: float) -> None:
        self.a *= 1 - alpha
        self.b = (1 - alpha) * self.b + alpha * x
        self.cold = smooth(self.cold, x, alpha)

    def dump(self) -> list:
        return [self.a, self.b, self.cold]

    @staticmethod
    def apply(y: float | None, dumped: list) -> float | None:
        a, b, cold = dumped
        return cold if y is None else a * y + b


class Ewma(ComposableFold):
    """Exponentially weighted mean over `span` samples; missing values leave it as it is."""

    inputs = ("x",)

    def __init__(self, span: float, out: str = "ewma"):
        self.alpha = 2 / (span + 1)
        self.output = f"{out} double"

    def step(self, state, row):
        (x,) = row
        if finite(x):
            state = smooth(state, x, self.alpha)
        return state, (state,)

    def summarise(self, rows):
        run = Affine()
        for (x,) in rows:
            if finite(x):
                run.add(x, self.alpha)
        return run.dump()

    def advance(self, state, summary):
        return Affine.apply(state, summary)


#: fixed value: relative changes are clipped here
CHANGE_CLIP = 1.4


class EwmZScore(ComposableFold):
    """Smoothed mean, smoothed squared relative change, and the z-score of each value."""

    inputs = ("x",)
    output = "ewm_mean double, ewm_stddev double, z_score double"

    def __init__(self, span: float, reg: float):
        self.alpha, self.reg = 2 / (span + 1), reg

    def _regular(self, x: float) -> float:
        return (-1 if x < 0 else 1) * (abs(x) + self.reg) if self.reg else x

    @staticmethod
    def _change(x: float, before: float) -> float | None:
        if before == 0:
            return None
        pct = min(abs((x - before) / before), CHANGE_CLIP)
        return pct * pct

    def init(self):
        return [None, None, None]

    def step(self, state, row):
        (x,) = row
        if not finite(x):
            return state, (None, None, None)
        avg, std, before = state
        avg = smooth(avg, x, self.alpha)
        r = self._regular(x)
        c = self._change(r, before) if before is not None else None
        if c is not None:
            std = smooth(std, c, self.alpha)
        dev = None if std is None else abs(avg * std)
        z = None if dev is None or dev + self.reg == 0 else (x - avg) / (dev + self.reg)
        return [avg, std, r], (avg, dev, z)

    def summarise(self, rows):
        mean, change, first, last = Affine(), Affine(), None, None
        for (x,) in rows:
            if not finite(x):
                continue
            mean.add(x, self.alpha)
            r = self._regular(x)
            if first is None:
                first = r
            else:
                c = self._change(r, last)
                if c is not None:
                    change.add(c, self.alpha)
            last = r
        return [mean.dump(), change.dump(), first, last]

    def advance(self, state, summary):
        mean, change, first, last = summary
        if first is None:
            return state
        avg, std, before = state
        c = self._change(first, before) if before is not None else None
        if c is not None:
            std = smooth(std, c, self.alpha)
        return [Affine.apply(avg, mean), Affine.apply(std, change), last]


class Quantizer(ComposableFold):
    """Smoothing, then a hysteresis quantizer: half steps, pulled by a third of the last output.

    `x` is one value or an array of sensors; every sensor has a filter of its own, by position.

    Both parts forget: after `20 * span` values the smoothed signal no longer depends on where it
    started (the rest weighs less than a rounding error), and the quantizer's step is monotone and shrinks
    distances to a third, so 48 steps later all possible starts have met in a few neighbouring levels.
    The summary keeps the values up to there as they are, and the end level for each of those few.
    """

    inputs = ("x",)
    SETTLE = 48
    FAR = 1e9

    def __init__(self, step: float, span: float, out: str = "quantized", sensors: bool = False, digits: int | None = None):
        self.q, self.alpha, self.digits, self.sensors = step, 2 / (span + 1), digits, sensors
        self.forget = int(20 * span)
        self.output = f"{out} {'array<double>' if sensors else 'double'}"

    def _next(self, last: float, smoothed: float) -> float:
        return round((last + 2 * smoothed) / 3 * 2 / self.q) * 0.5 * self.q

    def _one(self, state: list | None, x: float | None) -> list | None:
        if not finite(x):
            return state
        smoothed, last = state or (None, x)
        smoothed = smooth(smoothed, x, self.alpha)
        return [smoothed, self._next(last, smoothed)]

    def _show(self, state: list | None) -> float | None:
        if state is None or self.digits is None:
            return state and state[1]
        return round(state[1], self.digits)

    def init(self):
        return []

    def step(self, state, row):
        values = (row[0] or []) if self.sensors else [row[0]]
        state = state + [None] * (len(values) - len(state))
        state = [self._one(s, values[i]) if i < len(values) else s for i, s in enumerate(state)]
        shown = [self._show(s) for s in state[: len(values)]]
        if not self.sensors:
            return state, (shown[0],)
        return state, (None if row[0] is None else shown,)

    def summarise(self, rows):
        runs: list[_Settling] = []
        for (x,) in rows:
            values = (x or []) if self.sensors else [x]
            while len(runs) < len(values):
                runs.append(_Settling(self))
            for run, v in zip(runs, values):
                if finite(v):
                    run.add(v)
        return [r.dump() for r in runs]

    def advance(self, state, summary):
        state = state + [None] * (len(summary) - len(state))
        out = list(state)
        for i, (head, smoothed, ends) in enumerate(summary):
            s = state[i]
            for x in head:
                s = self._one(s, x)
            if ends:
                s = [smoothed, min(ends, key=lambda e: abs(e[0] - s[1]))[1]]
            out[i] = s
        return out


class _Settling:
    """One sensor of one slice: the values until everything is forgotten, then the possible levels."""

    def __init__(self, fold: Quantizer):
        self.fold, self.head, self.smoothed = fold, [], None
        self.lo, self.hi, self.ends = -fold.FAR, fold.FAR, None

    def add(self, x: float) -> None:
        f = self.fold
        self.smoothed = smooth(self.smoothed, x, f.alpha)
        if len(self.head) < f.forget + f.SETTLE:
            self.head.append(x)
            if len(self.head) > f.forget:
                self.lo, self.hi = f._next(self.lo, self.smoothed), f._next(self.hi, self.smoothed)
            return
        if self.ends is None:
            first, last = round(self.lo * 2 / f.q), round(self.hi * 2 / f.q)
            levels = [n * 0.5 * f.q for n in range(first, last + 1)]
            self.ends = [[v, v] for v in levels]
        for end in self.ends:
            end[1] = f._next(end[1], self.smoothed)

    def dump(self) -> list:
        return [self.head, self.smoothed, self.ends]


class Throttle(ComposableFold):
    """Keep a row when at least `interval_us` has passed since the last kept one.

    `seed_us` stands for the last kept time before the first row; without one the first row is kept.
    """

    inputs = ("t_us", "seed_us")

    def __init__(self, interval_us: int, out: str = "kept"):
        self.interval = interval_us
        self.output = f"{out} boolean"

    def step(self, state, row):
        t, seed = row
        if state is None:
            state = seed
        keep = state is None or t - state >= self.interval
        return (t if keep else state), (keep,)

    def summarise(self, rows):
        chain, seed = KeptChain(self.interval), None
        for i, (t, s) in enumerate(rows):
            if i == 0:
                seed = s
            chain.add(t)
        return [seed, chain.dump()]

    def advance(self, state, summary):
        seed, chain = summary
        return follow_chain(seed if state is None else state, chain, self.interval)


class KeptChain:
    """For each row that can be the first one kept: its time and the last time kept from there on, row by row.

    Only rows within one interval of the first can be. Those that were kept last at the same time are a group from then on; a row
    moves all groups that are an interval behind it, which makes them one. So what is held are the rows of one interval,
    however many rows go by.
    """

    def __init__(self, interval: int):
        self.interval, self.first, self.open = interval, None, True
        self.heads: list[int] = []
        self.groups: deque[tuple[int, list[int]]] = deque()

    def add(self, t: int) -> None:
        if self.first is None:
            self.first = t
        moved: list[int] = []
        while self.groups and t - self.groups[0][0] >= self.interval:
            group = self.groups.popleft()[1]
            small, moved = sorted((moved, group), key=len)
            moved += small
        if self.open:
            moved.append(len(self.heads))
            self.heads.append(t)
            self.open = t - self.first < self.interval
        if moved:
            self.groups.append((t, moved))

    def dump(self) -> list[list[int]]:
        """Neighbours that end alike are one."""
        last = [0] * len(self.heads)
        for t, group in self.groups:
            for i in group:
                last[i] = t
        chain: list[list[int]] = []
        for t, end in zip(self.heads, last, strict=True):
            if chain and chain[-1][1] == end:
                chain[-1][0] = t
            else:
                chain.append([t, end])
        return chain


def kept_chain(ts: Iterable[int], interval: int) -> list[list[int]]:
    chain = KeptChain(interval)
    for t in ts:
        chain.add(t)
    return chain.dump()


def follow_chain(state: int | None, chain: list[list[int]], interval: int) -> int | None:
    for t, last in chain:
        if state is None or t >= state + interval:
            return last
    return state


class Periods(ComposableFold):
    """Periodic signals: each is true on the sample after the one that closed its period.

    All are true on the first sample. The state is the start of the running period and the pending
    signal, per period.
    """

    inputs = ("t_us",)
    output = "due array<boolean>"

    def __init__(self, periods_us: Sequence[int]):
        self.periods = list(periods_us)

    def init(self):
        return [[None, True] for _ in self.periods]

    def _one(self, state, t, period):
        start, _ = state
        if start is None:
            return [t, period == 0]
        return [t, True] if t - start >= period else [start, False]

    def step(self, state, row):
        (t,) = row
        due = [signal for _, signal in state]
        return [self._one(s, t, p) for s, p in zip(state, self.periods)], (due,)

    def summarise(self, rows):
        chains, first, last, tied = [KeptChain(p) for p in self.periods], None, None, False
        for (t,) in rows:
            first = t if first is None else first
            tied, last = t == last, t
            for chain in chains:
                chain.add(t)
        return [first, last, tied, [chain.dump() for chain in chains]]

    def advance(self, state, summary):
        first, last, tied, chains = summary
        out = []
        for (start, _), chain, period in zip(state, chains, self.periods):
            at = follow_chain(start, chain, period)
            # the last row closed a period when the running one starts with it, and with no earlier row
            closed = at == last and not tied and at != (first if start is None else start)
            out.append([at, period == 0 or closed])
        return out


class KeepAlive(ComposableFold):
    """Emit a value when it changed, or when `interval_us` has passed since it was last emitted."""

    inputs = ("t_us", "v")
    output = "emitted boolean"

    def __init__(self, interval_us: int):
        self.interval = interval_us

    def step(self, state, row):
        t, v = row
        emit = state is None or state[0] != v or t - state[1] >= self.interval
        return ([v, t] if emit else state), (emit,)

    def summarise(self, rows):
        first, run, end = None, KeptChain(self.interval), None
        for i, (t, v) in enumerate(rows):
            if i == 0:
                first = v
            if end is None and v == first:
                run.add(t)
                continue
            if end is None or end[0] != v or t - end[1] >= self.interval:
                end = [v, t]
        return [first, run.dump(), end]

    def advance(self, state, summary):
        first, chain, end = summary
        if end is not None:
            return end
        same = state is not None and state[0] == first
        return [first, follow_chain(state[1] if same else None, chain, self.interval)]


#: fixed values: runtime estimation
RUNTIME_SPAN = 6
RUNTIME_STALE_FACTOR = 4
RUNTIME_STALE_MIN_S = 10.0


class Runtime(Fold):
    """Seconds to empty from the remaining charge and the smoothed discharge current.

    A pause well beyond the learned cadence forgets both filters; charging or idling forgets the
    current. A runtime the device reports itself is passed through and leaves the filters alone.
    """

    inputs = ("t_us", "current", "charge", "reported")

    def __init__(self, out: str = "runtime"):
        self.alpha = 2 / (RUNTIME_SPAN + 1)
        self.output = f"{out} double"

    def init(self):
        return [None, None, None]

    def step(self, state, row):
        t, current, charge, reported = row
        if finite(reported):
            return state, (reported,)
        amps, cadence, before = state
        dt = None if before is None else (t - before) / 1e6
        if dt is not None:
            limit = RUNTIME_STALE_MIN_S if cadence is None else max(RUNTIME_STALE_MIN_S, RUNTIME_STALE_FACTOR * cadence)
            if cadence is not None and dt > limit:
                amps, cadence = None, None
            else:
                cadence = smooth(cadence, dt, self.alpha)
        if not finite(charge):
            return [amps, cadence, t], (None,)
        if finite(current) and current > 0:
            amps = smooth(amps, current, self.alpha)
        else:
            amps = None
        left = charge / amps * 3600 if amps is not None and amps > 0 else None
        return [amps, cadence, t], (left,)


#: fixed values: conductances of the lumped thermal model per `RC_STEP_S`, and its restart gap
A_ROOM, A_OUTDOOR, A_MOS = 0.0006, 0.0009, 0.0017
RC_STEP_S = 60.0
RC_MAX_GAP_S = 3600.0


def valid_temperature(x: float | None) -> bool:
    return x is not None and -100.0 < x < 200.0


class PackTemperature(ComposableFold):
    """Cell temperature from the MOSFET sensor and the surroundings, by a lumped thermal model."""

    inputs = ("t_us", "mos", "room", "outdoor")

    def __init__(self, a_room=A_ROOM, a_outdoor=A_OUTDOOR, a_mos=A_MOS, step_s=RC_STEP_S, max_gap_s=RC_MAX_GAP_S, out="pack_temperature"):
        self.weights = (a_mos, a_room, a_outdoor)
        self.step_s, self.max_gap_s = step_s, max_gap_s
        self.output = f"{out} double"

    def init(self):
        return [None, None]

    def _drivers(self, values) -> tuple[float, float]:
        """Total conductance and conductance-weighted sum of the usable inputs."""
        total = pull = 0.0
        for a, v in zip(self.weights, values):
            if valid_temperature(v):
                total += a
                pull += a * v
        return total, pull

    def _restart(self, before, t) -> bool:
        return before is None or t - before > self.max_gap_s * 1e6 or t < before

    def step(self, state, row):
        t, *values = row
        temp, before = state
        if not valid_temperature(values[0]):
            return state, (temp,)
        total, pull = self._drivers(values)
        if temp is None or self._restart(before, t):
            temp = pull / total
        else:
            scale = (t - before) / 1e6 / self.step_s
            temp = temp + (pull - total * temp) * scale
        return [temp, t], (temp,)

    def summarise(self, rows):
        first, a, b, before = None, 1.0, 0.0, None
        for row in rows:
            t, *values = row
            if not valid_temperature(values[0]):
                continue
            if first is None:
                first = list(row)
            else:
                total, pull = self._drivers(values)
                if self._restart(before, t):
                    a, b = 0.0, pull / total
                else:
                    scale = (t - before) / 1e6 / self.step_s
                    a, b = a * (1 - total * scale), b + (pull - total * b) * scale
            before = t
        return [first, a, b, before]

    def advance(self, state, summary):
        first, a, b, last = summary
        if first is None:
            return state
        (temp, _), _ = self.step(state, tuple(first))
        return [a * temp + b, last]


class SocController(Fold):
    """Charge-switch commands sample by sample; `soc_controller` gives the same ones from a table.

    The state is whether the pack may charge, and the time of the last full charge, which begins as that of the first sample.
    """

    inputs = ("t_us", "soc", "sw", "stop", "start", "calibration_us")
    output = "value boolean, reason string"

    def init(self):
        return [True, None]

    def step(self, state, row):
        t, soc, sw, stop, start, calibration = row
        charging, last = state
        last = t if last is None else last
        level = math.nan if soc is None else soc
        if calibration and t - last > calibration:
            if level == 100:
                return [False, t], (False, "calibrated")
            if sw is not None and not sw:
                return [True, last], (True, "calibrate")
            return [charging, last], (None, None)
        if charging and level >= stop:
            return [False, last], (False, "stop") if sw else (None, None)
        if not charging and level <= min(start, stop - LATCH_MARGIN):
            return [True, last], (True, "start") if sw is not None and not sw else (None, None)
        return [charging, last], (None, None)


# --- the folds as table operators -------------------------------------------------------------


def ewma(df: DataFrame, x: Column, span: float, out: str = "ewma", tl: Timeline = DEVICE_TIME) -> DataFrame:
    return run_fold(df, Ewma(span, out), {"x": x.cast("double")}, tl)


def ewm_zscore(df: DataFrame, x: Column, span: float = 120, reg: float = 0.1, tl: Timeline = DEVICE_TIME) -> DataFrame:
    return run_fold(df, EwmZScore(span, reg), {"x": x.cast("double")}, tl)


#: fixed values: temperature filters per device family as (step, span)
TEMPERATURE_FILTERS = {"daly": (1.0, 40), "jk": (0.1, 30), "ant": (1.0, 40)}


def quantize(df: DataFrame, x: Column, step: float, span: float, out: str = "quantized", digits: int | None = None, tl: Timeline = DEVICE_TIME) -> DataFrame:
    """Smooth one signal and quantize it with hysteresis."""
    return run_fold(df, Quantizer(step, span, out, digits=digits), {"x": x.cast("double")}, tl)


def temp_filter(df: DataFrame, step: float, span: float, tl: Timeline = DEVICE_TIME) -> DataFrame:
    """Filter every sensor of `temperatures` (two decimals) and `mos_temperature`, each on its own.

    The MOSFET sensor rides along as the first element, so that one pass filters all of them.
    """
    probes = F.coalesce(F.col("temperatures").cast("array<double>"), F.array().cast("array<double>"))
    every = F.concat(F.array(F.col("mos_temperature").cast("double")), probes)
    out = run_fold(df, Quantizer(step, span, "__filtered", sensors=True), {"x": every}, tl)
    rest = F.slice("__filtered", F.lit(2), F.size("__filtered"))
    filtered = F.transform(rest, lambda v: F.rint(v * 100) / 100)
    return out.withColumns(
        {
            "mos_temperature": F.when(F.col("mos_temperature").isNotNull(), F.get("__filtered", F.lit(0))),
            "temperatures": F.when(F.col("temperatures").isNotNull(), filtered),
        }
    ).drop("__filtered")


def throttle(df: DataFrame, interval_s: float, out: str = "kept", seed: Column | None = None, tl: Timeline = DEVICE_TIME) -> DataFrame:
    seed = F.lit(None).cast("long") if seed is None else seed
    return run_fold(df, Throttle(int(interval_s * 1e6), out), {"t_us": micros(tl.time), "seed_us": seed}, tl)


#: fixed value: unchanged values are repeated after this long
KEEPALIVE_S = 10.0


def keepalive_dedup(df: DataFrame, interval_s: float = KEEPALIVE_S, tl: Timeline | None = None) -> DataFrame:
    """(device, topic, ts, value): values worth sending."""
    tl = tl or DEVICE_TIME.with_keys("device", "topic")
    out = run_fold(df, KeepAlive(int(interval_s * 1e6)), {"t_us": micros(tl.time), "v": F.col("value").cast("string")}, tl)
    return out.filter("emitted").drop("emitted")


def runtime(df: DataFrame, tl: Timeline = DEVICE_TIME, reported: str | None = None) -> DataFrame:
    args = {
        "t_us": micros(tl.time),
        "current": F.col("current").cast("double"),
        "charge": F.col("charge").cast("double"),
        "reported": F.col(reported).cast("double") if reported else F.lit(None).cast("double"),
    }
    return run_fold(df, Runtime("runtime"), args, tl)


def pack_temperature(df: DataFrame, room: str = "room", outdoor: str = "outdoor", tl: Timeline = DEVICE_TIME) -> DataFrame:
    args = {"t_us": micros(tl.time), "mos": F.col("mos_temperature").cast("double"), "room": F.col(room).cast("double"), "outdoor": F.col(outdoor).cast("double")}
    return run_fold(df, PackTemperature(), args, tl)


#: fixed values: publishing periods
DISCOVERY_S = 300.0


def publish_decision(df: DataFrame, period_s: float, over_power: float | None = None, tl: Timeline = DEVICE_TIME) -> DataFrame:
    """Needs `power` and `jump_hold`. A row is due by either period, by a recent jump or by sheer power."""
    df = run_fold(df, Periods([int(period_s * 1e6), int(DISCOVERY_S * 1e6)]), {"t_us": micros(tl.time)}, tl)
    due = F.get("due", F.lit(0)) | F.get("due", F.lit(1)) | F.col("jump_hold")
    if over_power is not None:
        due = due | F.coalesce(F.abs("power") > over_power, F.lit(False))
    return df.withColumn("publish", due).drop("due")


#: fixed value: a full charge is due this long after the last one
CALIBRATION_S = 14 * 86_400.0


def calibrations(df: DataFrame, calibration_s: float, last_calibration: Column | None = None, tl: Timeline = DEVICE_TIME) -> DataFrame:
    """Per key: when the record starts (`seed`, the stored time or the first sample) and every calibration.

    A calibration is a full sample more than `calibration_s` after the previous one: a throttle over
    the full samples alone, which are few, and of which it keeps one in weeks. Both tables have a row
    per device; they are written to the checkpoint folder, so the samples behind them are read once.
    """
    tl = tl.of(df)
    keys = list(tl.keys)
    start = F.min(micros(tl.time)) if last_calibration is None else F.coalesce(F.max(last_calibration), F.min(micros(tl.time)))
    starts = checkpointed(df.groupBy(*keys).agg(start.alias("__seed")))
    full = df.filter(F.col("soc") == 100).select(*keys, *tl.order).join(starts, keys)
    kept = run_fold(full, Throttle(int(calibration_s * 1e6) + 1, "__kept"), {"t_us": micros(tl.time), "seed_us": F.col("__seed")}, tl)
    mark = F.struct(*tl.order)
    marks = kept.filter("__kept").groupBy(*keys).agg(F.array_sort(F.collect_list(mark)).alias("__marks"))
    return checkpointed(starts.join(marks, keys, "left"))


def soc_controller(
    df: DataFrame,
    stop: Column | float,
    start: Column | float,
    calibration_s: float = CALIBRATION_S,
    last_calibration: Column | None = None,
    tl: Timeline = DEVICE_TIME,
) -> DataFrame:
    """Charge-switch commands: stay between `start` and `stop`, but reach 100 % every `calibration_s`.

    The calibration times come first (a handful per device). With them every row knows whether a
    calibration is due, the charging state is the last event that set it, and a command is due where the
    reported switch disagrees. Needs `soc` and `switch_charge`; returns the commands.
    """
    stop = stop if isinstance(stop, Column) else F.lit(float(stop))
    start = start if isinstance(start, Column) else F.lit(float(start))
    low = F.least(start, stop - LATCH_MARGIN)
    if calibration_s:
        known = calibrations(df, calibration_s, last_calibration, tl)
        now = F.struct(*tl.order)
        before = F.array_max(F.filter("__marks", lambda m: m < now))
        last = F.coalesce(F.unix_micros(before[tl.time]), F.col("__seed"))
        due = micros(tl.time) - last > int(calibration_s * 1e6)
        df = df.join(known, list(tl.keys)).withColumn("__need", due).drop("__marks", "__seed")
    else:
        df = df.withColumn("__need", F.lit(False))
    need, soc, sw = F.col("__need"), F.col("soc"), F.col("switch_charge")
    event = (
        F.when(need & (soc == 100), False)
        .when(need & ~sw, True)
        .when(need, None)
        .when(soc >= stop, False)
        .when(soc <= low, True)
    )
    df = scan(df, tl, last_before={"__was": event})
    was = F.coalesce("__was", F.lit(True))
    value = (
        F.when(need & (soc == 100), False)
        .when(need & ~sw, True)
        .when(need, None)
        .when(was & (soc >= stop) & sw, False)
        .when(~was & (soc <= low) & ~sw, True)
    )
    reason = (
        F.when(need & (soc == 100), "calibrated").when(need, "calibrate").when(~value, "stop").when(value, "start")
    )
    return df.select(
        *tl.keys, *tl.order, F.lit("charge").alias("switch"), value.alias("value"), reason.alias("reason")
    ).filter("value IS NOT NULL")
