"""Rows that wait in the state of a stream, and the thermal model, without a Spark session."""

import random

import pandas as pd

from fleetwatt.operators import folds as O
from fleetwatt.streaming import folds as S


class Value:
    def __init__(self):
        self.v = None

    def exists(self):
        return self.v is not None

    def get(self):
        return self.v

    def update(self, v):
        self.v = v


class Map:
    def __init__(self):
        self.d, self.reads = {}, 0

    def getValue(self, key):
        self.reads += 1
        return self.d[key]

    def updateValue(self, key, value):
        self.d[key] = value

    def removeKey(self, key):
        del self.d[key]


class Handle:
    def __init__(self):
        self.values, self.map = {}, Map()

    def getValueState(self, name, schema):
        return self.values.setdefault(name, Value())

    def getMapState(self, name, key, value):
        return self.map

    def registerTimer(self, ms):
        self.timer = ms


def processor(delay_s):
    p = S.FoldProcessor(O.Ewma(4), ["device"], ["t_us", "seq", "arg_x"], ["ewma"], int(delay_s * 1e6))
    p.init(Handle())
    return p


def feed(p, rows):
    pdf = pd.DataFrame(rows, columns=["t_us", "seq", "arg_x"])
    return [tuple(r) for out in p.handleInputRows(("a",), iter([pdf]), None) for r in out.itertuples(index=False)]


def test_own_clock_keeps_late_rows_apart():
    rnd = random.Random(1)
    p, out, clock, want_late, fresh = processor(900), [], None, set(), []
    for batch in range(60):
        rows = []
        for k in range(20):
            back = rnd.choice([0, 0, 0, 300, 1200, 90_000])
            rows.append((int((batch * 120 + rnd.uniform(0, 120) - back) * 1e6), batch * 20 + k, rnd.uniform(0, 9)))
        late = {r[1] for r in rows if clock is not None and r[0] <= clock}
        want_late |= late
        fresh += [r for r in rows if r[1] not in late]
        clock = max([r[0] - 900_000_000 for r in rows if r[1] not in late] + ([] if clock is None else [clock]))
        out += feed(p, rows)
    assert {r[2] for r in out if r[4]} == want_late and want_late
    due = sorted(r for r in fresh if r[0] <= clock)
    fold, state, want = O.Ewma(4), None, []
    for t, seq, x in due:
        state, (y,) = fold.step(state, (x,))
        want.append((t, seq, y))
    assert [(r[1], r[2], r[3]) for r in out if not r[4]] == want
    # nothing is lost: released, late or waiting
    assert len(out) + sum(len(p._read(b)) for (b,) in list(p.waiting.d)) == 1200


def test_reads_do_not_grow_with_the_delay():
    reads = {}
    for delay in (600, 36_000):
        p = processor(delay)
        for batch in range(800):
            feed(p, [(int((batch * 60 + k) * 1e6), batch * 60 + k, 1.0) for k in range(60)])
            if batch == 700:
                p.waiting.reads = 0
        reads[delay] = p.waiting.reads
    assert reads[36_000] <= reads[600] + 2


def test_waiting_buckets_of_the_watermark_kind():
    class Timer:
        def getCurrentWatermarkInMs(self):
            return 60_500

    p = S.FoldProcessor(O.Ewma(4), ["device"], ["t_us", "seq", "arg_x"], ["ewma"])
    p.init(Handle())
    pdf = pd.DataFrame([(61_000_000, 3, 2.0), (60_100_000, 2, 4.0), (1_000, 1, 1.0)], columns=["t_us", "seq", "arg_x"])
    got = [r for out in p.handleInputRows(("a",), iter([pdf]), Timer()) for r in out.itertuples(index=False)]
    assert [(r.t_us, r.seq) for r in got] == [(1_000, 1), (60_100_000, 2)] and p.handle.timer == 61_000


def model(rows, fold=None):
    fold, out = fold or O.PackTemperature(), []
    state = fold.init()
    for r in rows:
        state, (y,) = fold.step(state, r)
        out.append(y)
    return out


def test_thermal_model_step_by_step_equals_the_whole_record():
    """600 steps of a minute, in pieces of any size, end where one pass ends."""
    rnd = random.Random(7)
    rows = [(i * 60_000_000, 20 + rnd.uniform(-3, 8), rnd.choice([None, 19.0 + rnd.random()]), 5 + rnd.random()) for i in range(600)]
    whole = model(rows)[-1]
    fold = O.PackTemperature()
    for size in (1, 7, 100, 600):
        state = fold.init()
        for i in range(0, 600, size):
            state = fold.advance(state, fold.summarise(iter(rows[i : i + size])))
        assert abs(state[0] - whole) < 1e-9


def test_a_short_spike_hardly_moves_the_estimate():
    warm = [(i * 60_000_000, 22.0, 22.0, 22.0) for i in range(600)]
    spike = [((600 + i) * 60_000_000, 60.0, 22.0, 22.0) for i in range(5)]
    got = model(warm + spike)
    assert abs(got[599] - 22.0) < 1e-9 and 0 < got[-1] - got[599] < 2.0


def test_controller_by_hand():
    fold, state, out = O.SocController(), O.SocController().init(), []
    hour = 3_600_000_000
    for t, soc, sw in [(0, 50, True), (1, 90, True), (2, 89, False), (3, 70, False), (4, None, True), (5, 95, None), (30, 60, False), (31, 99, True), (32, 100, True), (33, 100, True)]:
        state, got = fold.step(state, (t * hour, soc, sw, 90.0, 70.0, 24 * hour))
        out.append(got)
    none = (None, None)
    assert out == [none, (False, "stop"), none, (True, "start"), none, none, (True, "calibrate"), none, (False, "calibrated"), none]
