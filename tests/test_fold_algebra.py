"""`advance(state, summarise(rows))` must equal stepping through the rows, wherever the cut is."""

import math

from hypothesis import given, settings
from hypothesis import strategies as st

from fleetwatt.operators import folds as O

values = st.one_of(st.none(), st.floats(-50, 150, allow_nan=False), st.just(float("nan")))
times = st.lists(st.integers(0, 40), min_size=1, max_size=80)


def walk(fold, rows, state):
    outs = []
    for r in rows:
        state, out = fold.step(state, r)
        outs.append(out)
    return state, outs


def close(a, b):
    if isinstance(a, list):
        return isinstance(b, list) and len(a) == len(b) and all(close(x, y) for x, y in zip(a, b))
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


def check(fold, rows, cuts):
    state = fold.init()
    cuts = sorted({0, len(rows), *[c % (len(rows) + 1) for c in cuts]})
    for lo, hi in zip(cuts, cuts[1:]):
        stepped, _ = walk(fold, rows[lo:hi], state)
        jumped = fold.advance(state, fold.summarise(iter(rows[lo:hi])))
        assert close(stepped, jumped), (lo, hi, state, stepped, jumped)
        state = stepped


def ordered(gaps):
    t, out = 0, []
    for g in gaps:
        t += g
        out.append(t)
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(values, min_size=1, max_size=80), st.lists(st.integers(0, 80), max_size=4))
def test_ewma(xs, cuts):
    check(O.Ewma(6), [(x,) for x in xs], cuts)


@settings(max_examples=300, deadline=None)
@given(st.lists(values, min_size=1, max_size=80), st.lists(st.integers(0, 80), max_size=4))
def test_ewm_zscore(xs, cuts):
    check(O.EwmZScore(20, 0.1), [(x,) for x in xs], cuts)


@settings(max_examples=500, deadline=None)
@given(times, st.integers(1, 30), st.lists(st.integers(0, 80), max_size=4), st.one_of(st.none(), st.integers(-20, 0)))
def test_throttle(gaps, interval, cuts, seed):
    check(O.Throttle(interval), [(t, seed) for t in ordered(gaps)], cuts)


@settings(max_examples=500, deadline=None)
@given(times, st.lists(st.sampled_from("ab"), min_size=80, max_size=80), st.integers(1, 60), st.lists(st.integers(0, 80), max_size=4))
def test_keepalive(gaps, labels, interval, cuts):
    check(O.KeepAlive(interval), list(zip(ordered(gaps), labels)), cuts)


@settings(max_examples=500, deadline=None)
@given(times, st.lists(st.integers(0, 30), min_size=1, max_size=3), st.lists(st.integers(0, 80), max_size=4))
def test_periods(gaps, periods, cuts):
    check(O.Periods(periods), [(t,) for t in ordered(gaps)], cuts)


@settings(max_examples=100, deadline=None)
@given(times, st.lists(values, min_size=80, max_size=80), st.lists(values, min_size=80, max_size=80), st.lists(st.integers(0, 80), max_size=4))
def test_pack_temperature(gaps, mos, room, cuts):
    rows = [(t * 120_000_000, m, r, None) for t, m, r in zip(ordered(gaps), mos, room)]
    rows = [tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in rows]
    check(O.PackTemperature(), rows, cuts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 400), min_size=60, max_size=260), st.lists(st.integers(0, 260), max_size=3), st.sampled_from([0.1, 0.5, 1.0]))
def test_quantizer(xs, cuts, step):
    # a short span, so that slices run past the point where everything is forgotten
    check(O.Quantizer(step, 2), [(x / 10,) for x in xs], cuts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.none(), st.integers(0, 400)), max_size=3), min_size=1, max_size=200), st.lists(st.integers(0, 200), max_size=3))
def test_quantizer_sensors(rows, cuts):
    check(O.Quantizer(0.5, 2, sensors=True), [([None if x is None else x / 10 for x in r],) for r in rows], cuts)


def test_golden_quantizer():
    q = O.Quantizer(0.1, 2)
    state, got = walk(q, [(0.0,), (0.1,), (0.1,)], q.init())
    assert [round(g[0], 6) for g in got] == [0.0, 0.05, 0.1]


def _runtime(rows):
    fold = O.Runtime()
    _, out = walk(fold, [(int(t * 1e6), i, q, None) for t, i, q in rows], fold.init())
    return [o[0] for o in out]


def test_golden_runtime():
    got = _runtime([(0, -10, 100), (60, 5, 100), (120, 10, 100), (180, -10, 100), (240, 8, 100)])
    assert got[0] is None and got[3] is None
    assert math.isclose(got[1], 72000) and math.isclose(got[4], 45000)
    assert math.isclose(got[2], 100 / (5 * 5 / 7 + 10 * 2 / 7) * 3600)


def test_golden_runtime_outage():
    steady = [(60 * i, 10, 50) for i in range(20)]
    got = _runtime(steady + [(60 * 19 + 3600, 2, 50)])
    assert math.isclose(got[19], 18000) and math.isclose(got[20], 90000)
    blended = _runtime([(60 * i, 2, 50) for i in range(6)] + [(60 * 5 + 75, 10, 50)])[-1]
    assert not math.isclose(blended, 50 / 10 * 3600)
    floor = _runtime([(i, 2, 50) for i in range(6)] + [(5 + 6, 10, 50)])[-1]
    assert not math.isclose(floor, 50 / 10 * 3600)
    again = [(60 * i, 10, 50) for i in range(8)]
    t = again[-1][0]
    got = _runtime(again + [(t + 3600, 10, 50), (t + 3660, 10, 50), (t + 4860, 2, 50)])
    assert math.isclose(got[-1], 50 / 2 * 3600)


def test_golden_pack_temperature():
    fold = O.PackTemperature()
    assert fold.step(fold.init(), (0, None, 20.0, 10.0))[1] == (None,)
    mean = (25 * 0.0017 + 18 * 0.0006 + 10 * 0.0009) / 0.0032
    _, out = walk(fold, [(60_000_000 * i, 25.0, 18.0, 10.0) for i in range(5000)], [40.0, -60_000_000])
    assert abs(out[-1][0] - mean) < 0.01
    fine = walk(fold, [(60_000_000 * i, 30.0, 20.0, 20.0) for i in range(1, 51)], [20.0, 0])[1][-1][0]
    coarse = walk(fold, [(120_000_000 * i, 30.0, 20.0, 20.0) for i in range(1, 26)], [20.0, 0])[1][-1][0]
    assert abs(fine - coarse) < 0.05
    back = fold.step([50.0, 0], (3 * 3600 * 1_000_000, 25.0, 18.0, 10.0))[1][0]
    assert abs(back - mean) < 0.5
    assert [O.valid_temperature(x) for x in (20, -10, None, -200, 300)] == [True, True, False, False, False]
