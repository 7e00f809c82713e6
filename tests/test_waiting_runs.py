"""Many rows of a key at once: they wait in runs and come out in order, and no part of the work holds them all."""

import json
import random

import pandas as pd
import pytest
from test_waiting_rows import Handle, Map

from fleetwatt.operators import folds as O
from fleetwatt.streaming import folds as S


class Maps(Handle):
    def __init__(self):
        super().__init__()
        self.maps = {}

    def getMapState(self, name, key, value):
        return self.maps.setdefault(name, Map())


class Timer:
    def __init__(self, t_us):
        self.ms = t_us // 1000

    def getCurrentWatermarkInMs(self):
        return self.ms


N = 4000


def batch(rows):
    return (pd.DataFrame(rows[i : i + 50], columns=["t_us", "seq", "arg_x"]) for i in range(0, len(rows), 50))


def out_of(frames):
    parts = [list(f.itertuples(index=False)) for f in frames]
    return [r for p in parts for r in p], max(map(len, parts), default=0)


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(S, "HELD_ROWS", 200)
    monkeypatch.setattr(S, "PIECE_ROWS", 10)


def rows_in_any_order():
    rnd = random.Random(3)
    rows = [(rnd.randrange(3000) * 1_000_000, i, rnd.uniform(0, 9)) for i in range(N)]
    rnd.shuffle(rows)
    return rows


def folded(rows):
    fold, state, want = O.Ewma(4), None, []
    for t, seq, x in sorted(rows):
        state, (y,) = fold.step(state, (x,))
        want.append((t, seq, y))
    return want


def test_rows_wait_in_runs_and_come_out_in_order(small):
    rows = rows_in_any_order()
    p = S.FoldProcessor(O.Ewma(4), ["device"], ["t_us", "seq", "arg_x"], ["ewma"])
    p.init(Maps())
    assert not list(p.handleInputRows(("a",), batch(rows), Timer(-1_000_000)))
    # 20 runs of 20 pieces
    assert max(len(json.loads(v[0])) for m in p.handle.maps.values() for v in m.d.values()) <= 10
    got, largest = [], 0
    for limit in (1_000_000_000, 1_500_000_000, 9_000_000_000):
        part, size = out_of(p.handleExpiredTimer(("a",), Timer(limit), None))
        assert part and max(r.t_us for r in part) <= limit
        got, largest = got + part, max(largest, size)
    assert [(r.t_us, r.seq, r.ewma) for r in got] == folded(rows)
    # at most what is held and a piece of each run come out at a time
    assert largest <= 2 * 200 + 20 * 10
    assert not any(m.d for m in p.handle.maps.values())


def test_own_clock_with_many_rows(small):
    rows = rows_in_any_order()
    p = S.FoldProcessor(O.Ewma(4), ["device"], ["t_us", "seq", "arg_x"], ["ewma"], 500_000_000)
    p.init(Maps())
    first, largest = out_of(p.handleInputRows(("a",), batch(rows[:3000]), None))
    clock = max(r[0] for r in rows[:3000]) - 500_000_000
    assert [(r.t_us, r.seq, r.ewma) for r in first] == folded([r for r in rows[:3000] if r[0] <= clock])
    second, size = out_of(p.handleInputRows(("a",), batch(rows[3000:]), None))
    assert {r.seq for r in second if r.late} == {r[1] for r in rows[3000:] if r[0] <= clock}
    assert max(largest, size) <= 2 * 200 + 20 * 10


def test_entities_over_many_rows(small):
    rows = sorted((t, i, 60_000_000) for i, t in enumerate(random.Random(5).sample(range(0, 90_000_000_000, 1000), N)))
    p = S.EntityProcessor(["device"])
    p.init(Maps())
    feed = random.Random(6).sample(rows, N)
    frames = (pd.DataFrame(feed[i : i + 50], columns=["t_us", "seq", "expire_us"]) for i in range(0, N, 50))
    assert not list(p.handleInputRows(("a",), frames, Timer(-1_000_000)))
    got, largest = out_of(p.handleExpiredTimer(("a",), Timer(10**12), None))
    times = [r[0] for r in rows]
    on = [t for b, t in zip([None, *times], times) if b is None or t - b > 60_000_000]
    off = [t + 60_000_000 for t, n in zip(times, [*times[1:], None]) if n is None or n - t > 60_000_000]
    assert [r.t_us for r in got if r.available] == on and [r.t_us for r in got if not r.available] == off
    assert largest <= 2 * (2 * 200 + 20 * 10)
