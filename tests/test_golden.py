"""Known vectors: meters, groups, ambient payloads, frames, ids."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetwatt.functions import frames as B
from fleetwatt.functions import scalar as S
from fleetwatt.operators import frames as R
from fleetwatt.operators import groups as G
from fleetwatt.operators import meters as M
from fleetwatt.sources import readers

T0 = datetime(2024, 1, 1)


def series(spark, points):
    """(hours, value) pairs, in order, as one device's rows."""
    rows = [("d", T0 + timedelta(hours=h), i, float(v)) for i, (h, v) in enumerate(points)]
    return spark.createDataFrame(rows, "device string, ts timestamp, event_id long, y double")


def readings(df):
    return [round(r.reading, 5) for r in df.orderBy("event_id").collect()]


def test_trapezoid(spark):
    df = series(spark, [(0, 1), (1, 1), (1, 2), (2, 2), (3, 3), (5, 3)])
    assert readings(M.integrate(df, F.col("y"), 3600, "reading")) == [0, 1, 1, 3, 5.5, 5.5]


def test_abs_diff(spark):
    df = series(spark, [(0, 1), (1, 1), (1, 1.1), (2, 1.2), (3, 1.25), (4, 1), (5, 0.95)])
    assert readings(M.abs_diff_sum(df, F.col("y"), 3600, 0.1, "reading")) == [0, 0, 0, 0.1, 0.15, 0.15, 0.2]


def test_group(spark):
    rows = [("g", 0, "a", 0, T0, 12.2, 2.0, 24.4, 33.0, 100.0, 33.0), ("g", 0, "b", 1, T0, 12.4, 3.0, 37.2, 77.0, 100.0, 77.0)]
    df = spark.createDataFrame(rows, "group string, tick long, member string, ord int, ts timestamp, voltage double, current double, power double, charge double, capacity double, soc double")
    r = G.sum_parallel(df).first()
    assert (round(r.voltage, 6), r.current, r.charge, r.capacity, r.soc) == (12.3, 5.0, 110.0, 200.0, 55.0)


def test_switches_of_the_later_member_win(spark):
    rows = [("g", 0, 1, {"charge": False, "balance": True}), ("g", 0, 0, {"charge": True}), ("g", 0, 2, None)]
    df = spark.createDataFrame(rows, "group string, tick long, ord int, switches map<string,boolean>")
    assert G.merge_switches(df).first().switches == {"charge": False, "balance": True}


def test_group_waits_for_all_members(spark):
    rows = [("a", T0 + timedelta(minutes=m), m, 12.0) for m in (1, 2, 3, 9)] + [("b", T0 + timedelta(minutes=5), 99, 13.0)]
    df = spark.createDataFrame(rows, "device string, ts timestamp, event_id long, voltage double")
    members = spark.createDataFrame([("g", "a", 0), ("g", "b", 1), ("h", "a", 0), ("h", "never", 1)], "group string, member string, ord int")
    got = G.align_group(df, members, 60)
    by_tick = {(r.group, r.member, r.tick - int(got.agg(F.min("tick")).first()[0])): r.event_id for r in got.collect()}
    assert {k[0] for k in by_tick} == {"g"}
    assert by_tick[("g", "a", 0)] == 3 and by_tick[("g", "b", 0)] == 99 and by_tick[("g", "a", 240)] == 9


@pytest.mark.parametrize(
    "payload, value",
    [("18.42", 18.42), ("-5", -5.0), ('{"state": "18.42"}', 18.42), ('{"value": 7.5}', 7.5), ('{"temperature": 25.0}', 25.0),
     (None, None), ("", None), ("unavailable", None), ("{ not json }", None), ("99999", None), ("nan", None)],
)
def test_ambient(spark, payload, value):
    df = spark.createDataFrame([(payload,)], "p string")
    assert df.select(readers.parse_ambient("p")).first()[0] == value


def decoded(spark, text, layout):
    df = spark.createDataFrame([(bytearray.fromhex(text),)], "frame binary")
    return R.decode_frames(df, layout).first()


def test_jbd_frames(spark):
    a = decoded(spark, "dd03001b0a50fda4b717dac000002cf300000000000016540308020b7d0b77f8e277", "jbd_info")
    assert (a.voltage, a.current, a.charge, a.capacity, list(a.temperatures), a.problem_code) == (26.40, 6.04, 468.71, 560.0, [21.0, 20.4], 0)
    assert a.switch_charge and a.switch_discharge
    b = decoded(spark, "dd03001d0617000001f301f400002c7c00000000000080640304030b8d0b8c0b88fa8577", "jbd_info")
    assert (b.voltage, b.current, b.charge, b.capacity, list(b.temperatures)) == (15.59, 0.0, 4.99, 5.0, [22.6, 22.5, 22.1])


def test_daly_frames(spark):
    a = decoded(spark, "010101ca0003dd38", "daly_93")
    assert a.mode == 1 and a.charge == 253.24
    b = decoded(spark, "08010000020035dc", "daly_94")
    assert (b.n_cells, b.n_temps, b.num_cycles, b.io_states) == (8, 1, 53, 2)
    c = decoded(spark, "0108000075620311", "daly_90")
    assert (c.voltage, c.current, c.soc) == (26.4, 5.0, 78.5)


def test_other_frames(spark):
    s = decoded(spark, "3b162a1800000000ce610000121419196323000080800000080200006f030d0a", "basen_status")
    assert (s.voltage, s.charge, s.soc, list(s.temperatures)) == (25.038, 9.059, 8, [18, 20, 25, 25])
    m = decoded(spark, "0103080004000100060005cdd5", "modbus_info")
    assert (m.n_cells, m.n_temps) == (4, 1)
    df = spark.createDataFrame([(bytearray.fromhex("ff5501020d440df700208d00000b2f000064000000000020003b1c1d3c0000000023"),)], "frame binary")
    w = R.decode_meter(df).first()
    assert (w.voltage, w.current, w.charge, w.energy, w.temperature, w.power) == (339.6, 3.575, 8.333, 28.63, 59, 1214.0)


def test_validity(spark):
    rows = [("0103080004000100060005cdd5", True), ("0103080004000100060005cdd4", False), ("0103", False)]
    df = spark.createDataFrame([(bytearray.fromhex(h), ok) for h, ok in rows], "frame binary, want boolean")
    assert all(r.ok == r.want for r in R.frame_valid(df, "modbus").collect())
    good = "dd03001b0a50fda4b717dac000002cf300000000000016540308020b7d0b77f8e277"
    rows = [(good, None), (good[:-2] + "78", "terminator"), (good[:-6] + "000077", "checksum"), (good[:8], "short"), ("dc" + good[2:], "header"), (good + "00", "length")]
    df = spark.createDataFrame([(bytearray.fromhex(h), why) for h, why in rows], "frame binary, why string")
    assert all(r.reason == r.why for r in df.select("why", B.invalid_jbd(F.col("frame")).alias("reason")).collect())


def test_hash(spark):
    df = spark.createDataFrame([("AA:BB",), ("",)], "s string")
    assert [r[0] for r in df.select(S.hash_id("s")).collect()] == ["3lcw6riAV-upcQ", None]


def jk_frame(kind, fill):
    body = bytes([0x55, 0xAA, 0xEB, 0x90, kind]) + bytes([fill]) * 294
    return body + bytes([sum(body) % 256])


def test_reassembly():
    a, b = jk_frame(1, 7), jk_frame(2, 9)
    cut = lambda buf: R.cut_frames(buf, R.FRAMINGS["jk"])
    assert cut(a + b)[0] == [a, b]
    state, got = b"", []
    stream = b"AT\r\n" + a + b"junk" + b
    for i in range(0, len(stream), 20):
        frames, _, _, state = cut(state + stream[i : i + 20])
        got += frames
    assert got == [a, b]
    bad = a[:100] + bytes([a[100] ^ 1]) + a[101:]
    frames, _, corrupt, _ = cut(bad + b)
    assert frames == [b] and corrupt == 1
    unknown = jk_frame(9, 1)
    assert cut(unknown + b)[0] == [b]


def test_bit_diff_word_edges(spark):
    rows = [("A", "ff00000001"), ("A", "ff00000001"), ("B", "fe00000003"), ("B", "fe00000003"), ("C", "0000000000")]
    df = spark.createDataFrame([(l, bytearray.fromhex(h)) for l, h in rows], "label string, frame binary")
    assert sorted((r.bit, r.in_a, r.in_b) for r in R.bit_diff(df, 5).collect()) == [(0, 1, 0), (33, 0, 1)]
