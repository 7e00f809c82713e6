"""Byte-level column expressions and the layouts of captured frames."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def bytes_at(frame: Column, offset: int | Column, length: int) -> Column:
    pos = F.lit(offset + 1) if isinstance(offset, int) else offset + 1
    return F.substr(frame, pos, F.lit(length))


def byte_at(frame: Column, offset: int | Column) -> Column:
    return F.conv(F.hex(bytes_at(frame, offset, 1)), 16, 10).cast("int")


def number_at(frame: Column, offset: int | Column, length: int, endian: str = "big", signed: bool = False) -> Column:
    """Integer read from `length` bytes; eight unsigned bytes come back as a decimal. NULL beyond the frame."""
    if endian == "big" or length == 1:
        raw = bytes_at(frame, offset, length)
    else:
        raw = F.concat(*[bytes_at(frame, offset + i, 1) for i in reversed(range(length))])
    wide = length >= 8 and not signed
    text = F.conv(F.hex(raw), 16, 10)
    v = text.cast("decimal(20,0)") if wide else text.cast("long")
    if signed:
        v = F.when(v >= 2 ** (8 * length - 1), v - 2 ** (8 * length)).otherwise(v)
    return F.when(F.length(raw) == length, v)


@F.arrow_udf(T.IntegerType())
def _byte_sum(frame: pa.Array, start: pa.Array, stop: pa.Array) -> pa.Array:
    """Sums over the flat byte buffer of the whole batch; no Python per row."""
    data, offsets = _flat(frame)
    upto = np.concatenate([[0], np.cumsum(data, dtype=np.int64)])
    size = np.diff(offsets)
    lo, hi = _bounds(start, size), _bounds(stop, size)
    out = upto[offsets[:-1] + np.maximum(lo, hi)] - upto[offsets[:-1] + lo]
    return pa.array(out.astype(np.int32), mask=frame.is_null().to_numpy(zero_copy_only=False))


@F.arrow_udf(T.IntegerType())
def _crc16(frame: pa.Array, stop: pa.Array) -> pa.Array:
    """Byte position by byte position, over all frames of the batch at once."""
    data, offsets = _flat(frame)
    size = _bounds(stop, np.diff(offsets))
    table = np.array(_crc_table(), dtype=np.int32)
    crc = np.full(len(size), 0xFFFF, dtype=np.int32)
    for pos in range(int(size.max(initial=0))):
        live = np.flatnonzero(size > pos)
        crc[live] = (crc[live] >> 8) ^ table[(crc[live] ^ data[offsets[live] + pos]) & 0xFF]
    return pa.array(crc, mask=frame.is_null().to_numpy(zero_copy_only=False))


def _flat(frame: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the batch in one array, and where each frame starts."""
    sizes = np.array(pc.fill_null(pc.binary_length(frame), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    return np.frombuffer(b"".join(frame.drop_null().to_pylist()), dtype=np.uint8), offsets


def _bounds(at: pa.Array, size: np.ndarray) -> np.ndarray:
    return np.clip(np.array(pc.fill_null(at, 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0, size)


def _array_reader(size: int, endian: str, signed: bool):
    """UDF over a batch of frames: `count` numbers of `size` bytes each from `at` on; NULL beyond the frame."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def read(frame: pa.Array, at: pa.Array, count: pa.Array) -> pa.Array:
        data, offsets = _flat(frame)
        data = np.append(data, 0)  # somewhere to point at when a number lies beyond its frame
        n = np.maximum(np.array(pc.fill_null(count, 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0)
        ends = np.cumsum(n)
        nth = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n)
        first = offsets[:-1] + np.array(pc.fill_null(at, 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        pos = np.repeat(first, n) + nth * size
        inside = pos + size <= np.repeat(offsets[1:], n)
        pos = np.where(inside, pos, 0)
        value = np.zeros(len(pos), dtype=np.int64)
        for i in range(size):
            shift = 8 * (size - 1 - i if endian == "big" else i)
            value |= data[np.minimum(pos + i, len(data) - 1)].astype(np.int64) << shift
        if signed and size < 8:
            value -= (value >> (8 * size - 1)) << (8 * size)
        lists = np.concatenate([[0], ends]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(lists), pa.array(value, mask=~inside), mask=frame.is_null())

    return read


def numbers_at(frame: Column, offset: int, length: int, count: Column, endian: str = "big", signed: bool = False) -> Column:
    """Array of equal numbers, decoded for the whole batch at once (up to 7 bytes each)."""
    return _array_reader(length, endian, signed)(frame, F.lit(offset), count.cast("int"))


def byte_sum(frame: Column, start: int = 0, stop: Column | int | None = None) -> Column:
    """Sum of the bytes in [start, stop)."""
    stop = F.length(frame) if stop is None else F.lit(stop) if isinstance(stop, int) else stop
    return _byte_sum(frame, F.lit(start), stop.cast("int"))


def _crc_table() -> list[int]:
    """One entry per byte value, from the reflected polynomial 0xA001."""
    table = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xA001 if value & 1 else 0)
        table.append(value)
    return table


def crc16_modbus(frame: Column, stop: Column | int | None = None) -> Column:
    """CRC of the first `stop` bytes."""
    stop = F.length(frame) if stop is None else F.lit(stop) if isinstance(stop, int) else stop
    return _crc16(frame, stop.cast("int"))


# --- validity ---------------------------------------------------------------------------------


def _first_failure(checks: Sequence[tuple[Column, str]]) -> Column:
    """Name of the first check that does not hold, else NULL."""
    out = None
    for ok, name in checks:
        bad = ~F.coalesce(ok, F.lit(False))
        out = F.when(bad, name) if out is None else out.when(bad, name)
    return out


def invalid_jbd(f: Column) -> Column:
    n = F.length(f)
    return _first_failure(
        [
            (n >= 7, "short"),
            (byte_at(f, 0) == 0xDD, "header"),
            (n == byte_at(f, 3) + 7, "length"),
            (byte_at(f, n - 1) == 0x77, "terminator"),
            (byte_at(f, 2) == 0, "status"),
            (number_at(f, n - 3, 2) == F.pmod(F.lit(0x10000) - byte_sum(f, 2, n - 3), F.lit(0x10000)), "checksum"),
        ]
    )


def invalid_jk(f: Column) -> Column:
    n = F.length(f)
    return _first_failure(
        [
            (n >= 300, "short"),
            (F.hex(bytes_at(f, 0, 4)) == "55AAEB90", "header"),
            (byte_sum(f, 0, 299) % 256 == byte_at(f, 299), "checksum"),
            (byte_at(f, 4).isin(1, 2, 3), "type"),
        ]
    )


def invalid_daly(f: Column) -> Column:
    return _first_failure(
        [
            (F.length(f) == 13, "length"),
            (byte_at(f, 0) == 0xA5, "header"),
            (byte_sum(f, 0, 12) % 256 == byte_at(f, 12), "checksum"),
        ]
    )


def invalid_basen(f: Column) -> Column:
    n = F.length(f)
    return _first_failure(
        [
            (n >= 8, "short"),
            (byte_at(f, 0).isin(0x3A, 0x3B), "header"),
            (byte_at(f, 1) == 0x16, "address"),
            (n == byte_at(f, 3) + 8, "length"),
            (F.hex(bytes_at(f, n - 2, 2)) == "0D0A", "terminator"),
            (number_at(f, n - 4, 2, "little") == byte_sum(f, 1, n - 4) % 65536, "checksum"),
        ]
    )


def invalid_modbus(f: Column) -> Column:
    end = byte_at(f, 2) + 3
    return _first_failure(
        [
            (F.length(f) >= 5, "short"),
            ((byte_at(f, 0) == 1) & (byte_at(f, 1) == 3), "header"),
            (F.length(f) >= end + 2, "length"),
            (number_at(f, end, 2, "little") == crc16_modbus(f, end), "checksum"),
        ]
    )


VALIDATORS = {"jbd": invalid_jbd, "jk": invalid_jk, "daly": invalid_daly, "basen": invalid_basen, "modbus": invalid_modbus}


# --- layouts ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Num:
    """value = (raw + add) / div, NULL for the raw codes in `missing`; a negative `div` flips the sign."""

    name: str
    offset: int
    length: int
    div: float = 1
    add: int = 0
    signed: bool = False
    endian: str = "big"
    missing: tuple[int, ...] = ()


@dataclass(frozen=True)
class Nums(Num):
    """Array of equal fields; the number of elements is fixed or read from an earlier `Num` of the layout.

    As many are read as the frame declares, NULL where it ends earlier, but never more than the bytes from `at` on could
    hold; `limit` is for layouts that fix a number themselves.
    """

    count: int | str = 1
    limit: int | None = None
    drop_missing: bool = False


@dataclass(frozen=True)
class Flag:
    """True when any bit of `mask` is set in the byte."""

    name: str
    offset: int
    mask: int = 0xFF


@dataclass(frozen=True)
class Layout:
    """Fields of one frame kind; offsets count from `base`."""

    fields: tuple[Num | Nums | Flag, ...]
    base: int = 0
    hidden: tuple[str, ...] = ()


def LE(*a, **k):
    return Num(*a, endian="little", **k)


#: fixed values: field layouts per frame kind
LAYOUTS: dict[str, Layout] = {
    "jbd_info": Layout(
        base=4,
        hidden=("n_temps",),
        fields=(
            Num("voltage", 0, 2, 100),
            Num("current", 2, 2, -100, signed=True),
            Num("charge", 4, 2, 100),
            Num("capacity", 6, 2, 100),
            Num("num_cycles", 8, 2),
            Num("problem_code", 16, 2),
            Num("soc", 19, 1),
            Flag("switch_charge", 20, 1),
            Flag("switch_discharge", 20, 2),
            Num("n_cells", 21, 1),
            Num("n_temps", 22, 1),
            Nums("temperatures", 23, 2, 10, -2731, count="n_temps"),
        ),
    ),
    "jbd_cells": Layout(
        base=4, hidden=("n_bytes",), fields=(Num("n_bytes", -1, 1), Nums("cell_mv", 0, 2, count="n_bytes/2"))
    ),
    "daly_90": Layout(fields=(Num("voltage", 0, 2, 10, signed=True), Num("current", 4, 2, 10, -30000), Num("soc", 6, 2, 10, signed=True))),
    "daly_93": Layout(fields=(Num("mode", 0, 1, signed=True), Flag("charging_mosfet", 1), Flag("discharging_mosfet", 2), Num("charge", 4, 4, 1000, signed=True))),
    "daly_94": Layout(fields=(Num("n_cells", 0, 1), Num("n_temps", 1, 1), Flag("charging", 2), Flag("discharging", 3), Num("io_states", 4, 1), Num("num_cycles", 5, 2, signed=True))),
    "daly_95": Layout(fields=(Num("frame_no", 0, 1), Nums("cell_mv", 1, 2, signed=True, count=3))),
    "daly_96": Layout(fields=(Num("frame_no", 0, 1), Nums("temperatures", 1, 1, 1, -40, signed=True, count=7))),
    "daly2": Layout(
        base=3,
        hidden=("n_temps",),
        fields=(
            Num("voltage", 80, 2, 10),
            Num("current", 82, 2, 10, -30000),
            Num("soc", 84, 2, 10),
            Num("charge", 96, 2, 10),
            Num("n_cells", 98, 2),
            Num("n_temps", 100, 2),
            Num("num_cycles", 102, 2),
            Nums("temperatures", 64, 2, 1, -40, count="n_temps"),
            Num("charge_mosfet", 106, 2),
            Num("discharge_mosfet", 108, 2),
            Num("problem_code", 116, 8),
            Nums("cell_mv", 0, 2, count="n_cells", limit=48),
        ),
    ),
    "jk_settings": Layout(
        fields=(LE("capacity", 130, 4, 1000), Flag("switch_charge", 118), Flag("switch_discharge", 122), Flag("switch_balance", 126), Flag("switch_float_charge", 283, 2))
    ),
    "jk_status_24s": Layout(
        fields=(
            LE("voltage", 118, 4, 1000),
            LE("current", 126, 4, -1000, signed=True),
            Nums("temperatures", 130, 2, 10, signed=True, endian="little", missing=(-2000,), count=2),
            LE("mos_temperature", 134, 2, 10, signed=True),
            LE("balance_current", 138, 2, 1000, signed=True),
            Num("soc", 141, 1),
            LE("charge", 142, 4, 1000),
            LE("num_cycles", 150, 4),
            LE("total_charge_throughput", 154, 4, 1000),
            LE("uptime", 162, 4),
            Nums("cell_mv", 6, 2, endian="little", count=24),
        )
    ),
    "jk_status_32s": Layout(
        fields=(
            LE("voltage", 150, 4, 1000),
            LE("current", 158, 4, -1000, signed=True),
            Nums("temperatures", 162, 2, 10, signed=True, endian="little", missing=(-2000,), count=2),
            Nums("temperatures_far", 256, 2, 10, signed=True, endian="little", missing=(-2000,), count=2),
            LE("mos_temperature", 144, 2, 10, signed=True),
            LE("balance_current", 170, 2, 1000, signed=True),
            Num("soc", 173, 1),
            LE("charge", 174, 4, 1000),
            LE("aged_capacity", 178, 4, 1000),
            LE("num_cycles", 182, 4),
            LE("total_charge_throughput", 186, 4, 1000),
            Num("soh", 190, 1),
            LE("uptime", 194, 4),
            Nums("cell_mv", 6, 2, endian="little", count=32),
        )
    ),
    "litime": Layout(
        fields=(
            LE("voltage", 12, 4, 1000),
            LE("current", 48, 4, -1000, signed=True),
            Nums("temperatures", 52, 2, signed=True, endian="little", count=1),
            LE("mos_temperature", 54, 2),
            LE("charge", 62, 2, 100),
            LE("capacity", 64, 2, 100),
            LE("soc", 90, 2),
            LE("num_cycles", 96, 4),
            LE("total_charge_throughput", 100, 4),
            Nums("cell_mv", 16, 2, endian="little", missing=(0,), count=16, drop_missing=True),
        )
    ),
    "modbus_info": Layout(base=3, fields=(Num("n_cells", 0, 2), Num("n_temps", 2, 2))),
    "modbus_volts": Layout(base=3, fields=(Num("voltage", 74, 2, 100), Nums("cell_mv", 0, 2, missing=(0xEE49, 0), count=32, drop_missing=True))),
    "modbus_capacity": Layout(
        base=3,
        fields=(
            Num("temperature", 0, 2, 10, -400, missing=(0,)),
            Num("charge_a", 24, 2, 10),
            Num("discharge_a", 26, 2, 10),
            Num("soc", 28, 2),
            Num("soh", 30, 2),
            Num("charge", 32, 2, 10),
            Num("aged_capacity", 34, 2, 10),
            Num("capacity", 36, 2, 10),
            Num("num_cycles", 38, 2),
        ),
    ),
    "basen_status": Layout(
        fields=(
            LE("current", 4, 4, -1000, signed=True),
            LE("voltage", 8, 4, 1000),
            Nums("temperatures", 12, 1, signed=True, count=4),
            LE("charge", 16, 4, 1000),
            Num("charge_states", 20, 1),
            Num("discharge_states", 21, 1),
            Num("charge_warn", 22, 1),
            Num("discharge_warn", 23, 1),
            Num("soc", 24, 1),
        )
    ),
    "basen_info": Layout(fields=(LE("capacity", 4, 4, 1000), LE("nominal_voltage", 8, 4, 1000), LE("aged_capacity", 12, 4, 1000), LE("num_cycles", 26, 2))),
    "basen_cells": Layout(hidden=("n_bytes",), fields=(Num("n_bytes", 3, 1), Nums("cell_mv", 4, 2, endian="little", count="n_bytes/2"))),
    "meter_a": Layout(fields=(Num("voltage", 4, 3, 10), Num("current", 7, 3, 1000, signed=True), Num("charge", 10, 3, 1000), Num("energy", 13, 4, 100), Num("temperature", 24, 2))),
    "meter_b": Layout(fields=(Num("voltage", 4, 2, 10), Num("current", 6, 2, 1000, signed=True), Num("charge", 8, 3, 1000), Num("energy", 11, 4, 100), Num("temperature", 24, 2))),
}


def _value(raw: Column, f: Num) -> Column:
    known = F.when(~raw.isin(*f.missing), raw) if f.missing else raw
    whole = f.div == 1
    shifted = known + f.add if f.add else known
    if whole:
        return shifted
    v = shifted / F.lit(float(abs(f.div)))
    # subtract from zero, so that a zero reading stays +0
    return F.lit(0.0) - v if f.div < 0 else v


def _scaled(f: Nums):
    return lambda raw: _value(raw, f)


def decode(frame: Column, layout: Layout) -> dict[str, Column]:
    """Column expressions of every field of the layout."""
    out: dict[str, Column] = {}
    for f in layout.fields:
        at = layout.base + f.offset
        if isinstance(f, Flag):
            out[f.name] = byte_at(frame, at).bitwiseAND(F.lit(f.mask)) > 0
        elif isinstance(f, Nums):
            if isinstance(f.count, str):
                name, _, by = f.count.partition("/")
                n = F.floor(out[name] / int(by or 1)).cast("int")
            else:
                n = F.lit(f.count)
            if f.limit is not None:
                n = F.least(n, F.lit(f.limit))
            raw = numbers_at(frame, at, f.length, n, f.endian, f.signed)
            plain = f.div == 1 and not f.add and not f.missing
            values = raw if plain else F.transform(raw, _scaled(f))
            out[f.name] = F.array_compact(values) if f.drop_missing else values
        else:
            out[f.name] = _value(number_at(frame, at, f.length, f.endian, f.signed), f)
    return {k: v for k, v in out.items() if k not in layout.hidden}
