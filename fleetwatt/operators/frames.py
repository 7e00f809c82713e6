"""Jobs over captured frames: decode, validate, reassemble, compare bits."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwatt.functions.frames import LAYOUTS, VALIDATORS, decode, number_at, numbers_at
from fleetwatt.functions.scalar import round_half_even
from fleetwatt.operators.fold import Fold, run_fold
from fleetwatt.operators.timeline import DEVICE_TIME, Timeline


def decode_frames(frames: DataFrame, layout: str, frame: str = "frame") -> DataFrame:
    return frames.withColumns(decode(F.col(frame), LAYOUTS[layout]))


def decode_meter(frames: DataFrame, frame: str = "frame") -> DataFrame:
    """The meter plug-in: the compact layout when its values are plausible, else the padded one."""
    b, a = decode(F.col(frame), LAYOUTS["meter_b"]), decode(F.col(frame), LAYOUTS["meter_a"])
    within = lambda c, lo, hi: c.isNull() | c.between(lo, hi)
    ok = (
        b["voltage"].between(0.1, 1000.0) & within(b["current"], -1000.0, 1000.0)
        & within(b["charge"], 0.0, 1e6) & within(b["energy"], 0.0, 1e6)
    )
    out = {n: F.when(ok, b[n]).otherwise(a[n]) for n in b}
    out["power"] = F.rint(out["voltage"] * out["current"])
    out["battery_charging"] = out["current"] > 0
    return frames.withColumns(out)


def modbus_cells(df: DataFrame, count: str = "n_cells", cells: str = "cell_mv", frame: str = "frame") -> DataFrame:
    """With a known cell count the first slots are the cells, whatever they read."""
    raw = numbers_at(F.col(frame), 3, 2, F.col(count))
    return df.withColumn(cells, F.when(F.col(count) > 0, raw).otherwise(F.col(cells)))


def join_numbered(df: DataFrame, values: str, out: str, keys=("device", "ts"), number: str = "frame_no", count: str | None = None) -> DataFrame:
    """Answers that come in numbered parts -> one array per poll; NULL when a part is missing or doubled."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(number).alias("no"), F.col(values).alias("v"))))
    agg = [parts.alias("__p")] + ([F.max(count).alias("__n")] if count else [])
    df = df.groupBy(*keys).agg(*agg)
    in_order = F.forall(F.transform("__p", lambda p, i: p["no"] == i + 1), lambda ok: ok)
    flat = F.flatten(F.transform("__p", lambda p: p["v"]))
    if count:
        flat = F.slice(flat, F.lit(1), F.col("__n").cast("int"))
    return df.select(*keys, F.when(in_order, flat).alias(out))


def jk_soc(df: DataFrame, aged: str | None = "aged_capacity", capacity: str = "capacity") -> DataFrame:
    """Full-precision state of charge from the device's own charge and capacity."""
    full = F.col(aged) if aged else F.lit(None).cast("double")
    fine = F.when((full > 0) & (F.col("charge") > 0), round_half_even(F.col("charge") / full * 100, 2))
    again = F.when((F.col(capacity) > 0) & (F.col("charge") > 0), round_half_even(F.col("charge") / F.col(capacity) * 100, 2))
    return df.withColumn("soc", F.coalesce(fine, again, F.col("soc").cast("double")))


def frame_valid(frames: DataFrame, protocol: str, frame: str = "frame") -> DataFrame:
    reason = VALIDATORS[protocol](F.col(frame))
    return frames.withColumn("reason", reason).withColumn("ok", F.col("reason").isNull())


# --- reassembly -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Framing:
    """How frames sit in a byte stream."""

    header: bytes
    need: int
    size: Callable[[bytes], int]
    valid: Callable[[bytes], bool]
    #: after a bad frame: look for the next header, or drop the bad frame's bytes
    rescan: bool


def _sum_ok(frame: bytes) -> bool:
    return sum(frame[:-1]) % 256 == frame[-1]


def _twos_ok(frame: bytes) -> bool:
    return (
        frame[-1] == 0x77 and frame[2] == 0
        and int.from_bytes(frame[-3:-1], "big") == -sum(frame[2:-3]) % 65536
    )


#: fixed values: headers, sizes and response types of the streams
FRAMINGS = {
    "jk": Framing(bytes.fromhex("55aaeb90"), 300, lambda b: 300, lambda f: _sum_ok(f) and f[4] in (1, 2, 3), True),
    "jbd": Framing(b"\xdd", 4, lambda b: b[3] + 7, _twos_ok, False),
    "daly": Framing(b"\xa5", 13, lambda b: 13, _sum_ok, False),
}


def cut_frames(buffer: bytes, framing: Framing) -> tuple[list[bytes], int, int, bytes]:
    """(valid frames, junk bytes, corrupt frames, bytes to keep for the next chunk)."""
    frames, junk, corrupt, head = [], 0, 0, framing.header
    pos = 0
    while True:
        at = buffer.find(head, pos)
        if at < 0:
            # the end of the buffer may be the beginning of a header
            keep = min(len(head) - 1, len(buffer) - pos)
            junk += len(buffer) - pos - keep
            return frames, junk, corrupt, buffer[len(buffer) - keep :]
        junk += at - pos
        if len(buffer) - at < framing.need or len(buffer) - at < framing.size(buffer[at:]):
            return frames, junk, corrupt, buffer[at:]
        size = framing.size(buffer[at:])
        frame = buffer[at : at + size]
        if framing.valid(frame):
            frames.append(frame)
            pos = at + size
        else:
            corrupt += 1
            if not framing.rescan:
                pos = at + size
                continue
            # the bad frame's bytes up to the next header are dropped with it
            nxt = buffer.find(head, at + len(head))
            if nxt < 0:
                return frames, junk, corrupt, buffer[max(at, len(buffer) - len(head) + 1) :]
            pos = nxt


class Reassemble(Fold):
    """Chunks of a byte stream -> the frames each chunk completes."""

    inputs = ("chunk",)
    output = "frames array<binary>, junk_bytes int, corrupt int"

    def __init__(self, protocol: str):
        self.protocol = protocol

    def init(self):
        return ""

    def step(self, state, row):
        (chunk,) = row
        frames, junk, corrupt, rest = cut_frames(bytes.fromhex(state) + bytes(chunk or b""), FRAMINGS[self.protocol])
        return rest.hex(), (frames, junk, corrupt)


def reassemble(chunks: DataFrame, protocol: str, tl: Timeline | None = None) -> DataFrame:
    """chunks(device, ts, seq, chunk) -> one row per chunk with the frames it completed."""
    tl = tl or Timeline(("device",), "ts", ("ts", "seq"), DEVICE_TIME.width_s)
    return run_fold(chunks, Reassemble(protocol), {"chunk": F.col("chunk")}, tl)


def bit_diff(frames: DataFrame, n_bytes: int, label: str = "label", a: str = "A", b: str = "B", frame: str = "frame") -> DataFrame:
    """Bits that are constant within each label and differ between the two.

    Every label is reduced to the AND and the OR of its frames, four bytes at a time, before any bit is
    looked at: a bit is constant where both agree. Bit 0 is the lowest bit of the first byte.
    """
    n_words = -(-n_bytes // 4)
    width = lambda i: min(4, n_bytes - 4 * i)
    words = [number_at(F.col(frame), 4 * i, width(i), "little").alias(f"w{i}") for i in range(n_words)]
    per = frames.select(F.col(label).alias("__l"), *words)
    agg = []
    for side, value in (("a", a), ("b", b)):
        for i in range(n_words):
            w = F.when(F.col("__l") == value, F.col(f"w{i}"))
            agg += [F.bit_and(w).alias(f"{side}and{i}"), F.bit_or(w).alias(f"{side}or{i}")]
    one = per.filter(F.col("__l").isin(a, b)).agg(*agg)
    bits = F.array(
        *[
            F.struct(F.lit(4 * i * 8).alias("base"), F.lit(8 * width(i)).alias("n"), *[F.col(f"{s}{o}{i}").alias(f"{s}{o}") for s in "ab" for o in ("and", "or")])
            for i in range(n_words)
        ]
    )
    flat = one.select(F.explode(bits).alias("w")).select("w.*").select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    at = lambda c: F.getbit(F.col(c), F.col("i"))
    return flat.select(
        (F.col("base") + F.col("i")).alias("bit"), at("aand").alias("in_a"), at("band").alias("in_b"),
        (at("aand") == at("aor")).alias("const_a"), (at("band") == at("bor")).alias("const_b"),
    ).filter("const_a AND const_b AND in_a <> in_b").select("bit", F.col("in_a").cast("int").alias("in_a"), F.col("in_b").cast("int").alias("in_b"))
