"""Ordered per-device computation that does not need a whole device in one task.

A device's history is cut into time slices, and every slice is an independent window partition, so a
device that owns a third of the fleet's rows still spreads over as many tasks as it has slices. What a
slice needs from the past reaches it in one of two ways:

* *Reach*: an operator that looks back a limited time (a gap limit, a maximum age) gets the rows of
  that last stretch before the slice as copies. One read and one shuffle of the data.
* *Carry*: an operator that looks back without limit gets one carry row per slice: the last row before
  it, the last known values, or the running total so far. Carry rows come from a map-side combined
  aggregate (one row per device and slice). Two reads, one of them with few columns, and one shuffle of
  the data; the data is never joined.

`has_hot_slice` tells whether a slice is too large for one task; operators then order rows in runs of equal size instead (`prefix`).
`balanced` measures the slices and splits the ones that are too large.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from fleetwatt.session import checkpointed

SLICE = "__slice"
CARRIED = "__carried"


@dataclass(frozen=True)
class Timeline:
    """How rows are keyed, ordered and sliced.

    `order` is the time and then the columns that break ties; of the tie-breakers those count that the rows
    have (see `of`), so samples without a sequence column are ordered by time alone, and rows of one device
    at one instant in no particular order. `width_s` is the slice width. A day holds 86 400 rows of a device
    that reports every second.
    """

    keys: tuple[str, ...] = ("device",)
    time: str = "ts"
    order: tuple[str, ...] = ("ts", "event_id")
    width_s: int = 86_400
    #: slices to cut finer: (keys, slice, parts), see `balanced`
    hot: DataFrame | None = None

    def slice_of(self, later_s: float = 0.0) -> Column:
        """Start of the slice, in microseconds; `later_s` shifts the row's time."""
        us = self.width_s * 1_000_000
        at = F.unix_micros(self.time) + F.lit(int(later_s * 1e6))
        return at - F.pmod(at, F.lit(us))

    def sliced(self, df: DataFrame) -> DataFrame:
        df = df.withColumn(SLICE, self.slice_of())
        if self.hot is None:
            return df
        # the hot list is short by construction (rows / max_rows entries) and its size was checked
        df = df.join(F.broadcast(self.hot), [*self.keys, SLICE], "left")
        step = F.ceil(F.lit(self.width_s * 1_000_000) / F.col("__parts")).cast("long")
        inner = F.unix_micros(self.time) - F.col(SLICE)
        finer = F.col(SLICE) + (inner - inner % step)
        return df.withColumn(SLICE, F.when(F.col("__parts").isNull(), F.col(SLICE)).otherwise(finer)).drop("__parts")

    def of(self, df: DataFrame) -> "Timeline":
        """This timeline with the tie-breakers that `df` has."""
        return replace(self, order=tuple(c for c in self.order if c == self.time or c in df.columns))

    def order_key(self) -> Column:
        return F.struct(*[F.col(c) for c in self.order])

    def with_keys(self, *keys: str) -> "Timeline":
        return replace(self, keys=keys)


DEVICE_TIME = Timeline()


def scan(
    df: DataFrame,
    tl: Timeline = DEVICE_TIME,
    *,
    lag: Mapping[str, Column] | None = None,
    last: Mapping[str, Column] | None = None,
    last_before: Mapping[str, Column] | None = None,
    total: Mapping[str, Column] | None = None,
    high: Mapping[str, Column] | None = None,
    low: Mapping[str, Column] | None = None,
    reach_s: float | None = None,
    reach_if: Column | None = None,
) -> DataFrame:
    """Add running columns along each key's timeline.

    lag          value on the previous row
    last         latest non-null value up to this row
    last_before  latest non-null value strictly before this row
    total        running sum up to this row
    high, low    running maximum / minimum up to this row (structs compare field by field)

    With `reach_s`, `lag` and the `last` kinds are only promised to see rows at most that much older (and
    among them only rows for which `reach_if` holds, when they lie in an earlier slice); older rows
    may or may not be seen, so the caller must apply its own age limit. That needs no carry pass.
    """
    tl = tl.of(df)
    kinds = {"lag": lag, "last": last, "last_before": last_before, "total": total, "high": high, "low": low}
    wanted = {out: (kind, col) for kind, cols in kinds.items() for out, col in (cols or {}).items()}
    arg = {out: f"__in_{out}" for out in wanted}

    keys = list(tl.keys)
    rows = tl.sliced(df)
    rows = rows.select("*", *[col.alias(arg[out]) for out, (_, col) in wanted.items()])

    if reach_s is not None and tl.hot is None:
        if total or high or low:
            raise ValueError("running totals and extremes look back without limit")
        us = tl.width_s * 1_000_000
        copies = F.sequence(F.col(SLICE), tl.slice_of(reach_s), F.lit(us))
        if reach_if is not None:
            copies = F.when(reach_if, copies).otherwise(F.array(SLICE))
        rows = rows.withColumn("__own", F.col(SLICE)).withColumn(SLICE, F.explode(copies))
        rows = rows.withColumn(CARRIED, F.col(SLICE) != F.col("__own")).drop("__own")
        return _apply(rows, tl, wanted, arg)

    lags = [out for out, (kind, _) in wanted.items() if kind == "lag"]
    knowns = [out for out, (kind, _) in wanted.items() if kind in ("last", "last_before")]
    folds = {"total": F.sum, "high": F.max, "low": F.min}

    per_slice = []
    if lags:
        per_slice.append(F.max_by(F.struct(*[F.col(arg[o]) for o in lags]), tl.order_key()).alias("__prev"))
    for o in knowns:
        per_slice.append(F.max_by(arg[o], F.when(F.col(arg[o]).isNotNull(), tl.order_key())).alias(arg[o]))
    for o, (kind, _) in wanted.items():
        if kind in folds:
            per_slice.append(folds[kind](arg[o]).alias(arg[o]))
    heads = rows.groupBy(*keys, SLICE).agg(*per_slice)

    by_slice = Window.partitionBy(*keys).orderBy(SLICE)
    past = by_slice.rowsBetween(Window.unboundedPreceding, -1)
    carry = []
    if lags:
        carry.append(F.lag("__prev").over(by_slice).alias("__prev"))
    for o, (kind, _) in wanted.items():
        if o in knowns:
            carry.append(F.last(arg[o], ignorenulls=True).over(past).alias(arg[o]))
        elif kind in folds:
            carry.append(folds[kind](arg[o]).over(past).alias(arg[o]))
    heads = heads.select(*keys, SLICE, F.row_number().over(by_slice).alias("__nth"), *carry).filter("__nth > 1")
    heads = heads.select(
        *keys,
        SLICE,
        *[F.col("__prev")[arg[o]].alias(arg[o]) for o in lags],
        *[arg[o] for o in wanted if o not in lags],
        F.lit(True).alias(CARRIED),
    )

    rows = rows.withColumn(CARRIED, F.lit(False)).unionByName(heads, allowMissingColumns=True)
    return _apply(rows, tl, wanted, arg)


def slice_window(tl: Timeline) -> WindowSpec:
    """One slice in order, its carry row first."""
    return Window.partitionBy(*tl.keys, SLICE).orderBy(F.col(CARRIED).desc(), *tl.order)


def _apply(rows: DataFrame, tl: Timeline, wanted: Mapping[str, tuple[str, Column]], arg: Mapping[str, str]) -> DataFrame:
    w = slice_window(tl)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    apply = {
        "lag": lambda c: F.lag(c).over(w),
        "last": lambda c: F.last(c, ignorenulls=True).over(upto),
        "last_before": lambda c: F.last(c, ignorenulls=True).over(before),
        "total": lambda c: F.sum(c).over(upto),
        "high": lambda c: F.max(c).over(upto),
        "low": lambda c: F.min(c).over(upto),
    }
    out = rows.select("*", *[apply[kind](arg[o]).alias(o) for o, (kind, _) in wanted.items()])
    return out.filter(~F.col(CARRIED)).drop(SLICE, CARRIED, *arg.values())


#: more slices than this in the hot list are joined by shuffle-free broadcast no longer
HOT_LIST_MAX = 200_000


def slice_sizes(df: DataFrame, tl: Timeline = DEVICE_TIME) -> DataFrame:
    """Rows per key and slice; reads the keys and the time only."""
    return df.select(*tl.keys, tl.slice_of().alias(SLICE)).groupBy(*tl.keys, SLICE).agg(F.count(F.lit(1)).alias("rows"))


#: rows of a slice that one task should order at most
SLICE_ROWS = 5_000_000


def has_hot_slice(df: DataFrame, tl: Timeline = DEVICE_TIME, max_rows: int = SLICE_ROWS) -> bool:
    """Whether any slice is too large for a task; a job that reads keys and time, and counts them before it shuffles."""
    return not slice_sizes(df, tl).filter(F.col("rows") > max_rows).isEmpty()


def balanced(df: DataFrame, tl: Timeline = DEVICE_TIME, max_rows: int = SLICE_ROWS) -> Timeline:
    """A timeline whose slices hold about `max_rows` rows at most, by cutting the larger ones finer.

    The list of large slices has at most (rows / max_rows) entries; it goes through the checkpoint
    folder so that later jobs do not count again.
    """
    parts = F.ceil(F.col("rows") / max_rows).cast("long")
    hot = checkpointed(slice_sizes(df, tl).filter(F.col("rows") > max_rows).select(*tl.keys, SLICE, parts.alias("__parts")))
    n = hot.count()
    if n > HOT_LIST_MAX:
        raise ValueError(f"{n} slices above {max_rows} rows: use a smaller slice width or a larger max_rows")
    return replace(tl, hot=hot) if n else tl


def micros(col: str | Column = "ts") -> Column:
    return F.unix_micros(F.col(col) if isinstance(col, str) else col)
