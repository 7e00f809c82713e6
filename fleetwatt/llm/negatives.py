"""Hard-negative mining by slot-decomposed selection.

Vectors are scaled to whole numbers, and a score is an integer inner product, so nothing is rounded. An anchor's positives
are its first N_POSITIVE other rows of the same label. Their scores are the upper limits of overlapping windows
[LOW % of a positive's score, the positive's score]; the limits in descending order split the scores into disjoint slots,
slot i from positive i's score down to just above that of positive i + 1. Then

1. tasks keep, for each anchor and slot, the K first rows of another label (a combiner: a row that can't come into the K first
   of its slot, or lies below the window of every positive, is dropped as soon as it is scored);
2. the K first of each slot over all tasks follow from those;
3. positive i's window is answered by the K first rows of slots i, i + 1, ... in a row, of which those below its lower
   limit fall away. Slots are disjoint and in order, so each row is looked at once, however many windows overlap.

Rows and anchors meet in tiles: a tile holds up to ANCHORS anchors, in memory, and streams about TILE rows past them in matrix
products. Anchors go to all tiles of their lot, rows to one tile of each lot; positives are searched in tiles
of one label, so a label that holds a third of all rows only has more tiles. Nothing depends on the number of anchors or labels.

Rows with a null id, label or vector, with a null or non-finite component, or without components take no part. Only vectors of
equal length have a score. Rows that share an id, also identical ones, are separate rows: an anchor that stands twice
is answered twice, and each may be the other's positive. Ties go to the smaller id. Scores beyond 64 bits count as the
largest 64-bit number of their sign. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetwatt.llm.best import NONE, Best
from fleetwatt.session import checkpointed

#: Positives of an anchor, and negatives returned for each of them.
N_POSITIVE = 5
K = 5

#: Factor from components to whole numbers.
SCALE = 256

#: The window of a positive in percent of its score.
LOW = 80

#: Anchors and rows of a tile, and the most scores worked out at once.
ANCHORS = 1 << 14
TILE = 1 << 14
SCORES = 1 << 21

_EXACT = float(1 << 53)


def whole(x: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * component) of a list column of equally long rows, as doubles."""
    v = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(x), -1)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(v * scale), -np.finfo(float).max, np.finfo(float).max)


def scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of x with those of y."""
    if not len(x) or not len(y):
        return np.zeros((len(x), len(y)))
    if np.abs(x).max() * np.abs(y).max() * x.shape[1] < _EXACT:
        return x @ y.T
    big = np.frompyfunc(int, 1, 1)
    out = big(x).astype(object) @ big(y).astype(object).T
    return np.clip(out, NONE + 1, np.iinfo(np.int64).max).astype(np.int64)


class Positives:
    """First rows of the anchors' own label; a tile holds one label."""

    slots = 1

    def __init__(self, anchors: dict, k: int, low: int):
        self.uid = anchors["uid"]
        self.best = Best(len(self.uid), k)

    def rows(self, s: np.ndarray, uid: np.ndarray, ident: np.ndarray, label: np.ndarray) -> None:
        r, a = np.nonzero(s >= self.best.least)
        other = uid[r] != self.uid[a]
        r, a = r[other], a[other]
        self.best.add(a, s[r, a].astype(np.int64), ident[r], uid[r])


class Negatives:
    """First rows of other labels in each slot between the limits of an anchor."""

    def __init__(self, anchors: dict, k: int, low: int):
        self.label, self.limits = anchors["label"], anchors["limits"]
        self.slots = self.limits.shape[1]
        self.best = Best(self.limits.size, k)
        exact = np.frompyfunc(lambda u: -(-low * int(u) // 100) if u >= 0 else np.iinfo(np.int64).max, 1, 1)
        self.floor = exact(self.limits).astype(np.int64)
        self.top, self.bottom = self.limits.max(1), self.floor.min(1)

    def rows(self, s: np.ndarray, uid: np.ndarray, ident: np.ndarray, label: np.ndarray) -> None:
        r, a = np.nonzero((s <= self.top) & (s >= self.bottom))
        other = label[r] != self.label[a]
        r, a = r[other], a[other]
        score = s[r, a].astype(np.int64)
        slot = (self.limits[a] >= score[:, None]).sum(1) - 1
        key = a * self.slots + slot
        fits = (score >= self.floor[a, slot]) & (score >= self.best.least[key])
        self.best.add(key[fits], score[fits], ident[r[fits]], uid[r[fits]])


FOUND = "anchor bigint, slot int, score bigint, id bigint, uid bigint"


def tiles(rows: DataFrame, anchors: DataFrame, keys: list[str]) -> DataFrame:
    """Anchors (kind 0) and then rows (kind 1) of each tile; only rows and anchors that agree on `keys` meet."""
    parts = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / TILE).alias("_parts"))
    lots = anchors.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / ANCHORS).alias("_lots"))
    shape = checkpointed(parts.join(lots, keys))
    n = shape.agg(F.sum(F.col("_parts") * F.col("_lots"))).first()[0] or 1
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    one = lambda n, seed: F.pmod(F.xxhash64("uid", F.lit(seed)), F.col(n))
    cols = ["size", "uid", "id", "label", "v"]
    a = anchors.join(shape, keys).withColumn("lot", one("_lots", 1)).withColumn("part", every("_parts"))
    r = rows.join(shape, keys).withColumn("part", one("_parts", 2)).withColumn("lot", every("_lots"))
    if "limits" not in anchors.columns:
        a = a.withColumn("limits", F.lit(None).cast("array<bigint>"))
    r = r.withColumn("limits", F.lit(None).cast("array<bigint>"))
    side = lambda df, kind: df.select(*cols, "lot", "part", F.lit(kind).alias("kind"), "limits")
    both = side(a, 0).unionByName(side(r, 1))
    place = [*keys, "lot", "part"]
    return both.repartition(int(min(3 * n, 1 << 14)), *place).sortWithinPartitions(*place, "kind")


def selected(dealt: DataFrame, by_label: bool, k: int, low: int, scale: int) -> DataFrame:
    """The k first rows of each anchor and slot in each tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held, block, state = None, [], None, None

        def done():
            if state is None:
                return None
            key, score, ident, uid = state.best.settle()
            return pa.RecordBatch.from_arrays([pa.array(block["uid"][key // state.slots]), pa.array((key % state.slots).astype(np.int32)), pa.array(score), pa.array(ident), pa.array(uid)], names=["anchor", "slot", "score", "id", "uid"])

        for batch in batches:
            size, lot, part, label, kind = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 5, 6, 3, 7))
            place = np.stack([size, lot, part] + ([label] if by_label else []), 1)
            cut = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]).any(1) | (kind[1:] != kind[:-1])])) if len(kind) else []
            for i, j in zip(cut, [*cut[1:], len(kind)], strict=True):
                here = tuple(place[i])
                if here != tile:
                    if (out := done()) is not None:
                        yield out
                    tile, held, state = here, [], None
                piece = batch.slice(i, j - i)
                if not kind[i]:
                    held.append(piece)
                    continue
                if not held:
                    continue
                if state is None:
                    t = pa.Table.from_batches(held).combine_chunks()
                    got = [t.column(c).combine_chunks() for c in range(9)]
                    block = {"uid": got[1].to_numpy(), "label": got[3].to_numpy(), "x": whole(got[4], scale)}
                    if not by_label:
                        block["limits"] = limits_of(got[8])
                    state = (Positives if by_label else Negatives)(block, k, low)
                x, uid, ident = whole(piece.column(4), scale), piece.column(1).to_numpy(), piece.column(2).to_numpy()
                step = max(1, SCORES // len(block["x"]))
                for b in range(0, len(x), step):
                    e = b + step
                    state.rows(scores(x[b:e], block["x"]), uid[b:e], ident[b:e], label[i + b : min(j, i + e)])
        if (out := done()) is not None:
            yield out

    return dealt.mapInArrow(run, FOUND)


def limits_of(x: pa.Array) -> np.ndarray:
    """Descending upper limits, a row an anchor; short rows end in limits that no score is under."""
    n = np.diff(x.offsets.to_numpy())
    out = np.full((len(x), max(1, int(n.max(initial=1)))), NONE)
    out[np.arange(out.shape[1]) < n[:, None]] = x.flatten().to_numpy()
    return out


def best(found: DataFrame, k: int) -> DataFrame:
    """The k first rows of each anchor and slot over all tiles, and their rank."""
    w = Window.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), "id", "uid")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def mined(
    rows: DataFrame,
    is_anchor: Column,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str | Column = "label",
    n_positive: int = N_POSITIVE,
    k: int = K,
    low: int = LOW,
    scale: int = SCALE,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every anchor, a row for which `is_anchor` holds."""
    v = F.col(vector)
    fine = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    label = F.col(label) if isinstance(label, str) else label
    given = rows.select(F.col(vec_id).cast("bigint").alias("id"), label.cast("bigint").alias("label"), F.when(fine, v).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    # the numbers given to rows are fixed by writing them
    given = given.filter("id is not null and label is not null and v is not null").select(F.monotonically_increasing_id().alias("uid"), F.size("v").alias("size"), "*")
    given = checkpointed(given)
    all_rows, anchors = given.drop("asks"), given.filter("asks").drop("asks")

    near = best(selected(tiles(all_rows, anchors, ["size", "label"]), True, n_positive, low, scale), n_positive)
    positives = near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "id"))).alias("positives"))
    asked = checkpointed(anchors.join(positives, anchors["uid"] == positives["anchor"]).drop("anchor"))

    limits = asked.select("uid", "size", "id", "label", "v", F.transform("positives", lambda p: p["score"]).alias("limits"))
    chosen = best(selected(tiles(all_rows, limits, ["size"]), False, k, low, scale), k)
    order = F.struct(-F.col("score").cast("decimal(20,0)"), F.col("id"), F.col("uid"), F.col("slot"), F.col("score"))
    slots = chosen.groupBy("anchor").agg(F.transform(F.sort_array(F.collect_list(order)), lambda x: F.struct(x["slot"].alias("slot"), x["score"].alias("score"), x["id"].alias("id"))).alias("slots"))
    told = asked.select("uid", F.col("id").alias("anchor_id"), "positives").join(slots, F.col("uid") == F.col("anchor"))
    told = told.select("anchor_id", "slots", F.posexplode("positives").alias("i", "p"))
    suffix = F.slice(F.filter("slots", lambda s: s["slot"] >= F.col("i")), 1, k)
    wide = lambda c, by: c.cast("decimal(20,0)") * F.lit(by)
    window = F.filter(suffix, lambda s: wide(F.col("p.score"), low) <= wide(s["score"], 100))
    return told.select("anchor_id", F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score"), F.posexplode(window).alias("n", "s")).select(
        "anchor_id", "positive_id", (F.col("n") + 1).alias("rank"), F.col("s.id").alias("negative_id"), "positive_score", F.col("s.score").alias("negative_score")
    )
