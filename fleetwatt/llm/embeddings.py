"""Embedding near-dedup by epsilon grid order.

Vectors are brought to length 1, so that a cosine of c is a distance of EPS = sqrt(2 - 2 c), and turned to their principal
axes. Their order is the epsilon grid order: by cells of width EPS on the LEADING axes with the greatest variance. Equal
vectors are one node with a count. The sequence is cut in blocks of at most BLOCK nodes, each with its bounding box on all
axes. The join goes down a tree of sequence intervals (FAN to one): pairs of intervals whose boxes are more than EPS
apart are skipped with all that is below, the others are replaced by the pairs of their parts, down to blocks. Pairs of blocks
that are left are worked out in tiles of some blocks by some, so that a block is sent once a tile and not once a pair; there
they go on to leaves of LEAF nodes. Leaf pairs that remain are worked out in single precision with a margin, then in double, and
where that is within CLOSE of the bound, by the plain quotient of the vectors as given. A task gives counts and a spanning forest,
never pairs, so that large groups of near copies cost no rows.

The order skips what the boxes can tell apart: clusters. Vectors spread evenly in many dimensions have overlapping boxes,
and then all block pairs are compared.

A vector that is null, zero, or has null or non-finite components links with nothing, nor does a null id; vectors of different
lengths never link. Rows are separate vectors, also if they share an id. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwatt.llm.components import components
from fleetwatt.session import checkpointed

LEADING = 16
BLOCK = 4096
LEAF = 512

#: Bytes of a block at most (as doubles), whatever the length of vectors.
BLOCK_BYTES = 1 << 21

#: Blocks' worth of vectors at each side of a tile.
GROUP = 2

#: How far rounding may have moved a cosine.
CLOSE = 1e-9

#: Parts of an interval, as bits.
FAN = 8

#: Bits of the number that counts blocks within a partition of the sequence.
POSITION = 20


def matrix(x: pa.Array) -> np.ndarray:
    """A list column of equally long rows as doubles."""
    return x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(x), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, without overflow."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def principal(vectors: DataFrame, size: int) -> np.ndarray:
    """The axes (columns) of the unit vectors, greatest variance first; size ** 2 sums come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((size + 1, size + 1)), 0
        for batch in batches:
            x = unit(matrix(batch.column(0)))
            x = np.hstack([x, np.ones((len(x), 1))])
            total += x.T @ x
            n += len(x)
        if n:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "v"])

    out = np.zeros((size + 1, size + 1))
    for r in vectors.select("v").mapInArrow(run, "i bigint, j bigint, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = r["v"]
    n = max(out[size, size], 1)
    mean = out[:size, size] / n
    _, axes = np.linalg.eigh(out[:size, :size] / n - np.outer(mean, mean))
    return axes[:, ::-1]


def kind_of(vectors: DataFrame) -> str:
    return vectors.schema["v"].dataType.elementType.simpleString()


def grid(vectors: DataFrame, axes: np.ndarray, eps: float) -> DataFrame:
    """(node, m, v, cells): the place of each vector (node, m, v) in the grid order."""
    lead = min(LEADING, axes.shape[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = np.floor(unit(matrix(batch.column(2))) @ axes[:, :lead] / eps).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.FixedSizeListArray.from_arrays(pa.array(cells.ravel()), lead).cast(pa.list_(pa.int32()))], names=["node", "m", "v", "cells"])

    return vectors.mapInArrow(run, f"node bigint, m bigint, v array<{kind_of(vectors)}>, cells array<int>")


BLOCKS = "block bigint, nodes binary, counts binary, body binary, lo array<double>, hi array<double>"


def blocks(ordered: DataFrame, axes: np.ndarray) -> DataFrame:
    """Runs of the sequence packed in a row each: nodes, counts, vectors as given, and the box of their turned unit vectors."""
    most = max(1, min(BLOCK, BLOCK_BYTES // (8 * len(axes))))
    number = np.dtype(np.float32 if kind_of(ordered) == "float" else np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = place = 0
        partition = None

        def out(rows: list[pa.RecordBatch], place: int):
            if place >> POSITION:
                raise ValueError(f"a partition of the sequence has over {1 << POSITION} blocks: use more partitions")
            t = pa.Table.from_batches(rows).combine_chunks()
            x = matrix(t.column("v").combine_chunks())
            y = unit(x) @ axes
            cols = [[int(partition) << POSITION | place], [t.column("node").to_numpy().tobytes()], [t.column("m").to_numpy().tobytes()], [x.astype(number).tobytes()], [(y.min(0) - 1e-9).tolist()], [(y.max(0) + 1e-9).tolist()]]
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["block", "nodes", "counts", "body", "lo", "hi"])

        for batch in batches:
            i = 0
            while i < batch.num_rows:
                partition = batch.column(0)[0].as_py() if partition is None else partition
                part = batch.slice(i, most - count)
                held.append(part)
                count, i = count + part.num_rows, i + part.num_rows
                if count == most:
                    yield out(held, place)
                    held, count, place = [], 0, place + 1
        if held:
            yield out(held, place)

    return ordered.select(F.spark_partition_id().cast("bigint").alias("p"), "node", "m", "v").mapInArrow(run, BLOCKS)


def numbered(packed: DataFrame) -> tuple[DataFrame, int, int]:
    """Blocks numbered in a row, with the last number, and how many bits of it a tile's side takes. To the driver comes a row a partition."""
    sizes = packed.groupBy(F.shiftright("block", POSITION).alias("p")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("nodes") / 8).alias("m")).collect()
    begin, upto = [], 0
    for r in sorted(sizes, key=lambda r: r["p"]):
        begin.append((r["p"], upto))
        upto += r["n"]
    begins = packed.sparkSession.createDataFrame(begin, "p bigint, begin bigint")
    place = F.col("block") - F.shiftleft("p", POSITION) + F.col("begin")
    dense = packed.withColumn("p", F.shiftright("block", POSITION)).join(begins, "p").withColumn("block", place).drop("p", "begin")
    mean = sum(r["m"] for r in sizes) / max(1, upto)
    return dense, max(0, upto - 1), max(0, int(np.ceil(np.log2(max(1.0, GROUP * BLOCK / max(1.0, mean))))))


def apart(a: str, b: str, eps: float) -> Column:
    """Whether two boxes are more than eps apart."""
    gap = F.zip_with(
        F.zip_with(F.col(f"{b}.lo"), F.col(f"{a}.hi"), lambda x, y: x - y),
        F.zip_with(F.col(f"{a}.lo"), F.col(f"{b}.hi"), lambda x, y: x - y),
        lambda x, y: F.greatest(x, y, F.lit(0.0)),
    )
    return F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x) > eps * eps


def near_blocks(boxes: DataFrame, size: int, top: int, eps: float) -> DataFrame:
    """(a, b) with a <= b: pairs of blocks that boxes can't keep apart, by descent from the whole sequence."""
    levels = 0
    while top >> (FAN * levels):
        levels += 1
    pairs = None
    for level in range(levels, -1, -1):
        part = F.shiftright("block", FAN * level) if level else F.col("block")
        box = [F.array(*[f(F.get(c, F.lit(k))) for k in range(size)]).alias(c) for c, f in (("lo", F.min), ("hi", F.max))]
        here = boxes.groupBy(part.alias("part")).agg(*box) if level else boxes.select(F.col("block").alias("part"), "lo", "hi")
        here = checkpointed(here.withColumn("up", F.shiftright("part", FAN)))
        if pairs is None:
            pairs = here.select(F.col("part").alias("a"), F.col("part").alias("b"))
            continue
        a = here.select(F.col("part").alias("a"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"), F.col("up").alias("ua"))
        left = pairs.withColumnsRenamed({"a": "ua", "b": "ub"}).join(a, "ua").select("a", F.struct(F.col("alo").alias("lo"), F.col("ahi").alias("hi")).alias("x"), F.col("ub").alias("up"))
        both = left.alias("l").join(here.alias("h"), F.col("l.up") == F.col("h.up")).select("a", "x", F.col("h.part").alias("b"), F.struct("h.lo", "h.hi").alias("y")).filter("a <= b")
        pairs = checkpointed(both.filter(~apart("x", "y", eps)).select("a", "b"))
    return pairs


def boxes_apart(x: np.ndarray, y: np.ndarray, eps: float) -> bool:
    gap = np.maximum(0, np.maximum(y.min(0) - x.max(0), x.min(0) - y.max(0)))
    return float(gap @ gap) > (eps + 1e-9) ** 2


def leaf_pairs(x: np.ndarray, y: np.ndarray, eps: float, i: int = 0, j: int = 0) -> Iterator[tuple[int, int, int, int]]:
    """(i, end, j, end) of intervals of two sequences, halved until small, that boxes can't keep apart."""
    if boxes_apart(x, y, eps):
        return
    if len(x) <= LEAF and len(y) <= LEAF:
        yield i, i + len(x), j, j + len(y)
        return
    cut = lambda z: [(0, len(z))] if len(z) <= LEAF else [(0, len(z) // 2), (len(z) // 2, len(z))]
    for s, t in cut(x):
        for u, v in cut(y):
            yield from leaf_pairs(x[s:t], y[u:v], eps, i + s, j + u)


LINKS = "node bigint, links bigint, root bigint"


def quotient(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of the rows of x with those of y, from the numbers as given; scaled by powers of two, which round nothing."""
    x, y = (np.ldexp(v, -np.frexp(np.abs(v).max(1))[1][:, None]) for v in (x, y))
    return (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))


class Forest:
    """A spanning forest over numbered nodes; roots are the least of their trees."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> int:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return min(i, j)

    def add(self, near: np.ndarray, row: int, col: int) -> None:
        """Links of nodes row.. with nodes col..: each row's links as one star, and rows that share a column through it."""
        done = np.zeros(near.shape[1], bool)
        for q in np.flatnonzero(near.any(1)):
            cols = np.flatnonzero(near[q])
            top = self.find(row + q)
            for c in cols[~done[cols]]:
                top = self.join(top, col + c)
            for root in np.unique(self.up[col + cols[done[cols]]]):
                top = self.join(top, int(root))
            done[cols] = True


class Block:
    """A block in a task: its nodes, counts, vectors as given, unit vectors, and those on the principal axes."""

    def __init__(self, nodes: bytes, counts: bytes, body: bytes, number: np.dtype, axes: np.ndarray):
        self.nodes, self.counts = np.frombuffer(nodes, np.int64), np.frombuffer(counts, np.int64)
        self.given = np.frombuffer(body, number).reshape(len(self.nodes), -1)
        self.unit = unit(self.given.astype(np.float64))
        self.turned = self.unit @ axes
        self.single = self.unit.astype(np.float32)
        self.links = np.zeros(len(self.nodes), np.int64)
        self.offset = 0


def link(a: Block, b: Block, cosine: float, eps: float, forest: Forest) -> None:
    """Find all links between two blocks, or within one."""
    for i, ie, j, je in leaf_pairs(a.turned, b.turned, eps):
        if a is b and j > i:
            continue
        if (a.single[i:ie] @ b.single[j:je].T).max() < cosine - 1e-4:
            continue
        value = a.unit[i:ie] @ b.unit[j:je].T
        near = value >= cosine
        p, q = np.nonzero(np.abs(value - cosine) <= CLOSE)
        for k in range(0, len(p), 1 << 14):
            s, t = p[k : k + (1 << 14)], q[k : k + (1 << 14)]
            near[s, t] = quotient(a.given[i + s].astype(np.float64), b.given[j + t].astype(np.float64)) >= cosine
        if a is b and i == j:
            np.fill_diagonal(near, False)
        a.links[i:ie] += near @ b.counts[j:je]
        if not (a is b and i == j):
            b.links[j:je] += a.counts[i:ie] @ near
        forest.add(near, a.offset + i, b.offset + j)


def joined(pairs: DataFrame, packed: DataFrame, axes: np.ndarray, cosine: float, eps: float, number: str, bits: int) -> DataFrame:
    """(node, links, root): in each tile, links of a node with nodes of the tile, and a node it is linked with."""
    kind = np.dtype(np.float32 if number == "float" else np.float64)

    def solved(own: tuple[int, int], blocks: list[tuple[int, Block]]) -> pa.RecordBatch:
        upto = 0
        for _, x in blocks:
            x.offset, upto = upto, upto + len(x.nodes)
        forest = Forest(upto)
        for k, (p, a) in enumerate(blocks):
            for q, b in blocks[k:]:
                if own[0] == own[1] or (p >> bits != q >> bits):
                    link(a, b, cosine, eps, forest)
        nodes = np.concatenate([x.nodes for _, x in blocks])
        links = np.concatenate([x.links for _, x in blocks])
        hit = np.flatnonzero(links)
        roots = nodes[[forest.find(int(h)) for h in hit]] if len(hit) else nodes[:0]
        return pa.RecordBatch.from_arrays([pa.array(nodes[hit]), pa.array(links[hit]), pa.array(roots)], names=["node", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tile = [], None
        for batch in batches:
            for r in range(batch.num_rows):
                ta, tb, block, *rest = (c[r].as_py() for c in batch.columns)
                if (ta, tb) != tile:
                    if held:
                        yield solved(tile, held)
                    held, tile = [], (ta, tb)
                held.append((block, Block(*rest, kind, axes)))
        if held:
            yield solved(tile, held)

    tiles = pairs.select(F.shiftright("a", bits).alias("ta"), F.shiftright("b", bits).alias("tb"), "a", "b")
    needed = checkpointed(tiles.select("ta", "tb", F.explode(F.array("a", "b")).alias("block")).distinct())
    n = needed.select("ta", "tb").distinct().count()
    rows = needed.join(packed.select("block", "nodes", "counts", "body"), "block").select("ta", "tb", "block", "nodes", "counts", "body")
    most = 4 * int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(1, min(2 * n, most)), "ta", "tb").sortWithinPartitions("ta", "tb", "block").mapInArrow(run, LINKS)


def near_duplicates(rows: DataFrame, cosine: float, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, n_links, component_id) of every row."""
    eps = float(np.sqrt(2 - 2 * cosine))
    number = rows.select(F.col(vector)).schema[0].dataType.elementType.simpleString()
    v = F.col(vector) if number == "float" else F.col(vector).cast("array<double>")
    fine = F.exists(v, lambda x: x != 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    given = rows.select(F.col(vec_id).cast("bigint").alias("id"), F.when(F.coalesce(fine, F.lit(False)) & F.col(vec_id).isNotNull(), v).alias("v"))
    given = given.withColumn("node", F.when(F.col("v").isNotNull(), F.xxhash64("v")))
    good = given.filter("v is not null")
    nodes = checkpointed(good.groupBy("node").agg(F.count(F.lit(1)).alias("m"), F.first("v").alias("v")))
    found = None
    for size in sorted(r["size"] for r in nodes.select(F.size("v").alias("size")).distinct().collect()):
        mine = nodes.filter(F.size("v") == size)
        axes = principal(mine, size)
        ordered = grid(mine.select("node", "m", "v"), axes, eps).repartitionByRange("cells", "node").sortWithinPartitions("cells", "node")
        packed = checkpointed(blocks(ordered, axes))
        packed, top, bits = numbered(packed)
        pairs = near_blocks(packed.select("block", "lo", "hi"), size, top, eps)
        part = joined(pairs, packed, axes, cosine, eps, kind_of(mine), bits)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return given.select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    found = checkpointed(found)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    root = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    told = nodes.select("node", "m").join(links, "node", "left").join(root, "node", "left").select("node", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "node").alias("root"))
    every = checkpointed(given.filter("node is not null").select("id", "node").join(told, "node").select("id", "n_links", "root"))
    least = every.groupBy("root").agg(F.min("id").alias("component_id"))
    linked = every.join(least, "root").select("id", "n_links", "component_id")
    return linked.unionByName(given.filter("node is null").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id")))
