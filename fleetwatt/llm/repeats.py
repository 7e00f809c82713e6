"""Suffix-array dedup of long repeated byte strings, by prefix-free parsing.

Parsing. The rolling hash of every stretch of TRIGGER bytes is worked out; a trigger is the leftmost stretch of
least hash in some window of LENGTH bytes. Triggers depend on the window's bytes alone, so equal windows have their
trigger at the same place, and no phrase between triggers is longer than a window: the parse is bounded even where text
is highly repetitive. A trigger at a serves the windows that begin in [lo, hi]; their bytes, [lo, hi + LENGTH), are its context: the
phrase that ends with the trigger and what follows it.

Dictionary. Contexts are keyed by their trigger's hash, and equal contexts (a second hash) are counted. A key that
stands once has no repeated window. A context that stands twice has none but repeated ones. Only where a key has
several different contexts are bytes looked at, one row a different context, and only these go on.

Order. In a task, the contexts of its keys give two suffix orders: that of the dictionary, the phrases up to the end of the
trigger read backwards, and that of the parse, the texts from the trigger on. Neighbours in each order and the lengths they
share give classes: windows are equal if their phrase parts fall in one class of the dictionary and the rests in one
class of the parse, which is the combined corpus order cut where neighbours share less than LENGTH. A key with more than
CROWD contexts (a very common line in ever new surroundings) isn't put into a task: each of its windows is
hashed, and the hashes are counted.

Results. A repeated window's bytes are removed; overlaps count, and windows are judged on the input. Matches never
cross texts. A null text is empty. Rows that share an id are separate documents; identical rows repeat each other.
Texts shorter than LENGTH keep all bytes. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwatt.llm.prefilter import flagged, maybe_in
from fleetwatt.llm.text import BASE, BYTE, mix, pieces, span_hash, sums
from fleetwatt.session import checkpointed

#: Bytes of a string that counts as repeated, and of a trigger.
LENGTH = 200
TRIGGER = 64

#: Contexts of one key that a task takes.
CROWD = 2000

#: Contexts a task is meant to hold.
TASK = 20_000

_U = np.uint64


def rolling(data: np.ndarray, size: int = TRIGGER) -> np.ndarray:
    """The polynomial hash of every stretch of `size` bytes (a power of two), by doubling."""
    h, power, k = BYTE[data], BASE, 1
    while k < size:
        h = h[:-k] * _U(power) + h[k:] if len(h) > k else h[:0]
        power, k = power * power % (1 << 64), 2 * k
    return mix(h)


def sliding_least(h: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values."""
    n = len(h)
    whole = -(-n // w) * w
    x = np.full(whole, 0xFFFFFFFFFFFFFFFF, np.uint64)
    x[:n] = h
    blocks = x.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def triggers(h: np.ndarray, length: int = LENGTH, size: int = TRIGGER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(at, lo, hi) of the triggers of a text of `length` bytes or more, given its rolling hashes: windows that begin in [lo, hi] have their trigger at `at`.

    Upper halves of hashes decide, and the place decides among equal ones.
    """
    x = (h & _U(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    place = (sliding_least(x, length - size + 1) & _U(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return place[first], first, np.append(first[1:], len(place)) - 1


PARSE = "node bigint, at bigint, lo bigint, hi bigint, key bigint, context bigint"


def parsed(docs: DataFrame) -> DataFrame:
    """The triggers of all texts of (node, text): places in bytes, the trigger's hash and the context's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            for i, j, data, at in pieces(batch.column(1)):
                rows, hashes, run = [], rolling(data), sums(data)
                for k in np.flatnonzero(np.diff(at) >= LENGTH):
                    h = hashes[at[k] : at[k + 1] - TRIGGER + 1]
                    t, lo, hi = triggers(h)
                    rows.append((np.full(len(t), nodes[i + k]), t, lo, hi, h[t], at[k] + lo, at[k] + hi + LENGTH))
                if rows:
                    node, t, lo, hi, key, b, e = (np.concatenate(x) for x in zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node, t, lo, hi, key.view(np.int64), span_hash(run, b, e).view(np.int64))], names=["node", "at", "lo", "hi", "key", "context"])

    return docs.select("node", "text").mapInArrow(run, PARSE)


def classes(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(rank, shared): each string's place in the sorted order, and how many bytes each place shares with the one before."""
    order = sorted(range(len(rows)), key=rows.__getitem__)
    rank = np.empty(len(rows), np.int64)
    rank[order] = np.arange(len(rows))
    width = max(map(len, rows), default=0)
    table = np.frombuffer(b"".join(rows[i].ljust(width, b"\0") for i in order), np.uint8).reshape(len(rows), width)
    size = np.array([len(rows[i]) for i in order])
    shared = np.zeros(len(rows), np.int64)
    if len(rows) > 1 and width:
        differ = table[1:] != table[:-1]
        shared[1:] = np.where(differ.any(1), differ.argmax(1), width)
        shared[1:] = np.minimum(shared[1:], np.minimum(size[1:], size[:-1]))
    return rank, shared


def repeated_windows(bodies: list[bytes], at: np.ndarray) -> np.ndarray:
    """For each context (bytes, the trigger's place in it) which of its windows, by their distance to the trigger, stand in another one too."""
    dictionary, d_shared = classes([b[: a + TRIGGER][::-1] for b, a in zip(bodies, at, strict=True)])
    parse, p_shared = classes([b[a:] for b, a in zip(bodies, at, strict=True)])
    size = np.array([len(b) for b in bodies])
    most = LENGTH - TRIGGER + 1
    out = np.zeros((len(bodies), most), bool)
    # a window that begins `back` bytes before the trigger: its phrase part has back + TRIGGER bytes, the rest LENGTH - back
    for back in range(most):
        has = np.flatnonzero((at >= back) & (at - back + LENGTH <= size))
        if len(has) < 2:
            continue
        d = np.cumsum(d_shared < back + TRIGGER)[dictionary[has]]
        p = np.cumsum(p_shared < LENGTH - back)[parse[has]]
        pair = d * (len(bodies) + 1) + p
        _, which, n = np.unique(pair, return_inverse=True, return_counts=True)
        out[has, back] = n[which] > 1
    return out


def intervals(flags: np.ndarray, at: int) -> list[tuple[int, int]]:
    """Runs [first, last] of window begins among the flagged windows of one context."""
    begins = np.sort(at - np.flatnonzero(flags))
    if not len(begins):
        return []
    cut = np.flatnonzero(np.diff(begins) > 1) + 1
    return [(int(x[0]), int(x[-1])) for x in np.split(begins, cut)]


def repeats(rows: DataFrame) -> DataFrame:
    """(node, first, last): windows that begin in [first, last] of a text stand elsewhere too; rows are (node, text)."""
    # keys that stand twice or more, then just their triggers
    keys = checkpointed(parsed(rows).groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("key"))
    held = maybe_in(parsed(rows), "key", keys).join(keys, "key")
    places = checkpointed(held)
    several = places.groupBy("key", "context").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("node", "at", "lo", "hi")).alias("one"))
    several = checkpointed(several)
    whole = places.join(several.filter("m > 1").select("key", "context"), ["key", "context"], "left_semi").select("node", F.col("lo").alias("first"), F.col("hi").alias("last"))

    # the bytes of one context of each kind, where a key has several
    mixed = several.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.max((F.col("m") == 1).cast("int")).alias("open")).filter("kinds > 1 and open = 1")
    wanted = several.join(mixed, "key").select("key", "kinds", (F.col("m") > 1).alias("often"), "one.*")
    wanted = checkpointed(wanted)
    texts = maybe_in(rows, "node", wanted.select("node").distinct())
    packed = wanted.groupBy("node").agg(F.collect_list(F.struct("key", "kinds", "often", "at", "lo", "hi")).alias("w"))
    bytes_of = F.encode("text", "utf-8")
    cut = texts.dropDuplicates(["node"]).join(packed, "node").select("node", bytes_of.alias("b"), F.explode("w").alias("w"))
    contexts = checkpointed(cut.select("node", "w.*", F.substring(F.col("b"), (F.col("w.lo") + 1).cast("int"), (F.col("w.hi") - F.col("w.lo") + LENGTH).cast("int")).alias("body")))

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def solved():
            node, key, often, at, lo, body = (list(x) for x in zip(*held, strict=True))
            at, lo = np.array(at), np.array(lo)
            flags = repeated_windows(body, at - lo)
            found = [(n, *run) for n, o, a, f in zip(node, often, at, flags, strict=True) if not o for run in intervals(f, int(a))]
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], names=["node", "first", "last"])

        last = None
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if len(held) >= TASK and row[1] != last:
                    yield solved()
                    held.clear()
                held.append(row)
                last = row[1]
        if held:
            yield solved()

    calm = contexts.filter(F.col("kinds") <= CROWD).select("node", "key", "often", "at", "lo", "body")
    calm = calm.repartition("key").sortWithinPartitions("key").mapInArrow(ordered, "node bigint, first bigint, last bigint")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, lo = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, j, data, at in pieces(batch.column(2), 1 << 19):
                run, count = sums(data), np.diff(at) - LENGTH + 1
                which = np.repeat(np.arange(j - i), count)
                begin = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
                b = at[:-1][which] + begin
                yield pa.RecordBatch.from_arrays([pa.array(span_hash(run, b, b + LENGTH).view(np.int64)), pa.array(node[i + which]), pa.array(lo[i + which] + begin)], names=["h", "node", "first"])

    crowd = contexts.filter(F.col("kinds") > CROWD).select("node", "lo", "body")
    windows = crowd.mapInArrow(hashed, "h bigint, node bigint, first bigint")
    again = windows.groupBy("h").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("h")
    crowded = windows.join(again, "h").select("node", "first", F.col("first").alias("last"))
    return whole.unionByName(calm).unionByName(crowded)


def spans_of(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal removed stretches [b, e) of a text from its runs of repeated windows."""
    order = np.argsort(first, kind="stable")
    b, e = first[order], np.maximum.accumulate(last[order] + LENGTH)
    new = np.concatenate([[True], b[1:] > e[:-1]])
    start = np.flatnonzero(new)
    return b[start], e[np.append(start[1:], len(b)) - 1]


def removed_column(bodies: str, first: str, last: str):
    """struct<n_bytes, n_removed, n_spans, kept_sha256> of a binary column and its arrays of window runs (null: none)."""

    def run(body: pa.Array, first: pa.Array, last: pa.Array) -> pa.Array:
        out = []
        for b, f, t in zip(body, first, last, strict=True):
            data = b.as_py() or b""
            if f.as_py():
                s, e = spans_of(np.array(f.as_py()), np.array(t.as_py()))
                kept = b"".join(data[x:y] for x, y in zip([0, *e], [*s, len(data)], strict=True))
                out.append((len(data), len(data) - len(kept), len(s), sha256(kept).hexdigest()))
            else:
                out.append((len(data), 0, 0, sha256(data).hexdigest()))
        return pa.StructArray.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["n_bytes", "n_removed", "n_spans", "kept_sha256"])

    run.__annotations__ = {"body": pa.Array, "first": pa.Array, "last": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "struct<n_bytes:bigint,n_removed:bigint,n_spans:bigint,kept_sha256:string>")(bodies, first, last)


def removed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every row. Texts without a repeat aren't shuffled."""
    rows = docs.select(F.xxhash64(F.col(doc_id), F.col(text)).alias("node"), F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = repeats(rows.select("node", "text"))
    runs = checkpointed(found.distinct().groupBy("node").agg(F.collect_list(F.struct("first", "last")).alias("runs")))
    split = flagged(rows, "node", runs.select("node"))
    none = F.lit(None).cast("array<bigint>")
    body = F.encode("text", "utf-8")
    with_runs = split.filter("_maybe").join(runs, "node", "left").select("id", removed_column(body, F.col("runs.first"), F.col("runs.last")).alias("x"))
    without = split.filter("not _maybe").select("id", removed_column(body, none, none).alias("x"))
    return with_runs.unionByName(without).select("id", "x.*")
