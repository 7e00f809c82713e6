"""LM scoring by logistic mixing of context bit predictors.

A text, in lower case (A-Z), is coded as bytes and one end byte 0, each byte as 8 bits. Predictor o of ORDERS looks up the
last o bytes and the bits of the byte so far in the bit counts of all learning texts, and gives the logit of its estimate, 0
where nothing was seen. Counts are exact: no context shares a place with another, and they grow with the corpus. They follow from
how often each string of ORDERS bytes stands in the learning texts, kept as a table of buckets by the last NEAR bytes of
context, so a bucket holds all counts of its longer contexts; those of shorter ones go to all tasks.

A gate (the longest context seen, and the bit's place) picks a set of weights; the weighted sum of logits is the mixed
logit. It is refined by an adaptive map from (bits so far, step of the logit) to the observed rate, averaged with
the mixed probability. Weights and map are learned over all learning texts: each half of them (by a hash of the text, so
copies stay together) is predicted from the counts of the other half. A round adds up gradients, second derivatives
and map counts over all buckets and takes a Newton step for each gate. Sums are whole numbers, so they don't depend on their order.

Scoring is a function of the last ORDERS bytes. Texts are dealt into groups by a hash; the different strings of a group go to their
buckets and come back with their values. The base score needs the
count of each word in the learning texts: words frequent enough that at most FREQUENT pass are sent to all tasks, the others meet
their counts in a join, so no task or broadcast holds the vocabulary.

Null text: empty, so just the end. A null id is neither learned from nor held out. Identical rows get equal results; rows that
share an id are separate documents. Without learning texts every bit has probability 1/2 and every count is 0. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwatt.llm.text import LOWER, mix, pieces, span_hash, sums, words
from fleetwatt.session import checkpointed

#: Contexts are 0 to ORDERS - 1 bytes long.
ORDERS = 6
#: Bytes of context by which buckets are made; the counts of shorter contexts are at most 2 ** (8 * NEAR) and go to all tasks.
NEAR = 3

#: Pseudo-count of a bit, and bounds of a logit.
PRIOR = 0.1
MOST = 12.0

#: Bytes of learning text for each bucket, and of all texts for each group; strings worked on at once.
BUCKET_BYTES = 1 << 24
GROUP_BYTES = 1 << 26
AT_ONCE = 1 << 15

#: Weights begin at START and are drawn there as by RIDGE; rounds end when the loss falls by less than a part of ENOUGH.
START = 0.3
RIDGE = 1.0
ROUNDS = 12
ENOUGH = 1e-3

#: Words sent to all tasks at most, and strings whose score a task remembers.
FREQUENT = 200_000
REMEMBERED = 3_000_000

#: Add-constant smoothing of the base score.
ADDED = 0.1

STEPS = 33
GATES = 8 * (ORDERS + 1)
#: Sums are kept in these parts of 1.
PARTS = float(1 << 16)
_U = np.uint64
#: A key is a string, and above it the half that its text is in.
HALF = _U(8 * ORDERS)
STRING = (_U(1) << HALF) - _U(1)
#: The end token's hash.
END = int(mix(np.array([0xE0F], np.uint64)).view(np.int64)[0])


def strings(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(string, ends): for every byte and the end of each text the byte (lowest) and the ORDERS - 1 before it; zeros before the text."""
    n, size = len(at) - 1, np.diff(at)
    lead = ORDERS - 1
    body = np.zeros(len(data) + n * (lead + 1), np.uint64)
    where = np.arange(len(data)) + np.repeat(np.arange(n) * (lead + 1) + lead, size)
    body[where] = LOWER[data]
    out = body.copy()
    for k in range(1, ORDERS):
        out[k:] |= body[:-k] << _U(8 * k)
    kept = np.ones(len(body), bool)
    starts = at[:-1] + np.arange(n) * (lead + 1)
    for k in range(lead):
        kept[starts + k] = False
    return out[kept], np.cumsum(size + 1)


def bits(string: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place, node, bit) of the 8 bits of the lowest byte."""
    byte = string & _U(255)
    for k in range(8):
        yield k, (_U(1) << _U(k)) | (byte >> _U(8 - k)), ((byte >> _U(7 - k)) & _U(1)).astype(np.int64)


def ordered(order: int, string: np.ndarray) -> np.ndarray:
    """The context of `order` bytes, and below it the byte: the bits of the byte so far stand for a range of these."""
    return (((string >> _U(8)) & _U((1 << 8 * order) - 1)) << _U(8)) | (string & _U(255))


def bucketed(string: np.ndarray, n: int) -> np.ndarray:
    return (mix((string >> _U(8)) & _U((1 << 8 * NEAR) - 1)) % _U(n)).astype(np.int64)


def by_bucket(string: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places) of strings."""
    b = bucketed(string, n)
    order = np.argsort(b, kind="stable")
    ends = np.flatnonzero(np.diff(b[order], append=-1)) + 1
    for x, y in zip([0, *ends[:-1]], ends, strict=False):
        yield int(b[order[x]]), order[x:y]


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, at = np.unique(keys, return_inverse=True)
    return u, np.bincount(at, weights=n, minlength=len(u)).astype(np.int64)


def string_counts(learning: DataFrame, buckets: int) -> DataFrame:
    """(bucket, key, n): the keys of each bucket, sorted, and how often each stands in the texts (columns text, half)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out():
            u, n = summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            for b, at in by_bucket(u & STRING, buckets):
                yield pa.RecordBatch.from_pylist([{"bucket": b, "key": u[at].tobytes(), "n": n[at].tobytes()}])

        for batch in batches:
            half = batch.column(1).to_numpy().astype(np.uint64)
            for i, j, data, at in pieces(batch.column(0)):
                s, ends = strings(data, at)
                held.append(np.unique(s | (np.repeat(half[i:j], np.diff(ends, prepend=0)) << HALF), return_counts=True))
                if len(held) >= 16:
                    held = [summed(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                    if len(held[0][0]) > REMEMBERED:
                        yield from out()
                        held = []
        if held:
            yield from out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def out():
            u, n = summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            return pa.RecordBatch.from_pylist([{"bucket": now, "key": u.tobytes(), "n": n.tobytes()}])

        for batch in batches:
            for b, key, n in zip(*batch.columns, strict=True):
                if b.as_py() != now and held:
                    yield out()
                    held = []
                now = b.as_py()
                held.append(unpacked(key, n))
                if len(held) >= 16:
                    held = [summed(*(np.concatenate(x) for x in zip(*held, strict=True)))]
        if held:
            yield out()

    kind = "bucket bigint, key binary, n binary"
    return learning.select("text", "half").mapInArrow(run, kind).repartition(tasks(buckets), "bucket").sortWithinPartitions("bucket").mapInArrow(merge, kind)


def tasks(buckets: int) -> int:
    return max(24, buckets // 4)


def unpacked(key: pa.Scalar, n: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(key.as_buffer(), np.uint64), np.frombuffer(n.as_buffer(), np.int64)


def short_counts(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(key, n) with the last NEAR bytes of strings only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, key, n in zip(*batch.columns, strict=True):
                key, n = unpacked(key, n)
                u, n = summed(key & ((_U(1) << HALF) | _U((1 << 8 * NEAR) - 1)), n)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n)], names=["key", "n"])

    got = counts.mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    return got["key"].to_numpy().view(np.uint64), got["n"].to_numpy()


def table(order: int, key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context and byte, sorted; running counts of each half, from 0)."""
    u, at = np.unique(ordered(order, key & STRING), return_inverse=True)
    run = np.zeros((2, len(u) + 1))
    for h in (0, 1):
        run[h, 1:] = np.cumsum(np.bincount(at, weights=n * (key >> HALF == _U(h)), minlength=len(u)))
    return u, run


def inputs(tables: list[tuple[np.ndarray, np.ndarray]], string: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(logits, gate) by place of the bit, row of running counts, string, and for logits the order."""
    rows = len(tables[0][1])
    x = np.zeros((8, rows, len(string), ORDERS), np.float32)
    gate = np.zeros((8, rows, len(string)), np.int64)
    for o, (known, run) in enumerate(tables):
        q, back = np.unique(ordered(o, string), return_inverse=True)
        lo, hi = np.searchsorted(known, q & ~_U(255)), np.searchsorted(known, (q | _U(255)) + _U(1))
        for k in range(8):
            mid = np.searchsorted(known, (q >> _U(8 - k) << _U(8 - k)) | _U(1 << (7 - k)))
            n, ones = run[:, hi] - run[:, lo], run[:, hi] - run[:, mid]
            logit = np.where(n > 0, np.clip(np.log((ones + PRIOR) / (n - ones + PRIOR)), -MOST, MOST), 0)
            x[k, :, :, o] = logit[:, back]
            gate[k][(n > 0)[:, back]] = o + 1
            one = (q >> _U(7 - k)) & _U(1) == 1
            lo, hi = np.where(one, mid, lo), np.where(one, hi, mid)
    gate += np.arange(8)[:, None, None] * (ORDERS + 1)
    return x, gate


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Mixer:
    """Gated weights and the adaptive map over them."""

    def __init__(self, weights: np.ndarray | None = None):
        self.weights = np.full((GATES, ORDERS), START) if weights is None else weights
        centre = (np.arange(STEPS) - STEPS // 2) / 2
        self.seen = np.full((256, STEPS), 4.0)
        self.hits = self.seen * squash(centre)[None, :]

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        logit = np.clip((x * self.weights[gate]).sum(-1), -15, 15)
        return logit, np.clip(np.rint(logit * 2).astype(np.int64) + STEPS // 2, 0, STEPS - 1)

    def sums(self, tables: list[tuple[np.ndarray, np.ndarray]], string: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Gradient, second derivatives, map counts, map hits and loss over n occurrences of strings (a row for each row of running counts), one after the other."""
        slope, bend = np.zeros((GATES, ORDERS)), np.zeros((GATES, ORDERS, ORDERS))
        seen, hits, loss = np.zeros(256 * STEPS), np.zeros(256 * STEPS), 0.0
        for c in range(0, len(string), AT_ONCE):
            s = string[c : c + AT_ONCE]
            some, at = np.nonzero(n[:, c : c + AT_ONCE])
            m = n[:, c : c + AT_ONCE][some, at].astype(float)
            x, gate = inputs(tables, s)
            for k, node, bit in bits(s):
                xs, gates, bit, node = x[k][some, at].astype(float), gate[k][some, at], bit[at], node[at].astype(np.int64)
                logit, step = self.mixed(xs, gates)
                p = squash(logit)
                loss -= (m * np.log(np.where(bit == 1, p, 1 - p))).sum()
                for g in np.unique(gates):
                    mine = gates == g
                    f = xs[mine]
                    slope[g] += f.T @ (m * (bit - p))[mine]
                    bend[g] += f.T @ (f * (m * p * (1 - p))[mine, None])
                seen += np.bincount(node * STEPS + step, weights=m, minlength=256 * STEPS)
                hits += np.bincount(node * STEPS + step, weights=m * bit, minlength=256 * STEPS)
        return np.concatenate([slope.ravel(), bend.ravel(), seen, hits, [loss]])

    def log10(self, tables: list[tuple[np.ndarray, np.ndarray]], string: np.ndarray) -> np.ndarray:
        """log10 of the probability of each string's last byte."""
        out = np.zeros(len(string))
        for c in range(0, len(string), AT_ONCE):
            s = string[c : c + AT_ONCE]
            x, gate = inputs(tables, s)
            for k, node, bit in bits(s):
                logit, step = self.mixed(x[k, 0], gate[k, 0])
                at = node.astype(np.int64), step
                p = np.clip((squash(logit) + self.hits[at] / self.seen[at]) / 2, 1e-5, 1 - 1e-5)
                out[c : c + AT_ONCE] += np.log10(np.where(bit == 1, p, 1 - p))
        return out


class Model:
    """The counts of the learning texts, and the mixer learned over them."""

    def __init__(self, counts: DataFrame, buckets: int):
        self.spark, self.counts, self.buckets, self.mixer = counts.sparkSession, counts, buckets, Mixer()
        key, n = short_counts(counts)
        self.short = self.spark.sparkContext.broadcast([table(o, key, n) for o in range(NEAR)])

    def round(self, mixer: Mixer) -> np.ndarray:
        """What Mixer.sums gives over all buckets, each half predicted from the other."""
        short = self.short

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for _, key, n in zip(*batch.columns, strict=True):
                    key, n = unpacked(key, n)
                    tables = [(u, c[::-1]) for u, c in [*short.value, *(table(o, key, n) for o in range(NEAR, ORDERS))]]
                    string, at = np.unique(key & STRING, return_inverse=True)
                    times = np.zeros((2, len(string)), np.int64)
                    times[(key >> HALF).astype(np.int64), at] = n
                    got = mixer.sums(tables, string, times)
                    total = got if total is None else total + got
            if total is not None:
                whole = np.rint(total * PARTS).astype(np.int64)
                at = np.flatnonzero(whole)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(whole[at])], names=["at", "v"])

        got = self.counts.mapInArrow(run, "at bigint, v bigint").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
        out = np.zeros(GATES * ORDERS * (1 + ORDERS) + 2 * 256 * STEPS + 1)
        out[got["at"].to_numpy()] = got["v"].to_numpy() / PARTS
        return out

    def learn(self) -> None:
        """Newton steps for the weights of each gate, halved where they overshoot, and the map that goes with them."""
        weights, step, least = self.mixer.weights, 0.0, np.inf
        for _ in range(ROUNDS):
            slope, bend, seen, hits, loss = np.split(self.round(Mixer(weights + step)), np.cumsum([GATES * ORDERS, GATES * ORDERS**2, 256 * STEPS, 256 * STEPS]))
            loss = loss[0] + RIDGE / 2 * ((weights + step - START) ** 2).sum()
            if loss > least:
                step = step / 2
                continue
            weights = weights + step
            self.mixer = Mixer(weights)
            self.mixer.seen += seen.reshape(256, STEPS)
            self.mixer.hits += hits.reshape(256, STEPS)
            if least - loss <= ENOUGH * loss:
                break
            least = loss
            pull = slope.reshape(GATES, ORDERS) - RIDGE * (weights - START)
            step = np.linalg.solve(bend.reshape(GATES, ORDERS, ORDERS) + RIDGE * np.eye(ORDERS), pull[:, :, None])[:, :, 0]

    def values(self, asked: DataFrame) -> DataFrame:
        """(part, string, value): log10 of the probability of the last byte of strings (columns bucket, part, string)."""
        short, mixer = self.short, self.mixer
        kind = pa.schema([("part", pa.int64()), ("string", pa.binary()), ("value", pa.binary())])

        def run(asked: pa.Table, counts: pa.Table) -> pa.Table:
            if not len(asked):
                return kind.empty_table()
            none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            key, n = unpacked(counts["key"][0], counts["n"][0]) if len(counts) else none
            tables = [(u, c.sum(0, keepdims=True)) for u, c in [*short.value, *(table(o, key, n) for o in range(NEAR, ORDERS))]]
            each = [np.frombuffer(x.as_buffer(), np.uint64) for x in asked["string"]]
            every = np.unique(np.concatenate(each))
            value = mixer.log10(tables, every)
            return pa.table([asked["part"], asked["string"], pa.array([value[np.searchsorted(every, x)].tobytes() for x in each], pa.binary())], schema=kind)

        run.__annotations__ = {"asked": pa.Table, "counts": pa.Table, "return": pa.Table}
        left, right = (x.repartition(tasks(self.buckets), "bucket").groupBy("bucket") for x in (asked, self.counts))
        return left.cogroup(right).applyInArrow(run, "part bigint, string binary, value binary")

    def log10(self, string: np.ndarray) -> np.ndarray:
        """The values of a few strings."""
        u, back = np.unique(string, return_inverse=True)
        rows = [(b, 0, bytearray(u[at].tobytes())) for b, at in by_bucket(u, self.buckets)]
        value = np.zeros(len(u))
        for r in self.values(self.spark.createDataFrame(rows, "bucket bigint, part bigint, string binary")).collect():
            value[np.searchsorted(u, np.frombuffer(r["string"], np.uint64))] = np.frombuffer(r["value"])
        return value[back]


def token_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the words in lower case."""
    low = LOWER[data]
    b, e, doc = words(low, at)
    return span_hash(sums(low), b, e).view(np.int64), doc


def token_counts(texts: DataFrame) -> DataFrame:
    """(h, c): how often each token stands in the texts, ends included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        ends = 0

        def out():
            u, n = summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            for k in range(0, len(u), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(u[k : k + (1 << 17)]), pa.array(n[k : k + (1 << 17)])], names=["h", "n"])

        for batch in batches:
            ends += batch.num_rows
            for _, _, data, at in pieces(batch.column(0)):
                held.append(np.unique(token_hashes(data, at)[0], return_counts=True))
                if len(held) >= 16:
                    held = [summed(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                    if len(held[0][0]) > REMEMBERED:
                        yield from out()
                        held = []
        held.append((np.array([END]), np.array([ends])))
        if ends:
            yield from out()

    return texts.mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("c"))


def base_scores(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """(node, n_tokens, n_known, train_tokens, base_score) of rows (node, text)."""
    spark = rows.sparkSession
    size = F.floor(F.log2("c")).cast("int")
    levels = counts.groupBy(size.alias("level")).agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("n")).collect()
    whole, distinct = sum(r["n"] for r in levels), sum(r["v"] for r in levels)
    below = whole + ADDED * (distinct + 1)
    level, room = 64, FREQUENT
    for r in sorted(levels, key=lambda r: -r["level"]):
        if r["v"] > room:
            break
        level, room = r["level"], room - r["v"]
    often = counts.filter(size >= level).collect()
    often.sort(key=lambda r: r["h"])
    shared = spark.sparkContext.broadcast((np.array([r["h"] for r in often], np.int64), np.array([r["c"] for r in often], np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, c = shared.value
        value = np.log10((c + ADDED) / below)
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            for i, j, data, at in pieces(batch.column(1)):
                h, doc = token_hashes(data, at)
                h, doc = np.append(h, np.full(j - i, END)), np.append(doc, np.arange(j - i))
                u, back = np.unique(h, return_inverse=True)
                place = np.minimum(np.searchsorted(known, u), max(0, len(known) - 1))
                found = known[place] == u if len(known) else np.zeros(len(u), bool)
                there = found[back]
                score = np.bincount(doc[there], weights=value[place[back[there]]], minlength=j - i)
                tokens, good = np.bincount(doc, minlength=j - i), np.bincount(doc[there], minlength=j - i)
                # one row a text, then its rarer words, each with how often it stands there
                pair, n = np.unique(doc[~there] * len(u) + back[~there], return_counts=True)
                none = pa.nulls(len(pair), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(nodes[i:j]), pa.nulls(j - i, pa.int64()), pa.array(tokens), pa.array(good), pa.array(score)], names=["node", "h", "n", "n_known", "score"])
                yield pa.RecordBatch.from_arrays([pa.array(nodes[i + pair // len(u)]), pa.array(u[pair % len(u)]), pa.array(n), none, pa.nulls(len(pair), pa.float64())], names=["node", "h", "n", "n_known", "score"])

    parts = rows.select("node", "text").mapInArrow(run, "node bigint, h bigint, n bigint, n_known bigint, score double")
    rare = counts.filter(size < level)
    # a text's own row has no word to look up, and no key that many rows share
    key = F.coalesce("h", "node")
    met = parts.withColumn("k", key).alias("p").join(rare.alias("r"), (F.col("p.k") == F.col("r.h")) & F.col("p.h").isNotNull(), "left")
    own, c = F.col("p.h").isNull(), F.coalesce("c", F.lit(0))
    line = met.select(
        "node",
        F.when(own, 1).otherwise(0).alias("copies"),
        F.when(own, F.col("n")).otherwise(0).alias("n_tokens"),
        F.when(own, F.col("n_known")).otherwise(F.when(c > 0, F.col("n")).otherwise(0)).alias("n_known"),
        F.when(own, F.col("score")).otherwise(F.col("n") * F.log10((c + ADDED) / F.lit(below))).alias("score"),
    )
    total = line.groupBy("node").agg(*[F.sum(x).alias(x) for x in ("copies", "n_tokens", "n_known", "score")])
    by = lambda x: (F.col(x) / F.col("copies")).cast("bigint").alias(x)
    return total.select("node", by("n_tokens"), by("n_known"), F.lit(whole).cast("bigint").alias("train_tokens"), (F.col("score") / F.col("copies")).alias("base_score"))


def model_scores(rows: DataFrame, model: Model) -> DataFrame:
    """(id, held_out, node, n_bytes, score) of rows (id, held_out, node, text)."""
    buckets = model.buckets
    n = max(2 * rows.sparkSession.sparkContext.defaultParallelism, text_bytes(rows) // GROUP_BYTES)
    parts = rows.select(F.pmod("node", F.lit(n)).alias("part"), "id", "held_out", "node", "text").repartition(n, "part")

    def different(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}

        def out(part):
            u = np.unique(np.concatenate(held.pop(part)))
            for b, at in by_bucket(u, buckets):
                yield pa.RecordBatch.from_pylist([{"bucket": b, "part": part, "string": u[at].tobytes()}])

        for batch in batches:
            part = batch.column(0).to_numpy()
            for p in np.unique(part):
                mine = held.setdefault(int(p), [])
                for _, _, data, at in pieces(batch.column(4).filter(pa.array(part == p))):
                    mine.append(np.unique(strings(data, at)[0]))
                    if len(mine) >= 16:
                        mine[:] = [np.unique(np.concatenate(mine))]
                        if len(mine[0]) > REMEMBERED:
                            yield from out(int(p))
                            mine = held.setdefault(int(p), [])
        for p in list(held):
            yield from out(p)

    def run(rows: pa.Table, values: pa.Table) -> pa.Table:
        known, at = np.unique(np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in values["string"]] + [np.zeros(0, np.uint64)]), return_index=True)
        value = np.concatenate([np.frombuffer(x.as_buffer()) for x in values["value"]] + [np.zeros(0)])[at]
        score, size = [], []
        for chunk in rows["text"].chunks:
            for _, _, data, at in pieces(chunk):
                s, ends = strings(data, at)
                u, back = np.unique(s, return_inverse=True)
                score.append(np.add.reduceat(value[np.searchsorted(known, u)][back], np.concatenate([[0], ends[:-1]])))
                size.append(np.diff(at))
        n_bytes, total = (pa.array(np.concatenate([*x, np.zeros(0, kind)])) for x, kind in ((size, np.int64), (score, np.float64)))
        return pa.table([rows["id"], rows["held_out"], rows["node"], n_bytes, total], names=["id", "held_out", "node", "n_bytes", "score"])

    run.__annotations__ = {"rows": pa.Table, "values": pa.Table, "return": pa.Table}
    values = model.values(parts.mapInArrow(different, "bucket bigint, part bigint, string binary"))
    return parts.groupBy("part").cogroup(values.repartition(n, "part").groupBy("part")).applyInArrow(run, "id bigint, held_out boolean, node bigint, n_bytes bigint, score double")


def text_bytes(rows: DataFrame) -> int:
    return rows.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0


def train(learning: DataFrame) -> Model:
    """Counts of all learning texts (column text), and the mixer learned over all of them."""
    buckets = max(48, text_bytes(learning) // BUCKET_BYTES)
    halves = learning.select(F.coalesce("text", F.lit("")).alias("text"), F.pmod(F.xxhash64("text"), F.lit(2)).alias("half"))
    model = Model(checkpointed(string_counts(halves, buckets)), buckets)
    model.learn()
    return model


def scored(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every row."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.xxhash64(F.col(doc_id), F.col(text)).alias("node"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    learning = rows.filter("id is not null and not held_out").select("node", "text")
    counts = checkpointed(token_counts(learning.select("text")))
    scores = model_scores(rows, train(learning.select("text")))
    base = base_scores(rows.select("node", "text"), counts)
    both = scores.join(base, "node")
    return both.select("id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", (-F.col("score") * F.lit(float(np.log2(10))) / F.greatest(F.lit(1), F.col("n_bytes"))).alias("bits_per_byte"))
