"""Ranked lexical search with per-term geometric blocking.

A document's score for an item is the sum over the item's terms of a term's weight times its impact in the document, a whole
number that grows with the term's count and falls with the document's length. The index and the search:

1. One pass over the whole texts keeps, of each document, its length and the counts of those terms that some item asks for.
   Statistics (documents, terms, documents of a term) come from all of them.
2. Documents are put in order of similarity: their weighted terms, thrown on DIM random axes, go to the nearest of PIVOTS
   pivot documents, and by their nearness within it. Pivots only set the order, every document is in it. The order is
   cut by sampled bounds, so that thousands of copies of one document spread over tasks.
3. A task goes through its stretch in chunks. In a chunk each term has its list of documents, in order of similarity, cut in
   blocks of BLOCK: neighbours in a block are alike. A block's summary is the greatest impact of every term among its
   documents, coordinate by coordinate, and so its product with an item's weights is an upper bound of all their scores.
4. A block is passed over for an item only if that bound is below the item's K-th best score so far in the task. Lists of
   terms that together can't lift a document to that score aren't opened at all: a document that could reach it stands in one of the
   others too. Documents of the blocks that are left are scored exactly, in whole numbers.
5. The K best of each item and task are ranked over all tasks.

The first chunk of a task is scored whole, as nothing is known yet. Items are answered in groups whose terms take about
GROUP bytes, each with a pass of its own; so what is sent to all tasks is bounded, whatever the number of items.

Null texts and texts without a term have no terms, aren't counted and are in no result. Rows that share an id are separate
documents, and items that share an id separate items. A null doc_id ranks behind equal scores. Equal scores go by doc_id. Items
without a term, or without a document that holds one, give no rows; so do empty tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetwatt.llm.best import Best
from fleetwatt.llm.text import LOWER, pieces, words
from fleetwatt.session import checkpointed

#: Results of an item.
K = 10

#: Bytes of terms of the items answered in one pass.
GROUP = 1 << 23

#: Terms and items worked on at once in a task.
COLUMNS = 2048
ITEMS = 256

#: Documents in a chunk, in a block, and (about) in a task.
CHUNK = 1024
BLOCK = 32
TASK = 1 << 14

#: Random axes and pivots that the order of similarity goes by; rows looked at for pivots.
DIM = 32
PIVOTS = 128
SAMPLE = 512

#: Bytes that part terms: all of ASCII but letters and digits.
GAP = np.zeros(256, bool)
GAP[:128] = True
GAP[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


def terms(data: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All terms of texts in lower case, and the text of each."""
    b, e, doc = words(data, at, GAP)
    ends = np.cumsum(e - b)
    starts = ends - (e - b)
    body = LOWER[data[np.repeat(b - starts, e - b) + np.arange(ends[-1] if len(ends) else 0)]]
    offsets = np.concatenate([starts, ends[-1:]]) if len(b) else np.zeros(1, np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(b), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(body)]), doc


def asked(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, terms, bytes): the distinct terms of every item that has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in pieces(batch.column(1)):
                got, doc = terms(data, at)
                ids, lists, sizes = [], [], []
                for k in np.unique(doc):
                    own = pc.unique(got.filter(pa.array(doc == k)))
                    ids.append(batch.column(0)[i + int(k)].as_py())
                    lists.append(own.to_pylist())
                    sizes.append(sum(map(len, lists[-1])) + 8 * len(own))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lists, pa.list_(pa.binary())), pa.array(sizes, pa.int64())], names=["item_id", "terms", "bytes"])

    rows = items.select(F.col(item_id).cast("bigint"), F.col(text))
    return checkpointed(rows.mapInArrow(run, "item_id bigint, terms array<binary>, bytes bigint").select(F.monotonically_increasing_id().alias("item"), "*"))


def counted(docs: DataFrame, vocabulary: list[bytes], doc_id: str, text: str) -> DataFrame:
    """(doc_id, n, ids, tfs, docs): length and counts of asked terms of each document that has one; rows with `docs` sum up documents and terms."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = pa.array(known.value, pa.large_binary())
        n_docs = n_terms = 0
        for batch in batches:
            for i, j, data, at in pieces(batch.column(1)):
                got, doc = terms(data, at)
                n = np.bincount(doc, minlength=j - i)
                n_docs, n_terms = n_docs + int((n > 0).sum()), n_terms + len(doc)
                which = pc.index_in(got, value_set=values)
                hit = which.is_valid().to_numpy(zero_copy_only=False)
                pair, tf = np.unique(doc[hit] * len(values) + which.drop_null().to_numpy(), return_counts=True)
                own = pair // max(1, len(values))
                some = np.unique(own)
                cut = np.append(np.searchsorted(own, some), len(own)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(v.astype(np.int32))) for v in (pair % max(1, len(values)), tf)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(some)), pa.array(n[some].astype(np.int64)), *lists, pa.nulls(len(some), pa.int64())], names=["doc_id", "n", "ids", "tfs", "docs"])
        none = pa.nulls(1, pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([n_terms]), none, none, pa.array([n_docs])], names=["doc_id", "n", "ids", "tfs", "docs"])

    rows = docs.select(F.col(doc_id).cast("bigint"), F.col(text))
    return checkpointed(rows.mapInArrow(run, "doc_id bigint, n bigint, ids array<int>, tfs array<int>, docs bigint"))


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Whole-number impact of terms that stand tf times in documents of n terms."""
    m = 10 + (90 * n * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def entries(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """(n, starts, row, ids, tfs): the flat lists of rows (doc_id, n, ids, tfs, ..)."""
    size = pc.list_value_length(batch.column(2)).to_numpy().astype(np.int64)
    flat = [pc.list_flatten(batch.column(c)).to_numpy().astype(np.int64) for c in (2, 3)]
    return batch.column(1).to_numpy(), np.cumsum(size) - size, np.repeat(np.arange(len(size)), size), *flat


def thrown(batch: pa.RecordBatch, weights: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Directions of documents on DIM random axes."""
    axes = np.random.default_rng(11).integers(0, 2, (len(weights), DIM), dtype=np.int8).astype(np.float32) * 2 - 1
    n, starts, row, ids, tfs = entries(batch)
    if not len(n):
        return np.zeros((0, DIM), np.float32)
    value = (weights[ids] * impacts(tfs, n[row], n_docs, n_terms)).astype(np.float32)
    y = np.empty((len(n), DIM), np.float32)
    for d in range(DIM):
        y[:, d] = np.add.reduceat(value * axes[ids, d], starts)
    return y / np.maximum(np.sqrt((y * y).sum(1, keepdims=True)), 1e-9)


def in_order(forward: DataFrame, weights: np.ndarray, n_docs: int, n_terms: int, n_rows: int) -> DataFrame:
    """Documents by pivot and nearness to it."""
    spark = forward.sparkSession
    chosen = forward.orderBy(F.xxhash64("ids", "tfs"), "n").limit(SAMPLE).select("doc_id", "n", "ids", "tfs").toArrow().combine_chunks()
    directions = np.unique(np.vstack([thrown(b, weights, n_docs, n_terms) for b in chosen.to_batches()]), axis=0)
    pivots = directions[np.random.default_rng(5).permutation(len(directions))[:PIVOTS]]
    shared = spark.sparkContext.broadcast((weights, pivots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, pivots = shared.value
        for batch in batches:
            near = thrown(batch, weights, n_docs, n_terms) @ pivots.T
            cell = near.argmax(1) if len(near) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(near.max(1) if len(near) else np.zeros(0, np.float32))], names=[*batch.schema.names, "cell", "near"])

    placed = forward.select("doc_id", "n", "ids", "tfs").mapInArrow(run, "doc_id bigint, n bigint, ids array<int>, tfs array<int>, cell int, near float")
    order = ["cell", "near", F.xxhash64("ids", "tfs"), "doc_id"]
    return placed.repartitionByRange(max(1, -(-n_rows // TASK)), *order).sortWithinPartitions(*order).select("doc_id", "n", "ids", "tfs")


class Batch:
    """Items worked on at once: their terms as columns, weights, and the best documents so far."""

    def __init__(self, items: list[int], lists: list[np.ndarray], weights: np.ndarray, k: int):
        self.items = np.array(items)
        self.terms = np.unique(np.concatenate(lists))
        self.column = np.full(len(weights), -1)
        self.column[self.terms] = np.arange(len(self.terms))
        longest = max(map(len, lists))
        self.of = np.zeros((len(items), longest), np.int64)
        self.weight = np.zeros((len(items), longest))
        self.by_term = np.zeros((len(self.terms), len(items)))
        for i, own in enumerate(lists):
            c = self.column[own]
            self.of[i, : len(own)], self.weight[i, : len(own)] = c, weights[own]
            self.by_term[c, i] = weights[own]
        self.best = Best(len(items), k)

    def needed(self) -> np.ndarray:
        """The least score that can still come in."""
        return np.maximum(self.best.least, 1)

    def essential(self, top: np.ndarray, live: np.ndarray, needed: np.ndarray) -> np.ndarray:
        """(term, live item): whether the term's list has to be opened for the item, if no impact is above `top`."""
        share = top[self.of[live]] * self.weight[live]
        order = np.argsort(share, 1)
        upto = np.cumsum(np.take_along_axis(share, order, 1), 1)
        out = np.zeros((len(self.terms), len(live)), bool)
        i, j = np.nonzero(upto >= needed[:, None])
        out[self.of[live][i, order[i, j]], i] = True
        # places behind an item's last term point at column 0 with weight 0
        return out & (self.by_term[:, live] > 0)

    def opened(self, d: np.ndarray, live: np.ndarray, needed: np.ndarray, top: np.ndarray) -> np.ndarray:
        """Which documents of a chunk stand in a block whose bound doesn't fail."""
        lists = self.essential(top, live, needed)
        out = np.zeros(len(d), bool)
        some = np.flatnonzero(lists.any(1) & (top > 0))
        # a few lists at a time, so that the gathered rows stay small
        size = (d[:, some] > 0).sum(0)
        for part in np.split(some, np.flatnonzero(np.diff(np.cumsum(size) // CHUNK)) + 1):
            term, doc = np.nonzero(d[:, part].T > 0)
            if not len(term):
                continue
            first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
            place = np.arange(len(term)) - np.repeat(first, np.diff(np.append(first, len(term))))
            starts = np.flatnonzero(place % BLOCK == 0)
            summary = np.maximum.reduceat(d[doc], starts, 0)
            open_ = ((summary @ self.by_term[:, live] >= needed) & lists[part[term[starts]]]).any(1)
            out[doc[np.repeat(open_, np.diff(np.append(starts, len(term))))]] = True
        return out

    def chunk(self, ids: np.ndarray, row: np.ndarray, impact: np.ndarray, ident: np.ndarray, uid: np.ndarray) -> None:
        column = self.column[ids]
        own = column >= 0
        d = np.zeros((len(ident), len(self.terms)))
        d[row[own], column[own]] = impact[own]
        top = d.max(0)
        needed = self.needed()
        live = np.flatnonzero(top @ self.by_term >= needed)
        if not len(live):
            return
        needed = needed[live]
        docs = np.arange(len(d)) if (needed == 1).any() else np.flatnonzero(self.opened(d, live, needed, top))
        score = d[docs] @ self.by_term[:, live]
        i, j = np.nonzero(score >= needed)
        self.best.add(live[j], score[i, j].astype(np.int64), ident[docs[i]], uid[docs[i]])
        self.best.settle()


def batches_of(lists: list[np.ndarray], weights: np.ndarray, k: int) -> list[Batch]:
    """Items in batches of bounded terms; an item with more terms than that is a batch of its own."""
    out, items, seen = [], [], set()
    for i, own in enumerate(lists):
        if items and (len(items) == ITEMS or len(seen.union(own.tolist())) > COLUMNS):
            out.append(Batch(items, [lists[x] for x in items], weights, k))
            items, seen = [], set()
        items.append(i)
        seen.update(own.tolist())
    return [*out, Batch(items, [lists[x] for x in items], weights, k)] if items else out


def searched(ordered: DataFrame, lists: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(place, doc_id, score): the k best documents of each item in each task."""
    shared = ordered.sparkSession.sparkContext.broadcast((lists, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, upto = batches_of(*shared.value, k), 0
        for batch in batches:
            for first in range(0, batch.num_rows, CHUNK):
                part = batch.slice(first, CHUNK)
                n, _, row, ids, tfs = entries(part)
                null = part.column(0).is_null().to_numpy(zero_copy_only=False)
                ident = pc.fill_null(part.column(0), np.iinfo(np.int64).max).to_numpy()
                # a negative number marks a null id
                uid = np.arange(upto, upto + len(n))
                uid = np.where(null, -1 - uid, uid)
                upto += len(n)
                impact = impacts(tfs, n[row], n_docs, n_terms)
                for x in held:
                    x.chunk(ids, row, impact, ident, uid)
        for x in held:
            key, score, ident, uid = x.best.settle()
            yield pa.RecordBatch.from_arrays([pa.array(x.items[key]), pa.array(ident, mask=uid < 0), pa.array(score)], names=["place", "doc_id", "score"])

    return ordered.mapInArrow(run, "place bigint, doc_id bigint, score bigint")


def group(docs: DataFrame, rows: list, doc_id: str, text: str, k: int) -> DataFrame:
    """(item, item_id, rank, doc_id, score) for the collected items of one group."""
    vocabulary = sorted({bytes(t) for r in rows for t in r["terms"]})
    number = {t: i for i, t in enumerate(vocabulary)}
    forward = counted(docs, vocabulary, doc_id, text)
    total = forward.agg(F.sum("docs"), F.sum(F.when(F.col("docs").isNotNull(), F.col("n"))), F.sum(F.when(F.col("docs").isNull(), 1))).first()
    n_docs, n_terms, n_rows = (x or 0 for x in total)
    forward = forward.filter("docs is null")
    df = np.zeros(len(vocabulary), np.int64)
    for r in forward.select(F.explode("ids").alias("t")).groupBy("t").count().collect():
        df[r["t"]] = r["count"]
    weights = np.array([weight(n_docs, int(x)) for x in df], np.int64)
    lists = [np.array(sorted(number[bytes(t)] for t in r["terms"]), np.int64) for r in rows]
    names = docs.sparkSession.createDataFrame([(i, r["item"], r["item_id"]) for i, r in enumerate(rows)], "place bigint, item bigint, item_id bigint")
    found = searched(in_order(forward, weights, n_docs, n_terms, n_rows), lists, weights, n_docs, n_terms, k) if n_rows else None
    if found is None:
        return names.select("item", "item_id", F.lit(1).alias("rank"), F.lit(None).cast("bigint").alias("doc_id"), F.lit(0).cast("bigint").alias("score")).limit(0)
    w = Window.partitionBy("place").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.join(names, "place").select("item", "item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item."""
    known = asked(items, item_id, item_text)
    groups = -(-(known.agg(F.sum("bytes")).first()[0] or 0) // GROUP)
    out = None
    for g in range(groups):
        rows = known.filter(F.pmod(F.xxhash64("item"), F.lit(groups)) == g).orderBy("item").collect()
        if rows:
            part = group(docs, rows, doc_id, text, k)
            out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    return out.select("item_id", "rank", "doc_id", "score")
