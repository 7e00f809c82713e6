"""MinHash near-dedup by fast similarity sketching, banding and exact verification.

A document's set holds the hashes of its distinct windows of K words. Its sketch has BANDS * ROWS places. In round i
every element falls into a hashed place with a hashed value; a place keeps its least (round, value). The first rounds
spread elements over all places; from round BANDS * ROWS on, each round serves one place alone, so that at the latest then
every place is filled. Rounds end when no place is empty, which for a set of n takes about t ln t / n rounds.

1. Equal sets (two sums of element hashes and the size) become one node, so exact copies cost nothing further.
2. Nodes that share a band meet in a bucket; each is tied to the bucket's least node. Two sets of similarity 0.85 share
   none of 40 bands of 5 with a chance of 7e-11, of similarity 0.8 with one of 1.3e-7.
3. Nodes tied together are a family. Families are dealt in chunks of bounded size by hash; a task holds one chunk and the
   family's chunk 0, and works out all similarities among them on full sets. Pairs of two other chunks matter only if
   one of them isn't in the family's largest component by then; those strays meet all chunks in a second pass.
4. Links found are joined to components.

A text without words links with nothing, and so does a null id, which has no component. Rows that share an id are
separate documents. Identical rows link to each other. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwatt.llm.components import components
from fleetwatt.llm.prefilter import flagged, maybe_in
from fleetwatt.llm.text import mix, pieces, shingles, word_hashes
from fleetwatt.session import checkpointed

#: Words in a shingle; bands of the sketch, and places in a band.
K = 5
BANDS = 40
ROWS = 5

#: Bounds of a chunk of a family.
CHUNK_SETS = 400
CHUNK_SHINGLES = 250_000

_U = np.uint64


def sets(data: np.ndarray, at: np.ndarray, k: int = K) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    n = len(at) - 1
    h, doc = word_hashes(data, at)
    s, of = shingles(h, doc, n, k)
    whole = np.argsort(of, kind="stable") if len(of) and (np.diff(of) < 0).any() else None
    if whole is not None:
        s, of = s[whole], of[whole]
    cut = np.searchsorted(of, np.arange(n + 1))
    return [np.unique(s[cut[i] : cut[i + 1]]) for i in range(n)]


def sketch(x: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """`size` values of a non-empty set; equal places of two sketches are as likely as the sets are similar."""
    out = np.full(size, 0xFFFFFFFFFFFFFFFF, np.uint64)
    i, n = 0, len(x)
    while i < 2 * size:
        rounds = np.arange(i, min(2 * size, i + max(1, 2 * size // n)), dtype=np.uint64)
        h = mix(x[None, :] ^ mix((rounds + _U(1)) * _U(0x9E3779B97F4A7C15))[:, None])
        place = np.where(rounds[:, None] < size, (h % _U(size)).astype(np.int64), rounds[:, None].astype(np.int64) - size)
        value = (rounds[:, None] << _U(48)) | (h >> _U(16))
        np.minimum.at(out, place.ravel(), value.ravel())
        i += len(rounds)
        if out.max() != 0xFFFFFFFFFFFFFFFF:
            break
    return out


def band_keys(s: np.ndarray, bands: int = BANDS) -> np.ndarray:
    s = s.reshape(bands, -1)
    key = mix(np.arange(1, bands + 1, dtype=np.uint64) * _U(0xD1B54A32D192ED03))
    for j in range(s.shape[1]):
        key = mix(key * _U(0x9E3779B97F4A7C15) + s[:, j])
    return key.view(np.int64)


def sketched(docs: DataFrame) -> DataFrame:
    """(node, id, n, d1, d2, bands) of rows (node, id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            n, d1, d2, bands = [], [], [], []
            for _, _, data, at in pieces(texts):
                for x in sets(data, at):
                    n.append(len(x))
                    if len(x):
                        d1.append(int(mix(x).sum().view(np.int64)))
                        d2.append(int(mix(x ^ _U(0xA0761D6478BD642F)).sum().view(np.int64)))
                        bands.append(band_keys(sketch(x)))
                    else:
                        d1.append(None)
                        d2.append(None)
                        bands.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["node", "id", "n", "d1", "d2", "bands"])

    return docs.select("node", "id", "text").mapInArrow(run, "node bigint, id bigint, n bigint, d1 bigint, d2 bigint, bands array<bigint>")


def linked(group: list[np.ndarray], percent: int) -> np.ndarray:
    """The component of each set of a group, as the place of its first member; all pairs are worked out exactly."""
    k = len(group)
    size = np.array([len(x) for x in group], np.int64)
    element, of = np.concatenate(group), np.repeat(np.arange(k), size)
    order = np.argsort(element, kind="stable")
    element, of = element[order], of[order]
    fresh = np.concatenate([[True], element[1:] != element[:-1]])
    which = np.cumsum(fresh) - 1
    often = np.bincount(which)[which] > 1
    which, of = np.unique(which[often], return_inverse=True)[1], of[often]
    both = np.zeros((k, k), np.float32)
    for c in range(0, int(which.max()) + 1 if len(which) else 0, 2048):
        lo, hi = np.searchsorted(which, [c, c + 2048])
        m = np.zeros((k, 2048), np.float32)
        m[of[lo:hi], which[lo:hi] - c] = 1
        both += m @ m.T
    inter = both.astype(np.int64)
    near = 100 * inter >= percent * (size[:, None] + size[None, :] - inter)
    np.fill_diagonal(near, True)
    label = np.arange(k)
    while True:
        new = np.where(near, label[None, :], k).min(1)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def verified(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): links of the nodes of each task to the least place of their component there; rows are (family, task, node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None

        def solved():
            if len(held) < 2:
                return None
            label = linked([x for _, x in held], percent)
            nodes = np.array([n for n, _ in held], np.int64)
            moved = np.flatnonzero(label != np.arange(len(label)))
            return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], names=["a", "b"])

        for batch in batches:
            family, task, node = (batch.column(i).to_numpy() for i in range(3))
            for i, j, data, at in pieces(batch.column(3)):
                for k, x in zip(range(i, j), sets(data, at), strict=True):
                    if (family[k], task[k]) != key:
                        if (out := solved()) is not None:
                            yield out
                        held, key = [], (family[k], task[k])
                    held.append((node[k], x))
        if (out := solved()) is not None:
            yield out

    dealt = rows.select("family", "task", "node", "text").repartition("family", "task").sortWithinPartitions("family", "task", "node")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def groups(docs: DataFrame, percent: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(node, id, n_shingles, component_id) of every row; a node is a hash of id and text; sets link at `percent` of 100 or more."""
    rows = docs.select(F.xxhash64(F.col(doc_id), F.col(text)).alias("node"), F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"))
    known = checkpointed(sketched(rows))
    full = known.filter("n > 0 and id is not null")
    classes = full.groupBy("d1", "d2", "n").agg(F.min("node").alias("rep"))
    member = checkpointed(full.select("node", "id", "d1", "d2", "n").join(classes, ["d1", "d2", "n"]).select("node", "id", "n", "rep"))
    reps = full.join(member.filter("node = rep").select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]).select("node", "n", "bands")

    # ties to the least node of each bucket
    ties = reps.select("node", F.explode("bands").alias("bucket"))
    heads = ties.groupBy("bucket").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    star = ties.join(heads, "bucket").filter("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    family = components(star).withColumnRenamed("component", "family")

    # families in chunks
    sized = checkpointed(family.join(reps.select("node", "n"), "node"))
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / CHUNK_SETS), F.ceil(F.sum("n") / CHUNK_SHINGLES))
    parts = sized.groupBy("family").agg(parts.alias("parts"))
    dealt = checkpointed(sized.join(parts, "family").select("node", "family", "parts", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).alias("part")))
    some = rows.filter("id is not null").select("node", "text")
    bodies = checkpointed(maybe_in(some, "node", dealt.select("node")).join(dealt, "node").dropDuplicates(["node"]))
    tasks = F.when((F.col("part") == 0) & (F.col("parts") > 1), F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).otherwise(F.array("part"))
    links = checkpointed(verified(bodies.select("family", F.explode(tasks).alias("task"), "node", "text"), percent))

    large = bodies.filter("parts > 1")
    if not large.isEmpty():
        at = large.select("node", "family", "part").join(components(links), "node", "left").select("node", "family", "part", F.coalesce("component", "node").alias("component"))
        count = at.groupBy("family", "component").agg(F.count(F.lit(1)).alias("m"))
        main = count.groupBy("family").agg(F.max(F.struct("m", "component"))["component"].alias("main"))
        stray = checkpointed(at.join(main, "family").filter("component <> main").select("node", "family"))
        lots = stray.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / CHUNK_SETS).alias("lots"))
        if not lots.isEmpty():
            every = large.join(lots, "family").select("family", "parts", "part", "lots", "node", "text")
            task = lambda part, lot: F.col("lots") * part + lot
            there = every.select("family", F.explode(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("lots") - 1), lambda s: task(F.col("part"), s))).alias("task"), "node", "text")
            lot = F.pmod(F.xxhash64("node", F.lit(2)), F.col("lots"))
            strays = every.join(stray.select("node"), "node", "left_semi")
            comes = strays.select("family", F.explode(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1), lambda p: task(p, lot))).alias("task"), "node", "text")
            links = links.unionByName(verified(there.unionByName(comes).dropDuplicates(["family", "task", "node"]), percent))

    found = components(links)
    rooted = member.alias("m").join(found.alias("c"), F.col("m.rep") == F.col("c.node"), "left").select("m.node", "m.id", "m.n", F.coalesce("c.component", "m.rep").alias("root"))
    rooted = checkpointed(rooted)
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    told = rooted.join(least, "root").select("node", "id", F.col("n").alias("n_shingles"), "component_id")
    alone = known.filter("n = 0 or id is null").select("node", "id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return told.unionByName(alone)



def deduplicated(docs: DataFrame, percent: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` of which each component keeps the one of its least id; of identical rows one stays. Texts of rows that have no partner aren't shuffled."""
    found = checkpointed(groups(docs, percent, doc_id, text))
    gone = found.filter("id <> component_id").select("node").distinct()
    twice = found.filter("id is not null").groupBy("node").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("node")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(F.col(doc_id), F.col(text)).alias("node"))
    split = flagged(rows, "node", gone.unionByName(twice))
    checked = split.filter("_maybe").select("row", "node")
    stay = checked.join(gone, "node", "left_anti")
    alone, one = stay.filter(F.col("row")[doc_id].isNull()), stay.filter(F.col("row")[doc_id].isNotNull()).dropDuplicates(["node"])
    return split.filter("not _maybe").select("row").unionByName(alone.select("row")).unionByName(one.select("row")).select("row.*")
