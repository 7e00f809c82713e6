"""Secret scan: base patterns, and a linear-chain conditional random field that adds spans to theirs.

Tokens are runs of bytes between white space, quotes, brackets and marks. Each gets the tag outside, begin or inside
from hashed features: its word, shape and head, the words, shapes and gaps around it, and of the file how many of its bytes are
digits. The field's weights are fitted to two things. One is tags that the base patterns give (documents without a match are outside
throughout) on a bounded sample: up to POSITIVE stretches around matches and NEGATIVE stretches of other texts, each the
ones of least hash over the whole table, REACH tokens to either side. The other is a small labelled table (`secret_table`) of
secrets that no base pattern matches, from which the field learns what to add. Decoding is Viterbi's over every token of every whole text. Where the outside
tag leads by more than any transitions can give, it is certain, so the chain falls apart there without loss; only the
stretches between are searched.

Added spans that touch a base span are dropped, so base spans always stay. Null or empty text: no spans. Without any
match in the table the field learns from the labelled table and the other texts. Repeated rows get equal results; how rows are dealt over
partitions plays no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetwatt.llm import secret_table
from fleetwatt.llm.text import LOWER, mix, pieces, span_hash, sums, words
from fleetwatt.session import checkpointed

#: Bounds of the learning sample.
POSITIVE = 2000
NEGATIVE = 4000
REACH = 16

#: Feature slots (a power of two), and rounds over the sample.
SLOTS = 1 << 16
ROUNDS = 8

#: Share of features left out at random while fitting.
DROPPED = 0.5

KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

#: Texts without a match of this have no base span.
ANY = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"""

BREAK = np.zeros(256, bool)
BREAK[list(b" \t\n\x0b\x0c\r\"'`()[]{}<>,;:=|!?&*#$%~^\\")] = True

_U = np.uint64


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by start and then kind."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def secret_parts(text: str) -> list[tuple[int, int]]:
    """The secrets themselves: the value of an assignment, else the match."""
    out = [m.span(2) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    return out + [m.span() for p in (ACCESS, HEX) for m in p.finditer(text)]


def tokens(data: np.ndarray, at: np.ndarray):
    """(begin, end, text, features) of every token; features is an array of slots, a row a token."""
    low = LOWER[data]
    b, e, doc = words(data, at, BREAK)
    n = len(b)
    if not n:
        return b, e, doc, np.zeros((0, 1), np.int32)
    run = sums(low)
    word = span_hash(run, b, e)
    edge = np.ones(n + 1, bool)
    edge[1:n] = doc[1:] != doc[:-1]
    begins = np.where(edge[:-1], at[doc], np.concatenate([[0], e[:-1]]))
    ends = np.where(edge[1:], at[doc + 1], np.concatenate([b[1:], [0]]))
    head = span_hash(run, b, np.minimum(e, b + 4))
    before, after = span_hash(run, np.maximum(begins, b - 6), b), span_hash(run, e, np.minimum(ends, e + 6))
    digit, upper, small = (data >= 48) & (data < 58), (data >= 65) & (data < 91), (data >= 97) & (data < 123)
    count = lambda mask: (c := np.concatenate([[0], np.cumsum(mask)]))[e] - c[b]
    size, d, u, s = e - b, count(digit), count(upper), count(small)
    hexed = count(digit | ((data >= 97) & (data < 103))) == size
    turns = count(np.concatenate([[False], digit[1:] != digit[:-1]]))
    step = lambda x: np.minimum(x, 3)
    length = np.digitize(size, [4, 6, 8, 12, 16, 20, 24, 32, 40, 64])
    shape = ((((length * 4 + step(d * 4 // np.maximum(size, 1))) * 4 + step(u)) * 2 + (s > 0)) * 2 + hexed) * 4 + step(turns)
    shape = (shape * 2 + (d + u + s < size)).astype(np.uint64)
    share = np.digitize(np.add.reduceat(np.append(digit, False), np.minimum(at[:-1], len(digit)))[doc] / np.maximum(1, np.diff(at))[doc], [0.001, 0.01, 0.05, 0.2]).astype(np.uint64)

    def beside(x: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros_like(x)
        if k > 0:
            out[:-k] = np.where(doc[k:] == doc[:-k], x[k:], 0)
        else:
            out[-k:] = np.where(doc[:k] == doc[-k:], x[:k], 0)
        return out

    coarse = (((d > 0) & (s + u > 0)) * 2 + (size >= 12)).astype(np.uint64)
    last = beside(word, -1)
    parts = [word, shape, head, before, after, last, beside(word, 1), beside(word, -2), beside(shape, -1), beside(shape, 1), last ^ (before << _U(1)), shape ^ mix(before), shape ^ (share << _U(40)), coarse, coarse ^ mix(before), np.zeros_like(word)]
    slots = np.empty((n, len(parts)), np.int32)
    for k, x in enumerate(parts):
        slots[:, k] = mix(x + _U((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) & _U(SLOTS - 1)
    return b, e, doc, slots


def points(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code points before each byte of a text."""
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[at]


@dataclass
class Field:
    weights: np.ndarray  # SLOTS x 3
    moves: np.ndarray  # 3 x 3, from tag to tag

    def emissions(self, slots: np.ndarray) -> np.ndarray:
        out = np.zeros((len(slots), 3), np.float32)
        for k in range(slots.shape[1]):
            out += self.weights[slots[:, k]]
        return out

    def lead(self) -> float:
        """How much transitions can favour another tag over outside, whatever the neighbours."""
        t = self.moves
        ways = [t[a, y] + t[y, c] - t[a, 0] - t[0, c] for a in range(3) for y in (1, 2) for c in range(3)]
        one = [t[a, y] - t[a, 0] for a in range(3) for y in (1, 2)] + [t[y, c] - t[0, c] for c in range(3) for y in (1, 2)]
        return float(max(*ways, *one, 0.0))

    def viterbi(self, e: np.ndarray, left: bool, right: bool) -> list[int]:
        """Best tags of a stretch; left and right tell whether an outside token is beside it."""
        t = self.moves
        s = e[0] + (t[0] if left else 0)
        back = []
        for x in e[1:]:
            way = s[:, None] + t
            back.append(way.argmax(0))
            s = way.max(0) + x
        if right:
            s = s + t[:, 0]
        tags = [int(s.argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]

    def tags(self, slots: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The best tags of all tokens; each text is one chain."""
        e = self.emissions(slots)
        out = np.zeros(len(e), np.int8)
        unsure = np.flatnonzero(e[:, 0] - np.maximum(e[:, 1], e[:, 2]) <= self.lead())
        if not len(unsure):
            return out
        cut = np.flatnonzero((np.diff(unsure) > 1) | (doc[unsure[1:]] != doc[unsure[:-1]])) + 1
        for stretch in np.split(unsure, cut):
            i, j = int(stretch[0]), int(stretch[-1]) + 1
            out[i:j] = self.viterbi(e[i:j].astype(np.float64), i > 0 and doc[i - 1] == doc[i], j < len(doc) and doc[j] == doc[j - 1])
        return out


def fit(chains: list[tuple[np.ndarray, np.ndarray]], rounds: int = ROUNDS, rate: float = 0.3, decay: float = 1e-4, seed: int = 7) -> Field:
    """Conditional likelihood of the chains (slots, tags), climbed by adaptive gradients in batches of chains."""
    w, t = np.zeros((SLOTS, 3)), np.zeros((3, 3))
    gw, gt = np.full((SLOTS, 3), 1e-6), np.full((3, 3), 1e-6)
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        order = rng.permutation(len(chains))
        for k in range(0, len(order), 64):
            part = [chains[i] for i in order[k : k + 64]]
            size = max(len(y) for _, y in part)
            x = np.zeros((len(part), size, part[0][0].shape[1]), np.int64)
            y = np.zeros((len(part), size), np.int64)
            on = np.zeros((len(part), size), bool)
            for i, (a, b) in enumerate(part):
                x[i, : len(b)], y[i, : len(b)], on[i, : len(b)] = a, b, True
            # features left out at random, so that shape has to do where words are new
            kept = (rng.random((len(part), size, x.shape[2])) > DROPPED)[..., None]
            e = (w[x] * kept).sum(2)
            soft = lambda v, axis: (m := v.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(v - m).sum(axis))
            f, g = np.zeros_like(e), np.zeros_like(e)
            f[:, 0] = e[:, 0]
            for i in range(1, size):
                f[:, i] = np.where(on[:, i, None], soft(f[:, i - 1, :, None] + t, 1) + e[:, i], f[:, i - 1])
            for i in range(size - 2, -1, -1):
                g[:, i] = np.where(on[:, i + 1, None], soft(t[None] + (e[:, i + 1] + g[:, i + 1])[:, None, :], 2), 0.0)
            z = soft(f[:, -1], 1)
            p = np.exp(f + g - z[:, None, None]) * on[:, :, None]
            de = np.zeros_like(e)
            np.put_along_axis(de, y[:, :, None], 1.0, 2)
            de = (de * on[:, :, None] - p) / len(part)
            both = on[:, 1:] & on[:, :-1]
            pair = np.exp(f[:, :-1, :, None] + t + (e[:, 1:] + g[:, 1:])[:, :, None, :] - z[:, None, None, None]) * both[:, :, None, None]
            dt = -pair.sum((0, 1))
            np.add.at(dt, (y[:, :-1][both], y[:, 1:][both]), 1.0)
            dt /= len(part)
            dw = np.zeros_like(w)
            np.add.at(dw, x[on].ravel(), (de[on][:, None, :] * kept[on]).reshape(-1, 3))
            dw -= decay * w
            gw += dw * dw
            gt += dt * dt
            w += rate * dw / np.sqrt(gw)
            t += rate * dt / np.sqrt(gt)
    return Field((w * (1 - DROPPED)).astype(np.float32), t)


def tagged(body: np.ndarray, parts: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Features and tags of a text whose secrets are `parts`, in code points, and the first token of each."""
    b, e, _, slots = tokens(body, np.array([0, len(body)]))
    tags, firsts = np.zeros(len(b), np.int8), []
    if parts:
        pb, pe = points(body, b), points(body, e)
        for s, t in sorted(set(parts)):
            inside = np.flatnonzero((pb < t) & (pe > s))
            fresh = inside[tags[inside] == 0]
            tags[fresh] = 2
            if len(fresh):
                tags[fresh[0]] = 1
                firsts.append(int(inside[0]))
    return slots, tags, firsts


def sample(docs: DataFrame, text: str) -> DataFrame:
    """(positive, h, n, slots, tags): stretches of tokens with the tags of the base patterns; a row a stretch.

    Of texts without a match those of a hash below a bound are looked at, which are about four times NEGATIVE, or all.
    """
    limit = _U(min((1 << 64) - 1, (4 * NEGATIVE << 64) // max(1, docs.count())))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0)
            some = pc.fill_null(pc.match_substring_regex(texts, ANY), False).to_numpy(zero_copy_only=False)
            rows = []
            for i, j, data, at in pieces(texts):
                h = span_hash(sums(data), at[:-1], at[1:])
                for k in np.flatnonzero((some[i:j] | (h <= limit)) & (np.diff(at) > 0)):
                    found = secret_parts(texts[int(i + k)].as_py()) if some[i + k] else []
                    slots, tags, firsts = tagged(data[at[k] : at[k + 1]], found)
                    marks = [(m, True) for m in firsts]
                    if len(tags) and h[k] <= limit:
                        marks.append((int(h[k] % np.uint64(len(tags))), False))
                    for m, hit in marks:
                        part = slice(max(0, m - REACH), m + REACH)
                        rows.append((hit or bool(tags[part].any()), int((h[k] + np.uint64(m)).view(np.int64)), len(tags[part]), slots[part].tobytes(), tags[part].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["positive", "h", "n", "slots", "tags"])

    return docs.select(F.col(text)).mapInArrow(cut, "positive boolean, h bigint, n bigint, slots binary, tags binary")


def learn(docs: DataFrame, text: str = "text") -> Field:
    """The field fitted to the labelled table and the bounded sample."""
    rows = checkpointed(sample(docs, text).dropDuplicates(["positive", "h"]))

    def least(x: DataFrame, n: int) -> list:
        # the limit goes by hashes alone, so that no task gathers the stretches themselves
        last = x.select("h").orderBy("h").limit(n).agg(F.max("h")).first()[0]
        return [] if last is None else x.filter(F.col("h") <= last).orderBy("h").collect()

    got = least(rows.filter("positive"), POSITIVE) + least(rows.filter("not positive"), NEGATIVE)
    return fit(table_chains() + [(np.frombuffer(r["slots"], np.int32).reshape(r["n"], -1), np.frombuffer(r["tags"], np.int8)) for r in got])


def table_chains(lines: list[str] = secret_table.LINES) -> list[tuple[np.ndarray, np.ndarray]]:
    """The labelled table as features and tags."""
    rows = secret_table.labelled(lines=lines)
    chains = (tagged(np.frombuffer(t.encode(), np.uint8), parts)[:2] for t, parts in rows)
    return [c for c in chains if len(c[1])]


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def found_in(crf: Field | None, texts: pa.Array) -> list[list[tuple[str, int, int]]]:
    """Spans (kind, start, end) of each text, in code points, by start and then kind as listed."""
    some = pc.fill_null(pc.match_substring_regex(texts, ANY), False).to_numpy(zero_copy_only=False)
    out = [base_spans(texts[i].as_py()) if some[i] else [] for i in range(len(texts))]
    for i, j, data, at in pieces(texts) if crf else ():
        b, e, doc, slots = tokens(data, at)
        tags = crf.tags(slots, doc)
        first = np.flatnonzero((tags == 1) | ((tags == 2) & np.concatenate([[True], (tags[:-1] == 0) | (doc[1:] != doc[:-1])])))
        for m in first:
            n = m + 1
            while n < len(tags) and tags[n] == 2 and doc[n] == doc[m]:
                n += 1
            k = int(doc[m])
            body = data[at[k] : at[k + 1]]
            s, t = (int(np.count_nonzero((body[: p - at[k]] & 0xC0) != 0x80)) for p in (b[m], e[n - 1]))
            base = out[i + k]
            if all(t <= x or s >= y for name, x, y in base if name != "crf"):
                base.append(("crf", s, t))
    return [sorted(x, key=lambda v: (v[1], KINDS.index(v[0]))) for x in out]


def secret_column(spark: SparkSession, field: Field | None, text: str | Column) -> Column:
    """array<struct<kind, start, end>> of a text column (code points), by start and then kind as listed."""
    shared = spark.sparkContext.broadcast(None if field is None else (field.weights, field.moves))

    def scan(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        crf = None if shared.value is None else Field(*shared.value)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for texts in it:
            yield pa.array([[{"kind": a, "start": s, "end": t} for a, s, t in x] for x in found_in(crf, texts)], kind)

    scan.__annotations__ = {"it": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(scan, SPANS)(text)


#: What stands in place of a secret.
MARK = "[SECRET]"


def redacted(body: str | None, spans: list[tuple[int, int]], mark: str = MARK) -> str | None:
    """The text with every span, overlapping ones as one, put into a mark."""
    if body is None or not spans:
        return body
    made, upto = [], 0
    for s, t in sorted(spans):
        if s >= upto:
            made += [body[upto:s], mark]
        upto = max(upto, t)
    return "".join(made) + body[upto:]


def clean_column(spark: SparkSession, field: Field | None, text: str | Column, mark: str = MARK) -> Column:
    """struct<text, n_secrets>: a text column without its secrets, found and put into marks in one pass."""
    shared = spark.sparkContext.broadcast(None if field is None else (field.weights, field.moves))

    def clean(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        crf = None if shared.value is None else Field(*shared.value)
        for texts in it:
            found = found_in(crf, texts)
            out = [redacted(texts[i].as_py(), [(s, t) for _, s, t in x], mark) if x else texts[i] for i, x in enumerate(found)]
            yield pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array([len(x) for x in found], pa.int32())], names=["text", "n_secrets"])

    clean.__annotations__ = {"it": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(clean, "struct<text:string,n_secrets:int>")(text)


def joined(spans: Column, base_only: bool = False) -> Column:
    """kind:start:end of spans, comma-joined."""
    x = F.filter(spans, lambda s: s["kind"] != "crf") if base_only else spans
    return F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact_column(text: str | Column, spans: Column, mark: str = MARK) -> Column:
    """The text with every span of a column of spans put into a mark."""

    def redact(bodies: pa.Array, rows: pa.Array) -> pa.Array:
        pairs = zip(bodies.to_pylist(), rows.to_pylist(), strict=True)
        return pa.array([redacted(body, [(s["start"], s["end"]) for s in found or []], mark) for body, found in pairs], pa.string())

    redact.__annotations__ = {"bodies": pa.Array, "rows": pa.Array, "return": pa.Array}
    return F.arrow_udf(redact, "string")(text, spans)
