"""Personal data: base patterns, and a linear-chain conditional random field that adds spans to theirs.

The base patterns find mail addresses, network addresses, card numbers and phone numbers. The field finds what has no fixed form:
names, postal addresses, dates of birth, numbers of accounts and papers, phone numbers without a plus and spelled mail addresses.
A token is a run of bytes between white space, quotes, brackets and marks; its features are the word, its shape (capitals,
digits, length), its ending, what stands between it and the word before, the two words before and the one after, their shapes, and pairs of
those. Tags are outside, and begin and inside of each kind. The weights are fitted to a small labelled table (`pii_table`, or
any table of texts and spans; at most LABELLED rows of it, those of least hash). Decoding is Viterbi's over every token of every whole text, in
numpy batches of many stretches: where outside leads by more than any transitions can give, the chain falls apart there without loss.

Added spans that touch a base span are dropped, so base spans always stay. Null or empty texts have no spans. An empty labelled table
gives no field, and no span is added. Ties between tags go to the one listed first. Repeated rows get equal results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetwatt.llm import pii_table
from fleetwatt.llm.crf import SLOTS, Field, fit
from fleetwatt.llm.text import LOWER, mix, pieces, span_hash, sums, words

#: Bound of the labelled rows that are learned from.
LABELLED = 4000

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, *pii_table.KINDS)

# possessive runs: each byte of a text is looked at a bounded number of times
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: Texts without a match of this have no base span.
ANY = r"@|[0-9]\.[0-9]+\.[0-9]+\.[0-9]|[0-9](?:[ -]?[0-9]){12}|\+[0-9]"

BREAK = np.zeros(256, bool)
BREAK[list(b" \t\n\x0b\x0c\r\"'`()[]{}<>,;:=|!?&*#$%~^\\.")] = True

_U = np.uint64


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: at each @, the longest local part behind the last match, and a domain."""
    done, at = 0, text.find("@")
    while at >= 0:
        end = DOMAIN.match(text, at + 1)
        start = at
        if end:
            while start > done and text[start - 1] in LOCAL:
                start -= 1
        if end and start < at:
            yield start, end.end()
            done = end.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    n = [int(d) for d in reversed(digits)]
    return (sum(n[::2]) + sum(d * 2 - 9 * (d > 4) for d in n[1::2])) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by kind as listed and then start."""
    out = [("email", *s) for s in emails(text)] if "@" in text else []
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if 13 <= m.end() - m.start() <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def tokens(data: np.ndarray, at: np.ndarray):
    """(begin, end, text, features) of every token; features is an array of slots, a row a token."""
    low = LOWER[data]
    b, e, doc = words(data, at, BREAK)
    n = len(b)
    if not n:
        return b, e, doc, np.zeros((0, 1), np.int32)
    run = sums(low)
    word = span_hash(run, b, e)
    edge = np.ones(n, bool)
    edge[1:] = doc[1:] != doc[:-1]
    before = np.where(edge, at[doc], np.concatenate([[0], e[:-1]]))
    two = np.zeros(len(data), bool)
    two[:-1] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    digit, upper = (data >= 48) & (data < 58), ((data >= 65) & (data < 91)) | two
    mark = (data == 45) | (data == 47)
    count = lambda mask: (c := np.concatenate([[0], np.cumsum(mask)]))[e] - c[b]
    size, d, u, m = e - b, count(digit), count(upper), count(mark)
    # what stands before a token: line ends, stops, commas, colons, other marks
    between = lambda mask: (c := np.concatenate([[0], np.cumsum(mask)]))[b] > c[before]
    known = [data == 10, data == 46, data == 44, (data == 58) | (data == 61)]
    gap = edge.astype(np.uint64)
    for mask in (*known, ~(known[0] | known[1] | known[2] | known[3] | (data == 32))):
        gap = gap * _U(2) + between(mask)
    least = lambda x, k: np.minimum(x, k)
    figures = np.where(d > 0, np.digitize(size, [2, 3, 4, 5, 6, 8, 9, 10, 12]) + 1, 0)
    case = np.where(u == 0, 0, np.where(u == size, np.where(size == 1, 1, 2), np.where(upper[b] & (u == 1), 3, 4)))
    shape = ((figures * 5 + case) * 3 + np.where(d == 0, 0, np.where(d + m == size, 1, 2))) * 3 + least(m, 2)
    shape = shape.astype(np.uint64) + _U(1)
    tail = span_hash(run, np.maximum(b, e - 3), e)

    def beside(x: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros_like(x)
        if k > 0:
            out[:-k] = np.where(doc[k:] == doc[:-k], x[k:], 0)
        else:
            out[-k:] = np.where(doc[:k] == doc[-k:], x[:k], 0)
        return out

    last, ago, coming = beside(shape, -1), beside(shape, -2), beside(shape, 1)
    said = beside(word, -1)
    shift = lambda x, k: x << _U(k)
    parts = [word, shape, said, beside(word, -2), beside(word, 1), shape ^ shift(last, 16), shape ^ shift(coming, 16), shape ^ shift(gap, 32), gap ^ shift(last, 16), tail ^ shape, said ^ shape, beside(word, -2) ^ shape, shape ^ shift(last, 16) ^ shift(ago, 32), beside(word, 1) ^ shape, ((word == said) + _U(2) * (word == beside(word, 1))) ^ shift(shape, 8), np.zeros_like(word)]
    slots = np.empty((n, len(parts)), np.int32)
    for k, x in enumerate(parts):
        slots[:, k] = mix(x + _U((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) & _U(SLOTS - 1)
    return b, e, doc, slots


def points(data: np.ndarray) -> np.ndarray:
    """Code points before each byte."""
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])


def chain(text: str, spans: list[tuple[int, int, str]]) -> tuple[np.ndarray, np.ndarray]:
    """A labelled text as features and tags."""
    data = np.frombuffer(text.encode(), np.uint8)
    b, e, _, slots = tokens(data, np.array([0, len(data)]))
    upto, tags = points(data), np.zeros(len(b), np.int64)
    for s, t, kind in spans:
        inside = np.flatnonzero((upto[b] < t) & (upto[e] > s))
        tags[inside] = 2 * pii_table.KINDS.index(kind) + 2
        if len(inside):
            tags[inside[0]] -= 1
    return slots, tags


def learn(labelled: DataFrame, text: str = "text", spans: str = "spans") -> Field | None:
    """The field fitted to a labelled table (text, spans array<struct<start, end, kind>>); None if the table is empty."""
    rows = labelled.filter(F.col(text).isNotNull()).orderBy(F.xxhash64(text), text).limit(LABELLED).select(text, spans).collect()
    chains = [chain(t, [(s["start"], s["end"], s["kind"]) for s in found or [] if s["kind"] in pii_table.KINDS]) for t, found in rows]
    return fit(chains, 2 * len(pii_table.KINDS) + 1) if any(len(y) for _, y in chains) else None


def own_table(spark: SparkSession) -> DataFrame:
    """The labelled table that comes with the operator."""
    return spark.createDataFrame(pii_table.labelled(), "text string, spans array<struct<start:bigint,end:bigint,kind:string>>")


def added_spans(field: Field, data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, str, int, int]]:
    """(text, kind, start, end) of the field's spans, in code points of the text."""
    b, e, doc, slots = tokens(data, at)
    tags = field.tags(slots, doc)
    on = np.flatnonzero(tags)
    if not len(on):
        return
    upto = points(data)
    kind = (tags[on] - 1) // 2
    first = np.ones(len(on), bool)
    first[1:] = (np.diff(on) > 1) | (doc[on[1:]] != doc[on[:-1]]) | (kind[1:] != kind[:-1]) | (tags[on[1:]] % 2 == 1)
    heads = np.flatnonzero(first)
    for i, j in zip(heads, np.append(heads[1:], len(on)) - 1, strict=True):
        k = int(doc[on[i]])
        zero, start = upto[at[k]], b[on[i]]
        # a bracket that the span closes belongs to it
        start -= start > at[k] and data[start - 1] == 40 and (data[start : e[on[j]]] == 41).any()
        yield k, pii_table.KINDS[kind[i]], int(upto[start] - zero), int(upto[e[on[j]]] - zero)


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def private_column(spark: SparkSession, field: Field | None, text: str | Column) -> Column:
    """array<struct<kind, start, end>> of a text column (code points), by kind as listed and then start."""
    shared = spark.sparkContext.broadcast(None if field is None else (field.weights, field.moves))

    def scan(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        crf = None if shared.value is None else Field(*shared.value)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for texts in it:
            some = pc.fill_null(pc.match_substring_regex(texts, ANY), False).to_numpy(zero_copy_only=False)
            out = [base_spans(texts[i].as_py()) if some[i] else [] for i in range(len(texts))]
            for i, _, data, at in pieces(texts) if crf else ():
                for k, name, s, t in added_spans(crf, data, at):
                    base = out[i + k]
                    if all(t <= x or s >= y for what, x, y in base if what in BASE):
                        base.append((name, s, t))
            rows = [[{"kind": a, "start": s, "end": t} for a, s, t in sorted(x, key=lambda v: (KINDS.index(v[0]), v[1]))] for x in out]
            yield pa.array(rows, kind)

    scan.__annotations__ = {"it": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(scan, SPANS)(text)


def joined(spans: Column, base_only: bool = False) -> Column:
    """kind:start:end of spans, comma-joined."""
    x = F.filter(spans, lambda s: s["kind"].isin(*BASE)) if base_only else spans
    return F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
