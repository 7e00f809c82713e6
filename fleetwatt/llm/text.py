"""Whole texts of an Arrow column as flat byte arrays: pieces, words, hashes.

Everything here works on the bytes of many texts at once. A null text counts as an empty one. Words are
`[^\\x20\\x09-\\x0D]+`, and only A-Z are ever put into lower case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once; a longer text is a piece of its own.
PIECE = (1 << 19) - 64

#: Bytes of an Arrow batch between Spark and its Python workers; a longer row is a batch of its own.
BATCH = 1 << 22

GAP = np.zeros(256, bool)
GAP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit moves every output bit."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


#: A random 64-bit value for each byte.
BYTE = mix((np.arange(256, dtype=np.uint64) + _U(1)) * _U(0x9E3779B97F4A7C15))
BASE = 0x5851F42D4C957F2D
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2 ** 64 for i up to n."""
    size = 1 << max(19, int(n).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        out = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        _POWERS[size] = tuple(out)
    return _POWERS[size]


def small_batches(spark) -> None:
    """From now on the session's Arrow batches hold about BATCH bytes, not some number of rows of any length."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(str(spark.conf.get(key)).rstrip("b")) != BATCH:
        spark.conf.set(key, BATCH)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins (one entry more than texts)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, where, data = texts.buffers()
    at = np.frombuffer(where, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if where else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def pieces(texts: pa.Array, most: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, bytes, starts) of runs of texts that hold about `most` bytes."""
    data, at = flat(texts)
    i, n = 0, len(at) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1))
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def words(data: np.ndarray, at: np.ndarray, gap: np.ndarray = GAP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, text) of every word, in order; `gap` tells for each byte whether it parts words."""
    inside = ~gap[data]
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    starts = at[:-1][at[:-1] < at[1:]]
    first[starts] = inside[starts]
    ends = at[1:][at[:-1] < at[1:]] - 1
    last[ends] = inside[ends]
    b, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return b, e, np.searchsorted(at, b, "right") - 1


def sums(data: np.ndarray, table: np.ndarray = BYTE) -> np.ndarray:
    """Running polynomial sums, from which `span_hash` takes the hash of any stretch."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * powers(len(data))[0][: len(data)], out=out[1:])
    return out


def span_hash(run: np.ndarray, b: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hashes of the stretches [b, e): equal bytes, equal hash."""
    return mix((run[e] - run[b]) * powers(len(run))[1][b] + (e - b).astype(np.uint64))


#: Bytes hashed as one stretch of a word. Sums modulo a power of two can't tell some long strings apart whatever the base, but
#: for those this is too short.
STRETCH = 64


def word_hash(run: np.ndarray, b: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hashes of words: of one stretch, or mixed from the hashes of all stretches of a longer word and their places."""
    out = span_hash(run, b, np.minimum(e, b + STRETCH))
    long = np.flatnonzero(e - b > STRETCH)
    if len(long):
        n = -(-(e[long] - b[long]) // STRETCH)
        first = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(first, n)
        begin = np.repeat(b[long], n) + place * STRETCH
        part = span_hash(run, begin, np.minimum(np.repeat(e[long], n), begin + STRETCH))
        turned = mix(part ^ mix((place.astype(np.uint64) + _U(1)) * _U(0xD1B54A32D192ED03)))
        out[long] = mix(np.add.reduceat(turned, first) + (e[long] - b[long]).astype(np.uint64) * _U(0x9E3779B97F4A7C15))
    return out


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every word in lower case."""
    low = LOWER[data]
    b, e, doc = words(low, at)
    return word_hash(sums(low), b, e), doc


def shingles(h: np.ndarray, doc: np.ndarray, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every window of k words; a text with fewer words, but any, is one window."""
    count = np.bincount(doc, minlength=n_docs)
    out = h.copy()
    for j in range(1, k):
        step = np.zeros_like(h)
        step[: max(0, len(h) - j)] = h[j:]
        out = mix(out * _U(0x9E3779B97F4A7C15) + step)
    ends = np.cumsum(count)
    left = ends[doc] - np.arange(len(h))
    whole = left >= k
    short = np.flatnonzero((count > 0) & (count < k))
    out, doc = out[whole], doc[whole]
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for i, d in enumerate(short):
            x = np.full(1, count[d], np.uint64)
            for w in h[ends[d] - count[d] : ends[d]]:
                x = mix(x * _U(0x9E3779B97F4A7C15) + w)
            extra[i] = x[0]
        out, doc = np.concatenate([out, extra]), np.concatenate([doc, short])
    return out, doc
