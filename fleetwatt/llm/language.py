"""Language ID by rank-order profiles of n-grams.

A text is folded to words of letters in lower case, one blank around each; its profile is its RANKS most frequent
n-grams of 1 to 4 bytes that keep within a word (blank included), ties by the n-gram. A language's profile is that of
all its learning texts together. The out-of-place distance sums, over the text's n-grams, how far each one's rank is
from its rank in the language's profile, RANKS if it isn't there. The least distance wins, ties by the language's name;
the score is 1 less the distance's share of the largest possible one.

Null text, or text without a letter: `und` with score 0, also if nothing could be learned. Rows without a language
aren't learned from. Repeated rows each get their own result. Texts are taken whole, whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetwatt.llm.text import pieces

#: N-grams in a profile, and the longest n-gram in bytes.
RANKS = 300
LONGEST = 4

UNKNOWN = "und"

#: Bytes that stay: lower-case letters and all bytes of characters beyond ASCII.
LETTER = np.zeros(256, bool)
LETTER[97:123] = True
LETTER[128:] = True


def grams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, ends): the n-gram codes of each text, text by text; text i has codes[ends[i - 1]:ends[i]]."""
    out, size = [], np.zeros(len(at) - 1, np.int64)
    keep = LETTER[data]
    blank = ~keep
    single = blank.copy()
    single[1:] &= keep[:-1]
    firsts = at[:-1][at[:-1] < at[1:]]
    single[firsts] = blank[firsts]
    chosen = keep | single
    body = np.where(keep, data, 32)[chosen].astype(np.uint32)
    where = np.concatenate([[0], np.cumsum(chosen)])[at]
    padded = np.full(len(body) + 2 * (len(at) - 1), 32, np.uint32)
    shift = np.repeat(np.arange(len(at) - 1) * 2 + 1, np.diff(where))
    padded[np.arange(len(body)) + shift] = body
    doc = np.repeat(np.arange(len(at) - 1), np.diff(where) + 2)
    code, inner = padded.copy(), padded != 32
    n = len(padded)
    whole = inner.copy()
    parts = [(code[whole], doc[whole])]
    middle = np.ones(n, bool)
    for k in range(2, LONGEST + 1):
        code = (code[: n - k + 1] << np.uint32(8)) | padded[k - 1 :]
        if k > 2:
            middle = middle[: n - k + 1] & inner[k - 2 : n - 1]
        else:
            middle = middle[: n - 1]
        ok = middle & (doc[: n - k + 1] == doc[k - 1 :])
        if k == 2:
            ok &= inner[:-1] | inner[1:]
        parts.append((code[ok], doc[: n - k + 1][ok]))
    for c, d in parts:
        size += np.bincount(d, minlength=len(size))
    ends = np.cumsum(size)
    fill = ends - size
    out = np.empty(int(size.sum()), np.uint32)
    for c, d in parts:
        m = np.bincount(d, minlength=len(size))
        out[np.repeat(fill - (np.cumsum(m) - m), m) + np.arange(len(c))] = c
        fill = fill + m
    return out, ends


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = np.sort(codes)
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.diff(np.append(first, len(codes)))


def ranked(codes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The RANKS most frequent codes, best first."""
    order = ((np.uint64(0xFFFFFFFF) - count.astype(np.uint64)) << np.uint64(32)) | codes.astype(np.uint64)
    if len(order) > RANKS:
        order = np.partition(order, RANKS - 1)[:RANKS]
    return (np.sort(order) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def gram_counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, gram, n): how often each n-gram stands in the texts of each language; all rows of `docs` count."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts):
            codes, n = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
            u, at = np.unique(codes, return_inverse=True)
            return u, np.bincount(at, weights=n, minlength=len(u)).astype(np.int64)

        for batch in batches:
            langs = batch.column(1).dictionary_encode()
            names, of = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False)
            for i, j, data, at in pieces(pc.utf8_lower(batch.column(0))):
                codes, ends = grams(data, at)
                size = np.diff(np.concatenate([[0], ends]))
                for k in np.unique(of[i:j]):
                    held.setdefault(names[k], []).append(counted(codes[np.repeat(of[i:j] == k, size)]))
                    if len(held[names[k]]) >= 24:
                        held[names[k]] = [merged(held[names[k]])]
        for name, parts in held.items():
            u, n = merged(parts)
            for k in range(0, len(u), 1 << 16):
                part = slice(k, k + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(u[part]), pa.string()), pa.array(u[part].astype(np.int64)), pa.array(n[part])], names=["lang", "gram", "n"])

    rows = docs.select(F.col(text).alias("t"), F.col(lang).alias("l")).filter("t is not null and l is not null")
    return rows.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def profiles(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, list[int]]:
    """Each language's n-grams, best rank first. To the driver come RANKS numbers a language."""
    counts = gram_counts(docs, text, lang)
    best = lambda *by: Window.partitionBy(*by).orderBy(F.desc("n"), "gram")
    some = counts.withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(16))).withColumn("r", F.row_number().over(best("lang", "part"))).filter(F.col("r") <= RANKS)
    rows = some.withColumn("rank", F.row_number().over(best("lang"))).filter(F.col("rank") <= RANKS).select("lang", "gram", "rank").collect()
    out: dict[str, list[int]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["rank"])):
        out.setdefault(r["lang"], []).append(r["gram"])
    return out


def language_column(spark: SparkSession, known: dict[str, list[int]], text: str | Column) -> Column:
    """struct<lang, score> of a text column."""
    names = sorted(known)
    codes = np.unique(np.array([g for name in names for g in known[name]], np.uint32)) if names else np.zeros(0, np.uint32)
    rank = np.full((len(names), len(codes) + 1), -1, np.int32)
    for i, name in enumerate(names):
        rank[i, np.searchsorted(codes, np.array(known[name], np.uint32))] = np.arange(len(known[name]))
    shared = spark.sparkContext.broadcast((names, codes, rank))

    def judge(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names, codes, rank = shared.value
        for texts in it:
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            lowered = pc.utf8_lower(texts)
            lettered = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            for i, j, data, at in pieces(lowered):
                found, ends = grams(data, at)
                begin = 0
                for k in range(j - i):
                    end = ends[k]
                    if lettered[i + k] and names:
                        top = ranked(*counted(found[begin:end]))
                        place = np.searchsorted(codes, top)
                        place[place == len(codes)] = 0
                        place[codes[place] != top] = len(codes)
                        there = rank[:, place]
                        far = np.where(there < 0, RANKS, np.abs(there - np.arange(len(top), dtype=np.int32))).sum(1)
                        m = int(far.argmin())
                        lang[i + k] = names[m]
                        score[i + k] = 1 - far[m] / (RANKS * max(1, len(top)))
                    begin = end
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score)], names=["lang", "score"])

    judge.__annotations__ = {"it": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(judge, "struct<lang:string,score:double>")(text)
