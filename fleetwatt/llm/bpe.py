"""Byte-level BPE by a tokenization automaton.

The automaton reads tokens and accepts just the token sequences that BPE would give. It starts as one state with
a loop for every byte; each merge u v -> w, in order, adds a gadget: a copy of the state behind u without its arc v,
to which all arcs u now lead, and an arc w to the state behind v wherever an arc u stands. All arcs of a token
lead to one state, so the automaton is a table of gadgets: `gadget[u, v]` is the number of the merge that closed v
behind u. A word has exactly one accepted path that spells it. Decoding emits the labels of the arcs.

Null text: no tokens, empty decoded text. Texts of any length are taken whole. The literal text of an added
token (`<|endoftext|>`) becomes that token's id, as the tokenizers library has it.
"""

from __future__ import annotations

import gc
import json
import re
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: The usual byte-level split before merges (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Words whose tokens a worker remembers, and letters of such a word at most; other words are encoded each time they come.
#: Together they bound the bytes of the memory.
REMEMBERED = 120_000
SHORT = 40

#: Pairs of tokens whose arc is remembered as open or closed.
ARCS = 150_000


def byte_letters() -> dict[str, int]:
    """The letter that vocabulary files write for each byte: itself if it prints, else the next one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """Tables compiled from merges; holds no more than the vocabulary."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], added: dict[str, int] | None = None):
        letters = byte_letters()
        self.added = dict(added or {})
        size = max([*vocab.values(), *self.added.values()], default=-1) + 1
        self.label: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.label[i] = bytes(letters[c] for c in token)
        for token, i in self.added.items():
            self.label[i] = token.encode()
        self.token = {self.label[i]: i for i in vocab.values()}
        self.left, self.right, self.made = [-1] * size, [-1] * size, [0] * size
        self.gadget: dict[int, int] = {}
        for n, (a, b) in enumerate(merges, 1):
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            if self.made[w] == 0 and self.left[w] < 0:
                self.left[w], self.right[w], self.made[w] = u, v, n
            self.gadget.setdefault(u << 32 | v, n)
        self.span = list(map(len, self.label))
        self.reach: dict[bytes, int] = {}
        for text in self.token:
            self.reach[text[:2]] = max(len(text), self.reach.get(text[:2], 1))
        self.shorter = [-1] * size
        for text, i in self.token.items():
            self.shorter[i] = next((t for k in range(len(text) - 1, 0, -1) if (t := self.token.get(text[:k])) is not None), -1)

    def _open(self, t: int, x: int) -> bool:
        """Whether the state behind t still has an arc x.

        The state behind t has the gadgets of t, those that its right part had when t was made, and so on. The arc x
        is missing if a gadget closed x, or closed its left part by the time x was made, and so on.
        """
        gadget, made, left = self.gadget, self.made, self.left
        y, until = t, 1 << 60
        while y >= 0:
            z, by = x, 1 << 60
            while z >= 0:
                n = gadget.get(y << 32 | z)
                if n is not None and n < until and n <= by:
                    return False
                z, by = left[z], made[z]
            y, until = self.right[y], made[y]
        return True

    def path(self, word: bytes, arcs: dict[int, bool]) -> tuple[int, ...]:
        """The accepted path that spells the word: longest arcs first, stepping back from dead ends."""
        token, span, shorter, reach = self.token, self.span, self.shorter, self.reach
        if (t := token.get(word)) is not None:
            return (t,)
        size, out, at, dead, last = len(word), [], 0, set(), -1
        fresh = True
        while at < size:
            if fresh:
                end = at + reach.get(word[at : at + 2], 1)
                while (t := token.get(word[at:end], -1)) < 0 and end > at:
                    end -= 1
            while t >= 0:
                if not (dead and at + span[t] in dead):
                    if last < 0:
                        break
                    ok = arcs.get(last << 32 | t)
                    if ok is None:
                        ok = self._open(last, t)
                        if len(arcs) < ARCS:
                            arcs[last << 32 | t] = ok
                    if ok:
                        break
                t = shorter[t]
            if t >= 0:
                out.append(t)
                at += span[t]
                last, fresh = t, True
            elif not out:
                raise ValueError(f"no token path spells {word!r}")
            else:
                dead.add(at)
                t = out.pop()
                at -= span[t]
                last, fresh, t = out[-1] if out else -1, False, shorter[t]
        return tuple(out)


class Memory(dict):
    """Words met so far and their paths; a bounded number is kept."""

    def __init__(self, automaton: Automaton):
        self.a, self.arcs = automaton, {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.a.path(word.encode(), self.arcs)
        if len(word) <= SHORT and len(self) < REMEMBERED:
            self[word] = ids
        return ids


class Coder:
    """An automaton with the pre-split and a memory of words."""

    def __init__(self, automaton: Automaton):
        self.a, self.path = automaton, Memory(automaton).__getitem__
        self.split = regex.compile(PATTERN).findall
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(automaton.added, key=len, reverse=True))) + ")")

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if not any(x in text for x in self.a.added):
            return list(chain.from_iterable(map(self.path, self.split(text))))
        out: list[int] = []
        for i, part in enumerate(self.special.split(text)):
            if i % 2:
                out.append(self.a.added[part])
            elif part:
                out += chain.from_iterable(map(self.path, self.split(part)))
        return out

    def decode(self, ids) -> str:
        return b"".join(map(self.a.label.__getitem__, ids)).decode("utf-8", "replace")


def coder_of(tables: dict) -> Coder:
    """The coder of broadcast tables in this process; worker processes that are used again find it warm.

    Words and paths hold no cycles, so looking through the whole memory for cyclic garbage again and again is left out.
    """
    if "coder" not in tables:
        automaton = Automaton.__new__(Automaton)
        automaton.__dict__.update(tables)
        tables["coder"] = Coder(automaton)
    gc.freeze()
    return tables["coder"]


def load(path: str) -> Automaton:
    """Compile a byte-level tokenizer file; the path is read on the driver alone."""
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    if any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in d["added_tokens"]):
        raise ValueError("added tokens that take white space or whole words are not supported")
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in d["model"]["merges"]]
    return Automaton(d["model"]["vocab"], merges, {x["content"]: x["id"] for x in d["added_tokens"]})


def encode_column(spark: SparkSession, automaton: Automaton, text: str | Column) -> Column:
    """array<int> of token ids of a text column."""
    shared = spark.sparkContext.broadcast(dict(vars(automaton)))

    def encode(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = coder_of(shared.value)
        for texts in it:
            yield pa.array([coder.encode(t) for t in texts.to_pylist()], pa.list_(pa.int32()))

    encode.__annotations__ = {"it": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(encode, "array<int>")(text)


def decode_column(spark: SparkSession, automaton: Automaton, ids: str | Column) -> Column:
    """Text of an array<int> column of token ids."""
    shared = spark.sparkContext.broadcast(dict(vars(automaton)))

    def decode(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = coder_of(shared.value)
        for rows in it:
            yield pa.array([None if x is None else coder.decode(x) for x in rows.to_pylist()], pa.string())

    decode.__annotations__ = {"it": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(decode, "string")(ids)


ROUND_TRIP = "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>"


def round_trip_column(spark: SparkSession, automaton: Automaton, text: str | Column) -> Column:
    """Encode and decode in one pass: the number of tokens, and digests of the ids and of the decoded text."""
    shared = spark.sparkContext.broadcast(dict(vars(automaton)))

    def digest(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = coder_of(shared.value)
        decimal = list(map(str, range(len(coder.a.label)))).__getitem__
        for texts in it:
            gc.freeze()
            count, ids_sha, text_sha = [], [], []
            for t in texts:
                ids = coder.encode(t.as_py())
                count.append(len(ids))
                ids_sha.append(sha256(",".join(map(decimal, ids)).encode()).hexdigest())
                text_sha.append(sha256(coder.decode(ids).encode()).hexdigest())
            yield pa.StructArray.from_arrays([pa.array(count, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["n_tokens", "ids_sha256", "decoded_sha256"])

    digest.__annotations__ = {"it": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(digest, ROUND_TRIP)(text)
