"""Mixing sources to target weights: temperature mixing, in DataFrame operations alone.

A source's share q is its part of all tokens (words). Weights are q ** t, normalised; t = 1 keeps the shares, t = 0
makes all sources equal. The exponent is found by bisection in [0, 1]: the largest one whose entropy reaches a target (a
share of the logarithm of the number of sources), and the least one at which no source is repeated more often than a
limit; the limit goes first. A budget of tokens is then dealt by weight. A source gets as many full passes as its part of
the budget holds, and the rest from a fixed permutation of its documents: blocks (by hash of the document) in the
order of a hash of source and block, documents in a block by hash and id, as long as the running total keeps within
the rest.

Every row gets its number of copies. A null source is a source of its own; a document without words costs nothing
and comes along in its place; a source without a word is dealt no copies. Rows that share an id are told apart by nothing and get the
same number of copies. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetwatt.session import checkpointed

#: Hex digits of a document's hash that name its block, so 16 ** 3 blocks a source.
BLOCK_DIGITS = 3

#: Bisection steps; three are answered by one pass over the sources.
STEPS = 30
AT_ONCE = 3

WORDS = r"[^\x20\x09-\x0D]+"


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("bigint")


def place(doc_id: Column, source: Column, seed: str) -> list[Column]:
    """What orders the documents of a source: order of the block, block, hash, id."""
    h = F.md5(F.concat_ws(":", F.lit(seed), doc_id.cast("string")))
    block = F.substring(h, 1, BLOCK_DIGITS)
    return [F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(source, F.lit("")), block)).alias("turn"), block.alias("block"), h.alias("h")]


def narrow(docs: DataFrame, doc_id: str, text: str, source: str, seed: str) -> DataFrame:
    """(id, source, n_tokens, turn, block, h): all that the mixture needs of a document, without its text."""
    s = F.col(source).cast("string")
    return docs.select(F.col(doc_id).alias("id"), s.alias("source"), tokens(F.col(text)).alias("n_tokens"), *place(F.col(doc_id), s, seed))


def _midpoints(lo: float, hi: float) -> list[float]:
    n = 1 << AT_ONCE
    return [lo + (hi - lo) * k / n for k in range(1, n)]


def exponent(shares: DataFrame, target_entropy: float | None, max_repeats: float | None, budget_x: float | None) -> float:
    """The exponent for `shares` (source, q); each pass over them sums powers, so no source comes to the driver."""
    n, least, most = shares.agg(F.count(F.lit(1)), F.min("q"), F.max("q")).first()
    if n < 2:
        return 1.0
    at: list[float] = []
    for kind in (k for k, x in (("entropy", target_entropy), ("repeats", max_repeats)) if x is not None):
        lo, hi = 0.0, 1.0
        for _ in range(STEPS // AT_ONCE):
            mids = _midpoints(lo, hi)
            z = [F.sum(F.pow("q", F.lit(t))).alias(f"z{k}") for k, t in enumerate(mids)]
            e = [F.sum(F.pow("q", F.lit(t)) * F.ln("q")).alias(f"e{k}") for k, t in enumerate(mids)] if kind == "entropy" else []
            row = shares.agg(*z, *e).first()
            # entropy and repetition both fall as the exponent grows
            if kind == "entropy":
                high = [math.log(row[f"z{k}"]) - t * row[f"e{k}"] / row[f"z{k}"] >= target_entropy * math.log(n) for k, t in enumerate(mids)]
            else:
                high = [((least / most) ** (t - 1) if budget_x is None else budget_x * least ** (t - 1) / row[f"z{k}"]) > max_repeats for k, t in enumerate(mids)]
            k = sum(high)
            lo, hi = ([lo, *mids, hi])[k], ([lo, *mids, hi])[k + 1]
        at.append(lo if kind == "entropy" else hi)
    return round(max(at), 6) if at else 1.0


def mixture(rows: DataFrame, *, target_entropy: float | None = None, max_repeats: float | None = None, budget_x: float | None = 1.0) -> DataFrame:
    """One row a source: tokens, weight, budget, full passes and the last place that the rest pays for.

    `rows` comes from `narrow`. The budget is budget_x times all tokens; None: the least one that gives every source one full pass.
    """
    blocks = rows.groupBy("source", "turn", "block").agg(F.sum("n_tokens").alias("n"))
    totals = checkpointed(blocks.groupBy("source").agg(F.sum("n").alias("tokens")))
    whole = totals.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all")).first()["all"]
    shares = totals.filter("tokens > 0").select("source", "tokens", (F.col("tokens") / F.lit(float(max(1, whole)))).alias("q"))
    t = exponent(shares, target_entropy, max_repeats, budget_x)
    z = shares.agg(F.sum(F.pow("q", F.lit(t))).alias("z"), F.max(F.col("q") / F.pow("q", F.lit(t))).alias("x")).first()
    z, x = z["z"] or 1.0, z["x"] or 1.0
    weight = F.round(F.pow("q", F.lit(t)) / F.lit(z), 12)
    total = float(whole) * (budget_x if budget_x is not None else z * x)
    spare = 1e-6 if budget_x is None else 0.0
    dealt = (
        shares.withColumn("weight", weight)
        .withColumn("budget", F.floor(F.col("weight") * F.lit(total) * (1 + spare)))
        .withColumn("full", F.floor(F.col("budget") / F.col("tokens")))
        .withColumn("rest", F.col("budget") - F.col("full") * F.col("tokens"))
    )
    before = F.sum("n").over(Window.partitionBy("source").orderBy("turn", "block").rowsBetween(Window.unboundedPreceding, -1))
    d = F.broadcast(dealt) if dealt.count() <= 10_000 else dealt
    ahead = blocks.withColumn("before", F.coalesce(before, F.lit(0))).alias("b").join(d.alias("d"), F.col("b.source").eqNullSafe(F.col("d.source")))
    ahead = ahead.filter("before <= rest").select("b.source", "b.turn", "b.block", "before", "rest", (F.col("before") + F.col("n") > F.col("rest")).alias("cut"))
    # whole blocks end at the last place of the block; only blocks in which the rest ends are looked into
    inner = ahead.filter("cut").alias("a").join(rows.alias("r"), F.col("a.source").eqNullSafe(F.col("r.source")) & F.col("a.turn").eqNullSafe(F.col("r.turn")) & F.col("a.block").eqNullSafe(F.col("r.block")))
    run = F.sum("n_tokens").over(Window.partitionBy("r.source", "r.turn", "r.block").orderBy("h", "id").rangeBetween(Window.unboundedPreceding, 0))
    key = lambda h, i: F.struct("turn", "block", h.alias("h"), i.alias("id"))
    fine = inner.select("r.source", "r.turn", "r.block", "h", "id", "before", "rest", run.alias("run")).filter("before + run <= rest").select("source", key(F.col("h"), F.col("id")).alias("at"))
    coarse = ahead.filter("not cut").select("source", key(F.lit("~"), F.lit(None).cast(dict(rows.dtypes)["id"])).alias("at"))
    last = fine.unionByName(coarse).groupBy("source").agg(F.max("at").alias("last"))
    return dealt.alias("d").join(last.alias("l"), F.col("d.source").eqNullSafe(F.col("l.source")), "left").select("d.source", "tokens", "q", "weight", "budget", "full", "last")


def copies(full: Column, last: Column, turn: Column, block: Column, h: Column, doc_id: Column) -> Column:
    """How often a row is taken, from its source's row of the mixture."""
    here = F.struct(turn.alias("turn"), block.alias("block"), h.alias("h"), doc_id.alias("id"))
    return (F.coalesce(full, F.lit(0)) + F.when(last.isNotNull() & (here <= last), 1).otherwise(0)).cast("bigint")


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix", **limits) -> DataFrame:
    """(id, source, n_tokens, weight, copies) of every row."""
    rows = checkpointed(narrow(docs, doc_id, text, source, seed))
    plan = checkpointed(mixture(rows, **limits))
    plan = (F.broadcast(plan) if plan.count() <= 10_000 else plan).alias("p")
    return rows.alias("r").join(plan, F.col("r.source").eqNullSafe(F.col("p.source")), "left").select(
        F.col("r.id").alias("id"), "r.source", "r.n_tokens", F.coalesce("p.weight", F.lit(0.0)).alias("weight"), copies(F.col("p.full"), F.col("p.last"), F.col("r.turn"), F.col("r.block"), F.col("r.h"), F.col("r.id")).alias("copies")
    )


def mixed_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix", **limits) -> DataFrame:
    """The rows of `docs` as they are, each as often as the mixture takes it; texts aren't shuffled while the mixture is small."""
    plan = mixture(checkpointed(narrow(docs, doc_id, text, source, seed)), **limits)
    plan = checkpointed(plan.select(F.col("source").alias("s"), "full", "last"))
    plan = F.broadcast(plan) if plan.count() <= 10_000 else plan
    s = F.col(source).cast("string")
    rows = docs.select(F.struct(*docs.columns).alias("row"), s.alias("s"), F.struct(*place(F.col(doc_id), s, seed)).alias("at"))
    both = rows.alias("r").join(plan.alias("p"), F.col("r.s").eqNullSafe(F.col("p.s")), "left")
    at = F.col("r.at")
    n = copies(F.col("p.full"), F.col("p.last"), at["turn"], at["block"], at["h"], F.col("r.row")[doc_id])
    taken = both.select("r.row", n.cast("int").alias("n")).filter("n > 0")
    return taken.select("row", F.explode(F.array_repeat(F.lit(1), F.col("n")))).select("row.*")
