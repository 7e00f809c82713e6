"""A map-side filter of fixed size in front of a join, so that rows without a partner aren't shuffled.

The keys set bits of one bitmap; rows whose bit isn't set have no partner. The bitmap has BITS bits whatever the
number of keys, so it can be broadcast; with very many keys it lets more rows through, which the join then drops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the bitmap, 4 MB when full.
BITS = 1 << 25


def flagged(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """`rows` and a column _maybe, false where the bigint `key` is surely not among `keys` (a bigint column of that name)."""
    bit = F.pmod(F.xxhash64(F.col(key)), F.lit(BITS)) + 1
    part, at = F.bitmap_bucket_number(bit), F.bitmap_bit_position(bit)
    maps = keys.groupBy(part.alias("_part")).agg(F.bitmap_construct_agg(at).alias("_bits"))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    both = rows.withColumn("_part", part).join(F.broadcast(maps), "_part", "left")
    maybe = F.coalesce(F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1, F.lit(False))
    return both.select(*rows.columns, maybe.alias("_maybe"))


def maybe_in(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows whose `key` may be among `keys`."""
    return flagged(rows, key, keys).filter("_maybe").drop("_maybe")
