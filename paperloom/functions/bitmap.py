"""A bitmap of fixed size as a pre-filter of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Size of the bitmap of `may_contain`: 2**25 bits, 4 MB whatever the number of keys.
BITMAP_BITS = 1 << 25


def may_contain(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of `df` whose key may be in `keys`: a pre-filter before a join, so that wide rows without a partner are not shuffled.

    A bitmap over hashed keys is built by an aggregate and broadcast; its size is fixed, more keys only let more rows through.
    """
    at = F.pmod(F.xxhash64(key), F.lit(BITMAP_BITS)) + 1
    bits = keys.select(at.alias("_at")).groupBy(F.bitmap_bucket_number("_at").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("_bits"))
    out = df.withColumn("_at", at).withColumn("_bucket", F.bitmap_bucket_number("_at")).withColumn("_pos", F.bitmap_bit_position("_at").cast("int"))
    # the hex digit that holds the bit (high half of the byte first) as a number
    digit = F.ascii(F.expr("substring(hex(substring(_bits, _pos div 8 + 1, 1)), 2 - _pos % 8 div 4, 1)"))
    half = F.when(digit >= 65, digit - 55).otherwise(digit - 48)
    return out.join(F.broadcast(bits), "_bucket").filter(half.bitwiseAND(F.expr("shiftleft(1, _pos % 4)")) != 0).drop("_at", "_bucket", "_pos", "_bits")
