"""Shared helpers: table access, lineage cuts and salts.

Every operator accepts extra columns with any names: it selects the columns it needs into a
frame of its own, and carries the user's row as one struct where rows are returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.bitmap import BITMAP_BITS, may_contain  # noqa: F401
from ..functions.staging import clear_stages, stage, stage_dir  # noqa: F401

#: ASCII white space that separates words: 0x20 and 0x09 to 0x0D.
WORD_SEP = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, least: int = 8) -> int:
    """Number of shuffle partitions of this session, for salts and bucket counts."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def crc_mod(col: Column, mod: int) -> Column:
    """crc32 of the decimal text of an id, modulo `mod`; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def held_out(col: Column) -> Column:
    return crc_mod(col, 5) == 0


def let(value: Column, body) -> Column:
    """Bind `value` once and use it many times inside `body` (also inside lambdas)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sample_ids(df: DataFrame, key: str, cap: int) -> DataFrame:
    """The `cap` rows with the smallest hashes of `key`, which must be distinct; all rows if there are no more than `cap`."""
    n = df.count()
    if n <= cap:
        return df
    place = F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(1 << 40))
    # a filter first, so that few more than `cap` rows are compared
    near = df.filter(place < int((cap + 6 * cap**0.5) / n * (1 << 40)))
    return near.orderBy(place, key).limit(cap)


#: Keys with more than a thousandth of the rows are dealt over so many salts.
SALTS = 256


def join_spread(left: DataFrame, right: DataFrame, key: str | list[str], count: str, ties: list[str], how: str = "inner") -> DataFrame:
    """Join of `left` with `right`, which has each key once and in `count` about how many rows of `left` have it.

    Keys with over a thousandth of all rows (so at most 1000 of them) are broadcast, and their rows
    dealt over salts by `ties`, so no task gets all rows of one key. `right` should be staged.
    """
    keys = [key] if isinstance(key, str) else key
    total = right.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) * 1000 > total
    few = right.filter(hot).select(*keys, F.lit(True).alias("hot_key"))
    salt = F.when(F.col("hot_key"), F.pmod(F.xxhash64(*ties, F.lit(11)), F.lit(SALTS))).otherwise(0).cast("int")
    spread = left.join(F.broadcast(few), keys, "left").withColumn("salt", salt).drop("hot_key")
    salts = F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return spread.join(right.withColumn("salt", F.explode(salts)).drop(count), [*keys, "salt"], how).drop("salt")


#: Rows that one bucket of `gapless_rank` has about.
BUCKET_ROWS = 100_000


def gapless_rank(df: DataFrame, by: list[str], first: list[str], ties: list[str], name: str, least_buckets: int = 256) -> DataFrame:
    """Adds `name`: a rank from 0 without gaps within `by`, in the order of `first`, then of a hash of `ties`.

    Rows are counted per bucket and only the counts are summed in order, so no group of `by` is
    ever sorted by one task, and there are more buckets the more rows there are. `first` must have
    few values; `df` should be staged.
    """
    buckets = max(least_buckets, -(-df.count() // BUCKET_ROWS))
    b = df.withColumn("_bucket", F.pmod(F.xxhash64(*ties), F.lit(buckets)).cast("int"))
    keys = [*by, *first, "_bucket"]
    counts = b.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy(*first, "_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*keys, before.alias("_before"))
    local = F.row_number().over(Window.partitionBy(*keys).orderBy(*ties))
    return b.withColumn("_local", local).join(counts, keys).withColumn(name, F.col("_before") + F.col("_local") - 1).drop("_bucket", "_local", "_before")
