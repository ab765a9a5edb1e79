"""Aliases of kinds with few possible values: distinct by construction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keyed import hmac_sha256, number_at, permuted
from ..functions.staging import stage

#: Initials are four letters, permuted as two halves of two.
HALF = 26**2
#: Values of the kinds that stand for one of a few words (fixed values).
ENUMS = {"trapped": ["True", "False", "Unknown"]}


def _initials(n: Column) -> Column:
    letters = lambda x: F.concat(*[F.char((65 + F.floor(x / F.lit(26**i)) % 26).cast("int")) for i in (3, 2, 1, 0)])
    return F.transform(F.array(n), letters)[0]  # the number is worked out once


def spaced_aliases(keys: DataFrame, salt: bytes, scope: list[str], enums: dict[str, list[str]]) -> DataFrame:
    """`keys(*scope, kind, original_value)`, distinct, of kind `initials` or of a kind in `enums`, with alias, attempt and error_code.

    Every original draws an alias by its HMAC (attempt 0); the first original of those that drew the same one keeps it, unless it is the
    original itself. All others are settled together (attempt 1): of n originals u kept theirs, so among the first n values of a permutation
    that the salt chooses for the scope at least n - u are unused, and the others take these by rank. Nothing is drawn again. An original that
    would get itself changes places with others like it; a single one takes the next unused value or, if all are in use, changes places with another original.
    Rows may come in any order and with any partitions.

    Originals of a scope with more of them than aliases exist, and one whose only possible alias is itself, get a null
    alias and ALIASES_EXHAUSTED. They are told apart by counts, so a window never holds more rows than a kind has aliases.
    """
    values = {k: sorted(set(v)) for k, v in enums.items()}
    if any("" in v or not v for v in values.values()):
        raise ValueError("values of an enumeration must not be empty")
    sizes = {"initials": HALF**2} | {k: len(v) for k, v in values.items()}
    space = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, n)])[F.col("kind")]

    def value(index: Column) -> Column:
        """The index-th alias in the order of the scope."""
        out = F.when(F.col("kind") == "initials", _initials(permuted(index, HALF, F.col("key"))))
        for kind, words in values.items():
            mixed = F.array_sort(F.array(*[F.struct(F.sha2(F.concat_ws(":", "key", F.lit(w)), 256).alias("h"), F.lit(w).alias("w")) for w in words]))
            out = out.when(F.col("kind") == kind, F.get(mixed, index.cast("int"))["w"])
        return out

    cols = [*scope, "kind", "original_value"]
    d = keys.select(*cols, F.to_json(F.struct(*scope, "kind")).alias("g"))  # never null, nulls of the scope left out by name
    key = hmac_sha256(salt, F.concat(F.lit("order\0"), "g"))
    groups = stage(d.groupBy("g", "kind").agg(F.count(F.lit(1)).alias("n")).withColumn("space", space).withColumn("key", key), "groups")
    crowded = d.join(groups.filter("n > space").select("g"), "g", "left_semi").select(*cols, F.lit(None).cast("string").alias("alias"), F.lit(0).alias("attempt"))

    drawn = number_at(hmac_sha256(salt, F.concat_ws("\0", "kind", F.lit("string"), "original_value", F.concat_ws("|", *scope), F.lit("0"))), 1) 
    d = d.join(groups.filter("n <= space").drop("kind"), "g").withColumn("drawn", drawn % F.col("space")).withColumn("alias", value(F.col("drawn"))).drop("drawn")
    first = F.row_number().over(Window.partitionBy("g", "alias").orderBy("original_value")) == 1
    d = stage(d.withColumn("keeps", first & ~F.coalesce(F.col("alias") == F.col("original_value"), F.lit(False))), "drawn")

    open_groups = d.filter("not keeps").select("g", "kind", "key", "n", "space").distinct()
    upto = F.least(F.col("n"), F.col("space") - 1)  # one more than needed, if there is one
    offers = open_groups.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), upto.cast("long")))).withColumn("alias", value(F.col("i")))
    offers = offers.join(d.filter("keeps").select("g", "alias"), ["g", "alias"], "left_anti")
    nth = lambda order: F.row_number().over(Window.partitionBy("g").orderBy(order))
    offers = stage(offers.select("g", F.col("alias").alias("offer"), nth("i").alias("j")), "offers")

    late = d.filter("not keeps").withColumn("j", nth("original_value"))
    spare = offers.join(late.groupBy("g").agg(F.count(F.lit(1)).alias("m")), "g").filter("j = m + 1").select("g", F.col("offer").alias("spare"))
    late = late.join(offers, ["g", "j"]).withColumn("alias", F.col("offer"))
    d = d.filter("keeps").unionByName(late.drop("j", "offer")).join(spare, "g", "left")
    d = d.withColumn("itself", F.coalesce(F.col("alias") == F.col("original_value"), F.lit(False))).withColumn("n_itself", F.count_if("itself").over(Window.partitionBy("g")))
    beside = F.row_number().over(Window.partitionBy("g", "itself").orderBy("original_value")) == 1
    partner = ~F.col("itself") & (F.col("n_itself") == 1) & F.col("spare").isNull() & beside
    d = d.withColumn("moves", F.col("itself") | partner)
    ring = Window.partitionBy("g", "moves").orderBy("original_value")
    following = F.coalesce(F.lead("alias").over(ring), F.first("alias").over(ring))
    d = d.withColumn("new", F.when(~F.col("moves"), F.col("alias")).otherwise(F.coalesce(F.when(F.col("n_itself") == 1, F.col("spare")), following)))
    alias = F.when(~F.col("new").eqNullSafe(F.col("original_value")), F.col("new"))
    d = d.select(*cols, alias.alias("alias"), (~F.col("keeps") | F.col("moves")).cast("int").alias("attempt"))
    return d.unionByName(crowded).withColumn("error_code", F.when(F.col("alias").isNull(), "ALIASES_EXHAUSTED"))
