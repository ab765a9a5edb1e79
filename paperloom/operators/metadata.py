"""Identity metadata: validity, actions, aliases, replacement, verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.folds import ordered_fold
from ..functions.keyed import hmac_sha256 as _hmac
from ..functions.keyed import number_at
from ..functions.staging import stage
from ..functions.text import digest, display_value, js_trim
from ..functions.vocab import INTEGER_BOUNDS
from .aliases import ENUMS, spaced_aliases

KEY = ["doc_id", "part", "locator"]
UUID4 = "^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\\z"


def value_valid(value: Column, value_type: Column) -> Column:
    """Type check of a metadata value; other types are always valid (FLT10)."""
    v = js_trim(value)
    number = v.rlike("^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\z")
    return (
        F.when(value_type == "integer", v.rlike("^-?\\d+\\z"))
        .when(value_type == "number", number)
        .when(value_type == "boolean", v.rlike("(?i)^(true|false|0|1)\\z"))
        .when(value_type == "timestamp", F.try_to_timestamp(value).isNotNull())
        .otherwise(F.lit(True))
    )


def custom_integer_valid(value: Column, name: Column) -> Column:
    """Within the bounds of a custom integer type; wider than 64 bits, so decimals (FLT10)."""
    bound = lambda i: F.create_map(*[F.lit(x) for k, b in INTEGER_BOUNDS.items() for x in (k, str(b[i]))])[name].cast("decimal(20,0)")
    v = js_trim(value)
    n = v.try_cast("decimal(20,0)")
    return F.coalesce(v.rlike("^-?\\d+\\z") & (n >= bound(0)) & (n <= bound(1)), F.lit(False))


def assign_action(occurrences: DataFrame, specs: DataFrame) -> DataFrame:
    """Action of each occurrence by its field; invalid values are downgraded to warn, with a warning (FLT11).

    `specs(field, spec_action)`; fields without a spec are preserved.
    """
    d = occurrences.drop("spec_action").join(specs.select("field", "spec_action"), "field", "left")  # Spark broadcasts it if it is small
    bad = (F.col("spec_action") == "randomize") & ~value_valid(F.col("original_value"), F.col("value_type"))
    action = F.when(bad, "warn").otherwise(F.coalesce("spec_action", F.lit("preserve")))
    return d.withColumn("action", action).withColumn("warning", F.when(bad, F.concat_ws(": ", "part", "field"))).drop("spec_action")


def field_descriptors(occ: DataFrame) -> DataFrame:
    """Occurrences by field, category, type and action per document (AG1)."""
    return occ.groupBy("doc_id", "field", "category", "value_type", "action").agg(F.count(F.lit(1)).alias("occurrences"))


def action_counts(fields: DataFrame) -> DataFrame:
    """Occurrences by action per document, total and changed (AG2)."""
    of = lambda a: F.coalesce(F.sum(F.when(F.col("action") == a, F.col("occurrences"))), F.lit(0))
    return fields.groupBy("doc_id").agg(of("randomize").alias("randomize"), of("preserve").alias("preserve"), of("warn").alias("warn"), F.sum("occurrences").alias("total"))


#: Milliseconds that an alias of a timestamp may lie back.
YEAR = 365 * 86_400_000


def _shape(kind: Column, h: Column, original: Column, now: int) -> Column:
    up = lambda n: F.upper(F.substring(h, 1, n))
    variant = F.element_at(F.array(*[F.lit(x) for x in "89ab"]), (number_at(h, 20, 1) % 4 + 1).cast("int"))
    uuid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("4"), F.substring(h, 13, 3)), F.concat(variant, F.substring(h, 17, 3)), F.substring(h, 21, 12))
    bounds = F.split(kind, ":")  # integer, or integer:lowest:highest
    lo = F.coalesce(F.get(bounds, F.lit(1)).try_cast("long"), F.lit(1))
    hi = F.coalesce(F.get(bounds, F.lit(2)).try_cast("long"), F.lit(2147483646))
    n = lo + number_at(h, 1) % (hi - lo + 1)
    same = n.cast("string") == js_trim(original)
    n = F.when(~same, n).when(n == hi, lo).otherwise(n + 1)
    past = F.lit(now * 1000) - number_at(h, 1, 12) % (YEAR + 1)  # written without the session's time zone
    part = lambda unit, of: (F.floor(past / F.lit(unit)) % of).cast("int")
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(past / F.lit(86_400_000)).cast("int")).cast("string")
    time = F.format_string("%sT%02d:%02d:%02d.%03dZ", day, part(3_600_000, 24), part(60_000, 60), part(1000, 60), part(1, 1000))
    return (
        F.when(kind == "person", F.concat(F.lit("User-"), up(12)))
        .when(kind == "organization", F.concat(F.lit("Org-"), up(12)))
        .when(kind == "application", F.concat(F.lit("App-"), up(12)))
        .when(kind == "uuid", uuid)
        .when(kind.rlike("^integer(:|\\z)"), n.cast("string"))
        .when(kind == "number", (n.cast("double") / 1000).cast("string"))
        .when(kind == "boolean", F.when(F.lower(js_trim(original)).isin("true", "1"), "false").otherwise("true"))
        .when(kind == "timestamp", time)
        .otherwise(F.concat(F.lit("Document-"), up(16)))
    )


#: Kinds whose aliases must differ between originals; those of the first list are so many that they hardly collide.
_BY_HMAC = ["person", "organization", "application", "description", "uuid", "timestamp"]
DISTINCT_KINDS = [*_BY_HMAC, "initials"]


def aliases(occ: DataFrame, salt: bytes, now: int, scope: list[str] | None = None, max_attempts: int = 100, enums: dict[str, list[str]] | None = None) -> DataFrame:
    """One alias per (scope, kind, original): distinct within scope and kind, never the original.

    Aliases are made from an HMAC of the key, so they are stable for a salt and no state is shared. Only keys that collide are
    made again, with the next attempt number, and a round joins only the aliases that were made in it;
    the loop ends when none collided. Kinds with few aliases, initials and those of `enums` (kind: values), collide too
    often for that: they come from `spaced_aliases`, where the ones that no alias is left for get an error_code.
    An integer kind may carry its bounds (`integer:-128:127`). `now` is in epoch seconds.
    """
    scope = scope or ["doc_id"]
    enums = ENUMS if enums is None else enums
    key = [*scope, "kind", "original_value"]
    cols = [*key, "alias", "attempt", "error_code"]
    d = occ.filter("action = 'randomize'").select(*scope, F.col("replacement_kind").alias("kind"), "original_value").distinct().withColumn("attempt", F.lit(0))
    few = F.coalesce(F.col("kind").isin("initials", *enums), F.lit(False))
    keys = stage(d.filter(few).drop("attempt"), "keys")
    spaced = None if keys.isEmpty() else spaced_aliases(keys, salt, scope, enums).select(*cols)
    d = d.filter(~few)

    def made(x: DataFrame) -> DataFrame:
        message = F.concat_ws("\0", "kind", F.lit("string"), "original_value", F.concat_ws("|", *scope), F.col("attempt").cast("string"))
        return x.withColumn("alias", _shape(F.col("kind"), _hmac(salt, message), F.col("original_value"), now))

    holder = [*scope, "kind", "alias"]
    kept, new = None, stage(made(d), "aliases")
    for _ in range(max_attempts):
        first = F.row_number().over(Window.partitionBy(*holder).orderBy("original_value")) == 1
        own = F.col("alias").eqNullSafe(F.col("original_value"))
        marked = new.withColumn("fresh", ~F.col("kind").isin(*_BY_HMAC) | first & ~own)
        if kept is not None:  # what was settled in an earlier round keeps its alias
            taken = kept.filter(F.col("kind").isin(*_BY_HMAC)).select(*holder, F.lit(True).alias("taken"))
            marked = marked.join(taken, holder, "left").withColumn("fresh", F.col("fresh") & F.col("taken").isNull()).drop("taken")
        marked = stage(marked, "marked")
        settled = marked.filter("fresh").drop("fresh")
        kept = settled if kept is None else kept.unionByName(settled)
        again = marked.filter("not fresh").drop("fresh", "alias").withColumn("attempt", F.col("attempt") + 1)
        if again.isEmpty():
            kept = kept.withColumn("error_code", F.lit(None).cast("string")).select(*cols)
            return kept if spaced is None else kept.unionByName(spaced)
        new = stage(made(again), "aliases")
    raise RuntimeError("aliases did not become distinct")


def plan_replacements(occ: DataFrame, alias: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """replacements(doc_id, part, locator, value) of randomised occurrences; none where no alias was left, which `apply_replacements` reports."""
    scope = scope or ["doc_id"]
    d = occ.filter("action = 'randomize'").withColumnRenamed("replacement_kind", "kind")
    return d.join(alias.filter("alias is not null").drop("error_code"), [*scope, "kind", "original_value"]).select(*KEY, F.col("alias").alias("value"))


def apply_replacements(occ: DataFrame, replacements: DataFrame) -> DataFrame:
    """Planned values on randomised occurrences; without one, the error PLAN_EXPIRED (JN12)."""
    d = occ.join(replacements.select(*KEY, F.col("value").alias("_value")), KEY, "left")
    change = F.col("action") == "randomize"
    return d.withColumn("new_value", F.when(change, F.col("_value")).otherwise(F.col("original_value"))).withColumn("error_code", F.when(change & F.col("_value").isNull(), "PLAN_EXPIRED")).drop("_value")


def preview_items(occ: DataFrame, replacements: DataFrame) -> DataFrame:
    """Original and replacement as shown to the user (FLT13)."""
    d = occ.join(replacements, KEY, "left")
    return d.select(*KEY, "field", "action", display_value(F.col("original_value")).alias("original"), F.when(F.col("action") == "randomize", display_value(F.coalesce("value", F.lit("")))).alias("replacement"))


def randomized_valid(value: Column, value_type: Column, now: Column) -> Column:
    """A legal output value: not empty, typed, not in the future, a version 4 uuid (FLT12)."""
    v = js_trim(value)
    typed = (
        F.when(value_type == "integer", v.rlike("^-?\\d+\\z"))
        .when(value_type == "number", v.rlike("^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\z"))
        .when(value_type == "boolean", v.rlike("^(true|false)\\z"))
        .when(value_type == "timestamp", F.coalesce(F.try_to_timestamp(v) <= now, F.lit(False)))
        .when(value_type == "uuid", v.rlike(UUID4))
        .otherwise(F.lit(True))
    )
    return (v != "") & typed


def occurrence_diff(source: DataFrame, output: DataFrame, replacements: DataFrame, now: Column) -> DataFrame:
    """Rows that break the metadata rules, with the reason (JN8): a full outer join on the key."""
    s = source.select(*KEY, F.col("action").alias("s_action"), F.col("original_value").alias("s_value"), F.lit(1).alias("in_source"))
    o = output.select(*KEY, F.col("action").alias("o_action"), F.col("original_value").alias("o_value"), "value_type", F.lit(1).alias("in_output"))
    d = s.join(o, KEY, "full").join(replacements.select(*KEY, F.col("value").alias("expected")), KEY, "left")
    change = F.col("s_action") == "randomize"
    reason = (
        F.when(F.col("in_output").isNull(), "missing")
        .when(F.col("in_source").isNull(), "added")
        .when(F.col("s_action") != F.col("o_action"), "action")
        .when(change & (F.col("s_value") == F.col("o_value")), "unchanged")
        .when(change & ~F.coalesce(randomized_valid(F.col("o_value"), F.col("value_type"), now), F.lit(False)), "illegal")
        .when(change & ~F.col("expected").eqNullSafe(F.col("o_value")), "not-planned")
        .when(~change & ~F.col("s_value").eqNullSafe(F.col("o_value")), "changed")
    )
    return d.withColumn("reason", reason).filter("reason is not null").select(*KEY, "reason")


def identity_bijection(source: DataFrame, output: DataFrame, kinds: tuple = ("person", "initials", "organization")) -> DataFrame:
    """Per document: originals with several aliases and aliases with several originals (AG13)."""
    o = output.select(*KEY, F.col("original_value").alias("alias"))
    d = source.filter((F.col("action") == "randomize") & F.col("replacement_kind").isin(*kinds)).join(o, KEY)
    wide = lambda k, v: d.groupBy("doc_id", "replacement_kind", k).agg(F.count_distinct(v).alias("n")).groupBy("doc_id").agg(F.count_if(F.col("n") > 1).alias("bad"))
    a = wide("original_value", "alias").withColumnRenamed("bad", "split_originals")
    b = wide("alias", "original_value").withColumnRenamed("bad", "shared_aliases")
    return a.join(b, "doc_id")


def date_consistency(occ: DataFrame) -> DataFrame:
    """Per document: one created and one modified value among randomised dates, created first (AG14). `date_role` is created or modified."""
    t = F.try_to_timestamp("original_value")
    role = lambda r: F.when(F.col("date_role") == r, t)
    d = occ.filter("action = 'randomize' and date_role is not null").groupBy("doc_id").agg(F.max(role("created")).alias("c"), F.min(role("modified")).alias("m"), F.count_distinct(role("created")).alias("nc"), F.count_distinct(role("modified")).alias("nm"))
    return d.select("doc_id", (F.coalesce(F.col("c") <= F.col("m"), F.lit(True)) & (F.col("nc") <= 1) & (F.col("nm") <= 1)).alias("passed"))


def content_diff(source: DataFrame, output: DataFrame) -> DataFrame:
    """Parts whose fingerprints differ or that stand on one side only (JN9). `contents` is hashed before the join."""
    s = source.select("doc_id", "name", F.sha2("contents", 256).alias("a"))
    o = output.select("doc_id", "name", F.sha2("contents", 256).alias("b"))
    return s.join(o, ["doc_id", "name"], "full").filter(~F.col("a").eqNullSafe(F.col("b"))).select("doc_id", "name", F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "added").otherwise("changed").alias("reason"))


def masked_content_diff(source: DataFrame, output: DataFrame, source_scan: DataFrame, output_scan: DataFrame) -> DataFrame:
    """Parts that differ beyond their identity metadata, or stand on one side only (JN9): doc_id, name, reason.

    Parts of the source with a value to randomise are compared by the hash of their masked form, all others byte by byte.
    A masked part that cannot be read on either side is `invalid`. Parts are hashed before the join.
    """

    def side(parts: DataFrame, scan: DataFrame, p: str) -> DataFrame:
        plan = F.exists("occurrences", lambda x: x["action"] == "randomize")
        masks = scan.select("doc_id", F.col("part").alias("name"), F.col("masked_sha256").alias(p + "mask"), plan.alias(p + "plan"), F.col("error_code").isNotNull().alias(p + "bad"))
        return parts.select("doc_id", "name", F.sha2("contents", 256).alias(p + "raw")).join(masks, ["doc_id", "name"], "left")

    d = side(source, source_scan, "s_").join(side(output, output_scan, "o_"), ["doc_id", "name"], "full")
    masked = F.coalesce("s_plan", F.lit(False))
    reason = (
        F.when(F.col("o_raw").isNull(), "missing")
        .when(F.col("s_raw").isNull(), "added")
        .when(F.coalesce("s_bad", F.lit(False)) | (masked & F.coalesce("o_bad", F.lit(False))), "invalid")
        .when(F.when(masked, F.col("s_mask") != F.col("o_mask")).otherwise(F.col("s_raw") != F.col("o_raw")), "changed")
    )
    return d.withColumn("reason", reason).filter("reason is not null").select("doc_id", "name", "reason")


def structure_diff(source: DataFrame, output: DataFrame) -> DataFrame:
    """Grouped fingerprints (number of parts, names, sizes) that differ between two versions (JN10)."""
    f = lambda d, p: d.groupBy("doc_id").agg(F.count(F.lit(1)).alias(p + "n"), digest(F.array_join(F.sort_array(F.collect_list("name")), "|")).alias(p + "names"), F.sum(F.length("contents")).alias(p + "size"))
    d = f(source, "s_").join(f(output, "o_"), "doc_id", "full")
    same = lambda c: F.col("s_" + c).eqNullSafe(F.col("o_" + c))
    return d.select("doc_id", same("n").alias("same_count"), same("names").alias("same_names"), same("size").alias("same_size")).filter("not (same_count and same_names and same_size)")


def package_structure(source: DataFrame, output: DataFrame) -> DataFrame:
    """Part names equal in content and order (SET3)."""
    names = lambda d, c: d.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]).alias(c))
    d = names(source, "s").join(names(output, "o"), "doc_id", "full")
    return d.select("doc_id", F.col("s").eqNullSafe(F.col("o")).alias("passed"))


def verification_status(checks: DataFrame) -> DataFrame:
    """A file passes if all its checks did (AG11)."""
    return checks.groupBy("task_id", "doc_id").agg(F.bool_and(F.col("status") == "passed").alias("passed"))


def verification_rollup(files: DataFrame) -> DataFrame:
    """Task hash over its files' hashes in order, and status (AG12). `files(task_id, ord, sha256, passed)`."""
    whole = ordered_fold(files, ["task_id"], ["ord"], F.col("sha256"), "sha256", separator=":", digest=("", "")).select("task_id", "sha256")
    return whole.join(files.groupBy("task_id").agg(F.bool_and("passed").alias("passed")), "task_id")


def flattened_checks(checks: DataFrame) -> DataFrame:
    """Checks of a task's files with a file prefix of 200 characters at most (AG12). `checks(task_id, file_ord, ord, name, status)`, file_ord from 1."""
    return checks.select("task_id", "file_ord", "ord", F.substring(F.concat(F.lit("file-"), "file_ord", F.lit(":"), "name"), 1, 200).alias("name"), "status")
