"""Checks of packages: unsafe parts, kinds, totals, relationships."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_ENTRIES, MAX_TOTAL, MAX_ENTRY, MAX_RATIO = 10_000, 1 << 30, 256 << 20, 100


def unsafe_parts(parts: DataFrame) -> DataFrame:
    """Entries with an unsafe path, encryption, a link, or a size or ratio over the limits (FLT14)."""
    n = F.col("name")
    path = (n == "") | n.rlike("^/|^[A-Za-z]:|\\\\|\\x00") | F.arrays_overlap(F.split(n, "/"), F.array(F.lit(".."), F.lit(".")))
    reason = (
        F.when(path, "path")
        .when(F.col("flags").bitwiseAND(1) != 0, "encrypted")
        .when(F.shiftright("mode", 12).bitwiseAND(15) == 10, "symlink")
        .when(F.col("size") > MAX_ENTRY, "entry-size")
        .when((F.col("size") > 0) & (F.col("compressed_size") * MAX_RATIO < F.col("size")), "ratio")
    )
    return parts.withColumn("reason", reason).filter("reason is not null").select("doc_id", "name", "reason")


def package_kind(parts: DataFrame) -> DataFrame:
    """doc_id and error_code by the names of its parts: incomplete, macro-enabled or signed packages (FLT15)."""
    has = lambda c: F.bool_or(c)
    n = F.lower("name")
    d = parts.groupBy("doc_id").agg(has(n == "word/document.xml").alias("main"), has(n == "[content_types].xml").alias("types"), has(n.rlike("vbaproject\\.bin\\z|vbadata\\.xml\\z")).alias("macro"), has(n.startswith("_xmlsignatures/")).alias("signed"))
    code = F.when(~F.col("main") | ~F.col("types"), "INVALID_DOCUMENT").when(F.col("macro"), "MACRO_ENABLED").when(F.col("signed"), "SIGNED_DOCUMENT")
    return d.select("doc_id", code.alias("error_code"))


def archive_totals(parts: DataFrame, size: Column | None = None) -> DataFrame:
    """Entries, bytes and repeated names per archive, with whether it is within the limits (AG10)."""
    size = F.col("size") if size is None else size
    d = parts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("entries"), F.sum(size).alias("total"), F.count_distinct("name").alias("names"))
    return d.withColumn("ok", (F.col("entries") <= MAX_ENTRIES) & (F.col("total") <= MAX_TOTAL) & (F.col("entries") == F.col("names"))).drop("names")


def resolved_target(source_part: Column, target: Column) -> Column:
    """Package path of a relationship target: absolute, or relative to the source part's folder; null if it is unsafe.

    Query and fragment are cut, percent escapes decoded once. Unsafe are escaped dots and slashes, escapes within escapes or
    broken ones, backslashes, zero characters, schemes, steps above the root and empty paths.
    """
    path = F.regexp_extract(target, "^[^?#]*", 0)
    # a plus sign is a plus sign in a path; broken escapes and bytes that are no UTF-8 give null
    decoded = F.when(path.contains("%"), F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))).otherwise(path)
    bad = path.rlike("(?i)%(2e|2f|5c)") | decoded.rlike("(?i)%[0-9a-f]{2}|[\\\\\\x00\\uFFFD]|^[A-Za-z][A-Za-z0-9+.-]*:")
    folder = F.filter(F.split(F.regexp_replace(source_part, "[^/]*\\z", ""), "/"), lambda x: ~x.isin("", "."))
    start = F.when(decoded.startswith("/"), F.array().cast("array<string>")).otherwise(folder)
    steps = F.filter(F.split(decoded, "/"), lambda x: ~x.isin("", "."))
    # a null array stands for a step above the root and stays one
    up = lambda a, x: F.when(x != "..", F.concat(a, F.array(x))).when(F.size(a) > 0, F.slice(a, 1, F.size(a) - 1))
    found = F.aggregate(steps, start, up)
    return F.when((path != "") & ~bad & (F.size(found) > 0), F.array_join(found, "/"))


def relationship_audit(rels: DataFrame, parts: DataFrame) -> DataFrame:
    """Per document: relationships whose source is no part, whose internal target is none or unsafe, and external ones (JN11).

    `rels(doc_id, source_part, target, external)`; the source part "" is the package itself.
    """
    names = parts.select("doc_id", F.col("name").alias("_name")).distinct()
    s = names.select(F.col("doc_id"), F.col("_name").alias("source_part"), F.lit(1).alias("_s"))
    t = names.select(F.col("doc_id"), F.col("_name").alias("path"), F.lit(1).alias("_t"))
    d = rels.withColumn("path", resolved_target(F.col("source_part"), F.col("target"))).join(s, ["doc_id", "source_part"], "left").join(t, ["doc_id", "path"], "left")
    no_source = F.col("source_part").isNull() | ((F.col("source_part") != "") & F.col("_s").isNull())
    unsafe = ~F.col("external") & F.col("path").isNull()
    no_target = ~F.col("external") & F.col("_t").isNull()
    return d.groupBy("doc_id").agg(F.count_if(no_source).alias("no_source"), F.count_if(no_target).alias("no_target"), F.count_if("external").alias("external"), F.count_if(unsafe).alias("unsafe"))


#: Fixed value: the content type of a document without macros.
MAIN_TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"


def inspect_packages(parts: DataFrame, types: DataFrame, rels: DataFrame) -> DataFrame:
    """doc_id, error_code, external: the first reason to refuse a package, or none (FLT15, JN11).

    `types` and `rels` are the readers' tables. In this order: a needed part is missing or its table unreadable; the main part's type is
    another, or a type or part is of macros; a part or type is of signatures; the package does not name exactly one main part;
    then, by relationship parts in archive order: a part without its source or unreadable, a signed relationship, a target that is no part.
    """
    has = lambda c, name: F.bool_or(F.coalesce(c, F.lit(False))).alias(name)
    n = F.col("name")
    named = parts.groupBy("doc_id").agg(
        *[has(n == x, a) for x, a in (("[Content_Types].xml", "types"), ("_rels/.rels", "root"), ("word/document.xml", "main"))], has(n.rlike("(?i)(^|/)vbaProject\\.bin\\z"), "macro_part"), has(F.lower(n).startswith("_xmlsignatures/"), "signed_part")
    )
    over = F.col("kind") == "override"
    kind = F.lower("content_type")
    main = F.min_by(F.when(over & (F.col("key") == "/word/document.xml"), F.col("content_type")), F.when(over & (F.col("key") == "/word/document.xml"), F.lit(1)))
    typed = types.groupBy("doc_id").agg(has(F.col("error_code").isNotNull(), "bad_types"), main.alias("main_type"), has(over & kind.contains("macroenabled"), "macro_type"), has(over & kind.contains("digital-signature"), "signed_type"))
    entries = parts.filter("not coalesce(is_dir, false)").select("doc_id", F.col("name").alias("_name")).distinct()
    place = parts.groupBy("doc_id", F.col("name").alias("rels_part")).agg(F.min("ord").alias("place"))
    r = rels.withColumn("row_no", F.monotonically_increasing_id()).withColumn("path", resolved_target(F.col("source_part"), F.col("target")))
    r = r.join(place, ["doc_id", "rels_part"]).join(entries.select("doc_id", F.col("_name").alias("source_part"), F.lit(1).alias("_s")), ["doc_id", "source_part"], "left")
    r = r.join(entries.select("doc_id", F.col("_name").alias("path"), F.lit(1).alias("_t")), ["doc_id", "path"], "left")
    is_main = F.col("is_row") & (F.col("rels_part") == "_rels/.rels") & F.col("type").endswith("/officeDocument")
    fault = (
        F.when(F.col("source_part").isNull() | ((F.col("source_part") != "") & F.col("_s").isNull()) | F.col("error_code").isNotNull(), "INVALID_DOCUMENT")
        .when(F.lower("type").contains("/digital-signature/"), "SIGNED_DOCUMENT")
        .when(F.col("is_row") & ~F.col("external") & F.col("_t").isNull(), "INVALID_DOCUMENT")
    )
    r = r.withColumn("fault", fault)
    linked = r.groupBy("doc_id").agg(
        has((F.col("rels_part") == "_rels/.rels") & F.col("error_code").isNotNull(), "bad_root"),
        F.count_if(is_main).alias("mains"),
        F.count_if(is_main & ~F.col("external") & (F.regexp_replace("target", "^/", "") == "word/document.xml")).alias("good_mains"),
        F.min_by("fault", F.when(F.col("fault").isNotNull(), F.struct("place", "row_no"))).alias("fault"),
        F.count_if("external").alias("external"),
    )
    d = named.join(typed, "doc_id", "left").join(linked, "doc_id", "left")
    code = (
        F.when(~(F.col("types") & F.col("root") & F.col("main")) | F.coalesce("bad_types", F.lit(False)), "INVALID_DOCUMENT")
        .when(~F.col("main_type").eqNullSafe(F.lit(MAIN_TYPE)) | F.coalesce("macro_type", F.lit(False)) | F.col("macro_part"), "UNSUPPORTED_TYPE")
        .when(F.col("signed_part") | F.coalesce("signed_type", F.lit(False)), "SIGNED_DOCUMENT")
        .when(F.coalesce("bad_root", F.lit(False)) | (F.coalesce("mains", F.lit(0)) != 1) | (F.coalesce("good_mains", F.lit(0)) != 1), "INVALID_DOCUMENT")
        .otherwise(F.col("fault"))
    )
    return d.select("doc_id", code.alias("error_code"), F.coalesce("external", F.lit(0)).cast("long").alias("external"))
