"""Discovery of files to ingest: status and reason of each candidate, from a scan of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.predicates import FORMATS, matches_glob, source_format


def files(spark: SparkSession, folders: list[str], recursive: bool = True) -> DataFrame:
    """path, content_hash, size of the files in folders; only files of known formats are read, others have an empty hash."""
    path = F.regexp_replace("path", "^file:/+", "/").alias("path")

    def rows(**options):
        return spark.read.format("binaryFile").options(recursiveFileLookup=str(recursive).lower(), ignoreMissingFiles="true", **options).load(folders)

    either_case = lambda end: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in end)
    hashed = rows(pathGlobFilter="*.{" + ",".join(map(either_case, FORMATS)) + "}").select(path, F.sha2("content", 256).alias("content_hash"))
    named = rows().select(path, F.col("length").alias("size"))
    found = named.join(hashed, "path", "left")
    return found.select("path", F.when(source_format("path").isNull(), "").otherwise(F.col("content_hash")).alias("content_hash"), "size")


def any_glob(path: Column, globs: list[str]) -> Column:
    out = F.lit(False)
    for glob in globs:
        out = out | matches_glob(path, glob)
    return out


def candidates(found: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, supported: Column | None = None) -> DataFrame:
    """path, status (pending, excluded, duplicate), reason, duplicate_of, content_hash of each path.

    Only files that pass all filters are held against each other; of equal contents the first by lower-cased
    path is pending. A null hash is a missing file.
    """
    path = F.col("path")
    known = source_format(path).isNotNull() if supported is None else supported
    reason = F.when(F.col("content_hash").isNull(), "missing").when(~known, "unsupported_extension")
    if include:
        reason = reason.when(~any_glob(path, include), "not_matched_by_include")
    if exclude:
        reason = reason.when(any_glob(path, exclude), "matched_exclude_rule")
    rows = found.dropDuplicates(["path"]).withColumn("reason", reason)
    passed = F.col("reason").isNull()
    first = F.min(F.when(passed, F.struct(F.lower("path").alias("low"), F.col("path")))).over(Window.partitionBy("content_hash"))
    rows = rows.withColumn("first", first["path"])
    again = passed & (F.col("first") != path)
    return rows.select(
        "path",
        F.when(~passed, "excluded").when(again, "duplicate").otherwise("pending").alias("status"),
        F.when(again, "duplicate_content_hash").otherwise(F.coalesce("reason", F.lit(""))).alias("reason"),
        F.when(again, F.col("first")).alias("duplicate_of"),
        "content_hash",
    )


def sidecars(pdfs: DataFrame, found: DataFrame) -> DataFrame:
    """path, layout_path, tei_path of PDF files: the layout JSON and the TEI that stand beside each under its name, null if they aren't found."""
    stem = F.regexp_replace("path", r"(?i)\.pdf$", "")
    rows = pdfs.select("path", F.concat(stem, F.lit(".layout.json")).alias("__l"), F.concat(stem, F.lit(".tei.xml")).alias("__t"))
    for mine, name in (("__l", "layout_path"), ("__t", "tei_path")):
        rows = rows.join(found.select(F.col("path").alias(mine), F.col("path").alias(name)).distinct(), mine, "left")
    return rows.select("path", "layout_path", "tei_path")


def ingest_status(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """incoming (path, content_hash) with status: unchanged, duplicate (a new path of known content), changed or new."""
    old = known.select(F.col("path").alias("__p"), F.col("content_hash").alias("__h"))
    by_path = old.groupBy("__p").agg(F.first("__h").alias("__h"))
    hashes = old.select(F.col("__h").alias("__any")).distinct()
    rows = incoming.join(by_path, incoming.path == F.col("__p"), "left").join(hashes, incoming.content_hash == F.col("__any"), "left")
    status = F.when(F.col("__h") == F.col("content_hash"), "unchanged").when(F.col("__p").isNotNull(), "changed").when(F.col("__any").isNotNull(), "duplicate").otherwise("new")
    return rows.select(*incoming.columns, status.alias("status"))


def sampled_pages(total: Column, most: int) -> Column:
    """Page numbers spread evenly over a document (halves are rounded to even)."""
    if most == 1:
        return F.array(F.lit(0))
    spread = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.bround(i * (total - 1) / (most - 1)).cast("int"))
    every = F.when(total > 0, F.sequence(F.lit(0), total - 1)).otherwise(F.array().cast("array<int>"))
    return F.when(total <= most, every).otherwise(F.array_sort(F.array_distinct(spread)))


def text_layer(pages: DataFrame) -> DataFrame:
    """doc_id, sampled_pages, extracted_chars (without white space) of sampled pages."""
    dense = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s+", ""))
    return pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sampled_pages"), F.sum(dense).alias("extracted_chars"))


def ocr_decision(mode: str, extracted_chars: Column, failed: Column | None = None, least: int = 300) -> Column:
    """struct<mode, enabled, force_full_page, reason>: whether to read a document's pages by character recognition."""
    mode = (mode or "auto").strip().lower()
    if mode not in ("auto", "true", "false"):
        raise ValueError(f"unknown OCR mode: {mode}")
    if mode != "auto":
        on = F.lit(mode == "true")
        return F.struct(F.lit(mode).alias("mode"), on.alias("enabled"), on.alias("force_full_page"), F.lit("forced_on" if mode == "true" else "forced_off").alias("reason"))
    broken = F.lit(False) if failed is None else F.coalesce(failed, F.lit(False))
    scarce = F.coalesce(extracted_chars, F.lit(0)) < least
    reason = F.when(broken, "inspection_failed").when(scarce, "little_text").otherwise("text_layer")
    return F.struct(F.lit(mode).alias("mode"), (broken | scarce).alias("enabled"), F.lit(False).alias("force_full_page"), reason.alias("reason"))
