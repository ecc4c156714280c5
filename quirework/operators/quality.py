"""Quality counters of chunks, their merge, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import predicates as P, text as X

COUNTERS = ("documents", "parent_chunks", "child_chunks", "assets", "references", "noise_blocks", "furniture_blocks", "reference_blocks", "empty_parent_chunks", "empty_child_chunks", "oversize_parent_chunks", "oversize_child_chunks", "hard_limit_child_chunks", "mojibake_warnings")
BLOCKERS = ("empty_parent_chunks", "empty_child_chunks", "oversize_parent_chunks", "oversize_child_chunks", "hard_limit_child_chunks", "mojibake_warnings")


def child_stats(children: DataFrame, most: int) -> DataFrame:
    n = lambda c: F.count_if(c)
    return children.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("child_chunks"), n(X.strip("text") == "").alias("empty_child_chunks"), n(X.estimated_tokens("text") > most).alias("oversize_child_chunks"),
        n(F.col("split_reason") == "hard_limit").alias("hard_limit_child_chunks"), n(P.is_mojibake("text")).alias("mojibake_warnings"),
    )


def parent_stats(parents: DataFrame, most: int) -> DataFrame:
    return parents.groupBy("doc_id").agg(F.count(F.lit(1)).alias("parent_chunks"), F.count_if(X.strip("text") == "").alias("empty_parent_chunks"), F.count_if(X.estimated_tokens("text") > most).alias("oversize_parent_chunks"))


def role_counts(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("doc_id", F.coalesce("role", F.lit("body")).alias("role")).agg(F.count(F.lit(1)).alias("n"))


def counts_of(keys: DataFrame, rows: DataFrame, key: str, name: str) -> DataFrame:
    """The number of rows for each key, 0 without any; rows without a key don't count."""
    n = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(name))
    return keys.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def document_stats(documents: DataFrame, parents: DataFrame, children: DataFrame, assets: DataFrame, blocks: DataFrame, parent_most: int = 1800, child_most: int = 500) -> DataFrame:
    """All counters of each document."""
    roles = blocks.groupBy("doc_id").agg(*(F.count_if(F.col("role") == r).alias(f"{r}_blocks") for r in ("noise", "furniture", "reference")))
    out = documents.select("doc_id", F.lit(1).cast("long").alias("documents"))
    for part in (parent_stats(parents, parent_most), child_stats(children, child_most), counts_of(documents.select("doc_id"), assets, "doc_id", "assets"), roles):
        out = out.join(part, "doc_id", "left")
    return out.select("doc_id", *((F.coalesce(c, F.lit(0)) if c in out.columns else F.lit(0)).cast("long").alias(c) for c in COUNTERS))


def merged(stats: DataFrame, counters: tuple[str, ...] = COUNTERS) -> DataFrame:
    """The sums of counters over documents: one row."""
    return stats.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in counters))


def blocked(stats: DataFrame) -> DataFrame:
    return stats.where(P.has_quality_blockers(*map(F.col, BLOCKERS)))


def mojibake_warnings(children: DataFrame, per_document: int = 20, most: int = 50) -> DataFrame:
    """The first warnings of each document, and of these the first of the batch."""
    from pyspark.sql import Window

    bad = children.where(P.is_mojibake("text")).select("doc_id", "parent_index", "child_index", F.concat(F.lit("Possible mojibake in "), "title", F.lit(" / "), "section_path").alias("warning"))
    by = Window.partitionBy("doc_id").orderBy("parent_index", "child_index")
    some = bad.withColumn("n", F.row_number().over(by)).where(F.col("n") <= per_document)
    return some.orderBy("doc_id", "n").limit(most).select("doc_id", "warning")


def report(counters: dict, statuses: dict[str, int], warnings: list[str]) -> str:
    """A batch's text report."""
    lines = ["Files: " + ", ".join(f"{k} {v}" for k, v in sorted(statuses.items())) if statuses else "Files: none"]
    lines += [f"{name.replace('_', ' ').capitalize()}: {counters.get(name, 0)}" for name in COUNTERS]
    return "\n".join(lines + [f"Warning: {w}" for w in warnings])
