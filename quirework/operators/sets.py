"""Unions, keyed merges and memory of the assistant, over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def first_wins(rows: DataFrame, key: Column, *order) -> DataFrame:
    """The first row of each key."""
    by = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n")


def source_key(url: Column, source: Column, title: Column, content: Column) -> Column:
    """What makes two results the same: the url, else source, title and 80 characters of the content."""
    rest = F.concat_ws(":", F.coalesce(source, F.lit("")), F.coalesce(title, F.lit("")), F.substring(F.coalesce(content, F.lit("")), 1, 80))
    return F.when(F.coalesce(url, F.lit("")) != "", url).otherwise(rest)


def merged_sources(*results: DataFrame) -> DataFrame:
    """Results (source, query_no, rank, title, url, content) of all sources; of equal ones the first by source order, query and rank."""
    every = None
    for n, part in enumerate(results):
        part = part.withColumn("source_no", F.lit(n))
        every = part if every is None else every.unionByName(part)
    key = source_key(F.col("url"), F.col("source"), F.col("title"), F.col("content"))
    return first_wins(every, key, "source_no", "query_no", "rank")


def appended(*results: DataFrame) -> DataFrame:
    """All results, one list after the other; equal ones stay."""
    first, *rest = results
    for part in rest:
        first = first.unionByName(part)
    return first


def in_first_order(values: Column) -> Column:
    """Each value of an array once, where it stands first."""
    return F.array_distinct(values)


def merge_messages(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Messages with those of equal id replaced by the new ones."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def merge_results(old: DataFrame, new: DataFrame, key: str = "result_id", replace: bool = False) -> DataFrame:
    """Results with those that are new by id; existing ones win unless all are replaced."""
    if replace:
        return new
    return old.unionByName(new.join(old.select(key), key, "left_anti"))


def remembered(memory: DataFrame, category: Column, content: Column, created_at: Column, categories: tuple[str, ...] = ("preference", "fact", "project", "note")) -> DataFrame:
    """Memory with an item more; an unknown category becomes the first one."""
    fallback = F.when(category.isin(*categories), category).otherwise(categories[0])
    item = memory.sparkSession.range(1).select(fallback.alias("category"), content.alias("content"), created_at.alias("created_at"))
    return memory.select("category", "content", "created_at").unionByName(item)


def forgotten(memory: DataFrame, text: str, all_if_empty: bool = False) -> DataFrame:
    """Memory without the items that hold a text; an empty text removes nothing, unless asked to remove all."""
    if not text:
        return memory.limit(0) if all_if_empty else memory
    return memory.where(~F.col("content").contains(text))


def memory_summary(memory: DataFrame, per_category: int = 8, most: int = 8) -> DataFrame:
    """category, content, place of the last items of each category, and of these the last overall by (category, created_at)."""
    last = Window.partitionBy("category").orderBy(F.desc("created_at"), F.desc("content"))
    some = memory.withColumn("__n", F.row_number().over(last)).where(F.col("__n") <= per_category).drop("__n")
    ends = some.orderBy(F.desc("category"), F.desc("created_at"), F.desc("content")).limit(most)
    return ends.select("category", "content", "created_at")


def recent(messages: DataFrame, n: int, key: str = "conv_id", order: str = "turn") -> DataFrame:
    by = Window.partitionBy(key).orderBy(F.desc(order))
    return messages.withColumn("__n", F.row_number().over(by)).where(F.col("__n") <= n).drop("__n")


def to_summarize(messages: DataFrame, threshold: int = 20, keep: int = 6, done: Column | None = None, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Messages of long conversations between those that a summary has and the last ``keep``."""
    by = Window.partitionBy(key)
    at = Window.partitionBy(key).orderBy(order)
    rows = messages.withColumn("__all", F.count(F.lit(1)).over(by)).withColumn("__at", F.row_number().over(at) - 1)
    begin = F.lit(0) if done is None else F.coalesce(done, F.lit(0))
    return rows.where((F.col("__all") > threshold) & (F.col("__at") >= begin) & (F.col("__at") < F.col("__all") - keep)).drop("__all", "__at")


def new_results(messages: DataFrame, known: DataFrame) -> DataFrame:
    """Results of a conversation's trailing tool messages that aren't known yet. messages: conv_id, turn, role, result_id."""
    by = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    trailing = messages.withColumn("__others", F.sum(F.when(F.col("role") == "tool", 0).otherwise(1)).over(by)).where("__others = 0").drop("__others")
    return trailing.where(F.col("result_id").isNotNull()).join(known.select("result_id"), "result_id", "left_anti")


def latest_state(events: DataFrame, key: str, state: str, at: str) -> DataFrame:
    """The state of each key's last event."""
    return events.groupBy(key).agg(F.max_by(F.struct(state, at), F.struct(at, state)).alias("s")).select(key, F.col(f"s.{state}").alias(state), F.col(f"s.{at}").alias(at))
