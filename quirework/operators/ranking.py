"""Fusion, reranking, expansion to parents, citations and ranking metrics over tables of hits.

Hits are rows (query_id, rank from 0, ...); ranks are explicit, so that no operator relies on row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

RRF_K = 60


def fuse(*lists: DataFrame, key: str = "doc_key", k: int = RRF_K) -> DataFrame:
    """query_id, key, rrf_score, score, methods, first (list and rank of the first sight), rank: reciprocal rank fusion.

    Hits are (query_id, key, rank, score, method). Hits of one key add up, also within a list; the first seen
    gives the score; ties keep the order of first sight.
    """
    every = None
    for n, hits in enumerate(lists):
        part = hits.select("query_id", key, "rank", "score", "method", F.lit(n).alias("list"))
        every = part if every is None else every.unionByName(part)
    seen = F.struct("list", "rank")
    fused = every.groupBy("query_id", key).agg(
        F.sum(1 / (k + F.col("rank") + 1)).alias("rrf_score"), F.min_by("score", seen).alias("score"), F.min(seen).alias("first"), F.array_sort(F.collect_set("method")).alias("methods")
    )
    return ranked(fused, F.desc(F.round("rrf_score", 12)), "first")


def ranked(hits: DataFrame, *order) -> DataFrame:
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)) - 1)


def hybrid(dense: DataFrame, lexical: DataFrame, key: str = "doc_key", k: int = RRF_K) -> DataFrame:
    """Fusion where both lists of a query have hits, else the list that has, as it is."""
    columns = ("query_id", key, "rank", "score", "method")
    every = dense.select(*columns, F.lit(0).alias("list")).unionByName(lexical.select(*columns, F.lit(1).alias("list")))
    of_query = Window.partitionBy("query_id")
    every = every.withColumn("both", F.min("list").over(of_query) != F.max("list").over(of_query))
    seen = F.struct("list", "rank")
    # a hit of a single list stays a group of its own
    fused = every.groupBy("query_id", key, "both", F.when(~F.col("both"), F.col("rank")).alias("own")).agg(
        F.sum(1 / (k + F.col("rank") + 1)).alias("rrf"), F.min_by("score", seen).alias("score"), F.min(seen).alias("first"), F.array_sort(F.collect_set("method")).alias("methods")
    )
    fused = fused.withColumn("rrf_score", F.when(F.col("both"), F.col("rrf"))).drop("rrf", "own", "both")
    return ranked(fused, F.desc(F.round("rrf_score", 12)), "first")


def rerank(hits: DataFrame, scorer: Column, top: int) -> DataFrame:
    """Hits by a new score, the old one kept as original_score."""
    scored = hits.withColumn("original_score", F.col("score")).withColumn("score", scorer)
    return ranked(scored.drop("rank"), F.desc("score"), "first" if "first" in hits.columns else "original_score").where(F.col("rank") < top)


def overlap_scorer(query: Column, text: Column) -> Column:
    """A deterministic stand-in for a reranking model: the share of query tokens that the text has."""
    from ..functions.text import overlap

    return overlap(query, text)


def expand(children: DataFrame, parents: DataFrame, top: int = 6) -> DataFrame:
    """query_id, parent_id, score (the best child's), first_rank, child_ids, citation_id, rank and the parents' columns.

    Parents come in the order of their first child; children of unknown parents go. Children are (query_id,
    rank, child_id, parent_id, score).
    """
    best = children.groupBy("query_id", "parent_id").agg(F.max("score").alias("score"), F.min("rank").alias("first_rank"), F.array_sort(F.collect_set("child_id")).alias("child_ids"))
    known = best.join(parents, "parent_id")
    out = ranked(known, "first_rank", "parent_id").where(F.col("rank") < top)
    return out.withColumn("citation_id", F.concat(F.lit("S"), (F.col("rank") + 1).cast("string")))


def with_assets(hits: DataFrame, assets: DataFrame, key: str = "parent_id", order: str = "asset_index") -> DataFrame:
    """Hits with the array of their assets, in order; empty if there are none."""
    fields = [c for c in assets.columns if c not in (key, order)]
    lists = assets.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *fields))).alias("assets"))
    out = hits.join(lists, key, "left")
    return out.withColumn("assets", F.coalesce("assets", F.array().cast(lists.schema["assets"].dataType)))


def citations(hits: DataFrame) -> DataFrame:
    """query_id, citation_id, title, page, section, source_path: numbered by position unless given; hits without a parent are left out but counted."""
    from ..functions.text import page_label

    number = F.concat(F.lit("S"), (F.col("rank") + 1).cast("string"))
    given = F.coalesce("citation_id", number) if "citation_id" in hits.columns else number
    return hits.where(F.col("parent_id").isNotNull()).select("query_id", given.alias("citation_id"), "title", page_label(F.col("page_start"), F.col("page_end")).alias("page"), F.col("section_path").alias("section"), "source_path")


def metrics(hits: DataFrame, grades: DataFrame, key: str = "doc_key", cuts: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """One row for each query: recall, any_hit, precision and graded NDCG at each cut, mrr at the last, average precision.

    grades: query_id, key, grade (2 gold, 1 support, 0 none); a query without graded documents isn't listed.
    """
    good = grades.where("grade > 0")
    ideal = good.withColumn("at", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), key)) - 1)
    gain = lambda at: F.col("grade") / F.log2(at + 2)
    wanted = ideal.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_good"), F.sum(F.when(F.col("grade") >= 2, 1).otherwise(0)).alias("n_gold"), *(F.sum(F.when(F.col("at") < c, gain(F.col("at"))).otherwise(0.0)).alias(f"ideal_{c}") for c in cuts)
    )
    found = hits.select("query_id", key, "rank").join(good, ["query_id", key])
    found = found.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    at = F.col("rank")
    got = found.groupBy("query_id").agg(
        F.min("rank").alias("first"),
        F.sum(F.col("nth") / (at + 1)).alias("ap"),
        *(F.sum(F.when(at < c, 1).otherwise(0)).alias(f"hits_{c}") for c in cuts),
        *(F.sum(F.when((at < c) & (F.col("grade") >= 2), 1).otherwise(0)).alias(f"gold_{c}") for c in cuts),
        *(F.sum(F.when(at < c, gain(at)).otherwise(0.0)).alias(f"dcg_{c}") for c in cuts),
    )
    row, zero = wanted.join(got, "query_id", "left"), F.lit(0.0)
    out = [F.col("query_id")]
    for c in cuts:
        hit = F.coalesce(f"hits_{c}", F.lit(0))
        out += [
            (hit / F.col("n_good")).alias(f"recall_{c}"),
            F.when(F.col("n_gold") > 0, F.coalesce(f"gold_{c}", F.lit(0)) / F.col("n_gold")).alias(f"gold_recall_{c}"),
            F.when(hit > 0, 1.0).otherwise(0.0).alias(f"any_hit_{c}"),
            (hit / c).alias(f"precision_{c}"),
            (F.coalesce(f"dcg_{c}", zero) / F.col(f"ideal_{c}")).alias(f"ndcg_{c}"),
        ]
    out += [F.when(F.col("first") < cuts[-1], 1 / (F.col("first") + 1)).otherwise(0.0).alias("mrr"), (F.coalesce("ap", zero) / F.col("n_good")).alias("average_precision")]
    return row.select(*out)
