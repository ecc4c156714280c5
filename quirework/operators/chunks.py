"""Parent and child chunks and assets of documents, from their blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import predicates as P, text as X
from . import blocks as B

PARENT_MOST, PARENT_LEAST, CHILD_MOST, CHILD_OVERLAP = 1800, 300, 500, 80


def merge_plan(sections: list[dict], least: int, most: int) -> list[dict]:
    """Sections merged until no small one can be: {path, level, numbers} of each.

    A section (number, path, level, tokens, assets, body) below ``least`` tokens joins the next or else the
    previous one if one's path lies in the other's, or if it has no title, and both fit in ``most``; sections
    of assets alone never join. The first one that can be merged is, then the search begins anew.
    """
    rows = [{**s, "numbers": [s["number"]]} for s in sections]

    def alone(s: dict) -> bool:
        return s["tokens"] == 0 and s["assets"]

    def nested(a: str, b: str) -> bool:
        a, b = (a or "").strip(), (b or "").strip()
        return bool(a and b) and a != b and (b.startswith(a + " > ") or a.startswith(b + " > "))

    def partner(k: int) -> int | None:
        one = rows[k]
        if alone(one) or one["tokens"] >= least:
            return None
        loose = (one["path"] or "").strip() in ("", "Untitled")
        for j in (k + 1, k - 1):
            if 0 <= j < len(rows) and not alone(rows[j]) and (loose or nested(one["path"], rows[j]["path"])) and one["tokens"] + rows[j]["tokens"] <= most:
                return j
        return None

    def joined(a: dict, b: dict) -> dict:
        if a["body"] != b["body"]:
            name = a if a["body"] else b
        else:
            name = b if (b["path"] or "").count(" > ") < (a["path"] or "").count(" > ") else a
        return {
            "path": name["path"], "level": min(a["level"], b["level"]) or name["level"], "tokens": a["tokens"] + b["tokens"],
            "assets": a["assets"] or b["assets"], "body": a["body"] or b["body"], "numbers": a["numbers"] + b["numbers"],
        }

    while True:
        found = next(((k, j) for k in range(len(rows)) if (j := partner(k)) is not None), None)
        if found is None:
            return rows
        low, high = min(found), max(found)
        rows[low : high + 1] = [joined(rows[low], rows[high])]


def merge_small_sections(rows: DataFrame, least: int = PARENT_LEAST, most: int = PARENT_MOST) -> DataFrame:
    """Blocks with section_no, path and section_level of merged sections. The plan is made for each document from one row a section."""
    import pandas as pd

    from ..sources.formats import prepare_workers

    prepare_workers(rows.sparkSession)
    text_like = ~F.coalesce(F.col("block_type").isin(*P.ASSETS), F.lit(False)) & P.is_main_role(F.col("role"))
    body = text_like & ~F.coalesce(F.col("block_type").isin(*P.HEADINGS), F.lit(False)) & (X.strip("text") != "")
    summary = rows.groupBy("doc_id", "section_no").agg(
        F.first("path").alias("path"),
        F.first("section_level").alias("section_level"),
        F.sum(F.when(text_like, X.estimated_tokens("text")).otherwise(0)).cast("long").alias("tokens"),
        F.bool_or(F.coalesce(F.col("block_type").isin(*P.ASSETS), F.lit(False))).alias("assets"),
        F.bool_or(body).alias("body"),
    )
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def plan(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("section_no")
        given = [{"number": int(r.section_no), "path": r.path, "level": int(r.section_level), "tokens": int(r.tokens), "assets": bool(r.assets), "body": bool(r.body)} for r in part.itertuples(index=False)]
        out = [(part.doc_id.iloc[0], n, k, s["path"], s["level"]) for k, s in enumerate(merge_plan(given, least, most)) for n in s["numbers"]]
        return pd.DataFrame(out, columns=["doc_id", "section_no", "merged_no", "merged_path", "merged_level"])

    made = summary.groupBy("doc_id").applyInPandas(plan, f"doc_id {id_type}, section_no long, merged_no long, merged_path string, merged_level int")
    joined = rows.join(made, ["doc_id", "section_no"])
    return joined.withColumns({"section_no": F.col("merged_no"), "path": F.col("merged_path"), "section_level": F.col("merged_level")}).drop("merged_no", "merged_path", "merged_level")


def rendered(path, texts):
    """A section's text: its path, then its blocks' texts; headings that the path has and repeated parts go."""
    kept = F.filter(texts, lambda b: (b["text"] != "") & ~((b["block_type"] == "section_header") & path.contains(b["text"])))
    head = F.when((path != "") & (path != "Untitled"), F.array(path)).otherwise(F.array().cast("array<string>"))
    return X.strip(F.array_join(F.array_distinct(F.concat(head, F.transform(kept, lambda b: b["text"]))), "\n\n"))


def parents(blocks: DataFrame, documents: DataFrame, by_path: bool = False, most: int = PARENT_MOST, least: int = PARENT_LEAST, cleaning: bool = True) -> tuple[DataFrame, DataFrame]:
    """(parent chunks, assets) of blocks; documents: doc_id, title, source_path, source_type, file_type."""
    rows = B.sections_by_path(blocks) if by_path else B.sections(blocks)
    rows = merge_small_sections(rows, least, most)
    asset = F.coalesce(F.col("block_type").isin(*P.ASSETS), F.lit(False)) | F.coalesce(F.col("role") == "asset", F.lit(False))
    words = ~F.coalesce(F.col("block_type").isin(*P.ASSETS), F.lit(False)) & P.is_main_role(F.col("role"))
    entry = F.struct("block_ordinal", X.strip("text").alias("text"), F.coalesce("block_type", F.lit("")).alias("block_type"))
    grouped = rows.groupBy("doc_id", "section_no").agg(
        F.first("path").alias("path"),
        F.first("section_level").alias("section_level"),
        F.array_sort(F.collect_list(F.when(words, entry))).alias("texts"),
        F.bool_or(asset).alias("has_assets"),
        F.least(F.min("page_start"), F.min("page_end")).alias("page_start"),
        F.greatest(F.max("page_start"), F.max("page_end")).alias("page_end"),
        F.transform(F.array_sort(F.collect_list(F.struct("block_ordinal", "block_id"))), lambda b: b["block_id"]).alias("block_ids"),
        F.array_sort(F.collect_set("block_type")).alias("content_types"),
        F.array_sort(F.collect_set("role")).alias("roles"),
    )
    grouped = grouped.withColumn("whole", rendered(F.col("path"), F.col("texts")))
    only = F.array(F.struct(F.col("path").alias("text"), F.lit("asset_only").alias("reason")))
    pieces = F.when((F.col("whole") == "") & F.col("has_assets"), only).otherwise(X.split_text("whole", most))
    split = grouped.select("*", F.posexplode(pieces).alias("piece_no", "piece")).drop("texts", "whole")
    split = split.withColumn("text", F.col("piece.text")).where(F.col("has_assets") | ~P.is_heading_only("text", "path"))
    split = split.where(P.drop_reason("text", "path", cleaning).isNull())
    at = Window.partitionBy("doc_id").orderBy("section_no", "piece_no")
    split = split.withColumn("parent_index", F.row_number().over(at) - 1).join(documents.select("doc_id", "title", "source_path", "source_type", "file_type"), "doc_id", "left")
    out = split.select(
        X.stable_id("parent", F.col("doc_id"), F.col("parent_index"), F.col("path"), F.col("text")).alias("parent_id"), "doc_id", "parent_index", "title", "source_path", "source_type", "file_type",
        F.coalesce(F.nullif(F.col("path"), F.lit("")), F.col("title")).alias("section_path"), "section_level", "page_start", "page_end", "text", X.content_hash("text").alias("content_hash"),
        "block_ids", "content_types", "roles", X.estimated_tokens("text").alias("estimated_tokens"), F.col("piece.reason").alias("split_reason"), "section_no",
    )
    last = out.groupBy("doc_id", "section_no").agg(F.max_by("parent_id", "parent_index").alias("parent_id"))
    order = Window.partitionBy("doc_id").orderBy("section_no", "block_ordinal")
    found = rows.where(asset).withColumn("asset_index", F.row_number().over(order)).join(last, ["doc_id", "section_no"], "left")
    found = found.withColumn("label", X.asset_label(F.col("caption"), F.col("block_type"), F.col("asset_index")))
    assets = found.select(
        X.stable_id("asset", F.col("doc_id"), F.col("block_id"), F.col("block_type"), F.col("label")).alias("asset_id"), "parent_id", "doc_id", F.col("block_type").alias("asset_type"), "asset_index", "label",
        F.coalesce(F.nullif(F.col("caption"), F.lit("")), F.col("text")).alias("caption"), "page_start", "page_end", F.when(F.col("block_type").isin("table", "equation"), F.col("text")).otherwise("").alias("text_repr"),
    )
    return out.drop("section_no"), assets


def children(parent_rows: DataFrame, most: int = CHILD_MOST, overlap: int = CHILD_OVERLAP) -> DataFrame:
    """Child chunks of parents, with the text that is embedded and indexed."""
    rows = parent_rows.select("*", F.posexplode(X.split_text("text", most, overlap)).alias("child_index", "piece"))
    text, page = F.col("piece.text"), X.page_label(F.col("page_start"), F.col("page_end"))
    return rows.select(
        X.stable_id("child", F.col("parent_id"), F.col("child_index"), text).alias("child_id"), "parent_id", "doc_id", "child_index", "parent_index", "title", "source_path", "source_type", "file_type", "section_path", "page_start", "page_end",
        text.alias("text"), X.contextualized(F.col("title"), F.col("source_type"), F.col("section_path"), page, text).alias("embedding_text"), X.estimated_tokens(text).alias("estimated_tokens"), F.col("piece.reason").alias("split_reason"),
    )
