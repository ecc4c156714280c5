"""Blocks of documents: making them from texts, cleaning, sections.

A block is a row (doc_id, block_ordinal, block_id, block_type, text, level, page_start, page_end, section_path, role,
noise_reason, source_type, caption). Rules that depend on the order of blocks (reference lists, recommendations, heading paths)
are windows over a document's blocks.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import predicates as P, text as X

DEFAULTS = {"block_id": "string", "block_type": "string", "text": "string", "level": "int", "page_start": "int", "page_end": "int", "section_path": "string", "role": "string", "noise_reason": "string", "source_type": "string", "caption": "string"}
MARKDOWN = "array<struct<block_ordinal:int,block_id:string,block_type:string,text:string,level:int>>"


def completed(blocks: DataFrame) -> DataFrame:
    """Blocks with all columns; missing ones are empty (role: body)."""
    for name, kind in DEFAULTS.items():
        if name not in blocks.columns:
            blocks = blocks.withColumn(name, F.lit("body" if name == "role" else None).cast(kind))
    return blocks


def text_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Paragraphs between blank lines; ordinals count empty ones too."""
    parts = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.coalesce(text_col, F.lit("")), r"(?U)\n\s*\n")).alias("block_ordinal", "text"))
    parts = parts.withColumn("text", X.strip("text")).where("text <> ''")
    return completed(parts.withColumn("block_id", F.concat(F.lit("b"), F.col("block_ordinal").cast("string"))).withColumn("block_type", F.lit("paragraph")).withColumn("level", F.lit(0)))


def parse_markdown(text: str) -> list[dict]:
    """Blocks of a Markdown text: fenced code as it stands, headings, paragraphs between blank lines.

    A fence that isn't closed makes its lines a paragraph; lines right before a fence belong to its block.
    """
    import re

    out: list[dict] = []
    held: list[str] = []
    fenced = False

    def add(kind: str, body: str, level: int = 0) -> None:
        out.append({"block_ordinal": len(out), "block_id": f"b{len(out)}", "block_type": kind, "text": body, "level": level})

    def close(kind: str = "paragraph") -> None:
        body = "\n".join(held).strip()
        held.clear()
        if body or kind == "code":
            add(kind, body)

    for line in text.splitlines():
        bare = line.strip()
        fence = bare.startswith("```")
        if fence or fenced:
            held.append(line)
            if fence:
                fenced = not fenced
                if not fenced:
                    close("code")
        elif head := re.match(r"(#{1,6})\s+(.+)$", bare):
            close()
            level = len(head[1])
            add("title" if level == 1 and not out else "section_header", head[2].strip(), level)
        elif bare:
            held.append(line)
        else:
            close()
    close()
    return out


def markdown_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    from ..sources.formats import prepare_workers

    prepare_workers(docs.sparkSession)

    @F.pandas_udf(MARKDOWN)
    def parse(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(parse_markdown)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.explode(parse(F.coalesce(text_col, F.lit("")))).alias("b"))
    return completed(rows.select("doc_id", "b.*"))


def repeated_lines(blocks: DataFrame, least_pages: int = 2) -> DataFrame:
    """doc_id, line: short lines that stand on several pages of a document."""
    rows = blocks.where(F.col("page_start").isNotNull()).select("doc_id", "page_start", F.explode(P.candidate_lines("text")).alias("line"))
    rows = rows.withColumn("line", X.normalize_line("line")).where(P.is_repeatable_line("line"))
    return rows.groupBy("doc_id", "line").agg(F.countDistinct("page_start").alias("n")).where(F.col("n") >= least_pages).select("doc_id", "line")


def cleaned_lines(text: Column, repeated: Column) -> Column:
    """struct<text, removed>: a text without repeated and noise lines, and how many these were."""
    lines = P.candidate_lines(text)
    noise = lambda x: F.array_contains(repeated, X.normalize_line(x)) | P.is_noise_line(x)
    return X.let(
        lines,
        lambda all_: X.let(F.filter(all_, lambda x: ~noise(x)), lambda kept: F.struct(X.normalize_space(F.array_join(kept, "\n")).alias("text"), (F.size(all_) - F.size(kept)).alias("removed"))),
    )


def annotate(blocks: DataFrame, repeated_headers: bool = True, least_pages: int = 2, exclude_references: bool = True, compose: bool = True) -> DataFrame:
    """Blocks with cleaned text, role, noise_reason, removed_lines, text_for_embedding; code stays as it is, notes are only squeezed."""
    blocks = completed(blocks)
    doc = Window.partitionBy("doc_id").orderBy("block_ordinal")
    role, reason = F.coalesce("role", F.lit("body")), F.coalesce("noise_reason", F.lit(""))
    code = F.coalesce(F.col("block_type") == "code", F.lit(False))
    note = ~code & F.coalesce(F.col("source_type").isin("note", "text"), F.lit(False))
    kind = F.coalesce("block_type", F.lit(""))
    rows = blocks.withColumns({"__on": ~code & ~note, "__t": X.normalize_scientific("text", compose), "__lvl": F.coalesce(F.nullif(F.col("level"), F.lit(0)), F.lit(1))})
    rows = rows.withColumns({"__head": kind.isin(*P.HEADINGS), "__path": P.is_reference_path("section_path"), "__academic": P.is_academic_heading("__t", kind)})

    # a list of references begins at its heading and ends at the next other heading that isn't deeper
    on = F.col("__on")
    rows = rows.withColumn("__ref", on & P.is_reference_heading("text") if exclude_references else F.lit(False))
    rows = rows.withColumns({"__ref_no": F.sum(F.col("__ref").cast("int")).over(doc), "__ref_lvl": F.last(F.when(F.col("__ref"), F.col("__lvl")), True).over(doc)})
    ends = on & F.col("__head") & ~F.col("__ref") & (F.col("__ref_no") > 0) & (F.col("__lvl") <= F.col("__ref_lvl"))
    inside = Window.partitionBy("doc_id", "__ref_no").orderBy("block_ordinal")
    rows = rows.withColumn("__listed", on & (F.col("__ref_no") > 0) & ~F.bool_or(ends).over(inside.rowsBetween(Window.unboundedPreceding, 0)))

    # recommendations reach from their heading over its page, to the first academic heading
    free = on & ~F.col("__listed")
    rows = rows.withColumn("__rec", free & P.is_recommendation_heading("text"))
    rows = rows.withColumns({"__rec_no": F.sum(F.col("__rec").cast("int")).over(doc), "__rec_page": F.last(F.when(F.col("__rec"), F.struct("page_start")), True).over(doc)["page_start"]})
    other = free & ~F.col("__rec") & (F.col("__rec_no") > 0) & F.col("__rec_page").isNotNull()
    stops = other & ~(F.coalesce(F.col("page_start") == F.col("__rec_page"), F.lit(False)) & ~F.col("__academic"))
    before = Window.partitionBy("doc_id", "__rec_no").orderBy("block_ordinal").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"__stops": stops, "__span": other & ~F.coalesce(F.bool_or(stops).over(before), F.lit(False))})

    first = F.when(F.col("__listed") | F.col("__path"), "reference").when(X.strip("__t") == "", "noise").otherwise(role)
    first_reason = F.when(~F.col("__listed") & ~F.col("__path") & (X.strip("__t") == ""), "empty").otherwise(reason)
    checks = free & ~F.col("__span")
    noise = (
        F.when(F.col("__rec") | (F.col("__span") & ~F.col("__stops")), "recommendation_noise")
        .when(checks & P.is_platform_metadata("text"), "platform_metadata")
        .when(checks & P.is_title_noise("text"), "publication_noise")
        .when(checks & P.is_publication_header("text"), "publication_header")
    )
    rows = rows.withColumns({"__noise": noise, "__role": first, "__reason": first_reason})
    cited = checks & F.col("__noise").isNull() & F.col("__path") & P.is_bibliography("__t")
    rows = rows.withColumns({"__role": F.when(F.col("__noise").isNotNull(), "noise").otherwise(F.col("__role")), "__reason": F.when(cited, "").otherwise(F.coalesce("__noise", "__reason"))})

    if repeated_headers:
        lists = repeated_lines(blocks.withColumn("text", X.normalize_scientific("text", compose)), least_pages).groupBy("doc_id").agg(F.collect_set("line").alias("__lines"))
        rows = rows.join(lists, "doc_id", "left")
        lines = F.coalesce("__lines", F.array().cast("array<string>"))
    else:
        lines = F.array().cast("array<string>")
    rows = rows.withColumn("__clean", cleaned_lines(F.col("__t"), lines))
    text = F.col("__clean.text")
    blank = (text == "") & ~F.col("__role").isin("asset", "reference", "furniture")
    rows = rows.withColumns({"__reason": F.when(blank & (F.col("__reason") == ""), "empty_after_line_clean").otherwise(F.col("__reason")), "__role": F.when(blank, "noise").otherwise(F.col("__role"))})
    lifted = (F.col("__role") == "body") & P.is_academic_heading(text, kind)
    new_kind = F.when(lifted, "section_header").otherwise(F.col("block_type"))
    squeezed = X.strip(F.regexp_replace(F.coalesce("text", F.lit("")), r"[ \t]+", " "))

    def pick(of_code, of_note, of_paper):
        return F.when(code, of_code).when(note, of_note).otherwise(of_paper)

    raw = F.coalesce("text", F.lit(""))
    out = {
        "text": pick(raw, squeezed, text),
        "text_for_embedding": pick(raw, squeezed, X.remove_citation_markers(text)),
        "role": pick(F.lit("body"), F.when(squeezed == "", "noise").otherwise("body"), F.col("__role")),
        "noise_reason": pick(F.lit(""), F.when(squeezed == "", "empty").otherwise(""), F.col("__reason")),
        "removed_lines": pick(F.lit(0), F.lit(0), F.col("__clean.removed")),
        "block_type": F.when(F.col("__on"), new_kind).otherwise(F.col("block_type")),
        "level": F.when(F.col("__on") & (F.col("__role") == "body") & (new_kind == "section_header") & (F.coalesce("level", F.lit(0)) == 0), 2).otherwise(F.col("level")),
        "section_path": F.when(F.col("__on") & (F.col("__role") == "reference") & (F.coalesce("section_path", F.lit("")) == ""), "References").otherwise(F.col("section_path")),
    }
    return rows.select(*(c for c in blocks.columns if c not in out), *(v.alias(k) for k, v in out.items()))


def cleaning_report(blocks: DataFrame) -> DataFrame:
    """doc_id, blocks, and counts by role and by noise reason of annotated blocks."""
    by_role = blocks.groupBy("doc_id", F.lit("role").alias("kind"), F.col("role").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    by_reason = blocks.where("role = 'noise' and noise_reason <> ''").groupBy("doc_id", F.lit("noise").alias("kind"), F.col("noise_reason").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    lines = blocks.groupBy("doc_id", F.lit("noise").alias("kind"), F.lit("repeated_or_noise_lines").alias("name")).agg(F.sum("removed_lines").cast("long").alias("n")).where("n > 0")
    return by_role.unionByName(by_reason).unionByName(lines)


def sections(blocks: DataFrame) -> DataFrame:
    """Blocks with section_no, path and section_level: a section begins at each heading; its path joins the headings above it."""
    blocks = completed(blocks)
    doc = Window.partitionBy("doc_id").orderBy("block_ordinal").rowsBetween(Window.unboundedPreceding, 0)
    head = F.coalesce(F.col("block_type").isin(*P.HEADINGS), F.lit(False))
    level = F.coalesce(F.nullif(F.col("level"), F.lit(0)), F.when(F.col("block_type") == "title", 1).otherwise(2))
    rows = blocks.withColumns({"__head": head, "__lvl": F.when(head, F.least(level, F.lit(9)))})
    rows = rows.withColumn("section_no", F.sum(head.cast("int")).over(doc)).withColumn("__now", F.last("__lvl", True).over(doc))
    at = {k: F.last(F.when(F.col("__lvl") == k, F.struct("block_ordinal", X.strip("text").alias("text"))), True).over(doc) for k in range(1, 10)}
    rows = rows.withColumns({f"__l{k}": v for k, v in at.items()})
    parts = []
    for k in range(1, 10):
        above = [F.col(f"__l{m}.block_ordinal") for m in range(1, k)]
        latest = F.greatest(*above, F.lit(-1)) if above else F.lit(-1)
        live = (F.col("__now") >= k) & (F.col(f"__l{k}.block_ordinal") > latest)
        parts.append(F.when(live & (F.col(f"__l{k}.text") != ""), F.col(f"__l{k}.text")))
    path = F.when(F.col("section_no") == 0, "Untitled").otherwise(F.array_join(F.array_compact(F.array(*parts)), " > "))
    rows = rows.withColumns({"path": path, "section_level": F.coalesce("__now", F.lit(1))})
    return rows.drop("__head", "__lvl", "__now", *(f"__l{k}" for k in range(1, 10)))


def sections_by_path(blocks: DataFrame) -> DataFrame:
    """Blocks of the body with section_no, path and section_level: a section is a run of equal section paths."""
    blocks = completed(blocks)
    doc = Window.partitionBy("doc_id").orderBy("block_ordinal")
    rows = blocks.where(P.is_main_role(F.col("role"))).withColumn("path", F.coalesce(F.nullif(F.col("section_path"), F.lit("")), F.lit("Untitled")))
    rows = rows.withColumn("__new", F.when(F.lag("path").over(doc).eqNullSafe(F.col("path")), 0).otherwise(1))
    rows = rows.withColumn("section_no", F.sum("__new").over(doc))
    run = Window.partitionBy("doc_id", "section_no").orderBy("block_ordinal")
    level = F.coalesce(F.nullif(F.col("level"), F.lit(0)), F.lit(1))
    return rows.withColumn("section_level", F.first(level).over(run)).drop("__new")


def page_ranges(blocks: DataFrame, *keys: str) -> DataFrame:
    """keys, page_start, page_end over both page columns; null without any page."""
    low, high = F.least(F.min("page_start"), F.min("page_end")), F.greatest(F.max("page_start"), F.max("page_end"))
    return blocks.groupBy(*keys).agg(low.alias("page_start"), high.alias("page_end"))


def aligned(blocks: DataFrame, headings: DataFrame, abstracts: DataFrame | None = None) -> DataFrame:
    """Blocks with the section path of a second parser: (doc_id, heading, section_path), carried on to the next matched heading.

    Of headings that are equal in their normal form the first counts; a reference heading gives the path References.
    With abstracts (doc_id, abstract), the first of the leading paragraphs that overlaps with it has the path Abstract.
    """
    blocks = completed(blocks)
    doc = Window.partitionBy("doc_id").orderBy("block_ordinal")
    mapped = headings.withColumn("__h", X.normalize_heading("heading")).where("__h <> ''")
    order = F.min(F.struct(F.col("ordinal") if "ordinal" in headings.columns else F.lit(0), F.col("section_path"))).alias("m")
    mapped = mapped.groupBy("doc_id", "__h").agg(order).select("doc_id", "__h", F.col("m.section_path").alias("__to"))
    head = F.coalesce(F.col("block_type").isin(*P.HEADINGS), F.lit(False))
    rows = blocks.withColumn("__h", F.when(head, X.normalize_heading("text"))).join(mapped, ["doc_id", "__h"], "left")
    here = F.when(head & P.is_reference_heading("text"), "References").when(head, F.coalesce("__to", X.strip("text")))
    rows = rows.withColumn("section_path", F.last(here, True).over(doc))
    if abstracts is not None:
        rows = rows.join(abstracts.select("doc_id", "abstract"), "doc_id", "left").withColumn("__n", F.row_number().over(doc) - 1)
        likely = (F.col("__n") <= 10) & F.col("block_type").isin("paragraph", "list_item") & (X.overlap(F.col("text"), F.col("abstract")) >= 0.4)
        rows = rows.withColumn("__like", likely)
        firsts = F.sum(F.col("__like").cast("int")).over(doc.rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.withColumn("section_path", F.when(F.col("__like") & (firsts == 1), "Abstract").otherwise(F.col("section_path"))).drop("abstract", "__n", "__like")
    return rows.drop("__h", "__to")
