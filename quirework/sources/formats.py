"""Files of several formats as documents and blocks.

Bytes come from Spark's binaryFile reader; formats that are trees (DOCX, TEI, layout JSON, MAT) are parsed in
Python, a file at a time, in vectorised functions. Everything else is column expressions.
"""

from __future__ import annotations

import io
import json
import struct
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import text as X
from ..functions.predicates import ASSETS, source_format
from ..operators import blocks as B

TEI = "{http://www.tei-c.org/ns/1.0}"
XML_ID = "{http://www.w3.org/XML/1998/namespace}id"
TEI_SCHEMA = "struct<title:string,authors:array<string>,year:string,doi:string,abstract:string,sections:array<struct<section_path:string,level:int,heading:string,paragraphs:array<struct<text:string,citation_ids:array<string>,xml_id:string>>>>,references:array<struct<label:string,raw_text:string,title:string,authors:array<string>,year:string,doi:string>>>"
LAYOUT_SCHEMA = "struct<fallback:boolean,blocks:array<struct<block_ordinal:int,block_id:string,block_type:string,text:string,role:string,ref:string,caption:string,page_start:int,page_end:int>>>"


def prepare_workers(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it."""
    import os
    from pathlib import Path

    top, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if top not in paths:
        env["PYTHONPATH"] = os.pathsep.join([top, *(p for p in paths if p)])


def contents(spark: SparkSession, folders: list[str], wanted: DataFrame, most: int = 100_000) -> DataFrame:
    """path and content of the wanted paths: read by name if they are few, else from their folders, by a semi-join."""
    path = F.regexp_replace("path", "^file:/+", "/").alias("path")
    reader = spark.read.format("binaryFile")
    names = [r.path for r in wanted.select("path").limit(most + 1).collect()]
    if not names:
        return spark.createDataFrame([], "path string, content binary")
    if len(names) <= most:
        return reader.load(names).select(path, "content")
    return reader.option("recursiveFileLookup", "true").load(folders).select(path, "content").join(wanted.select("path"), "path", "left_semi")


def scan(spark: SparkSession, paths: list[str], strict: bool = False) -> DataFrame:
    """path, file_type, content_hash, content of files; strict raises an error for unknown formats."""
    return typed(spark.read.format("binaryFile").load(paths).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "content"), strict)


def typed(rows: DataFrame, strict: bool = False) -> DataFrame:
    prepare_workers(rows.sparkSession)
    kind = source_format("path")
    if strict:
        kind = F.coalesce(kind, F.raise_error(F.concat(F.lit("Unsupported file type: "), F.col("path"))).cast("string"))
    return rows.select("path", kind.alias("file_type"), F.sha2("content", 256).alias("content_hash"), "content")


def docx_text(content: bytes) -> str:
    """Paragraphs in order (headings as ## lines), then tables, a line for each row with tabs between cells."""
    import xml.etree.ElementTree as ET
    import zipfile

    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ET.fromstring(archive.read("word/document.xml")).find(f"{w}body")
        names = {}
        if "word/styles.xml" in archive.namelist():
            for style in ET.fromstring(archive.read("word/styles.xml")).iter(f"{w}style"):
                name = style.find(f"{w}name")
                names[style.get(f"{w}styleId")] = name.get(f"{w}val", "") if name is not None else ""

    def words(node) -> str:
        return "".join("\t" if x.tag == f"{w}tab" else "\n" if x.tag == f"{w}br" else x.text or "" for x in node.iter() if x.tag in (f"{w}t", f"{w}tab", f"{w}br")).strip()

    out = []
    for paragraph in body.findall(f"{w}p") if body is not None else []:
        text, style = words(paragraph), paragraph.find(f"{w}pPr/{w}pStyle")
        name = names.get(style.get(f"{w}val"), style.get(f"{w}val")) if style is not None else ""
        if text:
            out.append(f"\n## {text}\n" if name.lower().startswith("heading") else text)
    for row in body.iter(f"{w}tr") if body is not None else []:
        cells = [t for t in ("\n".join(filter(None, map(words, cell.findall(f"{w}p")))) for cell in row.findall(f"{w}tc")) if t]
        if cells:
            out.append("\t".join(cells))
    return "\n".join(out).strip()


def failure(reason: str, message: Column | str) -> Column:
    return failure_of(F.lit(reason), F.lit(message) if isinstance(message, str) else message)


def failure_of(reason: Column, message: Column) -> Column:
    return F.struct(reason.alias("reason"), message.alias("message"))


def read_texts(files: DataFrame) -> DataFrame:
    """path, file_type, content_hash, raw and error (reason, message) of Markdown, text and DOCX files: either raw or error is null.

    A file that can't be read is a row like any other; no file ends the others' task.
    """
    prepare_workers(files.sparkSession)

    @F.pandas_udf("struct<text:string,error:string>")
    def of_docx(contents: pd.Series) -> pd.DataFrame:
        def one(content):
            try:
                return (docx_text(bytes(content)) if content is not None and len(content) else "", None)
            except Exception as error:  # whatever a broken archive or tree gives
                return None, f"{type(error).__name__}: {error}"

        return pd.DataFrame([one(c) for c in contents], columns=["text", "error"])

    kind = F.col("file_type")
    rows = files.where(kind.isin("md", "txt", "docx")).withColumn("__docx", F.when(kind == "docx", of_docx(F.when(kind == "docx", F.col("content")))))
    plain = F.try_validate_utf8(F.col("content").cast("string"))
    error = F.when(F.col("__docx.error").isNotNull(), failure("bad_docx", F.col("__docx.error"))).when((kind != "docx") & plain.isNull(), failure("not_utf8", "the text isn't UTF-8"))
    return rows.select("path", "file_type", "content_hash", F.when(kind == "docx", F.col("__docx.text")).otherwise(plain).alias("raw"), error.alias("error"))


def documents(files: DataFrame) -> DataFrame:
    """doc_id, path, file_type, source_type, content_hash, title, text, metadata of the readable Markdown, text and DOCX files (or of rows of read_texts)."""
    rows = files if "raw" in files.columns else read_texts(files)
    kind = F.col("file_type")
    rows = rows.where("error is null").withColumn("front", F.when(kind == "md", X.front_matter("raw")))
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    return rows.select(
        X.stable_id("doc", F.col("path"), F.col("content_hash")).alias("doc_id"), "path", "file_type", F.when(kind == "md", "note").otherwise("text").alias("source_type"), "content_hash",
        F.coalesce(F.col("front.metadata")["title"], stem).alias("title"), F.coalesce("front.body", "raw").alias("text"), F.col("front.metadata").alias("metadata"), F.col("front.metadata")["title"].isNotNull().alias("titled"),
    )


def with_sidecars(files: DataFrame, sides: DataFrame, sidecars: DataFrame) -> DataFrame:
    """The PDF files among files with layout and tei, the texts of their sidecars (path, layout_path, tei_path), and error.

    sidecars: path and content of files that hold the sidecars. A sidecar that can't be read counts as none; a file
    that is left without any has an error of both.
    """
    prepare_workers(files.sparkSession)
    rows = files.where("file_type = 'pdf'").select("path", "file_type", "content_hash").join(sides, "path")
    text = F.try_validate_utf8(F.col("content").cast("string"))
    for name in ("layout", "tei"):
        read = sidecars.select(F.col("path").alias(f"{name}_path"), text.alias(name), F.col("content").isNotNull().alias(f"{name}_there"))
        rows = rows.join(read, f"{name}_path", "left")

    @F.pandas_udf("struct<layout:string,tei:string>")
    def faults(layouts: pd.Series, teis: pd.Series) -> pd.DataFrame:
        def of(parse, value):
            try:
                if value is not None:
                    parse(value)
            except Exception as error:
                return f"{type(error).__name__}: {error}"

        return pd.DataFrame({"layout": [of(parse_layout, x) for x in layouts], "tei": [of(parse_tei, x) for x in teis]}, dtype=object)

    rows = rows.withColumn("fault", faults("layout", "tei"))
    utf8 = lambda name: F.when(F.col(f"{name}_there") & F.col(name).isNull(), "not UTF-8")
    said = [F.concat(F.lit(f"{name}: "), F.coalesce(utf8(name), F.col("fault")[name])) for name in ("layout", "tei")]
    rows = rows.withColumns({name: F.when(F.col("fault")[name].isNull(), F.col(name)) for name in ("layout", "tei")} | {"message": F.concat_ws("; ", *said)})
    lost = F.col("layout").isNull() & F.col("tei").isNull()
    error = F.when(lost & (F.col("message") == ""), failure("no_layout_or_tei", "no file of layout or TEI beside it")).when(lost, failure("bad_layout_or_tei", F.col("message")))
    return rows.select("path", "file_type", "content_hash", "layout", "tei", error.alias("error"))


def pdf_documents(pdfs: DataFrame) -> DataFrame:
    """Documents of PDF files with sidecars: also authors, year, parser, layout and the parsed tei. A broken TEI counts as none."""
    rows = pdfs.where("error is null") if "error" in pdfs.columns else pdfs
    rows = rows.withColumn("doc_id", X.stable_id("doc", F.col("path"), F.col("content_hash")))
    rows = rows.drop("tei").join(tei(rows), "doc_id")
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    title = F.nullif(F.col("tei.title"), F.lit(""))
    for name, kind in (("pages", "array<struct<page:int,text:string>>"), ("ocr", "string")):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    parser = F.concat_ws("+", F.when(F.col("layout").isNotNull(), "layout"), F.when(F.col("tei").isNotNull(), "tei"), F.when(F.col("pages").isNotNull(), "text_layer"))
    told = F.map_filter(F.create_map(F.lit("doi"), F.nullif(F.col("tei.doi"), F.lit("")), F.lit("ocr"), F.when(F.col("pages").isNotNull(), F.col("ocr"))), lambda k, v: v.isNotNull())
    return rows.select(
        "doc_id", "path", F.lit("pdf").alias("file_type"), F.lit("paper").alias("source_type"), "content_hash", F.coalesce(title, stem).alias("title"), F.lit(None).cast("string").alias("text"),
        F.when(F.size(told) > 0, told).alias("metadata"), title.isNotNull().alias("titled"), F.col("tei.authors").alias("authors"), F.col("tei.year").alias("year"), parser.alias("parser"), "layout", "tei", "pages",
    )


def pdf_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of PDF documents: the layout's, aligned to the TEI's sections if there is one, else the TEI's own."""
    laid = layout_blocks(docs.where("layout is not null"))
    both = docs.where("layout is not null and tei is not null")
    heads = both.select("doc_id", F.posexplode("tei.sections").alias("ordinal", "s")).select("doc_id", "ordinal", "s.heading", "s.section_path")
    paired = laid.join(both.select("doc_id"), "doc_id", "left_semi")
    matched = B.aligned(paired, heads, both.select("doc_id", F.col("tei.abstract").alias("abstract")))
    rest = laid.join(both.select("doc_id"), "doc_id", "left_anti")
    own = tei_blocks(docs.where("layout is null and tei is not null"))
    return matched.unionByName(rest).unionByName(own, allowMissingColumns=True).drop("ref")


def document_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of documents: Markdown and DOCX by their marks, plain texts by blank lines."""
    marked = B.markdown_blocks(docs.where("file_type <> 'txt'"))
    plain = B.text_blocks(docs.where("file_type = 'txt'"))
    blocks = marked.unionByName(plain.select(*marked.columns))
    return blocks.drop("source_type").join(docs.select("doc_id", "source_type"), "doc_id")


def titles(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """docs with the title of their blocks: a title, else the first uncommon heading, else a heading of level 1, else as it was."""
    text = X.strip("text")
    rank = F.when(F.col("block_type") == "title", 1).when((F.col("block_type") == "section_header") & ~X.is_common_heading("text"), 2).when((F.col("block_type") == "section_header") & (F.col("level") <= 1), 3)
    best = blocks.where(text != "").withColumn("__r", rank).where("__r is not null").groupBy("doc_id").agg(F.min_by(text, F.struct("__r", "block_ordinal")).alias("__title"))
    return docs.join(best, "doc_id", "left").withColumn("title", F.when(F.col("titled"), F.col("title")).otherwise(F.coalesce("__title", "title"))).drop("__title")


# --- TEI ------------------------------------------------------------------------------------------


def _flat(node) -> str:
    return " ".join(" ".join(node.itertext()).split()) if node is not None else ""


def parse_tei(xml: str) -> dict:
    """Title, authors, year, DOI, abstract, sections with paragraphs and citations, and references of a TEI document."""
    import re
    import xml.etree.ElementTree as ET

    root = ET.fromstring(xml)
    every = lambda node, name: node.iter(TEI + name)

    def year(node) -> str:
        for date in every(node, "date"):
            found = re.search(r"\d{4}", date.get("when") or date.get("year") or _flat(date))
            return found[0] if found else ""
        return ""

    def doi(node) -> str:
        return next((_flat(i) for i in every(node, "idno") if i.get("type") == "DOI"), "")

    header = root.find(f".//{TEI}teiHeader")
    names: dict[str, None] = {}
    for author in every(header, "author") if header is not None else ():
        parts = [_flat(part) for person in every(author, "persName") for part in person]
        names.setdefault(" ".join(p for p in parts if p) or _flat(author))
    sections: list[dict] = []

    def visit(div, path: list[str], level: int) -> None:
        heading = _flat(div.find(f"{TEI}head")) or f"Section {len(sections) + 1}"
        paragraphs = []
        for p in div.findall(f"{TEI}p"):
            if text := _flat(p):
                targets = [(r.get("target") or "").lstrip("#") for r in every(p, "ref") if r.get("type") == "bibr"]
                paragraphs.append({"text": text, "citation_ids": list(dict.fromkeys(t for t in targets if t)), "xml_id": p.get(XML_ID, "")})
        sections.append({"section_path": " > ".join([*path, heading]), "level": level, "heading": heading, "paragraphs": paragraphs})
        for inner in div.findall(f"{TEI}div"):
            visit(inner, [*path, heading], level + 1)

    body = root.find(f".//{TEI}text/{TEI}body")
    for div in body.findall(f"{TEI}div") if body is not None else ():
        visit(div, [], 1)
    references = []
    for n, bibl in enumerate(root.findall(f".//{TEI}text/{TEI}back//{TEI}listBibl/{TEI}biblStruct"), 1):
        note = next((x for x in every(bibl, "note") if x.get("type") == "raw_reference"), None)
        when = next((re.search(r"\d{4}", d.get("when") or d.get("year") or "") for d in every(bibl, "date")), None)
        references.append({"label": bibl.get(XML_ID) or str(n), "raw_text": _flat(note) or _flat(bibl), "title": _flat(next(every(bibl, "title"), None)), "authors": [a for a in map(_flat, every(bibl, "author")) if a], "year": when[0] if when else "", "doi": doi(bibl)})
    published = next((y for scope in ("publicationStmt", "sourceDesc") for part in every(root, scope) if (y := year(part))), "") or year(root)
    title = root.find(f".//{TEI}teiHeader//{TEI}titleStmt/{TEI}title")
    return {
        "title": _flat(title) or _flat(root.find(f".//{TEI}title[@type='main']")), "authors": [n for n in names if n], "year": published, "doi": doi(root),
        "abstract": _flat(root.find(f".//{TEI}profileDesc/{TEI}abstract")), "sections": sections, "references": references,
    }


def tei(rows: DataFrame, xml_col: str = "tei") -> DataFrame:
    """doc_id and a struct of each TEI document; a broken document gives null."""
    def safe(xml):
        import xml.etree.ElementTree as ET

        try:
            return parse_tei(xml) if xml else None
        except ET.ParseError:
            return None

    @F.pandas_udf("string")
    def parse(values: pd.Series) -> pd.Series:
        return values.map(lambda x: json.dumps(d) if (d := safe(x)) is not None else None)

    return rows.select("doc_id", F.from_json(parse(xml_col), TEI_SCHEMA).alias("tei"))


def tei_references(parsed: DataFrame) -> DataFrame:
    """Rows of the references table."""
    rows = parsed.select("doc_id", F.explode("tei.references").alias("r"))
    return rows.select(X.stable_id("ref", F.col("doc_id"), F.col("r.label"), F.col("r.raw_text")).alias("reference_id"), "doc_id", "r.label", "r.raw_text", "r.title", "r.authors", "r.year", "r.doi")


def tei_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of parsed TEI documents (doc_id, tei): the abstract, then each section's heading and paragraphs under its path."""
    unit = "array<struct<block_type:string,text:string,level:int>>"
    abstract = docs.where("tei.abstract <> ''").select("doc_id", F.lit(-1).alias("k"), F.lit("Abstract").alias("section_path"), F.expr(f"cast(array(struct('paragraph', tei.abstract, 0)) as {unit})").alias("units"))
    parts = docs.select("doc_id", F.posexplode("tei.sections").alias("k", "s"))
    units = F.concat(F.expr(f"cast(array(struct('section_header', s.heading, s.level)) as {unit})"), F.expr(f"cast(transform(s.paragraphs, p -> struct('paragraph', p.text, 0)) as {unit})"))
    rows = abstract.unionByName(parts.select("doc_id", "k", "s.section_path", units.alias("units"))).select("doc_id", "k", "section_path", F.posexplode("units").alias("j", "u"))
    at = Window.partitionBy("doc_id").orderBy("k", "j")
    rows = rows.withColumn("block_ordinal", F.row_number().over(at) - 1).withColumn("block_id", F.concat(F.lit("t"), F.col("block_ordinal").cast("string")))
    return B.completed(rows.select("doc_id", "block_ordinal", "block_id", "u.*", "section_path").withColumn("source_type", F.lit("paper")))


# --- layout trees ---------------------------------------------------------------------------------


def parse_layout(raw: str) -> dict:
    """Leaf items of a layout document's body (then furniture) in reading order, references resolved, each once.

    A body that is empty or broken gives the items of texts, tables and pictures in their order instead.
    """
    doc = json.loads(raw)
    lists = [item for name in ("texts", "tables", "pictures", "groups") for item in doc.get(name) or []]
    known = {item.get("self_ref"): item for item in lists if item.get("self_ref")}

    def ref(node: dict) -> str | None:
        return node.get("self_ref") or node.get("$ref") or node.get("cref")

    def leaves(node: dict, above: frozenset = frozenset()):
        node = known.get(ref(node), node)
        mark = ref(node)
        if mark in above:
            raise ValueError("a layout tree refers to itself")
        below = above | {mark} if mark else above
        if node.get("children"):
            for child in node["children"]:
                yield from leaves(child, below)
        else:
            yield node

    def kind(label: str) -> str:
        for marks, name in ((("section_header", "heading"), "section_header"), (("title",), "title"), (("table",), "table"), (("picture", "figure"), "figure"), (("formula", "equation"), "equation"), (("list",), "list_item")):
            if any(m in label for m in marks):
                return name
        return "paragraph"

    def text_of(item) -> str:
        item = known.get(ref(item), item)
        return next((item[k] for k in ("text", "orig", "content") if isinstance(item.get(k), str)), "").strip()

    def blocks(items, role: str, prefix: str) -> list[dict]:
        out, seen = [], set()
        for item in items:
            mark = ref(item)
            if mark and mark in seen:
                continue
            seen.add(mark)
            of = kind(str(item.get("label") or item.get("name") or "").lower())
            caption = " ".join(filter(None, map(text_of, item.get("captions") or [])))
            text = text_of(item) or caption
            if not text and of not in ASSETS:
                continue
            pages = [int(p["page_no"]) for p in item.get("prov") or [] if p.get("page_no") is not None]
            mine = "furniture" if role == "furniture" else "asset" if of in ASSETS else "body"
            out.append({"block_id": f"{prefix}{len(out)}", "block_type": of, "text": text, "role": mine, "ref": mark, "caption": caption, "page_start": min(pages, default=None), "page_end": max(pages, default=None)})
        return out

    fallback = False
    try:
        items = list(leaves(doc["body"]))
        if items == [doc["body"]]:
            raise ValueError("empty body")
    except (KeyError, ValueError, TypeError):
        fallback, items = True, [i for i in lists if i not in (doc.get("groups") or [])]
    out = blocks(items, "body", "b")
    if doc.get("furniture"):
        out += blocks([i for i in leaves(doc["furniture"]) if i is not doc["furniture"]], "furniture", "f")
    return {"fallback": fallback, "blocks": [{"block_ordinal": n, **b} for n, b in enumerate(out)]}


def layout_blocks(rows: DataFrame, json_col: str = "layout", source_type: str = "paper") -> DataFrame:
    """Blocks of layout documents (doc_id and their JSON)."""
    @F.pandas_udf("string")
    def parse(values: pd.Series) -> pd.Series:
        return values.map(lambda x: json.dumps(parse_layout(x)) if x else None)

    found = rows.select("doc_id", F.from_json(parse(json_col), LAYOUT_SCHEMA).alias("d")).select("doc_id", F.explode("d.blocks").alias("b")).select("doc_id", "b.*")
    return B.completed(found.withColumn("level", X.heading_level(F.col("block_type"), F.col("text"))).withColumn("source_type", F.lit(source_type)))


# --- MAT matrices ---------------------------------------------------------------------------------

_TYPES = {1: "i1", 2: "u1", 3: "<i2", 4: "<u2", 5: "<i4", 6: "<u4", 7: "<f4", 9: "<f8", 12: "<i8", 13: "<u8"}


def read_mat(content: bytes) -> dict:
    """Numeric variables (name to array) of a MAT file of level 5, little-endian."""
    import numpy as np

    def element(data: bytes, at: int):
        kind, size = struct.unpack_from("<II", data, at)
        if kind >> 16:  # small element
            return kind & 0xFFFF, data[at + 4 : at + 4 + (kind >> 16)], at + 8
        end = at + 8 + size
        return kind, data[at + 8 : end], end if kind == 15 else -(-end // 8) * 8

    def matrix(data: bytes):
        at, parts = 0, []
        while at < len(data) and len(parts) < 4:
            kind, body, at = element(data, at)
            parts.append((kind, body))
        if len(parts) < 4 or parts[3][0] not in _TYPES:
            return None
        shape = struct.unpack(f"<{len(parts[1][1]) // 4}i", parts[1][1])
        return parts[2][1].decode(), np.frombuffer(parts[3][1], _TYPES[parts[3][0]]).reshape(shape, order="F").astype(float)

    out, at = {}, 128
    if content[126:128] != b"IM":
        raise ValueError("not a little-endian MAT file of level 5")
    while at + 8 <= len(content):
        kind, body, at = element(content, at)
        if kind == 15:
            kind, body, _ = element(zlib.decompress(body), 0)
        if kind == 14 and (found := matrix(body)) is not None and not found[0].startswith("__"):
            out[found[0]] = found[1]
    return out


def write_mat(variables: dict) -> bytes:
    """A MAT file of level 5 with two-dimensional matrices of doubles."""
    import numpy as np

    def element(kind: int, body: bytes) -> bytes:
        return struct.pack("<II", kind, len(body)) + body + b"\0" * (-len(body) % 8)

    out = b"MATLAB 5.0 MAT-file".ljust(116) + b"\0" * 8 + struct.pack("<H", 0x0100) + b"IM"
    for name, value in variables.items():
        value = np.asarray(value, float)
        flags, shape = element(6, struct.pack("<II", 6, 0)), element(5, struct.pack(f"<{value.ndim}i", *value.shape))
        out += element(14, flags + shape + element(1, name.encode()) + element(9, value.tobytes(order="F")))
    return out


def inspect_mat(content: bytes) -> list[dict]:
    return [{"name": n, "shape": list(a.shape), "dtype": str(a.dtype)} for n, a in read_mat(content).items()]


def single_matrix(content: bytes):
    """(name, matrix) of a file with exactly one two-dimensional variable."""
    found = read_mat(content)
    if len(found) != 1:
        raise ValueError(f"expected exactly one variable, found {len(found)}")
    (name, value), = found.items()
    if value.ndim != 2:
        raise ValueError("the variable isn't two-dimensional")
    return name, value


def mat_grid(files: DataFrame) -> DataFrame:
    """The cells (matrix_id, r, c, v) of files (path, content); the path names a matrix."""
    def cells(batches):
        for batch in batches:
            for path, content in zip(batch.path, batch.content):
                import numpy as np

                _, m = single_matrix(bytes(content))
                r, c = np.indices(m.shape)
                yield pd.DataFrame({"matrix_id": path, "r": r.ravel(), "c": c.ravel(), "v": m.ravel()})

    return files.select("path", "content").mapInPandas(cells, "matrix_id string, r int, c int, v double")
