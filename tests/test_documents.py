import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirework.operators import blocks as B, chunks, grid as G
from quirework.sources import formats


def block_rows(spark, rows, source="paper"):
    data = [("d", n, f"b{n}", kind, text, level, page, source) for n, (kind, text, level, page) in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id string, block_ordinal int, block_id string, block_type string, text string, level int, page_start int, source_type string").withColumn("page_end", F.col("page_start"))


def roles(spark, rows, **options):
    out = B.annotate(block_rows(spark, rows, options.pop("source", "paper")), **options).orderBy("block_ordinal").collect()
    return [r.role for r in out], out


H, P_ = "section_header", "paragraph"


def test_reference_lists(spark):
    assert roles(spark, [(H, "Methods", 2, None), (P_, "Some text here", 0, None), (H, "References", 2, None), (P_, "[1] Some paper.", 0, None)])[0] == ["body", "body", "reference", "reference"]
    assert roles(spark, [(H, "References", 2, None), (P_, "[1] x y", 0, None), (H, "Appendix A", 2, None), (P_, "more text", 0, None)])[0] == ["reference", "reference", "body", "body"]
    assert roles(spark, [(H, "References", 2, None), (H, "Deeper", 3, None), (P_, "still", 0, None)])[0] == ["reference"] * 3
    assert roles(spark, [(H, "References", 2, None), (P_, "x", 0, None)], exclude_references=False)[0] == ["body", "body"]


def test_repeated_headers_and_noise(spark):
    got, _ = roles(spark, [(P_, "Journal Header", 0, 1), (P_, "1", 0, 1), (P_, "Real content of a page", 0, 1), (P_, "Journal Header", 0, 2), (P_, "Other content", 0, 2)])
    assert got == ["noise", "noise", "body", "noise", "body"]
    got, out = roles(spark, [(P_, "Checkfor", 0, 1), (P_, "updates", 0, 1), ("title", "Optics Letters", 1, 1), ("title", "A real title", 1, 1)])
    assert got == ["noise", "noise", "noise", "body"] and out[0].noise_reason == "publication_noise"
    got, _ = roles(spark, [(P_, "Citation: A et al", 0, 1), (H, "Articles you may be interested in", 2, 1), (H, "Unrelated thing", 2, 1), (H, "Next header", 2, 2), (P_, "text", 0, 2)])
    assert got == ["noise", "noise", "noise", "body", "body"]


def test_promotion_code_and_notes(spark):
    _, out = roles(spark, [(P_, "1. Introduction", 0, 1), (P_, "三、方法", 0, 1), ("code", "x  =  1\n\n\n[1]", 0, 1)])
    assert [(r.block_type, r.level) for r in out[:2]] == [(H, 2), (H, 2)] and out[2].text == "x  =  1\n\n\n[1]" and out[2].role == "body"
    got, out = roles(spark, [(H, "References", 2, None), (P_, "a   b", 0, None), (P_, "  ", 0, None)], source="note")
    assert got == ["body", "body", "noise"] and out[1].text == "a b" and out[2].noise_reason == "empty"


def test_sections(spark):
    rows = [(P_, "before", 0, 1), ("title", "T", 1, 1), (P_, "x", 0, 1), (H, "A", 2, 1), (H, "A1", 3, 2), (P_, "y", 0, 2), (H, "B", 2, 3), (P_, "z", 0, 3)]
    out = B.sections(block_rows(spark, rows)).orderBy("block_ordinal").collect()
    assert [r.path for r in out] == ["Untitled", "T", "T", "T > A", "T > A > A1", "T > A > A1", "T > B", "T > B"]
    assert [r.section_no for r in out] == [0, 1, 1, 2, 3, 3, 4, 4]


def test_chunks_by_role(spark):
    data = [("d", 0, "b0", P_, "Body text of the introduction.", "body", "Introduction"), ("d", 1, "b1", P_, "furniture", "furniture", "Introduction"), ("d", 2, "b2", P_, "ref", "reference", "References"), ("d", 3, "b3", P_, "noise", "noise", "Introduction"), ("d", 4, "b4", "table", "cells", "asset", "Introduction")]
    rows = spark.createDataFrame(data, "doc_id string, block_ordinal int, block_id string, block_type string, text string, role string, section_path string").withColumn("caption", F.when(F.col("block_type") == "table", "Table 1. Results"))
    docs = spark.createDataFrame([("d", "T", "p", "paper", "pdf")], "doc_id string, title string, source_path string, source_type string, file_type string")
    parents, assets = chunks.parents(rows, docs, by_path=True)
    (parent,), (asset,) = parents.collect(), assets.collect()
    assert parent.section_path == "Introduction" and parent.text == "Introduction\n\nBody text of the introduction." and parent.parent_index == 0
    assert asset.label == "Table 1" and asset.parent_id == parent.parent_id and asset.text_repr == "cells"
    (child,) = chunks.children(parents).collect()
    assert child.embedding_text == "Title: T\nSource type: paper\nSection: Introduction\nContent:\n" + parent.text


def test_markdown():
    got = [(b["block_type"], b["text"], b["level"]) for b in B.parse_markdown("# T\n\n## A\npara one\nline\n\n```py\n# x\n\ny\n```\n# Late\n```open\nrest")]
    assert got == [("title", "T", 1), (H, "A", 2), (P_, "para one\nline", 0), ("code", "```py\n# x\n\ny\n```", 0), (H, "Late", 1), (P_, "```open\nrest", 0)]


def docx(paragraphs, table):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = "".join(f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>' for s, t in paragraphs)
    t = "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>" for c in row) + "</w:tr>" for row in table) + "</w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{p}{t}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {w}><w:style w:styleId="H1"><w:name w:val="Heading 1"/></w:style></w:styles>')
    return out.getvalue()


def test_docx():
    assert formats.docx_text(docx([("H1", "Head"), ("", "Text"), ("", " ")], [["a", "b"], ["", "c"]])) == "## Head\n\nText\na\tb\nc"


TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>A  Title</title></titleStmt><publicationStmt><date when="2021-03-04"/></publicationStmt>
<sourceDesc><biblStruct><analytic><author><persName><forename>Ada</forename><surname>L</surname></persName></author><author><persName><forename>Ada</forename><surname>L</surname></persName></author></analytic><idno type="DOI">10.1/x</idno></biblStruct></sourceDesc></fileDesc>
<profileDesc><abstract><p>An abstract.</p></abstract></profileDesc></teiHeader>
<text><body><div><head>Intro</head><p xml:id="p1">Text <ref type="bibr" target="#b0">[1]</ref> and <ref type="bibr" target="#b0">again</ref>.</p><div><p>Deep</p></div></div></body>
<back><div><listBibl><biblStruct xml:id="b0"><analytic><title>Ref title</title><author><persName>B. C</persName></author></analytic><monogr><imprint><date when="2020"/></imprint></monogr><idno type="DOI">10.2/y</idno></biblStruct></listBibl></div></back></text></TEI>"""


def test_tei(spark):
    (row,) = formats.tei(spark.createDataFrame([("d", TEI)], "doc_id string, tei string")).collect()
    t = row.tei
    assert (t.title, t.authors, t.year, t.doi, t.abstract) == ("A Title", ["Ada L"], "2021", "10.1/x", "An abstract.")
    assert [(s.section_path, s.level) for s in t.sections] == [("Intro", 1), ("Intro > Section 2", 2)] and t.sections[0].paragraphs[0].citation_ids == ["b0"]
    (ref,) = formats.tei_references(formats.tei(spark.createDataFrame([("d", TEI), ("e", "<broken")], "doc_id string, tei string"))).collect()
    assert (ref.label, ref.title, ref.authors, ref.year, ref.doi) == ("b0", "Ref title", ["B. C"], "2020", "10.2/y")


def test_layout(spark):
    doc = {
        "texts": [{"self_ref": "#/t/0", "label": "section_header", "text": "1.2 Methods", "prov": [{"page_no": 2}, {"page_no": 3}]}, {"self_ref": "#/t/1", "label": "text", "text": "Body"}, {"self_ref": "#/t/2", "label": "page_footer", "text": "foot"}],
        "tables": [{"self_ref": "#/x/0", "label": "table", "captions": [{"text": "Table 1"}]}],
        "groups": [{"self_ref": "#/g/0", "children": [{"$ref": "#/x/0"}, {"$ref": "#/t/1"}]}],
        "body": {"self_ref": "#/body", "children": [{"$ref": "#/t/0"}, {"$ref": "#/g/0"}, {"$ref": "#/t/1"}]},
        "furniture": {"self_ref": "#/furniture", "children": [{"$ref": "#/t/2"}]},
    }
    rows = formats.layout_blocks(spark.createDataFrame([("d", json.dumps(doc))], "doc_id string, layout string")).orderBy("block_ordinal").collect()
    assert [(r.block_type, r.text, r.role) for r in rows] == [(H, "1.2 Methods", "body"), ("table", "Table 1", "asset"), (P_, "Body", "body"), (P_, "foot", "furniture")]
    assert (rows[0].level, rows[0].page_start, rows[0].page_end) == (2, 2, 3)
    assert formats.parse_layout(json.dumps({k: v for k, v in doc.items() if k != "body"}))["fallback"]


def test_mat_and_strain(spark):
    y, x = np.meshgrid(np.linspace(0, 1, 16), np.linspace(0, 1, 18), indexing="ij")
    content = formats.write_mat({"phase": y + x})
    name, value = formats.single_matrix(content)
    assert name == "phase" and np.allclose(value, y + x) and formats.inspect_mat(content) == [{"name": "phase", "shape": [16, 18], "dtype": "float64"}]
    with pytest.raises(ValueError):
        formats.single_matrix(formats.write_mat({"a": value, "b": value}))
    cells = formats.mat_grid(spark.createDataFrame([("m", bytearray(content))], "path string, content binary"))
    out = G.as_rows(G.vector_strain(cells, 3, 3, 1)).orderBy("r").collect()
    got = np.array([r.row for r in out])
    assert got.shape == (13, 16)
    want = (1 / 15) * 840e-9 / (4 * np.pi) * 1e3 / (840e-9**2 / 50e-9)
    hole = np.zeros((13, 16), bool)
    hole[0, 0] = True
    assert np.allclose(got[~hole], want, rtol=1e-6) and got[0, 0] == 0
