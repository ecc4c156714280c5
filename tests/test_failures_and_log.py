"""Files that can't be read, and the store as a log of segments."""

import io
import json
import os
import zipfile

import pytest

from quirework.operators import bm25
from quirework.plans.config import settings
from quirework.plans.knowledge import KnowledgeBase
from quirework.sources.store import Conflict, Store

SCHEMAS = {"documents": "doc_id string, text string, created_at int", "child_chunks": "child_id string, doc_id string, text string"}
KEYS = {"documents": "doc_id", "child_chunks": "child_id"}
KEPT = {"documents": ("created_at",)}


def docx(body: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def names(rows):
    return {r.path.rsplit("/", 1)[1]: r for r in rows.collect()}


def test_broken_files_fail_alone(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "good.md").write_text("# Good\n\nA good text about strain and phase.")
    (docs / "good.docx").write_bytes(docx("<w:p><w:r><w:t>Displacement fields are measured.</w:t></w:r></w:p>"))
    (docs / "latin.txt").write_bytes("Größe und Länge".encode("latin-1"))
    (docs / "zip.docx").write_bytes(b"no archive")
    (docs / "tree.docx").write_bytes(docx("<w:p>"))
    for name in ("layout", "both", "tei", "lone"):
        (docs / f"{name}.pdf").write_bytes(b"%PDF " + name.encode())
    (docs / "layout.layout.json").write_text("{broken")
    (docs / "both.layout.json").write_bytes(b"\xff\xfe")
    (docs / "both.tei.xml").write_text("<TEI")
    item = {"self_ref": "#/texts/0", "label": "text", "text": "Windows of the phase are averaged over the field.", "prov": [{"page_no": 1}]}
    (docs / "tei.tei.xml").write_text("<TEI")
    (docs / "tei.layout.json").write_text(json.dumps({"body": {"children": [{"$ref": "#/texts/0"}]}, "texts": [item]}))
    (docs / "other.csv").write_bytes(b"\xff")
    kb = KnowledgeBase(spark, f"file://{tmp_path}/store", settings({}, use_hyde=False, parent_chunk_min_tokens=1))
    dry = kb.ingest([str(docs)], dry_run=True)["statuses"]
    done = kb.ingest([str(docs)])["statuses"]
    assert done == dry == {"pending": 9, "excluded:unsupported_extension": 6, "new": 3, "failed:not_utf8": 1, "failed:bad_docx": 2, "failed:bad_layout_or_tei": 2, "failed:no_layout_or_tei": 1}
    assert {r.source_path.rsplit("/", 1)[1] for r in kb.store.table("documents").collect()} == {"good.md", "good.docx", "tei.pdf"}
    failed = names(kb.failures())
    assert set(failed) == {"latin.txt", "zip.docx", "tree.docx", "layout.pdf", "both.pdf", "lone.pdf"}
    assert "BadZipFile" in failed["zip.docx"].message and "ParseError" in failed["tree.docx"].message and failed["zip.docx"].file_type == "docx"
    assert "layout: JSONDecodeError" in failed["layout.pdf"].message and failed["both.pdf"].message.startswith("layout: not UTF-8; tei: ParseError")
    assert os.listdir(tmp_path / "store/staging") == []
    # mended files leave the failures, a good file that breaks keeps its document
    (docs / "latin.txt").write_text("Größe und Länge")
    (docs / "good.docx").write_bytes(b"broken now")
    again = kb.ingest([str(docs)])["statuses"]
    assert again["new"] == 1 and again["failed:bad_docx"] == 3 and again["unchanged"] == 2 and "changed" not in again
    assert kb.status()["documents"] == 4 and set(names(kb.failures())) == {"good.docx", "zip.docx", "tree.docx", "layout.pdf", "both.pdf", "lone.pdf"}


def test_an_error_leaves_no_staging_and_no_segment(spark, tmp_path, monkeypatch):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.md").write_text("# A\n\nSome text.")
    kb = KnowledgeBase(spark, f"file://{tmp_path}/store", settings({}, parent_chunk_min_tokens=1))

    def fails(*_):
        raise RuntimeError("killed")

    monkeypatch.setattr(KnowledgeBase, "write_index", fails)
    with pytest.raises(RuntimeError):
        kb.ingest([str(docs)])
    assert os.listdir(tmp_path / "store/staging") == [] and os.listdir(tmp_path / "store/segments") == [] and kb.is_empty()


def files_of(folder):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(folder) for f in fs}


def test_one_file_writes_its_own_rows_only(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    for k in range(6):
        (docs / f"{k}.md").write_text(f"# Title {k}\n\nText number {k} speaks of strain, phase and word{k}.")
    kb = KnowledgeBase(spark, f"file://{tmp_path}/store", settings({}, use_hyde=False, parent_chunk_min_tokens=1, segments_before_compaction=99))
    kb.ingest([str(docs)])
    before, first = files_of(tmp_path / "store"), kb.store.current()
    (docs / "new.md").write_text("# New\n\nA new text of strain.")
    (docs / "3.md").write_text("# Title 3\n\nThe third text is another one now.")
    assert kb.ingest([str(docs)])["statuses"]["changed"] == 1
    after = files_of(tmp_path / "store")
    assert all(after.get(f) == t for f, t in before.items())  # nothing old is written again
    segments = kb.store.segments()
    assert len(segments) == 2 and segments[1]["rows"]["documents"] == 2 and segments[1]["gone"]["documents"] == 1
    # scores are those of an index built anew, before and after compaction
    asked = spark.createDataFrame([(1, "strain text"), (2, "word3 phase"), (3, "third another word1")], "query_id long, question string")

    def found(index):
        from quirework.functions import text as X

        words = X.search_tokens("question", kb.s.tokenizer, [], kb.s.cjk_bigrams)
        return sorted((r.query_id, r.doc_key, round(r.score, 9)) for r in bm25.scores(index, asked, "query_id", words).collect())

    want = found(bm25.build(kb.store.table("child_chunks"), "child_id", kb._tokens(), keep=False))
    assert found(kb.lexical_index()) == want and len(want) > 6
    rows = {n: sorted(map(str, t.collect())) for n, t in kb.store.tables().items()}
    kb.store.compact(index=kb.write_index, whole=True)
    assert len(kb.store.segments()) == 1 and not kb.store.segments()[0]["gone"]
    assert found(kb.lexical_index()) == want and {n: sorted(map(str, t.collect())) for n, t in kb.store.tables().items()} == rows
    assert kb.store.table("documents", first).count() == 6  # the first version is still there
    removed = kb.store.vacuum(keep=1)
    assert len(removed) == 2 and {n: sorted(map(str, t.collect())) for n, t in kb.store.tables().items()} == rows and len(kb.store.versions()) == 1


def test_log_against_a_dictionary(spark, tmp_path):
    import random

    rng = random.Random(7)
    store = Store(spark, f"file://{tmp_path}/log", SCHEMAS, KEYS, KEPT)
    docs, kids = {}, {}
    assert store.current() is None and store.table("documents").collect() == []
    for step in range(12):
        if step % 4 == 3:
            gone = rng.sample(sorted(docs), min(3, len(docs)))
            store.delete(spark.createDataFrame([(d,) for d in gone], "doc_id string"))
            docs = {d: v for d, v in docs.items() if d not in gone}
            kids = {k: v for k, v in kids.items() if v[0] not in gone}
        else:
            new = {f"d{rng.randrange(12)}": (f"text {step}", step) for _ in range(4)}
            more = {f"k{rng.randrange(20)}": (d, f"kid {step}") for d in new}
            old = rng.sample(sorted(docs), min(1, len(docs)))
            store.add({"documents": spark.createDataFrame([(d, *v) for d, v in new.items()], SCHEMAS["documents"]), "child_chunks": spark.createDataFrame([(k, *v) for k, v in more.items()], SCHEMAS["child_chunks"])}, without=spark.createDataFrame([(d,) for d in old], "doc_id string"))
            docs = {d: v for d, v in docs.items() if d not in old}
            kids = {k: v for k, v in kids.items() if v[0] not in old}
            docs |= {d: (t, docs[d][1] if d in docs else n) for d, (t, n) in new.items()}
            kids |= more
        if step % 3 == 2:
            store.compact(least=2)
        if step == 8:
            store.vacuum()
        got = {r.doc_id: (r.text, r.created_at) for r in store.table("documents").collect()}
        assert got == docs and store.table("documents").count() == len(docs), step
        assert {r.child_id: (r.doc_id, r.text) for r in store.table("child_chunks").collect()} == kids, step
    assert len(store.segments()) < 8
    store.reset()
    assert store.table("documents").collect() == [] and store.segments() == []


def test_an_overtaken_change_fails(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/log", SCHEMAS, KEYS, KEPT)
    row = lambda d: {"documents": spark.createDataFrame([(d, "t", 1)], SCHEMAS["documents"])}
    store.add(row("a"))
    version, seen = store.current(), store.segments()
    store.add(row("b"))
    with pytest.raises(Conflict):
        store.commit(row("c"), {}, None, seen, version)
    assert {r.doc_id for r in store.table("documents").collect()} == {"a", "b"} and len(os.listdir(tmp_path / "log/segments")) == 2
