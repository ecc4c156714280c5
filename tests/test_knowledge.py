import json

import pytest

from quirework.__main__ import parser
from quirework.plans import answer, assistant, research
from quirework.plans.config import overlay, settings
from quirework.plans.knowledge import KnowledgeBase
from quirework.plans.models import HashedEmbedder, ScriptedChat, structured
from quirework.sources import formats
from quirework.sources.results import Registry
from quirework.streaming import continuous


@pytest.fixture()
def folder(tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "first.md").write_text("# Paper Title\n\n## Abstract\nWe measure strain by phase.\n\n## Methods\nThe vector method averages windows of the phase signal.\n")
    (docs / "copy.md").write_text((docs / "first.md").read_text())
    (docs / "note.txt").write_text("Gardening needs water and light.\n\nTomatoes like warm days.")
    (docs / "skip.md").write_text("# Other")
    (docs / "image.png").write_bytes(b"x")
    return tmp_path


def test_ingest_and_retrieve(spark, folder):
    kb = KnowledgeBase(spark, f"file://{folder}/store", settings({}, use_hyde=False, parent_chunk_min_tokens=1))
    assert kb.is_empty() and set(kb.status().values()) == {0}
    dry = kb.ingest([f"{folder}/docs"], exclude=["skip.md"], dry_run=True)
    assert kb.is_empty() and dry["counters"]["documents"] == 2
    done = kb.ingest([f"{folder}/docs"], exclude=["skip.md"])
    assert done["statuses"] == {"pending": 2, "duplicate:duplicate_content_hash": 1, "excluded:unsupported_extension": 1, "excluded:matched_exclude_rule": 1, "new": 2}
    status = kb.status()
    assert status["documents"] == 2 and status["parent_chunks"] >= 2 and status["child_chunks"] == status["child_vectors"]
    found = kb.retrieve("vector method phase windows")
    assert "vector method" in found["documents"][0]["text"] and found["citations"][0]["citation_id"] == "S1"
    again = kb.ingest([f"{folder}/docs"], exclude=["skip.md"])
    assert again["statuses"]["unchanged"] == 2 and kb.status() == status
    (folder / "docs/note.txt").write_text("Something new about tomatoes.")
    assert kb.ingest([f"{folder}/docs"], exclude=["skip.md"])["statuses"]["changed"] == 1
    assert kb.status()["documents"] == 2 and kb.retrieve("new tomatoes")["documents"][0]["text"].startswith("Something new")
    chat = ScriptedChat(lambda m: "the phase windows of the vector method")
    kb.s.use_hyde = True
    assert len(kb.retrieve("how is it done", chat)["documents"]) >= 1
    doc = kb.store.table("documents").first().doc_id
    kb.delete([doc])
    assert kb.status()["documents"] == 1


def test_stream(spark, folder):
    kb = KnowledgeBase(spark, f"file://{folder}/store2", settings({}, parent_chunk_min_tokens=1))
    for _ in range(2):
        continuous.ingest_stream(kb, f"{folder}/docs", f"file://{folder}/check").awaitTermination()
    assert kb.status()["documents"] == 3


class Fixed:
    def __init__(self, *found):
        self.found, self.asked = list(found), []

    def retrieve(self, query):
        self.asked.append(query)
        docs = self.found[min(len(self.asked), len(self.found)) - 1]
        return {"documents": docs, "citations": [{"citation_id": "S1", "title": "T", "section": "A", "page": "3"}] if docs else []}


def grader(relevant="yes", grounded="yes", useful="yes"):
    def reply(messages):
        system = messages[0]["content"]
        if "rewritten_question" in system:
            return '{"rewritten_question": "better"}'
        for mark, value in (("helps to answer", relevant), ("supports", grounded), ("answers the question. Answer", useful)):
            if mark in system:
                return json.dumps({"binary_score": value, "reason": "r"})
        return "an answer"

    return ScriptedChat(reply)


def test_answer_loop():
    doc = [{"text": "d", "citation_id": "S1"}]
    retriever = Fixed([], doc)
    state = answer.run("q", retriever, grader())
    assert retriever.asked == ["q", "better"] and state.generation == "an answer" and state.error is None
    assert "[S1] T（A，页码 3）" in answer.message(state)
    assert "maximum retrieval" in answer.run("q", Fixed([]), grader()).error
    state = answer.run("q", Fixed(doc), grader(grounded="no"))
    assert state.generations == 2 and "not grounded" in state.error
    assert "did not answer" in answer.run("q", Fixed(doc), grader(useful="no")).error
    broken = ScriptedChat(lambda m: 1 / 0)
    assert answer.run("q", Fixed(doc), broken).error.startswith("generation failed")
    assert answer.gate(True, "", broken)[0] is False and answer.gate(False, "", broken)[0] is True


def test_loop_edges_as_columns(spark):
    rows = assistant.literal_states(spark, [("x", 1, 0, True, True, 1), (None, 1, 0, True, True, 1), (None, 0, 1, False, None, 1), (None, 0, 2, False, None, 2), (None, 0, 0, True, False, 1), (None, 0, 2, True, False, 1)]).collect()
    assert [r.after_documents for r in rows] == ["end", "generate", "transform_query", "end", "transform_query", "end"]
    assert [r.after_generation for r in rows] == ["end", "end", "generate", "end", "transform_query", "end"]


def test_research(spark):
    pages = spark.createDataFrame([("a", "http://a", "strain imaging of tissue"), ("b", "http://b", "gardens"), ("a2", "http://a", "strain again")], "title string, url string, text string")
    sources = [research.TableSource("web", pages, "title", "url", "text"), research.EmptySource("library", spark), research.FailedSource("down", "no key")]
    found = research.search_all(spark, ["strain tissue", "gardens"], sources).collect()
    assert sorted((r.source, r.url) for r in found) == [("down", ""), ("web", "http://a"), ("web", "http://b")]
    assert research.run(spark, "研究", sources, ScriptedChat(lambda m: "x")).pending
    chat = ScriptedChat(lambda m: "1. strain\n2. gardens" if "topics" in m[0]["content"] else "strain tissue" if "queries" in m[0]["content"] else "notes" if "Condense" in m[0]["content"] else "the report")
    done = research.run(spark, "strain in tissue and gardens", sources, chat)
    assert done.topics == ["strain", "gardens"] and done.notes == ["notes", "notes"] and done.report == "the report"


def test_assistant_memory_and_tools(spark, tmp_path):
    memory = assistant.Memory(str(tmp_path / "memory.json"))
    assert assistant.memory_command("记住：喜欢茶", memory) == "已记住：喜欢茶"
    assert "喜欢茶" in assistant.memory_command("查看记忆", memory) and memory.forget("") == 0
    assert assistant.memory_command("忘记茶", memory) == "已删除 1 条相关记忆。" and assistant.memory_command("hello", memory) is None
    registry = Registry(str(tmp_path / "data"))
    import numpy as np

    path = tmp_path / "m x.mat"
    path.write_bytes(formats.write_mat({"p": np.add.outer(np.linspace(0.1, 1, 40), np.linspace(0.1, 1, 40))}))
    up = registry.register_upload(str(path))
    tools = assistant.StrainTools(spark, registry, bnn=type("M", (), {"infer": lambda self, m, n: np.stack([m + k for k in range(n)])})())
    run = registry.run_folder("strain_estimation")
    ok = json.loads(tools.run("vector", run, file_ids=[up["file_id"]], Nx=3, Nz=3))
    assert ok["success"] and ok["outputs"]["strain"]["shape"] == [37, 38]
    assert registry.array(ok["result_id"])["shape"] == [37, 38] and registry.recover({"path": registry.get(ok["result_id"]).path}).result_id == ok["result_id"]
    with pytest.raises(ValueError):
        registry.recover({"path": "/etc/passwd"})
    bnn = json.loads(tools.run("bnn", run, file_ids=[up["file_id"]], MC_test=3))
    assert bnn["outputs"]["epistemic_uncertainty"]["shape"] == [32, 32]
    assert json.loads(tools.run("cnn", run, file_ids=[up["file_id"]]))["error_type"] == "model_unavailable"
    assert json.loads(tools.run("vector", run, path="/x"))["error_type"] == "invalid_input"
    bot = assistant.Assistant(spark, None, ScriptedChat(lambda m: "hi"), memory, tools=tools)
    assert bot.route(assistant.Turn("x", requested="chat")) == "chat" and bot.route(assistant.Turn("查看记忆")) == "chat" and bot.route(assistant.Turn("hello")) == "self_rag"
    messages = [{"role": "user", "content": str(k)} for k in range(25)]
    assert assistant.summarized(messages, {}, ScriptedChat(lambda m: "s")) == {"conversation_summary": "s", "summary_message_count": 19}
    assert assistant.summarized(messages[:10], {}, ScriptedChat(lambda m: "s")) == {}


def test_settings_models_cli():
    assert settings({"QUIREWORK_USE_HYDE": "no", "QUIREWORK_FINAL_K": "3"}).final_k == 3 and not settings({"QUIREWORK_USE_HYDE": "no"}).use_hyde
    assert overlay({"a": 1, "b": 2}, {"a": None, "b": 3}) == {"a": 1, "b": 3}
    assert structured(ScriptedChat(lambda m: 'so {"n": 2}'), [], lambda d: d["n"], lambda: 0) == 2 and structured(ScriptedChat(lambda m: "no"), [], lambda d: d["n"], lambda: 0) == 0
    assert abs(sum(x * x for x in HashedEmbedder().embed(["a b c"])[0]) - 1) < 1e-9
    args = parser().parse_args(["ingest", "--dataset", "x", "--dry-run", "--no-recursive"])
    assert args.dry_run and args.no_recursive and args.dataset == ["x"]


def test_pdf_with_sidecars(spark, tmp_path):
    docs = tmp_path / "papers"
    docs.mkdir()
    for name in ("both", "tree", "tei", "broken", "alone"):
        (docs / f"{name}.pdf").write_bytes(b"%PDF-1.4 " + name.encode())
    item = lambda n, label, text: {"self_ref": f"#/texts/{n}", "label": label, "text": text, "prov": [{"page_no": n + 1}]}
    texts = [item(0, "section_header", "1. Methods"), item(1, "text", "We average windows of the phase signal to measure strain."), item(2, "section_header", "Results"), item(3, "text", "The error of the measured strain stays below one percent.")]
    layout = json.dumps({"body": {"children": [{"$ref": t["self_ref"]} for t in texts]}, "texts": texts})
    tei = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>Strain by Phase</title></titleStmt></fileDesc></teiHeader><text><body>
    <div><head>Methods</head><p>Windows of the phase are averaged.</p><div><head>Results</head><p>Errors are below one percent of the strain.</p></div></div></body>
    <back><listBibl><biblStruct xml:id="b0"><title>An Older Paper</title><date when="2001"/></biblStruct></listBibl></back></text></TEI>"""
    for name in ("both", "tree", "broken"):
        (docs / f"{name}.layout.json").write_text(layout)
    for name in ("both", "tei"):
        (docs / f"{name}.tei.xml").write_text(tei)
    (docs / "broken.tei.xml").write_text("<TEI")
    kb = KnowledgeBase(spark, f"file://{tmp_path}/store", settings({}, use_hyde=False, parent_chunk_min_tokens=1))
    done = kb.ingest([str(docs)])
    assert done["statuses"]["failed:no_layout_or_tei"] == 1 and done["statuses"]["new"] == 4
    found = {r.source_path.rsplit("/", 1)[1]: r for r in kb.store.table("documents").collect()}
    assert {n: r.parser for n, r in found.items()} == {"both.pdf": "layout+tei", "tree.pdf": "layout", "tei.pdf": "tei", "broken.pdf": "layout"}
    assert found["both.pdf"].title == found["tei.pdf"].title == "Strain by Phase" and found["tree.pdf"].file_type == "pdf"
    paths = {}
    for r in kb.store.table("parent_chunks").collect():
        paths.setdefault(r.source_path.rsplit("/", 1)[1], set()).add(r.section_path)
    assert paths["both.pdf"] == paths["tei.pdf"] == {"Methods", "Methods > Results"}
    assert paths["tree.pdf"] == paths["broken.pdf"] == {"1. Methods", "1. Methods > Results"}
    assert sorted((r.label, r.title, r.year) for r in kb.store.table("references").collect()) == [("b0", "An Older Paper", "2001")] * 2
    assert kb.ingest([str(docs)])["statuses"] == {**{k: n for k, n in done["statuses"].items() if k != "new"}, "unchanged": 4}
