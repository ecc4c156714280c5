import zlib

import numpy as np
import pytest

from quirework.llm import language_id as L


def test_codewords_are_apart():
    for k in (2, 3, 4, 6, 9, 30):
        code = L.codewords(k)
        assert len({tuple(r) for r in code.tolist()}) == k
        columns = [tuple(c) for c in code.T.tolist()]
        assert all(len(set(c)) == 2 for c in columns)
    assert min(int((a != b).sum()) for i, a in enumerate(L.codewords(4)) for b in L.codewords(4)[:i]) == 4


def test_margins_match_a_plain_sum(monkeypatch):
    counts = np.random.default_rng(1).integers(0, 50, (4, 1 << L.BITS)).astype(float)
    model = L.Model(list("abcd"), counts)
    texts = [b"", b"a", "Été à la plage, 12 fois".encode(), b"hello world " * 300]
    plain = []
    for t in texts:
        data = np.frombuffer(L.folded(t), np.uint8)
        h = np.concatenate(L.hashes(data))
        plain.append(model.weights[h].sum(0, dtype=float) / max(1, len(h)))
    assert np.allclose(model.margins(texts)[0], plain)
    monkeypatch.setattr(L, "STEP", 16)
    assert np.allclose(model.margins(texts)[0], plain)


def test_margins_of_small_texts_before_a_huge_one(monkeypatch):
    model = L.Model(list("abcd"), np.random.default_rng(2).integers(0, 50, (4, 1 << L.BITS)).astype(float))
    monkeypatch.setattr(L, "STEP", 64)
    texts = [b"one small text", b"another one", b"some long words here " * 40, b"the last", b"x" * 62, b"y" * 63, b""]
    margin, n = model.margins(texts)
    for t, m, count in zip(texts, margin, n):
        h = np.concatenate(L.hashes(np.frombuffer(L.folded(t), np.uint8)))
        assert count == len(h)
        assert np.allclose(m, model.weights[h].sum(0, dtype=float) / max(1, len(h)))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = L.held_out_prediction(docs).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    right = sum(r.lang_pred == truth[r.doc_id] for r in held)
    assert right >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_defined_cases(spark):
    rows = [(1, "the cat and the dog of the house", "en", 0), (2, "le chat et la maison des amis", "fr", 0), (3, None, "en", 0), (4, "", None, 0), (5, "12 34 ...", "fr", 0), (6, "Ünique", None, 0), (None, "the and of", "en", 0), (6, "Ünique", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    model = L.fit(docs)
    got = {(r.doc_id, r.lang_pred) for r in L.predict(docs, model).collect()}
    assert {(3, "und"), (4, "und"), (5, "und"), (1, "en"), (2, "fr"), (None, "en")} <= got
    kept = L.filter_documents(docs, model)
    assert kept.columns == docs.columns and kept.count() == 5
    assert L.predict(docs, L.fit(docs.limit(0))).where("lang_pred <> 'und'").count() == 0
    one = L.fit(docs.where("lang = 'en'"))
    assert {r.lang_pred for r in L.predict(docs.where("doc_id < 3"), one).collect()} == {"en"}
    assert L.held_out_prediction(docs.limit(0)).count() == 0


@pytest.mark.parametrize("text,want", [("", False), ("12 .", False), ("a", True), ("é", True), ("١٢", False), ("中", True), ("€ × ÷", False), ("." * 100 + "x", True)])
def test_has_letter(text, want):
    assert L.has_letter(text.encode()) is want
