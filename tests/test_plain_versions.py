"""Operators whose queries have no SQL, against plain Python over whole documents; a store that fails midway."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from quirework.functions import text as X
from quirework.plans import queries_text as Q
from quirework.plans.knowledge import KnowledgeBase

SF = "/root/testdata/sf0.001"
SPACE = "[ \t\n\x0b\f\r\x85\xa0  -     　]"


def strip(text):
    return re.sub(f"^{SPACE}+|{SPACE}+$", "", text)


def test_scientific_text_of_every_document(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r.clean for r in Q.txt_03_scientific(spark, SF).collect()}
    assert got.keys() == texts.keys()
    for k, text in texts.items():
        plain = unicodedata.normalize("NFKC", text + "\ninter-\n national  x")
        plain = re.sub(rf"([A-Za-z])-{SPACE}*\n{SPACE}*([a-z])", r"\1\2", plain)
        assert got[k] == strip(re.sub("\n{3,}", "\n\n", re.sub("[ \t]+", " ", plain))), k


def test_list_items_of_every_document(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r["items"] for r in Q.txt_31_list_items(spark, SF).collect()}
    assert got.keys() == texts.keys()
    from quirework.functions import vocabulary as V

    for k, text in texts.items():
        lines = re.split("\r\n|[\n\r]", re.sub("(?m)^", "- ", text))
        bare = [strip(re.sub(rf"^{SPACE}*(?:[-*•]|[0-9]+[.)、]){SPACE}*", "", x)).strip("\"'` ") for x in lines]
        items = [x for x in bare if x and not re.match("|".join(V.ITEM_PREFIXES), x)]
        if items:
            assert got[k] == items[:3], k


@pytest.mark.parametrize("overlap", [0, 7])
def test_pieces_are_those_of_a_plain_splitter(spark, overlap):
    """Units of paragraphs and sentences, packed greedily; tokens are counted anew for each candidate piece."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60)
    units = rows.select("doc_id", X.boundary_units(X.normalize_space("text"), 40).alias("u"), X.split_text("text", 40, overlap).alias("p"), X.estimated_tokens(X.normalize_space("text")).alias("n"))
    token = re.compile(r"[㐀-䶿一-鿿豈-﫿]|[A-Za-z0-9]+(?:[-_'][A-Za-z0-9]+)*|\S")
    count = lambda t: len(token.findall(t))

    def joined(a, b):
        a, b = strip(a), strip(b)
        if not a or not b:
            return a or b
        return a + b if a[-1] in "。！？；.!?;" or b[0] in "，。！？；：、,.!?;:%)]}" or re.match(r"[㐀-䶿一-鿿豈-﫿]", b) or re.search(r"[㐀-䶿一-鿿豈-﫿]$", a) else f"{a} {b}"

    seen = 0
    for r in units.collect():
        if r.n <= 40 or overlap:
            assert all(count(p.text) <= 40 for p in r.p)
            continue
        pieces, now = [], ""
        for unit in r.u:
            longer = joined(now, unit.text) if now else unit.text
            if now and count(longer) > 40:
                pieces.append(strip(now))
                now = unit.text
            else:
                now = longer
        assert [p.text for p in r.p] == pieces + [strip(now)]
        seen += 1
    assert overlap or seen > 20


def test_a_failed_ingest_leaves_the_old_snapshot(spark, tmp_path, monkeypatch):
    data = tmp_path / "data"
    data.mkdir()
    (data / "a.md").write_text("# One\n\nThe first text has a few plain words about interference and phase.")
    kb = KnowledgeBase(spark, str(tmp_path / "kb"))
    kb.ingest([str(data)])
    before, snapshot = kb.status(), kb.store.current()
    (data / "b.md").write_text("# Two\n\nThe second text has other words about strain and displacement fields.")

    def fails(*_):
        raise RuntimeError("killed")

    for where in ("parsed", "write_index"):
        for reset in (False, True):
            with monkeypatch.context() as m:
                m.setattr(KnowledgeBase, where, fails)
                with pytest.raises(RuntimeError):
                    kb.ingest([str(data)], reset=reset)
            assert kb.store.current() == snapshot and kb.status() == before
    kb.ingest([str(data)], reset=True)
    assert kb.status()["documents"] == 2 and kb.store.current() != snapshot
    asked = spark.createDataFrame([(1, "strain displacement")], "query_id long, question string")
    assert kb.hits(asked).count() > 0
    (data / "a.md").unlink()
    (data / "b.md").unlink()
    kb.ingest([str(data)], reset=True)
    assert kb.is_empty()
