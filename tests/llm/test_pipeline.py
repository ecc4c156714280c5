"""The pipeline's stages, each against a plain version of what it keeps."""

import hashlib

import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from quirework.llm import decontaminate, language_id, quality_rules

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    """What each stage was given and what it kept."""
    out, docs = {}, spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("p") / name)
        stage(spark, docs, SF).write.parquet(path)
        kept = spark.read.parquet(path)
        out[name] = (docs.collect(), kept.collect(), kept.columns)
        docs = kept
    return out


def test_columns_and_rows(staged):
    for name, (given, kept, columns) in staged.items():
        assert len(kept) <= len(given) and kept
        if name != "encoding":
            assert columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert set(kept) <= set(given)


def test_language_and_quality(spark, staged):
    given, kept, _ = staged["language_id"]
    docs = spark.createDataFrame(given)
    verdict = language_id.predict(docs, language_id.fit(docs)).collect()
    assert {r.doc_id for r in kept} == {r.doc_id for r in verdict if r.lang_pred != "und" and not r.ambiguous}
    given, kept, _ = staged["quality_rules"]
    verdict = {r.doc_id for r in quality_rules.judge(spark.createDataFrame(given)).where("kept").collect()}
    assert {r.doc_id for r in kept} == verdict


def test_near_dedup(staged):
    given, kept, _ = staged["near_dedup"]

    def shingles(text):
        w = text.lower().encode().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    sets = [shingles(r.text) for r in given]
    root = list(range(len(sets)))

    def find(k):
        return k if root[k] == k else find(root[k])

    for i, x in enumerate(sets):
        for j in range(i):
            if len(x & sets[j]) >= 0.8 * len(x | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    # of each group of the plain version, the smallest id is left
    want = {min(r.doc_id for k, r in enumerate(given) if find(k) == g) for g in set(map(find, range(len(sets))))}
    assert {r.doc_id for r in kept} == want


def test_defined_cases(spark, tmp_path):
    """Nulls, empty texts, repeated rows and clashing columns pass every stage; an empty table gives an empty one."""
    good = "The quick brown fox jumps over the lazy dog and runs to the old mill by the river while it is still light outside today .\n"
    rows = [(1, None, None, "a", None, 1), (2, "", "en", "a", 0, 1), (None, good + "one more line of words here", "en", None, 5, 1), (3, "other words " + good * 2 + " and the rest of this text goes on about the weather in spring", "en", "a", 1, 1), (4, good, None, "a", 1, 1), (4, good, None, "a", 1, 1), (5, "12 34 !!", "fr", "b", 1, 1), (6, good + "and le mot " * 30_000, "en", "b", 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, q int").repartition(2)
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), SF)
        assert empty.count() == 0 and (name == "encoding" or empty.columns == docs.columns)
        kept = stage(spark, docs, SF)
        if name != "encoding":
            assert kept.columns == docs.columns and set(kept.collect()) <= {tuple(r) for r in docs.collect()}
        if name == "language_id":
            assert {r.doc_id for r in kept.collect()} >= {None, 3, 4} and not kept.where("doc_id in (1, 2, 5)").count()
        if name == "near_dedup":
            assert kept.where("doc_id = 4").count() == 1 and kept.where("doc_id in (1, 2)").count() == 1 and kept.where("doc_id is null or doc_id in (3, 6)").count() == 3
        if name == "encoding":
            assert kept.count() == len(rows)


def test_decontamination_and_encoding(spark, staged):
    given, kept, _ = staged["decontamination"]
    match = decontaminate.Matcher([(r.item_id, (r.text or "").encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()], 10)
    assert {r.doc_id for r in kept} == {r.doc_id for r in given if not match.spans(decontaminate.words_of((r.text or "").encode()))[0]}
    given, kept, _ = staged["encoding"]
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    t = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    by = {r.doc_id: r for r in kept}
    for r in given:
        assert by[r.doc_id].n_tokens == len(t.encode_ordinary(r.text)) and by[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
