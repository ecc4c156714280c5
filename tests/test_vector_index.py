"""The vector index against a scan of all vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirework.operators import dense, vector_index as V
from quirework.plans.config import settings
from quirework.plans.knowledge import KnowledgeBase

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def clusters():
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(30, 20))
    v = (middle[rng.integers(30, size=3000)] + 0.15 * rng.normal(size=(3000, 20))).astype(np.float32)
    v[2000:2400] = v[7]  # a large group of copies
    return v


def table(spark, v, parts=4):
    rows = [(k, x.tolist(), k % 3) for k, x in enumerate(v)]
    return spark.createDataFrame(rows + [(10**6, None, 1)], SCHEMA).repartition(parts)


def built(spark, vectors, folder, **options):
    V.write(vectors, V.train(vectors, **options), folder)
    return V.read(spark, folder)


def pairs(found):
    return {(r.query_id, r.vec_id, r.rank) for r in found.collect()}


def test_exact_and_approximate(spark, tmp_path, clusters):
    vectors = table(spark, clusters).cache()
    index = built(spark, vectors, f"file://{tmp_path}/v")
    assert index.vectors.count() == 3000 and len(index.books.centres) == 54 and index.books.probes < 30
    asked = vectors.where("vec_id % 40 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    want = pairs(dense.nearest(vectors, asked, 25))
    assert pairs(V.search(index, asked, 25, exact=True)) == want and len(want) == 75 * 25
    # even with one list and few candidates in the first pass the exact result is whole
    assert pairs(V.search(index, asked, 25, probes=1, candidates=25, exact=True)) == want
    near = {(q, v) for q, v, _ in pairs(V.search(index, asked, 25))}
    assert len(near & {(q, v) for q, v, _ in want}) >= 0.95 * len(want)


def test_filter_delete_get(spark, tmp_path, clusters):
    vectors = table(spark, clusters[:600]).cache()
    index = built(spark, vectors, f"file://{tmp_path}/v", lists=7)
    asked = vectors.where("vec_id < 12").select(F.col("vec_id").alias("query_id"), "embedding")
    gone = vectors.where("vec_id % 5 = 0").select("vec_id")
    live = vectors.where("label = 1 and vec_id % 5 <> 0")
    assert pairs(V.search(index, asked, 9, exact=True, where=F.col("label") == 1, gone=gone)) == pairs(dense.nearest(live, asked, 9))
    got = V.get(index, spark.createDataFrame([(3,), (5,), (5,), (10**9,)], "vec_id long"))
    assert got.columns == ["vec_id", "embedding", "label"] and sorted(r.vec_id for r in got.collect()) == [3, 5]


def test_small_and_empty(spark, tmp_path, clusters):
    few = table(spark, clusters[:3])
    index = built(spark, few, f"file://{tmp_path}/few")
    asked = few.select(F.col("vec_id").alias("query_id"), "embedding")
    assert pairs(V.search(index, asked, 25, exact=True)) == pairs(dense.nearest(few, asked, 25)) and V.search(index, asked, 25).count() == 9
    assert V.search(index, asked.limit(0), 5).collect() == []
    none = built(spark, few.limit(0), f"file://{tmp_path}/none")
    assert V.search(none, asked, 5).collect() == [] and V.search(none, asked, 5, exact=True).collect() == []


def test_knowledge_base_searches_indexed_and_small_segments(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    for k in range(12):
        (docs / f"{k}.md").write_text(f"# Title {k}\n\nText {k} of {'strain phase window field mesh noise'.split()[k % 6]} and {'alpha beta gamma'.split()[k % 3]}.")
    kb = KnowledgeBase(spark, f"file://{tmp_path}/store", settings({}, use_hyde=False, parent_chunk_min_tokens=1, vectors_before_index=8, exact_neighbours=True))
    kb.ingest([str(docs)])
    (docs / "3.md").write_text("# Title 3\n\nAnother text of gamma noise.")
    (docs / "12.md").write_text("# Title 12\n\nText 12 of strain and beta.")
    kb.ingest([str(docs)])
    assert [bool(s.get("vectors")) for s in kb.store.segments()] == [True, False]
    asked = kb.store.table("child_vectors").select(F.xxhash64("child_id").alias("query_id"), "embedding")
    rows = kb.store.table("child_vectors").select(F.xxhash64("child_id").alias("vec_id"), "child_id", "embedding")
    want = dense.nearest(rows, asked, 5).join(rows.select("vec_id", "child_id"), "vec_id")
    assert {(r.query_id, r.rank, round(r.score, 9)) for r in kb.near(asked, 5).collect()} == {(r.query_id, r.rank, round(r.score, 9)) for r in want.collect()}
    assert {r.doc_key for r in kb.near(asked, 99).collect()} == {r.child_id for r in rows.collect()}
    found = kb.retrieve("gamma noise")
    assert any("Another text" in d["text"] for d in found["documents"])


def test_search_joins_and_broadcasts_nothing(spark):
    """Candidates are ranked where their vectors are."""
    import numpy as np

    from quirework.operators import vector_index as V

    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rng.normal(size=(300, 8)))], "vec_id long, embedding array<double>")
    books = V.train(rows, lists=6, parts=4, k=5)
    lists = V.encoded(rows, books)
    index = V.Index(books, lists, lists.groupBy("list").agg({"reach": "max"}).withColumnRenamed("max(reach)", "reach"))
    asked = rows.where("vec_id < 9").withColumnRenamed("vec_id", "query_id")
    plan = V.search(index, asked, 5, exact=True)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan and "WindowGroupLimit" in plan
