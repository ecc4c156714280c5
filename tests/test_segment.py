"""The most probable words against all ways to cut."""

import itertools
import math
import random

from pyspark.sql import functions as F

from quirework.functions import segment as S, text as X
from quirework.plans.config import settings
from quirework.plans.knowledge import KnowledgeBase

COUNTS = {"北京": 50, "大学": 40, "北京大学": 30, "学生": 25, "大学生": 20, "生活": 30, "活动": 15, "京": 3, "生": 8, "相位": 20, "应变": 25, "测量": 30, "位": 2}


def ways(run):
    for k in range(len(run)):
        for cuts in itertools.combinations(range(1, len(run)), k):
            yield [run[a:b] for a, b in zip((0, *cuts), (*cuts, len(run)))]


def test_best_of_all_ways():
    graph, total = S.Graph(COUNTS), math.log(sum(COUNTS.values()))
    rng = random.Random(1)
    score = lambda words: sum(math.log(COUNTS[w]) - total if w in COUNTS else -total if len(w) == 1 else -math.inf for w in words)
    for _ in range(300):
        run = "".join(rng.choices("北京大学生活动相位应变测量子", k=rng.randrange(1, 10)))
        assert math.isclose(score(graph.cut(run)), max(map(score, ways(run)))) and "".join(graph.cut(run)) == run
    assert graph.cut("北京大学生活动") == ["北京", "大学生", "活动"] or score(graph.cut("北京大学生活动")) >= score(["北京大学", "生活", "动"])
    assert S.Graph(COUNTS | {"北京大学": 10**6}).words("在北京大学", inner=True) == ["在", "北京", "大学", "北京大学"]
    assert S.Graph({}).cut("北京") == ["北", "京"]


def test_columns_and_index(spark, tmp_path):
    table = spark.createDataFrame(list(COUNTS.items()), "word string, n long")
    rows = spark.createDataFrame([(1, "测量 strain 的应变 and 相位。"), (2, "plain words"), (3, None), (4, "")], "id long, text string")
    found = {r.id: r for r in rows.select("id", S.chinese_words("text", table).alias("w"), S.search_tokens_by_words("text", table).alias("b")).collect()}
    assert found[1].w == ["测量", "的", "应变", "相位"] and found[2].w == found[3].w == found[4].w == []
    assert set(found[1].b) == {"strain", "and", "测量", "的", "应变", "相位", "的应"} and found[2].b == ["plain", "words"]
    kb = KnowledgeBase(spark, f"file://{tmp_path}/store", settings({}, use_hyde=False, parent_chunk_min_tokens=1, word_frequencies_path=f"{tmp_path}/words"))
    table.write.parquet(f"{tmp_path}/words")
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/a.md").write_text("# 测量\n\n相位的测量给出应变。")
    kb.ingest([f"{tmp_path}/docs"])
    terms = {r.term for r in kb.lexical_index().terms.collect()}
    assert {"测量", "相位", "应变"} <= terms and "测" not in terms and kb.retrieve("应变测量")["documents"]
    plain = rows.select("id", X.search_tokens("text").alias("b")).where("id = 2").first().b
    assert found[2].b == plain


def test_learnt(spark):
    rng = random.Random(3)
    words = ["相位", "应变", "测量", "散斑"]
    texts = ["".join(rng.choice(words) if rng.random() < 0.6 else rng.choice("的和在了是有不人这中上个国我以要他时来用们生到作") for _ in range(12)) for _ in range(400)]
    table = S.learnt_words(spark.createDataFrame([(t,) for t in texts] + [(None,), ("no such",)], "text string"))
    found = {r.word: r.n for r in table.where(F.length("word") > 1).collect()}
    assert set(words) <= set(found) and len(found) < 40 and found["相位"] == sum(t.count("相位") for t in texts)
    graph = S.Graph({r.word: r.n for r in table.collect()})
    assert graph.cut("应变的测量和相位") == ["应变", "的", "测量", "和", "相位"]
