"""Research over several sources: clarify, brief, topics, queries, sources, notes, report."""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor, wait
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.vocabulary import ITEM_PREFIXES, VAGUE_REQUESTS
from ..operators import sets
from . import prompts
from .config import Settings
from .models import Chat

RESULT = "source string, query_no int, rank int, title string, url string, content string"
CONTENT = 6000


class Source(Protocol):
    """Results of a batch of queries (query_no, query), with the columns of RESULT."""

    name: str

    def search(self, queries: DataFrame, most: int) -> DataFrame: ...


class TableSource:
    """Texts of a table that hold most of a query's words, best first."""

    def __init__(self, name: str, rows: DataFrame, title: str, url: str, content: str):
        self.name = name
        self.rows = rows.select(F.col(title).cast("string").alias("title"), F.col(url).cast("string").alias("url"), F.col(content).alias("content"))

    def search(self, queries: DataFrame, most: int) -> DataFrame:
        from pyspark.sql import Window

        from ..functions.text import token_set

        asked = queries.select("query_no", F.explode(token_set("query")).alias("w"))
        texts = self.rows.withColumn("w", F.explode(token_set("content")))
        hits = texts.join(asked, "w").groupBy("query_no", "title", "url", "content").agg(F.count(F.lit(1)).alias("n"))
        by = Window.partitionBy("query_no").orderBy(F.desc("n"), "url")
        ranked = hits.withColumn("rank", F.row_number().over(by) - 1).where(F.col("rank") < most)
        return ranked.select(F.lit(self.name).alias("source"), F.col("query_no").cast("int").alias("query_no"), F.col("rank").cast("int").alias("rank"), "title", "url", F.substring("content", 1, CONTENT).alias("content"))


class EmptySource:
    def __init__(self, name: str, spark: SparkSession):
        self.name, self.spark = name, spark

    def search(self, queries: DataFrame, most: int) -> DataFrame:
        return self.spark.createDataFrame([], RESULT)


class FailedSource:
    """What stands for a source that can't be reached: one result that says so for each query."""

    def __init__(self, name: str, reason: str):
        self.name, self.reason = name, reason

    def search(self, queries: DataFrame, most: int) -> DataFrame:
        return queries.select(F.lit(self.name).alias("source"), F.col("query_no").cast("int").alias("query_no"), F.lit(0).alias("rank"), F.lit("unavailable").alias("title"), F.lit("").alias("url"), F.lit(self.reason).alias("content"))


def search_all(spark: SparkSession, queries: list[str], sources: list[Source], most: int = 3) -> DataFrame:
    """Results of all sources for all queries, equal ones once."""
    asked = spark.createDataFrame(list(enumerate(queries)), "query_no int, query string")
    return sets.merged_sources(*(s.search(asked, most) for s in sources))


def material(results: list[dict]) -> str:
    if not results:
        return "没有检索到可用资料。"
    return "\n\n---\n\n".join(f"Source {n}\nProvider: {r['source']}\nTitle: {r['title']}\nURL: {r['url']}\nContent: {r['content']}" for n, r in enumerate(results, 1))


def items(text: str, most: int) -> list[str]:
    """Lines without bullets, numbers and quotes; without any, sentences."""
    bare = (re.sub(r"^\s*(?:[-*•]|\d+[.)、])\s*", "", line).strip().strip("\"'` ") for line in text.splitlines())
    found = [b for b in bare if b and not b.startswith(ITEM_PREFIXES)]
    return (found or [p.strip() for p in re.split(r"[。；;\n]+", text) if p.strip()])[:most]


def is_vague(text: str) -> bool:
    bare = re.sub(r"^(?:deep\s*research|deep_research)[:：]?", "", text.strip(), flags=re.I).strip()
    return bare.lower() in VAGUE_REQUESTS or len(bare) <= 3


@dataclass
class Research:
    pending: bool = False
    question: str = ""
    brief: str = ""
    topics: list[str] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)
    report: str = ""


def _said(chat: Chat, messages, fallback: str) -> str:
    try:
        return chat.generate(messages).strip() or fallback
    except Exception as e:
        return f"{fallback}\n\n({e})" if fallback else ""


def note_on(spark: SparkSession, topic: str, sources: list[Source], chat: Chat, s: Settings) -> str:
    asked = items(_said(chat, prompts.queries(topic), topic), s.research_queries) or [topic]
    found = [r.asDict() for r in search_all(spark, asked, sources, s.research_results).orderBy("source_no", "query_no", "rank").collect()]
    text = material(found)
    return _said(chat, prompts.compress(topic, text), f"研究子问题“{topic}”\n\n原始资料：\n{text}")


def run(spark: SparkSession, text: str, sources: list[Source], chat: Chat, s: Settings | None = None, pending: bool = False) -> Research:
    """Research on a request; a vague one asks back. Topics run side by side and are given up after the time limit."""
    s = s or Settings()
    if not pending and is_vague(text):
        return Research(pending=True, question=f"您希望我围绕“{text.strip() or '这个主题'}”具体研究哪个方向？")
    out = Research(brief=text.strip())
    out.topics = items(_said(chat, prompts.plan(out.brief), out.brief), s.research_topics) or [out.brief]
    pool = ThreadPoolExecutor(max_workers=len(out.topics))
    group = f"research-{id(out)}"

    def one(topic: str) -> str:
        spark.sparkContext.setJobGroup(group, topic, interruptOnCancel=True)
        return note_on(spark, topic, sources, chat, s)

    jobs = [pool.submit(one, t) for t in out.topics]
    wait(jobs, timeout=s.research_timeout_s)
    late = [j for j in jobs if not j.done()]
    if late:
        spark.sparkContext.cancelJobGroup(group)
    pool.shutdown(wait=False, cancel_futures=True)
    out.notes = [j.result() if j not in late and not j.exception() else f"研究子问题“{t}”未能按时完成。" for t, j in zip(out.topics, jobs)]
    notes = "\n\n".join(out.notes)
    out.report = _said(chat, prompts.report(out.brief, notes), f"## Deep Research 研究笔记\n\n{notes}")
    return out
