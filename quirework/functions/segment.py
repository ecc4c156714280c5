"""Words of Chinese texts: the most probable way through the graph of a dictionary's words.

A frequency table (word, n) is given, or learnt from texts by `learnt_words`. A run of CJK characters is cut where the
product of its words' frequencies is highest; a character that no word begins with stands alone with the least
frequency. Of equally probable ways the one with the longer words first is taken. The table is sent to the workers if
it has at most MOST_WORDS words (an error otherwise: a dictionary is no corpus).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from . import vocabulary as V

MOST_WORDS, LONGEST = 1_000_000, 8


class Graph:
    """A dictionary's words with the logarithms of their shares, and all their beginnings."""

    def __init__(self, counts: dict[str, int]):
        total = math.log(max(1, sum(max(1, n) for n in counts.values())))
        self.share = {w: math.log(max(1, n)) - total for w, n in counts.items() if w}
        self.alone = -total
        self.beginnings = {w[:k] for w in self.share for k in range(1, len(w) + 1)}
        self.runs = re.compile(f"[{V.py(V.CJK)}]+")

    def cut(self, run: str) -> list[str]:
        """The words of a run of characters."""
        n = len(run)
        best = [(0.0, n)] * (n + 1)
        for at in range(n - 1, -1, -1):
            ways, stop = [(self.share.get(run[at], self.alone) + best[at + 1][0], at + 1)], at + 1
            while stop < n and run[at : stop] in self.beginnings:
                stop += 1
                if (found := self.share.get(run[at:stop])) is not None:
                    ways.append((found + best[stop][0], stop))
            best[at] = max(ways)
        out, at = [], 0
        while at < n:
            out.append(run[at : best[at][1]])
            at = best[at][1]
        return out

    def words(self, text: str, inner: bool = False) -> list[str]:
        """The words of all runs of CJK characters of a text; inner: before each word the dictionary's words of two, then three characters inside it."""
        out = []
        for word in (w for run in self.runs.findall(text) for w in self.cut(run)):
            for size in (2, 3) if inner else ():
                if len(word) > size:
                    out += [p for k in range(len(word) - size + 1) if (p := word[k : k + size]) in self.share]
            out.append(word)
        return out


def chinese_words(text: Column | str, frequencies: DataFrame, inner: bool = False) -> Column:
    """array<string>: the words of a text's CJK runs, in order; other characters give none. Null gives none."""
    from ..sources.formats import prepare_workers

    spark = frequencies.sparkSession
    prepare_workers(spark)
    rows = frequencies.select("word", "n").limit(MOST_WORDS + 1).collect()
    if len(rows) > MOST_WORDS:
        raise ValueError(f"a dictionary of more than {MOST_WORDS} words")
    sent = spark.sparkContext.broadcast({r.word: r.n for r in rows if r.word})

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        graph = Graph(sent.value)
        for batch in batches:
            yield batch.map(lambda x: graph.words(x or "", inner))

    text = F.col(text) if isinstance(text, str) else text
    # texts without such characters don't leave the JVM
    return F.when(F.coalesce(text.rlike(f"[{V.CJK}]"), F.lit(False)), run(text)).otherwise(F.array().cast("array<string>"))


def learnt_words(docs: DataFrame, text_col: str = "text", least: int = 5, longest: int = 4, cohesion: float = 8.0) -> DataFrame:
    """word, n: characters, and runs of two to ``longest`` that occur ``least`` times and hang together.

    A run hangs together if it is at least ``cohesion`` times as frequent as each of its cuts in two would be by chance.
    """
    run = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"[{V.CJK}]+"), F.lit(0))).alias("run")
    at = "sequence(1, length(run))"
    pieces = F.expr(f"flatten(transform({at}, i -> transform(sequence(1, least({longest}, length(run) - i + 1)), k -> substring(run, i, k))))")
    counts = docs.select(run).select(F.explode(pieces).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= least) | (F.length("word") == 1))
    total = counts.where(F.length("word") == 1).agg(F.sum("n").alias("total"))
    cuts = counts.where(F.length("word") > 1).select("word", "n", F.explode(F.expr("sequence(1, length(word) - 1)")).alias("k"))
    part = lambda name: counts.select(F.col("word").alias(name), F.col("n").alias(f"{name}_n"))
    cuts = cuts.select("word", "n", F.expr("substring(word, 1, k)").alias("a"), F.expr("substring(word, k + 1)").alias("b")).join(part("a"), "a").join(part("b"), "b")
    # one row with the number of characters beside each cut
    held = cuts.crossJoin(F.broadcast(total)).groupBy("word", "n").agg(F.min(F.col("n") * F.col("total") / (F.col("a_n") * F.col("b_n"))).alias("held"))
    return counts.where(F.length("word") == 1).unionByName(held.where(F.col("held") >= cohesion).select("word", "n"))


def search_tokens_by_words(text: Column | str, frequencies: DataFrame, terms: list[str] | None = None, bigrams: bool = True) -> Column:
    """The bag of search terms of `text.search_tokens`, with the words of Chinese runs, and those inside them, in place of their single characters."""
    from .text import cjk_bigrams, domain_terms, normalize_space

    def bag(clean: Column) -> Column:
        words = F.regexp_extract_all(F.lower(clean), F.lit(V.WORD), F.lit(0))
        parts = [words, domain_terms(clean, terms or []), chinese_words(clean, frequencies, True)] + ([cjk_bigrams(clean)] if bigrams else [])
        return F.filter(F.concat(*parts), lambda t: t != "")

    return bag(normalize_space(text))  # no lambda holds a Python function
