import re
from collections import Counter
from random import Random

import pytest
from pyspark.sql import functions as F

from quirework.llm import quality_rules as Q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    times, inside = Counter(windows), set()
    for k, w in enumerate(windows):
        if times[w] > 1:
            inside |= set(range(k, k + 5))
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), failed


def test_counts_match_brute_force(spark):
    random = Random(1)
    texts = [None, "", " \n\t", "a", "#*$", "a b c d e a b c d e", "one\n\none\n \none", "x\x1cy\x85z\xa0 🙂 ﬀ $", "a " * 3000]
    for _ in range(150):
        vocab = [random.choice(["a", "bb", "ü", "c|", "😀", "z."]) + str(random.randint(0, random.choice([0, 3, 50]))) for _ in range(30)]
        texts.append("".join(random.choice(vocab) + random.choice([" ", " ", "\n", "\x0b\x0c", "\r\n"]) for _ in range(random.randint(0, 120))))
    rows = [(k, t, 5) for k, t in enumerate(texts)] + [(None, "null id " * 9, 1), (3, "a", 1), (3, "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    got = sorted((tuple(r)[:7] for r in Q.judge(docs).collect()), key=str)
    assert got == sorted(((i, *brute(t)) for i, t, _ in rows), key=str)
    kept = Q.filter_documents(docs)
    assert kept.columns == docs.columns
    assert kept.count() == Q.judge(docs).where("kept").count()
    assert Q.judge(docs.limit(0)).count() == 0 and Q.filter_documents(docs.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = docs.select(Q.measures(F.col("text")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_expectation_maximisation_finds_the_accuracies():
    random = Random(2)
    truth = [(random.uniform(0.6, 0.95), random.uniform(0.85, 0.99)) for _ in Q.RULES]
    counts: Counter = Counter()
    good_of: Counter = Counter()
    for _ in range(40_000):
        good = random.random() < 0.8
        votes = tuple(0 if random.random() < 0.2 else (1 if random.random() < g else -1) if good else (-1 if random.random() < b else 1) for b, g in truth)
        counts[votes] += 1
        good_of[votes] += good
    model = Q.fit(counts)
    assert model.prior == pytest.approx(0.8, abs=0.03)
    for (b, g), (b2, g2) in zip(truth, model.accuracy):
        assert b == pytest.approx(b2, abs=0.06) and g == pytest.approx(g2, abs=0.03)
    right = sum(good_of[v] if model.posterior(v) >= 0.5 else c - good_of[v] for v, c in counts.items())
    assert right > 0.95 * 40_000


def test_posterior_column_matches_the_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    measured = docs.select("doc_id", Q.measures(F.col("text")).alias("q")).cache()
    model = Q.fit(Q.vote_counts(measured, "q"))
    votes = Q.rules(F.col("q"))
    for r in measured.select(Q.posterior(F.col("q"), model).alias("p"), *(votes[n].alias(n) for n in Q.RULES)).collect():
        assert r.p == pytest.approx(model.posterior(tuple(r[1:])), abs=1e-8)
