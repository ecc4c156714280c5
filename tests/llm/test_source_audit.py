"""The audit against a plain version that forms every probability."""

import random
import re
from collections import Counter, defaultdict

import pytest

from quirework.llm import source_audit as A

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least_docs, top):
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(FOLD))) for lang, source, text in rows]
    df, n = defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in docs:
        df[lang].update(set(terms))
        n[lang, source].update(terms)
    out = []
    for lang in df:
        kept = sorted(t for t, k in df[lang].items() if k >= least_docs)
        own = {s: {t: c[t] for t in kept} for (x, s), c in n.items() if x == lang}
        share = lambda c, total: 1 + A.SCALE * (c + 5) // (total + 5 * len(kept))
        p = {s: {t: share(c, sum(counts.values())) for t, c in counts.items()} for s, counts in own.items()}
        total = sum(sum(c.values()) for c in own.values())
        q = {t: share(sum(c[t] for c in own.values()), total) for t in kept}
        for s in own:
            pairs = [(r, sum(abs(p[s][t] - p[r][t]) for t in kept)) for r in own if r != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                items = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, rank) for rank, (item, value) in enumerate(items, 1)]
    return sorted(out)


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["Ab", "ab", "É", "é", "x1y", "über", "ZZ", "z　z", "日本", *(f"w{chr(97 + k)}" for k in range(20))]
    rows = []
    for _ in range(n):
        lang, source = rng.choice(["en", "fr", None, "xx"]), rng.choice(["s1", "s2", None, "hot", "hot", "hot", "é"])
        rows.append((lang, source, rng.choice([None, "", "12 3"]) if rng.random() < 0.1 or lang == "xx" else " ".join(rng.choices(words[rng.randrange(9) :], k=rng.randrange(1, 30)))))
    return rows + rows[:10]


def audit(spark, rows, **options):
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "lang string, source string, text string, n int, term string, rank int").repartition(3)
    found = A.audit(docs, **options)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(map(tuple, found.collect()))


@pytest.mark.parametrize("options", [{}, {"most_sent": 0}])
def test_equals_the_plain_version(spark, options):
    rows = corpus(1, 150)
    assert audit(spark, rows, least_docs=5, top=4, **options) == plain(rows, 5, 4)


def test_blocks_of_sources(spark, monkeypatch):
    monkeypatch.setattr(A, "BLOCK", 2)
    rows = corpus(2, 80)
    assert audit(spark, rows, least_docs=2, top=3) == plain(rows, 2, 3)


def test_ties_go_to_the_smaller_item_and_stay_open(spark):
    # many terms of equal difference: buckets whose bound equals the bar have to be opened
    rows = [("en", "a", " ".join(f"t{x}{y}" for x in "abcdefgh" for y in "abcdefgh"))] * 2 + [("en", "b", "other words " * 3)] * 4
    rows += [("en", "a", "tab tab tab"), ("en", "b", "tab")]
    assert audit(spark, rows, least_docs=2, top=5) == plain(rows, 2, 5)


def test_defined_cases(spark):
    assert audit(spark, []) == []
    assert audit(spark, [(None, None, None)]) == []
    rows = [("en", "a", "one two"), ("en", "b", None), ("en", None, "1 2")]
    assert audit(spark, rows) == plain(rows, 30, 50) and len(plain(rows, 30, 50)) == 6
    assert audit(spark, rows, least_docs=1) == plain(rows, 1, 50)


def test_long_texts(spark):
    rows = [("en", "a", "long text " * 150_000), ("en", "b", "x" * 3_000_000), ("en", "a", "text"), ("en", "b", "é" * 700_000 + " text")]
    assert audit(spark, rows, least_docs=1, top=2) == plain(rows, 1, 2)


def test_words_in_steps(monkeypatch):
    rng = random.Random(3)
    for step in (1, 2, 7, 50):
        monkeypatch.setattr(A, "STEP", step)
        for _ in range(50):
            text = "".join(rng.choices("aZé日 1\n", k=rng.randrange(60)))
            assert [w.decode() for some in A.words(text.encode()) for w in some] == TERM.findall(text.translate(FOLD))


def test_division_is_exact(spark):
    from pyspark.sql import functions as F

    rng = random.Random(4)
    rows = [(5, 5), (10**12, 10**12 + 7), *((rng.randrange(10**k), rng.randrange(1, 10 ** min(15, k + 1))) for k in range(1, 16) for _ in range(5))]
    rows = [(a, max(a, b)) for a, b in rows]
    found = spark.createDataFrame(rows, "a long, b long").select("a", "b", A.scaled(F.col("a"), F.col("b")).alias("p")).collect()
    assert all(r.p == 1 + A.SCALE * r.a // r.b for r in found)
