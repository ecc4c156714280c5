import hashlib
import re
from random import Random

from quirework.llm import decontaminate as D


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    patterns = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            patterns.setdefault(tuple(w[k : k + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(p) for p in patterns}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in patterns:
                    hit |= set(range(k, k + n))
                    found |= patterns[tuple(w[k : k + n])]
        ids = ",".join(sorted(map(str, found - {None})))
        out.append((doc, len(w), len(hit), len(found - {None}), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def case(seed):
    random = Random(seed)
    vocab = [random.choice(["a", "b", "É", "zz9", "The", "of"]) + str(random.randint(0, 3)) for _ in range(8)]
    text = lambda n: random.choice([" ", ", ", "-\n"]).join(random.choices(vocab, k=n))
    items = [(k, text(random.choice([0, 1, 3, 9, 10, 12, 40]) if seed % 2 else random.randint(10, 40))) for k in range(12)] + [(99, None), (3, text(15)), (None, text(14))]
    docs = [(k, text(random.randint(0, 300)) + (" " + (random.choice(items)[1] or "") + " ") + text(5)) for k in range(40)] + [(7, None), (8, ""), (7, None), (None, text(50))]
    return docs, items


def test_brute_force(spark):
    for seed in (1, 2, 3):
        docs, items = case(seed)
        d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
        want = brute(docs, items)
        for block in (D.BLOCK_BYTES, 200):
            got = sorted((tuple(r) for r in D.contamination(d, b, block_bytes=block).collect()), key=str)
            assert got == want
        kept = sorted((tuple(r) for r in D.cut_out(d, b).collect()), key=str)
        clean = {(x[0], x[1]) for x in want if not x[5]}
        assert {(i, len(words(t))) for i, t in kept} == clean


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c", 5)], "doc_id long, text string, spans int")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:4] for r in D.contamination(docs, none).collect()] == [(1, 3, 0, 0)]
    assert D.contamination(docs.limit(0), none).count() == 0
    assert D.cut_out(docs, none).columns == docs.columns
