from random import Random

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from quirework.llm import simhash_dedup as S


def brute_fp(text, k):
    words = (text or "").encode().translate(S.LOWER).split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius=4):
    root = list(range(len(fps)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(fps))]


def near(random, fp, n):
    for b in random.sample(range(64), n):
        fp ^= 1 << b
    return fp


def test_fingerprints_match_brute_force():
    random = Random(1)
    texts = ["", "a", "A b C", "x " * 50, "é Ü ß\x0bzz\r\n q"] + [" ".join(random.choices("ab cd ef gh ij kl".split(), k=random.randint(1, 90))) for _ in range(40)]
    for text in texts:
        for k in (4, 5):
            assert S.fingerprint(text.encode(), k) == brute_fp(text, k)


def test_large_bucket_matches_brute_force():
    random = Random(2)
    for size in (33, 200, 500):
        centres = [random.getrandbits(64) for _ in range(5)]
        fps = [near(random, random.choice(centres), random.randint(0, 6)) for _ in range(size)] + [random.getrandbits(64) for _ in range(20)]
        want = brute_components(fps)
        got = S.components_of_bucket(np.array(fps, np.uint64), 4).tolist()
        assert [got[g] for g in got] == got
        assert got == want


def test_tables_hold_every_pair_within_the_radius():
    random = Random(3)
    for n in (10, 10**6, 10**9, 10**12):
        tables = S.tables_for(n)
        for _ in range(200):
            a = random.getrandbits(64)
            b = near(random, a, 4)
            assert any(all((a ^ b) >> s & ((1 << w) - 1) == 0 for s, w in t) for t in tables)


def test_near_duplicates(spark):
    random = Random(4)
    words = [f"w{k}" for k in range(300)]
    base = [" ".join(random.choices(words, k=120)) for _ in range(20)]
    texts = base + [b + " tail" for b in base[:10]] + base[:5] + [None, "", "  \n", "one", "One"]
    rows = [(100 - k, t, "x", k) for k, t in enumerate(texts)] + [(None, base[0], "n", 0), (None, "only null id here", "n", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, root int").repartition(5)
    got = {(r.doc_id, r.fp): r.component_id for r in S.near_duplicates(docs, 4).collect()}
    fps = [brute_fp(t, 4) for _, t, _, _ in rows]
    root = brute_components(fps)
    for (i, _, _, _), fp, r in zip(rows, fps, root):
        members = [rows[k][0] for k in range(len(rows)) if root[k] == r and rows[k][0] is not None]
        assert got[(i, int(np.uint64(fp).astype(np.int64)))] == min(members, default=None)
    kept = S.keep_one(docs, 4, radius=4)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(root))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(docs).count() == 0 and S.keep_one(docs).count() == 0


@pytest.mark.parametrize("edges", [[(1, 2), (2, 3), (5, 9), (9, 7), (3, 10)], [(k, k + 1) for k in range(40)], []])
def test_components(spark, edges):
    got = dict(map(tuple, S.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    for a, b in edges:
        assert got.get(a, a) == got.get(b, b)
    assert all(got.get(r, r) == r and r < n for n, r in got.items())


def test_wide_buckets_match_brute_force():
    random = Random(7)
    centres = [[random.getrandbits(64) for _ in range(6)] for _ in range(6)]
    fps = [[near(random, w, random.randint(0, 10)) for w in random.choice(centres)] for _ in range(150)] + [[random.getrandbits(64) for _ in range(6)] for _ in range(30)]
    distance = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(a, b))
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if distance(fps[i], fps[j]) <= 60:
                a, b = S._root(root, i), S._root(root, j)
                root[max(a, b)] = min(a, b)
    want = [S._root(root, k) for k in range(len(fps))]
    array = np.array(fps, np.uint64)
    assert S.components_of_bucket(array, 60).tolist() == want
    keys = np.zeros(len(fps), np.int64)
    a, b = S.links_of_rows(keys, array, 60, 1024)
    got = list(range(len(fps)))
    for x, y in zip(a, b):
        got[x] = y
    assert got == want


def test_similar_texts_are_grouped_and_others_are_not(spark):
    random = Random(8)
    vocab = [f"w{k}" for k in range(3000)]
    base = [random.choices(vocab, k=random.randint(150, 400)) for _ in range(150)]

    def edited(words, n):
        words = list(words)
        for k in random.sample(range(len(words)), n):
            words[k] = "edit"
        return words

    def jaccard(a, b):
        a, b = ({tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in (a, b))
        return len(a & b) / len(a | b)

    close = [edited(b, max(1, len(b) // 90)) for b in base]
    far = [edited(b, len(b) // 6) for b in base]
    rows = [(k, " ".join(w)) for k, w in enumerate(base + close + far)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    root = {r.doc_id: r.root for r in S.similar_groups(docs).collect()}
    near_pairs = [k for k in range(150) if jaccard(base[k], close[k]) >= 0.82]
    assert len(near_pairs) > 100
    assert sum(root[k] == root[150 + k] for k in near_pairs) >= 0.97 * len(near_pairs)
    assert all(jaccard(base[k], far[k]) < 0.6 for k in range(150))
    assert sum(root[k] == root[300 + k] for k in range(150)) <= 2
    assert len({root[k] for k in range(150)}) == 150
    kept = {r.doc_id for r in S.keep_one(docs).collect()}
    assert set(range(150)) <= kept


def pairs_of_similarity(at_least, below, n, seed):
    """Pairs of texts whose sets of five-word shingles have a Jaccard similarity in a range."""
    random, out = Random(seed), []
    while len(out) < n:
        size = random.randint(150, 400)
        a = [f"w{random.randrange(10**6)}" for _ in range(size)]
        b = list(a)
        for k in random.sample(range(size), random.randint(1, size // 20)):
            b[k] = "edit"
        x, y = ({tuple(w[k : k + 5]) for k in range(size - 4)} for w in (a, b))
        if at_least <= len(x & y) / len(x | y) < below:
            out.append((" ".join(a), " ".join(b)))
    return out


def grouped(spark, pairs):
    rows = [(2 * k + j, t) for k, p in enumerate(pairs) for j, t in enumerate(p)]
    root = {r.doc_id: r.root for r in S.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    return [root[2 * k] == root[2 * k + 1] for k in range(len(pairs))]


def test_links_end_at_the_similarity(spark):
    close, far = pairs_of_similarity(0.8, 0.82, 150, 9), pairs_of_similarity(0.75, 0.8, 150, 10)
    got = grouped(spark, close + far)
    assert sum(got[:150]) >= 149
    assert not any(got[150:])


def test_components_of_sets_match_brute_force():
    random, sets = Random(11), []
    for _ in range(12):
        base = random.sample(range(10**6), 60)
        for _ in range(random.randint(1, 9)):
            base = base[random.randint(0, 8) :] + random.sample(range(10**6), random.randint(0, 8))
            sets.append(np.unique(np.array(base, np.uint64)))
    random.shuffle(sets)
    sets += [np.zeros(0, np.uint64), np.arange(5, dtype=np.uint64), np.arange(4, dtype=np.uint64)]
    root = list(range(len(sets)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if len(np.union1d(x, y)) and 5 * len(np.intersect1d(x, y)) >= 4 * len(np.union1d(x, y)):
                a, b = S._root(root, i), S._root(root, j)
                root[max(a, b)] = min(a, b)
    assert S.components_of_sets(sets, 0.8).tolist() == [S._root(root, k) for k in range(len(sets))]


def test_links_are_the_same_at_every_size(spark, monkeypatch):
    pairs = pairs_of_similarity(0.75, 0.8, 60, 12) + pairs_of_similarity(0.8, 0.82, 60, 13)
    small, sized = grouped(spark, pairs), S.bands_for
    monkeypatch.setattr(S, "bands_for", lambda n, *rest: sized(10**7, *rest))
    large = grouped(spark, pairs)
    assert not any(small[:60] + large[:60])
    assert sum(small[60:]) >= 59 and sum(large[60:]) >= 59


def test_large_groups_are_confirmed_in_parts(spark, monkeypatch):
    random = Random(14)
    vocab = [f"v{k}" for k in range(5000)]

    def edited(words, n):
        words = list(words)
        for k in random.sample(range(len(words)), n):
            words[k] = random.choice(vocab)
        return words

    texts = []
    for _ in range(3):  # chains of edits: near neighbours are alike, distant ones are not
        words = random.choices(vocab, k=120)
        for _ in range(20):
            texts.append(words := edited(words, random.randint(1, 4)))
    base = random.choices(vocab, k=200)
    texts += [edited(base, random.randint(0, 8)) for _ in range(50)] + [random.choices(vocab, k=80) for _ in range(10)]
    random.shuffle(texts)
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string").repartition(3)
    sets = [S.shingle_hashes(" ".join(w).encode(), 5) for w in texts]
    want = S.components_of_sets(sets, 0.8).tolist()
    groups = lambda root: sorted(sorted(k for k in range(len(texts)) if root[k] == r) for r in set(root))
    plain = {r.doc_id: r.root for r in S.similar_groups(docs).collect()}
    monkeypatch.setattr(S, "MOST_MEMBERS", 5)
    monkeypatch.setattr(S, "PART", 7)
    monkeypatch.setattr(S, "PIVOTS", 10)
    split = {r.doc_id: r.root for r in S.similar_groups(docs).collect()}
    assert groups([split[k] for k in range(len(texts))]) == groups([plain[k] for k in range(len(texts))]) == groups(want)


def test_components_that_take_too_long_are_an_error(spark):
    with pytest.raises(RuntimeError):
        S.components(spark.createDataFrame([(k, k + 1) for k in range(60)], "a long, b long"), most_rounds=1)


def test_hubs_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(S, "MOST_SHARED", 5)
    monkeypatch.setattr(S, "FEW_EDGES", 0)
    edges = [(0, k) for k in range(1, 40)] + [(100, k) for k in range(41, 80)] + [(39, 41), (200, 201), (201, 202)]
    got = dict(map(tuple, S.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {got.get(k, k) for k in (*range(80), 100) if k != 40} == {0} and got[201] == got[202] == 200


def test_few_pairs_are_missed_by_the_bits_that_are_compared():
    from math import comb

    for n in (1000, 260_000, 10**7):
        radius, bits, p = S.bands_for(n, 0.8)[2], 64 * S.COMPARED, S.odd_bits(0.8)
        assert sum(comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(radius + 1, bits + 1)) <= 0.0013
        assert S.COMPARED < S.WORDS


def test_workers_give_freed_arrow_memory_back(spark):
    import pyarrow as pa

    S.prepare_workers(spark)

    def run(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([pa.default_memory_pool().backend_name])], ["name"])

    assert {r.name for r in spark.range(3).mapInArrow(run, "name string").collect()} == {"system"}


def test_near_copies_are_not_linked_anew_in_each_band(spark, monkeypatch):
    random = Random(15)
    vocab = [f"v{k}" for k in range(5000)]
    base = random.choices(vocab, k=300)
    texts = [list(base) for _ in range(400)] + [random.choices(vocab, k=80) for _ in range(100)]
    for words in texts[:400]:
        for k in random.sample(range(300), random.randint(1, 8)):
            words[k] = random.choice(vocab)
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string").repartition(3)
    counts, plain = [], S.components

    def counted(edges, *rest):
        edges = S.written(edges, "counted")
        counts.append(edges.count())
        return plain(edges, *rest)

    monkeypatch.setattr(S, "components", counted)
    got = {r.doc_id: r.root for r in S.similar_groups(docs).collect()}
    few = sum(counts)
    assert few < 3 * 400
    counts.clear()
    monkeypatch.setattr(S, "AHEAD", 1, raising=False)  # all bands at once
    assert {r.doc_id: r.root for r in S.similar_groups(docs).collect()} == got
    assert sum(counts) > 3 * few
    want = S.components_of_sets([S.shingle_hashes(" ".join(w).encode(), 5) for w in texts], 0.8).tolist()
    groups = lambda root: sorted(sorted(k for k in range(len(texts)) if root[k] == r) for r in set(root))
    assert groups([got[k] for k in range(len(texts))]) == groups(want)
