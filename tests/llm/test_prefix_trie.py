"""The trie against a plain one that keeps every sequence of turns."""

import random
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest

from quirework.llm import prefix_trie as T


def plain(rows, group=100, most=6):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % most
        base = c - (abs(c) % group) * (1 if c >= 0 else -1)
        built[c] = own.get(base, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    below = {}
    for path in sorted(members, key=len, reverse=True):
        saved = (len(members[path]) - 1) * (len(path[-1][1]) if path else 0)
        leaves = 0 if children[path] else 1
        below[path] = (leaves + sum(below[p][0] for p in children[path]), saved + sum(below[p][1] for p in children[path]))
    out = []
    for path, convs in members.items():
        ends = ",".join(str(c) for c in convs if len(built[c]) == len(path))
        out.append((convs[0], len(path), members[path[:-1]][0] if path else None, len(convs), len(children[path]), *below[path], sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def digest(role, text):
    return sha256(f"{len(role)}:{role}:{text}".encode()).digest()[:16]


def trie(spark, rows, parts=3, **options):
    table = spark.createDataFrame([(*r, 5, b"x") for r in rows], "conv_id long, turn int, role string, text string, depth int, node binary").repartition(parts)
    found = T.trie(table, **options)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, found.collect()), key=str)


def conversations(seed, n):
    rng = random.Random(seed)
    said = ["a", "b", "", None, "long " * 20, "é日"]
    rows = []
    for c in rng.sample(range(-250, 450), n):
        for t in range(rng.choice([1, 2, 3, 8, 12])):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "user", None]), rng.choice(said[: rng.choice([1, 2, 6])])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_the_plain_version(spark, seed):
    rows = conversations(seed, 150)
    assert trie(spark, rows) == plain(rows)


def test_a_conversation_over_many_tasks(spark):
    rows = [(7, t, "user", f"t{t}") for t in range(3000)] + [(8, t, "user", f"t{t}" if t < 1700 else "else") for t in range(2500)] + [(200, t, "u", "x") for t in range(3)]
    rows += [(c, t, "u", "x") for c in range(300, 320) for t in range(c % 7)] + [(9, 5, "user", "same")] * 40
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert trie(spark, rows, parts=8, most=3) == plain(rows, most=3)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_copies_and_small_texts_of_ids(spark, monkeypatch):
    monkeypatch.setattr(T, "TEXT", 40)
    rows = [(c, t, "user", "hello"[: t + 1]) for c in range(1000, 1300) for t in range(7)]
    assert trie(spark, rows) == plain(rows)


def test_defined_cases(spark):
    assert trie(spark, []) == []
    assert trie(spark, [(None, 1, "user", "x")]) == []
    # one turn, all of which is replaced by turns of a conversation that isn't there: it ends at the root
    turnless = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6)
    assert trie(spark, [(turnless, 1, "user", "x")]) == [(turnless, 0, None, 1, 0, 1, 0, sha256(str(turnless).encode()).hexdigest())]
    rows = [(100, None, None, None), (100, 1, "u", "x" * 1_000_000), (101, 1, "u", "x"), (101, 1, "u", "x"), (None, 1, "u", "y")]
    assert trie(spark, rows) == plain(rows)
