"""Packing: ids against the library, the choice against enumeration, and the contract of the pieces."""

import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from quirework.llm import packing as P

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t\r\x0b\x1c\x85\xa0  '’sdtABCabc0<|endoftext|>١²"))))
def test_ids_are_the_librarys(text):
    assert P.encoder(PATH).encode(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_ids_of_hostile_texts():
    assert P.encoder(PATH).engine is not None
    for text in ("<|endoftext|>", "a<|endoftext|>  <|endoftext|> b", " " * 200_000 + "x", "\n" * 300_000, "a" * 50_000, "é" * 20_000, "x  y \n z　 　q", "\0\x01 \0"):
        assert P.encoder(PATH).encode(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), max_size=5), st.integers(1, 40))
def test_choice_is_the_closest(counts, room):
    chosen = P.closest(sorted(counts), counts.__getitem__, room)
    assert all(0 < n <= counts[k] for k, n in chosen.items())
    sums = {sum(k * n for k, n in zip(counts, some)) for some in itertools.product(*(range(n + 1) for n in counts.values()))}
    assert sum(k * n for k, n in chosen.items()) == max(s for s in sums if s <= room)


def test_windows_are_full_and_lose_nothing():
    rng = random.Random(5)
    packer, got, want = P.Packer(64), [], {}
    for doc in range(400):
        ids = np.arange(rng.choice([1, 2, 5, 30, 33, 63, 64, 65, 128, 1000])).astype(np.uint32) + doc * 10_000
        want[doc] = ids
        got.extend(packer.add(doc, ids))
        got.extend(packer.full(500))
    got.extend(packer.rest())
    sizes = [sum(len(p[2]) for p in s) for s in got]
    assert all(n == 64 or n & n - 1 == 0 for n in sizes) and sum(n < 64 for n in sizes) <= 6
    pieces = defaultdict(list)
    for sequence in got:
        for doc, start, ids, n in sequence:
            assert n == len(want[doc])
            pieces[doc].append((start, ids))
    assert all(np.array_equal(np.concatenate([ids for _, ids in sorted(pieces[d], key=lambda p: p[0])]), want[d]) for d in want)
    # few cuts: a document has its full windows, its remainder, and seldom more
    assert sum(len(p) for p in pieces.values()) <= sum(-(-len(w) // 64) for w in want.values()) + len(got) // 5


def check(rows, texts):
    """rows: of digests(); texts: (doc_id, text) of each document."""
    ids = defaultdict(list)
    for doc, text in texts:
        ids[doc].append(LIBRARY.encode(text or "", add_special_tokens=False).ids + [1])
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 2048 and (at == 2048 or at & at - 1 == 0)
    assert pieces.keys() == ids.keys()
    for doc, parts in pieces.items():
        if len(ids[doc]) > 1:  # documents of the same id
            assert sum(p.length for p in parts) == sum(map(len, ids[doc]))
            continue
        whole, at = ids[doc][0], 0
        for p in sorted(parts, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(whole)
            assert p.ids_crc32 == zlib.crc32(np.array(whole[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(whole)


def test_pieces_over_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(5, "doc_id")
    rows = P.digests(docs, PATH).collect()
    check(rows, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    used = defaultdict(int)
    for r in rows:
        used[r.sequence_id] += r.length
    assert sum(n < 2048 for n in used.values()) <= 5 * 11


def test_defined_cases(spark):
    texts = [(1, None), (2, ""), (None, "no id"), (3, "same"), (3, "same id, other text"), (4, "word " * 30_000), (5, "<|endoftext|>"), (6, "\0  ")]
    docs = spark.createDataFrame([(d, t, 7, 8) for d, t in texts], "doc_id long, text string, start int, ids int").repartition(3)
    check(P.digests(docs, PATH).collect(), texts)
    assert P.digests(docs.limit(0), PATH).collect() == []
    whole = P.pack(docs, PATH)
    assert whole.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    assert {bytes(r.ids) for r in whole.where("doc_id = 2").collect()} == {b"\1\0\0\0"}


def test_query(spark):
    from quirework.llm.queries import op13_packing

    check(op13_packing(spark, "/root/testdata/sf0.001").collect(), [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()])
