import base64
from random import Random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from quirework.llm import byte_bpe as B

PATH = P.path("byte_bpe_50k.tiktoken")
V = B.vocabulary(PATH, P.PATTERN)
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
T = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def same(text):
    ids = V.encode([text])[0]
    assert np.frombuffer(ids, "<u4").tolist() == T.encode_ordinary(text)
    assert V.decode(ids) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_any_text(text):
    same(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \n\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0 　a'sté1²,.<|", max_size=40))
def test_white_space_and_contractions(text):
    same(text)


def test_long_pieces_and_hard_ones():
    random = Random(1)
    for text in ("a" * 5000, "ab" * 700, "é" * 2000, "".join(random.choices("abcdefgh", k=3000)), "<|endoftext|>", "x" * 511, "y" * 513, "  lead", "trail  ", "\n\n a"):
        same(text)
    piece = bytes(random.choices(b"abcde ", k=400))
    assert V.merge_matrix([piece], 512)[0].tolist() == V.merge_long(piece).tolist()


def test_rows(spark):
    rows = [(1, "Hello wörld", 7), (2, None, 8), (3, "", 9), (3, "", 9), (None, "x y", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = {(r.doc_id, r.n_tokens) for r in B.digests(docs, PATH, P.PATTERN).collect()}
    assert out == {(1, len(T.encode_ordinary("Hello wörld"))), (2, 0), (3, 0), (None, 2)}
    assert B.digests(docs.limit(0), PATH, P.PATTERN).count() == 0
    kept = B.encode(docs.withColumnRenamed("ids", "other"), PATH, P.PATTERN)
    assert kept.columns == ["doc_id", "text", "other", "ids"] and kept.count() == 5
    with pytest.raises(Exception):
        V.decode(np.array([10**6], "<u4").tobytes())
