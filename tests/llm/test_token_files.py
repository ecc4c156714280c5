import zlib
from random import Random

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from quirework.llm import token_files as K
from quirework.llm.shared import new_folder

PATH = P.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=50))
def test_code_round_trip(values):
    ranks = np.array(values, np.uint32)
    control, data = K.pack(ranks)
    assert len(control) == -(-len(values) // 4)
    got, used = K.unpack(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), len(values))
    assert got.tolist() == values and used == len(data)


def test_shard_round_trip_over_steps(monkeypatch):
    monkeypatch.setattr(K, "STEP", 64)
    random = Random(1)
    docs = [np.array([random.randrange(50000) for _ in range(random.choice([0, 1, 5, 300]))], np.uint32) for _ in range(60)]
    id_of = np.random.default_rng(1).permutation(50000).astype(np.uint32)
    rank_of = np.argsort(id_of).astype(np.uint32)
    shard = K.Shard(b"".join(K.shard_bytes([None, *range(59)], docs, rank_of)), id_of)
    assert [d.tolist() for d in shard.documents()] == [d.tolist() for d in docs]
    assert shard.null.tolist() == [True] + [False] * 59


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet="aB'sſΣς̀ÀÉ \n\x0b\x1c\x85\xa0 <|endoftext|>1²", max_size=40))
def test_words_give_the_ids_of_texts(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(K.words_of(PATH).encode([text.encode()])[0], "<u4").tolist() == want


def test_special_tokens_and_long_texts():
    texts = ["hello <|endoftext|> world", "a<|endoftext|>b<|startoftext|><|endoftext|>", "<|EndOfText|>", "<|endoftext", "É<|endoftext|>\u0301x <|startoftext<|endoftext|>", "x'" * 400_000, "Ünï cödé's 12 " * 150_000, "中文" * 100_000]
    got = K.words_of(PATH).encode([t.encode() for t in texts])
    for text, ids in zip(texts, got):
        assert np.frombuffer(ids, "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
    assert 49407 in np.frombuffer(got[0], "<u4")


def test_files(spark):
    random = Random(2)
    words = "The quick Brown föx isn't jumping over 2024 lazy-dogs ... été".split()
    rows = [(k * 3 % 101, " ".join(random.choices(words, k=random.randint(0, 60))), k) for k in range(101)]
    rows += [(None, "null id", 1), (7, None, 2), (7, "", 3), (7, "zz", 4), (7, "zz", 4), (8, "end<|endoftext|> it", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(6)
    t = Tokenizer.from_file(PATH)
    want, start = [], 0
    for i, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, np.array(t.encode(r[1] or "", add_special_tokens=False).ids + [2], "<u2").tobytes())):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    folder = new_folder(spark, "t")
    manifest = K.write(docs, folder, PATH, shard_size=400)
    assert manifest.count() > 3
    got = K.read(spark, folder, with_ids=True).join(manifest.select("shard", "start"), "shard").collect()
    assert sorted(((r.doc_id, r.start + r.offset, r.n_tokens, r.ids_crc32) for r in got), key=lambda r: r[1]) == want
    assert all(r.ids[-1] == 2 and len(r.ids) == r.n_tokens for r in got)
    assert sorted(map(tuple, K.round_trip(docs, PATH).collect()), key=lambda r: r[1]) == want
    assert K.round_trip(docs.limit(0), PATH).count() == 0


def test_words_are_made_once_until_two_generations_are_full():
    made, table = [], K.Table(4)

    def make(todo):
        made.extend(todo)
        return [w.upper() for w in todo]

    for keys in (["a", "b", ""], ["b", "c"], ["d", "a"], ["c", "b", "e"], ["a", "e"]):
        assert table.values(keys, make) == [k.upper() for k in keys]
    assert sorted(made) == ["", "a", "b", "c", "d", "e"]
    assert table.values([], make) == []


def test_a_part_looks_each_distinct_word_up_once(monkeypatch):
    import pyarrow as pa

    words, asked = K.Words(PATH), []
    look_up = words.known.values
    monkeypatch.setattr(words.known, "values", lambda keys, make: asked.append(len(keys)) or look_up(keys, make))
    texts = [f"Word{k % 7} and word{k % 5}, again " * 300 for k in range(1000)]  # 8 MB, of which 17 words differ at most
    found = [words.encode_column(part, 2) for part in K._cut(pa.array(texts))]
    assert len(asked) == 1 and asked[0] <= 17
    assert found[0][1].sum() == len(found[0][0]) and (found[0][0][np.cumsum(found[0][1]) - 1] == 2).all()
    whole = words.tokenizer.encode(texts[3], add_special_tokens=False).ids
    assert found[0][0][found[0][1][:3].sum() :][: found[0][1][3]].tolist() == whole + [2]
