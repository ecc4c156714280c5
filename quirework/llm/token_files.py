"""Token-id files: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

An id is stored as its rank by frequency (0: the most frequent of the corpus), in one to four bytes, least
first. Two bits for each rank hold its number of bytes less one; four of them make a control byte, and all
control bytes of a shard stand before its data bytes, so that a reader finds the lengths of four ranks by
one look-up in a table of 256 rows, and all offsets by one running sum.

A data set is a folder with
  ranks.bin            little-endian unsigned 32-bit ids, in rank order
  shard-NNNNN.qtok     documents in ascending doc_id order, also from shard to shard
and a shard is, all little-endian:
  b"QTOK0001", n_docs u64, n_tokens u64, doc_ids i64[n_docs], null flags u8[n_docs], counts u32[n_docs],
  control u8[ceil(n_tokens / 4)], data.

The texts are encoded once, into the shared folder; their ids are counted there (for the ranks), then
range-partitioned by doc_id, and each partition writes a shard. Words repeat, so workers keep bounded tables
of the ids of words: the tokenizer cuts at white space before it merges, so the ids of a text are those of
its words. What fails is run again and replaces the same file.

Defined cases: a null or empty text has the end id only; null doc_ids come first; rows of equal doc_ids are
ordered by their ids (as stored bytes); an empty table gives no shard; other columns are ignored.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import new_folder, packed_rows, prepare_workers, remove_folder, texts_as_bytes, write_file

MAGIC = b"QTOK0001"
#: Stands between the ids of words; no vocabulary has this id.
MARK = b"\xff\xff\xff\xff"
#: Bytes of unpacked ids for each shard, about; entries of a generation of a worker's tables of words and of pieces; ids of one decoding step.
SHARD_BYTES, MOST_WORDS, STEP = 32 << 20, 200_000, 1 << 20
#: For each control byte, the bytes of its four ranks.
LENGTHS = (np.arange(256, dtype=np.uint8)[:, None] >> np.array([0, 2, 4, 6], np.uint8) & 3) + np.uint8(1)


# --- code -----------------------------------------------------------------------------------------


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of ranks."""
    ranks = ranks.astype(np.uint32)
    size = (1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)).astype(np.uint8)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    raw = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.tobytes(), raw[np.arange(4) < size[:, None]].tobytes()


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    """(n ranks, data bytes used), by table look-up of the control bytes."""
    size = LENGTHS[control].ravel()[:n].astype(np.int64)
    end = np.cumsum(size)
    used = int(end[-1]) if n else 0
    start = end - size
    padded = np.concatenate((data[:used], np.zeros(3, np.uint8))).astype(np.uint32)
    out = padded[start]
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        out[more] |= padded[start[more] + k] << np.uint32(8 * k)
    return out, used


def shard_bytes(doc_ids: list[int | None], tokens: list[np.ndarray], rank_of: np.ndarray):
    """The parts of a shard file."""
    counts = np.fromiter(map(len, tokens), np.uint32, len(tokens))
    total = int(counts.sum(dtype=np.int64))
    yield MAGIC + np.array([len(tokens), total], "<u8").tobytes()
    yield np.array([i or 0 for i in doc_ids], "<i8").tobytes()
    yield np.array([i is None for i in doc_ids], np.uint8).tobytes()
    yield counts.astype("<u4").tobytes()
    ids = np.concatenate(tokens) if tokens else np.zeros(0, np.uint16)
    data = []
    for at in range(0, total, STEP):
        control, part = pack(rank_of[ids[at : at + STEP]])
        yield control
        data.append(part)
    yield from data


class Shard:
    """A shard file's content; documents are decoded in order."""

    def __init__(self, content: bytes, id_of: np.ndarray):
        if content[:8] != MAGIC:
            raise ValueError("not a token shard")
        n, self.n_tokens = (int(x) for x in np.frombuffer(content, "<u8", 2, 8))
        at = 24
        self.doc_ids = np.frombuffer(content, "<i8", n, at)
        self.null = np.frombuffer(content, np.uint8, n, at + 8 * n).astype(bool)
        self.counts = np.frombuffer(content, "<u4", n, at + 9 * n)
        at += 13 * n
        self.control = np.frombuffer(content, np.uint8, -(-self.n_tokens // 4), at)
        self.data = np.frombuffer(content, np.uint8, offset=at + len(self.control))
        self.id_of = id_of

    def documents(self):
        """The ids of each document."""
        held, have, at, read = np.zeros(0, np.uint32), 0, 0, 0
        for count in self.counts.tolist():
            while have < count:
                n = min(STEP, self.n_tokens - read)
                ranks, used = unpack(self.control[read // 4 : -(-(read + n) // 4)], self.data[at:], n)
                at, read = at + used, read + n
                held, have = np.concatenate((held[len(held) - have :], self.id_of[ranks])), have + n
            start = len(held) - have
            yield held[start : start + count]
            have -= count


# --- tokenizer ------------------------------------------------------------------------------------


class Words:
    """A tokenizer of the tokenizers library that drops white space, with tables of the ids of known words and pieces.

    Words of plain letters and ASCII signs are lower-cased and cut into pieces here, and the library's model
    merges the pieces that are new; all other words go through the library's whole chain.
    """

    PLAIN = r"[\x21-\x7eÀ-ÖØ-öø-ÿ]+"

    def __init__(self, path: str):
        import json
        import re

        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        #: literal occurrences of these are one id each, as the library cuts them out before anything else
        added = spec.get("added_tokens") or []
        self.special = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in added}
        #: tokens that take part in normalisation, or look at their neighbours, are left to the library, text by text
        self.whole = any(t.get(k) for t in added for k in ("normalized", "single_word", "lstrip", "rstrip"))
        self.special_cut = re.compile("|".join(re.escape(c) for c in sorted(self.special, key=len, reverse=True)) or r"(?!)").sub
        suffix = spec["model"].get("end_of_word_suffix") or None
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        splits = [p["pattern"]["Regex"] for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", []) if p["type"] == "Split"]
        #: the one chain whose plain words are cut here
        self.plain = re.compile(self.PLAIN).fullmatch if suffix and kinds == ["NFC", "Replace", "Lowercase"] and splits == [r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"] else None
        self.plain_lines = self.plain and re.compile(rf"(?:{self.PLAIN}\n)*{self.PLAIN}").fullmatch
        self.cut = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+|\n").findall
        self.merger = Tokenizer(self.tokenizer.model)
        self.merger.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocab = spec["model"]["vocab"]
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        if suffix:
            self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        # how the byte-level alphabet shows bytes: printable Latin-1 as itself, the others from U+0100 on
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self.alphabet = {b: 0x100 + k for k, b in enumerate(b for b in range(256) if b not in shown) if b != 0x20}
        self.known, self.pieces = Table(MOST_WORDS), Table(MOST_WORDS)

    def _plain_ids(self, lines: str) -> list[bytes]:
        """The ids of plain words, one on each line: cut as one text, put together with a mark between words."""
        cut = self.cut(lines.lower())
        self.pieces.keep(set(cut) - {"\n"}, self._merge)
        self.pieces.new["\n"] = MARK
        return b"".join(map(self.pieces.new.__getitem__, cut)).split(MARK)

    def _merge(self, found: set[str]):
        """(piece, ids) of pieces; ASCII ones first, as they are their own byte-level form."""
        pieces, out = sorted(found, key=str.isascii, reverse=True), []
        for at in range(0, len(pieces), 1000):
            part = pieces[at : at + 1000]
            line = " ".join(part)
            if not line.isascii():
                line = line.encode().decode("latin-1").translate(self.alphabet)
            ids = np.array(self.merger.encode(line, add_special_tokens=False).ids, "<u4")
            stops = (np.flatnonzero(self.ends[ids]) + 1) * 4  # a piece ends with its only end-of-word token
            if len(stops) != len(part):
                raise ValueError("pieces and end-of-word tokens differ in number")
            data, stops = ids.tobytes(), stops.tolist()
            out.extend(data[a:b] for a, b in zip([0, *stops], stops))
        return zip(pieces, out)

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words; an empty one, as Arrow cuts before and after white space, has none."""
        if any(not w or w in self.special for w in words):
            rest = [w for w in words if w and w not in self.special]
            found = iter(self._encode_words(rest) if rest else ())
            return [self.special.get(w, b"") if not w or w in self.special else next(found) for w in words]
        lines = "\n".join(words)
        if self.plain_lines and self.plain_lines(lines):
            return self._plain_ids(lines)
        plain = [bool(self.plain and self.plain(w)) for w in words]
        found = iter(self._plain_ids("\n".join(w for w, p in zip(words, plain) if p)) if any(plain) else ())
        others = [w for w, p in zip(words, plain) if not p]
        rest = iter(self.tokenizer.encode_batch_fast(others, add_special_tokens=False) if others else ())
        return [next(found) if p else np.array(next(rest).ids, "<u4").tobytes() for p in plain]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        import pyarrow as pa

        ids, lengths = self.encode_column(pa.array(texts, pa.binary()).cast(pa.large_string()))
        return [x.tobytes() for x in np.split(ids, np.cumsum(lengths)[:-1])] if texts else []

    def encode_column(self, texts, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts, one after the other, the number of ids of each) of an Arrow column of large strings.

        Texts are cut into words, and these numbered, by Arrow; each distinct word goes through the tables once, and
        its ids are copied to all its places by numpy. With end_id, each text gets that id at its end.
        """
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = texts.fill_null("")
        if self.whole:
            found = [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids + [end_id] * (end_id is not None), "<u4") for t in texts.to_pylist()]
            return np.concatenate([np.zeros(0, "<u4"), *found]), np.array(list(map(len, found)), np.int64)
        for content in self.special:  # white space is dropped, so that special tokens may become words of their own
            if pc.any(pc.match_substring(texts, content)).as_py():
                texts = pa.array([self.special_cut(r" \g<0> ", t) for t in texts.to_pylist()], pa.large_string())
                break
        cut = pc.ascii_split_whitespace(texts)
        stops = cut.offsets.to_numpy()
        numbered = cut.flatten().dictionary_encode()
        places, found = numbered.indices.to_numpy(), numbered.dictionary
        # words have no white space, so that one text of them all is split anew, faster than word by word
        words = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), found.cast(pa.string())), "\n")[0].as_py().split("\n") if len(found) else []
        values = self.known.values(words, self._encode_words) + [b"" if end_id is None else np.array([end_id], "<u4").tobytes()]
        # the last word of each text is the end
        places = np.insert(places, stops[1:] - stops[0], len(words))
        size = np.fromiter(map(len, values), np.int64, len(values)) // 4
        start = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(values), "<u4")
        del values
        firsts = np.concatenate(([0], np.cumsum(np.diff(stops) + 1)))[:-1]
        lengths = np.add.reduceat(size[places], firsts) if len(firsts) else np.zeros(0, np.int64)
        ids, at = np.empty(int(lengths.sum()), "<u4"), 0
        for first in range(0, len(places), STEP >> 4):
            part = places[first : first + (STEP >> 4)]
            count = size[part]
            ends = np.cumsum(count)
            n = int(ends[-1])
            ids[at : at + n] = flat[np.repeat(start[part] - ends + count, count) + np.arange(n)]
            at += n
        return ids, lengths


class Table:
    """A bounded table of two generations: what was used of the older one moves on when the newer one is full."""

    def __init__(self, most: int):
        self.most = most
        self.new: dict = {}
        self.old: dict = {}

    def values(self, keys: list, make) -> list:
        """The value of each of the distinct keys; make gives those of keys that are in neither generation."""
        found = list(map(self.new.get, keys))
        missing = [k for k, v in zip(keys, found) if v is None]
        if not missing:
            return found
        held = list(map(self.old.get, missing))
        todo = [k for k, v in zip(missing, held) if v is None]
        made = iter(make(todo) if todo else ())
        held = [next(made) if v is None else v for v in held]
        if self.new and len(self.new) + len(missing) > self.most:
            self.old, self.new = self.new, {k: v for k, v in zip(keys, found) if v is not None}
        self.new.update(zip(missing, held))
        held = iter(held)
        return [next(held) if v is None else v for v in found]

    def keep(self, keys: set, make) -> None:
        """Afterwards ``new`` has all keys; make gives (key, value) pairs of those that are in neither generation."""
        missing = keys.difference(self.new)
        if len(self.new) + len(missing) > self.most and self.new:
            self.old, self.new = self.new, {}
            missing = keys
        todo = missing.difference(self.old)
        self.new.update((k, self.old[k]) for k in missing - todo)
        if todo:
            self.new.update(make(todo))


@lru_cache(2)
def words_of(path: str) -> Words:
    return Words(path)


def _cut(column, most: int = 1 << 24):
    """A column of texts in parts of about ``most`` bytes."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = column.cast(pa.large_string())
    upto = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        stop = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most)) + 1
        yield column.slice(at, stop - at)
        at = stop


# --- data sets ------------------------------------------------------------------------------------


def encoded(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id long and ids of each row: little-endian unsigned integers, of two bytes if the vocabulary allows it, else four."""
    prepare_workers(docs.sparkSession)
    kind = id_type(tokenizer)

    def run(batches):
        import pyarrow as pa

        words = words_of(tokenizer)
        for batch in batches:
            at = 0
            for part in _cut(batch.column(1)):
                ids, lengths = words.encode_column(part, end_id)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), packed_rows(ids.astype(kind), lengths)], ["doc_id", "ids"])
                at += len(part)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary")


def id_type(tokenizer: str) -> str:
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else "<u4"


def id_counts(rows: DataFrame, kind: str) -> np.ndarray:
    """How often each id occurs in all rows. The counts of a vocabulary, summed on the executors, come to the driver."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros(0, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                part = np.bincount(np.frombuffer(ids.as_buffer(), kind))
                if len(part) > len(total):
                    total = np.concatenate((total, np.zeros(len(part) - len(total), np.int64)))
                total[: len(part)] += part
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["id", "n"])

    made = rows.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r.id for r in made), default=-1) + 1, np.int64)
    for r in made:
        counts[r.id] = r.n
    return counts


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_size: int = SHARD_BYTES) -> DataFrame:
    """Writes the data set; shard int, n_docs, n_tokens, n_bytes, start (ids of all shards before it) of each shard."""
    spark = docs.sparkSession
    staged = new_folder(spark, "token-ids")
    encoded(docs, tokenizer, end_id, id_col, text_col).write.option("compression", "zstd").parquet(staged)
    rows = spark.read.schema("doc_id long, ids binary").parquet(staged)
    kind = id_type(tokenizer)
    counts = id_counts(rows, kind)
    id_of = np.lexsort((np.arange(len(counts)), -counts)).astype("<u4")
    write_file(f"{folder}/ranks.bin", [id_of.tobytes()])
    # a vocabulary's ranks: bounded by the tokenizer, whatever the corpus
    sent = spark.sparkContext.broadcast(id_of.tobytes())

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        id_of = np.frombuffer(sent.value, "<u4")
        rank_of = np.empty(len(id_of), np.uint32)
        rank_of[id_of] = np.arange(len(id_of), dtype=np.uint32)
        ids, tokens = [], []
        for batch in batches:
            ids.extend(batch.column(0).to_pylist())
            tokens.extend(np.frombuffer(x, kind) for x in batch.column(1).to_pylist())
        if ids:
            shard = TaskContext.get().partitionId()
            n = write_file(f"{folder}/shard-{shard:05d}.qtok", shard_bytes(ids, tokens, rank_of))
            out = [[shard], [len(ids)], [sum(map(len, tokens))], [n]]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, (pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["shard", "n_docs", "n_tokens", "n_bytes"])

    parts = max(1, -(-int(counts.sum()) * int(kind[-1]) // shard_size))
    made = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "ids").mapInArrow(run, "shard int, n_docs long, n_tokens long, n_bytes long").collect()
    # one row for each shard: its place in the order of all ids
    start, manifest = 0, []
    for r in sorted(made):
        manifest.append((r.shard, r.n_docs, r.n_tokens, r.n_bytes, start))
        start += r.n_tokens
    remove_folder(spark, staged)
    return spark.createDataFrame(manifest, "shard int, n_docs long, n_tokens long, n_bytes long, start long")


def read(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """shard, doc_id, offset (ids of the shard before it), n_tokens, ids_crc32 and, if asked for, ids (array) of each document in the files."""
    prepare_workers(spark)
    ranks = bytes(spark.read.format("binaryFile").load(f"{folder}/ranks.bin").first().content)
    sent = spark.sparkContext.broadcast(ranks)

    def run(batches):
        import pyarrow as pa

        id_of = np.frombuffer(sent.value, "<u4")
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard = Shard(content.as_py(), id_of)
                number = int(path.rsplit("-", 1)[1].split(".")[0])
                n = len(shard.counts)
                counts = shard.counts.astype(np.int64)
                out = [pa.array(np.full(n, number, np.int32)), pa.array(shard.doc_ids, mask=shard.null), pa.array(np.cumsum(counts) - counts), pa.array(counts)]
                crc, ids = [], []
                for tokens in shard.documents():
                    crc.append(zlib.crc32(tokens.astype("<u4").tobytes()))
                    if with_ids:
                        ids.append(tokens.astype(np.int64))
                out.append(pa.array(crc, pa.int64()))
                yield pa.RecordBatch.from_arrays(out + [pa.array(ids, pa.list_(pa.int64()))] * with_ids, ["shard", "doc_id", "offset", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    # a file is a row: each task takes the files of one read split
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.qtok").load(folder).select("path", "content")
    return files.mapInArrow(run, "shard int, doc_id long, offset long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, as read from files that were written before."""
    spark = docs.sparkSession
    folder = new_folder(spark, "token-files")
    manifest = write(docs, folder, tokenizer, end_id)
    if not manifest.count():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read(spark, folder).join(manifest.select("shard", "start"), "shard").select("doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
