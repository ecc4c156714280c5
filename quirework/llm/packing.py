"""Packing of documents into fixed windows of token ids: minimum bin slack.

A document's ids, with an end id, are cut into full windows and a remainder. The remainders of a task are a
multiset of lengths. Each window takes the longest remainder, and a subset-sum dynamic program over a bitset
(bit s is set if some of the lengths sum to s; a length that occurs n times enters as 1, 2, 4, ... of it) finds
the multiset that comes closest to the rest of the window; the bitsets before each step give, backwards, how
often each length is taken. The program ends early once the window can be filled exactly, as nothing is closer.
Where slack is left, the longest remainder gives its first ids and goes back shorter. So every window is full;
what a task has left in the end, less than a window, goes to sequences of a power of two, by the same program.

There is no shuffle: a task packs the rows it reads, holding KEEP ids and a batch at most, and the remainders of
a text leave its other ids behind. Sequence numbers are made from the partition and a running number.

The ids are those of the tokenizers library for a byte-level BPE file. The file's vocabulary is run by the merge
loop of tiktoken, whose ids are the same where merges are in the order of ids (checked when the file is read), at
several times the speed; other files, and texts whose white space is too long for its pattern, go through the
library itself.

Defined cases: a null or empty text is the end id alone; rows of equal or null doc_id are documents of their own;
an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .shared import prepare_workers

#: Ids whose remainders a task keeps to choose from; ids of one step from Python.
KEEP, STEP = 1 << 20, 1 << 20
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


# --- tokenizer ------------------------------------------------------------------------------------


class Encoder:
    """The ids of texts as the tokenizers library gives them for a file, without added tokens."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            self.engine = self._engine(json.load(file))

    @staticmethod
    def _engine(spec: dict):
        """The vocabulary in tiktoken's merge loop, if that gives the library's ids; else None."""
        import public_tokenizers
        import tiktoken

        model, before = spec["model"], spec["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not spec["normalizer"] and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        if not plain or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            return None
        added = spec.get("added_tokens") or []
        if any(t.get(k) for t in added for k in ("normalized", "single_word", "lstrip", "rstrip")):
            return None
        # how the byte-level alphabet shows bytes: printable Latin-1 as itself, the others from U+0100 on
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte_of = {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        special = {t["content"]: t["id"] for t in added}
        ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in model["vocab"].items() if t not in special}
        made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        single = {i for t, i in ranks.items() if len(t) == 1}
        if len(single) < 256 or made != sorted(made) or single.union(made) != set(ranks.values()) or len(single) + len(made) != len(ranks):
            return None
        return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> np.ndarray:
        if self.engine:
            try:
                return self.engine.encode_to_numpy(text, allowed_special="all")
            except ValueError:  # a run of white space beyond what its pattern matcher can go back over
                pass
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


# --- minimum bin slack ----------------------------------------------------------------------------


def closest(lengths: list[int], count_of, room: int) -> dict[int, int]:
    """How often to take each of ``lengths`` (ascending, distinct) so that the sum is closest to ``room``, not above it."""
    reach, full, steps = 1, (1 << room + 1) - 1, []
    for k in range(bisect_right(lengths, room) - 1, -1, -1):
        length = lengths[k]
        left, take = min(count_of(length), room // length), 1
        while left:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= reach << length * take & full
            left, take = left - take, take * 2
        if reach >> room:
            break
    best, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> best & 1:
            chosen[length] = chosen.get(length, 0) + take
            best -= length * take
    return chosen


class Packer:
    """Documents in, full sequences out. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, length: int):
        self.length, self.total = length, 0
        self.lengths: list[int] = []
        self.pieces: dict[int, list[tuple]] = {}

    def put(self, piece: tuple) -> None:
        n = len(piece[2])
        if n not in self.pieces:
            self.pieces[n] = []
            insort(self.lengths, n)
        self.pieces[n].append(piece)
        self.total += n

    def take(self, n: int) -> tuple:
        piece = self.pieces[n].pop()
        if not self.pieces[n]:
            del self.pieces[n], self.lengths[bisect_right(self.lengths, n) - 1]
        self.total -= n
        return piece

    def add(self, doc_id: int | None, ids: np.ndarray):
        """Yields the document's full windows; its remainder is kept."""
        n = len(ids)
        for at in range(0, n - self.length + 1, self.length):
            yield [(doc_id, at, ids[at : at + self.length], n)]
        if rest := n % self.length:
            self.put((doc_id, n - rest, ids[n - rest :].copy(), n))

    def window(self, room: int) -> list[tuple]:
        """A sequence of ``room`` ids, or of all that are left if these are fewer."""
        out = []
        if self.lengths and self.lengths[-1] <= room:
            out.append(self.take(self.lengths[-1]))
            room -= len(out[0][2])
        chosen = closest(self.lengths, lambda n: len(self.pieces[n]), room) if room else {}
        for n, times in sorted(chosen.items(), reverse=True):
            out.extend(self.take(n) for _ in range(times))
            room -= n * times
        if room and self.lengths:
            doc_id, start, ids, n = self.take(self.lengths[-1])
            out.append((doc_id, start, ids[:room], n))
            self.put((doc_id, start + room, ids[room:], n))
        return out

    def full(self, keep: int):
        while self.total >= max(keep, self.length):
            yield self.window(self.length)

    def rest(self):
        """All that is left: full sequences, then powers of two."""
        yield from self.full(0)
        while self.total:
            yield self.window(1 << self.total.bit_length() - 1)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = 2048, id_col: str = "doc_id", text_col: str = "text", keep: int = KEEP) -> DataFrame:
    """doc_id, start (in its document), length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset (in its sequence) of each piece.

    ``length`` is a power of two, or the sequences of a task's end may need padding as well.
    """
    prepare_workers(docs.sparkSession)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        packer, encode, end = Packer(length), encoder(tokenizer).encode, np.array([end_id], np.uint32)
        number = TaskContext.get().partitionId() << 32
        held, size = [], 0

        def rows():
            columns = list(zip(*held))
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.binary()), *(pa.array(c, pa.int64()) for c in columns[4:])], SCHEMA.replace(" long", "").replace(" binary", "").split(", "))

        def sequences():
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    text = text.as_py()
                    yield from packer.add(doc_id, np.concatenate((encode(text), end)) if text else end)
                    yield from packer.full(keep)
            yield from packer.rest()

        for pieces in sequences():
            offset = 0
            for doc_id, start, ids, n in pieces:
                held.append((doc_id, start, len(ids), ids.astype("<u4").tobytes(), n, number, offset))
                offset += len(ids)
            number, size = number + 1, size + offset
            if size >= STEP:
                yield rows()
                held, size = [], 0
        if held:
            yield rows()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def digests(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """The pieces with the checksum of their ids in place of these."""
    return pack(docs, tokenizer, end_id).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
