"""Byte-level BPE: encoding as the tiktoken library does it (without special tokens), and decoding.

A text is cut into chunks at white space (a chunk keeps one leading space), a chunk by the tokenizer's
pattern into pieces, and each piece is merged by rank. Chunks and pieces repeat, so a worker keeps a bounded
table of the ids of chunks; the pieces of unknown chunks are merged together: they are grouped by length, each
group is a padded numpy matrix of token ids with a row for each piece, and in each round every row merges its
leftmost pair of least rank. Pair ranks come from a hash table in numpy arrays; finished rows leave the matrix
and empty columns are squeezed out. Pieces beyond LONG bytes are merged one by one with a heap, with the same
order of merges, so that their cost stays n log n.

Defined cases: a null or empty text has no ids (the empty binary) and decodes to no bytes; ids that the
vocabulary lacks raise an error; other columns are kept as they are.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .shared import prepare_workers

LONG = 512
#: Entries of a worker's table of chunks; it is emptied when full.
MOST_CHUNKS = 250_000
#: White space as Unicode defines it, which the tokenizers' patterns mean by \s.
SPACE = "\t-\r \x85\xa0  -     　"
NONE = np.int32(-1)
FAR = np.int32(0x7FFFFFFF)


class Vocabulary:
    """Ranks of byte strings, as in a .tiktoken file, with the pattern that cuts pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import re

        import regex

        self.ranks = ranks
        own = pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"(?!\S)", f"(?![^{SPACE}])").replace(r"\s", f"[{SPACE}]")
        self.pieces = regex.compile(own).findall
        self.chunks = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+").findall
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.known: dict[str, bytes] = {}
        top = max(ranks.values()) + 1
        self.bytes_of: list[bytes | None] = [None] * top
        for piece, rank in ranks.items():
            self.bytes_of[rank] = piece
        self._pairs()

    def _pairs(self) -> None:
        """The hash table of mergeable pairs: each split of a token into two tokens."""
        ranks, left, right, value = self.ranks, [], [], []
        for piece, rank in ranks.items():
            for k in range(1, len(piece)):
                a, b = ranks.get(piece[:k]), ranks.get(piece[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    value.append(rank)
        keys = np.array(left, np.uint64) << np.uint64(32) | np.array(right, np.uint64)
        bits = max(4, int(len(keys) * 4).bit_length())
        self.slot_shift = np.uint64(64 - bits)
        self.slots = np.full(1 << bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.slot_rank = np.full(1 << bits, FAR)
        values, todo, at = np.array(value, np.int32), np.arange(len(keys)), self._slot(keys)
        mask = np.uint64((1 << bits) - 1)
        self.slot_mask = mask
        while len(todo):
            free = self.slots[at[todo]] == np.uint64(0xFFFFFFFFFFFFFFFF)
            mine = todo[free]
            self.slots[at[mine]] = keys[mine]  # of several, the last stays
            won = self.slots[at[todo]] == keys[todo]
            self.slot_rank[at[todo[won]]] = values[todo[won]]
            todo = todo[~won]
            at[todo] = (at[todo].astype(np.uint64) + np.uint64(1) & mask).astype(np.int64)
        self.pair_rank = dict(zip(zip(left, right), value))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> self.slot_shift).astype(np.int64)

    def rank_of_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, FAR where there is none or either side is empty."""
        keys = left.astype(np.uint32).astype(np.uint64) << np.uint64(32) | right.astype(np.uint32).astype(np.uint64)
        out = np.full(len(keys), FAR)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        at = self._slot(keys[todo])
        while len(todo):
            there = self.slots[at]
            same = there == keys[todo]
            out[todo[same]] = self.slot_rank[at[same]]
            on = ~same & (there != np.uint64(0xFFFFFFFFFFFFFFFF))
            todo, at = todo[on], (at[on].astype(np.uint64) + np.uint64(1) & self.slot_mask).astype(np.int64)
        return out

    # --- merging -------------------------------------------------------------------------------

    def merge_matrix(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        """The ids of pieces of at most ``width`` bytes."""
        n = len(pieces)
        flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        length = np.fromiter(map(len, pieces), np.int64, n)
        ids = np.where(np.arange(width) < length[:, None], self.single[flat], NONE)
        rank = np.full((n, width), FAR)
        rank[:, :-1] = self.rank_of_pairs(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        out: list[np.ndarray] = [None] * n  # type: ignore[list-item]
        row_of = np.arange(n)
        while len(row_of):
            at = rank.argmin(axis=1)  # the leftmost of the least
            rows = np.arange(len(row_of))
            best = rank[rows, at]
            done = best == FAR
            if done.any():
                for k in np.flatnonzero(done).tolist():
                    out[row_of[k]] = ids[k, : length[k]].copy()
                keep = ~done
                ids, rank, row_of, length, at, best = ids[keep], rank[keep], row_of[keep], length[keep], at[keep], best[keep]
                if not len(row_of):
                    break
                rows = np.arange(len(row_of))
                most = int(length.max())
                ids, rank = ids[:, :most], rank[:, :most]
            most = ids.shape[1]
            # everything right of the merged pair moves one column to the left
            source = np.arange(most) + (np.arange(most) > at[:, None])
            source[:, -1] = np.minimum(source[:, -1], most - 1)
            ids, rank = np.take_along_axis(ids, source, 1), np.take_along_axis(rank, source, 1)
            length = length - 1
            ids[rows, at] = best
            ids[rows, length] = NONE
            rank[rows, length] = FAR
            rank[rows, length - 1] = FAR
            here = ids[rows, at]
            after = np.where(at + 1 < most, ids[rows, np.minimum(at + 1, most - 1)], NONE)
            rank[rows, at] = self.rank_of_pairs(here, after)
            before = np.where(at > 0, ids[rows, np.maximum(at - 1, 0)], NONE)
            left = self.rank_of_pairs(before, here)
            has = at > 0
            rank[rows[has], at[has] - 1] = left[has]
        return out

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The ids of one piece, by a heap of (rank, place): the same merges in the same order."""
        n, pair_rank = len(piece), self.pair_rank.get
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        before, after, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        heap = [(r, k, ids[k], ids[k + 1]) for k in range(n - 1) if (r := pair_rank((ids[k], ids[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, k, a, b = heapq.heappop(heap)
            nxt = after[k]
            if not alive[k] or nxt < 0 or ids[k] != a or ids[nxt] != b:
                continue
            ids[k], alive[nxt] = rank, False
            after[k] = after[nxt]
            if after[k] >= 0:
                before[after[k]] = k
                if (r := pair_rank((rank, ids[after[k]]))) is not None:
                    heapq.heappush(heap, (r, k, rank, ids[after[k]]))
            if before[k] >= 0 and (r := pair_rank((ids[before[k]], rank))) is not None:
                heapq.heappush(heap, (r, before[k], ids[before[k]], rank))
        return np.array([t for t, on in zip(ids, alive) if on], np.int32)

    def merge(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """The ids of distinct pieces, as little-endian unsigned 32-bit integers."""
        out: dict[bytes, bytes] = {}
        groups: dict[int, list[bytes]] = {}
        for piece in pieces:
            if (rank := self.ranks.get(piece)) is not None:
                out[piece] = rank.to_bytes(4, "little")
            elif len(piece) > LONG:
                out[piece] = self.merge_long(piece).astype("<u4").tobytes()
            else:
                width = 4
                while width < len(piece):
                    width = width * 3 // 2
                groups.setdefault(width, []).append(piece)
        for width, group in groups.items():
            step = max(1, (1 << 20) // width)
            for k in range(0, len(group), step):
                for piece, ids in zip(group[k : k + step], self.merge_matrix(group[k : k + step], width)):
                    out[piece] = ids.astype("<u4").tobytes()
        return out

    # --- texts ---------------------------------------------------------------------------------

    def encode(self, texts: list[str]) -> list[bytes]:
        known = self.known
        cut = [self.chunks(t) for t in texts]
        every = set().union(*cut)
        missing = every - known.keys()
        if missing:
            if len(known) + len(missing) > MOST_CHUNKS:
                known.clear()
                missing = every
            parts = {c: [p.encode() for p in self.pieces(c)] for c in missing}
            ids = self.merge(list({p for ps in parts.values() for p in ps}))
            known.update((c, b"".join(map(ids.__getitem__, ps))) for c, ps in parts.items())
        return [b"".join(map(known.__getitem__, chunks)) for chunks in cut]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(4)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return Vocabulary(ranks, pattern)


def _slices(values: list, most: int = 1 << 20):
    """(place of the first, values) of parts of about ``most`` characters or bytes."""
    at, size = 0, 0
    for k, value in enumerate(values):
        size += len(value)
        if size >= most:
            yield at, values[at : k + 1]
            at, size = k + 1, 0
    if at < len(values):
        yield at, values[at:]


def _with_columns(df: DataFrame, fields: dict[str, str], source: str, function) -> DataFrame:
    """``df`` with columns (name to type) that ``function`` makes, as lists, from a list of the values of ``source``."""
    from pyspark.sql.types import StructType

    at = df.columns.index(source)
    columns = [c for c in df.columns if c not in fields]
    schema = StructType([f for f in df.schema.fields if f.name not in fields])
    for name, kind in fields.items():
        schema = schema.add(name, kind)

    def run(batches):
        import pyarrow as pa

        kinds = {"binary": pa.binary(), "long": pa.int64(), "string": pa.string()}
        for batch in batches:
            values = batch.column(at).to_pylist()
            for first, part in _slices([v or (b"" if batch.column(at).type == pa.binary() else "") for v in values]):
                rows = batch.slice(first, len(part))
                made = [pa.array(c, kinds[k]) for c, k in zip(function(part), fields.values())]
                yield pa.RecordBatch.from_arrays([*(rows.column(batch.schema.get_field_index(c)) for c in columns), *made], [*columns, *fields])

    return df.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with ids_col: the token ids as little-endian unsigned 32-bit integers."""
    prepare_workers(docs.sparkSession)
    return _with_columns(docs, {ids_col: "binary"}, text_col, lambda texts: [vocabulary(path, pattern).encode(texts)])


def decode(docs: DataFrame, path: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``docs`` with bytes_col: the bytes of the ids in ids_col."""
    prepare_workers(docs.sparkSession)
    return _with_columns(docs, {bytes_col: "binary"}, ids_col, lambda ids: [list(map(vocabulary(path, pattern).decode, ids))])


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row: encoded, and decoded from the ids, in one worker."""
    prepare_workers(docs.sparkSession)

    def run(texts):
        from hashlib import sha256

        vocab = vocabulary(path, pattern)
        ids = vocab.encode(texts)
        return [len(x) // 4 for x in ids], [sha256(x).hexdigest() for x in ids], [sha256(vocab.decode(x)).hexdigest() for x in ids]

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return _with_columns(rows, {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}, "text", run).drop("text")
