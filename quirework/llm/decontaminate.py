"""Benchmark decontamination: occurrences of benchmark windows in documents, by Wu-Manber search.

Texts are lower-cased (A-Z) and cut into words of digits, a-z and non-ASCII characters. A pattern is a
window of ``window`` consecutive words of a benchmark item (an item with fewer words, but not none, is one
pattern). The search runs over word numbers: the shift table holds, for each block of two words that a
pattern has, how far the search may move on (blocks of no pattern let it skip nearly a whole window), a
block with shift zero is a pattern's suffix and picks the bucket of the patterns that end in it, their
prefixes sort out most, and a direct comparison confirms an occurrence. Patterns of one length share a set
of tables, so short items don't shorten the shifts of the others.

The patterns are sent to the executors in blocks of at most ``block_bytes`` of benchmark text, one pass over
the documents for each block; there is usually one. A worker holds the tables of one block, about 27 times its text.

Defined cases: null or empty texts, and texts without words, have no words and no hits; null or empty items
have no windows; items of equal texts each count; an item with a null id is searched under the id null and
isn't listed; repeated documents give repeated rows; other columns are ignored (the filter keeps them).
"""

from __future__ import annotations

import array
from functools import lru_cache

from pyspark.sql import DataFrame, functions as F

from .shared import prepare_workers, texts_as_bytes

WINDOW = 10
BLOCK_BYTES = 8 << 20
#: A-Z to a-z; all other ASCII characters but digits and a-z to a space.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class Tables:
    """The search tables of patterns of one length, over word numbers below ``base`` (0: a word of no pattern)."""

    def __init__(self, length: int, base: int):
        self.length, self.base, self.block = length, base, min(2, length)
        self.default = length - self.block + 1
        self.shift: dict[int, int] = {}
        self.buckets: dict[int, dict[int, list]] = {}

    def add(self, words: tuple[int, ...], item: int) -> None:
        m, base = self.length, self.base
        for end in range(self.block, m + 1):
            key = words[end - 1] if self.block == 1 else words[end - 2] * base + words[end - 1]
            if m - end < self.shift.get(key, self.default):
                self.shift[key] = m - end
        suffix = words[-1] if self.block == 1 else words[-2] * base + words[-1]
        prefix = words[0] if self.block == 1 else words[0] * base + words[1]
        same = self.buckets.setdefault(suffix, {}).setdefault(prefix, [])
        for pattern, items in same:
            if pattern == words:
                items.add(item)
                return
        same.append((words, {item}))

    def search(self, ids: list[int]):
        """(end, items) of each occurrence."""
        m, base, pair, default = self.length, self.base, self.block == 2, self.default
        shift, buckets, n = self.shift.get, self.buckets, len(ids)
        at = m - 1
        while at < n:
            key = ids[at - 1] * base + ids[at] if pair else ids[at]
            step = shift(key, default)
            if step:
                at += step
                continue
            start = at - m + 1
            for pattern, items in buckets[key].get(ids[start] * base + ids[start + 1] if pair else ids[start], ()):
                if pattern == tuple(ids[start : at + 1]):
                    yield at + 1, items
            at += 1


class Matcher:
    """All patterns of a block of benchmark items."""

    def __init__(self, items: list[tuple[int | None, bytes]], window: int):
        self.items = [i for i, _ in items]
        texts = [words_of(t) for _, t in items]
        self.number = {w: k for k, w in enumerate(sorted({w for t in texts for w in t}), 1)}
        self.tables: dict[int, Tables] = {}
        for k, words in enumerate(texts):
            ids = tuple(self.number[w] for w in words)
            length = min(window, len(ids))
            for at in range(len(ids) - length + 1 if length else 0):
                self.tables.setdefault(length, Tables(length, len(self.number) + 1)).add(ids[at : at + length], k)

    def spans(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged (start, end) word spans of all occurrences, and the item ids."""
        get = self.number.get
        ids = [get(w, 0) for w in words]
        found, items = [], set()
        for length, tables in self.tables.items():
            for end, which in tables.search(ids):
                found.append((end - length, end))
                items |= which
        return merged(found), {self.items[k] for k in items}


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


@lru_cache(1)
def _matcher(key: str, holder) -> Matcher:
    return Matcher(holder.value, holder.window)


class _Patterns:
    """A block of items, broadcast; its tables are built once in each worker."""

    def __init__(self, broadcast, window: int, key: str):
        self.broadcast, self.window, self.key = broadcast, window, key

    @property
    def value(self):
        return self.broadcast.value

    def matcher(self) -> Matcher:
        return _matcher(self.key, self)

    def __hash__(self):
        return hash(self.key)

    def __eq__(self, other):
        return self.key == other.key


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, spans (array of struct<start, end>, word numbers, merged), items (distinct ids) of each document."""
    import uuid

    spark = docs.sparkSession
    prepare_workers(spark)
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.lit(None).cast("binary").alias("spans"), F.lit(None).cast("array<long>").alias("items")
    )
    id_type = docs.schema[id_col].dataType.simpleString()
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        held = _Patterns(spark.sparkContext.broadcast([(r.item, r.text.encode()) for r in part.collect()]), window, uuid.uuid4().hex)
        last = k == blocks - 1

        def run(batches, held=held, last=last):
            import numpy as np
            import pyarrow as pa

            match = held.matcher()
            for batch in batches:
                texts, spans, items, counts = texts_as_bytes(batch.column(1)), [], [], []
                before = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
                for text, (old, had) in zip(texts, before):
                    words = words_of(text)
                    found, ids = match.spans(words)
                    if old:
                        flat = array.array("i", old)
                        found = merged(found + list(zip(flat[::2], flat[1::2])))
                    spans.append(found)
                    items.append(sorted((ids | set(had or ())) - {None}))
                    counts.append(len(words))
                if last:
                    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                    out = [batch.column(0), pa.array(counts, pa.int64()), pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], kind), pa.array(items, pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_words", "spans", "items"])
                else:
                    packed = [np.array(x, np.int32).tobytes() for x in spans]
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary()), pa.array(items, pa.list_(pa.int64()))], ["doc_id", "text", "spans", "items"])

        schema = f"doc_id {id_type}, n_words long, spans array<struct<start:int,end:int>>, items array<long>" if last else f"doc_id {id_type}, text string, spans binary, items array<long>"
        rows = rows.mapInArrow(run, schema)
    return rows


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each document."""
    found = hits(docs, benchmark, **options)
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256")
    ).withColumn("contaminated", F.col("n_hit") > 0)


def cut_out(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of documents without any benchmark window, with all their columns.

    Rows are tested in place (one block of patterns after the other), so equal ids don't matter.
    """
    spark = docs.sparkSession
    prepare_workers(spark)
    import uuid

    items = benchmark.select(F.col("item_id").cast("long").alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, column = max(1, -(-total // BLOCK_BYTES)), docs.columns.index(text_col)
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        held = _Patterns(spark.sparkContext.broadcast([(r.item, r.text.encode()) for r in part.collect()]), window, uuid.uuid4().hex)

        def run(batches, held=held):
            import pyarrow as pa

            match = held.matcher()
            for batch in batches:
                clean = [not match.spans(words_of(t))[0] for t in texts_as_bytes(batch.column(column))]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


ORACLE = r"""
WITH doc AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
pattern AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS p FROM item, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(s) WHERE len(w) > 0),
place AS (SELECT DISTINCT r, s, n, array_to_string(w[s:s + n - 1], ' ') AS p FROM doc, (SELECT DISTINCT n FROM pattern), unnest(range(1, len(w) - n + 2)) AS t(s)),
found AS (SELECT r, s, n, item_id FROM place JOIN pattern USING (n, p)),
hit AS (SELECT r, count(DISTINCT k) AS n_hit FROM found, unnest(range(s, s + n)) AS t(k) GROUP BY r),
named AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM found GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""
