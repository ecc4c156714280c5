"""Prefix trie of conversations: nodes in preorder, with the ends of their subtrees and distributed prefix sums.

A node is the sequence of the first d turns of some conversation. No text moves: a turn is the first half of a
SHA-256 digest, and a node the polynomial hash of its turns' digests modulo the prime 2**127 - 1. That hash is a
running value that can be put together from parts, so conversations are read as one table sorted by conversation
and turn, in ranges: each task forms values within its range, and what the conversation before a range's start has
come to is added afterwards (`carried`). So a conversation of any length is spread over tasks, none is held whole.

Preorder: a node's heavy child is the one with the most conversations. Its key is made of the light edges above it,
a depth and the child's hash each, and its own depth; comparing keys as bytes walks, from the head of a chain of
heavy children, each node, then the subtrees of its light children, then its heavy child. An edge is light at most
log2(conversations) times on a path, so keys stay short however deep the trie is. Nodes are ranked by a range sort of
their keys, and prefix sums of ends, leaves and savings run along the ranks: in a task by itself, and one row for each
task gives the offsets. A subtree ends at a leaf, where conversations end; the sum of ends up to it is that before the
subtree's top and the top's number of conversations, which is how it is found by one equi-join; leaves and savings of
the subtree are differences of prefix sums at its two ends.

Conversations that end at a node are sorted by id over tasks and joined to texts of bounded size, which one digest
reads in order: SHA-256 has no other way, but it meets one row for each TEXT bytes.

Defined cases: rows of null conv_id are dropped; a null role or text is empty; null turns come first, equal turns go
by their digest, and repeated rows are turns of their own; a conversation without turns ends at the root; an empty
table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .shared import prepare_workers, scratch, written

PRIME = (1 << 127) - 1
BASE = 0x5A1D_3C96_E0F7_4B28_91D5_6A3E_C84F_0B77
#: Bytes of a text of joined ids.
TEXT = 1 << 20


# --- running values over a sorted table -----------------------------------------------------------


def sorted_rows(rows: DataFrame, *by: str) -> DataFrame:
    return rows.repartitionByRange(*by).sortWithinPartitions(*by)


def running(rows: DataFrame, schema: str, step: Callable, name: str) -> DataFrame:
    """A written table of the rows that ``step`` makes of each task's rows (as tuples), with the task's number (`part`) and the row's number in it (`at`)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    full = f"part int, at long, {schema}"
    kinds = to_arrow_schema(StructType.fromDDL(full))

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId(), []
        made = lambda: pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*held), kinds)], schema=kinds)
        for at, row in enumerate(step(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))):
            held.append((part, at, *row))
            if len(held) == 20_000:
                yield made()
                held = []
        if held:
            yield made()

    return written(rows.mapInArrow(run, full), name)


def task_ends(table: DataFrame, *columns: str) -> list:
    """part, first and last row (conv_id and ``columns``) of each task that had rows, in order: a row for a task."""
    row = F.struct("at", "conv_id", *columns)
    return sorted(table.groupBy("part").agg(F.min_by(row, "at").alias("first"), F.max_by(row, "at").alias("last")).collect(), key=lambda r: r.part)


def carried(ends: list, join: Callable) -> dict[int, tuple]:
    """For each task whose first conversation began in an earlier task, (the task's ends, what the conversation had come to).

    join(value, ends) is what a task's last conversation has come to; value is None unless it began before the task.
    """
    out, conv, value = {}, None, None
    for r in ends:
        goes_on = r.first.conv_id == conv
        if goes_on:
            out[r.part] = (r, value)
        value = join(value if goes_on and r.last.conv_id == conv else None, r)
        conv = r.last.conv_id
    return out


def with_carried(table: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """``table`` with the columns of ``schema`` on the rows that go on with an earlier task's conversation; ``rows`` are one for a task at most."""
    found = table.sparkSession.createDataFrame(rows, f"part int, conv_id long, {schema}")
    return table.join(F.broadcast(found), ["part", "conv_id"], "left")


# --- conversations --------------------------------------------------------------------------------


def turn_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest (of role and text), chars of each turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.substring(F.sha2(F.concat_ws(":", F.length(role).cast("string"), role, text), 256), 1, 32))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.length(text).cast("long").alias("chars")).where("conv_id IS NOT NULL")


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, number (from 1, of the conversation's turns in order), digest, chars."""

    def step(rows):
        conv, number = None, 0
        for conv_id, _, digest, chars in rows:
            number = number + 1 if conv_id == conv else 1
            conv = conv_id
            yield conv_id, number, digest, chars

    table = running(sorted_rows(turns, "conv_id", "turn", "digest"), "conv_id long, number long, digest binary, chars long", step, "numbered-turns")
    carry = carried(task_ends(table, "number"), lambda before, r: (before or 0) + r.last.number)
    table = with_carried(table, [(part, r.first.conv_id, before) for part, (r, before) in carry.items()], "more long")
    return table.select("conv_id", (F.col("number") + F.coalesce("more", F.lit(0))).alias("number"), "digest", "chars")


def shared_turns(conv_id: Column, most: int) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % most


def rebuilt(turns: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """conv_id, place, digest, chars: the head turns of the group's first conversation, then the conversation's own after as many.

    Each conversation also has a row of place -1 and no digest, its beginning.
    """
    heads = turns.where((F.col("conv_id") % group == 0) & (F.col("number") < most)).groupBy(F.col("conv_id").alias("base")).agg(F.collect_list(F.struct("number", "digest", "chars")).alias("heads"))
    convs = turns.where("number = 1").select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    first = convs.join(heads, "base").select("conv_id", F.explode("heads").alias("head")).where(F.col("head.number") <= shared_turns(F.col("conv_id"), most))
    own = turns.where(F.col("number") > shared_turns(F.col("conv_id"), most))
    begin = convs.select("conv_id", F.lit(-1).cast("long").alias("place"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("chars"))
    return begin.unionByName(first.select("conv_id", F.col("head.number").alias("place"), "head.digest", "head.chars")).unionByName(own.select("conv_id", (F.col("number") + most).alias("place"), "digest", "chars"))


# --- nodes ----------------------------------------------------------------------------------------


def visits(rows: DataFrame) -> DataFrame:
    """conv_id, depth, node, parent (null for the root), chars, last (whether the conversation ends there): each conversation's way down."""

    def step(rows):
        conv, depth, value, held = None, 0, 0, None
        for conv_id, _, digest, chars in rows:
            if conv_id != conv:
                depth, value = 0, 0  # of a conversation that began before this task, only the part from here on
            before = value
            if digest is None:
                depth, value = 0, 1
            else:
                depth, value = depth + 1, (value * BASE + 1 + int.from_bytes(digest, "big")) % PRIME
            if held:
                yield *held, conv_id != conv
            conv, held = conv_id, (conv_id, depth, value.to_bytes(16, "big"), None if digest is None else before.to_bytes(16, "big"), chars)
        if held:
            yield *held, True

    table = running(sorted_rows(rows, "conv_id", "place"), "conv_id long, depth long, node binary, parent binary, chars long, last boolean", step, "visits")
    ends = task_ends(table, "depth", "node")

    def join(before, r):
        depth, value = before or (0, 0)
        return depth + r.last.depth, (value * pow(BASE, r.last.depth, PRIME) + int.from_bytes(r.last.node, "big")) % PRIME

    carry = {part: (r.first.conv_id, *before) for part, (r, before) in carried(ends, join).items()}
    # a task's last row isn't its conversation's last if the next task goes on with it
    stops = {r.part: r.last.at for r, after in zip(ends, ends[1:]) if r.last.conv_id == after.first.conv_id}

    def run(batches):
        import pyarrow as pa

        def moved(x, start, power):
            return ((start * power + int.from_bytes(x, "big")) % PRIME).to_bytes(16, "big")

        for batch in batches:
            out = []
            for part, at, conv_id, depth, node, parent, chars, last in zip(*(c.to_pylist() for c in batch.columns)):
                if part in carry and carry[part][0] == conv_id:
                    _, more, start = carry[part]
                    power = pow(BASE, depth - 1, PRIME)
                    node, parent, depth = moved(node, start, power * BASE % PRIME), moved(parent, start, power), depth + more
                out.append((conv_id, depth, node, parent, chars, last and stops.get(part) != at))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["conv_id", "depth", "node", "parent", "chars", "last"])

    return table.mapInArrow(run, "conv_id long, depth long, node binary, parent binary, chars long, last boolean")


def node_table(ways: DataFrame) -> DataFrame:
    """node, depth, chars, n_convs, first (smallest member), ends, n_children, heavy (child of the most conversations)."""
    nodes = ways.groupBy("node").agg(F.max("depth").alias("depth"), F.max("parent").alias("parent"), F.max("chars").alias("chars"), F.count("*").alias("n_convs"), F.min("conv_id").alias("first"), F.count_if("last").alias("ends"))
    nodes = written(nodes, "nodes")
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"), F.max(F.struct("n_convs", "node")).alias("heavy"))
    return nodes.drop("parent").join(children.select("node", "n_children", F.col("heavy.node").alias("heavy")), "node", "left").fillna(0, ["n_children"])


def edge(depth: int, node: bytes = bytes(16)) -> bytes:
    return depth.to_bytes(8, "big") + node


def keyed(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes with key (their place in preorder, as bytes) and parent_conv_id, read off the way of each node's smallest member."""
    rest = ["n_convs", "ends", "n_children", "chars"]
    rows = ways.select("conv_id", "node").join(nodes, "node").select("conv_id", "depth", "node", "heavy", "first", *rest)

    def step(rows):
        conv, edges, heavy_before, above = None, b"", None, None
        for conv_id, depth, node, heavy, first, *others in rows:
            if conv_id != conv:
                edges, above = b"", None
            elif node != heavy_before:
                edges += edge(depth - 1, node)
            yield conv_id, depth, node, heavy, first, *others, above, edges + edge(depth)
            conv, heavy_before, above = conv_id, heavy, first

    schema = "conv_id long, depth long, node binary, heavy binary, first long, n_convs long, ends long, n_children long, chars long, parent_conv_id long, key binary"
    table = running(sorted_rows(rows, "conv_id", "depth"), schema, step, "keys")
    own = len(edge(0))

    def entered(before, r):
        """The edges down to the task's first row."""
        edges, heavy, _ = before
        return edges if r.first.node == heavy else edges + edge(r.first.depth - 1, r.first.node)

    def join(before, r):
        return (entered(before, r) if before else b"") + r.last.key[:-own], r.last.heavy, r.last.first

    carry = carried(task_ends(table, "depth", "node", "heavy", "first", "key"), join)
    table = with_carried(table, [(part, r.first.conv_id, bytearray(entered(before, r)), before[2], r.first.at) for part, (r, before) in carry.items()], "edges binary, above long, top long")
    key = F.concat(F.coalesce("edges", F.lit(b"")), "key")
    parent = F.when(F.col("at") == F.col("top"), F.col("above")).otherwise(F.col("parent_conv_id"))
    return table.where("conv_id = first").select("node", "depth", "conv_id", parent.alias("parent_conv_id"), *rest, key.alias("key"))


def summed(nodes: DataFrame) -> DataFrame:
    """The nodes with the prefix sums, in preorder, of ends, leaves and savings before and up to each."""
    sums = ["ends", "leaves", "saved"]
    rows = nodes.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("own", (F.col("n_convs") - 1) * F.col("chars"))
    plain = ["node", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "ends"]

    def step(rows):
        ends = leaves = saved = 0
        for *values, n_ends, leaf, own, _ in rows:
            before = ends, leaves, saved
            ends, leaves, saved = ends + n_ends, leaves + leaf, saved + own
            yield *values, n_ends, *before, ends, leaves, saved

    schema = "node binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, ends long, " + ", ".join(f"{c}_{w} long" for w in ("before", "upto") for c in sums)
    table = running(sorted_rows(rows.select(*plain, "leaf", "own", "key"), "key"), schema, step, "prefix-sums")
    ends = task_ends(table, *(f"{c}_upto" for c in sums))
    starts, total = [], (0, 0, 0)
    for r in ends:
        starts.append((r.part, *total))
        total = tuple(a + r.last[f"{c}_upto"] for a, c in zip(total, sums))
    starts = table.sparkSession.createDataFrame(starts, "part int, ends_start long, leaves_start long, saved_start long")  # a row for a task
    table = table.join(F.broadcast(starts), "part")
    return table.select(*plain, *((F.col(f"{c}_{w}") + F.col(f"{c}_start")).alias(f"{c}_{w}") for w in ("before", "upto") for c in sums))


def ends_digests(ways: DataFrame) -> DataFrame:
    """node and ends_sha256, the digest of the ascending ids of the conversations that end at it."""

    def texts(rows):
        node, held, size = None, [], 0
        for after, conv_id in rows:
            if held and (after != node or size > TEXT):
                yield node, ",".join(held)
                held, size = [], 0
            node = after
            held.append(str(conv_id))
            size += len(held[-1]) + 1
        if held:
            yield node, ",".join(held)

    parts = running(sorted_rows(ways.where("last").select("node", "conv_id"), "node", "conv_id"), "node binary, ids string", texts, "ends")

    def run(batches):
        import pyarrow as pa
        from hashlib import sha256

        node, digest, out = None, None, []
        for batch in batches:
            for after, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if after == node:
                    digest.update(b"," + ids.encode())
                    continue
                if node is not None:
                    out.append((node, digest.hexdigest()))
                node, digest = after, sha256(ids.encode())
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["node", "ends_sha256"])
                out = []
        if node is not None:
            out.append((node, digest.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["node", "ends_sha256"])

    return parts.repartition("node").sortWithinPartitions("node", "part", "at").select("node", "ids").mapInArrow(run, "node binary, ends_sha256 string")


def trie(conversations: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node."""
    prepare_workers(conversations.sparkSession)
    with scratch(conversations.sparkSession) as keep:
        turns = written(numbered(turn_rows(conversations)), "turns")
        ways = written(visits(rebuilt(turns, group, most)), "ways")
        nodes = written(summed(keyed(ways, written(node_table(ways), "node-table"))), "summed-nodes")
        bottom = nodes.where("ends > 0").select(F.col("ends_upto").alias("bottom"), F.col("leaves_upto").alias("leaves_end"), F.col("saved_upto").alias("saved_end"))
        rows = nodes.withColumn("bottom", F.col("ends_before") + F.col("n_convs")).join(bottom, "bottom").join(ends_digests(ways), "node", "left")
        none = F.sha2(F.lit("").cast("binary"), 256)
        found = rows.select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("leaves_end") - F.col("leaves_before")).alias("n_leaves"),
            (F.col("saved_end") - F.col("saved_before")).alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256"),
        )
        return keep(written(found, "trie"))


ORACLE = r"""
WITH convs AS (
    SELECT DISTINCT conv_id AS c, conv_id - conv_id % 100 AS base FROM conversations WHERE conv_id IS NOT NULL
), heads AS (
    SELECT c, base, xor(list_reduce(list_transform(range(1, len(c::VARCHAR) + 1), lambda i: ascii(substr(c::VARCHAR, i::INT, 1))::BIGINT),
        lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1))), 4294967295::BIGINT), 4294967295) % 6 AS h
    FROM convs
), turns AS (
    SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL
), built AS (
    SELECT c, list({'role': role, 'text': text} ORDER BY own, k) AS turns FROM (
        SELECT h.c, 0 AS own, k, role, text FROM heads h JOIN turns t ON t.c = h.base AND t.k <= h.h
        UNION ALL SELECT h.c, 1, k, role, text FROM heads h JOIN turns t ON t.c = h.c AND t.k > h.h) GROUP BY c
), whole AS (
    SELECT h.c, coalesce(turns, []) AS turns FROM heads h LEFT JOIN built USING (c)
), ways AS (
    SELECT c, d, turns[1:d] AS path, turns[1:d - 1] AS above, len(turns) = d AS last, CASE WHEN d > 0 THEN length(turns[d].text) ELSE 0 END AS chars
    FROM (SELECT c, turns, unnest(range(len(turns) + 1)) AS d FROM whole)
), nodes AS (
    SELECT path, d, any_value(above) AS above, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS own,
        sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last), '')) AS ends_sha256
    FROM ways GROUP BY path, d
), children AS (
    SELECT above AS path, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL
), counted AS (
    SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN children USING (path, d)
), below AS (
    SELECT t.path, t.d, count(*) FILTER (b.n_children = 0) AS n_leaves, sum(b.own) AS saved
    FROM counted t JOIN counted b ON b.d >= t.d AND b.path[1:t.d] = t.path GROUP BY ALL
)
SELECT t.conv_id::BIGINT AS conv_id, t.d::BIGINT AS depth, p.conv_id::BIGINT AS parent_conv_id, t.n_convs::BIGINT AS n_convs, t.n_children::BIGINT AS n_children,
    b.n_leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, t.ends_sha256
FROM counted t JOIN below b USING (path, d) LEFT JOIN nodes p ON t.d > 0 AND p.path = t.above AND p.d = t.d - 1
"""
