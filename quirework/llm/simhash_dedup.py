"""Near-duplicate groups by SimHash.

A fingerprint has 64 bits: bit b is 1 if it is set in more than half of the XXH64 hashes of a text's
word shingles. Texts whose fingerprints differ in at most ``radius`` bits are linked, and the connected
components of those links are the groups.

Candidates come from the pigeonhole principle: of ``radius + m`` bit blocks at least m are equal in two
linked fingerprints, so each choice of m blocks is a table, and all links lie inside its buckets. The
search is exact: no bucket is capped. Inside buckets, distances are counted bit-sliced: bit planes are
stored vertically (one machine word holds the same bit of 64 fingerprints), carry-save adders update 64
distances at once, and a block of lanes is abandoned as soon as each of them exceeds the radius. A bucket
returns at most one link per member (to the smallest member that it reaches in the bucket), never pairs.

Equal fingerprints are merged before, so a group of exact copies counts as one member. Fingerprints, links
and components stay distributed; components come from alternating large-star and small-star steps, each
written to the shared folder.

Defined cases: a null or empty text, or one without words, has fingerprint zero and is linked like any
other; fewer words than a shingle make one shingle; repeated rows are kept, each with the same group; a
null doc_id takes part, but a group's id is its smallest non-null doc_id (null if it has none). Other
columns of the input are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from .shared import prepare_workers, scratch, texts_as_bytes, written

RADIUS = 4
SEED = 42
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

#: Rows that are compared at once; buckets up to SMALL members are compared lane by lane with their neighbours.
BLOCK_ROWS, SMALL = 1 << 16, 32
#: A node with this share of all edges is a hub; tables of fewer edges fit a task as a whole, so hubs don't matter there.
MOST_SHARED, FEW_EDGES = 10_000, 1_000_000
#: Rows of two numbers that are broadcast at most.
LARGEST_BROADCAST = 500_000
#: Members, and bytes of their texts, of a group of candidates that is confirmed in one task; members that are held
#: against pivots at once in larger groups; pivots of the first round.
MOST_MEMBERS, MOST_BYTES, PART, PIVOTS = 1000, 32 << 20, 500, 64
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


# --- fingerprints ---------------------------------------------------------------------------------


def hashes_of(text: bytes, shingle: int, seed: int = SEED) -> np.ndarray:
    """The hash of each of a text's shingles, repeats included; none for a text without words."""
    from xxhash import xxh64_intdigest

    words = text.translate(LOWER).split()  # at exactly \x20 and \x09-\x0D
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if n <= shingle:
        return np.array([xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    del words
    starts = np.concatenate(([0], ends[:-1] + 1))[: n - shingle + 1]
    ends, out = ends[shingle - 1 :], np.empty(n - shingle + 1, np.uint64)
    for at in range(0, len(out), BLOCK_ROWS):
        a, b = starts[at : at + BLOCK_ROWS].tolist(), ends[at : at + BLOCK_ROWS].tolist()
        out[at : at + BLOCK_ROWS] = np.fromiter((xxh64_intdigest(joined[x:y], seed) for x, y in zip(a, b)), np.uint64, len(a))
    return out


def fingerprint(text: bytes, shingle: int, seed: int = SEED) -> int:
    hashes = hashes_of(text, shingle, seed)
    return int(hashes[0]) if len(hashes) == 1 else majority(hashes) if len(hashes) else 0


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in more than half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * counts > len(hashes)).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key (a hash of the text) and fp (the 64 bits as a signed long) of each row."""
    prepare_workers(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            fps = np.fromiter((fingerprint(t, shingle) for t in texts_as_bytes(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps.view(np.int64))], ["doc_id", "text_key", "fp"])

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.withColumn("text_key", F.xxhash64("text")).mapInArrow(run, f"doc_id {id_type}, text_key long, fp long")


# --- bit-sliced comparison ------------------------------------------------------------------------


def planes_of(fps: np.ndarray) -> np.ndarray:
    """A row of machine words for each bit of (n,) or (n, words) fingerprints: bit i of word w in row b is bit b of fingerprint 64 * w + i."""
    width = fps.shape[1] if fps.ndim > 1 else 1
    padded = np.zeros((-(-max(len(fps), 1) // 64) * 64, width), np.uint64)
    padded[: len(fps)] = fps.reshape(-1, width)
    bits = np.unpackbits(padded.view(np.uint8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def shifted(plane: np.ndarray, words: np.ndarray, lanes: int) -> np.ndarray:
    """Some words of a plane that is moved so that lane i is lane i + lanes; zeros enter at the end."""
    skip, bits = divmod(lanes, 64)
    at = words + skip
    n = len(plane)
    low = np.where(at < n, plane[np.minimum(at, n - 1)], np.uint64(0))
    if not bits:
        return low
    high = np.where(at + 1 < n, plane[np.minimum(at + 1, n - 1)], np.uint64(0))
    return low >> np.uint64(bits) | high << np.uint64(64 - bits)


def within(differences, dead: np.ndarray, radius: int, width: int = 64) -> np.ndarray:
    """A bit for each lane that differs in at most ``radius`` planes and isn't dead.

    ``differences(b, words)`` gives plane b of the differences for those words. Counters are bit-sliced
    and hold a distance up to 2 ** levels - 1; a lane that counts beyond the radius is dead. Words (64
    lanes) whose lanes are all dead are abandoned.
    """
    levels = radius.bit_length()
    alive = np.flatnonzero(dead != ALL)
    gone, counts = dead[alive], np.zeros((levels, len(alive)), np.uint64)
    for b in range(width):
        carry = differences(b, alive)
        for level in range(levels):
            counts[level], carry = counts[level] ^ carry, counts[level] & carry
        gone = gone | carry
        if b % (width // 8) == width // 8 - 1:
            # more than the radius: compare the sliced counter with the constant, from the top bit down
            more, equal = np.zeros_like(gone), np.full_like(gone, ALL)
            for level in reversed(range(levels)):
                if radius >> level & 1:
                    equal = equal & counts[level]
                else:
                    more, equal = more | (equal & counts[level]), equal & ~counts[level]
            gone = gone | more
            keep = gone != ALL
            if not keep.all():
                alive, gone, counts = alive[keep], gone[keep], counts[:, keep]
            if not len(alive):
                break
    out = np.zeros_like(dead)
    out[alive] = ~gone
    return out


def lanes_of(mask: np.ndarray) -> np.ndarray:
    words = np.flatnonzero(mask)
    bits = np.unpackbits(mask[words].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, lane = np.nonzero(bits)
    return words[row] * 64 + lane


def mask_of(flags: np.ndarray, lanes: int) -> np.ndarray:
    padded = np.zeros(lanes, np.uint8)
    padded[: len(flags)] = flags
    return np.packbits(padded, bitorder="little").view(np.uint64)


def neighbours(fps: np.ndarray, runs: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within the radius in runs (runs[i]: last index of i's bucket, plus one), lane against lane."""
    planes = planes_of(fps)
    at, left, right = np.arange(len(fps)), [], []
    for d in range(1, int((runs - at).max(initial=0))):
        valid = runs - at > d
        dead = ~mask_of(valid, planes.shape[1] * 64)
        found = lanes_of(within(lambda b, words, d=d: planes[b, words] ^ shifted(planes[b], words, d), dead, radius, len(planes)))
        left.append(found)
        right.append(found + d)
    return (np.concatenate(left), np.concatenate(right)) if left else (at[:0], at[:0])


def bits_of(fps: np.ndarray, k: int) -> list[int]:
    return np.unpackbits(np.ascontiguousarray(fps[k : k + 1]).view(np.uint8), bitorder="little").tolist()


def components_of_bucket(fps: np.ndarray, radius: int) -> np.ndarray:
    """For each member of one large bucket, the index of the first member that it reaches.

    A member that was reached is compared with those not reached so far only: near copies of each other
    leave at once, and the words of lanes that are left are packed anew as they become few. Once fewer are left
    than wait for their turn, those that are left are held against all that wait instead.
    """
    n = len(fps)
    root = np.arange(n)
    rest = np.arange(n)  # not reached, ascending
    planes = planes_of(fps)
    dead = ~mask_of(np.ones(n, bool), planes.shape[1] * 64)
    left = n
    for first in range(n):
        if root[first] != first or not left:
            continue
        lane = np.searchsorted(rest, first)
        if lane >= len(rest) or rest[lane] != first or dead[lane // 64] >> np.uint64(lane % 64) & np.uint64(1):
            continue
        dead[lane // 64] |= np.uint64(1) << np.uint64(lane % 64)
        left -= 1
        queue = [first]
        while queue and left:
            if len(queue) > 2 * left:
                # fewer are left than wait: hold each of those against all that wait
                waiting, count = planes_of(fps[np.array(queue)]), len(queue)
                unused, queue = ~mask_of(np.ones(count, bool), waiting.shape[1] * 64), []
                for lane in lanes_of(~dead).tolist():
                    member = bits_of(fps, rest[lane])
                    if within(lambda b, words, member=member: waiting[b, words] ^ (ALL if member[b] else np.uint64(0)), unused, radius, len(waiting)).any():
                        root[rest[lane]] = first
                        dead[lane // 64] |= np.uint64(1) << np.uint64(lane % 64)
                        left -= 1
                        queue.append(int(rest[lane]))
                continue
            k = queue.pop()
            member = bits_of(fps, k)
            found = lanes_of(within(lambda b, words, member=member: planes[b, words] ^ (ALL if member[b] else np.uint64(0)), dead, radius, len(planes)))
            if len(found):
                root[rest[found]] = first
                np.bitwise_or.at(dead, found // 64, np.uint64(1) << (found % 64).astype(np.uint64))
                left -= len(found)
                queue.extend(rest[found].tolist())
            if left * 4 < len(rest) and len(rest) > 256:
                keep = lanes_of(~dead)
                rest = rest[keep]
                planes = planes_of(fps[rest])
                dead = ~mask_of(np.ones(len(rest), bool), planes.shape[1] * 64)
    return root


def links_of_rows(keys: np.ndarray, fps: np.ndarray, radius: int, small_size: int = SMALL) -> tuple[np.ndarray, np.ndarray]:
    """(row, first row that it reaches) of rows that are sorted by bucket: one link at most for each row."""
    n = len(fps)
    first = np.concatenate(([True], keys[1:] != keys[:-1]))
    begin = np.flatnonzero(first)
    end = np.append(begin[1:], n)
    size = end - begin
    root = np.arange(n)
    for k in np.flatnonzero(size > small_size).tolist():
        a, b = begin[k], end[k]
        root[a:b] = a + components_of_bucket(fps[a:b], radius)
    small = np.flatnonzero(np.repeat((size > 1) & (size <= small_size), size))
    if len(small):
        run = np.cumsum(np.concatenate(([True], keys[small][1:] != keys[small][:-1]))) - 1
        last = np.searchsorted(run, np.arange(run[-1] + 1), side="right")
        for a, b in zip(*(x.tolist() for x in neighbours(fps[small], last[run], radius))):
            a, b = _root(root, small[a]), _root(root, small[b])
            if a != b:
                root[max(a, b)] = min(a, b)
        for k in small.tolist():
            root[k] = _root(root, k)
    linked = np.flatnonzero(root != np.arange(n))
    return linked, root[linked]


def _root(root: np.ndarray, k: int) -> int:
    while root[k] != k:
        root[k] = root[root[k]]
        k = root[k]
    return k


def tables_for(n: int, radius: int = RADIUS) -> list[tuple[list[tuple[int, int]], ...]]:
    """Choices of equal bit blocks, so that any two fingerprints within the radius share one.

    The number of blocks follows the number n of fingerprints: a bucket has 8 random members at most on
    average. Each number of blocks gives the same links; it only trades rows for comparisons.
    """
    blocks = radius + 1
    while blocks < 2 * radius and n > 8 << (64 * (blocks - radius) // blocks):
        blocks += 1
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    spans = [(a, b - a) for a, b in zip(edges, edges[1:])]
    return list(combinations(spans, blocks - radius))


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp long, other long: links between different fingerprints of the column fp (distinct), whose components are those of all pairs within the radius."""
    prepare_workers(fps.sparkSession)
    tables = tables_for(fps.count(), radius)

    def key(spans) -> F.Column:
        parts, width = F.lit(0).cast("long"), 0
        for start, size in spans:
            parts = parts.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", start).bitwiseAND((1 << size) - 1), width))
            width += size
        return parts

    rows = fps.select("fp", F.posexplode(F.array(*(key(spans) for spans in tables))).alias("table", "key"))

    def run(batches):
        import pyarrow as pa

        def out(keys, found):
            a, b = links_of_rows(keys, found.view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(found[a]), pa.array(found[b])], ["fp", "other"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        count, limit = 0, BLOCK_ROWS
        for batch in batches:
            # tables and keys as one number: a table's keys have fewer than 56 bits
            keys = batch.column(0).to_numpy().astype(np.uint64) << np.uint64(56) | batch.column(1).to_numpy().astype(np.uint64)
            held.append((keys, batch.column(2).to_numpy()))
            count += len(keys)
            if count >= limit:
                keys, found = (np.concatenate(x) for x in zip(*held))
                cut = int(np.searchsorted(keys == keys[-1], True)) if keys[-1] != keys[0] else 0
                if cut:  # the last bucket may go on
                    yield out(keys[:cut], found[:cut])
                held, count = [(keys[cut:], found[cut:])], len(keys) - cut
                limit = max(BLOCK_ROWS, 2 * count)
        if count:
            yield out(*(np.concatenate(x) for x in zip(*held)))

    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        rows.repartition(n, "table", "key")
        .sortWithinPartitions("table", "key", "fp")
        .select("table", "key", "fp")
        .mapInArrow(run, "fp long, other long")
        .distinct()
    )


# --- connected components -------------------------------------------------------------------------


def with_least(rows: DataFrame, least: DataFrame, edges: int) -> DataFrame:
    """rows (u, v) with m of their u, from least (u, m, n: u's number of rows).

    Nodes with a MOST_SHARED-th of all edges are hubs; so there are at most 2 * MOST_SHARED of them, and their m is
    broadcast. No task gets all rows of a hub, and no other node has many.
    """
    if edges < FEW_EDGES:
        return rows.join(least.select("u", "m"), "u")
    hubs = least.where(F.col("n") * MOST_SHARED >= edges).select("u", F.col("m").alias("hub_m"))
    dealt = rows.join(F.broadcast(hubs), "u", "left")
    hot = dealt.where("hub_m is not null").select("u", "v", F.col("hub_m").alias("m"))
    return dealt.where("hub_m is null").select("u", "v").join(least.select("u", "m"), "u").unionByName(hot)


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """node long, root long: for each node with an edge, the smallest node of its component.

    Edges (two long columns) of different nodes. Each round joins every node's neighbours to its smallest
    neighbour (large star, then small star); it ends when a round changes nothing. The number of rounds grows with
    the logarithm of the nodes; if ``most_rounds`` don't do, that is an error.
    """
    a, b = edges.columns
    edges = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct(), "edges")
    state = F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))
    before = edges.agg(*state).first()
    for _ in range(most_rounds):
        if not before[0]:
            break
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        # large star: the larger neighbours of u go to the smallest one of u's neighbourhood
        large = with_least(both.where("v > u"), least, before[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small star: the smaller neighbours of u, and u, go to the smallest of them
        small = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        joined = with_least(large, small, before[0])
        edges = written(
            joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u != v").distinct(),
            "edges",
        )
        now = edges.agg(*state).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components are not complete after {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 5, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, fp long, root long, component_id of each row: root names its group, component_id is the group's smallest doc_id."""
    with scratch(docs.sparkSession) as keep:
        found = written(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
        reps = written(found.groupBy("fp").agg(F.min("doc_id").alias("rep")), "representatives")
        roots = components(links(reps.select("fp"), radius))
        grouped = written(reps.join(roots, reps.fp == roots.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")), "grouped")
        ids = grouped.groupBy("root").agg(F.min("rep").alias("component_id"))
        named = written(grouped.join(ids, "root").select("fp", "root", "component_id"), "named")
        return keep(written(found.join(named, "fp").select("doc_id", "text_key", "fp", "root", "component_id"), "groups"))


def keep_one(docs: DataFrame, shingle: int = 5, radius: int | None = None, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group, with all its columns: that of the smallest doc_id (null last; of equal ids, the smallest text_key).

    Groups are those of similar shingles, or with a radius those of 64-bit fingerprints.
    """
    groups = similar_groups(docs, shingle, similarity, id_col, text_col) if radius is None else near_duplicates(docs, shingle, radius, id_col, text_col)
    best = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")).alias("best"))
    kept = best.select(F.col("best.doc_id").alias("__id"), F.col("best.text_key").alias("__key"))
    rows = docs.withColumn("__text_key", F.xxhash64(F.col(text_col).cast("string")))
    rows = rows.join(kept, rows[id_col].eqNullSafe(F.col("__id")) & (rows["__text_key"] == F.col("__key")), "left_semi")
    # the rows of an id are in one partition by now: repeated ones go without another shuffle
    window = Window.partitionBy(F.coalesce(F.col(id_col), F.lit(0).cast(docs.schema[id_col].dataType)), F.col(id_col).isNull(), "__text_key").orderBy(F.lit(0))
    return rows.withColumn("__n", F.row_number().over(window)).where("__n = 1").drop("__n", "__text_key")


# --- groups by similarity -------------------------------------------------------------------------


def odd_bits(similarity: float) -> float:
    """The share of bits in which the fingerprints of two texts differ whose sets of shingles have that Jaccard similarity."""
    from math import acos, pi

    return acos(2 * similarity / (1 + similarity)) / pi


#: 64-bit words of the fingerprints that bands are cut from; those of them that go with each band and are compared.
WORDS, COMPARED = 6, 3
#: One band of so many is searched ahead of the others, which then link clusters instead of texts.
AHEAD = 20


def bands_for(n: int, similarity: float, missed: float = 0.0013) -> tuple[int, int, int]:
    """(bits of a band, bands, radius) for n texts.

    A band has so many bits that random texts share a bucket with 32 others at most on average; there are so
    many bands that of pairs with just the similarity, the share 2 * ``missed`` at most has no band in common, over
    all numbers of odd bits that such a pair may have. The radius is the least that the share ``missed`` of them at
    most exceeds in the bits that are compared. Both only choose candidates.
    """
    from math import ceil, comb, log2

    bits, p = 64 * WORDS, odd_bits(similarity)
    width = max(13, ceil(log2(max(n, 1) / 32)))
    odd, shares = np.arange(bits + 1), lambda bits: np.array([float(comb(bits, k) * (p**k) * (1 - p) ** (bits - k)) for k in range(bits + 1)])
    share, radius = shares(bits), int(np.argmax(1 - np.cumsum(shares(64 * COMPARED)) <= missed))
    equal = (1 - odd / bits) ** width  # of a band
    bands = 1
    while (share * (1 - equal) ** bands).sum() > 2 * missed:
        bands += 1 + bands // 50
    return width, bands, radius


def band_bits(width: int, bands: int) -> np.ndarray:
    """The bits of each band: a permutation of all bits is cut into bands, then another one."""
    random, each = np.random.default_rng(7), 64 * WORDS // width
    return np.concatenate([random.permutation(64 * WORDS)[: each * width].reshape(each, width) for _ in range(-(-bands // each))])[:bands]


MIXERS = 0x9E3779B97F4A7C15


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending; none for a text without words."""
    return np.unique(hashes_of(text, shingle))


def wide_fingerprint(h: np.ndarray, words: int = WORDS) -> bytes:
    """64 * words bits of a set of shingles: each shingle's hash is mixed anew for each 64 bits."""
    if not len(h):
        return bytes(8 * words)
    out = []
    for k in range(words):
        x = h + np.uint64((k + 1) * MIXERS & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        out.append(majority(x ^ x >> np.uint64(31)))
    return np.array(out, "<u8").tobytes()


def components_of_sets(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each set, the index of the first one that it reaches by pairs of at least that Jaccard similarity.

    A set that was reached is compared with those not reached so far only, all at once.
    """
    root, left = np.arange(len(sets)), np.ones(len(sets), bool)
    size = np.array([len(x) for x in sets], np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    dropped = 0
    for first in range(len(sets)):
        queue = [first] if left[first] else []
        left[first] = False
        while queue:
            k = queue.pop()
            at = np.minimum(np.searchsorted(sets[k], flat), max(len(sets[k]) - 1, 0))
            common = np.bincount(owner[sets[k][at] == flat], minlength=len(sets)) if len(sets[k]) else np.zeros(len(sets), np.int64)
            found = np.flatnonzero(left & (common >= similarity * (size + size[k] - common) - 1e-9))
            root[found], left[found] = first, False
            queue.extend(found.tolist())
            dropped += len(found) + 1
            if dropped * 4 > len(sets):
                keep, dropped = left[owner], 0
                flat, owner = flat[keep], owner[keep]
    return root


def links_to_pivots(sets: list[np.ndarray], pivots: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(set, pivot) of all pairs of at least that Jaccard similarity."""
    size = np.array([len(x) for x in sets], np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    left, right = [], []
    for k, pivot in enumerate(pivots):
        if not len(pivot):
            continue
        at = np.minimum(np.searchsorted(pivot, flat), len(pivot) - 1)
        common = np.bincount(owner[pivot[at] == flat], minlength=len(sets))
        found = np.flatnonzero(common >= similarity * (size + len(pivot) - common) - 1e-9)
        left.append(found)
        right.append(np.full(len(found), k))
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def confirmed_large(members: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """node, root: confirmed groups inside large components of candidates (root, fp, text), spread over tasks.

    Each round holds all members of a component against some of its members, the pivots, in parts. What is linked
    so far forms clusters; members outside a component's largest cluster are the next pivots, twice as many each
    round. Once each of them was a pivot, no link between clusters is left to find: a link either is inside the
    largest cluster or has an end that was a pivot. Near copies of one text are done after a round or two.
    """
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / PART))
    sizes = written(members.groupBy("root").agg(F.count(F.lit(1)).alias("n")).select("root", parts.cast("long").alias("parts")), "sizes")
    # large components only: far fewer than one for each thousand members, but counted all the same
    sized = F.broadcast(sizes) if sizes.count() <= LARGEST_BROADCAST else sizes
    dealt = written(members.join(sized, "root").select("root", F.pmod(F.xxhash64("fp"), F.col("parts")).alias("part"), "fp", "text"), "dealt")

    def held(rows, pivots):
        import pyarrow as pa

        sets, ends = ([shingle_hashes(t, shingle) for t in texts_as_bytes(x.column("text").combine_chunks())] if len(x) else [] for x in (rows, pivots))
        a, b = links_to_pivots(sets, ends, similarity) if sets else (np.zeros(0, np.int64),) * 2
        fps, others = (x.column("fp").to_numpy() for x in (rows, pivots))
        # of each member's links the first, and those of its other pivots that join two groups of pivots
        first, root = np.full(len(sets), -1), np.arange(len(ends))
        out = []
        for k, pivot in zip(a.tolist(), b.tolist()):
            if first[k] < 0:
                first[k] = pivot
                out.append((fps[k], others[pivot]))
            elif (x := _root(root, first[k])) != (y := _root(root, pivot)):
                root[max(x, y)] = min(x, y)
                out.append((fps[k], others[pivot]))
        return pa.table({name: pa.array([row[at] for row in out], pa.int64()) for at, name in enumerate(("fp", "other"))})

    waiting, used, edges, pivots = members.select("root", "fp"), None, None, PIVOTS
    while True:
        # the sequence in which members are taken is that of a hash
        place = F.row_number().over(Window.partitionBy("root").orderBy(F.xxhash64("fp"), "fp"))
        now = written(waiting.withColumn("place", place).where(F.col("place") <= pivots).select("root", "fp"), "pivots")
        if not now.take(1):
            return groups
        chosen_rows = members.join(now, ["root", "fp"], "left_semi").join(sized, "root")
        ends = written(chosen_rows.select("root", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "fp", "text"), "ends")
        found = dealt.groupBy("root", "part").cogroup(ends.groupBy("root", "part")).applyInArrow(held, "fp long, other long")
        found = written(found.where("fp != other"), "links")
        edges = found if edges is None else edges.union(found)
        used = now if used is None else used.union(now)
        groups = written(components(edges), "groups")
        named = members.select(F.col("root").alias("component"), "fp").join(groups.toDF("fp", "cluster"), "fp", "left")
        named = written(named.select("component", "fp", F.coalesce("cluster", "fp").alias("cluster")), "clusters")
        largest = named.groupBy("component", "cluster").agg(F.count(F.lit(1)).alias("n")).groupBy("component").agg(F.max(F.struct("n", "cluster")).alias("most"))
        outside = named.join(largest.select("component", F.col("most.cluster").alias("cluster")), ["component", "cluster"], "left_anti")
        waiting = written(outside.select(F.col("component").alias("root"), "fp").join(used, ["root", "fp"], "left_anti"), "waiting")
        pivots *= 2


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key and root (long) of each row: rows of one root are near duplicates.

    Fingerprints of some hundred bits are compared bit-sliced inside the buckets of bands of their bits, so
    that nearly all pairs of at least the similarity are candidates (see ``bands_for``). A few bands go ahead; the
    others only link the clusters that these have made. Inside the components of candidates, texts are linked if the
    Jaccard similarity of their sets of shingles, counted exactly, is at least the given one: what is linked doesn't depend on the fingerprints, thus nor on the number of texts.
    Texts of equal sets are one member; a component of candidates is confirmed in one task if it is small
    (MOST_MEMBERS, MOST_BYTES), and in parts by pivots if it is larger.
    """
    spark = docs.sparkSession
    prepare_workers(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with scratch(spark) as keep:
        return keep(written(_similar_groups(texts, shingle, similarity, id_type), "groups"))


def _similar_groups(texts: DataFrame, shingle: int, similarity: float, id_type: str) -> DataFrame:
    spark = texts.sparkSession
    width, bands, radius = bands_for(texts.count(), similarity)
    places, texts = band_bits(width, bands), texts.withColumn("text_key", F.xxhash64("text"))
    compared = [f"bits_{k}" for k in range(COMPARED)]

    def prints(batches):
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [shingle_hashes(t, shingle) for t in texts_as_bytes(part.column(1))]
                bits = pa.array([wide_fingerprint(h) for h in sets], pa.binary())
                fps = pa.array([xxh64_intdigest(h.tobytes(), SEED) for h in sets], pa.uint64()).view(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), bits, fps], ["doc_id", "text_key", "bits", "fp"])

    found = written(texts.mapInArrow(prints, f"doc_id {id_type}, text_key long, bits binary, fp long"), "fingerprints")
    # of texts with one set of shingles, one stands for all: its key and document find its text again
    reps = found.groupBy("fp").agg(F.min(F.struct("text_key", "doc_id", "bits")).alias("r")).select("fp", "r.text_key", "r.doc_id", "r.bits")
    reps = written(reps, "representatives")

    def dealt(first: int, last: int):
        """A row for each of those bands of each fingerprint: its bucket, its cluster so far, and the words that are compared."""

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    part = batch.slice(at, 500)
                    n = part.num_rows
                    raw = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(n, -1)
                    bits = np.unpackbits(raw, axis=1, bitorder="little")[:, places[first:last]]
                    keys = bits.astype(np.int64) @ (1 << np.arange(width, dtype=np.int64)) | np.arange(first, last, dtype=np.int64) << 40
                    held = [part.column(0).to_numpy(), *raw.view("<i8")[:, :COMPARED].T]
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *(pa.array(np.repeat(x, last - first)) for x in held)], ["key", "cluster", *compared])

        return run

    def linked(batches):
        import pyarrow as pa

        def out(rows):
            cluster = rows[:, 1]
            a, b = (cluster[x] for x in links_of_rows(rows[:, 0], np.ascontiguousarray(rows[:, 2:]).view(np.uint64), radius, 2 * SMALL))
            return pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], ["cluster", "other"])

        held, count, limit = [], 0, BLOCK_ROWS // 2
        for batch in batches:
            held.append(np.stack([x.to_numpy() for x in batch.columns], axis=1))
            count += batch.num_rows
            if count >= limit:
                rows = np.concatenate(held)
                keys = rows[:, 0]
                cut = int(np.searchsorted(keys == keys[-1], True)) if keys[-1] != keys[0] else 0
                if cut:
                    yield out(rows[:cut])
                held, count = [rows[cut:].copy()], len(rows) - cut
                limit = max(BLOCK_ROWS // 2, 2 * count)
        if count:
            yield out(np.concatenate(held))

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    few = lambda rows: F.broadcast(rows) if rows.count() <= LARGEST_BROADCAST else rows
    # a cluster is named by its smallest fingerprint; near copies are mostly one after the bands that go ahead, so that
    # the others don't link each of them anew in each band
    clusters, ahead = reps.select("fp", "bits", F.col("fp").alias("cluster")), -(-bands // AHEAD)
    for first, last in ((0, ahead), (ahead, bands)):
        rows = clusters.select("cluster", "bits").mapInArrow(dealt(first, last), ", ".join(f"{x} long" for x in ("key", "cluster", *compared)))
        rows = rows.repartition(n, "key").sortWithinPartitions("key", "cluster")
        merged = components(rows.mapInArrow(linked, "cluster long, other long").distinct())
        clusters = clusters.join(few(merged), clusters.cluster == merged.node, "left").select("fp", "bits", F.coalesce("root", "cluster").alias("cluster"))
    candidates = clusters.where("fp != cluster").select("fp", F.col("cluster").alias("root"))
    candidates = written(candidates.union(candidates.select("root", "root").distinct()).toDF("fp", "root"), "candidates")
    # the text of one document for each candidate is read again; rows that are repeated as a whole give it more than once, which changes no link
    keys = written(reps.select("fp", "text_key", F.col("doc_id").alias("of")).join(candidates, "fp"), "keys")
    members = texts.join(few(keys), (texts.text_key == keys.text_key) & F.col("doc_id").eqNullSafe(F.col("of"))).select("root", "fp", F.coalesce("text", F.lit("")).alias("text"))
    members = written(members, "members")
    size = F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")
    large = written(members.groupBy("root").agg(*size).where((F.col("n") > MOST_MEMBERS) | (F.col("bytes") > MOST_BYTES)).where("n > 2").select("root"), "large")
    n_large = large.count()

    def confirmed(table):
        import pyarrow as pa

        table = table.sort_by("fp")
        fps = table.column("fp").to_numpy()
        table = table.filter(pa.array(np.append(True, fps[1:] != fps[:-1])))
        root = components_of_sets([shingle_hashes(t, shingle) for t in texts_as_bytes(table.column("text").combine_chunks())], similarity)
        return pa.table({"node": table.column("fp"), "root": table.column("fp").take(pa.array(root))})

    kind = "node long, root long"
    if n_large:
        # far fewer than one for each thousand members, but counted all the same
        large = F.broadcast(large) if n_large <= LARGEST_BROADCAST else large
        roots = members.join(large, "root", "left_anti").groupBy("root").applyInArrow(confirmed, kind)
        roots = roots.unionByName(confirmed_large(members.join(large, "root", "left_semi"), shingle, similarity))
    else:
        roots = members.groupBy("root").applyInArrow(confirmed, kind)
    return found.join(roots, found.fp == roots.node, "left").select("doc_id", "text_key", F.coalesce("root", "fp").alias("root"))


def hex_fingerprint(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
