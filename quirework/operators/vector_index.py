"""Nearest neighbours by inverted lists with product-quantised residuals, re-ranked by true distances.

`train` fits the lists' centres and the code words by k-means on a bounded sample (SAMPLE rows, those of least hash),
and measures on it how many lists and candidates a search needs for a wanted recall. `write` puts every vector, with
its code, into the table of its nearest centre's list, sorted by list, so that a search reads little more than the
codes of the lists it probes; a list of very many vectors is spread over files and tasks.

A search sends a batch of queries (of bounded size) to the tasks that scan codes. Each finds the best candidates of
each query by the sums of a table of distances for each part of the code, and ranks them by true distance as they come;
k of each query leave the task, so nothing is joined or broadcast. With ``exact``, a second scan follows. The k-th true distance so far is a bar; a
vector's distance is at least that of its code less the code's error, and a list's at least that of its centre less
the list's reach, so all that can pass the bar is found and ranked, and the result is that of the whole scan.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

#: Rows that training looks at; lists at most; queries at once.
SAMPLE, MOST_LISTS, QUERIES = 50_000, 4096, 1024
WORDS = 256


@dataclass
class Books:
    """centres (lists x dims) and words (parts x 256 x dims of a part); probes and candidates for the wanted recall."""

    centres: np.ndarray
    words: np.ndarray
    probes: int
    candidates: int

    def padded(self, v: np.ndarray) -> np.ndarray:
        return np.pad(v, ((0, 0), (0, self.centres.shape[1] - v.shape[1])))

    def encode(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(list, code, error, reach) of vectors: error and reach are the distances from the code's vector and from the list's centre."""
        v = self.padded(v)
        lists = nearest_of(v, self.centres)
        rest = v - self.centres[lists]
        parts, _, width = self.words.shape
        codes, left = np.empty((len(v), parts), np.uint8), rest.copy()
        for m in range(parts):
            codes[:, m] = nearest_of(rest[:, m * width : (m + 1) * width], self.words[m])
            left[:, m * width : (m + 1) * width] -= self.words[m][codes[:, m]]
        return lists, codes, np.sqrt((left**2).sum(1)), np.sqrt((rest**2).sum(1))

    def distances(self, queries: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances (queries x codes) of padded queries from the vectors of codes in list ``at``."""
        parts, _, width = self.words.shape
        rest = queries - self.centres[at]
        out = np.zeros((len(queries), len(codes)))
        for m in range(parts):
            table = ((rest[:, None, m * width : (m + 1) * width] - self.words[m][None]) ** 2).sum(2)
            out += table[:, codes[:, m]]
        return out


@dataclass
class Index:
    books: Books
    vectors: DataFrame
    reaches: DataFrame


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0)


def nearest_of(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    step = max(1, (1 << 23) // len(centres))
    return np.concatenate([squares(v[k : k + step], centres).argmin(1) for k in range(0, len(v), step)] or [np.zeros(0, np.int64)])


def means(v: np.ndarray, n: int, rounds: int = 12) -> np.ndarray:
    """k-means from evenly spread rows; a centre that loses all its rows takes the row that is farthest from its own."""
    centres = v[np.linspace(0, len(v) - 1, n).astype(int)].copy()
    for _ in range(rounds):
        lists = nearest_of(v, centres)
        count = np.bincount(lists, minlength=n)
        sums = np.zeros_like(centres)
        np.add.at(sums, lists, v)
        centres[count > 0] = sums[count > 0] / count[count > 0, None]
        if (lost := np.flatnonzero(count == 0)).size:
            far = ((v - centres[lists]) ** 2).sum(1).argsort()[::-1][: lost.size]
            centres[lost[: far.size]] = v[far]
    return centres


def train(vectors: DataFrame, key: str = "vec_id", col: str = "embedding", lists: int | None = None, parts: int = 16, recall: float = 0.97, k: int = 25, sample: int = SAMPLE) -> Books:
    """Centres, code words, and the numbers of probes and candidates that give the recall on the sample."""
    rows = vectors.where(F.col(col).isNotNull())
    n = rows.count()
    seen = np.array([r[0] for r in rows.orderBy(F.xxhash64(key), key).limit(sample).select(F.col(col).cast("array<double>")).collect()], float)
    if not len(seen):
        return Books(np.zeros((1, parts)), np.zeros((parts, WORDS, 1)), 1, k)
    seen = np.pad(seen, ((0, 0), (0, -seen.shape[1] % parts)))
    lists = max(1, min(lists or int(n**0.5), MOST_LISTS, len(seen)))
    centres = means(seen, lists)
    at = nearest_of(seen, centres)
    rest, width = seen - centres[at], seen.shape[1] // parts
    words = np.stack([means(rest[:, m * width : (m + 1) * width], WORDS) for m in range(parts)])
    books = Books(centres, words, lists, k)
    _, codes, _, _ = books.encode(seen)
    # how it fares on up to 200 rows of the sample as queries
    asked = seen[:: max(1, len(seen) // 200)][:200]
    near = np.argsort(squares(asked, seen), 1, kind="stable")[:, :k]
    order = np.argsort(squares(asked, centres), 1)
    place = np.argsort(order, 1)  # of each list in a query's order
    needed = np.sort(place[np.arange(len(asked))[:, None], at[near]].ravel())
    books.probes = int(needed[min(len(needed) - 1, int(np.ceil(len(needed) * (1 + recall) / 2)))]) + 1
    close = np.full((len(asked), len(seen)), np.inf)
    for c in range(lists):
        some, mine = np.flatnonzero(place[:, c] < books.probes), np.flatnonzero(at == c)
        if len(some) and len(mine):
            close[np.ix_(some, mine)] = books.distances(asked[some], c, codes[mine])
    rank = np.argsort(np.argsort(close, 1, kind="stable"), 1)
    found = np.sort(np.where(np.isinf(np.take_along_axis(close, near, 1)), len(seen), np.take_along_axis(rank, near, 1)).ravel())
    books.candidates = max(k, int(min(found[min(len(found) - 1, int(np.ceil(len(found) * recall)))], len(seen) - 1)) + 1)
    return books


def encoded(vectors: DataFrame, books: Books, col: str = "embedding") -> DataFrame:
    """``vectors`` with list, code, error and reach; rows without a vector are left out."""
    from ..sources.formats import prepare_workers

    prepare_workers(vectors.sparkSession)
    rows = vectors.where(F.col(col).isNotNull())
    at = rows.columns.index(col)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column(at)
            v = flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            lists, codes, error, reach = books.encode(v)
            made = [pa.array(lists.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), pa.array(reach)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "list", "code", "error", "reach"])

    made = StructType.fromDDL("list int, code binary, error double, reach double")
    return rows.mapInArrow(run, StructType([*rows.schema.fields, *made.fields]))


def write(vectors: DataFrame, books: Books, folder: str, key: str = "vec_id", col: str = "embedding") -> None:
    """The lists in a folder: all columns of ``vectors``, and their codes."""
    encoded(vectors, books, col).repartitionByRange("list", key).sortWithinPartitions("list").write.parquet(f"{folder}/lists")
    spark = vectors.sparkSession
    spark.read.parquet(f"{folder}/lists").groupBy("list").agg(F.max("reach").alias("reach"), F.count(F.lit(1)).alias("n")).write.parquet(f"{folder}/reaches")
    raw = spark.createDataFrame([(books.centres.tobytes(), len(books.centres), books.words.tobytes(), books.words.shape[0], books.probes, books.candidates)], "centres binary, lists int, words binary, parts int, probes int, candidates int")
    raw.coalesce(1).write.parquet(f"{folder}/books")


def read(spark: SparkSession, folder: str) -> Index:
    r = spark.read.parquet(f"{folder}/books").first()
    books = Books(np.frombuffer(bytes(r.centres)).reshape(r.lists, -1), np.frombuffer(bytes(r.words)).reshape(r.parts, WORDS, -1), r.probes, r.candidates)
    return Index(books, spark.read.parquet(f"{folder}/lists"), spark.read.parquet(f"{folder}/reaches"))


def _scan(index: Index, rows: DataFrame, key: str, col: str, ids: np.ndarray, points: np.ndarray, chosen: np.ndarray, k: int, most: int | None, bars: np.ndarray | None) -> DataFrame:
    """q, vec_key, distance: each task's k nearest vectors of each query, by true distance. chosen: queries x lists that
    are probed. Looked at are those among the task's best ``most`` by their codes, or all that the bars let pass."""
    books = index.books

    def run(batches):
        import pyarrow as pa

        near = np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
        # the best by codes so far: their distances only, as those that enter are ranked at once
        best = None if most is None else [np.zeros(0, np.float32)] * len(ids)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, lists, error = (batch.column(n).to_numpy(zero_copy_only=False) for n in (0, 1, 3))
            codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(keys), -1)
            v = books.padded(batch.column(4).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(keys), -1))
            for at in np.unique(lists).tolist():
                some, mine = np.flatnonzero(chosen[:, at]), np.flatnonzero(lists == at)
                for begin in range(0, len(some), 64):
                    asked = some[begin : begin + 64]
                    d = books.distances(points[asked], at, codes[mine])
                    if bars is not None:
                        # what was found since lowers the bar
                        bar = np.minimum(bars[asked], np.sqrt(near[0][asked, -1]) * (1 + 1e-9) + 1e-9)
                        passed = np.sqrt(d) - error[mine][None] <= bar[:, None]
                    for row, q in enumerate(asked.tolist()):
                        if bars is not None:
                            look = np.flatnonzero(passed[row])
                        else:
                            both = np.concatenate((best[q], d[row].astype(np.float32)))
                            if len(both) > most:
                                both = np.partition(both, most - 1)[:most]
                                look = np.flatnonzero(d[row].astype(np.float32) <= both.max())
                            else:
                                look = np.arange(len(mine))
                            best[q] = both
                        if not len(look):
                            continue
                        apart = ((points[q][None] - v[mine[look]]) ** 2).sum(1)
                        closer = apart <= near[0][q, -1]
                        if closer.any():
                            every_d, every_k = np.concatenate((near[0][q], apart[closer])), np.concatenate((near[1][q], keys[mine[look[closer]]]))
                            order = np.lexsort((every_k, every_d))[:k]
                            near[0][q], near[1][q] = every_d[order], every_k[order]
        q, place = np.nonzero(np.isfinite(near[0]))
        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(near[1][q, place]), pa.array(near[0][q, place])], ["q", "vec_key", "distance"])

    probed = np.flatnonzero(chosen.any(0)).tolist()
    if len(probed) < len(books.centres):
        rows = rows.where(F.col("list").isin(probed))
    return rows.select(F.col(key).cast("long"), "list", "code", "error", F.col(col).cast("array<double>")).mapInArrow(run, "q long, vec_key long, distance double")


def search(index: Index, queries: DataFrame, k: int, probes: int | None = None, candidates: int | None = None, exact: bool = False, where: Column | None = None, gone: DataFrame | None = None, key: str = "vec_id", col: str = "embedding", query_key: str = "query_id", query_col: str = "embedding") -> DataFrame:
    """query_id, vec_id, distance (squared), score 1 / (1 + distance), rank from 0; ties go to the smaller key.

    where: a condition on the index's columns, so on metadata that was written with the vectors. gone: keys (column
    ``key``) that count no more. Keys are whole numbers.
    """
    from ..sources.formats import prepare_workers

    spark, books = queries.sparkSession, index.books
    prepare_workers(spark)
    rows = index.vectors if where is None else index.vectors.where(where)
    if gone is not None:
        rows = rows.join(gone.select(key), key, "left_anti")
    asked = queries.where(F.col(query_col).isNotNull()).select(F.col(query_key).cast("long").alias("q"), F.col(query_col).cast("array<double>").alias("point"))
    reach = np.full(len(books.centres), -np.inf)
    reaches = index.reaches.collect()  # a row for each list
    for r in reaches:
        reach[r.list] = r.reach
    in_order = Window.partitionBy("q").orderBy("distance", "vec_key")

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(in_order)).where(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)

    out, held = None, []

    def answered(held: list) -> DataFrame:
        ids, points = np.array([r.q for r in held], np.int64), books.padded(np.array([r.point for r in held], float))
        from_centre = np.sqrt(squares(points, books.centres))
        chosen = np.argsort(np.argsort(from_centre, 1), 1) < (probes or books.probes)
        found = ranked(_scan(index, rows, key, col, ids, points, chosen, k, max(k, candidates or books.candidates), None))
        if not exact:
            return found
        # the k-th true distance so far, a number for each query; without k candidates nothing is ruled out
        bars = np.full(len(ids), np.inf)
        place = {q: n for n, q in enumerate(ids.tolist())}
        for r in found.where(F.col("rank") == k - 1).select("q", "distance").collect():
            bars[place[r.q]] = np.sqrt(r.distance)
        bars = bars * (1 + 1e-9) + 1e-9
        able = from_centre - reach[None] <= bars[:, None]
        return ranked(_scan(index, rows, key, col, ids, points, able, k, None, bars))

    for row in asked.toLocalIterator() if reaches else ():
        held.append(row)
        if len(held) == QUERIES:
            part = answered(held)
            out, held = part if out is None else out.unionByName(part), []
    if held:
        part = answered(held)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], "q long, vec_key long, distance double, rank int")
    return out.select(F.col("q").alias("query_id"), F.col("vec_key").alias("vec_id"), "distance", (1 / (1 + F.col("distance"))).alias("score"), "rank")


def get(index: Index, keys: DataFrame, key: str = "vec_id") -> DataFrame:
    """The index's rows of keys."""
    return index.vectors.join(keys.select(key).distinct(), key, "left_semi").drop("list", "code", "error", "reach")
