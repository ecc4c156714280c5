"""Exact nearest neighbours of a stated set of query vectors.

Queries go out in passes of at most PASS_BYTES (usually one); each task scans its vectors batch by batch, holds them
against BLOCK queries at a time and keeps the best k for each query, so that a task returns at most k rows for a
query. A last window picks the best of these.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

BLOCK, PASS_BYTES = 256, 32 << 20


def nearest(vectors: DataFrame, queries: DataFrame, k: int, vec_key: str = "vec_id", vec_col: str = "embedding", query_key: str = "query_id", query_col: str = "embedding") -> DataFrame:
    """query_id, vec_id, distance (squared L2), score 1 / (1 + distance), rank from 0; ties go to the smaller key."""
    import numpy as np

    rows = vectors.where(F.col(vec_col).isNotNull()).select(F.col(vec_key).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    asked = queries.where(F.col(query_col).isNotNull()).select(F.col(query_key).cast("long").alias("q"), F.col(query_col).cast("array<double>").alias("v")).toLocalIterator()

    def scan(ids, points):
        def run(batches):
            import pandas as pd

            blocks = range(0, len(ids), BLOCK)
            best = {b: (np.empty((len(ids[b : b + BLOCK]), 0)), np.empty((len(ids[b : b + BLOCK]), 0), np.int64)) for b in blocks}
            for batch in batches:
                if not len(batch):
                    continue
                v, keys = np.stack(batch.v.to_numpy()), batch.vec_id.to_numpy()
                for at in range(0, len(v), 512):
                    for b in blocks:
                        best_d, best_k = best[b]
                        part = ((points[b : b + BLOCK, None, :] - v[None, at : at + 512, :]) ** 2).sum(2)
                        d = np.concatenate((best_d, part), 1)
                        n = np.concatenate((best_k, np.broadcast_to(keys[at : at + 512], part.shape)), 1)
                        order = np.lexsort((n, d), axis=1)[:, :k]
                        best[b] = np.take_along_axis(d, order, 1), np.take_along_axis(n, order, 1)
            for b, (best_d, best_k) in best.items():
                if width := best_d.shape[1]:
                    yield pd.DataFrame({"query_id": np.repeat(ids[b : b + BLOCK], width), "vec_id": best_k.ravel(), "distance": best_d.ravel()})

        return rows.mapInPandas(run, "query_id long, vec_id long, distance double")

    found, held, size = None, [], 0
    for row in asked:
        held.append(row)
        size += 8 * len(row.v)
        if size >= PASS_BYTES:
            part = scan(np.array([r.q for r in held]), np.array([r.v for r in held]))
            found, held, size = part if found is None else found.unionByName(part), [], 0
    if held or found is None:
        part = scan(np.array([r.q for r in held], np.int64), np.array([r.v for r in held])) if held else rows.sparkSession.createDataFrame([], "query_id long, vec_id long, distance double")
        found = part if found is None else found.unionByName(part)
    by = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(by) - 1).where(F.col("rank") < k)
    return ranked.withColumn("score", 1 / (1 + F.col("distance")))
