"""Queries of grid numerics: the vectors of ``embeddings`` are the rows of a matrix for each label."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import grid as G
from .catalog import query, table

GRID_SQL = """
rows_ AS (SELECT label AS matrix_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS r, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
grid AS (SELECT matrix_id, r, i AS c, CASE WHEN matrix_id = 0 AND r = 3 AND i = 5 THEN 0.0 ELSE e[i + 1] END AS v FROM rows_, unnest(range(0, 64)) AS t(i))"""
BOX_SQL = """
polar AS (SELECT matrix_id, r, c, CASE WHEN v = 0 THEN 'NaN'::DOUBLE ELSE cos(v) END AS re, CASE WHEN v = 0 THEN 'NaN'::DOUBLE ELSE sin(v) END AS im FROM grid),
wide AS (SELECT matrix_id, r, c, avg(re) OVER w AS re, avg(im) OVER w AS im FROM polar WINDOW w AS (PARTITION BY matrix_id, r ORDER BY c ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) QUALIFY count(*) OVER w = 5),
box AS (SELECT matrix_id, r, c, sqrt(re * re + im * im) AS m, atan2(im, re) AS a FROM wide)"""


def phase_grid(spark, sf):
    by = Window.partitionBy("label").orderBy("vec_id")
    rows = table(spark, sf, "embeddings").withColumn("r", F.row_number().over(by) - 1)
    cells = G.from_arrays(rows, "vec_id", "embedding", F.col("r"), F.col("label"))
    hole = (F.col("matrix_id") == 0) & (F.col("r") == 3) & (F.col("c") == 5)
    return cells.withColumn("v", F.when(hole, 0.0).otherwise(F.col("v")))


@query(f"WITH {GRID_SQL}, {BOX_SQL} SELECT matrix_id, r::INT AS r, c::INT AS c, CASE WHEN isnan(m) THEN -1 ELSE round(m, 9) END AS m, CASE WHEN isnan(a) THEN -9 ELSE round(a, 9) END AS a FROM box")
def rnk_09_box_filter(spark, sf):
    out = G.box_filter(G.invalid_zeros(phase_grid(spark, sf)), 5)
    return out.select("matrix_id", "r", "c", F.round(F.nanvl("m", F.lit(-1.0)), 9).alias("m"), F.round(F.nanvl("a", F.lit(-9.0)), 9).alias("a"))


DIFFERENCE_SQL = """
diff AS (SELECT x.matrix_id, x.r, x.c, atan2(x.m * y.m * sin(y.a - x.a), x.m * y.m * cos(y.a - x.a)) / 2 AS v FROM box x JOIN box y ON x.matrix_id = y.matrix_id AND x.c = y.c AND y.r = x.r + 2)"""


@query(f"WITH {GRID_SQL}, {BOX_SQL}, {DIFFERENCE_SQL} SELECT matrix_id, r::INT AS r, c::INT AS c, round(v, 9) AS v FROM diff WHERE NOT isnan(v)")
def rnk_10_row_difference(spark, sf):
    out = G.row_difference(G.box_filter(G.invalid_zeros(phase_grid(spark, sf)), 5), 2)
    return out.where(~F.isnan("v")).select("matrix_id", "r", "c", F.round("v", 9).alias("v"))


@query(
    f"""WITH {GRID_SQL}, {BOX_SQL}, {DIFFERENCE_SQL},
tall AS (SELECT matrix_id, r, c, avg(cos(v)) OVER w AS re, avg(sin(v)) OVER w AS im FROM diff WINDOW w AS (PARTITION BY matrix_id, c ORDER BY r ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) QUALIFY count(*) OVER w = 3)
SELECT matrix_id, r::INT AS r, c::INT AS c, round(CASE WHEN isnan(re) THEN 0 ELSE atan2(im, re) * 840e-9 / (4 * pi() * 1.0) * 1e3 / (840e-9 * 840e-9 / 50e-9) END, 6) AS v FROM tall"""
)
def rnk_11_vector_strain(spark, sf):
    return G.vector_strain(phase_grid(spark, sf), nx=5, nz=3, g=2).withColumn("v", F.round("v", 6))


@query(f"WITH {GRID_SQL}, h AS (SELECT matrix_id, max(r) + 1 AS h FROM grid GROUP BY matrix_id) SELECT matrix_id, (r - (h % 24) // 2)::INT AS r, (c - 8)::INT AS c, v FROM grid JOIN h USING (matrix_id) WHERE r >= (h % 24) // 2 AND r < (h % 24) // 2 + h - h % 24 AND c >= 8 AND c < 56")
def rnk_12_centre_crop(spark, sf):
    return G.centre_crop(phase_grid(spark, sf), 24)


@query(f"WITH {GRID_SQL} SELECT r % 3 AS matrix_id, (r // 3)::INT AS r, c::INT AS c, round(avg(v), 9) AS mean, round(stddev_samp(v), 9) AS deviation FROM grid GROUP BY ALL")
def agg_08_sample_statistics(spark, sf):
    cells = phase_grid(spark, sf).select((F.col("r") % 3).alias("matrix_id"), F.floor(F.col("r") / 3).cast("int").alias("r"), "c", F.col("matrix_id").alias("sample"), "v")
    return G.sample_statistics(cells).select("matrix_id", "r", "c", F.round("mean", 9).alias("mean"), F.round("deviation", 9).alias("deviation"))


@query(f"WITH {GRID_SQL} SELECT matrix_id, min(v) AS low, max(v) AS high FROM grid WHERE v <> 0 GROUP BY matrix_id")
def agg_09_extent(spark, sf):
    return G.extent(G.invalid_zeros(phase_grid(spark, sf)))


@query("SELECT row_number() OVER (PARTITION BY label ORDER BY vec_id)::INT - 1 AS r, label AS matrix_id, CAST(embedding AS DOUBLE[]) AS row FROM embeddings WHERE label <> 0")
def src_36_array_rows(spark, sf):
    return G.as_rows(phase_grid(spark, sf).where("matrix_id <> 0").withColumn("v", G.drawable(F.col("v"))))
