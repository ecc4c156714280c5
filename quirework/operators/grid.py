"""Moving-window numerics over grids (matrix_id, r, c, v), as ordered windows and column arithmetic.

NaN marks an invalid cell and spreads to each window that holds it. Windows are valid-mode: only full ones stay.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, Window, functions as F

# The default light source and medium.
WAVELENGTH, BANDWIDTH, REFRACTIVE_INDEX = 840e-9, 50e-9, 1.0
KEYS = ("matrix_id", "r", "c", "v")


def from_arrays(rows: DataFrame, key: str, values: str, row: Column, matrix: Column) -> DataFrame:
    """A grid of which each input row is a row: its array's places are the columns."""
    return rows.select(matrix.alias("matrix_id"), row.cast("int").alias("r"), F.posexplode(F.col(values).cast("array<double>")).alias("c", "v"))


def invalid_zeros(grid: DataFrame) -> DataFrame:
    return grid.withColumn("v", F.when(F.col("v") == 0, F.lit(float("nan"))).otherwise(F.col("v")))


def _moving(grid: DataFrame, along: str, across: str, n: int, *columns: str) -> DataFrame:
    """Means of columns over n cells along an axis; the cell keeps the place of the window's begin."""
    window = Window.partitionBy("matrix_id", across).orderBy(along).rowsBetween(0, n - 1)
    out = grid.withColumns({c: F.avg(c).over(window) for c in columns} | {"__n": F.count(F.lit(1)).over(window)})
    return out.where(F.col("__n") == n).drop("__n")


def box_filter(grid: DataFrame, nx: int, nz: int = 1) -> DataFrame:
    """Circular mean: magnitude m and angle a of the mean of e^(iv) over nx columns, then nz rows."""
    parts = grid.select("matrix_id", "r", "c", F.cos("v").alias("re"), F.sin("v").alias("im"))
    parts = _moving(parts, "c", "r", nx, "re", "im")
    if nz > 1:
        parts = _moving(parts, "r", "c", nz, "re", "im")
    return parts.select("matrix_id", "r", "c", F.hypot("re", "im").alias("m"), F.atan2("im", "re").alias("a"))


def row_difference(field: DataFrame, g: int) -> DataFrame:
    """v: the wrapped phase between rows r and r + g, per row; g is at most the number of rows less one."""
    height = field.groupBy("matrix_id").agg((F.max("r") - F.min("r")).alias("__most"))
    # a row for each matrix, beside its cells
    rows = field.join(height, "matrix_id")
    step = F.least(F.lit(g), F.col("__most"))
    later = field.select("matrix_id", F.col("r").alias("__r"), "c", F.col("a").alias("a2"), F.col("m").alias("m2"))
    pairs = rows.withColumn("__r", F.col("r") + step).where("__most >= 1").join(later, ["matrix_id", "__r", "c"])
    turn = F.col("a2") - F.col("a")
    weight = F.col("m") * F.col("m2")
    return pairs.select("matrix_id", "r", "c", (F.atan2(weight * F.sin(turn), weight * F.cos(turn)) / step).alias("v"))


def to_strain(phase: Column, wavelength: float = WAVELENGTH, bandwidth: float = BANDWIDTH, refractive_index: float = REFRACTIVE_INDEX) -> Column:
    """Strain of a mean phase; NaN becomes 0."""
    scaled = phase * wavelength / (4 * pi * refractive_index) * 1e3 / (wavelength**2 / bandwidth)
    return F.nanvl(scaled, F.lit(0.0))


def vector_strain(grid: DataFrame, nx: int = 25, nz: int = 25, g: int = 1, **physical) -> DataFrame:
    """The strain map of a phase grid by the vector method: matrix_id, r, c, v."""
    if nx < 1 or nz < 1 or g < 1:
        raise ValueError("nx, nz and g must be at least 1")
    local = row_difference(box_filter(invalid_zeros(grid), nx), g)
    mean = _moving(local.select("matrix_id", "r", "c", F.cos("v").alias("re"), F.sin("v").alias("im")), "r", "c", nz, "re", "im")
    return mean.select("matrix_id", "r", "c", to_strain(F.atan2("im", "re"), **physical).alias("v"))


def centre_crop(grid: DataFrame, multiple: int = 32) -> DataFrame:
    """The middle of each matrix, its sides cut down to multiples; the smaller half is cut first."""
    sides = grid.groupBy("matrix_id").agg((F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w"))
    rows = grid.join(sides, "matrix_id")
    keep, shift = F.lit(True), {}
    for at, side in (("r", "h"), ("c", "w")):
        cut = F.col(side) % multiple
        first = F.floor(cut / 2).cast("int")
        keep = keep & (F.col(at) >= first) & (F.col(at) < first + F.col(side) - cut)
        shift[at] = F.col(at) - first
    return rows.where(keep).select("matrix_id", shift["r"].alias("r"), shift["c"].alias("c"), "v")


def sample_statistics(samples: DataFrame) -> DataFrame:
    """Mean and sample deviation of each cell over samples (matrix_id, r, c, sample, v)."""
    return samples.groupBy("matrix_id", "r", "c").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("deviation"))


def finite(v: Column) -> Column:
    return ~F.isnan(v) & (F.abs(v) != float("inf"))


def extent(grid: DataFrame) -> DataFrame:
    """matrix_id, low, high over finite cells, 0 if there are none."""
    v = F.when(finite(F.col("v")), F.col("v"))
    return grid.groupBy("matrix_id").agg(F.coalesce(F.min(v), F.lit(0.0)).alias("low"), F.coalesce(F.max(v), F.lit(0.0)).alias("high"))


def drawable(v: Column) -> Column:
    """NaN to 0, infinities to the largest numbers."""
    most = 1.7976931348623157e308
    return F.when(F.isnan(v), 0.0).when(v == float("inf"), most).when(v == float("-inf"), -most).otherwise(v)


def as_rows(grid: DataFrame) -> DataFrame:
    """matrix_id, r, row: each row of a matrix as an array."""
    return grid.groupBy("matrix_id", "r").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "v"))), lambda x: x["v"]).alias("row"))
