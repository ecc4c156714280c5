"""Convolutional networks over matrices in numpy: a residual U-Net, and a nested one with dropout that stays on.

A network's numbers of channels are those of its weights, which come from a file of named arrays (`.npz`); the names
are those of the trained modules' parameters and stand together below, as they have to match. Spark deals the work:
a row for each matrix and sample, a random sequence for each that depends on these alone, so that a task which runs
again draws the same. Results are cells of samples, for `grid.sample_statistics` and `grid.to_strain`.
"""

from __future__ import annotations

import io
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

EPS, TEMPERATURE, NOISE_EPS, SLOPE = 1e-5, 0.4, 1e-7, 0.01


# --- layers: arrays are (channels, height, width) -------------------------------------------------


def convolved(x: np.ndarray, weight: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """A convolution of odd kernels whose result is as large as x."""
    k = weight.shape[2] // 2
    windows = np.lib.stride_tricks.sliding_window_view(np.pad(x, ((0, 0), (k, k), (k, k))), weight.shape[2:], (1, 2))
    return np.tensordot(weight, windows, ([1, 2, 3], [0, 3, 4])) + bias[:, None, None]


def widened(x: np.ndarray, weight: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """A transposed convolution of kernel and stride 2."""
    out = np.einsum("ihw,ioab->ohawb", x, weight, optimize=True)
    return out.reshape(weight.shape[1], 2 * x.shape[1], 2 * x.shape[2]) + bias[:, None, None]


def pooled(x: np.ndarray) -> np.ndarray:
    """The maxima of two by two; an odd last row or column goes."""
    h, w = x.shape[1] // 2, x.shape[2] // 2
    return x[:, : 2 * h, : 2 * w].reshape(len(x), h, 2, w, 2).max((2, 4))


def centred(x: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """x with zeros around it up to a height and width; the smaller half stands first."""
    more = [b - a for a, b in zip(x.shape[1:], shape)]
    return np.pad(x, ((0, 0), *((m // 2, m - m // 2) for m in more)))


def rectified(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0)


class Network:
    """Weights by name, and the layers that use them."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = {k: np.asarray(v, float) for k, v in weights.items()}

    def conv(self, x, name):
        return convolved(x, self.w[f"{name}.weight"], self.w[f"{name}.bias"])

    def up(self, x, name):
        return widened(x, self.w[f"{name}.weight"], self.w[f"{name}.bias"])

    def norm(self, x, name):
        scale = self.w[f"{name}.weight"] / np.sqrt(self.w[f"{name}.running_var"] + EPS)
        return x * scale[:, None, None] + (self.w[f"{name}.bias"] - self.w[f"{name}.running_mean"] * scale)[:, None, None]


class ResidualUNet(Network):
    """Down by maxima, up by transposed convolutions, each level by a block of two convolutions beside one of width 1."""

    #: Names of parameters (fixed values).
    FIRST, DOWN, UP, LAST = "inc.conv", "down{}.conv.1", "up{}", "outc.conv.0"

    def block(self, x, name):
        inner = rectified(self.norm(self.conv(x, f"{name}.conv1.0"), f"{name}.conv1.1"))
        both = rectified(self.conv(inner, f"{name}.conv2.0")) + self.conv(x, f"{name}.conv3")
        return rectified(self.norm(both, f"{name}.BN_Relu.0"))

    def sample(self, image: np.ndarray, random=None) -> np.ndarray:
        levels = [self.block(image[None], self.FIRST)]
        while f"{self.DOWN.format(len(levels))}.conv3.weight" in self.w:
            levels.append(self.block(pooled(levels[-1]), self.DOWN.format(len(levels))))
        x = levels.pop()
        for k in range(1, len(levels) + 1):
            beside = levels.pop()
            x = centred(self.up(x, f"{self.UP.format(k)}.up"), beside.shape[1:])
            x = self.block(np.concatenate((beside, x)), f"{self.UP.format(k)}.conv")
        return self.conv(x, self.LAST)[0]


class NestedUNet(Network):
    """A triangle of blocks: block (i, j) takes what (i + 1, j - 1) is widened to and all of (i, 0) to (i, j - 1). Dropout of channels stays on."""

    #: Names of parameters (fixed values).
    BLOCK, UP, LAST, LAST_DROP = "c{}{}", "up{}{}", "conv_last_mean", "conv_last_drop1"

    def dropped(self, x, name, random):
        """Channels scaled by soft samples of being kept."""
        p = 1 / (1 + np.exp(-self.w[f"{name}.p_logit"][0]))
        noise = random.random(len(x))
        logit = np.log(p + NOISE_EPS) - np.log(1 - p + NOISE_EPS) + np.log(noise + NOISE_EPS) - np.log(1 - noise + NOISE_EPS)
        return x * ((1 - 1 / (1 + np.exp(-logit / TEMPERATURE))) / (1 - p))[:, None, None]

    def block(self, x, name, random):
        beside = self.conv(x, f"{name}.resconv")
        for k in (1, 2, 3):
            x = self.norm(self.conv(self.dropped(x, f"{name}.conc_drop{k}", random), f"{name}.double_conv{k}.0"), f"{name}.double_conv{k}.1")
            x = rectified(x) if k < 3 else x
        return rectified(x + beside)

    def sample(self, image: np.ndarray, random) -> np.ndarray:
        grid = [[self.block(image[None], self.BLOCK.format(0, 0), random)]]
        while f"{self.BLOCK.format(len(grid), 0)}.resconv.weight" in self.w:
            grid.append([self.block(pooled(grid[-1][0]), self.BLOCK.format(len(grid), 0), random)])
        for j in range(1, len(grid)):
            for i in range(len(grid) - j):
                wide = self.up(grid[i + 1][j - 1], self.UP.format(i, j))
                grid[i].append(self.block(np.concatenate((wide, *grid[i])), self.BLOCK.format(i, j), random))
        mean = self.conv(self.dropped(grid[0][-1], self.LAST_DROP, random), self.LAST)[0]
        return np.where(mean > 0, mean, SLOPE * mean)


KINDS = {"cnn": ResidualUNet, "bnn": NestedUNet}


@lru_cache(2)
def loaded(kind: str, content: bytes) -> Network:
    with np.load(io.BytesIO(content)) as file:
        return KINDS[kind](dict(file))


class NumpyModel:
    """The protocol of matrix models for one matrix; the networks take it turned over its diagonal."""

    def __init__(self, kind: str, path: str, seed: int = 0):
        with open(path, "rb") as file:
            self.network, self.seed = loaded(kind, file.read()), seed

    def infer(self, matrix: np.ndarray, samples: int = 1) -> np.ndarray:
        return np.stack([self.network.sample(np.asarray(matrix, float).T, np.random.default_rng([self.seed, k])).T for k in range(samples)])


# --- Spark ----------------------------------------------------------------------------------------


def matrices(grid: DataFrame) -> DataFrame:
    """matrix_id, h, w and cells (row by row) of each matrix of a grid; a matrix is a row."""
    cells = F.transform(F.array_sort(F.collect_list(F.struct("r", "c", "v"))), lambda x: x["v"])
    return grid.groupBy("matrix_id").agg((F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w"), cells.alias("cells"))


def inferred(rows: DataFrame, kind: str, weights: bytes, samples: int = 1, seed: int = 0, tasks: int | None = None) -> DataFrame:
    """matrix_id, sample, r, c, v of matrices (matrix_id, h, w, cells): each sample of each matrix is work of its own."""
    from ..sources.formats import prepare_workers

    spark = rows.sparkSession
    prepare_workers(spark)
    sent = spark.sparkContext.broadcast(weights)  # one file of weights, whatever the number of matrices
    name = rows.schema["matrix_id"].dataType.simpleString()

    def run(batches):
        network = loaded(kind, sent.value)
        for batch in batches:
            for matrix_id, h, w, cells, sample in zip(batch.matrix_id, batch.h, batch.w, batch.cells, batch["sample"]):
                random = np.random.default_rng([seed, zlib.crc32(str(matrix_id).encode()), sample])
                found = network.sample(np.asarray(cells, float).reshape(h, w).T, random).T
                r, c = np.indices(found.shape)
                yield pd.DataFrame({"matrix_id": matrix_id, "sample": sample, "r": r.ravel(), "c": c.ravel(), "v": found.ravel()})

    dealt = rows.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    dealt = dealt.repartition(tasks or max(1, spark.sparkContext.defaultParallelism), "matrix_id", "sample")
    return dealt.select("matrix_id", "h", "w", "cells", "sample").mapInPandas(run, f"matrix_id {name}, sample int, r int, c int, v double")
