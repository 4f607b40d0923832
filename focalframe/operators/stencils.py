"""Neighbourhood operators on rows of pixels: each takes and returns (frame, y, row, height).

One shuffle deals rows with their halo to bands; a band is then one dense block for an Arrow kernel. Chained steps share the
halo, so a whole chain costs one shuffle. Integer inputs stay integers wherever the operator is exact in them.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..raster import BAND, with_halo


def _kernel(fn: Callable, halo: int, edge: str, columns: tuple[str, ...], out: pa.DataType):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        band = key[1].as_py()
        table = table.sort_by("y").combine_chunks()
        y, height = table["y"].to_numpy(), table["height"][0].as_py()
        own = (y // BAND == band) & (y >= 0) & (y < height)
        blocks = []
        for name in columns:
            lists = table[name].combine_chunks()
            block = lists.flatten().to_numpy().reshape(len(lists), -1)
            blocks.append(np.pad(block, ((0, 0), (halo, halo)), mode="reflect" if edge == "reflect" else "edge") if halo else block)
        made = fn(*blocks)
        inner = made if len(made) == int(own.sum()) else made[own[halo : len(y) - halo]]
        width = inner.shape[1]
        rows = pa.ListArray.from_arrays(pa.array(np.arange(len(inner) + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(inner).ravel(), out))
        n = len(inner)
        return pa.Table.from_arrays([pa.array([key[0].as_py()] * n, pa.int32()), pa.array(y[own], pa.int32()), rows, pa.array([height] * n, pa.int32())], names=["frame", "y", "row", "height"])

    return run


def stencil(frames: DataFrame, halo: int, fn: Callable, edge: str = "reflect", integer: bool = True, columns: tuple[str, ...] = ("row",)) -> DataFrame:
    """Applies ``fn`` to blocks padded by ``halo`` on all sides; it returns the block without the padding."""
    banded = with_halo(frames.select("frame", "y", "height", *columns), halo, edge)
    kind = "bigint" if integer else "double"
    schema = f"frame int, y int, row array<{kind}>, height int"
    return banded.groupBy("frame", "band").applyInArrow(_kernel(fn, halo, edge, columns, pa.int64() if integer else pa.float64()), schema)


def box(block: np.ndarray, radius: int) -> np.ndarray:
    """Sums over (2r + 1) squares; the result is 2r smaller each way."""
    if radius < 1:
        return block
    for axis in (0, 1):
        sums = np.concatenate([np.zeros_like(block.take([0], axis)), np.cumsum(block, axis)], axis)
        n, k = sums.shape[axis], 2 * radius + 1
        block = sums.take(range(k, n), axis) - sums.take(range(n - k), axis)
    return block


def laplace(block: np.ndarray) -> np.ndarray:
    return block[:-2, 1:-1] + block[2:, 1:-1] + block[1:-1, :-2] + block[1:-1, 2:] - 4 * block[1:-1, 1:-1]


def laplacian(frames: DataFrame) -> DataFrame:
    """Four-neighbour Laplacian, border mirrored without the border sample."""
    return stencil(frames, 1, laplace)


def sharpness(frames: DataFrame, radius: int) -> DataFrame:
    """Box sums of the squared Laplacian; the halo covers both steps."""
    return stencil(frames, 1 + radius, lambda block: box(laplace(block) ** 2, radius))


def box_sum(frames: DataFrame, radius: int) -> DataFrame:
    """Sums over (2r + 1) squares; divide by their count for the mean filter."""
    return stencil(frames, radius, lambda block: box(block, radius))


def gaussian_taps(sigma: float) -> np.ndarray:
    """Normalised taps out to max(1, ceil(3 sigma))."""
    radius = max(1, math.ceil(3 * sigma))
    raw = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return raw / raw.sum()


def separable(block: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """Weighted sums along both axes."""
    k = len(taps)
    for axis in (0, 1):
        n = block.shape[axis] - k + 1
        block = sum(w * block.take(range(i, i + n), axis) for i, w in enumerate(taps))
    return block


def gaussian_blur(frames: DataFrame, sigma: float) -> DataFrame:
    """Separable Gaussian, mirrored border."""
    taps = gaussian_taps(sigma)
    return stencil(frames, len(taps) // 2, lambda block: separable(block.astype(float), taps), integer=False)


def downsample2(frames: DataFrame) -> DataFrame:
    """Blur of sigma 1, then every second row and column, the first included."""
    kept = gaussian_blur(frames, 1.0).where("y % 2 = 0")
    return kept.select("frame", F.expr("cast(y div 2 AS int)").alias("y"), F.expr("filter(row, (v, i) -> i % 2 = 0)").alias("row"), F.expr("cast((height + 1) div 2 AS int)").alias("height"))


def second_difference(frames: DataFrame) -> DataFrame:
    """|2 v - above - below|, the border row repeated."""
    return stencil(frames, 1, lambda block: np.abs(2 * block[1:-1] - block[:-2] - block[2:])[:, 1:-1], "replicate")


def median(frames: DataFrame, radius: int) -> DataFrame:
    """Median over (2r + 1) squares of integers, border repeated."""

    def middle(block: np.ndarray) -> np.ndarray:
        views = np.lib.stride_tricks.sliding_window_view(block, (2 * radius + 1, 2 * radius + 1))
        flat = views.reshape(*views.shape[:2], -1)
        return np.partition(flat, flat.shape[-1] // 2, axis=-1)[..., flat.shape[-1] // 2]

    return stencil(frames, radius, middle, "replicate")


def local_energy(frames: DataFrame) -> DataFrame:
    """3 x 3 mean of absolute values."""
    return stencil(frames, 1, lambda block: box(np.abs(block), 1) / 9.0, integer=False)


def guided_filter(frames: DataFrame, guide: str, source: str, radius: int, eps: float) -> DataFrame:
    """Guided filter (He et al. 2010) of the array column ``source`` by ``guide``; mirrored border, both rounds of means in one halo."""
    count = float((2 * radius + 1) ** 2)

    def run(i: np.ndarray, p: np.ndarray) -> np.ndarray:
        i, p = i.astype(float), p.astype(float)
        mi, mp, mip, mii = (box(x, radius) / count for x in (i, p, i * p, i * i))
        a = (mip - mi * mp) / (mii - mi * mi + eps)
        b = mp - a * mi
        inner = i[2 * radius : i.shape[0] - 2 * radius, 2 * radius : i.shape[1] - 2 * radius]
        return box(a, radius) / count * inner + box(b, radius) / count

    return stencil(frames, 2 * radius, run, integer=False, columns=(guide, source))


def upsample(frames: DataFrame, height: int, width: int) -> DataFrame:
    """Bilinear resize with half-pixel centres and clamped borders: each target row joins its two source rows by number."""
    scale = f"cast(height AS double) / {height}"
    targets = frames.sparkSession.range(height).select(F.col("id").cast("int").alias("ty"))
    spots = frames.select("frame", "height").distinct().crossJoin(F.broadcast(targets)).withColumn("at", F.expr(f"greatest(0D, least(cast(height - 1 AS double), (ty + 0.5D) * ({scale}) - 0.5D))"))
    spots = spots.select("frame", "ty", F.floor("at").cast("int").alias("lo"), (F.col("at") - F.floor("at")).alias("f")).withColumn("hi", F.expr("lo + CASE WHEN f > 0 THEN 1 ELSE 0 END"))
    a, b = (frames.select("frame", F.col("y").alias(n), F.col("row").alias(f"{n}_row")) for n in ("lo", "hi"))
    mixed = spots.join(a, ["frame", "lo"]).join(b, ["frame", "hi"]).withColumn("row", F.expr("zip_with(lo_row, hi_row, (p, q) -> (1D - f) * p + f * q)"))
    at = f"greatest(0D, least(cast(size(row) - 1 AS double), (tx + 0.5D) * (cast(size(row) AS double) / {width}) - 0.5D))"
    wide = F.expr(f"transform(sequence(0, {width - 1}), tx -> (1D - ({at} - floor({at}))) * row[cast(floor({at}) AS int)] + ({at} - floor({at})) * row[cast(least(floor({at}) + 1, size(row) - 1) AS int)])")
    return mixed.select("frame", F.col("ty").alias("y"), wide.alias("row"), F.lit(height).alias("height"))
