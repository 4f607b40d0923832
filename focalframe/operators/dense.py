"""Fusion methods on rows of pixels: Laplacian pyramids with arg-max fusion, refined depth maps, softmax blends, slabs and tiles of them;
and the registration of neighbours.

Frames are tables (frame, y, row, height), optionally with ``stack`` (several stacks at once, numbered from 0) and ``valid`` (a mask row).
Work along y takes bands of rows with a halo, merges over frames take one row of all frames, so no task holds a frame or an image.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..raster import with_halo
from . import fuse, registry
from .stencils import box, gaussian_taps, median, separable, sharpness

TAPS = gaussian_taps(1.0)
#: Rows in a band, at least; frames in a stack at most, and levels in a pyramid, for numbers made of both.
ROWS = 512
FRAMES = 1 << 16
LEVELS = 64
#: Floors of coverage and of divisors, rounds and tolerance of filling, guided filter's epsilon, floor of the rest's weight.
COVERED, FLOOR, ROUNDS, SETTLED, EPS, REST = 1e-6, 1e-8, 64, 1e-5, 1e-4, 1e-6


def padded(block: np.ndarray, by: int) -> np.ndarray:
    return np.pad(block, by, mode="reflect")


def window_mean(block: np.ndarray, radius: int) -> np.ndarray:
    return box(padded(block, radius), radius) / (2 * radius + 1) ** 2


def halve(block: np.ndarray) -> np.ndarray:
    """Blur of sigma 1, then every second sample."""
    return separable(padded(block, len(TAPS) // 2), TAPS)[::2, ::2]


def stretched(block: np.ndarray, first: int, height: int, rows: np.ndarray, full: int, width: int) -> np.ndarray:
    """Rows of a bilinear resize (half-pixel centres, clamped) to ``full`` x ``width``, from ``block``: the rows from ``first`` on of ``height``."""
    for axis, at, n, size in ((0, rows, height, full), (1, np.arange(width), block.shape[1], width)):
        spot = np.clip((at + 0.5) * n / size - 0.5, 0, n - 1)
        low = np.floor(spot).astype(int)
        part = (spot - low).reshape((-1, 1) if axis == 0 else (1, -1))
        start, have = (first, block.shape[0]) if axis == 0 else (0, n)
        near, far = (np.clip(np.minimum(low + k, n - 1) - start, 0, have - 1) for k in (0, 1))
        block = block.take(near, axis) * (1 - part) + block.take(far, axis) * part
    return block


def resize(block: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    return stretched(block, 0, len(block), np.arange(shape[0]), *shape)


def depth_for(shape: tuple[int, int]) -> int:
    return max(1, int(math.floor(math.log2(max(1, min(shape))))) - 5)


def pyramid(block: np.ndarray, depth: int) -> list[np.ndarray]:
    """Detail levels, finest first, and the coarse rest."""
    coarse = [block]
    for _ in range(depth):
        coarse.append(halve(coarse[-1]))
    return [a - resize(b, a.shape) for a, b in zip(coarse, coarse[1:])] + coarse[-1:]


def collapse(levels: list[np.ndarray]) -> np.ndarray:
    image = levels[-1]
    for detail in reversed(levels[:-1]):
        image = resize(image, detail.shape) + detail
    return image


def mean3(block: np.ndarray) -> np.ndarray:
    """3 x 3 means, summed term by term, so that bands and whole arrays give the same bits."""
    return separable(padded(block, 1), np.ones(3)) / 9.0


def _dense(table: pa.Table, column: str = "row") -> np.ndarray:
    lists = table[column].combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _lists(block: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = block.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(block).ravel(), kind))


def staged(frames: DataFrame) -> DataFrame:
    """(stack, frame, y, row, height, valid): stack 0 and no masks where there are none."""
    stack = "stack" if "stack" in frames.columns else F.lit(0).alias("stack")
    valid = "valid" if "valid" in frames.columns else F.lit(None).cast("array<boolean>").alias("valid")
    return frames.select(stack, "frame", "y", "row", "height", valid)


def _levels(depth: int, band: int):
    """The own rows of a band at every level of a frame's pyramid. Bands and halos are multiples of 2 ** depth rows."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        stack, frame, number = (k.as_py() for k in key)
        table = table.sort_by("y")
        first, height = table["y"][0].as_py(), table["height"][0].as_py()
        coarse, heights, starts = [_dense(table).astype(float)], [height], [first]
        ok = [_dense(table, "valid").astype(float)] if table["valid"].null_count == 0 else None
        for _ in range(depth):
            coarse.append(halve(coarse[-1]))
            heights.append((heights[-1] + 1) // 2)
            starts.append(starts[-1] // 2)
            if ok:
                ok.append(halve(ok[-1]))
        made = []
        for k, block in enumerate(coarse):
            rows = starts[k] + np.arange(len(block))
            if k < depth:
                block = block - stretched(coarse[k + 1], starts[k + 1], heights[k + 1], rows, heights[k], block.shape[1])
                energy = mean3(np.abs(block))
            else:
                energy = mean3(np.abs(block - mean3(block))) + REST
            good = ok[k] > 0.5 if ok else None
            if ok:
                energy = np.where(good, energy, -np.inf if k < depth else 0.0)
            own = (rows >= number * band >> k) & (rows < (number + 1) * band >> k) & (rows < heights[k])
            n = int(own.sum())
            ids = {"stack": stack, "frame": frame, "level": k, "top": depth}
            columns = {name: pa.array([v] * n, pa.int32()) for name, v in ids.items()} | {"y": pa.array(rows[own], pa.int32()), "height": pa.array([heights[k]] * n, pa.int32()), "full": pa.array([height] * n, pa.int32())}
            columns |= {"value": _lists(block[own], pa.float64()), "energy": _lists(energy[own], pa.float64()), "ok": _lists(good[own], pa.bool_()) if ok else pa.nulls(n, pa.list_(pa.bool_()))}
            made.append(pa.table(columns))
        return pa.concat_tables(made)

    return run


_LEVEL_COLUMNS = "stack int, frame int, level int, top int, y int, height int, full int, value array<double>, energy array<double>, ok array<boolean>"


def pyramid_levels(frames: DataFrame, depth: int | None = None) -> DataFrame:
    """(stack, frame, level, top, y, height, full, value, energy, ok): rows of each frame's pyramid; level ``top`` is the coarse rest.

    A mask is averaged like the frame and holds where it is above one half; there is no energy where it does not hold.
    """
    frames = staged(frames)
    if depth is None:
        depth = depth_for(tuple(frames.agg(F.min("height"), F.min(F.size("row"))).first()[:]) if frames.limit(1).count() else (1, 1))
    unit = 1 << depth
    band, halo = max(ROWS, unit), -(-(5 * unit) // unit) * unit
    return with_halo(frames, halo, "none", band).groupBy("stack", "frame", "band").applyInArrow(_levels(depth, band), _LEVEL_COLUMNS)


def _fused(key: tuple, table: pa.Table) -> pa.Table:
    """One row of one level: the value of most energy, ties to the lowest frame; the rest level is averaged by energy."""
    table = table.sort_by("frame")
    shape = (table.num_rows, -1)
    value, energy = (table[c].combine_chunks().flatten().to_numpy().reshape(shape) for c in ("value", "energy"))
    top = table["top"][0].as_py()
    pick = energy.argmax(0)
    merged = (value * energy).sum(0) / np.maximum(energy.sum(0), FLOOR) if key[1].as_py() == top else np.take_along_axis(value, pick[None], 0)[0]
    ids = {n: pa.array([table[n][0].as_py()], pa.int32()) for n in ("stack", "level", "top", "y", "height", "full")}
    return pa.table(ids | {"value": _lists(merged[None], pa.float64()), "winner": _lists(table["frame"].to_numpy()[pick][None].astype(np.int32), pa.int32())})


def pmax_levels(frames: DataFrame, smoothing: int = 1, depth: int | None = None) -> DataFrame:
    """(stack, level, top, y, height, full, value, winner): the fused pyramid.

    Winner maps of the detail levels are median-filtered with radius ``smoothing`` (0: not at all); where that changes the winner, the
    coefficient is taken from the new one, if it is valid there.
    """
    levels = pyramid_levels(frames, depth)
    fused = levels.groupBy("stack", "level", "y").applyInArrow(_fused, "stack int, level int, top int, y int, height int, full int, value array<double>, winner array<int>")
    if not smoothing:
        return fused
    maps = fused.where("level < top").select((F.col("stack") * LEVELS + F.col("level")).alias("frame"), "y", F.col("winner").cast("array<bigint>").alias("row"), "height")
    smooth = median(maps, smoothing).select(F.expr(f"cast(frame div {LEVELS} AS int)").alias("stack"), (F.col("frame") % LEVELS).alias("level"), "y", F.col("row").cast("array<int>").alias("smooth"))
    both = fused.join(smooth, ["stack", "level", "y"], "left")
    moved = both.where("smooth IS NOT NULL").select("stack", "level", "y", F.posexplode(F.arrays_zip("winner", "smooth")).alias("x", "w")).where("w.winner <> w.smooth")
    wanted = moved.groupBy("stack", "level", "y", F.col("w.smooth").alias("frame")).agg(F.collect_list("x").alias("xs"))
    read = wanted.join(levels.select("stack", "level", "y", "frame", F.col("value").alias("from"), "ok"), ["stack", "level", "y", "frame"])
    read = read.select("stack", "level", "y", F.explode(F.expr("transform(filter(xs, x -> ok IS NULL OR ok[x]), x -> struct(x, from[x] AS v))")).alias("p"))
    patch = read.groupBy("stack", "level", "y").agg(F.map_from_entries(F.collect_list("p")).alias("patch"))
    value = F.expr("CASE WHEN patch IS NULL THEN value ELSE transform(value, (v, x) -> coalesce(patch[x], v)) END")
    return both.join(patch, ["stack", "level", "y"], "left").select("stack", "level", "top", "y", "height", "full", value.alias("value"), F.coalesce("smooth", "winner").alias("winner"))


def _collapsed(band: int):
    """The own rows of a band of the image, from the rows of all levels around it."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        stack, number = (k.as_py() for k in key)
        image = first = height = None
        for k in range(table["top"][0].as_py(), -1, -1):
            level = table.filter(pc.equal(table["level"], k)).sort_by("y")
            rows, block, size = level["y"].to_numpy(), _dense(level, "value"), level["height"][0].as_py()
            image = block if image is None else stretched(image, first, height, rows, size, block.shape[1]) + block
            first, height = rows[0], size
        own = rows // band == number
        n = int(own.sum())
        return pa.table({"stack": pa.array([stack] * n, pa.int32()), "y": pa.array(rows[own], pa.int32()), "row": _lists(image[own], pa.float64()), "height": pa.array([height] * n, pa.int32())})

    return run


def pmax(frames: DataFrame, smoothing: int = 1, depth: int | None = None, band: int = ROWS) -> DataFrame:
    """(stack, y, row, height): the image of the fused pyramid."""
    levels = pmax_levels(frames, smoothing, depth)
    # Row y of a level touches rows from (y - 2) to (y + 3) times 2 ** level of the image.
    span = f"sequence(cast(greatest(0, floor((y - 2) * shiftleft(1, level) / {band})) AS int), cast(least((full - 1) div {band}, floor((y + 3) * shiftleft(1, level) / {band})) AS int))"
    dealt = levels.select("stack", "level", "top", "y", "height", "value", F.explode(F.expr(span)).alias("band"))
    return dealt.groupBy("stack", "band").applyInArrow(_collapsed(band), "stack int, y int, row array<double>, height int")


def guided(guide: np.ndarray, source: np.ndarray, radius: int, eps: float) -> np.ndarray:
    """Guided filter (He et al. 2010), mirrored border."""
    mi, mp, mip, mii = (window_mean(x, radius) for x in (guide, source, guide * source, guide * guide))
    a = (mip - mi * mp) / (mii - mi * mi + eps)
    return window_mean(a, radius) * guide + window_mean(mp - a * mi, radius)


def fill_unknown(field: np.ndarray, known: np.ndarray, radius: int) -> np.ndarray:
    """``field`` where it is known; elsewhere the fixed point of averaging over the windows' reached samples (normalised convolution).

    Each round reaches ``radius`` further; rounds end when all is reached and nothing moves by ``SETTLED`` any more, or after ``ROUNDS``.
    """
    value, reached = np.where(known, field, 0.0), known.copy()
    for _ in range(ROUNDS):
        cover = window_mean(reached.astype(float), radius)
        near = ~known & (cover > COVERED)
        before = value[near]
        value[near] = (window_mean(value, radius)[near] / np.maximum(cover[near], FLOOR))
        reached |= near
        if reached.all() and np.abs(value[near] - before).max(initial=0.0) < SETTLED:
            break
    return value


def dmap_fold(frames: DataFrame, radius: int) -> DataFrame:
    """(stack, y, height, index, sharp): rows of the sharpest frame of each pixel and of its sharpness; masked samples lose, ties go to the lowest frame."""
    frames = staged(frames)
    sharp = sharpness(frames.select((F.col("stack") * FRAMES + F.col("frame")).alias("frame"), "y", "row", "height"), radius)
    sharp = sharp.select(F.expr(f"cast(frame div {FRAMES} AS int)").alias("stack"), (F.col("frame") % FRAMES).alias("frame"), "y", "row", "height")
    if dict(frames.dtypes).get("valid") and not frames.where("valid IS NOT NULL").isEmpty():
        sharp = sharp.join(frames.select("stack", "frame", "y", "valid"), ["stack", "frame", "y"]).withColumn("row", F.expr("zip_with(row, valid, (v, ok) -> CASE WHEN ok THEN v ELSE -1L END)")).drop("valid")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("frame")
        energy = _dense(table)
        pick = energy.argmax(0)
        ids = {n: pa.array([table[n][0].as_py()], pa.int32()) for n in ("stack", "y", "height")}
        return pa.table(ids | {"index": _lists(table["frame"].to_numpy()[pick][None].astype(float), pa.float64()), "sharp": _lists(np.maximum(energy.max(0), 0)[None].astype(float), pa.float64())})

    return sharp.groupBy("stack", "y").applyInArrow(run, "stack int, y int, height int, index array<double>, sharp array<double>")


def refine_index(winners: DataFrame, percentile: float = 7.0, radius: int = 16) -> DataFrame:
    """(stack, y, row): the index of ``winners(stack, y, height, index, sharp)`` smoothed by its sharpness (guided filter) and filled where sharpness is
    not above its percentile; all counts as decided where nothing is above it.

    Bands take a halo as wide as filling reaches in all its rounds.
    """
    fill = max(2, radius // 2)
    if "stack" not in winners.columns:
        winners = winners.withColumn("stack", F.lit(0))
    if "height" not in winners.columns:
        winners = winners.join(F.broadcast(winners.groupBy("stack").agg((F.max("y") + 1).alias("height"))), "stack")
    stats = winners.select("stack", F.explode("sharp").alias("s")).groupBy("stack").agg(F.expr(f"percentile(s, {percentile / 100}D)").alias("least"), F.max("s").alias("most"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        stack, band = (k.as_py() for k in key)
        table = table.sort_by("y")
        rows, index, sharp = table["y"].to_numpy(), _dense(table, "index").astype(float), _dense(table, "sharp").astype(float)
        least, most = table["least"][0].as_py(), table["most"][0].as_py()
        out = guided(sharp / (most + FLOOR), index, radius, EPS)
        if most > least:
            out = fill_unknown(out, sharp > least, fill)
        own = rows // ROWS == band
        n = int(own.sum())
        return pa.table({"stack": pa.array([stack] * n, pa.int32()), "y": pa.array(rows[own], pa.int32()), "row": _lists(out[own], pa.float64())})

    banded = with_halo(winners.join(stats, "stack"), 2 * radius + ROUNDS * fill, "none", ROWS)
    return banded.groupBy("stack", "band").applyInArrow(run, "stack int, y int, row array<double>")


def composite_rows(frames: DataFrame, index: DataFrame) -> DataFrame:
    """(stack, y, row, height): the two frames around each pixel's fractional ``index(stack, y, row)``, mixed; the index is clipped to the frames."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("frame")
        rows, at = _dense(table).astype(float), np.clip(_dense(table.slice(0, 1), "at")[0], 0, table.num_rows - 1)
        low = np.floor(at).astype(int)
        high = np.minimum(low + 1, table.num_rows - 1)
        mixed = np.take_along_axis(rows, low[None], 0)[0] * (1 - (at - low)) + np.take_along_axis(rows, high[None], 0)[0] * (at - low)
        ids = {n: pa.array([table[n][0].as_py()], pa.int32()) for n in ("stack", "y", "height")}
        return pa.table(ids | {"row": _lists(mixed[None], pa.float64())})

    met = staged(frames).drop("valid").join(index.select("stack", "y", F.col("row").alias("at")), ["stack", "y"])
    return met.groupBy("stack", "y").applyInArrow(run, "stack int, y int, height int, row array<double>").select("stack", "y", "row", "height")


def dmap(frames: DataFrame, radius: int = 8, percentile: float = 7.0, smoothing: int = 16) -> DataFrame:
    """(stack, y, row, height, depth): sharpest frames, refined index, composite; depth is the index over the last frame's number."""
    frames = staged(frames)
    index = refine_index(dmap_fold(frames, radius), percentile, smoothing)
    counts = frames.groupBy("stack").agg(F.greatest(F.max("frame"), F.lit(1)).alias("last"))
    depth = index.join(F.broadcast(counts), "stack").select("stack", "y", F.expr("transform(row, i -> i / last)").alias("depth"))
    return composite_rows(frames, index).join(depth, ["stack", "y"])


def weighted(frames: DataFrame, radius: int = 8, temperature: float = 0.05) -> DataFrame:
    """(stack, y, row, height): softmax-weighted mean of the frames; sharpness (0 where masked) is scaled by its 99.9th percentile in the middle frame (at least 1e-8)."""
    frames = staged(frames)
    sharp = sharpness(frames.select((F.col("stack") * FRAMES + F.col("frame")).alias("frame"), "y", "row", "height"), radius)
    sharp = sharp.select(F.expr(f"cast(frame div {FRAMES} AS int)").alias("stack"), (F.col("frame") % FRAMES).alias("frame"), "y", F.col("row").alias("sharp"))
    middle = frames.groupBy("stack").agg(F.expr("cast((max(frame) + 1) div 2 AS int)").alias("frame"))
    scale = sharp.join(F.broadcast(middle), ["stack", "frame"]).select("stack", F.explode("sharp").alias("s")).groupBy("stack").agg(F.greatest(F.expr("percentile(s, 0.999)"), F.lit(FLOOR)).alias("scale"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("frame")
        rows, logit = _dense(table).astype(float), _dense(table, "sharp").astype(float)
        if table["valid"].null_count == 0:
            logit = np.where(_dense(table, "valid"), logit, 0.0)
        logit = logit / table["scale"][0].as_py() / temperature
        weight = np.exp(logit - logit.max(0))
        ids = {n: pa.array([table[n][0].as_py()], pa.int32()) for n in ("stack", "y", "height")}
        return pa.table(ids | {"row": _lists(((rows * weight).sum(0) / np.maximum(weight.sum(0), FLOOR))[None], pa.float64())})

    met = frames.join(sharp, ["stack", "frame", "y"]).join(F.broadcast(scale), "stack")
    return met.groupBy("stack", "y").applyInArrow(run, "stack int, y int, height int, row array<double>").select("stack", "y", "row", "height")


#: The fusion methods by name.
METHODS: dict[str, Callable[..., DataFrame]] = {}


def register(name: str) -> Callable:
    """Registers a method (frames, **parameters) -> (stack, y, row, height, ...) under a name."""

    def add(method: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        METHODS[name] = method
        return method

    return add


register("pmax")(lambda frames, selection_smoothing=1, **_: pmax(frames, selection_smoothing))
register("dmap")(lambda frames, estimation_radius=8, contrast_threshold=7.0, smoothing_radius=16, **_: dmap(frames, estimation_radius, contrast_threshold, smoothing_radius))
register("weighted")(lambda frames, sharpness_radius=8, temperature=0.05, **_: weighted(frames, sharpness_radius, temperature))


def fused_by(name: str, frames: DataFrame, **parameters) -> DataFrame:
    """Runs a registered method; an unknown name, and a parameter that is unknown or out of its range, are errors that say what is known."""
    if name not in METHODS:
        raise ValueError(f"unknown method {name!r}; known: {', '.join(sorted(METHODS))}")
    return METHODS[name](frames, **(registry.checked(name, parameters) if name in registry.METHODS else parameters))


@register("slab")
def slab(frames: DataFrame, slab_size: int = 10, slab_overlap: int = 2, inner_method: str = "pmax", outer_method: str = "dmap", **parameters) -> DataFrame:
    """Overlapping runs of frames are fused by the inner method, their images by the outer one. Masks are not used."""
    n = frames.agg(F.max("frame") + 1).first()[0] or 0
    dealt = fuse.in_slabs(frames.select("frame", "y", "row", "height"), n, slab_size, slab_overlap).withColumnRenamed("slab", "stack").withColumn("stack", F.col("stack").cast("int"))
    inner = fused_by(inner_method, dealt.withColumn("frame", F.expr(f"cast(frame - stack * {slab_size - slab_overlap} AS int)")), **parameters)
    images = inner.select(F.col("stack").alias("frame"), "y", F.expr("transform(row, v -> cast(rint(v * 256) AS bigint))").alias("row"), "height")
    out = fused_by(outer_method, images, **parameters)
    return out.withColumn("row", F.expr("transform(row, v -> v / 256)"))


def tiled(name: str, frames: DataFrame, tile: int = 2048, overlap: int = 128, **parameters) -> DataFrame:
    """(y, x, v): a method run on overlapping tiles, each a stack of its own, and their images averaged under feathered weights."""
    frames = staged(frames)
    height, width = frames.agg(F.max("height"), F.max(F.size("row"))).first()
    depth = depth_for((height, width))
    overlap = max(overlap, 1 << depth)
    tile = max(tile, 4 * overlap)
    size = frames.sparkSession.range(1).select(F.lit(0).alias("stack"), F.lit(height).cast("long").alias("h"), F.lit(width).cast("long").alias("w"))
    step = tile - overlap
    columns = max(1, -(-max(width - overlap, 1) // step)) if height > tile or width > tile else 1
    plan = fuse.tile_plan(size, tile, overlap).select(F.expr(f"cast(y0 div {step} * {columns} + x0 div {step} AS int)").alias("stack"), "y0", "x0", "y1", "x1")
    held = frames.drop("stack").join(F.broadcast(plan), (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1")))
    cut = "slice({}, cast(x0 + 1 AS int), cast(x1 - x0 AS int))"
    parts = held.select("stack", "frame", F.expr("cast(y - y0 AS int)").alias("y"), F.expr(cut.format("row")).alias("row"), F.expr("cast(least(y1, height) - y0 AS int)").alias("height"), F.expr(cut.format("valid")).alias("valid"))
    made = pmax(parts, parameters.get("selection_smoothing", 1), depth) if name == "pmax" else fused_by(name, parts, **parameters)
    spots = made.join(F.broadcast(plan), "stack").select("y0", "x0", "y1", "x1", (F.col("y") + F.col("y0")).alias("y"), F.posexplode("row").alias("dx", "v")).withColumn("x", F.col("dx") + F.col("x0"))
    weight = F.expr(f"({fuse.feather('y', 'y0', 'y1', str(height), overlap)}) * ({fuse.feather('x', 'x0', 'x1', str(width), overlap)})")
    summed = spots.withColumn("wt", weight).groupBy("y", "x").agg((F.sum(F.col("wt") * F.col("v")) / F.greatest(F.sum("wt"), F.lit(FLOOR))).alias("v"))
    return summed.select(F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "v")


def phase_shift(a: np.ndarray, b: np.ndarray) -> tuple[float, float, float]:
    """(dy, dx, peak) of phase correlation under a Hann window: ``b`` is ``a`` shifted cyclically by (dy, dx); peak is its height over the mean."""
    taper = np.hanning(len(a))[:, None] * np.hanning(a.shape[1])
    fa, fb = np.fft.rfft2(taper * a), np.fft.rfft2(taper * b)
    product = fb * fa.conj()
    surface = np.fft.irfft2(product / (np.abs(product) + FLOOR), s=a.shape)
    top = divmod(int(np.argmax(surface)), a.shape[1])
    # Shifts of more than half a side count as negative ones.
    dy, dx = ((p + (n - 1) // 2) % n - (n - 1) // 2 for p, n in zip(top, a.shape))
    return float(dy), float(dx), float(surface[top] / (np.abs(surface).mean() + 1e-12))


def neighbour_shifts(frames: DataFrame) -> DataFrame:
    """(link, dy, dx, peak) for each frame and the next: rows go to the two links of their frame, a kernel takes a pair (of proxies, for large frames)."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        link = key[0].as_py()
        pair = [table.filter(pc.equal(table["frame"], f)).sort_by("y") for f in (link, link + 1)]
        made = []
        if all(t.num_rows for t in pair):
            a, b = (_dense(t).astype(float) for t in pair)
            made = [(link, *phase_shift(a, b))] if a.shape == b.shape else []
        columns = list(zip(*made)) or [[], [], [], []]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("link", "dy", "dx", "peak"), columns, (pa.int32(), pa.float64(), pa.float64(), pa.float64()))})

    dealt = frames.select("frame", "y", "row", F.explode(F.expr("array(frame, frame - 1)")).alias("link"))
    return dealt.groupBy("link").applyInArrow(run, "link int, dy double, dx double, peak double")
