"""Fusion of a stack into one image: keyed arg-max, softmax blend, composite, slabs, overlapping tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..raster import pixels
from .stencils import sharpness


def winners(energy: DataFrame, value: str = "v", valid: str | None = None) -> DataFrame:
    """(y, x, winner, energy): per pixel the frame of greatest energy, ties to the lowest frame; invalid samples lose to all others."""
    e = F.col(value) if valid is None else F.when(F.col(valid), F.col(value))
    usable = energy.withColumn("e", e)
    lowest = F.min("frame")
    best = usable.groupBy("y", "x").agg(F.max_by("frame", F.when(F.col("e").isNotNull(), F.struct("e", -F.col("frame")))).alias("w"), lowest.alias("f"), F.max("e").alias("energy"))
    return best.select("y", "x", F.coalesce("w", "f").alias("winner"), "energy")


def depth_map_winner(frames: DataFrame, radius: int) -> DataFrame:
    """Sharpness, then arg-max over frames."""
    return winners(pixels(sharpness(frames, radius)))


def weighted_blend(frames: DataFrame, radius: int, temperature: float) -> DataFrame:
    """(y, x, v) of the softmax blend of one stack."""
    from .dense import weighted

    return pixels(weighted(frames, radius, temperature).withColumn("frame", F.lit(0))).select("y", "x", "v")


def composite(frames: DataFrame, index: DataFrame, n: int) -> DataFrame:
    """(y, x, v): blend of frames floor(i) and floor(i) + 1 for a fractional index ``index(y, x, i)``; the upper one only where it counts."""
    low = F.expr(f"cast(least(floor(i), {n - 1}) AS int)")
    parts = F.expr(f"array(struct(lo AS frame, 1D - f AS w), struct(least(lo + 1, {n - 1}) AS frame, f AS w))")
    wanted = index.withColumn("lo", low).withColumn("f", F.expr("i - lo")).select("y", "x", F.explode(parts).alias("p")).select("y", "x", "p.frame", "p.w").where("w > 0")
    return wanted.join(pixels(frames), ["frame", "y", "x"]).groupBy("y", "x").agg(F.sum(F.col("w") * F.col("v")).alias("v"))


def slab_step(size: int, overlap: int) -> int:
    if size <= overlap:
        raise ValueError(f"slabs of {size} frames cannot overlap by {overlap}")
    return size - overlap


def slab_plan(counts: DataFrame, size: int, overlap: int) -> DataFrame:
    """(stack, slab, start_frame, end_frame) of overlapping slabs for ``counts(stack, n)``; the first that reaches the end is the last."""
    step = slab_step(size, overlap)
    last = f"greatest(0, ceil((n - {size}) / {step}))"
    return counts.select("stack", "n", F.explode(F.expr(f"sequence(0L, cast({last} AS bigint))")).alias("slab")).select("stack", "slab", (F.col("slab") * step).alias("start_frame"), F.expr(f"least(slab * {step} + {size}, n)").alias("end_frame"))


def in_slabs(frames: DataFrame, n: int, size: int, overlap: int) -> DataFrame:
    """``frames`` with ``slab``, once for each slab of a stack of ``n`` frames that holds the frame."""
    step = slab_step(size, overlap)
    last = max(0, -(-(n - size) // step))
    return frames.withColumn("slab", F.explode(F.expr(f"sequence(greatest(0, cast(ceil((frame - {size - 1}) / {step}D) AS int)), least({last}, cast(frame div {step} AS int)))")))


def slab_winners(frames: DataFrame, radius: int, size: int, overlap: int, n: int) -> DataFrame:
    """(slab, y, x, winner): the arg-max inside each slab; frames in two slabs take part in both."""
    dealt = in_slabs(pixels(sharpness(frames, radius)), n, size, overlap)
    return dealt.groupBy("slab", "y", "x").agg(F.max_by("frame", F.struct("v", -F.col("frame"))).alias("winner"))


def tile_plan(sizes: DataFrame, tile: int, overlap: int) -> DataFrame:
    """(stack, y0, x0, y1, x1) of the overlapping tiles that cover ``sizes(stack, h, w)``; one tile when the image fits."""
    step = tile - overlap

    def starts(n: str) -> str:
        return f"CASE WHEN h <= {tile} AND w <= {tile} THEN array(0L) ELSE sequence(0L, cast((greatest({n} - {overlap}, 1) - 1) div {step} AS bigint) * {step}, {step}L) END"

    plan = sizes.withColumn("y0", F.explode(F.expr(starts("h")))).withColumn("x0", F.explode(F.expr(starts("w"))))
    return plan.select("stack", "y0", "x0", F.expr(f"least(y0 + {tile}, h)").alias("y1"), F.expr(f"least(x0 + {tile}, w)").alias("x1"))


def feather(at: str, lo: str, hi: str, n: str, overlap: int) -> str:
    """SQL for a tile's weight along one axis: ramps from 1 / (r + 1) to 1 over the first and last r samples, none at the image's border."""
    r = f"least({max(overlap, 1)}, {hi} - {lo})"
    up = f"1D / ({r} + 1) + ({at} - {lo}) * (1D - 1D / ({r} + 1)) / greatest({r} - 1, 1)"
    down = f"1D - ({at} - ({hi} - {r})) * (1D - 1D / ({r} + 1)) / greatest({r} - 1, 1)"
    return f"CASE WHEN {hi} <> {n} AND {at} >= {hi} - {r} THEN {down} WHEN {lo} <> 0 AND {at} < {lo} + {r} THEN {up} ELSE 1D END"


def feathered(image: DataFrame, plan: DataFrame, overlap: int, h: int, w: int) -> DataFrame:
    """(y, x, tiles, weight, v): weighted average of the tiles that hold each pixel of ``image(y, x, v)``; pixels find tiles by number."""
    tiles = plan.select("y0", "x0", "y1", "x1").withColumn("ty", F.explode(F.expr("sequence(y0 div 16, (y1 - 1) div 16)"))).withColumn("tx", F.explode(F.expr("sequence(x0 div 16, (x1 - 1) div 16)")))
    held = image.withColumn("ty", F.expr("cast(y div 16 AS bigint)")).withColumn("tx", F.expr("cast(x div 16 AS bigint)")).join(tiles, ["ty", "tx"]).where("y >= y0 AND y < y1 AND x >= x0 AND x < x1")
    weight = F.expr(f"{feather('y', 'y0', 'y1', str(h), overlap)} * {feather('x', 'x0', 'x1', str(w), overlap)}")
    return held.withColumn("wt", weight).groupBy("y", "x").agg(F.count("*").alias("tiles"), F.sum("wt").alias("weight"), (F.sum(F.col("wt") * F.col("v")) / F.greatest(F.sum("wt"), F.lit(1e-8))).alias("v"))
