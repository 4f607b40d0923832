"""Frame selection: focus curves on a grid, reliable cells, in-focus intervals, interval-stabbing cover."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..raster import pixels
from .stencils import second_difference


def cell_of(at: str, n: str, cells: int) -> str:
    """SQL for the grid cell of a coordinate; cell k begins at floor(k * n / cells)."""
    return f"size(filter(sequence(1, {cells} - 1), k -> {at} >= floor(k * {n} / {cells})))"


def focus_measure(frames: DataFrame, rows: int, cols: int, valid: str = "true") -> DataFrame:
    """(frame, r, c, total, n, good): summed second difference over valid pixels, pixels, and valid pixels of each cell; ``valid`` is SQL over (frame, y, x, code)."""
    d = second_difference(frames).withColumn("width", F.size("row"))
    both = d.withColumnRenamed("row", "d").join(frames.select("frame", "y", F.col("row").alias("codes")), ["frame", "y"])
    flat = both.select("frame", "y", "height", "width", F.posexplode(F.arrays_zip("d", "codes")).alias("x", "p")).select("*", "p.d", F.col("p.codes").alias("code"))
    cells = flat.withColumn("r", F.expr(cell_of("y", "height", rows))).withColumn("c", F.expr(cell_of("x", "width", cols))).withColumn("ok", F.expr(valid))
    return cells.groupBy("frame", "r", "c").agg(F.sum(F.when(F.col("ok"), F.col("d")).otherwise(0)).alias("total"), F.count("*").alias("n"), F.count_if("ok").alias("good"))


def invalid_cells(measure: DataFrame, most: float = 0.25) -> DataFrame:
    """(r, c, invalid): whether more than a share ``most`` of a cell is invalid in any frame."""
    return measure.groupBy("r", "c").agg(F.bool_or(1 - F.col("good") / F.col("n") > most).alias("invalid"))


def smooth_curves(measure: DataFrame, value: str = "total") -> DataFrame:
    """(frame, r, c, v): each cell's value plus its eight neighbours', nothing beyond the grid: every cell is sent to its neighbours."""
    around = F.explode(F.expr("flatten(transform(sequence(-1, 1), i -> transform(sequence(-1, 1), j -> struct(r + i AS r, c + j AS c))))"))
    sent = measure.select("frame", F.col("r").alias("r0"), F.col("c").alias("c0"), F.col(value).alias("v")).withColumnsRenamed({"r0": "r", "c0": "c"}).select("frame", "v", around.alias("to")).select("frame", "to.r", "to.c", "v")
    return sent.groupBy("frame", "r", "c").agg(F.sum("v").alias("v")).join(measure.select("frame", "r", "c"), ["frame", "r", "c"], "left_semi")


def curves(smoothed: DataFrame) -> DataFrame:
    """(r, c, curve): values in frame order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("frame", "v"))), lambda p: p["v"])
    return smoothed.groupBy("r", "c").agg(ordered.alias("curve"))


def kurtosis(curve: str = "curve") -> str:
    """SQL for the excess kurtosis of an array; -3 where the variance is below 1e-12."""
    mean = f"(aggregate({curve}, 0D, (s, v) -> s + v) / size({curve}))"
    moment = f"(aggregate({curve}, 0D, (s, v) -> s + pow(v - {mean}, {{}})) / size({curve}))"
    return f"CASE WHEN {moment.format(2)} < 1e-12 THEN -3D ELSE {moment.format(4)} / pow({moment.format(2)}, 2) - 3 END"


def reliable_cells(smoothed: DataFrame, invalid: DataFrame, threshold: float = -1.2, least_peak: float = 0.3) -> DataFrame:
    """(r, c, curve, kurt, reliable)."""
    c = curves(smoothed).withColumn("kurt", F.expr(kurtosis())).join(invalid, ["r", "c"])
    top = c.agg(F.max(F.array_max("curve")).alias("top"))
    ok = ~F.col("invalid") & (F.array_max("curve") >= least_peak * F.col("top")) & (F.col("kurt") >= threshold)
    return c.crossJoin(F.broadcast(top)).select("r", "c", "curve", "kurt", ok.alias("reliable"))


def intervals(cells: DataFrame, percent: int) -> DataFrame:
    """(r, c, peak, lo, hi): the run of frames around a cell's first peak that reach ``percent`` of it (integers compared exactly)."""
    peak = "cast(array_position(curve, array_max(curve)) - 1 AS int)"
    low = f"100 * curve[i] < {percent} * curve[peak]"
    out = cells.withColumn("peak", F.expr(peak))
    lo = f"coalesce(array_max(filter(sequence(0, size(curve) - 1), i -> i < peak AND {low})) + 1, 0)"
    hi = f"coalesce(array_min(filter(sequence(0, size(curve) - 1), i -> i > peak AND {low})) - 1, size(curve) - 1)"
    return out.select("r", "c", "peak", F.expr(lo).alias("lo"), F.expr(hi).alias("hi"))


def coverage_rows(cell_intervals: DataFrame, n: int) -> DataFrame:
    """(lo, hi, kind): a row per cell, and for each run of consecutive peaks one before and one after it."""
    byp = cell_intervals.groupBy("peak").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    island = F.col("peak") - F.row_number().over(Window.orderBy("peak"))
    runs = byp.withColumn("island", island).groupBy("island").agg(F.min_by(F.struct("lo", "hi"), "peak").alias("a"), F.max_by(F.struct("lo", "hi"), "peak").alias("b"))

    def clip(e: str) -> str:
        return f"greatest(0, least({n - 1}, {e}))"

    made = F.explode(F.expr(f"array(struct({clip('a.lo - 1')} AS lo, {clip('a.hi - 1')} AS hi), struct({clip('b.lo + 1')} AS lo, {clip('b.hi + 1')} AS hi))"))
    synthetic = runs.select(made.alias("s")).select("s.lo", "s.hi", F.lit("synthetic").alias("kind")).where("lo <= hi")
    return cell_intervals.select("lo", "hi", F.lit("cell").alias("kind")).unionByName(synthetic)


def stab_cover(rows: DataFrame) -> DataFrame:
    """(kept): the fewest points that meet every interval; by right end, each point closes the first interval not met yet.

    Of intervals with the same right end only the narrowest matters, so what is folded has a row for each frame at most.
    """
    narrow = rows.groupBy("hi").agg(F.max("lo").alias("lo"))
    sorted_rows = F.array_sort(F.collect_list(F.struct("hi", "lo")))
    fold = "aggregate(s, cast(array() AS array<int>), (kept, p) -> CASE WHEN size(kept) = 0 OR p.lo > element_at(kept, -1) THEN concat(kept, array(p.hi)) ELSE kept END)"
    return narrow.agg(sorted_rows.alias("s")).select(F.expr(fold).alias("kept"))


def select_frames(rows: DataFrame, n: int, least: int = 3) -> DataFrame:
    """(frame, kept, warned): fewer than ``least`` points keep every frame, with a warning."""
    cover = stab_cover(rows).withColumn("warned", F.size("kept") < least)
    every = F.sequence(F.lit(0), F.lit(n - 1))
    return cover.select(F.explode(every).alias("frame"), "kept", "warned").select("frame", (F.col("warned") | F.array_contains("kept", F.col("frame"))).alias("kept"), "warned")
