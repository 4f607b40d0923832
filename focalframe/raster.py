"""Frame stacks as tables: rows of pixels ``(frame, y, row ARRAY)`` for stencils, single pixels ``(frame, y, x, v)`` for joins.

Samples are integer codes, so linear operators stay exact in BIGINT. A row of pixels travels as one array: work along y
takes one shuffle by (frame, band of rows) with a halo, whatever the size of a frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in a band; a band and its halo are what one window partition holds.
BAND = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def codes(row: str = "embedding") -> Column:
    """Components in [-1, 1] as codes 0 to 255."""
    return F.expr(f"transform({row}, e -> cast(floor((cast(e AS double) + 1D) / 2D * 255D + 0.5D) AS bigint))")


def embedding_frames(spark: SparkSession, sf_dir: str, frames: int = 10) -> DataFrame:
    """(frame, y, row, height): vectors dealt to ``frames`` frames, one vector a row of pixels."""
    rows = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % frames).cast("int").alias("frame"), F.expr(f"cast(vec_id div {frames} AS int)").alias("y"), codes().alias("row"))
    heights = rows.groupBy("frame").agg((F.max("y") + 1).alias("height"))
    return rows.join(F.broadcast(heights), "frame")


def pixels(rows: DataFrame, name: str = "v") -> DataFrame:
    """(frame, y, x, v) of rows of pixels."""
    return rows.select("frame", "y", F.posexplode("row").alias("x", name))


def rows(pixel_table: DataFrame, value: str = "v") -> DataFrame:
    """Rows of pixels of a dense table of pixels."""
    packed = F.transform(F.array_sort(F.collect_list(F.struct("x", value))), lambda p: p[value])
    return pixel_table.groupBy("frame", "y").agg(packed.alias("row"))


def with_halo(frames: DataFrame, halo: int, edge: str = "reflect", band: int = BAND) -> DataFrame:
    """Rows dealt to bands (column ``band``), each with ``halo`` rows more on either side.

    Rows beyond the frame are mirrored without the border row (``reflect``), repeat it (``replicate``), or are missing (``none``).
    """
    last = "(height - 1)"
    mirrored = {
        "reflect": f"filter(array(y, CASE WHEN y BETWEEN 1 AND {halo} THEN -y END, CASE WHEN {last} - y BETWEEN 1 AND {halo} THEN 2 * {last} - y END), p -> p IS NOT NULL)",
        "replicate": f"concat(array(y), CASE WHEN y = 0 THEN sequence(-{halo}, -1) ELSE array() END, CASE WHEN y = {last} THEN sequence({last} + 1, {last} + {halo}) ELSE array() END)" if halo else "array(y)",
        "none": "array(y)",
    }[edge]
    placed = frames.withColumn("y", F.explode(F.expr(mirrored)))
    first, final = f"greatest(0, floor((y - {halo}) / {band}))", f"least(floor((y + {halo}) / {band}), {last} div {band})"
    return placed.withColumn("band", F.explode(F.expr(f"sequence(cast({first} AS int), cast({final} AS int))")))
