"""Stencils, fusion, histograms and display over rasters of the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analysis, fuse, retouch, stencils
from ..raster import embedding_frames, pixels, table
from .registry import query

RASTER = """
WITH px AS MATERIALIZED (
  SELECT CAST(vec_id % 10 AS INTEGER) AS frame, CAST(vec_id // 10 AS INTEGER) AS y, CAST(unnest(range(len(embedding))) AS INTEGER) AS x,
    unnest(list_transform(embedding, lambda e: CAST(floor((CAST(e AS DOUBLE) + 1.0) / 2.0 * 255.0 + 0.5) AS BIGINT))) AS v FROM embeddings
), dim AS MATERIALIZED (SELECT frame, max(y) + 1 AS h, max(x) + 1 AS w FROM px GROUP BY frame)"""


def off(name: str, source: str, radius: int, aggregate: str = "sum(n.v)", edge: str = "reflect") -> str:
    """A CTE that aggregates the neighbours of every pixel."""
    at = "CAST(({n} - 1) - abs(({n} - 1) - abs({i})) AS INTEGER)" if edge == "reflect" else "CAST(greatest(0, least({n} - 1, {i})) AS INTEGER)"
    return f""", {name} AS MATERIALIZED (
  SELECT c.frame, c.y, c.x, {aggregate} AS v FROM (
    SELECT c.frame, c.y, c.x, {at.format(n="dim.h", i="(c.y + a.dy)")} AS ny, {at.format(n="dim.w", i="(c.x + b.dx)")} AS nx FROM {source} c JOIN dim USING (frame) CROSS JOIN range(-{radius}, {radius + 1}) a(dy) CROSS JOIN range(-{radius}, {radius + 1}) b(dx)
  ) c JOIN {source} n ON n.frame = c.frame AND n.y = c.ny AND n.x = c.nx GROUP BY 1, 2, 3
)"""


LAPLACIAN = """, lap AS MATERIALIZED (
  SELECT c.frame, c.y, c.x, CAST(u.v + d.v + l.v + r.v - 4 * c.v AS BIGINT) AS v FROM px c JOIN dim USING (frame)
  JOIN px u ON u.frame = c.frame AND u.x = c.x AND u.y = abs(c.y - 1) JOIN px d ON d.frame = c.frame AND d.x = c.x AND d.y = (h - 1) - abs((h - 1) - (c.y + 1))
  JOIN px l ON l.frame = c.frame AND l.y = c.y AND l.x = abs(c.x - 1) JOIN px r ON r.frame = c.frame AND r.y = c.y AND r.x = (w - 1) - abs((w - 1) - (c.x + 1))
), sq AS MATERIALIZED (SELECT frame, y, x, v * v AS v FROM lap)"""
SHARP = RASTER + LAPLACIAN + off("sh", "sq", 2)


@query(SHARP + " SELECT y, x, arg_max(frame, (v, -frame)) AS winner, CAST(max(v) AS BIGINT) AS energy FROM sh GROUP BY y, x")
def dmap_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuse.depth_map_winner(embedding_frames(spark, sf_dir), 2)


@query(RASTER + LAPLACIAN + off("sh", "sq", 8) + " SELECT y, x, arg_max(frame, (v, -frame)) AS winner, CAST(max(v) AS BIGINT) AS energy FROM sh GROUP BY y, x")
def dmap_winner_radius_8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuse.depth_map_winner(embedding_frames(spark, sf_dir), 8)


@query(RASTER + LAPLACIAN + " SELECT * FROM lap")
def laplacian_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(stencils.laplacian(embedding_frames(spark, sf_dir)))


@query(SHARP + " SELECT frame, y, x, CAST(v AS BIGINT) AS v FROM sh")
def sharpness_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(stencils.sharpness(embedding_frames(spark, sf_dir), 2))


@query(SHARP + " SELECT y, x, CAST(max(v) AS BIGINT) AS energy FROM sh GROUP BY y, x")
def max_sharpness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(stencils.sharpness(embedding_frames(spark, sf_dir), 2)).groupBy("y", "x").agg(F.max("v").alias("energy"))


@query(RASTER + ", ok AS (SELECT *, v % 3 <> 0 AS good FROM px) SELECT y, x, coalesce(arg_max(frame, (v, -frame)) FILTER (good), min(frame)) AS winner, max(v) FILTER (good) AS energy FROM ok GROUP BY y, x")
def masked_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuse.winners(pixels(embedding_frames(spark, sf_dir)).withColumn("good", F.col("v") % 3 != 0), valid="good")


@query(RASTER + off("bx", "px", 1) + " SELECT frame, y, x, CAST(v AS BIGINT) AS v FROM bx")
def box_filter_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(stencils.box_sum(embedding_frames(spark, sf_dir), 1))


@query(RASTER + off("md", "px", 1, "list_sort(list(n.v))[5]", "replicate") + " SELECT frame, y, x, v FROM md")
def median_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(stencils.median(embedding_frames(spark, sf_dir), 1))


GAUSS = ", taps AS (SELECT range AS k, exp(-0.5 * range * range) AS e FROM range(-3, 4)), tap AS (SELECT k, e / (SELECT sum(e) FROM taps) AS w FROM taps)" + """, gx AS (
  SELECT c.frame, c.y, c.x, sum(tap.w * n.v) AS v FROM px c JOIN dim USING (frame), tap, px n WHERE n.frame = c.frame AND n.y = c.y AND n.x = (w_ - 1) - abs((w_ - 1) - abs(c.x + tap.k)) GROUP BY 1, 2, 3
), gy AS (
  SELECT c.frame, c.y, c.x, sum(tap.w * n.v) AS v FROM gx c JOIN dim USING (frame), tap, gx n WHERE n.frame = c.frame AND n.x = c.x AND n.y = (h - 1) - abs((h - 1) - abs(c.y + tap.k)) GROUP BY 1, 2, 3
)""".replace("w_", "dim.w")


@query(RASTER + GAUSS + " SELECT frame, y, x, round(v, 6) AS v FROM gy")
def gaussian_blur(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(stencils.gaussian_blur(embedding_frames(spark, sf_dir), 1.0)).withColumn("v", F.round("v", 6))


@query(RASTER + GAUSS + " SELECT frame, CAST(y // 2 AS INTEGER) AS y, CAST(x // 2 AS INTEGER) AS x, round(v, 6) AS v FROM gy WHERE y % 2 = 0 AND x % 2 = 0")
def downsample2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(stencils.downsample2(embedding_frames(spark, sf_dir))).withColumn("v", F.round("v", 6))


@query(
    RASTER
    + """, t AS (
  SELECT frame, CAST(a.range AS INTEGER) AS y, CAST(b.range AS INTEGER) AS x, greatest(0.0, least(h - 1.0, (a.range + 0.5) * h / 75.0 - 0.5)) AS sy, greatest(0.0, least(w - 1.0, (b.range + 0.5) * w / 96.0 - 0.5)) AS sx, h, w
  FROM dim, range(75) a, range(96) b
), g AS (SELECT frame, y, x, CAST(floor(sy) AS INTEGER) AS y0, CAST(floor(sx) AS INTEGER) AS x0, sy - floor(sy) AS fy, sx - floor(sx) AS fx, h, w FROM t)
SELECT g.frame, g.y, g.x, round((1 - fy) * ((1 - fx) * a.v + fx * b.v) + fy * ((1 - fx) * c.v + fx * d.v), 6) AS v FROM g
JOIN px a ON a.frame = g.frame AND a.y = y0 AND a.x = x0 JOIN px b ON b.frame = g.frame AND b.y = y0 AND b.x = least(x0 + 1, w - 1)
JOIN px c ON c.frame = g.frame AND c.y = least(y0 + 1, h - 1) AND c.x = x0 JOIN px d ON d.frame = g.frame AND d.y = least(y0 + 1, h - 1) AND d.x = least(x0 + 1, w - 1)"""
)
def upsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(stencils.upsample(embedding_frames(spark, sf_dir), 75, 96)).withColumn("v", F.round("v", 6))


GUIDED = RASTER + """, one AS (SELECT frame, y, x, CAST(v AS DOUBLE) / 255 AS i, CAST((v * v) % 256 AS DOUBLE) / 255 AS p FROM px), p1 AS (SELECT frame, y, x, i AS v FROM one), p2 AS (SELECT frame, y, x, p AS v FROM one),
p3 AS (SELECT frame, y, x, i * p AS v FROM one), p4 AS (SELECT frame, y, x, i * i AS v FROM one)""" + "".join(off(f"m{k}", f"p{k}", 1, "sum(n.v) / 9") for k in range(1, 5)) + """, ab AS (
  SELECT m1.frame, m1.y, m1.x, (m3.v - m1.v * m2.v) / (m4.v - m1.v * m1.v + 0.01) AS a, m1.v AS mi, m2.v AS mp FROM m1 JOIN m2 USING (frame, y, x) JOIN m3 USING (frame, y, x) JOIN m4 USING (frame, y, x)
), pa AS (SELECT frame, y, x, a AS v FROM ab), pb AS (SELECT frame, y, x, mp - a * mi AS v FROM ab)""" + off("ma", "pa", 1, "sum(n.v) / 9") + off("mb", "pb", 1, "sum(n.v) / 9")


@query(GUIDED + " SELECT frame, y, x, round(ma.v * one.i + mb.v, 6) + 0.0 AS v FROM ma JOIN mb USING (frame, y, x) JOIN one USING (frame, y, x)")
def guided_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = embedding_frames(spark, sf_dir).withColumn("g", F.expr("transform(row, v -> cast(v AS double) / 255D)")).withColumn("p", F.expr("transform(row, v -> cast((v * v) % 256 AS double) / 255D)"))
    return pixels(stencils.guided_filter(frames, "g", "p", 1, 0.01)).withColumn("v", F.round("v", 6) + 0.0)


@query(SHARP + ", q AS (SELECT quantile_cont(v, 0.999) AS s FROM sh WHERE frame = 5), l AS (SELECT sh.frame, y, x, sh.v / greatest(s, 1e-8) / 0.05 AS l, px.v FROM sh JOIN px USING (frame, y, x), q), m AS (SELECT y, x, max(l) AS m FROM l GROUP BY 1, 2) SELECT y, x, round(sum(exp(l - m) * v) / greatest(sum(exp(l - m)), 1e-8), 6) AS v FROM l JOIN m USING (y, x) GROUP BY 1, 2")
def weighted_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuse.weighted_blend(embedding_frames(spark, sf_dir), 2, 0.05).withColumn("v", F.round("v", 6))


@query(RASTER + ", ix AS (SELECT y, x, least(9.0, (y * 7 + x * 13) % 91 / 10.0::DOUBLE) AS i FROM px WHERE frame = 0), s AS (SELECT y, x, CAST(floor(i) AS INTEGER) AS lo, i - floor(i) AS f FROM ix) SELECT s.y, s.x, round((1 - f) * a.v + CASE WHEN f > 0 THEN f * b.v ELSE 0 END, 6) AS v FROM s JOIN px a ON a.frame = lo AND a.y = s.y AND a.x = s.x JOIN px b ON b.frame = least(lo + 1, 9) AND b.y = s.y AND b.x = s.x")
def dmap_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = embedding_frames(spark, sf_dir)
    index = pixels(frames.where("frame = 0")).select("y", "x", F.expr("least(9D, (y * 7 + x * 13) % 91 / 10D)").alias("i"))
    return fuse.composite(frames, index, 10).withColumn("v", F.round("v", 6))


@query(SHARP + ", s AS (SELECT unnest([0, 1, 2]) AS slab, unnest([0, 3, 6]) AS a, unnest([4, 7, 10]) AS b) SELECT CAST(slab AS INTEGER) AS slab, y, x, arg_max(frame, (v, -frame)) AS winner FROM sh JOIN s ON frame >= a AND frame < b GROUP BY 1, 2, 3")
def slab_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuse.slab_winners(embedding_frames(spark, sf_dir), 2, 4, 1, 10)


@query("WITH c AS (SELECT user_id AS stack, count(*) AS n FROM events GROUP BY 1), k AS (SELECT stack, n, unnest(range(CAST(greatest(0, ceil((n - 10) / 8.0)) AS BIGINT) + 1)) AS slab FROM c) SELECT stack, slab, slab * 8 AS start_frame, least(slab * 8 + 10, n) AS end_frame FROM k")
def slab_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuse.slab_plan(table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("stack")).agg(F.count("*").alias("n")), 10, 2)


@query("""WITH s AS (SELECT p_partkey AS stack, CAST(p_size * 40 AS BIGINT) AS h, CAST(floor(p_retailprice) AS BIGINT) AS w FROM part), a AS (
  SELECT *, unnest(CASE WHEN h <= 512 AND w <= 512 THEN [0] ELSE range(0, greatest(h - 64, 1), 448) END) AS y0 FROM s
), b AS (SELECT *, unnest(CASE WHEN h <= 512 AND w <= 512 THEN [0] ELSE range(0, greatest(w - 64, 1), 448) END) AS x0 FROM a)
SELECT stack, CAST(y0 AS BIGINT) AS y0, CAST(x0 AS BIGINT) AS x0, least(y0 + 512, h) AS y1, least(x0 + 512, w) AS x1 FROM b""")
def tile_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("stack"), (F.col("p_size") * 40).cast("long").alias("h"), F.expr("cast(floor(p_retailprice) AS bigint)").alias("w"))
    return fuse.tile_plan(sizes, 512, 64)


def _axis(at: str, lo: str, hi: str, n: str) -> str:
    return f"CASE WHEN {hi} <> {n} AND {at} >= {hi} - 4 THEN [1.0, 0.7333333333333334, 0.4666666666666667, 0.2][{at} - ({hi} - 4) + 1] WHEN {lo} <> 0 AND {at} < {lo} + 4 THEN [0.2, 0.4666666666666667, 0.7333333333333333, 1.0][{at} - {lo} + 1] ELSE 1.0 END"


@query(RASTER + f""", im AS (SELECT y, x, sum(v) AS v, (SELECT h FROM dim WHERE frame = 0) AS h FROM px GROUP BY 1, 2), t AS (
  SELECT a.range AS y0, b.range AS x0, least(a.range + 20, h) AS y1, least(b.range + 20, 64) AS x1, h FROM (SELECT h FROM dim WHERE frame = 0), range(0, h - 4, 16) a, range(0, 60, 16) b
), w AS (SELECT y, x, v, CAST({_axis('y', 'y0', 'y1', 't.h')} AS DOUBLE) * CAST({_axis('x', 'x0', 'x1', '64')} AS DOUBLE) AS wt FROM im JOIN t ON y >= y0 AND y < y1 AND x >= x0 AND x < x1)
SELECT y, x, count(*) AS tiles, round(sum(wt), 6) AS weight, round(sum(wt * v) / greatest(sum(wt), 1e-8), 6) AS v FROM w GROUP BY 1, 2""")
def tile_feather(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = embedding_frames(spark, sf_dir)
    # The other frames may be a row lower.
    size = frames.where("frame = 0").select(F.lit(0).alias("stack"), F.col("height").cast("long").alias("h"), F.lit(64).cast("long").alias("w")).distinct()
    h = size.first()["h"]
    image = pixels(frames).groupBy("y", "x").agg(F.sum("v").alias("v"))
    return fuse.feathered(image, fuse.tile_plan(size, 20, 4), 4, h, 64).withColumns({"weight": F.round("weight", 6), "v": F.round("v", 6)})


@query(SHARP + " SELECT frame, round(quantile_cont(v, 0.07), 6) AS p07, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.999), 6) AS p999 FROM sh GROUP BY frame")
def sharp_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharp = pixels(stencils.sharpness(embedding_frames(spark, sf_dir), 2))
    return sharp.groupBy("frame").agg(*(F.round(F.expr(f"percentile(v, {p})"), 6).alias(n) for n, p in (("p07", 0.07), ("p50", 0.5), ("p999", 0.999))))


PLANES = "WITH v AS (SELECT unnest(['discount', 'tax', 'quantity']) AS series, unnest([l_discount * 10, l_tax * 12, l_quantity / 50]) AS v FROM lineitem)"


def planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_discount", "l_tax", "l_quantity")
    return rows.select(F.expr("stack(3, 'discount', l_discount * 10, 'tax', l_tax * 12, 'quantity', l_quantity / 50) AS (series, v)"))


@query(PLANES + ", c AS (SELECT series, CAST(least(floor(greatest(0.0, least(1.0, v)) * 256), 255) AS INTEGER) AS bin, count(*) AS n FROM v GROUP BY 1, 2) SELECT s.series, CAST(r.range AS INTEGER) AS bin, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT series FROM v) s, range(256) r LEFT JOIN c ON c.series = s.series AND c.bin = r.range")
def histogram_256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.histogram(planes(spark, sf_dir))


@query(PLANES + " SELECT series, count(*) FILTER (v <= 0) AS shadows, count(*) FILTER (v >= 1) AS highlights, count(*) AS n FROM v GROUP BY series")
def clip_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.clip_counts(planes(spark, sf_dir))


@query("SELECT l_orderkey, l_linenumber, CAST(floor(least(greatest(l_discount * 10, 0.0), 1.0) * 65535 + 0.5) AS INTEGER) AS code16, CAST(floor(least(greatest(l_quantity / 50, 0.0), 1.0) * 255 + 0.5) AS INTEGER) AS code8 FROM lineitem")
def quantise_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", analysis.quantise(F.col("l_discount") * 10, 16).alias("code16"), analysis.quantise(F.col("l_quantity") / 50, 8).alias("code8"))


RGB = RASTER + ", rgb AS (SELECT frame, y, CAST(x // 3 AS INTEGER) AS x, max(v) FILTER (x % 3 = 0) AS r, max(v) FILTER (x % 3 = 1) AS g, max(v) FILTER (x % 3 = 2) AS b FROM px WHERE x < 63 GROUP BY 1, 2, 3)"


def rgb_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, y, x, r, g, b): three neighbouring samples of a row are one pixel; cut from the array, no shuffle."""
    rows = embedding_frames(spark, sf_dir)
    cut = F.expr("transform(sequence(0, size(row) div 3 - 1), i -> struct(row[3 * i] AS r, row[3 * i + 1] AS g, row[3 * i + 2] AS b))")
    return rows.select("frame", "y", F.posexplode(cut).alias("x", "p")).select("frame", "y", "x", "p.*")


@query(RGB + " SELECT frame, y, x, CAST(2126 * r + 7152 * g + 722 * b AS BIGINT) AS luma FROM rgb")
def luma_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rgb_pixels(spark, sf_dir).select("frame", "y", "x", analysis.luma("r", "g", "b").alias("luma"))


@query(RASTER + " SELECT frame, y, x, round(CASE WHEN v / 255.0::DOUBLE <= 0.0031308 THEN v / 255.0::DOUBLE * 12.92 ELSE 1.055 * pow(v / 255.0::DOUBLE, 1 / 2.4::DOUBLE) - 0.055 END, 6) AS v FROM px")
def srgb_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(embedding_frames(spark, sf_dir)).withColumn("v", F.round(analysis.srgb_encode(F.col("v") / 255.0), 6))


@query(RGB + " SELECT frame, round(greatest(0.25, least(64.0, 0.9 / greatest(quantile_cont(l, 0.995), 1e-6))), 6) AS gain FROM (SELECT frame, (r * 0.2126::DOUBLE + g * 0.7152::DOUBLE + b * 0.0722::DOUBLE) / 255 AS l FROM rgb) WHERE l > 0 GROUP BY frame")
def auto_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    lit = rgb_pixels(spark, sf_dir).select("frame", F.expr("(r * 0.2126D + g * 0.7152D + b * 0.0722D) / 255").alias("luma")).where("luma > 0")
    level = lit.groupBy("frame").agg(F.expr("percentile(luma, 0.995)").alias("level"))
    return level.select("frame", F.round(F.expr("greatest(0.25D, least(64D, 0.9D / greatest(level, 1e-6D)))"), 6).alias("gain"))


@query(RGB + """, f AS (SELECT frame, y, x, r / 255.0::DOUBLE AS r, g / 255.0::DOUBLE AS g, b / 255.0::DOUBLE AS b FROM rgb), m AS (SELECT avg(g) / avg(r) AS gr, 1.0::DOUBLE AS gg, avg(g) / avg(b) AS gb FROM f
), w AS (SELECT frame, y, x, least(r * gr, least(gr, gg, gb)) AS r, least(g * gg, least(gr, gg, gb)) AS g, least(b * gb, least(gr, gg, gb)) AS b FROM f, m
), e AS (SELECT greatest(0.25, least(64.0, 0.9 / greatest(quantile_cont(l, 0.995), 1e-6))) AS gain FROM (SELECT r * 0.2126::DOUBLE + g * 0.7152::DOUBLE + b * 0.0722::DOUBLE AS l FROM w) WHERE l > 0
), c AS (SELECT frame, y, x, greatest(0.0, least(1.0, r * gain)) AS r, greatest(0.0, least(1.0, g * gain)) AS g, greatest(0.0, least(1.0, b * gain)) AS b FROM w, e)
SELECT frame, y, x, """ + ", ".join(f"round(CASE WHEN {c} <= 0.0031308 THEN {c} * 12.92 ELSE 1.055 * pow({c}, 1 / 2.4::DOUBLE) - 0.055 END, 6) AS {c}" for c in "rgb") + " FROM c")
def tonemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rgb = rgb_pixels(spark, sf_dir).withColumns({c: F.col(c) / 255.0 for c in "rgb"})
    return analysis.tonemap(rgb).withColumns({c: F.round(c, 6) for c in "rgb"})


@query(RASTER + ", v AS (SELECT frame, y, x, v / 200.0::DOUBLE - 0.25 AS v FROM px), s AS (SELECT least(0.0, min(v)) AS lo, greatest(1.0, max(v)) AS hi FROM v) SELECT frame, y, x, CAST(round_even((v - lo) / (hi - lo) * 65535, 0) AS INTEGER) AS code, CAST(round_even((0 - lo) / (hi - lo) * 65535, 0) AS INTEGER) AS black, CAST(round_even((1 - lo) / (hi - lo) * 65535, 0) AS INTEGER) AS white FROM v, s")
def linear_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = pixels(embedding_frames(spark, sf_dir)).withColumn("v", F.col("v") / 200.0 - 0.25)
    return analysis.linear_codes(values).drop("v")


def _strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stroke per supplier: two points, radius and hardness from its numbers."""
    s = table(spark, sf_dir, "supplier")
    pt = "named_struct('x', cast(s_suppkey * {} % 60 AS double), 'y', cast(s_suppkey * {} % 45 AS double), 'p', {}D)"
    return s.select(F.col("s_suppkey").alias("seq"), F.expr(f"array({pt.format(7, 11, 1)}, {pt.format(13, 5, 0.5)})").alias("points"), F.expr("cast(2 + s_suppkey % 5 AS double)").alias("radius"), F.expr("(s_suppkey % 4) / 4D").alias("hardness"), F.expr("0.25D + (s_suppkey % 3) / 4D").alias("opacity"), F.expr("CASE WHEN s_suppkey % 5 = 0 THEN 'erase' ELSE 'paint' END").alias("mode"), F.expr("cast(s_suppkey % 9 + 1 AS int)").alias("source"))


STROKES = """
WITH st AS (SELECT s_suppkey AS seq, (s_suppkey * 7 % 60)::DOUBLE AS ax, (s_suppkey * 11 % 45)::DOUBLE AS ay, (s_suppkey * 13 % 60)::DOUBLE AS bx, (s_suppkey * 5 % 45)::DOUBLE AS by_, (2 + s_suppkey % 5)::DOUBLE AS radius, (s_suppkey % 4) / 4.0::DOUBLE AS hardness,
  0.25 + (s_suppkey % 3) / 4.0::DOUBLE AS opacity, CASE WHEN s_suppkey % 5 = 0 THEN 'erase' ELSE 'paint' END AS mode, s_suppkey % 9 + 1 AS source FROM supplier
), n AS (SELECT *, CAST(greatest(1, floor(sqrt((bx - ax) ** 2 + (by_ - ay) ** 2) / greatest(1, round_even(radius / 4, 0)))) AS INTEGER) AS n FROM st
), dab AS (
  SELECT seq, 0 AS k, ax AS x, ay AS y, 1.0::DOUBLE AS p, radius, hardness FROM n UNION ALL
  SELECT seq, k, ax + (bx - ax) * (k / n::DOUBLE), ay + (by_ - ay) * (k / n::DOUBLE), 1.0 + -0.5 * (k / n::DOUBLE), radius, hardness FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM n)
)"""


@query(STROKES + " SELECT seq, CAST(k AS INTEGER) AS k, round(x, 6) AS x, round(y, 6) AS y, round(p, 6) AS p FROM dab")
def stroke_dabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retouch.dabs(_strokes(spark, sf_dir)).select("seq", "k", *(F.round(c, 6).alias(c) for c in "xyp"))


MASKS = STROKES + """, box AS (SELECT seq, max(radius) AS r, max(hardness) AS hd, greatest(0, floor(min(x) - ceil(max(radius)))) AS x0, greatest(0, floor(min(y) - ceil(max(radius)))) AS y0, least(64, ceil(max(x) + ceil(max(radius))) + 1) AS x1, least(50, ceil(max(y) + ceil(max(radius))) + 1) AS y1 FROM dab GROUP BY seq
), mask AS (SELECT d.seq, CAST(a.range AS INTEGER) AS py, CAST(b.range AS INTEGER) AS px, least(1.0, greatest(0.0, max(exp(-((b.range - x) ** 2 + (a.range - y) ** 2) / (2 * (r * (1 - hd) + 1e-3) ** 2)) * p))) AS mask
  FROM dab d JOIN box USING (seq), range(50) a, range(64) b WHERE a.range >= y0 AND a.range < y1 AND b.range >= x0 AND b.range < x1 GROUP BY 1, 2, 3)"""


@query(MASKS + " SELECT seq, py, px, round(mask, 6) AS mask FROM mask")
def stroke_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retouch.stroke_masks(_strokes(spark, sf_dir), 50, 64).withColumn("mask", F.round("mask", 6))


@query(RASTER.replace("WITH px", "WITH RECURSIVE px") + MASKS.replace("\nWITH st", ", st") + """, t AS (
  SELECT m.py AS y, m.px AS x, row_number() OVER (PARTITION BY m.py, m.px ORDER BY m.seq) AS k, m.mask * st.opacity AS a, CASE WHEN st.mode = 'erase' THEN b.v ELSE s.v END AS s, b.v AS v
  FROM mask m JOIN st USING (seq) JOIN px b ON b.frame = 0 AND b.y = m.py AND b.x = m.px LEFT JOIN px s ON s.frame = st.source AND s.y = m.py AND s.x = m.px
), fold AS (
  SELECT y, x, k, v * (1 - a) + coalesce(s, v) * a AS v FROM t WHERE k = 1 UNION ALL
  SELECT t.y, t.x, t.k, f.v * (1 - t.a) + coalesce(t.s, t.v) * t.a FROM fold f JOIN t ON t.y = f.y AND t.x = f.x AND t.k = f.k + 1
), last AS (SELECT y, x, arg_max(v, k) AS v FROM fold GROUP BY 1, 2)
SELECT px.y, px.x, round(coalesce(last.v, px.v), 6) AS v FROM px LEFT JOIN last ON last.y = px.y AND last.x = px.x WHERE px.frame = 0""")
def retouch_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = pixels(embedding_frames(spark, sf_dir))
    base = flat.where("frame = 0").select("y", "x", F.col("v").cast("double").alias("v"))
    sources = flat.where("frame > 0").select(F.col("frame").alias("source"), "y", "x", F.col("v").cast("double").alias("s"))
    return retouch.retouched(base, _strokes(spark, sf_dir), sources, 50, 64).withColumn("v", F.round("v", 6))
