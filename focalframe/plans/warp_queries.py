"""Transforms, chains and warps over the embedding raster and the orders of each day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import geometry
from ..raster import embedding_frames, table
from .raster_queries import RASTER
from .registry import query


def transforms(spark: SparkSession) -> DataFrame:
    """A similarity for each of ten frames."""
    return spark.range(10).select(F.col("id").cast("int").alias("frame"), geometry.similarity("(1D + id * 0.01D)", "(id * 0.02D)", "(id * 0.5D)", "(id * -0.25D)", "31.5D", "24.5D").alias("m"))


SIM = """, k AS (SELECT CAST(range AS INTEGER) AS frame, (1 + range * 0.01::DOUBLE) * cos(range * 0.02::DOUBLE) AS a, (1 + range * 0.01::DOUBLE) * sin(range * 0.02::DOUBLE) AS b, range * 0.5::DOUBLE AS tx, range * -0.25::DOUBLE AS ty FROM range(10)
), pt AS MATERIALIZED (SELECT px.frame, y, x, h, w, b * x + a * y + 24.5 - b * 31.5 - a * 24.5 + ty AS sy, a * x - b * y + 31.5 - a * 31.5 + b * 24.5 + tx AS sx FROM px JOIN dim USING (frame) JOIN k USING (frame))"""


@query("""WITH p AS (SELECT p_partkey, 1 + (p_size - 25) / 1000.0::DOUBLE AS s, (p_partkey % 100 - 50) / 500.0::DOUBLE AS a, p_size::DOUBLE AS tx, -p_size / 4.0::DOUBLE AS ty FROM part)
SELECT p_partkey, round(s * cos(a), 6) AS a, round(s * sin(a), 6) AS b, round(31.5 - s * cos(a) * 31.5 + s * sin(a) * 24.5 + tx, 6) + 0.0 AS tx, round(24.5 - s * sin(a) * 31.5 - s * cos(a) * 24.5 + ty, 6) + 0.0 AS ty FROM p""")
def similarity_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A similarity about a centre for each part, of its numbers."""
    m = geometry.similarity("(1D + (p_size - 25) / 1000D)", "((p_partkey % 100 - 50) / 500D)", "cast(p_size AS double)", "(-p_size / 4D)", "31.5D", "24.5D")
    out = table(spark, sf_dir, "part").select("p_partkey", m.alias("m"))
    return out.select("p_partkey", F.round(F.expr("m[0]"), 6).alias("a"), F.round(F.expr("m[3]"), 6).alias("b"), (F.round(F.expr("m[2]"), 6) + 0.0).alias("tx"), (F.round(F.expr("m[5]"), 6) + 0.0).alias("ty"))


@query(RASTER + SIM + " SELECT pt.frame, pt.y, pt.x, px.v FROM pt JOIN px ON px.frame = pt.frame AND px.y = greatest(0, least(h - 1, round_even(sy, 0))) AND px.x = greatest(0, least(w - 1, round_even(sx, 0)))")
def warp_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.warp(embedding_frames(spark, sf_dir), transforms(spark), "nearest")


TAP = RASTER + SIM + """, tp AS (SELECT pt.*, CAST(greatest(0, least(h - 1, floor(sy))) AS INTEGER) AS y0, CAST(greatest(0, least(h - 1, floor(sy) + 1)) AS INTEGER) AS y1, CAST(greatest(0, least(w - 1, floor(sx))) AS INTEGER) AS x0, CAST(greatest(0, least(w - 1, floor(sx) + 1)) AS INTEGER) AS x1, sy - floor(sy) AS fy, sx - floor(sx) AS fx FROM pt)"""


@query(TAP + """ SELECT tp.frame, tp.y, tp.x, round((1 - fy) * ((1 - fx) * a.v + fx * b.v) + fy * ((1 - fx) * c.v + fx * d.v), 5) AS v FROM tp JOIN px a ON a.frame = tp.frame AND a.y = y0 AND a.x = x0 JOIN px b ON b.frame = tp.frame AND b.y = y0 AND b.x = x1
JOIN px c ON c.frame = tp.frame AND c.y = y1 AND c.x = x0 JOIN px d ON d.frame = tp.frame AND d.y = y1 AND d.x = x1""")
def warp_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.warp(embedding_frames(spark, sf_dir), transforms(spark), "bilinear").withColumn("v", F.round("v", 5))


@query(TAP + " SELECT frame, y, x, (CASE WHEN floor(sy) BETWEEN 0 AND h - 1 THEN 1 - fy ELSE 0 END + CASE WHEN floor(sy) + 1 BETWEEN 0 AND h - 1 THEN fy ELSE 0 END) * (CASE WHEN floor(sx) BETWEEN 0 AND w - 1 THEN 1 - fx ELSE 0 END + CASE WHEN floor(sx) + 1 BETWEEN 0 AND w - 1 THEN fx ELSE 0 END) > 0.999 AS valid FROM tp")
def warp_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.warp_mask(embedding_frames(spark, sf_dir), transforms(spark))


LANCZOS = RASTER + SIM + """, tap AS (SELECT pt.*, CAST(greatest(0, least(h - 1, floor(sy) + i.range)) AS INTEGER) AS iy, CAST(greatest(0, least(w - 1, floor(sx) + j.range)) AS INTEGER) AS ix, sy - floor(sy) - i.range AS dy, sx - floor(sx) - j.range AS dx FROM pt, range(-2, 4) i, range(-2, 4) j
), wt AS (SELECT *, CASE WHEN dy = 0 THEN 1 WHEN abs(dy) < 3 THEN sin(pi() * dy) / (pi() * dy) * sin(pi() * dy / 3) / (pi() * dy / 3) ELSE 0 END * CASE WHEN dx = 0 THEN 1 WHEN abs(dx) < 3 THEN sin(pi() * dx) / (pi() * dx) * sin(pi() * dx / 3) / (pi() * dx / 3) ELSE 0 END AS wt FROM tap)
SELECT wt.frame, wt.y, wt.x, round(sum(wt.wt * px.v) / sum(wt.wt), 5) AS v FROM wt JOIN px ON px.frame = wt.frame AND px.y = iy AND px.x = ix GROUP BY 1, 2, 3"""


@query(LANCZOS)
def warp_lanczos3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.warp(embedding_frames(spark, sf_dir), transforms(spark), "lanczos3").withColumn("v", F.round("v", 5))


@query(RASTER + SIM + """, tap AS (SELECT pt.*, CAST(greatest(0, least(h - 1, floor(sy) + i.range)) AS INTEGER) AS iy, CAST(greatest(0, least(w - 1, floor(sx) + j.range)) AS INTEGER) AS ix, abs(sy - floor(sy) - i.range) AS dy, abs(sx - floor(sx) - j.range) AS dx FROM pt, range(-1, 3) i, range(-1, 3) j
), wt AS (SELECT *, CASE WHEN dy <= 1 THEN 1.25 * dy ** 3 - 2.25 * dy ** 2 + 1 WHEN dy < 2 THEN -0.75 * dy ** 3 + 3.75 * dy ** 2 - 6 * dy + 3 ELSE 0 END * CASE WHEN dx <= 1 THEN 1.25 * dx ** 3 - 2.25 * dx ** 2 + 1 WHEN dx < 2 THEN -0.75 * dx ** 3 + 3.75 * dx ** 2 - 6 * dx + 3 ELSE 0 END AS wt FROM tap)
SELECT wt.frame, wt.y, wt.x, round(sum(wt.wt * px.v) / sum(wt.wt), 4) + 0.0 AS v FROM wt JOIN px ON px.frame = wt.frame AND px.y = iy AND px.x = ix GROUP BY 1, 2, 3""")
def warp_bicubic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.warp(embedding_frames(spark, sf_dir), transforms(spark), "bicubic").withColumn("v", F.round("v", 4) + 0.0)


@query(LANCZOS)
def warp_lanczos3_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resamples every frame of the stack."""
    return geometry.warp(embedding_frames(spark, sf_dir), transforms(spark), "lanczos3").withColumn("v", F.round("v", 5))


def links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """(link, correlation) from the suppliers' accounts, a link for each supplier, and the number of frames that they join."""
    s = table(spark, sf_dir, "supplier")
    made = s.select(F.col("s_suppkey").cast("int").alias("link"), F.expr("0.8D + (abs(cast(s_acctbal AS bigint)) % 20) / 100D").alias("correlation"))
    return made, s.agg(F.max("s_suppkey")).first()[0] + 2


LINKS = "WITH l AS (SELECT CAST(s_suppkey AS INTEGER) AS link, 0.8::DOUBLE + (abs(CAST(trunc(s_acctbal) AS BIGINT)) % 20) / 100.0::DOUBLE AS correlation FROM supplier), bad AS (SELECT link FROM l WHERE correlation < 0.9), nf AS (SELECT max(s_suppkey) + 2 AS n, (max(s_suppkey) + 2) // 2 AS ref FROM supplier), fs AS (SELECT CAST(unnest(range(n)) AS INTEGER) AS f, n, ref FROM nf)"
CULPRITS = LINKS + ", cu AS (SELECT f AS frame FROM fs WHERE (f = 0 OR f - 1 IN (SELECT link FROM bad)) AND (f = n - 1 OR f IN (SELECT link FROM bad)))"


@query(LINKS + " SELECT f AS frame FROM fs WHERE EXISTS (SELECT 1 FROM bad WHERE link >= least(f, ref) AND link < greatest(f, ref))")
def affected_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, n = links(spark, sf_dir)
    return geometry.affected_frames(held, n, n // 2, 0.9)


@query(CULPRITS + " SELECT frame FROM cu")
def culprits(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, n = links(spark, sf_dir)
    return geometry.culprits(held, n, 0.9)


@query(CULPRITS + " SELECT CAST(coalesce((SELECT f FROM fs WHERE f NOT IN (SELECT frame FROM cu) ORDER BY abs(f - ref), f LIMIT 1), (SELECT ref FROM nf)) AS INTEGER) AS ref")
def nearest_good(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, n = links(spark, sf_dir)
    return geometry.nearest_good(geometry.culprits(held, n, 0.9), n, n // 2)


@query("""WITH RECURSIVE m AS (SELECT s_suppkey AS link, 1 + (s_suppkey % 7 - 3) / 1000.0::DOUBLE AS s, (s_suppkey % 5 - 2) / 2.0::DOUBLE AS tx, (s_suppkey % 3 - 1) / 4.0::DOUBLE AS ty FROM supplier), r AS (SELECT (max(s_suppkey) + 2) // 2 AS f FROM supplier
), up AS (SELECT f, 1.0::DOUBLE AS a, 0.0::DOUBLE AS u, 0.0::DOUBLE AS v FROM r UNION ALL SELECT f + 1, s * a, s * u + tx, s * v + ty FROM up JOIN m ON m.link = f
), down AS (SELECT f, 1.0::DOUBLE AS a, 0.0::DOUBLE AS u, 0.0::DOUBLE AS v FROM r UNION ALL SELECT f - 1, a / s, (u - tx) / s, (v - ty) / s FROM down JOIN m ON m.link = f - 1
), b AS (SELECT * FROM up UNION SELECT * FROM down) SELECT CAST(f AS INTEGER) AS frame, round(a, 6) AS scale, round(u, 6) + 0.0 AS tx, round(v, 6) + 0.0 AS ty FROM b""")
def transform_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame of a stack to its middle, over a link for each supplier."""
    s = table(spark, sf_dir, "supplier")
    scale, tx, ty = "(1D + (s_suppkey % 7 - 3) / 1000D)", "((s_suppkey % 5 - 2) / 2D)", "((s_suppkey % 3 - 1) / 4D)"
    pairs = s.select(F.col("s_suppkey").cast("int").alias("link"), F.expr(f"array({scale}, 0D, {tx}, 0D, {scale}, {ty}, 0D, 0D, 1D)").alias("m"))
    n = s.agg(F.max("s_suppkey")).first()[0] + 2
    out = geometry.chain_to_reference(pairs, n, n // 2)
    return out.select("frame", F.round(F.expr("m[0]"), 6).alias("scale"), (F.round(F.expr("m[2]"), 6) + 0.0).alias("tx"), (F.round(F.expr("m[5]"), 6) + 0.0).alias("ty"))
