"""Focus curves and frame selection over the embedding raster, on a grid of 5 x 8 cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import select, stencils
from ..raster import embedding_frames, pixels
from .raster_queries import RASTER
from .registry import query

ROWS, COLS = 5, 8
SECOND = RASTER + """, d2 AS MATERIALIZED (
  SELECT c.frame, c.y, c.x, abs(2 * c.v - u.v - d.v) AS v, c.v AS code FROM px c JOIN dim USING (frame) JOIN px u ON u.frame = c.frame AND u.x = c.x AND u.y = greatest(0, c.y - 1) JOIN px d ON d.frame = c.frame AND d.x = c.x AND d.y = least(h - 1, c.y + 1)
)"""
CELLS = SECOND + f""", cell AS MATERIALIZED (
  SELECT frame, CAST((SELECT count(*) FROM range(1, {ROWS}) k WHERE y >= floor(k.range * h / {ROWS})) AS INTEGER) AS r, CAST((SELECT count(*) FROM range(1, {COLS}) k WHERE x >= floor(k.range * w / {COLS})) AS INTEGER) AS c, v, code FROM d2 JOIN dim USING (frame)
), fm AS MATERIALIZED (SELECT frame, r, c, CAST(sum(CASE WHEN code % 7 <> 0 THEN v ELSE 0 END) AS BIGINT) AS total, count(*) AS n, count(*) FILTER (code % 7 <> 0) AS good FROM cell GROUP BY 1, 2, 3
), fa AS MATERIALIZED (SELECT frame, r, c, CAST(sum(v) AS BIGINT) AS v FROM cell GROUP BY 1, 2, 3
), sm AS MATERIALIZED (SELECT a.frame, a.r, a.c, CAST(sum(b.v) AS BIGINT) AS v FROM fa a JOIN fa b ON b.frame = a.frame AND abs(b.r - a.r) <= 1 AND abs(b.c - a.c) <= 1 GROUP BY 1, 2, 3)"""
CURVES = CELLS + """, mo AS (SELECT r, c, avg(v) AS mu FROM sm GROUP BY 1, 2
), ku AS (SELECT sm.r, sm.c, avg((v - mu) ** 2) AS m2, avg((v - mu) ** 4) AS m4, max(v) AS top, list(v ORDER BY frame) AS curve FROM sm JOIN mo USING (r, c) GROUP BY 1, 2
), re AS MATERIALIZED (SELECT r, c, curve, CASE WHEN m2 < 1e-12 THEN -3.0 ELSE m4 / (m2 * m2) - 3 END AS kurt, top >= 0.3 * (SELECT max(top) FROM ku) AS loud FROM ku)"""


def intervals_sql(percent: int) -> str:
    return CURVES + f""", pk AS (SELECT r, c, curve, CAST(list_position(curve, list_max(curve)) - 1 AS INTEGER) AS peak FROM re WHERE loud AND kurt >= -1.2
), iv AS MATERIALIZED (
  SELECT r, c, peak, CAST(coalesce(list_max(list_filter(range(0, len(curve)), lambda i: i < peak AND 100 * curve[i + 1] < {percent} * curve[peak + 1])) + 1, 0) AS INTEGER) AS lo,
    CAST(coalesce(list_min(list_filter(range(0, len(curve)), lambda i: i > peak AND 100 * curve[i + 1] < {percent} * curve[peak + 1])) - 1, len(curve) - 1) AS INTEGER) AS hi FROM pk
)"""


def rows_sql(percent: int) -> str:
    return intervals_sql(percent) + """, bp AS (SELECT peak, min(lo) AS lo, max(hi) AS hi FROM iv GROUP BY peak
), sy AS (
  SELECT greatest(0, least(9, lo - 1)) AS lo, greatest(0, least(9, hi - 1)) AS hi FROM bp WHERE peak - 1 NOT IN (SELECT peak FROM bp)
  UNION ALL SELECT greatest(0, least(9, lo + 1)), greatest(0, least(9, hi + 1)) FROM bp WHERE peak + 1 NOT IN (SELECT peak FROM bp)
), cr AS MATERIALIZED (SELECT lo, hi, 'cell' AS kind FROM iv UNION ALL SELECT lo, hi, 'synthetic' FROM sy WHERE lo <= hi)"""


def cover_sql(percent: int, then: str) -> str:
    text = rows_sql(percent).replace("WITH px", "WITH RECURSIVE px")
    return text + f""", st(p, n) AS (
  SELECT min(hi), 1 FROM cr HAVING count(*) > 0 UNION ALL SELECT (SELECT min(hi) FROM cr WHERE lo > p), n + 1 FROM st WHERE (SELECT min(hi) FROM cr WHERE lo > p) IS NOT NULL
) {then}"""


KEPT = "SELECT list(CAST(p AS INTEGER) ORDER BY p) AS kept FROM st"
CHOSEN = "SELECT CAST(f.range AS INTEGER) AS frame, (SELECT count(*) FROM st) < 3 OR f.range IN (SELECT p FROM st) AS kept, (SELECT count(*) FROM st) < 3 AS warned FROM range(10) f"


def measure(spark: SparkSession, sf_dir: str, valid: str = "true") -> DataFrame:
    return select.focus_measure(embedding_frames(spark, sf_dir), ROWS, COLS, valid)


def reliable(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measure(spark, sf_dir)
    return select.reliable_cells(select.smooth_curves(m), select.invalid_cells(m))


def cell_intervals(spark: SparkSession, sf_dir: str, percent: int) -> DataFrame:
    return select.intervals(reliable(spark, sf_dir).where("reliable"), percent)


@query(SECOND + " SELECT frame, y, x, v FROM d2")
def second_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(stencils.second_difference(embedding_frames(spark, sf_dir)))


@query(CELLS + " SELECT * FROM fm")
def focus_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(spark, sf_dir, "code % 7 <> 0")


@query(CELLS + " SELECT r, c, bool_or(1 - good / n > 0.25) AS invalid FROM fm GROUP BY 1, 2")
def cell_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.invalid_cells(measure(spark, sf_dir, "code % 7 <> 0"))


@query(CELLS + " SELECT * FROM sm")
def smooth_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.smooth_curves(measure(spark, sf_dir))


@query(CURVES + " SELECT r, c, round(kurt, 6) AS kurt FROM re")
def kurtosis_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reliable(spark, sf_dir).select("r", "c", F.round("kurt", 6).alias("kurt"))


@query(CURVES + " SELECT r, c, loud AND kurt >= -1.2 AS reliable FROM re")
def reliable_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reliable(spark, sf_dir).select("r", "c", "reliable")


@query(CELLS + " SELECT r, c, arg_max(frame, (v, -frame)) AS peak FROM sm GROUP BY 1, 2")
def peak_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.smooth_curves(measure(spark, sf_dir)).groupBy("r", "c").agg(F.max_by("frame", F.struct("v", -F.col("frame"))).alias("peak"))


@query(intervals_sql(95) + " SELECT * FROM iv")
def focus_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cell_intervals(spark, sf_dir, 95)


@query(rows_sql(95) + " SELECT * FROM cr")
def coverage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.coverage_rows(cell_intervals(spark, sf_dir, 95), 10)


@query(cover_sql(98, KEPT))
def stab_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.stab_cover(select.coverage_rows(cell_intervals(spark, sf_dir, 98), 10))


def chosen(percent: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return select.select_frames(select.coverage_rows(cell_intervals(spark, sf_dir, percent), 10), 10)

    run.__name__ = f"selection_{percent}"
    return run


for _percent in (85, 95, 98):
    query(cover_sql(_percent, CHOSEN))(chosen(_percent))
