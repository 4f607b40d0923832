"""Frame lists, capture groups, validation, digests, jobs and names over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import catalog, retouch
from ..raster import table
from .registry import query


@query("""WITH e AS (SELECT user_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t0 FROM events)
SELECT user_id, event_id, CAST(sum(CASE WHEN abs(epoch_us(ts) - epoch_us(t0)) > 7200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS grp FROM e""")
def auto_group_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return catalog.auto_group(events, ["user_id"], ["ts", "event_id"], "ts", None, max_seconds=7200.0).select("user_id", "event_id", "grp")


@query("""WITH f AS (SELECT source, doc_id, CAST(regexp_extract('img_' || doc_id || '.tif', '([0-9]+)\\.[^.]+$', 1) AS BIGINT) AS n FROM documents), g AS (SELECT *, lag(n) OVER (PARTITION BY source ORDER BY doc_id) AS n0 FROM f)
SELECT source, doc_id, CAST(sum(CASE WHEN n - n0 > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS grp FROM g""")
def auto_group_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select("source", "doc_id", F.format_string("img_%d.tif", "doc_id").alias("name"))
    numbered = files.withColumn("number", catalog.trailing_number("name"))
    return catalog.auto_group(numbered, ["source"], ["doc_id"], None, "number").select("source", "doc_id", "grp")


#: A stack of frame headers for each brand of part.
HEADERS = """WITH f AS (
  SELECT p_brand AS stack, p_partkey AS ordinal, ['tif', 'png', 'dng', 'gif', 'jpg', 'tiff', 'nef'][p_partkey % 7 + 1] AS ext, p_partkey % 11 <> 0 AS readable, CASE WHEN p_partkey % 13 = 0 THEN 4 ELSE 3 END AS channels,
    CASE WHEN p_partkey % 7 IN (2, 6) THEN 'scene_linear_camera_rgb' ELSE 'rendered_rgb' END AS domain, 4000 + p_size % 2 AS width, 3000 AS height, CASE WHEN p_size % 5 = 0 THEN 8 ELSE 16 END AS bit_depth,
    CASE WHEN p_size % 3 = 0 THEN 'a' ELSE 'b' END AS camera, p_size % 4 AS black, p_size % 2 AS sensor, CASE WHEN p_partkey % 19 = 0 THEN 'x' ELSE 'rggb' END AS cfa, p_partkey % 17 = 0 AS lacks FROM part
)"""


@query(HEADERS + """, u AS (SELECT *, readable AND channels = 3 AND ext <> 'gif' AS ok FROM f), r AS (SELECT stack, arg_min(domain, ordinal) AS rd, arg_min(width, ordinal) AS rw, arg_min(bit_depth, ordinal) AS rb, arg_min(camera, ordinal) AS rc, arg_min(black, ordinal) AS rk, arg_min(sensor, ordinal) AS rs, arg_min(cfa, ordinal) AS rf FROM u WHERE ok GROUP BY stack)
SELECT ordinal, CASE WHEN ext = 'gif' THEN 'unsupported' WHEN NOT readable THEN CASE WHEN ext IN ('dng', 'nef') THEN 'raw_decode_error' ELSE 'unreadable' END WHEN channels <> 3 THEN 'not_rgb'
  WHEN domain = 'scene_linear_camera_rgb' AND lacks THEN 'missing_raw_calibration' WHEN domain IS DISTINCT FROM rd THEN 'mixed_domain' WHEN domain = 'scene_linear_camera_rgb' AND camera IS DISTINCT FROM rc THEN 'incompatible_camera'
  WHEN domain = 'scene_linear_camera_rgb' AND sensor IS DISTINCT FROM rs THEN 'incompatible_sensor_mode' WHEN domain = 'scene_linear_camera_rgb' AND cfa IS DISTINCT FROM rf THEN 'incompatible_cfa'
  WHEN domain = 'scene_linear_camera_rgb' AND black IS DISTINCT FROM rk THEN 'incompatible_raw_calibration' WHEN domain = 'scene_linear_camera_rgb' THEN 'ok' WHEN width IS DISTINCT FROM rw THEN 'wrong_size' WHEN bit_depth IS DISTINCT FROM rb THEN 'wrong_bit_depth' ELSE 'ok' END AS status
FROM f LEFT JOIN r USING (stack)""")
def validate_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    frames = p.select(
        F.col("p_brand").alias("stack"), F.col("p_partkey").alias("ordinal"), F.expr("array('tif', 'png', 'dng', 'gif', 'jpg', 'tiff', 'nef')[cast(p_partkey % 7 AS int)]").alias("ext"), F.expr("p_partkey % 11 <> 0").alias("readable"),
        F.expr("CASE WHEN p_partkey % 13 = 0 THEN 4 ELSE 3 END").alias("channels"), F.expr("CASE WHEN p_partkey % 7 IN (2, 6) THEN 'scene_linear_camera_rgb' ELSE 'rendered_rgb' END").alias("domain"), F.expr("4000 + p_size % 2").alias("width"), F.lit(3000).alias("height"),
        F.expr("CASE WHEN p_size % 5 = 0 THEN 8 ELSE 16 END").alias("bit_depth"), F.expr("CASE WHEN p_size % 3 = 0 THEN 'a' ELSE 'b' END").alias("camera"), F.expr("p_size % 4").alias("black"), F.expr("p_size % 2").alias("sensor"), F.expr("CASE WHEN p_partkey % 19 = 0 THEN 'x' ELSE 'rggb' END").alias("cfa"),
        F.expr("CASE WHEN p_partkey % 17 = 0 THEN array('white level') ELSE cast(array() AS array<string>) END").alias("missing"),
    )
    return catalog.validate_stack(frames, ["stack"]).select("ordinal", "status")


@query("SELECT source, sha256(string_agg('f' || doc_id || sha256(text), '' ORDER BY doc_id)) AS source_digest, count(*) AS files FROM documents GROUP BY source")
def source_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("ordinal"), F.format_string("f%d", "doc_id").alias("name"), F.sha2("text", 256).alias("digest"))
    return catalog.source_digest(files, ["source"])


def _paths(spark: SparkSession, sf_dir: str, where: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where(where).select(F.format_string("frame_%05d.tif", F.col("c_custkey")).alias("path"), F.col("c_custkey").alias("ordinal"))


@query("""WITH have AS (SELECT printf('frame_%05d.tif', c_custkey) AS path, c_custkey AS ordinal FROM customer WHERE c_custkey % 3 = 0), new AS (SELECT printf('frame_%05d.tif', c_custkey) AS path, c_custkey AS o FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0)
SELECT * FROM have UNION ALL SELECT path, (SELECT coalesce(max(ordinal) + 1, 0) FROM have) + row_number() OVER (ORDER BY o) - 1 FROM new""")
def frame_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.add_frames(_paths(spark, sf_dir, "c_custkey % 3 = 0"), _paths(spark, sf_dir, "c_custkey % 2 = 0"))


@query("SELECT printf('frame_%05d.tif', c_custkey) AS path, c_custkey AS ordinal FROM customer WHERE c_custkey % 4 <> 0")
def frame_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.remove_frames(_paths(spark, sf_dir, "true"), _paths(spark, sf_dir, "c_custkey % 4 = 0")).select("path", "ordinal")


@query("SELECT DISTINCT l_suppkey AS frame, CAST(dense_rank() OVER (ORDER BY l_suppkey) - 1 AS INTEGER) AS position FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def subset_reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("frame"))
    return catalog.reindex(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("frame")), kept)


@query("SELECT c_custkey AS frame FROM customer EXCEPT SELECT o_custkey FROM orders")
def excluded_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("frame")).exceptAll(table(spark, sf_dir, "orders").select("o_custkey").distinct())


@query("SELECT (SELECT string_agg(n_name, ', ' ORDER BY n_nationkey) FROM nation WHERE n_nationkey < 8) || ' (+' || (count(*) - 8) || ' more)' AS label FROM nation")
def skipped_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.first_names(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ordinal"), F.col("n_name").alias("name")))


@query("SELECT user_id AS job_id, arg_max(event_type, event_id) AS status, max(event_id) AS seq, count(*) AS n FROM events GROUP BY user_id")
def job_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.latest_jobs(table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_type").alias("status"), F.col("event_id").alias("seq")))


JOBS = "WITH j AS (SELECT o_orderkey AS job_id, CASE WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'done' END AS status, o_orderkey AS seq, CASE WHEN o_orderkey % 3 = 0 THEN -o_orderkey END AS wanted FROM orders)"


@query(JOBS + ", m AS (SELECT *, status = 'pending' AND wanted IS NOT NULL AS moved FROM j), r AS (SELECT *, CASE WHEN moved THEN 1 WHEN seq = (SELECT min(seq) FROM m WHERE NOT moved) THEN 0 ELSE 2 END AS rank FROM m) SELECT job_id, row_number() OVER (ORDER BY rank, CASE WHEN moved THEN wanted ELSE seq END) - 1 AS position FROM r")
def job_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    jobs = o.select(F.col("o_orderkey").alias("job_id"), F.expr("CASE WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'done' END").alias("status"), F.col("o_orderkey").alias("seq"))
    return catalog.job_order(jobs, o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("job_id"), (-F.col("o_orderkey")).alias("wanted")))


@query("WITH s AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part) SELECT p_partkey, regexp_replace(p_name || ' ' || p_type || ':' || p_size || ' {x} ' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END, '[\\\\/:*?\"<>|]', '_', 'g') AS name FROM s")
def export_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of a brand's exports, numbered within the brand."""
    parts = table(spark, sf_dir, "part").withColumn("seq", catalog.sequence_number(["p_partkey"], ["p_brand"]))
    return parts.select("p_partkey", catalog.export_name("{stack_name} {method}:{frames} {x} {seq}", stack_name=F.col("p_name"), method=F.col("p_type"), frames=F.col("p_size"), seq=F.col("seq")).alias("name"))


@query("SELECT c_custkey AS image_id, min(o_orderkey) FILTER (o_orderstatus = 'F') AS depth_id FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def depth_companion(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id"), F.col("o_custkey").alias("parent"), F.expr("CASE WHEN o_orderstatus = 'F' THEN 'depth' ELSE 'result' END").alias("kind"))
    return catalog.companion(images, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("image_id")))


@query("""WITH e AS (SELECT event_id, ['DiskSpaceError', 'ValueError', 'KeyError', 'OSError', 'BackendError', 'AlignmentError'][event_id % 6 + 1] AS error FROM events)
SELECT event_id, CASE error WHEN 'DiskSpaceError' THEN 'insufficient_disk_space' WHEN 'ValueError' THEN 'invalid_request' WHEN 'OSError' THEN 'io_failed' WHEN 'BackendError' THEN 'backend_failed' WHEN 'AlignmentError' THEN 'alignment_failed' ELSE 'internal_error' END AS code,
  CASE error WHEN 'DiskSpaceError' THEN 507 WHEN 'ValueError' THEN 400 WHEN 'BackendError' THEN 503 WHEN 'AlignmentError' THEN 422 ELSE 500 END AS status FROM e""")
def error_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.expr("array('DiskSpaceError', 'ValueError', 'KeyError', 'OSError', 'BackendError', 'AlignmentError')[cast(event_id % 6 AS int)]")
    code, status = catalog.error_code("error")
    return table(spark, sf_dir, "events").select("event_id", names.alias("error")).select("event_id", code.alias("code"), status.alias("status"))


@query("SELECT session, n, CAST(n // 20 * 20 AS BIGINT) AS checkpoint, CAST(n % 20 AS BIGINT) AS replay FROM (SELECT user_id AS session, count(*) AS n FROM events GROUP BY 1)")
def undo_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long").alias("at"))
    return retouch.checkpoint_for(e.groupBy("session").agg(F.count("*").alias("n")), e.where("at % 20 = 0"))


@query("""WITH RECURSIVE e AS (SELECT user_id AS session, event_id AS stroke, CASE event_type WHEN 'view' THEN 'undo' WHEN 'click' THEN 'redo' ELSE 'apply' END AS action, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events
), s AS (SELECT DISTINCT session, n, 0::BIGINT AS i, []::BIGINT[] AS done, []::BIGINT[] AS undone FROM e
  UNION ALL SELECT s.session, s.n, e.i, CASE e.action WHEN 'apply' THEN list_append(done, e.stroke) WHEN 'undo' THEN done[1:len(done) - 1] ELSE CASE WHEN len(undone) > 0 THEN list_append(done, undone[len(undone)]) ELSE done END END,
    CASE e.action WHEN 'apply' THEN []::BIGINT[] WHEN 'undo' THEN CASE WHEN len(done) > 0 THEN list_append(undone, done[len(done)]) ELSE undone END ELSE undone[1:len(undone) - 1] END FROM s JOIN e ON e.session = s.session AND e.i = s.i + 1
) SELECT session, unnest(range(len(done)))::INTEGER AS position, unnest(done) AS stroke FROM s WHERE i = n""")
def live_strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event log as strokes: views undo, clicks redo, all else paints; tested against a plain replay."""
    e = table(spark, sf_dir, "events")
    action = F.expr("CASE event_type WHEN 'view' THEN 'undo' WHEN 'click' THEN 'redo' ELSE 'apply' END")
    return retouch.live_strokes(e.select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), action.alias("action"), F.col("event_id").alias("stroke")))


@query("""WITH b AS (SELECT p_partkey AS id, p_size * 30 AS y0, p_partkey * 37 % 3500 AS x0, p_size * 30 + 200 AS y1, p_partkey * 37 % 3500 + 300 AS x1 FROM part), l AS (SELECT 0 AS z, 250 AS w, 187 AS h, 16 AS s UNION ALL SELECT 1, 500, 375, 8 UNION ALL SELECT 2, 1000, 750, 4 UNION ALL SELECT 3, 2000, 1500, 2 UNION ALL SELECT 4, 4000, 3000, 1)
SELECT id, z, CAST(ty.range AS INTEGER) AS ty, CAST(tx.range AS INTEGER) AS tx FROM b, l, range(12) ty, range(16) tx WHERE ty.range BETWEEN y0 // s // 256 AND least((h - 1) // 256, (y1 - 1) // s // 256) AND tx.range BETWEEN x0 // s // 256 AND least((w - 1) // 256, (x1 - 1) // s // 256)""")
def dirty_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), *(F.expr(f"cast({e} AS int)").alias(n) for n, e in (("y0", "p_size * 30"), ("x0", "p_partkey * 37 % 3500"), ("y1", "p_size * 30 + 200"), ("x1", "p_partkey * 37 % 3500 + 300"))))
    out = retouch.dirty_tiles(boxes, 4000, 3000)
    return out.select("id", "z", *(F.col(c).cast("int").alias(c) for c in ("ty", "tx")))
