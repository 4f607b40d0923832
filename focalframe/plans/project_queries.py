"""Frame lists, metadata, planning, projects, sessions and jobs over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import geometry, projects
from ..raster import embedding_frames, pixels, table
from .raster_queries import RASTER
from .registry import query

#: Files of documents: a folder for each source, every third file a kind that is no frame.
FILES = "WITH fs AS (SELECT doc_id, '/' || coalesce(source, 'none') AS folder, '/' || coalesce(source, 'none') || '/img_' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.TIF' WHEN 1 THEN '.nef' ELSE '.txt' END AS path FROM documents)"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = F.concat(F.lit("/"), F.coalesce("source", F.lit("none")))
    kind = F.expr("CASE doc_id % 3 WHEN 0 THEN '.TIF' WHEN 1 THEN '.nef' ELSE '.txt' END")
    return table(spark, sf_dir, "documents").select("doc_id", folder.alias("folder"), F.concat(folder, F.lit("/img_"), F.col("doc_id").cast("string"), kind).alias("path"))


@query(FILES + """, raw AS (SELECT folder AS path, 0 AS ordinal FROM fs WHERE doc_id % 2 = 0 UNION SELECT path, 1 + doc_id FROM fs WHERE doc_id % 5 = 0), ok AS (SELECT * FROM fs WHERE doc_id % 3 <> 2)
SELECT path, min(ordinal) AS ordinal FROM (SELECT ok.path, ordinal FROM raw JOIN ok ON ok.folder = raw.path UNION ALL SELECT ok.path, ordinal FROM raw JOIN ok ON ok.path = raw.path) GROUP BY path""")
def expand_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    raw = files.where("doc_id % 2 = 0").select(F.col("folder").alias("path"), F.lit(0).cast("long").alias("ordinal")).distinct().unionByName(files.where("doc_id % 5 = 0").select("path", (F.col("doc_id") + 1).alias("ordinal")))
    return projects.expand(raw, files.select("folder", "path"))


@query(FILES + " SELECT folder, path, CAST(row_number() OVER (PARTITION BY folder ORDER BY path) - 1 AS INTEGER) AS ordinal FROM fs WHERE doc_id % 3 <> 2")
def folder_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.catalog import scan

    return projects.path_order(scan(_files(spark, sf_dir)), ["folder"]).select("folder", "path", "ordinal")


@query("""WITH e AS (SELECT p_brand AS folder, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END || '_' || p_partkey || CASE p_partkey % 4 WHEN 0 THEN '.jpg' WHEN 1 THEN '.nef' WHEN 2 THEN '.PNG' ELSE '' END AS name, p_partkey % 7 = 0 AS is_dir, p_partkey FROM part)
SELECT folder, name, is_dir, CAST(row_number() OVER (PARTITION BY folder ORDER BY NOT is_dir, lower(name), name) - 1 AS INTEGER) AS position, count(*) FILTER (NOT is_dir AND p_partkey % 4 IN (0, 2)) OVER (PARTITION BY folder) AS image_count FROM e""")
def folder_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.expr("concat(CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END, '_', p_partkey, CASE p_partkey % 4 WHEN 0 THEN '.jpg' WHEN 1 THEN '.nef' WHEN 2 THEN '.PNG' ELSE '' END)")
    entries = table(spark, sf_dir, "part").select(F.col("p_brand").alias("folder"), name.alias("name"), F.expr("p_partkey % 7 = 0").alias("is_dir"))
    return projects.listing(entries, ["folder"])


@query("SELECT p_partkey, CASE WHEN p_partkey % 9 BETWEEN 5 AND 8 THEN p_size + 100 ELSE p_size + 200 END AS width, CASE WHEN p_partkey % 9 BETWEEN 5 AND 8 THEN p_size + 200 ELSE p_size + 100 END AS height FROM part")
def oriented_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") + 200).alias("w"), (F.col("p_size") + 100).alias("h"), (F.col("p_partkey") % 9).alias("o"))
    w, h = projects.oriented_size("w", "h", "o")
    return p.select("p_partkey", w.alias("width"), h.alias("height"))


@query(RASTER + """ SELECT frame, CAST(CASE frame % 9 WHEN 3 THEN h - 1 - y WHEN 4 THEN h - 1 - y WHEN 5 THEN x WHEN 6 THEN x WHEN 7 THEN w - 1 - x WHEN 8 THEN w - 1 - x ELSE y END AS INTEGER) AS y,
CAST(CASE frame % 9 WHEN 2 THEN w - 1 - x WHEN 3 THEN w - 1 - x WHEN 5 THEN y WHEN 6 THEN h - 1 - y WHEN 7 THEN h - 1 - y WHEN 8 THEN y ELSE x END AS INTEGER) AS x, v FROM px JOIN dim USING (frame)""")
def upright(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = embedding_frames(spark, sf_dir)
    px = frames.select("frame", "y", "height", F.size("row").alias("width"), F.posexplode("row").alias("x", "v")).withColumn("orientation", F.col("frame") % 9)
    return projects.upright(px).select("frame", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "v")


@query(RASTER + " SELECT frame, y, x, v FROM px WHERE y >= 3 AND y < 17 AND x >= 10 AND x < 40")
def crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The region is the feature; every frame is read."""
    return projects.crop(pixels(embedding_frames(spark, sf_dir)), 3, 10, 17, 40)


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 < 3 THEN 'o' || event_id WHEN event_id % 5 = 3 THEN 't' || event_id ELSE 'd' || event_id END AS captured FROM events")
def capture_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = {"Exif.Photo.DateTimeOriginal": "CASE WHEN event_id % 5 IN (1, 2) THEN concat('o', event_id) ELSE '' END", "Exif.Image.DateTime": "CASE WHEN event_id % 5 = 3 THEN concat('t', event_id) END", "Exif.Photo.DateTimeDigitized": "CASE WHEN event_id % 5 <> 0 THEN concat('d', event_id) END"}
    exif = F.create_map(*(x for k, v in keys.items() for x in (F.lit(k), F.expr(v))))
    return table(spark, sf_dir, "events").select("event_id", exif.alias("exif")).select("event_id", projects.capture_time_of().alias("captured"))


@query("SELECT p_partkey, 'Exif.Photo.ISO,Exif.Photo.FNumber' || CASE WHEN p_partkey % 2 = 0 THEN ',Xmp.aux.Lens' ELSE '' END AS kept FROM part")
def portable_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = "CASE WHEN p_partkey % 2 = 0 THEN 'Xmp.aux.Lens' ELSE 'Xmp.aux.Depth_Of_Field' END"
    exif = F.create_map(F.lit("Exif.Photo.ISO"), F.lit("1"), F.lit("Exif.Photo.Subject_Distance"), F.lit("2"), F.lit("Exif.Photo.FNumber"), F.lit("3"), F.expr(lens), F.lit("4"))
    return table(spark, sf_dir, "part").select("p_partkey", exif.alias("m")).select("p_partkey", F.array_join(F.map_keys(projects.without_single_exposure("m")), ",").alias("kept"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 0.5 WHEN p_partkey % 4 = 1 THEN NULL ELSE round((1 / CAST(p_size AS DOUBLE)) / (1 / CAST(p_size + 1 AS DOUBLE)), 9) END AS red FROM part")
def shot_neutral(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.expr("CASE WHEN p_partkey % 4 = 0 THEN array(0.5D, 1D, 0.7D) END").alias("tag"), F.expr("CASE WHEN p_partkey % 4 = 1 THEN array(0D, 1D, 1D) ELSE array(cast(p_size AS double), p_size + 1D, p_size + 2D, 0D) END").alias("wb"))
    return p.select("p_partkey", F.round(projects.as_shot_neutral().getItem(0), 9).alias("red"))


@query(RASTER + ", q AS (SELECT frame, quantile_cont(v, 0.005) AS lo, quantile_cont(v, 0.995) AS hi FROM px GROUP BY 1) SELECT frame, y, x, round(CASE WHEN hi - lo <= 1e-7 THEN 0.0 ELSE least(1.0, greatest(0.0, (v - lo) / (hi - lo))) END, 9) AS proxy FROM px JOIN q USING (frame)")
def proxy_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projects.proxy_stretch(pixels(embedding_frames(spark, sf_dir)), ["frame"]).select("frame", "y", "x", F.round("proxy", 9).alias("proxy"))


@query("WITH s AS (SELECT p_partkey, p_size * 160 AS w, p_partkey % 50 * 90 + 1 AS h FROM part), t AS (SELECT *, greatest(w, h) AS e FROM s), u AS (SELECT *, CASE WHEN e <= 2048 THEN w ELSE greatest(1, round_even(w / (e / 2048.0::DOUBLE), 0)) END AS pw, CASE WHEN e <= 2048 THEN h ELSE greatest(1, round_even(h / (e / 2048.0::DOUBLE), 0)) END AS ph FROM t) SELECT p_partkey, CAST(pw AS INTEGER) AS width, CAST(ph AS INTEGER) AS height, round(CASE WHEN e <= 2048 THEN 1.0 ELSE e / CAST(greatest(pw, ph) AS DOUBLE) END, 9) AS factor FROM u")
def proxy_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h, factor = projects.proxy_size("w", "h")
    sizes = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 160).alias("w"), (F.col("p_partkey") % 50 * 90 + 1).alias("h"))
    return sizes.select("p_partkey", w.cast("int").alias("width"), h.cast("int").alias("height"), F.round(factor, 9).alias("factor"))


@query("WITH m AS (SELECT o_custkey, count(*) FILTER (o_orderkey % 3 <> 0) AS n, avg(CAST(o_orderkey % 97 AS DOUBLE)) FILTER (o_orderkey % 3 <> 0) AS a, avg(CAST(o_orderkey % 89 AS DOUBLE)) FILTER (o_orderkey % 3 <> 0) AS b FROM orders GROUP BY 1) SELECT o_custkey, round(CASE WHEN n < 16 OR b < 1e-6 THEN 1.0 ELSE a / b END, 9) AS gain FROM m")
def brightness_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", F.expr("cast(o_orderkey % 97 AS double)").alias("a"), F.expr("cast(o_orderkey % 89 AS double)").alias("b"), F.expr("o_orderkey % 3 <> 0").alias("ok"))
    return projects.brightness_gain(o, ["o_custkey"]).select("o_custkey", F.round("gain", 9).alias("gain"))


PLAN = "WITH j AS (SELECT p_partkey, p_size * 100 AS w, p_partkey % 40 * 75 + 1 AS h, p_partkey % 60 + 2 AS n, ['pmax', 'dmap', 'slab', 'weighted', 'other'][p_partkey % 5 + 1] AS method, p_partkey % 2 = 0 AS align, ['cuda', 'mps', 'cpu'][p_partkey % 3 + 1] AS device FROM part)"


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"method": "array('pmax', 'dmap', 'slab', 'weighted', 'other')[cast(p_partkey % 5 AS int)]", "align": "p_partkey % 2 = 0", "device": "array('cuda', 'mps', 'cpu')[cast(p_partkey % 3 AS int)]"}
    return table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 100).alias("w"), (F.col("p_partkey") % 40 * 75 + 1).alias("h"), (F.col("p_partkey") % 60 + 2).alias("n"), *(F.expr(e).alias(c) for c, e in names.items()))


@query(PLAN + " SELECT p_partkey, CAST(trunc(CAST(h AS DOUBLE) * w * 4 / 3 * 20 + (CAST(h AS DOUBLE) * w * 36 + CAST(h AS DOUBLE) * w * 4 / 3 * 16)) AS BIGINT) AS bytes FROM j")
def memory_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _jobs(spark, sf_dir).select("p_partkey", projects.stack_bytes("w", "h").alias("bytes"))


@query(PLAN + " SELECT p_partkey, greatest(0.1, round_even(CAST(w AS DOUBLE) * h * n / 1e6 / CASE device WHEN 'cuda' THEN 80.0 WHEN 'mps' THEN 28.0 ELSE 4.0 END * CASE method WHEN 'weighted' THEN 0.7 WHEN 'dmap' THEN 1.35 WHEN 'slab' THEN 1.6 ELSE 1.0 END + CASE WHEN align THEN n * 0.12::DOUBLE ELSE 0.0 END, 1)) AS seconds FROM j")
def planning_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _jobs(spark, sf_dir).select("p_partkey", projects.planned_seconds("w", "h", "n", "method", "align", "device").alias("seconds"))


@query("SELECT vec_id, list_bool_and(list_transform(embedding, lambda e: isfinite(CAST(1 / nullif(round(CAST(e AS DOUBLE), 1), 0) AS DOUBLE)))) AS finite FROM embeddings")
def finite_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.expr("transform(embedding, e -> try_divide(1D, round(cast(e AS double), 1)))").alias("v"))
    return e.select("vec_id", F.expr("forall(filter(v, x -> x IS NOT NULL), x -> NOT isnan(x) AND abs(x) < double('infinity'))").alias("finite"))


@query("SELECT p_brand, count(*) FILTER (p_size > 20) AS reliable, count(*) AS cells FROM part GROUP BY 1")
def coverage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projects.coverage(table(spark, sf_dir, "part").select("p_brand", (F.col("p_size") > 20).alias("reliable")), ["p_brand"])


@query(RASTER + ", m AS (SELECT frame, y, x, (y * 3 + x + frame) % 5 <> 0 AS valid FROM px WHERE frame <> 9), ok AS (SELECT px.*, coalesce(valid, true) AS valid FROM px LEFT JOIN m USING (frame, y, x)) SELECT y, x, coalesce(arg_max(frame, (v, -frame)) FILTER (valid), min(frame)) AS winner, max(v) FILTER (valid) AS energy FROM ok GROUP BY y, x")
def frames_with_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import fuse

    px = pixels(embedding_frames(spark, sf_dir))
    masks = px.where("frame <> 9").select("frame", "y", "x", F.expr("(y * 3 + x + frame) % 5 <> 0").alias("valid"))
    return fuse.winners(projects.with_masks(px, masks), valid="valid")


@query("WITH f AS (SELECT DISTINCT o_custkey AS a FROM orders), g AS (SELECT a, lead(a) OVER (ORDER BY a) AS b, row_number() OVER (ORDER BY a) - 1 AS link FROM f) SELECT CAST(link AS INTEGER) AS link, a, b FROM g WHERE b IS NOT NULL")
def consecutive_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.consecutive_pairs(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("frame")).distinct())


#: A project for each nation whose images are its suppliers.
IMAGES = "WITH im AS (SELECT s_nationkey AS project_id, s_suppkey % 50 AS image_id, arg_min(CASE s_suppkey % 3 WHEN 0 THEN 'view' WHEN 1 THEN 'result' ELSE 'depth' END, s_suppkey) AS kind, arg_min(CASE WHEN s_suppkey % 7 <> 0 THEN '/p/' || s_suppkey % 11 ELSE '' END, s_suppkey) AS path FROM supplier GROUP BY 1, 2)"


def _projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("project_id"), (F.col("s_suppkey") % 50).alias("image_id"), "s_suppkey", F.expr("CASE s_suppkey % 3 WHEN 0 THEN 'view' WHEN 1 THEN 'result' ELSE 'depth' END").alias("kind"), F.expr("CASE WHEN s_suppkey % 7 <> 0 THEN concat('/p/', s_suppkey % 11) ELSE '' END").alias("path"))
    first = s.groupBy("project_id", "image_id").agg(F.min_by(F.struct("kind", "path"), "s_suppkey").alias("info"))
    return first.groupBy("project_id").agg(F.map_from_entries(F.collect_list(F.struct("image_id", "info"))).alias("images"))


@query(IMAGES + " SELECT image_id, min(project_id) AS project_id, arg_min(path, project_id) AS path FROM im WHERE path <> '' AND image_id % 2 = 0 GROUP BY 1")
def image_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.range(0, 50, 2).select(F.col("id").alias("image_id"))
    return projects.find_image(_projects(spark, sf_dir), wanted)


@query(IMAGES + ", w AS (SELECT n_nationkey AS project_id, '/p/' || n_nationkey % 11 AS path FROM nation), v AS (SELECT project_id, path, min(image_id) AS image_id FROM im WHERE kind = 'view' GROUP BY 1, 2) SELECT w.project_id, w.path, v.image_id FROM w LEFT JOIN v USING (project_id, path)")
def view_for_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("project_id"), F.expr("concat('/p/', n_nationkey % 11)").alias("path"))
    return projects.registered_view(_projects(spark, sf_dir), wanted)


@query("SELECT c_custkey AS ordinal, c_name AS path, sha256(c_name) AS digest FROM customer")
def zipped_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return projects.zip_strict(c.select(F.col("c_custkey").alias("ordinal"), F.col("c_name").alias("path")), c.select(F.col("c_custkey").alias("ordinal"), F.sha2("c_name", 256).alias("digest")))


#: A project for each brand of part whose images are its parts.
RESULTS = "WITH im AS (SELECT p_brand AS project_id, p_partkey AS image_id, CASE WHEN p_partkey % 3 = 0 THEN 'view' ELSE 'result' END AS kind, p_size % 2 AS width, p_size % 3 AS height FROM part), tg AS (SELECT p_brand AS project_id, p_partkey AS image_id FROM part WHERE p_partkey % 7 = 0)"


def _results(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf_dir, "part")
    images = p.select(F.col("p_brand").alias("project_id"), F.col("p_partkey").alias("image_id"), F.expr("CASE WHEN p_partkey % 3 = 0 THEN 'view' ELSE 'result' END").alias("kind"), F.expr("p_size % 2").alias("width"), F.expr("p_size % 3").alias("height"))
    return images, p.where("p_partkey % 7 = 0").select(F.col("p_brand").alias("project_id"), F.col("p_partkey").alias("image_id"))


@query(RESULTS + " SELECT t.project_id, t.image_id AS target, s.image_id AS source, t.width = s.width AND t.height = s.height AS fits FROM tg JOIN im t USING (project_id, image_id) JOIN im s ON s.project_id = t.project_id AND s.image_id <> t.image_id WHERE t.kind = 'result' AND s.kind = 'result'")
def retouch_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projects.retouch_sources(*_results(spark, sf_dir))


@query(RESULTS + " SELECT t.project_id, t.image_id, coalesce(array_to_string(list(s.image_id ORDER BY s.image_id) FILTER (s.image_id IS NOT NULL), ','), '') AS sources, 0 AS rev FROM tg JOIN im t USING (project_id, image_id) LEFT JOIN im s ON s.project_id = t.project_id AND s.image_id <> t.image_id AND s.kind = 'result' WHERE t.kind = 'result' GROUP BY 1, 2")
def new_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projects.new_sessions(*_results(spark, sf_dir), text=True)


@query("SELECT user_id AS session, count(*) FILTER (event_id % 4 <> 0) AS rev, CAST(coalesce(sum(CASE WHEN event_id % 4 <> 0 THEN (event_id % 4) * 5 END), 0) AS BIGINT) AS dirty FROM events GROUP BY 1")
def session_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.lit(0).alias("y0"), F.lit(0).alias("x0"), (F.col("event_id") % 4).alias("y1"), F.lit(5).alias("x1"))
    return projects.revisions(boxes)


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'unknown mode' WHEN p_partkey % 7 = 0 THEN 'missing field' WHEN p_size > 45 THEN 'out of range' END AS error, CASE WHEN p_partkey % 5 = 0 THEN 'smear' WHEN p_partkey % 2 = 0 THEN 'erase' ELSE 'normal' END AS mode, 0.5 AS hardness, p_size / 45.0::DOUBLE AS opacity, 1.0 AS p FROM part""")
def parse_strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = "CASE WHEN p_partkey % 5 = 0 THEN ',\"mode\":\"smear\"' WHEN p_partkey % 2 = 0 THEN ',\"mode\":\"erase\"' ELSE '' END"
    radius = "CASE WHEN p_partkey % 7 = 0 THEN '' ELSE ',\"radius\":3' END"
    text = F.expr(f"concat('{{\"source_id\":\"s\",\"points\":[[1,2],[3,4,0.5]],\"opacity\":', cast(p_size / 45D AS string), {radius}, {mode}, '}}')")
    out = projects.parse_strokes(table(spark, sf_dir, "part").select("p_partkey", text.alias("stroke")))
    return out.select("p_partkey", "error", "mode", "hardness", "opacity", F.col("points")[0]["p"].alias("p"))


@query("""WITH e AS (SELECT user_id AS job_id, event_id AS seq, ['submit', 'start', 'progress', 'finish', 'fail', 'cancel', 'progress', 'progress'][event_id % 8 + 1] AS kind FROM events
), j AS (SELECT job_id, min(seq) FILTER (kind = 'start') AS started, min(seq) FILTER (kind IN ('finish', 'fail', 'cancel')) AS ended, arg_min(kind, seq) FILTER (kind IN ('finish', 'fail', 'cancel')) AS how FROM e GROUP BY 1
), s AS (SELECT job_id, CASE WHEN how IS NULL THEN CASE WHEN started IS NULL THEN 'pending' ELSE 'running' END WHEN how <> 'cancel' AND (started IS NULL OR started > ended) THEN 'pending' WHEN how = 'finish' THEN 'done' WHEN how = 'fail' THEN 'error' ELSE 'cancelled' END AS status FROM j)
SELECT job_id, status, CASE WHEN status = 'done' THEN 1.0 ELSE 0.0 END AS percent FROM s""")
def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.expr("array('submit', 'start', 'progress', 'finish', 'fail', 'cancel', 'progress', 'progress')[cast(event_id % 8 AS int)]")
    return projects.job_states(table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), kind.alias("kind")))


@query("WITH o AS (SELECT c_custkey % 40 AS name, max(c_custkey) AS seq FROM customer WHERE c_custkey % 3 = 0 GROUP BY 1), n AS (SELECT c_custkey % 60 AS name, max(c_custkey) AS seq FROM customer WHERE c_custkey % 3 = 1 GROUP BY 1) SELECT * FROM n UNION ALL SELECT * FROM o WHERE name NOT IN (SELECT name FROM n)")
def preset_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    old = c.where("c_custkey % 3 = 0").groupBy((F.col("c_custkey") % 40).alias("name")).agg(F.max("c_custkey").alias("seq"))
    return projects.upsert(old, c.where("c_custkey % 3 = 1").select((F.col("c_custkey") % 60).alias("name"), F.col("c_custkey").alias("seq")))


@query("WITH s AS (SELECT s_suppkey AS k, 2 - s_suppkey % 2 AS version, 'd' || s_suppkey % 3 AS domain, 'h' || s_suppkey % 5 AS source_hash FROM supplier WHERE s_suppkey % 4 <> 0), e AS (SELECT s_suppkey AS k, 2 AS version, 'd' || s_suppkey % 3 AS domain, CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE 'h' || s_suppkey % 10 END AS source_hash FROM supplier) SELECT e.k, CASE WHEN s.version IS NULL THEN 'new' WHEN s.version = e.version AND s.domain = e.domain AND (e.source_hash = '' OR e.source_hash = s.source_hash) THEN 'reuse' ELSE 'clash' END AS verdict FROM e LEFT JOIN s USING (k)")
def cache_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").withColumn("k", F.col("s_suppkey"))
    stored = s.where("k % 4 <> 0").select("k", F.expr("2 - k % 2").alias("version"), F.expr("concat('d', k % 3)").alias("domain"), F.expr("concat('h', k % 5)").alias("source_hash"))
    expected = s.select("k", F.lit(2).alias("version"), F.expr("concat('d', k % 3)").alias("domain"), F.expr("CASE WHEN k % 7 = 0 THEN '' ELSE concat('h', k % 10) END").alias("source_hash"))
    return projects.manifest_fits(stored, expected, "k")


@query("WITH c AS (SELECT o_custkey, o_orderkey AS candidate, o_orderkey % 4 <> 0 AS stable, CASE WHEN o_orderkey % 6 = 0 THEN 'nan'::DOUBLE ELSE o_orderkey % 100 / 100.0::DOUBLE END AS correlation FROM orders), g AS (SELECT o_custkey, arg_max(candidate, (correlation, -candidate)) AS candidate, max(correlation) AS correlation FROM c WHERE stable AND isfinite(correlation) GROUP BY 1) SELECT d.o_custkey, coalesce(candidate, 0) AS candidate, coalesce(correlation, 0.0) AS correlation FROM (SELECT DISTINCT o_custkey FROM c) d LEFT JOIN g USING (o_custkey)")
def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("candidate"), F.expr("o_orderkey % 4 <> 0").alias("stable"), F.expr("CASE WHEN o_orderkey % 6 = 0 THEN double('nan') ELSE o_orderkey % 100 / 100D END").alias("correlation"))
    return projects.best_stable(c, ["o_custkey"])


@query("""WITH m AS (SELECT p_partkey, p_partkey % 3 = 0 AS per, 0.7::DOUBLE + p_size / 80.0::DOUBLE AS s, p_partkey % 400 AS t, CASE WHEN p_partkey % 11 = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS k FROM part)
SELECT p_partkey, CASE WHEN k = 0 THEN false WHEN per THEN greatest(sqrt(t * t), sqrt((s * 299 + t - 299) ** 2), sqrt((s * 299 + t - 299) ** 2 + (s * 199 - 199) ** 2), sqrt(t * t + (s * 199 - 199) ** 2)) < sqrt(130000.0) * 0.5 ELSE s > 0.8 AND s < 1.25 END AS plausible FROM m""")
def plausible_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.expr("p_partkey % 3 = 0").alias("per"), F.expr("0.7D + p_size / 80D").alias("s"), F.expr("cast(p_partkey % 400 AS double)").alias("t"), F.expr("CASE WHEN p_partkey % 11 = 0 THEN 0D ELSE 1D END").alias("k"), F.lit(200).alias("h"), F.lit(300).alias("w"))
    m = p.withColumn("m", F.expr("array(s * k, 0D, t, 0D, s * k, 0D, 0D, 0D, 1D)"))
    return m.select("p_partkey", projects.plausible("m", "per", "h", "w").alias("plausible"))


@query("""WITH m AS (SELECT p_partkey, 1 + p_size / 50.0::DOUBLE AS a, p_partkey % 7 / 10.0::DOUBLE AS b, p_partkey % 5 / -10.0::DOUBLE AS c, 1.5::DOUBLE - p_size / 100.0::DOUBLE AS d, CAST(p_partkey % 13 AS DOUBLE) AS tx, CAST(p_partkey % 17 AS DOUBLE) AS ty FROM part
), t AS (SELECT *, atan2(c - b, a + d) AS th, greatest(sqrt((a + d) ** 2 + (c - b) ** 2), sqrt((a - d) ** 2 + (b + c) ** 2)) / 2 AS s FROM m)
SELECT p_partkey, round(s * cos(th), 6) AS p, round(s * sin(th), 6) AS q, round(tx + (a - s * cos(th)) * 40 + (b + s * sin(th)) * 30, 6) + 0.0 AS tx, round(ty + (c - s * sin(th)) * 40 + (d - s * cos(th)) * 30, 6) + 0.0 AS ty FROM t""")
def nearest_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.expr("array(1D + p_size / 50D, p_partkey % 7 / 10D, cast(p_partkey % 13 AS double), p_partkey % 5 / -10D, 1.5D - p_size / 100D, cast(p_partkey % 17 AS double), 0D, 0D, 1D)")
    out = table(spark, sf_dir, "part").select("p_partkey", m.alias("m")).select("p_partkey", projects.nearest_similarity("m", "40D", "30D").alias("n"))
    return out.select("p_partkey", *((F.round(F.col("n")[k], 6) + 0.0).alias(c) for c, k in (("p", 0), ("q", 3), ("tx", 2), ("ty", 5))))


FLAGS = "WITH af AS (SELECT c_custkey AS frame FROM customer WHERE c_custkey % 2 = 0), re AS (SELECT c_custkey AS frame FROM customer WHERE c_custkey % 6 = 0), cu AS (SELECT c_custkey AS frame FROM customer WHERE c_custkey % 5 = 0)"


def _flags(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("frame"))
    return geometry.flagged_and_dropped(c.where("frame % 2 = 0"), c.where("frame % 6 = 0"), c.where("frame % 5 = 0"), 20)


@query(FLAGS + " SELECT frame FROM af EXCEPT SELECT frame FROM re")
def flagged_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(spark, sf_dir)[0]


@query(FLAGS + " SELECT frame FROM cu WHERE frame IN (SELECT frame FROM af EXCEPT SELECT frame FROM re) AND frame <> 20")
def dropped_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(spark, sf_dir)[1]


@query("SELECT c_custkey AS frame FROM customer WHERE c_custkey % 4 = 0 UNION SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0")
def drop_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return c.where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("frame")).union(o.where("o_orderkey % 3 = 0").select("o_custkey")).distinct()


@query(RASTER + ", ab AS (SELECT px.frame, y, x, v, abs(v - 128) AS a, h, w FROM px JOIN dim USING (frame)), n AS (SELECT c.frame, c.y, c.x, sum(b.a) AS s FROM (SELECT frame, y, x, CAST((h - 1) - abs((h - 1) - abs(y + i.range)) AS INTEGER) AS ny, CAST((w - 1) - abs((w - 1) - abs(x + j.range)) AS INTEGER) AS nx FROM ab, range(-1, 2) i, range(-1, 2) j) c JOIN ab b ON b.frame = c.frame AND b.y = ny AND b.x = nx GROUP BY 1, 2, 3) SELECT frame, y, x, CAST(s AS BIGINT) AS v FROM n")
def local_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine times the 3 x 3 mean of the distances from mid grey."""
    from ..operators import stencils

    frames = embedding_frames(spark, sf_dir).withColumn("row", F.expr("transform(row, v -> v - 128)"))
    return pixels(stencils.local_energy(frames)).withColumn("v", F.round(F.col("v") * 9).cast("long"))


@query("SELECT e.event_id, c.revision IS NOT NULL AS hit FROM (SELECT event_id, user_id AS image_id, event_id % 3 AS revision FROM events) e LEFT JOIN (SELECT DISTINCT user_id AS image_id, event_id % 3 AS revision FROM events WHERE event_id % 10 = 0) c USING (image_id, revision)")
def analysis_memo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests whose (image, revision) was analysed before."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("image_id"), (F.col("event_id") % 3).alias("revision"))
    return projects.memo(e, e.where("event_id % 10 = 0"), ["image_id", "revision"]).select("event_id", "hit")


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 2 = 0 THEN p_size + 1.0 ELSE 2.0 END AS m0 FROM part")
def colour_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = "CASE WHEN p_partkey % 5 = 0 THEN array(1D, 1D, 1D, 1D, 1D, 1D, 0D, 0D, 1D) WHEN p_partkey % 2 = 0 THEN array(p_size + 1D, 0D, 0D, 0D, 1D, 0D, 0D, 0D, 1D) END"
    p = table(spark, sf_dir, "part").select("p_partkey", F.expr(tag).alias("tag"), F.expr("array(2D, 0D, 0D, 0D, 1D, 0D, 0D, 0D, 1D)").alias("given"))
    return p.select("p_partkey", projects.colour_matrix().getItem(0).alias("m0"))


@query("SELECT user_id AS job_id FROM events GROUP BY 1 HAVING arg_max(event_type, event_id) = 'view'")
def pending_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The jobs of a status, as lists show them."""
    from ..operators.catalog import latest_jobs

    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_type").alias("status"), F.col("event_id").alias("seq"))
    return latest_jobs(e).where("status = 'view'").select("job_id")


@query("SELECT s_suppkey AS link, s_acctbal / 10000.0::DOUBLE AS correlation FROM supplier WHERE s_acctbal / 10000.0::DOUBLE < 0.9")
def low_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links below the correlation that reviews ask for."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("link"), F.expr("cast(s_acctbal AS double) / 10000D").alias("correlation")).where("correlation < 0.9")
