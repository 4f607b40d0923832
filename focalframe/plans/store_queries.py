"""Frames written and read as files, and stores that are brought up to date in place, all made from the embedding raster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retouch
from ..raster import embedding_frames, pixels, rows, table
from ..sources import frames as files
from ..sources.store import AlignedCache, DocumentStore, RetouchImages, TileStore, fresh_path
from .raster_queries import MASKS, RASTER, _strokes
from .registry import query
from .warp_queries import SIM, transforms


def rgb_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, y, r, g, b, height): a frame's rows, their mirror images and their negatives as channels."""
    negative = F.transform("row", lambda v: 255 - v)
    return embedding_frames(spark, sf_dir).select("frame", "y", F.col("row").alias("r"), F.reverse("row").alias("g"), negative.alias("b"), "height")


RGB = RASTER + ", c AS (SELECT a.frame, a.y, a.x, a.v AS r, m.v AS g, 255 - a.v AS b FROM px a JOIN dim USING (frame) JOIN px m ON m.frame = a.frame AND m.y = a.y AND m.x = w - 1 - a.x)"


def _flat(rgb: DataFrame) -> DataFrame:
    return rgb.select("frame", "y", F.posexplode(F.arrays_zip(*"rgb")).alias("x", "p")).select("frame", "y", "x", *(F.col(f"p.{c}").alias(c) for c in "rgb"))


@query(RGB + " SELECT frame, y, x, r, g, b FROM c")
def frame_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All frames exported as TIFF files and read again."""
    folder = fresh_path(spark, "frames")
    files.export_frames(rgb_frames(spark, sf_dir), folder, bits=8)
    return _flat(files.read_stack(spark, folder, band=64))


@query(RASTER + " SELECT px.frame, y, x, CAST(v / 255.0 AS FLOAT)::DOUBLE - 0.5 AS v FROM px")
def frame_files_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unclamped floats: values under 0 come back as they were."""
    folder = fresh_path(spark, "floats")
    values = F.transform("row", lambda v: (v / 255.0).cast("float").cast("double"))
    files.export_frames(embedding_frames(spark, sf_dir).select("frame", "y", *(values.alias(c) for c in "rgb"), "height"), folder, bits=32)
    back = files.read_stack(spark, folder, samples="floats")
    return back.select("frame", "y", F.posexplode("r").alias("x", "v")).withColumn("v", F.col("v") - 0.5)


@query(RGB + " SELECT frame, y, x, r, g, b FROM c WHERE frame >= 2 AND frame < 7 AND y >= 5 AND y < 30 AND x >= 10 AND x < 50")
def frame_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region of some frames of a stack of files: files, rows and strips outside it are not read. The region is the feature; the export is of all frames."""
    folder = fresh_path(spark, "region")
    files.export_frames(rgb_frames(spark, sf_dir), folder, bits=8)
    return _flat(files.read_stack(spark, folder).where("frame >= 2 AND frame < 7 AND y >= 5 AND y < 30")).where("x >= 10 AND x < 50")


#: Frames brighter than the mean of all frames are changed between two runs of the cache.
CHANGED = """, mean AS (SELECT frame, sum(v) AS s, count(*) AS n FROM px GROUP BY frame), ch AS (SELECT frame, s / n > (SELECT sum(s) / sum(n) FROM mean) AS changed FROM mean)"""


@query(RASTER + SIM + CHANGED + """ SELECT pt.frame, pt.y, pt.x, CAST(CASE WHEN changed THEN least(255, px.v + 1) ELSE px.v END AS DOUBLE) AS v, (CASE WHEN floor(sy) BETWEEN 0 AND h - 1 THEN 1 - (sy - floor(sy)) ELSE 0 END + CASE WHEN floor(sy) + 1 BETWEEN 0 AND h - 1 THEN sy - floor(sy) ELSE 0 END)
  * (CASE WHEN floor(sx) BETWEEN 0 AND w - 1 THEN 1 - (sx - floor(sx)) ELSE 0 END + CASE WHEN floor(sx) + 1 BETWEEN 0 AND w - 1 THEN sx - floor(sx) ELSE 0 END) > 0.999 AS valid, CASE WHEN changed THEN 'rewritten' ELSE 'kept' END AS verdict
FROM pt JOIN ch USING (frame) JOIN px ON px.frame = pt.frame AND px.y = greatest(0, least(h - 1, round_even(sy, 0))) AND px.x = greatest(0, least(w - 1, round_even(sx, 0)))""")
def aligned_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache after a second run, before which some frames have changed: their rows are new, those of the others are from the first run."""
    frames = embedding_frames(spark, sf_dir)
    path = fresh_path(spark, "aligned")
    AlignedCache(spark, path, source_hash="raster").refresh(frames, transforms(spark), "nearest")
    sums = frames.select("frame", F.expr("aggregate(row, 0L, (s, v) -> s + v)").alias("s"), F.size("row").alias("n"))
    means = sums.groupBy("frame").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    overall = means.agg((F.sum("s") / F.sum("n")).alias("mean")).first()["mean"]
    bright = means.select("frame", (F.col("s") / F.col("n") > F.lit(overall)).alias("changed"))
    lifted = frames.join(F.broadcast(bright), "frame").withColumn("row", F.expr("CASE WHEN changed THEN transform(row, v -> least(255L, v + 1)) ELSE row END")).drop("changed")
    cache = AlignedCache(spark, path, source_hash="raster")
    verdicts = cache.refresh(lifted, transforms(spark), "nearest")
    flat = cache.read().join(F.broadcast(verdicts), "frame").select("frame", "y", "verdict", F.posexplode(F.arrays_zip(F.col("row").alias("v"), F.col("valid").alias("valid"))).alias("x", "p"))
    return flat.select("frame", "y", "x", "p.v", "p.valid", "verdict")


#: The mean frame at every viewer level, by triangles as wide as two output samples; ``i`` 0 is the image, ``i`` 1 the image with 1000 added in the boxes.
LEVELS = """, im AS (SELECT y, x, sum(v)::DOUBLE AS v FROM px GROUP BY 1, 2), bx AS (SELECT r_regionkey AS id, r_regionkey * 9 AS y0, r_regionkey * 12 AS x0, r_regionkey * 9 + 3 AS y1, r_regionkey * 12 + 3 AS x1 FROM region
), ims AS (SELECT 0 AS i, y, x, v FROM im UNION ALL SELECT 1, y, x, v + CASE WHEN EXISTS (SELECT 1 FROM bx WHERE y >= y0 AND y < y1 AND x >= x0 AND x < x1) THEN 1000 ELSE 0 END FROM im
), sz AS (SELECT max(y) + 1 AS h, 64 AS w FROM im), nl AS (SELECT h, w, CAST(greatest(1, ceil(log2(greatest(1.0, greatest(h, w) / 16.0))) + 1) AS INTEGER) AS n FROM sz
), lv AS (SELECT z, h, w, (1 << (n - 1 - z)) AS s, greatest(1, h // (1 << (n - 1 - z))) AS lh, greatest(1, w // (1 << (n - 1 - z))) AS lw FROM (SELECT *, unnest(range(n)) AS z FROM nl)
), wy AS (SELECT z, oy, iy, wt / sum(wt) OVER (PARTITION BY z, oy) AS wt FROM (SELECT z, oy, iy, greatest(0.0, 1 - abs(iy + 0.5 - (oy + 0.5) * (h / lh::DOUBLE)) / greatest(h / lh::DOUBLE, 1.0)) AS wt FROM (SELECT *, unnest(range(h)) AS iy FROM (SELECT *, unnest(range(lh)) AS oy FROM lv))) WHERE wt > 0
), wx AS (SELECT z, ox, ix, wt / sum(wt) OVER (PARTITION BY z, ox) AS wt FROM (SELECT z, ox, ix, greatest(0.0, 1 - abs(ix + 0.5 - (ox + 0.5) * (w / lw::DOUBLE)) / greatest(w / lw::DOUBLE, 1.0)) AS wt FROM (SELECT *, unnest(range(w)) AS ix FROM (SELECT *, unnest(range(lw)) AS ox FROM lv))) WHERE wt > 0
), half AS (SELECT i, z, oy, x, sum(wt * v) AS v FROM wy JOIN ims ON ims.y = iy GROUP BY ALL
), lev AS (SELECT i, z, oy, ox, sum(wt * v) AS v FROM half JOIN wx USING (z) WHERE wx.ix = half.x GROUP BY ALL
), tl AS (SELECT i, CAST(z AS INTEGER) AS z, CAST(oy // 16 AS INTEGER) AS ty, CAST(ox // 16 AS INTEGER) AS tx, CAST(oy % 16 AS INTEGER) AS dy, CAST(ox % 16 AS INTEGER) AS dx, round(v, 4) AS v FROM lev)"""


def _mean_frame(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """(y, x, v) of the sum of all frames, and its height."""
    frames = embedding_frames(spark, sf_dir)
    return pixels(frames).groupBy("y", "x").agg(F.sum("v").alias("v")), frames.agg(F.max("height")).first()[0] or 1


def _image(flat: DataFrame) -> DataFrame:
    return rows(flat.withColumn("frame", F.lit(0))).select("y", "row")


@query(RASTER + LEVELS + " SELECT z, ty, tx, dy, dx, v FROM tl WHERE i = 0")
def viewer_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tiles of the mean frame, 16 pixels a side."""
    flat, height = _mean_frame(spark, sf_dir)
    out = retouch.tile_rows(_image(flat), height, 64, 16)
    return out.select("z", "ty", "tx", F.col("dy").cast("int").alias("dy"), F.posexplode("row").alias("dx", "v")).withColumn("v", F.round("v", 4))


@query(RASTER + LEVELS + " , hit AS (SELECT DISTINCT z, ty, tx FROM tl t JOIN lv USING (z) JOIN bx ON ty BETWEEN y0 // s // 16 AND (y1 - 1) // s // 16 AND tx BETWEEN x0 // s // 16 AND (x1 - 1) // s // 16) SELECT z, ty, tx, dy, dx, v, i = 1 AS renewed FROM tl LEFT JOIN (SELECT *, 1 AS is_hit FROM hit) USING (z, ty, tx) WHERE i = coalesce(is_hit, 0)")
def tile_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored tiles of the mean frame after boxes of it have changed: the tiles that the boxes touch are new, the others as they were."""
    flat, height = _mean_frame(spark, sf_dir)
    boxes = table(spark, sf_dir, "region").selectExpr("r_regionkey AS id", "r_regionkey * 9 AS y0", "r_regionkey * 12 AS x0", "r_regionkey * 9 + 3 AS y1", "r_regionkey * 12 + 3 AS x1")
    spots = boxes.selectExpr("explode(sequence(y0, y1 - 1)) AS y", "x0", "x1").selectExpr("y", "explode(sequence(x0, x1 - 1)) AS x", "1000 AS more").distinct()
    changed = flat.join(F.broadcast(spots), ["y", "x"], "left").select("y", "x", (F.col("v") + F.coalesce("more", F.lit(0))).alias("v"))
    store = TileStore(spark, fresh_path(spark, "tiles"), height, 64, 16)
    store.build(_image(flat))
    dirty = store.update(_image(changed), boxes)
    marked = store.read().join(F.broadcast(dirty.withColumn("renewed", F.lit(True))), ["z", "ty", "tx"], "left")
    return marked.select("z", "ty", "tx", "dy", F.coalesce("renewed", F.lit(False)).alias("renewed"), F.posexplode("row").alias("dx", "v")).withColumn("v", F.round("v", 4))


#: The strokes folded one after another over frame 0; {when} names those that take part.
REPLAY = RASTER.replace("WITH px", "WITH RECURSIVE px") + MASKS.replace("\nWITH st", ", st") + """, t AS (
  SELECT m.py AS y, m.px AS x, row_number() OVER (PARTITION BY m.py, m.px ORDER BY m.seq) AS k, m.mask * st.opacity AS a, CASE WHEN st.mode = 'erase' THEN b.v ELSE s.v END AS s, b.v AS v
  FROM mask m JOIN st USING (seq) JOIN px b ON b.frame = 0 AND b.y = m.py AND b.x = m.px LEFT JOIN px s ON s.frame = st.source AND s.y = m.py AND s.x = m.px WHERE {when}
), fold AS (
  SELECT y, x, k, v * (1 - a) + coalesce(s, v) * a AS v FROM t WHERE k = 1 UNION ALL
  SELECT t.y, t.x, t.k, f.v * (1 - t.a) + coalesce(t.s, t.v) * t.a FROM fold f JOIN t ON t.y = f.y AND t.x = f.x AND t.k = f.k + 1
), last AS (SELECT y, x, arg_max(v, k) AS v FROM fold GROUP BY 1, 2), im AS (SELECT px.y, px.x, coalesce(last.v, px.v) AS v FROM px LEFT JOIN last ON last.y = px.y AND last.x = px.x WHERE px.frame = 0)"""


def _session(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(base, strokes, sources) of a session whose strokes are the suppliers', and how many strokes it has."""
    flat = pixels(embedding_frames(spark, sf_dir))
    base = flat.where("frame = 0").select("y", "x", F.col("v").cast("double").alias("v"))
    sources = flat.where("frame > 0").select(F.col("frame").alias("source"), "y", "x", F.col("v").cast("double").alias("s"))
    strokes = _strokes(spark, sf_dir).withColumn("position", F.col("seq") + 1)
    return base, strokes, sources, strokes.agg(F.max("position")).first()[0]


@query(REPLAY.format(when="m.seq < (SELECT max(seq) FROM st)") + " SELECT y, x, round(v, 6) AS v, CAST((SELECT max(seq) FROM st) % 20 AS BIGINT) AS replayed FROM im")
def retouch_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The image after all strokes but the last, as an undo shows it: from the latest stored checkpoint and the strokes after it."""
    base, strokes, sources, last = _session(spark, sf_dir)
    store = RetouchImages(spark, fresh_path(spark, "retouch"), 50, 64)
    store.save(base, strokes, sources)
    store.forget_after(last - 1)
    image, replayed = store.after(base, strokes, sources, last - 1)
    return image.select("y", "x", F.round("v", 6).alias("v"), F.lit(replayed).cast("long").alias("replayed"))


@query(REPLAY.format(when="TRUE") + " SELECT substr(sha256('session'), 1, 12) AS image_id, 'result' AS kind, 'retouch' AS method, y, x, CAST(floor(greatest(0.0, least(1.0, v / 255.0::DOUBLE)) * 65535 + 0.5) AS BIGINT) AS code FROM im")
def flatten_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session flattened to a new result: its last image as a 16-bit file, read again, with the result's record."""
    base, strokes, sources, last = _session(spark, sf_dir)
    store, folder = RetouchImages(spark, fresh_path(spark, "retouch"), 50, 64), fresh_path(spark, "flattened")
    store.save(base, strokes, sources)
    image, _ = store.after(base, strokes, sources, last)
    record = store.flatten(image, folder, "session", "retouched")
    back = files.read_stack(spark, record["path"].rsplit("/", 1)[0])
    return back.select(*(F.lit(record[c]).alias(c) for c in ("image_id", "kind", "method")), "y", F.posexplode("r").alias("x", "code"))


PARTS = "WITH c AS (SELECT p_brand, sum(p_retailprice) > (SELECT sum(p_retailprice) / count(DISTINCT p_brand) FROM part) AS dear FROM part GROUP BY 1)"


@query(PARTS + " SELECT p_brand AS project_id, CASE WHEN dear THEN 'Renamed ' ELSE 'Project ' END || p_brand AS name, count(*) AS frames, count(*) FILTER (p_partkey % 3 = 0) AS results FROM part JOIN c USING (p_brand) GROUP BY p_brand, dear")
def project_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects kept as documents, of which those with the dearer parts are renamed and saved again."""
    p = table(spark, sf_dir, "part")
    images = F.collect_list(F.when(F.col("p_partkey") % 3 == 0, F.struct(F.col("p_partkey").alias("image_id"), F.lit("result").alias("kind"))))
    made = p.groupBy(F.col("p_brand").alias("project_id")).agg(F.collect_list("p_partkey").alias("frames"), images.alias("images"), F.sum("p_retailprice").alias("price"))
    store = DocumentStore(spark, fresh_path(spark, "projects"), "project_id", "name string, frames array<bigint>, images array<struct<image_id:bigint,kind:string>>", ("name", "frames"))
    store.save(made.withColumn("name", F.concat(F.lit("Project "), "project_id")).drop("price"))
    mean = made.agg(F.avg("price")).first()[0]
    store.save(made.where(F.col("price") > F.lit(mean)).withColumn("name", F.concat(F.lit("Renamed "), "project_id")).drop("price"))
    return store.load().select("project_id", "name", F.size("frames").cast("long").alias("frames"), F.size("images").cast("long").alias("results"))


@query(PARTS + " SELECT p_brand, p_name AS name, CAST(p_size AS INTEGER) AS radius FROM part JOIN c USING (p_brand) WHERE NOT dear")
def preset_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presets kept as one document for each brand, after those of the dearer brands were deleted."""
    p = table(spark, sf_dir, "part")
    made = p.groupBy("p_brand").agg(F.collect_list(F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("radius"))).alias("presets"), F.sum("p_retailprice").alias("price"))
    store = DocumentStore(spark, fresh_path(spark, "presets"), "p_brand", "presets array<struct<name:string,radius:int>>")
    store.save(made.drop("price"))
    mean = made.agg(F.avg("price")).first()[0]
    store.delete(made.where(F.col("price") > F.lit(mean)).select("p_brand"))
    return store.load().select("p_brand", F.explode("presets").alias("p")).select("p_brand", "p.name", "p.radius")
