"""Frame lists, capture-time groups, stack validation, digests, jobs, projects, names and errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordinal import numbered

#: Extensions of frames, raw and rendered.
RENDERED = ("jpeg", "jpg", "png", "tif", "tiff")
RAW = ("3fr", "arw", "cr2", "cr3", "crw", "dcr", "dng", "erf", "fff", "iiq", "kdc", "mef", "mos", "mrw", "nef", "nrw", "orf", "pef", "raf", "raw", "rw2", "srw", "x3f")
#: Error classes with their codes and HTTP statuses; the first class that fits an error counts.
ERRORS = (
    ("DiskSpaceError", "insufficient_disk_space", 507),
    ("DngExportError", "dng_export_failed", 422),
    ("RawDecodeError", "raw_decode_failed", 422),
    ("AlignmentError", "alignment_failed", 422),
    ("ValidationError", "validation_failed", 422),
    ("BackendError", "backend_failed", 503),
    ("EngineError", "engine_failed", 500),
    ("ValueError", "invalid_request", 400),
    ("OSError", "io_failed", 500),
)


def scan(paths: DataFrame, path: str = "path") -> DataFrame:
    """Rows whose path has a known extension."""
    return paths.where(F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*RENDERED, *RAW))


def trailing_number(name: str = "name") -> Column:
    """The digits right before the extension; null without any."""
    return F.expr(rf"cast(nullif(regexp_extract({name}, '([0-9]+)\\.[^.]+$', 1), '') AS bigint)")


def capture_time(text: str = "captured") -> Column:
    """EXIF or ISO times; null for anything else."""
    forms = (f"try_to_timestamp({text}, 'yyyy:MM:dd HH:mm:ss')", f"try_to_timestamp({text}, 'yyyy:MM:dd HH:mm:ss.SSS')", f"try_cast({text} AS timestamp)")
    return F.expr(f"coalesce({', '.join(forms)})")


def auto_group(frames: DataFrame, by: list[str], order: list[str], time: str | None, number: str | None, max_seconds: float = 10.0, max_gap: int = 3) -> DataFrame:
    """``frames`` with ``grp`` (from 0): a new group begins after a pause of more than ``max_seconds``; where one of two neighbours has
    no time, after a step of more than ``max_gap`` in number (steps back never split)."""
    w = Window.partitionBy(*by).orderBy(*order)
    t = F.unix_micros(F.col(time).cast("timestamp")) if time else F.lit(None).cast("long")
    n = F.col(number) if number else F.lit(None).cast("long")
    timed = frames.withColumns({"__t": t, "__n": n}).withColumns({"__t0": F.lag("__t").over(w), "__n0": F.lag("__n").over(w)})
    both = F.col("__t").isNotNull() & F.col("__t0").isNotNull()
    split = F.when(both, F.abs(F.col("__t") - F.col("__t0")) > max_seconds * 1e6).otherwise(F.coalesce(F.col("__n") - F.col("__n0") > max_gap, F.lit(False)))
    return timed.withColumn("__s", split.cast("int")).withColumn("grp", F.sum("__s").over(w)).drop("__t", "__n", "__t0", "__n0", "__s")


def validate_stack(frames: DataFrame, by: list[str]) -> DataFrame:
    """``frames(ordinal, ext, readable, channels, domain, width, height, bit_depth, camera, sensor, cfa, black, missing)`` with ``status``.

    The first readable frame of a list is the reference; the first rule that a frame breaks names its status. Raw frames are held against the
    reference's camera, sensor mode, colour filter array and calibration, others against its size and depth.
    """
    usable = F.col("readable") & (F.col("channels") == 3) & F.col("ext").isin(*RENDERED, *RAW)
    parts = ("domain", "width", "height", "bit_depth", "camera", "sensor", "cfa", "black")
    first = frames.where(usable).groupBy(*by).agg(F.min_by(F.struct(*parts), "ordinal").alias("ref"))
    known = frames.join(first, by, "left")
    raw = F.col("domain") == "scene_linear_camera_rgb"

    def other(name: str) -> Column:
        return ~F.col(name).eqNullSafe(F.col(f"ref.{name}"))

    status = (
        F.when(~F.col("ext").isin(*RENDERED, *RAW), "unsupported")
        .when(~F.col("readable"), F.when(F.col("ext").isin(*RAW), "raw_decode_error").otherwise("unreadable"))
        .when(F.col("channels") != 3, "not_rgb")
        .when(raw & (F.size("missing") > 0), "missing_raw_calibration")
        .when(other("domain"), "mixed_domain")
        .when(raw & other("camera"), "incompatible_camera")
        .when(raw & other("sensor"), "incompatible_sensor_mode")
        .when(raw & other("cfa"), "incompatible_cfa")
        .when(raw & other("black"), "incompatible_raw_calibration")
        .when(~raw & (other("width") | other("height")), "wrong_size")
        .when(~raw & other("bit_depth"), "wrong_bit_depth")
        .otherwise("ok")
    )
    return known.withColumn("status", status).drop("ref")


def source_digest(files: DataFrame, by: list[str], name: str = "name", digest: str = "digest") -> DataFrame:
    """One SHA-256 per list over name and content digest of its files, in order."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", name, digest))), lambda p: F.concat(p[name], p[digest]))
    return files.groupBy(*by).agg(F.sha2(F.array_join(parts, ""), 256).alias("source_digest"), F.count("*").alias("files"))


def add_frames(have: DataFrame, new: DataFrame) -> DataFrame:
    """(path, ordinal): the new paths that are not there yet go to the end, in order, each once."""
    once = new.groupBy("path").agg(F.min("ordinal").alias("o")).join(have.select("path"), "path", "left_anti")
    tail = have.agg(F.coalesce(F.max("ordinal") + 1, F.lit(0))).first()[0]
    placed = numbered(once, "o", "path", name="k").select("path", (F.col("k") + tail).alias("ordinal"))
    return have.select("path", "ordinal").unionByName(placed)


def remove_frames(have: DataFrame, drop: DataFrame) -> DataFrame:
    return have.join(drop.select("path").distinct(), "path", "left_anti")


def reindex(frames: DataFrame, kept: DataFrame) -> DataFrame:
    """(frame, position): the kept frames numbered from 0."""
    return numbered(frames.select("frame").distinct().join(kept, "frame", "left_semi"), "frame")


def first_names(names: DataFrame, most: int = 8) -> DataFrame:
    """(label): the first names in order, and how many more there are."""
    listed = names.orderBy("ordinal", "name").limit(most).agg(F.array_sort(F.collect_list(F.struct("ordinal", "name"))).alias("a"))
    more = names.agg((F.count("*") - most).alias("more"))
    shown = F.array_join(F.transform("a", lambda p: p["name"]), ", ")
    return listed.crossJoin(F.broadcast(more)).select(F.concat(shown, F.when(F.col("more") > 0, F.concat(F.lit(" (+"), F.col("more").cast("string"), F.lit(" more)"))).otherwise("")).alias("label"))


def latest_jobs(events: DataFrame) -> DataFrame:
    """(job_id, status, seq, n): the last event of each job."""
    return events.groupBy("job_id").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"), F.count("*").alias("n"))


def job_order(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(job_id, position): of ``jobs(job_id, status, seq)`` first the job in front, then the pending ones that the user has ordered (``wanted(job_id, wanted)``), then the rest as they came.

    The job in front is the first that is not among those; a wanted job that is not pending stays where it is.
    """
    marked = jobs.join(wanted, "job_id", "left").withColumn("moved", (F.col("status") == "pending") & F.col("wanted").isNotNull())
    front = marked.where("NOT moved").agg(F.min("seq")).first()[0]
    rank = F.when(F.col("moved"), 1).when(F.col("seq").eqNullSafe(F.lit(front)), 0).otherwise(2)
    return numbered(marked.select("job_id", rank.alias("rank"), F.when(F.col("moved"), F.col("wanted")).otherwise(F.col("seq")).alias("key")), "rank", "key", "job_id").select("job_id", "position")


def export_name(template: str, **values: Column) -> Column:
    """A template's tokens filled in (unknown ones stay), characters that file systems forbid replaced by underscores."""
    out = F.lit(template)
    for token, value in values.items():
        out = F.replace(out, F.lit("{" + token + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return F.regexp_replace(out, r'[\\/:*?"<>|]', "_")


def sequence_number(order: list[str], by: list[str] | None = None) -> Column:
    """1-based, three digits at least."""
    n = F.row_number().over(Window.partitionBy(*(by or [])).orderBy(*order)).cast("string")
    return F.when(F.length(n) < 3, F.lpad(n, 3, "0")).otherwise(n)


def companion(images: DataFrame, results: DataFrame) -> DataFrame:
    """(image_id, depth_id): the first depth image of each result; a result without one has null."""
    depth = images.where("kind = 'depth'").groupBy("parent").agg(F.min("image_id").alias("depth_id"))
    return results.select("image_id").join(depth, F.col("parent") == F.col("image_id"), "left").select("image_id", "depth_id")


def error_code(name: str = "error") -> tuple[Column, Column]:
    """(code, status) of an error class."""
    code, status = F.lit("internal_error"), F.lit(500)
    for cls, c, s in reversed(ERRORS):
        code, status = F.when(F.col(name) == cls, c).otherwise(code), F.when(F.col(name) == cls, s).otherwise(status)
    return code, status
