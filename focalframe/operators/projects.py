"""Frame lists, metadata, planning, projects, sessions and job states as DataFrame operators."""

from __future__ import annotations

from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .catalog import RAW, RENDERED

#: Parts of metadata keys that hold for one exposure only.
SINGLE_EXPOSURE = ("focusdistance", "subjectdistance", "depthoffield")
#: XMP namespaces by prefix.
XMP = {"dc": "http://purl.org/dc/elements/1.1/", "aux": "http://ns.adobe.com/exif/1.0/aux/", "xmp": "http://ns.adobe.com/xap/1.0/", "tiff": "http://ns.adobe.com/tiff/1.0/", "exif": "http://ns.adobe.com/exif/1.0/"}
#: Keys that hold a capture time, best first.
TIME_KEYS = ("Exif.Photo.DateTimeOriginal", "Exif.Image.DateTime", "Exif.Photo.DateTimeDigitized")
#: Planning throughput in megapixels a second, methods' factors, seconds a frame for alignment.
THROUGHPUT = {"cuda": 80.0, "mps": 28.0, "cpu": 4.0}
FACTORS = {"pmax": 1.0, "weighted": 0.7, "dmap": 1.35, "slab": 1.6}
ALIGN_SECONDS = 0.12


def extension(path: str = "path") -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def expand(raw: DataFrame, files: DataFrame) -> DataFrame:
    """(path, ordinal): frames of ``raw(ordinal, path)``, where a folder stands for its frames in ``files(folder, path)``.

    Each path is kept once, where it first occurs; other files are left out. Order: ordinal of the entry, then path.
    """
    known = files.where(extension("path").isin(*RENDERED, *RAW))
    listed = raw.alias("r").join(known.alias("f"), F.col("r.path") == F.col("f.folder")).select(F.col("f.path").alias("path"), F.col("r.ordinal").alias("ordinal"))
    single = raw.alias("r").join(known.alias("f"), F.col("r.path") == F.col("f.path")).select(F.col("f.path").alias("path"), F.col("r.ordinal").alias("ordinal"))
    return listed.unionByName(single).groupBy("path").agg(F.min("ordinal").alias("ordinal"))


def listing(entries: DataFrame, by: list[str]) -> DataFrame:
    """``entries(name, is_dir)`` of each folder with ``position`` (folders first, then by name without case) and the folder's ``image_count`` (rendered files)."""
    order = Window.partitionBy(*by).orderBy(~F.col("is_dir"), F.lower("name"), "name")
    counts = entries.groupBy(*by).agg(F.count_if(~F.col("is_dir") & extension("name").isin(*RENDERED)).alias("image_count"))
    return entries.withColumn("position", F.row_number().over(order) - 1).join(counts, by)


def path_order(frames: DataFrame, by: list[str]) -> DataFrame:
    """``frames`` with ``ordinal``: their place in the order of path within each list."""
    return frames.withColumn("ordinal", F.row_number().over(Window.partitionBy(*by).orderBy("path")) - 1)


def oriented_size(width: str, height: str, orientation: str) -> tuple[Column, Column]:
    """Width and height as shown: orientations 5 to 8 swap them."""
    turned = F.col(orientation).between(5, 8)
    return F.when(turned, F.col(height)).otherwise(F.col(width)), F.when(turned, F.col(width)).otherwise(F.col(height))


def upright(pixels: DataFrame, orientation: str = "orientation") -> DataFrame:
    """``pixels(y, x, height, width, orientation)`` moved to where they are in the upright image; unknown orientations are left alone."""
    o, down, right = F.col(orientation), F.expr("height - 1 - y"), F.expr("width - 1 - x")
    y = F.when(o.isin(3, 4), down).when(o.isin(5, 6), F.col("x")).when(o.isin(7, 8), right).otherwise(F.col("y"))
    x = F.when(o.isin(2, 3), right).when(o.isin(5, 8), F.col("y")).when(o.isin(6, 7), down).otherwise(F.col("x"))
    return pixels.withColumns({"y": y, "x": x})


def crop(pixels: DataFrame, y0: int, x0: int, y1: int, x1: int) -> DataFrame:
    """The half-open region; coordinates stay."""
    return pixels.where((F.col("y") >= y0) & (F.col("y") < y1) & (F.col("x") >= x0) & (F.col("x") < x1))


def capture_time_of(exif: str = "exif") -> Column:
    """The first capture time in a map that is not empty."""
    return F.coalesce(*(F.nullif(F.col(exif)[key], F.lit("")) for key in TIME_KEYS))


def without_single_exposure(keys: str) -> Column:
    """A metadata map without what holds for one exposure only."""
    plain = lambda k: F.lower(F.replace(k, F.lit("_"), F.lit("")))
    return F.map_filter(keys, lambda k, _: ~plain(k).rlike("|".join(SINGLE_EXPOSURE)))


def xmp_map(packet: str = "packet", namespaces: dict[str, str] = XMP) -> Column:
    """``Xmp.<prefix>.<name>`` to value, of the attributes and element texts of an XMP packet (a string) that belong to known ``namespaces``, whatever prefixes the packet gives them.

    Of several values of a name the last in the document counts, an element's text after its attributes. Null, empty and malformed packets give an empty map.
    SQL's XML functions neither resolve prefixes nor tell names, so a parser reads each packet.
    """
    prefixes = {uri: prefix for prefix, uri in namespaces.items()}

    @F.arrow_udf("map<string,string>")
    def read(packets: pa.Array) -> pa.Array:
        found = []
        for packet in packets.to_pylist():
            values: dict[str, str] = {}

            def say(name: str, value: str) -> None:
                uri, _, local = name[1:].partition("}")
                if name[:1] == "{" and uri in prefixes:
                    values[f"Xmp.{prefixes[uri]}.{local}"] = value

            try:
                for element in ElementTree.fromstring(packet).iter() if packet else ():
                    for name, value in element.attrib.items():
                        say(name, value)
                    if element.text and element.text.strip():
                        say(element.tag, element.text.strip())
            except ElementTree.ParseError:
                values.clear()
            found.append(list(values.items()))
        return pa.array(found, pa.map_(pa.string(), pa.string()))

    return read(F.col(packet))


#: The namespaces that wrap an XMP packet, and the entities of signs in attributes.
WRAPPERS = {"x": "adobe:ns:meta/", "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#"}
ENTITIES = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "\r": "&#13;", "\n": "&#10;", "\t": "&#09;"}


def xmp_packet(values: str = "xmp", namespaces: dict[str, str] = XMP) -> Column:
    """An XMP packet of a map ``Xmp.<prefix>.<name>`` to value: an attribute for each known name, sorted by name; null for a null or empty map. ``xmp_map`` reads it back."""

    def prefix(e: Column) -> Column:
        return F.get(F.split(e["key"], "[.]"), F.lit(1))

    def attribute(e: Column) -> Column:
        shown = e["value"]
        for sign, entity in ENTITIES.items():
            shown = F.replace(shown, F.lit(sign), F.lit(entity))
        name = F.substring(e["key"], F.lit(6) + F.length(prefix(e)), F.length(e["key"]))
        return F.concat(F.lit(" "), prefix(e), F.lit(":"), name, F.lit('="'), shown, F.lit('"'))

    named = F.filter(F.map_entries(values), lambda e: e["key"].rlike(r"^Xmp\.[^.]+\..") & prefix(e).isin(*namespaces) & e["value"].isNotNull())
    attributes = F.array_join(F.transform(F.array_sort(named), attribute), "")
    declared = "".join(f' xmlns:{p}="{uri}"' for p, uri in {**WRAPPERS, **namespaces}.items())
    return F.when(F.size(values) > 0, F.concat(F.lit(f"<x:xmpmeta{declared}><rdf:RDF><rdf:Description"), attributes, F.lit("/></rdf:RDF></x:xmpmeta>")))


def merged_metadata(files: DataFrame) -> DataFrame:
    """``files(exif, portable_exif, packet, portable_xmp, ...)`` with the maps merged (what the portable reader says wins) as exif and xmp, and the fields that are read from them.

    exif, portable_exif and portable_xmp are maps of names to strings, any may be null; ``packet`` is the XMP packet. Added: make, model, lens, captured, orientation (1:
    pixels are upright) and source_orientation (that of the file, 1 where there is none).
    """
    none = F.create_map().cast("map<string,string>")

    def over(low: str, high: str) -> Column:
        """The entries of both maps; those of ``high`` count."""
        return F.map_concat(F.map_filter(low, lambda k, _: ~F.map_contains_key(high, k)), F.col(high))

    known = files.withColumns({c: F.coalesce(c, none) for c in ("exif", "portable_exif", "portable_xmp")}).withColumn("xmp", xmp_map("packet"))
    known = known.withColumns({"exif": over("exif", "portable_exif"), "xmp": over("xmp", "portable_xmp")})
    said = lambda *keys: F.coalesce(*(F.nullif(F.col("exif")[k], F.lit("")) for k in keys))
    fields = {
        "make": said("Exif.Image.Make"), "model": said("Exif.Image.Model"), "lens": said("Exif.Photo.LensModel"), "captured": said("Exif.Photo.DateTimeOriginal", "Exif.Image.DateTime"),
        "orientation": F.lit(1), "source_orientation": F.coalesce(F.nullif(said("Exif.Image.Orientation").try_cast("int"), F.lit(0)), F.lit(1)),
    }
    return known.withColumns(fields).drop("portable_exif", "portable_xmp", "packet")


def as_shot_neutral(tag: str = "tag", wb: str = "wb") -> Column:
    """The neutral a file names, else the reciprocals of its white balance over that of green; null unless all three are positive."""
    fit = f"size({wb}) >= 3 AND forall(slice({wb}, 1, 3), v -> v > 0 AND NOT isnan(v) AND v < double('infinity'))"
    return F.expr(f"CASE WHEN size({tag}) = 3 THEN {tag} WHEN {fit} THEN transform(slice({wb}, 1, 3), v -> (1D / v) / (1D / {wb}[1])) END")


def colour_matrix(tag: str = "tag", given: str = "given") -> Column:
    """The colour matrix a file names, else the decoder's; null for a singular one."""
    m = f"CASE WHEN size({tag}) = 9 THEN {tag} WHEN size({given}) = 9 THEN {given} END"
    det = "(m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6]))"
    return F.expr(f"transform(array({m}), m -> CASE WHEN abs({det}) > 1e-12 THEN m END)[0]")


def proxy_stretch(pixels: DataFrame, by: list[str], value: str = "v", low: float = 0.005, high: float = 0.995) -> DataFrame:
    """``pixels`` with ``proxy``: values between the two percentiles of their frame to [0, 1], clipped; 0 in a flat frame."""
    span = pixels.groupBy(*by).agg(F.expr(f"percentile({value}, array({low}D, {high}D))").alias("p"))
    wide = pixels.join(span, by)
    flat = F.col("p")[1] - F.col("p")[0] <= 2.0**-23
    return wide.withColumn("proxy", F.when(flat, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(value) - F.col("p")[0]) / (F.col("p")[1] - F.col("p")[0]))))).drop("p")


def proxy_size(width: str, height: str, longest: int = 2048) -> tuple[Column, Column, Column]:
    """(width, height, factor) of a proxy whose longer edge is at most ``longest``; never larger than the frame. Halves round to even."""
    edge = f"greatest({width}, {height})"
    w, h = (f"CASE WHEN {edge} <= {longest} THEN {n} ELSE cast(greatest(1, rint({n} / ({edge} / {longest}D))) AS int) END" for n in (width, height))
    return F.expr(w), F.expr(h), F.expr(f"CASE WHEN {edge} <= {longest} THEN 1D ELSE {edge} / cast(greatest({w}, {h}) AS double) END")


def brightness_gain(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by, gain): mean of ``a`` over mean of ``b`` where ``ok``; 1 with fewer than 16 such pixels or a mean of ``b`` under 1e-6."""
    means = pairs.groupBy(*by).agg(F.count_if("ok").alias("n"), F.avg(F.when(F.col("ok"), F.col("a"))).alias("ma"), F.avg(F.when(F.col("ok"), F.col("b"))).alias("mb"))
    return means.select(*by, F.when((F.col("n") < 16) | (F.col("mb") < 1e-6), 1.0).otherwise(F.col("ma") / F.col("mb")).alias("gain"))


def stack_bytes(width: str, height: str, channels: int = 3) -> Column:
    """Memory that an untiled pyramid fold takes at most, about."""
    c = channels
    return F.expr(f"cast({height} * {width} * 4 / 3 * ({4 * c} + 8) + (3 * {height} * {width} * {4 * c} + {height} * {width} * 4 / 3 * ({4 * c} + 4)) AS bigint)")


def planned_seconds(width: str, height: str, frames: str, method: str, align: str, device: str) -> Column:
    """Planning estimate of a run, to a tenth of a second (halves to even), at least 0.1."""
    rate = F.create_map(*(F.lit(x) for kv in THROUGHPUT.items() for x in kv))[F.col(device)]
    factor = F.coalesce(F.create_map(*(F.lit(x) for kv in FACTORS.items() for x in kv))[F.col(method)], F.lit(1.0))
    work = F.col(width) * F.col(height) * F.col(frames) / 1e6 / rate * factor + F.when(F.col(align), F.col(frames) * ALIGN_SECONDS).otherwise(0.0)
    return F.greatest(F.lit(0.1), F.bround(work, 1))


def finite(value: str) -> Column:
    return F.expr(f"{value} IS NOT NULL AND NOT isnan({value}) AND abs({value}) < double('infinity')")


def coverage(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by, reliable, cells) of ``cells(reliable)``."""
    return cells.groupBy(*by).agg(F.count_if("reliable").alias("reliable"), F.count("*").alias("cells"))


def with_masks(pixels: DataFrame, masks: DataFrame) -> DataFrame:
    """``pixels(frame, y, x, ...)`` with ``valid`` of ``masks(frame, y, x, valid)``; pixels without a mask are valid."""
    return pixels.join(masks, ["frame", "y", "x"], "left").withColumn("valid", F.coalesce("valid", F.lit(True)))


def images_of(projects: DataFrame) -> DataFrame:
    """(project_id, image_id, kind, path, ...) of ``projects(project_id, images MAP)``."""
    return projects.select("project_id", F.explode("images").alias("image_id", "info")).select("project_id", "image_id", "info.*")


def find_image(projects: DataFrame, wanted: DataFrame) -> DataFrame:
    """(image_id, project_id, path): of ``wanted(image_id)`` the first project, by id, that has it with a path."""
    held = images_of(projects).where("path IS NOT NULL AND path <> ''").join(wanted, "image_id", "left_semi")
    return held.groupBy("image_id").agg(F.min_by(F.struct("project_id", "path"), "project_id").alias("p")).select("image_id", "p.project_id", "p.path")


def registered_view(projects: DataFrame, wanted: DataFrame) -> DataFrame:
    """(project_id, path, image_id): the view that a project already has for a path; null if there is none."""
    views = images_of(projects).where("kind = 'view'").groupBy("project_id", "path").agg(F.min("image_id").alias("image_id"))
    return wanted.join(views, ["project_id", "path"], "left").select("project_id", "path", "image_id")


def zip_strict(left: DataFrame, right: DataFrame, on: str = "ordinal") -> DataFrame:
    """Rows of two lists side by side by ``on``; lists of different lengths, or with other places, are an error."""
    both = left.withColumn("__l", F.lit(1)).join(right.withColumn("__r", F.lit(1)), on, "full")
    fit = F.assert_true(F.col("__l").isNotNull() & F.col("__r").isNotNull(), F.lit("lists of different lengths"))
    return both.where(fit.isNull()).drop("__l", "__r")


#: Results of a project that are listed as one for pairing.
LISTED = 1024


def retouch_sources(images: DataFrame, targets: DataFrame) -> DataFrame:
    """(project_id, target, source, fits): the other results of a project; ``fits`` where their sizes are the target's.

    A project's results are dealt to lists of ids of one size; each target meets each list of its project once, is compared with its size and unfolded with its ids.
    Lists and not projects are dealt to tasks: the pairs grow with the square of a project, and a few projects hold them all.
    """
    results = images.where("kind = 'result'").select("project_id", "image_id", "width", "height")
    lists = results.groupBy("project_id").agg(F.ceil(F.count("*") / LISTED).alias("lists"))
    dealt = results.join(lists, "project_id")
    held = dealt.groupBy("project_id", F.pmod(F.xxhash64("image_id"), F.col("lists")).alias("list"), F.col("width").alias("w"), F.col("height").alias("h")).agg(F.collect_list("image_id").alias("sources"))
    chosen = dealt.join(targets, ["project_id", "image_id"], "left_semi").withColumn("list", F.explode(F.expr("sequence(0L, lists - 1)")))
    # A fixed number of parts: their size says nothing about the pairs in them.
    spread = chosen.repartition(4 * images.sparkSession.sparkContext.defaultParallelism, "project_id", "list")
    met = spread.join(held.hint("merge"), ["project_id", "list"]).select("project_id", F.col("image_id").alias("target"), F.expr("width = w AND height = h").alias("fits"), "sources")
    return met.select("project_id", "target", F.explode("sources").alias("source"), "fits").where("target <> source").select("project_id", "target", "source", "fits")


STROKE = "struct<source_id:string,radius:double,hardness:double,opacity:double,mode:string,points:array<array<double>>>"


def parse_strokes(rows: DataFrame, text: str = "stroke") -> DataFrame:
    """``rows`` with source_id, radius, hardness, opacity, mode, points(x, y, p) of a stroke's JSON, and ``error`` (null where it is valid).

    Hardness is 0.5, opacity and pressure 1 and mode normal where they are not given.
    """
    parsed = rows.withColumn("s", F.from_json(text, STROKE))
    values = parsed.withColumns({
        "source_id": F.col("s.source_id"), "radius": F.col("s.radius"), "hardness": F.coalesce("s.hardness", F.lit(0.5)),
        "opacity": F.coalesce("s.opacity", F.lit(1.0)), "mode": F.coalesce("s.mode", F.lit("normal")),
        "points": F.transform("s.points", lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"), F.coalesce(F.get(p, F.lit(2)), F.lit(1.0)).alias("p"))),
    })
    error = (
        F.when(~F.col("mode").isin("normal", "erase"), "unknown mode")
        .when(F.col("source_id").isNull() | F.col("radius").isNull() | F.col("points").isNull(), "missing field")
        .when((F.col("radius") < 0) | ~F.col("hardness").between(0, 1) | ~F.col("opacity").between(0, 1), "out of range")
    )
    return values.withColumn("error", error).drop("s")


#: Tasks to a core that sessions are dealt to, about.
DEALT = 16


def new_sessions(images: DataFrame, targets: DataFrame, text: bool = False) -> DataFrame:
    """(project_id, image_id, sources, rev): sessions over results, with the other results of the project; other targets give none.

    With ``text`` the sources are one string, ids in order parted by commas. It is made once a project; a session copies what is before and after its own id.
    A project's sessions are dealt to shares by the ids they hold, so that its list is copied about as often as there are tasks for it and not for each session.
    """
    spread = DEALT * images.sparkSession.sparkContext.defaultParallelism
    results = images.where("kind = 'result' AND project_id IS NOT NULL AND image_id IS NOT NULL").groupBy("project_id", "image_id").agg(F.count("*").alias("copies"))
    # Where an id begins in the text, a comma counted after each id.
    place = F.coalesce(F.sum(F.length(F.col("image_id").cast("string")) + 1).over(Window.partitionBy("project_id").orderBy("image_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = (results.withColumn("place", place.cast("int")) if text else results).join(targets, ["project_id", "image_id"], "left_semi")
    ids = F.sort_array(F.collect_list("image_id"))
    lists = results.groupBy("project_id").agg(F.count("*").alias("n"), (F.array_join(ids.cast("array<string>"), ",").cast("binary") if text else ids).alias("sources"))
    held = chosen.groupBy("project_id").agg(F.sum("copies").alias("sessions")).join(lists.select("project_id", "n"), "project_id")
    held = held.withColumn("work", F.col("sessions").cast("double") * F.col("n"))
    held = held.crossJoin(held.agg(F.sum("work").alias("whole"))).select("project_id", F.expr(f"cast(floor({spread} * work / whole) AS int) + 1").alias("shares"))
    lists = lists.join(held, "project_id").select("project_id", "sources", F.explode(F.expr("sequence(0, shares - 1)")).alias("share"))
    dealt = chosen.join(held, "project_id").withColumn("share", F.expr("pmod(hash(image_id), shares)")).drop("shares").repartition(spread, "project_id", "share")
    met = dealt.join(lists.hint("merge"), ["project_id", "share"])
    own = F.expr("length(cast(image_id AS string))")
    others = F.array_remove("sources", F.col("image_id"))
    if text:
        tail = F.substring("sources", F.col("place") + own + 1, F.length("sources"))
        others = F.when(F.col("place") == 0, F.substring("sources", own + 2, F.length("sources"))).otherwise(F.concat(F.substring("sources", F.lit(1), F.col("place") - 1), tail)).cast("string")
    repeated = F.explode(F.expr("sequence(1L, copies)")).alias("copy")
    return met.select("project_id", "image_id", others.alias("sources"), F.lit(0).alias("rev"), repeated).drop("copy")


def revisions(changes: DataFrame) -> DataFrame:
    """(session, rev, dirty) from ``changes(session, seq, y0, x0, y1, x1)``: changes with an empty box count for nothing."""
    real = changes.where("y1 > y0 AND x1 > x0")
    return changes.select("session").distinct().join(real.groupBy("session").agg(F.count("*").alias("rev"), F.sum(F.expr("(y1 - y0) * (x1 - x0)")).alias("dirty")), "session", "left").select("session", F.coalesce("rev", F.lit(0)).alias("rev"), F.coalesce("dirty", F.lit(0)).alias("dirty"))


#: What an export of scene-linear samples does not bake in, and how codes map to samples.
NO_BAKE = ("white_balance", "exposure_style", "tone_curve", "denoise", "sharpen", "output_color_conversion")
FORMULA = "scene_linear = code / 65535 * span + offset"
CALIBRATION = ("black_level", "white_level", "color_matrix1", "color_matrix2", "calibration_illuminant1", "calibration_illuminant2", "as_shot_neutral")


def provenance(files: DataFrame, version: str, supplied: str | None = None) -> Column:
    """JSON of how an export was made, from the columns decoder (a map), those of ``CALIBRATION`` (missing ones are null), offset and span of ``files``; the fields of the struct ``supplied`` are added at the end."""
    known = set(files.columns)
    calibration = [F.col(c) if c in known else F.lit(None).cast("double").alias(c) for c in CALIBRATION]
    made = [
        F.lit(1).alias("schema"), F.lit("focalframe").alias("application"), F.lit(version).alias("version"), F.lit("scene_linear_camera_rgb").alias("processing_domain"),
        F.struct(*(F.lit(True).alias(n) for n in NO_BAKE)).alias("no_bake"), F.col("decoder"), F.struct(*calibration).alias("source_calibration"),
        F.struct(F.col("offset"), F.col("span"), F.lit(FORMULA).alias("formula")).alias("integer_mapping"),
    ]
    made += [F.col(f"{supplied}.{f.name}") for f in files.schema[supplied].dataType.fields] if supplied else []
    return F.to_json(F.struct(*made), {"ignoreNullFields": "false"})


#: The metadata of an image that a project keeps.
METADATA = """source_path string, icc binary, exif_bytes binary, xmp_bytes binary, exif map<string,string>, xmp map<string,string>, camera_make string, camera_model string,
lens_model string, capture_time string, orientation int, source_orientation int, black_level array<double>, white_level double, color_matrix1 array<double>, as_shot_neutral array<double>"""


def metadata_json(metadata: str = "metadata") -> Column:
    """A struct of metadata as JSON: bytes in base64, absent fields null."""
    return F.to_json(metadata, {"ignoreNullFields": "false"})


def metadata_of(text: str = "text") -> Column:
    """The metadata in a JSON text; fields that are missing are null, unknown ones are passed over, and a text that is no JSON object gives null."""
    return F.when(F.get_json_object(text, "$").startswith("{"), F.from_json(text, METADATA))


def job_states(events: DataFrame) -> DataFrame:
    """(job_id, status, percent) after ``events(job_id, seq, kind)`` with kinds submit, start, progress, finish, fail and cancel.

    The first final event counts; a cancel before the start ends a job at once, one after it when the work notices; what follows the end is void.
    """
    by_job = events.groupBy("job_id").agg(
        F.min(F.when(F.col("kind") == "start", F.col("seq"))).alias("started"),
        F.min(F.when(F.col("kind").isin("finish", "fail", "cancel"), F.struct("seq", "kind"))).alias("end"),
    )
    status = F.when(F.col("end").isNull(), F.when(F.col("started").isNull(), "pending").otherwise("running"))
    status = status.when((F.col("end.kind") != "cancel") & (F.col("started").isNull() | (F.col("started") > F.col("end.seq"))), "pending")
    status = status.when(F.col("end.kind") == "finish", "done").when(F.col("end.kind") == "fail", "error").otherwise("cancelled")
    out = by_job.select("job_id", status.alias("status"))
    return out.withColumn("percent", F.when(F.col("status") == "done", 1.0).otherwise(0.0))


def upsert(presets: DataFrame, new: DataFrame, key: str = "name") -> DataFrame:
    """``presets`` with those of ``new`` in the place of their namesakes; of several new ones with a name the last ``seq`` counts."""
    last = new.groupBy(key).agg(F.max_by(F.struct(*(c for c in new.columns if c != key)), "seq").alias("r")).select(key, "r.*")
    return presets.join(last, key, "left_anti").unionByName(last.select(*presets.columns))


def manifest_fits(stored: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """(key, verdict): reuse, where a stored manifest has the expected version, domain and, if one is expected, source hash; clash, where not; new, where there is none."""
    both = expected.alias("e").join(stored.alias("s"), key, "left")
    same = F.col("e.version").eqNullSafe(F.col("s.version")) & F.col("e.domain").eqNullSafe(F.col("s.domain")) & ((F.col("e.source_hash") == "") | F.col("e.source_hash").eqNullSafe(F.col("s.source_hash")))
    return both.select(key, F.when(F.col("s.version").isNull(), "new").when(same, "reuse").otherwise("clash").alias("verdict"))


def memo(requests: DataFrame, results: DataFrame, key: list[str]) -> DataFrame:
    """``requests`` with ``hit``: whether there is a result under their key; only the others need work."""
    return requests.join(results.select(*key).distinct().withColumn("hit", F.lit(True)), key, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def best_stable(candidates: DataFrame, by: list[str]) -> DataFrame:
    """(by, candidate, correlation): the stable candidate of finite and greatest correlation, ties to the first; candidate 0 with correlation 0 where there is none."""
    good = candidates.where(F.col("stable") & finite("correlation"))
    best = good.groupBy(*by).agg(F.max_by(F.struct("candidate", "correlation"), F.struct("correlation", -F.col("candidate"))).alias("c"))
    return candidates.select(*by).distinct().join(best, by, "left").select(*by, F.coalesce("c.candidate", F.lit(0)).alias("candidate"), F.coalesce("c.correlation", F.lit(0.0)).alias("correlation"))


def plausible(matrix: str, perspective: str, height: str, width: str) -> Column:
    """Whether a transform is finite and regular and neither scales nor, if perspective, moves corners too much."""
    m = matrix
    det = f"({m}[0] * ({m}[4] * {m}[8] - {m}[5] * {m}[7]) - {m}[1] * ({m}[3] * {m}[8] - {m}[5] * {m}[6]) + {m}[2] * ({m}[3] * {m}[7] - {m}[4] * {m}[6]))"
    corners = f"array(struct(0D AS x, 0D AS y), struct({width} - 1D AS x, 0D AS y), struct({width} - 1D AS x, {height} - 1D AS y), struct(0D AS x, {height} - 1D AS y))"
    w = f"({m}[6] * c.x + {m}[7] * c.y + {m}[8])"
    moved = f"sqrt(pow(({m}[0] * c.x + {m}[1] * c.y + {m}[2]) / {w} - c.x, 2) + pow(({m}[3] * c.x + {m}[4] * c.y + {m}[5]) / {w} - c.y, 2))"
    scale = f"sqrt(abs({m}[0] * {m}[4] - {m}[1] * {m}[3]))"
    sound = f"forall({m}, v -> NOT isnan(v) AND abs(v) < double('infinity')) AND abs({det}) > 1e-8 AND forall({corners}, c -> abs({w}) > 1e-6)"
    return F.expr(f"CASE WHEN NOT ({sound}) THEN false WHEN {perspective} THEN forall({corners}, c -> {moved} < sqrt(pow({height}, 2) + pow({width}, 2)) * 0.5D) ELSE {scale} > 0.8D AND {scale} < 1.25D END")


def nearest_similarity(matrix: str, cx: str, cy: str) -> Column:
    """The similarity nearest to an affine transform (closed form of the 2 x 2 Procrustes problem), mapping the centre to the same point.

    The rotation maximises the trace, so its angle is atan2(c - b, a + d); the scale is the mean of the singular values.
    """
    a, b, c, d = (f"{matrix}[{k}]" for k in (0, 1, 3, 4))
    turn = f"sqrt(pow({a} + {d}, 2) + pow({c} - {b}, 2))"
    flip = f"sqrt(pow({a} - {d}, 2) + pow({b} + {c}, 2))"
    # Singular values are (turn +- flip) / 2 up to sign, so their mean is half the greater of the two.
    scale = f"(greatest({turn}, {flip}) / 2D)"
    cos, sin = (f"CASE WHEN {turn} = 0 THEN {z} ELSE ({x}) / {turn} END" for x, z in ((f"{a} + {d}", "1D"), (f"{c} - {b}", "0D")))
    p, q = f"({scale} * ({cos}))", f"({scale} * ({sin}))"
    tx = f"{matrix}[2] + ({a} - {p}) * {cx} + ({b} + {q}) * {cy}"
    ty = f"{matrix}[5] + ({c} - {q}) * {cx} + ({d} - {p}) * {cy}"
    return F.expr(f"array({p}, -{q}, {tx}, {q}, {p}, {ty}, 0D, 0D, 1D)")
