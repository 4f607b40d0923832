"""Metadata packets made of the part table, read, built and merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import projects
from ..raster import table
from .registry import query


def _said(*parts: str | Column) -> Column:
    """Text of columns and of literals."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 10 IN (0, 7) THEN 0 ELSE 4 END AS n, CASE WHEN p_partkey % 10 NOT IN (0, 7) THEN p_name || ' <&> "' || p_brand || '"' END AS lens, CASE WHEN p_partkey % 10 NOT IN (0, 7) THEN CAST(p_size AS VARCHAR) END AS rating,
CASE WHEN p_partkey % 10 NOT IN (0, 7) THEN p_type END AS title, CASE WHEN p_partkey % 10 NOT IN (0, 7) THEN CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'first' END END AS model FROM part""")
def xmp_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets with unusual prefixes, both quotes, entities, element texts, repeated names and unknown namespaces; some are missing or broken."""
    names = projects.XMP
    opened = f"<x:xmpmeta xmlns:x='adobe:ns:meta/' xmlns:lens='{names['aux']}' xmlns:dc='urn:other'><rdf:RDF xmlns:rdf='http://www.w3.org/1999/02/22-rdf-syntax-ns#'>"
    attributes = (f"<rdf:Description xmlns:b='{names['xmp']}' xmlns:t='{names['tiff']}' b:Rating=\"", F.col("p_size").cast("string"), "\" dc:title='no' t:Model='first' lens:Lens='", F.col("p_name"), " &lt;&#38;&gt; &quot;", F.col("p_brand"), "&quot;'>")
    title = (f"<d:title xmlns:d='{names['dc']}'>  ", F.col("p_type"), " </d:title>")
    model = F.when(F.expr("p_partkey % 2 = 0"), _said("<t:Model>", F.col("p_brand"), "</t:Model>")).otherwise("<t:Model> </t:Model>")
    whole = _said(opened, *attributes, *title, model, "</rdf:Description></rdf:RDF></x:xmpmeta>")
    kind = F.expr("p_partkey % 10")
    packet = F.when(kind == 7, "<x:xmpmeta><open>").when(kind != 0, whole)
    m = table(spark, sf_dir, "part").withColumn("packet", packet).select("p_partkey", projects.xmp_map("packet").alias("m"))
    found = {"lens": "Xmp.aux.Lens", "rating": "Xmp.xmp.Rating", "title": "Xmp.dc.title", "model": "Xmp.tiff.Model"}
    return m.select("p_partkey", F.size("m").alias("n"), *(F.col("m")[k].alias(c) for c, k in found.items()))


@query("""SELECT p_partkey, unnest(['Xmp.aux.Lens', 'Xmp.dc.title', 'Xmp.exif.UserComment', 'Xmp.xmp.Rating']) AS key,
unnest([p_name, p_type || ' "<' || p_brand || '>" & ''x''', p_brand || chr(10) || p_type || chr(9), CAST(p_size AS VARCHAR)]) AS value FROM part""")
def xmp_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets made of maps and read again: every known name comes back as it was, unknown ones stay out."""
    size, name = F.col("p_size").cast("string"), F.col("p_name")
    values = {"Xmp.xmp.Rating": size, "Xmp.aux.Lens": name, "Xmp.dc.title": _said(F.col("p_type"), ' "<', F.col("p_brand"), ">\" & 'x'"), "Xmp.exif.UserComment": _said(F.col("p_brand"), "\n", F.col("p_type"), "\t"), "Xmp.unknown.Name": name, "Exif.Image.Make": name}
    made = F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v)))
    packets = table(spark, sf_dir, "part").select("p_partkey", made.alias("xmp")).select("p_partkey", projects.xmp_packet("xmp").alias("packet"))
    return packets.select("p_partkey", F.explode(projects.xmp_map("packet")))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE 'Maker' END AS make, p_name AS model, CASE WHEN p_partkey % 3 = 0 THEN '2024' ELSE 'd' || p_partkey END AS captured,
CASE WHEN p_size % 9 = 0 THEN 1 ELSE CAST(p_size % 9 AS INTEGER) END AS source_orientation, 1 AS orientation, 4 AS n_exif, CASE WHEN p_partkey % 5 = 0 THEN p_brand ELSE p_type END AS lens FROM part""")
def merged_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of the decoder under those of the portable reader, which win name by name."""
    exif = F.create_map(F.lit("Exif.Image.Make"), F.lit("Maker"), F.lit("Exif.Image.Orientation"), F.expr("cast(p_size % 9 AS string)"), F.lit("Exif.Image.DateTime"), F.expr("concat('d', p_partkey)"))
    own = F.expr("map_filter(map('Exif.Image.Make', CASE WHEN p_partkey % 2 = 0 THEN p_type END, 'Exif.Image.Model', p_name, 'Exif.Image.DateTime', CASE WHEN p_partkey % 3 = 0 THEN '2024' END), (k, v) -> v IS NOT NULL)")
    packet = _said(f"<a xmlns:q='{projects.XMP['aux']}' q:Lens='", F.col("p_type"), "'/>")
    extra = F.expr("CASE WHEN p_partkey % 5 = 0 THEN map('Xmp.aux.Lens', p_brand) END")
    files = table(spark, sf_dir, "part").select("p_partkey", exif.alias("exif"), own.alias("portable_exif"), packet.alias("packet"), extra.alias("portable_xmp"))
    out = projects.merged_metadata(files).drop("lens")
    return out.select("p_partkey", "make", "model", "captured", "source_orientation", "orientation", F.size("exif").alias("n_exif"), F.col("xmp")["Xmp.aux.Lens"].alias("lens"))


@query("""SELECT p_partkey, '{"schema":1,"application":"focalframe","version":"1","processing_domain":"scene_linear_camera_rgb","no_bake":{"white_balance":true,"exposure_style":true,"tone_curve":true,"denoise":true,"sharpen":true,"output_color_conversion":true},"decoder":{"name":"' || p_brand
|| '"},"source_calibration":{"black_level":[' || p_size || ',1],"white_level":' || (p_size + 1000) || ',"color_matrix1":null,"color_matrix2":null,"calibration_illuminant1":null,"calibration_illuminant2":null,"as_shot_neutral":null},"integer_mapping":{"offset":' || p_size || ',"span":65535,"formula":"scene_linear = code / 65535 * span + offset"},"method":"' || p_type || '","frames":' || p_size || '}' AS provenance FROM part""")
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an export says of how it was made."""
    p = table(spark, sf_dir, "part")
    files = p.select("p_partkey", F.create_map(F.lit("name"), "p_brand").alias("decoder"), F.array(F.col("p_size"), F.lit(1)).alias("black_level"), (F.col("p_size") + 1000).alias("white_level"), F.col("p_size").alias("offset"), F.lit(65535).alias("span"), F.struct(F.col("p_type").alias("method"), F.col("p_size").alias("frames")).alias("supplied"))
    return files.select("p_partkey", projects.provenance(files, "1", "supplied").alias("provenance"))


@query("""SELECT p_partkey, p_name AS source_path, CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS icc, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS INTEGER) END AS orientation, p_type AS make, CASE WHEN p_partkey % 5 <> 0 THEN p_size + 0.5::DOUBLE END AS black, p_partkey % 7 = 0 AS absent FROM part""")
def metadata_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata with bytes, maps, lists and absent fields to JSON and back; texts that are no documents give nothing."""
    p = table(spark, sf_dir, "part")
    made = F.struct(
        F.col("p_name").alias("source_path"), F.when(F.expr("p_partkey % 3 <> 0"), F.encode("p_brand", "UTF-8")).alias("icc"), F.create_map(F.lit("Exif.Image.Make"), "p_type").alias("exif"),
        F.when(F.expr("p_partkey % 2 = 0"), F.col("p_size").cast("int")).alias("orientation"), F.when(F.expr("p_partkey % 5 <> 0"), F.array(F.col("p_size") + F.lit(0.5), F.lit(1.0))).alias("black_level"), F.lit("x").alias("unknown"),
    )
    texts = p.select("p_partkey", made.alias("metadata")).select("p_partkey", "metadata", projects.metadata_json().alias("text"))
    back = texts.select("p_partkey", projects.metadata_of().alias("m"), F.when(F.expr("p_partkey % 7 = 0"), "[1, 2]").otherwise(F.col("text")).alias("text")).withColumn("absent", projects.metadata_of().isNull())
    return back.select("p_partkey", "m.source_path", F.decode("m.icc", "UTF-8").alias("icc"), "m.orientation", F.col("m.exif")["Exif.Image.Make"].alias("make"), F.col("m.black_level")[0].alias("black"), "absent")
