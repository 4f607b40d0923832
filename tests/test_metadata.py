"""Packets of metadata: namespaces by address, both quotes, entities, texts; what is built is read again."""

from xml.etree import ElementTree

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from focalframe.operators import projects

OWN = {**projects.XMP, "own": "https://example.test/ns/1.0/"}


def read(spark, packets, namespaces=projects.XMP):
    df = spark.createDataFrame([*enumerate(packets)], "k int, packet string").coalesce(1)
    return [r["m"] for r in df.select("k", projects.xmp_map("packet", namespaces).alias("m")).orderBy("k").collect()]


def test_reading(spark):
    aux, dc, xmp = (projects.XMP[p] for p in ("aux", "dc", "xmp"))
    packets = [
        f"""<a xmlns:q='{aux}' q:Lens='50 "mm" &amp; more' plain='x'/>""",
        f'<?xpacket begin="" id="x"?><a xmlns="{dc}"><title> T&#228;tel &lt;1&gt; </title><title><!-- c --></title></a>',
        f'<a xmlns:p="{aux}"><b p:Lens="1"><c xmlns:p="{xmp}" p:Rating="5" Lens="0"/><p:Lens>2</p:Lens></b><b p:Lens="3"/></a>',
        '<a xmlns:aux="urn:unknown" aux:Lens="no"/>', "<a", "", None, "<a/>", '<a aux:Lens="undeclared"/>',
    ]
    want = [{"Xmp.aux.Lens": '50 "mm" & more'}, {"Xmp.dc.title": "Tätel <1>"}, {"Xmp.aux.Lens": "3", "Xmp.xmp.Rating": "5"}, {}, {}, {}, {}, {}, {}]
    assert read(spark, packets) == want
    assert read(spark, [f'<a xmlns:z="{OWN["own"]}" z:Depth="7"/>'], OWN) == [{"Xmp.own.Depth": "7"}]


NAMES = st.tuples(st.sampled_from([*OWN]), st.from_regex(r"[A-Za-z_][A-Za-z0-9_.-]{0,8}", fullmatch=True)).map(lambda t: f"Xmp.{t[0]}.{t[1]}")
TEXT = st.text(st.characters(codec="utf-8", exclude_categories=["Cc", "Cs", "Cn"]) | st.sampled_from("\t\n\r<>&\"'"), max_size=12)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.dictionaries(NAMES, TEXT, min_size=1, max_size=6), min_size=1, max_size=8))
def test_what_is_built_is_read_again(spark, maps):
    df = spark.createDataFrame([(k, {**m, "Xmp.other.Name": "x", "Exif.Image.Make": "y", "Xmp.dc": "z", "Xmp.dc.none": None}) for k, m in enumerate(maps)], "k int, xmp map<string,string>").coalesce(1)
    packets = [r["p"] for r in df.select("k", projects.xmp_packet("xmp", OWN).alias("p")).orderBy("k").collect()]
    assert read(spark, packets, OWN) == maps
    for packet, m in zip(packets, maps):
        described = ElementTree.fromstring(packet)[0][0]
        assert [f"{{{OWN[k.split('.')[1]]}}}{k.split('.', 2)[2]}" for k in sorted(m)] == list(described.attrib)


def test_no_packet_of_nothing(spark):
    df = spark.createDataFrame([(None,), ({},)], "xmp map<string,string>")
    assert [r[0] for r in df.select(projects.xmp_packet("xmp")).collect()] == [None, None]


def test_merging(spark):
    aux = projects.XMP["aux"]
    rows = [
        ({"Exif.Image.Make": "A", "Exif.Image.Orientation": "6", "Exif.Image.DateTime": "t"}, {"Exif.Image.Make": "B", "Exif.Photo.LensModel": "L"}, f'<a xmlns:q="{aux}" q:Lens="l" q:Other="o"/>', {"Xmp.aux.Lens": "won"}),
        (None, None, None, None),
        ({"Exif.Image.Orientation": "x", "Exif.Photo.DateTimeOriginal": "", "Exif.Image.DateTime": "later"}, {}, "<broken", None),
    ]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, exif map<string,string>, portable_exif map<string,string>, packet string, portable_xmp map<string,string>")
    a, b, c = projects.merged_metadata(df).orderBy("k").collect()
    assert a["exif"] == {"Exif.Image.Make": "B", "Exif.Image.Orientation": "6", "Exif.Image.DateTime": "t", "Exif.Photo.LensModel": "L"} and a["xmp"] == {"Xmp.aux.Lens": "won", "Xmp.aux.Other": "o"}
    assert (a["make"], a["lens"], a["captured"], a["orientation"], a["source_orientation"]) == ("B", "L", "t", 1, 6)
    assert (b["exif"], b["xmp"], b["make"], b["source_orientation"]) == ({}, {}, None, 1)
    assert (c["captured"], c["source_orientation"], c["xmp"]) == ("later", 1, {})


def test_provenance_and_metadata_documents(spark):
    import json

    df = spark.createDataFrame([({"name": "d"}, [1.5], 2.0, 0.25, 4.0, ("pmax", [3]))], "decoder map<string,string>, black_level array<double>, white_level double, offset double, span double, supplied struct<method:string,frames:array<int>>")
    made = json.loads(df.select(projects.provenance(df, "7", "supplied").alias("p")).first()["p"])
    assert list(made) == ["schema", "application", "version", "processing_domain", "no_bake", "decoder", "source_calibration", "integer_mapping", "method", "frames"]
    assert made["source_calibration"] == {c: {"black_level": [1.5], "white_level": 2.0}.get(c) for c in projects.CALIBRATION} and all(made["no_bake"].values()) and made["frames"] == [3]
    texts = spark.createDataFrame([("{}",), ("[1]",), ("no",), (None,), ('{"orientation": 3, "icc": "AAE=", "new": 1}',)], "text string")
    got = [r["m"] for r in texts.select(projects.metadata_of().alias("m")).collect()]
    assert got[1:4] == [None] * 3 and got[0]["icc"] is None and got[4]["orientation"] == 3 and bytes(got[4]["icc"]) == b"\x00\x01"
