"""Frames as a Spark source and sink: what is read for a region, and that no failed export leaves a trace."""

import json
import os

import numpy as np
import pyarrow.fs as pafs
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import datasource as ds

from focalframe.sources import decode_tiff, encode_png, encode_tiff
from focalframe.sources import frames as files


def stack(n, height, width, seed=0, top=256):
    return np.random.default_rng(seed).integers(0, top, (n, height, width, 3))


def rows(spark, images):
    made = [(k, y, *(image[y, :, c].tolist() for c in range(3)), len(image)) for k, image in enumerate(images) for y in range(len(image))]
    kind = "double" if images[0].dtype.kind == "f" else "bigint"
    return spark.createDataFrame(made, f"frame int, y int, r array<{kind}>, g array<{kind}>, b array<{kind}>, height int").repartition(5)


def images_of(df, n):
    got = {}
    for r in df.collect():
        got[r["frame"], r["y"]] = np.stack([r["r"], r["g"], r["b"]], axis=1)
    return [np.stack([got[k, y] for y in range(sum(f == k for f, _ in got))]) for k in range(n)]


@pytest.mark.parametrize("bits, strip", [(8, 7), (16, 64), (16, 1)])
def test_what_is_exported_is_read_again(spark, tmp_path, bits, strip):
    images = stack(3, 37, 11, top=1 << bits)
    files.register(spark)
    rows(spark, images).repartition("frame").sortWithinPartitions("frame", "y").write.format("frames").option("bits", bits).option("strip", strip).mode("append").save(str(tmp_path))
    back = images_of(files.read_stack(spark, str(tmp_path), band=10), 3)
    assert all((a == b).all() for a, b in zip(images, back))
    assert (decode_tiff((tmp_path / "0001.tif").read_bytes()) == images[1]).all() if strip >= 37 else True
    listed = json.loads((tmp_path / "manifest.json").read_text())
    assert list(listed) == ["0000.tif", "0001.tif", "0002.tif"] and listed["0001.tif"]["height"] == 37
    assert sorted(p.name for p in tmp_path.iterdir()) == ["0000.tif", "0001.tif", "0002.tif", "manifest.json"]


def test_values_are_clamped_rounded_or_kept(spark, tmp_path):
    image = np.array([[[-0.5, 0.0, 0.25], [1.0, 1.5, 0.5]]])
    files.export_frames(rows(spark, [image]), str(tmp_path / "codes"), bits=8)
    assert images_of(files.read_stack(spark, str(tmp_path / "codes")), 1)[0].tolist() == [[[0, 0, 64], [255, 255, 128]]]
    files.export_frames(rows(spark, [image]), str(tmp_path / "floats"), bits=32)
    assert (images_of(files.read_stack(spark, str(tmp_path / "floats"), samples="floats"), 1)[0] == image).all()


def test_a_region_costs_its_own_bytes(tmp_path):
    height, width = 400, 50
    for k, image in enumerate(stack(4, height, width)):
        (tmp_path / f"{k:04d}.tif").write_bytes(encode_tiff(image / 255, 8))
    reader = files.FrameReader({"path": str(tmp_path)})
    left = list(reader.pushFilters([ds.In(("frame",), (1, 3)), ds.GreaterThanOrEqual(("y",), 100), ds.LessThan(("y",), 120), ds.EqualTo(("height",), height)]))
    assert [type(f) for f in left] == [ds.EqualTo]
    parts = reader.partitions()
    assert [(p.frame, p.first, p.last) for p in parts] == [(1, 100, 120), (3, 100, 120)]
    heads = reader.bytes_read
    read = [b for p in parts for b in reader.read(p)]
    assert sum(b.num_rows for b in read) == 40
    pixels = reader.bytes_read - heads
    assert 2 * 20 * width * 3 <= pixels <= 2 * 20 * width * 3 + 2 * 1000 and pixels < 0.06 * 4 * height * width * 3
    assert reader.bytes_read < 0.06 * sum(p.stat().st_size for p in tmp_path.iterdir())


def test_partitions_are_bands_of_files(tmp_path):
    for k, image in enumerate(stack(2, 100, 5)):
        (tmp_path / f"{k}.tif").write_bytes(encode_tiff(image / 255, 8))
    (tmp_path / "2.png").write_bytes(encode_png(stack(1, 90, 5)[0] / 255, 8))
    (tmp_path / ".hidden.tif").write_bytes(b"")
    (tmp_path / "notes.txt").write_text("no frame")
    parts = files.FrameReader({"path": str(tmp_path), "band": "40"}).partitions()
    assert [(p.frame, p.first, p.last) for p in parts] == [(0, 0, 40), (0, 40, 80), (0, 80, 100), (1, 0, 40), (1, 40, 80), (1, 80, 100), (2, 0, 90)]


def test_filters_of_a_query_reach_the_files(spark, tmp_path):
    images = stack(4, 30, 8)
    files.export_frames(rows(spark, images), str(tmp_path), bits=8)
    got = files.read_stack(spark, str(tmp_path), band=8).where("frame IN (1, 2) AND y BETWEEN 10 AND 19 AND y <> 12 AND size(r) = 8")
    plan = got._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PushedFilters" in plan and "In(frame, [1,2])" in plan
    assert {(r["frame"], r["y"]) for r in got.collect()} == {(k, y) for k in (1, 2) for y in range(10, 20) if y != 12}
    path = got.select("path").first()[0]
    assert files.read_stack(spark, str(tmp_path)).where(F.col("path") == path).select("frame").distinct().count() == 1
    assert files.read_stack(spark, str(tmp_path)).where("frame > 99").count() == 0


def left_in(folder):
    return sorted(p.name for p in folder.iterdir()) if folder.exists() else []


@pytest.mark.parametrize("fault, says", [
    ("CASE WHEN frame = 2 AND y = 7 THEN transform(r, v -> 300L) ELSE r END", "codes must lie"),
    ("CASE WHEN frame = 2 AND y = 7 THEN slice(r, 1, 3) ELSE r END", "rows must come in order"),
])
def test_a_failing_task_leaves_no_file(spark, tmp_path, fault, says):
    bad = rows(spark, stack(4, 10, 6)).withColumn("r", F.expr(fault))
    with pytest.raises(PySparkException, match=says):
        files.export_frames(bad, str(tmp_path / "out"), bits=8)
    assert left_in(tmp_path / "out") == []


def test_missing_rows_and_values_are_refused(spark, tmp_path):
    good = rows(spark, stack(2, 10, 6))
    with pytest.raises(PySparkException, match="9 of 10 rows"):
        files.export_frames(good.where("frame = 0 OR y < 9"), str(tmp_path / "short"), bits=8)
    with pytest.raises(PySparkException, match="must be finite"):
        files.export_frames(rows(spark, stack(1, 4, 4) / 255.0).withColumn("g", F.transform("g", lambda v: F.lit(float("nan")))), str(tmp_path / "nan"), bits=32)
    assert left_in(tmp_path / "short") == left_in(tmp_path / "nan") == []


def test_existing_files_are_replaced_only_on_request(spark, tmp_path):
    first, second = stack(2, 6, 5, 1), stack(1, 6, 5, 2)
    files.export_frames(rows(spark, first), str(tmp_path), bits=8)
    before = (tmp_path / "0000.tif").read_bytes()
    with pytest.raises(PySparkException, match="exists"):
        files.export_frames(rows(spark, second), str(tmp_path), bits=8)
    assert (tmp_path / "0000.tif").read_bytes() == before and not any(n.startswith(".") for n in left_in(tmp_path))
    files.export_frames(rows(spark, second), str(tmp_path), bits=8, overwrite=True)
    back = images_of(files.read_stack(spark, str(tmp_path)), 2)
    assert (back[0] == second[0]).all() and (back[1] == first[1]).all()


def batch_of(image, frame=0, height=None):
    import pyarrow as pa

    n = len(image)
    return pa.RecordBatch.from_arrays([pa.array([frame] * n, pa.int32()), pa.array(range(n), pa.int32()), *(pa.array(image[:, :, c].tolist()) for c in range(3)), pa.array([height or n] * n, pa.int32())], names=["frame", "y", "r", "g", "b", "height"])


def test_two_phases(tmp_path, monkeypatch):
    image = stack(1, 9, 4)[0]
    writer = files.FrameWriter({"path": str(tmp_path), "bits": "8", "strip": "4"}, False)
    message = writer.write(iter([batch_of(image)]))
    # Nothing has a final name before the commit, and what a lost executor has left goes with either end.
    (tmp_path / f".{writer.job}-9-9-0007").write_bytes(b"half")
    assert not (tmp_path / "0000.tif").exists()
    writer.commit([message, None])
    assert left_in(tmp_path) == ["0000.tif", "manifest.json"]
    again = files.FrameWriter({"path": str(tmp_path), "bits": "8"}, True)
    again.abort([again.write(iter([batch_of(image, 5)])), None])
    assert left_in(tmp_path) == ["0000.tif", "manifest.json"]
    twice = files.FrameWriter({"path": str(tmp_path), "bits": "8"}, True)
    messages = [twice.write(iter([batch_of(image, 3)])), files.Written([(f"{tmp_path}/x", "0003.tif", 9, 4, "")])]
    with pytest.raises(ValueError, match="several tasks"):
        twice.commit(messages)
    twice.abort(messages)
    monkeypatch.setattr(files.shutil, "disk_usage", lambda p: type("Usage", (), {"free": 10})())
    with pytest.raises(OSError, match="more than are free"):
        files.FrameWriter({"path": str(tmp_path), "bits": "8"}, True).write(iter([batch_of(image, 4)]))
    with pytest.raises(ValueError, match="more than a TIFF file can hold"):
        files.FrameWriter({"path": str(tmp_path), "bits": "32"}, True).write(iter([batch_of(image, 4, 1 << 30)]))
    assert left_in(tmp_path) == ["0000.tif", "manifest.json"]


def test_a_change_on_the_way_to_the_disk_is_found(tmp_path):
    image = stack(1, 9, 4)[0]
    writer = files.FrameWriter({"path": str(tmp_path), "bits": "8"}, False)
    path = writer.write(iter([batch_of(image)])).files[0]
    with open(path[0], "r+b") as f:
        f.seek(-1, os.SEEK_END)
        last = f.read(1)[0]
        f.seek(-1, os.SEEK_END)
        f.write(bytes([last ^ 1]))
    with pytest.raises(OSError, match="samples changed"):
        writer._check(pafs.LocalFileSystem(), *path)
