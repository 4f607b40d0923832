"""Stores that are brought up to date in place: only what has changed is written, and what is read is as if all were new."""

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from focalframe.operators import dense, geometry, registry, retouch
from focalframe.plans.raster_queries import _strokes
from focalframe.raster import embedding_frames, pixels
from focalframe.sources.store import AlignedCache, DocumentStore, RetouchImages, TileStore


def parts(root):
    """Data files by partition folder."""
    out = {}
    for p in root.rglob("*.parquet"):
        out.setdefault(str(p.parent.relative_to(root)), set()).add(p.name)
    return out


def stack(spark, n, height, width, seed=0):
    rnd = np.random.default_rng(seed)
    return spark.createDataFrame([(k, y, rnd.integers(0, 256, width).tolist(), height) for k in range(n) for y in range(height)], "frame int, y int, row array<bigint>, height int")


def shifts(spark, n):
    return spark.range(n).select(F.col("id").cast("int").alias("frame"), geometry.translation("id * 0.5D", "id * -0.25D").alias("m"))


def held(cache):
    return {(r["frame"], r["y"]): ([round(v, 9) for v in r["row"]], r["valid"]) for r in cache.read().collect()}


def test_second_run_writes_changed_frames_only(spark, tmp_path):
    path = f"{tmp_path}/cache"
    frames, moves = stack(spark, 4, 150, 9), shifts(spark, 4)
    first = AlignedCache(spark, path, source_hash="a")
    assert {(r["frame"], r["verdict"]) for r in first.refresh(frames, moves).collect()} == {(k, "new") for k in range(4)}
    before = parts(tmp_path / "cache" / "rows")
    assert set(before) == {f"frame={k}/band={b}" for k in range(4) for b in range(3)}
    # Nothing changed: nothing is written.
    assert {r["verdict"] for r in AlignedCache(spark, path, source_hash="a").refresh(frames, moves).collect()} == {"kept"}
    assert parts(tmp_path / "cache" / "rows") == before
    # One sample of frame 1 and the transform of frame 2 change.
    frames = frames.withColumn("row", F.expr("CASE WHEN frame = 1 AND y = 140 THEN transform(row, (v, i) -> CASE WHEN i = 3 THEN v + 1 ELSE v END) ELSE row END"))
    moves = moves.withColumn("m", F.when(F.col("frame") == 2, geometry.translation("1.5D", "2D")).otherwise(F.col("m")))
    cache = AlignedCache(spark, path, source_hash="a")
    told = {r["frame"]: r["verdict"] for r in cache.refresh(frames, moves).collect()}
    assert told == {0: "kept", 1: "rewritten", 2: "rewritten", 3: "kept"}
    after = parts(tmp_path / "cache" / "rows")
    assert {k for k in after if after[k] != before[k]} == {f"frame={k}/band={b}" for k in (1, 2) for b in range(3)}
    fresh = AlignedCache(spark, f"{tmp_path}/fresh", source_hash="a")
    fresh.refresh(frames, moves)
    assert held(cache) == held(fresh)
    # A frame goes, another gets lower.
    low = frames.where("frame <> 0 AND (frame <> 3 OR y < 60)").withColumn("height", F.expr("CASE WHEN frame = 3 THEN 60 ELSE height END"))
    told = {r["frame"]: r["verdict"] for r in cache.refresh(low, moves.where("frame <> 0")).collect()}
    assert told == {0: "removed", 1: "kept", 2: "kept", 3: "rewritten"}
    assert {k for k, _ in held(cache)} == {1, 2, 3} and max(y for k, y in held(cache) if k == 3) == 59


def test_a_cache_of_another_source_is_refused(spark, tmp_path):
    AlignedCache(spark, f"{tmp_path}/c", source_hash="a").refresh(stack(spark, 1, 5, 5), shifts(spark, 1))
    for other in ({"source_hash": "b"}, {"source_hash": "a", "domain": "scene_linear"}, {"source_hash": "a", "version": 3}):
        with pytest.raises(ValueError, match="another version, domain or source"):
            AlignedCache(spark, f"{tmp_path}/c", **other)
    AlignedCache(spark, f"{tmp_path}/c")


def test_a_run_that_died_before_the_manifest_is_repeated(spark, tmp_path):
    frames, moves = stack(spark, 2, 8, 6), shifts(spark, 2)
    cache = AlignedCache(spark, f"{tmp_path}/c")
    cache.rows.replace(cache._made(frames, moves, "bilinear"))
    assert cache.read().count() == 0
    assert {r["verdict"] for r in cache.refresh(frames, moves).collect()} == {"new"}
    assert cache.read().count() == 16


def test_only_dirty_tiles_change(spark, tmp_path):
    height, width, tile = 70, 45, 16
    rnd = np.random.default_rng(1)
    image = rnd.integers(0, 200, (height, width)).astype(float)
    store = TileStore(spark, f"{tmp_path}/tiles", height, width, tile)
    frame = lambda a: spark.createDataFrame([(y, a[y].tolist()) for y in range(height)], "y int, row array<double>")
    store.build(frame(image))
    before, old = parts(tmp_path / "tiles"), {(r["z"], r["ty"], r["tx"], r["dy"]): r["row"] for r in store.read().collect()}
    boxes = [(1, 3, 4, 9, 12), (2, 50, 30, 70, 45), (3, 5, 5, 5, 9)]
    for _, y0, x0, y1, x1 in boxes:
        image[y0:y1, x0:x1] += 50
    dirty = {tuple(r) for r in store.update(frame(image), spark.createDataFrame(boxes, "id int, y0 int, x0 int, y1 int, x1 int")).collect()}
    after, new = parts(tmp_path / "tiles"), {(r["z"], r["ty"], r["tx"], r["dy"]): r["row"] for r in store.read().collect()}
    assert {k for k in after if after[k] != before[k]} == {f"z={z}/ty={y}/tx={x}" for z, y, x in dirty} and 0 < len(dirty) < len(after)
    whole = {(r["z"], r["ty"], r["tx"], r["dy"]): r["row"] for r in retouch.tile_rows(frame(image), height, width, tile).collect()}
    assert all(new[k] == (whole if k[:3] in dirty else old)[k] for k in whole) and set(new) == set(whole)


def test_replay_from_checkpoints(spark, tmp_path):
    flat = pixels(embedding_frames(spark, DATA))
    base = flat.where("frame = 0").select("y", "x", F.col("v").cast("double").alias("v"))
    sources = flat.where("frame > 0").select(F.col("frame").alias("source"), "y", "x", F.col("v").cast("double").alias("s"))
    strokes = _strokes(spark, DATA).withColumn("position", F.col("seq") + 1).cache()
    store = RetouchImages(spark, f"{tmp_path}/images", 50, 64, every=3)
    assert store.save(base, strokes, sources) == 3 and store.save(base, strokes, sources) == 0
    before = parts(tmp_path / "images")
    assert set(before) == {"at=3", "at=6", "at=9"}
    for n in (10, 9, 7, 2, 0):
        image, replayed = store.after(base, strokes, sources, n)
        want = retouch.retouched(base, strokes.where(F.col("position") <= n), sources, 50, 64)
        got, want = ({(r["y"], r["x"]): round(r["v"], 9) for r in d.collect()} for d in (image, want))
        assert got == want and replayed == n % 3
    store.forget_after(7)
    assert set(parts(tmp_path / "images")) == {"at=3", "at=6"}
    # Other strokes after an undo: only the forgotten checkpoint is made again.
    assert store.save(base, strokes.withColumn("opacity", F.expr("CASE WHEN position > 7 THEN 0.1D ELSE opacity END")), sources) == 1
    after = parts(tmp_path / "images")
    assert all(after[k] == before[k] for k in ("at=3", "at=6")) and after["at=9"] != before["at=9"]


def test_documents_are_kept_one_by_one(spark, tmp_path):
    store = DocumentStore(spark, f"{tmp_path}/d", "name", "size int, tags array<string>", ("size",))
    assert store.load().count() == 0
    store.save(spark.createDataFrame([("a", 1, ["x"]), ("b/ö", 2, None), ("c", None, [])], "name string, size int, tags array<string>"))
    before = parts(tmp_path / "d")
    store.save(spark.createDataFrame([("a", 5, ["y", "z"])], "name string, size int, tags array<string>"))
    after = parts(tmp_path / "d")
    assert sum(after[k] != before[k] for k in before) == 1
    assert sorted(map(tuple, store.load().collect())) == [("a", 5, ["y", "z"]), ("b/ö", 2, None)]
    store.delete(spark.createDataFrame([("a",), ("none",)], "name string"))
    assert [r["name"] for r in store.load().collect()] == ["b/ö"]
    store.documents.replace(spark.createDataFrame([("{broken", "d"), ('{"size": 1}', "e")], "document string, name string"))
    assert sorted(r["name"] for r in store.load().collect()) == ["b/ö", "e"]
    store.delete(spark.createDataFrame([("b/ö",)], "name string"))
    assert [r["name"] for r in store.load().collect()] == ["e"]


def test_parameters_are_checked():
    registry.checked("slab", {"slab_size": 4, "estimation_radius": 2, "inner_method": "pmax"})
    for name, given, says in (("pmax", {"selection_smoothing": 4}, "from 0 to 3"), ("pmax", {"selection_smoothing": 1.0}, "whole number"), ("weighted", {"temperature": 0}, "from 0.001 to 1"), ("weighted", {"heat": 1}, "unknown parameter"), ("slab", {"inner_method": "slab"}, "one of pmax"), ("blend", {}, "unknown method")):
        with pytest.raises(ValueError, match=says):
            registry.checked(name, given)
    with pytest.raises(ValueError, match="from 2 to 40"):
        dense.fused_by("weighted", None, sharpness_radius=1)
