"""Whole-frame operators against numpy on synthetic stacks with known truth."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import stack

from focalframe import sources, streaming
from focalframe.operators import dense, fuse, registry


def noise(shape, seed):
    rnd = np.random.default_rng(seed)
    return sum(a * dense.separable(np.pad(rnd.normal(size=shape), len(t) // 2, mode="reflect"), t) for a, t in ((1, dense.gaussian_taps(1.0)), (2, dense.gaussian_taps(3.0))))


def focus_stack(shape=(96, 128), n=4, seed=7):
    """A scene with a depth ramp; each frame is blurred by its distance from the focus. Codes of 8 bits."""
    scene = noise(shape, seed)
    scene = (scene - scene.min()) / np.ptp(scene) * 0.8 + 0.1
    depth = np.tile(np.linspace(0, 1, shape[1]), (shape[0], 1))
    frames = []
    for k in range(n):
        sigma = np.round(np.abs(depth - k / (n - 1)) * 8) / 2
        frame = np.zeros(shape)
        for s in np.unique(sigma):
            taps = dense.gaussian_taps(s) if s > 0 else np.ones(1)
            blurred = dense.separable(np.pad(scene, len(taps) // 2, mode="reflect"), taps)
            frame[sigma == s] = blurred[sigma == s]
        frames.append(np.floor(frame * 255 + 0.5).astype(int))
    return scene * 255, depth, frames


def similar(a, b):
    """Mean SSIM over 7 x 7 windows."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    m = lambda x: dense.box(x, 3) / 49
    ma, mb = m(a), m(b)
    va, vb, c = m(a * a) - ma**2, m(b * b) - mb**2, m(a * b) - ma * mb
    k1, k2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    return float(((2 * ma * mb + k1) * (2 * c + k2) / ((ma**2 + mb**2 + k1) * (va + vb + k2))).mean())


@pytest.fixture(scope="module")
def fixture(spark):
    scene, depth, frames = focus_stack()
    return scene, depth, frames, stack(spark, frames).cache()


def test_pmax_beats_every_frame(fixture):
    scene, _, frames, df = fixture
    image = np.array([r["row"] for r in dense.pmax(df).orderBy("y").collect()])
    assert similar(image, scene) > 0.95 and similar(image, scene) > max(similar(f, scene) for f in frames)


def whole_pmax(frames, masks=None, smoothing=1, depth=1):
    """The fold over whole arrays, written for the test alone."""
    pyramids = [dense.pyramid(f.astype(float), depth) for f in frames]
    masks = [np.ones(f.shape) for f in frames] if masks is None else [m.astype(float) for m in masks]
    levels, winners = [], []
    for k in range(depth):
        good = np.array([m > 0.5 for m in masks])
        energy = np.where(good, [dense.mean3(np.abs(p[k])) for p in pyramids], -np.inf)
        pick = energy.argmax(0)
        out = np.take_along_axis(np.array([p[k] for p in pyramids]), pick[None], 0)[0]
        if smoothing:
            views = np.lib.stride_tricks.sliding_window_view(np.pad(pick, smoothing, mode="edge"), (2 * smoothing + 1,) * 2)
            smooth = np.median(views, axis=(2, 3)).astype(int)
            for y, x in zip(*np.nonzero(smooth != pick)):
                if good[smooth[y, x], y, x]:
                    out[y, x] = pyramids[smooth[y, x]][k][y, x]
            pick = smooth
        levels.append(out)
        winners.append(pick)
        masks = [dense.halve(m) for m in masks]
    rest = np.array([p[-1] for p in pyramids])
    weight = np.array([(dense.mean3(np.abs(r - dense.mean3(r))) + 1e-6) * (m > 0.5) for r, m in zip(rest, masks)])
    return dense.collapse([*levels, (rest * weight).sum(0) / np.maximum(weight.sum(0), 1e-8)]), winners


def image_of(rows, column="row"):
    return np.array([r[column] for r in rows.orderBy("y").collect()])


@pytest.mark.parametrize("smoothing, depth", [(0, 1), (1, 1), (2, 3)])
def test_pmax_equals_a_whole_numpy_fold(fixture, monkeypatch, smoothing, depth):
    _, _, frames, df = fixture
    monkeypatch.setattr(dense, "ROWS", 16)
    image, winners = whole_pmax(frames, None, smoothing, depth)
    got = dense.pmax_levels(df, smoothing, depth)
    for k in range(depth):
        assert (image_of(got.where(f"level = {k}"), "winner") == winners[k]).all()
    assert np.allclose(image_of(dense.pmax(df, smoothing, depth, band=16)), image)


def test_masked_methods(spark, fixture):
    _, _, frames, df = fixture
    masked = df.withColumn("valid", F.expr("transform(row, (v, x) -> (v + x + frame) % 7 <> 0 AND (frame <> 1 OR x > 40))"))
    masks = [np.array([[(v + x + k) % 7 != 0 and (k != 1 or x > 40) for x, v in enumerate(row)] for row in f]) for k, f in enumerate(frames)]
    assert np.allclose(image_of(dense.pmax(masked)), whole_pmax(frames, masks)[0])
    flat = dense.dmap_fold(df.where("frame < 2").withColumn("valid", F.expr("transform(row, v -> frame = 1)")), 2)
    assert set(image_of(flat, "index").ravel()) == {1.0}


def test_dmap_gives_image_and_depth(fixture):
    scene, depth, _, df = fixture
    out = dense.fused_by("dmap", df, estimation_radius=4, smoothing_radius=8)
    assert similar(image_of(out), scene) > 0.93 and np.corrcoef(image_of(out, "depth").ravel(), depth.ravel())[0, 1] > 0.95


def test_refinement_in_bands_equals_the_whole(spark, fixture, monkeypatch):
    df = fixture[3]
    winners = dense.dmap_fold(df, 2)
    whole = image_of(dense.refine_index(winners, 7.0, 4))
    monkeypatch.setattr(dense, "ROWS", 16)
    assert np.allclose(image_of(dense.refine_index(winners, 7.0, 4)), whole, atol=1e-4)


def test_slab_and_tiles(fixture):
    scene, _, _, df = fixture
    assert similar(image_of(dense.fused_by("slab", df, slab_size=3, slab_overlap=1, estimation_radius=4, smoothing_radius=8)), scene) > 0.93
    whole = image_of(dense.fused_by("pmax", df))
    got = np.zeros(whole.shape)
    for r in dense.tiled("pmax", df, 64, 24).collect():
        got[r["y"], r["x"]] = r["v"]
    assert np.abs(got - whole).max() < 0.02 * 255 and similar(got, whole) > 0.99


def test_depth_map_follows_the_ramp(fixture):
    _, depth, frames, df = fixture
    best = fuse.depth_map_winner(df, 4)
    got = np.zeros(depth.shape)
    for r in best.collect():
        got[r["y"], r["x"]] = r["winner"]
    assert np.corrcoef(got.ravel(), depth.ravel())[0, 1] > 0.9


def test_weighted_blend_is_close_to_the_scene(fixture):
    scene, _, frames, df = fixture
    got = np.zeros(scene.shape)
    for r in fuse.weighted_blend(df, 4, 0.05).collect():
        got[r["y"], r["x"]] = r["v"]
    assert similar(got, scene) > 0.93


def test_pyramid_collapses_to_the_image():
    img = noise((70, 90), 1)
    assert np.allclose(dense.collapse(dense.pyramid(img, 2)), img)


def test_diffusion_keeps_known_and_fills():
    known = np.zeros((20, 20), bool)
    known[5:8, 5:8] = True
    out = dense.fill_unknown(np.where(known, 4.0, 99.0), known, 2)
    assert np.allclose(out[known], 4) and np.allclose(out, 4, atol=1e-3)


@pytest.mark.parametrize("shift", [(0, 0), (5, -7), (-3, 11)])
def test_phase_shift(spark, shift):
    img = noise((64, 96), 3)
    moved = np.roll(img, shift, (0, 1))
    assert dense.phase_shift(img, moved)[:2] == tuple(map(float, shift))
    scaled = [((x - img.min()) / np.ptp(img) * 255).astype(int) for x in (img, moved)]
    got = dense.neighbour_shifts(stack(spark, scaled)).collect()
    assert [(r["link"], r["dy"], r["dx"]) for r in got] == [(0, *map(float, shift))]


@pytest.mark.parametrize("bits", [8, 16])
def test_png_round_trip(spark, tmp_path, bits):
    img = np.random.default_rng(2).random((9, 7, 3))
    data = sources.encode_png(img, bits)
    want = np.floor(img * ((1 << bits) - 1) + 0.5).astype(int)
    assert (sources.decode_png(data) == want).all()
    for k in (0, 1):
        (tmp_path / f"{k}.png").write_bytes(data)
    (tmp_path / "x.txt").write_text("no")
    rows = sources.read_png_frames(spark, str(tmp_path)).where("frame = 1").orderBy("y").collect()
    assert (np.array([r["g"] for r in rows]) == want[:, :, 1]).all()
    head = sources.png_headers(spark.read.format("binaryFile").load(str(tmp_path / "0.png"))).first()
    assert (head["is_png"], head["width"], head["height"], head["bit_depth"], head["colour"]) == (True, 7, 9, bits, 2)
    with pytest.raises(ValueError):
        sources.decode_png(b"nonsense")


@pytest.mark.parametrize("bits", [8, 16, 32])
def test_tiff_round_trip(spark, tmp_path, bits):
    img = np.random.default_rng(2).random((9, 7, 3)) * 1.2 - 0.1
    data = sources.encode_tiff(img, bits)
    want = img.astype(np.float32) if bits == 32 else np.floor(np.clip(img, 0, 1) * ((1 << bits) - 1) + 0.5)
    assert (sources.decode_tiff(data) == want).all()
    (tmp_path / "a.tif").write_bytes(data)
    (tmp_path / "b.png").write_bytes(sources.encode_png(img, 8))
    (tmp_path / "c.jpg").write_bytes(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x09\x00\x07\x03" + bytes(12))
    (tmp_path / "d.tif").write_bytes(b"nonsense")
    got = {r["path"][-5:]: r for r in sources.probe(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert [tuple(got[n])[1:6] for n in ("a.tif", "b.png", "c.jpg")] == [("tiff", 7, 9, bits, 3), ("png", 7, 9, 8, 3), ("jpeg", 7, 9, 8, 3)]
    assert got["d.tif"]["width"] is None and got["d.tif"]["error"]
    if bits == 16:
        rows = [(0, y, *([float(v) for v in img[y, :, c]] for c in range(3))) for y in range(9)]
        made = sources.encoded(spark.createDataFrame(rows, "frame int, y int, r array<double>, g array<double>, b array<double>"), "tiff").first()
        assert (bytes(made["content"]), made["height"], made["width"]) == (data, 9, 7)
        (tmp_path / "d.tif").unlink()
        assert sources.read_frames(spark, str(tmp_path)).select("frame").distinct().count() == 2


def test_stateful_streams_equal_batches(spark, tmp_path):
    from focalframe.operators import catalog, retouch

    rnd = np.random.default_rng(4)
    rows = [(f"s{k % 3}", k, int(1_700_000_000 + 4 * k + 30 * (k // 17)), ["apply", "apply", "undo", "redo"][rnd.integers(4)]) for k in range(90)]
    df = spark.createDataFrame(rows, "stack string, frame long, t long, action string").selectExpr("stack", "frame", "timestamp_seconds(t) AS captured", "action", "frame % 4 AS session")
    for part in (0, 1, 2):
        df.where(f"frame div 30 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = lambda q, name: q.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    run(streaming.grouped_by_gaps(stream()), "gaps_now")
    want = catalog.auto_group(df, ["stack"], ["captured", "frame"], "captured", None).select("stack", "frame", "grp")
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(spark.table("gaps_now")) == key(want)
    run(streaming.stroke_history(stream().selectExpr("session", "frame AS seq", "action", "frame AS stroke")), "strokes_now")
    last = spark.table("strokes_now").groupBy("session").agg(F.max_by("n", "seq").alias("n"))
    live = retouch.live_strokes(df.selectExpr("session", "frame AS seq", "action", "frame AS stroke")).groupBy("session").agg(F.count("*").cast("int").alias("n"))
    assert key(last.where("n > 0")) == key(live)


def test_streams_equal_batches(spark, tmp_path):
    rows = [(f, y, x, (f * 7 + y * 3 + x) % 5) for f in range(6) for y in range(4) for x in range(5)]
    df = spark.createDataFrame(rows, "frame int, y int, x int, v bigint")
    df.where("frame < 3").write.parquet(str(tmp_path / "in"))
    df.where("frame >= 3").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streaming.follow_winners(stream, "winners_now", str(tmp_path / "c")).awaitTermination()
    key = lambda d: sorted(map(tuple, d.select("y", "x", "winner", "energy").collect()))
    assert key(spark.table("winners_now")) == key(fuse.winners(df))


def test_registry():
    assert registry.METHODS == ("dmap", "pmax", "slab", "weighted") and len(registry.method("dmap")) == 3
    assert sorted(dense.METHODS) == sorted(registry.METHODS)
    for lookup in (registry.method, lambda name: dense.fused_by(name, None)):
        with pytest.raises(ValueError, match="dmap, pmax"):
            lookup("nope")
