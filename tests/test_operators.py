"""Small exact cases and independent numpy versions."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from focalframe.operators import analysis, catalog, fuse, geometry, retouch, select, stencils


def stack(spark, frames):
    rows = [(f, y, [int(v) for v in row], len(img)) for f, img in enumerate(frames) for y, row in enumerate(img)]
    return spark.createDataFrame(rows, "frame int, y int, row array<bigint>, height int")


def image(df, frame=0):
    return np.array([r["row"] for r in df.where(f"frame = {frame}").orderBy("y").collect()])


@pytest.mark.parametrize("shape", [(5, 7), (150, 9)])
def test_stencils_against_numpy(spark, shape):
    img = np.random.default_rng(3).integers(0, 255, shape)
    frames = stack(spark, [img, img[::-1]])
    p = np.pad(img, 1, mode="reflect")
    lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * img
    assert (image(stencils.laplacian(frames)) == lap).all()
    p = np.pad(lap**2, 2, mode="reflect")
    # squares of the mirrored Laplacian equal the Laplacian of the mirrored image
    sharp = sum(p[i : i + shape[0], j : j + shape[1]] for i in range(5) for j in range(5))
    assert (image(stencils.sharpness(frames, 2)) == sharp).all()
    e = np.pad(img, ((1, 1), (0, 0)), mode="edge")
    assert (image(stencils.second_difference(frames)) == abs(2 * img - e[:-2] - e[2:])).all()
    p = np.pad(img, 2, mode="edge")
    med = np.median([p[i : i + shape[0], j : j + shape[1]] for i in range(5) for j in range(5)], axis=0)
    assert (image(stencils.median(frames, 2)) == med).all()
    taps = stencils.gaussian_taps(1.0)
    p = np.pad(img.astype(float), 3, mode="reflect")
    p = sum(w * p[i : i + shape[0]] for i, w in enumerate(taps))
    p = sum(w * p[:, i : i + shape[1]] for i, w in enumerate(taps))
    assert np.allclose(image(stencils.gaussian_blur(frames, 1.0)), p)


def test_constant_images_are_invariant(spark):
    frames = stack(spark, [np.full((12, 12), 50)])
    assert np.allclose(image(stencils.gaussian_blur(frames, 1.5)), 50)
    assert (image(stencils.sharpness(frames, 1)) == 0).all()
    assert np.allclose(image(stencils.upsample(frames, 20, 30)), 50)
    assert np.allclose(image(stencils.downsample2(frames)), 50)


def test_ties_go_to_the_lowest_frame_and_masks_lose(spark):
    df = spark.createDataFrame([(0, 0, 0, 5), (1, 0, 0, 5), (2, 0, 0, 4)], "frame int, y int, x int, v bigint")
    assert fuse.winners(df).first()["winner"] == 0
    masked = df.selectExpr("*", "frame > 0 AS ok")
    assert fuse.winners(masked, valid="ok").first()["winner"] == 1
    assert fuse.winners(df.selectExpr("*", "false AS ok"), valid="ok").first()["winner"] == 0


def test_weighted_mean_of_two_constant_frames(spark):
    frames = stack(spark, [np.full((20, 20), 20), np.full((20, 20), 60)])
    assert all(abs(r["v"] - 40) < 1e-9 for r in fuse.weighted_blend(frames, 2, 0.05).collect())


@pytest.mark.parametrize("n, size, overlap", [(25, 10, 2), (10, 10, 2), (3, 10, 2), (26, 10, 2), (11, 10, 9)])
def test_slabs(spark, n, size, overlap):
    plan = fuse.slab_plan(spark.createDataFrame([(1, n)], "stack int, n bigint"), size, overlap)
    spans = [(r["slab"], r["start_frame"], r["end_frame"]) for r in plan.orderBy("slab").collect()]
    assert spans[0][1] == 0 and spans[-1][2] == n and set(range(n)) == {i for _, a, b in spans for i in range(a, b)}
    assert all(b - a == size for _, a, b in spans[:-1]) and len({b for _, _, b in spans}) == len(spans)
    held = fuse.in_slabs(spark.range(n).selectExpr("cast(id AS int) AS frame"), n, size, overlap)
    assert {(r["slab"], r["frame"]) for r in held.collect()} == {(k, i) for k, a, b in spans for i in range(a, b)}
    with pytest.raises(ValueError):
        fuse.in_slabs(held, n, overlap, overlap)


def test_in_focus_interval(spark):
    """Random curves: the run of frames around the first peak, walked out from it frame by frame."""
    rnd = np.random.default_rng(5)
    curves = [(k, int(rnd.integers(40, 99)), rnd.integers(0, [3, 1000][k % 2], 1 + k % 12).tolist()) for k in range(60)]
    for percent in sorted({p for _, p, _ in curves}):
        mine = {k: c for k, p, c in curves if p == percent}
        got = select.intervals(spark.createDataFrame([(k, 0, c) for k, c in mine.items()], "r int, c int, curve array<bigint>"), percent)
        for row in got.collect():
            curve = mine[row["r"]]
            peak = low = high = curve.index(max(curve))
            while low > 0 and 100 * curve[low - 1] >= percent * curve[peak]:
                low -= 1
            while high < len(curve) - 1 and 100 * curve[high + 1] >= percent * curve[peak]:
                high += 1
            assert (row["peak"], row["lo"], row["hi"]) == (peak, low, high)


def test_cover(spark):
    """Random intervals: every one is met, by no more points than an exhaustive search needs."""
    rnd = np.random.default_rng(6)
    for trial in range(8):
        n, starts = 9, rnd.integers(0, 9, trial)
        spans = [(int(a), int(min(n - 1, a + rnd.integers(0, 4)))) for a in starts]
        df = spark.createDataFrame(spans, "lo int, hi int")
        kept = select.stab_cover(df).first()["kept"]
        meets = lambda points: all(any(a <= p <= b for p in points) for a, b in spans)
        fewest = next(size for size in range(n + 1) if any(meets(points) for points in itertools.combinations(range(n), size)))
        assert meets(kept) and len(kept) == fewest and kept == sorted(kept)
        chosen = select.select_frames(df, n).where("kept").count()
        assert chosen == (fewest if fewest >= 3 else n)


def test_synthetic_rows_cover_the_neighbours(spark):
    cells = spark.createDataFrame([(0, 0, 2, 2, 2), (0, 1, 3, 3, 3)], "r int, c int, peak int, lo int, hi int")
    made = {(r["lo"], r["hi"]) for r in select.coverage_rows(cells, 6).where("kind = 'synthetic'").collect()}
    assert made == {(1, 1), (4, 4)}


def test_neighbour_sums(spark):
    grid = spark.createDataFrame([(0, r, c, 1 if (r, c) == (1, 1) else 0) for r in range(3) for c in range(3)], "frame int, r int, c int, total bigint")
    assert all(r["v"] == 1 for r in select.smooth_curves(grid).collect()) and select.smooth_curves(grid).count() == 9


def test_kurtosis(spark):
    values = [1.0, 2.0, 9.0, 2.0, 1.0]
    d = np.array(values) - np.mean(values)
    got = spark.createDataFrame([(values,), ([3.0, 3.0],)], "curve array<double>").selectExpr(select.kurtosis() + " AS k").collect()
    assert math.isclose(got[0]["k"], (d**4).mean() / (d**2).mean() ** 2 - 3, rel_tol=1e-12) and got[1]["k"] == -3


def test_chain_order(spark):
    pairs = spark.createDataFrame([(k, [float(v) for v in m]) for k, m in enumerate(([1, 0, 5, 0, 1, 0, 0, 0, 1], [2, 0, 0, 0, 2, 0, 0, 0, 1]))], "link int, m array<double>")
    got = {r["frame"]: np.reshape(r["m"], (3, 3)) for r in geometry.chain_to_reference(pairs, 3, 0).collect()}
    a, b = np.array([[1, 0, 5], [0, 1, 0], [0, 0, 1.0]]), np.diag([2, 2, 1.0])
    assert np.allclose(got[2], b @ a) and np.allclose(got[1], a) and np.allclose(got[0], np.eye(3))
    back = {r["frame"]: np.reshape(r["m"], (3, 3)) for r in geometry.chain_to_reference(pairs, 3, 2).collect()}
    assert np.allclose(back[0], np.linalg.inv(a) @ np.linalg.inv(b))


def test_matrix_sql(spark):
    m = [1.1, 0.2, 3.0, -0.1, 0.9, 4.0, 0.001, 0.002, 1.0]
    df = spark.createDataFrame([(m,)], "m array<double>")
    inv = df.selectExpr(geometry.invert("m") + " AS i").first()["i"]
    assert np.allclose(np.reshape(inv, (3, 3)), np.linalg.inv(np.reshape(m, (3, 3))))
    scaled = df.selectExpr(geometry.rescale("m", 2.0) + " AS s").first()["s"]
    s = np.diag([2, 2, 1.0])
    assert np.allclose(np.reshape(scaled, (3, 3)), s @ np.reshape(m, (3, 3)) @ np.linalg.inv(s))


@pytest.mark.parametrize("kernel", ["nearest", "bilinear", "bicubic", "lanczos3"])
def test_identity_and_shift_warps(spark, kernel):
    img = np.arange(30).reshape(5, 6)
    frames = stack(spark, [img, img])
    t = spark.createDataFrame([(k, [float(v) for v in m]) for k, m in enumerate(([1, 0, 0, 0, 1, 0, 0, 0, 1], [1, 0, 1, 0, 1, 0, 0, 0, 1]))], "frame int, m array<double>")
    got = {(r["frame"], r["y"], r["x"]): r["v"] for r in geometry.warp(frames, t, kernel).collect()}
    for y in range(5):
        for x in range(6):
            assert math.isclose(got[0, y, x], img[y, x], abs_tol=1e-9)
            assert math.isclose(got[1, y, x], img[y, min(x + 1, 5)], abs_tol=1e-9)
    mask = {(r["frame"], r["y"], r["x"]): r["valid"] for r in geometry.warp_mask(frames, t).collect()}
    assert all(mask[0, y, x] for y in range(5) for x in range(6)) and not any(mask[1, y, 5] for y in range(5))


def test_bad_links(spark):
    links = spark.createDataFrame([(0, 0.95), (1, 0.5), (2, 0.5), (3, 0.99)], "link int, correlation double")
    assert sorted(r["frame"] for r in geometry.culprits(links, 5, 0.9).collect()) == [2]
    assert sorted(r["frame"] for r in geometry.affected_frames(links, 5, 3, 0.9).collect()) == [0, 1, 2]
    bad = geometry.culprits(links, 5, 0.9)
    assert geometry.nearest_good(bad, 5, 2).first()["ref"] == 1
    flagged, dropped = geometry.flagged_and_dropped(geometry.affected_frames(links, 5, 3, 0.9), spark.createDataFrame([(0,)], "frame int"), bad, 3)
    assert sorted(r["frame"] for r in flagged.collect()) == [1, 2] and [r["frame"] for r in dropped.collect()] == [2]


def test_histogram_case(spark):
    vals = [("r", v) for v in np.linspace(0, 1, 20)] + [("g", 0.5)] * 20 + [("b", 1.0)] * 20 + [("b", float("nan"))]
    df = spark.createDataFrame([(s, float(v)) for s, v in vals], "series string, v double")
    h = {(r["series"], r["bin"]): r["n"] for r in analysis.histogram(df).collect()}
    assert len(h) == 3 * 256 and h["g", 128] == 20 and h["b", 255] == 20 and sum(n for (s, _), n in h.items() if s == "r") == 20
    c = {r["series"]: (r["shadows"], r["highlights"]) for r in analysis.clip_counts(df.where("NOT isnan(v)")).collect()}
    assert c == {"r": (1, 1), "g": (0, 0), "b": (0, 20)}


@pytest.mark.parametrize("value, want", [(1e-9, 64.0), (100.0, 0.25), (0.0, 1.0)])
def test_exposure_gain_clamps(spark, value, want):
    assert analysis.exposure_gain(spark.createDataFrame([(value,)] * 4, "luma double")).first()["gain"] == want


def test_camera_matrix(spark):
    given = [np.linalg.inv(np.array(analysis.SRGB_TO_XYZ)).ravel().tolist(), [0.0] * 9, None, [1.0, float("nan")] + [0.5] * 7, [1.0], [0.8, 0.1, 0.05, 0.2, 1.1, -0.1, 0.02, 0.1, 0.7]]
    df = spark.createDataFrame([*enumerate(given)], "i int, m array<double>").withColumn("out", F.expr("m"))
    got = {r["i"]: r["c"] for r in df.select("i", analysis.camera_to_srgb("m").alias("c")).collect()}
    assert np.allclose(np.reshape(got[0], (3, 3)), np.eye(3), atol=1e-6) and [got[i] for i in range(1, 5)] == [None] * 4
    cam = np.reshape(given[5], (3, 3)) @ np.array(analysis.SRGB_TO_XYZ)
    assert np.allclose(np.reshape(got[5], (3, 3)) @ (cam / cam.sum(1, keepdims=True)), np.eye(3))


@pytest.mark.parametrize(
    "rows, sizes",
    [
        ([("a1.tif", "2024:01:01 12:00:00"), ("a2.tif", "2024:01:01 12:00:04"), ("a3.tif", "2024:01:01 12:00:20")], [2, 1]),
        ([("001.tif", None), ("002.tif", None), ("010.tif", None)], [2, 1]),
        ([("9.tif", None), ("1.tif", None), ("x.tif", None), ("50.tif", None)], [4]),
        ([("1.tif", "2024:01:01 12:00:00"), ("2.tif", "bad"), ("3.tif", "2024:01:01 13:00:00")], [3]),
    ],
)
def test_auto_group(spark, rows, sizes):
    df = spark.createDataFrame([(1, i, n, t) for i, (n, t) in enumerate(rows)], "p int, o int, name string, captured string")
    df = df.withColumn("t", catalog.capture_time("captured")).withColumn("n", catalog.trailing_number("name"))
    g = [r["grp"] for r in catalog.auto_group(df, ["p"], ["o"], "t", "n").orderBy("o").collect()]
    assert [g.count(k) for k in sorted(set(g))] == sizes


def test_adding_and_removing_frames(spark):
    have = spark.createDataFrame([("a", 0), ("b", 1)], "path string, ordinal int")
    new = spark.createDataFrame([("c", 0), ("b", 1), ("d", 2), ("c", 3)], "path string, ordinal int")
    out = catalog.add_frames(have, new).orderBy("ordinal").collect()
    assert [(r["path"], r["ordinal"]) for r in out] == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    assert [r["path"] for r in catalog.remove_frames(have, new).collect()] == ["a"]


def test_names_and_labels(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, f"n{i}") for i in range(10)], "ordinal int, name string")
    assert catalog.first_names(df).first()["label"] == "n0, n1, n2, n3, n4, n5, n6, n7 (+2 more)"
    got = spark.range(1).select(catalog.export_name("{stack_name}/{nope}:{seq}", stack_name=F.lit("a?b"), seq=F.lit("001")).alias("n")).first()["n"]
    assert got == "a_b_{nope}_001"


def test_strokes_and_undo(spark):
    s = spark.createDataFrame([(1, [(40.0, 32.0, 1.0)], 12.0, 0.5, 1.0, "paint", 1), (2, [(1.0, 1.0, 1.0)], 0.2, 0.5, 1.0, "paint", 1)], "seq bigint, points array<struct<x:double,y:double,p:double>>, radius double, hardness double, opacity double, mode string, source int")
    base = spark.range(64 * 80).selectExpr("cast(id div 80 AS int) y", "cast(id % 80 AS int) x", "0D v")
    source = base.selectExpr("1 AS source", "y", "x", "1D s")
    out = {(r["y"], r["x"]): r["v"] for r in retouch.retouched(base, s, source, 64, 80).collect()}
    assert out[32, 40] > 0.5 and out[0, 0] == 0 and len(out) == 64 * 80
    line = spark.createDataFrame([(1, [(0.0, 0.0, 1.0), (10.0, 0.0, 0.0)], 8.0, 0.5)], "seq bigint, points array<struct<x:double,y:double,p:double>>, radius double, hardness double")
    assert [r["x"] for r in retouch.dabs(line).orderBy("k").collect()] == [0, 2, 4, 6, 8, 10]


def test_live_strokes_against_replay(spark):
    import random

    rnd, log = random.Random(5), []
    for session in range(5):
        log += [(session, i, rnd.choice(["apply", "apply", "undo", "redo"]), session * 100 + i) for i in range(40)]
    want = {}
    for session in range(5):
        done, undone = [], []
        for s, _, action, stroke in log:
            if s != session:
                continue
            if action == "apply":
                done.append(stroke)
                undone.clear()
            elif action == "undo" and done:
                undone.append(done.pop())
            elif action == "redo" and undone:
                done.append(undone.pop())
        want[session] = done
    rows = retouch.live_strokes(spark.createDataFrame(log, "session int, seq int, action string, stroke bigint")).orderBy("session", "position").collect()
    assert {s: [r["stroke"] for r in rows if r["session"] == s] for s in range(5)} == want


@pytest.mark.parametrize("height, width", [(60, 100), (33, 70), (9, 7)])
def test_tiles_are_triangle_means(spark, height, width):
    img = np.random.default_rng(3).integers(0, 255, (height, width))
    df = spark.createDataFrame([(y, [int(v) for v in row]) for y, row in enumerate(img)], "y int, row array<bigint>")
    levels = retouch.viewer_levels(width, height, 16)
    got = {}
    for r in retouch.tile_rows(df, height, width, 16).collect():
        got[r["z"], r["ty"] * 16 + r["dy"], r["tx"]] = r["row"]
    for z, w, h in levels:
        want = retouch.triangle(height, h) @ img @ retouch.triangle(width, w).T
        have = np.array([sum((got[z, y, t] for t in range(-(-w // 16))), []) for y in range(h)])
        assert np.allclose(have, want)
    assert np.allclose([r["row"] for r in retouch.thumbnail(df, height, width, 16).orderBy("y").collect()], retouch.triangle(height, max(1, int(height * min(1, 16 / max(height, width))))) @ img @ retouch.triangle(width, max(1, int(width * min(1, 16 / max(height, width))))).T)
