"""Polish by sums over bands against the single-task steps, and transforms planted in textures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from focalframe.operators import register


def texture(height, width, seed=0, sigma=2.5):
    """Smooth noise around 128 with a margin that warps may sample."""
    rnd = np.random.default_rng(seed)
    fy, fx = np.fft.fftfreq(height)[:, None], np.fft.fftfreq(width)[None]
    smooth = np.fft.ifft2(np.fft.fft2(rnd.normal(size=(height, width))) * np.exp(-2 * (np.pi * sigma) ** 2 * (fy**2 + fx**2))).real
    return 128 + 40 * smooth / smooth.std()


def planted(m, height, width, seed=0):
    """(a, b) with a(p) = b(m p): ``b`` is a smooth image, ``a`` samples it bilinearly from four times its resolution."""
    fine = texture(4 * height, 4 * width, seed, 10)
    b = fine[::4, ::4]
    y, x = np.mgrid[:height, :width].astype(float)
    sx, sy, depth = np.tensordot(m, np.stack([x, y, np.ones_like(x)]), 1)
    at = np.clip(4 * sy / depth, 0, 4 * height - 1.001), np.clip(4 * sx / depth, 0, 4 * width - 1.001)
    return register.sampled(fine, *at)[0], b


def rows(spark, images):
    made = [(k, y, image[y].tolist(), len(image)) for k, image in enumerate(images) for y in range(len(image))]
    return spark.createDataFrame(made, "frame int, y int, row array<double>, height int").repartition(3)


def far(m, want, height, width):
    """Greatest distance between the images of the corners."""
    corners = np.array([(x, y, 1.0) for x in (0, width - 1) for y in (0, height - 1)])
    p, q = (corners @ t.T for t in (m, want))
    return np.hypot(*(p[:, :2] / p[:, 2:] - q[:, :2] / q[:, 2:]).T).max()


MOTIONS = {
    "translation": np.array([[1, 0, 1.7], [0, 1, -2.3], [0, 0, 1]]),
    "affine": np.array([[1.01, -0.015, 1.2], [0.012, 0.99, -0.8], [0, 0, 1]]),
    "perspective": np.array([[1.004, -0.006, 1.5], [0.005, 0.997, -1.1], [0.00012, -0.00009, 1]]),
}


@pytest.mark.parametrize("model", list(MOTIONS))
def test_sums_over_bands_equal_the_single_task(spark, model):
    height, width = 70, 90
    a, b = planted(MOTIONS[model], height, width)
    start = np.eye(3)
    want, rho = register.correlate(a / 255, b / 255, start, model, steps=10)
    starts = spark.createDataFrame([(5, 0, 1, start.ravel().tolist())], "link int, a int, b int, m array<double>")
    for band in (64, 9):
        got = register.polish(rows(spark, [a, b]), starts, model, 10, band).first()
        assert np.allclose(np.reshape(got["m"], (3, 3)), want, atol=1e-9) and abs(got["correlation"] - rho) < 1e-9
    assert far(want, MOTIONS[model], height, width) < 0.1 and rho > 0.99


def test_homography_is_recovered():
    height, width = 160, 192
    a, b = planted(MOTIONS["perspective"], height, width, 9)
    m, rho = register.estimate(a / 255, b / 255, "perspective")
    assert far(m, MOTIONS["perspective"], height, width) < 0.1 and rho > 0.98 and m[2, 2] == 1
    assert abs(m[2, 0]) > 1e-5 and abs(m[2, 1]) > 1e-5
    # A similarity cannot follow it.
    assert far(register.estimate(a / 255, b / 255)[0], MOTIONS["perspective"], height, width) > 0.5


def test_translation_keeps_its_linear_part():
    a, b = planted(np.array([[1, 0, 6.4], [0, 1, -3.6], [0, 0, 1]]), 96, 80, 3)
    m, rho = register.estimate(a / 255, b / 255, "translation")
    assert (m[:2, :2] == np.eye(2)).all() and np.abs(m[:2, 2] - (6.4, -3.6)).max() < 0.05 and rho > 0.99
    with pytest.raises(ValueError, match="unknown model"):
        register.estimate(a, b, "elastic")


def test_links_of_several_frames_and_without_texture(spark):
    height, width = 60, 70
    a, b = planted(MOTIONS["affine"], height, width, 4)
    flat = np.full((height, width), 9.0)
    frames = rows(spark, [a, b, flat, b[:50]])
    eye = np.eye(3).ravel().tolist()
    far_off = np.array([[1, 0, 500.0], [0, 1, 0], [0, 0, 1]]).ravel().tolist()
    starts = [(0, 0, 1, eye), (1, 1, 0, eye), (2, 0, 2, eye), (3, 0, 1, far_off), (4, 0, 3, eye)]
    got = {r["link"]: r for r in register.polish(frames, spark.createDataFrame(starts, "link int, a int, b int, m array<double>")).collect()}
    forth, back = (np.reshape(got[k]["m"], (3, 3)) for k in (0, 1))
    assert far(forth, MOTIONS["affine"], height, width) < 0.1 and far(forth @ back, np.eye(3), height, width) < 0.2
    assert all(got[k]["correlation"] is None and got[k]["m"] == dict((s[0], s[3]) for s in starts)[k] for k in (2, 3, 4))
    assert register.polish(frames, spark.createDataFrame([], "link int, a int, b int, m array<double>")).count() == 0


@pytest.mark.parametrize("model", ["similarity", "translation"])
def test_polish_betters_the_proxy(spark, model):
    height, width = 120, 150
    c, s = 1.008 * np.cos(0.006), 1.008 * np.sin(0.006)
    want = MOTIONS["translation"] if model == "translation" else np.array([[c, -s, 2.2], [s, c, -1.4], [0, 0, 1]])
    a, b = planted(want, height, width, 6)
    frames = rows(spark, [a, b * 0.5])
    pairs = spark.createDataFrame([(0, 0, 1)], "link int, a int, b int")
    coarse = register.estimate_pairs(register.proxies(frames, 50), pairs, model).first()
    scaled = np.diag([3, 3, 1.0]) @ np.reshape(coarse["m"], (3, 3)) @ np.diag([1 / 3, 1 / 3, 1.0])
    got = register.estimate_full(frames, pairs, model, 50).first()
    m = np.reshape(got["m"], (3, 3))
    assert far(m, want, height, width) < 0.1 and far(m, want, height, width) <= far(scaled, want, height, width)
    assert abs(got["gain"] - 2) < 0.05 and got["correlation"] > 0.99


def test_a_tall_frame_whose_start_fits_only_at_one_end(spark):
    height, width = 2000, 64
    want = np.array([[1.004, -0.003, 0.3], [0.002, 0.98, 0.35], [0, 0, 1]])
    a, b = planted(want, height, width, 8)
    # At the other end the start is off by 40 pixels.
    starts = spark.createDataFrame([(0, 0, 1, np.eye(3).ravel().tolist())], "link int, a int, b int, m array<double>")
    got = register.polish(rows(spark, [a, b]), starts).first()
    assert far(np.reshape(got["m"], (3, 3)), want, height, width) < 0.1 and got["correlation"] > 0.98


def test_proxies_of_slim_frames_keep_their_width(spark):
    a, b = planted(MOTIONS["translation"], 4000, 32, 5)
    frames = rows(spark, [a, b])
    size = register.proxies(frames, 1024).agg(F.max("height"), F.max(F.size("row")), F.max("factor")).first()
    assert tuple(size) == (4000, 32, 1.0)
    # The shorter edge stays at 128 / SLIM.
    assert tuple(register.proxies(frames, 128).agg(F.max("height"), F.max(F.size("row"))).first()) == (500, 4)
    pairs = spark.createDataFrame([(0, 0, 1)], "link int, a int, b int")
    found = register.estimate_pairs(register.proxies(frames, 1024), pairs).first()
    assert far(np.reshape(found["m"], (3, 3)), MOTIONS["translation"], 4000, 32) < 0.5


def test_a_slim_frame_keeps_the_scale_along_it():
    m = np.array([[1.0002, -1e-6, 0.4], [3e-4, 1.000001, -0.3], [0, 0, 1]])
    for shape in ((10200, 64), (64, 10200)):
        a = m if shape[0] > shape[1] else m[[1, 0, 2]][:, [1, 0, 2]]
        assert far(register.similar_to(a, shape), a, *shape) < 0.05


def test_stability_of_a_refinement():
    shape, start = (100, 200), np.array([[1.02, -0.01, 4], [0.01, 1.02, -3], [0, 0, 1]])
    grown, moved = (np.array(x) for x in ([[1.06, 0, 0], [0, 1.06, 0], [0, 0, 1]], [[1, 0, 7.5], [0, 1, 7.5], [0, 0, 1]]))
    assert register.stable(start, start, shape) and not register.stable(grown @ start, start, shape)
    assert register.stable(moved @ start, start, shape) and not register.stable(np.diag([1, 1, 1.0]) + np.array([[0, 0, 12.0], [0, 0, 0], [0, 0, 0]]), np.eye(3), shape)
    assert not register.stable(np.full((3, 3), np.nan), start, shape) and not register.stable(np.diag([1e-9, 1e-9, 1]), np.diag([1e-9, 1e-9, 1]), shape)
