"""Registration against transforms that are known."""

import numpy as np
import pytest
from test_dense import noise
from test_operators import stack

from focalframe.operators import register


def scene(shape=(140, 180), seed=4):
    img = noise(shape, seed) + 3 * noise(shape, seed + 1)
    return (img - img.min()) / np.ptp(img)


def transform(scale, angle, dy, dx, shape):
    return register.about_centre(scale, angle, shape) @ np.array([[1, 0, dx], [0, 1, dy], [0, 0, 1.0]])


def cut(image, m, shape=(96, 128), origin=(22, 26)):
    """A view of the scene through a transform, without borders."""
    shift = np.array([[1, 0, origin[1]], [0, 1, origin[0]], [0, 0, 1.0]])
    return register.moved(image, shift @ m, shape)[0]


@pytest.mark.parametrize("scale, angle, dy, dx", [(1.0, 0.0, 0.0, 0.0), (1.01, 0.01, 2.0, -3.0), (0.985, -0.02, -1.5, 2.5), (1.03, 0.03, 0.0, 1.0)])
def test_pairs_are_recovered(scale, angle, dy, dx):
    image = scene()
    a = cut(image, np.eye(3))
    truth = transform(scale, angle, dy, dx, a.shape)
    b = cut(image, np.linalg.inv(truth))
    m, rho = register.estimate(a, b)
    corners = np.array([[0, 127, 127, 0], [0, 0, 95, 95], [1, 1, 1, 1.0]])
    assert rho > 0.97 and np.abs((m - truth) @ corners).max() < 0.5


def test_scale_and_rotation_have_the_right_signs():
    image = scene((300, 300))
    a = cut(image, np.eye(3), (200, 200), (50, 50))
    b = cut(image, np.linalg.inv(transform(1.08, 0.1, 0, 0, a.shape)), (200, 200), (50, 50))
    scale, angle = register.scale_rotation(a, b)
    assert abs(scale - 1.08) < 0.03 and abs(angle - 0.1) < 0.04


def test_unstable_results_are_refused():
    eye = np.eye(3)
    assert register.stable(eye, eye, (100, 100)) and not register.stable(np.diag([1.1, 1.1, 1]), eye, (100, 100))
    assert not register.stable(np.full((3, 3), np.nan), eye, (100, 100))
    m, rho = register.refine(np.zeros((40, 40)), np.zeros((40, 40)), eye)
    assert rho == 0 and np.allclose(m, eye)
    assert np.allclose(register.similar_to(np.array([[1.1, 0.3, 0], [-0.2, 0.9, 0], [0, 0, 1]]), (1, 1))[0, 0], np.linalg.svd([[1.1, 0.3], [-0.2, 0.9]])[1].mean() * np.cos(np.arctan2(-0.5, 2.0)))


def test_a_stack_is_aligned_and_a_bad_frame_dropped(spark):
    image = scene()
    shape = (96, 128)
    truths = [transform(1 + 0.004 * k, 0.003 * k, 0.5 * k, -0.7 * k, shape) for k in range(5)]
    frames = [np.floor(cut(image, np.linalg.inv(t)) * 255 + 0.5).astype(int) for t in truths]
    df = stack(spark, frames)
    got = {r["frame"]: r for r in register.align(register.proxies(df), 5, 2, 0.9).collect()}
    corners = np.array([[0, 127, 127, 0], [0, 0, 95, 95], [1, 1, 1, 1.0]])
    for k, t in enumerate(truths):
        want = t @ np.linalg.inv(truths[2])
        assert np.abs((np.reshape(got[k]["m"], (3, 3)) - want) @ corners).max() < 1
    frames[1] = np.random.default_rng(1).integers(0, 255, shape)
    got = {r["frame"]: r for r in register.align(stack(spark, frames), 5, 2, 0.9).collect()}
    assert [k for k in range(5) if got[k]["dropped"]] == [1] and got[1]["m"] == [1, 0, 0, 0, 1, 0, 0, 0, 1]
    want = truths[0] @ np.linalg.inv(truths[2])
    assert np.abs((np.reshape(got[0]["m"], (3, 3)) - want) @ corners).max() < 1


def test_proxies_are_never_larger(spark):
    df = stack(spark, [np.arange(60 * 40).reshape(60, 40) % 255])
    assert register.proxies(df).first()["factor"] == 1.0
    small = register.proxies(df, 30)
    assert (small.count(), len(small.first()["row"]), small.first()["factor"]) == (30, 20, 2.0)
