"""Queries over the whole stack against brute force."""

import math

import numpy as np
from conftest import DATA

from focalframe import plans
from focalframe.raster import embedding_frames


def lanczos(d):
    return 1.0 if d == 0 else np.sinc(d) * np.sinc(d / 3) if abs(d) < 3 else 0.0


def test_lanczos_takes_all_frames(spark):
    got = {(r["frame"], r["y"], r["x"]): r["v"] for r in plans.QUERIES["warp_lanczos3_stack"](spark, DATA).collect()}
    frames = {}
    for r in embedding_frames(spark, DATA).orderBy("frame", "y").collect():
        frames.setdefault(r["frame"], []).append(list(r["row"]))
    assert len(frames) == 10 and len(got) == sum(len(f) * 64 for f in frames.values())
    for f, rows in frames.items():
        image, scale = np.array(rows, float), 1 + f * 0.01
        h, w = image.shape
        a, b = scale * math.cos(f * 0.02), scale * math.sin(f * 0.02)
        for y, x in ((0, 0), (h - 1, w - 1), (h // 2, 20), (7 % h, 41)):
            sx = a * x - b * y + 31.5 - a * 31.5 + b * 24.5 + f * 0.5
            sy = b * x + a * y + 24.5 - b * 31.5 - a * 24.5 - f * 0.25
            total = weight = 0.0
            for j in range(-2, 4):
                for i in range(-2, 4):
                    iy, ix = math.floor(sy) + j, math.floor(sx) + i
                    wt = lanczos(sy - iy) * lanczos(sx - ix)
                    total += wt * image[min(max(iy, 0), h - 1), min(max(ix, 0), w - 1)]
                    weight += wt
            assert abs(got[f, y, x] - total / weight) < 2e-4
