"""Registration of frames: a guess from spectra, refinement by enhanced correlation (Evangelidis and Psarakis 2008), chains to a reference.

Pairs of proxies (bounded in size) are the unit of work; pairs spread over tasks. Transforms are arrays of nine that take a pixel of the first frame
of a pair to the second.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..raster import BAND
from . import geometry, stencils
from .dense import _dense, halve, phase_shift

#: Side of log-polar maps, pyramid levels, steps and tolerance of a level, least correlation without a second try, largest
#: change of scale and of corners (as a share of the diagonal) by refinement, plausible scales.
SIDE, LEVELS, STEPS, TOLERANCE, RETRY, CHANGE, PLAUSIBLE = 256, 3, 100, 1e-5, 0.5, 0.05, (0.8, 1.25)

#: How many times as long as wide a frame may be to be judged by its longer edge alone.
SLIM = 32


def proxies(frames: DataFrame, longest: int = 2048) -> DataFrame:
    """(frame, y, row, height, factor): frames whose longer edge is at most ``longest``, never enlarged; all frames have one size.

    Frames more than ``SLIM`` times as long as wide would keep too few pixels across: their shorter edge stays at ``longest`` / ``SLIM`` as far as they get no
    more pixels than a square proxy has.
    """
    size = frames.agg(F.max("height"), F.max(F.size("row"))).first()
    edge, slim = max(size[0] or 0, size[1] or 0), max(size[0] or 0, size[1] or 0) / max(min(size[0] or 0, size[1] or 0), 1)
    if slim > SLIM:
        longest = longest * min(slim / SLIM, slim**0.5)
    if edge <= longest:
        return frames.select("frame", "y", F.col("row").cast("array<double>").alias("row"), "height", F.lit(1.0).alias("factor"))
    h, w = (max(1, round(n * longest / edge)) for n in size)
    return stencils.upsample(frames, h, w).select("frame", "y", F.col("row").cast("array<double>").alias("row"), "height", F.lit(edge / max(h, w)).alias("factor"))


def sampled(image: np.ndarray, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bilinear samples, and where all four neighbours are inside; 0 elsewhere."""
    h, w = image.shape
    inside = (y >= 0) & (x >= 0) & (y <= h - 1) & (x <= w - 1)
    y, x = np.where(inside, y, 0.0), np.where(inside, x, 0.0)
    top, left = np.minimum(y.astype(int), max(h - 2, 0)), np.minimum(x.astype(int), max(w - 2, 0))
    fy, fx = y - top, x - left
    below, right = np.minimum(top + 1, h - 1), np.minimum(left + 1, w - 1)
    rows = image[top, left] * (1 - fx) + image[top, right] * fx, image[below, left] * (1 - fx) + image[below, right] * fx
    return (rows[0] * (1 - fy) + rows[1] * fy) * inside, inside


def log_polar(image: np.ndarray, radii: int = SIDE, angles: int = SIDE) -> np.ndarray:
    """Rows of growing radius (geometric, from 1 to the corner) and columns of angles about the centre; 0 outside."""
    cy, cx = ((n - 1) / 2 for n in image.shape)
    rho = np.exp(np.arange(radii) * np.log(np.hypot(cy, cx) + 1e-6) / radii)[:, None]
    turn = np.arange(angles) * (2 * np.pi / angles)
    return sampled(image, cy + rho * np.sin(turn), cx + rho * np.cos(turn))[0]


def scale_rotation(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """(scale, angle) from ``a`` to ``b``, by phase correlation of the log-polar maps of their spectra; scales beyond a factor of 2 count as 1.

    A spectrum shrinks as its image grows, so the shift along the logarithmic radius is minus the logarithm of the scale.
    """
    spectra = [np.log1p(np.abs(np.fft.fftshift(np.fft.fft2(x * np.hanning(len(x))[:, None] * np.hanning(x.shape[1]))))) for x in (a, b)]
    down, across, _ = phase_shift(*(log_polar(s) for s in spectra))
    step = np.log(np.hypot(*((n - 1) / 2 for n in a.shape)) + 1e-6) / SIDE
    scale = float(np.exp(-down * step))
    angle = across * 2 * np.pi / SIDE
    # Spectra of real images repeat after half a turn.
    angle = (angle + np.pi / 2) % np.pi - np.pi / 2
    return (scale if 0.5 < scale < 2 else 1.0), float(angle)


def about_centre(scale: float, angle: float, shape: tuple[int, int]) -> np.ndarray:
    cy, cx = ((n - 1) / 2 for n in shape)
    c, s = scale * np.cos(angle), scale * np.sin(angle)
    return np.array([[c, -s, cx - c * cx + s * cy], [s, c, cy - s * cx - c * cy], [0, 0, 1]])


def moved(image: np.ndarray, m: np.ndarray, shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    y, x = np.mgrid[: shape[0], : shape[1]]
    depth = m[2, 0] * x + m[2, 1] * y + m[2, 2]
    depth = np.where(np.abs(depth) < 1e-8, 1e-8, depth)
    return sampled(image, (m[1, 0] * x + m[1, 1] * y + m[1, 2]) / depth, (m[0, 0] * x + m[0, 1] * y + m[0, 2]) / depth)


def guess(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A similarity from ``a`` to ``b``: scale and rotation first, then the shift that is left."""
    turn = about_centre(*scale_rotation(a, b), a.shape)
    dy, dx, _ = phase_shift(a, moved(b, turn, a.shape)[0])
    return turn @ np.array([[1, 0, dx], [0, 1, dy], [0, 0, 1.0]])


def similar_to(m: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """The similarity nearest to an affine transform that keeps the image of the centre; for slim frames the nearest over their pixels.

    Across a slim frame scale and rotation are hardly determined, along it to a fraction of a pixel at its ends; the mean of both would lose that.
    """
    (a, b), (c, d) = m[:2, :2]
    across = shape[1] ** 2 / (shape[0] ** 2 + shape[1] ** 2) if max(shape) > SLIM * min(shape) else 0.5
    turn = complex(across * a + (1 - across) * d, across * c - (1 - across) * b)
    scale = max(abs(turn), abs(complex(a - d, b + c)) / 2)
    unit = turn / abs(turn) * scale if abs(turn) else complex(scale)
    out = np.array([[unit.real, -unit.imag, 0], [unit.imag, unit.real, 0], [0, 0, 1.0]])
    centre = np.array([(shape[1] - 1) / 2, (shape[0] - 1) / 2])
    out[:2, 2] = m[:2, 2] + (m[:2, :2] - out[:2, :2]) @ centre
    return out


#: Numbers that each model of motion has; an affine transform serves similarities, which are projected from it.
MODELS = {"translation": 2, "affine": 6, "perspective": 8}


def centring(shape: tuple[int, int]) -> np.ndarray:
    """Takes pixels to coordinates about the centre of a frame, with its longer half as unit; normal equations are well conditioned in them."""
    half = max(*shape, 2) / 2
    return np.array([[1 / half, 0, -(shape[1] - 1) / 2 / half], [0, 1 / half, -(shape[0] - 1) / 2 / half], [0, 0, 1]])


def derivatives(model: str, m: np.ndarray, x: np.ndarray, y: np.ndarray, gx: np.ndarray, gy: np.ndarray) -> np.ndarray:
    """(samples, parameters): how the moved samples change with the parameters of ``m``, at the points (x, y) with the gradients (gx, gy) there."""
    if model == "translation":
        return np.stack([gx, gy], axis=1)
    if model == "affine":
        return np.stack([gx * x, gx * y, gx, gy * x, gy * y, gy], axis=1)
    px, py, depth = m @ np.stack([x, y, np.ones_like(x)])
    gx, gy = gx / depth, gy / depth
    along = -(gx * px + gy * py) / depth
    return np.stack([gx * x, gx * y, gx, gy * x, gy * y, gy, along * x, along * y], axis=1)


def partial_sums(t: np.ndarray, w: np.ndarray, g: np.ndarray) -> np.ndarray:
    """All that a step needs to know of some samples, additive over bands: counts, sums and products of the fixed samples t, the moved ones w and the derivatives g."""
    plain = np.array([len(t), t.sum(), w.sum(), t @ t, w @ w, t @ w])
    return np.concatenate([plain, g.sum(0), t @ g, w @ g, (g.T @ g).ravel()])


def plain_correlation(sums: np.ndarray) -> float:
    """The correlation that partial sums stand for; 0 without overlap or texture."""
    n, st, sw, tt, ww, tw = sums[:6]
    if n < 16:
        return 0.0
    norm = np.sqrt(max(tt - st * st / n, 0.0) * max(ww - sw * sw / n, 0.0))
    return float((tw - st * sw / n) / norm) if norm > 1e-12 * n else 0.0


def ascent(sums: np.ndarray, p: int) -> tuple[np.ndarray | None, float]:
    """(step, correlation) from the sums over all samples; no step where the images have no overlap or texture.

    With zero-mean t, w and g a step is the least-squares solution of g p = l t - w, where l makes the step ascend.
    """
    n, st, sw, tt, ww, tw = sums[:6]
    if n < 16:
        return None, np.nan
    sg, gt, gw = sums[6 : 6 + 3 * p].reshape(3, p)
    gg = sums[6 + 3 * p :].reshape(p, p) - np.outer(sg, sg) / n
    tt, ww, tw, gt, gw = tt - st * st / n, ww - sw * sw / n, tw - st * sw / n, gt - sg * st / n, gw - sg * sw / n
    norm = np.sqrt(max(tt, 0.0) * max(ww, 0.0))
    if not norm > 1e-12 * n:
        return None, np.nan
    try:
        fit_t, fit_w = np.linalg.solve(gg, np.stack([gt, gw], axis=1)).T
    except np.linalg.LinAlgError:
        return None, np.nan
    below = tw - gt @ fit_w
    lift = (ww - gw @ fit_w) / below if below > 0 else 1.0
    return lift * fit_t - fit_w, float(tw / norm)


def moved_by(m: np.ndarray, step: np.ndarray, model: str) -> np.ndarray:
    """``m`` after a step; a perspective transform is divided by its last element."""
    m = m.copy()
    if model == "translation":
        m[:2, 2] += step
    elif model == "affine":
        m[:2] += step.reshape(2, 3)
    else:
        m = (m.ravel() + np.append(step, 0.0)).reshape(3, 3)
        m = m / m[2, 2] if abs(m[2, 2]) > 1e-8 else np.full((3, 3), np.nan)
    return m


def correlate(a: np.ndarray, b: np.ndarray, m: np.ndarray, model: str = "affine", steps: int = STEPS) -> tuple[np.ndarray, float]:
    """A transform near ``m`` that maximises the correlation of ``a`` with the moved ``b``, and that correlation; nan where the images have no overlap or texture."""
    to, rho = centring(a.shape), np.nan
    back = np.linalg.inv(to)
    y, x = np.mgrid[: a.shape[0], : a.shape[1]].astype(float)
    gy, gx = np.gradient(b)
    for _ in range(steps):
        w, inside = moved(b, m, a.shape)
        unit = to @ np.stack([x[inside], y[inside], np.ones(inside.sum())])
        slopes = (moved(g, m, a.shape)[0][inside] * back[0, 0] for g in (gx, gy))
        step, found = ascent(partial_sums(a[inside], w[inside], derivatives(model, to @ m @ back, unit[0], unit[1], *slopes)), MODELS[model])
        if step is None:
            return m, np.nan
        before, rho = rho, found
        m = back @ moved_by(to @ m @ back, step, model) @ to
        if model == "perspective":
            m = m / m[2, 2]
        if not np.isfinite(m).all() or abs(rho - before) < TOLERANCE:
            break
    return m, rho


def coarse_to_fine(a: np.ndarray, b: np.ndarray, m: np.ndarray, levels: int, model: str = "affine") -> tuple[np.ndarray, float]:
    """``correlate`` from the coarsest of ``levels`` levels to the finest."""
    pyramid = [(a, b)]
    for _ in range(levels - 1):
        pyramid.append((halve(pyramid[-1][0]), halve(pyramid[-1][1])))
    rho = np.nan
    for k in range(levels - 1, -1, -1):
        scale = np.diag([2.0**k, 2.0**k, 1.0])
        found, rho = correlate(*pyramid[k], np.linalg.inv(scale) @ m @ scale, model)
        if np.isfinite(rho) and np.isfinite(found).all():
            m = scale @ found @ np.linalg.inv(scale)
    return m, rho


def stable(m: np.ndarray, start: np.ndarray, shape: tuple[int, int]) -> bool:
    """Whether refinement stayed near its start: what leads from one transform to the other hardly scales, and hardly moves the corners of a frame."""
    if not np.isfinite(m).all() or min(abs(np.linalg.det(x)) for x in (m, start)) < 1e-16:
        return False
    between = m @ np.linalg.inv(start)
    corners = np.array([(x, y, 1.0) for x in (0, shape[1] - 1) for y in (0, shape[0] - 1)])
    drift = corners @ (between - np.eye(3))[:2].T
    return bool(abs(abs(np.linalg.det(between)) ** 0.5 - 1) <= CHANGE and np.hypot(*drift.T).max() <= CHANGE * np.hypot(*shape))


def refine(a: np.ndarray, b: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float]:
    """The refined similarity and its correlation.

    Where that is unstable or correlates badly, the other direction and then the finest level alone are tried too, and the stable
    result of the greatest correlation counts; without one the start, with correlation 0.
    """
    start = similar_to(start, a.shape)
    tried = []
    for attempt in range(3):
        if attempt == 1:
            m, rho = coarse_to_fine(b, a, np.linalg.inv(start), LEVELS)
            m = np.linalg.inv(similar_to(m, b.shape)) if np.isfinite(m).all() and abs(np.linalg.det(m)) > 1e-12 else m
        else:
            m, rho = coarse_to_fine(a, b, start, LEVELS if attempt == 0 else 1)
            m = similar_to(m, a.shape)
        if np.isfinite(rho) and stable(m, start, a.shape):
            tried.append((rho, attempt, m))
        if tried and max(tried)[0] >= RETRY:
            break
    best = max(tried, key=lambda r: (r[0], -r[1]), default=(0.0, 0, start))
    return best[2], float(best[0])


def believable(m: np.ndarray, model: str, shape: tuple[int, int]) -> bool:
    """Whether a transform is one that frames of a stack can have: a scale near 1; for a perspective one corners that move by less than half the diagonal."""
    if not np.isfinite(m).all() or abs(np.linalg.det(m)) <= 1e-8:
        return False
    if model != "perspective":
        return bool(PLAUSIBLE[0] < abs(np.linalg.det(m[:2, :2])) ** 0.5 < PLAUSIBLE[1])
    corners = np.array([(x, y, 1.0) for x in (0, shape[1] - 1) for y in (0, shape[0] - 1)])
    far = corners @ m.T
    return bool(np.abs(far[:, 2]).min() > 1e-6 and np.hypot(*(far[:, :2] / far[:, 2:] - corners[:, :2]).T).max() < np.hypot(*shape) / 2)


def estimate(a: np.ndarray, b: np.ndarray, model: str = "similarity") -> tuple[np.ndarray, float]:
    """Guess and refinement of a pair of equal shape by a translation, similarity or perspective transform; an implausible result gives the guess with correlation 0."""
    if model == "translation":
        dy, dx, _ = phase_shift(a, b)
        start = np.array([[1, 0, dx], [0, 1, dy], [0, 0, 1.0]])
        m, rho = coarse_to_fine(a, b, start, LEVELS, model)
    elif model == "perspective":
        start = guess(a, b)
        # The similarity is a start from which the two terms of depth have little way to go.
        near, _ = refine(a, b, start)
        m, rho = coarse_to_fine(a, b, near, LEVELS, model)
    elif model == "similarity":
        start = guess(a, b)
        m, rho = refine(a, b, start)
    else:
        raise ValueError(f"unknown model of motion {model!r}; known are translation, similarity and perspective")
    return (m, float(rho)) if np.isfinite(rho) and believable(m, model, a.shape) else (start, 0.0)


def estimate_pairs(frames: DataFrame, pairs: DataFrame, model: str = "similarity") -> DataFrame:
    """(link, m, correlation) for ``pairs(link, a, b)`` of ``frames(frame, y, row, height)`` (proxies) by a ``model`` of motion; pairs of different shapes give none."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        first, second = (table.filter(pc.equal(table["side"], side)).sort_by("y") for side in (0, 1))
        made = []
        if first.num_rows and second.num_rows:
            a, b = (_dense(t).astype(float) / 255 for t in (first, second))
            if a.shape == b.shape and min(a.shape) >= 16:
                m, rho = estimate(a, b, model)
                made = [(key[0].as_py(), m.ravel().tolist(), rho)]
        columns = list(zip(*made)) or [[], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.list_(pa.float64()), pa.float64()))], names=["link", "m", "correlation"])

    sides = pairs.select("link", F.explode(F.array(F.struct(F.col("a").alias("frame"), F.lit(0).alias("side")), F.struct(F.col("b").alias("frame"), F.lit(1).alias("side")))).alias("s")).select("link", "s.frame", "s.side")
    return frames.select("frame", "y", "row").join(F.broadcast(sides), "frame").groupBy("link").applyInArrow(run, "link int, m array<double>, correlation double")


def _halo_rows(m: str, band: int) -> str:
    """SQL for the rows of the second frame, as an array, that a band of the first one needs: the band's corners moved, and a row more than the samples' gradients touch."""
    first, last = f"(band * {band})", f"least((band + 1) * {band}, height) - 1"
    depth = f"({m}[6] * c.x + {m}[7] * c.y + {m}[8])"
    rows = f"transform(array(struct(0D AS x, cast({first} AS double) AS y), struct(width - 1D AS x, cast({first} AS double) AS y), struct(0D AS x, cast({last} AS double) AS y), struct(width - 1D AS x, cast({last} AS double) AS y)), c -> ({m}[3] * c.x + {m}[4] * c.y + {m}[5]) / {depth})"
    low, high = f"cast(greatest(0, floor(array_min({rows})) - 2) AS int)", f"cast(least(height - 1, floor(array_max({rows})) + 3) AS int)"
    return f"CASE WHEN {low} <= {high} THEN sequence({low}, {high}) ELSE cast(array() AS array<int>) END"


def _band_sums(model: str, p: int):
    """Partial sums of a band, and how telling its correlation is: its rows of the first frame (side 0) and the rows around it of the second (side 1)."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        link, band = (k.as_py() for k in key)
        out, fit = np.zeros(6 + 3 * p + p * p), -1.0
        first, second = (table.filter(pc.equal(table["side"], side)).sort_by("y") for side in (0, 1))
        if first.num_rows and second.num_rows:
            m, height = np.array(table["m"][0].as_py()).reshape(3, 3), table["height"][0].as_py()
            a, b = (_dense(t).astype(float) / 255 for t in (first, second))
            top, width = second["y"][0].as_py(), a.shape[1]
            to = centring((height, width))
            back = np.linalg.inv(to)
            x, y = (v.ravel() for v in np.meshgrid(np.arange(width, dtype=float), first["y"].to_numpy().astype(float)))
            sx, sy, depth = m @ np.stack([x, y, np.ones_like(x)])
            depth = np.where(np.abs(depth) < 1e-8, 1e-8, depth)
            sx, sy = sx / depth, sy / depth
            inside = (sy >= 0) & (sx >= 0) & (sy <= height - 1) & (sx <= width - 1)
            if inside.any():
                sy, sx = sy[inside] - top, sx[inside]
                gy, gx = np.gradient(b) if len(b) > 1 else (np.zeros_like(b), np.gradient(b, axis=1))
                w, slope_x, slope_y = (sampled(v, sy, sx)[0] for v in (b, gx, gy))
                unit = to @ np.stack([x[inside], y[inside], np.ones(inside.sum())])
                out = partial_sums(a.ravel()[inside], w, derivatives(model, to @ m @ back, unit[0], unit[1], slope_x * back[0, 0], slope_y * back[0, 0]))
                fit = plain_correlation(out) * np.sqrt(out[0])
        return pa.table({"link": pa.array([link], pa.int32()), "band": pa.array([band], pa.int32()), "fit": pa.array([fit]), "sums": pa.array([out.tolist()], pa.list_(pa.float64()))})

    return run


#: Rows that a window has at first where a frame as a whole does not correlate under its start, and the movement in pixels under which it grows.
WINDOW, SETTLED = 256, 0.1


def _window(at: int, reach: int, last: int) -> tuple[int, int]:
    """First and last of at most ``reach`` bands around the band ``at``, and of a frame's bands 0 to ``last``."""
    first = max(0, min(at - reach // 2, last + 1 - reach))
    return first, min(last, first + reach - 1)


def polish(frames: DataFrame, starts: DataFrame, model: str = "affine", rounds: int = 10, band: int = BAND) -> DataFrame:
    """(link, m, correlation): correlation steps from ``starts(link, a, b, m)`` on ``frames(frame, y, row, height)`` of full size and equal shape.

    A frame is never in one task: each band of the first frame meets the rows of the second that its samples come from, and gives the sums of its normal
    equations. These are added up; a few dozen numbers a link reach the driver, which solves them and sends the next transforms. Links that have
    settled leave. A link without overlap or texture keeps its start, with a null correlation.

    A tall frame that does not correlate under its start as a whole may do so where the start is nearly right: steps are taken on a window around its most
    telling band, which grows by three each time it has settled, to the whole frame. Each window takes ``rounds`` steps at most.
    """
    spark, p = frames.sparkSession, MODELS[model]
    links = {r["link"]: (r["a"], r["b"], np.array(r["m"]).reshape(3, 3)) for r in starts.select("link", "a", "b", "m").collect()}
    begun = {k: m for k, (_, _, m) in links.items()}
    known = {r["frame"]: (r["height"], r["width"]) for r in frames.groupBy("frame").agg(F.max("height").alias("height"), F.max(F.size("row")).alias("width")).collect()}
    rho, open_ = dict.fromkeys(links, np.nan), {k for k, (a, b, _) in links.items() if a in known and known.get(a) == known.get(b)}
    last = {k: (known[links[k][0]][0] - 1) // band for k in open_}
    seed, reach, left, fresh = dict.fromkeys(open_, 0), {k: last[k] + 1 for k in open_}, dict.fromkeys(open_, rounds), set(open_)
    least = -(-WINDOW // band)
    while open_ and rounds > 0:
        made = [(k, a, b, m.ravel().tolist(), *known[a], *_window(seed[k], reach[k], last[k])) for k, (a, b, m) in sorted(links.items()) if k in open_]
        now = F.broadcast(spark.createDataFrame(made, "link int, a int, b int, m array<double>, height int, width int, first int, last int"))
        values = frames.select("frame", "y", F.col("row").cast("array<double>").alias("row"))
        one = values.join(now, (F.col("frame") == F.col("a")) & F.expr(f"y div {band} BETWEEN first AND last")).select("link", F.expr(f"cast(y div {band} AS int)").alias("band"), F.lit(0).alias("side"), "y", "row", "m", "height")
        needed = now.select("*", F.explode(F.expr("sequence(first, last)")).alias("band")).select("link", "band", "b", "m", "height", F.explode(F.expr(_halo_rows("m", band))).alias("row_b"))
        two = values.join(needed, (F.col("frame") == F.col("b")) & (F.col("y") == F.col("row_b"))).select("link", "band", F.lit(1).alias("side"), "y", "row", "m", "height")
        each = one.unionByName(two).groupBy("link", "band").applyInArrow(_band_sums(model, p), "link int, band int, fit double, sums array<double>")
        total, telling = {k: np.zeros(6 + 3 * p + p * p) for k in open_}, {}
        best = F.max_by("band", F.struct("fit", -F.col("band"))).alias("best")
        for r in each.select("link", "band", "fit", F.posexplode("sums")).groupBy("link", "pos").agg(F.sum("col").alias("v"), best).collect():
            total[r["link"]][r["pos"]], telling[r["link"]] = r["v"], r["best"]
        for k in sorted(open_):
            a, b, m = links[k]
            if k in fresh:
                fresh.discard(k)
                if k in telling and last[k] + 1 > least and plain_correlation(total[k]) < RETRY:
                    seed[k], reach[k] = telling[k], least
                    continue
            step, found = ascent(total[k], p)
            whole = reach[k] > last[k]
            to = centring(known[a])
            back = np.linalg.inv(to)
            after = None if step is None else back @ moved_by(to @ m @ back, step, model) @ to
            after = None if after is None else after / after[2, 2]
            if after is None or not np.isfinite(after).all():
                if not whole:
                    # A window without overlap or texture tells nothing; a wider one may.
                    reach[k], left[k] = reach[k] * 3, rounds
                    continue
                if np.isnan(rho[k]):
                    links[k] = (a, b, begun[k])
                open_.discard(k)
                continue
            links[k], left[k] = (a, b, after), left[k] - 1
            if whole:
                if abs(found - rho[k]) < TOLERANCE or not left[k]:
                    open_.discard(k)
                rho[k] = found
            else:
                low, high = _window(seed[k], reach[k], last[k])
                corners = np.array([(x, y, 1.0) for x in (0, known[a][1] - 1) for y in (low * band, min((high + 1) * band, known[a][0]) - 1)])
                old, new = (corners @ t.T for t in (m, after))
                if np.hypot(*(old[:, :2] / old[:, 2:] - new[:, :2] / new[:, 2:]).T).max() < SETTLED or not left[k]:
                    reach[k], left[k] = reach[k] * 3, rounds
    rows = [(k, m.ravel().tolist(), None if np.isnan(rho[k]) else rho[k]) for k, (_, _, m) in links.items()]
    return spark.createDataFrame(rows, "link int, m array<double>, correlation double")


def estimate_full(frames: DataFrame, pairs: DataFrame, model: str = "similarity", longest: int = 2048) -> DataFrame:
    """(link, m, correlation, gain) at full resolution for ``pairs(link, a, b)`` of ``frames(frame, y, row, height)``.

    Proxies give the estimate; where frames are larger than their proxies it is scaled up and polished on all their pixels, and an
    implausible polish falls back to it. ``gain`` is what the second frame's brightness is multiplied by to have the first one's mean.
    """
    small = proxies(frames, longest)
    factor = small.agg(F.max("factor")).first()[0] or 1.0
    found = estimate_pairs(small, pairs, model)
    full = found.select("link", F.expr(geometry.rescale("m", factor)).alias("m"), "correlation")
    if factor > 1:
        held = full.collect()
        rough = frames.sparkSession.createDataFrame(held, full.schema)
        motion = "affine" if model == "similarity" else model
        fine = {r["link"]: r for r in polish(frames, rough.join(pairs, "link"), motion).collect()}
        shape = frames.agg(F.max("height"), F.max(F.size("row"))).first()
        rows = []
        for r in held:
            m, rho, better = np.array(r["m"]).reshape(3, 3), r["correlation"], fine.get(r["link"])
            if better is not None and better["correlation"] is not None:
                polished = np.array(better["m"]).reshape(3, 3)
                polished = similar_to(polished, tuple(shape)) if model == "similarity" else polished
                if believable(polished, model, tuple(shape)):
                    m, rho = polished, better["correlation"]
            rows.append((r["link"], m.ravel().tolist(), rho))
        full = frames.sparkSession.createDataFrame(rows, full.schema)
    means = small.select("frame", F.expr("aggregate(row, 0D, (s, v) -> s + v)").alias("s"), F.size("row").alias("n")).groupBy("frame").agg((F.sum("s") / F.sum("n")).alias("mean"))
    bright = pairs.join(means.select(F.col("frame").alias("a"), F.col("mean").alias("ma")), "a").join(means.select(F.col("frame").alias("b"), F.col("mean").alias("mb")), "b")
    # Samples are codes: 255 stands for 1.
    gain = F.when(F.col("mb") < 255e-6, 1.0).otherwise(F.col("ma") / F.col("mb"))
    return full.join(bright.select("link", gain.alias("gain")), "link")


def align(frames: DataFrame, n: int, ref: int, threshold: float = 0.9) -> DataFrame:
    """(frame, m, affected, recovered, dropped) of a stack of ``n`` frames (``frames`` are its proxies, numbered from 0; their pairs are broadcast).

    Neighbours are chained to the reference. Frames whose chain crosses a link under the threshold are estimated against the reference directly and
    recover if that correlates well. Frames with a bad link on every side that do not recover are dropped (identity), and their neighbours
    are linked over the gap. A bad reference gives way to the nearest good frame.
    """
    spark = frames.sparkSession
    numbers = spark.range(n).select(F.col("id").cast("int").alias("frame"))
    links = estimate_pairs(frames, geometry.consecutive_pairs(numbers)).cache()
    bad = geometry.culprits(links, n, threshold)
    ref = geometry.nearest_good(bad, n, ref).first()[0]
    affected = geometry.affected_frames(links, n, ref, threshold)
    again = affected.select(F.col("frame").alias("link"), F.lit(ref).alias("a"), F.col("frame").alias("b"))
    direct = estimate_pairs(frames, again).where(F.col("correlation") >= threshold).select(F.col("link").alias("frame"), F.col("m").alias("direct")).cache()
    _, dropped = geometry.flagged_and_dropped(affected, direct.select("frame"), bad, ref)
    gone = sorted(r[0] for r in dropped.collect())
    chain = geometry.chain_to_reference(links.select("link", "m"), n, ref)
    if gone:
        kept = [k for k in range(n) if k not in gone]
        spans = spark.createDataFrame([(j, a, b) for j, (a, b) in enumerate(zip(kept, kept[1:]))] or [(0, -1, -1)], "link int, a int, b int")
        over = estimate_pairs(frames, spans.where("b - a > 1"))
        near = spans.where("b - a = 1").join(links.select(F.col("link").alias("a"), "m"), "a").select("link", "m")
        places = spark.createDataFrame(list(enumerate(kept)), "place int, frame int")
        short = geometry.chain_to_reference(near.unionByName(over.select("link", "m")), len(kept), kept.index(ref))
        chain = numbers.join(short.withColumnRenamed("frame", "place").join(places, "place").select("frame", "m"), "frame", "left").select("frame", F.coalesce("m", F.expr(geometry.IDENTITY)).alias("m"))
        direct = direct.where("false")
    marks = [(affected, "affected"), (direct.select("frame"), "recovered")]
    out = chain.join(direct, "frame", "left").select("frame", F.coalesce("direct", "m").alias("m")).withColumn("dropped", F.col("frame").isin(gone) if gone else F.lit(False))
    for frames_of, name in marks:
        out = out.join(frames_of.distinct().withColumn(name, F.lit(True)), "frame", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out
