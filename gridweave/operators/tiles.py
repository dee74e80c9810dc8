"""Image operators that need more than column expressions: numpy over whole tiles, Arrow batches in and out, no shuffle.

`map_planes` hands a function a stack of images (n, height, width), so that numpy works on all of a batch together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import register
from .fixtures import SIDE, planes


def map_planes(df: DataFrame, function: Callable[[np.ndarray], dict[str, np.ndarray]], names: tuple[str, ...] = ("b",), side: int = SIDE, out_side: int | None = None) -> DataFrame:
    """(img, *names): results of `function` over (n, side, side) stacks; arrays that are null or of another size are null in the result."""
    schema = "img long, " + ", ".join(f"{n} array<double>" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
            whole = np.flatnonzero(sizes == side * side)
            stack = np.array(lists.take(pa.array(whole)).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, side, side)
            got = function(stack) if len(whole) else {}
            columns = [batch.column(0).cast(pa.int64())]
            for n in names:
                rows: list = [None] * batch.num_rows
                for k, i in enumerate(whole.tolist()):
                    rows[i] = got[n][k].ravel()
                columns.append(pa.array(rows, pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays(columns, ["img", *names])

    import pyarrow.compute  # noqa: F401

    return df.select("img", "a").mapInArrow(run, schema)


def pixels_of(df: DataFrame, *names: str, width: int = SIDE) -> DataFrame:
    rows = df.select("img", F.posexplode(F.arrays_zip(*names)).alias("i", "z"))
    return rows.select("img", F.expr(f"cast(i div {width} as int)").alias("y"), (F.col("i") % width).alias("x"), *(F.round(F.col("z")[n], 6).alias(n) for n in names))


def edge(a: np.ndarray, r: int, mode: str = "edge") -> np.ndarray:
    return np.pad(a, ((0, 0), (r, r), (r, r)), mode=mode)


def shifted(a: np.ndarray, r: int, mode: str = "edge") -> Iterator[tuple[int, int, np.ndarray]]:
    """(dy, dx, the stack moved by that) for all offsets up to r."""
    p, (_, h, w) = edge(a, r, mode), a.shape
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            yield dy, dx, p[:, r + dy : r + dy + h, r + dx : r + dx + w]


def gaussian_blur(a: np.ndarray, sigma: float) -> np.ndarray:
    """By a finite kernel of four deviations either way, rows and columns after one another."""
    r = max(1, int(np.ceil(4 * sigma)))
    k = np.exp(-np.arange(-r, r + 1) ** 2 / (2 * sigma * sigma))
    k /= k.sum()
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (r, r)
        p = np.pad(a, pad, mode="edge")
        a = sum(w * np.take(p, range(i, i + a.shape[axis]), axis=axis) for i, w in enumerate(k))
    return a


def recursive_gaussian(a: np.ndarray, sigma: float) -> np.ndarray:
    """Young and van Vliet's third-order recursion, forwards and backwards along rows, then columns: its cost doesn't depend on sigma."""
    q = 0.98711 * sigma - 0.96330 if sigma >= 2.5 else 3.97156 - 4.14554 * np.sqrt(1 - 0.26891 * sigma)
    b0 = 1.57825 + 2.44413 * q + 1.4281 * q * q + 0.422205 * q**3
    b1, b2, b3 = (2.44413 * q + 2.85619 * q * q + 1.26661 * q**3) / b0, -(1.4281 * q * q + 1.26661 * q**3) / b0, 0.422205 * q**3 / b0
    gain = 1 - b1 - b2 - b3

    def line(x: np.ndarray) -> np.ndarray:
        out = np.empty_like(x)
        h1 = h2 = h3 = x[..., 0]
        for k in range(x.shape[-1]):
            out[..., k] = gain * x[..., k] + b1 * h1 + b2 * h2 + b3 * h3
            h1, h2, h3 = out[..., k], h1, h2
        return out

    for _ in range(2):
        a = line(line(a)[..., ::-1])[..., ::-1].swapaxes(1, 2)
    return a


def bilateral(a: np.ndarray, sigma: float, spread: float, r: int = 2) -> np.ndarray:
    top, under = np.zeros_like(a), np.zeros_like(a)
    for dy, dx, s in shifted(a, r):
        w = np.exp(-(dy * dy + dx * dx) / (2 * sigma * sigma) - (s - a) ** 2 / (2 * spread * spread))
        top, under = top + w * s, under + w
    return top / under


def richardson_lucy(a: np.ndarray, sigma: float, rounds: int, floor: float = 1e-6) -> np.ndarray:
    """Deconvolution: blur the estimate, divide the image by it, blur the ratio, multiply."""
    x = np.maximum(a, floor)
    image = x
    for _ in range(rounds):
        x = x * gaussian_blur(image / np.maximum(gaussian_blur(x, sigma), floor), sigma)
    return x


def haar(a: np.ndarray, levels: int) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
    """Undecimated Haar-like decomposition: per level horizontal, vertical and diagonal detail, and what is left."""
    out = []
    for k in range(levels):
        d = 1 << k
        low_x = (a + np.roll(a, -d, axis=2)) / 2
        high_x = (a - np.roll(a, -d, axis=2)) / 2
        out.append((((high_x + np.roll(high_x, -d, axis=1)) / 2), (low_x - np.roll(low_x, -d, axis=1)) / 2, (high_x - np.roll(high_x, -d, axis=1)) / 2))
        a = (low_x + np.roll(low_x, -d, axis=1)) / 2
    return out, a


def unhaar(details, a: np.ndarray) -> np.ndarray:
    """The inverse: at every place the four bands add up to the level before."""
    for h, v, d in reversed(details):
        a = a + h + v + d
    return a


def wavelet_denoise(a: np.ndarray, strength: float, levels: int = 3) -> np.ndarray:
    """Shrink details by the noise that the median of each band tells."""
    details, rest = haar(a, levels)

    def shrink(x: np.ndarray) -> np.ndarray:
        noise = (np.median(np.abs(x), axis=(1, 2), keepdims=True) / 0.6745 * strength) ** 2
        return x * (x * x / (x * x + noise + 1e-12))

    return unhaar([tuple(map(shrink, d)) for d in details], rest)


def wavelet_contrast(a: np.ndarray, gains: tuple[float, ...]) -> np.ndarray:
    details, rest = haar(a, len(gains))
    return unhaar([tuple(x * g for x in d) for d, g in zip(details, gains, strict=True)], rest)


def line_denoise(a: np.ndarray, strength: float) -> np.ndarray:
    """Noise along lines sits in the first row and column of the cosine transform; these coefficients shrink, but for the mean."""
    n = a.shape[1]
    k = np.arange(n)
    c = np.sqrt(2 / n) * np.cos(np.pi * (2 * k[None] + 1) * k[:, None] / (2 * n))
    c[0] /= np.sqrt(2)
    f = c @ a @ c.T
    noise = np.median(np.abs(f[:, 1:, 1:]), axis=(1, 2)) / 0.6745 * strength
    for part in (f[:, 0, 1:], f[:, 1:, 0]):
        part *= part**2 / (part**2 + noise[:, None] ** 2 + 1e-12)
    return c.T @ f @ c


def retinex(a: np.ndarray, sigmas: tuple[float, ...], floor: float = 1e-3) -> np.ndarray:
    """Mean over scales of the log ratio to the blurred image, stretched to the image's own mean and deviation."""
    x = np.maximum(a, floor)
    r = sum(np.log(x) - np.log(np.maximum(gaussian_blur(x, s), floor)) for s in sigmas) / len(sigmas)
    z = (r - r.mean(axis=(1, 2), keepdims=True)) / (r.std(axis=(1, 2), keepdims=True) + 1e-9)
    return z * a.std(axis=(1, 2), keepdims=True) + a.mean(axis=(1, 2), keepdims=True)


def edge_preserving(a: np.ndarray, scale: float, power: float, rounds: int = 60) -> np.ndarray:
    """Weighted least squares: the base that is near the image and smooth where that is; conjugate gradients on the normal equations."""
    wx = scale / (np.abs(np.diff(a, axis=2)) ** power + 1e-2)
    wy = scale / (np.abs(np.diff(a, axis=1)) ** power + 1e-2)

    def apply(u: np.ndarray) -> np.ndarray:
        out = u.copy()
        fx, fy = wx * np.diff(u, axis=2), wy * np.diff(u, axis=1)
        out[:, :, :-1] -= fx
        out[:, :, 1:] += fx
        out[:, :-1] -= fy
        out[:, 1:] += fy
        return out

    x = a.copy()
    r = a - apply(x)
    p, rr = r.copy(), (r * r).sum(axis=(1, 2), keepdims=True)
    for _ in range(rounds):
        q = apply(p)
        step = rr / np.maximum((p * q).sum(axis=(1, 2), keepdims=True), 1e-30)
        x, r = x + step * p, r - step * q
        new = (r * r).sum(axis=(1, 2), keepdims=True)
        p, rr = r + new / np.maximum(rr, 1e-30) * p, new
    return x


def compress_gradients(a: np.ndarray, alpha: float, beta: float) -> np.ndarray:
    """Attenuate large gradients of the log image and solve Poisson's equation by a cosine transform."""
    x = np.log(np.maximum(a, 1e-3))
    gx, gy = np.diff(x, axis=2, append=x[:, :, -1:]), np.diff(x, axis=1, append=x[:, -1:])
    g = np.hypot(gx, gy) + 1e-6
    level = alpha * g.mean(axis=(1, 2), keepdims=True)
    phi = (level / g) * (g / level) ** beta
    gx, gy = gx * phi, gy * phi
    div = gx + gy
    div[:, :, 1:] -= gx[:, :, :-1]
    div[:, 1:] -= gy[:, :-1]
    n, m = a.shape[1:]

    def cosines(k: int) -> np.ndarray:
        i = np.arange(k)
        c = np.sqrt(2 / k) * np.cos(np.pi * (2 * i[None] + 1) * i[:, None] / (2 * k))
        c[0] /= np.sqrt(2)
        return c

    cy, cx = cosines(n), cosines(m)
    eigen = (2 * np.cos(np.pi * np.arange(n) / n) - 2)[:, None] + (2 * np.cos(np.pi * np.arange(m) / m) - 2)[None]
    f = cy @ div @ cx.T
    f = np.where(eigen == 0, 0, f / np.where(eigen == 0, 1, eigen))
    return np.exp(cy.T @ f @ cx)


def sample(a: np.ndarray, sy: np.ndarray, sx: np.ndarray, cubic: bool = True) -> np.ndarray:
    """Values of all images at places between pixels; Catmull-Rom or straight, the border repeats."""
    h, w = a.shape[1:]
    reach = (-1, 0, 1, 2) if cubic else (0, 1)

    def weights(t: np.ndarray) -> list[np.ndarray]:
        if not cubic:
            return [1 - t, t]
        return [((-t + 2) * t - 1) * t / 2, ((3 * t - 5) * t * t + 2) / 2, ((-3 * t + 4) * t + 1) * t / 2, (t - 1) * t * t / 2]

    y0, x0 = np.floor(sy).astype(int), np.floor(sx).astype(int)
    wy, wx = weights(sy - y0), weights(sx - x0)
    out = 0
    for dy, u in zip(reach, wy, strict=True):
        for dx, v in zip(reach, wx, strict=True):
            out = out + u * v * a[:, np.clip(y0 + dy, 0, h - 1), np.clip(x0 + dx, 0, w - 1)]
    return out


def warp(a: np.ndarray, angle: float, distortion: float, cubic: bool = True) -> np.ndarray:
    """Turn about the centre and undo radial distortion."""
    h, w = a.shape[1:]
    y, x = np.mgrid[:h, :w].astype(float)
    c = (np.array([h, w]) - 1) / 2
    u, v = x - c[1], y - c[0]
    xr, yr = u * np.cos(angle) - v * np.sin(angle), u * np.sin(angle) + v * np.cos(angle)
    f = 1 + distortion * (xr * xr + yr * yr) / (c @ c)
    return sample(a, yr * f + c[0], xr * f + c[1], cubic)


def demosaic_gradients(a: np.ndarray) -> np.ndarray:
    """Green at other sites from the direction that changes less; red and blue from differences to green. (n, 3, h, w)"""
    h, w = a.shape[1:]
    y, x = np.mgrid[:h, :w]
    colour = np.where((y % 2 == 0) & (x % 2 == 0), 0, np.where((y % 2 == 1) & (x % 2 == 1), 2, 1))
    at = {(dy, dx): s for dy, dx, s in shifted(a, 2, "reflect")}
    across, down = np.abs(at[0, -1] - at[0, 1]) + np.abs(2 * a - at[0, -2] - at[0, 2]), np.abs(at[-1, 0] - at[1, 0]) + np.abs(2 * a - at[-2, 0] - at[2, 0])
    gx = (at[0, -1] + at[0, 1]) / 2 + (2 * a - at[0, -2] - at[0, 2]) / 4
    gy = (at[-1, 0] + at[1, 0]) / 2 + (2 * a - at[-2, 0] - at[2, 0]) / 4
    wx, wy = 1 / (across + 1e-6), 1 / (down + 1e-6)
    green = np.where(colour == 1, a, (wx * gx + wy * gy) / (wx + wy))
    out = np.empty((len(a), 3, h, w))
    out[:, 1] = green
    for c in (0, 2):
        has = (colour == c).astype(float)[None]
        top, under = 0, 0
        diff = np.where(has > 0, a - green, 0)
        for (_, _, d), (_, _, m) in zip(shifted(diff, 1, "reflect"), shifted(np.broadcast_to(has, a.shape), 1, "reflect"), strict=True):
            top, under = top + d * m, under + m
        out[:, c] = np.where(colour == c, a, green + top / np.maximum(under, 1))
    return out


def inpaint(a: np.ndarray, clip: float, rounds: int = 40) -> np.ndarray:
    """Clipped places take the mean of their neighbours until nothing changes much; known places stay."""
    known = a < clip
    x = np.where(known, a, clip)
    for _ in range(rounds):
        p = edge(x, 1)
        x = np.where(known, a, np.maximum(clip, (p[:, :-2, 1:-1] + p[:, 2:, 1:-1] + p[:, 1:-1, :-2] + p[:, 1:-1, 2:]) / 4))
    return x


def grain(a: np.ndarray, strength: float, seed: int, img: np.ndarray | None = None) -> np.ndarray:
    """Noise of the place alone, weaker in the lights and depths."""
    h, w = a.shape[1:]
    y, x = np.mgrid[:h, :w].astype(np.uint64)
    z = (y * np.uint64(0x9E3779B97F4A7C15) ^ x * np.uint64(0xBF58476D1CE4E5B9)) + np.uint64(seed)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    n = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2**53 - 0.5
    t = np.clip(a, 0, 1)
    return a + strength * n * 4 * t * (1 - t)


def apply_hald(rgb: np.ndarray, cube: np.ndarray, strength: float) -> np.ndarray:
    """(n, 3) colours through a (k, k, k, 3) table, trilinear, blended in."""
    k = cube.shape[0] - 1
    p = np.clip(rgb, 0, 1) * k
    i = np.minimum(p.astype(int), k - 1)
    f = p - i
    out = 0
    for d in np.ndindex(2, 2, 2):
        w = np.prod([f[:, c] if d[c] else 1 - f[:, c] for c in range(3)], axis=0)
        out = out + w[:, None] * cube[i[:, 0] + d[0], i[:, 1] + d[1], i[:, 2] + d[2]]
    return strength * out + (1 - strength) * rgb


def spline(knots: list[tuple[float, float]]) -> Callable[[np.ndarray], np.ndarray]:
    """Natural cubic spline through the knots, kept between 0 and 1; the first and last value beyond them."""
    x, y = (np.array(v, dtype=float) for v in zip(*knots, strict=True))
    n = len(x)
    h = np.diff(x)
    m = np.eye(n)
    right = np.zeros(n)
    for k in range(1, n - 1):
        m[k, k - 1 : k + 2] = h[k - 1], 2 * (h[k - 1] + h[k]), h[k]
        right[k] = 6 * ((y[k + 1] - y[k]) / h[k] - (y[k] - y[k - 1]) / h[k - 1])
    d2 = np.linalg.solve(m, right)

    def value(t: np.ndarray) -> np.ndarray:
        t = np.clip(t, x[0], x[-1])
        k = np.clip(np.searchsorted(x, t, side="right") - 1, 0, n - 2)
        b = (t - x[k]) / h[k]
        a = 1 - b
        return np.clip(a * y[k] + b * y[k + 1] + ((a**3 - a) * d2[k] + (b**3 - b) * d2[k + 1]) * h[k] ** 2 / 6, 0, 1)

    return value


def block_shift(a: np.ndarray, b: np.ndarray, most: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """The whole shift of b that brings it closest to a, for every image, by sums of squared differences inside the margin."""
    best = np.full(len(a), np.inf)
    dy_, dx_ = np.zeros(len(a), dtype=int), np.zeros(len(a), dtype=int)
    inner = (slice(None), slice(most, -most), slice(most, -most))
    for dy, dx, s in shifted(b, most):
        e = ((s - a)[inner] ** 2).sum(axis=(1, 2))
        closer = e < best - 1e-12
        best, dy_, dx_ = np.where(closer, e, best), np.where(closer, dy, dy_), np.where(closer, dx, dx_)
    return dy_, dx_


OPERATORS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "gaussian_blur": lambda a: gaussian_blur(a, 1.3),
    "gaussian_recursive": lambda a: recursive_gaussian(a, 2.0),
    "bilateral_filter": lambda a: bilateral(a, 1.0, 0.1),
    "deconvolution": lambda a: richardson_lucy(a + 1, 0.7, 10) - 1,
    "wavelet_denoise": lambda a: wavelet_denoise(a, 1.0),
    "wavelet_contrast": lambda a: wavelet_contrast(a, (1.4, 1.2, 1.0)),
    "line_denoise": lambda a: line_denoise(a, 1.0),
    "retinex": lambda a: retinex(a + 1, (1.0, 2.0)),
    "edge_preserving_base": lambda a: edge_preserving(a, 0.3, 1.2),
    "gradient_compression": lambda a: compress_gradients(a + 1, 0.1, 0.85),
    "geometric_warp": lambda a: warp(a, 0.1, 0.03),
    "highlight_inpaint": lambda a: inpaint(a, 0.2),
    "film_grain": lambda a: grain(a, 0.2, 7),
    "curve_spline": lambda a: spline([(0.0, 0.0), (0.3, 0.2), (0.7, 0.85), (1.0, 1.0)])(a + 0.5),
}


def _register(name: str, function: Callable[[np.ndarray], np.ndarray]) -> None:
    @register(name)
    def _(spark, sf_dir):
        return pixels_of(map_planes(planes(spark, sf_dir), lambda a: {"b": function(a)}), "b")


for _name, _function in OPERATORS.items():
    _register(_name, _function)


@register("demosaic_gradients")
def _(spark, sf_dir):
    def run(a: np.ndarray) -> dict[str, np.ndarray]:
        out = demosaic_gradients(a)
        return {n: out[:, c] for c, n in enumerate("rgb")}

    return pixels_of(map_planes(planes(spark, sf_dir), run, ("r", "g", "b")), "r", "g", "b")


@register("hald_clut")
def _(spark, sf_dir):
    grid = np.linspace(0, 1, 5)
    cube = np.stack(np.meshgrid(grid, grid, grid, indexing="ij"), axis=-1) ** 1.2

    def run(a: np.ndarray) -> dict[str, np.ndarray]:
        rgb = np.stack([a + 0.5, np.roll(a, 1, axis=2) + 0.5, np.roll(a, 1, axis=1) + 0.5], axis=-1)
        out = apply_hald(rgb.reshape(-1, 3), cube, 0.8).reshape(rgb.shape)
        return {n: out[..., c] for c, n in enumerate("rgb")}

    return pixels_of(map_planes(planes(spark, sf_dir), run, ("r", "g", "b")), "r", "g", "b")


@register("block_shift")
def _(spark, sf_dir):
    """The shift between each image's even and odd sites, as colours that the lens has moved apart."""

    def run(a: np.ndarray) -> dict[str, np.ndarray]:
        dy, dx = block_shift(a, np.roll(a, 1, axis=2))
        return {"d": np.stack([dy, dx], axis=1).astype(float)}

    return map_planes(planes(spark, sf_dir), run, ("d",)).select("img", F.col("d")[0].cast("int").alias("dy"), F.col("d")[1].cast("int").alias("dx"))
