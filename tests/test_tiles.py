import numpy as np
import pytest

from gridweave.operators import tiles

rng = np.random.default_rng(2)
A = rng.uniform(0.2, 0.8, (5, 16, 16))
FLAT = np.full((2, 16, 16), 0.4)


@pytest.mark.parametrize("name", ["gaussian_blur", "gaussian_recursive", "bilateral_filter", "wavelet_denoise", "wavelet_contrast", "line_denoise", "edge_preserving_base", "geometric_warp", "deconvolution"])
def test_a_flat_image_stays(name):
    assert np.allclose(tiles.OPERATORS[name](FLAT), FLAT, atol=1e-6)


def test_recursion_is_near_the_kernel():
    impulse = np.zeros((1, 41, 41))
    impulse[0, 20, 20] = 1
    a, b = tiles.recursive_gaussian(impulse, 3.0), tiles.gaussian_blur(impulse, 3.0)
    assert abs(a.sum() - 1) < 0.01 and np.abs(a - b).max() < 0.05 * b.max() + 1e-3


def test_wavelets_are_inverse():
    assert np.allclose(tiles.unhaar(*tiles.haar(A, 3)), A)
    assert np.allclose(tiles.wavelet_contrast(A, (1.0, 1.0)), A)


def test_deconvolution_sharpens():
    blurred = tiles.gaussian_blur(A, 0.8)
    assert np.abs(tiles.richardson_lucy(blurred, 0.8, 30) - A).mean() < 0.8 * np.abs(blurred - A).mean()


def test_bilateral_by_brute_force():
    got, n = tiles.bilateral(A[:1], 1.0, 0.1), 16
    for y, x in ((0, 0), (5, 9), (15, 3)):
        top = under = 0.0
        for dy in range(-2, 3):
            for dx in range(-2, 3):
                v = A[0, min(max(y + dy, 0), n - 1), min(max(x + dx, 0), n - 1)]
                w = np.exp(-(dy * dy + dx * dx) / 2 - (v - A[0, y, x]) ** 2 / 0.02)
                top, under = top + w * v, under + w
        assert got[0, y, x] == pytest.approx(top / under)


def test_edge_preserving_solves_its_equations():
    a = A[:1, :6, :6]
    wx, wy = 0.3 / (np.abs(np.diff(a, axis=2)) ** 1.2 + 1e-2), 0.3 / (np.abs(np.diff(a, axis=1)) ** 1.2 + 1e-2)
    m = np.eye(36)
    for y in range(6):
        for x in range(6):
            for (yy, xx), w in (((y, x + 1), wx[0, y, x] if x < 5 else 0), ((y + 1, x), wy[0, y, x] if y < 5 else 0)):
                if w:
                    i, j = y * 6 + x, yy * 6 + xx
                    m[i, i] += w
                    m[j, j] += w
                    m[i, j] -= w
                    m[j, i] -= w
    assert np.allclose(tiles.edge_preserving(a, 0.3, 1.2).ravel(), np.linalg.solve(m, a.ravel()), atol=1e-6)


def test_gradients_that_stay_give_the_image_up_to_a_factor():
    out = tiles.compress_gradients(A, 1.0, 1.0)  # an exponent of 1 leaves gradients as they are
    ratio = out / A
    assert np.allclose(ratio, ratio.mean(axis=(1, 2), keepdims=True), rtol=1e-6)


def test_sampling():
    assert np.allclose(tiles.warp(A, 0.0, 0.0), A)
    y, x = np.mgrid[:16, :16].astype(float)
    plane = (2 * y + 3 * x)[None]
    assert np.allclose(tiles.sample(plane, y[4:10, 4:10] + 0.25, x[4:10, 4:10] + 0.5), plane[:, 4:10, 4:10] + 2.0)
    turned = tiles.warp(A, np.pi / 2, 0.0, cubic=False)
    assert np.allclose(turned, np.rot90(A, 1, axes=(1, 2))) or np.allclose(turned, np.rot90(A, -1, axes=(1, 2)))


def test_demosaic_keeps_sites_and_greys():
    out = tiles.demosaic_gradients(A)
    assert np.allclose(out[:, 0, ::2, ::2], A[:, ::2, ::2]) and np.allclose(out[:, 2, 1::2, 1::2], A[:, 1::2, 1::2])
    assert np.allclose(out[:, 1, ::2, 1::2], A[:, ::2, 1::2])
    assert np.allclose(tiles.demosaic_gradients(FLAT), 0.4)


def test_inpaint_keeps_what_is_known():
    out = tiles.inpaint(A, 0.6)
    assert (out[A < 0.6] == A[A < 0.6]).all() and (out[A >= 0.6] >= 0.6).all()


def test_hald_of_the_identity_changes_nothing():
    g = np.linspace(0, 1, 4)
    cube = np.stack(np.meshgrid(g, g, g, indexing="ij"), axis=-1)
    rgb = rng.uniform(0, 1, (50, 3))
    assert np.allclose(tiles.apply_hald(rgb, cube, 1.0), rgb)


def test_spline_goes_through_its_knots():
    k = [(0.0, 0.1), (0.4, 0.3), (0.8, 0.9), (1.0, 1.0)]
    assert np.allclose(tiles.spline(k)(np.array([x for x, _ in k])), [y for _, y in k])
    assert np.allclose(tiles.spline([(0.0, 0.0), (0.5, 0.5), (1.0, 1.0)])(np.array([-1, 0.25, 2])), [0, 0.25, 1])


def test_block_shift_finds_the_shift():
    b = np.roll(A, (1, -1), axis=(1, 2))
    dy, dx = tiles.block_shift(A, b)
    assert (dy == 1).all() and (dx == -1).all()


def test_map_planes_keeps_odd_rows(spark):
    df = spark.createDataFrame([(1, [1.0] * 64), (2, None), (3, [1.0, 2.0]), (4, [2.0] * 64)], "img long, a array<double>")
    got = {r.img: r.b for r in tiles.map_planes(df, lambda a: {"b": a * 2}).collect()}
    assert got[1] == [2.0] * 64 and got[2] is None and got[3] is None and got[4] == [4.0] * 64
    assert tiles.map_planes(df.limit(0), lambda a: {"b": a}).collect() == []
