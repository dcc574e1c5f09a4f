"""Grid kernels against loops."""
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from gridcast.functions import kernels as k

RNG = np.random.default_rng(3)


def brute_bilinear(g, n):
    h = g.shape[0]
    out = np.zeros((n, n))
    for i in range(n):
        for j in range(n):
            total = 0.0
            y, x = max((i + 0.5) * h / n - 0.5, 0), max((j + 0.5) * h / n - 0.5, 0)
            y0, x0 = int(y), int(x)
            y1, x1 = min(y0 + 1, h - 1), min(x0 + 1, h - 1)
            fy, fx = y - y0, x - x0
            total += g[y0, x0] * (1 - fy) * (1 - fx) + g[y0, x1] * (1 - fy) * fx
            total += g[y1, x0] * fy * (1 - fx) + g[y1, x1] * fy * fx
            out[i, j] = total
    return out


@settings(max_examples=25, deadline=None)
@given(st.integers(2, 9), st.integers(1, 14))
def test_bilinear(h, n):
    g = RNG.normal(size=(h, h))
    np.testing.assert_allclose(k.resize(g[None], (n, n))[0], brute_bilinear(g, n), atol=1e-12)


@pytest.mark.parametrize("mode", ["bilinear", "bicubic", "nearest"])
def test_weights_sum_to_one_and_same_size_is_untouched(mode):
    for n_in, n_out in ((8, 5), (5, 8), (81, 96), (144, 96)):
        np.testing.assert_allclose(sum(w for _, w in k.resize_taps(n_in, n_out, mode)), 1.0)
    g = RNG.normal(size=(2, 7, 7))
    assert k.resize(g, (7, 7), mode) is g


def test_nearest_takes_the_floor():
    g = np.arange(64.0).reshape(1, 8, 8)
    np.testing.assert_array_equal(k.resize(g, (5, 5), "nearest")[0][0], [0, 1, 3, 4, 6])


def test_bad_mode():
    with pytest.raises(ValueError):
        k.resize_taps(4, 4, "area")


def brute_window(g, i, j, r):
    h, w = g.shape
    return [
        (dy, dx, g[i + dy, j + dx] if 0 <= i + dy < h and 0 <= j + dx < w else 0.0)
        for dy in range(-r, r + 1)
        for dx in range(-r, r + 1)
    ]


def test_sobel():
    p, t = RNG.normal(size=(2, 9, 9))
    kx = {(-1, -1): -1, (-1, 1): 1, (0, -1): -2, (0, 1): 2, (1, -1): -1, (1, 1): 1}
    want = np.zeros((9, 9))
    for i in range(9):
        for j in range(9):
            gx = sum(kx.get((dy, dx), 0) * v for dy, dx, v in brute_window(p - t, i, j, 1))
            gy = sum(kx.get((dx, dy), 0) * v for dy, dx, v in brute_window(p - t, i, j, 1))
            want[i, j] = abs(gx) + abs(gy)
    np.testing.assert_allclose(k.sobel_difference(p[None], t[None])[0], want, atol=1e-12)


def test_ssim():
    p, t = RNG.random(size=(2, 10, 10))
    want = np.zeros((10, 10))
    for i in range(10):
        for j in range(10):
            a = np.array([v for *_, v in brute_window(p, i, j, 3)])
            b = np.array([v for *_, v in brute_window(t, i, j, 3)])
            ma, mb = a.sum() / 49, b.sum() / 49
            va, vb, c = (a * a).sum() / 49 - ma**2, (b * b).sum() / 49 - mb**2, (a * b).sum() / 49 - ma * mb
            q = (2 * ma * mb + 1e-4) * (2 * c + 9e-4) / max((ma**2 + mb**2 + 1e-4) * (va + vb + 9e-4), 1e-8)
            want[i, j] = 1 - min(max(q, -1), 1)
    np.testing.assert_allclose(k.ssim_loss(p[None], t[None])[0], want, atol=1e-10)
    np.testing.assert_allclose(k.ssim_loss(p[None], p[None]), 0, atol=1e-9)


def test_orientation():
    g = np.arange(9).reshape(1, 3, 3)
    np.testing.assert_array_equal(k.orient(g, True, False, 0)[0], [[2, 1, 0], [5, 4, 3], [8, 7, 6]])
    np.testing.assert_array_equal(k.orient(g, False, True, 0)[0], [[6, 7, 8], [3, 4, 5], [0, 1, 2]])
    np.testing.assert_array_equal(k.orient(g, False, False, 1)[0], [[2, 5, 8], [1, 4, 7], [0, 3, 6]])
    np.testing.assert_array_equal(k.orient(k.orient(g, False, False, 3), False, False, 1), g)
