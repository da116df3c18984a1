import numpy as np
import pytest

from frameflow.functions.curves import spline
from frameflow.operators import kernels as K

RNG = np.random.default_rng(4)


def field(n=64, stars=12, seed=2):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:n, :n]
    a = rng.normal(0.1, 0.002, (n, n))
    at = rng.uniform(8, n - 8, (stars, 2))
    for cy, cx in at:
        a += rng.uniform(0.3, 1) * np.exp(-((y - cy) ** 2 + (x - cx) ** 2) / (2 * 1.6**2))
    return a, at


def test_gaussian_keeps_a_constant_and_the_sum():
    assert np.allclose(K.gaussian(np.full((9, 7), 3.0), 1.5), 3)
    a = np.zeros((31, 31))
    a[15, 15] = 1
    b = K.gaussian(a, 2.0)
    assert abs(b.sum() - 1) < 1e-9 and b[15, 15] == b.max() and np.allclose(b, b.T)


def test_label_against_flood_fill():
    for _ in range(20):
        m = RNG.random((9, 11)) < 0.5
        names, n = K.label(m)
        seen = np.zeros_like(m, int)
        count = 0
        for start in np.argwhere(m):
            if seen[tuple(start)]:
                continue
            count += 1
            todo = [tuple(start)]
            while todo:
                y, x = todo.pop()
                if 0 <= y < 9 and 0 <= x < 11 and m[y, x] and not seen[y, x]:
                    seen[y, x] = count
                    todo += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
        assert n == count and np.array_equal(names, seen)


def test_distance_transform_against_brute_force():
    for _ in range(10):
        m = RNG.random((8, 9)) < 0.8
        m[0, 0] = False
        zeros = np.argwhere(~m)
        want = np.array([[np.sqrt(((zeros - (y, x)) ** 2).sum(1)).min() for x in range(9)] for y in range(8)])
        assert np.allclose(K.distance_transform(m), want)


def test_shift_by_whole_and_part_pixels():
    a, _ = field(32)
    assert np.allclose(K.shift(a, 2, -3)[2:, :-3], a[:-2, 3:])
    assert np.all(K.shift(a, 2, 0)[:2] == 0)
    y = np.sin(np.arange(40) / 5)[:, None] * np.ones((1, 5))
    assert np.allclose(K.shift(y, 0.5, 0)[6:-6, 0], np.sin((np.arange(40) - 0.5) / 5)[6:-6], atol=1e-4)


@pytest.mark.parametrize("d", [(3, 5), (-4, 2), (0, 0)])
def test_phase_shift_has_the_rolls_sign(d):
    a, _ = field(48)
    got = K.phase_shift(a, np.roll(a, d, (0, 1)))
    assert np.allclose(got, d, atol=0.11)


def test_alignment_finds_a_homography():
    a, _ = field(96, 25, 5)
    h = np.array([[1, 0, 4.0], [0, 1, -3.0], [0, 0, 1]])
    got, sure = K.align(a, K.warp(a, np.linalg.inv(h)))
    p = np.array([[30.0, 40.0], [60.0, 20.0]])
    assert sure > 0.3 and np.allclose(K.project(got, p), K.project(h, p), atol=1.0)


def test_backgrounds_recover_a_plane():
    y, x = np.mgrid[8:64:16, 8:64:16].astype(float)
    v = 1 + 0.01 * y + 0.02 * x
    want = 1 + 0.01 * np.arange(64)[:, None] + 0.02 * np.arange(64)[None]
    for f in (K.polynomial_background, K.rbf_background):
        assert np.allclose(f(y.ravel(), x.ravel(), v.ravel(), 64, 64), want, atol=1e-6)
    assert np.allclose(K.rbf_background(y.ravel()[:2], x.ravel()[:2], v.ravel()[:2], 4, 4), np.median(v.ravel()[:2]))


def test_psf_of_a_known_gaussian():
    y, x = np.mgrid[:25, :25]
    a = 0.2 + 2 * np.exp(-0.5 * (((x - 12.3) / 2.0) ** 2 + ((y - 11.8) / 3.0) ** 2))
    p = K.fit_psf(a)
    assert abs(p["fwhm"] - 2.3548 * np.sqrt(6)) < 1e-3 and abs(p["ellipticity"] - 1 / 3) < 1e-3 and p["rms"] < 1e-6


def test_detection_finds_the_stars():
    a, at = field(96, 8, 11)
    found = np.array([(s["cy"], s["cx"]) for s in K.detect(a)])
    assert sum(np.hypot(*(found - p).T).min() < 1.5 for p in at) >= 7  # two may stand too close


def test_denoise_deconvolve_inpaint():
    a, _ = field(48)
    flat = np.full((16, 16), 0.4)
    assert np.array_equal(K.denoise(flat), flat)
    noisy = flat + RNG.normal(0, 0.02, flat.shape)
    assert K.denoise(noisy).std() < noisy.std()
    sharp = K.deconvolve(K.gaussian(a, 1.0))
    assert sharp.max() <= K.gaussian(a, 1.0).max() + 1e-12 and np.abs(sharp - a).mean() < np.abs(K.gaussian(a, 1.0) - a).mean()
    mask = np.zeros((16, 16), bool)
    mask[5:8, 5:8] = True
    assert np.allclose(K.inpaint(np.where(mask, 9.0, 0.4), mask), 0.4)


def test_comet_polygon_offsets_spline():
    ref = np.full((32, 32), 0.1)
    a = ref.copy()
    a[10:14, 20:24] += 1
    y, x, sure = K.comet_nucleus(a, ref, 0.02)
    assert abs(y - 11.5) < 1e-9 and abs(x - 21.5) < 1e-9 and sure == 1.0
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    cut = K.clip_polygon([(2.0, 2.0), (6.0, 2.0), (6.0, 6.0), (2.0, 6.0)], square)
    area = abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(cut, cut[1:] + cut[:1]))) / 2
    assert abs(area - 4) < 1e-9 and K.clip_polygon([(9.0, 9.0), (10.0, 9.0), (10.0, 10.0)], square) == []
    assert np.allclose(K.solve_offsets(3, [(0, 1, -2.0), (1, 2, -1.0), (0, 2, -3.0)]), [0, 2, 3])
    pieces = spline([(0, 0), (0.3, 0.027), (0.5, 0.125), (0.8, 0.512), (1, 1)])  # a cubic is its own spline
    for start, c in pieces:
        assert abs(np.polyval(c, 0.05) - (start + 0.05) ** 3) < 1e-9
