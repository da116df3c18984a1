"""NumPy kernels on one plane or frame, for what Catalyst can't express. Applied by ``frameflow.operators.frames``.

Boundaries are reflected as d c b a | a b c d | d c b a unless a kernel says otherwise.
"""

from __future__ import annotations

import numpy as np


def gaussian_weights(sigma: float, truncate: float = 4.0) -> np.ndarray:
    r = int(truncate * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return w / w.sum()


def _reflect(n: int, r: int) -> np.ndarray:
    i = np.arange(-r, n + r) % (2 * n)
    return np.where(i < n, i, 2 * n - 1 - i)


def convolve_axis(a: np.ndarray, w: np.ndarray, axis: int) -> np.ndarray:
    r, n = len(w) // 2, a.shape[axis]
    padded = np.take(a, _reflect(n, r), axis)
    return sum(k * np.take(padded, np.arange(j, j + n), axis) for j, k in enumerate(w[::-1]))


def gaussian(a: np.ndarray, sigma: float) -> np.ndarray:
    if sigma <= 0:
        return a.astype(float)
    w = gaussian_weights(sigma)
    return convolve_axis(convolve_axis(a.astype(float), w, 0), w, 1)


def convolve(a: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    kh, kw = kernel.shape
    p = a[_reflect(a.shape[0], kh // 2)][:, _reflect(a.shape[1], kw // 2)]
    windows = np.lib.stride_tricks.sliding_window_view(p, kernel.shape)
    return np.einsum("yxij,ij->yx", windows, kernel[::-1, ::-1])[: a.shape[0], : a.shape[1]]


def rank_filter(a: np.ndarray, size: int, how=np.median) -> np.ndarray:
    r = size // 2
    p = a[_reflect(a.shape[0], r)][:, _reflect(a.shape[1], r)]
    return how(np.lib.stride_tricks.sliding_window_view(p, (size, size)), axis=(2, 3))


def laplacian(a: np.ndarray) -> np.ndarray:
    return convolve(a.astype(float), np.array([[0, 1, 0], [1, -4, 1], [0, 1, 0]], float))


def mad_sigma(a: np.ndarray) -> float:
    return float(np.median(np.abs(a - np.median(a))) * 1.4826)


def label(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """4-connected components, numbered from 1 in reading order."""
    h, w = mask.shape
    out = np.where(mask, np.arange(1, h * w + 1).reshape(h, w), 0)
    while True:  # spread the smallest number along whole runs, in both directions of both axes
        before = out.copy()
        for axis in (0, 1):
            lines = out if axis == 1 else out.T
            for step in (1, -1):
                view = lines[:, ::step]
                for x in range(1, view.shape[1]):
                    both = (view[:, x] > 0) & (view[:, x - 1] > 0)
                    view[:, x] = np.where(both, np.minimum(view[:, x], view[:, x - 1]), view[:, x])
        if np.array_equal(before, out):
            break
    names = np.unique(out[out > 0])
    return np.searchsorted(names, out, side="left") * (out > 0) + (out > 0), len(names)


def distance_transform(mask: np.ndarray) -> np.ndarray:
    """Exact Euclidean distance of each true pixel to the nearest false one, by lower envelopes along both axes."""
    far = float(sum(mask.shape) ** 2)

    def envelope(f: np.ndarray) -> np.ndarray:
        n = len(f)
        v, z, k = np.zeros(n, int), np.full(n + 1, np.inf), 0
        z[0] = -np.inf
        for q in range(1, n):
            while True:
                s = (f[q] + q * q - f[v[k]] - v[k] ** 2) / (2 * (q - v[k]))
                if s > z[k]:
                    break
                k -= 1
            k += 1
            v[k], z[k], z[k + 1] = q, s, np.inf
        near = v[np.searchsorted(z[1 : k + 1], np.arange(n))]
        return (np.arange(n) - near) ** 2 + f[near]

    d = np.where(mask, far, 0.0)
    d = np.apply_along_axis(envelope, 0, d)
    return np.sqrt(np.apply_along_axis(envelope, 1, d))


def feather(mask: np.ndarray, how: str = "distance") -> np.ndarray:
    """Weights that fall to the edge of a footprint, by distance or a cosine of it."""
    d = distance_transform(np.pad(mask, 1))[1:-1, 1:-1]
    d = d / d.max() if d.max() > 0 else d
    return 0.5 * (1 - np.cos(np.pi * d)) if how == "feather" else d


def spline_coefficients(a: np.ndarray, axis: int) -> np.ndarray:
    """Cubic B-spline coefficients along an axis, mirrored about the outer samples."""
    pole = np.sqrt(3.0) - 2
    c = np.moveaxis(a.astype(float), axis, 0).copy() * 6
    n = len(c)
    if n == 1:
        return a.astype(float)
    powers = pole ** np.arange(n)
    mirrored = np.concatenate([c, c[-2:0:-1]])
    weights = np.concatenate([powers, pole ** np.arange(n, 2 * n - 2)])
    c[0] = np.tensordot(weights, mirrored, 1) / (1 - pole ** (2 * n - 2))
    for k in range(1, n):
        c[k] += pole * c[k - 1]
    c[-1] = pole / (pole * pole - 1) * (c[-1] + pole * c[-2])
    for k in range(n - 2, -1, -1):
        c[k] = pole * (c[k + 1] - c[k])
    return np.moveaxis(c, 0, axis)


def shift(a: np.ndarray, dy: float, dx: float) -> np.ndarray:
    """out[p] = a(p - shift) by cubic splines; 0 where that lies outside."""
    out = a.astype(float)
    for axis, d in ((0, dy), (1, dx)):
        n = out.shape[axis]
        at = np.arange(n) - d
        inside = (at >= 0) & (at <= n - 1)
        c = np.moveaxis(spline_coefficients(out, axis), axis, 0)
        first = np.floor(at).astype(int)
        t = at - first
        weights = [(1 - t) ** 3 / 6, (4 - 6 * t**2 + 3 * t**3) / 6, (1 + 3 * t + 3 * t**2 - 3 * t**3) / 6, t**3 / 6]
        moved = 0
        for k, w in enumerate(weights):
            i = np.abs(first - 1 + k) % max(1, 2 * n - 2)
            i = np.where(i < n, i, 2 * n - 2 - i)
            moved = moved + (w * inside)[:, None] * c[i]
        out = np.moveaxis(moved, 0, axis)
    return out


def phase_shift(reference: np.ndarray, target: np.ndarray, upsample: int = 10) -> tuple[float, float]:
    """(dy, dx) by which ``target`` is moved against ``reference``, to 1 / upsample of a pixel.

    The sign is that of target = roll(reference, d), so shifting the target by -d aligns it."""
    cross = np.fft.fft2(target) * np.conj(np.fft.fft2(reference))
    cross /= np.maximum(np.abs(cross), 1e-12)
    h, w = reference.shape
    peak = np.unravel_index(int(np.argmax(np.fft.ifft2(cross).real)), (h, w))
    d = [p - n if p > n // 2 else p for p, n in zip(peak, (h, w))]
    fine = np.arange(-upsample, upsample + 1) / upsample
    fy, fx = np.fft.fftfreq(h), np.fft.fftfreq(w)
    rows = np.exp(2j * np.pi * np.outer(d[0] + fine, fy))
    cols = np.exp(2j * np.pi * np.outer(fx, d[1] + fine))
    near = (rows @ cross @ cols).real
    j, i = np.unravel_index(int(np.argmax(near)), near.shape)
    return float(d[0] + fine[j]), float(d[1] + fine[i])


def keypoints(a: np.ndarray, top: int = 256, border: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Maxima of a difference of Gaussians: (y, x) and z-scored 8 by 8 patches, strongest first."""
    d = np.abs(gaussian(a, 1.0) - gaussian(a, 2.0))
    best = (d == rank_filter(d, 7, np.max)) & (d > max(2 * d.mean(), 1e-10))
    best[:border], best[-border:], best[:, :border], best[:, -border:] = False, False, False, False
    at = np.argwhere(best)
    at = at[np.argsort(-d[tuple(at.T)], kind="stable")[:top]]
    patches = np.array([a[y - 4 : y + 4, x - 4 : x + 4].ravel() for y, x in at], float).reshape(len(at), 64)
    return at, (patches - patches.mean(1, keepdims=True)) / (patches.std(1, keepdims=True) + 1e-8)


def mutual_matches(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Index pairs of descriptors that are each other's most similar by cosine."""
    if not len(a) or not len(b):
        return np.zeros((0, 2), int)
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    s = unit(a) @ unit(b).T
    forth, back = s.argmax(1), s.argmax(0)
    k = np.flatnonzero(back[forth] == np.arange(len(a)))
    return np.column_stack([k, forth[k]])


def homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Least-squares H with dst ~ H src, for (x, y) points."""
    rows = []
    for (x, y), (u, v) in zip(src, dst):
        rows += [[-x, -y, -1, 0, 0, 0, u * x, u * y, u], [0, 0, 0, -x, -y, -1, v * x, v * y, v]]
    h = np.linalg.svd(np.array(rows))[2][-1].reshape(3, 3)
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else h


def project(h: np.ndarray, pts: np.ndarray) -> np.ndarray:
    p = np.column_stack([pts, np.ones(len(pts))]) @ h.T
    return p[:, :2] / np.where(np.abs(p[:, 2:]) < 1e-12, 1e-12, p[:, 2:])


def ransac(src: np.ndarray, dst: np.ndarray, rounds: int = 1000, tolerance: float = 3.0, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The homography with most inliers over samples of four, refitted on them, and the inlier mask."""
    rng, best = np.random.default_rng(seed), np.zeros(len(src), bool)
    for _ in range(rounds if len(src) >= 4 else 0):
        pick = rng.choice(len(src), 4, replace=False)
        near = np.linalg.norm(project(homography(src[pick], dst[pick]), src) - dst, axis=1) < tolerance
        if near.sum() > best.sum():
            best = near
            if best.all():
                break
    return (homography(src[best], dst[best]), best) if best.sum() >= 4 else (np.eye(3), best)


def align(reference: np.ndarray, target: np.ndarray, seed: int = 0, least: int = 6) -> tuple[np.ndarray, float]:
    """The homography from reference to target places and its confidence (inliers over matches); identity and 0 if poor."""
    (ka, da), (kb, db) = keypoints(reference), keypoints(target)
    pairs = mutual_matches(da, db)
    if min(len(ka), len(kb)) < least or len(pairs) < least:
        return np.eye(3), 0.0
    h, inliers = ransac(ka[pairs[:, 0]][:, ::-1].astype(float), kb[pairs[:, 1]][:, ::-1].astype(float), seed=seed)
    return h, float(inliers.sum() / len(pairs))


def warp(a: np.ndarray, h: np.ndarray) -> np.ndarray:
    """out[p] = a[h p], bilinear, 0 outside."""
    y, x = np.mgrid[: a.shape[0], : a.shape[1]]
    p = project(h, np.column_stack([x.ravel(), y.ravel()]).astype(float))
    x0, y0 = np.floor(p[:, 0]).astype(int), np.floor(p[:, 1]).astype(int)
    fx, fy = p[:, 0] - x0, p[:, 1] - y0
    out = np.zeros(a.size)
    for j, wy in ((0, 1 - fy), (1, fy)):
        for i, wx in ((0, 1 - fx), (1, fx)):
            ok = (y0 + j >= 0) & (y0 + j < a.shape[0]) & (x0 + i >= 0) & (x0 + i < a.shape[1])
            out[ok] += (wy * wx)[ok] * a[y0[ok] + j, x0[ok] + i]
    return out.reshape(a.shape)


def denoise(a: np.ndarray, strength: float = 1.0) -> np.ndarray:
    """Impulses to the median, then a mix of three blurs; what is far from its median, by the noise, stays as it is."""
    a = a.astype(float)
    noise = mad_sigma(laplacian(a)) / np.sqrt(20)
    if noise < 1e-10:
        return a
    med = rank_filter(a, 3)
    off = np.abs(a - med)
    clean = np.where(off > 5 * noise, med, a)
    soft = 0.5 * gaussian(clean, 1) + 0.3 * gaussian(clean, 2) + 0.2 * gaussian(clean, 4)
    keep = np.clip(off / (3 * noise + 1e-10), 0, 1)
    return a + strength * (keep * clean + (1 - keep) * soft - a)


def deconvolve(a: np.ndarray, sigma: float = 1.0, size: int = 5, rounds: int = 10) -> np.ndarray:
    """Richardson-Lucy with a Gaussian point spread, clipped to [0, the input's maximum]."""
    r = np.arange(size) - size // 2
    psf = np.exp(-(r[:, None] ** 2 + r[None, :] ** 2) / (2 * sigma * sigma))
    psf /= psf.sum()
    est = np.maximum(a.astype(float), 0) + 1e-12
    for _ in range(rounds):
        est = est * convolve(a / (convolve(est, psf) + np.finfo(float).eps), psf[::-1, ::-1])
    return np.clip(est, 0, a.max())


def polynomial_background(y: np.ndarray, x: np.ndarray, v: np.ndarray, h: int, w: int, degree: int = 3) -> np.ndarray:
    """Least squares over samples in y^a x^b, a + b <= degree, on places scaled by the frame; fewer than 4: their median."""
    if len(v) < 4:
        return np.full((h, w), np.median(v) if len(v) else 0.0)
    basis = lambda yy, xx: np.stack([(yy / max(h - 1, 1)) ** a * (xx / max(w - 1, 1)) ** b for a in range(degree + 1) for b in range(degree + 1 - a)], -1)
    c = np.linalg.lstsq(basis(y, x), v, rcond=None)[0]
    yy, xx = np.mgrid[:h, :w].astype(float)
    return basis(yy, xx) @ c


def rbf_background(y: np.ndarray, x: np.ndarray, v: np.ndarray, h: int, w: int) -> np.ndarray:
    """Thin-plate spline through the samples with a linear part."""
    if len(v) < 4:
        return polynomial_background(y, x, v, h, w)
    pts = np.column_stack([y, x]).astype(float)

    def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        r2 = ((a[:, None] - b[None]) ** 2).sum(-1)
        return 0.5 * r2 * np.log(np.where(r2 > 0, r2, 1))

    lin = np.column_stack([np.ones(len(pts)), pts])
    m = np.block([[kernel(pts, pts), lin], [lin.T, np.zeros((3, 3))]])
    c = np.linalg.lstsq(m, np.concatenate([v, np.zeros(3)]), rcond=None)[0]
    out = np.empty(h * w)
    yy, xx = np.mgrid[:h, :w]
    grid = np.column_stack([yy.ravel(), xx.ravel()]).astype(float)
    for k in range(0, len(grid), 1 << 16):
        g = grid[k : k + (1 << 16)]
        out[k : k + len(g)] = kernel(g, pts) @ c[:-3] + np.column_stack([np.ones(len(g)), g]) @ c[-3:]
    return out.reshape(h, w)


def inpaint(a: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Masked pixels take the background's median, then three ever finer blurs."""
    out = a.astype(float).copy()
    if mask.all() or not mask.any():
        return out
    out[mask] = np.median(a[~mask])
    for sigma in (8, 4, 2):
        out[mask] = gaussian(out, sigma)[mask]
    return out


def detect(a: np.ndarray, k: float = 3.0, sigma: float = 2.0, least: int = 3) -> list[dict]:
    """Sources in the negative Laplacian of a blur over mean + k sd: peak, centroid, flux, area, by descending flux."""
    log = -laplacian(gaussian(a, sigma))
    names, n = label(log > log.mean() + k * log.std())
    out = []
    for i in range(1, n + 1):
        ys, xs = np.nonzero(names == i)
        v = a[ys, xs]
        if len(ys) < least or v.sum() <= 0:
            continue
        top = int(np.argmax(v))
        out.append({"y": int(ys[top]), "x": int(xs[top]), "cy": float((ys * v).sum() / v.sum()), "cx": float((xs * v).sum() / v.sum()), "flux": float(v.sum()), "area": len(ys)})
    return sorted(out, key=lambda s: (-s["flux"], s["y"], s["x"]))


def fit_psf(patch: np.ndarray, rounds: int = 60) -> dict:
    """An elliptical Gaussian on a constant by damped least squares from the moments: widths, angle, fwhm, ellipticity, rms."""
    y, x = np.mgrid[: patch.shape[0], : patch.shape[1]].astype(float)
    base = float(np.median(patch))
    w = np.clip(patch - base, 0, None)
    total = w.sum() or 1.0
    cy, cx = (w * y).sum() / total, (w * x).sum() / total
    sy = np.sqrt(max((w * (y - cy) ** 2).sum() / total, 0.3))
    sx = np.sqrt(max((w * (x - cx) ** 2).sum() / total, 0.3))
    p = np.array([max(float(patch.max()) - base, 1e-6), cy, cx, sy, sx, 0.0, base])

    def model(p: np.ndarray) -> np.ndarray:
        c, s = np.cos(p[5]), np.sin(p[5])
        u, v = c * (x - p[2]) + s * (y - p[1]), -s * (x - p[2]) + c * (y - p[1])
        return p[0] * np.exp(-0.5 * ((u / p[4]) ** 2 + (v / p[3]) ** 2)) + p[6]

    damp, r = 1e-2, (model(p) - patch).ravel()
    for _ in range(rounds):
        steps = 1e-5 * np.maximum(np.abs(p), 1e-2)
        j = np.column_stack([(model(p + np.eye(7)[k] * steps[k]).ravel() - model(p).ravel()) / steps[k] for k in range(7)])
        a, g = j.T @ j, j.T @ r
        q = p - np.linalg.lstsq(a + damp * np.diag(np.diag(a) + 1e-12), g, rcond=None)[0]
        q[3:5] = np.clip(np.abs(q[3:5]), 0.2, max(patch.shape))
        new = (model(q) - patch).ravel()
        if new @ new < r @ r:
            done = r @ r - new @ new < 1e-14 * (r @ r + 1e-30)
            p, r, damp = q, new, damp / 3
            if done:
                break
        else:
            damp *= 4
            if damp > 1e8:
                break
    big, small = max(p[3], p[4]), min(p[3], p[4])
    return {"amplitude": p[0], "cy": p[1], "cx": p[2], "fwhm": 2.3548 * float(np.sqrt(big * small)), "ellipticity": float(1 - small / big), "rms": float(np.sqrt(np.mean(r * r)))}


def comet_nucleus(a: np.ndarray, reference: np.ndarray, share: float = 0.002, least: int = 5) -> tuple[float, float, float]:
    """(y, x, confidence) of the brightest moving blob; the brightest pixel with a low confidence where none is large enough."""
    d = np.clip(a - reference, 0, None)
    if d.max() <= 0:
        return (a.shape[0] - 1) / 2, (a.shape[1] - 1) / 2, 0.0
    cut = np.sort(d.ravel())[-max(1, int(d.size * share))]
    names, n = label((d >= cut) & (d > 0))
    blobs = [(float(d[names == i].sum()), i) for i in range(1, n + 1) if (names == i).sum() >= least]
    if not blobs:
        y, x = np.unravel_index(int(np.argmax(d)), d.shape)
        return float(y), float(x), 0.3
    flux, i = max(blobs)
    ys, xs = np.nonzero(names == i)
    v = d[ys, xs]
    return float((ys * v).sum() / flux), float((xs * v).sum() / flux), float(min(1.0, flux / (v.max() * 5)))


def clip_polygon(subject: list[tuple[float, float]], window: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """The part of a polygon inside a convex counter-clockwise window, cut edge by edge."""
    out = list(subject)
    for (ax, ay), (bx, by) in zip(window, window[1:] + window[:1]):
        side = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x, y in out]
        cut = []
        for k, (p, s) in enumerate(zip(out, side)):
            q, t = out[k - 1], side[k - 1]
            if (s >= 0) != (t >= 0) and abs(t - s) > 1e-12:
                f = t / (t - s)
                cut.append((q[0] + f * (p[0] - q[0]), q[1] + f * (p[1] - q[1])))
            if s >= 0:
                cut.append(p)
        out = cut
    return out


def solve_offsets(n: int, edges: list[tuple[int, int, float]]) -> np.ndarray:
    """Panel offsets whose differences fit the edges' (a, b, offset a - offset b) best, panel 0 fixed at 0."""
    if n < 2 or not edges:
        return np.zeros(n)
    m, r = np.zeros((len(edges), n)), np.zeros(len(edges))
    for k, (a, b, d) in enumerate(edges):
        m[k, a], m[k, b], r[k] = 1, -1, d
    return np.concatenate([[0.0], np.linalg.lstsq(m[:, 1:], r, rcond=None)[0]])
