"""Point-wise transfer functions and colour spaces as Catalyst expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of grey conversions, by the module that uses them.
GREY = {"registration": (0.2989, 0.5870, 0.1140), "noise": (0.299, 0.587, 0.114), "video": (0.2126, 0.7152, 0.0722), "mean": (1 / 3, 1 / 3, 1 / 3)}

# Centre and half width of each hue range, as shares of the circle.
HUES = {"reds": (0.000, 0.083), "oranges": (0.083, 0.042), "yellows": (0.167, 0.042), "greens": (0.333, 0.125), "cyans": (0.500, 0.042), "blues": (0.667, 0.083), "purples": (0.833, 0.083)}


def clip(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def mtf(x: Column, m: Column | float) -> Column:
    """Midtones transfer: 0 to 0, m to a half, 1 to 1."""
    m = F.lit(m) if isinstance(m, float) else m
    den = (2 * m - 1) * x - m
    den = F.when(F.abs(den) < 1e-10, 1e-10).otherwise(den)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(clip((m - 1) * x / den))


def mtf_apply(x: Column, midpoint: float, shadows: float = 0.0, highlights: float = 1.0) -> Column:
    """Clip to [shadows, highlights], rescale, then ``mtf``; parameters are held to their ranges."""
    m, s, h = min(max(midpoint, 0.001), 0.499), min(max(shadows, 0.0), 0.1), min(max(highlights, 0.98), 1.0)
    return F.lit(0.0) if h - s < 1e-10 else mtf(clip((x - s) / (h - s)), m)


def auto_midpoint(bg: Column, target: float = 0.25) -> Column:
    """The midpoint that brings a background to ``target``; a bright one gets a quarter."""
    den = (2 * target - 1) * bg - target
    return F.when(bg >= target, 0.25).otherwise(clip(target * (bg - 1) / den, 0.001, 0.499))


def asinh_stretch(x: Column, beta: float, black: float = 0.0) -> Column:
    x = clip(x - black) if black > 0 else x
    return clip(x if beta < 1e-9 else F.asinh(x * beta) / F.asinh(F.lit(beta)))


def spline(points: list[tuple[float, float]]) -> list[tuple[float, list[float]]]:
    """Cubic pieces (start, coefficients highest first) through sorted distinct points, not-a-knot at the ends."""
    pts = sorted(dict(points).items())
    x, y = np.array(pts, float).T
    n = len(x)
    if n < 4:  # one polynomial through all points is what not-a-knot leaves
        whole = np.polyfit(x - x[0], y, n - 1)
        return [(float(x[0]), [0.0] * (4 - n) + whole.tolist())]
    h = np.diff(x)
    a, r = np.zeros((n, n)), np.zeros(n)
    a[0, :3] = h[1], -(h[0] + h[1]), h[0]
    a[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
    for k in range(1, n - 1):
        a[k, k - 1 : k + 2] = h[k - 1], 2 * (h[k - 1] + h[k]), h[k]
        r[k] = 6 * ((y[k + 1] - y[k]) / h[k] - (y[k] - y[k - 1]) / h[k - 1])
    m = np.linalg.solve(a, r)  # second derivatives
    return [(float(x[k]), [float((m[k + 1] - m[k]) / (6 * h[k])), float(m[k] / 2), float((y[k + 1] - y[k]) / h[k] - h[k] * (2 * m[k] + m[k + 1]) / 6), float(y[k])]) for k in range(n - 1)]


def tone_curve(x: Column, points: list[tuple[float, float]], levels: int = 65_536) -> Column:
    """The spline at x's level (truncated), clipped to [0, 1]."""
    at = F.least(F.greatest(F.floor(x * (levels - 1)), F.lit(0)), F.lit(levels - 1)) / float(levels - 1)
    out = None
    for start, (a, b, c, d) in spline(points):
        t = at - start
        value = ((t * a + b) * t + c) * t + d
        out = value if out is None else F.when(at >= start, value).otherwise(out)
    return clip(out)


def grey(r: Column, g: Column, b: Column, kind: str = "noise") -> Column:
    w = GREY[kind]
    return r * w[0] + g * w[1] + b * w[2]


def rgb_to_hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue as a share of the circle, saturation and value."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = top - low
    h = F.when(d <= 0, 0.0).when(top == r, (g - b) / d).when(top == g, (b - r) / d + 2).otherwise((r - g) / d + 4) / 6
    return F.pmod(h, F.lit(1.0)), F.when(top > 0, d / top).otherwise(0.0), top


def hsv_to_rgb(h: Column, s: Column, v: Column) -> tuple[Column, Column, Column]:
    def channel(n: int) -> Column:
        k = F.pmod(h * 6 + n, F.lit(6.0))
        return v - v * s * clip(F.least(k, 4 - k))

    return channel(5), channel(3), channel(1)


def hue_multiplier(h: Column, factors: dict[str, float]) -> Column:
    """Triangular weights of the hue ranges' factors, normalised; 1 where no range reaches."""
    weights, total = F.lit(0.0), F.lit(0.0)
    for name, (centre, half) in HUES.items():
        d = F.abs(h - centre)
        w = F.greatest(F.lit(0.0), 1 - F.least(d, 1 - d) / half)
        weights, total = weights + w * factors.get(name, 1.0), total + w
    return F.when(total > 1e-8, weights / total).otherwise(1.0)


def saturate(r: Column, g: Column, b: Column, factors: dict[str, float], overall: float = 1.0) -> tuple[Column, Column, Column]:
    h, s, v = rgb_to_hsv(r, g, b)
    out = hsv_to_rgb(h, clip(s * hue_multiplier(h, factors) * overall), v)
    return clip(out[0]), clip(out[1]), clip(out[2])


def magnitude(flux: Column) -> Column:
    return F.log10(F.greatest(flux, F.lit(1e-10))) * -2.5


def denoise_strength(sigma: Column) -> Column:
    """Piecewise linear from 0.2 at a sky sigma of 0.005 over 0.5 at 0.015 and 0.8 at 0.040 up to 1."""
    return (
        F.when(sigma <= 0.005, 0.2).when(sigma <= 0.015, (sigma - 0.005) * 30 + 0.2).when(sigma <= 0.040, (sigma - 0.015) * 12 + 0.5)
        .otherwise(F.least((sigma - 0.040) / 0.3 + 0.8, F.lit(1.0)))
    )


def shoelace(points: Column) -> Column:
    """Area of a polygon given as an array of (x, y); zero below three points."""
    following = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    cross = F.zip_with(points, following, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.when(F.size(points) < 3, 0.0).otherwise(F.abs(F.aggregate(cross, F.lit(0.0), lambda a, b: a + b)) / 2)
