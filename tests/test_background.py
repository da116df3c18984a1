import numpy as np
import pytest
from pyspark.sql import functions as F

from frameflow.layout import frames_to_pixels
from frameflow.operators import background as B
from frameflow.operators import kernels as K


def frame(spark, planes):
    rows = [(k, *a.shape[:2], a.shape[2], a.ravel().tolist()) for k, a in enumerate(planes)]
    return frames_to_pixels(spark.createDataFrame(rows, "frame_id bigint, h int, w int, c int, data array<double>"))


def numpy_model(a, tile, degree, soften):
    """Tile values as surveyed, and numpy's least squares in powers of y and x."""
    (h, w), soft = a.shape, K.rank_filter(a, soften) if soften else a
    ys, xs, vs = [], [], []
    for y in range(0, h, tile):
        for x in range(0, w, tile):
            v = soft[y : y + tile, x : x + tile].ravel()
            v = v[v <= np.percentile(v, 80)]
            if len(v) >= 4:
                near = v[np.abs(v - v.mean()) <= 2.5 * v.std()]
                ys.append((y + min(y + tile, h)) / 2)
                xs.append((x + min(x + tile, w)) / 2)
                vs.append(v.mean() if v.std() < 1e-10 or len(near) < 2 else np.median(near))
    if len(vs) < 4:
        return np.full((h, w), np.median(a))
    terms = lambda yy, xx: np.stack([(yy / max(h - 1, 1)) ** i * (xx / max(w - 1, 1)) ** j for i in range(degree + 1) for j in range(degree + 1 - i)], -1)
    yy, xx = np.mgrid[:h, :w].astype(float)
    return terms(yy, xx) @ np.linalg.lstsq(terms(np.array(ys), np.array(xs)), np.array(vs), rcond=None)[0]


@pytest.mark.parametrize(("h", "w", "tile", "degree", "soften"), [(40, 56, 8, 3, 0), (33, 47, 7, 3, 0), (24, 24, 6, 2, 5), (30, 20, 5, 1, 0), (64, 30, 8, 2, 0), (9, 9, 9, 3, 0)])
def test_model_equals_numpy(spark, h, w, tile, degree, soften):
    rng = np.random.default_rng(h)
    y, x = np.mgrid[:h, :w] / max(h, w)
    planes = [np.stack([0.2 + 0.5 * x * y - 0.3 * y**2 + c * x + rng.normal(0, 0.02, (h, w)) for c in range(2)], 2) for _ in range(2)]
    for a in planes:
        a[rng.integers(0, h, 5), rng.integers(0, w, 5)] += 5
    got = B.polynomial_background(frame(spark, planes), tile, degree, soften=soften)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    out = np.zeros((2, h, w, 2))
    for r in got.collect():
        out[r["frame_id"], r["y"], r["x"], r["ch"]] = r["bg"]
    for k, a in enumerate(planes):
        for c in range(2):
            assert np.allclose(out[k, :, :, c], numpy_model(a[..., c], tile, degree, soften), atol=1e-9)


def test_a_known_surface_comes_back(spark):
    y, x = np.mgrid[:60, :60]
    px = frame(spark, [(0.1 + 0.002 * y + 0.001 * x)[..., None]])
    fitted = B.fit_surface(B.tile_samples(px, 6, share=1.0, soften=0), 1).first()
    assert fitted["n"] == 100 and len(fitted["terms"]) == 3
    assert abs(fitted["terms"][0] - (0.1 + 0.003 * 29.5)) < 2e-3


def test_fewer_samples_than_unknowns_still_pass_through_them(spark):
    """Six samples and ten terms: the surface goes through all of them."""
    samples = spark.createDataFrame([(0, 0, 12, 18, 3.0 + 6 * i, 3.0 + 6 * j, float(i * 5 + j * j)) for i in range(2) for j in range(3)], "frame_id bigint, ch int, h int, w int, y double, x double, v double")
    terms = F.col("terms")
    b = B.basis(F.col("y"), F.col("x"), F.col("h"), F.col("w"), 3)
    met = samples.join(B.fit_surface(samples, 3).select("frame_id", "terms"), "frame_id").select("v", sum((terms[i] * b[i] for i in range(10)), F.lit(0.0)).alias("bg"))
    assert all(abs(r["v"] - r["bg"]) < 1e-6 for r in met.collect())
