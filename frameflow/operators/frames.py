"""Kernels over frames (L1) and tiles (L3) in Arrow batches: a frame or tile is a task's unit, so memory is bounded by it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameflow.layout import pixels_to_tiles
from frameflow.operators import kernels as K

Plane = Callable[[np.ndarray], np.ndarray]

#: Kernels that work on one plane, by name; each takes the plane and its keywords.
PLANE_KERNELS: dict[str, Callable] = {
    "gaussian": K.gaussian, "median": lambda a, size=3: K.rank_filter(a, size), "minimum": lambda a, size=3: K.rank_filter(a, size, np.min), "denoise": K.denoise, "deconvolve": K.deconvolve, "shift": K.shift, "laplacian": K.laplacian,
}


def planes(row_data, h: int, w: int, c: int) -> np.ndarray:
    return np.asarray(row_data, float).reshape(h, w, c)


def map_planes(frames: DataFrame, kernel: str | Plane, **options) -> DataFrame:
    """L1 with each channel's plane put through a kernel; other columns stay."""
    f = PLANE_KERNELS[kernel] if isinstance(kernel, str) else kernel

    def work(batches):
        for pdf in batches:
            pdf = pdf.copy()
            pdf["data"] = [np.stack([f(p, **options) for p in np.moveaxis(planes(d, h, w, c), 2, 0)], 2).ravel() for d, h, w, c in zip(pdf["data"], pdf["h"], pdf["w"], pdf["c"])]
            yield pdf

    return frames.mapInPandas(work, frames.schema)


def map_tiles(pixels: DataFrame, sizes: DataFrame, kernel: str | Plane, tile: int, overlap: int, ramp: bool = True, **options) -> DataFrame:
    """L2 through a kernel in overlapping tiles, merged by cosine ramps (or equal weights): for frames beyond a task's memory.

    The overlap must be at least the kernel's reach on both sides for seams to vanish."""
    f = PLANE_KERNELS[kernel] if isinstance(kernel, str) else kernel
    tiles = pixels_to_tiles(pixels, sizes, tile, overlap)

    def line(n: int) -> np.ndarray:
        w, r = np.ones(n), min(overlap, n // 2)
        if ramp and r:
            up = 0.5 * (1 - np.cos(np.pi * (np.arange(r) + 0.5) / r))
            w[:r], w[-r:] = up, up[::-1]
        return w

    def work(batches):
        for pdf in batches:
            pdf = pdf.copy()
            pdf["weight"] = [np.outer(line(h), line(w)).ravel() for h, w in zip(pdf["h"], pdf["w"])]
            pdf["data"] = [f(np.asarray(d, float).reshape(h, w), **options).ravel() for d, h, w in zip(pdf["data"], pdf["h"], pdf["w"])]
            yield pdf

    schema = tiles.withColumn("weight", F.array(F.lit(0.0))).schema
    done = tiles.mapInPandas(work, schema).select("frame_id", "ch", "y0", "x0", "w", F.posexplode(F.arrays_zip("data", "weight")).alias("i", "p"))
    spread = done.select("frame_id", "ch", (F.col("y0") + F.expr("i div w")).cast("int").alias("y"), (F.col("x0") + F.col("i") % F.col("w")).cast("int").alias("x"), F.col("p.data").alias("v"), F.greatest("p.weight", F.lit(1e-6)).alias("k"))
    return spread.groupBy("frame_id", "ch", "y", "x").agg((F.sum(F.col("v") * F.col("k")) / F.sum("k")).alias("v"))


def grey_plane(d, h, w, c) -> np.ndarray:
    return planes(d, h, w, c).mean(2)


def detect_stars(frames: DataFrame, k: float = 3.0, least: int = 3, top: int = 200) -> DataFrame:
    """Star rows (frame_id, star_id, y, x, cy, cx, flux, area) of each frame's mean over channels, strongest first."""

    def work(batches):
        for pdf in batches:
            rows = [(f, n, s["y"], s["x"], s["cy"], s["cx"], s["flux"], s["area"]) for f, d, h, w, c in zip(pdf["frame_id"], pdf["data"], pdf["h"], pdf["w"], pdf["c"]) for n, s in enumerate(K.detect(grey_plane(d, h, w, c), k, least=least)[:top])]
            yield pd.DataFrame(rows, columns=["frame_id", "star_id", "y", "x", "cy", "cx", "flux", "area"])

    return frames.mapInPandas(work, "frame_id bigint, star_id int, y int, x int, cy double, cx double, flux double, area int")


def measure_psf(frames: DataFrame, reach: int = 12, k: float = 4.0, top: int = 200) -> DataFrame:
    """Detected stars with their fitted fwhm, ellipticity, residual and a Strehl stand-in (peak over the ideal peak)."""

    def work(batches):
        for pdf in batches:
            rows = []
            for f, d, h, w, c in zip(pdf["frame_id"], pdf["data"], pdf["h"], pdf["w"], pdf["c"]):
                a = grey_plane(d, h, w, c)
                for n, s in enumerate(K.detect(a, k)[:top]):
                    patch = a[max(s["y"] - reach, 0) : s["y"] + reach + 1, max(s["x"] - reach, 0) : s["x"] + reach + 1]
                    p = K.fit_psf(patch)
                    rows.append((f, n, s["cy"], s["cx"], s["flux"], p["fwhm"], p["ellipticity"], p["rms"], float(min(1.0, p["amplitude"] / max(patch.max() - np.median(patch), 1e-12)))))
            yield pd.DataFrame(rows, columns=["frame_id", "star_id", "cy", "cx", "flux", "fwhm", "ellipticity", "rms", "strehl"])

    return frames.mapInPandas(work, "frame_id bigint, star_id int, cy double, cx double, flux double, fwhm double, ellipticity double, rms double, strehl double")


def register(frames: DataFrame, reference: np.ndarray, method: str = "phase", least_confidence: float = 0.3) -> DataFrame:
    """L1 aligned to one reference frame (a single frame, sent to the workers): columns confidence and accepted are added.

    'phase': whole-frame correlation and a spline shift; 'star': median shift of detected stars; 'feature': a homography.
    A frame below the confidence is left as it is and not accepted."""
    spark = frames.sparkSession
    held = spark.sparkContext.broadcast(reference)

    def moved(a: np.ndarray, seed: int) -> tuple[Callable | None, float]:
        ref = held.value
        if method == "feature":
            h, sure = K.align(ref, a, seed)
            return (lambda p: K.warp(p, h)), sure
        if method == "star":
            here, there = K.detect(a), K.detect(ref)
            steps = []
            for s in here:
                near = min(there, key=lambda t: (t["cy"] - s["cy"]) ** 2 + (t["cx"] - s["cx"]) ** 2, default=None)
                if near and np.hypot(near["cy"] - s["cy"], near["cx"] - s["cx"]) < 50:
                    steps.append((near["cy"] - s["cy"], near["cx"] - s["cx"]))
            if len(steps) >= 3:
                dy, dx = np.median(np.array(steps), 0)
                return (lambda p: K.shift(p, dy, dx)), 1.0
        dy, dx = K.phase_shift(ref, a)
        return (lambda p: K.shift(p, -dy, -dx)), 1.0

    def work(batches):
        for pdf in batches:
            pdf = pdf.copy()
            out, sure = [], []
            for f, d, h, w, c in zip(pdf["frame_id"], pdf["data"], pdf["h"], pdf["w"], pdf["c"]):
                p = planes(d, h, w, c)
                step, confidence = moved(p.mean(2), int(f) & 0x7FFFFFFF)
                ok = confidence >= least_confidence
                out.append(np.stack([step(q) if ok else q for q in np.moveaxis(p, 2, 0)], 2).ravel())
                sure.append(confidence)
            pdf["data"], pdf["confidence"] = out, sure
            pdf["accepted"] = pdf["confidence"] >= least_confidence
            yield pdf

    return frames.mapInPandas(work, frames.withColumns({"confidence": F.lit(0.0), "accepted": F.lit(True)}).schema)


def track_comet(frames: DataFrame, reference: np.ndarray) -> DataFrame:
    """(frame_id, y, x, confidence) of the nucleus against the median frame."""
    held = frames.sparkSession.sparkContext.broadcast(reference)

    def work(batches):
        for pdf in batches:
            rows = [(f, *K.comet_nucleus(grey_plane(d, h, w, c), held.value)) for f, d, h, w, c in zip(pdf["frame_id"], pdf["data"], pdf["h"], pdf["w"], pdf["c"])]
            yield pd.DataFrame(rows, columns=["frame_id", "y", "x", "confidence"])

    return frames.mapInPandas(work, "frame_id bigint, y double, x double, confidence double")


def shift_to(frames: DataFrame, positions: DataFrame, y: float, x: float) -> DataFrame:
    """L1 moved so that each frame's position comes to (y, x): a comet's nucleus stands still, the stars trail."""
    joined = frames.join(positions.select("frame_id", F.col("y").alias("__y"), F.col("x").alias("__x")), "frame_id")

    def work(batches):
        for pdf in batches:
            pdf = pdf.copy()
            pdf["data"] = [np.stack([K.shift(p, y - py, x - px) for p in np.moveaxis(planes(d, h, w, c), 2, 0)], 2).ravel() for d, h, w, c, py, px in zip(pdf["data"], pdf["h"], pdf["w"], pdf["c"], pdf["__y"], pdf["__x"])]
            yield pdf.drop(columns=["__y", "__x"])

    return joined.mapInPandas(work, frames.schema)


def background_model(frames: DataFrame, method: str = "polynomial", tile: int = 64, degree: int = 3) -> DataFrame:
    """L1 of background models per channel, from robust tile values after a 5 by 5 median."""

    def model(a: np.ndarray) -> np.ndarray:
        soft, (h, w) = K.rank_filter(a, 5), a.shape
        ys, xs, vs = [], [], []
        for y in range(0, h, tile):
            for x in range(0, w, tile):
                v = soft[y : y + tile, x : x + tile].ravel()
                v = v[v <= np.percentile(v, 80)]
                if len(v) < 4:
                    continue
                m, s = v.mean(), v.std()
                near = v[np.abs(v - m) <= 2.5 * s]
                ys.append(y + (min(tile, h - y) - 1) / 2)
                xs.append(x + (min(tile, w - x) - 1) / 2)
                vs.append(m if s < 1e-10 or len(near) < 2 else np.median(near))
        fit = (np.array(ys), np.array(xs), np.array(vs), h, w)
        return K.polynomial_background(*fit, degree) if method == "polynomial" else K.rbf_background(*fit)

    return map_planes(frames, model)


def remove_stars(frames: DataFrame, k: float = 4.0, low: int = 4, high: int = 2000, aspect: float = 4.0, grow: int = 3) -> DataFrame:
    """L1 without stars, with their mask (0 or 1 a pixel) as an array column."""

    def work(batches):
        for pdf in batches:
            pdf = pdf.copy()
            out, masks = [], []
            for d, h, w, c in zip(pdf["data"], pdf["h"], pdf["w"], pdf["c"]):
                p = planes(d, h, w, c)
                g = p.mean(2)
                mask = np.zeros((h, w), bool)
                if g.std() >= 1e-8:
                    names, n = K.label(g > g.mean() + k * g.std())
                    for i in range(1, n + 1):
                        ys, xs = np.nonzero(names == i)
                        a, b = np.ptp(ys) + 1, np.ptp(xs) + 1
                        if low <= len(ys) <= high and max(a, b) / min(a, b) <= aspect:
                            mask[ys, xs] = True
                for _ in range(grow):
                    q = np.pad(mask, 1)
                    mask = q[1:-1, 1:-1] | q[:-2, 1:-1] | q[2:, 1:-1] | q[1:-1, :-2] | q[1:-1, 2:]
                out.append(np.stack([K.inpaint(q, mask) for q in np.moveaxis(p, 2, 0)], 2).ravel())
                masks.append(mask.ravel().astype(float))
            pdf["data"], pdf["mask"] = out, masks
            yield pdf

    return frames.mapInPandas(work, frames.withColumn("mask", F.array(F.lit(0.0))).schema)


def synthetic_flat(models: DataFrame) -> DataFrame:
    """One L1 flat from background models: pixel-wise median, blurred by 8, over its maximum (ones where that isn't positive)."""
    from frameflow.layout import frames_to_pixels, pixels_to_frames

    middle = frames_to_pixels(models).groupBy("ch", "y", "x").agg(F.median("v").alias("v")).select(F.lit(0).cast("bigint").alias("frame_id"), "ch", "y", "x", "v")

    def flat(a: np.ndarray) -> np.ndarray:
        s = K.gaussian(a, 8.0)
        return s / s.max() if s.max() > 0 else np.ones_like(s)

    return map_planes(pixels_to_frames(middle), flat)


def infer(frames: DataFrame, session: Callable[[], Callable[[np.ndarray], np.ndarray]] | None = None) -> DataFrame:
    """L1 through a model that each worker loads once (``session()`` gives the function); identity without a model."""

    def work(batches):
        run = session() if session else (lambda a: a)
        for pdf in batches:
            pdf = pdf.copy()
            pdf["data"] = [np.stack([_scaled(run, p) for p in np.moveaxis(planes(d, h, w, c), 2, 0)], 2).ravel() for d, h, w, c in zip(pdf["data"], pdf["h"], pdf["w"], pdf["c"])]
            yield pdf

    return frames.mapInPandas(work, frames.schema)


def _scaled(run: Callable, a: np.ndarray) -> np.ndarray:
    lo, hi = a.min(), a.max()
    return a if hi <= lo else np.clip(run((a - lo) / (hi - lo)), 0, 1) * (hi - lo) + lo
