"""From a configuration to one lazy plan: a bundle of frames and images goes through the enabled steps in fixed order.

Steps at their neutral parameters are left out of the plan. Point-wise steps work on pixels (L2) and fuse in Catalyst;
steps with a neighbourhood kernel go through frames (L1). Nothing runs before the caller's action but what a step
has to know: registration's reference and the comet's median, one frame each; a drizzle's size; a mosaic's overlaps, a row
a pair of panels; a colour fit's medians; and the files that an export writes.
"""

from __future__ import annotations

import threading
import uuid
import warnings
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, fields, replace
from enum import Enum

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameflow.functions import curves as C
from frameflow.layout import frames_to_pixels, pixels_to_frames
from frameflow.operators import frames as K
from frameflow.operators import pixels as P
from frameflow.operators import stencil as S


class Stage(str, Enum):
    CALIBRATION = "calibration"
    REGISTRATION = "registration"
    STACKING = "stacking"
    DRIZZLE = "drizzle"
    MOSAIC = "mosaic"
    COMET_STACKING = "comet_stacking"
    PROCESSING = "processing"
    ASTROMETRY = "astrometry"
    PHOTOMETRY = "photometry"
    SAVING = "saving"


@dataclass(frozen=True)
class Bundle:
    """What a step sees: frames (L1), the result image (L2, frame_id 0) and side images; ``meta`` describes what was done."""

    frames: DataFrame | None = None
    result: DataFrame | None = None
    starless: DataFrame | None = None
    mask: DataFrame | None = None
    meta: dict = field(default_factory=dict)

    def noting(self, **facts) -> Bundle:
        return replace(self, meta=self.meta | facts)


@dataclass(frozen=True)
class Step:
    """A user-defined step is any function from bundle to bundle with a name and a stage."""

    name: str
    stage: Stage
    apply: Callable[[Bundle], Bundle]


class Pipeline:
    def __init__(self, steps: list[Step] | None = None):
        self.steps = list(steps or [])

    def add(self, step: Step) -> Pipeline:
        self.steps.append(step)
        return self

    def run(self, bundle: Bundle, progress: Callable[[str, int, int], None] | None = None, cancelled: Callable[[], bool] | None = None, poll: float = 0.2) -> Bundle:
        """Compose the plan. ``cancelled`` is asked between steps, and every ``poll`` seconds while one runs: its Spark jobs
        carry a tag of this run's own and are interrupted by it. InterruptedError tells where."""
        spark = SparkSession.getActiveSession() if cancelled else None
        for k, step in enumerate(self.steps):
            if cancelled and cancelled():
                raise InterruptedError(f"cancelled before {step.name}")
            if progress:
                progress(step.stage.value, k, len(self.steps))
            bundle = step.apply(bundle) if spark is None else _interruptible(spark, step, bundle, cancelled, poll)
        return bundle


def _interruptible(spark: SparkSession, step: Step, bundle: Bundle, cancelled: Callable[[], bool], poll: float) -> Bundle:
    tag, over, stopped = f"frameflow-{uuid.uuid4().hex}", threading.Event(), threading.Event()

    def watch() -> None:
        while not over.wait(poll):
            if cancelled():
                stopped.set()
                spark.sparkContext.cancelJobsWithTag(tag)  # again and again: a step may start another job meanwhile

    watcher = threading.Thread(target=watch, daemon=True)
    spark.sparkContext.addJobTag(tag)  # the session's own tags are known to their thread only
    watcher.start()
    try:
        done = step.apply(bundle)
    except Exception as e:
        if stopped.is_set():
            raise InterruptedError(f"cancelled during {step.name}") from e
        raise
    finally:
        over.set()
        watcher.join()
        spark.sparkContext.removeJobTag(tag)
    if stopped.is_set():
        raise InterruptedError(f"cancelled during {step.name}")
    return done


@dataclass(frozen=True)
class Config:
    frame_selection_enabled: bool = False
    frame_selection_min_score: float = 0.5
    frame_selection_max_rejected: float = 0.8
    synthetic_flat_enabled: bool = False
    registration_method: str = "star"
    registration_reference: int = 0
    stacking_method: str = "sigma_clip"
    stacking_sigma_low: float = 2.5
    stacking_sigma_high: float = 2.5
    drizzle_enabled: bool = False
    drizzle_drop_size: float = 0.7
    drizzle_scale: float = 1.0
    drizzle_pixfrac: float = 1.0
    drizzle_mode: str = "reference"
    mosaic_enabled: bool = False
    mosaic_blend_mode: str = "average"
    mosaic_gradient_correct: bool = True
    mosaic_output_scale: float = 1.0
    channel_combine_enabled: bool = False
    channel_combine_mode: str = "lrgb"
    channel_combine_palette: str = "SHO"
    comet_stack_enabled: bool = False
    comet_tracking_mode: str = "blend"
    comet_blend_factor: float = 0.5
    background_removal_enabled: bool = False
    background_removal_method: str = "rbf"
    background_removal_tile_size: int = 64
    background_removal_preserve_median: bool = True
    stretch_target_background: float = 0.25
    stretch_shadow_clipping_sigmas: float = -2.8
    stretch_linked_channels: bool = True
    curve_points: tuple[tuple[float, float], ...] = ((0.0, 0.0), (1.0, 1.0))
    color_calibration_enabled: bool = False
    color_calibration_radius: int = 8
    denoise_strength: float = 1.0
    denoise_tile_size: int = 0
    denoise_tile_overlap: int = 0
    adaptive_denoise: bool = False
    deconvolution_enabled: bool = False
    deconvolution_iterations: int = 10
    sharpening_amount: float = 0.0
    sharpening_radius: float = 1.0
    sharpening_threshold: float = 0.0
    saturation_global: float = 1.0
    saturation_hues: tuple[tuple[str, float], ...] = ()
    white_balance: tuple[float, float, float] = (1.0, 1.0, 1.0)
    channel_balance: tuple[float, float, float] = (0.0, 0.0, 0.0)
    channel_balance_auto: bool = False
    neutralise_enabled: bool = False
    neutralise_target: float = 0.1
    asinh_beta: float = 0.0
    asinh_black: float = 0.0
    mtf_midpoint: float = 0.0
    clahe_enabled: bool = False
    clahe_tile: int = 64
    clahe_limit: float = 2.0
    star_reduction_amount: float = 0.0
    star_reduction_radius: int = 2
    star_reduction_threshold: float = 0.5
    grading: tuple[tuple[float, float, float], ...] = ((0.0, 0.0, 0.0),) * 3
    starless_enabled: bool = False


# The built-in parameter sets. Shadow sigmas there are positive and "grid" stands for the RBF model.
PRESETS: dict[str, dict] = {
    "Deepsky LRGB": {
        "stacking_method": "sigma_clip",
        "stacking_sigma_low": 3.0,
        "stacking_sigma_high": 3.0,
        "stretch_target_background": 0.2,
        "stretch_shadow_clipping_sigmas": 1.5,
        "stretch_linked_channels": True,
        "denoise_strength": 0.5,
        "denoise_tile_size": 128,
        "denoise_tile_overlap": 16,
        "background_removal_enabled": True,
        "background_removal_method": "grid",
        "background_removal_tile_size": 64,
        "background_removal_preserve_median": True,
        "drizzle_enabled": False,
        "drizzle_drop_size": 1.0,
        "drizzle_scale": 2.0,
        "drizzle_pixfrac": 1.0,
        "frame_selection_enabled": False,
        "frame_selection_min_score": 0.5,
        "comet_stack_enabled": False,
        "comet_tracking_mode": "stars",
        "synthetic_flat_enabled": False,
        "deconvolution_enabled": False,
        "starless_enabled": False,
    },
    "Narrowband SHO": {
        "stacking_method": "sigma_clip",
        "stacking_sigma_low": 2.5,
        "stacking_sigma_high": 2.5,
        "stretch_target_background": 0.15,
        "stretch_shadow_clipping_sigmas": 2.0,
        "stretch_linked_channels": False,
        "denoise_strength": 0.7,
        "denoise_tile_size": 128,
        "denoise_tile_overlap": 16,
        "background_removal_enabled": True,
        "background_removal_method": "grid",
        "background_removal_tile_size": 64,
        "background_removal_preserve_median": False,
        "drizzle_enabled": False,
        "drizzle_drop_size": 1.0,
        "drizzle_scale": 2.0,
        "drizzle_pixfrac": 1.0,
        "frame_selection_enabled": True,
        "frame_selection_min_score": 0.6,
        "comet_stack_enabled": False,
        "comet_tracking_mode": "stars",
        "synthetic_flat_enabled": False,
        "deconvolution_enabled": True,
        "starless_enabled": False,
    },
    "Narrowband HOO": {
        "stacking_method": "median",
        "stacking_sigma_low": 3.0,
        "stacking_sigma_high": 3.0,
        "stretch_target_background": 0.18,
        "stretch_shadow_clipping_sigmas": 1.5,
        "stretch_linked_channels": False,
        "denoise_strength": 0.6,
        "denoise_tile_size": 128,
        "denoise_tile_overlap": 16,
        "background_removal_enabled": True,
        "background_removal_method": "grid",
        "background_removal_tile_size": 64,
        "background_removal_preserve_median": True,
        "drizzle_enabled": False,
        "drizzle_drop_size": 1.0,
        "drizzle_scale": 2.0,
        "drizzle_pixfrac": 1.0,
        "frame_selection_enabled": True,
        "frame_selection_min_score": 0.55,
        "comet_stack_enabled": False,
        "comet_tracking_mode": "stars",
        "synthetic_flat_enabled": False,
        "deconvolution_enabled": False,
        "starless_enabled": False,
    },
    "Planetarisch": {
        "stacking_method": "mean",
        "stacking_sigma_low": 3.0,
        "stacking_sigma_high": 3.0,
        "stretch_target_background": 0.1,
        "stretch_shadow_clipping_sigmas": 1.0,
        "stretch_linked_channels": True,
        "denoise_strength": 0.3,
        "denoise_tile_size": 64,
        "denoise_tile_overlap": 8,
        "background_removal_enabled": False,
        "background_removal_method": "grid",
        "background_removal_tile_size": 64,
        "background_removal_preserve_median": True,
        "drizzle_enabled": True,
        "drizzle_drop_size": 0.5,
        "drizzle_scale": 2.0,
        "drizzle_pixfrac": 0.5,
        "frame_selection_enabled": True,
        "frame_selection_min_score": 0.7,
        "comet_stack_enabled": False,
        "comet_tracking_mode": "stars",
        "synthetic_flat_enabled": False,
        "deconvolution_enabled": True,
        "starless_enabled": False,
    },
}


def configure(preset: str | None = None, **changes) -> Config:
    """A preset's values with changes; unknown keys warn and are left out."""
    known = {f.name for f in fields(Config)}
    values = dict(PRESETS[preset]) if preset else {}
    values |= changes
    for k in values.keys() - known:
        warnings.warn(f"{k} is no parameter", stacklevel=2)
    return Config(**{k: v for k, v in values.items() if k in known})


def _on_result(name: str, f: Callable[[DataFrame], DataFrame]) -> Step:
    """A step on the result, or on the first frame where there is no result yet."""

    def apply(b: Bundle) -> Bundle:
        px = b.result if b.result is not None else first_frame(b.frames)
        return replace(b, result=f(px)).noting(**{name: True})

    return Step(name, Stage.PROCESSING, apply)


def first_frame(frames: DataFrame) -> DataFrame:
    first = frames.agg(F.min("frame_id").alias("frame_id"))
    return frames_to_pixels(frames.select("frame_id", "h", "w", "c", "data").join(F.broadcast(first), "frame_id", "left_semi"))


def _in_frames(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    return lambda px: frames_to_pixels(f(pixels_to_frames(px)))


def _select(c: Config) -> Step:
    def apply(b: Bundle) -> Bundle:
        from frameflow.operators.tables import select_frames

        if "score" not in b.frames.columns:
            return b
        kept = select_frames(b.frames.select("frame_id", "score", F.col("frame_id").alias("idx")), c.frame_selection_min_score, c.frame_selection_max_rejected).where("kept")
        return replace(b, frames=b.frames.join(kept.select("frame_id"), "frame_id", "left_semi")).noting(frame_selection=c.frame_selection_min_score)

    return Step("frame selection", Stage.CALIBRATION, apply)


def _flat(c: Config) -> Step:
    def apply(b: Bundle) -> Bundle:
        l1 = b.frames.select("frame_id", "h", "w", "c", "data")
        flat = frames_to_pixels(K.synthetic_flat(K.background_model(l1, tile=c.background_removal_tile_size))).select("ch", "y", "x", F.col("v").alias("f"))
        done = P.apply_flat(frames_to_pixels(l1), flat, P.PLACE, normalise=False)
        return replace(b, frames=pixels_to_frames(done)).noting(synthetic_flat_applied=True)

    return Step("synthetic flat", Stage.CALIBRATION, apply)


def _register(c: Config) -> Step:
    def apply(b: Bundle) -> Bundle:
        l1 = b.frames.select("frame_id", "h", "w", "c", "data")
        heads = [r[0] for r in l1.select("frame_id").orderBy("frame_id").limit(c.registration_reference + 1).collect()]
        if len(heads) < 1:
            return b
        ref = l1.where(F.col("frame_id") == heads[-1]).first()
        plane = np.asarray(ref["data"], float).reshape(ref["h"], ref["w"], ref["c"]).mean(2)
        done = K.register(l1, plane, c.registration_method)
        return replace(b, frames=done.where("accepted").drop("confidence", "accepted")).noting(registration_method=c.registration_method, registration_reference=heads[-1])

    return Step("registration", Stage.REGISTRATION, apply)


def _stack(c: Config) -> Step:
    def apply(b: Bundle) -> Bundle:
        if b.frames.select("h", "w", "c").distinct().limit(2).count() > 1:  # sizes alone are read
            raise ValueError("frames of a stack must have the same shape")
        px = frames_to_pixels(b.frames.select("frame_id", "h", "w", "c", "data"))
        one = P.stack(px, c.stacking_method, (), c.stacking_sigma_low, c.stacking_sigma_high)
        return replace(b, result=one.select(F.lit(0).cast("bigint").alias("frame_id"), *P.PLACE, "v")).noting(stacking_method=c.stacking_method)

    return Step("stacking", Stage.STACKING, apply)


def load_frames(spark: SparkSession, paths: list[str]) -> Step:
    """Read image files as the bundle's frames, in the order of their ids; no paths leave the bundle as it is."""

    def apply(b: Bundle) -> Bundle:
        from frameflow.sources.images import read_frames

        if not paths:
            return b
        return replace(b, frames=read_frames(spark, list(paths), strict=True)).noting(loaded_frame_paths=list(paths))

    return Step("load frames", Stage.CALIBRATION, apply)


def export_result(spark: SparkSession, kind: str, folder: str, starless: bool = False, mask: bool = False) -> Step:
    """Write the result, or the first frame without one, and on request the starless image and the mask: an action."""

    def apply(b: Bundle) -> Bundle:
        from frameflow.sources.images import export

        if b.result is None and b.frames is None:
            raise ValueError("there is no image to export")
        image = lambda px: None if px is None else pixels_to_frames(px)
        result = b.result if b.result is not None else first_frame(b.frames)
        export(spark, kind, folder, image(result), image(b.starless) if starless else None, image(b.mask) if mask else None)
        return b.noting(export_path=folder)

    return Step(f"export {kind}", Stage.SAVING, apply)


def _solutions(b: Bundle) -> dict | None:
    """Plate solutions by frame id (or one for all, under None), from ``meta['wcs']``."""
    found = b.meta.get("wcs")
    return found if found is None or isinstance(found, dict) else {None: found}


def _drizzle(c: Config) -> Step:
    """All frames onto a grid of ``drizzle_scale`` times the first one's size; without solutions places stay as they are."""

    def apply(b: Bundle) -> Bundle:
        from frameflow.operators import geometry as G

        l1 = b.frames.select("frame_id", "h", "w", "c", "data")
        size = l1.orderBy("frame_id").select("h", "w").first()
        if size is None:
            return b
        px, found = frames_to_pixels(l1), _solutions(b)
        x, y = F.col("x").cast("double"), F.col("y").cast("double")
        if found and None not in found:
            ref = found[min(found)]
            rows = px.sparkSession.createDataFrame([(k, *map(float, w.cd), *map(float, w.crpix)) for k, w in found.items()], "frame_id bigint, m0 double, m1 double, m2 double, m3 double, p0 double, p1 double")
            px = px.join(rows, "frame_id")
            x, y = G.affine(px, G.cd_affine([F.col(f"m{k}") for k in range(4)], [F.col("p0"), F.col("p1")], ref.cd, ref.crpix))
        done = G.drizzle(px, x, y, int(size["h"] * c.drizzle_scale), int(size["w"] * c.drizzle_scale), c.drizzle_drop_size, c.drizzle_pixfrac, c.drizzle_scale, c.drizzle_mode)
        filled = _filled(done, int(size["h"] * c.drizzle_scale), int(size["w"] * c.drizzle_scale))
        return replace(b, result=filled).noting(drizzle_scale=c.drizzle_scale)

    return Step("drizzle", Stage.DRIZZLE, apply)


def _filled(cells: DataFrame, height: int, width: int) -> DataFrame:
    """Every place of the grid, 0 where nothing fell."""
    channels = cells.select("ch").distinct()
    grid = channels.select("ch", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y")).select("*", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))
    at = cells.select("ch", F.col("oy").cast("int").alias("y"), F.col("ox").cast("int").alias("x"), "v")
    return grid.join(at, ["ch", "y", "x"], "left").select(F.lit(0).cast("bigint").alias("frame_id"), *P.PLACE, F.coalesce("v", F.lit(0.0)).alias("v"))


def _mosaic(c: Config) -> Step:
    """The frames as panels, by their plate solutions; without those the bundle stays as it is."""

    def apply(b: Bundle) -> Bundle:
        from frameflow.operators.mosaic import solutions, stitch

        found = _solutions(b)
        if not found or None in found:
            return b
        l1 = b.frames.select("frame_id", "h", "w", "c", "data")
        known = solutions(l1.sparkSession, found).drop("width", "height", "channels")
        panels = l1.select("frame_id", F.col("w").alias("width"), F.col("h").alias("height"), F.col("c").alias("channels")).join(known, "frame_id")
        result, target = stitch(frames_to_pixels(l1), panels, c.mosaic_output_scale, c.mosaic_blend_mode, c.mosaic_gradient_correct)
        cells = result.select("ch", F.col("y").alias("oy"), F.col("x").alias("ox"), "v")
        return replace(b, result=_filled(cells, target.height, target.width)).noting(mosaic_wcs=target, mosaic_panels=len(found))

    return Step("mosaic", Stage.MOSAIC, apply)


def _combine(c: Config) -> Step:
    """Mono images by band in ``meta['channels']`` (l, r, g, b, or h, o, s) to colour; none leave the bundle as it is."""

    def apply(b: Bundle) -> Bundle:
        bands = {k.lower()[0]: px for k, px in b.meta.get("channels", {}).items() if px is not None}
        if not bands:
            return b
        every = None
        for k, px in bands.items():
            one = px.select("y", "x", "v", F.lit(k).alias("band"))
            every = one if every is None else every.unionByName(one)
        names = "lrgb" if c.channel_combine_mode == "lrgb" else "hosn"
        planes = every.groupBy("y", "x").agg(*[F.max(F.when(F.col("band") == k, F.col("v"))).alias(k) for k in names]).withColumn("frame_id", F.lit(0).cast("bigint"))
        rgb = P.lrgb_combine(planes) if names == "lrgb" else P.narrowband(planes, c.channel_combine_palette.upper())
        long = rgb.select("frame_id", "y", "x", F.posexplode(F.array("r", "g", "b")).alias("ch", "v"))
        return replace(b, result=long.select("frame_id", *P.PLACE, "v")).noting(channel_combine=c.channel_combine_mode)

    return Step("channel combine", Stage.PROCESSING, apply)


def _color_calibrate(c: Config) -> Step:
    """Scale red and blue by the fit of the stars in ``meta['color_stars']`` (star_id, sy, sx, rg, bg: the catalog's flux
    ratios) to their colours here; without stars, or on a mono image, the result stays as it is."""

    def apply(b: Bundle) -> Bundle:
        from frameflow.operators import geometry as G

        stars = b.meta.get("color_stars")
        px = b.result if b.result is not None else first_frame(b.frames)
        if stars is None or px.agg(F.max("ch")).first()[0] != 2:
            return b
        keyed = stars.withColumn("frame_id", F.lit(0).cast("bigint"))
        seen = G.color_aperture_flux(px.withColumn("frame_id", F.lit(0).cast("bigint")), keyed, c.color_calibration_radius).join(keyed.select("star_id", "rg", "bg"), "star_id")
        fit = G.color_fit(seen.select((F.col("rg") * F.col("g") / F.col("r")).alias("rr"), (F.col("bg") * F.col("g") / F.col("b")).alias("rb"))).first()
        done = P.per_channel(px, (fit["scale_r"], 1.0, fit["scale_b"]), clip=False)
        return replace(b, result=done).noting(color_scales=(fit["scale_r"], fit["scale_b"]), color_stars_used=fit["inliers"])

    return Step("color calibration", Stage.PROCESSING, apply)


def _denoise(c: Config) -> Callable[[DataFrame], DataFrame]:
    """In tiles where a size is set, else whole planes."""
    if not c.denoise_tile_size:
        return _in_frames(lambda f: K.map_planes(f, "denoise", strength=c.denoise_strength))
    sizes = lambda px: px.groupBy("frame_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    return lambda px: K.map_tiles(px, sizes(px), "denoise", c.denoise_tile_size, c.denoise_tile_overlap, strength=c.denoise_strength)


def _comet(c: Config) -> Step:
    def apply(b: Bundle) -> Bundle:
        l1 = b.frames.select("frame_id", "h", "w", "c", "data")
        size = l1.select("h", "w").first()
        if size is None:
            return b
        middle = frames_to_pixels(l1).groupBy("y", "x").agg(F.median("v").alias("v")).toPandas()  # one frame's pixels, whatever the number of frames
        ref = np.zeros((size["h"], size["w"]))
        ref[middle["y"], middle["x"]] = middle["v"]
        at = K.track_comet(l1, ref)
        mid = at.agg(F.median("y"), F.median("x")).first()
        stars = b.result if b.result is not None else _stack(c).apply(b).result
        moved = frames_to_pixels(K.shift_to(l1, at, mid[0], mid[1]))
        comet = P.stack(moved, c.stacking_method, (), c.stacking_sigma_low, c.stacking_sigma_high).select(F.lit(0).cast("bigint").alias("frame_id"), *P.PLACE, "v")
        out = {"stars": stars, "comet": comet}.get(c.comet_tracking_mode)
        out = P.blend(stars, comet, c.comet_blend_factor, ("frame_id", *P.PLACE)) if out is None else out
        return replace(b, result=out).noting(comet_tracking_mode=c.comet_tracking_mode)

    return Step("comet stack", Stage.COMET_STACKING, apply)


def photometry_step(catalog: DataFrame, **options) -> Step:
    """Star magnitudes of the first frame, by its plate solution in ``meta['wcs']`` and a catalog (name, ra, dec, mag):
    ``meta['photometry']`` has the star rows, ``meta['photometry_fit']`` one row of the fit. Without a solution nothing is
    done."""

    def apply(b: Bundle) -> Bundle:
        from frameflow.operators.photometry import photometry

        found = _solutions(b)
        if not found or b.frames is None and b.result is None:
            return b
        frame = pixels_to_frames(b.result) if b.result is not None else b.frames.select("frame_id", "h", "w", "c", "data")
        stars, fit = photometry(frame, found[None] if None in found else found[min(found)], catalog, **options)
        return b.noting(photometry=stars, photometry_fit=fit)

    return Step("photometry", Stage.PHOTOMETRY, apply)


def _background(c: Config) -> Callable[[DataFrame], DataFrame]:
    method = "polynomial" if c.background_removal_method == "polynomial" else "rbf"
    if c.background_removal_method not in ("polynomial", "rbf"):
        warnings.warn(f"background method {c.background_removal_method!r} is taken as 'rbf'", stacklevel=3)

    def f(px: DataFrame) -> DataFrame:
        model = frames_to_pixels(K.background_model(pixels_to_frames(px), method, c.background_removal_tile_size)).select("frame_id", *P.PLACE, F.col("v").alias("bg"))
        return P.gradient_remove(px, model, c.background_removal_preserve_median)

    return f


def _adaptive(px: DataFrame) -> DataFrame:
    level = P.noise_estimate(px).select("frame_id", "strength")
    soft = frames_to_pixels(K.map_planes(pixels_to_frames(px), "denoise")).select("frame_id", *P.PLACE, F.col("v").alias("__d"))
    return px.join(soft, ["frame_id", *P.PLACE]).join(level, "frame_id").withColumn("v", F.col("v") + F.col("strength") * (F.col("__d") - F.col("v"))).drop("__d", "strength")


def _starless(c: Config) -> Step:
    def apply(b: Bundle) -> Bundle:
        px = b.result if b.result is not None else first_frame(b.frames)
        done = K.remove_stars(pixels_to_frames(px))
        mask = done.select("frame_id", "h", "w", F.lit(1).alias("c"), F.col("mask").alias("data"))
        return replace(b, starless=frames_to_pixels(done.drop("mask")), mask=frames_to_pixels(mask))

    return Step("star removal", Stage.PROCESSING, apply)


def build(c: Config) -> Pipeline:
    """The enabled steps in their fixed order; identities are left out."""
    p = Pipeline()
    if c.frame_selection_enabled:
        p.add(_select(c))
    if c.synthetic_flat_enabled:
        p.add(_flat(c))
    p.add(_register(c)).add(_stack(c))
    if c.drizzle_enabled:
        p.add(_drizzle(c))
    if c.mosaic_enabled:
        p.add(_mosaic(c))
    if c.channel_combine_enabled:
        p.add(_combine(c))
    if c.comet_stack_enabled:
        p.add(_comet(c))
    if c.background_removal_enabled:
        p.add(_on_result("background removal", _background(c)))
    p.add(_on_result("stretch", lambda px: P.stf_stretch(px, c.stretch_target_background, c.stretch_shadow_clipping_sigmas, c.stretch_linked_channels)))
    if any(x != y for x, y in c.curve_points):
        p.add(_on_result("curves", lambda px: px.withColumn("v", C.tone_curve(F.col("v"), list(c.curve_points)))))
    if c.color_calibration_enabled:
        p.add(_color_calibrate(c))
    if c.adaptive_denoise:
        p.add(_on_result("adaptive denoise", _adaptive))
    elif c.denoise_strength > 0:
        p.add(_on_result("denoise", _denoise(c)))
    if c.deconvolution_enabled:
        p.add(_on_result("deconvolution", _in_frames(lambda f: K.map_planes(f, "deconvolve", rounds=c.deconvolution_iterations))))
    if c.sharpening_amount > 0:
        p.add(_on_result("sharpening", lambda px: S.unsharp(px, c.sharpening_radius, c.sharpening_amount, c.sharpening_threshold)))
    if c.saturation_global != 1.0 or any(f != 1.0 for _, f in c.saturation_hues):
        p.add(_on_result("saturation", lambda px: P.saturation(px, dict(c.saturation_hues), c.saturation_global)))
    if any(abs(f - 1) > 1e-4 for f in c.white_balance):
        p.add(_on_result("white balance", lambda px: P.per_channel(px, c.white_balance)))
    if c.channel_balance_auto:
        p.add(_on_result("channel balance", P.auto_balance))
    elif any(c.channel_balance):
        p.add(_on_result("channel balance", lambda px: P.per_channel(px, c.channel_balance, "add")))
    if c.neutralise_enabled:
        p.add(_on_result("background neutralisation", lambda px: P.neutralise(px, c.neutralise_target)))
    if c.asinh_beta > 0:
        p.add(_on_result("asinh", lambda px: px.withColumn("v", C.asinh_stretch(F.col("v"), c.asinh_beta, c.asinh_black))))
    if c.mtf_midpoint > 0:
        p.add(_on_result("mtf", lambda px: px.withColumn("v", C.mtf_apply(F.col("v"), c.mtf_midpoint))))
    if c.clahe_enabled:
        p.add(_on_result("clahe", lambda px: P.clahe(px, c.clahe_tile, limit=c.clahe_limit)))
    if c.star_reduction_amount > 0:
        p.add(_on_result("star reduction", lambda px: S.star_shrink(px, c.star_reduction_radius, c.star_reduction_threshold, c.star_reduction_amount)))
    if any(v for t in c.grading for v in t):
        p.add(_on_result("color grading", lambda px: P.color_grade(px, *c.grading)))
    if c.starless_enabled:
        p.add(_starless(c))
    return p


def presets_table(spark) -> DataFrame:
    """Built-in presets as rows (name, config map)."""
    return spark.createDataFrame([(n, {k: str(v) for k, v in asdict(configure(n)).items()}) for n in PRESETS], "name string, config map<string,string>")
