"""Operators over the pixels of frames (L2): calibration, stacking, statistics, stretches and colour. No Python UDFs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameflow.functions import curves as C

PLACE = ("ch", "y", "x")
FRAME = ("frame_id",)


# -- calibration

def apply_dark(light: DataFrame, dark: DataFrame, on: tuple[str, ...] = ("y", "x")) -> DataFrame:
    """max(v - d, 0). ``dark`` has d; masters are a frame's size, so Spark broadcasts them under its own threshold."""
    return light.join(dark, list(on)).withColumn("v", F.greatest(F.col("v") - F.col("d"), F.lit(0.0))).drop("d")


def normalised_flat(flat: DataFrame) -> DataFrame:
    """f over its median, both at least 1e-7."""
    middle = flat.agg(F.greatest(F.median("f"), F.lit(1e-7)).alias("__m"))
    return flat.crossJoin(F.broadcast(middle)).withColumn("f", F.greatest(F.col("f") / F.col("__m"), F.lit(1e-7))).drop("__m")


def apply_flat(light: DataFrame, flat: DataFrame, on: tuple[str, ...] = ("y", "x"), normalise: bool = True) -> DataFrame:
    return light.join(normalised_flat(flat) if normalise else flat.withColumn("f", F.greatest("f", F.lit(1e-7))), list(on)).withColumn("v", F.col("v") / F.col("f")).drop("f")


# -- stacking

def check_shapes(pixels: DataFrame, by: tuple[str, ...]) -> None:
    """Raise if a group's frames differ in size; one row a group comes to the driver only if one does."""
    sizes = pixels.groupBy(*by, "frame_id").agg(F.max("y").alias("h"), F.max("x").alias("w"), F.max("ch").alias("c"))
    if sizes.groupBy(*by).agg(F.count_distinct("h", "w", "c").alias("n")).where("n > 1").limit(1).count():
        raise ValueError("frames of a stack must have the same shape")


def stack(pixels: DataFrame, method: str = "sigma_clip", by: tuple[str, ...] = ("target",), low: float = 2.5, high: float = 2.5, rounds: int = 5) -> DataFrame:
    """Per group and place: v by 'mean', 'median' or 'sigma_clip', and n, the values that it rests on."""
    key = [*by, *PLACE]
    if method == "mean":
        return pixels.groupBy(*key).agg(F.avg("v").alias("v"), F.count("v").alias("n"))
    if method == "median":
        return pixels.groupBy(*key).agg(F.median("v").alias("v"), F.count("v").alias("n"))
    if method != "sigma_clip":
        raise ValueError(f"no stacking method {method!r}")
    return clip_rounds(pixels, key, low, high, rounds).groupBy(*key).agg(F.avg("v").alias("v"), F.count("v").alias("n"))


def clip_rounds(pixels: DataFrame, key: list[str], low: float, high: float, rounds: int) -> DataFrame:
    """Rows that survive ``rounds`` of rejection outside mean - low sd .. mean + high sd. All rounds share one exchange.

    Equal values whose mean differs from them in the last digit stay: the bounds are wider by 1e-12 of it."""
    w = Window.partitionBy(*key)
    for _ in range(rounds):
        kept = pixels.withColumns({"__m": F.avg("v").over(w), "__s": F.stddev_pop("v").over(w)})
        slack = (F.abs("__m") + 1) * 1e-12
        pixels = kept.where((F.col("v") >= F.col("__m") - low * F.col("__s") - slack) & (F.col("v") <= F.col("__m") + high * F.col("__s") + slack)).drop("__m", "__s")
    return pixels


def blend(a: DataFrame, b: DataFrame, factor: float, on: tuple[str, ...] = PLACE) -> DataFrame:
    """(1 - f) a + f b, f held to [0, 1]."""
    f = min(max(factor, 0.0), 1.0)
    return a.join(b.withColumnRenamed("v", "__b"), list(on)).withColumn("v", F.col("v") * (1 - f) + F.col("__b") * f).drop("__b")


def weighted_stack(pixels: DataFrame, by: tuple[str, ...], weight: Column) -> DataFrame:
    """Sum of v * w over the sum of w, where that is positive."""
    return pixels.withColumn("__w", weight).groupBy(*by).agg((F.sum(F.col("v") * F.col("__w")) / F.sum("__w")).alias("v"), F.sum("__w").alias("w")).where("w > 0")


def overlap_medians(pixels: DataFrame, least: int = 10) -> DataFrame:
    """Per pair of panels (frame_id) with enough common pixels: their number and the difference of their medians."""
    a, b = pixels.selectExpr("frame_id as a", "y", "x", "v as va"), pixels.selectExpr("frame_id as b", "y", "x", "v as vb")
    return a.join(b, ["y", "x"]).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), (F.median("va") - F.median("vb")).alias("offset")).where(F.col("n") >= least)


# -- statistics

def image_stats(pixels: DataFrame, by: tuple[str, ...] = ("frame_id", "ch")) -> DataFrame:
    sd = F.stddev_pop("v")
    return pixels.groupBy(*by).agg(F.avg("v").alias("mean"), F.median("v").alias("median"), sd.alias("std"), F.when(sd >= 1e-8, F.avg("v") / sd).alias("snr"), F.min("v").alias("min"), F.max("v").alias("max"))


def histogram(pixels: DataFrame, bins: int = 256, by: tuple[str, ...] = ("ch",)) -> DataFrame:
    """Counts in equal bins over [min, max], the last one closed; every bin has a row. Flat groups count nothing."""
    ends = pixels.groupBy(*by).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    rows = pixels.join(ends, list(by)).where("hi > lo")
    counts = rows.groupBy(*by, F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = ends.select(*by, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(counts, [*by, "bin"], "left").select(*by, "bin", F.coalesce("n", F.lit(0)).alias("n"))


def median_mad(pixels: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Median and 1.4826 times the median absolute deviation."""
    w = pixels.groupBy(*by).agg(F.median("v").alias("med"))
    return pixels.join(w, list(by)).groupBy(*by, "med").agg((F.median(F.abs(F.col("v") - F.col("med"))) * 1.4826).alias("sigma"))


def background(pixels: DataFrame, share: float, by: tuple[str, ...]) -> DataFrame:
    """Median of the values up to the given percentile."""
    cut = pixels.groupBy(*by).agg(F.percentile("v", share).alias("cut"))
    return pixels.join(cut, list(by)).where("v <= cut").groupBy(*by).agg(F.median("v").alias("bg"))


def mtf_background(pixels: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Median of the values below the median; the median where there are none."""
    med = pixels.groupBy(*by).agg(F.median("v").alias("med"))
    return pixels.join(med, list(by)).groupBy(*by, "med").agg(F.median(F.when(F.col("v") < F.col("med"), F.col("v"))).alias("low")).select(*by, F.coalesce("low", "med").alias("bg"))


def noise_estimate(pixels: DataFrame, by: tuple[str, ...] = FRAME, kappa: float = 3.0, rounds: int = 5) -> DataFrame:
    """Sky sigma by clipping at kappa scaled MADs, signal to noise in dB, level in percent and a denoising strength.

    A round that would leave fewer than 10 pixels, or with no spread, changes nothing."""
    w = Window.partitionBy(*by)
    left = pixels.withColumn("__mean", F.avg("v").over(w))
    for _ in range(rounds):
        left = left.withColumn("__med", F.median("v").over(w))
        left = left.withColumn("__mad", F.median(F.abs(F.col("v") - F.col("__med"))).over(w) * 1.4826)
        near = F.abs(F.col("v") - F.col("__med")) <= F.col("__mad") * kappa
        left = left.withColumn("__n", F.count_if(near).over(w)).where((F.col("__mad") <= 0) | (F.col("__n") < 10) | near)
    s = left.groupBy(*by).agg(F.stddev_pop("v").alias("sky_sigma"), F.first("__mean").alias("mean"))
    sigma = F.col("sky_sigma")
    return s.select(*by, "sky_sigma", F.when(sigma > 1e-12, F.log10(F.greatest("mean", F.lit(1e-12)) / sigma) * 20).alias("snr_db"), (C.clip(sigma / 0.05) * 100).alias("noise_level_pct"), C.denoise_strength(sigma).alias("strength"))


def top_fraction_mask(pixels: DataFrame, share: float = 0.002, by: tuple[str, ...] = FRAME) -> DataFrame:
    """Pixels at or above the n-th largest value of their frame, n = max(1, int(share * count))."""
    w = Window.partitionBy(*by)
    nth = F.row_number().over(w.orderBy(F.desc("v")))
    n = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(w) * share))
    return pixels.withColumns({"__nth": nth, "__n": n}).withColumn("__cut", F.max(F.when(F.col("__nth") == F.col("__n"), F.col("v"))).over(w)).where("v >= __cut").drop("__nth", "__n", "__cut")


def threshold_mask(pixels: DataFrame, k: float, by: tuple[str, ...] = FRAME) -> DataFrame:
    """Pixels over mean + k sd; none where the frame has no spread."""
    w = Window.partitionBy(*by)
    return pixels.withColumns({"__m": F.avg("v").over(w), "__s": F.stddev_pop("v").over(w)}).where((F.col("__s") >= 1e-8) & (F.col("v") > F.col("__m") + k * F.col("__s"))).drop("__m", "__s")


# -- stretches and point operators

def normalise(pixels: DataFrame, by: tuple[str, ...] = FRAME) -> DataFrame:
    """To [0, 1] by the group's extremes; a flat group is all zeros."""
    w = Window.partitionBy(*by)
    lo, hi = F.min("v").over(w), F.max("v").over(w)
    return pixels.withColumns({"__lo": lo, "__hi": hi}).withColumn("v", F.when(F.col("__hi") - F.col("__lo") < 1e-10, 0.0).otherwise((F.col("v") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")))).drop("__lo", "__hi")


def stf_stretch(pixels: DataFrame, target: float = 0.25, sigmas: float = -2.8, linked: bool = True) -> DataFrame:
    """Screen transfer: normalise, clip shadows at median + sigmas * sigma, then a midtones transfer.

    ``linked`` takes the statistics of the mean over channels, else each channel has its own and is normalised alone."""
    one = normalise(pixels, FRAME if linked else ("frame_id", "ch"))
    by = FRAME if linked else ("frame_id", "ch")
    basis = one.groupBy("frame_id", "y", "x").agg(F.avg("v").alias("v")) if linked else one
    s = median_mad(basis, by).withColumn("sc", F.greatest(F.col("med") + sigmas * F.col("sigma"), F.lit(0.0)))
    s = s.withColumn("bg", C.clip((F.col("med") - F.col("sc")) / F.greatest(1 - F.col("sc"), F.lit(1e-10)), 1e-6, 1 - 1e-6))
    balance = C.clip(target * (F.col("bg") - 1) / ((2 * target - 1) * F.col("bg") - target), 0.01, 0.99)
    s = s.withColumn("m", F.when(F.col("bg") >= target, 0.5).otherwise(balance)).select(*by, "sc", "m")
    return one.join(s, list(by)).withColumn("v", C.mtf(C.clip((F.col("v") - F.col("sc")) / F.greatest(1 - F.col("sc"), F.lit(1e-10))), F.col("m"))).drop("sc", "m")


def gradient_remove(pixels: DataFrame, model: DataFrame, keep_median: bool = True) -> DataFrame:
    """max(v - bg + the frame's median over all channels, 0); ``model`` has bg by frame and place."""
    w = Window.partitionBy("frame_id")
    lift = F.median("v").over(w) if keep_median else F.lit(0.0)
    return pixels.withColumn("__lift", lift).join(model, ["frame_id", *PLACE]).withColumn("v", F.greatest(F.col("v") - F.col("bg") + F.col("__lift"), F.lit(0.0))).drop("bg", "__lift")


def per_channel(pixels: DataFrame, values: tuple[float, float, float], how: str = "multiply", clip: bool = True) -> DataFrame:
    """White balance ('multiply') or channel balance ('add'), clipped to [0, 1]; a colour correction isn't clipped."""
    k = F.element_at(F.array(*map(F.lit, values)), F.col("ch") + 1)
    v = F.col("v") * k if how == "multiply" else F.col("v") + k
    return pixels.withColumn("v", C.clip(v) if clip else v)


def neutralise(pixels: DataFrame, target: float = 0.1, share: float = 0.02) -> DataFrame:
    """Move each channel's background to ``target``, clipped."""
    bg = background(pixels, share, ("frame_id", "ch"))
    return pixels.join(bg, ["frame_id", "ch"]).withColumn("v", C.clip(F.col("v") + target - F.col("bg"))).drop("bg")


def auto_balance(pixels: DataFrame, share: float = 0.05) -> DataFrame:
    """Add to each channel what its background lacks to the lowest one's (a single channel loses its own), clipped."""
    bg = background(pixels, share, ("frame_id", "ch"))
    w = Window.partitionBy("frame_id")
    add = bg.select("frame_id", "ch", F.when(F.count(F.lit(1)).over(w) > 1, F.min("bg").over(w) - F.col("bg")).otherwise(-F.col("bg")).alias("add"))
    return pixels.join(add, ["frame_id", "ch"]).withColumn("v", C.clip(F.col("v") + F.col("add"))).drop("add")


def wide(pixels: DataFrame) -> DataFrame:
    """Columns r, g, b by frame and place; a missing channel is null."""
    return pixels.groupBy("frame_id", "y", "x").agg(*[F.max(F.when(F.col("ch") == k, F.col("v"))).alias(n) for k, n in enumerate("rgb")])


def long(rgb: DataFrame) -> DataFrame:
    """The inverse of ``wide``."""
    return rgb.select("frame_id", "y", "x", F.posexplode(F.array("r", "g", "b")).alias("ch", "v"))


def saturation(pixels: DataFrame, factors: dict[str, float], overall: float = 1.0) -> DataFrame:
    """``pixels`` unchanged where all factors are 1."""
    if overall == 1.0 and all(f == 1.0 for f in factors.values()):
        return pixels
    r, g, b = C.saturate(F.col("r"), F.col("g"), F.col("b"), factors, overall)
    return long(wide(pixels).select("frame_id", "y", "x", r.alias("r"), g.alias("g"), b.alias("b")))


def color_grade(pixels: DataFrame, shadow: tuple, midtone: tuple, highlight: tuple) -> DataFrame:
    """Add shifts to shadows, midtones and highlights by luminance masks; the midtone mask is scaled to the frame's top."""
    rgb = wide(pixels).withColumn("l", C.grey(F.col("r"), F.col("g"), F.col("b"), "video"))
    raw = F.col("l") * 4 * F.pow(1 - F.col("l"), F.lit(1.5))
    top = F.max(raw).over(Window.partitionBy("frame_id"))
    rgb = rgb.withColumn("__top", top).withColumn("__mid", F.when(F.col("__top") > 0, raw / F.col("__top")).otherwise(raw))
    out = [C.clip(F.col(n) + F.pow(1 - F.col("l"), F.lit(2.0)) * shadow[k] + F.col("__mid") * midtone[k] + F.pow("l", F.lit(2.0)) * highlight[k]).alias(n) for k, n in enumerate("rgb")]
    return long(rgb.select("frame_id", "y", "x", *out))


def lrgb_combine(planes: DataFrame) -> DataFrame:
    """From columns l, r, g, b by frame and place: rgb scaled to the luminance l; without l the rgb as it is."""
    clipped = {n: C.clip(F.coalesce(F.col(n), F.lit(0.0))) for n in "rgb"}
    p = planes.withColumns(clipped)
    scale = F.when(F.col("l").isNotNull(), C.clip(F.col("l")) / (C.grey(F.col("r"), F.col("g"), F.col("b"), "noise") + 2.220446049250313e-16)).otherwise(1.0)
    return p.withColumn("__k", scale).select("frame_id", "y", "x", *[C.clip(F.col(n) * F.col("__k")).alias(n) for n in "rgb"])


# Which narrow band goes to red, green and blue.
BANDS = {"SHO": ("s", "h", "o"), "HOO": ("h", "o", "o"), "NHO": ("n", "h", "o")}


def narrowband(planes: DataFrame, mode: str = "SHO") -> DataFrame:
    return planes.select("frame_id", "y", "x", *[C.clip(F.coalesce(F.col(b), F.lit(0.0))).alias(n) for n, b in zip("rgb", BANDS[mode], strict=True)])


def preview_stretch(pixels: DataFrame, by: tuple[str, ...] = FRAME) -> DataFrame:
    """Between the percentiles 0.5 and 99.5; unchanged where they don't differ."""
    ends = pixels.groupBy(*by).agg(F.percentile("v", F.array(F.lit(0.005), F.lit(0.995))).alias("p"))
    lo, hi = F.col("p")[0], F.col("p")[1]
    return pixels.join(ends, list(by)).withColumn("v", F.when(hi > lo, C.clip((F.col("v") - lo) / (hi - lo))).otherwise(F.col("v"))).drop("p")


def thumbnail(pixels: DataFrame, side: int, height: int, width: int) -> DataFrame:
    """Nearest rows and columns, evenly spread, for a longer side of at most ``side``. A filter before all else."""
    scale = min(1.0, side / max(height, width))
    pick = lambda n: {(int(k * (n - 1) / max(1, max(1, int(n * scale)) - 1))): k for k in range(max(1, int(n * scale)))}
    out = pixels
    for c, n in (("y", height), ("x", width)):
        places = F.create_map(*[F.lit(v) for kv in pick(n).items() for v in kv])
        out = out.withColumn(c, F.element_at(places, F.col(c))).where(F.col(c).isNotNull())
    return out


def quantise(pixels: DataFrame) -> DataFrame:
    return pixels.withColumn("v", F.floor(C.clip(F.col("v")) * 255).cast("int"))


def diff_image(a: DataFrame, b: DataFrame, gain: float = 3.0) -> DataFrame:
    return a.join(b.withColumnRenamed("v", "__b"), ["frame_id", *PLACE]).withColumn("v", C.clip(F.abs(F.col("v") - F.col("__b")) * gain)).drop("__b")


def star_mask(a: DataFrame, b: DataFrame) -> DataFrame:
    """1 where the mean difference over channels exceeds its mean by two standard deviations, else 0."""
    d = a.join(b.withColumnRenamed("v", "__b"), ["frame_id", *PLACE]).groupBy("frame_id", "y", "x").agg(F.avg(F.abs(F.col("v") - F.col("__b"))).alias("d"))
    w = Window.partitionBy("frame_id")
    return d.withColumns({"__m": F.avg("d").over(w), "__s": F.stddev_pop("d").over(w)}).select("frame_id", "y", "x", (F.col("d") > F.col("__m") + 2 * F.col("__s")).cast("double").alias("v"))


def star_reduce(starless: DataFrame, stars: DataFrame, factor: float) -> DataFrame:
    return starless.join(stars.withColumnRenamed("v", "__s"), ["frame_id", *PLACE]).withColumn("v", F.greatest(F.col("v") + factor * F.col("__s"), F.lit(0.0))).drop("__s")


# -- tiles

def tile_values(pixels: DataFrame, tile: int = 64, share: float = 0.8, sigma: float = 2.5) -> DataFrame:
    """Per tile a robust value: up to the percentile, clipped once at ``sigma``, then the median; null below 4 pixels."""
    key = ["frame_id", "ch", "ty", "tx"]
    t = pixels.withColumns({"ty": F.expr(f"y div {tile}"), "tx": F.expr(f"x div {tile}")})
    w = Window.partitionBy(*key)
    low = t.withColumn("__cut", F.percentile("v", share).over(w)).where("v <= __cut").withColumns({"__m": F.avg("v").over(w), "__s": F.stddev_pop("v").over(w), "__n": F.count(F.lit(1)).over(w)})
    near = F.abs(F.col("v") - F.col("__m")) <= sigma * F.col("__s")
    s = low.groupBy(*key).agg(F.first("__n").alias("n"), F.first("__m").alias("m"), F.first("__s").alias("s"), F.count_if(near).alias("k"), F.median(F.when(near, F.col("v"))).alias("med"))
    return s.select(*key, F.when(F.col("n") < 4, None).when((F.col("s") < 1e-10) | (F.col("k") < 2), F.col("m")).otherwise(F.col("med")).alias("v"))


def cloud_score(pixels: DataFrame, block: int = 64, ratio: float = 1.3, spread: float = 15.0, small_ratio: float = 1.2, small_spread: float = 20.0) -> DataFrame:
    """1 minus the share of whole blocks that are bright and even; a small frame is 0 or 1 by its own statistics."""
    w = Window.partitionBy("frame_id")
    p = pixels.withColumns({"h": F.max("y").over(w) + 1, "w": F.max("x").over(w) + 1, "med": F.median("v").over(w), "mean": F.avg("v").over(w), "sd": F.stddev_pop("v").over(w)})
    whole = p.where(f"y < (h div {block}) * {block} and x < (w div {block}) * {block}").groupBy("frame_id", F.expr(f"y div {block}").alias("by"), F.expr(f"x div {block}").alias("bx")).agg(F.first("med").alias("med"), F.stddev_pop("v").alias("s"), F.median("v").alias("m"))
    blocks = whole.groupBy("frame_id").agg(F.avg(((F.col("m") > F.col("med") * ratio) & (F.col("s") < spread)).cast("double")).alias("share"))
    frames = p.groupBy("frame_id").agg(F.first("med").alias("med"), F.first("mean").alias("mean"), F.first("sd").alias("sd"))
    small = F.when((F.col("med") > F.col("mean") * small_ratio) & (F.col("sd") < small_spread), 0.0).otherwise(1.0)
    return frames.join(blocks, "frame_id", "left").select("frame_id", F.coalesce(C.clip(1 - F.col("share")), small).alias("cloud"))


def clahe_lut(pixels: DataFrame, tile: int, bins: int = 256, limit: float = 2.0) -> DataFrame:
    """Per tile and bin the contrast-limited cumulative share. Pixels beyond the last whole tile belong to none."""
    key = ["frame_id", "ch", "ty", "tx"]
    p = pixels.withColumns({"nh": F.greatest(F.lit(1), F.expr(f"(max(y) over (partition by frame_id, ch) + 1) div {tile}")), "nw": F.greatest(F.lit(1), F.expr(f"(max(x) over (partition by frame_id, ch) + 1) div {tile}"))})
    p = p.withColumns({"ty": F.expr(f"y div {tile}"), "tx": F.expr(f"x div {tile}"), "bin": F.least(F.greatest(F.floor(F.col("v") * (bins - 1)), F.lit(0)), F.lit(bins - 1)).cast("int")}).where("ty < nh and tx < nw")
    counts = p.groupBy(*key, "bin").agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy(*key).agg(F.sum("n").alias("pixels")).withColumn("cap", F.greatest(F.lit(1), F.bround(F.col("pixels") * limit / bins, 0).cast("bigint")))
    every = total.select(*key, "pixels", "cap", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")).join(counts, [*key, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    t = Window.partitionBy(*key)
    every = every.withColumn("over", F.sum(F.greatest(F.col("n") - F.col("cap"), F.lit(0))).over(t))
    even = F.least("n", "cap") + F.floor(F.col("over") / bins) + F.when(F.col("bin") < F.col("over") % bins, 1).otherwise(0)
    cdf = every.withColumn("cdf", F.sum(even).over(t.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))
    cdf = cdf.withColumn("least", F.coalesce(F.min(F.when(F.col("cdf") > 0, F.col("cdf"))).over(t), F.lit(0)))
    lut = F.when(F.col("pixels") > F.col("least"), C.clip((F.col("cdf") - F.col("least")) / (F.col("pixels") - F.col("least")))).otherwise(F.col("bin") / F.lit(float(bins - 1)))
    return cdf.select(*key, "bin", lut.alias("lut"))


def clahe(pixels: DataFrame, tile: int, bins: int = 256, limit: float = 2.0) -> DataFrame:
    """Contrast-limited adaptive equalisation: each pixel between the look-up tables of its four nearest tile centres."""
    w = Window.partitionBy("frame_id", "ch")
    size = lambda c: F.greatest(F.lit(1), F.floor((F.max(c).over(w) + 1) / tile)).cast("int")
    p = pixels.withColumns({"nh": size("y"), "nw": size("x"), "H": F.max("y").over(w) + 1, "W": F.max("x").over(w) + 1})
    half = lambda n: (F.least(F.lit(tile), F.col(n)) - 1) / 2.0
    for c, n, count, lo, hi, f in (("y", "H", "nh", "y0", "y1", "fy"), ("x", "W", "nw", "x0", "x1", "fx")):
        u = F.least(F.greatest((F.col(c) - half(n)) / tile, F.lit(0.0)), (F.col(count) - 1).cast("double"))
        p = p.withColumn("__u", u).withColumns({lo: F.floor("__u").cast("bigint"), f: F.col("__u") - F.floor("__u")}).withColumn(hi, F.least(F.col(lo) + 1, F.col(count) - 1).cast("bigint")).drop("__u")
    p = p.withColumn("bin", F.least(F.greatest(F.floor(F.col("v") * (bins - 1)), F.lit(0)), F.lit(bins - 1)).cast("int"))
    weight = lambda a, b: (F.col("fy") if a == "y1" else 1 - F.col("fy")) * (F.col("fx") if b == "x1" else 1 - F.col("fx"))
    corners = [F.struct(F.lit(n).alias("tap"), F.col(a).alias("ty"), F.col(b).alias("tx"), weight(a, b).alias("k")) for n, (a, b) in enumerate((a, b) for a in ("y0", "y1") for b in ("x0", "x1"))]
    taps = p.select("frame_id", "ch", "y", "x", "bin", F.explode(F.array(*corners)).alias("t")).select("frame_id", "ch", "y", "x", "bin", "t.*")
    met = taps.join(clahe_lut(pixels, tile, bins, limit), ["frame_id", "ch", "ty", "tx", "bin"])
    # the four terms in one order, column by column, whatever order their rows come in
    terms = met.groupBy("frame_id", "ch", "y", "x").agg(*[F.max(F.when(F.col("tap") == n, F.col("k") * F.col("lut"))).alias(f"t{n}") for n in range(4)])
    return terms.select("frame_id", "ch", "y", "x", C.clip(F.expr("t0 + t2 + t1 + t3")).alias("v"))
