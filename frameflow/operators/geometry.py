"""Resampling and measuring in the image plane: drizzle, warps, mosaic extents, apertures, heat maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def affine(pixels: DataFrame, m: tuple[float, float, float, float, float, float] | list[Column]) -> tuple[Column, Column]:
    """(x', y') of ``pixels``' places under x' = m0 x + m1 y + m2, y' = m3 x + m4 y + m5."""
    m = [F.lit(v) if not isinstance(v, Column) else v for v in m]
    return m[0] * F.col("x") + m[1] * F.col("y") + m[2], m[3] * F.col("x") + m[4] * F.col("y") + m[5]


def cd_affine(cd_in: list[Column], crpix_in: list[Column], cd_ref: tuple, crpix_ref: tuple) -> list[Column]:
    """The affine step from a frame's pixels to the reference's: R = inverse(CDref) CDin, t = crpix_ref - R crpix_in."""
    a, b, c, d = cd_ref
    det = a * d - b * c
    r = [(d * cd_in[0] - b * cd_in[2]) / det, (d * cd_in[1] - b * cd_in[3]) / det, (a * cd_in[2] - c * cd_in[0]) / det, (a * cd_in[3] - c * cd_in[1]) / det]
    t = [crpix_ref[0] - r[0] * crpix_in[0] - r[1] * crpix_in[1], crpix_ref[1] - r[2] * crpix_in[0] - r[3] * crpix_in[1]]
    return [r[0], r[1], t[0], r[2], r[3], t[1]]


def drizzle(pixels: DataFrame, x: Column, y: Column, height: int, width: int, drop: float = 0.7, pixfrac: float = 1.0, scale: float = 1.0, mode: str = "reference", by: tuple[str, ...] = ("ch",)) -> DataFrame:
    """Drops of side drop * pixfrac at (x, y), shared out by overlap with the unit cells [k, k + 1) of the output grid.

    Only drops wholly inside count. The coordinates are divided by ``scale``, or multiplied with mode 'upsample'."""
    half = drop * pixfrac / 2
    k = 1 / scale if mode == "reference" else scale
    p = pixels.withColumns({"__x": x * k, "__y": y * k})
    lo, hi = lambda c: F.floor(F.col(c) - half), lambda c: F.floor(F.col(c) + half)
    p = p.where((lo("__x") >= 0) & (lo("__y") >= 0) & (hi("__x") < width) & (hi("__y") < height))
    cells = p.select("*", F.explode(F.sequence(lo("__x"), hi("__x"))).alias("ox")).select("*", F.explode(F.sequence(lo("__y"), hi("__y"))).alias("oy"))
    share = lambda c, o: F.greatest(F.lit(0.0), F.least(F.col(c) + half, F.col(o) + 1.0) - F.greatest(F.col(c) - half, F.col(o).cast("double")))
    w = cells.withColumn("__k", share("__x", "ox") * share("__y", "oy")).where("__k > 0")
    return w.groupBy(*by, "oy", "ox").agg((F.sum(F.col("v") * F.col("__k")) / F.sum("__k")).alias("v"), F.sum("__k").alias("weight"))


def warp(pixels: DataFrame, targets: DataFrame, sx: Column, sy: Column) -> DataFrame:
    """Bilinear: each target place (frame_id, ch, y, x) reads the source at (sx, sy); outside is 0."""
    t = targets.withColumns({"__sx": sx, "__sy": sy}).withColumns({"__x0": F.floor("__sx"), "__y0": F.floor("__sy")})
    fx, fy = F.col("__sx") - F.col("__x0"), F.col("__sy") - F.col("__y0")
    taps = F.array(*[F.struct((F.col("__y0") + j).alias("ny"), (F.col("__x0") + i).alias("nx"), ((fy if j else 1 - fy) * (fx if i else 1 - fx)).alias("k")) for j in (0, 1) for i in (0, 1)])
    reads = t.select("frame_id", "ch", "y", "x", F.explode(taps).alias("t")).select("frame_id", "ch", "y", "x", "t.*")
    source = pixels.select("frame_id", "ch", F.col("y").cast("bigint").alias("ny"), F.col("x").cast("bigint").alias("nx"), F.col("v").alias("u"))
    return reads.join(source, ["frame_id", "ch", "ny", "nx"], "left").groupBy("frame_id", "ch", "y", "x").agg(F.sum(F.coalesce(F.col("u") * F.col("k"), F.lit(0.0))).alias("v"))


def mosaic_extent(corners: DataFrame, pixel_scale: float, output_scale: float = 1.0) -> DataFrame:
    """One row from panels' corners (ra, dec): the centre and the size nx, ny of the mosaic."""
    e = corners.agg(*[f(c).alias(f"{c}_{n}") for c in ("ra", "dec") for n, f in (("min", F.min), ("max", F.max))])
    e = e.withColumns({"ra": (F.col("ra_min") + F.col("ra_max")) / 2, "dec": (F.col("dec_min") + F.col("dec_max")) / 2})
    s = pixel_scale / output_scale
    n = lambda span: F.ceil(span / s).cast("bigint") + 1
    return e.select("ra", "dec", n((F.col("ra_max") - F.col("ra_min")) * F.cos(F.radians("dec"))).alias("nx"), n(F.col("dec_max") - F.col("dec_min")).alias("ny"))


def aperture_flux(pixels: DataFrame, stars: DataFrame, radius: float, parity: bool = False) -> DataFrame:
    """Per star (frame_id, star_id, sy, sx): background (median in the annulus 1.5 r to 2.5 r) and flux above it within r.

    Stars go into the cells of side 2.5 r around them, so the join is an equi-join. With ``parity`` only the cutout of
    ceil(r) around the star is read, which the annulus rarely meets; the background is then 0."""
    import math

    reach = 2.5 * radius
    cell = lambda c: F.floor(F.col(c) / reach)
    near = stars.select("*", F.explode(F.array(*[F.struct((cell("sy") + j).alias("cy"), (cell("sx") + i).alias("cx")) for j in (-1, 0, 1) for i in (-1, 0, 1)])).alias("c")).select("*", "c.*").drop("c")
    met = pixels.withColumns({"cy": cell("y"), "cx": cell("x")}).join(near, ["frame_id", "cy", "cx"])
    dy, dx = F.col("y") - F.col("sy"), F.col("x") - F.col("sx")
    met = met.withColumn("d", F.sqrt(dy * dy + dx * dx)).where(F.col("d") <= reach)
    if parity:
        side = math.ceil(radius)
        met = met.where((F.abs(dy) <= side) & (F.abs(dx) <= side))
    ring = (F.col("d") >= 1.5 * radius) & (F.col("d") <= reach)
    inside = F.col("d") <= radius
    s = met.groupBy("frame_id", "star_id").agg(F.coalesce(F.median(F.when(ring, F.col("v"))), F.lit(0.0)).alias("bg"), F.sum(F.when(inside, F.col("v"))).alias("total"), F.count_if(inside).alias("n"))
    return s.select("frame_id", "star_id", "bg", "n", F.greatest(F.col("total") - F.col("n") * F.col("bg"), F.lit(1e-10)).alias("flux"))


NODES = 16  # nodes of a grid that one group sums


def idw_grid(stars: DataFrame, height: int, width: int, step: int, power: float = 2.0, smooth: float = 4.0) -> DataFrame:
    """Inverse-distance mean of the stars' value on a grid of at most (height / step) * (width / step) nodes a frame.

    Each star goes to slabs of ``NODES`` nodes, whose sums are columns of one group."""
    across = -(-width // step)
    nodes = across * -(-height // step)
    node = [F.col("slab") * NODES + k for k in range(NODES)]
    at = lambda n: (F.floor(n / across) * step, n % across * step)
    w = [1 / F.pow((at(n)[0] - F.col("sy")) ** 2 + (at(n)[1] - F.col("sx")) ** 2 + smooth, F.lit(power / 2)) for n in node]
    dealt = stars.where("frame_id is not null").select("frame_id", "sy", "sx", "value", F.explode(F.sequence(F.lit(0), F.lit((nodes - 1) // NODES))).alias("slab"))
    sums = dealt.groupBy("frame_id", "slab").agg(*[F.sum(w[k] * F.col("value")).alias(f"a{k}") for k in range(NODES)], *[F.sum(w[k]).alias(f"b{k}") for k in range(NODES)])
    each = F.array(*[F.struct(node[k].alias("n"), (F.col(f"a{k}") / F.col(f"b{k}")).alias("value")) for k in range(NODES)])
    out = sums.select("frame_id", F.explode(each).alias("o")).where(f"o.n < {nodes}")
    return out.select("frame_id", at(F.col("o.n"))[0].cast("int").alias("gy"), at(F.col("o.n"))[1].cast("int").alias("gx"), F.col("o.value").alias("value"))


def connected_labels(mask: DataFrame, rounds: int | None = None) -> DataFrame:
    """4-connected labels of mask pixels (frame_id, y, x): the smallest pixel number y * 2^20 + x of the component.

    Runs along rows are numbered by a window, so that labels only have to travel between runs; the components of the
    runs' contacts come from alternating star steps on their numbers, which are unique over all frames."""
    w = Window.partitionBy("frame_id", "y").orderBy("x")
    runs = mask.select("frame_id", "y", "x").withColumn("__new", (F.col("x") - F.coalesce(F.lag("x").over(w), F.lit(-2)) > 1).cast("int"))
    runs = runs.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    start = F.min("x").over(Window.partitionBy("frame_id", "y", "__run"))
    px = runs.select("frame_id", "y", "x", (F.col("y").cast("bigint") * (1 << 20) + start).alias("run"))
    up = px.select("frame_id", (F.col("y") + 1).alias("y"), "x", F.col("run").alias("above"))
    edges = px.join(up, ["frame_id", "y", "x"]).select("frame_id", "run", "above").distinct()
    from frameflow.operators.components import propagate

    labels = propagate(edges, px.select("frame_id", "run").distinct(), rounds)
    return px.join(labels, ["frame_id", "run"]).select("frame_id", "y", "x", "label")


def region_props(labelled: DataFrame, pixels: DataFrame) -> DataFrame:
    """Per label: area, flux, box, flux-weighted centroid, peak and its place (ties to the first), second moments."""
    p = labelled.join(pixels, ["frame_id", "y", "x"])
    y, x, v = F.col("y"), F.col("x"), F.col("v")
    s = p.groupBy("frame_id", "label").agg(
        F.count(F.lit(1)).alias("area"), F.sum("v").alias("flux"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"), (F.sum(y * v) / F.sum("v")).alias("cy"), (F.sum(x * v) / F.sum("v")).alias("cx"),
        F.max("v").alias("peak"), F.min_by(F.struct("y", "x"), F.struct(-v, y, x)).alias("at"), F.var_pop(x.cast("double")).alias("mu20"), F.var_pop(y.cast("double")).alias("mu02"), F.covar_pop(x.cast("double"), y.cast("double")).alias("mu11"),
    )
    return s.select("*", F.col("at.y").alias("py"), F.col("at.x").alias("px")).drop("at")


def roundness(props: DataFrame, least: int = 3) -> DataFrame:
    """Per frame the median of 1 - eccentricity over regions of at least ``least`` pixels; 0 without any."""
    trace, det = F.col("mu20") + F.col("mu02"), F.col("mu20") * F.col("mu02") - F.col("mu11") * F.col("mu11")
    root = F.sqrt(F.greatest(trace * trace - 4 * det, F.lit(0.0)))
    l1, l2 = (trace + root) / 2, (trace - root) / 2
    ok = (F.col("area") >= least) & (trace >= 1e-12)
    value = F.when(ok, 1 - F.sqrt(F.greatest(1 - l2 / l1, F.lit(0.0))))
    return props.groupBy("frame_id").agg(F.least(F.greatest(F.coalesce(F.median(value), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)).alias("roundness"))


def star_filter(props: DataFrame, low: int = 3, high: int = 5000, aspect: float = 4.0) -> DataFrame:
    """Regions of a fitting area whose box isn't longer than ``aspect`` times its width."""
    h, w = F.col("y1") - F.col("y0") + 1, F.col("x1") - F.col("x0") + 1
    return props.where(F.col("area").between(low, high) & (F.greatest(h, w) / F.least(h, w) <= aspect))


def top_stars(props: DataFrame, k: int = 200) -> DataFrame:
    return props.withColumn("rank", F.row_number().over(Window.partitionBy("frame_id").orderBy(F.desc("flux"), "label"))).where(F.col("rank") <= k)


def half_flux_radius(pixels: DataFrame, stars: DataFrame, reach: int = 15) -> DataFrame:
    """Per star (frame_id, star_id, sy, sx) the radius where the cumulative flux, by distance, reaches half the total.

    A star goes into the at most four cells of the pixels' grid that its box meets, so the join is an equi-join."""
    side = 2 * reach + 1
    cells = lambda c: F.sequence(F.floor((F.col(c) - reach) / side), F.floor((F.col(c) + reach) / side))
    near = stars.withColumn("cy", F.explode(cells("sy"))).withColumn("cx", F.explode(cells("sx")))
    placed = pixels.withColumns({"cy": F.floor(F.col("y") / side), "cx": F.floor(F.col("x") / side)})
    met = near.join(placed, ["frame_id", "cy", "cx"]).where(F.expr(f"abs(y - sy) <= {reach} and abs(x - sx) <= {reach}"))
    d2 = (F.col("y") - F.col("sy")) ** 2 + (F.col("x") - F.col("sx")) ** 2
    rings = met.groupBy("frame_id", "star_id", F.sqrt(d2).alias("r")).agg(F.sum("v").alias("v"))  # equal radii count together
    w = Window.partitionBy("frame_id", "star_id")
    cum = rings.withColumns({"cum": F.sum("v").over(w.orderBy("r").rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("v").over(w), "rmax": F.max("r").over(w)})
    return cum.where("total >= 1e-8 and rmax >= 1").groupBy("frame_id", "star_id").agg(F.coalesce(F.min(F.when(F.col("cum") >= F.col("total") / 2, F.col("r"))), F.max("r")).alias("hfr"))


def frame_score(hfr: DataFrame, round_: DataFrame, cloud: DataFrame, frames: DataFrame) -> DataFrame:
    """0.4 * (1 - median hfr / 10) + 0.35 * roundness + 0.25 * cloud, each clipped; without stars the first two are 0."""
    h = hfr.groupBy("frame_id").agg(F.least(F.greatest(1 - F.median("hfr") / 10, F.lit(0.0)), F.lit(1.0)).alias("h"))
    j = frames.select("frame_id").distinct().join(h, "frame_id", "left").join(round_, "frame_id", "left").join(cloud, "frame_id", "left")
    zero = F.lit(0.0)
    return j.select("frame_id", F.least(F.greatest(F.coalesce("h", zero) * 0.4 + F.coalesce("roundness", zero) * 0.35 + F.coalesce("cloud", zero) * 0.25, zero), F.lit(1.0)).alias("score"))


def psf_aggregate(stars: DataFrame, fwhm_limit: float = 0.0) -> DataFrame:
    """Per frame from star rows (fwhm, ellipticity, strehl, hfr): medians, the 90th percentile, and whether the median
    width exceeds ``fwhm_limit`` (0: no limit)."""
    width = F.median("fwhm")
    return stars.groupBy("frame_id").agg(
        F.count(F.lit(1)).alias("n"), width.alias("fwhm"), F.percentile("fwhm", 0.9).alias("fwhm_p90"), F.median("ellipticity").alias("ellipticity"), F.median("strehl").alias("strehl"),
        F.median(F.abs(F.col("fwhm") / 2 - F.col("hfr"))).alias("hfr_gap"), ((F.lit(fwhm_limit) > 0) & (width > fwhm_limit)).alias("exceeds_limit"),
    )


def color_fit_round(stars: DataFrame, sigma: float = 2.5) -> DataFrame:
    """One round of the white-balance fit over ratios rr and rb: median scales, rms and the inliers that remain."""
    scale = stars.agg(F.median("rr").alias("scale_r"), F.median("rb").alias("scale_b"))
    r = stars.crossJoin(F.broadcast(scale)).withColumn("t", F.sqrt((F.col("rr") - F.col("scale_r")) ** 2 + (F.col("rb") - F.col("scale_b")) ** 2))
    s = r.agg(F.sqrt(F.avg(F.col("t") * F.col("t"))).alias("rms"), F.greatest(F.stddev_pop("t") * sigma, F.median("t") * 3).alias("cut"))
    return r.crossJoin(F.broadcast(s)).groupBy("scale_r", "scale_b", "rms").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("t") < F.col("cut")).alias("inliers"))


def color_aperture_flux(pixels: DataFrame, stars: DataFrame, radius: int) -> DataFrame:
    """Per star (frame_id, star_id, sy, sx) the flux r, g, b within ``radius`` of its nearest pixel. Stars whose box leaves
    the frame, or without light in any channel, have no row."""
    side = 2 * radius + 1
    centred = stars.withColumns({"py": F.bround("sy").cast("int"), "px": F.bround("sx").cast("int")})
    cells = lambda c: F.sequence(F.floor((F.col(c) - radius) / side), F.floor((F.col(c) + radius) / side))
    near = centred.select("frame_id", "star_id", "py", "px", F.explode(cells("py")).alias("cy"), "sx").withColumn("cx", F.explode(cells("px"))).drop("sx")
    placed = pixels.withColumns({"cy": F.floor(F.col("y") / side), "cx": F.floor(F.col("x") / side)})
    met = near.join(placed, ["frame_id", "cy", "cx"]).where((F.abs(F.col("y") - F.col("py")) <= radius) & (F.abs(F.col("x") - F.col("px")) <= radius))
    dy, dx = F.col("y") - F.col("py"), F.col("x") - F.col("px")
    flux = lambda k: F.sum(F.when((F.col("ch") == k) & (dy * dy + dx * dx <= radius * radius), F.col("v")))
    sums = met.groupBy("frame_id", "star_id").agg(F.count_if(F.col("ch") == 0).alias("n"), *[flux(k).alias(c) for k, c in enumerate("rgb")])
    return sums.where((F.col("n") == side * side) & (F.col("r") > 0) & (F.col("g") > 0) & (F.col("b") > 0)).drop("n")


def _medians(stars: DataFrame) -> tuple:
    return tuple(stars.agg(F.count(F.lit(1)), F.median("rr"), F.median("rb")).first())


def color_fit(stars: DataFrame, sigma: float = 2.5, rounds: int = 10, least: int = 5) -> DataFrame:
    """The white-balance fit over ratios rr and rb: one row with the median scales, their rms and the stars that remain.

    In each round stars go that are off by both ``sigma`` deviations and three median residuals or more; it ends without
    such stars, with less than ``least`` of them, or where the residuals vanish. A round sends five numbers to the driver."""
    for _ in range(rounds):
        n, r, b = _medians(stars)
        if n < least:
            break
        off = stars.withColumn("t", F.sqrt((F.col("rr") - r) ** 2 + (F.col("rb") - b) ** 2))
        spread, middle = off.agg(F.stddev_pop("t"), F.median("t")).first()
        if spread < 1e-6 or middle < 1e-6:
            break
        kept = off.where(F.col("t") < max(sigma * spread, 3 * middle)).select(*stars.columns)
        if kept.count() == n:
            break
        stars = kept
    n, r, b = _medians(stars)
    off = F.sqrt(F.avg((F.col("rr") - F.lit(r)) ** 2 + (F.col("rb") - F.lit(b)) ** 2))
    return stars.agg(F.lit(r if n else 1.0).alias("scale_r"), F.lit(b if n else 1.0).alias("scale_b"), F.coalesce(off, F.lit(0.0)).alias("rms"), F.count(F.lit(1)).alias("inliers"))
