"""Queries over pixels: calibration, stacks, statistics, stretches and colour."""

from __future__ import annotations

from pyspark.sql import functions as F

from frameflow.functions import curves as C
from frameflow.operators import pixels as P
from frameflow.plans.fixtures import DARK, FLAT, PX, RGB, UNIT, dark_master, flat_master, pixels, r6, rgb_pixels, s6, unit_pixels
from frameflow.plans.registry import query

CLIP = "least(greatest({0}, 0.0), 1.0)"


def clip(x: str) -> str:
    return CLIP.format(x)


@query("apply_dark", f"WITH {PX}, {DARK} SELECT frame_id, y, x, {s6('greatest(v - d, 0.0)')} AS v FROM px JOIN dark USING (y, x)")
def apply_dark(spark, sf):
    return P.apply_dark(pixels(spark, sf), dark_master(spark, sf)).select("frame_id", "y", "x", r6("v").alias("v"))


NORMAL_FLAT = f"{FLAT}, nf AS (SELECT y, x, greatest(f / greatest((SELECT median(f) FROM flat), 1e-7), 1e-7) AS f FROM flat)"


@query("apply_flat", f"WITH {PX}, {NORMAL_FLAT} SELECT frame_id, y, x, {s6('v / f')} AS v FROM px JOIN nf USING (y, x)")
def apply_flat(spark, sf):
    return P.apply_flat(pixels(spark, sf), flat_master(spark, sf)).select("frame_id", "y", "x", r6("v").alias("v"))


@query("calibrate_frame", f"WITH {PX}, {DARK}, {NORMAL_FLAT} SELECT frame_id, y, x, {s6('greatest(v - d, 0.0) / f')} AS v FROM px JOIN dark USING (y, x) JOIN nf USING (y, x)")
def calibrate_frame(spark, sf):
    return P.apply_flat(P.apply_dark(pixels(spark, sf), dark_master(spark, sf)), flat_master(spark, sf)).select("frame_id", "y", "x", r6("v").alias("v"))


def stack_sql(f: str) -> str:
    return f"WITH {PX} SELECT target, ch, y, x, {s6(f)} AS v, count(v) AS n FROM px GROUP BY target, ch, y, x"


def stack(spark, sf, method):
    return P.stack(pixels(spark, sf), method).select("target", "ch", "y", "x", r6("v").alias("v"), "n")


@query("stack_mean", stack_sql("avg(v)"))
def stack_mean(spark, sf):
    return stack(spark, sf, "mean")


@query("stack_median", stack_sql("median(v)"))
def stack_median(spark, sf):
    return stack(spark, sf, "median")


def clip_sql(rounds: int) -> str:
    out = "c0 AS (SELECT * FROM px)"
    for k in range(rounds):
        out += f""", c{k + 1} AS (SELECT * EXCLUDE (m, s) FROM (SELECT *, avg(v) OVER w AS m, stddev_pop(v) OVER w AS s FROM c{k} WINDOW w AS (PARTITION BY target, ch, y, x)) WHERE v >= m - 2.5 * s - (abs(m) + 1) * 1e-12 AND v <= m + 2.5 * s + (abs(m) + 1) * 1e-12)"""
    return out


@query("stack_sigma_clip", f"WITH {PX}, {clip_sql(5)} SELECT target, ch, y, x, {s6('avg(v)')} AS v, count(v) AS n FROM c5 GROUP BY target, ch, y, x")
def stack_sigma_clip(spark, sf):
    return stack(spark, sf, "sigma_clip")


@query("comet_blend", f"WITH {PX}, a AS (SELECT target, ch, y, x, avg(v) AS v FROM px GROUP BY 1, 2, 3, 4), b AS (SELECT target, ch, y, x, median(v) AS v FROM px GROUP BY 1, 2, 3, 4) SELECT target, y, x, {s6('0.7 * a.v + 0.3 * b.v')} AS v FROM a JOIN b USING (target, ch, y, x)")
def comet_blend(spark, sf):
    px = pixels(spark, sf)
    a, b = P.stack(px, "mean").drop("n"), P.stack(px, "median").drop("n")
    return P.blend(a, b, 0.3, ("target", *P.PLACE)).select("target", "y", "x", r6("v").alias("v"))


@query("overlap_medians", f"WITH {PX}, p AS (SELECT frame_id AS f, y, x + CAST(frame_id AS INTEGER) AS x, v FROM px) SELECT a.f AS a, b.f AS b, count(*) AS n, {s6('median(a.v) - median(b.v)')} AS offset FROM p a JOIN p b USING (y, x) WHERE a.f < b.f GROUP BY 1, 2 HAVING count(*) >= 10")
def overlap_medians(spark, sf):
    p = pixels(spark, sf).withColumn("x", (F.col("x") + F.col("frame_id")).cast("int"))
    return P.overlap_medians(p).select("a", "b", "n", r6("offset").alias("offset"))


@query("image_stats", f"WITH {RGB} SELECT frame_id, ch, {s6('avg(v)')} AS mean, {s6('median(v)')} AS median, {s6('stddev_pop(v)')} AS std, {s6('CASE WHEN stddev_pop(v) >= 1e-8 THEN avg(v) / stddev_pop(v) END')} AS snr, {s6('min(v)')} AS min, {s6('max(v)')} AS max FROM rgb GROUP BY frame_id, ch")
def image_stats(spark, sf):
    return P.image_stats(rgb_pixels(spark, sf)).select("frame_id", "ch", *[r6(c).alias(c) for c in ("mean", "median", "std", "snr", "min", "max")])


@query("histogram", f"""WITH {RGB}, e AS (SELECT ch, min(v) AS lo, max(v) AS hi FROM rgb GROUP BY ch), n AS (SELECT ch, CAST(least(floor((v - lo) / (hi - lo) * 256), 255) AS INTEGER) AS bin, count(*) AS n FROM rgb JOIN e USING (ch) WHERE hi > lo GROUP BY 1, 2)
    SELECT ch, bin, coalesce(n, 0) AS n FROM (SELECT ch, CAST(unnest(range(256)) AS INTEGER) AS bin FROM e) LEFT JOIN n USING (ch, bin)""")
def histogram(spark, sf):
    return P.histogram(rgb_pixels(spark, sf))


BG = "bg{0} AS (SELECT frame_id, ch, median(v) AS bg FROM rgb JOIN (SELECT frame_id, ch, quantile_cont(v, {1}) AS cut FROM rgb GROUP BY 1, 2) USING (frame_id, ch) WHERE v <= cut GROUP BY 1, 2)"


@query("channel_background", f"WITH {RGB}, {BG.format('', 0.02)} SELECT frame_id, ch, {s6('bg')} AS bg FROM bg")
def channel_background(spark, sf):
    return P.background(rgb_pixels(spark, sf), 0.02, ("frame_id", "ch")).select("frame_id", "ch", r6("bg").alias("bg"))


@query("bg_neutralize", f"WITH {RGB}, {BG.format('', 0.02)} SELECT frame_id, ch, y, x, {s6(clip('v + 0.1 - bg'))} AS v FROM rgb JOIN bg USING (frame_id, ch)")
def bg_neutralize(spark, sf):
    return P.neutralise(rgb_pixels(spark, sf), 0.1, 0.02).select("frame_id", "ch", "y", "x", r6("v").alias("v"))


@query("channel_balance", f"WITH {RGB}, {BG.format('', 0.05)}, a AS (SELECT frame_id, ch, min(bg) OVER (PARTITION BY frame_id) - bg AS add FROM bg) SELECT frame_id, ch, y, x, {s6(clip('v + add'))} AS v FROM rgb JOIN a USING (frame_id, ch)")
def channel_balance(spark, sf):
    return P.auto_balance(rgb_pixels(spark, sf), 0.05).select("frame_id", "ch", "y", "x", r6("v").alias("v"))


@query("mtf_background", f"WITH {UNIT}, m AS (SELECT frame_id, median(v) AS med FROM un GROUP BY 1) SELECT frame_id, {s6('coalesce(median(v) FILTER (v < med), any_value(med))')} AS bg FROM un JOIN m USING (frame_id) GROUP BY frame_id")
def mtf_background(spark, sf):
    return P.mtf_background(unit_pixels(spark, sf), ("frame_id",)).select("frame_id", r6("bg").alias("bg"))


MAD = "mad AS (SELECT frame_id, med, 1.4826 * median(abs(v - med)) AS sigma FROM {0} JOIN (SELECT frame_id, median(v) AS med FROM {0} GROUP BY 1) USING (frame_id) GROUP BY 1, 2)"


@query("median_mad", f"WITH {UNIT}, {MAD.format('un')} SELECT frame_id, {s6('med')} AS med, {s6('sigma')} AS sigma FROM mad")
def median_mad(spark, sf):
    return P.median_mad(unit_pixels(spark, sf), ("frame_id",)).select("frame_id", r6("med").alias("med"), r6("sigma").alias("sigma"))


def noise_sql() -> str:
    out = "k0 AS (SELECT frame_id, v, avg(v) OVER (PARTITION BY frame_id) AS mean FROM un)"
    for k in range(5):
        out += f""", m{k} AS (SELECT *, median(v) OVER (PARTITION BY frame_id) AS med FROM k{k}), d{k} AS (SELECT *, 1.4826 * median(abs(v - med)) OVER (PARTITION BY frame_id) AS mad FROM m{k}),
            n{k} AS (SELECT *, count(*) FILTER (abs(v - med) <= 3 * mad) OVER (PARTITION BY frame_id) AS n FROM d{k}), k{k + 1} AS (SELECT frame_id, v, mean FROM n{k} WHERE mad <= 0 OR n < 10 OR abs(v - med) <= 3 * mad)"""
    return out


STRENGTH = "CASE WHEN s <= 0.005 THEN 0.2 WHEN s <= 0.015 THEN (s - 0.005) * 30 + 0.2 WHEN s <= 0.040 THEN (s - 0.015) * 12 + 0.5 ELSE least((s - 0.040) / 0.3 + 0.8, 1.0) END"


@query("noise_estimate", f"WITH {UNIT}, {noise_sql()}, r AS (SELECT frame_id, stddev_pop(v) AS s, any_value(mean) AS mean FROM k5 GROUP BY 1) SELECT frame_id, {s6('s')} AS sky_sigma, {s6('20 * log10(greatest(mean, 1e-12) / s)')} AS snr_db, {s6(STRENGTH)} AS strength FROM r")
def noise_estimate(spark, sf):
    return P.noise_estimate(unit_pixels(spark, sf)).select("frame_id", *[r6(c).alias(c) for c in ("sky_sigma", "snr_db", "strength")])


@query("top_fraction_mask", f"WITH {PX}, r AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY v DESC) AS nth FROM px) SELECT p.frame_id, p.y, p.x FROM px p JOIN (SELECT frame_id, v AS cut FROM r WHERE nth = 3) USING (frame_id) WHERE p.v >= cut")
def top_fraction_mask(spark, sf):
    return P.top_fraction_mask(pixels(spark, sf), 0.05).select("frame_id", "y", "x")


STARS = "st AS (SELECT frame_id, y, x, v FROM (SELECT *, avg(v) OVER (PARTITION BY frame_id) AS m, stddev_pop(v) OVER (PARTITION BY frame_id) AS s FROM px) WHERE s >= 1e-8 AND v > m + 1.5 * s)"


@query("star_threshold", f"WITH {PX}, {STARS} SELECT frame_id, y, x FROM st")
def star_threshold(spark, sf):
    return P.threshold_mask(pixels(spark, sf), 1.5).select("frame_id", "y", "x")


@query("mask_intersection", f"WITH {PX}, {STARS} SELECT frame_id, y, x FROM st INTERSECT SELECT frame_id, y, x FROM px WHERE (x + y) % 2 = 0 AND v > 0.1")
def mask_intersection(spark, sf):
    px = pixels(spark, sf)
    return P.threshold_mask(px, 1.5).select("frame_id", "y", "x").join(px.where("(x + y) % 2 = 0 and v > 0.1"), ["frame_id", "y", "x"], "left_semi")


NORM = "nm AS (SELECT frame_id, y, x, CASE WHEN hi - lo < 1e-10 THEN 0.0 ELSE (v - lo) / (hi - lo) END AS v FROM (SELECT *, min(v) OVER (PARTITION BY frame_id) AS lo, max(v) OVER (PARTITION BY frame_id) AS hi FROM px))"


@query("normalize_minmax", f"WITH {PX}, {NORM} SELECT frame_id, y, x, {s6('v')} AS v FROM nm")
def normalize_minmax(spark, sf):
    return P.normalise(pixels(spark, sf)).select("frame_id", "y", "x", r6("v").alias("v"))


def mtf_sql(x: str, m: str) -> str:
    den = f"((2 * {m} - 1) * ({x}) - {m})"
    return f"CASE WHEN {x} <= 0 THEN 0.0 WHEN {x} >= 1 THEN 1.0 ELSE {clip(f'({m} - 1) * ({x}) / CASE WHEN abs({den}) < 1e-10 THEN 1e-10 ELSE {den} END')} END"


@query("stf_stretch", f"""WITH {PX}, {NORM}, {MAD.format('nm')}, s AS (SELECT frame_id, med, greatest(med - 2.8 * sigma, 0.0) AS sc FROM mad), b AS (SELECT frame_id, sc, least(greatest((med - sc) / greatest(1 - sc, 1e-10), 1e-6), 1 - 1e-6) AS bg FROM s),
    q AS (SELECT frame_id, sc, CASE WHEN bg >= 0.25 THEN 0.5 ELSE least(greatest(0.25 * (bg - 1) / (-0.5 * bg - 0.25), 0.01), 0.99) END AS m FROM b), t AS (SELECT frame_id, y, x, m, {clip('(v - sc) / greatest(1 - sc, 1e-10)')} AS u FROM nm JOIN q USING (frame_id))
    SELECT frame_id, y, x, {s6(mtf_sql('u', 'm'))} AS v FROM t""")
def stf_stretch(spark, sf):
    return P.stf_stretch(pixels(spark, sf).drop("target")).select("frame_id", "y", "x", r6("v").alias("v"))


@query("mtf", f"WITH {UNIT} SELECT frame_id, y, x, {s6(mtf_sql('u', '0.2'))} AS v FROM (SELECT *, {clip('(v - 0.02) / (0.99 - 0.02)')} AS u FROM un)")
def mtf(spark, sf):
    return unit_pixels(spark, sf).select("frame_id", "y", "x", r6(C.mtf_apply(F.col("v"), 0.2, 0.02, 0.99)).alias("v"))


@query("auto_midpoint", f"WITH {UNIT}, m AS (SELECT frame_id, 0.4 * median(v) AS bg FROM un GROUP BY 1) SELECT frame_id, {s6('CASE WHEN bg >= 0.25 THEN 0.25 ELSE least(greatest(0.25 * (bg - 1) / (-0.5 * bg - 0.25), 0.001), 0.499) END')} AS m FROM m")
def auto_midpoint(spark, sf):
    return unit_pixels(spark, sf).groupBy("frame_id").agg((F.median("v") * 0.4).alias("bg")).select("frame_id", r6(C.auto_midpoint(F.col("bg"))).alias("m"))


@query("asinh_stretch", f"WITH {UNIT} SELECT frame_id, y, x, {s6(clip('asinh(5.0 * ' + clip('v - 0.05') + ') / asinh(5.0)'))} AS v FROM un")
def asinh_stretch(spark, sf):
    return unit_pixels(spark, sf).select("frame_id", "y", "x", r6(C.asinh_stretch(F.col("v"), 5.0, 0.05)).alias("v"))


POINTS = [(0.0, 0.0), (0.25, 0.15), (0.5, 0.55), (0.75, 0.85), (1.0, 1.0)]


def curve_sql() -> str:
    out = ""
    for start, (a, b, c, d) in reversed(C.spline(POINTS)):
        t = f"(t - {start!r})"
        out += f"WHEN t >= {start!r} THEN (({t} * {a!r} + {b!r}) * {t} + {c!r}) * {t} + {d!r} " if start else f"ELSE (({t} * {a!r} + {b!r}) * {t} + {c!r}) * {t} + {d!r} "
    return f"CASE {out} END"


@query("curves", f"WITH {UNIT} SELECT frame_id, y, x, {s6(clip(curve_sql()))} AS v FROM (SELECT *, least(greatest(floor(v * 65535), 0), 65535) / 65535.0::DOUBLE AS t FROM un)")
def curves(spark, sf):
    return unit_pixels(spark, sf).select("frame_id", "y", "x", r6(C.tone_curve(F.col("v"), POINTS)).alias("v"))


@query("white_balance", f"WITH {RGB} SELECT frame_id, ch, y, x, {s6(clip('v * CASE ch WHEN 0 THEN 1.2 WHEN 1 THEN 1.0 ELSE 0.8 END'))} AS v FROM rgb")
def white_balance(spark, sf):
    return P.per_channel(rgb_pixels(spark, sf), (1.2, 1.0, 0.8)).select("frame_id", "ch", "y", "x", r6("v").alias("v"))


@query("gradient_remove", f"WITH {UNIT}, m AS (SELECT frame_id, median(v) AS med FROM un GROUP BY 1) SELECT frame_id, y, x, {s6('greatest(v - (0.1 + 0.01 * x + 0.02 * y) + med, 0.0)')} AS v FROM un JOIN m USING (frame_id)")
def gradient_remove(spark, sf):
    px = unit_pixels(spark, sf)
    model = px.select("frame_id", "ch", "y", "x", (F.col("x") * 0.01 + 0.1 + F.col("y") * 0.02).alias("bg"))
    return P.gradient_remove(px, model).select("frame_id", "y", "x", r6("v").alias("v"))


WIDE = f"{RGB}, w AS (SELECT frame_id, y, x, max(v) FILTER (ch = 0) AS r, max(v) FILTER (ch = 1) AS g, max(v) FILTER (ch = 2) AS b FROM rgb GROUP BY 1, 2, 3)"
FACTORS = {"reds": 1.5, "greens": 0.6, "blues": 1.2, "cyans": 0.0}


def saturation_sql() -> str:
    hue = "CASE WHEN d <= 0 THEN 0.0 WHEN t = r THEN (g - b) / d WHEN t = g THEN (b - r) / d + 2 ELSE (r - g) / d + 4 END / 6"
    weights = {n: f"greatest(0.0, 1 - least(abs(h - {c!r}), 1 - abs(h - {c!r})) / {w!r})" for n, (c, w) in C.HUES.items()}
    total = " + ".join(weights.values())
    mixed = " + ".join(f"{w} * {FACTORS.get(n, 1.0)!r}" for n, w in weights.items())
    channel = lambda n: clip(f"t - t * s2 * {clip(f'least(fmod(h * 6 + {n}, 6.0), 4 - fmod(h * 6 + {n}, 6.0))')}")
    return f"""WITH {WIDE}, a AS (SELECT *, greatest(r, g, b) AS t, greatest(r, g, b) - least(r, g, b) AS d FROM w), h AS (SELECT *, fmod({hue} + 1.0, 1.0) AS h, CASE WHEN t > 0 THEN d / t ELSE 0.0 END AS s FROM a),
        k AS (SELECT *, {clip(f"s * 1.1 * CASE WHEN {total} > 1e-8 THEN ({mixed}) / ({total}) ELSE 1.0 END")} AS s2 FROM h)
        SELECT frame_id, y, x, {s6(channel(5))} AS r, {s6(channel(3))} AS g, {s6(channel(1))} AS b FROM k"""


@query("saturation", saturation_sql())
def saturation(spark, sf):
    out = P.wide(P.saturation(rgb_pixels(spark, sf), FACTORS, 1.1))
    return out.select("frame_id", "y", "x", *[r6(c).alias(c) for c in "rgb"])


def grading_sql() -> str:
    shift = {"r": (0.1, -0.05, 0.02), "g": (0.0, 0.1, -0.1), "b": (-0.1, 0.05, 0.2)}
    out = ", ".join(s6(clip(f"{n} + pow(1 - l, 2) * {a} + mid * {m} + pow(l, 2) * {h}")) + f" AS {n}" for n, (a, m, h) in shift.items())
    return f"WITH {WIDE}, l AS (SELECT *, r * 0.2126 + g * 0.7152 + b * 0.0722 AS l FROM w), m AS (SELECT *, l * 4 * pow(1 - l, 1.5) AS raw FROM l), t AS (SELECT *, CASE WHEN max(raw) OVER (PARTITION BY frame_id) > 0 THEN raw / max(raw) OVER (PARTITION BY frame_id) ELSE raw END AS mid FROM m) SELECT frame_id, y, x, {out} FROM t"


@query("color_grading", grading_sql())
def color_grading(spark, sf):
    px = rgb_pixels(spark, sf)
    out = P.wide(P.color_grade(px, (0.1, 0.0, -0.1), (-0.05, 0.1, 0.05), (0.02, -0.1, 0.2)))
    return out.select("frame_id", "y", "x", *[r6(c).alias(c) for c in "rgb"])


PLANES = f"{UNIT}, pl AS (SELECT frame_id // 4 AS frame_id, y, x, max(v) FILTER (frame_id % 4 = 0) AS l, max(v) FILTER (frame_id % 4 = 1) AS r, max(v) FILTER (frame_id % 4 = 2) AS g, max(v) FILTER (frame_id % 4 = 3) AS b FROM un WHERE NOT (frame_id % 40 = 0 OR frame_id % 44 = 2) GROUP BY 1, 2, 3)"


def planes(spark, sf, names):
    px = unit_pixels(spark, sf).where("not (frame_id % 40 = 0 or frame_id % 44 = 2)")
    return px.groupBy(F.expr("frame_id div 4").alias("frame_id"), "y", "x").agg(*[F.max(F.when(F.col("frame_id") % 4 == k, F.col("v"))).alias(n) for k, n in enumerate(names)])


@query("lrgb_combine", f"""WITH {PLANES}, c AS (SELECT frame_id, y, x, l, coalesce(r, 0.0) AS r, coalesce(g, 0.0) AS g, coalesce(b, 0.0) AS b FROM pl), k AS (SELECT *, CASE WHEN l IS NOT NULL THEN l / (r * 0.299 + g * 0.587 + b * 0.114 + 2.220446049250313e-16) ELSE 1.0 END AS k FROM c)
    SELECT frame_id, y, x, {', '.join(f"{s6(clip(f'{n} * k'))} AS {n}" for n in 'rgb')} FROM k""")
def lrgb_combine(spark, sf):
    return P.lrgb_combine(planes(spark, sf, "lrgb")).select("frame_id", "y", "x", *[r6(c).alias(c) for c in "rgb"])


@query("narrowband", f"WITH {PLANES} SELECT frame_id, y, x, {s6('coalesce(l, 0.0)')} AS r, {s6('coalesce(r, 0.0)')} AS g, {s6('coalesce(g, 0.0)')} AS b FROM pl")
def narrowband(spark, sf):
    return P.narrowband(planes(spark, sf, "shon"), "SHO").select("frame_id", "y", "x", *[r6(c).alias(c) for c in "rgb"])


@query("luminance", f"WITH {WIDE} SELECT frame_id, y, x, {', '.join(s6(f'r * {w[0]!r} + g * {w[1]!r} + b * {w[2]!r}') + f' AS {n}' for n, w in C.GREY.items())} FROM w")
def luminance(spark, sf):
    return P.wide(rgb_pixels(spark, sf)).select("frame_id", "y", "x", *[r6(C.grey(F.col("r"), F.col("g"), F.col("b"), k)).alias(k) for k in C.GREY])


@query("preview_stretch", f"WITH {PX}, e AS (SELECT frame_id, quantile_cont(v, 0.005) AS lo, quantile_cont(v, 0.995) AS hi FROM px GROUP BY 1) SELECT frame_id, y, x, {s6('CASE WHEN hi > lo THEN ' + clip('(v - lo) / (hi - lo)') + ' ELSE v END')} AS v FROM px JOIN e USING (frame_id)")
def preview_stretch(spark, sf):
    return P.preview_stretch(pixels(spark, sf)).select("frame_id", "y", "x", r6("v").alias("v"))


@query("thumbnail", f"WITH {PX} SELECT frame_id, CAST(list_position([0, 2, 4, 7], y) - 1 AS INTEGER) AS y, CAST(list_position([0, 2, 4, 7], x) - 1 AS INTEGER) AS x, {s6('v')} AS v FROM px WHERE y IN (0, 2, 4, 7) AND x IN (0, 2, 4, 7)")
def thumbnail(spark, sf):
    return P.thumbnail(pixels(spark, sf), 4, 8, 8).select("frame_id", "y", "x", r6("v").alias("v"))


PAIR = f"{UNIT}, a AS (SELECT frame_id // 2 AS frame_id, ch, y, x, v FROM un WHERE frame_id % 2 = 0), b AS (SELECT frame_id // 2 AS frame_id, ch, y, x, v AS u FROM un WHERE frame_id % 2 = 1)"


def pair(spark, sf):
    px = unit_pixels(spark, sf).drop("target")
    half = lambda k: px.where(f"frame_id % 2 = {k}").withColumn("frame_id", F.expr("frame_id div 2"))
    return half(0), half(1)


@query("diff_image", f"WITH {PAIR} SELECT frame_id, y, x, {s6(clip('3 * abs(v - u)'))} AS v FROM a JOIN b USING (frame_id, ch, y, x)")
def diff_image(spark, sf):
    return P.diff_image(*pair(spark, sf)).select("frame_id", "y", "x", r6("v").alias("v"))


@query("derive_star_mask", f"WITH {PAIR}, d AS (SELECT frame_id, y, x, avg(abs(v - u)) AS d FROM a JOIN b USING (frame_id, ch, y, x) GROUP BY 1, 2, 3) SELECT frame_id, y, x, CAST(d > avg(d) OVER (PARTITION BY frame_id) + 2 * stddev_pop(d) OVER (PARTITION BY frame_id) AS DOUBLE) AS v FROM d")
def derive_star_mask(spark, sf):
    return P.star_mask(*pair(spark, sf)).select("frame_id", "y", "x", "v")


@query("star_reduce", f"WITH {PAIR} SELECT frame_id, y, x, {s6('greatest(v + 0.4 * u, 0.0)')} AS v FROM a JOIN b USING (frame_id, ch, y, x)")
def star_reduce(spark, sf):
    return P.star_reduce(*pair(spark, sf), 0.4).select("frame_id", "y", "x", r6("v").alias("v"))


@query("quantise8", f"WITH {UNIT} SELECT frame_id, y, x, CAST(floor(v * 255) AS INTEGER) AS v FROM un")
def quantise8(spark, sf):
    return P.quantise(unit_pixels(spark, sf)).select("frame_id", "y", "x", "v")


@query("instr_mag", f"WITH {PX} SELECT frame_id, {s6('-2.5 * log10(greatest(sum(v) + 1, 1e-10))')} AS mag FROM px GROUP BY frame_id")
def instr_mag(spark, sf):
    return pixels(spark, sf).groupBy("frame_id").agg((F.sum("v") + 1).alias("f")).select("frame_id", r6(C.magnitude(F.col("f"))).alias("mag"))


@query("tile_background", f"""WITH {PX}, t AS (SELECT frame_id, ch, y // 4 AS ty, x // 4 AS tx, v FROM px), c AS (SELECT *, quantile_cont(v, 0.8) OVER (PARTITION BY frame_id, ch, ty, tx) AS cut FROM t),
    l AS (SELECT *, avg(v) OVER w AS m, stddev_pop(v) OVER w AS s, count(*) OVER w AS n FROM c WHERE v <= cut WINDOW w AS (PARTITION BY frame_id, ch, ty, tx)),
    g AS (SELECT frame_id, ty, tx, any_value(n) AS n, any_value(m) AS m, any_value(s) AS s, count(*) FILTER (abs(v - m) <= 2.5 * s) AS k, median(v) FILTER (abs(v - m) <= 2.5 * s) AS med FROM l GROUP BY 1, 2, 3)
    SELECT frame_id, ty, tx, {s6('CASE WHEN n < 4 THEN NULL WHEN s < 1e-10 OR k < 2 THEN m ELSE med END')} AS v FROM g""")
def tile_background(spark, sf):
    return P.tile_values(pixels(spark, sf).drop("target"), 4).select("frame_id", "ty", "tx", r6("v").alias("v"))


@query("polynomial_background", f"""WITH {PX}, t AS (SELECT frame_id, ch, y // 4 AS ty, x // 4 AS tx, v FROM px), c AS (SELECT *, quantile_cont(v, 0.8) OVER (PARTITION BY frame_id, ch, ty, tx) AS cut FROM t),
    l AS (SELECT *, avg(v) OVER w AS m, stddev_pop(v) OVER w AS s, count(*) OVER w AS n FROM c WHERE v <= cut WINDOW w AS (PARTITION BY frame_id, ch, ty, tx)),
    g AS (SELECT frame_id, ty, tx, any_value(n) AS n, any_value(m) AS m, any_value(s) AS s, count(*) FILTER (abs(v - m) <= 2.5 * s) AS k, median(v) FILTER (abs(v - m) <= 2.5 * s) AS med FROM l GROUP BY 1, 2, 3),
    z AS (SELECT frame_id, ty * 4 + 2.0 AS y, tx * 4 + 2.0 AS x, CASE WHEN s < 1e-10 OR k < 2 THEN m ELSE med END AS v FROM g WHERE n >= 4),
    u AS (SELECT frame_id, count(*) AS n, avg(y) AS my, avg(x) AS mx, avg(v) AS mv, covar_pop(y, y) AS yy, covar_pop(x, x) AS xx, covar_pop(y, x) AS yx, covar_pop(y, v) AS yv, covar_pop(x, v) AS xv FROM z GROUP BY 1),
    f AS (SELECT *, (yv * xx - xv * yx) / (yy * xx - yx * yx) AS b, (xv * yy - yv * yx) / (yy * xx - yx * yx) AS a FROM u)
    SELECT px.frame_id, px.y, px.x, {s6('mv + b * (px.y - my) + a * (px.x - mx)')} AS bg FROM px JOIN f USING (frame_id)""")
def polynomial_background(spark, sf):
    from frameflow.operators.background import polynomial_background as model

    return model(pixels(spark, sf).drop("target"), 4, degree=1, soften=0).select("frame_id", "y", "x", r6("bg").alias("bg"))


CLOUD = "cl AS (SELECT frame_id, 1 - avg(CAST(m > med * 1.3 AND s < 0.09 AS DOUBLE)) AS cloud FROM (SELECT frame_id, y // 4 AS ty, x // 4 AS tx, median(v) AS m, stddev_pop(v) AS s FROM un GROUP BY 1, 2, 3) JOIN (SELECT frame_id, median(v) AS med FROM un GROUP BY 1) USING (frame_id) GROUP BY 1)"


@query("cloud_score", f"WITH {UNIT}, {CLOUD} SELECT frame_id, {s6('cloud')} AS cloud FROM cl")
def cloud_score(spark, sf):
    return P.cloud_score(unit_pixels(spark, sf), 4, spread=0.09).select("frame_id", r6("cloud").alias("cloud"))


LUT = f"""{UNIT}, q AS (SELECT frame_id, y // 4 AS ty, x // 4 AS tx, CAST(least(greatest(floor(v * 15), 0), 15) AS INTEGER) AS bin FROM un), n AS (SELECT frame_id, ty, tx, bin, count(*) AS n FROM q GROUP BY 1, 2, 3, 4),
    e AS (SELECT frame_id, ty, tx, CAST(unnest(range(16)) AS INTEGER) AS bin FROM (SELECT DISTINCT frame_id, ty, tx FROM q)), f AS (SELECT e.*, coalesce(n, 0) AS n FROM e LEFT JOIN n USING (frame_id, ty, tx, bin)),
    o AS (SELECT *, sum(greatest(n - 2, 0)) OVER (PARTITION BY frame_id, ty, tx) AS ov FROM f), h AS (SELECT *, least(n, 2) + ov // 16 + CASE WHEN bin < ov % 16 THEN 1 ELSE 0 END AS k FROM o),
    c AS (SELECT *, sum(k) OVER (PARTITION BY frame_id, ty, tx ORDER BY bin) AS cdf FROM h), l AS (SELECT *, coalesce(min(cdf) FILTER (cdf > 0) OVER (PARTITION BY frame_id, ty, tx), 0) AS lo FROM c),
    lut AS (SELECT frame_id, ty, tx, bin, CASE WHEN 16 > lo THEN least(greatest((cdf - lo) / (16.0::DOUBLE - lo), 0.0), 1.0) ELSE bin / 15.0::DOUBLE END AS lut FROM l)"""


@query("clahe_lut", f"WITH {LUT} SELECT frame_id, ty, tx, bin, {s6('lut')} AS lut FROM lut")
def clahe_lut(spark, sf):
    return P.clahe_lut(unit_pixels(spark, sf).drop("target"), 4, 16, 2.0).select("frame_id", "ty", "tx", "bin", r6("lut").alias("lut"))


@query("clahe", f"""WITH {LUT}, p AS (SELECT frame_id, y, x, CAST(least(greatest(floor(v * 15), 0), 15) AS INTEGER) AS bin, least(greatest((y - 1.5) / 4, 0.0), 1.0) AS u, least(greatest((x - 1.5) / 4, 0.0), 1.0) AS w FROM un),
    t AS (SELECT frame_id, y, x, bin, j AS ty, i AS tx, (CASE j WHEN 1 THEN u ELSE 1 - u END) * (CASE i WHEN 1 THEN w ELSE 1 - w END) AS k FROM p, (SELECT unnest([0, 1]) AS j), (SELECT unnest([0, 1]) AS i))
    SELECT frame_id, y, x, {s6(clip('sum(k * lut)'))} AS v FROM t JOIN lut USING (frame_id, ty, tx, bin) GROUP BY frame_id, y, x""")
def clahe(spark, sf):
    return P.clahe(unit_pixels(spark, sf).drop("target"), 4, 16, 2.0).select("frame_id", "y", "x", r6("v").alias("v"))


@query("color_fit_1round", f"""WITH s AS (SELECT 1 + (c_custkey * 7 % 101) / 200.0::DOUBLE AS rr, 0.8 + (c_custkey * 13 % 97) / 150.0::DOUBLE AS rb FROM customer), c AS (SELECT median(rr) AS sr, median(rb) AS sb FROM s), t AS (SELECT sr, sb, sqrt((rr - sr) ** 2 + (rb - sb) ** 2) AS t FROM s, c),
    g AS (SELECT sqrt(avg(t * t)) AS rms, greatest(0.9 * stddev_pop(t), 3 * median(t)) AS cut FROM t) SELECT {s6('sr')} AS scale_r, {s6('sb')} AS scale_b, {s6('rms')} AS rms, count(*) AS n, count(*) FILTER (t < cut) AS inliers FROM t, g GROUP BY sr, sb, rms""")
def color_fit_1round(spark, sf):
    from frameflow.operators.geometry import color_fit_round

    s = spark.read.parquet(f"{sf}/customer.parquet").selectExpr("1 + (c_custkey * 7 % 101) / 200.0D as rr", "0.8D + (c_custkey * 13 % 97) / 150.0D as rb")
    return color_fit_round(s, 0.9).select(*[r6(c).alias(c) for c in ("scale_r", "scale_b", "rms")], "n", "inliers")


FIT_ROUNDS = ", ".join(
    f"""m{k} AS (SELECT count(*) AS n, median(rr) AS sr, median(rb) AS sb FROM s{k}), t{k} AS (SELECT rr, rb, n, sqrt((rr - sr) ** 2 + (rb - sb) ** 2) AS t FROM s{k}, m{k}), g{k} AS (SELECT stddev_pop(t) AS sd, median(t) AS md FROM t{k}),
    s{k + 1} AS (SELECT rr, rb FROM t{k}, g{k} WHERE n < 5 OR sd < 1e-6 OR md < 1e-6 OR t < greatest(1.2 * sd, 3 * md))""" for k in range(10)
)


@query("color_fit", f"""WITH s0 AS (SELECT 1 + (c_custkey * 7 % 101) ** 3 / 200000.0::DOUBLE AS rr, 0.8 + (c_custkey * 13 % 97) ** 3 / 150000.0::DOUBLE AS rb FROM customer), {FIT_ROUNDS},
    f AS (SELECT median(rr) AS sr, median(rb) AS sb FROM s10) SELECT {s6('sr')} AS scale_r, {s6('sb')} AS scale_b, {s6('sqrt(avg((rr - sr) ** 2 + (rb - sb) ** 2))')} AS rms, count(*) AS inliers FROM s10, f GROUP BY sr, sb""")
def color_fit(spark, sf):
    from frameflow.operators.geometry import color_fit as fit

    s = spark.read.parquet(f"{sf}/customer.parquet").selectExpr("1 + power(c_custkey * 7 % 101, 3) / 200000.0D as rr", "0.8D + power(c_custkey * 13 % 97, 3) / 150000.0D as rb")
    return fit(s, 1.2).select(*[r6(c).alias(c) for c in ("scale_r", "scale_b", "rms")], "inliers")
