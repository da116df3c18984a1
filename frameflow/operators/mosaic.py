"""Mosaics: footprints and their overlaps, reprojection of panels, level offsets and blending."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameflow.functions import sky, sphere
from frameflow.operators import geometry as G
from frameflow.operators import kernels as K
from frameflow.operators import pixels as P


def footprint(w: sky.Wcs) -> list[tuple[float, float]]:
    """The sky positions of a panel's corners, counter-clockwise in (ra, dec)."""
    a, b, c, d = w.cd
    out = []
    for x, y in ((0, 0), (w.width - 1, 0), (w.width - 1, w.height - 1), (0, w.height - 1)):
        dx, dy = x - (w.crpix[0] - 1), y - (w.crpix[1] - 1)
        out.append((w.ra + (a * dx + b * dy) / math.cos(math.radians(w.dec)), w.dec + c * dx + d * dy))
    turn = sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(out, out[1:] + out[:1]))
    return out if turn > 0 else out[::-1]


def area(polygon: list[tuple[float, float]]) -> float:
    return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(polygon, polygon[1:] + polygon[:1]))) / 2 if len(polygon) > 2 else 0.0


def overlap_graph(panels: DataFrame, cell: float) -> DataFrame:
    """Edges a < b (area, fraction of the smaller) of panels (id, xs, ys: a convex polygon's corners): boxes that meet in
    cells of side ``cell`` are candidates, and the polygons are clipped in Arrow batches."""
    from frameflow.operators.match import overlap_graph as boxes

    found = boxes(panels.select("id", F.array_min("xs").alias("x0"), F.array_min("ys").alias("y0"), F.array_max("xs").alias("x1"), F.array_max("ys").alias("y1")), cell).select("a", "b")
    side = lambda n: panels.select(F.col("id").alias(n), F.col("xs").alias(f"{n}x"), F.col("ys").alias(f"{n}y"))
    pairs = found.join(side("a"), "a").join(side("b"), "b")

    def work(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                p, q = list(zip(r.ax, r.ay)), list(zip(r.bx, r.by))
                common = area(K.clip_polygon(p, q))
                if common > 0:
                    rows.append((r.a, r.b, common, common / min(area(p), area(q))))
            yield pd.DataFrame(rows, columns=["a", "b", "area", "fraction"])

    return pairs.mapInPandas(work, "a bigint, b bigint, area double, fraction double")


SOLUTION = "frame_id bigint, ra double, dec double, cd array<double>, crpix array<double>, width int, height int, channels int"


def solutions(spark: SparkSession, found: dict[int, sky.Wcs], channels: int = 1) -> DataFrame:
    """Plate solutions by frame as a table."""
    return spark.createDataFrame([(int(k), float(w.ra), float(w.dec), list(map(float, w.cd)), list(map(float, w.crpix)), int(w.width), int(w.height), channels) for k, w in found.items()], SOLUTION)


def _parts(prefix: str = "") -> tuple:
    """cd, crpix, ra and dec of a solution's columns, as ``sphere`` takes them."""
    c = lambda n: F.col(prefix + n)
    return [c("cd")[k] for k in range(4)], [c("crpix")[k] for k in range(2)], c("ra"), c("dec")


def sky_corners(panels: DataFrame) -> DataFrame:
    """Each panel's columns with its four corners' places, cra and cdec, on the sphere."""
    places = F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in ((F.lit(0), F.lit(0)), (F.col("width") - 1, F.lit(0)), (F.col("width") - 1, F.col("height") - 1), (F.lit(0), F.col("height") - 1))])
    at = panels.withColumn("corner", F.explode(places))
    ra, dec = sphere.pixel_to_sky(*_parts(), F.col("corner.x"), F.col("corner.y"))
    return at.withColumns({"cra": ra, "cdec": dec})


def output_wcs(panels: DataFrame, output_scale: float = 1.0) -> sky.Wcs:
    """A grid that holds all panels (solutions), at the first one's scale over ``output_scale``. It touches the sphere at
    the mean direction of their corners, so that neither right ascension 0 nor a pole is an edge. Two rows of sums and
    extremes come to the driver."""
    corners = sky_corners(panels)
    sums = corners.agg(*[F.sum(v).alias(n) for v, n in zip(sphere.unit_vector(F.col("cra"), F.col("cdec")), "xyz")], F.min_by(F.sqrt(F.abs(F.expr("cd[0] * cd[3] - cd[1] * cd[2]"))), "frame_id").alias("s")).first()
    if sums["s"] is None:
        raise ValueError("a mosaic needs a panel")
    ra, dec = math.degrees(math.atan2(sums["y"], sums["x"])) % 360, math.degrees(math.atan2(sums["z"], math.hypot(sums["x"], sums["y"])))
    xi, eta = sphere.project(F.col("cra"), F.col("cdec"), ra, dec)
    e = corners.select(xi.alias("xi"), eta.alias("eta")).agg(F.min("xi").alias("x0"), F.max("xi").alias("x1"), F.min("eta").alias("y0"), F.max("eta").alias("y1"), F.count_if(F.col("xi").isNull()).alias("hidden")).first()
    if e["hidden"]:
        raise ValueError("panels lie more than 90 degrees from the mosaic's centre")
    s = sums["s"] / output_scale
    size = lambda lo, hi: math.ceil(round((hi - lo) / s, 6)) + 1
    return sky.Wcs(ra, dec, (-s, 0.0, 0.0, s), (e["x1"] / s + 1, 1 - e["y0"] / s), size(e["x0"], e["x1"]), size(e["y0"], e["y1"]))


def source_places(places: DataFrame, target: tuple) -> DataFrame:
    """``places`` (x, y on the target's grid, and the columns of a source's solution) with sx and sy in the source, on the
    sphere; those outside the source's frame go. ``target``: cd, crpix, ra, dec, numbers or columns."""
    cd, crpix, ra0, dec0 = target
    ra, dec = sphere.pixel_to_sky(cd, crpix, ra0, dec0, F.col("x").cast("double"), F.col("y").cast("double"))
    seen = places.withColumns({"__ra": ra, "__dec": dec})
    sx, sy = sphere.sky_to_pixel(*_parts(), F.col("__ra"), F.col("__dec"))
    near = seen.withColumns({"sx": sx, "sy": sy}).drop("__ra", "__dec")
    return near.where("sx >= -1e-9 and sx <= width - 1 + 1e-9 and sy >= -1e-9 and sy <= height - 1 + 1e-9")


def reproject(pixels: DataFrame, panels: DataFrame, target: sky.Wcs, how: str | None = None) -> DataFrame:
    """All panels on the target's grid, bilinear, in one plan: frame_id, ch, y, x, v, and with ``how`` a weight (see
    ``edge_weight``). Only places inside a panel's frame have rows.

    A panel's corners bound its places, as straight lines stay straight between tangent planes; so a panel costs places
    by its own size and not by the mosaic's."""
    at = (list(target.cd), list(target.crpix), target.ra, target.dec)
    tx, ty = sphere.sky_to_pixel(*at, F.col("cra"), F.col("cdec"))
    named = ["ra", "dec", "cd", "crpix", "width", "height", "channels"]
    box = sky_corners(panels).withColumns({"tx": tx, "ty": ty}).groupBy("frame_id").agg(*[F.first(c).alias(c) for c in named], F.min("tx").alias("x0"), F.max("tx").alias("x1"), F.min("ty").alias("y0"), F.max("ty").alias("y1"))
    line = lambda lo, hi, n: F.sequence(F.greatest(F.floor(lo).cast("int") - 1, F.lit(0)), F.least(F.ceil(hi).cast("int") + 1, F.lit(n - 1)))
    rows = box.where(f"x1 >= -1 and y1 >= -1 and x0 <= {target.width} and y0 <= {target.height}").withColumn("y", F.explode(line("y0", "y1", target.height)))
    rows = rows.repartition("frame_id", "y").withColumn("x", F.explode(line("x0", "x1", target.width)))
    inside = source_places(rows.select("frame_id", "y", "x", *named), at)
    each = inside.withColumn("ch", F.explode(F.sequence(F.lit(0), F.col("channels") - 1)))
    out = G.warp(pixels, each.select("frame_id", "ch", "y", "x", "sx", "sy"), F.col("sx"), F.col("sy"))
    if how is None:
        return out
    return out.join(inside.select("frame_id", "y", "x", edge_weight(how).alias("weight")), ["frame_id", "y", "x"])


def edge_weight(how: str = "average"):
    """How far a place (sx, sy) lies inside its source's frame, as a share of the most; 'feather' takes a cosine of it."""
    d = F.least(F.col("sx") + 1, F.col("sy") + 1, F.col("width") - F.col("sx"), F.col("height") - F.col("sy")) / ((F.least("width", "height") + 1) / 2)
    d = F.least(F.greatest(d, F.lit(1e-6)), F.lit(1.0))
    return 0.5 * (1 - F.cos(d * math.pi)) if how == "feather" else d


def stitch(pixels: DataFrame, panels: DataFrame, output_scale: float = 1.0, blend: str = "average", level: bool = True, least: int = 10) -> tuple[DataFrame, sky.Wcs]:
    """Reproject, move each panel by an offset that evens out the overlaps' medians (the first is fixed), and blend."""
    target = output_wcs(panels, output_scale)
    moved = reproject(pixels, panels, target, blend)
    ids = [r[0] for r in panels.select("frame_id").orderBy("frame_id").collect()] if level else []  # a row a panel
    if len(ids) > 1:
        number = {k: n for n, k in enumerate(ids)}
        edges = [(number[r["a"]], number[r["b"]], r["offset"]) for r in P.overlap_medians(moved.where("ch = 0"), least).collect()]  # a row a pair of panels
        offsets = K.solve_offsets(len(ids), edges)
        shifts = moved.sparkSession.createDataFrame([(k, float(offsets[n])) for k, n in number.items()], "frame_id bigint, __shift double")
        moved = moved.join(shifts, "frame_id").withColumn("v", F.col("v") - F.col("__shift")).drop("__shift")
    out = P.weighted_stack(moved, ("ch", "y", "x"), F.col("weight"))
    return out.select(F.lit(0).cast("bigint").alias("frame_id"), "ch", "y", "x", "v"), target


def wcs_cards(w: sky.Wcs, panels: int | None = None) -> dict:
    """FITS cards of a solution; a mosaic says so and names its panels."""
    cards = {"CTYPE1": "RA---TAN", "CTYPE2": "DEC--TAN", "CRVAL1": w.ra, "CRVAL2": w.dec, "CRPIX1": w.crpix[0], "CRPIX2": w.crpix[1], "CD1_1": w.cd[0], "CD1_2": w.cd[1], "CD2_1": w.cd[2], "CD2_2": w.cd[3]}
    return cards | ({"MOSAIC": True, "NPANELS": panels} if panels else {})


def read_wcs(cards: dict) -> sky.Wcs | None:
    """The solution in a header; None without CTYPE1."""
    if "CTYPE1" not in cards:
        return None
    f = lambda k, d=0.0: float(cards.get(k, d))
    cd = (f("CD1_1", cards.get("CDELT1", 1)), f("CD1_2"), f("CD2_1"), f("CD2_2", cards.get("CDELT2", 1)))
    return sky.Wcs(f("CRVAL1"), f("CRVAL2"), cd, (f("CRPIX1", 1), f("CRPIX2", 1)), int(f("NAXIS1")), int(f("NAXIS2")))
