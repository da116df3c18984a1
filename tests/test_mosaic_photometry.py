import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameflow.functions import sky, sphere
from frameflow.operators import mosaic, photometry
from frameflow.sources.formats import fits_decode, fits_encode, fits_table_decode

S = 1.0 / 3600


def wcs(ra, dec, w=24, h=20):
    return sky.Wcs(ra, dec, (-S, 0.0, 0.0, S), ((w + 1) / 2, (h + 1) / 2), w, h)


def plane(spark, panels, centre, lifts):
    """Panels of one plane over the tangent plane at ``centre``, each lifted by a constant."""
    rows = []
    for k, (w, lift) in enumerate(zip(panels, lifts)):
        grid = spark.range(w.width * w.height).select((F.col("id") % w.width).cast("double").alias("x"), F.floor(F.col("id") / w.width).cast("double").alias("y"))
        ra, dec = sphere.pixel_to_sky(list(w.cd), list(w.crpix), w.ra, w.dec, F.col("x"), F.col("y"))
        xi, eta = sphere.project(ra, dec, *centre)
        rows.append(grid.select(F.lit(k).cast("bigint").alias("frame_id"), F.lit(0).alias("ch"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), (xi / S * 0.1 + eta / S * 0.2 + lift).alias("v")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@pytest.mark.parametrize("centre", [(10.0, 0.0), (0.0, 20.0), (359.9995, -35.0), (77.0, 89.9999), (5.0, -90.0)])
def test_panels_become_one_plane(spark, centre):
    """The second panel lifted by a constant and turned, around right ascension 0 and at the poles too, comes out as the
    first continues."""
    ra, dec = spark.range(1).select(*sphere.deproject(F.lit(-12 * S), F.lit(3 * S), *centre)).first()
    turned = S * math.cos(0.3), S * math.sin(0.3)
    panels = [wcs(*centre), sky.Wcs(ra, dec, (-turned[0], turned[1], turned[1], turned[0]), (12.5, 10.5), 24, 20)]
    found = mosaic.solutions(spark, dict(enumerate(panels)))
    out, t = mosaic.stitch(plane(spark, panels, centre, (0.0, 5.0)), found)
    at = out.select("*", *[v.alias(n) for v, n in zip(sphere.pixel_to_sky(list(t.cd), list(t.crpix), t.ra, t.dec, F.col("x").cast("double"), F.col("y").cast("double")), ("ra", "dec"))])
    xi, eta = sphere.project(F.col("ra"), F.col("dec"), *centre)
    rows = at.select("v", (xi / S * 0.1 + eta / S * 0.2).alias("want")).collect()
    assert len(rows) > 500 and max(abs(r["v"] - r["want"]) for r in rows) < 2e-3
    assert 24 <= t.width < 70 and 20 <= t.height < 70


def test_mosaic_is_one_plan_without_products(spark):
    panels = [wcs(0.0, 20.0), wcs(0.001, 20.0), wcs(0.002, 20.0)]
    found = mosaic.solutions(spark, dict(enumerate(panels)))
    px = plane(spark, panels, (0.0, 20.0), (0, 0, 0))
    plan = mosaic.reproject(px, found, mosaic.output_wcs(found), "feather")._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Python" not in plan
    with pytest.raises(ValueError, match="90 degrees"):
        mosaic.output_wcs(mosaic.solutions(spark, {0: wcs(0.0, 0.0), 1: wcs(0.0, 0.1), 2: wcs(170.0, 0.0)}))


def test_footprints_overlap(spark):
    a, b = mosaic.footprint(wcs(10.0, 0.0)), mosaic.footprint(wcs(10.0 - 12 * S, 0.0))
    rows = [(k, [p[0] for p in f], [p[1] for p in f]) for k, f in enumerate((a, b, mosaic.footprint(wcs(50.0, 5.0))))]
    edges = mosaic.overlap_graph(spark.createDataFrame(rows, "id bigint, xs array<double>, ys array<double>"), 0.01).collect()
    assert [(r["a"], r["b"]) for r in edges] == [(0, 1)] and abs(edges[0]["fraction"] - 11 / 23) < 1e-6


def test_wcs_cards_round_trip():
    w = wcs(123.4, -5.6)
    cards, _ = fits_decode(fits_encode(np.zeros((20, 24), np.float32), mosaic.wcs_cards(w, 3)))
    assert mosaic.read_wcs(cards) == w and cards["NPANELS"] == 3 and mosaic.read_wcs({}) is None


def test_photometry_recovers_the_zero_point(spark):
    w, rng = wcs(180.0, 45.0, 96, 96), np.random.default_rng(3)
    y, x = np.mgrid[:96, :96]
    a, stars = np.full((96, 96), 0.2), []
    for k, (cy, cx) in enumerate([(20, 20), (20, 70), (48, 45), (75, 22), (72, 74)]):
        amp = 2.0 + k
        a += amp * np.exp(-((y - cy) ** 2 + (x - cx) ** 2) / (2 * 1.5**2))
        ra = 180 - S * (cx - 47.5) / np.cos(np.radians(45))
        stars.append((f"s{k}", float(ra), float(45 + S * (cy - 47.5)), float(20 - 2.5 * np.log10(amp))))
    f = spark.createDataFrame([(1, 96, 96, 1, (a + rng.normal(0, 1e-4, a.shape)).ravel().tolist())], "frame_id bigint, h int, w int, c int, data array<double>")
    got, summary = photometry.photometry(f, w, spark.createDataFrame(stars, "name string, ra double, dec double, mag double"), one_to_one=True)
    s, rows = summary.first(), got.collect()
    assert s["n_matched"] == 5 and 0.2 < s["slope"] < 1.0 and s["r2"] > 0.7
    assert sum(r["cal_mag"] is not None for r in rows) == 5
    cards, cols = fits_table_decode(photometry.fits_table(got.where("cal_mag is not null"), s["r2"]))
    assert cards["NSTARS"] == 5 and len(cols["RA"]) == 5
    few, none = photometry.photometry(f, w, spark.createDataFrame(stars[:1], "name string, ra double, dec double, mag double"))
    assert none.first()["n_matched"] == 0 and all(r["cal_mag"] is None for r in few.collect())
