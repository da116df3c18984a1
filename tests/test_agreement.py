"""Rules of the surveyed behaviour that the queries' SQL doesn't reach, and plans that hold at size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameflow import layout
from frameflow.functions import sky
from frameflow.operators import geometry, kernels, tables


@pytest.mark.parametrize(
    ("header", "want"),
    [
        ({"CRVAL1": "210.8", "CRVAL2": "54.35", "CTYPE1": "RA---TAN", "CTYPE2": "DEC--TAN"}, (210.8, 54.35, "crval", 0.85)),
        ({"CRVAL1": "100.0", "CRVAL2": "30.0"}, (100.0, 30.0, "crval", 0.85)),
        ({"CRVAL1": "10", "CRVAL2": "20", "CTYPE1": "DEC--TAN"}, (20.0, 10.0, "crval", 0.85)),
        ({"CRVAL1": "10", "CRVAL2": "20", "CTYPE1": "LINEAR", "CTYPE2": "ra---tan"}, (10.0, 20.0, "crval", 0.85)),
        ({"CRVAL1": "10", "CRVAL2": "20", "CTYPE1": "GLON"}, (10.0, 20.0, "crval", 0.70)),
        ({"OBJECT": " Dark "}, (0.0, 0.0, "none", 0.0)),
        ({"OBJECT": "m31"}, (10.68, 41.27, "object", 0.75)),
    ],
)
def test_coordinate_cascade(spark, header, want):
    objects = F.create_map(*[F.lit(x) if isinstance(x, str) else F.struct(F.lit(x[0]).alias("ra"), F.lit(x[1]).alias("dec")) for x in ("M31", (10.68, 41.27), "DARK", (1.0, 1.0))])
    cards = spark.createDataFrame([(header,)], "h map<string,string>")
    assert tuple(cards.select(sky.coordinates(F.col("h"), objects).alias("c")).select("c.*").first()) == want


def test_denoise_keeps_what_is_far_from_its_median():
    a = np.random.default_rng(2).normal(0.4, 0.02, (17, 23))
    a[4, 5], a[9, 9] = 3.0, 0.55
    noise = kernels.mad_sigma(kernels.laplacian(a)) / np.sqrt(20)
    padded = np.pad(a, 1, mode="symmetric")
    med = np.array([[np.median(padded[y : y + 3, x : x + 3]) for x in range(23)] for y in range(17)])
    off = np.abs(a - med)
    clean = np.where(off > 5 * noise, med, a)
    soft = 0.5 * kernels.gaussian(clean, 1) + 0.3 * kernels.gaussian(clean, 2) + 0.2 * kernels.gaussian(clean, 4)
    keep = np.clip(off / (3 * noise + 1e-10), 0, 1)
    assert np.allclose(kernels.denoise(a), clean * keep + soft * (1 - keep))


@pytest.mark.parametrize(("h", "w", "tile", "overlap"), [(10, 13, 4, 1), (7, 5, 4, 3), (3, 9, 5, 0), (4, 4, 4, 2)])
def test_pixels_to_tiles_by_arithmetic(spark, h, w, tile, overlap):
    px = spark.range(h * w).selectExpr("1 as frame_id", "0 as ch", f"cast(id div {w} as int) as y", f"cast(id % {w} as int) as x", "cast(id as double) as v")
    sizes = spark.createDataFrame([(1, h, w)], "frame_id int, h int, w int")
    got = {(r["ty"], r["tx"]): (r["y0"], r["x0"], r["h"], r["w"], r["data"]) for r in layout.pixels_to_tiles(px, sizes, tile, overlap).collect()}
    a = np.arange(h * w, dtype=float).reshape(h, w)
    grid = layout.tile_grid(sizes, tile, overlap).collect()
    assert got == {(r["ty"], r["tx"]): (r["y0"], r["x0"], r["th"], r["tw"], a[r["y0"] : r["y0"] + r["th"], r["x0"] : r["x0"] + r["tw"]].ravel().tolist()) for r in grid}


def test_half_flux_radius_joins_by_cells(spark):
    rng = np.random.default_rng(5)
    a = rng.random((40, 50))
    px = spark.createDataFrame([(1, y, x, float(a[y, x])) for y in range(40) for x in range(50)], "frame_id int, y int, x int, v double")
    stars = [(1, 1, 3.5, 4.25), (1, 2, 20.0, 25.0), (1, 3, 39.0, 49.0)]
    done = geometry.half_flux_radius(px, spark.createDataFrame(stars, "frame_id int, star_id int, sy double, sx double"), reach=6)
    yy, xx = np.mgrid[:40, :50]
    for r in done.collect():
        _, _, sy, sx = stars[r["star_id"] - 1]
        box = (np.abs(yy - sy) <= 6) & (np.abs(xx - sx) <= 6)
        d, v = np.sqrt((yy - sy) ** 2 + (xx - sx) ** 2)[box], a[box]
        order = np.argsort(d, kind="stable")
        cum = np.cumsum(v[order])
        assert abs(d[order][np.searchsorted(cum, v.sum() / 2)] - r["hfr"]) < 1e-9
    assert done.count() == 3


def test_selection_over_all_frames_ranks_rejected_rows_only(spark):
    rows = [(k, (k * 37 % 100) / 100) for k in range(300)]
    scored = spark.createDataFrame(rows, "idx int, score double")
    for share in (0.2, 0.5, 0.9):
        got = {r["idx"] for r in tables.select_frames(scored, 0.7, share).where("kept").collect()}
        want = {r["idx"] for r in tables.select_frames(scored.withColumn("g", F.lit(1)), 0.7, share, ["g"]).where("kept").collect()}
        assert got == want
    assert "SinglePartition" not in tables.select_frames(scored, 0.7, 0.2)._jdf.queryExecution().executedPlan().toString()
