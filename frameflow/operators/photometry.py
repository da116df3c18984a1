"""From frames to calibrated star tables: detection, aperture fluxes, catalog match and a zero point."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameflow.functions import curves, sky
from frameflow.layout import frames_to_pixels
from frameflow.operators import frames as K
from frameflow.operators import geometry as G
from frameflow.operators import match as M
from frameflow.operators.tables import magnitude_fit


def photometry(frames: DataFrame, w: sky.Wcs, catalog: DataFrame, radius: float = 3.0, tolerance: float = 5.0, one_to_one: bool = False, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """(stars, summary) of frames that share a solution; ``catalog`` has name, ra, dec, mag.

    stars: frame_id, star_id, x, y, ra, dec, instr_mag, catalog_mag, cal_mag, residual; the last three are null for stars
    without a match or in frames with fewer than ``least`` matches. summary: frame_id, n_matched, slope, intercept, r2.
    With ``one_to_one`` the nearest detection alone keeps a catalog star."""
    found = K.detect_stars(frames)
    spots = found.select("frame_id", "star_id", F.col("cy").alias("sy"), F.col("cx").alias("sx"))
    grey = frames_to_pixels(frames.select("frame_id", "h", "w", "c", "data")).groupBy("frame_id", "y", "x").agg(F.avg("v").alias("v"))
    ra, dec = sky.pixel_to_radec(w, F.col("sx"), F.col("sy"))
    stars = G.aperture_flux(grey, spots, radius).join(spots, ["frame_id", "star_id"]).select("frame_id", "star_id", F.col("sx").alias("x"), F.col("sy").alias("y"), ra.alias("ra"), dec.alias("dec"), curves.magnitude(F.col("flux")).alias("instr_mag"))
    px, py = sky.radec_to_pixel(w, F.col("ra"), F.col("dec"))
    seen = catalog.select(F.col("name").alias("id"), F.col("mag").alias("catalog_mag"), px.alias("x"), py.alias("y")).where(sky.in_frame(F.col("x"), F.col("y"), w.width, w.height))
    keyed = stars.select(F.struct("frame_id", "star_id").alias("id"), "x", "y")
    met = M.nearest_within(keyed, seen, tolerance).select("left_id.frame_id", "left_id.star_id", F.col("right_id").alias("id"), "distance")
    if one_to_one:
        first = F.row_number().over(Window.partitionBy("frame_id", "id").orderBy("distance", "star_id"))
        met = met.withColumn("__n", first).where("__n = 1").drop("__n")
    met = met.join(seen.select("id", "catalog_mag"), "id").select("frame_id", "star_id", "catalog_mag")
    pairs = stars.join(met, ["frame_id", "star_id"])
    fit = magnitude_fit(pairs.select("frame_id", F.col("instr_mag").alias("x"), F.col("catalog_mag").alias("y")), ["frame_id"]).where(F.col("n") >= least)
    done = stars.join(met, ["frame_id", "star_id"], "left").join(fit.select("frame_id", "slope", "intercept"), "frame_id", "left")
    cal = F.col("slope") * F.col("instr_mag") + F.col("intercept")
    out = done.select("frame_id", "star_id", "x", "y", "ra", "dec", "instr_mag", F.when(F.col("slope").isNotNull(), F.col("catalog_mag")).alias("catalog_mag"), F.when(F.col("catalog_mag").isNotNull(), cal).alias("cal_mag"), (F.col("catalog_mag") - cal).alias("residual"))
    summary = frames.select("frame_id").join(fit, "frame_id", "left").select("frame_id", F.coalesce("n", F.lit(0)).alias("n_matched"), "slope", "intercept", "r2")
    return out, summary


def fits_table(stars: DataFrame, r2: float) -> bytes:
    """One frame's star table as a FITS binary table with its NSTARS and RSQUARED cards."""
    from frameflow.sources.formats import fits_table_encode

    names = ("star_id", "ra", "dec", "instr_mag", "catalog_mag", "cal_mag", "residual")
    pdf = stars.select(*names).orderBy("star_id").toPandas()
    return fits_table_encode([(n.upper(), pdf[n].to_numpy("int32" if n == "star_id" else "float64")) for n in names], {"NSTARS": len(pdf), "RSQUARED": float(r2)})


def write_psf_csv(stars: DataFrame, folder: str, digits: int = 4) -> None:
    """PSF rows as CSV, numbers rounded half to even."""
    kinds = dict(stars.dtypes)
    stars.select(*[F.bround(c, digits).alias(c) if kinds[c] == "double" else c for c in stars.columns]).write.mode("overwrite").option("header", "true").csv(folder)
