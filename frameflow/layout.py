"""The three physical layouts of a frame and the steps between them.

L1: a row a frame (frame_id, h, w, c, data array<double> row-major by (y, x, ch)); L2: a row a pixel (frame_id, ch, y, x,
v); L3: a row a tile with a halo (frame_id, ch, ty, tx, y0, x0, h, w, data). L2 is what Catalyst can work on; L1 and L3
feed NumPy kernels in Arrow batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIXEL = ("frame_id", "ch", "y", "x")


def frames_to_pixels(frames: DataFrame) -> DataFrame:
    """L1 to L2."""
    keep = [c for c in frames.columns if c not in ("data", "h", "w", "c")]
    return frames.select(*keep, "w", "c", F.posexplode("data").alias("i", "v")).select(
        *keep, (F.col("i") % F.col("c")).alias("ch"), F.expr("i div (w * c)").cast("int").alias("y"), F.expr("(i div c) % w").cast("int").alias("x"), F.col("v").cast("double").alias("v")
    )


def pixels_to_frames(pixels: DataFrame) -> DataFrame:
    """L2 to L1. Absent pixels aren't filled: every frame must be dense."""
    made = pixels.groupBy("frame_id").agg(
        (F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"), (F.max("ch") + 1).alias("c"), F.array_sort(F.collect_list(F.struct("y", "x", "ch", "v"))).alias("p")
    )
    return made.select("frame_id", "h", "w", "c", F.transform("p", lambda p: p["v"]).alias("data"))


def vectors_to_pixels(vectors: DataFrame, side: int = 8) -> DataFrame:
    """Vectors of side * side floats as mono frames, with their label as target."""
    return vectors.select("vec_id", "label", F.posexplode("embedding").alias("i", "v")).select(
        F.col("vec_id").alias("frame_id"), F.col("label").alias("target"), F.lit(0).alias("ch"), F.expr(f"i div {side}").cast("int").alias("y"), (F.col("i") % side).alias("x"), F.col("v").cast("double").alias("v")
    )


def tile_grid(sizes: DataFrame, tile: int, overlap: int) -> DataFrame:
    """Per row (frame_id, h, w): its tiles ty, tx with origin y0, x0 and size th, tw. Tiles step by tile - overlap and the
    last one slides back to end with the frame; smaller frames are one tile."""
    if not 0 <= overlap < tile:
        raise ValueError("overlap must be at least 0 and below the tile's side")
    step = tile - overlap
    count = lambda n: F.greatest(F.lit(1), F.ceil((F.col(n) - overlap) / F.lit(step))).cast("int")
    ys = sizes.select("*", F.explode(F.sequence(F.lit(0), count("h") - 1)).alias("ty"))
    both = ys.select("*", F.explode(F.sequence(F.lit(0), count("w") - 1)).alias("tx"))
    start = lambda k, n: F.greatest(F.lit(0), F.least(F.col(k) * step, F.col(n) - tile))
    return both.select("*", start("ty", "h").alias("y0"), start("tx", "w").alias("x0"), F.least(F.lit(tile), F.col("h")).alias("th"), F.least(F.lit(tile), F.col("w")).alias("tw"))


def pixels_to_tiles(pixels: DataFrame, sizes: DataFrame, tile: int, overlap: int) -> DataFrame:
    """L2 to L3: each pixel goes to every tile that holds it, by arithmetic on its place: those whose step begins at most
    a tile before it, and the last one, which slides back. A frame's size is all that a pixel is joined with."""
    if not 0 <= overlap < tile:
        raise ValueError("overlap must be at least 0 and below the tile's side")
    step = tile - overlap
    start = lambda k, n: F.greatest(F.lit(0), F.least(k * step, F.col(n) - tile))

    def held(c: str, n: str):
        last = F.greatest(F.lit(1), F.ceil((F.col(n) - overlap) / F.lit(step))).cast("int") - 1
        first = F.greatest(F.lit(0), F.ceil((F.col(c) - tile + 1) / F.lit(step)).cast("int"))
        upto = F.least(last, F.floor(F.col(c) / step).cast("int"))
        some = F.when(first <= upto, F.sequence(first, upto)).otherwise(F.array().cast("array<int>"))
        return F.filter(F.array_union(some, F.array(last)), lambda k: (start(k, n) <= F.col(c)) & (F.col(c) < start(k, n) + tile))

    sized = pixels.join(sizes.select("frame_id", "h", "w"), "frame_id")
    near = sized.withColumn("ty", F.explode(held("y", "h"))).withColumn("tx", F.explode(held("x", "w")))
    near = near.withColumns({"y0": start(F.col("ty"), "h"), "x0": start(F.col("tx"), "w"), "th": F.least(F.lit(tile), F.col("h")), "tw": F.least(F.lit(tile), F.col("w"))})
    made = near.groupBy("frame_id", "ch", "ty", "tx", "y0", "x0", "th", "tw").agg(F.array_sort(F.collect_list(F.struct("y", "x", "v"))).alias("p"))
    return made.select("frame_id", "ch", "ty", "tx", "y0", "x0", F.col("th").alias("h"), F.col("tw").alias("w"), F.transform("p", lambda p: p["v"]).alias("data"))
