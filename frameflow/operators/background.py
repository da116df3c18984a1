"""Polynomial background models inside Spark: robust tile values, least squares by groups, and the surface as an expression.

The least-squares sums are over products of Legendre polynomials on places scaled to -1 .. 1, which spans the same surfaces
as powers of y and x but keeps the normal equations well-conditioned. A frame's equations are a small matrix in one row, and
are solved there by elimination; so any number of frames is fitted by two aggregations, and nothing comes to the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameflow.operators import pixels as P
from frameflow.operators import stencil as S

PLANE = ["frame_id", "ch"]


def legendre(t: Column, degree: int) -> list[Column]:
    out = [F.lit(1.0), t]
    for n in range(1, degree):
        out.append(((2 * n + 1) * t * out[n] - n * out[n - 1]) / (n + 1))
    return out[: degree + 1]


def basis(y: Column, x: Column, h: Column, w: Column, degree: int) -> list[Column]:
    """The products of a total degree of at most ``degree``; y and x may lie anywhere in a frame of h by w."""
    scaled = lambda v, n: 2 * v / F.greatest(n - 1, F.lit(1)) - 1
    py, px = legendre(scaled(y, h), degree), legendre(scaled(x, w), degree)
    return [py[a] * px[b] for a in range(degree + 1) for b in range(degree + 1 - a)]


def solve(equations: Column, n: int, least: float = 1e-10) -> Column:
    """The solution of n symmetric equations, an array of n rows with n coefficients and a right side each. An unknown whose
    pivot is below ``least`` times the first one's diagonal is 0: the others are solved without it."""
    size = F.abs(equations[0][0])

    def step(m: Column, k: Column) -> Column:
        row = F.element_at(m, k + 1)
        pivot = F.element_at(row, k + 1)
        own = F.transform(row, lambda v: F.when(F.abs(pivot) > size * least, v / pivot).otherwise(0.0))
        return F.transform(m, lambda r, i: F.when(i == k, own).otherwise(F.zip_with(r, own, lambda a, b: a - b * F.element_at(r, k + 1))))

    return F.transform(F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), equations, step), lambda r: r[n])


def tile_samples(pixels: DataFrame, tile: int = 64, share: float = 0.8, sigma: float = 2.5, soften: int = 5) -> DataFrame:
    """(frame_id, ch, h, w, y, x, v): the robust value of each tile, at its middle, after a median filter of side ``soften``.
    A plane with no tile of at least 4 values has one row, with nulls."""
    sizes = pixels.groupBy(*PLANE).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    values = P.tile_values(S.median_filter(pixels, soften) if soften else pixels, tile, share, sigma).where("v is not null")
    middle = lambda k, n: (F.col(k) * tile + F.least((F.col(k) + 1) * tile, F.col(n))) / 2
    return sizes.join(values, PLANE, "left").select(*PLANE, "h", "w", middle("ty", "h").alias("y"), middle("tx", "w").alias("x"), "v")


def fit_surface(samples: DataFrame, degree: int = 3) -> DataFrame:
    """(frame_id, ch, h, w, n, terms): least squares over each plane's samples; terms is null below 4 of them."""
    b = basis(F.col("y"), F.col("x"), F.col("h"), F.col("w"), degree)
    n = len(b)
    # each product once; the matrix is symmetric
    sums = [F.sum(F.when(F.col("v").isNotNull(), b[i] * b[j])).alias(f"m{i}_{j}") for i in range(n) for j in range(i, n)] + [F.sum(b[i] * F.col("v")).alias(f"r{i}") for i in range(n)]
    fitted = samples.groupBy(*PLANE, "h", "w").agg(F.count("v").alias("n"), *sums)
    rows = F.array(*[F.array(*[F.col(f"m{min(i, j)}_{max(i, j)}") for j in range(n)], F.col(f"r{i}")) for i in range(n)])
    return fitted.select(*PLANE, "h", "w", "n", F.when(F.col("n") >= 4, solve(rows, n)).alias("terms"))


def polynomial_background(pixels: DataFrame, tile: int = 64, degree: int = 3, share: float = 0.8, sigma: float = 2.5, soften: int = 5) -> DataFrame:
    """(frame_id, ch, y, x, bg): each plane's background as a polynomial in y and x of a total degree of at most ``degree``;
    with fewer than 4 samples it is the plane's median. The coefficients are a row a plane, so Spark sends them to the
    pixels under its own threshold, and joins beyond it."""
    fitted = fit_surface(tile_samples(pixels, tile, share, sigma, soften), degree)
    b = basis(F.col("y"), F.col("x"), F.col("h"), F.col("w"), degree)
    value = sum((F.col("terms")[i] * b[i] for i in range(len(b))), F.lit(0.0))
    flat = pixels.join(fitted.where("n < 4").select(*PLANE), PLANE, "left_semi").groupBy(*PLANE).agg(F.median("v").alias("__flat"))
    return pixels.join(fitted.join(flat, PLANE, "left"), PLANE).select(*PLANE, "y", "x", F.when(F.col("n") >= 4, value).otherwise(F.col("__flat")).alias("bg"))
