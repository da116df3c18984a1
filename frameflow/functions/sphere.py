"""The gnomonic (TAN) projection and its inverse as Catalyst expressions, good at the poles and across right ascension 0.

Angles are in degrees. Every argument may be a number or a column, so that solutions can come from a table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def column(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def separation(ra1, dec1, ra2, dec2) -> Column:
    """The angle between two places by half chords, exact for the smallest ones too."""
    ra1, dec1, ra2, dec2 = (F.radians(column(v)) for v in (ra1, dec1, ra2, dec2))
    half = lambda d: F.pow(F.sin(d / 2), F.lit(2.0))
    return F.degrees(2 * F.asin(F.sqrt(F.least(F.lit(1.0), half(dec2 - dec1) + F.cos(dec1) * F.cos(dec2) * half(ra2 - ra1)))))


def project(ra, dec, ra0, dec0) -> tuple[Column, Column]:
    """Standard coordinates (xi to the east, eta to the north) on the plane that touches the sphere at (ra0, dec0); null
    for places at 90 degrees or more from there, which the plane doesn't show."""
    da, d, d0 = F.radians(column(ra) - column(ra0)), F.radians(column(dec)), F.radians(column(dec0))
    depth = F.sin(d0) * F.sin(d) + F.cos(d0) * F.cos(d) * F.cos(da)
    shown = lambda v: F.when(depth > 1e-12, F.degrees(v / depth))
    return shown(F.cos(d) * F.sin(da)), shown(F.cos(d0) * F.sin(d) - F.sin(d0) * F.cos(d) * F.cos(da))


def deproject(xi, eta, ra0, dec0) -> tuple[Column, Column]:
    """The inverse of ``project``; right ascension from 0 up to 360."""
    x, y, d0 = F.radians(column(xi)), F.radians(column(eta)), F.radians(column(dec0))
    out = F.cos(d0) - y * F.sin(d0)
    ra = column(ra0) + F.degrees(F.atan2(x, out))
    return F.pmod(ra, F.lit(360.0)), F.degrees(F.atan2(y * F.cos(d0) + F.sin(d0), F.sqrt(x * x + out * out)))


def pixel_to_sky(cd: list, crpix: list, ra0, dec0, x: Column, y: Column) -> tuple[Column, Column]:
    """(ra, dec) of a pixel counted from 0; crpix counts from 1."""
    a, b, c, d = map(column, cd)
    dx, dy = x - (column(crpix[0]) - 1), y - (column(crpix[1]) - 1)
    return deproject(a * dx + b * dy, c * dx + d * dy, ra0, dec0)


def sky_to_pixel(cd: list, crpix: list, ra0, dec0, ra: Column, dec: Column) -> tuple[Column, Column]:
    """The inverse of ``pixel_to_sky``; null for the far side of the sky."""
    a, b, c, d = map(column, cd)
    xi, eta = project(ra, dec, ra0, dec0)
    det = a * d - b * c
    return (d * xi - b * eta) / det + (column(crpix[0]) - 1), (a * eta - c * xi) / det + (column(crpix[1]) - 1)


def unit_vector(ra: Column, dec: Column) -> list[Column]:
    a, d = F.radians(ra), F.radians(dec)
    return [F.cos(d) * F.cos(a), F.cos(d) * F.sin(a), F.sin(d)]
