"""Sky coordinates as Catalyst expressions; angles in degrees unless a name says otherwise."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Wcs:
    """A linear plate solution; crpix counts from 1."""

    ra: float
    dec: float
    cd: tuple[float, float, float, float]
    crpix: tuple[float, float]
    width: int = 0
    height: int = 0


def pixel_to_radec(w: Wcs, x: Column, y: Column) -> tuple[Column, Column]:
    a, b, c, d = map(F.lit, w.cd)
    dx, dy = x - (w.crpix[0] - 1), y - (w.crpix[1] - 1)
    return F.pmod(F.lit(w.ra) + (a * dx + b * dy) / F.cos(F.radians(F.lit(w.dec))), F.lit(360.0)), F.lit(w.dec) + c * dx + d * dy


def radec_to_pixel(w: Wcs, ra: Column, dec: Column) -> tuple[Column, Column]:
    """The inverse of ``pixel_to_radec``; right ascension differences wrap to +-180 degrees."""
    a, b, c, d = w.cd
    det = a * d - b * c
    dra = (F.pmod(ra - w.ra + 180.0, F.lit(360.0)) - 180.0) * F.cos(F.radians(F.lit(w.dec)))
    ddec = dec - w.dec
    return (F.lit(d) * dra - F.lit(b) * ddec) / det + (w.crpix[0] - 1), (F.lit(a) * ddec - F.lit(c) * dra) / det + (w.crpix[1] - 1)


def angular_separation(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """In degrees, by the cosine rule, clamped."""
    d1, d2 = F.radians(dec1), F.radians(dec2)
    cosine = F.sin(d1) * F.sin(d2) + F.cos(d1) * F.cos(d2) * F.cos(F.radians(ra1 - ra2))
    return F.degrees(F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0))))


def cd_scale(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Arc seconds a pixel."""
    return F.sqrt(F.abs(a * d - b * c)) * 3600


def cd_rotation(a: Column, b: Column) -> Column:
    return F.degrees(F.atan2(b, a))


def plate_scale(pixel_um: Column, focal_mm: Column) -> Column:
    return pixel_um / focal_mm * 206.265


def make_cd(dx: float, dy: float, rotation: Column) -> list[Column]:
    c, s = F.cos(F.radians(rotation)), F.sin(F.radians(rotation))
    return [c * dx, s * -dy, s * dx, c * dy]


def parse_ra(text: Column) -> Column:
    """Hours, minutes and optional seconds, by blanks or colons, to degrees; null where it isn't that."""
    p = F.split(F.trim(F.regexp_replace(text, ":", " ")), r"\s+")
    part = lambda k: F.get(p, k).try_cast("double")
    seconds = F.when(F.size(p) > 2, part(2)).otherwise(0.0)
    return F.when(F.size(p) >= 2, (part(0) + part(1) / 60 + seconds / 3600) * 15)


DEC = r"^([+-]?\d+)\s+(\d+\.?\d*)\s*(\d+\.?\d*)?"


def parse_dec(text: Column) -> Column:
    """Signed degrees, minutes and optional seconds; the sign counts for -0 too."""
    t = F.trim(F.regexp_replace(text, ":", " "))
    part = lambda k: F.regexp_extract(t, DEC, k).try_cast("double")
    value = F.abs(part(1)) + part(2) / 60 + F.coalesce(part(3), F.lit(0.0)) / 3600
    return F.when(t.rlike(DEC), F.when(t.startswith("-"), -value).otherwise(value))


def coordinates(header: Column, objects: Column | None = None) -> Column:
    """The best of a header's coordinates: (ra, dec, method, confidence), down to 'none'."""
    h = lambda k: F.element_at(header, k)
    kind = "struct<ra:double,dec:double,method:string,confidence:double>"

    def offer(ra: Column, dec: Column, method: str, confidence: float | Column) -> Column:
        confidence = F.lit(confidence) if isinstance(confidence, float) else confidence
        return F.when(ra.isNotNull() & dec.isNotNull(), F.struct(ra.alias("ra"), dec.alias("dec"), F.lit(method).alias("method"), confidence.alias("confidence"))).cast(kind)

    either = lambda k, parse: F.coalesce(h(k).try_cast("double"), parse(h(k)))
    kinds = [F.upper(F.coalesce(h(k), F.lit(""))) for k in ("CTYPE1", "CTYPE2")]
    plain = kinds[0].contains("RA") | kinds[1].contains("RA") | (kinds[0] == "") & (kinds[1] == "")
    turned = ~plain & kinds[0].contains("DEC")  # declination first
    crval = [h(k).try_cast("double") for k in ("CRVAL1", "CRVAL2")]
    offers = [
        offer(parse_ra(h("OBJCTRA")), parse_dec(h("OBJCTDEC")), "objctra_dec", 0.95),
        offer(either("RA", parse_ra), either("DEC", parse_dec), "ra_dec", 0.90),
        offer(F.when(turned, crval[1]).otherwise(crval[0]), F.when(turned, crval[0]).otherwise(crval[1]), "crval", F.when(plain | turned, 0.85).otherwise(0.70)),
    ]
    if objects is not None:
        name = F.upper(F.trim(h("OBJECT")))
        found = F.when(~name.isin("", "LIGHT", "DARK", "FLAT", "BIAS"), F.element_at(objects, name))
        offers.append(offer(found["ra"], found["dec"], "object", 0.75))
    return F.coalesce(*offers, F.struct(F.lit(0.0).alias("ra"), F.lit(0.0).alias("dec"), F.lit("none").alias("method"), F.lit(0.0).alias("confidence")).cast(kind))


def _sexagesimal(tenths: Column, form: str) -> Column:
    """Whole units, minutes and seconds of a number of tenths of a second; so no part ever prints as 60."""
    whole = lambda n: F.floor(tenths / n)
    return F.format_string(form, whole(36000), whole(600) % 60, (tenths % 600) / 10)


def format_ra(ra: Column) -> Column:
    """Hours, minutes and seconds to a tenth; what rounds up to 24 hours is 0."""
    return _sexagesimal(F.floor(F.pmod(ra, F.lit(360.0)) * 2400 + 0.5) % 864000, "%02dh%02dm%04.1fs")


def format_dec(dec: Column) -> Column:
    return F.concat(F.when(dec >= 0, "+").otherwise("-"), _sexagesimal(F.floor(F.abs(dec) * 36000 + 0.5), "%02d°%02d'%04.1f\""))


def header_hint(header: Column) -> Column:
    """(ra, dec) where a header has both as plain numbers: from RA, OBJCTRA or CRVAL1 and DEC, OBJCTDEC or CRVAL2, whichever
    comes first with a value other than an empty text or zero; else null."""
    h = lambda k: F.element_at(header, k)
    told = lambda k: F.when((F.length(h(k)) > 0) & ~F.coalesce(h(k).try_cast("double") == 0, F.lit(False)), h(k))
    ra, dec = (F.coalesce(told(a), told(b), h(c)).try_cast("double") for a, b, c in (("RA", "OBJCTRA", "CRVAL1"), ("DEC", "OBJCTDEC", "CRVAL2")))
    return F.when(ra.isNotNull() & dec.isNotNull(), F.struct(ra.alias("ra"), dec.alias("dec")))


# The steps that a coordinate grid may have.
GRID_STEPS = (0.1, 0.25, 0.5, 1.0, 2.0, 5.0, 10.0, 15.0, 30.0)


def grid_step(span: Column, lines: int = 12) -> Column:
    """The smallest step that needs at most ``lines`` lines."""
    out = F.lit(GRID_STEPS[-1])
    for step in reversed(GRID_STEPS):
        out = F.when(span / step <= lines, step).otherwise(out)
    return out


def recommended_catalog(fov: Column) -> Column:
    return F.when(fov > 2, "H18").otherwise("D50")


def in_frame(x: Column, y: Column, w: int, h: int, margin: float = 0.0) -> Column:
    """Half-open bounds, wider by a share of the frame."""
    return (x >= -margin * w) & (x < w * (1 + margin)) & (y >= -margin * h) & (y < h * (1 + margin))
