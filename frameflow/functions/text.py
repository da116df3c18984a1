"""String, path, header and format functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words of IMAGETYP by frame type. "bias frame" belongs to the darks.
DARK_WORDS = ("dark", "dark frame", "darkframe", "bias frame", "biasframe")
FLAT_WORDS = ("flat", "flat field", "flatfield", "flat frame", "flatframe")
BIAS_WORDS = ("bias", "offset", "zero")
LIGHT_WORDS = ("light", "light frame", "lightframe", "science")

# Header keys of the metadata panel, the first present key of a group counts.
HEADER_GROUPS = (
    ("OBJECT",), ("DATE-OBS", "DATE_OBS"), ("EXPTIME", "EXPOSURE"), ("FILTER",), ("TELESCOP",), ("INSTRUME",), ("FOCALLEN",), ("XPIXSZ", "PIXSIZE1"),
    ("RA", "OBJCTRA"), ("DEC", "OBJCTDEC"), ("GAIN",), ("CCD-TEMP", "CCD_TEMP"), ("XBINNING",), ("YBINNING",), ("NAXIS1",), ("NAXIS2",),
)


def classify_frame_type(word: Column) -> Column:
    """dark, flat, bias, light or unknown; null is unknown."""
    w = F.lower(F.trim(word))
    return F.when(w.isin(*DARK_WORDS), "dark").when(w.isin(*FLAT_WORDS), "flat").when(w.isin(*BIAS_WORDS), "bias").when(w.isin(*LIGHT_WORDS), "light").otherwise("unknown")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """The lower-cased last suffix with its dot; empty where there is none."""
    return F.lower(F.regexp_extract(basename(path), r"[^.](\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=[^.])\.[^.]+$", "")


def safe_name(name: Column, length: int = 64) -> Column:
    """Letters, digits, space, underscore, hyphen and dot stay, others become an underscore; cut, then trimmed."""
    return F.trim(F.substring(F.regexp_replace(name, r"[^\p{L}\p{N} _.-]", "_"), 1, length))


def hms(seconds: Column) -> Column:
    """As in 1h 23m 45s; hours are left out at zero, minutes at zero without hours."""
    s = F.floor(seconds).cast("bigint")
    h, m = F.floor(s / 3600).cast("bigint"), F.floor(s % 3600 / 60).cast("bigint")
    return F.concat(F.when(h > 0, F.concat(h, F.lit("h "))).otherwise(""), F.when((h > 0) | (m > 0), F.concat(m, F.lit("m "))).otherwise(""), s % 60, F.lit("s"))


def header_metadata(header: Column) -> Column:
    """exposure, gain_iso, temperature, date_obs and dimensions from a map of header cards; other cards go to extra."""
    get = lambda *names: F.coalesce(*[F.element_at(header, n) for n in names])
    axes = F.coalesce(F.element_at(header, "NAXIS").cast("int"), F.lit(0))
    size = lambda n, least: F.when(axes >= least, F.coalesce(F.element_at(header, n).cast("int"), F.lit(1)))
    taken = ("EXPTIME", "EXPOSURE", "GAIN", "ISO", "CCD-TEMP", "DATE-OBS")
    return F.struct(
        get("EXPTIME", "EXPOSURE").try_cast("double").alias("exposure"), get("GAIN", "ISO").try_cast("double").cast("int").alias("gain_iso"), get("CCD-TEMP").try_cast("double").alias("temperature"), F.nullif(get("DATE-OBS"), F.lit("")).alias("date_obs"),
        F.coalesce(size("NAXIS1", 2), F.lit(0)).alias("width"), F.coalesce(size("NAXIS2", 2), F.lit(0)).alias("height"), F.when(axes < 2, 0).otherwise(F.coalesce(size("NAXIS3", 3), F.lit(1))).alias("channels"),
        F.map_filter(header, lambda k, _: ~k.isin(*taken) & ~k.rlike("^(SIMPLE|BITPIX|NAXIS|EXTEND)") & (k != "")).alias("extra"),
    )


def header_panel(header: Column) -> Column:
    """A map with one trimmed value for each alias group that has any."""
    pairs = [F.struct(F.lit(g[0]).alias("k"), F.trim(F.coalesce(*[F.element_at(header, n) for n in g])).alias("v")) for g in HEADER_GROUPS]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["v"].isNotNull()))


def fixed(x: Column, places: int) -> Column:
    """``places`` decimals (5 at most) of the double's exact value, halves to even, as C's printf has them; format_string
    rounds its shortest decimal text instead."""
    scale, size = 10**places, F.abs(x)
    high = size * 134217729.0 - (size * 134217729.0 - size)  # the upper half of the bits, so that both products are exact
    whole = F.floor(size * scale)
    past = (high * scale - whole - 0.5) + (size - high) * scale  # its sign is exact
    n = F.when(past > 0, whole + 1).when(past < 0, whole).otherwise(whole + whole % 2)
    text = F.concat(F.when(x.cast("string").startswith("-"), "-").otherwise(""), F.floor(n / scale).cast("string"), F.lit("."), F.lpad((n % scale).cast("string"), places, "0"))
    return F.when(size < 9e15 / scale, text).otherwise(F.format_string(f"%.{places}f", x))


def cache_key(catalog: Column, ra: Column, dec: Column, radius: Column, extra: Column) -> Column:
    """SHA-256 of the query's parts; coordinates to 4 decimals and the radius to 5."""
    return F.sha2(F.concat_ws("|", catalog, fixed(ra, 4), fixed(dec, 4), fixed(radius, 5), extra), 256)


def machine_id(host: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.substring(F.sha2(host, 256), 1, 32))
