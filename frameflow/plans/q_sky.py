"""Queries over sky coordinates."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from frameflow.functions import sky, sphere
from frameflow.operators import match
from frameflow.plans.fixtures import SKY, r6, s6
from frameflow.plans.fixtures import sky as sky_table
from frameflow.plans.registry import query

_C, _S = math.cos(math.radians(10.0)) * 1.5 / 3600, math.sin(math.radians(10.0)) * 1.5 / 3600
WCS = sky.Wcs(180.0, 45.0, (-_C, _S, _S, _C), (32.5, 32.5), 4000, 3000)
#: The stand-in's positions lie all over the sky, so the camera that sees some of them is wide.
_K = 400.0
WIDE = sky.Wcs(180.0, 45.0, (-_C * _K, _S * _K, _S * _K, _C * _K), (100.5, 75.5), 200, 150)


def to_pixel(w: sky.Wcs, ra: str = "ra", dec: str = "dec") -> tuple[str, str]:
    a, b, c, d = w.cd
    det = a * d - b * c
    dra = f"((fmod(fmod({ra} - {w.ra!r} + 180.0, 360.0) + 360.0, 360.0) - 180.0) * cos(radians({w.dec!r})))"
    dd = f"({dec} - {w.dec!r})"
    return f"(({d!r} * {dra} - {b!r} * {dd}) / {det!r} + {w.crpix[0] - 1!r})", f"(({a!r} * {dd} - {c!r} * {dra}) / {det!r} + {w.crpix[1] - 1!r})"


X, Y = to_pixel(WIDE)
PROJECTED = f"{SKY}, proj AS (SELECT k, ra, dec, mag, {X} AS px, {Y} AS py FROM sky)"


def projected(spark, sf):
    x, y = sky.radec_to_pixel(WIDE, F.col("ra"), F.col("dec"))
    return sky_table(spark, sf).select("k", "ra", "dec", "mag", x.alias("px"), y.alias("py"))


@query("pixel_to_radec", f"""SELECT p_partkey AS k, {s6(f"fmod({WCS.ra!r} + ({WCS.cd[0]!r} * dx + {WCS.cd[1]!r} * dy) / cos(radians({WCS.dec!r})) + 360.0, 360.0)")} AS ra, {s6(f"{WCS.dec!r} + {WCS.cd[2]!r} * dx + {WCS.cd[3]!r} * dy")} AS dec
    FROM (SELECT p_partkey, p_partkey % 64 - {WCS.crpix[0] - 1!r} AS dx, p_partkey % 48 - {WCS.crpix[1] - 1!r} AS dy FROM part)""")
def pixel_to_radec(spark, sf):
    ra, dec = sky.pixel_to_radec(WCS, F.col("p_partkey") % 64, F.col("p_partkey") % 48)
    return spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("k"), r6(ra).alias("ra"), r6(dec).alias("dec"))


@query("cd_scale_rotation", f"""SELECT k, {s6('sqrt(abs(a * d - b * c)) * 3600')} AS scale, {s6('degrees(atan2(b, a))')} AS rotation FROM (SELECT c_custkey AS k, c_acctbal / 1e6 AS a, (c_custkey % 17 - 8) / 1e5 AS b, (c_custkey % 13 - 6) / 1e5 AS c, -c_acctbal / 1e6 AS d FROM customer)""")
def cd_scale_rotation(spark, sf):
    m = spark.read.parquet(f"{sf}/customer.parquet").selectExpr("c_custkey as k", "c_acctbal / 1e6D as a", "(c_custkey % 17 - 8) / 1e5D as b", "(c_custkey % 13 - 6) / 1e5D as c", "-c_acctbal / 1e6D as d")
    return m.select("k", r6(sky.cd_scale(*map(F.col, "abcd"))).alias("scale"), r6(sky.cd_rotation(F.col("a"), F.col("b"))).alias("rotation"))


SEPARATION = "degrees(acos(least(greatest(sin(radians(dec)) * sin(radians({d})) + cos(radians(dec)) * cos(radians({d})) * cos(radians(ra - {r})), -1.0), 1.0)))"


@query("angular_separation", f"WITH {SKY} SELECT k, {s6(SEPARATION.format(d='45.0', r='180.0'))} AS sep FROM sky")
def angular_separation(spark, sf):
    return sky_table(spark, sf).select("k", r6(sky.angular_separation(F.col("ra"), F.col("dec"), F.lit(180.0), F.lit(45.0))).alias("sep"))


@query("cone_search", f"WITH {SKY} SELECT k, {s6(SEPARATION.format(d='45.0', r='180.0'))} AS sep FROM sky WHERE {SEPARATION.format(d='45.0', r='180.0')} <= 20 AND mag < 15 ORDER BY {SEPARATION.format(d='45.0', r='180.0')}, k LIMIT 20")
def cone_search(spark, sf):
    from frameflow.operators.match import cone_search as cone

    return cone(sky_table(spark, sf).where("mag < 15"), 180.0, 45.0, 20.0, 20).select("k", r6("sep").alias("sep"))


@query("visible_objects", f"WITH {PROJECTED} SELECT k, {s6('px')} AS px, {s6('py')} AS py, px >= 0 AND px < 200 AND py >= 0 AND py < 150 AS inside FROM proj WHERE px >= -20 AND px < 220 AND py >= -15 AND py < 165")
def visible_objects(spark, sf):
    x, y = F.col("px"), F.col("py")
    return projected(spark, sf).where(sky.in_frame(x, y, 200, 150, 0.1)).select("k", r6(x).alias("px"), r6(y).alias("py"), sky.in_frame(x, y, 200, 150).alias("inside"))


@query("boundary_segments", f"""WITH {PROJECTED}, n AS (SELECT a.k, a.px AS x1, a.py AS y1, b.px AS x2, b.py AS y2 FROM proj a JOIN proj b ON b.k = a.k + 1)
    SELECT k, {s6('x1')} AS x1, {s6('y2')} AS y2 FROM n WHERE (x1 >= -200 AND x1 <= 400 AND y1 >= -200 AND y1 <= 350) OR (x2 >= -200 AND x2 <= 400 AND y2 >= -200 AND y2 <= 350)""")
def boundary_segments(spark, sf):
    p = projected(spark, sf)
    near = lambda x, y: F.col(x).between(-200, 400) & F.col(y).between(-200, 350)
    n = p.selectExpr("k", "px as x1", "py as y1").join(p.selectExpr("k - 1 as k", "px as x2", "py as y2"), "k")
    return n.where(near("x1", "y1") | near("x2", "y2")).select("k", r6("x1").alias("x1"), r6("y2").alias("y2"))


HEADS = "CASE k % 5 WHEN 0 THEN '12:30:' || CAST(k % 60 AS VARCHAR) WHEN 1 THEN ' 5 10 20.5 ' WHEN 2 THEN 'bad' WHEN 3 THEN '23 59' ELSE '7' END"
DECS = "CASE k % 4 WHEN 0 THEN '-00:30:' || CAST(k % 60 AS VARCHAR) WHEN 1 THEN '+45 10 20.5' WHEN 2 THEN 'bad' ELSE '-12 15' END"
RA_VALUE = "CASE k % 5 WHEN 0 THEN (12 + 30 / 60.0 + (k % 60) / 3600.0) * 15 WHEN 1 THEN (5 + 10 / 60.0 + 20.5 / 3600) * 15 WHEN 3 THEN (23 + 59 / 60.0) * 15 END"
DEC_VALUE = "CASE k % 4 WHEN 0 THEN -(0 + 30 / 60.0 + (k % 60) / 3600.0) WHEN 1 THEN 45 + 10 / 60.0 + 20.5 / 3600 WHEN 3 THEN -(12 + 15 / 60.0) END"
KEYS = "(SELECT p_partkey AS k FROM part)"


def texts(spark, sf):
    return spark.read.parquet(f"{sf}/part.parquet").selectExpr("p_partkey as k").withColumns({"ra": F.expr(HEADS.replace("VARCHAR", "STRING")), "dec": F.expr(DECS.replace("VARCHAR", "STRING"))})


@query("parse_sexagesimal", f"SELECT k, {s6(f'CAST({RA_VALUE} AS DOUBLE)')} AS ra, {s6(f'CAST({DEC_VALUE} AS DOUBLE)')} AS dec FROM {KEYS}")
def parse_sexagesimal(spark, sf):
    return texts(spark, sf).select("k", r6(sky.parse_ra(F.col("ra"))).alias("ra"), r6(sky.parse_dec(F.col("dec"))).alias("dec"))


@query("coordinate_cascade", f"""SELECT k, {s6('CAST(CASE m WHEN 1 THEN ra WHEN 2 THEN k % 360 WHEN 3 THEN CASE WHEN k % 4 = 2 THEN 20 ELSE k % 90 END ELSE 0 END AS DOUBLE)')} AS ra, {s6('CAST(CASE m WHEN 1 THEN dec WHEN 2 THEN 10 WHEN 3 THEN CASE WHEN k % 4 = 2 THEN k % 90 ELSE 20 END ELSE 0 END AS DOUBLE)')} AS dec, CASE m WHEN 1 THEN 'objctra_dec' WHEN 2 THEN 'ra_dec' WHEN 3 THEN 'crval' ELSE 'none' END AS method,
    CASE m WHEN 1 THEN 0.95 WHEN 2 THEN 0.9 WHEN 3 THEN CASE WHEN k % 4 = 1 THEN 0.7 ELSE 0.85 END ELSE 0.0 END::DOUBLE AS confidence FROM (SELECT k, {RA_VALUE} AS ra, {DEC_VALUE} AS dec, CASE WHEN ({RA_VALUE}) IS NOT NULL AND ({DEC_VALUE}) IS NOT NULL THEN 1 WHEN k % 3 = 0 THEN 2 WHEN k % 7 < 3 THEN 3 ELSE 4 END AS m FROM {KEYS})""")
def coordinate_cascade(spark, sf):
    pairs = [("OBJCTRA", "ra"), ("OBJCTDEC", "dec"), ("RA", "if(k % 3 = 0, cast(k % 360 as string), null)"), ("DEC", "if(k % 3 = 0, '10', null)"), ("CRVAL1", "if(k % 7 < 3, cast(k % 90 as string), null)"), ("CRVAL2", "if(k % 7 < 3, '20', null)"), ("CTYPE1", "element_at(array('RA---TAN', 'LINEAR', 'dec--tan', null), cast(k % 4 as int) + 1)")]
    header = F.expr("map_filter(map(" + ", ".join(f"'{k}', {v}" for k, v in pairs) + "), (k, v) -> v is not null)")
    c = texts(spark, sf).select("k", sky.coordinates(header).alias("c"))
    return c.select("k", r6("c.ra").alias("ra"), r6("c.dec").alias("dec"), "c.method", "c.confidence")


@query("format_radec", f"""WITH {SKY}, t AS (SELECT k, CAST(floor(ra * 2400 + 0.5) AS BIGINT) % 864000 AS r, CAST(floor(abs(dec) * 36000 + 0.5) AS BIGINT) AS d, dec >= 0 AS p FROM sky)
    SELECT k, printf('%02dh%02dm%04.1fs', r // 36000, r // 600 % 60, r % 600 / 10.0) AS ra, CASE WHEN p THEN '+' ELSE '-' END || printf('%02d°%02d''%04.1f"', d // 36000, d // 600 % 60, d % 600 / 10.0) AS dec FROM t""")
def format_radec(spark, sf):
    return sky_table(spark, sf).select("k", sky.format_ra(F.col("ra")).alias("ra"), sky.format_dec(F.col("dec")).alias("dec"))


@query("grid_step", "SELECT p_partkey AS k, CAST(CASE " + " ".join(f"WHEN (p_partkey % 500 + 1) * 0.77 / {s} <= 12 THEN {s}" for s in sky.GRID_STEPS) + " ELSE 30 END AS DOUBLE) AS step FROM part")
def grid_step(spark, sf):
    return spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("k"), sky.grid_step((F.col("p_partkey") % 500 + 1) * 0.77).alias("step"))


CHORD = "degrees(2 * asin(sqrt(least(1.0, pow(sin((radians({d2}) - radians({d1})) / 2), 2) + cos(radians({d1})) * cos(radians({d2})) * pow(sin((radians({r2}) - radians({r1})) / 2), 2)))))"
PAIRS = f"""{SKY}, cones AS (SELECT k AS cone, fmod(ra + 0.25, 360.0) AS ra, greatest(least(dec + 0.125, 90.0), -90.0) AS dec, 0.75 + k % 4 AS radius FROM sky),
    met AS (SELECT cone, k, mag, {CHORD.format(r1='c.ra', d1='c.dec', r2='s.ra', d2='s.dec')} AS sep, radius FROM cones c JOIN sky s ON s.dec BETWEEN c.dec - radius - 0.001 AND c.dec + radius + 0.001)"""


def cones(spark, sf):
    """A cone beside each place of the sky table, the poles and right ascension 0 among them."""
    s = sky_table(spark, sf)
    return s.selectExpr("k as cone", "pmod(ra + 0.25D, 360.0D) as ra", "greatest(least(dec + 0.125D, 90.0D), -90.0D) as dec", "0.75D + k % 4 as radius")


@query("cone_join", f"WITH {PAIRS} SELECT cone, k, {s6('sep')} AS sep FROM met WHERE sep <= radius")
def cone_join(spark, sf):
    return match.cone_pairs(cones(spark, sf), sky_table(spark, sf), 2.0).select("cone", "k", r6("sep").alias("sep"))


@query("cone_counts", f"""WITH {PAIRS}, f AS (SELECT cone, count(*) AS n, min(sep) AS nearest, sum(pow(10.0, mag * -0.4)) AS flux FROM met WHERE sep <= radius GROUP BY cone)
    SELECT cone, coalesce(n, 0) AS n, {s6('nearest')} AS nearest, {s6('flux')} AS flux FROM cones LEFT JOIN f USING (cone)""")
def cone_counts(spark, sf):
    return match.cone_counts(cones(spark, sf), sky_table(spark, sf), 2.0).select("cone", "n", r6("nearest").alias("nearest"), r6("flux").alias("flux"))


def tan_sql(ra: str, dec: str, ra0: str, dec0: str) -> tuple[str, str]:
    """Standard coordinates by plain trigonometry; null on the far side."""
    da, d, d0 = f"radians({ra} - {ra0})", f"radians({dec})", f"radians({dec0})"
    depth = f"(sin({d0}) * sin({d}) + cos({d0}) * cos({d}) * cos({da}))"
    return tuple(f"CASE WHEN {depth} > 1e-12 THEN degrees({v} / {depth}) END" for v in (f"cos({d}) * sin({da})", f"(cos({d0}) * sin({d}) - sin({d0}) * cos({d}) * cos({da}))"))


#: Each place seen from the place with the key after it, turned to a plate that touches the sphere 20 degrees from there.
PLATES = f"{SKY}, plates AS (SELECT k, ra, dec, fmod(ra + 20.0, 360.0) AS ra0, CAST(CASE WHEN dec > 0 THEN dec - 15 ELSE dec + 15 END AS DOUBLE) AS dec0 FROM sky)"
_XI, _ETA = tan_sql("ra", "dec", "ra0", "dec0")


def plates(spark, sf):
    return sky_table(spark, sf).selectExpr("k", "ra", "dec", "pmod(ra + 20.0D, 360.0D) as ra0", "cast(case when dec > 0 then dec - 15 else dec + 15 end as double) as dec0")


@query("tan_project", f"WITH {PLATES} SELECT k, {s6(_XI)} AS xi, {s6(_ETA)} AS eta FROM plates")
def tan_project(spark, sf):
    xi, eta = sphere.project(*map(F.col, ("ra", "dec", "ra0", "dec0")))
    return plates(spark, sf).select("k", r6(xi).alias("xi"), r6(eta).alias("eta"))


@query("tan_pixel", f"""WITH {PLATES}, p AS (SELECT k, ra0, dec0, radians({WIDE.cd[0] / 60!r} * (k % 200 - 99.5) + {WIDE.cd[1] / 60!r} * (k % 150 - 74.5)) AS x, radians({WIDE.cd[2] / 60!r} * (k % 200 - 99.5) + {WIDE.cd[3] / 60!r} * (k % 150 - 74.5)) AS y FROM plates),
    q AS (SELECT *, cos(radians(dec0)) - y * sin(radians(dec0)) AS o FROM p), s AS (SELECT k, ra0 + degrees(atan2(x, o)) AS ra, degrees(atan2(y * cos(radians(dec0)) + sin(radians(dec0)), sqrt(x * x + o * o))) AS dec FROM q)
    SELECT k, {s6('fmod(fmod(ra, 360.0) + 360.0, 360.0)')} AS ra, {s6('dec')} AS dec, CAST(k % 200 AS DOUBLE) AS x, CAST(k % 150 AS DOUBLE) AS y FROM s""")
def tan_pixel(spark, sf):
    """Pixels to the sky and back."""
    cd, crpix = [v / 60 for v in WIDE.cd], WIDE.crpix
    x, y = (F.col("k") % 200).cast("double"), (F.col("k") % 150).cast("double")
    ra, dec = sphere.pixel_to_sky(cd, crpix, F.col("ra0"), F.col("dec0"), x, y)
    there = plates(spark, sf).select("k", "ra0", "dec0", ra.alias("ra"), dec.alias("dec"))
    bx, by = sphere.sky_to_pixel(cd, crpix, F.col("ra0"), F.col("dec0"), F.col("ra"), F.col("dec"))
    return there.select("k", r6("ra").alias("ra"), r6("dec").alias("dec"), r6(bx).alias("x"), r6(by).alias("y"))


@query("header_hint", """WITH h AS (SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN '12 30 00' WHEN 1 THEN '0.0' WHEN 2 THEN CAST(p_partkey % 360 AS VARCHAR) END AS ra, CASE WHEN p_partkey % 3 > 0 THEN '45.5' ELSE '' END AS dec, CAST(p_partkey % 90 AS VARCHAR) AS v FROM part),
    f AS (SELECT k, TRY_CAST(CASE WHEN ra IS NOT NULL AND ra <> '0.0' THEN ra ELSE v END AS DOUBLE) AS ra, TRY_CAST(CASE WHEN dec <> '' THEN dec ELSE v END AS DOUBLE) AS dec FROM h)
    SELECT k, CASE WHEN ra IS NOT NULL AND dec IS NOT NULL THEN ra END AS ra, CASE WHEN ra IS NOT NULL AND dec IS NOT NULL THEN dec END AS dec FROM f""")
def header_hint(spark, sf):
    header = F.expr("""map_filter(map('RA', case p_partkey % 4 when 0 then '12 30 00' when 1 then '0.0' when 2 then cast(p_partkey % 360 as string) end, 'DEC', case when p_partkey % 3 > 0 then '45.5' else '' end,
        'CRVAL1', cast(p_partkey % 90 as string), 'CRVAL2', cast(p_partkey % 90 as string)), (k, v) -> v is not null)""")
    return spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("k"), sky.header_hint(header).alias("h")).select("k", "h.ra", "h.dec")
