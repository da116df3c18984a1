"""Queries over neighbourhoods, detections, resampling and spatial joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from frameflow.functions import curves as C
from frameflow.layout import tile_grid as grid_of
from frameflow.operators import geometry as G
from frameflow.operators import match as M
from frameflow.operators import pixels as P
from frameflow.operators import stencil as S
from frameflow.plans.fixtures import PX, SKY, UNIT, pixels, r6, s6, table, unit_pixels
from frameflow.plans.q_pixels import CLOUD, STARS, clip
from frameflow.plans.registry import query

#: All frames of the table side by side, 20 tiles of 8 pixels a row, as one wide image.
MOSAIC = f"{UNIT}, mo AS (SELECT 0 AS frame_id, 0 AS ch, CAST(frame_id // 20 * 8 + y AS INTEGER) AS y, CAST(frame_id % 20 * 8 + x AS INTEGER) AS x, v FROM un)"


def mosaic(spark, sf):
    return unit_pixels(spark, sf).select(F.lit(0).alias("frame_id"), "ch", F.expr("cast(frame_id div 20 * 8 + y as int)").alias("y"), F.expr("cast(frame_id % 20 * 8 + x as int)").alias("x"), "v")


def near_sql(name: str, source: str, kernel: list, fill: str | None = None) -> str:
    """Gathered neighbours (u, k) of 8 by 8 frames, reflected or filled."""
    rows = ", ".join(f"({dy}, {dx}, {k!r}::DOUBLE)" for dy, dx, k in kernel)
    line = lambda c: c if fill is not None else f"(CASE WHEN (({c}) % 16 + 16) % 16 < 8 THEN (({c}) % 16 + 16) % 16 ELSE 15 - (({c}) % 16 + 16) % 16 END)"
    value = "b.v" if fill is None else f"coalesce(b.v, {fill})"
    return f"""{name} AS (SELECT a.frame_id, a.y, a.x, a.v, k, {value} AS u FROM {source} a CROSS JOIN (VALUES {rows}) o(dy, dx, k)
        {'JOIN' if fill is None else 'LEFT JOIN'} {source} b ON b.frame_id = a.frame_id AND b.y = {line('a.y + dy')} AND b.x = {line('a.x + dx')})"""


@query("median_filter3", f"WITH {PX}, {near_sql('n', 'px', S.square(1))} SELECT frame_id, y, x, {s6('median(u)')} AS v FROM n GROUP BY 1, 2, 3")
def median_filter3(spark, sf):
    return S.median_filter(pixels(spark, sf), 3).select("frame_id", "y", "x", r6("v").alias("v"))


@query("min_filter", f"WITH {PX}, {near_sql('n', 'px', S.square(2))} SELECT frame_id, y, x, {s6('min(u)')} AS v FROM n GROUP BY 1, 2, 3")
def min_filter(spark, sf):
    return S.minimum_filter(pixels(spark, sf), 2).select("frame_id", "y", "x", r6("v").alias("v"))


@query("gaussian_blur", f"WITH {PX}, {near_sql('n', 'px', S.gaussian(0.8))} SELECT frame_id, y, x, {s6('sum(u * k)')} AS v FROM n GROUP BY 1, 2, 3")
def gaussian_blur(spark, sf):
    return S.blur(pixels(spark, sf), 0.8).select("frame_id", "y", "x", r6("v").alias("v"))


@query("unsharp_mask", f"WITH {UNIT}, {near_sql('n', 'un', S.gaussian(0.6))}, b AS (SELECT frame_id, y, x, any_value(v) AS v, sum(u * k) AS s FROM n GROUP BY 1, 2, 3) SELECT frame_id, y, x, {s6(clip('CASE WHEN abs(v - s) >= 0.02 THEN v + 0.5 * (v - s) ELSE v END'))} AS v FROM b")
def unsharp_mask(spark, sf):
    return S.unsharp(unit_pixels(spark, sf), 0.6, 0.5, 0.02).select("frame_id", "y", "x", r6("v").alias("v"))


@query("laplacian_noise", f"WITH {PX}, {near_sql('n', 'px', S.LAPLACE)}, d AS (SELECT frame_id, y, x, sum(u * k) AS v FROM n GROUP BY 1, 2, 3), m AS (SELECT frame_id, median(v) AS m FROM d GROUP BY 1) SELECT frame_id, {s6('1.4826 * median(abs(v - m)) / sqrt(20)')} AS noise FROM d JOIN m USING (frame_id) GROUP BY 1")
def laplacian_noise(spark, sf):
    return S.laplacian_noise(pixels(spark, sf)).select("frame_id", r6("noise").alias("noise"))


MASK = f"{PX}, {STARS}, mask AS (SELECT px.frame_id, px.y, px.x, CAST(st.frame_id IS NOT NULL AS DOUBLE) AS v FROM px LEFT JOIN st USING (frame_id, y, x))"


@query("dilate", f"WITH {MASK}, {near_sql('n', 'mask', S.diamond(3), '0.0')} SELECT frame_id, y, x, max(u) AS v FROM n GROUP BY 1, 2, 3")
def dilate(spark, sf):
    px = pixels(spark, sf)
    on = P.threshold_mask(px, 1.5).select("frame_id", "ch", "y", "x", F.lit(1.0).alias("on"))
    mask = px.join(on, S.KEY, "left").select(*S.KEY, F.coalesce("on", F.lit(0.0)).alias("v"))
    return S.dilate(mask, 3).select("frame_id", "y", "x", "v")


@query("integer_shift", f"WITH {PX} SELECT a.frame_id, a.y, a.x, {s6('coalesce(b.v, 0.0)')} AS v FROM px a LEFT JOIN px b ON a.frame_id = b.frame_id AND b.y = a.y - a.frame_id % 3 AND b.x = a.x + a.frame_id % 2")
def integer_shift(spark, sf):
    px = pixels(spark, sf).drop("target")
    return S.shifted(px, (F.col("frame_id") % 3).cast("int"), -(F.col("frame_id") % 2).cast("int")).select("frame_id", "y", "x", r6("v").alias("v"))


@query("tile_grid", """WITH s AS (SELECT p_partkey AS frame_id, CAST(100 + p_partkey % 300 AS INTEGER) AS h, CAST(40 + p_partkey % 50 AS INTEGER) AS w FROM part),
    c AS (SELECT *, greatest(1, CAST(ceil((h - 16) / 48.0) AS INTEGER)) AS ny, greatest(1, CAST(ceil((w - 16) / 48.0) AS INTEGER)) AS nx FROM s), y AS (SELECT *, unnest(range(ny)) AS ty FROM c), t AS (SELECT *, unnest(range(nx)) AS tx FROM y)
    SELECT frame_id, CAST(ty AS INTEGER) AS ty, CAST(tx AS INTEGER) AS tx, CAST(greatest(0, least(ty * 48, h - 64)) AS INTEGER) AS y0, CAST(greatest(0, least(tx * 48, w - 64)) AS INTEGER) AS x0, least(64, h) AS th, least(64, w) AS tw FROM t""")
def tile_grid(spark, sf):
    sizes = table(spark, sf, "part").selectExpr("p_partkey as frame_id", "cast(100 + p_partkey % 300 as int) as h", "cast(40 + p_partkey % 50 as int) as w")
    return grid_of(sizes, 64, 16).select("frame_id", "ty", "tx", "y0", "x0", "th", "tw")


DRIZZLE = "(SELECT frame_id, y, x, v, (x * 0.9 + 0.05 * y + (frame_id % 5) * 0.31) / 1.0 AS cx, (y * 0.95 - 0.02 * x + (frame_id % 7) * 0.23 + 0.4) / 1.0 AS cy FROM px)"


@query("drizzle", f"""WITH {PX}, d AS (SELECT *, floor(cx - 0.35) AS x0, floor(cx + 0.35) AS x1, floor(cy - 0.35) AS y0, floor(cy + 0.35) AS y1 FROM {DRIZZLE}), c AS (SELECT *, unnest(range(CAST(x0 AS BIGINT), CAST(x1 AS BIGINT) + 1)) AS ox FROM d WHERE x0 >= 0 AND y0 >= 0 AND x1 < 10 AND y1 < 10),
    e AS (SELECT *, unnest(range(CAST(y0 AS BIGINT), CAST(y1 AS BIGINT) + 1)) AS oy FROM c), k AS (SELECT ox, oy, v, greatest(0.0, least(cx + 0.35, ox + 1.0) - greatest(cx - 0.35, ox)) * greatest(0.0, least(cy + 0.35, oy + 1.0) - greatest(cy - 0.35, oy)) AS k FROM e)
    SELECT oy, ox, {s6('sum(v * k) / sum(k)')} AS v, {s6('sum(k)')} AS weight FROM k WHERE k > 0 GROUP BY oy, ox""")
def drizzle(spark, sf):
    px = pixels(spark, sf)
    x, y = G.affine(px, [F.lit(0.9), F.lit(0.05), (F.col("frame_id") % 5) * 0.31, F.lit(-0.02), F.lit(0.95), (F.col("frame_id") % 7) * 0.23 + 0.4])
    return G.drizzle(px, x, y, 10, 10, 0.7).select("oy", "ox", r6("v").alias("v"), r6("weight").alias("weight"))


@query("perspective_warp", f"""WITH {PX}, t AS (SELECT frame_id, y, x, x * 0.8 + 0.1 * y + 0.3 AS sx, y * 0.9 + 0.05 * x + 0.2 AS sy FROM px), p AS (SELECT *, floor(sx) AS x0, floor(sy) AS y0 FROM t),
    k AS (SELECT p.frame_id, p.y, p.x, y0 + j AS ny, x0 + i AS nx, (CASE j WHEN 1 THEN sy - y0 ELSE 1 - (sy - y0) END) * (CASE i WHEN 1 THEN sx - x0 ELSE 1 - (sx - x0) END) AS k FROM p, (SELECT unnest([0, 1]) AS j), (SELECT unnest([0, 1]) AS i))
    SELECT k.frame_id, k.y, k.x, {s6('sum(coalesce(px.v * k, 0.0))')} AS v FROM k LEFT JOIN px ON px.frame_id = k.frame_id AND px.y = ny AND px.x = nx GROUP BY 1, 2, 3""")
def perspective_warp(spark, sf):
    px = pixels(spark, sf)
    sx, sy = G.affine(px, (0.8, 0.1, 0.3, 0.05, 0.9, 0.2))
    return G.warp(px, px.select("frame_id", "ch", "y", "x"), sx, sy).select("frame_id", "y", "x", r6("v").alias("v"))


@query("mosaic_extent", f"""WITH {SKY}, e AS (SELECT min(ra) AS a, max(ra) AS b, min(dec) AS c, max(dec) AS d FROM sky WHERE ra BETWEEN 100 AND 140 AND dec BETWEEN 10 AND 30)
    SELECT {s6('(a + b) / 2')} AS ra, {s6('(c + d) / 2')} AS dec, CAST(ceil((b - a) * cos(radians((c + d) / 2)) / 0.01) AS BIGINT) + 1 AS nx, CAST(ceil((d - c) / 0.01) AS BIGINT) + 1 AS ny FROM e""")
def mosaic_extent(spark, sf):
    from frameflow.plans.fixtures import sky

    m = G.mosaic_extent(sky(spark, sf).where("ra between 100 and 140 and dec between 10 and 30"), 0.02, 2.0)
    return m.select(r6("ra").alias("ra"), r6("dec").alias("dec"), "nx", "ny")


@query("polygon_area", f"""WITH p AS (SELECT p_partkey AS k, [0.0, 3.0 + p_partkey % 5, 4.0, p_partkey % 3]::DOUBLE[] AS xs, [0.0, p_partkey % 2, 5.0 + p_partkey % 7, 2.0]::DOUBLE[] AS ys FROM part)
    SELECT k, {s6('abs(list_sum(list_transform(range(1, 5), lambda i: xs[i] * ys[i % 4 + 1] - xs[i % 4 + 1] * ys[i]))) / 2')} AS area FROM p""")
def polygon_area(spark, sf):
    pts = F.expr("array(struct(0D as x, 0D as y), struct(3D + p_partkey % 5 as x, cast(p_partkey % 2 as double) as y), struct(4D as x, 5D + p_partkey % 7 as y), struct(cast(p_partkey % 3 as double) as x, 2D as y))")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k"), r6(C.shoelace(pts)).alias("area"))


#: Every part is a star, and stars are spread over the whole height of the mosaic of all frames.
@query("aperture_flux", f"""WITH {MOSAIC}, e AS (SELECT (max(vec_id) // 20 + 1) * 8 AS h FROM embeddings), s AS (SELECT CAST(p_partkey AS BIGINT) AS star_id, 3.0 + (p_partkey * 7) % (h - 6) AS sy, 2.5 + (p_partkey * 13) % 150 AS sx FROM part, e),
    m AS (SELECT star_id, v, sqrt((y - sy) ** 2 + (x - sx) ** 2) AS d FROM s JOIN mo ON y >= sy - 7.5 AND y <= sy + 7.5 AND x >= sx - 7.5 AND x <= sx + 7.5 WHERE sqrt((y - sy) ** 2 + (x - sx) ** 2) <= 7.5), a AS (SELECT star_id, coalesce(median(v) FILTER (d >= 4.5), 0.0) AS bg, sum(v) FILTER (d <= 3) AS t, count(*) FILTER (d <= 3) AS n FROM m GROUP BY 1)
    SELECT star_id, {s6('bg')} AS bg, n, {s6('greatest(t - n * bg, 1e-10)')} AS flux FROM a""")
def aperture_flux(spark, sf):
    height = table(spark, sf, "embeddings").agg(((F.floor(F.max("vec_id") / 20) + 1) * 8).alias("h"))
    stars = table(spark, sf, "part").crossJoin(F.broadcast(height)).selectExpr("0 as frame_id", "p_partkey as star_id", "3.0D + (p_partkey * 7) % (h - 6) as sy", "2.5D + (p_partkey * 13) % 150 as sx")
    return G.aperture_flux(mosaic(spark, sf), stars, 3.0).select("star_id", r6("bg").alias("bg"), "n", r6("flux").alias("flux"))


#: Every part is a sample, with 20 samples a frame, so that frames grow with the table.
@query("idw_grid", f"""WITH s AS (SELECT p_partkey // 20 AS frame_id, (p_partkey * 7) % 60 AS sy, (p_partkey * 13) % 60 AS sx, 2.0 + p_partkey % 9 AS value FROM part), g AS (SELECT f.frame_id, gy, gx FROM (SELECT DISTINCT frame_id FROM s) f, (SELECT unnest(range(0, 60, 8)) AS gy), (SELECT unnest(range(0, 60, 8)) AS gx))
    SELECT g.frame_id, CAST(gy AS INTEGER) AS gy, CAST(gx AS INTEGER) AS gx, {s6('sum(value / ((gy - sy) ** 2 + (gx - sx) ** 2 + 4)) / sum(1 / ((gy - sy) ** 2 + (gx - sx) ** 2 + 4))')} AS value FROM g JOIN s ON g.frame_id = s.frame_id GROUP BY 1, 2, 3""")
def idw_grid(spark, sf):
    stars = table(spark, sf, "part").selectExpr("p_partkey div 20 as frame_id", "(p_partkey * 7) % 60 as sy", "(p_partkey * 13) % 60 as sx", "2.0D + p_partkey % 9 as value")
    return G.idw_grid(stars, 60, 60, 8).select("frame_id", "gy", "gx", r6("value").alias("value"))


LABELS = """lab AS (WITH RECURSIVE r AS (SELECT frame_id, y, x, y * 1048576 + x AS label FROM st UNION SELECT s.frame_id, s.y, s.x, r.label FROM r JOIN st s ON s.frame_id = r.frame_id AND abs(s.y - r.y) + abs(s.x - r.x) = 1) SELECT frame_id, y, x, CAST(min(label) AS BIGINT) AS label FROM r GROUP BY 1, 2, 3)"""


def labels(spark, sf):
    px = pixels(spark, sf)
    return px, G.connected_labels(P.threshold_mask(px, 1.5))


@query("connected_components", f"WITH {PX}, {STARS}, {LABELS} SELECT frame_id, y, x, label FROM lab")
def connected_components(spark, sf):
    return labels(spark, sf)[1]


PROPS = f"""{PX}, {STARS}, {LABELS}, pr AS (SELECT frame_id, label, count(*) AS area, sum(v) AS flux, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1, sum(y * v) / sum(v) AS cy, sum(x * v) / sum(v) AS cx, max(v) AS peak,
    var_pop(x) AS mu20, var_pop(y) AS mu02, covar_pop(x, y) AS mu11 FROM lab JOIN px USING (frame_id, y, x) GROUP BY 1, 2)"""


def props(spark, sf):
    px, lab = labels(spark, sf)
    return px, G.region_props(lab, px)


@query("region_props", f"WITH {PROPS} SELECT frame_id, label, area, y0, y1, x0, x1, {', '.join(f'{s6(c)} AS {c}' for c in ('flux', 'cy', 'cx', 'peak', 'mu20', 'mu02', 'mu11'))} FROM pr")
def region_props(spark, sf):
    return props(spark, sf)[1].select("frame_id", "label", "area", "y0", "y1", "x0", "x1", *[r6(c).alias(c) for c in ("flux", "cy", "cx", "peak", "mu20", "mu02", "mu11")])


@query("star_filter", f"WITH {PROPS} SELECT frame_id, label FROM pr WHERE area BETWEEN 2 AND 6 AND greatest(y1 - y0 + 1, x1 - x0 + 1) / least(y1 - y0 + 1, x1 - x0 + 1)::DOUBLE <= 2")
def star_filter(spark, sf):
    return G.star_filter(props(spark, sf)[1], 2, 6, 2.0).select("frame_id", "label")


@query("topk_stars", f"WITH {PROPS} SELECT * FROM (SELECT frame_id, label, CAST(row_number() OVER (PARTITION BY frame_id ORDER BY flux DESC, label) AS INTEGER) AS rank FROM pr) WHERE rank <= 2")
def topk_stars(spark, sf):
    return G.top_stars(props(spark, sf)[1], 2).select("frame_id", "label", "rank")


ROUND = f"""rn AS (SELECT frame_id, least(greatest(coalesce(median(CASE WHEN area >= 3 AND mu20 + mu02 >= 1e-12 THEN 1 - sqrt(greatest(1 - (mu20 + mu02 - d) / (mu20 + mu02 + d), 0.0)) END), 0.0), 0.0), 1.0) AS roundness
    FROM (SELECT *, sqrt(greatest((mu20 + mu02) ** 2 - 4 * (mu20 * mu02 - mu11 * mu11), 0.0)) AS d FROM pr) GROUP BY 1)"""


@query("roundness", f"WITH {PROPS}, {ROUND} SELECT frame_id, {s6('roundness')} AS roundness FROM rn")
def roundness(spark, sf):
    return G.roundness(props(spark, sf)[1]).select("frame_id", r6("roundness").alias("roundness"))


HFR = """pk AS (SELECT frame_id, arg_min(y, -v * 1e6 + y * 8 + x) AS sy, arg_min(x, -v * 1e6 + y * 8 + x) AS sx FROM un GROUP BY 1), rg AS (SELECT frame_id, sqrt((y - sy) ** 2 + (x - sx) ** 2) AS r, sum(v) AS v FROM un JOIN pk USING (frame_id) GROUP BY 1, 2),
    cm AS (SELECT *, sum(v) OVER (PARTITION BY frame_id ORDER BY r) AS c, sum(v) OVER (PARTITION BY frame_id) AS t FROM rg), hf AS (SELECT frame_id, min(r) FILTER (c >= t / 2) AS hfr FROM cm GROUP BY 1)"""


def peaks(spark, sf):
    px = unit_pixels(spark, sf)
    return px, px.groupBy("frame_id").agg(F.min_by(F.struct("y", "x"), F.col("v") * -1e6 + F.col("y") * 8 + F.col("x")).alias("p")).select("frame_id", F.col("frame_id").alias("star_id"), F.col("p.y").alias("sy"), F.col("p.x").alias("sx"))


@query("hfr", f"WITH {UNIT}, {HFR} SELECT frame_id, {s6('hfr')} AS hfr FROM hf")
def hfr(spark, sf):
    return G.half_flux_radius(*peaks(spark, sf)).select("frame_id", r6("hfr").alias("hfr"))


@query("frame_score", f"""WITH {PROPS}, {ROUND}, un AS (SELECT frame_id, ch, y, x, least(greatest(0.5 + v, 0.0), 1.0) AS v FROM px), {HFR}, {CLOUD}
    SELECT frame_id, {s6('least(greatest(0.4 * least(greatest(1 - hfr / 10, 0.0), 1.0) + 0.35 * coalesce(roundness, 0.0) + 0.25 * cloud, 0.0), 1.0)')} AS score FROM hf LEFT JOIN rn USING (frame_id) JOIN cl USING (frame_id)""")
def frame_score(spark, sf):
    px, stars = peaks(spark, sf)
    return G.frame_score(G.half_flux_radius(px, stars), G.roundness(props(spark, sf)[1]), P.cloud_score(px, 4, spread=0.09), px).select("frame_id", r6("score").alias("score"))


@query("psf_aggregate", f"SELECT event_type AS frame_id, count(*) AS n, {s6('median(value)')} AS fwhm, {s6('quantile_cont(value, 0.9)')} AS fwhm_p90, {s6('median(user_id % 10 / 10.0)')} AS ellipticity, {s6('median(event_id % 97 / 97.0)')} AS strehl, {s6('median(abs(value / 2 - user_id))')} AS hfr_gap, median(value) > 10.25 AS exceeds_limit FROM events GROUP BY 1")
def psf_aggregate(spark, sf):
    s = table(spark, sf, "events").selectExpr("event_type as frame_id", "value as fwhm", "user_id % 10 / 10.0D as ellipticity", "event_id % 97 / 97.0D as strehl", "cast(user_id as double) as hfr")
    return G.psf_aggregate(s, 10.25).select("frame_id", "n", *[r6(c).alias(c) for c in ("fwhm", "fwhm_p90", "ellipticity", "strehl", "hfr_gap")], "exceeds_limit")


POINTS = """pt AS (SELECT c_custkey AS id, (c_custkey * 37 % 997) * 3.0::DOUBLE AS x, (c_custkey * 61 % 991) * 3.0::DOUBLE AS y FROM customer), jt AS (SELECT id, x + ((id * 7919) % 100 - 50) / 12.5::DOUBLE AS x, y + ((id * 104729) % 100 - 50) / 12.5::DOUBLE AS y FROM pt)"""


def points(spark, sf):
    pt = table(spark, sf, "customer").selectExpr("c_custkey as id", "(c_custkey * 37 % 997) * 3.0D as x", "(c_custkey * 61 % 991) * 3.0D as y")
    return pt.selectExpr("id", "x + ((id * 7919) % 100 - 50) / 12.5D as x", "y + ((id * 104729) % 100 - 50) / 12.5D as y"), pt


@query("star_catalog_match", f"""WITH {POINTS}, m AS (SELECT j.id AS left_id, p.id AS right_id, (j.x - p.x) ** 2 + (j.y - p.y) ** 2 AS d2 FROM jt j, pt p WHERE (j.x - p.x) ** 2 + (j.y - p.y) ** 2 <= 25)
    SELECT left_id, right_id, {s6('sqrt(d2)')} AS distance FROM m QUALIFY row_number() OVER (PARTITION BY left_id ORDER BY d2, right_id) = 1""")
def star_catalog_match(spark, sf):
    return M.nearest_within(*points(spark, sf), 5.0).select("left_id", "right_id", r6("distance").alias("distance"))


@query("star_shift", f"""WITH {POINTS}, t AS (SELECT id % 40 AS frame_id, id, x + 4 AS x, y - 3 AS y FROM jt), m AS (SELECT t.frame_id, t.id, p.x - t.x AS dx, p.y - t.y AS dy, row_number() OVER (PARTITION BY t.id ORDER BY (p.x - t.x) ** 2 + (p.y - t.y) ** 2, p.id) AS nth FROM t, pt p WHERE (p.x - t.x) ** 2 + (p.y - t.y) ** 2 <= 2500)
    SELECT frame_id, count(*) AS n, {s6('CASE WHEN count(*) >= 3 THEN median(dy) ELSE 0.0 END')} AS dy, {s6('CASE WHEN count(*) >= 3 THEN median(dx) ELSE 0.0 END')} AS dx FROM m WHERE nth = 1 GROUP BY 1""")
def star_shift(spark, sf):
    jt, pt = points(spark, sf)
    t = jt.selectExpr("id % 40 as frame_id", "id", "x + 4 as x", "y - 3 as y")
    return M.star_shift(t, pt).select("frame_id", "n", r6("dy").alias("dy"), r6("dx").alias("dx"))


@query("mutual_nn_descriptors", """WITH d AS (SELECT label % 5 AS pair, vec_id, embedding::DOUBLE[] AS e, vec_id % 2 AS side FROM embeddings),
    s AS (SELECT a.pair, a.vec_id AS a_id, b.vec_id AS b_id, list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)) AS sim FROM d a JOIN d b ON a.pair = b.pair AND a.side = 0 AND b.side = 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY pair, a_id ORDER BY sim DESC, b_id) AS ra, row_number() OVER (PARTITION BY pair, b_id ORDER BY sim DESC, a_id) AS rb FROM s) SELECT pair, a_id, b_id, (round(sim, 6) + 0.0) AS sim FROM r WHERE ra = 1 AND rb = 1""")
def mutual_nn_descriptors(spark, sf):
    d = table(spark, sf, "embeddings").selectExpr("label % 5 as pair", "vec_id as id", "embedding as d")
    return M.mutual_nearest(d.where("id % 2 = 0"), d.where("id % 2 = 1"), ["pair"]).select("pair", "a_id", "b_id", r6("sim").alias("sim"))


@query("overlap_graph_bbox", f"""WITH b AS (SELECT c_custkey AS id, (c_custkey * 37 % 997)::DOUBLE AS x0, (c_custkey * 61 % 991)::DOUBLE AS y0, c_custkey * 37 % 997 + 20.0 + c_custkey % 7 AS x1, c_custkey * 61 % 991 + 15.0 + c_custkey % 5 AS y1 FROM customer),
    m AS (SELECT a.id AS a, b.id AS b, least(a.x1, b.x1) - greatest(a.x0, b.x0) AS w, least(a.y1, b.y1) - greatest(a.y0, b.y0) AS h, least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)) AS s FROM b a JOIN b ON a.id < b.id)
    SELECT a, b, {s6('w * h')} AS area, {s6('w * h / s')} AS fraction FROM m WHERE w > 0 AND h > 0""")
def overlap_graph_bbox(spark, sf):
    b = table(spark, sf, "customer").selectExpr("c_custkey as id", "cast(c_custkey * 37 % 997 as double) as x0", "cast(c_custkey * 61 % 991 as double) as y0", "c_custkey * 37 % 997 + 20.0D + c_custkey % 7 as x1", "c_custkey * 61 % 991 + 15.0D + c_custkey % 5 as y1")
    return M.overlap_graph(b, 32.0).select("a", "b", r6("area").alias("area"), r6("fraction").alias("fraction"))


# -- time windows over the event stream, in batch; frameflow.streaming has the streaming forms

def events(spark, sf):
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("tumbling", f"SELECT event_type, epoch(time_bucket(INTERVAL '1 hour', ts))::BIGINT AS start, count(*) AS n, {s6('sum(value)')} AS total FROM events GROUP BY 1, 2")
def tumbling(spark, sf):
    w = events(spark, sf).groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return w.select("event_type", F.unix_timestamp("w.start").alias("start"), "n", r6("total").alias("total"))


@query("sliding", f"SELECT start, count(*) AS n, {s6('avg(value)')} AS mean FROM (SELECT epoch(time_bucket(INTERVAL '15 minutes', ts))::BIGINT - 900 * unnest(range(4)) AS start, value FROM events) GROUP BY 1")
def sliding(spark, sf):
    w = events(spark, sf).groupBy(F.window("ts", "1 hour", "15 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    return w.select(F.unix_timestamp("w.start").alias("start"), "n", r6("mean").alias("mean"))


SESSION = """(SELECT user_id, ts, event_id, value, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL '{0}' > ts THEN 0 ELSE 1 END AS fresh FROM events))"""


@query("session", f"SELECT user_id, epoch_us(min(ts))::BIGINT AS start, count(*) AS n FROM {SESSION.format('30 minutes')} GROUP BY user_id, s")
def session(spark, sf):
    w = events(spark, sf).groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return w.select("user_id", F.unix_micros("w.start").alias("start"), "n")


@query("debounce_session", f"SELECT user_id, epoch_us(max(ts))::BIGINT AS at, arg_max(event_id, ts) AS event_id FROM {SESSION.format('300 milliseconds')} GROUP BY user_id, s")
def debounce_session(spark, sf):
    from frameflow.streaming.windows import debounce

    return debounce(events(spark, sf), "user_id", "300 milliseconds", "event_id").select("user_id", F.unix_micros("at").alias("at"), "event_id")


@query("rate_limit_tumbling", "SELECT event_id, row_number() OVER (PARTITION BY user_id, time_bucket(INTERVAL '1 hour', ts) ORDER BY ts, event_id) <= 2 AS allowed FROM events")
def rate_limit_tumbling(spark, sf):
    from frameflow.streaming.windows import rate_limit_batch

    return rate_limit_batch(events(spark, sf), "user_id", "1 hour", 2, "event_id").select("event_id", "allowed")


#: Each frame as a panel somewhere on the sphere, 0.1 degrees a pixel and turned by its number, and a grid beside it, a tenth
#: coarser and turned back, on which it is read.
PANELS = """panels AS (SELECT frame_id, fmod(frame_id * 137.50776405, 360.0) AS ra, degrees(asin(2 * ((frame_id + 0.5) / (SELECT max(vec_id) + 1 FROM embeddings)) - 1)) AS dec,
    0.1 * cos(radians(frame_id % 90 + 0.0)) AS c, 0.1 * sin(radians(frame_id % 90 + 0.0)) AS s FROM (SELECT DISTINCT frame_id FROM px))"""


@query("reproject", f"""WITH {PX}, {PANELS}, g AS (SELECT frame_id, ra, dec, c, s, y, x, radians(-0.11 * (x - 3.25) + 0.01 * (y - 3.75)) AS tx, radians(0.01 * (x - 3.25) + 0.11 * (y - 3.75)) AS ty FROM panels JOIN (SELECT frame_id, y, x FROM px) USING (frame_id)),
    w AS (SELECT *, cos(radians(dec)) - ty * sin(radians(dec)) AS o FROM g),
    p AS (SELECT *, atan2(tx, o) AS da, atan2(ty * cos(radians(dec)) + sin(radians(dec)), sqrt(tx * tx + o * o)) AS d, radians(dec) AS d0 FROM w),
    z AS (SELECT *, sin(d0) * sin(d) + cos(d0) * cos(d) * cos(da) AS depth FROM p),
    q AS (SELECT *, degrees(cos(d) * sin(da) / depth) AS xi, degrees((cos(d0) * sin(d) - sin(d0) * cos(d) * cos(da)) / depth) AS eta FROM z),
    h AS (SELECT frame_id, y, x, (c * xi - s * eta) / (-c * c - s * s) + 3.5 AS sx, (-c * eta - s * xi) / (-c * c - s * s) + 3.5 AS sy FROM q),
    i AS (SELECT *, floor(sx) AS x0, floor(sy) AS y0 FROM h WHERE sx >= -1e-9 AND sx <= 7 + 1e-9 AND sy >= -1e-9 AND sy <= 7 + 1e-9),
    t AS (SELECT frame_id, y, x, y0 + j AS ny, x0 + k AS nx, (CASE j WHEN 1 THEN sy - y0 ELSE 1 - (sy - y0) END) * (CASE k WHEN 1 THEN sx - x0 ELSE 1 - (sx - x0) END) AS f FROM i, (VALUES (0), (1)) a(j), (VALUES (0), (1)) b(k))
    SELECT t.frame_id, t.y, t.x, {s6('sum(coalesce(v * f, 0.0))')} AS v FROM t LEFT JOIN px ON px.frame_id = t.frame_id AND px.y = ny AND px.x = nx GROUP BY 1, 2, 3""")
def reproject(spark, sf):
    from frameflow.operators import mosaic as MO

    px = pixels(spark, sf)
    n = table(spark, sf, "embeddings").agg((F.max("vec_id") + 1).alias("n"))
    turn = F.radians((F.col("frame_id") % 90).cast("double"))
    c, s = F.cos(turn) * 0.1, F.sin(turn) * 0.1
    panels = table(spark, sf, "embeddings").select(F.col("vec_id").alias("frame_id")).crossJoin(F.broadcast(n)).select(
        "frame_id", F.expr("pmod(frame_id * 137.50776405D, 360.0D)").alias("ra"), F.expr("degrees(asin(2 * ((frame_id + 0.5D) / n) - 1))").alias("dec"),
        F.array(-c, s, s, c).alias("cd"), F.array(F.lit(4.5), F.lit(4.5)).alias("crpix"), F.lit(8).alias("width"), F.lit(8).alias("height"),
    )
    places = px.select("frame_id", "y", "x").join(panels, "frame_id")
    inside = MO.source_places(places, ([-0.11, 0.01, 0.01, 0.11], [4.25, 4.75], F.col("ra"), F.col("dec"))).withColumn("ch", F.lit(0))
    return G.warp(px, inside.select("frame_id", "ch", "y", "x", "sx", "sy"), F.col("sx"), F.col("sy")).select("frame_id", "y", "x", r6("v").alias("v"))
