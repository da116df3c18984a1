"""Queries over tables: metadata, matching, selection, summaries, licences, caches and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from frameflow.functions import claims as L
from frameflow.functions import sky, text
from frameflow.operators import tables as T
from frameflow.plans.fixtures import ENTRIES, LIBRARY, LIGHTS, SKY, entries, library, lights, r6, s6, table
from frameflow.plans.fixtures import sky as sky_table
from frameflow.plans.registry import query

HEADERS = """hdr AS (SELECT event_id, map_from_entries(list_filter([
    {k: 'NAXIS', v: CAST(event_id % 4 AS VARCHAR)}, {k: 'NAXIS1', v: CAST(user_id + 10 AS VARCHAR)}, {k: 'NAXIS2', v: '48'}, {k: 'NAXIS3', v: '3'},
    {k: CASE event_id % 3 WHEN 0 THEN 'EXPTIME' WHEN 1 THEN 'EXPOSURE' ELSE 'NONE' END, v: CAST(event_id % 300 AS VARCHAR)},
    {k: CASE WHEN event_id % 2 = 0 THEN 'GAIN' ELSE 'ISO' END, v: CAST(100 * (event_id % 9) AS VARCHAR)},
    {k: 'CCD-TEMP', v: CASE WHEN event_id % 5 = 0 THEN NULL ELSE '-' || CAST(event_id % 20 AS VARCHAR) END}, {k: 'OBJECT', v: ' ' || event_type || ' '}], lambda e: e.v IS NOT NULL)) AS h FROM events)"""


def headers(spark, sf):
    pairs = [
        ("'NAXIS'", "cast(event_id % 4 as string)"), ("'NAXIS1'", "cast(user_id + 10 as string)"), ("'NAXIS2'", "'48'"), ("'NAXIS3'", "'3'"),
        ("case event_id % 3 when 0 then 'EXPTIME' when 1 then 'EXPOSURE' else 'NONE' end", "cast(event_id % 300 as string)"), ("case when event_id % 2 = 0 then 'GAIN' else 'ISO' end", "cast(100 * (event_id % 9) as string)"),
        ("'CCD-TEMP'", "case when event_id % 5 = 0 then null else concat('-', event_id % 20) end"), ("'OBJECT'", "concat(' ', event_type, ' ')"),
    ]
    made = "map_filter(map(" + ", ".join(f"{k}, {v}" for k, v in pairs) + "), (k, v) -> v is not null)"
    return table(spark, sf, "events").selectExpr("event_id", f"{made} as h")


@query("fits_metadata", f"""WITH {HEADERS}
    SELECT event_id, CAST(coalesce(h['EXPTIME'], h['EXPOSURE']) AS DOUBLE) AS exposure, CAST(coalesce(h['GAIN'], h['ISO']) AS INTEGER) AS gain_iso, CAST(h['CCD-TEMP'] AS DOUBLE) AS temperature,
        CASE WHEN event_id % 4 >= 2 THEN CAST(h['NAXIS1'] AS INTEGER) ELSE 0 END AS width, CASE event_id % 4 WHEN 3 THEN 3 WHEN 2 THEN 1 ELSE 0 END AS channels, trim(h['OBJECT']) AS object FROM hdr""")
def fits_metadata(spark, sf):
    m = headers(spark, sf).select("event_id", text.header_metadata(F.col("h")).alias("m"), text.header_panel(F.col("h")).alias("p"))
    return m.select("event_id", "m.exposure", "m.gain_iso", "m.temperature", "m.width", "m.channels", F.element_at("p", "OBJECT").alias("object"))


@query("import_dedupe", f"""WITH {ENTRIES} SELECT DISTINCT path FROM entries WHERE idx % 3 <> 0 AND path NOT IN (SELECT path FROM entries WHERE idx % 4 = 0)""")
def import_dedupe(spark, sf):
    e = entries(spark, sf)
    found = e.where("idx % 3 <> 0")
    return T.new_paths(found.select("path").unionAll(found.where("idx % 2 = 0").select("path")), e.where("idx % 4 = 0"))


@query("catalog_flux_ratios", f"""WITH {SKY}, m AS (SELECT k, mag AS r, mag + k % 7 * 0.1 AS g, CASE WHEN k % 10 = 0 THEN NULL ELSE mag - k % 5 * 0.1 END AS b FROM sky WHERE mag < 16)
    SELECT k, {s6('pow(10, -0.4 * r) / pow(10, -0.4 * g)')} AS ratio_rg, {s6('pow(10, -0.4 * b) / pow(10, -0.4 * g)')} AS ratio_bg FROM m WHERE b IS NOT NULL""")
def catalog_flux_ratios(spark, sf):
    m = sky_table(spark, sf).where("mag < 16").selectExpr("k", "mag as r", "mag + k % 7 * 0.1D as g", "case when k % 10 = 0 then null else mag - k % 5 * 0.1D end as b").where("b is not null")
    flux = lambda c: F.pow(F.lit(10.0), F.col(c) * -0.4)
    ratio = lambda a, b: F.when(flux(b) > 0, flux(a) / flux(b)).otherwise(1.0)
    return m.select("k", r6(ratio("r", "g")).alias("ratio_rg"), r6(ratio("b", "g")).alias("ratio_bg"))


@query("mru_top10", """SELECT path, CAST(row_number() OVER (ORDER BY seq DESC, path) AS INTEGER) AS rank
    FROM (SELECT 'p' || CAST(user_id AS VARCHAR) AS path, max(event_id) AS seq FROM events GROUP BY 1) QUALIFY row_number() OVER (ORDER BY seq DESC, path) <= 10""")
def mru_top10(spark, sf):
    return T.mru(table(spark, sf, "events").selectExpr("concat('p', user_id) as path", "event_id as seq")).select("path", "rank")


@query("frame_stats_export", f"""WITH {ENTRIES} SELECT split_part(path, '/', 4) AS filename, path, printf('%.3f', exposure) AS exposure_s, CASE WHEN user_id % 3 = 0 THEN '' ELSE CAST(100 * (user_id % 4) AS VARCHAR) END AS gain_iso,
    coalesce(printf('%.1f', temperature), '') AS temperature_c, coalesce(printf('%.4f', quality), '') AS quality_score, CASE WHEN selected THEN '1' ELSE '0' END AS selected FROM entries""")
def frame_stats_export(spark, sf):
    return T.frame_stats(entries(spark, sf).selectExpr("*", "if(user_id % 3 = 0, null, 100 * (user_id % 4)) as gain_iso"))


@query("quality_dashboard", f"""WITH {ENTRIES} SELECT event_type, count(*) FILTER (quality >= 0.5) AS accepted, count(*) FILTER (quality < 0.5) AS rejected, {s6('avg(quality)')} AS mean FROM entries GROUP BY event_type""")
def quality_dashboard(spark, sf):
    return entries(spark, sf).groupBy("event_type").agg(F.count_if(F.col("quality") >= 0.5).alias("accepted"), F.count_if(F.col("quality") < 0.5).alias("rejected"), r6(F.avg("quality")).alias("mean"))


@query("wcs_create", f"""SELECT c_custkey AS k, {s6('-0.5 * cos(radians(c_custkey % 360))')} AS cd11, {s6('-0.25 * sin(radians(c_custkey % 360))')} AS cd12,
    {s6('-0.5 * sin(radians(c_custkey % 360))')} AS cd21, {s6('0.25 * cos(radians(c_custkey % 360))')} AS cd22 FROM customer""")
def wcs_create(spark, sf):
    cd = sky.make_cd(-0.5, 0.25, (F.col("c_custkey") % 360).cast("double"))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), *[r6(c).alias(n) for c, n in zip(cd, ("cd11", "cd12", "cd21", "cd22"))])


@query("safe_name", r"""SELECT page_id, trim(substr(regexp_replace(url, '[^\p{L}\p{N} _.-]', '_', 'g'), 1, 64)) AS name FROM pages""")
def safe_name(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.safe_name(F.col("url")).alias("name"))


WORDS = "CASE p_partkey % 9 WHEN 0 THEN ' Dark ' WHEN 1 THEN 'FLAT FIELD' WHEN 2 THEN 'Bias' WHEN 3 THEN 'Light Frame' WHEN 4 THEN 'bias frame' WHEN 5 THEN 'zero' WHEN 6 THEN p_type WHEN 7 THEN 'science' ELSE NULL END"
CLASS = f"""cls AS (SELECT p_partkey, CASE WHEN w IN ('dark', 'dark frame', 'darkframe', 'bias frame', 'biasframe') THEN 'dark' WHEN w IN ('flat', 'flat field', 'flatfield', 'flat frame', 'flatframe') THEN 'flat'
    WHEN w IN ('bias', 'offset', 'zero') THEN 'bias' WHEN w IN ('light', 'light frame', 'lightframe', 'science') THEN 'light' ELSE 'unknown' END AS frame_type
    FROM (SELECT p_partkey, lower(trim({WORDS})) AS w FROM part))"""


def classified(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.classify_frame_type(F.expr(WORDS)).alias("frame_type"))


@query("classify_frame_type", f"WITH {CLASS} SELECT * FROM cls")
def classify_frame_type(spark, sf):
    return classified(spark, sf)


@query("type_counts", f"WITH {CLASS} SELECT frame_type, count(*) AS n, CAST(list_position(['light', 'dark', 'flat', 'bias', 'unknown'], frame_type) AS BIGINT) AS pos FROM cls GROUP BY frame_type")
def type_counts(spark, sf):
    order = F.array(*map(F.lit, ("light", "dark", "flat", "bias", "unknown")))
    return classified(spark, sf).groupBy("frame_type").agg(F.count(F.lit(1)).alias("n")).withColumn("pos", F.array_position(order, F.col("frame_type"))).orderBy("pos")


@query("frame_selection", f"""WITH {ENTRIES}, s AS (SELECT idx, event_type, coalesce(quality, 0.0) AS score FROM entries),
    r AS (SELECT *, row_number() OVER (PARTITION BY event_type, score < 0.7 ORDER BY score DESC, idx) AS nth, sum(CASE WHEN score < 0.7 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type) - floor(count(*) OVER (PARTITION BY event_type) * 0.6) AS excess FROM s)
    SELECT idx, score >= 0.7 OR nth <= excess AS kept FROM r""")
def frame_selection(spark, sf):
    s = entries(spark, sf).select("idx", "event_type", F.coalesce("quality", F.lit(0.0)).alias("score"))
    return T.select_frames(s, 0.7, 0.6, ["event_type"]).select("idx", "kept")


@query("quality_threshold", f"WITH {ENTRIES} SELECT idx, CASE WHEN quality IS NULL THEN selected ELSE quality >= 0.4505 END AS selected FROM entries")
def quality_threshold(spark, sf):
    return T.quality_threshold(entries(spark, sf), 0.4505).select("idx", "selected")


@query("name_filter", f"WITH {ENTRIES} SELECT idx, path FROM entries WHERE contains(lower(split_part(path, '/', 4)), '77.f')")
def name_filter(spark, sf):
    return T.name_filter(entries(spark, sf), "77.F").select("idx", "path")


@query("selection_toggle", f"WITH {ENTRIES} SELECT idx, NOT selected AS selected FROM entries")
def selection_toggle(spark, sf):
    return T.toggle(entries(spark, sf), "invert").select("idx", "selected")


@query("validate_project", f"""WITH {ENTRIES}, {LIBRARY}, gone AS (SELECT idx, split_part(path, '/', 4) AS b FROM entries WHERE selected AND idx % 50 = 1), top AS (SELECT string_agg(b, ', ' ORDER BY idx) AS names FROM (SELECT * FROM gone ORDER BY idx LIMIT 3))
    SELECT 'warning' AS level, 'MISSING_LIGHT_FILES' AS code, n, names || CASE WHEN n > 3 THEN ' (+' || CAST(n - 3 AS VARCHAR) || ')' ELSE '' END AS detail FROM (SELECT count(*) AS n FROM gone), top WHERE n > 0
    UNION ALL SELECT 'warning', 'MISSING_' || upper(frame_type) || '_FILES', count(*), split_part(arg_min(path, ord), '/', 3) FROM lib WHERE ord % 10 = 3 GROUP BY frame_type""")
def validate_project(spark, sf):
    e, lib = entries(spark, sf), library(spark, sf).where("ord % 10 = 3").selectExpr("frame_type as kind", "path", "ord")
    return T.validate(e, e.where("idx % 50 <> 1"), lib)


@query("tier_filter", """SELECT c_custkey, c_custkey % 4 AS tier FROM customer WHERE c_custkey % 4 <= 2 AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)""")
def tier_filter(spark, sf):
    ranks = spark.createDataFrame([("free", 0), ("basic", 1), ("pro", 2), ("max", 3)], "tier_name string, rank int")
    c = table(spark, sf, "customer").selectExpr("c_custkey", "c_nationkey", "c_custkey % 4 as tier").join(F.broadcast(ranks), F.col("tier") == F.col("rank")).where("rank <= 2")
    return c.join(table(spark, sf, "nation").where("n_regionkey = 1"), F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select("c_custkey", "tier")


@query("license_status", """WITH l AS (SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE (c_custkey % 12) * 86400 - 7200 END AS age, c_custkey % 8 <> 0 AS machine_ok, c_custkey % 60 AS starts FROM customer)
    SELECT c_custkey, CASE WHEN age IS NULL THEN 'not_activated' WHEN NOT machine_ok THEN 'machine_mismatch' WHEN age < -60 THEN 'time_rollback' WHEN floor(age / 86400) >= 7 THEN 'grace_expired' WHEN starts >= 50 THEN 'start_limit' ELSE 'valid' END AS status FROM l""")
def license_status(spark, sf):
    rows = table(spark, sf, "customer").selectExpr("c_custkey", "timestamp'2024-06-01 00:00:00' as now", "case when c_custkey % 9 = 0 then null else timestamp_seconds(unix_timestamp(timestamp'2024-06-01 00:00:00') - ((c_custkey % 12) * 86400 - 7200)) end as last_online", "cast(null as timestamp) as attested", "c_custkey % 8 <> 0 as machine_ok", "c_custkey % 60 as starts")
    return T.license_status(rows).select("c_custkey", "status")


def dims(a, b):
    return f"CASE WHEN NOT ({a}.width > 0 AND {b}.width > 0) THEN 0.0 WHEN {a}.width = {b}.width AND {a}.height = {b}.height THEN 2.0 ELSE -1e300 END"


SCORE = f"""coalesce(CASE WHEN abs(a.exposure - b.exposure) < 0.01 THEN 10.0 ELSE -abs(a.exposure - b.exposure) END, 0.0) + coalesce(CASE WHEN a.gain = b.gain THEN 5.0 WHEN a.gain <> b.gain THEN -2.0 END, 0.0)
    + coalesce(CASE WHEN abs(a.temperature - b.temperature) < 2 THEN 3.0 ELSE -0.5 * abs(a.temperature - b.temperature) END, 0.0) + {dims('a', 'b')}"""
BEST = f"""best AS (SELECT * FROM (SELECT a.light_id, b.ord, b.path, b.frame_type, {SCORE} AS score FROM lights a, lib b) WHERE score > 0)"""


@query("calibration_best_match", f"""WITH {LIGHTS}, {LIBRARY}, {BEST} SELECT light_id, ord, path, {s6('CAST(score AS DOUBLE)')} AS score FROM best QUALIFY row_number() OVER (PARTITION BY light_id ORDER BY score DESC, ord) = 1""")
def calibration_best_match(spark, sf):
    return T.best_match(lights(spark, sf), library(spark, sf)).select("light_id", "ord", "path", r6("score").alias("score"))


MATCHES = f"""{LIGHTS}, {LIBRARY}, {BEST}, one AS (SELECT light_id, frame_type, path FROM best QUALIFY row_number() OVER (PARTITION BY light_id, frame_type ORDER BY score DESC, ord) = 1),
    matches AS (SELECT light_id, d.path AS dark, f.path AS flat FROM lights LEFT JOIN (SELECT * FROM one WHERE frame_type = 'dark') d USING (light_id) LEFT JOIN (SELECT * FROM one WHERE frame_type = 'flat') f USING (light_id))"""


@query("calibration_coverage", f"""WITH {MATCHES} SELECT count(*) AS n, {s6('avg(CAST(dark IS NOT NULL AS DOUBLE))')} AS dark_coverage, {s6('avg(CAST(flat IS NOT NULL AS DOUBLE))')} AS flat_coverage,
    {s6('avg(CAST(dark IS NOT NULL AND flat IS NOT NULL AS DOUBLE))')} AS coverage FROM matches""")
def calibration_coverage(spark, sf):
    c = T.coverage(T.batch_match(lights(spark, sf), library(spark, sf)))
    return c.select("n", *[r6(k).alias(k) for k in ("dark_coverage", "flat_coverage", "coverage")])


@query("calibration_config", f"""WITH {MATCHES}, long AS (SELECT light_id, 'dark' AS kind, dark AS path FROM matches UNION ALL SELECT light_id, 'flat', flat FROM matches)
    SELECT kind, path, first, CAST(row_number() OVER (PARTITION BY kind ORDER BY first, path) AS INTEGER) AS pos FROM (SELECT kind, path, min(light_id) AS first FROM long WHERE path IS NOT NULL GROUP BY kind, path)""")
def calibration_config(spark, sf):
    return T.suggested_paths(T.batch_match(lights(spark, sf), library(spark, sf)))


@query("license_lookup", """SELECT o_orderkey AS machine, c_custkey AS license, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def license_lookup(spark, sf):
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).selectExpr("o_orderkey as machine", "c_custkey as license", "n_name")


@query("project_summary", f"""WITH {ENTRIES} SELECT count(*) AS total_frames, count(*) FILTER (selected) AS selected_count, {s6('sum(exposure) FILTER (selected)')} AS total_exposure, count(quality) FILTER (selected) AS scored_count,
    {s6('avg(quality) FILTER (selected)')} AS quality_mean, min(quality) FILTER (selected) AS quality_min, max(quality) FILTER (selected) AS quality_max, min(temperature) FILTER (selected) AS temp_min, max(temperature) FILTER (selected) AS temp_max FROM entries""")
def project_summary(spark, sf):
    s = T.project_summary(entries(spark, sf))
    return s.withColumns({"total_exposure": r6("total_exposure"), "quality_mean": r6("quality_mean")})


@query("exposure_groups", f"""WITH {ENTRIES} SELECT round_even(exposure, 2) AS exposure_s, count(*) AS n FROM entries WHERE selected AND exposure IS NOT NULL GROUP BY 1""")
def exposure_groups(spark, sf):
    return T.exposure_groups(entries(spark, sf))


@query("exposure_hms", """WITH s AS (SELECT event_id, CAST(floor(value * 97) AS BIGINT) AS t FROM events WHERE value >= 0)
    SELECT event_id, CASE WHEN t >= 3600 THEN CAST(t // 3600 AS VARCHAR) || 'h ' ELSE '' END || CASE WHEN t >= 60 THEN CAST(t % 3600 // 60 AS VARCHAR) || 'm ' ELSE '' END || CAST(t % 60 AS VARCHAR) || 's' AS hms FROM s""")
def exposure_hms(spark, sf):
    return table(spark, sf, "events").where("value >= 0").select("event_id", text.hms(F.col("value") * 97).alias("hms"))


@query("cache_stats", """SELECT event_type AS catalog, count(*) AS entries, sum(user_id) AS hits FROM events GROUP BY event_type""")
def cache_stats(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("catalog")).agg(F.count(F.lit(1)).alias("entries"), F.sum("user_id").alias("hits"))


def timings(spark, sf):
    return table(spark, sf, "events").selectExpr("event_type as step", "ts as seq", "event_id as ord", "value as duration")


ETA = "eta AS (SELECT event_type AS step, avg(value) AS eta, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS nth FROM events) WHERE nth <= 5 GROUP BY 1)"


@query("step_eta", f"WITH {ETA} SELECT step, {s6('eta')} AS eta, n FROM eta")
def step_eta(spark, sf):
    return T.step_eta(timings(spark, sf)).select("step", r6("eta").alias("eta"), "n")


@query("remaining_eta", f"WITH {ETA} SELECT {s6('sum(eta)')} AS remaining, count(*) AS pending FROM eta WHERE step <> 'error'")
def remaining_eta(spark, sf):
    t = timings(spark, sf)
    return T.remaining_eta(t.where("step <> 'error'").select("step").distinct(), T.step_eta(t)).select(r6("remaining").alias("remaining"), "pending")


@query("atlas_confidence", f"""SELECT q.p_partkey AS k, {s6('CASE WHEN n = 0 THEN s * 0.3 ELSE least(s * 0.6 + least(n / 5.0, 1.0) * 0.4, 1.0) END')} AS confidence FROM
    (SELECT p_partkey, p_partkey % 8 AS n, CASE WHEN p_partkey % 7 = 0 THEN 0.5 WHEN p_partkey % 24 * 0.5 <= 0.5 THEN 1.0 WHEN p_partkey % 24 * 0.5 >= 10 THEN 0.1 ELSE greatest(0.1, 1 - (p_partkey % 24 * 0.5 - 0.5) / 9.5) END AS s FROM part) q""")
def atlas_confidence(spark, sf):
    rms = F.expr("case when p_partkey % 7 = 0 then null else p_partkey % 24 * 0.5D end")
    quality = F.when(rms.isNull(), 0.5).when(rms <= 0.5, 1.0).when(rms >= 10, 0.1).otherwise(F.greatest(F.lit(0.1), 1 - (rms - 0.5) / 9.5))
    n = F.col("p_partkey") % 8
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k"), r6(F.when(n == 0, quality * 0.3).otherwise(F.least(quality * 0.6 + F.least(n / 5.0, F.lit(1.0)) * 0.4, F.lit(1.0)))).alias("confidence"))


@query("rolling_eta", f"SELECT event_id, {s6('avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)')} AS rolling FROM events")
def rolling_eta(spark, sf):
    return T.rolling_mean(timings(spark, sf)).select(F.col("ord").alias("event_id"), r6("rolling").alias("rolling"))


@query("stage_transitions", """SELECT event_id, previous, event_type FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events) WHERE previous IS NULL OR previous <> event_type""")
def stage_transitions(spark, sf):
    log = table(spark, sf, "events").selectExpr("event_id as ord", "user_id as run", "ts as seq", "event_type as stage")
    return T.stage_transitions(log).selectExpr("ord as event_id", "previous", "stage as event_type")


@query("step_states", """WITH e AS (SELECT *, CASE event_type WHEN 'error' THEN '' WHEN 'click' THEN CAST(event_id % 9 AS VARCHAR) END AS a FROM events)
    SELECT event_id, nullif(last_value(a IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), '') AS active FROM e""")
def step_states(spark, sf):
    log = table(spark, sf, "events").selectExpr("event_id as ord", "user_id as run", "ts as seq", "case event_type when 'error' then 'reset' when 'click' then 'advance' else 'other' end as op", "cast(event_id % 9 as string) as step")
    return T.step_states(log).selectExpr("ord as event_id", "active")


@query("frame_sort", f"WITH {ENTRIES} SELECT idx, row_number() OVER (ORDER BY coalesce(quality, -1) DESC, idx) AS pos FROM entries")
def frame_sort(spark, sf):
    return T.frame_ranks(entries(spark, sf), "quality", descending=True).select("idx", "pos")


@query("set_new_paths", f"WITH {ENTRIES} SELECT path FROM entries WHERE user_id % 2 = 0 EXCEPT SELECT path FROM entries WHERE idx % 6 = 0")
def set_new_paths(spark, sf):
    e = entries(spark, sf)
    return e.where("user_id % 2 = 0").select("path").distinct().exceptAll(e.where("idx % 6 = 0").select("path").distinct())


@query("path_parts", f"""WITH {ENTRIES} SELECT idx, split_part(path, '/', 4) AS name, '.fits' AS suffix, split_part(split_part(path, '/', 4), '.', 1) AS stem FROM entries""")
def path_parts(spark, sf):
    p = F.col("path")
    return entries(spark, sf).select("idx", text.basename(p).alias("name"), text.suffix(p).alias("suffix"), text.stem(p).alias("stem"))


@query("cache_key", f"""WITH {SKY} SELECT k, sha256('gaia|' || printf('%.4f', ra) || '|' || printf('%.4f', dec) || '|' || printf('%.5f', 0.25) || '|' || CAST(k % 3 AS VARCHAR)) AS key FROM sky""")
def cache_key(spark, sf):
    return sky_table(spark, sf).select("k", text.cache_key(F.lit("gaia"), F.col("ra"), F.col("dec"), F.lit(0.25), (F.col("k") % 3).cast("string")).alias("key"))


@query("json_extract", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, coalesce(json_extract_string(props, '$.absent'), 'none') AS absent FROM events""")
def json_extract(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"), F.coalesce(F.get_json_object("props", "$.absent"), F.lit("none")).alias("absent"))


SEATS = """lic AS (SELECT c_custkey, 1 + c_custkey % 2 AS seats_max, c_custkey % 10 = 0 AS revoked, coalesce(m, CAST([] AS VARCHAR[])) AS machines, 'm' || CAST(c_custkey % 5 AS VARCHAR) AS machine FROM customer LEFT JOIN
    (SELECT o_custkey, list(DISTINCT 'm' || CAST(o_orderkey % 7 AS VARCHAR) ORDER BY 'm' || CAST(o_orderkey % 7 AS VARCHAR)) AS m FROM orders WHERE o_orderkey % 5 = 0 GROUP BY 1) ON c_custkey = o_custkey)"""


def licences(spark, sf):
    m = table(spark, sf, "orders").where("o_orderkey % 5 = 0").groupBy("o_custkey").agg(F.sort_array(F.collect_set(F.concat(F.lit("m"), F.col("o_orderkey") % 7))).alias("m"))
    return table(spark, sf, "customer").join(m, F.col("c_custkey") == F.col("o_custkey"), "left").selectExpr("c_custkey", "1 + c_custkey % 2 as seats_max", "c_custkey % 10 = 0 as revoked", "coalesce(m, array()) as machines", "concat('m', c_custkey % 5) as machine")


@query("array_seats", f"""WITH {SEATS} SELECT c_custkey, len(machines) AS n, list_contains(machines, machine) AS known, array_to_string(list_filter(machines, lambda x: x <> machine), ',') AS without FROM lic""")
def array_seats(spark, sf):
    return licences(spark, sf).select("c_custkey", F.size("machines").cast("bigint").alias("n"), F.array_contains("machines", F.col("machine")).alias("known"), F.array_join(F.array_remove(F.array_distinct("machines"), F.col("machine")), ",").alias("without"))


@query("seat_activation", f"""WITH {SEATS} SELECT c_custkey, status, array_to_string(CASE WHEN status = 'activated' THEN list_append(machines, machine) ELSE machines END, ',') AS machines FROM
    (SELECT *, CASE WHEN revoked THEN 'gone' WHEN list_contains(machines, machine) THEN 'active' WHEN len(machines) >= seats_max THEN 'conflict' ELSE 'activated' END AS status FROM lic)""")
def seat_activation(spark, sf):
    return T.seat_activation(licences(spark, sf)).select("c_custkey", "status", F.array_join("machines", ",").alias("machines"))


@query("cache_replay", """WITH o AS (SELECT event_id, user_id, epoch(ts) AS t, event_type FROM events WHERE event_type IN ('click', 'view')),
    p AS (SELECT *, last_value(CASE WHEN event_type = 'click' THEN floor(t) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY floor(t), event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS put FROM o)
    SELECT event_id, coalesce(floor(t) - put <= 86400, false) AS hit FROM p WHERE event_type = 'view'""")
def cache_replay(spark, sf):
    ops = table(spark, sf, "events").where("event_type in ('click', 'view')").selectExpr("event_id as ord", "user_id as key", "unix_timestamp(cast(ts as timestamp)) as ts", "case event_type when 'click' then 'put' else 'get' end as op")
    return T.cache_replay(ops, 86_400).selectExpr("ord as event_id", "hit")


@query("ridge_zero_point", f"""WITH s AS (SELECT event_type, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x*x) AS sxx, sum(x*y) AS sxy, sum(y*y) AS syy FROM (SELECT event_type, value AS x, 2 * value + user_id % 10 AS y FROM events) GROUP BY 1),
    c AS (SELECT event_type, n, sx / n AS mx, sy / n AS my, sxx - sx*sx/n AS cxx, sxy - sx*sy/n AS cxy, syy - sy*sy/n AS cyy FROM s)
    SELECT event_type, n, {s6('cxy / (cxx + 1)')} AS slope, {s6('my - cxy / (cxx + 1) * mx')} AS intercept, {s6('1 - (cyy - 2 * cxy / (cxx + 1) * cxy + pow(cxy / (cxx + 1), 2) * cxx) / cyy')} AS r2 FROM c""")
def ridge_zero_point(spark, sf):
    pairs = table(spark, sf, "events").selectExpr("event_type", "value as x", "2 * value + user_id % 10 as y")
    fit = T.magnitude_fit(pairs, ["event_type"])
    return fit.select("event_type", "n", *[r6(c).alias(c) for c in ("slope", "intercept", "r2")])


@query("positional_join", """WITH a AS (SELECT c_custkey AS left_key, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS pos FROM customer),
    b AS (SELECT c_custkey AS right_key, c_nationkey AS nation, row_number() OVER (ORDER BY c_nationkey DESC, c_custkey) - 1 AS pos FROM customer)
    SELECT pos, left_key, right_key, nation FROM a JOIN b USING (pos)""")
def positional_join(spark, sf):
    c = table(spark, sf, "customer")
    left = c.select(F.col("c_custkey").alias("left_key"), "c_acctbal")
    right = c.select(F.col("c_custkey").alias("right_key"), F.col("c_nationkey").alias("nation"))
    return T.positional_join(left, right, ["c_acctbal", "left_key"], [F.desc("nation"), F.col("right_key")]).select("pos", "left_key", "right_key", "nation")


@query("token_claims", """WITH c AS (SELECT c_custkey AS k, c_custkey % 5 AS m FROM customer)
    SELECT k, CASE WHEN m < 3 THEN 'user-' || CAST(k AS VARCHAR) || '?é' END AS sub, CASE WHEN m < 4 THEN 'j' || CAST(k AS VARCHAR) END AS jti, CAST(CASE WHEN m < 4 THEN k * 10 END AS DOUBLE) AS exp,
        CAST(CASE WHEN m < 4 THEN CASE WHEN k % 2 = 0 THEN 3 ELSE 1 END END AS INTEGER) AS seats_max, CASE m WHEN 3 THEN 'missing sub' WHEN 4 THEN 'malformed' ELSE CASE WHEN k * 10 <= 900 THEN 'expired' END END AS problem FROM c""")
def token_claims(spark, sf):
    c = table(spark, sf, "customer").selectExpr("c_custkey as k", "c_custkey % 5 as m")
    payload = F.expr("""concat('{', if(m = 3, '', concat('"sub":"user-', k, '?é",')), '"jti":"j', k, '","iat":5,"exp":', k * 10, ',"tier":"pro","machine_id":"m"', if(k % 2 = 0, ',"seats_max":3', ''), '}')""")
    token = F.when(F.col("m") == 4, F.lit("only.two")).otherwise(F.concat_ws(".", F.lit("e30"), L.to_base64url(payload), F.lit("sig")))
    found = c.select("k", L.claims(token).alias("c"))
    return found.select("k", "c.sub", "c.jti", "c.exp", F.when(F.col("c.jti").isNotNull(), F.coalesce("c.seats_max", F.lit(1))).alias("seats_max"), L.problem(F.col("c"), L.TOKEN, F.lit(900.0)).alias("problem"))


@query("selected_existing", f"WITH {ENTRIES} SELECT idx FROM entries WHERE selected AND idx % 3 <> 1")
def selected_existing(spark, sf):
    e = entries(spark, sf)
    return T.selected_existing(e, e.where("idx % 3 <> 1").select("path")).select("idx")


@query("validation_summary", """WITH i AS (SELECT user_id, CASE event_id % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' END AS level FROM events WHERE user_id % 3 > 0 OR event_id % 4 > 1),
    n AS (SELECT user_id, count(*) FILTER (level = 'error') AS errors, count(*) FILTER (level = 'warning') AS warnings FROM i GROUP BY 1)
    SELECT user_id, errors, warnings, CASE WHEN errors = 0 AND warnings = 0 THEN 'Projekt OK' ELSE concat_ws(', ', CASE WHEN errors > 0 THEN CAST(errors AS VARCHAR) || ' Fehler' END, CASE WHEN warnings > 0 THEN CAST(warnings AS VARCHAR) || ' Warnung(en)' END) END AS summary FROM n""")
def validation_summary(spark, sf):
    issues = table(spark, sf, "events").where("user_id % 3 > 0 or event_id % 4 > 1").select("user_id", F.expr("case event_id % 4 when 0 then 'error' when 1 then 'warning' end").alias("level"))
    return T.validation_summary(issues, ["user_id"])


@query("alignment_counts", f"""WITH a AS (SELECT event_type, event_id % 1000 / 1000.0 AS confidence, event_id % 1000 >= 300 AS accepted FROM events)
    SELECT event_type, count(*) AS n, count(*) FILTER (accepted) AS aligned, count(*) FILTER (NOT accepted) AS skipped, {s6('CAST(avg(confidence) FILTER (accepted) AS DOUBLE)')} AS confidence, {s6('CAST(avg(confidence) FILTER (NOT accepted) AS DOUBLE)')} AS skipped_confidence FROM a GROUP BY 1""")
def alignment_counts(spark, sf):
    e = table(spark, sf, "events").selectExpr("event_type", "event_id % 1000 / 1000.0D as confidence", "event_id % 1000 >= 300 as accepted")
    return T.alignment_counts(e, ["event_type"]).select("event_type", "n", "aligned", "skipped", r6("confidence").alias("confidence"), r6("skipped_confidence").alias("skipped_confidence"))


@query("fwhm_histogram", f"""WITH e AS (SELECT user_id, min(value) AS lo, max(value) AS hi, CAST(least(count(*), 40) AS INTEGER) AS bins FROM events WHERE value IS NOT NULL GROUP BY 1),
    w AS (SELECT user_id, bins, CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS lo, (CASE WHEN lo = hi THEN 1.0 ELSE hi - lo END) / bins AS width FROM e),
    n AS (SELECT user_id, least(CAST(floor((value - lo) / width) AS INTEGER), bins - 1) AS bin, count(*) AS n FROM events JOIN w USING (user_id) WHERE value IS NOT NULL GROUP BY 1, 2)
    SELECT user_id, bin, {s6('lo + bin * width')} AS low, coalesce(n, 0) AS n FROM (SELECT *, CAST(unnest(range(bins)) AS INTEGER) AS bin FROM w) LEFT JOIN n USING (user_id, bin)""")
def fwhm_histogram(spark, sf):
    return T.value_histogram(table(spark, sf, "events"), ["user_id"], "value").select("user_id", "bin", r6("low").alias("low"), "n")
