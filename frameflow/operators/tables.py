"""Relational operators: calibration matching, selection, summaries, validation, caches, timings and licences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameflow.functions.text import basename
from frameflow.scratch import materialise

BROADCAST_ROWS = 200_000


def hinted(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``limit`` rows; else the join shuffles."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def match_score(a: str = "a", b: str = "b") -> Column:
    """How well a calibration frame fits a light; null metadata adds nothing, differing sizes exclude."""
    c = lambda t, n: F.col(f"{t}.{n}")
    d_exp, d_temp = F.abs(c(a, "exposure") - c(b, "exposure")), F.abs(c(a, "temperature") - c(b, "temperature"))
    exposure = F.when(d_exp < 0.01, 10.0).otherwise(-d_exp)
    gain = F.when(c(a, "gain") == c(b, "gain"), 5.0).otherwise(F.when(c(a, "gain").isNotNull() & c(b, "gain").isNotNull(), -2.0))
    temperature = F.when(d_temp < 2, 3.0).otherwise(d_temp * -0.5)
    sized = (c(a, "width") > 0) & (c(b, "width") > 0)
    size = F.when(~sized, 0.0).when((c(a, "width") == c(b, "width")) & (c(a, "height") == c(b, "height")), 2.0).otherwise(float("-inf"))
    zero = F.lit(0.0)
    return F.coalesce(exposure, zero) + F.coalesce(gain, zero) + F.coalesce(temperature, zero) + F.coalesce(size, zero)


def best_match(lights: DataFrame, library: DataFrame) -> DataFrame:
    """Per light the library frame with the highest positive score, ties to the smallest ord; no row without one.

    Lights with equal metadata have equal matches, and of library frames with equal metadata the smallest ord wins, so the
    theta join runs over distinct metadata: the pairs grow with neither the lights nor the library frames a setting."""
    meta = ["exposure", "gain", "temperature", "width", "height"]
    kinds = lights.select(*meta).distinct()
    settings = library.groupBy(*meta).agg(F.min(F.struct("ord", "path")).alias("f")).select(F.col("f.ord").alias("ord"), F.col("f.path").alias("path"), *meta)
    pairs = kinds.alias("a").join(hinted(settings).alias("b"), match_score() > 0, "inner")
    best = pairs.groupBy(*[F.col(f"a.{c}").alias(f"k_{c}") for c in meta]).agg(F.min_by(F.struct("b.ord", "b.path"), F.struct(-match_score(), F.col("b.ord"))).alias("m"), F.max(match_score()).alias("score"))
    same = [lights[c].eqNullSafe(best[f"k_{c}"]) for c in meta]
    on = same[0]
    for s in same[1:]:
        on = on & s
    # best has no more rows than kinds, whose count needs no theta join
    found = F.broadcast(best) if kinds.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else best
    return lights.join(found, on).select(*[lights[c] for c in lights.columns], F.col("m.ord").alias("ord"), F.col("m.path").alias("path"), "score")


def batch_match(lights: DataFrame, library: DataFrame, match_bias: bool = False) -> DataFrame:
    """Per light the paths of its dark and flat (and bias, which is null unless asked for)."""
    out = lights.select("light_id")
    for kind in ("dark", "flat", "bias"):
        if kind == "bias" and not match_bias:
            out = out.withColumn("bias", F.lit(None).cast("string"))
            continue
        found = best_match(lights, library.where(F.col("frame_type") == kind)).select("light_id", F.col("path").alias(kind))
        out = out.join(found, "light_id", "left")
    return out


def coverage(matches: DataFrame) -> DataFrame:
    """Shares of lights with a dark, with a flat and with both; zero without lights."""
    share = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    dark, flat = F.col("dark").isNotNull(), F.col("flat").isNotNull()
    return matches.agg(F.count(F.lit(1)).alias("n"), share(dark).alias("dark_coverage"), share(flat).alias("flat_coverage"), share(dark & flat).alias("coverage"))


def suggested_paths(matches: DataFrame) -> DataFrame:
    """Distinct matched paths a kind, in order of the first light that has them."""
    long = matches.select("light_id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("path")) for k in ("dark", "flat", "bias")])).alias("e")).select("light_id", "e.*").where("path is not null")
    first = long.groupBy("kind", "path").agg(F.min("light_id").alias("first"))
    return first.withColumn("pos", F.row_number().over(Window.partitionBy("kind").orderBy("first", "path")))


def select_frames(scored: DataFrame, least: float, max_rejected: float, by: list[str] | None = None) -> DataFrame:
    """kept: score >= least, and the best of the others while more than int(n * max_rejected) would go; ties by idx."""
    if not by:
        return _select_all(scored, least, max_rejected)
    rejected = F.col("score") < least
    every = Window.partitionBy(*by)
    excess = F.sum(rejected.cast("int")).over(every) - F.floor(F.count(F.lit(1)).over(every) * max_rejected)
    nth = F.row_number().over(Window.partitionBy(*by, rejected).orderBy(F.desc("score"), "idx"))
    return scored.withColumn("kept", ~rejected | (nth <= excess))


def frame_stats(entries: DataFrame) -> DataFrame:
    """The statistics table of a frame list as text: fixed decimals, empty for nulls, 1 or 0 for selected."""
    number = lambda f, c: F.when(F.col(c).isNull(), "").otherwise(F.format_string(f, F.col(c).cast("double")))
    return entries.select(
        basename(F.col("path")).alias("filename"), "path", number("%.3f", "exposure").alias("exposure_s"), F.coalesce(F.col("gain_iso").cast("string"), F.lit("")).alias("gain_iso"),
        number("%.1f", "temperature").alias("temperature_c"), number("%.4f", "quality").alias("quality_score"), F.when(F.col("selected"), "1").otherwise("0").alias("selected"),
    )


def _select_all(scored: DataFrame, least: float, max_rejected: float) -> DataFrame:
    """``select_frames`` over all rows: counts come from an aggregate, and only rejected rows are ranked, by ranges."""
    n, gone = scored.agg(F.count(F.lit(1)), F.count_if(F.col("score") < least)).first()
    back = gone - int(n * max_rejected)
    if back <= 0:
        return scored.withColumn("kept", F.coalesce(F.col("score") >= least, F.lit(True)))
    low = frame_ranks(scored.where(F.col("score") < least), "score", descending=True)
    return low.withColumn("kept", F.col("pos") <= back).drop("pos").unionByName(scored.where(F.coalesce(F.col("score") >= least, F.lit(True))).withColumn("kept", F.lit(True)))


def quality_threshold(entries: DataFrame, least: float) -> DataFrame:
    return entries.withColumn("selected", F.when(F.col("quality").isNull(), F.col("selected")).otherwise(F.col("quality") >= least))


def name_filter(entries: DataFrame, pattern: str) -> DataFrame:
    return entries.where(F.contains(F.lower(basename(F.col("path"))), F.lit(pattern.lower())))


def toggle(entries: DataFrame, how: str) -> DataFrame:
    """Select 'all', 'none' or 'invert'."""
    return entries.withColumn("selected", {"all": F.lit(True), "none": F.lit(False), "invert": ~F.col("selected")}[how])


def frame_sort(entries: DataFrame, key: str, descending: bool = False) -> DataFrame:
    """Stable: ties by idx. Null numbers count as -1, names go by lower case."""
    c = F.lower(basename(F.col("path"))) if key == "name" else F.coalesce(F.col(key), F.lit(-1.0))
    return entries.orderBy(c.desc() if descending else c.asc(), "idx")


def frame_ranks(entries: DataFrame, key: str, descending: bool = False, ranges: int = 32, sample: int = 20_000) -> DataFrame:
    """Every entry with its position ``pos`` (from 1) in the order of ``frame_sort``; idx is unique.

    A sample of bounded size gives the ranges' bounds, which are pairs (key, idx), so that equal keys are spread too.
    Rows are ranked within their range and moved on by the number of rows in the ranges before; no window holds all."""
    keyed = entries.withColumn("__k", F.lower(basename(F.col("path"))) if key == "name" else F.coalesce(F.col(key), F.lit(-1.0)))
    order = [F.col("__k").desc() if descending else F.col("__k").asc(), F.col("idx").asc()]
    n = entries.count()
    share = int(min(1.0, sample / max(1, n)) * (1 << 30))
    some = keyed.where(F.pmod(F.xxhash64("idx"), F.lit(1 << 30)) < max(share, 1)).where("__k is not null").select("__k", "idx").limit(2 * sample).orderBy(*order).collect()
    bounds = [some[len(some) * r // ranges] for r in range(1, ranges)] if some else []
    after = lambda k, i: ((F.col("__k") < k) if descending else (F.col("__k") > k)) | ((F.col("__k") == k) & (F.col("idx") > i))
    place = F.lit(0)
    for b in bounds:
        place = place + F.coalesce(after(F.lit(b["__k"]), F.lit(b["idx"])), F.lit(descending)).cast("int")  # nulls: first, or last if descending
    placed = keyed.withColumn("__range", place)
    sizes = {r["__range"]: r["count"] for r in placed.groupBy("__range").count().collect()}
    starts, total = [], 0
    for r in range(len(bounds) + 1):
        starts.append(total)
        total += sizes.get(r, 0)
    start = F.element_at(F.array(*[F.lit(v).cast("bigint") for v in starts]), F.col("__range") + 1)
    return placed.withColumn("pos", F.row_number().over(Window.partitionBy("__range").orderBy(*order)) + start).drop("__k", "__range")


def positions(df: DataFrame, order: list) -> tuple[DataFrame, int]:
    """``df`` with ``pos``, from 0, in the order of ``order`` (equal rows in any), and its number of rows.

    Sorted ranges are written once; a row's position is its place in its range after the numbers of rows in the ranges
    before, of which one a range comes to the driver. No window holds all rows."""
    ranged = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "ranges")
    part, before, starts = F.shiftright("__at", 33), 0, []
    for r in ranged.groupBy(part.alias("part")).count().orderBy("part").collect():
        starts.append((r["part"], before))
        before += r["count"]
    offsets = df.sparkSession.createDataFrame(starts, "__part bigint, __start bigint")
    placed = ranged.withColumn("__part", part).join(F.broadcast(offsets), "__part")  # a row a range
    return placed.withColumn("pos", F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at", "__part", "__start"), before


def positional_join(left: DataFrame, right: DataFrame, left_order: list, right_order: list, check: bool = True) -> DataFrame:
    """Rows of two tables side by side by their positions, each in its own order: pos, left's and right's columns. Unequal
    lengths raise, unless ``check`` is off: then the longer one's last rows go."""
    a, n = positions(left, left_order)
    b, m = positions(right, right_order)
    if check and n != m:
        raise ValueError(f"a positional join needs equal lengths, not {n} and {m}")
    return a.join(b, "pos")


def new_paths(found: DataFrame, existing: DataFrame) -> DataFrame:
    """Paths that aren't there yet, once each."""
    return found.join(existing.select("path"), "path", "left_anti").dropDuplicates(["path"])


def validate(entries: DataFrame, present: DataFrame, calibration: DataFrame, output_ok: bool = True) -> DataFrame:
    """Issues (level, code, n, detail): no frames, none selected, missing lights and calibration files, missing folder.

    ``calibration`` has kind, path and ord; details name the first three missing lights, or the first missing file."""
    selected = entries.where("selected")
    missing = selected.join(present.select("path"), "path", "left_anti")
    none = entries.agg(F.count(F.lit(1)).alias("n"), F.count_if("selected").alias("s"))
    rules = [
        none.where("n = 0").selectExpr("'error' as level", "'NO_FRAMES' as code", "n", "cast(null as string) as detail"),
        none.where("n > 0 and s = 0").selectExpr("'error' as level", "'NO_SELECTED_FRAMES' as code", "n", "cast(null as string) as detail"),
    ]
    top = missing.orderBy("idx").limit(3).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", basename(F.col("path")).alias("b")))), lambda s: s["b"]), ", ").alias("names"))
    count = missing.agg(F.count(F.lit(1)).alias("n"))
    rules.append(count.crossJoin(top).where("n > 0").select(F.lit("warning").alias("level"), F.lit("MISSING_LIGHT_FILES").alias("code"), "n", F.concat("names", F.when(F.col("n") > 3, F.concat(F.lit(" (+"), F.col("n") - 3, F.lit(")"))).otherwise("")).alias("detail")))
    gone = calibration.join(present.select("path"), "path", "left_anti").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min_by("path", "ord").alias("p"))
    rules.append(gone.select(F.lit("warning").alias("level"), F.concat(F.lit("MISSING_"), F.upper("kind"), F.lit("_FILES")).alias("code"), "n", basename(F.col("p")).alias("detail")))
    if not output_ok:
        rules.append(none.selectExpr("'warning' as level", "'OUTPUT_DIR_MISSING' as code", "1L as n", "cast(null as string) as detail"))
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out


def project_summary(entries: DataFrame) -> DataFrame:
    """One row of counts, total exposure, quality and temperature ranges over selected frames."""
    s = F.col("selected")
    on = lambda c: F.when(s, F.col(c))
    return entries.agg(
        F.count(F.lit(1)).alias("total_frames"), F.count_if(s).alias("selected_count"), F.coalesce(F.sum(on("exposure")), F.lit(0.0)).alias("total_exposure"), F.count(on("quality")).alias("scored_count"),
        F.avg(on("quality")).alias("quality_mean"), F.min(on("quality")).alias("quality_min"), F.max(on("quality")).alias("quality_max"), F.min(on("temperature")).alias("temp_min"), F.max(on("temperature")).alias("temp_max"),
    )


def exposure_groups(entries: DataFrame) -> DataFrame:
    return entries.where("selected and exposure is not null").groupBy(F.bround("exposure", 2).alias("exposure_s")).agg(F.count(F.lit(1)).alias("n"))


def selected_existing(entries: DataFrame, present: DataFrame) -> DataFrame:
    """Selected frames whose path is among ``present``."""
    return entries.where("selected").join(present.select("path"), "path", "left_semi")


def partition_by_type(frames: DataFrame) -> dict[str, DataFrame]:
    """A scan's frames by their type, of which there are a handful."""
    kinds = [r[0] for r in frames.select("frame_type").distinct().orderBy("frame_type").collect()]
    return {k: frames.where(F.col("frame_type") == k) for k in kinds}


def validation_summary(issues: DataFrame, by: list[str]) -> DataFrame:
    """Per group of ``by`` (those of ``issues`` with a level or null): whether it has errors and warnings, and how many, in
    words."""
    n = lambda level: F.count_if(F.col("level") == level)
    made = issues.groupBy(*by).agg(n("error").alias("errors"), n("warning").alias("warnings"))
    # The words of the summary.
    parts = F.array_compact(F.array(F.when(F.col("errors") > 0, F.concat(F.col("errors").cast("string"), F.lit(" Fehler"))), F.when(F.col("warnings") > 0, F.concat(F.col("warnings").cast("string"), F.lit(" Warnung(en)")))))
    return made.select(*by, "errors", "warnings", F.when(F.size(parts) == 0, "Projekt OK").otherwise(F.array_join(parts, ", ")).alias("summary"))


def alignment_counts(aligned: DataFrame, by: list[str]) -> DataFrame:
    """Per group how many frames were aligned (accepted) and left out, and the mean confidence of each."""
    ok = F.col("accepted")
    return aligned.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("aligned"), F.count_if(~ok).alias("skipped"), F.avg(F.when(ok, F.col("confidence"))).alias("confidence"), F.avg(F.when(~ok, F.col("confidence"))).alias("skipped_confidence"))


def value_histogram(values: DataFrame, by: list[str], value: str, most: int = 40) -> DataFrame:
    """Per group the counts of min(n, ``most``) bins of equal width from its least to its largest value, which the last bin
    holds too; one value's bins reach half a unit to each side. Empty bins have rows."""
    known = values.where(F.col(value).isNotNull())
    ends = known.groupBy(*by).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"), F.least(F.count(F.lit(1)), F.lit(most)).cast("int").alias("bins"))
    flat = F.col("__lo") == F.col("__hi")
    ends = ends.withColumns({"lo": F.when(flat, F.col("__lo") - 0.5).otherwise(F.col("__lo")), "width": F.when(flat, F.lit(1.0)).otherwise(F.col("__hi") - F.col("__lo")) / F.col("bins")}).drop("__lo", "__hi")
    placed = known.join(ends, by).withColumn("bin", F.least(F.floor((F.col(value) - F.col("lo")) / F.col("width")).cast("int"), F.col("bins") - 1))
    counts = placed.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
    every = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)))
    return every.join(counts, [*by, "bin"], "left").select(*by, "bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("low"), F.coalesce("n", F.lit(0)).alias("n"))


def license_status(records: DataFrame, grace_days: int = 7, max_starts: int = 50) -> DataFrame:
    """The first rule that fails, in order: activation, machine, clock rollback over 60 s, grace period, starts."""
    last = F.coalesce("attested", "last_online")
    age = F.unix_timestamp("now") - F.unix_timestamp(last)
    status = (
        F.when(last.isNull(), "not_activated").when(~F.col("machine_ok"), "machine_mismatch").when(age < -60, "time_rollback")
        .when(F.floor(age / 86_400) >= grace_days, "grace_expired").when(F.col("starts") >= max_starts, "start_limit").otherwise("valid")
    )
    return records.withColumn("status", status)


def price_tier(price: Column, tiers: dict[str, str], default: str = "free") -> Column:
    out = F.lit(default)
    for p, t in tiers.items():
        out = F.when(price == p, t).otherwise(out)
    return out


def mru(log: DataFrame, n: int = 10) -> DataFrame:
    """The n most recently seen paths with their rank; one total order over distinct paths, kept by a bounded top-n."""
    last = log.groupBy("path").agg(F.max("seq").alias("seq")).orderBy(F.desc("seq"), "path").limit(n)
    return last.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("seq"), "path")))


def step_eta(timings: DataFrame, last: int = 5) -> DataFrame:
    """Per step the mean of its last few durations (columns step, seq, ord, duration)."""
    nth = F.row_number().over(Window.partitionBy("step").orderBy(F.desc("seq"), F.desc("ord")))
    return timings.withColumn("nth", nth).where(F.col("nth") <= last).groupBy("step").agg(F.avg("duration").alias("eta"), F.count(F.lit(1)).alias("n"))


def remaining_eta(pending: DataFrame, etas: DataFrame) -> DataFrame:
    """The sum over pending steps; null if one is unknown."""
    met = pending.join(etas.select("step", "eta"), "step", "left")
    return met.agg(F.when(F.count("eta") == F.count(F.lit(1)), F.coalesce(F.sum("eta"), F.lit(0.0))).alias("remaining"), F.count(F.lit(1)).alias("pending"))


def cache_replay(ops: DataFrame, ttl_seconds: int) -> DataFrame:
    """Per get, whether a time-to-live cache hits: its key's last put is at most ``ttl_seconds`` old. Columns key, ts
    (seconds), ord, op ('put' or 'get'); a get after the expiry finds nothing until the next put."""
    w = Window.partitionBy("key").orderBy("ts", "ord").rowsBetween(Window.unboundedPreceding, -1)
    put = F.last(F.when(F.col("op") == "put", F.col("ts")), ignorenulls=True).over(w)
    return ops.withColumn("put_ts", put).where("op = 'get'").withColumn("hit", F.coalesce(F.col("ts") - F.col("put_ts") <= ttl_seconds, F.lit(False)))


def rolling_mean(timings: DataFrame, n: int = 5) -> DataFrame:
    return timings.withColumn("rolling", F.avg("duration").over(Window.partitionBy("step").orderBy("seq", "ord").rowsBetween(1 - n, 0)))


def stage_transitions(log: DataFrame) -> DataFrame:
    """Rows whose stage differs from the one before, per run."""
    w = Window.partitionBy("run").orderBy("seq", "ord")
    return log.withColumn("previous", F.lag("stage").over(w)).where("previous is null or previous <> stage")


def step_states(log: DataFrame) -> DataFrame:
    """After each event, the run's active step: the last 'advance', none since a 'reset'."""
    w = Window.partitionBy("run").orderBy("seq", "ord").rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumn("active", F.nullif(F.last(F.when(F.col("op") == "reset", "").when(F.col("op") == "advance", F.col("step")), ignorenulls=True).over(w), F.lit("")))


def seat_activation(licences: DataFrame) -> DataFrame:
    """Activation of ``machine``: (status, machines). A revoked licence is gone, a known machine stays, a full one conflicts."""
    known = F.array_contains("machines", F.col("machine"))
    full = F.size("machines") >= F.col("seats_max")
    status = F.when(F.col("revoked"), "gone").when(known, "active").when(full, "conflict").otherwise("activated")
    return licences.withColumn("status", status).withColumn("machines", F.when(F.col("status") == "activated", F.array_append("machines", F.col("machine"))).otherwise(F.col("machines")))


def magnitude_fit(pairs: DataFrame, by: list[str], alpha: float = 1.0) -> DataFrame:
    """Ridge line y ~ x per group with an unpenalised intercept: slope, intercept, r2."""
    n, sx, sy = F.count(F.lit(1)), F.sum("x"), F.sum("y")
    s = pairs.groupBy(*by).agg(n.alias("n"), sx.alias("sx"), sy.alias("sy"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("x") * F.col("y")).alias("sxy"), F.sum(F.col("y") * F.col("y")).alias("syy"))
    s = s.selectExpr(*by, "n", "sx / n as mx", "sy / n as my", "sxx - sx * sx / n as cxx", "sxy - sx * sy / n as cxy", "syy - sy * sy / n as cyy")
    s = s.withColumn("slope", F.col("cxy") / (F.col("cxx") + alpha))
    rss = F.col("cyy") - 2 * F.col("slope") * F.col("cxy") + F.col("slope") ** 2 * F.col("cxx")
    return s.select(*by, "n", "slope", (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"), F.when(F.col("cyy") > 0, 1 - rss / F.col("cyy")).otherwise(0.0).alias("r2"))
