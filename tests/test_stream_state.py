import datetime as dt
import os
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from frameflow.plans import builder
from frameflow.streaming import joins, progress, state, windows

SF = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, state.ROCKSDB)
    yield spark
    spark.conf.set(key, before)


def land(df, folder, name):
    """One Parquet file, put in place at once."""
    made = f"{folder}-made-{name}"
    os.makedirs(folder, exist_ok=True)
    df.coalesce(1).write.parquet(made)
    part = next(n for n in os.listdir(made) if n.startswith("part-"))
    os.replace(f"{made}/{part}", f"{folder}/{name}.parquet")


def drain(df, name, checkpoint, **trigger):
    """The rows that come out until the stream has seen all of its input."""
    rows = []
    q = df.writeStream.queryName(name).foreachBatch(lambda batch, _: rows.extend(batch.collect())).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    q.awaitTermination()
    return rows


def token_events(spark):
    """Clicks revoke tokens and views use them."""
    e = spark.read.parquet(f"{SF}/events.parquet").where("event_type in ('click', 'view')")
    return e.select("event_id", (F.col("user_id") % 7).alias("user"), F.when(F.col("event_type") == "click", "revoke").otherwise("use").alias("kind"), (F.col("event_id") % 5).cast("string").alias("jti"), F.col("ts").cast("timestamp").alias("ts")).withColumn("exp", F.when(F.col("event_id") % 3 > 0, F.unix_timestamp("ts") + 3600.0 * (F.col("event_id") % 9)))


def test_token_checks_equal_the_batch_rule_and_state_goes(rocks, tmp_path):
    spark, src, at = rocks, str(tmp_path / "in"), str(tmp_path / "checkpoint")
    events = [tuple(r) for r in token_events(spark).orderBy("ts", "event_id").collect()]
    schema = token_events(spark).schema
    third = len(events) // 3
    rows = []
    stream = lambda: state.token_checks(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), "1 minute")
    for k in range(3):  # a restart from the checkpoint between the parts
        land(spark.createDataFrame(events[k * third : (k + 1) * third if k < 2 else None], schema), src, f"part{k}")
        rows += drain(stream(), f"tokens{k}", at)
    want = {(r["event_id"], r["blocked"]) for r in state.token_checks_batch(token_events(spark)).collect()}
    assert {(r["event_id"], r["blocked"]) for r in rows} == want and len(rows) == len(want) and {b for _, b in want} == {True, False}
    held = spark.read.format("statestore").option("stateVarName", "revoked").load(at).count()
    late = [(10**9 + k, 6, "use", "x", (T0 + dt.timedelta(days=900 + k)), None) for k in range(2)]
    for k, row in enumerate(late):  # time goes on, past the expiry of all tokens
        land(spark.createDataFrame([row], schema), src, f"late{k}")
        drain(stream(), f"late{k}", at)
    assert held > 0 and spark.read.format("statestore").option("stateVarName", "revoked").load(at).count() == 0


def test_cache_entries_live_for_their_time(rocks, tmp_path):
    spark, src, at = rocks, str(tmp_path / "in"), str(tmp_path / "checkpoint")
    schema = "key string, seq bigint, op string, name string, value string"
    run = lambda name: {r["seq"]: r["value"] for r in drain(state.cache_gets(spark.readStream.schema(schema).parquet(src), 20.0), name, at, once=True)}  # noqa: E731 (by processing time a query that runs until all is seen never ends)
    land(spark.createDataFrame([("k", 1, "put", "a", "v1"), ("k", 2, "get", "a", None), ("j", 3, "get", "a", None), ("k", 4, "put", "a", "v2")], schema), src, "1")
    assert run("cache1") == {2: "v1", 3: None}
    land(spark.createDataFrame([("k", 5, "get", "a", None)], schema), src, "2")
    assert run("cache2") == {5: "v2"}
    time.sleep(21)
    land(spark.createDataFrame([("k", 6, "get", "a", None), ("k", 7, "put", "b", "w"), ("k", 8, "get", "b", None)], schema), src, "3")
    assert run("cache3") == {6: None, 8: "w"}


def test_anchored_rate_limit_as_a_stream(rocks, tmp_path):
    spark, src = rocks, str(tmp_path / "in")
    schema = "event_id bigint, user_id bigint, ts timestamp"
    at = lambda m: T0 + dt.timedelta(minutes=m)
    land(spark.createDataFrame([(0, 1, at(50)), (1, 1, at(70)), (2, 1, at(80)), (3, 2, at(80))], schema), src, "1")
    rows = drain(windows.rate_limit(spark.readStream.schema(schema).parquet(src), "user_id", 2, 3600), "limit1", str(tmp_path / "c"))
    land(spark.createDataFrame([(4, 1, at(109)), (5, 1, at(111))], schema), src, "2")
    rows += drain(windows.rate_limit(spark.readStream.schema(schema).parquet(src), "user_id", 2, 3600), "limit2", str(tmp_path / "c"))
    assert {r["event_id"]: r["allowed"] for r in rows} == {0: True, 1: True, 2: False, 3: True, 4: False, 5: True}


def test_progress_of_a_stream_of_known_size(spark, tmp_path):
    src = str(tmp_path / "in")
    for k in range(4):
        land(spark.range(k * 50, k * 50 + 50).selectExpr("id", "id * 2.0D as v"), src, f"p{k}")
    log = progress.watch(spark)
    try:
        frames, name = progress.measured(spark.readStream.schema("id bigint, v double").option("maxFilesPerTrigger", 1).parquet(src), "frames", total=F.sum("v"))
        drain(frames, "known", str(tmp_path / "c"))
        for _ in range(50):  # the listener hears of it a little later
            if log.table(spark).where("query = 'known' and rows > 0").count() == 4:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(log)
    rows = progress.throughput(log.table(spark).where("query = 'known'"), 300).orderBy("batch").collect()
    assert [r["done"] for r in rows] == [50, 100, 150, 200] and [r["remaining"] for r in rows] == [250, 200, 150, 100]
    last = rows[-1]
    assert last["rate"] > 0 and abs(last["eta_seconds"] - 100 / (200 / sum(r["seconds"] for r in rows))) < 1e-6
    seen = log.table(spark).where("query = 'known' and rows > 0").agg(F.sum(F.col("observed")["frames.rows"]), F.sum(F.col("observed")["frames.total"])).first()
    assert tuple(seen) == (200.0, float(sum(2 * k for k in range(200))))


def test_metrics_of_a_batch(spark):
    df, seen = progress.measured(spark.range(10), "batch", most=F.max("id"))
    df.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 10, "most": 9}


def test_stream_join_against_the_batch_join_and_late_rows(spark, tmp_path):
    rng, schema = random.Random(2), "id bigint, k bigint, ts timestamp"
    row = lambda i, m: (i, rng.randrange(3), T0 + dt.timedelta(minutes=m))
    left = [row(i, rng.uniform(0, 300)) for i in range(80)]
    right = [row(i, rng.uniform(0, 300)) for i in range(80)]
    l_in, r_in = str(tmp_path / "left"), str(tmp_path / "right")
    hours = [0, 100, 200, 301]
    for a, b in zip(hours, hours[1:]):
        part = lambda rows, a=a, b=b: spark.createDataFrame([r for r in rows if a <= (r[2] - T0).total_seconds() / 60 < b], schema)
        land(part(left), l_in, f"{a:04d}")
        land(part(right), r_in, f"{a:04d}")
    late = [(900 + k, k % 3, T0 + dt.timedelta(minutes=1)) for k in range(5)]
    read = lambda path: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    joined = lambda: joins.join_in_time(read(l_in), read(r_in), "k", "10 minutes", "5 minutes", "20 minutes")
    log = progress.watch(spark)
    try:
        rows = drain(joined(), "join1", str(tmp_path / "c"))
        land(spark.createDataFrame(late, schema), l_in, "9999")
        rows += drain(joined(), "join2", str(tmp_path / "c"))
        for _ in range(50):
            if (progress.late_rows(log.table(spark).where("query = 'join2'")).first() or [0, 0])[1] >= 5:
                break
            time.sleep(0.2)
        dropped = progress.late_rows(log.table(spark).where("query in ('join1', 'join2')")).agg(F.sum("late")).first()[0]
    finally:
        spark.streams.removeListener(log)
    batch = joins.join_in_time(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), "k", "10 minutes", "5 minutes")
    want = {(r["id"], r["right_id"]) for r in batch.collect()}
    assert {(r["id"], r["right_id"]) for r in rows} == want and len(rows) == len(want) > 50 and dropped == 5


def test_a_running_step_is_interrupted(spark):
    """The step's job would take minutes; cancelling it ends it, and the session goes on."""
    begun, wanted = threading.Event(), threading.Event()

    def slow(b):
        begun.set()
        spark.range(0, 400, 1, 400).selectExpr("java_method('java.lang.Thread', 'sleep', 1000L) as x").write.format("noop").mode("overwrite").save()
        return b

    threading.Thread(target=lambda: (begun.wait(), time.sleep(2), wanted.set()), daemon=True).start()
    t = time.time()
    with pytest.raises(InterruptedError, match="during slow"):
        builder.Pipeline([builder.Step("slow", builder.Stage.STACKING, slow)]).run(builder.Bundle(), cancelled=wanted.is_set)
    assert time.time() - t < 30 and spark.range(3).count() == 3
    quick = builder.Pipeline([builder.Step("quick", builder.Stage.STACKING, lambda b: b.noting(n=spark.range(5).count()))])
    assert quick.run(builder.Bundle(), cancelled=lambda: False).meta["n"] == 5
    with pytest.raises(ValueError, match="own fault"):
        builder.Pipeline([builder.Step("bad", builder.Stage.STACKING, lambda b: (_ for _ in ()).throw(ValueError("own fault")))]).run(builder.Bundle(), cancelled=lambda: False)
