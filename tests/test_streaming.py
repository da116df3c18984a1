import datetime as dt

from pyspark.sql import functions as F

from frameflow.layout import vectors_to_pixels
from frameflow.streaming import history, ingest, windows

SF = "/root/testdata/sf0.001"


def drain(df, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def stream(spark, name):
    return spark.readStream.schema(spark.read.parquet(f"{SF}/{name}.parquet").schema).parquet(f"{SF}/{name}.parq*")


def test_tumbling_equals_batch(spark):
    got = drain(windows.tumbling(windows.event_time(stream(spark, "events")), ["event_type"], "1 hour"), "complete", "tumbling")
    want = windows.tumbling(windows.event_time(spark.read.parquet(f"{SF}/events.parquet")), ["event_type"], "1 hour")
    key = lambda df: sorted((r["event_type"], r["w"]["start"], r["n"], round(r["total"], 6)) for r in df.collect())
    assert key(got) == key(want)


def test_running_stack_equals_batch(spark):
    got = drain(ingest.running_stack(vectors_to_pixels(stream(spark, "embeddings"))), "complete", "running")
    want = ingest.running_stack(vectors_to_pixels(spark.read.parquet(f"{SF}/embeddings.parquet")))
    key = lambda df: sorted((r["target"], r["y"], r["x"], r["n"], round(r["v"], 9)) for r in df.collect())
    assert key(got) == key(want)


def test_anchored_rate_limit_rules():
    """The window starts with the first request, not at a full hour, and starts anew after it has passed."""
    import pandas as pd

    class State:
        value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, v):
            self.value = v

    p = windows.AnchoredWindow(2, 3600)
    p.state = State()
    base = pd.Timestamp("2024-01-01 00:50:00", tz="UTC")
    rows = pd.DataFrame({"event_id": range(5), "ts": [base + pd.Timedelta(minutes=m) for m in (0, 20, 30, 59, 61)]})
    out = pd.concat(list(p.handleInputRows(("k",), iter([rows[:3], rows[3:]]), None)))
    assert out["allowed"].tolist() == [True, True, False, False, True]
    assert out["retry_after"].tolist() == [0.0, 0.0, 1800.0, 60.0, 0.0]


def test_cache_rules(spark):
    cache = spark.createDataFrame([("a", 10.0, 0), ("b", 99.0, 3)], "key string, expires_at double, hit_count bigint")
    hits, after = ingest.cached_lookup(cache, spark.createDataFrame([("a",), ("b",), ("b",)], "key string"), 50.0)
    assert [r["key"] for r in hits.collect()] == ["b", "b"] and [tuple(r) for r in after.collect()] == [("b", 99.0, 5)]
    new = ingest.upsert(spark.createDataFrame([("b", 120.0, 0), ("c", 5.0, 0)], cache.schema), cache, ["key"], "expires_at")
    assert sorted(tuple(r) for r in new.collect()) == [("a", 10.0, 0), ("b", 120.0, 0), ("c", 5.0, 0)]
    tokens, black = spark.createDataFrame([("x",), ("y",), ("z",)], "jti string"), spark.createDataFrame([("x", 100.0, 0.0), ("y", 10.0, 0.0), ("z", 10.0, 45.0)], "jti string, exp double, added double")
    assert [r[0] for r in ingest.blocked_tokens(tokens, black, 90.0).collect()] == ["y"]


def test_history_replay(spark):
    log = spark.createDataFrame([(1, 1, "push", "a"), (1, 2, "push", "b"), (1, 3, "undo", None), (1, 4, "redo", None), (1, 5, "undo", None), (1, 6, "push", "c"), (1, 7, "redo", None)], "session bigint, seq bigint, op string, step string")
    got = [tuple(r)[2:] for r in history.replay(log).orderBy("seq").collect()]
    assert got == [("a", 1, 0), ("b", 2, 0), ("a", 1, 1), ("b", 2, 0), ("a", 1, 1), ("c", 2, 0), ("c", 2, 0)]


def test_throttle_and_debounce(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(k, 1, t + dt.timedelta(milliseconds=ms)) for k, ms in enumerate((0, 100, 250, 900, 1500))]
    e = spark.createDataFrame(rows, "event_id bigint, user_id bigint, ts timestamp")
    assert windows.throttle(e, "user_id").count() == 2
    assert sorted(r["event_id"] for r in windows.debounce(e, "user_id", "300 milliseconds", "event_id").collect()) == [2, 3, 4]
    assert windows.sessions(e, ["user_id"], "1 second").agg(F.count("*")).first()[0] == 1
