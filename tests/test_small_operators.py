import base64
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameflow.functions import claims as L
from frameflow.functions import sky
from frameflow.functions.sky import Wcs
from frameflow.operators import tables as T
from frameflow.plans import builder


def token(payload):
    body = base64.urlsafe_b64encode(json.dumps(payload).encode()).decode().rstrip("=")
    return f"e30.{body}.c2ln"


def test_claims_of_tokens(spark):
    whole = {"sub": "ü?>~", "jti": "j", "iat": 1, "exp": 50.5, "tier": "pro", "machine_id": "m", "plugins": ["a", "b"]}
    rows = [token(whole), token({k: v for k, v in whole.items() if k != "tier"}), "a.b", "a.!.c", token([1]), None, "e30.e30.x"]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, t string").select("k", L.claims(F.col("t")).alias("c"))
    got = df.select("k", "c.sub", "c.plugins", L.problem(F.col("c")).alias("p"), L.problem(F.col("c"), L.TOKEN, F.lit(50.5)).alias("late")).orderBy("k").collect()
    assert got[0]["sub"] == "ü?>~" and got[0]["plugins"] == ["a", "b"] and got[0]["p"] is None and got[0]["late"] == "expired"
    assert got[1]["p"] == "missing tier" and {r["p"] for r in got[2:]} == {"malformed"}
    for text in ("", "a", "ab", "abc", "ÿÿ>?"):
        if text:
            assert spark.range(1).select(L.from_base64url(L.to_base64url(F.lit(text)))).first()[0] == text


def test_seconds_never_print_as_sixty(spark):
    df = spark.createDataFrame([(359.99999, 89.999999), (14.9999999, -0.99999999), (0.0, -30.5)], "ra double, dec double")
    assert [tuple(r) for r in df.select(sky.format_ra(F.col("ra")), sky.format_dec(F.col("dec"))).collect()] == [("00h00m00.0s", "+90°00'00.0\""), ("01h00m00.0s", "-01°00'00.0\""), ("00h00m00.0s", "-30°30'00.0\"")]


def test_histogram_equals_numpy(spark):
    rng = np.random.default_rng(4)
    groups = {1: rng.normal(3, 1, 500), 2: rng.normal(3, 1, 7), 3: np.full(5, 2.5), 4: np.array([1.0])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs] + [(1, None)], "g int, v double")
    rows = T.value_histogram(df, ["g"], "v").orderBy("g", "bin").collect()
    for k, vs in groups.items():
        assert [r["n"] for r in rows if r["g"] == k] == np.histogram(vs, min(len(vs), 40))[0].tolist()


def test_frames_by_type_and_best_match_without_counting_matches(spark):
    frames = spark.createDataFrame([("/a", "dark"), ("/b", "flat"), ("/c", "dark")], "path string, frame_type string")
    assert {k: v.count() for k, v in T.partition_by_type(frames).items()} == {"dark": 2, "flat": 1}
    meta = "exposure double, gain bigint, temperature double, width int, height int"
    lights = spark.createDataFrame([(1, 60.0, 100, -10.0, 4, 4)], f"light_id int, {meta}")
    library = spark.createDataFrame([(1, "/x", 60.0, 100, -10.0, 4, 4)], f"ord int, path string, {meta}")
    plan = T.best_match(lights, library)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftOuter") == 0 and T.best_match(lights, library).first()["path"] == "/x"


def test_positions_and_unequal_lengths(spark):
    left = spark.range(1000, numPartitions=7).select(F.col("id").alias("a"))
    right = spark.range(1000, numPartitions=3).select((F.col("id") * 3).alias("b"))
    rows = T.positional_join(left, right, [F.desc("a")], ["b"]).collect()
    assert len(rows) == 1000 and all(r["a"] == 999 - r["pos"] and r["b"] == 3 * r["pos"] for r in rows)
    with pytest.raises(ValueError, match="equal lengths"):
        T.positional_join(left, right.limit(9), ["a"], ["b"])
    assert T.positional_join(left, right.limit(9), ["a"], ["b"], check=False).count() == 9
    empty = left.where("false")
    assert T.positional_join(empty, empty.withColumnRenamed("a", "b"), ["a"], ["b"]).count() == 0


def test_stack_of_unequal_frames_raises(spark):
    rows = [(0, 2, 2, 1, [1.0] * 4), (1, 2, 3, 1, [1.0] * 6)]
    frames = spark.createDataFrame(rows, "frame_id bigint, h int, w int, c int, data array<double>")
    with pytest.raises(ValueError, match="same shape"):
        builder._stack(builder.configure()).apply(builder.Bundle(frames=frames))


def test_photometry_step(spark):
    y, x = np.mgrid[:48, :48]
    a = 0.1 + sum(2.0 * np.exp(-((y - cy) ** 2 + (x - cx) ** 2) / 4.5) for cy, cx in ((12, 12), (30, 34)))
    frames = spark.createDataFrame([(0, 48, 48, 1, a.ravel().tolist())], "frame_id bigint, h int, w int, c int, data array<double>")
    catalog = spark.createDataFrame([("s", 180.0, 45.0, 9.0)], "name string, ra double, dec double, mag double")
    step = builder.photometry_step(catalog)
    assert step.apply(builder.Bundle(frames=frames)).meta == {}
    w = Wcs(180.0, 45.0, (-1 / 3600, 0.0, 0.0, 1 / 3600), (24.5, 24.5), 48, 48)
    done = builder.Pipeline([step]).run(builder.Bundle(frames=frames, meta={"wcs": w}))
    assert "photometry" in done.meta and done.meta["photometry_fit"].count() == 1


def test_cache_key_rounds_the_exact_value(spark):
    from frameflow.functions import text

    values = [249.87645, 0.00005, 0.00015, 2.00005, -7.00025, 359.99995, -0.00001]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(text.fixed(F.col("v"), 4)).collect()]
    assert got == [f"{v:.4f}" for v in values]
    odd = spark.createDataFrame([(None,), (float("inf"),)], "v double").select(text.fixed(F.col("v"), 4)).collect()
    assert [r[0] for r in odd] == ["null", "Infinity"]


def test_places_of_large_keys_are_exact_products(spark, tmp_path):
    from frameflow.plans.fixtures import sky
    from frameflow.plans.q_sky import format_radec

    keys = [37_500, 62_500, 899_999]
    spark.createDataFrame([(k,) for k in keys], "c_custkey bigint").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r["k"]: r["ra"] for r in sky(spark, str(tmp_path)).collect()}
    assert got == {k: float(k * 13750776405) / 1e8 % 360 for k in keys}
    shown = {r["k"]: r["ra"] for r in format_radec(spark, str(tmp_path)).collect()}
    assert (shown[37_500], shown[62_500]) == ("17h24m36.5s", "21h01m00.8s")
