import math
import random

from pyspark.sql import functions as F

from frameflow.functions import sphere
from frameflow.operators import match


def apart(a, b):
    v = lambda r, d: (math.cos(math.radians(d)) * math.cos(math.radians(r)), math.cos(math.radians(d)) * math.sin(math.radians(r)), math.sin(math.radians(d)))
    return math.degrees(2 * math.asin(min(1.0, math.dist(v(*a), v(*b)) / 2)))


def test_projection_round_trip(spark):
    """Below 1e-9 degrees, at the poles and across right ascension 0 too."""
    rng = random.Random(1)
    centres = [(0.0, 0.0), (359.9, 89.9), (0.05, -89.95), (180.0, 45.0), (123.4, 90.0)]
    rows = [(*c, rng.uniform(-3, 3), rng.uniform(-3, 3)) for c in centres for _ in range(50)]
    df = spark.createDataFrame(rows, "ra0 double, dec0 double, xi double, eta double")
    ra, dec = sphere.deproject(*map(F.col, ("xi", "eta", "ra0", "dec0")))
    there = df.select("*", ra.alias("ra"), dec.alias("dec"))
    xi, eta = sphere.project(*map(F.col, ("ra", "dec", "ra0", "dec0")))
    for r in there.select("*", xi.alias("x"), eta.alias("y")).collect():
        assert abs(r["x"] - r["xi"]) < 1e-9 and abs(r["y"] - r["eta"]) < 1e-9
        distance = apart((r["ra"], r["dec"]), (r["ra0"], r["dec0"]))
        assert abs(math.degrees(math.tan(math.radians(distance))) - math.hypot(r["xi"], r["eta"])) < 1e-9
    far = spark.range(1).select(*sphere.project(F.lit(181.0), F.lit(0.0), 0.0, 0.0)).first()
    assert far[0] is None and far[1] is None


def test_cone_join_against_brute_force(spark):
    rng = random.Random(3)
    around = lambda: rng.choice([(rng.uniform(0, 360), math.degrees(math.asin(rng.uniform(-1, 1)))), (rng.uniform(-3, 3) % 360, rng.uniform(-4, 4)), (rng.uniform(0, 360), rng.uniform(84, 90)), (rng.uniform(0, 360), -90 + rng.uniform(0, 4)), (0.0, 90.0), (0.0, 0.0)])
    places = [(k, *around(), 5.0) for k in range(700)] + [(700, None, 1.0, 1.0), (701, 359.9999999, -90.0, 1.0)]
    cones = [(k, *around(), rng.choice([0.0, 0.5, 2.0, 7.0, 40.0])) for k in range(120)] + [(120, 10.0, None, 1.0), (121, 200.0, 3.0, 180.0), (122, 5.0, 88.0, 2.0)]
    cat = spark.createDataFrame(places, "k int, ra double, dec double, mag double")
    c = spark.createDataFrame(cones, "cone int, ra double, dec double, radius double")
    want = {(a[0], p[0]) for a in cones for p in places if None not in a and None not in p and apart(a[1:3], p[1:3]) <= a[3]}
    edge = {(a[0], p[0]) for a in cones for p in places if None not in a and None not in p and abs(apart(a[1:3], p[1:3]) - a[3]) < 1e-6}
    for height in (0.7, 2.0, 30.0):
        got = [(r["cone"], r["k"]) for r in match.cone_join(c, cat, height).collect()]
        assert len(got) == len(set(got)) and set(got) ^ want <= edge
    counts = {r["cone"]: r["n"] for r in match.cone_counts(c, cat, 2.0).collect()}
    assert len(counts) == 123 and counts[120] == 0 and counts[121] == 701


def test_cone_pairs_by_ranges_of_separation(spark, monkeypatch):
    """Every pair of the brute force once, poles and right ascension 0 among them; a task's seps are together, as are the first cones."""
    for name, value in (("PLACES", 60), ("OFTEN", 0), ("FOUND", 300), ("HELD", 200), ("FIRST", 20)):
        monkeypatch.setattr(match, name, value)
    rng = random.Random(5)
    around = lambda: rng.choice([(rng.uniform(0, 360), math.degrees(math.asin(rng.uniform(-1, 1)))), (rng.uniform(-3, 3) % 360, rng.uniform(-4, 4)), (rng.uniform(0, 360), rng.uniform(84, 90)), (rng.uniform(0, 360), -90 + rng.uniform(0, 4)), (0.0, 90.0), (0.0, 0.0)])
    places = [(k, *around(), 5.0) for k in range(900)] + [(900, None, 1.0, 1.0), (901, 359.9999999, -90.0, 1.0)]
    cones = [(f"c{k}", *around(), rng.choice([0.0, 0.5, 2.0, 7.0, 40.0])) for k in range(150)] + [("n", 10.0, None, 1.0), ("w", 200.0, 3.0, 180.0), ("p", 5.0, 88.0, 2.0), ("m", 5.0, 8.0, None)]
    cat = spark.createDataFrame(places, "k int, ra double, dec double, mag double")
    c = spark.createDataFrame(cones, "cone string, ra double, dec double, radius double")
    for step in (1e-6, 1.0):
        df = match.cone_pairs(c, cat, step=step)
        assert df.columns == ["cone", "k", "sep"] and dict(df.dtypes)["cone"] == "string"
        got = [(r["cone"], r["k"]) for r in df.collect()]
        sides = [[(a, p) for p in places if None not in a and None not in p and apart(a[1:3], p[1:3]) <= a[3]] for a in cones]
        want = {(a[0], p[0]) for pairs in sides for a, p in pairs}
        edge = {(a[0], p[0]) for a in cones for p in places if None not in a and None not in p and abs(apart(a[1:3], p[1:3]) - a[3]) < 1e-6}
        assert len(got) == len(set(got)) and set(got) ^ want <= edge
    parts = [p for p in df.rdd.map(lambda r: r["sep"]).glom().collect() if p]
    assert len(parts) > 20
    assert sum(a > b for p in parts for a, b in zip(p, p[1:], strict=False)) < sum(map(len, parts)) / 4
    monkeypatch.setattr(match, "OFTEN", 8)
    plan = match.cone_pairs(c, cat)._jdf.queryExecution().executedPlan().toString()
    assert "InArrow" not in plan  # few pairs stay a join
    assert match.cone_pairs(c.limit(0), cat).count() == 0 and match.cone_pairs(c, cat.limit(0)).count() == 0


def test_cone_join_is_an_equi_join(spark):
    cat = spark.createDataFrame([(1, 2.0, 3.0)], "k int, ra double, dec double")
    plan = match.cone_join(cat.selectExpr("k as cone", "ra", "dec", "1.0D as radius"), cat)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
