"""Queries over whole tables: every id has its part in the result, and operators hold against brute force."""

import numpy as np

from frameflow.operators import match
from frameflow.plans import catalog

SF = "/root/testdata/sf0.001"


def test_all_descriptors_and_panels_are_compared(spark):
    q = catalog.queries()
    assert q["mutual_nn_descriptors"](spark, SF).where("a_id >= 400 or b_id >= 400").count() > 0
    panels = q["overlap_medians"](spark, SF).agg({"b": "max"}).first()[0]
    assert panels == spark.read.parquet(f"{SF}/embeddings.parquet").agg({"vec_id": "max"}).first()[0]


def test_mutual_nearest_in_blocks(spark):
    rng = np.random.default_rng(5)
    rows = [(k % 3, k, rng.integers(-2, 3, 4).astype(float).tolist()) for k in range(90)]
    rows = [(g, k, d if any(d) else [1.0, 0.0, 0.0, 0.0]) for g, k, d in rows]
    df = spark.createDataFrame(rows, "pair int, id bigint, d array<double>")
    got = {tuple(r)[:3] for r in match.mutual_nearest(df.where("id < 45"), df.where("id >= 45"), ["pair"], blocks=4).collect()}

    def cos(p, q):
        dot = lambda u, v: sum(x * y for x, y in zip(u, v))
        return dot(p, q) / np.sqrt(dot(p, p) * dot(q, q))

    want = set()
    for g in range(3):
        a, b = [r for r in rows if r[0] == g and r[1] < 45], [r for r in rows if r[0] == g and r[1] >= 45]
        to_b = {x[1]: min((-cos(x[2], y[2]), y[1]) for y in b)[1] for x in a}
        to_a = {y[1]: min((-cos(x[2], y[2]), x[1]) for x in a)[1] for y in b}
        want |= {(g, i, j) for i, j in to_b.items() if to_a[j] == i}
    assert got == want


def test_every_part_is_measured(spark):
    """Stars, samples and frames of all parts."""
    sf, q = "/root/testdata/sf0.01", catalog.queries()
    parts = spark.read.parquet(f"{sf}/part.parquet")
    n, last = parts.count(), parts.agg({"p_partkey": "max"}).first()[0]
    assert q["aperture_flux"](spark, sf).select("star_id").distinct().count() == n
    assert q["tile_grid"](spark, sf).select("frame_id").distinct().count() == n
    assert q["idw_grid"](spark, sf).agg({"frame_id": "max"}).first()[0] == last // 20


def test_library_beyond_the_first_ids_is_matched(spark):
    """The library holds all suppliers and parts, and validation reads all of them."""
    from frameflow.plans import fixtures

    sf = "/root/testdata/sf0.1"
    suppliers, parts = (spark.read.parquet(f"{sf}/{t}.parquet").count() for t in ("supplier", "part"))
    whole = fixtures.library(spark, sf)
    assert whole.count() == suppliers + parts
    got = {r["code"]: r["n"] for r in catalog.queries()["validate_project"](spark, sf).collect()}
    want = {f"MISSING_{r['frame_type'].upper()}_FILES": r["count"] for r in whole.where("ord % 10 = 3").groupBy("frame_type").count().collect()}
    assert {k: got[k] for k in want} == want


def test_equal_library_settings_match_their_smallest_ord(spark):
    meta = "exposure double, gain bigint, temperature double, width int, height int"
    lights = spark.createDataFrame([(1, 60.0, 100, -10.0, 64, 48)], f"light_id int, {meta}")
    lib = spark.createDataFrame([(k, f"/{k}", 60.0, 100, -10.0, 64, 48) for k in (9, 4, 7)], f"ord int, path string, {meta}")
    from frameflow.operators import tables

    assert [r["ord"] for r in tables.best_match(lights, lib).collect()] == [4]


def test_every_entry_has_its_position(spark):
    got = catalog.queries()["frame_sort"](spark, SF)
    n = spark.read.parquet(f"{SF}/events.parquet").count()
    assert n > 100 and sorted(r["pos"] for r in got.collect()) == list(range(1, n + 1))


def test_ranks_by_name_and_with_equal_keys(spark):
    from frameflow.operators import tables

    rows = [(k, None if k % 50 == 9 else f"/d/{'AbC'[k % 3]}.fits", None if k % 4 == 0 else float(k % 2)) for k in range(300)]
    df = spark.createDataFrame(rows, "idx bigint, path string, quality double")
    for key, down in (("quality", True), ("quality", False), ("name", True), ("name", False)):
        want = [r["idx"] for r in tables.frame_sort(df, key, down).collect()]
        for sample in (40, 20_000):
            got = {r["pos"]: r["idx"] for r in tables.frame_ranks(df, key, down, ranges=7, sample=sample).collect()}
            assert [got[k + 1] for k in range(300)] == want
    assert tables.frame_ranks(df.limit(0), "quality").count() == 0


def test_mutual_nearest_of_copies_and_vectors_without_direction(spark):
    """Copies give way to the smallest id; zero, null and odd vectors take no part."""
    rows = [(k, [1.0, float(k % 5), 0.5]) for k in range(40)] + [(40, [0.0, 0.0, 0.0]), (41, None), (42, [float("nan"), 1.0, 0.0])]
    df = spark.createDataFrame([(0, *r) for r in rows], "g int, id bigint, d array<float>")
    got = {(r["a_id"], r["b_id"]) for r in match.mutual_nearest(df.where("id % 2 = 0"), df.where("id % 2 = 1"), ["g"]).collect()}
    assert got == {(a, b) for a in range(0, 10, 2) for b in range(1, 10, 2) if a % 5 == b % 5}
    plan = match.mutual_nearest(df, df, ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan  # pairs are matrix products, not rows


def test_overlaps_against_brute_force(spark):
    rng = np.random.default_rng(8)
    box = [(k, *(float(v) for v in (x, y, x + w, y + h))) for k, (x, y, w, h) in enumerate(zip(rng.integers(-40, 40, 300), rng.integers(-40, 40, 300), rng.integers(0, 20, 300), rng.integers(1, 15, 300), strict=True))]
    df = match.overlap_graph(spark.createDataFrame(box, "id bigint, x0 double, y0 double, x1 double, y1 double"), 8.0)
    got = sorted((r["a"], r["b"], r["area"]) for r in df.collect())
    want = []
    for p in box:
        for q in box[p[0] + 1 :]:
            w, h = min(p[3], q[3]) - max(p[1], q[1]), min(p[4], q[4]) - max(p[2], q[2])
            want += [(p[0], q[0], w * h)] if w > 0 and h > 0 else []
    assert got == want and len(want) > 100
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()  # a cell's boxes are not joined with one another


def test_overlaps_of_dense_places_are_dealt_into_bounded_tasks(spark, monkeypatch):
    """Many boxes of a place become many tasks; cells are halved, and split by how boxes come in and by blocks. Ids occur twice."""
    for name, value in (("PAIRS", 2_000), ("BOXES", 64), ("SIDE", 48)):
        monkeypatch.setattr(match, name, value, raising=False)
    rng = np.random.default_rng(4)
    spot = [(x, y, x + w, y + h) for x, y, w, h in zip(rng.integers(3, 6, 250), rng.integers(-2, 2, 250), rng.integers(1, 9, 250), rng.integers(1, 6, 250), strict=True)]
    wide = [(x, y, x + w, y + h) for x, y, w, h in zip(rng.integers(-40, 40, 300), rng.integers(-40, 40, 300), rng.integers(0, 12, 300), rng.integers(1, 9, 300), strict=True)]
    box = [(k % 540, *map(float, b)) for k, b in enumerate(spot + wide)]
    df = match.overlap_graph(spark.createDataFrame(box, "id bigint, x0 double, y0 double, x1 double, y1 double"), 8.0)
    parts = [[tuple(r) for r in p] for p in df.rdd.glom().collect()]
    want = []
    for k, p in enumerate(box):
        for q in box[k + 1 :]:
            w, h = min(p[3], q[3]) - max(p[1], q[1]), min(p[4], q[4]) - max(p[2], q[2])
            if w > 0 and h > 0 and p[0] != q[0]:
                want.append((min(p[0], q[0]), max(p[0], q[0]), w * h, w * h / min((b[3] - b[1]) * (b[4] - b[2]) for b in (p, q))))
    assert sorted(r for p in parts for r in p) == sorted(want) and len(want) > 20_000
    assert max(map(len, parts)) < 6_000 and sum(map(bool, parts)) > 10
    # equal areas and shares are together, which makes files of edges small
    largest = max(parts, key=len)
    assert sum(a[2:] != b[2:] for a, b in zip(largest, largest[1:], strict=False)) < len(largest) / 4


def test_nearest_within_against_brute_force(spark):
    """Dense and sparse places, copies and ties, by radii that grow."""
    rng = np.random.default_rng(9)
    right = [(k, float(x), float(y)) for k, (x, y) in enumerate(np.concatenate([rng.integers(0, 12, (500, 2)) / 4, rng.integers(0, 300, (60, 2))]))]
    left = [(k, float(x), float(y)) for k, (x, y) in enumerate(np.concatenate([rng.integers(0, 24, (200, 2)) / 8, rng.integers(-20, 320, (200, 2))]))]
    frame = lambda rows: spark.createDataFrame(rows, "id bigint, x double, y double")
    found = match.nearest_within(frame(left), frame(right), 25.0)
    got = {r["left_id"]: (r["right_id"], r["distance"]) for r in found.collect()}
    want = {}
    for k, x, y in left:
        d2, best = min(((x - u) ** 2 + (y - v) ** 2, j) for j, u, v in right)
        if d2 <= 625:
            want[k] = (best, d2**0.5)
    assert got == want and 200 < len(want) < 400
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") > 1  # small radii come first


def test_nearest_within_deals_more_rows_into_more_partitions(spark, monkeypatch):
    """A task sorts a bounded number of rows at any size, so its memory doesn't grow with the tables."""
    rng = np.random.default_rng(10)
    right = [(k, float(x), float(y)) for k, (x, y) in enumerate(rng.integers(0, 60, (400, 2)))]
    left = [(k, float(x), float(y)) for k, (x, y) in enumerate(rng.integers(-20, 160, (300, 2)) / 2)]
    frame = lambda rows: spark.createDataFrame(rows, "id bigint, x double, y double")
    places = len({r[1:] for r in right})
    want = {}
    for k, x, y in left:
        d2, best = min(((x - u) ** 2 + (y - v) ** 2, j) for j, u, v in right)
        if d2 <= 25:
            want[k] = (best, d2**0.5)
    for asked in (10_000, 100, 50):
        monkeypatch.setattr(match, "ASKED", asked)
        found = match.nearest_within(frame(left), frame(right), 5.0)
        assert {r["left_id"]: (r["right_id"], r["distance"]) for r in found.collect()} == want
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        n = -(-(4 * len(left) + places) // asked)
        assert plan.count(f"L, {n}") + plan.count(f"], {n}\n") >= 2, plan
