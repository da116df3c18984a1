import numpy as np
import pytest
from pyspark.sql import functions as F

from frameflow.layout import frames_to_pixels, pixels_to_frames
from frameflow.operators import frames as K
from frameflow.operators import kernels, stencil
from frameflow.operators import pixels as P
from frameflow.operators import tables as T
from frameflow.plans import builder

N = 32


def sky(k, shift=(0, 0), n=N):
    rng = np.random.default_rng(1)
    y, x = np.mgrid[:n, :n]
    a = np.full((n, n), 0.1)
    for cy, cx, f in rng.uniform((6, 6, 0.3), (n - 6, n - 6, 0.9), (6, 3)):
        a += f * np.exp(-((y - cy) ** 2 + (x - cx) ** 2) / 5)
    return np.roll(a, shift, (0, 1)) + np.random.default_rng(k).normal(0, 0.003, (n, n))


@pytest.fixture(scope="module")
def frames(spark):
    rows = [(k, N, N, 1, sky(k, (k % 3, -k % 2)).ravel().tolist()) for k in range(5)]
    return spark.createDataFrame(rows, "frame_id bigint, h int, w int, c int, data array<double>")


def plane(df):
    r = pixels_to_frames(df).first()
    return np.array(r["data"]).reshape(r["h"], r["w"], r["c"])


def test_layouts_round_trip(frames):
    assert sorted(tuple(r["data"]) for r in pixels_to_frames(frames_to_pixels(frames)).collect()) == sorted(tuple(r["data"]) for r in frames.collect())


def test_tiles_have_no_seams(frames):
    px, sizes = frames_to_pixels(frames.where("frame_id = 0")), frames.where("frame_id = 0").select("frame_id", "h", "w")
    whole = kernels.gaussian(sky(0), 1.0)
    got = plane(K.map_tiles(px, sizes, "gaussian", 20, 12, sigma=1.0))[..., 0]
    assert np.abs(got - whole)[6:-6, 6:-6].max() < 5e-3
    assert np.allclose(plane(stencil.blur(px, 1.0))[..., 0], whole)


@pytest.mark.parametrize("method", ["phase", "star"])
def test_registration_undoes_the_shift(frames, method):
    done = K.register(frames, sky(0), method)
    for r in done.collect():
        a = np.array(r["data"]).reshape(N, N)
        assert r["accepted"] and np.abs(a - sky(0))[5:-5, 5:-5].mean() < 0.02


def test_full_pipeline(spark, frames):
    config = builder.configure("Deepsky LRGB", denoise_strength=0.3, background_removal_method="polynomial", background_removal_tile_size=16, starless_enabled=True, asinh_beta=2.0, mtf_midpoint=0.3, clahe_enabled=True, clahe_tile=16, sharpening_amount=0.3)
    pipe = builder.build(config)
    assert [s.name for s in pipe.steps] == ["registration", "stacking", "background removal", "stretch", "denoise", "sharpening", "asinh", "mtf", "clahe", "star removal"]
    seen = []
    out = pipe.run(builder.Bundle(frames=frames), progress=lambda *a: seen.append(a))
    a = plane(out.result)
    assert a.shape == (N, N, 1) and 0 <= a.min() and a.max() <= 1 and len(seen) == 10
    assert set(np.unique(plane(out.mask))) <= {0.0, 1.0}
    with pytest.raises(InterruptedError):
        pipe.run(builder.Bundle(frames=frames), cancelled=lambda: True)


def test_identities_are_left_out():
    assert [s.name for s in builder.build(builder.configure(denoise_strength=0.0)).steps] == ["registration", "stacking", "stretch"]
    with pytest.warns(UserWarning):
        builder.configure(no_such_key=1)
    assert set(builder.PRESETS) == {"Deepsky LRGB", "Narrowband SHO", "Narrowband HOO", "Planetarisch"}


def test_stack_rejects_an_outlier_and_odd_shapes(spark):
    rows = [(k, 0, 0, y, x, 100.0 + (9900 if k == 11 else k % 3)) for k in range(12) for y in range(2) for x in range(2)]
    px = spark.createDataFrame(rows, "frame_id bigint, target int, ch int, y int, x int, v double")
    out = P.stack(px, "sigma_clip").collect()
    assert all(r["n"] == 11 and abs(r["v"] - 101) < 0.2 for r in out)
    with pytest.raises(ValueError):
        P.stack(px, "mode")
    odd = px.union(spark.createDataFrame([(99, 0, 0, 5, 5, 1.0)], px.schema))
    P.check_shapes(px, ("target",))
    with pytest.raises(ValueError):
        P.check_shapes(odd, ("target",))


def test_best_match_with_nulls(spark):
    lights = spark.createDataFrame([(1, None, None, None, 0, 0), (2, 60.0, 100, -10.0, 64, 48)], "light_id bigint, exposure double, gain bigint, temperature double, width int, height int")
    lib = spark.createDataFrame([(7, "a", 60.0, 100, -9.0, 64, 48), (8, "b", 60.0, 100, -9.0, 32, 48), (6, "c", 300.0, 100, -9.0, 64, 48)], "ord bigint, path string, exposure double, gain bigint, temperature double, width int, height int")
    assert [(r["light_id"], r["ord"], r["score"]) for r in T.best_match(lights, lib).collect()] == [(2, 7, 20.0)]
    empty = T.coverage(T.batch_match(lights.where("false"), lib.withColumn("frame_type", F.lit("dark")))).first()
    assert tuple(empty) == (0, 0.0, 0.0, 0.0)


def test_comet(spark):
    y, x = np.mgrid[:N, :N]
    rows = [(k, N, N, 1, (0.1 + np.exp(-((y - 10 - 2 * k) ** 2 + (x - 8 - 3 * k) ** 2) / 6)).ravel().tolist()) for k in range(5)]
    f = spark.createDataFrame(rows, "frame_id bigint, h int, w int, c int, data array<double>")
    out = builder.build(builder.configure(comet_stack_enabled=True, comet_tracking_mode="comet", denoise_strength=0.0, registration_method="phase"))
    step = [s for s in out.steps if s.name == "comet stack"][0]
    a = plane(step.apply(builder.Bundle(frames=f)).result)[..., 0]
    assert np.unravel_index(a.argmax(), a.shape) == (14, 14)


def test_presets_have_every_parameter():
    assert all(set(p) == set(builder.PRESETS["Planetarisch"]) and len(p) == 24 for p in builder.PRESETS.values())
    names = [s.name for s in builder.build(builder.configure("Planetarisch")).steps]
    assert names == ["frame selection", "registration", "stacking", "drizzle", "stretch", "denoise", "deconvolution"]


def test_from_files_to_a_written_result(spark, frames, tmp_path):
    from frameflow.sources import images

    images.export(spark, "fits", str(tmp_path / "in"), frames)
    paths = sorted(str(p) for p in (tmp_path / "in").glob("*.fits"))
    assert len(paths) == 5
    pipe = builder.build(builder.configure(denoise_strength=0.5, denoise_tile_size=20, denoise_tile_overlap=8, channel_balance=(0.01, 0.0, 0.0)))
    steps = builder.Pipeline([builder.load_frames(spark, paths), *pipe.steps, builder.export_result(spark, "fits", str(tmp_path / "out"))])
    out = steps.run(builder.Bundle())
    assert out.meta["loaded_frame_paths"] == paths and out.meta["export_path"] == str(tmp_path / "out")
    written = images.read_frames(spark, str(tmp_path / "out")).collect()
    assert len(written) == 1 and np.allclose(np.array(written[0]["data"]).reshape(N, N), plane(out.result)[..., 0], atol=1e-5)
    with pytest.raises(ValueError):
        builder.Pipeline([builder.export_result(spark, "fits", str(tmp_path / "no"))]).run(builder.Bundle())


def test_drizzle_mosaic_and_combine_steps(spark, frames):
    from frameflow.functions.sky import Wcs

    cd = (1 / 3600, 0.0, 0.0, 1 / 3600)
    wcs = {k: Wcs(0.0, 0.0, cd, (N / 2 + k, N / 2), N, N) for k in range(3)}
    some = frames.where("frame_id < 3")
    done = builder._drizzle(builder.configure(drizzle_drop_size=1.0)).apply(builder.Bundle(frames=some, meta={"wcs": wcs})).result
    data = {r["frame_id"]: np.array(r["data"]).reshape(N, N) for r in some.collect()}
    drops = [0.25 * (d[:-1, :-1] + d[1:, :-1] + d[:-1, 1:] + d[1:, 1:]) for d in (data[k] for k in range(3))]  # a drop meets four cells
    got = plane(done)[..., 0]
    assert got.shape == (N, N) and np.allclose(got[1:-2, 1 : N - 4], np.mean([d[1:-1, 1 + k : N - 4 + k] for k, d in enumerate(drops)], 0))
    twice = builder._drizzle(builder.configure(drizzle_scale=2.0, drizzle_mode="upsample")).apply(builder.Bundle(frames=some)).result
    assert plane(twice).shape[:2] == (2 * N, 2 * N)
    panels = builder._mosaic(builder.configure()).apply(builder.Bundle(frames=some, meta={"wcs": {k: Wcs(180 + k * 20 / 3600, 0.0, (-1 / 3600, 0, 0, 1 / 3600), (N / 2, N / 2), N, N) for k in range(2)}}))
    assert panels.meta["mosaic_panels"] == 2 and plane(panels.result).shape[1] > N
    mono = {b: frames_to_pixels(frames.where(F.col("frame_id") == k)) for k, b in enumerate(("Ha", "OIII", "SII"))}
    rgb = plane(builder._combine(builder.configure(channel_combine_mode="narrowband")).apply(builder.Bundle(meta={"channels": mono})).result)
    assert np.allclose(rgb, np.clip(np.stack([data[2], data[0], data[1]], 2), 0, 1))


def test_color_calibration_recovers_the_scales(spark):
    rng = np.random.default_rng(3)
    a = np.full((60, 60, 3), 0.01)
    stars = [(k, float(y), float(x)) for k, (y, x) in enumerate((y, x) for y in (10, 30, 50) for x in (10, 30, 50))]
    for _, y, x in stars:
        a[int(y) - 2 : int(y) + 3, int(x) - 2 : int(x) + 3] += rng.uniform(0.2, 0.5)
    tinted = a * [0.8, 1.0, 1.25]
    px = frames_to_pixels(spark.createDataFrame([(0, 60, 60, 3, tinted.ravel().tolist())], "frame_id bigint, h int, w int, c int, data array<double>"))
    table = spark.createDataFrame([(k, y, x, 1.0 if k else 9.0, 1.0) for k, y, x in stars], "star_id int, sy double, sx double, rg double, bg double")
    out = builder._color_calibrate(builder.configure(color_calibration_radius=4)).apply(builder.Bundle(result=px, meta={"color_stars": table}))
    assert np.allclose(out.meta["color_scales"], (1 / 0.8, 1 / 1.25)) and out.meta["color_stars_used"] < 10
    assert np.allclose(plane(out.result), a)


def test_stencils_by_tiles_against_brute_force(spark, monkeypatch):
    """Frames larger than a tile and smaller than a kernel, holes and nulls; pixels are shuffled, not their reads."""
    monkeypatch.setattr(stencil, "TILE", 4)
    rng = np.random.default_rng(4)
    rows = [(f, 0, y, x, None if rng.random() < 0.1 else float(rng.normal())) for f, (h, w) in enumerate([(9, 11), (1, 2), (5, 3)]) for y in range(h) for x in range(w) if (y, x) == (h - 1, w - 1) or rng.random() < 0.9]
    px = spark.createDataFrame(rows, "frame_id bigint, ch int, y int, x int, v double")
    at = {r[:4]: r[4] for r in rows}
    size = {f: (max(r[2] for r in rows if r[0] == f) + 1, max(r[3] for r in rows if r[0] == f) + 1) for f in range(3)}
    mirror = lambda i, n: i % (2 * n) if i % (2 * n) < n else 2 * n - 1 - i % (2 * n)
    for how, fold in (("min", min), ("max", max), ("median", lambda u: float(np.median(list(u)))), ("sum", sum)):
        for constant in (None, 0.5):
            df = stencil.filtered(px, stencil.square(2), how, constant)
            got = {tuple(r)[:4]: r["v"] for r in df.collect()}
            assert got.keys() == at.keys()
            for f, c, y, x in at:
                places = [(f, c, y + dy, x + dx) if constant is not None else (f, c, mirror(y + dy, size[f][0]), mirror(x + dx, size[f][1])) for dy, dx, _ in stencil.square(2)]
                u = [at.get(p) if at.get(p) is not None else constant for p in places]
                u = [t for t in u if t is not None]
                assert (got[f, c, y, x] is None) == (not u) and (not u or abs(got[f, c, y, x] - fold(u)) < 1e-9), (how, constant)
    assert "Window" not in stencil.filtered(px, stencil.square(2), "min")._jdf.queryExecution().executedPlan().toString()
