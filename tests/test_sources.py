import os

import numpy as np
import pytest

from frameflow.sources import catalogs, formats, images

RNG = np.random.default_rng(9)


@pytest.mark.parametrize("kind", ["fits", "xisf", "tiff32"])
@pytest.mark.parametrize("channels", [1, 3])
def test_bytes_round_trip(kind, channels):
    a = RNG.random((channels, 5, 7)).astype(np.float32)
    data = formats.ENCODERS[kind](a, {"EXPTIME": 120.0, "GAIN": 100, "OBJECT": "M 42"})
    cards, b = formats.DECODERS[formats.SUFFIX[kind]](data)
    assert np.array_equal(a, b)
    if kind != "tiff32":
        assert float(cards["EXPTIME"]) == 120.0 and int(cards["GAIN"]) == 100 and cards["OBJECT"].strip("'") == "M 42"


def test_fits_integers_are_scaled():
    head = formats._cards_block([("SIMPLE", True), ("BITPIX", 16), ("NAXIS", 2), ("NAXIS1", 2), ("NAXIS2", 1), ("BZERO", 32768), ("BSCALE", 1)])
    data = head + np.array([-32768, 5], ">i2").tobytes()
    assert formats.fits_decode(data)[1].ravel().tolist() == [0.0, 32773.0]


def test_fits_table_round_trip():
    cards, cols = formats.fits_table_decode(formats.fits_table_encode([("STAR_ID", np.array([1, 2])), ("RA", np.array([1.5, 2.5]))], {"NSTARS": 2}))
    assert cards["NSTARS"] == 2 and cols["STAR_ID"].tolist() == [1, 2] and cols["RA"].tolist() == [1.5, 2.5]


@pytest.mark.parametrize("data", [b"", b"nothing", b"SIMPLE  =" + b" " * 100])
def test_broken_files_raise(data):
    for decode in set(formats.DECODERS.values()):
        with pytest.raises((formats.FormatError, ValueError, KeyError)):
            decode(data)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("frames")
    os.makedirs(d / "deep")
    for k, kind in enumerate(["Light Frame", "DARK", "flat", "bias", "else"]):
        a = np.full((4, 6), k, np.float32)
        (d / f"f{k}.fits").write_bytes(formats.fits_encode(a, {"IMAGETYP": kind, "EXPTIME": 60.0 * k, "GAIN": 100, "CCD-TEMP": -10.0}))
    (d / "deep" / "g.xisf").write_bytes(formats.xisf_encode(np.ones((3, 4, 6), np.float32), {"EXPTIME": 5}))
    (d / "broken.fits").write_bytes(b"not a file")
    return str(d)


def test_read_frames_and_scan(spark, folder):
    assert images.read_frames(spark, folder).count() == 5
    rows = images.read_frames(spark, folder, recursive=True).orderBy("path").collect()
    assert len(rows) == 6 and {(r["h"], r["w"], r["c"]) for r in rows} == {(4, 6, 1), (4, 6, 3)}
    scan = images.scan_directory(spark, folder)
    assert [r["frame_type"] for r in scan.collect()] == ["light", "dark", "flat", "bias", "unknown"]
    lib = images.calibration_library(scan).orderBy("ord").collect()
    assert [(r["frame_type"], r["exposure"], r["gain"], r["width"]) for r in lib] == [("dark", 60.0, 100, 6), ("flat", 120.0, 100, 6), ("bias", 180.0, 100, 6)]
    assert [r["path"] for r in images.calibration_library(scan).orderBy("ord").collect()] == sorted(r["path"] for r in scan.where("frame_type in ('dark', 'flat', 'bias')").collect())
    assert "SinglePartition" not in images.calibration_library(scan)._jdf.queryExecution().executedPlan().toString()
    assert images.read_frames(spark, folder + "/absent").count() == images.scan_directory(spark, folder + "/absent").count() == 0
    with pytest.raises(images.NotSupported):
        images.read_raw(spark, folder)


@pytest.mark.parametrize("kind", ["fits", "xisf", "tiff32"])
def test_data_source_round_trip(spark, tmp_path, kind):
    images.register(spark)
    rows = [("x", k, {"OBJECT": "M1", "EXPTIME": "30.0"}, 3, 4, 3, [float(k + v) for v in range(36)]) for k in range(3)]
    spark.createDataFrame(rows, images.L1).write.format(kind).mode("append").save(str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out")) == sorted(f"frame_{k}{formats.SUFFIX[kind]}" for k in range(3))
    back = spark.read.format(kind).load(str(tmp_path / "out"))
    assert sorted(tuple(r["data"]) for r in back.collect()) == sorted(tuple(r[6]) for r in rows)
    heads = spark.read.format(kind).option("metadataOnly", "true").load(str(tmp_path / "out"))
    assert heads.columns == ["path", "frame_id", "header"] and heads.count() == 3


def test_catalogs(spark, tmp_path):
    (tmp_path / "o.csv").write_text("name,ra,dec,kind,mag,size\nA,1.0,2.0,galaxy,,\n")
    assert catalogs.read_objects(spark, str(tmp_path / "o.csv")).first()["mag"] == 99.0
    near = catalogs.brightest_in_cone(catalogs.bright_objects(spark), 83.7, 10.0, 20.0)
    assert [r["name"] for r in near.collect()] == ["M42", "M1"]
    local = catalogs.bright_objects(spark).where("name in ('M1', 'M13')")
    both = catalogs.with_fallback(local, catalogs.bright_objects(spark).where("name in ('M1', 'M27')"))
    assert sorted(r["name"] for r in both.collect()) == ["M1", "M13", "M27"]
    (tmp_path / "p.json").write_text('{"version": "1.2", "name": "p", "input_frames": [{"path": "/a.fits"}, {"path": "/b.fits", "selected": false}]}')
    frames = catalogs.project_frames(catalogs.read_projects(spark, str(tmp_path / "p.json"))).collect()
    assert [r["selected"] for r in frames] == [True, False]
    lines = spark.createDataFrame([("%J 10.5 -3.25 = x",), ("#",)], "value string")
    assert tuple(catalogs.read_name_response(lines).first()) == (10.5, -3.25)
    assert tuple(catalogs.read_table_response(spark.createDataFrame([("M1\t8.4",)], "value string"), "name string, v double").first()) == ("M1", 8.4)
