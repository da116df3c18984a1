import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from frameflow.layout import frames_to_pixels
from frameflow.sources import fits, formats
from frameflow.streaming.ingest import running_stack


def put(folder, name, value, side=64, **cards):
    os.makedirs(folder, exist_ok=True)
    made = os.path.join(folder, f".{name}")
    with open(made, "wb") as f:
        f.write(formats.fits_encode(np.full((side, side), value, np.float32), cards))
    os.replace(made, os.path.join(folder, name))


@pytest.fixture
def folder(tmp_path):
    for k in range(12):
        put(tmp_path / "in", f"f{k:02d}.fits", k, IMAGETYP="DARK" if k % 3 == 0 else "LIGHT", EXPTIME=30.0 * k, OBJECT=f"M {k % 2}", GAIN=100)
    put(tmp_path / "in" / "deep", "g.fit", 99, IMAGETYP="FLAT")
    (tmp_path / "in" / "broken.fits").write_bytes(b"no image")
    return str(tmp_path / "in")


def read_bytes(folder, columns, *where):
    reader = fits.FramesReader({"path": folder, "where": json.dumps(where)}, StructType.fromDDL(fits._some(columns)))
    count, rows = [], []
    for p in reader.partitions():
        rows += reader.made.rows(p.paths, count.append)
    return sum(count), rows


def test_headers_decide_conditions_and_data_units_are_skipped(spark, folder):
    block, unit = formats.BLOCK, 64 * 64 * 4
    head = 12 * block + 8  # the broken file has eight bytes
    assert read_bytes(folder, "path,imagetyp")[0] == head
    assert read_bytes(folder, "path,data")[0] == head + 12 * unit
    n, rows = read_bytes(folder, "path,data", ("imagetyp", "=", "DARK"), ("exposure", ">", 100.0))
    assert n == head + 2 * unit and len(rows) == 2
    assert read_bytes(folder, "exposure,data", ("imagetyp", "in", ["FLAT"])) == (head, [])
    assert len(read_bytes(folder, "path", ("imagetyp", "!=", "DARK"), ("object", "contains", "1"), ("temperature", "<", 0))[1]) == 0
    assert len(read_bytes(folder, "path", ("imagetyp", "!=", "DARK"), ("object", "contains", "1"))[1]) == 4
    with pytest.raises(ValueError, match="header"):
        fits.conditions([("data", "=", 1)])


def test_frames_by_conditions_and_columns(spark, folder):
    darks = fits.read_frames(spark, folder, where=[("imagetyp", "=", "DARK"), ("exposure", ">", 100)], recursive=True)
    some = darks.where("header['GAIN'] = '100' and size(data) > 3").select("exposure", F.element_at("data", 1).alias("v"))
    assert sorted((r["exposure"], r["v"]) for r in some.collect()) == [(180.0, 6.0), (270.0, 9.0)]
    df = fits.read_frames(spark, folder, recursive=True)
    assert df.where("imagetyp = 'FLAT'").count() == 1 and df.count() == 13 and df.where("imagetyp is null or c <> 1").count() == 0
    assert df.where("imagetyp = 'DARK'").unionAll(df.where("exposure = 30")).count() == 5
    some = fits.read_frames(spark, folder, "path,imagetyp,exposure")
    assert some.columns == ["path", "imagetyp", "exposure"] and some.where("imagetyp not in ('DARK')").count() == 8
    with pytest.raises(Exception, match="FITS"):
        fits.read_frames(spark, folder, strict=True).count()
    empty = os.path.join(folder, "deep", "none")
    os.makedirs(empty)
    assert fits.read_frames(spark, empty).count() == 0


def test_many_files_share_a_partition():
    files = [(f"{k}", 10) for k in range(1200)] + [("large", fits.BYTES * 2), ("last", 5)]
    assert [len(p.paths) for p in fits.shared_out(files, True)] == [512, 512, 178]
    assert [len(p.paths) for p in fits.shared_out(files, False)] == [512, 512, 176, 1, 1]


def run(spark, folder, out, checkpoint, most=None):
    q = fits.stream_frames(spark, folder, "path,frame_id,h,w,c,data", most=most).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return len([p for p in q.recentProgress if p["numInputRows"]])


def test_a_restarted_stream_reads_each_file_once(spark, tmp_path):
    src, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    for k in range(5):
        put(src, f"a{k}.fits", k, 8)
    run(spark, src, out, checkpoint)
    assert spark.read.parquet(out).count() == 5
    for k in range(4):
        put(src, f"A{k}.fits", 10 + k, 8)  # these sort before the others
    run(spark, src, out, checkpoint)
    run(spark, src, out, checkpoint)
    put(src, "last.fits", 50, 8)
    run(spark, src, out, checkpoint)
    rows = spark.read.parquet(out)
    assert rows.count() == rows.select("path").distinct().count() == 10
    # a second query goes by the same log, from its start
    run(spark, src, str(tmp_path / "out2"), str(tmp_path / "checkpoint2"))
    assert spark.read.parquet(str(tmp_path / "out2")).count() == 10


def test_a_batch_planned_again_has_the_same_files(spark, tmp_path):
    src = str(tmp_path / "in")
    put(src, "a.fits", 1, 8)
    schema = StructType.fromDDL(fits.FRAMES)
    first = fits.FramesStream({"path": src}, schema)
    end = first.latestOffset()
    assert first.latestOffset() == end == {"look": 0}
    put(src, "b.fits", 2, 8)
    again = fits.FramesStream({"path": src, "maxFilesPerTrigger": "1"}, schema)
    assert [p.paths for p in again.partitions({"look": -1}, end)] == [[os.path.join(src, "a.fits")]]
    put(src, "c.fits", 3, 8)
    assert again.latestOffset() == {"look": 1} and again.latestOffset() == {"look": 2}
    assert [p.paths for p in again.partitions({"look": 1}, {"look": 2})] == [[os.path.join(src, "c.fits")]]


def test_stack_of_a_stream_equals_the_batch_stack(spark, tmp_path):
    src, at = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    pixels = lambda df: frames_to_pixels(df.select("frame_id", "h", "w", "c", F.lit(0).alias("target"), "data"))
    kept = {}
    for turn in range(3):
        for k in range(2):
            put(src, f"{turn}-{k}.fits", turn * 7 + k, 6)
        stack = running_stack(pixels(fits.stream_frames(spark, src, "frame_id,h,w,c,data")))
        q = stack.writeStream.outputMode("complete").foreachBatch(lambda df, _: kept.update({"rows": sorted((r["y"], r["x"], r["n"], r["v"]) for r in df.collect())})).option("checkpointLocation", at).trigger(availableNow=True).start()
        q.awaitTermination()
    batch = running_stack(pixels(fits.read_frames(spark, src)))
    assert kept["rows"] == sorted((r["y"], r["x"], r["n"], r["v"]) for r in batch.collect()) and kept["rows"][0][2] == 6


def test_tables_are_written_at_once_and_read_back(spark, tmp_path):
    out = str(tmp_path / "tables")
    stars = spark.range(20_000).selectExpr("id % 37 as frame_id", "cast(id as int) as star_id", "id * 0.25D as ra", "cast(id as float) as flux", "id * 1000000007L as big", "concat('star ', id) as name")
    fits.write_tables(stars, out, ["star_id"])
    assert sorted(os.listdir(out)) == sorted(f"table_{k}.fits" for k in range(37))
    back = spark.read.format("fitstable").load(out)
    assert dict(back.dtypes) == dict(stars.dtypes)
    assert back.exceptAll(stars.select(back.columns)).count() == 0 and back.count() == 20_000
    one = fits.read_tables(spark, out, [("frame_id", "=", 5)]).where("flux > 100")
    assert one.count() == stars.where("frame_id = 5 and flux > 100").count()
    with fits.Ranged(os.path.join(out, "table_3.fits")) as f:
        cards, kind = fits._table_header(f)
    assert cards["NAXIS2"] == stars.where("frame_id = 3").count() and cards["NAXIS1"] == kind.itemsize and os.path.getsize(os.path.join(out, "table_3.fits")) % formats.BLOCK == 0


def test_frames_of_several_tasks_and_failed_tasks(spark, tmp_path):
    fits.register(spark)
    out = str(tmp_path / "tables")
    rows = spark.range(0, 90, 1, 3).selectExpr("id % 3 as frame_id", "id as n", "cast(null as double) as gone")
    rows.write.format("fitstable").mode("append").save(out)
    assert len(os.listdir(out)) == 9 and not [n for n in os.listdir(out) if n[0] == "."]
    assert spark.read.format("fitstable").load(out).agg(F.sum("n")).first()[0] == sum(range(90))
    before = sorted(os.listdir(out))
    bad = spark.range(0, 90, 1, 3).selectExpr("id as frame_id", "case when id = 70 then repeat('x', 99) else 'ok' end as name")
    with pytest.raises(Exception, match="more than 64 bytes"):
        bad.write.format("fitstable").mode("append").save(out)
    assert sorted(os.listdir(out)) == before
    with pytest.raises(Exception, match="no column of type"):
        spark.range(1).selectExpr("id as frame_id", "array(1) as a").write.format("fitstable").mode("append").save(out)
