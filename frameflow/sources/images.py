"""Image files as frame tables (L1) and back.

``read_frames`` lists and loads through Spark's binaryFile source, so it reaches every store that Spark does. The data
sources 'fits', 'xisf' and 'tiff32' read and write files on a folder that all executors mount; with metadataOnly they read
headers alone.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from frameflow.functions.text import classify_frame_type, header_metadata
from frameflow.operators.tables import frame_stats
from frameflow.sources import formats

L1 = "path string, frame_id bigint, header map<string,string>, h int, w int, c int, data array<double>"
HEADER = "path string, frame_id bigint, header map<string,string>"


class NotSupported(NotImplementedError):
    """An operation that needs what this engine leaves out: raw decoders, external solvers, network services, model weights."""


def _suffix(path: str) -> str:
    return os.path.splitext(path)[1].lower()


def _frame_id(path: str) -> int:
    """Stable for a path: 52 bits of its checksum pair."""
    import hashlib

    return int.from_bytes(hashlib.sha256(path.encode()).digest()[:8], "big") >> 12


def _row(path: str, data: bytes, metadata_only: bool):
    if metadata_only:
        return path, _frame_id(path), {k: str(v) for k, v in formats.header_of(data, _suffix(path)).items() if v is not None}
    cards, a = formats.DECODERS[_suffix(path)](data)
    c, h, w = a.shape
    return path, _frame_id(path), {k: str(v) for k, v in cards.items() if v is not None}, h, w, c, np.moveaxis(a, 0, 2).astype(float).ravel()


def read_frames(spark: SparkSession, path: str, recursive: bool = False, metadata_only: bool = False, strict: bool = False) -> DataFrame:
    """All known image files under ``path``; unreadable ones are skipped unless ``strict``. A missing folder gives no rows."""
    schema = HEADER if metadata_only else L1
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.{fits,fit,fts,xisf,tif,tiff,FITS,FIT,FTS,XISF,TIF,TIFF}").load(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) and not strict:
            return spark.createDataFrame([], schema)
        raise
    names = [f.split(" ")[0] for f in schema.replace("map<string,string>", "map").split(", ")]

    def work(batches):
        for pdf in batches:
            rows = []
            for p, data in zip(pdf["path"], pdf["content"]):
                try:
                    rows.append(_row(p, data, metadata_only))
                except (formats.FormatError, KeyError, ValueError, StopIteration):
                    if strict:
                        raise
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(work, schema)


def scan_directory(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(path, frame_type, metadata) of the FITS files in a folder, sorted by path; only headers are read. A folder with a
    scheme, which only Spark reaches, is listed by Spark, and there whole files are."""
    if "://" in path:
        heads = read_frames(spark, path, recursive, metadata_only=True).where(F.lower("path").rlike(r"\.(fits|fit|fts)$"))
    else:
        from frameflow.sources import fits

        heads = fits.read_frames(spark, path, "path,header", recursive=recursive)
    kind = classify_frame_type(F.coalesce(F.element_at("header", "IMAGETYP"), F.element_at("header", "FRAME")))
    return heads.select("path", kind.alias("frame_type"), header_metadata(F.col("header")).alias("metadata")).orderBy("path")


def calibration_library(scan: DataFrame) -> DataFrame:
    """Darks, flats and bias frames of a scan as a library for matching; ``ord`` rises with the path, by sorted ranges."""
    w = scan.where(F.col("frame_type").isin("dark", "flat", "bias")).repartitionByRange("path").sortWithinPartitions("path")
    m = F.col("metadata")
    return w.select(F.monotonically_increasing_id().alias("ord"), "path", "frame_type", m["exposure"].alias("exposure"), m["gain_iso"].cast("bigint").alias("gain"), m["temperature"].alias("temperature"), m["width"].alias("width"), m["height"].alias("height"))


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    raise NotSupported("camera raw files need a demosaicing decoder; convert them to FITS, XISF or TIFF first")


@dataclass
class FilePartition(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], metadata_only: bool):
        self.paths, self.metadata_only = paths, metadata_only

    def partitions(self):
        return [FilePartition(p) for p in self.paths] or [FilePartition("")]

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        if not partition.path:
            return
        with open(partition.path, "rb") as f:
            data = self._head(f) if self.metadata_only and _suffix(partition.path) in (".fits", ".fit", ".fts") else f.read()
        row = _row(partition.path, data, self.metadata_only)
        yield row if self.metadata_only else (*row[:6], row[6].tolist())

    @staticmethod
    def _head(f) -> bytes:
        out = b""
        while block := f.read(formats.BLOCK):
            out += block
            if any(block[k : k + 80].startswith(b"END ") for k in range(0, len(block), 80)):
                break
        return out


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class _Writer(DataSourceWriter):
    """A file a frame, under a temporary name until the whole write commits; a lost task's files are simply left out."""

    def __init__(self, folder: str, kind: str, prefix: str):
        self.folder, self.kind, self.prefix = folder, kind, prefix

    def write(self, rows) -> Written:
        os.makedirs(self.folder, exist_ok=True)
        from pyspark import TaskContext

        done, attempt = [], TaskContext.get().taskAttemptId()
        for r in rows:
            a = np.moveaxis(np.asarray(r["data"], np.float32).reshape(r["h"], r["w"], r["c"]), 2, 0)
            header = {k: formats._card_value(v) if not isinstance(v, str) or v[:1] not in "'" else v for k, v in (r["header"] or {}).items() if not k.startswith(("SIMPLE", "BITPIX", "NAXIS", "EXTEND", "BSCALE", "BZERO"))} if "header" in r else {}
            name = f"{self.prefix}{r['frame_id']}{formats.SUFFIX[self.kind]}"
            with open(os.path.join(self.folder, f".{attempt}-{name}"), "wb") as f:
                f.write(formats.ENCODERS[self.kind](a, header))
            done.append(f"{attempt}-{name}")
        return Written(done)

    def commit(self, messages) -> None:
        for m in messages:
            for name in m.files if m else []:
                os.replace(os.path.join(self.folder, f".{name}"), os.path.join(self.folder, name.split("-", 1)[1]))

    def abort(self, messages) -> None:
        for m in messages:
            for name in m.files if m else []:
                if os.path.exists(p := os.path.join(self.folder, f".{name}")):
                    os.remove(p)


class FitsSource(DataSource):
    kind = "fits"

    @classmethod
    def name(cls) -> str:
        return cls.kind

    def schema(self) -> str:
        return HEADER if self._only() else L1

    def _only(self) -> bool:
        return self.options.get("metadataOnly", "false").lower() == "true"

    def reader(self, schema) -> _Reader:
        path = self.options["path"]
        found = [path] if os.path.isfile(path) else sorted(p for p in glob.glob(os.path.join(path, "**"), recursive=self.options.get("recursive", "false") == "true") + glob.glob(os.path.join(path, "*")) if formats.DECODERS.get(_suffix(p)) is formats.DECODERS[formats.SUFFIX[self.kind]])
        return _Reader(sorted(set(found)), self._only())

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], self.kind, self.options.get("prefix", "frame_"))


class XisfSource(FitsSource):
    kind = "xisf"


class Tiff32Source(FitsSource):
    kind = "tiff32"


def register(spark: SparkSession) -> None:
    for source in (FitsSource, XisfSource, Tiff32Source):
        spark.dataSource.register(source)


def export(spark: SparkSession, kind: str, folder: str, result: DataFrame, starless: DataFrame | None = None, mask: DataFrame | None = None) -> None:
    """Write a result and, where given, its starless image and mask with their suffixes."""
    if kind not in formats.ENCODERS:
        raise ValueError(f"no export format {kind!r}")
    register(spark)
    for df, prefix in ((result, "result_"), (starless, "result_starless_"), (mask, "result_starmask_")):
        if df is not None:
            df.write.format(kind).mode("append").option("prefix", prefix).save(folder)


def write_photometry(stars: DataFrame, folder: str) -> None:
    """The star table as CSV with a header."""
    stars.select("star_id", "ra", "dec", "instr_mag", "catalog_mag", "cal_mag", "residual").write.mode("overwrite").option("header", "true").csv(folder)


def write_frame_stats(entries: DataFrame, folder: str) -> None:
    """The frame list's statistics as CSV with a header, in the seven columns of ``frame_stats``."""
    frame_stats(entries).write.mode("overwrite").option("header", "true").csv(folder)
