"""FITS files as Spark data sources on a folder that all executors mount: 'fitsframes' (batch and stream) and 'fitstable'.

'fitsframes' reads a file's header block by block. Conditions on the header's columns (``where`` of ``read_frames``) are
decided there, so that the data unit of a file that doesn't pass is never read; it isn't either where the schema that the
query asks for leaves data out. Many small files share a partition. Conditions are an option of the source, and not pushed
by Spark's optimizer: Spark 4.1 keeps filters that were pushed to a Python source with the relation, so that two branches
of one DataFrame, or a later query without a filter, would get each other's.

As a stream its offsets are places in a log: a numbered file of JSON lists the image files that were new at one look at the
folder. Logged files never change, so a batch that is planned again after a restart has the same files, and each file is
in one batch. The log lies beside the images (option ``log``), and any number of queries may read by it.

'fitstable' writes a binary table for each frame_id, in as many files as tasks held rows of it (one, if the rows were
partitioned by it), and reads them back.
"""

from __future__ import annotations

import contextlib
import glob
import json
import operator
import os
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from frameflow.sources import formats
from frameflow.sources.images import _frame_id

SUFFIXES = (".fits", ".fit", ".fts")
FRAMES = "path string, frame_id bigint, imagetyp string, object string, exposure double, gain double, temperature double, date_obs string, h int, w int, c int, header map<string,string>, data array<double>"
# The cards that a column is read from, the first that is there.
CARDS = {"imagetyp": ("IMAGETYP", "FRAME"), "object": ("OBJECT",), "exposure": ("EXPTIME", "EXPOSURE"), "gain": ("GAIN", "ISOSPEED"), "temperature": ("CCD-TEMP", "SET-TEMP"), "date_obs": ("DATE-OBS",)}
NUMBERS = ("exposure", "gain", "temperature")
FILES, BYTES = 512, 128 << 20  # of a partition, at most (or one file)


# -- reading

class Ranged:
    """A file that is read by ranges; ``read`` counts the bytes."""

    def __init__(self, path: str):
        self.path, self.read = path, 0

    def __enter__(self) -> Ranged:
        self.file = open(self.path, "rb", buffering=0)
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def take(self, n: int) -> bytes:
        out = b""
        while len(out) < n and (got := self.file.read(n - len(out))):
            out += got
        self.read += len(out)
        return out

    def header(self) -> bytes:
        """The primary header's blocks, up to the one with END."""
        blocks = []
        while len(block := self.take(formats.BLOCK)) == formats.BLOCK:
            blocks.append(block)
            if len(blocks) == 1 and block[:9] != b"SIMPLE  =":
                break
            if any(block[k : k + 80].rstrip() == b"END" for k in range(0, formats.BLOCK, 80)):
                return b"".join(blocks)
        raise formats.FormatError(f"{self.path} isn't a FITS file, or is cut short")


def described(path: str, cards: dict) -> dict:
    """A file's columns but for data, from its header's cards."""
    out = {"path": path, "frame_id": _frame_id(path), "header": {k: str(v) for k, v in cards.items() if v is not None}}
    for name, keys in CARDS.items():
        value = next((cards[k] for k in keys if cards.get(k) is not None), None)
        if value is not None and name in NUMBERS:
            with contextlib.suppress(ValueError):
                out[name] = float(value)
        elif value is not None:
            out[name] = str(value)
    sides = [int(cards.get(f"NAXIS{k}", 1)) for k in (1, 2, 3)]
    return out | {"w": sides[0], "h": sides[1], "c": sides[2]}


TESTS = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "in": lambda a, b: a in b, "starts": lambda a, b: a.startswith(b), "contains": lambda a, b: b in a}
DECIDED = {"path", "frame_id", "h", "w", "c"} | CARDS.keys()


def conditions(where: list[tuple]) -> list[tuple]:
    """(column, test, value) triples, checked."""
    for column, test, _ in where:
        if column not in DECIDED or test not in TESTS:
            raise ValueError(f"a header doesn't decide {column} {test}; columns: {sorted(DECIDED)}, tests: {list(TESTS)}")
    return [tuple(x) for x in where]


def passes(condition: tuple, row: dict) -> bool:
    """As in SQL, null passes no test."""
    column, test, value = condition
    return row.get(column) is not None and TESTS[test](row[column], value)


@dataclass
class Files(InputPartition):
    paths: list[str]


def shared_out(found: list[tuple[str, int]], headers_only: bool) -> list[Files]:
    """Paths with their sizes in partitions of at most FILES files, and BYTES bytes where those are read."""
    out, held = [], BYTES
    for path, size in found:
        size = min(size, formats.BLOCK) if headers_only else size
        if not out or len(out[-1].paths) >= FILES or held + size > BYTES:
            out.append(Files([]))
            held = 0
        out[-1].paths.append(path)
        held += size
    return out


def listed(folder: str, recursive: bool) -> list[tuple[str, int]]:
    """(path, size) of a folder's FITS files in order; hidden ones are left out."""
    if os.path.isfile(folder):
        return [(folder, os.path.getsize(folder))]
    found = []
    for at, folders, names in os.walk(folder):
        folders[:] = sorted(d for d in folders if recursive and d[0] not in "._")
        for name in names:
            if name.lower().endswith(SUFFIXES) and name[0] not in "._":
                with contextlib.suppress(FileNotFoundError):
                    found.append((p := os.path.join(at, name), os.path.getsize(p)))
    return sorted(found)


@dataclass
class Rows:
    """How a partition's files become rows: the columns asked for, and the filters that their headers decide."""

    columns: list[str]
    strict: bool = False
    where: list = field(default_factory=list)

    def rows(self, paths: list[str], count=None) -> Iterator[tuple]:
        for path in paths:
            with Ranged(path) as f:
                try:
                    head = f.header()
                    cards, _ = formats.fits_header(head)
                    row = described(path, cards)
                    if all(passes(x, row) for x in self.where):
                        if "data" in self.columns:
                            size = abs(int(cards["BITPIX"])) // 8 * int(np.prod([int(cards[f"NAXIS{k}"]) for k in range(1, int(cards["NAXIS"]) + 1)]))
                            row["data"] = np.moveaxis(formats.fits_decode(head + f.take(size))[1], 0, 2).astype(float).ravel().tolist()
                        yield tuple(row.get(c.lower()) for c in self.columns)
                except (formats.FormatError, KeyError, ValueError):
                    if self.strict:
                        raise
                finally:
                    if count is not None:
                        count(f.read)


def _made(options, schema: StructType) -> Rows:
    return Rows(schema.fieldNames(), options.get("strict", "false").lower() == "true", conditions(json.loads(options.get("where", "[]"))))


class FramesReader(DataSourceReader):
    def __init__(self, options, schema: StructType):
        self.folder, self.recursive, self.made = options["path"], options.get("recursive", "false").lower() == "true", _made(options, schema)

    def partitions(self):
        return shared_out(listed(self.folder, self.recursive), "data" not in self.made.columns) or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.made.rows(partition.paths)


class FramesStream(DataSourceStreamReader):
    """Offsets {"look": n}: the last look at the folder that a batch has; -1 is before the first."""

    def __init__(self, options, schema: StructType):
        self.folder, self.recursive = options["path"], options.get("recursive", "false").lower() == "true"
        self.log = options.get("log", os.path.join(self.folder, "_frames_log"))
        self.most = int(options.get("maxFilesPerTrigger", str(1 << 31)))
        self.made = _made(options, schema)
        self.seen, self.looks = set(), 0

    def _look(self, n: int) -> list[tuple[str, int]]:
        with open(os.path.join(self.log, f"{n:012d}.json")) as f:
            return [tuple(x) for x in json.load(f)]

    def _catch_up(self) -> None:
        while os.path.exists(os.path.join(self.log, f"{self.looks:012d}.json")):
            self.seen.update(p for p, _ in self._look(self.looks))
            self.looks += 1

    def initialOffset(self) -> dict:  # noqa: N802
        return {"look": -1}

    def latestOffset(self) -> dict:  # noqa: N802
        self._catch_up()
        new = [x for x in listed(self.folder, self.recursive) if x[0] not in self.seen][: self.most]
        if new:
            os.makedirs(self.log, exist_ok=True)
            made = os.path.join(self.log, f".{uuid.uuid4().hex}")
            with open(made, "w") as f:
                json.dump(new, f)
            with contextlib.suppress(FileExistsError):  # another query has just looked: its look counts
                os.link(made, os.path.join(self.log, f"{self.looks:012d}.json"))
            os.remove(made)
            self._catch_up()
        return {"look": self.looks - 1}

    def partitions(self, start: dict, end: dict):
        files = [x for n in range(start["look"] + 1, end["look"] + 1) for x in self._look(n)]
        return shared_out(files, "data" not in self.made.columns)

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.made.rows(partition.paths)


class FramesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fitsframes"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema: StructType) -> FramesReader:
        return FramesReader(self.options, schema)

    def streamReader(self, schema: StructType) -> FramesStream:  # noqa: N802
        return FramesStream(self.options, schema)


# -- tables

# Binary table codes by Spark type, with NumPy's types for them.
KINDS = {"int": ("J", ">i4"), "bigint": ("K", ">i8"), "float": ("E", ">f4"), "double": ("D", ">f8")}
TEXT = 64  # bytes of a text column, unless the option ``text`` says otherwise
OPEN, ROWS = 64, 4096  # files that a task holds open, rows that it gathers for each


@dataclass
class Tables(WriterCommitMessage):
    made: list[tuple[int, str, int]]  # frame, file, rows


def _columns(schema: StructType, text: int) -> list[tuple[str, str, str]]:
    out = []
    for f in schema.fields:
        kind = f.dataType.simpleString()
        if f.name != "frame_id":
            if kind not in KINDS and kind != "string":
                raise ValueError(f"a FITS table has no column of type {kind}")
            out.append((f.name, *(KINDS[kind] if kind in KINDS else (f"{text}A", f"S{text}"))))
    return out


class TableWriter(DataSourceWriter):
    """Rows go to hidden files under this write's own name. A file's header is written last, with its number of rows, and
    files get their names when all tasks have ended well; a failed task deletes its own."""

    def __init__(self, options, schema: StructType):
        self.folder, self.write_id = options["path"], uuid.uuid4().hex[:12]
        self.columns, self.text = _columns(schema, int(options.get("text", TEXT))), int(options.get("text", TEXT))
        if "frame_id" not in schema.fieldNames():
            raise ValueError("a FITS table needs the column frame_id")

    def header(self, frame: int, n: int) -> bytes:
        width = sum(np.dtype(k).itemsize for _, _, k in self.columns)
        cards = [("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", width), ("NAXIS2", n), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", len(self.columns)), ("FRAMEID", frame)]
        cards += [c for k, (name, code, _) in enumerate(self.columns, 1) for c in ((f"TTYPE{k}", name), (f"TFORM{k}", code))]
        return formats._cards_block([("SIMPLE", True), ("BITPIX", 8), ("NAXIS", 0), ("EXTEND", True)]) + formats._cards_block(cards)

    def write(self, rows) -> Tables:
        from pyspark import TaskContext

        os.makedirs(self.folder, exist_ok=True)
        task = TaskContext.get().taskAttemptId()
        held: dict[int, list] = {}
        counts: dict[int, int] = {}
        files: OrderedDict[int, object] = OrderedDict()
        kind = np.dtype([(name, k) for name, _, k in self.columns])

        def path(frame: int) -> str:
            return os.path.join(self.folder, f".{self.write_id}-{task}-{frame}")

        def out(frame: int):
            if frame not in files:
                if len(files) >= OPEN:
                    files.popitem(last=False)[1].close()
                files[frame] = open(path(frame), "r+b" if frame in counts else "w+b")
                if frame not in counts:
                    counts[frame] = 0
                    files[frame].write(self.header(frame, 0))
            files.move_to_end(frame)
            return files[frame]

        def flush(frame: int) -> None:
            rows_, f = held.pop(frame), out(frame)
            f.seek(0, 2)
            f.write(np.array(rows_, kind).tobytes())
            counts[frame] += len(rows_)

        try:
            gathered = 0
            for r in rows:
                frame = int(r["frame_id"])
                held.setdefault(frame, []).append(tuple(self._cell(r[name], code) for name, code, _ in self.columns))
                gathered += 1
                if len(held[frame]) >= ROWS:
                    gathered -= len(held[frame])
                    flush(frame)
                elif gathered >= OPEN * ROWS:
                    for x in list(held):
                        flush(x)
                    gathered = 0
            for frame in list(held):
                flush(frame)
            for frame, n in counts.items():
                f = out(frame)
                f.seek(0, 2)
                f.write(b"\0" * (-f.tell() % formats.BLOCK))
                f.seek(0)
                f.write(self.header(frame, n))
                f.flush()
            return Tables([(frame, os.path.basename(path(frame)), n) for frame, n in counts.items()])
        except BaseException:
            for frame in counts:
                with contextlib.suppress(FileNotFoundError):
                    os.remove(path(frame))
            raise
        finally:
            for f in files.values():
                f.close()

    def _cell(self, value, code: str):
        if code.endswith("A"):
            data = (value or "").encode()
            if len(data) > self.text:
                raise ValueError(f"{value[:40]!r} ... has more than {self.text} bytes; set the option text")
            return data
        if value is None:
            if code in "ED":
                return np.nan
            raise ValueError("integers of a FITS table can't be null")
        return value

    def _clean(self) -> None:
        for p in glob.glob(os.path.join(glob.escape(self.folder), f".{self.write_id}-*")):
            os.remove(p)

    def commit(self, messages) -> None:
        parts: dict[int, int] = {}
        for frame, name, _ in sorted(x for m in messages if m for x in m.made):
            k = parts[frame] = parts.get(frame, 0) + 1
            os.replace(os.path.join(self.folder, name), os.path.join(self.folder, f"table_{frame}" + (f"_{k}" if k > 1 else "") + ".fits"))
        self._clean()

    def abort(self, messages) -> None:
        self._clean()


def _table_header(f: Ranged) -> tuple[dict, np.dtype]:
    head = f.header()
    more = []
    while len(block := f.take(formats.BLOCK)) == formats.BLOCK:
        more.append(block)
        if any(block[k : k + 80].rstrip() == b"END" for k in range(0, formats.BLOCK, 80)):
            break
    cards, _ = formats.fits_header(head + b"".join(more), len(head))
    kinds = {code: k for code, k in KINDS.values()}
    names = [(str(cards[f"TTYPE{k}"]), str(cards[f"TFORM{k}"]).strip()) for k in range(1, int(cards["TFIELDS"]) + 1)]
    return cards, np.dtype([(n, kinds.get(code) or f"S{code[:-1]}") for n, code in names])


class TableReader(DataSourceReader):
    def __init__(self, options, schema: StructType):
        self.folder, self.columns, self.where = options["path"], schema.fieldNames(), json.loads(options.get("where", "[]"))

    def partitions(self):
        return shared_out(listed(self.folder, False), False) or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            with Ranged(path) as f:
                cards, kind = _table_header(f)
                if not all(passes(x, {"frame_id": cards["FRAMEID"]}) for x in self.where):
                    continue
                left = int(cards["NAXIS2"])
                while left:
                    rows = np.frombuffer(f.take(min(left, ROWS) * kind.itemsize), kind)
                    left -= len(rows)
                    columns = [[int(cards["FRAMEID"])] * len(rows) if c == "frame_id" else [v.decode() for v in rows[c]] if kind[c].kind == "S" else rows[c].tolist() for c in self.columns]
                    yield from zip(*columns, strict=True)


class TableSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fitstable"

    def schema(self) -> str:
        """By the first file's header."""
        found = listed(self.options["path"], False)
        if not found:
            raise ValueError("there is no FITS table; name the schema")
        with Ranged(found[0][0]) as f:
            _, kind = _table_header(f)
        types = {np.dtype(k): t for t, (_, k) in KINDS.items()}
        return "frame_id bigint, " + ", ".join(f"`{n}` {types.get(kind[n], 'string')}" for n in kind.names)

    def reader(self, schema: StructType) -> TableReader:
        return TableReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> TableWriter:
        return TableWriter(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FramesSource)
    spark.dataSource.register(TableSource)


def _loaded(reader, folder: str, columns: str | None, **options) -> DataFrame:
    for name, value in options.items():
        if value is not None:
            reader = reader.option(name, value if isinstance(value, str) else json.dumps(value))
    return (reader.schema(_some(columns)) if columns else reader).load(folder)


def read_frames(spark: SparkSession, folder: str, columns: str | None = None, where: list[tuple] = (), recursive: bool = False, strict: bool = False) -> DataFrame:
    """The FITS files of a folder whose headers pass all of ``where`` (triples such as ('imagetyp', '=', 'DARK')), with those
    of FRAMES' columns that are named, or all."""
    register(spark)
    return _loaded(spark.read.format("fitsframes"), folder, columns, where=conditions(where), recursive=recursive, strict=strict)


def stream_frames(spark: SparkSession, folder: str, columns: str | None = None, where: list[tuple] = (), log: str | None = None, most: int | None = None) -> DataFrame:
    """The same as a stream of the files that land in the folder (whole: move them there)."""
    register(spark)
    return _loaded(spark.readStream.format("fitsframes"), folder, columns, where=conditions(where), log=log, maxFilesPerTrigger=most)


def read_tables(spark: SparkSession, folder: str, where: list[tuple] = ()) -> DataFrame:
    """The rows of a folder's tables; those of frames that don't pass (tests on frame_id) aren't read."""
    register(spark)
    return _loaded(spark.read.format("fitstable"), folder, None, where=conditions(where))


def _some(columns: str) -> str:
    kinds = dict(x.split(" ", 1) for x in FRAMES.split(", "))
    return ", ".join(f"{c} {kinds[c]}" for c in columns.replace(" ", "").split(","))


def write_tables(rows: DataFrame, folder: str, order: list[str] = (), text: int = TEXT) -> None:
    """A FITS table for each frame_id, written by as many tasks as the shuffle has."""
    register(rows.sparkSession)
    placed = rows.repartition("frame_id").sortWithinPartitions("frame_id", *[F.col(c) for c in order])
    placed.write.format("fitstable").mode("append").option("text", str(text)).save(folder)
