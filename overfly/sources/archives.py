"""Archives as Spark data sources: array archives (.npz), tar members, raster headers and strips.

Files are opened by URI through Arrow's file systems (local, HDFS, S3), by ranges, so a task
holds a bounded piece: a slice of an array's rows, a chunk of a tar member, a run of raster
strips; headers are read without what follows them. Which columns are read is told by the
schema that the reader is given: arrays that it does not name are not touched. ``register``
makes the formats known to a session.
"""

from __future__ import annotations

import io
import math
import struct
import tarfile
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, LongType, StructField, StructType

from ..operators.store import ship

#: Bytes that a partition of an array archive, or a row of a tar member or of raster strips, holds.
PIECE = 8 << 20


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or a plain path, and the path in it."""
    if "://" in uri or uri.startswith("file:"):
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri


def files(path: str, ending: str) -> list[str]:
    """A file, or the files below a folder with this ending (of finished writes: names that begin with . or _ are not listed), by name."""
    fs, at = opened(path)
    head = path[: len(path) - len(at)] if path.endswith(at) else ""
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.File:
        return [path]
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = fs.get_file_info(pafs.FileSelector(at, recursive=True))
    return sorted(head + f.path for f in found if f.type == pafs.FileType.File and f.path.endswith(ending) and not f.base_name.startswith((".", "_")))


# --- array archives ----------------------------------------------------------------------


@dataclass
class Stored:
    """An array in an archive: how it is laid out, and where its numbers begin (None: compressed)."""

    dtype: np.dtype
    shape: tuple[int, ...]
    at: int | None


def array_headers(f, names: list[str] | None = None) -> dict[str, Stored]:
    """Headers of an open archive's arrays, without their numbers."""
    out = {}
    with zipfile.ZipFile(f) as z:
        for info in z.infolist():
            name = info.filename.removesuffix(".npy")
            if names is not None and name not in names:
                continue
            with z.open(info) as member:
                version = np.lib.format.read_magic(member)
                shape, column_major, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(member)
                head = member.tell()
            if column_major and len(shape) > 1 or dtype.hasobject:
                raise ValueError(f"array {name!r} is not laid out row by row")
            at = None
            if info.compress_type == zipfile.ZIP_STORED:
                f.seek(info.header_offset + 26)
                at = info.header_offset + 30 + sum(struct.unpack("<HH", f.read(4))) + head
            out[name] = Stored(dtype, shape, at)
    return out


@dataclass
class Rows(InputPartition):
    """Rows lo to hi - 1 of one archive."""

    path: str
    lo: int
    hi: int


class ArrayReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.schema = path, schema

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in files(self.path, ".npz"):
            fs, at = opened(path)
            with fs.open_input_file(at) as f:
                heads = array_headers(f, self.schema.names)
            absent = set(self.schema.names) - set(heads)
            if absent:
                raise ValueError(f"{path} has no array {', '.join(sorted(absent))}")
            n = {h.shape[0] if h.shape else 1 for h in heads.values()}
            if len(n) > 1:
                raise ValueError(f"arrays of {path} have different lengths")
            n = n.pop()
            row = sum(h.dtype.itemsize * math.prod(h.shape[1:]) for h in heads.values())
            # What is compressed has to be read from its beginning: such an archive is one partition.
            step = max(1, PIECE // max(row, 1)) if all(h.at is not None for h in heads.values()) else max(n, 1)
            out += [Rows(path, lo, min(lo + step, n)) for lo in range(0, n, step)]
        return out

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(self.schema)
        fs, at = opened(partition.path)
        with fs.open_input_file(at) as f:
            heads = array_headers(f, self.schema.names)
            streams, archive = {}, None
            for name, h in heads.items():
                if h.at is None:
                    archive = archive or zipfile.ZipFile(f)
                    streams[name] = archive.open(f"{name}.npy")
                    version = np.lib.format.read_magic(streams[name])
                    (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(streams[name])
            width = sum(h.dtype.itemsize * math.prod(h.shape[1:]) for h in heads.values())
            step = max(1, PIECE // 8 // max(width, 1))
            for lo in range(partition.lo, partition.hi, step):
                n = min(step, partition.hi - lo)
                arrays = []
                for field in target:
                    h = heads[field.name]
                    size = h.dtype.itemsize * math.prod(h.shape[1:])
                    if h.at is None:
                        raw = streams[field.name].read(n * size)
                    else:
                        f.seek(h.at + lo * size)
                        raw = f.read(n * size)
                    x = np.frombuffer(raw, h.dtype).astype(h.dtype.newbyteorder("="))
                    if len(h.shape) > 1:
                        per = math.prod(h.shape[1:])
                        a = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * per), pa.array(x))
                    else:
                        a = pa.array(x.astype(str) if h.dtype.kind in "SU" else x)
                    arrays.append(a.cast(field.type))
                yield pa.RecordBatch.from_arrays(arrays, schema=target)


@dataclass
class Written(WriterCommitMessage):
    path: str | None


class ArrayWriter(DataSourceArrowWriter):
    """One archive a task, under a hidden name until the whole write is committed. A task writes its arrays at the end, so it holds its rows: deal rows out to small partitions before."""

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.run = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        batches = list(iterator)
        table = pa.Table.from_batches(batches) if batches else None
        if table is None or not table.num_rows:
            return Written(None)
        arrays = {}
        for name in table.schema.names:
            c = table.column(name).combine_chunks()
            if c.null_count:
                raise ValueError(f"column {name!r} has nulls, which arrays cannot hold")
            if pa.types.is_list(c.type):
                width = set(c.value_lengths().to_pylist())
                if len(width) > 1 or c.flatten().null_count:
                    raise ValueError(f"vectors of {name!r} have different lengths or nulls")
                arrays[name] = np.asarray(c.flatten()).reshape(len(c), -1)
            else:
                arrays[name] = np.asarray(c.to_pylist()) if pa.types.is_string(c.type) else np.asarray(c)
        t = TaskContext.get()
        fs, at = opened(self.path)
        fs.create_dir(at, recursive=True)
        name = f"{at}/_part-{t.partitionId():05d}-{self.run}-{t.attemptNumber()}.npz"
        with fs.open_output_stream(name) as f:
            buffer = io.BytesIO()
            np.savez(buffer, **arrays)
            f.write(buffer.getbuffer())
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        fs, at = opened(self.path)
        fs.create_dir(at, recursive=True)
        old = [x.path for x in fs.get_file_info(pafs.FileSelector(at)) if x.base_name.endswith(".npz") and not x.base_name.startswith(("_", "."))] if self.overwrite else []
        for m in messages:
            if m is not None and m.path:
                folder, _, name = m.path.rpartition("/")
                fs.move(m.path, f"{folder}/{name[1:]}")
        for x in old:
            fs.delete_file(x)

    def abort(self, messages: list[Written | None]) -> None:
        fs, _ = opened(self.path)
        for m in messages:
            if m is not None and m.path and fs.get_file_info(m.path).type == pafs.FileType.File:
                fs.delete_file(m.path)


class ArrayArchive(DataSource):
    """``array_archive``: .npz files, one column per array, one row per entry of its first axis (vectors for two axes)."""

    @classmethod
    def name(cls) -> str:
        return "array_archive"

    def schema(self) -> StructType:
        found = files(self.options["path"], ".npz")
        if not found:
            raise FileNotFoundError(f"no array archive below {self.options['path']}")
        fs, at = opened(found[0])
        with fs.open_input_file(at) as f:
            heads = array_headers(f)
        plain = {"f8": DoubleType(), "f4": FloatType(), "i8": LongType(), "i4": IntegerType()}
        out = []
        for name, h in heads.items():
            kind = plain.get(h.dtype.str[1:])
            if kind is None and h.dtype.kind not in "SU":
                raise ValueError(f"array {name!r} holds {h.dtype}")
            from pyspark.sql.types import StringType

            kind = kind or StringType()
            out.append(StructField(name, ArrayType(kind) if len(h.shape) > 1 else kind))
        return StructType(out)

    def reader(self, schema: StructType) -> ArrayReader:
        return ArrayReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> ArrayWriter:
        return ArrayWriter(self.options["path"], overwrite)


# --- tar members -------------------------------------------------------------------------


@dataclass
class File(InputPartition):
    path: str


class TarReader(DataSourceReader):
    def __init__(self, path: str, content: bool) -> None:
        self.path, self.content = path, content

    def partitions(self) -> list[InputPartition]:
        return [File(p) for p in files(self.path, ".tar")]

    def read(self, partition: File) -> Iterator[tuple]:
        fs, at = opened(partition.path)
        with fs.open_input_file(at) as f, tarfile.open(fileobj=f, mode="r:") as t:
            # Members are found by their headers; content is read a piece at a time, and only if asked for.
            for m in t:
                if not m.isfile():
                    continue
                if not self.content:
                    yield partition.path, m.name, m.size, 0, None
                    continue
                data = t.extractfile(m)
                for part in range(max(1, -(-m.size // PIECE))):
                    yield partition.path, m.name, m.size, part, data.read(PIECE)


class TarArchive(DataSource):
    """``tar_archive``: (path, member, size, part, content) of uncompressed tar files' members; option ``content`` (default false) reads what they hold, in pieces."""

    @classmethod
    def name(cls) -> str:
        return "tar_archive"

    def schema(self) -> str:
        return "path string, member string, size long, part int, content binary"

    def reader(self, schema: StructType) -> TarReader:
        return TarReader(self.options["path"], self.options.get("content", "false").lower() == "true")


# --- rasters -----------------------------------------------------------------------------

# TIFF tags that are read, and bytes of a value by its type.
TAGS = {256: "width", 257: "height", 258: "bits", 259: "compression", 273: "strip_at", 277: "bands", 278: "strip_rows", 279: "strip_bytes", 33550: "scale", 33922: "tie"}
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 12: 8, 16: 8}
TYPE_CODE = {1: "B", 3: "H", 4: "I", 12: "d", 16: "Q"}


def raster_tags(f) -> dict[str, tuple]:
    """The known tags of an open TIFF's first image, without its pixels."""
    order = {b"II": "<", b"MM": ">"}.get(f.read(2))
    if order is None:
        raise ValueError("not a TIFF file")
    big = struct.unpack(order + "H", f.read(2))[0] == 43
    if big:
        f.seek(8)
    f.seek(struct.unpack(order + ("Q" if big else "I"), f.read(8 if big else 4))[0])
    n = struct.unpack(order + ("Q" if big else "H"), f.read(8 if big else 2))[0]
    size, inline = (20, 8) if big else (12, 4)
    entries = f.read(n * size)
    out = {}
    for i in range(n):
        e = entries[i * size : (i + 1) * size]
        tag, kind = struct.unpack(order + "HH", e[:4])
        count = struct.unpack(order + ("Q" if big else "I"), e[4 : size - inline])[0]
        if tag not in TAGS or kind not in TYPE_CODE:
            continue
        raw = e[size - inline :]
        if count * TYPE_SIZE[kind] > inline:
            f.seek(struct.unpack(order + ("Q" if big else "I"), raw)[0])
            raw = f.read(count * TYPE_SIZE[kind])
        out[TAGS[tag]] = struct.unpack(f"{order}{count}{TYPE_CODE[kind]}", raw[: count * TYPE_SIZE[kind]])
    return out


class RasterHeaderReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [File(p) for p in files(self.path, ".tif")]

    def read(self, partition: File) -> Iterator[tuple]:
        fs, at = opened(partition.path)
        with fs.open_input_file(at) as f:
            t = raster_tags(f)
        w, h = t["width"][0], t["height"][0]
        left = top = right = bottom = None
        if "scale" in t and "tie" in t:
            i, j, _, x, y, _ = t["tie"][:6]
            sx, sy = t["scale"][:2]
            left, top = x - i * sx, y + j * sy
            right, bottom = left + w * sx, top - h * sy
        yield partition.path, w, h, t.get("bands", (1,))[0], t.get("bits", (1,))[0], t.get("compression", (1,))[0], top, left, bottom, right


class RasterHeader(DataSource):
    """``raster_header``: size, bands and, where a GeoTIFF tells it, the corners (top, left, bottom, right) of .tif files."""

    @classmethod
    def name(cls) -> str:
        return "raster_header"

    def schema(self) -> str:
        return "path string, width long, height long, bands int, bits int, compression int, top double, left double, bottom double, right double"

    def reader(self, schema: StructType) -> RasterHeaderReader:
        return RasterHeaderReader(self.options["path"])


@dataclass
class Strips(InputPartition):
    path: str
    lo: int
    hi: int


class RasterStripReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        out = []
        for p in files(self.path, ".tif"):
            fs, at = opened(p)
            with fs.open_input_file(at) as f:
                t = raster_tags(f)
            if t.get("compression", (1,))[0] != 1 or "strip_at" not in t:
                raise ValueError(f"{p} has no plain strips")
            step = max(1, PIECE // max(t["strip_bytes"]))
            out += [Strips(p, lo, min(lo + step, len(t["strip_at"]))) for lo in range(0, len(t["strip_at"]), step)]
        return out

    def read(self, partition: Strips) -> Iterator[tuple]:
        fs, at = opened(partition.path)
        with fs.open_input_file(at) as f:
            t = raster_tags(f)
            rows, height = t.get("strip_rows", (t["height"][0],))[0], t["height"][0]
            for i in range(partition.lo, partition.hi):
                f.seek(t["strip_at"][i])
                yield partition.path, i * rows, min(rows, height - i * rows), f.read(t["strip_bytes"][i])


class RasterStrips(DataSource):
    """``raster_strips``: (path, first_row, rows, pixels) of .tif files with plain strips, a partition for each run of strips."""

    @classmethod
    def name(cls) -> str:
        return "raster_strips"

    def schema(self) -> str:
        return "path string, first_row long, rows long, pixels binary"

    def reader(self, schema: StructType) -> RasterStripReader:
        return RasterStripReader(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the four formats known to the session, and this package to its workers."""
    ship(spark)
    for source in (ArrayArchive, TarArchive, RasterHeader, RasterStrips):
        spark.dataSource.register(source)


def write_arrays(rows: DataFrame, path: str, per_file: int = 100_000) -> None:
    """Rows as .npz files of about ``per_file`` rows, in place of what stood there."""
    register(rows.sparkSession)
    parts = max(1, -(-rows.count() // per_file))
    rows.repartition(parts).write.format("array_archive").mode("overwrite").save(path)


def write_tars(members: DataFrame, path: str) -> DataFrame:
    """(archive, member, content) rows to one tar file per archive name; returns (archive, members). An archive's members are one group: archives are what one job leaves."""
    spark = members.sparkSession
    ship(spark)

    def run(key, t):
        fs, at = opened(path)
        fs.create_dir(at, recursive=True)
        t = t.sort_by("member")
        # Written whole under a name that readers pass over, then moved: a repeated task replaces its own file.
        hidden = f"{at}/_{uuid.uuid4().hex}.tar"
        with fs.open_output_stream(hidden) as f, tarfile.open(fileobj=f, mode="w|") as tar:
            for member, content in zip(t.column("member").to_pylist(), t.column("content").to_pylist()):
                info = tarfile.TarInfo(member)
                info.size = len(content)
                tar.addfile(info, io.BytesIO(content))
        fs.move(hidden, f"{at}/{key[0].as_py()}")
        return pa.table({"archive": [key[0].as_py()], "members": pa.array([t.num_rows], pa.int64())})

    return members.groupBy("archive").applyInArrow(run, "archive string, members long")


def raster(width: int, height: int, pixels: bytes, corners: tuple[float, float, float, float] | None = None, strip_rows: int = 16) -> bytes:
    """A little-endian TIFF of one 8-bit band in plain strips; ``corners`` (top, left, bottom, right) are told the GeoTIFF way."""
    strips = [pixels[i * width : (i + strip_rows) * width] for i in range(0, height, strip_rows)]
    first = 8 + len(pixels)
    at = [8 + i * strip_rows * width for i in range(len(strips))]
    entries = [(256, 4, [width]), (257, 4, [height]), (258, 3, [8]), (259, 3, [1]), (262, 3, [1]), (273, 4, at), (277, 3, [1]), (278, 4, [strip_rows]), (279, 4, [len(s) for s in strips])]
    if corners:
        top, left, bottom, right = corners
        entries += [(33550, 12, [(right - left) / width, (top - bottom) / height, 0.0]), (33922, 12, [0.0, 0.0, 0.0, left, top, 0.0])]
    more_at = first + 2 + 12 * len(entries) + 4
    head, more = struct.pack("<H", len(entries)), b""
    for tag, kind, values in entries:
        raw = struct.pack(f"<{len(values)}{TYPE_CODE[kind]}", *values)
        if len(raw) > 4:
            value, more = struct.pack("<I", more_at + len(more)), more + raw
        else:
            value = raw.ljust(4, b"\0")
        head += struct.pack("<HHI", tag, kind, len(values)) + value
    return b"II*\0" + struct.pack("<I", first) + b"".join(strips) + head + struct.pack("<I", 0) + more


def write_rasters(rows: DataFrame, path: str) -> int:
    """(name, width, height, top, left, bottom, right, pixels) rows to a .tif file each; returns how many."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = opened(path)
        fs.create_dir(at, recursive=True)
        for b in batches:
            for r in b.to_pylist():
                hidden = f"{at}/_{uuid.uuid4().hex}.tif"
                with fs.open_output_stream(hidden) as f:
                    f.write(raster(r["width"], r["height"], r["pixels"], (r["top"], r["left"], r["bottom"], r["right"])))
                fs.move(hidden, f"{at}/{r['name']}.tif")
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("name"))], names=["name"])

    columns = ["name", "width", "height", "top", "left", "bottom", "right", "pixels"]
    return rows.select(*columns).mapInArrow(run, "name string").count()
