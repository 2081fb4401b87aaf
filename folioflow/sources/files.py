"""Folders of audio and container files as Python data sources.

The driver lists paths and sizes; tasks open the files and read the ranges that they
need: headers alone, a stretch of a long file's samples, or some members of a
container. Filters on the file's or member's name are applied before anything is
opened. register() makes the formats known; they need a file system that pyarrow knows.
"""

from __future__ import annotations

import struct
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith

from .. import constants as C

#: Names that Hadoop's connectors have for schemes of pyarrow.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs"}
#: Headers per task, bytes of samples or containers per task, and frames of a row of samples.
HEADERS, SPLIT_BYTES, FRAMES = 256, 64 << 20, 1 << 16


def located(uri: str) -> tuple[fs.FileSystem, str, str]:
    """(file system, path there, URI as Spark has it, without a closing slash); a path without a scheme is on the local disk."""
    scheme, found, rest = uri.partition(":")
    if not found:
        scheme, rest = "file", str(Path(uri).resolve())
    if scheme == "file":
        path = "/" + rest.strip("/")
        return fs.LocalFileSystem(), path, f"file:{path}"
    where, path = fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")
    return where, path.rstrip("/"), uri.rstrip("/")


def listed(uri: str, recursive: bool, suffixes: Sequence[str]) -> list[tuple[str, int]]:
    """(URI, size) of the files in a folder, or of the one file, sorted, by suffix in any case."""
    where, root, base = located(uri)
    info = where.get_file_info(root)
    found = where.get_file_info(fs.FileSelector(root, recursive=recursive)) if info.type == fs.FileType.Directory else [info]
    ends = tuple(s.lower() for s in suffixes)
    return sorted((base + f.path[len(root) :], f.size) for f in found if f.type == fs.FileType.File and f.path.lower().endswith(ends or ""))


def _passes(name: str, tests: Sequence[Filter]) -> bool:
    for t in tests:
        ok = (
            name == t.value if isinstance(t, EqualTo)
            else name in t.value if isinstance(t, In)
            else name.endswith(t.value) if isinstance(t, StringEndsWith)
            else name.startswith(t.value)
        )
        if not ok:
            return False
    return True


@dataclass(frozen=True)
class Layout:
    """Where a WAV file's samples are."""

    rate: int
    channels: int
    width: int
    at: int
    frames: int


class _Counted:
    """A file that counts the bytes that are read from it."""

    def __init__(self, file):
        self.file, self.count = file, 0

    def read_at(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        out = self.file.read(n)
        self.count += len(out)
        return out


def wav_layout(file: _Counted, size: int) -> Layout:
    """The layout of an uncompressed WAV file, by the heads of its sections; ValueError for anything else."""
    head = file.read_at(0, 12)
    if head[:4] not in (b"RIFF", b"RF64") or head[8:12] != b"WAVE":
        raise ValueError("no WAV file")
    at, large, form = 12, None, None
    while len(section := file.read_at(at, 8)) == 8:
        name, length = struct.unpack("<4sI", section)
        if name == b"ds64":
            large = struct.unpack("<Q", file.read_at(at + 16, 8))[0]
        elif name == b"fmt ":
            form = struct.unpack("<HHIIHH", file.read_at(at + 8, 16))
        elif name == b"data":
            if form is None:
                raise ValueError("samples before their format")
            kind, channels, rate, _, frame, bits = form
            if kind not in (1, 0xFFFE) or not frame or bits not in (8, 16, 24, 32):
                raise ValueError(f"format {kind} with {bits} bits")
            length = large if large is not None and length == 0xFFFFFFFF else length
            return Layout(rate, channels, bits // 8, at + 8, min(length, size - at - 8) // frame)
        at += 8 + length + length % 2
    raise ValueError("no samples")


def pcm_samples(raw: bytes, width: int) -> np.ndarray:
    """Samples from -1 to below 1 of little-endian integers of width bytes; single bytes are unsigned."""
    if width == 3:
        triple = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        wide = np.concatenate([np.zeros((len(triple), 1), np.uint8), triple], axis=1)
        return (wide.reshape(-1).view("<i4") >> 8).astype(np.float32) / 2**23
    if width == 1:
        return (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    if width in (2, 4):
        return np.frombuffer(raw, f"<i{width}").astype(np.float32) / 2 ** (8 * width - 1)
    raise ValueError(f"samples of {width} bytes")


class _Reader(DataSourceReader):
    """Listing, filters on the file's name, and tasks of files that follow each other."""

    column = "file"

    def __init__(self, options: dict):
        self.path = options["path"]
        self.recursive = options.get("recursive", "true").lower() != "false"
        self.suffixes = [s for s in options.get("suffixes", ",".join(self.default_suffixes)).split(",") if s]
        self.tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, (EqualTo, In, StringEndsWith, StringStartsWith)) and f.attribute == (self.column,):
                self.tests.append(f)
            else:
                yield f

    def files(self) -> list[tuple[str, int]]:
        return [x for x in listed(self.path, self.recursive, self.suffixes) if _passes(x[0], self.tests)]


class HeaderReader(_Reader):
    default_suffixes = C.AUDIO_SUFFIXES

    def partitions(self) -> list[InputPartition]:
        files = self.files()
        return [InputPartition(files[k : k + HEADERS]) for k in range(0, len(files), HEADERS)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for file, size in partition.value if partition else ():
            where, path, _ = located(file)
            with where.open_input_file(path) as opened:
                counted = _Counted(opened)
                try:
                    x = wav_layout(counted, size)
                    row = (x.rate, x.channels, x.width * 8, x.frames, x.frames / x.rate if x.rate else None, None)
                except (ValueError, struct.error) as e:
                    row = (None, None, None, None, None, str(e))
            yield (file, size, *row[:5], counted.count, row[5])


class SampleReader(_Reader):
    """Samples in rows of FRAMES frames; a long file is cut into ranges, each read by a task of its own."""

    default_suffixes = C.AUDIO_SUFFIXES

    def partitions(self) -> list[InputPartition]:
        out: list[list] = [[]]
        held = 0
        for file, size in self.files():
            ranges = max(1, -(-size // SPLIT_BYTES))
            for k in range(ranges):
                if held + size // ranges > SPLIT_BYTES and out[-1]:
                    out.append([])
                    held = 0
                out[-1].append((file, size, k, ranges))
                held += size // ranges
        return [InputPartition(x) for x in out if x]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        names = ("file", "start", "sample_rate", "channels", "frames", "samples", "error")
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float32()), pa.string())
        for file, size, k, ranges in partition.value if partition else ():
            where, path, _ = located(file)
            with where.open_input_file(path) as opened:
                counted = _Counted(opened)
                try:
                    x = wav_layout(counted, size)
                except (ValueError, struct.error) as e:
                    if k == 0:
                        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((file, None, None, None, None, None, str(e)), kinds, strict=True)], names)
                    continue
                first, last, frame = x.frames * k // ranges, x.frames * (k + 1) // ranges, x.channels * x.width
                for a in range(first, max(last, first + (k == 0)), FRAMES):  # an empty file is one row
                    n = min(FRAMES, last - a)
                    samples = pcm_samples(counted.read_at(x.at + a * frame, n * frame), x.width)
                    row = (file, a, x.rate, x.channels, x.frames, samples, None)
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names)


class MemberReader(_Reader):
    """Members of containers: a container's directory is read first, then the members that the filters let through."""

    column = "name"
    default_suffixes = (".epub",)

    def files(self) -> list[tuple[str, int]]:
        return listed(self.path, self.recursive, self.suffixes)

    def partitions(self) -> list[InputPartition]:
        out: list[list] = [[]]
        held = 0
        for file, size in self.files():
            if held + size > SPLIT_BYTES and out[-1]:
                out.append([])
                held = 0
            out[-1].append(file)
            held += size
        return [InputPartition(x) for x in out if x]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for file in partition.value if partition else ():
            where, path, _ = located(file)
            with where.open_input_file(path) as opened:
                try:
                    archive = zipfile.ZipFile(opened)
                    for m in archive.infolist():
                        if not m.is_dir() and _passes(m.filename, self.tests):
                            yield (file, m.filename, m.file_size, archive.read(m))
                except (zipfile.BadZipFile, OSError, ValueError):
                    continue


class AudioHeaders(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folio_audio_headers"

    def schema(self) -> str:
        return "file string, size long, sample_rate int, channels int, bits int, frames long, duration_seconds double, bytes_read long, error string"

    def reader(self, schema) -> DataSourceReader:
        return HeaderReader(self.options)


class AudioSamples(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folio_audio_samples"

    def schema(self) -> str:
        return "file string, start long, sample_rate int, channels int, frames long, samples array<float>, error string"

    def reader(self, schema) -> DataSourceReader:
        return SampleReader(self.options)


class ContainerMembers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folio_members"

    def schema(self) -> str:
        return "book string, name string, size long, content binary"

    def reader(self, schema) -> DataSourceReader:
        return MemberReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the formats known to a session, and let it push filters into them."""
    for source in (AudioHeaders, AudioSamples, ContainerMembers):
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def _read(spark: SparkSession, source: type[DataSource], path: str, recursive: bool, suffixes: Sequence[str]) -> DataFrame:
    register(spark)
    options = {"path": path, "recursive": str(recursive), "suffixes": ",".join(suffixes)}
    return spark.read.format(source.name()).options(**options).load()


def audio_headers(spark: SparkSession, path: str, recursive: bool = True, suffixes: Sequence[str] = C.AUDIO_SUFFIXES) -> DataFrame:
    """file, size, sample_rate, channels, bits, frames, duration_seconds, bytes_read and error of each audio file, by its header."""
    return _read(spark, AudioHeaders, path, recursive, suffixes)


def audio_samples(spark: SparkSession, path: str, recursive: bool = True, suffixes: Sequence[str] = C.AUDIO_SUFFIXES) -> DataFrame:
    """Samples of each audio file in rows of bounded size: file, start (frame), sample_rate, channels, frames (of the file), samples, error."""
    return _read(spark, AudioSamples, path, recursive, suffixes)


def container_members(spark: SparkSession, path: str, recursive: bool = True, suffixes: Sequence[str] = (".epub",)) -> DataFrame:
    """book, name, size and content of the members of each container; one that is damaged has none."""
    return _read(spark, ContainerMembers, path, recursive, suffixes)
