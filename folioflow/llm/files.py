"""Binary files in a folder that all executors share, written and read inside tasks by URI."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyarrow import fs


#: Other names that Hadoop's connectors have for schemes of this library.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs"}


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    """(file system, path) of a URI as work_dir gives them; a scheme that tasks can't write to is an error here already."""
    scheme, found, rest = uri.partition(":")
    if not found:
        raise ValueError(f"{uri!r} has no scheme, so driver and executors may take it for different folders")
    try:
        return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}" if scheme != "file" else f"file:///{rest.lstrip('/')}")
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError) as e:
        raise ValueError(f"files can't be written to {uri!r}: set spark.checkpoint.dir to a shared folder of another kind") from e


def make_folder(uri: str) -> None:
    where, path = _at(uri)
    where.create_dir(path, recursive=True)


class NewFile:
    """A file that gets its name only when it is complete.

    Each attempt of a task writes under a name of its own and returns it with its
    rows, so a task that is run again, or twice at a time, harms nothing; a file
    whose rows were not kept is simply never read.
    """

    def __init__(self, folder: str, prefix: str, suffix: str):
        self.name = f"{prefix}-{uuid.uuid4().hex}{suffix}"
        self._fs, path = _at(folder)
        self._path = f"{path.rstrip('/')}/{self.name}"
        self.stream = self._fs.open_output_stream(f"{self._path}.part")
        self.position = 0

    def write(self, data) -> int:
        """Write data and return where it starts."""
        start = self.position
        self.stream.write(data)
        self.position += len(data)
        return start

    def close(self) -> None:
        self.stream.close()
        self._fs.move(f"{self._path}.part", self._path)

    def discard(self) -> None:
        self.stream.close()
        self._fs.delete_file(f"{self._path}.part")


def open_file(folder: str, name: str):
    """A seekable file; a memory map where the folder is local, so that reading copies nothing."""
    where, path = _at(folder)
    path = f"{path.rstrip('/')}/{name}"
    return pa.memory_map(path) if isinstance(where, fs.LocalFileSystem) else where.open_input_file(path)
