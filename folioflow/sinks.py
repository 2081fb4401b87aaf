"""Sinks: JSON reports, chapter markers and WAV files."""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

from pyarrow import fs
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .sources.files import located


def as_json(df: DataFrame, *keys: str) -> DataFrame:
    """keys and one JSON document per row in column value."""
    return df.select(*keys, F.to_json(F.struct("*")).alias("value"))


def write_json(df: DataFrame, path: str, *partitions: str) -> None:
    """One JSON line per row; Spark's commit makes a rerun safe."""
    df.write.mode("overwrite").partitionBy(*partitions).json(path)


def escaped(text: Column) -> Column:
    """Text as a value in a chapter-marker file."""
    return F.regexp_replace(text, r"([=;#\\\n])", r"\\$1")


def chapter_markers(timed: DataFrame, titles: DataFrame, book: str = "book") -> DataFrame:
    """book and its chapter-marker file: header, title, artist, then each chapter's start and end in milliseconds.

    timed has book, idx, title, start_ms, end_ms; titles has book, title, creator.
    """
    block = F.concat_ws(
        "\n", F.lit("[CHAPTER]"), F.lit("TIMEBASE=1/1000"), F.concat(F.lit("START="), F.col("start_ms").cast("string")),
        F.concat(F.lit("END="), F.col("end_ms").cast("string")), F.concat(F.lit("title="), escaped(F.col("title"))),
    )
    ordered = F.sort_array(F.collect_list(F.struct("idx", block.alias("block"))))
    body = timed.groupBy(book).agg(F.array_join(F.transform(ordered, lambda x: x["block"]), "\n").alias("_body"))
    rows = body.join(titles.select(book, F.col("title").alias("_title"), F.col("creator").alias("_creator")), book, "left")
    head = F.concat_ws(
        "\n", F.lit(";FFMETADATA1"), F.concat(F.lit("title="), escaped(F.col("_title"))), F.concat(F.lit("artist="), escaped(F.col("_creator")))
    )
    return rows.select(book, F.concat_ws("\n", head, "_body", F.lit("")).alias("markers"))


@dataclass
class Written(WriterCommitMessage):
    """(staged path, name) of the files of one task."""

    files: list[tuple[str, str]]


class _FileWriter(DataSourceWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite = folder, overwrite
        # A name that listings of data skip.
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> Written:
        """Files of a task: rows come sorted by name and part, and each attempt writes to a folder of its own."""
        where, root, _ = located(self.folder)
        attempt = f"{root}/{self.staging}/{uuid.uuid4().hex}"
        files: list[tuple[str, str]] = []
        for name, parts in groupby(rows, key=lambda r: r[0]):
            staged = f"{attempt}/{len(files)}"
            where.create_dir(attempt, recursive=True)
            with where.open_output_stream(staged) as out:
                for r in parts:
                    out.write(r[2])
            files.append((staged, name))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        """Give all files their names, or none if one is there already or comes twice."""
        where, root, _ = located(self.folder)
        files = [x for m in messages if m for x in m.files]
        names = Counter(name for _, name in files)
        twice = [n for n, k in names.items() if k > 1]
        # An overwriting run replaces files of the same name and leaves others alone.
        there = [] if self.overwrite else [n for n in names if where.get_file_info(f"{root}/{n}").type != fs.FileType.NotFound]
        if twice or there:
            self.abort(messages)
            raise ValueError(f"files come twice: {twice[:3]}" if twice else f"files exist: {there[:3]}")
        for folder in {f"{root}/{n}".rpartition("/")[0] for n in names}:
            where.create_dir(folder, recursive=True)
        for staged, name in files:
            where.move(staged, f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        where, root, _ = located(self.folder)
        if where.get_file_info(f"{root}/{self.staging}").type != fs.FileType.NotFound:
            where.delete_dir(f"{root}/{self.staging}")


class FileSink(DataSource):
    """Rows (name, part, content) as files. Nothing is visible before all tasks are done; a failed job leaves nothing."""

    @classmethod
    def name(cls) -> str:
        return "folio_files"

    def schema(self) -> str:
        return "name string, part long, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _FileWriter(self.options["path"], overwrite)


def write_parts(df: DataFrame, folder: str, overwrite: bool = True) -> None:
    """Write each name's content (BINARY), in the order of part, to one file in folder, which a task streams part by part.

    folder: a URI of a file system that all executors share. A path without a
    scheme is the driver's own disk, which tasks share with it in local mode only.
    Files appear when all are complete. Rows with a null name or content are left out.
    """
    spark = df.sparkSession
    if not re.match(r"[a-z][a-z0-9+.-]*:", folder) and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"executors don't share the folder {folder!r}; name it with its file system, as in hdfs://...")
    spark.dataSource.register(FileSink)
    rows = df.select("name", F.col("part").cast("long").alias("part"), "content").filter("name IS NOT NULL AND content IS NOT NULL")
    rows = rows.repartition("name").sortWithinPartitions("name", "part")
    rows.write.format(FileSink.name()).mode("overwrite" if overwrite else "append").option("path", located(folder)[2]).save()


def write_files(df: DataFrame, folder: str, name: str, content: str) -> None:
    """write_parts with column content of each row as a file of its own."""
    write_parts(df.select(F.col(name).alias("name"), F.lit(0).alias("part"), F.col(content).alias("content")), folder)
