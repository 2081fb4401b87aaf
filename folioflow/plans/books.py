"""Whole runs: e-books to narration with all reports, and the reports of existing folders.

A conversion writes its chapters, segments and audio to a work folder once, so that no
output reads a container or calls the speech function again; reports are lazy plans.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.text import chapter_file
from ..operators import audio, clean, long_audio, navigation, reports, segments
from ..operators.blocks import html_blocks
from ..operators.classify import judged_blocks
from ..operators.speech import tone
from ..sinks import chapter_markers, write_parts
from ..sources import containers
from ..sources import files as audio_files
from ..sources.reports import earlier_summary, read_reports
from ..work import kept, work_folder


@dataclass(frozen=True)
class Conversion:
    """What a conversion gives, a table each; chapters without text have reports but no audio.

    chapters: book, chapter (from 1), title, href, text and the cleaning report.
    documents: a measured report of each planned chapter. spoken: chapter audio in
    chunks (long_audio.assembled), so that no row holds a chapter. audio_qc: its metrics. markers: a chapter-marker file per book. summary:
    a nested row per book.
    """

    chapters: DataFrame
    documents: DataFrame
    segments: DataFrame
    spoken: DataFrame
    audio_qc: DataFrame
    timeline: DataFrame
    markers: DataFrame
    covers: DataFrame
    summary: DataFrame


def chapter_texts(books: DataFrame, max_chapters: int | None = None, level: str = C.DEFAULT_LEVEL) -> DataFrame:
    """book, chapter, title, href, text and the nested cleaning report of each content chapter; all zero where there is no block."""
    C.check_level(level)
    nav = containers.chapters(books)
    planned = navigation.limited(nav, max_chapters or (1 << 31) - 1)
    bodies = navigation.with_bodies(planned, containers.items(books))
    bodies = bodies.withColumn("chapter_key", F.concat_ws("#", F.col("chapter").cast("string"), "book"))
    judged = judged_blocks(html_blocks(bodies, "chapter_key"), [level], "chapter_key")
    texts = clean.cleaned_text(judged, "chapter_key").drop("strictness")
    report = clean.full_report(judged, "chapter_key").drop("strictness")
    out = bodies.drop("html", "pos").join(texts, "chapter_key", "left").join(report, "chapter_key", "left").withColumn("strictness", F.lit(level))
    counts = [c for c, t in report.dtypes if t == "bigint"]
    filled = {c: F.coalesce(c, F.lit(0)).cast("long") for c in counts} | {c: F.coalesce(c, F.lit(0.0)) for c, t in report.dtypes if t == "double"}
    return out.withColumns({"text": F.coalesce("text", F.lit(""))} | filled)


def convert(
    books: DataFrame,
    speak: Callable[[str], np.ndarray | None] = tone,
    rate: int = 8000,
    calls: int | None = None,
    max_chapters: int | None = None,
    segment_chars: int = C.SEGMENT_CHARS,
    level: str = C.DEFAULT_LEVEL,
    normalization: str = "basic",
    split: Callable[[str], Iterable[str]] = segments.sentences,
) -> Conversion:
    """Convert books (book, content) by a speech function; calls bounds how many of its calls run at a time.

    Each segment is spoken once: what it gives is written before anything else is made of it.
    """
    folder = work_folder(books.sparkSession, "convert")
    chapters = kept(chapter_texts(books, max_chapters, level), f"{folder}/chapters")
    by = ["book", "chapter", "title", "href"]
    texts = chapters.filter(F.trim("text") != "").select("chapter_key", "text")
    cut = kept(segments.segments(texts, segment_chars, normalization, "chapter_key", split), f"{folder}/segments")
    voiced = long_audio.assembled(audio.synthesize(cut, speak, rate, calls), "chapter_key")
    named = chapters.select(*by, "chapter_key", F.concat(chapter_file(F.col("chapter"), F.col("title")), F.lit(".wav")).alias("file"))
    spoken = kept(named.join(voiced, "chapter_key"), f"{folder}/spoken")
    qc = long_audio.chunk_metrics(spoken.withColumn("channels", F.lit(1)), [*by, "chapter_key", "file"])
    qc = kept(qc, f"{folder}/qc")
    timed = audio.timeline(qc.withColumn("idx", F.col("chapter")))
    heard = qc.select("chapter_key", F.lit(True).alias("audio_generated"))
    documents = reports.chapter_reports(chapters.withColumn("idx", F.col("chapter")).join(heard, "chapter_key", "left"))
    meta = containers.metadata(books)
    names = containers.joined_metadata(meta, "title").join(containers.joined_metadata(meta, "creator"), "book", "full")
    return Conversion(
        chapters, documents, cut, spoken, qc, timed, chapter_markers(timed, names), containers.covers(containers.items(books), meta), reports.book_summary(documents)
    )


def write_audio(conversion: Conversion, folder: str) -> None:
    """The chapters of a conversion as WAV files, book/file, which appear when all are complete."""
    book = F.regexp_replace(F.regexp_extract("book", r"([^/]*)\z", 1), r"\.[^.]*\z", "")
    write_parts(long_audio.wav_parts(conversion.spoken, F.concat_ws("/", book, F.col("file"))), folder)


def build_summary(spark: SparkSession, folder: str) -> DataFrame:
    """The summary of a folder of cleaning reports, one nested row: totals, integrity, reasons, candidates and all reports by name.

    book is that of an earlier summary.json there, else the folder's name;
    strictness that of the first report. A folder without reports gives no row.
    """
    found = reports.fallback_reasons(read_reports(spark, folder)).withColumn("href", F.col("name")).withColumn("idx", F.col("name"))
    measured = reports.chapter_reports(found.withColumn("book", F.lit(folder.rstrip("/").rpartition("/")[2])))
    earlier = earlier_summary(spark.read.text(f"{folder}/summary.jso[n]", wholetext=True)) if _has(spark, f"{folder}/summary.json") else None
    whole = reports.book_summary(measured).drop("order_consistent").withColumnRenamed("duplicate_href_count", "duplicate_name_count")
    whole = whole.join(reports.first_value(measured, "strictness"), "book")
    for column in ("removed_reason_counts", "reason_counts"):
        pairs = F.sort_array(F.collect_list(F.struct("reason", "blocks")))
        whole = whole.join(reports.merged_reasons(measured, column).groupBy("book").agg(F.map_from_entries(pairs).alias(column)), "book", "left")
    if earlier is None:
        return whole
    named = earlier.select(F.col("book").alias("_book")).limit(1)
    return whole.crossJoin(named).withColumn("book", F.coalesce("_book", "book")).drop("_book")  # one row each


def _has(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def build_audio_qc(spark: SparkSession, root: str, recursive: bool = True, suffixes: Sequence[str] = C.AUDIO_SUFFIXES) -> DataFrame:
    """The audio report of a folder, one nested row: totals, the metrics of each file by name, and the files that can't be read.

    Tasks read stretches of files, so a file may be longer than a row.
    """
    rows = audio_files.audio_samples(spark, root, recursive, suffixes)
    metrics = long_audio.chunk_metrics(rows.filter("error IS NULL"), ["file"]).withColumn("error", F.lit(None).cast("string"))
    failed = rows.filter("error IS NOT NULL").select("file", "error")
    whole = audio.qc_summary(metrics.unionByName(failed, allowMissingColumns=True))
    return whole.withColumn("audio_root", F.lit(root)).withColumn("recursive", F.lit(recursive))
