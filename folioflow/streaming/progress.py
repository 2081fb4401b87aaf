"""Narration as a stream that tells how many chapters of each book are done."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators.audio import synthesize
from ..operators.speech import tone
from ..session import ship_package

#: Books that are counted one by one; of more, only the sum is told, as book None.
MOST_BOOKS = 1000
_METRIC = "chapters"


def _books(planned: Mapping[str | None, int]) -> list[str]:
    return sorted(b for b in planned if b is not None)


def observed(chapters: DataFrame, planned: Mapping[str | None, int], book: str = "book") -> DataFrame:
    """chapters, whose rows are counted by book as they pass; the counts cost no pass of their own."""
    counts = [F.count_if(F.col(book).eqNullSafe(b)).alias(f"book{k}") for k, b in enumerate(_books(planned))]
    return chapters.observe(_METRIC, F.count("*").alias("all"), *counts)


class Progress(StreamingQueryListener):
    """Calls tell(book, done, planned) for each book that moved on, whenever a batch is done; the last call for None has all books' sums.

    A query that goes on after a stop starts with what is done already.
    """

    def __init__(self, planned: Mapping[str | None, int], tell: Callable[[str | None, int, int], None], done: Mapping[str | None, int] | None = None):
        self.planned, self.tell = dict(planned), tell
        self.done = dict.fromkeys(self.planned, 0) | dict(done or {})
        self.all = sum(self.done.values())

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        counts = event.progress.observedMetrics.get(_METRIC)
        if counts is None or not counts["all"]:
            return
        for k, b in enumerate(_books(self.planned)):
            if counts[f"book{k}"]:
                self.done[b] += counts[f"book{k}"]
                self.tell(b, self.done[b], self.planned[b])
        self.all += counts["all"]
        self.tell(None, self.all, sum(self.planned.values()))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def _counts(chapters: DataFrame) -> dict[str | None, int]:
    """Chapters of each book, or of all together as book None where there are too many to name."""
    counts = {r.book: r["count"] for r in chapters.groupBy("book").count().limit(MOST_BOOKS + 1).collect()}
    return counts if len(counts) <= MOST_BOOKS else {None: chapters.count()}


def narrate(
    spark: SparkSession,
    folder: str,
    out: str,
    checkpoint: str,
    tell: Callable[[str | None, int, int], None],
    speak: Callable[[str], np.ndarray | None] = tone,
    rate: int = 8000,
    files: int = 1,
) -> tuple[StreamingQuery, Progress]:
    """Speak the chapters in folder (Parquet with book, chapter, segment), files at a time, and append their samples to out.

    Gives the query and the listener, which the caller takes off with
    spark.streams.removeListener when the query is done. Each chapter is spoken once,
    also if the query is stopped and started again with the same checkpoint.
    """
    ship_package(spark)
    written = spark.read.parquet(folder)
    planned, done = _counts(written), {}
    where = spark._jvm.org.apache.hadoop.fs.Path(out)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        done = _counts(spark.read.schema(written.schema).parquet(out))
    chapters = spark.readStream.schema(written.schema).option("maxFilesPerTrigger", files).parquet(folder)
    progress = Progress(planned, tell, done)
    spark.streams.addListener(progress)
    spoken = observed(synthesize(chapters, speak, rate), planned)
    query = spoken.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    return query, progress
