"""Pages as a stream: new files are cleaned batch by batch and their reports appended. Not in the batch rules' scope."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from .. import constants as C
from ..operators.blocks import html_blocks
from ..operators.classify import judged_blocks
from ..operators.clean import cleaning_report


def page_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Pages from Parquet files as they arrive in folder."""
    return spark.readStream.schema("page_id long, url string, html string").parquet(folder)


def append_blocks(pages: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append the blocks of each page as it comes: a stateless stream in append mode, each page once."""
    blocks = html_blocks(pages)
    return blocks.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_reports(pages: DataFrame, out: str, checkpoint: str, level: str = C.DEFAULT_LEVEL) -> StreamingQuery:
    """Write a cleaning report per page of each batch; a batch that is run again replaces its own output."""

    def batch(df: DataFrame, number: int) -> None:
        report = cleaning_report(judged_blocks(html_blocks(df), [level]))
        report.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
