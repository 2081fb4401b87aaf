"""Report folders: cleaning reports as JSON beside the cleaned texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE = (
    "array<struct<index:int,tag:string,text:string,classification:string,reason:string,score:double,"
    "link_density:double,punct_density:double,stopword_density:double>>"
)
SCHEMA = (
    "strictness string, total_blocks long, kept_blocks long, removed_blocks long, raw_chars long, kept_chars long, "
    f"removed_chars long, retention_ratio double, removed_samples {SAMPLE}, kept_samples {SAMPLE}, kept_ratio double, "
    "removed_reason_counts map<string,bigint>, reason_counts map<string,bigint>"
)
REPORT_SUFFIX, TEXT_SUFFIX = ".cleaning_report.json", ".cleaned.txt"


def _stem(suffix: str):
    name = F.regexp_extract(F.input_file_name(), r"([^/]*)\z", 1)
    return F.regexp_replace(F.url_decode(name), f"{suffix.replace('.', '[.]')}\\z", "")


def read_reports(spark: SparkSession, folder: str) -> DataFrame:
    """name, text and the fields of each report in folder, in no order, so that no text is sorted; a report without a text has an empty one."""
    reports = spark.read.schema(SCHEMA).json(f"{folder}/*{REPORT_SUFFIX}", multiLine=True, mode="PERMISSIVE")
    reports = reports.withColumn("name", _stem(REPORT_SUFFIX))
    texts = spark.read.text(f"{folder}/*.txt", wholetext=True).withColumn("name", _stem(TEXT_SUFFIX))
    joined = reports.join(texts.withColumnRenamed("value", "text"), "name", "left")
    return joined.withColumn("text", F.coalesce("text", F.lit("")))


def earlier_summary(text: DataFrame, column: str = "value") -> DataFrame:
    """book and strictness of earlier summaries; text that is no JSON gives nulls."""
    parsed = F.from_json(column, "book string, strictness string")
    return text.select(parsed["book"].alias("book"), parsed["strictness"].alias("strictness"))
