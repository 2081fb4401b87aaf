"""Cleaned text and cleaning reports from judged blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.text import ratio, rounded, strip

SAMPLE = ("block_index", "tag", "text", "classification", "reason", "score", "link_density", "punct_density", "stopword_density")


def cleaned_text(judged: DataFrame, key: str = "page_id") -> DataFrame:
    """key, strictness and text: the kept blocks, a line each."""
    line = F.when(F.col("keep") & (strip(F.col("text")) != ""), F.struct("block_index", strip(F.col("text")).alias("line")))
    lines = F.sort_array(F.collect_list(line))
    joined = F.array_join(F.transform(lines, lambda x: x["line"]), "\n")
    text = F.regexp_replace(strip(F.regexp_replace(joined, "[ \t]+", " ")), "\n{3,}", "\n\n")
    return judged.groupBy(key, "strictness").agg(text.alias("text"))


def cleaning_report(judged: DataFrame, key: str = "page_id") -> DataFrame:
    """One row per key and strictness: block and character counts and their ratios."""
    keep, size = F.col("keep"), F.length("text").cast("long")
    sums = judged.groupBy(key, "strictness").agg(
        F.count("*").alias("total_blocks"),
        F.count_if(keep).alias("kept_blocks"),
        F.count_if(~keep).alias("removed_blocks"),
        F.sum(size).alias("raw_chars"),
        F.sum(F.when(keep, size).otherwise(F.lit(0))).alias("kept_chars"),
    )
    return sums.withColumns(_ratios())


def _ratios() -> dict[str, Column]:
    return {
        "removed_chars": F.greatest(F.col("raw_chars") - F.col("kept_chars"), F.lit(0)),
        "retention_ratio": ratio(F.col("kept_chars"), F.col("raw_chars")),
        "kept_ratio": ratio(F.col("kept_blocks"), F.col("total_blocks")),
    }


def reason_counts(judged: DataFrame, key: str = "page_id", removed_only: bool = False) -> DataFrame:
    """key, strictness, reason and how many blocks have it."""
    rows = judged.filter(~F.col("keep")) if removed_only else judged
    reason = F.when(F.coalesce("reason", F.lit("")) == "", "unspecified").otherwise(F.col("reason"))
    return rows.groupBy(key, "strictness", reason.alias("reason")).agg(F.count("*").alias("blocks"))


def samples(judged: DataFrame, kept: bool, key: str = "page_id", most: int = C.LIST_CAP) -> DataFrame:
    """The first kept or removed blocks of each document, shortened and rounded."""
    place = F.row_number().over(Window.partitionBy(key, "strictness").orderBy("block_index"))
    rows = judged.filter(F.col("keep") == kept).withColumn("place", place).filter(F.col("place") <= most)
    return rows.select(
        key, "strictness", "place", "block_index", "tag", F.substring("text", 1, C.SAMPLE_CHARS).alias("text"), "classification",
        "reason", *[rounded(F.col(c), 3).alias(c) for c in SAMPLE[5:]],
    )


def full_report(judged: DataFrame, key: str = "page_id", most: int = C.LIST_CAP) -> DataFrame:
    """The report as nested columns: cleaning_report with sample lists and reason maps, by one sort and one shuffle."""
    place = F.row_number().over(Window.partitionBy(key, "strictness", "keep").orderBy("block_index"))
    rounded_ = [rounded(F.col(c), 3).alias(c) for c in SAMPLE[5:]]
    sample = F.struct("block_index", "tag", F.substring("text", 1, C.SAMPLE_CHARS).alias("text"), "classification", "reason", *rounded_)
    reason = F.when(F.coalesce("reason", F.lit("")) == "", "unspecified").otherwise(F.col("reason"))
    rows = judged.withColumn("_place", place).withColumn("_reason", reason)
    by_reason = rows.groupBy(key, "strictness", "keep", "_reason").agg(
        F.count("*").alias("n"), F.sum(F.length("text").cast("long")).alias("chars"), F.collect_list(F.when(F.col("_place") <= most, sample)).alias("samples")
    )
    keep = F.col("keep")
    some = lambda kept, x: F.coalesce(F.sum(F.when(keep if kept else ~keep, F.col(x))), F.lit(0))
    listed = lambda kept: F.sort_array(F.flatten(F.collect_list(F.when(keep if kept else ~keep, F.col("samples")))))
    pairs = F.collect_list(F.struct(F.col("_reason").alias("reason"), "n", "keep"))
    out = by_reason.groupBy(key, "strictness").agg(
        F.sum("n").alias("total_blocks"), some(True, "n").alias("kept_blocks"), some(False, "n").alias("removed_blocks"),
        F.sum("chars").alias("raw_chars"), some(True, "chars").alias("kept_chars"),
        listed(False).alias("removed_samples"), listed(True).alias("kept_samples"), pairs.alias("_pairs"),
    )
    out = out.withColumns(_ratios()).withColumn("_removed", F.filter("_pairs", lambda x: ~x["keep"]))
    return out.withColumns({"removed_reason_counts": _counted("_removed"), "reason_counts": _counted("_pairs")}).drop("_pairs", "_removed")


def _counted(pairs: str) -> Column:
    """A map of the reasons in pairs, in order, to the sum of their n."""
    names = F.sort_array(F.array_distinct(F.transform(pairs, lambda x: x["reason"])))
    total = lambda r: F.aggregate(F.filter(pairs, lambda x: x["reason"] == r), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    return F.map_from_entries(F.transform(names, lambda r: F.struct(r, total(r))))
