"""Chapter reports and their rollup to books."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.text import ratio, rounded
from .readability import readability

SUMS = (
    "cleaned_chars", "raw_chars", "kept_chars", "removed_chars", "total_blocks", "removed_blocks", "sentence_count",
    "overlong_sentence_count", "abnormal_symbol_count", "numeric_char_count",
)


def chapter_reports(chapters: DataFrame) -> DataFrame:
    """Add readability and the defaults of missing counts to chapters with book, idx, href, text.

    raw_chars, kept_chars, removed_chars, total_blocks, removed_blocks and
    audio_generated may be missing; counts then follow from the text's length,
    and char_metrics_estimated says so.
    """
    have = set(chapters.columns)
    out = readability(chapters).withColumn("cleaned_chars", F.length(F.coalesce("text", F.lit(""))).cast("long"))
    some = lambda c: F.col(c) if c in have else F.lit(None).cast("long")
    out = out.withColumn("char_metrics_estimated", some("raw_chars").isNull() | some("removed_chars").isNull())
    out = out.withColumn("raw_chars", F.coalesce(some("raw_chars"), "cleaned_chars"))
    out = out.withColumn("kept_chars", F.coalesce(some("kept_chars"), "cleaned_chars"))
    out = out.withColumn("removed_chars", F.coalesce(some("removed_chars"), F.greatest(F.col("raw_chars") - F.col("kept_chars"), F.lit(0))))
    for c in ("total_blocks", "removed_blocks"):
        out = out.withColumn(c, F.coalesce(some(c), F.lit(0)).cast("long"))
    audio = F.col("audio_generated") if "audio_generated" in have else F.lit(False)
    out = out.withColumn("audio_generated", F.coalesce(audio, F.lit(False)))
    return out.withColumn("retention_ratio", ratio(F.col("kept_chars"), F.col("raw_chars")))


def book_rollup(reports: DataFrame, book: str = "book") -> DataFrame:
    """Sums, counts, ratios and integrity flags per book, by one aggregation.

    order_consistent: the places are 1, 2 and so on, each once.
    planned_chapter_count is the number of rows, reported or not generated.
    """
    sums = [F.sum(c).alias(f"total_{c}" if c != "total_blocks" else c) for c in SUMS]
    out = reports.groupBy(book).agg(
        F.count("*").alias("document_count"),
        *sums,
        F.sum(F.col("sentence_count") * F.col("avg_sentence_length")).alias("_sentence_chars"),
        F.max("max_sentence_length").alias("max_sentence_length"),
        F.count_if(F.col("cleaned_chars") == 0).alias("empty_chapter_count"),
        F.count_if((F.col("cleaned_chars") > 0) & (F.col("cleaned_chars") < C.ULTRA_SHORT)).alias("ultra_short_chapter_count"),
        F.count_if("audio_generated").alias("generated_audio_count"),
        F.count_if("char_metrics_estimated").alias("estimated_document_count"),
        (F.count("href") - F.count_distinct("href")).alias("duplicate_href_count"),
        (F.min("idx").eqNullSafe(F.lit(1)) & (F.max("idx") == F.count("*")) & (F.count_distinct("idx") == F.count("*"))).alias("order_consistent"),
    )
    return out.withColumns(
        {
            "planned_chapter_count": F.col("document_count"),
            "retention_ratio": ratio(F.col("total_kept_chars"), F.col("total_raw_chars")),
            "removed_char_ratio": ratio(F.col("total_removed_chars"), F.col("total_raw_chars")),
            "removed_ratio": ratio(F.col("total_removed_blocks"), F.col("total_blocks")),
            "avg_sentence_length": rounded(F.col("_sentence_chars") / F.greatest(F.col("total_sentence_count"), F.lit(1)), 3),
            "overlong_sentence_ratio": ratio(F.col("total_overlong_sentence_count"), F.col("total_sentence_count")),
            "abnormal_symbol_ratio": ratio(F.col("total_abnormal_symbol_count"), F.col("total_cleaned_chars")),
            "numeric_char_ratio": ratio(F.col("total_numeric_char_count"), F.col("total_cleaned_chars")),
            "empty_chapter_ratio": ratio(F.col("empty_chapter_count"), F.col("document_count")),
            "ultra_short_chapter_ratio": ratio(F.col("ultra_short_chapter_count"), F.col("document_count")),
        }
    ).drop("_sentence_chars")


def is_false_drop() -> Column:
    return (F.col("retention_ratio") < C.FALSE_DROP_RETENTION) & (F.col("removed_chars") > C.FALSE_DROP_CHARS)


def is_false_keep() -> Column:
    return (F.col("abnormal_symbol_ratio") > C.FALSE_KEEP_ABNORMAL) | (F.col("numeric_char_ratio") > C.FALSE_KEEP_NUMERIC)


def candidates(reports: DataFrame, condition: Column, book: str = "book", most: int = C.LIST_CAP) -> DataFrame:
    """The first chapters of each book that meet condition, with their place in that list."""
    place = F.row_number().over(Window.partitionBy(book).orderBy("idx"))
    return reports.filter(condition).withColumn("place", place).filter(F.col("place") <= most)


def fallback_reasons(reports: DataFrame) -> DataFrame:
    """Fill empty reason maps: removed reasons from the samples, all reasons from the removed ones."""
    names = F.transform("removed_samples", lambda s: F.coalesce(s["reason"], F.lit("unspecified")))
    counted = F.map_from_entries(
        F.transform(F.array_distinct(names), lambda n: F.struct(n, F.size(F.filter(names, lambda m: m == n)).cast("long")))
    )
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    out = reports.withColumn("removed_reason_counts", F.when(empty("removed_reason_counts"), counted).otherwise(F.col("removed_reason_counts")))
    return out.withColumn("reason_counts", F.when(empty("reason_counts"), F.col("removed_reason_counts")).otherwise(F.col("reason_counts")))


def merged_reasons(reports: DataFrame, column: str, book: str = "book") -> DataFrame:
    """Reason maps of a book's chapters added up, in long form."""
    rows = reports.select(book, F.explode(column).alias("reason", "blocks"))
    return rows.groupBy(book, "reason").agg(F.sum("blocks").alias("blocks"))


def first_value(reports: DataFrame, column: str, book: str = "book") -> DataFrame:
    """column of each book's first chapter."""
    return reports.groupBy(book).agg(F.min_by(column, "idx").alias(column))


def summary_rows(reports: DataFrame, book: str = "book", most: int = C.LIST_CAP) -> DataFrame:
    """The lists of a book's summary in long form: book, part (documents or a list of candidates), place, idx, href, retention_ratio, removed_chars."""
    order = Window.partitionBy(book).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    flags = {"documents": F.lit(True), "possible_false_drop": is_false_drop(), "possible_false_keep": is_false_keep()}
    narrow = reports.select(book, "idx", "href", "retention_ratio", "removed_chars", *[x.alias(f"_{k}") for k, x in flags.items()])
    parts = F.array(*[F.struct(F.lit(k).alias("part"), F.sum(F.col(f"_{k}").cast("int")).over(order).alias("place"), F.col(f"_{k}").alias("is")) for k in flags])
    rows = narrow.withColumn("_parts", parts).withColumn("_part", F.explode(F.filter("_parts", lambda x: x["is"])))
    rows = rows.select(book, F.col("_part.part").alias("part"), F.col("_part.place").alias("place"), "idx", "href", "retention_ratio", "removed_chars")
    return rows.filter((F.col("part") == "documents") | (F.col("place") <= most))


def book_summary(reports: DataFrame, book: str = "book") -> DataFrame:
    """One nested row per book: the rollup, its documents and both lists of candidates, for books of bounded size; see summary_rows."""
    item = F.struct("idx", "href", "retention_ratio", "removed_chars")
    listed = lambda k: F.sort_array(F.collect_list(F.when(F.col("part") == k, item))).alias(k)
    lists = summary_rows(reports, book).groupBy(book).agg(*[listed(k) for k in ("documents", "possible_false_drop", "possible_false_keep")])
    return book_rollup(reports, book).join(lists, book, "left").withColumn("generated_at", F.current_timestamp())
