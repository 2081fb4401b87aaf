"""Chapter order: filters, first occurrences, limits and navigation made up from file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import href_key, is_non_content_href, title_from_filename


def content_chapters(nav: DataFrame, book: str = "book", nav_file: Column | None = None) -> DataFrame:
    """Rows of nav (book, pos, title, href) that are content, the first of each reference, in order."""
    rows = nav.filter(~is_non_content_href(F.col("href"), nav_file)).withColumn("_key", href_key(F.col("href")))
    first = F.row_number().over(Window.partitionBy(book, "_key").orderBy("pos"))
    return rows.withColumn("_first", first).filter("_first = 1").drop("_first", "_key")


def limited(nav: DataFrame, max_chapters: int, book: str = "book", order: str = "pos") -> DataFrame:
    """The first chapters of each book, numbered from 1 as chapter."""
    if max_chapters < 1:
        raise ValueError("max_chapters must be at least 1")
    place = F.row_number().over(Window.partitionBy(book).orderBy(order))
    return nav.withColumn("chapter", place).filter(F.col("chapter") <= max_chapters)


def with_progress(chapters: DataFrame, book: str = "book", order: str = "pos") -> DataFrame:
    """Add chapter_index (from 0), total_chapters and progress_pct, the share that is done before the chapter."""
    index = F.row_number().over(Window.partitionBy(book).orderBy(order)) - 1
    total = F.count("*").over(Window.partitionBy(book))
    out = chapters.withColumn("chapter_index", index.cast("long")).withColumn("total_chapters", total)
    return out.withColumn("progress_pct", F.col("chapter_index") / F.col("total_chapters") * 100.0)


def virtual_navigation(items: DataFrame, book: str = "book", titles: DataFrame | None = None) -> DataFrame:
    """Navigation for books without any: their documents by file name, with titles made of the names.

    A book without documents gets one entry, with its first title where titles
    (book, title) has one.
    """
    is_doc = F.col("media_type").isin("application/xhtml+xml", "text/html") | F.col("href").endswith(".xhtml")
    docs = items.filter(is_doc).select(book, "href")
    pos = F.row_number().over(Window.partitionBy(book).orderBy("href"))
    total = F.count("*").over(Window.partitionBy(book))
    out = docs.withColumn("pos", pos).withColumn("_total", total)
    bare = F.when(F.col("_total") == 1, F.lit("Content")).otherwise(F.concat(F.lit("Page "), F.col("pos").cast("string")))
    title = title_from_filename(F.col("href"))
    out = out.select(book, "pos", F.when(title != "", title).otherwise(bare).alias("title"), "href")
    none = items.select(book).distinct().join(docs.select(book).distinct(), book, "left_anti")
    none = none.join(titles.select(book, F.col("title").alias("_title")), book, "left") if titles is not None else none.withColumn("_title", F.lit(None).cast("string"))
    named = F.coalesce("_title", F.lit("Content"))
    return out.unionByName(none.select(book, F.lit(1).alias("pos"), named.alias("title"), F.lit("content.xhtml").alias("href")))


def as_text(content: Column) -> Column:
    """Bytes as UTF-8 text without the ones that are none."""
    raw = content.cast("string")
    return F.when(F.is_valid_utf8(raw), raw).otherwise(F.replace(F.make_valid_utf8(raw), F.lit("\ufffd"), F.lit("")))


def with_bodies(nav: DataFrame, items: DataFrame, book: str = "book") -> DataFrame:
    """Add html to nav: the text of the item without the fragment, else of the one with the whole reference, else null."""
    one = items.select(F.col(book).alias("_book"), F.col("href").alias("_href"), F.col("content").alias("_plain"))
    two = items.select(F.col(book).alias("_book2"), F.col("href").alias("_href2"), F.col("content").alias("_whole"))
    out = nav.join(one, (F.col(book) == F.col("_book")) & (F.substring_index("href", "#", 1) == F.col("_href")), "left")
    out = out.join(two, (F.col(book) == F.col("_book2")) & (F.col("href") == F.col("_href2")), "left")
    return out.withColumn("html", as_text(F.coalesce("_plain", "_whole"))).drop("_book", "_href", "_plain", "_book2", "_href2", "_whole")
