"""E-book containers: zip files of XHTML as rows of items, metadata, navigation and covers."""

from __future__ import annotations

import io
import posixpath
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.navigation import content_chapters, virtual_navigation

ITEMS = "book string, item_pos int, item_id string, href string, media_type string, properties string, content binary"
META = "book string, pos int, name string, value string"
_CONTAINER = "META-INF/container.xml"


def _local(element: ET.Element) -> str:
    return element.tag.rpartition("}")[2]


def _find(root: ET.Element, name: str) -> Iterator[ET.Element]:
    return (e for e in root.iter() if isinstance(e.tag, str) and _local(e) == name)


def _package(archive: zipfile.ZipFile) -> tuple[str, ET.Element]:
    rootfile = next(_find(ET.fromstring(archive.read(_CONTAINER)), "rootfile"))
    name = rootfile.get("full-path", "")
    return posixpath.dirname(name), ET.fromstring(archive.read(name))


def read_containers(spark: SparkSession, path: str) -> DataFrame:
    """One row per container file: book (its path) and content."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("book"), "content")


def items(books: DataFrame) -> DataFrame:
    """One row per manifest item, in manifest order; a file that is no container has none."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in ITEMS.split(", ")]
        for f in frames:
            for book, content in zip(f["book"], f["content"], strict=True):
                out = []
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content))
                    folder, package = _package(archive)
                    present = set(archive.namelist())
                    for i, e in enumerate(e for e in _find(package, "item") if e.get("href")):
                        name = posixpath.normpath(posixpath.join(folder, e.get("href")))
                        body = archive.read(name) if name in present else None
                        out.append((book, i, e.get("id"), e.get("href"), e.get("media-type", ""), e.get("properties", ""), body))
                except (zipfile.BadZipFile, KeyError, ET.ParseError, StopIteration):
                    out = []
                yield pd.DataFrame(out, columns=names)

    return books.select("book", "content").mapInPandas(rows, ITEMS)


def metadata(books: DataFrame) -> DataFrame:
    """book, pos, name (title, creator, cover) and value of the package's metadata; blank values are left out."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for book, content in zip(f["book"], f["content"], strict=True):
                out = []
                try:
                    _, package = _package(zipfile.ZipFile(io.BytesIO(content)))
                    for e in package.iter():
                        if _local(e) in ("title", "creator") and e.text:
                            out.append((_local(e), e.text))
                        elif _local(e) == "meta" and e.get("name") == "cover" and e.get("content"):
                            out.append(("cover", e.get("content")))
                except (zipfile.BadZipFile, KeyError, ET.ParseError, StopIteration):
                    out = []
                yield pd.DataFrame([(book, i, *x) for i, x in enumerate(out)], columns=["book", "pos", "name", "value"])

    return books.select("book", "content").mapInPandas(rows, META)


def joined_metadata(meta: DataFrame, name: str, by: str = " / ") -> DataFrame:
    """book and all its values of a metadata name in order, joined."""
    ordered = F.sort_array(F.collect_list(F.struct("pos", "value")))
    rows = meta.filter(F.col("name") == name).groupBy("book")
    return rows.agg(F.array_join(F.transform(ordered, lambda x: x["value"]), by).alias(name))


def navigation_item(all_items: DataFrame) -> DataFrame:
    """The navigation item of each book and its version: the first .ncx, else the first XHTML with a toc nav."""
    text = F.col("content").cast("string")
    toc = text.contains('epub:type="toc"') | text.contains("epub:type='toc'")
    rank = F.when(F.col("href").endswith(".ncx"), 1).when(F.col("href").endswith(".xhtml") & toc, 2)
    rows = all_items.withColumn("_rank", rank).filter("_rank is not null")
    first = F.row_number().over(Window.partitionBy("book").orderBy("_rank", "item_pos"))
    version = F.when(F.col("_rank") == 1, "EPUB2").otherwise("EPUB3")
    return rows.withColumn("_first", first).filter("_first = 1").select("book", version.alias("version"), F.col("href").alias("nav_file"), "content")


def _ncx(root: ET.Element) -> Iterator[tuple[str, str]]:
    for point in _find(root, "navPoint"):
        children = {_local(e): e for e in reversed(list(point))}
        label, target = children.get("navLabel"), children.get("content")
        if label is None or target is None:
            continue
        words = next((e for e in label if _local(e) == "text"), None)
        title, href = (words.text if words is not None else "") or "", target.get("src", "")
        if title and href:
            yield title.strip(), href


def _nav(root: ET.Element) -> Iterator[tuple[str, str]]:
    navs = list(_find(root, "nav"))
    kind = lambda e: next((v for k, v in e.attrib.items() if k.rpartition("}")[2] in ("type", "epub:type")), None)
    chosen = next((e for e in navs if kind(e) == "toc"), navs[0] if navs else root)
    for link in _find(chosen, "a"):
        title = "".join(link.itertext()).strip()
        if link.get("href") and title:
            yield title, link.get("href")


def navigation(nav_items: DataFrame) -> DataFrame:
    """book, pos, title, href of the entries in navigation_item's files; a file that doesn't parse has none."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for book, version, content in zip(f["book"], f["version"], f["content"], strict=True):
                try:
                    root = ET.fromstring(content.decode("utf-8", "ignore"))
                    out = list(_ncx(root) if version == "EPUB2" else _nav(root))
                except ET.ParseError:
                    out = []
                yield pd.DataFrame([(book, i + 1, *x) for i, x in enumerate(out)], columns=["book", "pos", "title", "href"])

    wanted = nav_items.filter("content is not null").select("book", "version", "content")
    return wanted.mapInPandas(rows, "book string, pos int, title string, href string")


def chapters(books: DataFrame) -> DataFrame:
    """Content chapters of each book in order: from its navigation, else from its file names."""
    all_items = items(books)
    found = navigation_item(all_items)
    real = navigation(found).join(found.select("book", "nav_file"), "book")
    bare = all_items.join(found.select("book"), "book", "left_anti")
    titles = metadata(books).filter("name = 'title'").groupBy("book").agg(F.min_by("value", "pos").alias("title"))
    made = virtual_navigation(bare, titles=titles).withColumn("nav_file", F.lit(""))
    return content_chapters(real.unionByName(made), nav_file=F.col("nav_file")).drop("nav_file")


def covers(all_items: DataFrame, meta: DataFrame) -> DataFrame:
    """book, href, content of each book's cover: by property, by metadata, by id, by name; images only."""
    named = meta.filter("name = 'cover'").select("book", F.col("value").alias("_cover")).dropDuplicates(["book"])
    rows = all_items.filter(F.col("media_type").startswith("image/")).join(named, "book", "left")
    rank = (
        F.when(F.col("properties").contains("cover-image"), 1)
        .when(F.col("item_id") == F.col("_cover"), 2)
        .when(F.col("item_id") == "cover", 3)
        .when(F.lower("href").contains("cover"), 4)
    )
    rows = rows.withColumn("_rank", rank).filter("_rank is not null")
    first = F.row_number().over(Window.partitionBy("book").orderBy("_rank", "item_pos"))
    return rows.withColumn("_first", first).filter("_first = 1").select("book", "href", "content")
