"""EPUB files as tables of chapters and of contents, and the chapters that are read."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.operators import pages as pg
from folioforge.sources.files import file_name
from folioforge.sources.listing import found as found_files

PARTS = "book string, kind string, ord int, item_id string, href string, properties string, title string, html string"


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def parts_of(data: bytes) -> list[tuple]:
    """(kind, ord, item id, href, properties, title, html): titles, chapters of the spine and entries of the contents."""
    out: list[tuple] = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        read = lambda name: z.read(name).decode("utf-8", "replace")
        root = next(e.get("full-path") for e in ElementTree.fromstring(z.read("META-INF/container.xml")).iter() if _local(e.tag) == "rootfile")
        package, base = ElementTree.fromstring(z.read(root)), posixpath.dirname(root)
        items = {e.get("id"): e for e in package.iter() if _local(e.tag) == "item"}
        out += [("title", k, None, None, None, e.text, None) for k, e in enumerate(e for e in package.iter() if _local(e.tag) == "title")]
        names = set(z.namelist())
        at = lambda e: posixpath.normpath(posixpath.join(base, unquote(e.get("href"))))
        for k, ref in enumerate(e for e in package.iter() if _local(e.tag) == "itemref"):
            e = items.get(ref.get("idref"))
            if e is not None and at(e) in names:
                out.append(("chapter", k, e.get("id"), unquote(e.get("href")), e.get("properties"), None, read(at(e))))
        for e in items.values():
            if (e.get("media-type") or "").endswith("ncx+xml") and at(e) in names:
                points = [p for p in ElementTree.fromstring(z.read(at(e))).iter() if _local(p.tag) == "navPoint"]
                for k, p in enumerate(points):
                    label = next((x.text for x in p.iter() if _local(x.tag) == "text"), None)
                    src = next((x.get("src") for x in p if _local(x.tag) == "content"), None)
                    out.append(("contents", k, None, src, None, label, None))
    return out


def parts(spark: SparkSession, folder: str) -> DataFrame:
    """All parts of a folder's books; a file that is no EPUB has one row of kind ``error``."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for book, data in batch.itertuples(index=False):
                try:
                    rows = parts_of(bytes(data))
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, StopIteration) as e:
                    rows = [("error", 0, None, None, None, f"{type(e).__name__}: {e}", None)]
                yield pd.DataFrame([(book, *r) for r in rows], columns=["book", "kind", "ord", "item_id", "href", "properties", "title", "html"])

    f = found_files(spark, folder, "*.epub")
    return f.select(file_name(F.col("path")).alias("book"), "content").mapInPandas(unpack, PARTS)


def book_titles(found: DataFrame) -> DataFrame:
    """(book, title): the first title that is not blank."""
    t = found.where("kind = 'title'").select("book", "ord", pg.inline_form(F.col("title")).alias("title")).where("title <> ''")
    return t.groupBy("book").agg(F.min_by("title", "ord").alias("title"))


def chapters(found: DataFrame) -> DataFrame:
    """(book, ord, href, title, html, position, reason): chapters but navigation documents; reason: why one is not read, or null."""
    c = found.where((F.col("kind") == "chapter") & ~pg.is_navigation(F.col("item_id"), F.col("href"), F.col("properties"))).drop("title")
    c = pg.with_contents_titles(c, found.where("kind = 'contents'").select("book", F.col("href").alias("h"), F.col("title").alias("t"), F.col("ord").alias("o")), "book", "href", "h", "t", "o")
    c = c.withColumn("title", pg.title(F.col("html"), F.col("href"), F.col("contents_title"))).withColumn("__t", pg.preview(F.col("html")))
    key = pg.key_form(F.concat("href", F.lit(" "), "title"))
    c = c.withColumns({"__key": key, "__links": pg.count_links(F.col("html")), "__items": pg.count_list_items(F.col("html")), "__heading": pg.contents_heading(F.col("html")), "__lines": pg.short_lines(F.col("__t"))})
    c = pg.near_edges(c, "book", "ord")
    reason = pg.skip_reason(F.col("__key"), F.col("__t"), F.col("__links"), F.col("__items"), F.col("__lines"), F.col("__heading"), F.col("in_front"), F.col("in_window"))
    return c.select("book", "ord", "href", "title", "html", "position", reason.alias("reason"))


def chapter_texts(found: DataFrame) -> DataFrame:
    """(book, ord, title, text) of the chapters that are read and have text."""
    return pg.reading_text(chapters(found).where("reason is null"), "html").where("text <> ''").select("book", "ord", "title", "text")
