"""Web pages and book chapters: preview and reading text, titles, counts, and which pages are front or back matter."""

from __future__ import annotations

import html as html_lib
from functools import partial
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from folioforge.functions.text import SPACE, collapse_space

#: Tags whose content no preview has, and tags whose end is a line's end there.
SKIPPED = ("script", "style", "head", "nav", "svg")
LINE_ENDS = ("p", "div", "section", "article", "h[1-6]", "li", "tr", "blockquote", "a")
#: Limits of the rules for sections that are no reading text.
FRONT, BACK, MOST_WORDS, MOST_CHARS, SIGNALS, LINKS, LINES, LINE_CHARS = 6, 4, 700, 4000, 2, 5, 5, 80
#: Terms in names and titles of publication data, tables of contents and other sections that are not read.
PUBLICATION_TERMS = "aboutpublisher aboutthepublisher alsoavailable copyright copyrgt colophon credits edition frontmatter imprint isbn legal license otherbooks publisher publishinghistory rights".split()
CONTENTS_TERMS = "contents tableofcontents toc".split()
NON_READING_TERMS = "cover copyright dedication halftitle imprint landmark license nav title titlepage toc".split()
NAVIGATION_NAMES = ("nav.html", "nav.xhtml", "toc.html", "toc.xhtml")
#: Phrases of publication data in a text.
PUBLICATION_PHRASES = (
    "all rights reserved", "copyright", "copyrighted material", "cover design by", "cover image", "cover illustration", "ebook isbn", "edited by", "first published", "interior design by", "isbn", "library of congress",
    "no part of this book may be reproduced", "printed in", "published by", "publishing history", "this edition", "translation copyright", "without permission of the publisher",
)
#: Tags that reading text skips, tags that stand in blocks of their own, and tags within a line.
READING_SKIPPED = set("audio button canvas form head iframe img input nav noscript object script select style svg textarea title video".split())
READING_BLOCKS = set("address article aside blockquote body caption dd div dl dt figcaption figure footer h1 h2 h3 h4 h5 h6 header hr li main ol p pre section table tbody td tfoot th thead tr ul".split())
INLINE = set("a abbr b bdi bdo cite code data dfn em i kbd mark q rp rt ruby s samp small span strong sub sup time u var wbr".split())
#: Tags without an end, as HTML has them.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())


@F.pandas_udf(T.StringType())
def unescaped(c: pd.Series) -> pd.Series:
    return c.map(lambda t: html_lib.unescape(t) if t and "&" in t else t)


def _unclosed_aside(html: Column) -> Column:
    """Puts a mark into the skipped tags that no end follows: they are no pair, and need not be tried.

    One step after the other on an array of one value, so that a step may name its value more than once.
    """
    step = F.array(html)
    for tag in SKIPPED:
        parts = F.transform(step, partial(_split_at_last, tag))
        step = F.transform(parts, partial(_mark_rest, tag))
    return F.get(step, F.lit(0))


def _split_at_last(tag: str, x: Column) -> Column:
    return F.struct(x.alias("t"), F.length(F.regexp_extract(x, rf"(?is)^(.*</{tag}>)", 1)).alias("n"))


def _mark_rest(tag: str, x: Column) -> Column:
    return F.concat(F.substring(x["t"], F.lit(1), x["n"]), F.regexp_replace(F.substring(x["t"], x["n"] + 1, F.length(x["t"])), f"(?i)<(?={tag})", "<\u0001"))


def preview(html: Column) -> Column:
    """Reading text by rules: skipped tags with their content go, ends of blocks and links end lines, other tags become blanks."""
    pair = rf"(?is)<({'|'.join(SKIPPED)})[^>]*>.*?</\1>"
    c = _unclosed_aside(html)
    c = F.when(F.rlike(html, F.lit(rf"(?i)</({'|'.join(SKIPPED)})>")), F.replace(F.regexp_replace(c, pair, " "), F.lit("<\u0001"), F.lit("<"))).otherwise(html)
    c = F.regexp_replace(F.regexp_replace(c, r"(?i)<br\s*/?>", "\n"), rf"(?i)</({'|'.join(LINE_ENDS)})>", "\n")
    c = F.replace(unescaped(F.regexp_replace(c, r"(?s)<[^>]+>", " ")), F.lit(" "), F.lit(" "))
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n\s*\n+", "\n\n")
    return F.trim(c, F.lit(" \n\t\r\f\u000b"))


def count_links(html: Column) -> Column:
    return F.regexp_count(html, F.lit(r"(?is)<a\b[^>]*\bhref\s*="))


def count_list_items(html: Column) -> Column:
    return F.regexp_count(html, F.lit(r"(?is)<li\b"))


def short_lines(text: Column, at_most: int = LINE_CHARS) -> Column:
    return F.size(F.filter(F.split(text, "\n"), lambda x: (F.trim(x) != "") & (F.length(F.trim(x)) <= at_most)))


def inline_form(c: Column) -> Column:
    return collapse_space(F.replace(unescaped(c), F.lit(" "), F.lit(" ")))


def title(html: Column, href: Column, contents_title: Column | None = None) -> Column:
    """The table of contents' title, else the first h1, h2 or title with text, else the file's stem."""
    get = lambda tag: F.nullif(inline_form(F.regexp_replace(F.regexp_extract(html, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1), r"<[^>]*>", " ")), F.lit(""))
    stem = F.regexp_extract(href, r"([^/]*?)(?:\.[^./]*)?$", 1)
    found = F.coalesce(get("h1"), get("h2"), get("title"), F.nullif(stem, F.lit("")), href)
    return found if contents_title is None else F.coalesce(F.nullif(contents_title, F.lit("")), found)


def key_form(c: Column) -> Column:
    return F.regexp_replace(F.lower(unescaped(c)), "[^a-z0-9]+", "")


def content_form(c: Column) -> Column:
    """Of text without entities."""
    c = F.replace(F.replace(F.lower(c), F.lit(" "), F.lit(" ")), F.lit("©"), F.lit(" copyright "))
    return F.trim(F.regexp_replace(c, f"[{SPACE}]+", " "))


def has_term(key: Column, terms: list[str]) -> Column:
    return F.rlike(key, F.lit("|".join(terms)))


def is_navigation(item_id: Column, href: Column, properties: Column) -> Column:
    """A book's navigation document: by its id, the name of its file, or its properties."""
    name = F.lower(F.regexp_extract(F.replace(href, F.lit("\\"), F.lit("/")), r"([^/]*)$", 1))
    return (F.lower(item_id) == "nav") | name.isin(*NAVIGATION_NAMES) | F.array_contains(F.split(F.lower(F.coalesce(properties, F.lit(""))), r"\s+"), "nav")


def contents_heading(html: Column) -> Column:
    """Whether one of the first four headings and bold texts speaks of contents."""
    found = F.slice(F.regexp_extract_all(html, F.lit(r"(?is)<(?:h1|h2|title|strong|b)[^>]*>(.*?)</(?:h1|h2|title|strong|b)>"), F.lit(1)), 1, 4)
    return has_term(F.regexp_replace(F.lower(F.regexp_replace(F.array_join(found, " "), r"(?s)<[^>]+>", " ")), "[^a-z0-9]+", ""), CONTENTS_TERMS)


def near_edges(pages: DataFrame, book: str, order: str, front: int = FRONT, back: int = BACK) -> DataFrame:
    """Adds position, in_front and in_window: among the first, or the first or last, pages of its book.

    The last ones are those with less than ``back`` pages after them, so one window counts from both ends.
    """
    w = Window.partitionBy(book)
    d = pages.withColumns({"position": F.row_number().over(w.orderBy(order)) - 1, "__n": F.count("*").over(w)})
    return d.withColumns({"in_front": F.col("position") < front, "in_window": (F.col("position") < front) | (F.col("position") >= F.greatest(F.lit(0), F.col("__n") - back))}).drop("__n")


def skip_reason(key: Column, text: Column, links: Column, list_items: Column, lines: Column, heading: Column, in_front: Column, in_window: Column) -> Column:
    """Why a section is no reading text, or null: publication data by its name, or by two phrases in a short text in front;
    contents by name and links, by a heading and links, or, in front only, by links and short lines.

    key: ``key_form`` of name and title; text: the preview.
    """
    publication = has_term(key, PUBLICATION_TERMS)
    content = content_form(text)
    signals = F.size(F.filter(F.array(*map(F.lit, PUBLICATION_PHRASES)), lambda p: F.contains(content, p)))
    short = (text != "") & ((F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+")) <= MOST_WORDS) | (F.length(text) <= MOST_CHARS))
    linked = (links >= LINKS) | (list_items >= LINKS)
    return (
        F.when(publication & in_window, "publication name").when(~publication & in_front & short & (signals >= SIGNALS), "publication phrases")
        .when(in_window & has_term(key, CONTENTS_TERMS) & linked, "contents name").when(in_window & heading & linked, "contents heading").when(in_front & (links >= LINKS) & (lines >= LINES), "contents links")
    )


def likely_empty(key: Column) -> Column:
    """Whether a section without text is expected to have none."""
    return has_term(key, NON_READING_TERMS)


class _Reader(HTMLParser):
    """Pieces of reading text of one chapter, with the count of repaired blanks within lines."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.pieces, self.open, self.skipping, self.repairs, self.images, self.pending, self.said = [], [], 0, 0, 0, False, False

    def handle_starttag(self, tag, attrs):
        self.images += tag == "img"
        if tag == "body" and not self.skipping:  # what stands before the body is not read
            self.pieces, self.said, self.pending = [], False, False
        if tag in READING_SKIPPED:
            self.skipping += tag not in VOID
        elif not self.skipping:
            self.pending = self.pending and tag in INLINE
            self.pieces.append({"br": "\n", "hr": "\n\n* * *\n\n", "li": "\n- "}.get(tag, "\n\n" if tag in READING_BLOCKS else ""))
        if tag not in VOID:
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open.pop() != tag:
                pass
        if tag in READING_SKIPPED:
            self.skipping = max(0, self.skipping - (tag not in VOID))
        elif not self.skipping and tag in READING_BLOCKS:
            self.pending = False
            self.pieces.append("\n\n")

    def handle_data(self, data):
        if self.skipping:
            return
        if not data.strip() and "\n" in data:  # only indentation, unless it stands between words of a line
            self.pending |= bool(self.open) and self.open[-1] in INLINE and self.said
            return
        if data.strip():
            if self.pending:
                self.repairs += 1
                if not (self.pieces and self.pieces[-1].endswith((" ", "\n"))):
                    self.pieces.append(" ")
            self.pending, self.said = False, True
        self.pieces.append(data)


READING = T.StructType([T.StructField("text", T.StringType()), T.StructField("repairs", T.IntegerType()), T.StructField("images", T.IntegerType())])


def _read(html: str) -> tuple[str, int, int]:
    reader = _Reader()
    reader.feed(html)
    reader.close()
    return "".join(reader.pieces), reader.repairs, reader.images


@F.pandas_udf(READING)
def _raw_reading(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_read(t or "") for t in html], columns=["text", "repairs", "images"])


def output_form(c: Column) -> Column:
    """Lines without blanks around, runs of five line feeds and more to three, of three and four to two."""
    c = F.regexp_replace(F.replace(c, F.lit(" "), F.lit(" ")), r"\r\n?", "\n")
    c = F.array_join(F.transform(F.split(c, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t]+", " "))), "\n")
    c = F.replace(F.regexp_replace(F.regexp_replace(c, "\n{5,}", "\u0001"), "\n{3,4}", "\n\n"), F.lit("\u0001"), F.lit("\n\n\n"))
    return F.trim(c, F.lit(" \n\t"))


def reading_text(rows: DataFrame, html: str) -> DataFrame:
    """Adds text, repairs (blanks put back within lines) and image_only (pictures, but no text) of chapters."""
    r = rows.withColumn("__r", _raw_reading(F.col(html))).withColumn("text", output_form(F.col("__r.text")))
    return r.withColumns({"repairs": F.col("__r.repairs"), "image_only": (F.col("text") == "") & (F.col("__r.images") > 0)}).drop("__r")


def contents_href(href: Column) -> Column:
    """A link's path as the table of contents is searched by: decoded, with slashes, without leading dots."""
    path = F.regexp_extract(F.coalesce(href, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return F.regexp_replace(F.trim(F.replace(F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path), F.lit("\\"), F.lit("/"))), r"^(\./)+", "")


def with_contents_titles(chapters: DataFrame, contents: DataFrame, book: str, href: str, entry_href: str, entry_title: str, order: str) -> DataFrame:
    """Adds contents_title: the title of the first entry of the table of contents that links to the chapter, or null."""
    t = contents.select(book, contents_href(F.col(entry_href)).alias("__h"), inline_form(F.col(entry_title)).alias("__t"), order).where("__h <> '' and __t <> ''")
    t = t.groupBy(book, "__h").agg(F.min_by("__t", order).alias("contents_title"))
    return chapters.withColumn("__h", contents_href(F.col(href))).join(t, [book, "__h"], "left").drop("__h")
