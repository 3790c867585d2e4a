"""Chapters to books: groups of each chapter, their places in the whole book, markers, and sections with their groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioforge.operators import segmentation as seg


def chapter_groups(chapters: DataFrame, strategy: str = "normal", max_words: int = 40, *, book: str = "book", order: str = "ord", text: str = "text", language: str | None = None) -> DataFrame:
    """Chapters (book, ord, ...) that have text, with in its place groups array<array<struct<position, text, reason, n_words>>>.

    The last phrase of a chapter ends it (``xx``); after the first chapter a leading run of groups that end in a break
    (``x``) ends in paragraphs. A chapter is one row: nothing is shuffled but for its place among the others.
    """
    c = chapters.where(F.rlike(text, F.lit(r"\S")))
    c = c.withColumn("__first", F.col(order) == F.min(order).over(Window.partitionBy(book)))
    keep = [x for x in c.columns if x not in (book, text)]
    c = seg.grouped(seg.phrase_arrays(c, max_words, book, text, language, keep), strategy, max_words)
    last_reason = lambda x: F.element_at(x, -1)["reason"]
    run = F.coalesce(F.nullif(F.array_position(F.transform("groups", lambda x: last_reason(x) == "x"), False), F.lit(0)) - 1, F.size("groups").cast("long"))
    c = c.withColumn("__run", F.when(F.col("__first"), F.lit(0).cast("long")).otherwise(run))

    def ended(x: Column, k: Column) -> Column:
        reason = F.when(k == F.size("groups") - 1, "xx").when(k < F.col("__run"), "p").otherwise(last_reason(x))
        return F.transform(x, lambda p, i: F.when(i == F.size(x) - 1, p.withField("reason", reason)).otherwise(p))

    return c.withColumn("groups", F.transform("groups", ended)).drop("__first", "__run")


def placed_chapters(chapters: DataFrame, *, book: str = "book", order: str = "ord") -> DataFrame:
    """Chapters with groups, and start_index and end_index: the places of their groups in the book. Starts but 0 are its markers."""
    w = Window.partitionBy(book).orderBy(order)
    n = F.size("groups").cast("long")
    return chapters.withColumn("end_index", F.sum(n).over(w)).withColumn("start_index", F.col("end_index") - n)


def sectioned(groups: DataFrame, starts: DataFrame, *, book: str = "book", index: str = "group_index", start: str = "start", title: str = "title") -> DataFrame:
    """(book, section, title, start_index, end_index, groups) of flat groups (book, group_index, phrases) cut at starts (book, ord, start, title).

    The first section begins with the book; starts outside of it count for nothing; titles go by section, in the order of
    ``ord``, empty where there is none. Starts and groups are sorted together and counted, so no section is looked for.
    """
    size = groups.groupBy(book).agg((F.max(index) + 1).alias("__n"))
    inside = starts.join(size, book).where((F.col(start) > 0) & (F.col(start) <= F.col("__n"))).select(book, F.col(start).cast("long").alias("__at"))
    begin = size.select(book, F.lit(0).cast("long").alias("__at")).unionByName(inside)
    w = Window.partitionBy(book).orderBy("__at")
    sections = begin.join(size, book).select(book, (F.row_number().over(w) - 1).alias("section"), F.col("__at").alias("start_index"), F.coalesce(F.lead("__at").over(w), "__n").alias("end_index"))
    named = starts.select(book, (F.row_number().over(Window.partitionBy(book).orderBy("ord")) - 1).alias("section"), F.col(title).alias("title"))
    marks = sections.where("end_index > start_index").select(book, F.col("start_index").alias("__at"), "section", F.lit(None).cast(groups.schema["phrases"].dataType).alias("phrases"), F.lit(0).alias("__kind"))
    rows = groups.select(book, F.col(index).cast("long").alias("__at"), F.lit(None).cast("int").alias("section"), "phrases", F.lit(1).alias("__kind"))
    both = marks.unionByName(rows).withColumn("section", F.last("section", True).over(Window.partitionBy(book).orderBy("__at", "__kind"))).where("__kind = 1")
    held = both.groupBy(book, "section").agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", "phrases"))), lambda x: x["phrases"]).alias("groups"))
    out = sections.join(named, [book, "section"], "left").join(held, [book, "section"], "left")
    none = F.array().cast(held.schema["groups"].dataType)
    return out.select(book, "section", F.coalesce("title", F.lit("")).alias("title"), "start_index", "end_index", F.coalesce("groups", none).alias("groups"))


def section_metadata(sections: DataFrame, counts: DataFrame, *, book: str = "book", n_segments: str = "n") -> DataFrame:
    """(book, section, title, start_index, end_index) of the sections within so many segments; empty ones go. A join, for many books."""
    s = sections.join(counts.select(book, F.col(n_segments).alias("__n")), book).where(F.col("start_index") < F.col("__n"))
    return s.withColumn("end_index", F.least("end_index", "__n")).where("end_index > start_index").select(book, "section", "title", "start_index", "end_index")


def remapped_sections(sections: DataFrame, places: DataFrame, *, book: str = "book", first: str = "first", last: str = "last") -> DataFrame:
    """(book, section, title, start_index, end_index) of an output's sections, counted in its text segments.

    sections: (book, section, title, start_index, end_index, first, last): an output has the lines from first to last,
    both inside. places: (book, index, n_parts): the lines, and how many segments each became (one at least).
    """
    lo, hi = F.greatest("start_index", first), F.least(F.col("end_index"), F.col(last) + 1)
    s = sections.withColumns({"__a": lo, "__b": hi}).where("__b > __a")
    n = F.greatest(F.col("n_parts"), F.lit(1))
    p = places.select(book, F.col("index").cast("long").alias("__i"), F.coalesce(F.sum(n).over(Window.partitionBy(book).orderBy("index").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__s"))
    total = places.groupBy(book).agg(F.sum(n).alias("__total"))
    at = lambda c, out: p.select(book, F.col("__i").alias(c), F.col("__s").alias(out))
    s = s.join(total, book).join(at("__a", "__sa"), [book, "__a"], "left").join(at("__b", "__sb"), [book, "__b"], "left")
    s = s.withColumn("__f", F.col(first)).join(at("__f", "__sf"), [book, "__f"], "left")
    return s.select(book, "section", "title", (F.coalesce("__sa", "__total") - F.coalesce("__sf", F.lit(0))).alias("start_index"), (F.coalesce("__sb", "__total") - F.coalesce("__sf", F.lit(0))).alias("end_index"))
