"""What a player asks of a timeline: playable ranges, neighbours of a time in a gap, sections to show, sample ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def playable_range(segments: DataFrame, key: str, index: str, start: str, end: str) -> DataFrame:
    """(key, first, stop, duration): the first segment with audio, the one after the last, and the latest end; -1, -1, 0 without."""
    plays = F.col(end) > F.col(start)
    return segments.groupBy(key).agg(
        F.coalesce(F.min(F.when(plays, F.col(index))), F.lit(-1)).alias("first"), F.coalesce(F.max(F.when(plays, F.col(index))) + 1, F.lit(-1)).alias("stop"), F.coalesce(F.max(F.when(plays, F.col(end))), F.lit(0)).alias("duration")
    )


def valid_bookmarks(bookmarks: DataFrame, segments: DataFrame, key: str, index: str, start: str, end: str) -> DataFrame:
    """The bookmarks that name a segment with audio."""
    return bookmarks.join(segments.where(F.col(end) > F.col(start)).select(key, index), [key, index], "left_semi")


def enclosing(queries: DataFrame, segments: DataFrame, key: str, at: str, index: str, start: str, end: str) -> DataFrame:
    """Adds before and after: the segment with audio that holds the time (both ends count) twice, else its neighbours (null at the ends).

    One pass over both sides in order of time: the last start before, and the first start after.
    """
    s = segments.where(F.col(end) > F.col(start)).select(key, F.col(start).alias("__t"), F.lit(0).alias("__kind"), F.struct(F.col(index).alias("i"), F.col(end).alias("e")).alias("__s"))
    q = queries.select(key, F.col(at).alias("__t"), F.lit(1).alias("__kind"), F.struct(*queries.columns).alias("__row"))
    w = Window.partitionBy(key).orderBy("__t", "__kind")
    both = q.unionByName(s, allowMissingColumns=True)
    both = both.withColumn("__b", F.last("__s", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__a", F.first("__s", True).over(w.rowsBetween(1, Window.unboundedFollowing))).where("__kind = 1")
    inside = F.col("__t") <= F.col("__b.e")
    return both.select("__row.*", F.col("__b.i").alias("before"), F.when(inside, F.col("__b.i")).otherwise(F.col("__a.i")).alias("after"))


def first_playable(sections: DataFrame, segments: DataFrame, key: str, start_index: str, end_index: str, index: str, start: str, end: str) -> DataFrame:
    """Adds playable: the first segment with audio in each half-open section, -1 without; by the next one with audio from the section's start on."""
    n = segments.select(key, F.col(index).alias("__i"), F.lit(0).alias("__kind"), F.when(F.col(end) > F.col(start), F.col(index)).alias("__p"))
    s = sections.select(key, F.col(start_index).alias("__i"), F.lit(1).alias("__kind"), F.struct(*sections.columns).alias("__row"))
    w = Window.partitionBy(key).orderBy(F.col("__i").desc(), "__kind").rowsBetween(Window.unboundedPreceding, 0)
    both = s.unionByName(n, allowMissingColumns=True).withColumn("__next", F.last("__p", True).over(w)).where("__kind = 1")
    return both.select("__row.*", F.when(F.col("__next") < F.col(f"__row.{end_index}"), F.col("__next")).otherwise(F.lit(-1)).alias("playable"))


def shown_sections(sections: DataFrame, sizes: DataFrame, key: str, start: str, end: str, size: str) -> DataFrame:
    """(key, start, end): the sections of a book if they cover its segments without a gap, else one block for all."""
    w = Window.partitionBy(key).orderBy(start, end)
    s = sections.join(sizes.select(key, F.col(size).alias("__n")), key)
    good = (F.col(start) == F.coalesce(F.lag(end).over(w), F.lit(0))) & (F.col(end) > F.col(start)) & (F.col(end) <= F.col("__n"))
    s = s.withColumn("__good", F.coalesce(good, F.lit(False)))
    whole = s.groupBy(key).agg((F.min("__good") & (F.max(end) == F.max("__n"))).alias("__all"))
    blocks = sizes.join(whole, key, "left").where(~F.coalesce("__all", F.lit(False))).select(key, F.lit(0).cast("long").alias(start), F.col(size).cast("long").alias(end))
    return s.join(whole.where("__all"), key, "left_semi").select(key, F.col(start).cast("long").alias(start), F.col(end).cast("long").alias(end)).unionByName(blocks)


def shifted(start: Column, end: Column, trim_start: Column, trim_end: Column) -> tuple[Column, Column]:
    """A phrase's times in a clip of which a part is left."""
    return F.greatest(start - trim_start, F.lit(0.0)), F.least(end, trim_end - trim_start)


def subdivided(phrases: DataFrame, clip: str, order: str, start: str, end: str, offset: str, duration: str) -> DataFrame:
    """Phrases of clips on the book's timeline: each begins where the one before it in its clip ends, the last ends with its clip."""
    w = Window.partitionBy(clip).orderBy(order)
    ends = F.when(F.lead(order).over(w).isNull(), F.col(offset) + F.col(duration)).otherwise(F.col(offset) + F.col(end))
    p = phrases.withColumn("__end", ends)
    return p.withColumns({start: F.coalesce(F.lag("__end").over(w), F.col(offset) + F.col(start)), end: F.col("__end")}).drop("__end")


def sample_ranges(phrases: DataFrame, key: str, order: str, start: str, end: str, rate: int, first: str, last: str) -> DataFrame:
    """Adds sample_start and sample_end in first..last of the stream: in order, without overlap; the last phrase ends with the stream, empty ones are dropped."""
    w = Window.partitionBy(key).orderBy(order)
    inside = lambda c: F.greatest(F.col(first), F.least(F.col(first) + F.rint(F.col(c) * rate).cast("long"), F.col(last)))
    p = phrases.withColumns({"__s": inside(start), "__e": F.when(F.lead(order).over(w).isNull(), F.col(last)).otherwise(inside(end))})
    p = p.withColumn("sample_start", F.greatest("__s", F.coalesce(F.max("__e").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col(first)))).withColumn("sample_end", F.col("__e"))
    return p.where("sample_end > sample_start").drop("__s", "__e")


def group_ranges(starts: DataFrame, key: str, start: str, total: str) -> DataFrame:
    """(key, start, end): half-open ranges from starts to the next one or the total; empty ones are dropped."""
    w = Window.partitionBy(key).orderBy(start)
    return starts.select(key, F.col(start).alias("start"), F.coalesce(F.lead(start).over(w), F.col(total)).alias("end")).where("end > start")


def chapter_times(sections: DataFrame, clips: DataFrame, key: str, start_index: str, index: str, duration: str) -> DataFrame:
    """(key, start_index, time_start, time_end): when each section begins on its file's timeline, and the next one, or the file's end."""
    upto = Window.partitionBy(key).orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    at = clips.select(key, F.col(index).alias(start_index), F.coalesce(F.sum(duration).over(upto), F.lit(0)).alias("time_start"), F.sum(duration).over(Window.partitionBy(key)).alias("__all"))
    s = sections.select(key, start_index).join(at, [key, start_index])
    return s.select(key, start_index, "time_start", F.coalesce(F.lead("time_start").over(Window.partitionBy(key).orderBy(start_index)), F.col("__all")).alias("time_end"))


def chapter_text(chapters: DataFrame, key: str, order: str, start_ms: str, end_ms: str, title: str) -> DataFrame:
    """(key, metadata): the chapters of a file in the text form that encoders read."""
    sign = F.regexp_replace(F.col(title), r"([=;#\\\n])", r"\\$1")
    one = F.concat(F.lit("[CHAPTER]\nTIMEBASE=1/1000\nSTART="), F.col(start_ms).cast("string"), F.lit("\nEND="), F.col(end_ms).cast("string"), F.lit("\ntitle="), sign)
    c = chapters.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), one.alias("t")))).alias("c"))
    return c.select(key, F.concat(F.lit(";FFMETADATA1\n"), F.array_join(F.transform("c", lambda x: x["t"]), "\n")).alias("metadata"))
