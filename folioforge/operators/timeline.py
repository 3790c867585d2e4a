"""Timelines: running cursors, runs of gaps, sections, chapters, as-of lookups, pauses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Seconds of pause after each reason.
PAUSES = {"undefined": 1.0, "w": 0.1, "isqe": 0.1, "is": 0.5, "s": 0.9, "p": 1.2, "x": 2.0, "xx": 2.5}
SHORT_PAUSES = {"undefined": 1.0, "w": 0.1, "isqe": 0.1, "is": 0.3, "s": 0.6, "p": 0.9, "x": 1.5, "xx": 2.0}


def pause_of(reason: Column, pauses: dict[str, float] = PAUSES) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in pauses.items() for x in kv]), reason)


def _upto(key: str, order: str, last: int = 0):
    return Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, last)


def time_cursor(items: DataFrame, key: str, order: str, duration: str) -> DataFrame:
    """Adds time_start and time_end; an item without duration is (0, 0) and leaves the cursor."""
    end = F.sum(F.greatest(F.col(duration), F.lit(0))).over(_upto(key, order))
    some = F.col(duration) > 0
    return items.withColumns({"time_start": F.when(some, end - F.col(duration)).otherwise(0), "time_end": F.when(some, end).otherwise(0)})


def runs_without_audio(items: DataFrame, key: str, order: str, duration: str, least: int) -> DataFrame:
    """(key, first, last, n): runs of at least ``least`` neighbouring items without duration."""
    w = Window.partitionBy(key).orderBy(order)
    d = items.select(key, order, F.col(duration), F.row_number().over(w).alias("rn")).where(F.col(duration) <= 0)
    d = d.withColumn("run", F.col("rn") - F.row_number().over(w))
    return d.groupBy(key, "run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).where(F.col("n") >= least).drop("run")


def section_ranges(sections: DataFrame, key: str, order: str, count: str) -> DataFrame:
    """Adds start_index and end_index (half-open) from each section's item count."""
    end = F.sum(count).over(_upto(key, order))
    return sections.withColumns({"start_index": end - F.col(count), "end_index": end})


def marker_ranges(markers: DataFrame, sizes: DataFrame, key: str, marker: str, size: str) -> DataFrame:
    """(key, start, end), inclusive: pieces of 0..size-1 that start at 0 and at each marker inside."""
    starts = markers.select(key, F.col(marker).alias("start")).unionByName(sizes.select(key, F.lit(0).cast(markers.schema[marker].dataType).alias("start"))).distinct()
    s = starts.join(sizes.select(key, F.col(size).alias("n")), key).where("start >= 0 and start < n")
    return s.select(key, "start", (F.lead("start", 1).over(Window.partitionBy(key).orderBy("start"))).alias("next"), "n").select(key, "start", (F.coalesce("next", "n") - 1).alias("end"))


def as_of(queries: DataFrame, segments: DataFrame, key: str, at: str, start: str, end: str, value: str) -> DataFrame:
    """Each query row with the value of the segment of its key that holds its time (start <= t < end), else null.

    One shuffle by key: both sides in one column of events, and the last segment before each query carried on.
    """
    held = F.struct(F.col(end).alias("e"), F.col(value).alias("v"))
    s = segments.select(key, F.col(start).alias("__t"), F.lit(0).alias("__kind"), held.alias("__s"))
    q = queries.select(key, F.col(at).alias("__t"), F.lit(1).alias("__kind"), F.struct(*queries.columns).alias("__row"))
    w = Window.partitionBy(key).orderBy("__t", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    both = q.unionByName(s, allowMissingColumns=True).withColumn("__last", F.last("__s", ignorenulls=True).over(w)).where("__kind = 1")
    return both.select("__row.*", F.when(F.col("__t") < F.col("__last.e"), F.col("__last.v")).alias(value))


def overlaps(sections: DataFrame, ranges: DataFrame, key: str, width: int = 64) -> DataFrame:
    """Sections (half-open start_index, end_index) that touch a range (inclusive start, end) of their key.

    Both sides are dealt to bins of ``width`` indices that they touch; a pair counts in the first bin that
    both have. An empty section counts at its place.
    """
    first = lambda c: F.floor(F.col(c) / width)
    last = F.floor(F.greatest(F.col("end_index") - 1, F.col("start_index")) / width)
    s = sections.withColumn("__bin", F.explode(F.sequence(first("start_index"), last)))
    r = ranges.withColumn("__bin", F.explode(F.sequence(first("start"), first("end"))))
    both = s.join(r, [key, "__bin"]).where("start_index <= end and end_index > start")
    return both.where(F.col("__bin") == F.greatest(first("start_index"), first("start"))).drop("__bin")


def last_audio(items: DataFrame, key: str, order: str, has_audio: Column) -> DataFrame:
    """Adds audio_ordinal: how many items with audio there are up to this one, less one (-1: none yet)."""
    return items.withColumn("audio_ordinal", F.sum(has_audio.cast("int")).over(_upto(key, order)) - 1)


def pauses(items: DataFrame, key: str, order: str, reason: str, head: str, tail: str, present: str) -> DataFrame:
    """Adds pause to present items: what the reason asks, less the silence at this end and at the next present start; the last gets none."""
    p = items.where(F.col(present))
    after = F.lead(head).over(Window.partitionBy(key).orderBy(order))
    p = p.withColumn("pause", F.when(after.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), pause_of(F.col(reason)) - F.col(tail) - after)))
    return p


def remaining_time(samples: DataFrame, key: str, order: str, seconds: str, window: int = 50, least: int = 5) -> DataFrame:
    """Adds mean_seconds of the last ``window`` samples (null before ``least`` of them)."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(1 - window, 0)
    return samples.withColumn("mean_seconds", F.when(F.count(seconds).over(w) >= least, F.avg(seconds).over(w)))


def resets(items: DataFrame, key: str, order: str, is_reset: Column) -> DataFrame:
    """Adds session: the running count of resets before each item."""
    return items.withColumn("session", F.coalesce(F.sum(is_reset.cast("int")).over(_upto(key, order, -1)), F.lit(0)))


def scaled(value: Column, low: float, high: float, to_low: float, to_high: float) -> Column:
    """A value mapped from one range to another, clamped at its ends."""
    return to_low + (to_high - to_low) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low)))


def break_effect(reason: Column, first_in_section: Column) -> Column:
    """Whether a break sounds: chapter ends always, others but for the first of a section."""
    return (reason == "xx") | ((reason == "x") & ~first_in_section)
