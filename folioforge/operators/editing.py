"""Edits of books: deleted and split groups, section markers from breaks, patterns and lists, remapped indices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def reindexed(groups: DataFrame, book: str, order: str, *more: str) -> DataFrame:
    """Adds new_index: the position in the book, from 0."""
    return groups.withColumn("new_index", (F.row_number().over(Window.partitionBy(book).orderBy(order, *more)) - 1).cast("long"))


def delete_groups(groups: DataFrame, wanted: DataFrame, book: str, index: str, section: str) -> tuple[DataFrame, DataFrame]:
    """(the groups that stay, reindexed; (book, n_deleted, earliest, n_sections_removed) of books that change).

    Wanted ids that the book lacks are passed over; a section without groups is gone with them.
    """
    stay = reindexed(groups.join(wanted, [book, index], "left_anti"), book, index)
    gone = groups.join(wanted, [book, index], "left_semi").groupBy(book).agg(F.count("*").alias("n_deleted"), F.min(index).alias("earliest"))
    emptied = groups.select(book, section).distinct().join(stay.select(book, section).distinct(), [book, section], "left_anti").groupBy(book).agg(F.count("*").alias("n"))
    return stay, gone.join(emptied, book, "left").select(book, "n_deleted", "earliest", F.coalesce("n", F.lit(0)).alias("n_sections_removed"))


def split_groups(groups: DataFrame, cuts: DataFrame, book: str, index: str, phrases: str, boundary: str = "boundary") -> DataFrame:
    """Groups with a cut inside become two; adds side (0 or 1) and new_index. Cuts at or outside the ends are passed over."""
    g = groups.join(cuts.select(book, index, boundary), [book, index], "left")
    inside = F.coalesce((F.col(boundary) > 0) & (F.col(boundary) < F.size(phrases)), F.lit(False))
    halves = F.when(inside, F.array(F.slice(phrases, F.lit(1), F.col(boundary)), F.slice(phrases, F.col(boundary) + 1, F.size(phrases)))).otherwise(F.array(phrases))
    return reindexed(g.select(*[c for c in groups.columns if c != phrases], F.posexplode(halves).alias("side", phrases)), book, index, "side")


def commit_edit(markers: DataFrame, takes: DataFrame, cutoffs: DataFrame, book: str, index: str, snapshot: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(markers before, takes before the book's earliest edit; books whose edit is stale).

    cutoffs: (book, cutoff, snapshot, current): an edit made on another snapshot than the current one changes nothing.
    """
    stale = cutoffs.where(~F.col(snapshot).eqNullSafe(F.col("current")))
    live = cutoffs.where(F.col(snapshot).eqNullSafe(F.col("current"))).select(book, "cutoff")
    keep = lambda d: d.join(live, book, "left").where(F.col("cutoff").isNull() | (F.col(index) < F.col("cutoff"))).drop("cutoff")
    return keep(markers), keep(takes), stale.select(book)


def toggled(markers: DataFrame, toggles: DataFrame, book: str, index: str) -> DataFrame:
    """Markers that are in one of both sides only."""
    both = markers.select(book, index).distinct().unionAll(toggles.select(book, index).distinct())
    return both.groupBy(book, index).count().where("count = 1").drop("count")


def break_markers(phrases: DataFrame, book: str, group: str, reason: str) -> DataFrame:
    """(book, marker): the group after each one that holds a break (``x``), but for the last group."""
    p = phrases.groupBy(book, group).agg(F.max((F.col(reason) == "x").cast("int")).alias("__x"))
    return p.withColumn("__last", F.max(group).over(Window.partitionBy(book))).where((F.col("__x") == 1) & (F.col(group) < F.col("__last"))).select(book, (F.col(group) + 1).alias("marker"))


def pattern_markers(groups: DataFrame, book: str, group: str, text: str, pattern: str) -> DataFrame:
    """(book, marker): groups but the first whose text starts with a pattern, case aside."""
    return groups.where(F.rlike(F.col(text), F.lit(rf"\A(?i:{pattern})")) & (F.col(group) > 0)).select(book, F.col(group).alias("marker"))


def listed_markers(value: Column) -> Column:
    """array<bigint> of a list like ``4, 2`` (1-based), sorted, once each, without the first line; null if an item is bad."""
    found = F.transform(F.split(value, ","), lambda x: F.trim(x).try_cast("bigint") - 1)
    return F.when(~F.exists(found, lambda x: x.isNull() | (x < 0)), F.filter(F.array_sort(F.array_distinct(found)), lambda x: x > 0))


def remapped(markers: DataFrame, parts: DataFrame, book: str, index: str, n_parts: str) -> DataFrame:
    """Adds new_index to markers: where their item begins once each item is ``n_parts`` (one at least); beyond the last: the total."""
    w = Window.partitionBy(book).orderBy(index)
    n = F.greatest(F.col(n_parts), F.lit(1))
    start = parts.select(book, index, F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("new_index"))
    total = parts.groupBy(book).agg(F.sum(n).alias("__total"))
    return markers.join(start, [book, index], "left").join(total, book).withColumn("new_index", F.coalesce("new_index", "__total")).drop("__total")


def matches(rows: DataFrame, query: Column, *fields: str) -> DataFrame:
    """Rows in which a field holds the query, case aside."""
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.coalesce(F.contains(F.lower(f), F.lower(query)), F.lit(False))
    return rows.where(hit)


def next_around(cursors: DataFrame, places: DataFrame, book: str, cursor: str, place: str, forward: bool = True) -> DataFrame:
    """Adds found: the next place after the cursor, else the first one again (or backwards); null without places."""
    p = places.select(book, place).distinct().withColumnRenamed(place, "__p")
    near = F.min if forward else F.max
    beyond = F.col("__p") > F.col(cursor) if forward else F.col("__p") < F.col(cursor)
    found = cursors.join(p, book, "left").groupBy(*cursors.columns).agg(near(F.when(beyond, F.col("__p"))).alias("a"), near("__p").alias("b"))
    return found.select(*cursors.columns, F.coalesce("a", "b").alias("found"))
