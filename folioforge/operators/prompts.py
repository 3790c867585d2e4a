"""Texts for models: chunks by speaker or words, paragraph windows, annotated text, model names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioforge.functions.text import let

#: Paragraphs and words of a window.
WINDOW_PARAGRAPHS, WINDOW_WORDS = 3, 160


def paragraphs(text: Column) -> Column:
    """Pieces that end after each run of line feeds; nothing is lost."""
    return F.regexp_extract_all(text, F.lit(r"([^\n]*\n+|[^\n]+$)"), F.lit(1))


def outer_space(paragraph: Column) -> Column:
    """struct<leading, core, trailing> by white space."""
    core = F.trim(paragraph, F.lit(" \t\n\r\f\u000b"))
    at = F.when(core != "", F.instr(paragraph, core) - 1).otherwise(F.length(paragraph))
    return F.struct(F.substring(paragraph, F.lit(1), at).alias("leading"), core.alias("core"), F.substring(paragraph, at + F.length(core) + 1, F.length(paragraph)).alias("trailing"))


def forward_windows(rows: DataFrame, key: str, order: str, words: str) -> DataFrame:
    """(key, window, first, last, n_words): paragraphs in turn, three and 160 words at most, one at least."""
    p = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).cast("long").alias("o"), F.col(words).cast("long").alias("n")))).alias("p"))
    kind = "array<struct<first:bigint,last:bigint,k:int,n:bigint>>"

    def step(done, x):
        now = F.try_element_at(done, F.lit(-1))
        full = (F.size(done) == 0) | F.coalesce((now["k"] >= WINDOW_PARAGRAPHS) | (now["n"] + x["n"] > WINDOW_WORDS), F.lit(True))
        fresh = F.struct(x["o"].alias("first"), x["o"].alias("last"), F.lit(1).alias("k"), x["n"].alias("n"))
        more = F.struct(now["first"].alias("first"), x["o"].alias("last"), (now["k"] + 1).alias("k"), (now["n"] + x["n"]).alias("n"))
        return F.when(full, F.concat(done, F.array(fresh))).otherwise(F.concat(F.slice(done, 1, F.size(done) - 1), F.array(more)))

    w = p.select(key, F.posexplode(F.aggregate("p", F.array().cast(kind), step)).alias("window", "w"))
    return w.select(key, "window", "w.first", "w.last", F.col("w.n").alias("n_words"))


def previous_window(rows: DataFrame, key: str, order: str, words: str) -> DataFrame:
    """Adds context: how many paragraphs before this one fit three and 160 words, one at least if there is one."""
    w = Window.partitionBy(key).orderBy(order)
    sums = [F.sum(words).over(w.rowsBetween(-k, -1)) for k in range(1, WINDOW_PARAGRAPHS + 1)]
    there = [F.lag(order, k).over(w).isNotNull() for k in range(1, WINDOW_PARAGRAPHS + 1)]
    n = F.when(there[0], 1).otherwise(0)
    for k in range(1, WINDOW_PARAGRAPHS):
        n = F.when((n == k) & there[k] & (sums[k] <= WINDOW_WORDS), k + 1).otherwise(n)
    return rows.withColumn("context", n)


def speaker_chunks(text: Column, turns: int = 1) -> Column:
    """A text's turns, each from a line that names a speaker on, in chunks of so many."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    starts = lambda x: x.startswith("[SPEAKER") | x.startswith("<|speaker_id_start|>")
    marked = F.array_join(F.transform(lines, lambda x: F.concat(F.when(starts(x), "\u0001").otherwise(""), x)), "\n")
    found = F.filter(F.transform(F.split(marked, "\u0001"), lambda x: F.trim(x, F.lit(" \n"))), lambda x: x != "")
    chunks = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / turns).cast("int")), lambda i: F.array_join(F.slice(v, i * turns + 1, turns), "\n"))
    return let(found, lambda v: F.when(F.size(v) == 0, v).otherwise(chunks(v)))


def word_chunks(text: Column, most: int) -> Column:
    """A text's paragraphs in chunks of so many words; the last one of a paragraph ends in its blank line."""

    def of(words: Column) -> Column:
        last = F.floor((F.size(words) - 1) / most).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.concat(F.array_join(F.slice(words, i * most + 1, most), " "), F.when(i == last, "\n\n").otherwise("")))

    return F.flatten(F.transform(F.split(text, "\n\n"), lambda p: let(F.split(p, " "), of)))


def without_markup(text: Column) -> Column:
    return F.regexp_replace(text, r"<[^<>]*>", "")


def first_difference(a: Column, b: Column) -> Column:
    """The first position at which two texts differ, from 0; -1 if they don't."""
    both = F.struct(F.lit(0).alias("lo"), F.least(F.length(a), F.length(b)).alias("hi"))

    def halve(r: Column, _: Column) -> Column:  # the longest prefix that both have lies between lo and hi
        mid = F.ceil((r["lo"] + r["hi"]) / 2).cast("int")
        same = F.substring(a, F.lit(1), mid) == F.substring(b, F.lit(1), mid)
        return F.struct(F.when(same, mid).otherwise(r["lo"]).alias("lo"), F.when(same, r["hi"]).otherwise(mid - 1).alias("hi"))

    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.least(F.length(a), F.length(b)) + 2)).cast("int"))
    return F.when(a == b, -1).otherwise(F.aggregate(rounds, both, halve)["lo"])


def model_type(models: DataFrame, catalog: DataFrame, model_id: str, part: str, order: str) -> DataFrame:
    """Adds type: the catalog's entry with the longest part that a model's id contains, equals by the catalog's order; null: none.

    The catalog is a list that a program holds, so it is broadcast; its size is checked.
    """
    if catalog.count() > 10_000:
        raise ValueError("the catalog has over 10 000 entries")
    ids = models.select(model_id).distinct()
    c = catalog.select(F.lower(part).alias("__p"), F.col(order).alias("__o"), F.col("type").alias("__type")).where("__p <> ''")
    hit = ids.join(F.broadcast(c), F.contains(F.lower(F.trim(model_id)), F.col("__p"))).groupBy(model_id).agg(F.min_by("__type", F.struct(-F.length("__p"), F.col("__o"))).alias("type"))
    return models.join(hit, model_id, "left")
