"""Output files of a book: what they cover, what they are called, which are the latest, how fast they were made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioforge.functions.text import file_name_form
from folioforge.operators.catalog import common_tag, mode_of_tags


def within(lines: DataFrame, files: DataFrame, key: str, index: str, output: str, first: str, last: str) -> DataFrame:
    """Lines with the output file whose range (both ends count) holds them; ranges of a book don't overlap.

    One pass over both in order of the index: the last range begun, if it has not ended.
    """
    f = files.select(key, F.col(first).alias("__i"), F.lit(0).alias("__kind"), F.struct(F.col(output).alias("o"), F.col(last).alias("l")).alias("__f"))
    q = lines.select(key, F.col(index).alias("__i"), F.lit(1).alias("__kind"), F.struct(*lines.columns).alias("__row"))
    w = Window.partitionBy(key).orderBy("__i", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    both = q.unionByName(f, allowMissingColumns=True).withColumn("__last", F.last("__f", True).over(w)).where("__kind = 1 and __i <= __last.l")
    return both.select("__row.*", F.col("__last.o").alias(output))


def coverage(lines: DataFrame, takes: DataFrame, files: DataFrame, key: str, index: str, output: str, first: str, last: str) -> DataFrame:
    """(key, output, first, last, n_segments, n_exist, n_missing) of each file; a line exists if it has a take."""
    made = takes.select(key, index).distinct().withColumn("__made", F.lit(True))
    n = within(lines, files, key, index, output, first, last).join(made, [key, index], "left")
    n = n.groupBy(key, output).agg(F.count("*").alias("n_segments"), F.count("__made").alias("n_exist")).withColumn("n_missing", F.col("n_segments") - F.col("n_exist"))
    return files.select(key, output, first, last).join(n, [key, output])


def stems(lines: DataFrame, takes: DataFrame, files: DataFrame, key: str, index: str, output: str, first: str, last: str, title: Column) -> DataFrame:
    """(key, output, stem): title, which file of how many, its lines, how many are missing, the common model, the voices."""
    c = coverage(lines, takes, files, key, index, output, first, last).withColumn("__n", F.count("*").over(Window.partitionBy(key)))
    t = within(takes, files, key, index, output, first, last).withColumn("__file", F.struct(key, output))
    tags = common_tag(t, "__file", "model").join(mode_of_tags(t, "__file", "voice"), "__file").select("__file.*", "model", "voice", "others")
    s = lambda x: F.col(x).cast("string") if isinstance(x, str) else x.cast("string")
    parts = F.array(
        file_name_form(title, 20), F.when(F.col("__n") > 1, F.concat(F.lit("["), s(F.col(output) + 1), F.lit(" of "), s("__n"), F.lit("]"))), F.when(F.col("__n") > 1, F.concat(F.lit("["), s(F.col(first) + 1), F.lit("-"), s(F.col(last) + 1), F.lit("]"))),
        F.when(F.col("n_missing") > 0, F.concat(F.lit("["), s("n_missing"), F.lit(" missing]"))), F.when(F.col("model") != "", F.concat(F.lit("["), F.col("model"), F.lit("]"))),
        F.when(F.col("voice") != "", F.concat(F.lit("["), F.col("voice"), F.when(F.col("others") > 0, F.concat(F.lit(" +"), s("others"))).otherwise(""), F.lit("]"))),
    )
    return c.join(tags, [key, output], "left").select(key, output, F.array_join(F.array_compact(parts), " ").alias("stem"))


def latest(files: DataFrame, folder: str, name: str, mtime: str, most: int, excluded: str = "[debug]") -> DataFrame:
    """(folder, name): the first file by name of the folders that changed last; names with the excluded tag are passed over."""
    f = files.groupBy(folder).agg(F.max(mtime).alias("__m"), F.min(F.when(~F.contains(F.col(name), F.lit(excluded)), F.col(name))).alias(name)).where(F.col(name).isNotNull())
    return f.orderBy(F.desc("__m"), folder).limit(most).select(folder, name)


def speed(items: DataFrame, key: str, duration: str, elapsed: str, trimmed: str, rate: int) -> DataFrame:
    """(key, factor, removed, buffered): audio a second of work (99.9 at most), seconds that trimming removed, samples as seconds."""
    factor = F.least(F.sum(duration) / F.greatest(F.sum(elapsed), F.lit(0.1)), F.lit(99.9))
    return items.groupBy(key).agg(F.round(factor, 6).alias("factor"), F.round(F.sum(F.greatest(F.col(duration) - F.col(trimmed), F.lit(0.0))), 6).alias("removed"), F.round(F.sum(duration) / rate, 6).alias("buffered"))
