"""Batches of lines for a generator: windows of similar lengths, rounds by voice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed value: batches in a window.
WINDOW = 5


def length_windows(items: DataFrame, key: str, order: str, n_words: str, batch: int) -> DataFrame:
    """Adds window, position and batch: windows of 5 batches, sorted by length, down and up in turn (stable)."""
    rn = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    d = items.withColumn("window", F.floor(rn / (WINDOW * batch)))
    by = F.when(F.col("window") % 2 == 0, -F.col(n_words)).otherwise(F.col(n_words))
    d = d.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy("window", by, order)) - 1)
    return d.withColumn("batch", F.floor(F.col("position") / batch))


def voice_rounds(items: DataFrame, key: str, order: str, voice: str, batch: int, voices: int) -> DataFrame:
    """Adds window, pile and sub_batch: windows of 5 batches a voice; in each, piles by voice in order of appearance, in chunks."""
    rn = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    d = items.withColumn("__rn", rn).withColumn("window", F.floor(F.col("__rn") / (WINDOW * batch * voices)))
    pile = Window.partitionBy(key, "window", voice)
    d = d.withColumn("__first", F.min("__rn").over(pile)).withColumn("sub_batch", F.floor((F.row_number().over(pile.orderBy("__rn")) - 1) / batch))
    d = d.withColumn("pile", F.dense_rank().over(Window.partitionBy(key, "window").orderBy("__first")) - 1)
    return d.drop("__rn", "__first")


def retry_order(items: DataFrame, key: str, order: str, voice: str) -> DataFrame:
    """Adds position: by voice, then by arrival."""
    return items.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy(voice, order)) - 1)


def rotate_voices(items: DataFrame, key: str, order: str, voices: int) -> DataFrame:
    """Adds voice: each item the next one, around."""
    return items.withColumn("voice", F.pmod(F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1, F.lit(voices)))


def batches(items: DataFrame, key: str, order: str, batch: int) -> DataFrame:
    """Adds batch: so many items each, in order."""
    return items.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1) / batch))


def clamped_voice(voice: Column, voices: int) -> Column:
    return F.least(F.greatest(voice, F.lit(0)), F.lit(voices - 1))


def voice_of(items: DataFrame, voices: DataFrame, selection: str, position: str, count: int) -> DataFrame:
    """Items with the values of the voice that their selection names, around the voices."""
    return items.join(voices, F.pmod(F.col(selection), F.lit(count)) == F.col(position))


def by_priority(requests: DataFrame, key: str, priority: str, arrival: str) -> DataFrame:
    """Adds position: by priority, then by arrival."""
    return requests.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy(priority, arrival)) - 1)
