"""Text and JSON files as tables. Tasks list and read them (see listing), so the driver holds no names of files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge.functions.text import natural_key
from folioforge.sources.listing import found


def decoded_bytes(data: bytes) -> str:
    """Text of bytes: by its byte order mark, else UTF-8, else UTF-16 where every other byte is 0, else Windows-1252."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return data.decode(name, "replace")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        zeros = data[1::2].count(0), data[::2].count(0)
        if max(zeros) * 4 > len(data):
            return data.decode("utf-16-le" if zeros[0] > zeros[1] else "utf-16-be", "replace")
        return data.decode("cp1252", "replace")


@F.pandas_udf(T.StringType())
def decoded(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else decoded_bytes(bytes(b)))


def lossy_text(data: Column) -> Column:
    """UTF-8 bytes as text, with a replacement sign for what is none."""
    return F.make_valid_utf8(data.cast("string"))


def file_name(path: Column) -> Column:
    return F.regexp_extract(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), r"([^/]*)$", 1)


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(file, stem, bytes, modified, content) of a folder's files; empty ones are passed over."""
    f = found(spark, folder, pattern)
    return f.select(file_name(F.col("path")).alias("file"), F.regexp_replace(file_name(F.col("path")), r"\.[^.]*$", "").alias("stem"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), "content")


def text_books(spark: SparkSession, folder: str) -> DataFrame:
    """(file, title, text) of text files, whatever their encoding; the title is the file's stem."""
    return files(spark, folder, "*.txt").select("file", F.col("stem").alias("title"), decoded(F.col("content")).alias("text"))


def json_documents(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """((file, v variant), (file, text) of the files that are no JSON, for quarantine)."""
    d = files(spark, folder, "*.json").select("file", decoded(F.col("content")).alias("text")).withColumn("v", F.try_parse_json("text"))
    return d.where("v is not null").select("file", "v"), d.where("v is null").select("file", "text")


def write_documents(documents: DataFrame, folder: str, json: str = "json") -> None:
    """JSON documents as lines of text files; Spark's committer makes them visible all at once."""
    documents.select(F.col(json).alias("value")).write.mode("overwrite").text(folder)


def word_lists(spark: SparkSession, folder: str, good: str) -> tuple[DataFrame, DataFrame]:
    """The lines of word lists, those that match a pattern and those that don't."""
    w = spark.read.text(folder).select(F.trim("value").alias("word")).where("word <> ''")
    return w.where(F.rlike("word", F.lit(good))), w.where(~F.rlike("word", F.lit(good)))


def ordered_manifest(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(file, position) of a folder's files in natural order: the list of a concatenation (one row a file of one book)."""
    from pyspark.sql.window import Window

    f = found(spark, folder, pattern, content=False).select(file_name(F.col("path")).alias("file"))
    return f.select("file", (F.row_number().over(Window.orderBy(natural_key(F.col("file")), "file")) - 1).alias("position"))


def supporting_files(paths: Column) -> Column:
    """Relative paths of an array, once each, in their order."""
    inside = F.filter(paths, lambda p: (F.trim(p) != "") & ~F.rlike(p, F.lit(r"^(?:[/\\]|[A-Za-z]:|.*(?:^|[/\\])\.\.(?:[/\\]|$))")))
    return F.array_distinct(inside)
