"""The takes of a project and their sidecars, as tables joined with the present lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import contracts as ct
from folioforge.functions.names import content_hash, take_fields
from folioforge.sources.files import file_name, files
from folioforge.sources.listing import found


def catalog(spark: SparkSession, folder: str, lines: DataFrame, models: list[str]) -> DataFrame:
    """(file, index, hash, model, voice, errors) of files of present lines (index, text).

    Files must not be empty, their name must be a take's, and its digest that of the line's text.
    """
    f = found(spark, folder, "*.flac", content=False).select(file_name(F.col("path")).alias("file"))
    f = f.select("file", take_fields(F.col("file"), models).alias("t")).where("t is not null").select("file", "t.*").withColumn("hash", F.lower("hash"))
    present = lines.select(F.col("index").cast("int").alias("index"), content_hash(F.col("index").cast("long"), F.col("text")).alias("hash"))
    return f.join(present, ["index", "hash"], "left_semi")


def sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """(stem, v variant, error) of the sidecars in a folder, by the stem of their take."""
    s = files(spark, folder, "*.json").select("stem", F.try_parse_json(F.decode("content", "UTF-8")).alias("v"))
    return s.select("stem", "v", ct.sidecar_error(F.col("v")).alias("error"))


def with_sidecars(takes: DataFrame, side: DataFrame) -> DataFrame:
    """Takes with the timed phrases of the sidecar of the same stem, null without or with a bad one."""
    t = takes.withColumn("stem", F.regexp_replace("file", r"\.[^.]*$", ""))
    return t.join(side.select("stem", ct.sidecar_phrases(F.col("v")).alias("phrases")), "stem", "left")


def projects(spark: SparkSession, folder: str) -> DataFrame:
    """(project, settings variant, book struct, error): each sub-folder's project.json with the text beside it."""
    # both kinds of files meet in a group: a join would list and read the folder once for each of its sides
    f = found(spark, folder, "project*.json", recursive=True)
    f = f.select(F.regexp_extract("path", r"([^/]*)/[^/]*$", 1).alias("project"), file_name(F.col("path")).alias("file"), "content").where("file in ('project.json', 'project_text.json')")
    of = lambda name: F.collect_list(F.when(F.col("file") == name, F.col("content")))
    f = f.groupBy("project").agg(of("project.json").alias("s"), of("project_text.json").alias("t"))
    f = f.select("project", F.explode("s").alias("s"), "t").select("project", "s", F.explode_outer("t").alias("t"))
    parsed = lambda c: F.try_parse_json(F.decode(c, "UTF-8"))
    f = f.select("project", parsed("s").alias("settings"), F.col("t").isNull().alias("bare"), parsed("t").alias("v"))
    f = f.select("project", "settings", F.when(~F.col("bare"), ct.book_error(F.col("v"))).alias("error"), F.when(~F.col("bare"), ct.book(F.col("v"))).alias("book"))
    return f.withColumn("error", F.when(F.col("settings").isNull(), "settings").otherwise(F.when(F.col("book").isNull(), F.coalesce("error", F.lit("text missing")))))
