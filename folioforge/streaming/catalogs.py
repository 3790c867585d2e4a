"""A catalog that follows its folder: snapshots of the folder, what changed between two, and a table kept up to date by it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioforge.functions.names import take_fields
from folioforge.sources.files import file_name

TAKES = ("file", "modified", "bytes", "index", "hash", "model", "voice", "errors")


def snapshot(spark: SparkSession, folder: str, models: list[str]) -> DataFrame:
    """(file, modified, bytes, index, hash, model, voice, errors) of the takes that a folder has now; other files are passed over."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    # a file that goes between the listing and the reading is one that the folder has no more
    found = spark.read.format("binaryFile").schema(schema).option("pathGlobFilter", "*.flac").option("ignoreMissingFiles", "true").load(folder).where("length > 0")
    f = found.select(file_name(F.col("path")).alias("file"), F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))
    return f.withColumn("t", take_fields(F.col("file"), models)).where("t is not null").select("file", "modified", "bytes", "t.*").select(*TAKES)


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """The takes that were added, changed or removed between two snapshots, with ``change``; a removed one as it was.

    A full outer join by the file; what neither time nor size tells apart is unchanged.
    """
    b = before.select(*[F.col(c).alias(f"b_{c}") for c in TAKES])
    both = after.select(*TAKES).join(b, F.col("file") == F.col("b_file"), "full")
    same = F.col("modified").eqNullSafe(F.col("b_modified")) & F.col("bytes").eqNullSafe(F.col("b_bytes"))
    change = F.when(F.col("b_file").isNull(), "added").when(F.col("file").isNull(), "removed").when(~same, "changed")
    return both.withColumn("change", change).where("change is not null").select("change", *[F.when(F.col("file").isNull(), F.col(f"b_{c}")).otherwise(F.col(c)).alias(c) for c in TAKES])


def applied(catalog: DataFrame, feed: DataFrame) -> DataFrame:
    """A catalog after a feed of changes: what was removed or changed goes, what was added or changed comes."""
    return catalog.join(feed.where("change <> 'added'").select("file"), "file", "left_anti").unionByName(feed.where("change <> 'removed'").select(*TAKES))


def _versions(spark: SparkSession, table: str) -> list[tuple[int, str]]:
    """(number, path) of the whole versions of a table, the oldest first."""
    at = spark._jvm.org.apache.hadoop.fs.Path(table)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    found = [s.getPath() for s in fs.listStatus(at)]
    return sorted((int(p.getName()[1:]), p.toString()) for p in found if p.getName()[:1] == "v" and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def current(spark: SparkSession, table: str) -> DataFrame:
    """The newest version of a followed catalog."""
    return spark.read.parquet(_versions(spark, table)[-1][1])


def follow_once(spark: SparkSession, folder: str, table: str, models: list[str], number: int) -> DataFrame:
    """Writes version ``number`` of the catalog from the one before and the changes since, and returns these.

    A version that is there already is kept, so a batch that is run again changes nothing; the last two versions stay.
    """
    schema = "file string, modified timestamp, bytes long, index int, hash string, model string, voice string, errors int"
    old = _versions(spark, table)
    before = [v for v in old if v[0] < number]
    catalog = spark.read.parquet(before[-1][1]) if before else spark.createDataFrame([], schema)
    now = snapshot(spark, folder, models)
    feed = changes(catalog.select(*[F.col(c).cast(now.schema[c].dataType) for c in TAKES]), now)
    if all(k != number for k, _ in old):
        applied(catalog.select(*[F.col(c).cast(now.schema[c].dataType) for c in TAKES]), feed).write.mode("overwrite").parquet(f"{table}/v{number}")
        for k, path in before[:-1]:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return feed


def follow(spark: SparkSession, folder: str, table: str, models: list[str], checkpoint: str, seconds: float = 1.0) -> StreamingQuery:
    """A query that brings the catalog up to date every so many seconds; files that go leave it, too."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    step = lambda _, number: follow_once(spark, folder, table, models, int(number))
    return ticks.writeStream.foreachBatch(step).trigger(processingTime=f"{int(seconds * 1000)} milliseconds").option("checkpointLocation", checkpoint).start()
