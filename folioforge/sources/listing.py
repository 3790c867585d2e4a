"""Folders listed and their files read by tasks: neither names nor contents of files pass through the driver.

A folder is listed by one task, the folders in it are dealt to others, and what they find is dealt again by its path
before it is read. ``folder/*`` means the files of the folders in it, as Spark's readers take it.
"""

from __future__ import annotations

from collections.abc import Iterator
from fnmatch import fnmatch
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.sources.shared import opened

ENTRY = pa.schema([("path", pa.string()), ("folder", pa.bool_()), ("length", pa.int64()), ("modified", pa.int64())])
FILE = pa.schema([("path", pa.string()), ("modified", pa.int64()), ("length", pa.int64()), ("content", pa.binary())])
#: Bytes of files in a batch of rows.
BATCH = 16 << 20


def tasks(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _shown(name: str) -> bool:
    """Whether Spark's readers see a name."""
    return not name.startswith((".", "_"))


def _entries(found) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), ENTRY, strict=True)], schema=ENTRY)


def _level(file_system, path: str, recursive: bool = False) -> Iterator[tuple]:
    """(path, folder, length, modified in microseconds) of what a folder has; hidden names are passed over."""
    from pyarrow import fs

    for f in file_system.get_file_info(fs.FileSelector(path)):
        if not _shown(f.base_name):
            continue
        if f.is_file:
            yield f.path, False, f.size, f.mtime_ns // 1000 if f.mtime_ns is not None else None
        elif recursive:
            yield from _level(file_system, f.path, True)
        else:
            yield f.path, True, None, None


def listed(spark: SparkSession, folder: str, suffixes: tuple[str, ...] | None = None, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """(path, length, modified) of the files of a folder that are not empty, dealt to tasks by their path."""
    inner = folder.endswith("/*")
    top = folder.removesuffix("/*")

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            file_system, path = opened(top)
            yield from _in_batches(x for x in _level(file_system, path) if (x[1] and (inner or recursive)) or (not x[1] and not inner))

    def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file_system, _ = opened(top)
        for batch in batches:
            rows = (tuple(r.values()) for r in batch.to_pylist())
            yield from _in_batches(y for x in rows for y in (_level(file_system, x[0], recursive) if x[1] else (x,)))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [p.rsplit("/", 1)[-1] for p in batch.column(0).to_pylist()]
            yield batch.filter(pa.array([fnmatch(n, pattern) and (suffixes is None or n.lower().endswith(suffixes)) for n in names], pa.bool_()))

    schema, n = "path string, folder boolean, length long, modified long", tasks(spark)
    # of an RDD, whose size counts as unknown: a range of one row would make any join with the files a broadcast
    one = spark.createDataFrame(spark.sparkContext.parallelize([(0,)], 1), "id long")
    first = one.mapInArrow(begin, schema).repartition(n, "path")
    found = first.mapInArrow(go_on, schema).where("not folder and length > 0").mapInArrow(kept, schema)
    return found.select("path", "length", "modified").repartition(n, "path")


def _in_batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    part = []
    for x in rows:
        part.append(x)
        if len(part) == 10_000:
            yield _entries(part)
            part = []
    if part:
        yield _entries(part)


def found(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = False, content: bool = True) -> DataFrame:
    """What Spark's ``binaryFile`` gives of a folder: (path, modificationTime, length, content), paths as it encodes them.

    Stores that Arrow does not know are left to ``binaryFile``.
    """
    try:
        opened(folder.removesuffix("/*"))
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
        return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", pattern).load(folder)
    files = listed(spark, folder, None, pattern, recursive)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file_system, _ = opened(folder.removesuffix("/*"))
        rows, size = [], 0
        for batch in batches:
            for path, length, modified in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with file_system.open_input_stream(path) as f:
                    data = f.read()
                rows.append((quote(path, safe="/:"), modified, len(data), data))
                size += len(data)
                if size > BATCH or len(rows) == 1000:
                    yield _files(rows)
                    rows, size = [], 0
        if rows:
            yield _files(rows)

    if content:
        files = files.mapInArrow(read, "path string, modified long, length long, content binary")
    else:
        files = files.select(F.replace(F.replace(F.url_encode("path"), F.lit("%2F"), F.lit("/")), F.lit("+"), F.lit("%20")).alias("path"), "modified", "length")
    return files.select("path", F.timestamp_micros("modified").alias("modificationTime"), "length", *(["content"] if content else []))


def _files(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), FILE, strict=True)], schema=FILE)
