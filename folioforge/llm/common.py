"""What several operators share: the shared folder, written tables, words, blocks of documents and string hashes."""

from __future__ import annotations

import math
import os
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words, in every operator that speaks of words.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    On one machine (tests) a temporary folder is made and set where none is named; on a cluster that is an error.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.folioforge.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="folioforge-")
        spark.conf.set("spark.folioforge.shared.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path for one run's files below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder, in folders for the values of ``by``.

    Its lineage ends there and lost executors cost nothing.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def dropped(df: DataFrame) -> None:
    """Deletes a table that ``written`` made, once nothing reads it any more."""
    spark = df.sparkSession
    for path in {re.sub(r"(/[^/]*=[^/]*)*/[^/]*$", "", f) for f in df.inputFiles()}:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def local_path(uri: str) -> str:
    return uri[len("file:") :].replace("//", "/", 1) if uri.startswith("file:") else uri


def file_system(uri: str):
    """(Arrow file system, path in it) of a URI, so that workers can write where Spark has no binary writer."""
    from pyarrow import fs

    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + local_path(uri))
    return fs.LocalFileSystem(), os.path.abspath(uri)


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z; other letters stay."""
    return F.translate(c, UPPER, UPPER.lower())


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts, counted by Spark."""
    return docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0


def blocks(docs: DataFrame, block_bytes: int, id_col: str = "doc_id", text: str = "text", total: int | None = None) -> DataFrame:
    """(block, doc_id, text) of every document, dealt by a hash of its id to blocks of about ``block_bytes``.

    A block is the unit that a Python worker holds. Null texts are empty. Rows may repeat.
    """
    n = max(1, math.ceil((text_bytes(docs, text) if total is None else total) / block_bytes))
    return docs.select(
        F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(n)).cast("long").alias("block"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )


# ---------------------------------------------------------------- hashes of byte ranges

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for k, v in (("up", _BASE), ("down", _INVERSE)):
            a = np.full(size, v, np.uint64)
            a[0] = 1
            _powers[k] = np.multiply.accumulate(a)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A finaliser that spreads every bit (splitmix64)."""
    h = h + np.uint64((seed * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Ranges:
    """64-bit hashes of any byte ranges of one buffer, each in constant time, from prefix sums of a polynomial."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        # symbols through a finaliser first, else small byte values leave the low bits weak
        np.cumsum(SYMBOL[data] * up[: len(data)], out=self.sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


SYMBOL = mix(np.arange(256, dtype=np.uint64), 7)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, *range(9, 14)]] = True
