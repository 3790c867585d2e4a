"""Queries on audio files that Spark writes from the vectors: tags of FLAC and MP4 files, chunks of samples."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from folioforge.registry import register, table
from folioforge.sources import audio
from folioforge.sources.listing import tasks
from folioforge.sources.shared import new_folder

#: Ten vectors in a row are a clip.
CLIPS_SQL = "WITH v AS (SELECT vec_id // 10 AS clip, vec_id, embedding, label FROM embeddings)"


@F.pandas_udf(BinaryType())
def _flac(samples: pd.Series) -> pd.Series:
    return samples.map(lambda x: audio.flac_file(16000, len(x), np.asarray(x, "<f4").tobytes()))


@F.pandas_udf(BinaryType())
def _mp4(samples: pd.Series) -> pd.Series:
    places = audio.atom(b"trak", audio.atom(b"mdia", audio.atom(b"minf", audio.atom(b"stbl", audio.atom(b"stco", bytes(4) + (1).to_bytes(4, "big") + (999).to_bytes(4, "big"))))))
    return samples.map(lambda x: audio.atom(b"ftyp", b"M4A \0\0\0\0") + audio.atom(b"moov", places) + audio.atom(b"mdat", np.asarray(x, "<f4").tobytes()))


@F.pandas_udf(BinaryType())
def _wave(samples: pd.Series) -> pd.Series:
    return samples.map(lambda x: audio.wave_file(np.trunc(np.clip(np.asarray(x, np.float64), -1, 1) * 32767), 16000))


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clip, x, labels): the samples of ten vectors and their labels."""
    v = table(spark, sf_dir, "embeddings").groupBy(F.floor(F.col("vec_id") / 10).alias("clip")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding", "label"))).alias("v"))
    return v.select("clip", F.flatten(F.transform("v", lambda x: x["embedding"])).alias("x"), F.array_join(F.transform("v", lambda x: x["label"].cast("string")), ",").alias("labels"))


def written(files: DataFrame, name: str) -> str:
    """Writes (file, content) into folders of a new one that all share, one a task, and returns the path of these."""
    spark = files.sparkSession
    audio.register(spark)
    folder = new_folder(spark, name)
    # the files of a folder go to one task, which makes it
    files.repartition(tasks(spark), F.regexp_replace("file", "/[^/]*$", "")).write.format("named_files").option("path", folder).option("taskFolders", "true").mode("append").save()
    return f"{folder}/*"


@register("flac_tags", CLIPS_SQL + """
, t AS (SELECT clip, string_agg(label, ',' ORDER BY vec_id) AS labels FROM v GROUP BY clip), f AS (SELECT clip, labels, unnest(['TITLE', 'LABELS']) AS field, unnest([0, 1]) AS ord FROM t)
SELECT 'c' || clip || '.flac' AS file, 'flac' AS kind, field, CASE field WHEN 'TITLE' THEN 'Clip é ' || clip ELSE labels END AS value, ord, true AS header_only FROM f
""")
def flac_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags written into FLAC files, one of them twice, and read back from their headers."""
    c = F.col("clip").cast("string")
    content = audio.with_flac_tag(_flac("x"), "labels", F.lit("old"))
    content = audio.with_flac_tag(audio.with_flac_tag(content, "title", F.concat(F.lit("Clip é "), c)), "Labels", F.col("labels"))
    folder = written(clips(spark, sf_dir).select(F.concat(F.lit("c"), c, F.lit(".flac")).alias("file"), content.alias("content")), "flac")
    return audio.tags(spark, folder).select("file", "kind", "field", "value", "ord", (F.col("bytes_read") < 600).alias("header_only"))


@register("mp4_tags", CLIPS_SQL + """
, t AS (SELECT clip, string_agg(label, ',' ORDER BY vec_id) AS labels FROM v GROUP BY clip), f AS (SELECT clip, labels, unnest(['title', 'labels']) AS field, unnest([0, 1]) AS ord FROM t)
SELECT 'c' || clip || '.m4a' AS file, 'mp4' AS kind, '----:app.book:' || field AS field, CASE field WHEN 'title' THEN 'Clip é ' || clip ELSE labels END AS value, ord, true AS header_only FROM f
""")
def mp4_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free-form tags written into MP4 files, one of them twice, and read back by a walk over the atoms."""
    c = F.col("clip").cast("string")
    content = audio.with_mp4_tag(_mp4("x"), "app.book", "labels", F.lit("old"))
    content = audio.with_mp4_tag(audio.with_mp4_tag(content, "app.book", "title", F.concat(F.lit("Clip é "), c)), "app.book", "labels", F.col("labels"))
    folder = written(clips(spark, sf_dir).select(F.concat(F.lit("c"), c, F.lit(".m4a")).alias("file"), content.alias("content")), "mp4")
    return audio.tags(spark, folder).select("file", "kind", "field", "value", "ord", (F.col("bytes_read") < 1600).alias("header_only"))


@register("pcm_chunks", CLIPS_SQL + """
, s AS (SELECT clip, vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM v), n AS (SELECT clip, trunc(greatest(-1, least(1, CAST(x AS DOUBLE))) * 32767) AS y, row_number() OVER (PARTITION BY clip ORDER BY vec_id, i) - 1 AS k FROM s)
SELECT 'c' || clip || '.wav' AS file, 16000 AS rate, k // 100 AS chunk, k // 100 * 100 AS start_sample, count(*) AS n_samples, CAST(sum(y * (k % 100 + 1)) AS BIGINT) AS weighted FROM n GROUP BY clip, k // 100
""")
def pcm_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of WAV files in chunks of a hundred, three chunks a task; each chunk with a sum that knows their places."""
    files = clips(spark, sf_dir).select(F.concat(F.lit("c"), F.col("clip").cast("string"), F.lit(".wav")).alias("file"), _wave("x").alias("content"))
    p = audio.pcm_chunks(spark, written(files, "wave"), 100, 300)
    weighted = F.aggregate(F.transform("samples", lambda x, i: F.round(x * 32768).cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, x: a + x)
    return p.select("file", "rate", "chunk", "start_sample", F.col("n_samples").cast("long").alias("n_samples"), weighted.alias("weighted"))
