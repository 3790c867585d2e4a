"""Batch forms of the streaming operators over the tables, and readers that need no folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import text as tx
from folioforge.operators import pages as pg
from folioforge.plans.text_queries import PHRASES_SQL, documents
from folioforge.registry import register, table
from folioforge.sources import files
from folioforge.streaming import deltas, utterances


@register("sample_blocks", """
WITH s AS (SELECT CAST(user_id AS VARCHAR) AS key, CAST(sum(event_id % 500 + 1) AS BIGINT) AS n FROM events GROUP BY 1), b AS (SELECT key, n, unnest(range(CAST(ceil(n / 1000.0) AS BIGINT))) AS sequence FROM s)
SELECT key, sequence, sequence * 1000 AS start_sample, least(1000, n - sequence * 1000) AS n_samples, 16000 AS rate FROM b
""")
def sample_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of a stream's samples in blocks of a thousand, the last one shorter."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("ord"), (F.col("event_id") % 500 + 1).alias("n_samples"), F.lit(16000).cast("long").alias("rate"))
    return deltas.blocks(e, 1000)


#: A line of five words comes first, so that it is the first piece.
OPENING = "One two three four five.\n"


@register("folded_deltas", PHRASES_SQL.replace("FROM documents", "FROM (SELECT conv_id || '-' || turn AS doc_id, 'en' AS lang, 'One two three four five.' || chr(10) || coalesce(text, '') AS text FROM conversations)").replace("regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[ \\t]+\\n', chr(10), 'g') AS t", "text AS t") + """
SELECT doc_id AS key, CAST(s AS BIGINT) AS sequence, sha256(t) AS piece, CASE WHEN contains(regexp_extract(t, '[BLANK]*$'), chr(10)) THEN 'p' WHEN regexp_matches(rtrim(t), '[.!?…]["”’)]*$') THEN 's' ELSE 'is' END AS reason FROM sentence
""".replace("BLANK", tx.SPACE))
def folded_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that come word by word, handed out sentence by sentence; what an older generation said is dropped."""
    c = table(spark, sf_dir, "conversations").select(F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("key"), "text")
    w = c.select("key", tx.settled(F.split(F.concat(F.lit(OPENING), F.coalesce("text", F.lit(""))), r"(?<= )")).alias("w"))
    d = w.select("key", F.size("w").alias("n"), F.posexplode("w").alias("ord", "text")).select("key", "ord", "text", F.lit(2).alias("generation"), (F.col("ord") == F.col("n") - 1).alias("last"))
    stale = c.select("key", F.explode(F.array(F.lit(-1), F.lit(3))).alias("ord"), F.lit("Stale words. Gone ").alias("text"), F.lit(1).alias("generation"), F.lit(False).alias("last"))
    return deltas.folded(d.unionByName(stale)).withColumn("piece", F.sha2("piece", 256))


@register("stable_previews", PHRASES_SQL + """
, l AS (SELECT doc_id, s, t, max(s) OVER (PARTITION BY doc_id) AS last FROM sentence) SELECT doc_id, count(*) FILTER (WHERE s < last) AS n_complete, sha256(coalesce(string_agg(CASE WHEN s < last THEN t END, '' ORDER BY s), '')) AS preview FROM l GROUP BY doc_id
""")
def stable_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sentences of a growing text but the last."""
    d = documents(spark, sf_dir).where("text <> ''")
    return d.select("doc_id", F.size(deltas.complete_sentences(F.col("text"), F.col("lang"))).cast("long").alias("n_complete"), F.sha2(deltas.stable_preview(F.col("text"), F.col("lang")), 256).alias("preview"))


@register("utterance_chunks")
def utterance_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterances in blocks of a microphone's samples, one block an event, the open one at the end (a state machine; held against a plain loop)."""
    level = F.when(F.col("event_type").isin("view", "click"), F.col("value") / 50).otherwise(0.001)
    b = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("stream"), F.col("event_id").alias("number"), F.array_repeat(level, 100).alias("samples"), F.lit(None).cast("string").alias("control"))
    return utterances.utterances(b, 1000, 100)


@register("decoded_texts", "SELECT doc_id, sha256(coalesce(text, '')) AS decoded FROM documents")
def decoded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in four encodings as bytes, read back without being told which."""
    t, k = F.coalesce("text", F.lit("")), F.col("doc_id") % 3
    data = F.when(k == 0, F.encode(t, "UTF-8")).when(k == 1, F.encode(t, "UTF-16")).otherwise(F.concat(F.lit(b"\xef\xbb\xbf"), F.encode(t, "UTF-8")))
    d = documents(spark, sf_dir).select("doc_id", files.decoded(data).alias("t"))
    return d.select("doc_id", F.sha2("t", 256).alias("decoded"))


@register("supporting_files", """
SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'a/' || p_partkey ELSE 'a/' || p_partkey || '|b' END AS files FROM part
""")
def supporting_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative paths once each; absolute ones and those that leave the folder are dropped."""
    a = F.concat(F.lit("a/"), F.col("p_partkey").cast("string"))
    paths = F.array(a, F.lit("/etc/x"), a, F.when(F.col("p_partkey") % 4 == 0, "../b").otherwise("b"), F.lit("C:\\x"), F.lit(" "))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(files.supporting_files(paths), "|").alias("files"))


@register("navigation_pages", "SELECT page_id, page_id % 5 IN (0, 1, 2) AS navigation FROM pages")
def navigation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Navigation documents by id, name or properties."""
    k = F.col("page_id") % 5
    return table(spark, sf_dir, "pages").select("page_id", pg.is_navigation(F.when(k == 0, "NAV").otherwise("x"), F.when(k == 1, "Text\\Toc.xhtml").otherwise("Text/ch.xhtml"), F.when(k == 2, "scripted nav").otherwise(F.lit(None))).alias("navigation"))
