"""Queries on takes, ranges and schedules. Line items stand in for takes of a line (their order), orders for lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import names
from folioforge.operators import catalog as cat
from folioforge.operators import schedule as sch
from folioforge.registry import register, table

#: Takes: index, errors (-1 unknown, to 12), file name, voice.
TAKES_SQL = """
WITH takes AS (
  SELECT l_orderkey AS idx, CAST(l_quantity AS BIGINT) % 14 - 1 AS errors, lpad(CAST(l_linenumber AS VARCHAR), 3, '0') || '-' || l_partkey || '-' || l_suppkey AS name,
    CASE WHEN l_suppkey % 4 = 0 THEN 'none' ELSE 'v' || (l_suppkey % 4) END AS voice, CASE WHEN l_orderkey % 3 = 0 THEN 'm1' ELSE l_returnflag END AS model FROM lineitem
), lines AS (SELECT o_orderkey AS idx, o_custkey % 60 AS n_words FROM orders)
"""


def takes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "lineitem")
    return i.select(
        F.col("l_orderkey").alias("idx"),
        (F.col("l_quantity").cast("long") % 14 - 1).alias("errors"),
        F.concat_ws("-", F.lpad(F.col("l_linenumber").cast("string"), 3, "0"), "l_partkey", "l_suppkey").alias("name"),
        F.when(F.col("l_suppkey") % 4 == 0, "none").otherwise(F.concat(F.lit("v"), (F.col("l_suppkey") % 4).cast("string"))).alias("voice"),
        F.when(F.col("l_orderkey") % 3 == 0, "m1").otherwise(F.col("l_returnflag")).alias("model"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"), (F.col("o_custkey") % 60).alias("n_words"))


@register("best_take", TAKES_SQL + """
SELECT idx, name, errors FROM (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY CASE WHEN errors = -1 THEN 9999 ELSE errors END, name) AS k FROM takes) WHERE k = 1
""")
def best_take(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The take with the fewest errors of each line; unknown counts come last, ties go by name."""
    return cat.best_takes(takes(spark, sf_dir), "idx", "errors", "name")


@register("redundant_takes", TAKES_SQL + """
SELECT idx, name, k AS take_rank FROM (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY CASE WHEN errors = -1 THEN 9999 ELSE errors END, name) AS k FROM takes) WHERE k > 1
""")
def redundant_takes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All takes but the best of their line."""
    return cat.rank_takes(takes(spark, sf_dir), "idx", "errors", "name").where("take_rank > 1").select("idx", "name", F.col("take_rank").cast("long").alias("take_rank"))


@register("common_model_tag", TAKES_SQL + "SELECT idx, CASE WHEN min(model) = max(model) THEN min(model) ELSE '' END AS model FROM takes GROUP BY idx")
def common_model_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model that all takes of a line share, else empty."""
    return cat.common_tag(takes(spark, sf_dir), "idx", "model")


@register("line_status", TAKES_SQL + """
, t AS (
  SELECT l.idx, count(*) AS n_takes, bool_or(errors <> -1 AND errors > CAST(ceil(n_words / 10.0) AS BIGINT)) AS any_failed, min(errors) FILTER (WHERE errors >= 0) AS least FROM takes JOIN lines l USING (idx) GROUP BY l.idx
)
SELECT idx, n_words, coalesce(n_takes, 0) AS n_takes, CASE WHEN n_takes IS NULL THEN 'missing' WHEN any_failed THEN 'failed' WHEN least > 0 THEN 'errors' ELSE 'good' END AS status FROM lines LEFT JOIN t USING (idx)
""")
def line_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with the number of their takes: missing, failed, with errors, or good."""
    return cat.line_status(lines(spark, sf_dir), takes(spark, sf_dir), "idx", "errors", "n_words", "moderate")


@register("lines_without_takes", "SELECT o_orderkey AS idx FROM orders ANTI JOIN lineitem ON o_orderkey = l_orderkey")
def lines_without_takes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected lines that have not been generated."""
    return lines(spark, sf_dir).join(takes(spark, sf_dir), "idx", "left_anti").select("idx")


@register("threshold_by_strictness", """
WITH s(strictness) AS (VALUES ('low'), ('moderate'), ('high'), ('intolerant')), n AS (SELECT DISTINCT o_custkey % 60 AS n_words FROM orders)
SELECT strictness, n_words, CAST(CASE strictness WHEN 'low' THEN ceil(n_words / 10.0) + 1 WHEN 'moderate' THEN ceil(n_words / 10.0) WHEN 'high' THEN greatest(ceil(n_words / 10.0) - 1, 0) ELSE 0 END AS INTEGER) AS most_errors FROM s CROSS JOIN n
""")
def threshold_by_strictness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word errors that a line of each length may have, by strictness."""
    n = lines(spark, sf_dir).select("n_words").distinct().withColumn("strictness", F.explode(F.array(*map(F.lit, ("low", "moderate", "high", "intolerant")))))
    return n.select("strictness", "n_words", cat.threshold(F.col("n_words"), F.col("strictness")).alias("most_errors"))


@register("excessive_duration", """
SELECT event_id, value > 1.5 + 0.75 * CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS too_long FROM events
""")
def excessive_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips longer than 1.5 s and 0.75 s a word."""
    words = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select("event_id", cat.too_long(F.col("value"), words, F.lit(False)).alias("too_long"))


@register("attempt_summary", """
SELECT idx, linenumber, errors, improved FROM (
  SELECT l_orderkey AS idx, l_linenumber AS linenumber, CAST(l_quantity AS BIGINT) AS errors, CAST(l_quantity AS BIGINT) < min(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS improved FROM lineitem)
""")
def attempt_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts at a line in order: does each have fewer errors than all before it."""
    a = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("idx"), F.col("l_linenumber").alias("linenumber"), F.col("l_quantity").cast("long").alias("errors"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("at"))
    return cat.attempt_summary(a, "idx", "at", "errors").drop("at")


# ---------------------------------------------------------------- file names and ranges

_MODELS = ["A", "N"]


@register("segment_tags_parse", """
SELECT l_orderkey AS idx, md5(CAST(l_partkey AS VARCHAR))[1:16] AS digest, CASE WHEN l_returnflag IN ('A', 'N') THEN l_returnflag ELSE '' END AS model, 'v' || (l_suppkey % 4) AS voice,
  CASE WHEN CAST(l_quantity AS BIGINT) % 5 = 0 THEN -1 ELSE CAST(l_quantity AS BIGINT) % 5 END AS errors FROM lineitem
""")
def segment_tags_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of takes are written and parsed back; an error count of 0 has no tag and comes back as unknown."""
    i = table(spark, sf_dir, "lineitem")
    digest, voice = F.substring(F.md5(F.col("l_partkey").cast("string")), 1, 16), F.concat(F.lit("v"), (F.col("l_suppkey") % 4).cast("string"))
    name = names.take_name(F.col("l_orderkey"), digest, F.col("l_returnflag"), voice, F.col("l_quantity").cast("long") % 5, F.concat(F.lit("Line, "), F.col("l_linestatus")))
    t = i.select(names.take_fields(name, _MODELS).alias("t"))
    return t.select(F.col("t.index").cast("long").alias("idx"), F.col("t.hash").alias("digest"), "t.model", "t.voice", F.col("t.errors").cast("long").alias("errors"))


@register("range_parse", """
WITH r AS (SELECT c_custkey AS key, c_custkey % 9 + 1 AS a, c_custkey % 5 AS d, c_custkey % 17 + 1 AS b, c_custkey % 30 + 1 AS n FROM customer),
i AS (SELECT key, a, d, b, n, unnest(range(1, 31)) AS k FROM r)
SELECT key, k - 1 AS idx FROM i WHERE k <= n AND ((k BETWEEN a AND a + d) OR (b <= n AND k >= b AND n % 2 = 0) OR k = 2)
""")
def range_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range strings like ``3-5, 9-, 2`` to the indices they name."""
    k = F.col("c_custkey")
    a, d, b, n = k % 9 + 1, k % 5, k % 17 + 1, k % 30 + 1
    s = lambda c: c.cast("string")
    value = F.concat(s(a), F.lit("-"), s(a + d), F.when(n % 2 == 0, F.concat(F.lit(", "), s(b), F.lit("-"))).otherwise(", bad"), F.lit(", 2"))
    r = table(spark, sf_dir, "customer").select(k.alias("key"), value.alias("value"), n.alias("n"))
    return names.parse_ranges(r, "key", "value", "n").select("key", F.col("index").cast("long").alias("idx"))


@register("range_compact", """
WITH d AS (SELECT DISTINCT o_custkey AS key, o_orderkey % 40 AS i FROM orders), g AS (SELECT key, i, i - row_number() OVER (PARTITION BY key ORDER BY i) AS run FROM d),
r AS (SELECT key, min(i) AS lo, max(i) AS hi FROM g GROUP BY key, run)
SELECT key, string_agg(CAST(lo + 1 AS VARCHAR) || CASE WHEN hi > lo THEN '-' || (hi + 1) ELSE '' END, ', ' ORDER BY lo) AS ranges FROM r GROUP BY key
""")
def range_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of indices as range strings."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), (F.col("o_orderkey") % 40).alias("index"))
    return names.compact_ranges(o, "key")


# ---------------------------------------------------------------- schedules

ITEMS_SQL = "WITH items AS (SELECT o_custkey AS key, o_orderkey AS idx, o_orderkey % 23 AS n_words, o_orderkey % 3 AS voice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS rn FROM orders) "


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), k.alias("idx"), (k % 23).alias("n_words"), (k % 3).alias("voice"))


@register("length_bucket_schedule", ITEMS_SQL + """
, w AS (SELECT *, rn // 10 AS win FROM items), p AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY win, CASE WHEN win % 2 = 0 THEN -n_words ELSE n_words END, idx) - 1 AS position FROM w)
SELECT key, idx, win, position, position // 2 AS batch FROM p
""")
def length_bucket_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of five batches of two, sorted by length, down and up in turn."""
    s = sch.length_windows(items(spark, sf_dir), "key", "idx", "n_words", 2)
    return s.select("key", "idx", F.col("window").alias("win"), F.col("position").cast("long").alias("position"), "batch")


@register("voice_round_schedule", ITEMS_SQL + """
, w AS (SELECT *, rn // 30 AS win FROM items), f AS (SELECT *, min(rn) OVER (PARTITION BY key, win, voice) AS first, row_number() OVER (PARTITION BY key, win, voice ORDER BY rn) - 1 AS k FROM w)
SELECT key, idx, win, dense_rank() OVER (PARTITION BY key, win ORDER BY first) - 1 AS pile, k // 2 AS sub_batch FROM f
""")
def voice_round_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds of three voices: piles by voice in order of appearance, in chunks of two."""
    s = sch.voice_rounds(items(spark, sf_dir), "key", "idx", "voice", 2, 3)
    return s.select("key", "idx", F.col("window").alias("win"), F.col("pile").cast("long").alias("pile"), "sub_batch")


@register("retry_round", ITEMS_SQL + "SELECT key, idx, row_number() OVER (PARTITION BY key ORDER BY voice, idx) - 1 AS position FROM items")
def retry_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retries by voice, then by arrival."""
    return sch.retry_order(items(spark, sf_dir), "key", "idx", "voice").select("key", "idx", F.col("position").cast("long").alias("position"))


@register("voice_rotation", ITEMS_SQL + "SELECT key, idx, rn % 4 AS voice FROM items")
def voice_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voices in turn."""
    return sch.rotate_voices(items(spark, sf_dir), "key", "idx", 4).select("key", "idx", F.col("voice").cast("long").alias("voice"))
