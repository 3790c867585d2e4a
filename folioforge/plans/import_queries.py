"""Queries on books from end to end, catalogs and choices, prompts that are put together, and longer sound."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioforge.functions import text as tx
from folioforge.operators import books as bk
from folioforge.operators import catalog as cat
from folioforge.operators import pages as pg
from folioforge.operators import segmentation as seg
from folioforge.operators import signal as sg
from folioforge.plans.audio_queries import CLIPS_SQL, clips
from folioforge.plans.book_queries import CHAIN_SQL
from folioforge.plans.text_queries import PAGES_SQL, TITLES_SQL, pages
from folioforge.registry import register, table
from folioforge.streaming import prompts

#: Ten pages are a book, a page's preview is a chapter.
CHAPTERS_SQL = f"SELECT page_id AS doc_id, 'en' AS lang, t AS text, {TITLES_SQL} AS title FROM named"
BOOK_SQL = PAGES_SQL.rstrip() + ", chapter AS (" + CHAPTERS_SQL + ")," + CHAIN_SQL.replace("FROM documents", "FROM chapter").lstrip().removeprefix("WITH") + """
, c AS (SELECT *, coalesce(sum(CASE WHEN reason IN ('s', 'p', 'x') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM chain),
g AS (SELECT doc_id // 10 AS book, doc_id, CAST(g AS BIGINT) AS g, string_agg(t, '' ORDER BY position) AS t, arg_max(reason, position) AS reason FROM c WHERE doc_id IN (SELECT doc_id FROM chapter WHERE regexp_matches(text, '[^ \\t\\n\\r\\f]')) GROUP BY doc_id, g),
r AS (SELECT *, max(g) OVER (PARTITION BY doc_id) AS last, min(doc_id) OVER (PARTITION BY book) AS first, min(CASE WHEN reason = 'x' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY g) AS lead_run, row_number() OVER (PARTITION BY book ORDER BY doc_id, g) - 1 AS group_index FROM g),
book AS (SELECT book, doc_id, group_index, t, CASE WHEN g = last THEN 'xx' WHEN lead_run = 1 AND doc_id <> first THEN 'p' ELSE reason END AS reason FROM r)
"""


def book_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir).select(F.floor(F.col("page_id") / 10).alias("book"), F.col("page_id").alias("ord"), pg.title(F.col("html"), F.col("href")).alias("title"), pg.preview(F.col("html")).alias("text"))
    return bk.placed_chapters(bk.chapter_groups(p, "sentence", 1_000_000))


@register("imported_books", BOOK_SQL + "SELECT book, group_index, reason, sha256(t) AS t FROM book")
def imported_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters to the groups of their book: each chapter ends in ``xx``, the breaks at its start are paragraphs."""
    c = book_chapters(spark, sf_dir).select("book", "start_index", F.posexplode_outer("groups").alias("k", "g")).where("k is not null")
    return c.select("book", (F.col("start_index") + F.col("k")).alias("group_index"), F.element_at("g", -1)["reason"].alias("reason"), F.sha2(seg.group_text(F.col("g")), 256).alias("t"))


@register("sectioned_books", BOOK_SQL + """
, s AS (SELECT book, doc_id, min(group_index) AS start_index, max(group_index) + 1 AS end_index, string_agg(t, '' ORDER BY group_index) AS t FROM book GROUP BY book, doc_id)
SELECT s.book, row_number() OVER (PARTITION BY s.book ORDER BY s.doc_id) - 1 AS section, title, start_index, end_index, sha256(t) AS t FROM s JOIN chapter ON s.doc_id = chapter.doc_id
""")
def sectioned_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat groups of a book, its markers and the titles of its chapters to sections with their groups."""
    c = book_chapters(spark, sf_dir)
    flat = c.select("book", "start_index", F.posexplode_outer("groups").alias("k", "phrases")).where("k is not null").select("book", (F.col("start_index") + F.col("k")).alias("group_index"), "phrases")
    out = bk.sectioned(flat, c.select("book", "ord", F.col("start_index").alias("start"), "title"))
    whole = F.array_join(F.transform("groups", seg.group_text), "")
    return out.select("book", F.col("section").cast("long").alias("section"), "title", "start_index", "end_index", F.sha2(whole, 256).alias("t"))


SECTIONS_SQL = """
WITH l AS (SELECT l_orderkey // 8 AS book, l_orderkey, l_linenumber, l_quantity, row_number() OVER (PARTITION BY l_orderkey // 8 ORDER BY l_orderkey, l_linenumber, l_quantity) - 1 AS i FROM lineitem),
s AS (SELECT book, l_orderkey, dense_rank() OVER (PARTITION BY book ORDER BY l_orderkey) - 1 AS section, min(i) AS start_index, max(i) + 1 AS end_index FROM l GROUP BY book, l_orderkey)
"""


def _sections(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Eight orders are a book, an order is a section, its lines are the lines."""
    w = Window.partitionBy("book").orderBy("l_orderkey", "l_linenumber", "l_quantity")
    lines = table(spark, sf_dir, "lineitem").withColumn("book", F.floor(F.col("l_orderkey") / 8)).select("book", "l_orderkey", "l_quantity", (F.row_number().over(w) - 1).cast("long").alias("index"))
    s = lines.groupBy("book", "l_orderkey").agg(F.min("index").alias("start_index"), (F.max("index") + 1).alias("end_index"))
    s = s.withColumn("section", (F.dense_rank().over(Window.partitionBy("book").orderBy("l_orderkey")) - 1).cast("long")).withColumn("title", F.col("l_orderkey").cast("string"))
    return lines, s


@register("section_metadata", SECTIONS_SQL + """
, n AS (SELECT book, count(*) * 2 // 3 AS n FROM l GROUP BY book)
SELECT s.book, section, CAST(l_orderkey AS VARCHAR) AS title, start_index, least(end_index, n) AS end_index FROM s JOIN n ON s.book = n.book WHERE start_index < n
""")
def section_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of a book of which only two thirds were told."""
    lines, s = _sections(spark, sf_dir)
    return bk.section_metadata(s, lines.groupBy("book").agg(F.floor(F.count("*") * 2 / 3).alias("n")))


@register("remapped_sections", SECTIONS_SQL + """
, p AS (SELECT book, i, greatest(CAST(l_quantity AS BIGINT) % 4, 1) AS parts FROM l), o AS (SELECT book, max(i) // 4 AS first, max(i) * 3 // 4 AS last FROM l GROUP BY book),
c AS (SELECT s.book, section, l_orderkey, greatest(start_index, first) AS a, least(end_index, last + 1) AS b, first FROM s JOIN o ON s.book = o.book)
SELECT c.book, section, CAST(any_value(l_orderkey) AS VARCHAR) AS title, CAST(coalesce(sum(parts) FILTER (WHERE i >= first AND i < a), 0) AS BIGINT) AS start_index, CAST(coalesce(sum(parts) FILTER (WHERE i >= first AND i < b), 0) AS BIGINT) AS end_index
FROM c JOIN p ON c.book = p.book WHERE b > a GROUP BY c.book, section
""")
def remapped_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of an output that has the middle of a book, whose lines became several segments each."""
    lines, s = _sections(spark, sf_dir)
    top = lines.groupBy("book").agg(F.max("index").alias("m"))
    s = s.join(top, "book").withColumns({"first": F.floor(F.col("m") / 4), "last": F.floor(F.col("m") * 3 / 4)})
    return bk.remapped_sections(s, lines.select("book", "index", (F.col("l_quantity").cast("long") % 4).alias("n_parts")))


@register("line_classes", """
WITH l AS (SELECT o_orderkey AS idx, o_orderkey % 9 + 1 AS n_words FROM orders), t AS (SELECT l_orderkey AS idx, CAST(l_quantity AS INTEGER) % 4 - 1 AS errors FROM lineitem WHERE l_linenumber <= 2),
s AS (SELECT l.idx, count(t.idx) AS n_takes, min(CASE WHEN errors >= 0 THEN errors END) AS least, bool_or(errors > ceil(n_words / 10.0) AND errors <> -1) AS failed FROM l LEFT JOIN t ON l.idx = t.idx GROUP BY l.idx)
SELECT idx, n_takes, n_takes > 0 AS generated, n_takes = 0 AS ungenerated, coalesce(least > 0, false) AS with_errors, coalesce(failed, false) AS failed FROM s
""")
def line_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes that each line is in, by its takes and its words."""
    lines = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"), (F.col("o_orderkey") % 9 + 1).alias("n_words"))
    takes = table(spark, sf_dir, "lineitem").where("l_linenumber <= 2").select(F.col("l_orderkey").alias("idx"), (F.col("l_quantity").cast("int") % 4 - 1).alias("errors"))
    return cat.line_classes(lines, takes, "idx", "errors", "n_words", "moderate").select("idx", "n_takes", "generated", "ungenerated", "with_errors", "failed")


@register("output_choices", """
WITH o AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) - 1 AS output, CAST(l_quantity AS INTEGER) % 5 AS n_exist FROM lineitem), n AS (SELECT k, max(output) + 1 AS n FROM o GROUP BY k),
w AS (SELECT DISTINCT k, n, unnest(CASE k % 3 WHEN 0 THEN range(1, n + 1) WHEN 1 THEN [1, 2] ELSE [n, 9] END) AS item FROM n), v AS (SELECT w.k, item, o.n_exist FROM w LEFT JOIN o ON w.k = o.k AND o.output = item - 1),
e AS (SELECT k, CASE WHEN k % 3 = 2 AND count(*) FILTER (WHERE n_exist IS NULL) > 0 THEN 'no such output: 9' WHEN k % 3 = 1 AND count(*) FILTER (WHERE n_exist IS NULL) > 0 THEN 'no such output: 1-2'
  WHEN k % 3 > 0 AND count(*) FILTER (WHERE n_exist = 0) > 0 THEN 'no audio: ' || string_agg(item, ', ' ORDER BY item) FILTER (WHERE n_exist = 0) END AS error FROM v GROUP BY k)
SELECT v.k, CAST(item - 1 AS INTEGER) AS output, NULL AS error FROM v JOIN e ON v.k = e.k WHERE error IS NULL AND n_exist > 0 UNION ALL SELECT k, NULL, error FROM e WHERE error IS NOT NULL
""")
def output_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs chosen by number, range or ``all``; one without audio or that is not there spoils the choice."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_quantity")) - 1
    o = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), place.alias("output"), (F.col("l_quantity").cast("int") % 5).alias("n_exist"))
    n = o.groupBy("k").agg((F.max("output") + 1).alias("n"))
    choice = n.select("k", F.when(F.col("k") % 3 == 0, " ALL").when(F.col("k") % 3 == 1, "1-2").otherwise(F.concat(F.col("n").cast("string"), F.lit(", 9"))).alias("value"))
    return cat.output_choice(o, choice, "k")


@register("spoken_prompts", """
WITH t AS (SELECT conv_id, turn, trim(coalesce(text, '')) AS t FROM conversations) SELECT CAST(conv_id AS VARCHAR) AS key, string_agg(t, ' ' ORDER BY turn) AS prompt, count(*) AS n_pieces, 0 AS sequence FROM t WHERE t <> '' AND turn % 3 <> 1 GROUP BY conv_id
""")
def spoken_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts from additions of which each third is taken back again, entered at the end."""
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("key"), "turn", F.trim(F.coalesce("text", F.lit(""))).alias("text")).where("text <> ''")
    add = t.select("key", (F.col("turn") * 2).alias("ord"), F.lit("add").alias("action"), "text")
    gone = t.where("turn % 3 = 1").select("key", (F.col("turn") * 2 + 1).alias("ord"), F.lit("delete").alias("action"), F.lit(None).cast("string").alias("text"))
    enter = t.groupBy("key").agg((F.max("turn") * 2 + 2).alias("ord")).select("key", "ord", F.lit("enter").alias("action"), F.lit(None).cast("string").alias("text"))
    return prompts.assembled(add.unionByName(gone).unionByName(enter)).select("key", "prompt", "n_pieces", "sequence")


SAMPLES_SQL = CLIPS_SQL + """
, s AS (SELECT clip, vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(len(embedding))) AS i FROM v), x AS (SELECT clip, row_number() OVER (PARTITION BY clip ORDER BY vec_id, i) - 1 AS k, x FROM s), n AS (SELECT clip, count(*) AS n FROM x GROUP BY clip)
"""


@register("band_limited_clips", SAMPLES_SQL + f"""
, o AS (SELECT clip, unnest(range(n * 8000 // 16000)) AS m FROM n), t AS (SELECT o.clip, m, x, m * 2 - k AS d FROM o JOIN x ON o.clip = x.clip AND x.k BETWEEN m * 2 - HALF AND m * 2 + HALF)
SELECT clip, m // 50 AS part, round(sum(x * CUT * CASE WHEN d = 0 THEN 1 ELSE sin(pi() * CUT * d) / (pi() * CUT * d) END * (0.5 + 0.5 * cos(pi() * d / HALF)) * (m % 50 + 1)), 3) AS weighted FROM t GROUP BY clip, m // 50
""".replace("HALF", "52").replace("CUT", str(sg.PASSED / 2)))
def band_limited_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips at half their rate, without what it cannot hold, in parts of fifty samples with a sum that knows their places."""
    y = clips(spark, sf_dir).select("clip", sg.band_limited(F.col("x"), 16000, 8000).alias("y")).select("clip", F.posexplode("y").alias("m", "y"))
    return y.groupBy("clip", F.floor(F.col("m") / 50).alias("part")).agg(F.round(F.sum(F.col("y") * (F.col("m") % 50 + 1)), 3).alias("weighted"))


@register("joined_chunks", SAMPLES_SQL + """
SELECT x.clip, CAST(CASE WHEN k < 200 THEN 0 ELSE (k - 50) // 150 END AS BIGINT) AS chunk, count(*) AS n, round(sum(2 * x * (k % 7 + 1)), 3) AS weighted FROM x JOIN n ON x.clip = n.clip WHERE n > 200 GROUP BY ALL
""")
def joined_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips made louder in chunks of 200 that overlap by 50, joined again: the samples of the whole clip made louder."""
    c = clips(spark, sf_dir).where(F.size("x") > 200).select("clip", "x", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil((F.size("x") - 50) / 150).cast("int") - 1, F.lit(0)))).alias("k"))
    louder = F.transform(F.slice("x", F.col("k") * 150 + 1, F.lit(200)), lambda v: v.cast("double") * 2)
    j = sg.overlap_added(c.select("clip", (F.col("k") * 150).alias("start"), louder.alias("x")), "clip", "start", "x", 50)
    s = j.select("clip", "start", F.posexplode("x").alias("i", "y")).withColumn("k", F.col("start") + F.col("i"))
    chunk = F.when(F.col("k") < 200, 0).otherwise(F.floor((F.col("k") - 50) / 150)).cast("long")
    return s.groupBy("clip", chunk.alias("chunk")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("y") * (F.col("k") % 7 + 1)), 3).alias("weighted"))


@register("trailing_bursts")
def trailing_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips with half a second of quiet and, in half of them, a short burst at the end, which goes (held against brute force)."""
    c = clips(spark, sf_dir).withColumn("x", F.transform("x", lambda v: v.cast("double")))
    quiet = F.transform(F.sequence(F.lit(1), F.lit(800)), lambda i: 0.001 * F.sin(i.cast("double")))
    burst = F.transform(F.slice("x", 1, 40), lambda v: v * 0.8)
    data = F.concat("x", quiet, F.when(F.col("clip") % 2 == 0, burst).otherwise(F.slice("x", 1, 0)))
    c = c.select("clip", data.alias("x"))
    return c.select("clip", F.size("x").alias("n"), F.size(sg.without_burst(F.col("x"), 1600)).alias("n_kept"))
