"""Queries on players, outputs and edits. Line items of an order stand in for the segments of a book."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioforge.functions import names
from folioforge.functions import text as tx
from folioforge.operators import catalog as cat
from folioforge.operators import editing as ed
from folioforge.operators import outputs
from folioforge.operators import player as pl
from folioforge.operators import schedule as sch
from folioforge.operators import timeline as tl
from folioforge.registry import register, table

#: Segments of a book (an order's customer) in order: index from 0, hundredths of a second, 0 without audio.
SEGMENTS_SQL = """
WITH raw AS (
  SELECT o_custkey AS book, l_orderkey AS section, l_linenumber AS line, CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE CAST(l_quantity AS BIGINT) * 10 END AS dur,
    row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS idx FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), timed AS (SELECT *, CAST(sum(dur) OVER (PARTITION BY book ORDER BY idx) AS BIGINT) AS t FROM raw
), seg AS (SELECT book, section, line, idx, dur, CASE WHEN dur > 0 THEN t - dur ELSE 0 END AS time_start, CASE WHEN dur > 0 THEN t ELSE 0 END AS time_end FROM timed)
"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rn = F.row_number().over(Window.partitionBy("o_custkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")) - 1
    i = i.select(F.col("o_custkey").alias("book"), F.col("l_orderkey").alias("section"), F.col("l_linenumber").alias("line"), rn.cast("long").alias("idx"), F.when(F.col("l_linenumber") % 3 == 0, 0).otherwise(F.col("l_quantity").cast("long") * 10).alias("dur"))
    return tl.time_cursor(i, "book", "idx", "dur")


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-open sections of each book."""
    return segments(spark, sf_dir).groupBy("book", "section").agg(F.min("idx").alias("start_index"), (F.max("idx") + 1).alias("end_index"))


@register("playable_range", SEGMENTS_SQL + "SELECT book, coalesce(min(idx) FILTER (WHERE dur > 0), -1) AS first, coalesce(max(idx) FILTER (WHERE dur > 0) + 1, -1) AS stop, coalesce(max(time_end) FILTER (WHERE dur > 0), 0) AS duration FROM seg GROUP BY book")
def playable_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the first to the last segment with audio, and the end of the audio."""
    return pl.playable_range(segments(spark, sf_dir), "book", "idx", "time_start", "time_end")


@register("valid_bookmarks", SEGMENTS_SQL + "SELECT o_custkey AS book, o_orderkey % 50 AS idx, o_orderkey AS mark FROM orders o WHERE EXISTS (SELECT 1 FROM seg WHERE seg.book = o.o_custkey AND seg.idx = o.o_orderkey % 50 AND dur > 0)")
def valid_bookmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookmarks that name a segment with audio."""
    b = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book"), (F.col("o_orderkey") % 50).alias("idx"), F.col("o_orderkey").alias("mark"))
    return pl.valid_bookmarks(b, segments(spark, sf_dir), "book", "idx", "time_start", "time_end")


@register("enclosing_segments", SEGMENTS_SQL + """
, q AS (SELECT o_custkey AS book, o_orderkey AS query, CAST(floor(o_totalprice) AS BIGINT) % 20000 - 100 AS t FROM orders), a AS (SELECT * FROM seg WHERE dur > 0),
b AS (SELECT q.*, x.idx AS b, x.time_end AS e FROM q ASOF LEFT JOIN a x ON q.book = x.book AND q.t >= x.time_start), c AS (SELECT b.*, x.idx AS a FROM b ASOF LEFT JOIN a x ON b.book = x.book AND b.t < x.time_start)
SELECT book, query, t, b AS before, CASE WHEN t <= e THEN b ELSE a END AS after FROM c
""")
def enclosing_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segment that holds a time, or its neighbours with audio."""
    q = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book"), F.col("o_orderkey").alias("query"), (F.col("o_totalprice").cast("long") % 20000 - 100).alias("t"))
    q = q.withColumn("t", F.col("t").cast("long"))
    return pl.enclosing(q, segments(spark, sf_dir), "book", "t", "idx", "time_start", "time_end")


@register("first_playable", SEGMENTS_SQL + "SELECT book, section, min(idx) AS start_index, max(idx) + 1 AS end_index, coalesce(min(idx) FILTER (WHERE dur > 0), -1) AS playable FROM seg GROUP BY book, section")
def first_playable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first segment with audio of each section."""
    return pl.first_playable(sections(spark, sf_dir), segments(spark, sf_dir), "book", "start_index", "end_index", "idx", "time_start", "time_end").withColumn("playable", F.col("playable").cast("long"))


@register("shown_sections", SEGMENTS_SQL + """
, s AS (SELECT book, section, min(idx) + CASE WHEN book % 3 = 0 AND min(idx) > 0 THEN 1 ELSE 0 END AS a, max(idx) + 1 AS b FROM seg GROUP BY book, section), n AS (SELECT book, count(*) AS n FROM seg GROUP BY book),
g AS (SELECT s.*, n, a = coalesce(lag(b) OVER (PARTITION BY s.book ORDER BY a, b), 0) AND b > a AND b <= n AS good FROM s JOIN n USING (book)), w AS (SELECT book, bool_and(good) AND max(b) = max(n) AS whole FROM g GROUP BY book)
SELECT book, a AS start_index, b AS end_index FROM g JOIN w USING (book) WHERE whole UNION ALL SELECT book, 0, n FROM n JOIN w USING (book) WHERE NOT whole
""")
def shown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections without gaps as they are, else one block for the book (a third of the books have gaps here)."""
    s = sections(spark, sf_dir).withColumn("start_index", F.col("start_index") + F.when((F.col("book") % 3 == 0) & (F.col("start_index") > 0), 1).otherwise(0))
    return pl.shown_sections(s, segments(spark, sf_dir).groupBy("book").agg(F.count("*").alias("n")), "book", "start_index", "end_index", "n")


@register("subdivided_phrases", SEGMENTS_SQL + """
, c AS (SELECT book, section, line, idx, dur, CAST(book * 7 AS DOUBLE) AS off, 3.5 * (sum(dur) OVER (PARTITION BY section)) / 100.0 AS clip, dur / 200.0 AS s, dur / 100.0 AS e, row_number() OVER (PARTITION BY section ORDER BY idx) AS rn, count(*) OVER (PARTITION BY section) AS n FROM seg),
x AS (SELECT *, CASE WHEN rn = n THEN off + clip ELSE off + e END AS e2 FROM c)
SELECT book, idx, round(coalesce(lag(e2) OVER (PARTITION BY section ORDER BY idx), off + s), 6) AS time_start, round(e2, 6) AS time_end FROM x
""")
def subdivided_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases within clips on the book's timeline, without gaps."""
    s = segments(spark, sf_dir).withColumn("clip", 3.5 * F.sum("dur").over(Window.partitionBy("section")) / 100)
    p = s.select("book", "section", "idx", (F.col("book") * 7).cast("double").alias("off"), "clip", (F.col("dur") / 200).alias("s"), (F.col("dur") / 100).alias("e"))
    p = pl.subdivided(p, "section", "idx", "s", "e", "off", "clip")
    return p.select("book", "idx", F.round("s", 6).alias("time_start"), F.round("e", 6).alias("time_end"))


@register("trimmed_times", SEGMENTS_SQL + "SELECT book, idx, round(greatest(time_start / 100.0 - 1.5, 0), 6) AS time_start, round(least(time_end / 100.0, 30.0 - 1.5), 6) AS time_end FROM seg")
def trimmed_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times after a clip was cut to 1.5..30 seconds."""
    a, b = pl.shifted(F.col("time_start") / 100, F.col("time_end") / 100, F.lit(1.5), F.lit(30.0))
    return segments(spark, sf_dir).select("book", "idx", F.round(a, 6).alias("time_start"), F.round(b, 6).alias("time_end"))


@register("sample_ranges", SEGMENTS_SQL + """
, c AS (SELECT book, idx, row_number() OVER (PARTITION BY book ORDER BY idx) AS rn, count(*) OVER (PARTITION BY book) AS n, greatest(1000, least(1000 + (time_start * 10), 60000)) AS s, greatest(1000, least(1000 + (time_end * 10) + 7, 60000)) AS e0 FROM seg),
d AS (SELECT *, CASE WHEN rn = n THEN 60000 ELSE e0 END AS e FROM c), f AS (SELECT *, greatest(s, coalesce(max(e) OVER (PARTITION BY book ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1000)) AS s2 FROM d)
SELECT book, idx, s2 AS sample_start, e AS sample_end FROM f WHERE e > s2
""")
def sample_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases as ranges of a stream's samples, in order and without overlap."""
    s = segments(spark, sf_dir).select("book", "idx", (F.col("time_start") / 100).alias("a"), ((F.col("time_end") + 0.7) / 100).alias("b"), F.lit(1000).cast("long").alias("lo"), F.lit(60000).cast("long").alias("hi"))
    return pl.sample_ranges(s, "book", "idx", "a", "b", 1000, "lo", "hi").select("book", "idx", "sample_start", "sample_end")


@register("group_ranges", SEGMENTS_SQL + """
, s AS (SELECT DISTINCT book, idx - idx % 3 AS start FROM seg), n AS (SELECT book, count(*) AS n FROM seg GROUP BY book)
SELECT s.book, start, coalesce(lead(start) OVER (PARTITION BY s.book ORDER BY start), n) AS "end" FROM s JOIN n USING (book)
""")
def group_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of phrases from the starts of groups."""
    s = segments(spark, sf_dir).withColumn("n", F.count("*").over(Window.partitionBy("book")))
    return pl.group_ranges(s.select("book", (F.col("idx") - F.col("idx") % 3).alias("start"), "n").distinct(), "book", "start", "n")


CHAPTERS_SQL = SEGMENTS_SQL + """
, s AS (SELECT book, section, min(idx) AS i FROM seg GROUP BY book, section), a AS (SELECT s.book, s.section, i, coalesce((SELECT 0), 0) AS z FROM s),
c AS (SELECT book, idx, CAST(sum(dur) OVER (PARTITION BY book ORDER BY idx) AS BIGINT) - dur AS t, CAST(sum(dur) OVER (PARTITION BY book) AS BIGINT) AS total FROM seg),
x AS (SELECT a.book, a.i AS start_index, t AS time_start, coalesce(lead(t) OVER (PARTITION BY a.book ORDER BY a.i), total) AS time_end FROM a JOIN c ON a.book = c.book AND a.i = c.idx)
"""


def _chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    return pl.chapter_times(sections(spark, sf_dir), s, "book", "start_index", "idx", "dur")


@register("chapter_times", CHAPTERS_SQL + "SELECT * FROM x")
def chapter_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each section begins and ends on its book's timeline."""
    return _chapters(spark, sf_dir)


@register("chapter_metadata", CHAPTERS_SQL + r"""
SELECT book, ';FFMETADATA1' || chr(10) || string_agg('[CHAPTER]' || chr(10) || 'TIMEBASE=1/1000' || chr(10) || 'START=' || time_start * 10 || chr(10) || 'END=' || time_end * 10 || chr(10) || 'title=Part \= ' || start_index, chr(10) ORDER BY start_index) AS metadata FROM x GROUP BY book
""")
def chapter_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters as encoders read them."""
    c = _chapters(spark, sf_dir).select("book", "start_index", (F.col("time_start") * 10).alias("a"), (F.col("time_end") * 10).alias("b"), F.concat(F.lit("Part = "), F.col("start_index").cast("string")).alias("title"))
    return pl.chapter_text(c, "book", "start_index", "a", "b", "title")


# ---------------------------------------------------------------- edits


@register("deleted_groups", SEGMENTS_SQL + """
, gone AS (SELECT book, section, idx FROM seg WHERE (idx * 7 + book) % 4 = 0), stay AS (SELECT * FROM seg ANTI JOIN gone USING (book, idx)), n AS (SELECT book, idx, section, row_number() OVER (PARTITION BY book ORDER BY idx) - 1 AS new_index FROM stay)
SELECT book, section, idx, new_index FROM n
""")
def deleted_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups that stay after a deletion, with their new positions."""
    s = segments(spark, sf_dir).select("book", "section", "idx")
    wanted = s.where((F.col("idx") * 7 + F.col("book")) % 4 == 0).select("book", "idx").unionByName(s.select("book", F.lit(-5).cast("long").alias("idx")).distinct())
    return ed.delete_groups(s, wanted, "book", "idx", "section")[0]


@register("deletion_summary", SEGMENTS_SQL + """
, gone AS (SELECT book, section, idx FROM seg WHERE (idx * 7 + book) % 2 = 0), emptied AS (SELECT book, section FROM seg GROUP BY 1, 2 HAVING bool_and((idx * 7 + book) % 2 = 0))
SELECT book, count(*) AS n_deleted, min(idx) AS earliest, (SELECT count(*) FROM emptied e WHERE e.book = gone.book) AS n_sections_removed FROM gone GROUP BY book
""")
def deletion_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a deletion did to each book: groups gone, the earliest of them, sections gone with them."""
    s = segments(spark, sf_dir).select("book", "section", "idx")
    return ed.delete_groups(s, s.where((F.col("idx") * 7 + F.col("book")) % 2 == 0).select("book", "idx"), "book", "idx", "section")[1]


@register("split_groups", SEGMENTS_SQL + """
, g AS (SELECT section AS grp, book, list(idx ORDER BY idx) AS phrases, section % 4 AS cut FROM seg GROUP BY section, book),
h AS (SELECT book, grp, unnest(CASE WHEN cut > 0 AND cut < len(phrases) THEN [phrases[:cut], phrases[cut + 1:]] ELSE [phrases] END) AS phrases, unnest(CASE WHEN cut > 0 AND cut < len(phrases) THEN [0, 1] ELSE [0] END) AS side FROM g)
SELECT book, grp, side, array_to_string(phrases, ',') AS phrases, row_number() OVER (PARTITION BY book ORDER BY grp, side) - 1 AS new_index FROM h
""")
def split_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups split at a phrase."""
    g = segments(spark, sf_dir).groupBy("book", F.col("section").alias("grp")).agg(F.sort_array(F.collect_list("idx")).alias("phrases"))
    out = ed.split_groups(g, g.select("book", "grp", (F.col("grp") % 4).cast("int").alias("boundary")), "book", "grp", "phrases")
    return out.select("book", "grp", "side", F.array_join(F.col("phrases").cast("array<string>"), ",").alias("phrases"), "new_index")


@register("committed_markers", SEGMENTS_SQL + "SELECT book, idx FROM seg WHERE idx % 4 = 1 AND (book % 3 <> 1 OR book % 2 = 0 OR idx < book % 11)")
def committed_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers after edits: those from the earliest edit on go, unless the edit was made on an old snapshot."""
    s = segments(spark, sf_dir)
    b = s.select("book").distinct().where("book % 3 = 1")
    cuts = b.select("book", (F.col("book") % 11).alias("cutoff"), F.lit(1).alias("snapshot"), F.when(F.col("book") % 2 == 0, 2).otherwise(1).alias("current"))
    return ed.commit_edit(s.where("idx % 4 = 1").select("book", "idx"), s.select("book", "idx"), cuts, "book", "idx", "snapshot")[0]


@register("toggled_markers", SEGMENTS_SQL + "SELECT book, idx FROM seg WHERE (idx % 2 = 0) <> (idx % 3 = 0)")
def toggled_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers in one of two sets only."""
    s = segments(spark, sf_dir)
    return ed.toggled(s.where("idx % 2 = 0"), s.where("idx % 3 = 0"), "book", "idx").select("book", "idx")


@register("break_markers", SEGMENTS_SQL + """
, g AS (SELECT book, idx // 4 AS grp, bool_or(dur = 0 AND line % 2 = 0) AS x FROM seg GROUP BY 1, 2), l AS (SELECT *, max(grp) OVER (PARTITION BY book) AS last FROM g)
SELECT book, grp + 1 AS marker FROM l WHERE x AND grp < last
""")
def break_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section markers after groups that hold a break."""
    s = segments(spark, sf_dir).select("book", F.floor(F.col("idx") / 4).alias("grp"), F.when((F.col("dur") == 0) & (F.col("line") % 2 == 0), "x").otherwise("s").alias("reason"))
    return ed.break_markers(s, "book", "grp", "reason")


@register("pattern_markers", "SELECT doc_id // 50 AS book, doc_id % 50 AS marker FROM documents WHERE doc_id % 50 > 0 AND regexp_matches(text, '^(?i:the|die|an|es) ')")
def pattern_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section markers where a text starts with a pattern."""
    d = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 50).alias("book"), (F.col("doc_id") % 50).alias("grp"), "text")
    return ed.pattern_markers(d, "book", "grp", "text", "(?:the|die|an|es) ")


@register("listed_markers", """
SELECT c_custkey AS key, CASE WHEN c_custkey % 7 = 0 OR c_custkey % 9 = 0 THEN NULL ELSE array_to_string(list_sort(list_filter(list_distinct([c_custkey % 9 - 1, c_custkey % 4 + 1, 0]), lambda x: x > 0)), ',') END AS markers FROM customer
""")
def listed_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers from a list like ``9, 4, 1``; null where an item is bad."""
    k = F.col("c_custkey")
    s = lambda c: c.cast("string")
    value = F.concat(s(k % 9), F.lit(", "), s(k % 4 + 2), F.when(k % 7 == 0, ", x").otherwise(", 1"))
    return table(spark, sf_dir, "customer").select(k.alias("key"), F.array_join(ed.listed_markers(value).cast("array<string>"), ",").alias("markers"))


@register("remapped_markers", SEGMENTS_SQL + """
, n AS (SELECT book, idx, greatest(line % 4, 1) AS n FROM seg), p AS (SELECT book, idx, CAST(sum(n) OVER (PARTITION BY book ORDER BY idx) AS BIGINT) - n AS new_index FROM n), t AS (SELECT book, CAST(sum(n) AS BIGINT) AS total FROM n GROUP BY book),
m AS (SELECT DISTINCT book, idx + 2 AS idx FROM seg WHERE idx % 5 = 0)
SELECT m.book, m.idx, coalesce(new_index, total) AS new_index FROM m LEFT JOIN p USING (book, idx) JOIN t USING (book)
""")
def remapped_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers once each segment is several."""
    s = segments(spark, sf_dir)
    m = s.where("idx % 5 = 0").select("book", (F.col("idx") + 2).alias("idx")).distinct()
    return ed.remapped(m, s.select("book", "idx", (F.col("line") % 4).alias("n")), "book", "idx", "n").select("book", "idx", "new_index")


@register("found_lines", "SELECT doc_id FROM documents WHERE contains(lower(text), 'tion the') OR contains(lower(source), 'tion the') OR contains(lower(lang), 'tion the')")
def found_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which a field holds a query, case aside."""
    return ed.matches(table(spark, sf_dir, "documents"), F.lit("Tion THE"), "text", "source", "lang").select("doc_id")


@register("next_marker", SEGMENTS_SQL + """
, p AS (SELECT DISTINCT book, idx FROM seg WHERE idx % 4 = 1), c AS (SELECT o_custkey AS book, o_orderkey AS query, o_orderkey % 40 AS cursor FROM orders)
SELECT c.book, query, cursor, coalesce(min(idx) FILTER (WHERE idx > cursor), min(idx)) AS forth, coalesce(max(idx) FILTER (WHERE idx < cursor), max(idx)) AS back FROM c LEFT JOIN p ON c.book = p.book GROUP BY ALL
""")
def next_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The marker after and before a cursor, around the ends."""
    p = segments(spark, sf_dir).where("idx % 4 = 1")
    c = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book"), F.col("o_orderkey").alias("query"), (F.col("o_orderkey") % 40).alias("cursor"))
    forth = ed.next_around(c, p, "book", "cursor", "idx").withColumnRenamed("found", "forth")
    return forth.join(ed.next_around(c, p, "book", "cursor", "idx", False).withColumnRenamed("found", "back"), ["book", "query", "cursor"])


# ---------------------------------------------------------------- outputs and takes

TAKES_SQL = SEGMENTS_SQL + """
, takes AS (SELECT book, idx, (idx * 13 + book) % 9 - 1 AS errors, CASE WHEN idx % 6 = 5 THEN 'none' WHEN idx % 6 = 4 THEN '' ELSE 'v' || (idx % 3) END AS voice, CASE WHEN book % 2 = 0 THEN 'm1' ELSE 'm' || (idx % 2) END AS model FROM seg WHERE (idx + book) % 5 <> 0)
"""


def _takes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, b = F.col("idx"), F.col("book")
    voice = F.when(i % 6 == 5, "none").when(i % 6 == 4, "").otherwise(F.concat(F.lit("v"), (i % 3).cast("string")))
    model = F.when(b % 2 == 0, "m1").otherwise(F.concat(F.lit("m"), (i % 2).cast("string")))
    return segments(spark, sf_dir).where("(idx + book) % 5 <> 0").select("book", "idx", ((i * 13 + b) % 9 - 1).alias("errors"), voice.alias("voice"), model.alias("model"))


@register("output_ranges", TAKES_SQL + """
, f AS (SELECT seg.book, seg.idx, seg.idx // 10 AS output, t.idx IS NOT NULL AS there FROM seg LEFT JOIN takes t USING (book, idx))
SELECT book, output, min(idx) AS first, max(idx) AS last, count(*) AS n_segments, count(*) FILTER (WHERE there) AS n_exist, count(*) FILTER (WHERE NOT there) AS n_missing FROM f GROUP BY book, output
""")
def output_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments, takes and gaps of each output file."""
    s = segments(spark, sf_dir)
    files = s.groupBy("book", F.floor(F.col("idx") / 10).alias("output")).agg(F.min("idx").alias("first"), F.max("idx").alias("last"))
    return outputs.coverage(s.select("book", "idx"), _takes(spark, sf_dir), files, "book", "idx", "output", "first", "last")


@register("output_stems", TAKES_SQL + """
, f AS (SELECT seg.book, seg.idx // 10 AS output, seg.idx, t.idx IS NOT NULL AS there, model, voice FROM seg LEFT JOIN takes t USING (book, idx)),
v AS (SELECT book, output, voice, count(*) AS n FROM f WHERE voice <> '' AND voice <> 'none' GROUP BY ALL), tv AS (SELECT book, output, voice, row_number() OVER (PARTITION BY book, output ORDER BY n DESC, voice) AS k, count(*) OVER (PARTITION BY book, output) - 1 AS more FROM v),
g AS (SELECT book, output, min(idx) AS a, max(idx) AS b, count(*) FILTER (WHERE NOT there) AS missing, CASE WHEN min(model) = max(model) THEN min(model) ELSE '' END AS model, bool_or(voice = 'none') AS has_none, max(output) OVER (PARTITION BY book) + 1 AS n FROM f GROUP BY book, output)
SELECT g.book, g.output, rtrim('Book_' || g.book || ' ' || CASE WHEN n > 1 THEN '[' || (g.output + 1) || ' of ' || n || '] [' || (a + 1) || '-' || (b + 1) || '] ' ELSE '' END || CASE WHEN missing > 0 THEN '[' || missing || ' missing] ' ELSE '' END
  || CASE WHEN coalesce(model, '') <> '' THEN '[' || model || '] ' ELSE '' END || CASE WHEN tv.voice IS NOT NULL THEN '[' || tv.voice || CASE WHEN more > 0 THEN ' +' || more ELSE '' END || ']' WHEN has_none THEN '[none]' ELSE '' END) AS stem
FROM g LEFT JOIN tv ON g.book = tv.book AND g.output = tv.output AND k = 1
""")
def output_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of output files: which of how many, lines, gaps, model and voices."""
    s = segments(spark, sf_dir)
    files = s.groupBy("book", F.floor(F.col("idx") / 10).alias("output")).agg(F.min("idx").alias("first"), F.max("idx").alias("last"))
    title = F.concat(F.lit("Book "), F.col("book").cast("string"))
    return outputs.stems(s.select("book", "idx"), _takes(spark, sf_dir), files, "book", "idx", "output", "first", "last", title)


@register("voice_tag_mode", TAKES_SQL + """
, v AS (SELECT book, voice, count(*) AS n FROM takes WHERE voice <> '' AND voice <> 'none' GROUP BY ALL), t AS (SELECT book, voice, row_number() OVER (PARTITION BY book ORDER BY n DESC, voice) AS k, count(*) OVER (PARTITION BY book) - 1 AS more FROM v),
b AS (SELECT book, bool_or(voice = 'none') AS has_none FROM takes GROUP BY book)
SELECT b.book, coalesce(t.voice, CASE WHEN has_none THEN 'none' ELSE '' END) AS voice, coalesce(more, 0) AS others FROM b LEFT JOIN t ON b.book = t.book AND k = 1
""")
def voice_tag_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The voice that most takes of a book have; takes without one don't count."""
    return cat.mode_of_tags(_takes(spark, sf_dir), "book", "voice")


@register("generation_filters", TAKES_SQL + """
SELECT book, count(*) AS n_all, count(*) FILTER (WHERE t.idx IS NULL) AS n_ungenerated, count(t.idx) AS n_generated, count(*) FILTER (WHERE errors > 0) AS n_with_errors, count(*) FILTER (WHERE errors = 99 OR errors > 2) AS n_failed FROM seg LEFT JOIN takes t USING (book, idx) GROUP BY book
""")
def generation_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines each filter of a book shows."""
    s = segments(spark, sf_dir).select("book", "idx").join(_takes(spark, sf_dir), ["book", "idx"], "left")
    e = F.col("errors")
    return s.groupBy("book").agg(F.count("*").alias("n_all"), F.count_if(e.isNull()).alias("n_ungenerated"), F.count(e).alias("n_generated"), F.count_if(e > 0).alias("n_with_errors"), F.count_if(cat.score_failed(e, F.lit(2))).alias("n_failed"))


@register("error_counts", """
SELECT idx, errors, n AS n_takes FROM (SELECT l_orderkey AS idx, CAST(l_quantity AS BIGINT) AS errors, count(*) OVER (PARTITION BY l_orderkey) AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS k FROM lineitem) WHERE k = 1
""")
def error_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error count of a line's last take, and its takes."""
    i = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("idx"), F.col("l_quantity").cast("long").alias("errors"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("at"))
    return cat.last_errors(i, "idx", "at", "errors")


@register("generation_sets", TAKES_SQL + """
SELECT seg.book, count(*) FILTER (WHERE seg.idx % 3 = 0 AND t.idx IS NOT NULL) AS n_selected_done, count(*) FILTER (WHERE seg.idx % 3 = 0 AND t.idx IS NULL) AS n_selected_left, count(*) FILTER (WHERE seg.idx % 3 <> 0 AND t.idx IS NOT NULL) AS n_other_done FROM seg LEFT JOIN takes t USING (book, idx) GROUP BY seg.book
""")
def generation_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected lines with and without takes, and takes of other lines."""
    s = segments(spark, sf_dir).select("book", "idx", (F.col("idx") % 3 == 0).alias("selected"))
    return cat.selection_sets(s, _takes(spark, sf_dir), "book", "idx", "selected")


@register("lines_left_as_ranges", TAKES_SQL + """
, d AS (SELECT seg.book, seg.idx FROM seg ANTI JOIN takes USING (book, idx)), g AS (SELECT book, idx, idx - row_number() OVER (PARTITION BY book ORDER BY idx) AS run FROM d), r AS (SELECT book, run, min(idx) AS lo, max(idx) AS hi FROM g GROUP BY ALL)
SELECT book, string_agg((lo + 1) || CASE WHEN hi > lo THEN '-' || (hi + 1) ELSE '' END, ', ' ORDER BY lo) AS ranges FROM r GROUP BY book
""")
def lines_left_as_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected lines less the saved ones, as a range string."""
    left = segments(spark, sf_dir).select("book", "idx").join(_takes(spark, sf_dir), ["book", "idx"], "left_anti")
    return names.compact_ranges(left, "book", "idx")


@register("canonical_ranges", """
WITH d AS (SELECT c_custkey AS key, c_custkey % 5 AS n, c_custkey % 3 AS m FROM customer)
SELECT key, CASE WHEN m = 0 THEN 'none' WHEN n = 0 THEN 'none' WHEN m = 1 OR n = 1 THEN 'all' WHEN n = 2 THEN '2' ELSE '2-' || n END AS ranges FROM d
""")
def canonical_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of lines as range strings, ``all`` and ``none`` by name."""
    n, m = F.col("c_custkey") % 5, F.col("c_custkey") % 3
    sizes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), n.alias("n"))
    every = table(spark, sf_dir, "customer").where(n > 0).select(F.col("c_custkey").alias("key"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("index"), m.alias("m"), n.alias("n"))
    return names.compact_ranges(every.where((F.col("m") == 1) | ((F.col("m") == 2) & ((F.col("index") > 0) | (F.col("n") == 1)))).select("key", "index"), "key", sizes=sizes, size="n")


@register("range_warnings", """
SELECT c_custkey AS key, CASE WHEN c_custkey % 4 = 0 THEN 'Bad value: x' WHEN c_custkey % 4 = 1 THEN 'Bad value: 5-3' WHEN c_custkey % 4 = 2 THEN 'Out of range: 99' ELSE '' END AS warnings FROM customer
""")
def range_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a strict reading of range strings finds wrong."""
    k = F.col("c_custkey")
    value = F.concat(F.lit("1, "), F.when(k % 4 == 0, "x").when(k % 4 == 1, "5-3").when(k % 4 == 2, "99").otherwise("2-3"))
    return table(spark, sf_dir, "customer").select(k.alias("key"), F.array_join(names.range_warnings(value, F.lit(40)), "; ").alias("warnings"))


@register("single_range", """
SELECT c_custkey AS key, CASE c_custkey % 5 WHEN 0 THEN 0 WHEN 1 THEN c_custkey % 7 WHEN 2 THEN c_custkey % 7 WHEN 3 THEN c_custkey % 7 END AS first, CASE c_custkey % 5 WHEN 0 THEN 19 WHEN 1 THEN 19 WHEN 2 THEN 19 WHEN 3 THEN least(c_custkey % 7 + 3, 19) END AS last FROM customer
""")
def single_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One range: all, from a line on, or from one to another; null for anything else."""
    k = F.col("c_custkey")
    a = (k % 7 + 1).cast("string")
    value = F.when(k % 5 == 0, "all").when(k % 5 == 1, F.concat(a, F.lit("-"))).when(k % 5 == 2, a).when(k % 5 == 3, F.concat(a, F.lit("-"), (k % 7 + 4).cast("string"))).otherwise("-3")
    r = names.single_range(value, F.lit(20))
    return table(spark, sf_dir, "customer").select(k.alias("key"), r["first"].cast("long").alias("first"), r["last"].cast("long").alias("last"))


@register("voice_values", "SELECT o_orderkey AS idx, 'voice' || (o_custkey % 3) AS voice, CASE WHEN o_custkey % 3 < 2 THEN 'said ' || (o_custkey % 3) ELSE '' END AS transcript, least(greatest(o_custkey % 5 - 1, 0), 2) AS clamped, o_custkey % 5 - 1 NOT BETWEEN 0 AND 2 AS out_of_range FROM orders")
def voice_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The voice of each line, around its book's three, with its transcript; clamped voice numbers."""
    v = spark.range(1).select(F.posexplode(F.array(*[F.lit(f"voice{k}") for k in range(3)])).alias("pos", "voice")).withColumn("transcript", F.coalesce(F.get(F.array(F.lit("said 0"), F.lit("said 1")), F.col("pos")), F.lit("")))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"), F.col("o_custkey").alias("selection"), (F.col("o_custkey") % 5 - 1).alias("wanted"))
    out = sch.voice_of(o, v, "selection", "pos", 3)
    return out.select("idx", "voice", "transcript", sch.clamped_voice(F.col("wanted"), 3).alias("clamped"), (~F.col("wanted").between(0, 2)).alias("out_of_range"))


@register("single_voice_rounds", "SELECT o_custkey AS key, o_orderkey AS idx, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 4 AS batch FROM orders")
def single_voice_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of four lines in order."""
    return sch.batches(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("idx")), "key", "idx", 4)


@register("priority_order", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'view' THEN 0 ELSE 1 END, event_id) - 1 AS position FROM events")
def priority_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remainders first, then requests, each in order of arrival."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") == "view", 0).otherwise(1).alias("priority"))
    return sch.by_priority(e, "user_id", "priority", "event_id").select("event_id", F.col("position").cast("long").alias("position"))


@register("latest_outputs", """
WITH f AS (SELECT l_suppkey AS dir, 'File ' || l_partkey || CASE WHEN l_linenumber % 5 = 0 THEN ' [debug]' ELSE '' END AS name, l_shipdate AS mtime FROM lineitem),
d AS (SELECT dir, max(mtime) AS mtime FROM f GROUP BY dir), one AS (SELECT dir, min(name) AS name FROM f WHERE NOT contains(name, '[debug]') GROUP BY dir)
SELECT dir, name FROM one JOIN d USING (dir) ORDER BY mtime DESC, dir LIMIT 12
""")
def latest_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first file of each of the twelve folders that changed last (the list's length)."""
    name = F.concat(F.lit("File "), F.col("l_partkey").cast("string"), F.when(F.col("l_linenumber") % 5 == 0, " [debug]").otherwise(""))
    f = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("dir"), name.alias("name"), F.col("l_shipdate").alias("mtime"))
    return outputs.latest(f, "dir", "name", "mtime", 12)


@register("natural_order", """
SELECT s_suppkey AS key, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey % 50, s_suppkey) - 1 AS position FROM supplier
""")
def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names in natural order: numbers by value, case aside."""
    s = table(spark, sf_dir, "supplier").withColumn("name", F.concat(F.when(F.col("s_suppkey") % 2 == 0, "Track ").otherwise("track "), (F.col("s_suppkey") % 50).cast("string"), F.lit(".flac")))
    w = Window.partitionBy("s_nationkey").orderBy(tx.natural_key(F.col("name")), "s_suppkey")
    return s.select(F.col("s_suppkey").alias("key"), (F.row_number().over(w) - 1).cast("long").alias("position"))


@register("realtime_factor", "SELECT user_id, round(least(sum(value) / greatest(sum(value) FILTER (WHERE event_type = 'click'), 0.1), 99.9), 6) AS factor, round(sum(greatest(value - 5, 0)), 6) AS removed, round(sum(value) / 24000, 6) AS buffered FROM events GROUP BY user_id")
def realtime_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds of audio a second, what trimming removed, and what is left in a buffer."""
    return outputs.speed(table(spark, sf_dir, "events").select("user_id", "value", F.when(F.col("event_type") == "click", F.col("value")).alias("elapsed"), F.lit(5.0).alias("trimmed")), "user_id", "value", "elapsed", "trimmed", 24000)


@register("remaining_time", """
SELECT user_id, event_id, round(CASE WHEN count(*) OVER w >= 5 THEN (100 - row_number() OVER (PARTITION BY user_id ORDER BY event_id)) * avg(value) OVER w END, 5) AS seconds_left FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)
""")
def remaining_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of a hundred items times the mean of the last 50 durations, from the fifth on."""
    e = tl.remaining_time(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", "event_id", "value")
    left = 100 - F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return e.select("user_id", "event_id", F.round(left * F.col("mean_seconds"), 5).alias("seconds_left"))


@register("attempt_totals", """
WITH a AS (SELECT l_orderkey AS idx, CAST(l_quantity AS BIGINT) % 6 AS errors, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem), b AS (SELECT *, errors > 2 AS failed, coalesce(min(errors) OVER (PARTITION BY idx ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 999) AS best, coalesce(bool_or(errors <= 2) OVER (PARTITION BY idx ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS done FROM a)
SELECT n AS attempt, count(*) AS n_made, count(*) FILTER (WHERE NOT failed) AS n_passed, count(*) FILTER (WHERE failed) AS n_failed, count(*) FILTER (WHERE n > 1 AND errors < best) AS n_improved FROM b WHERE NOT done AND n <= 4 GROUP BY n
""")
def attempt_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts under a policy of three retries: made, passed, failed, better than all before."""
    from folioforge.operators import alignment

    a = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("idx"), (F.col("l_quantity").cast("long") % 6).alias("errors"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("at"))
    a = cat.attempt_summary(a, "idx", "at", "errors").withColumn("failed", F.col("errors") > 2)
    a = alignment.best_attempts(a, "idx", "at", "errors", "failed", 3)
    return a.groupBy(F.col("attempt").cast("long").alias("attempt")).agg(F.count("*").alias("n_made"), F.count_if(~F.col("failed")).alias("n_passed"), F.count_if("failed").alias("n_failed"), F.count_if("improved").alias("n_improved"))
