"""Queries on books: prompts of each strategy, dialog, chapter ends, word errors, verdicts, alignment, JSON contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioforge.functions import contracts as ct
from folioforge.functions import names
from folioforge.functions import text as tx
from folioforge.operators import alignment as al
from folioforge.operators import catalog as cat
from folioforge.operators import dialog as dg
from folioforge.operators import segmentation as seg
from folioforge.operators import timeline as tl
from folioforge.plans.text_queries import PHRASES_SQL, documents
from folioforge.registry import register, table
from folioforge.sources.shared import written

#: The full chain on phrases of one part: ornaments join the phrase before, a break after a break becomes a paragraph.
CHAIN_SQL = PHRASES_SQL + r"""
, lead AS (SELECT doc_id, lang, s, k, ltrim(t, BLANKS) AS t, n_words, reason FROM phrases), orn AS (
  SELECT *, CASE WHEN reason IN ('p', 'x') AND NOT regexp_matches(t, '[\p{L}\p{N}]') AND row_number() OVER (PARTITION BY doc_id ORDER BY s, k) > 1 THEN 0 ELSE 1 END AS own FROM lead
), isl AS (SELECT *, CAST(sum(own) OVER (PARTITION BY doc_id ORDER BY s, k) AS BIGINT) - 1 AS position FROM orn
), one AS (SELECT doc_id, lang, position, string_agg(t, '' ORDER BY s, k) AS t, arg_min(reason, (s, k)) AS reason FROM isl GROUP BY ALL
), down AS (SELECT *, reason = 'x' AND coalesce(lag(reason) OVER (PARTITION BY doc_id ORDER BY position), '') = 'x' AS again FROM one
), chain AS (SELECT doc_id, lang, position, CASE WHEN again THEN rtrim(t, BLANKS) || chr(10) || chr(10) ELSE t END AS t, CASE WHEN again THEN 'p' ELSE reason END AS reason FROM down)
""".replace("BLANKS", " || ".join(f"chr({ord(c)})" for c in tx._BLANKS))


@register("segmented_phrases", CHAIN_SQL + "SELECT doc_id, position, reason, sha256(t) AS t FROM chain")
def segmented_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every phrase of every document after the full chain (no phrase is long enough to be split)."""
    p = seg.segmented(documents(spark, sf_dir), 1_000_000, language="lang")
    return p.select("doc_id", "position", "reason", F.sha2("text", 256).alias("t"))


GROUPS_SQL = CHAIN_SQL + """
, c AS (SELECT *, coalesce(sum(CASE WHEN reason IN (CLOSERS) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM chain)
SELECT doc_id, CAST(g AS BIGINT) AS group_index, sha256(string_agg(t, '' ORDER BY position)) AS t, count(*) AS n_phrases FROM c GROUP BY doc_id, g
"""


def _digested(spark: SparkSession, sf_dir: str, strategy: str, max_words: int) -> DataFrame:
    g = seg.grouped(seg.phrase_arrays(documents(spark, sf_dir), max_words, language="lang"), strategy, max_words)
    g = g.select("doc_id", F.posexplode_outer("groups").alias("group_index", "phrases")).where("group_index is not null")
    return g.select("doc_id", F.col("group_index").cast("long").alias("group_index"), F.sha2(seg.group_text(F.col("phrases")), 256).alias("t"), F.size("phrases").cast("long").alias("n_phrases"))


@register("sentence_groups", GROUPS_SQL.replace("CLOSERS", "'s', 'p', 'x'"))
def sentence_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of one sentence (none is too long here)."""
    return _digested(spark, sf_dir, "sentence", 1_000_000)


@register("paragraph_groups", GROUPS_SQL.replace("CLOSERS", "'p', 'x'"))
def paragraph_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of one paragraph (none is too long here)."""
    return _digested(spark, sf_dir, "max_len", 1_000_000)


def _merged_groups_sql(short: int, most: int) -> str:
    """Long phrases split, groups by sentence, short ones merged back and then forth, and split again: a recursion for each fold."""
    parts = """
, worded AS (SELECT *, regexp_extract_all(t, '[^BLANK]+[BLANK]*') AS ws, greatest(CAST(ceil(n_words / MOST.0) AS BIGINT), 1) AS m FROM phrases), strides AS (SELECT *, greatest(CAST(ceil(n_words / CAST(m AS DOUBLE)) AS BIGINT), 1) AS stride, unnest(range(m)) AS part FROM worded),
parts AS (SELECT doc_id, lang, s, k * 100000 + part AS k, array_to_string(ws[part * stride + 1:part * stride + stride], '') AS t, n_words, CASE WHEN part < m - 1 THEN 'w' ELSE reason END AS reason FROM strides), lead AS ("""
    chain = CHAIN_SQL.replace("WITH clean", "WITH RECURSIVE clean", 1).replace("\n, lead AS (", parts, 1).replace("n_words, reason FROM phrases)", "n_words, reason FROM parts)", 1)
    return (chain + """
, x AS MATERIALIZED (SELECT doc_id, position, t, CASE reason WHEN 'w' THEN 1 WHEN 'isqe' THEN 2 WHEN 'is' THEN 3 WHEN 's' THEN 4 WHEN 'p' THEN 5 WHEN 'x' THEN 6 ELSE 7 END AS lv, len(regexp_extract_all(t, '[^BLANK]+')) AS n FROM chain),
y AS (SELECT *, coalesce(sum(CASE WHEN lv >= 4 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM x),
a AS MATERIALIZED (SELECT doc_id, g, count(*) AS c, sum(n) AS w, arg_max(lv, position) AS lv FROM y GROUP BY doc_id, g),
back(doc_id, g, b, w, lv) AS (
  SELECT doc_id, g, 0, w, lv FROM a WHERE g = 0 UNION ALL
  SELECT a.doc_id, a.g, CASE WHEN a.c = 1 AND a.w <= SHORT AND k.lv < 5 AND k.w + a.w <= MOST THEN b ELSE b + 1 END, CASE WHEN a.c = 1 AND a.w <= SHORT AND k.lv < 5 AND k.w + a.w <= MOST THEN k.w + a.w ELSE a.w END, a.lv FROM back k JOIN a ON a.doc_id = k.doc_id AND a.g = k.g + 1
), b AS MATERIALIZED (SELECT doc_id, b, c, w, lv, lead(w) OVER (PARTITION BY doc_id ORDER BY b) AS after FROM (SELECT k.doc_id, b, sum(a.c) AS c, sum(a.w) AS w, arg_max(a.lv, a.g) AS lv FROM back k JOIN a ON a.doc_id = k.doc_id AND a.g = k.g GROUP BY k.doc_id, b)),
forth(doc_id, b, o, c, w, on_) AS (
  SELECT doc_id, b, 0, c, w, coalesce(c = 1 AND w <= SHORT AND lv <= 4 AND after + w <= MOST, false) FROM b WHERE b = 0 UNION ALL
  SELECT doc_id, b, o, c, w, coalesce(c = 1 AND w <= SHORT AND lv <= 4 AND after + w <= MOST, false) FROM (SELECT b.doc_id, b.b, CASE WHEN on_ THEN o ELSE o + 1 END AS o, CASE WHEN on_ THEN f.c + b.c ELSE b.c END AS c, CASE WHEN on_ THEN f.w + b.w ELSE b.w END AS w, b.lv, b.after FROM forth f JOIN b ON b.doc_id = f.doc_id AND b.b = f.b + 1)
), z AS MATERIALIZED (SELECT y.doc_id, y.position, y.t, y.n, f.o FROM y JOIN back k ON k.doc_id = y.doc_id AND k.g = y.g JOIN forth f ON f.doc_id = k.doc_id AND f.b = k.b),
cut(doc_id, position, o, cur, group_index) AS (
  SELECT doc_id, position, o, n, 0 FROM z WHERE position = 0 UNION ALL
  SELECT z.doc_id, z.position, z.o, CASE WHEN z.o <> c.o OR cur + n > MOST THEN n ELSE cur + n END, CASE WHEN z.o <> c.o OR cur + n > MOST THEN group_index + 1 ELSE group_index END FROM cut c JOIN z ON z.doc_id = c.doc_id AND z.position = c.position + 1
)
SELECT z.doc_id, CAST(group_index AS BIGINT) AS group_index, sha256(string_agg(t, '' ORDER BY z.position)) AS t, count(*) AS n_phrases FROM z JOIN cut ON cut.doc_id = z.doc_id AND cut.position = z.position GROUP BY z.doc_id, group_index
""").replace("BLANK", tx.SPACE).replace("SHORT", str(short)).replace("MOST", str(most))


@register("normal_groups", _merged_groups_sql(2, 40))
def normal_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of the normal strategy, 40 words at most."""
    return _digested(spark, sf_dir, "normal", 40)


@register("multi_sentence_groups", _merged_groups_sql(9999, 40))
def multi_sentence_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of several sentences, 40 words at most."""
    return _digested(spark, sf_dir, "multi", 40)


#: Two of three sentences, with what stands between them, in quotes.
_IN_QUOTES = r'(\p{Lu}[^“”"\n.!?]*[.!?] \p{Lu}[^“”"\n.!?]*[.!?])( \p{Lu}[^“”"\n.!?]*[.!?])'


@register("quoted_sentences", PHRASES_SQL.replace("FROM documents", rf"FROM (SELECT doc_id, lang, regexp_replace(text, '{_IN_QUOTES}', CASE WHEN doc_id % 2 = 0 THEN '“\1”\2' ELSE chr(34) || '\1' || chr(34) || chr(10) || '\2' END, 'g') AS text FROM documents)") + "SELECT doc_id, s, sha256(t) AS t FROM sentence")
def quoted_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of documents put in quotes: beside others they stay whole, on a line of their own they are told apart."""
    quoted = _IN_QUOTES.replace(r'[^“”"\n.!?]*', r'[ a-z[^“”"\n.!?]]*+')
    text = F.when(F.col("doc_id") % 2 == 0, F.regexp_replace("text", quoted, "“$1”$2")).otherwise(F.regexp_replace("text", quoted, '"$1"\n$2'))
    d = seg.sentence_rows(documents(spark, sf_dir).where("text <> ''"), text, F.col("lang"), ["doc_id"])
    return d.select("doc_id", F.col("sentence_index").cast("long").alias("s"), F.sha2("sentence", 256).alias("t"))


@register("dialog_groups")
def dialog_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts cut at dialog, every third sentence of a document put in quotes (held against brute force)."""
    d = documents(spark, sf_dir).select("doc_id", "lang", F.regexp_replace("text", r"(\p{Lu}[^.!?\n]*)([.!?]) (?=\p{Lu}\p{Ll}+ )", "“$1,” $2").alias("text"))
    out = dg.dialog_arrays(seg.grouped(seg.phrase_arrays(d, 40, language="lang", keep=["lang"]), "normal", 40))
    return out.select("doc_id", F.col("group_index").cast("long").alias("group_index"), F.col("part_index").cast("long").alias("part_index"), F.sha2("text", 256).alias("text"), "reason", "voice")


@register("chapter_ends", CHAIN_SQL + """
, d AS (SELECT doc_id, position, CASE WHEN position < 2 AND doc_id % 2 = 0 THEN 'x' ELSE reason END AS reason FROM chain), w AS (SELECT *, min(CASE WHEN reason = 'x' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY position) AS run, max(position) OVER (PARTITION BY doc_id) AS last FROM d)
SELECT doc_id, position, CASE WHEN position = last THEN 'xx' WHEN run = 1 THEN 'p' ELSE reason END AS reason FROM w
""")
def chapter_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chapters: the last phrase ends them, leading breaks become paragraphs (half of them have such)."""
    p = seg.segmented(documents(spark, sf_dir), 1_000_000, language="lang").select("doc_id", "position", F.when((F.col("position") < 2) & (F.col("doc_id") % 2 == 0), "x").otherwise(F.col("reason")).alias("reason"))
    return seg.end_chapters(p, "doc_id", "position", "reason")


@register("presentable_groups", CHAIN_SQL + """
, g AS (SELECT doc_id, position // 3 AS g, string_agg(t, ' ' ORDER BY position) || ' ' AS t, arg_max(reason, position) AS reason, max(len(regexp_extract_all(t, '[^BLANK]+'))) AS most FROM chain GROUP BY 1, 2)
SELECT doc_id, g, trim(regexp_replace(t, '[BLANK]+', ' ', 'g')) AS t, reason, most FROM g
""".replace("BLANK", tx.SPACE))
def presentable_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of three phrases as one line, with the last reason and the words of the longest phrase."""
    p = seg.segmented(documents(spark, sf_dir), 1_000_000, language="lang")
    g = p.groupBy("doc_id", F.floor(F.col("position") / 3).alias("g")).agg(F.array_sort(F.collect_list(F.struct("position", "text", "reason", "n_words"))).alias("p"))
    text = F.concat(F.array_join(F.transform("p", lambda x: x["text"]), " "), F.lit(" "))
    return g.select("doc_id", "g", tx.collapse_space(text).alias("t"), F.element_at("p", -1)["reason"].alias("reason"), F.array_max(F.transform("p", lambda x: x["n_words"])).cast("long").alias("most"))


@register("pause_totals", CHAIN_SQL + """
SELECT doc_id, CAST(sum(CASE reason WHEN 'w' THEN 0.1 WHEN 'is' THEN 0.5 WHEN 's' THEN 0.9 WHEN 'p' THEN 1.2 ELSE 2.0 END) AS DOUBLE) AS usual, CAST(sum(CASE reason WHEN 'w' THEN 0.1 WHEN 'is' THEN 0.3 WHEN 's' THEN 0.6 WHEN 'p' THEN 0.9 ELSE 1.5 END) AS DOUBLE) AS short FROM chain GROUP BY doc_id
""")
def pause_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds of pause in a told text, by each of the two policies."""
    p = seg.segmented(documents(spark, sf_dir), 1_000_000, language="lang")
    return p.groupBy("doc_id").agg(F.round(F.sum(tl.pause_of(F.col("reason"))), 3).alias("usual"), F.round(F.sum(tl.pause_of(F.col("reason"), tl.SHORT_PAUSES)), 3).alias("short"))


# ---------------------------------------------------------------- word errors


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, line, source): sentences of documents as they are compared."""
    s = seg.sentence_rows(documents(spark, sf_dir).where("text <> ''"), F.col("text"), F.col("lang"), ["doc_id", "lang"])
    return s.select("doc_id", "lang", F.col("sentence_index").alias("line"), tx.settled(tx.collapse_space(tx.light_form(F.col("sentence")))).alias("source")).where("source <> ''")


def _heard(s: DataFrame) -> DataFrame:
    """Adds the transcript, in which each seventh word is missing, each eleventh doubled and each thirteenth another."""
    words = F.transform(F.split("source", " "), lambda w, i: F.when(i % 7 == 6, "").when(i % 11 == 10, F.concat(w, F.lit(" "), w)).when(i % 13 == 12, F.lit("other")).otherwise(w))
    return s.withColumn("transcript", F.array_join(F.filter(words, lambda w: w != ""), " "))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences as sources, and their transcripts."""
    return _heard(_sources(spark, sf_dir))


@register("word_error_codes")
def word_error_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word errors of every sentence, and whether they fail it (dynamic program; held against brute force)."""
    p = _pairs(spark, sf_dir).withColumn("steps", al.word_alignment(F.col("source"), F.col("transcript")))
    e = al.word_errors(F.col("steps"))
    n = F.size(F.split("source", " "))
    out = p.select("doc_id", "line", F.array_join(e, " ").alias("codes"), F.size(e).alias("n_errors"), n.alias("n_words"), F.sha2(al.rendered(F.col("steps")), 256).alias("shown"))
    return out.withColumn("failed", F.col("n_errors") > cat.threshold(F.col("n_words"), F.lit("moderate")))


@register("word_error_totals")
def word_error_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word errors of each document, where words that the lexicon lacks stand for any one or two."""
    # the sentences are needed three times: made once; the transcripts follow after the join, which need not carry them
    p = written(_sources(spark, sf_dir), "sentences").withColumn("key", F.struct("doc_id", "line"))
    words = p.select("lang", "doc_id", F.explode(F.split("source", " ")).alias("word")).distinct()
    lexicon = words.groupBy("word").agg(F.count("*").alias("n")).where("n >= 5")
    p = _heard(al.uncommon_words(p, "key", "source", lexicon))
    p = p.withColumn("n", al.error_count(F.col("source"), F.col("transcript"), "", F.col("uncommon")))
    return p.groupBy("doc_id").agg(F.sum("n").alias("n_errors"), F.count("*").alias("n_lines"))


@register("validation_verdict", """
WITH e AS (SELECT event_id, event_id % 5 AS errors, event_id % 17 AS words, event_type = 'error' AS music, value > 1.5 + 0.75 * (event_id % 17) AND event_id % 4 <> 0 AS too_long, event_id % 6 = 0 AS truncated, (event_id % 30) / 100.0 AS trimmed FROM events),
f AS (SELECT *, errors + CAST(truncated AS INT) > ceil(words / 10.0) AS failed FROM e)
SELECT event_id, CASE WHEN music THEN 'music' WHEN NOT failed AND too_long THEN 'too_long' WHEN NOT truncated AND trimmed > 0.1 THEN 'trimmed' WHEN failed THEN 'failed' ELSE 'passed' END AS verdict, CASE WHEN music THEN 99 ELSE errors + CAST(truncated AS INT) END AS score FROM f
""")
def validation_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on clips in their precedence, and the score for the file's name."""
    i = F.col("event_id")
    words = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: F.when((k == 2) & (i % 4 == 0), "a123").otherwise("a12"))
    too_long = cat.too_long(F.col("value"), i % 17, cat.has_long_number(words))
    music, truncated = F.col("event_type") == "error", i % 6 == 0
    e = table(spark, sf_dir, "events")
    return e.select("event_id", al.verdict(i % 5, i % 17, F.lit("moderate"), music, too_long, truncated, (i % 30) / 100).alias("verdict"), al.effective_errors(i % 5, truncated, music).alias("score"))


@register("clip_report", """
WITH e AS (SELECT user_id, event_id % 5 > ceil((event_id % 17) / 10.0) AS failed, event_type = 'view' AS skipped FROM events)
SELECT user_id, count(*) FILTER (WHERE skipped) AS n_skipped, count(*) FILTER (WHERE NOT skipped AND failed) AS n_failed, count(*) FILTER (WHERE NOT skipped AND NOT failed) AS n_passed FROM e GROUP BY user_id
""")
def clip_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips of a folder that pass, fail or have no transcript."""
    i, skipped = F.col("event_id"), F.col("event_type") == "view"
    failed = cat.failed(i % 5, i % 17, F.lit("moderate"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(skipped).alias("n_skipped"), F.count_if(~skipped & failed).alias("n_failed"), F.count_if(~skipped & ~failed).alias("n_passed"))


@register("semantic_trims", PHRASES_SQL + r"""
, w AS (SELECT doc_id, s AS line, string_split(trim(regexp_replace(regexp_replace(lower(t), '[^\p{L}\p{N}_BLANK]', '', 'g'), '[BLANK]+', ' ', 'g')), ' ') AS src FROM sentence),
h AS (SELECT doc_id, line, src, list_concat(list_concat(['well', 'so'], src), ['uh', 'ok']) AS heard FROM w WHERE src <> ['']),
f AS (SELECT doc_id, line, len(src) AS n, len(heard) AS m, list_filter(range(len(heard) - len(src) + 1), lambda i: heard[i + 1:i + len(src)] = src)[1] AS i FROM h)
SELECT doc_id, line, CAST(CASE WHEN i > 0 THEN i * 0.5 - 0.05 ELSE 0 END AS DOUBLE) AS start, CAST(CASE WHEN i + n >= m THEN m * 0.5 ELSE (i + n) * 0.5 - 0.05 END AS DOUBLE) AS "end" FROM f
""".replace("BLANK", tx.SPACE))
def semantic_trims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where clips that say more than their line are cut: two words too many before and after."""
    s = _pairs(spark, sf_dir)
    heard = F.concat(F.array(F.lit("well"), F.lit("so")), F.split("source", " "), F.array(F.lit("uh"), F.lit("ok")))
    words = F.transform(heard, lambda w, i: F.struct(w.alias("word"), (i * 0.5).alias("start"), (i * 0.5 + 0.4).alias("end")))
    w = s.select("doc_id", "line", "source", tx.settled(words).alias("words"))
    t = w.select("doc_id", "line", tx.settled(al.semantic_trim(F.col("words"), F.col("source"), F.size("words") * 0.5)).alias("t"))
    return t.select("doc_id", "line", F.round("t.start", 3).alias("start"), F.round("t.end", 3).alias("end"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").where("text <> ''").select(F.col("item_id").alias("doc_id"), "text")


@register("forced_alignment")
def forced_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of the phrases of each item's sentences within their clip (dynamic program; held against brute force)."""
    p = seg.phrases(_items(spark, sf_dir))
    s = p.groupBy("doc_id", "sentence_index").agg(F.array_sort(F.collect_list(F.struct("phrase_index", "text"))).alias("p"))
    s = s.select("doc_id", "sentence_index", F.transform("p", lambda x: tx.collapse_space(tx.light_form(x["text"]))).alias("phrases"))
    heard = F.filter(F.split(F.array_join("phrases", " "), " "), lambda w: w != "")
    words = F.transform(heard, lambda w, i: F.struct(w.alias("word"), (i * 0.5).alias("start"), (i * 0.5 + 0.4).alias("end")))
    s = s.select("doc_id", "sentence_index", F.posexplode(al.timed_phrases(F.col("phrases"), words, F.size(heard) * 0.5)).alias("phrase_index", "t"))
    return s.select("doc_id", "sentence_index", "phrase_index", "t.start", "t.end")


@register("transcript_alignment")
def transcript_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of an item's sentences in a transcript of it that begins late and lacks each ninth word (held against literal cases)."""
    s = seg.sentences(F.col("text"))
    d = _items(spark, sf_dir).select("doc_id", F.transform(s, lambda x: tx.collapse_space(tx.light_form(x))).alias("phrases"))
    heard = F.filter(F.split(F.array_join("phrases", " "), " "), lambda w, i: (w != "") & (i % 9 != 8))
    words = F.transform(heard, lambda w, i: F.struct(w.alias("word"), (3 + i * 0.5).alias("start"), (3 + i * 0.5 + 0.4).alias("end")))
    books = d.select("doc_id", F.array("phrases").alias("sections"), words.alias("words"))
    out = al.follow_transcript(books, "doc_id", "sections", "words").select("doc_id", F.posexplode("times").alias("line", "t"))
    return out.select("doc_id", "line", "t.start", "t.end")


@register("stitched_transcripts", """
WITH w AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events) SELECT user_id, count(*) AS n_words, CAST(max(i) AS DOUBLE) AS last_start FROM w GROUP BY user_id
""")
def stitched_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts of chunks of 30 words that overlap by five, as one again."""
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    e = table(spark, sf_dir, "events").select("user_id", i.alias("i"))
    sizes = e.groupBy("user_id").agg(F.count("*").alias("n"))
    chunks = al.overlapping_chunks(sizes, "n", 30, 5)
    w = e.withColumn("chunk", F.explode(F.sequence(F.greatest(F.floor((F.col("i") - 30) / 25).cast("int") + 1, F.lit(0)), F.floor(F.col("i") / 25).cast("int")))).join(chunks, ["user_id", "chunk"]).where("i >= start and i < stop")
    word = F.struct(F.col("i").cast("string").alias("word"), F.col("i").cast("double").alias("start"), (F.col("i") + 0.9).cast("double").alias("end"))
    c = w.groupBy("user_id", "chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", word.alias("w")))), lambda x: x["w"]).alias("words"))
    return al.stitched(c, "user_id", "chunk", "words").select("user_id", F.size("words").cast("long").alias("n_words"), F.array_max(F.transform("words", lambda x: x["start"])).alias("last_start"))


@register("chunk_windows", """
WITH s AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id), c AS (SELECT user_id, n, unnest(range(greatest(CAST(ceil((n - 5) / 25.0) AS BIGINT), 1))) AS chunk FROM s) SELECT user_id, n, chunk, chunk * 25 AS start, least(chunk * 25 + 30, n) AS stop FROM c
""")
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings in chunks of 30 that overlap by five."""
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return al.overlapping_chunks(s, "n", 30, 5)


# ---------------------------------------------------------------- contracts


def _metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of players, one in seven sound, the others each with a fault of its own."""
    k = F.col("c_custkey")
    fault = k % 7
    segments = F.transform(F.sequence(F.lit(0), k % 4 + 1), lambda i: F.struct(F.concat(F.lit("t"), i.cast("string")).alias("text"), (i * 1.5).alias("time_start"), (i * 1.5 + 1).alias("time_end")))
    body = F.to_json(F.struct(
        F.lit("Book").alias("title"), F.when(fault == 3, 0).otherwise(k % 3 + 1).alias("version"), F.when(fault != 2, segments).alias("text_segments"), F.array(k % 5, F.lit(1).cast("long"), k % 5).alias("bookmarks"),
        F.array(F.struct(F.lit("a").alias("title"), F.lit(0).cast("long").alias("start_index"), (k % 3 + 1).alias("end_index")), F.struct(F.lit("b").alias("title"), F.lit(2).cast("long").alias("start_index"), F.when(fault == 4, 1).otherwise(9).cast("long").alias("end_index"))).alias("sections"),
    ))
    body = F.when(fault == 1, F.rtrim(body, F.lit("}"))).when(fault == 5, F.concat(F.lit("["), body, F.lit("]"))).when(fault == 6, F.replace(body, F.lit('"bookmarks":['), F.lit('"bookmarks":["x",'))).otherwise(body)
    return table(spark, sf_dir, "customer").select("c_custkey", F.try_parse_json(body).alias("v"))


@register("metadata_strict", """
SELECT c_custkey, CASE c_custkey % 7 WHEN 1 THEN 'json' WHEN 2 THEN 'segments missing' WHEN 3 THEN 'version' WHEN 4 THEN 'section' WHEN 5 THEN 'root' WHEN 6 THEN 'bookmark' END AS error, CASE WHEN c_custkey % 7 = 0 THEN c_custkey % 4 + 2 END AS n_segments,
  CASE WHEN c_custkey % 7 = 0 THEN CASE WHEN c_custkey % 5 = 1 THEN '[1]' WHEN c_custkey % 5 < 1 THEN '[0,1]' ELSE '[1,' || (c_custkey % 5) || ']' END END AS bookmarks FROM customer
""")
def metadata_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata by the strict reader: the first fault, or what is written again."""
    m = _metadata(spark, sf_dir).select("c_custkey", ct.metadata_error(F.col("v")).alias("error"), ct.metadata(F.col("v")).alias("m"))
    return m.select("c_custkey", "error", F.when(F.col("m").isNotNull(), F.size("m.segments")).cast("long").alias("n_segments"), F.get_json_object(ct.metadata_json(F.col("m")), "$.bookmarks").alias("bookmarks"))


@register("metadata_lenient", """
SELECT c_custkey, CASE WHEN c_custkey % 7 NOT IN (1, 2, 5) THEN c_custkey % 4 + 2 END AS n_segments, CASE WHEN c_custkey % 7 NOT IN (1, 2, 5) THEN CASE WHEN c_custkey % 3 + 1 <= c_custkey % 4 + 2 THEN 1 ELSE 0 END END AS n_sections,
  CASE WHEN c_custkey % 7 NOT IN (1, 2, 5) THEN 3 END AS n_bookmarks, CASE WHEN c_custkey % 7 = 3 THEN 1 WHEN c_custkey % 7 NOT IN (1, 2, 5) THEN c_custkey % 3 + 1 END AS version FROM customer
""")
def metadata_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata by the lenient reader, which leaves out what is wrong."""
    m = _metadata(spark, sf_dir).select("c_custkey", ct.metadata(F.col("v"), False).alias("m"))
    n = lambda c: F.when(F.col("m").isNotNull(), F.size(c)).cast("long")
    return m.select("c_custkey", n("m.segments").alias("n_segments"), n("m.sections").alias("n_sections"), n("m.bookmarks").alias("n_bookmarks"), "m.version")


def _groups(key: str, n: str) -> F.Column:
    return F.transform(F.sequence(F.lit(1), F.col(n)), lambda i: F.array(F.struct(F.concat(F.col(key).cast("string"), F.lit("-"), i.cast("string")).alias("text"), F.lit("p").alias("reason"))))


@register("book_formats", """
WITH n AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1)
SELECT k, CASE k % 6 WHEN 4 THEN 'group empty' WHEN 5 THEN 'format' END AS error, CASE WHEN k % 6 < 4 THEN CASE WHEN k % 6 < 2 THEN 'Told' ELSE '' END END AS title, CASE WHEN k % 6 < 4 THEN CASE WHEN k % 6 < 2 THEN 'epub' ELSE 'legacy_flat' END END AS kind, CASE WHEN k % 6 < 4 THEN n END AS n_groups, CASE WHEN k % 6 < 4 THEN 'book.v2' END AS format FROM n
""")
def book_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of projects in four formats, read and written again in the present one."""
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"))
    kind, g = F.col("k") % 6, _groups("k", "n")
    new = F.to_json(F.struct(F.when(kind == 0, "book.v2").otherwise("book.v1").alias("format"), F.struct(F.lit("Told").alias("title"), F.lit("epub").alias("text_source_kind"), F.array(F.struct(F.lit("s").alias("title"), g.alias("phrase_groups"))).alias("sections")).alias("book")))
    flat, wrapped = F.to_json(g), F.to_json(F.struct(F.lit("phrase_groups.v1").alias("format"), g.alias("phrase_groups")))
    body = F.when(kind < 2, new).when(kind == 2, flat).when(kind == 3, wrapped).when(kind == 4, F.replace(wrapped, F.lit("]]}"), F.lit("],[]]}"))).otherwise(F.lit('{"format":"other"}'))
    b = n.select("k", F.try_parse_json(body).alias("v")).select("k", ct.book_error(F.col("v")).alias("error"), ct.book(F.col("v")).alias("b"))
    return b.select("k", "error", "b.title", F.col("b.text_source_kind").alias("kind"), F.when(F.col("b").isNotNull(), F.size(F.col("b.sections")[0]["phrase_groups"])).cast("long").alias("n_groups"), F.get_json_object(ct.book_json(F.col("b")), "$.format").alias("format"))


@register("sidecar_upgrade", """
SELECT event_id, CASE event_id % 5 WHEN 3 THEN 'type' WHEN 4 THEN 'transcript_errors' END AS error, CASE event_id % 5 WHEN 0 THEN 'd:b' WHEN 1 THEN 's:b/x' WHEN 2 THEN 's:b/x' END AS errors, CASE event_id % 5 WHEN 2 THEN 'music_detected' END AS invalid FROM events
""")
def sidecar_upgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sidecars of two versions: findings as they are, or word errors counted again; an unknown exception is music."""
    i = F.col("event_id") % 5
    common = '"language_code":"de","index_1b":3,"source":"a b","prompt":"a b","transcript":"a x","normalized_source":"a b","normalized_transcript":"a x","timed_phrases":[{"text":"a b","time_start":0,"time_end":1}],"transcript_words":[]'
    body = F.concat(F.lit("{" + common + ',"version":'), F.when(i == 0, '3,"type":"segment_stt_info","findings":{"transcript_errors":["d:b"],"possible_truncation":false,"invalid_reason":null}}').when(i == 1, '2,"type":"segment_stt_info"}')
                    .when(i == 2, '2,"type":"segment_stt_info","exception":"odd"}').when(i == 3, '2,"type":"x"}').otherwise('3,"type":"segment_stt_info","findings":{"transcript_errors":[1]}}'))
    s = table(spark, sf_dir, "events").select("event_id", F.try_parse_json(body).alias("v"))
    again = al.word_errors(al.word_alignment(ct.get(F.col("v"), "$.normalized_source", "string"), ct.get(F.col("v"), "$.normalized_transcript", "string")))
    s = s.select("event_id", ct.sidecar_error(F.col("v")).alias("error"), ct.sidecar_findings(F.col("v"), again).alias("f"))
    good = F.col("error").isNull()
    return s.select("event_id", "error", F.when(good, F.array_join("f.transcript_errors", " ")).alias("errors"), F.when(good, F.col("f.invalid_reason")).alias("invalid"))


@register("sidecar_round_trip", "SELECT event_id, 3 AS version, event_id + 1 AS index_1b, CAST(NULL AS VARCHAR) AS error, event_type AS source FROM events")
def sidecar_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sidecars written and read back."""
    t = F.col("event_type")
    findings = F.struct(F.array(F.lit("d:x")).alias("transcript_errors"), F.lit(False).alias("possible_truncation"), F.lit(None).cast("string").alias("invalid_reason"))
    phrases = F.array(F.struct(t.alias("text"), F.lit(0.0).alias("time_start"), F.col("value").alias("time_end")))
    words = F.array(F.struct(t.alias("word"), F.lit(0.0).alias("start"), F.col("value").alias("end")))
    v = table(spark, sf_dir, "events").select("event_id", F.try_parse_json(ct.sidecar_json(F.lit("en"), F.col("event_id"), t, t, t, t, findings, phrases, words)).alias("v"))
    return v.select("event_id", ct.get(F.col("v"), "$.version", "int").alias("version"), ct.get(F.col("v"), "$.index_1b", "bigint").alias("index_1b"), ct.sidecar_error(F.col("v")).alias("error"), ct.get(F.col("v"), "$.source", "string").alias("source"))


@register("token_streams", "SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations")
def token_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as lines of two shapes of token streams, put together again."""
    w = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    part = lambda x, i: F.when(F.lit(True), F.concat(F.lit("data: "), F.when(i % 2 == 0, F.to_json(F.struct(F.array(F.struct(F.struct(x.alias("content")).alias("delta"))).alias("choices")))).otherwise(F.to_json(F.struct(F.lit("content_block_delta").alias("type"), F.struct(F.lit("text_delta").alias("type"), x.alias("text")).alias("delta"))))))
    lines = F.concat(F.array(F.lit(": hello"), F.lit("")), F.transform(F.split("text", r"(?<= )"), part), F.array(F.lit("data: [DONE]")))
    d = w.select("conv_id", "turn", F.transform(lines, ct.sse_delta).alias("d"))
    return d.select("conv_id", "turn", F.array_join(F.array_compact("d"), "").alias("text"))


@register("current_takes", """
WITH l AS (SELECT l_orderkey AS idx, l_linenumber AS line, md5(CAST(l_orderkey + CASE WHEN l_linenumber % 3 = 0 THEN 1 ELSE 0 END AS VARCHAR)) AS digest FROM lineitem) SELECT idx, line, digest FROM l WHERE digest = md5(CAST(idx AS VARCHAR))
""")
def current_takes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Takes whose digest is that of their line's present text."""
    stale = F.when(F.col("l_linenumber") % 3 == 0, 1).otherwise(0)
    t = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("idx"), F.col("l_linenumber").alias("line"), F.md5((F.col("l_orderkey") + stale).cast("string")).alias("digest"))
    lines = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"), F.md5(F.col("o_orderkey").cast("string")).alias("digest"))
    return cat.current_takes(t, lines, "idx", "digest").select("idx", "line", "digest")


@register("content_hashes")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests in the names of takes (XXH3, which SQL lacks; held against the library)."""
    return documents(spark, sf_dir).select("doc_id", names.content_hash(F.col("doc_id"), F.coalesce("text", F.lit(""))).alias("digest"))


@register("text_identities", """
SELECT c_custkey, format('{:x}', list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(c_name, ''), lambda x: CAST(unicode(x) AS BIGINT))), lambda h, u: xor(h, u) * 16777619 % 4294967296)) AS identity FROM customer
""")
def text_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FNV-1a identities of names."""
    return table(spark, sf_dir, "customer").select("c_custkey", ct.fnv1a(F.col("c_name")).alias("identity"))


@register("settings_with_defaults", """
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 40 ELSE least(greatest(c_custkey % 200, 20), 80) END AS max_words, CASE WHEN c_custkey % 4 = 0 THEN 'multi' WHEN c_custkey % 4 = 1 THEN 'sentence' ELSE 'normal' END AS strategy FROM customer
""")
def settings_with_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings from JSON with old names, defaults and limits."""
    k = F.col("c_custkey")
    body = F.concat(F.lit("{"), F.when(k % 3 != 0, F.concat(F.lit('"max_words": '), (k % 200).cast("string"), F.lit(","))).otherwise(""), F.when(k % 4 == 0, '"strategy":"multi","segmentation":"sentence"').when(k % 4 == 1, '"segmentation":"sentence"').otherwise('"strategy":"odd"'), F.lit("}"))
    s = table(spark, sf_dir, "customer").select("c_custkey", F.try_parse_json(body).alias("v"))
    words = ct.clamped(ct.renamed(F.col("v"), "max_words", "max_words_per_segment"), 20, 80, 40)
    return s.select("c_custkey", words.alias("max_words"), ct.one_of(ct.renamed(F.col("v"), "strategy", "segmentation"), list(seg.STRATEGIES), "normal").alias("strategy"))
