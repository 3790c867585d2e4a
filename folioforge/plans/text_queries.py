"""Queries on texts: phrases with boundary reasons, groups, words, normal forms, lexicons, pages, conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioforge.functions import text as tx
from folioforge.operators import pages as pg
from folioforge.operators import segmentation as seg
from folioforge.registry import register, spread, table

#: Inside a character class: white space, and punctuation as SQL text.
WS = tx.SPACE
PUNC = tx.regex_class(tx.PUNCTUATION).replace("'", "''")

def _ends_sql(column: str) -> str:
    """SQL for the cuts that abbreviations, initials and small letters take back."""
    # an initial takes the sign before it, so of two in a row the second is found in a second pass
    once = lambda x, c: rf"regexp_replace({c}, '((?:^|[^\p{{L}}])(?:{'|'.join(seg.ABBREVIATIONS[x])}|\p{{Lu}})\.[ \t]+)' || chr(1), '\1', 'g')"
    kept = lambda x: once(x, once(x, column))
    cases = " ".join(f"WHEN '{x}' THEN {kept(x)}" for x in seg.ABBREVIATIONS if x != "en")
    return rf"regexp_replace(CASE lang {cases} ELSE {kept('en')} END, '([.…][\"”’)]*[ \t]+)' || chr(1) || '(\p{{Ll}})', '\1\2', 'g')"


#: SQL for the phrases of every document: cleaned, breaks in quotes held back, marked, split; pieces of white space and
#: punctuation join the piece before; sentences that quotes hold are split once more.
PHRASES_SQL = r"""
WITH clean AS (
  SELECT doc_id, lang, regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+\n', chr(10), 'g') AS t FROM documents WHERE text <> ''
), held AS (
  SELECT doc_id, lang, CASE WHEN regexp_matches(t, '[“"]') THEN array_to_string(list_transform(regexp_extract_all(t, '“[^”\n]*”|"[^"\n]*"|[^“"]+|[“"]'),
    lambda x: CASE WHEN len(x) > 1 AND (starts_with(x, '“') OR starts_with(x, '"')) THEN regexp_replace(x, '([.!?…][’)]*)([ \t\r\f]+)', '\1' || chr(2) || '\2', 'g') ELSE x END), '') ELSE t END AS t FROM clean
), first_cuts AS (
  SELECT doc_id, lang, regexp_replace(t, '([.!?…]["”’)]*[ \t\n\r\f]+|\n[ \t\n\r\f]*)', '\1' || chr(1), 'g') AS m FROM held
), marked AS (
  SELECT doc_id, lang, ENDS AS t FROM first_cuts
), raw AS (
  SELECT doc_id, lang, unnest(p) AS piece, unnest(range(len(p))) AS i FROM (SELECT doc_id, lang, list_filter(string_split(t, chr(1)), lambda x: x <> '') AS p FROM marked)
), numbered AS (
  SELECT *, sum(CASE WHEN i > 0 AND NOT regexp_full_match(replace(piece, chr(2), ''), '[EDGE]*') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM raw
), outer_sentence AS (
  SELECT doc_id, lang, s, string_agg(piece, '' ORDER BY i) AS t FROM numbered GROUP BY ALL
), again AS (
  SELECT doc_id, lang, s, CASE WHEN contains(t, chr(2)) AND regexp_full_match(t, '(?s)\s*["“].*["”]\s*') THEN regexp_replace(t, chr(2) || '([ \t\r\f]+)', '\1' || chr(1), 'g') ELSE replace(t, chr(2), '') END AS m FROM outer_sentence
), marked_again AS (
  SELECT doc_id, lang, s, CASE WHEN contains(m, chr(1)) THEN ENDS ELSE m END AS t FROM again
), raw_again AS (
  SELECT doc_id, lang, s, unnest(p) AS piece, unnest(range(len(p))) AS i FROM (SELECT doc_id, lang, s, list_filter(string_split(t, chr(1)), lambda x: x <> '') AS p FROM marked_again)
), numbered_again AS (
  SELECT *, sum(CASE WHEN i > 0 AND NOT regexp_full_match(piece, '[EDGE]*') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, s ORDER BY i) AS k FROM raw_again
), sentence AS (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY doc_id ORDER BY s, k) - 1 AS s, t FROM (SELECT doc_id, lang, s, k, string_agg(piece, '' ORDER BY i) AS t FROM numbered_again GROUP BY ALL)
), raw2 AS (
  SELECT doc_id, lang, s, unnest(p) AS piece, unnest(range(len(p))) AS i
  FROM (SELECT doc_id, lang, s, list_filter(string_split(regexp_replace(regexp_replace(t, '(["”,;:] [ \t\n\r\f]*|[–—)][ \t\n\r\f]*)', '\1' || chr(1), 'g'), '\(', chr(1) || '(', 'g'), chr(1)), lambda x: x <> '') AS p FROM sentence)
), numbered2 AS (
  SELECT *, sum(CASE WHEN i > 0 AND NOT regexp_full_match(piece, '[EDGE]*') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, s ORDER BY i) AS k FROM raw2
), merged AS (
  SELECT doc_id, lang, s, k, string_agg(piece, '' ORDER BY i) AS t FROM numbered2 GROUP BY ALL
), counted AS (
  SELECT *, max(k) OVER (PARTITION BY doc_id, s) AS last_k, len(regexp_replace(regexp_extract(t, '[BLANK]*$'), '[^\n]', '', 'g')) AS lf, len(regexp_extract_all(t, '[^BLANK]+')) AS n_words FROM merged
), phrases AS (
  SELECT doc_id, lang, s, k, t, n_words, CASE WHEN k < last_k THEN 'is' WHEN lf = 0 THEN 's' WHEN lf < 3 THEN 'p' ELSE 'x' END AS reason FROM counted
)
""".replace("ENDS", _ends_sql("m")).replace("EDGE", WS + PUNC).replace("BLANK", WS)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


@register("phrase_split_counts", PHRASES_SQL + "SELECT doc_id, reason, count(*) AS n, CAST(sum(n_words) AS BIGINT) AS words FROM phrases GROUP BY doc_id, reason")
def phrase_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases and words by document and boundary reason."""
    p = seg.phrases(documents(spark, sf_dir), language="lang")
    return p.groupBy("doc_id", "reason").agg(F.count("*").alias("n"), F.sum("n_words").alias("words"))


@register("reason_groups", PHRASES_SQL + """
, closing AS (
  SELECT *, coalesce(sum(CASE WHEN reason IN ('s', 'p', 'x') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM phrases
), sized AS (SELECT doc_id, g, sum(n_words) AS w FROM closing GROUP BY doc_id, g)
SELECT doc_id, count(*) AS n_groups, CAST(max(w) AS BIGINT) AS most_words FROM sized GROUP BY doc_id
""")
def reason_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups that close after a phrase of at least sentence level: how many, and the largest in words."""
    g = seg.group_by_reason(seg.phrases(documents(spark, sf_dir), language="lang"), "s")
    return g.groupBy("doc_id", "group_index").agg(F.sum("n_words").alias("w")).groupBy("doc_id").agg(F.count("*").alias("n_groups"), F.max("w").alias("most_words"))


@register("packed_groups", PHRASES_SQL.replace("WITH clean", "WITH RECURSIVE clean", 1) + """
, pr AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s, k) AS i, n_words AS w FROM phrases), fill(doc_id, i, g, cur) AS (
  SELECT doc_id, i, 0, w FROM pr WHERE i = 1 UNION ALL SELECT p.doc_id, p.i, CASE WHEN cur > 0 AND cur + w > 40 THEN g + 1 ELSE g END, CASE WHEN cur > 0 AND cur + w > 40 THEN w ELSE cur + w END FROM fill f JOIN pr p ON p.doc_id = f.doc_id AND p.i = f.i + 1
), sizes AS (SELECT doc_id, g, max(cur) AS n FROM fill GROUP BY doc_id, g)
SELECT doc_id, count(*) FILTER (WHERE n > 0) AS n_groups, max(n) FILTER (WHERE n > 0) AS most_words FROM sizes GROUP BY doc_id
""")
def packed_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups filled with phrases up to 40 words: how many, and the largest in words ."""
    g = seg.pack_words(seg.phrases(documents(spark, sf_dir), language="lang"), 40)
    return g.select("doc_id", F.size("groups").alias("n_groups"), F.array_max("groups").alias("most_words"))


@register("long_phrase_split", PHRASES_SQL + """
, cut AS (SELECT doc_id, n_words, greatest(CAST(ceil(n_words / 4.0) AS BIGINT), 1) AS parts FROM phrases)
SELECT doc_id, CAST(sum(parts) AS BIGINT) AS n_parts, CAST(sum(n_words) AS BIGINT) AS n_words, CAST(sum(parts - 1) AS BIGINT) AS n_cut FROM cut GROUP BY doc_id
""")
def long_phrase_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of more than 4 words in equal strides: parts, words, and parts that a cut ends."""
    parts = seg.split_long(seg.phrases(documents(spark, sf_dir), language="lang"), 4)
    return parts.groupBy("doc_id").agg(F.count("*").alias("n_parts"), F.sum("n_words").cast("long").alias("n_words"), F.count_if(F.col("reason") == "w").alias("n_cut"))


@register("word_tokens", r"""
SELECT doc_id, len(w) AS n_words, len(list_filter(w, lambda x: regexp_matches(x, '[\p{L}\p{N}]'))) AS n_spoken, CAST(coalesce(list_max(list_transform(w, lambda x: len(x))), 0) AS BIGINT) AS longest
FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^BLANK]+') AS w FROM documents)
""".replace("BLANK", WS))
def word_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, words with a letter or digit, and the longest word of each document."""
    w = tx.words_with_space(F.coalesce("text", F.lit("")))
    d = documents(spark, sf_dir).select("doc_id", w.alias("w"))
    bare = F.transform("w", lambda x: F.length(F.rtrim(x, F.lit(tx._BLANKS))))
    return d.select("doc_id", F.size("w").cast("long").alias("n_words"), F.size(F.filter("w", tx.vocalizable)).cast("long").alias("n_spoken"), F.coalesce(F.array_max(bare), F.lit(0)).cast("long").alias("longest"))


_PUNC_BLANK = tx.regex_class("".join(x for x in tx.PUNCTUATION if x not in "“”‘’")).replace("'", "''")
#: The steps of the comparison form, each around the one before. Compatibility forms are left out: the tables hold letters that have none.
COMPARE_SQL = (
    "lower(translate(@, '’“”', chr(39) || chr(34) || chr(34)))",
    "replace(@, 'ß', 'ss')",
    r"trim(regexp_replace(regexp_replace(@, '[\p{So}\p{Sk}\p{Cf}\p{Co}]', '', 'g'), '[BLANK]+', ' ', 'g'))",
    r"regexp_replace(regexp_replace(@, '([\p{L}\p{N}_])' || chr(39), '\1', 'g'), chr(39) || '([\p{L}\p{N}_])', '\1', 'g')",
    "regexp_replace(@, '[EDGE]', ' ', 'g')",
    r"trim(regexp_replace(regexp_replace(@, '[^\p{L}\p{N}_BLANK]', '', 'g'), '[BLANK]+', ' ', 'g'))",
)


def compare_sql(text: str) -> str:
    at = "\x00"
    for step in COMPARE_SQL:
        text = step.replace("@", at).replace("BLANK", WS).replace("EDGE", _PUNC_BLANK).replace(at, text)
    return text


@register("normalize_common", f"SELECT doc_id, sha256(c) AS compared, len(c) AS n_chars FROM (SELECT doc_id, {compare_sql("coalesce(text, '')")} AS c FROM documents)")
def normalize_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in the form in which they are compared."""
    d = documents(spark, sf_dir).select("doc_id", tx.compare_form(F.coalesce("text", F.lit(""))).alias("c"))
    return d.select("doc_id", F.sha2("c", 256).alias("compared"), F.length("c").cast("long").alias("n_chars"))


@register("silent_lines", """
SELECT doc_id, count(*) FILTER (WHERE regexp_full_match(line, '[EDGE]*')) AS n_silent, count(*) AS n_lines
FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents) GROUP BY doc_id
""".replace("EDGE", WS + PUNC))
def silent_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of only white space and punctuation."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    return documents(spark, sf_dir).select("doc_id", F.size(F.filter(lines, tx.blank_or_punctuation)).cast("long").alias("n_silent"), F.size(lines).cast("long").alias("n_lines"))


LEXICON_SQL = r"""
WITH words AS (SELECT DISTINCT doc_id, lang, unnest(string_split({0}, ' ')) AS word FROM documents WHERE text IS NOT NULL),
lexicon AS (SELECT lang, word, count(*) AS n_docs FROM words WHERE word <> '' GROUP BY lang, word HAVING count(*) >= 5)
""".replace("{0}", compare_sql("text"))


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).where("text is not null")
    return d.select("doc_id", "lang", F.explode(F.split(tx.compare_form(F.col("text")), " ")).alias("word")).where("word <> ''")


def lexicon(texts: DataFrame, least: int = 5) -> DataFrame:
    """(lang, word, n_docs) of words in at least so many documents of a language; texts: (doc_id, lang, text).

    A row's words are made distinct in the row. Only where an id has several rows are words grouped with their ids; else
    a task sums up its rows before the shuffle.
    """
    repeated = texts.groupBy("doc_id").count().agg(F.coalesce(F.max("count") > 1, F.lit(False))).scalar()
    w = texts.where("text is not null").select("lang", "doc_id", F.explode(F.array_distinct(F.split(tx.compare_form(F.col("text")), " "))).alias("word")).where("word <> ''")
    once = w.groupBy("lang", "word", F.when(repeated, F.col("doc_id")).alias("id")).agg(F.when(repeated, 1).otherwise(F.count("*")).alias("k"))
    return once.groupBy("lang", "word").agg(F.sum("k").alias("n_docs")).where(F.col("n_docs") >= least)


@register("lexicon_by_lang", LEXICON_SQL + "SELECT lang, word, n_docs FROM lexicon")
def lexicon_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of a language: those in at least five of its documents."""
    return lexicon(documents(spark, sf_dir))


@register("uncommon_words_topk", LEXICON_SQL.replace("SELECT DISTINCT doc_id, lang", "SELECT doc_id, lang").replace("count(*)", "count(DISTINCT doc_id)") + """
SELECT lang, word, count(*) AS n FROM words ANTI JOIN lexicon USING (lang, word) WHERE word <> '' GROUP BY lang, word ORDER BY n DESC, lang, word LIMIT 25
""")
def uncommon_words_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the 25 most frequent words that no lexicon has; its limit is the report's size."""
    once = _words(spark, sf_dir).groupBy("lang", "word", "doc_id").agg(F.count("*").alias("k"))
    counted = once.groupBy("lang", "word").agg(F.sum("k").alias("n"), F.count("*").alias("n_docs"))
    return counted.where("n_docs < 5").orderBy(F.desc("n"), "lang", "word").limit(25).drop("n_docs")


@register("stem_family_index", LEXICON_SQL + """
, forms AS (SELECT DISTINCT word FROM lexicon), stems AS (SELECT word, unnest(range(5, len(word) + 1)) AS k FROM forms)
SELECT word[1:k] AS stem, count(*) AS n FROM stems WHERE len(word) <= k + 12 GROUP BY stem HAVING count(*) >= 2
""")
def stem_family_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems of five letters or more with at least two lexicon words that start with them, 12 letters longer at most."""
    forms = lexicon(documents(spark, sf_dir)).select("word").distinct().where(F.length("word") >= 5)
    n = F.length("word")
    s = forms.select("word", F.explode(F.sequence(F.greatest(F.lit(5), n - 12), n)).alias("k"))
    return s.groupBy(F.substring(F.col("word"), F.lit(1), F.col("k")).alias("stem")).agg(F.count("*").alias("n")).where("n >= 2")


def previews(d: DataFrame) -> DataFrame:
    """Shortened texts and their length (a character a second) as a clock; a null length has no clock."""
    return d.select("doc_id", tx.language(F.col("lang")).alias("language"), tx.ellipsize(tx.collapse_space(F.coalesce("text", F.lit(""))), 60).alias("preview"), tx.clock(F.col("n_chars")).alias("length_clock"))


@register("text_previews", r"""
SELECT doc_id, split_part(lower(trim(lang)), '-', 1) AS language, CASE WHEN len(t) > 60 THEN rtrim(t[1:57]) || '...' ELSE t END AS preview,
  CASE WHEN n_chars >= 3600 THEN CAST(n_chars // 3600 AS VARCHAR) || ':' || lpad(CAST(n_chars % 3600 // 60 AS VARCHAR), 2, '0') ELSE CAST(n_chars // 60 AS VARCHAR) END || ':' || lpad(CAST(n_chars % 60 AS VARCHAR), 2, '0') AS length_clock
FROM (SELECT *, trim(regexp_replace(coalesce(text, ''), '[BLANK]+', ' ', 'g')) AS t FROM documents)
""".replace("BLANK", WS))
def text_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Previews and clocks of every document, those below an hour and without a length too."""
    return previews(documents(spark, sf_dir))


# ---------------------------------------------------------------- pages


#: Entities that the pages hold.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", chr(160)), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def _unescaped_sql(c: str) -> str:
    for a, b in ENTITIES:
        c = f"replace({c}, '{a}', '{b.replace("'", "''")}')"
    return c


def _preview_sql(html: str) -> str:
    c = html
    for tag in pg.SKIPPED:
        c = f"regexp_replace({c}, '(?is)<{tag}[^>]*>.*?</{tag}>', ' ', 'g')"
    c = rf"regexp_replace(regexp_replace({c}, '(?i)<br\s*/?>', chr(10), 'g'), '(?i)</({'|'.join(pg.LINE_ENDS)})>', chr(10), 'g')"
    c = f"replace({_unescaped_sql(f"regexp_replace({c}, '(?s)<[^>]+>', ' ', 'g')")}, chr(160), ' ')"
    c = rf"regexp_replace(regexp_replace({c}, '[ \t]+', ' ', 'g'), '\n\s*\n+', chr(10) || chr(10), 'g')"
    return f"trim({c}, ' ' || chr(10) || chr(9) || chr(11) || chr(12) || chr(13))"


PAGES_SQL = f"""WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, {_preview_sql("coalesce(html, '')")} AS t FROM pages),
named AS (SELECT *, regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1) AS href FROM p) """


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    return p.withColumn("href", F.regexp_extract("url", r"^[^:]*://[^/?#]*([^?#]*)", 1))


@register("html_preview", PAGES_SQL + "SELECT page_id, len(t) AS n_chars, sha256(t) AS preview FROM p")
def html_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preview text of pages, by rules."""
    p = pages(spark, sf_dir).select("page_id", pg.preview(F.col("html")).alias("t"))
    return p.select("page_id", F.length("t").cast("long").alias("n_chars"), F.sha2("t", 256).alias("preview"))


def _title_sql(tag: str) -> str:
    inner = rf"regexp_replace(regexp_extract(html, '(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>', 1), '<[^>]*>', ' ', 'g')"
    return f"nullif(trim(regexp_replace(replace({_unescaped_sql(inner)}, chr(160), ' '), '[{WS}]+', ' ', 'g')), '')"


TITLES_SQL = f"""coalesce({_title_sql("h1")}, {_title_sql("h2")}, {_title_sql("title")}, nullif(regexp_replace(regexp_extract(href, '([^/]*)$', 1), '\\.[^./]*$', ''), ''), href)"""


@register("page_titles", PAGES_SQL + f"SELECT page_id, {TITLES_SQL} AS title FROM named")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first heading with text, else the title, else the name of the file."""
    return pages(spark, sf_dir).select("page_id", pg.title(F.col("html"), F.col("href")).alias("title"))


@register("page_skip_decision", PAGES_SQL + rf"""
, q AS (
  SELECT page_id, regexp_extract(url, '^.*?://([^/?#]*)', 1) AS book, t, lower(regexp_replace(lower(href || ' ' || title), '[^a-z0-9]+', '', 'g')) AS key, len(regexp_extract_all(html, '(?is)<a\b[^>]*\bhref\s*=')) AS n_links, len(regexp_extract_all(html, '(?is)<li\b')) AS n_items,
    len(list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '' AND len(trim(x)) <= 80)) AS n_short,
    regexp_matches(regexp_replace(lower(regexp_replace(array_to_string((regexp_extract_all(html, '(?is)<(?:h1|h2|title|strong|b)[^>]*>(.*?)</(?:h1|h2|title|strong|b)>', 1))[:4], ' '), '(?s)<[^>]+>', ' ', 'g')), '[^a-z0-9]+', '', 'g'), '{"|".join(pg.CONTENTS_TERMS)}') AS heading,
    trim(regexp_replace(replace(lower(t), '©', ' copyright '), '[{WS}]+', ' ', 'g')) AS content
  FROM (SELECT *, {_unescaped_sql(TITLES_SQL)} AS title FROM named)
), w AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY page_id) - 1 AS position, count(*) OVER (PARTITION BY book) AS n FROM q
), r AS (SELECT *, position < 6 AS front, position < 6 OR position >= greatest(0, n - 4) AS win, regexp_matches(key, '{"|".join(pg.PUBLICATION_TERMS)}') AS pub, n_links >= 5 OR n_items >= 5 AS linked FROM w)
SELECT page_id, position, n_links, n_items, n_short, CASE WHEN pub AND win THEN 'publication name'
  WHEN NOT pub AND front AND t <> '' AND (len(regexp_extract_all(t, '[\p{{L}}\p{{N}}_]+')) <= 700 OR len(t) <= 4000) AND len(list_filter({list(pg.PUBLICATION_PHRASES)}, lambda x: contains(content, x))) >= 2 THEN 'publication phrases'
  WHEN win AND regexp_matches(key, '{"|".join(pg.CONTENTS_TERMS)}') AND linked THEN 'contents name' WHEN win AND heading AND linked THEN 'contents heading' WHEN front AND n_links >= 5 AND n_short >= 5 THEN 'contents links' END AS reason, regexp_matches(key, '{"|".join(pg.NON_READING_TERMS)}') AS likely_empty FROM r
""")
def page_skip_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a page of a site, in order, is no reading text: publication data, or a table of contents."""
    p = pages(spark, sf_dir).withColumn("t", pg.preview(F.col("html")))
    key = pg.key_form(F.concat("href", F.lit(" "), pg.title(F.col("html"), F.col("href"))))
    p = p.select("page_id", F.regexp_extract("url", r"^.*?://([^/?#]*)", 1).alias("book"), "t", key.alias("key"), pg.count_links(F.col("html")).cast("long").alias("n_links"), pg.count_list_items(F.col("html")).cast("long").alias("n_items"), pg.contents_heading(F.col("html")).alias("heading"))
    p = pg.near_edges(p.withColumn("n_short", pg.short_lines(F.col("t")).cast("long")), "book", "page_id")
    reason = pg.skip_reason(F.col("key"), F.col("t"), F.col("n_links"), F.col("n_items"), F.col("n_short"), F.col("heading"), F.col("in_front"), F.col("in_window"))
    return p.select("page_id", F.col("position").cast("long").alias("position"), "n_links", "n_items", "n_short", reason.alias("reason"), pg.likely_empty(F.col("key")).alias("likely_empty"))


@register("reading_texts")
def reading_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading text of pages by their elements (a parser; held against literal cases)."""
    r = pg.reading_text(pages(spark, sf_dir), "html")
    return r.select("page_id", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text"), "repairs", "image_only")


@register("contents_titles", """
WITH c AS (SELECT page_id, 'book' || (page_id % 20) AS book, 'Text/ch ' || (page_id // 20) || '.xhtml' AS href FROM pages),
e AS (SELECT page_id // 20 AS i, 'book' || (page_id % 20) AS book, page_id FROM pages WHERE page_id % 3 <> 0)
SELECT c.page_id, CASE WHEN e.page_id IS NOT NULL THEN 'Part ' || e.i END AS contents_title FROM c LEFT JOIN e ON c.page_id = e.page_id
""")
def contents_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of chapters from tables of contents, whose links are written otherwise and come twice."""
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("book"), (F.col("page_id") % 20).cast("string")).alias("book"), F.floor(F.col("page_id") / 20).cast("string").alias("i"))
    chapters = p.select("page_id", "book", F.concat(F.lit("Text/ch "), "i", F.lit(".xhtml")).alias("href"))
    entry = F.explode(F.array(F.struct(F.lit(0).alias("o"), F.concat(F.lit("./Text/ch%20"), "i", F.lit(".xhtml#top")).alias("h"), F.concat(F.lit(" Part&nbsp;"), "i").alias("t")), F.struct(F.lit(1).alias("o"), F.concat(F.lit("Text\\ch%20"), "i", F.lit(".xhtml")).alias("h"), F.lit("later").alias("t"))))
    contents = p.where("page_id % 3 <> 0").select("book", entry.alias("e")).select("book", "e.o", "e.h", "e.t")
    return pg.with_contents_titles(chapters, contents, "book", "href", "h", "t", "o").select("page_id", "contents_title")


# ---------------------------------------------------------------- conversations


@register("alternating_role_violations", """
WITH t AS (SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 7 = 0 THEN 'user' ELSE role END AS role FROM conversations)
SELECT conv_id, min(turn) AS turn FROM (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM t) WHERE role = next_role GROUP BY conv_id
""")
def alternating_role_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first turn of each conversation whose role the next one repeats (some turns are said by the user here)."""
    role = F.when((F.col("conv_id") + F.col("turn")) % 7 == 0, "user").otherwise(F.col("role"))
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", role.alias("role"))
    after = F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    return t.withColumn("next_role", after).where("role = next_role").groupBy("conv_id").agg(F.min("turn").alias("turn"))


@register("message_assembly", r"""
WITH m AS (SELECT conv_id, turn, role, coalesce(text, '') AS content FROM conversations UNION ALL SELECT DISTINCT conv_id, -1, 'system', 'Be brief.' FROM conversations WHERE conv_id % 2 = 0)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position, role, content FROM m
""")
def message_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of each request in order, every other one with a system message in front; a row a message."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("content"))
    system = c.select("conv_id").distinct().where("conv_id % 2 = 0").select("conv_id", F.lit(-1).cast("long").alias("turn"), F.lit("system").alias("role"), F.lit("Be brief.").alias("content"))
    position = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return c.unionByName(system).select("conv_id", position.cast("long").alias("position"), "role", "content")


@register("rolling_history", """
WITH t AS (SELECT conv_id, turn, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\f]+')) AS w FROM conversations),
s AS (SELECT conv_id, turn, sum(w) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS suffix_words, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM t)
SELECT conv_id, turn, CAST(suffix_words AS BIGINT) AS suffix_words FROM s WHERE k <= 4 AND suffix_words <= 160
""".replace("\\\\", "\\"))
def rolling_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns that a history of at most four turns and 160 words keeps: the longest fitting end of the conversation."""
    back = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(tx.words_with_space(F.coalesce("text", F.lit("")))).cast("long").alias("w"))
    t = t.withColumns({"suffix_words": F.sum("w").over(back.rowsBetween(Window.unboundedPreceding, 0)), "k": F.row_number().over(back)})
    return t.where("k <= 4 and suffix_words <= 160").select("conv_id", "turn", "suffix_words")
