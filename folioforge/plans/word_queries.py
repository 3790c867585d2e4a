"""Queries on words and small texts: lists, lexicons, substitutions, prompts, chunks, codes in text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import contracts as ct
from folioforge.functions import names
from folioforge.functions import numbers
from folioforge.functions import text as tx
from folioforge.operators import alignment as al
from folioforge.operators import lexicon as lx
from folioforge.operators import prompts as pr
from folioforge.operators import timeline as tl
from folioforge.plans.text_queries import PUNC, WS, compare_sql, documents
from folioforge.registry import register, table
from folioforge.sources.shared import written

#: Raw words of every document (split at white space), and a lexicon: words in at least five documents.
RAW_SQL = """
WITH w AS (SELECT doc_id, lang, regexp_extract_all(coalesce(text, ''), '[^BLANK]+') AS w FROM documents),
raw AS (SELECT doc_id, lang, unnest(w) AS word, unnest(range(len(w))) AS i FROM w),
core AS (SELECT doc_id, lang, i, word, regexp_extract(word, '^[EDGE]*((?s:.*[^EDGE])?)[EDGE]*$', 1) AS core FROM raw),
known AS (SELECT lower(core) AS word FROM core WHERE core <> '' GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5)
""".replace("BLANK", WS).replace("EDGE", WS + PUNC)


def raw_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select("doc_id", "lang", tx.settled(tx.bare_words(F.coalesce("text", F.lit("")))).alias("w"))
    return d.select("doc_id", "lang", F.posexplode("w").alias("i", "word"))


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, n): the words of all documents without edges in small letters, and in how many documents they are.

    A document's words are made distinct in its own row (its texts come together first, should its id have several), so
    that no row of a document and a word is shuffled: tasks count words.
    """
    core = lambda w: F.lower(tx.word_parts(w)["core"])
    d = documents(spark, sf_dir).where("text <> ''").groupBy("doc_id").agg(F.array_join(F.collect_list("text"), "\n").alias("text"))
    words = F.array_distinct(F.transform(F.array_distinct(tx.bare_words(F.col("text"))), core))
    w = d.select("doc_id", tx.settled(words).alias("w")).select("doc_id", F.explode("w").alias("word")).where("word <> ''")
    return w.groupBy("word").agg(F.count("doc_id").alias("n"))


def known_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary(spark, sf_dir).where("n >= 5").select("word")


@register("word_parts", RAW_SQL + "SELECT doc_id, count(*) FILTER (WHERE core <> word) AS n_edged, count(*) FILTER (WHERE core = '') AS n_bare, sha256(string_agg(core, ' ' ORDER BY i)) AS cores FROM core GROUP BY doc_id")
def word_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words without the punctuation around them."""
    c = raw_words(spark, sf_dir).withColumn("core", tx.word_parts(F.col("word"))["core"])
    cores = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "core"))), lambda x: x["core"]), " ")
    return c.groupBy("doc_id").agg(F.count_if(F.col("core") != F.col("word")).alias("n_edged"), F.count_if(F.col("core") == "").alias("n_bare"), F.sha2(cores, 256).alias("cores"))


@register("uncommon_report", RAW_SQL + r"""
, u AS (SELECT doc_id, i, core, lower(core) AS word FROM (SELECT doc_id, i, replace(core, '’', chr(39)) AS core FROM core) WHERE regexp_matches(core, '[\p{L}\p{N}]')), f AS (SELECT word, core, count(*) AS n, min((doc_id, i)) AS place FROM u ANTI JOIN known USING (word) GROUP BY ALL)
SELECT word, CAST(sum(n) AS BIGINT) AS n, string_agg(core, '|' ORDER BY place) AS forms FROM f GROUP BY word
""")
def uncommon_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the lexicon lacks, with their forms as first seen."""
    out = lx.uncommon_report(raw_words(spark, sf_dir), "doc_id", "i", "word", known_words(spark, sf_dir))
    return out.select("word", "n", F.array_join("forms", "|").alias("forms"))


@register("word_list_reasons", RAW_SQL + r"""
, r AS (SELECT DISTINCT word AS raw, regexp_replace(translate(lower(word), 'áéíóúü', 'aeiouu'), '[.,;:!?]+$', '') AS n FROM raw)
SELECT raw, CASE WHEN n = '' THEN 'empty' WHEN n IN ('the', 'der') THEN 'stoplist' WHEN len(n) < 2 THEN 'too_short' WHEN len(n) > 12 THEN 'too_long'
  WHEN regexp_matches(raw, '(?i)https?:|www\.|@|\.(?:com|org|net)\b|/') OR starts_with(n, 'http') OR starts_with(n, 'www') THEN 'url_or_email' WHEN regexp_matches(raw, '\p{Nd}') THEN 'contains_digit'
  WHEN regexp_full_match(regexp_replace(raw, '[^\p{L}]', '', 'g'), '\p{Lu}{2,}') THEN 'all_caps_acronym'
  WHEN len(regexp_replace(raw, '[^\p{L}]', '', 'g')) >= 3 AND regexp_matches(raw, '\p{Ll}') AND regexp_matches(regexp_replace(raw, '[^\p{L}]', '', 'g'), '^.+\p{Lu}') THEN 'internal_camelcase_glued_token'
  WHEN NOT regexp_full_match(n, '[a-zñ]+') THEN 'malformed_after_normalization' WHEN len(n) >= 2 AND regexp_full_match(n, 'm{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})') THEN 'roman_numeral' ELSE 'keep' END AS reason FROM r
""")
def word_list_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each word would be kept out of a list."""
    r = raw_words(spark, sf_dir).select(F.col("word").alias("raw")).distinct()
    n = F.regexp_replace(F.translate(F.lower("raw"), "áéíóúü", "aeiouu"), "[.,;:!?]+$", "")
    return r.select("raw", lx.list_reason(F.col("raw"), n, 2, 12, ["the", "der"]).alias("reason"))


@register("best_tokens", RAW_SQL + """
, s AS (SELECT lower(core) AS word, core AS raw, count(*) AS n FROM core WHERE core <> '' GROUP BY ALL), b AS (SELECT word, max(n) AS score, string_agg(raw, '|' ORDER BY raw) AS forms FROM s GROUP BY word), t AS (SELECT *, row_number() OVER (ORDER BY score DESC, word) AS rank FROM b)
SELECT word, score, forms, rank FROM t WHERE rank <= 200
""")
def best_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 200 normal forms with the most frequent raw form (a list's size)."""
    c = raw_words(spark, sf_dir).select(tx.word_parts(F.col("word"))["core"].alias("raw")).where("raw <> ''").groupBy("raw").agg(F.count("*").alias("n")).withColumn("word", F.lower("raw"))
    return lx.best_tokens(c, "word", "raw", "n", 200).select("word", "score", F.array_join("forms", "|").alias("forms"), F.col("rank").cast("long").alias("rank"))


@register("trusted_english", RAW_SQL + """
, d AS (SELECT DISTINCT lower(core) AS word FROM core WHERE core <> '')
SELECT word FROM d WHERE word IN (SELECT word FROM known) OR (word LIKE '%''s' AND len(word) > 2 AND word[:-3] IN (SELECT word FROM known)) OR (word LIKE '%s' AND word NOT LIKE '%''s' AND len(word) > 1 AND word[:-2] IN (SELECT word FROM known))
""")
def trusted_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the lexicon has, or has without a plural or possessive ending."""
    v = written(vocabulary(spark, sf_dir), "vocabulary")
    return lx.trusted(v.select("word"), v.where("n >= 5").select("word"), None, "en")


#: Endings of a family, one for another.
_SIBLINGS = [(a, b) for family in lx.ES_FAMILIES for a in family for b in family]


@register("trusted_spanish", RAW_SQL.replace("known AS (", "known AS MATERIALIZED (") + """
, d AS MATERIALIZED (SELECT DISTINCT lower(core) AS word FROM core WHERE core <> ''),
sib AS (SELECT DISTINCT c.word FROM (SELECT word, unnest(list_transform(list_filter(SIBLINGS, lambda p: ends_with(word, p[1]) AND len(word) - len(p[1]) >= 4), lambda p: left(word, len(word) - len(p[1])) || p[2])) AS k FROM d) c JOIN known ON c.k = known.word),
stems AS (SELECT left(word, k) AS stem FROM (SELECT word, unnest(range(5, len(word) + 1)) AS k FROM known) WHERE len(word) <= k + 12 GROUP BY stem HAVING count(*) >= 2),
t AS (SELECT word, list_transform(list_filter(ENDINGS, lambda e: ends_with(word, e)), lambda e: left(word, len(word) - len(e))) AS s FROM d WHERE len(word) >= 7),
u AS (SELECT word, unnest(list_filter(s, lambda x, i: list_min(list_transform(s[1:i], lambda y: len(y))) >= 5)) AS stem FROM t)
SELECT d.word FROM known JOIN d ON known.word = d.word UNION SELECT word FROM sib UNION SELECT u.word FROM u JOIN stems ON u.stem = stems.stem
""".replace("ENDINGS", str(lx.ES_ENDINGS)).replace("SIBLINGS", str([list(p) for p in _SIBLINGS])))
def trusted_spanish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the lexicon has, or siblings or verb forms of such words."""
    v = written(vocabulary(spark, sf_dir), "vocabulary")  # read several times
    known = v.where("n >= 5").select("word")
    n = F.length("word")
    stems = known.where(n >= 5).select("word", F.explode(F.sequence(F.greatest(F.lit(5), n - 12), n)).alias("k")).groupBy(F.substring(F.col("word"), F.lit(1), F.col("k")).alias("stem")).agg(F.count("*").alias("n")).where("n >= 2")
    return lx.trusted(v.select("word"), known, stems, "es")


@register("bracketed_words", RAW_SQL + "SELECT doc_id, sha256(string_agg(CASE WHEN k.word IS NULL THEN '[' || raw.word || ']' ELSE raw.word END, ' ' ORDER BY i)) AS shown FROM raw LEFT JOIN known k ON raw.word = k.word GROUP BY doc_id")
def bracketed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with the words that the lexicon lacks in brackets."""
    d = documents(spark, sf_dir).where(F.rlike("text", F.lit(tx.NO_BLANK))).select("doc_id", tx.settled(F.regexp_replace("text", f"{tx.BLANK}+", " ")).alias("text"))
    return lx.bracketed(d, "doc_id", "text", known_words(spark, sf_dir)).select("doc_id", F.sha2("text", 256).alias("shown"))


@register("lowered_capitals", RAW_SQL + """
, d AS (SELECT DISTINCT doc_id, upper(replace(list_aggregate(w, 'string_agg', ' '), 'ß', 's')) AS t FROM w WHERE len(w) > 0), e AS (SELECT doc_id, t, unnest(string_split(t, ' ')) AS word, unnest(range(len(string_split(t, ' ')))) AS i FROM d)
SELECT doc_id, sha256(CASE WHEN regexp_matches(any_value(t), '[A-Z]') AND NOT regexp_matches(any_value(t), '[a-z]') THEN string_agg(CASE WHEN k.word IS NULL THEN e.word ELSE k.word END, ' ' ORDER BY i) ELSE any_value(t) END) AS t FROM e LEFT JOIN known k ON lower(e.word) = k.word GROUP BY doc_id
""")
def lowered_capitals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in capitals: known words become small."""
    d = documents(spark, sf_dir).where("text <> ''").select("doc_id", tx.settled(F.upper(F.replace(tx.collapse_space(F.col("text")), F.lit("ß"), F.lit("s")))).alias("t")).where("t <> ''")
    return lx.lower_known_capitals(d, "doc_id", "t", known_words(spark, sf_dir)).select("doc_id", F.sha2("t", 256).alias("t"))


@register("word_substitutions", RAW_SQL + """
, p AS (SELECT doc_id, i, word, lower(core) AS l, core, strpos(word, core) AS place FROM core WHERE core <> ''), s(word, r) AS (VALUES ('the', 'that'), ('and', 'or'), ('die', 'jene'), ('tion', 'action')),
x AS (SELECT p.doc_id, p.i, p.core, s.r || e.suffix AS r, row_number() OVER (PARTITION BY p.doc_id, p.i ORDER BY e.o) AS k FROM p JOIN (VALUES (0, ''), (1, 's'), (2, 'es'), (3, '''s'), (4, 's''')) e(o, suffix) ON ends_with(l, suffix) JOIN s ON left(l, len(l) - len(suffix)) = s.word)
SELECT doc_id, count(*) AS n, string_agg(CASE WHEN regexp_matches(core, '^\\p{Lu}') THEN upper(r[1]) || r[2:] ELSE r END, ' ' ORDER BY i) AS words FROM x WHERE k = 1 GROUP BY doc_id
""".replace("\\\\", "\\"))
def word_substitutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words replaced, with their endings and capitals: how many in each document, and which."""
    pairs = spark.sql("SELECT * FROM VALUES (0, 'The', 'that'), (1, 'and', 'or'), (2, 'die', 'jene'), (3, 'tion', 'action') AS p(ord, word, replacement)")  # of known size, so it is broadcast
    d = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    after = lx.substituted(d.withColumn("before", F.col("text")), "doc_id", "text", pairs).where("text <> before")
    other = F.zip_with(tx.words_with_space(F.col("before")), tx.words_with_space(F.col("text")), lambda a, b: F.when(a != b, tx.word_parts(b)["core"]))
    both = after.select("doc_id", tx.settled(F.filter(other, lambda x: x.isNotNull())).alias("w"))
    return both.select("doc_id", F.size("w").cast("long").alias("n"), F.array_join("w", " ").alias("words"))


@register("comparison_pairs", f"SELECT doc_id, sha256(c) AS compared FROM (SELECT doc_id, {compare_sql("replace(coalesce(text, ''), '-', ' ')")} AS c FROM documents)")
def comparison_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in the English form for comparison (no text of the tables holds an English number word)."""
    d = documents(spark, sf_dir).select("doc_id", tx.compare_form(F.coalesce("text", F.lit("")), "en").alias("c"))
    return d.select("doc_id", F.sha2("c", 256).alias("compared"))


@register("light_forms", rf"SELECT doc_id, sha256(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}_{WS}]', '', 'g')) AS light FROM documents")
def light_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in the form in which they are aligned."""
    return documents(spark, sf_dir).select("doc_id", F.sha2(tx.light_form(F.coalesce("text", F.lit(""))), 256).alias("light"))


@register("literal_replacements", "SELECT doc_id, sha256(replace(replace(coalesce(text, ''), 'tion', 'shun'), 'shuns', 'X')) AS replaced FROM documents")
def literal_replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literal replacements of a model, one after the other."""
    return documents(spark, sf_dir).select("doc_id", F.sha2(tx.replaced_in_order(F.coalesce("text", F.lit("")), [("tion", "shun"), ("shuns", "X")]), 256).alias("replaced"))


@register("prompt_forms", rf"""
WITH d AS (SELECT doc_id, trim(regexp_replace(regexp_replace(translate(coalesce(text, ''), '’“”', chr(39) || chr(34) || chr(34)), '[\p{{So}}\p{{Sk}}\p{{Cf}}\p{{Co}}]', '', 'g'), '[{WS}]+', ' ', 'g')) AS t FROM documents),
e AS (SELECT doc_id, string_split(replace(regexp_replace(regexp_replace(t, '\.{{3,}}', '...', 'g'), '…+', '…', 'g'), ' . . . ', ' ... '), ' ') AS w FROM d)
SELECT doc_id, sha256(trim(coalesce(array_to_string(list_filter(w, lambda x: NOT regexp_full_match(x, '[{WS}{PUNC}]*') OR x IN ('...', '…', '—', '–', '-')), ' '), ''))) AS prompt FROM e
""")
def prompt_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as prompts, numbers as they are."""
    return documents(spark, sf_dir).select("doc_id", F.sha2(tx.prompt_form(F.coalesce("text", F.lit("")), spell=False), 256).alias("prompt"))


_SMALL = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "- - twenty thirty forty fifty sixty seventy eighty ninety".split()


@register("spelled_numbers", """
WITH o AS (SELECT o_orderkey, o_orderkey % 1200 AS v, o_orderkey % 1200 % 100 AS r FROM orders),
w AS (SELECT o_orderkey, v, r, CASE WHEN r < 20 THEN SMALL[r + 1] ELSE TENS[r // 10 + 1] || CASE WHEN r % 10 > 0 THEN '-' || SMALL[r % 10 + 1] ELSE '' END END AS below FROM o)
SELECT o_orderkey, CAST(v AS VARCHAR) AS n, CASE WHEN v > 999 THEN CAST(v AS VARCHAR) WHEN v < 100 THEN below ELSE SMALL[v // 100 + 1] || ' hundred' || CASE WHEN r > 0 THEN ' and ' || below ELSE '' END END AS words, CAST(v AS VARCHAR) AS digits FROM w
""".replace("SMALL", str(_SMALL)).replace("TENS", str(_TENS)))
def spelled_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small numbers of labels spelled, and back to digits."""
    n = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 1200).cast("string").alias("n"))
    n = n.withColumn("words", numbers.spelled(F.col("n"), 999))
    return n.withColumn("digits", numbers.english_digits(F.replace("words", F.lit("-"), F.lit(" "))))


@register("file_names", "SELECT p_partkey, trim(regexp_replace(left(p_name || '--' || p_type, 20), '[^A-Za-z0-9]+', '_', 'g'), '_') AS name FROM part")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as parts of file names."""
    return table(spark, sf_dir, "part").select("p_partkey", tx.file_name_form(F.concat("p_name", F.lit("--"), "p_type"), 20).alias("name"))


@register("voice_names", "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'none' ELSE trim(regexp_replace(left(p_name, 30), '[^A-Za-z0-9]+', '_', 'g'), '_') END AS tag FROM part")
def voice_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of voice files: no folder, no ending, no model; ``none`` without a file."""
    name = F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.concat(F.lit("a/b/"), "p_name", F.lit("_m1.flac")))
    return table(spark, sf_dir, "part").select("p_partkey", names.voice_tag(name, "m1").alias("tag"))


@register("malformed_names", """
WITH n AS (SELECT l_orderkey AS k, l_linenumber AS line, l_linenumber % 7 AS kind, md5(CAST(l_partkey AS VARCHAR))[1:16] AS h FROM lineitem)
SELECT k, line, CASE WHEN kind IN (0, 6) THEN k - 1 END AS idx, CASE WHEN kind = 0 THEN -1 WHEN kind = 6 THEN 4 END AS errors, CASE WHEN kind IN (0, 6) THEN h END AS digest, kind <> 3 AS is_hash FROM n
""")
def malformed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of takes, most of them wrong: no number, index 0, a short hash, no tags; what can be read of each."""
    kind, h = F.col("l_linenumber") % 7, F.substring(F.md5(F.col("l_partkey").cast("string")), 1, 16)
    k = F.col("l_orderkey").cast("string")
    digest = F.when(kind == 3, F.concat(F.substring(h, 1, 15), F.lit("g"))).otherwise(h)
    head = F.when(kind == 1, "[x]").when(kind == 2, "[00000]").when(kind == 4, "").otherwise(F.concat(F.lit("["), F.lpad(k, 9, "0"), F.lit("]")))
    name = F.when(kind == 5, "plain.flac").otherwise(F.concat(head, F.lit(" ["), digest, F.lit("] [A] [v1] "), F.when(kind == 6, "[4] ").otherwise("[four] "), F.lit("text.flac")))
    t = names.take_fields(name, ["A"])
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), t["index"].cast("long").alias("idx"), t["errors"].cast("long").alias("errors"), t["hash"].alias("digest"), names.is_digest(digest).alias("is_hash"))


@register("emotion_vectors", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 8 END AS n, CASE WHEN c_custkey % 3 = 0 THEN round((c_custkey % 10) / 10.0, 6) END AS first FROM customer")
def emotion_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight numbers from 0 to 1; others are null."""
    k = F.col("c_custkey")
    v = ct.emotion_vector(F.concat(F.when(k % 3 == 1, "1.5").otherwise((k % 10 / 10).cast("string")), F.lit(", 0, 0, 0, 0, 1, .5"), F.when(k % 3 == 2, "").otherwise(",0.25")))
    return table(spark, sf_dir, "customer").select("c_custkey", F.when(v.isNotNull(), F.size(v)).cast("long").alias("n"), F.round(v[0], 6).alias("first"))


@register("substitution_lists", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'c' ELSE 'b' END AS a FROM customer")
def substitution_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of substitutions; a later pair wins, a bad line spoils the list."""
    k = F.col("c_custkey")
    m = ct.substitutions(F.concat(F.lit("x y = z\na = b\n\n"), F.when(k % 2 == 0, " a= c").otherwise(""), F.when(k % 4 == 0, "\nodd").otherwise("")))
    return table(spark, sf_dir, "customer").select("c_custkey", F.element_at(m, "a").alias("a"))


@register("small_texts", r"""
SELECT c_custkey, 'x' || c_custkey || 'y' AS plain, lpad(CAST(c_custkey // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(c_custkey % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(c_custkey % 60 AS VARCHAR), 2, '0') || '.250' AS stamp,
  CASE WHEN len(c_name) > 9 THEN c_name[1:4] || '…' || c_name[-4:] ELSE c_name END AS short, CASE WHEN c_custkey % 3 = 0 THEN 'Unsupported language' WHEN c_custkey % 2 = 0 THEN 'Sound buffer duration too short' ELSE '' END AS skipped, c_custkey % 3 <> 0 AS supported,
  round(10 + 20 * greatest(0, least(1, (c_custkey - 50) / 100.0)), 6) AS mapped, CASE c_custkey % 4 WHEN 0 THEN true WHEN 1 THEN c_custkey % 5 <> 0 ELSE false END AS effect, c_custkey % 6 = 0 AS out_of_memory FROM customer
""")
def small_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terminal colours gone, time stamps, shortened names, reasons not to transcribe, a clamped scale, break effects, memory errors."""
    k = F.col("c_custkey")
    language = F.when(k % 3 == 0, "zh-CN").otherwise("de")
    reason = F.when(k % 4 == 0, "xx").when(k % 4 == 1, "x").otherwise("s")
    message = F.when(k % 6 == 0, "CUDA error: out of memory").otherwise("no such file")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", tx.without_ansi(F.concat(F.lit("x\u001b[31m"), k.cast("string"), F.lit("\u001b[0my"))).alias("plain"), tx.stamp(k + 0.25).alias("stamp"), tx.ellipsize_middle(F.col("c_name"), 9).alias("short"),
        lx.skip_reason(F.lit(False), language, k % 2 == 0).alias("skipped"), lx.is_supported(language).alias("supported"), F.round(tl.scaled(k, 50, 150, 10, 30), 6).alias("mapped"), tl.break_effect(reason, k % 5 == 0).alias("effect"), tx.out_of_memory(message).alias("out_of_memory"),
    )


# ---------------------------------------------------------------- chunks and windows

PARAGRAPHS_SQL = r"""
WITH p AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\n]*\n+|[^\n]+$') AS p FROM documents),
q AS (SELECT doc_id, unnest(p) AS t, unnest(range(len(p))) AS i FROM p), r AS (SELECT doc_id, i, t, len(regexp_extract_all(t, '[^BLANK]+')) AS n FROM q)
""".replace("BLANK", WS)


def paragraph_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = documents(spark, sf_dir).select("doc_id", F.posexplode(pr.paragraphs(F.coalesce("text", F.lit("")))).alias("i", "t"))
    return p.withColumn("n", F.size(tx.words_with_space(F.col("t"))))


@register("paragraph_split", PARAGRAPHS_SQL + "SELECT doc_id, count(*) AS n, sha256(string_agg(t, '' ORDER BY i)) AS whole, sha256(string_agg(trim(t, chr(10) || ' ' || chr(9) || chr(11) || chr(12) || chr(13)), '|' ORDER BY i)) AS cores FROM r GROUP BY doc_id")
def paragraph_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs with their line feeds, and without white space around."""
    p = paragraph_rows(spark, sf_dir).withColumn("c", pr.outer_space(F.col("t"))["core"])
    in_order = F.array_sort(F.collect_list(F.struct("i", "t", "c")))
    p = p.groupBy("doc_id").agg(F.count("*").alias("n"), in_order.alias("p"))
    return p.select("doc_id", "n", F.sha2(F.array_join(F.transform("p", lambda x: x["t"]), ""), 256).alias("whole"), F.sha2(F.array_join(F.transform("p", lambda x: x["c"]), "|"), 256).alias("cores"))


@register("forward_windows", PARAGRAPHS_SQL.replace("WITH p", "WITH RECURSIVE p", 1) + """
, m AS MATERIALIZED (SELECT doc_id, i, n FROM r), fill(doc_id, i, w, k, n) AS (
  SELECT doc_id, i, 0, 1, n FROM m WHERE i = 0 UNION ALL
  SELECT m.doc_id, m.i, CASE WHEN k >= 3 OR f.n + m.n > 160 THEN w + 1 ELSE w END, CASE WHEN k >= 3 OR f.n + m.n > 160 THEN 1 ELSE k + 1 END, CASE WHEN k >= 3 OR f.n + m.n > 160 THEN m.n ELSE f.n + m.n END FROM fill f JOIN m ON m.doc_id = f.doc_id AND m.i = f.i + 1
) SELECT doc_id, w AS "window", min(i) AS first, max(i) AS last, max(n) AS n_words FROM fill GROUP BY doc_id, w
""")
def forward_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs in windows of three and 160 words at most."""
    return pr.forward_windows(paragraph_rows(spark, sf_dir), "doc_id", "i", "n")


@register("previous_windows", PARAGRAPHS_SQL + """
, s AS (SELECT doc_id, i, lag(n, 1) OVER w AS a, lag(n, 2) OVER w AS b, lag(n, 3) OVER w AS c FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY i))
SELECT doc_id, i, CASE WHEN a IS NULL THEN 0 WHEN b IS NULL OR a + b > 160 THEN 1 WHEN c IS NULL OR a + b + c > 160 THEN 2 ELSE 3 END AS context FROM s
""")
def previous_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many paragraphs before each one fit its context."""
    return pr.previous_window(paragraph_rows(spark, sf_dir), "doc_id", "i", "n").select("doc_id", "i", "context")


@register("speaker_chunks", """
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations), n AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id) SELECT conv_id, CAST(ceil(n / 2.0) AS BIGINT) AS n_chunks FROM n
""")
def speaker_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as marked text, in chunks of two turns."""
    line = F.concat(F.lit("[SPEAKER_"), F.col("role"), F.lit("] "), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n ")))
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("t")))), lambda x: x["t"]), "\n").alias("t"))
    return t.select("conv_id", F.size(pr.speaker_chunks(F.col("t"), 2)).cast("long").alias("n_chunks"))


@register("word_chunks", """
WITH p AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10) || chr(10))) AS p FROM documents) SELECT doc_id, CAST(sum(ceil(len(string_split(p, ' ')) / 30.0)) AS BIGINT) AS n_chunks, sum(len(p)) + 2 * count(*) - sum(CAST(ceil(len(string_split(p, ' ')) / 30.0) AS BIGINT) - 1) AS n_chars FROM p GROUP BY doc_id
""")
def word_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs in chunks of 30 words."""
    d = documents(spark, sf_dir).select("doc_id", pr.word_chunks(F.coalesce("text", F.lit("")), 30).alias("c"))
    return d.select("doc_id", F.size("c").cast("long").alias("n_chunks"), F.aggregate("c", F.lit(0), lambda a, x: a + F.length(x)).cast("long").alias("n_chars"))


@register("annotation_checks", r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[<>]', '', 'g') AS t FROM documents), p AS (SELECT doc_id, t, doc_id * 7919 % (len(t) + 1) AS k FROM d),
c AS (SELECT doc_id, t, t[:k] || CASE WHEN doc_id % 3 = 0 THEN '#' ELSE '' END || t[k + 1:] AS p FROM p)
SELECT doc_id, t = p AS same, CASE WHEN t = p THEN -1 ELSE list_position(list_transform(list_zip(string_split(t, ''), string_split(p, '')), lambda z: z[1] IS NOT DISTINCT FROM z[2]), false) - 1 END AS differs_at FROM c
""")
def annotation_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated text against the text, one in three with a sign too many somewhere."""
    d = documents(spark, sf_dir).select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), "[<>]", "").alias("t"))
    at = (F.col("doc_id") * 7919 % (F.length("t") + 1)).cast("int")
    annotated = F.concat(F.lit("<b>"), F.substring(F.col("t"), F.lit(1), at), F.lit("</b><pause s=1>"), F.when(F.col("doc_id") % 3 == 0, "#").otherwise(""), F.substring(F.col("t"), at + 1, F.length("t")))
    d = d.select("doc_id", "t", pr.without_markup(annotated).alias("p"))
    return d.select("doc_id", (F.col("t") == F.col("p")).alias("same"), pr.first_difference(F.col("t"), F.col("p")).alias("differs_at"))


@register("model_types", """
WITH m AS (SELECT DISTINCT p_brand || '/' || p_type AS id FROM part), c(o, part, type) AS (VALUES (0, 'BRAND', 'any'), (1, 'brand#1', 'one'), (2, 'PROMO', 'promo'), (3, '', 'none')),
h AS (SELECT id, type, row_number() OVER (PARTITION BY id ORDER BY len(part) DESC, o) AS k FROM m JOIN c ON part <> '' AND contains(lower(id), lower(part)))
SELECT m.id, h.type FROM m LEFT JOIN h ON m.id = h.id AND k = 1
""")
def model_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type of each model, by the longest known part of its name."""
    m = table(spark, sf_dir, "part").select(F.concat("p_brand", F.lit("/"), "p_type").alias("id")).distinct()
    c = spark.createDataFrame([(0, "BRAND", "any"), (1, "brand#1", "one"), (2, "PROMO", "promo"), (3, "", "none")], "o int, part string, type string")
    return pr.model_type(m, c, "id", "part", "o")


@register("probable_words", """
WITH w AS (SELECT user_id, event_id, event_type AS word, value AS p FROM events)
SELECT user_id, string_agg(word, ' ' ORDER BY event_id) AS transcript FROM w WHERE p >= 5 GROUP BY user_id
""")
def probable_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts of the words that are probable enough."""
    w = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", F.col("event_type").alias("word"), F.col("value").alias("probability")))).alias("words"))
    return w.select("user_id", tx.transcript(F.col("words"), 5.0).alias("transcript")).where("transcript <> ''")


# ---------------------------------------------------------------- letters, sounds and numbers in words


@register("plain_letters", "SELECT doc_id, sha256(replace(replace(strip_accents(replace(replace(coalesce(text, ''), 'ñ', chr(1)), 'Ñ', chr(2))), chr(1), 'ñ'), chr(2), 'Ñ')) AS plain FROM documents")
def plain_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without diacritics, but for ñ."""
    d = documents(spark, sf_dir).select("doc_id", tx.without_marks(F.coalesce("text", F.lit(""))).alias("t"))
    return d.select("doc_id", F.sha2("t", 256).alias("plain"))


@register("spanish_numbers")
def spanish_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number words among others, to digits, with the runs they were found in (a parser; held against literal cases)."""
    small = F.array(*map(F.lit, ("dos", "treinta y uno", "cien", "mil quinientos", "uno", "segundo", "veintidós", "dos coma cinco")))
    k = F.col("o_orderkey") % 8
    text = F.concat(F.lit("hay "), F.get(small, k.cast("int")), F.lit(" de ellos, número "), F.get(small, ((k + 3) % 8).cast("int")), F.lit("."))
    o = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("t"))
    return o.select("o_orderkey", "t", numbers.spanish_digits(F.col("t")).alias("digits"), F.size(numbers.number_runs(F.split("t", " "))).alias("n_runs"))


@register("edge_words", """
WITH w AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'), ' ') AS w FROM documents) SELECT a.doc_id, a.w[1] = b.w[1] AND a.w[-1] = b.w[-1] AS same FROM w a JOIN w b ON b.doc_id = a.doc_id + 1
""".replace("\\\\", "\\"))
def edge_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a text begins and ends with the same words as the next document."""
    w = documents(spark, sf_dir).select("doc_id", F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\t\n\f\r ]+", " "), " ").alias("w"))
    after = w.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("x"))
    return w.join(after, "doc_id").select("doc_id", al.same_edges(F.col("w"), F.col("x")).alias("same"))


@register("spacing_repair", "SELECT item_id, sha256(t) AS repaired FROM (SELECT item_id, trim(regexp_replace(coalesce(text, ''), '[WS]+', ' ', 'g')) AS t FROM benchmark)".replace("WS", WS))
def spacing_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts that lack each fifth blank get their source's blanks back."""
    b = table(spark, sf_dir, "benchmark").select("item_id", tx.collapse_space(F.coalesce("text", F.lit(""))).alias("t"))
    merged = F.array_join(F.transform(F.split("t", " "), lambda w, i: F.when(i == 0, w).when(i % 5 == 4, w).otherwise(F.concat(F.lit(" "), w))), "")
    return b.select("item_id", F.sha2(al.respaced(F.col("t"), merged), 256).alias("repaired"))
