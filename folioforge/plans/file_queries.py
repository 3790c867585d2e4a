"""Queries on folders of files that Spark writes from the tables: texts, EPUB files, projects, takes and their sidecars, lists."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from folioforge.functions import contracts as ct
from folioforge.functions import names
from folioforge.functions import text as tx
from folioforge.plans.audio_queries import written
from folioforge.plans.text_queries import documents
from folioforge.registry import register, table
from folioforge.sources import epub, files, takes


def utf8(c: F.Column) -> F.Column:
    return F.encode(c, "UTF-8")


@register("text_books", "SELECT 'Text ' || doc_id || '.b' AS title, sha256(text) AS text FROM documents WHERE text <> ''")
def text_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as files of three encodings, read back with the file's stem as title."""
    d = documents(spark, sf_dir).where("text <> ''")
    k = F.col("doc_id") % 3
    data = F.when(k == 0, utf8(F.col("text"))).when(k == 1, F.encode("text", "UTF-16")).otherwise(F.concat(F.lit(b"\xef\xbb\xbf"), utf8(F.col("text"))))
    folder = written(d.select(F.concat(F.lit("Text "), F.col("doc_id").cast("string"), F.lit(".b.txt")).alias("file"), data.alias("content")), "texts")
    return files.text_books(spark, folder).select("title", F.sha2("text", 256).alias("text"))


@F.pandas_udf(BinaryType())
def _epub(title: pd.Series, chapters: pd.Series) -> pd.Series:
    """EPUB files of chapters (id, html), with a blank first title and a table of contents that names every second chapter."""

    def one(name: str, parts) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("META-INF/container.xml", '<container xmlns="c"><rootfiles><rootfile full-path="in/p.opf"/></rootfiles></container>')
            items = "".join(f'<item id="c{x["id"]}" href="c%20{x["id"]}.xhtml" media-type="application/xhtml+xml"/>' for x in parts)
            refs = "".join(f'<itemref idref="c{x["id"]}"/>' for x in parts)
            z.writestr("in/p.opf", f'<package xmlns:dc="d"><metadata><dc:title> </dc:title><dc:title>{name}</dc:title></metadata><manifest>{items}<item id="n" href="n.ncx" media-type="application/x-dtbncx+xml"/></manifest><spine>{refs}<itemref idref="gone"/></spine></package>')
            points = "".join(f'<navPoint><navLabel><text>Part {x["id"]}</text></navLabel><content src="./c%20{x["id"]}.xhtml#a"/></navPoint>' for x in parts if x["id"] % 2 == 0)
            z.writestr("in/n.ncx", f"<ncx>{points}</ncx>")
            for x in parts:
                z.writestr(f"in/c {x['id']}.xhtml", x["html"])
        return out.getvalue()

    return pd.Series([one(t, c) for t, c in zip(title, chapters, strict=True)])


@register("epub_chapters", """
SELECT 'b' || page_id // 10 || '.epub' AS book, 'Book ' || page_id // 10 AS book_title, row_number() OVER (PARTITION BY page_id // 10 ORDER BY page_id) - 1 AS ord, 'c ' || page_id || '.xhtml' AS href, CASE WHEN page_id % 2 = 0 THEN 'Part ' || page_id END AS contents_title, sha256(coalesce(html, '')) AS html FROM pages
""")
def epub_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as chapters of EPUB files: the spine's order, the book's first title with text, titles of the table of contents."""
    from folioforge.operators import pages as pg

    p = table(spark, sf_dir, "pages").groupBy(F.floor(F.col("page_id") / 10).alias("b")).agg(F.array_sort(F.collect_list(F.struct(F.col("page_id").alias("id"), F.coalesce("html", F.lit("")).alias("html")))).alias("c"))
    b = F.col("b").cast("string")
    folder = written(p.select(F.concat(F.lit("b"), b, F.lit(".epub")).alias("file"), _epub(F.concat(F.lit("Book "), b), F.col("c")).alias("content")), "epub")
    found = epub.parts(spark, folder)
    c = found.where("kind = 'chapter'").drop("title").join(epub.book_titles(found).withColumnRenamed("title", "book_title"), "book")
    c = pg.with_contents_titles(c, found.where("kind = 'contents'").select("book", F.col("href").alias("h"), F.col("title").alias("t"), F.col("ord").alias("o")), "book", "href", "h", "t", "o")
    return c.select("book", "book_title", F.col("ord").cast("long").alias("ord"), "href", "contents_title", F.sha2("html", 256).alias("html"))


@register("project_folders", """
WITH o AS (SELECT o_custkey AS k, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY 1)
SELECT 'p' || k AS project, CASE k % 4 WHEN 1 THEN 'settings' WHEN 2 THEN 'text missing' WHEN 3 THEN 'format' END AS error, CASE WHEN k % 4 <> 1 THEN 'v' || first END AS voice, CASE WHEN k % 4 < 2 THEN n END AS n_groups FROM o
""")
def project_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects with settings and text in a folder each: what is no JSON, missing or of another format is said."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))
    name, kind = F.concat(F.lit("p"), F.col("k").cast("string")), F.col("k") % 4
    settings = F.when(kind == 1, '{"voice": ').otherwise(F.to_json(F.struct(F.concat(F.lit("v"), F.col("first").cast("string")).alias("voice"))))
    groups = F.transform(F.sequence(F.lit(1).cast("long"), F.col("n")), lambda i: F.array(F.struct(i.cast("string").alias("text"), F.lit("p").alias("reason"))))
    body = F.when(kind == 3, '{"format": "odd"}').otherwise(F.to_json(F.struct(F.lit("phrase_groups.v1").alias("format"), groups.alias("phrase_groups"))))
    a = o.select(F.concat(name, F.lit("/project.json")).alias("file"), utf8(settings).alias("content"))
    b = o.where(kind != 2).select(F.concat(name, F.lit("/project_text.json")).alias("file"), utf8(body).alias("content"))
    p = takes.projects(spark, written(a.unionByName(b), "projects"))
    return p.select("project", "error", ct.get(F.col("settings"), "$.voice", "string").alias("voice"), F.size(F.col("book.sections")[0]["phrase_groups"]).cast("long").alias("n_groups"))


@register("folder_catalog", """
WITH t AS (SELECT p_partkey - 1 AS idx, p_partkey % 3 AS kind, p_partkey % 7 AS e FROM part) SELECT idx, CASE WHEN kind = 1 THEN 'm1' ELSE '' END AS model, CASE WHEN e > 0 THEN e ELSE -1 END AS errors, CASE WHEN e % 2 = 0 THEN 1 END AS n_phrases FROM t WHERE kind > 0
""")
def folder_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Takes in a folder, a third of them of an older text, some with sidecars: those of present lines with their phrases."""
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") - 1).alias("index"), F.col("p_name").alias("text"), (F.col("p_partkey") % 3).alias("kind"), (F.col("p_partkey") % 7).alias("e"))
    stale = F.when(F.col("kind") == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    stem = F.concat(F.format_string("[%05d] [", F.col("index") + 1), names.content_hash(F.col("index"), stale), F.lit("] ["), F.when(F.col("kind") == 1, "m1").otherwise("m9"), F.lit("] [v] "), F.when(F.col("e") > 0, F.concat(F.lit("["), F.col("e").cast("string"), F.lit("] "))).otherwise(""), F.lit("t"))
    t = p.withColumn("stem", stem)
    phrases = F.to_json(F.array(F.struct(F.col("text").alias("text"), F.lit(0.0).alias("time_start"), F.lit(1.5).alias("time_end"))))
    side = t.where("e % 2 = 0").select(F.concat("stem", F.lit(".json")).alias("file"), utf8(phrases).alias("content"))
    odd = t.limit(3).select(F.concat(F.lit("note "), F.col("index").cast("string"), F.lit(".flac")).alias("file"), F.lit(b"x").alias("content"))
    folder = written(t.select(F.concat("stem", F.lit(".flac")).alias("file"), F.lit(b"x").alias("content")).unionByName(side).unionByName(odd), "takes")
    c = takes.with_sidecars(takes.catalog(spark, folder, p.select("index", "text"), ["m1"]), takes.sidecars(spark, folder))
    return c.select(F.col("index").cast("long").alias("idx"), "model", "errors", F.when(F.col("phrases").isNotNull(), F.size("phrases")).alias("n_phrases"))


@register("concat_lists", "SELECT 'part ' || p_partkey || '.flac' AS file, row_number() OVER (ORDER BY p_partkey) - 1 AS position FROM part")
def concat_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder's files in natural order, as a list to join them."""
    f = table(spark, sf_dir, "part").select(F.concat(F.lit("part "), F.col("p_partkey").cast("string"), F.lit(".flac")).alias("file"), F.lit(b"x").alias("content"))
    m = files.ordered_manifest(spark, written(f, "parts"), "*.flac")
    return m.select("file", F.col("position").cast("long").alias("position"))


@register("word_list_files", r"""
WITH w AS (SELECT DISTINCT doc_id % 7 AS list, unnest(regexp_extract_all(coalesce(text, ''), '[^BLANK]+')) AS word FROM documents) SELECT word, count(*) AS n_lists, regexp_full_match(word, '[a-z]+') AS good FROM w GROUP BY word
""".replace("BLANK", tx.SPACE))
def word_list_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words as lines of list files, read back and parted by a pattern."""
    w = documents(spark, sf_dir).select((F.col("doc_id") % 7).alias("list"), F.explode(F.transform(tx.words_with_space(F.coalesce("text", F.lit(""))), lambda x: F.rtrim(x, F.lit(tx._BLANKS)))).alias("word")).distinct()
    lines = w.groupBy("list").agg(F.array_join(F.collect_list(F.concat(F.lit(" "), "word")), "\n\n").alias("t"))
    folder = written(lines.select(F.concat(F.lit("w"), F.col("list").cast("string"), F.lit(".txt")).alias("file"), utf8(F.col("t")).alias("content")), "lists")
    good, bad = files.word_lists(spark, folder, "^[a-z]+$")
    both = good.withColumn("good", F.lit(True)).unionByName(bad.withColumn("good", F.lit(False)))
    return both.groupBy("word", "good").agg(F.count("*").alias("n_lists"))


@register("quarantined_files", "SELECT 'o' || o_orderkey || '.json' AS file, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END AS customer, o_orderkey % 5 = 0 AS quarantined FROM orders WHERE o_orderkey % 8 = 0")
def quarantined_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON files, one in five of them broken: what is read, and what goes to quarantine."""
    o = table(spark, sf_dir, "orders").where("o_orderkey % 8 = 0")
    body = F.when(F.col("o_orderkey") % 5 == 0, '{"customer": ').otherwise(F.to_json(F.struct(F.col("o_custkey").alias("customer"))))
    folder = written(o.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string"), F.lit(".json")).alias("file"), utf8(body).alias("content")), "json")
    good, bad = files.json_documents(spark, folder)
    return good.select("file", ct.get(F.col("v"), "$.customer", "bigint").alias("customer"), F.lit(False).alias("quarantined")).unionByName(bad.select("file", F.lit(None).cast("long").alias("customer"), F.lit(True).alias("quarantined")))


@F.pandas_udf(StringType())
def _deflated(c: pd.Series) -> pd.Series:
    import base64
    import zlib

    return c.map(lambda t: base64.urlsafe_b64encode(zlib.compress(t.encode())).decode().rstrip("="))


@register("inflated_texts", "SELECT doc_id, sha256(CASE WHEN doc_id % 9 = 0 THEN '' ELSE coalesce(text, '') END) AS text FROM documents")
def inflated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as older metadata holds them, deflated and in base64 (one in nine spoiled), read back."""
    packed = _deflated(F.coalesce("text", F.lit("")))
    d = documents(spark, sf_dir).select("doc_id", packed.alias("p")).select("doc_id", F.when(F.col("doc_id") % 9 == 0, F.expr("substring(p, 5)")).otherwise(F.col("p")).alias("p"))
    return d.select("doc_id", F.sha2(ct.inflated(F.col("p")), 256).alias("text"))


@register("transferred_settings", """
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS voice, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey END AS words, CAST(c_custkey % 2 = 0 AS INT) + CAST(c_custkey % 3 = 0 AS INT) AS n FROM customer
""")
def transferred_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings that move to another project: the named ones that are there, and no others."""
    k = F.col("c_custkey")
    body = F.to_json(F.struct(F.when(k % 2 == 0, F.col("c_name")).alias("voice"), F.when(k % 3 == 0, F.col("c_nationkey")).alias("words"), F.lit("secret").alias("folder")))
    m = table(spark, sf_dir, "customer").select("c_custkey", ct.transferred(F.try_parse_json(body), ["voice", "words", "absent"]).alias("m"))
    return m.select("c_custkey", ct.get(F.element_at("m", "voice"), "$", "string").alias("voice"), ct.get(F.element_at("m", "words"), "$", "int").alias("words"), F.size("m").alias("n"))


@register("stable_identities", "SELECT c_custkey, true AS same FROM customer")
def stable_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities of JSON documents whatever the order of their keys and their white space."""
    n, k = F.col("c_name"), F.col("c_custkey").cast("string")
    a = F.concat(F.lit('{"b": '), k, F.lit(', "a": {"y": [1, 2], "x": "'), n, F.lit('"}}'))
    b = F.concat(F.lit('{"a":{"x":"'), n, F.lit('","y":[1,2]}, "b":'), k, F.lit("}"))
    identity = lambda j: ct.fnv1a(ct.stable_json(F.try_parse_json(j)))
    c = table(spark, sf_dir, "customer").select("c_custkey", identity(a).alias("a"), identity(b).alias("b"))
    return c.select("c_custkey", (F.col("a") == F.col("b")).alias("same"))


@register("lowered_openings", r"""
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'THE BIG 2 BAD ' ELSE 'THE BIG ' END || regexp_replace(coalesce(text, ''), '^[BLANK]+', '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^BLANK]+[BLANK]*') AS w FROM d), f AS (SELECT *, coalesce(list_position(list_transform(w, lambda x: regexp_matches(x, '\p{Ll}')), true) - 1, len(w)) AS k FROM w)
SELECT doc_id, sha256(CASE WHEN len(list_filter(w[1:k], lambda x: regexp_matches(x, '\p{L}'))) < 3 THEN t ELSE lower(array_to_string(w[1:k], '')) || array_to_string(w[k + 1:], '') END) AS t FROM f
""".replace("BLANK", tx.SPACE).replace("\\\\p", "\\p"))
def lowered_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that open in capitals: with three such words they become small."""
    t = F.regexp_replace(F.coalesce("text", F.lit("")), f"^[{tx.SPACE}]+", "")
    d = documents(spark, sf_dir).select("doc_id", F.concat(F.when(F.col("doc_id") % 2 == 0, "THE BIG 2 BAD ").otherwise("THE BIG "), t).alias("t"))
    return d.select("doc_id", F.sha2(tx.lower_opening(F.col("t")), 256).alias("t"))
