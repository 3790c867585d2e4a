"""The registered queries against DuckDB on the smallest tables, and operators on literal cases."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from folioforge import queries
from folioforge.functions import names, text
from folioforge.operators import catalog, schedule, segmentation, timeline

SF = "/root/testdata/sf0.001"


def shown(v):
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    found = duck.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    got = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    assert got == sorted(tuple(map(shown, r)) for r in found.fetchall())


def test_packed_groups(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    words = {}
    for r in sorted(segmentation.phrases(docs).collect(), key=lambda r: (r.doc_id, r.sentence_index, r.phrase_index)):
        words.setdefault(r.doc_id, []).append(r.n_words)
    want = {}
    for d, w in words.items():
        groups, now = [], 0
        for n in w:
            if now and now + n > 40:
                groups, now = [*groups, now], 0
            now += n
        want[d] = (len(groups) + (now > 0), max([*groups, now]))
    assert {r.doc_id: (r.n_groups, r.most_words) for r in queries.queries()["packed_groups"](spark, SF).collect()} == want


def phrase_rows(spark, t):
    df = segmentation.phrases(spark.createDataFrame([(1, t)], "doc_id long, text string"))
    return sorted(df.collect(), key=lambda r: (r.sentence_index, r.phrase_index))


def test_phrases_of_literal_texts(spark):
    assert [r.text for r in phrase_rows(spark, "Yes. Run. They went home late.")] == ["Yes. ", "Run. ", "They went home late."]
    assert [r.reason for r in phrase_rows(spark, "Chapter 1\n\n\nThe start, then\n\nProse (so) starts here.")] == ["x", "is", "p", "is", "is", "s"]
    assert phrase_rows(spark, "") == [] and [r.text for r in phrase_rows(spark, "...")] == ["..."]


def test_phrases_keep_every_character(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text <> ''")
    rows = {}
    for r in sorted(segmentation.phrases(docs).collect(), key=lambda r: (r.doc_id, r.sentence_index, r.phrase_index)):
        rows[r.doc_id] = rows.get(r.doc_id, "") + r.text
    assert rows == {r.doc_id: r.t for r in docs.select("doc_id", text.clean_line_ends(F.col("text")).alias("t")).collect()}


def test_ranges(spark):
    cases = [("a", "", 3), ("b", "none", 3), ("c", "2-3", 3), ("d", "2, 9-99", 12), ("e", "5-3, x", 9), ("f", "all", 2), ("g", None, 1)]
    got = {}
    for r in names.parse_ranges(spark.createDataFrame(cases, "k string, v string, n int"), "k", "v", "n").collect():
        got.setdefault(r.k, set()).add(r["index"])
    assert got == {"a": {0, 1, 2}, "c": {1, 2}, "d": {1, 8, 9, 10, 11}, "f": {0, 1}, "g": {0}}
    one = names.compact_ranges(spark.createDataFrame([("k", i) for i in (0, 2, 3, 4, 8, 8)], "k string, index int"), "k").first()
    assert one.ranges == "1, 3-5, 9"


def test_voices_and_thresholds(spark):
    rows = [(1, v) for v in ("zeta", "alpha", "belle")] + [(2, v) for v in ("none", "none", "none", "belle", "belle", "other")] + [(3, "none")]
    got = {r.k: (r.v, r.others) for r in catalog.mode_of_tags(spark.createDataFrame(rows, "k int, v string"), "k", "v").collect()}
    assert got == {1: ("alpha", 2), 2: ("belle", 1), 3: ("none", 0)}
    t = spark.createDataFrame([(25, s) for s in ("low", "moderate", "high", "intolerant")], "n int, s string").select("s", catalog.threshold(F.col("n"), F.col("s")).alias("t"))
    assert dict(map(tuple, t.collect())) == {"low": 4, "moderate": 3, "high": 2, "intolerant": 0}
    d = spark.createDataFrame([(3.75,), (3.76,)], "d double").select(catalog.too_long(F.col("d"), F.lit(3), F.lit(False)).alias("x"))
    assert [r.x for r in d.collect()] == [False, True]


def test_sections_and_schedule(spark):
    s = timeline.section_ranges(spark.createDataFrame([("b", 0, 2), ("b", 1, 1), ("b", 2, 2)], "k string, i int, n int"), "k", "i", "n")
    assert sorted((r.start_index, r.end_index) for r in s.collect()) == [(0, 2), (2, 3), (3, 5)]
    items = spark.createDataFrame([("k", i, i % 2) for i in range(24)], "key string, idx int, voice int")
    got = schedule.voice_rounds(items, "key", "idx", "voice", 2, 2).collect()
    assert len(got) == 24 and {r.window for r in got} == {0, 1}
    for r in {(r.window, r.pile, r.sub_batch) for r in got}:
        assert len({x.voice for x in got if (x.window, x.pile, x.sub_batch) == r}) == 1


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["doc_id", "reason", "n", "words"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_previews_of_all_documents(spark):
    from folioforge.plans import text_queries

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert queries.queries()["text_previews"](spark, SF).count() == docs.count()
    rows = [(1, "en-US", "short", 59), (2, "DE ", "x" * 60, 60), (3, "en", "y " * 40, 3599), (4, "en", None, 3600), (5, "en", "", 0), (6, None, "a\n b", None)]
    got = {r.doc_id: (r.language, r.preview, r.length_clock) for r in text_queries.previews(spark.createDataFrame(rows, "doc_id long, lang string, text string, n_chars long")).collect()}
    assert {k: v[2] for k, v in got.items()} == {1: "0:59", 2: "1:00", 3: "59:59", 4: "1:00:00", 5: "0:00", 6: None}
    assert got[1][:2] == ("en", "short") and got[2][:2] == ("de", "x" * 60) and got[3][1] == ("y " * 29).strip()[:57].rstrip() + "..." and got[6][1] == "a b"
