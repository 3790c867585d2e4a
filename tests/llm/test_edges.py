"""Nulls, empty tables, repeated rows and clashing names in every operator, and rules on labels they have not seen."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folioforge.llm import bpe, chat_format, decontaminate, licence_scan, minhash, quality_rules, queries, suffix_merge, suffix_tree, url_filter, warc

LONG = " ".join(f"w{i}" for i in range(400))
DOCS = [(1, LONG), (None, LONG), (2, None), (3, ""), (4, " \n"), (5, LONG), (5, LONG), (6, "short text here"), (None, None), (7, LONG + " " + LONG)]
CLASH = "id component component_id a b size n keys class kept rule verdict host path start end distance spans n_words n_removed text_b shingles block bucket".split()


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string")
    return df.withColumns({c: F.lit("mine") for c in CLASH})


def test_near_duplicates_of_odd_rows(spark, docs):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()), key=str)
    assert len(got) == len(DOCS) and (5, 396, 1, False) in got and (1, 396, 1, True) in got and (2, 0, 2, True) in got
    assert all(c is None for d, n, c, k in got if d is None and n == 0)
    assert minhash.drop_near_duplicates(docs).columns == docs.columns


def test_repeats_of_odd_rows(spark, docs):
    words = {(r.doc_id, r.n_words, r.n_removed) for r in suffix_tree.remove_repeated_passages(docs).collect()}
    assert {(1, 400, 0), (5, 400, 400), (2, 0, 0), (6, 3, 0)} <= words
    sizes = {(r.doc_id, r.n_bytes, r.n_removed) for r in suffix_merge.remove_repeated_bytes(docs).collect()}
    assert {(1, len(LONG), 0), (5, len(LONG), len(LONG)), (2, 0, 0)} <= sizes


def test_leaks_of_odd_rows(spark, docs):
    item = " ".join(LONG.split()[50:80])
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (None, item), (3, "")], "item_id long, text string").withColumns({c: F.lit("x") for c in ("doc_id", "start", "distance")})
    got = decontaminate.find_leaks(docs, bench).collect()
    assert {r.doc_id for r in got} == {1, 5, 7, None} and len([r for r in got if r.doc_id == 1]) == 3
    left = decontaminate.without_leaks(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {2, 3, 4, 6, None}
    assert decontaminate.find_leaks(docs.limit(0), bench).count() == 0


def test_other_operators_on_odd_rows(spark, docs, tmp_path):
    u = spark.createDataFrame([(None, None, 1), (1, "http://a.com/en/1", 2), (1, "http://a.com/en/1", 2)], "page_id long, url string, x int").withColumns({c: F.lit("old") for c in ("host", "path", "verdict", "suffix", "rule")})
    tie = [url_filter.UrlRule("allow", "com", "/en/"), url_filter.UrlRule("block", "a.com", "/e")]
    for bound in (64 << 20, 0):
        got = url_filter.filter_urls(u, tie, max_broadcast_bytes=bound).collect()
        assert len(got) == 3 and len({(r.rule, r.verdict) for r in got if r.page_id == 1}) == 1
    assert bpe.encode_texts(docs, queries.tokenizer_file(), digest=queries.bpe_digest, digest_schema=queries.BPE_DIGEST).count() == len(DOCS)
    assert bpe.encode_texts(docs.limit(0), queries.tokenizer_file(), digest=queries.bpe_digest, digest_schema=queries.BPE_DIGEST).count() == 0
    chats = spark.createDataFrame([(1, 0, None, None), (1, 0, "user", "hi"), (None, 1, "assistant", "x" * 50_000)], "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("window", "formatted", "t", "s", "n")})
    back = chat_format.read_chats(chat_format.format_chats(chats)).collect()
    assert {r.conv_id: len(r.turns) for r in back} == {1: 2, None: 1} and chat_format.format_chats(chats.limit(0)).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    folder, _ = warc.archive_pages(pages, folder=f"file://{tmp_path}/w")
    assert warc.read_warc(spark, folder).count() == 0
    files = docs.limit(0).select("doc_id", F.col("path"), "text")
    assert licence_scan.scan_licences(files).count() == 0


def test_rules_on_labels_not_seen(spark):
    sf = "/root/testdata/sf0.1"
    documents, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    seen = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)
    judged, _ = quality_rules.judge(documents, seen, keep=["doc_id"])
    unseen = judged.join(labels.join(seen, "doc_id", "left_anti"), "doc_id").where("not base_failed")
    bad, caught, clean, lost = unseen.agg(*[F.count_if(F.expr(e)) for e in ("quality = 0", "quality = 0 and not kept", "quality = 1", "quality = 1 and not kept")]).first()
    assert bad and caught / bad > 0.8 and lost / clean < 0.02, (bad, caught, clean, lost)


def test_base_rule_by_hand(spark):
    texts = {1: "a b c " * 30, 2: " ".join(f"v{i}" for i in range(60)), 3: " ".join(f"v{i}" for i in range(49)), 4: None, 5: " ".join(f"v{i % 40}" for i in range(60)), 6: " ".join(f"v{i % 55}" for i in range(70))}
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame([*texts.items(), (2, texts[2])], "doc_id long, text string")
    got = [(r.doc_id, r.base_failed, r.kept) for r in quality_rules.judge(df, labels)[0].collect()]

    def failed(t):
        w = (t or "").split()
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        repeated = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 3)}
        return len(w) < 50 or 100 * len(repeated) > 50 * len(w)

    assert sorted(got) == sorted((i, failed(t), not failed(t)) for i, t in [*texts.items(), (2, texts[2])])


def test_pipeline_stages_of_odd_rows(spark):
    sf = "/root/testdata/sf0.001"
    odd = spark.createDataFrame([(i, t, "en", "web", None, "mine") for i, t in DOCS], "doc_id long, text string, lang string, source string, n_chars long, kept string")
    for frame in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, sf)
            assert out.columns == frame.columns
            assert {tuple(r) for r in out.select("kept", "lang", "source").collect()} == ({("mine", "en", "web")} if frame is odd else set())
        assert corpus_pipeline.STAGES[-1][1](spark, frame, sf).count() == frame.count()
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, odd, sf).collect()}
    assert 1 in kept and 6 not in kept
