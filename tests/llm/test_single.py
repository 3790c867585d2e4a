"""URL filters, archives, tokens, quality rules and chats against brute force on small fixtures."""

import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioforge.llm import bpe, chat_format, quality_rules, queries, url_filter, warc

SF = "/root/testdata/sf0.001"
sha = lambda s: hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ------------------------------------------------------------------ url filters

URLS = [None, "", "no scheme", "http://", "https://EXAMPLE.com/en/7", "http://a.example.com/en/77?x", "http://x.com/en/1#a", "http://xcom/en/1", "ftp://q.net/de/8", "http://q.example.net/de/81", "http://w.org/es/", "http://w.org/es", "http://b.org?/es/", "http://a://b.org/es/", "http://É.com/en/"]


def by_hand(url):
    host = path = ""
    if url and "://" in url:
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]
    fits = [r for r in queries.URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: r.rank, default=None)
    return host, path, best and best.name, best.verdict if best else "allow"


@pytest.mark.parametrize("bound", [64 << 20, 0])
def test_urls_by_trie_and_by_join(spark, bound):
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(URLS)] + [(0, None, "x")], "page_id long, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df, queries.URL_RULES, max_broadcast_bytes=bound).collect()}
    assert got == {i: by_hand(u) for i, u in enumerate(URLS)}


def test_urls_of_an_empty_table(spark):
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string"), []).count() == 0


# ------------------------------------------------------------------ archives


def test_archive_round_trip(spark, tmp_path):
    big = "é" * 80
    rows = [(5, "http://a/\r\nX: y", big), (2, None, big), (9, "u", big), (3, "u", None), (4, "u", ""), (7, "u", "short"), (8, "u", "short"), (8, "u", "short"), (None, "n", big), (11, "u", "\r\n\r\nWARC/1.1" * 20), (2, "again", "other" * 40), (12, "z", "other" * 40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder, manifest = warc.archive_pages(df, folder=f"file://{tmp_path}/w", roll_bytes=600)
    lines = manifest.collect()
    assert sum(r.records for r in lines) == len(rows) and len(lines) > 3
    for r in lines:
        assert sha((tmp_path / "w" / r.file).read_bytes()) == r.sha256 and (tmp_path / "w" / r.file).stat().st_size == r.file_bytes
    got = sorted((r.id is not None, r.id, r.payload_digest, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_warc(spark, folder).collect() if r.block_ok)

    def kind(i, html):
        same = [j for j, _, h in rows if (h or "") == (html or "") and j is not None]
        revisit = i is not None and len((html or "").encode()) >= 100 and i > min(same)
        return ("revisit", min(same)) if revisit else ("response", None)

    assert got == sorted((i is not None, i, sha(h or ""), len((h or "").encode()), *kind(i, h)) for i, _, h in rows)


def test_archive_is_the_same_twice(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    a, b = ({(r.file, r.sha256) for r in warc.archive_pages(pages, folder=f"file://{tmp_path}/{x}")[1].collect()} for x in "ab")
    assert a == b and a


def test_archive_of_ties_and_of_a_late_attempt(spark, tmp_path):
    rows = [(1, "http://a", f"page {k:03} " * 20) for k in range(40)]  # equal in id, url and length
    found = []
    for x, parts in (("a", 1), ("b", 3)):
        df = spark.createDataFrame(rows if x == "a" else rows[::-1], "page_id long, url string, html string").repartition(parts)
        folder, manifest = warc.archive_pages(df, folder=f"file://{tmp_path}/{x}", roll_bytes=1500)
        found.append([(r.file, r.sha256) for r in manifest.orderBy("shard", "seq").collect()])
    assert found[0] == found[1] and len(found[0]) > 1
    before = {f.name: f.read_bytes() for f in (tmp_path / "a").glob("*.gz")}
    warc.archive_pages(df, folder=f"file://{tmp_path}/a", roll_bytes=1500)  # all tasks once more, in the same folder
    assert {f.name: f.read_bytes() for f in (tmp_path / "a").glob("*.gz")} == before
    assert warc.read_warc(spark, f"file://{tmp_path}/a").where("block_ok").count() == len(rows)


# ------------------------------------------------------------------ tokens


@pytest.fixture(scope="module")
def hf():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


ODD = ["", " ", "a" * 5000, " " * 3000 + "x", "\n \n" * 700, "日本語" * 900, "it's we'll " * 300, "<|endoftext|>x<|endoftext|>" * 90, "!!'s" * 800, "ab" * 2000 + "é" * 999, "🙂‍🙂" * 500, "x" * 2047 + "<|endoftext|>" + " " * 50]


def test_bpe_equals_the_library(spark, hf):
    rng = random.Random(5)
    alphabet = ["a", "the", " ", "  ", "\n", "é", "日", "'s", "'", "!", "<|endoftext|>", "9", "\t", "🙂"]
    texts = ODD + ["".join(rng.choices(alphabet, k=rng.randint(1, 4000))) for _ in range(40)] + [None]
    df = spark.createDataFrame(list(enumerate(texts)) + [(0, "repeated row")], "doc_id long, text string")
    for leaf in (100, 1000, 1 << 15):
        enc = bpe.encode_texts(df, queries.tokenizer_file(), leaf_chars=leaf)
        got = sorted((r.doc_id, tuple(bpe.unpack(r.ids))) for r in enc.collect())
        assert got == sorted((i, tuple(hf.encode(t or "", add_special_tokens=False).ids)) for i, t in [*enumerate(texts), (0, "repeated row")])
    back = sorted((r.doc_id, r.text) for r in bpe.decode_ids(enc, queries.tokenizer_file()).collect())
    assert back == sorted((i, hf.decode(hf.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)) for i, t in [*enumerate(texts), (0, "repeated row")])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab '\n\ts!é日9<|>endoftext🙂", max_size=300), st.integers(0, 300))
def test_join_of_any_cut(text, cut):
    v = bpe.vocabulary(queries.tokenizer_file())
    assert v.join(v.encode(text[:cut]), v.encode(text[cut:])) == v.encode(text)


# ------------------------------------------------------------------ quality rules


def stats_by_hand(text):
    w = WORD.findall(text or "")
    grams = {}
    for i in range(len(w) - 2):
        grams.setdefault(tuple(w[i : i + 3]), []).append(i)
    inside = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside)


def test_statistics(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts += [None, "", " \n\t", "a b c a b c", "a a a a", "x\u00a0y z\n\n x\u00a0y z\n", "one", "l\nl\nl \n\nl", "a b c x a b c y a b", "# $ | <>\x0b\x0cq"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_words", F.lit(-1))
    got = {r.doc_id: tuple(r[c] for c in quality_rules.BASE) for r in quality_rules.statistics(df).collect()}
    assert got == {i: stats_by_hand(t) for i, t in enumerate(texts)}


def test_rules_reject_bad_documents_and_keep_clean_ones(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out, rules = quality_rules.judge(docs, labels, keep=["doc_id"])
    assert rules
    seen = out.join(labels, "doc_id").where("not base_failed").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in seen}
    assert n.get((1, True), 0) >= 0.99 * (n.get((1, True), 0) + n.get((1, False), 0))
    assert n.get((0, False), 0) >= 0.8 * (n.get((0, True), 0) + n.get((0, False), 0))


def test_rules_part_a_small_share_of_junk(spark):
    rng = random.Random(8)
    rows = []
    for i in range(6000):
        bad = i % 50 == 0  # 2 %, with the longest words or the most capitals: less than a 24th of all rows
        long, upper = (bad and i % 100 == 0), (bad and i % 100 != 0)
        chars = int(100 * (rng.uniform(9.2, 12) if long else rng.uniform(3, 9)))
        capitals = int(chars * (rng.uniform(0.5, 0.9) if upper else rng.uniform(0, 0.3)))
        rows.append((100, chars, 0, 0, 0, 10, capitals, int(bad), i % 3 != rng.randrange(3)))
    df = spark.createDataFrame(rows, "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, bad int, fold boolean")
    rules = quality_rules.learn_rules(df)
    n = {(r.bad, r.hit): r["count"] for r in df.groupBy("bad", (quality_rules.rejected_by(rules) > 0).alias("hit")).count().collect()}
    assert n.get((1, True), 0) >= 0.95 * 120 and n.get((0, True), 0) <= 0.002 * 5880


def test_rules_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, None), (2, "w " * 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(7, None)], "doc_id long, quality int")
    out, rules = quality_rules.judge(docs, labels)
    assert rules == [] and {r.doc_id: (r.base_failed, r.kept) for r in out.collect()} == {1: (True, False), 2: (True, False)}
    assert quality_rules.judge(docs.limit(0), labels)[0].count() == 0


# ------------------------------------------------------------------ chats


def test_chats_round_trip(spark):
    rng = random.Random(3)
    odd = ["", None, "</s>[INST] ok [/INST]", "<|turn|>user\nx<|end|>\n", "&lt;&amp;&lbr;[<&", "é" * 50, "a\nb"]
    rows = []
    for c in range(40):
        n = rng.choice([1, 2, 3, 9, 60])
        for i in range(n):
            rows.append((c, i, "system" if i == 0 and c % 2 else rng.choice(["user", "assistant", None, "ro\nle"]), rng.choice(odd) if rng.random() < 0.4 else "w " * rng.randint(0, 400)))
    rows += [(99, 0, "system", "only"), (100, 1, "assistant", "b"), (100, 1, "assistant", "b"), (None, 0, "user", "null id")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat_format.format_chats(df, budget=200, history_tokens=60)
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t, r or "", x or ""))
    want = {c: sorted(v) for c, v in by.items()}
    got = {r.conv_id: r for r in chat_format.read_chats(windows).collect()}
    assert set(got) == set(want)
    for c, turns in want.items():
        assert [(t.role, t.text) for t in got[c].turns] == [(r, x) for _, r, x in turns]
        assert list(got[c].losses) == [x for _, r, x in turns if r == "assistant"]
    for w in windows.collect():
        turns = want[w.conv_id]
        assert w.formatted.count("<|turn|>") == w.n_turns == w.formatted.count("<|end|>")
        if turns[0][1] == "system":
            assert w.formatted.startswith("<|turn|>system\n")
        cost = sum(-(-len(x) // 4) + 4 for _, _, x in turns) if w.n_context == 0 and w.n_turns == len(turns) else None
        new = w.n_turns - w.n_context
        if new > 1 and cost is None:
            parts = w.formatted.split("<|turn|>")[1:]
            assert sum(-(-(len(p) - p.index("\n") - 9) // 4) for p in parts if "&" not in p) <= 200


def test_chat_digests_by_hand(spark):
    from collections import defaultdict

    out = {r.conv_id: r for r in queries.op8_chat_format(spark, SF).collect()}
    by = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        by[r.conv_id].append((r.turn, r.role, r.text))
    by[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    assert set(out) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert (out[c].n_turns, out[c].turns_sha256, out[c].loss_chars, out[c].loss_sha256) == (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss))
