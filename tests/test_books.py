"""Segmentation, dialog, normal forms, alignment and contracts on literal cases and against brute force."""

import itertools
import json
import random
import time
import unicodedata
from difflib import SequenceMatcher

import pytest
import regex
from pyspark.sql import functions as F

from folioforge import queries
from folioforge.functions import contracts, names, numbers, phonetics, text
from folioforge.operators import alignment, books, catalog, dialog, lexicon, pages, prompts, segmentation

SF = "/root/testdata/sf0.001"


def words(t):
    return len(t.split())


def brute_groups(phrases, short, closes, most):
    """Groups of (text, reason) by the stated rules, one after the other."""
    level = segmentation.REASONS.index
    groups, now = [], []
    for p in phrases:
        now.append(p)
        if level(p[1]) >= level(closes):
            groups, now = [*groups, now], []
    groups += [now] if now else []
    size = lambda g: sum(words(t) for t, _ in g)
    if short:
        out = []
        for g in groups:
            if len(g) == 1 and size(g) <= short and out and size(out[-1]) + size(g) <= most and level(out[-1][-1][1]) < level("p"):
                out[-1] = out[-1] + g
            else:
                out.append(g)
        groups, carry = [], []
        for k, g in enumerate(out):
            g = carry + g
            carry = []
            if len(g) == 1 and size(g) <= short and level(g[-1][1]) <= level("s") and k + 1 < len(out) and size(out[k + 1]) + size(g) <= most:
                carry = g
            else:
                groups.append(g)
    out = []
    for g in groups:
        now = []
        for p in g:
            if now and size(now) + words(p[0]) > most:
                out, now = [*out, now], []
            now = [*now, p]
        out += [now] if now else []
    return ["".join(t for t, _ in g) for g in out]


@pytest.mark.parametrize(("strategy", "most"), [("sentence", 40), ("normal", 12), ("multi", 25), ("max_len", 9)])
def test_groups_equal_brute_force(spark, strategy, most):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 4 = 0")
    p = segmentation.segmented(docs, most)
    by = {}
    for r in p.orderBy("doc_id", "position").collect():
        by.setdefault(r.doc_id, []).append((r.text, r.reason))
    got = {}
    for r in segmentation.groups(p, strategy, most).select("doc_id", "group_index", segmentation.group_text(F.col("phrases")).alias("t")).orderBy("doc_id", "group_index").collect():
        got.setdefault(r.doc_id, []).append(r.t)
    short, closes = segmentation.STRATEGIES[strategy]
    assert got == {d: brute_groups(x, short, closes, most) for d, x in by.items()}


def segmented(spark, t, most=40):
    return [(r.text, r.reason) for r in segmentation.segmented(spark.createDataFrame([(1, t)], "doc_id long, text string"), most).orderBy("position").collect()]


def test_sentences_ornaments_and_breaks(spark):
    assert [t for t, _ in segmented(spark, "Mr. Hill saw Dr. Ray at 5 p.m. today. J. Poe left.")] == ["Mr. Hill saw Dr. Ray at 5 p.m. today. ", "J. Poe left."]
    assert segmented(spark, "There.\n\n♦ ♦\n\n\nEnd.") == [("There.\n\n♦ ♦\n\n\n", "p"), ("End.", "s")]
    assert segmented(spark, "One.\n\n\n\nTwo.\n\n\nThree.") == [("One.\n\n\n\n", "x"), ("Two.\n\n", "p"), ("Three.", "s")]
    assert segmented(spark, "a b c d e f g", 3) == [("a b c ", "w"), ("d e f ", "w"), ("g", "s")]
    assert segmented(spark, "Wait (now) go") == [("Wait ", "is"), ("(now) ", "is"), ("go", "s")]
    ends = spark.createDataFrame([("c", 0, "x"), ("c", 1, "x"), ("c", 2, "s"), ("c", 3, "x"), ("c", 4, "s")], "c string, i int, r string")
    assert [r.r for r in segmentation.end_chapters(ends, "c", "i", "r").orderBy("i").collect()] == ["p", "p", "s", "x", "xx"]


def said(spark, t, lang="en"):
    docs = spark.createDataFrame([(1, lang, t)], "doc_id long, lang string, text string")
    g = segmentation.groups(segmentation.segmented(docs, 40), "normal", 40).join(docs.select("doc_id", "lang"), "doc_id")
    return [(r.text, r.reason, r.voice) for r in dialog.dialog_groups(g).orderBy("group_index", "part_index").collect()]


def test_dialog(spark):
    assert said(spark, "“Come in now,” he said softly. Then rain.") == [("“Come in now,” ", "isqe", 1), ("he said softly. Then rain.", "s", -1)]
    assert said(spark, 'Well. "Come here at once," Anna said again.')[-2:] == [('"Come here at once," ', "isqe", 1), ("Anna said again.", "s", -1)]
    assert said(spark, '"Come here at once," Anna said again.', "de")[0][1] == "is"
    assert [v for _, _, v in said(spark, 'It was "big" there for us.')] == [-1]
    assert said(spark, 'He asked "where?" of everyone there.')[1] == ('"where?" ', "isqe", 1)
    assert "".join(t for t, _, _ in said(spark, "A “b c d e” f. “Open it is never closed. Then “So it is.” End.")) == "A “b c d e” f. “Open it is never closed. Then “So it is.” End."


def test_sentences_in_quotes(spark):
    cut = lambda t, lang="en": spark.createDataFrame([(t, lang)], "t string, l string").select(segmentation.sentences(F.col("t"), F.col("l")).alias("s")).first().s
    cases = {
        "“Come in. Sit down.” He left.": ["“Come in. ", "Sit down.” ", "He left."],
        "“Come in. Sit down. Now!”\nHe left.": ["“Come in. ", "Sit down. ", "Now!”\n", "He left."],
        '  "Mr. Hill came. He sat. . . It rained."  ': ['  "Mr. Hill came. ', "He sat. . . ", 'It rained."  '],
        'She said "Go. Run." and went. Then "a lone quote. Stays': ['She said "Go. Run." and went. ', 'Then "a lone quote. ', "Stays"],
        "“": ["“"], "“”": ["“”"], "": [], "A. B": ["A. B"],
    }
    for t, want in cases.items():
        assert (cut(t) if t else []) == want and segmentation.split_sentences(t) == want, t
    assert cut("Um 3 Uhr bzw. Vier. Gut.", "de") == ["Um 3 Uhr bzw. Vier. ", "Gut."] and cut("Um bzw. Vier.", "en") == ["Um bzw. ", "Vier."]
    assert cut("J. R. R. T. Poe left. So.") == ["J. R. R. T. Poe left. ", "So."]
    assert segmentation.split_sentences("La Sra. Paz vino. Ya.", "es") == ["La Sra. Paz vino. ", "Ya."]
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text <> ''").select("lang", text.clean_line_ends(F.col("text")).alias("t"))
    for r in docs.select("lang", "t", segmentation.sentences(F.col("t"), F.col("lang")).alias("s")).collect():
        assert segmentation.split_sentences(r.t, r.lang) == list(r.s)


def dialog_by_hand(t, groups):
    """Voice and quote ends of a text of one language (en), sign by sign; groups: (text, reason) of the phrases of each group."""
    flat, ends, at = [], [], 0
    for g in groups:
        for x, reason in g:
            at += len(x)
            flat.append((at, reason))
        ends.append(at)
    group_of = lambda k: sum(e <= k for e in ends)
    pairs, at = [], 0
    for line in t.splitlines(keepends=True):
        pairs += [(at + i, at + j, line[:i].rstrip()[-1:]) for i, j in dialog.line_pairs(line.rstrip("\r\n"))]
        at += len(line)
    taken = []
    for i, j, before in sorted(pairs, key=lambda p: (p[0], -p[1])):
        content = t[i + 1 : j]
        letters = [c for c in content if c.isalnum()]
        spoken = [w for w in content.split() if any(c.isalnum() for c in w)]
        if letters and (letters[0].isupper() or len(spoken) > 3 or group_of(i) != group_of(j) or before in ("", ",", ":", "—", "–") or content.lstrip()[:1] in ("—", "–") or "?" in content or "!" in content):
            if not any(a < i and j < b for a, b, _ in taken):
                stop = j + 1
                while stop < ends[group_of(j)] and unicodedata.category(t[stop]).startswith("P") and t[stop] not in '"“”':
                    stop += 1
                while stop < ends[group_of(j)] and t[stop] in " \t\n\r\x0b\x0c":
                    stop += 1
                taken.append((i, j, stop))
    cuts = sorted({c for i, _, stop in taken for c in (i, stop)})
    out, begin = [], 0
    for g, end in enumerate(ends):
        edges = [begin, *[c for c in cuts if begin < c < end], end]
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            after = t[b : b + 1000]
            said = any(stop == b for _, _, stop in taken) and (bool(regex.match(r"\s*\p{Ll}", after)) or bool(regex.match(rf"\s*\p{{Lu}}\S*[ \t]+(?:{'|'.join(dialog.ATTRIBUTION_VERBS)})(?!\p{{L}})", after, regex.I)) and bool(regex.match(r"\s*\p{Lu}", after)))
            reason = "isqe" if said else dict(flat).get(b, "is")
            out.append((g, k, t[a:b], reason, 1 if any(i <= a and b <= stop for i, _, stop in taken) else -1))
        begin = end
    return out


def test_dialog_against_brute_force(spark):
    rng = random.Random(9)
    bits = ["“Come in,", '"Go!', "he said. ", "Anna said again. ", "the cat sat", "Rain fell. ", "”", '"', " ", ", ", ".\n", "\n\n", "“Who?” ", "“a b” ", '"So it was here now." ', "– ", "and then. "]
    docs = [(k, "en", "".join(rng.choice(bits) for _ in range(rng.randint(5, 60)))) for k in range(150)]
    df = spark.createDataFrame(docs, "doc_id long, lang string, text string")
    g = segmentation.grouped(segmentation.phrase_arrays(df, 40, keep=["lang"]), "normal", 40)
    want = {}
    for r in g.collect():
        groups = [[(p.text, p.reason) for p in x] for x in r.groups]
        want[r.doc_id] = dialog_by_hand("".join(t for x in groups for t, _ in x), groups)
    got = {}
    for r in dialog.dialog_arrays(g).orderBy("doc_id", "group_index", "part_index").collect():
        got.setdefault(r.doc_id, []).append((r.group_index, r.part_index, r.text, r.reason, r.voice))
    assert got == want and any(x[4] == 1 for v in want.values() for x in v) and any(x[3] == "isqe" for v in want.values() for x in v)


def test_very_long_texts(spark):
    one = " ".join(f"Word{k % 97} goes here, then there." if k % 3 else "“Come here now,” she said." for k in range(40_000))
    df = spark.createDataFrame([(1, "en", one)], "doc_id long, lang string, text string")
    began = time.time()
    g = segmentation.grouped(segmentation.phrase_arrays(df, 40, keep=["lang"]), "normal", 40)
    assert g.select(F.size("groups")).first()[0] > 20_000 and time.time() - began < 60
    began = time.time()
    assert dialog.dialog_arrays(g).where("voice = 1").count() > 10_000 and time.time() - began < 90
    page = "<script>" * 20_000 + "<p>Text</p></nav>" + "<nav>x</nav>end"
    began = time.time()
    shown = spark.createDataFrame([(page,), ("<nav>a<script>b</script>c</nav>d<script>e",), ("<NAV>a</nav><nav>b",)], "h string").select(pages.preview(F.col("h")).alias("t")).collect()
    assert shown[0].t.endswith("end") and "Text" in shown[0].t and [r.t for r in shown[1:]] == ["d e", "b"] and time.time() - began < 20


def test_choices_and_lists(spark):
    v = spark.range(1).select(catalog.voice_pairs(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("x"))).alias("p")).first().p
    assert [tuple(x) for x in v] == [("a", "x"), ("b", "")]
    tags = spark.createDataFrame([("m1",), (" m1",), ("m2",), ("",), (None,)], "t string")
    assert sorted(r.tag for r in catalog.known_tags(tags, "t").collect()) == ["m1", "m2"]
    lines = spark.createDataFrame([("b", 0, 0, 5), ("b", 0, 1, 5), ("b", 1, 2, 30)], "book string, section int, idx int, n_words int")
    takes = spark.createDataFrame([(0, 0), (0, 9), (2, 1), (2, -1)], "idx int, errors int")
    c = catalog.line_classes(lines, takes, "idx", "errors", "n_words", "moderate")
    assert {r.idx: (r.generated, r.with_errors, r.failed) for r in c.collect()} == {0: (True, False, True), 1: (False, False, False), 2: (True, True, False)}
    shown, headings = catalog.visible_lines(c, "failed", "book", "section")
    assert [r.idx for r in shown.collect()] == [0] and [(r.section, r.n_visible) for r in headings.collect()] == [(0, 1)] and catalog.visible_lines(c, "all", "book", "section")[0].count() == 3
    rules = [("text", F.col("n") > 0, "no text"), ("voice", F.col("voice").isNotNull(), "no voice")]
    s = spark.createDataFrame([("a", 1, "v"), ("b", 0, None), ("c", None, "v")], "k string, n int, voice string")
    assert sorted((r.k, r.position, r.part) for r in catalog.missing_settings(s, "k", rules).collect()) == [("b", 0, "text"), ("b", 1, "voice"), ("c", 0, "text")]
    flat = spark.createDataFrame([("b", i, [(f"g{i}",)]) for i in range(5)], "book string, group_index int, phrases array<struct<text string>>".replace("text string", "text: string"))
    starts = spark.createDataFrame([("b", 0, 0, "One"), ("b", 1, 2, "Two"), ("b", 2, 5, "End"), ("b", 3, 9, "Gone")], "book string, ord int, start int, title string")
    out = [(r.section, r.title, r.start_index, r.end_index, len(r.groups)) for r in books.sectioned(flat, starts).orderBy("section").collect()]
    assert out == [(0, "One", 0, 2, 2), (1, "Two", 2, 5, 3), (2, "End", 5, 5, 0)]


def test_normal_forms(spark):
    rows = ["Ninety-nine ‘red’ ﬁsh… don't STOP! 👍 it's three", "Straße", "", "  "]
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    assert [r.c for r in df.select(text.compare_form(F.col("t"), "en").alias("c")).collect()] == ["99 red fish dont stop its 3", "strasse", "", ""]
    es = spark.createDataFrame([("Tengo treinta y uno, el primero de dos mil quinientos. Mañana él, uno de ellos",)], "t string").select(text.compare_form(F.col("t"), "es").alias("c")).first().c
    assert es == "tengo 31 el primero de 2500 mañana el uno de ellos"
    one = spark.range(1).select(text.prompt_form(F.lit("Wait . . . 12 ** of 1000 -- — go....."), un_caps=False).alias("p"), text.lower_opening(F.lit("THE BIG BAD wolf. HE")).alias("o"), text.lower_opening(F.lit("THE big")).alias("s")).first()
    assert one.p == "Wait ... twelve of 1000 — go..." and one.o == "the big bad wolf. HE" and one.s == "THE big"
    assert [r.r for r in spark.createDataFrame([("el treinta y uno de mayo dos",)], "t string").select(numbers.number_runs(F.split("t", " ")).alias("r")).collect()][0][0].asDict() == {"start": 1, "end": 4}


@pytest.mark.parametrize(("t", "want"), [("one hundred and five", "105"), ("two thousand and one", "2001"), ("one two", "1 2"), ("twenty one thirty", "21 30"), ("and so", "and so"), ("three million two hundred thousand", "3200000"), ("zero", "0")])
def test_english_numbers(t, want):
    assert numbers.english_text(t) == want


def test_number_words_round_trip():
    for n in range(1000):
        assert numbers.english_text(numbers.words_of(n).replace("-", " ")) == str(n)
    assert [numbers.spanish_value(w.split()) for w in ("mil", "dos mil cinco", "novecientas noventa y nueve", "veintidós", "treinta y", "cien mil")] == [1000, 2005, 999, 22, None, None]


def test_sounds():
    same = [("night", "knight"), ("their", "there"), ("write", "right"), ("sea", "see"), ("phone", "fone"), ("lamb", "lam")]
    assert all(phonetics.primary_code(a) == phonetics.primary_code(b) for a, b in same) and phonetics.primary_code("cat") != phonetics.primary_code("dog")


def least_cost(s, t, uncommon):
    """By trying all moves."""
    if not s and not t:
        return 0
    costs = []
    if s and t:
        costs.append(least_cost(s[1:], t[1:], uncommon) + (s[0] != t[0] and s[0] not in uncommon))
    if s and len(t) > 1 and s[0] in uncommon:
        costs.append(least_cost(s[1:], t[2:], uncommon))
    if s:
        costs.append(least_cost(s[1:], t, uncommon) + 1)
    if t:
        costs.append(least_cost(s, t[1:], uncommon) + 1)
    return min(costs)


def test_word_errors(spark):
    rng = random.Random(3)
    for _ in range(60):
        s, t = ([rng.choice("abcd") for _ in range(rng.randint(0, 5))] for _ in range(2))
        uncommon = {"d"} if rng.random() < 0.5 else set()
        steps = alignment.align_words(s, t, uncommon)
        assert sum(k in ("substitute", "delete", "insert") for k, _, _ in steps) == least_cost(s, t, uncommon)
        assert " ".join(a for _, a, _ in steps if a != "-").split() == s and " ".join(b for _, _, b in steps if b != "-").split() == t
    long = [rng.choice("abcdefgh") for _ in range(3000)]
    heard = [w for k, w in enumerate(long) if k % 50]
    assert sum(k != "match" for k, _, _ in alignment.align_words(long, heard, set())) == 60
    assert [k for k, _, _ in alignment.align_words(["one", "wise"], ["won", "whys"], set(), phonetics.primary_code)] == ["homophone", "homophone"]
    df = spark.createDataFrame([("the knight rode on", "the night rode"), ("a b c", "a x b c"), ("a b", "a y"), ("", "u"), ("zyx two", "one more two")], "s string, t string")
    e = df.select(alignment.word_errors(alignment.word_alignment(F.col("s"), F.col("t"), "en", F.array(F.lit("zyx")))).alias("e"), alignment.rendered(alignment.word_alignment(F.col("s"), F.col("t"), "en")).alias("r")).collect()
    assert [r.e for r in e] == [["d:on"], ["i:x"], ["s:b/y"], ["i:u"], []] and e[0].r == "the knight rode [-on-]"
    assert [r.v for r in spark.createDataFrame([("high school is", "highschool is"), ("firefly", "fire fly")], "s string, t string").select(alignment.respaced("s", "t").alias("v")).collect()] == ["high school is", "firefly"]


def test_trims_and_alignment(spark):
    heard = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(float(k)).alias("start"), F.lit(k + 0.6).alias("end")) for k, w in enumerate("uh the cat sat down ok".split())])
    r = spark.range(1).select(alignment.semantic_trim(heard, F.lit("the cat sat down"), F.lit(6.0)).alias("t"), alignment.semantic_trim(heard, F.lit("a dog"), F.lit(6.0)).alias("n"), alignment.timed_phrases(F.array(F.lit("uh the cat"), F.lit("sat down ok")), heard, F.lit(6.0)).alias("p")).first()
    assert (round(r.t.start, 2), round(r.t.end, 2)) == (0.8, 4.8) and r.n is None and [(x.start, x.end) for x in r.p] == [(0.0, 3.0), (3.0, 6.0)]
    rng = random.Random(5)
    ratio = lambda a, b: SequenceMatcher(None, a, b).ratio()
    for _ in range(12):
        w = ["".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(rng.randint(3, 7))]
        phrases = [" ".join(w[:2]), " ".join(w[2:4]), " ".join(w[4:]) or "zz"]
        score = lambda e: ratio(phrases[0], " ".join(w[: e[0] + 1])) + ratio(phrases[1], " ".join(w[e[0] + 1 : e[1] + 1])) + ratio(phrases[2], " ".join(w[e[1] + 1 :]))  # noqa: B023, E731
        best = max(score(e) for e in itertools.combinations_with_replacement(range(len(w)), 2))
        assert abs(score(alignment.phrase_ends(phrases, w)) - best) < 1e-9
    t = [(w, k * 1.0, k + 0.5) for k, w in enumerate("noise here the cat sat on the mat and then it slept".split())]
    times, cursor, skip = alignment.follow(["the cat sat on the mat", "zzzz qqqq", "and then it slept"], t)
    assert times == [(2.0, 8.0), (0.0, 0.0), (8.0, 11.5)] and cursor == 12 and skip == alignment.SKIP


def test_contracts(spark):
    seg = [{"text": "a", "time_start": 0, "time_end": 1.5}]
    rows = [{"text_segments": seg, "bookmarks": [2, "1", 2.9]}, {"text_segments": seg, "title": 3}, [], {"text_segments": seg, "sections": [{"title": "s", "start_index": 0, "end_index": 9}]}]
    df = spark.createDataFrame([(json.dumps(r),) for r in rows], "j string").withColumn("v", F.try_parse_json("j"))
    got = df.select(contracts.metadata_error(F.col("v")).alias("e"), contracts.metadata(F.col("v")).alias("s"), contracts.metadata(F.col("v"), False).alias("l"), contracts.metadata_json(contracts.metadata(F.col("v"))).alias("j")).collect()
    assert [r.e for r in got] == [None, "title", "root", None] and json.loads(got[0].j)["bookmarks"] == [1, 2] and got[1].l.title == "" and got[2].l is None
    assert len(got[3].s.sections) == 1 and got[3].l.sections == []
    b = {"format": "book.v2", "book": {"sections": [{"title": "x", "phrase_groups": [{"phrases": [{"text": "t", "reason": "p"}], "voice_index": 2}, [{"text": "u", "reason": "?"}]]}]}}
    v = spark.createDataFrame([(json.dumps(b),)], "j string").select(contracts.book(F.try_parse_json("j")).alias("b"))
    again = v.select(contracts.book(F.try_parse_json(contracts.book_json(F.col("b")))).alias("c"), "b").first()
    assert again.b == again.c and again.b.sections[0].phrase_groups[1].phrases[0].reason == "undefined" and again.b.sections[0].phrase_groups[0].voice_index == 2

    def fnv(t):
        h, u = 2166136261, t.encode("utf-16-be")
        for i in range(0, len(u), 2):
            h = ((h ^ int.from_bytes(u[i : i + 2], "big")) * 16777619) & 0xFFFFFFFF
        return f"{h:x}"

    cases = ["", "a", "hello é😀", "x" * 300]
    out = spark.createDataFrame([(t,) for t in cases], "t string").select("t", contracts.fnv1a(F.col("t")).alias("h")).collect()
    assert {r.t: r.h for r in out} == {t: fnv(t) for t in cases}
    import base64
    import zlib

    packed = base64.urlsafe_b64encode(zlib.compress("Straße".encode())).decode()
    assert [r.x for r in spark.createDataFrame([(packed,), ("!!",), (None,)], "p string").select(contracts.inflated("p").alias("x")).collect()] == ["Straße", "", ""]
    import xxhash

    assert spark.range(1).select(names.content_hash(F.lit(3), F.lit("abc")).alias("h")).first().h == xxhash.xxh3_64_hexdigest("3 abc")


def test_substitutions_and_windows(spark):
    df = spark.createDataFrame([(1, "The Fox, foxes; fox's FOX boxes")], "k int, t string")
    pairs = spark.createDataFrame([(0, "fox", "wolf"), (1, "box", "crate")], "ord int, word string, replacement string")
    assert lexicon.substituted(df, "k", "t", pairs).first().t == "The Wolf, wolfes; wolf's Wolf cratees"
    rows = spark.createDataFrame([("d", i, n) for i, n in enumerate((100, 50, 20, 5, 5, 5, 300, 1))], "k string, i int, n int")
    got = [(r.first, r.last, r.n_words) for r in prompts.forward_windows(rows, "k", "i", "n").orderBy("window").collect()]
    assert got == [(0, 1, 150), (2, 4, 30), (5, 5, 5), (6, 6, 300), (7, 7, 1)]
    one = spark.range(1).select(prompts.speaker_chunks(F.lit("intro\n[SPEAKER0] a\nb\n[SPEAKER1] c"), 2).alias("s"), prompts.word_chunks(F.lit("a b c\n\nd"), 2).alias("w"), prompts.first_difference(F.lit("abc"), F.lit("abd")).alias("d"), prompts.first_difference(F.lit("ab"), F.lit("abd")).alias("e")).first()
    assert one.s == ["intro\n[SPEAKER0] a\nb", "[SPEAKER1] c"] and one.w == ["a b", "c\n\n", "d\n\n"] and (one.d, one.e) == (2, 2)


def test_queries_without_sql_run(spark):
    for name in ("normal_groups", "dialog_groups", "word_error_codes", "semantic_trims", "forward_windows", "spelled_numbers"):
        assert queries.queries()[name](spark, SF).count() > 0
    back = queries.queries()["spelled_numbers"](spark, SF)
    assert back.where("n <> digits").count() == 0
