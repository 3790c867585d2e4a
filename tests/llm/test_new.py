"""The Merkle manifest, packing and ranked search against plain Python, and their odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.llm import lexical, merkle, packing, queries

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASH = "tree leaf claimed at n block level digest tie row part shift piece start length ids sequence_id offset open norm terms counts stats query score rank item_id".split()


def clashing(df, *but):
    return df.withColumns({c: F.lit("mine") for c in CLASH if c not in but})


def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    return H("".join("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in FIELDS))


def tree(nodes):
    """(root, proofs as lists of siblings with the own place in each run)."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H("".join(levels[-1][k : k + 8])) for k in range(0, len(levels[-1]), 8)])
    proofs = []
    for i in range(len(nodes)):
        proof = []
        for level in levels[:-1]:
            first = i - i % 8
            proof.append((level[first:i], level[i + 1 : first + 8]))
            i //= 8
        proofs.append(proof)
    return levels[-1][0], proofs


def whole_manifest(rows):
    by = defaultdict(list)
    for r in rows:
        by[r["lang"]].append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    found = {}
    for x in langs:
        by[x].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        found[x] = tree([leaf(r) for r in by[x]])
    root, tops = tree([found[x][0] for x in langs])
    out = []
    for x, top in zip(langs, tops, strict=True):
        for r, proof in zip(by[x], found[x][1], strict=True):
            claimed = r | {"text": r["text"] and r["text"].translate(LOW)} if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 else r
            value = leaf(claimed)
            for a, b in proof + top:
                value = H("".join([*a, value, *b]))
            out.append((r["doc_id"], leaf(r), found[x][0], root, H("".join(d for a, b in proof + top for d in a + b)), value, value == root))
    return sorted(out, key=str)


def manifest_rows(spark, rows, levels):
    df = clashing(spark.createDataFrame([tuple(r[c] for c in FIELDS) for r in rows], "doc_id long, source string, lang string, n_chars long, text string"))
    out = merkle.manifest(df.repartition(3), claimed=merkle.tampered(), levels=levels)
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, H(r.proof), r.folded_root, r.folded_root == r.root) for r in out.collect()), key=str)


@pytest.mark.parametrize("levels", [1, 4])
def test_manifest_against_a_whole_tree(spark, levels):
    rows = [{"doc_id": i, "source": None if i % 7 == 0 else f"s{i}", "lang": x, "n_chars": None if i % 5 == 0 else i, "text": t} for x, ids in ((None, range(3)), ("", range(10, 11)), ("de", range(20, 93)), ("é", range(100, 108)), ("z", range(200, 209)), *((f"k{j}", range(300 + j, 301 + j)) for j in range(9))) for i in ids for t in [None if i % 11 == 0 else "" if i % 13 == 0 else f"Grüße {i}"]]
    rows += [rows[0], rows[0] | {"doc_id": None}, {c: None for c in FIELDS}, rows[30]]
    assert manifest_rows(spark, rows, levels) == whole_manifest(rows)


def test_manifest_of_few_rows(spark):
    one = [{"doc_id": 1, "source": "s", "lang": "en", "n_chars": 1, "text": "A"}]
    assert manifest_rows(spark, one, 4) == whole_manifest(one)
    assert manifest_rows(spark, one * 9, 1) == whole_manifest(one * 9)
    assert merkle.manifest(spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")).count() == 0


def test_octopus_is_the_least_that_is_missing():
    for n in (1, 2, 8, 9, 64, 65, 700):
        for known in ({0}, {n - 1}, set(range(n)), set(range(0, n, 3)), set(range(n // 2, n))):
            lacking = merkle.missing(n, known)
            have = {(0, x) for x in known}
            for k in range(merkle.depth(n)):  # with them every node on the paths can be derived, and none of them is derived anyway
                have |= {c for c in lacking if c[0] == k}
                assert all((k, x) not in lacking or not any(x * 8**k <= y < (x + 1) * 8**k for y in known) for x in range(merkle.width(n, k)))
                have |= {(k + 1, p) for p in {x // 8 for j, x in have if j == k} if all((k, x) in have for x in range(p * 8, min(p * 8 + 8, merkle.width(n, k))))}
            assert (merkle.depth(n), 0) in have


TEXTS = ["", None, "Hello  world", "don't DON'T 123 4½ café CAFÉ́", "a" * 5000, "x y " * 40_000, "\tтекст\n\n新しい 文 <|endoftext|> <|startoftext|>a", "ﬁ ① ǅ İstanbul ΣΑΣ", "é é ́   x\x1cy\x85z"]


def packed_ok(out, texts, tokenizer, room=2048):
    """Pieces of each document in order, equal to the library's ids; sequences gapless and within the room."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r.doc_id].append((r.piece, r.start, r.length, bytes(r.ids)))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for d, t in texts.items():
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want = [(k, s, len(ids[s : s + room]), ids[s : s + room].tobytes()) for k, s in enumerate(range(0, len(ids), room))]
        assert sorted(by_doc[d]) == want, d
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= room
    return len(by_sequence)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_file(queries.WORD_TOKENIZER))
    t.no_truncation()
    t.no_padding()
    return t


def test_packing_of_odd_texts(spark, tokenizer):
    df = clashing(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"))
    packed_ok(packing.pack_documents(df, queries.tokenizer_file(queries.WORD_TOKENIZER)).collect(), dict(enumerate(TEXTS)), tokenizer)
    again = packing.pack_documents(df.unionByName(df).withColumn("doc_id", F.when(F.col("doc_id") > 2, F.col("doc_id"))), queries.tokenizer_file(queries.WORD_TOKENIZER)).collect()
    assert sum(r.piece == 0 for r in again) == 2 * len(TEXTS) and sum(r.doc_id is None and r.piece == 0 for r in again) == 6
    assert packing.pack_documents(df.limit(0), queries.tokenizer_file(queries.WORD_TOKENIZER)).count() == 0


def test_packing_of_documents(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = packing.pack_documents(docs.repartition(5, "doc_id"), queries.tokenizer_file(queries.WORD_TOKENIZER), open_bins=32).collect()
    n = packed_ok(out, {r.doc_id: r.text for r in docs.collect()}, tokenizer)
    pieces = sorted((r.length for r in out), reverse=True)
    bins: list[int] = []
    for x in pieces:  # best-fit decreasing with all pieces known
        fit = [b for b in bins if b >= x]
        if fit:
            bins.remove(min(fit))
            bins.append(min(fit) - x)
        else:
            bins.append(2048 - x)
    assert n <= 1.01 * len(bins) + 1, (n, len(bins))


def test_open_bins_are_bounded_and_best():
    rng, bins, open_ones, closed = np.random.default_rng(1), packing.OpenBins(100, 4), [], 0
    for k in range(3000):
        x = int(rng.integers(1, 100)) if k % 50 else 100
        free = sorted(open_ones)
        fit = [f for f in free if f >= x]
        if fit:
            open_ones.remove(fit[0])
            fit = fit[0]
        else:
            if len(open_ones) == 4 and x < 100:
                open_ones.remove(free[0])
                closed += 1
            fit = 100
        closed += fit == x
        open_ones += [fit - x] if fit > x else []
        closed -= len(bins.place(x, k))
        assert closed == 0 and sorted(f for f, b in enumerate(bins.with_free) for _ in b) == sorted(open_ones) and bins.n == len(open_ones) <= 4


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def ranked(docs, items, k=10):
    parts = [(d, TERM.findall(t.translate(LOW)) if t else []) for d, t in docs]
    n_docs, n_terms = sum(bool(w) for _, w in parts), sum(len(w) for _, w in parts)
    df = Counter(t for _, w in parts for t in set(w))
    out = []
    for item, text in items:
        q = Counter(TERM.findall((text or "").translate(LOW)))
        found = []
        for d, words in parts:
            tf, m = Counter(words), 100 - 75 + (75 * len(words) * n_docs) // max(n_terms, 1)
            score = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * m)) for t, c in q.items() if tf[t])
            if score > 0:
                found.append((-score, d is not None, d))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("parameters", [{}, {"bucket_rows": 16, "lead": 0.1}, {"block_chars": 900, "bucket_rows": 64}])
def test_search_against_brute_force(spark, parameters):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = lexical.rank_documents(docs.repartition(3, "doc_id"), items, **parameters).collect()
    assert sorted((tuple(r) for r in got), key=str) == ranked([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])


def test_search_of_odd_rows(spark):
    docs = [(1, "Äpfel the the cat"), (2, None), (3, ""), (4, "?! -"), (5, "the CAT sat"), (5, "the CAT sat"), (None, "cat"), (7, "cat " * 100_000), (8, "dog"), (9, "ÄPFEL äpfel")]
    items = [(1, "cat"), (1, "cat cat ÄPFEL"), (2, None), (3, " . "), (4, "absent"), (None, "the dog")]
    df = clashing(spark.createDataFrame(docs, "doc_id long, text string"), "item_id")
    asked = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit("x") for c in ("doc_id", "score", "query", "rank")})
    for parameters in ({}, {"bucket_rows": 1, "lead": 0.5}):
        got = sorted((tuple(r) for r in lexical.rank_documents(df, asked, **parameters).collect()), key=str)
        assert got == ranked(docs, items)
    assert lexical.rank_documents(df.limit(0), asked).count() == 0 and lexical.rank_documents(df, asked.limit(0)).count() == 0
    many = [(i, "copy of one text") for i in range(500)]
    got = lexical.rank_documents(spark.createDataFrame(many, "doc_id long, text string").repartition(4), spark.createDataFrame([(1, "copy text")], "item_id long, text string"), bucket_rows=8)
    assert sorted((tuple(r) for r in got.collect()), key=str) == ranked(many, [(1, "copy text")])
