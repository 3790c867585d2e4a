"""Both exact repeat finders against brute force."""

import random
import re

import numpy as np
import pytest

from folioforge.llm import suffix_merge, suffix_tree

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts(seed, n, words):
    rng = random.Random(seed)
    shared = ["".join(rng.choices("ab \n", k=rng.randint(40, 160))) for _ in range(4)] + [" ".join(rng.choices(words, k=rng.randint(15, 60))) for _ in range(6)]
    out = []
    for _ in range(n):
        parts = [rng.choice(shared) if rng.random() < 0.4 else " ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(rng.randint(0, 5))]
        out.append(rng.choice([" ", "\n", ""]).join(parts))
    out += [out[0], out[1] + " x", None, "", " \n\t", "é" * 90, "é" * 90, "aé" * 40 + "b", "\0" * 120, "\0" * 70 + "a" * 70, "a" * 60, "ab" * 50, "日本語テキスト" * 20, "日本語テキスト" * 20]
    return out


def bytes_by_hand(rows, length):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                gone[k : k + length] = True
        spans = len(re.findall("1+", "".join("01"[int(x)] for x in gone)))
        out.append((i, len(b), int(gone.sum()), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out)


def words_by_hand(rows, length):
    first = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - length + 1):
            key = tuple(w[k : k + length])
            first[key] = min(first.get(key, (i, k)), (i, k))
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] < (i, k):
                gone[k : k + length] = [True] * length
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out)


@pytest.mark.parametrize(("block", "bucket", "hot", "words"), [(4 << 20, 16 << 20, 512, "the of and a to in it is".split()), (3000, 4000, 2, "the of and a".split()), (900, 2000, 0, ["a", "b"]), (2000, 900, 1, [f"w{i}" for i in range(300)])])
def test_repeats(spark, block, bucket, hot, words):
    rows = [(k * 7 % 101 if k % 9 else k, t) for k, t in enumerate(texts(len(words), 45, words))]
    rows += [(rows[0][0], rows[0][1]), (rows[3][0], rows[5][1])]  # ids that repeat, with the same and with another text
    df = spark.createDataFrame([(i, t, "s", 1, "x") for i, t in rows], "doc_id long, text string, block string, kept int, data string")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in suffix_merge.remove_repeated_bytes(df, block_bytes=block, bucket_bytes=bucket, hot_runs=hot).collect())
    assert got == bytes_by_hand(rows, 50)
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in suffix_tree.remove_repeated_passages(df, block_bytes=block, bucket_bytes=bucket, hot_runs=hot).collect())
    assert got == words_by_hand(rows, 20)


def test_cut_keeps_columns_and_layout(spark):
    passage = " ".join(f"p{i}" for i in range(25))
    df = spark.createDataFrame([(1, f"a  b\n{passage}\n c", "k"), (2, f"x\n\ny {passage}  z\n", "l"), (3, passage, "m"), (4, "  few\twords ", "n"), (5, None, "o")], "doc_id long, text string, x_text string")
    got = {r.doc_id: (r.text, r.x_text) for r in suffix_tree.cut_repeated_passages(df).collect()}
    assert got == {1: (f"a  b\n{passage}\n c", "k"), 2: ("x\n\ny z", "l"), 4: ("  few\twords ", "n"), 5: ("", "o")}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_merge.remove_repeated_bytes(df).count() == 0 and suffix_tree.remove_repeated_passages(df).count() == 0


def test_loser_tree_merges():
    rng = random.Random(1)
    for _ in range(200):
        runs = [sorted(bytes(rng.choices(b"ab", k=rng.randint(0, 6))) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 9))]
        lcp = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        shared = [[0] + [lcp(a, b) for a, b in zip(r, r[1:])] for r in runs]
        order, lcps = suffix_merge.merge([list(r) for r in runs], shared)
        at, out = [0] * len(runs), []
        for r in order:
            out.append(runs[r][at[r]])
            at[r] += 1
        assert out == sorted(x for r in runs for x in r)
        assert lcps[1:] == [lcp(a, b) for a, b in zip(out, out[1:])]
