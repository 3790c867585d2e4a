"""Decontamination and licence scans against brute force."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from folioforge.llm import decontaminate, licence_scan

SF = "/root/testdata/sf0.001"


def best_distance(item, text):
    """Least edit distance of an item to any substring."""
    row = np.zeros(len(text) + 1, int)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = np.array(new)
    return row.min()


def norm(t):
    return " ".join((t or "").lower().split())


def edited(rng, text, n):
    for _ in range(n):
        k = rng.randrange(len(text))
        text = rng.choice([text[:k] + text[k + 1 :], text[:k] + "#" + text[k:], text[:k] + "~" + text[k + 1 :]])
    return text


def test_leaks_equal_brute_force(spark):
    rng = random.Random(4)
    items = [(k, "".join(rng.choices("abcdefgh é", k=rng.randint(60, 140)))) for k in range(6)]
    docs = []
    for k in range(60):
        noise = lambda: "".join(rng.choices("abcdefgh \né", k=rng.randint(0, 150)))
        i = rng.randrange(6)
        docs.append((k, noise() + edited(rng, items[i][1], rng.randint(0, 14)).upper() + noise() if k % 3 else noise()))
    docs += [(100, None), (101, ""), (102, items[0][1] + " x " + items[0][1]), (103, items[1][1].replace(" ", " \n ")), (103, "clean")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([*items, (9, None), (10, "short"), (11, "")], "item_id long, text string")
    rate, q = 0.06, 12
    for extra in ({}, {"block_chars": 150, "segment": 300}):
        got = decontaminate.find_leaks(df, bench, q=q, edit_rate=rate, **extra).collect()
        pairs = {(r.doc_id, r.item_id) for r in got}
        want = set()
        for d, t in docs:
            for i, x in items:
                m = len(norm(x))
                if best_distance(norm(x), norm(t)) <= min(int(rate * m), m // q - 1):
                    want.add((d, i))
        assert pairs == want and len(want) > 15
        text = {d: t for d, t in docs if d != 103}
        for r in got:
            if r.doc_id in text:
                assert best_distance(norm(dict(items)[r.item_id]), re.sub(r"\s+", " ", text[r.doc_id][r.start : r.end].lower())) <= r.distance
        assert sorted((r.start, r.end) for r in got if r.doc_id == 102 and r.item_id == 0)[1:]  # both places
    left = decontaminate.without_leaks(df, bench, q=q, edit_rate=rate)
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} >= {100, 101} and left.where("doc_id = 103").count() == 1
    assert decontaminate.find_leaks(df, bench.limit(0)).count() == 0


def test_short_items_and_excerpts_of_long_ones_are_found(spark):
    rng = random.Random(9)
    prose = lambda n: "".join(rng.choices("abcdefgh ", k=n)).strip()
    long = " ".join(f"word{i}" for i in range(100, 200))
    items = [(1, "What is  2+2?"), (2, "cat"), (3, long), (4, "Ünder x"), (5, "cat"), (6, prose(39) + "zz")]
    docs = [
        (1, "so: what is 2+2? Four."), (2, "concatenate cats"), (3, "a CAT, a cat"), (4, prose(300) + long[85:640] + prose(300)), (5, long[300:420]),
        (6, "\n".join([prose(90), edited(rng, long[100:345], 6), prose(90)])), (7, f"x {long} y {long[:400]}"), (8, "ünder\n x"), (9, "ünder xy, what is 2+22?"), (10, "x" * 299 + " cat"),
    ]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for extra in ({}, {"segment": 300}, {"block_chars": 50}):
        got = decontaminate.find_leaks(df, bench, **extra).collect()
        assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (3, 2), (3, 5), (4, 3), (6, 3), (7, 3), (8, 4), (10, 2), (10, 5)}
        assert sorted((r.start, r.end) for r in got if r.doc_id == 3 and r.item_id == 2) == [(2, 5), (9, 12)]
        text = dict(docs)
        assert [(text[4][r.start : r.end] in long, r.distance) for r in got if r.doc_id == 4] == [(True, 0)]
        assert len([r for r in got if r.doc_id == 7]) == 2 and all(r.distance == 0 for r in got if r.doc_id != 6)
    assert {r.doc_id for r in decontaminate.without_leaks(df, bench).collect()} == {2, 5, 9}


def test_long_repetitive_texts_stay_in_bounds():
    block = decontaminate.Items([(1, "a" * 700), (2, "ab" * 300)], 12, 0.06, 40, 4000)
    assert {x[0] for x in decontaminate.search_text(block, "a" * 300_000, 1 << 18)} == {1}
    assert {x[0] for x in decontaminate.search_text(block, "ab" * 50_000, 1 << 18)} == {2}


def test_band_counts_do_not_depend_on_the_chunk():
    rng = random.Random(8)
    block = decontaminate.Items([(k, "".join(rng.choices("ab", k=90))) for k in range(5)], 6, 0.1, 40, 4000)
    text, _ = decontaminate.normalise("".join(rng.choices("ab", k=2000)) + "a" * 500)
    assert block.candidates(text) == block.candidates(text, 7) != []


def test_verbatim_items_are_found(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = {(d.doc_id, b.item_id) for d in docs.collect() for b in bench.collect() if norm(b.text) in norm(d.text)}
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect()} == want and want


def test_licences(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [
        (1, "r/LICENSE", mit), (2, "r/a/b/x.txt", "text\nmore"), (3, "r/a/COPYING", f"{gpl}\n{gpl}\n{mit}"), (4, "r/a/c/y.txt", None), (5, "r/z.txt", f"head\n{mit.upper()}\nbody"),
        (6, "q/z.txt", "none"), (7, None, mit), (8, None, "none"), (9, "LICENSE", gpl), (10, "r/n.txt", "this is a long line that speaks of some license in passing and of a public version of it"), (10, "r/n.txt", "twice"),
    ]
    df = spark.createDataFrame([(i, p, t, "mine") for i, p, t in rows], "doc_id long, path string, text string, near string").withColumns({c: F.lit("x") for c in ("above", "given", "full", "key", "licence", "own_licence")})
    got = {r.doc_id: (r.own_licence, r.licence, r.licence_from) for r in licence_scan.scan_licences(df).collect()}
    assert got == {
        1: ("MIT", "MIT", None), 2: (None, "GPL-3.0", "r/a"), 3: ("GPL-3.0", "GPL-3.0", None), 4: (None, "GPL-3.0", "r/a"), 5: ("MIT", "MIT", None),
        6: (None, "GPL-3.0", ""), 7: ("MIT", "MIT", None), 8: (None, None, None), 9: ("GPL-3.0", "GPL-3.0", None), 10: (None, "MIT", "r"),
    }
    assert licence_scan.scan_licences(df.limit(0)).count() == 0


def test_licences_of_wrapped_embedded_and_full_texts(spark):
    texts = dict(licence_scan.full_texts())
    wrap = lambda t, n: "\n".join(" ".join(t.split()[i : i + n]) for i in range(0, len(t.split()), n))
    rows = [
        (1, "a/x.c", "Copyright (c) 2020 Jane Doe. Released under the MIT License."),
        (2, "a/y.py", "# Licensed under the Apache License,\n# Version 2.0.\nimport os"),
        (3, "a/z.js", "// This work is licensed under the GNU General\n// Public License, version 3."),
        (4, "a/w.txt", "Released under the MIT License.\nOne part\nis licensed under CC\nBY-NC 4.0. Another: licensed under CC BY-NC 4.0."),
        (5, "m/LICENSE", "MIT License\n\nCopyright (c) 2020 Jane Doe\n\n" + wrap(texts["MIT"], 9)),
        (6, "m/src/x.c", "int x;"),
        (7, "g/COPYING", wrap(texts["GPL-3.0"], 7)),
        (8, "p/LICENSE", wrap(texts["Apache-2.0"], 5)),
        (9, "q/plain.txt", texts["MIT"]),  # not a licence file: full texts do not count
        (10, "q/LICENSE", "All rights reserved. No license under any public version is given. " * 20),
        (11, "q/n.txt", None),
    ]
    rows += [(100 + i, f"n/{i}.txt", f"plain words {i} of a document that names no terms of use") for i in range(300)]
    got = {r.doc_id: (r.own_licence, r.licence) for r in licence_scan.scan_licences(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert len(got) == len(rows)
    want = {1: "MIT", 2: "Apache-2.0", 3: "GPL-3.0", 4: "CC-BY-NC-4.0", 5: "MIT", 7: "GPL-3.0", 8: "Apache-2.0"}
    assert {k: v[0] for k, v in got.items() if v[0]} == want
    assert got[6] == (None, "MIT") and got[11] == (None, None)
