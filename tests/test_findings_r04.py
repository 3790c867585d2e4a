"""Cases of the fourth round's findings, each of which failed before it was mended."""

import json
from collections import Counter
from pathlib import Path

from pyspark.sql import functions as F


def test_projects_are_listed_and_read_once(spark, tmp_path):
    from folioforge.plans import audio_queries
    from folioforge.sources import takes

    text = {"ok": {"phrase_groups": [[{"text": "a", "reason": "p"}], {"phrases": [{"text": "b"}], "voice_index": 2}]}, "odd": {"format": "odd"}, "bare": {"phrase_groups": [{"voice_index": 1}]}, "flat": {"phrase_groups": ["a"]}, "none": {"phrase_groups": [[]]}, "dumb": {"phrase_groups": [[{"reason": "p"}]]}}
    rows = [(f"{k}/project.json", '{"voice": "v"}') for k in [*text, "gone"]] + [("bad/project.json", "{"), ("lone/project_text.json", "{}"), ("ok/projects.json", "{}")] + [(f"{k}/project_text.json", json.dumps(v)) for k, v in text.items()]
    folder = audio_queries.written(spark.createDataFrame(rows, "file string, t string").select("file", F.encode("t", "UTF-8").alias("content")), "few")
    top = Path(folder.removeprefix("file://").removesuffix("/*"))
    assert max(Counter(p.name for p in top.glob("*/*") if p.is_dir()).values()) == 1  # a project's folder is made by one task
    p = takes.projects(spark, folder)
    assert p._jdf.queryExecution().sparkPlan().toString().count("MapInArrow") == 4  # twice as many for a join of two readings
    got = {r.project: (r.error, r.book and [(g.voice_index, [(x.text, x.reason) for x in g.phrases]) for g in r.book.sections[0].phrase_groups]) for r in p.select("project", "error", "book").collect()}
    assert got == {
        "ok": (None, [(-1, [("a", "p")]), (2, [("b", "undefined")])]), "odd": ("format", None), "bare": ("group without phrases", None), "flat": ("phrases", None),
        "none": ("group empty", None), "dumb": ("phrase", None), "gone": ("text missing", None), "bad": ("settings", None),
    }


def test_errors_are_counted_without_steps(spark):
    import random

    from folioforge.operators import alignment as al

    rng = random.Random(4)
    some = lambda n: [rng.choice("abcdef") for _ in range(rng.randrange(n))]
    pairs = [(some(9), some(9), set(some(3))) for _ in range(500)] + [([], [], set()), (["a"] * 2000, ["b"] * 1500, set()), (["u", "a"], ["x", "y", "a"], {"u"})]
    steps = al.align_many(pairs)
    assert al.count_many(pairs) == [sum(k in ("delete", "insert", "substitute") for k, _, _ in s) for s in steps]
    d = spark.createDataFrame([("a u b", "a x y", ["u"]), ("", "x", None), (None, None, None), ("a b", "a b", [])], "s string, t string, u array<string>")
    n = d.select(al.error_count(F.col("s"), F.col("t"), "", F.col("u")).alias("n"), F.size(al.word_errors(al.word_alignment(F.col("s"), F.col("t"), "", F.col("u")))).alias("m")).collect()
    assert [r.n for r in n] == [r.m for r in n] and [r.n for r in n] == [1, 1, 0, 0]
