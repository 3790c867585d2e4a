"""Sources on small folders, streams against their batch form, signals on literal clips."""

import io
import json
import math
import random
import time
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from folioforge.functions import names
from folioforge.operators import pages, signal
from folioforge.sources import audio, epub, files, takes
from folioforge.streaming import catalogs, deltas, prompts, stateful, utterances


def test_text_and_json_files(spark, tmp_path):
    for name, data in {"a b.txt": "héllo".encode(), "b.txt": "héllo".encode("cp1252"), "c.txt": "héllo".encode("utf-16"), "d.txt": "héllo".encode("utf-16-le")}.items():
        (tmp_path / name).write_bytes(data)
    got = {r.title: r.text for r in files.text_books(spark, str(tmp_path)).collect()}
    assert got == {"a b": "héllo", "b": "héllo", "c": "héllo", "d": "héllo"}
    (tmp_path / "x.json").write_text('{"a": 1}')
    (tmp_path / "y.json").write_text('{"a": ')
    good, bad = files.json_documents(spark, str(tmp_path))
    assert [r.file for r in good.collect()] == ["x.json"] and [r.file for r in bad.collect()] == ["y.json"]
    files.write_documents(good.select(F.to_json("v").alias("json")), str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ['{"a":1}']
    assert [r.file for r in files.ordered_manifest(spark, str(tmp_path), "*.txt").orderBy("position").collect()] == ["a b.txt", "b.txt", "c.txt", "d.txt"]
    p = spark.range(1).select(files.supporting_files(F.array(*map(F.lit, ["a", "/b", "a", "../c", "C:\\d", "e/f", " "]))).alias("p"), files.lossy_text(F.lit(b"a\xff")).alias("t")).first()
    assert p.p == ["a", "e/f"] and p.t == "a\ufffd"


def test_catalog_and_sidecars(spark, tmp_path):
    import xxhash

    h = lambda i, t: xxhash.xxh3_64_hexdigest(f"{i} {t}")
    good = f"[00001] [{h(0, 'one')}] [m1] [v] [2] one"
    for name, data in {f"{good}.flac": b"x", f"[00002] [{h(1, 'old')}] [m1] [v] old.flac": b"x", f"[00003] [{h(2, 'three')}] [m9] [v] t.flac": b"", "other.flac": b"x"}.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / f"{good}.json").write_text(json.dumps([{"text": "one", "time_start": 0, "time_end": 1}]))
    lines = spark.createDataFrame([(0, "one"), (1, "two"), (2, "three")], "index int, text string")
    c = takes.catalog(spark, str(tmp_path), lines, ["m1"])
    assert [(r["index"], r.model, r.errors) for r in c.collect()] == [(0, "m1", 2)]
    assert len(takes.with_sidecars(c, takes.sidecars(spark, str(tmp_path))).first().phrases) == 1
    assert sorted(r["index"] for r in catalogs.snapshot(spark, str(tmp_path), ["m1"]).collect()) == [0, 1]
    assert spark.range(1).select(names.is_digest(F.lit("0" * 16)).alias("a"), names.is_digest(F.lit("g" * 16)).alias("b")).first() == (True, False)


def test_epub(spark, tmp_path):
    chapter = lambda body: f"<html><head><title>t</title></head><body>{body}</body></html>"
    links = "".join(f'<li><a href="c{k}.xhtml">Part {k}</a></li>' for k in range(6))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="x"><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>')
        names_ = ["nav", "copyright", "toc1", "c1", "c2"]
        items = "".join(f'<item id="{n}" href="{n}.xhtml" media-type="application/xhtml+xml"{" properties=%snav%s" % (chr(34), chr(34)) if n == "nav" else ""}/>' for n in names_)
        z.writestr("O/p.opf", f'<package xmlns="y"><metadata><title> </title><title>The Book</title></metadata><manifest>{items}<item id="ncx" href="n.ncx" media-type="application/x-dtbncx+xml"/></manifest><spine>{"".join(f"<itemref idref={chr(34)}{n}{chr(34)}/>" for n in names_)}</spine></package>')
        z.writestr("O/n.ncx", '<ncx><navPoint><navLabel><text>First &amp; one</text></navLabel><content src="./c1.xhtml#a"/></navPoint></ncx>')
        bodies = {"nav": links, "copyright": "rights", "toc1": f"<h1>Contents</h1><ul>{links}</ul>", "c1": "<p>It <b>was</b>\n so.</p><p>Go<br/>on</p><hr/><ul><li>x</li></ul>", "c2": "<h2>Two</h2><p>Text.</p>"}
        for n, b in bodies.items():
            z.writestr(f"O/{n}.xhtml", chapter(b))
    (tmp_path / "b.epub").write_bytes(data.getvalue())
    (tmp_path / "z.epub").write_bytes(b"no zip")
    found = epub.parts(spark, str(tmp_path)).cache()
    assert [(r.book, r.title) for r in epub.book_titles(found).collect()] == [("b.epub", "The Book")] and found.where("kind = 'error'").count() == 1
    c = {r.href: (r.title, r.reason) for r in epub.chapters(found).collect()}
    assert c == {"copyright.xhtml": ("t", "publication name"), "toc1.xhtml": ("Contents", "contents name"), "c1.xhtml": ("First & one", None), "c2.xhtml": ("Two", None)}
    t = {r.title: r.text for r in epub.chapter_texts(found).collect()}
    assert t == {"First & one": "It was\nso.\n\nGo\non\n\n* * *\n\n\n- x", "Two": "Two\n\nText."}
    html = spark.createDataFrame([("<p><span>Will it?</span><span>\n</span><span>Yes.</span></p>",), ("<body><img src=x>\n</body>",), ("<div>a\n</div>\n<div>b</div>",)], "h string")
    got = [(r.text, r.repairs, r.image_only) for r in pages.reading_text(html, "h").collect()]
    assert got[:2] == [("Will it? Yes.", 1, False), ("", 0, True)] and got[2][0].split() == ["a", "b"]


def stream_of(spark, tmp_path, name, frames, schema):
    folder = tmp_path / name
    for k, f in enumerate(frames):
        f.write.parquet(str(folder / f"p{k}"))
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(folder))


def until(found, seconds=60):
    end = time.time() + seconds
    while time.time() < end:
        if found():
            return True
        time.sleep(0.3)
    return False


def run(df, name, tmp_path, n):
    """The rows of a stream that is stopped once it has n of them (its timers would keep it going)."""
    q = df.writeStream.format("memory").queryName(name).trigger(processingTime="100 milliseconds").option("checkpointLocation", str(tmp_path / f"cp-{name}")).start()
    try:
        assert until(lambda: q.exception() is not None or df.sparkSession.table(name).count() >= n) and q.exception() is None, q.exception()
        return df.sparkSession.table(name).collect()
    finally:
        q.stop()


def test_utterances(spark, tmp_path):
    stateful.timers(spark)
    rate, block = 1000, 100
    level = [0.001] * 10 + [0.2] * 20 + [0.001] * 10 + [0.001] * 5
    rows = [("s", k, [v] * block, None) for k, v in enumerate(level)] + [("s", 90, [], "flush"), ("s", 91, [0.3] * block, None), ("s", 92, [], "end")]
    schema = "stream string, number long, samples array<double>, control string"
    batch = utterances.utterances(spark.createDataFrame(rows, schema), rate, block).collect()
    assert [(r.first_block, r.last_block, r.n_samples, r.flushed) for r in batch] == [(6, 34, 2900, False), (91, 91, 100, True)]
    live = utterances.utterances(stream_of(spark, tmp_path, "u", [spark.createDataFrame(rows, schema).coalesce(1)], schema), rate, block)
    assert sorted(map(tuple, run(live, "utter", tmp_path, 2))) == sorted(map(tuple, batch))
    speech = [("s", k, [0.3] * block, None) for k in range(20)]
    assert [(r.first_block, r.last_block, r.flushed) for r in utterances.utterances(spark.createDataFrame(speech, schema), rate, block).collect()] == [(0, 19, True)]  # open at the end


def test_deltas_and_blocks(spark, tmp_path):
    stateful.timers(spark)
    assert deltas.take_complete("Hi. ", True) == ([], "Hi. ") and deltas.take_complete("This is a long one. And", True) == (["This is a long one. "], "And")
    assert deltas.take_complete("Now there are many words, and more", True) == (["Now there are many words, "], "and more")
    assert deltas.take_complete("I met Mr. Smith", False) == ([], "I met Mr. Smith") and deltas.take_complete("One. Two. So", False) == (["One. ", "Two. "], "So")
    rows = [("k", k, t, 1, False) for k, t in enumerate(["It is ", "all well now. So ", "be it. Fi", "ne."])] + [("k", 4, "", 1, True), ("k", 5, "Old text.", 0, True), ("k", 6, "New. ", 2, False), ("k", 7, "Words", 2, True), ("j", 0, "Open ended. So", 1, False)]
    schema = "key string, ord int, text string, generation int, last boolean"
    got = [(r.key, r.sequence, r.piece, r.reason) for r in deltas.folded(spark.createDataFrame(rows, schema)).collect()]
    assert sorted(got) == [("j", 0, "Open ended. So", "is"), ("k", 0, "It is all well now. ", "s"), ("k", 1, "So be it. ", "s"), ("k", 2, "Fine.", "s"), ("k", 3, "New. Words", "is")]
    live = deltas.folded(stream_of(spark, tmp_path, "d", [spark.createDataFrame(rows, schema).coalesce(1)], schema))
    assert sorted((r.key, r.sequence, r.piece, r.reason) for r in run(live, "folded", tmp_path, 4)) == [x for x in sorted(got) if x[0] == "k"]
    b = deltas.blocks(spark.createDataFrame([("k", 0, 15, 8), ("k", 1, 10, 8), ("k", 2, 3, 16), ("k", 3, 0, 16), ("k", 4, 7, 16)], "key string, ord int, n_samples long, rate long"), 10)
    assert [(r.sequence, r.start_sample, r.n_samples, r.rate) for r in b.collect()] == [(0, 0, 10, 8), (1, 10, 10, 8), (2, 20, 5, 8), (3, 25, 3, 16), (4, 28, 7, 16)]
    s = spark.range(1).select(deltas.complete_sentences(F.lit("A b. C d. E")).alias("c"), deltas.stable_preview(F.lit("A b. C d. E")).alias("p")).first()
    assert s.c == ["A b. ", "C d. "] and s.p == "A b. C d. "


def test_a_stream_at_rest_hands_out_what_it_holds(spark, tmp_path):
    stateful.timers(spark)
    schema = "key string, ord int, n_samples long, rate long"
    rows = stream_of(spark, tmp_path, "idle", [spark.createDataFrame([("k", 0, 25, 8)], schema).coalesce(1)], schema)
    q = deltas.blocks(rows, 10).writeStream.format("memory").queryName("idle").trigger(processingTime="200 milliseconds").option("checkpointLocation", str(tmp_path / "cp-idle")).start()
    try:
        assert until(lambda: spark.table("idle").count() == 3)
        assert sorted((r.sequence, r.start_sample, r.n_samples) for r in spark.table("idle").collect()) == [(0, 0, 10), (1, 10, 10), (2, 20, 5)]
        spark.createDataFrame([("k", 1, 4, 8)], schema).coalesce(1).write.parquet(str(tmp_path / "idle" / "p9"))  # its state went: it begins anew
        assert until(lambda: spark.table("idle").count() == 4)
        assert [(r.start_sample, r.n_samples) for r in spark.table("idle").where("n_samples = 4").collect()] == [(0, 4)]
    finally:
        q.stop()


def test_prompts_whatever_the_micro_batches(spark, tmp_path):
    stateful.timers(spark)
    log = [("k", k, a, t) for k, (a, t) in enumerate([("delete", None), ("enter", None), ("add", "one"), ("add", "two "), ("add", "three"), ("left", None), ("delete", None), ("delete", None), ("add", " four"), ("enter", None), ("right", None), ("add", "five"), ("enter", None), ("add", "left over")])]
    schema = "key string, ord int, action string, text string"
    want = [(0, "one four", 2), (1, "five", 1)]
    assert [(r.sequence, r.prompt, r.n_pieces) for r in prompts.assembled(spark.createDataFrame(log, schema)).collect()] == want
    for name, cuts in (("each", range(len(log))), ("some", (0, 3, 4, 9))):
        edges = [*cuts, len(log)]
        parts = [spark.createDataFrame(log[a:b], schema).coalesce(1) for a, b in zip(edges, edges[1:], strict=False)]
        got = run(prompts.assembled(stream_of(spark, tmp_path, name, parts, schema)), f"prompt_{name}", tmp_path, 2)
        assert sorted((r.sequence, r.prompt, r.n_pieces) for r in got) == want
    assert [r.prompt for r in prompts.assembled(spark.createDataFrame(log[2:4], schema), immediate=True).collect()] == ["one", "two"]


def test_a_catalog_loses_what_its_folder_loses(spark, tmp_path):
    folder, table = tmp_path / "takes", f"file://{tmp_path}/catalog"
    folder.mkdir()
    name = lambda k, e="": f"[{k:05}] [0123456789abcdef] [m1] [v] {e}t.flac"
    for k in (1, 2, 3):
        (folder / name(k)).write_bytes(b"x")
    (folder / "other.flac").write_bytes(b"x")
    assert sorted((r.change, r["index"]) for r in catalogs.follow_once(spark, str(folder), table, ["m1"], 0).collect()) == [("added", 0), ("added", 1), ("added", 2)]
    (folder / name(2)).unlink()
    (folder / name(3)).write_bytes(b"longer")
    (folder / name(4, "[7] ")).write_bytes(b"x")
    feed = catalogs.follow_once(spark, str(folder), table, ["m1"], 1).collect()
    assert sorted((r.change, r["index"]) for r in feed) == [("added", 3), ("changed", 2), ("removed", 1)]
    now = lambda: {r["index"]: (r.bytes, r.errors) for r in catalogs.current(spark, table).collect()}
    assert now() == {0: (1, -1), 2: (6, -1), 3: (1, 7)}
    catalogs.follow_once(spark, str(folder), table, ["m1"], 1)
    assert now() == {0: (1, -1), 2: (6, -1), 3: (1, 7)}
    live = f"file://{tmp_path}/live"
    q = catalogs.follow(spark, str(folder), live, ["m1"], str(tmp_path / "cp-live"))
    try:
        assert until(lambda: catalogs._versions(spark, live) and catalogs.current(spark, live).count() == 3, 90)
        for k in (7, 8, 9):  # at any time of its work
            (folder / name(k)).write_bytes(b"x")
            time.sleep(0.4)
            (folder / name(k)).unlink()
        (folder / name(1)).unlink()
        assert until(lambda: q.exception() is not None or catalogs.current(spark, live).count() == 2, 90) and q.exception() is None, q.exception()
    finally:
        q.stop()


def test_tags_and_samples_of_files(spark, tmp_path):
    audio.register(spark)
    flac = audio.flac_with_tag(audio.flac_with_tag(b"ID3\4\0\0\0\0\0\3abc" + audio.flac_file(8000, 5, b"frames"), "title", "é=1"), "x", "y")
    assert audio.flac_tags(lambda a, n: flac[a : a + n]) == [("TITLE", "é=1"), ("X", "y")] and flac.endswith(b"frames") and flac.startswith(b"ID3")
    again = audio.flac_with_tag(flac, "Title", "new")
    assert audio.flac_tags(lambda a, n: again[a : a + n]) == [("X", "y"), ("TITLE", "new")]
    offsets = lambda d: int.from_bytes(d[d.index(b"stco") + 12 : d.index(b"stco") + 16], "big")
    stbl = audio.atom(b"stbl", audio.atom(b"stco", bytes(4) + (1).to_bytes(4, "big") + (72).to_bytes(4, "big")))
    mp4 = audio.atom(b"ftyp", b"M4A ") + audio.atom(b"moov", audio.atom(b"trak", audio.atom(b"mdia", audio.atom(b"minf", stbl)))) + audio.atom(b"mdat", b"sound")
    mp4 = mp4.replace((72).to_bytes(4, "big"), (mp4.index(b"sound")).to_bytes(4, "big"))
    out = audio.mp4_with_tag(audio.mp4_with_tag(mp4, "a.b", "t", "1"), "a.b", "u", "2")
    out = audio.mp4_with_tag(out, "a.b", "t", "longer é")
    assert audio.mp4_tags(lambda a, n: out[a : a + n], len(out)) == [("----:a.b:u", "2"), ("----:a.b:t", "longer é")] and out[offsets(out) :].startswith(b"sound")
    for n, d in (("a.flac", flac), ("b.m4a", out), ("c.flac", b"none"), ("d.flac", flac[:60]), ("e.m4a", b"\0\0\0\1moov"), ("f.flac", b"")):
        (tmp_path / n).write_bytes(d)
    got = sorted((r.file, r.kind, r.field, r.value) for r in spark.read.format("audio_tags").option("path", f"file://{tmp_path}").option("filesPerTask", 2).load().collect() if r.kind != "error")
    assert got == [("a.flac", "flac", "TITLE", "é=1"), ("a.flac", "flac", "X", "y"), ("b.m4a", "mp4", "----:a.b:t", "longer é"), ("b.m4a", "mp4", "----:a.b:u", "2")]
    x = (np.arange(2501) * 37 % 30001 - 15000).astype(np.int16)
    (tmp_path / "w.wav").write_bytes(audio.wave_file(x, 8000))
    (tmp_path / "bad.wav").write_bytes(b"RIFF")
    for size, split in ((100, 250), (1000, 1 << 20), (4000, 1)):
        p = spark.read.format("pcm_chunks").option("path", f"file://{tmp_path}").option("chunkSamples", size).option("splitSamples", split).load().orderBy("chunk").collect()
        assert np.allclose(np.concatenate([r.samples for r in p]) * 32768, x) and [r.start_sample for r in p] == list(range(0, len(x), size))


def test_longer_sound(spark):
    rate = 8000
    t = np.arange(rate) / rate
    tones = spark.createDataFrame([(f, (0.5 * np.sin(2 * np.pi * f * t)).tolist()) for f in (300, 1500, 2500, 3900)], "f int, x array<double>")
    level = {r.f: float(np.sqrt(np.mean(np.square(r.y[200:-200])))) for r in tones.select("f", signal.band_limited(F.col("x"), rate, 4000).alias("y")).collect()}
    assert all(abs(level[f] - 0.5 / np.sqrt(2)) < 0.005 for f in (300, 1500)) and level[2500] < 0.002 and level[3900] < 0.002
    up = tones.where("f = 300").select(signal.band_limited(F.col("x"), rate, 12000).alias("y")).first().y
    assert len(up) == 12000 and np.allclose(up[300:-300], 0.5 * np.sin(2 * np.pi * 300 * np.arange(12000) / 12000)[300:-300], atol=2e-3)
    x = np.random.default_rng(2).normal(size=1003)
    for size, overlap in ((100, 20), (250, 1), (1003, 5), (64, 31)):
        starts = range(0, max(1, len(x) - overlap), size - overlap)
        chunks = spark.createDataFrame([("k", s, x[s : s + size].tolist()) for s in starts], "key string, start long, x array<double>")
        got = signal.overlap_added(chunks, "key", "start", "x", overlap).orderBy("start").collect()
        assert np.allclose(np.concatenate([r.x for r in got]), x) and [r.start for r in got] == [0, *np.cumsum([len(r.x) for r in got])[:-1].tolist()]


def burst_by_hand(x, sr):
    """Frame by frame from the end."""
    most, after, lead, frame, quiet = (int(sr * ms / 1000) for ms in (65, 10, 120, 5, 25))
    level = lambda y: math.sqrt(sum(v * v for v in y) / len(y)) if len(y) else 0.0
    top = max(map(abs, x), default=0)
    if len(x) <= most + quiet or not top:
        return None
    cut = [(k, min(k + frame, len(x))) for k in range(len(x) - most, len(x), frame)]
    while cut and level(x[cut[-1][0] : cut[-1][1]]) < 0.045 * top:
        cut.pop()
    if not cut or len(x) - cut[-1][1] > after:
        return None
    end, begin = cut[-1][1], cut[-1][0]
    while cut and level(x[cut[-1][0] : cut[-1][1]]) >= 0.045 * top:
        begin = cut.pop()[0]
    noise = x[begin:end]
    if level(noise) < 0.045 * top or max(map(abs, noise)) < 0.07 * top:
        return None
    before = x[max(0, begin - lead) : begin]
    if len(before) < quiet:
        return None
    levels, run = [level(before[k : k + frame]) for k in range(0, len(before), frame)], []
    while levels and levels[-1] <= 0.06 * top:
        run.append(levels.pop())
    if len(run) < max(1, math.ceil(quiet / frame)) or level(noise) / max(float(np.median(run)), top * 1e-5) < 2:
        return None
    return begin


def test_bursts(spark):
    rng, rows = random.Random(4), []
    for k in range(80):
        sr = rng.choice([1600, 8000])
        speech = [rng.uniform(-0.9, 0.9) for _ in range(rng.randint(0, sr // 4))]
        quiet = [rng.uniform(-1, 1) * rng.choice([0.001, 0.02, 0.05, 0.1]) for _ in range(int(sr * rng.choice([0.01, 0.03, 0.2])))]
        burst = [rng.uniform(-1, 1) * rng.choice([0.05, 0.4]) for _ in range(int(sr * rng.choice([0, 0.01, 0.04, 0.1])))]
        rest = [0.0] * int(sr * rng.choice([0, 0.004, 0.02]))
        rows.append((k, sr, speech + quiet + burst + rest))
    found = 0
    for sr in (1600, 8000):
        df = spark.createDataFrame([r for r in rows if r[1] == sr], "k int, sr int, x array<double>")
        for r in df.select("k", F.size(signal.without_burst(F.col("x"), sr)).alias("n")).collect():
            want = burst_by_hand(rows[r.k][2], sr)
            assert r.n == (len(rows[r.k][2]) if want is None else want), r.k
            found += want is not None
    assert found > 5


def test_signals(spark):
    quiet = [0.0] * 40
    x = [0.5] * 20 + quiet + [0.5] * 20
    df = spark.createDataFrame([("a", x, len(x) / 100), ("b", [0.0] * 50, 0.5)], "k string, x array<double>, d double")
    i = signal.silent_intervals(signal.frames(df, "k", "x", 3, 1), df, "k", 1, 100, "d")
    got = {(r.k, round(r.start, 2), round(r.end, 2)) for r in i.collect()}
    assert got == {("a", 0.21, 0.59), ("b", 0.0, 0.5)}
    kept = [(round(r.start, 2), round(r.end, 2)) for r in signal.capped_gaps(i, df, "k", "d", 0.1).where("k = 'a'").orderBy("start").collect()]
    assert kept == [(0.0, 0.21), (0.35, 0.45), (0.59, 0.8)]
    tone = [0.5 * math.sin(2 * math.pi * 997 * n / 48000) for n in range(48000)]
    r = spark.createDataFrame([(tone, tone[:100])], "x array<double>, s array<double>").select(
        signal.integrated_loudness(F.col("x"), 48000).alias("l"), signal.integrated_loudness(F.col("s"), 48000).alias("n"), F.size(signal.high_shelf(F.col("x"), 48000, 0.6, 4200.0, 1.1)).alias("h"), signal.quietest_near(F.lit([0.5] * 30 + [0.0] * 5 + [0.5] * 30), F.lit(0.3), F.lit(100)).alias("q"),
        F.size(signal.cross_faded(F.lit([1.0] * 10), F.lit([0.0] * 10), 4)).alias("c"), signal.loudness_report(F.lit('x\n{"input_i" : "-20.1"}\n'))["input_i"].alias("i"), signal.discarded(F.lit([0.0, 0.0])).alias("d"),
    ).first()
    assert abs(r.l - (-9.03)) < 0.1 and r.n is None and r.h == 48000 and 0.3 <= r.q <= 0.35 and r.c == 16 and r.i == "-20.1" and r.d == "silent"
    p = spark.createDataFrame([(pd.NA is None, b"abc", 0), (False, b"d", 1), (False, b"", 2), (False, b"efg", 3)], "z boolean, b binary, o int")
    s = signal.pcm_samples(p.withColumn("k", F.lit(1)), "k", "o", "b").orderBy("o").collect()
    assert b"".join(bytes(r.b) for r in s) == b"abcdef" and [r.n_samples for r in s] == [1, 1, 0, 1]
