"""Queries on timelines and signals. Events stand in for timed items and energy frames of a clip (their user), embeddings for clips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.operators import segmentation as seg
from folioforge.operators import signal as sig
from folioforge.operators import timeline as tl
from folioforge.registry import register, table

#: Items of a clip in order: hundredths of seconds, 0 where there is no audio.
ITEMS_SQL = "WITH items AS (SELECT user_id, event_id, CASE WHEN event_type IN ('view', 'error') THEN 0 ELSE CAST(round(value * 100) AS BIGINT) END AS dur, event_type FROM events) "


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    silent = F.col("event_type").isin("view", "error")
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.when(silent, 0).otherwise(F.round(F.col("value") * 100).cast("long")).alias("dur"), "event_type")


@register("timeline_cursor", ITEMS_SQL + """
, c AS (SELECT *, CAST(sum(dur) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS t FROM items)
SELECT user_id, event_id, CASE WHEN dur > 0 THEN t - dur ELSE 0 END AS time_start, CASE WHEN dur > 0 THEN t ELSE 0 END AS time_end FROM c
""")
def timeline_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start and end of each item on its clip's timeline; an item without audio is (0, 0)."""
    return tl.time_cursor(items(spark, sf_dir), "user_id", "event_id", "dur").select("user_id", "event_id", "time_start", "time_end")


@register("discontinuity_runs", ITEMS_SQL + """
, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM items), g AS (SELECT user_id, event_id, rn - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM r WHERE dur <= 0)
SELECT user_id, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM g GROUP BY user_id, run HAVING count(*) >= 2
""")
def discontinuity_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two or more neighbouring items without audio."""
    return tl.runs_without_audio(items(spark, sf_dir), "user_id", "event_id", "dur", 2)


@register("last_audio_ordinal", ITEMS_SQL + "SELECT user_id, event_id, CAST(sum(CASE WHEN dur > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) - 1 AS audio_ordinal FROM items")
def last_audio_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last audio up to each item (-1: none yet)."""
    return tl.last_audio(items(spark, sf_dir), "user_id", "event_id", F.col("dur") > 0).select("user_id", "event_id", "audio_ordinal")


@register("continuation_sessions", ITEMS_SQL + "SELECT user_id, event_id, CAST(coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS session FROM items")
def continuation_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that end with each reset."""
    return tl.resets(items(spark, sf_dir), "user_id", "event_id", F.col("event_type") == "purchase").select("user_id", "event_id", "session")


SECTIONS_SQL = """
WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1), sections AS (SELECT o_custkey AS book, o_orderkey AS section, coalesce(n, 0) AS n FROM orders LEFT JOIN n ON l_orderkey = o_orderkey),
ranges AS (SELECT book, section, CAST(sum(n) OVER (PARTITION BY book ORDER BY section) AS BIGINT) - n AS start_index, CAST(sum(n) OVER (PARTITION BY book ORDER BY section) AS BIGINT) AS end_index FROM sections)
"""


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("section")).agg(F.count("*").alias("n"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book"), F.col("o_orderkey").alias("section"))
    return tl.section_ranges(o.join(n, "section", "left").withColumn("n", F.coalesce("n", F.lit(0))), "book", "section", "n")


@register("section_ranges", SECTIONS_SQL + "SELECT book, section, start_index, end_index FROM ranges")
def section_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-open ranges of lines of each section of a book."""
    return sections(spark, sf_dir).select("book", "section", "start_index", "end_index")


MARKERS_SQL = """
, sizes AS (SELECT book, max(end_index) AS n FROM ranges GROUP BY book), starts AS (SELECT DISTINCT book, start FROM (SELECT book, section % 37 AS start FROM ranges UNION ALL SELECT book, 0 FROM sizes)),
inside AS (SELECT book, start, n FROM starts JOIN sizes USING (book) WHERE start < n), files AS (SELECT book, start, coalesce(lead(start) OVER (PARTITION BY book ORDER BY start), n) - 1 AS "end" FROM inside)
"""


def _files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = sections(spark, sf_dir)
    sizes = s.groupBy("book").agg(F.max("end_index").alias("n"))
    return s, tl.marker_ranges(s.select("book", (F.col("section") % 37).alias("marker")), sizes, "book", "marker", "n")


@register("markers_to_ranges", SECTIONS_SQL + MARKERS_SQL + 'SELECT book, start, "end" FROM files')
def markers_to_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inclusive ranges of lines between the markers of a book."""
    return _files(spark, sf_dir)[1]


@register("chapter_overlap", SECTIONS_SQL + MARKERS_SQL + 'SELECT r.book, section, start_index, end_index, start, "end" FROM ranges r JOIN files f ON r.book = f.book AND start_index <= "end" AND end_index > start')
def chapter_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections that each output file touches."""
    s, files = _files(spark, sf_dir)
    return tl.overlaps(s, files, "book").select("book", "section", "start_index", "end_index", "start", "end")


@register("asof_segment_at_time", """
WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS t FROM events), s AS (SELECT user_id, t AS t0, min(event_id) AS segment FROM e WHERE event_type = 'click' GROUP BY user_id, t)
SELECT q.event_id, q.user_id, CASE WHEN q.t < s.t0 + 3600000000 THEN s.segment END AS segment FROM (SELECT * FROM e WHERE event_type = 'purchase') q ASOF LEFT JOIN s ON q.user_id = s.user_id AND q.t >= s.t0
""")
def asof_segment_at_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segment (an hour from each click) that holds each purchase of its user."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    s = e.where("event_type = 'click'").groupBy("user_id", F.col("t").alias("t0")).agg(F.min("event_id").alias("segment")).withColumn("t1", F.col("t0") + 3_600_000_000)
    q = e.where("event_type = 'purchase'").select("event_id", "user_id", "t")
    return tl.as_of(q, s, "user_id", "t", "t0", "t1", "segment").select("event_id", "user_id", "segment")


@register("pause_compensation", """
WITH p AS (SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 'is' WHEN 'view' THEN 's' WHEN 'signup' THEN 'p' ELSE 'x' END AS reason, (event_id % 7) / 10.0::DOUBLE AS head, (event_id % 4) / 10.0::DOUBLE AS tail FROM events WHERE event_type <> 'error'),
n AS (SELECT *, lead(head) OVER (PARTITION BY user_id ORDER BY event_id) AS next_head FROM p)
SELECT user_id, event_id, round(CASE WHEN next_head IS NULL THEN 0 ELSE greatest(0, CASE reason WHEN 'is' THEN 0.5 WHEN 's' THEN 0.9 WHEN 'p' THEN 1.2 ELSE 2.0 END - tail - next_head) END, 6) AS pause FROM n
""")
def pause_compensation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pauses between present items, less the silence they have themselves."""
    e, k = F.col("event_type"), F.col("event_id")
    reason = F.when(e == "click", "is").when(e == "view", "s").when(e == "signup", "p").otherwise("x")
    p = table(spark, sf_dir, "events").select("user_id", "event_id", reason.alias("reason"), (k % 7 / 10).alias("head"), (k % 4 / 10).alias("tail"), (e != "error").alias("present"))
    return tl.pauses(p, "user_id", "event_id", "reason", "head", "tail", "present").select("user_id", "event_id", F.round("pause", 6).alias("pause"))


@register("eta_moving_avg", """
SELECT user_id, event_id, CASE WHEN count(*) OVER w >= 5 THEN round(avg(value) OVER w, 6) END AS mean_seconds FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)
""")
def eta_moving_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the last 50 durations, from the fifth on."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return tl.remaining_time(e, "user_id", "event_id", "value").select("user_id", "event_id", F.round("mean_seconds", 6).alias("mean_seconds"))


FRAMES_SQL = """
WITH x AS (SELECT vec_id, label, embedding::DOUBLE[] AS x, len(embedding) AS n FROM embeddings), f AS (SELECT vec_id, x, n, unnest(range(CAST(floor((n + 8 - 8) / 4) AS BIGINT) + 1)) AS frame FROM x),
r AS (SELECT vec_id, frame, n, sqrt(list_sum(list_transform(x[greatest(frame * 4 - 3, 1):least(frame * 4 + 4, n)], lambda v: v * v)) / 8) AS rms FROM f),
q AS (SELECT *, rms < max(rms) OVER (PARTITION BY vec_id) * pow(10, -3 / 20.0) AS quiet FROM r), g AS (SELECT *, frame - row_number() OVER (PARTITION BY vec_id ORDER BY frame) AS run FROM q WHERE quiet),
s AS (SELECT vec_id, min(frame) * 4 / 16.0 AS start, least((max(frame) + 1) * 4 / 16.0, any_value(n) / 16.0) AS "end" FROM g GROUP BY vec_id, run HAVING count(*) >= 2), i AS (SELECT * FROM s WHERE start < "end")
"""


def _clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("x"), (F.size("embedding") / 16).alias("duration"))


def _intervals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = _clips(spark, sf_dir)
    return sig.silent_intervals(sig.frames(c, "vec_id", "x", 8, 4), c, "vec_id", 4, 16, "duration", -3.0, 2), c


@register("framed_rms", FRAMES_SQL + "SELECT vec_id, frame, round(rms, 9) AS rms FROM r")
def framed_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energy of centred frames of eight samples, four apart."""
    f = sig.frames(_clips(spark, sf_dir), "vec_id", "x", 8, 4)
    return f.select("vec_id", F.col("frame").cast("long").alias("frame"), F.round("rms", 9).alias("rms"))


@register("silence_runs", FRAMES_SQL + "SELECT vec_id, start, \"end\" FROM i")
def silence_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silences of each clip: two frames and more that are 3 dB below the loudest (16 samples a second)."""
    return _intervals(spark, sf_dir)[0]


@register("end_silences", FRAMES_SQL + "SELECT x.vec_id, max(CASE WHEN start = 0 THEN \"end\" END) AS lead, max(CASE WHEN \"end\" >= x.n / 16.0 THEN start END) AS tail FROM x LEFT JOIN i ON x.vec_id = i.vec_id GROUP BY x.vec_id")
def end_silences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silence at the start and at the end of each clip."""
    c = _clips(spark, sf_dir)
    return sig.end_silences(sig.frames(c, "vec_id", "x", 8, 4), c, "vec_id", 4, 16, "duration", -3.0, 2)


@register("capped_gaps", FRAMES_SQL + """
, l AS (SELECT *, coalesce(lag("end") OVER (PARTITION BY vec_id ORDER BY start), 0) AS before FROM i),
k AS (SELECT vec_id, before AS a, start AS b FROM l UNION ALL SELECT vec_id, CASE WHEN "end" - start > 0.3 THEN (start + "end") / 2 - 0.15 ELSE start END, CASE WHEN "end" - start > 0.3 THEN (start + "end") / 2 + 0.15 ELSE "end" END FROM l
  UNION ALL SELECT x.vec_id, coalesce(max("end"), 0), any_value(n) / 16.0 FROM x LEFT JOIN i ON x.vec_id = i.vec_id GROUP BY x.vec_id)
SELECT vec_id, round(a, 6) AS start, round(b, 6) AS "end" FROM k WHERE b > a
""")
def capped_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of each clip that stay when silences are cut to their middle 0.3 seconds."""
    i, c = _intervals(spark, sf_dir)
    return sig.capped_gaps(i, c, "vec_id", "duration", 0.3).select("vec_id", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@register("clip_edits", """
WITH x AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), p AS (SELECT vec_id, x, list_max(list_transform(x, lambda v: abs(v))) AS peak FROM x)
SELECT vec_id, len(x) AS n, len(x) + 8 AS n_longer, round(list_sum(x[5:16]), 6) AS cut_sum, round(CASE WHEN peak > pow(10, -6 / 20.0) THEN pow(10, -6 / 20.0) ELSE peak END, 6) AS soft_peak, len(x) * 2 AS n_double, round(list_sum(list_transform(x, lambda v: greatest(-1, least(1, v)))), 6) AS clean_sum,
  CASE WHEN peak > 1 THEN 'out of range' ELSE '' END AS reasons, round(list_sum(list_transform(x, lambda v: (v + 2 * v) / 2)), 5) AS mono_sum FROM p
""")
def clip_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips with silence behind, cut, softened, at twice the rate, cleaned, checked, mixed to one channel."""
    x = F.col("x")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    return _clips(spark, sf_dir).withColumn("x", F.transform("x", lambda v: v.cast("double"))).select(
        "vec_id", F.size(x).cast("long").alias("n"), F.size(sig.with_silence(x, F.lit(0.5), 16)).cast("long").alias("n_longer"), F.round(total(sig.trimmed(x, F.lit(0.25), F.lit(1.0), 16)), 6).alias("cut_sum"), F.round(sig.peak(sig.attenuated(x, -6.0)), 6).alias("soft_peak"),
        F.size(sig.resampled(x, 16, 32)).cast("long").alias("n_double"), F.round(total(sig.cleaned(x)), 6).alias("clean_sum"), F.array_join(sig.invalid_reasons(x), " ").alias("reasons"), F.round(total(sig.mono(F.array(x, F.transform(x, lambda v: v * 2)))), 5).alias("mono_sum"),
    )


@register("top_classes", """
WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS score, unnest(range(len(embedding))) AS class FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, class) AS k FROM x)
SELECT vec_id, class, round(score, 6) AS score FROM r WHERE k <= 5 AND score >= 0.2
""")
def top_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best classes of each frame with a score of 0.2 or more."""
    t = sig.top_classes(table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("s")), "vec_id", "s", 5, 0.2)
    return t.select("vec_id", F.col("class").cast("long").alias("class"), F.round("score", 6).alias("score"))


@register("music_clips", """
WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS score, unnest(range(len(embedding))) AS class FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, class) AS k FROM x)
SELECT label, bool_or(class = 3) AS found FROM r WHERE k <= 10 AND score >= 0.1 GROUP BY label
""")
def music_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a clip (a label) has a frame that shows class 3 among its ten best."""
    e = table(spark, sf_dir, "embeddings").select(F.struct("vec_id", "label").alias("k"), F.transform("embedding", lambda v: v.cast("double")).alias("s"))
    return sig.has_class(sig.top_classes(e, "k", "s", 10, 0.1).select(F.col("k.label").alias("label"), "class"), "label", 3)


@register("pcm_streams", """
SELECT conv_id, turn, CAST((octet_length(encode(coalesce(text, ''))) + coalesce(b, 0) % 2) // 2 AS BIGINT) AS n_samples FROM (SELECT *, sum(octet_length(encode(coalesce(text, '')))) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM conversations)
""")
def pcm_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams of bytes in chunks as 16-bit samples: an odd byte goes on to the next chunk."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("b"))
    return sig.pcm_samples(c, "conv_id", "turn", "b").select("conv_id", "turn", F.col("n_samples").cast("long").alias("n_samples"))


@register("playback_log", "SELECT user_id, event_id, CAST(sum(event_id % 50) OVER (PARTITION BY user_id ORDER BY event_id) - event_id % 50 AS BIGINT) AS sample_start, CAST(sum(event_id % 50) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS sample_end FROM events")
def playback_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of a stream's samples that enqueued pieces take."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 50).alias("n"))
    s = tl.section_ranges(e, "user_id", "event_id", "n")
    return s.select("user_id", "event_id", F.col("start_index").alias("sample_start"), F.col("end_index").alias("sample_end"))


@register("noise_floor_p20", """
SELECT user_id, event_id, round(quantile_cont(value, 0.2) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 6) AS floor FROM events
""")
def noise_floor_p20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20th percentile of the 20 frames before each frame."""
    f = sig.noise_floor(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", "event_id", "value")
    return f.select("user_id", "event_id", F.round("floor", 6).alias("floor"))


@register("clip_levels", """
WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i, len(embedding) AS n FROM embeddings)
SELECT vec_id, round(sqrt(sum(x * x) / count(*)), 6) AS rms, round(max(abs(x)), 6) AS peak, sqrt(sum(x * x) FILTER (WHERE i >= n - 8) / 8) > pow(10, -1) + 1e-8 AS cut_off,
  CAST(sum(trunc(greatest(-1, least(1, x)) * 32767)) AS BIGINT) AS pcm_sum FROM x GROUP BY vec_id
""")
def clip_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loudness, peak, a tail that is still loud, and the sum of the 16-bit samples of each clip."""
    x = F.col("embedding")
    pcm = F.aggregate(sig.pcm16(x), F.lit(0).cast("long"), lambda a, v: a + v)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(sig.rms(x), 6).alias("rms"), F.round(sig.peak(x), 6).alias("peak"), sig.cut_tail(x, 8).alias("cut_off"), pcm.alias("pcm_sum"))


@register("peak_normalize", """
WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings), p AS (SELECT vec_id, x, max(abs(x)) OVER (PARTITION BY vec_id) AS peak FROM x)
SELECT vec_id, round(max(abs(x / peak * pow(10, -1 / 20.0))), 6) AS peak, round(sum(abs(x / peak * pow(10, -1 / 20.0))), 4) AS total FROM p GROUP BY vec_id
""")
def peak_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips scaled to 1 dB below full scale: their peak and the sum of their magnitudes."""
    n = table(spark, sf_dir, "embeddings").select("vec_id", sig.peak_normalise(F.col("embedding"), 1.0).alias("x"))
    return n.select("vec_id", F.round(sig.peak(F.col("x")), 6).alias("peak"), F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + F.abs(v)), 4).alias("total"))


@register("break_downgrades", """
WITH p AS (SELECT user_id, event_id, CASE WHEN event_type IN ('view', 'error') THEN 'x' ELSE 's' END AS reason FROM events)
SELECT user_id, event_id, CASE WHEN reason = 'x' AND lag(reason) OVER (PARTITION BY user_id ORDER BY event_id) = 'x' THEN 'p' ELSE reason END AS reason FROM p
""")
def break_downgrades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A break right after a break becomes a paragraph's end."""
    p = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("sentence_index"), F.lit(0).alias("phrase_index"), F.when(F.col("event_type").isin("view", "error"), "x").otherwise("s").alias("reason"))
    return seg.downgrade_repeated_breaks(p, "user_id").select("user_id", F.col("sentence_index").alias("event_id"), "reason")


@register("clip_sound")
def clip_sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loudness (of the clip sixty times over), the quietest point near the middle, lifted treble and a cross-fade of each clip (signals; held against literal cases)."""
    c = _clips(spark, sf_dir).withColumn("x", F.transform("x", lambda v: v.cast("double")))
    return c.select(
        "vec_id", F.round(sig.integrated_loudness(F.flatten(F.array_repeat("x", 60)), 8000), 4).alias("loudness"), sig.quietest_near(F.col("x"), F.lit(0.3), F.lit(100)).alias("quiet"), F.round(sig.peak(sig.high_shelf(F.col("x"), 100, 0.6, 20.0, 1.1)), 6).alias("peak"), F.size(sig.cross_faded(F.col("x"), F.col("x"), 8)).alias("n_faded"),
    )


@register("mean_loudness")
def mean_loudness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean loudness of the clips of each label, each sixty times over."""
    c = table(spark, sf_dir, "embeddings").select("label", sig.integrated_loudness(F.flatten(F.array_repeat(F.transform("embedding", lambda v: v.cast("double")), 60)), 8000).alias("l"))
    return c.where("l is not null and l > -1000").groupBy("label").agg(F.round(F.avg("l"), 4).alias("loudness"), F.count("*").alias("n"))
