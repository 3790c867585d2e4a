"""Arrays of samples and frames of energy."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from folioforge.functions.text import let


def rms(data: Column) -> Column:
    return F.sqrt(F.aggregate(data, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) / F.size(data))


def peak(data: Column) -> Column:
    return F.array_max(F.transform(data, lambda x: F.abs(x).cast("double")))


def peak_normalise(data: Column, headroom_db: float) -> Column:
    """Scaled to a peak of ``-headroom_db`` dB; silence stays."""
    gain = 10 ** (-headroom_db / 20)
    return let(peak(data), lambda top: F.transform(data, lambda x: F.when(top > 0, x.cast("double") / top * gain).otherwise(0.0)))


def pcm16(data: Column) -> Column:
    """Clipped to -1..1, to 16-bit integers, cut towards zero."""
    return F.transform(data, lambda x: (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x.cast("double"))) * 32767).cast("int"))


def mono(channels: Column) -> Column:
    """The mean of channels, array<array<double>> with one array a channel."""
    n = F.size(channels)
    zero = F.transform(channels[0], lambda x: F.lit(0.0))
    total = F.aggregate(channels, zero, lambda a, c: F.zip_with(a, c, lambda x, y: x + y.cast("double")))
    return F.transform(total, lambda x: x / n)


def cut_tail(data: Column, samples: int, db: float = -20.0) -> Column:
    """Whether the last samples are still loud: the clip may be cut off."""
    return rms(F.slice(data, -samples, samples)) > 10 ** (db / 20) + 1e-8


def silences(frames: DataFrame, key: str, order: str, level: str, db: float, least: int) -> DataFrame:
    """(key, first, last, n): runs of at least ``least`` frames below the clip's peak by ``-db`` dB."""
    top = frames.groupBy(key).agg(F.max(level).alias("__top"))
    w = Window.partitionBy(key).orderBy(order)
    f = frames.join(top, key).withColumn("__quiet", F.col(level) < F.col("__top") * 10 ** (db / 20)).withColumn("__rn", F.row_number().over(w))
    f = f.where("__quiet").withColumn("__run", F.col("__rn") - F.row_number().over(w))
    return f.groupBy(key, "__run").agg(F.min("__rn").alias("first"), F.max("__rn").alias("last"), F.count("*").alias("n")).where(F.col("n") >= least).drop("__run")


def noise_floor(frames: DataFrame, key: str, order: str, level: str, history: int = 20) -> DataFrame:
    """Adds floor: the 20th percentile of the frames before, at most ``history`` (null at the first)."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-history, -1)
    return frames.withColumn("floor", F.percentile(level, 0.2).over(w))


# ---------------------------------------------------------------- clips


def invalid_reasons(data: Column) -> Column:
    """array<string>: why samples can't be used."""
    x = F.transform(data, lambda v: v.cast("double"))
    finite = F.filter(x, lambda v: ~F.isnan(v))
    reasons = F.array(
        F.when(F.exists(x, F.isnan), "nan"), F.when(F.exists(finite, lambda v: F.abs(v) == float("inf")), "infinite"), F.when(F.coalesce(F.array_max(F.transform(finite, F.abs)) > 1.0, F.lit(False)), "out of range")
    )
    return F.when(F.coalesce(F.size(data) <= 0, F.lit(True)), F.array(F.lit("empty"))).otherwise(F.array_compact(reasons))


def discarded(data: Column, silent_peak: float = 1e-4) -> Column:
    """Why a new clip is thrown away: empty, not a number, or silent; null if it is kept."""
    top = peak(F.filter(data, lambda x: ~F.isnan(x)))
    return F.when(F.coalesce(F.size(data) <= 0, F.lit(True)), "empty").when(F.exists(data, lambda x: F.isnan(x.cast("double"))), "nan").when(top < silent_peak, "silent")


def cleaned(data: Column) -> Column:
    """For a recogniser: what is no number becomes 0, the rest is clipped to -1..1."""
    return F.transform(data, lambda x: F.when(F.isnan(x.cast("double")), 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x.cast("double")))))


def attenuated(data: Column, ceiling_db: float) -> Column:
    """Scaled down to a peak of ``ceiling_db`` if it is above, else as it is."""
    most = 10 ** (ceiling_db / 20)
    return let(peak(data), lambda top: F.transform(data, lambda x: F.when(top > most, x.cast("double") / top * most).otherwise(x.cast("double"))))


def trimmed(data: Column, start: Column, end: Column, rate: int) -> Column:
    """The samples from a time to another; null times are the ends."""
    a = F.greatest(F.coalesce((start * rate).cast("int"), F.lit(0)), F.lit(0))
    b = F.least(F.coalesce((end * rate).cast("int"), F.size(data)), F.size(data))
    return F.when(b > a, F.slice(data, a + 1, b - a)).otherwise(F.slice(data, 1, 0))


def with_silence(data: Column, seconds: Column, rate: int) -> Column:
    return F.concat(data, F.array_repeat(F.lit(0.0), F.greatest((seconds * rate).cast("int"), F.lit(0))))


def cross_faded(a: Column, b: Column, overlap: int) -> Column:
    """Two clips that overlap: the end of one fades into the start of the other, linearly."""
    n = F.least(F.lit(overlap), F.size(a), F.size(b))
    tail, head = F.slice(a, F.size(a) - n + 1, n), F.slice(b, F.lit(1), n)
    ramp = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: i / (n + 1))
    mixed = F.transform(F.arrays_zip(tail.alias("t"), head.alias("h"), F.slice(ramp, F.lit(1), n).alias("r")), lambda x: x["t"] * (1 - x["r"]) + x["h"] * x["r"])
    return F.when(n > 0, F.concat(F.slice(a, F.lit(1), F.size(a) - n), mixed, F.slice(b, n + 1, F.size(b)))).otherwise(F.concat(a, b))


#: Zero crossings of the resampling filter to each side, and where it ends of the lower Nyquist frequency.
CROSSINGS, PASSED = 24, 0.94


def band_limited(data: Column, rate: int, to: int, crossings: int = CROSSINGS, passed: float = PASSED) -> Column:
    """Samples at another rate through a bank of windowed sinc filters, one a phase; what the new rate cannot hold is gone.

    A sample of the result is the product of the filter of its phase with the samples around its time (zeros outside of
    the clip). Clips are worked in runs of the result, so memory is bounded by the filter, not by the clip.
    """
    g = math.gcd(rate, to)
    up, down = to // g, rate // g
    cut = passed * min(1.0, to / rate)
    half = math.ceil(crossings / cut)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(clips: pd.Series) -> pd.Series:
        taps = np.arange(-half, half + 1)
        t = np.arange(up)[:, None] / up - taps[None, :]  # time of each phase from each sample
        bank = np.where(np.abs(t) <= half, cut * np.sinc(cut * t) * (0.5 + 0.5 * np.cos(np.pi * t / half)), 0.0)

        def one(x) -> np.ndarray:
            x = np.asarray(x, np.float64)
            n = len(x) * to // rate
            padded, out = np.pad(x, half + 1), np.empty(n)
            for a in range(0, n, 1 << 14):
                k = np.arange(a, min(a + (1 << 14), n)) * down
                windows = np.lib.stride_tricks.sliding_window_view(padded, 2 * half + 1)[k // up + 1]
                out[a : a + len(k)] = np.einsum("ij,ij->i", windows, bank[k % up])
            return out

        return clips.map(lambda x: None if x is None else one(x))

    return run(data)


def resampled(data: Column, rate: int, to: int) -> Column:
    """Samples at another rate, by straight lines between neighbours; see ``band_limited`` for a rate that is lower."""
    n = F.floor(F.size(data) * to / rate).cast("int")
    at = lambda i: F.least(i * rate / to, (F.size(data) - 1).cast("double"))
    value = lambda p: F.get(data, F.floor(p).cast("int")) + (F.get(data, F.least(F.floor(p).cast("int") + 1, F.size(data) - 1)) - F.get(data, F.floor(p).cast("int"))) * (p - F.floor(p))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: value(at(i)))).otherwise(F.slice(data, 1, 0))


def overlap_added(chunks: DataFrame, key: str, start: str, data: str, overlap: int) -> DataFrame:
    """(key, start, data): processed chunks of clips as one sound, in pieces that follow each other.

    Each chunk but the first begins ``overlap`` samples before the end of the one before; there one fades into the other,
    linearly. A chunk takes its seam from the next chunk's head by a second pass over the seams alone, so any number of
    chunks is joined and no row holds a clip.
    """
    w = Window.partitionBy(key).orderBy(start)
    c = chunks.withColumns({"__head": F.lead(F.slice(data, 1, overlap)).over(w), "__first": F.lag(start).over(w).isNull()})
    n = F.size(data)
    tail = F.least(F.when(F.col("__head").isNull(), 0).otherwise(F.size("__head")), n)
    ramp = lambda i, m: (i + 1) / (m + 1)
    mixed = F.transform(F.slice(data, n - F.col("__m") + 1, F.col("__m")), lambda x, i: x * (1 - ramp(i, F.col("__m"))) + F.get("__head", i) * ramp(i, F.col("__m")))
    skip = F.when(F.col("__first"), 0).otherwise(F.least(F.lit(overlap), n))
    c = c.withColumn("__m", tail).withColumn("__skip", skip)
    body = F.slice(data, F.col("__skip") + 1, F.greatest(n - F.col("__m") - F.col("__skip"), F.lit(0)))
    return c.select(key, (F.col(start) + F.col("__skip")).alias(start), F.concat(body, F.when(F.col("__m") > 0, mixed).otherwise(F.slice(data, 1, 0))).alias(data))


#: Milliseconds of a burst, of silence after it, of the stretch before it, of a frame, and of quiet needed.
BURST_MS, AFTER_MS, LEAD_MS, FRAME_MS, QUIET_MS = 65, 10, 120, 5, 25
#: Fixed values, as shares of the peak: what is quiet, a burst's energy and its peak; and the rise from one to the other.
QUIET_SHARE, BURST_SHARE, BURST_PEAK, RISE = 0.06, 0.045, 0.07, 2.0


def _energies(x: np.ndarray, n: int) -> np.ndarray:
    """Root mean squares of frames of n samples, the last one shorter."""
    at = np.arange(0, len(x), n)
    return np.sqrt(np.add.reduceat(x * x, at) / np.diff(np.append(at, len(x)))) if len(x) else np.zeros(0)


def burst_start(x: np.ndarray, rate: int) -> int | None:
    """Where a short burst at a clip's end begins that stands alone after quiet; null where there is none."""
    most, after, lead, frame, quiet = (int(rate * ms / 1000) for ms in (BURST_MS, AFTER_MS, LEAD_MS, FRAME_MS, QUIET_MS))
    top = np.abs(x).max() if len(x) else 0.0
    if min(most, lead, frame) <= 0 or len(x) <= most + quiet or top <= 0:
        return None
    base = len(x) - most
    loud = _energies(x[base:], frame) >= BURST_SHARE * top
    if not loud.any():
        return None
    last = int(np.flatnonzero(loud)[-1])
    silent = np.flatnonzero(~loud[: last + 1])
    begin, end = base + (int(silent[-1]) + 1 if len(silent) else 0) * frame, min(len(x), base + (last + 1) * frame)
    burst, before = x[begin:end], x[max(0, begin - lead) : begin]
    energy = np.sqrt(np.mean(burst * burst))
    if len(x) - end > after or energy < BURST_SHARE * top or np.abs(burst).max() < BURST_PEAK * top or len(before) < max(quiet, 1):
        return None
    levels = _energies(before, frame)
    still = levels <= QUIET_SHARE * top
    run = len(still) if still.all() else int(np.argmin(still[::-1]))
    if run < max(1, -(-quiet // frame)) or energy < RISE * max(float(np.median(levels[-run:])), 1e-5 * top):
        return None
    return begin


def without_burst(data: Column, rate: int) -> Column:
    """Clips without a short burst at their end that stands alone after quiet, as models of tokens make them."""

    @F.pandas_udf(T.IntegerType())
    def begin(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else burst_start(np.asarray(x, np.float64), rate) for x in s], dtype="Int32")

    return F.slice(data, F.lit(1), F.coalesce(begin(data), F.size(data)))


def saved_take(data: Column, lead: Column, tail: Column, rate: int, headroom_db: float = 3.0) -> Column:
    """struct<data, removed, reason>: what is kept of a generated clip, as one expression.

    reason: why it is discarded, else null; its silent ends go (``lead`` seconds, and from ``tail`` on) and its peak is
    brought to the headroom; removed: the seconds that went.
    """
    part = trimmed(data, lead, tail, rate)
    return F.struct(peak_normalise(part, headroom_db).alias("data"), ((F.size(data) - F.size(part)) / rate).alias("removed"), discarded(data).alias("reason"))


def frames(clips: DataFrame, key: str, data: str, length: int, hop: int) -> DataFrame:
    """(key, frame, rms) of centred frames: the clip has half a frame of zeros around it."""
    half = length // 2
    zeros = F.array_repeat(F.lit(0.0), half)
    padded = F.concat(zeros, F.transform(data, lambda x: x.cast("double")), zeros)
    levels = let(padded, lambda d: F.transform(F.sequence(F.lit(0), F.floor((F.size(d) - length) / hop).cast("int")), lambda i: rms(F.slice(d, i * hop + 1, F.lit(length)))))
    return clips.where(F.size(data) > 0).select(key, F.posexplode(levels).alias("frame", "rms"))  # numbers, never the clip once a frame


def silent_intervals(frame_rows: DataFrame, clips: DataFrame, key: str, hop: int, rate: int, duration: str, db: float = -42.0, least: int = 10) -> DataFrame:
    """(key, start, end) of runs of quiet frames in seconds, ended by the clip; a clip of silence is one."""
    top = frame_rows.groupBy(key).agg(F.max("rms").alias("__top"))
    w = Window.partitionBy(key).orderBy("frame")
    f = frame_rows.join(top, key).where((F.col("rms") < F.col("__top") * 10 ** (db / 20)) | (F.col("__top") == 0))
    f = f.withColumn("__run", F.col("frame") - F.row_number().over(w))
    runs = f.groupBy(key, "__run").agg(F.min("frame").alias("a"), (F.max("frame") + 1).alias("b"), F.count("*").alias("n"), F.max("__top").alias("__top")).where((F.col("n") >= least) | (F.col("__top") == 0))
    out = runs.join(clips.select(key, duration), key)
    whole = F.col("__top") == 0
    out = out.select(key, F.when(whole, 0.0).otherwise(F.col("a") * hop / rate).alias("start"), F.when(whole, F.col(duration)).otherwise(F.least(F.col("b") * hop / rate, F.col(duration))).alias("end"))
    return out.where("start < end")


def capped_gaps(intervals: DataFrame, clips: DataFrame, key: str, duration: str, most: float) -> DataFrame:
    """(key, start, end) of the parts of a clip that stay: all that sounds, and of each silence the middle ``most`` seconds."""
    w = Window.partitionBy(key).orderBy("start")
    s = intervals.withColumn("__last", F.coalesce(F.lag("end").over(w), F.lit(0.0)))
    mid = (F.col("start") + F.col("end")) / 2
    long = F.col("end") - F.col("start") > most
    kept = F.struct(F.when(long, mid - most / 2).otherwise(F.col("start")).alias("a"), F.when(long, mid + most / 2).otherwise(F.col("end")).alias("b"))
    parts = s.select(key, F.explode(F.array(F.struct(F.col("__last").alias("a"), F.col("start").alias("b")), kept)).alias("p"))
    tails = clips.select(key, duration).join(intervals.groupBy(key).agg(F.max("end").alias("__e")), key, "left").select(key, F.struct(F.coalesce("__e", F.lit(0.0)).alias("a"), F.col(duration).alias("b")).alias("p"))
    return parts.unionByName(tails).select(key, F.col("p.a").alias("start"), F.col("p.b").alias("end")).where("end > start")


def end_silences(frame_rows: DataFrame, clips: DataFrame, key: str, hop: int, rate: int, duration: str, db: float = -42.0, least: int = 10) -> DataFrame:
    """(key, lead, tail): seconds of silence at the start, and when that at the end begins; null where there is none."""
    s = silent_intervals(frame_rows, clips, key, hop, rate, duration, db, least)
    lead = F.max(F.when(F.col("start") == 0, F.col("end"))).alias("lead")
    tail = F.max(F.when(F.col("end") >= F.col(duration), F.col("start"))).alias("tail")
    return clips.select(key, duration).join(s, key, "left").groupBy(key).agg(lead, tail)


@F.pandas_udf(T.DoubleType())
def quietest_near(data: pd.Series, at: pd.Series, rate: pd.Series) -> pd.Series:
    """The time of least energy (over 20 ms) within 250 ms of a time; the time itself if that is outside of the clip."""

    def one(x, t: float, sr: int) -> float:
        x = np.asarray(x, np.float64)
        lo, hi = max(0, int(t * sr) - int(0.25 * sr)), min(len(x), int(t * sr) + int(0.25 * sr))
        if lo >= hi:
            return t
        n = max(1, int(0.02 * sr)) | 1
        sums = np.concatenate(([0.0], np.cumsum(np.pad(x[lo:hi], n // 2) ** 2)))
        return (lo + int(np.argmin(np.round(sums[n:] - sums[:-n], 12)))) / sr

    return pd.Series([one(x, t, r) for x, t, r in zip(data, at, rate, strict=True)])


def high_shelf(data: Column, rate: int, strength: float, start_hz: float, q: float) -> Column:
    """Frequencies above a start lifted by a smooth step in the spectrum; the peak stays within full scale."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def lift(s: pd.Series) -> pd.Series:
        def one(x):
            x = np.asarray(x, np.float64)
            f = np.fft.rfftfreq(len(x), 1 / rate)
            begin = min(max(20.0, start_hz), max(25.0, rate / 2 * 0.98))
            width = max(1.0, (rate / 2 - begin) / max(0.1, q))
            t = np.clip((f - begin) / width, 0, 1)
            y = np.fft.irfft(np.fft.rfft(x) * (1 + strength * t * t * (3 - 2 * t)), len(x))
            return y / max(1.0, np.abs(y).max())

        return s.map(lambda x: x if x is None or not len(x) or strength <= 0 else one(x))

    return lift(data)


def integrated_loudness(data: Column, rate: int) -> Column:
    """Gated loudness (BS.1770: two filters, blocks of 0.4 s with 75 % overlap, an absolute and a relative gate); null below 0.4 s."""

    def biquad(gain: float, q: float, fc: float, high_pass: bool) -> tuple[np.ndarray, np.ndarray]:
        w = 2 * np.pi * fc / rate
        alpha, c, a = np.sin(w) / (2 * q), np.cos(w), 10 ** (gain / 40)
        if high_pass:
            return np.array([(1 + c) / 2, -(1 + c), (1 + c) / 2]) / (1 + alpha), np.array([1 + alpha, -2 * c, 1 - alpha]) / (1 + alpha)
        r = 2 * np.sqrt(a) * alpha
        b = a * np.array([(a + 1) + (a - 1) * c + r, -2 * ((a - 1) + (a + 1) * c), (a + 1) + (a - 1) * c - r])
        d = np.array([(a + 1) - (a - 1) * c + r, 2 * ((a - 1) - (a + 1) * c), (a + 1) - (a - 1) * c - r])
        return b / d[0], d / d[0]

    def filtered(x: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
        f = np.fft.rfft(x, 2 * len(x))
        z = np.exp(-2j * np.pi * np.fft.rfftfreq(2 * len(x)))
        return np.fft.irfft(f * (b[0] + b[1] * z + b[2] * z * z) / (d[0] + d[1] * z + d[2] * z * z), 2 * len(x))[: len(x)]

    def one(x) -> float | None:
        if x is None or len(x) < 0.4 * rate:
            return None
        y = filtered(filtered(np.asarray(x, np.float64), *biquad(4.0, 1 / np.sqrt(2), 1500.0, False)), *biquad(0.0, 0.5, 38.0, True))
        block, step = int(0.4 * rate), int(0.1 * rate)
        power = np.array([np.mean(y[i : i + block] ** 2) for i in range(0, len(y) - block + 1, step)])
        level = -0.691 + 10 * np.log10(np.maximum(power, 1e-20))
        loud = power[level >= -70]
        if not len(loud):
            return float("-inf")
        relative = -0.691 + 10 * np.log10(loud.mean()) - 10
        both = power[(level >= -70) & (level > relative)]
        return float(-0.691 + 10 * np.log10(both.mean())) if len(both) else float("-inf")

    @F.pandas_udf(T.DoubleType())
    def loudness(s: pd.Series) -> pd.Series:
        return pd.Series([one(x) for x in s], dtype="float64").where(lambda v: v.notna(), None)

    return loudness(data)


def loudness_report(log: Column) -> Column:
    """map<string, string> of the last JSON object in an encoder's log; null without one."""
    last = F.element_at(F.regexp_extract_all(log, F.lit(r"(?s)(\{[^{}]*\})"), F.lit(1)), -1)
    return F.when(F.rlike(log, F.lit(r"(?s)\{[^{}]*\}")), F.from_json(last, "map<string,string>"))


def pcm_samples(chunks: DataFrame, key: str, order: str, data: str) -> DataFrame:
    """(key, n_samples, checksum) of 16-bit streams in chunks: an odd byte goes to the next chunk, a last one is dropped.

    Each chunk begins with the byte left over if an odd number of bytes came before, by a running sum.
    """
    w = Window.partitionBy(key).orderBy(order)
    n = F.octet_length(data)
    c = chunks.withColumn("__before", F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    c = c.withColumn("__carry", F.when(F.col("__before") % 2 == 1, F.last(F.when(n > 0, F.substring(data, -1, 1)), True).over(w.rowsBetween(Window.unboundedPreceding, -1))))
    whole = F.concat(F.coalesce("__carry", F.lit(b"")), F.col(data))
    even = F.floor(F.octet_length(whole) / 2).cast("int")
    return c.select(key, order, F.substring(whole, F.lit(1), even * 2).alias(data), even.alias("n_samples"))


def top_classes(scores: DataFrame, key: str, data: str, most: int, least: float) -> DataFrame:
    """(key, class, score) of each frame's best classes, ``most`` at most and from a least score on."""
    s = scores.select(key, F.slice(F.array_sort(F.transform(data, lambda x, i: F.struct((-x).alias("s"), i.alias("c")))), 1, most).alias("t"))
    return s.select(key, F.explode("t").alias("t")).select(key, F.col("t.c").alias("class"), (-F.col("t.s")).alias("score")).where(F.col("score") >= least)


def has_class(top: DataFrame, clip: str, wanted: int) -> DataFrame:
    """(clip, found): whether a clip's frames show a class among their best."""
    return top.groupBy(clip).agg(F.max((F.col("class") == wanted).cast("int")).alias("__f")).select(clip, (F.col("__f") == 1).alias("found"))
