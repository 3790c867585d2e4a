"""Operators that SQL cannot express against plain loops: Spanish numbers, loudness, equaliser, quietest places, transcripts, utterances."""

import math
import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge import queries
from folioforge.functions import numbers
from folioforge.operators import alignment, signal
from folioforge.streaming import utterances

SF = "/root/testdata/sf0.001"
ONES = "cero uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciséis diecisiete dieciocho diecinueve veinte veintiuno veintidós veintitrés veinticuatro veinticinco veintiséis veintisiete veintiocho veintinueve".split()
TENS = "treinta cuarenta cincuenta sesenta setenta ochenta noventa".split()
HUNDREDS = "ciento doscientos trescientos cuatrocientos quinientos seiscientos setecientos ochocientos novecientos".split()


def spanish(n):
    if n < 30:
        return ONES[n]
    if n < 100:
        return TENS[n // 10 - 3] + (f" y {ONES[n % 10]}" if n % 10 else "")
    if n == 100:
        return "cien"
    if n < 1000:
        return HUNDREDS[n // 100 - 1] + (f" {spanish(n % 100)}" if n % 100 else "")
    return ("mil" if n < 2000 else f"{spanish(n // 1000)} mil") + (f" {spanish(n % 1000)}" if n % 1000 else "")


def test_spanish_numbers_up_to_ten_thousand():
    assert all(numbers.spanish_value(spanish(n).split()) == n for n in range(1, 10_000)) and numbers.spanish_value(["cero"]) is None


def test_spanish_numbers_of_the_query(spark):
    rows = queries.queries()["spanish_numbers"](spark, SF).collect()
    said = {"dos": "2", "treinta y uno": "31", "cien": "100", "mil quinientos": "1500", "veintidós": "22"}
    checked = 0
    for r in rows:
        first, rest = r.t.removeprefix("hay ").rstrip(".").split(" de ellos, número ")
        if first in said and rest in said:
            assert r.digits == f"hay {said[first]} de ellos, número {said[rest]}." and r.n_runs == 2
            checked += 1
    assert checked > 10


def loudness_by_hand(x, rate=48000):
    """The standard's coefficients at 48 kHz, sample by sample, and its gates."""
    for b, a in (((1.53512485958697, -2.69169618940638, 1.19839281085285), (-1.69065929318241, 0.73248077421585)), ((1.0, -2.0, 1.0), (-1.99004745483398, 0.99007225036621))):
        x1 = x2 = y1 = y2 = 0.0
        out = []
        for v in x:
            y = b[0] * v + b[1] * x1 + b[2] * x2 - a[0] * y1 - a[1] * y2
            x1, x2, y1, y2 = v, x1, y, y1
            out.append(y)
        x = out
    block, step = int(0.4 * rate), int(0.1 * rate)
    power = [sum(v * v for v in x[i : i + block]) / block for i in range(0, len(x) - block + 1, step)]
    level = lambda p: -0.691 + 10 * math.log10(max(p, 1e-20))
    loud = [p for p in power if level(p) >= -70]
    gate = level(sum(loud) / len(loud)) - 10
    loud = [p for p in loud if level(p) > gate]
    return level(sum(loud) / len(loud))


def test_loudness(spark):
    rng = np.random.default_rng(1)
    t = np.arange(48000) / 48000
    clips = [0.3 * np.sin(2 * np.pi * 1000 * t), rng.normal(0, 0.1, 48000), np.concatenate([rng.normal(0, 0.2, 24000), rng.normal(0, 0.001, 24000)]), 0.5 * np.sin(2 * np.pi * 100 * t) + 0.1 * np.sin(2 * np.pi * 6000 * t)]
    df = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(clips)], "k int, x array<double>")
    got = {r.k: r.l for r in df.select("k", signal.integrated_loudness(F.col("x"), 48000).alias("l")).collect()}
    for k, c in enumerate(clips):
        assert abs(got[k] - loudness_by_hand(c.tolist())) < 0.15, k


def test_equaliser_and_quiet_places(spark):
    rng = np.random.default_rng(3)
    x, rate = rng.normal(0, 0.05, 64), 16000
    n = len(x)
    spectrum = [sum(x[i] * np.exp(-2j * np.pi * k * i / n) for i in range(n)) for k in range(n)]
    for k in range(n):
        f = min(k, n - k) * rate / n
        s = min(max((f - 2000.0) / ((rate / 2 - 2000.0) / 1.5), 0), 1)
        spectrum[k] *= 1 + 0.7 * s * s * (3 - 2 * s)
    want = np.array([sum(spectrum[k] * np.exp(2j * np.pi * k * i / n) for k in range(n)).real / n for i in range(n)])
    got = spark.createDataFrame([(x.tolist(),)], "x array<double>").select(signal.high_shelf(F.col("x"), rate, 0.7, 2000.0, 1.5).alias("y")).first().y
    assert np.allclose(got, want / max(1.0, np.abs(want).max()), atol=1e-9)
    rows, sr = [], 200
    for _ in range(20):
        y = np.round(rng.normal(0, 0.2, 300), 3)
        rows.append((y.tolist(), float(rng.uniform(0, 1.4))))
    df = spark.createDataFrame(rows, "x array<double>, t double")
    for r in df.select("x", "t", signal.quietest_near(F.col("x"), F.col("t"), F.lit(sr)).alias("q")).collect():
        lo, hi, m = max(0, int(r.t * sr) - 50), min(len(r.x), int(r.t * sr) + 50), 5
        part = [0.0] * (m // 2) + list(r.x[lo:hi]) + [0.0] * (m // 2)
        energy = [round(sum(v * v for v in part[i : i + m]), 12) for i in range(hi - lo)]
        assert abs(r.q - (lo + energy.index(min(energy))) / sr) < 1e-9


def follow_by_hand(phrases, words, cursor=0, skip=45):
    out = []
    for k, phrase in enumerate(phrases):
        n = len(phrase.split())
        if not n or (k and cursor >= len(words) - 1):
            out.append((0.0, 0.0))
            continue
        best, where = -1.0, None
        lead = phrases[k - 1].split()[-1] if k and cursor and phrases[k - 1].split() and words[cursor - 1][0] else None
        for i in range(cursor, min(cursor + skip, len(words))):
            for j in range(i + max(1, int(n * 0.75)), min(i + n + max(int(n * 0.25), 2), len(words)) + 1):
                a, b = phrase, " ".join(w for w, _, _ in words[i:j])
                if lead:
                    a, b = f"{lead} {a}", f"{words[cursor - 1][0]} {b}"
                ratio = SequenceMatcher(None, a, b).ratio()
                if ratio > best:
                    best, where = ratio, (i, j)
        if best >= 0.7:
            i, j = where
            out.append((words[i][1], words[j][1] if j < len(words) else words[j - 1][2]))
            cursor, skip = j, 45
        else:
            out.append((0.0, 0.0))
            skip = min(skip + 2 * n, 250)
    return out, cursor, skip


def test_transcripts_are_followed():
    rng = random.Random(6)
    lexicon = ["".join(rng.choices("abcdefg", k=rng.randint(2, 6))) for _ in range(60)]
    for _ in range(6):
        phrases = [" ".join(rng.choices(lexicon, k=rng.randint(1, 7))) for _ in range(12)]
        heard = [w for p in phrases if rng.random() < 0.85 for w in p.split() if rng.random() < 0.93]
        words = [(w, k * 1.0, k + 0.5) for k, w in enumerate(heard)]
        assert alignment.follow(phrases, words) == follow_by_hand(phrases, words)


def utterances_by_hand(levels, rate, block):
    """Whole lists, cut at each block: (first, last, samples, flushed)."""
    out, buffer, history, silence, speech, peak = [], [], [], 0, False, 0.0
    keep, need = max(1, int(6.0 * rate / block)), max(3, int(0.3 * rate / block))
    last = lambda b: b[-5:]  # noqa: E731  half a second of blocks of a tenth

    for k, v in enumerate(levels):
        floor = max(1e-6, float(np.percentile(history, 20)) if history else 0.01 / 1.25)
        start = max(0.01 if len(history) >= need else 0.0125, floor * 1.25)
        buffer.append(k)
        if not speech and v >= start:
            speech, peak, buffer = True, v, last(buffer)
        elif speech:
            peak = max(peak, v)
        if speech:
            silence = silence + block if v <= max(0.01, min(floor * 1.4, peak * 0.6)) else 0
        size = len(buffer) * block
        if speech and ((silence >= 0.5 * rate and size >= 1.5 * rate) or size >= 8 * rate):
            out.append((buffer[0], buffer[-1], size, False))
            buffer, silence, speech, peak = [], 0, False, 0.0
        elif not speech and size >= 8 * rate:
            buffer = last(buffer)
        history = [*history, v][-keep:]
    if speech and buffer:
        out.append((buffer[0], buffer[-1], len(buffer) * block, True))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_utterances(spark, seed):
    rng, rate, block = random.Random(seed), 1000, 100
    levels = [v for _ in range(25) for v in [rng.choice([0.001, 0.004, 0.02, 0.2, 0.5])] * rng.randint(1, 30)]
    rows = [("s", k, [v] * block, None) for k, v in enumerate(levels)]
    got = utterances.utterances(spark.createDataFrame(rows, "stream string, number long, samples array<double>, control string"), rate, block).collect()
    assert [(r.first_block, r.last_block, r.n_samples, r.flushed) for r in got] == utterances_by_hand([float(np.sqrt(np.mean(np.square([v] * block)))) for v in levels], rate, block)
