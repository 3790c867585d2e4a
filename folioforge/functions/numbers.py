"""Number words and digits: English and Spanish cardinals to digits, small numbers to English words.

The parsers are small helpers that work on the words of one run; Spark deals the rows, and only rows that hold a number
word reach them.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: English number words.
EN_SMALL = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen"
).split()
EN_TENS = {"twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90}
EN_SCALES = {"thousand": 1000, "million": 10**6, "billion": 10**9}
#: Spanish number words, with and without accents.
ES_SMALL = {
    "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9, "diez": 10, "once": 11, "doce": 12, "trece": 13, "catorce": 14, "quince": 15,
    "dieciséis": 16, "dieciseis": 16, "diecisiete": 17, "dieciocho": 18, "diecinueve": 19, "veinte": 20, "veintiuno": 21, "veintiuna": 21, "veintidós": 22, "veintidos": 22, "veintitrés": 23,
    "veintitres": 23, "veinticuatro": 24, "veinticinco": 25, "veintiséis": 26, "veintiseis": 26, "veintisiete": 27, "veintiocho": 28, "veintinueve": 29,
}
ES_TENS = {"treinta": 30, "cuarenta": 40, "cincuenta": 50, "sesenta": 60, "setenta": 70, "ochenta": 80, "noventa": 90}
ES_HUNDREDS = {"cien": 100, "ciento": 100, "doscientos": 200, "trescientos": 300, "cuatrocientos": 400, "quinientos": 500, "seiscientos": 600, "setecientos": 700, "ochocientos": 800, "novecientos": 900}
ES_HUNDREDS |= {k[:-2] + "as": v for k, v in ES_HUNDREDS.items() if v > 100}
#: Words that make a run of number words something else than a cardinal.
ES_ORDINALS = set("primero primera segundo segunda tercero tercera tercer cuarto cuarta quinto quinta sexto séptima séptimo octavo octava noveno novena décimo décima último última".split())
ES_OTHER = set("coma punto con medio media cuarto tercio menos negativo positivo".split())
ES_LARGE = set("miles millón millones billón billones trillón trillones".split())
_EDGE = ".,;:!?\"'()[]{}—–-…"


def english_value(words: list[str]) -> int | None:
    """The value of a run of number words (``and`` allowed inside), or None if it is not one cardinal."""
    total = part = 0
    last = None  # the size of the last word: what follows must be smaller
    for w in words:
        if w == "and":
            if last is None or last < 100:
                return None
        elif w in EN_SMALL:
            n = EN_SMALL.index(w)
            if last is not None and (last < 20 or (last < 100 and not 0 < n < 10)):
                return None
            part, last = part + n, 1 if n else 0
        elif w in EN_TENS:
            if last is not None and last < 100:
                return None
            part, last = part + EN_TENS[w], 20
        elif w == "hundred":
            if not 0 < part < 100:
                return None
            part, last = part * 100, 100
        else:
            if not part or (total and total % (EN_SCALES[w] * 1000)):
                return None
            total, part, last = total + part * EN_SCALES[w], 0, 1000
    return None if words[-1] == "and" else total + part


def english_text(text: str) -> str:
    """Each longest run of number words that is one cardinal becomes its digits."""
    known = {*EN_SMALL, *EN_TENS, *EN_SCALES, "hundred"}
    words, out, i = text.split(" "), [], 0
    while i < len(words):
        if words[i] not in known:
            out.append(words[i])
            i += 1
            continue
        j = i
        while j < len(words) and (words[j] in known or words[j] == "and"):
            j += 1
        value = None
        while j > i and value is None:
            value = english_value(words[i:j])
            j -= value is None
        out.append(str(value) if value is not None else words[i])
        i = j if value is not None else i + 1
    return " ".join(out)


def spanish_value(words: list[str]) -> int | None:
    """The value of a run of Spanish number words up to 9999, or None if it is not one cardinal."""

    def below_thousand(run: list[str]) -> int | None:
        value, at = 0, 0
        if at < len(run) and run[at] in ES_HUNDREDS:
            value += ES_HUNDREDS[run[at]]
            at += 1
        if at < len(run) and run[at] in ES_TENS:
            value += ES_TENS[run[at]]
            at += 1
            if at < len(run):
                if run[at] != "y" or at + 1 >= len(run) or not 0 < ES_SMALL.get(run[at + 1], 99) < 10:
                    return None
                value += ES_SMALL[run[at + 1]]
                at += 2
        elif at < len(run) and run[at] in ES_SMALL:
            value += ES_SMALL[run[at]]
            at += 1
        return value if at == len(run) and run else None

    if "mil" in words:
        k = words.index("mil")
        head = below_thousand(words[:k]) if k else 1
        tail = below_thousand(words[k + 1 :]) if k + 1 < len(words) else 0
        value = None if head is None or tail is None else head * 1000 + tail
    else:
        value = below_thousand(words)
    return value if value is not None and value <= 9999 else None


def spanish_text(text: str) -> str:
    """Runs of number words become digits; articles, ordinals, fractions and signs keep a run as it is."""
    known = {*ES_SMALL, *ES_TENS, *ES_HUNDREDS, "mil", "y", *ES_ORDINALS, *ES_OTHER, *ES_LARGE}
    tokens = text.split()
    bare = [t.strip(_EDGE).lower() for t in tokens]
    out, i, changed = [], 0, False
    while i < len(tokens):
        j = i
        while j < len(tokens) and bare[j] in known:
            j += 1
        run = bare[i:j]
        alone = run == ["uno"] and tokens[i].lower() == "uno" and (i == 0 or bare[i - 1] != "número")
        value = None if not run or alone or any(w in ES_ORDINALS or w in ES_OTHER for w in run) else spanish_value(run)
        if value is None:
            out += tokens[i : max(j, i + 1)]
        else:
            first, last = tokens[i], tokens[j - 1]
            head = first[: len(first) - len(first.lstrip(_EDGE))]
            tail = last[len(last.rstrip(_EDGE)) :]
            out.append(head + str(value) + tail)
            changed = True
        i = max(j, i + 1)
    return " ".join(out) if changed else text


def words_of(n: int) -> str:
    """A number below a thousand in English words."""
    tens = {v: k for k, v in EN_TENS.items()}
    if n < 20:
        return EN_SMALL[n]
    if n < 100:
        return tens[n - n % 10] + ("-" + EN_SMALL[n % 10] if n % 10 else "")
    return EN_SMALL[n // 100] + " hundred" + (" and " + words_of(n % 100) if n % 100 else "")


@F.pandas_udf(StringType())
def _english(c: pd.Series) -> pd.Series:
    return c.map(lambda t: t if t is None else english_text(t))


@F.pandas_udf(StringType())
def _spanish(c: pd.Series) -> pd.Series:
    return c.map(lambda t: t if t is None else spanish_text(t))


def english_digits(c: Column) -> Column:
    """Number words of a lower-case text to digits."""
    return _english(c)


def spanish_digits(c: Column) -> Column:
    """Spanish cardinals from 1 to 9999 to digits; zero stays a word."""
    return _spanish(c)


def spelled(c: Column, most: int) -> Column:
    """Runs of digits up to ``most`` (999 at most) as English words."""

    @F.pandas_udf(StringType())
    def spell(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t if t is None else re.sub(r"\d+", lambda m: words_of(int(m[0])) if int(m[0]) <= most else m[0], t))

    return spell(c)


def number_runs(words: Column) -> Column:
    """array<struct<start, end>> (half-open) of the longest runs of Spanish number words in an array of words."""
    known = F.array(*[F.lit(w) for w in sorted({*ES_SMALL, *ES_TENS, *ES_HUNDREDS, "mil", "y", *ES_ORDINALS, *ES_OTHER, *ES_LARGE})])
    hit = F.transform(words, lambda w: F.array_contains(known, F.lower(F.trim(w, F.lit(_EDGE)))))
    starts = F.filter(F.transform(hit, lambda h, i: F.when(h & ((i == 0) | ~F.coalesce(F.get(hit, i - 1), F.lit(False))), i)), lambda i: i.isNotNull())
    ends = F.filter(F.transform(hit, lambda h, i: F.when(h & ~F.coalesce(F.get(hit, i + 1), F.lit(False)), i + 1)), lambda i: i.isNotNull())
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), b.alias("end")))
