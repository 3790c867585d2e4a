"""Column functions on text: words, line breaks, normalisers, predicates."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from folioforge.functions import numbers

#: ASCII punctuation and the signs that count with it.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~…–—“”‘’"


#: White space of all scripts, as the inside of a character class.
SPACE = r"\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Words of punctuation that stay in a prompt, and the largest number that is spelled out there.
PROMPT_SIGNS, MOST_SPELLED = ("...", "…", "—", "–", "-"), 999


def regex_class(chars: str) -> str:
    """The inside of a character class that holds these characters."""
    return "".join("\\" + c if c in "\\]^-[&~" else c for c in chars)


def quick(inside: str, never: str = "a-z", negated: bool = False) -> str:
    """A character class (or its complement) that tells the frequent signs ``never``, which it does not hold, at once.

    A class of many ranges is else tried range by range for each sign of a text.
    """
    return f"[{never}[^{inside}]]" if negated else f"[[^{never}]&&[{inside}]]"


#: White space, and what is none.
BLANK, NO_BLANK = quick(SPACE, "!-~"), quick(SPACE, "!-~", True)
#: What is neither a word's sign nor white space.
NO_WORD = rf"[[^a-z ]&&[^\p{{L}}\p{{N}}_{SPACE}]]"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def settled(value: Column) -> Column:
    """A value that the optimizer does not copy into the expressions that name it: one exploded element (one a select)."""
    return F.explode(F.array(value))


def clean_line_ends(c: Column) -> Column:
    """CRLF and CR to LF, no blanks before LF."""
    lines = F.split(F.regexp_replace(c, r"\r\n?", "\n"), "\n")
    return F.array_join(let(lines, lambda v: F.transform(v, lambda x, i: F.when(i < F.size(v) - 1, F.rtrim(x, F.lit(" \t"))).otherwise(x))), "\n")


def collapse_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"{BLANK}+", " "))


def words_with_space(c: Column) -> Column:
    """Words with the white space that follows each; leading white space is dropped."""
    return F.regexp_extract_all(F.ltrim(c, F.lit(_BLANKS)), F.lit(f"{NO_BLANK}+{BLANK}*"), F.lit(0))


def bare_words(c: Column) -> Column:
    """Words without white space."""
    return F.regexp_extract_all(c, F.lit(f"{NO_BLANK}+"), F.lit(0))


def spoken_words(c: Column) -> Column:
    """Words that are more than punctuation."""
    return F.filter(words_with_space(c), lambda x: ~blank_or_punctuation(x))


def word_parts(word: Column) -> Column:
    """struct<before, core, after>: punctuation and white space around a word, and what is between."""
    sign = quick(SPACE + regex_class(PUNCTUATION), negated=True)
    core = F.regexp_extract(word, f"{sign}(?s:.*{sign})?", 0)
    at = F.instr(word, core)  # no earlier place: the core begins with the first such sign
    before = F.when(core == "", word).otherwise(F.substring(word, F.lit(1), at - 1))
    after = F.when(core == "", "").otherwise(F.substring(word, at + F.length(core), F.length(word)))
    return F.struct(before.alias("before"), core.alias("core"), after.alias("after"))


def vocalizable(c: Column) -> Column:
    """Has a letter or a digit of any script."""
    return F.rlike(c, F.lit(r"[a-z[\p{L}\p{N}]]"))


def blank_or_punctuation(c: Column) -> Column:
    """Only white space and punctuation; the empty string, too."""
    return ~F.rlike(c, F.lit(quick(SPACE + regex_class(PUNCTUATION), negated=True)))


#: The signs of SPACE.
_BLANKS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def trailing_line_breaks(c: Column) -> Column:
    """Line feeds in the white space at the end."""
    return F.length(F.regexp_replace(F.substring(c, F.length(F.rtrim(c, F.lit(_BLANKS))) + 1, F.length(c)), r"[^\n]", ""))


class _Signs(dict):
    """A table for str.translate that a rule fills, each sign once it is met; None drops a sign."""

    def __init__(self, rule):
        self.rule = rule

    def __missing__(self, sign: int):
        self[sign] = found = self.rule(chr(sign))
        return found


_QUOTES = dict(zip("’“”", "'\"\"", strict=True))
_EDGES = frozenset(PUNCTUATION) - frozenset("“”‘’")
#: Plain quotes, without symbols and signs without a look of their own; and word signs and white space, with punctuation as blanks.
_PLAIN = _Signs(lambda x: _QUOTES.get(x) or (None if unicodedata.category(x) in ("So", "Sk", "Cf", "Cs", "Co", "Cn") else x))
_WORD_SIGNS = _Signs(lambda x: " " if x in _EDGES else x if x.isspace() or unicodedata.category(x)[0] in "LN" else None)
#: The apostrophe comes first, so that only it is searched for.
_APOSTROPHE = re.compile(r"'(?:(?<=\w')|(?=\w))")


def _folded(t: str) -> str:
    return t.lower() if t.isascii() else unicodedata.normalize("NFKC", t).casefold()


def _unquoted(t: str) -> str:
    return _APOSTROPHE.sub("", t) if "'" in t else t


@F.pandas_udf(StringType())
def _general(c: pd.Series) -> pd.Series:
    return c.map(lambda t: t if t is None else " ".join((t if t.isascii() else unicodedata.normalize("NFKC", t)).translate(_PLAIN).split()))


@F.pandas_udf(StringType())
def _general_folded(c: pd.Series) -> pd.Series:
    return c.map(lambda t: t if t is None else _unquoted(" ".join(_folded(t).translate(_PLAIN).split())))


@F.pandas_udf(StringType())
def _word_signs(c: pd.Series) -> pd.Series:
    return c.map(lambda t: t if t is None else " ".join(t.translate(_WORD_SIGNS).split()))


@F.pandas_udf(StringType())
def _compared(c: pd.Series) -> pd.Series:
    return c.map(lambda t: t if t is None else " ".join(_unquoted(_folded(t).translate(_PLAIN)).translate(_WORD_SIGNS).split()))


@F.pandas_udf(StringType())
def _without_marks(c: pd.Series) -> pd.Series:
    def bare(t: str) -> str:
        kept = (x if x in "ñÑ" else unicodedata.normalize("NFC", "".join(y for y in unicodedata.normalize("NFD", x) if unicodedata.category(y) != "Mn")) for x in unicodedata.normalize("NFC", t))
        return "".join(kept)

    return c.map(lambda t: t if t is None or t.isascii() else bare(t))


def general_form(c: Column) -> Column:
    """Compatibility forms, plain quotes, no symbols or signs without a look of their own, one blank at a time."""
    return _general(c)


def without_marks(c: Column) -> Column:
    """Letters without their diacritics, but for ñ."""
    return _without_marks(c)


def compare_form(c: Column, language: str = "") -> Column:
    """For comparison: general form, case folded, no apostrophes beside word signs, the language's step, punctuation to blanks.

    English: hyphens to blanks and number words to digits; Spanish: cardinals to digits and no diacritics.
    """
    if language == "en":
        return _word_signs(numbers.english_digits(collapse_space(F.replace(_general_folded(c), F.lit("-"), F.lit(" ")))))
    if language == "es":
        return _word_signs(without_marks(numbers.spanish_digits(_general_folded(c))))
    return _compared(c)


def light_form(c: Column) -> Column:
    """For alignment: lower case, without all but word signs and white space."""
    return F.regexp_replace(F.lower(c), NO_WORD, "")


def file_name_form(c: Column, max_length: int = 50) -> Column:
    """The first ``max_length`` signs with ``_`` for all but letters and digits, once and not at the ends."""
    return F.trim(F.regexp_replace(F.substring(c, 1, max_length), r"[^A-Za-z0-9]+", "_"), F.lit("_"))


def prompt_form(c: Column, spell: bool = True, un_caps: bool = False) -> Column:
    """A prompt: general form, runs of dots shortened, loose punctuation dropped but for ellipses and dashes, small numbers spelled (English)."""
    c = F.replace(F.regexp_replace(F.regexp_replace(general_form(c), r"\.{3,}", "..."), "…+", "…"), F.lit(" . . . "), F.lit(" ... "))
    c = F.array_join(F.filter(F.split(c, " "), lambda x: ~blank_or_punctuation(x) | x.isin(*PROMPT_SIGNS)), " ")
    if un_caps:
        c = lower_opening(c)
    return collapse_space(numbers.spelled(c, MOST_SPELLED) if spell else c)


def lower_opening(c: Column, least: int = 3) -> Column:
    """If the first ``least`` words with letters are in capitals, all words before one with a small letter become small."""
    small = lambda x: F.rlike(x, F.lit(r"\p{Ll}"))

    def lowered(words: Column, first: Column) -> Column:
        opening = F.slice(words, F.lit(1), first)
        capitals = F.size(F.filter(opening, lambda x: F.rlike(x, F.lit(r"\p{L}"))))
        rest = F.array_join(F.slice(words, first + 1, F.size(words)), "")
        return F.when((capitals < least) | (F.size(words) == 0), c).otherwise(F.concat(F.lower(F.array_join(opening, "")), rest))

    first = lambda words: F.coalesce(F.nullif(F.array_position(F.transform(words, small), True), F.lit(0)) - 1, F.size(words).cast("long")).cast("int")
    return let(words_with_space(c), lambda w: let(first(w), lambda k: lowered(w, k)))


def replaced_in_order(c: Column, pairs: list[tuple[str, str]]) -> Column:
    """Literal replacements, one after the other."""
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def ellipsize(c: Column, length: int) -> Column:
    return F.when(F.length(c) > length, F.concat(F.rtrim(F.substring(c, 1, length - 3)), F.lit("..."))).otherwise(c)


def ellipsize_middle(c: Column, length: int, mark: str = "…") -> Column:
    """A text that is too long loses its middle."""
    head = (length - len(mark) + 1) // 2
    tail = length - len(mark) - head
    return F.when(F.length(c) > length, F.concat(F.substring(c, 1, head), F.lit(mark), F.substring(c, -tail, tail) if tail else F.lit(""))).otherwise(c)


def stamp(seconds: Column) -> Column:
    """hh:mm:ss.mmm of seconds, tenths of milliseconds cut."""
    ms = F.floor(seconds * 1000 + 1e-6).cast("long")
    return F.when(ms.isNotNull(), F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3600000), F.floor(ms % 3600000 / 60000), F.floor(ms % 60000 / 1000), ms % 1000))


def clock(seconds: Column) -> Column:
    """h:mm:ss, or m:ss below an hour; null for null."""
    s = F.floor(seconds).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).when(s.isNotNull(), F.format_string("%d:%02d", m, r))


def language(c: Column) -> Column:
    """``en-US`` to ``en``."""
    return F.substring_index(F.lower(F.trim(c)), "-", 1)


def natural_key(name: Column) -> Column:
    """A sort key in which runs of digits compare as numbers, case aside."""
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), F.lit(1)), lambda x: F.when(F.rlike(x, F.lit(r"^\d")), F.lpad(x, 18, "0")).otherwise(x)), "")


def without_ansi(c: Column) -> Column:
    return F.regexp_replace(c, "\u001b\\[[0-9;]*[A-Za-z]", "")


def out_of_memory(message: Column) -> Column:
    """Whether an error's message speaks of memory."""
    return F.rlike(F.lower(message), F.lit("out of memory|outofmemory|cannot allocate|mps backend"))


def transcript(words: Column, least: float = 0.0) -> Column:
    """The words of array<struct<word, probability, ...>> that are probable enough, one blank between."""
    return F.array_join(F.transform(F.filter(words, lambda w: w["probability"] >= least), lambda w: F.trim(w["word"])), " ")
