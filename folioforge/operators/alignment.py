"""Word errors between a text and its transcript, verdicts on clips, forced alignment of phrases, stitched transcripts.

The dynamic programs work on the words of one row (a line and its transcript) and are Arrow functions over columns;
everything around them, thresholds, precedence and times, is column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from folioforge.functions.phonetics import primary_code
from folioforge.functions.text import let
from folioforge.operators.catalog import threshold

STEP = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("action", "source", "transcript")]))
#: Likeness that an aligned phrase needs, and words that may be skipped at first and at most.
LEAST_LIKENESS, SKIP, MOST_SKIP = 0.7, 45, 250


def _costs(pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[np.ndarray]:
    """The least costs of all beginnings of pairs (source, heard, free): pair by heard, for one source word more at a time.

    Words are numbers, equal ones match at no cost. A row takes the least of the moves from above, then the moves along it
    as a running minimum. A source word that is ``free`` stands for any one or two words. Shorter pairs are filled up; no
    beginning depends on what follows.
    """
    n, m = max(len(a) for a, _, _ in pairs), max(len(b) for _, b, _ in pairs)
    source, heard, free = np.full((len(pairs), n), -1, np.int64), np.full((len(pairs), m), -2, np.int64), np.zeros((len(pairs), n), bool)
    for k, (a, b, f) in enumerate(pairs):
        source[k, : len(a)], heard[k, : len(b)], free[k, : len(a)] = a, b, f
    along = np.arange(m + 1, dtype=np.int32)
    above = np.tile(along, (len(pairs), 1))
    yield above
    for i in range(n):
        row, any_word = above + 1, free[:, i : i + 1]
        np.minimum(row[:, 1:], above[:, :-1] + ((heard != source[:, i : i + 1]) & ~any_word), out=row[:, 1:])
        if any_word.any():
            np.minimum(row[:, 2:], above[:, :-2] + np.where(any_word, 0, 3).astype(np.int32), out=row[:, 2:])
        above = np.minimum.accumulate(row - along, axis=1) + along
        yield above


#: Cells of costs that are worked on together.
_CELLS = 1 << 20


def align_words(source: list[str], heard: list[str], uncommon: set[str], sound=None) -> list[tuple[str, str, str]]:
    """The cheapest steps from source to heard words; of equal cost the first of: both, one for two, source, heard.

    A source word of ``uncommon`` may stand for any one or two words at no cost. Words of the same ``sound`` match.
    """
    return align_many([(source, heard, uncommon)], sound)[0]


def _numbered(pairs: list[tuple[list[str], list[str], set[str]]], sound) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Pairs as (source, heard, free, length of the longest common end) with numbers for words."""
    numbers: dict[str, int] = {}
    name = sound or (lambda w: w)
    number = lambda words: np.array([numbers.setdefault(name(w), len(numbers)) for w in words], np.int64)
    rows = []
    for source, heard, uncommon in pairs:
        a, b, free = number(source), number(heard), np.array([w in uncommon for w in source], bool)
        most = min(len(a), len(b))
        # from the end on, equal words that are not free can only match
        differ = np.flatnonzero((a[len(a) - most :] != b[len(b) - most :]) | free[len(a) - most :])
        end = most - 1 - int(differ[-1]) if len(differ) else most
        rows.append((a, b, free, end))
    return rows


def _together(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]], size: list[tuple[int, int]]) -> Iterator[tuple[list[int], Iterator[np.ndarray]]]:
    """Pairs of about one size, and their costs without the common end."""
    todo = sorted(range(len(rows)), key=lambda k: size[k])
    while todo:
        chunk, n, m = [], 0, 0
        while todo and (not chunk or (max(n, size[todo[-1]][0]) + 1) * (max(m, size[todo[-1]][1]) + 1) * (len(chunk) + 1) <= _CELLS):
            k = todo.pop()
            n, m = max(n, size[k][0]), max(m, size[k][1])
            chunk.append(k)
        yield chunk, _costs([(a[: len(a) - end], b[: len(b) - end], f[: len(a) - end]) for a, b, f, end in (rows[k] for k in chunk)])


def count_many(pairs: list[tuple[list[str], list[str], set[str]]], sound=None) -> list[int]:
    """The errors of each pair: the cost of its cheapest steps, which are not traced back and of which no table is kept."""
    rows = _numbered(pairs, sound)
    size, out = [(len(a) - end, len(b) - end) for a, b, _, end in rows], [0] * len(rows)
    for chunk, costs in _together(rows, size):
        done: dict[int, list[tuple[int, int]]] = {}
        for at, k in enumerate(chunk):
            done.setdefault(size[k][0], []).append((at, k))
        for i, row in enumerate(costs):
            for at, k in done.get(i, ()):
                out[k] = int(row[at, size[k][1]])
    return out


def align_many(pairs: list[tuple[list[str], list[str], set[str]]], sound=None) -> list[list[tuple[str, str, str]]]:
    """``align_words`` of many pairs, whose costs are computed side by side; the longest common end is no part of them."""
    rows = _numbered(pairs, sound)
    out: list[list[tuple[str, str, str]]] = [[] for _ in pairs]
    size = [(len(a) - end, len(b) - end) for a, b, _, end in rows]
    for chunk, costs in _together(rows, size):
        cost = np.empty((max(size[k][0] for k in chunk) + 1, len(chunk), max(size[k][1] for k in chunk) + 1), np.int32)
        for i, row in enumerate(costs):
            cost[i] = row
        for at, k in enumerate(chunk):
            mine = cost[: size[k][0] + 1, at, : size[k][1] + 1]
            out[k] = _steps(mine.tolist() if mine.size < 1 << 16 else mine, pairs[k][0], pairs[k][1], *rows[k])
    return out


def _steps(cost, source: list[str], heard: list[str], a: np.ndarray, b: np.ndarray, free: np.ndarray, end: int) -> list[tuple[str, str, str]]:
    """The steps, from the end on."""
    a, b, free = a.tolist(), b.tolist(), free.tolist()
    i, j = len(a), len(b)
    steps = [("match" if source[i - 1 - k] == heard[j - 1 - k] else "homophone", source[i - 1 - k], heard[j - 1 - k]) for k in range(end)]
    i, j = i - end, j - end
    while i or j:
        kind = "insert" if not i else "delete"
        if i and j:
            kind = "match" if source[i - 1] == heard[j - 1] else "homophone" if a[i - 1] == b[j - 1] else "uncommon" if free[i - 1] else "substitute"
            best = cost[i - 1][j - 1] + (kind == "substitute")
            if free[i - 1] and j > 1 and cost[i - 1][j - 2] < best:
                best, kind = cost[i - 1][j - 2], "uncommon_two"
            if cost[i - 1][j] + 1 < best:
                best, kind = cost[i - 1][j] + 1, "delete"
            if cost[i][j - 1] + 1 < best:
                kind = "insert"
        di, dj = {"delete": (1, 0), "insert": (0, 1), "uncommon_two": (1, 2)}.get(kind, (1, 1))
        steps.append((kind, " ".join(source[i - di : i]) or "-", " ".join(heard[j - dj : j]) or "-"))
        i, j = i - di, j - dj
    return steps[::-1]


def word_alignment(source: Column, transcript: Column, language: str = "", uncommon: Column | None = None) -> Column:
    """array<struct<action, source, transcript>> of two normalised texts; English words that sound alike match.

    ``uncommon``: the source words that no lexicon has (array<string>).
    """
    sound = primary_code if language == "en" else None

    @F.arrow_udf(STEP)
    def align(s: pa.Array, t: pa.Array, u: pa.Array) -> pa.Array:
        out = []
        for lo in range(0, len(s), 1000):
            part = [x.slice(lo, 1000).to_pylist() for x in (s, t, u)]
            pairs = [((x or "").split(), (y or "").split(), set() if z is None else set(z)) for x, y, z in zip(*part, strict=True)]
            found = align_many(pairs, sound)
            steps = [x for row in found for x in row]
            columns = [pa.array([x[k] for x in steps], pa.string()) for k in range(3)]
            ends = np.append(0, np.cumsum([len(row) for row in found])).astype(np.int32)
            out.append(pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(columns, names=["action", "source", "transcript"])))
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.struct([(c, pa.string()) for c in ("action", "source", "transcript")])))

    return align(source, transcript, F.array().cast("array<string>") if uncommon is None else uncommon)


def error_count(source: Column, transcript: Column, language: str = "", uncommon: Column | None = None) -> Column:
    """The number of ``word_errors`` of ``word_alignment``, without its steps."""
    sound = primary_code if language == "en" else None

    @F.arrow_udf(T.IntegerType())
    def count(s: pa.Array, t: pa.Array, u: pa.Array) -> pa.Array:
        out = []
        for lo in range(0, len(s), 1000):
            part = [x.slice(lo, 1000).to_pylist() for x in (s, t, u)]
            out += count_many([((x or "").split(), (y or "").split(), set() if z is None else set(z)) for x, y, z in zip(*part, strict=True)], sound)
        return pa.array(out, pa.int32())

    return count(source, transcript, F.array().cast("array<string>") if uncommon is None else uncommon)


def word_errors(steps: Column) -> Column:
    """Codes of the errors: ``d:word`` missing, ``i:word`` too many, ``s:word/word`` another."""
    code = lambda x: F.when(x["action"] == "delete", F.concat(F.lit("d:"), x["source"])).when(x["action"] == "insert", F.concat(F.lit("i:"), x["transcript"])).when(x["action"] == "substitute", F.concat(F.lit("s:"), x["source"], F.lit("/"), x["transcript"]))
    return F.filter(F.transform(steps, code), lambda x: x.isNotNull())


def rendered(steps: Column) -> Column:
    """The alignment as text: what is missing in ``[-…-]``, what is too many in ``{+…+}``."""
    show = lambda x: F.when(x["action"] == "delete", F.concat(F.lit("[-"), x["source"], F.lit("-]"))).when(x["action"] == "insert", F.concat(F.lit("{+"), x["transcript"], F.lit("+}"))).when(x["action"] == "substitute", F.concat(F.lit("[-"), x["source"], F.lit("-]{+"), x["transcript"], F.lit("+}"))).otherwise(x["source"])
    return F.array_join(F.transform(steps, show), " ")


def uncommon_words(rows: DataFrame, key: str, text: str, lexicon: DataFrame, word: str = "word") -> DataFrame:
    """Adds uncommon array<string>: the text's words that the lexicon lacks (an anti-join of the distinct words)."""
    words = rows.select(key, F.explode(F.array_distinct(F.split(F.col(text), " "))).alias("w")).where("w <> ''")
    lacking = words.join(lexicon.select(F.col(word).alias("w")).distinct(), "w", "left_anti").groupBy(key).agg(F.sort_array(F.collect_list("w")).alias("uncommon"))
    return rows.join(lacking, key, "left").withColumn("uncommon", F.coalesce("uncommon", F.array().cast("array<string>")))


def verdict(errors: Column, n_words: Column, strictness: Column, music: Column, too_long: Column, truncated: Column, trimmed_by: Column) -> Column:
    """music, too_long, trimmed, failed or passed, in that precedence.

    Length counts only if the words pass; a trimmed clip counts if more than 0.1 s went and it is not cut off.
    """
    failed = errors + truncated.cast("int") > threshold(n_words, strictness)
    return F.when(music, "music").when(~failed & too_long, "too_long").when(~truncated & (trimmed_by > 0.1), "trimmed").when(failed, "failed").otherwise("passed")


def effective_errors(errors: Column, truncated: Column, invalid: Column) -> Column:
    """Errors with one for a cut-off end; 99 for an invalid clip (the legacy score)."""
    return F.when(invalid, 99).otherwise(errors + truncated.cast("int"))


@F.pandas_udf(T.StringType())
def respaced(source: pd.Series, transcript: pd.Series) -> pd.Series:
    """The transcript with the source's spaces where only spaces differ."""

    def one(s: str, t: str) -> str:
        out = []
        for tag, i, j, k, m in SequenceMatcher(None, s, t, autojunk=False).get_opcodes():
            if tag == "delete":
                out.append(s[i:j] if s[i:j].isspace() else "")
            elif tag != "insert" or not t[k:m].isspace():
                out.append(t[k:m])
        return "".join(out)

    return pd.Series([None if s is None or t is None else one(s, t) for s, t in zip(source, transcript, strict=True)])


@F.pandas_udf(T.DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matched characters over all characters, by longest matching blocks."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def same_edges(a: Column, b: Column) -> Column:
    """Whether two arrays of words begin and end with the same word."""
    return (F.get(a, F.lit(0)) == F.get(b, F.lit(0))) & (F.element_at(a, -1) == F.element_at(b, -1))


def semantic_trim(words: Column, source: Column, duration: Column) -> Column:
    """struct<start, end> of the part of a clip that says the source and nothing else, cut half-way between words; null: none.

    words: array<struct<word, start, end>>, words normalised. The first run of as many words as the source has that says it.
    """
    heard, said = F.transform(words, lambda w: w["word"]), F.split(source, " ")

    def cut(s: Column) -> Column:
        n = F.size(s)
        places = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
        first = let(heard, lambda h: F.get(F.filter(places, lambda i: (F.get(h, i) == F.get(s, F.lit(0))) & (F.slice(h, i + 1, n) == s)), F.lit(0)))

        def times(i: Column) -> Column:
            at = lambda k: F.get(words, k)
            start = F.when(i > 0, (at(i - 1)["end"] + at(i)["start"]) / 2).otherwise(0.0)
            end = F.when(i + n >= F.size(words), duration).otherwise(F.least((at(i + n)["start"] + at(i + n - 1)["end"]) / 2, duration))
            return F.when(i.isNotNull() & (start != end), F.struct(start.alias("start"), end.alias("end")))

        return let(first, times)

    return let(said, cut)


# ---------------------------------------------------------------- forced alignment


class _Likeness:
    """Likeness of a phrase to runs of words, with a bound for many runs at once: the characters that both have."""

    def __init__(self, phrases: list[str], words: list[str]):
        self.words, self.phrases = words, phrases
        index = {c: k for k, c in enumerate(sorted({" ", *"".join(phrases), *"".join(words)}))}
        self.space = index[" "]
        count = lambda t: np.bincount([index[c] for c in t], minlength=len(index))
        self.of_phrase = [count(p) for p in phrases]
        self.upto = np.concatenate((np.zeros((1, len(index)), np.int64), np.cumsum([count(w) for w in words], axis=0))) if words else np.zeros((1, len(index)), np.int64)
        self.count, self.memo = count, {}

    def bounds(self, k: int, i: np.ndarray, j: np.ndarray, lead: tuple[str, str] | None = None) -> np.ndarray:
        """No likeness of phrase k to words[i:j] is above these; lead: the words before both."""
        runs = self.upto[j] - self.upto[i]
        runs[:, self.space] += np.maximum(j - i - 1, 0)
        own = self.of_phrase[k]
        if lead:
            runs, own = runs + self.count(lead[1] + " "), own + self.count(lead[0] + " ")
        both = np.minimum(runs, own).sum(1)
        return np.where(own.sum() + runs.sum(1) > 0, 2 * both / np.maximum(own.sum() + runs.sum(1), 1), 1.0)

    def ratio(self, k: int, i: int, j: int, lead: tuple[str, str] | None = None) -> float:
        key = (k, i, j, lead)
        if key not in self.memo:
            a, b = self.phrases[k], " ".join(self.words[i:j])
            self.memo[key] = SequenceMatcher(None, f"{lead[0]} {a}" if lead else a, f"{lead[1]} {b}" if lead else b).ratio()
        return self.memo[key]


def _first_best(bounds: np.ndarray, value) -> tuple[float, int]:
    """(the greatest value, the first place that has it); a place is looked at only if its bound allows it."""
    best, where = -1.0, -1
    for at in np.argsort(-bounds, kind="stable").tolist():
        if bounds[at] < best - 1e-12:
            break
        v = value(at)
        if v > best or (v == best and at < where):
            best, where = v, at
    return best, where


def phrase_ends(phrases: list[str], words: list[str]) -> list[int]:
    """For all phrases but the last the index of its last word: the split with the greatest sum of likenesses (the first of equals)."""
    if len(phrases) < 2:
        return []
    if not words:
        return [0] * (len(phrases) - 1)
    like, w = _Likeness(phrases, words), len(words)
    best, back = np.array([like.ratio(0, 0, j + 1) for j in range(w)]), []
    for k in range(1, len(phrases)):
        found, now = {}, np.full(w, -1.0)
        for j in range(w) if k < len(phrases) - 1 else [w - 1]:
            i = np.arange(j + 1)
            bounds = best[: j + 1] + like.bounds(k, i + 1, np.full(j + 1, j + 1))
            now[j], found[j] = _first_best(bounds, lambda at, j=j, k=k: best[at] + like.ratio(k, at + 1, j + 1))
        back.append(found)
        best = now
    out, j = [], w - 1
    for found in reversed(back):
        j = found[j]
        out.append(j)
    return out[::-1]


TIMED = T.ArrayType(T.StructType([T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType())]))


def timed_phrases(phrases: Column, words: Column, duration: Column) -> Column:
    """array<struct<start, end>> of the phrases of a clip: each ends where the word after its last one starts, the last with the clip.

    phrases: array<string>; words: array<struct<word, start, end>>; both normalised. One phrase, or no words: the whole clip.
    """

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ends(p: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([phrase_ends(list(x), list(y)) for x, y in zip(p, w, strict=True)])

    cuts = ends(phrases, F.transform(words, lambda x: x["word"]))
    times = F.transform(cuts, lambda e: F.coalesce(F.get(words, e + 1)["start"], F.element_at(words, -1)["end"]))
    whole = F.array(F.struct(F.lit(0.0).alias("start"), duration.alias("end")))
    many = F.zip_with(F.concat(F.array(F.lit(0.0)), times), F.concat(times, F.array(duration)), lambda a, b: F.struct(a.alias("start"), b.alias("end")))
    return F.when((F.size(phrases) < 2) | (F.size(words) == 0), whole).otherwise(many)


def follow(phrases: list[str], words: list[tuple[str, float, float]], cursor: int = 0, skip: int = SKIP) -> tuple[list[tuple[float, float]], int, int]:
    """(start, end) of each normalised phrase in a long transcript, (0, 0) where none is found; and the cursor and span left.

    From the cursor on, spans of about the phrase's length that start within ``skip`` words are compared, with the words
    before both; the best counts from a likeness of 0.7 on, else the next phrase may skip more words.
    """
    out: list[tuple[float, float]] = []
    like = _Likeness(phrases, [w for w, _, _ in words])
    for k, phrase in enumerate(phrases):
        n = len(phrase.split())
        if not n or (k and cursor >= len(words) - 1):
            out.append((0.0, 0.0))
            continue
        runs = [(i, j) for i in range(cursor, min(cursor + skip, len(words))) for j in range(i + max(1, int(n * 0.75)), min(i + n + max(int(n * 0.25), 2), len(words)) + 1)]
        lead = (phrases[k - 1].split()[-1], words[cursor - 1][0]) if k and cursor and phrases[k - 1].split() and words[cursor - 1][0] else None
        i, j = (np.array(x, np.int64) for x in zip(*runs, strict=True)) if runs else (np.zeros(0, np.int64),) * 2
        best, at = _first_best(like.bounds(k, i, j, lead), lambda x, k=k, lead=lead, runs=runs: like.ratio(k, *runs[x], lead))
        if best >= LEAST_LIKENESS:
            first, last = runs[at]
            out.append((words[first][1], words[last][1] if last < len(words) else words[last - 1][2]))
            cursor, skip = last, SKIP
        else:
            out.append((0.0, 0.0))
            skip = min(skip + 2 * n, MOST_SKIP)
    return out, cursor, skip


def follow_transcript(books: DataFrame, key: str, phrases: str, words: str) -> DataFrame:
    """(key, times array<struct<start, end>>) of a book's sections against its transcript, one cursor through all.

    phrases: array<array<string>> by section, words: array<struct<word, start, end>>; the sections follow each other.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for sections, heard in zip(batch["p"], batch["w"], strict=True):
                rows, cursor, skip = [], 0, SKIP
                heard = [(x["word"], x["start"], x["end"]) for x in heard]
                for section in sections:
                    times, cursor, skip = follow(list(section), heard, cursor, skip)
                    rows += times
                out.append([{"start": a, "end": b} for a, b in rows])
            yield pd.DataFrame({key: batch[key], "times": out})

    # a step of its own: as an expression within an exploded array it would not be evaluated
    b = books.select(key, F.col(phrases).alias("p"), F.col(words).alias("w"))
    return b.mapInPandas(run, T.StructType([books.schema[key], T.StructField("times", TIMED)]))


def stitched(chunks: DataFrame, key: str, order: str, words: str, tolerance: float = 0.01) -> DataFrame:
    """(key, words): overlapping transcripts of a recording as one.

    Each next chunk goes on after the last word but one: its first word that starts later replaces the last word and
    what follows is added; a chunk without such a word is passed over. words: array<struct<word, start, end>>.
    """
    kind = chunks.schema[words].dataType
    none = F.array().cast(kind)

    def add(done: Column, chunk: Column) -> Column:
        ref = F.coalesce(F.try_element_at(done, F.lit(-2)), F.try_element_at(done, F.lit(-1)))
        rest = F.filter(F.transform(chunk, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: (x["w"]["start"] > ref["start"] + tolerance) & ((x["i"] > 0) | (F.size(chunk) == 1)))
        tail = F.slice(chunk, F.get(rest, F.lit(0))["i"] + 1, F.size(chunk))
        return F.when(F.size(chunk) == 0, done).when(F.size(done) == 0, chunk).when(F.size(rest) == 0, done).otherwise(F.concat(F.slice(done, 1, F.size(done) - 1), tail))

    c = chunks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, words))).alias("c"))
    return c.select(key, F.aggregate(F.transform("c", lambda x: x[words]), none, add).alias(words))


def overlapping_chunks(clips: DataFrame, samples: str, length: int, overlap: int) -> DataFrame:
    """Adds chunk, start and stop: pieces of ``length`` samples, each beginning ``overlap`` before the last one's end."""
    n, stride = F.col(samples), length - overlap
    c = clips.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil((n - overlap) / stride).cast("int") - 1, F.lit(0)))))
    return c.withColumns({"start": F.col("chunk") * stride, "stop": F.least(F.col("chunk") * stride + length, n)})


def best_attempts(attempts: DataFrame, key: str, order: str, errors: str, failed: str, most_retries: int) -> DataFrame:
    """Attempts that a retry policy makes: up to the first that does not fail, ``most_retries`` + 1 at most."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    passed_before = F.coalesce(F.max((~F.col(failed)).cast("int")).over(w), F.lit(0))
    return attempts.withColumns({"__p": passed_before, "attempt": F.row_number().over(Window.partitionBy(key).orderBy(order))}).where((F.col("__p") == 0) & (F.col("attempt") <= most_retries + 1)).drop("__p")
