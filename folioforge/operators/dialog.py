"""Dialog in segmented text: quoted spans, groups cut at their ends, quote ends before an attribution, voices of dialog groups."""

from __future__ import annotations

import unicodedata
from bisect import bisect_right

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructType

from folioforge.functions.text import settled, spoken_words, vocalizable

#: Fixed value: the voice of dialog, counted from 0.
DIALOG_VOICE = 1
#: English verbs that introduce a speaker.
ATTRIBUTION_VERBS = (
    "say says said ask asks asked tell tells told reply replies replied add adds added answer answers answered explain explains explained continue continues continued "
    "exclaim exclaims exclaimed shout shouts shouted whisper whispers whispered murmur murmurs murmured mutter mutters muttered cry cries cried call calls called "
    "remark remarks remarked state states stated note notes noted declare declares declared retort retorts retorted respond responds responded insist insists insisted "
    "warn warns warned promise promises promised suggest suggests suggested repeat repeats repeated"
).split()
_QUOTES = "\"“”"
PAIRS = ArrayType(StructType().add("open", IntegerType()).add("close", IntegerType()).add("stop", IntegerType()).add("content", StringType()).add("before", StringType()).add("across", BooleanType()).add("after", StringType()))
PARTS = ArrayType(StructType().add("group_index", IntegerType()).add("part_index", IntegerType()).add("text", StringType()).add("phrase", IntegerType()).add("said", BooleanType()).add("inside", BooleanType()))
#: The same as Arrow has them.
_PAIRS = pa.list_(pa.struct([("open", pa.int32()), ("close", pa.int32()), ("stop", pa.int32()), ("content", pa.string()), ("before", pa.string()), ("across", pa.bool_()), ("after", pa.string())]))
_PARTS = pa.list_(pa.struct([("group_index", pa.int32()), ("part_index", pa.int32()), ("text", pa.string()), ("phrase", pa.int32()), ("said", pa.bool_()), ("inside", pa.bool_())]))
#: Signs after a quote that an attribution is looked for in.
AFTER = 1000
#: As much of it as an attribution can be told by: a word, and the next one as long as a verb and a sign more.
_AHEAD = regex.compile(rf"[ \t-\r]*[^ \t-\r]*[ \t]*[^ \t-\r]{{0,{max(map(len, ATTRIBUTION_VERBS)) + 2}}}")
_TAIL = regex.compile(r"(?:(?![\"“”])\p{P})*[ \t-\r]*")


def line_pairs(line: str) -> list[tuple[int, int]]:
    """Quote signs of a line that belong together, innermost first."""
    bare = line.strip()
    if not bare:
        return []
    first = line.index(bare[0])
    last = first + len(bare) - 1
    stack, out = [], []
    for i, c in enumerate(line):
        if c not in _QUOTES:
            continue
        ahead, behind = line[i + 1 : i + 2], line[i - 1 : i] if i else ""
        closes = c == "”" or (first < i and (not ahead or ahead.isspace() or _punctuation(ahead)))
        if stack and closes:
            out.append((stack.pop(), i))
        elif c == "“" or (i < last and (not behind or behind.isspace() or behind in "([{<:;,—–-")):
            stack.append(i)
    return out


def _punctuation(c: str) -> bool:
    return unicodedata.category(c).startswith("P")


def _pairs(text: str, ends: list[int]) -> list[dict]:
    """The pairs of a text, whose groups end at ``ends``."""
    out, at = [], 0
    for line in text.splitlines(keepends=True):
        if any(q in line for q in _QUOTES):
            body = line.rstrip("\r\n")
            for i, j in line_pairs(body):
                k = i - 1
                while k >= 0 and body[k].isspace():
                    k -= 1
                group = bisect_right(ends, at + j)
                stop = _TAIL.match(text, at + j + 1, ends[group]).end()
                across = group != bisect_right(ends, at + i)
                out.append({"open": at + i, "close": at + j, "stop": stop, "content": body[i + 1 : j], "before": body[k : k + 1] if k >= 0 else "", "across": across, "after": _AHEAD.match(text, stop, min(stop + AFTER, len(text))).group()})
        at += len(line)
    return sorted(out, key=lambda p: (p["open"], -p["close"]))


def _in_pieces(columns: tuple[pa.Array, ...], kind: pa.DataType, one) -> pa.Array:
    """``one`` of each row, some hundred rows at a time: as Python objects a batch would take many times its size."""
    out = [pa.array([], kind)]
    for lo in range(0, len(columns[0]), 200):
        out.append(pa.array([one(*row) for row in zip(*(c.slice(lo, 200).to_pylist() for c in columns), strict=True)], kind))
    return pa.concat_arrays(out)


@F.arrow_udf(PAIRS)
def quote_pairs(text: pa.Array, ends: pa.Array) -> pa.Array:
    """The quotes of a text by their place.

    before: the last sign in front of the quote in its line; across: whether it crosses the end of a group; stop: where the
    punctuation and white space after it end within the group; after: the text from there on.
    """
    return _in_pieces((text, ends), _PAIRS, lambda t, e: _pairs(t or "", e))


def _is_dialog(pair: Column) -> Column:
    content = pair["content"]
    first = F.regexp_extract(content, r"[\p{L}\p{N}]", 0)
    likely = (F.size(spoken_words(content)) > 3) | pair["across"] | (pair["before"] == "") | pair["before"].isin(",", ":", "—", "–")
    return vocalizable(content) & (F.rlike(first, F.lit(r"\p{Lu}")) | likely | F.rlike(content, F.lit(r"^\s*[—–]|[?!]")))


def attribution(after: Column, language: Column) -> Column:
    """Whether a text goes on in small letters or, in English, with a name and a verb of speaking."""
    verbs = "|".join(ATTRIBUTION_VERBS)
    return F.rlike(after, F.lit(r"^\s*\p{Ll}")) | ((language == "en") & F.rlike(after, F.lit(rf"^\s*\p{{Lu}}\S*[ \t]+(?i:{verbs})(?!\p{{L}})")))


def _parts(text: str, lengths: list[list[int]], spans: list[tuple[int, int, int, bool]]) -> list[dict]:
    """The groups of a text cut where spans (open, close, stop, said) begin and stop; of spans inside each other the outer counts.

    lengths: those of the phrases of each group. A part names the phrase that ends with it, if one does.
    """
    outer, last = [], -1
    for first, close, stop, said in spans:
        if first >= last:
            outer.append((first, stop, said))
            last = max(last, close)
    cuts = {}
    for first, stop, said in outer:
        cuts.setdefault(first, False)
        cuts[stop] = cuts.get(stop, False) or said
    places = sorted(cuts)
    out, at, phrase, c, o = [], 0, 0, 0, 0
    for g, group in enumerate(lengths):
        ends = {}
        start = at
        for n in group:
            at += n
            ends[at] = phrase
            phrase += 1
        k, begin = 0, start
        while c < len(places) and places[c] <= start:
            c += 1
        while begin < at or k == 0:
            end = min(places[c], at) if c < len(places) else at
            while o < len(outer) and outer[o][1] < end:
                o += 1
            inside = o < len(outer) and outer[o][0] <= begin and end <= outer[o][1]
            out.append({"group_index": g, "part_index": k, "text": text[begin:end], "phrase": ends.get(end, -1), "said": cuts.get(end, False), "inside": inside})
            begin, k = end, k + 1
            c += c < len(places) and places[c] <= end
    return out


@F.arrow_udf(PARTS)
def _cut(text: pa.Array, lengths: pa.Array, spans: pa.Array) -> pa.Array:
    return _in_pieces((text, lengths, spans), _PARTS, lambda t, n, s: _parts(t, n, [(x["open"], x["close"], x["stop"], x["said"]) for x in s]))


def dialog_arrays(rows: DataFrame, language: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """(id, group_index, part_index, text, reason, voice): groups cut where dialog begins and ends; voice 1 inside dialog, else -1.

    rows: (id, language, groups array<array<struct<text, reason, ...>>>), a text each. A part that ends a quote before an
    attribution has reason ``isqe``. Quotes are paired and groups are cut in time that is linear in the text.
    """
    texts = F.transform("groups", lambda g: F.transform(g, lambda x: x["text"]))
    lengths = F.transform("groups", lambda g: F.transform(g, lambda x: F.length(x["text"])))
    reasons = F.flatten(F.transform("groups", lambda g: F.transform(g, lambda x: x["reason"])))
    book = F.struct(F.array_join(F.flatten(texts), "").alias("text"), lengths.alias("n"), reasons.alias("r"))
    r = rows.select(id_col, language, settled(book).alias("__b")).withColumn("__pairs", quote_pairs(F.col("__b.text"), _ends(F.col("__b.n"))))
    spans = F.transform(F.filter("__pairs", _is_dialog), lambda p: F.struct(p["open"].alias("open"), p["close"].alias("close"), p["stop"].alias("stop"), attribution(p["after"], F.col(language)).alias("said")))
    r = r.select(id_col, "__b", settled(spans).alias("__spans"))
    r = r.withColumn("__parts", _cut(F.col("__b.text"), F.col("__b.n"), F.col("__spans"))).select(id_col, F.col("__b.r").alias("__r"), F.explode("__parts").alias("p"))
    reason = F.when(F.col("p.said"), "isqe").when(F.col("p.phrase") >= 0, F.get("__r", F.col("p.phrase"))).otherwise("is")
    return r.select(id_col, "p.group_index", "p.part_index", "p.text", reason.alias("reason"), F.when(F.col("p.inside"), DIALOG_VOICE).otherwise(-1).alias("voice"))


@F.arrow_udf(ArrayType(IntegerType()))
def _ends(lengths: pa.Array) -> pa.Array:
    """Where groups end, from the lengths of their phrases."""

    def sums(groups) -> list[int]:
        out, at = [], 0
        for g in groups:
            at += sum(g)
            out.append(at)
        return out

    return _in_pieces((lengths,), pa.list_(pa.int32()), sums)


def dialog_groups(group_rows: DataFrame, language: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """``dialog_arrays`` of rows (id, language, group_index, phrases)."""
    ordered = F.array_sort(F.collect_list(F.struct("group_index", F.transform("phrases", lambda x: F.struct(x["text"].alias("text"), x["reason"].alias("reason"))).alias("g"))))
    books = group_rows.groupBy(id_col, language).agg(F.transform(ordered, lambda x: x["g"]).alias("groups"))
    return dialog_arrays(books, language, id_col)
