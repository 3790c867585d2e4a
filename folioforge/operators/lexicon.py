"""Words against lists: substitutions, trusted forms, capitals of known words, brackets, lists built by rules."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from folioforge.functions.text import let, settled, vocalizable, word_parts, words_with_space

#: Endings of Spanish verbs, in the order in which they are tried.
ES_ENDINGS = (
    "abamos abais aban abas aba aramos arais aran aras ara eramos erais eran eras era ieramos ierais ieran ieras iera iriamos iriais irian irias iria "
    "ariamos ariais arian arias aria iendo ando ado ada ados adas ido ida idos idas"
).split()
ES_FAMILIES = (("o", "a", "os", "as"), ("e", "es"))
EN_SUFFIXES = ("s", "es", "'s", "s'")
#: Fixed value: languages whose transcripts are not compared.
UNSUPPORTED = ("zh", "ja", "ko")
_WORD = re.compile(r"[^ \t-\r]+")


def substituted(rows: DataFrame, key: str, text: str, pairs: DataFrame, language: str = "en") -> DataFrame:
    """Texts with whole words replaced, case aside; a capital stays one. English endings s, es, 's and s' are kept.

    pairs: (ord, word, replacement). A word itself comes before its form with an ending (of those the last pair counts).
    The words are joined to the pairs by the word and by what is left without each ending.
    """
    w = rows.select(key, settled(words_with_space(F.col(text))).alias("__w")).select(key, F.posexplode("__w").alias("__i", "__w")).withColumn("__l", settled(F.lower(word_parts(F.col("__w"))["core"])))
    forms = [F.struct(F.col("__l").alias("word"), F.lit("").alias("suffix"))]
    if language == "en":
        forms += [F.when(F.col("__l").endswith(s) & (F.length("__l") > len(s)), F.struct(F.expr(f"substring(__l, 1, length(__l) - {len(s)})").alias("word"), F.lit(s).alias("suffix"))) for s in EN_SUFFIXES]
    found = w.select(key, "__i", "__w", F.explode(F.array(*forms)).alias("__f")).select("*", F.col("__f.word").alias("__word")).where("__word is not null")
    p = pairs.select(F.lower("word").alias("__word"), F.col("ord").alias("__ord"), F.col("replacement").alias("__r")).dropDuplicates(["__word"])
    # only words that a pair has are shuffled, each text's as one array; of a word's forms the last counts
    order = F.struct("__i", (F.col("__f.suffix") == "").cast("int").alias("whole"), "__ord", "__w", "__r", F.col("__f.suffix").alias("suffix"))
    hits = found.join(p, "__word").groupBy(key).agg(F.array_sort(F.collect_list(order)).alias("__hits"))
    best = F.filter("__hits", lambda h, k: F.coalesce(F.get("__hits", k + 1)["__i"] != h["__i"], F.lit(True)))

    def new(h: Column) -> Column:
        upper = lambda parts: F.rlike(F.substring(parts["core"], 1, 1), F.lit(r"\p{Lu}"))
        capital = F.concat(F.upper(F.substring(h["__r"], 1, 1)), F.substring(h["__r"], F.lit(2), F.length(h["__r"])))
        return let(word_parts(h["__w"]), lambda p: F.concat(p["before"], F.when(upper(p), capital).otherwise(h["__r"]), h["suffix"], p["after"]))

    def whole(words: Column, best: Column) -> Column:
        """What is between two hits is a slice of the words."""
        after = lambda k: F.when(k == 0, 0).otherwise(F.get(best, k - 1)["__i"] + 1)
        upto = lambda k, h: F.concat(F.array_join(F.slice(words, after(k) + 1, h["__i"] - after(k)), ""), new(h))
        rest = F.array_join(F.slice(words, F.element_at(best, -1)["__i"] + 2, F.size(words)), "")
        return F.concat(F.array_join(F.transform(best, lambda h, k: upto(k, h)), ""), rest)

    out = rows.join(hits, key, "left").withColumn("__best", settled(best)).withColumn("__words", settled(F.when(F.col("__best").isNotNull(), words_with_space(F.col(text)))))
    return out.withColumn("__new", settled(whole(F.col("__words"), F.col("__best")))).withColumn(text, F.coalesce("__new", text)).drop("__new", "__hits", "__best", "__words")


def trusted(words: DataFrame, lexicon: DataFrame, families: DataFrame | None, language: str, word: str = "word") -> DataFrame:
    """The distinct words that the lexicon has or that a rule of the language trusts.

    English: without 's, or without s. Spanish: a gender or number sibling of a root of four letters or more, or a word of
    seven letters with a verb's ending whose stem's family has two words (families: (stem, n)). Each rule is a join.
    """
    w = words.select(F.col(word).alias("word")).distinct()
    known = lexicon.select(F.col(word).alias("__k")).distinct()
    c = F.col("word")
    if language == "en":
        tries = [c, F.when(c.endswith("'s") & (F.length(c) > 2), F.expr("substring(word, 1, length(word) - 2)")).when(c.endswith("s") & ~c.endswith("'s") & (F.length(c) > 1), F.expr("substring(word, 1, length(word) - 1)"))]
    elif language == "es":
        tries = [c]
        for family in ES_FAMILIES:
            for ending in family:
                n = len(ending)
                tries += [F.when(c.endswith(ending) & (F.length(c) - n >= 4), F.concat(F.expr(f"substring(word, 1, length(word) - {n})"), F.lit(other))) for other in family]
    else:
        tries = [c]
    out = w.select("word", F.explode(F.array_distinct(F.array_compact(F.array(*tries)))).alias("__k")).join(known, "__k", "left_semi").select("word")
    if language == "es" and families is not None:
        stems = F.array_compact(F.array(*[F.when(c.endswith(e), F.expr(f"substring(word, 1, length(word) - {len(e)})")) for e in ES_ENDINGS]))
        usable = F.filter("__s", lambda x, i: ~F.exists(F.slice("__s", F.lit(1), i + 1), lambda y: F.length(y) < 5))  # a short stem ends the search
        by_stem = w.where(F.length("word") >= 7).withColumn("__s", stems).select("word", F.explode(usable).alias("stem")).join(families.select("stem"), "stem", "left_semi").select("word")
        out = out.unionByName(by_stem)
    return out.distinct()


def bracketed(rows: DataFrame, key: str, text: str, known: DataFrame, word: str = "word") -> DataFrame:
    """Texts with the words that ``known`` lacks in brackets, one blank between words."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != "")
    return with_known(rows, key, words, known, word).withColumn(text, _in_brackets(F.coalesce(F.col(text), F.lit("")), F.col("__known"))).drop("__known")


@F.pandas_udf(StringType())
def _in_brackets(text: pd.Series, known: pd.Series) -> pd.Series:
    def one(t: str, k) -> str:
        k = set(() if k is None else k)
        return " ".join([w if w in k else f"[{w}]" for w in _WORD.findall(t)])

    return pd.Series([one(t, k) for t, k in zip(text, known, strict=True)], dtype=object)


def with_known(rows: DataFrame, key: str, words: Column, known: DataFrame, word: str = "word") -> DataFrame:
    """Rows with __known array<string>: which of their ``words`` (array<string>) are known, each once; null if none is.

    A text's distinct words are joined, and those that are known come back to its row; no word is shuffled with its place.
    """
    w = rows.select(key, settled(F.array_distinct(words)).alias("__x")).select(key, F.explode("__x").alias("__k"))
    found = w.join(known.select(F.col(word).alias("__k")).distinct(), "__k", "left_semi").groupBy(key).agg(F.collect_list("__k").alias("__known"))
    return rows.join(found, key, "left")


def lower_known_capitals(rows: DataFrame, key: str, text: str, known: DataFrame, word: str = "word") -> DataFrame:
    """Texts all in capitals: the words that are known become small, the others stay."""
    capitals = F.rlike(F.col(text), F.lit("[A-Z]")) & ~F.rlike(F.col(text), F.lit("[a-z]"))
    w = with_known(rows, key, F.when(capitals, F.split(F.lower(text), " ")), known, word)
    return w.withColumn(text, _in_small(F.col(text), F.lower(text), F.col("__known"))).drop("__known")


@F.pandas_udf(StringType())
def _in_small(text: pd.Series, small: pd.Series, known: pd.Series) -> pd.Series:
    def one(t: str, s: str, k) -> str:
        k = set(() if k is None else k)
        return t if not k else " ".join([b if b in k else a for a, b in zip(t.split(" "), s.split(" "), strict=True)])

    return pd.Series([t if t is None else one(t, s, k) for t, s, k in zip(text, small, known, strict=True)], dtype=object)


def acronym(raw: Column) -> Column:
    """At least two letters, all of them capitals."""
    letters = F.regexp_replace(raw, r"[^\p{L}]", "")
    return (F.length(letters) >= 2) & F.rlike(letters, F.lit(r"^\p{Lu}+$"))


def glued_capitals(raw: Column) -> Column:
    """At least three letters, some small, with a capital after the first."""
    letters = F.regexp_replace(raw, r"[^\p{L}]", "")
    return (F.length(letters) >= 3) & F.rlike(letters, F.lit(r"\p{Ll}")) & F.rlike(letters, F.lit(r"^.+\p{Lu}"))


def list_reason(raw: Column, normal: Column, shortest: int, longest: int, stoplist: list[str]) -> Column:
    """Why a word is not for a list, by the first rule that says so; ``keep`` if none does."""
    return (
        F.when(normal == "", "empty").when(normal.isin(*stoplist), "stoplist").when(F.length(normal) < shortest, "too_short").when(F.length(normal) > longest, "too_long")
        .when(F.rlike(raw, F.lit(r"(?i)https?:|www\.|@|\.(?:com|org|net)\b|/")) | normal.startswith("http") | normal.startswith("www"), "url_or_email").when(F.rlike(raw, F.lit(r"\p{Nd}")), "contains_digit")
        .when(acronym(raw), "all_caps_acronym").when(glued_capitals(raw), "internal_camelcase_glued_token").when(~F.rlike(normal, F.lit(r"^[a-zñ]+$")), "malformed_after_normalization")
        .when((F.length(normal) >= 2) & F.rlike(normal, F.lit(r"^m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$")), "roman_numeral").otherwise("keep")
    )


def best_tokens(tokens: DataFrame, normal: str, raw: str, score: str, most: int) -> DataFrame:
    """(word, score, forms, rank) of the ``most`` normal forms with the best score (the list's size), equals by the word."""
    t = tokens.groupBy(F.col(normal).alias("word")).agg(F.max(score).alias("score"), F.sort_array(F.collect_set(raw)).alias("forms"))
    return t.orderBy(F.desc("score"), "word").limit(most).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "word")))


def uncommon_report(words: DataFrame, key: str, position: str, raw: str, known: DataFrame, word: str = "word") -> DataFrame:
    """(word, n, forms): words without edges that ``known`` lacks, with their forms in the order first seen."""
    core = F.replace(word_parts(F.col(raw))["core"], F.lit("’"), F.lit("'"))
    w = words.select(key, position, settled(core).alias("__c"))
    whole = {"tinyint", "smallint", "int", "bigint"}
    place = F.struct(key, position)
    if {dict(words.dtypes)[c] for c in (key, position)} <= whole:  # one number, whose minimum needs no sort; it comes first where the key is null
        place = F.coalesce(F.col(key).cast("decimal(20,0)"), F.lit("-10000000000000000000").cast("decimal(20,0)")) * F.lit(str(2**63)).cast("decimal(19,0)") + F.col(position).cast("decimal(19,0)")
    # forms are counted first, so the lexicon meets each form once
    forms = w.groupBy("__c").agg(F.count("*").alias("n"), F.min(place).alias("at")).where(vocalizable(F.col("__c"))).withColumn("__l", settled(F.lower("__c")))
    forms = forms.join(known.select(F.col(word).alias("__l")).distinct(), "__l", "left_anti")
    return forms.groupBy(F.col("__l").alias("word")).agg(F.sum("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("at", F.col("__c").alias("f")))), lambda x: x["f"]).alias("forms"))


def is_supported(language: Column) -> Column:
    out = F.lit(True)
    for x in UNSUPPORTED:
        out = out & ~language.startswith(x)
    return out


def skip_reason(disabled: Column, language: Column, buffer_too_short: Column) -> Column:
    """Why a transcript is not made; empty if it is."""
    return F.when(disabled, "Whisper disabled").when(~is_supported(language), "Unsupported language").when(buffer_too_short, "Sound buffer duration too short").otherwise("")
