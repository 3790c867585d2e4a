"""Licence scans: sparse TF-IDF cosine of lines, spans and licence files to templates, then inheritance from the nearest directory.

Every line of a text is a header candidate. Its terms (lower-case runs of letters and digits) are weighted by
``tf * idf``; document frequencies are counted over the whole corpus for the templates' terms, and a term that no
template has weighs as if no document had it. A line matches the template with the highest cosine of at least
``threshold`` (ties: the template's name). Lines that share only light terms with every template cannot reach the
threshold (Cauchy-Schwarz over the templates' weights) and are passed over before any vector is made.

Headers that wrap over lines or stand inside a longer one are found as spans: runs of neighbouring terms, across line
ends and sentences, in what no matching line covers. A span has as many terms as can reach the threshold by count (the
template's, times and over threshold ** 2); a term that no template has weighs as much in it as the heaviest template
term, so that the cosine does not fall as the corpus grows. Of spans that overlap the one with the highest cosine
counts (ties: the first, the shorter, the name).

The whole text of a licence file is compared to ``full_texts``: cosine of ``(1 + ln tf) * idf``, with document
frequencies over the licence files, and for a term that no full text has the mean idf of the templates' terms. From
``full_threshold`` on the full text is the file's own licence, whatever its lines name.

Else a file's own licence is the one most of its matching lines and spans name (ties: the name). The licence of a directory is
that of its licence files (``is_licence_file``). A file without a licence of its own inherits that of the nearest
directory above it, found by equi-joins of directories with their ancestors.

Everything is DataFrame functions. Templates are a literal list, whose size is checked; full texts are compared by
joins on the terms of the distinct licence files.
Edge cases: null texts and texts without a match have no licence; null paths have no directory and inherit
nothing; a path given twice is judged per row; several licence files in a directory: the most common licence, then
the name; empty tables give empty results; input columns named like one of the three that are added are replaced.
"""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import written

TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
)
MAX_TEMPLATE_TERMS = 2000
MAX_FULL_TERMS = 100_000
_BREAK = "\x01"


def full_texts() -> tuple[tuple[str, str], ...]:
    """(name, text) of the licences whose full text comes with the package."""
    return tuple((p.stem, p.read_text()) for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt")))


def terms_of(text: str) -> list[str]:
    import re

    return re.findall(r"[a-z0-9]+", text.lower())


def document_frequencies(docs: DataFrame, vocabulary: list[str], text: str = "text") -> tuple[int, dict[str, int]]:
    """(documents, documents with each term of the vocabulary) over the whole corpus."""
    pattern = r"(?<![a-z0-9])(" + "|".join(sorted(vocabulary, key=lambda t: (-len(t), t))) + r")(?![a-z0-9])"
    d = docs.select(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(pattern), F.lit(1))).alias("terms"))
    rows = d.select(F.explode_outer("terms").alias("term"), F.lit(1).alias("n")).groupBy("term").count().collect()  # one row a term
    return d.count(), {t: 0 for t in vocabulary} | {r["term"]: r["count"] for r in rows if r["term"] is not None}


def line_licence(line: Column, templates, idf: dict[str, float], unknown: float, threshold: float) -> Column:
    """The template that a line matches, else null."""
    found = F.regexp_extract_all(F.lower(line), F.lit("([a-z0-9]+)"), F.lit(1))
    best = cosines(found, templates, idf, unknown)
    top = F.greatest(*[c for _, c in best], F.lit(-1.0)) if len(best) > 0 else F.lit(-1.0)
    out = F
    for name, c in sorted(best, key=lambda x: x[0]):
        out = out.when((c == top) & (c >= threshold), name)
    return out.otherwise(F.lit(None).cast("string"))


def cosines(found: Column, templates, idf: dict[str, float], unknown: float) -> list[tuple[str, Column]]:
    """(template, cosine) of an array of terms to each template."""
    known = F.create_map(*[x for t, w in sorted(idf.items()) for x in (F.lit(t), F.lit(w))])
    squares = F.aggregate(F.array_distinct(found), F.lit(0.0), lambda a, t: a + F.pow(F.coalesce(F.element_at(known, t), F.lit(unknown)) * F.size(F.filter(found, lambda x: x == t)), 2))
    best = []
    for name, text in templates:
        weight = {t: terms_of(text).count(t) * idf[t] for t in terms_of(text)}
        norm = math.sqrt(sum(w * w for w in weight.values()))
        shared = F.create_map(*[x for t, w in sorted(weight.items()) for x in (F.lit(t), F.lit(w * idf[t] / norm))])
        best.append((name, F.round(_sum_of(found, shared) / F.sqrt(squares), 9)))
    return best


def span_licences(text: Column, templates, idf: dict[str, float], heavy: list[str], threshold: float) -> Column:
    """The templates that spans of a text match, one for each place; no span crosses a ``_BREAK``."""
    unknown = max(idf.values())

    def runs_of(terms: Column, at: Column, name: str, x: str, n: int) -> Column:
        """(negative cosine, start, end, template) of the runs of n terms that hold a heavy one."""
        starts = F.transform(at, lambda i: F.sequence(F.greatest(i - n + 1, F.lit(0)), F.least(i, F.size(terms) - n)))
        starts = F.when(F.size(terms) >= n, F.array_distinct(F.flatten(starts))).otherwise(F.array().cast("array<int>"))
        runs = F.transform(starts, lambda s: F.struct(s.alias("s"), F.slice(terms, s + 1, n).alias("w")))
        runs = F.filter(runs, lambda r: ~F.array_contains(r["w"], _BREAK))
        return F.transform(runs, lambda r: F.struct((-cosines(r["w"], [(name, x)], idf, unknown)[0][1]).alias("c"), r["s"].alias("s"), (r["s"] + n).alias("e"), F.lit(name).alias("name")))

    def spans(terms: Column) -> Column:
        at = F.filter(F.transform(terms, lambda t, i: F.when(t.isin(heavy), i)), lambda i: i.isNotNull())
        found = []
        for name, x in templates:
            m = len(terms_of(x))
            found += [runs_of(terms, at, name, x, n) for n in range(math.ceil(m * threshold**2), math.floor(m / threshold**2) + 1)]
        best = F.array_sort(F.filter(F.concat(*found), lambda r: r["c"] <= -threshold))
        none = F.array().cast("array<struct<c:double,s:int,e:int,name:string>>")
        taken = F.aggregate(best, none, lambda a, r: F.when(F.exists(a, lambda b: (b["s"] < r["e"]) & (r["s"] < b["e"])), a).otherwise(F.concat(a, F.array(r))))
        return F.transform(taken, lambda r: r["name"])

    terms = F.regexp_extract_all(F.lower(text), F.lit(f"([a-z0-9]+|{_BREAK})"), F.lit(1))
    return F.flatten(F.transform(F.array(terms), spans))  # through an array of one, so that the terms are found once


def full_licences(files: DataFrame, texts, text: str, threshold: float) -> DataFrame:
    """(key, full) of the distinct texts, by their SHA-256, that match a full text."""
    spark = files.sparkSession
    tf = {(name, t): 1 + math.log(n) for name, x in texts for t, n in Counter(terms_of(x)).items()}
    vocabulary = {t for _, t in tf}
    if len(vocabulary) > MAX_FULL_TERMS:
        raise ValueError(f"{len(vocabulary)} terms of full texts; at most {MAX_FULL_TERMS} fit the driver")
    once = files.where(F.col(text).isNotNull()).groupBy(F.sha2(text, 256).alias("key")).agg(F.any_value(text).alias("text"))
    terms = once.select("key", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), F.lit(1))).alias("term"))
    terms = written(terms.groupBy("key", "term").agg((1 + F.log(F.count("*"))).alias("tf")), "licence-terms")
    n = terms.select("key").distinct().count()
    listed = F.broadcast(spark.createDataFrame([(t,) for t in sorted(vocabulary)], "term string"))
    df = {r["term"]: r["count"] for r in terms.join(listed, "term").groupBy("term").count().collect()}  # one row a term of the full texts
    idf = {t: math.log((1 + n) / (1 + df.get(t, 0))) + 1 for t in vocabulary}
    norm = {name: math.sqrt(sum((w * idf[t]) ** 2 for (k, t), w in tf.items() if k == name)) for name, _ in texts}
    weights = F.broadcast(spark.createDataFrame([(t, idf[t], {name: tf[name, t] * idf[t] / norm[name] for name, _ in texts if (name, t) in tf}) for t in sorted(vocabulary)], "term string, idf double, w map<string,double>"))
    w = F.col("tf") * F.coalesce("idf", F.lit(sum(idf.values()) / len(idf)))
    sums = terms.join(weights, "term", "left").groupBy("key").agg(F.sqrt(F.sum(w * w)).alias("norm"), *[F.sum(w * F.coalesce(F.element_at("w", F.lit(name)), F.lit(0.0))).alias(f"dot{i}") for i, (name, _) in enumerate(texts)])
    best = F.array_min(F.array(*[F.struct((-F.round(F.col(f"dot{i}") / F.col("norm"), 9)).alias("c"), F.lit(name).alias("name")) for i, (name, _) in enumerate(texts)]))
    return sums.select("key", best.alias("best")).where(F.col("best.c") <= -threshold).select("key", F.col("best.name").alias("full"))


def _sum_of(terms: Column, weights: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda a, t: a + F.coalesce(F.element_at(weights, t), F.lit(0.0)))


def heavy_terms(templates, idf: dict[str, float], threshold: float) -> list[str]:
    """Terms of which a line must have one to reach the threshold with any template."""
    out: set[str] = set()
    for _, text in templates:
        weight = {t: terms_of(text).count(t) * idf[t] for t in terms_of(text)}
        norm = sum(w * w for w in weight.values())
        light = 0.0
        for t, w in sorted(weight.items(), key=lambda x: (x[1], x[0])):
            light += w * w
            if light >= (threshold * 0.999) ** 2 * norm:
                out.add(t)
    return sorted(out)


def scan_licences(files: DataFrame, *, path: str = "path", text: str = "text", templates=TEMPLATES, threshold: float = 0.8, is_licence_file: Column | None = None, full: tuple[tuple[str, str], ...] | None = None, full_threshold: float = 0.9) -> DataFrame:
    """The files (without their text) with own_licence, licence and licence_from (the directory it comes from, or null).

    ``full``: (name, text) of full-text templates (``full_texts()`` if None).
    """
    full = full_texts() if full is None else full
    vocabulary = sorted({t for _, x in templates for t in terms_of(x)})
    if len(vocabulary) > MAX_TEMPLATE_TERMS:
        raise ValueError(f"{len(vocabulary)} template terms; at most {MAX_TEMPLATE_TERMS} fit an expression")
    n, df = document_frequencies(files, vocabulary, text)
    idf = {t: math.log((1 + n) / (1 + df[t])) + 1 for t in vocabulary}
    unknown = math.log(1 + n) + 1
    terms = heavy_terms(templates, idf, threshold)
    heavy = r"(?i)(?<![a-z0-9])(" + "|".join(terms) + r")(?![a-z0-9])"
    lines = F.when(F.rlike(F.col("__text"), F.lit(heavy)), F.split(F.col("__text"), "\n"))
    kept = [F.col(c) for c in files.columns if c not in (text, "own_licence", "licence", "licence_from")]
    named_so = F.regexp_like(F.col(path), F.lit(r"(?i)(^|/)(licen[cs]e|copying)[^/]*$")) if is_licence_file is None else is_licence_file
    f = files.select(F.struct(*kept).alias("__in"), F.col(path).alias("__path"), F.col(text).alias("__text"), F.coalesce(named_so, F.lit(False)).alias("__licence_file"))
    path, text = "__path", "__text"
    if full:
        whole = full_licences(f.where("__licence_file"), full, text, full_threshold)
        other = F.concat(F.lit("-"), F.xxhash64(path, text).cast("string"))  # meets nothing, and spreads the other files
        f = f.withColumn("__key", F.coalesce(F.when(F.col("__licence_file"), F.sha2(text, 256)), other))
    f = f.withColumn("__l", F.transform(lines, lambda x: F.struct(x.alias("line"), F.when(F.rlike(x, F.lit(heavy)), line_licence(x, templates, idf, unknown, threshold)).alias("name"))))
    named = F.filter(F.transform("__l", lambda x: x["name"]), lambda x: x.isNotNull())
    rest = F.array_join(F.transform("__l", lambda x: F.when(x["name"].isNull(), x["line"]).otherwise(_BREAK)), "\n")
    spans = F.when(F.rlike(rest, F.lit(heavy)), span_licences(rest, templates, idf, terms, threshold))
    f = f.withColumn("__m", F.concat(F.coalesce(named, F.array().cast("array<string>")), F.coalesce(spans, F.array().cast("array<string>"))))
    f = f.drop(text, "__l")
    names = F.array(*[F.lit(k) for k, _ in sorted(templates)])
    counts = F.transform(names, lambda k: F.struct((-F.size(F.filter("__m", lambda x: x == k))).alias("n"), k.alias("k")))
    f = f.withColumn("__own", F.when(F.size("__m") > 0, F.array_min(counts)["k"])).drop("__m")
    if full:
        f = f.join(whole.select(F.col("key").alias("__key"), F.col("full").alias("__full")), "__key", "left").withColumn("__own", F.coalesce("__full", "__own")).drop("__key", "__full")
    directory = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    f = f.withColumn("__dir", F.when(F.col(path).contains("/"), directory).otherwise(F.when(F.col(path).isNotNull(), "")))
    given = f.where("__licence_file and __own is not null and __dir is not null").groupBy(F.col("__dir").alias("above"), "__own").count()
    given = given.groupBy("above").agg(F.min(F.struct((-F.col("count")).alias("n"), "__own"))["__own"].alias("given"))
    parts = F.split("__dir", "/")
    up = f.where("__own is null and __dir is not null").select("__dir").distinct()
    up = up.withColumn("above", F.explode(F.concat(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")), F.array(F.lit("")))))
    near = up.distinct().join(given, "above").groupBy("__dir").agg(F.max_by(F.struct("above", "given"), F.length("above")).alias("__near"))
    out = f.join(near, "__dir", "left")
    return out.select("__in.*", F.col("__own").alias("own_licence"), F.coalesce("__own", "__near.given").alias("licence"), F.when(F.col("__own").isNull(), F.col("__near.above")).alias("licence_from"))
