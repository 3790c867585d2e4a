"""Quality rules: text statistics in SQL, and a decision list learned from labelled documents.

Statistics are DataFrame expressions over whole texts. ``n_repeat_words`` counts the words inside 3-word windows
found twice or more: window hashes and positions are packed into one long (the position in as many low bits as
the text's length needs), sorted, and neighbours with equal hashes count once their words are equal too.

The list is learned by sequential covering. A rule grows by the threshold condition with the best information
gain over binned statistics, counted by Spark per (feature, bin) on the growing rows. The cuts between bins are taken
anew at each step from the rows that are left: quantiles of all of them and of the bad ones, and the ends of both
classes, so that bad rows of any share can be parted from clean ones. A rule is pruned to the prefix
of its conditions with the best ``(p - n) / (p + n)`` on held-out rows, and taken if its held-out precision and
support are enough; the rows it covers are then set aside and the next rule grows. Where a rule fails, the next one
begins with another feature or side, until all have failed. All labelled rows count; what
reaches the driver is one row per feature and bin. The list is an ordered chain of ``CASE WHEN`` conditions.

Edge cases: null and blank texts have no words, zero statistics and fail the base rule; ratios with a zero
denominator are 0; without labels the list is empty and the base rule alone decides; labels for unknown documents
and null labels are left out; a document's repeated rows are judged alike.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import SPACE, written

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = {
    "mean_word": "word_chars / n_words",
    "symbol_ratio": "n_symbols / word_chars",
    "upper_ratio": "n_upper / word_chars",
    "dup_line_ratio": "n_dup_lines / n_lines",
    "repeat_ratio": "n_repeat_words / n_words",
    "words_per_line": "n_words / n_lines",
}
_STATS = ("n_lines", "n_upper")


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with the statistics of ``BASE`` and the two that the learned features need besides.

    Input columns with a statistic's name are replaced; helper columns start with ``__``.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.withColumn("__t", t)
    d = d.withColumn("__w", F.split(F.btrim("__t", F.lit(" \t\n\x0b\x0c\r")), SPACE))
    d = d.withColumn("__w", F.expr("if(__w[0] = '', cast(array() as array<string>), __w)"))
    d = d.withColumns({"n_words": F.size("__w").cast("long"), "__bits": F.length(F.bin(F.size("__w")))})
    d = d.withColumns(
        {
            "word_chars": F.length(F.array_join("__w", "")).cast("long"),
            "n_symbols": F.regexp_count("__t", F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_upper": F.regexp_count("__t", F.lit(r"\p{Lu}")).cast("long"),
            "__lines": F.expr(r"filter(split(__t, '\n'), x -> rlike(x, '[^\\x20\\x09-\\x0D]'))"),
            # position in the low bits, hash above
            "__s": F.expr("if(n_words < 3, cast(array() as array<bigint>), sort_array(transform(sequence(0, cast(n_words as int) - 3), i -> shiftleft(shiftrightunsigned(xxhash64(get(__w, i), get(__w, i + 1), get(__w, i + 2)), __bits), __bits) | i)))"),
        }
    )
    same = "(shiftrightunsigned(x ^ get(__s, {k}), __bits) = 0 and get(__w, {i}) = get(__w, {j}) and get(__w, {i} + 1) = get(__w, {j} + 1) and get(__w, {i} + 2) = get(__w, {j} + 2))"
    here, there = "cast(x & (shiftleft(1L, __bits) - 1) as int)", "cast(get(__s, {k}) & (shiftleft(1L, __bits) - 1) as int)"
    pair = lambda k: same.format(k=k, i=here, j=there.format(k=k))
    d = d.withColumn("__r", F.expr(f"sort_array(transform(filter(__s, (x, k) -> coalesce(k > 0 and {pair('k - 1')}, false) or coalesce({pair('k + 1')}, false)), x -> {here}))"))
    d = d.withColumns(
        {
            "n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": F.expr("aggregate(transform(__r, (x, k) -> least(3, coalesce(get(__r, k + 1) - x, 3))), 0L, (a, x) -> a + x)"),
        }
    )
    return d.drop(*[c for c in d.columns if c.startswith("__")])


def base_failed(min_words: int = 50, max_repeat_percent: int = 50) -> Column:
    """Too few words, or too many of them in repeated windows."""
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def feature(name: str) -> Column:
    a, b = FEATURES[name].split(" / ")
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)


class Condition(NamedTuple):
    feature: str
    op: str  # ">" or "<="
    threshold: float

    @property
    def column(self) -> Column:
        x = feature(self.feature)
        return x > self.threshold if self.op == ">" else x <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {self.op} {self.threshold:.6g}"


class Rule(NamedTuple):
    conditions: tuple[Condition, ...]
    positives: int
    negatives: int

    @property
    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column
        return out

    def __str__(self) -> str:
        return " AND ".join(map(str, self.conditions)) + f"  [{self.positives}:{self.negatives}]"


def rejected_by(rules: list[Rule]) -> Column:
    """Number of the first rule that fits, from 1; 0 if none does."""
    out = F
    for k, r in enumerate(rules, 1):
        out = out.when(r.column, k)
    return out.otherwise(0) if rules else F.lit(0)


def learn_rules(labelled: DataFrame, *, target: str = "bad", bins: int = 24, max_rules: int = 8, max_conditions: int = 3, min_precision: float = 0.97, min_support: int = 3) -> list[Rule]:
    """A decision list that rejects rows with ``target`` = 1, learned from statistics and labels.

    ``labelled``: the statistics, ``target`` (0 or 1) and ``fold`` (true: a growing row; false: held out).
    """
    names = list(FEATURES)
    rows = labelled.select(F.col(target).cast("int").alias("y"), "fold", *[feature(n).alias(n) for n in names]).where("y is not null")
    left = written(rows, "quality-features")
    rules: list[Rule] = []
    q = [k / bins for k in range(1, bins)]

    def cuts_of(df: DataFrame) -> dict[str, list[float]]:
        """Thresholds of each feature: quantiles of all and of bad rows, and the ends of both classes."""
        cols = []
        for n in names:
            bad, clean = F.when(F.col("y") == 1, F.col(n)), F.when(F.col("y") == 0, F.col(n))
            cols += [F.percentile_approx(n, q, 10000).alias(f"{n}_all"), F.percentile_approx(bad, q, 10000).alias(f"{n}_bad"), F.array(F.min(bad), F.max(bad), F.min(clean), F.max(clean)).alias(f"{n}_ends")]
        r = df.agg(*cols).first()
        return {n: sorted({x for k in ("all", "bad", "ends") for x in r[f"{n}_{k}"] or [] if x is not None}) for n in names}

    def counts(df: DataFrame, cuts: dict[str, list[float]]) -> dict[str, dict[int, tuple[int, int]]]:
        """Per feature and bin: positives and negatives."""
        binned = df.select("y", *[_below(n, cuts[n]).alias(n) for n in names])
        long = binned.select("y", F.explode(F.array(*[F.struct(F.lit(n).alias("f"), F.col(n).alias("b")) for n in names])).alias("x"))
        out: dict = {n: {} for n in names}
        for r in long.groupBy("x.f", "x.b").agg(F.sum("y").alias("p"), F.count("*").alias("n")).collect():  # one row a feature and bin
            out[r["f"]][r["b"]] = (r["p"], r["n"] - r["p"])
        return out

    def fits(c: Condition) -> Column:
        return F.col(c.feature) > c.threshold if c.op == ">" else F.col(c.feature) <= c.threshold

    def held_out(df: DataFrame, conditions: list[Condition]) -> list[tuple[int, int]]:
        """(positives, negatives) of each prefix of the conditions on the held-out rows."""
        cond, cols = F.lit(True), []
        for k, c in enumerate(conditions):
            cond = cond & fits(c)
            cols += [F.sum(F.when(cond, F.col("y")).otherwise(0)).alias(f"p{k}"), F.sum(F.when(cond, 1 - F.col("y")).otherwise(0)).alias(f"n{k}")]
        r = df.where("not fold").agg(*cols).first()
        return [(r[f"p{k}"] or 0, r[f"n{k}"] or 0) for k in range(len(conditions))]

    failed: set[tuple[str, str]] = set()  # (feature, side) of the first conditions that led to no rule
    first = None  # cuts and counts of all growing rows that are left
    while len(rules) < max_rules:
        grow, conditions = left.where("fold"), []
        while len(conditions) < max_conditions:
            if conditions or first is None:
                cuts = cuts_of(grow)
                found = cuts, counts(grow, cuts)
                first = found if not conditions else first
            else:
                found = first
            best = _best_condition(found[1], found[0], conditions, failed if not conditions else set())
            if best is None:
                break
            conditions.append(best[0])
            grow = grow.where(fits(best[0]))
            if best[2] == 0:
                break
        if not conditions:
            break
        scores = held_out(left, conditions)
        value = [(p - n) / (p + n) if p + n else -1.0 for p, n in scores]
        k = max(range(len(value)), key=lambda i: (value[i], -i))
        p, n = scores[k]
        if p < min_support or p < min_precision * (p + n):
            failed.add(conditions[0][:2])
            continue
        failed, first = set(), None
        rules.append(Rule(tuple(conditions[: k + 1]), p, n))
        cond = F.lit(True)
        for c in conditions[: k + 1]:
            cond = cond & fits(c)
        left = left.where(~cond)
    return rules


def _below(name: str, cuts: list[float]) -> Column:
    """How many cuts are below a feature's value: its bin."""
    values = F.array(*[F.lit(c) for c in cuts]).cast("array<double>")
    return F.size(F.filter(values, lambda c: c < F.col(name)))


def _best_condition(counts: dict, cuts: dict, taken: list[Condition], failed: set[tuple[str, str]]) -> tuple[Condition, int, int] | None:
    """The condition with the best FOIL gain over binned counts, with the positives and negatives that it keeps."""
    best = None
    for name, by_bin in counts.items():
        p_all, n_all = (sum(v[i] for v in by_bin.values()) for i in (0, 1))
        if not p_all or not n_all:
            continue
        p_low = n_low = 0
        for k, c in enumerate(cuts[name]):
            p, n = by_bin.get(k, (0, 0))
            p_low, n_low = p_low + p, n_low + n
            for op, p, n in (("<=", p_low, n_low), (">", p_all - p_low, n_all - n_low)):
                cond = Condition(name, op, c)
                if p == 0 or n == n_all or cond in taken or (name, op) in failed:
                    continue
                gain = p * (math.log2(p / (p + n)) - math.log2(p_all / (p_all + n_all)))
                if gain > 0 and (best is None or gain > best[0]):
                    best = (gain, cond, p, n)
    return best and best[1:]


def label_statistics(stats: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", quality: str = "quality") -> DataFrame:
    """Statistics of labelled rows that pass the base rule, with target and fold."""
    marks = labels.where(F.col(quality).isNotNull()).groupBy(F.col(id_col)).agg(F.max(F.when(F.col(quality) == 0, 1).otherwise(0)).alias("bad"))
    s = stats.where(~base_failed()).select(id_col, *BASE, *_STATS)
    return s.join(marks, id_col).withColumn("fold", F.pmod(F.xxhash64(id_col), F.lit(3)) < 2)


def judge(docs: DataFrame, labels: DataFrame, *, text: str = "text", id_col: str = "doc_id", keep: list[str] | None = None) -> tuple[DataFrame, list[Rule]]:
    """The documents (or their columns ``keep``) with statistics, base_failed, rule and kept; and the list learned."""
    columns = [c for c in (docs.columns if keep is None else keep) if c not in (*BASE, *_STATS, "base_failed", "rule", "kept")]
    stats = written(statistics(docs, text).select(*columns, *BASE, *_STATS), "quality-statistics")
    rules = learn_rules(label_statistics(stats, labels, id_col=id_col))
    out = stats.withColumn("base_failed", base_failed()).withColumn("rule", rejected_by(rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)), rules
