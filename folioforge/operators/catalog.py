"""The catalog of generated takes: thresholds, failures, the best take of a line, tags in use, status of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rank of an unknown error count, and a score that always failed.
UNKNOWN_RANK, INVALID_SCORE = 9999, 99


def threshold(n_words: Column, strictness: Column) -> Column:
    """Word errors that a line of so many words may have."""
    tenth = F.ceil(n_words / 10)
    return F.when(strictness == "low", tenth + 1).when(strictness == "moderate", tenth).when(strictness == "high", F.greatest(tenth - 1, F.lit(0))).otherwise(0).cast("int")


def failed(errors: Column, n_words: Column, strictness: Column) -> Column:
    """An unknown count (-1) has not failed; the invalid score has; else errors beyond the threshold have."""
    return F.when(errors == -1, False).when(errors == INVALID_SCORE, True).otherwise(errors > threshold(n_words, strictness))


def too_long(duration: Column, n_words: Column, has_long_number: Column) -> Column:
    """Longer than 1.5 s plus 0.75 s a word; not judged if a word has three digits or more."""
    return ~has_long_number & (duration > 1.5 + 0.75 * n_words)


def has_long_number(words: Column) -> Column:
    """Whether a word has three digits or more: its spoken form is long."""
    return F.exists(words, lambda w: F.length(F.regexp_replace(w, r"[^\p{Nd}]", "")) >= 3)


def rank_takes(takes: DataFrame, index: str, errors: str, name: str) -> DataFrame:
    """Adds take_rank: 1 is the line's best take. Unknown counts rank as 9999; equals go by name."""
    score = F.when(F.col(errors) == -1, UNKNOWN_RANK).otherwise(F.col(errors))
    return takes.withColumn("take_rank", F.row_number().over(Window.partitionBy(index).orderBy(score, name)))


def best_takes(takes: DataFrame, index: str, errors: str, name: str) -> DataFrame:
    """One row a line, by a grouped minimum (partial before the shuffle; no sort). Ranks of 10000 and more are never chosen."""
    score = F.when(F.col(errors) == -1, UNKNOWN_RANK).otherwise(F.col(errors))
    best = takes.where(score < UNKNOWN_RANK + 1).groupBy(index).agg(F.min(F.struct(score.alias("score"), F.col(name).alias("name"), F.col(errors).alias("errors"))).alias("b"))
    return best.select(index, F.col("b.name").alias(name), F.col("b.errors").alias(errors))


def common_tag(takes: DataFrame, key: str, tag: str) -> DataFrame:
    """(key, tag): the tag that all takes share, else empty."""
    return takes.groupBy(key).agg(F.when((F.min(tag) == F.max(tag)) & (F.count(tag) == F.count("*")), F.min(tag)).otherwise("").alias(tag))


def mode_of_tags(takes: DataFrame, key: str, tag: str) -> DataFrame:
    """(key, tag, others): the most frequent tag (then the first by name), and how many others there are.

    Takes without a tag don't count; ``none`` does only where there is no other; empty without any.
    """
    named = F.when((F.col(tag) != "") & (F.col(tag) != "none"), F.col(tag))
    n = takes.groupBy(key, named.alias("__t")).agg(F.count("*").alias("n"), F.max((F.col(tag) == "none").cast("int")).alias("__none"))
    top = n.groupBy(key).agg(F.min(F.when(F.col("__t").isNotNull(), F.struct((-F.col("n")).alias("n"), F.col("__t").alias("t")))).alias("top"), F.count("__t").alias("named"), F.max("__none").alias("__none"))
    return top.select(key, F.coalesce("top.t", F.when(F.col("__none") == 1, "none").otherwise("")).alias(tag), F.greatest(F.col("named") - 1, F.lit(0)).alias("others"))


def score_failed(score: Column, most: Column) -> Column:
    """Whether the score in a take's name says failed: the invalid one, or more than the threshold."""
    return (score == INVALID_SCORE) | (score > most)


def last_errors(takes: DataFrame, index: str, order: str, errors: str) -> DataFrame:
    """(index, errors, n_takes): the error count of each line's last take."""
    return takes.groupBy(index).agg(F.max_by(errors, order).alias(errors), F.count("*").alias("n_takes"))


def selection_sets(lines: DataFrame, takes: DataFrame, key: str, index: str, selected: str) -> DataFrame:
    """(key, n_selected_done, n_selected_left, n_other_done) of lines by selection and takes."""
    s = lines.join(takes.select(key, index).distinct().withColumn("__t", F.lit(True)), [key, index], "left")
    done = F.col("__t").isNotNull()
    return s.groupBy(key).agg(F.count_if(F.col(selected) & done).alias("n_selected_done"), F.count_if(F.col(selected) & ~done).alias("n_selected_left"), F.count_if(~F.col(selected) & done).alias("n_other_done"))


def line_classes(lines: DataFrame, takes: DataFrame, index: str, errors: str, n_words: str, strictness: str) -> DataFrame:
    """Lines with the classes that they are in: generated, ungenerated, with_errors, failed (each a column), and n_takes.

    With errors: its best take has some; failed: any of its takes has more than the line's words allow.
    """
    s = line_status(lines, takes, index, errors, n_words, strictness)
    least = takes.groupBy(index).agg(F.min(F.when(F.col(errors) >= 0, F.col(errors))).alias("__least"))
    s = s.join(least, index, "left")
    done = F.col("n_takes") > 0
    return s.withColumns({"generated": done, "ungenerated": ~done, "with_errors": done & F.coalesce(F.col("__least") > 0, F.lit(False)), "failed": done & (F.col("status") == "failed")}).drop("__least", "status")


def visible_lines(classes: DataFrame, kind: str, book: str, section: str) -> tuple[DataFrame, DataFrame]:
    """The lines of a filter (``all`` or a class) and the headings of the sections that show some: (book, section, n_visible)."""
    shown = classes if kind == "all" else classes.where(F.col(kind))
    return shown, shown.groupBy(book, section).agg(F.count("*").alias("n_visible"))


def known_tags(models: DataFrame, tag: str) -> DataFrame:
    """(tag): the tags that files of any model may have, once each."""
    return models.where(F.trim(tag) != "").select(F.trim(tag).alias("tag")).distinct()


def output_choice(outputs: DataFrame, choice: DataFrame, key: str) -> DataFrame:
    """(key, output, error) of outputs (key, output, n_exist) chosen by (key, value): numbers from 1, ``all`` or ``a``.

    ``all`` takes those with audio. A choice that has an item that is none, or an output without audio, has no outputs but
    an error that names them.
    """
    value = F.lower(F.trim("value"))
    c = choice.select(key, value.alias("__v"), value.isin("all", "a").alias("__all"))
    every = outputs.join(c.where("__all"), key).where("n_exist > 0").select(key, "output", F.lit(None).cast("string").alias("error"))
    token = c.where(~F.col("__all")).select(key, F.explode(F.split("__v", ",")).alias("t")).select(key, F.regexp_extract_all(F.trim("t"), F.lit(r"(\d+|-|\S)"), F.lit(1)).alias("p"), F.trim("t").alias("t"))
    first, last = F.get("p", F.lit(0)).try_cast("int"), F.element_at("p", -1).try_cast("int")
    good = F.rlike("t", F.lit(r"^\d+$|^\d+\s*-\s*\d+$"))
    n = outputs.groupBy(key).agg(F.max("output").alias("__n"))
    token = token.where("t <> ''").join(n, key).select(key, "t", (good & (first >= 1) & (last <= F.col("__n") + 1) & (first <= last)).alias("ok"), (first - 1).alias("a"), (last - 1).alias("b"))
    wanted = token.where("ok").select(key, F.explode(F.sequence("a", "b")).alias("output")).distinct().join(outputs, [key, "output"])
    bad = token.where("not ok").groupBy(key).agg(F.array_join(F.sort_array(F.collect_set("t")), ", ").alias("__bad"))
    silent = wanted.where("n_exist = 0").groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_set("output")), lambda x: (x + 1).cast("string")), ", ").alias("__silent"))
    verdict = c.where(~F.col("__all")).select(key).join(bad, key, "left").join(silent, key, "left")
    error = F.when(F.col("__bad").isNotNull(), F.concat(F.lit("no such output: "), "__bad")).when(F.col("__silent").isNotNull(), F.concat(F.lit("no audio: "), "__silent"))
    verdict = verdict.select(key, error.alias("error"))
    fine = wanted.join(verdict.where("error is null"), key).select(key, "output", "error")
    return every.unionByName(fine).unionByName(verdict.where("error is not null").select(key, F.lit(None).cast("int").alias("output"), "error"))


def missing_settings(settings: DataFrame, key: str, rules: list[tuple[str, Column, str]]) -> DataFrame:
    """(key, position, part, message): what keeps a project from starting, in the order of the rules (part, is in order, message)."""
    found = F.array_compact(F.array(*[F.when(~F.coalesce(good, F.lit(False)), F.struct(F.lit(part).alias("part"), F.lit(message).alias("message"))) for part, good, message in rules]))
    return settings.select(key, F.posexplode(found).alias("position", "x")).select(key, "position", "x.part", "x.message")


def voice_pairs(voices: Column, transcripts: Column) -> Column:
    """array<struct<voice, transcript>> by place; a voice without a transcript has an empty one."""
    return F.transform(voices, lambda v, i: F.struct(v.alias("voice"), F.coalesce(F.get(transcripts, i), F.lit("")).alias("transcript")))


def current_takes(takes: DataFrame, lines: DataFrame, index: str, digest: str) -> DataFrame:
    """Takes whose digest is that of the line's present text; stale ones drop out."""
    return takes.join(lines.select(index, digest), [index, digest], "left_semi")


def line_status(lines: DataFrame, takes: DataFrame, index: str, errors: str, n_words: str, strictness: str) -> DataFrame:
    """Lines with n_takes and status: missing, failed (any take failed), errors or good."""
    bad = failed(F.col(errors), F.col(n_words), F.lit(strictness))
    t = takes.join(lines.select(index, n_words), index).groupBy(index).agg(F.count("*").alias("n_takes"), F.max(bad).alias("any_failed"), F.min(F.when(F.col(errors) >= 0, F.col(errors))).alias("least"))
    status = F.when(F.col("n_takes").isNull(), "missing").when(F.col("any_failed"), "failed").when(F.col("least") > 0, "errors").otherwise("good")
    return lines.join(t, index, "left").withColumn("status", status).withColumn("n_takes", F.coalesce("n_takes", F.lit(0))).drop("any_failed", "least")


def attempt_summary(attempts: DataFrame, index: str, order: str, errors: str) -> DataFrame:
    """Adds improved: fewer errors than every attempt before (null at the first)."""
    w = Window.partitionBy(index).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return attempts.withColumn("improved", F.col(errors) < F.min(errors).over(w))
