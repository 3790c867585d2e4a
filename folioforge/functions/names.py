"""File names of takes, and strings of index ranges."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from folioforge.functions.text import file_name_form


def leading_tags(name: Column) -> Column:
    """The consecutive ``[tag]`` at the start, without brackets."""
    head = F.regexp_extract(name, r"^\s*((?:\[[^\[\]\s]+\]\s*)+)", 1)
    return F.regexp_extract_all(head, F.lit(r"\[([^\[\]\s]+)\]"), F.lit(1))


def take_fields(name: Column, models: list[str]) -> Column:
    """struct<index (from 0), hash, model, voice, errors> of a take's file name; null if it is none.

    Tags: index from 1, hash of 16 hex digits, model of the registry (else empty), voice, then the error count if its
    tag holds digits only (else -1: unknown).
    """
    t = leading_tags(name)
    index, digest = F.get(t, F.lit(0)), F.get(t, F.lit(1))
    model, voice, errors = F.coalesce(F.get(t, F.lit(2)), F.lit("")), F.coalesce(F.get(t, F.lit(3)), F.lit("")), F.coalesce(F.get(t, F.lit(4)), F.lit(""))
    good = F.rlike(index, F.lit(r"^\d{1,9}$")) & is_digest(digest)
    number = F.try_to_number(index, F.lit("999999999")).cast("int")
    return F.when(
        good & (number >= 1),
        F.struct(
            (number - 1).alias("index"), digest.alias("hash"), F.when(model.isin(models), model).otherwise("").alias("model"), voice.alias("voice"),
            F.when(F.rlike(errors, F.lit(r"^\d{1,9}$")), F.try_to_number(errors, F.lit("999999999")).cast("int")).otherwise(-1).alias("errors"),
        ),
    )


def take_name(index: Column, digest: Column, model: Column, voice: Column, errors: Column, text: Column) -> Column:
    """The file name of a take; an error count of 0 has no tag."""
    return F.concat(
        F.lit("["), F.format_string("%05d", (index + 1).cast("long")), F.lit("] ["), digest, F.lit("] ["), model, F.lit("] ["), voice, F.lit("] "),
        F.when(errors > 0, F.concat(F.lit("["), errors.cast("string"), F.lit("] "))).otherwise(""), file_name_form(text), F.lit(".flac"),
    )


def parse_ranges(requests: DataFrame, key: str, value: str, size: str) -> DataFrame:
    """(key, index) of range strings like ``1, 3-5, 7-`` against ``size`` items; 1-based text, 0-based result.

    Empty, ``all`` and ``a`` mean everything, ``none`` nothing; ends beyond the size are clamped, bad tokens skipped.
    """
    r = requests.select(key, F.lower(F.trim(F.coalesce(F.col(value), F.lit("")))).alias("v"), F.col(size).cast("int").alias("n"))
    r = r.withColumn("v", F.when(F.col("v").isin("", "all", "a"), "1-").when(F.col("v") == "none", "x").otherwise(F.col("v")))
    tokens = r.select(key, "n", F.explode(F.split("v", ",")).alias("token")).withColumn("token", F.trim("token")).where(F.rlike("token", F.lit(r"^\d{1,9}(-\d{0,9})?$")))
    lo = F.regexp_extract("token", r"^(\d+)", 1).cast("int")
    end = F.regexp_extract("token", r"-(\d+)$", 1)
    hi = F.when(end != "", F.least(F.expr("try_cast(regexp_extract(token, '-([0-9]+)$', 1) as int)"), F.col("n"))).when(F.col("token").endswith("-"), F.col("n")).otherwise(lo)
    t = tokens.select(key, "n", lo.alias("lo"), hi.alias("hi")).where("lo >= 1 and lo <= n and hi >= lo")
    return t.select(key, F.explode(F.sequence(F.col("lo") - 1, F.least("hi", "n") - 1)).alias("index")).distinct()


def range_warnings(value: Column, size: Column) -> Column:
    """array<string>: what a strict reading of a range string finds wrong in its tokens."""
    tokens = F.transform(F.split(F.lower(F.trim(value)), ","), lambda x: F.trim(x))
    lo, hi = (lambda t: F.regexp_extract(t, r"^(\d+)", 1).try_cast("bigint")), (lambda t: F.regexp_extract(t, r"-(\d+)$", 1).try_cast("bigint"))
    bad = lambda t: ~F.rlike(t, F.lit(r"^\d{1,9}(-\d{0,9})?$")) | F.coalesce(hi(t) < lo(t), F.lit(False))
    outside = lambda t: (lo(t) < 1) | (lo(t) > size)
    one = lambda t: F.when(bad(t), F.concat(F.lit("Bad value: "), t)).when(outside(t), F.concat(F.lit("Out of range: "), t))
    return F.when(F.lower(F.trim(value)).isin("", "all", "a", "none"), F.array().cast("array<string>")).otherwise(F.filter(F.transform(tokens, one), lambda x: x.isNotNull()))


def single_range(value: Column, size: Column) -> Column:
    """struct<first, last> (from 0) of ``x-y``, ``x-``, ``x`` (to the end) or ``all``; null for anything else."""
    v = F.lower(F.trim(value))
    lo, hi = F.regexp_extract(v, r"^(\d{1,9})", 1).try_cast("int"), F.regexp_extract(v, r"-\s*(\d{1,9})$", 1).try_cast("int")
    last = F.least(F.coalesce(hi, size), size) - 1
    good = F.rlike(v, F.lit(r"^\d{1,9}(\s*-\s*\d{0,9})?$")) & (lo >= 1) & (lo - 1 <= last)
    return F.when(v.isin("", "all", "a"), F.struct(F.lit(0).alias("first"), (size - 1).alias("last"))).when(good, F.struct((lo - 1).alias("first"), last.alias("last")))


def compact_ranges(indices: DataFrame, key: str, index: str = "index", sizes: DataFrame | None = None, size: str = "size") -> DataFrame:
    """(key, ranges): the distinct 0-based indices of a key as ``1, 3-5`` (1-based).

    With sizes (key, size) every key has a row: ``all`` where all indices are there, ``none`` where no index is.
    """
    d = indices.select(key, F.col(index).alias("i")).distinct()
    runs = d.withColumn("run", F.col("i") - F.row_number().over(Window.partitionBy(key).orderBy("i"))).groupBy(key, "run").agg(F.min("i").alias("lo"), F.max("i").alias("hi"))
    text = F.concat((F.col("lo") + 1).cast("string"), F.when(F.col("hi") > F.col("lo"), F.concat(F.lit("-"), (F.col("hi") + 1).cast("string"))).otherwise(""))
    out = runs.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lo", text.alias("t")))), lambda x: x["t"]), ", ").alias("ranges"), F.sum(F.col("hi") - F.col("lo") + 1).alias("__n"))
    if sizes is None:
        return out.drop("__n")
    named = F.when(F.col("__n").isNull(), "none").when(F.col("__n") == F.col(size), "all").otherwise(F.col("ranges"))
    return sizes.select(key, size).join(out, key, "left").select(key, named.alias("ranges"))


def is_digest(c: Column) -> Column:
    """Sixteen hexadecimal digits."""
    return F.rlike(c, F.lit(r"^[0-9a-fA-F]{16}$"))


def voice_tag(file: Column, model: str) -> Column:
    """The tag of a voice's file: its name without folder, ending and the model's tag, 30 signs of it; ``none`` without a file."""
    stem = F.regexp_replace(F.regexp_extract(file, r"([^/\\\\]*)$", 1), r"\.[^.]*$", "")
    return F.when(F.coalesce(file, F.lit("")) == "", "none").otherwise(file_name_form(F.regexp_replace(stem, f"_{model}$", ""), 30))


@F.pandas_udf(StringType())
def content_hash(index: pd.Series, text: pd.Series) -> pd.Series:
    """The digest in a take's name: XXH3 of 64 bits over the index and the text (Spark has XXH64 only)."""
    import xxhash

    return pd.Series([None if t is None else xxhash.xxh3_64_hexdigest(f"{i} {t}") for i, t in zip(index, text, strict=True)])
