"""JSON contracts of books, player metadata and sidecars: strict and lenient readers, upgrades of older formats, writers.

Documents are parsed once into a variant; each rule is a column on it. A strict reader gives a null value and the code of
the first rule that fails; a lenient one leaves out what is wrong.
"""

from __future__ import annotations

import zlib
from base64 import urlsafe_b64decode

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from folioforge.functions.text import let
from folioforge.operators.segmentation import REASONS, STRATEGIES

#: Names in the formats, versions and reasons for which a clip is invalid.
SIDECAR_TYPE, SIDECAR_VERSION, METADATA_VERSION = "segment_stt_info", 3, 3
INVALID_REASONS = ("music_detected", "excessive_sound_duration")
BOOK_FORMATS, GROUPS_FORMAT = ("book.v2", "book.v1"), "phrase_groups.v1"


def get(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def kind(v: Column) -> Column:
    """null (missing), VOID, BOOLEAN, STRING, BIGINT, DECIMAL, DOUBLE, ARRAY or OBJECT."""
    return F.regexp_extract(F.schema_of_variant(v), r"^[A-Z]+", 0)


def is_kind(v: Column, *kinds: str) -> Column:
    return F.coalesce(kind(v).isin(*kinds), F.lit(False))


def missing_or(v: Column, *kinds: str) -> Column:
    return v.isNull() | is_kind(v, *kinds)


def items(v: Column, path: str = "$") -> Column:
    """The items of a list as array<variant>; null if it is no list."""
    return get(v, path, "array<variant>")


def text_or_empty(v: Column, path: str) -> Column:
    return F.when(is_kind(get(v, path), "STRING"), get(v, path, "string")).otherwise("")


def whole_number(v: Column) -> Column:
    """What counts as an integer: numbers (cut), booleans, strings of digits; else null."""
    text = F.trim(get(v, "$", "string"))
    return F.when(is_kind(v, "BIGINT", "DECIMAL", "DOUBLE"), get(v, "$", "double").cast("long")).when(is_kind(v, "BOOLEAN"), get(v, "$", "boolean").cast("long")).when(is_kind(v, "STRING") & F.rlike(text, F.lit(r"^[+-]?\d{1,18}$")), text.try_cast("long"))


SECTION = "struct<title:string,start_index:bigint,end_index:bigint>"
PHRASE = "struct<text:string,time_start:double,time_end:double>"


def section(v: Column) -> Column:
    return F.struct(get(v, "$.title", "string").alias("title"), get(v, "$.start_index", "bigint").alias("start_index"), get(v, "$.end_index", "bigint").alias("end_index"))


def section_is_valid(v: Column) -> Column:
    """A strict section: a title, whole numbers, and 0 <= start <= end."""
    s = section(v)
    return is_kind(get(v, "$.title"), "STRING") & is_kind(get(v, "$.start_index"), "BIGINT") & is_kind(get(v, "$.end_index"), "BIGINT") & F.coalesce((s["start_index"] >= 0) & (s["end_index"] >= s["start_index"]), F.lit(False))


def timed_phrase(v: Column) -> Column:
    return F.struct(get(v, "$.text", "string").alias("text"), get(v, "$.time_start", "double").alias("time_start"), get(v, "$.time_end", "double").alias("time_end"))


def timed_phrase_is_valid(v: Column) -> Column:
    return is_kind(v, "OBJECT") & get(v, "$.text").isNotNull() & get(v, "$.time_start").isNotNull() & get(v, "$.time_end").isNotNull()


def metadata_error(v: Column) -> Column:
    """The first rule that a strict reader of metadata finds broken, or null."""
    version = get(v, "$.version")
    broken = lambda found, ok: F.exists(found, lambda x: ~ok(x))
    return (
        F.when(v.isNull(), "json").when(~is_kind(v, "OBJECT"), "root").when(get(v, "$.text_segments").isNull(), "segments missing").when(~missing_or(get(v, "$.title"), "STRING"), "title")
        .when(~(version.isNull() | (is_kind(version, "BIGINT") & (get(v, "$.version", "bigint") >= 1))), "version")
        .when(items(v, "$.text_segments").isNull(), "segments").when(F.size(items(v, "$.text_segments")) == 0, "segments empty")
        .when(broken(items(v, "$.text_segments"), timed_phrase_is_valid), "segment")
        .when(~missing_or(get(v, "$.bookmarks"), "ARRAY"), "bookmarks").when(broken(items(v, "$.bookmarks"), lambda x: whole_number(x).isNotNull()), "bookmark")
        .when(~missing_or(get(v, "$.project_snapshot"), "OBJECT"), "snapshot").when(~missing_or(get(v, "$.sections"), "ARRAY"), "sections")
        .when(broken(items(v, "$.sections"), section_is_valid), "section")
    )


def metadata(v: Column, strict: bool = True) -> Column:
    """struct<title, version, bookmarks, segments, has_break_audio, sections> of parsed metadata.

    Strict: null where ``metadata_error`` isn't. Lenient: null without segments; bad bookmarks and sections, and sections
    that end after the last segment, are left out, other bad values have their defaults.
    """
    segments = items(v, "$.text_segments")
    sections, marks = F.coalesce(items(v, "$.sections"), F.array().cast("array<variant>")), F.coalesce(items(v, "$.bookmarks"), F.array().cast("array<variant>"))
    version = F.when(is_kind(get(v, "$.version"), "BIGINT") & (get(v, "$.version", "bigint") >= 1), get(v, "$.version", "bigint")).otherwise(F.lit(1).cast("long"))
    if strict:
        sections, fits = F.transform(sections, section), metadata_error(v).isNull()
        break_audio = F.coalesce(get(v, "$.has_section_break_audio", "boolean"), F.lit(False))
    else:
        number = lambda x, p: whole_number(get(x, p))
        loose = lambda x: F.struct(text_or_empty(x, "$.title").alias("title"), number(x, "$.start_index").alias("start_index"), number(x, "$.end_index").alias("end_index"))
        good = lambda s: F.coalesce((s["start_index"] >= 0) & (s["end_index"] >= s["start_index"]) & (s["end_index"] <= F.size(segments)), F.lit(False))
        sections = F.filter(F.transform(F.filter(sections, lambda x: is_kind(x, "OBJECT")), loose), good)
        fits = is_kind(v, "OBJECT") & F.coalesce(F.size(segments) > 0, F.lit(False))
        break_audio = F.coalesce(is_kind(get(v, "$.has_section_break_audio"), "BOOLEAN") & get(v, "$.has_section_break_audio", "boolean"), F.lit(False))
    bookmarks = F.filter(F.transform(marks, whole_number), lambda x: x.isNotNull())
    return F.when(fits, F.struct(text_or_empty(v, "$.title").alias("title"), version.alias("version"), bookmarks.alias("bookmarks"), F.transform(segments, timed_phrase).alias("segments"), break_audio.alias("has_break_audio"), sections.cast(f"array<{SECTION}>").alias("sections")))


def metadata_json(m: Column) -> Column:
    """Metadata as JSON: bookmarks sorted and once each."""
    fields = [
        m["title"].alias("title"), m["version"].alias("version"), F.array_sort(F.array_distinct(m["bookmarks"])).alias("bookmarks"), m["segments"].alias("text_segments"),
        F.coalesce(m["has_break_audio"], F.lit(False)).alias("has_section_break_audio"), m["sections"].alias("sections"),
    ]
    return F.when(m.isNotNull(), F.to_json(F.struct(*fields)))


@F.pandas_udf(StringType())
def inflated(c: pd.Series) -> pd.Series:
    """Text that is deflated and in URL-safe base64; empty if it is not."""

    def one(t: str | None) -> str:
        try:
            return zlib.decompress(urlsafe_b64decode((t or "").replace("+", "-").replace("/", "_") + "===")).decode()
        except (ValueError, zlib.error):
            return ""

    return c.map(one)


# ---------------------------------------------------------------- books


def _phrases(g: Column) -> Column:
    """The phrases of a group, which is an object or a bare list."""
    return F.coalesce(items(g, "$.phrases"), items(g))


def _groups_error(found: Column) -> Column:
    # kinds are looked at only where there are no phrases; only an object has a text
    lacking = lambda g: F.when(is_kind(g, "OBJECT") & get(g, "$.phrases").isNull(), "group without phrases").otherwise("phrases")
    wrong = lambda g, phrases: F.when(phrases.isNull(), lacking(g)).when(F.size(phrases) == 0, "group empty").when(F.exists(phrases, lambda p: get(p, "$.text").isNull()), "phrase")
    bad = lambda g: let(_phrases(g), lambda phrases: wrong(g, phrases))
    return F.get(F.filter(F.transform(found, bad), lambda x: x.isNotNull()), F.lit(0))


def _groups(found: Column) -> Column:
    reason = lambda p: F.when(get(p, "$.reason", "string").isin(*REASONS), get(p, "$.reason", "string")).otherwise("undefined")
    voice = lambda g: F.when(get(g, "$.voice_index").isNull(), -1).when(is_kind(get(g, "$.voice_index"), "BIGINT") & (get(g, "$.voice_index", "int") >= -1), get(g, "$.voice_index", "int")).otherwise(-1)
    phrases = lambda g: F.transform(_phrases(g), lambda p: F.struct(get(p, "$.text", "string").alias("text"), reason(p).alias("reason")))
    return F.transform(found, lambda g: F.struct(voice(g).alias("voice_index"), phrases(g).alias("phrases")))


def _sections(v: Column) -> tuple[Column, Column]:
    """(array of struct<title, groups variant list>, the error of the root) for all four formats."""
    form = F.coalesce(get(v, "$.format", "string"), F.lit(GROUPS_FORMAT))
    is_book = is_kind(v, "OBJECT") & form.isin(*BOOK_FORMATS)
    flat = F.when(is_kind(v, "ARRAY"), items(v)).when(is_kind(v, "OBJECT") & ~is_book, items(v, "$.phrase_groups"))
    one = F.array(F.struct(F.lit("").alias("title"), flat.alias("groups")))
    many = F.transform(items(v, "$.book.sections"), lambda s: F.struct(text_or_empty(s, "$.title").alias("title"), items(s, "$.phrase_groups").alias("groups")))
    error = (
        F.when(v.isNull(), "json").when(is_book & get(v, "$.book").isNull(), "book missing").when(is_book & items(v, "$.book.sections").isNull(), "sections")
        .when(is_kind(v, "OBJECT") & ~is_book & get(v, "$.phrase_groups").isNull(), F.when(form == GROUPS_FORMAT, "groups missing").otherwise("format"))
        .when(~is_kind(v, "OBJECT", "ARRAY"), "root")
    )
    return F.when(is_book, many).otherwise(one), error


def book_error(v: Column) -> Column:
    """The first rule that a project's text breaks, or null: book, older book, wrapped groups or a bare list of groups."""
    sections, error = _sections(v)
    inside = F.transform(sections, lambda s: F.when(s["groups"].isNull(), "groups").otherwise(_groups_error(s["groups"])))
    return F.coalesce(error, F.get(F.filter(inside, lambda x: x.isNotNull()), F.lit(0)))


def book(v: Column) -> Column:
    """struct<title, text_source_kind, audio_source_kind, settings, sections> of a project's text; null if ``book_error`` isn't."""
    sections, _ = _sections(v)
    flat = ~(is_kind(v, "OBJECT") & F.coalesce(get(v, "$.format", "string").isin(*BOOK_FORMATS), F.lit(False)))
    s = lambda path: text_or_empty(v, "$.book." + path)
    at = "$.book.segmentation_settings."
    words = F.when(is_kind(get(v, at + "max_words_per_segment"), "BIGINT") & (get(v, at + "max_words_per_segment", "int") >= 0), get(v, at + "max_words_per_segment", "int")).otherwise(0)
    strategy = F.when(text_or_empty(v, at + "strategy").isin(*STRATEGIES), text_or_empty(v, at + "strategy")).otherwise("normal")
    dialog = F.coalesce(is_kind(get(v, at + "dialog_segmentation"), "BOOLEAN") & get(v, at + "dialog_segmentation", "boolean"), F.lit(False))
    settings = F.struct(text_or_empty(v, at + "language_code").alias("language_code"), words.alias("max_words_per_segment"), strategy.alias("strategy"), dialog.alias("dialog_segmentation"))
    return F.when(
        book_error(v).isNull(),
        F.struct(
            s("title").alias("title"), F.when(flat, "legacy_flat").otherwise(s("text_source_kind")).alias("text_source_kind"), F.when(flat, "unknown").otherwise(s("audio_source_kind")).alias("audio_source_kind"),
            settings.alias("segmentation_settings"), F.transform(sections, lambda x: F.struct(x["title"].alias("title"), _groups(x["groups"]).alias("phrase_groups"))).alias("sections"),
        ),
    )


def book_json(b: Column) -> Column:
    """A book in the present format."""
    return F.when(b.isNotNull(), F.to_json(F.struct(F.lit(BOOK_FORMATS[0]).alias("format"), b.alias("book"))))


# ---------------------------------------------------------------- sidecars


def sidecar_phrases(v: Column) -> Column:
    """The timed phrases of a sidecar whose root is a list or an object; null if one is bad."""
    found = F.when(is_kind(v, "ARRAY"), items(v)).otherwise(items(v, "$.timed_phrases"))
    return F.when(~F.exists(found, lambda x: ~timed_phrase_is_valid(x)), F.transform(found, timed_phrase))


def sidecar_error(v: Column) -> Column:
    """The first rule that a sidecar breaks, or null."""
    findings = F.coalesce(get(v, "$.findings"), get(v, "$.validation"))
    errors = items(findings, "$.transcript_errors")
    reason = get(findings, "$.invalid_reason")
    needed = ("language_code", "source", "prompt", "transcript", "normalized_source", "normalized_transcript")
    lacking = F.lit(False)
    for name in needed:
        lacking = lacking | get(v, f"$.{name}").isNull()
    return (
        F.when(v.isNull(), "json").when(~is_kind(v, "OBJECT"), "root").when(~F.coalesce(get(v, "$.type", "string") == SIDECAR_TYPE, F.lit(False)), "type").when(sidecar_phrases(v).isNull(), "timed_phrases")
        .when(~missing_or(get(v, "$.transcript_words"), "ARRAY"), "transcript_words").when(~missing_or(findings, "OBJECT"), "findings")
        .when(~missing_or(get(findings, "$.transcript_errors"), "ARRAY") | F.coalesce(F.exists(errors, lambda x: ~is_kind(x, "STRING")), F.lit(False)), "transcript_errors")
        .when(~(missing_or(reason, "VOID") | F.coalesce(get(findings, "$.invalid_reason", "string").isin(*INVALID_REASONS), F.lit(False))), "invalid_reason")
        .when(lacking | whole_number(get(v, "$.version")).isNull() | whole_number(get(v, "$.index_1b")).isNull(), "field")
    )


def sidecar_findings(v: Column, recomputed_errors: Column) -> Column:
    """struct<transcript_errors, possible_truncation, invalid_reason>; a sidecar without findings gets recomputed errors.

    There an unknown exception counts as music.
    """
    findings = F.coalesce(get(v, "$.findings"), get(v, "$.validation"))
    exception = get(v, "$.exception", "string")
    old = F.when(exception.isin(*INVALID_REASONS), exception).when(~missing_or(get(v, "$.exception"), "VOID"), INVALID_REASONS[0])
    truncated = lambda x: F.coalesce(get(x, "$.possible_truncation", "boolean"), F.lit(False)).alias("possible_truncation")
    new = F.struct(F.coalesce(F.transform(items(findings, "$.transcript_errors"), lambda x: get(x, "$", "string")), F.array().cast("array<string>")).alias("transcript_errors"), truncated(findings), get(findings, "$.invalid_reason", "string").alias("invalid_reason"))
    return F.when(findings.isNotNull(), new).otherwise(F.struct(recomputed_errors.alias("transcript_errors"), truncated(v), old.alias("invalid_reason")))


def sidecar_json(language: Column, index: Column, source: Column, transcript: Column, normalized_source: Column, normalized_transcript: Column, findings: Column, phrases: Column, words: Column) -> Column:
    """A sidecar in the present version; index counts from 0."""
    return F.to_json(F.struct(
        F.lit(SIDECAR_VERSION).alias("version"), F.lit(SIDECAR_TYPE).alias("type"), language.alias("language_code"), (index + 1).alias("index_1b"), source.alias("source"), source.alias("prompt"), transcript.alias("transcript"),
        normalized_source.alias("normalized_source"), normalized_transcript.alias("normalized_transcript"), findings.alias("findings"), phrases.alias("timed_phrases"), words.alias("transcript_words"),
    ), {"ignoreNullFields": "false"})


# ---------------------------------------------------------------- settings


def renamed(v: Column, name: str, old: str) -> Column:
    """A value by its name, or by the one it had before."""
    return F.coalesce(get(v, f"$.{name}"), get(v, f"$.{old}"))


def clamped(v: Column, least: int, most: int, default: int) -> Column:
    """A whole number within its limits; the default for anything else."""
    return F.when(is_kind(v, "BIGINT"), F.least(F.greatest(get(v, "$", "bigint"), F.lit(least)), F.lit(most))).otherwise(default)


def one_of(v: Column, allowed: list[str], default: str) -> Column:
    return F.when(is_kind(v, "STRING") & get(v, "$", "string").isin(*allowed), get(v, "$", "string")).otherwise(default)


def transferred(v: Column, fields: list[str]) -> Column:
    """The settings that move from one project to another, as map<string, variant>; missing ones are left out."""
    return F.map_filter(F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*[get(v, f"$.{f}") for f in fields])), lambda _, x: x.isNotNull())


# ---------------------------------------------------------------- identities and small values


def fnv1a(text: Column) -> Column:
    """FNV-1a of 32 bits over UTF-16 units, as hexadecimal without leading zeros."""
    units = let(F.encode(text, "UTF-16BE"), lambda b: F.transform(F.sequence(F.lit(1), F.octet_length(b), F.lit(2)), lambda i: F.conv(F.hex(F.substring(b, i, F.lit(2))), 16, 10).cast("long")))
    mixed = F.aggregate(units, F.lit(2166136261), lambda h, u: ((h.bitwiseXOR(u)) * 403 + F.shiftleft((h.bitwiseXOR(u)), 24)).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.lower(F.hex(F.when(F.length(text) > 0, mixed).otherwise(F.lit(2166136261))))


def stable_json(v: Column) -> Column:
    """JSON of a parsed document with keys in order, so that equal documents have equal text."""
    return F.to_json(v)


def emotion_vector(text: Column) -> Column:
    """Eight numbers from 0 to 1, separated by commas; null if there are others."""
    parts = F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("double"))
    return F.when((F.size(parts) == 8) & ~F.exists(parts, lambda x: x.isNull() | (x < 0) | (x > 1)), parts)


def substitutions(text: Column) -> Column:
    """map<string, string> of lines ``word = replacement``; null if a line is neither blank nor such a pair; a later pair wins."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.regexp_extract(x, r"^([^=]+)=(.+)$", 1)).alias("k"), F.trim(F.regexp_extract(x, r"^([^=]+)=(.+)$", 2)).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["k"] == p["k"]))
    return F.when(~F.exists(pairs, lambda p: (p["k"] == "") | (p["v"] == "")), F.map_from_entries(last))


def sse_delta(line: Column) -> Column:
    """The text that a line of a token stream adds, in either of two shapes of events; null for other lines and the end."""
    v = F.try_parse_json(F.when(line.startswith("data: ") & (F.trim(line) != "data: [DONE]"), F.substring(line, 7, 1 << 30)))
    block = F.when((get(v, "$.type", "string") == "content_block_delta") & (get(v, "$.delta.type", "string") == "text_delta"), get(v, "$.delta.text", "string"))
    return F.nullif(F.coalesce(get(v, "$.choices[0].delta.content", "string"), block), F.lit(""))
