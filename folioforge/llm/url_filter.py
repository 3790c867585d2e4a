"""URL filters: a trie over reversed host labels and path segments, broadcast; the longest rule wins.

A rule is ``(verdict, host, path)``. It fits its host and all subdomains of it, if the url's path starts with
the rule's path. Of the rules that fit, the longest wins (by the length of host plus path; between equals the
longer host, then ``block`` before ``allow``). A url that no rule fits gets ``default``.

The trie holds one node per host label, read from the last label to the first; each node has its own trie of
path segments, in which the unfinished last segment of a rule is kept as a prefix. It is broadcast while the
rules' text is within ``max_broadcast_bytes``, which is checked; a larger rule table is joined instead, on the
suffixes of each host (as many as it has labels), and ``max_by`` keeps the longest fit.

Edge cases: a null url, or one without ``://``, has an empty host and path and gets the default; so does an empty
host. Duplicate rules count once. Extra columns of the input are passed through unchanged.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge.llm.common import lower_ascii


class UrlRule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def rank(self) -> tuple:
        return len(self.name), len(self.host), self.verdict == "block"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def build_trie(rules: Iterable[UrlRule]) -> dict:
    """{label: node}; under "" a node keeps the path trie of the rules that end at it."""
    trie: dict = {}
    for rule in rules:
        node = trie
        for label in reversed(rule.host.split(".")):
            node = node.setdefault(("host", label), {})
        *whole, last = rule.path.split("/")
        node = node.setdefault("paths", {})
        for segment in whole:
            node = node.setdefault(("segment", segment), {})
        ends = node.setdefault("ends", {})
        if last not in ends or ends[last].rank < rule.rank:
            ends[last] = rule
    return trie


def longest(trie: dict, host: str, path: str) -> UrlRule | None:
    """The winning rule of a url."""
    if not host:
        return None
    best, node = None, trie
    segments = path.split("/")
    for label in reversed(host.split(".")):
        node = node.get(("host", label))
        if node is None:
            break
        at = node.get("paths")
        for segment in segments:
            if at is None:
                break
            for prefix, rule in at.get("ends", {}).items():
                if segment.startswith(prefix) and (best is None or best.rank < rule.rank):
                    best = rule
            at = at.get(("segment", segment))
    return best


def with_extra(df: DataFrame, schema: dict[str, str]) -> T.StructType:
    """The frame's schema with (or over) these columns."""
    fields = [f for f in df.schema.fields if f.name not in schema]
    return T.StructType(fields + [T.StructField(k, T._parse_datatype_string(v)) for k, v in schema.items()])


def filter_urls(pages: DataFrame, rules: DataFrame | Iterable[UrlRule], *, url: str = "url", default: str = "allow", max_broadcast_bytes: int = 8 << 20) -> DataFrame:
    """The pages with host, path, rule and verdict.

    ``rules``: a list, or a table (verdict, host, path) of any size; its trie takes some ten times its text's bytes in
    each worker, so beyond ``max_broadcast_bytes`` of text the rules are joined. Columns of the input that carry one of the
    four names are replaced.
    """
    spark = pages.sparkSession
    pages = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame([tuple(r) for r in rules], "verdict string, host string, path string")
    rules = rules.select("verdict", lower_ascii(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path")).where("host <> ''").distinct()
    size = rules.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 64)).first()[0] or 0
    return _by_trie(pages, rules, default) if size <= max_broadcast_bytes else _by_join(pages, rules, default)


def _by_trie(pages: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    trie = pages.sparkSession.sparkContext.broadcast(build_trie(UrlRule(*r) for r in rules.collect()))

    def judge(batches):
        for batch in batches:
            found = [longest(trie.value, h, p) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            out = {n: batch.column(n) for n in batch.schema.names if n not in ("rule", "verdict")}
            out["rule"] = pa.array([r and r.name for r in found], pa.string())
            out["verdict"] = pa.array([r.verdict if r else default for r in found], pa.string())
            yield pa.RecordBatch.from_pydict(out)

    return pages.mapInArrow(judge, with_extra(pages.drop("rule", "verdict"), {"rule": "string", "verdict": "string"}))


def _by_join(pages: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """For rule tables beyond the broadcast bound. Equal urls are judged once.

    Each url is joined by the pairs of a suffix of its host and a prefix of its path as long as some rule's, so that a
    common suffix such as a top-level domain is split by paths and only rules that fit meet it.
    """
    urls = pages.select("host", "path").distinct().where("host <> ''")
    lengths = [r[0] for r in rules.select(F.length("path")).distinct().collect()]  # one integer for each length of a rule's path
    labels = F.split("host", r"\.")
    suffixes = urls.withColumn("suffix", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))))
    starts = F.transform(F.filter(F.array(*map(F.lit, sorted(lengths))), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    r = rules.select(F.col("host").alias("suffix"), F.col("path").alias("start"), F.col("verdict").alias("v"))
    fits = suffixes.withColumn("start", F.explode(starts)).join(r, ["suffix", "start"])
    name = F.concat("suffix", "start")
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length(name), F.length("suffix"), F.col("v") == "block", name.alias("rule"), F.col("v").alias("verdict"))).alias("best"))
    out = pages.drop("rule", "verdict").join(best, ["host", "path"], "left")
    return out.withColumns({"rule": F.col("best.rule"), "verdict": F.coalesce("best.verdict", F.lit(default))}).drop("best")
