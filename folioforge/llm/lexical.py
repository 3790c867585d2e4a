"""Ranked lexical search of all documents for a set of queries, with norm buckets as in LEMP.

A document is its impact vector: for each term of the queries the impact of the term's occurrences under length
normalisation (an integer of at most 10**6). A query is the vector of its terms' weights times their repeats, and the score
of a document is the product of the two. The highest products are wanted, so documents are ordered by the length (norm)
of their vectors and taken in buckets:

- Cauchy-Schwarz: a bucket whose longest vector times the query's norm stays below the query's threshold is skipped.
- Coordinate bounds: inside a bucket the query's terms, heaviest first, are split at the first place where what is left
  cannot reach the threshold, be it by Cauchy-Schwarz or by the bucket's largest impact of each term. Only documents with
  a term before the split are candidates; those whose part so far plus the bound of their own rest stays below it go.
- Survivors are scored in 64-bit integers. Bounds are in doubles and loosened by a millionth of a thousandth, so no
  document at the threshold is lost.

The threshold of a query is its k-th best score so far: first that of the longest vectors of the whole table, then, in
each task, that of the task. Equal scores go by id, so only documents strictly below it are pruned.

Scale: documents are read once a block of queries and not shuffled: a task writes the impact vectors of its documents
and, as one row, its counts; counts are summed by term. The vectors are weighed and sorted inside their partitions by
Spark, which spills, and searched in buckets of ``bucket_rows``. Each task returns at most k rows a query. The queries
are a stated set, searched in blocks of about ``block_chars`` characters (a block's terms and weights are broadcast, its
counts and thresholds are as many numbers); between blocks results are written.

Edge cases: a null or empty text has no terms and is never found; queries without terms have no rows; queries that repeat
an id or a text are ranked each on its own; documents that repeat are ranked each; a null id comes first among equals;
very long texts are counted in slices; extra columns are left out of the result.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioforge.llm.common import dropped, written

#: Every ASCII sign that is no letter or digit is a blank, A-Z are a-z, bytes of other characters stay.
_FORM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

VECTORS = "doc_id long, n long, terms binary, counts binary, stats boolean"
_VECTOR_TYPES = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.binary()), ("counts", pa.binary()), ("stats", pa.bool_())])
IMPACTS = "doc_id long, norm double, terms binary, impacts binary"
_IMPACT_TYPES = pa.schema([("doc_id", pa.int64()), ("norm", pa.float64()), ("terms", pa.binary()), ("impacts", pa.binary())])
FOUND = "query long, doc_id long, score long"
_FOUND_TYPES = pa.schema([("query", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def terms_of(text: str, at_once: int = 1 << 22):
    """Lists of the terms of a text as bytes, a slice of the text each; a slice ends at a blank."""
    data, k = text.encode("utf-8", "surrogatepass").translate(_FORM), 0
    while k < len(data):
        end = data.find(b" ", k + at_once) if len(data) - k > at_once else -1
        end = len(data) if end < 0 else end
        yield data[k:end].split()
        k = end


class Queries:
    """A block of queries: its terms by number, and each query's terms with their repeats."""

    def __init__(self, texts: list[str]):
        counted = [Counter(t for part in terms_of(text or "") for t in part) for text in texts]
        self.words = sorted({t for c in counted for t in c})
        self.number = {t: i for i, t in enumerate(self.words)}
        self.terms = [np.array([self.number[t] for t in c], np.int64) for c in counted]
        self.repeats = [np.array(list(c.values()), np.int64) for c in counted]

    def weigh(self, n_docs: int, df: dict[int, int]) -> None:
        """Weights of the terms, the queries' coordinates heaviest first, and the norms of what is left after each."""
        w = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(self.words))], np.int64)
        for q, (terms, repeats) in enumerate(zip(self.terms, self.repeats, strict=True)):
            weight = repeats * w[terms]
            order = np.argsort(-weight, kind="stable")
            order = order[weight[order] > 0]
            self.terms[q], self.repeats[q] = terms[order], weight[order]
        self.left = [np.sqrt(np.append(np.cumsum((x.astype(np.float64) ** 2)[::-1])[::-1], 0.0)) for x in self.repeats]
        self.norms = np.array([x[0] for x in self.left])


class Bucket:
    """Impact vectors of documents of similar length, by term."""

    def __init__(self, doc_ids: np.ndarray, norms: np.ndarray, terms: np.ndarray, impacts: np.ndarray, sizes: np.ndarray, n_terms: int):
        self.doc_ids, self.norms, self.longest = doc_ids, norms, norms.max()
        order = np.argsort(terms, kind="stable")
        self.doc = np.repeat(np.arange(len(sizes)), sizes)[order]
        self.impact = impacts[order].astype(np.int64)
        self.start = np.searchsorted(terms[order], np.arange(n_terms + 1))
        self.most = np.zeros(n_terms)
        there = np.flatnonzero(np.diff(self.start))
        if len(there):
            self.most[there] = np.maximum.reduceat(self.impact, self.start[there])

    def search(self, terms: np.ndarray, weights: np.ndarray, left: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of all documents that score at least ``threshold`` and above 0."""
        loose = 1 + 1e-9
        by_term = np.append(np.cumsum((weights * self.most[terms])[::-1])[::-1], 0.0)
        bound = np.minimum(left * self.longest, by_term) * loose
        if bound[0] < threshold:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        split = int(np.argmax(bound < max(threshold, 1)))  # the last bound is 0
        score, square = np.zeros(len(self.norms), np.int64), np.zeros(len(self.norms))
        for t, w in zip(terms[:split], weights[:split], strict=True):
            at = slice(self.start[t], self.start[t + 1])
            score[self.doc[at]] += w * self.impact[at]
            square[self.doc[at]] += self.impact[at].astype(np.float64) ** 2
        rest = np.minimum(left[split] * np.sqrt(np.maximum(self.norms**2 * loose - square, 0.0)), by_term[split]) * loose
        alive = (score > 0) & (score + rest >= threshold)
        for t, w in zip(terms[split:], weights[split:], strict=True) if alive.any() else ():
            at = slice(self.start[t], self.start[t + 1])
            hit = alive[self.doc[at]]
            score[self.doc[at][hit]] += w * self.impact[at][hit]
        rows = np.flatnonzero(alive & (score >= max(threshold, 1)))
        return rows, score[rows]


def _vectors(docs: DataFrame, queries) -> DataFrame:
    """The vectors (term numbers and counts) of documents with terms of the queries, and the counts of each task."""

    def count(batches):
        number = queries.value.number
        df, n_docs, n_terms = np.zeros(len(number), np.int64), 0, 0
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n, found = 0, []
                for part in terms_of(text.as_py()):
                    n += len(part)
                    found += [i for i in map(number.get, part) if i is not None]
                n_docs, n_terms = n_docs + (n > 0), n_terms + n
                if found:
                    terms, counts = np.unique(np.array(found, "<i4"), return_counts=True)
                    df[terms] += 1
                    rows.append((doc_id, n, terms.tobytes(), counts.astype("<i4").tobytes(), False))
            yield _batch(rows, _VECTOR_TYPES)
        seen = np.flatnonzero(df)
        yield _batch([(n_docs, n_terms, seen.astype("<i4").tobytes(), df[seen].astype("<i8").tobytes(), True)], _VECTOR_TYPES)

    return written(docs.mapInArrow(count, VECTORS), "vectors", "stats")


def _batch(rows: list[tuple], types: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], f.type) for f in types], schema=types)


def _counts(vectors: DataFrame) -> tuple[int, int, dict[int, int]]:
    """Documents with terms, all terms, and the documents of each term of the block."""

    def apart(batches):
        types = pa.schema([("term", pa.int32()), ("df", pa.int64())])
        for batch in batches:
            for t, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(t, "<i4")), pa.array(np.frombuffer(c, "<i8"))], schema=types)

    stats = vectors.where("stats")
    total = stats.agg(F.sum("doc_id").alias("d"), F.sum("n").alias("t")).first()
    df = stats.select("terms", "counts").mapInArrow(apart, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    return total["d"] or 0, total["t"] or 0, {r["term"]: r["df"] for r in df}


def _impacts(vectors: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """Impact vectors, longest first inside each partition."""

    def weigh(batches):
        for batch in batches:
            rows = []
            for doc_id, n, terms, counts in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                tf, m = np.frombuffer(counts, "<i4").astype(np.int64), 100 - 75 + (75 * n * n_docs) // n_terms
                impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m)
                rows.append((doc_id, float(np.sqrt((impact.astype(np.float64) ** 2).sum())), terms, impact.astype("<i4").tobytes()))
            yield _batch(rows, _IMPACT_TYPES)

    out = vectors.where("not stats").select("doc_id", "n", "terms", "counts").mapInArrow(weigh, IMPACTS)
    return written(out.sortWithinPartitions(F.desc("norm")), "impacts")


def _searched(impacts: DataFrame, queries, thresholds, k: int, bucket_rows: int) -> DataFrame:
    """At most k documents a query and task that may be among the k best: (query, doc_id, score)."""

    def search(batches):
        block, least = queries.value, np.array(thresholds, np.int64)
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for x in range(0, len(batch), bucket_rows):
                part = batch.slice(x, bucket_rows)
                terms = [np.frombuffer(v, "<i4") for v in part.column(2).to_pylist()]
                impacts_ = [np.frombuffer(v, "<i4") for v in part.column(3).to_pylist()]
                ids = part.column(0).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
                bucket = Bucket(ids, part.column(1).to_numpy(), np.concatenate(terms), np.concatenate(impacts_), np.array([len(t) for t in terms]), len(block.words))
                for q in np.flatnonzero((block.norms * bucket.longest * (1 + 1e-9) >= least) & (block.norms > 0)):
                    rows, scores = bucket.search(block.terms[q], block.repeats[q], block.left[q], least[q])
                    if not len(rows):
                        continue
                    ids, old = bucket.doc_ids[rows], best.get(q, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                    ids, scores = np.append(old[0], ids), np.append(old[1], scores)
                    order = np.lexsort((ids, -scores))[:k]
                    best[q] = ids[order], scores[order]
                    if len(order) == k:
                        least[q] = max(least[q], scores[order[-1]])
        rows = [(q, None if d == -(1 << 63) else d, s) for q, found in best.items() for d, s in zip(*(v.tolist() for v in found), strict=True)]
        yield _batch(rows, _FOUND_TYPES)

    return impacts.mapInArrow(search, FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query; first inside shares of the rows, so that no task gets all rows of a query."""
    order = [F.desc("score"), F.asc("doc_id")]
    share = found.withColumn("share", F.pmod(F.xxhash64("doc_id"), F.lit(256)))
    first = share.withColumn("rank", F.row_number().over(Window.partitionBy("query", "share").orderBy(*order))).where(F.col("rank") <= k)
    return first.drop("share").withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)


def rank_documents(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = 10, bucket_rows: int = 4096, lead: float = 0.02, block_chars: int = 1 << 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 for each item.

    ``lead`` is the share of the documents, those of the longest vectors, that set the first thresholds.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    asked = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    total = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks, out = max(1, -(-total // block_chars)), None
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        queries = Queries([r["text"] for r in part])
        words = spark.sparkContext.broadcast(queries)
        vectors = _vectors(rows, words)
        n_docs, n_terms, df = _counts(vectors)
        queries.weigh(n_docs, df)
        weighed = spark.sparkContext.broadcast(queries)
        impacts = _impacts(vectors, n_docs, max(n_terms, 1))
        dropped(vectors)
        cutoff = impacts.agg(F.percentile_approx("norm", 1 - lead, 1000)).first()[0] or 0.0
        leaders = written(_ranked(_searched(impacts.where(F.col("norm") >= cutoff), weighed, [0] * len(part), k, bucket_rows), k).drop("rank"), "leaders")
        thresholds = [0] * len(part)
        for r in leaders.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == k).collect():
            thresholds[r["query"]] = r["least"]
        rest = _searched(impacts.where(F.col("norm") < cutoff), weighed, thresholds, k, bucket_rows)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(part)], "query long, item_id long")
        found = _ranked(leaders.unionByName(rest), k).join(names, "query").select("item_id", "rank", "doc_id", "score")
        if blocks > 1:
            found = written(found, "ranked")
            dropped(impacts)
            words.unpersist()
            weighed.unpersist()
        out = found if out is None else out.unionByName(found)
    return out
