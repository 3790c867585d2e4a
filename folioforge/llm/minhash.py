"""Near-duplicates by MinHash with tensored banding, confirmed on full shingle sets.

A document's set holds the distinct runs of ``SHINGLE`` words, A-Z lower-cased. Two documents are linked if the
Jaccard similarity of their sets is at least ``percent`` hundredths; components of links are the classes.

1. *Classes of equal word sequences* are one node, whatever their number; its id is the smallest document id.
2. *Tensored banding.* Two collections of ``side`` short keys are made, each key of ``rows`` minhashes; table (i, j)
   is keyed by the pair of key i of the first and key j of the second collection. ``side ** 2`` tables of
   ``2 * rows`` hashes each need only ``2 * side * rows`` minhashes. With side 10 and rows 2, 40 minhashes make 100
   tables of 4; a link of similarity 0.85 is in no common table with a probability of 2 (1 - 0.85**2)**10, 5 in a
   million, and more similar ones far less. Keys that only one node has are dropped before pairs are formed.
3. *Stars.* In each bucket every member is compared with one pivot, the member with the most company in all its
   buckets (in a group of copies that is the original); pairs within a bucket are not formed. Links are confirmed on
   the full sets.
4. *The rest, exactly.* Two members of a bucket are members of its pivot's star, so what is left are links between
   members of one star. If both are linked to the pivot they are in one component. Else, with D(x) the shingles that
   exactly one of x and the pivot p has, the sets' difference is ``|D(x)| + |D(y)| - 2 |D(x) & D(y)|``, and a linked
   pair must share a shingle of D; for sets closer to the pivot than to nothing these overlaps are counted by an
   inverted index of the D's. The others are searched by the prefix filter on their full sets, rarest shingles in the
   star first. Members linked to the pivot stay only if the triangle inequality lets an unlinked one reach them. A star
   gives a forest of links, not its pairs; one over ``star_shingles`` is split by a hash of the members into blocks,
   and each two blocks meet once, so a task holds two blocks at most.

Edge cases: null and blank texts have an empty set, no links and their own id; fewer than five words are one
shingle; a document id that occurs with several texts is one node; a null id is left out of groups (its component is
null); input columns beside id and text are passed over; an empty table gives an empty result.
Jobs run while the frame is built: signatures, classes, comparisons and rounds of components are written tables.
Memory: a batch of texts, or two blocks of a star; nothing is collected but counts. Joins with written tables are merged
by hint: their compressed files are small beside their rows, and by the files' size Spark would gather a million rows of
keys on the driver to broadcast them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import dropped, mix, written
from folioforge.llm.components import connected_components
from folioforge.llm.suffix_tree import word_symbols

SHINGLE = 5
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


class _Text(str):
    """A text that is encoded in lower case (A-Z only)."""

    __slots__ = ()

    def encode(self, *args) -> bytes:
        return str.encode(self, *args).translate(_LOWER)


def shingle_sets(texts: list[str]) -> tuple[list[np.ndarray], list[bytes]]:
    """(sorted distinct shingle hashes, digest of the word sequence) of each text."""
    w = word_symbols([_Text(t or "") for t in texts], list(range(len(texts))), SHINGLE)
    n = len(w.codes)
    grams = w.grams(0, n - SHINGLE + 1) if n >= SHINGLE else np.zeros(0, np.uint64)
    sets, digests = [], []
    for a, b in zip(w.starts.tolist(), w.ends.tolist(), strict=True):
        words = [w.data[x:y] for x, y in zip(w.lo[a:b].tolist(), w.hi[a:b].tolist(), strict=True)]
        joined = b" ".join(words)
        if b - a >= SHINGLE:
            s = np.unique(grams[a : b - SHINGLE + 1])
        else:
            s = np.array([int.from_bytes(hashlib.blake2b(joined, digest_size=8, person=b"short").digest(), "little")] if b > a else [], np.uint64)
        sets.append(s)
        digests.append(hashlib.blake2b(joined, digest_size=16).digest())
    return sets, digests


def minhash_keys(sets: list[np.ndarray], side: int, rows: int) -> list[list[int]]:
    """The 2 * side keys of each set (none of an empty one), as signed 64-bit numbers."""
    full = [s for s in sets if len(s)]
    if not full:
        return [[] for _ in sets]
    x = np.concatenate(full)
    start = np.append(0, np.cumsum([len(s) for s in full])[:-1])
    seeds = mix(np.arange(2 * side * rows, dtype=np.uint64), 3)
    factors = mix(np.arange(2 * side * rows, dtype=np.uint64), 4) | np.uint64(1)
    keys = np.empty((len(full), 2 * side), np.uint64)
    for k in range(2 * side):
        h = np.full(len(full), k, np.uint64)
        for r in range(rows):
            i = k * rows + r
            h = mix(h ^ np.minimum.reduceat((x ^ seeds[i]) * factors[i], start), 5)
        keys[:, k] = h
    out = iter(keys.view(np.int64).tolist())
    return [next(out) if len(s) else [] for s in sets]


def signatures(docs: DataFrame, id_col: str, text: str, side: int, rows: int) -> DataFrame:
    """(doc_id, class binary, n_shingles, keys) of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("class", pa.binary()), ("n_shingles", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _pieces(batches):
            sets, digests = shingle_sets(texts)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(minhash_keys(sets, side, rows), pa.list_(pa.int64()))], schema=schema)

    return docs.select(F.col(id_col).cast("long"), F.col(text)).mapInArrow(sign, "doc_id long, class binary, n_shingles long, keys array<long>")


def _pieces(batches: Iterator[pa.RecordBatch], chars: int = 1 << 20) -> Iterator[tuple[list, list]]:
    """Rows in pieces of about a million characters."""
    for batch in batches:
        ids, texts, size = [], [], 0
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            t = t.as_py() or ""
            ids.append(i)
            texts.append(t)
            size += len(t)
            if size > chars:
                yield ids, texts
                ids, texts, size = [], [], 0
        if ids:
            yield ids, texts


# ---------------------------------------------------------------- buckets and stars


def tensor_stars(nodes: DataFrame, side: int) -> DataFrame:
    """(a, b, size) of distinct pivots a and members b of the tables' buckets, size that of their largest; nodes: (id, keys)."""
    keys = nodes.select("id", F.posexplode("keys").alias("k", "key"))
    shared = keys.groupBy("k", "key").agg(F.count("*").alias("n")).where("n > 1")
    kept = keys.join(shared.hint("merge"), ["k", "key"]).groupBy("id").agg(F.collect_list(F.struct("k", "key")).alias("keys"), F.sum("n").alias("company"))  # 2 * side keys at most
    first, second = F.filter("keys", lambda x: x["k"] < side), F.filter("keys", lambda x: x["k"] >= side)
    tables = F.flatten(F.transform(first, lambda a: F.transform(second, lambda b: F.xxhash64(a["k"], b["k"], a["key"], b["key"]))))
    rows = kept.select("id", "company", F.explode(tables).alias("bucket"))
    pivots = rows.groupBy("bucket").agg(F.count("*").alias("size"), F.min(F.struct((-F.col("company")).alias("c"), "id"))["id"].alias("pivot")).where("size > 1")
    return rows.join(pivots.hint("merge"), "bucket").where("id <> pivot").groupBy(F.col("pivot").alias("a"), F.col("id").alias("b")).agg(F.max("size").alias("size"))


MEMBER = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("common", pa.int64()), ("shingles", pa.list_(pa.int64()))])


def compare(stars: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b, common, shingles) of each (a, b, size): sizes of the sets and of their common part.

    Where other members share a bucket (size over 2) the shingles of b follow, and once a task a row (a, a) those of a.
    docs: (id, text). They are dealt by their id once, for both sides. Rows come sorted by a, whose set is held.
    """
    b = stars.hint("merge").join(docs.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    a = docs.join(stars.select(F.col("a").alias("id")).distinct().hint("merge"), "id").select(F.col("id").alias("a"), F.col("text").alias("text_a"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, mine, told = None, None, None
        for batch in batches:
            for lo in range(0, len(batch), 100):
                part = batch.slice(lo, 100)
                theirs, _ = shingle_sets(part.column(4).to_pylist())
                rows = []
                for k, (x, y, size, s) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), theirs, strict=True)):
                    text = part.column(3)[k]
                    if x != at or mine[0] != text:
                        at, mine = x, (text, shingle_sets([text.as_py()])[0][0])
                    if size > 2 and told != x:
                        told = x
                        rows.append((x, x, len(mine[1]), len(mine[1]), len(mine[1]), mine[1].view(np.int64)))
                    rows.append((x, y, len(mine[1]), len(s), len(np.intersect1d(mine[1], s, True)), s.view(np.int64) if size > 2 else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), MEMBER, strict=True)], schema=MEMBER)

    return b.join(a.hint("merge"), "a").select("a", "b", "size", "text_a", "text_b").mapInArrow(work, "a long, b long, n_a long, n_b long, common long, shingles array<long>")


def _linked(percent: int):
    return 100 * F.col("common") >= percent * (F.col("n_a") + F.col("n_b") - F.col("common"))


class _Postings:
    """For each token the rows that have it."""

    def __init__(self, sets: list[np.ndarray]):
        flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        self.tokens, inverse, self.count = np.unique(flat, return_inverse=True, return_counts=True)
        self.rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[np.argsort(inverse, kind="stable")]
        self.start = np.append(0, np.cumsum(self.count))

    def find(self, tokens: np.ndarray) -> np.ndarray:
        """The places of tokens, all known."""
        return np.searchsorted(self.tokens, tokens)

    def of(self, places: np.ndarray) -> np.ndarray:
        """The rows of several tokens, one after the other."""
        n = self.count[places]
        return self.rows[np.repeat(self.start[places] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())] if len(places) else self.rows[:0]


def star_links(ids: np.ndarray, sets: list[np.ndarray], linked: np.ndarray, side: np.ndarray, pivot: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A forest of the links between members of a star; with two sides, of those between the sides."""
    m, size = len(ids), np.array([len(s) for s in sets])
    both, parent = side.min() != side.max(), list(range(m))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out, hub = [], None
    for k in np.flatnonzero(linked).tolist():  # these are one component already
        hub = k if hub is None else hub
        parent[k] = hub

    def join(x: int, y: int) -> None:
        a, b = root(x), root(y)
        if a != b:
            parent[b] = a
            out.append((int(ids[x]), int(ids[y])))

    deltas = [np.setxor1d(s, pivot, True) for s in sets]
    d = np.array([len(x) for x in deltas])
    near = d <= size
    # both near the pivot: overlaps of D by counting
    at = np.flatnonzero(near)
    postings = _Postings([deltas[k] for k in at.tolist()])
    for k, x in enumerate(at.tolist()):
        if linked[x]:
            continue
        places = postings.find(deltas[x])
        shared = np.bincount(postings.of(places[postings.count[places] > 1]), minlength=len(at))
        common = (size[x] + size[at] - (d[x] + d[at] - 2 * shared)) // 2
        fit = (100 * common >= percent * (size[x] + size[at] - common)) & (np.arange(len(at)) != k)
        if both:
            fit &= side[at] != side[x]
        for y in at[fit].tolist():
            join(x, y)
    # one far from it: a common token among the rarest, then the full sets
    far = np.flatnonzero(~near)
    if len(far) and m > 1:
        whole = _Postings(sets)
        prefixes = []
        for s in sets:
            places = whole.find(s)
            prefixes.append(places[np.lexsort((places, whole.count[places]))][: len(s) - (percent * len(s) + 99) // 100 + 1])
        begins = _Postings(prefixes)
        for x in far.tolist():
            places = begins.find(prefixes[x])
            fit = np.unique(begins.of(places[begins.count[places] > 1]))
            fit = fit[(fit != x) & (100 * np.minimum(size[fit], size[x]) >= percent * np.maximum(size[fit], size[x]))]
            if both:
                fit = fit[side[fit] != side[x]]
            for y in fit.tolist():
                if root(x) != root(y):
                    common = len(np.intersect1d(sets[x], sets[y], True))
                    if 100 * common >= percent * (size[x] + size[y] - common):
                        join(x, y)
    return out


def rest_of_stars(done: DataFrame, percent: int, star_shingles: int) -> DataFrame:
    """(a, b): a forest of the links between members of each star that do not both have one to its pivot."""
    d = done.where("shingles is not null").select("a", "b", "n_b", "shingles", (1 - F.col("common") / (F.col("n_a") + F.col("n_b") - F.col("common"))).alias("d"), _linked(percent).alias("linked"))
    star = d.where("a <> b").groupBy("a").agg(F.min(F.when(~F.col("linked"), F.col("d"))).alias("nearest"), F.count("*").alias("m"), F.sum("n_b").alias("total")).where("nearest is not null and m > 1")
    reach = F.col("nearest") - (1 - percent / 100) - 1e-9
    d = d.join(star, "a").where(~F.col("linked") | (F.col("a") == F.col("b")) | (F.col("d") >= reach))
    k = F.ceil(F.col("total") / star_shingles).cast("int")
    mine = F.pmod(F.xxhash64("b"), k).cast("int")
    every = F.sequence(F.lit(0), k - 1)
    meets = F.transform(every, lambda i: F.struct(F.least(i, mine).alias("i"), F.greatest(i, mine).alias("j")))
    all_ = F.flatten(F.transform(every, lambda i: F.transform(F.sequence(i, k - 1), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    dealt = d.select("a", "b", "linked", "shingles", mine.alias("mine"), F.explode(F.when(F.col("a") == F.col("b"), all_).otherwise(meets)).alias("pair")).select("a", "pair.i", "pair.j", "b", "linked", "mine", "shingles")

    def work(key: tuple, table: pa.Table) -> pa.Table:
        a = key[0].as_py()
        ids, linked, side = (table.column(c).to_numpy() for c in ("b", "linked", "mine"))
        sets = [x.values.to_numpy().view(np.uint64) for x in table.column("shingles")]
        own = ids == a
        keep = np.flatnonzero(~own)
        links = []
        if len(keep) > 1 and not linked[keep].all():
            pivot = sets[int(np.flatnonzero(own)[0])]
            links = star_links(ids[keep], [sets[k] for k in keep.tolist()], linked[keep], side[keep], pivot, percent)
        return pa.table([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])

    return dealt.groupBy("a", "i", "j").applyInArrow(work, "a long, b long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", percent: int = 85, side: int = 10, rows: int = 2, star_shingles: int = 1 << 22) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document; kept where it is its component's smallest id."""
    signed = written(signatures(docs, id_col, text, side, rows), "signatures")
    full = signed.where("n_shingles > 0 and doc_id is not null")
    classes = written(full.groupBy("class").agg(F.min("doc_id").alias("id"), F.min_by("keys", "doc_id").alias("keys")), "classes")
    stars = written(tensor_stars(classes.select("id", "keys"), side), "stars")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    done = written(compare(stars, texts), "compared")
    edges = done.where(_linked(percent)).where("a <> b").select("a", "b").unionByName(rest_of_stars(done, percent, star_shingles))
    component = connected_components(edges)
    dropped(stars)
    dropped(done)
    out = signed.select("doc_id", "class", "n_shingles").join(classes.select("class", "id").hint("merge"), "class", "left").join(component.hint("merge"), "id", "left")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.coalesce("component", "id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", **parameters) -> DataFrame:
    """The documents that are their component's smallest id, all columns as they are."""
    verdict = near_duplicates(docs, id_col=id_col, text=text, **parameters)
    gone = verdict.where("not kept").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
