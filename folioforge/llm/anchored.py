"""What the two exact repeat finders share: sparse suffixes at anchors, and who of them repeats.

Every window of ``length`` symbols has an anchor: the leftmost of its grams of ``gram`` symbols with the least hash.
Equal windows have their anchor at the same offset, so it is enough to sort the suffixes that start at anchors, each
with the few symbols before it: an anchor's suffix stands for all windows that chose it (about half of
``length - gram``), and two windows are equal where their suffixes share ``length - offset`` symbols and the
symbols before them agree on ``offset``.

The work is dealt in blocks of documents (a Python worker holds one) in three passes over the same shuffled blocks:

1. each block sends the distinct hashes of its anchors' grams, sorted, in four bytes each, to the reducer of their
   hash range; a reducer answers each block with one bit for each hash: another block has it (or another document of
   the block). A suffix whose gram is unique is a leaf at the tree's top; it is done.
2. each block sends the suffixes that are left, equal ones once with their first place, to a reducer, which sorts
   them, takes the common prefixes of neighbours and answers with a bit for each window of each suffix: an earlier
   place has the same window. A gram that many blocks have is sent window by window instead, under the hash of the
   whole window, so that no reducer gathers all contexts of a frequent gram.
3. each block turns the bits into the symbols to remove.

What a reducer gets from a block is bounded by the block, not by the copies in it; equal suffixes of all blocks are
one row each. Answers are a function of the input alone, so a lost task is simply run again.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge.llm.common import mix, text_bytes

SLICE = 1 << 18
_LOW = np.uint64((1 << 21) - 1)

RUN = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("data", pa.binary())])
ANSWER = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("data", pa.binary())])


class Found(NamedTuple):
    """Anchors of a block: the suffix's start, the first and last window that chose it, the gram's hash."""

    at: np.ndarray
    first: np.ndarray
    last: np.ndarray
    hash: np.ndarray


class Symbols(NamedTuple):
    """The documents of a block as one row of symbols."""

    codes: np.ndarray  # uint64 for hashing, or bytes
    starts: np.ndarray  # of each document
    ends: np.ndarray
    doc: np.ndarray  # its id
    grams: Callable[[int, int], np.ndarray]  # hashes of the grams that start in a range


def find_anchors(s: Symbols, length: int, gram: int) -> Found:
    n, w = len(s.codes), length - gram + 1
    whole = np.ones(max(0, n - length + 1), bool)
    for a, b in zip(np.maximum(s.starts, s.ends - length + 1).tolist(), s.ends.tolist(), strict=True):
        whole[a:b] = False
    parts = []
    for lo in range(0, len(whole), SLICE):
        hi = min(len(whole), lo + SLICE)
        h = s.grams(lo, hi + w - 1)
        v = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)  # the position makes the leftmost of equals the least
        span = 1
        while span < w:
            step = min(span, w - span)
            v = np.minimum(v[:-step], v[step:])
            span += step
        starts = np.flatnonzero(whole[lo:hi])
        if not len(starts):
            continue
        at = (v[starts] & _LOW).astype(np.int64)
        new = np.ones(len(starts), bool)
        new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
        k = np.flatnonzero(new)
        # anchors have the least hashes: mixed again, they fill the whole range
        parts.append(Found(at[k] + lo, starts[k] + lo, starts[np.append(k[1:], len(starts)) - 1] + lo, mix(h[at[k]])))
    if not parts:
        z = np.zeros(0, np.int64)
        return Found(z, z, z, np.zeros(0, np.uint64))
    return Found(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def owner(s: Symbols, at: np.ndarray) -> np.ndarray:
    """The document (by its order in the block) of each symbol position."""
    return np.searchsorted(s.starts, at, "right") - 1


# ---------------------------------------------------------------- pass 1: which grams repeat


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """A range of the hash space; rising with the hash."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def low_bits(h: np.ndarray, buckets: int) -> np.ndarray:
    """32 bits that tell hashes of a bucket apart, in the order of the hash as far as they go."""
    shift = np.uint64(max(0, 32 - max(1, buckets).bit_length() + 1))
    return ((h >> shift) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def gram_runs(block: int, s: Symbols, found: Found, buckets: int, across_documents: bool) -> pa.Table:
    """A block's distinct gram hashes by bucket, and which repeat in the block itself."""
    h, where, count = np.unique(found.hash, return_inverse=True, return_counts=True)
    again = count > 1
    if across_documents and len(h):
        doc = s.doc[owner(s, found.at)]
        lo, hi = np.full(len(h), np.iinfo(np.int64).max), np.full(len(h), np.iinfo(np.int64).min)
        np.minimum.at(lo, where, doc)
        np.maximum.at(hi, where, doc)
        again = lo < hi
    b = bucket_of(h, buckets)
    cut = np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(b) else np.zeros(0, np.int64)
    keys = low_bits(h, buckets)
    rows = [(int(b[i]), block, keys[i:j].tobytes() + np.packbits(again[i:j]).tobytes()) for i, j in zip(cut, np.append(cut[1:], len(b)), strict=True)]
    return to_table(rows, RUN)


def answer_grams(table: pa.Table, hot_runs: int) -> pa.Table:
    """For each block of a bucket: a bit a hash, whether it repeats; and a bit, whether more than ``hot_runs`` blocks have it."""
    runs = []
    for data in table.column("data").to_pylist():
        n = _count(len(data))
        runs.append((np.frombuffer(data, np.uint32, n), np.unpackbits(np.frombuffer(data, np.uint8, offset=4 * n), count=n).astype(bool)))
    keys, again = np.concatenate([r[0] for r in runs]), np.concatenate([r[1] for r in runs])
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    start = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    size = np.diff(np.append(start, len(k)))
    any_again = np.maximum.reduceat(again[order], start) if len(start) else np.zeros(0, bool)
    value = ((size > 1) | any_again).astype(np.uint8) + 2 * (size > hot_runs).astype(np.uint8)
    out = np.empty(len(keys), np.uint8)
    out[order] = np.repeat(value, size)
    rows, lo = [], 0
    bucket = table.column("bucket")[0].as_py()
    for block, r in zip(table.column("block").to_pylist(), runs, strict=True):
        v = out[lo : lo + len(r[0])]
        lo += len(r[0])
        rows.append((block, bucket, np.packbits(v & 1).tobytes() + np.packbits(v >> 1).tobytes()))
    return to_table(rows, ANSWER)


def _count(size: int) -> int:
    """n of 4 n + ceil(n / 8) bytes."""
    return size * 8 // 33


def kept_grams(found: Found, answers: dict[int, bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor: does its gram repeat, and is it a frequent one."""
    h, where = np.unique(found.hash, return_inverse=True)
    b = bucket_of(h, buckets)
    again, hot = np.zeros(len(h), bool), np.zeros(len(h), bool)
    cut = np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(b) else np.zeros(0, np.int64)
    for i, j in zip(cut, np.append(cut[1:], len(b)), strict=True):
        data, half = np.frombuffer(answers[int(b[i])], np.uint8), (j - i + 7) // 8
        again[i:j] = np.unpackbits(data[:half], count=j - i)
        hot[i:j] = np.unpackbits(data[half:], count=j - i)
    return again[where], hot[where]


# ---------------------------------------------------------------- pass 2: suffixes


class Entries(NamedTuple):
    """The distinct suffixes of a block, sorted by key, and for each occurrence the entry it belongs to."""

    key: np.ndarray  # by which they are dealt
    at: np.ndarray  # of the first place
    first: np.ndarray
    last: np.ndarray
    doc: np.ndarray  # document id of the first place
    of: np.ndarray  # entry of each occurrence
    occurrences: Found
    later: np.ndarray  # occurrence is at a later place than its entry's first


def span_hash(codes: np.ndarray, lo: np.ndarray, hi: np.ndarray, longest: int) -> np.ndarray:
    """Hash of symbols lo..hi of each row."""
    out = np.zeros(len(lo), np.uint64)
    for j in range(longest):
        p = lo + j
        c = codes[np.minimum(p, len(codes) - 1)].astype(np.uint64) + np.uint64(1)
        out = np.where(p < hi, (out ^ c) * np.uint64(0x9E3779B97F4A7C15) + (out >> np.uint64(29)), out)
    return mix(out + (hi - lo).astype(np.uint64))


def entries(s: Symbols, found: Found, again: np.ndarray, hot: np.ndarray, length: int, gram: int, places: bool, sort: Callable) -> Entries:
    """``places``: an earlier place in the same document counts as earlier, too. ``sort``: the order of suffixes, by key foremost."""
    f = Found(*(x[again] for x in found))
    hot = hot[again]
    if hot.any():  # window by window
        n = (f.last - f.first + 1)[hot]
        rows = np.repeat(np.flatnonzero(hot), n)
        start = f.first[rows] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        windows = Found(f.at[rows], start, start, span_hash(s.codes, start, start + length, length))
        f = Found(*(np.concatenate((x[~hot], y)) for x, y in zip(f, windows, strict=True)))
    same = mix(span_hash(s.codes, f.first, f.last + length, 2 * length - gram) + (f.at - f.first).astype(np.uint64))
    doc = s.doc[owner(s, f.at)] if len(f.at) else np.zeros(0, np.int64)
    order = np.lexsort((f.at, doc, same, f.hash))
    k, g = same[order], f.hash[order]
    start = np.append(True, (k[1:] != k[:-1]) | (g[1:] != g[:-1])) if len(k) else np.zeros(0, bool)
    of = np.empty(len(k), np.int64)
    of[order] = np.cumsum(start) - 1
    pick = order[start]
    by = sort(s, f.hash[pick], f.at[pick], f.first[pick], f.last[pick])
    pick, place = pick[by], np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    of = place[of]
    # rows that repeat a document repeat its places: these are told apart by the place in the document
    place = f.at - s.starts[owner(s, f.at)] if len(f.at) else f.at
    later = doc > doc[pick][of]
    if places:
        later |= (doc == doc[pick][of]) & (place > _least_place(place, doc, of, pick)[of])
    return Entries(f.hash[pick], f.at[pick], f.first[pick], f.last[pick], doc[pick], of, f, later)


def _least_place(place, doc, of, pick):
    out = np.full(len(pick), np.iinfo(np.int64).max)
    mine = doc == doc[pick][of]
    np.minimum.at(out, of[mine], place[mine])
    return out


def earlier(lcp: np.ndarray, before: Callable[[int], np.ndarray], low: np.ndarray, high: np.ndarray, rank: np.ndarray, length: int, gram: int) -> np.ndarray:
    """For each suffix, in sorted order, a bit for each offset: an earlier one has the same window.

    lcp[i]: symbols that i shares with i - 1. before(o): the symbol o + 1 places before each. low, high: its offsets. rank: order of the places. Suffixes that share ``length - o`` symbols are the leaves below one node of
    the suffix tree at that depth; those that also agree on the o symbols before are places of one window.
    """
    bits = np.zeros(len(lcp), np.uint64)
    near = lcp >= gram
    some = near | np.append(near[1:], False)
    left = np.zeros(len(lcp), np.uint64)  # hash of the o symbols before
    for o in range(length - gram + 1):
        if o:
            left = (left ^ (before(o - 1).astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
            left ^= left >> np.uint64(29)
        rows = np.flatnonzero(some & (low <= o) & (o <= high))
        if len(rows) < 2:
            continue
        node = np.cumsum(lcp < length - o)[rows].astype(np.uint64)
        key = mix(node + left[rows]) if o else node
        order = np.argsort(key, kind="stable")
        k = key[order]
        start = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        size = np.diff(np.append(start, len(k)))
        least = np.repeat(np.minimum.reduceat(rank[rows][order], start), size)
        hit = rows[order][least < rank[rows][order]]
        bits[hit] |= np.uint64(1 << o)
    return bits


def dense_rank(*keys: np.ndarray) -> np.ndarray:
    """Rank by the keys, the first foremost; equal keys share one."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def covered(s: Symbols, e: Entries, bits: np.ndarray, length: int) -> np.ndarray:
    """Pass 3: the symbols inside a window that an earlier place has."""
    f = e.occurrences
    n = f.last - f.first + 1
    rows = np.repeat(np.arange(len(n)), n)
    start = f.first[rows] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    hit = e.later[rows] | ((bits[e.of[rows]] >> (f.at[rows] - start).astype(np.uint64)) & np.uint64(1)).astype(bool)
    mark = np.zeros(len(s.codes) + 1, np.int64)
    np.add.at(mark, start[hit], 1)
    np.add.at(mark, start[hit] + length, -1)
    return np.cumsum(mark)[:-1] > 0


def to_table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


# ---------------------------------------------------------------- the passes as Spark jobs


class Method(NamedTuple):
    """What differs between the two operators."""

    length: int
    gram: int
    places: bool
    symbols: Callable[[list[str], list[int]], Symbols]
    runs: Callable[[int, Symbols, Entries, int], list[tuple[int, int, bytes]]]  # (bucket, block, data), entries in their order
    sort: Callable  # (symbols, key, at, first, last) to an order of suffixes, by key foremost
    merge: Callable[[list[bytes]], list[np.ndarray]]  # runs of a bucket to the bits of each run's entries
    finish: Callable[[pa.Table, Symbols, np.ndarray], pa.Table]  # documents, symbols and what is covered to rows


def remove_repeats(docs: DataFrame, method: Method, out: T.StructType, *, id_col: str, text: str, block_bytes: int, bucket_bytes: int, hot_runs: int, extra: list[str] = ()) -> DataFrame:
    """All passes; ``extra`` columns travel with their document under ``x_`` names."""
    total = text_bytes(docs, text)
    buckets = max(1, math.ceil(total / bucket_bytes))
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), *[F.col(c).alias(f"x_{c}") for c in extra])
    n = max(1, math.ceil(total / block_bytes))
    d = d.select(
        F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(n)).cast("long").alias("block"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        *[F.col(f"x_{c}") for c in extra],
    )
    m = method

    def load(table: pa.Table) -> tuple[pa.Table, Symbols, Found]:
        import pyarrow.compute as pc

        table = table.append_column("__null", pc.is_null(table.column("doc_id"))).sort_by([("__null", "ascending"), ("doc_id", "ascending"), ("text", "ascending")]).drop(["__null"])
        ids = pc.fill_null(table.column("doc_id"), np.iinfo(np.int64).max).to_pylist()
        s = m.symbols(table.column("text").to_pylist(), ids)
        return table, s, find_anchors(s, m.length, m.gram)

    def first_pass(key, table):
        _, s, found = load(table)
        return gram_runs(key[0].as_py(), s, found, buckets, not m.places)

    def first_answer(table):
        return answer_grams(table, hot_runs)

    def second_pass(key, left, right):
        block = key[0].as_py()
        _, s, found = load(left)
        told = dict(zip(right.column("bucket").to_pylist(), right.column("data").to_pylist(), strict=True))
        again, hot = kept_grams(found, told, buckets)
        e = entries(s, found, again, hot, m.length, m.gram, m.places, m.sort)
        rows = m.runs(block, s, e, buckets)
        # what this block learned goes back to it with the answers
        rows.append((-1 - block, block, np.packbits(again).tobytes() + np.packbits(hot).tobytes()))
        return to_table(rows, RUN)

    def second_answer(table):
        bucket = table.column("bucket")[0].as_py()
        own, data = table.column("block").to_pylist(), table.column("data").to_pylist()
        if bucket < 0:
            return to_table([(b, -1, x) for b, x in zip(own, data, strict=True)], ANSWER)
        return to_table([(b, bucket, bits.astype("<u4").tobytes()) for b, bits in zip(own, m.merge(data), strict=True)], ANSWER)

    def third_pass(key, left, right):
        table, s, found = load(left)
        told = dict(zip(right.column("bucket").to_pylist(), right.column("data").to_pylist(), strict=True))
        own, n = np.frombuffer(told.pop(-1), np.uint8), len(found.at)
        again, hot = (np.unpackbits(x, count=n).astype(bool) for x in (own[: (n + 7) // 8], own[(n + 7) // 8 :]))
        e = entries(s, found, again, hot, m.length, m.gram, m.places, m.sort)
        bits = np.concatenate([np.zeros(0, np.uint32)] + [np.frombuffer(told[b], np.uint32) for b in sorted(told)]).astype(np.uint64)
        return m.finish(table, s, covered(s, e, bits, m.length))

    run, answer = "bucket long, block long, data binary", "block long, bucket long, data binary"
    told = d.groupBy("block").applyInArrow(first_pass, run).groupBy("bucket").applyInArrow(first_answer, answer)
    sent = d.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(second_pass, run)
    said = sent.groupBy("bucket").applyInArrow(second_answer, answer)
    return d.groupBy("block").cogroup(said.groupBy("block")).applyInArrow(third_pass, out)
