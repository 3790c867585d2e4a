"""Exact removal of repeated passages of words, by prefix-partitioned suffix trees.

A window is ``length`` consecutive words of one document. Every word inside a window whose word sequence also
starts earlier (in a document with a smaller id, or before it in the same one) is removed; windows are judged on
the input. Suffixes are sparse (see ``anchored``): one at each anchor word.

Suffixes are split by prefixes into groups that fit in memory. The prefix is the anchor's gram of ``gram`` words;
where that is so frequent that many blocks have it, it is lengthened to the whole window (its ``length`` words),
below which the tree has no branch that matters. Prefixes that occur once are leaves and are never sent. A reducer
gets the groups of a range of prefix hashes, numbers their words, and builds the subtrees: suffixes in order, with
the number of words that neighbours share, which are the leaves and the depths of the internal nodes between them.
The nodes ``length - offset`` words deep are the maximal repeats to the right; below each, suffixes that also agree
on the words before them are places of the same window.

Edge cases: null and blank texts have no words; shorter texts lose nothing; rows that repeat a document id and
place are not earlier than each other; a null id counts as the greatest; extra columns may travel along, whatever
their names. Memory: one block, or one group of prefixes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge.llm import anchored
from folioforge.llm.anchored import Entries, Method, Symbols
from folioforge.llm.common import IS_SPACE, Ranges, mix
from folioforge.llm.suffix_merge import spans_of

_C1 = np.uint64(0x9E3779B97F4A7C15)


class Words(Symbols):
    """Words as symbols; ``data`` are the bytes, ``lo`` and ``hi`` the words' places in them, ``bytes_of`` the documents'."""


def word_symbols(texts: list[str], ids: list[int], gram: int) -> Words:
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = b" ".join(raw) + b" "
    a = np.frombuffer(data, np.uint8)
    space = IS_SPACE[a]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).astype(np.int8)))
    lo, hi = edge[::2], edge[1::2]
    doc_at = np.append(0, np.cumsum([len(x) + 1 for x in raw])).astype(np.int64)
    starts = np.searchsorted(lo, doc_at[:-1])
    ends = np.searchsorted(lo, doc_at[1:])
    codes = np.empty(len(lo), np.uint64)
    k = 0
    while k < len(lo):  # hashes of about half a megabyte at a time
        j = max(k + 1, int(np.searchsorted(lo, lo[k] + (1 << 19))))
        codes[k:j] = Ranges(a[lo[k] : hi[j - 1]]).hashes(lo[k:j] - lo[k], hi[k:j] - lo[k])
        k = j

    def grams(first: int, last: int) -> np.ndarray:
        h, power, width = codes[first : last + gram - 1], _C1, 1
        out, done = None, 0
        while True:
            if gram & width:
                out = h if out is None else out[: len(out) - width] * power + h[done : done + len(out) - width]
                done += width
            if 2 * width > gram:
                return mix(out[: last - first])
            h = h[:-width] * power + h[width:]
            width *= 2
            power = np.uint64(pow(int(_C1), width, 1 << 64))

    w = Words(codes, starts, ends, np.array(ids, np.int64), grams)
    w.data, w.lo, w.hi, w.doc_at = data, lo, hi, doc_at
    return w


def prefix_groups(block: int, s: Words, e: Entries, buckets: int, length: int) -> list[tuple[int, int, bytes]]:
    """What a block has of each group: words before and after the anchor, document, place in it, and the text."""
    n = len(e.key)
    if not n:
        return []
    b = anchored.bucket_of(e.key, buckets)
    cut = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
    before, after = e.at - e.first, e.last + length - e.at
    place = e.at - s.starts[anchored.owner(s, e.at)]
    lo, hi = s.lo[e.first], s.hi[e.last + length - 1]
    rows = []
    for i, j in zip(cut, np.append(cut[1:], n), strict=True):
        text = b"".join([s.data[x:y] for x, y in zip(lo[i:j].tolist(), hi[i:j].tolist(), strict=True)])
        rows.append((int(b[i]), block, b"".join((np.uint32(j - i).tobytes(), before[i:j].astype(np.uint8).tobytes(), after[i:j].astype(np.uint8).tobytes(), (hi - lo)[i:j].astype(np.uint32).tobytes(), e.doc[i:j].tobytes(), place[i:j].tobytes(), text))))
    return rows


def subtrees(right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the leaves, words that each shares with the leaf before): the trees of all prefixes of a group, side by side.

    ``right``: word numbers of each suffix, -1 after its end.
    """
    order = np.lexsort(right.T[::-1])
    r = right[order]
    same = (r[1:] == r[:-1]) & (r[1:] >= 0)
    depth = np.zeros(len(order), np.int64)
    depth[1:] = np.where(same.all(1), right.shape[1], same.argmin(1))
    return order, depth


def build_bucket(data: list[bytes], length: int, gram: int) -> list[np.ndarray]:
    """The subtrees of a bucket's groups; for each block, the bits of its suffixes."""
    numbers: dict[bytes, int] = {}
    flat, before, after, doc, place, sizes = [], [], [], [], [], []
    for x in data:
        n = int(np.frombuffer(x, np.uint32, 1)[0])
        sizes.append(n)
        before.append(np.frombuffer(x, np.uint8, n, 4).astype(np.int64))
        after.append(np.frombuffer(x, np.uint8, n, 4 + n).astype(np.int64))
        size = np.frombuffer(x, np.uint32, n, 4 + 2 * n)
        doc.append(np.frombuffer(x, np.int64, n, 4 + 6 * n))
        place.append(np.frombuffer(x, np.int64, n, 4 + 14 * n))
        lo = 4 + 22 * n
        for k in size.tolist():
            for w in x[lo : lo + k].split():
                flat.append(numbers.setdefault(w, len(numbers)))
            lo += k
    before, after, doc, place = (np.concatenate(x) for x in (before, after, doc, place))
    flat = np.array(flat, np.int32)
    start = np.cumsum(before + after) - before - after
    columns = np.arange(length)
    right = flat[np.minimum((start + before)[:, None] + columns, len(flat) - 1)]
    right[columns >= after[:, None]] = -1
    order, depth = subtrees(right)
    first = (start + before)[order]
    bits = np.empty(len(order), np.uint64)
    bits[order] = anchored.earlier(depth, lambda o: flat[np.maximum(first - 1 - o, 0)], length - after[order], before[order], anchored.dense_rank(doc[order], place[order]), length, gram)
    base = np.append(0, np.cumsum(sizes))
    return [bits[i:j] for i, j in zip(base[:-1], base[1:], strict=True)]


def _finish(extra: pa.Schema, layout: bool):
    def finish(table: pa.Table, s: Words, gone: np.ndarray) -> pa.Table:
        rows = []
        for i, text, a, b in zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist(), s.starts.tolist(), s.ends.tolist(), strict=True):
            mask = gone[a:b]
            n = int(mask.sum())
            spans = spans_of(mask) if n else []
            if layout:
                if n:  # a removed word goes with the white space after it
                    at, end = s.lo[a:b], s.lo[a]
                    parts = []
                    for span in spans:
                        parts.append(s.data[end : at[span["start"]]])
                        end = at[span["end"]] if span["end"] < b - a else s.hi[b - 1]
                    text = b"".join([*parts, s.data[end : s.hi[b - 1]]]).decode("utf-8", "surrogatepass")
            else:
                keep = np.flatnonzero(~mask) + a
                text = b" ".join([s.data[x:y] for x, y in zip(s.lo[keep].tolist(), s.hi[keep].tolist(), strict=True)]).decode("utf-8", "surrogatepass")
            rows.append((i, b - a, n, spans, text))
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        out = anchored.to_table(rows, pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", span), ("kept", pa.string())]))
        for f in extra:
            out = out.append_column(f.name, table.column(f.name))
        return out

    return finish


OUT = "doc_id long, n_words long, n_removed long, spans array<struct<start: long, end: long>>, kept string"


def remove_repeated_passages(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", length: int = 20, gram: int = 8, block_bytes: int = 2 << 20, bucket_bytes: int = 8 << 20, hot_runs: int = 512, layout: bool = False, extra: list[str] = ()) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept) of every document; spans count words.

    ``kept``: the words that stay, joined by one blank; with ``layout``, as the text has them (a text that loses
    nothing is unchanged). ``extra`` columns follow, each named ``x_`` and its name. ``length - gram`` is at most 31.
    """
    if not 0 < gram < length or length - gram > 31:
        raise ValueError("length - gram must be between 1 and 31")
    given = T.StructType([T.StructField(f"x_{c}", docs.schema[c].dataType) for c in extra])
    from pyspark.sql.pandas.types import to_arrow_schema

    method = Method(
        length, gram, True,
        symbols=lambda texts, ids: word_symbols(texts, ids, gram),
        runs=lambda block, s, e, buckets: prefix_groups(block, s, e, buckets, length),
        sort=lambda s, key, at, first, last: np.arange(len(key)),
        merge=lambda data: build_bucket(data, length, gram),
        finish=_finish(to_arrow_schema(given), layout),
    )
    out = T.StructType(T._parse_datatype_string(OUT).fields + given.fields)
    return anchored.remove_repeats(docs, method, out, id_col=id_col, text=text, block_bytes=block_bytes, bucket_bytes=bucket_bytes, hot_runs=hot_runs, extra=list(extra))


def cut_repeated_passages(docs: DataFrame, **parameters) -> DataFrame:
    """The documents, in their columns, with repeated passages cut from ``text``; those left without a word are dropped."""
    columns = docs.columns
    cut = remove_repeated_passages(docs, layout=True, extra=[c for c in columns if c not in ("doc_id", "text")], **parameters)
    return cut.where((F.col("n_words") > F.col("n_removed")) | (F.col("n_words") == 0)).select(*[F.col("doc_id") if c == "doc_id" else F.col("kept").alias("text") if c == "text" else F.col(f"x_{c}").alias(c) for c in columns])
