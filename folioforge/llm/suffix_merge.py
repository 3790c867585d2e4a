"""Exact removal of repeated byte strings: a distributed merge sort of suffixes that knows their common prefixes.

Every byte that a string of ``length`` bytes covers, which also starts in a document with a smaller id, is removed;
strings overlap, and are judged on the input. Suffixes are sparse (see ``anchored``): one at each anchor.

A suffix's key is the hash of its first gram, as eight bytes, then its bytes, so that the range of the hash deals the
runs evenly to reducers without sampled splitters. Each block sorts its suffixes and sends each reducer a run,
front-coded: the length of the prefix shared with the suffix before, and the bytes after it. A reducer merges its
runs with a loser tree whose nodes hold, with each loser, the prefix it shares with the winner that beat it. A
candidate that shares more with the last output than a loser does wins without looking at a byte; only equal
lengths compare bytes, and from there on. The merged order comes with the common prefix of each pair of neighbours,
and those give the repeats.

Edge cases: null and empty texts have no bytes; texts shorter than ``length`` lose nothing; rows that repeat a
document id are one document to each other (neither is earlier); a null id counts as the greatest; matches never
cross documents; other columns are passed over. Memory: one block, or one bucket of runs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from folioforge.llm import anchored
from folioforge.llm.anchored import Entries, Method, Symbols

_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
PAD = 64


def byte_symbols(texts: list[str], ids: list[int], gram: int) -> Symbols:
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(x) for x in raw]) if raw else np.zeros(0, np.int64)
    starts = np.append(0, ends[:-1]).astype(np.int64)
    data = np.frombuffer(b"".join(raw) + bytes(PAD), np.uint8)
    eight = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))

    def grams(lo: int, hi: int) -> np.ndarray:
        h = eight[lo:hi] * _C1
        for k in range(8, gram, 8):
            h ^= h >> np.uint64(32)
            h += eight[lo + k : hi + k]
            h *= _C2
        h ^= h >> np.uint64(29)
        h *= _C3
        h ^= h >> np.uint64(32)
        h *= _C1
        return h ^ (h >> np.uint64(31))

    return Symbols(data[: len(data) - PAD], starts, ends, np.array(ids, np.int64), grams)


def key_matrix(s: Symbols, key: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, zero-padded and followed by their length; lengths)."""
    size = last + length - at
    m = np.empty((len(at), length + 9), np.uint8)
    m[:, :8] = key.astype(">u8").view(np.uint8).reshape(-1, 8)
    m[:, -1] = size + 8
    for j in range(length):
        m[:, j + 8] = np.where(j < size, s.codes[np.minimum(at + j, len(s.codes) - 1)], 0)
    return m, size + 8


def sort_keys(s: Symbols, key, at, first, last, length: int) -> np.ndarray:
    if not len(key):
        return np.zeros(0, np.int64)
    m, _ = key_matrix(s, key, at, first, last, length)
    return np.argsort(np.ascontiguousarray(m).view(f"V{m.shape[1]}").ravel(), kind="stable")


def front_coded_runs(block: int, s: Symbols, e: Entries, buckets: int, length: int) -> list[tuple[int, int, bytes]]:
    """A run of each bucket: shared prefix, key length, symbols before, document; then the bytes after the prefixes."""
    n = len(e.key)
    if not n:
        return []
    m, size = key_matrix(s, e.key, e.at, e.first, e.last, length)
    width = m.shape[1] - 1
    b = anchored.bucket_of(e.key, buckets)
    cut = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
    differ = np.ones((n - 1, width + 1), bool)  # the last column ends every row
    np.not_equal(m[1:, :width], m[:-1, :width], out=differ[:, :width])
    lcp = np.zeros(n, np.int64)
    lcp[1:] = np.minimum(differ.argmax(1), np.minimum(size[1:], size[:-1]))
    lcp[cut] = 0
    before = e.at - e.first
    columns = np.arange(width)
    most = int(before.max()) if n else 0
    left = np.empty((n, most), np.uint8)
    for j in range(most):
        left[:, j] = s.codes[np.maximum(e.at - 1 - j, 0)]
    rows = []
    for i, j in zip(cut, np.append(cut[1:], n), strict=True):
        keep = (columns >= lcp[i:j, None]) & (columns < size[i:j, None])
        near = np.arange(most) < before[i:j, None]
        rows.append((int(b[i]), block, b"".join((
            np.uint32(j - i).tobytes(), lcp[i:j].astype(np.uint8).tobytes(), size[i:j].astype(np.uint8).tobytes(), before[i:j].astype(np.uint8).tobytes(), e.doc[i:j].tobytes(),
            m[i:j, :width][keep].tobytes(), left[i:j][near].tobytes(),
        ))))
    return rows


class Run:
    """A run as its reducer reads it."""

    def __init__(self, data: bytes):
        n = self.n = int(np.frombuffer(data, np.uint32, 1)[0])
        self.lcp, self.size, self.before = (np.frombuffer(data, np.uint8, n, 4 + k * n).astype(np.int64) for k in range(3))
        self.doc = np.frombuffer(data, np.int64, n, 4 + 3 * n)
        lo = 4 + 11 * n
        tails = self.size - self.lcp
        ends = (lo + np.cumsum(tails)).tolist()
        self.left = np.frombuffer(data, np.uint8, offset=ends[-1] if n else lo)
        keys, last = [], b""
        for p, end in zip(self.lcp.tolist(), ends, strict=True):
            last = last[:p] + data[lo:end]
            keys.append(last)
            lo = end
        self.keys = keys


def merge(runs: list[list[bytes]], shared: list[list[int]]) -> tuple[list[int], list[int]]:
    """(run of each output, prefix it shares with the output before), by a loser tree over common prefixes.

    runs: sorted keys; shared: each key's prefix shared with the key before it in its run.
    """
    k = 1
    while k < len(runs):
        k *= 2
    sizes = [len(r) for r in runs] + [0] * (k - len(runs))
    runs = runs + [[]] * (k - len(runs))
    shared = shared + [[]] * (k - len(shared))
    at = [0] * k
    loser, loser_lcp = [0] * k, [-1] * k
    win, win_lcp = list(range(k)), [0 if n else -1 for n in sizes]
    node = k
    heads = [r[0] if r else b"" for r in runs]
    while node > 1:  # the first round, level by level
        node //= 2
        up, up_lcp = [], []
        for i in range(node):
            a, la, b, lb = win[2 * i], win_lcp[2 * i], win[2 * i + 1], win_lcp[2 * i + 1]
            if lb > la or (la == lb and la >= 0 and heads[b] < heads[a]):
                a, la, b, lb = b, lb, a, la
            if la == lb and la >= 0:
                lb = _shared(heads[a], heads[b], la)
            loser[node + i], loser_lcp[node + i] = b, lb
            up.append(a)
            up_lcp.append(la)
        win, win_lcp = up, up_lcp
    run, h = win[0], win_lcp[0]
    order, lcps = [], []
    while h >= 0:
        order.append(run)
        lcps.append(h)
        i = at[run] = at[run] + 1
        if i < sizes[run]:
            head = heads[run] = runs[run][i]
            h = shared[run][i]
        else:
            head, h = b"", -1
        node = (k + run) // 2
        while node:
            other = loser_lcp[node]
            if other > h:
                loser_lcp[node], h = h, other
                loser[node], run = run, loser[node]
                head = heads[run]
            elif other == h and h >= 0:
                b = loser[node]
                rival = heads[b]
                if head == rival:
                    loser_lcp[node] = len(head)
                else:
                    c, end = h, min(len(head), len(rival))
                    while c < end and head[c] == rival[c]:
                        c += 1
                    loser_lcp[node] = c
                    if c == len(rival) or (c < end and rival[c] < head[c]):
                        loser[node], run, head = run, b, rival
            node //= 2
    return order, lcps


def _shared(a: bytes, b: bytes, c: int) -> int:
    end = min(len(a), len(b))
    while c < end and a[c] == b[c]:
        c += 1
    return c


def merge_bucket(data: list[bytes], length: int, gram: int) -> list[np.ndarray]:
    """Merge a bucket's runs; for each run, the bits of its suffixes."""
    runs = [Run(x) for x in data]
    base = np.append(0, np.cumsum([r.n for r in runs]))
    order, lcps = merge([r.keys for r in runs], [r.lcp.tolist() for r in runs])
    order = np.array(order, np.int64)
    by = np.argsort(order, kind="stable")  # the outputs of each run, in the run's order
    row = np.empty(len(order), np.int64)
    row[by] = np.arange(len(order))  # of each output, in the runs laid end to end
    size, before, doc = (np.concatenate([getattr(r, k) for r in runs]) for k in ("size", "before", "doc"))
    most = length - gram
    left = np.zeros((len(row), most), np.uint8)
    left[np.arange(most) < before[:, None]] = np.concatenate([r.left for r in runs])
    left = left[row]
    lcp = np.maximum(np.array(lcps, np.int64) - 8, 0)
    bits = np.empty(len(row), np.uint64)
    bits[row] = anchored.earlier(lcp, lambda o: left[:, o], length - (size[row] - 8), before[row], anchored.dense_rank(doc[row]), length, gram)
    return [bits[i:j] for i, j in zip(base[:-1], base[1:], strict=True)]


OUT = "doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary"


def spans_of(mask: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _finish(table: pa.Table, s: Symbols, gone: np.ndarray) -> pa.Table:
    rows = []
    for i, a, b in zip(table.column("doc_id").to_pylist(), s.starts.tolist(), s.ends.tolist(), strict=True):
        mask = gone[a:b]
        n = int(mask.sum())
        data = s.codes[a:b]
        rows.append((i, b - a, n, spans_of(mask) if n else [], (data[~mask] if n else data).tobytes()))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return anchored.to_table(rows, pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", span), ("kept", pa.binary())]))


def remove_repeated_bytes(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", length: int = 50, gram: int = 24, block_bytes: int = 2 << 20, bucket_bytes: int = 8 << 20, hot_runs: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept) of every document; spans count bytes.

    ``gram`` is a multiple of 8 below ``length``, and ``length - gram`` at most 31. A gram in more than ``hot_runs``
    blocks is dealt by whole windows.
    """
    if gram % 8 or not 0 < gram < length or length - gram > 31:
        raise ValueError("gram must be a multiple of 8, and length - gram between 1 and 31")
    method = Method(
        length, gram, False,
        symbols=lambda texts, ids: byte_symbols(texts, ids, gram),
        runs=lambda block, s, e, buckets: front_coded_runs(block, s, e, buckets, length),
        sort=lambda s, key, at, first, last: sort_keys(s, key, at, first, last, length),
        merge=lambda data: merge_bucket(data, length, gram),
        finish=_finish,
    )
    return anchored.remove_repeats(docs, method, T._parse_datatype_string(OUT), id_col=id_col, text=text, block_bytes=block_bytes, bucket_bytes=bucket_bytes, hot_runs=hot_runs)
