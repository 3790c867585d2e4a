"""Benchmark decontamination by the q-gram lemma.

An item of m characters and a region of a document within k edits share at least ``m + 1 - q (k + 1)`` q-grams, and
all of those lie on k + 1 neighbouring diagonals (document position minus item position). Shared q-grams are counted
in bands of 2 (k + 1) diagonals that overlap by half, so that some band holds all of them; bands that reach the
bound are verified by banded alignment of the item against its region, and regions within the budget are leaks.

Both sides are lower-cased and runs of white space count as one blank; positions in the result are those of the
original text. The budget is ``k = floor(edit_rate * m)``, or less where the bound would fall below 1.

Items with fewer than ``min_chars`` (or q) characters are searched exactly, by the hash of the whole item, and count
where they begin and end at word borders. Items with more than ``window_chars`` are searched whole and as windows of
``window_chars`` that overlap by half, each with a budget of its own, so that an excerpt of one and a half windows is
found wherever it is cut. Windows of an item that meet in a document are one region, whose distance is the least of
theirs; it is left out where it meets a place of the whole item.

Scale: the documents are not shuffled. The items are a stated query set against all rows, searched in blocks of about
``block_chars`` characters (an item with windows counts three times; some 24 bytes of index a character): a benchmark
of one block is broadcast and the documents are read once; a larger one is searched block after block, each with a
written result, so that one block is on the driver and in the executors at a time.
A very long text is searched in segments that overlap by more than the longest region.

Edge cases: null and empty texts have no leaks; null items are left out; items that repeat an id or a text are each
reported; a document's repeated rows are each reported; extra columns are left out of the result.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import dropped, mix, written

LEAKS = "doc_id long, item_id long, start long, end long, distance long"
_TABLE_BITS = 24
_SPACES = np.array([9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)
_IS_SPACE = np.zeros(0x3001, bool)
_IS_SPACE[_SPACES] = True


def normalise(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(code points lower-cased, white space runs as one blank; the original position of each)."""
    low = text.lower()
    if len(low) != len(text):  # a few letters grow in lower case; they stay as they are
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    a = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    space = _IS_SPACE[np.minimum(a, 0x3000)] & (a <= 0x3000)
    if not space.any():
        return a, np.arange(len(a))
    a = np.where(space, np.uint32(32), a)
    keep = np.ones(len(a), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    at = np.flatnonzero(keep)
    return a[at], at


def gram_hashes(a: np.ndarray, q: int) -> np.ndarray:
    """Hash of each q-gram, by doubling."""
    n = len(a) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15)
    power, span, out, done = base, a.astype(np.uint64) + np.uint64(1), None, 0
    width = 1
    while True:
        if q & width:
            if out is None:
                out = span[: len(a) - width + 1]
            else:
                out = out[: len(out) - width] * power + span[done : done + len(out) - width]
            done += width
        if width * 2 > q:
            break
        span = span[:-width] * power + span[width:]
        width *= 2
        power = np.uint64(pow(int(base), width, 1 << 64))
    return mix(out[:n])


class Items:
    """The q-gram index of a block of items."""

    def __init__(self, items: list[tuple[int, str]], q: int, edit_rate: float, min_chars: int, window: int):
        self.q, self.ids, self.text, self.k, self.need = q, [], [], [], []
        self.item, self.whole = [], []  # of each indexed text: the item's number, and whether it is all of it
        hashes, owners, places = [], [], []
        short: dict[int, list[tuple[int, int, np.ndarray]]] = {}
        for number, (item_id, text) in enumerate(items):
            a, _ = normalise(text.strip())
            if 0 < len(a) < max(min_chars, q):
                short.setdefault(len(a), []).append((number, item_id, a))
            if len(a) < max(min_chars, q):
                continue
            cuts = [(0, len(a))]
            if len(a) > window >= q:
                starts = sorted({*range(0, len(a) - window, max(1, window // 2)), len(a) - window})
                cuts += [(s, s + window) for s in starts]
            for s, e in cuts:
                m = e - s
                k = min(int(edit_rate * m), m // q - 1)
                h = gram_hashes(a[s:e], q)
                hashes.append(h)
                owners.append(np.full(len(h), len(self.ids)))
                places.append(np.arange(len(h)))
                self.ids.append(item_id)
                self.item.append(number)
                self.whole.append(m == len(a))
                self.text.append(a[s:e])
                self.k.append(k)
                self.need.append(m + 1 - q * (k + 1))
        self.short = []  # by length: sorted hashes and their items
        for n, found in sorted(short.items()):
            h = np.concatenate([gram_hashes(a, n) for _, _, a in found])
            order = np.argsort(h, kind="stable")
            self.short.append((n, h[order], [found[i] for i in order]))
        self.k, self.need = np.array(self.k, np.int64), np.array(self.need, np.int64)
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hash = h[order]
        self.owner = (np.concatenate(owners) if owners else np.zeros(0, np.int64))[order]
        self.place = (np.concatenate(places) if places else np.zeros(0, np.int64))[order]
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[(self.hash >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
        self.longest = max((len(t) for t in self.text), default=0)

    def candidates(self, a: np.ndarray, at_once: int = 1 << 20) -> list[tuple[int, int]]:
        """(item, first diagonal) of the bands of a text that reach the bound.

        Shared q-grams are counted in cells of k + 1 diagonals, two neighbours making a band. A run of equal q-grams in
        the text meets a place of an item on neighbouring diagonals, so it gives a weight to each cell instead of a
        count for each diagonal; what is held at a time is bounded by ``at_once`` cells, however repetitive the text.
        """
        h = gram_hashes(a, self.q)
        at = np.flatnonzero(self.table[(h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
        h = h[at]
        lo, hi = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
        hit = hi > lo
        at, h, lo, n = at[hit], h[hit], lo[hit], (hi - lo)[hit]
        if not len(at):
            return []
        first = np.append(True, (at[1:] != at[:-1] + 1) | (h[1:] != h[:-1]) | (np.arange(1, len(at)) % 4096 == 0))
        begin = np.flatnonzero(first)
        length = np.diff(np.append(begin, len(at)))
        at, lo, n = at[begin], lo[begin], n[begin]
        before = np.append(0, np.cumsum(n))
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for x in range(0, int(before[-1]), at_once):
            pair = np.arange(x, min(x + at_once, int(before[-1])))
            run = np.searchsorted(before, pair, "right") - 1
            entry = lo[run] + pair - before[run]
            owner = self.owner[entry]
            step = self.k[owner] + 1
            d0 = at[run] - self.place[entry] + self.longest  # not negative
            d1 = d0 + length[run] - 1
            c0 = d0 // step
            cells = d1 // step - c0 + 1
            upto = np.append(0, np.cumsum(cells))
            y = 0
            while y < len(pair):
                z = max(y + 1, int(np.searchsorted(upto, upto[y] + at_once, "right")) - 1)
                part = np.repeat(np.arange(y, z), cells[y:z])
                cell = c0[part] + np.arange(len(part)) - (upto[part] - upto[y])
                weight = np.minimum(d1[part], (cell + 1) * step[part] - 1) - np.maximum(d0[part], cell * step[part]) + 1
                keys, where = np.unique(np.concatenate((keys, (owner[part].astype(np.int64) << 40) | cell)), return_inverse=True)
                counts = np.bincount(where, np.concatenate((counts, weight))).astype(np.int64)
                y = z
        band, where = np.unique(np.concatenate((keys, keys[(keys & ((1 << 40) - 1)) > 0] - 1)), return_inverse=True)
        total = np.bincount(where, np.concatenate((counts, counts[(keys & ((1 << 40) - 1)) > 0]))).astype(np.int64)
        owner, band = band >> 40, band & ((1 << 40) - 1)
        good = total >= self.need[owner]
        return [(int(o), int(b * (self.k[o] + 1) - self.longest)) for o, b in zip(owner[good], band[good], strict=True)]

    def search(self, a: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item, start, end, distance) of each region within its item's budget; overlapping ones of an item count once."""
        found: list[tuple[int, int, int, int]] = []
        latest: dict[int, int] = {}  # of each item the place found last; bands come in the order of their diagonals
        for o, d in self.candidates(a):
            hit = align(self.text[o], a, d, int(self.k[o]))
            if hit:
                before = latest.get(o)
                if before is not None and found[before][1] < hit[1] and hit[0] < found[before][2]:
                    if hit[2] < found[before][3]:
                        found[before] = (o, *hit)
                elif before is None or found[before][1:] != hit:
                    latest[o] = len(found)
                    found.append((o, *hit))
        return found

    def search_short(self, a: np.ndarray, lo: int, hi: int) -> list[tuple[int, int, int, int]]:
        """(item number, item id, start, end) of each exact place of a short item that starts in a[lo:hi]."""
        out = []
        for n, hashes, items in self.short:
            h = gram_hashes(a[lo : hi + n - 1], n)
            first = np.searchsorted(hashes, h, "left")
            at = np.flatnonzero(hashes[np.minimum(first, len(hashes) - 1)] == h)
            for i, f in zip(at.tolist(), first[at].tolist(), strict=True):
                s, e = lo + i, lo + i + n
                if _border(a, s) and _border(a, e):
                    while f < len(hashes) and hashes[f] == h[i]:
                        number, item_id, item = items[f]
                        if np.array_equal(item, a[s:e]):
                            out.append((number, item_id, s, e))
                        f += 1
        return out


def _border(a: np.ndarray, i: int) -> bool:
    """Whether no word of letters and digits goes on across position i."""
    return i == 0 or i == len(a) or not (chr(a[i - 1]).isalnum() and chr(a[i]).isalnum())


def align(item: np.ndarray, text: np.ndarray, d: int, k: int) -> tuple[int, int, int] | None:
    """(start, end, distance) of the best place of an item whose matches lie on the diagonals d to d + 2k + 1, if within k edits.

    Only diagonals that such a place can reach, k to either side, are computed.
    """
    m = len(item)
    lo, hi = max(0, d - k), min(len(text), d + 3 * k + 2 + m)
    at = _find(item, text[lo:hi])
    if at is not None:
        return lo + at, lo + at + m, 0
    last = _band(item, text, d - k, 4 * k + 2, np.zeros(4 * k + 2, np.int64), k)
    if last is None or last.min() > k:
        return None
    end = min(len(text), d - k + m + int(np.argmin(last)))
    first = np.abs(np.arange(-k, k + 1))
    first[:k] = 2 * k + 2  # the reversed item starts where the place ends
    back = _band(item[::-1], text[:end][::-1], -k, 2 * k + 1, first, k)
    return max(0, end - (m - k + int(np.argmin(back)))), end, int(last.min())


def _find(item: np.ndarray, text: np.ndarray) -> int | None:
    where, what = text.tobytes(), item.tobytes()
    at = where.find(what)
    while at % 4 and at >= 0:
        at = where.find(what, at + 1)
    return at // 4 if at >= 0 else None


def _band(item: np.ndarray, text: np.ndarray, d: int, width: int, row: np.ndarray, k: int) -> np.ndarray | None:
    """Costs at the item's end on the diagonals d to d + width - 1, from those at its start; a row that is all beyond k ends it.

    Positions outside the text match nothing, which costs as much as leaving the item's character out.
    """
    m = len(item)
    near = np.full(m + width, 0xFFFFFFFF, np.uint32)
    lo, hi = max(0, d), min(len(text), d + m + width)
    if hi > lo:
        near[lo - d : hi - d] = text[lo:hi]
    step, new = np.arange(width), np.empty(width, np.int64)
    for i, c in enumerate(item):
        np.add(row, near[i : i + width] != c, out=new)
        np.minimum(new[:-1], row[1:] + 1, out=new[:-1])
        row = np.minimum.accumulate(new - step) + step
        if row.min() > k:
            return None
    return row


def search_text(block: Items, text: str, segment: int) -> list[tuple[int, int, int, int]]:
    """(item id, start, end, distance) of a block of items, in positions of the original text."""
    a, at = normalise(text)
    out = []
    overlap = 3 * block.longest + 64
    found: dict = {}
    for lo in range(0, max(1, len(a)), segment):
        for o, s, e, dist in block.search(a[lo : lo + segment + overlap]):
            found[(o, s + lo, e + lo)] = dist
    taken: list = []
    for (o, s, e), dist in sorted(found.items(), key=lambda x: (x[0][0], x[1], x[0][1])):
        if not taken or taken[-1][0] != o or s >= taken[-1][2]:
            taken.append((o, s, e, dist))
    out += [(block.ids[o], int(at[s]), int(at[e - 1]) + 1, dist) for o, s, e, dist in _regions(block, taken)]
    last: dict = {}
    for lo in range(0, len(a), segment):
        for number, item_id, s, e in block.search_short(a, lo, min(len(a), lo + segment)):
            if s >= last.get(number, 0):
                last[number] = e
                out.append((item_id, int(at[s]), int(at[e - 1]) + 1, 0))
    return out


def _regions(block: Items, taken: list) -> list:
    """The places of whole items, and the windows that meet none of them, joined where those of an item meet."""
    whole = [x for x in taken if block.whole[x[0]]]
    out: list = []
    for o, s, e, dist in sorted((x for x in taken if not block.whole[x[0]]), key=lambda x: (block.item[x[0]], x[1], x[2])):
        before = out[-1] if out and block.item[out[-1][0]] == block.item[o] else None
        if before and s < before[2]:
            out[-1] = (before[0], before[1], max(e, before[2]), min(dist, before[3]))
        else:
            out.append((o, s, e, dist))
    # the places of a whole item do not overlap each other, so the one that ends first after a window's start decides
    by_item: dict[int, list] = {}
    for x in whole:
        by_item.setdefault(block.item[x[0]], []).append(x)
    rest = []
    for x in out:
        places = by_item.get(block.item[x[0]], [])
        at = bisect_right(places, x[1], key=lambda w: w[2])
        if at == len(places) or places[at][1] >= x[2]:
            rest.append(x)
    return whole + rest


@dataclass
class _Blocks:
    """The benchmark in blocks of items, of which one at a time is on the driver and broadcast."""

    benchmark: DataFrame
    item_id: str
    text: str
    q: int
    edit_rate: float
    min_chars: int
    window_chars: int
    block_chars: int

    def __post_init__(self):
        self.rows = self.benchmark.select(F.col(self.item_id).cast("long").alias("item_id"), F.col(self.text).alias("text")).where("text is not null")
        total = self.rows.agg(F.sum(F.length("text") * F.when(F.length("text") > self.window_chars, 3).otherwise(1))).first()[0] or 0
        self.n = max(1, -(-total // self.block_chars))

    def broadcast(self, k: int):
        part = self.rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(self.n)) == k).collect()
        return self.benchmark.sparkSession.sparkContext.broadcast(Items([tuple(r) for r in part], self.q, self.edit_rate, self.min_chars, self.window_chars))


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", q: int = 12, edit_rate: float = 0.06, min_chars: int = 40, window_chars: int = 160, block_chars: int = 2 << 20, segment: int = 1 << 18) -> DataFrame:
    """(doc_id, item_id, start, end, distance) of every region of a document within the edit budget of an item."""
    blocks = _Blocks(benchmark, item_id, item_text, q, edit_rate, min_chars, window_chars, block_chars)
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("distance", pa.int64())])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def found(items) -> DataFrame:
        def find(batches):
            for batch in batches:
                out = [(d, *x) for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) if t.as_py() for x in search_text(items.value, t.as_py(), segment)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)] if out else [pa.array([], f.type) for f in schema], schema=schema)

        return rows.mapInArrow(find, LEAKS)

    return _each(blocks, lambda items, so_far: found(items) if so_far is None else so_far.unionByName(found(items)))


def without_leaks(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", q: int = 12, edit_rate: float = 0.06, min_chars: int = 40, window_chars: int = 160, block_chars: int = 2 << 20, segment: int = 1 << 18) -> DataFrame:
    """The documents without those that have a leak, all columns as they are."""
    blocks = _Blocks(benchmark, item_id, item_text, q, edit_rate, min_chars, window_chars, block_chars)

    def left(items, so_far: DataFrame | None) -> DataFrame:
        def keep(batches):
            for batch in batches:
                yield batch.filter(pa.array([not (t.as_py() and search_text(items.value, t.as_py(), segment)) for t in batch.column(batch.schema.get_field_index(text))], pa.bool_()))

        return (docs if so_far is None else so_far).mapInArrow(keep, docs.schema)

    return _each(blocks, left)


def _each(blocks: _Blocks, step) -> DataFrame:
    """The step for each block; between two blocks the result is written and the block's broadcast ends."""
    out = None
    for k in range(blocks.n):
        items = blocks.broadcast(k)
        before, out = out, step(items, out)
        if blocks.n > 1:
            out = written(out, "leaks")
            items.unpersist()
            if before is not None:
                dropped(before)
    return out
