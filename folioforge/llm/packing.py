"""Packing of tokenised documents into sequences by bounded-space online best-fit.

Each task tokenises its documents and places every piece at once into the open sequence whose free space fits best. The
free spaces of the open sequences are bits of one integer, so the least space of at least ``length`` is the lowest bit
above it. At most ``open_bins`` sequences are open: where none fits and no more may open, the fullest closes. A piece
that fills a sequence closes it. The token ids of an open sequence stay in the task until it closes, so what is held
is ``open_bins * room`` ids however large the partition, and a closed sequence is final when it is written.

Sequences still open when a task ends are not kept as they are: their pieces are dealt to groups of about
``repack_tokens`` tokens and packed again in the same way, so that only the last open sequences of a whole group stay
partly empty. On the share of them that is left: one group of 2**24 tokens fills 8,192 sequences and ends with at most
``open_bins`` open ones.

Only documents longer than ``room`` are cut, into pieces of ``room`` ids with a shorter last one. ``end_id`` follows
each document. Words between blanks are looked up, as the vocabulary's normaliser and its splitting never reach across
white space. A word not seen before is split into the vocabulary's pieces, which are looked up, too, and else tokenised
by the library's model; a word with other signs than Latin letters, digits and punctuation goes to the library whole.
Tests hold the ids against those of whole texts.

Edge cases: a null or empty text is the end id alone; a null id stays null; rows may repeat, each is packed; very long
texts are tokenised in slices cut at blanks; extra columns are left out of the result.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import written

PIECES = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long, open boolean"
_TYPES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("open", pa.bool_())])


class OpenBins:
    """Open sequences by free space. ``place`` returns the sequences that it closed, each a list of (item, offset)."""

    def __init__(self, room: int, most: int):
        self.room, self.most, self.n = room, most, 0
        self.bits = 0  # bit f is set while a sequence with f free places is open
        self.with_free: list[list[list]] = [[] for _ in range(room + 1)]

    def _take(self, free: int) -> list:
        bins = self.with_free[free]
        taken = bins.pop()
        if not bins:
            self.bits ^= 1 << free
        self.n -= 1
        return taken

    def place(self, length: int, item) -> list[list]:
        closed, above = [], self.bits >> length
        if above:
            free = length + (above & -above).bit_length() - 1
            into = self._take(free)
        else:
            free, into = self.room, []
            if self.n >= self.most and length < self.room:
                closed.append(self._take((self.bits & -self.bits).bit_length() - 1))
        into.append((item, self.room - free))
        free -= length
        if free == 0:
            closed.append(into)
        else:
            self.with_free[free].append(into)
            self.bits |= 1 << free
            self.n += 1
        return closed

    def rest(self) -> list[list]:
        return [b for bins in self.with_free for b in bins]


#: Words of these signs need no normal form but small letters, and are split by ``_PIECE``; others go to the library whole.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ‘’“”…–—]*")
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
#: Bytes as the signs of a byte-level vocabulary: those that print stand for themselves, the others follow from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SIGNS = {b: chr(b) for b in _PRINTED} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}


class _Cache(dict):
    """Ids of words or of their pieces as bytes; what is not there is made, and all is forgotten at ``most`` entries."""

    def __init__(self, make, most: int = 1 << 19, longest: int = 64):
        self.make, self.most, self.longest = make, most, longest

    def __missing__(self, key: str) -> bytes:
        ids = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[key] = ids
        return ids


@lru_cache(maxsize=2)
def words_of(tokenizer_file: str) -> _Cache:
    """The ids of a word without blanks: by the library, or piece by piece by the library's model."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    model, special = tokenizer.model, re.compile("|".join(re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values()) or r"(?!)")
    pack = lambda ids: np.array(ids, "<u4").tobytes()
    pieces = _Cache(lambda piece: pack([t.id for t in model.tokenize("".join(map(_SIGNS.__getitem__, piece.encode())))]))

    def make(word: str) -> bytes:
        if len(word) <= 64 and _PLAIN.fullmatch(word) and not special.search(word):
            return b"".join(map(pieces.__getitem__, _PIECE.findall(word.lower())))
        return pack(tokenizer.encode(word, add_special_tokens=False).ids)

    return _Cache(make)


def token_ids(words: _Cache, text: str, at_once: int = 1 << 20) -> np.ndarray:
    """The ids of a text, slice by slice; a slice ends at a blank."""
    parts, k = [], 0
    while k < len(text):
        end = len(text) if len(text) - k <= at_once else text.find(" ", k + at_once)
        end = len(text) if end < 0 else end
        parts.append(b"".join(map(words.__getitem__, text[k:end].replace("\n", " ").split(" "))))
        k = end
    return np.frombuffer(b"".join(parts), "<u4")


def _packed(pieces: Iterator[tuple], room: int, open_bins: int, first_id: int, marks_open: bool, at_once: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Rows of closed sequences as they close, and those of the open ones at the end."""
    bins, out, held, number = OpenBins(room, open_bins), [], 0, first_id

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _TYPES, strict=True)] if out else [pa.array([], f.type) for f in _TYPES], schema=_TYPES)

    def emit(closed: list[list], is_open: bool) -> None:
        nonlocal held, number
        for sequence in closed:
            for (doc_id, piece, start, length, ids), offset in sequence:
                out.append((doc_id, piece, start, length, ids, number, offset, is_open))
                held += length
            number += 1

    for item in pieces:
        emit(bins.place(item[3], item), False)
        if held >= at_once:
            yield batch()
            out, held = [], 0
    for sequence in bins.rest():
        emit([sequence], marks_open)
        if held >= at_once:
            yield batch()
            out, held = [], 0
    yield batch()


def pack_documents(docs: DataFrame, tokenizer_file: str, *, id_col: str = "doc_id", text: str = "text", room: int = 2048, end_id: int = 0, open_bins: int = 256, repack_tokens: int = 1 << 24) -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset) of every piece; ids are little-endian unsigned 32-bit.

    ``start`` counts the document's ids before the piece, ``offset`` is its place in the sequence, gapless from 0.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def pieces_of(batches) -> Iterator[tuple]:
        words, end = words_of(tokenizer_file), np.array([end_id], "<u4")
        for batch in batches:
            for doc_id, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.concatenate([token_ids(words, t.as_py()), end])
                for piece, start in enumerate(range(0, len(ids), room)):
                    part = ids[start : start + room]
                    yield doc_id, piece, start, len(part), part.tobytes()

    def pack(batches):
        yield from _packed(pieces_of(batches), room, open_bins, TaskContext.get().partitionId() << 32, True)

    def pack_again(batches):
        found = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "piece", "start", "length", "ids")), strict=True))
        yield from _packed(found, room, open_bins, (1 << 62) | (TaskContext.get().partitionId() << 32), False)

    first = written(rows.mapInArrow(pack, PIECES), "packed", "open")
    closed, left = first.where("not open").drop("open"), first.where("open").drop("open")
    tokens = left.agg(F.sum("length")).first()[0] or 0
    if not tokens:
        return closed
    deal = F.xxhash64("doc_id", "piece", "sequence_id", "offset")
    left = left.repartition(max(1, -(-tokens // repack_tokens)), deal).sortWithinPartitions(deal, "sequence_id", "offset")
    return closed.unionByName(left.mapInArrow(pack_again, PIECES).drop("open"))
