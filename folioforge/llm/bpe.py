"""BPE encoding and decoding with a byte-level vocabulary, by tree concatenation.

A text of up to ``leaf_chars`` code points is encoded at once. A longer one is cut into leaves at any code point
(it may have no white space at all), the leaves are encoded in parallel tasks, and neighbours are joined pair by
pair up a tree. At each join the last w tokens of the left half and the first w of the right are decoded and
encoded again as one window; the window is taken when its encoding starts with ``agree`` tokens of the left half
and ends with ``agree`` tokens of the right half, else w doubles, at most until both halves are encoded whole.
Between the agreeing ends every adjacent pair of tokens is then one that an encoder has put side by side, and a
token sequence whose adjacent pairs are all canonical is the canonical one; tests hold it against whole texts.

The rank file drives the merges (``tiktoken``), several times faster than the JSON vocabulary with equal ids; the
special token's string in a text becomes its id, as a tokenizer with that added token does. Ids are unsigned 32-bit,
little-endian, in a binary column.

Edge cases: a null text is encoded as the empty one; ids no vocabulary entry has raise an error; rows may repeat.
Memory: a task holds one batch of texts, and at a join one text's ids.
"""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

SPECIAL = "<|endoftext|>"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Bpe:
    """A vocabulary in a worker."""

    def __init__(self, ranks_file: str, special: str = SPECIAL, pattern: str = PATTERN):
        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.special = len(ranks)
        self.encoding = tiktoken.Encoding("rank-file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={special: self.special})
        self.bytes = [b""] * (len(ranks) + 1)
        for piece, i in ranks.items():
            self.bytes[i] = piece
        self.bytes[self.special] = special.encode()

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode(text, allowed_special="all")

    def raw(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def decode(self, ids) -> str:
        return self.raw(ids).decode("utf-8", errors="replace")

    def join(self, left: list[int], right: list[int], window: int = 16, agree: int = 4) -> list[int]:
        """The ids of the joined text, from those of its halves."""
        if not left or not right:
            return left or right
        w = window
        while True:
            a, b = max(0, len(left) - w), min(len(right), w)
            a, b = self._whole(left, a, -1), self._whole(right, b, 1)
            mid = self.encode(self.raw(left[a:] + right[:b]).decode())
            at_left = a == 0 or mid[:agree] == left[a : a + agree]
            at_right = b == len(right) or mid[-agree:] == right[b - agree : b]
            if at_left and at_right and (len(mid) > 2 * agree or (a == 0 and b == len(right))):
                return left[:a] + mid + right[b:]
            w *= 2

    def _whole(self, ids: list[int], at: int, step: int) -> int:
        """Move a cut between tokens away from the join until it is between code points."""
        while 0 < at < len(ids) and (self.bytes[ids[at]][0] & 0xC0) == 0x80:
            at += step
        return at


@lru_cache(maxsize=2)
def vocabulary(ranks_file: str) -> Bpe:
    return Bpe(ranks_file)


def pack(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


def unpack(data: bytes) -> list[int]:
    return np.frombuffer(data, dtype="<u4").tolist()


def encode_texts(docs: DataFrame, ranks_file: str, *, id_col: str = "doc_id", text: str = "text", leaf_chars: int = 1 << 15, window: int = 16, agree: int = 4, digest: Callable[[Bpe, list[int]], dict] | None = None, digest_schema: str = "") -> DataFrame:
    """(doc_id, ids binary) of every document; with ``digest``, its columns in place of the ids.

    A digest works on (vocabulary, ids) where they are made, so that ids need not leave the worker.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = "doc_id long, " + (digest_schema if digest else "ids binary")
    done = digest or (lambda _, ids: {"ids": pack(ids)})
    types = to_arrow_schema(_parse_datatype_string(schema))

    def finish(rows: list[tuple[int, list[int]]], bpe: Bpe) -> pa.RecordBatch:
        out = [{"doc_id": d} | done(bpe, ids) for d, ids in rows]
        return pa.RecordBatch.from_pylist(out, schema=types)

    def whole(batches):
        bpe = vocabulary(ranks_file)
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                yield finish([(d, bpe.encode(t)) for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)], bpe)

    long_ones = docs.where(F.length("text") > leaf_chars)
    short = docs.where(F.length("text") <= leaf_chars).mapInArrow(whole, schema)

    # the leaves of the long texts; a row's own number keeps repeated ids apart
    leaves = long_ones.withColumn("row", F.monotonically_increasing_id()).select(
        "doc_id", "row", F.ceil(F.length("text") / leaf_chars).alias("n"), F.posexplode(F.transform(F.sequence(F.lit(0), F.ceil(F.length("text") / leaf_chars).cast("int") - 1), lambda i: F.substring(F.col("text"), i * leaf_chars + 1, F.lit(leaf_chars)))).alias("leaf", "text")
    )
    from folioforge.llm.common import written  # the leaves' rows must keep their numbers if a task is lost

    leaves = written(leaves, "bpe-leaves")
    most = leaves.agg(F.max("n")).first()[0]
    if most is None:
        return short
    node = "doc_id long, row long, leaf long, ids binary"
    node_types = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("leaf", pa.int64()), ("ids", pa.binary())])

    def encode_leaf(batches):
        bpe = vocabulary(ranks_file)
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("doc_id", "row", "leaf", "text")]
            for d, r, k, t in zip(*cols, strict=True):
                yield pa.RecordBatch.from_pylist([{"doc_id": d, "row": r, "leaf": k, "ids": pack(bpe.encode(t))}], schema=node_types)

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tree = leaves.repartition(parts, "row", "leaf").mapInArrow(encode_leaf, node)

    def join_pair(table: pa.Table) -> pa.Table:
        bpe = vocabulary(ranks_file)
        rows = sorted(table.to_pylist(), key=lambda r: r["leaf"])
        ids = unpack(rows[0]["ids"])
        for other in rows[1:]:
            ids = bpe.join(ids, unpack(other["ids"]), window, agree)
        return pa.Table.from_pylist([{"doc_id": rows[0]["doc_id"], "row": rows[0]["row"], "leaf": rows[0]["leaf"] // 2, "ids": pack(ids)}], schema=node_types)

    while most > 1:
        tree = tree.groupBy("row", F.floor(F.col("leaf") / 2).alias("parent")).applyInArrow(join_pair, node)
        most = (most + 1) // 2

    def top(batches):
        bpe = vocabulary(ranks_file)
        for batch in batches:
            for d, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                yield finish([(d, unpack(ids))], bpe)

    return short.unionByName(tree.mapInArrow(top, schema))


def decode_ids(encoded: DataFrame, ranks_file: str, *, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, text) of (doc_id, ids binary)."""

    def decode(batches):
        bpe = vocabulary(ranks_file)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else bpe.decode(unpack(x)) for x in batch.column(1).to_pylist()], pa.string())], names=[id_col, "text"])

    return encoded.select(F.col(id_col).cast("long").alias(id_col), "ids").mapInArrow(decode, f"{id_col} long, text string")
