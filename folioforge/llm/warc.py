"""WARC archives: a deterministic sharded writer and its reader.

Writing: records are range-sorted by id, each task streams its range into gzip members (one per record) and rolls
a file when its compressed size passes ``roll_bytes``. Headers are made anew, with SHA-256 digests of block and
payload. A file is written under a temporary name that no other attempt uses and renamed when it is whole, to a name
with its content's digest, so that no attempt ever removes or changes another one's file; then its line enters the manifest, a Parquet table that Spark commits after all tasks. A reader takes what the
manifest names, so files of lost or repeated attempts don't count, and a repeated task writes the same bytes.

Of records with equal payloads of at least ``revisit_bytes``, the one with the smallest id is a ``response`` and
the others are ``revisit`` records that refer to it. Which ids those are is found on digests alone; the payloads
cross the network once, in the range sort, and meet their mark there as the row before them.

Edge cases: a null or empty payload is an empty one; a null url has no target header; rows that repeat an id keep
a record each (the same payload under the same id is a plain repeat, not a revisit of itself, and stays a response);
a null id sorts first, has no id header and is never a revisit; an empty table gives an empty manifest.
Memory: one record, one compressed member.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.common import file_system, new_folder

MANIFEST = "shard int, seq int, file string, file_bytes long, records long, first_id long, last_id long, sha256 string"
RECORD = "id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, block_ok boolean"
DATE = "2020-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def record_uri(i: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'folioforge:page:{i}')}>"


def record_bytes(i: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One record: regenerated headers, block and end."""
    http = HTTP % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_uri(i)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if i is not None:
        head.append(f"X-Page-Id: {i}")
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_uri(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def revisits(records: DataFrame, revisit_bytes: int) -> DataFrame:
    """(id, digest, refers_to) of each record whose payload a smaller id has; only ids and digests are shuffled."""
    small = records.where(F.octet_length("payload") >= revisit_bytes).select("id", F.sha2("payload", 256).alias("digest")).where("id is not null")
    first = small.groupBy("digest").agg(F.min("id").alias("refers_to"), F.max("id").alias("last")).where("last > refers_to").drop("last")
    return small.join(first, "digest").where("id > refers_to").select("id", "digest", "refers_to").distinct()


def write_warc(records: DataFrame, folder: str, *, partitions: int, roll_bytes: int = 256 << 20, revisit_bytes: int = 100, level: int = 6, date: str = DATE) -> DataFrame:
    """Write (id, url, payload binary) below ``folder``; the manifest as committed."""
    spark = records.sparkSession
    records = records.select(F.col("id").cast("long").alias("id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("payload"), F.lit(b"")).alias("payload"))
    marks = revisits(records, revisit_bytes).select("id", F.col("digest").alias("url"), F.lit(None).cast("binary").alias("payload"), "refers_to")
    rows = records.withColumn("refers_to", F.lit(None).cast("long")).unionByName(marks)
    # a mark has no payload, and its digest in place of a url; it sorts before the records of its id
    rows = rows.repartitionByRange(partitions, "id").sortWithinPartitions("id", F.col("payload").isNotNull(), "url", F.sha2("payload", 256))

    def write(batches):
        task = TaskContext.get()
        shard, attempt = task.partitionId(), task.taskAttemptId()
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        out = _Shard(fs, base, shard, attempt, roll_bytes, level)
        at, marks = None, {}
        for batch in batches:
            for i, url, payload, refers_to in zip(*(batch.column(n) for n in ("id", "url", "payload", "refers_to")), strict=True):
                i = i.as_py()
                if i != at:
                    at, marks = i, {}
                if not payload.is_valid:
                    marks[url.as_py()] = refers_to.as_py()
                    continue
                payload = payload.as_py()
                digest = hashlib.sha256(payload).hexdigest()
                out.add(i, record_bytes(i, url.as_py(), payload, digest, marks.get(digest), date))
        out.roll()
        yield pa.RecordBatch.from_pylist(out.lines, schema=pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("file_bytes", pa.int64()), ("records", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("sha256", pa.string())]))

    rows.mapInArrow(write, MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


class _Shard:
    """A task's open file; rolls by compressed size."""

    def __init__(self, fs, base: str, shard: int, attempt: int, roll_bytes: int, level: int):
        self.fs, self.base, self.shard, self.attempt, self.roll_bytes, self.level = fs, base, shard, attempt, roll_bytes, level
        self.lines: list[dict] = []
        self.file = None

    def add(self, i: int | None, record: bytes) -> None:
        if self.file is None:
            self.temporary = f"{self.base}/.part-{self.shard:06d}-{len(self.lines):04d}.{self.attempt}.{uuid.uuid4().hex}"
            self.file, self.size, self.records, self.first, self.digest = self.fs.open_output_stream(self.temporary, compression=None), 0, 0, i, hashlib.sha256()
        gz = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        member = gz.compress(record) + gz.flush()
        self.file.write(member)
        self.digest.update(member)
        self.size, self.records, self.last = self.size + len(member), self.records + 1, i
        if self.size >= self.roll_bytes:
            self.roll()

    def roll(self) -> None:
        if self.file is None:
            return
        self.file.close()
        # the name holds the content's digest: what an earlier or a late attempt wrote under it is the same file, and stays
        name = f"part-{self.shard:06d}-{len(self.lines):04d}-{self.digest.hexdigest()[:16]}.warc.gz"
        there = lambda: self.fs.get_file_info(f"{self.base}/{name}").type.name != "NotFound"
        if there():
            self.fs.delete_file(self.temporary)
        else:
            try:
                self.fs.move(self.temporary, f"{self.base}/{name}")
            except OSError:  # another attempt came first
                if not there():
                    raise
                self.fs.delete_file(self.temporary)
        self.lines.append({"shard": self.shard, "seq": len(self.lines), "file": name, "file_bytes": self.size, "records": self.records, "first_id": self.first, "last_id": self.last, "sha256": self.digest.hexdigest()})
        self.file = None


def members(stream, chunk: int = 1 << 20):
    """The gzip members of a stream, one at a time."""
    gz, parts, rest = zlib.decompressobj(31), [], b""
    while True:
        data = rest or stream.read(chunk)
        if not data:
            if parts:
                raise ValueError("the archive ends within a member")
            return
        parts.append(gz.decompress(data))
        rest = gz.unused_data
        if gz.eof:
            yield b"".join(parts)
            gz, parts = zlib.decompressobj(31), []


def parse(record: bytes) -> dict:
    """A record's headers, and its digests made again from its block."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    h = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(h["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    kind = h["WARC-Type"]
    told = h["WARC-Payload-Digest"].removeprefix("sha256:")
    ok = rest[len(block) :] == b"\r\n\r\n" and hashlib.sha256(block).hexdigest() == h["WARC-Block-Digest"].removeprefix("sha256:")
    digest = hashlib.sha256(payload).hexdigest() if kind == "response" else told
    return {
        "id": int(h["X-Page-Id"]) if "X-Page-Id" in h else None,
        "url": h.get("WARC-Target-URI"),
        "record_type": kind,
        "refers_to": int(h["X-Refers-To-Page-Id"]) if "X-Refers-To-Page-Id" in h else None,
        "payload_bytes": len(payload) if kind == "response" else int(h["X-Payload-Length"]),
        "payload_digest": digest,
        "block_ok": ok and digest == told,
    }


def read_warc(spark: SparkSession, folder: str, partitions: int | None = None) -> DataFrame:
    """Every record of the files that the manifest names, streamed member by member."""
    files = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").select("file")
    files = files.repartition(partitions or spark.sparkContext.defaultParallelism, "file")

    def read(batches):
        fs, base = file_system(folder)
        schema = pa.schema([("id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("block_ok", pa.bool_())])
        for batch in batches:
            for name in batch.column("file").to_pylist():
                out = []
                with fs.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for record in members(stream):
                        out.append(parse(record))
                        if len(out) == 2000:
                            yield pa.RecordBatch.from_pylist(out, schema=schema)
                            out = []
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return files.mapInArrow(read, RECORD)


def archive_pages(pages: DataFrame, *, payload: str = "html", id_col: str = "page_id", roll_bytes: int = 256 << 20, folder: str | None = None) -> tuple[str, DataFrame]:
    """(folder, manifest) of a page table's archive."""
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    records = pages.select(F.col(id_col).alias("id"), F.col("url"), F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8").alias("payload"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return folder, write_warc(records, folder, partitions=partitions, roll_bytes=roll_bytes)
