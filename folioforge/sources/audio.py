"""Audio files as tables, read by byte ranges: tags of FLAC and MP4 files, and the samples of WAV files in chunks.

``register`` makes three formats known to Spark: ``audio_tags`` (a row a tag; the reader walks metadata blocks or nested
atoms and never touches a sample), ``pcm_chunks`` (a row a chunk of samples; a large file is split over tasks), and the
sink ``named_files`` (a file a row, under its name once the job commits).

What cannot be read is a row of kind ``error`` with its reason, or gives no tag; nothing stops the others.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, StructType

from folioforge.sources.listing import listed, tasks
from folioforge.sources.shared import opened

Read = Callable[[int, int], bytes]
TAGS = "file string, kind string, field string, value string, ord int, bytes_read long"
SUFFIXES = (".flac", ".mp4", ".m4a", ".m4b")
CHUNKS = "file string, rate int, chunk long, start_sample long, n_samples int, samples array<float>"
#: FLAC's kinds of metadata blocks, and the atoms on the way to MP4's tags.
STREAM_INFO, VORBIS_COMMENT = 0, 4
TAG_PATH = (b"moov", b"udta", b"meta", b"ilst")


# ---------------------------------------------------------------- FLAC


def _flac_blocks(read: Read) -> Iterator[tuple[int, int, int, bool]]:
    """(kind, offset, length, last) of each metadata block."""
    at = 0
    head = read(0, 10)
    if head[:3] == b"ID3":  # tags of another kind before the file proper
        at = 10 + sum((b & 0x7F) << s for b, s in zip(head[6:10], (21, 14, 7, 0), strict=True))
    if read(at, 4) != b"fLaC":
        raise ValueError("no FLAC file")
    at += 4
    while True:
        head = read(at, 4)
        if len(head) < 4:
            raise ValueError("metadata ends early")
        yield head[0] & 0x7F, at + 4, int.from_bytes(head[1:], "big"), bool(head[0] & 0x80)
        if head[0] & 0x80:
            return
        at += 4 + int.from_bytes(head[1:], "big")


def _comments(block: bytes) -> tuple[bytes, list[bytes]]:
    """(vendor, comments) of a block of Vorbis comments."""
    n = struct.unpack_from("<I", block)[0]
    vendor, at, out = block[4 : 4 + n], 4 + n, []
    for _ in range(struct.unpack_from("<I", block, at)[0]):
        n = struct.unpack_from("<I", block, at + 4)[0]
        out.append(block[at + 8 : at + 8 + n])
        at += 4 + n
    return vendor, out


def flac_tags(read: Read) -> list[tuple[str, str]]:
    """(FIELD, value) in their order."""
    for kind, at, n, _ in _flac_blocks(read):
        if kind == VORBIS_COMMENT:
            parts = (c.decode("utf-8", "replace").partition("=") for c in _comments(read(at, n))[1])
            return [(k.upper(), v) for k, sign, v in parts if sign]
    return []


def _block(kind: int, body: bytes, last: bool) -> bytes:
    return bytes([kind | (0x80 if last else 0)]) + len(body).to_bytes(3, "big") + body


def flac_file(rate: int, n_samples: int, frames: bytes, bits: int = 16) -> bytes:
    """A file of one channel with its stream's description and encoded frames."""
    packed = (rate << 44) | ((bits - 1) << 36) | n_samples
    return b"fLaC" + _block(STREAM_INFO, struct.pack(">HH", 4096, 4096) + bytes(6) + packed.to_bytes(8, "big") + bytes(16), True) + frames


def flac_with_tag(data: bytes, field: str, value: str) -> bytes:
    """The file with one value of the field, whatever it had."""
    read = lambda at, n: data[at : at + n]
    field, kept, vendor, comments, first, end = field.upper(), [], b"", [], None, 0
    for kind, at, n, _ in _flac_blocks(read):
        first = at - 4 if first is None else first
        end = at + n
        if kind == VORBIS_COMMENT:
            vendor, comments = _comments(read(at, n))
        else:
            kept.append((kind, read(at, n)))
    comments = [c for c in comments if c.partition(b"=")[0].decode("utf-8", "replace").upper() != field] + [f"{field}={value}".encode()]
    body = struct.pack("<I", len(vendor)) + vendor + struct.pack("<I", len(comments)) + b"".join(struct.pack("<I", len(c)) + c for c in comments)
    return data[:first] + b"".join(_block(k, b, False) for k, b in kept) + _block(VORBIS_COMMENT, body, True) + data[end:]


# ---------------------------------------------------------------- MP4


def _atoms(read: Read, at: int, end: int) -> Iterator[tuple[bytes, int, int, int]]:
    """(name, where it begins, where its content begins, where it ends) of the atoms of a range."""
    while at + 8 <= end:
        head = read(at, 16)
        if len(head) < 8:
            raise ValueError("atom ends early")
        size, name, body = int.from_bytes(head[:4], "big"), head[4:8], 8
        if size == 1:
            size, body = int.from_bytes(head[8:16], "big"), 16
        size = size or end - at
        if size < body or at + size > end:
            raise ValueError("atom of a wrong size")
        yield name, at, at + body, at + size
        at += size


def _tag_list(read: Read, size: int) -> list[tuple[int, int, int]]:
    """(begin, content, end) of each atom on the way to the tags, as far as it goes."""
    out, begin, end = [], 0, size
    for name in TAG_PATH:
        found = next(((b, c, e) for n, b, c, e in _atoms(read, begin, end) if n == name), None)
        if found is None:
            break
        out.append(found)
        begin, end = found[1] + 4 * (name == b"meta"), found[2]
    return out


def _freeform(read: Read, at: int, end: int) -> tuple[str, str, str | None]:
    """(mean, name, value) of a free-form tag."""
    found = {n: read(c, e - c) for n, _, c, e in _atoms(read, at, end)}
    text = lambda n, skip: found.get(n, b"")[skip:].decode("utf-8", "replace")
    return text(b"mean", 4), text(b"name", 4), text(b"data", 8) if b"data" in found else None


def mp4_tags(read: Read, size: int) -> list[tuple[str, str]]:
    """(``----:mean:name`` or the atom's name, value) in their order."""
    way = _tag_list(read, size)
    if not way:
        raise ValueError("no MP4 file")
    if len(way) < len(TAG_PATH):
        return []
    out = []
    for name, _, content, end in _atoms(read, way[-1][1], way[-1][2]):
        if name == b"----":
            mean, tag, value = _freeform(read, content, end)
            out += [(f"----:{mean}:{tag}", value)] if value is not None else []
        else:
            out += [(name.decode("latin-1"), read(c + 8, e - c - 8).decode("utf-8", "replace")) for n, _, c, e in _atoms(read, content, end) if n == b"data"][:1]
    return out


def atom(name: bytes, body: bytes) -> bytes:
    return (len(body) + 8).to_bytes(4, "big") + name + body


def mp4_with_tag(data: bytes, mean: str, tag: str, value: str) -> bytes:
    """The file with one free-form value of (mean, tag), whatever it had; places of samples behind it are moved."""
    read = lambda at, n: data[at : at + n]
    way = _tag_list(read, len(data))
    if not way:
        raise ValueError("no MP4 file")
    new = atom(b"----", atom(b"mean", bytes(4) + mean.encode()) + atom(b"name", bytes(4) + tag.encode()) + atom(b"data", (1).to_bytes(4, "big") + bytes(4) + value.encode()))
    if len(way) == len(TAG_PATH):
        kept = b"".join(data[b:e] for n, b, c, e in _atoms(read, way[-1][1], way[-1][2]) if n != b"----" or _freeform(read, c, e)[:2] != (mean, tag))
    else:
        kept = b""
    inner = atom(b"ilst", kept + new)
    for k in range(len(TAG_PATH) - 2, -1, -1):  # around it what was there, or a new atom
        if k < len(way):
            begin, content, end = way[k]
            child = way[k + 1] if k + 1 < len(way) else (end, end, end)
            inner = atom(TAG_PATH[k], data[content : child[0]] + inner + data[child[2] : end])
        else:
            inner = atom(TAG_PATH[k], bytes(4) * (TAG_PATH[k] == b"meta") + inner)
    begin, _, end = way[0]
    out, moved = data[:begin] + inner + data[end:], len(inner) - (end - begin)
    return _moved(out, begin, begin + len(inner), end, moved) if moved else out


def _moved(data: bytes, begin: int, end: int, after: int, by: int) -> bytes:
    """Chunk offsets in the atom [begin, end) that pointed behind ``after`` go on by so much."""
    out, read = bytearray(data), lambda at, n: data[at : at + n]

    def walk(a: int, b: int) -> None:
        for name, _, content, stop in _atoms(read, a, b):
            if name in (b"moov", b"trak", b"mdia", b"minf", b"stbl"):
                walk(content, stop)
            elif name in (b"stco", b"co64"):
                w = 4 if name == b"stco" else 8
                for k in range(int.from_bytes(read(content + 4, 4), "big")):
                    at = content + 8 + k * w
                    old = int.from_bytes(read(at, w), "big")
                    out[at : at + w] = (old + by if old >= after else old).to_bytes(w, "big")

    walk(begin, end)
    return bytes(out)


# ---------------------------------------------------------------- tags as columns


def _tagger(write: Callable[[bytes, str], bytes]) -> Callable:
    @F.pandas_udf(BinaryType())
    def tagged(data: pd.Series, value: pd.Series) -> pd.Series:
        def one(d: bytes | None, v: str | None) -> bytes | None:
            try:
                return None if d is None or v is None else write(bytes(d), v)
            except (ValueError, struct.error):
                return None

        return pd.Series([one(d, v) for d, v in zip(data, value, strict=True)])

    return tagged


def with_flac_tag(content: Column, field: str, value: Column) -> Column:
    """The files' content with a tag set; null where it is no FLAC file."""
    return _tagger(lambda d, v: flac_with_tag(d, field, v))(content, value)


def with_mp4_tag(content: Column, mean: str, tag: str, value: Column) -> Column:
    """The files' content with a free-form tag set; null where it is no MP4 file."""
    return _tagger(lambda d, v: mp4_with_tag(d, mean, tag, v))(content, value)


# ---------------------------------------------------------------- readers


@dataclass
class _Files(InputPartition):
    files: list[str]


@dataclass
class _Span(InputPartition):
    file: str
    first: int  # chunks
    last: int


class _Ranges:
    """A file read by ranges, with the bytes counted."""

    def __init__(self, file_system, path: str):
        self.file, self.bytes = file_system.open_input_file(path), 0
        self.size = self.file.size()

    def __call__(self, at: int, n: int) -> bytes:
        out = self.file.read_at(max(0, min(n, self.size - at)), at) if at < self.size else b""
        self.bytes += len(out)
        return out


def _listed(folder: str, suffixes: tuple[str, ...]) -> list[str]:
    from pyarrow import fs

    file_system, path = opened(folder)
    found = file_system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
    return sorted(f.path for f in found if f.is_file and f.path.lower().endswith(suffixes))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.options = options["path"], options


def _tag_rows(file_system, path: str) -> Iterator[tuple]:
    read, flac, name = _Ranges(file_system, path), path.lower().endswith(".flac"), path.rsplit("/", 1)[-1]
    try:
        tags = flac_tags(read) if flac else mp4_tags(read, read.size)
    except (ValueError, struct.error) as e:
        yield name, "error", None, str(e), 0, read.bytes
        return
    yield from ((name, "flac" if flac else "mp4", k, v, i, read.bytes) for i, (k, v) in enumerate(tags))


def tags(spark: SparkSession, folder: str) -> DataFrame:
    """What the format ``audio_tags`` gives, of a folder that tasks list: the driver sees no file."""

    def read(paths: Iterator[str]) -> Iterator[tuple]:
        file_system, _ = opened(folder.removesuffix("/*"))
        return (row for path in paths for row in _tag_rows(file_system, path))

    return _by_file(listed(spark, folder, SUFFIXES), read, TAGS)


class TagReader(_Reader):
    def partitions(self) -> list[InputPartition]:
        files, n = _listed(self.folder, SUFFIXES), int(self.options.get("filespertask", 256))
        return [_Files(files[k : k + n]) for k in range(0, len(files), n)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        file_system, _ = opened(self.folder)
        for path in partition.files:
            yield from _tag_rows(file_system, path)


class AudioTags(DataSource):
    """(file, kind, field, value, ord, bytes_read) of the tags of a folder's FLAC and MP4 files.

    Options: path; filespertask (256).
    """

    @classmethod
    def name(cls) -> str:
        return "audio_tags"

    def schema(self) -> str:
        return TAGS

    def reader(self, schema) -> TagReader:
        return TagReader(dict(self.options))


@dataclass
class _Wave:
    rate: int
    channels: int
    bits: int
    floats: bool
    at: int
    n: int  # samples of each channel


def wave_layout(read: Read, size: int) -> _Wave:
    """Where the samples of a WAV file are, and their kind."""
    head = read(0, 12)
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError("no WAV file")
    at, kind = 12, None
    while at + 8 <= size:
        name, n = read(at, 4), int.from_bytes(read(at + 4, 4), "little")
        if name == b"fmt ":
            f = read(at + 8, min(n, 40))
            kind = struct.unpack_from("<HHIIHH", f)
            code = struct.unpack_from("<H", f, 24)[0] if kind[0] == 0xFFFE and len(f) >= 26 else kind[0]
        elif name == b"data":
            if kind is None or code not in (1, 3) or kind[5] not in ((8, 16, 24, 32) if code == 1 else (32, 64)) or not kind[1] or not kind[2]:
                raise ValueError("samples of an unknown kind")
            n = min(n, size - at - 8)
            return _Wave(kind[2], kind[1], kind[5], code == 3, at + 8, n // (kind[1] * kind[5] // 8))
        at += 8 + n + n % 2
    raise ValueError("no samples")


def wave_file(samples: np.ndarray, rate: int) -> bytes:
    """A WAV file of one channel of 16-bit samples."""
    data = samples.astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16) + b"data" + struct.pack("<I", len(data)) + data


def _mono(data: bytes, w: _Wave) -> np.ndarray:
    """Samples as floats between -1 and 1, the mean of the channels."""
    if w.floats:
        x = np.frombuffer(data, f"<f{w.bits // 8}").astype(np.float32)
    elif w.bits == 24:
        b = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        x = (((b[:, 0] | (b[:, 1] << 8) | (b[:, 2] << 16)) ^ 0x800000) - 0x800000).astype(np.float32) / (1 << 23)
    elif w.bits == 8:
        x = (np.frombuffer(data, np.uint8).astype(np.float32) - 128) / 128
    else:
        x = np.frombuffer(data, f"<i{w.bits // 8}").astype(np.float32) / (1 << (w.bits - 1))
    return x.reshape(-1, w.channels).mean(1) if w.channels > 1 else x


class ChunkReader(_Reader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.chunk, self.split = int(options.get("chunksamples", 24000)), int(options.get("splitsamples", 1 << 24))

    def partitions(self) -> list[InputPartition]:
        file_system, out = opened(self.folder)[0], []
        for path in _listed(self.folder, (".wav",)):
            read = _Ranges(file_system, path)
            try:
                chunks = -(-wave_layout(read, read.size).n // self.chunk)
            except (ValueError, struct.error):
                continue
            each = max(1, self.split // self.chunk)
            out += [_Span(path, k, min(k + each, chunks)) for k in range(0, chunks, each)]
        return out or [_Span("", 0, 0)]

    def read(self, partition: _Span) -> Iterator[tuple]:
        if partition.file:
            yield from _chunk_rows(_Ranges(opened(self.folder)[0], partition.file), partition, self.chunk)


def _chunk_rows(read: _Ranges, span: _Span, chunk: int) -> Iterator[tuple]:
    w = wave_layout(read, read.size)
    frame = w.channels * w.bits // 8
    for k in range(span.first, span.last):
        start = k * chunk
        n = min(chunk, w.n - start)
        x = _mono(read(w.at + start * frame, n * frame), w)
        yield span.file.rsplit("/", 1)[-1], w.rate, k, start, n, x.tolist()


def pcm_chunks(spark: SparkSession, folder: str, chunk: int = 24000, split: int = 1 << 24) -> DataFrame:
    """What the format ``pcm_chunks`` gives, of a folder that tasks list; files are measured by tasks and dealt as spans of ``split`` samples."""
    each = max(1, split // chunk)

    def spans(paths: Iterator[str]) -> Iterator[tuple]:
        file_system, _ = opened(folder.removesuffix("/*"))
        for path in paths:
            read = _Ranges(file_system, path)
            try:
                n = -(-wave_layout(read, read.size).n // chunk)
            except (ValueError, struct.error):
                continue
            yield from ((path, k, min(k + each, n)) for k in range(0, n, each))

    def samples(rows: Iterator[tuple]) -> Iterator[tuple]:
        file_system, at, read = opened(folder.removesuffix("/*"))[0], None, None
        for path, first, last in rows:
            at, read = path, read if path == at else _Ranges(file_system, path)
            yield from _chunk_rows(read, _Span(path, first, last), chunk)

    found = _by_file(listed(spark, folder, (".wav",)), spans, "path string, first long, last long")
    return _by_rows(found.repartition(tasks(spark), "path", "first"), samples, CHUNKS)


def _by_file(files: DataFrame, read: Callable[[Iterator[str]], Iterator[tuple]], schema: str) -> DataFrame:
    return _by_rows(files.select("path"), lambda rows: read(path for (path,) in rows), schema)


def _by_rows(rows: DataFrame, read: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """What ``read`` makes of a task's rows, in batches of a thousand."""
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = read(tuple(r.values()) for batch in batches for r in batch.to_pylist())
        while part := list(islice(found, 1000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), kind, strict=True)], schema=kind)

    return rows.mapInArrow(run, schema)


class PcmChunks(DataSource):
    """(file, rate, chunk, start_sample, n_samples, samples) of a folder's WAV files, in mono.

    Options: path; chunksamples (24,000), the samples of a row; splitsamples (2**24), those of a task.
    """

    @classmethod
    def name(cls) -> str:
        return "pcm_chunks"

    def schema(self) -> str:
        return CHUNKS

    def reader(self, schema) -> ChunkReader:
        return ChunkReader(dict(self.options))


@dataclass
class _Written(WriterCommitMessage):
    moves: list[tuple[str, str]]  # temporary and final path of files, or of a task's folder


class FileWriter(DataSourceWriter):
    """Tasks write under names of their own attempt; the commit gives what successful tasks wrote its names.

    With folders a task's files stay in one folder, so the commit is one move a task and the driver sees no file.
    """

    def __init__(self, options: dict):
        self.folder, self.folders = options["path"], options.get("taskfolders", "false").lower() == "true"

    def write(self, rows) -> _Written:
        file_system, path = opened(self.folder)
        file_system.create_dir(path, recursive=True)
        attempt, out, made = uuid.uuid4().hex, [], set()
        for k, row in enumerate(rows):
            hidden = f"{path}/.{attempt}/{row['file']}" if self.folders else f"{path}/.{attempt}-{k}"
            parent = hidden.rsplit("/", 1)[0]
            if self.folders and parent not in made:
                file_system.create_dir(parent, recursive=True)
                made.add(parent) if len(made) < 1 << 16 else None
            with file_system.open_output_stream(hidden) as f:
                f.write(bytes(row["content"]))
            if not self.folders:
                out.append((hidden, f"{path}/{row['file']}"))
            elif not out:
                out.append((f"{path}/.{attempt}", f"{path}/{attempt}"))
        return _Written(out)

    def commit(self, messages: list[_Written | None]) -> None:
        file_system, _ = opened(self.folder)
        for m in messages:
            for hidden, final in m.moves if m else []:
                file_system.create_dir(final.rsplit("/", 1)[0], recursive=True)
                file_system.move(hidden, final)

    def abort(self, messages: list[_Written | None]) -> None:
        file_system, _ = opened(self.folder)
        for m in messages:
            for hidden, _ in m.moves if m else []:
                file_system.delete_dir(hidden) if self.folders else file_system.delete_file(hidden)


class NamedFiles(DataSource):
    """A sink of rows (file, content): a file each in the folder ``path``, or in folders below it that its name has.

    Option taskFolders: each task's files in a folder of its own below ``path``, for very many files.
    """

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "file string, content binary"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the formats known to a session."""
    for source in (AudioTags, PcmChunks, NamedFiles):
        spark.dataSource.register(source)
