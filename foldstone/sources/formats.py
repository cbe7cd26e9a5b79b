"""Binary log, segment and index files as Spark data sources, and writers for them.

Layouts are little-endian. ``register(spark)`` makes the formats ``wal``, ``segment`` and ``kvindex`` readable: each file below
the path is one partition, read record by record, as where a record begins shows only from those before. ``chunks`` reads large files of any
kind in pieces, many tasks a file.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from foldstone.functions import lz4

# fixed values: the magics that begin records and files
WAL_MAGIC, BLOB_MAGIC, LZ4_MAGIC = b"WAL1", b"BLOB", b"BLOC"
INDEX_PLAIN, INDEX_TTL = b"KVINDEX2", b"KVINDEX3"
#: Bytes of a large blob's chunk, unless ``option("width", ...)`` says otherwise, and of the chunks that one task reads.
CHUNK, TASK_BYTES = 4 << 20, 128 << 20


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address, and the path within it. Without a scheme it is this machine's: callers give what ``session.qualified`` made of it."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def wal_record(seq: int, op: str, key: str, value: bytes = b"") -> bytes:
    k, v = key.encode(), value if op == "put" else b""
    body = struct.pack("<QBII", seq, 1 if op == "put" else 2, len(k), len(v)) + k + v
    return WAL_MAGIC + body + struct.pack("<I", zlib.crc32(body))


def _opened(data: bytes | BinaryIO) -> BinaryIO:
    return io.BytesIO(data) if isinstance(data, bytes) else data


def read_wal(data: bytes | BinaryIO) -> Iterator[tuple[int, str, str, bytes | None]]:
    """Records up to the first that is cut short, unknown or fails its checksum: a crash tears the tail. A file is read record by record."""
    f = _opened(data)
    while len(head := f.read(21)) == 21 and head[:4] == WAL_MAGIC:
        seq, op, nk, nv = struct.unpack_from("<QBII", head, 4)
        body = f.read(nk + nv + 4)
        if op not in (1, 2) or len(body) < nk + nv + 4 or zlib.crc32(body[:-4], zlib.crc32(head[4:])) != struct.unpack("<I", body[-4:])[0]:
            return
        yield seq, "put" if op == 1 else "delete", body[:nk].decode("utf-8", "replace"), body[nk:-4] if op == 1 else None


def blob_frame(key: str, value: bytes, compress: bool = False) -> bytes:
    """A frame with its checksum; with ``compress``, as an LZ4 block where that is worth it."""
    k, packed = key.encode(), lz4.pack(value) if compress else None
    data = value if packed is None else packed
    body = struct.pack("<IQQ", len(k), len(data), len(value)) + k + data
    return (BLOB_MAGIC if packed is None else LZ4_MAGIC) + body + struct.pack("<I", zlib.crc32(body))


def read_segment(data: bytes | BinaryIO) -> Iterator[tuple[str, int, int, bytes | None, bool]]:
    """``key, offset, size, value, ok`` of each frame up to the first bad magic or torn frame.

    A frame that fails its checksum, or whose LZ4 block is broken, is listed with ``ok`` false and a NULL value; ``size`` is that of
    the value, not of what is stored.
    """
    f, at = _opened(data), 0
    while len(head := f.read(24)) == 24 and head[:4] in (BLOB_MAGIC, LZ4_MAGIC):
        nk, stored, size = struct.unpack_from("<IQQ", head, 4)
        body = f.read(nk + stored + 4)
        if len(body) < nk + stored + 4:
            return
        ok = zlib.crc32(body[:-4], zlib.crc32(head[4:])) == struct.unpack("<I", body[-4:])[0]
        value = body[nk:-4] if ok else None
        if ok and head[:4] == LZ4_MAGIC:
            try:
                value = lz4.unpack(value, size)
            except ValueError:
                value, ok = None, False
        yield body[:nk].decode("utf-8", "replace"), at, size, value, ok
        at += 24 + len(body)


def index_snapshot(entries: Iterable[tuple[str, int, int, int, str, int | None]]) -> bytes:
    rows = list(entries)
    out = [INDEX_TTL, struct.pack("<Q", len(rows))]
    for key, shard, offset, size, digest, expires in rows:
        k, h = key.encode(), digest.encode()
        out.append(struct.pack("<I", len(k)) + k + struct.pack("<QQQI", shard, offset, size, len(h)) + h + struct.pack("<Q", expires or 0))
    return b"".join(out)


def read_index(data: bytes | BinaryIO) -> Iterator[tuple[str, int, int, int, str, int | None]]:
    """Entries of a snapshot with or without expiry; an expiry of 0 means never. A snapshot cut short is an error."""
    f = _opened(data)

    def take(form: str) -> tuple:
        return struct.unpack(form, f.read(struct.calcsize(form)))

    magic = f.read(8)
    if magic not in (INDEX_PLAIN, INDEX_TTL):
        raise ValueError("not an index snapshot")
    (n,) = take("<Q")
    for _ in range(n):
        key = f.read(take("<I")[0]).decode()
        shard, offset, size, nh = take("<QQQI")
        digest = f.read(nh).decode()
        expires = take("<Q")[0] if magic == INDEX_TTL else 0
        yield key, shard, offset, size, digest, expires or None


class _Part(InputPartition):
    """A file, or ``length`` bytes of it from ``start`` on."""

    def __init__(self, path: str, start: int = 0, length: int = 0):
        super().__init__(path)
        self.path, self.start, self.length = path, start, length


class _Reader(DataSourceReader):
    def __init__(self, path: str, decode: str, width: int):
        self.path, self.decode, self.width = path, decode, width

    def partitions(self) -> list[InputPartition]:
        store, path = located(self.path)
        info = store.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else [x for x in sorted(store.get_file_info(fs.FileSelector(path, recursive=True)), key=lambda x: x.path) if x.type == fs.FileType.File]
        if self.decode != "chunks":
            return [_Part(x.path) for x in found]
        step = self.width * max(1, TASK_BYTES // self.width)  # so many whole chunks a task
        return [_Part(x.path, start, min(step, x.size - start)) for x in found for start in range(0, x.size, step)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from foldstone.sources import formats

        store = formats.located(self.path)[0]
        if self.decode == "chunks":
            with store.open_input_file(partition.path) as f:
                f.seek(partition.start)
                for at in range(partition.start, partition.start + partition.length, self.width):
                    yield partition.path, at // self.width, f.read(min(self.width, partition.start + partition.length - at))
            return
        with store.open_input_stream(partition.path, buffer_size=1 << 20) as f:
            yield from getattr(formats, self.decode)(f)


def _source(called: str, columns: str, decode: str) -> type[DataSource]:
    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return called

        def schema(self) -> str:
            return columns

        def reader(self, schema) -> DataSourceReader:
            return _Reader(self.options["path"], decode, int(self.options.get("width", CHUNK)))

    return Source


SOURCES = [
    _source("wal", "seq bigint, op string, key string, value binary", "read_wal"),
    _source("segment", "key string, blob_offset bigint, size bigint, value binary, ok boolean", "read_segment"),
    _source("chunks", "file string, chunk_no bigint, chunk binary", "chunks"),
    _source("kvindex", "key string, shard bigint, blob_offset bigint, size bigint, hash string, expires_at bigint", "read_index"),
]


def register(spark: SparkSession) -> None:
    for source in SOURCES:
        spark.dataSource.register(source)
