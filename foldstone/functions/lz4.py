"""Values as the store keeps them: LZ4 blocks where they are worth it."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values of fewer bytes are kept as they are.
LEAST = 128
_KEPT = pa.struct([("compressed", pa.bool_()), ("size", pa.int64()), ("data", pa.binary())])


def pack(value: bytes) -> bytes | None:
    """The value as an LZ4 block behind its size (4 bytes, little-endian), or None if it is short or that is not smaller."""
    if len(value) < LEAST:
        return None
    packed = struct.pack("<I", len(value)) + pa.compress(value, codec="lz4_raw", asbytes=True)
    return packed if len(packed) < len(value) else None


def _length(block: bytes) -> int:
    """The size a block unpacks to, by its sequences; the codec itself accepts one that is cut short."""
    at = size = 0
    try:
        while True:
            counts = block[at] >> 4, block[at] & 15
            at += 1
            for last, n in enumerate(counts):
                if last and at == len(block):  # a block ends with literals
                    return size
                at += 2 * last
                if n == 15:
                    while (more := block[at]) == 255:
                        n, at = n + 255, at + 1
                    n, at = n + more, at + 1
                size += n + 4 * last
                at += 0 if last else n
                if at > len(block):
                    raise ValueError("broken block")
    except IndexError as e:
        raise ValueError("broken block") from e


def unpack(packed: bytes, size: int) -> bytes:
    """A block behind its size. ValueError if the sizes differ or the block is broken."""
    if len(packed) < 4 or struct.unpack_from("<I", packed)[0] != size or _length(packed[4:]) != size:
        raise ValueError("not a block of that size")
    try:
        return pa.decompress(packed[4:], decompressed_size=size, codec="lz4_raw", asbytes=True)
    except (OSError, pa.ArrowInvalid) as e:
        raise ValueError("broken block") from e


def stored(value: Column) -> Column:
    """``compressed, size, data`` of a text or binary value; NULL for NULL."""

    def run(values: pa.Array) -> pa.Array:
        out = []
        for v in values.to_pylist():
            packed = None if v is None else pack(v)
            out.append(None if v is None else {"compressed": packed is not None, "size": len(v), "data": v if packed is None else packed})
        return pa.array(out, _KEPT)

    run.__annotations__ = {"values": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "struct<compressed boolean, size bigint, data binary>")(value.cast("binary"))


def restored(kept: Column) -> Column:
    """The value of ``stored``; a broken block is NULL."""

    def run(values: pa.Array) -> pa.Array:
        out = []
        for v in values.to_pylist():
            try:
                out.append(None if v is None else unpack(v["data"], v["size"]) if v["compressed"] else v["data"])
            except ValueError:
                out.append(None)
        return pa.array(out, pa.binary())

    run.__annotations__ = {"values": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "binary")(kept)
