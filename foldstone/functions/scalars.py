"""Scalar functions of the store as column expressions. NULL in, NULL out."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from foldstone.functions.normalise import decoded_key

_HEX2 = "(..)"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def content_hash(c: Column | str) -> Column:
    """SHA-256 as 64 hex digits; the BLAKE3 form is ``foldstone.functions.blake3``."""
    return F.sha2(_col(c).cast("binary"), 256)


def little_endian(hexed: Column) -> Column:
    """The first 8 bytes of a hex digest in reverse: as text it orders like the unsigned number."""
    return F.concat(*(F.substring(hexed, i, 2) for i in range(15, 0, -2)))


def shard_of(hexed: Column, shards: int) -> Column:
    """The first 8 bytes of a digest, little-endian and unsigned, modulo ``shards``."""
    return (F.conv(little_endian(hexed), 16, 10).cast("decimal(20,0)") % F.lit(shards)).cast("bigint")


def blob_prefix(hexed: Column) -> Column:
    """The two directory levels of a blob: its first two digest bytes."""
    return F.concat_ws("/", F.substring(hexed, 1, 2), F.substring(hexed, 3, 2))


def key_valid(c: Column | str) -> Column:
    """1 to 1024 bytes, no control characters."""
    c = _col(c)
    return F.octet_length(c).between(1, 1024) & ~F.rlike(c, F.lit(r"\p{Cc}"))


def encode_key(c: Column | str) -> Column:
    """Percent-encode controls, blanks, ``/ % ? # &`` and every byte beyond ASCII, upper-case digits."""
    escaped = lambda ch: F.regexp_replace(F.hex(ch), _HEX2, "%$1")
    coded = F.transform(F.split(_col(c), ""), lambda ch: F.when(F.rlike(ch, F.lit(r"[\x00-\x20\x7f/%?#&]|[^\x00-\x7f]")), escaped(ch)).otherwise(ch))
    return F.array_join(coded, "")


decode_key = decoded_key


def format_bytes(c: Column | str) -> Column:
    """``B`` to ``PB`` in steps of 1024 with two decimals, ties to even."""
    size = _col(c).cast("double")
    units = ["B", "KB", "MB", "GB", "TB", "PB"]  # fixed values
    shown = None
    for i in reversed(range(len(units))):
        text = F.format_string(f"%.2f {units[i]}", F.bround(size / F.lit(float(1024**i)), 2))
        shown = text if shown is None else F.when(size < F.lit(float(1024 ** (i + 1))), text).otherwise(shown)
    return F.when(size.isNotNull(), shown)


# fixed values: the suffixes of durations, in milliseconds
UNITS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}
_DURATION = rf"^\+?([0-9]{{1,18}})({'|'.join(UNITS)})$"


def parse_duration(c: Column | str) -> Column:
    """Milliseconds of ``<number>(ms|s|m|h|d)``, trimmed; NULL for anything else."""
    text = F.trim(_col(c))
    number, unit = F.regexp_extract(text, _DURATION, 1).try_cast("bigint"), F.regexp_extract(text, _DURATION, 2)
    scale = F.coalesce(*(F.when(unit == u, F.lit(n)) for u, n in UNITS.items()))
    return F.try_multiply(number, scale.cast("bigint"))


def duration_ms(text: str) -> int | None:
    """The same of one text."""
    found = re.match(_DURATION, text.strip(" "))
    return int(found.group(1)) * UNITS[found.group(2)] if found else None
