"""Encrypted values: a magic, a 12-byte nonce, then AES-GCM ciphertext with its tag."""

from __future__ import annotations

import base64
import hashlib
import hmac

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed value: the magic that marks an encrypted blob
MAGIC = b"MKVENC01"
#: Magic, nonce and tag: no encrypted value is shorter.
LEAST = len(MAGIC) + 12 + 16


def derive_key(master_b64: str, context: str) -> bytes:
    """HKDF-SHA256 of a base64 master key of at least 32 bytes, for one context."""
    try:
        master = base64.b64decode(master_b64, validate=True)
    except ValueError as e:
        raise ValueError("the master key is not base64") from e
    if len(master) < 32:
        raise ValueError("the master key has less than 32 bytes")
    extracted = hmac.new(bytes(32), master, hashlib.sha256).digest()
    return hmac.new(extracted, context.encode() + b"\x01", hashlib.sha256).digest()


def encrypted(value: Column, key: bytes) -> Column:
    return F.concat(F.lit(MAGIC), F.aes_encrypt(value.cast("binary"), F.lit(key), F.lit("GCM")))


def is_encrypted(value: Column) -> Column:
    data = value.cast("binary")
    return (F.octet_length(data) >= LEAST) & F.startswith(data, F.lit(MAGIC))


def decrypted(value: Column, key: bytes) -> Column:
    """The plaintext; what is not encrypted, or not with this key, passes through."""
    data = value.cast("binary")
    opened = F.try_aes_decrypt(F.substring(data, len(MAGIC) + 1, 2_147_483_647), F.lit(key), F.lit("GCM"))
    return F.when(is_encrypted(data), F.coalesce(opened, data)).otherwise(data)
