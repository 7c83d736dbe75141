"""HMAC-SHA256 of columns, in the JVM: two nested hashes over the key's pads."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64  # bytes of a block of SHA-256


def pads(key: str | bytes) -> tuple[bytes, bytes]:
    """The key's inner and outer pad; a key longer than a block is hashed first."""
    raw = key.encode() if isinstance(key, str) else key
    raw = (hashlib.sha256(raw).digest() if len(raw) > _BLOCK else raw).ljust(_BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in raw), bytes(b ^ 0x5C for b in raw)


def sign(payload: Column, key: str | bytes) -> Column:
    """HMAC-SHA256 in lower-case hex of a text or binary column; null stays null."""
    inner, outer = (F.lit(bytearray(p)) for p in pads(key))
    once = F.sha2(F.concat(inner, payload.cast("binary")), 256)
    return F.sha2(F.concat(outer, F.unhex(once)), 256)
