"""Keyed pseudonyms, in pure Catalyst."""

from __future__ import annotations

import os

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY_VARIABLE = "PERMITLAKE_KEY"


def pads(key: bytes) -> tuple[bytes, bytes]:
    """The inner and outer pad of HMAC-SHA256; an empty key is refused."""
    if not key:
        raise ValueError("a pseudonym needs a key; without one it can be found by trying all identifiers")
    import hashlib

    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def pseudonym(subject: Column, key: bytes) -> Column:
    """HMAC-SHA256 of the identifier, its first 32 hex digits."""
    inner, outer = pads(key)
    first = F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(subject, "UTF-8")), 256))
    return F.substring(F.sha2(F.concat(F.lit(outer), first), 256), 1, 32)


def key_from_env(variable: str = KEY_VARIABLE) -> bytes:
    value = os.environ.get(variable)
    if not value:
        raise ValueError(f"{variable} is not set, and a made-up key would match nothing recorded before")
    return value.encode()
