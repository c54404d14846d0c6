"""Keyed digests and canonical forms from built-in functions alone."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64


def canonical_json(*names: str) -> Column:
    """The columns as a JSON object without spaces, its keys in order; a null has no key."""
    return F.to_json(F.struct(*sorted(names)))


def hmac_sha256(message: Column, key: bytes) -> Column:
    """The HMAC of a message (text is UTF-8) as binary; the padded keys are constants of the plan, the digests two of Spark's own."""
    key = (hashlib.sha256(key).digest() if len(key) > BLOCK else key).ljust(BLOCK, b"\0")
    inner, outer = (F.lit(bytearray(x ^ pad for x in key)) for pad in (0x36, 0x5C))
    return F.unhex(F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256))


def base64url(data: Column) -> Column:
    """Base 64 for names and addresses: - and _ for + and /, no padding, no line breaks."""
    return F.translate(F.translate(F.base64(data), "+/", "-_"), "=\r\n", "")


def keyed_digest(key: bytes, *names: str) -> Column:
    return base64url(hmac_sha256(canonical_json(*names), key))
