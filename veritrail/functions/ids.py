"""Deterministic identifiers and digests as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the name space of stable ids.
NAMESPACE = "69353598-1dc0-4aeb-98d9-f8ed395da6ad"


def uuid5(value: Column, namespace: str = NAMESPACE) -> Column:
    """The name-based (SHA-1) UUID of value: version and variant bits set in the first 16 bytes of the digest."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(value, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 2), 16, 10).cast("int").bitwiseAND(0x3F).bitwiseOR(0x80)))
    return F.concat_ws(
        "-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 19, 2)), F.substring(digest, 21, 12),
    )


def stable_id(prefix: str, value: Column) -> Column:
    return F.concat(F.lit(f"{prefix}_"), uuid5(value))


def cache_key(kind: str, value: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{kind}:"), value), 256)


def chunk_id(text: Column) -> Column:
    """Identical texts share an id, wherever they occur."""
    return F.sha1(text)
